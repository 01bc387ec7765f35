"""The tokenizers; they differ on purpose."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normalize import places, settled

# The patterns.
GUARD = "[a-z0-9]+"
GUARD_CHARACTERS = string.ascii_lowercase + string.digits
HOST = r"[\p{L}0-9'-]+"
LETTERS = r"[\p{L}\p{Nl}\p{No}]+"
LETTERS2 = r"[\p{L}\p{Nl}\p{No}]{2,}"
LETTERS3 = r"[\p{L}\p{Nl}\p{No}]{3,}"
LATIN = "[a-z][a-z']*"
LATIN_DIGITS = "[a-z0-9']+"
ATTESTED = r"[a-z][a-z'\-]+"
UNSPACED = "[㐀-䶿一-鿿぀-ヿ฀-๿]+"


def tokens(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def with_token_spans(df: DataFrame, chars: str, out: str, alphabet: str = GUARD_CHARACTERS) -> DataFrame:
    """Adds out: array<struct<token, start, end>>, the runs of characters of `alphabet`,
    from chars, an array of characters; places count from 0."""
    mine = lambda j: F.coalesce(F.lit(alphabet).contains(F.get(chars, j)), F.lit(False))
    df = settled(df, _starts=F.filter(places(F.size(chars)), lambda j: mine(j) & ~mine(j - 1)))
    found = F.arrays_zip(tokens(F.array_join(chars, ""), f"[{re.escape(alphabet)}]+").alias("token"), F.col("_starts").alias("start"))
    return settled(df, **{out: F.transform(found, lambda t: F.struct(t["token"].alias("token"), t["start"].alias("start"), (t["start"] + F.length(t["token"])).alias("end")))}).drop("_starts")
