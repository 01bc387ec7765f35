"""Checks of texts against evidence and style: numbers, wording, batteries, conformance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import settled
from ..functions.stats import wilson
from ..functions.text import sentences, strip_markdown, without_style


def numbers(texts: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """key and number: whole numbers in a text or page, thousands commas left out; the parts
    of a decimal are two. Numbers of more than 15 digits are no figures."""
    found = F.regexp_extract_all(without_style(F.col(text)), F.lit(r"\b(\d{1,3}(?:,\d{3})+|\d+)\b"), F.lit(1))
    plain = texts.select(key, F.explode(found).alias("d")).select(key, F.replace("d", F.lit(","), F.lit("")).alias("d"))
    return plain.filter(F.length("d") <= 15).select(key, F.col("d").cast("long").alias("number"))


def percents(texts: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """key and percent: percentages with decimals."""
    found = F.regexp_extract_all(without_style(F.col(text)), F.lit(r"\b(\d+\.\d+)%"), F.lit(1))
    return texts.select(key, F.explode(found).alias("d")).select(key, F.col("d").cast("double").alias("percent"))


def unsupported_percents(found: DataFrame, evidence: DataFrame) -> DataFrame:
    """Percentages that the evidence (percent) doesn't hold."""
    return found.join(evidence.select("percent").distinct(), "percent", "left_anti").select(*found.columns).distinct()


def unsupported(found: DataFrame, evidence: DataFrame, allowed: DataFrame | None = None, least: int = 100) -> DataFrame:
    """Numbers of `least` or more that neither the evidence nor the exceptions hold."""
    known = evidence.select("number")
    if allowed is not None:
        known = known.unionByName(allowed.select("number"))
    return found.filter(F.col("number") >= least).join(known.distinct(), "number", "left_anti").distinct()


# What a sentence must not exceed, one denial close behind another, and a
# pronoun that opens a paragraph.
MAX_WORDS = 28
NEGATION = r"(?i)\b(not|never|no|cannot|can't|without)\b[^.;]{0,40}?\b(not|never|no|nothing|none|nor|un\w+|in\w+valid)\b"
VAGUE = r"\n\n\s*(It|This|That|These|Those|They)\s+(?!is the|are the)"


def wording(texts: DataFrame, jargon: list[str], idioms: list[str], actors: str | None = None, key: str = "key", text: str = "text") -> DataFrame:
    """key, kind (jargon, idiom, actor, long, negation, vague) and n for each text."""
    plain = strip_markdown(F.col(text))
    low = F.lower(plain)
    count = lambda terms: sum((F.regexp_count(low, F.lit(rf"\Q{t}\E")) for t in terms), F.lit(0))
    said = settled(settled(texts, plain=plain), s=sentences(F.col("plain"))).select(key, "plain", "s", count(jargon).alias("jargon"), count(idioms).alias("idiom"))
    n = lambda test: F.size(F.filter("s", test))
    kinds = {"jargon": F.col("jargon"), "idiom": F.col("idiom"), "actor": F.regexp_count("plain", F.lit(actors)) if actors else F.lit(0), "long": n(lambda s: F.size(F.split(s, " ")) > MAX_WORDS), "negation": n(lambda s: s.rlike(NEGATION)), "vague": F.regexp_count("plain", F.lit(VAGUE))}
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), c.cast("long").alias("n")) for k, c in kinds.items()))
    return said.select(key, F.explode(rows).alias("x")).select(key, "x.*").filter("n > 0")


def score_battery(rows: DataFrame) -> DataFrame:
    """rows: stratum, expected, result. stratum, n, unexpected, rate, lo, hi in percent, one
    digit; rows without a result of pass or block don't count."""
    result, expected = F.lower(F.trim("result")), F.lower(F.trim("expected"))
    done = rows.filter(result.isin("pass", "block"))
    out = done.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if(result != expected).alias("unexpected"))
    w = wilson(F.col("unexpected"), F.col("n"))
    pct = lambda c: F.round(c * 100, 1)
    return out.withColumn("w", w).select("stratum", "n", "unexpected", pct(F.col("w.p")).alias("rate"), pct(F.col("w.lo")).alias("lo"), pct(F.col("w.hi")).alias("hi"))


def control_warnings(rows: DataFrame, clean: str = "H control-clean", block: str = "I control-block") -> DataFrame:
    """stratum and n of controls with the wrong result."""
    result = F.lower(F.trim("result"))
    wrong = ((F.col("stratum") == clean) & (result == "block")) | ((F.col("stratum") == block) & (result == "pass"))
    return rows.filter(wrong).groupBy("stratum").agg(F.count("*").alias("n"))


def conformance(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """expected: id, action, filtered (null: any); actual: id, action, filtered. The rows that
    fail, with both."""
    got = actual.select("id", F.col("action").alias("got_action"), F.col("filtered").alias("got_filtered"))
    rows = expected.join(got, "id", "left")
    same = F.col("action").eqNullSafe(F.col("got_action")) & (F.col("filtered").isNull() | F.col("filtered").eqNullSafe(F.col("got_filtered")))
    return rows.filter(~same)
