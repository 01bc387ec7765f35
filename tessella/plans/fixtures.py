"""Neutral inputs of the catalogue: lexicon, allowlist, messages and lists, as rows that
both Spark and SQL are given."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import LATIN, LETTERS, tokens

# term_ord, text, tier, mode, locales
TERMS = [
    (0, "tion", 2, "sub", None),
    (1, "the", 1, "prefix", None),
    (2, "der", 3, "word", None),
    (3, "und", 2, "word", ["de"]),
    (4, "que", 2, "word", ["es", "fr"]),
    (5, "ouan", 4, "sub", None),
    (6, "thing", 3, "word", None),
    (7, "ering", 3, "prefix", None),
    (8, "leau", 2, "sub", ["fr"]),
    (9, "enth", 2, "prefix", None),
    (10, "blast", 2, "prefix", None),
    (11, "darn", 2, "prefix", None),
]
ALLOW = ["retion", "ertion", "attion", "estion", "ention", "oution", "darnel", "blaster", "of the", "erings", "queci", "there", "enthion"]
MESSAGES = [
    "d a r n it",
    "d.a.r.n",
    "d-a-r-n now",
    "daaaarn",
    "d4rn",
    "DARN",
    "red arnica",
    "darnel grows",
    "bla st",
    "dar n",
    "b l a s t",
    "blaster is fine",
    "blasted",
    "the!",
    "t|h|i|n|g",
    "  ..the der und  ",
    "thimg and ering",
    "eringg",
    "th1ng",
    "of the thing",
    "ouan der tion",
    "...",
    "x",
    "éring thïng",
]
ENTRIES = ["an", "th", "of", "ou", "the", "und", "que", "der", "ing", "ent", "tion", "leau", "sch", "thing", "ering", "lich", "ation", "able", "on", "keit", "widget", "ring", "red"]
# What probes say: words, each at its place.
WORDS = ["gribble", "sandor", "malto", "corvin", "ks", "plentor", "darnel", "nettle", "bramble", "torvald", "quillon", "zephyr", "marrow", "fennel", "osprey", "tin", "candle", "lantern", "ember", "willow", "cinder", "maltose", "sandy", "networks", "disks", "plenty", "corvina", "brambles", "nettled", "embers", "marrows", "ring", "string", "stringing", "to", "vald", "lan", "ant", "and", "rr"]
CARRIED = (("xx", "xx"), ("qz", "jv"))
ROOTS = ["thing", "ou", "keit"]
PREFIXES = ["", "un", "re", "en"]
SUFFIXES = ["", "s", "ed", "ing", "tion"]
EXCEPTIONS = ["ouring", "out"]
LOCALES = ["en", "de", "fr", "es"]
TEXT, LONG, INT = pa.string(), pa.int64(), pa.int32()


def local(spark: SparkSession, values: list[tuple], **columns: pa.DataType) -> DataFrame:
    """A literal relation, whose size the optimizer knows."""
    rows = list(zip(*values)) or [()] * len(columns)
    return spark.createDataFrame(pa.table({n: pa.array(list(x), t) for (n, t), x in zip(columns.items(), rows)}))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(spark: SparkSession, name: str, values: list[str]) -> DataFrame:
    return local(spark, [(v,) for v in values], **{name: TEXT})


def numbered(spark: SparkSession, name: str, values: list[str]) -> DataFrame:
    return local(spark, [(v, i) for i, v in enumerate(values)], **{name: TEXT, f"{name}_ord": INT})


def terms(spark: SparkSession) -> DataFrame:
    return local(spark, TERMS, term_ord=LONG, text=TEXT, tier=INT, mode=TEXT, locales=pa.list_(TEXT))


def allow(spark: SparkSession) -> DataFrame:
    return column(spark, "word", ALLOW)


def messages(spark: SparkSession, sf_dir: str, surface: str = "public") -> DataFrame:
    """Turns of conversations, whose locale goes by their number, and the messages above,
    numbered down from -1."""
    locale = F.element_at(F.array(*map(F.lit, LOCALES)), (F.pmod("conv_id", F.lit(4)) + 1).cast("int"))
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "text", F.lit(surface).alias("surface"), locale.alias("locale"))
    extra = local(spark, [(-1 - i, t, surface, "en") for i, t in enumerate(MESSAGES)], msg_id=LONG, text=TEXT, surface=TEXT, locale=TEXT)
    return turns.unionByName(extra)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a line of text, labelled by role."""
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_id"), F.col("role").alias("label"), F.col("text").alias("line"))


def entries(spark: SparkSession) -> DataFrame:
    return column(spark, "entry", ENTRIES)


def own_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of authored strings: names of parts."""
    return table(spark, sf_dir, "part").select(F.explode(tokens(F.lower("p_name"), LATIN)).alias("word")).distinct()


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(tokens(F.lower("text"), LETTERS)).alias("word")).distinct()


def probes(spark: SparkSession, sf_dir: str, lone_errors: bool = False) -> DataFrame:
    """A probe log made of events: the word goes by user, its frame by event. With
    lone_errors, the words of errors are marked as their own."""
    e = table(spark, sf_dir, "events")
    word = F.element_at(F.array(*map(F.lit, WORDS)), (F.pmod("user_id", F.lit(len(WORDS))) + 1).cast("int"))
    wrap = F.when(F.pmod("event_id", F.lit(7)) == 0, F.concat(F.lit("xx"), word, F.lit("xx"))).when(F.pmod("event_id", F.lit(7)) == 1, F.concat(F.lit("qz"), word, F.lit("jv"))).otherwise(word)
    if lone_errors:
        wrap = F.when(F.col("event_type") == "error", F.concat(F.lit("err"), wrap)).otherwise(wrap)
    short = F.length(word) <= 5
    result = F.when(F.col("event_type") == "error", "mismatch").when((F.col("event_type") == "click") | ((F.col("event_type") == "view") & short), "blocked").otherwise("sent")
    phase = F.when(F.pmod("user_id", F.lit(11)) == 3, "stage1").otherwise("sweep")
    tag = F.concat(F.lit("t"), F.pmod("event_id", F.lit(5)).cast("string"))
    return e.select(wrap.alias("text"), result.alias("result"), tag.alias("tag"), F.col("event_id").alias("t"), phase.alias("phase"), F.lit(0).alias("src_ord"))


LANGUAGES = [("t0", "en"), ("t1", "de"), ("t2", "fr"), ("t3", "es")]
