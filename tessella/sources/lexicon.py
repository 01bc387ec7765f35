"""Lexicons, allowlists and policies.

A lexicon is term_ord, text, tier, mode, locales (null: all); an allowlist is word; a
policy is surface, tier, action, mask_char. Tiers run from 0 (none) to 4 (illegal);
actions are 0 allow, 1 mask, 2 block and 3 review, and the larger number wins.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names by number, and the built-in policies by tier 1 to 4.
TIERS = ("NONE", "MILD", "STRONG", "SEVERE", "ILLEGAL")
ACTIONS = ("ALLOW", "MASK", "BLOCK", "REVIEW")
POLICIES = {"private": (0, 0, 1, 2), "public": (0, 1, 2, 2), "identifier": (2, 2, 2, 2)}
LEXICON = "term_ord bigint, text string, tier int, mode string, locales array<string>"


def action_name(c: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ACTIONS)), c + 1)


def default_policy(spark: SparkSession) -> DataFrame:
    rows = [(s, i + 1, a, "*") for s, actions in POLICIES.items() for i, a in enumerate(actions)]
    surface, tier, action, mask = (list(c) for c in zip(*rows))
    return spark.createDataFrame(pa.table({"surface": surface, "tier": pa.array(tier, pa.int32()), "action": pa.array(action, pa.int32()), "mask_char": mask}))


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """value and line_ord (order of paths, then of lines) of text files; blank lines and
    comments left out. Bytes that aren't UTF-8 are replaced."""
    out = None
    for i, path in enumerate(paths):
        one = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "value")).select((F.lit(i << 40) + F.col("n")).alias("line_ord"), F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out.filter("value <> '' and not startswith(value, '#')")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; rows without text are comments, a malformed row is an error."""
    raw = lines(spark, path).select("line_ord", F.from_json("value", "text string, tier int, mode string, locales array<string>", {"mode": "FAILFAST"}).alias("r"))
    rows = raw.filter("r.text is not null")
    return rows.select(F.col("line_ord").alias("term_ord"), F.lower("r.text").alias("text"), F.coalesce("r.tier", F.lit(2)).alias("tier"), F.coalesce("r.mode", F.lit("word")).alias("mode"), F.when(F.size("r.locales") > 0, F.col("r.locales")).alias("locales"))


def read_allowlist(spark: SparkSession, *paths: str) -> DataFrame:
    return lines(spark, *paths).select(F.lower("value").alias("word")).distinct()


def read_phrases(spark: SparkSession, *paths: str) -> DataFrame:
    """Phrases keep their case."""
    return lines(spark, *paths).select(F.col("value").alias("phrase")).distinct()


def read_policy(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of surfaces laid over the built-in policies; a surface in it replaces
    the built-in one."""
    shape = "map<string, struct<actions: map<string, string>, mask_char: string>>"
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", shape, {"mode": "FAILFAST"})).alias("surface", "p"))
    number = lambda names, c: F.array_position(F.array(*map(F.lit, names)), c).cast("int") - 1
    given = raw.select("surface", F.coalesce("p.mask_char", F.lit("*")).alias("mask_char"), F.explode("p.actions").alias("t", "a")).select("surface", number(TIERS, F.col("t")).alias("tier"), number(ACTIONS, F.col("a")).alias("action"), "mask_char")
    return default_policy(spark).join(given.select("surface").distinct(), "surface", "left_anti").unionByName(given)


def read_list(spark: SparkSession, path: str, bare: bool = True) -> DataFrame:
    """word, ord of a list: a JSON array of strings if the file begins with [, else lines,
    which are JSON objects with text, JSON strings, or bare words if those are let in."""
    whole = spark.read.text(path, wholetext=True)
    array = whole.filter(F.ltrim("value").startswith("[")).select(F.posexplode(F.from_json("value", "array<string>")).alias("ord", "word"))
    each = whole.filter(~F.ltrim("value").startswith("[")).select(F.posexplode(F.split("value", "\r?\n")).alias("ord", "v")).withColumn("v", F.trim("v")).filter("v <> '' and not startswith(v, '#')")
    plain = F.col("v") if bare else F.lit(None).cast("string")
    word = F.when(F.col("v").startswith("{"), F.get_json_object("v", "$.text")).when(F.col("v").startswith('"'), F.regexp_extract("v", '^"(.*)"$', 1)).otherwise(plain)
    return array.unionByName(each.select("ord", word.alias("word"))).filter("word is not null and word <> ''")


def read_words(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Distinct lower-case words of three letters or more; the first `limit` in order."""
    from ..functions.tokens import LETTERS3, tokens

    out = spark.read.text(path).select(F.explode(tokens(F.col("value"), LETTERS3)).alias("w")).select(F.lower("w").alias("word")).distinct().orderBy("word")
    return out.limit(limit) if limit is not None else out


def read_corpora(spark: SparkSession, *specs: str) -> DataFrame:
    """label, line of text files given as label:path."""
    out = None
    for spec in specs:
        label, path = spec.split(":", 1)
        one = lines(spark, path).select(F.lit(label).alias("label"), F.col("value").alias("line"))
        out = one if out is None else out.unionByName(one)
    return out


def without_terms(allow: DataFrame, terms: DataFrame, word: str = "word", term: str = "term") -> DataFrame:
    """A term always beats the allowlist."""
    return allow.join(terms.select(F.col(term).alias(word)).distinct(), word, "left_anti")


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
