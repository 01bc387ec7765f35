"""Screens that keep unsafe words off allowlists, and builders of allowlists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams
from ..functions.tokens import LETTERS3, UNSPACED, tokens
from .match import occurrences


def by_containment(words: DataFrame, roots: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """word and root: words that hold a root, with the first of them (root_ord); words in
    exceptions are let pass. roots: root, root_ord."""
    distinct = words.select("word").distinct()
    if exceptions is not None:
        distinct = distinct.join(exceptions.select("word").distinct(), "word", "left_anti")
    found = occurrences(distinct.withColumn("text", F.lower("word")), roots.select(F.col("root").alias("term"), "root_ord"))
    return found.groupBy("word").agg(F.min_by("term", "root_ord").alias("root"))


def by_derivation(words: DataFrame, roots: DataFrame, prefixes: DataFrame, suffixes: DataFrame) -> DataFrame:
    """word and reason (prefix+root+suffix without empty ends): words made of a root between
    known affixes; a bare root is its own reason, else the first derivation in order of
    root, prefix and suffix counts. The three lists are short; they are combined once
    and joined by equality. roots: root, root_ord; prefixes: prefix, prefix_ord; ..."""
    made = roots.crossJoin(prefixes).crossJoin(suffixes).select(F.concat("prefix", "root", "suffix").alias("_w"), F.regexp_replace(F.concat_ws("+", "prefix", "root", "suffix"), r"^\++|\++$", "").alias("reason"), F.struct(F.lit(1).alias("d"), F.col("root_ord").alias("r"), F.col("prefix_ord").alias("p"), F.col("suffix_ord").alias("s")).alias("at"))
    bare = roots.select(F.col("root").alias("_w"), F.col("root").alias("reason"), F.struct(F.lit(0).alias("d"), F.col("root_ord").alias("r"), F.lit(0).alias("p"), F.lit(0).alias("s")).alias("at"))
    known = made.unionByName(bare).groupBy("_w").agg(F.min_by("reason", "at").alias("reason"))
    return words.select("word").distinct().join(known, F.lower("word") == F.col("_w")).select("word", "reason")


def by_affix(words: DataFrame, terms: DataFrame, prefixes: list[str], suffixes: list[str]) -> DataFrame:
    """word and term: words that are a term, or a term of three characters or more with one
    of the affixes."""
    long = terms.filter(F.length("term") >= 3)
    none = F.array().cast("array<string>")
    listed = lambda xs: F.array(*map(F.lit, xs)) if xs else none
    made = F.concat(F.transform(listed(suffixes), lambda s: F.concat("term", s)), F.transform(listed(prefixes), lambda p: F.concat(p, "term")))
    known = long.select("term", F.explode(made).alias("_w")).unionByName(terms.select("term", F.col("term").alias("_w")))
    known = known.groupBy("_w").agg(F.min("term").alias("term"))
    return words.select("word").distinct().join(known, F.lower("word") == F.col("_w")).select("word", "term")


def screened(words: DataFrame, *rejections: DataFrame) -> DataFrame:
    """word and reason (null if it passes). rejections: word, reason; the first one wins."""
    reasons = None
    for i, r in enumerate(rejections):
        one = r.select("word", F.struct(F.lit(i).alias("i"), F.col(r.columns[1]).alias("reason")).alias("x"))
        reasons = one if reasons is None else reasons.unionByName(one)
    first = reasons.groupBy("word").agg(F.min("x").alias("x"))
    return words.select("word").distinct().join(first, "word", "left").select("word", F.col("x.reason").alias("reason"))


def flagged_words(flags: DataFrame, keep_borderline: bool = False) -> DataFrame:
    """word and reason of review flags: word, severity, detail."""
    rows = flags.filter("severity <> 'borderline'") if keep_borderline else flags
    return rows.select(F.lower("word").alias("word"), F.concat_ws(": ", "severity", "detail").alias("reason"))


def collect_words(lines: DataFrame, low: int = 3, high: int = 24, pattern: str = LETTERS3) -> DataFrame:
    """word and sources (sorted set of labels) of label, line."""
    words = lines.select("label", F.explode(tokens(F.col("line"), pattern)).alias("w")).select("label", F.lower("w").alias("word"))
    return words.filter(F.length("word").between(low, high)).groupBy("word").agg(F.array_sort(F.collect_set("label")).alias("sources"))


def source_counts(collected: DataFrame) -> DataFrame:
    return collected.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count("*").alias("words"))


def phrases(lines: DataFrame, low: int = 2, high: int = 4, most: int | None = None, pattern: str = UNSPACED) -> DataFrame:
    """phrase and n: n-grams that occur more than once in runs of scripts without spaces;
    the most frequent `most`, if given."""
    runs = lines.select(F.explode(tokens(F.col("line"), pattern)).alias("run"))
    grams = runs.select(F.explode(ngrams(F.col("run"), low, high)).alias("phrase"))
    out = grams.groupBy("phrase").agg(F.count("*").alias("n")).filter("n > 1")
    return out.orderBy(F.desc("n"), "phrase").limit(most) if most is not None else out
