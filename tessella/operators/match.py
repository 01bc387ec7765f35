"""Finding many terms in many texts.

A term is found by its first characters: texts are cut into blocks that overlap, a
block into positions, and the seed at a position is looked up among the terms'
seeds; what follows is then compared. The lexicon is measured and broadcast, in
several parts if it is larger than a part may be, so texts are never moved: all
overlapping occurrences come out of one narrow stage, at a cost linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import ALNUM
from ..functions.tokens import tokens

SEED = 3
CHUNK = 8192
BLOCK = 128
#: Bytes of a lexicon that are broadcast at once.
PART = 32 << 20


def parts(df: DataFrame, key: str, size: int, limit: int = PART) -> list[DataFrame]:
    """df, whose rows take `size` bytes in all, cut by a hash of key into as many parts as
    keep each below `limit`; each is to be broadcast."""
    n = -(-size // limit) or 1
    if n == 1:
        return [F.broadcast(df)]
    return [F.broadcast(df.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i)) for i in range(n)]


def row_bytes(df: DataFrame) -> Column:
    """About what a row of df takes in a hash table, to be summed."""
    return F.octet_length(F.to_json(F.struct(*df.columns))) + 64


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for one in frames[1:]:
        out = out.unionByName(one)
    return out


def dealt(df: DataFrame) -> DataFrame:
    """df on all cores. A table too small for one scan partition a core, by the optimizer's
    estimate, would leave most of them idle in the searching stage; only such a one is
    dealt out, so what is moved is bounded by the size of the cluster."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split else df


def occurrences(texts: DataFrame, terms: DataFrame, text: str = "text", term: str = "term", limit: int = PART, deal: bool = True) -> DataFrame:
    """Every occurrence of every term: texts' columns but text, terms' columns, start, end,
    left and right (the characters around it, a space at the ends). Null and empty texts
    and terms have none. Terms are read twice, to be measured and to be sent; a small
    table of texts is dealt out first unless deal is False."""
    texts = dealt(texts) if deal else texts
    terms = terms.filter(F.length(term) > 0)
    keys = [c for c in texts.columns if c != text]
    n = F.length(term)
    shape = terms.agg(F.max(n).alias("most"), F.array_sort(F.collect_set(F.least(n, F.lit(SEED)))).alias("sizes"), F.sum(row_bytes(terms)).alias("bytes")).first()
    most, sizes = shape.most or 1, shape.sizes or [1]
    # A chunk begins one character before its first place and ends so far behind its last.
    padded = texts.filter(F.length(text) > 0).select(*keys, F.concat(F.lit(" "), F.col(text), F.lit(" ")).alias("_t"))
    cut = lambda rows, size: F.explode(F.sequence(F.lit(0), F.floor((F.length(rows) - 3) / size).cast("int")))
    chunks = padded.withColumn("_b", cut("_t", CHUNK)).select(*keys, (F.col("_b") * CHUNK).alias("_o"), F.substring("_t", F.col("_b") * CHUNK + 1, F.lit(CHUNK + most + 1)).alias("_t"))
    blocks = chunks.withColumn("_b", cut(F.substring("_t", F.lit(1), F.lit(CHUNK + 2)), BLOCK)).select(*keys, (F.col("_o") + F.col("_b") * BLOCK).alias("_o"), F.substring("_t", F.col("_b") * BLOCK + 1, F.lit(BLOCK + most + 1)).alias("_w"))
    last = F.least(F.lit(BLOCK + 1), F.length("_w") - 1)
    at = blocks.withColumn("_p", F.explode(F.sequence(F.lit(2), last)))
    seed = [F.substring("_w", F.col("_p"), F.lit(k)) for k in sizes]
    at = at.withColumn("_seed", F.explode(F.array(*seed)) if len(seed) > 1 else seed[0])
    known = terms.withColumn("_seed", F.substring(term, 1, SEED))
    found = union([at.join(part, "_seed") for part in parts(known, "_seed", shape.bytes or 0, limit)])
    found = found.filter(F.substring("_w", F.col("_p"), n) == F.col(term))
    start = F.col("_o") + F.col("_p") - 2
    return found.select(*keys, *terms.columns, start.alias("start"), (start + n).alias("end"), F.substring("_w", F.col("_p") - 1, F.lit(1)).alias("left"), F.substring("_w", F.col("_p") + n, F.lit(1)).alias("right"))


def at_boundary(mode: Column, left: Column, right: Column) -> Column:
    """Whether an occurrence has the bounds that its term's mode asks for."""
    free = lambda c: ~c.rlike(ALNUM)
    return (mode == "sub") | (free(left) & ((mode == "prefix") | free(right)))


def in_locale(locales: Column, locale: Column) -> Column:
    return locales.isNull() | F.array_contains(locales, locale)


def neighbourhood(word: Column) -> Column:
    """The word and what is left of it when one character goes."""
    n = F.length(word)
    less = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.array_distinct(F.concat(F.array(word), F.when(n > 0, less).otherwise(F.array().cast("array<string>"))))


def fuzzy(words: DataFrame, terms: DataFrame, word: str = "token", term: str = "term", limit: int = PART) -> DataFrame:
    """words joined with the terms one edit away from them (not equal). Both sides become
    what is left when one character goes, which words one edit apart share; the terms'
    side is measured and broadcast. A pair that shares several is taken at the least."""
    size = terms.agg(F.min(F.length(term)).alias("low"), F.max(F.length(term)).alias("high"), F.sum((F.length(term) + 1) * row_bytes(terms)).alias("bytes")).first()
    low, high = (size.low or 0) - 1, (size.high or 0) + 1
    known = terms.withColumn("_near", neighbourhood(F.col(term))).withColumn("_key", F.explode("_near"))
    mine = words.filter(F.length(word).between(low, high)).withColumn("_mine", neighbourhood(F.col(word))).withColumn("_key", F.explode("_mine"))
    found = union([mine.join(part, "_key") for part in parts(known, "_key", 2 * (size.bytes or 0), limit)])
    found = found.filter((F.col(word) != F.col(term)) & (F.levenshtein(F.col(word), F.col(term), 1) == 1))
    return found.filter(F.col("_key") == F.array_min(F.array_intersect("_mine", "_near"))).drop("_key", "_mine", "_near")


def containing(words: DataFrame, parts: DataFrame, word: str = "word", part: str = "part", strict: bool = False) -> DataFrame:
    """words joined with every part that they contain, once each, with pos (of the first
    place, from 0). With strict, equal ones are left out."""
    distinct = words.select(F.col(word).alias("_word")).distinct()
    hits = occurrences(distinct.withColumn("_x", F.col("_word")), parts.select(F.col(part).alias("term")).distinct(), text="_x")
    hits = hits.groupBy("_word", "term").agg(F.min("start").alias("pos"))
    if strict:
        hits = hits.filter("_word <> term")
    return words.join(hits.withColumnRenamed("_word", word).withColumnRenamed("term", part), word)


def whole_words(texts: DataFrame, terms: DataFrame, pattern: str, text: str = "text", term: str = "term") -> DataFrame:
    """texts' rows (without text) and the terms that are among their tokens, once each."""
    keys = [c for c in texts.columns if c != text]
    found = texts.select(*keys, F.explode(F.array_distinct(tokens(F.lower(text), pattern))).alias(term))
    return found.join(terms.select(term).distinct(), term).select(*keys, term)
