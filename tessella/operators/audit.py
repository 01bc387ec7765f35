"""Over- and under-blocking: baselines, matrices, what-if rules and remediation.

Lists are entries: entry (lower case, distinct). Lines are label, line_id, line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import evasions
from ..functions.tokens import LATIN, LATIN_DIGITS, LETTERS, tokens
from .match import occurrences, whole_words
from .verdict import Guard


def substring_hits(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """line_id and entry, once each, for entries that occur anywhere in a line."""
    low = lines.select("line_id", F.lower("line").alias("text"))
    return occurrences(low, entries.select(F.col("entry").alias("term"))).select("line_id", F.col("term").alias("entry")).distinct()


def word_hits(lines: DataFrame, entries: DataFrame, pattern: str = LATIN_DIGITS) -> DataFrame:
    """line_id and entry for entries that are whole words of a line."""
    return whole_words(lines.select("line_id", "line"), entries, pattern, "line", "entry")


def same_vocabulary(entries: DataFrame, allow: DataFrame | None = None) -> Guard:
    """A guard that knows just the entries, as strong terms that are whole words, so that a
    difference to another engine is one of matching."""
    terms = entries.select(F.xxhash64("entry").alias("term_ord"), F.col("entry").alias("text"), F.lit(2).alias("tier"), F.lit("word").alias("mode"), F.lit(None).cast("array<string>").alias("locales"))
    return Guard(terms, allow)


def guard_hits(lines: DataFrame, guard: Guard, surface: str = "public", locale: str = "en") -> DataFrame:
    """line_id of the lines that a guard flags as messages of one surface and locale."""
    messages = lines.select(F.col("line_id").alias("msg_id"), F.col("line").alias("text"), F.lit(surface).alias("surface"), F.lit(locale).alias("locale"))
    return guard.check(messages).filter("flagged").select(F.col("msg_id").alias("line_id"))


def flagged(lines: DataFrame, hits: DataFrame) -> DataFrame:
    return lines.join(hits.select("line_id").distinct(), "line_id", "left_semi")


def first_offender(lines: DataFrame, entries: DataFrame, allow: DataFrame | None = None, mode: str = "substring") -> DataFrame:
    """line_id and the entry that flags it: by substring the shortest and then leftmost, by
    word the first. Allowed entries are no offenders."""
    if allow is not None:
        entries = entries.join(allow.select(F.col("word").alias("entry")).distinct(), "entry", "left_anti")
    if mode == "word":
        each = lines.select("line_id", F.posexplode(tokens(F.lower("line"), LATIN)).alias("pos", "entry"))
        hits = each.join(entries.select("entry").distinct(), "entry")
        return hits.groupBy("line_id").agg(F.min_by("entry", "pos").alias("entry"))
    low = lines.select("line_id", F.lower("line").alias("text"))
    found = occurrences(low, entries.select(F.col("entry").alias("term")))
    return found.groupBy("line_id").agg(F.min_by("term", F.struct(F.length("term"), F.col("start"))).alias("entry"))


def longest_offender(words: DataFrame, entries: DataFrame) -> DataFrame:
    """word and the longest entry that is strictly shorter and in it, the leftmost of equal
    ones; words without one are left out."""
    distinct = words.select("word").distinct()
    found = occurrences(distinct.withColumn("text", F.lower("word")), entries.select(F.col("entry").alias("term")))
    found = found.filter(F.length("term") < F.length("word"))
    return found.groupBy("word").agg(F.max_by("term", F.struct(F.length("term"), -F.col("start"))).alias("entry"))


def offender_counts(offenders: DataFrame, examples: int = 3) -> DataFrame:
    """entry, n and up to `examples` words, for each entry that offends."""
    return offenders.groupBy("entry").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set("word")), 1, examples).alias("examples"))


def length_rule_hits(lines: DataFrame, entries: DataFrame, n: int) -> DataFrame:
    """Hits if entries shorter than n match whole words only (runs of letters)."""
    long, short = entries.filter(F.length("entry") >= n), entries.filter(F.length("entry") < n)
    return substring_hits(lines, long).unionByName(word_hits(lines, short, LETTERS)).distinct()


def length_rule_sweep(lines: DataFrame, entries: DataFrame, most: int = 5) -> DataFrame:
    """label, n, lines, flagged and pct for n from 1 (no rule) to most. All n come from one
    search: per line, the longest entry in it and the longest that is a word of it."""
    long = substring_hits(lines, entries).groupBy("line_id").agg(F.max(F.length("entry")).alias("sub"))
    short = word_hits(lines, entries, LETTERS).groupBy("line_id").agg(F.min(F.length("entry")).alias("word"))
    rows = lines.join(long, "line_id", "left").join(short, "line_id", "left").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(most))))
    hit = F.coalesce(F.col("sub") >= F.col("n"), F.lit(False)) | F.coalesce(F.col("word") < F.col("n"), F.lit(False))
    return share(rows, hit, "label", "n")


def share(rows: DataFrame, hit: Column, *by: str) -> DataFrame:
    """by, lines, flagged and pct (two digits) of rows."""
    return rows.groupBy(*by).agg(F.count("*").alias("lines"), F.count_if(hit).alias("flagged")).withColumn("pct", F.round(F.col("flagged") * 100 / F.col("lines"), 2))


def length_histogram(entries: DataFrame) -> DataFrame:
    """length, n and short (whether it is at most 3)."""
    return entries.groupBy(F.length("entry").alias("length")).agg(F.count("*").alias("n")).withColumn("short", F.col("length") <= 3)


def over_block(lines: DataFrame, engines: dict[str, DataFrame]) -> DataFrame:
    """label, engine, lines, flagged, pct. engines: name to the line_ids that it flags."""
    out = None
    for name, hits in engines.items():
        hit = hits.select("line_id").distinct().withColumn("hit", F.lit(True))
        one = share(lines.join(hit, "line_id", "left"), F.coalesce("hit", F.lit(False)), "label").withColumn("engine", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def evasion_corpus(terms: DataFrame, least: int = 4) -> DataFrame:
    """line_id, variant, line: every disguise of every term of `least` characters or more."""
    ways = evasions(F.col("term"))
    pairs = F.array(*(F.struct(F.lit(k).alias("variant"), v.alias("line")) for k, v in ways.items()))
    rows = terms.filter(F.length("term") >= least).select("term", F.explode(pairs).alias("p")).select("term", "p.variant", "p.line")
    return rows.withColumn("line_id", F.concat_ws("/", "variant", "term"))


def under_block(corpus: DataFrame, engines: dict[str, DataFrame]) -> DataFrame:
    """engine, variant (null for all of them), lines, flagged, pct."""
    out = None
    for name, hits in engines.items():
        hit = hits.select("line_id").distinct().withColumn("hit", F.lit(1))
        rows = corpus.join(hit, "line_id", "left")
        one = rows.rollup("variant").agg(F.count("*").alias("lines"), F.count("hit").alias("flagged")).withColumn("engine", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("pct", F.round(F.col("flagged") * 100 / F.col("lines"), 2))


def blast_radius(entries: DataFrame, own_words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """entry, length, own_broken, dict_broken, blast_radius, example: how many distinct
    words of one's own text (word) and of the dictionary hold the entry without being
    entries; the example is the first in order."""
    def broken(words: DataFrame, name: str) -> DataFrame:
        distinct = words.select(F.lower("word").alias("word")).distinct().join(entries.select(F.col("entry").alias("word")), "word", "left_anti")
        found = occurrences(distinct.withColumn("text", F.col("word")), entries.select(F.col("entry").alias("term"))).select("word", "term").distinct()
        return found.groupBy(F.col("term").alias("entry")).agg(F.count("*").alias(name), F.min("word").alias(f"{name}_example"))

    known = dictionary.filter(F.length("word") >= 3).filter(F.lower("word").rlike(r"^\p{L}+$"))
    rows = entries.join(broken(own_words, "own_broken"), "entry", "left").join(broken(known, "dict_broken"), "entry", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select("entry", F.length("entry").alias("length"), zero("own_broken").alias("own_broken"), zero("dict_broken").alias("dict_broken"), (zero("own_broken") + zero("dict_broken")).alias("blast_radius"), F.coalesce("own_broken_example", "dict_broken_example", F.lit("")).alias("example"))


def recommend(radius: DataFrame, own_words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """radius with recommended_action: in order, SCOPE:zh for one or two characters, DELETE
    if one's own text has the word, WHOLE-WORD if anything breaks, else KEEP; and
    rationale."""
    mark = lambda words, name: words.select(F.lower("word").alias("entry")).distinct().withColumn(name, F.lit(True))
    rows = radius.join(mark(own_words, "own"), "entry", "left").join(mark(dictionary, "english"), "entry", "left")
    some = F.col("blast_radius") > 0
    action = F.when(F.col("length") <= 2, "SCOPE:zh").when(F.col("own"), "DELETE").when(some, "WHOLE-WORD").otherwise("KEEP")
    why = F.when(F.col("length") <= 2, "one or two characters").when(F.col("own"), "used as a word in own text").when(F.col("english") & some, "an ordinary word").when(some, "breaks ordinary words").otherwise("breaks nothing measured")
    return rows.withColumn("recommended_action", action).withColumn("rationale", why).drop("own", "english")


# The ranks for which cumulative shares are shown.
PARETO = (5, 10, 20, 40, 60, 100, 200)


def pareto(radius: DataFrame, ranks: tuple[int, ...] = PARETO) -> DataFrame:
    """top, cumulative, total, pct: the share of all damage in the worst entries."""
    total = radius.agg(F.sum("blast_radius").alias("total"))
    worst = radius.orderBy(F.desc("blast_radius"), "entry").limit(max(ranks))
    ranked = worst.select("blast_radius", F.row_number().over(Window.orderBy(F.desc("blast_radius"), "entry")).alias("top"), F.sum("blast_radius").over(Window.orderBy(F.desc("blast_radius"), "entry").rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"))
    return ranked.filter(F.col("top").isin(*ranks)).crossJoin(total).select("top", "cumulative", "total", F.round(F.col("cumulative") * 100 / F.col("total"), 1).alias("pct"))


def simulate(lines: DataFrame, advice: DataFrame, ranks: tuple[int, ...] = (0, 5, 10, 20, 40)) -> DataFrame:
    """top, lines, flagged, pct after the advice for the worst `top` entries is taken:
    scoped and deleted ones no longer match, others only as whole words. Each line's
    hits are found once, with the rank of their entry."""
    bound = max(ranks)
    worst = advice.orderBy(F.desc("blast_radius"), "entry").limit(bound)
    ranked = worst.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("blast_radius"), "entry"))).select("entry", "rank")
    rows = advice.join(ranked, "entry", "left").select("entry", "recommended_action", F.coalesce("rank", F.lit(bound + 1)).alias("rank"))
    as_sub = substring_hits(lines, advice).join(rows, "entry").select("line_id", "rank", F.col("recommended_action").alias("action"))
    as_word = word_hits(lines, advice, LATIN).join(rows, "entry").filter("recommended_action = 'WHOLE-WORD'").select("line_id", "rank")
    # Still a substring beyond the rank or if it is kept; a word up to it.
    sub = as_sub.groupBy("line_id").agg(F.max(F.when(F.col("action") == "KEEP", bound + 1).otherwise(F.col("rank"))).alias("sub"))
    word = as_word.groupBy("line_id").agg(F.min("rank").alias("word"))
    each = lines.join(sub, "line_id", "left").join(word, "line_id", "left").withColumn("top", F.explode(F.array(*map(F.lit, ranks))))
    hit = F.coalesce(F.col("sub") > F.col("top"), F.lit(False)) | F.coalesce(F.col("word") <= F.col("top"), F.lit(False))
    return share(each, hit, "top")


def self_test(lines: DataFrame, entries: DataFrame, allow: DataFrame | None = None, mode: str = "substring") -> DataFrame:
    """The lines that the filter flags, with the entry: none should be."""
    return lines.join(first_offender(lines, entries, allow, mode), "line_id")


def self_test_passes(failures: DataFrame, most: int = 0) -> bool:
    return failures.limit(most + 1).count() <= most
