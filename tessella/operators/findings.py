"""From noisy probe logs to findings: votes, fragments, attribution and reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unwrap
from .match import containing


def vote(probes: DataFrame) -> DataFrame:
    """probes: text, result. word, n_blocked, n, verdict (sent, unconfirmed, blocked) and
    disputed ('2/3' where observations differ). Only single words, and only blocked and
    sent observations, count; a word blocked once and never seen again is unconfirmed."""
    word = F.lower(F.trim("text"))
    seen = probes.filter(F.col("result").isin("blocked", "sent")).select(word.alias("word"), "result").filter("word <> '' and instr(word, ' ') = 0")
    tally = seen.groupBy("word").agg(F.count_if(F.col("result") == "blocked").alias("n_blocked"), F.count("*").alias("n"))
    nb, n = F.col("n_blocked"), F.col("n")
    verdict = F.when(nb == 0, "sent").when((nb == 1) & (n == 1), "unconfirmed").when(nb * 2 > n, "blocked").otherwise("sent")
    mixed = (nb > 0) & (nb < n)
    return tally.select("word", "n_blocked", "n", verdict.alias("verdict"), F.when(mixed, F.concat_ws("/", nb, n)).alias("disputed"))


def untested(probes: DataFrame) -> DataFrame:
    """Words of which only mismatches were seen."""
    words = probes.select(F.lower(F.trim("text")).alias("word"), "result").filter("word <> '' and instr(word, ' ') = 0")
    tested = words.filter(F.col("result").isin("blocked", "sent"))
    return words.filter("result = 'mismatch'").select("word").distinct().join(tested, "word", "left_anti")


def lexicon_words(probes: DataFrame, phases: tuple[str, ...] = ("stage1", "phase2")) -> DataFrame:
    words = probes.filter(F.col("phase").isin(*phases)).select(F.lower(F.trim("text")).alias("word"))
    return words.filter("word <> '' and instr(word, ' ') = 0").distinct()


def fragments(votes: DataFrame, known: DataFrame) -> DataFrame:
    """Candidate fragments of blocked words: what a frame holds, words of three characters
    or fewer, and known terms (word)."""
    blocked = votes.filter("verdict = 'blocked'").select("word", unwrap(F.col("word")).alias("u"))
    framed = blocked.filter("u.wrapped").select(F.col("u.core").alias("fragment"))
    bare = blocked.filter("not u.wrapped").select("word")
    short = bare.filter(F.length("word") <= 3)
    listed = bare.join(known.select("word").distinct(), "word", "left_semi")
    return framed.unionByName(short.unionByName(listed).select(F.col("word").alias("fragment"))).distinct()


def minimal(parts: DataFrame) -> DataFrame:
    """Fragments that hold no other fragment."""
    inside = containing(parts.select(F.col("fragment").alias("word")), parts.select(F.col("fragment").alias("part")), strict=True)
    return parts.join(inside.select(F.col("word").alias("fragment")).distinct(), "fragment", "left_anti")


def stems(word: Column) -> Column:
    """Regular base forms that a word may be an inflection of."""
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    forms = (("ies", F.array(F.concat(cut(3), F.lit("y")))), ("es", F.array(cut(1), cut(2))), ("s", F.array(cut(1))), ("ed", F.array(cut(1), cut(2))), ("ing", F.array(cut(3), F.concat(cut(3), F.lit("e")))))
    none = F.array().cast("array<string>")
    return F.filter(F.concat(*(F.when(word.endswith(e), f).otherwise(none) for e, f in forms)), lambda s: F.length(s) >= 3)


def vocabulary(words: DataFrame, attested: DataFrame) -> DataFrame:
    """The words of three letters or more that are attested, or are inflections of attested ones."""
    each = words.filter(F.length("word") >= 3).select("word", F.explode(F.concat(F.array("word"), stems(F.col("word")))).alias("stem"))
    known = attested.select(F.lower("word").alias("stem")).distinct()
    return each.join(known, "stem", "left_semi").select("word").distinct()


def classify(votes: DataFrame, terms: DataFrame, known: DataFrame, attested: DataFrame) -> DataFrame:
    """word and kind: carrier, term (a confirmed fragment that no shorter one explains),
    listed (a known term), unattested, ordinary (blocked without being any of these),
    clean, or unconfirmed. terms: fragment; with no attested words all count as attested."""
    has = lambda df, c, name: df.select(F.col(c).alias("word")).distinct().withColumn(name, F.lit(True))
    rows = votes.withColumn("wrapped", unwrap(F.col("word"))["wrapped"]).join(has(terms, "fragment", "is_term"), "word", "left").join(has(known, "word", "is_listed"), "word", "left")
    rows = rows.join(has(vocabulary(votes, attested), "word", "is_word"), "word", "left")
    any_word = F.lit(not attested.isEmpty())
    blocked = F.col("verdict") == "blocked"
    kind = F.when(F.col("wrapped"), "carrier").when(blocked & F.col("is_term"), "term").when(blocked & F.col("is_listed"), "listed").when(blocked & any_word & F.col("is_word").isNull(), "unattested").when(blocked, "ordinary").when(F.col("verdict") == "sent", "clean").otherwise("unconfirmed")
    return rows.select("word", kind.alias("kind"))


def attribute(words: DataFrame, terms: DataFrame, least: int = 2) -> DataFrame:
    """word and rule: the shortest fragment (of `least` characters at least) strictly inside
    it, the first in order of equal ones; null where nothing explains it."""
    parts = terms.filter(F.length("fragment") >= least).select(F.col("fragment").alias("part"))
    inside = containing(words.select("word").distinct(), parts, strict=True)
    rule = inside.groupBy("word").agg(F.min_by("part", F.struct(F.length("part"), "part")).alias("rule"))
    return words.select("word").distinct().join(rule, "word", "left")


def reach(rules: DataFrame, dictionary: DataFrame, screened: DataFrame | None = None, low: int = 3, high: int = 20) -> DataFrame:
    """rule and word: dictionary words of low to high letters that hold the rule, itself
    included; words in screened are left out."""
    words = dictionary.select(F.lower(F.trim("word")).alias("word")).distinct().filter(F.length("word").between(low, high) & F.col("word").rlike(r"^\p{L}+$"))
    if screened is not None:
        words = words.join(screened.select("word").distinct(), "word", "left_anti")
    return containing(words, rules.select(F.col("rule").alias("part"))).select(F.col("part").alias("rule"), "word")


def reach_summary(reached: DataFrame, limit: int = 5) -> DataFrame:
    """One row: pairs, words (their union), under (words that a rule shorter than limit
    reaches), reached_only_by_long (the others), still_matched (words that hold a rule
    of limit or more, whatever else they hold)."""
    under = F.length("rule") < limit
    return reached.agg(F.count("*").alias("pairs"), F.countDistinct("word").alias("words"), F.countDistinct(F.when(under, F.col("word"))).alias("under"), F.countDistinct(F.when(~under, F.col("word"))).alias("still_matched")).withColumn("reached_only_by_long", F.col("words") - F.col("under"))


def reach_by_length(reached: DataFrame) -> DataFrame:
    """length of rule, rules, and distinct words that rules of it reach."""
    return reached.groupBy(F.length("rule").alias("length")).agg(F.countDistinct("rule").alias("rules"), F.countDistinct("word").alias("words"))


def first_rule(reached: DataFrame) -> DataFrame:
    """word and the shortest rule that reaches it, the first in order of equal ones."""
    return reached.groupBy("word").agg(F.min_by("rule", F.struct(F.length("rule"), "rule")).alias("rule"))


def top_and_others(reached: DataFrame, k: int = 5) -> DataFrame:
    """rule and words of the k rules with the widest reach, and 'others': the union of all
    reach less the sum of these, as the words of a rule overlap."""
    by_rule = reached.groupBy("rule").agg(F.countDistinct("word").alias("words"))
    top = by_rule.orderBy(F.desc("words"), "rule").limit(k)
    union = reached.agg(F.countDistinct("word").alias("words"))
    rest = union.crossJoin(top.agg(F.sum("words").alias("s"))).select(F.lit("others").alias("rule"), (F.col("words") - F.coalesce("s", F.lit(0))).alias("words"))
    return top.unionByName(rest)


def refusal_by_language(probes: DataFrame, votes: DataFrame, languages: DataFrame) -> DataFrame:
    """language, blocked, total, pct: by the first language (src_ord, then t) in which a word
    was probed. probes: text, tag, src_ord, t; languages: tag, language. Words blocked
    or sent count."""
    tagged = probes.join(languages, "tag").select(F.lower(F.trim("text")).alias("word"), "language", F.struct("src_ord", "t", "language").alias("at"))
    first = tagged.groupBy("word").agg(F.min_by("language", "at").alias("language"))
    rows = first.join(votes.filter(F.col("verdict").isin("blocked", "sent")), "word")
    out = rows.groupBy("language").agg(F.count_if(F.col("verdict") == "blocked").alias("blocked"), F.count("*").alias("total"))
    return out.withColumn("pct", F.round(F.col("blocked") * 100 / F.col("total"), 1))


def measured(attribution: DataFrame) -> DataFrame:
    return attribution.filter("rule is not null").groupBy("rule").agg(F.count("*").alias("words"))
