"""Inferring hidden terms from what a filter blocks, and planning the next probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import substrings

# Fixed value: letters that padding is taken from.
FILLER = "qzjvx"


def candidates(observations: DataFrame, common: DataFrame | None = None, low: int = 2, high: int = 12) -> DataFrame:
    """text (blocked) and candidate: substrings of it that no clean text, and no common
    word, holds."""
    clean = observations.filter("not blocked").select("text")
    if common is not None:
        clean = clean.unionByName(common.select(F.col("word").alias("text")))
    part = lambda df: df.select("text", F.explode(substrings(F.col("text"), low, high)).alias("candidate"))
    ruled_out = part(clean.distinct()).select("candidate").distinct()
    return part(observations.filter("blocked").select("text").distinct()).join(ruled_out, "candidate", "left_anti").select("text", "candidate")


def unexplained(observations: DataFrame, found: DataFrame) -> DataFrame:
    """Blocked texts without a candidate: blocking isn't by substring there."""
    return observations.filter("blocked").select("text").distinct().join(found, "text", "left_anti")


def explanation(found: DataFrame) -> list[str]:
    """Greedy hitting set: again and again the candidate that covers the most blocked texts
    not yet covered, the shorter and then the first in order of equal ones. Each round
    is one aggregation; what it leaves is written down, so lineage stays short."""
    chosen: list[str] = []
    left = found.persist()
    while True:
        best = left.groupBy("candidate").agg(F.countDistinct("text").alias("n")).orderBy(F.desc("n"), F.length("candidate"), "candidate").limit(1).collect()
        if not best:
            return chosen
        chosen.append(best[0].candidate)
        covered = found.filter(F.col("candidate").isin(chosen)).select("text").distinct()
        left = found.join(covered, "text", "left_anti")


def covers(found: DataFrame, chosen: list[str]) -> DataFrame:
    """candidate and the texts that it covers, for those chosen."""
    return found.filter(F.col("candidate").isin(chosen)).groupBy("candidate").agg(F.array_sort(F.collect_set("text")).alias("texts"))


def report(found: DataFrame, shown: int = 12) -> DataFrame:
    """text, n candidates and the shortest of them."""
    by_length = F.array_sort(F.collect_set(F.struct(F.length("candidate").alias("n"), F.col("candidate").alias("c"))))
    return found.groupBy("text").agg(F.countDistinct("candidate").alias("n"), F.transform(F.slice(by_length, 1, shown), lambda x: x["c"]).alias("shortest"))


def design(found: DataFrame, budget: int = 12, carrier: tuple[str, str] = ("qz", "jv")) -> DataFrame:
    """The next probes: candidate, n and probe (the candidate in a frame), the most frequent
    first, then the shorter, then in order."""
    ranked = found.groupBy("candidate").agg(F.countDistinct("text").alias("n")).orderBy(F.desc("n"), F.length("candidate"), "candidate").limit(budget)
    return ranked.withColumn("probe", F.concat(F.lit(carrier[0]), "candidate", F.lit(carrier[1])))


def pack_probes(words: DataFrame, longest: int = 80, pad: int = 2) -> DataFrame:
    """words: ord, word. msg_idx, payload, candidates: next-fit packing in order, each
    candidate between filler letters, messages of at most `longest` characters where a
    candidate lets them. A probe plan is short by nature; its order makes it one group."""
    token = F.concat(F.lit(FILLER[:pad]), F.col("word"), F.lit(FILLER[pad : 2 * pad]))
    first = words.groupBy(F.lower("word").alias("word")).agg(F.min("ord").alias("ord"))
    rows = first.select("ord", "word", token.alias("token"))
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("ord", "word", "token"))).alias("xs"))
    start = F.expr("named_struct('msg', -1, 'size', 0, 'out', cast(array() as array<int>))")

    def step(acc, x):
        size = F.length(x["token"]) + 1
        opens = (acc["msg"] < 0) | ((acc["size"] > 0) & (acc["size"] + size > longest))
        msg = F.when(opens, acc["msg"] + 1).otherwise(acc["msg"])
        return F.struct(msg.alias("msg"), F.when(opens, size).otherwise(acc["size"] + size).alias("size"), F.concat(acc["out"], F.array(msg)).alias("out"))

    placed = listed.select(F.explode(F.arrays_zip("xs", F.aggregate("xs", start, step, lambda acc: acc["out"]).alias("msg"))).alias("z")).select("z.msg", "z.xs.*")
    ordered = F.array_sort(F.collect_list(F.struct("ord", "word", "token")))
    return placed.groupBy(F.col("msg").cast("long").alias("msg_idx")).agg(ordered.alias("xs")).select("msg_idx", F.array_join(F.transform("xs", lambda x: x["token"]), " ").alias("payload"), F.transform("xs", lambda x: x["word"]).alias("candidates"))


def read_replies(packs: DataFrame, replies: DataFrame) -> DataFrame:
    """packs: msg_idx, payload, candidates; replies: msg_idx, reply. candidate and outcome:
    refused, fired or clean. Words are paired by place; if their number changed, all of a
    message's candidates share what happened to it."""
    rows = packs.join(replies, "msg_idx", "left").withColumn("reply", F.coalesce("reply", F.lit("")))
    sent, back = F.split("payload", " "), F.split("reply", " ")
    whole = F.when(F.col("reply") != F.col("payload"), "fired").otherwise("clean")
    each = F.transform("candidates", lambda c, i: F.struct(c.alias("candidate"), F.when(F.upper(F.trim("reply")) == "REFUSED", "refused").when(F.size(sent) != F.size(back), whole).when(F.get(sent, i) != F.get(back, i), "fired").otherwise("clean").alias("outcome")))
    return rows.select(F.explode(each).alias("x")).select("x.*")


def to_observations(outcomes: DataFrame) -> DataFrame:
    """Outcomes as observations for candidates()."""
    return outcomes.filter("outcome <> 'refused'").select(F.col("candidate").alias("text"), (F.col("outcome") == "fired").alias("blocked")).distinct()


def stratified_sample(words: DataFrame, sizes: dict[str, int], seed: int = 7) -> DataFrame:
    """words: stratum, word. Up to sizes[stratum] words of each, in the order of a hash of
    seed and word; the same at every run."""
    order = Window.partitionBy("stratum").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "word")), "word")
    size = F.lit(0)
    for stratum, n in sizes.items():
        size = F.when(F.col("stratum") == stratum, F.lit(n)).otherwise(size)
    return words.distinct().withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= size)


def waiting(queue: DataFrame, log: DataFrame) -> DataFrame:
    """Queue rows whose text isn't in the log."""
    return queue.join(log.select("text").distinct(), "text", "left_anti")
