"""Shadow comparison: a new filter beside the one in charge, in batches or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEDGER = "kind string, text string, surface string, locale string, incumbent_flagged boolean, guard_flagged boolean, guard_action string, guard_filtered string, rescued array<string>, ts double"


def kind(incumbent: Column, guard: Column) -> Column:
    """over_block_fixed if only the incumbent flags, new_catch if only the guard does."""
    return F.when(incumbent & ~guard, "over_block_fixed").when(guard & ~incumbent, "new_catch")


def compare(messages: DataFrame, verdicts: DataFrame, authority: str = "incumbent") -> DataFrame:
    """messages: msg_id, text, surface, locale, ts, incumbent_flagged, incumbent_text;
    verdicts of the guard. A message without a verdict, or with a null action, is a guard
    error: the incumbent decides and it isn't counted as a call. Adds agree, kind,
    guard_error, and output (the text as the authority leaves it)."""
    got = verdicts.select("msg_id", F.col("action").alias("guard_action"), F.col("filtered").alias("guard_filtered"), "rescued")
    rows = messages.join(got, "msg_id", "left")
    error = F.col("guard_action").isNull()
    flagged = F.col("guard_action") != "ALLOW"
    guard_text = F.col("guard_filtered") if authority == "guard" else F.col("incumbent_text")
    return rows.select("*", flagged.alias("guard_flagged"), error.alias("guard_error"), (flagged == F.col("incumbent_flagged")).alias("agree"), kind(F.col("incumbent_flagged"), flagged).alias("kind"), F.when(error, F.col("incumbent_text")).otherwise(guard_text).alias("output"))


def ledger(compared: DataFrame) -> DataFrame:
    """The disagreements, one row each."""
    return compared.filter("kind is not null").select("kind", "text", "surface", "locale", "incumbent_flagged", "guard_flagged", "guard_action", "guard_filtered", "rescued", F.col("ts").cast("double").alias("ts"))


def last(rows: DataFrame, size: int = 10_000) -> DataFrame:
    """The last `size` rows by ts; ties by text."""
    return rows.orderBy(F.desc("ts"), "text").limit(size)


def last_of_each(rows: DataFrame, key: str, size: int = 10_000) -> DataFrame:
    newest = Window.partitionBy(key).orderBy(F.desc("ts"), "text")
    return rows.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= size).drop("_n")


def report(compared: DataFrame) -> DataFrame:
    """One row: calls, agree, over_block_fixed, new_catch, guard_errors, agreement_pct."""
    n = F.count_if
    out = compared.agg(n(~F.col("guard_error")).alias("calls"), n(F.col("agree")).alias("agree"), n(F.col("kind") == "over_block_fixed").alias("over_block_fixed"), n(F.col("kind") == "new_catch").alias("new_catch"), n(F.col("guard_error")).alias("guard_errors"))
    return out.withColumn("agreement_pct", F.round(F.col("agree") * 100 / F.greatest("calls", F.lit(1)), 2))


def watch(stream: DataFrame, judge, ledger_path: str, checkpoint: str, authority: str = "incumbent", id_col: str | None = "msg_id", late: str = "1 hour", event_time: str | None = None):
    """Runs the comparison on a stream of messages and appends disagreements to a table.
    judge: a batch of messages to verdicts. With event_time, messages seen twice within
    the watermark count once. A batch that is run again replaces its own files, so a
    restart doubles nothing. Returns the query."""
    if event_time and id_col:
        stream = stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark([id_col])

    def one(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            found = ledger(compare(batch, judge(batch), authority))
            found.write.mode("overwrite").parquet(f"{ledger_path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
