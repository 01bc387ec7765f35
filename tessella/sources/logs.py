"""Probe logs, observations, packs and batteries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lexicon import lines

PROBE = "text string, result string, tag string, t bigint, note string, phase string, modal array<string>, present boolean, penalty array<string>, shown string"
BATTERY = "id bigint, stratum string, probe string, expected string, note string, result string"


def read_probes(spark: SparkSession, *paths: str) -> DataFrame:
    """All shapes of probe record in one schema, malformed ones dropped, with src_ord (the
    place of the file in the call)."""
    parts = [spark.read.schema(PROBE + ", _bad string").json(p, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad").filter("_bad is null").drop("_bad").withColumn("src_ord", F.lit(i)) for i, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, parts)


def read_observations(spark: SparkSession, *paths: str) -> DataFrame:
    """text, blocked of JSON lines with comments."""
    got = lines(spark, *paths).select(F.from_json("value", "text string, blocked boolean").alias("r"))
    return got.filter("r.text is not null").select("r.text", F.coalesce("r.blocked", F.lit(False)).alias("blocked"))


def read_pack(spark: SparkSession, path: str) -> DataFrame:
    """msg_idx, payload and candidates of a pack: MAP lines and, in order, payload lines."""
    from pyspark.sql import Window

    rows = lines(spark, path)
    fields = F.split("value", "\t")
    maps = rows.filter(F.col("value").startswith("MAP\t")).select(F.get(fields, F.lit(1)).cast("long").alias("msg_idx"), F.slice(fields, 3, F.size(fields)).alias("candidates"))
    payload = rows.filter(~F.col("value").startswith("MAP\t")).select((F.row_number().over(Window.orderBy("line_ord")) - 1).cast("long").alias("msg_idx"), F.col("value").alias("payload"))
    return maps.join(payload, "msg_idx", "left")


def read_battery(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BATTERY).csv(path, header=True)
