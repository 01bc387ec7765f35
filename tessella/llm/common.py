"""Helpers that the training-data operators share."""

from __future__ import annotations

import pickle
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import zstandard
except ImportError:  # a cluster without the wheel still works, with larger blobs
    zstandard = None
import zlib


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session that runs in one
    process, as in tests, may leave it unset; it then gets a folder of its own."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get().rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, a lost
    executor loses nothing, and the optimizer knows the size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shipped(spark: SparkSession, obj):
    """A broadcast of an object whose classes executors needn't have: what it gives there
    is what received() makes of it."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(obj))


def received(broadcast):
    return pickle.loads(broadcast.value)


def sliced(batches, rows: int = 512):
    """The same rows in batches of at most `rows`, so that Python copies of a batch's
    texts stay small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _rotl(x: int, r: int) -> int:
    return ((x << r) | (x >> (32 - r))) & 0xFFFFFFFF


def _spark_hash_long(v: int) -> int:
    """Spark's hash() of a bigint (Murmur3, x86 32 bit, seed 42)."""
    h = 42
    for word in (v & 0xFFFFFFFF, (v >> 32) & 0xFFFFFFFF):
        k = word * 0xCC9E2D51 & 0xFFFFFFFF
        h ^= _rotl(k, 15) * 0x1B873593 & 0xFFFFFFFF
        h = (_rotl(h, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
    h ^= 8
    for shift, mul in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> shift)) * mul & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >= 1 << 31 else h


def part_labels(n: int) -> list[int]:
    """n bigints of which repartition(n, label) sends each to a partition of its own."""
    found: dict[int, int] = {}
    v = 0
    while len(found) < n:
        found.setdefault(_spark_hash_long(v) % n, v)
        v += 1
    return [found[i] for i in range(n)]


def squeeze(raw: bytes) -> bytes:
    if zstandard is None:
        return b"z" + zlib.compress(raw, 1)
    return b"s" + zstandard.ZstdCompressor(level=1).compress(raw)


def unsqueeze(raw: bytes) -> bytes:
    if raw[:1] == b"z":
        return zlib.decompress(raw[1:])
    return zstandard.ZstdDecompressor().decompress(raw[1:])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list by alternating large-star and
    small-star steps, each a pair of shuffles on a node; rounds grow with the
    logarithm of the longest path. Edges with a null end are left out; loops and
    repeated edges change nothing. Returns node, component (its smallest node) for
    every node that has an edge to another one; empty for no edges."""
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    e = materialize(
        e.filter("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = materialize(small.filter("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        state = now
