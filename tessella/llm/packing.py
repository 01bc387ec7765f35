"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are dealt by hash to shards of about `shard_rows` rows, and each shard is
packed by itself, longest first. Repeated rows are counted before they travel and go
to the shards in lots of at most `LOT`, so a row that is a third of the table fills no
shard alone. Open bins are kept in order of their residual
space. A bin carries bitmaps: one of the duplicate clusters in it, and one of its
sources, with `per_source` bits each. The search starts at the smallest residual
that fits and goes on to the next larger until a bin has neither the document's
cluster nor all bits of its source; that is the tightest compatible bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Repeated rows that go to a shard together.
LOT = 64
OUT = "doc_id {}, source string, cluster bigint, shard bigint, bin bigint, piece bigint, start bigint, at bigint, n_tokens bigint"


def best_fit(items: list[tuple], capacity: int, per_source: int) -> list[tuple[int, int, int, int, int]]:
    """items: (length, source, cluster) in the order to place them. Returns (item, bin,
    piece, start in the document, place in the bin). Longer items fill bins of their
    own but for the last piece. An empty item takes no space, and a bin."""
    source_bit: dict = {}
    cluster_bit: dict = {}
    residuals: list[tuple[int, int]] = []
    sources: list[int] = []
    clusters: list[int] = []
    used: list[int] = []
    out = []
    for i, (size, source, cluster) in enumerate(items):
        plane = source_bit.setdefault(source, len(source_bit)) * per_source
        mask = ((1 << per_source) - 1) << plane
        same = 1 << cluster_bit.setdefault(cluster, len(cluster_bit)) if cluster is not None else 0
        piece = start = 0
        while size - start > capacity:
            out.append((i, len(used), piece, start, 0))
            used.append(capacity)
            sources.append(0)
            clusters.append(0)
            piece, start = piece + 1, start + capacity
        rest = size - start
        at = bisect_left(residuals, (rest, -1))
        while at < len(residuals):
            b = residuals[at][1]
            if not clusters[b] & same and sources[b] & mask != mask:
                break
            at += 1
        if at < len(residuals):
            del residuals[at]
        else:
            b = len(used)
            used.append(0)
            sources.append(0)
            clusters.append(0)
        out.append((i, b, piece, start, used[b]))
        used[b] += rest
        taken = (sources[b] & mask) >> plane
        sources[b] |= ((taken << 1) | 1) << plane
        clusters[b] |= same
        insort(residuals, (capacity - used[b], b))
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, length_col: str | None = None, capacity: int = 2048, per_source: int = 2, shard_rows: int = 8192) -> DataFrame:
    """One row per piece of a document: doc_id, source, cluster, shard, bin (unique over
    all shards), piece, start (first token in the document), at (place in the bin) and
    n_tokens. Tokens are words split at ASCII white space unless length_col gives the
    lengths; clusters are equal texts unless cluster_col names them. A bin never holds
    two documents of a cluster, nor more than per_source of a source, nor more than
    capacity tokens. Null and empty texts have no tokens and no cluster, and still get
    a row; null sources are one source. Ties are placed in order of id and text hash;
    repeated rows are of one cluster. No rows for no documents; other columns are left
    out."""
    text = F.col(text_col)
    length = F.col(length_col).cast("long") if length_col else F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    cluster = F.col(cluster_col).cast("long") if cluster_col else F.when(F.length(text) > 0, F.xxhash64(text))
    shards = max(1, round(docs.count() / shard_rows))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"), F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("long").alias("n"), F.xxhash64(text).alias("h"))
    lots = rows.groupBy("doc_id", "source", "cluster", "n", "h").agg(F.count("*").alias("copies")).withColumn("lot", F.explode(F.sequence(F.lit(0), ((F.col("copies") - 1) / LOT).cast("int"))))
    lots = lots.withColumn("copies", F.least(F.col("copies") - F.col("lot") * LOT, F.lit(LOT))).withColumn("shard", F.pmod(F.xxhash64("doc_id", "h", "lot", F.lit(9)), F.lit(shards)))

    def pack(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.repeat(np.arange(t.num_rows), t.column("copies").to_numpy())))
        t = t.sort_by([("n", "descending"), ("doc_id", "ascending"), ("h", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
        placed = best_fit(list(zip(*(t.column(c).to_pylist() for c in ("n", "source", "cluster")))), capacity, per_source)
        item, b, piece, start, at = (pa.array(x, pa.int64()) for x in zip(*placed))
        t = t.take(item)
        size = [min(capacity, n - s) for n, s in zip(t.column("n").to_pylist(), start.to_pylist())]
        shard = t.column("shard")
        bins = [s * (1 << 32) + x for s, x in zip(shard.to_pylist(), b.to_pylist())]
        return pa.table([t.column("doc_id"), t.column("source"), t.column("cluster"), shard, pa.array(bins, pa.int64()), piece, start, at, pa.array(size, pa.int64())], names=["doc_id", "source", "cluster", "shard", "bin", "piece", "start", "at", "n_tokens"])

    return lots.groupBy("shard").applyInArrow(pack, OUT.format(kind))
