"""Operator 3: links and components against brute force, in one shard and in many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm.embed_dedup import audit_recall, distinct_vectors, embedding_dedup, near_links

SCHEMA = "vec_id bigint, embedding array<float>, label int, rep string"


def test_embedding_dedup(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16))
    knot = x[0] + 0.05 * rng.normal(size=(120, 16))
    near = x[1:60] + 0.05 * rng.normal(size=(59, 16))
    every = np.concatenate([x, knot, near, x[:5], 3 * x[5:8]]).astype(np.float32)
    label = [int(i % 2) for i in range(600)] + [0] * 120 + [int(i % 2) for i in range(1, 60)] + [i % 2 for i in range(8)]
    rows = [(i, v.tolist(), label[i], "x") for i, v in enumerate(every)]
    odd = [(9000, None, 0, None), (9001, [0.0] * 16, 0, None), (9002, [float("nan")] * 16, 1, None), (9003, every[0].tolist(), None, None), (9004, [None] * 16, 0, None), (None, every[1].tolist(), 1, None)]
    vectors = spark.createDataFrame(rows + odd, SCHEMA)
    got = embedding_dedup(vectors)
    by = {r.vec_id: r for r in got.collect()}
    u = every.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    same = np.array(label)[:, None] == np.array(label)[None]
    links = ((u @ u.T >= 0.93) & same).sum(1) - 1
    links[1] += 1  # the row without an id equals row 1, and what is near that
    found = sum(min(by[i].n_links, n) for i, n in enumerate(links))
    assert found >= 0.95 * links.sum()
    assert all(by[i].n_links == 0 and by[i].component_id == i for i in (9000, 9001, 9002, 9003, 9004))
    assert by[0].kept and by[0].component_id == 0
    assert by[0].recall >= 0.9
    assert embedding_dedup(vectors.limit(0)).count() == 0


def brute(x: np.ndarray):
    """Links of each row, and the smallest row that links lead to."""
    near = x @ x.T >= 0.93
    low = np.arange(len(x))
    while True:
        new = np.where(near, low[None], len(x)).min(1)
        if (new == low).all():
            return near.sum(1) - 1, low
        low = new


@pytest.mark.parametrize("dim", [4, 6])
def test_many_shards(spark, dim):
    """Spread-out vectors, where links cross the borders of shards everywhere."""
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(1500, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    links, low = brute(x)
    got = sorted(embedding_dedup(vectors, limit=64).collect(), key=lambda r: r.vec_id)
    assert sum(r.n_links for r in got) >= 0.99 * links.sum() and all(r.n_links <= n for r, n in zip(got, links))
    assert [r.component_id for r in got] == low.tolist()
    assert got[0].recall >= 0.99


def test_exact_tiles_and_audit(spark):
    """What is done when the audit finds too little, and that it does find it."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    rows = distinct_vectors(vectors, "vec_id", "embedding", "label")
    reps = rows.select("rep", F.xxhash64("label").alias("label"), "v", F.lit(1).cast("long").alias("copies"))
    found = near_links(reps, 0.93, 64, exact=True).filter("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("near"))
    links, _ = brute(x)
    by = {r.vec_id: r.near or 0 for r in rows.join(found, "rep", "left").collect()}
    assert [by[i] for i in range(300)] == links.tolist()
    assert audit_recall(reps, found, rows, 0.93) == 1.0
    assert audit_recall(reps, found.withColumn("near", F.lit(0).cast("long")), rows, 0.93) == 0.0
