"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors count as one when they are equal (and of one label). A label's vectors are
split by k-means, level by level, until every shard is small; a vector also goes to
every centroid whose border with its nearest is at most half a link away, so shards
overlap and of any link both ends share one. In each shard a flat graph is built: every node searches its neighbours greedily from the medoid,
and robust pruning keeps those that no kept neighbour is much closer to. The
adjacency lists of all shards are united. Then every vector is a query, in each
shard that it is in: a greedy search from the medoid, which, once it is in range,
expands every node in range. A knot of vectors so dense that its centroids fall
together can't be split by place; larger ones are compared exactly, in tiles of
bounded size. Pairs are verified in double precision and counted in one of the shards
that both are in, so no task returns more than a count and a link or two for each of
its vectors. The recall is audited against brute force over a stated set of queries;
if it is too low, everything is compared exactly.

Where vectors fill so many dimensions that borders this wide would put most of them in
most shards, narrower ones are taken: one and a half standard deviations of a link of
random direction. Only there links can be lost, and the audit shows it. A cell that
even these can't split is compared exactly unless it is very large.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, materialize

SHARD = 2048
CHILDREN = 8
SAMPLE = 512
#: Cells of so many shards' size are compared exactly if they can't be split.
EXACT = 64
#: A split must leave at most this share in one child, and put a vector in so many at most.
SHARE, SPREAD = 0.7, 2.2
#: Queries that the audit takes at most, and the recall below which all is compared.
AUDIT, ENOUGH = 4096, 0.9
#: Centroids nearer than this are one: no link of dense vectors is cut.
KNOT = 0.6
DEGREE = 16
BEAM = 32
ALPHA = 1.2


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = np.stack([x[near == i].mean(0) if (near == i).any() else x[rng.integers(len(x))] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def apart(c: np.ndarray) -> np.ndarray:
    """Without the centroids that are near an earlier one."""
    kept: list[int] = []
    for i in range(len(c)):
        if all(np.linalg.norm(c[i] - c[j]) >= KNOT for j in kept):
            kept.append(i)
    return c[kept]


def members(x: np.ndarray, c: np.ndarray, margin: float) -> np.ndarray:
    """(vectors, centroids): whether the border between the vector's nearest centroid and
    this one is at most `margin` from the vector."""
    s = x @ c.T
    near = s.argmax(1)
    between = np.linalg.norm(c[:, None] - c[None], axis=2)[near]
    return s.max(1)[:, None] - s <= margin * between + 1e-9


def border(x: np.ndarray, c: np.ndarray, least: float, small: bool) -> float:
    """The margin for a cell, judged by its sample: half a link's length, so that one end of
    any link across a border is in both shards, or less where that doesn't split the
    cell; -1 for a cell to be compared exactly."""
    if len(c) == 1:
        return -1.0
    link = np.sqrt(2 - 2 * least)
    wide, narrow = 0.5 * link, min(0.5, 0.75 / np.sqrt(x.shape[1])) * link
    m = members(x, c, wide)
    if m.sum(1).mean() <= SPREAD and m.mean(0).max() <= SHARE:
        return float(wide)
    return -1.0 if small and members(x, c, narrow).mean(0).max() > SHARE else float(narrow)


def prune(x: np.ndarray, node: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of many nodes at once. cand: (n, c) indexes, -1 for none, no repeats.
    A kept neighbour drops the candidates that are alpha times closer to it than to
    the node (in squared distance)."""
    n, c = cand.shape
    safe = np.maximum(cand, 0)
    v = x[safe]
    d = np.where(cand < 0, np.inf, 1 - np.einsum("ncd,nd->nc", v, x[node]))
    out = np.full((n, degree), -1, np.int64)
    rows = np.arange(n)
    for k in range(degree):
        best = d.argmin(1)
        ok = np.isfinite(d[rows, best])
        if not ok.any():
            break
        out[ok, k] = cand[rows[ok], best[ok]]
        to_best = 1 - np.einsum("ncd,nd->nc", v, v[rows, best])
        gone = alpha * to_best <= d
        gone[rows, best] = True
        d[gone & ok[:, None]] = np.inf
    return out


def beam_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, start: int, beam: int) -> np.ndarray:
    """The `beam` nearest nodes that a greedy search finds for each query node, itself
    left out: (q, beam) indexes, -1 for none."""
    q = len(queries)
    ids = np.full((q, beam), -1, np.int64)
    dist = np.full((q, beam), np.inf, np.float32)
    done = np.ones((q, beam), bool)
    ids[:, 0], dist[:, 0], done[:, 0] = start, 1 - x[queries] @ x[start], False
    rows = np.arange(q)
    seen = np.zeros((q, len(x)), bool)
    seen[:, start] = True
    while True:
        open_ = np.where(done, np.inf, dist)
        best = open_.argmin(1)
        live = np.isfinite(open_[rows, best])
        if not live.any():
            break
        r = rows[live]
        at = ids[r, best[live]]
        done[r, best[live]] = True
        near = graph[at]
        fresh = (near >= 0) & ~seen[r[:, None], np.maximum(near, 0)]
        seen[np.broadcast_to(r[:, None], near.shape)[fresh], near[fresh]] = True
        d = np.where(fresh, 1 - np.einsum("nkd,nd->nk", x[np.maximum(near, 0)], x[queries[r]]), np.inf).astype(np.float32)
        all_d = np.concatenate([dist[r], d], 1)
        pick = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        take = lambda a, b: np.take_along_axis(np.concatenate([a, b], 1), pick, 1)  # noqa: B023, E731
        dist[r], ids[r], done[r] = take(dist[r], d), take(ids[r], np.where(fresh, near, -1)), take(done[r], ~fresh)
    ids[ids == queries[:, None]] = -1
    return ids


def unique_rows(cand: np.ndarray) -> np.ndarray:
    cand = np.sort(cand, 1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    return cand


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 11) -> np.ndarray:
    """The graph of a shard: (n, degree) neighbours, -1 for none."""
    n = len(x)
    every = np.arange(n)
    if n <= degree + 1:
        graph = np.full((n, degree), -1, np.int64)
        for i in range(n):
            others = np.delete(every, i)
            graph[i, : len(others)] = others
        return graph
    rng = np.random.default_rng(seed)
    graph = rng.integers(0, n, (n, degree))
    graph[graph == every[:, None]] = -1
    graph = unique_rows(graph)
    start = medoid(x)
    for a in (1.0, alpha):
        found = np.concatenate([beam_search(x, graph, every[i : i + 512], start, beam) for i in range(0, n, 512)])
        cand = unique_rows(np.concatenate([found, graph], 1))
        graph = prune(x, every, cand, degree, a)
        # Edges back: each node's own list and those that point to it, pruned again.
        src, col = np.nonzero(graph >= 0)
        dst = graph[src, col]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        turn = np.arange(len(dst)) - np.searchsorted(dst, dst)
        back = np.full((n, 4 * degree), -1, np.int64)
        ok = turn < 4 * degree
        back[dst[ok], turn[ok]] = src[ok]
        graph = prune(x, every, unique_rows(np.concatenate([graph, back], 1)), degree, a)
        if not (graph[start] >= 0).any():
            graph[start] = rng.integers(0, n, degree)
    return graph


def range_search(x: np.ndarray, graph: np.ndarray, least: float, beam: int = BEAM):
    """Pairs of nodes with cosine of at least `least` that the graph leads to: a greedy
    search for each node, then every node in range is expanded until none is new."""
    n = len(x)
    start = medoid(x)
    for lo in range(0, n, 512):
        queries = np.arange(lo, min(n, lo + 512))
        near = beam_search(x, graph, queries, start, beam)
        seen = np.zeros((len(queries), n), bool)
        seen[np.arange(len(queries)), queries] = True

        def new(q: np.ndarray, node: np.ndarray):
            """Those in range among the pairs not seen before."""
            key = np.unique(q * n + node)
            q, node = key // n, key % n
            keep = ~seen[q, node]  # noqa: B023
            q, node = q[keep], node[keep]
            seen[q, node] = True  # noqa: B023
            good = np.einsum("nd,nd->n", x[queries[q]], x[node]) >= least  # noqa: B023
            return q[good], node[good]

        q, col = np.nonzero(near >= 0)
        node = near[q, col]
        # A query is a node too: its own neighbours are a way in that the beam can't miss.
        own_q, own_col = np.nonzero(graph[queries] >= 0)
        q, node = new(np.concatenate([q, own_q]), np.concatenate([node, graph[queries][own_q, own_col]]))
        step = max(1, (1 << 20) // graph.shape[1])
        while len(q):
            yield queries[q], node
            found = []
            for i in range(0, len(q), step):
                out = graph[node[i : i + step]]
                ok = out >= 0
                found.append(new(np.broadcast_to(q[i : i + step, None], out.shape)[ok], out[ok]))
            q, node = (np.concatenate(c) for c in zip(*found))


def vectors_of(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def shards(reps: DataFrame, least: float, limit: int) -> DataFrame:
    """reps: rep, label, v (unit vectors), copies. Returns shard, size and the rest; a rep is
    in one shard or in several that overlap. None is larger than `limit` but knots.
    Each level fits a few centroids on a bounded sample of every cell that is too
    large."""
    cells = reps.select(F.xxhash64("label").alias("cell"), F.lit(False).alias("knot"), "rep", "label", "copies", "v")
    done = None
    level = 0
    while True:
        cells = materialize(cells)
        size = materialize(cells.groupBy("cell", "knot").agg(F.count("*").alias("size")))
        big = size.filter((F.col("size") > limit) & ~F.col("knot")).select("cell", "size")
        last = level == 24 or big.isEmpty()
        ready = cells if last else cells.join(big, "cell", "left_anti")
        ready = ready.join(size.select("cell", "size"), "cell")
        done = ready if done is None else done.unionByName(ready)
        if last:
            return done.withColumnRenamed("cell", "shard").drop("knot")
        level += 1
        seed = level

        def centroids(t: pa.Table) -> pa.Table:
            x = vectors_of(t.column("v"))
            k = min(CHILDREN, max(2, -(-3 * t.column("size")[0].as_py() // limit)))
            c = apart(kmeans(x, k, seed=seed))  # noqa: B023
            margin = border(x, c, least, t.column("size")[0].as_py() <= EXACT * limit)
            return pa.table([pa.array([t.column("cell")[0].as_py()]), pa.array([c.ravel().tolist()], pa.list_(pa.float64())), pa.array([margin])], names=["cell", "centroids", "margin"])

        mixed = cells.join(big, "cell")
        order = F.xxhash64("rep", F.lit(level))
        sample = mixed.filter(F.pmod(order, F.lit(1 << 30)) < F.lit(1 << 30) * F.lit(2.0 * SAMPLE) / F.col("size")).withColumn("turn", F.row_number().over(Window.partitionBy("cell").orderBy(order, "rep"))).filter(F.col("turn") <= SAMPLE)
        found = materialize(sample.select("cell", "size", "v").groupBy("cell").applyInArrow(centroids, "cell bigint, centroids array<double>, margin double"))

        def assign(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                cell = np.array(batch.column("cell").to_pylist(), np.int64)
                x = vectors_of(batch.column("v"))
                child, row, knot = [], [], []
                cents, margins = batch.column("centroids"), batch.column("margin")
                for value in np.unique(cell):
                    at = np.flatnonzero(cell == value)
                    margin = margins[int(at[0])].as_py()
                    if margin < 0:
                        mine, to = np.arange(len(at)), np.zeros(len(at), np.int64)
                    else:
                        mine, to = np.nonzero(members(x[at], np.array(cents[int(at[0])].as_py()).reshape(-1, x.shape[1]), margin))
                    row.append(at[mine])
                    child.append(to)
                    knot.append(np.full(len(mine), margin < 0))
                row, child, knot = (np.concatenate(y) for y in (row, child, knot))
                names = ["cell", "child", "knot", "rep", "label", "copies", "v"]
                yield pa.RecordBatch.from_arrays([batch.column("cell").take(pa.array(row)), pa.array(child, pa.int64()), pa.array(knot), *(batch.column(y).take(pa.array(row)) for y in names[3:])], names=names)

        kind = reps.schema["label"].dataType.simpleString()
        split = cells.join(found, "cell").mapInArrow(assign, f"cell bigint, child bigint, knot boolean, rep bigint, label {kind}, copies bigint, v array<double>")
        cells = split.select(F.xxhash64("cell", "child", F.lit(level)).alias("cell"), "knot", "rep", "label", "copies", "v")


FOUND = "kind int, a bigint, b bigint"


def owned(shard: int, lists: list, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of places, whether this shard is the smallest that both are in."""
    other = np.array([len(x) > 1 for x in lists])
    ok = np.ones(len(a), bool)
    for i in np.flatnonzero(other[a] & other[b]).tolist():
        ok[i] = min(set(lists[a[i]]) & set(lists[b[i]])) == shard
    return ok


def told(rep: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray, mine: np.ndarray) -> pa.Table:
    """(kind 0) rep and copies linked to it, over the pairs counted here; (kind 1) links
    that connect what all pairs connect."""
    near = np.bincount(a[mine], copies[b[mine]], len(rep)) + np.bincount(b[mine], copies[a[mine]], len(rep))
    at = np.flatnonzero(near)
    # Smallest place reachable, by rounds of taking the smaller of both ends.
    low = np.arange(len(rep))
    while len(a):
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    tail = np.flatnonzero(low != np.arange(len(rep)))
    kind = np.concatenate([np.zeros(len(at), np.int32), np.ones(len(tail), np.int32)])
    return pa.table([pa.array(kind), pa.array(np.concatenate([rep[at], rep[tail]])), pa.array(np.concatenate([near[at].astype(np.int64), rep[low[tail]]]))], names=["kind", "a", "b"])


def near_links(reps: DataFrame, least: float, limit: int = SHARD, exact: bool = False) -> DataFrame:
    """reps: rep, label, v, copies. Rows kind, a, b; kind 0: b rows equal to reps that a is
    linked to, to be summed; kind 1: links between reps that connect all that are. With
    exact, labels of more than `limit` aren't split but compared in tiles. No rows for
    no reps; equal reps are one."""
    if exact:
        size = reps.groupBy("label").agg(F.count("*").alias("size"))
        placed = materialize(reps.join(size, "label").withColumn("shard", F.xxhash64("label")))
    else:
        placed = materialize(shards(reps, least, limit))
    whole = materialize(placed.groupBy("rep").agg(F.array_sort(F.collect_set("shard")).alias("shards")))

    def edges(t: pa.Table) -> pa.Table:
        rep = np.array(t.column("rep").to_pylist(), np.int64)
        graph = build(vectors_of(t.column("v")).astype(np.float32))
        src, col = np.nonzero(graph >= 0)
        dst = graph[src, col]
        # Both ways: a node that hubs have pruned away can still be reached from its own neighbours.
        return pa.table([pa.array(np.concatenate([rep[src], rep[dst]])), pa.array(np.concatenate([rep[dst], rep[src]]))], names=["rep", "near"])

    flat = placed.filter(F.col("size") <= limit)
    united = materialize(flat.groupBy("shard").applyInArrow(edges, "rep bigint, near bigint").groupBy("rep").agg(F.collect_set("near").alias("near")))

    def search(t: pa.Table) -> pa.Table:
        rep = np.array(t.column("rep").to_pylist(), np.int64)
        copies = np.array(t.column("copies").to_pylist(), np.int64)
        exact = vectors_of(t.column("v"))
        x = exact.astype(np.float32)
        order = np.argsort(rep)
        lists = t.column("near").to_pylist()
        width = max((len(n) for n in lists if n), default=1)
        graph = np.full((len(rep), width), -1, np.int64)
        for i, near in enumerate(lists):
            near = np.array(near or [], np.int64)
            at = np.minimum(np.searchsorted(rep[order], near), len(rep) - 1)
            at = order[at][rep[order][at] == near]  # neighbours in other shards are searched there
            graph[i, : len(at)] = at
        keys = [np.zeros(0, np.int64)]
        for q, node in range_search(x, graph, least - 1e-4):
            ok = np.einsum("nd,nd->n", exact[q], exact[node]) >= least
            q, node = q[ok], node[ok]
            keys.append(np.unique(np.minimum(q, node) * len(rep) + np.maximum(q, node)))
        key = np.unique(np.concatenate(keys))
        a, b = key // len(rep), key % len(rep)
        return told(rep, copies, a, b, owned(t.column("shard")[0].as_py(), t.column("shards").to_pylist(), a, b))

    found = flat.join(united, "rep", "left").join(whole, "rep").groupBy("shard").applyInArrow(search, FOUND)

    def compare(t: pa.Table) -> pa.Table:
        rep = np.array(t.column("rep").to_pylist(), np.int64)
        copies = np.array(t.column("copies").to_pylist(), np.int64)
        side = np.array(t.column("block").to_pylist(), np.int64)
        x = vectors_of(t.column("v"))
        lists = t.column("shards").to_pylist()
        left = np.flatnonzero(side == side.min())
        right = np.flatnonzero(side == side.max())
        alone = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        if not alone and side.min() == side.max():
            left, right = left[:0], right[:0]
        i, j = np.nonzero(x[left] @ x[right].T >= least)
        a, b = left[i], right[j]
        if alone:
            a, b = a[a < b], b[a < b]
        return told(rep, copies, a, b, owned(t.column("shard")[0].as_py(), lists, a, b))

    # Knots: rows dealt to blocks, and every pair of blocks compared as a tile.
    block = placed.filter(F.col("size") > limit).join(whole, "rep").withColumn("blocks", F.ceil(F.col("size") / limit)).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    tiled = block.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return found.unionByName(tiled.select("shard", "i", "j", "block", "rep", "copies", "shards", "v").groupBy("shard", "i", "j").applyInArrow(compare, FOUND))


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, v (unit vector, double; null for a vector that can't be linked) and
    rep, a hash of label and vector that equal vectors share."""
    raw = F.col(vector_col).cast("array<double>")
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    sound = F.col(label_col).isNotNull() & raw.isNotNull() & ~F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (norm > 0) & (norm < float("inf"))
    v = F.when(F.coalesce(sound, F.lit(False)), F.transform(raw, lambda x: x / norm))
    return vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), v.alias("v")).withColumn("rep", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")))


def audit_recall(reps: DataFrame, degree: DataFrame, queries: DataFrame, least: float, most: int = AUDIT) -> float:
    """Share of the links of the queries (rep) that degree (rep, near) counts; 1 if they have
    none. reps: rep, label, v, copies. The queries, `most` at most, those of the smallest
    hash, are broadcast, and every rep is compared with those of its label."""
    picked = reps.join(queries.select("rep").distinct(), "rep", "left_semi").join(degree, "rep", "left")
    asked = picked.orderBy(F.xxhash64("rep", F.lit(17)), "rep").limit(most).select("rep", "label", "v", F.coalesce("near", F.lit(0)).alias("near")).toArrow()
    if not asked.num_rows:
        return 1.0
    rep, label = (np.array(asked.column(c).to_pylist(), np.int64) for c in ("rep", "label"))
    size = np.array([len(v) for v in asked.column("v").to_pylist()])
    of = {int(x): (rep[label == x], vectors_of(asked.column("v").filter(pa.array(label == x)))) for x in np.unique(label)}
    assert all(len(np.unique(size[label == x])) == 1 for x in of)
    sent = reps.sparkSession.sparkContext.broadcast(of)

    def count(batches):
        total: dict[int, int] = {}
        for batch in batches:
            labels = np.array(batch.column("label").to_pylist(), np.int64)
            for x in np.unique(labels):
                if int(x) not in sent.value:
                    continue
                ids, q = sent.value[int(x)]
                at = np.flatnonzero(labels == x)
                copies = np.array(batch.column("copies").to_pylist(), np.int64)[at]
                mine = np.array(batch.column("rep").to_pylist(), np.int64)[at]
                near = (q @ vectors_of(batch.column("v").take(pa.array(at))).T >= least) & (ids[:, None] != mine[None])
                for i, n in zip(ids.tolist(), (near @ copies).tolist()):
                    total[i] = total.get(i, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["rep", "links"])

    true = reps.select("rep", "label", "v", "copies").mapInArrow(count, "rep bigint, links bigint").groupBy("rep").agg(F.sum("links").alias("links"))
    links = {r.rep: r.links for r in true.collect()}
    found = sum(min(n, links.get(i, 0)) for i, n in zip(rep.tolist(), asked.column("near").to_pylist()))
    every = sum(links.values())
    return found / every if every else 1.0


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, limit: int = SHARD, audit_every: int = 50) -> DataFrame:
    """One row per row of vectors: vec_id, n_links (other rows linked directly),
    component_id (smallest id reachable, its own included), kept, and recall, that of
    all rows' links as audited on vectors whose id is divisible by audit_every. Only equal labels
    are compared. Rows whose label is null, or whose vector is null, empty, zero or
    has a null or non-finite component, have no links; vectors of other length than
    most of their label's have links with none but their copies' length; equal vectors
    are linked; null ids are passed over when the smallest is taken; other columns are
    left out; no rows for no vectors."""
    rows = materialize(distinct_vectors(vectors, id_col, vector_col, label_col))
    sound = rows.filter("rep is not null")
    size = F.size("v")
    reps = sound.groupBy("rep").agg(F.first(F.struct(F.struct("label", size.alias("size")).alias("label"), "v")).alias("x"), F.count("*").alias("copies"), F.min("vec_id").alias("smallest")).select("rep", "x.*", "copies", "smallest")
    reps = materialize(reps.withColumn("label", F.xxhash64("label")))
    slim = reps.select("rep", "label", "v", "copies")
    queries = rows.filter((F.col("vec_id") % audit_every == 0) & F.col("rep").isNotNull())
    for exact in (False, True):
        found = materialize(near_links(slim, least, limit, exact))
        degree = found.filter("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("near"))
        recall = 1.0 if exact else audit_recall(slim, degree, queries, least)
        if recall >= ENOUGH:
            break
    links = found.filter("kind = 1").select("a", "b")
    group = components(links)
    of = reps.select("rep", "copies", "smallest").join(degree, "rep", "left").join(group.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = of.groupBy("component").agg(F.min("smallest").alias("component_id"))
    of = of.join(named, "component").select("rep", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("vec_id", "rep").join(of, "rep", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"), F.lit(float(recall)).alias("recall"))
