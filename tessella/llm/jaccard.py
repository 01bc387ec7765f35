"""Exact Jaccard self-join of shingle sets, with every link between different texts.

Sets that are equal count as one (by a 64-bit hash of the whole set). Candidates come
from prefixes: with the shingles of all sets in one order, two sets that are similar
enough share one among the first few of each. The order is by hash, but the most
frequent shingles come last, so a passage that many documents share seldom leads to
candidates. A token's sets are banded by size and checked by the bound that their
places in the prefixes leave. Where few sets share a token, the pairs are emitted;
where many do, the sets become tiles of bounded size. Pairs and tiles are then
tested by hashed bitmaps of the shingles: the bits that one has and the other lacks
bound the overlap from above. What passes is counted exactly on the sorted arrays. Of
a tile only as many pairs are counted as connect all that its bitmaps let pass; if one
of them fails, all that they connect is compared exactly. So components are exact, and the
listed links of a group of copies stay fewer than twice its size. Links join sets of one
component, so all links are then counted, not listed: the sets of a component that a tile
has touched are compared in pairs of blocks of bounded text, each pair of sets once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, materialize, part_labels, partitions, sliced, squeeze, unsqueeze
from .hashing import prefix_sums, run_hashes, word_starts

SHINGLE = 5
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Tokens on the list of frequent ones, which all tasks hold; it only orders tokens.
FREQUENT = 1 << 18
#: Sets of a token up to which all its pairs are emitted.
FEW = 16
#: Shingles in one side of a tile.
TILE = 1 << 19
CHUNK = 1 << 19
#: Bits of the sketch of wanted rows.
SKETCH = 1 << 23
RUN = 8 << 20


class Similar:
    """100 * intersection >= percent * union, in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def overlap(self, a, b):
        """The least intersection that sizes a and b need."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def prefix(self, n: int) -> int:
        return n - (-(-self.percent * n // 100)) + 1

    def sizes(self, small, large):
        return 100 * small >= self.percent * large


def shingle_sets(texts: list[bytes], width: int = SHINGLE):
    """For each text the sorted hashes of its distinct shingles; of one with fewer words
    the whole sequence is the only one, one without words has none."""
    i = 0
    while i < len(texts):
        canon, size = [], 0
        while i < len(texts) and (not canon or size < CHUNK):
            words = texts[i].translate(LOWER).split()
            canon.append((b" ".join(words) + b" " if words else b"", len(words)))
            size += len(canon[-1][0])
            i += 1
        big = b"".join(c for c, _ in canon)
        at = word_starts(big)
        sums = prefix_sums(big)
        n = len(at) - 1
        last = np.minimum(np.arange(n) + width, n)
        ends = np.cumsum([k for _, k in canon])
        h = run_hashes(sums, at[:-1], at[last]) if n else np.zeros(0, np.uint64)
        for (_, k), end in zip(canon, ends.tolist()):
            start = end - k
            if k == 0:
                yield h[:0]
            elif k < width:
                yield run_hashes(sums, at[start : start + 1], at[end : end + 1])
            else:
                x = np.sort(h[start : end - width + 1])
                yield x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) > 1 else x


def set_id(x: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(x.astype("<u8").tobytes(), digest_size=8).digest(), "little", signed=True)


def bitmap(x: np.ndarray, bits: int) -> np.ndarray:
    """bits: a power of two. Set where any shingle hashes to."""
    out = np.zeros(bits // 64, np.uint64)
    slot = (x >> np.uint64(7)) & np.uint64(bits - 1)
    np.bitwise_or.at(out, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
    return out


def width_of(n: int) -> int:
    """Bits of the bitmap of a set of n: two to four for each shingle."""
    return max(64, 1 << (4 * n - 1).bit_length() - 1 if n else 64)


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """A bitmap as if made with fewer bits."""
    while len(x) > words:
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    return x


def bound(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> int:
    """The intersection can't be larger: each bit that only one side has is at least one
    shingle that the other lacks."""
    words = min(len(a), len(b))
    a, b = folded(a, words), folded(b, words)
    return min(na - int(np.bitwise_count(a & ~b).sum()), nb - int(np.bitwise_count(b & ~a).sum()))


def prefix_rows(x: np.ndarray, frequent: np.ndarray, need: int) -> np.ndarray:
    """The first `need` shingles: rare ones by hash, then frequent ones by hash."""
    if len(frequent):
        at = np.searchsorted(frequent, x)
        often = frequent[np.minimum(at, len(frequent) - 1)] == x
        if often.any():
            x = np.concatenate([x[~often], x[often]])
    return x[:need]


def texts_of(batch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


FEATURES = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])


def features(batches, width: int):
    """(kind 0) a row for each document: row id, set id, size and bitmap; (kind 1) tokens
    that several sets of a run share, with their count."""
    seen, held, size = set(), [], 0

    def frequent():
        tokens = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        n = np.diff(np.append(first, len(tokens)))
        token, n = tokens[first[n >= 3]].view(np.int64), n[n >= 3]
        kind, none = np.ones(len(n), np.int32), np.zeros(len(n), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(token), pa.array(none), pa.array(n.astype(np.int64)), pa.nulls(len(n), pa.binary())], schema=FEATURES)

    for batch in sliced(batches):
        out = []
        for k, x in zip(batch.column("k").to_pylist(), shingle_sets(texts_of(batch), width)):
            sid = set_id(x)
            out.append((0, k, sid, len(x), bitmap(x, width_of(len(x))).tobytes()))
            if len(x) and sid not in seen:
                seen.add(sid)
                held.append(x)
                size += 8 * len(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, FEATURES.types)], schema=FEATURES)
        if size >= 4 * RUN:
            yield frequent()
            seen, held, size = set(), [], 0
    if held:
        yield frequent()


def deal(batches, frequent: np.ndarray, similar: Similar, labels: list[int], width: int):
    """Prefixes, packed by part: per set its id, size and number of tokens here; per token
    its lower five bytes and its place."""
    parts = len(labels)
    sets, seen, size = [], set(), 0

    def flush():
        sid = np.array([s for s, _, _ in sets], np.int64)
        n = np.array([z for _, z, _ in sets], np.int64)
        lens = np.array([len(p) for _, _, p in sets], np.int64)
        token = np.concatenate([p for _, _, p in sets])
        owner = np.repeat(np.arange(len(sets)), lens)
        place = np.arange(len(token)) - np.repeat(np.cumsum(lens) - lens, lens)
        part = ((token >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        rows = []
        for p in range(parts):
            pick = order[cuts[p] : cuts[p + 1]]
            if not len(pick):
                continue
            who, first = np.unique(owner[pick], return_index=True)
            each = np.diff(np.append(first, len(pick)))
            low = np.ascontiguousarray(token[pick]).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
            head = np.array([len(who), len(pick)], "<i8").tobytes()
            rows.append((labels[p], squeeze(head + sid[who].tobytes() + n[who].astype("<u4").tobytes() + each.astype("<u4").tobytes() + place[pick].astype("<u4").tobytes() + low)))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "blob"])

    for batch in sliced(batches):
        for x in shingle_sets(texts_of(batch), width):
            if not len(x):
                continue
            sid = set_id(x)
            if sid in seen:
                continue
            seen.add(sid)
            p = prefix_rows(x, frequent, similar.prefix(len(x)))
            sets.append((sid, len(x), p))
            size += 8 * len(p)
            if size >= RUN:
                yield flush()
                sets, seen, size = [], set(), 0
    if sets:
        yield flush()


def dealt(blob: bytes):
    raw = unsqueeze(blob)
    sets, tokens = np.frombuffer(raw, "<i8", 2).tolist()
    o = 16
    sid = np.frombuffer(raw, "<i8", sets, o)
    n = np.frombuffer(raw, "<u4", sets, o := o + 8 * sets)
    each = np.frombuffer(raw, "<u4", sets, o := o + 4 * sets)
    place = np.frombuffer(raw, "<u4", tokens, o := o + 4 * sets)
    low = np.zeros((tokens, 8), np.uint8)
    low[:, :5] = np.frombuffer(raw, np.uint8, 5 * tokens, o + 4 * tokens).reshape(-1, 5)
    rep = np.repeat(np.arange(sets), each)
    return low.view("<u8")[:, 0], sid[rep], n[rep].astype(np.int64), place.astype(np.int64)


def candidates(blobs: list[bytes], similar: Similar):
    """Pairs (a < b) of sets that share a token of the part, and groups of many sets:
    arrays of set ids and sizes."""
    token, sid, n, place = (np.concatenate(x) for x in zip(*map(dealt, blobs)))
    order = np.lexsort((sid, token))
    token, sid, n, place = token[order], sid[order], n[order], place[order]
    new = np.concatenate(([True], (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])))  # a set of several runs counts once
    token, sid, n, place = token[new], sid[new], n[new], place[new]
    first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    count = np.diff(np.append(first, len(token)))
    a_all, b_all = [], []

    def add(i: np.ndarray, j: np.ndarray, bounded: bool):
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        ok = similar.sizes(small, large)
        if bounded:
            ok &= np.minimum(n[i] - place[i], n[j] - place[j]) >= similar.overlap(n[i], n[j])
        a_all.append(np.minimum(sid[i[ok]], sid[j[ok]]))
        b_all.append(np.maximum(sid[i[ok]], sid[j[ok]]))

    for size in range(2, FEW + 1):
        at = first[count == size]
        if len(at):
            u, v = np.triu_indices(size, 1)
            step = max(1, (1 << 20) // len(u))
            for k in range(0, len(at), step):
                rows = at[k : k + step, None]
                add((rows + u).ravel(), (rows + v).ravel(), True)
    groups, known = [], set()
    for f, size in zip(first[count > FEW].tolist(), count[count > FEW].tolist()):
        s, z = sid[f : f + size], n[f : f + size]
        mark = hashlib.blake2b(s.tobytes(), digest_size=8).digest()
        if mark not in known:
            known.add(mark)
            by = np.argsort(z, kind="stable")
            groups.append((s[by], z[by]))
    if a_all:
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        if len(a):
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            a, b = a[new], b[new]
    else:
        a = b = np.zeros(0, np.int64)
    return a, b, groups


def tiles(group, similar: Similar):
    """Cuts a group, in order of size, into blocks of bounded text and yields the pairs of
    blocks whose sizes can go together, as arrays of set ids."""
    s, z = group
    block = np.cumsum(np.maximum(z, TILE >> 12)) // TILE
    cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(s)]
    spans = list(zip(cuts, cuts[1:]))
    paired = False
    for i, (p, q) in enumerate(spans):
        more = [(u, v) for u, v in spans[i + 1 :] if similar.sizes(z[q - 1], z[u])]
        for u, v in more:
            yield np.concatenate([s[p:q], s[u:v]])
        if not more and not paired and q - p > 1:
            yield s[p:q]
        paired = bool(more)  # then the next block, the nearest in size, is in a tile


def pair_up(batches, similar: Similar):
    """Blobs of parts to rows: (kind 0) a, b: a pair; (kind 1) a: a tile, b: a set in it."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for p, blob in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist()):
            held.setdefault(p, []).append(blob)
    for p in list(held):
        a, b, groups = candidates(held.pop(p), similar)
        for i in range(0, len(a), 100_000):
            x, y = a[i : i + 100_000], b[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), np.int32)), pa.array(x), pa.array(y)], names=["kind", "a", "b"])
        for group in groups:
            for members in tiles(group, similar):
                tile = int.from_bytes(hashlib.blake2b(np.sort(members).tobytes(), digest_size=8).digest(), "little", signed=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(members), np.int32)), pa.array(np.full(len(members), tile)), pa.array(members)], names=["kind", "a", "b"])


def likely_forest(maps: list[np.ndarray], n: np.ndarray, similar: Similar) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Of the pairs of a tile that their bitmaps let pass, enough to connect all of them;
    and each set's group. maps: bitmaps in order of size n, smaller ones first."""
    count = np.array([int(np.bitwise_count(m).sum()) for m in maps], np.int64)
    width = np.array([len(m) for m in maps], np.int64)
    tables = {}
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width >= w)
        short = np.stack([folded(maps[i], w) for i in at.tolist()])
        tables[w] = (at[0], short, np.bitwise_count(short).sum(1).astype(np.int64))
    group = np.arange(len(maps))
    out = []
    for i in range(1, len(maps)):
        lo = int(np.searchsorted(n, -(-similar.percent * int(n[i]) // 100)))
        for w in np.unique(width[lo:i]).tolist():
            first, short, bits = tables[w]
            other = lo + np.flatnonzero((width[lo:i] == w) & (group[lo:i] != group[i]))
            if not len(other):
                continue
            both = np.bitwise_count(short[other - first] & short[i - first]).sum(1).astype(np.int64)
            most = np.minimum(n[i] - (bits[i - first] - both), n[other] - (count[other] - both))
            for j in other[most >= similar.overlap(n[other], n[i])].tolist():
                if group[i] != group[j]:
                    out.append((i, j))
                    group[group == group[i]] = group[j]
    return out, group


def tile_links(sets: list[np.ndarray], similar: Similar) -> list[tuple[int, int]]:
    """Links among the sets of a tile that suffice to connect all that are linked."""
    n = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(n, kind="stable")
    sets, n = [sets[i] for i in order], n[order]
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    tokens, which, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    v = int(shared.sum())
    exact = v <= 1 << 14
    bits = max(64, -(-v // 64) * 64) if exact else 1 << 14
    maps = np.zeros((len(sets), bits // 64), np.uint64)
    pick = shared[which]
    slot = number[which[pick]] if exact else ((flat[pick] >> np.uint64(7)) & np.uint64(bits - 1)).astype(np.int64)
    np.bitwise_or.at(maps, (owner[pick], slot >> 6), np.uint64(1) << (slot & 63).astype(np.uint64))
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    group = np.arange(len(sets))
    links = []
    lone = n - np.bincount(owner[pick], minlength=len(sets))  # shingles that no other set here has
    for i in range(len(sets)):
        lo = int(np.searchsorted(n, -(-similar.percent * int(n[i]) // 100)))
        other = np.arange(lo, i)
        other = other[group[lo:i] != group[i]]
        if not len(other):
            continue
        both = np.bitwise_count(maps[other] & maps[i]).sum(1).astype(np.int64)
        if exact:
            most = both
        else:
            own, theirs = int(np.bitwise_count(maps[i]).sum()), np.bitwise_count(maps[other]).sum(1).astype(np.int64)
            most = np.minimum(n[i] - lone[i] - (own - both), n[other] - lone[other] - (theirs - both))
        for j in other[most >= similar.overlap(n[other], n[i])].tolist():
            if find(i) == find(j):
                continue
            if exact or len(np.intersect1d(sets[i], sets[j], True)) >= similar.overlap(n[i], n[j]):
                links.append((int(order[i]), int(order[j])))
                x, y = find(i), find(j)
                root[x] = y
                group[group == group[i]] = group[j]
    return links


def overlaps(a: list[np.ndarray], b: list[np.ndarray], rows: int = 256):
    """For each run of `rows` sets of a, where it starts and its intersections with all of
    b, exactly. Tokens that many sets have are multiplied as matrices, others looked up."""
    flat = np.concatenate([*a, *b])
    size = np.array([len(x) for x in (*a, *b)], np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    token, which, times = np.unique(flat, return_inverse=True, return_counts=True)
    cut = int(size[: len(a)].sum())
    at, to = which[:cut], which[cut:]
    own, other = owner[:cut], owner[cut:] - len(a)
    often = 16 * times >= len(size)
    column = np.cumsum(often) - 1
    kind = np.float32 if size.max() < 1 << 24 else np.float64
    right = np.zeros((len(b), int(often.sum())), kind)
    right[other[often[to]], column[to[often[to]]]] = 1
    few = ~often[to]
    order = np.argsort(to[few], kind="stable")
    held = other[few][order]
    n = np.bincount(to[few], minlength=len(token))
    first = np.cumsum(n) - n
    for i in range(0, len(a), rows):
        p, q = np.searchsorted(own, (i, i + rows))
        count = min(rows, len(a) - i)
        tok, row = at[p:q], own[p:q] - i
        left = np.zeros((count, right.shape[1]), kind)
        left[row[often[tok]], column[tok[often[tok]]]] = 1
        both = (left @ right.T).astype(np.int64)
        tok, row = tok[~often[tok]], row[~often[tok]]
        ends = np.cumsum(n[tok])
        start = 0
        while start < len(tok):
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + (1 << 22), "right")))
            m = n[tok[start:stop]]
            spot = np.repeat(first[tok[start:stop]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            both += np.bincount(np.repeat(row[start:stop], m) * len(b) + held[spot], minlength=count * len(b)).reshape(count, len(b))
            start = stop
        yield i, both


def linked_copies(a: list[np.ndarray], copies_a: np.ndarray, b: list[np.ndarray] | None, copies_b: np.ndarray | None, similar: Similar) -> tuple[np.ndarray, np.ndarray]:
    """How many rows, by the copies of the sets, each set of a is linked to in b, and each
    of b in a; without b, each set of a to the others of a."""
    alone = b is None
    if alone:
        b, copies_b = a, copies_a
    na, nb = (np.array([len(x) for x in y], np.int64) for y in (a, b))
    of_a, of_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    for i, both in overlaps(a, b):
        rows = np.arange(i, i + len(both))
        ok = both >= similar.overlap(na[rows, None], nb[None])
        if alone:
            ok[rows - i, rows] = False
        of_a[rows] = ok @ copies_b
        of_b += copies_a[rows] @ ok
    return of_a, of_b


def sketch(chosen: DataFrame) -> np.ndarray:
    """A bit array of fixed size, set where a k of chosen falls: rows of other texts need
    not be shuffled to find that they aren't wanted. It is merged on the executors, and
    however full it is, the join that follows decides."""
    slot = F.col("k").bitwiseAND(F.lit(SKETCH - 1))
    words = chosen.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k & 63 as int))")).alias("v"))
    got = words.toPandas()
    out = np.zeros(SKETCH // 64, np.int64)
    out[got["w"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64)
    return out.view(np.uint8)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = SHINGLE) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest id reachable
    by links, its own included), n_links (other rows linked directly, those with an equal
    set among them), row_key (xxhash64 of id and text, the same for repeated
    rows) and kept (true for the row_key that stands for its component, and for rows
    without shingles). Sets are the distinct shingles of `width` words, split
    at ASCII white space, with ASCII letters in lower case. Null and empty texts have
    no shingles and no links; equal sets, those of repeated rows too, are linked; null
    ids are passed over when the smallest is taken; other columns are left out; no rows
    for no documents."""
    spark = docs.sparkSession
    similar = Similar(percent)
    parts = partitions(spark)
    labels = part_labels(parts)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("k"))

    made = materialize(rows.select("k", "text").mapInArrow(lambda it: features(it, width), "kind int, a bigint, b bigint, n bigint, bits binary"))
    of_row = made.filter("kind = 0").select(F.col("a").alias("k"), F.col("b").alias("sid"), "n")
    often = made.filter("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).filter(F.col("n") >= FEW).orderBy(F.desc("n"), "a").limit(FREQUENT)
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r.a for r in often.select("a").collect()], np.int64).view(np.uint64)))

    blobs = rows.select("text").mapInArrow(lambda it: deal(it, frequent.value, similar, labels, width), "part bigint, blob binary").repartition(parts, "part")
    found = materialize(blobs.mapInArrow(lambda it: pair_up(it, similar), "kind int, a bigint, b bigint"))
    pairs = found.filter("kind = 0").select("a", "b").distinct()
    members = found.filter("kind = 1").select(F.col("a").alias("tile"), F.col("b").alias("sid")).distinct()

    # First the bitmaps of all candidate pairs, a few hundred bytes each.
    maps = made.filter("kind = 0").groupBy(F.col("b").alias("sid")).agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    side = lambda df, x, *more: df.select(F.col("sid").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in more))

    def passing(batches):
        for batch in batches:
            na, nb, ba, bb = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b"))
            ok = [bound(np.frombuffer(x, np.uint64), p, np.frombuffer(y, np.uint64), q) >= similar.overlap(p, q) for p, q, x, y in zip(na, nb, ba, bb)]
            keep = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([keep.column("a"), keep.column("b")], names=["a", "b"])

    def forest(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n", "ascending"), ("sid", "ascending")])
        sid, n = t.column("sid").to_pylist(), np.array(t.column("n").to_pylist(), np.int64)
        got, tree = likely_forest([np.frombuffer(x, np.uint64) for x in t.column("bits").to_pylist()], n, similar)
        a, b = [min(sid[i], sid[j]) for i, j in got], [max(sid[i], sid[j]) for i, j in got]
        return pa.table([pa.array([t.column("tile")[0].as_py()] * len(got), pa.int64()), pa.array([int(tree[i]) for i, _ in got], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["tile", "tree", "a", "b"])

    # Tiles are tested by bitmaps too; a few pairs connect all that may be linked in one.
    forests = materialize(members.join(maps, "sid").groupBy("tile").applyInArrow(forest, "tile bigint, tree bigint, a bigint, b bigint"))
    passed = pairs.join(side(maps, "a", "n", "bits"), "a").join(side(maps, "b", "n", "bits"), "b").mapInArrow(passing, "a bigint, b bigint")
    likely = materialize(passed.unionByName(forests.select("a", "b")).distinct())

    # Then, of every set that is still a candidate, one row's text; it is shorter than its shingles.
    def texts(needed: DataFrame) -> DataFrame:
        """sid and text of each set in needed."""
        chosen = materialize(of_row.groupBy("sid").agg(F.min("k").alias("k")).join(needed, "sid", "left_semi"))
        some = spark.sparkContext.broadcast(sketch(chosen))

        def maybe(batches):
            for batch in batches:
                slot = (np.asarray(batch.column("k")).view(np.uint64) & np.uint64(SKETCH - 1)).astype(np.int64)
                yield batch.filter(pa.array((some.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)))

        near = rows.select("k", "text").mapInArrow(maybe, "k bigint, text string")
        return materialize(near.join(chosen, "k").dropDuplicates(["k"]).select("sid", "text"))

    def verified(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                text = [[t or b"" for t in part.column(c).cast(pa.binary()).to_pylist()] for c in ("text_a", "text_b")]
                ok = [len(np.intersect1d(x, y, True)) >= similar.overlap(len(x), len(y)) for x, y in zip(*(shingle_sets(t, width) for t in text))]
                keep = part.filter(pa.array(ok, pa.bool_()))
                yield pa.RecordBatch.from_arrays([keep.column("a"), keep.column("b")], names=["a", "b"])

    of_set = texts(likely.select(F.explode(F.array("a", "b")).alias("sid")).distinct())
    links = materialize(likely.join(side(of_set, "a", "text"), "a").join(side(of_set, "b", "text"), "b").mapInArrow(verified, "a bigint, b bigint"))
    group = components(links)

    def of_tile(t: pa.Table) -> pa.Table:
        sid = t.column("sid").to_pylist()
        got = list(shingle_sets([x or b"" for x in t.column("text").cast(pa.binary()).to_pylist()], width))
        links = [(sid[i], sid[j]) for i, j in tile_links(got, similar)]
        return pa.table([pa.array([min(x) for x in links], pa.int64()), pa.array([max(x) for x in links], pa.int64())], names=["a", "b"])

    # A tile of which a connecting pair failed may hold links that its forest doesn't show.
    end = lambda x: group.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    apart = ~F.col("c_a").eqNullSafe(F.col("c_b")) | F.col("c_a").isNull()
    open_ = forests.join(end("a"), "a", "left").join(end("b"), "b", "left").filter(apart).select("tile", "tree").distinct()
    nodes = forests.join(open_, ["tile", "tree"], "left_semi").select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    nodes = materialize(nodes)
    if not nodes.isEmpty():
        # Tokens of one family lead to the same sets again and again. A family, all that
        # forests connect, is compared once, in pairs of blocks of bounded text.
        family = components(forests).select(F.col("node").alias("sid"), F.col("component").alias("family"))
        order = Window.partitionBy("family").orderBy("n", "sid")
        sized = nodes.join(family, "sid").join(maps.select("sid", "n"), "sid").withColumn("block", F.floor(F.sum("n").over(order) / TILE))
        sized = sized.withColumn("last", F.max("block").over(Window.partitionBy("family"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
        tiled = materialize(sized.select("sid", F.xxhash64("family", F.least("block", "other"), F.greatest("block", "other")).alias("tile")))
        in_tiles = tiled.join(texts(nodes), "sid").groupBy("tile").applyInArrow(of_tile, "a bigint, b bigint")
        links = materialize(links.unionByName(in_tiles).distinct())
        group = components(links)
    # Links that aren't listed join sets of one forest. Components that a forest touches and
    # that miss a pair are counted whole, each pair of their sets in one pair of blocks.
    copies = of_row.filter("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.count("*").alias("copies"))
    group = group.select(F.col("node").alias("sid"), "component")
    sizes = group.groupBy("component").agg(F.count("*").alias("sets"))
    listed = links.join(group, links["a"] == group["sid"]).groupBy("component").agg(F.count("*").alias("links"))
    touched = group.join(forests.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "sid", "left_semi").select("component").distinct()
    missing = materialize(touched.join(sizes, "component").join(listed, "component").filter(2 * F.col("links") < F.col("sets") * (F.col("sets") - 1)).select("component"))
    both = links.select(F.explode(F.array(F.struct(F.col("a").alias("sid"), F.col("b").alias("other")), F.struct(F.col("b").alias("sid"), F.col("a").alias("other")))).alias("x")).select("x.*")
    both = both.join(group, "sid").join(missing, "component", "left_anti")
    near = both.join(copies.select(F.col("sid").alias("other"), "copies"), "other").select("sid", F.col("copies").alias("near"))
    if not missing.isEmpty():
        order = Window.partitionBy("component").orderBy("n", "sid")
        blocks = materialize(group.join(missing, "component", "left_semi").join(copies, "sid").withColumn("block", F.floor(F.sum(F.greatest("n", F.lit(TILE >> 12))).over(order) / TILE)))
        spans = blocks.groupBy("component", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
        one = spans.select("component", F.col("block").alias("one"), "hi")
        two = spans.select("component", F.col("block").alias("two"), "lo")
        tiled = materialize(one.join(two, "component").filter((F.col("one") <= F.col("two")) & (100 * F.col("hi") >= percent * F.col("lo"))).select("component", "one", "two"))
        sides = [blocks.withColumnRenamed("block", "one").join(tiled, ["component", "one"]).withColumn("second", F.lit(False))]
        sides.append(blocks.withColumnRenamed("block", "two").join(tiled.filter("one < two"), ["component", "two"]).withColumn("second", F.lit(True)))
        placed = sides[0].unionByName(sides[1]).join(of_set, "sid").select("component", "one", "two", "second", "sid", "copies", "text")

        def count(t: pa.Table) -> pa.Table:
            parts = [t.filter(pc.equal(t.column("second"), x)) for x in (False, True)]
            got = [list(shingle_sets([x or b"" for x in p.column("text").cast(pa.binary()).to_pylist()], width)) for p in parts]
            n = [np.array(p.column("copies").to_pylist(), np.int64) for p in parts]
            if len(parts[1]):
                of = linked_copies(got[0], n[0], got[1], n[1], similar)
            else:
                of = linked_copies(got[0], n[0], None, None, similar)[0], np.zeros(0, np.int64)
            return pa.table([pa.concat_arrays([c for p in parts for c in p.column("sid").chunks]), pa.array(np.concatenate(of))], names=["sid", "near"])

        near = near.unionByName(placed.groupBy("component", "one", "two").applyInArrow(count, "sid bigint, near bigint"))
    near = near.groupBy("sid").agg(F.sum("near").alias("near"))
    degree = copies.join(near, "sid", "left").select("sid", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    ids = rows.select("doc_id", "k").join(of_row.distinct(), "k", "left")
    of_sid = ids.join(group, "sid", "left").join(degree, "sid", "left")
    of_sid = of_sid.withColumn("component", F.coalesce("component", "sid"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k"))
    named = of_sid.filter("n > 0").groupBy("component").agg(first.alias("first"))
    out = of_sid.join(named, "component", "left")
    some = F.col("n") > 0
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(some, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.col("k").alias("row_key"),
        F.when(some, F.col("k") == F.col("first.k")).otherwise(F.lit(True)).alias("kept"),
    )
