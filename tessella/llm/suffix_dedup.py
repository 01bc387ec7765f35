"""Suffix-array deduplication of exact byte runs.

Each task sorts the sampled suffixes of its documents (see sync) into runs, which
travel front-coded: per suffix the length of the prefix shared with the one
before, and the rest. A suffix goes to the partition of a hash of the prefix that
any two equal windows share, so a partition holds whole branches of the suffix
array and no splitters have to be sampled. There a loser tree merges the runs. It
keeps for each contender the prefix shared with the last suffix that came out, so
known prefixes are never compared again, and the merged order comes with its LCP
array for nothing; from that the repeated windows are read.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import part_labels, partitions, squeeze, unsqueeze
from .sync import anchors, back_bytes, common, groups, merged, mixed

GRAM = 16
PIECE = 4 << 20
RUN = 60_000
#: Sampled suffixes for each part of the exchange; parts follow the data.
PART = 500_000
MARKS = pa.schema([("k", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])


class LoserTree:
    """Merges sorted streams of (lcp, string, tie, *rest); lcp is the prefix shared with
    the stream's string before. Yields the same, lcp then being the prefix shared
    with the string that came out before."""

    def __init__(self, streams: list):
        self.streams = [iter(s) for s in streams]
        self.head = [next(s, None) for s in self.streams]

    def wins(self, i: int, h: int, j: int, g: int) -> tuple[bool, int]:
        """Whether stream i's head, which shares h with the last output, comes before
        j's, which shares g; and what the loser shares with the winner."""
        a, b = self.head[i], self.head[j]
        if a is None or b is None:
            return b is None, 0
        if h != g:
            return h > g, min(h, g)
        x, y = a[1], b[1]
        if x == y:
            return (a[2], i) < (b[2], j), len(x)
        h += common(x[h:], y[h:])
        return x[h : h + 1] < y[h : h + 1], h

    def __iter__(self):
        k = len(self.streams)
        if not k:
            return
        loser = [(0, 0)] * (2 * k)

        def build(node: int) -> tuple[int, int]:
            if node >= k:
                return node - k, 0
            (i, h), (j, g) = build(2 * node), build(2 * node + 1)
            first, shared = self.wins(i, h, j, g)
            loser[node] = (j, shared) if first else (i, shared)
            return (i, h) if first else (j, g)

        win, shared = build(1) if k > 1 else (0, 0)
        while (out := self.head[win]) is not None:
            yield (shared, *out[1:])
            self.head[win] = nxt = next(self.streams[win], None)
            i, h = win, nxt[0] if nxt else 0
            node = (win + k) // 2
            while node:
                j, g = loser[node]
                first, rest = self.wins(i, h, j, g)
                if first:
                    loser[node] = (j, rest)
                else:
                    loser[node] = (i, rest)
                    i, h = j, g
                node //= 2
            win, shared = i, h


def pack(run: list) -> bytes:
    """run: sorted (right, left, lo, hi, k, pos, full)."""
    lcp, last, rest, lefts = [], b"", [], []
    for x in run:
        n = common(last, x[0])
        lcp.append(n)
        rest.append(x[0][n:])
        lefts.append(x[1])
        last = x[0]
    col = lambda i, t: np.array([x[i] for x in run], t).tobytes()
    return squeeze(pickle.dumps((np.array(lcp, "<u4").tobytes(), np.array([len(x) for x in rest], "<u4").tobytes(), b"".join(rest), b"".join(lefts), col(2, "<u4"), col(3, "<u4"), col(4, "<i8"), col(5, "<i8"), col(6, "u1"))))


def unpack(blob: bytes):
    lcp, size, rest, lefts, lo, hi, k, pos, full = pickle.loads(unsqueeze(blob))
    arr = lambda b, t: np.frombuffer(b, t).tolist()
    last, i, j = b"", 0, 0
    for n, z, a, b, key, p, f in zip(arr(lcp, "<u4"), arr(size, "<u4"), arr(lo, "<u4"), arr(hi, "<u4"), arr(k, "<i8"), arr(pos, "<i8"), arr(full, "u1")):
        last = last[:n] + rest[i : i + z]
        i += z
        left = lefts[j : j + b]
        j += b
        yield n, last, left, a, b, (key, p), bool(f)


def byte_records(docs, win: int, reach: int):
    """docs: (k, bytes). Yields (right, left, lo, hi, k, position)."""
    group, size = [], 0

    def flush():
        big = b"".join(x[2] for x in group)
        n = len(big)
        lengths = np.array([len(x[2]) for x in group], np.int64)
        starts = np.cumsum(lengths) - lengths
        v = np.ndarray((n + 8,), "<u8", buffer=big + bytes(24), strides=(1,))
        h = mixed(v[:n] * np.uint64(0x9E3779B97F4A7C15) + v[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F))
        a, first, last = anchors(h, reach, win, starts, lengths)
        of = np.searchsorted(starts, a, "right") - 1
        base = np.array([x[1] for x in group], np.int64) - starts
        for i, p, q, d, pos in zip(a.tolist(), first.tolist(), last.tolist(), of.tolist(), (a + base[of]).tolist() if len(a) else ()):
            yield big[i : q + win], big[p:i], i - q, i - p, group[d][0], pos

    for k, text in docs:
        if len(text) < win:
            continue
        for o in range(0, max(1, len(text) - win + 1), PIECE):
            piece = text[o : o + PIECE + win - 1]
            if size and size + len(piece) > PIECE // 2:
                yield from flush()
                group, size = [], 0
            group.append((k, o, piece))
            size += len(piece)
    if group:
        yield from flush()


def by_suffix(x: tuple) -> tuple:
    return x[0], x[1]


def collapse(run: list, win: int, key=by_suffix):
    """Sorts a run; of equal records one stays, marked full. Returns the run and the
    spans of repeated tokens (k, s, e) that it shows by itself."""
    run.sort(key=key)
    out, marks = [], []
    i, n = 0, len(run)
    while i < n:
        x = run[i]
        j = i + 1
        while j < n and run[j][0] == x[0] and run[j][1] == x[1] and run[j][2] == x[2]:
            j += 1
        if j - i > 1:
            marks += [(y[4], y[5] - y[3], y[5] - y[2] + win) for y in run[i:j]]
        out.append((*x, j - i > 1))
        i = j
    return out, marks


def spans_batch(marks: list) -> pa.RecordBatch:
    k, s, e = zip(*marks) if marks else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], schema=MARKS)


def blobs_batch(rows: list) -> pa.RecordBatch:
    part, kind, blob = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["part", "kind", "blob"])


def texts(batches):
    for batch in batches:
        ks = batch.column("k").to_pylist()
        for k, text in zip(ks, batch.column("text").cast(pa.binary()).to_pylist()):
            if text:
                yield k, text


def emit_runs(records, route, labels: list[int], win: int, size: int = RUN, key=by_suffix, encode=pack):
    """Cuts records into runs and these by route(record); yields batches of blobs."""
    parts, count, turn = {}, 0, 0

    def flush():
        nonlocal turn
        rows, all_marks = [], []
        for p, run in sorted(parts.items()):
            run, marks = collapse(run, win, key)
            all_marks += marks
            rows.append((labels[p], 0, encode(run)))
        if all_marks:
            turn += 1
            rows.append((labels[(len(all_marks) + turn * 7919) % len(labels)], 1, squeeze(np.array(all_marks, "<i8").tobytes())))
        return blobs_batch(rows)

    for x in records:
        parts.setdefault(route(x), []).append(x)
        count += 1
        if count >= size:
            yield flush()
            parts, count = {}, 0
    if count:
        yield flush()


def forwarded(batches, merge_part):
    """Passes marks on and gives the runs of each part to merge_part(blobs, put)."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for p, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "blob"))):
            if kind:
                got = np.frombuffer(unsqueeze(blob), "<i8").reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, i]) for i in range(3)], schema=MARKS)
            else:
                held.setdefault(p, []).append(blob)
    for p in list(held):
        marks: list = []
        merge_part(held.pop(p), marks)
        for i in range(0, len(marks), 100_000):
            yield spans_batch(marks[i : i + 100_000])


def keyed(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """Id and text with a key of both, by which equal rows are one place each but
    get one answer."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep).withColumn("k", F.xxhash64("doc_id", "text"))


def gathered(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """docs (with k) and the spans of each, as arrays."""
    spans = marks.groupBy("k").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return docs.join(spans, "k", "left")


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", win: int = 400, reach: int = 320) -> DataFrame:
    """Spans (k, s, e) of bytes covered by a `win`-byte string that also starts
    elsewhere; they may overlap. k is xxhash64(id, text). Null and short texts have
    none; repeated rows are places of their own, so all their windows repeat."""
    if not GRAM <= reach <= win - GRAM + 1:
        raise ValueError("reach must leave room for a gram inside the window")
    least = win - reach + 1
    rows = keyed(docs, id_col, text_col).select("k", "text").filter(F.octet_length("text") >= win)
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(partitions(docs.sparkSession), -(-2 * size // ((reach + 1) * PART)))
    labels = part_labels(n)

    def make(batches):
        yield from emit_runs(byte_records(texts(batches), win, reach), lambda x: zlib.crc32(x[0][:least]) % n, labels, win)

    def merge_part(blobs, marks):
        def put(x, o1, o2):
            marks.extend((k, pos - o2, pos - o1 + win) for k, pos in x[4])

        groups(iter(LoserTree([unpack(b) for b in blobs])), win, least, common, back_bytes, put)

    def merge(batches):
        yield from forwarded(batches, merge_part)

    runs = rows.mapInArrow(make, "part bigint, kind int, blob binary").repartition(n, "part")
    return runs.mapInArrow(merge, "k bigint, s bigint, e bigint")


def cut_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for s, e in spans:
        out.append(text[at:s])
        at = e
    out.append(text[at:])
    return b"".join(out)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", win: int = 400, reach: int = 320) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, spans (maximal removed runs, in bytes)
    and kept, the remaining bytes. A null text counts as empty; a null id is kept as
    it is; repeated rows all lose their windows; other columns of docs are left out;
    no rows for no documents."""
    joined = gathered(keyed(docs, id_col, text_col), repeated_bytes(docs, id_col, text_col, win, reach))

    def cut(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
                text = text or b""
                spans = merged((x["s"], x["e"]) for x in spans or ())
                rows.append((len(text), [{"s": s, "e": e} for s, e in spans], cut_bytes(text, spans)))
            size, spans, kept = zip(*rows) if rows else ((), (), ())
            span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", "spans").mapInArrow(cut, f"doc_id {kind}, n_bytes bigint, spans array<struct<s:bigint,e:bigint>>, kept binary")
