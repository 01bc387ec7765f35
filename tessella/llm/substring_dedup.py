"""Substring deduplication of repeated word windows by prefix-partitioned suffix trees.

A first pass counts, over all sampled suffixes (see sync), how many begin with each
prefix of one, two, and up to `least` words, in hashed counters. Each suffix is
then dealt by the shortest of its prefixes that few enough suffixes share, so the
prefixes vary in length and every group fits in memory; equal windows share
`least` words, so none is torn apart. Where even `least` words are too common, a
suffix is dealt twice: for windows that begin fewer than half of `reach` words before
it by the longer prefix that these share, and for the others by that half of
`reach` words before it and `least` after it. Of each group one task builds the suffix
tree. Its internal nodes at least `least` words deep are the maximal repeats, and
from their leaves, ordered by the words before them, the repeated windows follow.
Equal records of one task are merged before they travel, so a passage that a third
of all documents hold reaches its group once per task.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import part_labels, partitions, squeeze, unsqueeze
from .hashing import prefix_sums, run_hashes, word_starts
from .suffix_dedup import emit_runs, forwarded, gathered, keyed, texts
from .sync import anchors, back_words, common, common_words, groups, merged, mixed

GRAM = 3
PIECE = 400_000
GROUP = 50_000
#: Sampled suffixes for each part of the exchange; parts follow the data.
PART = 500_000


def pieces(docs, win: int):
    """docs: (k, bytes). Yields lists of (k, first word, words, text of the words)."""
    group, size = [], 0
    for k, text in docs:
        words = text.split()
        if len(words) < win:
            continue
        for o in range(0, len(words) - win + 1, PIECE):
            piece = words[o : o + PIECE + win - 1]
            if size and size + len(piece) > PIECE // 2:
                yield group
                group, size = [], 0
            group.append((k, o, len(piece), b" ".join(piece) + b" "))
            size += len(piece)
    if group:
        yield group


def sampled(group: list, win: int, reach: int, buckets: int):
    """Text, word starts, anchors, first and last window, piece of each, and the prefix
    buckets, a row for each length from 1 to win - reach + 1."""
    big = b"".join(x[3] for x in group)
    at = word_starts(big)
    h = run_hashes(prefix_sums(big), at[:-1], at[1:])
    gram = mixed(h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9))
    lengths = np.array([x[2] for x in group], np.int64)
    starts = np.cumsum(lengths) - lengths
    a, first, last = anchors(gram, reach, win, starts, lengths)
    of = np.searchsorted(starts, a, "right") - 1
    x = np.zeros(len(a), np.uint64)
    rows = []
    for t in range(win - reach + 1):
        x = mixed(x * np.uint64(0x9FB21C651E98DF25) + h[a + t])
        rows.append((x >> np.uint64(40)).astype(np.int64) % buckets)
    return big, at, a, first, last, of, starts, rows


def pack(run: list) -> bytes:
    """run: sorted (right, left, lo, hi, k, pos, group, full)."""
    lcp, last, rest = [], b"", []
    for x in run:
        n = common(last, x[0])
        lcp.append(n)
        rest.append(x[0][n:])
        last = x[0]
    col = lambda i, t: np.array([x[i] for x in run], t).tobytes()
    sizes = lambda xs: np.array([len(x) for x in xs], "<u4").tobytes()
    lefts = [x[1] for x in run]
    return squeeze(pickle.dumps((np.array(lcp, "<u4").tobytes(), sizes(rest), b"".join(rest), sizes(lefts), b"".join(lefts), col(2, "<u4"), col(3, "<u4"), col(4, "<i8"), col(5, "<i8"), col(6, "<i8"), col(7, "u1"))))


def unpack(blob: bytes):
    """(group, right, left, lo, hi, place, full) in order."""
    lcp, size, rest, lsize, lefts, lo, hi, k, pos, group, full = pickle.loads(unsqueeze(blob))
    arr = lambda b, t: np.frombuffer(b, t).tolist()
    last, i, j = b"", 0, 0
    for n, z, y, a, b, key, p, g, f in zip(arr(lcp, "<u4"), arr(size, "<u4"), arr(lsize, "<u4"), arr(lo, "<u4"), arr(hi, "<u4"), arr(k, "<i8"), arr(pos, "<i8"), arr(group, "<i8"), arr(full, "u1")):
        last = last[:n] + rest[i : i + z]
        i += z
        left = lefts[j : j + y]
        j += y
        yield g, last, left, a, b, (key, p), bool(f)


def by_group(x: tuple) -> tuple:
    return x[6], x[0], x[1]


def subtrees(blobs: list[bytes], visit) -> None:
    """Gives visit() the sorted suffixes of one group after the other."""
    streams = [unpack(b) for b in blobs]
    heads = [next(s) for s in streams]
    live = list(range(len(streams)))
    while live:
        g = min(heads[i][0] for i in live)
        leaves = []
        for i in live:
            while heads[i] is not None and heads[i][0] == g:
                leaves.append(heads[i])
                heads[i] = next(streams[i], None)
        live = [i for i in live if heads[i] is not None]
        if len(leaves) > 1:
            leaves.sort(key=lambda x: (x[1], x[2]))
            visit(leaves)


def prefix_counts(rows: DataFrame, win: int, reach: int, buckets: int) -> np.ndarray:
    """Sampled suffixes of all rows by prefix length and bucket."""
    depth = win - reach + 1

    def count(batches):
        total = np.zeros(depth * buckets, np.int64)
        for group in pieces(texts(batches), win):
            for t, b in enumerate(sampled(group, win, reach, buckets)[7]):
                total[t * buckets : (t + 1) * buckets] += np.bincount(b, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["slot", "n"])

    out = np.zeros(depth * buckets, np.int64)
    for r in rows.mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.slot] = r.n
    return out


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", win: int = 35, reach: int = 30) -> DataFrame:
    """Spans (k, s, e) of words, split at ASCII white space, covered by a window of `win`
    words that also starts elsewhere; they may overlap. k is xxhash64(id, text). Null,
    empty and short texts have none; repeated rows are places of their own."""
    if not 1 <= reach <= win - GRAM + 1:
        raise ValueError("reach must leave room for a gram inside the window")
    least, half = win - reach + 1, reach // 2
    # A bounded number of counters: what the driver holds does not grow with the text.
    buckets = 1 << min(17, max(13, (64 * partitions(docs.sparkSession) - 1).bit_length()))
    rows = keyed(docs, id_col, text_col).select("k", "text").filter(F.octet_length("text") >= 2 * win - 1)
    counts = prefix_counts(rows, win, reach, buckets)
    n = max(partitions(docs.sparkSession), -(-int(counts[:buckets].sum()) // PART))
    labels = part_labels(n)
    few = (counts <= GROUP).reshape(least, buckets)
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(few, axis=1))

    def records(batches):
        ok = np.unpackbits(shared.value, axis=1, count=buckets).astype(bool)
        for group in pieces(texts(batches), win):
            big, at, a, first, last, of, starts, prefix = sampled(group, win, reach, buckets)
            if not len(a):
                continue
            choice = np.full(len(a), -1, np.int64)
            for t, b in enumerate(prefix):
                open_ = (choice < 0) & ok[t][b]
                choice[open_] = t * buckets + b[open_]
            pos = a - starts[of] + np.array([x[1] for x in group], np.int64)[of]
            lo, hi = a - last, a - first
            if (choice < 0).any():
                near, far = np.flatnonzero((choice < 0) & (lo < half)), np.flatnonzero((choice < 0) & (hi >= half))
                sums = prefix_sums(big)
                key = lambda s, e: least * buckets + (run_hashes(sums, at[s], at[e]) >> np.uint64(2)).astype(np.int64)
                keys = [key(a[near], a[near] + win - half + 1), key(a[far] - half, a[far] + least)]
                plain = np.flatnonzero(choice >= 0)
                lo, hi = np.concatenate([lo[plain], lo[near], np.maximum(lo[far], half)]), np.concatenate([hi[plain], np.minimum(hi[near], half - 1), hi[far]])
                pick = np.concatenate([plain, near, far])
                choice = np.concatenate([choice[plain], *keys])
                a, of, pos = a[pick], of[pick], pos[pick]
            for i, j, d, x, y, w0, w1, w2 in zip(lo.tolist(), hi.tolist(), of.tolist(), pos.tolist(), choice.tolist(), at[a - hi].tolist(), at[a].tolist(), at[a - lo + win].tolist()):
                yield big[w1:w2], big[w0:w1], i, j, group[d][0], x, y

    def make(batches):
        yield from emit_runs(records(batches), lambda x: (x[6] * 2654435761 >> 7) % n, labels, win, key=by_group, encode=pack)

    def merge_part(blobs, marks):
        def put(x, o1, o2):
            marks.extend((k, pos - o2, pos - o1 + win) for k, pos in x[4])

        subtrees(blobs, lambda leaves: groups(((None, *x[1:]) for x in leaves), win, least, common_words, back_words, put))

    def merge(batches):
        yield from forwarded(batches, merge_part)

    return rows.mapInArrow(make, "part bigint, kind int, blob binary").repartition(n, "part").mapInArrow(merge, "k bigint, s bigint, e bigint")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", win: int = 35, reach: int = 30, keep: tuple[str, ...] = (), verbatim: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept (the words left, joined
    by one space; with verbatim, a text that loses nothing as it is) and the columns
    named in keep. A null text has no words; a null id
    is kept; repeated rows all lose their windows; other columns are left out; no rows
    for no documents."""
    joined = gathered(keyed(docs, id_col, text_col, *keep), repeated_words(docs, id_col, text_col, win, reach))

    def cut(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
                words = (text or b"").split()
                kept, at, gone = [], 0, 0
                for s, e in merged((x["s"], x["e"]) for x in spans or ()):
                    kept += words[at:s]
                    at = e
                    gone += e - s
                kept += words[at:]
                rows.append((len(words), gone, text or b"" if verbatim and not gone else b" ".join(kept)))
            size, gone, kept = zip(*rows) if rows else ((), (), ())
            more = [batch.column(c) for c in ("doc_id", *keep)]
            yield pa.RecordBatch.from_arrays([*more, pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", *keep, "n_words", "n_removed", "kept"])

    kinds = "".join(f"`{c}` {joined.schema[c].dataType.simpleString()}, " for c in ("doc_id", *keep))
    return joined.select("doc_id", *keep, "text", "spans").mapInArrow(cut, f"{kinds}n_words bigint, n_removed bigint, kept string")
