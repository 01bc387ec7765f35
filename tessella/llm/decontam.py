"""Benchmark decontamination by Wu-Manber search over words.

Every window of `win` words of a benchmark item, and every shorter item as a whole,
is a pattern. For each pattern length a shift table tells from the last two words
under the cursor how far the search can jump; where it says 0, the hash of the
pattern's last and first blocks selects a bucket of patterns, and the words
themselves are compared. Many stretches of text are searched side by side, each
with a cursor of its own, so a step is a few array operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import received, shipped
from .hashing import prefix_sums, run_hashes, word_starts
from .sync import merged, mixed

SLOTS = 1 << 18
LANE = 2048
BATCH = 2 << 20
#: Benchmark text in bytes that one search holds; more is searched in several passes.
LIMIT = 16 << 20

def _folded(i: int) -> int:
    if 65 <= i <= 90:
        return i + 32
    return i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32


FOLD = bytes(_folded(i) for i in range(256))


def canonical(text: bytes) -> bytes:
    """Lower-cased ASCII; words of letters, digits and non-ASCII, a space after each."""
    out = b" ".join(text.translate(FOLD).split())
    return out + b" " if out else b""


def blocks(h: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    x = h[end] * np.uint64(0xC2B2AE3D27D4EB4F)
    if width > 1:
        x = x + h[end - 1] * np.uint64(0x9E3779B97F4A7C15)
    return mixed(x)


class Search:
    """Patterns of one length, in words."""

    def __init__(self, size: int, patterns: dict[bytes, list]):
        self.size, self.width = size, min(2, size)
        self.texts = list(patterns)
        self.items = [sorted(set(patterns[t])) for t in self.texts]
        big = b"".join(self.texts)
        at = word_starts(big)
        h = run_hashes(prefix_sums(big), at[:-1], at[1:])
        first = np.arange(len(self.texts), dtype=np.int64) * size
        self.shift = np.full(SLOTS, size - self.width + 1, np.uint8 if size < 256 else np.int64)
        for j in range(self.width - 1, size):
            slot = (blocks(h, first + j, self.width) % np.uint64(SLOTS)).astype(np.int64)
            np.minimum.at(self.shift, slot, size - 1 - j)
        keys = self.key(h, first + size - 1)
        order = np.argsort(keys, kind="stable")
        self.keys, self.order = keys[order], order

    def key(self, h: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the last block and the first one."""
        return blocks(h, end, self.width) ^ (blocks(h, end - self.size + self.width, self.width) * np.uint64(0xA0761D6478BD642F))

    def find(self, big: bytes, at: np.ndarray, h: np.ndarray, lane: int = LANE):
        """Yields (first word, pattern) for every occurrence in the text."""
        n = len(h)
        if n < self.size:
            return
        cursor = np.arange(0, n, lane, dtype=np.int64)
        stop = np.minimum(cursor + lane, n)
        cursor = np.maximum(cursor, self.size - 1)
        live = np.flatnonzero(cursor < stop)
        cursor, stop = cursor[live], stop[live]
        found = []
        while len(cursor):
            step = self.shift[(blocks(h, cursor, self.width) % np.uint64(SLOTS)).astype(np.int64)].astype(np.int64)
            zero = step == 0
            if zero.any():
                found.append(cursor[zero])
                step[zero] = 1
            cursor = cursor + step
            live = cursor < stop
            if not live.all():
                cursor, stop = cursor[live], stop[live]
        if not found:
            return
        end = np.sort(np.concatenate(found))
        keys = self.key(h, end)
        lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        for e, a, b in zip(*(x[lo < hi].tolist() for x in (end, lo, hi))):
            s = e - self.size + 1
            text = big[at[s] : at[e + 1]]
            for i in self.order[a:b].tolist():
                if self.texts[i] == text:
                    yield s, i


def patterns(items, win: int) -> dict[int, dict[bytes, list]]:
    """By length: text of the words -> item ids. An item of fewer words than win is one
    pattern; one without words has none."""
    out: dict[int, dict[bytes, list]] = {}
    for item, text in items:
        words = canonical(text).split()
        size = min(win, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            out.setdefault(size, {}).setdefault(b" ".join(words[i : i + size]) + b" ", []).append(item)
    return out


def scanned(batches, searches: list[Search], keep: tuple[str, ...] = ()):
    """Batches of (doc_id, text) to (doc_id, keep, n_words, spans, items)."""
    span = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    for batch in batches:
        ids = batch.column("doc_id")
        texts = [canonical(x or b"") for x in batch.column("text").cast(pa.binary()).to_pylist()]
        n_words = [x.count(b" ") for x in texts]
        spans: list[list] = [[] for _ in texts]
        items: list[set] = [set() for _ in texts]
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= BATCH):
                size += len(texts[j])
                j += 1
            big = b"".join(texts[i:j])
            at = word_starts(big)
            h = run_hashes(prefix_sums(big), at[:-1], at[1:])
            starts = np.cumsum([0, *n_words[i:j]])
            for search in searches:
                hits = list(search.find(big, at, h))
                of = np.searchsorted(starts, [s for s, _ in hits], "right") - 1
                for (s, p), d in zip(hits, of.tolist()):
                    if s + search.size <= starts[d + 1]:  # not across two documents
                        s -= int(starts[d])
                        spans[i + d].append((s, s + search.size))
                        items[i + d].update(search.items[p])
            i = j
        out = [[{"s": s, "e": e} for s, e in merged(x)] for x in spans]
        yield pa.RecordBatch.from_arrays([ids, *(batch.column(c) for c in keep), pa.array(n_words, pa.int64()), pa.array(out, span), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=["doc_id", *keep, "n_words", "spans", "items"])


def packs(benchmark: DataFrame, id_col: str, text_col: str, limit: int):
    """Benchmark items in packs of bounded size, read one after the other."""
    held, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("string").alias("i"), F.encode(F.col(text_col), "utf-8").alias("t")).filter("t is not null").toLocalIterator():
        if held and size + len(r.t) > limit:
            yield held
            held, size = [], 0
        held.append((r.i if r.i is not None else "", bytes(r.t)))
        size += len(r.t)
    yield held


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", win: int = 10, limit: int = LIMIT, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, the columns named in keep, n_words, spans (maximal runs of words, from s to
    before e, that lie in an occurrence of a benchmark window) and items (ids, as
    strings, of the items that occur; sorted). A null text has no words; a null item
    id counts as ''; items that repeat a window are all named; an empty benchmark
    hits nothing; other columns are left out. Benchmark text beyond `limit` bytes is
    searched in further passes, whose results are merged per row."""
    spark = docs.sparkSession
    clash = {"doc_id", "spans", "items", "n_words", "spans_before", "items_before"} & set(keep)
    if clash or ("text" in keep and text_col != "text"):
        raise ValueError(f"kept columns would clash with the result's: {sorted(clash) or ['text']}")
    every = packs(benchmark, item_col, item_text, limit)
    first, second = next(every), next(every, None)
    held = tuple(keep) if second is None or "text" in keep else (*keep, "text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *(c for c in keep if c != "text"))
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in ("doc_id", *held))
    found = "n_words bigint, spans array<struct<s:bigint,e:bigint>>, items array<string>"

    def scan(source: DataFrame, pack: list, columns: str, more: tuple[str, ...]) -> DataFrame:
        searches = shipped(spark, [Search(k, p) for k, p in sorted(patterns(pack, win).items())])
        return source.mapInArrow(lambda batches: scanned(batches, received(searches), more), columns + found)

    out = scan(rows, first, kinds, held)
    while second is not None:
        # What the passes before found rides along as two more columns.
        before = out.withColumnRenamed("spans", "spans_before").withColumnRenamed("items", "items_before").drop("n_words")
        columns = kinds + "spans_before array<struct<s:bigint,e:bigint>>, items_before array<string>, "
        out = scan(before, second, columns, (*held, "spans_before", "items_before"))
        out = out.select("doc_id", *held, "n_words", joined_spans(F.concat("spans_before", "spans")).alias("spans"), F.array_sort(F.array_union("items_before", "items")).alias("items"))
        second = next(every, None)
    return out.select("doc_id", *keep, "n_words", "spans", "items")

def joined_spans(spans):
    """Sorted, with overlapping and touching spans joined."""
    empty = F.array().cast("array<struct<s:bigint,e:bigint>>")
    last = lambda acc: F.element_at(acc, -1)
    longer = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["s"].alias("s"), F.greatest(last(acc)["e"], x["e"]).alias("e"))))
    return F.aggregate(F.array_sort(spans), empty, lambda acc, x: F.when((F.size(acc) > 0) & (x["s"] <= F.get(acc, F.size(acc) - 1)["e"]), longer(acc, x)).otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))))

def n_hit(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
