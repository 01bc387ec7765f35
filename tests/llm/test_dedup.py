"""Operators 1, 4 and 5 against brute force, with nulls, copies and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import jaccard
from tessella.llm import substring_dedup as substring
from tessella.llm import suffix_dedup as suffix
from tessella.llm.jaccard import jaccard_components
from tessella.llm.substring_dedup import substring_dedup
from tessella.llm.suffix_dedup import LoserTree, suffix_dedup
from tessella.llm.sync import common

SCHEMA = "doc_id bigint, text string, k string, spans string, sid int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdéz") for _ in range(rng.randint(1, 7)))
    base = [" ".join(word() for _ in range(rng.randint(1, 160))) for _ in range(30)]
    passage = " ".join(word() for _ in range(60))
    texts = base + base[:4] + [None, "", "   ", "a" * 900, "one two", "One TWO", "one two"]
    texts += [b[: len(b) // 2] + " " + passage + "\n" + b[len(b) // 2 :] for b in base[5:15]]
    for b in base[15:25]:
        w = b.split()
        if len(w) > 20:
            w[3] = "changed"
            texts.append(" ".join(w))
    out = [(i, t, "x", "y", i) for i, t in enumerate(texts)]
    return out + [out[0], (None, base[2], None, None, None), (None, None, None, None, None)]


def windows_gone(seqs, size):
    seen = Counter(s[i : i + size] for s in seqs for i in range(len(s) - size + 1))
    out = []
    for s in seqs:
        gone = bytearray(len(s))
        for i in range(len(s) - size + 1):
            if seen[s[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        out.append(gone)
    return out


@pytest.mark.parametrize("win,reach", [(40, 20), (60, 45)])
def test_suffix_dedup(spark, rows, win, reach):
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA), win=win, reach=reach).collect()
    texts = [(r[1] or "").encode() for r in rows]
    want = Counter((r[0], len(t), sum(g), bytes(c for c, x in zip(t, g) if not x)) for r, t, g in zip(rows, texts, windows_gone(texts, win)))
    assert Counter((r.doc_id, r.n_bytes, sum(s.e - s.s for s in r.spans), bytes(r.kept)) for r in got) == want
    assert all(a.e < b.s for r in got for a, b in zip(r.spans, r.spans[1:]))


@pytest.mark.parametrize("win,reach", [(10, 6), (35, 30)])
def test_substring_dedup(spark, rows, win, reach):
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA), win=win, reach=reach).collect()
    seqs = [tuple(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    want = Counter((r[0], len(s), sum(g), " ".join(w for w, x in zip(s, g) if not x)) for r, s, g in zip(rows, seqs, windows_gone(seqs, win)))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want


@pytest.mark.parametrize("win,reach", [(10, 6), (10, 1), (35, 30)])
def test_substring_dedup_splits_common_prefixes(spark, rows, win, reach, monkeypatch):
    """Every prefix counts as too common, and parts are many."""
    monkeypatch.setattr(substring, "GROUP", 0)
    monkeypatch.setattr(substring, "PART", 20)
    rng = random.Random(6)
    more = [" ".join("same six words begin every window".split() + [rng.choice("ab") for _ in range(40)] + ["x"] * rng.randint(0, 40)) for _ in range(60)]
    test_substring_dedup(spark, rows + [(1000 + i, t, "x", "y", 0) for i, t in enumerate(more)], win, reach)


def test_suffix_dedup_of_many_parts(spark, rows, monkeypatch):
    monkeypatch.setattr(suffix, "PART", 200)
    test_suffix_dedup(spark, rows, 60, 45)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("few", [16, 1])
def test_jaccard(spark, rows, few, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", few)
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    smallest = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            smallest[find(i)] = min(smallest.get(find(i), r[0]), r[0])
    want = Counter((r[0], len(s), smallest.get(find(i), None) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets)))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    kept = [r for r in got if r.kept and r.n_shingles]
    assert len({r.row_key for r in kept}) == len({find(i) for i, s in enumerate(sets) if s})


@pytest.mark.parametrize("tile", [1 << 19, 1500])
def test_jaccard_counts_every_link(spark, tile, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = ["nothing like it at all here", None, ""]
    for _ in range(60):
        w = list(base)
        for i in rng.sample(range(120), rng.randint(0, 5)):
            w[i] = f"x{rng.randint(0, 99)}"
        texts.append(" ".join(w[: rng.choice([120, 120, 105, 95])]))
    texts += [texts[5].upper(), texts[5], texts[9]]
    rows = [(i, t, "x", "y", i) for i, t in enumerate(texts)]
    rows += [rows[7], rows[0]]
    sets = [shingles(r[1]) for r in rows]
    linked = lambda a, b: bool(a and b) and 100 * len(a & b) >= 75 * len(a | b)
    want = Counter((r[0], sum(linked(a, b) for b in sets) - bool(a)) for r, a in zip(rows, sets))
    assert len({n for _, n in want}) > 9 and max(n for _, n in want) > 25
    assert Counter((r.doc_id, r.n_links) for r in jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()) == want


def test_overlaps():
    rng = np.random.default_rng(4)
    sets = [np.unique(np.append(rng.choice(400, rng.integers(1, 60)), rng.integers(0, 1 << 60, 3))).astype(np.uint64) for _ in range(90)]
    sets += [np.unique(np.append(x[:30], np.uint64(7))) for x in sets[:30]]
    a, b = sets[:70], sets[60:]
    got = np.concatenate([x for _, x in jaccard.overlaps(a, b, 16)])
    assert (got == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup(none).count() == substring_dedup(none).count() == jaccard_components(none).count() == 0


def test_loser_tree():
    rng = random.Random(1)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 30))) for _ in range(7)]
    coded = [[(common(a, b), b, (run, i)) for i, (a, b) in enumerate(zip([b"", *r], r))] for run, r in enumerate(runs)]
    out = list(LoserTree(coded))
    assert [x[1] for x in out] == sorted(sum(runs, []))
    assert all(b[0] == common(a[1], b[1]) for a, b in zip(out, out[1:]))


def test_verbatim_and_kept_columns(spark):
    rows = [(1, "a  b\nc", "s"), (2, None, None)]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), keep=("source",), verbatim=True)
    assert sorted((r.doc_id, r.source, r.kept) for r in got.collect()) == [(1, "s", "a  b\nc"), (2, None, "")]
    assert hashlib.sha256(b"").hexdigest() == got.filter("doc_id = 2").select(F.sha2("kept", 256)).first()[0]
