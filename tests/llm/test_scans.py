"""Operators 2, 6, 7, 8, 9 and 10."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_pipeline import language_id
from tessella.llm.chat import chained, format_replies, loss_text, read_back
from tessella.llm.decontam import decontaminate, n_hit
from tessella.llm.langid import fit, identify
from tessella.llm.license_scan import PHRASES, TEMPLATES, scan_licenses
from tessella.llm.packing import best_fit, pack_documents
from tessella.llm.warc import audit, fixity_audit, leaves, parse_records, warc_records

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DATA = "/root/testdata/sf0.001"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_license_scan(spark):
    rows = [(i, t) for i, t in enumerate(["All rights  RESERVED. all-rights reserved", "CC BY, cc_by; cc-by 4.0", "gnu General Public License v2", "reserved rights all", None, "", "Kcc by İ é", "x " * 50 + TEMPLATES[5][1] + " all rights reserved", TEMPLATES[5][1].replace("free of charge", "for money")])]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows:
        w = words(t)
        want = sorted((s, label) for label, p in PHRASES for s in range(len(w)) if w[s : s + len(p.split())] == p.split())
        assert got[i].n_words == len(w)
        assert sorted((p.start, p.label) for p in got[i].places) == want
    assert [m.label for m in got[7].matches] == ["mit"] and got[7].matches[0].start == 50
    assert not got[8].matches and not got[0].matches
    assert scan_licenses(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_license_scan_of_all_templates(spark):
    every = " and ".join(sentence for _, sentence, _ in TEMPLATES)
    rows = [(0, every)] + [(i, dict((t[0], t[1]) for t in TEMPLATES)["mit"]) for i in range(1, 30)]
    got = {r.doc_id: r.matches for r in scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sorted((m.label, m.score) for m in got[0]) == sorted((label, 1.0) for label, _, _ in TEMPLATES)
    w = words(every)
    assert all(w[m.start : m.start + 5] == sentence.split()[:5] for m in got[0] for label, sentence, _ in TEMPLATES if label == m.label)
    assert all([(m.label, m.score) for m in got[i]] == [("mit", 1.0)] for i in range(1, 30))


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = fit(docs, sample=150, epochs=6)
    got = identify(docs.select("doc_id", "text", "lang"), net, keep=("lang",)).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    odd = identify(spark.createDataFrame([(1, None), (2, "12 !?"), (3, "")], "doc_id bigint, text string"), net).collect()
    assert [r.lang_pred for r in odd] == ["und"] * 3
    assert fit(docs.filter("lang = 'xx'")) is None


def test_pipeline_keeps_unlabelled_documents(spark):
    docs = spark.createDataFrame([(1, "clean text", None, "s", 10), (2, "12 !?", None, "s", 5), (3, None, None, "s", 0), (None, "é", None, None, 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = language_id(spark, docs, "").collect()
    assert Counter(map(tuple, got)) == Counter([(1, "clean text", "und", "s", 10), (None, "é", "und", None, 1)])


def test_chat_round_trip(spark):
    turns = [(1, 0, "user", "a<b|c[d\\e\\l \\\\|> <|end|> é\n"), (1, 1, "assistant", "\\"), (1, 2, "assistant", None), (2, 0, None, "only"), (None, 5, "assistant", "x"), (1, 3, "user|><|", "[INST]")]
    got = format_replies(chained(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")))
    got = got.select("tree", "n_turns", read_back(F.col("formatted")).alias("back"), loss_text(F.col("formatted"), F.col("segments")).alias("loss"), "formatted", "segments")
    by = {r.tree: r for r in got.collect()}
    assert set(by) == {1, 2, None}
    assert [(t.role, t.text) for t in by[1].back] == [(t[2], t[3] or "") for t in turns[:3]] + [(turns[5][2], "[INST]")]
    assert by[1].loss == "\\" and by[None].loss == "x" and by[2].loss == ""
    assert "".join(s.text for s in by[1].segments) == by[1].formatted
    assert "[INST]" not in by[1].formatted


def test_chat_tree_paths(spark):
    rows = [("t", 1, None, 1.0), ("t", 2, 1, 0.5), ("t", 3, 1, 0.9), ("t", 4, 2, 2.0), ("t", 5, 3, 0.1), ("t", 6, 99, 0.2), ("t", 7, 8, 9.0), ("t", 8, 7, 9.0)]
    rows = [(*r, "user", f"m{r[1]}") for r in rows]
    got = format_replies(spark.createDataFrame(rows, "tree string, node bigint, parent bigint, score double, role string, text string"), score="score", top=2).collect()
    paths = {r.path: [s.text for s in r.segments if s.text.startswith("m")] for r in got}
    assert paths == {1: ["m1", "m2", "m4"], 2: ["m1", "m3", "m5"]}


@pytest.mark.parametrize("limit", [1 << 24, 300])
def test_decontaminate(spark, limit):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice("abcdef") + str(rng.randint(0, 40)) for _ in range(n))) for i, n in enumerate([12, 30, 10, 4, 25])]
    items += [(7, items[0][1]), (8, None), (9, "!!"), (None, "solo word")]
    docs = [(1, f"x y {items[1][1].upper()} z"), (2, " ".join(items[0][1].split()[1:11]) + " tail"), (3, items[3][1].replace(" ", " --- ")), (4, "SOLO, word solo word"), (5, None), (6, ""), (7, items[2][1][:-3]), (1, "again")]
    got = decontaminate(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), limit=limit).withColumn("n_hit", n_hit()).collect()
    want = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            p = words(x)
            for k in range(len(p) - min(10, len(p)) + 1 if p else 0):
                win = p[k : k + min(10, len(p))]
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit |= set(range(s, s + len(win)))
                        found.add("" if i is None else str(i))
        want.append((d, len(w), len(hit), tuple(sorted(found))))
    assert sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == sorted(want)


def test_best_fit_is_tightest():
    rng = random.Random(5)
    items = sorted(((rng.randint(0, 130), rng.choice("ab"), rng.choice([None, 1, 2, 3])) for _ in range(300)), key=lambda x: -x[0])
    bins = []  # used, sources, clusters; by plain search over all bins

    def slow():
        for i, (size, source, cluster) in enumerate(items):
            piece = start = 0
            while size - start > 100:
                bins.append([100, [], set(), False])
                yield i, len(bins) - 1, piece, start, 0
                piece, start = piece + 1, start + 100
            rest = size - start
            fits = [(100 - b[0], k) for k, b in enumerate(bins) if b[3] and 100 - b[0] >= rest and b[1].count(source) < 2 and cluster not in b[2]]
            k = min(fits)[1] if fits else len(bins)
            if not fits:
                bins.append([0, [], set(), True])
            yield i, k, piece, start, bins[k][0]
            bins[k][0] += rest
            bins[k][1].append(source)
            bins[k][2] |= {cluster} - {None}

    assert best_fit(items, 100, 2) == list(slow())


def test_packing(spark):
    docs = [(i, " ".join(["w"] * (i * 7 % 90)) or None, f"s{i % 3}") for i in range(400)] + [(1, "w " * 7, "s1"), (None, "w " * 5000, None)]
    got = pack_documents(spark.createDataFrame(docs, "doc_id bigint, text string, source string"), capacity=100, per_source=2, shard_rows=100)
    rows = got.collect()
    assert sum(r.n_tokens for r in rows) == sum(len((d[1] or "").split()) for d in docs)
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r.bin, []).append(r)
    for held in by_bin.values():
        assert sum(r.n_tokens for r in held) <= 100
        clusters = [r.cluster for r in held if r.cluster is not None]
        assert len(clusters) == len(set(clusters))
        assert all([r.source for r in held].count(s) <= 2 for s in {r.source for r in held})
    assert pack_documents(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0


def test_packing_deals_copies(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 1)] * 1000 + [(None, None, None, 2)] * 500 + [(i, f"t{i}", "u", 3) for i in range(2, 502)], "doc_id bigint, text string, source string, copies int")
    rows = pack_documents(docs, capacity=100, shard_rows=200).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter([(1, 3)] * 1000 + [(None, 0)] * 500 + [(i, 1) for i in range(2, 502)])
    assert max(Counter(r.shard for r in rows if r.doc_id == 1).values()) < 500
    assert len({r.bin for r in rows if r.doc_id == 1}) == 1000


def test_fixity_audit(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>") for i in range(300)] + [(None, None, None), (7, "http://h/7", "<p>7</p>")], "page_id bigint, url string, html string")
    good = warc_records(pages)
    assert sorted(r.url for r in parse_records(good).collect())[1:] == sorted(r.url for r in pages.collect() if r.url)
    assert fixity_audit(good, good, 3).count() == 0
    bad = good.withColumn("record", F.when(F.col("page_id").isin(5, 250), F.concat("record", F.lit("!"))).otherwise(F.col("record")))
    assert sorted(r.page_id for r in fixity_audit(good, bad, 3).collect()) == [5, 250]
    leaf = leaves(good, 3).withColumn("replica", F.lit("a"))
    lost = audit(leaf.unionByName(leaf.filter("file <> 1").withColumn("replica", F.lit("b"))), 3)
    assert lost.filter("hash_b is null").count() == leaf.filter("file = 1").count() == lost.count()
    assert audit(leaf.limit(0), 3).count() == 0
    # A page that repeats is dealt to several files, and one damaged copy is found.
    copies = warc_records(pages.limit(1).crossJoin(spark.range(5000)).select("page_id", "url", "html"))
    assert leaves(copies, 50).select("file").distinct().count() > 1
    one = spark.createDataFrame([("x",)], "record string").crossJoin(copies.select("page_id", "key").limit(1)).unionByName(copies.limit(4999))
    assert fixity_audit(copies, one, 50).filter("hash_a <> hash_b").count() >= 1
