"""The pipeline's stages against brute force, and what its operators need of executors."""

import os
import subprocess
import sys

import numpy as np

import corpus_pipeline
from tessella.llm.langid import Network
from tessella.llm.license_scan import TEMPLATES, scan_licenses

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(n: int, seed: int) -> list[str]:
    rng = np.random.default_rng(seed)
    return ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(n)]


def repeated(texts: list[str], win: int) -> list[set[int]]:
    """Words of each text in a window that starts anywhere else too."""
    seen: dict[tuple, list] = {}
    for d, t in enumerate(texts):
        w = t.split()
        for i in range(len(w) - win + 1):
            seen.setdefault(tuple(w[i : i + win]), []).append((d, i))
    gone: list[set[int]] = [set() for _ in texts]
    for places in seen.values():
        for d, i in places if len(places) > 1 else ():
            gone[d].update(range(i, i + win))
    return gone


def test_stages(spark, tmp_path):
    shared, leak = words(60, 1), words(12, 2)
    base = [words(120, 10 + i) for i in range(6)]
    texts = [" ".join(b) for b in base]
    texts[1] = " ".join(base[1][:40] + shared + base[1][40:])
    texts[2] = " ".join(base[2][:70] + shared + base[2][70:])
    texts[3] = " ".join(base[3][:50] + leak + base[3][50:])
    rows = [(i, t, "en" if i % 2 else None, "s", len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[0], "en", "s", len(texts[0])), (101, texts[4][:-6] + " other", "en", "t", None), (102, None, "en", None, None), (103, "12 34", None, "s", 5), (104, "", "en", "s", 0), (0, texts[0], None, "s", len(texts[0]))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("b", " ".join(leak)), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)))
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert set(kept["language_id"]) == {0, 1, 2, 3, 4, 5, 100, 101}
    assert all(r.lang for r in kept["language_id"].values())
    assert set(kept["near_duplicates"]) == {0, 1, 2, 3, 4, 5}
    gone = repeated(texts, 35)
    assert {i: r.text for i, r in kept["repeated_passages"].items()} == {i: " ".join(w for j, w in enumerate(t.split()) if j not in gone[i]) for i, t in enumerate(texts)}
    assert set(kept["benchmark_passages"]) == {0, 1, 2, 4, 5}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.n_tokens for r in out} == {i: len(t.split()) - len(gone[i]) for i, t in enumerate(texts) if i != 3}
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_gradients():
    """Backpropagation through time against differences of the loss."""
    rng = np.random.default_rng(4)
    net = Network(["a", "b", "c"])
    x = rng.integers(97, 100, (6, 5)).astype(np.int16)
    x[4:, 0] = 256
    y = rng.integers(0, 3, 5)
    _, grads = net.step(x, y)
    for p, g in zip(net.params(), grads):
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(4)] + [np.unravel_index(np.abs(g).argmax(), g.shape)]:
            old = p[at]
            p[at] = old + 1e-2
            up = net.step(x, y)[0]
            p[at] = old - 1e-2
            down = net.step(x, y)[0]
            p[at] = old
            assert abs((up - down) / 2e-2 - g[at]) < 2e-3


def test_all_licences_of_a_file(spark):
    text = " . ".join(sentence for _, sentence, _ in TEMPLATES)
    docs = spark.createDataFrame([(1, text), (2, text), (2, text), (3, TEMPLATES[5][1]), (4, None)], "doc_id long, text string").selectExpr("*", "'x' as words", "1 as hits")
    for r in scan_licenses(docs).collect():
        want = {1: 8, 2: 8, 3: 1, 4: 0}[r.doc_id]
        assert len({m.label for m in r.matches}) == want


def test_executors_without_the_package(spark, tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from tessella.llm.decontam import decontaminate
from tessella.llm.langid import fit, identify
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.createDataFrame([(i, "one two three four" if i % 2 else "un deux trois quatre", "en" if i % 2 else "fr") for i in range(30)], "doc_id long, text string, lang string")
assert identify(docs, fit(docs, epochs=1)).count() == 30
bench = spark.createDataFrame([("b", "two three")], "item_id string, text string")
assert decontaminate(docs, bench).filter("size(items) > 0").count() == 15
print("fine")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "fine" in got.stdout, got.stderr[-2000:]
