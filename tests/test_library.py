"""Sources, findings, inference, screens, lint and the shadow stream on small inputs."""

import json
import random

from pyspark.sql import functions as F

from tessella.functions.stats import sample_size, wilson
from tessella.functions.text import unwrap, sentences
from tessella.operators import audit, findings, inference, lint, screen
from tessella.operators.match import occurrences
from tessella.operators.verdict import Guard
from tessella.sources import lexicon, logs, sinks
from tessella.streaming import shadow


def words(spark, name, values):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_occurrences_overlap(spark):
    text = "abab" * 200 + "aab"
    terms = words(spark, "term", ["a", "ab", "aba", "abab", "aab", "zz"])
    got = occurrences(spark.createDataFrame([(1, text), (2, None), (3, "")], "key int, text string"), terms).collect()
    want = {(t, i) for t in ["a", "ab", "aba", "abab", "aab"] for i in range(len(text)) if text.startswith(t, i)}
    assert {(r.term, r.start) for r in got} == want and len(got) == len(want)


def test_sources(spark, tmp_path):
    (tmp_path / "terms").write_text('# note\n{"_comment": "x"}\n\n{"text": "DARN"}\n{"text": "tolo", "tier": 3, "mode": "sub", "locales": ["es"]}\n')
    got = lexicon.read_lexicon(spark, str(tmp_path / "terms")).orderBy("term_ord").collect()
    assert [(r.text, r.tier, r.mode, r.locales) for r in got] == [("darn", 2, "word", None), ("tolo", 3, "sub", ["es"])]
    (tmp_path / "allow").write_text("# c\nCheck\n check \n\n")
    assert [r.word for r in lexicon.read_allowlist(spark, str(tmp_path / "allow")).collect()] == ["check"]
    (tmp_path / "policy").write_text('{"public": {"actions": {"MILD": "REVIEW"}, "mask_char": "#"}}')
    got = lexicon.read_policy(spark, str(tmp_path / "policy")).filter("surface = 'public'").collect()
    assert [(r.tier, r.action, r.mask_char) for r in got] == [(1, 3, "#")]
    (tmp_path / "list.json").write_text('["a", "b"]')
    (tmp_path / "list.txt").write_text('a\n# x\n"b"\n{"text": "c"}\n')
    assert sorted(r.word for r in lexicon.read_list(spark, str(tmp_path / "list.json")).collect()) == ["a", "b"]
    assert sorted(r.word for r in lexicon.read_list(spark, str(tmp_path / "list.txt")).collect()) == ["a", "b", "c"]
    (tmp_path / "log").write_text('{"text": "a", "result": "blocked", "t": 5}\nnot json\n{"text": "b", "result": "sent", "phase": "p", "modal": ["x"], "present": true}\n')
    assert [(r.text, r.src_ord) for r in logs.read_probes(spark, str(tmp_path / "log")).orderBy("text").collect()] == [("a", 0), ("b", 0)]
    (tmp_path / "obs").write_text('# c\n{"text": "a", "blocked": true}\n{"text": "b"}\n')
    assert [(r.text, r.blocked) for r in logs.read_observations(spark, str(tmp_path / "obs")).orderBy("text").collect()] == [("a", True), ("b", False)]
    sinks.write_screened(spark.createDataFrame([("a", None), ("b", "bad")], "word string, reason string"), str(tmp_path / "ok"), str(tmp_path / "no"))
    assert [r.value for r in spark.read.text(str(tmp_path / "no")).collect()] == ["b\tbad"]


def test_vote_table(spark):
    table = {"a": (0, 3), "b": (1, 1), "c": (2, 2), "d": (2, 3), "e": (1, 2), "f": (2, 4)}
    rows = [(w, "blocked" if i < nb else "sent") for w, (nb, n) in table.items() for i in range(n)] + [("g", "mismatch"), ("two words", "blocked"), ("a", "mismatch")]
    probes = spark.createDataFrame(rows, "text string, result string")
    got = {r.word: (r.verdict, r.disputed) for r in findings.vote(probes).collect()}
    assert got == {"a": ("sent", None), "b": ("unconfirmed", None), "c": ("blocked", None), "d": ("blocked", "2/3"), "e": ("sent", "1/2"), "f": ("sent", "2/4")}
    assert [r.word for r in findings.untested(probes).collect()] == ["g"]


def test_unwrap_and_stats(spark):
    row = spark.range(1).select(unwrap(F.lit("xxcuxx")).alias("a"), unwrap(F.lit("xxxx")).alias("b"), wilson(F.lit(0), F.lit(0)).alias("z"), wilson(F.lit(6), F.lit(491)).alias("w"), sample_size(F.lit(0.05)).alias("n")).first()
    assert tuple(row.a) == ("cu", True) and tuple(row.b) == ("xxxx", False)
    assert tuple(row.z) == (0.0, 0.0, 0.0) and row.n == 385
    assert abs(row.w.lo - 0.00562) < 1e-4 and abs(row.w.hi - 0.02638) < 1e-4


def test_inference_covers(spark):
    rng = random.Random(7)
    for _ in range(2):
        vocabulary = ["".join(rng.choice("abcde") for _ in range(rng.randint(3, 7))) for _ in range(25)]
        hidden = ["ab", "ce"]
        obs = spark.createDataFrame([(w, any(h in w for h in hidden)) for w in vocabulary], "text string, blocked boolean")
        found = inference.candidates(obs)
        chosen = inference.explanation(found)
        blocked = [w for w in vocabulary if any(h in w for h in hidden)]
        assert inference.unexplained(obs, found).count() == 0
        assert all(any(c in w for c in chosen) for w in blocked)
    odd = spark.createDataFrame([("abc", True), ("xabcx", False)], "text string, blocked boolean")
    assert [r.text for r in inference.unexplained(odd, inference.candidates(odd)).collect()] == ["abc"]


def test_pack_and_read(spark):
    listed = spark.createDataFrame([(i, w) for i, w in enumerate(["an", "bob", "cat", "an", "dove"])], "ord int, word string")
    packs = inference.pack_probes(listed, longest=16)
    got = packs.orderBy("msg_idx").collect()
    assert [r.candidates for r in got] == [["an", "bob"], ["cat"], ["dove"]] and got[0].payload == "qzanjv qzbobjv"
    replies = spark.createDataFrame([(0, "****** qzbobjv"), (1, "REFUSED"), (2, "gone away")], "msg_idx bigint, reply string")
    assert {r.candidate: r.outcome for r in inference.read_replies(packs, replies).collect()} == {"an": "fired", "bob": "clean", "cat": "refused", "dove": "fired"}


def test_screens_and_radius(spark):
    roots = spark.createDataFrame([("ugh", 0), ("bad", 1)], "root string, root_ord int")
    listed = words(spark, "word", ["laugh", "unbadly", "badly", "bad", "fine"])
    assert {r.word: r.root for r in screen.by_containment(listed, roots, words(spark, "word", ["laugh"])).collect()} == {"unbadly": "bad", "badly": "bad", "bad": "bad"}
    pre = spark.createDataFrame([("", 0), ("un", 1)], "prefix string, prefix_ord int")
    suf = spark.createDataFrame([("", 0), ("ly", 1)], "suffix string, suffix_ord int")
    assert {r.word: r.reason for r in screen.by_derivation(listed, roots, pre, suf).collect()} == {"unbadly": "un+bad+ly", "badly": "bad+ly", "bad": "bad"}
    entries = words(spark, "entry", ["ab", "cat", "zebra"])
    radius = audit.blast_radius(entries, words(spark, "word", ["cab", "cat"]), words(spark, "word", ["cats", "table", "crab"]))
    assert {r.entry: (r.own_broken, r.dict_broken, r.example) for r in radius.collect()} == {"ab": (1, 2, "cab"), "cat": (0, 1, "cats"), "zebra": (0, 0, "")}
    advice = audit.recommend(radius, words(spark, "word", ["cab", "cat"]), words(spark, "word", ["cats"]))
    assert {r.entry: r.recommended_action for r in advice.collect()} == {"ab": "SCOPE:zh", "cat": "DELETE", "zebra": "KEEP"}
    grams = screen.phrases(words(spark, "line", ["中文中文 abc", "文中"]))
    assert {r.phrase: r.n for r in grams.collect()} == {"中文": 2, "文中": 2}


def test_lint(spark):
    texts = spark.createDataFrame([("d", "We found 1,234 rows and 3.5 of 99. <b>It</b> is 700.")], "key string, text string")
    assert sorted(r.number for r in lint.numbers(texts).collect()) == [3, 5, 99, 700, 1234]  # the parts of a decimal are two
    evidence = spark.createDataFrame([(1234,)], "number bigint")
    assert [r.number for r in lint.unsupported(lint.numbers(texts), evidence).collect()] == [700]
    said = spark.createDataFrame([("d", "It leverages the thing we have. We do not say never here. " + "word " * 30 + ".\n\nThis stays with us all.\n\nThose are the rules we have.")], "key string, text string")
    assert {r.kind: r.n for r in lint.wording(said, ["leverage"], []).collect()} == {"jargon": 1, "vague": 1, "negation": 1, "long": 1}
    shares = spark.createDataFrame([("d", "<style>p {width: 9.9%}</style>We hold 12.5% and 7.25% of 8%.")], "key string, text string")
    assert [r.percent for r in lint.unsupported_percents(lint.percents(shares), spark.createDataFrame([(7.25,)], "percent double")).collect()] == [12.5]
    prose = spark.createDataFrame([("# A heading over it\nwe walk\nfar away today.\n\n- one two three four\n| a | table |\nFive six seven eight nine!",)], "t string")
    assert prose.select(sentences(F.col("t")).alias("s")).first().s == ["A heading over it we walk far away today", "one two three four", "Five six seven eight nine!"]
    good = spark.createDataFrame([("a", "ALLOW", None), ("b", "MASK", "**")], "id string, action string, filtered string")
    assert lint.conformance(good, good).count() == 0


def test_shadow_stream_equals_batch(spark, tmp_path):
    schema = "msg_id bigint, text string, surface string, locale string, ts double, incumbent_flagged boolean, incumbent_text string"
    rows = [(1, "oh darn", "public", "en", 1.0, False, "oh darn"), (2, "fine", "public", "en", 2.0, True, "****"), (3, "ok", "public", "en", 3.0, False, "ok")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.json(str(tmp_path / "in" / str(i)))
    terms = spark.createDataFrame([(0, "darn", 2, "word", None)], "term_ord bigint, text string, tier int, mode string, locales array<string>")
    guard = Guard(terms)
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in" / "*"))
    shadow.watch(stream, guard.verdicts, str(tmp_path / "ledger"), str(tmp_path / "ck")).awaitTermination(120)
    got = {(r.text, r.kind) for r in spark.read.parquet(str(tmp_path / "ledger")).collect()}
    messages = spark.createDataFrame(rows, schema)
    compared = shadow.compare(messages, guard.verdicts(messages).filter("msg_id <> 3"))
    assert got == {(r.text, r.kind) for r in shadow.ledger(compared).collect()} == {("oh darn", "new_catch"), ("fine", "over_block_fixed")}
    report = shadow.report(compared).first().asDict()
    assert report == {"calls": 2, "agree": 0, "over_block_fixed": 1, "new_catch": 1, "guard_errors": 1, "agreement_pct": 0.0}
    sinks.write_ledger(shadow.ledger(compared), str(tmp_path / "out"), 1)
    assert json.loads(spark.read.text(str(tmp_path / "out")).first().value)["text"] == "fine"


def test_entry(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert names >= set(__spark_entry__.oracle_sql()) and "verdict_public" in names
    assert __spark_entry__.entry(spark).count() > 0
