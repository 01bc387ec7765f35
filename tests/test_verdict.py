"""Verdicts: golden vectors, traps, and the Columns against plain Python."""

import random

import pytest

from tessella.functions.normalize import normalize_text, normalized
from tessella.operators.verdict import Guard, is_rescued, verdict_json

TERMS = [(0, "darn", 2, "prefix", None), (1, "heck", 2, "prefix", None), (2, "blast", 2, "prefix", None), (3, "grit", 3, "word", None), (4, "rude", 3, "word", None), (5, "tolo", 2, "word", ["es", "pt"]), (6, "草", 2, "sub", None), (7, "vilest", 3, "word", None)]
ALLOW = ["darnel", "check", "integrity", "crude", "草原", "blaster", "# note", "heckle"]

# text, surface, locale, action, filtered (None: as it is)
GOLDEN = [
    ("good morning all", "public", "en", "ALLOW", None),
    ("darnel grows here", "public", "en", "ALLOW", None),
    ("please check this", "public", "en", "ALLOW", None),
    ("a matter of integrity", "public", "en", "ALLOW", None),
    ("red arnica", "public", "en", "ALLOW", None),
    ("oh darn it", "public", "en", "MASK", "oh **** it"),
    ("so rude", "public", "en", "BLOCK", None),
    ("d a r n", "public", "en", "MASK", "*******"),
    ("d.a.r.n", "public", "en", "MASK", "*******"),
    ("d-a-r-n", "public", "en", "MASK", "*******"),
    ("daaaarn", "public", "en", "MASK", "*******"),
    ("d4rn", "public", "en", "MASK", "****"),
    ("ｄａｒｎ", "public", "en", "MASK", "****"),
    ("dаrn", "public", "en", "MASK", "****"),
    ("bla st", "public", "en", "MASK", "******"),
    ("dar n", "public", "en", "ALLOW", None),
    ("gri t", "public", "en", "ALLOW", None),
    ("darn", "private", "en", "ALLOW", None),
    ("darn", "identifier", "en", "BLOCK", None),
    ("darn", "unheard of", "en", "MASK", "****"),
    ("tolo", "public", "es", "MASK", "****"),
    ("tolo", "public", "en", "ALLOW", None),
    ("é darn ü", "public", "en", "MASK", "é **** ü"),
    ("草原", "public", "en", "ALLOW", None),
    ("拔草了", "public", "en", "MASK", "拔*了"),
    ("rude!", "public", "en", "ALLOW", None),
    ("gr|it", "public", "en", "ALLOW", None),
    ("", "public", "en", "ALLOW", None),
    ("x" * 20000, "public", "en", "ALLOW", None),
    ("vilist", "public", "en", "BLOCK", None),
    ("cr​ude", "public", "en", "ALLOW", None),
]


@pytest.fixture(scope="module")
def guard(spark):
    terms = spark.createDataFrame(TERMS, "term_ord bigint, text string, tier int, mode string, locales array<string>")
    return Guard(terms, spark.createDataFrame([(w,) for w in ALLOW], "word string"))


def test_golden(spark, guard):
    rows = [(i, g[0], g[1], g[2]) for i, g in enumerate(GOLDEN)]
    got = {r.msg_id: r for r in guard.verdicts(spark.createDataFrame(rows, "msg_id bigint, text string, surface string, locale string")).collect()}
    wrong = [(g, got[i].action, got[i].filtered) for i, g in enumerate(GOLDEN) if got[i].action != g[3] or got[i].filtered != (g[0] if g[4] is None else g[4])]
    assert not wrong
    assert got[1].rescued == ["darnel"]


def test_review_beats_block_and_null_text(spark):
    terms = spark.createDataFrame([(0, "aaab", 1, "word", None), (1, "cccd", 2, "word", None), (2, "eeef", 3, "word", None)], "term_ord bigint, text string, tier int, mode string, locales array<string>")
    policy = spark.createDataFrame([("s", 1, 3, "#"), ("s", 2, 2, "#"), ("s", 3, 1, "#")], "surface string, tier int, action int, mask_char string")
    rows = [(1, "aaab cccd eeef", "s", "en"), (2, None, "s", "en")]
    out = Guard(terms, policy=policy).verdicts(spark.createDataFrame(rows, "msg_id bigint, text string, surface string, locale string"))
    got = {r.msg_id: r for r in out.collect()}
    assert (got[1].action, got[1].filtered) == ("REVIEW", "aaab cccd ####")
    assert got[2].action == "ALLOW" and got[2].filtered is None
    assert '"errorId":3' in {r.msg_id: r.json for r in verdict_json(out).collect()}[1]


def test_normalized_equals_python(spark):
    rng = random.Random(9)
    pool = list("aabbc  .-_|!4$éßﬁ½가각ⅷﾊﾟ​́\t　İΣσаД草") + ["\U0001d400"]
    texts = ["".join(rng.choice(pool) * rng.choice([1, 1, 1, 2, 4]) for _ in range(rng.randint(0, 25))) for _ in range(120)]
    rows = normalized(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).collect()
    for r in rows:
        for form, condense in ((r.boundary, False), (r.evasion, True)):
            text, src = normalize_text(texts[r.i], condense)
            assert (form.text, [(x.s, x.e) for x in form.src]) == (text, src), texts[r.i]


def test_is_rescued(spark):
    rows = [(0, "the crude oil", 5, 9), (1, "crude", 0, 5), (2, "a rude b", 2, 6), (3, "拔草原了", 1, 2), (4, "x", 0, 9), (5, "Crude", 1, 5)]
    words = spark.createDataFrame([("crude",)], "word string")
    phrases = spark.createDataFrame([("草原",)], "phrase string")
    got = {r.key: r.rescued for r in is_rescued(spark.createDataFrame(rows, "key int, text string, start int, end int"), words, phrases).collect()}
    assert got == {0: True, 1: False, 2: False, 3: True, 4: False, 5: True}
