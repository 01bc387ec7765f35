"""The registered queries: each takes a session and a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import normalized, settled
from ..functions.stats import wilson
from ..functions.text import evasions, sentences
from ..functions.tokens import LATIN_DIGITS, LETTERS, tokens
from ..operators import audit, findings, inference, lint, screen
from ..operators.match import occurrences
from ..operators.verdict import Guard
from ..sources.lexicon import action_name
from ..streaming import shadow
from . import fixtures as fx

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def guard(spark: SparkSession) -> Guard:
    return Guard(fx.terms(spark), fx.allow(spark))


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guard(spark).forms(fx.messages(spark, sf_dir))


@query
def normalize_boundary(spark, sf_dir):
    """The boundary form of every message, and the sums of its source places."""
    return with_sums(forms(spark, sf_dir), "boundary")


@query
def normalize_condense(spark, sf_dir):
    """The evasion form of every message, and the sums of its source places."""
    return with_sums(forms(spark, sf_dir), "evasion")


def with_sums(df: DataFrame, form: str) -> DataFrame:
    total = lambda c: F.aggregate(f"{form}.src", F.lit(0).cast("long"), lambda acc, x: acc + x[c])
    return df.select("msg_id", F.col(f"{form}.text").alias("form"), total("s").alias("starts"), total("e").alias("ends"))


@query
def fold_leet(spark, sf_dir):
    """Words of part and nation names with digits and signs for letters, folded back."""
    names = fx.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).unionByName(fx.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))).distinct()
    hidden = names.select("name", evasions(F.lower("name"))["leet"].alias("text"))
    return normalized(hidden).select("name", "text", F.col("boundary.text").alias("form"))


@query
def tokenize_guard(spark, sf_dir):
    """Tokens of the boundary form and how often each occurs."""
    found = guard(spark).tokens(forms(spark, sf_dir))
    return found.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("start").cast("long")).alias("starts"))


@query
def match_all_hits(spark, sf_dir):
    """All overlapping occurrences of all terms in the boundary form."""
    g = guard(spark)
    found = occurrences(forms(spark, sf_dir).select("msg_id", F.col("boundary.text").alias("text")), g.terms)
    return found.select("msg_id", "term", "start", "end")


def boundary_hits(spark, sf_dir, mode: str) -> DataFrame:
    g = guard(spark)
    return g.boundary_hits(forms(spark, sf_dir)).filter(F.col("mode") == mode).select("msg_id", "term", "o_start", "o_end")


@query
def match_word(spark, sf_dir):
    return boundary_hits(spark, sf_dir, "word")


@query
def match_prefix(spark, sf_dir):
    return boundary_hits(spark, sf_dir, "prefix")


@query
def match_sub(spark, sf_dir):
    return boundary_hits(spark, sf_dir, "sub")


def staged(spark, sf_dir):
    g = guard(spark)
    return g, g.forms(fx.messages(spark, sf_dir))


@query
def match_locale(spark, sf_dir):
    """Live candidates: of the message's locale, the first of each span and term."""
    g, f = staged(spark, sf_dir)
    return g.live(f).select("msg_id", "pass_ord", "term", "tier", "o_start", "o_end")


@query
def evasion_hits(spark, sf_dir):
    g, f = staged(spark, sf_dir)
    return g.evasion_hits(f).select("msg_id", "term", "o_start", "o_end")


@query
def fuzzy_hits(spark, sf_dir):
    g, f = staged(spark, sf_dir)
    return g.fuzzy_hits(g.words(f)).select("msg_id", "token", "term", "o_start", "o_end")


@query
def phrase_shelter(spark, sf_dir):
    """Allowed words and phrases in the boundary form, in original places."""
    g, f = staged(spark, sf_dir)
    return g.shelters(f).select("msg_id", "phrase", "p_start", "p_end")


@query
def token_rescue(spark, sf_dir):
    """Hits that something allowed shelters, and by what."""
    g, f = staged(spark, sf_dir)
    return g.rescued(f)


def verdict(spark, sf_dir, surface: str) -> DataFrame:
    out = guard(spark).verdicts(fx.messages(spark, sf_dir, surface))
    shown = F.transform("hits", lambda h: F.concat_ws(":", h["start"], h["end"], h["term"], h["tier"], action_name(h["action"])))
    return out.select("msg_id", "action", "error_id", "filtered", F.array_join(shown, ",").alias("hits"), F.array_join("rescued", ",").alias("rescued"))


@query
def verdict_public(spark, sf_dir):
    return verdict(spark, sf_dir, "public")


@query
def verdict_private(spark, sf_dir):
    return verdict(spark, sf_dir, "private")


@query
def verdict_identifier(spark, sf_dir):
    return verdict(spark, sf_dir, "identifier")


@query
def mask_text(spark, sf_dir):
    """Masked texts and how many characters the mask covers."""
    out = guard(spark).verdicts(fx.messages(spark, sf_dir)).filter("error_id = 1")
    return out.select("msg_id", "filtered", (F.length("filtered") - F.length(F.replace("filtered", F.lit("*"), F.lit("")))).cast("long").alias("stars"))


@query
def baseline_substring(spark, sf_dir):
    """Entries that occur anywhere in a line."""
    return audit.substring_hits(fx.lines(spark, sf_dir), fx.entries(spark))


@query
def baseline_wholeword(spark, sf_dir):
    """Entries that are words of a line."""
    return audit.word_hits(fx.lines(spark, sf_dir), fx.entries(spark), LATIN_DIGITS)


@query
def length_rule_sweep(spark, sf_dir):
    return audit.length_rule_sweep(fx.lines(spark, sf_dir), fx.entries(spark), 6)


@query
def term_length_hist(spark, sf_dir):
    return audit.length_histogram(fx.dictionary(spark, sf_dir).select(F.col("word").alias("entry")))


def radius(spark, sf_dir) -> DataFrame:
    return audit.blast_radius(fx.entries(spark), fx.own_words(spark, sf_dir), fx.dictionary(spark, sf_dir))


def advice(spark, sf_dir) -> DataFrame:
    return audit.recommend(radius(spark, sf_dir), fx.own_words(spark, sf_dir), fx.dictionary(spark, sf_dir))


@query
def blast_radius(spark, sf_dir):
    return radius(spark, sf_dir)


@query
def recommend_action(spark, sf_dir):
    return advice(spark, sf_dir).select("entry", "blast_radius", "recommended_action", "rationale")


@query
def pareto_share(spark, sf_dir):
    return audit.pareto(radius(spark, sf_dir))


@query
def simulate_fixes(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_id"), F.lit("part").alias("label"), F.col("p_name").alias("line"))
    return audit.simulate(lines, advice(spark, sf_dir))


@query
def longest_offender(spark, sf_dir):
    return audit.longest_offender(fx.dictionary(spark, sf_dir), fx.entries(spark))


@query
def offender_counts(spark, sf_dir):
    found = audit.longest_offender(fx.dictionary(spark, sf_dir), fx.entries(spark))
    return audit.offender_counts(found).select("entry", "n", F.array_join("examples", ",").alias("examples"))


@query
def over_block_matrix(spark, sf_dir):
    lines = fx.lines(spark, sf_dir)
    return audit.over_block(lines, engines(spark, lines, fx.entries(spark)))


def engines(spark, lines: DataFrame, entries: DataFrame) -> dict[str, DataFrame]:
    """What four filters flag: two plain ones, a guard that knows the entries, and the guard."""
    same = audit.same_vocabulary(entries, fx.allow(spark))
    return {"substring": audit.substring_hits(lines, entries), "word": audit.word_hits(lines, entries), "guard, same list": audit.guard_hits(lines, same), "guard": audit.guard_hits(lines, guard(spark))}


def long_terms(spark) -> DataFrame:
    return fx.terms(spark).select(F.col("text").alias("term"))


@query
def evasion_generate(spark, sf_dir):
    """All disguises of the words of part names."""
    words = fx.own_words(spark, sf_dir).select(F.col("word").alias("term"))
    return audit.evasion_corpus(words).select("term", "variant", "line")


@query
def under_block_rollup(spark, sf_dir):
    """How many disguised words of part names plain substring and word filters catch."""
    words = fx.own_words(spark, sf_dir)
    corpus = audit.evasion_corpus(words.select(F.col("word").alias("term")))
    entries = words.select(F.col("word").alias("entry"))
    return audit.under_block(corpus, engines(spark, corpus, entries)).select("engine", F.coalesce("variant", F.lit("ALL")).alias("variant"), "lines", "flagged", "pct")


@query
def selftest_gate(spark, sf_dir):
    """Authored part names that the list flags, and the first entry that does."""
    lines = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_id"), F.col("p_name").alias("line"))
    return audit.self_test(lines, fx.entries(spark)).select("line_id", "entry")


def votes(spark, sf_dir) -> DataFrame:
    return findings.vote(fx.probes(spark, sf_dir))


@query
def probe_vote(spark, sf_dir):
    return votes(spark, sf_dir)


@query
def probe_untested(spark, sf_dir):
    """Words that only mismatched; some are probed by errors only."""
    return findings.untested(fx.probes(spark, sf_dir, lone_errors=True))


@query
def fragment_candidates(spark, sf_dir):
    return findings.fragments(votes(spark, sf_dir), findings.lexicon_words(fx.probes(spark, sf_dir)))


def rules(spark, sf_dir) -> DataFrame:
    return findings.minimal(findings.fragments(votes(spark, sf_dir), findings.lexicon_words(fx.probes(spark, sf_dir))))


@query
def fragment_minimal(spark, sf_dir):
    return rules(spark, sf_dir)


@query
def probe_classify(spark, sf_dir):
    attested = fx.column(spark, "word", fx.WORDS[:20])
    return findings.classify(votes(spark, sf_dir), rules(spark, sf_dir), findings.lexicon_words(fx.probes(spark, sf_dir)), attested)


@query
def attribution_shortest(spark, sf_dir):
    """Dictionary words and the shortest entry strictly inside them; null for none."""
    return findings.attribute(fx.dictionary(spark, sf_dir), fx.entries(spark).select(F.col("entry").alias("fragment")))


@query
def attribution_measured(spark, sf_dir):
    return findings.measured(attribution_shortest(spark, sf_dir))


def reached(spark, sf_dir) -> DataFrame:
    return findings.reach(fx.entries(spark).select(F.col("entry").alias("rule")), fx.dictionary(spark, sf_dir))


@query
def reach_union(spark, sf_dir):
    return findings.reach_summary(reached(spark, sf_dir))


@query
def reach_by_length(spark, sf_dir):
    return findings.reach_by_length(reached(spark, sf_dir))


@query
def reach_first_rule(spark, sf_dir):
    return findings.first_rule(reached(spark, sf_dir))


@query
def topk_others(spark, sf_dir):
    return findings.top_and_others(reached(spark, sf_dir))


@query
def locale_block_rate(spark, sf_dir):
    languages = fx.local(spark, fx.LANGUAGES, tag=fx.TEXT, language=fx.TEXT)
    return findings.refusal_by_language(fx.probes(spark, sf_dir), votes(spark, sf_dir), languages)


@query
def inflection_member(spark, sf_dir):
    words = fx.dictionary(spark, sf_dir)
    attested = fx.table(spark, sf_dir, "benchmark").select(F.explode(tokens(F.lower("text"), LETTERS)).alias("word"))
    return findings.vocabulary(words, attested)


def observations(spark, sf_dir) -> DataFrame:
    """Words of part names, blocked if they hold one of two hidden fragments."""
    return fx.own_words(spark, sf_dir).select(F.col("word").alias("text"), (F.col("word").contains("et") | F.col("word").contains("ot")).alias("blocked"))


@query
def candidate_elimination(spark, sf_dir):
    return inference.candidates(observations(spark, sf_dir))


@query
def candidate_report(spark, sf_dir):
    found = inference.report(inference.candidates(observations(spark, sf_dir)))
    return found.select("text", "n", F.array_join("shortest", ",").alias("shortest"))


@query
def hitting_set(spark, sf_dir):
    """The terms that a greedy search infers, in order."""
    chosen = inference.explanation(inference.candidates(observations(spark, sf_dir)))
    return fx.local(spark, list(enumerate(chosen)), step=fx.INT, candidate=fx.TEXT)


@query
def probe_design(spark, sf_dir):
    return inference.design(inference.candidates(observations(spark, sf_dir)))


def plan(spark, sf_dir) -> DataFrame:
    words = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("word"))
    return inference.pack_probes(words)


@query
def probe_pack(spark, sf_dir):
    return plan(spark, sf_dir).select("msg_idx", "payload", F.array_join("candidates", ",").alias("candidates"))


@query
def probe_read(spark, sf_dir):
    """Outcomes of the packed probes where every reply masks the letters 'an'."""
    packs = plan(spark, sf_dir)
    return inference.read_replies(packs, packs.select("msg_idx", F.replace("payload", F.lit("an"), F.lit("**")).alias("reply")))


@query
def stratified_sample(spark, sf_dir):
    words = fx.table(spark, sf_dir, "documents").select(F.col("lang").alias("stratum"), F.explode(tokens(F.lower("text"), LETTERS)).alias("word"))
    return inference.stratified_sample(words, {"en": 40, "de": 20, "fr": 20, "es": 10}).select("stratum", "word", "turn")


@query
def resume_anti_join(spark, sf_dir):
    """Part names that no probe has said yet."""
    queue = fx.own_words(spark, sf_dir).select(F.col("word").alias("text"))
    return inference.waiting(queue, fx.probes(spark, sf_dir).unionByName(fx.table(spark, sf_dir, "part").select(F.element_at(tokens(F.lower("p_name"), LETTERS), 1).alias("text"), *(F.lit(None).cast(t).alias(c) for c, t in (("result", "string"), ("tag", "string"), ("t", "bigint"), ("phase", "string"), ("src_ord", "int"))))))


@query
def wilson_by_stratum(spark, sf_dir):
    """Share of toxic documents by source, with its interval."""
    rows = fx.table(spark, sf_dir, "labels").join(fx.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    out = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("toxic").cast("long")).alias("k")).withColumn("w", wilson(F.col("k"), F.col("n")))
    return out.select("source", "n", "k", *(F.round(f"w.{c}", 6).alias(c) for c in ("p", "lo", "hi")))


def battery(spark, sf_dir) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("stratum"), F.when(F.pmod("user_id", F.lit(2)) == 0, "pass").otherwise("block").alias("expected"), F.when(F.col("value") < 20, "pass").when(F.col("value") < 60, " Block").alias("result"))


@query
def battery_score(spark, sf_dir):
    return lint.score_battery(battery(spark, sf_dir))


@query
def control_warnings(spark, sf_dir):
    return lint.control_warnings(battery(spark, sf_dir), "view", "click")


@query
def ngram_phrases(spark, sf_dir):
    """Runs of two to four letters that occur again, in part names."""
    lines = fx.table(spark, sf_dir, "part").select(F.col("p_name").alias("line"))
    return screen.phrases(lines, pattern=LETTERS)


@query
def derivation_screen(spark, sf_dir):
    return screen.by_derivation(fx.dictionary(spark, sf_dir), fx.numbered(spark, "root", fx.ROOTS), fx.numbered(spark, "prefix", fx.PREFIXES), fx.numbered(spark, "suffix", fx.SUFFIXES))


@query
def containment_screen(spark, sf_dir):
    return screen.by_containment(fx.dictionary(spark, sf_dir), fx.numbered(spark, "root", fx.ROOTS), fx.column(spark, "word", fx.EXCEPTIONS))


@query
def affix_screen(spark, sf_dir):
    terms = fx.column(spark, "term", ["the", "on", "der", "thing"])
    return screen.by_affix(fx.dictionary(spark, sf_dir), terms, ["un", "en"], ["s", "ing", "en"])


@query
def allowlist_screen(spark, sf_dir):
    """Words of all texts with the reason, if any, that keeps them off the allowlist."""
    words = fx.dictionary(spark, sf_dir)
    held = screen.by_containment(words, fx.numbered(spark, "root", fx.ROOTS)).select("word", F.concat(F.lit("holds "), "root").alias("reason"))
    made = screen.by_affix(words, fx.column(spark, "term", ["the", "on", "der"]), ["un", "en"], ["s", "ing", "en"]).select("word", F.concat(F.lit("made of "), "term").alias("reason"))
    return screen.screened(words, held, made)


@query
def allowlist_sources(spark, sf_dir):
    lines = fx.table(spark, sf_dir, "documents").select(F.col("lang").alias("label"), F.col("text").alias("line"))
    return screen.source_counts(screen.collect_words(lines))


def compared(spark, sf_dir) -> DataFrame:
    """The guard beside a substring filter over the entries."""
    messages = fx.messages(spark, sf_dir)
    hits = occurrences(messages.select("msg_id", F.lower("text").alias("text")), fx.entries(spark).filter(F.length("entry") >= 4).select(F.col("entry").alias("term"))).select("msg_id").distinct().withColumn("hit", F.lit(True))
    old = messages.join(hits, "msg_id", "left").select("msg_id", "text", "surface", "locale", F.abs("msg_id").cast("double").alias("ts"), F.coalesce("hit", F.lit(False)).alias("incumbent_flagged"), F.col("text").alias("incumbent_text"))
    return shadow.compare(old, guard(spark).verdicts(messages))


@query
def shadow_compare(spark, sf_dir):
    return shadow.ledger(compared(spark, sf_dir)).select("kind", "text", "locale", "incumbent_flagged", "guard_flagged", "guard_action", "ts")


@query
def shadow_report(spark, sf_dir):
    return shadow.report(compared(spark, sf_dir))


@query
def html_strip_numbers(spark, sf_dir):
    """Whole numbers of three digits or more in pages that page ids don't support."""
    pages = fx.table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), "html")
    found = lint.numbers(pages, "key", "html")
    return lint.unsupported(found, pages.select(F.col("key").alias("number")))


@query
def percent_evidence(spark, sf_dir):
    """Percentages in wordings of market shares that the order totals don't support."""
    nations = fx.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.concat(F.lit("<style>p {width: 12.5%}</style><p>"), "n_name", F.lit(" holds "), (F.col("n_nationkey") * 1.5).cast("string"), F.lit("% of 1,250 parts.</p>")).alias("text"))
    evidence = fx.table(spark, sf_dir, "region").select((F.col("r_regionkey") * 3.0).alias("percent"))
    return lint.unsupported_percents(lint.percents(nations), evidence)


@query
def blocked_and_clean(spark, sf_dir):
    """How many messages of each locale the guard blocks, flags and lets pass."""
    messages = fx.messages(spark, sf_dir)
    out = guard(spark).verdicts(messages).join(messages.select("msg_id", "locale"), "msg_id")
    return out.groupBy("locale").agg(F.count_if("blocked").alias("blocked"), F.count_if("clean").alias("clean"), F.count_if(F.col("error_id") > 0).alias("flagged"))


@query
def sentence_lint(spark, sf_dir):
    """Sentences of four words or more in documents, and how many are too long."""
    said = settled(fx.table(spark, sf_dir, "documents").select("doc_id", "text"), s=sentences(F.col("text")))
    long = F.filter("s", lambda x: F.size(F.split(x, " ")) > lint.MAX_WORDS)
    return said.select("doc_id", F.size("s").cast("long").alias("sentences"), F.size(long).cast("long").alias("long"))
