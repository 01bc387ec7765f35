"""From messages to verdicts.

Candidates come from the boundary form (bounds kept), the evasion form (if the
original characters show obfuscation) and near misses of severe terms. Locale, the
first candidate of a span, shelter by allowed phrases and words, and the surface's
policy then decide. Messages are normalized and searched in narrow stages that carry
what later steps ask of the message; only hits are shuffled, by message and block of
the message, and decided there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import SEPARATORS, SPACES, characters, normalized, ranges, settled, span, term_form
from ..functions.tokens import GUARD, with_token_spans
from ..sources.lexicon import action_name, default_policy, without_terms
from .match import PART, at_boundary, dealt, fuzzy, in_locale, occurrences, row_bytes

GAP = ranges(sorted(set(SEPARATORS) | set(SPACES)))
# Fixed value: from this length on, one separator inside a term counts as evasion.
SPLIT_LENGTH = 5
#: Characters of a message whose hits are decided together.
BLOCK = 1024

KEY = ("o_start", "o_end", "term")
#: A hit, in the order in which one span's hits are taken.
FIELDS = (*KEY, "pass_ord", "scan", "term_ord", "tier")


def compiled(df: DataFrame, limit: int = PART) -> DataFrame:
    """A list of at most `limit` bytes as a literal relation, whose size the optimizer
    knows; a larger one as it is."""
    size = df.agg(F.sum(row_bytes(df)).alias("n")).first().n or 0
    return df.sparkSession.createDataFrame(df.toArrow()) if size <= limit else df


def shows_evasion(text: Column, start: Column, end: Column, term: Column) -> Column:
    """Whether the original characters look like a disguise: longer than the term, and
    without separators, or with pieces of at most two, or one split of a long term."""
    chars = F.substring(text, start + 1, end - start)
    pieces = F.split(chars, GAP + "+", -1)
    short = F.forall(pieces, lambda p: F.length(p) <= 2)
    split = (F.length(term) >= SPLIT_LENGTH) & (F.size(pieces) == 2)
    return (F.length(chars) > F.length(term)) & (~chars.rlike(GAP) | short | split)


def bounded() -> Column:
    """Of a hit in the boundary form: whether it has the bounds that it needs."""
    return at_boundary(F.col("mode"), F.col("left"), F.col("right"))


def disguised() -> Column:
    """Of a hit in the evasion form: whether the original shows why it is one."""
    return shows_evasion(F.col("text"), F.col("o_start"), F.col("o_end"), F.col("term"))


class Guard:
    """A lexicon compiled for matching. terms: term_ord, text, tier, mode, locales;
    allow: word; policy: surface, tier, action, mask_char."""

    def __init__(self, terms: DataFrame, allow: DataFrame | None = None, policy: DataFrame | None = None, fuzzy_tiers: tuple[int, ...] = (3, 4), fuzzy_length: int = 5, fold_allow: bool = False):
        self.spark = terms.sparkSession
        self.terms = compiled(term_form(terms).select("term_ord", "term", "tier", "mode", "locales"))
        allow = allow if allow is not None else self.spark.createDataFrame([], "word string")
        allow = allow.select(F.lower(F.trim("word")).alias("word")).filter("word <> '' and not startswith(word, '#')")
        if fold_allow:
            allow = term_form(allow, "word", "folded").select(F.col("folded").alias("word"))
        self.allow = compiled(without_terms(allow.distinct(), self.terms))
        self.longest = self.allow.agg(F.max(F.length("word")).alias("n")).first().n or 0
        self.policy = compiled(policy if policy is not None else default_policy(self.spark))
        self.fuzzy_tiers, self.fuzzy_length = fuzzy_tiers, fuzzy_length

    def forms(self, messages: DataFrame) -> DataFrame:
        """messages: msg_id, text, surface, locale. Adds the forms, `flat` (the folded text)
        and `tokens` (token, o_start, o_end)."""
        df = normalized(dealt(messages.select("msg_id", "text", "surface", "locale")), keep_folded=True)
        df = with_token_spans(df, "folded", "_tokens")
        source = lambda j: F.coalesce(F.get("source", j), j)
        placed = F.transform("_tokens", lambda t: F.struct(t["token"].alias("token"), source(t["start"]).alias("o_start"), (source(t["end"] - 1) + 1).alias("o_end")))
        return settled(df, tokens=placed, even=F.col("source").isNull()).drop("_tokens", "folded", "source")

    def tokens(self, forms: DataFrame) -> DataFrame:
        """msg_id, token, start: the tokens of the boundary form, in its places."""
        chars = settled(forms, chars=characters(F.col("boundary.text"))).select("msg_id", "chars")
        return with_token_spans(chars, "chars", "t").select("msg_id", F.explode("t").alias("t")).select("msg_id", "t.token", "t.start")

    def words(self, forms: DataFrame) -> DataFrame:
        """msg_id, surface, locale, tok_ord, token, o_start, o_end."""
        return forms.select("msg_id", "surface", "locale", F.posexplode("tokens").alias("tok_ord", "t")).select("msg_id", "surface", "locale", "tok_ord", "t.*")

    def _found(self, forms: DataFrame, terms: DataFrame, *views: str) -> DataFrame:
        """Occurrences in the forms named, with pass_ord (0 for the boundary form, 1 for the
        evasion form), the original span, scan (their place in a scan that finds by end,
        and longer ones first) and what forms tells of the message."""
        carried = ("msg_id", "surface", "locale", "text", "flat", "even", F.when(~F.col("even"), F.col("tokens")).alias("odd_tokens"))
        view = [F.struct(F.lit(int(v == "evasion")).alias("pass_ord"), F.col(f"{v}.src").alias("_src"), F.col(f"{v}.text").alias("_form")) for v in views]
        hits = occurrences(forms.select(*carried, F.inline(F.array(*view))), terms, text="_form", deal=False)
        hits = settled(hits, _o=span(F.col("_src"), F.col("start"), F.col("end")))
        scan = F.struct(F.col("end").alias("a"), F.col("start").alias("b"))
        return hits.withColumn("o_start", F.col("_o.s")).withColumn("o_end", F.col("_o.e")).withColumn("scan", scan).drop("_src", "_o")

    def boundary_hits(self, forms: DataFrame) -> DataFrame:
        return self._found(forms, self.terms, "boundary").filter(bounded())

    def evasion_hits(self, forms: DataFrame) -> DataFrame:
        return self._found(forms, self.terms, "evasion").filter(disguised())

    def near_words(self, words: DataFrame) -> DataFrame:
        """words one edit away from severe terms; a word may have several."""
        core = self.terms.filter(F.col("tier").isin(*self.fuzzy_tiers) & (F.length("term") >= self.fuzzy_length))
        return fuzzy(words.filter(F.length("token") >= self.fuzzy_length), core).join(self.allow, F.col("token") == F.col("word"), "left_anti")

    def fuzzy_hits(self, words: DataFrame) -> DataFrame:
        """Of each word, the first term that it is near."""
        near = self.near_words(words)
        first = near.groupBy("msg_id", "tok_ord").agg(F.min_by(F.struct(*(c for c in near.columns if c not in ("msg_id", "tok_ord"))), "term_ord").alias("x"))
        return first.select("msg_id", "tok_ord", "x.*")

    def host(self) -> Column:
        """The token around a hit; null if it can't be an allowed word. In even texts places
        of characters and of what they become are the same, so it is read off there."""
        if not self.longest:
            return F.lit(None).cast("string")
        start, end, most = F.col("o_start"), F.col("o_end"), F.lit(self.longest)
        before = F.substring("flat", F.greatest(start - most, F.lit(0)) + 1, F.least(start, most))
        inner = F.substring("flat", start + 1, end - start)
        around = F.concat(F.regexp_extract(before, f"({GUARD[:-1]}*)$", 1), inner, F.regexp_extract(F.substring("flat", end + 1, most), f"^({GUARD[:-1]}*)", 1))
        odd = F.get(F.filter("odd_tokens", lambda t: (t["o_start"] <= start) & (end <= t["o_end"])), F.lit(0))["token"]
        return F.when(~F.col("even"), odd).when(inner.rlike(f"^{GUARD}$"), around)

    def searched(self, forms: DataFrame) -> DataFrame:
        """Candidates and shelters from one search of both forms, and from near misses:
        msg_id, surface, hit and shelter, one of which is null."""
        terms = self.terms.withColumn("allowed", F.lit(False))
        phrases = self.allow.select(F.lit(None).cast("bigint").alias("term_ord"), F.col("word").alias("term"), F.lit(None).cast("int").alias("tier"), F.lit("sub").alias("mode"), F.lit(None).cast("array<string>").alias("locales"), F.lit(True).alias("allowed"))
        found = self._found(forms, terms.unionByName(phrases), "boundary", "evasion")
        shelters = F.col("allowed") & (F.col("pass_ord") == 0)
        found = found.filter(shelters | (~F.col("allowed") & (((F.col("pass_ord") == 0) & bounded()) | ((F.col("pass_ord") == 1) & disguised()))))
        found = found.withColumn("host", F.when(~F.col("allowed"), self.host()))
        near = self.near_words(self.words(forms)).withColumn("pass_ord", F.lit(2)).withColumn("scan", F.struct(F.col("tok_ord").alias("a"), F.lit(0).alias("b")))
        near = near.withColumn("allowed", F.lit(False)).withColumn("host", F.lit(None).cast("string"))
        here = in_locale(F.col("locales"), F.col("locale")).alias("here")
        columns = ("msg_id", "surface", "pass_ord", "scan", "term_ord", "o_start", "o_end", "term", "tier", "allowed", "host")
        every = found.select(*columns, here).unionByName(near.select(*columns, here))
        known = self.allow.select(F.col("word").alias("host"), F.lit(True).alias("_known"))
        every = every.join(known, "host", "left").withColumn("host", F.when(F.col("_known") & (F.col("host") != F.col("term")), F.col("host")))
        hit = F.struct(*FIELDS, "here", "host")
        phrase = F.struct((F.col("o_start") - F.col("o_end")).alias("n"), F.col("scan").alias("p_scan"), F.col("term").alias("phrase"), F.col("o_start").alias("p_start"), F.col("o_end").alias("p_end"))
        return every.select("msg_id", "surface", F.when(~F.col("allowed"), hit).alias("hit"), F.when(F.col("allowed"), phrase).alias("shelter"))

    def shelters(self, forms: DataFrame) -> DataFrame:
        """Allowed phrases in the boundary form: msg_id, phrase, p_start, p_end."""
        found = self._found(forms, self.allow.select(F.col("word").alias("term")), "boundary")
        return found.select("msg_id", F.col("term").alias("phrase"), F.col("o_start").alias("p_start"), F.col("o_end").alias("p_end"))

    def resolved(self, forms: DataFrame) -> DataFrame:
        """Candidates of the message's locale, the first of each span and term: msg_id,
        surface, pass_ord, scan, term_ord, o_start, o_end, term, tier, and by: the longest
        allowed phrase around it that is longer, or else the allowed word, or null. Hits
        and phrases meet by message and block, phrases in every block that they touch."""
        of = lambda c: F.floor(c / BLOCK)
        first, last = F.coalesce("hit.o_start", "shelter.p_start"), F.coalesce(F.col("hit.o_start"), F.greatest("shelter.p_end", F.col("shelter.p_start") + 1) - 1)
        met = self.searched(forms).withColumn("block", F.explode(F.sequence(of(first), of(last)))).groupBy("msg_id", "block")
        rows = met.agg(F.first("surface", ignorenulls=True).alias("surface"), F.array_sort(F.collect_list("hit")).alias("hits"), F.array_sort(F.collect_list("shelter")).alias("shelters")).filter(F.size("hits") > 0)
        near = F.filter("hits", lambda x: x["pass_ord"] == 2)
        earlier = lambda x: F.exists("_near", lambda y: (y["scan"] == x["scan"]) & (y["term_ord"] < x["term_ord"]))
        rows = settled(settled(rows, _near=near), _mine=F.filter("hits", lambda x: x["here"] & ~((x["pass_ord"] == 2) & earlier(x))))
        again = lambda x, y: F.coalesce((x["o_start"] == y["o_start"]) & (x["o_end"] == y["o_end"]) & (x["term"] == y["term"]), F.lit(False))
        live = rows.select("msg_id", "surface", "shelters", F.explode(F.filter("_mine", lambda x, i: ~again(x, F.get("_mine", i - 1)))).alias("x"))
        x = F.col("x")
        around = F.filter("shelters", lambda p: (p["p_start"] <= x["o_start"]) & (x["o_end"] <= p["p_end"]) & (-p["n"] > x["o_end"] - x["o_start"]) & (p["phrase"] != x["term"]))
        by = F.coalesce(F.get(around, F.lit(0))["phrase"], x["host"])
        return settled(live, by=by).select("msg_id", "surface", *(x[c].alias(c) for c in FIELDS), "by")

    def live(self, forms: DataFrame) -> DataFrame:
        return self.resolved(forms).drop("by")

    def rescued(self, forms: DataFrame) -> DataFrame:
        """Hits that something allowed shelters: msg_id, o_start, o_end, term, by."""
        return self.resolved(forms).filter("by is not null").select("msg_id", *KEY, "by")

    def verdicts(self, messages: DataFrame) -> DataFrame:
        """One row per message: msg_id, text, action (a name), error_id, filtered, hits
        (array<struct<start, end, term, tier, action>> in order of the scan), rescued
        (sorted), blocked, clean. msg_id is unique; a null text is allowed and stays
        null; an unknown surface has the built-in public policy; a tier without an action
        is allowed; null locales match terms for all locales only."""
        found = self.resolved(self.forms(messages))
        known = self.policy.select("surface").distinct().withColumn("known", F.lit(True))
        public = default_policy(self.spark).filter("surface = 'public'").select(F.lit("\0").alias("surface"), "tier", "action", "mask_char")
        policy = self.policy.unionByName(public)
        where = F.when(F.col("known"), F.col("surface")).otherwise(F.lit("\0"))
        acted = found.join(known, "surface", "left").withColumn("surface", where).drop("known").join(policy, ["surface", "tier"], "left")
        free = F.col("by").isNull()
        counts = free & (F.col("action") != 0)
        hit = F.struct("pass_ord", "scan", "term_ord", F.col("o_start").alias("start"), F.col("o_end").alias("end"), "term", "tier", "action")
        by_msg = acted.groupBy("msg_id").agg(F.max(F.when(free, F.col("action"))).alias("worst"), F.array_sort(F.collect_list(F.when(counts, hit))).alias("hits"), F.max(F.when(counts, F.col("mask_char"))).alias("mask_char"), F.array_sort(F.collect_set("by")).alias("rescued"))
        by_msg = by_msg.withColumn("hits", F.transform("hits", lambda h: F.struct(*(h[c].alias(c) for c in ("start", "end", "term", "tier", "action")))))
        out = messages.select("msg_id", "text").join(by_msg, "msg_id", "left")
        worst = F.coalesce("worst", F.lit(0))
        none = F.expr("cast(array() as array<struct<start:int,end:int,term:string,tier:int,action:int>>)")
        hits = F.coalesce("hits", none)
        return out.select("msg_id", "text", action_name(worst).alias("action"), worst.alias("error_id"), F.when(worst.isin(0, 2), F.col("text")).otherwise(masked(F.col("text"), hits, F.col("mask_char"))).alias("filtered"), hits.alias("hits"), F.coalesce("rescued", F.array().cast("array<string>")).alias("rescued"), (worst == 2).alias("blocked"), (worst == 0).alias("clean"))

    def check(self, messages: DataFrame) -> DataFrame:
        return self.verdicts(messages).select("msg_id", (F.col("error_id") > 0).alias("flagged"))


def masked(text: Column, hits: Column, mask: Column) -> Column:
    """text with every character of a hit whose action is mask replaced by the first
    character of mask."""
    spans = F.array_sort(F.transform(F.filter(hits, lambda h: h["action"] == 1), lambda h: F.struct(h["start"].alias("s"), h["end"].alias("e"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s, e = F.greatest(acc["at"], x["s"]), F.greatest(acc["at"], x["e"])
        clear = F.substring(text, acc["at"] + 1, s - acc["at"])
        return F.struct(e.alias("at"), F.concat(acc["out"], clear, F.repeat(F.substring(mask, 1, 1), e - s)).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def verdict_json(verdict: DataFrame) -> DataFrame:
    """msg_id and the verdict as JSON: filtered_word, action, errorId, hits, rescued."""
    hits = F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["tier"].alias("tier"), action_name(h["action"]).alias("action")))
    return verdict.select("msg_id", F.to_json(F.struct(F.col("filtered").alias("filtered_word"), "action", F.col("error_id").alias("errorId"), hits.alias("hits"), "rescued"), {"ignoreNullFields": "false"}).alias("json"))


def is_rescued(spans: DataFrame, words: DataFrame, phrases: DataFrame) -> DataFrame:
    """spans: key, text, start, end. Adds rescued: whether the span lies in an allowed word
    (compared in lower case) or phrase (as it is written) that is longer. Spans out of
    range never are."""
    word_class = r"[\p{L}0-9'-]"
    valid = (F.col("start") >= 0) & (F.col("end") <= F.length("text")) & (F.col("start") < F.col("end"))
    before = F.regexp_extract(F.substring(F.col("text"), F.lit(1), F.col("start")), f"({word_class}*)$", 1)
    after = F.regexp_extract(F.substring(F.col("text"), F.col("end") + 1, F.length("text")), f"^({word_class}*)", 1)
    inner = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    longer = F.length(before) + F.length(after) > 0
    host = F.when(valid & longer, F.lower(F.concat(F.when(F.col("start") > 0, before).otherwise(F.lit("")), inner, after)))
    base = spans.withColumn("_host", host)
    ok = words.select(F.col("word").alias("_host")).distinct().withColumn("_word", F.lit(True))
    base = base.join(ok, "_host", "left")
    found = occurrences(spans.select("key", "text"), phrases.select(F.col("phrase").alias("term"))).select("key", F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    held = spans.join(found, "key").filter("p_start <= start and end <= p_end and p_end - p_start > end - start").select("key").distinct().withColumn("_phrase", F.lit(True))
    out = base.join(held, "key", "left")
    return out.withColumn("rescued", valid & F.coalesce("_word", "_phrase", F.lit(False))).drop("_host", "_word", "_phrase")
