"""The catalogue's queries in DuckDB's SQL, over the same tables."""

from __future__ import annotations

from ..functions.normalize import LEET, LOOKALIKES, SEPARATORS, SPACES
from ..functions.text import CARRIERS
from ..operators.audit import PARETO
from ..operators.inference import FILLER
from ..sources.lexicon import ACTIONS, POLICIES
from . import fixtures as fx


def q(value) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(q, value)) + "]"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def rows(name: str, columns: str, values) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(q, v)) + ")" for v in values) + ")"


def chars(text: str) -> str:
    """A list of characters, by code."""
    return "[" + ", ".join(f"chr({ord(c)})" for c in text) + "]"


WIDE = "".join(chr(0xFF01 + i) for i in range(94))
NARROW = "".join(chr(0x21 + i) for i in range(94))
PLAIN = f"translate(lower(strip_accents(translate(c, {q(WIDE)}, {q(NARROW)}))), {q(''.join(LOOKALIKES))}, {q(''.join(LOOKALIKES.values()))})"
FOLD = f"translate({PLAIN}, {q(''.join(LEET))}, {q(''.join(LEET.values()))})"
GAPS = chars("".join(sorted(set(SEPARATORS) | set(SPACES))))
LETTERS = r"[\p{L}\p{Nl}\p{No}]+"
WORD = r"[\p{L}\p{N}]"


def forms(source: str) -> str:
    """CTEs na, ta (boundary form) and nb, tb (evasion form) of source(msg_id, text)."""
    return f"""
ch AS (SELECT msg_id, i, substr(text, CAST(i + 1 AS INT), 1) AS c FROM (SELECT msg_id, text, unnest(range(length(text))) AS i FROM {source})),
fo AS (SELECT msg_id, i, f, list_contains({GAPS}, f) AS sep FROM (SELECT msg_id, i, {FOLD} AS f FROM ch)),
na AS (SELECT msg_id, i, CASE WHEN sep THEN ' ' ELSE f END AS f, row_number() OVER (PARTITION BY msg_id ORDER BY i) - 1 AS p
       FROM (SELECT *, lag(sep) OVER (PARTITION BY msg_id ORDER BY i) AS before FROM fo) WHERE NOT sep OR NOT before),
ta AS (SELECT msg_id, string_agg(f, '' ORDER BY p) AS t FROM na GROUP BY msg_id),
r1 AS (SELECT *, CASE WHEN f = lag(f) OVER (PARTITION BY msg_id ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM fo),
r2 AS (SELECT *, sum(fresh) OVER (PARTITION BY msg_id ORDER BY i) AS run FROM r1),
r3 AS (SELECT *, count(*) OVER (PARTITION BY msg_id, run) AS n, min(i) OVER (PARTITION BY msg_id, run) AS i0, max(i) OVER (PARTITION BY msg_id, run) AS i1 FROM r2),
nb AS (SELECT msg_id, f, i AS s, CASE WHEN n >= 3 THEN i1 + 1 ELSE i + 1 END AS e, row_number() OVER (PARTITION BY msg_id ORDER BY i) - 1 AS p
       FROM r3 WHERE NOT sep AND (n < 3 OR i = i0)),
tb AS (SELECT msg_id, string_agg(f, '' ORDER BY p) AS t FROM nb GROUP BY msg_id)"""


def messages(surface: str = "public") -> str:
    extra = ", ".join(f"({-1 - i}, {q(t)}, {q(surface)}, 'en')" for i, t in enumerate(fx.MESSAGES))
    return f"""msg(msg_id, text, surface, locale) AS (
  SELECT conv_id * 1000 + turn, text, {q(surface)}, {q(fx.LOCALES)}[conv_id % 4 + 1] FROM conversations UNION ALL VALUES {extra})"""


LEX = rows("lex", "term_ord, term, tier, mode, locales", fx.TERMS)
ALLOW = rows("allowed", "word", [(w,) for w in fx.ALLOW if w not in {t[1] for t in fx.TERMS}])
POLICY = rows("policy", "surface, tier, action", [(s, i + 1, a) for s, x in POLICIES.items() for i, a in enumerate(x)])


def hits(name: str, form: str, terms: str, columns: str) -> str:
    """Occurrences of terms(term, ...) in a form: start and end in it."""
    return f"""{name} AS (SELECT msg_id, {columns}, t, p AS a, p + length(term) AS z FROM (
  SELECT {form}.msg_id, t, {columns}, unnest(range(length(t) - length(term) + 1)) AS p FROM {form}, {terms} WHERE contains(t, term))
  WHERE substr(t, CAST(p + 1 AS INT), length(term)) = term)"""


FREE_LEFT = rf"(a = 0 OR NOT regexp_matches(substr(t, CAST(a AS INT), 1), '{WORD}'))"
FREE_RIGHT = rf"(z >= length(t) OR NOT regexp_matches(substr(t, CAST(z + 1 AS INT), 1), '{WORD}'))"
GAP_CLASS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}._*''\"`\^~,;:()\[\]{}<>/\\|\-]"


def stages(surface: str = "public", lex: str = LEX, allowed: str = ALLOW, source: str | None = None) -> str:
    """The guard's stages over msg, up to verdict."""
    pieces = f"regexp_split_to_array(chars, '{GAP_CLASS}+')"
    return f"""WITH {lex}, {allowed}, {POLICY}, {source or messages(surface)}, {forms("msg")},
{hits("ha", "ta", "lex", "term_ord, term, tier, mode, locales")},
pa AS (SELECT h.msg_id, 0 AS pass_ord, z AS scan1, a AS scan2, term_ord, term, tier, mode, locales, x.i AS o_start, y.i + 1 AS o_end
       FROM ha h JOIN na x ON x.msg_id = h.msg_id AND x.p = a JOIN na y ON y.msg_id = h.msg_id AND y.p = z - 1
       WHERE mode = 'sub' OR ({FREE_LEFT} AND (mode = 'prefix' OR {FREE_RIGHT}))),
{hits("hb", "tb", "lex", "term_ord, term, tier, mode, locales")},
pb AS (SELECT msg_id, 1 AS pass_ord, scan1, scan2, term_ord, term, tier, mode, locales, o_start, o_end FROM (
         SELECT h.msg_id, z AS scan1, a AS scan2, term_ord, term, tier, mode, locales, x.s AS o_start, y.e AS o_end, substr(text, CAST(x.s + 1 AS INT), CAST(y.e - x.s AS INT)) AS chars
         FROM hb h JOIN nb x ON x.msg_id = h.msg_id AND x.p = a JOIN nb y ON y.msg_id = h.msg_id AND y.p = z - 1 JOIN msg m ON m.msg_id = h.msg_id)
       WHERE length(chars) > length(term) AND (NOT regexp_matches(chars, '{GAP_CLASS}')
         OR len(list_filter({pieces}, lambda p: length(p) > 2)) = 0 OR (length(term) >= 5 AND len({pieces}) = 2))),
al AS (SELECT msg_id, i, p, f, CASE WHEN regexp_matches(f, '[a-z0-9]') THEN 1 ELSE 0 END AS w FROM na),
tk AS (SELECT msg_id, row_number() OVER (PARTITION BY msg_id ORDER BY min(p)) - 1 AS tok_ord, string_agg(f, '' ORDER BY p) AS token, min(p) AS p0, min(i) AS o_start, max(i) + 1 AS o_end
       FROM (SELECT *, p - sum(w) OVER (PARTITION BY msg_id ORDER BY p) AS g FROM al) WHERE w = 1 GROUP BY msg_id, g),
pc AS (SELECT msg_id, 2 AS pass_ord, tok_ord AS scan1, 0 AS scan2, term_ord, token, term, tier, mode, locales, o_start, o_end FROM (
         SELECT *, row_number() OVER (PARTITION BY msg_id, tok_ord ORDER BY term_ord) AS n FROM tk JOIN lex
         ON abs(length(token) - length(term)) <= 1 AND levenshtein(token, term) = 1
         WHERE tier IN (3, 4) AND length(term) >= 5 AND length(token) >= 5 AND token NOT IN (SELECT word FROM allowed)) WHERE n = 1),
cand AS (SELECT * FROM pa UNION ALL SELECT * FROM pb UNION ALL SELECT * EXCLUDE (token) FROM pc),
live AS (SELECT * FROM (
           SELECT cand.*, row_number() OVER (PARTITION BY cand.msg_id, o_start, o_end, term ORDER BY pass_ord, scan1, scan2, term_ord) AS n
           FROM cand JOIN msg ON msg.msg_id = cand.msg_id WHERE locales IS NULL OR list_contains(locales, locale)) WHERE n = 1),
{hits("hp", "ta", "(SELECT word AS term FROM allowed)", "term")},
shel AS (SELECT h.msg_id, term AS phrase, x.i AS p_start, y.i + 1 AS p_end, z AS scan1, a AS scan2
         FROM hp h JOIN na x ON x.msg_id = h.msg_id AND x.p = a JOIN na y ON y.msg_id = h.msg_id AND y.p = z - 1),
byp AS (SELECT l.msg_id, o_start, o_end, term, phrase FROM live l JOIN shel s ON s.msg_id = l.msg_id
        WHERE p_start <= o_start AND o_end <= p_end AND p_end - p_start > o_end - o_start AND phrase <> term
        QUALIFY row_number() OVER (PARTITION BY l.msg_id, o_start, o_end, term ORDER BY p_end - p_start DESC, s.scan1, s.scan2) = 1),
byt AS (SELECT * FROM (
          SELECT l.msg_id, l.o_start, l.o_end, term, token FROM live l JOIN tk ON tk.msg_id = l.msg_id
          WHERE tk.o_start <= l.o_start AND l.o_end <= tk.o_end
          QUALIFY row_number() OVER (PARTITION BY l.msg_id, l.o_start, l.o_end, term ORDER BY tok_ord) = 1)
        WHERE token <> term AND token IN (SELECT word FROM allowed)),
resc AS (SELECT msg_id, o_start, o_end, term, coalesce(phrase, token) AS saver FROM byp FULL JOIN byt USING (msg_id, o_start, o_end, term)),
acted AS (SELECT live.*, action FROM live ANTI JOIN resc USING (msg_id, o_start, o_end, term) JOIN msg ON msg.msg_id = live.msg_id JOIN policy ON policy.surface = msg.surface AND policy.tier = live.tier WHERE action <> 0),
worst AS (SELECT msg_id, max(action) AS worst, string_agg(o_start || ':' || o_end || ':' || term || ':' || tier || ':' || {q(ACTIONS)}[action + 1], ',' ORDER BY pass_ord, scan1, scan2, term_ord) AS hits FROM acted GROUP BY msg_id),
stars AS (SELECT DISTINCT msg_id, unnest(range(o_start, o_end)) AS i FROM acted WHERE action = 1),
hidden AS (SELECT ch.msg_id, string_agg(CASE WHEN stars.i IS NULL THEN c ELSE '*' END, '' ORDER BY ch.i) AS text FROM ch LEFT JOIN stars USING (msg_id, i) GROUP BY ch.msg_id),
saved AS (SELECT msg_id, string_agg(saver, ',' ORDER BY saver) AS rescued FROM (SELECT DISTINCT msg_id, saver FROM resc) GROUP BY msg_id),
verdict AS (SELECT msg.msg_id, {q(ACTIONS)}[coalesce(worst, 0) + 1] AS action, coalesce(worst, 0) AS error_id,
            CASE WHEN coalesce(worst, 0) IN (0, 2) THEN msg.text ELSE hidden.text END AS filtered, coalesce(hits, '') AS hits, coalesce(rescued, '') AS rescued, msg.text AS text, locale
            FROM msg LEFT JOIN worst USING (msg_id) LEFT JOIN hidden USING (msg_id) LEFT JOIN saved USING (msg_id))
"""


S = stages()
CAST = lambda *cs: ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in cs)
ENTRIES = rows("entries", "entry", [(e,) for e in fx.ENTRIES])
LINE_ROWS = "SELECT conv_id * 1000 + turn AS line_id, text AS line FROM conversations"
LINES = "lines AS (SELECT conv_id * 1000 + turn AS line_id, role AS label, text AS line FROM conversations)"
OWN = "own AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name), '[a-z][a-z'']*')) AS word FROM part)"
DICT = rf"dict AS MATERIALIZED (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{LETTERS}')) AS word FROM documents)"


def sub_hits(lines: str = "lines") -> str:
    return f"sub AS (SELECT line_id, entry FROM {lines}, entries WHERE contains(lower(line), entry))"


def word_hits(pattern: str, lines: str = "lines", name: str = "wrd") -> str:
    return f"{name} AS (SELECT DISTINCT line_id, entry FROM (SELECT line_id, unnest(regexp_extract_all(lower(line), '{pattern}')) AS entry FROM {lines}) JOIN entries USING (entry))"


DIGITS = "[a-z0-9'']+"
LATIN = "[a-z][a-z'']*"


def broken(words: str, name: str) -> str:
    return f"""{name} AS (SELECT entry, count(*) AS n, min(word) AS example FROM entries, (SELECT word FROM {words} WHERE word NOT IN (SELECT entry FROM entries)) WHERE contains(word, entry) GROUP BY entry)"""


RADIUS = f"""{ENTRIES}, {OWN}, {DICT}, known AS (SELECT word FROM dict WHERE length(word) >= 3 AND regexp_full_match(word, '\\p{{L}}+')),
{broken("own", "b1")}, {broken("known", "b2")},
radius AS (SELECT entry, length(entry) AS length, coalesce(b1.n, 0) AS own_broken, coalesce(b2.n, 0) AS dict_broken, coalesce(b1.n, 0) + coalesce(b2.n, 0) AS blast_radius, coalesce(b1.example, b2.example, '') AS example
           FROM entries LEFT JOIN b1 USING (entry) LEFT JOIN b2 USING (entry)),
advice AS (SELECT entry, blast_radius,
  CASE WHEN length <= 2 THEN 'SCOPE:zh' WHEN entry IN (SELECT word FROM own) THEN 'DELETE' WHEN blast_radius > 0 THEN 'WHOLE-WORD' ELSE 'KEEP' END AS recommended_action,
  CASE WHEN length <= 2 THEN 'one or two characters' WHEN entry IN (SELECT word FROM own) THEN 'used as a word in own text'
       WHEN entry IN (SELECT word FROM dict) AND blast_radius > 0 THEN 'an ordinary word' WHEN blast_radius > 0 THEN 'breaks ordinary words' ELSE 'breaks nothing measured' END AS rationale
  FROM radius)"""

PROBES = f"""log AS (SELECT CASE event_id % 7 WHEN 0 THEN 'xx' || w || 'xx' WHEN 1 THEN 'qz' || w || 'jv' ELSE w END AS text,
  CASE WHEN event_type = 'error' THEN 'mismatch' WHEN event_type = 'click' OR (event_type = 'view' AND length(w) <= 5) THEN 'blocked' ELSE 'sent' END AS result,
  't' || event_id % 5 AS tag, event_id AS t, CASE WHEN user_id % 11 = 3 THEN 'stage1' ELSE 'sweep' END AS phase
  FROM (SELECT *, {q(fx.WORDS)}[user_id % {len(fx.WORDS)} + 1] AS w FROM events)),
tally AS (SELECT lower(trim(text)) AS word, count(*) FILTER (result = 'blocked') AS n_blocked, count(*) AS n FROM log WHERE result IN ('blocked', 'sent') AND text NOT LIKE '% %' GROUP BY 1),
votes AS (SELECT *, CASE WHEN n_blocked = 0 THEN 'sent' WHEN n_blocked = 1 AND n = 1 THEN 'unconfirmed' WHEN n_blocked * 2 > n THEN 'blocked' ELSE 'sent' END AS verdict,
  CASE WHEN n_blocked > 0 AND n_blocked < n THEN n_blocked || '/' || n END AS disputed FROM tally),
listed AS (SELECT DISTINCT lower(trim(text)) AS word FROM log WHERE phase = 'stage1')"""


def unwrapped(word: str) -> str:
    cases = " ".join(f"WHEN starts_with({word}, {q(a)}) AND ends_with({word}, {q(b)}) AND length({word}) > {len(a + b)} THEN substr({word}, {len(a) + 1}, length({word}) - {len(a + b)})" for a, b in CARRIERS)
    return f"CASE {cases} END"


FRAGMENTS = f"""{PROBES}, fr AS (SELECT DISTINCT fragment FROM (
  SELECT CASE WHEN core IS NOT NULL THEN core WHEN length(word) <= 3 OR word IN (SELECT word FROM listed) THEN word END AS fragment
  FROM (SELECT word, {unwrapped("word")} AS core FROM votes WHERE verdict = 'blocked')) WHERE fragment IS NOT NULL),
rules AS (SELECT fragment FROM fr a WHERE NOT EXISTS (SELECT 1 FROM fr b WHERE b.fragment <> a.fragment AND contains(a.fragment, b.fragment)))"""

REACH = f"""{ENTRIES}, {DICT}, reach AS (SELECT entry AS rule, word FROM entries, dict WHERE length(word) BETWEEN 3 AND 20 AND regexp_full_match(word, '\\p{{L}}+') AND contains(word, entry))"""

STEMS = """CASE WHEN ends_with(word, 'ies') THEN [substr(word, 1, length(word) - 3) || 'y'] ELSE [] END
 || CASE WHEN ends_with(word, 'es') THEN [substr(word, 1, length(word) - 1), substr(word, 1, length(word) - 2)] ELSE [] END
 || CASE WHEN ends_with(word, 's') THEN [substr(word, 1, length(word) - 1)] ELSE [] END
 || CASE WHEN ends_with(word, 'ed') THEN [substr(word, 1, length(word) - 1), substr(word, 1, length(word) - 2)] ELSE [] END
 || CASE WHEN ends_with(word, 'ing') THEN [substr(word, 1, length(word) - 3), substr(word, 1, length(word) - 3) || 'e'] ELSE [] END"""


def vocabulary(words: str, attested: str) -> str:
    return f"vocab AS (SELECT DISTINCT word FROM (SELECT word, unnest([word] || list_filter({STEMS}, lambda s: length(s) >= 3)) AS stem FROM {words} WHERE length(word) >= 3) WHERE stem IN (SELECT word FROM {attested}))"


SUBSTRINGS = "SELECT {0}, lower(substr({1}, i, n)) AS candidate FROM (SELECT {0}, {1}, n, unnest(range(1, length({1}) - n + 2)) AS i FROM (SELECT {0}, {1}, unnest(range(2, least(12, length({1})) + 1)) AS n FROM {2}))"
FOUND = f"""{OWN}, obs AS (SELECT word AS text, contains(word, 'et') OR contains(word, 'ot') AS blocked FROM own),
clean AS (SELECT DISTINCT candidate FROM ({SUBSTRINGS.format("text", "text", "(SELECT text FROM obs WHERE NOT blocked)").replace("SELECT text, text, n", "SELECT text, n").replace("SELECT text, text, unnest", "SELECT text, unnest")})),
found AS (SELECT DISTINCT text, candidate FROM ({SUBSTRINGS.format("text", "text", "(SELECT text FROM obs WHERE blocked)").replace("SELECT text, text, n", "SELECT text, n").replace("SELECT text, text, unnest", "SELECT text, unnest")}) WHERE candidate NOT IN (SELECT candidate FROM clean))"""


def wilson(k: str, n: str) -> str:
    p, z = f"({k} / {n}::DOUBLE)", "1.96"
    under = f"(1 + {z} * {z} / {n})"
    centre = f"(({p} + {z} * {z} / (2 * {n})) / {under})"
    half = f"({z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n} * {n})) / {under})"
    return f"{p} AS p, greatest(0.0, {centre} - {half}) AS lo, least(1.0, {centre} + {half}) AS hi"


def flagged(source: str, entries: list[str] | None = None) -> str:
    """msg_id of the lines (line_id, line) of a query that a guard flags, its own list or
    the entries as strong whole words being its terms."""
    msg = f"msg(msg_id, text, surface, locale) AS (SELECT line_id, line, 'public', 'en' FROM ({source}))"
    if entries is None:
        return f"({stages(source=msg)} SELECT msg_id FROM worst)"
    lex = f"lex(term_ord, term, tier, mode, locales) AS (SELECT row_number() OVER (), entry, 2, 'word', CAST(NULL AS VARCHAR[]) FROM ({entries}))"
    allowed = f"allowed(word) AS (SELECT word FROM (SELECT unnest({q(fx.ALLOW)}) AS word) WHERE word NOT IN (SELECT entry FROM ({entries})))"
    return f"({stages(lex=lex, allowed=allowed, source=msg)} SELECT msg_id FROM worst)"


LEET_SQL = "translate({}, 'aeios', '43105')"
VARIANTS = f"""variants AS (SELECT term, unnest([
  {{'variant': 'plain', 'line': term}}, {{'variant': 'spaced', 'line': array_to_string(string_split(term, ''), ' ')}},
  {{'variant': 'dotted', 'line': array_to_string(string_split(term, ''), '.')}}, {{'variant': 'dashed', 'line': array_to_string(string_split(term, ''), '-')}},
  {{'variant': 'repeat', 'line': substr(term, 1, 1) || repeat(substr(term, 2, 1), 3) || substr(term, 3)}}, {{'variant': 'leet', 'line': {LEET_SQL.format("term")}}},
  {{'variant': 'fullwidth', 'line': translate(term, {q(NARROW)}, {q(WIDE)})}}, {{'variant': 'cyrillic', 'line': translate(term, 'aeoc', {q(chr(0x430) + chr(0x435) + chr(0x43E) + chr(0x441))})}},
  {{'variant': 'swap', 'line': CASE WHEN length(term) > 2 THEN substr(term, 1, 1) || 'v' || substr(term, 3) ELSE term END}}, {{'variant': 'padded', 'line': term || repeat(substr(term, length(term), 1), 2)}}, {{'variant': 'upper', 'line': upper(term)}}]) AS v
  FROM (SELECT word AS term FROM own) WHERE length(term) >= 4),
corpus AS (SELECT term, v.variant AS variant, v.line AS line, v.variant || '/' || term AS line_id FROM variants)"""

CORPUS_ROWS = f"WITH {OWN}, {VARIANTS} SELECT line_id, line FROM corpus"

CLAIMS = r"regexp_replace(regexp_replace(html, '(?is)<style\b.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g')"

MASKED = f"{S} SELECT msg_id, filtered, CAST(length(filtered) - length(replace(filtered, '*', '')) AS BIGINT) AS stars FROM verdict WHERE error_id = 1"
COMPARED = f"""{S}, {ENTRIES}, cmp AS (SELECT v.msg_id, text, locale, EXISTS (SELECT 1 FROM entries WHERE length(entry) >= 4 AND contains(lower(v.text), entry)) AS incumbent_flagged, action <> 'ALLOW' AS guard_flagged, action AS guard_action, CAST(abs(v.msg_id) AS DOUBLE) AS ts FROM verdict v)"""
PACKED = f"""WITH RECURSIVE w AS (SELECT word, row_number() OVER (ORDER BY ord) AS i FROM (SELECT lower(n_name) AS word, min(n_nationkey) AS ord FROM nation GROUP BY 1)),
tok AS (SELECT i, word, {q(FILLER[:2])} || word || {q(FILLER[2:4])} AS token FROM w),
fit(i, msg, used) AS (
  SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT)
  UNION ALL
  SELECT t.i, CASE WHEN msg < 0 OR used + length(token) + 1 > 80 THEN msg + 1 ELSE msg END, CASE WHEN msg < 0 OR used + length(token) + 1 > 80 THEN length(token) + 1 ELSE used + length(token) + 1 END
  FROM fit JOIN tok t ON t.i = fit.i + 1),
packed AS (SELECT msg AS msg_idx, string_agg(token, ' ' ORDER BY tok.i) AS payload, string_agg(word, ',' ORDER BY tok.i) AS candidates, list(word ORDER BY tok.i) AS words FROM fit JOIN tok USING (i) GROUP BY msg)"""
KIND = "CASE WHEN incumbent_flagged AND NOT guard_flagged THEN 'over_block_fixed' WHEN guard_flagged AND NOT incumbent_flagged THEN 'new_catch' END"
DERIVED = f"""{rows("roots", "root, r", [(x, i) for i, x in enumerate(fx.ROOTS)])}, {rows("pre", "prefix, p", [(x, i) for i, x in enumerate(fx.PREFIXES)])}, {rows("suf", "suffix, s", [(x, i) for i, x in enumerate(fx.SUFFIXES)])}"""


def affix(terms: list[str], prefixes: list[str], suffixes: list[str]) -> str:
    return f"""{rows("tm", "term", [(t,) for t in terms])}, made AS (SELECT w, min(term) AS term FROM (
  SELECT term, term AS w FROM tm UNION ALL SELECT term, term || unnest({q(suffixes)}) FROM tm WHERE length(term) >= 3 UNION ALL SELECT term, unnest({q(prefixes)}) || term FROM tm WHERE length(term) >= 3) GROUP BY w)"""


def share(lines: str, hit: str, by: str) -> str:
    return f"SELECT {by}, count(*) AS lines, count(*) FILTER ({hit}) AS flagged, round(count(*) FILTER ({hit}) * 100 / count(*), 2) AS pct FROM {lines} GROUP BY {by}"


NAMES = "names AS (SELECT p_partkey AS line_id, p_name AS line FROM part)"
BATTERY = "bat AS (SELECT event_type AS stratum, CASE WHEN user_id % 2 = 0 THEN 'pass' ELSE 'block' END AS expected, CASE WHEN value < 20 THEN 'pass' WHEN value < 60 THEN 'block' END AS result FROM events)"
HELD = "held AS (SELECT word, root FROM (SELECT word, root, row_number() OVER (PARTITION BY word ORDER BY r) AS n FROM dict, roots WHERE contains(word, root)) WHERE n = 1)"
FIXED_RANKS = (0, 5, 10, 20, 40)

ORACLES = {
    "normalize_boundary": f"{S} SELECT msg.msg_id, coalesce(t, '') AS form, CAST(coalesce(s, 0) AS BIGINT) AS starts, CAST(coalesce(e, 0) AS BIGINT) AS ends FROM msg LEFT JOIN ta USING (msg_id) LEFT JOIN (SELECT msg_id, sum(i) AS s, sum(i + 1) AS e FROM na GROUP BY msg_id) USING (msg_id)",
    "normalize_condense": f"{S} SELECT msg.msg_id, coalesce(t, '') AS form, CAST(coalesce(s, 0) AS BIGINT) AS starts, CAST(coalesce(e, 0) AS BIGINT) AS ends FROM msg LEFT JOIN tb USING (msg_id) LEFT JOIN (SELECT msg_id, sum(s) AS s, sum(e) AS e FROM nb GROUP BY msg_id) USING (msg_id)",
    "fold_leet": f"WITH n0 AS (SELECT p_name AS name FROM part UNION SELECT n_name FROM nation), src AS (SELECT row_number() OVER () AS msg_id, name, {LEET_SQL.format('lower(name)')} AS text FROM n0), {forms('src')} SELECT name, text, t AS form FROM src JOIN ta USING (msg_id)",
    "tokenize_guard": f"{S} SELECT token, count(*) AS n, CAST(sum(p0) AS BIGINT) AS starts FROM tk GROUP BY token",
    "match_all_hits": f"{S} SELECT msg_id, term, CAST(a AS INT) AS start, CAST(z AS INT) AS \"end\" FROM ha",
    **{f"match_{m}": f"{S} SELECT msg_id, term, CAST(o_start AS INT) AS o_start, CAST(o_end AS INT) AS o_end FROM pa WHERE mode = '{m}'" for m in ("word", "prefix", "sub")},
    "match_locale": f"{S} SELECT msg_id, pass_ord, term, tier, CAST(o_start AS INT) AS o_start, CAST(o_end AS INT) AS o_end FROM live",
    "evasion_hits": f"{S} SELECT msg_id, term, CAST(o_start AS INT) AS o_start, CAST(o_end AS INT) AS o_end FROM pb",
    "fuzzy_hits": f"{S} SELECT msg_id, token, term, CAST(o_start AS INT) AS o_start, CAST(o_end AS INT) AS o_end FROM pc",
    "phrase_shelter": f"{S} SELECT msg_id, phrase, CAST(p_start AS INT) AS p_start, CAST(p_end AS INT) AS p_end FROM shel",
    "token_rescue": f"{S} SELECT msg_id, CAST(o_start AS INT) AS o_start, CAST(o_end AS INT) AS o_end, term, saver AS \"by\" FROM resc",
    **{f"verdict_{s}": f"{stages(s)} SELECT msg_id, action, CAST(error_id AS INT) AS error_id, filtered, hits, rescued FROM verdict" for s in POLICIES},
    "mask_text": MASKED,
    "baseline_substring": f"WITH {ENTRIES}, {LINES}, {sub_hits()} SELECT line_id, entry FROM sub",
    "baseline_wholeword": f"WITH {ENTRIES}, {LINES}, {word_hits(DIGITS)} SELECT line_id, entry FROM wrd",
    "length_rule_sweep": f"WITH {ENTRIES}, {LINES}, {sub_hits()}, {word_hits(LETTERS)}, al AS (SELECT lines.*, n FROM lines, range(1, 7) t(n)), hit AS (SELECT al.*, EXISTS (SELECT 1 FROM sub WHERE sub.line_id = al.line_id AND length(entry) >= n) OR EXISTS (SELECT 1 FROM wrd WHERE wrd.line_id = al.line_id AND length(entry) < n) AS h FROM al) {share('hit', 'h', 'label, n').replace('n,', 'CAST(n AS INT) AS n,', 1)}",
    "term_length_hist": f"WITH {DICT} SELECT CAST(length(word) AS INT) AS length, count(*) AS n, length(word) <= 3 AS short FROM dict GROUP BY length(word)",
    "blast_radius": f"WITH {RADIUS} SELECT entry, CAST(length AS INT) AS length, {CAST('own_broken', 'dict_broken', 'blast_radius')}, example FROM radius",
    "recommend_action": f"WITH {RADIUS} SELECT entry, CAST(blast_radius AS BIGINT) AS blast_radius, recommended_action, rationale FROM advice",
    "pareto_share": f"WITH {RADIUS}, rk AS (SELECT row_number() OVER o AS top, sum(blast_radius) OVER (o ROWS UNBOUNDED PRECEDING) AS cumulative, sum(blast_radius) OVER () AS total FROM radius WINDOW o AS (ORDER BY blast_radius DESC, entry)) SELECT CAST(top AS INT) AS top, {CAST('cumulative', 'total')}, round(cumulative * 100 / total, 1) AS pct FROM rk WHERE top IN {PARETO}",
    "simulate_fixes": f"""WITH {RADIUS}, {NAMES}, rk AS (SELECT *, row_number() OVER (ORDER BY blast_radius DESC, entry) AS rank FROM advice), tops(top) AS (VALUES {', '.join(f'({t})' for t in FIXED_RANKS)}),
hit AS (SELECT line_id, top, EXISTS (SELECT 1 FROM rk WHERE (rank > top OR recommended_action = 'KEEP') AND contains(lower(line), entry))
  OR EXISTS (SELECT 1 FROM rk WHERE rank <= top AND recommended_action = 'WHOLE-WORD' AND list_contains(regexp_extract_all(lower(line), '{LATIN}'), entry)) AS h FROM names, tops) {share('hit', 'h', 'top').replace('top,', 'CAST(top AS INT) AS top,', 1)}""",
    "longest_offender": f"WITH {ENTRIES}, {DICT} SELECT word, entry FROM dict, entries WHERE contains(word, entry) AND length(entry) < length(word) QUALIFY row_number() OVER (PARTITION BY word ORDER BY length(entry) DESC, strpos(word, entry)) = 1",
    "offender_counts": f"WITH {ENTRIES}, {DICT}, o AS (SELECT word, entry FROM dict, entries WHERE contains(word, entry) AND length(entry) < length(word) QUALIFY row_number() OVER (PARTITION BY word ORDER BY length(entry) DESC, strpos(word, entry)) = 1) SELECT entry, count(*) AS n, array_to_string(list_sort(list(word))[1:3], ',') AS examples FROM o GROUP BY entry",
    "over_block_matrix": f"WITH {ENTRIES}, {LINES}, {sub_hits()}, {word_hits(DIGITS)}, hit AS (SELECT label, 'substring' AS engine, line_id IN (SELECT line_id FROM sub) AS h FROM lines UNION ALL SELECT label, 'word', line_id IN (SELECT line_id FROM wrd) FROM lines UNION ALL SELECT label, 'guard', line_id IN {flagged(LINE_ROWS)} FROM lines UNION ALL SELECT label, 'guard, same list', line_id IN {flagged(LINE_ROWS, 'SELECT unnest(' + q(fx.ENTRIES) + ') AS entry')} FROM lines) {share('hit', 'h', 'label, engine')}",
    "evasion_generate": f"WITH {OWN}, {VARIANTS} SELECT term, variant, line FROM corpus",
    "under_block_rollup": f"WITH {OWN}, {VARIANTS}, entries AS (SELECT word AS entry FROM own), {sub_hits('corpus')}, {word_hits(DIGITS, 'corpus')}, hit AS (SELECT variant, 'substring' AS engine, line_id IN (SELECT line_id FROM sub) AS h FROM corpus UNION ALL SELECT variant, 'word', line_id IN (SELECT line_id FROM wrd) FROM corpus UNION ALL SELECT variant, 'guard', line_id IN {flagged(CORPUS_ROWS)} FROM corpus UNION ALL SELECT variant, 'guard, same list', line_id IN {flagged(CORPUS_ROWS, 'WITH ' + OWN + ' SELECT word AS entry FROM own')} FROM corpus), every AS (SELECT * FROM hit UNION ALL SELECT 'ALL', engine, h FROM hit) {share('every', 'h', 'engine, variant')}",
    "selftest_gate": f"WITH {ENTRIES}, {NAMES} SELECT line_id, entry FROM names, entries WHERE contains(lower(line), entry) QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY length(entry), strpos(lower(line), entry)) = 1",
    "probe_vote": f"WITH {PROBES} SELECT word, n_blocked, n, verdict, disputed FROM votes",
    "hitting_set": f"""WITH RECURSIVE {FOUND},
     start AS MATERIALIZED (SELECT DISTINCT text, candidate FROM found),
     pick(step, candidate, remaining) AS (
       SELECT -1, CAST(NULL AS VARCHAR), (SELECT list(DISTINCT text) FROM start)
       UNION ALL
       SELECT step + 1, c, list_filter(remaining, lambda t: NOT list_contains(covered, t)) FROM (
         SELECT step, remaining, c, (SELECT list(text) FROM start WHERE candidate = c) AS covered FROM (
           SELECT step, remaining, (SELECT candidate FROM start WHERE list_contains(remaining, text) GROUP BY candidate ORDER BY count(*) DESC, length(candidate), candidate LIMIT 1) AS c FROM pick WHERE len(remaining) > 0)) WHERE c IS NOT NULL)
     SELECT CAST(step AS INTEGER) AS step, candidate FROM pick WHERE step >= 0""",
    "probe_pack": f"{PACKED} SELECT msg_idx, payload, candidates FROM packed",
    "probe_read": f"{PACKED}, pair AS (SELECT unnest(words) AS candidate, unnest(string_split(payload, ' ')) AS sent, unnest(string_split(replace(payload, 'an', '**'), ' ')) AS back FROM packed) SELECT candidate, CASE WHEN sent <> back THEN 'fired' ELSE 'clean' END AS outcome FROM pair",
    "probe_untested": f"WITH {PROBES}, marked AS (SELECT CASE WHEN result = 'mismatch' THEN 'err' || text ELSE text END AS text, result FROM log) SELECT DISTINCT text AS word FROM marked WHERE result = 'mismatch' AND text NOT IN (SELECT text FROM marked WHERE result IN ('blocked', 'sent'))",
    "fragment_candidates": f"WITH {FRAGMENTS} SELECT fragment FROM fr",
    "fragment_minimal": f"WITH {FRAGMENTS} SELECT fragment FROM rules",
    "probe_classify": f"WITH {FRAGMENTS}, {rows('att', 'word', [(w,) for w in fx.WORDS[:20]])}, {vocabulary('votes', 'att')} SELECT word, CASE WHEN {unwrapped('word')} IS NOT NULL THEN 'carrier' WHEN verdict = 'blocked' AND word IN (SELECT fragment FROM rules) THEN 'term' WHEN verdict = 'blocked' AND word IN (SELECT word FROM listed) THEN 'listed' WHEN verdict = 'blocked' AND word NOT IN (SELECT word FROM vocab) THEN 'unattested' WHEN verdict = 'blocked' THEN 'ordinary' WHEN verdict = 'sent' THEN 'clean' ELSE 'unconfirmed' END AS kind FROM votes",
    "attribution_shortest": f"WITH {ENTRIES}, {DICT}, a AS (SELECT word, entry FROM dict, entries WHERE contains(word, entry) AND word <> entry QUALIFY row_number() OVER (PARTITION BY word ORDER BY length(entry), entry) = 1) SELECT dict.word, entry AS rule FROM dict LEFT JOIN a USING (word)",
    "attribution_measured": f"WITH {ENTRIES}, {DICT}, a AS (SELECT word, entry FROM dict, entries WHERE contains(word, entry) AND word <> entry QUALIFY row_number() OVER (PARTITION BY word ORDER BY length(entry), entry) = 1) SELECT entry AS rule, count(*) AS words FROM a GROUP BY entry",
    "reach_union": f"WITH {REACH} SELECT count(*) AS pairs, count(DISTINCT word) AS words, count(DISTINCT word) FILTER (length(rule) < 5) AS under, count(DISTINCT word) FILTER (length(rule) >= 5) AS still_matched, count(DISTINCT word) - count(DISTINCT word) FILTER (length(rule) < 5) AS reached_only_by_long FROM reach",
    "reach_by_length": f"WITH {REACH} SELECT CAST(length(rule) AS INT) AS length, count(DISTINCT rule) AS rules, count(DISTINCT word) AS words FROM reach GROUP BY length(rule)",
    "reach_first_rule": f"WITH {REACH} SELECT word, rule FROM reach QUALIFY row_number() OVER (PARTITION BY word ORDER BY length(rule), rule) = 1",
    "topk_others": f"WITH {REACH}, by_rule AS (SELECT rule, count(*) AS words FROM reach GROUP BY rule ORDER BY words DESC, rule LIMIT 5) SELECT rule, words FROM by_rule UNION ALL SELECT 'others', CAST((SELECT count(DISTINCT word) FROM reach) - (SELECT sum(words) FROM by_rule) AS BIGINT)",
    "locale_block_rate": f"WITH {PROBES}, {rows('lang', 'tag, language', fx.LANGUAGES)}, f AS (SELECT text AS word, language FROM log JOIN lang USING (tag) QUALIFY row_number() OVER (PARTITION BY text ORDER BY t) = 1) SELECT language, count(*) FILTER (verdict = 'blocked') AS blocked, count(*) AS total, round(count(*) FILTER (verdict = 'blocked') * 100 / count(*), 1) AS pct FROM f JOIN votes USING (word) WHERE verdict IN ('blocked', 'sent') GROUP BY language",
    "inflection_member": rf"WITH {DICT}, att AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{LETTERS}')) AS word FROM benchmark), {vocabulary('dict', 'att')} SELECT word FROM vocab",
    "candidate_elimination": f"WITH {FOUND} SELECT text, candidate FROM found",
    "candidate_report": f"WITH {FOUND} SELECT text, count(*) AS n, array_to_string(list(candidate ORDER BY length(candidate), candidate)[1:12], ',') AS shortest FROM found GROUP BY text",
    "probe_design": f"WITH {FOUND} SELECT candidate, count(DISTINCT text) AS n, 'qz' || candidate || 'jv' AS probe FROM found GROUP BY candidate ORDER BY n DESC, length(candidate), candidate LIMIT 12",
    "resume_anti_join": rf"WITH {OWN}, {PROBES} SELECT word AS text FROM own WHERE word NOT IN (SELECT text FROM log) AND word NOT IN (SELECT regexp_extract(lower(p_name), '{LETTERS}') FROM part)",
    "stratified_sample": rf"WITH w AS (SELECT DISTINCT lang AS stratum, unnest(regexp_extract_all(lower(text), '{LETTERS}')) AS word FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('7:' || word), word) AS turn FROM w) SELECT stratum, word, CAST(turn AS INT) AS turn FROM r WHERE turn <= CASE stratum WHEN 'en' THEN 40 WHEN 'de' THEN 20 WHEN 'fr' THEN 20 WHEN 'es' THEN 10 ELSE 0 END",
    "wilson_by_stratum": f"WITH s AS (SELECT source, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS k FROM labels JOIN documents USING (doc_id) GROUP BY source), w AS (SELECT *, {wilson('k', 'n')} FROM s) SELECT source, n, k, round(p, 6) AS p, round(lo, 6) AS lo, round(hi, 6) AS hi FROM w",
    "battery_score": f"WITH {BATTERY}, s AS (SELECT stratum, count(*) AS n, count(*) FILTER (result <> expected) AS unexpected FROM bat WHERE result IS NOT NULL GROUP BY stratum), w AS (SELECT *, {wilson('unexpected', 'n')} FROM s) SELECT stratum, n, unexpected, round(p * 100, 1) AS rate, round(lo * 100, 1) AS lo, round(hi * 100, 1) AS hi FROM w",
    "control_warnings": f"WITH {BATTERY} SELECT stratum, count(*) AS n FROM bat WHERE (stratum = 'view' AND result = 'block') OR (stratum = 'click' AND result = 'pass') GROUP BY stratum",
    "ngram_phrases": rf"WITH r AS (SELECT unnest(regexp_extract_all(p_name, '{LETTERS}')) AS run FROM part), g AS (SELECT substr(run, i, n) AS phrase FROM (SELECT run, n, unnest(range(1, length(run) - n + 2)) AS i FROM (SELECT run, unnest(range(2, least(4, length(run)) + 1)) AS n FROM r))) SELECT phrase, count(*) AS n FROM g GROUP BY phrase HAVING count(*) > 1",
    "derivation_screen": f"WITH {DICT}, {DERIVED}, m AS (SELECT root AS w, root AS reason, 0 AS d, r, 0 AS p, 0 AS s FROM roots UNION ALL SELECT prefix || root || suffix, trim(prefix || '+' || root || '+' || suffix, '+'), 1, r, p, s FROM roots, pre, suf), k AS (SELECT w, reason FROM m QUALIFY row_number() OVER (PARTITION BY w ORDER BY d, r, p, s) = 1) SELECT word, reason FROM dict JOIN k ON word = w",
    "containment_screen": f"WITH {DICT}, {rows('roots', 'root, r', [(x, i) for i, x in enumerate(fx.ROOTS)])}, {HELD} SELECT word, root FROM held WHERE word NOT IN {tuple(fx.EXCEPTIONS)}",
    "affix_screen": f"WITH {DICT}, {affix(['the', 'on', 'der', 'thing'], ['un', 'en'], ['s', 'ing', 'en'])} SELECT word, term FROM dict JOIN made ON word = w",
    "allowlist_screen": f"WITH {DICT}, {rows('roots', 'root, r', [(x, i) for i, x in enumerate(fx.ROOTS)])}, {HELD}, {affix(['the', 'on', 'der'], ['un', 'en'], ['s', 'ing', 'en'])} SELECT dict.word, coalesce('holds ' || root, 'made of ' || term) AS reason FROM dict LEFT JOIN held USING (word) LEFT JOIN made ON dict.word = w",
    "allowlist_sources": r"WITH w AS (SELECT DISTINCT lang, lower(t) AS word FROM (SELECT lang, unnest(regexp_extract_all(text, '[\p{L}\p{Nl}\p{No}]{3,}')) AS t FROM documents)) SELECT lang AS source, count(*) AS words FROM w WHERE length(word) BETWEEN 3 AND 24 GROUP BY lang",
    "shadow_compare": f"{COMPARED} SELECT {KIND} AS kind, text, locale, incumbent_flagged, guard_flagged, guard_action, ts FROM cmp WHERE incumbent_flagged <> guard_flagged",
    "shadow_report": f"{COMPARED} SELECT count(*) AS calls, count(*) FILTER (incumbent_flagged = guard_flagged) AS agree, count(*) FILTER (incumbent_flagged AND NOT guard_flagged) AS over_block_fixed, count(*) FILTER (guard_flagged AND NOT incumbent_flagged) AS new_catch, CAST(0 AS BIGINT) AS guard_errors, round(count(*) FILTER (incumbent_flagged = guard_flagged) * 100 / greatest(count(*), 1), 2) AS agreement_pct FROM cmp",
    "html_strip_numbers": rf"WITH d AS (SELECT page_id AS key, replace(unnest(regexp_extract_all({CLAIMS}, '\b(?:\d{{1,3}}(?:,\d{{3}})+|\d+)\b')), ',', '') AS d FROM pages), n AS (SELECT DISTINCT key, CAST(d AS BIGINT) AS number FROM d WHERE length(d) <= 15) SELECT key, number FROM n WHERE number >= 100 AND number NOT IN (SELECT page_id FROM pages)",
    "percent_evidence": "SELECT n_nationkey AS key, n_nationkey * 1.5 :: DOUBLE AS percent FROM nation WHERE n_nationkey * 1.5 NOT IN (SELECT r_regionkey * 3.0 FROM region)",
    "blocked_and_clean": f"{S} SELECT locale, count(*) FILTER (error_id = 2) AS blocked, count(*) FILTER (error_id = 0) AS clean, count(*) FILTER (error_id > 0) AS flagged FROM verdict GROUP BY locale",
    "sentence_lint": r"""WITH line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i
       FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\|[^\n]*\|', chr(10), 'g') AS t FROM documents)),
     said AS (SELECT doc_id, i, CASE WHEN l = '' OR left(l, 1) IN ('#', '-', '*', '>', '|') OR starts_with(l, '===') OR regexp_matches(l, '^\d+\.')
       THEN '. ' || CASE WHEN regexp_matches(l, '^\d+\.') THEN regexp_replace(l, '^\d+\.\s*', '') ELSE ltrim(ltrim(l, '#>*-')) END ELSE l END AS l FROM (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS l FROM line)),
     doc AS (SELECT doc_id, regexp_replace(string_agg(l, ' ' ORDER BY i), '\s+', ' ', 'g') AS t FROM said GROUP BY doc_id),
     sent AS (SELECT doc_id, trim(unnest(regexp_extract_all(t, '[^.!?]+[.!?]')), ' .') AS s FROM doc),
     n AS (SELECT doc_id, len(string_split(s, ' ')) AS n FROM sent WHERE s <> '')
     SELECT d.doc_id, count(n) FILTER (n >= 4) AS sentences, count(n) FILTER (n > 28) AS long FROM documents d LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""",
}
