"""Text transforms: evasions, wrappers, substrings, markup and sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The frames in which a probe is sent, prefix and suffix.
CARRIERS = (("xx", "xx"), ("qz", "jv"), ("qz", "qz"), ("mm", "mm"), ("qw", "qw"))
# Letters and the digits, wide and Cyrillic forms that stand for them.
LEET_OUT = ("aeios", "43105")
WIDE_OUT = tuple("".join(chr(first + i) for i in range(94)) for first in (0x21, 0xFF01))
CYRILLIC_OUT = ("aeoc", "аеос")


def plain_tag(text: Column) -> Column:
    """Lower case, only a-z and digits."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def unwrap(word: Column, carriers=CARRIERS) -> Column:
    """struct<core, wrapped>: what the first fitting frame leaves, if that isn't empty."""
    core = F.lit(None).cast("string")
    for pre, post in reversed(carriers):
        fits = word.startswith(pre) & word.endswith(post) & (F.length(word) > len(pre) + len(post))
        core = F.when(fits, F.substring(word, F.lit(len(pre) + 1), F.length(word) - len(pre) - len(post))).otherwise(core)
    return F.struct(F.coalesce(core, word).alias("core"), core.isNotNull().alias("wrapped"))


def substrings(text: Column, low: int = 2, high: int = 12) -> Column:
    """Distinct lower-case substrings of low to high characters."""
    t = F.lower(text)
    most = F.least(F.lit(high), F.length(t))
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: F.substring(t, i, n))
    every = F.flatten(F.transform(F.sequence(F.lit(low), most), of))
    return F.when(F.length(t) >= low, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def ngrams(run: Column, low: int = 2, high: int = 4) -> Column:
    """All n-grams of a run, repeats included."""
    most = F.least(F.lit(high), F.length(run))
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substring(run, i, n))
    return F.when(F.length(run) >= low, F.flatten(F.transform(F.sequence(F.lit(low), most), of))).otherwise(F.array().cast("array<string>"))


def spread(term: Column, mark: str) -> Column:
    return F.array_join(F.filter(F.split(term, ""), lambda c: c != ""), mark)


def evasions(term: Column) -> dict[str, Column]:
    """The ways in which a term is disguised, by name."""
    cut = lambda at: F.substring(term, F.lit(at), F.length(term))
    first, second = F.substring(term, 1, 1), F.substring(term, 2, 1)
    return {
        "plain": term,
        "spaced": spread(term, " "),
        "dotted": spread(term, "."),
        "dashed": spread(term, "-"),
        "repeat": F.concat(first, F.repeat(second, 3), cut(3)),
        "leet": F.translate(term, *LEET_OUT),
        "fullwidth": F.translate(term, *WIDE_OUT),
        "cyrillic": F.translate(term, *CYRILLIC_OUT),
        "swap": F.when(F.length(term) > 2, F.concat(first, F.lit("v"), cut(3))).otherwise(term),
        "padded": F.concat(term, F.repeat(F.substring(term, -1, 1), 2)),
        "upper": F.upper(term),
    }


def strip_markup(html: Column) -> Column:
    """Without style and script blocks, tags and entities; white space shrunk."""
    out = F.regexp_replace(html, r"(?is)<(style|script)[^>]*>.*?</(style|script)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    out = F.regexp_replace(out, "&[a-z#0-9]+;", " ")
    return F.trim(F.regexp_replace(out, "[ \t\r\n]+", " "))


def strip_markdown(text: Column) -> Column:
    """Without fenced and inline code and links' targets."""
    out = F.regexp_replace(text, "(?s)```.*?```", " ")
    out = F.regexp_replace(out, "`[^`]*`", " ")
    return F.regexp_replace(out, r"\]\([^)]*\)", "]")


def sentences(text: Column, least: int = 4) -> Column:
    """Sentences of at least `least` words, without markup, tables and the marks of
    headings, lists and quotes; a blank or marked line breaks off the one before."""
    plain = F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\|[^\n]*\|", "\n")

    def broken(line: Column) -> Column:
        line = F.regexp_replace(line, r"^\s+|\s+$", "")
        marked = (line == "") | line.rlike(r"^(#|-|\*|>|\||===|\d+\.)")
        return F.when(marked, F.concat(F.lit(". "), F.regexp_replace(line, r"^([#>*\-]+\s*|\d+\.\s*)", ""))).otherwise(line)

    joined = F.regexp_replace(F.array_join(F.transform(F.split(plain, "\n"), broken), " "), r"\s+", " ")
    found = F.transform(F.regexp_extract_all(joined, F.lit("([^.!?]+[.!?])"), F.lit(1)), lambda s: F.regexp_replace(s, "^[ .]+|[ .]+$", ""))
    return F.filter(found, lambda s: (s != "") & (F.size(F.split(s, " ")) >= least))


def without_style(html: Column) -> Column:
    """What a page claims: without style blocks and tags."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<style\b.*?</style>", ""), "<[^>]+>", " ")
