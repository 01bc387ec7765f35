"""Text normalization with a map back to the original characters.

A text becomes an array of folded characters, each with the place of its source.
Folding is free of context, so it is a table: compatibility decomposition, marks
dropped, lower case, look-alikes, and digits and signs that stand for letters. The
boundary form keeps a space for each run of separators; the evasion form drops
separators and shrinks runs of three or more equal characters. Places are code
points, from 0; spans are half-open.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cyrillic and Greek letters and the Latin ones that they pass for.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "т": "t", "ο": "o", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "α": "a", "β": "b", "γ": "y", "σ": "o", "υ": "u", "χ": "x"}
# Digits and signs and the letters that they stand for.
LEET = {"4": "a", "@": "a", "8": "b", "3": "e", "6": "g", "9": "g", "1": "i", "!": "i", "|": "i", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "2": "z"}
# Characters that split words, besides white space.
SEPARATORS = " \t._-*'\"`^~,;:()[]{}<>/\\|"
# Characters without width, dropped before folding.
ZERO_WIDTH = "​‌‍﻿⁠­"
# What counts as white space besides.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
ALNUM = r"[\p{L}\p{N}]"
HANGUL = range(0xAC00, 0xD7A4)


def fold_text(ch: str, leet: bool = True) -> str:
    """One character folded, in Python; it may become none or several."""
    if ch in ZERO_WIDTH:
        return ""
    plain = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", ch))
    out = "".join(c for c in plain if unicodedata.category(c) != "Mn").lower()
    out = "".join(LOOKALIKES.get(c, c) for c in out)
    return "".join(LEET.get(c, c) for c in out) if leet else out


@lru_cache(2)
def fold_table(leet: bool) -> tuple[str, str, dict[str, str]]:
    """Characters to replace by one, these (then characters to drop), and those that become
    several; Hangul syllables, which follow a rule, aren't in it."""
    one, to, gone, many = [], [], [], {}
    for cp in (*range(0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE01F0)):
        ch = chr(cp)
        out = fold_text(ch, leet) if cp not in HANGUL else ch
        if out == ch:
            continue
        if not out:
            gone.append(ch)
        elif len(out) == 1:
            one.append(ch)
            to.append(out)
        else:
            many[ch] = out
    return "".join(one + gone), "".join(to), many


def ranges(chars) -> str:
    """A Java character class of these characters."""
    out, cps = [], sorted(map(ord, chars))
    i = 0
    while i < len(cps):
        j = i
        while j + 1 < len(cps) and cps[j + 1] == cps[j] + 1:
            j += 1
        out.append(f"\\x{{{cps[i]:x}}}" + (f"-\\x{{{cps[j]:x}}}" if j > i else ""))
        i = j + 1
    return "[" + "".join(out) + "]"


def several(many: dict[str, str]) -> Column:
    """The characters that become several, as a map; one literal, however long."""
    return F.from_json(F.lit(json.dumps(many)), "map<string,string>")


def fold(c: Column, leet: bool = True) -> Column:
    """fold_text() of a column of single characters."""
    one, to, many = fold_table(leet)
    number = F.ascii(c) - 0xAC00
    jamo = lambda first, n, i: F.substring(F.lit("".join(chr(first + k) for k in range(n))), (i + 1).cast("int"), F.lit(1))
    tail = F.when(number % 28 == 0, F.lit("")).otherwise(jamo(0x11A7, 28, number % 28))
    hangul = F.concat(jamo(0x1100, 19, F.floor(number / 588)), jamo(0x1161, 21, F.floor(number % 588 / 28)), tail)
    return F.when(c.rlike(ranges(many)), F.element_at(several(many), c)).when(c.rlike(r"[\x{ac00}-\x{d7a3}]"), hangul).otherwise(F.translate(c, one, to))


@lru_cache(2)
def uneven(leet: bool) -> str:
    """The class of the characters that become none or several."""
    one, to, many = fold_table(leet)
    return ranges({*many, *one[len(to) :], *map(chr, HANGUL)})


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def is_separator(c: Column) -> Column:
    """Of a column of single characters."""
    return F.lit("".join(sorted(set(SEPARATORS) | set(SPACES)))).contains(c)


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that the optimizer neither copies into their uses nor into filters that
    it pushes down, as it can't look through a generator: each is computed once a row."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def places(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def folded(df: DataFrame, text: str = "text", leet: bool = True) -> DataFrame:
    """Adds `folded`, the folded characters, and `source`, the place that each comes from;
    that is null where every character becomes one, so places are the same. Such texts,
    nearly all, are translated as a whole."""
    one, to, many = fold_table(leet)
    plain = F.octet_length(text) == F.length(text)
    odd = F.regexp_replace(text, r"[\x00-\x7f]+", "").rlike(uneven(leet))
    df = settled(df, _even=plain | ~odd)
    each = F.transform(characters(F.col(text)), lambda c, i: F.transform(characters(fold(c, leet)), lambda f: F.struct(f.alias("c"), i.alias("i"))))
    df = settled(df, _pairs=F.when(~F.col("_even"), F.flatten(each)))
    whole = characters(F.translate(text, one, to))
    return settled(df, folded=F.when(F.col("_even"), whole).otherwise(F.transform("_pairs", lambda x: x["c"])), source=F.transform("_pairs", lambda x: x["i"])).drop("_even", "_pairs")


def normalized(df: DataFrame, text: str = "text", leet: bool = True, keep_folded: bool = False) -> DataFrame:
    """Adds `boundary` and `evasion`: struct<text, src array<struct<s, e>>>. Null texts
    have null forms. With keep_folded the folded characters, their sources and `flat`,
    the folded text, stay. Runs are only looked for in texts that have one to shrink."""
    df = folded(df, text, leet)
    at = lambda j: F.get("folded", j)
    source = lambda j: F.coalesce(F.get("source", j), j)
    n = F.size("folded")
    gap = lambda j: F.coalesce(is_separator(at(j)), F.lit(True))
    df = settled(df, _keep=F.filter(places(n), lambda j: ~gap(j) | ~gap(j - 1)), flat=F.array_join("folded", ""))
    df = settled(df, _long=F.col("flat").rlike(r"(?s)(.)\1\1"))
    df = settled(df, _runs=F.when(F.col("_long"), F.filter(places(n), lambda j: (j == 0) | (at(j) != at(j - 1)))))
    one = lambda c, s, e: F.struct(c.alias("c"), s.alias("s"), e.alias("e"))
    none = F.array().cast("array<struct<c:string,s:int,e:int>>")

    def lean(j: Column, k: Column) -> Column:
        """What the evasion form keeps of run k, which begins at j."""
        end = F.coalesce(F.get("_runs", k + 1), n)
        short = F.transform(F.sequence(j, end - 1), lambda m: one(at(j), source(m), source(m) + 1))
        return F.when(is_separator(at(j)), none).when(end - j >= 3, F.array(one(at(j), source(j), source(end - 1) + 1))).otherwise(short)

    df = settled(df, _lean=F.flatten(F.transform("_runs", lean)))
    wide = lambda js: F.transform(js, lambda j: F.struct(source(j).alias("s"), (source(j) + 1).alias("e")))
    gaps = ranges(sorted(set(SEPARATORS) | set(SPACES)))
    boundary = F.struct(F.regexp_replace(F.regexp_replace("flat", f"^{gaps}+", ""), f"{gaps}+", " ").alias("text"), wide("_keep").alias("src"))
    shrunk = F.struct(F.array_join(F.transform("_lean", lambda x: x["c"]), "").alias("text"), F.transform("_lean", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias("src"))
    plain = F.struct(F.regexp_replace("flat", f"{gaps}+", "").alias("text"), wide(F.filter("_keep", lambda j: ~gap(j))).alias("src"))
    known = F.col(text).isNotNull()
    out = settled(df, boundary=F.when(known, boundary), evasion=F.when(known, F.when(F.col("_long"), shrunk).otherwise(plain))).drop("_keep", "_long", "_runs", "_lean")
    return out if keep_folded else out.drop("folded", "source", "flat")


def span(src: Column, start: Column, end: Column) -> Column:
    """struct<s, e>: the original characters of a span of a form; 0, 0 if it is outside."""
    inside = (F.size(src) > 0) & (start < F.size(src))
    s = F.when(inside, F.get(src, start)["s"]).otherwise(F.lit(0))
    e = F.when(inside, F.get(src, F.least(end, F.size(src)) - 1)["e"]).otherwise(F.lit(0))
    return F.struct(s.alias("s"), e.alias("e"))


def term_form(df: DataFrame, term: str = "text", out: str = "term") -> DataFrame:
    """Adds the boundary form without spaces, as terms are compared; rows that it leaves
    empty go."""
    df = normalized(df, term).withColumn(out, F.replace(F.col("boundary.text"), F.lit(" "), F.lit(""))).drop("boundary", "evasion")
    return df.filter(F.length(out) > 0)


def normalize_text(text: str, condense: bool = False, leet: bool = True) -> tuple[str, list[tuple[int, int]]]:
    """The same in Python, for Arrow functions and tests: form and source spans."""
    flat = [(c, i) for i, ch in enumerate(text) for c in fold_text(ch, leet)]
    gap = set(SEPARATORS) | set(SPACES)
    out: list[tuple[str, int, int]] = []
    j = 0
    while j < len(flat):
        c, i = flat[j]
        k = j + 1
        if c in gap:
            if not condense and j and flat[j - 1][0] not in gap:
                out.append((" ", i, i + 1))
        else:
            while condense and k < len(flat) and flat[k][0] == c:
                k += 1
            if k - j >= 3:
                out.append((c, i, flat[k - 1][1] + 1))
            else:
                out += [(c, flat[m][1], flat[m][1] + 1) for m in range(j, k)]
        j = k
    return "".join(c for c, _, _ in out), [(s, e) for _, s, e in out]
