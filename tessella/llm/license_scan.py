"""License scans with a positional index of rare words, in DataFrame operations only.

The document frequency of every licence word is counted over all documents. Each
template is indexed by its rarest words: word -> (template, place). All index words
of a file are looked up, at every place; a word found at place i that stands at place p of a template votes for an occurrence that starts at i - p,
so intersecting the postings by relative position is counting equal votes.
Candidates with enough votes are verified: the template's mandatory phrases must
stand at their places. Short phrases are found the same way, by the position of
their rarest word, at every place.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases of which every place is counted, with their labels.
PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)

# Sentences by which common licences are known, with their labels and
# the phrases that must be there.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("free software", "gnu general public license")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "is hereby granted")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "obtaining a copy")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words with ASCII letters in lower case. The two other characters that lower()
    would turn into ASCII are put aside first."""
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ÿ")), F.lit("İ"), F.lit("ÿ"))
    return F.regexp_extract_all(F.lower(plain), F.lit(WORD), F.lit(0))


def literal_array(xs: list[str]) -> Column:
    return F.array(*(F.lit(x) for x in xs)) if xs else F.array().cast("array<string>")


def document_frequency(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """words: one column `words`. What comes to the driver is one row per licence word."""
    found = words.select(F.explode(F.array_intersect(literal_array(vocabulary), F.col("words"))).alias("w"))
    df = {r.w: r.n for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return {w: df.get(w, 0) for w in vocabulary}


def stands_at(words: Column, start: Column, phrase: list[str]) -> Column:
    out = F.get(words, start).eqNullSafe(F.lit(phrase[0]))
    for j, w in enumerate(phrase[1:], 1):
        out = out & F.get(words, start + j).eqNullSafe(F.lit(w))
    return out


def place(sentence: list[str], phrase: list[str]) -> int:
    for i in range(len(sentence) - len(phrase) + 1):
        if sentence[i : i + len(phrase)] == phrase:
            return i
    raise ValueError(f"{' '.join(phrase)!r} isn't in its template")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, index_words: int = 6, votes: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, n_words, places (array of struct<label, start>, all
    places of the phrases, starts counted in words), matches (array of struct<label,
    start, score> of verified templates, score being the share of its index words that
    voted). Null and empty texts have no words and no matches; repeated rows are
    scanned each; other columns are left out; no rows for no documents."""
    split = lambda s: re.findall(WORD, s.lower())
    phrases = [(label, split(p)) for label, p in phrases]
    templates = [(label, split(t), [split(p) for p in must]) for label, t, must in templates]
    vocabulary = sorted({w for _, p in phrases for w in p} | {w for _, t, _ in templates for w in t})
    rows = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    df = document_frequency(rows.select("words"), vocabulary)
    rarity = lambda w: (df[w], w)

    postings: dict[str, list[tuple[int, int]]] = {}
    for t, (_, sentence, _) in enumerate(templates):
        for w in sorted(set(sentence), key=rarity)[:index_words]:
            postings.setdefault(w, []).extend((t, i) for i, x in enumerate(sentence) if x == w)
    rarest = {label: min(p, key=rarity) for label, p in phrases}
    wanted = sorted({*postings, *rarest.values()})

    words = F.col("words")
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(*wanted))
    rows = rows.withColumn("hits", hits)

    def places(label: str, phrase: list[str]) -> Column:
        at = phrase.index(rarest[label])
        starts = F.transform(F.filter("hits", lambda h: h["w"] == rarest[label]), lambda h: h["i"] - at)
        good = F.filter(starts, lambda s: (s >= 0) & stands_at(words, F.greatest(s, F.lit(0)), phrase))
        return F.transform(good, lambda s: F.struct(F.lit(label).alias("label"), s.alias("start")))

    if phrases:
        found = F.concat(*(places(label, p) for label, p in phrases))
    else:
        found = F.array().cast("array<struct<label:string,start:int>>")

    def votes_of(h: Column) -> Column:
        out = F.array().cast("array<struct<t:int,s:int>>")
        for w, at in postings.items():
            out = F.when(h["w"] == w, F.array(*(F.struct(F.lit(t).alias("t"), (h["i"] - p).cast("int").alias("s")) for t, p in at))).otherwise(out)
        return out

    cast = F.array_sort(F.flatten(F.transform("hits", votes_of)))
    start = F.expr("named_struct('t', -1, 's', 0, 'n', 0, 'out', cast(array() as array<struct<t:int,s:int,n:int>>))")

    def count(acc: Column, x: Column) -> Column:
        same = (acc["t"] == x["t"]) & (acc["s"] == x["s"])
        n = F.when(same, acc["n"] + 1).otherwise(F.lit(1))
        end = F.struct(acc["t"].alias("t"), acc["s"].alias("s"), acc["n"].alias("n"))
        out = F.when(~same & (acc["n"] >= votes), F.concat(acc["out"], F.array(end))).otherwise(acc["out"])
        return F.struct(x["t"].alias("t"), x["s"].alias("s"), n.alias("n"), out.alias("out"))

    stop = F.array(F.struct(F.lit(-2).alias("t"), F.lit(0).alias("s")))
    rows = rows.withColumn("candidates", F.aggregate(F.concat(cast, stop), start, count, lambda acc: acc["out"]))

    def verified(c: Column) -> Column:
        out = F.lit(False)
        for t, (_, sentence, must) in enumerate(templates):
            good = F.lit(True)
            for p in must:
                at = place(sentence, p)
                good = good & (c["s"] + at >= 0) & stands_at(words, F.greatest(c["s"] + at, F.lit(0)), p)
            out = F.when(c["t"] == t, good).otherwise(out)
        return out

    sizes = [sum(1 for at in postings.values() for x, _ in at if x == t) for t in range(len(templates))]

    def match(c: Column) -> Column:
        label, size = F.lit(""), F.lit(1)
        for t, (name, _, _) in enumerate(templates):
            label = F.when(c["t"] == t, F.lit(name)).otherwise(label)
            size = F.when(c["t"] == t, F.lit(sizes[t])).otherwise(size)
        return F.struct(label.alias("label"), c["s"].alias("start"), F.least(c["n"] / size, F.lit(1.0)).alias("score"))

    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), found.alias("places"), F.transform(F.filter("candidates", verified), match).alias("matches"))
