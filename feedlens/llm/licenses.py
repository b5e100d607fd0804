"""Licence scans with a positional index of rare words, in DataFrame functions only.

The index holds, for each licence template, postings (template, position) of its rarest
words, by inverse document frequency over the whole corpus.  A file's words are looked up;
each posting says where its template would start in the file, and only starts on which the
postings of all of a template's rarest words agree go on.  A start is confirmed if the
template's mandatory phrase stands there word for word and enough of the other words
stand at their places.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD_CHARS = r"0-9A-Za-z\x{80}-\x{10FFFF}"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least share of a template's words that must stand at their places.
SHARE = 0.6
#: Rarest words of each template whose postings must agree.
ANCHORS = 2


@dataclass(frozen=True)
class Template:
    """Words of a licence notice; ``phrase`` is the part of it that must stand there."""

    label: str
    text: str
    phrase: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key(self) -> list[str]:
        return self.phrase.split()

    @property
    def key_at(self) -> int:
        words, key = self.words, self.key
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


#: Wording of well-known licence notices, punctuation dropped.
TEMPLATES = (
    Template("cc-by", "cc by", "cc by", True),
    Template("gpl", "general public license", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied",
        "unless required by applicable law or agreed to in writing",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution",
        "redistributions of source code must retain the above copyright notice",
    ),
    Template(
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation either version 3 of the license or at your option any later version",
        "either version 3 of the license",
    ),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the above copyright notice and this permission notice shall be included",
    ),
    Template(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 "
        "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        "a copy of the mpl was not distributed with this file",
    ),
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc0", "cc0 1 0 universal", "cc0 1 0"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("public-domain", "released into the public domain", "into the public domain"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Number of documents with each word of a (small, fixed) vocabulary, over all documents."""
    if not vocabulary:
        return {}
    pattern = rf"(?i)(?<![{_WORD_CHARS}])(?:{'|'.join(sorted(vocabulary))})(?![{_WORD_CHARS}])"
    seen = F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda w: F.translate(w, UPPER, LOWER))
    counts = docs.select(F.explode(F.array_distinct(seen)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return {r["word"]: r["df"] for r in counts.collect()}


def _literal_words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _anchors(template: Template, idf: dict[str, float]) -> list[str]:
    """The rarest words of the mandatory phrase, ANCHORS of them (the last one again if it has fewer)."""
    words = sorted(set(template.key), key=lambda w: (-idf[w], w))
    return (words + words[-1:] * ANCHORS)[:ANCHORS]


#: Starts of templates are one number each, so that they intersect by hash.
_TEMPLATES_AT_MOST = 1024


def _starts(hits: Column, postings: dict[str, list[tuple[int, int]]]) -> Column:
    """Where, and of which template, each hit's postings say that a template starts."""
    index = F.create_map(
        *[x for word, own in sorted(postings.items()) for x in (F.lit(word), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(at).alias("at")) for t, at in own]))]
    )
    named = F.filter(hits, lambda h: h["w"].isin(sorted(postings)))
    return F.flatten(
        F.transform(named, lambda h: F.transform(F.element_at(index, h["w"]), lambda p: (h["i"] - p["at"]).cast("long") * _TEMPLATES_AT_MOST + p["t"]))
    )


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, share: float = SHARE) -> DataFrame:
    """Adds n_words and matches, an array of (template, label, base, start, share) by start, to documents.

    ``start`` is the word (from 0) where the template's mandatory phrase begins; matches
    with one start are ordered by template.  A null text is empty: no words, no matches.
    Long texts are read whole.  All of repeated rows, and none of an empty table, are
    returned.  A column named n_words or matches is replaced; all others stay.
    """
    if len(templates) > _TEMPLATES_AT_MOST:
        raise ValueError(f"more than {_TEMPLATES_AT_MOST} templates")
    vocabulary = sorted({w for t in templates for w in t.key})
    df = document_frequencies(docs, vocabulary)
    total = docs.count()
    idf = {w: math.log((total + 1) / (df.get(w, 0) + 1)) for w in vocabulary}
    ranked: list[dict[str, list[tuple[int, int]]]] = [{} for _ in range(ANCHORS)]
    for i, t in enumerate(templates):
        for own, word in zip(ranked, _anchors(t, idf), strict=True):
            # a word that the phrase repeats may stand at any of its places
            own.setdefault(word, []).extend((i, t.key_at + j) for j, w in enumerate(t.key) if w == word)
    shelf = F.array(
        *[
            F.struct(
                F.lit(t.label).alias("label"),
                F.lit(t.base).alias("base"),
                F.lit(t.key_at).alias("key_at"),
                _literal_words(t.key).alias("key"),
                _literal_words(t.words).alias("words"),
            )
            for t in templates
        ]
    )
    rows = docs.drop("n_words", "matches")
    taken = {c.lower() for c in rows.columns}
    w, hit, sure = (next(x for x in (f"_{name}{i}" for i in range(len(taken) + 1)) if x not in taken) for name in ("w", "hit", "sure"))
    text = F.coalesce("text", F.lit(""))
    maybe = text.rlike(f"(?i){'|'.join(sorted(ranked[0]))}")
    words = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))
    rows = rows.withColumn("n_words", F.regexp_count(text, F.lit(_ANY_CASE_WORD)).cast("long"))
    rows = rows.withColumn(w, F.when(maybe, words))
    named = F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i")))
    rows = rows.withColumn(hit, F.filter(named, lambda h: h["w"].isin(sorted({x for own in ranked for x in own}))))
    agreed = functools.reduce(F.array_intersect, [_starts(F.col(hit), own) for own in ranked])
    starts = F.transform(agreed, lambda c: F.struct(F.pmod(c, F.lit(_TEMPLATES_AT_MOST)).cast("int").alias("t"), F.shiftright(c, 10).cast("int").alias("off")))
    placed = F.transform(starts, lambda s: F.struct(s["t"].alias("t"), s["off"].alias("off"), F.get(shelf, s["t"]).alias("x")))
    placed = F.filter(placed, lambda s: s["off"] + s["x"]["key_at"] >= 0)
    rows = rows.withColumn(sure, F.filter(placed, lambda s: F.slice(w, s["off"] + s["x"]["key_at"] + 1, F.size(s["x"]["key"])) == s["x"]["key"]))

    def agreeing(s: Column) -> Column:
        here = F.transform(s["x"]["words"], lambda x, j: F.when(F.get(F.col(w), s["off"] + j) == x, 1).otherwise(0))
        return F.round(F.aggregate(here, F.lit(0), lambda a, x: a + x) / F.size(s["x"]["words"]), 6)

    found = F.transform(
        sure,
        lambda s: F.struct(
            (s["off"] + s["x"]["key_at"]).cast("long").alias("start"),
            s["t"].alias("template"),
            s["x"]["label"].alias("label"),
            s["x"]["base"].alias("base"),
            agreeing(s).alias("share"),
        ),
    )
    rows = rows.withColumn("matches", F.array_sort(F.filter(found, lambda m: m["share"] >= share)))
    empty = F.array().cast(rows.schema["matches"].dataType)
    return rows.withColumn("matches", F.coalesce("matches", empty)).drop(w, hit, sure)


def summary(scanned: DataFrame) -> DataFrame:
    """Per row: n_words, places of base phrases, their first and last word, labels and the best share."""
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    joined = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda m: m["label"]))), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"),
    )
