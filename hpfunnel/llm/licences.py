"""Licence scan by a positional rare-token index.

Templates (licence notices and short phrases) are word sequences.  A pass
over all documents counts in how many of them each template word occurs;
the index then holds, for every template, the positions of its rarest
(highest-IDF) words only.  A file looks its own words up in that index.
Postings of one template that agree on the relative position give a
candidate place; there the whole template is compared word by word and its
mandatory key phrases must stand in the text.

Phrase templates are indexed by their single rarest word and must match in
full, so every place of a phrase is found.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, packed, unpacked

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Rare words a notice is indexed by, how many of them must agree, words by
#: which a copied notice may be out of place, least IDF share for a match.
RARE, AGREE, SLACK, SHARE = 4, 2, 2, 0.6


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, then runs of 0-9, a-z and non-ASCII."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


@dataclass(frozen=True)
class Template:
    """A licence notice (``keys``: phrases that must stand in it) or, with
    ``exact``, a phrase that must match word for word."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    exact: bool = False
    words: tuple[bytes, ...] = field(init=False)
    key_words: tuple[tuple[bytes, ...], ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "words", tuple(words_of(self.text)))
        object.__setattr__(self, "key_words", tuple(tuple(words_of(k)) for k in self.keys))


# Phrases with their labels.
PHRASES = (
    Template("cc-by", "cc by", exact=True),
    Template("gpl", "general public license", exact=True),
    Template("reserved", "all rights reserved", exact=True),
)
# Public licence notices.
NOTICES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
             "file except in compliance with the License. You may obtain a copy of the License at "
             "http://www.apache.org/licenses/LICENSE-2.0", ("apache license", "version 2")),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
             "provided that the following conditions are met", ("source and binary forms", "are permitted")),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License",
             ("creative commons attribution", "4 0")),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa",)),
    Template("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of "
             "the GNU General Public License as published by the Free Software Foundation; either version 2 of the "
             "License", ("general public license", "version 2")),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3",
             ("general public license", "version 3")),
    Template("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of "
             "the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
             "License", ("general public license", "version 3")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
             "fee is hereby granted", ("with or without fee", "hereby granted")),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
             "and associated documentation files (the \"Software\"), to deal in the Software without restriction",
             ("permission is hereby granted", "free of charge")),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Licensed under the MIT License", ("mit license",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
             ("mozilla public license", "2 0")),
    Template("unlicense", "This is free and unencumbered software released into the public domain",
             ("unencumbered software", "public domain")),
)

FOUND = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("exact", T.BooleanType()),
    T.StructField("start", T.LongType()),
    T.StructField("share", T.DoubleType()),
])
SCHEMA = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("found", T.ArrayType(FOUND))])


def document_frequencies(texts: DataFrame, vocabulary: list[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many of all documents each vocabulary word occurs, and their number.

    One pass over the column ``text``; each task sends a row for each
    vocabulary word it saw, so what comes back is bounded by the templates.
    """
    ids = {w: i for i, w in enumerate(vocabulary)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, int] = defaultdict(int)
        for b in batches:
            seen[-1] += len(b)
            for t in b["text"]:
                for w in ids.keys() & words_of(t):
                    seen[ids[w]] += 1
        yield pd.DataFrame({"id": list(seen), "n": list(seen.values())}, dtype="int64")

    rows = texts.select("text").mapInPandas(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    counts = {r["id"]: r["n"] for r in rows.collect()}
    return {w: counts.get(i, 0) for w, i in ids.items()}, counts.get(-1, 0)


def build_index(templates: tuple[Template, ...], idf: dict[bytes, float]) -> dict[bytes, list[tuple[int, int]]]:
    """Rare word -> (template, position in it); ties in IDF by the word itself."""
    index: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    for t, template in enumerate(templates):
        rare = sorted(set(template.words), key=lambda w: (-idf[w], w))[:1 if template.exact else RARE]
        for q, w in enumerate(template.words):
            if w in rare and (not template.exact or q == template.words.index(w)):
                index[w].append((t, q))
    return index


def _stands_in(phrase: tuple[bytes, ...], words: list[bytes]) -> bool:
    n = len(phrase)
    return any(tuple(words[i:i + n]) == phrase for i in range(len(words) - n + 1))


def scan(words: list[bytes], templates: tuple[Template, ...], index: dict[bytes, list[tuple[int, int]]],
         idf: dict[bytes, float]) -> list[tuple[str, bool, int, float]]:
    """Places of templates in a text: (label, exact, start, IDF share)."""
    places: dict[tuple[int, int], set[int]] = defaultdict(set)
    for p, w in enumerate(words):
        if w in index:
            for t, q in index[w]:
                places[t, p - q].add(q)
    found = []
    for (t, at), hits in places.items():
        template = templates[t]
        m = len(template.words)
        if template.exact:
            if at >= 0 and tuple(words[at:at + m]) == template.words:
                found.append((template.label, True, at, 1.0))
            continue
        near = set().union(*(places.get((t, at + s), ()) for s in range(-SLACK, SLACK + 1)))
        if len(near) < AGREE or not hits:
            continue
        window = words[max(0, at - SLACK):max(0, at + m + SLACK)]
        if not all(_stands_in(k, window) for k in template.key_words):
            continue
        total = got = 0.0
        for i, w in enumerate(template.words):
            total += idf[w]
            lo = at + i - SLACK
            if w in words[max(0, lo):max(0, lo + 2 * SLACK + 1)]:
                got += idf[w]
        if got >= SHARE * total:
            found.append((template.label, False, max(at, 0), got / total))
    return sorted(found, key=lambda x: (x[2], x[0], -x[3]))


def scan_licences(df: DataFrame, text_col: str = "text", phrases: tuple[Template, ...] = PHRASES,
                  notices: tuple[Template, ...] = NOTICES) -> DataFrame:
    """Add ``n_words`` and ``found`` (label, exact, start word, share) to every row.

    ``found`` lists all places of all phrases and the accepted places of
    notices, by start.  A null or empty text has no words and an empty list.
    Word frequencies come from all rows.  Repeated rows get the same result;
    an empty table gives an empty one; input columns named like an output
    are replaced.
    """
    columns = df.columns
    templates = (*phrases, *notices)
    vocabulary = sorted({w for t in templates for w in t.words})
    rows = packed(bounded_batches(df), text=text_col)
    counts, n = document_frequencies(rows, vocabulary)
    idf = {w: log(1 + (n + 1) / (c + 1)) for w, c in counts.items()}
    index = build_index(templates, idf)

    @F.pandas_udf(SCHEMA)
    def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = FOUND.names
        for texts in batches:
            sizes, found = [], []
            for t in texts:
                words = words_of(t)
                sizes.append(len(words))
                found.append([dict(zip(names, x)) for x in scan(words, templates, index, idf)])
            yield pd.DataFrame({"n_words": sizes, "found": found})

    scanned = rows.select("doc", look_up("text").alias("s"))
    return unpacked(scanned, columns, {c: F.col("s").getField(c) for c in SCHEMA.names})


def licence_summary(scanned: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and the digest of ``scan_licences``' places."""
    base = F.filter("found", lambda x: x["exact"])
    starts = F.transform(base, lambda x: x["start"])

    def labels(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda x: x["label"]))), ",")

    return scanned.select(
        *keep, "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)).alias("score"))
