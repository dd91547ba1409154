import random

from pyspark.sql import functions as F

from hpfunnel.llm import licences as L
from tests.llm.helpers import as_dicts, by_id, docs

PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}


def brute(text):
    words, places, labels = L.words_of(text), [], set()
    for label, phrase in PHRASES.items():
        p = tuple(phrase.encode().split())
        for i in range(len(words)):
            if tuple(words[i:i + len(p)]) == p:
                places.append(i)
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def test_base_places_equal_brute_force(spark):
    rng = random.Random(3)
    pool = ["cc", "BY", "by", "general", "Public", "license", "all", "rights", "reserved", "x", "é", "cc-by", "CC_BY"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [None, "", "\n", "all all rights reserved reserved", "cc cc by by", "CC BY " * 4000, "ccby", "cçby cc  by"]
    got = by_id(L.licence_summary(L.scan_licences(docs(spark, texts)), "doc_id"))
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_notices(spark):
    texts = ["bla bla. Released under the MIT License.\nbla", "Licensed under the Apache License, Version 2.0.",
             "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.",
             "released under the license of version 2.0", "the MIT people", "mit released under license the",
             "Permission is hereby granted, free of charge, to any person obtaining one copy of this software and "
             "the associated documentation files, to deal in the Software without restriction"]
    got = by_id(L.licence_summary(L.scan_licences(docs(spark, texts)), "doc_id"))
    assert [got[i]["labels"] for i in range(len(texts))] == [
        "mit", "apache-2.0", "gpl,gpl-3.0", "cc-by,cc-by-nc-4.0", "", "", "", "mit"]
    assert got[0]["score"] == 1 and got[4]["score"] == 0 and 0.6 <= got[7]["score"] < 1


def test_frequencies_cover_all_rows_and_clashes(spark):
    df = docs(spark, ["mit mit", "MIT", None, "x"] * 50).withColumns({"FOUND": F.lit(1), "text_": F.lit("mit")})
    counts, n = L.document_frequencies(df, [b"mit", b"apache"])
    assert n == 200 and counts == {b"mit": 100, b"apache": 0}
    out = L.scan_licences(df)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "text_", "n_words", "found"]
    assert as_dicts(L.scan_licences(df.limit(0))) == []
