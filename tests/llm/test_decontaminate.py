import random
import re

import pytest
from pyspark.sql import functions as F

from hpfunnel.llm import decontaminate as K
from tests.llm.helpers import as_dicts, by_id, docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    """(n_words, hit places, ids) by comparing every window with every place."""
    w, hit, ids = words(text), set(), set()
    for item, passage in items:
        b = words(passage)
        n = min(window, len(b))
        for p in range(len(b) - n + 1 if n else 0):
            for at in range(len(w) - n + 1):
                if w[at:at + n] == b[p:p + n]:
                    hit |= set(range(at, at + n))
                    ids |= {item} - {None}
    return len(w), hit, sorted(ids)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def same(found, texts, items):
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        n, hit, ids = brute(text, items)
        r = found[i]
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (n, len(hit), ids, bool(hit)), text
        assert {x for s in r["spans"] for x in range(s["start"], s["end"])} == hit
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))


@pytest.mark.parametrize("part_bytes", [60, 8 << 20])
def test_equals_brute_force(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(K, "PART_BYTES", part_bytes)  # 60: many parts, joined afterwards
    monkeypatch.setattr(K, "SEGMENT_WINDOWS", 3)
    rng = random.Random(1)
    vocabulary = ["a", "b", "C", "é", "7"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([2, 5, 9, 10, 11, 14, 40])))) for i in range(12)]
    items += [(3, items[3][1]), (99, items[5][1]), (50, None), (51, ""), (52, "...")]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 60))) for _ in range(40)]
    texts += [items[k % 12][1].upper() + ", " + " ".join(rng.choices(vocabulary, k=12)) + "\n" + items[7][1] for k in range(20)]
    found = by_id(K.scan_benchmark(docs(spark, texts), benchmark(spark, items)))
    same(found, texts, items)


def test_edges(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    items = [(1, passage), (None, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich"), (2, "needle")]
    texts = [None, "", "  ", passage, "one two three four five six seven eight nine", "NEEDLE", "needles", passage + " " + passage,
             "x " * 100_000 + passage, items[1][1] + "!", "É needle É".lower(), passage, "İ K needle"]
    df = docs(spark, texts).withColumns({"items": F.lit("i"), "Spans": F.lit(1), "no": F.lit(2), "doc": F.lit(3), "a.b": F.lit(4)})
    found = by_id(K.scan_benchmark(df, benchmark(spark, items)))
    same(found, texts, items)
    assert found[0]["a.b"] == 4 and found[0]["no"] == 2 and "Spans" not in found[0]
    assert found[9]["n_hit"] == 10 and found[9]["items"] == []
    assert as_dicts(K.scan_benchmark(df.limit(0), benchmark(spark, items))) == []
    none = by_id(K.scan_benchmark(df, benchmark(spark, items).limit(0)))
    same(none, texts, [])


def test_removes_spans_or_documents(spark):
    passage = "One two three, four five six seven eight nine ten"
    texts = ["Keep this. " + passage + "! And this.", "clean text", None, passage, "a\n" + passage + "\nb " + passage + "."]
    df = docs(spark, texts).withColumn("row", F.lit("r"))
    bench = benchmark(spark, [(1, passage)])
    cut = by_id(K.decontaminate(df, bench))
    assert [cut[i]["text"] for i in range(5)] == ["Keep this. ! And this.", "clean text", None, "", "a\n\nb ."]
    assert cut[0]["row"] == "r" and list(cut[0]) == df.columns
    assert set(by_id(K.decontaminate(df, bench, remove="documents"))) == {1, 2}
    again = by_id(K.scan_benchmark(K.decontaminate(df, bench), bench))
    assert not any(r["contaminated"] for r in again.values())
    with pytest.raises(ValueError):
        K.decontaminate(df, bench, remove="all")


def test_parts_are_bounded(spark):
    from hpfunnel.llm.common import parts_of
    df = spark.createDataFrame([(i, 1 + i % 7) for i in range(500)] + [(1000, 90)], "a long, size long")
    got = parts_of(df, "size", 20).groupBy("part").agg(F.sum("size").alias("s")).collect()
    assert max(r["s"] for r in got) <= 90 + 40 and sum(r["s"] for r in got) == df.agg(F.sum("size")).first()[0]
    assert {r["s"] for r in got if r["s"] > 40} <= {r["s"] for r in got if r["s"] >= 90}
    assert parts_of(df.limit(0), "size", 20).count() == 0
