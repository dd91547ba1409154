import zlib

import numpy as np
from pyspark.sql import functions as F

from hpfunnel.llm import langid as G
from hpfunnel.llm.queries import op9_language_id
from tests.llm.helpers import SF, as_dicts, by_id, docs


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 6, 12, 40):
        c = G.codewords(n)
        assert set(np.unique(c)) == {-1, 1} and len({r.tobytes() for r in c}) == n
        apart = min((c[i] != c[j]).sum() for i in range(n) for j in range(i))
        assert apart >= max(1, c.shape[1] // 4)


def test_grams_equal_brute_force():
    text = "Ab,  cé\n1ß!"
    plain = " ab cé ß "
    plain = " " + "".join(plain).strip() + "  "  # one space for a gap; one more for the end
    c = [ord(x) for x in plain]
    m = 0xFFFFFFFF
    one = [x * 0x9E3779B1 & m for x in c]
    two = [(a ^ (b * 0x85EBCA77 & m)) * 0xC2B2AE3D & m for a, b in zip(one, c[1:])]
    three = [(a ^ (b * 0x27D4EB2F & m)) * 0x165667B1 & m for a, b in zip(two, c[2:])]
    assert sorted(G.grams(text)) == sorted(x >> 18 for x in one + two + three)


def test_held_out_accuracy_and_contract(spark):
    rows = as_dicts(op9_language_id(spark, SF))
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(lang) and set(rows[0]) >= {"doc_id", "held_out", "lang_pred", "score"}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edges_and_no_leak(spark):
    texts = ["the cat and the dog", "der hund und die katze", "le chat et le chien"] * 40 + [None, "", "123 !?", "x" * 60_000]
    langs = ["en", "de", "fr"] * 40 + [None] * 4
    df = docs(spark, texts, langs).withColumns({"SCORE": F.lit("mine"), "s": F.lit(1), "doc": F.lit(2)})
    model = G.train(df)
    assert model.langs == ["de", "en", "fr"]
    got = by_id(G.identify(df, model))
    assert [got[i]["lang_pred"] for i in range(3)] == ["en", "de", "fr"]
    assert [got[120 + i]["lang_pred"] for i in range(3)] == ["und"] * 3 and got[123]["lang_pred"] in model.langs
    assert set(got[0]) == {*df.columns, "lang_pred", "score", "ambiguous"} - {"SCORE"}
    # labels of held-out rows, and of rows without a label, change nothing
    flipped = df.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "xx")
                            .otherwise(F.col("lang")))
    assert G.train(flipped).langs == model.langs
    assert np.array_equal(G.train(flipped).weights, model.weights)
    assert as_dicts(G.identify(df.limit(0), G.train(df.limit(0)))) == []
    assert by_id(G.identify(df, G.train(df.limit(0))))[0]["lang_pred"] == "und"
    one = G.train(df.filter("lang = 'en'"))
    assert by_id(G.identify(df, one))[1]["lang_pred"] == "en"


def test_sample_is_bounded(spark):
    df = docs(spark, ["the cat"] * 2000)
    model = G.train(df, rows=100)
    assert model.langs == ["en"]


def test_a_rare_language_is_learnt_beside_many_rows(spark):
    df = docs(spark, ["the cat and the dog"] * 3000 + ["der hund und die katze"] * 10, ["en"] * 3000 + ["de"] * 10)
    model = G.train(df, rows=100)
    assert model.langs == ["de", "en"]
    assert model.predict("die katze und der hund")[0] == "de"
    taken = G.sampled(df.select(F.col("doc_id").alias("id"), "text", "lang"), 100).groupBy("lang").count().collect()
    taken = {r["lang"]: r["count"] for r in taken}
    assert taken["de"] == 10 and 50 <= taken["en"] <= 150
