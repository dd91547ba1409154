import zlib

import numpy as np
from pyspark.sql import functions as F

from hpfunnel.llm import toxicity as X
from hpfunnel.llm.queries import op10_toxicity
from tests.llm.helpers import as_dicts, by_id, docs

SF = "/root/testdata/sf0.1"


def labels_for(spark, toxic, ids=None):
    rows = [(ids[i] if ids else i, 1, y) for i, y in enumerate(toxic)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus(n=400):
    texts = [f"the cat number {i} sat {'zorbag' if i % 5 == 0 else 'mat'} {'zorbagish' if i % 10 == 0 else ''} on it" for i in range(n)]
    return texts, [int(i % 5 == 0) for i in range(n)]


def test_features():
    f = dict(zip(X.NAMES, X.features("You IDIOT! you stuuupid m0ron, s t u p i d ???", X.Lexicon(X.SEED))))
    assert f["lexicon_log"] == np.log1p(1) and f["second_near"] == 1 and f["disguised_hits"] == 3
    assert f["exclaim_rate"] > 0 and f["question_rate"] > 0 and f["shouted_rate"] > 0
    assert X.features(None, X.Lexicon(X.SEED)) == X.features("", X.Lexicon(X.SEED))
    far = dict(zip(X.NAMES, X.features("you " + "x " * 9 + "idiot " * 3 + "x " * 60 + "idiot", X.Lexicon(X.SEED))))
    assert far["second_near"] == 0 and far["lexicon_window"] == 3


def test_boost_and_isotonic():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    t = X.boost(x, y)
    assert ((t.raw(x) > 0) == (y > 0)).mean() > 0.97
    at, p = X.isotonic(t.raw(x), y)
    assert (np.diff(at) > 0).all() and (np.diff(p) >= 0).all() and 0 < p.min() and p.max() < 1
    assert (X.boost(x, np.zeros(2000)).raw(x) < 0).all() and len(X.boost(x[:0], y[:0]).raw(x)) == 2000


def test_held_out_accuracy(spark):
    rows = by_id(op10_toxicity(spark, SF))
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    held = [(rows[r["doc_id"]]["score"], r["toxic"]) for r in labels if rows[r["doc_id"]]["held_out"]]
    good, bad = ([s for s, y in held if y == k] for k in (0, 1))
    auc = np.mean([(b > g) + (b == g) / 2 for b in bad for g in good])
    assert auc > 0.95 and np.mean([s >= 0.5 for s in good]) < 0.02


def test_learns_new_words_without_held_out_labels(spark):
    texts, toxic = corpus()
    df, labels = docs(spark, texts), labels_for(spark, toxic)
    model = X.train(df, labels)
    assert "zorb*" in model.lexicon or "zorbag" in model.lexicon
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = X.train(df, labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    got, same = by_id(X.score_toxicity(df, model)), by_id(X.score_toxicity(df, other))
    assert {i: r["score"] for i, r in got.items()} == {i: r["score"] for i, r in same.items()}
    assert np.mean([got[i]["predicted"] == y for i, y in enumerate(toxic)]) > 0.95


def test_edges(spark):
    df = docs(spark, [None, "", "x" * 100_000, "you idiot", "you idiot"], ids=[0, 1, 2, 3, 3]).withColumns(
        {"Score": F.lit("mine"), "s": F.lit(1), "doc": F.lit(2)})
    nothing = X.train(df, labels_for(spark, [None, None], [0, 1]))
    got = as_dicts(X.score_toxicity(df, nothing))
    assert len(got) == 5 and set(got[0]) == {*df.columns, "score", "predicted"} - {"Score"}
    assert all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["text"] in (None, "")}) == 1
    one = X.train(df, labels_for(spark, [0, 0, 0], [1, 2, 3]))
    assert all(r["predicted"] == 0 for r in as_dicts(X.score_toxicity(df, one)))
    assert as_dicts(X.score_toxicity(df.limit(0), X.train(df.limit(0), labels_for(spark, [], [])))) == []
