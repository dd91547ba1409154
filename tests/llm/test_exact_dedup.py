import hashlib
import string
from collections import defaultdict

from pyspark.sql import functions as F

from hpfunnel.llm import exact_dedup as X
from tests.llm.helpers import as_dicts, docs

TABLE = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def mark(df):
    return X.mark_copies(df.withColumn("digest", X.text_digest(F.col("text"))))


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(TABLE)].append(i)
    return {i: (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest())
            for t, g in groups.items() for i in g}


def test_marks_equal_brute_force(spark):
    texts = ["a b", "A B", "É", "é", None, "", "x" * 50_000, "X" * 50_000, "solo", "a  b", "ǅ", "\x00a", "\x00A"]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])
           for r in as_dicts(mark(docs(spark, texts)))}
    assert got == brute(list(enumerate(texts)))
    assert got[2][1] == 1 and got[4][1] == 2  # only A-Z folds; null equals empty


def test_hot_group_and_saturated_filter(spark, monkeypatch):
    monkeypatch.setattr(X, "MAX_WORDS", 4)
    monkeypatch.setattr(X, "filter_words", lambda n: 4)
    texts = ["hot"] * 700 + [f"t{i % 450}" for i in range(900)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])
           for r in as_dicts(mark(docs(spark, texts)))}
    assert got == brute(list(enumerate(texts)))


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    df = docs(spark, ["a", "A", "b"], ids=[7, 7, None]).withColumns(
        {"KEPT": F.lit("mine"), "digest": F.lit("theirs"), "salt": F.lit(1), "doc": F.lit(2)})
    kept = as_dicts(X.exact_dedup(df))
    assert sorted(r["text"].lower() for r in kept) == ["a", "b"]
    assert set(kept[0]) == set(df.columns) and kept[0]["KEPT"] == "mine" and kept[0]["digest"] == "theirs"


def test_empty_table(spark):
    df = docs(spark, [])
    assert as_dicts(mark(df)) == [] and as_dicts(X.exact_dedup(df)) == []


def test_no_python_in_the_plan(spark):
    plan = mark(docs(spark, ["a", "a", "b"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_filter_size_is_a_parameter_and_saturation_keeps_the_result(spark):
    assert X.filter_words(10) == 1024 and X.filter_words(10_000) == 4096 and X.filter_words(10 ** 12) == X.MAX_WORDS
    assert X.filter_words(10 ** 12, 5000) == 4096 and X.filter_words(10 ** 12, 1) == 1
    texts = [f"t{i % 600}" for i in range(900)]
    df = docs(spark, texts).withColumn("digest", X.text_digest(F.col("text")))
    for words in (1, 16, None):
        got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])
               for r in as_dicts(X.mark_copies(df, max_words=words))}
        assert got == brute(list(enumerate(texts)))
