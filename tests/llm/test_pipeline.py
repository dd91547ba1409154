import random

import pytest

import corpus_pipeline as P
from hpfunnel.llm import mixing, near_dedup
from tests.llm.helpers import DOCS, SF, as_dicts, docs
from tests.llm.test_exact_dedup import brute as exact_brute
from tests.llm.test_near_dedup import brute_classes, smallest
from tests.llm.test_packing import check as check_packing

NAMES = ["language ID", "exact dedup", "MinHash near-dedup", "mixing sources to target weights", "best-fit packing"]


def test_stages_and_registration():
    import __spark_entry__ as E
    assert [n for n, _ in P.STAGES] == NAMES and P.ORACLE_SQL is None
    names = list(E.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's rows over the whole small table, each written and read again."""
    folder, out = tmp_path_factory.mktemp("stages"), []
    df = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, f) in enumerate(P.STAGES):
        f(spark, df, SF).write.parquet(str(folder / str(k)))
        df = spark.read.parquet(str(folder / str(k)))
        out.append(as_dicts(df))
    return [as_dicts(spark.read.parquet(f"{SF}/documents.parquet")), *out]


def test_each_stage_equals_brute_force(spark, stages):
    given, languages, exact, near, mixed, packed = stages
    key = lambda r: (r["doc_id"], r["text"])
    # every clean document has a language here
    assert sorted(map(key, languages)) == sorted(map(key, given))
    kept = exact_brute([key(r) for r in languages])
    assert {r["doc_id"] for r in exact} == {i for i, v in kept.items() if v[2]}
    classes = smallest(brute_classes({r["doc_id"]: r["text"] for r in exact}))
    assert sorted(r["doc_id"] for r in near) == sorted(set(classes.values()))
    assert all(set(r) == {f.name for f in DOCS} for s in stages[1:5] for r in s)
    # copies are those of the operator on the same rows, at most three of each
    df = spark.createDataFrame([tuple(r[f.name] for f in DOCS) for r in near], DOCS)
    copies = {r["doc_id"]: r["copies"] for r in as_dicts(mixing.mix(df))}
    times = {}
    for r in mixed:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert times == {i: n for i, n in copies.items() if n} and max(times.values()) <= 3
    # packing: whole documents, as often as they came
    first = {}
    for r in packed:
        first.setdefault((r["doc_id"], r["piece"]), []).append(r)
    assert {i: len(first[i, 0]) for i in times} == times
    once = [rows[0] | {"sequence_id": n, "offset": 0} for n, rows in enumerate(first.values())]
    check_packing(once, {r["doc_id"]: r["text"] for r in mixed})
    fill = {}
    for r in packed:
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_rejects_null_and_repeated_rows(spark):
    rng = random.Random(1)
    en = ["the " + " ".join(rng.choice(["and", "with", "that", "this", "from"]) for _ in range(30)) for _ in range(60)]
    df = docs(spark, [*en, None, "", "123 456", en[0], en[0]], ids=[*range(60), 60, 61, 62, 5, 5])
    rows = as_dicts(P.run_on(spark, df, SF))
    assert {r["doc_id"] for r in rows} <= set(range(60))
    assert as_dicts(P.run_on(spark, df.limit(0), SF)) == []
    assert as_dicts(near_dedup.near_dedup(df.limit(0))) == []


def test_unlabelled_corpus_is_kept(spark):
    texts = ["Plain words of a clean text", None, "", "123 ...", "Más texto limpio", "x"]
    rows = docs(spark, texts, langs=[None] * len(texts))
    assert sorted(r["doc_id"] for r in as_dicts(P.language_id(spark, rows, SF))) == [0, 4, 5]
    clashing = rows.selectExpr("*", "1 AS row", "2 AS lang_pred", "3 AS ambiguous", "4 AS score")
    kept = as_dicts(P.language_id(spark, clashing, SF))
    assert {r["doc_id"] for r in kept} == {0, 4, 5} and all(r["lang_pred"] == 2 and r["row"] == 1 for r in kept)
    assert {r["doc_id"] for r in as_dicts(P.run_on(spark, rows, SF))} <= {0, 4, 5}
