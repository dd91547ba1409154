"""Shape of the plans of queries that grow with the lines, and the shared K-Means pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hpfunnel.operators import clients as C
from hpfunnel.operators.cases import case_lookup


def test_services_are_counted_apart_from_the_sums(spark):
    rows = [("A", "s1", 1.0), ("A", "s1", 2.0), ("A", None, 3.0), ("B", None, 4.0), ("B", "s2", None)]
    lines = spark.createDataFrame(rows, "NomCliente string, Desc_Servicio string, nParticipante double").withColumns({
        "duracion": F.lit(1.0), "propuesta_convertida": F.lit(True), "MON": F.lit("S/."), "ImporteB": F.lit(2.0),
        "diferencia_facturacion": F.lit(1.0)})
    out = C.client_operations(lines)
    assert "distinct" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r["NomCliente"]: (r["cantidad_servicios_distintos"], r["cantidad_registros"], r["participantes_total"])
            for r in out.collect()} == {"A": (1, 3, 6.0), "B": (1, 2, 4.0)}


def test_lookup_reads_the_cases_once_for_the_latest(spark, tmp_path):
    rows = [("a", "2020-01-01"), ("b", "2021-01-01"), ("b", "2021-01-01"), ("c", None)]
    spark.createDataFrame(rows, "case_id string, Fecha string").coalesce(1).write.csv(str(tmp_path / "cases"))
    cases = spark.read.schema("case_id string, Fecha string").csv(str(tmp_path / "cases"))
    wanted = spark.createDataFrame([("a",), ("b",), ("x",), (None,), (None,)], "wanted string")
    found = case_lookup(cases, wanted)
    assert sorted(((r["wanted"] or "", r["case_id"]) for r in found.collect())) == [
        ("", "b"), ("", "b"), ("a", "a"), ("b", "b"), ("b", "b"), ("x", "b")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count(" csv") == 1


@pytest.mark.parametrize("n", [1, 700])
def test_kmeans_pass_in_blocks_equals_brute_force(spark, n):
    from hpfunnel.operators import segments as SG
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 3))
    assert [len(b) for b in SG._blocks(x)] == [len(x[i:i + SG.BLOCK_POINTS]) for i in range(0, n, SG.BLOCK_POINTS)]
    points = spark.createDataFrame([(str(i), i, *map(float, r)) for i, r in enumerate(x)], "k string, h long, x0 double, x1 double, x2 double")
    runs = [SG.Run(k, s, rng.normal(size=(k, 3))) for k in (2, 3) for s in (0, 1)]
    SG.update(points, runs)
    for r in runs:
        d = ((x[:, None, :] - r.centres) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        assert r.counts.tolist() == [int((own == c).sum()) for c in range(r.k)]
        assert np.isclose(r.cost, d.min(axis=1).sum())
        for c in range(r.k):
            assert np.allclose(r.sums[c], x[own == c].sum(axis=0))
            assert np.isclose(r.squares[c], (x[own == c] ** 2).sum())


def test_class_scores_are_made_once(spark, monkeypatch):
    from hpfunnel.operators import models as M
    from hpfunnel.plans import catalogue
    calls = []

    def predictions(model):
        calls.append(model)
        return spark.createDataFrame([(1, 1, 0.9), (0, 0, 0.2)], "real int, prediccion int, probabilidad_alta double")

    monkeypatch.setattr(catalogue, "_BUILT", {})
    monkeypatch.setattr(catalogue, "_classifier", lambda spark, sf_dir: None)
    monkeypatch.setattr(M, "classification_predictions", predictions)
    for _ in range(2):
        assert catalogue.q_rf_class_metrics(spark, "/root/testdata/sf0.001").first()["ROC_AUC"] == 1.0
    assert len(calls) == 1


def test_lines_are_sorted_in_small_tasks(spark, tmp_path, monkeypatch):
    from hpfunnel import session
    from hpfunnel.sources import proposals as P
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before, inside = [spark.conf.get(n) for n in names], []

    def prepare(raw):
        inside.extend(spark.conf.get(n) for n in names)
        return raw

    rows = spark.createDataFrame([(str(i), 1990 + i % 2 if i else None) for i in range(101)], "case_id string, ANIO int")
    monkeypatch.setattr(session, "SORTED_ROWS_A_TASK", 10)
    monkeypatch.setattr(P, "read_table", lambda spark, sf_dir, name: rows)
    monkeypatch.setattr(P, "raw_proposal_lines", lambda spark, sf_dir: rows)
    monkeypatch.setattr(P, "prepare_lines", prepare)
    P.write_lines(spark, "none", str(tmp_path / "lines"))
    assert inside == [str(max(int(before[0]), 11)), str(session.SORTED_BYTES_A_TASK)]
    assert spark.read.parquet(str(tmp_path / "lines")).count() == 101
    assert [spark.conf.get(n) for n in names] == before
    with pytest.raises(ValueError):
        with session.small_sorts(spark, 1000):
            raise ValueError
    assert [spark.conf.get(n) for n in names] == before


def test_smallest_hashes_by_hex_prefix(spark):
    import hashlib

    from hpfunnel.operators import split as SP
    rows = [(("a", "b")[i % 2], f"k{i // 3}" if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "MON string, case_id string")
    out = SP.smallest_hashes(df, ["MON"], "case_id", lambda n: F.ceil(n * F.lit(0.2)), "taken", 5)
    assert "conv(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r["MON"], r["case_id"] or "", r["taken"]) for r in out.collect())
    want = []
    for stratum in "ab":
        def order(k):
            return hashlib.md5(("5" if k is None else f"{k}|5").encode()).hexdigest()
        keys = [k for m, k in rows if m == stratum]
        last = sorted(keys, key=order)[-(-len(keys) // 5) - 1]
        want += [(stratum, k or "", k is not None and order(k) <= order(last)) for k in keys]
    # a null key that the cut does not fall into is taken by its hash alone
    want = [(m, k, t or (k == "" and null_taken(rows, m))) for m, k, t in want]
    assert got == sorted(want)


def null_taken(rows, stratum):
    import hashlib
    order = sorted(hashlib.md5(("5" if k is None else f"{k}|5").encode()).hexdigest() for m, k in rows if m == stratum)
    return hashlib.md5(b"5").hexdigest() < order[-(-len(order) // 5) - 1]


def test_forests_start_from_one_split(spark, monkeypatch):
    from hpfunnel.operators import models as M
    from hpfunnel.operators import split as SP
    from hpfunnel.plans import catalogue
    rows = spark.createDataFrame([("a", "S/.", False), ("b", "S/.", True)], "case_id string, MON string, is_test boolean")
    splits, given = [], []
    monkeypatch.setattr(catalogue, "_BUILT", {})
    monkeypatch.setattr(catalogue, "load_lines", lambda spark, sf_dir: rows)
    monkeypatch.setattr(SP, "modelling_base", lambda lines, *a: lines)
    monkeypatch.setattr(SP, "stratified_split", lambda base: splits.append(base) or base)
    for name in ("train_classifier", "train_regressors"):
        monkeypatch.setattr(M, name, lambda lines, params, split: given.append(split))
    catalogue._classifier(spark, "/root/testdata/sf0.001")
    catalogue._regressors(spark, "/root/testdata/sf0.001")
    assert len(splits) == 1 and len(given) == 2 and given[0] is given[1]


def test_written_tables_leave_no_shuffle_files(spark):
    import time

    from hpfunnel import session
    sc = spark.sparkContext
    tracker = sc._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    wide = spark.range(20_000).withColumn("k", F.col("id") % 997)
    for write in (session.materialize, lambda df: session.materialize(df).count()):
        before, was = tracker.shuffleStatuses().size(), spark.conf.get(session.SHUFFLE_REMOVAL, "false")
        write(wide.repartition(3, "k").groupBy("k").agg(F.max("id").alias("m")).join(wide.repartition(5, "k"), "k"))
        for _ in range(50):  # files go in the background
            if tracker.shuffleStatuses().size() <= before + 1:
                break
            time.sleep(0.1)
        assert tracker.shuffleStatuses().size() <= before + 1  # the count's own
        assert spark.conf.get(session.SHUFFLE_REMOVAL, "false") == was
    with session.shuffles_removed(spark), session.shuffles_removed(spark):
        assert spark.conf.get(session.SHUFFLE_REMOVAL) == "true"
    assert spark.conf.get(session.SHUFFLE_REMOVAL, "false") == was


@pytest.mark.parametrize("together", [3, 10 ** 9])
def test_formats_are_digested_in_parts_that_go(spark, monkeypatch, together):
    import os

    from hpfunnel import constants as K
    from hpfunnel.plans import catalogue
    from hpfunnel.sources import proposals as P
    rows = [(f"c{i}", 1990 + i % 3 if i % 5 else None, 1.5 * i, "a\nb" if i % 2 else None, i) for i in range(12)]
    raw = spark.createDataFrame(rows, "case_id string, ANIO int, ImporteB double, Desc_Servicio string, numHP long")
    lines, paths = P.prepare_lines(raw), []
    path = catalogue.shared_path
    monkeypatch.setattr(catalogue, "LINES_TOGETHER", together)
    monkeypatch.setattr(catalogue, "load_lines", lambda spark, sf_dir: lines)
    monkeypatch.setattr(catalogue, "shared_path", lambda *a: paths.append(path(*a)) or paths[-1])
    assert sorted(sum(catalogue._years_together(lines), []), key=str) == [1990, 1991, 1992, None]
    assert len(catalogue._years_together(lines)) == (4 if together == 3 else 1)
    got = {r["formato"]: r for r in catalogue.q_sink_roundtrip(spark, "none").collect()}
    for name in ("parquet", "csv", "csv_gz"):
        assert (got[name]["filas"], got[name]["importe"], got[name]["valores"]) == (12, 99.0, 12)
    letters = lines.agg(F.sum(F.length("Desc_Servicio") + F.length("NomCliente"))).first()[0]
    assert {got[n]["letras"] for n in ("parquet", "csv", "csv_gz")} == {letters}
    assert got["json"]["filas"] == len(K.FUNNEL_ORDER) and got["json"]["valores"] == 12
    assert [x for x in os.listdir(paths[0].removeprefix("file:")) if not x.startswith(".")] == ["json"]
