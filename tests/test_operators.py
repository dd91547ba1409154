import math

import pytest
from pyspark.sql import functions as F

from hpfunnel import constants as K
from hpfunnel.operators import evaluate as EV
from hpfunnel.operators import scenarios as S
from hpfunnel.operators import split as SP
from hpfunnel.operators import summary as SU


def test_split_exact_sizes(spark):
    rows = [(f"c{i}", "S/." if i % 10 else "US$") for i in range(2345)]
    df = spark.createDataFrame(rows, "case_id string, MON string")
    got = {r.MON: (r.n, r.t) for r in SP.stratified_split(df).groupBy("MON").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    for cur, (n, t) in got.items():
        assert t == math.ceil(0.2 * n)


def test_split_deterministic(spark):
    df = spark.createDataFrame([(f"c{i}", "S/.") for i in range(500)], "case_id string, MON string")
    a = {r.case_id for r in SP.stratified_split(df).where("is_test").collect()}
    b = {r.case_id for r in SP.stratified_split(df).where("is_test").collect()}
    assert a == b and len(a) == 100


def _auc_brute(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    tot = sum((1.0 if p > n else 0.5 if p == n else 0.0) for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_against_brute_force(spark):
    import random
    random.seed(7)
    pairs = [(random.randint(0, 1), round(random.random(), 2)) for _ in range(400)]
    df = spark.createDataFrame(pairs, "y int, s double")
    got = EV.roc_auc(df, "y", "s", buckets=16).first()[0]
    assert abs(got - _auc_brute(pairs)) < 1e-12


def test_auc_of_crowded_scores_spreads_over_tasks(spark):
    n = 200_000  # distinct scores within one millionth
    df = spark.range(n).select(F.when(F.xxhash64("id") % 3 == 0, 1).otherwise(0).alias("y"),
                               (0.5 + F.col("id") * 1e-6 / n).alias("s"))
    ranged = EV.score_ranges(df, "y", "s", 8)
    sizes = [r["count"] for r in ranged.groupBy("_b").count().collect()]
    assert sum(sizes) == n and len(sizes) == 8 and max(sizes) < 2 * n / 8
    y = [r["y"] for r in df.orderBy("s").collect()]
    pos = sum(y)
    rank_sum = sum(i + 1 for i, v in enumerate(y) if v)
    want = (rank_sum - pos * (pos + 1) / 2) / (pos * (n - pos))
    assert abs(EV.roc_auc(df, "y", "s", buckets=8).first()[0] - want) < 1e-9
    none = spark.createDataFrame([(1, None), (1, 0.5), (0, 0.25)], "y int, s double")
    assert EV.roc_auc(none, "y", "s").first()[0] == 1.0


def test_second_session_finds_the_stored_lines(spark, monkeypatch):
    from hpfunnel.sources import proposals as P
    first = P.load_lines(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(P, "_PREPARED", {})  # as a new session would begin

    def rebuilt(*_):
        raise AssertionError("the lines are built again")

    monkeypatch.setattr(P, "raw_proposal_lines", rebuilt)
    again = P.load_lines(spark, "/root/testdata/sf0.001")
    assert again.inputFiles() == first.inputFiles() and again.count() == first.count() > 0
    monkeypatch.setattr(P, "LINES_FORMAT", P.LINES_FORMAT + 1)
    with pytest.raises(AssertionError):
        P.load_lines(spark, "/root/testdata/sf0.001")
    one = first.select("case_id").first()[0]
    plan = first.where(F.col("case_id") == one)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(case_id" in plan


@pytest.mark.parametrize("n,expect_null", [(0, True), (1, True), (2, False), (3, False)])
def test_regression_metric_edges(spark, n, expect_null):
    rows = [(float(i), float(i) + 1.0) for i in range(n)]
    df = spark.createDataFrame(rows, "real double, prediccion double")
    r = EV.regression_metrics(df).first()
    if n == 0:
        assert r is None or r.records == 0
        return
    assert (r.mae is None) == expect_null
    assert (r.r2 is None) == (n <= 2)


def test_r2_constant_target(spark):
    df = spark.createDataFrame([(1.0, 1.0)] * 3, "real double, prediccion double")
    assert EV.regression_metrics(df).first().r2 == 1.0
    df = spark.createDataFrame([(1.0, 2.0)] * 3, "real double, prediccion double")
    assert EV.regression_metrics(df).first().r2 == 0.0


def test_year_filter_null_rule(spark):
    df = spark.createDataFrame([(2019, "A"), (2020, "B"), (None, "A")], "ANIO int, DES_AO string")
    assert SU.filter_dashboard(df, (2000, 2030)).count() == 3
    assert SU.filter_dashboard(df, (2020, 2030)).count() == 1
    assert SU.filter_dashboard(df, (2000, 2030), "A").count() == 2
    assert SU.filter_dashboard(df, (2000, 2030), "Todas").count() == 3


def test_empty_summary(spark):
    schema = ("propuesta_convertida boolean, etapa_comercial string, dias_conversion_hp_oi int, "
              "MON string, impFacturado decimal(18,2)")
    r = SU.summary_metrics(spark.createDataFrame([], schema)).first()
    assert r.records == 0 and r.conversion_pct == 0.0 and r.median_days is None and r.pen == 0.0


def test_scenario_defaults_and_bands(spark):
    schema = ("case_id string, ImporteB decimal(18,2), nParticipante double, duracion double, ANIO int, "
              "MON string, numHP bigint, impFacturado decimal(18,2), " +
              ", ".join(f"{c} string" for c in K.CATEGORICAL_REG_FEATURES))
    cats = ["x"] * len(K.CATEGORICAL_REG_FEATURES)
    cases = spark.createDataFrame([("a", None, None, 0.0, None, "EUR", 1, None, *cats),
                                   ("b", None, None, None, 2020, "US$", 2, None, *cats)], schema)
    g = S.scenario_inputs(cases, F.lit(10), F.lit(20), F.lit(0)).orderBy("case_id").collect()
    assert g[0].duracion == 15.0 and g[1].duracion == 1.0
    assert g[0].ImporteB == 0.0 and g[0].nParticipante == 0.0 and g[0].MON == K.PEN
    p = spark.createDataFrame([(0.75,), (0.5,), (0.3,), (0.2999,)], "p double")
    got = [r[0] for r in p.select(S.score_band(F.col("p"))).collect()]
    assert got == [K.BAND_HIGH[1], K.BAND_MID_HIGH[1], K.BAND_MID[1], K.BAND_LOW]


def test_missing_source_fails(spark):
    from pyspark.errors import AnalysisException

    from hpfunnel.sources.proposals import read_lines
    with pytest.raises(AnalysisException) as e:
        read_lines(spark, "/nonexistent/hpfunnel/lines.parquet")
    assert "PATH_NOT_FOUND" in str(e.value)


def test_unsupported_currency_routing():
    from hpfunnel.sources.sinks import regressor_for
    with pytest.raises(ValueError):
        regressor_for({"S/.": object()}, "EUR")


def test_csv_roundtrip_types_bad_cells(spark, tmp_path):
    from hpfunnel.sources.proposals import read_lines
    p = tmp_path / "lines.csv"
    p.write_text("case_id,Fecha,ImporteB,ANIO,propuesta_convertida,NomCliente,Desc_Estado\n"
                 "a,2020-01-02 00:00:00,12.5,2020,true,  Foo ,HP Activo\n"
                 "b,not a date,n/a,x,,,HP Inactivo\n", encoding="utf-8")
    rows = {r.case_id: r for r in read_lines(spark, str(p), fmt="csv").collect()}
    assert rows["a"].ImporteB == 12.5 and rows["a"].ANIO == 2020 and rows["a"].NomCliente == "Foo"
    assert rows["b"].Fecha is None and rows["b"].ImporteB is None and rows["b"].ANIO is None
    assert rows["b"].propuesta_convertida is False and rows["b"].NomCliente == K.NOT_SPECIFIED
    assert rows["a"].etapa_comercial == K.STAGE_CONVERTED and rows["b"].etapa_comercial == K.STAGE_INACTIVE


def test_csv_as_data_frame_libraries_write_it(spark, tmp_path):
    import pandas as pd

    from hpfunnel.sources.proposals import read_lines
    p = tmp_path / "lines.csv"
    pd.DataFrame({"case_id": ["a", "b"], "ANIO": [2020.0, None], "numHP": [77.0, 8.5], "dias_conversion_hp_oi": [5.0, None],
                  "NomCliente": ['He said "no"', "two\nlines, and more"], "ImporteB": [12.345, 1e3]}).to_csv(p, index=False)
    rows = {r.case_id: r for r in read_lines(spark, str(p), fmt="csv").collect()}
    assert len(rows) == 2
    assert (rows["a"].ANIO, rows["a"].numHP, rows["a"].dias_conversion_hp_oi) == (2020, 77, 5)
    assert (rows["b"].ANIO, rows["b"].numHP, rows["b"].dias_conversion_hp_oi) == (None, None, None)
    assert rows["a"].NomCliente == 'He said "no"' and rows["b"].NomCliente == "two\nlines, and more"
    assert float(rows["a"].ImporteB) == 12.35  # amounts are kept to the cent


def test_scenario_points_and_detail(spark):
    assert len(S.slider_points()) == 31 * 26 * 31 and (10, 20, 0) in S.slider_points()
    schema = ("case_id string, ImporteB decimal(18,2), nParticipante double, duracion double, ANIO int, "
              "MON string, numHP bigint, impFacturado decimal(18,2), " +
              ", ".join(f"{c} string" for c in K.CATEGORICAL_REG_FEATURES))
    from decimal import Decimal
    cases = spark.createDataFrame([("a", Decimal("50000.00"), 10.0, 2.5, 2020, K.PEN, 1, None,
                                    *["x"] * len(K.CATEGORICAL_REG_FEATURES))], schema)
    scored = S.formula_scores(S.scenario_grid(cases, [(10, 20, 0)]))
    r = scored.first()
    assert (r.ImporteB, r.nParticipante, r.level) == (pytest.approx(55000), 12.0, "Potencial medio-alto")
    assert r.message == K.BAND_MESSAGES["Potencial medio-alto"]
    assert [d.valor for d in S.scenario_detail(scored).collect()] == [
        "x", "x", "x", "S/ 55,000", "12", "2", "52.4%", "Sin facturación registrada"]


def test_missing_shared_folder_is_an_error_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from hpfunnel.session import ensure_checkpoint_dir
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", getConf=lambda: {})
    session = SimpleNamespace(sparkContext=sc, conf={})
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(session)


def test_rewritten_sources_are_seen(spark, tmp_path):
    from hpfunnel.session import source_version
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    one = source_version(spark, str(tmp_path / "t.parquet"))
    assert one == source_version(spark, str(tmp_path / "t.parquet"))
    spark.range(9).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    assert one != source_version(spark, str(tmp_path / "t.parquet"))
