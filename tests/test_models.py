"""Model operators on sf0.001 with small forests (quality floors are not the
point here; structure and invariants are)."""
import pytest
import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hpfunnel import constants as K
from hpfunnel.operators import models as M
from hpfunnel.operators import segments as SG
from hpfunnel.operators.clients import client_features
from hpfunnel.sources.proposals import load_lines

from .conftest import SF_SMALL

SMALL = M.ForestParams(num_trees=8, max_depth=5)


@pytest.fixture(scope="module")
def lines(spark):
    return load_lines(spark, SF_SMALL)


def test_classifier(spark, lines):
    m = M.train_classifier(lines, SMALL)
    preds = M.classification_predictions(m)
    r = preds.agg(F.min("probabilidad_alta").alias("lo"), F.max("probabilidad_alta").alias("hi"),
                  F.count("*").alias("n")).first()
    assert 0.0 <= r.lo <= r.hi <= 1.0 and r.n > 0
    imp = M.importances(spark, m.preprocessor, m.forest, m.test, K.CATEGORICAL_CLASS_FEATURES)
    assert abs(imp.agg(F.sum("Importancia")).first()[0] - 1.0) < 1e-9
    assert set(r.Variable_tecnica for r in imp.collect()) <= set(K.NUMERIC_FEATURES + K.CATEGORICAL_CLASS_FEATURES)


def test_regressors_and_tree_ranges(spark, lines, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_TREES", 3)
    regs = M.train_regressors(lines, SMALL)
    preds = M.regression_predictions(regs)
    bad = preds.where((F.col("rango_p10") > F.col("rango_p90")) | F.col("rango_p10").isNull()).count()
    assert bad == 0
    # looked up in blocks of trees; equal to an explicit explode + join of the leaf table
    r = regs[K.PEN]
    scored = r.forest.transform(r.preprocessor.transform(r.test))
    leaves = r.leaves
    ranged = M.tree_ranges(scored, r.store, SMALL.num_trees).select("case_id", "rango_p10", "rango_p90")
    plan = ranged._jdf.queryExecution()
    shown = plan.executedPlan().toString()
    assert shown.count("BroadcastHashJoin") == -(-SMALL.num_trees // M.BLOCK_TREES)
    assert "SortMergeJoin" not in shown and "Generate" not in shown
    assert max(len(x) for x in shown.splitlines()) < 10_000  # no table of leaves in the plan
    assert {r["block"]: len(r["values"]) for r in r.store.collect()} == {0: 3, 1: 3, 2: 2}
    ex = scored.select("case_id", F.posexplode(vector_to_array("leaves")).alias("treeID", "leaf")) \
        .withColumn("leaf", F.col("leaf").cast("int")).join(leaves, ["treeID", "leaf"]) \
        .groupBy("case_id").agg(F.percentile("pred", [0.1, 0.9]).alias("q"))
    d = ranged.join(ex, "case_id").agg(F.count("*"), F.max(F.abs(F.col("rango_p10") - F.col("q")[0])),
                                       F.max(F.abs(F.col("rango_p90") - F.col("q")[1]))).first()
    assert d[0] == r.test.count() and d[1] < 1e-6 and d[2] < 1e-6
    # forest prediction is the mean of the joined leaf predictions
    exploded = scored.select("case_id", "prediction", F.posexplode(vector_to_array("leaves"))
                             .alias("treeID", "leaf")).withColumn("leaf", F.col("leaf").cast("int"))
    diff = exploded.join(leaves, ["treeID", "leaf"]).groupBy("case_id").agg(
        F.abs(F.avg("pred") - F.first("prediction")).alias("d")).agg(F.max("d")).first()[0]
    assert diff < 1e-6


def test_default_forests_are_not_cut(lines):
    regs = M.train_regressors(lines, M.ForestParams(num_trees=2))
    for r in regs.values():
        assert r.forest.getMaxDepth() == 30 and r.forest.getFeatureSubsetStrategy() == "all"
    assert max(t.depth for r in regs.values() for t in r.forest.trees) > 12
    assert M.ForestParams().num_trees == 200


def test_training_rows_are_bounded_and_nominal(spark, lines):
    from hpfunnel.operators import split as SP
    split = SP.stratified_split(SP.modelling_base(lines))
    train = split.where("not is_test")
    have = {r["MON"]: r["count"] for r in train.groupBy("MON").count().collect()}
    few = SP.bounded_rows(train, 100)
    assert {r["MON"]: r["count"] for r in few.groupBy("MON").count().collect()} == {c: min(n, 100) for c, n in have.items()}
    assert {r["case_id"] for r in few.collect()} == {r["case_id"] for r in SP.bounded_rows(train.repartition(7), 100).collect()}
    assert SP.bounded_rows(train, 10 ** 9).count() == train.count()
    regs = M.train_regressors(lines, M.ForestParams(num_trees=2, max_depth=4, max_rows=100))
    for r in regs.values():
        size = len(K.NUMERIC_FEATURES) + len(K.CATEGORICAL_REG_FEATURES)
        assert r.forest.numFeatures == size  # a slot a variable, not one a category
        assert r.forest.trees[0].numNodes <= 200


def test_encoding_equals_category_buckets(spark, lines):
    from hpfunnel.operators import split as SP
    from hpfunnel.operators.features import encoded, fit_preprocessor
    train = SP.modelling_base(lines).withColumn("is_test", F.lit(False))
    cats = K.CATEGORICAL_CLASS_FEATURES
    pre = fit_preprocessor(train, K.NUMERIC_FEATURES, cats, 10)
    codes = encoded(pre, train).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).alias("categoria"), F.col(f"idx_{c}").alias("code")) for c in cats])).alias("x")) \
        .select("x.*").distinct()
    buckets = SP.category_buckets(train, cats, 10)
    rows = codes.join(buckets, ["variable", "categoria"]).collect()
    assert len(rows) == buckets.count()
    for c in cats:
        own = [r for r in rows if r["variable"] == c]
        frequent = sorted((r for r in own if r["bucket"] == r["categoria"]), key=lambda r: (-r["n"], r["categoria"]))
        assert [r["code"] for r in frequent] == list(range(len(frequent)))  # most frequent first
        assert {r["code"] for r in own if r["bucket"] != r["categoria"]} <= {float(len(frequent))}


def test_scenarios_encode_a_case_once(spark, lines):
    from hpfunnel.operators import scenarios as S
    from hpfunnel.operators.clients import eligible_cases
    params = M.ForestParams(num_trees=3, max_depth=4, max_rows=300)
    clf, regs = M.train_classifier(lines, params), M.train_regressors(lines, params)
    cases = eligible_cases(lines)
    points = [(0, 0, 0), (10, 20, 0), (-50, 200, 100)]
    scored = M.score_scenarios(clf, regs, cases, points)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == len(regs)
    for part in plan.split("Generate explode")[1:]:
        assert "UDF(str_" not in plan.split("Generate explode")[0] and "str_" in part  # labels are looked up below the points
    got = {(r["case_id"], r["pct_importe"]): r for r in scored.collect()}
    # the same as imputing and encoding every scenario by itself
    grid = S.scenario_grid(cases, points)
    assert len(got) == grid.count() == 3 * cases.count()
    for cur, r in regs.items():
        rows = r.forest.transform(r.preprocessor.transform(grid.where(F.col("MON") == cur))).select("case_id", "pct_importe", "prediction")
        p = {(x["case_id"], x["pct_importe"]): x["probabilidad_alta"] for x in M.classify(clf, grid.where(F.col("MON") == cur)).collect()}
        for x in rows.collect():
            mine = got[x["case_id"], x["pct_importe"]]
            assert np.isclose(mine["estimate"], x["prediction"]) and np.isclose(mine["probability"], p[x["case_id"], x["pct_importe"]])


def test_scoring_walks_each_tree_once(spark, lines, monkeypatch):
    from hpfunnel.operators.clients import eligible_cases
    params = M.ForestParams(num_trees=30, max_depth=6, max_rows=300)
    regs = M.train_regressors(lines, params)
    for cur, r in regs.items():
        mine = M.regress(r, r.test).select("case_id", "prediction", "rango_p10", "rango_p90")
        plan = mine._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan  # no row carries the leaf values of the forest
        scored = r.forest.transform(r.preprocessor.transform(r.test))
        both = M.tree_ranges(scored, r.store, 30).select(
            "case_id", *[F.col(c).alias(f"_{c}") for c in ("prediction", "rango_p10", "rango_p90")]).join(mine, "case_id").collect()
        assert len(both) == r.test.count() > 0
        for x in both:  # the forest's own estimate, to the last bit
            assert x["prediction"] == x["_prediction"]
            assert np.isclose(x["rango_p10"], x["_rango_p10"], rtol=1e-12) and np.isclose(x["rango_p90"], x["_rango_p90"], rtol=1e-12)
    # cases are dealt by their number
    monkeypatch.setattr(M, "CASES_A_TASK", 500)
    cases = eligible_cases(lines)
    scored = M.score_scenarios(M.train_classifier(lines, params), regs, cases, [(0, 0, 0)])
    assert scored.rdd.getNumPartitions() == len(regs) * (cases.count() // 500 + 1)
    assert M.score_scenarios(M.train_classifier(lines, params), regs, cases.limit(0), [(0, 0, 0)]).count() == 0


def test_kmeans_segments(spark, lines):
    from hpfunnel.session import materialize
    feats = materialize(client_features(lines))
    seg = SG.build_segments(feats, restarts=2)
    n = feats.count()
    assert 2 <= seg.k <= min(10, n - 1)
    assert seg.clients.count() == n
    labels = {r.segmento_negocio for r in seg.clients.select("segmento_negocio").distinct().collect()}
    assert K.SEGMENT_HIGH in labels and labels <= {K.SEGMENT_HIGH, K.SEGMENT_LOW}
    assert len(seg.explained_variance) == 2 and 0 < sum(seg.explained_variance) <= 1.0 + 1e-9


def test_shared_kmeans_passes_equal_separate_fits(spark, lines):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    from hpfunnel.operators.clients import scaled_features
    from hpfunnel.session import materialize
    scaled = materialize(scaled_features(client_features(lines)))
    width = len(K.CLIENT_FEATURES)
    points = materialize(SG.points_of(scaled, K.CLIENT_FEATURES, "NomCliente"))
    n = points.count()
    runs = SG.start_runs(points, width, [2, 3, 5], 4, 42)
    starts = [r.centres.copy() for r in runs]
    assert [len(r.centres) for r in runs] == [2] * 4 + [3] * 4 + [5] * 4
    assert all(len(np.unique(r.centres, axis=0)) == r.k for r in runs)
    again = SG.start_runs(points.repartition(3), width, [2, 3, 5], 4, 42)
    assert all(np.allclose(a.centres, b) for a, b in zip(again, starts))
    passes = SG.settle(points, runs)
    assert passes <= 60  # shared: not 12 fits' passes one after another
    x = np.array([[r[f"x{i}"] for i in range(width)] for r in points.collect()])
    for r, c in zip(runs, starts):  # plain Lloyd from the same start
        for _ in range(300):
            near = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
            to = np.array([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(r.k)])
            moved, c = ((to - c) ** 2).sum(), to
            if moved <= 1e-4:
                break
        cost = ((x[:, None] - c) ** 2).sum(axis=2).min(axis=1).sum()
        assert np.isclose(r.cost, cost, rtol=1e-6) and r.counts.sum() == n
    data = VectorAssembler(inputCols=K.CLIENT_FEATURES, outputCol="x").transform(scaled)
    best = [min((r for r in runs if r.k == k), key=lambda r: r.cost) for k in (2, 3, 5)]
    fits = [min((KMeans(featuresCol="x", k=k, seed=s, maxIter=300).fit(data).summary.trainingCost for s in range(3))) for k in (2, 3)]
    assert all(r.cost <= 1.02 * f for r, f in zip(best, fits))
    for r, s in zip(best, SG.silhouettes(points, best)):
        clustered = data.join(SG.clusters_of(points, r, "NomCliente"), "NomCliente")
        ev = ClusteringEvaluator(featuresCol="x", predictionCol="cluster_validado", distanceMeasure="squaredEuclidean")
        assert np.isclose(s, ev.evaluate(clustered), atol=1e-6)


def test_kmeans_of_few_distinct_points(spark):
    rows = [(f"c{i}", float(i % 2), 1.0) for i in range(6)]
    points = SG.points_of(spark.createDataFrame(rows, "NomCliente string, a double, b double"), ["a", "b"], "NomCliente")
    found = SG.k_sweep(points, 2, 6, restarts=2, max_k=4)
    assert [r.k for r, _ in found] == [2, 3, 4] and all(np.isclose(r.cost, 0) for r, _ in found)
    assert np.isclose(found[0][1], 1.0)


def test_a_constant_model_misses_the_quality_floors(spark):
    from hpfunnel.operators import evaluate as EV
    df = spark.range(40).select(
        (F.col("id") % 2).cast("int").alias("real"), F.lit(1).alias("prediccion"), F.lit(0.7).alias("probabilidad_alta"),
        F.col("id").cast("double").alias("y"), F.lit(19.5).alias("yhat"))
    assert EV.classification_metrics(df).first()["ROC_AUC"] == 0.5 < K.AUC_FLOOR
    assert EV.regression_metrics(df, [], "y", "yhat").first()["r2"] == 0.0 < K.R2_FLOOR
