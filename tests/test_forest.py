"""Forests of all rows: what is fitted, single splits against brute force, walks, storage."""
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hpfunnel import constants as K
from hpfunnel.operators import forest as RF
from hpfunnel.operators import models as M


def modelling_rows(spark, n):
    """A split of ``n`` rows a currency, a fifth of them for tests; some keys are null or repeated."""
    row = F.col("id")
    return spark.range(2 * n).select(
        F.when(row % 11 != 0, (row - row % 3).cast("string")).alias("case_id"), F.when(row < n, F.lit(K.PEN)).otherwise(F.lit(K.USD)).alias("MON"),
        (row % 5 == 0).alias("is_test"), (row * 37 % 101 + 1).cast("decimal(18,2)").alias("impFacturado"),
        (row * 37 % 101).cast("decimal(18,2)").alias("ImporteB"), (row % 7).cast("double").alias("nParticipante"),
        F.when(row % 4 != 0, (row % 9).cast("double")).alias("duracion"), (1990 + row % 6).cast("int").alias("ANIO"),
        *[F.concat(F.lit(c), (row % (i + 2)).cast("string")).alias(c) for i, c in enumerate(K.CATEGORICAL_CLASS_FEATURES) if c != "MON"])


def test_registered_forests_see_all_training_rows(spark, monkeypatch):
    from hpfunnel.plans import catalogue
    split, seen = modelling_rows(spark, 1600), []  # 1280 training rows a currency: more than the forests' old bound

    def fit(train, *args):
        seen.append((train.count(), train.select("case_id").distinct().count()))
        return RF.ForestModel("none", {})

    monkeypatch.setattr(catalogue, "_BUILT", {})
    monkeypatch.setattr(catalogue, "load_lines", lambda spark, sf_dir: split)
    monkeypatch.setattr(catalogue, "_split", lambda spark, sf_dir: split)
    monkeypatch.setattr(RF, "fit", fit)
    catalogue._classifier(spark, "/root/testdata/sf0.001")
    catalogue._regressors(spark, "/root/testdata/sf0.001")
    train = split.where("not is_test")
    assert sorted(n for n, _ in seen) == [1280, 1280, 2560] and train.count() == 2560
    assert M.ForestParams().max_rows is None


def spread(y, w, left):
    return sum((w[m] * (y[m] - np.average(y[m], weights=w[m])) ** 2).sum() for m in (left, ~left))


@pytest.mark.parametrize("seed", range(6))
def test_a_split_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    n, bins, nominal = 60, np.array([12, 5]), np.array([False, True])
    x = np.array([rng.integers(0, b, n) for b in bins])
    y, w, times = rng.normal(size=n).round(3), rng.uniform(0.5, 2, n), rng.integers(1, 3, n)
    g = RF.grow(x, y, w, times, bins, nominal, 1, 4, 2, rng)
    weight = w * times
    ways = [x[0] <= t for t in range(11)] + [np.isin(x[1], c) for k in range(1, 5) for c in combinations(range(5), k)]
    best = min(spread(y, weight, m) for m in ways if min(times[m].sum(), times[~m].sum()) >= 4)
    f = g["feature"][0]
    mine = x[0] <= g["threshold"][0] if f == 0 else np.isin(x[1], g["members"][g["starts"][0]:g["starts"][1]])
    assert np.isclose(spread(y, weight, mine), best)
    assert np.allclose(g["value"], [np.average(y[m], weights=weight[m]) for m in (mine >= 0, mine, ~mine)])
    assert np.isclose(g["gain"][0], (weight * (y - np.average(y, weights=weight)) ** 2).sum() - best)


@pytest.mark.parametrize("bits", [0, 1024])
def test_walks_equal_one_row_at_a_time(monkeypatch, bits):
    monkeypatch.setattr(RF, "BITS", bits)
    rng = np.random.default_rng(5)
    n, bins, nominal = 900, np.array([40, 300, 6, 30]), np.array([False, True, True, True])
    x = np.array([rng.integers(0, b, n) for b in bins]).astype(np.int32)
    y = x[0] + (x[1] % 7) * 5.0 + rng.normal(size=n)
    g = RF.grow(x[:, :600], y[:600], np.ones(600), np.ones(600), bins, nominal, 30, 2, 4, rng)
    assert g["depth"].max() > 5 and (g["feature"] == 1).any() and (g["feature"] == 0).any()
    tree = RF.Tree(*[g[c].astype(np.int32) for c in ("feature", "threshold", "left", "leaf")], g["value"], g["members"], g["starts"])
    got = RF.Walker(tree, bins, nominal).leaves(x)
    for i in range(n):
        node = 0
        while g["feature"][node] >= 0:
            f = g["feature"][node]
            own = g["members"][g["starts"][node]:g["starts"][node + 1]]
            node = g["left"][node] + (x[f, i] not in own if nominal[f] else x[f, i] > g["threshold"][node])
        assert got[i] == node
    # every leaf has the mean of its own rows
    for node in np.unique(got[:600]):
        assert np.isclose(g["value"][node], y[:600][got[:600] == node].mean())
    assert sorted(g["leaf"][g["feature"] < 0]) == list(range((g["feature"] < 0).sum()))


def test_split_points_are_exact(spark):
    values = [(float(i * i % 1009), float(i % 4), None if i % 2 else 1.0) for i in range(4000)]
    df = spark.createDataFrame(values, "a double, b double, c double").repartition(5)
    found = RF.split_points(df, ["a", "b", "c"], 16)
    assert found["b"] == [0.5, 1.5, 2.5] and found["c"] == []
    a = np.sort([v[0] for v in values])
    ends = {int((a <= v).sum()): v for v in np.unique(a)}
    assert found["a"] == [v for n, v in sorted(ends.items()) if n < 4000 and n * 16 // 4000 > (n - (a == v).sum()) * 16 // 4000]
    assert 10 <= len(found["a"]) < 16


def test_forests_do_not_depend_on_partitions_and_can_be_stored(spark, tmp_path):
    from pyspark.ml import PipelineModel
    rows = modelling_rows(spark, 300).where("not is_test")
    params = M.ForestParams(num_trees=3, max_depth=6)
    rows = rows.withColumn("y", F.col("impFacturado").cast("double"))
    found = []
    for df in (rows, rows.repartition(7)):
        pre = M.fit_preprocessor(df, K.NUMERIC_FEATURES, K.CATEGORICAL_REG_FEATURES, 5)
        forest = M.fit_forest(pre, df, K.CATEGORICAL_REG_FEATURES, params, "y", None, "all", False)
        found.append(forest.nodes.orderBy("tree", "node").collect())
    assert found[0] == found[1] and len({r["tree"] for r in found[0]}) == 3
    path = str(tmp_path / "model")
    PipelineModel([pre, forest]).write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    both = [sorted(map(str, m.transform(rows).select("case_id", "prediction", "leaves").collect()))
            for m in (PipelineModel([pre, forest]), loaded)]
    assert both[0] == both[1] and loaded.stages[1].uid == forest.uid
    assert np.isclose(forest.featureImportances.toArray().sum(), 1) and forest.featureImportances[0] > 0.9
    with pytest.raises(Exception, match="no rows"):
        M.fit_forest(pre, rows.limit(0), K.CATEGORICAL_REG_FEATURES, params, "y", None, "all", False)
