import numpy as np
import pytest
from pyspark.sql import functions as F

from hpfunnel.operators.quantiles import exact_quantiles, exact_quantiles_many, value_ranges


def _data(spark, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(4):
        n = [1, 2, 37, 3000][k]
        vals = rng.integers(0, 40 if k == 3 else 1000, size=n).astype(float)
        rows += [(k, float(v)) for v in vals]
        rows += [(k, None)]
    return spark.createDataFrame(rows, "k int, v double"), rows


@pytest.mark.parametrize("ranges", [None, 1, 7, 64])
def test_matches_numpy_wherever_the_ranges_begin(spark, ranges):
    df, rows = _data(spark)
    probs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r.k: r[1:] for r in exact_quantiles(df, ["k"], "v", probs, ranges=ranges).collect()}
    assert set(got) == set(range(4))
    for k in range(4):
        vals = np.array([v for kk, v in rows if kk == k and v is not None])
        assert np.allclose(got[k], np.quantile(vals, probs), rtol=0, atol=1e-9)


def test_order_statistics_in_neighbouring_ranges(spark):
    df = spark.createDataFrame([(float(v),) for v in range(1000)], "v double")
    for ranges in (2, 10, 250):
        r = exact_quantiles(df, [], "v", [0.5, 0.999], ["m", "q"], ranges).first()
        assert r.m == 499.5 and abs(r.q - np.quantile(np.arange(1000), 0.999)) < 1e-9


def test_global_and_many(spark):
    df, rows = _data(spark)
    vals = np.array([v for _, v in rows if v is not None])
    g = exact_quantiles(df, [], "v", [0.25]).first()
    assert abs(g["q25"] - np.quantile(vals, 0.25)) < 1e-9
    m = exact_quantiles_many(df.withColumn("w", F.col("v") * 2), ["k"], ["v", "w"], 0.5, "_med").orderBy("k").collect()
    assert len(m) == 4 and all(abs(r.w_med - 2 * r.v_med) < 1e-9 for r in m)


def test_nulls_nan_signs_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([("a", -1e300), ("a", -0.0), ("a", 0.0), ("a", nan), ("a", 1e-300), ("a", inf),
                                (None, 2.0), (None, 4.0), ("b", None), ("c", nan)], "k string, v double")
    got = {r.k: (r.lo, r.m) for r in exact_quantiles(df, ["k"], "v", [0.0, 0.5], ["lo", "m"]).collect()}
    assert got == {"a": (-1e300, 0.0), None: (2.0, 3.0)}
    assert exact_quantiles(df.limit(0), ["k"], "v", [0.5]).collect() == []
    assert exact_quantiles(df.limit(0), [], "v", [0.5], ["m"]).first().m is None
    assert exact_quantiles_many(df.limit(0), [], ["v"], 0.5).first()["v"] is None


def test_hot_group_is_dealt_over_tasks_without_cartesian_plans(spark):
    rng = np.random.default_rng(5)
    vals = rng.normal(size=4000)
    rows = [("hot" if i % 10 else f"k{i % 7}", float(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(8)
    for keys in (["k"], []):
        q = exact_quantiles(df, keys, "v", [0.5])
        plan = q._jdf.queryExecution().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan and "percentile" not in plan
    assert abs(q.first()[0] - np.quantile(vals, 0.5)) < 1e-12
    sizes = [r["count"] for r in value_ranges(df, ["k"], "v", 16).groupBy("k", "_b").count().collect()]
    assert max(sizes) < 0.15 * 4000


def test_one_frequent_value_is_one_row(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).cast("double").alias("v"))
    counted = value_ranges(df, [], "v", 4)
    assert counted.where("_v = 7").first()["_c"] == 13_333
    assert exact_quantiles(df, [], "v", [0.5], ["m"]).first().m == 7.0
