"""Model evaluation as aggregations (classification and regression)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dealt_in_ranges


def _div0(num: Column, den: Column) -> Column:
    """zero_division=0 semantics."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def score_ranges(df: DataFrame, label: str, score: str, ranges: int | None = None) -> DataFrame:
    """(_s, _pos, _neg, _b), written: the distinct scores with their labels' counts, dealt into ranges."""
    d = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("_s")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg"))
    return dealt_in_ranges(d, ["_s"], ranges)


def roc_auc(df: DataFrame, label: str, score: str, buckets: int | None = None) -> DataFrame:
    """Exact ROC-AUC (Mann-Whitney with half credit for ties), one row.

    Rows are first collapsed to distinct scores (map-side), then a running
    count of negatives is built in two levels: a prefix over the ranges of
    ``score_ranges`` (one row each) and a running sum inside each range, so
    no step orders the whole table in one task.
    """
    d = score_ranges(df, label, score, buckets)
    bt = d.groupBy("_b").agg(F.sum("_neg").alias("_bneg"))
    bt = bt.withColumn("_before_b", F.coalesce(F.sum("_bneg").over(
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w_in = Window.partitionBy("_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_before_in", F.coalesce(F.sum("_neg").over(w_in), F.lit(0))) \
        .join(bt.select("_b", "_before_b"), "_b")
    contrib = F.col("_pos") * (F.col("_before_b") + F.col("_before_in") + F.lit(0.5) * F.col("_neg"))
    agg = d.agg(F.sum(contrib).alias("_c"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_n"))
    return agg.select(F.try_divide(F.col("_c"), F.col("_p").cast("double") * F.col("_n")).alias("ROC_AUC"))


def classification_metrics(df: DataFrame, label: str = "real", pred: str = "prediccion",
                           score: str | None = "probabilidad_alta") -> DataFrame:
    """Accuracy, precision, recall, F1 (positive = 1, zero_division 0)
    and ROC-AUC, one row."""
    y, p = F.col(label), F.col(pred)
    c = df.agg(F.count(F.lit(1)).alias("n"),
               F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
               F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))
    prec = _div0(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _div0(F.col("tp"), F.col("tp") + F.col("fn"))
    out = c.select(
        _div0(F.col("tp") + F.col("tn"), F.col("n")).alias("Accuracy"),
        prec.alias("Precision"), rec.alias("Recall"),
        _div0(F.lit(2) * F.col("tp"), F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn")).alias("F1"),
        F.col("n").alias("Muestra_prueba"))
    if score:
        out = out.select("*", roc_auc(df, label, score).scalar().alias("ROC_AUC"))
    return out


def confusion_cells(df: DataFrame, label: str = "real", pred: str = "prediccion") -> DataFrame:
    """The 2x2 matrix as four cells, zero cells included."""
    y, p = F.col(label), F.col(pred)
    c = df.agg(*[F.count_if((y == a) & (p == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)])
    return c.select(F.expr("stack(4, 0, 0, c00, 0, 1, c01, 1, 0, c10, 1, 1, c11) AS (real, prediccion, casos)"))


def regression_metrics(df: DataFrame, by: Sequence[str] = (), real: str = "real",
                       pred: str = "prediccion") -> DataFrame:
    """MAE, RMSE and R^2 (optionally per group).

    Fewer than 2 rows: all null; R^2 needs more than 2 rows; a constant
    target scores 1.0 when predicted perfectly, else 0.0.
    """
    d = df.where(F.col(real).isNotNull() & F.col(pred).isNotNull())
    y, yh = F.col(real).cast("double"), F.col(pred).cast("double")
    agg = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"),
        F.avg(F.abs(y - yh)).alias("_mae"), F.avg((y - yh) * (y - yh)).alias("_mse"),
        F.sum((y - yh) * (y - yh)).alias("_sse"),
        F.var_pop(y).alias("_var"))
    sst = F.col("_var") * F.col("records")
    r2 = (F.when(sst == 0, F.when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(F.lit(1.0) - F.col("_sse") / sst))
    ok = F.col("records") >= 2
    return agg.select(*by, "records",
                      F.when(ok, F.col("_mae")).alias("mae"),
                      F.when(ok, F.sqrt("_mse")).alias("rmse"),
                      F.when(F.col("records") > 2, r2).alias("r2"))


def regression_subset(preds: DataFrame, currency: str, year_range: Sequence[int], area: str | None) -> DataFrame:
    """test predictions of one currency, year range (null year always
    excluded) and optional area, with both values present."""
    f = preds.where((F.col("MON") == currency) & F.col("ANIO").between(int(year_range[0]), int(year_range[1])))
    if area and area != "Todas":
        f = f.where(F.col("DES_AO") == area)
    return f.where(F.col("real").isNotNull() & F.col("prediccion").isNotNull())


def axis_max(points: DataFrame, real: str = "real", pred: str = "prediccion") -> Column:
    """Max over both columns (scalar subquery)."""
    return points.agg(F.greatest(F.max(real), F.max(pred))).scalar()
