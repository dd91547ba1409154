"""Exact, skew-safe grouped quantiles (linear interpolation).

Spark's exact ``percentile``/``median`` keep one value->count map per group
in a single aggregation buffer.  That is fine when the value domain is small
(days, years, counts) but a group holding a third of a 100 TB table with
continuous money values would have to fit in one task.  This operator selects
by rank, the same way for groups of every size:

1. ``value_ranges`` counts the distinct values of each group (combined before
   the shuffle) and deals them, in the order of (keys, value), into ranges of
   about equal size, so a large group is spread over many ranges.
2. The ranges' totals, one row a (group, range), give by a running sum how
   many values of the group lie before each range, and so which ranges hold
   the wanted order statistics.
3. Only those ranges are read again; a running count inside them finds the
   order statistics.

Nothing is approximate: where the ranges begin decides who does the work,
not the result.  The interpolation is ``lo + (hi - lo) * frac`` on the two
neighbouring order statistics, the definition used by numpy, pandas and SQL
``quantile_cont``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dealt_in_ranges


def value_ranges(df: DataFrame, keys: Sequence[str], value: str, ranges: int | None = None) -> DataFrame:
    """keys + (_v, _c, _b), written: each group's distinct values, how often they occur, their range.

    Nulls and NaN are no values.  Within a group a larger value never has a
    smaller range.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    return dealt_in_ranges(rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")), [*keys, "_v"], ranges)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: Sequence[float], names: Sequence[str] | None = None,
                    ranges: int | None = None) -> DataFrame:
    """One row per group with values: ``keys + names`` (double).

    Nulls in ``value`` are ignored; groups without values are absent, so
    callers left-join the result where such groups must stay.  A null key is
    a group like any other.  Without keys there is always one row.
    """
    keys = list(keys)
    probs = [float(p) for p in probs]
    names = list(names) if names else [f"q{int(round(p * 100))}" for p in probs]
    values = value_ranges(df, keys, value, ranges)

    group = Window.partitionBy(*keys)  # over one row a range
    totals = values.groupBy(*keys, "_b").agg(F.sum("_c").alias("_in"))
    totals = totals.withColumns({
        "_n": F.sum("_in").over(group),
        "_before": F.coalesce(F.sum("_in").over(
            group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})

    def places(p: float, n: Column) -> tuple[Column, Column, Column]:
        """The two order statistics (from 0) around ``p``, and how far it lies between them."""
        at = (n - 1).cast("double") * F.lit(p)
        return F.floor(at), F.least(F.floor(at) + 1, n - 1), at - F.floor(at)

    n = F.col("_n")
    wanted = [k for p in probs for k in places(p, n)[:2]]
    held = reduce(or_, [(F.col("_before") <= k) & (k < F.col("_before") + F.col("_in")) for k in wanted])
    needed = totals.where(held).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                                       F.col("_b").alias("_kb"), "_n", "_before")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)],
                  F.col("_b") == F.col("_kb"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = values.join(needed, same).withColumn("_end", F.col("_before") + F.sum("_c").over(inside)) \
        .withColumn("_start", F.col("_end") - F.col("_c"))

    def at(k: Column) -> Column:
        return F.min(F.when((F.col("_start") <= k) & (k < F.col("_end")), F.col("_v")))

    found = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *[
        at(k).alias(f"_s{i}_{side}") for i, p in enumerate(probs) for side, k in zip("ab", places(p, n))])
    return found.select(*keys, *[
        (F.col(f"_s{i}_a") + (F.col(f"_s{i}_b") - F.col(f"_s{i}_a")) * places(p, n)[2]).alias(name)
        for i, (p, name) in enumerate(zip(probs, names))])


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, [0.5], [name])


def exact_quantiles_many(df: DataFrame, keys: Sequence[str], values: Sequence[str],
                         prob: float, suffix: str = "") -> DataFrame:
    """Exact quantile ``prob`` of several columns per group in one run.

    The value columns are unpivoted to ``(keys, _var, _val)`` so that all of
    them share the same passes; the result is pivoted back to one column per
    input (``<name><suffix>``).
    """
    keys = list(keys)
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(v).alias("_var"), F.col(v).cast("double").alias("_val")) for v in values
    ])).alias("_kv")).select(*keys, "_kv._var", "_kv._val")
    q = exact_quantiles(long, keys + ["_var"], "_val", [prob], ["_q"])
    return q.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_var") == v, F.col("_q"))).alias(f"{v}{suffix}") for v in values])
