"""Modelling base, exact stratified hash split, thresholds and targets.

The split is exact (``ceil(test_size * n)`` test rows per stratum, chosen
by a seeded md5 of the case key) without sorting any stratum: a histogram
of the leading hash digits per stratum locates the boundary bucket, only
the rows of that one bucket are ranked, and the resulting per-stratum
threshold is joined back (broadcast if the strata are few, which is
checked).  A stratum holding most of the data therefore never lands in one
task.  The same selection gives models a bounded number of training rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import clean_category
from ..session import if_small
from .quantiles import exact_quantiles, exact_quantiles_many

HASH_DIGITS = 4  # 16**4 = 65,536 histogram buckets per stratum


def modelling_base(lines: DataFrame, categorical: Sequence[str] = K.CATEGORICAL_CLASS_FEATURES) -> DataFrame:
    """Billed (> 0) lines in a valid currency with a gross amount."""
    base = lines.where(F.col("impFacturado").isNotNull() & (F.col("impFacturado") > 0)
                       & F.col("MON").isin(*K.VALID_CURRENCIES) & F.col("ImporteB").isNotNull())
    return base.withColumns({c: clean_category(F.col(c)) for c in categorical})


def split_hash(key: Column, seed: int = K.RANDOM_STATE) -> Column:
    """Seeded md5 of the case key (hex text; same value in any SQL engine)."""
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def smallest_hashes(df: DataFrame, strata: Sequence[str], key: str, how_many: Callable[[Column], Column],
                    flag: str, seed: int = K.RANDOM_STATE) -> DataFrame:
    """Add ``flag``: true for exactly ``how_many(n)`` of the n rows of each stratum, those of the smallest hashes.

    Rows of equal keys count as one another's equals: a key that the cut
    falls into is taken with all its rows.
    """
    strata = list(strata)
    h = df.withColumn("_h", split_hash(F.col(key), seed)) \
        .withColumn("_bk", F.substring("_h", 1, HASH_DIGITS))  # hex text sorts as its number does
    hist = h.groupBy(*strata, "_bk").agg(F.count(F.lit(1)).alias("_cnt"))
    w_all = Window.partitionBy(*strata)
    w_cum = Window.partitionBy(*strata).orderBy("_bk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumns({
        "_n": F.sum("_cnt").over(w_all),
        "_end": F.sum("_cnt").over(w_cum)}) \
        .withColumn("_k", how_many(F.col("_n")).cast("long"))
    boundary = hist.where((F.col("_end") >= F.col("_k")) & (F.col("_end") - F.col("_cnt") < F.col("_k"))) \
        .select(*strata, "_bk", (F.col("_k") - (F.col("_end") - F.col("_cnt"))).alias("_need"))
    # rank only the rows of each stratum's boundary bucket
    edge = h.join(if_small(boundary), strata + ["_bk"]) \
        .withColumn("_r", F.row_number().over(Window.partitionBy(*strata).orderBy("_h", key))) \
        .where(F.col("_r") == F.col("_need")) \
        .select(*strata, F.col("_h").alias("_th"), F.col(key).alias("_tk"))
    marked = h.join(if_small(edge), strata, "left")
    taken = F.coalesce((F.col("_h") < F.col("_th")) |
                       ((F.col("_h") == F.col("_th")) & (F.col(key) <= F.col("_tk"))), F.lit(False))
    return marked.withColumn(flag, taken).drop("_h", "_bk", "_th", "_tk")


def stratified_split(df: DataFrame, strata: Sequence[str] = ("MON",), key: str = "case_id",
                     test_size: float = K.TEST_SIZE, seed: int = K.RANDOM_STATE) -> DataFrame:
    """Add ``is_test`` with exactly ``ceil(test_size*n)`` rows per stratum."""
    return smallest_hashes(df, strata, key, lambda n: F.ceil(n * F.lit(test_size)), "is_test", seed)


def bounded_rows(df: DataFrame, most: int, strata: Sequence[str] = ("MON",), key: str = "case_id",
                 seed: int = K.RANDOM_STATE + 1) -> DataFrame:
    """The ``most`` rows of each stratum with the smallest hashes; all of them, if there are fewer."""
    return smallest_hashes(df, strata, key, lambda n: F.least(n, F.lit(most)), "_taken", seed).where("_taken").drop("_taken")


def train_thresholds(split: DataFrame, value: str = "impFacturado", by: str = "MON") -> DataFrame:
    """A10: exact median billing per currency over the training rows."""
    return exact_quantiles(split.where(~F.col("is_test")), [by], value, [0.5], ["umbral"])


def label_targets(split: DataFrame, thresholds: DataFrame, by: str = "MON",
                  value: str = "impFacturado") -> DataFrame:
    """``target = value > threshold of its currency`` (strict); the
    thresholds, one row a value of ``by``, are broadcast if they are few."""
    return split.join(if_small(thresholds), by) \
        .withColumn("target", (F.col(value).cast("double") > F.col("umbral")).cast("int"))


def class_weights(labeled: DataFrame, label: str = "target") -> DataFrame:
    """``balanced`` weights n / (2 * n_class) over the training rows."""
    train = labeled.where(~F.col("is_test"))
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n_clase"))
    total = F.sum("n_clase").over(Window.partitionBy())  # <= 2 rows
    return counts.withColumn("peso", total / (F.lit(2.0) * F.col("n_clase")))


def imputer_medians(split: DataFrame, features: Sequence[str] = K.NUMERIC_FEATURES) -> DataFrame:
    """Exact training medians of the numeric features (one row)."""
    return exact_quantiles_many(split.where(~F.col("is_test")), [], list(features), 0.5)


INFREQUENT = "infrequent_sklearn"


def category_counts(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(variable, categoria, n): how often each value of each column occurs, in one unpivoted pass."""
    long = rows.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("categoria")) for c in features
    ])).alias("_kv")).select("_kv.*")
    return long.groupBy("variable", "categoria").agg(F.count(F.lit(1)).alias("n"))


def category_buckets(split: DataFrame, features: Sequence[str] = K.CATEGORICAL_CLASS_FEATURES,
                     min_frequency: int = K.MIN_FREQUENCY_CLASS) -> DataFrame:
    """Training frequency of every category and its encoding bucket
    (categories seen fewer than ``min_frequency`` times share one slot)."""
    return category_counts(split.where(~F.col("is_test")), features) \
        .withColumn("bucket", F.when(F.col("n") >= min_frequency, F.col("categoria")).otherwise(F.lit(INFREQUENT)))
