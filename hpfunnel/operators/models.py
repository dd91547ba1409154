"""Random forests: high-billing classifier and per-currency regressors,
scoring, importances and per-tree prediction ranges.

Forests are fitted on all training rows (``forest.fit``; ``ForestParams.max_rows``
bounds them only for a caller who asks for it).  Categories are nominal
features, whose splits order them by their mean target.  The estimate and the
P10/P90 range across trees come from one walk of each tree by a chunk of rows
(``ranged``), so rows are neither exploded nor shuffled and no plan, broadcast
or driver holds the trees.  ``tree_ranges`` does the same with built-ins on the
leaf indices, a broadcast join a block of trees.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..session import if_small, materialize
from . import forest as RF
from . import split as SP
from .features import FEATURES, assembled, code_counts, encoded, fit_preprocessor, slot_sources
from .scenarios import CHANGED, Point, at_points, scenario_bases


@dataclass
class ForestParams:
    num_trees: int = 200
    max_depth: int = 30          # the reference grows unlimited trees
    min_instances: int = 2
    # of numbers, and at least as many as the widest category has codes; categories get a bin each
    max_bins: int = 32
    seed: int = K.RANDOM_STATE
    # labelled rows a forest is fitted on, a currency; None: all of them
    max_rows: int | None = None
    # features tried per split in the regressors: all of them, as in the reference
    regression_features: str = "all"
    # one slot a category instead of nominal features
    onehot: bool = False


@dataclass
class Classifier:
    preprocessor: PipelineModel
    forest: RF.ForestModel
    thresholds: DataFrame
    split: DataFrame
    test: DataFrame = field(repr=False, default=None)


@dataclass
class Regressor:
    currency: str
    preprocessor: PipelineModel
    forest: RF.ForestModel
    test: DataFrame = field(repr=False, default=None)

    @cached_property
    def leaves(self) -> DataFrame:
        """treeID, leaf, pred"""
        return leaf_table(self.forest)

    @cached_property
    def store(self) -> DataFrame:
        """``leaves`` in blocks of trees"""
        return leaf_store(self.leaves, self.currency, BLOCK_TREES)


#: Trees whose leaf values are broadcast together.
BLOCK_TREES = 25
#: Cases that a task scores at all points.
CASES_A_TASK = 20_000
PRED_COLS = ["case_id", "Fecha", "ANIO", "MON", "DES_AO", "NomCliente", "numHP"]


def training_rows(split: DataFrame, params: ForestParams) -> DataFrame:
    """The training rows of a split: all of them, unless the caller bounds them."""
    train = split.where(~F.col("is_test"))
    return train if params.max_rows is None else SP.bounded_rows(train, params.max_rows)


def fit_forest(pre: PipelineModel, train: DataFrame, categorical, params: ForestParams, label: str, weight: str | None, tries: str,
               classes: bool) -> RF.ForestModel:
    """A forest of all rows of ``train`` on the features of ``pre``."""
    rows = pre.transform(train)
    codes = [0] * len(K.NUMERIC_FEATURES) + code_counts(pre)
    points = RF.split_points(rows, [f"num_{c}" for c in K.NUMERIC_FEATURES], max(params.max_bins, *codes))
    edges = [points[f"num_{c}"] for c in K.NUMERIC_FEATURES] + [None] * len(categorical)
    if params.onehot:  # each slot is 0 or 1
        slots = sum(codes)
        edges, codes = edges[:len(K.NUMERIC_FEATURES)] + [[0.5]] * slots, [0] * (len(K.NUMERIC_FEATURES) + slots)
    return RF.fit(rows, FEATURES, label, weight, "case_id", codes, edges, params.num_trees, params.max_depth, params.min_instances,
                  tries, params.seed, classes)


def train_classifier(lines: DataFrame, params: ForestParams | None = None, split: DataFrame | None = None) -> Classifier:
    """M5: RF classifier of ``impFacturado > training median of its currency``
    with balanced class weights (A25), on an exact stratified split (M1).

    Split, medians, weights, encoding and forest are those of all rows.
    ``split``: that of ``lines``, if it is written already.
    """
    params = params or ForestParams()
    if split is None:
        split = materialize(SP.stratified_split(SP.modelling_base(lines, K.CATEGORICAL_CLASS_FEATURES)))
    thresholds = materialize(SP.train_thresholds(split))
    labeled = SP.label_targets(split, thresholds)
    weights = SP.class_weights(labeled)
    rows = SP.label_targets(training_rows(split, params), thresholds)
    train = materialize(rows.join(if_small(weights.select("target", "peso")), "target"))
    pre = fit_preprocessor(train, K.NUMERIC_FEATURES, K.CATEGORICAL_CLASS_FEATURES, K.MIN_FREQUENCY_CLASS, params.onehot)
    forest = fit_forest(pre, train, K.CATEGORICAL_CLASS_FEATURES, params, "target", "peso", "sqrt", True)
    test = labeled.where(F.col("is_test"))
    return Classifier(pre, forest, thresholds, split, test)


def classify(model: Classifier, df: DataFrame) -> DataFrame:
    """M7: class and probability of the high-billing class."""
    scored = model.forest.transform(model.preprocessor.transform(df))
    return scored.withColumns({
        "probabilidad_alta": vector_to_array("probability")[1],
        "prediccion": F.col("prediction").cast("int")})


def classification_predictions(model: Classifier) -> DataFrame:
    """M8: test-set prediction table."""
    s = classify(model, model.test)
    return s.select(*PRED_COLS, F.col("impFacturado").cast("double").alias("impFacturado"),
                    F.col("target").alias("real"), "prediccion", "probabilidad_alta")


def business_name(col) -> F.Column:
    """Business label of a model input (unknown -> null)."""
    m = F.create_map(*[F.lit(x) for kv in K.BUSINESS_NAMES.items() for x in kv])
    return m[col]


def importances(spark: SparkSession, preprocessor: PipelineModel, forest, sample: DataFrame,
                categorical, currency: str | None = None) -> DataFrame:
    """Importance summed per source variable, in percent."""
    sources = slot_sources(preprocessor.transform(sample.limit(1)), K.NUMERIC_FEATURES, categorical)
    vec = forest.featureImportances.toArray().tolist()
    rows = [(sources[i] if i < len(sources) else f"slot_{i}", float(v)) for i, v in enumerate(vec)]
    slots = spark.createDataFrame(rows, "Variable_tecnica string, Importancia double")
    out = slots.groupBy("Variable_tecnica").agg(F.sum("Importancia").alias("Importancia")) \
        .withColumn("Nombre_para_negocio", business_name(F.col("Variable_tecnica"))) \
        .withColumn("Importancia_pct", F.col("Importancia") * F.lit(100.0))
    if currency is not None:
        out = out.select(F.lit(currency).alias("Moneda"), "*")
    return out.orderBy(F.desc("Importancia"), F.asc("Variable_tecnica"))


def leaf_table(forest: RF.ForestModel) -> DataFrame:
    """Leaf predictions of a fitted forest as a DataFrame (treeID, leaf, pred); the leaves of a
    tree are numbered in the order of its nodes, as the indices that ``transform`` gives in ``leaves``."""
    return forest.nodes.where("feature < 0").select(F.col("tree").alias("treeID"), F.col("value").alias("pred"), "leaf")


def leaf_store(leaves: DataFrame, currency: str, trees: int) -> DataFrame:
    """The leaf predictions (treeID, leaf, pred) in blocks of ``trees`` trees: (model, block, values), written.

    ``values`` has an array a tree.  A tree has at most a leaf for every two
    rows that it was fitted on.
    """
    def in_order(key: str, value: str) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: x[value])

    per_tree = leaves.groupBy("treeID").agg(in_order("leaf", "pred").alias("v"))
    blocks = per_tree.groupBy(F.floor(F.col("treeID") / trees).cast("int").alias("block")).agg(in_order("treeID", "v").alias("values"))
    return materialize(blocks.select(F.lit(currency).alias("model"), "block", "values"))


def tree_ranges(scored: DataFrame, store: DataFrame, num_trees: int, probs=(0.1, 0.9)) -> DataFrame:
    """Add ``rango_p10`` and ``rango_p90``, quantiles of the
    individual tree predictions of every row (linear interpolation).

    ``scored`` has the forest's leaf indices (``leaves``) and the currency of
    its model (``MON``); ``store`` comes from ``leaf_store``.
    """
    out = scored.withColumn("_leaves", vector_to_array("leaves"))
    found = []
    for first in range(0, num_trees, BLOCK_TREES):
        block = store.where(F.col("block") == first // BLOCK_TREES).select(F.col("model").alias("_model"), F.col("values").alias("_v"))
        found.append(f"_found_{first}")
        hits = [F.get(F.get("_v", F.lit(t - first)), F.get("_leaves", F.lit(t)).cast("int"))
                for t in range(first, min(first + BLOCK_TREES, num_trees))]
        out = out.join(F.broadcast(block), F.col("MON") == F.col("_model")).withColumn(found[-1], F.array(*hits)).drop("_model", "_v")
    out = out.withColumn("_trees", F.sort_array(F.concat(*found))).drop("_leaves", *found)

    def quantile(p: float) -> Column:
        h = (num_trees - 1) * p
        low, high = F.get("_trees", F.lit(int(h))), F.get("_trees", F.lit(min(int(h) + 1, num_trees - 1)))
        return low + (high - low) * F.lit(h - int(h))

    return out.withColumns({"rango_p10": quantile(probs[0]), "rango_p90": quantile(probs[1])}).drop("_trees")


def tree_statistics(values: np.ndarray, probs=(0.1, 0.9)) -> list[pa.Array]:
    """Mean and quantiles (linear interpolation) of the trees' values, a row a case and a column a tree.

    The sum runs in the order of the trees, so the mean is the forest's own prediction.
    """
    columns, last = [RF.mean_of_trees(values)], values.shape[1] - 1
    values.sort(axis=1)
    for p in probs:
        h = last * p
        low, high = values[:, int(h)], values[:, min(int(h) + 1, last)]
        columns.append(low + (high - low) * (h - int(h)))
    return [pa.array(c) for c in columns]


def train_regressors(lines: DataFrame, params: ForestParams | None = None, split: DataFrame | None = None) -> dict[str, Regressor]:
    """One RF regressor per currency on the same exact split, each fitted
    on all of its training rows.  ``split``: that of ``lines``, if it is written already."""
    params = params or ForestParams()
    if split is None:
        split = materialize(SP.stratified_split(SP.modelling_base(lines, K.CATEGORICAL_REG_FEATURES)))
    rows = materialize(training_rows(split, params).withColumn("y", F.col("impFacturado").cast("double")))

    def fit(cur: str) -> Regressor:
        train = rows.where(F.col("MON") == cur)
        pre = fit_preprocessor(train, K.NUMERIC_FEATURES, K.CATEGORICAL_REG_FEATURES, K.MIN_FREQUENCY_REG[cur], params.onehot)
        forest = fit_forest(pre, train, K.CATEGORICAL_REG_FEATURES, params, "y", None, params.regression_features, False)
        return Regressor(cur, pre, forest, split.where((F.col("MON") == cur) & F.col("is_test")))

    # group order of the reference (sorted currency codes); the fits are independent jobs
    with ThreadPoolExecutor(max_workers=len(K.VALID_CURRENCIES)) as pool:
        return dict(zip(K.VALID_CURRENCIES, pool.map(fit, K.VALID_CURRENCIES)))


def regress(model: Regressor, df: DataFrame) -> DataFrame:
    """Estimate plus P10/P90 tree range for every row of ``df``."""
    return ranged(model, model.preprocessor.transform(df))


def ranged(model: Regressor, features: DataFrame) -> DataFrame:
    """Estimate plus P10/P90 tree range of rows that have their feature vector.

    Each tree is walked once a row: its leaf gives the estimate's share as well.
    """
    found = model.forest.scored(vector_to_array(FEATURES), "prediction double, rango_p10 double, rango_p90 double",
                                lambda values, _: tree_statistics(values))
    return features.withColumn("_trees", found).select(*features.columns, "_trees.*")


def score_scenarios(classifier: Classifier, regressors: dict[str, Regressor], cases: DataFrame,
                    points: list[Point]) -> DataFrame:
    """Probability, estimate and range of every case at every point.

    A case is imputed and encoded once for each model; a point only changes
    the three numbers of its vectors.  Each currency takes its own regressor.
    Scoring costs much more than reading, so cases are dealt into tasks by
    their number, not by the size of their files.
    """
    frames = []
    bases = scenario_bases(cases)
    bases = bases.repartition(cases.count() // CASES_A_TASK + 1, "case_id")
    for currency, regressor in regressors.items():
        part = bases.where(F.col("MON") == currency)
        columns = at_points(bases, points).columns
        kept = {}
        for name, pre, categorical in (("class", classifier.preprocessor, K.CATEGORICAL_CLASS_FEATURES),
                                       ("reg", regressor.preprocessor, K.CATEGORICAL_REG_FEATURES)):
            own = part.columns
            known = [f"num_{c}" for c in K.NUMERIC_FEATURES if c not in CHANGED] + [f"idx_{c}" for c in categorical]
            part = encoded(pre, part).select(*own, F.struct(*known).alias(f"_{name}"))
            kept[name] = assembled([F.col(c) if c in CHANGED else F.col(f"_{name}.num_{c}") for c in K.NUMERIC_FEATURES],
                                   [F.col(f"_{name}.idx_{c}") for c in categorical])
        scored = at_points(part, points)
        p = classifier.forest.transform(scored.withColumn(FEATURES, kept["class"])) \
            .withColumn("_p", vector_to_array("probability")[1])
        p = p.select(*columns, "_reg", F.col("_p").alias("probability")).withColumn(FEATURES, kept["reg"])
        frames.append(ranged(regressor, p).select(
            *columns, "probability", F.col("prediction").alias("estimate"),
            F.col("rango_p10").alias("range_low"), F.col("rango_p90").alias("range_high")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def regression_predictions(models: dict[str, Regressor]) -> DataFrame:
    """Test predictions of all currencies, unioned."""
    frames = []
    for m in models.values():
        s = regress(m, m.test)
        frames.append(s.select(*PRED_COLS, F.col("ImporteB").cast("double").alias("ImporteB"),
                               F.col("impFacturado").cast("double").alias("impFacturado"),
                               F.col("impFacturado").cast("double").alias("real"),
                               F.col("prediction").alias("prediccion"), "rango_p10", "rango_p90"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
