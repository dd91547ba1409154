"""Model preprocessing as a Spark ML pipeline.

numeric  : exact training medians fill the gaps (SQLTransformer, so the
           fitted values travel inside the saved pipeline)
category : one distributed pass counts the values of all columns; values seen
           often enough get a code in frequency order, everything else, rare
           or unseen, shares the last code.  Trees take the codes as nominal
           features (splits order the categories by their mean target);
           ``onehot=True`` spreads them over one slot a value instead
assemble : VectorAssembler

Only model-sized values reach the driver: four medians and the frequent
labels.  A fit on n rows has at most n / ``min_frequency`` labels a column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .quantiles import exact_quantiles_many
from .split import category_counts

FEATURES = "features"


def frequent_labels(train: DataFrame, categorical: Sequence[str], min_frequency: int) -> dict[str, list[str]]:
    """The values of each column seen at least ``min_frequency`` times, most frequent first, ties by name."""
    counts = category_counts(train, categorical).where(F.col("n") >= min_frequency)
    out: dict[str, list[str]] = {c: [] for c in categorical}
    for r in counts.orderBy("variable", F.desc("n"), "categoria").collect():
        out[r["variable"]].append(r["categoria"])
    return out


def fit_preprocessor(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], min_frequency: int,
                     onehot: bool = False) -> PipelineModel:
    numeric, categorical = list(numeric), list(categorical)
    med_row = exact_quantiles_many(train, [], numeric, 0.5).first()
    medians = {c: (med_row[c] if med_row and med_row[c] is not None else 0.0) for c in numeric}
    impute = SQLTransformer(statement="SELECT *, " + ", ".join(
        f"coalesce(CAST(`{c}` AS DOUBLE), {float(medians[c])!r}) AS `num_{c}`" for c in numeric
    ) + " FROM __THIS__")
    cast_cats = SQLTransformer(statement="SELECT *, " + ", ".join(
        f"coalesce(CAST(`{c}` AS STRING), '{K.NOT_SPECIFIED}') AS `str_{c}`" for c in categorical) + " FROM __THIS__")
    texts = train.select(*[F.coalesce(F.col(c).cast("string"), F.lit(K.NOT_SPECIFIED)).alias(c) for c in categorical])
    labels = frequent_labels(texts, categorical, min_frequency)
    codes = [f"idx_{c}" for c in categorical]
    indexers = [StringIndexerModel.from_labels(labels[c], inputCol=f"str_{c}", outputCol=f"idx_{c}", handleInvalid="keep")
                for c in categorical]
    stages: list = [impute, cast_cats, *indexers]
    if onehot:
        stages.append(OneHotEncoder(inputCols=codes, outputCols=[f"ohe_{c}" for c in categorical],
                                    dropLast=False, handleInvalid="keep"))
        codes = [f"ohe_{c}" for c in categorical]
    stages.append(VectorAssembler(inputCols=[f"num_{c}" for c in numeric] + codes, outputCol=FEATURES))
    return Pipeline(stages=stages).fit(train)


def code_counts(preprocessor: PipelineModel) -> list[int]:
    """Codes of every category, the shared one included."""
    return [len(s.labels) + 1 for s in preprocessor.stages if isinstance(s, StringIndexerModel)]


def encoded(preprocessor: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with its imputed numbers (``num_*``) and codes (``idx_*``), not yet assembled."""
    return PipelineModel([s for s in preprocessor.stages if not isinstance(s, VectorAssembler)]).transform(df)


def assembled(numeric: Sequence[Column], codes: Sequence[Column]) -> Column:
    """The feature vector of numbers and codes that are known already, in the assembler's order."""
    return array_to_vector(F.array(*[c.cast("double") for c in [*numeric, *codes]]))


def slot_sources(assembled: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> list[str]:
    """Source variable of every slot of the assembled vector, read from
    the ML attribute metadata (prefix match in list order)."""
    meta = assembled.schema[FEATURES].metadata.get("ml_attr", {})
    size = meta.get("num_attrs")
    attrs = []
    for group in meta.get("attrs", {}).values():
        attrs += group
    names = [""] * (size or (max(a["idx"] for a in attrs) + 1 if attrs else 0))
    for a in attrs:
        names[a["idx"]] = a.get("name", "")
    out = []
    for n in names:
        src = n
        for c in numeric:
            if n == f"num_{c}":
                src = c
        for c in categorical:
            if n.startswith(f"ohe_{c}_") or n in (f"ohe_{c}", f"idx_{c}"):
                src = c
                break
        out.append(src)
    return out
