"""Sinks and artifact readers.

All writes are distributed (one file per partition, overwrite mode) into a
folder; nothing is gathered on the driver.  The reference's UTF-8 BOM on
CSV headers is not written (Spark's CSV reader would strip it anyway).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.typing import coerce
from ..session import shuffles_removed


#: CSV as data-frame libraries write it: quotes doubled, newlines inside quotes.
CSV_OPTIONS = {"header": True, "encoding": "UTF-8", "multiLine": True, "escape": '"'}


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    """Header CSV, optionally gzip-compressed."""
    w = df.write.mode("overwrite").option("header", True).option("escape", '"') \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if gzip:
        w = w.option("compression", "gzip")
    with shuffles_removed(df.sparkSession):
        w.csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """S9 (preferred form): Parquet, optionally partitioned (e.g. by year)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    with shuffles_removed(df.sparkSession):
        w.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines (nested structs, arrays and maps kept)."""
    df.write.mode("overwrite").json(path)


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Header CSV (gzip detected from the extension).  With a schema
    the columns are read as text and typed by ``coerce``, so whole numbers
    stored as floats stay and bad cells become null; columns that the file
    lacks are null, those that the schema lacks are left out."""
    raw = spark.read.options(**CSV_OPTIONS).csv(path)
    if schema is None:
        return raw
    return raw.select(*[
        (coerce(F.col(f"`{f.name}`"), f.dataType.simpleString()) if f.name in raw.columns else F.lit(None).cast(f.dataType))
        .alias(f.name) for f in schema.fields])


def read_json_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
                    multiline: bool = False) -> DataFrame:
    """JSON (one object per line, or one multi-line document)."""
    r = spark.read.option("multiLine", multiline)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def save_model(model, path: str) -> None:
    """Spark ML writer (overwrite)."""
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def regressor_for(models: dict, currency: str):
    """Model routing by currency; unsupported currency raises."""
    if currency not in K.VALID_CURRENCIES or currency not in models:
        raise ValueError(f"Moneda no soportada: {currency}")
    return models[currency]
