"""Report slices, published metric tables and the run record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.formatting import format_currency


def top_clients_slice(top: DataFrame, segment: str, currency: str, n: int = 10) -> DataFrame:
    """One segment x currency of the stored ranking, first ``n``
    positions, with the display amount."""
    return top.where((F.col("Segmento") == segment) & (F.col("Moneda") == currency) & (F.col("Posicion") <= n)) \
        .withColumn("Facturacion_texto", format_currency(F.col("Facturacion"), F.col("Moneda"), 0))


def importance_for(imp: DataFrame, currency: str) -> DataFrame:
    """importances of one currency's regressor."""
    return imp.where(F.col("Moneda") == currency)


def top_importances(imp: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` most important source variables."""
    return imp.orderBy(F.desc("Importancia_pct"), F.asc("Variable_tecnica")).limit(n)


def classification_record(metrics: DataFrame, thresholds: DataFrame, confusion: DataFrame,
                          base_rows: DataFrame, model_name: str = "Random Forest pre-OI") -> DataFrame:
    """One metrics row with the nested fields of the run metadata:
    ``Umbrales`` map currency -> threshold and ``Matriz_confusion``
    [[TN, FP], [FN, TP]], plus their JSON text forms for CSV sinks.

    All inputs are one-row or few-row aggregates, combined by scalar
    subqueries.
    """
    th = thresholds.agg(F.map_from_entries(F.collect_list(F.struct("MON", "umbral")))).scalar()
    cells = confusion.agg(F.map_from_entries(F.collect_list(
        F.struct(F.concat(F.col("real").cast("string"), F.col("prediccion").cast("string")), "casos")))).scalar()
    matrix = F.array(F.array(cells["00"], cells["01"]), F.array(cells["10"], cells["11"]))
    rows = base_rows.agg(F.count(F.lit(1))).scalar()
    out = metrics.select(F.lit(model_name).alias("Modelo"), "*", rows.alias("Registros"),
                         th.alias("Umbrales"), matrix.alias("Matriz_confusion"))
    return out.withColumns({"Umbrales_json": F.to_json("Umbrales"),
                            "Matriz_confusion_json": F.to_json("Matriz_confusion")})


def regression_table(metrics: DataFrame, base_rows: DataFrame, model_name: str = "Random Forest pre-OI") -> DataFrame:
    """The published regression metrics, one row a currency.

    ``metrics`` is (MON, records, mae, rmse, r2) of the test rows,
    ``base_rows`` the modelling base.
    """
    rows = base_rows.groupBy("MON").agg(F.count(F.lit(1)).alias("Registros"))
    return metrics.join(rows, "MON").select(
        F.col("MON").alias("Moneda"), F.lit(model_name).alias("Modelo"), "Registros",
        F.col("records").alias("Muestra_prueba"), F.col("mae").alias("MAE_prueba"), F.col("rmse").alias("RMSE_prueba"),
        F.col("r2").alias("R2_prueba"))


def run_metadata(business: DataFrame, classification: DataFrame, regression: DataFrame, segmentation: DataFrame) -> DataFrame:
    """The nested record of a run, one row.

    ``business``, ``classification`` and ``segmentation`` have one row,
    ``regression`` one a currency; they are put together by scalar subqueries.
    """
    def one(df: DataFrame):
        return df.agg(F.first(F.struct(*df.columns))).scalar()

    def features(categorical):
        return F.struct(F.lit(K.NUMERIC_FEATURES).alias("numeric"), F.lit(list(categorical)).alias("categorical"))

    spark = business.sparkSession
    return spark.range(1).select(
        F.lit(K.RANDOM_STATE).alias("random_state"), F.lit(K.TEST_SIZE).alias("test_size"),
        F.lit(list(K.VALID_CURRENCIES)).alias("valid_currencies"),
        features(K.CATEGORICAL_CLASS_FEATURES).alias("classification_features"),
        features(K.CATEGORICAL_REG_FEATURES).alias("regression_features"),
        one(classification).alias("classification"),
        regression.agg(F.array_sort(F.collect_list(F.struct(*regression.columns)))).scalar().alias("regression"),
        one(segmentation).alias("segmentation"), one(business).alias("business_summary"))


#: The fields that readers of the run record rely on.
METADATA_SCHEMA = """
  random_state int, test_size double, valid_currencies array<string>,
  classification_features struct<numeric: array<string>, categorical: array<string>>,
  regression_features struct<numeric: array<string>, categorical: array<string>>,
  classification struct<Accuracy: double, ROC_AUC: double, Registros: bigint, Muestra_prueba: bigint,
                        Umbrales: map<string, double>, Matriz_confusion: array<array<bigint>>>,
  regression array<struct<Moneda: string, Modelo: string, Registros: bigint, Muestra_prueba: bigint,
                          MAE_prueba: double, RMSE_prueba: double, R2_prueba: double>>,
  segmentation struct<clientes: bigint, segmentos: bigint>,
  business_summary struct<total_registros: bigint, fecha_min: string, fecha_max: string, lineas_convertidas: bigint,
                          conversion_lineas_pct: double, hp_analiticas: bigint, total_facturacion_pen: double,
                          total_facturacion_usd: double>"""
