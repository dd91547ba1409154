"""Case lookup and per-case summaries over the eligible cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.formatting import case_label, format_currency
from ..session import if_small, materialize


def case_lookup(cases: DataFrame, wanted: DataFrame) -> DataFrame:
    """for every id in ``wanted`` (column ``wanted``) its case; unknown
    or null ids get the latest case.

    The ids meet the cases in one join on the id, whose hits are written; few
    ids are broadcast, so the cases are not shuffled.  The latest case is one
    TakeOrdered row, found once and added where nothing matched.
    """
    wanted = if_small(wanted)
    hit = materialize(cases.join(wanted, wanted["wanted"] == cases["case_id"]).select("wanted", *cases.columns))
    latest = cases.orderBy(F.desc("Fecha"), F.asc("case_id")).limit(1)
    missing = wanted.join(hit.select("case_id"), wanted["wanted"] == hit["case_id"], "left_anti")
    return hit.unionByName(missing.crossJoin(latest))


def case_labels(cases: DataFrame) -> DataFrame:
    """Option label per case."""
    return cases.select("case_id", case_label(F.col("Fecha"), F.col("numHP"), F.col("NomCliente"),
                                              F.col("Desc_Servicio"), F.col("MON")).alias("label"))


def case_summaries(cases: DataFrame) -> DataFrame:
    """The thirteen summary fields of each case, with defaults
    (null amount/participants -> 0.0, null duration -> 15.0)."""
    importe = F.coalesce(F.col("ImporteB").cast("double"), F.lit(0.0))
    return cases.select(
        F.col("case_id").cast("string").alias("case_id"),
        F.coalesce(F.date_format("Fecha", "dd/MM/yyyy"), F.lit(K.NOT_SPECIFIED)).alias("fecha"),
        F.coalesce(F.col("numHP").cast("bigint").cast("string"), F.lit(K.NOT_SPECIFIED)).alias("hp"),
        F.col("NomCliente").alias("cliente"),
        F.col("Desc_Servicio").alias("servicio"),
        F.col("DES_AO").alias("area"),
        F.col("MON").alias("moneda"),
        importe.alias("importe"),
        F.coalesce(F.col("nParticipante").cast("double"), F.lit(0.0)).alias("participantes"),
        F.coalesce(F.col("duracion").cast("double"), F.lit(K.DEFAULT_DURATION)).alias("duracion"),
        F.col("impFacturado").cast("double").alias("facturacion_real"),
        F.col("Desc_Estado").alias("estado"),
        F.col("segmento_negocio").alias("segmento"),
        format_currency(importe, F.col("MON"), 0).alias("importe_texto"),
    )
