"""Parameterised dashboard summaries (filters re-aimed as DataFrame functions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .funnel import _pct, billed_sum

ALL_AREAS = "Todas"


def year_bounds(df: DataFrame) -> DataFrame:
    """Observed min and max year (nulls ignored)."""
    return df.agg(F.min("ANIO").alias("anio_min"), F.max("ANIO").alias("anio_max"))


def area_list(df: DataFrame) -> DataFrame:
    """Distinct service areas, sorted (nulls dropped)."""
    return df.select(F.col("DES_AO").alias("area")).where(F.col("area").isNotNull()) \
        .distinct().orderBy("area")


def filter_dashboard(df: DataFrame, year_range: Sequence[int], area: str | None = None) -> DataFrame:
    """inclusive year range and optional area.

    A line without year is kept only when the range covers every observed
    year (min and max come from scalar subqueries over the same table, so
    nothing is collected to the driver).
    """
    start, end = int(year_range[0]), int(year_range[1])
    bounds = df.agg(F.struct(F.min("ANIO").alias("lo"), F.max("ANIO").alias("hi"))).scalar()
    covers_all = (F.lit(start) <= bounds["lo"]) & (F.lit(end) >= bounds["hi"])
    year = F.col("ANIO")
    mask = F.coalesce(year.between(start, end), F.lit(False)) | (year.isNull() & F.coalesce(covers_all, F.lit(False)))
    if area and area != ALL_AREAS:
        mask = mask & (F.col("DES_AO") == area)
    return df.where(mask)


def summary_metrics(filtered: DataFrame) -> DataFrame:
    """The seven headline numbers of a filtered slice (one row).

    Empty slice: conversion 0.0, median null, sums 0.
    """
    days = F.col("dias_conversion_hp_oi")
    valid = F.when(F.col("propuesta_convertida") & (days >= 0), days)
    return filtered.agg(
        F.count(F.lit(1)).alias("records"),
        F.coalesce(F.avg(F.col("propuesta_convertida").cast("int")) * F.lit(100.0), F.lit(0.0))
        .alias("conversion_pct"),
        F.count_if(F.col("etapa_comercial") == K.STAGE_ACTIVE).alias("active"),
        F.count_if(F.col("etapa_comercial") == K.STAGE_INACTIVE).alias("inactive"),
        F.median(valid).cast("double").alias("median_days"),
        billed_sum(K.PEN).alias("pen"),
        billed_sum(K.USD).alias("usd"),
    )


def annual_trend(df: DataFrame) -> DataFrame:
    """Lines and conversion % per year (null year dropped)."""
    return df.where(F.col("ANIO").isNotNull()).groupBy("ANIO").agg(
        F.count(F.lit(1)).alias("Registros"),
        (F.avg(F.col("propuesta_convertida").cast("int")) * F.lit(100.0)).alias("Conversion_pct"),
    ).orderBy("ANIO")
