"""Business KPIs over proposal lines: funnel, reasons, HP rollup, ageing.

Every function takes the prepared line table (``sources.proposals``) and
returns a lazy DataFrame.  Aggregations are written so that each one is a
single pass with map-side partial aggregation; one-row results are combined
through scalar subqueries instead of joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def _conv() -> Column:
    return F.col("propuesta_convertida")


def _pct(num: Column, den: Column) -> Column:
    """``num / den * 100`` as double; null when the denominator is 0."""
    return F.try_divide(num.cast("double"), den.cast("double")) * F.lit(100.0)


def inactive_filter() -> Column:
    """inactive proposal lines that did not convert."""
    return ~_conv() & (F.col("Desc_Estado") == K.STATE_INACTIVE)


def active_filter() -> Column:
    """active proposal lines that did not convert."""
    return ~_conv() & (F.col("Desc_Estado") == K.STATE_ACTIVE)


def funnel_stages(lines: DataFrame) -> DataFrame:
    """All four stages in fixed order, with count and share.

    One aggregate pass with a conditional count per stage, then ``stack`` to
    rows; the fixed stage list plays the spine so absent stages show 0.
    """
    counts = lines.agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.count_if(F.col("etapa_comercial") == s).alias(f"_s{i}")
          for i, s in enumerate(K.FUNNEL_ORDER)])
    stack_args = ", ".join(f"{i}, '{s}', _s{i}" for i, s in enumerate(K.FUNNEL_ORDER))
    rows = counts.select(
        "_total", F.expr(f"stack({len(K.FUNNEL_ORDER)}, {stack_args}) AS (Orden, Etapa, Registros)"))
    return rows.select(
        F.col("Orden").cast("int").alias("Orden"), "Etapa",
        F.col("Registros").cast("bigint").alias("Registros"),
        _pct(F.col("Registros"), F.col("_total")).alias("Porcentaje"))


def hp_key(fecha: Column, num: Column, client: Column) -> Column:
    """P5: analytical proposal key ``yyyy-MM-dd|numHP|client``."""
    return F.concat_ws("|", F.date_format(fecha, "yyyy-MM-dd"), num.cast("bigint").cast("string"), client)


def hp_status(converted: Column, lines_n: Column) -> Column:
    """None / total / partial conversion of an analytical proposal."""
    return (F.when(converted == 0, F.lit(K.HP_NONE))
            .when(converted == lines_n, F.lit(K.HP_TOTAL))
            .otherwise(F.lit(K.HP_PARTIAL)))


def hp_rollup(lines: DataFrame) -> DataFrame:
    """One row per analytical proposal (date + number + client)."""
    base = lines.where(F.col("Fecha").isNotNull() & F.col("numHP").isNotNull())
    # the typed parts group faster than the text they make up, and one to one
    agg = base.groupBy(F.to_date("Fecha").alias("_day"), "numHP", F.col("NomCliente").alias("cliente")) \
        .agg(F.min("Fecha").alias("fecha_hp"),
             F.count(F.lit(1)).alias("lineas_servicio"),
             F.count_distinct("Desc_Servicio").alias("servicios_distintos"),
             F.count_if(_conv()).alias("lineas_convertidas"))
    return agg.select(hp_key(F.col("_day"), F.col("numHP"), F.col("cliente")).alias("hp_id_analitico"), "fecha_hp",
                      "numHP", "cliente", "lineas_servicio", "servicios_distintos", "lineas_convertidas",
                      hp_status(F.col("lineas_convertidas"), F.col("lineas_servicio")).alias("estado_conversion_hp"))


def hp_status_counts(lines: DataFrame) -> DataFrame:
    """Analytical proposals per conversion status."""
    return hp_rollup(lines).groupBy("estado_conversion_hp") \
        .agg(F.count(F.lit(1)).alias("hp"))


def reason_counts(lines: DataFrame) -> DataFrame:
    """Reasons of inactive lines, count and share of all inactive.

    The share uses a window over the already aggregated frame, which has at
    most one row per fixed reason category.
    """
    counts = lines.where(inactive_filter()).groupBy(F.col("motivo_negocio").alias("Motivo")) \
        .agg(F.count(F.lit(1)).alias("Registros"))
    total = F.sum("Registros").over(Window.partitionBy())
    return counts.withColumn("Porcentaje", _pct(F.col("Registros"), total))


def top_reasons(lines: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` most frequent reasons (share still over all inactive)."""
    return reason_counts(lines).orderBy(F.desc("Registros"), F.asc("Motivo")).limit(n)


def price_cost_share(lines: DataFrame) -> DataFrame:
    """A3/F16: share of inactive lines lost on reference cost or price."""
    inactive = inactive_filter()
    agg = lines.agg(
        F.count_if(inactive).alias("_n"),
        *[F.count_if(inactive & (F.col("motivo_negocio") == r)).alias(f"_r{i}")
          for i, r in enumerate(K.PRICE_COST_REASONS)])
    parts = [F.coalesce(_pct(F.col(f"_r{i}"), F.col("_n")), F.lit(0.0))
             for i in range(len(K.PRICE_COST_REASONS))]
    return agg.select((parts[0] + parts[1]).alias("precio_costo_no_conversion_pct"))


def _days_aggs(valid: Column, days: Column) -> list[Column]:
    """A8 aggregates over converted lines' day counts (``valid`` = converted,
    non-null days).  Days are small integers, so Spark's exact percentile
    buffer (value -> count) stays bounded by the number of distinct days."""
    ok = valid & (days >= 0)
    d = F.when(ok, days)
    n_ok = F.count(d)
    return [
        F.count_if(valid & (days < 0)).alias("fechas_inconsistentes"),
        F.median(d).cast("double").alias("mediana_dias_conversion"),
        F.avg(d).alias("promedio_dias_conversion"),
        _pct(F.count_if(ok & (days <= 15)), n_ok).alias("conversion_15_dias_pct"),
        _pct(F.count_if(ok & (days <= 30)), n_ok).alias("conversion_30_dias_pct"),
        F.percentile(d, 0.9).cast("double").alias("p90_dias_conversion"),
    ]


def conversion_days_stats(lines: DataFrame) -> DataFrame:
    """Negative-date count, median, mean, <=15/<=30 shares, P90."""
    days = F.col("dias_conversion_hp_oi")
    valid = _conv() & days.isNotNull()
    return lines.agg(*_days_aggs(valid, days))


def age_days(cutoff: Column, ts: Column) -> Column:
    """Whole 24-hour periods between ``ts`` and ``cutoff`` (floored)."""
    return F.floor(F.timestamp_diff("SECOND", ts, cutoff) / F.lit(86400))


def cutoff_date(lines: DataFrame) -> Column:
    """Latest proposal date as a scalar subquery (runs once, read-only)."""
    return lines.agg(F.max("Fecha")).scalar()


def active_aging(lines: DataFrame, days: int = K.AGED_DAYS) -> DataFrame:
    """Open proposals and how many are older than ``days``."""
    cutoff = cutoff_date(lines)
    active = active_filter()
    aged = active & (age_days(cutoff, F.col("Fecha")) > days)
    agg = lines.agg(F.count_if(active).alias("hp_activas_sin_oi"),
                    F.count_if(aged).alias("hp_activas_mas_90"))
    return agg.withColumn(
        "hp_activas_mas_90_pct",
        F.coalesce(_pct(F.col("hp_activas_mas_90"), F.col("hp_activas_sin_oi")), F.lit(0.0)))


def billed_sum(currency: str) -> Column:
    """Exact (decimal) billing of one currency; 0 when nothing is billed."""
    amount = F.when(F.col("MON") == currency, F.col("impFacturado"))
    return F.coalesce(F.sum(amount), F.lit(0).cast("decimal(28,2)")).cast("double")


def area_portfolio(lines: DataFrame) -> DataFrame:
    """Per service area: lines, conversion %, PEN and USD billing."""
    return lines.groupBy(F.col("DES_AO").alias("area")).agg(
        F.count(F.lit(1)).alias("Registros"),
        (F.avg(_conv().cast("int")) * F.lit(100.0)).alias("Conversion_pct"),
        billed_sum(K.PEN).alias("Facturacion_PEN"),
        billed_sum(K.USD).alias("Facturacion_USD"),
    ).orderBy(F.desc("Registros"), F.asc("area"))


def business_kpis(lines: DataFrame) -> DataFrame:
    """The global KPI row.

    Three scans: the cutoff date (scalar subquery), the analytical-proposal
    rollup (one shuffle on the HP key, folded to one row by a scalar
    subquery) and one conditional aggregate pass for everything else.
    """
    hp = hp_rollup(lines).agg(F.struct(
        F.count(F.lit(1)).alias("hp_analiticas"),
        F.count_if(F.col("estado_conversion_hp") == K.HP_TOTAL).alias("hp_conversion_total"),
        (F.avg((F.col("estado_conversion_hp") == K.HP_TOTAL).cast("int")) * F.lit(100.0))
        .alias("hp_conversion_total_pct"),
        F.count_if(F.col("estado_conversion_hp") == K.HP_PARTIAL).alias("hp_conversion_parcial"),
        F.count_if(F.col("estado_conversion_hp") == K.HP_NONE).alias("hp_no_convertidas"),
    )).scalar()
    cutoff = cutoff_date(lines)
    days = F.col("dias_conversion_hp_oi")
    inactive = inactive_filter()
    active = active_filter()
    main = lines.agg(
        F.count(F.lit(1)).alias("total_registros"),
        F.date_format(F.min("Fecha"), "yyyy-MM-dd").alias("fecha_min"),
        F.date_format(F.max("Fecha"), "yyyy-MM-dd").alias("fecha_max"),
        F.count_if(_conv()).alias("lineas_convertidas"),
        (F.avg(_conv().cast("int")) * F.lit(100.0)).alias("conversion_lineas_pct"),
        *_days_aggs(_conv() & days.isNotNull(), days),
        F.count_if(inactive).alias("_inactive"),
        *[F.count_if(inactive & (F.col("motivo_negocio") == r)).alias(f"_r{i}")
          for i, r in enumerate(K.PRICE_COST_REASONS)],
        F.count_if(active).alias("hp_activas_sin_oi"),
        F.count_if(active & (age_days(cutoff, F.col("Fecha")) > K.AGED_DAYS)).alias("hp_activas_mas_90"),
        billed_sum(K.PEN).alias("total_facturacion_pen"),
        billed_sum(K.USD).alias("total_facturacion_usd"),
    )
    price = sum(F.coalesce(_pct(F.col(f"_r{i}"), F.col("_inactive")), F.lit(0.0))
                for i in range(len(K.PRICE_COST_REASONS)))
    return main.select(
        "total_registros", "fecha_min", "fecha_max", "lineas_convertidas", "conversion_lineas_pct",
        hp["hp_analiticas"].alias("hp_analiticas"),
        hp["hp_conversion_total"].alias("hp_conversion_total"),
        hp["hp_conversion_total_pct"].alias("hp_conversion_total_pct"),
        hp["hp_conversion_parcial"].alias("hp_conversion_parcial"),
        hp["hp_no_convertidas"].alias("hp_no_convertidas"),
        "mediana_dias_conversion", "promedio_dias_conversion", "conversion_15_dias_pct",
        "conversion_30_dias_pct", "p90_dias_conversion", "fechas_inconsistentes",
        price.alias("precio_costo_no_conversion_pct"),
        "hp_activas_sin_oi", "hp_activas_mas_90",
        F.coalesce(_pct(F.col("hp_activas_mas_90"), F.col("hp_activas_sin_oi")), F.lit(0.0))
        .alias("hp_activas_mas_90_pct"),
        "total_facturacion_pen", "total_facturacion_usd",
    )
