"""Registered queries: name -> (spark builder, oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole driver tables.  Double outputs are rounded to 6 decimals on both sides
so that engine-specific summation order cannot change the value hash.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.text import categorize_reason, normalize_text
from ..operators import funnel
from ..session import materialize, remove_path, shared_path, source_version
from ..sources.adapter import TABLES
from ..sources.proposals import load_lines
from .oracle import _WS, RAW_SQL, clean_sql, norm_sql, q, with_lines

DIGITS = 6
Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every double column (oracle-stable output)."""
    return df.select(*[
        F.round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name) for f in df.schema.fields])


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def R(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), {DIGITS})"


def PCT(num: str, den: str) -> str:
    """Oracle for ``num / den * 100`` (double, null on zero denominator)."""
    return f"(CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0) * 100.0)"


# --------------------------------------------------------------------------
# Funnel, reasons, HP rollup, KPIs
# --------------------------------------------------------------------------

_stage_rows = " UNION ALL ".join(
    f"SELECT {i} AS Orden, {q(s)} AS Etapa" for i, s in enumerate(K.FUNNEL_ORDER))


@register("funnel_stages", with_lines(f"""
, spine AS ({_stage_rows})
SELECT CAST(s.Orden AS INTEGER) AS Orden, s.Etapa,
       CAST(count(l.etapa_comercial) AS BIGINT) AS Registros,
       {R(PCT('count(l.etapa_comercial)', '(SELECT count(*) FROM lines)'))} AS Porcentaje
FROM spine s LEFT JOIN lines l ON l.etapa_comercial = s.Etapa
GROUP BY s.Orden, s.Etapa"""))
def q_funnel_stages(spark, sf_dir):
    return rounded(funnel.funnel_stages(load_lines(spark, sf_dir)))


@register("reason_normalized", with_lines(f"""
SELECT case_id, DescAnulado, {norm_sql('DescAnulado')} AS texto_normalizado,
       motivo_negocio
FROM lines"""))
def q_reason_normalized(spark, sf_dir):
    lines = load_lines(spark, sf_dir)
    return lines.select("case_id", "DescAnulado", normalize_text(F.col("DescAnulado")).alias("texto_normalizado"),
                        "motivo_negocio")


_INACTIVE = f"NOT propuesta_convertida AND Desc_Estado = {q(K.STATE_INACTIVE)}"
_ACTIVE = f"NOT propuesta_convertida AND Desc_Estado = {q(K.STATE_ACTIVE)}"

_REASONS_SQL = f"""
SELECT motivo_negocio AS Motivo, CAST(count(*) AS BIGINT) AS Registros,
       {R(PCT('count(*)', 'sum(count(*)) OVER ()'))} AS Porcentaje
FROM lines WHERE {_INACTIVE} GROUP BY motivo_negocio"""


@register("reason_category_counts", with_lines(_REASONS_SQL))
def q_reason_category_counts(spark, sf_dir):
    return rounded(funnel.reason_counts(load_lines(spark, sf_dir)))


@register("top_reasons", with_lines(f"SELECT * FROM ({_REASONS_SQL}) ORDER BY Registros DESC, Motivo LIMIT 8"))
def q_top_reasons(spark, sf_dir):
    return rounded(funnel.top_reasons(load_lines(spark, sf_dir), 8))


@register("price_cost_share", with_lines(f"""
SELECT {R(' + '.join(f"coalesce({PCT(f'count_if({_INACTIVE} AND motivo_negocio = {q(r)})', f'count_if({_INACTIVE})')}, 0.0)" for r in K.PRICE_COST_REASONS))}
       AS precio_costo_no_conversion_pct
FROM lines"""))
def q_price_cost_share(spark, sf_dir):
    return rounded(funnel.price_cost_share(load_lines(spark, sf_dir)))


_HP_SQL = f"""
hp AS (
  SELECT strftime(Fecha, '%Y-%m-%d') || '|' || CAST(numHP AS VARCHAR) || '|' || NomCliente AS hp_id_analitico,
         min(Fecha) AS fecha_hp, any_value(numHP) AS numHP, any_value(NomCliente) AS cliente,
         CAST(count(*) AS BIGINT) AS lineas_servicio,
         CAST(count(DISTINCT Desc_Servicio) AS BIGINT) AS servicios_distintos,
         CAST(count_if(propuesta_convertida) AS BIGINT) AS lineas_convertidas
  FROM lines WHERE Fecha IS NOT NULL AND numHP IS NOT NULL GROUP BY 1),
hps AS (
  SELECT *, CASE WHEN lineas_convertidas = 0 THEN {q(K.HP_NONE)}
                 WHEN lineas_convertidas = lineas_servicio THEN {q(K.HP_TOTAL)}
                 ELSE {q(K.HP_PARTIAL)} END AS estado_conversion_hp
  FROM hp)"""


@register("hp_rollup", with_lines(f""", {_HP_SQL}
SELECT hp_id_analitico, strftime(fecha_hp, '%Y-%m-%d %H:%M:%S') AS fecha_hp, numHP, cliente,
       lineas_servicio, servicios_distintos, lineas_convertidas, estado_conversion_hp
FROM hps"""))
def q_hp_rollup(spark, sf_dir):
    df = funnel.hp_rollup(load_lines(spark, sf_dir))
    return df.withColumn("fecha_hp", F.date_format("fecha_hp", "yyyy-MM-dd HH:mm:ss"))


@register("hp_status_counts", with_lines(f""", {_HP_SQL}
SELECT estado_conversion_hp, CAST(count(*) AS BIGINT) AS hp FROM hps GROUP BY 1"""))
def q_hp_status_counts(spark, sf_dir):
    return funnel.hp_status_counts(load_lines(spark, sf_dir))


_DAYS_SQL_COLS = f"""
  CAST(count_if(propuesta_convertida AND dias_conversion_hp_oi < 0) AS BIGINT) AS fechas_inconsistentes,
  {R("median(CASE WHEN propuesta_convertida AND dias_conversion_hp_oi >= 0 THEN dias_conversion_hp_oi END)")} AS mediana_dias_conversion,
  {R("avg(CASE WHEN propuesta_convertida AND dias_conversion_hp_oi >= 0 THEN dias_conversion_hp_oi END)")} AS promedio_dias_conversion,
  {R(PCT("count_if(propuesta_convertida AND dias_conversion_hp_oi >= 0 AND dias_conversion_hp_oi <= 15)", "count(CASE WHEN propuesta_convertida AND dias_conversion_hp_oi >= 0 THEN 1 END)"))} AS conversion_15_dias_pct,
  {R(PCT("count_if(propuesta_convertida AND dias_conversion_hp_oi >= 0 AND dias_conversion_hp_oi <= 30)", "count(CASE WHEN propuesta_convertida AND dias_conversion_hp_oi >= 0 THEN 1 END)"))} AS conversion_30_dias_pct,
  {R("quantile_cont(CASE WHEN propuesta_convertida AND dias_conversion_hp_oi >= 0 THEN dias_conversion_hp_oi END, 0.9)")} AS p90_dias_conversion"""


@register("conversion_days_stats", with_lines(f"SELECT {_DAYS_SQL_COLS} FROM lines"))
def q_conversion_days_stats(spark, sf_dir):
    return rounded(funnel.conversion_days_stats(load_lines(spark, sf_dir)))


_AGED = (f"{_ACTIVE} AND floor(date_diff('second', Fecha, (SELECT max(Fecha) FROM lines)) / 86400) > {K.AGED_DAYS}")


@register("active_aging", with_lines(f"""
SELECT CAST(count_if({_ACTIVE}) AS BIGINT) AS hp_activas_sin_oi,
       CAST(count_if({_AGED}) AS BIGINT) AS hp_activas_mas_90,
       {R(f"coalesce({PCT(f'count_if({_AGED})', f'count_if({_ACTIVE})')}, 0.0)")} AS hp_activas_mas_90_pct
FROM lines"""))
def q_active_aging(spark, sf_dir):
    return rounded(funnel.active_aging(load_lines(spark, sf_dir)))


def _billed(cur: str) -> str:
    return f"CAST(coalesce(sum(CASE WHEN MON = {q(cur)} THEN impFacturado END), 0) AS DOUBLE)"


@register("area_portfolio", with_lines(f"""
SELECT DES_AO AS area, CAST(count(*) AS BIGINT) AS Registros,
       {R("avg(CAST(propuesta_convertida AS INTEGER)) * 100.0")} AS Conversion_pct,
       {R(_billed(K.PEN))} AS Facturacion_PEN, {R(_billed(K.USD))} AS Facturacion_USD
FROM lines GROUP BY DES_AO"""))
def q_area_portfolio(spark, sf_dir):
    return rounded(funnel.area_portfolio(load_lines(spark, sf_dir)))


@register("business_kpis", with_lines(f""", {_HP_SQL},
hpagg AS (
  SELECT CAST(count(*) AS BIGINT) AS hp_analiticas,
         CAST(count_if(estado_conversion_hp = {q(K.HP_TOTAL)}) AS BIGINT) AS hp_conversion_total,
         avg(CAST(estado_conversion_hp = {q(K.HP_TOTAL)} AS INTEGER)) * 100.0 AS hp_conversion_total_pct,
         CAST(count_if(estado_conversion_hp = {q(K.HP_PARTIAL)}) AS BIGINT) AS hp_conversion_parcial,
         CAST(count_if(estado_conversion_hp = {q(K.HP_NONE)}) AS BIGINT) AS hp_no_convertidas
  FROM hps),
main AS (
  SELECT CAST(count(*) AS BIGINT) AS total_registros,
         strftime(min(Fecha), '%Y-%m-%d') AS fecha_min, strftime(max(Fecha), '%Y-%m-%d') AS fecha_max,
         CAST(count_if(propuesta_convertida) AS BIGINT) AS lineas_convertidas,
         {R("avg(CAST(propuesta_convertida AS INTEGER)) * 100.0")} AS conversion_lineas_pct,
         {_DAYS_SQL_COLS},
         {R(' + '.join(f"coalesce({PCT(f'count_if({_INACTIVE} AND motivo_negocio = {q(r)})', f'count_if({_INACTIVE})')}, 0.0)" for r in K.PRICE_COST_REASONS))} AS precio_costo_no_conversion_pct,
         CAST(count_if({_ACTIVE}) AS BIGINT) AS hp_activas_sin_oi,
         CAST(count_if({_AGED}) AS BIGINT) AS hp_activas_mas_90,
         {R(f"coalesce({PCT(f'count_if({_AGED})', f'count_if({_ACTIVE})')}, 0.0)")} AS hp_activas_mas_90_pct,
         {R(_billed(K.PEN))} AS total_facturacion_pen, {R(_billed(K.USD))} AS total_facturacion_usd
  FROM lines)
SELECT main.*, hp_analiticas, hp_conversion_total, {R("hp_conversion_total_pct")} AS hp_conversion_total_pct,
       hp_conversion_parcial, hp_no_convertidas
FROM main, hpagg"""))
def q_business_kpis(spark, sf_dir):
    return rounded(funnel.business_kpis(load_lines(spark, sf_dir)))


# --------------------------------------------------------------------------
# Parameterised summaries (R2)
# --------------------------------------------------------------------------

PARTIAL_YEARS = (1996, 1998)
PARTIAL_AREA = "LARGE"
FULL_YEARS = (1900, 2100)


def _summary_sql(years, area):
    area_cond = f" AND DES_AO = {q(area)}" if area and area != "Todas" else ""
    return f"""
, b AS (SELECT min(ANIO) AS lo, max(ANIO) AS hi FROM lines),
f AS (SELECT lines.* FROM lines, b
      WHERE (coalesce(ANIO BETWEEN {years[0]} AND {years[1]}, false)
             OR (ANIO IS NULL AND coalesce({years[0]} <= b.lo AND {years[1]} >= b.hi, false))){area_cond})
SELECT CAST(count(*) AS BIGINT) AS records,
       {R("coalesce(avg(CAST(propuesta_convertida AS INTEGER)) * 100.0, 0.0)")} AS conversion_pct,
       CAST(count_if(etapa_comercial = {q(K.STAGE_ACTIVE)}) AS BIGINT) AS active,
       CAST(count_if(etapa_comercial = {q(K.STAGE_INACTIVE)}) AS BIGINT) AS inactive,
       {R("median(CASE WHEN propuesta_convertida AND dias_conversion_hp_oi >= 0 THEN dias_conversion_hp_oi END)")} AS median_days,
       {R(_billed(K.PEN))} AS pen, {R(_billed(K.USD))} AS usd
FROM f"""


def _summary_spark(spark, sf_dir, years, area):
    from ..operators import summary
    lines = load_lines(spark, sf_dir)
    return rounded(summary.summary_metrics(summary.filter_dashboard(lines, years, area)))


@register("filtered_summary", with_lines(_summary_sql(PARTIAL_YEARS, PARTIAL_AREA)))
def q_filtered_summary(spark, sf_dir):
    return _summary_spark(spark, sf_dir, PARTIAL_YEARS, PARTIAL_AREA)


@register("filtered_summary_full", with_lines(_summary_sql(FULL_YEARS, "Todas")))
def q_filtered_summary_full(spark, sf_dir):
    return _summary_spark(spark, sf_dir, FULL_YEARS, "Todas")


@register("annual_trend", with_lines(f"""
SELECT ANIO, CAST(count(*) AS BIGINT) AS Registros,
       {R("avg(CAST(propuesta_convertida AS INTEGER)) * 100.0")} AS Conversion_pct
FROM lines WHERE ANIO IS NOT NULL GROUP BY ANIO"""))
def q_annual_trend(spark, sf_dir):
    from ..operators import summary
    return rounded(summary.annual_trend(load_lines(spark, sf_dir)))


@register("area_list", with_lines("SELECT DISTINCT DES_AO AS area FROM lines WHERE DES_AO IS NOT NULL"))
def q_area_list(spark, sf_dir):
    from ..operators import summary
    return summary.area_list(load_lines(spark, sf_dir))


@register("year_bounds", with_lines("SELECT min(ANIO) AS anio_min, max(ANIO) AS anio_max FROM lines"))
def q_year_bounds(spark, sf_dir):
    from ..operators import summary
    return summary.year_bounds(load_lines(spark, sf_dir))


# --------------------------------------------------------------------------
# Clients, segments, top clients, serving tables
# --------------------------------------------------------------------------

_M_SQL = f"""
m AS (
  SELECT *, CASE WHEN MON IN ({q(K.PEN)}, {q(K.USD)}) THEN MON ELSE {q(K.OTHER_CURRENCY)} END AS MON_limpia,
         CASE WHEN ImporteB IS NOT NULL AND ImporteB <> 0
              THEN CAST(diferencia_facturacion AS DOUBLE) / CAST(ImporteB AS DOUBLE) * 100.0 END AS pdo
  FROM lines
  WHERE NomCliente <> '' AND lower(NomCliente) NOT IN ('nan', {q(K.NOT_SPECIFIED.lower())}))"""


def _sum_cur(cur):
    return f"CAST(coalesce(sum(CASE WHEN MON_limpia = {q(cur)} THEN impFacturado END), 0) AS DOUBLE)"


_CF_SQL = f"""{_M_SQL},
cagg AS (
  SELECT NomCliente,
         {_sum_cur(K.PEN)} AS facturacion_soles_total,
         {_sum_cur(K.USD)} AS facturacion_dolares_total,
         median(pdo) AS porcentaje_diferencia_mediana,
         sum(nParticipante) AS participantes_total,
         avg(duracion) AS duracion_promedio,
         avg(CAST(propuesta_convertida AS INTEGER)) AS tasa_conversion_hp_oi,
         CAST(count(DISTINCT Desc_Servicio) AS DOUBLE) AS cantidad_servicios_distintos,
         CAST(count(*) AS DOUBLE) AS cantidad_registros,
         count_if(MON_limpia = {q(K.PEN)}) AS _n_pen, count_if(MON_limpia = {q(K.USD)}) AS _n_usd
  FROM m GROUP BY NomCliente),
cf AS (
  SELECT * FROM cagg
  WHERE facturacion_soles_total + facturacion_dolares_total > 0
    AND {' AND '.join(f'{c} IS NOT NULL' for c in K.CLIENT_FEATURES)}),
lg AS (
  SELECT NomCliente, _n_pen, _n_usd,
         {', '.join((f'ln(1 + {c}) AS {c}' if c in K.LOG_FEATURES else c) for c in K.CLIENT_FEATURES)}
  FROM cf),
st AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in K.CLIENT_FEATURES)} FROM lg),
sc AS (
  SELECT NomCliente, _n_pen, _n_usd,
         {', '.join(f'({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END AS {c}' for c in K.CLIENT_FEATURES)}
  FROM lg, st),
cl AS (SELECT NomCliente, CAST(cantidad_registros >= 0 AS INTEGER) AS cluster_validado FROM sc),
cm AS (SELECT cluster_validado, median(cantidad_registros) AS act FROM cf JOIN cl USING (NomCliente) GROUP BY 1),
topc AS (SELECT cluster_validado AS top FROM cm ORDER BY act DESC, cluster_validado LIMIT 1),
seg AS (
  SELECT cf.*, cl.cluster_validado,
         CASE WHEN cl.cluster_validado = (SELECT top FROM topc) THEN {q(K.SEGMENT_HIGH)} ELSE {q(K.SEGMENT_LOW)} END
           AS segmento_negocio
  FROM cf JOIN cl USING (NomCliente))"""


_BUILT: dict = {}


def _cached(spark, sf_dir, kind, build):
    """What several queries start from, built once per session and version of its sources."""
    version = "".join(source_version(spark, f"{sf_dir.rstrip('/')}/{t}.parquet") for t in TABLES)
    key = (spark.sparkContext.applicationId, version, kind)
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def _clients_ready(spark, sf_dir):
    from ..operators import clients as C
    lines = load_lines(spark, sf_dir)
    return lines, _cached(spark, sf_dir, "clients", lambda: materialize(C.client_features(lines)))


def _rule_segmented(spark, sf_dir):
    from ..operators import clients as C
    lines, feats = _clients_ready(spark, sf_dir)
    return lines, _cached(spark, sf_dir, "segments", lambda: materialize(
        C.label_segments(feats, C.rule_clusters(C.scaled_features(feats)))))


@register("client_billing_pivot", with_lines(f""", {_M_SQL}
SELECT NomCliente, {R(_sum_cur(K.PEN))} AS facturacion_soles_total, {R(_sum_cur(K.USD))} AS facturacion_dolares_total
FROM m GROUP BY NomCliente"""))
def q_client_billing_pivot(spark, sf_dir):
    from ..operators import clients as C
    return rounded(C.client_billing_pivot(load_lines(spark, sf_dir)))


@register("client_operations", with_lines(f""", {_M_SQL}
SELECT NomCliente, {R("median(pdo)")} AS porcentaje_diferencia_mediana, {R("sum(nParticipante)")} AS participantes_total,
       {R("avg(duracion)")} AS duracion_promedio, {R("avg(CAST(propuesta_convertida AS INTEGER))")} AS tasa_conversion_hp_oi,
       CAST(count(DISTINCT Desc_Servicio) AS BIGINT) AS cantidad_servicios_distintos,
       CAST(count(*) AS BIGINT) AS cantidad_registros
FROM m GROUP BY NomCliente"""))
def q_client_operations(spark, sf_dir):
    from ..operators import clients as C
    return rounded(C.client_operations(load_lines(spark, sf_dir)))


@register("client_features", with_lines(f""", {_CF_SQL}
SELECT NomCliente, {', '.join(f'{R(c)} AS {c}' for c in K.CLIENT_FEATURES)} FROM cf"""))
def q_client_features(spark, sf_dir):
    _, feats = _clients_ready(spark, sf_dir)
    return rounded(feats.select("NomCliente", *K.CLIENT_FEATURES))


@register("client_scaled_features", with_lines(f""", {_CF_SQL}
SELECT NomCliente, {', '.join(f'{R(c)} AS {c}' for c in K.CLIENT_FEATURES)} FROM sc"""))
def q_client_scaled_features(spark, sf_dir):
    from ..operators import clients as C
    _, feats = _clients_ready(spark, sf_dir)
    return rounded(C.scaled_features(feats).select("NomCliente", *K.CLIENT_FEATURES))


@register("rule_segments", with_lines(f""", {_CF_SQL}
SELECT NomCliente, cluster_validado, segmento_negocio FROM seg"""))
def q_rule_segments(spark, sf_dir):
    _, seg = _rule_segmented(spark, sf_dir)
    return seg.select("NomCliente", "cluster_validado", "segmento_negocio")


_SEG_SUMMARY_SQL = f"""
, per AS (
  SELECT cluster_validado, any_value(segmento_negocio) AS Segmento, CAST(count(*) AS BIGINT) AS Clientes,
         sum(cantidad_registros) AS ops, sum(facturacion_soles_total) AS pen, sum(facturacion_dolares_total) AS usd,
         median(cantidad_registros) AS Operaciones_por_cliente_mediana,
         median(cantidad_servicios_distintos) AS Servicios_distintos_mediana,
         median(participantes_total) AS Participantes_mediana,
         median(tasa_conversion_hp_oi) * 100.0 AS Conversion_HP_OI_mediana_pct,
         median(duracion_promedio) AS Duracion_mediana,
         median(facturacion_soles_total) AS Facturacion_PEN_por_cliente_mediana,
         median(facturacion_dolares_total) AS Facturacion_USD_por_cliente_mediana
  FROM seg GROUP BY cluster_validado),
summ AS (
  SELECT cluster_validado, Segmento, Clientes,
         {R("Clientes / sum(Clientes) OVER () * 100.0")} AS pct_clientes,
         {R("ops / sum(ops) OVER () * 100.0")} AS pct_operaciones,
         {R("CASE WHEN sum(pen) OVER () <> 0 THEN pen / sum(pen) OVER () * 100.0 END")} AS pct_facturacion_PEN,
         {R("CASE WHEN sum(usd) OVER () <> 0 THEN usd / sum(usd) OVER () * 100.0 END")} AS pct_facturacion_USD,
         {', '.join(f'{R(c)} AS {c}' for c in ['Operaciones_por_cliente_mediana', 'Servicios_distintos_mediana', 'Participantes_mediana', 'Conversion_HP_OI_mediana_pct', 'Duracion_mediana', 'Facturacion_PEN_por_cliente_mediana', 'Facturacion_USD_por_cliente_mediana'])}
  FROM per)"""


@register("segment_summary", with_lines(f""", {_CF_SQL} {_SEG_SUMMARY_SQL}
SELECT * FROM summ"""))
def q_segment_summary(spark, sf_dir):
    from ..operators import clients as C
    _, seg = _rule_segmented(spark, sf_dir)
    return rounded(C.segment_summary(seg))


@register("segment_shares_long", with_lines(f""", {_CF_SQL} {_SEG_SUMMARY_SQL}
SELECT Segmento, metrica, valor FROM summ
UNPIVOT INCLUDE NULLS (valor FOR metrica IN (pct_clientes, pct_operaciones, pct_facturacion_PEN, pct_facturacion_USD))"""))
def q_segment_shares_long(spark, sf_dir):
    from ..operators import clients as C
    _, seg = _rule_segmented(spark, sf_dir)
    return rounded(C.segment_shares_long(C.segment_summary(seg)))


@register("top_clients_by_segment", with_lines(f""", {_CF_SQL},
pc AS (
  SELECT segmento_negocio, NomCliente, {q(K.PEN)} AS Moneda, _n_pen AS n, facturacion_soles_total AS Facturacion FROM seg
  UNION ALL
  SELECT segmento_negocio, NomCliente, {q(K.USD)}, _n_usd, facturacion_dolares_total FROM seg),
rk AS (
  SELECT *, row_number() OVER (PARTITION BY segmento_negocio, Moneda ORDER BY Facturacion DESC, NomCliente) AS Posicion
  FROM pc WHERE n > 0)
SELECT segmento_negocio AS Segmento, Moneda, CAST(Posicion AS INTEGER) AS Posicion, NomCliente AS Cliente,
       {R("Facturacion")} AS Facturacion
FROM rk WHERE Posicion <= {K.TOP_CLIENTS_PER_SEGMENT}"""))
def q_top_clients_by_segment(spark, sf_dir):
    from ..operators import clients as C
    _, seg = _rule_segmented(spark, sf_dir)
    return rounded(C.top_clients(seg))


def finalize(df: DataFrame) -> DataFrame:
    """Oracle-stable output: decimals -> double, timestamps -> text, round."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = F.round(c.cast("double"), DIGITS)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, DIGITS)
        cols.append(c.alias(f.name))
    return df.select(*cols)


_TS_COLS = {"Fecha", "FechaOI"}
_DEC_COLS = {"ImporteB", "impFacturado", "diferencia_facturacion", "ingreso_neto_estimado"}
_DBL_COLS = {"duracion", "nParticipante"}


def _sql_col(c: str, prefix: str = "") -> str:
    if c in _TS_COLS:
        return f"strftime({prefix}{c}, '%Y-%m-%d %H:%M:%S') AS {c}"
    if c in _DEC_COLS or c in _DBL_COLS:
        return f"{R(prefix + c)} AS {c}"
    return f"{prefix}{c} AS {c}"


_DASH_SQL = f""",
dash AS (
  SELECT l.case_id, {', '.join('l.' + c for c in K.DASHBOARD_COLUMNS)},
         coalesce(seg.segmento_negocio, {q(K.SEGMENT_NONE)}) AS segmento_negocio
  FROM lines l LEFT JOIN seg ON l.NomCliente = seg.NomCliente),
cases AS (
  SELECT * FROM dash
  WHERE ImporteB IS NOT NULL AND MON IN ({q(K.PEN)}, {q(K.USD)}) AND Fecha IS NOT NULL)"""

_CASE_COLS = ["case_id", *K.DASHBOARD_COLUMNS, "segmento_negocio"]


def _cases(spark, sf_dir):
    """All eligible cases with their segment."""
    from ..operators import clients as C
    lines, seg = _rule_segmented(spark, sf_dir)
    return C.dashboard_table(C.eligible_cases(lines), seg)


@register("dashboard_table", with_lines(f""", {_CF_SQL} {_DASH_SQL}
SELECT {', '.join(_sql_col(c) for c in _CASE_COLS)} FROM dash"""))
def q_dashboard_table(spark, sf_dir):
    from ..operators import clients as C
    return finalize(C.dashboard_table(*_rule_segmented(spark, sf_dir)))


@register("recent_cases", with_lines(f""", {_CF_SQL} {_DASH_SQL}
SELECT {', '.join(_sql_col(c) for c in _CASE_COLS)} FROM (SELECT * FROM cases ORDER BY Fecha DESC, case_id LIMIT {K.RECENT_CASES})"""))
def q_recent_cases(spark, sf_dir):
    from ..operators import clients as C
    return finalize(C.recent_cases(*_rule_segmented(spark, sf_dir)))


@register("case_lookup", with_lines(f""", {_CF_SQL} {_DASH_SQL},
probe AS (SELECT 'no-such-case' AS wanted UNION ALL SELECT NULL UNION ALL SELECT max(case_id) FROM cases
          UNION ALL SELECT min(case_id) FROM cases),
pick AS (
  SELECT p.wanted, c.*, row_number() OVER (PARTITION BY p.wanted
           ORDER BY CAST(coalesce(c.case_id = p.wanted, false) AS INTEGER) DESC, c.Fecha DESC, c.case_id) AS rn
  FROM probe p, cases c)
SELECT wanted, {', '.join(_sql_col(c) for c in _CASE_COLS)} FROM pick WHERE rn = 1"""))
def q_case_lookup(spark, sf_dir):
    from ..operators import clients as C
    from ..operators.cases import case_lookup
    lines, seg = _rule_segmented(spark, sf_dir)
    cases = C.eligible_cases(lines)
    wanted = cases.agg(F.array(F.max("case_id"), F.min("case_id"), F.lit("no-such-case"), F.lit(None)).alias("w")) \
        .select(F.explode("w").alias("wanted"))
    # the segment joins the cases that were found, not all of them
    found = case_lookup(cases.select("case_id", *K.DASHBOARD_COLUMNS), wanted)
    return finalize(C.with_segment(found, seg).select("wanted", *_CASE_COLS))


def _number_sql(v: str, decimals: int = 0) -> str:
    return f"format('{{:,.{decimals}f}}', CAST({v} AS DOUBLE))"


def _money_sql(v: str, cur: str) -> str:
    return f"CASE WHEN {cur} = {q(K.PEN)} THEN 'S/' ELSE 'US$' END || ' ' || {_number_sql(v)}"


def _short_sql(col: str, n: int) -> str:
    v = f"CASE WHEN {col} IS NULL OR {col} = '' THEN {q(K.NOT_SPECIFIED)} ELSE {col} END"
    head = f"regexp_replace(substr({v}, 1, {n - 1}), '{_WS}+$', '')"
    return f"CASE WHEN length({v}) <= {n} THEN {v} ELSE {head} || {q(K.ELLIPSIS)} END"


@register("case_labels", with_lines(f""", {_CF_SQL} {_DASH_SQL}
SELECT case_id,
       coalesce(strftime(Fecha, '%d/%m/%Y'), 'Sin fecha') || ' · HP ' || coalesce(CAST(numHP AS VARCHAR), 'N/E')
       || ' · ' || {_short_sql('NomCliente', 30)} || ' · ' || {_short_sql('Desc_Servicio', 35)} || ' · ' || MON
       AS label
FROM cases"""))
def q_case_labels(spark, sf_dir):
    from ..operators.cases import case_labels
    from ..operators.clients import eligible_cases
    return case_labels(eligible_cases(load_lines(spark, sf_dir)))


@register("case_summaries", with_lines(f""", {_CF_SQL} {_DASH_SQL}
SELECT case_id, coalesce(strftime(Fecha, '%d/%m/%Y'), {q(K.NOT_SPECIFIED)}) AS fecha,
       coalesce(CAST(numHP AS VARCHAR), {q(K.NOT_SPECIFIED)}) AS hp, NomCliente AS cliente,
       Desc_Servicio AS servicio, DES_AO AS area, MON AS moneda,
       {R("coalesce(CAST(ImporteB AS DOUBLE), 0.0)")} AS importe,
       {R("coalesce(nParticipante, 0.0)")} AS participantes,
       {R(f"coalesce(duracion, {K.DEFAULT_DURATION})")} AS duracion,
       {R("CAST(impFacturado AS DOUBLE)")} AS facturacion_real,
       Desc_Estado AS estado, segmento_negocio AS segmento,
       {_money_sql("coalesce(CAST(ImporteB AS DOUBLE), 0.0)", "MON")} AS importe_texto
FROM cases"""))
def q_case_summaries(spark, sf_dir):
    from ..operators.cases import case_summaries
    return finalize(case_summaries(_cases(spark, sf_dir)))


_SPLIT_SQL = f""",
base AS (SELECT * FROM lines WHERE impFacturado IS NOT NULL AND impFacturado > 0
         AND MON IN ({q(K.PEN)}, {q(K.USD)}) AND ImporteB IS NOT NULL),
hs AS (SELECT *, md5(case_id || '|{K.RANDOM_STATE}') AS h FROM base),
sp AS (SELECT *, row_number() OVER (PARTITION BY MON ORDER BY h, case_id)
                 <= ceil({K.TEST_SIZE} * count(*) OVER (PARTITION BY MON)) AS is_test FROM hs),
th AS (SELECT MON, median(CAST(impFacturado AS DOUBLE)) AS umbral FROM sp WHERE NOT is_test GROUP BY MON),
lab AS (SELECT sp.*, th.umbral, CAST(CAST(impFacturado AS DOUBLE) > umbral AS INTEGER) AS target
        FROM sp JOIN th USING (MON)),
ev AS (SELECT case_id, MON, ANIO, DES_AO, target AS real,
              CAST(ImporteB AS DOUBLE) / (CAST(ImporteB AS DOUBLE) + umbral) AS probabilidad_alta,
              CAST(CAST(ImporteB AS DOUBLE) / (CAST(ImporteB AS DOUBLE) + umbral) >= 0.5 AS INTEGER) AS prediccion,
              CAST(impFacturado AS DOUBLE) AS yreal, CAST(ImporteB AS DOUBLE) AS yhat
       FROM lab WHERE is_test)"""


_POINTS_SQL = ", ".join(f"({a}, {p}, {d})" for a, p, d in K.SCENARIO_POINTS)
_ELIGIBLE_SQL = f""",
cases AS (SELECT * FROM lines WHERE ImporteB IS NOT NULL AND MON IN ({q(K.PEN)}, {q(K.USD)}) AND Fecha IS NOT NULL)"""
_SCENARIO_SQL = f"""
, s AS (
  SELECT c.case_id, pa AS pct_importe, pp AS pct_participantes, pd AS pct_duracion, MON,
         NomCliente, Desc_Servicio, DES_AO, CAST(impFacturado AS DOUBLE) AS billed,
         greatest(0.0, coalesce(CAST(ImporteB AS DOUBLE), 0.0) * (1.0 + pa / 100.0)) AS amount,
         greatest(0.0, coalesce(nParticipante, 0.0) * (1.0 + pp / 100.0)) AS participants,
         greatest(1.0, greatest(0.0, coalesce(CASE WHEN duracion = 0 THEN {K.DEFAULT_DURATION} ELSE duracion END
                                           * (1.0 + pd / 100.0), 0.0))) AS duration
  FROM cases c, (VALUES {_POINTS_SQL}) t(pa, pp, pd)),
f AS (
  SELECT *, amount / (amount + 50000.0) AS p,
         CASE WHEN amount / (amount + 50000.0) >= 0.75 THEN {q(K.BAND_HIGH[1])}
              WHEN amount / (amount + 50000.0) >= 0.5 THEN {q(K.BAND_MID_HIGH[1])}
              WHEN amount / (amount + 50000.0) >= 0.3 THEN {q(K.BAND_MID[1])} ELSE {q(K.BAND_LOW)} END AS level
  FROM s)"""
_MESSAGE_SQL = "CASE level " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in K.BAND_MESSAGES.items()) + " END"


def _formula_scored(spark, sf_dir):
    from ..operators import clients as C
    from ..operators import scenarios as S
    return S.formula_scores(S.scenario_grid(C.eligible_cases(load_lines(spark, sf_dir)), K.SCENARIO_POINTS))


@register("scenario_grid", with_lines(f"""{_ELIGIBLE_SQL} {_SCENARIO_SQL} {_SPLIT_SQL}
SELECT f.case_id, CAST(pct_importe AS INTEGER) AS pct_importe, CAST(pct_participantes AS INTEGER) AS pct_participantes,
       CAST(pct_duracion AS INTEGER) AS pct_duracion, f.MON,
       {R("amount")} AS ImporteB, {R("participants")} AS nParticipante, {R("duration")} AS duracion,
       {R("p")} AS probability, CAST(p >= 0.5 AS INTEGER) AS classification, level, {_MESSAGE_SQL} AS message,
       {R("least(100.0, greatest(0.0, p * 100.0))")} AS gauge,
       {R("amount * 0.97")} AS estimate, {R("amount * 0.97 * 0.8")} AS range_low, {R("amount * 0.97 * 1.2")} AS range_high,
       {R("th.umbral")} AS threshold
FROM f JOIN th ON f.MON = th.MON"""))
def q_scenario_grid(spark, sf_dir):
    _, th, _ = _labeled(spark, sf_dir)
    scored = _formula_scored(spark, sf_dir).join(F.broadcast(th), "MON")  # a row a currency
    return finalize(scored.select(
        "case_id", "pct_importe", "pct_participantes", "pct_duracion", "MON", "ImporteB", "nParticipante",
        "duracion", "probability", "classification", "level", "message", "gauge", "estimate", "range_low", "range_high",
        F.col("umbral").alias("threshold")))


_DETAIL_SQL = ", ".join(f"({q(n)}, {v})" for n, v in zip(K.DETAIL_VARIABLES, [
    "NomCliente", "Desc_Servicio", "DES_AO", _money_sql("amount", "MON"), _number_sql("participants"),
    _number_sql("duration"), _number_sql("p * 100.0", 1) + " || '%'",
    f"CASE WHEN billed IS NULL THEN {q(K.NO_BILLING)} ELSE {_money_sql('billed', 'MON')} END"]))


@register("scenario_detail", with_lines(f"""{_ELIGIBLE_SQL} {_SCENARIO_SQL}
SELECT case_id, CAST(pct_importe AS INTEGER) AS pct_importe, CAST(pct_participantes AS INTEGER) AS pct_participantes,
       CAST(pct_duracion AS INTEGER) AS pct_duracion, variable, valor
FROM f, LATERAL (VALUES {_DETAIL_SQL}) d(variable, valor)"""))
def q_scenario_detail(spark, sf_dir):
    from ..operators import scenarios as S
    return S.scenario_detail(_formula_scored(spark, sf_dir))


# --------------------------------------------------------------------------
# Split, thresholds, targets, preprocessing statistics, evaluation
# --------------------------------------------------------------------------

def _split(spark, sf_dir):
    """The modelling rows with their split, which thresholds, metrics and forests all start from."""
    from ..operators import split as SP
    return _cached(spark, sf_dir, "split", lambda: materialize(
        SP.stratified_split(SP.modelling_base(load_lines(spark, sf_dir)))))


def _labeled(spark, sf_dir):
    from ..operators import split as SP
    sp = _split(spark, sf_dir)
    th = _cached(spark, sf_dir, "thresholds", lambda: materialize(SP.train_thresholds(sp)))
    return sp, th, SP.label_targets(sp, th)


def _eval_frame(spark, sf_dir):
    _, _, lab = _labeled(spark, sf_dir)
    p = F.col("ImporteB").cast("double") / (F.col("ImporteB").cast("double") + F.col("umbral"))
    return lab.where("is_test").select(
        "case_id", "MON", "ANIO", "DES_AO", F.col("target").alias("real"), p.alias("probabilidad_alta"),
        (p >= K.DECISION_THRESHOLD).cast("int").alias("prediccion"),
        F.col("impFacturado").cast("double").alias("yreal"), F.col("ImporteB").cast("double").alias("yhat"))


@register("model_split", with_lines(_SPLIT_SQL + "\nSELECT case_id, MON, is_test FROM sp"))
def q_model_split(spark, sf_dir):
    sp, _, _ = _labeled(spark, sf_dir)
    return sp.select("case_id", "MON", "is_test")


@register("train_thresholds", with_lines(_SPLIT_SQL + f"\nSELECT MON, {R('umbral')} AS umbral FROM th"))
def q_train_thresholds(spark, sf_dir):
    _, th, _ = _labeled(spark, sf_dir)
    return rounded(th)


@register("labeled_targets", with_lines(_SPLIT_SQL + "\nSELECT case_id, MON, is_test, target FROM lab"))
def q_labeled_targets(spark, sf_dir):
    _, _, lab = _labeled(spark, sf_dir)
    return lab.select("case_id", "MON", "is_test", "target")


@register("class_weights", with_lines(_SPLIT_SQL + f"""
SELECT target, CAST(count(*) AS BIGINT) AS n_clase, {R("sum(count(*)) OVER () / (2.0 * count(*))")} AS peso
FROM lab WHERE NOT is_test GROUP BY target"""))
def q_class_weights(spark, sf_dir):
    from ..operators import split as SP
    _, _, lab = _labeled(spark, sf_dir)
    return rounded(SP.class_weights(lab))


@register("imputer_medians", with_lines(_SPLIT_SQL + f"""
SELECT {', '.join(f"{R(f'median(CAST({c} AS DOUBLE))')} AS {c}" for c in K.NUMERIC_FEATURES)}
FROM sp WHERE NOT is_test"""))
def q_imputer_medians(spark, sf_dir):
    from ..operators import split as SP
    sp, _, _ = _labeled(spark, sf_dir)
    return rounded(SP.imputer_medians(sp))


@register("category_buckets", with_lines(_SPLIT_SQL + f""",
lg AS ({' UNION ALL '.join(f"SELECT {q(c)} AS variable, CAST({c} AS VARCHAR) AS categoria FROM sp WHERE NOT is_test" for c in K.CATEGORICAL_CLASS_FEATURES)})
SELECT variable, categoria, CAST(count(*) AS BIGINT) AS n,
       CASE WHEN count(*) >= {K.MIN_FREQUENCY_CLASS} THEN categoria ELSE 'infrequent_sklearn' END AS bucket
FROM lg GROUP BY variable, categoria"""))
def q_category_buckets(spark, sf_dir):
    from ..operators import split as SP
    sp, _, _ = _labeled(spark, sf_dir)
    return SP.category_buckets(sp)


_AUC_SQL = """
auc AS (
  SELECT (sum(CASE WHEN real = 1 THEN ar END) - sum(real) * (sum(real) + 1) / 2.0)
         / (CAST(sum(real) AS DOUBLE) * (count(*) - sum(real))) AS ROC_AUC
  FROM (SELECT real, rank() OVER (ORDER BY probabilidad_alta)
                     + (count(*) OVER (PARTITION BY probabilidad_alta) - 1) / 2.0 AS ar FROM ev))"""


@register("classification_metrics", with_lines(_SPLIT_SQL + f""", {_AUC_SQL},
cm AS (SELECT count(*) AS n, count_if(real = 1 AND prediccion = 1) AS tp, count_if(real = 0 AND prediccion = 1) AS fp,
              count_if(real = 1 AND prediccion = 0) AS fn, count_if(real = 0 AND prediccion = 0) AS tn FROM ev)
SELECT {R("coalesce((tp + tn) / NULLIF(CAST(n AS DOUBLE), 0), 0.0)")} AS Accuracy,
       {R("coalesce(tp / NULLIF(CAST(tp + fp AS DOUBLE), 0), 0.0)")} AS Precision,
       {R("coalesce(tp / NULLIF(CAST(tp + fn AS DOUBLE), 0), 0.0)")} AS Recall,
       {R("coalesce(2 * tp / NULLIF(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0.0)")} AS F1,
       CAST(n AS BIGINT) AS Muestra_prueba, {R("ROC_AUC")} AS ROC_AUC
FROM cm, auc"""))
def q_classification_metrics(spark, sf_dir):
    from ..operators import evaluate as EV
    return rounded(EV.classification_metrics(_eval_frame(spark, sf_dir)))


@register("confusion_cells", with_lines(_SPLIT_SQL + """,
sp2 AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(r, p))
SELECT CAST(r AS INTEGER) AS real, CAST(p AS INTEGER) AS prediccion, CAST(count(ev.real) AS BIGINT) AS casos
FROM sp2 LEFT JOIN ev ON ev.real = sp2.r AND ev.prediccion = sp2.p GROUP BY r, p"""))
def q_confusion_cells(spark, sf_dir):
    from ..operators import evaluate as EV
    return EV.confusion_cells(_eval_frame(spark, sf_dir)).select(
        F.col("real").cast("int").alias("real"), F.col("prediccion").cast("int").alias("prediccion"),
        F.col("casos").cast("bigint").alias("casos"))


@register("roc_auc_rank", with_lines(_SPLIT_SQL + f", {_AUC_SQL}\nSELECT {R('ROC_AUC')} AS ROC_AUC FROM auc"))
def q_roc_auc_rank(spark, sf_dir):
    from ..operators import evaluate as EV
    return rounded(EV.roc_auc(_eval_frame(spark, sf_dir), "real", "probabilidad_alta"))


def _reg_metrics_sql(where: str, by: str | None):
    sel = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""
SELECT {sel}CAST(count(*) AS BIGINT) AS records,
       {R("CASE WHEN count(*) >= 2 THEN avg(abs(yreal - yhat)) END")} AS mae,
       {R("CASE WHEN count(*) >= 2 THEN sqrt(avg((yreal - yhat) * (yreal - yhat))) END")} AS rmse,
       {R('''CASE WHEN count(*) > 2 THEN CASE WHEN var_pop(yreal) * count(*) = 0
             THEN CASE WHEN sum((yreal - yhat) * (yreal - yhat)) = 0 THEN 1.0 ELSE 0.0 END
             ELSE 1.0 - sum((yreal - yhat) * (yreal - yhat)) / (var_pop(yreal) * count(*)) END END''')} AS r2
FROM ev WHERE yreal IS NOT NULL AND yhat IS NOT NULL {where} {grp}"""


@register("regression_metrics", with_lines(_SPLIT_SQL + _reg_metrics_sql("", "MON")))
def q_regression_metrics(spark, sf_dir):
    from ..operators import evaluate as EV
    ev = _eval_frame(spark, sf_dir)
    return rounded(EV.regression_metrics(ev, ["MON"], "yreal", "yhat"))


SUBSET = (K.PEN, (1996, 1999), "LARGE")


@register("regression_subset", with_lines(_SPLIT_SQL + _reg_metrics_sql(
    f"AND MON = {q(SUBSET[0])} AND ANIO BETWEEN {SUBSET[1][0]} AND {SUBSET[1][1]} AND DES_AO = {q(SUBSET[2])}", None)))
def q_regression_subset(spark, sf_dir):
    from ..operators import evaluate as EV
    ev = _eval_frame(spark, sf_dir).drop("real", "prediccion") \
        .withColumnsRenamed({"yreal": "real", "yhat": "prediccion"})
    return rounded(EV.regression_metrics(EV.regression_subset(ev, *SUBSET)))


@register("regression_points", with_lines(_SPLIT_SQL + f""",
pts AS (SELECT case_id, yreal, yhat FROM ev WHERE yreal IS NOT NULL AND yhat IS NOT NULL AND MON = {q(SUBSET[0])}
        AND ANIO BETWEEN {SUBSET[1][0]} AND {SUBSET[1][1]} AND DES_AO = {q(SUBSET[2])})
SELECT case_id, {R('yreal')} AS real, {R('yhat')} AS prediccion,
       {R('(SELECT greatest(max(yreal), max(yhat)) FROM pts)')} AS eje_max FROM pts"""))
def q_regression_points(spark, sf_dir):
    from ..operators import evaluate as EV
    ev = _eval_frame(spark, sf_dir).drop("real", "prediccion") \
        .withColumnsRenamed({"yreal": "real", "yhat": "prediccion"})
    pts = EV.regression_subset(ev, *SUBSET).select("case_id", "real", "prediccion")
    return rounded(pts.withColumn("eje_max", EV.axis_max(pts)))


# --------------------------------------------------------------------------
# Models (rows-only checks): forests, intervals, importances, K-Means, PCA
# --------------------------------------------------------------------------

def _classifier(spark, sf_dir):
    from ..operators import models as M
    return _cached(spark, sf_dir, "clf", lambda: M.train_classifier(
        load_lines(spark, sf_dir), M.ForestParams(), _split(spark, sf_dir)))


def _class_scores(spark, sf_dir):
    """What the metrics read of the test predictions, scored and written once."""
    from ..operators import models as M
    return _cached(spark, sf_dir, "class_scores", lambda: materialize(
        M.classification_predictions(_classifier(spark, sf_dir)).select("real", "prediccion", "probabilidad_alta")))


def _regressors(spark, sf_dir):
    from ..operators import models as M
    return _cached(spark, sf_dir, "reg", lambda: M.train_regressors(
        load_lines(spark, sf_dir), M.ForestParams(), _split(spark, sf_dir)))


def _segmentation(spark, sf_dir):
    from ..operators import segments as SG
    return _cached(spark, sf_dir, "seg", lambda: SG.build_segments(_clients_ready(spark, sf_dir)[1]))


@register("rf_class_predictions")
def q_rf_class_predictions(spark, sf_dir):
    from ..operators import models as M
    return finalize(M.classification_predictions(_classifier(spark, sf_dir)))


@register("rf_class_metrics")
def q_rf_class_metrics(spark, sf_dir):
    from ..operators import evaluate as EV
    return rounded(EV.classification_metrics(_class_scores(spark, sf_dir)))


@register("rf_class_confusion")
def q_rf_class_confusion(spark, sf_dir):
    from ..operators import evaluate as EV
    from ..operators import models as M
    return EV.confusion_cells(M.classification_predictions(_classifier(spark, sf_dir)))


@register("rf_class_importance")
def q_rf_class_importance(spark, sf_dir):
    from ..operators import models as M
    m = _classifier(spark, sf_dir)
    return rounded(M.importances(spark, m.preprocessor, m.forest, m.test, K.CATEGORICAL_CLASS_FEATURES))


@register("rf_reg_predictions")
def q_rf_reg_predictions(spark, sf_dir):
    from ..operators import models as M
    return finalize(M.regression_predictions(_regressors(spark, sf_dir)))


@register("rf_reg_metrics")
def q_rf_reg_metrics(spark, sf_dir):
    from ..operators import evaluate as EV
    from ..operators import models as M
    preds = M.regression_predictions(_regressors(spark, sf_dir))
    return rounded(EV.regression_metrics(preds, ["MON"]))


@register("rf_reg_importance")
def q_rf_reg_importance(spark, sf_dir):
    from ..operators import models as M
    frames = [M.importances(spark, r.preprocessor, r.forest, r.test, K.CATEGORICAL_REG_FEATURES, cur)
              for cur, r in _regressors(spark, sf_dir).items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return rounded(out)


@register("rf_scenarios")
def q_rf_scenarios(spark, sf_dir):
    """R1 with the trained models: probability, band, estimate and tree range
    for every eligible case x scenario point, each currency on its own regressor."""
    from ..operators import clients as C
    from ..operators import models as M
    from ..operators import scenarios as S
    clf, regs = _classifier(spark, sf_dir), _regressors(spark, sf_dir)
    cases = C.eligible_cases(load_lines(spark, sf_dir))
    scored = M.score_scenarios(clf, regs, cases, K.SCENARIO_POINTS)
    out = S.decorate_scores(scored).join(F.broadcast(clf.thresholds), "MON")
    return finalize(out.select("case_id", "pct_importe", "pct_participantes", "pct_duracion", "MON",
                               "probability", "classification", "level", "message", "gauge", "estimate",
                               "range_low", "range_high", F.col("umbral").alias("threshold")))


# What holds for any model: who is scored, with what truth, and the ranges of the results.

@register("rf_class_invariants", with_lines(_SPLIT_SQL + "\nSELECT case_id, MON, target AS real, true AS ok FROM lab WHERE is_test"))
def q_rf_class_invariants(spark, sf_dir):
    from ..operators import models as M
    p = F.col("probabilidad_alta")
    return M.classification_predictions(_classifier(spark, sf_dir)).select(
        "case_id", "MON", "real", (p.between(0, 1) & (F.col("prediccion") == (p > 0.5).cast("int"))).alias("ok"))


@register("rf_reg_invariants", with_lines(_SPLIT_SQL + f"\nSELECT case_id, MON, {R('yreal')} AS real, true AS ok FROM ev"))
def q_rf_reg_invariants(spark, sf_dir):
    from ..operators import models as M
    ok = (F.col("rango_p10") <= F.col("rango_p90")) & (F.col("prediccion") >= 0)
    return rounded(M.regression_predictions(_regressors(spark, sf_dir)).select("case_id", "MON", "real", ok.alias("ok")))


@register("rf_scenario_invariants", with_lines(f"""{_ELIGIBLE_SQL} {_SCENARIO_SQL}
SELECT case_id, CAST(pct_importe AS INTEGER) AS pct_importe, CAST(pct_participantes AS INTEGER) AS pct_participantes,
       CAST(pct_duracion AS INTEGER) AS pct_duracion, MON, true AS ok FROM s"""))
def q_rf_scenario_invariants(spark, sf_dir):
    ok = F.col("probability").between(0, 1) & (F.col("estimate") >= 0) & (F.col("range_low") <= F.col("range_high"))
    return q_rf_scenarios(spark, sf_dir).select("case_id", "pct_importe", "pct_participantes", "pct_duracion", "MON", ok.alias("ok"))


@register("kmeans_invariants", with_lines(f""", {_CF_SQL}
SELECT NomCliente, {', '.join(f'{R(c)} AS {c}' for c in K.CLIENT_FEATURES)}, true AS ok FROM cf"""))
def q_kmeans_invariants(spark, sf_dir):
    seg = _segmentation(spark, sf_dir)
    ok = F.col("segmento_negocio").isin(K.SEGMENT_HIGH, K.SEGMENT_LOW) & F.col("cluster_validado").between(0, seg.k - 1)
    return rounded(seg.clients.select("NomCliente", *K.CLIENT_FEATURES, ok.alias("ok")))


@register("rf_quality", with_lines(_SPLIT_SQL + """
SELECT 'clasificacion' AS modelo, NULL AS MON, CAST(count(*) AS BIGINT) AS muestra, true AS ok FROM ev
UNION ALL SELECT 'regresion', MON, CAST(count(*) AS BIGINT), true FROM ev GROUP BY MON"""))
def q_rf_quality(spark, sf_dir):
    """The forests reach the quality floors on the test rows; a constant model reaches neither."""
    from ..operators import evaluate as EV
    from ..operators import models as M
    clf = EV.classification_metrics(_class_scores(spark, sf_dir))
    reg = EV.regression_metrics(M.regression_predictions(_regressors(spark, sf_dir)), ["MON"])
    return clf.select(F.lit("clasificacion").alias("modelo"), F.lit(None).cast("string").alias("MON"),
                      F.col("Muestra_prueba").alias("muestra"), (F.col("ROC_AUC") > K.AUC_FLOOR).alias("ok")) \
        .unionByName(reg.select(F.lit("regresion").alias("modelo"), "MON", F.col("records").alias("muestra"),
                                (F.col("r2") > K.R2_FLOOR).alias("ok")))


@register("rf_class_margins", with_lines(_SPLIT_SQL + f"""
SELECT (SELECT CAST(count(*) AS BIGINT) FROM sp) AS Registros, CAST(count(*) AS BIGINT) AS Muestra_prueba,
       CAST(count_if(real = 0) AS BIGINT) AS negativos, CAST(count_if(real = 1) AS BIGINT) AS positivos,
       (SELECT {R('umbral')} FROM th WHERE MON = {q(K.PEN)}) AS umbral_pen,
       (SELECT {R('umbral')} FROM th WHERE MON = {q(K.USD)}) AS umbral_usd, true AS ok
FROM ev"""))
def q_rf_class_margins(spark, sf_dir):
    """What any classifier's report must say: sizes, thresholds, both rows of the confusion matrix;
    ``ok``: its accuracy is that of the matrix, and the JSON fields read back as the nested ones."""
    r = _class_record(spark, sf_dir)
    cells = F.col("Matriz_confusion")
    right = (cells[0][0] + cells[1][1]) / F.col("Muestra_prueba")
    back = F.from_json("Umbrales_json", "map<string, double>")[K.PEN].eqNullSafe(F.col("Umbrales")[K.PEN]) & \
        (F.from_json("Matriz_confusion_json", "array<array<bigint>>") == cells)
    return rounded(r.select(
        "Registros", "Muestra_prueba", (cells[0][0] + cells[0][1]).alias("negativos"),
        (cells[1][0] + cells[1][1]).alias("positivos"), F.col("Umbrales")[K.PEN].alias("umbral_pen"),
        F.col("Umbrales")[K.USD].alias("umbral_usd"), ((F.abs(right - F.col("Accuracy")) < 1e-9) & back).alias("ok")))


def _importance_sql(modelo: str, moneda: str, categorical) -> str:
    rows = ", ".join(f"({q(v)}, {q(K.BUSINESS_NAMES[v]) if v in K.BUSINESS_NAMES else 'NULL'})"
                     for v in [*K.NUMERIC_FEATURES, *categorical])
    source = "(SELECT NULL AS MON)" if moneda == "NULL" else "(SELECT DISTINCT MON FROM lab)"
    return f"SELECT {q(modelo)} AS modelo, {moneda} AS Moneda, v AS Variable_tecnica, b AS Nombre_para_negocio, true AS ok " \
        f"FROM {source} c, (VALUES {rows}) t(v, b)"


@register("rf_importance_shares", with_lines(_SPLIT_SQL + "\n" + _importance_sql("clasificacion", "NULL", K.CATEGORICAL_CLASS_FEATURES)
                                             + " UNION ALL " + _importance_sql("regresion", "MON", K.CATEGORICAL_REG_FEATURES)))
def q_rf_importance_shares(spark, sf_dir):
    """One row a model and source variable with its business name; ``ok``: a model's shares are not
    negative and sum to 100, and the top eight are those that no other variable exceeds."""
    from ..operators.report import importance_for, top_importances
    clf = q_rf_class_importance(spark, sf_dir).withColumn("Moneda", F.lit(None).cast("string"))
    reg = q_rf_reg_importance(spark, sf_dir)
    top = top_importances(importance_for(reg, K.PEN), 8).agg(F.min("Importancia_pct")).scalar()
    above = reg.where((F.col("Moneda") == K.PEN) & (F.col("Importancia_pct") > top)).agg(F.count(F.lit(1))).scalar()
    every = clf.select(F.lit("clasificacion").alias("modelo"), "*").unionByName(reg.select(F.lit("regresion").alias("modelo"), "*"))
    w = Window.partitionBy("modelo", "Moneda")  # one row a variable
    ok = (F.abs(F.sum("Importancia_pct").over(w) - 100.0) < 1e-3) & (F.min("Importancia_pct").over(w) >= 0)
    return every.select("modelo", "Moneda", "Variable_tecnica", "Nombre_para_negocio", ok.alias("ok")) \
        .withColumn("ok", F.col("ok") & (above < 8))


@register("kmeans_segment_totals", with_lines(f""", {_CF_SQL}
SELECT CAST(count(*) AS BIGINT) AS clientes, 100.0 AS pct_clientes, 100.0 AS pct_operaciones,
       CASE WHEN sum(facturacion_soles_total) <> 0 THEN 100.0 END AS pct_facturacion_PEN,
       CASE WHEN sum(facturacion_dolares_total) <> 0 THEN 100.0 END AS pct_facturacion_USD, true AS ok FROM cf"""))
def q_kmeans_segment_totals(spark, sf_dir):
    """Whatever the clusters: their summary covers all clients and shares add up; ``ok``: as many
    segments as the chosen k, which is the best of the sweep, and the metadata says the same."""
    from ..operators import clients as C
    from ..operators import segments as SG
    seg = _segmentation(spark, sf_dir)
    meta = SG.segment_meta(seg)
    best = seg.scores.agg(F.max_by("k", F.struct("silhouette_score", -F.col("k")))).scalar()
    ok = (F.count(F.lit(1)) == meta.select("k").scalar()) & (best == meta.select("k").scalar()) & \
        (F.sum("Clientes") == meta.select("clientes").scalar())
    return rounded(C.segment_summary(seg.clients).agg(
        F.sum("Clientes").alias("clientes"), *[F.sum(c).alias(c) for c in (
            "pct_clientes", "pct_operaciones", "pct_facturacion_PEN", "pct_facturacion_USD")], ok.alias("ok")))


@register("pca_invariants", with_lines(f""", {_CF_SQL}
SELECT CAST(count(*) AS BIGINT) AS clientes,
       {R(' + '.join(f'var_samp({c})' for c in K.CLIENT_FEATURES))} AS varianza_total, true AS ok FROM sc"""))
def q_pca_invariants(spark, sf_dir):
    """The scaled features' variance, and what any principal components hold: mean 0, no covariance,
    the variances that the metadata says, the first at least that of every feature and of the second."""
    from ..operators import clients as C
    seg = _segmentation(spark, sf_dir)
    scaled = C.scaled_features(_clients_ready(spark, sf_dir)[1])
    of = scaled.agg(*[F.var_samp(c).alias(c) for c in K.CLIENT_FEATURES]).select(
        sum((F.col(c) for c in K.CLIENT_FEATURES), F.lit(0.0)).alias("total"), F.greatest(*K.CLIENT_FEATURES).alias("most"))
    total, most = of.select("total").scalar(), of.select("most").scalar()
    p = seg.clients.agg(F.count(F.lit(1)).alias("clientes"), *[f(c).alias(f"{n}{i}") for i, c in enumerate(("PCA_1", "PCA_2"))
                                                              for n, f in (("m", F.avg), ("v", F.var_samp))],
                        F.covar_samp("PCA_1", "PCA_2").alias("c")).withColumns({"varianza_total": total, "most": most})
    near = [F.abs(F.col(f"m{i}")) < 1e-6 for i in (0, 1)] + [F.abs(F.col("c")) < 1e-6] + [
        F.abs(F.col(f"v{i}") / F.col("varianza_total") - seg.explained_variance[i]) < 1e-6 for i in (0, 1)]
    ok = (F.col("v0") >= F.col("most") - 1e-9) & (F.col("v0") >= F.col("v1"))
    for n in near:
        ok = ok & n
    return rounded(p.select("clientes", "varianza_total", ok.alias("ok")))


@register("kmeans_k_sweep")
def q_kmeans_k_sweep(spark, sf_dir):
    return rounded(_segmentation(spark, sf_dir).scores)


@register("kmeans_segments")
def q_kmeans_segments(spark, sf_dir):
    seg = _segmentation(spark, sf_dir)
    return rounded(seg.clients.select("NomCliente", *K.CLIENT_FEATURES, "cluster_validado", "segmento_negocio",
                                      "PCA_1", "PCA_2"))


@register("kmeans_segment_summary")
def q_kmeans_segment_summary(spark, sf_dir):
    from ..operators import clients as C
    return rounded(C.segment_summary(_segmentation(spark, sf_dir).clients))


@register("pca_points")
def q_pca_points(spark, sf_dir):
    seg = _segmentation(spark, sf_dir)
    return rounded(seg.clients.select("NomCliente", "segmento_negocio", "PCA_1", "PCA_2", "cantidad_registros",
                                      "cantidad_servicios_distintos", "tasa_conversion_hp_oi"))


@register("segment_meta")
def q_segment_meta(spark, sf_dir):
    from ..operators import segments as SG
    return SG.segment_meta(_segmentation(spark, sf_dir))


_ROUNDTRIP_SQL = " UNION ALL ".join(
    f"SELECT {q(f)} AS formato, CAST(count(*) AS BIGINT) AS filas, {R('sum(ImporteB)')} AS importe, "
    f"CAST(sum(length(Desc_Servicio) + length(NomCliente)) AS BIGINT) AS letras, "
    f"CAST(count(Fecha) + count(numHP) + count(dias_conversion_hp_oi) AS BIGINT) AS valores FROM lines"
    for f in ("parquet", "csv", "csv_gz"))


#: Lines above which no further year joins those that are written together.
LINES_TOGETHER = 20_000_000


def _years_together(lines: DataFrame) -> list[list[int | None]]:
    """All years of the lines, the null one too, dealt into parts of consecutive years."""
    parts, room = [], 0
    for r in lines.groupBy("ANIO").count().orderBy("ANIO").collect():
        if r["count"] > room:
            parts, room = [*parts, []], LINES_TOGETHER
        parts[-1].append(r["ANIO"])
        room -= r["count"]
    return parts or [[None]]


@register("sink_roundtrip", with_lines(f"""{_ROUNDTRIP_SQL} UNION ALL
SELECT 'json', CAST({len(K.FUNNEL_ORDER)} AS BIGINT), NULL, CAST({sum(map(len, K.FUNNEL_ORDER))} AS BIGINT), (SELECT CAST(count(*) AS BIGINT) FROM lines)"""))
def q_sink_roundtrip(spark, sf_dir):
    """S1-S11 round trip: write the prepared lines and the funnel in every
    format to the shared folder, read them back, digest their content."""
    from ..operators import funnel
    from ..sources import sinks
    from ..sources.proposals import read_lines
    lines = load_lines(spark, sf_dir)
    base = shared_path(spark, "sinks")
    json_path = f"{base}/json"
    table = lines.select("case_id", *K.DASHBOARD_COLUMNS)
    formats = {"parquet": (lambda df, at: sinks.write_parquet(df, at, ["ANIO"]), "parquet"),
               "csv": (sinks.write_csv, "csv"), "csv_gz": (lambda df, at: sinks.write_csv(df, at, gzip=True), "csv")}
    parts = _years_together(lines)

    def digest(name):
        """Digest of all lines, written and read back in one format, some years at a time: text takes several
        times the room of the stored lines, so a part's files go once they are read."""
        write, fmt = formats[name]
        found = []
        for i, years in enumerate(parts):
            at = f"{base}/{name}-{i}"
            write(table.where(reduce(or_, [F.col("ANIO").eqNullSafe(F.lit(y).cast("int")) for y in years])), at)
            found.append(materialize(read_lines(spark, at, fmt=fmt).agg(
                F.count(F.lit(1)).alias("filas"), F.sum("ImporteB").alias("importe"),
                F.sum(F.length("Desc_Servicio") + F.length("NomCliente")).alias("letras"),
                (F.count("Fecha") + F.count("numHP") + F.count("dias_conversion_hp_oi")).alias("valores"))))
            remove_path(spark, at)
        return reduce(DataFrame.unionByName, found).agg(
            F.sum("filas").alias("filas"), F.sum("importe").cast("double").alias("importe"), F.sum("letras").alias("letras"),
            F.sum("valores").alias("valores")).select(F.lit(name).alias("formato"), "*")

    sinks.write_json(funnel.funnel_stages(lines), json_path)
    stages = sinks.read_json_table(spark, json_path).agg(
        F.count(F.lit(1)).alias("filas"), F.lit(None).cast("double").alias("importe"),
        F.sum(F.length("Etapa")).cast("bigint").alias("letras"), F.sum("Registros").alias("valores")) \
        .select(F.lit("json").alias("formato"), "*")
    out = digest("parquet").unionByName(digest("csv")).unionByName(digest("csv_gz")).unionByName(stages)
    return rounded(out)


# --------------------------------------------------------------------------
# Typed ingest: text round trip with injected bad cells
# --------------------------------------------------------------------------

_BAD_TEXT = {"ImporteB": "n/a", "Fecha": "31/02/xx", "ANIO": "año?", "nParticipante": "NaN",
             "duracion": "inf", "propuesta_convertida": "quizá", "NomCliente": "  "}


def _bad_rule_spark():
    return (F.length("case_id") % 7) == 0


@register("typed_ingest", f"""WITH {RAW_SQL.strip()},
txt AS (
  SELECT case_id,
    CASE WHEN length(case_id) % 7 = 0 THEN {q(_BAD_TEXT['Fecha'])} ELSE strftime(Fecha, '%Y-%m-%d %H:%M:%S') END AS Fecha,
    CASE WHEN length(case_id) % 7 = 0 THEN {q(_BAD_TEXT['ANIO'])} ELSE CAST(ANIO AS VARCHAR) || '.0' END AS ANIO,
    CAST(numHP AS VARCHAR) || CASE WHEN length(case_id) % 2 = 0 THEN '.0' ELSE '.5' END AS numHP,
    CASE WHEN length(case_id) % 7 = 0 THEN {q(_BAD_TEXT['ImporteB'])} ELSE CAST(ImporteB AS VARCHAR) END AS ImporteB,
    CASE WHEN length(case_id) % 7 = 0 THEN {q(_BAD_TEXT['nParticipante'])} ELSE CAST(nParticipante AS VARCHAR) END AS nParticipante,
    CASE WHEN length(case_id) % 7 = 0 THEN {q(_BAD_TEXT['duracion'])} ELSE CAST(duracion AS VARCHAR) END AS duracion,
    CASE WHEN length(case_id) % 7 = 0 THEN {q(_BAD_TEXT['propuesta_convertida'])} ELSE CAST(propuesta_convertida AS VARCHAR) END AS propuesta_convertida,
    CASE WHEN length(case_id) % 7 = 0 THEN {q(_BAD_TEXT['NomCliente'])} ELSE NomCliente || ' "a"' || chr(10) || 'b, c' END AS NomCliente
  FROM raw)
SELECT case_id,
  strftime(TRY_CAST(Fecha AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS Fecha,
  CAST(TRY_CAST(ANIO AS DOUBLE) AS INTEGER) AS ANIO,
  CASE WHEN ends_with(numHP, '.0') THEN CAST(TRY_CAST(numHP AS DOUBLE) AS BIGINT) END AS numHP,
  {R("TRY_CAST(ImporteB AS DECIMAL(18,2))")} AS ImporteB,
  {R("CASE WHEN isfinite(TRY_CAST(nParticipante AS DOUBLE)) THEN TRY_CAST(nParticipante AS DOUBLE) END")} AS nParticipante,
  {R("CASE WHEN isfinite(TRY_CAST(duracion AS DOUBLE)) THEN TRY_CAST(duracion AS DOUBLE) END")} AS duracion,
  coalesce(TRY_CAST(propuesta_convertida AS BOOLEAN), false) AS propuesta_convertida,
  {clean_sql('NomCliente')} AS NomCliente
FROM txt""")
def q_typed_ingest(spark, sf_dir):
    from ..sources import sinks
    from ..sources.adapter import raw_proposal_lines
    from ..sources.proposals import type_lines
    from ..functions.text import clean_category
    bad = _bad_rule_spark()

    def text(c):
        if c == "Fecha":
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        if c == "ANIO":
            return F.concat(F.col(c).cast("string"), F.lit(".0"))
        return F.concat(F.col(c), F.lit(' "a"\nb, c')) if c == "NomCliente" else F.col(c).cast("string")

    half = F.when(F.length("case_id") % 2 == 0, F.lit(".0")).otherwise(F.lit(".5"))
    txt = raw_proposal_lines(spark, sf_dir).select(
        "case_id", *[F.when(bad, F.lit(v)).otherwise(text(c)).alias(c) for c, v in _BAD_TEXT.items()],
        F.concat(F.col("numHP").cast("string"), half).alias("numHP"))
    path = shared_path(spark, "ingest")
    sinks.write_csv(txt, path)
    typed = type_lines(sinks.read_csv_table(spark, path)).select(
        "case_id", "Fecha", "ANIO", "numHP", "ImporteB", "nParticipante", "duracion",
        F.coalesce("propuesta_convertida", F.lit(False)).alias("propuesta_convertida"),
        clean_category(F.col("NomCliente")).alias("NomCliente"))
    return finalize(typed)


# Each table written as CSV, its integers as float text, and read back by its declared schema.

def _reread(spark: SparkSession, df: DataFrame, table: str) -> DataFrame:
    from ..sources import sinks
    from ..sources.artifacts import artifact_schema, read_artifact
    path = shared_path(spark, table)
    whole = [f.name for f in artifact_schema(table).fields if isinstance(f.dataType, (T.IntegerType, T.LongType))]
    text = df.select(*[F.concat(F.col(c).cast("string"), F.lit(".0")).alias(c) if c in whole else F.col(c) for c in df.columns])
    sinks.write_csv(text, path, gzip=True)
    return finalize(read_artifact(spark, path, table))


@register("artifact_cases", REGISTRY["dashboard_table"][1])
def q_artifact_cases(spark, sf_dir):
    from ..operators import clients as C
    return _reread(spark, C.dashboard_table(*_rule_segmented(spark, sf_dir)), "cases")


@register("artifact_segment_summary", REGISTRY["segment_summary"][1])
def q_artifact_segment_summary(spark, sf_dir):
    from ..operators import clients as C
    return _reread(spark, C.segment_summary(_rule_segmented(spark, sf_dir)[1]), "segment_summary")


@register("artifact_top_clients", REGISTRY["top_clients_by_segment"][1])
def q_artifact_top_clients(spark, sf_dir):
    from ..operators import clients as C
    return _reread(spark, C.top_clients(_rule_segmented(spark, sf_dir)[1]), "top_clients")


@register("artifact_segmented_clients", with_lines(f""", {_CF_SQL}
SELECT NomCliente, {', '.join(f'{R(c)} AS {c}' for c in K.CLIENT_FEATURES)}, CAST(cluster_validado AS INTEGER) AS cluster_validado,
       segmento_negocio, CAST(NULL AS DOUBLE) AS PCA_1, CAST(NULL AS DOUBLE) AS PCA_2 FROM seg"""))
def q_artifact_segmented_clients(spark, sf_dir):
    """The clients with their rule segments; the projected coordinates, which the rule does not have, come back as null."""
    _, seg = _rule_segmented(spark, sf_dir)
    return _reread(spark, seg.select("NomCliente", *K.CLIENT_FEATURES, "cluster_validado", "segmento_negocio"), "segmented_clients")


@register("artifact_regression_metrics", with_lines(f"""{_SPLIT_SQL},
n AS (SELECT MON, count(*) AS n FROM sp GROUP BY MON)
SELECT MON AS Moneda, 'Random Forest pre-OI' AS Modelo, CAST(n AS BIGINT) AS Registros, records AS Muestra_prueba,
       mae AS MAE_prueba, rmse AS RMSE_prueba, r2 AS R2_prueba
FROM ({_reg_metrics_sql("", "MON")}) m JOIN n USING (MON)"""))
def q_artifact_regression_metrics(spark, sf_dir):
    from ..operators import evaluate as EV
    from ..operators import report as RP
    split, _, _ = _labeled(spark, sf_dir)
    metrics = EV.regression_metrics(_eval_frame(spark, sf_dir), ["MON"], "yreal", "yhat")
    return _reread(spark, RP.regression_table(metrics, split), "regression_metrics")


@register("artifact_regression_predictions", with_lines(f"""{_SPLIT_SQL}
SELECT case_id, strftime(Fecha, '%Y-%m-%d %H:%M:%S') AS Fecha, CAST(ANIO AS INTEGER) AS ANIO, MON, DES_AO, NomCliente,
       CAST(numHP AS BIGINT) AS numHP, {R("ImporteB")} AS ImporteB, {R("impFacturado")} AS impFacturado,
       {R("impFacturado")} AS "real", {R("CAST(ImporteB AS DOUBLE) * 0.97")} AS prediccion,
       {R("CAST(ImporteB AS DOUBLE) * 0.8")} AS rango_p10, {R("CAST(ImporteB AS DOUBLE) * 1.2")} AS rango_p90
FROM sp WHERE is_test"""))
def q_artifact_regression_predictions(spark, sf_dir):
    """The test rows with closed-form estimates, which SQL can check, in the table of the predictions."""
    split, _, _ = _labeled(spark, sf_dir)
    gross, billed = F.col("ImporteB").cast("double"), F.col("impFacturado").cast("double")
    rows = split.where("is_test").select(
        "case_id", "Fecha", "ANIO", "MON", "DES_AO", "NomCliente", "numHP", gross.alias("ImporteB"), billed.alias("impFacturado"),
        billed.alias("real"), (gross * 0.97).alias("prediccion"), (gross * 0.8).alias("rango_p10"), (gross * 1.2).alias("rango_p90"))
    return _reread(spark, rows, "regression_predictions")


@register("top_clients_slice", with_lines(f""", {_CF_SQL},
pc AS (
  SELECT segmento_negocio, NomCliente, {q(K.PEN)} AS Moneda, _n_pen AS n, facturacion_soles_total AS Facturacion FROM seg
  UNION ALL
  SELECT segmento_negocio, NomCliente, {q(K.USD)}, _n_usd, facturacion_dolares_total FROM seg),
rk AS (
  SELECT *, row_number() OVER (PARTITION BY segmento_negocio, Moneda ORDER BY Facturacion DESC, NomCliente) AS Posicion
  FROM pc WHERE n > 0)
SELECT segmento_negocio AS Segmento, Moneda, CAST(Posicion AS INTEGER) AS Posicion, NomCliente AS Cliente,
       {R("Facturacion")} AS Facturacion, {_money_sql("Facturacion", "Moneda")} AS Facturacion_texto
FROM rk WHERE Posicion <= 10 AND segmento_negocio = {q(K.SEGMENT_HIGH)} AND Moneda = {q(K.USD)}"""))
def q_top_clients_slice(spark, sf_dir):
    from ..operators import clients as C
    from ..operators.report import top_clients_slice
    _, seg = _rule_segmented(spark, sf_dir)
    return rounded(top_clients_slice(C.top_clients(seg), K.SEGMENT_HIGH, K.USD, 10))


def _class_record(spark, sf_dir):
    from ..operators import evaluate as EV
    from ..operators.report import classification_record
    m = _classifier(spark, sf_dir)
    preds = _class_scores(spark, sf_dir)
    return classification_record(EV.classification_metrics(preds), m.thresholds, EV.confusion_cells(preds), m.split)


@register("rf_class_report")
def q_rf_class_report(spark, sf_dir):
    return rounded(_class_record(spark, sf_dir).drop("Umbrales", "Matriz_confusion"))


@register("rf_reg_importance_top")
def q_rf_reg_importance_top(spark, sf_dir):
    from ..operators.report import importance_for, top_importances
    return top_importances(importance_for(q_rf_reg_importance(spark, sf_dir), K.PEN), 8)


def _one_row(name: str, alias: str, cols: str) -> str:
    return f"(SELECT {cols} FROM ({REGISTRY[name][1]}) {alias})"


@register("run_metadata", f"""
SELECT CAST({K.RANDOM_STATE} AS INTEGER) AS random_state, {R(str(K.TEST_SIZE))} AS test_size,
       {q(",".join(K.VALID_CURRENCIES))} AS valid_currencies, CAST({len(K.NUMERIC_FEATURES)} AS INTEGER) AS numeric_features,
       CAST({len(K.CATEGORICAL_REG_FEATURES)} AS INTEGER) AS categorical_features,
       c.Accuracy AS accuracy, c.ROC_AUC AS roc_auc, c.Muestra_prueba AS muestra,
       t.pen AS umbral_pen, t.usd AS umbral_usd, m.casos AS aciertos_altos,
       r.moneda AS moneda, r.muestra AS muestra_regresion, r.mae AS mae, r.rmse AS rmse, r.r2 AS r2,
       s.clientes AS clientes, s.segmentos AS segmentos,
       b.total_registros, b.fecha_min, b.fecha_max, b.lineas_convertidas, b.conversion_lineas_pct, b.hp_analiticas,
       b.total_facturacion_pen, b.total_facturacion_usd
FROM ({REGISTRY["classification_metrics"][1]}) c,
     {_one_row("train_thresholds", "x", f"max(CASE WHEN MON = {q(K.PEN)} THEN umbral END) AS pen, max(CASE WHEN MON = {q(K.USD)} THEN umbral END) AS usd")} t,
     {_one_row("confusion_cells", "x", "max(CASE WHEN real = 1 AND prediccion = 1 THEN casos END) AS casos")} m,
     (SELECT MON AS moneda, records AS muestra, mae, rmse, r2 FROM ({REGISTRY["regression_metrics"][1]}) x) r,
     {_one_row("rule_segments", "x", "CAST(count(*) AS BIGINT) AS clientes, CAST(count(DISTINCT segmento_negocio) AS BIGINT) AS segmentos")} s,
     ({REGISTRY["business_kpis"][1]}) b""")
def q_run_metadata(spark, sf_dir):
    """The run record written as JSON and read back by its schema, a row a regression entry
    (metrics of the closed-form scores, which SQL can check)."""
    from ..operators import evaluate as EV
    from ..operators import report as RP
    from ..sources import sinks
    split, th, _ = _labeled(spark, sf_dir)
    ev = _cached(spark, sf_dir, "evaluation", lambda: materialize(_eval_frame(spark, sf_dir)))
    record = RP.classification_record(EV.classification_metrics(ev), th, EV.confusion_cells(ev), split)
    regression = RP.regression_table(EV.regression_metrics(ev, ["MON"], "yreal", "yhat"), split)
    _, seg = _rule_segmented(spark, sf_dir)
    segmentation = seg.agg(F.count(F.lit(1)).alias("clientes"), F.count_distinct("segmento_negocio").alias("segmentos"))
    path = shared_path(spark, "metadata")
    sinks.write_json(RP.run_metadata(funnel.business_kpis(load_lines(spark, sf_dir)), record, regression, segmentation), path)
    back = sinks.read_json_table(spark, path, RP.METADATA_SCHEMA)
    c, r = F.col("classification"), F.col("r")
    return rounded(back.withColumn("r", F.explode("regression")).select(
        "random_state", "test_size", F.array_join("valid_currencies", ",").alias("valid_currencies"),
        F.size("classification_features.numeric").alias("numeric_features"),
        F.size("regression_features.categorical").alias("categorical_features"),
        c["Accuracy"].alias("accuracy"), c["ROC_AUC"].alias("roc_auc"), c["Muestra_prueba"].alias("muestra"),
        c["Umbrales"][K.PEN].alias("umbral_pen"), c["Umbrales"][K.USD].alias("umbral_usd"),
        c["Matriz_confusion"][1][1].alias("aciertos_altos"), r["Moneda"].alias("moneda"),
        r["Muestra_prueba"].alias("muestra_regresion"), r["MAE_prueba"].alias("mae"), r["RMSE_prueba"].alias("rmse"),
        r["R2_prueba"].alias("r2"), "segmentation.clientes", "segmentation.segmentos", "business_summary.*"))


@register("saved_models", with_lines(_SPLIT_SQL + f"\nSELECT case_id, MON, {R('yreal')} AS real, true AS same FROM ev"))
def q_saved_models(spark, sf_dir):
    """Save every currency's pipeline and forest, load them by currency, score the test rows;
    ``same`` tells whether the loaded model gives the estimate of the one in memory."""
    from pyspark.ml import PipelineModel

    from ..sources import sinks
    regressors = _regressors(spark, sf_dir)
    base, frames = shared_path(spark, "models"), []
    paths = {cur: f"{base}/{i}" for i, cur in enumerate(regressors)}
    for cur, m in regressors.items():
        sinks.save_model(PipelineModel([m.preprocessor, m.forest]), paths[cur])
    for cur, m in regressors.items():
        loaded = sinks.load_pipeline(sinks.regressor_for(paths, cur))
        mine = m.forest.transform(m.preprocessor.transform(m.test)).select("case_id", F.col("prediction").alias("_p"))
        frames.append(loaded.transform(m.test).select("case_id", "MON", F.col("impFacturado").cast("double").alias("real"),
                                                      "prediction").join(mine, "case_id")
                      .select("case_id", "MON", "real", (F.col("prediction") == F.col("_p")).alias("same")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return rounded(out)
