"""Independent SQL formulations (DuckDB dialect) of the registered queries.

``LINES_SQL`` rebuilds the prepared proposal-line table from the driver
tables with plain SQL; every oracle query starts from it.  The oracle only
has to agree on the driver data, so accent folding uses DuckDB's
``strip_accents`` rather than the full compatibility decomposition.
"""

from __future__ import annotations

from .. import constants as K
from ..sources.adapter import REASON_TEXTS

_WS = "[\\x{09}-\\x{0D}\\x{1C}-\\x{1F}\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _clean(col: str) -> str:
    stripped = f"regexp_replace(coalesce({col}, {q(K.NOT_SPECIFIED)}), '^{_WS}+|{_WS}+$', '', 'g')"
    return f"CASE WHEN {stripped} = '' THEN {q(K.NOT_SPECIFIED)} ELSE {stripped} END"


def _norm(col: str) -> str:
    folded = f"regexp_replace(strip_accents(coalesce({col}, '')), '[^\\x00-\\x7F]', '', 'g')"
    spaced = f"regexp_replace(upper({folded}), '[\\x09-\\x0D\\x1C-\\x1F ]+', ' ', 'g')"
    return f"regexp_replace({spaced}, '^ +| +$', '', 'g')"


def _any(t: str, words) -> str:
    return "(" + " OR ".join(f"contains({t}, {q(w)})" for w in words) + ")"


def reason_case(t: str) -> str:
    parts = [f"WHEN {t} = '' OR {t} = 'NO ESPECIFICADO' THEN {q(K.REASON_NOT_SPECIFIED)}"]
    for label, words in K.REASON_RULES_BEFORE_STAFF:
        parts.append(f"WHEN {_any(t, words)} THEN {q(label)}")
    parts.append(f"WHEN {_any(t, K.STAFF_GROUP_A)} AND {_any(t, K.STAFF_GROUP_B)} THEN {q(K.REASON_STAFF)}")
    for label, words in K.REASON_RULES_AFTER_STAFF:
        parts.append(f"WHEN {_any(t, words)} THEN {q(label)}")
    return "CASE " + " ".join(parts) + f" ELSE {q(K.REASON_OTHER)} END"


_reason_whens = " ".join(f"WHEN {i} THEN {q(t)}" for i, t in enumerate(REASON_TEXTS) if t is not None)

RAW_SQL = f"""
geo AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
cust AS (SELECT c_custkey, c_name, c_mktsegment, n_name, r_name FROM customer JOIN geo ON c_nationkey = n_nationkey),
j AS (
  SELECT l.*, o_orderstatus, o_orderdate, c_custkey, c_name, c_mktsegment, n_name, r_name,
         p_name, p_brand, p_type, p_size, s_name,
         (l_returnflag <> 'R' AND l_shipdate >= o_orderdate - INTERVAL 30 DAY) AS conv
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN cust ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
raw0 AS (
  SELECT
    concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
              CAST(l_suppkey AS VARCHAR), CAST(CAST(l_shipdate AS DATE) AS VARCHAR),
              CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR)) AS case_id,
    CASE WHEN l_orderkey % 997 = 0 THEN NULL ELSE o_orderdate END AS Fecha,
    CASE WHEN conv THEN l_shipdate END AS FechaOI,
    CAST(CASE WHEN l_orderkey % 997 = 0 THEN NULL ELSE year(o_orderdate) END AS INTEGER) AS ANIO,
    CAST(CASE WHEN l_orderkey % 499 = 7 THEN NULL ELSE l_orderkey END AS BIGINT) AS numHP,
    p_brand AS idUnidNeg, p_type AS DES_AO, p_name AS Desc_Servicio,
    CASE WHEN c_custkey % 211 = 3 THEN '  ' ELSE c_name END AS NomCliente,
    CAST(CASE WHEN p_size % 17 = 0 THEN NULL ELSE p_size END AS DOUBLE) AS duracion,
    n_name AS LugarEjec,
    CAST(CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE l_quantity END AS DOUBLE) AS nParticipante,
    s_name AS Consultor,
    CASE WHEN r_name = 'EUROPE' THEN 'US$' WHEN r_name = 'AFRICA' THEN 'EUR' ELSE 'S/.' END AS MON,
    CASE WHEN l_partkey % 53 = 0 THEN NULL WHEN l_partkey % 59 = 0 THEN CAST(0 AS DECIMAL(18,2))
         ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS ImporteB,
    CASE WHEN conv THEN CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
         AS DECIMAL(18,2)) END AS impFacturado,
    c_mktsegment AS Rubro,
    CASE WHEN l_linestatus = 'O' THEN 'HP Activo' WHEN o_orderstatus = 'P' AND l_linenumber = 7 THEN 'Otro'
         ELSE 'HP Inactivo' END AS Desc_Estado,
    CASE (l_partkey * 7 + l_suppkey) % 12 {_reason_whens} END AS DescAnulado,
    CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN NULL ELSE conv END AS propuesta_convertida,
    CASE WHEN conv THEN CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER)
         END AS dias_conversion_hp_oi
  FROM j),
raw AS (
  SELECT *, CAST(impFacturado - ImporteB AS DECIMAL(18,2)) AS diferencia_facturacion,
         impFacturado AS ingreso_neto_estimado
  FROM raw0)"""

_cats = ", ".join(f"{_clean(c)} AS {c}" for c in K.CATEGORICAL_SOURCE_COLUMNS)

LINES_SQL = f"""
{RAW_SQL},
clean AS (
  SELECT case_id, Fecha, FechaOI, ANIO, numHP, duracion, nParticipante, ImporteB, impFacturado,
         dias_conversion_hp_oi, diferencia_facturacion, ingreso_neto_estimado,
         coalesce(propuesta_convertida, false) AS propuesta_convertida, {_cats}
  FROM raw),
lines AS (
  SELECT *,
    CASE WHEN propuesta_convertida THEN {q(K.STAGE_CONVERTED)}
         WHEN Desc_Estado = {q(K.STATE_ACTIVE)} THEN {q(K.STAGE_ACTIVE)}
         WHEN Desc_Estado = {q(K.STATE_INACTIVE)} THEN {q(K.STAGE_INACTIVE)}
         ELSE {q(K.STAGE_OTHER)} END AS etapa_comercial,
    {reason_case(_norm('DescAnulado'))} AS motivo_negocio
  FROM clean)"""


def with_lines(body: str) -> str:
    """Prefix a query over ``lines`` with the line-table CTEs."""
    return f"WITH {LINES_SQL.strip()}\n{body}"


def norm_sql(col: str) -> str:
    return _norm(col)


def clean_sql(col: str) -> str:
    return _clean(col)
