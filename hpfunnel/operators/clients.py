"""Client features, segment summaries, top clients and the serving table.

Every per-client number (billing per currency, operations, medians) comes
from ONE group-by on the client key: the reference's pivot + merge of two
client tables (J1) collapses into a single aggregate, and the later
line-level join used for segment totals (J2) is replaced by sums of the
client-level aggregates, which are the same numbers without reshuffling
the line table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.text import py_strip
from .quantiles import exact_median, exact_quantiles_many


def currency_bucket(col: Column) -> Column:
    """Valid currency, else ``Otra``."""
    return F.when(col.isin(*K.VALID_CURRENCIES), col).otherwise(F.lit(K.OTHER_CURRENCY))


def modelling_clients(lines: DataFrame) -> DataFrame:
    """Line rows usable for client modelling."""
    name = py_strip(F.coalesce(F.col("NomCliente"), F.lit("nan")))
    df = lines.withColumn("NomCliente", name)
    low = F.lower(F.col("NomCliente"))
    df = df.where((F.col("NomCliente") != "") & ~low.isin("nan", K.NOT_SPECIFIED.lower()))
    imp = F.col("ImporteB").cast("double")
    return df.withColumns({
        "propuesta_convertida_num": F.col("propuesta_convertida").cast("int"),
        "MON_limpia": currency_bucket(F.col("MON")),
        "porcentaje_diferencia_operacion": F.when(
            imp.isNotNull() & (imp != 0),
            F.col("diferencia_facturacion").cast("double") / imp * F.lit(100.0)),
    })


def distinct_services(m: DataFrame) -> DataFrame:
    """(NomCliente, cantidad_servicios_distintos): how many services a client has.

    Counted by itself: beside other aggregates, every pair of client and
    service would carry their buffers through two shuffles.
    """
    pairs = m.groupBy("NomCliente", "Desc_Servicio").agg(F.count(F.lit(1)).alias("_n"))
    return pairs.groupBy("NomCliente").agg(F.count("Desc_Servicio").alias("cantidad_servicios_distintos"))


def client_features(lines: DataFrame) -> DataFrame:
    """One row per client with the eight features.

    ``_n_pen``/``_n_usd`` (lines per currency) ride along for the top-client
    ranking; the median of the operation difference is the exact, skew-safe
    operator (a client may own a third of all lines).
    """
    m = modelling_clients(lines)
    bill = F.col("impFacturado")
    agg = m.groupBy("NomCliente").agg(
        F.coalesce(F.sum(F.when(F.col("MON_limpia") == K.PEN, bill)), F.lit(0).cast("decimal(28,2)"))
        .cast("double").alias("facturacion_soles_total"),
        F.coalesce(F.sum(F.when(F.col("MON_limpia") == K.USD, bill)), F.lit(0).cast("decimal(28,2)"))
        .cast("double").alias("facturacion_dolares_total"),
        F.sum("nParticipante").alias("participantes_total"),
        F.avg("duracion").alias("duracion_promedio"),
        F.avg("propuesta_convertida_num").alias("tasa_conversion_hp_oi"),
        F.count(F.lit(1)).alias("cantidad_registros"),
        F.count_if(F.col("MON_limpia") == K.PEN).alias("_n_pen"),
        F.count_if(F.col("MON_limpia") == K.USD).alias("_n_usd"),
    ).where((F.col("facturacion_soles_total") + F.col("facturacion_dolares_total")) > 0)
    med = exact_median(m, ["NomCliente"], "porcentaje_diferencia_operacion",
                       "porcentaje_diferencia_mediana")
    joined = agg.join(distinct_services(m), "NomCliente").join(med, "NomCliente", "left")

    def finite(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(F.abs(x) == F.lit(float("inf")), F.lit(None)).otherwise(x)

    out = joined.select("NomCliente", *[finite(c).alias(c) for c in K.CLIENT_FEATURES], "_n_pen", "_n_usd")
    return out.na.drop(subset=K.CLIENT_FEATURES)


def log_features(clients: DataFrame) -> DataFrame:
    """``log1p`` of the skewed features (x < -1 has no log: null)."""
    return clients.withColumns({
        c: F.when(F.col(c) >= -1, F.log1p(F.col(c))) for c in K.LOG_FEATURES})


def scaled_features(clients: DataFrame, features: Sequence[str] = K.CLIENT_FEATURES) -> DataFrame:
    """Z-scores with the population standard deviation.

    Means and deviations are one global aggregate (map-side partial) read
    back as a scalar subquery; a constant column scales by 1 (z = 0).
    """
    logged = log_features(clients)
    stats = logged.agg(F.struct(*[
        F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in features
    ])).scalar()

    def z(c: str) -> Column:
        s = stats[c]["s"]
        return (F.col(c) - stats[c]["m"]) / F.when(s == 0, F.lit(1.0)).otherwise(s)

    return logged.select("NomCliente", *[z(c).alias(c) for c in features],
                         *[c for c in ("_n_pen", "_n_usd") if c in logged.columns])


def rule_clusters(scaled: DataFrame) -> DataFrame:
    """Deterministic two-group labelling (activity z-score >= 0 -> 1).

    Stands in for K-Means where results must be checkable by SQL.
    """
    return scaled.select("NomCliente", (F.col("cantidad_registros") >= 0).cast("int").alias("cluster_validado"))


def label_segments(clients: DataFrame, clusters: DataFrame) -> DataFrame:
    """The cluster with the highest median activity is the
    high-value segment, every other cluster the low-activity one (ties go to
    the smallest cluster id)."""
    c = clients.join(clusters, "NomCliente")
    med = exact_median(c, ["cluster_validado"], "cantidad_registros", "_act")
    top = med.agg(F.min_by("cluster_validado", F.struct(-F.col("_act"), F.col("cluster_validado")))).scalar()
    return c.withColumn("segmento_negocio", F.when(F.col("cluster_validado") == top, F.lit(K.SEGMENT_HIGH))
                        .otherwise(F.lit(K.SEGMENT_LOW)))


_SUMMARY_MEDIANS = [
    ("cantidad_registros", "Operaciones_por_cliente_mediana", 1.0),
    ("cantidad_servicios_distintos", "Servicios_distintos_mediana", 1.0),
    ("participantes_total", "Participantes_mediana", 1.0),
    ("tasa_conversion_hp_oi", "Conversion_HP_OI_mediana_pct", 100.0),
    ("duracion_promedio", "Duracion_mediana", 1.0),
    ("facturacion_soles_total", "Facturacion_PEN_por_cliente_mediana", 1.0),
    ("facturacion_dolares_total", "Facturacion_USD_por_cliente_mediana", 1.0),
]


def segment_summary(segmented: DataFrame) -> DataFrame:
    """Per cluster: clients, shares of clients/operations/billing and
    seven medians.  Shares of billing are null when the currency total is 0.

    ``segmented`` = client features + ``cluster_validado`` + ``segmento_negocio``.
    """
    per = segmented.groupBy("cluster_validado").agg(
        F.any_value("segmento_negocio").alias("Segmento"),
        F.count(F.lit(1)).alias("Clientes"),
        F.sum("cantidad_registros").alias("_ops"),
        F.sum("facturacion_soles_total").alias("_pen"),
        F.sum("facturacion_dolares_total").alias("_usd"))
    tot = Window.partitionBy()  # over <= k rows (one per cluster)

    def share(c: str) -> Column:
        total = F.sum(c).over(tot)
        return F.when(total != 0, F.col(c) / total * F.lit(100.0))

    shares = per.select(
        "cluster_validado", "Segmento", "Clientes",
        (F.col("Clientes") / F.sum("Clientes").over(tot) * F.lit(100.0)).alias("pct_clientes"),
        (F.col("_ops") / F.sum("_ops").over(tot) * F.lit(100.0)).alias("pct_operaciones"),
        share("_pen").alias("pct_facturacion_PEN"),
        share("_usd").alias("pct_facturacion_USD"))
    meds = exact_quantiles_many(segmented, ["cluster_validado"], [m for m, _, _ in _SUMMARY_MEDIANS], 0.5)
    meds = meds.select("cluster_validado", *[(F.col(m) * F.lit(f)).alias(n) for m, n, f in _SUMMARY_MEDIANS])
    return shares.join(meds, "cluster_validado", "left")


def segment_shares_long(summary: DataFrame) -> DataFrame:
    """C4: wide shares -> (Segmento, metrica, valor)."""
    return summary.unpivot(["Segmento"], ["pct_clientes", "pct_operaciones", "pct_facturacion_PEN",
                                          "pct_facturacion_USD"], "metrica", "valor")


def top_clients(segmented: DataFrame, n: int = K.TOP_CLIENTS_PER_SEGMENT) -> DataFrame:
    """The ``n`` best-billed clients per segment and currency.

    Ranking ``row_number() <= n`` is planned as a partial + final
    ``WindowGroupLimit``: each task keeps only its local top ``n`` per group
    before the shuffle, so a huge segment never lands in one task whole.
    Clients that have lines in a currency but no billing rank with 0.
    """
    per_cur = segmented.select(
        "segmento_negocio", "NomCliente",
        F.explode(F.array(
            F.struct(F.lit(K.PEN).alias("Moneda"), F.col("_n_pen").alias("_n"),
                     F.col("facturacion_soles_total").alias("Facturacion")),
            F.struct(F.lit(K.USD).alias("Moneda"), F.col("_n_usd").alias("_n"),
                     F.col("facturacion_dolares_total").alias("Facturacion")))).alias("_c")
    ).select("segmento_negocio", "NomCliente", "_c.*").where(F.col("_n") > 0)
    w = Window.partitionBy("segmento_negocio", "Moneda").orderBy(F.desc("Facturacion"), F.asc("NomCliente"))
    return per_cur.withColumn("Posicion", F.row_number().over(w)).where(F.col("Posicion") <= n).select(
        F.col("segmento_negocio").alias("Segmento"), "Moneda", "Posicion",
        F.col("NomCliente").alias("Cliente"), "Facturacion")


def with_segment(lines: DataFrame, segmented: DataFrame) -> DataFrame:
    """``lines`` with the segment of their client, ``SEGMENT_NONE`` where it has none."""
    return lines.join(segmented.select("NomCliente", "segmento_negocio"), "NomCliente", "left") \
        .withColumn("segmento_negocio", F.coalesce(F.col("segmento_negocio"), F.lit(K.SEGMENT_NONE)))


def dashboard_table(lines: DataFrame, segmented: DataFrame) -> DataFrame:
    """Serving table = case id + 24 columns + segment label."""
    return with_segment(lines.select("case_id", *K.DASHBOARD_COLUMNS), segmented) \
        .select("case_id", *K.DASHBOARD_COLUMNS, "segmento_negocio")


def eligible_cases(lines: DataFrame) -> DataFrame:
    """lines that can be simulated (amount, valid currency, date)."""
    return lines.where(F.col("ImporteB").isNotNull() & F.col("MON").isin(*K.VALID_CURRENCIES)
                       & F.col("Fecha").isNotNull())


def recent_cases(lines: DataFrame, segmented: DataFrame, limit: int = K.RECENT_CASES) -> DataFrame:
    """The latest eligible cases (ties by case id) with their segment.

    The limit is the feature here, and comes before the join: the client
    side is unique and the join is left, so only ``limit`` rows meet it.
    """
    latest = eligible_cases(lines).orderBy(F.desc("Fecha"), F.asc("case_id")).limit(limit)
    return dashboard_table(latest, segmented)


def client_billing_pivot(lines: DataFrame) -> DataFrame:
    """Billing per client and currency (fixed pivot values, so no
    extra job to discover them); a client without billing in a currency
    gets 0."""
    m = modelling_clients(lines)
    piv = m.groupBy("NomCliente").pivot("MON_limpia", [K.PEN, K.USD]).agg(F.sum("impFacturado"))
    return piv.select(
        "NomCliente",
        F.coalesce(F.col(f"`{K.PEN}`"), F.lit(0).cast("decimal(28,2)")).cast("double").alias("facturacion_soles_total"),
        F.coalesce(F.col(f"`{K.USD}`"), F.lit(0).cast("decimal(28,2)")).cast("double").alias("facturacion_dolares_total"))


def client_operations(lines: DataFrame) -> DataFrame:
    """Operational profile per client (before any filter)."""
    m = modelling_clients(lines)
    agg = m.groupBy("NomCliente").agg(
        F.sum("nParticipante").alias("participantes_total"),
        F.avg("duracion").alias("duracion_promedio"),
        F.avg("propuesta_convertida_num").alias("tasa_conversion_hp_oi"),
        F.count(F.lit(1)).alias("cantidad_registros"))
    med = exact_median(m, ["NomCliente"], "porcentaje_diferencia_operacion",
                       "porcentaje_diferencia_mediana")
    return agg.join(distinct_services(m), "NomCliente").join(med, "NomCliente", "left") \
        .select("NomCliente", "participantes_total", "duracion_promedio", "tasa_conversion_hp_oi",
                "cantidad_servicios_distintos", "cantidad_registros", "porcentaje_diferencia_mediana")
