"""Driver tables -> proposal-line table.

The test data is a TPC-H style star schema; one ``lineitem`` row plays one
service line of a commercial proposal.  Every rule below is deterministic
in the source columns, so the same table can be rebuilt in any SQL engine
(see ``hpfunnel.plans.oracle.LINES_SQL``).

Join plan: the two tiny geography tables are folded into the customer side
first, orders are enriched with customers on ``custkey`` and only then the
fact table is joined on ``orderkey``; part and supplier join last.  No join
is hinted: Catalyst's size estimate (``autoBroadcastJoinThreshold``) and
AQE's runtime statistics choose broadcast for small dimensions and fall
back to shuffle joins when a dimension is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]

# --- fixed values: reason texts assigned by (l_partkey*7 + l_suppkey) % 12 --
# index 0 carries no reason (null).
REASON_TEXTS = [
    None,
    " costo de  referencia ",
    "Precio muy alto",
    "Proyecto en Stand By",
    "Ausencia de respuesta",
    "Eligió otro proveedor",
    "No contaba con equipo",
    "Sin habilitación de inspector",
    "Atendido con otra HP",
    "No requiere servicio",
    "Cambio de gerencia ñandú",
    "Costo referencial y precio",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_proposal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposal lines as a source system would deliver them (not cleaned)."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    cust = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    part = read_table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")

    geo = nation.join(region, nation.n_regionkey == region.r_regionkey) \
        .select("n_nationkey", "n_name", "r_name")
    cust = cust.join(geo, cust.c_nationkey == geo.n_nationkey) \
        .select("c_custkey", "c_name", "c_mktsegment", "n_name", "r_name")
    orders = orders.join(cust, orders.o_custkey == cust.c_custkey)
    j = li.join(orders, li.l_orderkey == orders.o_orderkey) \
        .join(part, li.l_partkey == part.p_partkey) \
        .join(supp, li.l_suppkey == supp.s_suppkey)

    conv = (F.col("l_returnflag") != "R") & \
        (F.col("l_shipdate") >= F.col("o_orderdate") - F.expr("INTERVAL 30 DAYS"))
    ship_day = F.to_date("l_shipdate")
    case_id = F.concat_ws(
        "|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
        F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
        ship_day.cast("string"), F.col("l_quantity").cast("bigint").cast("string"))
    reason_idx = (F.col("l_partkey") * 7 + F.col("l_suppkey")) % 12
    reason = F.element_at(F.array(*[F.lit(t).cast("string") for t in REASON_TEXTS]),
                          (reason_idx + 1).cast("int"))
    billed = F.when(conv, (F.col("l_extendedprice").cast("decimal(12,2)") *
                           (F.lit(1).cast("decimal(1,0)") - F.col("l_discount").cast("decimal(4,2)"))
                           ).cast("decimal(18,2)"))
    gross = F.when(F.col("l_partkey") % 53 == 0, F.lit(None).cast("decimal(18,2)")) \
        .when(F.col("l_partkey") % 59 == 0, F.lit(0).cast("decimal(18,2)")) \
        .otherwise(F.col("l_extendedprice").cast("decimal(18,2)"))
    null_date = F.col("l_orderkey") % 997 == 0

    return j.select(
        case_id.alias("case_id"),
        F.when(null_date, F.lit(None)).otherwise(F.col("o_orderdate")).alias("Fecha"),
        F.when(conv, F.col("l_shipdate")).alias("FechaOI"),
        F.when(null_date, F.lit(None)).otherwise(F.year("o_orderdate")).cast("int").alias("ANIO"),
        F.when(F.col("l_orderkey") % 499 == 7, F.lit(None))
         .otherwise(F.col("l_orderkey")).cast("bigint").alias("numHP"),
        F.col("p_brand").alias("idUnidNeg"),
        F.col("p_type").alias("DES_AO"),
        F.col("p_name").alias("Desc_Servicio"),
        F.when(F.col("c_custkey") % 211 == 3, F.lit("  ")).otherwise(F.col("c_name")).alias("NomCliente"),
        F.when(F.col("p_size") % 17 == 0, F.lit(None)).otherwise(F.col("p_size"))
         .cast("double").alias("duracion"),
        F.col("n_name").alias("LugarEjec"),
        F.when(F.col("l_partkey") % 41 == 0, F.lit(None)).otherwise(F.col("l_quantity"))
         .cast("double").alias("nParticipante"),
        F.col("s_name").alias("Consultor"),
        F.when(F.col("r_name") == "EUROPE", F.lit(K.USD))
         .when(F.col("r_name") == "AFRICA", F.lit("EUR")).otherwise(F.lit(K.PEN)).alias("MON"),
        gross.alias("ImporteB"),
        billed.alias("impFacturado"),
        F.col("c_mktsegment").alias("Rubro"),
        F.when(F.col("l_linestatus") == "O", F.lit(K.STATE_ACTIVE))
         .when((F.col("o_orderstatus") == "P") & (F.col("l_linenumber") == 7), F.lit("Otro"))
         .otherwise(F.lit(K.STATE_INACTIVE)).alias("Desc_Estado"),
        reason.alias("DescAnulado"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), F.lit(None))
         .otherwise(conv).cast("boolean").alias("propuesta_convertida"),
        F.when(conv, F.datediff(ship_day, F.to_date("o_orderdate"))).cast("int")
         .alias("dias_conversion_hp_oi"),
        (billed - gross).cast("decimal(18,2)").alias("diferencia_facturacion"),
        billed.alias("ingreso_neto_estimado"),
    )
