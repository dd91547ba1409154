from pyspark.sql import functions as F

from hpfunnel import constants as K
from hpfunnel.functions.formatting import case_label, format_currency, format_number
from hpfunnel.functions.text import categorize_reason, clean_category, normalize_text, shorten


def _one(spark, expr, values, schema="s string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr(F.col("s"))).collect()]


def test_normalize(spark):
    expected = {
        "  Habilitación de  Inspector ": "HABILITACION DE INSPECTOR",
        None: "",
        "日本 x": "X",
        "ﬁn ½": "FIN 12",
        "a…b\tc": "A...B C",
        "Ǆx 𝐀": "DZX A",
        "ß": "",
        "Ñandú x": "NANDU X",
        "x\x1cy": "X Y",
        "Ⅻ ㎏": "XII KG",
        "": "",
    }
    assert _one(spark, normalize_text, list(expected)) == list(expected.values())


def test_reason_of_every_driver_text(spark):
    expected = {
        None: "No especificado",
        " costo de  referencia ": "Costo de referencia",
        "Precio muy alto": "Precio / presupuesto",
        "Proyecto en Stand By": "Proyecto en stand by",
        "Ausencia de respuesta": "Ausencia de respuesta / vencimiento",
        "Eligió otro proveedor": "Eligió otro proveedor",
        "No contaba con equipo": "No cuenta con equipo",
        "Sin habilitación de inspector": "Disponibilidad / habilitación de personal",
        "Atendido con otra HP": "Atendido con otra HP/OI",
        "No requiere servicio": "Servicio no requerido",
        "Cambio de gerencia ñandú": "Otros motivos",
        "Costo referencial y precio": "Costo de referencia",
    }
    assert _one(spark, categorize_reason, list(expected)) == list(expected.values())


def test_fixture_examples(spark):
    got = _one(spark, normalize_text, ["  Habilitación de  Inspector ", None, "日本 x", "ﬁn ½"])
    assert got == ["HABILITACION DE INSPECTOR", "", "X", "FIN 12"]


def test_reason_rule_order(spark):
    cases = {
        "Costo referencial y precio": K.REASON_REFERENCE_COST,
        "precio, stand by": K.REASON_PRICE,
        "disponibilidad": K.REASON_OTHER,
        "disponibilidad del instructor": K.REASON_STAFF,
        "Sin habilitación de inspector": K.REASON_STAFF,
        "no especificado": K.REASON_NOT_SPECIFIED,
        "": K.REASON_NOT_SPECIFIED,
        None: K.REASON_NOT_SPECIFIED,
        "Proyecto en StandBy": K.REASON_STANDBY,
        "vencimiento de oferta": K.REASON_NO_ANSWER,
        "eligió otro proveedor": K.REASON_OTHER_SUPPLIER,
        "no contaba con equipo": K.REASON_NO_EQUIPMENT,
        "atendido con otra OI": K.REASON_OTHER_HP,
        "no requiere": K.REASON_NOT_REQUIRED,
        "cambio de gerencia": K.REASON_OTHER,
    }
    got = _one(spark, categorize_reason, list(cases))
    assert got == list(cases.values())


def test_clean_category(spark):
    got = _one(spark, clean_category, [None, "  ", "　x ", "a"])
    assert got == [K.NOT_SPECIFIED, K.NOT_SPECIFIED, "x", "a"]


def test_shorten(spark):
    long = "a" * 60
    got = _one(spark, lambda c: shorten(c, 52), [None, "", "abc", long, "b" * 50 + " " * 5 + "c" * 5])
    assert got[:3] == [K.NOT_SPECIFIED, K.NOT_SPECIFIED, "abc"]
    assert got[3] == "a" * 51 + "…"
    assert got[4] == "b" * 50 + "…"


def test_format_number_half_even(spark):
    df = spark.createDataFrame([(2.5, "S/."), (1234567.891, "US$"), (None, "S/.")], "v double, c string")
    rows = df.select(format_number(F.col("v"), 0).alias("a"), format_currency(F.col("v"), F.col("c"), 2).alias("b")) \
        .collect()
    assert [r.a for r in rows] == [f"{2.5:,.0f}", f"{1234567.891:,.0f}", K.NOT_SPECIFIED]
    assert [r.b for r in rows] == ["S/ 2.50", "US$ 1,234,567.89", K.NOT_SPECIFIED]


def test_case_label(spark):
    df = spark.createDataFrame([(None, None, "Cliente", "Servicio", "S/.")],
                               "f timestamp, n bigint, c string, s string, m string")
    got = df.select(case_label(F.col("f"), F.col("n"), F.col("c"), F.col("s"), F.col("m"))).first()[0]
    assert got == "Sin fecha · HP N/E · Cliente · Servicio · S/."


def test_clean_category_strips_like_python_without_regex(spark):
    from hpfunnel.functions.text import PY_WHITESPACE_CHARS, py_strip
    ends = [*PY_WHITESPACE_CHARS, "", "a", "!", "~", "\x7f", "\x80", "\x00", "ñ", "日", "𐀀", "\u200b"]
    values = [a + m + b for a in ends for m in ("", "x y", " ") for b in ends]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = df.select("s", py_strip(F.col("s")).alias("p"), clean_category(F.col("s")).alias("c"))
    assert all(r.p == r.s.strip() and r.c == (r.s.strip() or K.NOT_SPECIFIED) for r in got.collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp" not in plan and "rlike" not in plan


def test_lines_share_one_cleaning_of_their_categories(spark):
    from hpfunnel.sources.proposals import prepare_lines
    row = {c: f"\u2003{c} \x1c" for c in K.CATEGORICAL_SOURCE_COLUMNS} | {"case_id": " 1 "}
    lines = prepare_lines(spark.createDataFrame([row, {**{c: " " for c in row}, "case_id": None}]))
    plan = lines._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "rlike" not in plan and plan.count("btrim") + plan.count("trim(both") <= 2
    rows = {r["case_id"]: r for r in lines.collect()}
    assert all(rows[" 1 "][c] == c and rows[None][c] == K.NOT_SPECIFIED for c in K.CATEGORICAL_SOURCE_COLUMNS)
