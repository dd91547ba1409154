"""Display expressions: currency symbol, number/currency text, case labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .text import shorten


def currency_symbol(cur: Column) -> Column:
    """P25: ``S/`` for soles, ``US$`` for anything else."""
    return F.when(cur == K.PEN, F.lit("S/")).otherwise(F.lit("US$"))


def format_number(value: Column, decimals: int = 0) -> Column:
    """Thousands separators, half-even rounding; null -> sentinel."""
    v = value.cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(K.NOT_SPECIFIED)).otherwise(F.format_number(v, decimals))


def format_currency(value: Column, cur: Column, decimals: int = 0) -> Column:
    """``<symbol> <number>``; null -> sentinel."""
    v = value.cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(K.NOT_SPECIFIED)).otherwise(
        F.concat_ws(" ", currency_symbol(cur), F.format_number(v, decimals)))


def case_label(fecha: Column, num: Column, client: Column, service: Column, cur: Column) -> Column:
    """``dd/MM/yyyy · HP n · client · service · MON`` with fallbacks."""
    date_text = F.coalesce(F.date_format(fecha, "dd/MM/yyyy"), F.lit("Sin fecha"))
    hp_text = F.coalesce(num.cast("bigint").cast("string"), F.lit("N/E"))
    return F.concat_ws(" · ", date_text, F.concat(F.lit("HP "), hp_text), shorten(client, 30),
                       shorten(service, 35), F.coalesce(cur.cast("string"), F.lit("")))
