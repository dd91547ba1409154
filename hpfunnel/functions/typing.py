"""Typing of text cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coerce(col: Column, type_name: str) -> Column:
    """Type a column; unparsable values become null (never an error).

    ``try_cast`` is used because ANSI mode makes a plain cast throw.  For
    doubles, NaN and infinities are mapped to null, so that null is the only
    "missing" and every value is a number.  Integers are often stored as
    float text (``2020.0``): whole numbers are kept, anything with a fraction
    is null.  Amounts are ``decimal(18,2)``: finer ones are rounded to cents.
    """
    if type_name in ("int", "bigint"):
        number = col.try_cast("double")
        whole = F.coalesce(col.try_cast("bigint"), F.when(number == F.rint(number), number).try_cast("bigint"))
        return whole.try_cast(type_name)
    typed = col.try_cast(type_name)
    if type_name in ("double", "float"):
        typed = F.when(F.abs(typed) < float("inf"), typed)
    return typed
