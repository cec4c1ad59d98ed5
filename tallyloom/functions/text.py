"""Numbers as plain text, as a spreadsheet or another program reads them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _spelled_out(text: Column) -> Column:
    """Decimal text without an exponent: ``1.25E-3`` becomes ``0.00125``."""
    parts = F.regexp_extract
    form = r"^(-?)(\d+)(?:\.(\d+))?[eE]([+-]?\d+)$"
    sign, whole = parts(text, form, 1), parts(text, form, 2)
    digits = F.concat(whole, F.regexp_replace(parts(text, form, 3), "0+$", ""))
    point = F.length(whole) + parts(text, form, 4).cast("int")  # digits before the point
    size = F.length(digits)
    left = F.when(point <= 0, F.lit("0")).otherwise(F.rpad(F.substring(digits, F.lit(1), point), point, "0"))
    right = (F.when(point <= 0, F.concat(F.repeat(F.lit("0"), -point), digits))
             .when(point >= size, F.lit("0")).otherwise(F.substring(digits, point + 1, size)))
    return F.when(text.rlike(form), F.concat(sign, left, F.lit("."), right)).otherwise(text)


def plain_number(value: Column, kind: T.DataType) -> Column:
    """``value`` as the shortest text that reads back as the same number, never with an exponent.

    Doubles try 15 and 16 digits before the 17 that always suffice, as the
    text of a cast isn't the shortest on every Java. NaN gives null (a missing
    value); infinities are ``inf`` and ``-inf``. Numbers below 1e-307 may have a digit too
    many. Other types: their cast.
    """
    if not isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return value.cast("string")
    text = value.cast("string")
    if isinstance(kind, T.DecimalType):
        return _spelled_out(text)
    if isinstance(kind, T.DoubleType):
        tried = [F.format_string(f"%.{n}e", value) for n in (14, 15)]
        text = F.coalesce(*[F.when(t.try_cast("double") == value, t) for t in tried], text)
    plain = _spelled_out(text)
    inf = F.lit(float("inf"))
    return (F.when(F.isnan(value), F.lit(None).cast("string")).when(value == inf, "inf").when(value == -inf, "-inf")
            .otherwise(plain))
