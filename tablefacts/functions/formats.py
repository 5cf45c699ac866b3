"""Number, date and cell texts, all built from JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import is_datetime, is_float, is_integer

# What stands in for missing or absent things.
EMPTY_CELL = "—"
NO_CATEGORY = "N/A"
NO_VALUE = "0"
NO_SHARE = "0.0%"
MISSING_NUMBER = "nan"
MISSING_TIME = "NaT"


def thousands(c: Column, digits: int) -> Column:
    return F.format_number(c, digits)


def four_digits(c: Column) -> Column:
    """A double rounded to four digits, halves to even by its exact binary value."""
    return F.call_function("format_number", c, F.lit("0.0000")).cast("double")


def share(part: Column, whole: Column) -> Column:
    """``part`` as a percentage of ``whole``; 0 when the whole is 0."""
    p, w = part.cast("double"), whole.cast("double")
    return F.when(w != 0, p / w * 100).otherwise(F.lit(0.0))


def share_text(pct: Column) -> Column:
    return F.concat(F.call_function("format_number", pct, F.lit("0.0")), F.lit("%"))


def timestamp_text(c: Column, separator: str = " ") -> Column:
    """``yyyy-MM-dd HH:mm:ss`` with a six digit fraction only if there is one."""
    text = c.cast("timestamp_ntz").cast("string")
    text = F.when(F.contains(text, F.lit(".")), F.rpad(text, 26, "0")).otherwise(text)
    return text if separator == " " else F.replace(text, F.lit(" "), F.lit(separator))


def iso_text(c: Column) -> Column:
    return timestamp_text(c, "T")


def day_text(c: Column) -> Column:
    return F.substring(c.cast("string"), 1, 10)


def float_text(c: Column) -> Column:
    """Shortest text of a double: plain digits up to 1e16, exponent form beyond."""
    size = F.abs(c)
    plain = F.call_function("format_number", c, F.lit("0.0################"))
    exponent = F.regexp_replace(c.cast("string"), r"\.0E", "E")
    exponent = F.regexp_replace(exponent, r"E(\d)", "e+$1")
    exponent = F.regexp_replace(exponent, "E-", "e-")
    exponent = F.regexp_replace(exponent, r"e([+-])(\d)$", "e$10$2")
    grouped = F.replace(plain, F.lit(","), F.lit(""))
    return F.when(F.isnan(c), F.lit(MISSING_NUMBER)).when(
        (c == 0) | ((size >= 1e-4) & (size < 1e16)), grouped
    ).otherwise(exponent)


def plain_text(c: Column, dtype: T.DataType) -> Column:
    """The value as it is written when used as a category or label."""
    if isinstance(dtype, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(dtype, T.DoubleType):
        return float_text(c)
    if isinstance(dtype, T.FloatType):
        return float_text(c.cast("string").cast("double"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return timestamp_text(c)
    return c.cast("string")


def key_text(c: Column, dtype: T.DataType) -> Column:
    """The key of a KPI: dates shortened to the day, everything else as written."""
    return day_text(c) if is_datetime(dtype) else plain_text(c, dtype)


def single_value_text(c: Column, dtype: T.DataType) -> Column:
    """KPI value: whole numbers with thousands, others with one digit, dates by day."""
    if is_float(dtype) and not _whole_decimal(dtype):
        return F.when(c == F.floor(c), thousands(c, 0)).otherwise(thousands(c, 1))
    if is_integer(dtype) or _whole_decimal(dtype):
        return thousands(c, 0)
    return key_text(c, dtype)


def fact_text(c: Column, dtype: T.DataType) -> Column:
    """Fact value: two digits for floats, thousands for whole-number types."""
    whole = is_integer(dtype) or _whole_decimal(dtype)
    return thousands(c, 0 if whole else 2)


def cell_text(c: Column, dtype: T.DataType) -> Column:
    """Table cell: missing as a dash, floats with two digits, the rest as written."""
    text = thousands(c, 2) if is_float(dtype) else plain_text(c, dtype)
    return F.coalesce(text, F.lit(EMPTY_CELL))


def category_text(c: Column, dtype: T.DataType) -> Column:
    missing = MISSING_TIME if is_datetime(dtype) else MISSING_NUMBER
    return F.coalesce(plain_text(c, dtype), F.lit(missing))


def _whole_decimal(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.DecimalType) and dtype.scale == 0
