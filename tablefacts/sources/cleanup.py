"""Cleanup shared by all sources: missing values, empty rows and columns, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ROW, col, data_columns, dtype_of
from ..functions.names import clean_names

# Texts that stand for a missing value in a text source.
MISSING_TEXTS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

COLUMNS_PER_JOB = 64


def present_text(c: Column) -> Column:
    """The text, or null where it stands for a missing value."""
    return F.when(~c.isin(MISSING_TEXTS), c)


def normalize_missing(df: DataFrame, text_source: bool = False) -> DataFrame:
    """NaN becomes null; in text sources so do the texts that mean "missing"."""
    return df.select(*[_normalized(df, c, text_source) for c in df.columns])


def _normalized(df: DataFrame, name: str, text_source: bool) -> Column:
    dtype = dtype_of(df, name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col(name)), col(name)).alias(name)
    if text_source and isinstance(dtype, T.StringType) and name != ROW:
        return present_text(col(name)).alias(name)
    return col(name)


def has_value(df: DataFrame) -> Column:
    """True for rows with at least one value."""
    names = data_columns(df)
    if not names:
        return F.lit(False)
    return F.coalesce(*[F.when(col(c).isNotNull(), F.lit(True)) for c in names], F.lit(False))


def is_empty_table(df: DataFrame) -> bool:
    """Whether no row has any value; stops at the first row that does."""
    return df.where(has_value(df)).isEmpty()


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.where(has_value(df))


def value_counts_per_column(df: DataFrame) -> dict[str, int]:
    """Non-null values per column, counted a few columns per job."""
    counts: dict[str, int] = {}
    names = data_columns(df)
    for start in range(0, len(names), COLUMNS_PER_JOB):
        chunk = names[start : start + COLUMNS_PER_JOB]
        row = df.agg(*[F.count(col(c)).alias(str(i)) for i, c in enumerate(chunk)]).first()
        counts |= dict(zip(chunk, row))
    return counts


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Leave out columns without any value; needs one aggregate over the table."""
    counts = value_counts_per_column(df)
    return df.select(*[col(c) for c in df.columns if c == ROW or counts[c] > 0])


def rename_clean(df: DataFrame) -> DataFrame:
    """Give the columns their cleaned, distinct names."""
    cleaned = iter(clean_names(data_columns(df)))
    return df.toDF(*[c if c == ROW else next(cleaned) for c in df.columns])


def clean_table(df: DataFrame, text_source: bool = False) -> DataFrame:
    """All cleanup steps for a table whose columns are already named and typed."""
    df = normalize_missing(df, text_source)
    return rename_clean(drop_empty_columns(drop_empty_rows(df)))


def validate_workspace(profile: DataFrame) -> DataFrame:
    """One row: tables with rows, their columns, and whether there is anything to chart."""
    usable = F.col("row_count") > 0
    counted = profile.agg(
        F.count_distinct(F.when(usable, F.col("table"))).alias("tables"),
        F.count_if(usable & F.col("column").isNotNull()).alias("columns"),
    )
    reason = (
        F.when(F.col("tables") == 0, F.lit("no table has rows"))
        .when(F.col("columns") == 0, F.lit("no table has columns"))
        .otherwise(F.lit("ok"))
    )
    return counted.select("*", (reason == "ok").alias("usable"), reason.alias("reason"))
