"""Column references and the type rules shared by every operator."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROW = "_row"
"""Optional source-order column; any orderable type, never treated as data."""

LARGEST_SPLIT = 1e38
"""Larger doubles do not fit a float and are added as they are."""

# The labels a column can be given.
BOOLEAN = "boolean"
FLOAT = "numeric (float)"
INTEGER = "numeric (integer)"
DATETIME = "datetime"
DATETIME_INFERRED = "datetime (inferred)"
TEXT = "categorical / text"

FLOAT_TYPES = (T.FloatType, T.DoubleType, T.DecimalType)
INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def col(name: str) -> Column:
    """Reference a column by its exact name, whatever characters it contains."""
    return F.col("`" + name.replace("`", "``") + "`")


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW]


def local_frame(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """Rows the driver holds, as a frame of a size that Spark knows: its own threshold then
    decides whether a join broadcasts it."""
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(fields)
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), fields)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames with equal columns. Joined in pairs, so that no frame is looked
    through more often than the logarithm of their number."""
    while len(frames) > 1:
        pairs = [frames[i : i + 2] for i in range(0, len(frames), 2)]
        frames = [p[0].unionByName(p[1]) if len(p) > 1 else p[0] for p in pairs]
    return frames[0]


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def label_of(dtype: T.DataType) -> str | None:
    """Label of a storage type; ``None`` for nested and other unsupported types."""
    if isinstance(dtype, T.BooleanType):
        return BOOLEAN
    if isinstance(dtype, FLOAT_TYPES):
        return FLOAT
    if isinstance(dtype, INTEGER_TYPES):
        return INTEGER
    if isinstance(dtype, DATETIME_TYPES):
        return DATETIME
    if isinstance(dtype, T.StringType):
        return TEXT
    return None


def is_integer(dtype: T.DataType) -> bool:
    return isinstance(dtype, INTEGER_TYPES)


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, FLOAT_TYPES)


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, DATETIME_TYPES)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def is_addable(dtype: T.DataType) -> bool:
    """Numbers, and booleans counted as 0/1."""
    return is_integer(dtype) or is_float(dtype) or isinstance(dtype, T.BooleanType)


def number(c: Column, dtype: T.DataType) -> Column:
    """The column as something Spark can add up."""
    return c.cast("int") if isinstance(dtype, T.BooleanType) else c


def total(c: Column, dtype: T.DataType) -> Column:
    """Sum with 0 for an empty or all-null group.

    Integers are added as decimals: a bigint sum overflows (and fails the job under ANSI
    rules) once billions of rows are involved.
    """
    if is_integer(dtype) or isinstance(dtype, T.BooleanType):
        zero = F.lit(0).cast("decimal(30,0)")
        return F.coalesce(F.sum(number(c, dtype).cast("decimal(20,0)")), zero)
    if isinstance(dtype, T.DecimalType):
        return F.coalesce(F.sum(c), F.lit(0).cast(dtype))
    return F.coalesce(float_sum(c), F.lit(0.0))


def float_sum(c: Column) -> Column:
    """Sum of doubles that does not depend on the order of the rows.

    Each value is split into its leading 24 bits and the rest. A double adds hundreds of
    millions of such leading parts exactly, and the rests are too small for their rounding
    to show, so any partitioning gives the same, correctly rounded sum.
    """
    lead, rest = float_parts(c)
    return F.sum(lead) + F.coalesce(F.sum(rest), F.lit(0.0))


def float_parts(c: Column) -> tuple[Column, Column]:
    """The leading 24 bits of a double and the rest, null where the value is not split."""
    v = c.cast("double")
    splits = F.abs(v) < LARGEST_SPLIT
    lead = F.when(splits, v.cast("float").cast("double")).otherwise(v)
    return lead, F.when(splits, v - lead)


def mean(c: Column, dtype: T.DataType) -> Column:
    """Mean of the non-null values, from the sum above; null without values."""
    values = F.count(c)
    return F.when(values > 0, total(c, dtype).cast("double") / values)
