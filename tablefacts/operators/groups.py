"""One group-by per (table, category), shared by KPIs, facts and series."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    col,
    dtype_of,
    is_addable,
    is_datetime,
    is_text,
    label_of,
    mean,
    total,
)

# The aggregates a spec may name.
AGGREGATES = ("sum", "mean", "count", "max", "min")

KEY = "k"
ROWS = ("count", None)
"""The measure that counts rows instead of values."""

Measure = tuple[str, str | None]


class NotComputable(Exception):
    """A spec that the schema already rules out; the text is the reason."""


def measure_expr(df: DataFrame, measure: Measure) -> Column:
    agg, name = measure
    if name is None:
        return F.count(F.lit(1))
    dtype, c = dtype_of(df, name), col(name)
    if agg == "count":
        return F.count(c)
    if agg in ("max", "min"):
        if not (is_addable(dtype) or is_datetime(dtype) or is_text(dtype)):
            raise NotComputable("unsupported type")
        return F.max(c) if agg == "max" else F.min(c)
    if not is_addable(dtype):
        raise NotComputable("not numeric")
    return total(c, dtype) if agg == "sum" else mean(c, dtype)


@dataclass
class Groups:
    """A grouped frame: key ``k`` plus one column per measure."""

    frame: DataFrame
    names: dict[Measure, str]

    @property
    def key_type(self) -> T.DataType:
        return self.frame.schema[KEY].dataType

    def value(self, measure: Measure) -> Column:
        return F.col(self.names[measure])

    def value_type(self, measure: Measure) -> T.DataType:
        return self.frame.schema[self.names[measure]].dataType


def check_category(df: DataFrame, name: str) -> None:
    if label_of(dtype_of(df, name)) is None:
        raise NotComputable("unsupported type")


def text_extreme(df: DataFrame, measure: Measure) -> str | None:
    """The column of a text maximum or minimum. Such a measure is grouped apart, as texts
    have no place in a hash aggregate and would make it sort the source."""
    agg, name = measure
    return name if agg in ("max", "min") and is_text(dtype_of(df, name)) else None


def group(df: DataFrame, category: str, measures: list[Measure], apart: str | None = None) -> Groups:
    """Group by the non-null categories; combined map-side, so hot keys stay small.

    Extremes of the text column ``apart`` are taken from its distinct pairs with the
    category, which a hash aggregate finds."""
    wanted = list(dict.fromkeys(measures))
    names = {m: f"m{i}" for i, m in enumerate(wanted)}
    if apart is not None:
        pairs = df.where(col(category).isNotNull()).groupBy(col(category).alias(KEY), col(apart).alias("text"))
        # The count keeps the optimizer from folding this step into the next one.
        pairs = pairs.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 0)
        extremes = [(F.max("text") if m[0] == "max" else F.min("text")).alias(names[m]) for m in wanted]
        return Groups(pairs.groupBy(KEY).agg(*extremes), names)
    exprs = [measure_expr(df, m).alias(names[m]) for m in wanted]
    frame = df.where(col(category).isNotNull()).groupBy(col(category).alias(KEY)).agg(*exprs)
    return Groups(frame, names)


@dataclass
class GroupCache:
    """Collects the measures wanted per (table, category) and groups each once, those of a
    text column ``apart`` on their own.

    With ``keep`` a grouping that several results use is persisted, not its source; lost
    blocks are computed again from the source."""

    keep: bool = False
    wanted: dict[tuple[str, str, str | None], list[Measure]] = field(default_factory=dict)
    made: dict[tuple[str, str, str | None], Groups] = field(default_factory=dict)

    def want(self, table: str, category: str, measure: Measure, apart: str | None = None) -> None:
        self.wanted.setdefault((table, category, apart), []).append(measure)

    def get(self, df: DataFrame, table: str, category: str, apart: str | None = None) -> Groups:
        key = (table, category, apart)
        if key not in self.made:
            groups = group(df, category, self.wanted[key], apart)
            if self.keep and len(self.wanted[key]) > 1:
                groups.frame.persist(StorageLevel.MEMORY_AND_DISK)
            self.made[key] = groups
        return self.made[key]

    def release(self) -> None:
        for groups in self.made.values():
            groups.frame.unpersist()
