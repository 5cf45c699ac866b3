"""Ranked facts: leading, second and last category of a value column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import dtype_of, is_addable, total, union_all
from ..functions.formats import (
    NO_CATEGORY,
    NO_SHARE,
    NO_VALUE,
    fact_text,
    plain_text,
    share,
    share_text,
    thousands,
)
from .groups import AGGREGATES, KEY, ROWS, Groups, Measure, NotComputable, check_category, group

# The names of the facts.
FACTS = [
    "top_category",
    "top_value",
    "top_pct",
    "second_category",
    "second_value",
    "second_pct",
    "bottom_category",
    "bottom_value",
    "total_value",
    "mean_value",
    "count",
]


def pick_roles(df: DataFrame, columns: list[str]) -> tuple[str, str | None]:
    """Category and value column: the first numeric one after the category, else the second."""
    category, rest = columns[0], columns[1:]
    numeric = [c for c in rest if is_addable(dtype_of(df, c))]
    return category, next(iter(numeric or rest), None)


def fact_measure(df: DataFrame, columns: list[str], agg: str = "sum") -> tuple[str, Measure]:
    """Category and the measure ranked: a sum, a count of values, or a count of rows."""
    category, value = pick_roles(df, columns)
    check_category(df, category)
    if value == category:
        raise NotComputable("duplicate column")
    if agg not in AGGREGATES:
        raise NotComputable("unknown aggregate")
    if value is None:
        return category, ROWS
    return category, (agg if is_addable(dtype_of(df, value)) else "count", value)


def category_totals(df: DataFrame, columns: list[str], agg: str = "sum") -> DataFrame:
    """``category, value`` per non-null category."""
    category, measure = fact_measure(df, columns, agg)
    groups = group(df, category, [measure])
    return groups.frame.select(F.col(KEY).alias("category"), groups.value(measure).alias("value"))


def insight_facts(
    df: DataFrame, columns: list[str], spec_id: str = "0", agg: str = "sum"
) -> DataFrame:
    """One row with the eleven facts as text, and their numbers beside them."""
    category, measure = fact_measure(df, columns, agg)
    return finish_facts([fact_rows(group(df, category, [measure]), {measure: [spec_id]})])


def _place(groups: Groups, measure: Measure) -> tuple[Column, Column, T.DataType]:
    """The place of a group in the ranking of a measure, its amount and the amount's type."""
    vtype, amount = groups.value_type(measure), groups.value(measure)
    if isinstance(vtype, T.BooleanType):
        vtype, amount = T.LongType(), amount.cast("bigint")
    # Negated as a decimal, which holds the negative of the least bigint too.
    down = -amount.cast("decimal(20,0)") if isinstance(vtype, T.LongType) else -amount
    return F.when(amount.isNotNull(), F.struct(down.alias("down"), F.col(KEY).alias("key"))), amount, vtype


def fact_rows(groups: Groups, asked: dict[Measure, list[str]]) -> DataFrame:
    """One row for each of the specs that ask a measure of one grouping.

    Equal values rank by category ascending. The leaders of all measures are one aggregate,
    read as a subquery of one row; the seconds are the least places after them, in one
    more aggregate with the totals. No group list is ever sorted or gathered as a whole.
    """
    ranked = [_place(groups, m) for m in asked]
    leaders = groups.frame.agg(*[F.min(p).alias(f"f{i}") for i, (p, _, _) in enumerate(ranked)])
    first = leaders.select(F.struct(*leaders.columns).alias("first")).scalar()
    aggregates = []
    for i, (place, amount, vtype) in enumerate(ranked):
        aggregates += [
            F.min(F.when(place > first[f"f{i}"], place)).alias(f"next{i}"),
            F.max(place).alias(f"last{i}"),
            total(amount, vtype).alias(f"total{i}"),
            F.count(amount).alias(f"n{i}"),
        ]
    row = groups.frame.agg(*aggregates).select("*", first.alias("first"))

    def facts(i: int, ids: list[str]) -> Column:
        vtype = ranked[i][2]
        back = "bigint" if isinstance(vtype, T.LongType) else vtype
        places = {"top": F.col("first")[f"f{i}"], "second": F.col(f"next{i}"), "bottom": F.col(f"last{i}")}
        parts = [F.array(*[F.lit(s) for s in ids]).alias("ids")]
        for name, place in places.items():
            value = (-place["down"]).cast(back)
            parts += [
                plain_text(place["key"], groups.key_type).alias(f"{name}_category"),
                fact_text(value, vtype).alias(f"{name}_value"),
                value.cast("double").alias(f"{name}_number"),
            ]
        whole, n = F.col(f"total{i}"), F.col(f"n{i}")
        parts += [
            fact_text(whole, vtype).alias("total_value"),
            whole.cast("double").alias("total_number"),
            F.when(n > 0, whole.cast("double") / n).alias("mean_number"),
            n.alias("count_number"),
        ]
        return F.struct(*parts)

    rows = row.select(F.inline(F.array(*[facts(i, ids) for i, ids in enumerate(asked.values())])))
    return rows.select(F.explode("ids").alias("spec_id"), *rows.drop("ids").columns)


def finish_facts(parts: list[DataFrame]) -> DataFrame:
    """The rows of all groupings as the eleven facts and their numbers."""
    rows = union_all(parts)
    top_share = share(F.col("top_number"), F.col("total_number"))
    second_share = share(F.col("second_number"), F.col("total_number"))
    texts = {
        "top_category": F.col("top_category"),
        "top_value": F.col("top_value"),
        "top_pct": share_text(top_share),
        "second_category": F.col("second_category"),
        "second_value": F.col("second_value"),
        "second_pct": share_text(second_share),
        "bottom_category": F.col("bottom_category"),
        "bottom_value": F.col("bottom_value"),
        "total_value": F.col("total_value"),
        "mean_value": thousands(F.col("mean_number"), 2),
        "count": thousands(F.col("count_number"), 0),
    }
    absent = {n: NO_CATEGORY for n in FACTS if n.endswith("category")}
    absent |= {n: NO_SHARE for n in FACTS if n.endswith("pct")}
    return rows.select(
        "spec_id",
        *[F.coalesce(texts[n], F.lit(absent.get(n, NO_VALUE))).alias(n) for n in FACTS],
        "top_number",
        "second_number",
        "bottom_number",
        "total_number",
        "mean_number",
        "count_number",
    )
