"""Chart and table series as long frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ROW, col, dtype_of, is_addable, is_integer, number
from ..functions.formats import category_text, cell_text
from .groups import KEY, ROWS, GroupCache, Measure, NotComputable, check_category

# The row count up to which a line keeps its rows, and a count's name.
MOST_RAW_ROWS = 20
LINE_MODES = ("auto", "rows", "mean")
COUNT_SERIES = "Count"

MOST_FILES = 1000
BLOCK_BITS = 20
"""Positions are counted in blocks of so many bits of the row order."""

SERIES_COLUMNS = ["spec_id", "ord", "category", "series_idx", "series", "value"]


def bar_measures(df: DataFrame, values: list[str]) -> list[tuple[str, Measure]]:
    """Per value column its series name and measure: sums of numbers, counts of the rest."""
    if not values:
        return [(COUNT_SERIES, ROWS)]
    return [(v, ("sum" if is_addable(dtype_of(df, v)) else "count", v)) for v in values]


def line_measures(df: DataFrame, values: list[str]) -> list[tuple[str, Measure]]:
    """Means of the numeric value columns; the others are left out of a long line."""
    if not values:
        return [(COUNT_SERIES, ROWS)]
    numeric = [(v, ("mean", v)) for v in values if is_addable(dtype_of(df, v))]
    if not numeric:
        raise NotComputable("no numeric value column")
    return numeric


def check_roles(df: DataFrame, columns: list[str]) -> tuple[str, list[str]]:
    """Category and value columns of a chart, if its columns allow one."""
    category, values = columns[0], columns[1:]
    check_category(df, category)
    if category in values:
        raise NotComputable("duplicate column")
    if not values and is_addable(dtype_of(df, category)) and not _is_numbered(df):
        raise NotComputable("single numeric column")
    return category, values


def _is_numbered(df: DataFrame) -> bool:
    """Whether the rows carry an order that positions can be counted from."""
    if ROW not in df.columns:
        return False
    dtype = dtype_of(df, ROW)
    return is_integer(dtype.fields[-1].dataType if isinstance(dtype, T.StructType) else dtype)


def is_long(df: DataFrame) -> bool:
    """Whether a line has too many rows to be drawn row by row; reads a few rows only."""
    return len(df.select(F.lit(1)).take(MOST_RAW_ROWS + 1)) > MOST_RAW_ROWS


class SeriesPlan:
    def __init__(self, kind: str, category: str, measures: list, values: list[str] | None = None):
        self.kind, self.category, self.measures, self.values = kind, category, measures, values


def line_mode(mode: str) -> Callable[[DataFrame], bool]:
    """Whether a line shows means per category instead of rows: always (``mean``), never
    (``rows``), or if its table has more than :data:`MOST_RAW_ROWS` rows (``auto``)."""
    if mode not in LINE_MODES:
        raise ValueError(f"unknown line mode {mode}: one of {', '.join(LINE_MODES)}")
    return is_long if mode == "auto" else lambda df: mode == "mean"


def chart_series(
    df: DataFrame, columns: list[str], chart_type: str, spec_id: str = "0", line: str = "auto"
) -> DataFrame:
    """Series of a bar, pie or line chart over the matched columns; :func:`line_mode` tells
    what a line shows."""
    cache = GroupCache()
    plan = plan_series(df, columns, chart_type, line_mode(line))
    if plan.measures:
        for _, measure in plan.measures:
            cache.want("", plan.category, measure)
    return series_rows([(spec_id, "", df, plan)], cache)[0]


def plan_series(
    df: DataFrame, columns: list[str], chart_type: str, is_long: Callable[[DataFrame], bool] = is_long
) -> SeriesPlan:
    category, values = check_roles(df, columns)
    if not values and is_addable(dtype_of(df, category)):
        return SeriesPlan("position", category, [])
    if chart_type == "line" and values and not is_long(df):
        if not all(is_addable(dtype_of(df, v)) for v in values):
            raise NotComputable("value column is not numeric")
        return SeriesPlan("raw", category, [], values)
    measures = line_measures(df, values) if chart_type == "line" else bar_measures(df, values)
    return SeriesPlan("grouped", category, measures)


def series_rows(planned: list[tuple[str, str, DataFrame, SeriesPlan]], cache: GroupCache) -> list[DataFrame]:
    """Frames with the series of many specs (spec_id, table, df, plan): those of the same
    kind over one table and category share a frame."""
    together: dict[tuple, list] = {}
    for spec_id, table, df, plan in planned:
        raw = tuple(plan.values) if plan.kind == "raw" else ()
        together.setdefault((plan.kind, table, plan.category, raw), []).append((spec_id, df, plan))
    frames = []
    for (kind, table, category, raw), entries in together.items():
        df = entries[0][1]
        if kind == "grouped":
            groups = cache.get(df, table, category)
            asked = [(s, i, name, groups.value(m)) for s, _, plan in entries for i, (name, m) in enumerate(plan.measures)]
            frames.append(_long(groups.frame.orderBy(KEY), category_text(F.col(KEY), groups.key_type), asked))
        elif kind == "raw":
            # The rows of a short line in category order, missing categories last.
            ties = [ROW] if ROW in df.columns else [col(v) for v in raw]
            ordered = df.orderBy(col(category).asc_nulls_last(), *ties)
            asked = [(s, i, v, number(col(v), dtype_of(df, v))) for s, _, _ in entries for i, v in enumerate(raw)]
            frames.append(_long(ordered, category_text(col(category), dtype_of(df, category)), asked))
        else:
            # A single numeric column against the position of its rows.
            value = number(F.col("value"), dtype_of(df, category))
            asked = [(s, 0, category, value) for s, _, _ in entries]
            frames.append(_long(positions(df, category), F.col("place").cast("string"), asked, F.col("place")))
    return frames


def file_starts(df: DataFrame) -> dict[str, int] | None:
    """The rows in files before each file, where ``_row`` names file and place (``file``,
    ``idx``) of all rows of at most :data:`MOST_FILES` files; None otherwise.

    That no row was dropped shows in the counts, the last places and the sums of the places."""
    dtype = dtype_of(df, ROW)
    if not isinstance(dtype, T.StructType) or dtype.fieldNames() != ["file", "idx"]:
        return None
    place = F.col(ROW)["idx"]
    whole = F.sum(place.cast("decimal(38,0)")) * 2 == F.max(place).cast("decimal(20,0)") * F.count(F.lit(1))
    files = df.groupBy(F.col(ROW)["file"].alias("file")).agg(
        F.count(F.lit(1)).alias("n"), ((F.count(F.lit(1)) == F.max(place) + 1) & whole).alias("whole")
    ).limit(MOST_FILES + 1).collect()
    if len(files) > MOST_FILES or not all(r["whole"] for r in files):
        return None
    starts, rows = {}, 0
    for r in sorted(files, key=lambda r: r["file"].encode()):
        starts[r["file"]] = rows
        rows += r["n"]
    return starts


def _place(starts: dict[str, int]) -> Column:
    """The place of a row among those of all files, given the rows before each."""
    start = F.create_map(*[x for file, n in starts.items() for x in (F.lit(file), F.lit(n).cast("bigint"))])
    return start[F.col(ROW)["file"]] + F.col(ROW)["idx"]


def positions(df: DataFrame, name: str) -> DataFrame:
    """``place, value``: a column by the positions 0, 1, 2, … of its rows in the order of
    ``_row``, a whole number or a struct that ends in one.

    Rows of whole parquet files are numbered by their places in the files and the row counts
    of the files before; nothing moves. Others are numbered within blocks of a million
    consecutive order numbers, and the blocks by their row counts, so only the counts of the
    blocks ever meet in one task."""
    dtype, row = dtype_of(df, ROW), F.col(ROW)
    starts = file_starts(df)
    if starts:
        return df.select(_place(starts).alias("place"), col(name).alias("value"))
    if isinstance(dtype, T.StructType):
        *outer, last = dtype.fieldNames()
        block = F.struct(*[row[n].alias(n) for n in outer], F.shiftright(row[last].cast("bigint"), BLOCK_BITS).alias(last))
    else:
        block = F.shiftright(row.cast("bigint"), BLOCK_BITS)
    rows = df.select(block.alias("block"), row.alias("row"), col(name).alias("value"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(F.col("block").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("block").orderBy("row"))
    numbered = rows.withColumn("within", within).join(starts, F.col("block").eqNullSafe(F.col("of")))
    return numbered.select((F.col("start") + F.col("within") - 1).alias("place"), "value")


def _long(ordered: DataFrame, category: Column, asked: list, place: Column | None = None) -> DataFrame:
    """One row per point of ``asked`` (spec_id, series_idx, series, value). ``ord`` is
    ``place``, or else rises with the sort order but may have gaps: the ids follow the
    range partitions of the sort, so no task ever sees all categories."""
    points = F.array(
        *[
            F.struct(
                F.lit(spec_id).alias("spec_id"),
                F.lit(i).alias("series_idx"),
                F.lit(name).alias("series"),
                F.coalesce(v.cast("double"), F.lit(0.0)).alias("value"),
            )
            for spec_id, i, name, v in asked
        ]
    )
    order = F.monotonically_increasing_id() if place is None else place
    numbered = ordered.select(order.alias("ord"), category.alias("category"), points.alias("p"))
    return numbered.select("ord", "category", F.inline("p")).select(*SERIES_COLUMNS)


def table_extract(df: DataFrame, columns: list[str]) -> DataFrame:
    """The matched columns of every row, in source order if the rows carry one."""
    ordered = df.orderBy(ROW) if ROW in df.columns else df
    return ordered.select(*[col(c) for c in columns])


def table_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table as texts, one column per matched column."""
    if len(set(columns)) < len(columns):
        raise NotComputable("duplicate column")
    ordered = df.orderBy(ROW) if ROW in df.columns else df
    return ordered.select(*[cell_text(col(c), dtype_of(df, c)).alias(c) for c in columns])


def table_rows(df: DataFrame, columns: list[str], *spec_ids: str) -> DataFrame:
    """The table as ``spec_id, ord, names, cells``, the same shape for every table, once
    for each spec that shows it. Rows of whole parquet files get their order from their
    places, without a sort."""
    ids = F.array(*[F.lit(s) for s in spec_ids or ("0",)])
    starts = file_starts(df) if ROW in df.columns else None
    if starts and len(set(columns)) == len(columns):
        cells = [cell_text(col(c), dtype_of(df, c)).alias(c) for c in columns]
        numbered = df.select(*cells, _place(starts).alias(ROW))
    else:
        numbered = table_cells(df, columns).select("*", F.monotonically_increasing_id().alias(ROW))
    return numbered.select(
        F.explode(ids).alias("spec_id"),
        F.col(ROW).alias("ord"),
        F.array(*[F.lit(c) for c in columns]).alias("names"),
        F.array(*[col(c) for c in columns]).alias("cells"),
    )
