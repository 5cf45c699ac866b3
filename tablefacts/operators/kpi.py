"""KPI specs: extreme category, average per group, filtered rate and sum, peak point."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    ROW,
    col,
    dtype_of,
    is_addable,
    is_datetime,
    is_integer,
    is_text,
    local_frame,
    mean,
    total,
    union_all,
)
from ..functions.formats import key_text, single_value_text
from ..functions.names import resolve_columns
from .groups import AGGREGATES, KEY, GroupCache, Groups, NotComputable, check_category, text_extreme

# The spec vocabulary and how many KPIs a spec may carry.
TYPES = ("extreme_category", "avg_per_group", "filtered_rate", "filtered_sum", "peak_point")
COLUMN_FIELDS = ("group_by", "value_col", "filter_col", "x_col")
MOST_KPIS = 3
FAR = 1 << 30
PERCENT = "%"

OK = "ok"
NO_VALUE = "skipped: no value"

RESULT_SCHEMA = (
    "spec_id string, kpi_idx int, label string, type string, "
    "key string, value double, formatted string, status string"
)


def resolve_kpi(spec: dict, columns: list[str]) -> dict:
    """Replace the column names of a KPI by the actual ones; unknown names stay."""
    resolved = dict(spec)
    for name in COLUMN_FIELDS:
        if spec.get(name):
            if not isinstance(spec[name], str):
                raise NotComputable(f"{name} is no name")
            found, _ = resolve_columns([spec[name]], columns)
            resolved[name] = found[0] if found else spec[name]
    return resolved


@lru_cache(maxsize=10_000)
def check_pattern(pattern: str) -> None:
    """Reject a pattern Java cannot compile before it can fail a whole job. A row that the
    driver holds is searched while the query is planned, without a job."""
    text = local_frame(SparkSession.active(), [("",)], "text string")
    try:
        text.select(_matches(F.col("text"), pattern)).first()
    except Exception as error:
        raise NotComputable("bad pattern") from error


def _matches(c: Column, pattern: str) -> Column:
    """Case-insensitive, Unicode-aware search; missing text does not match."""
    return F.coalesce(c.rlike("(?iU)" + pattern), F.lit(False))


def _field(spec: dict, name: str) -> str:
    value = spec.get(name)
    if value is None:
        raise NotComputable(f"no {name}")
    return value


def _column(df: DataFrame, spec: dict, name: str) -> str:
    column = _field(spec, name)
    if column not in df.columns or column == ROW:
        raise NotComputable(f"unknown column in {name}")
    return column


def _result(key: Column | None, value: Column, text: Column) -> Column:
    return F.struct(
        (F.lit(None).cast("string") if key is None else key).alias("key"),
        value.alias("value"),
        text.alias("formatted"),
    )


def _pair(key: Column, ktype: T.DataType, value: Column, vtype: T.DataType) -> Column:
    written = key_text(key, ktype)
    text = F.concat(written, F.lit(" ("), single_value_text(value, vtype), F.lit(")"))
    amount = value.cast("double") if is_addable(vtype) else F.lit(None)
    return _result(written, amount.cast("double"), text)


def _descending(value: Column, dtype: T.DataType) -> Column | None:
    """An expression that sorts the other way round, without overflow; None if there is none."""
    if isinstance(dtype, T.BooleanType):
        return ~value
    if is_integer(dtype):
        return F.bitwise_not(value)
    if is_addable(dtype):
        return -value
    return None


class Plan:
    """What one KPI needs: either a grouped measure or aggregates over all rows."""

    def __init__(self, df: DataFrame, spec: dict):
        kind = _field(spec, "type")
        if kind not in TYPES:
            raise NotComputable("unknown type")
        self.kind, self.df = kind, df
        self.category = self.measure = self.apart = None
        if kind in ("extreme_category", "avg_per_group"):
            self._plan_grouped(spec)
        elif kind == "peak_point":
            self._plan_peak(spec)
        else:
            self._plan_filtered(spec)

    def _plan_grouped(self, spec: dict) -> None:
        agg = _field(spec, "agg")
        if agg not in AGGREGATES:
            raise NotComputable("unknown agg")
        self.category = _column(self.df, spec, "group_by")
        check_category(self.df, self.category)
        value = _column(self.df, spec, "value_col")
        dtype = dtype_of(self.df, value)
        if agg in ("sum", "mean") and not is_addable(dtype):
            raise NotComputable("not numeric")
        if self.kind == "avg_per_group" and agg in ("max", "min") and not is_addable(dtype):
            raise NotComputable("not numeric")
        if not (agg == "count" or is_addable(dtype) or is_datetime(dtype) or is_text(dtype)):
            raise NotComputable("unsupported type")
        self.lowest = self.kind == "extreme_category" and _field(spec, "which") == "min"
        self.measure = (agg, value)
        self.apart = text_extreme(self.df, self.measure)

    def _plan_filtered(self, spec: dict) -> None:
        column = _column(self.df, spec, "filter_col")
        if not is_text(dtype_of(self.df, column)):
            raise NotComputable("not text")
        pattern = _field(spec, "filter_contains")
        if not isinstance(pattern, str):
            raise NotComputable("bad pattern")
        check_pattern(pattern)
        hit = _matches(col(column), pattern)
        if self.kind == "filtered_rate":
            self.aggregates = [
                F.count(F.when(hit, 1)).alias("hits"),
                F.count(F.lit(1)).alias("rows"),
            ]
            return
        value = _column(self.df, spec, "value_col")
        dtype = dtype_of(self.df, value)
        if not is_addable(dtype):
            raise NotComputable("not numeric")
        self.aggregates = [
            total(F.when(hit, col(value)), dtype).alias("sum"),
            F.count(F.lit(1)).alias("rows"),
        ]
        self.value_type = T.DecimalType(30, 0) if not _floating(dtype) else T.DoubleType()

    def _plan_peak(self, spec: dict) -> None:
        x, value = _column(self.df, spec, "x_col"), _column(self.df, spec, "value_col")
        check_category(self.df, x)
        self.value_type, self.x_type = dtype_of(self.df, value), dtype_of(self.df, x)
        down = _descending(col(value), self.value_type)
        if down is None and not is_datetime(self.value_type):
            raise NotComputable("not numeric")
        if down is None:
            micros = F.unix_micros(col(value).cast("timestamp_ntz").cast("timestamp"))
            down = -micros
        tie = col(ROW) if ROW in self.df.columns else col(x)
        place = F.struct(down.alias("down"), tie.alias("tie"), col(x).alias("x"), col(value).alias("v"))
        self.aggregates = [F.min(F.when(col(value).isNotNull(), place)).alias("peak")]

    def scalar_result(self, agg: Column) -> Column:
        """The result of a KPI over all rows, from the struct of its aggregates."""
        if self.kind == "filtered_rate":
            rate = F.when(agg["rows"] > 0, agg["hits"] / agg["rows"] * 100)
            text = F.concat(single_value_text(rate, T.DoubleType()), F.lit(PERCENT))
            return _result(None, rate, text)
        if self.kind == "filtered_sum":
            amount = F.when(agg["rows"] > 0, agg["sum"])
            text = single_value_text(amount, self.value_type)
            return _result(None, amount.cast("double"), text)
        peak = agg["peak"]
        return _pair(peak["x"], self.x_type, peak["v"], self.value_type)

    def grouped_reduction(self, groups: Groups) -> Column | None:
        """One aggregate over the groups; None where only a top-1 query can answer."""
        value, vtype = groups.value(self.measure), groups.value_type(self.measure)
        if self.kind == "avg_per_group":
            return F.struct(mean(value, vtype).alias("mean"))
        order = value if self.lowest else _descending(value, vtype)
        if order is None:
            return None
        place = F.struct(order.alias("o"), F.col(KEY).alias("k"), value.alias("v"))
        return F.struct(F.min(F.when(value.isNotNull(), place)).alias("best"))

    def grouped_result(self, agg: Column, groups: Groups) -> Column:
        if self.kind == "avg_per_group":
            return _result(None, agg["mean"], single_value_text(agg["mean"], T.DoubleType()))
        best, vtype = agg["best"], groups.value_type(self.measure)
        return _pair(best["k"], groups.key_type, best["v"], vtype)

    def grouped_top(self, groups: Groups) -> Column:
        return _pair(
            F.col(KEY), groups.key_type, groups.value(self.measure), groups.value_type(self.measure)
        )


def _floating(dtype: T.DataType) -> bool:
    return not (is_integer(dtype) or isinstance(dtype, T.BooleanType))


def plan_kpis(df: DataFrame, specs: list[dict], most: int = MOST_KPIS) -> list[tuple[int, dict, Plan | str]]:
    """The specs that carry a label, each with its plan or the reason it has none: those
    after the first ``most`` are named and not computed."""
    columns = [c for c in df.columns if c != ROW]
    planned = []
    for i, spec in enumerate(specs):
        if not spec.get("label"):
            continue
        spec = {**spec, "label": str(spec["label"])}
        if i >= most:
            planned.append((i, spec, f"skipped: beyond the first {most}"))
            continue
        try:
            planned.append((i, spec, Plan(df, resolve_kpi(spec, columns))))
        except NotComputable as reason:
            planned.append((i, spec, f"skipped: {reason}"))
    return planned


def want_groups(cache: GroupCache, table: str, planned: list) -> None:
    for _, _, plan in planned:
        if isinstance(plan, Plan) and plan.category is not None:
            cache.want(table, plan.category, plan.measure, plan.apart)


def compute_kpis(df: DataFrame, specs: list[dict], spec_id: str = "0", most: int = MOST_KPIS) -> DataFrame:
    """KPI rows of one spec: KPIs that share a group-by or a scan are computed together."""
    planned = [(spec_id, *p) for p in plan_kpis(df, specs, most)]
    cache = GroupCache()
    want_groups(cache, "", [p[1:] for p in planned])
    return finish_kpis(kpi_rows(df, "", planned, cache), df.sparkSession)


def kpi_rows(df: DataFrame, table: str, planned: list, cache: GroupCache) -> list[DataFrame]:
    """Frames with the KPI rows of one table; ``planned`` holds (spec_id, index, spec, plan)."""
    frames, scalars, grouped, skipped = [], [], {}, []
    for entry in planned:
        plan = entry[3]
        if not isinstance(plan, Plan):
            skipped.append(entry)
        elif plan.category is None:
            scalars.append(entry)
        else:
            grouped.setdefault((plan.category, plan.apart), []).append(entry)

    if skipped:
        rows = [
            (s, i, k["label"], str(k["type"]) if k.get("type") else None, None, None, None, why)
            for s, i, k, why in skipped
        ]
        frames.append(df.sparkSession.createDataFrame(rows, RESULT_SCHEMA))
    if scalars:
        aggs = [F.struct(*e[3].aggregates).alias(f"a{n}") for n, e in enumerate(scalars)]
        row = df.agg(*aggs)
        results = [(e, e[3].scalar_result(F.col(f"a{n}"))) for n, e in enumerate(scalars)]
        frames.append(_stack(row, results))
    for (category, apart), entries in grouped.items():
        groups = cache.get(df, table, category, apart)
        reduced = [(e, e[3].grouped_reduction(groups)) for e in entries]
        together = [(e, r) for e, r in reduced if r is not None]
        if together:
            row = groups.frame.agg(*[r.alias(f"a{n}") for n, (_, r) in enumerate(together)])
            results = [
                (e, e[3].grouped_result(F.col(f"a{n}"), groups)) for n, (e, _) in enumerate(together)
            ]
            frames.append(_stack(row, results))
        for e, r in reduced:
            if r is None:
                v = groups.value(e[3].measure)
                name = groups.names[e[3].measure]
                best = groups.frame.where(v.isNotNull()).orderBy(v.desc(), KEY).limit(1)
                best = best.agg(F.first(KEY).alias(KEY), F.first(name).alias(name))
                frames.append(_stack(best, [(e, e[3].grouped_top(groups))]))
    return frames


def _stack(row: DataFrame, results: list) -> DataFrame:
    """Turn the one-row result into one row per KPI."""
    parts = [
        F.struct(
            F.lit(spec_id).alias("spec_id"),
            F.lit(i).alias("kpi_idx"),
            F.lit(spec["label"]).alias("label"),
            F.lit(spec["type"]).alias("type"),
            result.alias("r"),
        )
        for (spec_id, i, spec, _), result in results
    ]
    found = F.col("r.formatted").isNotNull()
    return (
        row.select(F.inline(F.array(*parts)))
        .select("spec_id", "kpi_idx", "label", "type", "r.*", found.alias("found"))
        .select(
            "spec_id",
            "kpi_idx",
            "label",
            "type",
            "key",
            "value",
            "formatted",
            F.when(F.col("found"), F.lit(OK)).otherwise(F.lit(NO_VALUE)).alias("status"),
        )
    )


def finish_kpis(frames: list[DataFrame], spark: SparkSession) -> DataFrame:
    """All KPI rows; of equal labels in a spec the last computed one takes the first place."""
    if not frames:
        return spark.createDataFrame([], RESULT_SCHEMA)
    rows = union_all(frames)
    whole = F.struct(*[F.col(c) for c in rows.columns])
    place = F.when(F.col("status") == OK, F.col("kpi_idx"))
    kept = rows.groupBy(F.col("spec_id").alias("s"), F.col("label").alias("l")).agg(
        F.max_by(whole, F.coalesce(place, F.col("kpi_idx") - FAR)).alias("best"),
        F.min(place).alias("place"),
    )
    first = F.coalesce(F.col("place"), F.col("best.kpi_idx"))
    return kept.select(F.col("best").withField("kpi_idx", first).alias("best")).select("best.*")
