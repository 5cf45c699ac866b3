"""Running the specs of a plan against a workspace."""

from __future__ import annotations

from functools import cache as cache_of
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import data_columns, union_all
from ..functions.names import resolve_columns
from ..operators.facts import FACTS, fact_measure, fact_rows, finish_facts
from ..operators.groups import GroupCache, NotComputable
from ..operators.kpi import finish_kpis, kpi_rows, plan_kpis, want_groups
from ..operators.series import line_mode, plan_series, series_rows, table_rows
from ..operators.templates import fill_template, is_unfilled

# The sheet name of a spec without data, and the kinds of output.
NO_SHEET = "none"
CHARTS = ("bar", "pie", "line")
TABLE, TEXT = "table", "text"

OK, UNFILLED = "ok", "unfilled"

STATUS_SCHEMA = (
    "spec_id string, title string, source_sheet string, chart_type string, "
    "rendered_as string, status string, matched array<string>, unmatched array<string>, "
    "insight_text string"
)
SERIES_SCHEMA = (
    "spec_id string, ord bigint, category string, series_idx int, series string, value double"
)
TABLE_SCHEMA = "spec_id string, ord bigint, names array<string>, cells array<string>"


class UnfilledTemplate(ValueError):
    """A text still holds a placeholder, in strict mode."""


class Run:
    """The results of a run, each a lazy frame keyed by ``spec_id`` and built when it is
    first asked for."""

    def __init__(self, spark: SparkSession, planned: list["_Spec"], tables: dict, cache: GroupCache):
        self._spark, self._planned, self._tables, self._groups = spark, planned, tables, cache

    @cached_property
    def facts(self) -> DataFrame:
        """One row per spec with matched columns: the eleven facts and their numbers."""
        asked: dict[tuple, dict] = {}
        for p in self._planned:
            if p.fact:
                category, measure = p.fact
                asked.setdefault((p.sheet, category), {}).setdefault(measure, []).append(p.id)
        if asked:
            parts = [
                fact_rows(self._groups.get(self._tables[sheet], sheet, category), measures)
                for (sheet, category), measures in asked.items()
            ]
            return finish_facts(parts)
        names = ["spec_id", *FACTS]
        return self._spark.createDataFrame([], ", ".join(f"{n} string" for n in names))

    @cached_property
    def status(self) -> DataFrame:
        """One row per spec: how it came out, why, and its filled text."""
        static = self._spark.createDataFrame([p.row() for p in self._planned], STATUS_SCHEMA)
        filled = fill_template(static, self.facts)
        unfilled = is_unfilled(F.col("insight_text"))
        return filled.withColumn("status", F.when(unfilled, F.lit(UNFILLED)).otherwise(F.col("status")))

    @cached_property
    def kpis(self) -> DataFrame:
        by_table: dict[str, list] = {}
        for p in self._planned:
            by_table.setdefault(p.sheet, []).extend((p.id, *k) for k in p.kpis)
        frames = [
            frame
            for sheet, entries in by_table.items()
            if entries
            for frame in kpi_rows(self._tables[sheet], sheet, entries, self._groups)
        ]
        return finish_kpis(frames, self._spark)

    @cached_property
    def series(self) -> DataFrame:
        planned = [(p.id, p.sheet, p.df, p.series) for p in self._planned if p.series]
        return self._union(SERIES_SCHEMA, series_rows(planned, self._groups))

    @cached_property
    def tables(self) -> DataFrame:
        shown: dict[tuple, list[str]] = {}
        for p in self._planned:
            if p.rendered == TABLE:
                shown.setdefault((p.sheet, *p.matched), []).append(p.id)
        frames = [table_rows(self._tables[t], columns, *ids) for (t, *columns), ids in shown.items()]
        return self._union(TABLE_SCHEMA, frames)

    def _union(self, schema: str, frames: list[DataFrame]) -> DataFrame:
        return union_all(frames) if frames else self._spark.createDataFrame([], schema)

    def frames(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in ("status", "kpis", "facts", "series", "tables")}

    def release(self) -> None:
        """Drop the groupings kept for the results."""
        self._groups.release()


class _Spec:
    """What the schemas say about one spec, before anything is computed."""

    def __init__(self, spec_id: str, spec: dict, tables: dict, is_empty, is_long):
        self.id, self.spec = spec_id, spec
        self.sheet = spec.get("source_sheet") or NO_SHEET
        self.chart_type = (spec.get("chart_type") or TEXT).lower().strip()
        self.matched, self.unmatched = [], []
        self.df = self.fact = self.series = None
        self.kpis = []
        self.rendered, self.status = TEXT, OK
        wants_data = self.sheet.lower() != NO_SHEET
        if wants_data:
            self._find(tables, is_empty)
        if self.matched:
            self._plan_facts()
        if wants_data and self.status == OK and self.chart_type != TEXT:
            self._plan_output(is_long)

    def _find(self, tables: dict, is_empty) -> None:
        df = tables.get(self.sheet)
        if df is None:
            self.status = "fallback: no such table"
        elif is_empty(self.sheet):
            self.status = "fallback: empty table"
        else:
            requested = self.spec.get("data_columns") or []
            requested = [requested] if isinstance(requested, str) else requested
            requested = [str(c) for c in requested if c is not None]
            self.matched, self.unmatched = resolve_columns(requested, data_columns(df))
            self.df = df
            if not self.matched:
                self.status = "fallback: no matching column"

    def _plan_facts(self) -> None:
        try:
            self.fact = fact_measure(self.df, self.matched)
        except NotComputable:
            self.fact = None

    def _plan_output(self, is_long) -> None:
        try:
            if self.chart_type in CHARTS:
                self.series = plan_series(self.df, self.matched, self.chart_type, is_long)
            elif self.chart_type == TABLE:
                if len(set(self.matched)) < len(self.matched):
                    raise NotComputable("duplicate column")
            else:
                return
        except NotComputable as reason:
            self.status = f"fallback: {reason}"
            return
        self.rendered = self.chart_type
        self.kpis = plan_kpis(self.df, self.spec.get("kpis") or [])

    def want(self, cache: GroupCache) -> None:
        if self.fact:
            cache.want(self.sheet, *self.fact)
        if self.series:
            for _, measure in self.series.measures:
                cache.want(self.sheet, self.series.category, measure)
        want_groups(cache, self.sheet, self.kpis)

    def row(self) -> tuple:
        s = self.spec
        return (
            self.id,
            s.get("title"),
            self.sheet,
            self.chart_type,
            self.rendered,
            self.status,
            self.matched,
            self.unmatched,
            s.get("insight_text"),
        )


def collect_specs(specs: DataFrame) -> list[dict]:
    """The valid specs of one plan, in plan order; a plan is a text that someone wrote."""
    rows = specs.where(F.col("status") == OK).orderBy("spec_idx").collect()
    return [r.asDict(recursive=True) for r in rows]


def run_specs(
    specs: DataFrame | list[dict],
    tables: dict[str, DataFrame],
    strict: bool = False,
    keep_groups: bool = True,
    line: str = "auto",
) -> Run:
    """Compute KPIs, facts, filled texts, series and tables of all specs.

    Everything that can go wrong with a spec is decided from the schemas first, so one
    bad spec becomes a text with a reason and never stops the others. Results of the same
    table that share a category share one group-by, persisted until ``release`` so that
    the frames of the run share it too; without ``keep_groups`` only parts of one frame do.
    ``line`` is what line charts show: ``rows``, the ``mean`` per category, or by the size of
    the table (``auto``).
    """
    listed = collect_specs(specs) if isinstance(specs, DataFrame) else specs
    if not tables:
        raise ValueError("no tables")
    spark = next(iter(tables.values())).sparkSession
    # Asked once for each table, however many specs name it.
    is_empty = cache_of(lambda name: tables[name].isEmpty())
    long_line = cache_of(line_mode(line))
    planned = [_Spec(str(i), s, tables, is_empty, long_line) for i, s in enumerate(listed)]
    cache = GroupCache(keep=keep_groups)
    for p in planned:
        p.want(cache)

    run = Run(spark, planned, tables, cache)
    if strict:
        left = [r["spec_id"] for r in run.status.where(F.col("status") == UNFILLED).collect()]
        if left:
            run.release()
            raise UnfilledTemplate(f"unfilled placeholder in spec {', '.join(sorted(left))}")
    return run
