"""Plan texts to validated specs: one row per spec, problems as a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import data_columns, local_frame
from ..functions.names import match_key

# The vocabulary of a plan and the fences it may be wrapped in.
CHART_TYPES = ["bar", "pie", "line", "table", "text"]
REQUIRED_KEYS = ["title", "source_sheet", "chart_type", "data_columns", "insight_text"]
KPI_FIELDS = [
    "label",
    "type",
    "group_by",
    "value_col",
    "agg",
    "which",
    "filter_col",
    "filter_contains",
    "x_col",
]
OPENING_FENCE = r"^```(?:json)?\s*\n?"
CLOSING_FENCE = r"\n?```\s*$"

KPI_TYPE = "array<struct<" + ",".join(f"{f}:string" for f in KPI_FIELDS) + ">>"

OK = "ok"
BAD_JSON = "error: not JSON"
NOT_A_LIST = "error: no list of specs"
NOT_AN_OBJECT = "error: not an object"
MISSING_KEYS = "error: missing keys: "
BAD_CHART_TYPE = "error: unknown chart type"
REJECTED = "error: another spec of the plan is invalid"


WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def strip_fences(text: Column) -> Column:
    """The text without a code fence around it and without outer whitespace."""
    opened = F.regexp_replace(strip(text), OPENING_FENCE, "")
    return strip(F.regexp_replace(opened, CLOSING_FENCE, ""))


def _get(v: Column, as_type: str) -> Column:
    """The variant as a type, null where it is something else."""
    return F.try_variant_get(v, "$", as_type)


def _members(v: Column, names: list[str]) -> Column:
    """The members of an object in one cast. A missing one is null; one that is a JSON
    null is not, so presence and value stay apart."""
    return _get(v, "struct<" + ",".join(f"`{n}`:variant" for n in names) + ">")


SPEC_KEYS = [*REQUIRED_KEYS, "kpis"]


def _kpis(kpis: Column) -> Column:
    """The well-formed KPI objects of a spec; anything but a list counts as none."""
    objects = F.transform(_get(kpis, "array<variant>"), lambda v: _members(v, KPI_FIELDS))
    named = F.filter(objects, lambda k: k["label"].isNotNull() & k["type"].isNotNull())
    texts = F.transform(
        named, lambda k: F.struct(*[_get(k[f], "string").alias(f) for f in KPI_FIELDS])
    )
    return F.coalesce(texts, F.array().cast(KPI_TYPE))


def _data_columns(columns: Column) -> Column:
    """A list as texts, a single value as a list of one."""
    texts = F.transform(_get(columns, "array<variant>"), lambda v: _get(v, "string"))
    single = _get(columns, "string")
    return F.coalesce(texts, F.when(single.isNotNull(), F.array(single)))


def _chart_type(members: Column) -> Column:
    return F.lower(strip(_get(members["chart_type"], "string")))


def _status(members: Column, chart_type: Column) -> Column:
    absent = [F.when(members[k].isNull(), F.lit(k)) for k in sorted(REQUIRED_KEYS)]
    missing = F.concat_ws(", ", *absent)
    known = F.coalesce(chart_type.isin(CHART_TYPES), F.lit(False))
    return (
        F.when(members.isNull(), F.lit(NOT_AN_OBJECT))
        .when(missing != "", F.concat(F.lit(MISSING_KEYS), missing))
        .when(~known, F.lit(BAD_CHART_TYPE))
        .otherwise(F.lit(OK))
    )


def _is_invalid(spec: Column) -> Column:
    members = _members(spec, SPEC_KEYS)
    return _status(members, _chart_type(members)) != OK


def parse_specs(plans: DataFrame, id_col: str, text_col: str, strict: bool = False) -> DataFrame:
    """Specs of many plan texts: ``plan_id, spec_idx, status, title, source_sheet,
    chart_type, data_columns, insight_text, kpis``.

    A plan is a list of specs or an object holding one under ``slides``. A plan that is
    neither gives one row without ``spec_idx``. With ``strict`` one invalid spec rejects
    its whole plan. Everything happens within the row of a plan: no shuffle.
    """
    document = F.try_parse_json(strip_fences(F.col(text_col)))
    parsed = plans.select(F.col(id_col).alias("plan_id"), document.alias("doc"))
    slides = F.try_variant_get("doc", "$.slides", "variant")
    rows = parsed.select("plan_id", "doc", slides.alias("slides"))
    listed = F.when(F.col("slides").isNotNull(), _get(F.col("slides"), "array<variant>")).otherwise(
        _get(F.col("doc"), "array<variant>")
    )
    rows = rows.select("plan_id", F.col("doc").isNull().alias("bad"), listed.alias("specs"))
    problem = F.when(F.col("bad"), F.lit(BAD_JSON)).when(F.col("specs").isNull(), F.lit(NOT_A_LIST))
    rows = rows.select("plan_id", problem.alias("problem"), "specs")
    rejected = F.exists("specs", _is_invalid) if strict else F.lit(False)
    exploded = rows.select(
        "plan_id", "problem", rejected.alias("rejected"), F.posexplode_outer("specs").alias("spec_idx", "spec")
    )
    # An empty list is a valid plan without specs; only broken plans keep an empty row.
    # Asked after the explode, so that the test cannot move below the JSON parser and
    # run it twice.
    exploded = exploded.where(F.col("spec_idx").isNotNull() | F.col("problem").isNotNull())
    members = exploded.select(
        "plan_id", "problem", "rejected", "spec_idx", _members(F.col("spec"), SPEC_KEYS).alias("m")
    )
    m = F.col("m")
    typed = members.select("*", _chart_type(m).alias("chart_type"))
    status = F.coalesce("problem", _status(m, F.col("chart_type")))
    status = F.when((status == OK) & F.col("rejected"), F.lit(REJECTED)).otherwise(status)
    return typed.select(
        "plan_id",
        "spec_idx",
        status.alias("status"),
        _get(m["title"], "string").alias("title"),
        _get(m["source_sheet"], "string").alias("source_sheet"),
        "chart_type",
        _data_columns(m["data_columns"]).alias("data_columns"),
        _get(m["insight_text"], "string").alias("insight_text"),
        F.when(F.col("spec_idx").isNotNull(), _kpis(m["kpis"])).alias("kpis"),
    )


def catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """``table, ordinal, column`` of all tables, from their schemas."""
    rows = [(t, i, c) for t, df in tables.items() for i, c in enumerate(data_columns(df))]
    spark = next(iter(tables.values())).sparkSession
    return local_frame(spark, rows, "table string, ordinal int, column string")


def resolve_requests(requests: DataFrame, names: DataFrame) -> DataFrame:
    """Add ``matched`` to requests ``(…, table, requested)`` from a catalog ``(table,
    ordinal, column)``; null where nothing matches. The join is an ordinary one on table
    and name key, so Spark broadcasts the catalog only while it is small."""
    known = names.groupBy("table", match_key(F.col("column")).alias("name_key")).agg(
        F.min_by("column", "ordinal").alias("matched")
    )
    keyed = requests.withColumn("name_key", match_key(F.col("requested")))
    return keyed.join(known, ["table", "name_key"], "left").drop("name_key")
