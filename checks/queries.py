"""One query per operator, each over whole tables or data derived from them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefacts.functions.columns import ROW
from tablefacts.functions.formats import fact_text, four_digits, iso_text, plain_text, single_value_text
from tablefacts.operators import profile as P
from tablefacts.operators.facts import category_totals, insight_facts, pick_roles
from tablefacts.operators.kpi import compute_kpis
from tablefacts.operators.series import chart_series, table_cells, table_extract
from tablefacts.operators.templates import fill_template, unfilled
from tablefacts.plans.run import Run, run_specs
from tablefacts.plans.specs import catalog, parse_specs, resolve_requests, strip_fences
from tablefacts.session import shared_folder
from tablefacts.sources.cleanup import (
    clean_table,
    drop_empty_columns,
    drop_empty_rows,
    is_empty_table,
    normalize_missing,
    rename_clean,
    validate_workspace,
)
from tablefacts.sources.grid import (
    detect_header,
    grid_to_table,
    head_rows,
    load_grid,
    promote_header,
)
from tablefacts.sources.refresh import refresh_profile
from tablefacts.sources.workspace import load_workspace

TABLES = [
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: read(spark, sf_dir, n) for n in TABLES}


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Doubles cut to four digits: two engines may differ in the last bit of a sum."""
    return df.withColumns({n: four_digits(F.col(n)) for n in names})


def union(frames: list[DataFrame]) -> DataFrame:
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame)
    return rows


# ---- sources and cleanup ---------------------------------------------------------


def load_tables(spark, sf_dir):
    """Every table of the folder, found by listing it, with its row count."""
    tables = load_workspace(spark, sf_dir)
    return union(
        [
            df.agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"))
            for n, df in tables.items()
        ]
    )


def load_text_grid(spark, sf_dir):
    """The customers written as delimited lines and read back as a raw grid."""
    folder = f"{shared_folder(spark)}/customer.csv"
    read(spark, sf_dir, "customer").write.csv(folder)
    grid = load_grid(spark, folder)
    return grid.select(
        F.size("cells").alias("width"),
        F.get("cells", F.lit(1)).alias("name"),
        F.get("cells", F.lit(4)).alias("segment"),
    )


def load_text_table(spark, sf_dir):
    """The orders written as text with a header, found, named and typed again."""
    folder = shared_folder(spark)
    orders = read(spark, sf_dir, "orders")
    dated = orders.withColumn("o_orderdate", F.date_format("o_orderdate", "MM/dd/yyyy"))
    dated.write.option("header", True).csv(f"{folder}/orders.csv")
    return load_workspace(spark, folder)["orders"]


def load_json_table(spark, sf_dir):
    folder = shared_folder(spark)
    read(spark, sf_dir, "supplier").write.json(f"{folder}/supplier.json")
    return load_workspace(spark, folder)["supplier"]


def load_titled_files(spark, sf_dir):
    """The orders as many text files, each with a title row and a header above its rows."""
    folder = shared_folder(spark)
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    part = F.floor(F.col("o_orderkey") / 10000).alias("part")
    lines = orders.select(part, F.col("o_orderkey").alias("place"), F.concat_ws(",", *orders.columns).alias("line"))
    parts = lines.select("part").distinct()
    title = parts.select("part", F.lit(-2).cast("bigint").alias("place"), F.format_string("Report %d", "part").alias("line"))
    header = parts.select("part", F.lit(-1).cast("bigint").alias("place"), F.lit(",".join(orders.columns)).alias("line"))
    ordered = union([lines, title, header]).repartition("part").sortWithinPartitions("part", "place")
    ordered.select("part", "line").write.partitionBy("part").text(f"{folder}/orders.csv")
    return load_workspace(spark, folder)["orders"]


def load_multiline_cells(spark, sf_dir):
    """The documents as delimited text whose quoted cells hold line breaks and quotes."""
    folder = shared_folder(spark)
    body = F.concat(F.lit('"'), F.col("source"), F.lit('",\n'), F.regexp_replace("text", r"\r", " "), F.lit("\nend"))
    documents = read(spark, sf_dir, "documents").select("doc_id", body.alias("body"))
    documents.write.option("header", True).option("escape", '"').csv(f"{folder}/documents.csv")
    table = load_workspace(spark, folder, multiline=["documents"])["documents"]
    return table.select("doc_id", F.md5("body").alias("digest"))


def load_compressed(spark, sf_dir):
    """The suppliers as a folder of compressed text files without a suffix of its own."""
    folder = shared_folder(spark)
    read(spark, sf_dir, "supplier").write.option("header", True).option("compression", "gzip").csv(f"{folder}/supplier")
    return load_workspace(spark, folder)["supplier"]


def load_long_ids(spark, sf_dir):
    """Customers under ids of 25 digits, read back from text digit by digit."""
    folder = shared_folder(spark)
    wide = F.lit("1234567890123456789000000").cast("decimal(38,0)") + F.col("c_custkey")
    customers = read(spark, sf_dir, "customer").select(wide.alias("id"), "c_name")
    customers.write.option("header", True).csv(f"{folder}/customer.csv")
    return load_workspace(spark, folder)["customer"]


def missing_values(spark, sf_dir):
    """Texts that mean "missing" and NaN, put into the events and normalised away."""
    kind = (
        F.when(F.col("event_type") == "click", F.lit("N/A"))
        .when(F.col("event_type") == "error", F.lit(""))
        .otherwise(F.col("event_type"))
    )
    value = F.when(F.col("value") > 20, F.lit(float("nan"))).otherwise(F.col("value"))
    events = read(spark, sf_dir, "events").select("event_id", kind.alias("kind"), value.alias("value"))
    return normalize_missing(events, text_source=True)


def _blank(df: DataFrame, keep: Column) -> DataFrame:
    return df.select(*[F.when(keep, F.col(c)).alias(c) for c in df.columns])


def empty_tables(spark, sf_dir):
    """Every table, and a copy of it with all values blanked, tested for emptiness."""
    rows = []
    for name, df in workspace(spark, sf_dir).items():
        rows.append((name, is_empty_table(df)))
        never = F.col(df.columns[0]).isNull()
        rows.append((f"{name} blanked", is_empty_table(_blank(df, never))))
    return spark.createDataFrame(rows, "table string, is_empty boolean")


def _segment_grid(spark, sf_dir) -> DataFrame:
    """One text grid per market segment: two rows above the header, then its customers."""
    customers = read(spark, sf_dir, "customer")
    row = F.array(*[F.col(c).cast("string") for c in ("c_name", "c_nationkey", "c_acctbal")])
    blank = F.lit(None).cast("string")
    body = customers.select(
        F.col("c_mktsegment").alias("source"), (F.col("c_custkey") + 3).alias("row_idx"), row.alias("cells")
    )
    top = customers.select(F.col("c_mktsegment").alias("source")).distinct()
    above = [
        F.array(blank, blank, blank),
        F.array(F.col("source"), blank, blank),
        F.array(F.lit("Name"), F.lit("Nation"), F.lit("Balance")),
    ]
    heads = [
        top.select("source", F.lit(i).cast("bigint").alias("row_idx"), cells.alias("cells"))
        for i, cells in enumerate(above)
    ]
    return union([body, *heads])


def header_detect(spark, sf_dir):
    found = detect_header(head_rows(_segment_grid(spark, sf_dir)))
    return found.select("source", "header_row", "score", F.array_join("header", "|").alias("header"))


def header_detect_off(spark, sf_dir):
    found = detect_header(head_rows(_segment_grid(spark, sf_dir)), max_scan=1)
    return found.select("source", "header_row", "score")


def header_promote(spark, sf_dir):
    """The grids of all segments, each below its own header."""
    grid = _segment_grid(spark, sf_dir)
    return promote_header(grid, 2, ["Name", "Nation", "Balance"]).drop(ROW)


def grid_table(spark, sf_dir):
    """All customers as one text grid with an empty and an unnamed column, made a table."""
    customers = read(spark, sf_dir, "customer")
    blank = F.lit(None).cast("string")
    cells = [F.col(c).cast("string") for c in ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")]
    even = F.when(F.col("c_acctbal") >= 0, F.lit("true")).otherwise(F.lit("false"))
    grid = customers.select(
        F.lit("customer").alias("source"),
        (F.col("c_custkey") + 1).alias("row_idx"),
        F.array(cells[0], blank, cells[1], cells[2], cells[3], even).alias("cells"),
    )
    return grid_to_table(grid, [" Name ", "Blank", "Nation", "Balance", None, "Name"]).drop(ROW)


def empty_rows(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return drop_empty_rows(_blank(orders, F.col("o_orderstatus") != "F")).select(
        "o_orderkey", "o_orderstatus", "o_totalprice"
    )


def empty_columns(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    blanked = orders.withColumn("o_custkey", F.nullif(F.col("o_custkey"), F.col("o_custkey")))
    return drop_empty_columns(blanked)


def column_names(spark, sf_dir):
    """Suppliers under messy names: padded, unnamed, and equal ignoring case."""
    suppliers = read(spark, sf_dir, "supplier")
    return rename_clean(suppliers.toDF(" Key ", "Unnamed: 1", "key", "Balance"))


def clean_all(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    blanked = _blank(parts, F.col("p_type") != "PROMO").withColumn(
        "p_brand", F.nullif(F.col("p_brand"), F.col("p_brand"))
    )
    return clean_table(blanked.toDF(" p_partkey", "p_brand", "Unnamed: 2", "p_retailprice "))


def workspace_gate(spark, sf_dir):
    return validate_workspace(P.profile_workspace(workspace(spark, sf_dir)))


# ---- types -----------------------------------------------------------------------


def _dated_orders(spark, sf_dir) -> DataFrame:
    day = F.date_format("o_orderdate", "MM/dd/yyyy")
    return read(spark, sf_dir, "orders").select(
        "*",
        day.alias("us_date"),
        F.when(F.col("o_orderstatus") != "F", day).otherwise(F.lit("open")).alias("mixed"),
        F.when(F.col("o_orderstatus") == "P", day).otherwise(F.lit("none")).alias("rarely"),
    )


def type_labels(spark, sf_dir):
    orders = _dated_orders(spark, sf_dir).withColumn("urgent", F.col("o_orderpriority") == "1-URGENT")
    return P.infer_types(orders).select("column", "label")


def datetime_share(spark, sf_dir):
    formats = {c: "M/d/yyyy" for c in ("us_date", "mixed", "rarely", "o_orderstatus")}
    ratio = P.datetime_ratio(_dated_orders(spark, sf_dir), formats)
    return ratio.select("column", "non_null", "parsed", "ratio", "is_datetime")


# ---- profiles --------------------------------------------------------------------


def numeric_profile(spark, sf_dir):
    return P.profile_numeric(read(spark, sf_dir, "lineitem")).drop("note")


def medians(spark, sf_dir):
    """Medians alone, with the missing values of a filtered column."""
    items = read(spark, sf_dir, "lineitem").select(
        "l_extendedprice", F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).alias("returned")
    )
    return P.profile_numeric(items).select("column", "non_null", "median")


def missing_share(spark, sf_dir):
    events = read(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("value") <= 20, F.col("value")).alias("value")
    )
    return P.profile_numeric(events).select("column", "count", "non_null", "missing_pct", "sum", "mean")


def categorical_profile(spark, sf_dir):
    return P.profile_categorical(read(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


def long_text_profile(spark, sf_dir):
    """Documents and pages: long texts, counted by their first characters and a digest."""
    documents = P.profile_categorical(read(spark, sf_dir, "documents"), ["text", "lang", "source"])
    pages = P.profile_categorical(read(spark, sf_dir, "pages"), ["url", "html"])
    return union([documents, pages])


def frequent_values(spark, sf_dir):
    return P.top_values(read(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"])


def frequent_values_of_long_text(spark, sf_dir):
    """The whole documents that occur most often."""
    top = P.top_values(read(spark, sf_dir, "documents"), ["text"], n=10)
    return top.select("column", "rank", F.md5("value").alias("digest"), "count")


def identifiers(spark, sf_dir):
    customer = P.identifier_flags(read(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"])
    part = P.identifier_flags(read(spark, sf_dir, "part"), ["p_name", "p_brand"])
    return union([customer, part])


def suppressed_values(spark, sf_dir):
    profile = P.profile_table(read(spark, sf_dir, "customer"), "customer")
    return profile.where(F.col("identifier_like").isNotNull()).select(
        "column",
        "identifier_like",
        F.posexplode_outer("top_values").alias("position", "top"),
    ).select("column", "identifier_like", "position", "top.value", "top.count")


def datetime_profile(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").select("l_shipdate")
    events = read(spark, sf_dir, "events").select("ts")
    return union([P.profile_datetime(items), P.profile_datetime(events)]).drop("note")


def inferred_datetime_profile(spark, sf_dir):
    orders = _dated_orders(spark, sf_dir).select("us_date", "mixed", "rarely")
    return P.profile_table(orders).select(
        "column", "label", "count", "non_null", "missing_pct", "min_date", "max_date", "date_range_days", "unique_values"
    )


def boolean_profile(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").alias("returned"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity") > 40).alias("large_open"),
    )
    return P.profile_boolean(items).drop("note")


def all_missing_profile(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    orders = orders.withColumn("flag", F.col("o_custkey") > 5)
    blanked = orders.select(*[F.nullif(F.col(c), F.col(c)).alias(c) for c in orders.columns])
    return P.profile_table(blanked).select("column", "label", "row_count", "count", "non_null", "missing_pct", "note")


def table_profile(spark, sf_dir):
    return P.profile_table(read(spark, sf_dir, "orders"), "orders").drop(
        "ordinal", "int_sum", "int_min", "int_max", "true_count", "false_count", "true_pct", "top_values", "note"
    )


def empty_table_profile(spark, sf_dir):
    nothing = read(spark, sf_dir, "orders").where(F.col("o_totalprice") < 0)
    return P.profile_table(nothing, "nothing").select("table", "row_count", "column_count", "column", "note")


def workspace_profile(spark, sf_dir):
    return P.profile_workspace(workspace(spark, sf_dir)).select(
        "table", "column", "label", "row_count", "column_count", "count", "non_null", "unique_values", "identifier_like"
    )


def refreshed_profile(spark, sf_dir):
    """The profile of orders that came in two landings; the second refresh reads the new files only."""
    folder, orders = shared_folder(spark), read(spark, sf_dir, "orders")
    done = F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))
    for part in (orders.where(done), orders.where(~done)):
        part.write.mode("append").parquet(f"{folder}/tables/orders")
        profile = refresh_profile(spark, f"{folder}/tables", f"{folder}/state")
    return profile.drop("ordinal", "int_sum", "int_min", "int_max", "true_count", "false_count", "true_pct", "top_values", "note")


def value_texts(spark, sf_dir):
    """Rounding to four digits and timestamps in ISO form, for every event."""
    return read(spark, sf_dir, "events").select(
        "event_id", four_digits(F.col("value") / 7).alias("seventh"), iso_text(F.col("ts")).alias("ts")
    )


def condensed_profile(spark, sf_dir):
    slim = P.condense(P.profile_table(read(spark, sf_dir, "orders"), "orders"))
    tops = F.array_join(F.transform("top_values", lambda t: F.concat_ws("=", t["value"], t["count"].cast("string"))), ",")
    return slim.select(
        "table", "row_count", "column", "type", "sum", "mean", "min_date", "max_date", "unique_values",
        tops.alias("top_values"), "identifier_like",
    )


def json_profile(spark, sf_dir):
    """Numbers read back from the emitted JSON documents of two tables."""
    tables = {n: read(spark, sf_dir, n) for n in ("customer", "part")}
    docs = P.profile_to_json(P.profile_workspace(tables))

    def at(path: str) -> Column:
        return F.get_json_object("json", path)

    return docs.select(
        "table",
        at("$.row_count").alias("rows"),
        at("$.column_count").alias("columns"),
        at("$.columns.c_custkey.sum").alias("key_sum"),
        at("$.columns.c_name.identifier_like").alias("name_flag"),
        at("$.columns.c_name.top_values").alias("name_values"),
        at("$.columns.p_type.top_values.PROMO").alias("promo"),
        at("$.columns.p_size.inferred_type").alias("size_type"),
    )


def identifier_guard(spark, sf_dir):
    """A spec per customer, asking for an identifier column that must not be charted."""
    customers = read(spark, sf_dir, "customer")
    specs = customers.select(
        F.col("c_custkey").alias("spec_id"),
        F.when(F.col("c_acctbal") >= 0, F.lit("customer")).otherwise(F.lit("elsewhere")).alias("source_sheet"),
        F.array(F.lit("C_Name "), F.col("c_mktsegment"), F.lit("c_mktsegment")).alias("data_columns"),
    )
    kept = P.drop_identifier_columns(specs, P.profile_table(customers, "customer"))
    return kept.select("spec_id", F.array_join("data_columns", ",").alias("data_columns"))


# ---- specs -----------------------------------------------------------------------


def fence_strip(spark, sf_dir):
    """Every document inside a code fence, and what is left without it."""
    fenced = F.concat(F.lit(" \n```json\n"), F.lit("["), F.col("text"), F.lit("]"), F.lit("\n```\n "))
    stripped = strip_fences(fenced)
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(stripped).alias("digest"))


def _plans(spark, sf_dir) -> DataFrame:
    """One plan text per event, valid or broken in a way that depends on the event."""
    events = read(spark, sf_dir, "events")
    kind, name = F.col("event_type"), F.concat(F.lit("E"), F.col("event_id").cast("string"))
    spec = F.to_json(
        F.struct(
            name.alias("title"),
            F.lit("events").alias("source_sheet"),
            F.when(F.col("value") > 20, F.lit(" BAR ")).when(F.col("value") > 5, F.lit("Line")).otherwise(F.lit("radar")).alias("chart_type"),
            F.array(F.lit("event_type"), kind).alias("data_columns"),
            F.lit("{{TOP_VALUE}}").alias("insight_text"),
            F.array(F.struct(F.lit("K").alias("label"), F.lit("peak_point").alias("type"), kind.alias("x_col"))).alias("kpis"),
        )
    )
    short = F.to_json(F.struct(name.alias("title"), F.lit("text").alias("chart_type")))
    text = (
        F.when(kind == "click", F.concat(F.lit("```json\n["), spec, F.lit("]\n```")))
        .when(kind == "view", F.concat(F.lit('{"slides": ['), spec, F.lit(", "), short, F.lit("]}")))
        .when(kind == "error", F.concat(F.lit("["), spec))
        .when(kind == "purchase", F.concat(F.lit('{"other": '), spec, F.lit("}")))
        .otherwise(F.concat(F.lit("["), spec, F.lit(", 7]")))
    )
    return events.select("event_id", text.alias("body"))


def _parsed(specs: DataFrame) -> DataFrame:
    return specs.select(
        "plan_id",
        F.col("spec_idx").cast("bigint").alias("spec_idx"),
        "status",
        "title",
        "chart_type",
        F.array_join("data_columns", ",").alias("data_columns"),
        F.size("kpis").cast("bigint").alias("n_kpis"),
        F.get("kpis", F.lit(0))["x_col"].alias("x_col"),
    )


def spec_parse(spark, sf_dir):
    return _parsed(parse_specs(_plans(spark, sf_dir), "event_id", "body"))


def spec_parse_strict(spark, sf_dir):
    return _parsed(parse_specs(_plans(spark, sf_dir), "event_id", "body", strict=True)).select(
        "plan_id", "spec_idx", "status"
    )


def _part_plans(spark, sf_dir, fields: list[Column]) -> DataFrame:
    """One plan of one spec per part; ``fields`` are JSON members after the title."""
    member = F.concat(F.lit('"title": "'), F.col("p_name"), F.lit('"'))
    body = F.concat(F.lit("[{"), F.concat_ws(", ", member, *fields), F.lit("}]"))
    return read(spark, sf_dir, "part").select("p_partkey", body.alias("body"))



def spec_required_keys(spark, sf_dir):
    """Members left out depending on the size of the part."""
    size = F.col("p_size")
    fields = [
        F.when(size > 10, F.lit('"source_sheet": "part"')),
        F.when(size > 20, F.lit('"chart_type": "bar"')),
        F.when(size > 30, F.lit('"data_columns": []')),
        F.lit('"insight_text": "t"'),
    ]
    specs = parse_specs(_part_plans(spark, sf_dir, fields), "p_partkey", "body")
    return specs.select("plan_id", "status")


def spec_kpis(spark, sf_dir):
    """KPI lists in all shapes, depending on the type of the part."""
    good = '{"label": "A", "type": "avg_per_group"}'
    kind = F.col("p_type")
    kpis = (
        F.when(kind == "ECONOMY", F.lit(f'"kpis": [{good}, {{"label": "B"}}, 5, {good}]'))
        .when(kind == "STANDARD", F.lit('"kpis": {"label": "A"}'))
        .when(kind == "PROMO", F.lit('"kpis": "none"'))
        .when(kind == "SMALL", F.lit('"kpis": []'))
        .when(kind == "LARGE", F.lit(f'"kpis": [{good}]'))
    )
    fields = [F.lit(m) for m in ('"source_sheet": "part"', '"insight_text": "t"', '"chart_type": "pie"', '"data_columns": []')]
    specs = parse_specs(_part_plans(spark, sf_dir, [*fields, kpis]), "p_partkey", "body")
    return specs.select("plan_id", "status", F.size("kpis").cast("bigint").alias("n_kpis"))


def spec_chart_type(spark, sf_dir):
    """Chart types in any case and padding, and unknown ones."""
    kind = F.col("p_type")
    name = (
        F.when(kind == "ECONOMY", F.lit(" Bar"))
        .when(kind == "STANDARD", F.lit("PIE "))
        .when(kind == "PROMO", F.lit("table"))
        .otherwise(F.lower(kind))
    )
    fields = [F.lit(m) for m in ('"source_sheet": "part"', '"insight_text": "t"', '"data_columns": []')]
    member = F.concat(F.lit('"chart_type": "'), name, F.lit('"'))
    specs = parse_specs(_part_plans(spark, sf_dir, [*fields, member]), "p_partkey", "body")
    return specs.select("plan_id", "status", "chart_type")


def spec_data_columns(spark, sf_dir):
    """Column lists and single columns."""
    brand = F.concat(F.lit('"'), F.col("p_brand"), F.lit('"'))
    columns = F.when(F.col("p_size") > 25, brand).otherwise(F.concat(F.lit("["), brand, F.lit(', "p_size"]')))
    fields = [F.lit(m) for m in ('"source_sheet": "part"', '"insight_text": "t"', '"chart_type": "pie"')]
    member = F.concat(F.lit('"data_columns": '), columns)
    specs = parse_specs(_part_plans(spark, sf_dir, [*fields, member]), "p_partkey", "body")
    return specs.select("plan_id", F.array_join("data_columns", ",").alias("data_columns"))


def column_resolution(spark, sf_dir):
    """A column request per order, in free spelling, matched against all schemas."""
    spelled = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(" O_TotalPrice"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.lit("o_order\tdate "))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("o order key"))
        .otherwise(F.col("o_orderpriority"))
    )
    requests = read(spark, sf_dir, "orders").select(
        "o_orderkey", F.lit("orders").alias("table"), spelled.alias("requested")
    )
    return resolve_requests(requests, catalog(workspace(spark, sf_dir))).select("o_orderkey", "requested", "matched")


# ---- KPIs ------------------------------------------------------------------------


def kpis(table: str, *specs: dict):
    def query(spark, sf_dir):
        rows = compute_kpis(read(spark, sf_dir, table), list(specs))
        return rounded(rows, "value").drop("spec_id", "kpi_idx")

    return query


def extreme(label, by, value, agg="sum", which="max"):
    return {"label": label, "type": "extreme_category", "group_by": by, "value_col": value, "agg": agg, "which": which}


def average(label, by, value, agg="sum"):
    return {"label": label, "type": "avg_per_group", "group_by": by, "value_col": value, "agg": agg}


def rate(label, column, pattern):
    return {"label": label, "type": "filtered_rate", "filter_col": column, "filter_contains": pattern}


def matching_sum(label, column, pattern, value):
    return {
        "label": label, "type": "filtered_sum", "filter_col": column, "filter_contains": pattern, "value_col": value,
    }


def peak(label, x, value):
    return {"label": label, "type": "peak_point", "x_col": x, "value_col": value}


KPI_RULES = [
    rate("Urgent", "O_OrderPriority", "URGENT"),
    matching_sum("Urgent", "o_orderpriority", "urgent", "o_total price"),
    extreme("Broken", "o_orderpriority", "no such column"),
    rate("Fourth", "o_orderpriority", "low"),
]
KPI_FAILURES = [
    {"label": "Unknown", "type": "median_per_group"},
    rate("Pattern", "o_orderpriority", "(unclosed"),
    rate("Not text", "o_totalprice", "1"),
]


def datetime_any_order(spark, sf_dir):
    """Dates in two formats, profiled in either order of the rows: one answer."""
    day = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 10 == 0, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "MM/dd/yyyy"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", text.alias("day"))
    frames = []
    for name, order in (("up", F.col("o_orderkey") % 10), ("down", -(F.col("o_orderkey") % 10))):
        profile = P.profile_table(rows.orderBy(order).select("day"))
        frames.append(profile.select(F.lit(name).alias("sorted"), "label", "non_null", "min_date"))
    return union(frames)


def datetime_zones(spark, sf_dir):
    """Times of events written with their zone."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    profile = P.profile_table(read(spark, sf_dir, "events").select(text.alias("time")))
    return profile.select("label", "non_null", "max_date")


def missing_kpis(spark, sf_dir):
    """KPIs over columns with missing values: null keys, and groups that are all null."""
    events = read(spark, sf_dir, "events").select(
        F.when(F.col("event_type") != "click", F.col("event_type")).alias("kind"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("value"),
        "ts",
    )
    specs = [
        extreme("Least", "kind", "value", "sum", "min"),
        extreme("Least mean", "kind", "value", "mean", "min"),
        average("Mean of sums", "kind", "value"),
    ]
    return rounded(compute_kpis(events, specs), "value").select("label", "key", "value", "formatted", "status")


def value_formats(spark, sf_dir):
    """KPI and fact texts of whole numbers, fractions and dates, for every line item."""
    items = read(spark, sf_dir, "lineitem")

    def both(name: str) -> list[Column]:
        dtype = items.schema[name].dataType
        return [
            single_value_text(F.col(name), dtype).alias(f"kpi_{name}"),
            fact_text(F.col(name), dtype).alias(f"fact_{name}"),
        ]

    return items.select(
        "l_orderkey", "l_linenumber", *both("l_extendedprice"), *both("l_quantity"), *both("l_partkey"),
        single_value_text(F.col("l_shipdate"), items.schema["l_shipdate"].dataType).alias("kpi_l_shipdate"),
        plain_text(F.col("l_extendedprice"), items.schema["l_extendedprice"].dataType).alias("plain"),
    )


# ---- facts and texts -------------------------------------------------------------


def facts(table: str, columns: list[str]):
    def query(spark, sf_dir):
        return insight_facts(read(spark, sf_dir, table), columns).drop(
            "spec_id", "top_number", "second_number", "bottom_number", "total_number", "mean_number", "count_number"
        )

    return query


def fact_numbers(spark, sf_dir):
    """Facts over a category with a great many values."""
    found = insight_facts(read(spark, sf_dir, "orders"), ["o_custkey", "o_totalprice"]).select(
        "top_category", "top_number", "second_category", "second_number", "bottom_category", "bottom_number",
        "total_number", "count_number",
    )
    return rounded(found, "top_number", "second_number", "bottom_number", "total_number")


def column_roles(spark, sf_dir):
    """Totals by the roles picked from a list with a text column before the number."""
    items = read(spark, sf_dir, "lineitem")
    category, value = pick_roles(items, ["l_returnflag", "l_linestatus", "l_quantity"])
    return rounded(category_totals(items, [category, value]), "value")


def totals_by_customer(spark, sf_dir):
    return rounded(category_totals(read(spark, sf_dir, "orders"), ["o_custkey", "o_totalprice"]), "value")


TEMPLATE = (
    "{{TOP_CATEGORY}} {{TOP_VALUE}} {{TOP_PCT}} | {{SECOND_CATEGORY}} {{SECOND_VALUE}} {{SECOND_PCT}} | "
    "{{BOTTOM_CATEGORY}} {{BOTTOM_VALUE}} | {{TOTAL_VALUE}} {{MEAN_VALUE}} {{COUNT}}"
)


def template_fill(spark, sf_dir):
    """One text per order of a customer, filled from the facts of its priority."""
    orders = read(spark, sf_dir, "orders")
    found = insight_facts(orders, ["o_orderpriority", "o_totalprice"], spec_id="1-URGENT")
    texts = orders.select(
        "o_orderkey",
        F.col("o_orderpriority").alias("spec_id"),
        F.concat(F.lit("{{COUNT}}: "), F.col("o_orderstatus"), F.lit(" " + TEMPLATE)).alias("insight_text"),
    )
    return fill_template(texts, found)


def template_leftovers(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations")
    text = F.when(F.col("role") == "user", F.concat("text", F.lit(" {{COUNT}}"))).otherwise(F.col("text"))
    return unfilled(turns.withColumn("text", text), "text").select("conv_id", "turn", F.md5("text").alias("digest"))


# ---- series and tables -----------------------------------------------------------


def series(table: str, columns: list[str], chart_type: str):
    def query(spark, sf_dir):
        points = chart_series(read(spark, sf_dir, table), columns, chart_type)
        return rounded(points, "value").select("category", "series", "value")

    return query


def line_means(spark, sf_dir):
    """A long line of daily means; the text column is left out. Whole cents keep the means
    the same to the last bit on any engine."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    orders = read(spark, sf_dir, "orders").select("o_orderdate", cents.alias("cents"), "o_orderstatus")
    return chart_series(orders, ["o_orderdate", "cents", "o_orderstatus"], "line").select("category", "series", "value")


def line_rows(spark, sf_dir):
    """A short line: the average price per priority, drawn row by row."""
    orders = read(spark, sf_dir, "orders")
    short = orders.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("largest")
    )
    return chart_series(short, ["o_orderpriority", "orders", "largest"], "line").select(
        F.col("ord").cast("bigint").alias("ord"), "category", "series", "value"
    )


def line_gaps(spark, sf_dir):
    """A long line over a column that is missing for some categories entirely."""
    parts = read(spark, sf_dir, "part").select(
        "p_brand", F.when(F.col("p_brand") != "Brand#7", F.col("p_retailprice")).alias("price")
    )
    return rounded(chart_series(parts, ["p_brand", "price"], "line"), "value").select("category", "series", "value")


def boolean_bars(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").select(
        (F.col("l_quantity") > 25).alias("large"), (F.col("l_returnflag") == "R").alias("returned"), "l_shipdate"
    )
    return chart_series(items, ["large", "returned", "l_shipdate"], "bar").select("category", "series", "value")


def position_line(spark, sf_dir):
    """A single numeric column against the position of its rows, in a table of three files."""
    folder = shared_folder(spark)
    orders = read(spark, sf_dir, "orders").repartitionByRange(3, "o_orderkey").sortWithinPartitions("o_orderkey")
    orders.select("o_totalprice").write.parquet(f"{folder}/prices.parquet")
    prices = load_workspace(spark, folder, keep_order=True)["prices"]
    return chart_series(prices, ["o_totalprice"], "line").select("category", "series", "value")


def table_whole(spark, sf_dir):
    return table_extract(read(spark, sf_dir, "supplier"), ["s_name", "s_acctbal", "s_nationkey"])


def table_texts(spark, sf_dir):
    """Cells of every event, with missing values."""
    events = read(spark, sf_dir, "events").select(
        "event_id", "ts", F.when(F.col("value") <= 20, F.col("value")).alias("value"),
        F.when(F.col("event_type") != "click", F.col("event_type")).alias("kind"),
        (F.col("value") > 10).alias("high"),
    )
    return table_cells(events, ["event_id", "ts", "value", "kind", "high"])


# ---- whole runs ------------------------------------------------------------------


def _spec(title, sheet, chart_type, columns, text, kpi_specs=()):
    return {
        "title": title, "source_sheet": sheet, "chart_type": chart_type, "data_columns": columns,
        "insight_text": text, "kpis": list(kpi_specs),
    }


PLAN = [
    _spec("Overview", "none", "text", [], "All orders."),
    _spec(
        "Priorities", "orders", "bar", ["O_OrderPriority", "o_totalprice"],
        "{{TOP_CATEGORY}} leads with {{TOP_VALUE}} ({{TOP_PCT}}).",
        [extreme("Top", "o_orderpriority", "o_totalprice"), average("Mean", "o_orderpriority", "o_totalprice"),
         matching_sum("All", "o_orderpriority", "", "o_totalprice")],
    ),
    _spec("Status", "orders", "pie", ["o_orderstatus"], "{{COUNT}} states, {{TOTAL_VALUE}} orders."),
    _spec(
        "Days", "orders", "line", ["o_orderdate", "o_custkey"], "{{COUNT}} days.",
        [peak("Peak", "o_orderdate", "o_totalprice"), rate("Urgent", "o_orderpriority", "urgent")],
    ),
    _spec("Suppliers", "supplier", "table", ["s_name", "s_acctbal"], "{{COUNT}} suppliers."),
    _spec("Elsewhere", "nowhere", "bar", ["x"], "Nothing."),
    _spec("Unmatched", "orders", "bar", ["x"], "{{COUNT}}"),
    _spec("Brands", "part", "bar", ["P_ Brand", "p_size", "p_name"], "{{BOTTOM_CATEGORY}} is last."),
]


def _run(spark, sf_dir) -> Run:
    text = "```json\n" + json.dumps({"slides": PLAN}) + "\n```"
    plans = spark.createDataFrame([("plan", text)], "plan_id string, body string")
    tables = {n: read(spark, sf_dir, n) for n in ("orders", "supplier", "part")}
    return run_specs(parse_specs(plans, "plan_id", "body"), tables, keep_groups=False)


def run_status(spark, sf_dir):
    return _run(spark, sf_dir).status.select("spec_id", "rendered_as", "status", "insight_text")


def run_kpis(spark, sf_dir):
    return _run(spark, sf_dir).kpis.select("spec_id", "label", "formatted", "status")


def run_facts(spark, sf_dir):
    return _run(spark, sf_dir).facts.select("spec_id", "top_category", "top_value", "total_value", "count")


def run_series(spark, sf_dir):
    return rounded(_run(spark, sf_dir).series, "value").select("spec_id", "category", "series", "value")


def run_tables(spark, sf_dir):
    return _run(spark, sf_dir).tables.select(
        "spec_id", F.array_join("names", "|").alias("names"), F.array_join("cells", "|").alias("cells")
    )


QUERIES = {
    "load_tables": load_tables,
    "load_text_grid": load_text_grid,
    "load_text_table": load_text_table,
    "load_json_table": load_json_table,
    "load_titled_files": load_titled_files,
    "load_multiline_cells": load_multiline_cells,
    "load_compressed": load_compressed,
    "load_long_ids": load_long_ids,
    "missing_values": missing_values,
    "empty_tables": empty_tables,
    "header_detect": header_detect,
    "header_detect_off": header_detect_off,
    "header_promote": header_promote,
    "grid_table": grid_table,
    "empty_rows": empty_rows,
    "empty_columns": empty_columns,
    "column_names": column_names,
    "clean_all": clean_all,
    "workspace_gate": workspace_gate,
    "type_labels": type_labels,
    "datetime_share": datetime_share,
    "numeric_profile": numeric_profile,
    "medians": medians,
    "missing_share": missing_share,
    "categorical_profile": categorical_profile,
    "long_text_profile": long_text_profile,
    "frequent_values": frequent_values,
    "frequent_values_of_long_text": frequent_values_of_long_text,
    "identifiers": identifiers,
    "suppressed_values": suppressed_values,
    "datetime_profile": datetime_profile,
    "inferred_datetime_profile": inferred_datetime_profile,
    "boolean_profile": boolean_profile,
    "all_missing_profile": all_missing_profile,
    "table_profile": table_profile,
    "empty_table_profile": empty_table_profile,
    "workspace_profile": workspace_profile,
    "refreshed_profile": refreshed_profile,
    "value_texts": value_texts,
    "condensed_profile": condensed_profile,
    "json_profile": json_profile,
    "identifier_guard": identifier_guard,
    "fence_strip": fence_strip,
    "spec_parse": spec_parse,
    "spec_parse_strict": spec_parse_strict,
    "spec_required_keys": spec_required_keys,
    "spec_kpis": spec_kpis,
    "spec_chart_type": spec_chart_type,
    "spec_data_columns": spec_data_columns,
    "column_resolution": column_resolution,
    "kpi_extreme_max": kpis("part", extreme("Top", "p_brand", "p_retailprice"), extreme("Rows", "p_brand", "p_name", "count"), extreme("Largest", "p_brand", "p_size", "max")),
    "kpi_extreme_min": kpis("part", extreme("Least", "p_brand", "p_retailprice", "sum", "min"), extreme("Mean", "p_type", "p_size", "mean", "min"), extreme("Small", "p_name", "p_retailprice", "min", "min")),
    "kpi_extreme_date": kpis("orders", extreme("Last day", "o_custkey", "o_orderdate", "max"), extreme("First day", "o_custkey", "o_orderdate", "min", "min"), extreme("Whole", "o_orderstatus", "o_custkey")),
    "kpi_extreme_text": kpis("orders", extreme("Text", "o_custkey", "o_orderpriority", "max"), extreme("Day", "o_orderdate", "o_totalprice")),
    "kpi_avg_per_group": kpis("customer", average("Balance", "c_mktsegment", "c_acctbal"), average("Mean", "c_nationkey", "c_acctbal", "mean"), average("Rows", "c_mktsegment", "c_name", "count")),
    "kpi_filtered_rate": kpis("orders", rate("Urgent or high", "o_orderpriority", "urgent|high"), rate("Nothing", "o_orderpriority", "^x"), rate("All", "o_orderpriority", "")),
    "kpi_filtered_sum": kpis("orders", matching_sum("Urgent or high", "o_orderpriority", "Urgent|High", "o_totalprice"), matching_sum("Keys", "o_orderstatus", "[fo]", "o_custkey"), matching_sum("None", "o_orderstatus", "x", "o_totalprice")),
    "kpi_filtered_text": kpis("documents", rate("Words", "text", "the [a-z]+ing"), matching_sum("Characters", "text", "license", "n_chars")),
    "kpi_peak_point": kpis("orders", peak("Peak", "o_orderdate", "o_totalprice"), peak("Key", "o_orderpriority", "o_orderkey"), peak("Last day", "o_orderkey", "o_orderdate")),
    "datetime_any_order": datetime_any_order,
    "datetime_zones": datetime_zones,
    "kpi_rules": kpis("orders", *KPI_RULES),
    "kpi_failures": kpis("orders", *KPI_FAILURES),
    "kpi_missing": missing_kpis,
    "value_formats": value_formats,
    "facts_sum": facts("orders", ["o_orderpriority", "o_totalprice"]),
    "facts_whole": facts("lineitem", ["l_shipdate", "l_partkey"]),
    "facts_count": facts("events", ["event_type", "props"]),
    "facts_rows": facts("events", ["event_type"]),
    "facts_numbers": fact_numbers,
    "column_roles": column_roles,
    "category_totals": totals_by_customer,
    "template_fill": template_fill,
    "template_leftovers": template_leftovers,
    "series_bar": series("lineitem", ["l_returnflag", "l_quantity", "l_extendedprice", "l_linestatus"], "bar"),
    "series_pie": series("orders", ["o_orderpriority", "o_totalprice"], "pie"),
    "series_counts": series("part", ["p_type"], "bar"),
    "series_dates": series("orders", ["o_orderdate", "o_custkey"], "bar"),
    "series_line_mean": line_means,
    "series_line_rows": line_rows,
    "series_line_gaps": line_gaps,
    "series_booleans": boolean_bars,
    "series_positions": position_line,
    "table_extract": table_whole,
    "table_cells": table_texts,
    "run_status": run_status,
    "run_kpis": run_kpis,
    "run_facts": run_facts,
    "run_series": run_series,
    "run_tables": run_tables,
}
