import json

import pytest
from pyspark.sql import functions as F

from tablefacts.operators.series import chart_series, table_cells, table_rows
from tablefacts.operators.groups import NotComputable
from tablefacts.operators.templates import fill_template, unfilled
from tablefacts.operators.facts import insight_facts
from tablefacts.plans.specs import catalog, parse_specs, resolve_requests, strip_fences

GOOD = {"title": "T", "source_sheet": "S", "chart_type": "bar", "data_columns": ["a"], "insight_text": "x"}


def parse(spark, *texts, strict=False):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, body string")
    got = parse_specs(df, "id", "body", strict).orderBy("plan_id", "spec_idx").collect()
    return [r.asDict(recursive=True) for r in got]


def statuses(spark, *texts, strict=False):
    return [(r["plan_id"], r["spec_idx"], r["status"]) for r in parse(spark, *texts, strict=strict)]


def test_fences(spark):
    texts = {
        "```json\n[1]\n```": "[1]", "```\n[1]\n```": "[1]", "  ```json [1]```  ": "[1]", "[1]": "[1]",
        "  \n[1] ": "[1]", "```json\n[1]": "[1]", "a ``` b": "a ``` b", "": "", "```json\n\n\n[1]\n\n```\n\n": "[1]",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(strip_fences(F.col("t"))).collect()] == list(texts.values())


def test_plan_shapes(spark):
    one = json.dumps(GOOD)
    got = statuses(
        spark, f"[{one}]", f'{{"slides": [{one}, {one}]}}', "[]", '{"slides": []}', f"[{one}",
        '{"x": 1}', "7", '"text"', '{"slides": 5}', '{"slides": null}', "null", "",
    )
    assert got == [
        (0, 0, "ok"), (1, 0, "ok"), (1, 1, "ok"),
        (4, None, "error: not JSON"), (5, None, "error: no list of specs"), (6, None, "error: no list of specs"),
        (7, None, "error: no list of specs"), (8, None, "error: no list of specs"), (9, None, "error: no list of specs"),
        (10, None, "error: no list of specs"), (11, None, "error: not JSON"),
    ]


def test_keys_and_types(spark):
    without = {k: v for k, v in GOOD.items() if k not in ("title", "chart_type")}
    plan = [GOOD, without, 5, "x", None, {**GOOD, "chart_type": " PIE\n"}, {**GOOD, "chart_type": "donut"}, {**GOOD, "title": None}]
    got = parse(spark, json.dumps(plan))
    assert [r["status"] for r in got] == [
        "ok", "error: missing keys: chart_type, title", "error: not an object", "error: not an object",
        "error: not an object", "ok", "error: unknown chart type", "ok",
    ]
    assert got[5]["chart_type"] == "pie"


def test_strict(spark):
    plan = json.dumps([GOOD, {**GOOD, "chart_type": "donut"}])
    assert statuses(spark, plan, json.dumps([GOOD]), strict=True) == [
        (0, 0, "error: another spec of the plan is invalid"), (0, 1, "error: unknown chart type"), (1, 0, "ok"),
    ]


def test_kpis_and_columns(spark):
    kpi = {"label": "L", "type": "avg_per_group", "group_by": "g", "value_col": "v", "agg": "sum", "extra": 1}
    plan = [
        {**GOOD, "kpis": [kpi, {"label": "x"}, 3, None, {**kpi, "label": None}]},
        {**GOOD, "kpis": {"L": 1}}, {**GOOD, "kpis": None}, {**GOOD, "kpis": "L"}, GOOD,
        {**GOOD, "data_columns": "only"}, {**GOOD, "data_columns": ["a", 2]}, {**GOOD, "data_columns": []},
    ]
    got = parse(spark, json.dumps(plan))
    assert [len(r["kpis"]) for r in got] == [2, 0, 0, 0, 0, 0, 0, 0]
    assert got[0]["kpis"][0]["group_by"] == "g" and got[0]["kpis"][0]["x_col"] is None
    assert [r["data_columns"] for r in got[5:]] == [["only"], ["a", "2"], []]


def test_resolve_requests(spark, harvest):
    asked = spark.createDataFrame(
        [(1, "Harvest", "crew size"), (2, "Harvest", "CrewSize "), (3, "Harvest", "nope"), (4, "Other", "Orchard")],
        "id int, table string, requested string",
    )
    names = catalog({"Harvest": harvest}).union(spark.createDataFrame([("Harvest", 9, "CREWSIZE")], "t string, o int, c string"))
    got = {r["id"]: r["matched"] for r in resolve_requests(asked, names).collect()}
    assert got == {1: "Crew Size", 2: "Crew Size", 3: None, 4: None}


def test_templates(spark, harvest):
    texts = spark.createDataFrame(
        [("0", "{{TOP_CATEGORY}} {{COUNT}} {{TOP_CATEGORY}} {{OTHER}}"), ("1", "{{COUNT}}"), ("2", None), ("3", "plain")],
        "spec_id string, insight_text string",
    )
    done = fill_template(texts, insight_facts(harvest, ["Orchard", "Crates"]))
    got = {r["spec_id"]: r["insight_text"] for r in done.collect()}
    assert got == {"0": "Hill 4 Hill {{OTHER}}", "1": "{{COUNT}}", "2": None, "3": "plain"}
    assert sorted(r["spec_id"] for r in unfilled(done).collect()) == ["0", "1"]


def points(df, columns, kind):
    rows = chart_series(df, columns, kind).orderBy("series_idx", "ord").collect()
    return [(r["category"], r["series"], r["value"]) for r in rows]


def test_bars(spark):
    df = spark.createDataFrame(
        [(2, 1.5, "x", True), (1, None, None, False), (2, 2.0, "y", True), (None, 9.0, "z", True), (10, None, "q", None)],
        "k int, v double, s string, b boolean",
    )
    assert points(df, ["k", "v", "s", "b"], "bar") == [
        ("1", "v", 0.0), ("2", "v", 3.5), ("10", "v", 0.0),
        ("1", "s", 0.0), ("2", "s", 2.0), ("10", "s", 1.0),
        ("1", "b", 0.0), ("2", "b", 2.0), ("10", "b", 0.0),
    ]
    assert points(df, ["s"], "pie") == [(c, "Count", 1.0) for c in "qxyz"]
    assert points(df, ["b", "v"], "bar") == [("False", "v", 0.0), ("True", "v", 12.5)]


def test_lines(spark):
    short = spark.createDataFrame([("b", 1.0), (None, 3.0), ("a", None)], "k string, v double")
    assert points(short, ["k", "v"], "line") == [("a", "v", 0.0), ("b", "v", 1.0), ("nan", "v", 3.0)]
    twenty = spark.createDataFrame([("a", i) for i in range(20)], "k string, v int")
    assert len(points(twenty, ["k", "v"], "line")) == 20
    more = spark.createDataFrame([("a", i) for i in range(20)] + [("b", 7)], "k string, v int")
    assert points(more, ["k", "v"], "line") == [("a", "v", 9.5), ("b", "v", 7.0)]
    text = spark.createDataFrame([("a", "x")], "k string, v string")
    with pytest.raises(NotComputable):
        chart_series(text, ["k", "v"], "line")


def test_positions_and_duplicates(spark):
    df = spark.createDataFrame([(5.0, 1), (4.0, 0)], "v double, _row int")
    assert points(df, ["v"], "bar") == [("0", "v", 4.0), ("1", "v", 5.0)]
    with pytest.raises(NotComputable):
        chart_series(df.drop("_row"), ["v"], "bar")
    with pytest.raises(NotComputable):
        chart_series(df, ["v", "v"], "bar")
    with pytest.raises(NotComputable):
        table_cells(df, ["v", "v"])


def test_tables_keep_source_order(spark):
    df = spark.createDataFrame([("b", 2.0, 1), ("a", None, 0)], "k string, v double, _row int")
    got = [(r["names"], r["cells"]) for r in table_rows(df, ["k", "v"]).orderBy("ord").collect()]
    assert got == [(["k", "v"], ["a", "—"]), (["k", "v"], ["b", "2.00"])]


def test_series_order_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit(1).alias("v")).repartition(8)
    got = [c for c, _, _ in points(df, ["k", "v"], "bar")]
    assert got == [str(i) for i in range(1000)]
