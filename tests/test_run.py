"""A plan over two tables, end to end."""

import json

import pytest

from tablefacts.plans.run import UnfilledTemplate, run_specs
from tablefacts.plans.specs import parse_specs


def spec(title, sheet, kind, columns, text, kpis=()):
    return {
        "title": title,
        "source_sheet": sheet,
        "chart_type": kind,
        "data_columns": columns,
        "insight_text": text,
        "kpis": list(kpis),
    }


def total(label, by, value):
    return {"label": label, "type": "filtered_sum", "filter_col": by, "filter_contains": "", "value_col": value}


def top(label, by, value):
    return {"label": label, "type": "extreme_category", "group_by": by, "value_col": value, "agg": "sum", "which": "max"}


def average(label, by, value):
    return {"label": label, "type": "avg_per_group", "group_by": by, "value_col": value, "agg": "mean"}


def rate(label, column, pattern):
    return {"label": label, "type": "filtered_rate", "filter_col": column, "filter_contains": pattern}


def peak(label, x, value):
    return {"label": label, "type": "peak_point", "x_col": x, "value_col": value}


PLAN = [
    spec(
        "Wettest week", "Visits", "bar", ["week", "Rain%"], "{{TOP_CATEGORY}} had {{TOP_VALUE}} of {{TOTAL_VALUE}}, {{BOTTOM_CATEGORY}} {{BOTTOM_VALUE}}",
        [peak("Peak", "Week", "Rain %"), average("Mean rain", "Week", "Rain %"), rate("North", "Gate", "NORTH")],
    ),
    spec("Gates", "Visits", "pie", ["Gate", "Visitors"], "{{SECOND_CATEGORY}} {{SECOND_PCT}}", [total("South", "Gate", "Visitors") | {"filter_contains": "sou"}]),
    spec("No table", "none", "text", ["x"], "Only words."),
    spec(
        "Fruit", "Harvest", "bar", ["Fruit", "Crates", "crew size", "no such"], "{{COUNT}} kinds, {{MEAN_VALUE}} each",
        [top("Most", "Fruit", "Crates"), top("Late", "Orchard", "Fruit") | {"agg": "max"}, total("All", "Fruit", "Crates"), total("Fourth", "Fruit", "Crates")],
    ),
    spec("Crews", "Harvest", "table", ["Orchard", "Crew Size"], "{{TOP_CATEGORY}}"),
    spec("Orchards", "Harvest", "line", ["Orchard", "Crates"], "as rows", [top("Bad", "Orchard", "nothing")]),
]


@pytest.fixture(scope="module")
def run(spark, harvest, visits):
    text = "```json\n" + json.dumps({"slides": PLAN}) + "\n```"
    plans = spark.createDataFrame([("p", text)], "id string, body string")
    run = run_specs(parse_specs(plans, "id", "body"), {"Harvest": harvest, "Visits": visits})
    yield run
    run.release()


def rows(frame, *order):
    return [r.asDict() for r in frame.orderBy(*order).collect()]


def test_status_and_texts(run):
    got = rows(run.status, "spec_id")
    assert [r["rendered_as"] for r in got] == ["bar", "pie", "text", "bar", "table", "line"]
    assert {r["status"] for r in got} == {"ok"}
    assert [r["insight_text"] for r in got] == [
        "W3 had 55.00 of 90.00, W2 5.00", "south 40.0%", "Only words.", "3 kinds, 8,333.33 each", "Lake", "as rows",
    ]
    assert got[3]["unmatched"] == ["no such"]


def test_kpis(run):
    got = {(r["spec_id"], r["label"]): (r["formatted"], r["status"]) for r in rows(run.kpis, "spec_id")}
    assert got == {
        ("0", "Peak"): ("W3 (30)", "ok"),
        ("0", "Mean rain"): ("15", "ok"),
        ("0", "North"): ("50%", "ok"),
        ("1", "South"): ("2,400", "ok"),
        ("3", "Most"): ("apple (12,000)", "ok"),
        ("3", "Late"): ("Hill (plum)", "ok"),
        ("3", "All"): ("25,000", "ok"),
        ("3", "Fourth"): (None, "skipped: beyond the first 3"),
        ("5", "Bad"): (None, "skipped: unknown column in value_col"),
    }


def test_series(run):
    by_spec = {}
    for r in rows(run.series, "spec_id", "series_idx", "ord"):
        by_spec.setdefault(r["spec_id"], []).append((r["category"], r["series"], r["value"]))
    assert by_spec["0"] == [("W1", "Rain %", 30.0), ("W2", "Rain %", 5.0), ("W3", "Rain %", 55.0)]
    assert by_spec["1"] == [("north", "Visitors", 3600.0), ("south", "Visitors", 2400.0)]
    assert by_spec["3"] == [
        ("apple", "Crates", 12000.0), ("pear", "Crates", 8000.0), ("plum", "Crates", 5000.0),
        ("apple", "Crew Size", 17.0), ("pear", "Crew Size", 15.0), ("plum", "Crew Size", 8.0),
    ]
    assert [c for c, _, _ in by_spec["5"]] == ["Dune"] + ["Hill"] * 3 + ["Lake"] * 3 + ["Mill"] * 3


def test_table(run):
    got = rows(run.tables, "ord")
    assert len(got) == 10 and got[0]["names"] == ["Orchard", "Crew Size"]
    assert got[0]["cells"] == ["Hill", "5"]


def test_bad_specs_fall_back_alone(spark, harvest):
    empty = spark.createDataFrame([], "a string, b bigint")
    specs = [
        spec("a", "Nowhere", "bar", ["x"], "t"),
        spec("b", "Empty", "bar", ["a"], "t"),
        spec("c", "Harvest", "bar", ["nothing"], "{{TOP_VALUE}}"),
        spec("d", "Harvest", "bar", ["Orchard", "orchard"], "{{TOP_VALUE}}"),
        spec("e", "Harvest", "table", ["Orchard", "Crates", "CRATES"], "{{TOP_VALUE}}"),
        spec("f", "Harvest", "line", ["Orchard", "Fruit"], "x"),
        spec("g", "Harvest", "pie", ["Crates"], "{{COUNT}}"),
        spec("h", "Harvest", "text", ["Orchard", "Crates"], "{{TOP_CATEGORY}}"),
        spec("i", "NONE", "text", [], "{{TOP_CATEGORY}}"),
        spec("j", "Harvest", "bar", "Orchard", "ok"),
    ]
    run = run_specs(specs, {"Harvest": harvest, "Empty": empty})
    got = [(r["rendered_as"], r["status"]) for r in rows(run.status, "spec_id")]
    assert got == [
        ("text", "fallback: no such table"),
        ("text", "fallback: empty table"),
        ("text", "unfilled"),
        ("text", "unfilled"),
        ("text", "fallback: duplicate column"),
        ("text", "fallback: value column is not numeric"),
        ("text", "fallback: single numeric column"),
        ("text", "ok"),
        ("text", "unfilled"),
        ("bar", "ok"),
    ]
    texts = [r["insight_text"] for r in rows(run.status, "spec_id")]
    assert texts[7] == "Hill" and texts[6] == "9"
    run.release()
    nested = harvest.selectExpr("array(Orchard) AS Orchards", "Crates + `Crew Size` AS Crates")
    run = run_specs(
        [spec("k", "N", "bar", ["Orchards", "Crates"], "{{COUNT}}"),
         spec("l", "N", "bar", ["Crates", "Orchards"], "x", [top("T", "Orchards", "Crates")])],
        {"N": nested},
    )
    assert [(r["rendered_as"], r["status"]) for r in rows(run.status, "spec_id")] == [("text", "unfilled"), ("bar", "ok")]
    assert rows(run.kpis, "spec_id")[0]["status"] == "skipped: unsupported type"
    assert [r["value"] for r in rows(run.series, "ord")] == [1.0] * 10
    run.release()
    with pytest.raises(UnfilledTemplate):
        run_specs(specs[2:3], {"Harvest": harvest}, strict=True)


def test_awkward_column_names(spark):
    """Dots, backticks, percent signs and letters of any script in column names."""
    from tablefacts.operators.profile import infer_types, profile_table

    df = spark.createDataFrame(
        [("a", 1.5, 2, "2024-01-01"), ("b", 2.5, 3, "2024-01-02"), ("a", None, 4, None)],
        "`k.1` string, `v``%` double, `名 前` int, `d:ay` string",
    )
    profile = {r["column"]: r for r in profile_table(df).collect()}
    assert list(profile) == df.columns and profile["d:ay"]["label"] == "datetime (inferred)"
    assert (profile["v`%"]["median"], profile["名 前"]["sum"], profile["k.1"]["unique_values"]) == (2.0, 9.0, 2)
    assert [r["label"] for r in infer_types(df).collect()][3] == "datetime (inferred)"
    specs = [
        spec("a", "T", "bar", ["K.1", "V`%", "名前"], "{{TOP_CATEGORY}} {{TOTAL_VALUE}}",
             [top("t", "k.1", "名前"), {"label": "p", "type": "peak_point", "x_col": "d:ay", "value_col": "v`%"}]),
        spec("b", "T", "table", ["d:ay", "v`%"], "x"),
        spec("c", "T", "line", ["k.1", "v`%"], "x"),
    ]
    run = run_specs(specs, {"T": df})
    assert [(r["status"], r["insight_text"]) for r in rows(run.status, "spec_id")][0] == ("ok", "b 4.00")
    assert {r["label"]: r["formatted"] for r in run.kpis.collect()} == {"t": "a (6)", "p": "2024-01-02 (2.5)"}
    assert len(run.series.collect()) == 7 and len(run.tables.collect()) == 3
    run.release()
