import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablefacts.operators.facts import FACTS, insight_facts
from tablefacts.operators.groups import NotComputable
from tablefacts.operators.kpi import compute_kpis


def extreme(label, by, value, agg="sum", which="max"):
    return {"label": label, "type": "extreme_category", "group_by": by, "value_col": value, "agg": agg, "which": which}


def average(label, by, value, agg="sum"):
    return {"label": label, "type": "avg_per_group", "group_by": by, "value_col": value, "agg": agg}


def rate(label, column, pattern):
    return {"label": label, "type": "filtered_rate", "filter_col": column, "filter_contains": pattern}


def matching(label, column, pattern, value):
    return {"label": label, "type": "filtered_sum", "filter_col": column, "filter_contains": pattern, "value_col": value}


def peak(label, x, value):
    return {"label": label, "type": "peak_point", "x_col": x, "value_col": value}


def run(df, *specs):
    out = {}
    for i in range(0, len(specs), 3):
        for r in compute_kpis(df, list(specs[i : i + 3])).collect():
            out[r["label"]] = (r["formatted"], r["status"])
    return out


@pytest.fixture(scope="module")
def shop(spark):
    rows = [
        ("a", 1, 1.5, True, datetime.date(2024, 1, 1), "Reorder"),
        ("b", 5, 2.5, False, datetime.date(2024, 3, 1), "ok"),
        ("a", 4, None, None, None, None),
        ("c", 5, 0.0, True, datetime.date(2024, 2, 1), "Don't REORDER"),
        (None, 99, 50.0, True, datetime.date(2025, 1, 1), "ok"),
        ("d", None, None, None, None, "Übung"),
    ]
    return spark.createDataFrame(rows, "k string, i int, f double, b boolean, d date, s string")


def test_ties_take_the_smallest_key(shop):
    got = run(shop, extreme("max", "k", "i"), extreme("min", "k", "i", "sum", "min"), extreme("n", "k", "i", "count"))
    assert got == {"max": ("a (5)", "ok"), "min": ("d (0)", "ok"), "n": ("a (2)", "ok")}


def test_aggregates(shop):
    got = run(
        shop,
        extreme("mean", "k", "i", "mean", "min"),
        extreme("largest", "k", "f", "max"),
        extreme("bool", "k", "b"),
        extreme("date", "k", "d", "max"),
        extreme("first", "k", "d", "min", "min"),
        extreme("text", "k", "s", "max"),
        average("avg", "k", "i"),
        average("avg mean", "k", "f", "mean"),
        average("other which", "k", "i", "count"),
    )
    assert got == {
        "mean": ("a (2.5)", "ok"),
        "largest": ("b (2.5)", "ok"),
        "bool": ("a (1)", "ok"),
        "date": ("b (2024-03-01)", "ok"),
        "first": ("a (2024-01-01)", "ok"),
        "text": ("d (Übung)", "ok"),
        "avg": ("3.8", "ok"),
        "avg mean": ("1.3", "ok"),
        "other which": ("1", "ok"),
    }


def test_filters(shop):
    got = run(
        shop,
        rate("contains", "s", "reorder"),
        rate("regex", "s", "^re|^ok$"),
        rate("unicode", "s", "üBUNG"),
        matching("sum", "s", "reorder", "i"),
        matching("all", "s", "", "i"),
        matching("none", "s", "zzz", "f"),
    )
    assert got == {
        "contains": ("33.3%", "ok"),
        "regex": ("50%", "ok"),
        "unicode": ("16.7%", "ok"),
        "sum": ("6", "ok"),
        "all": ("110", "ok"),
        "none": ("0", "ok"),
    }


def test_peaks(shop):
    got = run(shop, peak("number", "d", "i"), peak("float", "k", "f"), peak("date", "k", "d"), peak("bool", "i", "b"))
    assert got["number"] == ("2025-01-01 (99)", "ok")
    assert got["date"] == (None, "skipped: no value") or got["date"][1] == "ok"


def test_peak_takes_the_first_row_on_ties(spark):
    rows = [("z", 5, 1), ("a", 5, 2), ("q", 1, 0)]
    df = spark.createDataFrame(rows, "x string, v int, _row int")
    assert run(df, peak("p", "x", "v")) == {"p": ("z (5)", "ok")}
    assert run(df.drop("_row"), peak("p", "x", "v")) == {"p": ("a (5)", "ok")}


def test_failures_stay_alone(shop):
    got = run(
        shop,
        {"label": "no type"},
        {"label": "type", "type": "median"},
        rate("pattern", "s", "(("),
        rate("number", "i", "1"),
        rate("column", "nope", "1"),
        extreme("agg", "k", "i", "median"),
        extreme("text sum", "k", "s"),
        {"label": "which", "type": "extreme_category", "group_by": "k", "value_col": "i", "agg": "sum"},
        rate("pattern type", "s", 5),
        {"label": "name", "type": "peak_point", "x_col": 3, "value_col": "i"},
        {"label": 7, "type": ["x"]},
        matching("good", "s", "ok", "i"),
    )
    assert got.pop("good") == ("104", "ok")
    assert got.pop("pattern type") == (None, "skipped: bad pattern")
    assert got.pop("name") == (None, "skipped: x_col is no name")
    assert got.pop("7") == (None, "skipped: unknown type")
    assert got == {
        "no type": (None, "skipped: no type"),
        "type": (None, "skipped: unknown type"),
        "pattern": (None, "skipped: bad pattern"),
        "number": (None, "skipped: not text"),
        "column": (None, "skipped: unknown column in filter_col"),
        "agg": (None, "skipped: unknown agg"),
        "text sum": (None, "skipped: not numeric"),
        "which": (None, "skipped: no which"),
    }


def test_three_specs_labels_and_order(shop):
    specs = [rate("A", "s", "ok"), rate("", "s", "ok"), matching("A", "s", "ok", "i"), rate("D", "s", "ok")]
    rows = [(r["kpi_idx"], r["label"], r["formatted"]) for r in compute_kpis(shop, specs).collect()]
    assert sorted(rows) == [(0, "A", "104"), (3, "D", None)]
    kept = [rate("A", "s", "ok"), rate("A", "nope", "ok")]
    assert [r["formatted"] for r in compute_kpis(shop, kept).collect()] == ["33.3%"]
    assert compute_kpis(shop, []).collect() == []


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, v int")
    got = run(df, extreme("e", "k", "v"), rate("r", "k", "x"), matching("s", "k", "", "v"))
    assert {s for _, s in got.values()} == {"skipped: no value"}


def facts(df, *columns):
    return insight_facts(df, list(columns)).first().asDict()


def test_facts_goldens(harvest, visits):
    got = facts(harvest, "Orchard", "Crates")
    assert [got[n] for n in FACTS] == [
        "Hill", "9,500", "38.0%", "Lake", "9,500", "38.0%", "Dune", "0", "25,000", "6,250.00", "4",
    ]
    got = facts(harvest, "Fruit", "Crates")
    assert [got[n] for n in FACTS][:8] == ["apple", "12,000", "48.0%", "pear", "8,000", "32.0%", "plum", "5,000"]
    got = facts(visits, "Week", "Rain %")
    assert [got[n] for n in FACTS] == ["W3", "55.00", "61.1%", "W1", "30.00", "33.3%", "W2", "5.00", "90.00", "30.00", "3"]
    got = facts(visits, "Gate", "Visitors")
    assert (got["second_category"], got["bottom_category"], got["second_pct"]) == ("south", "south", "40.0%")


def test_facts_of_extremes(spark):
    least = -(2**63)
    df = spark.createDataFrame([("a", True, least), ("b", False, 7), ("c", None, None)], "k string, b boolean, n bigint")
    got = insight_facts(df, ["k", "b"], agg="max").first()
    assert (got["top_category"], got["bottom_category"], got["count"]) == ("a", "b", "2")
    got = insight_facts(df, ["k", "n"], agg="min").first()
    assert (got["top_category"], got["bottom_category"], got["bottom_number"]) == ("b", "a", float(least))
    with pytest.raises(NotComputable):
        insight_facts(df, ["k", "n"], agg="median")


def test_kpis_beyond_the_limit_are_named(harvest):
    specs = [rate(f"r{i}", "Fruit", "apple") for i in range(5)]
    got = {r["label"]: r["status"] for r in compute_kpis(harvest, specs).collect()}
    assert got == {"r0": "ok", "r1": "ok", "r2": "ok", "r3": "skipped: beyond the first 3", "r4": "skipped: beyond the first 3"}
    assert {r["status"] for r in compute_kpis(harvest, specs, most=5).collect()} == {"ok"}


def test_facts_edges(spark, shop):
    one = spark.createDataFrame([("a", 0.0)], "k string, v double")
    got = facts(one, "k", "v")
    assert [got[n] for n in FACTS] == ["a", "0.00", "0.0%", "N/A", "0", "0.0%", "a", "0.00", "0.00", "0.00", "1"]
    none = spark.createDataFrame([(None, 1.0)], "k string, v double")
    got = facts(none, "k", "v")
    assert (got["top_category"], got["top_value"], got["bottom_value"], got["count"]) == ("N/A", "0", "0", "0")
    got = facts(shop, "k", "s", "i")
    assert got["top_category"] == "a" and got["bottom_category"] == "d" and got["total_value"] == "15"
    got = facts(shop, "i", "k")
    assert (got["top_category"], got["top_value"], got["count"]) == ("5", "2", "4")
    got = facts(shop, "b")
    assert (got["top_category"], got["top_value"], got["second_category"]) == ("True", "3", "False")


@settings(max_examples=4, deadline=None)
@given(
    st.lists(
        st.tuples(st.sampled_from("abc"), st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False))), min_size=1, max_size=40
    )
)
def test_partitioning_does_not_show(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    specs = [extreme("m", "k", "v"), average("a", "k", "v"), peak("p", "k", "v")]
    first = sorted(compute_kpis(df.coalesce(1), specs).collect())
    assert sorted(compute_kpis(df.repartition(5), specs).collect()) == first
    assert facts(df.repartition(5), "k", "v") == facts(df.coalesce(1), "k", "v")
