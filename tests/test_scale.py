"""Plans and driver time: what must not grow with rows or specs."""

import io
import time
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from tablefacts.functions.columns import ROW, local_frame, union_all
from tablefacts.operators.groups import NotComputable, group
from tablefacts.operators.kpi import check_pattern
from tablefacts.operators.profile import drop_identifier_columns, profile_table
from tablefacts.operators.series import BLOCK_BITS, chart_series, positions
from tablefacts.plans.run import run_specs
from tablefacts.plans.specs import catalog, resolve_requests
from tablefacts.sources.workspace import load_workspace


def plan_of(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture(scope="module")
def harvest_file(spark, harvest, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("scale") / "harvest.parquet")
    harvest.write.parquet(path)
    return spark.read.parquet(path)


def test_requests_and_specs_are_not_shuffled(spark, harvest):
    asked = spark.range(1000).select("id", F.concat(F.lit("T"), F.col("id") % 3).alias("table"), F.concat(F.lit("c"), F.col("id")).alias("requested"))
    plan = plan_of(resolve_requests(asked, catalog({"Harvest": harvest})))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    specs = spark.range(1000).select(F.concat(F.lit("T"), F.col("id") % 3).alias("source_sheet"), F.array(F.lit("Crates")).alias("data_columns"))
    flagged = profile_table(harvest, "T1").withColumn("identifier_like", F.col("column") == "Crates")
    kept = drop_identifier_columns(specs, flagged)
    assert "SortMergeJoin" not in plan_of(kept)
    assert {tuple(r) for r in kept.distinct().select("source_sheet", F.size("data_columns")).collect()} == {("T0", 1), ("T1", 0), ("T2", 1)}


def test_text_extremes_do_not_sort_the_source(harvest_file):
    texts = [c for c, t in harvest_file.dtypes if t == "string"]
    groups = group(harvest_file, texts[0], [("max", texts[1]), ("min", texts[1])], apart=texts[1])
    lowest = [line for line in plan_of(groups.frame).splitlines() if "Aggregate" in line][-1]
    assert "HashAggregate" in lowest
    expected = harvest_file.groupBy(texts[0]).agg(F.max(texts[1]), F.min(texts[1]))
    assert sorted(map(tuple, groups.frame.collect())) == sorted(map(tuple, expected.collect()))


def test_many_specs_share_one_scan_for_each_category(spark, harvest_file):
    texts = [c for c, t in harvest_file.dtypes if t == "string"][:2]
    specs = [
        {"title": str(i), "source_sheet": "h", "chart_type": "bar", "data_columns": [texts[i % 2], "Crates"], "insight_text": "{{top_value}}"}
        for i in range(400)
    ]
    start = time.time()
    run = run_specs(specs, {"h": harvest_file}, keep_groups=False)
    facts, series = run.facts, run.series
    assert time.time() - start < 30
    assert plan_of(series).count("FileScan") == 2
    assert facts.count() == 400 and facts.select("top_value", "second_value", "top_category").distinct().count() == 2
    assert series.select("spec_id").distinct().count() == 400


def test_facts_of_several_measures(spark):
    rows = [("a", 1, 2.5, True), ("a", 2, None, None), ("b", 3, 0.5, True), ("c", None, None, None), (None, 9, 9.0, False)]
    df = spark.createDataFrame(rows, "k string, n long, x double, t boolean")
    specs = [
        {"source_sheet": "d", "chart_type": "bar", "data_columns": c, "insight_text": "", "title": ""}
        for c in (["k", "n"], ["k", "x"], ["k"], ["k", "n"], ["t", "n"])
    ]
    got = {r["spec_id"]: r for r in run_specs(specs, {"d": df}, keep_groups=False).facts.collect()}
    place = lambda i: tuple(got[i][n] for n in ("top_category", "top_number", "second_category", "second_number", "bottom_category", "total_number", "count_number"))
    assert place("0") == place("3") == ("a", 3.0, "b", 3.0, "c", 6.0, 3)
    assert place("1") == ("a", 2.5, "b", 0.5, "c", 3.0, 3)
    assert place("2") == ("a", 2.0, "b", 1.0, "c", 4.0, 3)
    assert place("4")[1:4:2] == (9.0, 4.0)


def test_positions_over_three_files(spark, tmp_path):
    df = spark.range(0, 3000, 1, 3).select(F.col("id").cast("double").alias("v"))
    df.write.parquet(str(tmp_path / "t.parquet"))
    table = load_workspace(spark, str(tmp_path), keep_order=True)["t"]
    points = chart_series(table, ["v"], "line").collect()
    assert sorted((int(p["category"]), p["ord"], p["value"]) for p in points) == [(i, i, float(i)) for i in range(3000)]


def test_line_modes(spark, harvest):
    """What a line shows is an argument; by itself the size of the table decides."""
    shown = lambda mode: len(chart_series(harvest, ["Orchard", "Crates"], "line", line=mode).collect())
    assert (shown("auto"), shown("rows"), shown("mean")) == (10, 10, 4)
    twice = harvest.union(harvest).union(harvest)
    assert len(chart_series(twice, ["Orchard", "Crates"], "line").collect()) == 4
    assert len(chart_series(twice, ["Orchard", "Crates"], "line", line="rows").collect()) == 30
    with pytest.raises(ValueError, match="unknown line mode"):
        chart_series(harvest, ["Orchard", "Crates"], "line", line="curve")


def test_positions_over_blocks(spark):
    step = 1 << (BLOCK_BITS - 2)
    df = spark.range(40).select((F.col("id") * step - 3 * step).alias(ROW), (F.col("id") * 1.0).alias("v"))
    got = sorted(map(tuple, positions(df.repartition(7), "v").collect()))
    assert got == [(i, float(i)) for i in range(40)]
    assert positions(df.limit(0), "v").count() == 0


def test_long_ids_stay_exact(spark, tmp_path):
    ids = [1234567890123456781, 1234567890123456782, 99999999999999999999]
    (tmp_path / "a.csv").write_text("id,wide,far\n" + "".join(f"{i},{w},1{'0' * 40}\n" for i, w in zip(ids[:2], ids[1:])))
    table = load_workspace(spark, str(tmp_path))["a"]
    assert table.dtypes == [("id", "bigint"), ("wide", "decimal(38,0)"), ("far", "double")]
    assert sorted((r["id"], int(r["wide"])) for r in table.collect()) == list(zip(ids[:2], ids[1:]))


def test_patterns_need_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    check_pattern("only once [a-z]+")
    assert len(tracker.getJobIdsForGroup(None)) == before
    with pytest.raises(NotComputable):
        check_pattern("(")


def test_union_of_many(spark):
    frames = [local_frame(spark, [(i, None)], "i long, t string") for i in range(5)]
    assert sorted(r["i"] for r in union_all(frames).collect()) == [0, 1, 2, 3, 4]
    assert local_frame(spark, [], "i long").count() == 0
