"""Positions of rows by the row counts of their files, and by blocks where rows were dropped."""

import pytest
from pyspark.sql import functions as F

from tablefacts.functions.columns import ROW
from tablefacts.operators import series as S
from tablefacts.sources.workspace import load_table


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t")) + "/t"
    spark.range(0, 1000, 1, 5).withColumn("v", F.when(F.col("id") % 7 > 0, F.col("id") * 3)).write.parquet(path)
    return load_table(spark, path, "parquet", keep_order=True)


def expected(table, name="v"):
    rows = table.select(F.col(ROW)["file"].alias("f"), F.col(ROW)["idx"].alias("i"), F.col(name).alias("v")).collect()
    return [(n, r["v"]) for n, r in enumerate(sorted(rows, key=lambda r: (r["f"], r["i"])))]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_whole_files_are_not_moved(table):
    got = S.positions(table, "v")
    assert "Exchange" not in plan(got) and "Sort" not in plan(got) and "Window" not in plan(got)
    assert sorted(map(tuple, got.collect())) == expected(table)


def test_dropped_and_repeated_rows_are_numbered_by_blocks(table):
    some = table.where("v is not null")
    assert S.file_starts(some) is None
    assert sorted(map(tuple, S.positions(some, "v").collect())) == expected(some)
    assert S.file_starts(table.unionByName(table.where("id % 2 = 0"))) is None


def test_more_files_than_listed(table, monkeypatch):
    monkeypatch.setattr(S, "MOST_FILES", 3)
    assert S.file_starts(table) is None
    assert sorted(map(tuple, S.positions(table, "v").collect())) == expected(table)


def test_an_empty_table_and_other_orders(spark, table):
    assert S.positions(table.limit(0), "v").collect() == []
    numbered = spark.createDataFrame([(5, "a"), (2, "b")], f"{ROW} bigint, v string")
    assert S.file_starts(numbered) is None
    assert sorted(map(tuple, S.positions(numbered, "v").collect())) == [(0, "b"), (1, "a")]


def test_shown_rows_keep_their_order_without_a_sort(table):
    got = S.table_rows(table, ["v"], "a", "b")
    assert "Exchange" not in plan(got) and "Sort" not in plan(got)
    for spec in "ab":
        shown = got.where(f"spec_id = '{spec}'").select("ord", "cells").collect()
        by_order = [r["cells"][0] for r in sorted(shown, key=lambda r: r["ord"])]
        sorted_cells = [r["v"] for r in S.table_cells(table, ["v"]).collect()]
        assert by_order == sorted_cells
    some = table.where("v is not null")
    assert S.table_rows(some, ["v"]).count() == some.count()
