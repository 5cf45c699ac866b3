import collections
import datetime
import hashlib
import json
import math
import statistics

import pytest
from pyspark.sql import functions as F

from tablefacts.operators import median as M
from tablefacts.operators import profile as P


def by_column(profile):
    return {r["column"]: r.asDict(recursive=True) for r in profile.collect()}


def test_harvest(harvest):
    got = by_column(P.profile_table(harvest, "Harvest"))
    crates = [r["Crates"] for r in harvest.collect()]
    assert (got["Crates"]["int_sum"], got["Crates"]["mean"], got["Crates"]["median"]) == (25000, 2500.0, 2250.0)
    assert got["Crates"]["std_dev"] == round(statistics.stdev(crates), 4)
    crew = got["Crew Size"]
    assert (crew["sum"], crew["mean"], crew["median"], crew["std_dev"]) == (40.0, 4.0, 4.0, 1.8257)
    assert got["Orchard"]["unique_values"] == 4
    assert got["Orchard"]["top_values"][0] == {"value": "Hill", "count": 3}
    assert got["Orchard"]["identifier_like"] is False
    assert {r["row_count"] for r in got.values()} == {10}


def test_visits(visits):
    rain = by_column(P.profile_table(visits))["Rain %"]
    assert (rain["mean"], rain["median"], rain["label"]) == (15.0, 15.0, "numeric (float)")


def test_dates_do_not_depend_on_order(spark):
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(days=i) for i in range(300)]
    texts = [d.strftime("%Y-%m-%d") for d in days[:120]] + [d.strftime("%m/%d/%Y") for d in days[120:]]
    frame = spark.createDataFrame([(t,) for t in texts], "d string").coalesce(1)
    profiles = [P.profile_table(f) for f in (frame, frame.orderBy(F.desc("d")), frame.repartition(5))]
    assert len({tuple(map(str, p.collect())) for p in profiles}) == 1
    got = by_column(profiles[0])["d"]
    assert (got["label"], got["non_null"], got["min_date"]) == ("datetime (inferred)", 180, "2024-04-30T00:00:00")
    late = spark.createDataFrame([("x",)] * 200 + [("  jan 02, 2024 ",)] * 300, "d string").coalesce(1)
    assert by_column(P.profile_table(late))["d"]["max_date"] == "2024-01-02T00:00:00"
    zones = spark.createDataFrame([("2024-01-01T23:30:00-01:00",), ("2024-01-01T00:00:00Z",)], "d string")
    assert by_column(P.profile_table(zones))["d"]["max_date"] == "2024-01-02T00:30:00"


def test_texts_that_get_long_late(spark):
    rows = [(f"s{i % 7}",) for i in range(400)] + [("long " * 100 + str(i % 3),) for i in range(90)]
    got = by_column(P.profile_table(spark.createDataFrame(rows, "s string").coalesce(1)))["s"]
    assert (got["unique_values"], got["non_null"]) == (10, 490)
    assert got["top_values"][0] == {"value": "s0", "count": 58}


def test_one_row_and_missing(spark):
    df = spark.createDataFrame(
        [(1, float("nan"), None, None, "x")], "i int, f double, b boolean, t timestamp_ntz, s string"
    )
    got = by_column(P.profile_table(df))
    assert got["i"]["std_dev"] is None and got["i"]["median"] == 1.0
    for c in "fbt":
        assert (got[c]["count"], got[c]["non_null"], got[c]["note"]) == (0, 0, P.NOTE_MISSING)
        assert got[c]["missing_pct"] is None
    assert got["s"]["identifier_like"] is False


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (3.0,)], "f double")
    got = by_column(P.profile_table(df))["f"]
    assert (got["count"], got["non_null"], got["missing_pct"], got["max"], got["median"]) == (4, 2, 50.0, 3.0, 2.0)


def test_booleans(spark):
    df = spark.createDataFrame([(True,), (False,), (True,), (None,)], "b boolean")
    got = by_column(P.profile_table(df))["b"]
    assert (got["true_count"], got["false_count"], got["true_pct"], got["missing_pct"]) == (2, 1, 66.7, 25.0)


def test_identifier_needs_ten_values(spark):
    nine = spark.createDataFrame([(str(i),) for i in range(9)], "s string")
    ten = spark.createDataFrame([(str(max(i, 1)),) for i in range(10)], "s string")
    assert by_column(P.profile_table(nine))["s"]["identifier_like"] is False
    row = by_column(P.profile_table(ten))["s"]
    assert row["identifier_like"] is True and row["top_values"] is None and row["note"] == P.NOTE_IDENTIFIER


def test_datetimes(spark):
    rows = [(datetime.date(2024, 1, 31), "01/02/2024"), (datetime.date(2026, 6, 30), "2024-05-06"), (None, "02/03/2024")]
    df = spark.createDataFrame(rows, "d date, s string")
    got = by_column(P.profile_table(df))
    assert (got["d"]["min_date"], got["d"]["date_range_days"]) == ("2024-01-31T00:00:00", 881)
    s = got["s"]
    assert (s["label"], s["non_null"], s["missing_pct"], s["max_date"]) == (
        "datetime (inferred)", 2, 33.3, "2024-02-03T00:00:00",
    )


def test_mostly_other_text_is_no_date(spark):
    df = spark.createDataFrame([("2024-01-01",), ("a",), ("b",)], "s string")
    got = by_column(P.profile_table(df))["s"]
    assert (got["label"], got["unique_values"]) == ("categorical / text", 3)


def test_dates_after_many_other_values(spark):
    """The leading rows settle the pattern only where they have one."""
    rows = [("TBD",)] * 150 + [(f"03/{i % 28 + 1:02d}/2024",) for i in range(200)] + [("2024-01-05",)]
    df = spark.createDataFrame(rows, "s string").coalesce(1)
    got = by_column(P.profile_table(df))["s"]
    assert (got["label"], got["non_null"], got["max_date"]) == (
        "datetime (inferred)", 200, "2024-03-28T00:00:00",
    )
    assert [r["label"] for r in P.infer_types(df).collect()] == ["datetime (inferred)"]
    few = spark.createDataFrame([("TBD",)] * 150 + rows[150:200], "s string").coalesce(1)
    got = by_column(P.profile_table(few))["s"]
    assert (got["label"], got["top_values"][0]["count"]) == ("categorical / text", 150)
    assert [r["label"] for r in P.infer_types(few).collect()] == ["categorical / text"]


def test_long_texts_are_counted_whole(spark):
    base = "x" * 500
    df = spark.createDataFrame([(base + "1",)] * 3 + [(base + "2",)] * 2 + [(None,)], "s string")
    got = by_column(P.profile_table(df))["s"]
    assert (got["unique_values"], got["non_null"]) == (2, 5)
    assert [(t["value"][-1], t["count"]) for t in got["top_values"]] == [("1", 3), ("2", 2)]


def test_dates_after_long_texts(spark):
    rows = [("w" * 400,)] * 120 + [(f"2024-03-{i % 28 + 1:02d}",) for i in range(200)]
    got = by_column(P.profile_table(spark.createDataFrame(rows, "s string").coalesce(1)))["s"]
    assert (got["label"], got["non_null"], got["date_range_days"], got["top_values"]) == ("datetime (inferred)", 200, 27, None)


def test_top_long_values(spark):
    """Ties among long texts of one beginning go by digest, others by their beginning."""
    texts = [f"{i % 40:02d}" + "z" * 200 for i in range(300)] + ["07" + "z" * 200] * 2 + ["x"] * 50
    same = ["a" * 128 + str(i % 3) for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(texts, same)), "t string, same string")
    row = by_column(P.profile_table(df))["t"]
    expected = [("x", 50), ("07", 10), ("00", 8), ("01", 8), ("02", 8)]
    assert [(t["value"][:2], t["count"]) for t in row["top_values"]] == expected
    got = [tuple(r) for r in P.top_values(df, ["t", "same"], 3).collect()]
    assert [(c, r, v[:2], n) for c, r, v, n in got[:3]] == [("t", i + 1, *e) for i, e in enumerate(expected[:3])]
    counts = collections.Counter(same)
    order = sorted(counts, key=lambda t: (-counts[t], hashlib.sha256(t.encode()).digest()))
    assert got[3:] == [("same", i + 1, t, counts[t]) for i, t in enumerate(order)]


def test_many_long_values_tie(spark):
    df = spark.range(100_000).select(F.concat(F.lpad(F.col("id").cast("string"), 6, "0"), F.repeat(F.lit("t"), 200)).alias("s"))
    got = [r["value"][:6] for r in P.top_values(df, ["s"], 3).orderBy("rank").collect()]
    assert got == ["000000", "000001", "000002"]


def test_short_first_rows_then_long_texts(spark):
    rows = [("a",)] * 200 + [("y" * 1000,)] * 300
    got = by_column(P.profile_table(spark.createDataFrame(rows, "s string").coalesce(1)))["s"]
    assert got["top_values"][0]["count"] == 300 and got["unique_values"] == 2


def test_empty_and_nested(spark):
    got = P.profile_table(spark.createDataFrame([], "a int, s string"), "e").collect()
    assert len(got) == 1 and got[0]["row_count"] == 0 and got[0]["note"] == P.NOTE_EMPTY
    nested = spark.createDataFrame([([1],)], "a array<int>")
    assert by_column(P.profile_table(nested))["a"]["note"] == P.NOTE_UNSUPPORTED


def test_sums_beyond_bigint(spark):
    big = 2**62
    df = spark.createDataFrame([(big,), (big,), (big,)], "v bigint")
    got = by_column(P.profile_table(df))["v"]
    assert got["int_sum"] == 3 * big and got["int_max"] == big


def test_same_for_any_order_and_partitioning(spark):
    rows = [(i % 7, math.sin(i) * 10 ** (i % 9), f"v{i % 13}", i % 3 == 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "i int, f double, s string, b boolean")
    first = by_column(P.profile_table(df))
    for other in (df.repartition(7, "s"), df.orderBy(F.desc("f")), df.coalesce(1)):
        got = by_column(P.profile_table(other))
        for c in first:
            std = got[c].pop("std_dev"), first[c]["std_dev"]
            assert std[0] == pytest.approx(std[1]) if std[1] is not None else std[0] is None
            assert got[c] == {k: v for k, v in first[c].items() if k != "std_dev"}


def test_many_columns(spark):
    df = spark.range(20).select(*[(F.col("id") * i).alias(f"c{i}") for i in range(130)])
    got = by_column(P.profile_table(df))
    assert len(got) == 130 and got["c129"]["sum"] == 129 * 190 and got["c2"]["median"] == 19.0


@pytest.mark.parametrize("listed", [1_000_000, 50, 5])
def test_medians(spark, monkeypatch, listed):
    """Exact however few values may be listed, for smooth, tied and extreme columns."""
    monkeypatch.setattr(M, "MOST_LISTED", listed)
    n = 5001
    rows = [
        (float(i * i % 9973), float(i % 3), 1.0 if i < 2600 else 2.0, math.exp(i / 50), float("-inf") if i < 3000 else 1.0)
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(5)
    got = M.exact_medians(df, list("abcde"))
    for i, c in enumerate("abcde"):
        assert got[c] == sorted(r[i] for r in rows)[n // 2], c


def test_even_medians_and_a_missed_bracket(spark, monkeypatch):
    df = spark.createDataFrame([(v,) for v in (1, 2, 10, 20)], "v int")
    assert M.exact_medians(df, ["v"]) == {"v": 6.0}
    monkeypatch.setattr(M, "MARGIN", 1e-9)
    wide = spark.range(200001).select((F.col("id") * 2).alias("v"))
    assert M.exact_medians(wide, ["v"]) == {"v": 200000.0}
    monkeypatch.setattr(M, "MOST_LISTED", 100)
    assert M.exact_medians(wide, ["v"]) == {"v": 200000.0}


def test_condense_and_json(spark, harvest):
    empty = spark.createDataFrame([], "a int")
    ids = spark.createDataFrame([(f"n{i}", 0.5 * i) for i in range(20)], "name string, x double")
    profile = P.profile_workspace({"Harvest": harvest, "Empty": empty, "Ids": ids})
    docs = {r["table"]: json.loads(r["json"]) for r in P.profile_to_json(profile).collect()}
    assert list(docs["Harvest"]["columns"]) == ["Orchard", "Fruit", "Crates", "Crew Size"]
    assert docs["Harvest"]["columns"]["Crates"]["sum"] == 25000
    assert docs["Ids"]["columns"]["x"]["sum"] == 95.0
    assert docs["Empty"]["row_count"] == 0 and docs["Empty"]["note"] == P.NOTE_EMPTY
    slim = {r["table"]: json.loads(r["json"]) for r in P.profile_to_json(P.condense(profile)).collect()}
    assert slim["Harvest"]["columns"]["Orchard"] == {
        "type": "categorical / text", "unique_values": 4, "top_values": {"Hill": 3, "Lake": 3, "Mill": 3},
    }
    assert slim["Ids"]["columns"]["name"]["identifier_like"] is True
    assert "top_values" not in slim["Ids"]["columns"]["name"]


def test_identifier_guard(spark):
    ids = spark.createDataFrame([(f"n{i}", "a") for i in range(20)], "`Client Name` string, kind string")
    specs = spark.createDataFrame(
        [(1, "t", ["clientname", "kind"]), (2, "other", ["Client Name"])],
        "id int, source_sheet string, data_columns array<string>",
    )
    got = {r["id"]: r["data_columns"] for r in P.drop_identifier_columns(specs, P.profile_table(ids, "t")).collect()}
    assert got == {1: ["kind"], 2: ["Client Name"]}
