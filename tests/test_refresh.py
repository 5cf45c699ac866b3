"""Profiles put together from the kept states of files equal those of full runs."""

import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tablefacts.operators.profile import profile_workspace
from tablefacts.sources import refresh as R
from tablefacts.sources.workspace import load_workspace

SCHEMA = (
    "n long, x double, f float, d decimal(12,2), ok boolean, day date, at timestamp, `odd ``name` string, "
    "dated string, mixed string, id string, long string, none string, parts array<int>"
)


def part(spark, seed, rows=60):
    rng = random.Random(seed)
    made = spark.range(rows).select(F.col("id").alias("k"), F.rand(seed).alias("r"))
    cut = int(rows * 0.7)
    text = F.concat(F.lit("x" * 140), (F.col("k") % 3).cast("string"))
    return made.select(
        F.when(F.col("k") % 7 != 0, (F.col("r") * 1000).cast("long")).alias("n"),
        F.when(F.col("k") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("r") * 1e6 - 4e5).alias("x"),
        (F.col("r") / 3).cast("float").alias("f"),
        (F.col("r") * 500).cast("decimal(12,2)").alias("d"),
        F.when(F.col("k") % 5 != 0, F.col("r") > 0.4).alias("ok"),
        F.date_add(F.lit("2021-03-01").cast("date"), (F.col("r") * 300).cast("int")).alias("day"),
        F.timestamp_seconds((F.col("r") * 1e9).cast("long")).alias("at"),
        F.concat(F.lit("v"), (F.col("k") % 4).cast("string")).alias("odd `name"),
        F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("r") * 900).cast("int")), "MM/dd/yyyy").alias("dated"),
        F.when(F.col("k") < cut, F.lit("2020-02-03")).otherwise(F.concat(F.lit(" t"), F.lit(rng.randint(0, 9)))).alias("mixed"),
        F.concat(F.lit(f"id {seed} "), F.col("k")).alias("id"),
        text.alias("long"),
        F.lit(None).cast("string").alias("none"),
        F.array(F.col("k").cast("int")).alias("parts"),
    )


def rows(frame):
    return sorted((r.asDict(recursive=True) for r in frame.collect()), key=lambda r: (r["table"], r["ordinal"] or 0))


def check(spark, folder, state, tables=None):
    got = rows(R.refresh_profile(spark, folder, state, tables))
    full = load_workspace(spark, folder)
    want = rows(profile_workspace({n: t for n, t in full.items() if tables is None or n in tables}))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for k in b:
            if isinstance(b[k], float):
                assert math.isclose(a[k], b[k], rel_tol=1e-12, abs_tol=1e-4), (b["column"], k)
            else:
                assert a[k] == b[k], (b["column"], k)
    return got


def seen(spark, folder, state, name):
    return [Path(p).name for p in R.unread_files(spark, f"{folder}/{name}", state, name)]


def test_only_new_files_are_read(spark, tmp_path):
    folder, state = str(tmp_path / "my work+space"), str(tmp_path / "state")
    for seed in (1, 2, 3):
        part(spark, seed).repartition(2).write.mode("append").parquet(f"{folder}/sales")
    assert len(seen(spark, folder, state, "sales")) == 6
    first = check(spark, folder, state)
    assert seen(spark, folder, state, "sales") == []
    part(spark, 4).coalesce(1).write.mode("append").parquet(f"{folder}/sales")
    assert len(seen(spark, folder, state, "sales")) == 1
    # What lies in the states is used as it is: with old files unreadable, only the new one is read.
    states = R._Table(spark, "sales", f"{folder}/sales", state)
    read = states._read(list(states.unknown().values()))
    assert len(read.inputFiles()) == 1 and read.count() == 60
    again = check(spark, folder, state)
    assert [r["row_count"] for r in (first[0], again[0])] == [180, 240]
    assert {r["label"] for r in again if r["column"] in ("dated", "mixed")} == {"datetime (inferred)"}


def test_files_that_go_or_change(spark, tmp_path):
    folder, state = str(tmp_path / "w"), str(tmp_path / "state")
    for seed in (1, 2):
        part(spark, seed).coalesce(1).write.mode("append").parquet(f"{folder}/t.parquet")
    check(spark, folder, state)
    old = sorted(Path(f"{folder}/t.parquet").glob("*.parquet"))
    part(spark, 9, rows=31).coalesce(1).write.parquet(str(tmp_path / "other"))
    new = next((tmp_path / "other").glob("*.parquet")).read_bytes()
    old[0].write_bytes(new)  # another size under the old name
    for crc in Path(f"{folder}/t.parquet").glob(".*.crc"):
        crc.write_bytes(b"")
        crc.unlink()
    assert check(spark, folder, state)[0]["row_count"] == 91
    old[1].unlink()
    assert check(spark, folder, state)[0]["row_count"] == 31


def test_runs_that_die_and_run_twice(spark, tmp_path):
    folder, state = str(tmp_path / "w"), str(tmp_path / "state")
    part(spark, 1).coalesce(1).write.parquet(f"{folder}/t")
    table = R._Table(spark, "t", f"{folder}/t", state)
    before = R._Table(spark, "t", f"{folder}/t", state)
    table.keep_states()
    before.unknown = lambda: dict(before.files)  # a run that began before the other had ended
    before.keep_states()
    assert len(table.batches()) == 2
    broken = f"{table.root}/batch-broken"
    part(spark, 2).select("n").write.parquet(f"{broken}/numbers")
    assert check(spark, folder, state)[0]["row_count"] == 60
    assert R.sweep_states(spark, state) == []
    assert R.sweep_states(spark, state, grace=0) == ["batch-broken"]
    assert len(table.batches()) == 2
    assert check(spark, folder, state)[0]["row_count"] == 60


def test_empty_files_partitions_and_new_columns(spark, tmp_path):
    folder, state = str(tmp_path / "w"), str(tmp_path / "state")
    part(spark, 1).limit(0).write.parquet(f"{folder}/nothing")
    part(spark, 2).withColumn("area", F.when(F.col("n") > 500, "north").otherwise("south")).write.partitionBy("area").parquet(f"{folder}/areas")
    check(spark, folder, state)
    assert seen(spark, folder, state, "nothing") == seen(spark, folder, state, "areas") == []
    part(spark, 3).withColumn("more", F.lit(1)).write.mode("overwrite").parquet(f"{folder}/nothing")
    assert check(spark, folder, state, ["nothing"])[-1]["column"] == "more"


def test_other_formats_are_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="land them first: a"):
        R.refresh_profile(spark, str(tmp_path), str(tmp_path / "state"))


@pytest.mark.parametrize("most", [1, 50, 1_000_000])
def test_counted_medians(spark, monkeypatch, most):
    monkeypatch.setattr(R, "MOST_RANKED", most)
    rng = random.Random(5)
    inf = float("inf")
    columns = {
        "even": [1.0, 2.0, 3.0, 10.0],
        "ties": [5.0] * 700 + [1.0] * 300,
        "halves": [1.0] * 50 + [2.0] * 50,
        "wide": [rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300) for _ in range(999)],
        "ends": [-inf] * 40 + [inf] * 41,
        "one": [7.0],
    }
    data = [(c, v, 1) for c, vs in columns.items() for v in vs] + [("even", 2.0, 3)]
    columns["even"] += [2.0] * 3
    got = R.counted_medians(spark.createDataFrame(data, "column string, value double, count long").repartition(6))
    for c, vs in columns.items():
        vs = sorted(vs)
        assert got[c] == (vs[(len(vs) - 1) // 2] + vs[len(vs) // 2]) / 2, c
    assert R.counted_medians(spark.createDataFrame([], "column string, value double, count long")) == {}
