"""Random small tables: statistics, KPIs and series against plain pandas."""

import math

import numpy as np
import pandas as pd
import pytest

from tablefacts.operators.facts import insight_facts
from tablefacts.operators.kpi import compute_kpis
from tablefacts.operators.profile import profile_table
from tablefacts.operators.series import chart_series

SCHEMA = "k string, g bigint, i bigint, f double, b boolean, t timestamp_ntz"


def random_rows(seed: int, n: int) -> list[tuple]:
    rng = np.random.default_rng(seed)

    def maybe(value):
        return None if rng.random() < 0.15 else value

    day = pd.Timestamp("2024-01-01")
    return [
        (
            maybe("abcdefgh"[int(rng.integers(0, 8))]),
            maybe(int(rng.integers(-3, 4))),
            maybe(int(rng.integers(-1000, 1000))),
            maybe(float(np.round(rng.normal(0, 100), 3))),
            maybe(bool(rng.integers(0, 2))),
            maybe((day + pd.Timedelta(seconds=int(rng.integers(0, 10**7)))).to_pydatetime()),
        )
        for _ in range(n)
    ]


@pytest.fixture(scope="module", params=[(1, 7), (2, 60), (3, 400)])
def pair(request, spark):
    rows = random_rows(*request.param)
    frame = pd.DataFrame(rows, columns=["k", "g", "i", "f", "b", "t"])
    return spark.createDataFrame(rows, SCHEMA).repartition(3), frame


def close(a, b):
    return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def test_numeric_statistics(pair):
    df, frame = pair
    got = {r["column"]: r for r in profile_table(df).collect()}
    for c in ("g", "i", "f"):
        clean = frame[c].dropna().astype(float)
        row = got[c]
        assert row["non_null"] == len(clean) and row["count"] == len(frame)
        assert row["missing_pct"] == round(frame[c].isna().sum() / len(frame) * 100, 1)
        for field, value in (
            ("sum", clean.sum()), ("mean", clean.mean()), ("median", clean.median()), ("min", clean.min()),
            ("max", clean.max()), ("std_dev", clean.std()),
        ):
            assert abs(row[field] - value) < 1.01e-4, (c, field)


def test_other_statistics(pair):
    df, frame = pair
    got = {r["column"]: r for r in profile_table(df).collect()}
    counts = frame["k"].value_counts()
    expected = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:5]
    assert got["k"]["unique_values"] == len(counts)
    if got["k"]["top_values"]:
        assert [(t["value"], t["count"]) for t in got["k"]["top_values"]] == expected
    t = frame["t"].dropna()
    assert got["t"]["min_date"] == t.min().isoformat() and got["t"]["max_date"] == t.max().isoformat()
    assert got["t"]["date_range_days"] == (t.max() - t.min()).days
    b = frame["b"].dropna().astype(bool)
    assert (got["b"]["true_count"], got["b"]["false_count"]) == (b.sum(), (~b).sum())


def shown(text, winner):
    """The number in brackets after the winner."""
    head, _, rest = text.rpartition(" (")
    assert head == winner and rest.endswith(")")
    return float(rest[:-1].replace(",", ""))


@pytest.mark.parametrize("agg", ["sum", "mean", "count", "max", "min"])
@pytest.mark.parametrize("value", ["i", "f", "b"])
def test_grouped_kpis(pair, agg, value):
    df, frame = pair
    column = frame[value].astype(float) if value != "f" else frame[value]
    grouped = column.groupby(frame["k"]).agg(agg)
    specs = [
        {"label": w, "type": "extreme_category", "group_by": "k", "value_col": value, "agg": agg, "which": w}
        for w in ("min", "max")
    ] + [{"label": "avg", "type": "avg_per_group", "group_by": "k", "value_col": value, "agg": agg}]
    got = {r["label"]: r for r in compute_kpis(df, specs).collect()}
    kept = grouped.dropna()
    for which, best in (("min", kept.min()), ("max", kept.max())):
        winner = next((k for k in sorted(kept.index) if close(kept[k], best)), None)
        assert got[which]["key"] == winner
        if value == "b" and agg in ("max", "min"):
            assert got[which]["formatted"] == f"{winner} ({bool(best)})"
        else:
            assert close(got[which]["value"], best)
            assert abs(shown(got[which]["formatted"], winner) - best) <= 0.0501
    if not (value == "b" and agg in ("max", "min")):
        assert close(got["avg"]["value"], grouped.mean())


def test_scalar_kpis(pair):
    df, frame = pair
    specs = [
        {"label": "r", "type": "filtered_rate", "filter_col": "k", "filter_contains": "[A-C]"},
        {"label": "s", "type": "filtered_sum", "filter_col": "k", "filter_contains": "a|h", "value_col": "f"},
        {"label": "p", "type": "peak_point", "x_col": "t", "value_col": "i"},
    ]
    got = {r["label"]: r for r in compute_kpis(df, specs).collect()}
    hit = frame["k"].str.contains("[A-C]", case=False, na=False)
    assert close(got["r"]["value"], hit.sum() / len(frame) * 100)
    some = frame["k"].str.contains("a|h", case=False, na=False)
    assert close(got["s"]["value"], frame.loc[some, "f"].sum())
    assert got["p"]["value"] == frame["i"].max()


def test_facts(pair):
    df, frame = pair
    got = insight_facts(df, ["k", "f"]).first()
    sums = frame.groupby("k")["f"].sum()
    ranked = sorted(sums.items(), key=lambda kv: (-kv[1], kv[0]))
    assert (got["top_category"], got["top_value"]) == (ranked[0][0], f"{ranked[0][1]:,.2f}")
    assert (got["second_category"], got["second_value"]) == (ranked[1][0], f"{ranked[1][1]:,.2f}")
    assert (got["bottom_category"], got["bottom_value"]) == (ranked[-1][0], f"{ranked[-1][1]:,.2f}")
    assert got["top_pct"] == f"{ranked[0][1] / sums.sum() * 100:.1f}%"
    assert got["mean_value"] == f"{sums.mean():,.2f}" and got["count"] == f"{len(sums):,}"


def points(df, columns, kind):
    rows = chart_series(df, columns, kind).orderBy("series_idx", "ord").collect()
    return [(r["category"], r["series"], r["value"]) for r in rows]


def test_bar_series(pair):
    df, frame = pair
    got = points(df, ["g", "f", "k"], "bar")
    grouped = frame.groupby("g").agg({"f": "sum", "k": "count"})
    expected = [(str(int(g)), c, float(v)) for c in ("f", "k") for g, v in grouped[c].items()]
    assert [p[:2] for p in got] == [p[:2] for p in expected]
    assert all(close(a[2], b[2]) for a, b in zip(got, expected))


def test_line_series(pair):
    df, frame = pair
    got = points(df, ["t", "f", "i"], "line")
    if len(frame) <= 20:
        ordered = frame.sort_values("t")
        expected = [
            ("NaT" if pd.isna(t) else str(t), c, 0.0 if pd.isna(v) else float(v))
            for c in ("f", "i") for t, v in zip(ordered["t"], ordered[c])
        ]
    else:
        means = frame.groupby("t")[["f", "i"]].mean()
        expected = [(str(t), c, 0.0 if pd.isna(v) else float(v)) for c in ("f", "i") for t, v in means[c].items()]
    assert [p[:2] for p in got] == [p[:2] for p in expected]
    if len(frame) > 20:
        assert all(close(a[2], b[2]) for a, b in zip(got, expected))
    else:
        assert sorted(got) == sorted(expected)
