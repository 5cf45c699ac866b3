"""Text columns whose values mostly differ are counted by hashes, with equal results."""

import random

import pytest

from tablefacts.operators import profile as P


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(9)
    names = [f"name {k}" for k in range(700)] + ["name 3"] * 5 + ["name 7"] * 5 + ["name 9"]
    half = [f"half {rng.randint(0, 500)}" for _ in range(len(names) - 1)] + [None]
    long = ["x" * 150 + str(rng.randint(0, 450)) for _ in names]
    pairs = [f"pair {k * 2 // 3}" for k in range(len(names))]
    few = [rng.choice("abc") for _ in names]
    rows = list(zip(names, half, long, pairs, few, [None] * len(names)))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "name string, half string, long string, pair string, few string, none string").repartition(5)


def rows(frame):
    return [r.asDict(recursive=True) for r in frame.orderBy("ordinal").collect()]


@pytest.mark.parametrize("most", [100_000, 20])
def test_profiles_are_equal(texts, monkeypatch, most):
    plain = rows(P.profile_table(texts, "t"))
    assert P.text_facts(texts, texts.columns)[1] == set()
    monkeypatch.setattr(P, "VARIED_FROM", 10)
    monkeypatch.setattr(P, "MOST_CANDIDATES", most)  # equal counts are ranked by texts of all values below
    assert P.text_facts(texts, texts.columns)[1] == {"name", "half", "long", "pair"}
    hashed = rows(P.profile_table(texts, "t"))
    assert hashed == plain
    assert [r["identifier_like"] for r in plain] == [True, False, False, False, False, None]


def test_a_wrong_estimate_changes_nothing(texts, monkeypatch):
    plain = rows(P.profile_table(texts, "t"))
    monkeypatch.setattr(P, "VARIED_FROM", 0)
    monkeypatch.setattr(P, "VARIED_RATIO", 0.0)  # all columns are taken for varied ones
    assert rows(P.profile_table(texts, "t")) == plain


def test_shuffles_carry_no_texts(texts):
    plan = P.hashed_frequencies(texts, ["name", "long"])._jdf.queryExecution().executedPlan().toString()
    exchange = next(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    assert "h1" in exchange and "value" not in exchange and "head" not in exchange
    flags = {r["column"]: tuple(r)[1:] for r in P.identifier_flags(texts, ["name", "few"]).collect()}
    assert flags == {"name": (711, 700, True), "few": (711, 3, False)}
