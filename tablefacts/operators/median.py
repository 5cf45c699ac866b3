"""Exact medians of large columns without sorting or gathering them.

A mergeable quantile sketch proposes a narrow bracket around each median. One counting
pass then finds the median in it, or shows that the bracket missed: values below the
bracket collapse into one counter map-side, and only the values inside are grouped.
A bracket expected to hold too many values is sketched again first, which divides its
content by about a hundred. The sketch only decides how much there is to count.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col

SKETCH_SIZE = 2000
MARGIN = 0.005
"""Half width of a new bracket, in rank; about twice the rank error of the sketch."""

STEPS = 400
"""Quantiles read from a sketch, evenly spaced."""

MERGE_GROUPS = 64
"""Sketches of many tasks are first merged in this many groups, then once more."""

MOST_LISTED = 1_000_000
"""Most values inside a bracket that are grouped and ranked."""

COLUMNS_PER_JOB = 64

INFINITY = float("inf")


@dataclass
class Bracket:
    """Closed bounds around the median of ``rows`` values, and how many of them are
    expected strictly between the bounds; unknown before the first sketch."""

    margin: float
    rows: int = 0
    between: float = INFINITY
    low: float = -INFINITY
    high: float = INFINITY


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Median per numeric column; ``None`` for a column without values."""
    medians: dict[str, float | None] = {}
    for start in range(0, len(columns), COLUMNS_PER_JOB):
        medians |= _medians(df, columns[start : start + COLUMNS_PER_JOB])
    return medians


def _medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    medians: dict[str, float | None] = {}
    open_ = {c: Bracket(MARGIN) for c in columns}
    while open_:
        wide = {c: b for c, b in open_.items() if b.between > MOST_LISTED}
        if wide:
            _narrow(df, wide)
            empty = [c for c, b in open_.items() if b.rows == 0]
            medians |= {c: None for c in empty}
            open_ = {c: b for c, b in open_.items() if c not in empty}
            continue
        for name, median in _count_inside(df, open_).items():
            if median is None:
                open_[name] = Bracket(min(0.5, open_[name].margin * 4))
            else:
                medians[name] = median
                del open_[name]
    return medians


def _narrow(df: DataFrame, brackets: dict[str, Bracket]) -> None:
    """Sketch what lies strictly inside each bracket and move its bounds inwards."""
    partial, merged, picked = [], [], []
    grid = [step / STEPS for step in range(STEPS + 1)]
    for i, (name, b) in enumerate(brackets.items()):
        v = col(name).cast("double")
        fresh = b.rows == 0
        inside = v if fresh else F.when((v > b.low) & (v < b.high), v)
        upto = F.lit(0) if fresh else F.count(F.when(v <= b.low, 1))
        partial += [
            F.kll_sketch_agg_double(inside, F.lit(SKETCH_SIZE)).alias(f"s{i}"),
            upto.alias(f"upto{i}"),
            F.count(inside).alias(f"in{i}"),
        ]
        merged += [
            F.kll_merge_agg_double(f"s{i}", F.lit(SKETCH_SIZE)).alias(f"s{i}"),
            F.sum(f"upto{i}").alias(f"upto{i}"),
            F.sum(f"in{i}").alias(f"in{i}"),
        ]
        ranks = [max(0.5 - b.margin, 0.0), min(0.5 + b.margin, 1.0)] if fresh else grid
        sketch = F.when(F.col(f"in{i}") > 0, F.col(f"s{i}"))
        picked += [
            F.kll_sketch_get_quantile_double(sketch, F.array(*map(F.lit, ranks))).alias(f"q{i}"),
            F.col(f"upto{i}"),
            F.col(f"in{i}"),
        ]
    groups = df.groupBy((F.spark_partition_id() % MERGE_GROUPS).alias("g")).agg(*partial)
    row = groups.agg(*merged).select(*picked).first()
    for i, b in enumerate(brackets.values()):
        within, quantiles = row[f"in{i}"] or 0, row[f"q{i}"]
        if not within:
            b.between = 0
            continue
        if not b.rows:
            b.rows, (b.low, b.high) = within, quantiles
            b.between = within * 2 * b.margin
            continue
        middle = ((b.rows - 1) / 2 - row[f"upto{i}"]) / within
        left = math.floor((middle - MARGIN) * STEPS)
        right = math.ceil((middle + MARGIN) * STEPS)
        b.low = quantiles[min(left, STEPS)] if left > 0 else b.low
        b.high = quantiles[max(right, 0)] if right < STEPS else b.high
        b.between = within * (min(right, STEPS) - max(left, 0)) / STEPS


def _count_inside(df: DataFrame, brackets: dict[str, Bracket]) -> dict[str, float | None]:
    """Medians found by counting; ``None`` for a bracket that does not hold its median."""
    names = list(brackets)
    ids = [str(i) for i in range(len(names))]
    values, ranks = [], []
    for i, name in zip(ids, names):
        b, v, n = brackets[name], col(name).cast("double"), brackets[name].rows
        values.append(F.when(v < b.low, F.lit(-INFINITY)).when(v <= b.high, v).alias(i))
        ranks += [F.lit(i), F.array(F.lit((n - 1) // 2), F.lit(n // 2))]
    tally = (
        df.select(*values)
        .unpivot([], ids, "i", "v")
        .where(F.col("v").isNotNull())
        .groupBy("i", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Bounded: a column has about `between` values here, whatever the size of the table.
    running = Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    place = tally.select("i", "v", "n", F.sum("n").over(running).alias("upto"))
    rank = F.create_map(*ranks)[F.col("i")]

    def value_at(r):
        return F.max(F.when((F.col("upto") > r) & (F.col("upto") - F.col("n") <= r), F.col("v")))

    middle = place.groupBy("i").agg(value_at(rank[0]).alias("a"), value_at(rank[1]).alias("b"))
    medians: dict[str, float | None] = {name: None for name in names}
    for row in middle.collect():
        name, (a, b) = names[int(row["i"])], (row["a"], row["b"])
        missed = a == -INFINITY and brackets[name].low > -INFINITY
        if a is not None and b is not None and not missed:
            medians[name] = (a + b) / 2
    return medians
