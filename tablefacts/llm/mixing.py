"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the copies that each of its rows should get. The whole
part is given to every row; the fraction is rounded by the pivotal method: two rows with
fractional probabilities meet, and a random transfer of mass (words) from one to the other
makes one of them 0 or 1. The chances of the two directions keep every row's expectation,
and a transfer keeps the words taken, so a whole source misses its target by less than one
row. Rows meet in leaves (a hash bucket of one source); each leaf leaves one undecided row
at most, and those meet in a tree of fixed fan-in until a source has one, which is drawn.

Sizes are words; a null text has none, and rows of size 0 are drawn on their own. A null
source is a source, the last. Draws depend on doc_id, place in the file and seed only, so
reruns over the same files agree. Repeated rows are rows of their own. Other columns are kept by
``mixed_documents`` and not read by ``mix_sources``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize, row_parts, with_row_key

#: Weights of the sources in order, repeating; share of all words to take; copies at most.
WEIGHTS, SHARE, MOST_COPIES = (5.0, 2.0, 1.0), 1.5, 2.0
#: Rows of a leaf, and undecided rows that meet in a node of the tree.
LEAF_ROWS, FAN_IN = 4096, 64


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """One row per source: rows, size, target, copies per row.

    Sources are filled evenly by weight until the least filled of them is full (``most``
    times its size); what is left goes to the others by weight, and so on. The frame has a
    row per source, so its windows are small."""
    sources = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    sources = sources.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    total = F.lit(float(share)) * F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    sources = sources.select("*", (left / open_weight).alias("level"), F.row_number().over(fill).alias("place"))
    sources = sources.withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("full"), F.struct("place", "level"))).over(everything)
    target = F.when(level.isNull() | (F.col("place") < level["place"]), F.col("cap")).otherwise(level["level"] * F.col("weight"))
    return sources.select("source", "rows", F.col("source_size").cast("long"), target.alias("target")).withColumn(
        "copies", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    )


def pivot(size: np.ndarray, p: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Round probabilities of rows in their order; one row at most stays fractional."""
    out, held, draws = p.copy(), -1, random.random(len(p))
    near = 1e-9
    for j in range(len(p)):
        if not near < out[j] < 1 - near:
            out[j] = round(out[j])
            continue
        if size[j] <= 0:
            out[j] = float(draws[j] < out[j])
            continue
        if held < 0:
            held = j
            continue
        a, b = size[held], size[j]
        up, down = min((1 - out[held]) * a, out[j] * b), min(out[held] * a, (1 - out[j]) * b)
        moved = up if draws[j] * (up + down) < down else -down
        out[held] += moved / a
        out[j] -= moved / b
        for k in (held, j):
            if not near < out[k] < 1 - near:
                out[k] = round(out[k])
        held = held if 0 < out[held] < 1 else j if 0 < out[j] < 1 else -1
    return out


STATE = "rf long, ri long, doc_id long, source string, size long, whole int, p double, leaf long"


def _round_group(seed: int, level: int):
    def rounded(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "ri", "rf"], ascending=[False, True, True, True], kind="mergesort").reset_index(drop=True)
        key = [seed, level, int(rows["leaf"].iloc[0]), int(rows["ri"].iloc[0]) & (2**63 - 1), len(rows)]
        rows["p"] = pivot(rows["size"].to_numpy(float), rows["p"].to_numpy(float), np.random.default_rng(key))
        return rows[["rf", "ri", "doc_id", "source", "size", "whole", "p", "leaf"]]

    return rounded


def words_of(name: str) -> Column:
    return F.coalesce(F.regexp_count(name, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def mix_sources(keyed: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: int = 7) -> DataFrame:
    """How often the mix takes each row of ``keyed`` (with a row key, doc_id, text, source):
    rf, ri, doc_id, source, size, source_size, target, copies, taken."""
    sizes = materialize(
        keyed.select(*row_parts(), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_of("text").alias("size"))
    )
    targets = materialize(source_targets(sizes, weights, share, most))
    named = targets.withColumnRenamed("source", "s")
    rows = sizes.join(named, F.col("source").eqNullSafe(F.col("s"))).select(
        "rf", "ri", "doc_id", "source", "size",
        F.floor("copies").cast("int").alias("whole"),
        (F.col("copies") - F.floor("copies")).alias("p"),
        F.pmod(F.xxhash64("doc_id", "ri", F.lit(seed)), F.ceil(F.col("rows") / LEAF_ROWS)).alias("leaf"),
    )
    most_rows = targets.agg(F.max("rows")).first()[0] or 0
    state = materialize(rows.groupBy("source", "leaf").applyInPandas(_round_group(seed, 0), STATE))
    undecided = (F.col("p") > 0) & (F.col("p") < 1)
    decided, level, leaves = [state.where(~undecided)], 0, -(-most_rows // LEAF_ROWS)
    while leaves > 1:
        level, leaves = level + 1, -(-leaves // FAN_IN)
        met = state.where(undecided).withColumn("leaf", F.floor(F.col("leaf") / FAN_IN).cast("long"))
        state = materialize(met.groupBy("source", "leaf").applyInPandas(_round_group(seed, level), STATE))
        decided.append(state.where(~undecided))
    chance = F.pmod(F.xxhash64("doc_id", "ri", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
    decided.append(state.where(undecided).withColumn("p", (chance < F.col("p")).cast("double")))
    whole = decided[0]
    for frame in decided[1:]:
        whole = whole.unionByName(frame)
    copies = (F.col("whole") + F.col("p").cast("int")).cast("int")
    known = targets.select(F.col("source").alias("s"), "source_size", "target")
    return whole.join(known, F.col("source").eqNullSafe(F.col("s"))).select(
        "rf", "ri", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    keyed = with_row_key(docs)
    mix = mix_sources(keyed, **options).where("copies > 0").select("rf", "ri", F.col("copies").alias("__copies"))
    own = [F.col(f"`{c}`").alias(f"d_{c}") for c in docs.columns]
    rows = keyed.select(*own, *row_parts()).join(mix, ["rf", "ri"])
    return rows.select("*", F.explode(F.sequence(F.lit(1), "__copies")).alias("__copy")).select(*[F.col(f"`d_{c}`").alias(c) for c in docs.columns])
