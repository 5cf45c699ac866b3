"""Exact top-k search by inner product, with Fagin's threshold algorithm.

Components become integers, floor(1024 * x). Vectors are dealt by their row key to blocks of
about ``BLOCK``; a block is packed into one row with a list per dimension, the places of
its vectors in the order of that component. Queries are packed likewise and meet the blocks
in pairs, each in one task.

Within a block a query goes down all lists at once, from the end where its own component
makes the product largest, in steps of growing length. Vectors that turn up are scored in
full. The components at the depth that was reached bound the score of every vector that has
not turned up; once that threshold is below the k-th best score the rest can't enter, and
the search of the block ends. At a tie it goes on, as a smaller id may be among the rest. It
also ends when all vectors have turned up, which is the rule rather than the exception for
many dimensions without correlation.

The k-th score of a first block, searched beforehand, bounds the search of all others, so
that blocks without good candidates end early and send on little. Of each query the k best
of every block meet, ranked by the score and the smaller id, null ids last.

Vectors that are null or hold a null or a non-finite component take no part; missing
components at the end count as 0, so that empty vectors score 0. Repeated rows are
candidates of their own; a row is no candidate of its own query. Scores beyond a long are
held at its ends. A null id is no query. Columns beside the id and the vector don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, bounded_batches, in_batches, materialize, row_parts, rows_of, with_row_key

#: Factor of the components before they are rounded down.
SCALE = 1024
#: Vectors of a block, and queries of a pack, about.
BLOCK, PACK = 4096, 1024
#: Depth of the first step down the lists.
STEP = 16
#: Whole numbers up to here are exact as doubles.
EXACT = 2**53
LEAST, MOST = -(2**63), 2**63 - 1

PACKED = "part long, size int, ids array<long>, rf array<long>, ri array<long>, bounds array<long>, matrix binary, lists binary"
FOUND = pa.schema([("rf", pa.int64()), ("ri", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Row key, id and integer components of the vectors that take part."""
    rows = with_row_key(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding")))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    parts = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return rows.where(F.coalesce(finite, F.lit(False))).select(*row_parts(), "vec_id", parts.alias("parts"))


def _matrix(rows: list[list[int]]) -> np.ndarray:
    """Vectors as the rows of a matrix of small numbers, filled up with zeros."""
    wide = max(map(len, rows))
    whole = np.array([r + [0] * (wide - len(r)) for r in rows], np.int64).reshape(len(rows), wide)
    top = max(int(whole.max(initial=0)), -int(whole.min(initial=0)))
    return whole.astype(np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64)


def _pack(with_lists: bool):
    def run(table: pa.Table) -> pa.Table:
        matrix = _matrix(table["parts"].to_pylist())
        lists = np.argsort(matrix, axis=0, kind="stable").T.astype(np.uint32).tobytes() if with_lists else None
        row = {"part": [table["part"][0].as_py()], "size": pa.array([len(matrix)], pa.int32())}
        row |= {c: pa.array([table[n].to_pylist()], pa.list_(pa.int64())) for c, n in (("ids", "vec_id"), ("rf", "rf"), ("ri", "ri"), ("bounds", "bound"))}
        held = BytesIO()
        np.save(held, matrix)
        return pa.table(row | {"matrix": [held.getvalue()], "lists": pa.array([lists], pa.binary())})

    return run


def pack(rows: DataFrame, parts: int, lists: bool) -> DataFrame:
    """Vectors (rf, ri, vec_id, parts, bound) in ``parts`` parts, one row each."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("rf", "ri", F.lit(lists)), F.lit(parts)))
    return dealt.groupBy("part").applyInArrow(_pack(lists), PACKED)


def threshold_search(
    values: np.ndarray, lists: np.ndarray, query: np.ndarray, k: int, bound: int | None, own: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the vectors (rows of ``values``) that may be among the k best of
    a query: all with a score of at least the k-th best and of ``bound``. ``lists`` has the
    places by ascending component, a row per dimension; ``own`` places take no part."""
    size = len(values)
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    seen = np.zeros(size, bool)
    seen[own] = True
    places, scores = np.zeros(0, np.int64), np.zeros(0, values.dtype)
    depth, step, need = 0, STEP, bound
    while not seen.all():
        to = min(size, depth + step)
        turned_up = np.zeros(size, bool)
        turned_up[lists[up, size - to : size - depth]] = True
        turned_up[lists[down, depth:to]] = True
        if to == size:
            turned_up[:] = True  # which a query of zeros needs
        new = np.flatnonzero(turned_up & ~seen)
        seen |= turned_up
        if len(new):
            places = np.concatenate((places, new))
            scores = np.concatenate((scores, np.clip(values[new] @ query, LEAST, MOST)))
            if len(scores) >= k:
                kth = np.sort(scores)[-k]
                need = kth if need is None else max(need, kth)
            if need is not None:
                places, scores = places[scores >= need], scores[scores >= need]
        threshold = query[up] @ values[lists[up, size - to], up] + query[down] @ values[lists[down, to - 1], down]
        if need is not None and threshold < need:
            break
        depth, step = to, 2 * step
    return places, scores


def _search(k: int):
    def rows(batches):
        for size, ids, rf, ri, matrix, lists, q_size, q_ids, q_rf, q_ri, bounds, q_matrix in rows_of(batches):
            order = np.frombuffer(lists, np.uint32).reshape(-1, size).astype(np.int64)
            found, asked = (np.load(BytesIO(x)).astype(np.int64) for x in (matrix, q_matrix))
            both = min(found.shape[1], asked.shape[1])  # what one side lacks is zero
            found, asked, order = found[:, :both], asked[:, :both], order[:both]
            top = sum(int(x) * int(y) for x, y in zip(np.abs(found).max(axis=0, initial=0), np.abs(asked).max(axis=0, initial=0)))
            kind = np.float64 if top < EXACT else object
            found, asked = found.astype(kind), asked.astype(kind)
            keys = np.array([MOST if x is None else x for x in ids])
            rf, ri = np.array(rf), np.array(ri)
            for n in range(q_size):
                own = np.flatnonzero((ri == q_ri[n]) & (rf == q_rf[n]))
                places, scores = threshold_search(found, order, asked[n], k, bounds[n], own)
                best = np.lexsort((keys[places], -scores))[:k]
                for p, s in zip(places[best].tolist(), scores[best].tolist()):
                    yield q_rf[n], q_ri[n], q_ids[n], ids[p], int(s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from in_batches(rows(batches), FOUND)

    return run


def _search_pairs(blocks: DataFrame, packs: DataFrame, parts: int, k: int) -> DataFrame:
    """What queries find: ``packs`` has the number of the block that each meets in ``block``."""
    columns = ["size", "ids", "rf", "ri", "matrix"]
    asked = packs.select("block", *[F.col(c).alias(f"q_{c}") for c in columns], "bounds").repartition(parts, "block")
    met = blocks.withColumnRenamed("part", "block").drop("bounds").repartition(parts, "block").join(asked, "block")
    met = met.select(*columns, "lists", "q_size", "q_ids", "q_rf", "q_ri", "bounds", "q_matrix")
    return met.mapInArrow(_search(k), "rf long, ri long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """The k best candidates of each vector that meets the condition ``queries`` (on vec_id):
    query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = materialize(integer_vectors(vectors).withColumn("bound", F.lit(None).cast("long")))
    asked = rows.where(F.coalesce(queries, F.lit(False)))
    blocks, packs = (max(1, -(-frame.count() // size)) for frame, size in ((rows, BLOCK), (asked, PACK)))
    parts = min(3 * blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    index = materialize(pack(rows, blocks, lists=True))
    if blocks > 1:
        first = pack(asked, packs, lists=False).withColumn("block", F.pmod("part", F.lit(blocks)))
        seen = _search_pairs(index, first, parts, k).groupBy("rf", "ri").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
        bounds = seen.where(F.col("n") >= k).select("rf", "ri", F.col("least").alias("bound"))
        asked = asked.drop("bound").join(bounds, ["rf", "ri"], "left").select(*rows.columns)
    pairs = pack(asked, packs, lists=False).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found = _search_pairs(index, pairs, parts, k)
    rank = F.row_number().over(Window.partitionBy("rf", "ri").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
