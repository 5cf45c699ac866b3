"""Exact dedup by an exchange of Golomb-coded fingerprints.

Every task sorts the fingerprints of its rows and sends each owner (a range of
fingerprints) its part as Golomb-Rice coded gaps. Owners answer with one bit for each
fingerprint: seen more than once or not. Only rows whose bit is set, the suspects, are
shuffled as whole texts and compared byte by byte.

Null texts count as empty; empty texts equal each other. Of equal texts the row with the
most code points in the original stays, then the smallest doc_id (null last), then the
first row. Repeated rows are one group like any other. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, as_bytes, bounded_batches, in_batches, materialize, row_parts, rows_of, task_number, with_row_key

#: Bits of a fingerprint; more only make false suspects rarer.
FINGERPRINT_BITS = 56
#: Fingerprints that an owner holds at once, about.
OWNER_ROWS = 500_000
#: Rows that a task gathers before it sends them.
PIECE_ROWS = 200_000

PRINTS = pa.schema(
    [("rf", pa.int64()), ("ri", pa.int64()), ("doc_id", pa.int64()), ("n_points", pa.int64()), ("sha", pa.binary())]
    + [("piece", pa.int64()), ("owner", pa.int64()), ("place", pa.int32())]
    + [("first", pa.int64()), ("low_bits", pa.int32()), ("n", pa.int32()), ("high", pa.binary()), ("low", pa.binary())]
)
PRINTS_SQL = (
    "rf long, ri long, doc_id long, n_points long, sha binary, piece long, owner long, place int, "
    "first long, low_bits int, n int, high binary, low binary"
)


def golomb_encode(values: np.ndarray) -> tuple[int, int, int, bytes, bytes]:
    """Sorted distinct numbers as (first, bits of the low parts, count, high parts in unary, low parts)."""
    gaps = np.diff(values)
    mean = float(gaps.mean()) if len(gaps) else 1.0
    k = max(0, int(np.log2(max(mean, 1.0))))
    high, low = gaps >> k, gaps & ((1 << k) - 1)
    unary = np.zeros(int(high.sum()) + len(gaps), dtype=np.uint8)
    unary[np.cumsum(high + 1) - 1] = 1
    bits = ((low[:, None] >> np.arange(k)) & 1).astype(np.uint8) if k else np.zeros(0, np.uint8)
    return int(values[0]), k, len(values), np.packbits(unary).tobytes(), np.packbits(bits.ravel()).tobytes()


def golomb_decode(first: int, k: int, n: int, high: bytes, low: bytes) -> np.ndarray:
    """The numbers that ``golomb_encode`` was given."""
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8)))[: n - 1]
    gaps = np.diff(ends, prepend=-1) - 1 if n > 1 else np.zeros(0, np.int64)
    gaps = gaps.astype(np.int64) << k
    if k and n > 1:
        bits = np.unpackbits(np.frombuffer(low, np.uint8))[: (n - 1) * k].reshape(n - 1, k)
        gaps += bits.astype(np.int64) @ (np.int64(1) << np.arange(k, dtype=np.int64))
    return first + np.concatenate([[0], np.cumsum(gaps)]).astype(np.int64)


def send_fingerprints(owners: int):
    """Per task: its rows, each with its owner and place there, and the coded blocks."""
    shift = FINGERPRINT_BITS - (owners.bit_length() - 1)

    def one_piece(rows: list[tuple], piece: int) -> Iterator[tuple]:
        prints = np.array([int.from_bytes(r[4][:8], "big") >> (64 - FINGERPRINT_BITS) for r in rows], dtype=np.int64)
        values, inverse = np.unique(prints, return_inverse=True)
        owner = values >> shift
        starts = np.searchsorted(owner, np.arange(owners + 1))
        for row, v in zip(rows, inverse):
            o = int(owner[v])
            yield (*row, piece, o, int(v - starts[o]), None, None, None, None, None)
        for o in np.unique(owner):
            block = values[starts[o] : starts[o + 1]]
            yield (None, None, None, None, None, piece, int(o), None, *golomb_encode(block))
        # A value that the task has twice is a duplicate whatever the others have.
        twice = np.bincount(inverse, minlength=len(values)) > 1
        for o in np.unique(owner[twice]):
            block = values[twice & (owner == o)]
            yield (None, None, None, None, None, -1, int(o), None, *golomb_encode(block))

    def rows(batches):
        held, pieces = [], 0
        for rf, ri, doc_id, n_points, data in rows_of(batches):
            held.append((rf, ri, doc_id, n_points, hashlib.sha256(data.translate(None, SPACES)).digest()))
            if len(held) >= PIECE_ROWS:
                yield from one_piece(held, (task_number() << 20) | pieces)
                held, pieces = [], pieces + 1
        if held:
            yield from one_piece(held, (task_number() << 20) | pieces)

    return lambda batches: in_batches(rows(batches), PRINTS)


def answer(blocks: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmaps: for each piece, which of its fingerprints came more than once."""
    decoded = [golomb_decode(*r) for r in blocks[["first", "low_bits", "n", "high", "low"]].itertuples(index=False)]
    values, counts = np.unique(np.concatenate(decoded), return_counts=True)
    more = values[counts > 1]
    out = [
        (piece, owner, np.packbits(np.isin(v, more)).tobytes())
        for piece, owner, v in zip(blocks["piece"], blocks["owner"], decoded)
        if piece >= 0
    ]
    return pd.DataFrame(out, columns=["piece", "owner", "bits"])


def mark(rows: pd.DataFrame, bitmaps: pd.DataFrame) -> pd.DataFrame:
    """The rows of a piece with their bit."""
    by_owner = {o: np.unpackbits(np.frombuffer(b, np.uint8)) for o, b in zip(bitmaps["owner"], bitmaps["bits"])}
    rows["suspect"] = [bool(by_owner[o][p]) for o, p in zip(rows["owner"], rows["place"])]
    return rows[["rf", "ri", "doc_id", "n_points", "sha", "suspect"]]


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): keep_id, group_size, kept, text_sha256,
    and the row key (rf, ri) of the row itself."""
    bounded_batches(docs.sparkSession)
    keyed = with_row_key(docs.select("doc_id", "text"))
    owners = 1 << max(4, (keyed.count() // OWNER_ROWS).bit_length())
    points = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    prints = materialize(
        keyed.select(*row_parts(), F.col("doc_id").cast("long"), points.alias("n_points"), as_bytes("text").alias("data"))
        .mapInArrow(send_fingerprints(owners), PRINTS_SQL)
    )
    blocks = prints.where("high is not null").select("piece", "owner", "first", "low_bits", "n", "high", "low")
    bitmaps = blocks.groupBy("owner").applyInPandas(answer, "piece long, owner long, bits binary")
    own = prints.where("high is null").select("rf", "ri", "doc_id", "n_points", "sha", "piece", "owner", "place")
    marked = materialize(
        own.groupBy("piece")
        .cogroup(bitmaps.groupBy("piece"))
        .applyInPandas(mark, "rf long, ri long, doc_id long, n_points long, sha binary, suspect boolean")
    )
    suspects = marked.where("suspect")

    # The suspects' whole texts, compared byte by byte: one text for each digest.
    normal = F.translate(F.coalesce("text", F.lit("")), SPACES.decode(), "")
    texts = keyed.select(*row_parts(), normal.alias("normal")).join(suspects.select("rf", "ri"), ["rf", "ri"], "left_semi")
    same = texts.groupBy("normal").agg(F.count(F.lit(1)).alias("rows")).select(F.unhex(F.sha2("normal", 256)).alias("sha"), "rows")
    verified = same.groupBy("sha").agg(F.count(F.lit(1)).alias("texts"), F.sum("rows").alias("group_size"))
    differ = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts with one SHA-256"))).otherwise(F.col("group_size"))
    verified = verified.select("sha", differ.cast("long").alias("group_size"))

    order = F.struct("n_points", F.bitwise_not("doc_id").alias("small_id"), F.bitwise_not("rf").alias("f"), F.bitwise_not("ri").alias("i"))
    best = suspects.groupBy("sha").agg(F.max(order).alias("best")).join(verified, "sha")
    groups = best.select(
        "sha", "group_size", F.bitwise_not("best.small_id").alias("keep_id"),
        F.bitwise_not("best.f").alias("keep_f"), F.bitwise_not("best.i").alias("keep_i"),
    )
    hexed = F.lower(F.hex("sha")).alias("text_sha256")
    kept = (F.col("rf") == F.col("keep_f")) & (F.col("ri") == F.col("keep_i"))
    found = suspects.join(groups, "sha").select("doc_id", "keep_id", "group_size", kept.alias("kept"), hexed, "rf", "ri")
    alone = marked.where("not suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), hexed, "rf", "ri"
    )
    return found.unionByName(alone)
