"""Near-dedup by b-bit MinHash.

1. Every text becomes its set of five-word shingles (A-Z lower-cased). Equal sets are one
   class from here on, so copies cost nothing below.
2. Of each class, minima under 252 hash functions make 36 band keys of 7 minima each. A pair
   at the threshold shares a band but for one case in a million. Of the classes that share
   a band with another, 1008 minima are kept by their low 4 bits, packed into 504 bytes.
3. Classes that share a band key are candidates. First only those with the class that
   shares most (a star, never all pairs of a bucket); links so found make components.
   Then, in each bucket that still has several components, members outside the component
   of its star are compared with the rest in blocks, inside tasks.
4. A candidate's similarity is estimated by bit counts of the packed signatures, less
   chance agreement; what is more than four standard errors below the threshold goes.
5. What is left is confirmed on the full sets, and the links give the components.

Null and blank texts have no shingles and link with nothing. A text of fewer than five
words is one shingle. Null doc_ids sort last: a component without any id has a null
component_id. Of rows that repeat the least doc_id one stays; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, as_bytes, bounded_batches, in_batches, materialize, mix, row_parts, rows_of, signed, window_hashes, with_row_key
from .components import components

SHINGLE, THRESHOLD = 5, 85
BANDS, ROWS = 36, 7
#: Minima of a packed signature, and the bits kept of each.
HASHES, BITS = 1008, 4
#: Standard errors that an estimate may lie below the threshold.
ERRORS = 4.0
#: Members of a bucket that are compared as one block.
BLOCK = 512

_random = np.random.default_rng(20240229)
FACTORS = _random.integers(1, 2**32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
SHIFTS = _random.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)


def shingles(data: bytes, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text."""
    return np.unique(window_hashes(hashes.all(data.lower().split()), size))


def minima(found: np.ndarray, hashes: int, step: int = 1024) -> np.ndarray:
    """The least value under each of the first hash functions; a long text in steps."""
    low = mix(found).astype(np.uint32)
    least = np.full(hashes, 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(low), step):
        part = low[at : at + step]
        values = part[None, :] * FACTORS[:hashes, None] + SHIFTS[:hashes, None]
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x2C1B3C6D)
        values ^= values >> np.uint32(13)
        np.minimum(least, values.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    table = least.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key + table[:, r] * np.uint64(0x9E3779B97F4A7C15))
    return key


def packed(least: np.ndarray) -> bytes:
    """The low four bits of each minimum, two to a byte."""
    low = (least & np.uint32(15)).astype(np.uint8)
    return ((low[0::2] << 4) | low[1::2]).tobytes()


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of signatures (rows of bytes), corrected for chance agreement."""
    x = a ^ b
    x = (x | (x >> np.uint8(2))) & np.uint8(0x33)
    x = (x | (x >> np.uint8(1))) & np.uint8(0x11)
    same = HASHES - np.bitwise_count(x).sum(axis=-1, dtype=np.int32)
    chance = 1 / (1 << BITS)
    return (same / HASHES - chance) / (1 - chance)


def least_estimate(threshold: int = THRESHOLD) -> float:
    """What an estimate must reach for the pair to be confirmed."""
    t, chance = threshold / 100, 1 / (1 << BITS)
    agree = t + (1 - t) * chance
    return t - ERRORS * np.sqrt(agree * (1 - agree) / HASHES) / (1 - chance)


SIGNED = pa.schema(
    [("rf", pa.int64()), ("ri", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64())]
    + [("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64()))]
)
SIGNED_SQL = "rf long, ri long, doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()

    def rows():
        for rf, ri, doc_id, data in rows_of(batches):
            found = shingles(data, hashes)
            if not len(found):
                yield rf, ri, doc_id, 0, None, None, None
                continue
            s1, s2 = (signed(np.array([mix(found ^ np.uint64(k)).sum(dtype=np.uint64)])) for k in (0x5851F42D4C957F2D, 0x14057B7EF767814F))
            yield rf, ri, doc_id, len(found), int(s1[0]), int(s2[0]), signed(band_keys(minima(found, BANDS * ROWS))).tolist()

    return in_batches(rows(), SIGNED, size=1000)


MEMBERS = pa.schema([("rep", pa.int64()), ("data", pa.binary()), ("signature", pa.binary())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    return in_batches(((rep, data, packed(minima(shingles(data, hashes), HASHES))) for rep, data in rows_of(batches)), MEMBERS, size=1000)


def _signature_matrix(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _estimated(limit: float):
    """Keep the pairs (a, b) whose signatures agree enough."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (_signature_matrix(batch.column(n).to_pylist()) for n in ("sig_a", "sig_b"))
                yield batch.select(["a", "b"]).filter(pa.array(agreement(a, b) >= limit))

    return run


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compared(limit: float):
    """Pairs of different components in each cell; cells come as runs of sorted rows."""

    def run(batches):
        def rows():
            for _, cell in groupby(rows_of(batches), key=lambda r: r[:4]):
                cell = list(cell)
                kind, first, second = cell[0][1:4]
                if kind == 0:
                    left, right = ([r for r in cell if r[4] == side] for side in (0, 1))
                else:
                    left = [r for r in cell if r[5] == first]
                    right = left if first == second else [r for r in cell if r[5] == second]
                if not left or not right:
                    continue
                sig, comp = _signature_matrix([r[8] for r in right]), np.array([r[7] for r in right])
                rep = np.array([r[6] for r in right])
                for r in left:
                    near = agreement(np.frombuffer(r[8], np.uint8)[None, :], sig) >= limit
                    near &= comp != r[7]
                    if left is right:
                        near &= rep > r[6]
                    for k in np.flatnonzero(near):
                        other = right[k]
                        # The least key that both have is the one that tells.
                        if min(set(r[9]).intersection(other[9])) == r[0]:
                            yield min(r[6], other[6]), max(r[6], other[6])

        return in_batches(rows(), PAIRS)

    return run


CONFIRMED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])


def _confirm(threshold: int):
    def run(batches):
        hashes = WordHashes()

        def rows():
            held: tuple = (None, None)
            for a, b, text_a, text_b in rows_of(batches):
                if held[0] != a:
                    held = (a, shingles(text_a, hashes))
                x, y = held[1], shingles(text_b, hashes)
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                both = int((x[at] == y).sum())
                yield a, b, 100 * both >= threshold * (len(x) + len(y) - both)

        return in_batches(rows(), CONFIRMED)

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Each pair with whether the full sets of its texts are similar enough."""
    a = texts.select(F.col("rep").alias("a"), F.col("data").alias("text_a"))
    b = texts.select(F.col("rep").alias("b"), F.col("data").alias("text_b"))
    return materialize(pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(threshold), "a long, b long, linked boolean"))


def _star_pairs(members: DataFrame) -> DataFrame:
    """Each member of a bucket with the member that shares most buckets."""
    lead = members.groupBy("key").agg(F.max(F.struct("degree", F.bitwise_not("rep").alias("r"))).alias("lead"))
    pairs = members.join(lead.select("key", F.bitwise_not("lead.r").alias("leader")), "key").where("rep <> leader")
    return pairs.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()


def _cells(members: DataFrame) -> DataFrame:
    """The members of buckets with several components, dealt to the cells that compare
    them: those outside the star's component against those inside, and among themselves."""
    lead = members.groupBy("key").agg(F.max(F.struct("degree", F.bitwise_not("rep").alias("r"), "comp")).alias("lead"))
    sided = members.join(lead.select("key", F.col("lead.comp").alias("main")), "key")
    sided = sided.withColumn("side", (F.col("comp") != F.col("main")).cast("int"))
    counts = sided.groupBy("key").agg(F.sum("side").alias("outside"), F.sum(1 - F.col("side")).alias("inside")).where("outside > 0")
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    sided = sided.join(counts.select("key", blocks("outside").alias("n1"), blocks("inside").alias("n0")), "key")
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("side") == 1, F.col("n1")).otherwise(F.col("n0"))).cast("int")
    sided = sided.withColumn("block", own)
    cell = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    to_main = F.transform(F.sequence(F.lit(0), F.col("n0") - 1), lambda i: cell(0, i, F.col("block")))
    each_other = F.transform(F.sequence(F.lit(0), F.col("n1") - 1), lambda j: cell(1, F.least(j, F.col("block")), F.greatest(j, F.col("block"))))
    from_main = F.transform(F.sequence(F.lit(0), F.col("n1") - 1), lambda j: cell(0, F.col("block"), j))
    to = F.when(F.col("side") == 1, F.concat(to_main, each_other)).otherwise(from_main)
    return sided.select("key", F.explode(to).alias("c"), "side", "block", "rep", "comp").select("key", "c.kind", "c.i", "c.j", "side", "block", "rep", "comp")


def _dealt(cells: DataFrame, signatures: DataFrame, buckets: DataFrame) -> DataFrame:
    """The cells' members with what the comparison needs, the rows of a cell together."""
    rows = cells.join(signatures, "rep").join(buckets.select("rep", "keys"), "rep")
    rows = rows.select("key", "kind", "i", "j", "side", "block", "rep", "comp", "signature", "keys")
    return rows.repartition("key", "kind", "i", "j").sortWithinPartitions("key", "kind", "i", "j")


def near_dedup(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_shingles, component_id, kept, and the
    row key (rf, ri)."""
    bounded_batches(docs.sparkSession)
    limit = float(least_estimate(threshold))
    keyed = with_row_key(docs.select("doc_id", "text"))
    signed_rows = materialize(
        keyed.select(*row_parts(), F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("data")).mapInArrow(_sign, SIGNED_SQL)
    )
    # Classes of equal sets, each with its first row; a null id is the last.
    rank: Column = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rf", "ri")
    with_set = signed_rows.where("n_shingles > 0")
    classes = with_set.groupBy("s1", "s2", "n_shingles").agg(F.min(rank).alias("first"))
    classes = materialize(classes.select("s1", "s2", "n_shingles", "first", F.monotonically_increasing_id().alias("rep")))
    first = classes.select("rep", F.col("first.rf").alias("rf"), F.col("first.ri").alias("ri"))
    bands = materialize(with_set.select("rf", "ri", "bands").join(first, ["rf", "ri"]).select("rep", "bands"))

    keys = bands.select("rep", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(keys.join(shared, "key"))
    # A class is in 36 buckets at most.
    buckets = members.groupBy("rep").agg(F.sum("n").alias("degree"), F.collect_list("key").alias("keys"))
    members = members.select("key", "rep").join(buckets.select("rep", "degree"), "rep")
    data = keyed.select(*row_parts(), as_bytes("text").alias("data"))
    texts = data.join(first.join(buckets.select("rep"), "rep"), ["rf", "ri"]).select("rep", "data")
    texts = materialize(texts.mapInArrow(_pack, "rep long, data binary, signature binary"))
    signatures = texts.select("rep", "signature")
    sig = lambda name: signatures.select(F.col("rep").alias(name), F.col("signature").alias(f"sig_{name}"))

    stars = _star_pairs(members).join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b")
    tried = confirmed(stars.mapInArrow(_estimated(limit), "a long, b long"), texts, threshold)
    links = tried.where("linked").select(F.col("b").alias("u"), F.col("a").alias("v"))
    found = components(links)

    named = members.join(found.withColumnRenamed("u", "rep"), "rep", "left").select("key", "rep", "degree", F.coalesce("v", "rep").alias("comp"))
    dealt = _dealt(_cells(named), signatures, buckets)
    more = dealt.mapInArrow(_compared(limit), "a long, b long").join(tried.select("a", "b"), ["a", "b"], "left_anti")
    tried_more = confirmed(more, texts, threshold)
    links = links.unionByName(tried_more.where("linked").select(F.col("b").alias("u"), F.col("a").alias("v")))
    found = components(links)

    named = classes.join(found.withColumnRenamed("u", "rep"), "rep", "left").withColumn("comp", F.coalesce("v", "rep"))
    heads = named.groupBy("comp").agg(F.min("first").alias("head"))
    classed = named.join(heads, "comp").select("s1", "s2", "n_shingles", "head")
    kept = (F.col("rf") == F.col("head.rf")) & (F.col("ri") == F.col("head.ri"))
    linked = with_set.select("rf", "ri", "doc_id", "n_shingles", "s1", "s2").join(classed, ["s1", "s2", "n_shingles"])
    linked = linked.select("doc_id", "n_shingles", F.col("head.doc_id").alias("component_id"), kept.alias("kept"), "rf", "ri")
    alone = signed_rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "rf", "ri")
    return linked.unionByName(alone)


def without_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group."""
    keyed = with_row_key(docs)
    kept = near_dedup(docs, threshold).where("kept").select("rf", "ri")
    own = [F.col(f"`{c}`").alias(f"d_{c}") for c in docs.columns]
    return keyed.select(*own, *row_parts()).join(kept, ["rf", "ri"]).select(*[F.col(f"`d_{c}`").alias(c) for c in docs.columns])
