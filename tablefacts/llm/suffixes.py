"""Repeated byte strings removed, by hashed content anchors in place of prefix doubling.

A byte goes if a string of ``length`` (200) bytes covers it that starts anywhere else too,
in the same document or another. Strings are judged on the input; overlaps count.

Ranking every byte position at every doubled length would move many times the input, so
positions are sampled first, by content: of the 169 strings of 32 bytes inside a window of
200, the one with the least hash is the window's anchor. Equal windows have equal anchors
at equal offsets, so a string of 200 bytes can only repeat where its anchor does.

* Rank 32: anchors are named by their 32 bytes; names that are unique drop out.
* Rank of the context: all windows of an anchor together span up to 368 bytes. Anchors with
  the same name and the same context are one class; where it has two members, all windows
  of both repeat, and one member stands for the class from here on.
* Rank 200: classes that share a name but not the context are told apart window by window.
  Each window is named by the pair of its anchor's name and the rank of its 200 bytes; a
  window that has its pair alone is unique, past the threshold nothing is compared.

Names are 64-bit hashes in place of dense ranks (equality is all that is needed), and every
comparison is of two of them together. Ranks are made by Spark's grouping, with partial
aggregates, so that a passage that a third of the documents share meets as counts.

Null texts are empty. Texts shorter than 200 bytes keep all. Long texts go in blocks of
1 MB. Ids may be null or repeat; every row gets a result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    ROW,
    as_bytes,
    bitmap_of,
    bounded_batches,
    in_batches,
    materialize,
    mix,
    row_parts,
    rows_of,
    signed,
    task_number,
    where_in_bitmap,
    with_row_key,
)

LENGTH, GRAM = 200, 32
#: Window starts that are worked on at once.
STEP = 1 << 20
#: Contexts of one name that are compared in one task; those of other names are compared as
#: rows, one for each window, with partial aggregates.
MANY = 4096

_random = np.random.default_rng(607)
BYTES = _random.integers(0, 2**64, (2, 256), dtype=np.uint64)
BASES = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    known = _powers.get(which)
    if known is None or len(known[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = []
        for base in (BASES[which], pow(BASES[which], -1, 2**64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        known = _powers[which] = (out[0], out[1])
    return known[0][:n], known[1][:n]


def prefix_hashes(data: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(which, len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTES[which][data] * up[:-1], out=sums[1:])
    return sums, down


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, values
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(out) - (width - size)], out[width - size :]) if width > size else out


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """The anchors of all windows of a piece of text: first window, number of windows,
    offset of the anchor in the first, name of its bytes, name of its context."""
    sums, down = prefix_hashes(data, 0)
    n = len(data)
    grams = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    order = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min(order, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:], len(at)) - 1
    place = at[first]
    sums, down = prefix_hashes(data, 1)
    context = (sums[last + length] - sums[first]) * down[first]
    shape = (last - first).astype(np.uint64) * np.uint64(1024) + (place - first).astype(np.uint64)
    return first, last - first + 1, place - first, grams[place], mix(mix(context) + shape)


ANCHORS_SQL = (
    "doc long, start int, windows int, shift int, name long, context long, anchor long, "
    "rf long, ri long, doc_id long, n_bytes long, sha string"
)
ANCHORS = pa.schema(
    [("doc", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("shift", pa.int32())]
    + [("name", pa.int64()), ("context", pa.int64()), ("anchor", pa.int64())]
    + [("rf", pa.int64()), ("ri", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.string())]
)


def _find_anchors(length: int):
    """Rows of anchors, and a row for each document, from documents."""

    def run(batches):
        count, seen = 0, 0
        for batch in batches:
            docs, parts = [], []
            for rf, ri, doc_id, data in rows_of([batch]):
                doc = (task_number() << 40) | seen
                seen += 1
                docs.append((doc, rf, ri, doc_id, len(data), hashlib.sha256(data).hexdigest()))
                array = np.frombuffer(data, np.uint8)
                for at in range(0, len(array) - length + 1, STEP):
                    first, windows, shift, name, context = anchors(array[at : at + STEP + length - 1], length)
                    ids = (task_number() << 40) + np.arange(count, count + len(first), dtype=np.int64)
                    count += len(first)
                    parts.append((np.full(len(first), doc), first + at, windows, shift, signed(name), signed(context), ids))
                if sum(len(p[0]) for p in parts) > 100_000:
                    yield _anchor_batch(parts)
                    parts = []
            if parts:
                yield _anchor_batch(parts)
            if docs:
                none = [None] * len(docs)
                doc, rf, ri, doc_id, n, sha = zip(*docs)
                columns = [doc, none, none, none, none, none, none, rf, ri, doc_id, n, sha]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ANCHORS)], schema=ANCHORS)

    return run


def _anchor_batch(parts: list[tuple]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts)]
    arrays = [pa.array(c).cast(f.type) for c, f in zip(columns, ANCHORS)]
    arrays += [pa.nulls(len(columns[0]), f.type) for f in list(ANCHORS)[len(columns) :]]
    return pa.RecordBatch.from_arrays(arrays, schema=ANCHORS)


CONTEXTS = pa.schema(
    [("doc", pa.int64()), ("context", pa.binary()), ("name", pa.int64()), ("start", pa.int32()), ("windows", pa.int32())]
    + [("shift", pa.int32()), ("open", pa.bool_())]
)
CONTEXTS_SQL = "doc long, context binary, name long, start int, windows int, shift int, open boolean"


def _cut_contexts(length: int):
    """The bytes of each context that stands for its class."""

    def run(batches):
        def rows():
            for doc, data, listed in rows_of(batches):
                for a in listed:
                    context = data[a["start"] : a["start"] + a["windows"] - 1 + length]
                    yield doc, context, a["name"], a["start"], a["windows"], a["shift"], a["open"]

        return in_batches(rows(), CONTEXTS, size=1000)

    return run


def window_names(context: bytes, windows: int, shift: int, length: int) -> np.ndarray:
    """The rank of each window of a context together with its place about the anchor."""
    sums, down = prefix_hashes(np.frombuffer(context, np.uint8), 1)
    rank = mix((sums[length:] - sums[:windows]) * down[:windows])
    return mix(rank + (np.uint64(shift + 1) - np.arange(windows, dtype=np.uint64)))


HITS = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _compare_names(length: int):
    """The repeated windows of the contexts of each name; names come as runs of rows."""

    def run(batches):
        def rows():
            for _, group in groupby(rows_of(batches), key=lambda r: r[2]):
                group = list(group)
                named = [window_names(r[1], r[4], r[5], length) for r in group]
                values, inverse, counts = np.unique(np.concatenate(named), return_inverse=True, return_counts=True)
                twice, at = counts[inverse] > 1, 0
                for r in group:
                    hits = np.flatnonzero(twice[at : at + r[4]])
                    at += r[4]
                    if r[6] and len(hits):
                        # Windows in a row are one span.
                        cuts = np.flatnonzero(np.diff(hits) > 1)
                        for first, last in zip(hits[np.append(0, cuts + 1)], hits[np.append(cuts, len(hits) - 1)]):
                            yield r[0], r[3] + int(first), r[3] + int(last) + length

        return in_batches(rows(), HITS)

    return run


WINDOWS = pa.schema([("name", pa.int64()), ("window", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("open", pa.bool_())])


def _name_windows(length: int):
    """Every window of the given contexts as a row."""

    def run(batches):
        for batch in batches:
            parts = []
            for doc, context, name, start, n, shift, is_open in rows_of([batch]):
                names = signed(window_names(context, n, shift, length))
                parts.append((np.full(n, name), names, np.full(n, doc), np.arange(start, start + n), np.full(n, is_open)))
            if parts:
                arrays = [pa.array(np.concatenate(c)).cast(f.type) for c, f in zip(zip(*parts), WINDOWS)]
                yield pa.RecordBatch.from_arrays(arrays, schema=WINDOWS)

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


CUT = pa.schema([("doc", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for doc, data, listed in rows_of(batches):
            spans, kept, at = merged([(s["start"], s["end"]) for s in listed]), [], 0
            for start, end in spans:
                kept.append(data[at:start])
                at = end
            yield doc, [{"start": a, "end": b} for a, b in spans], b"".join([*kept, data[at:]])

    return in_batches(rows(), CUT, size=200)


def _ranked(points: DataFrame) -> DataFrame:
    """Anchors whose context repeats or that stand for their class among several."""
    contexts = points.groupBy("name", "context").agg(F.count(F.lit(1)).alias("members"), F.min("anchor").alias("first"))
    names = contexts.groupBy("name").agg(F.count(F.lit(1)).alias("contexts"), F.sum("members").alias("total")).where("total > 1")
    known = contexts.join(names, "name")
    rows = points.join(known, ["name", "context"])
    repeats, stands = F.col("members") > 1, (F.col("contexts") > 1) & (F.col("first") == F.col("anchor"))
    return rows.select("doc", "start", "windows", "shift", "name", repeats.alias("repeats"), stands.alias("stands")).where("repeats or stands")


def repeated_spans(docs: DataFrame, length: int = LENGTH, many: int = MANY) -> tuple[DataFrame, DataFrame]:
    """(rows, cut): a row (doc, rf, ri, doc_id, n_bytes, sha) for every row of ``docs``
    (doc_id, text), and for those with repeats (doc, spans, kept): what goes, as merged byte
    ranges, and the bytes that stay."""
    bounded_batches(docs.sparkSession)
    keyed = with_row_key(docs.select("doc_id", "text"))
    data = as_bytes("text").alias("data")
    found = materialize(
        keyed.select(*row_parts(), F.col("doc_id").cast("long").alias("doc_id"), data).mapInArrow(_find_anchors(length), ANCHORS_SQL)
    )
    rows = found.where("sha is not null").select("doc", "rf", "ri", "doc_id", "n_bytes", "sha")
    points = found.where("sha is null").select("doc", "start", "windows", "shift", "name", "context", "anchor")
    ranked = materialize(_ranked(points))

    # Documents of which every window repeats go whole, and need no text.
    standing = F.struct("start", "windows", "shift", "name", (~F.col("repeats")).alias("open"))
    listed = ranked.groupBy("doc").agg(
        F.sum(F.when(F.col("repeats"), F.col("windows")).otherwise(0)).alias("gone"),
        F.collect_list(F.when(F.col("stands"), standing)).alias("listed"),
        F.collect_list(F.when(F.col("repeats"), F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.col("windows") - 1 + length).cast("long").alias("end")))).alias("spans"),
    )
    listed = materialize(listed.join(rows, "doc").withColumn("whole", F.col("gone") == F.col("n_bytes") - (length - 1)))
    texts = keyed.select(F.xxhash64(f"{ROW}.f", f"{ROW}.i").alias("h"), *row_parts(), data)
    asked = listed.where("size(listed) > 0").select("doc", "rf", "ri", "listed")
    texts_of = lambda frame: where_in_bitmap(texts, bitmap_of(frame.select(F.xxhash64("rf", "ri").alias("h")))).join(frame, ["rf", "ri"])
    contexts = materialize(texts_of(asked).select("doc", "data", "listed").mapInArrow(_cut_contexts(length), CONTEXTS_SQL))

    wide = materialize(contexts.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > many).select("name"))
    narrow = contexts if wide.isEmpty() else contexts.join(wide, "name", "left_anti").select(contexts.columns)
    hits = narrow.repartition("name").sortWithinPartitions("name").mapInArrow(_compare_names(length), "doc long, start long, end long")
    if not wide.isEmpty():
        windows = contexts.join(wide, "name", "left_semi").select(contexts.columns)
        windows = materialize(windows.mapInArrow(_name_windows(length), "name long, window long, doc long, start long, open boolean"))
        twice = windows.groupBy("name", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name", "window")
        single = windows.where("open").join(twice, ["name", "window"])
        hits = hits.unionByName(single.select("doc", "start", (F.col("start") + length).alias("end")))
    more = hits.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("more"))
    partly = listed.where("not whole").select("doc", "rf", "ri", "spans").join(more, "doc", "left")
    spans = F.concat("spans", F.coalesce("more", F.array().cast("array<struct<start:long,end:long>>")))
    partly = materialize(partly.select("doc", "rf", "ri", spans.alias("listed")).where("size(listed) > 0"))
    cut = texts_of(partly).select("doc", "data", "listed").mapInArrow(_cut, "doc long, spans array<struct<start:long,end:long>>, kept binary")
    whole = listed.where("whole").select(
        "doc", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))).alias("spans"), F.lit(b"").alias("kept")
    )
    return rows, cut.unionByName(whole)


def without_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256, rf, ri."""
    rows, cut = repeated_spans(docs, length, **options)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    cut = cut.select("doc", "spans", removed.alias("gone"), F.sha2("kept", 256).alias("kept_sha"))
    return rows.join(cut, "doc", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        "spans",
        F.coalesce("kept_sha", "sha").alias("kept_sha256"),
        "rf",
        "ri",
    )
