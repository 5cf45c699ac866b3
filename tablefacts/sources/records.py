"""Records of delimited text whose quoted cells hold line breaks, read by all cores.

Files are split at any line. A line break ends a record only outside quotes, and whether a
split begins inside quotes is not known while it is read. So every split is read for both
cases: it becomes chunks of lines, each with the places where its records begin and its last
one is left open, and a map from the state at its start to the state at its end.
The maps of the splits of a file, a row each, are composed from its top, which gives every
split its state; then all chunks are cut at their places, without another look at quotes and
without Python, whose workers hold a batch of lines and a chunk at most. Records that run over
the end of a chunk are put together from their parts, at most two a chunk; nothing else moves.

Records end in a line feed, with or without a carriage return; the first line of a file
tells whether its line ends have one. A quote that nothing closes
runs to the end of its file, as with any reader. Compressed files are one split each.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Collection, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Functions go to the workers whole, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_SCHEMA = (
    "file string, block bigint, chunk bigint, text binary, starts_out boolean, starts_in boolean, "
    "ends_out boolean, ends_in boolean, places_out array<int>, tail_out bigint, head_in bigint, "
    "places_in array<int>, common bigint, tail_in bigint, returns boolean"
)
#: Bytes of a chunk, besides one line.
CHUNK_LENGTH = 1 << 20
#: Splits whose states (a path, a number and a bit each) are sent to every task.
MOST_SPLITS = 200_000
#: Behind the number of any record within a chunk.
LAST = (1 << 32) - 1


class Cutter:
    """Where records begin and end in whole lines, each with its line feed."""

    def __init__(self, separator: str):
        s = re.escape(separator)
        rest = rf"[^{s}\n]*+"
        inside = r'[^"]*+(?:""[^"]*+)*+"'
        cell = rf'(?:"{inside}{rest}|(?!"){rest})'
        self.record = re.compile(rf"{cell}(?:{s}{cell})*+\n")
        self.resumed = re.compile(rf"{inside}{rest}(?:{s}{cell})*+\n")

    def starts(self, text: str, begin: int, known: Collection[int] = ()) -> tuple[list[int], int]:
        """Where the whole records from ``begin`` to one of ``known`` begin, and how far they
        reach: to that one, to one that is left open, or to the end."""
        found, last, match = [], len(text), self.record.match
        while begin < last and begin not in known:
            record = match(text, begin)
            if not record:
                break
            found.append(begin)
            begin = record.end()
        return found, begin

    def places(self, text: str) -> tuple[list[int], int, int, list[int], int, int, bool]:
        """Where whole records begin and one is left open, or -1, if the text starts outside quotes;
        if it starts inside: where its first record begins, the records from there to the first that
        both cases have, that one, where a record is left open, and whether the text ends inside."""
        last = len(text)
        found, tail = self.starts(text, 0)
        tail = tail if tail < last else -1
        resumed = self.resumed.match(text)
        if not resumed:
            return found, tail, last, [], last, -1, True
        head, known = resumed.end(), frozenset(found)
        own, common = self.starts(text, head, known)
        if common in known:  # from there on both cases are one
            return found, tail, head, own, common, tail, tail >= 0
        return found, tail, head, own, last, common if common < last else -1, common < last

    def cut(self, text: str) -> list[str]:
        """Records of a text that begins and ends with whole ones, without blank lines."""
        if '"' not in text:
            records = text.split("\n")
        else:
            starts, _ = self.starts(text, 0)
            records = [text[p : q - 1] for p, q in zip(starts, [*starts[1:], len(text)])]
        return [r for r in (r.removesuffix("\r") for r in records) if r]


def _in_bytes(text: str, body: bytes, places: Collection[int]) -> Callable[[int], int]:
    """From places in a text to those in its bytes; -1 stays."""
    if len(text) == len(body):
        return lambda p: p
    order = sorted({p for p in places if p >= 0})
    sizes = (len(text[p:q].encode()) for p, q in zip([0, *order], order))
    return {-1: -1, **dict(zip(order, accumulate(sizes)))}.__getitem__


def _chunks(separator: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines (value, file, block), in order, as chunks."""

    def runs(batches):
        """The lines of one split after the other, however long they are: file, block, text."""
        for batch in batches:
            names = batch.column(1).dictionary_encode()
            ends = np.cumsum(pc.binary_length(batch.column(0)).to_numpy().astype(np.int64) + 1)
            keys = np.stack([names.indices.to_numpy(), batch.column(2).to_numpy(), ends // CHUNK_LENGTH])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for p, q in zip(cuts, cuts[1:]):
                if p < q:
                    lines = batch.column(0).slice(p, q - p).to_pylist()
                    yield batch.column(1)[p].as_py(), batch.column(2)[p].as_py(), b"\n".join([*lines, b""])

    def gathered(batches):
        held, own = [], None
        for file, block, text in runs(batches):
            if held and (own != (file, block) or sum(map(len, [*held, text])) > CHUNK_LENGTH):
                yield *own, b"".join(held).decode("utf-8", "replace")
                held = []
            own = file, block
            held.append(text)
        if held:
            yield *own, b"".join(held).decode("utf-8", "replace")

    def run(batches):
        cutter, own, chunk, out, into = Cutter(separator), None, 0, False, True
        spots = pa.list_(pa.int32())
        schema = pa.schema(
            [("file", pa.string()), *((c, pa.int64()) for c in ("block", "chunk")), ("text", pa.binary())]
            + [(c, pa.bool_()) for c in ("starts_out", "starts_in", "ends_out", "ends_in")]
            + [("places_out", spots), *((c, pa.int64()) for c in ("tail_out", "head_in"))]
            + [("places_in", spots), *((c, pa.int64()) for c in ("common", "tail_in")), ("returns", pa.bool_())]
        )
        for file, block, text in gathered(batches):
            if own != (file, block):
                own, chunk, out, into = (file, block), 0, False, True
            body = text.encode()
            if b'"' in body:
                found, tail_out, head, more, common, tail_in, open_in = cutter.places(text)
                at = _in_bytes(text, body, [*found, tail_out, head, *more, common, tail_in])
                places = [[*map(at, found)], at(tail_out), at(head), [*map(at, more)], at(common), at(tail_in)]
            else:  # every line is a record, or all are within one
                places, open_in = [None, -1, len(body), [], len(body), -1], True
            after = {False: places[1] >= 0, True: open_in}
            row = [file, block, chunk, body, out, into, after[out], after[into], *places]
            row.append(text[: text.index("\n")].endswith("\r"))
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)
            chunk, out, into = chunk + 1, after[out], after[into]

    return run


def _cut(text: Column, head: Column, places: Column, end: Column) -> Column:
    """The records of a chunk that begin at ``places``, the last of them before ``end``, without
    blank lines; without places every line from ``head`` on is a record."""
    ends = F.concat(F.slice(places, 2, F.size(places)), F.array(end))
    # as an item of an array the text is taken from its row once, not for every record
    chunk = F.array(F.struct(text.alias("text"), places.alias("places"), ends.alias("ends")))
    part = lambda c: lambda p, q: F.substring(c["text"], p + 1, q - p - 1).cast("string")
    records = F.flatten(F.transform(chunk, lambda c: F.zip_with(c["places"], c["ends"], part(c))))
    lines = F.split(F.substring(text, head + 1, F.octet_length(text)).cast("string"), "\n")
    shorn = lambda r: F.when(F.endswith(r, F.lit("\r")), F.substring(r, F.lit(1), F.length(r) - 1)).otherwise(r)
    return F.filter(F.transform(F.when(places.isNull(), lines).otherwise(records), shorn), lambda r: r != "")


def _odd(n: Column) -> Column:
    return n % 2 != 0


def start_states(maps: DataFrame) -> DataFrame:
    """``maps`` (file, block, ends_out, ends_in: what splits make of either state) with
    ``inside``: whether each split begins inside quotes.

    A split keeps the state, turns it, or ends in one state whatever it began with; so the
    state is that of the last split of the third kind, turned by all that turn it since."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fixed, turns = F.col("ends_out") == F.col("ends_in"), F.col("ends_out") & ~F.col("ends_in")
    counted = maps.withColumn("turned", F.coalesce(F.sum(turns.cast("bigint")).over(before), F.lit(0)))
    known = F.last(F.when(fixed, F.struct("ends_out", "turned")), ignorenulls=True).over(before)
    since = _odd(F.col("turned") - F.coalesce("known.turned", F.lit(0)))
    begun = F.coalesce("known.ends_out", F.lit(False))
    return counted.withColumn("known", known).select(*maps.columns, (begun != since).alias("inside"))


def load_chunks(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """The lines of all files below ``path`` as chunks. Write them before use: places in a
    split hold only as long as files are split in one way."""
    lines = spark.read.option("lineSep", "\n").text(path)
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    return lines.select(F.col("value").cast("binary").alias("value"), *place).mapInArrow(_chunks(separator), CHUNK_SCHEMA)


def cut_records(chunks: DataFrame) -> DataFrame:
    """``file, block, place, record`` of chunks; (block, place) orders the records of a file."""
    last = F.max_by(F.struct("ends_out", "ends_in"), "chunk")
    splits = chunks.groupBy("file", "block").agg(last.alias("m"), F.min_by("returns", "chunk").alias("returns"))
    states = start_states(splits.select("file", "block", "m.*", "returns"))
    returns = F.first("returns").over(Window.partitionBy("file").orderBy("block"))
    states = states.select("file", "block", "inside", returns.alias("crlf"))
    if states.count() <= MOST_SPLITS:  # else the join moves the texts
        states = F.broadcast(states)
    inside = F.when(F.col("inside"), F.col("starts_in")).otherwise(F.col("starts_out"))
    known = chunks.drop("returns").join(states, ["file", "block"]).withColumn("inside", inside)
    head = F.when(F.col("inside"), F.col("head_in")).otherwise(0).cast("int")
    tail = F.when(F.col("inside"), F.col("tail_in")).otherwise(F.col("tail_out")).cast("int")
    shared = F.filter("places_out", lambda p: p >= F.col("common"))
    places = F.when(F.col("inside"), F.concat("places_in", shared)).otherwise(F.col("places_out"))
    known = known.select("file", "block", "chunk", "crlf", "text", head.alias("head"), tail.alias("tail"), places.alias("places"))

    end = F.when(F.col("tail") >= 0, F.col("tail")).otherwise(F.octet_length("text"))
    records = _cut(F.col("text"), F.col("head"), F.col("places"), end)
    whole = known.select("file", "block", "chunk", "crlf", F.posexplode(records).alias("n", "record"))
    place = F.shiftleft(F.col("chunk"), 32) + F.col("n")
    whole = whole.select("file", "block", place.alias("place"), "crlf", "record")

    first = F.when(F.col("head") > 0, F.struct(F.lit(0).alias("kind"), F.expr("string(substring(text, 1, head))").alias("part")))
    left = F.when(F.col("tail") >= 0, F.struct(F.lit(1).alias("kind"), F.expr("string(substring(text, tail + 1))").alias("part")))
    parts = known.select("file", "block", "chunk", "crlf", F.explode(F.array_compact(F.array(first, left))).alias("x"))
    order = Window.partitionBy("file").orderBy("block", "chunk", "x.kind")
    parts = parts.withColumn("number", F.sum("x.kind").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sort_array(F.collect_list(F.struct("block", "chunk", F.col("x.kind").alias("kind"), F.col("x.part").alias("part"))))
    joined = parts.groupBy("file", "number").agg(run.alias("run"), F.any_value("crlf").alias("crlf"))
    record = F.regexp_replace(F.array_join(F.transform("run", lambda x: x["part"]), ""), r"\r?\n\z", "")
    begun = F.element_at("run", 1)
    place = F.shiftleft(begun["chunk"], 32) + F.lit(LAST)
    glued = joined.select("file", begun["block"].alias("block"), place.alias("place"), "crlf", record.alias("record"))
    # a file whose lines end in both has line feeds alone in its cells, as with Spark's reader
    plain = F.when(F.col("crlf"), F.replace("record", F.lit("\r\n"), F.lit("\n"))).otherwise(F.col("record"))
    return whole.unionByName(glued).select("file", "block", "place", plain.alias("record"))
