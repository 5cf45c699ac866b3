"""What the operators share: row keys, written intermediate tables, batches of bytes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Name of the key that ``with_row_key`` adds; two longs in a struct.
ROW = "__row"
#: A batch that goes to Python holds so many rows and bytes at most, besides one row.
BATCH_ROWS, BATCH_BYTES = 2000, "16m"
#: ASCII white space, the bytes of [\x20\x09-\x0D].
SPACES = b" \t\n\x0b\x0c\r"
#: The same class in a regular expression.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the batches that Python workers get; texts may be long, so rows alone don't."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


#: Folders written in each open scope of ``scratch``, the innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def materialize(frame: DataFrame, outlive: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: a cut in the lineage that
    survives lost executors and is computed once. With ``outlive`` it stays when the
    innermost scope of ``scratch`` ends."""
    path = shared_folder(frame.sparkSession)
    scopes = _scopes.get()[: -1 if outlive else None]
    if scopes:
        scopes[-1].append(path)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """A scope at whose end the tables that were materialised in it go; frames that read
    them can't be used any more."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(token)
        settings = spark._jsc.hadoopConfiguration()
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(settings).delete(place, True)


def with_row_key(docs: DataFrame) -> DataFrame:
    """Add a key that is the same whenever the rows are read again.

    Rows that come straight from Parquet files are named by file and place, which costs
    nothing. Any other frame is numbered and written first, as its order may change."""
    if ROW in docs.columns:
        raise ValueError(f"{ROW} is the name of the row key")
    place = F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    try:
        return docs.select("*", place.alias(ROW))
    except AnalysisException:
        number = F.struct(F.lit(0).cast("long").alias("f"), F.monotonically_increasing_id().alias("i"))
        return materialize(docs.select("*", number.alias(ROW)))


def row_parts() -> list[Column]:
    """The row key as two plain columns, for joins."""
    return [F.col(f"{ROW}.f").alias("rf"), F.col(f"{ROW}.i").alias("ri")]


def as_bytes(name: str) -> Column:
    """A text as UTF-8 bytes; null becomes empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as plain Python values."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4000) -> Iterator[pa.RecordBatch]:
    """Plain rows as Arrow batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def task_number() -> int:
    return TaskContext.get().partitionId()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered while there are not too many."""

    MOST = 500_000

    def __init__(self):
        import xxhash

        super().__init__()
        self.of = xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        h = self[word] = self.of(word)
        return h

    def all(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    total = np.full(n, min(size, len(words)), dtype=np.uint64)
    for k in range(min(size, len(words))):
        total = mix(total + words[k : k + n])
    return total


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


#: Bits of a bitmap of hashes (a power of two): a size that does not grow with the data.
BITMAP_BITS = 1 << 24


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(BITMAP_BITS, dtype=bool)
    for batch in batches:
        bits[(batch.column(0).to_numpy().view(np.uint64) % np.uint64(BITMAP_BITS)).astype(np.int64)] = True
    packed, step = np.packbits(bits, bitorder="little"), 1 << 16
    parts = [(k, packed[k : k + step]) for k in range(0, len(packed), step)]
    schema = pa.schema([("part", pa.int64()), ("bits", pa.binary())])
    yield from in_batches(((k, p.tobytes()) for k, p in parts if p.any()), schema)


def _merged_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for part, bits in rows_of(batches):
        own = np.frombuffer(bits, np.uint8)
        held[part] = held[part] | own if part in held else own
    yield from in_batches(((k, v.tobytes()) for k, v in held.items()), pa.schema([("part", pa.int64()), ("bits", pa.binary())]))


def bitmap_of(hashes: DataFrame) -> bytes:
    """Which hashes (the one column, longs) there are, as a bitmap of a fixed size.

    With more hashes than bits it lets everything pass; it only saves work for others."""
    parts = hashes.coalesce(32).mapInArrow(_bitmaps, "part long, bits binary")
    whole = np.zeros(BITMAP_BITS // 8, dtype=np.uint8)
    for part, bits in parts.repartition(8, "part").mapInArrow(_merged_bitmaps, "part long, bits binary").collect():
        whole[part : part + len(bits)] = np.frombuffer(bits, np.uint8)
    return whole.tobytes()


def in_bitmap(bitmap: bytes, hashes: np.ndarray) -> np.ndarray:
    """Whether 64-bit hashes are in a bitmap."""
    bits = np.frombuffer(bitmap, np.uint8)
    slot = (hashes % np.uint64(BITMAP_BITS)).astype(np.int64)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def where_in_bitmap(frame: DataFrame, bitmap: bytes) -> DataFrame:
    """The rows whose column ``h`` (a long, the first) is in the bitmap, without it."""

    def run(batches):
        for batch in batches:
            passed = in_bitmap(bitmap, batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:]).filter(pa.array(passed))

    return frame.mapInArrow(run, frame.drop("h").schema)
