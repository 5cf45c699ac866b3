"""Headerless text grids: reading, finding the header row, naming and typing columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import ROW, local_frame
from ..functions.names import clean_names, header_names
from ..session import shared_folder
from .cleanup import present_text
from .records import cut_records, load_chunks

HEADER_SCAN_ROWS = 10
RAW = "_raw"
BOM = "\ufeff"

# What counts as a number or a truth value in a text cell.
INTEGER_TEXT = r"^[+-]?\d{1,38}$"
NUMBER_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
TRUTH_TEXTS = ["TRUE", "True", "true", "FALSE", "False", "false"]

TABLES = {"bigint": "integers", "decimal(38,0)": "wide", "double": "numbers", "boolean": "truths"}


def _options(separator: str, multiline: bool = False) -> dict:
    return {"sep": separator, "quote": '"', "escape": '"', "multiLine": multiline}


def _separators(record: str, separator: str) -> Column:
    """How many separators a record has outside quoted cells."""
    s = "\\" + separator
    # doubled quotes go first, as a pattern that repeats over them needs a stack
    plain = F.replace(record, F.lit('""'), F.lit(""))
    closed = F.regexp_replace(plain, f'(^|{s})"[^"]*+"(?={s}|$)', "$1")
    outside = F.when(F.contains(record, F.lit('"')), closed).otherwise(F.col(record))
    return F.length(outside) - F.length(F.replace(outside, F.lit(separator), F.lit("")))


def grid_width(spark: SparkSession, path: str, separator: str = ",") -> int:
    """Cells of the widest record. A record of more than one cell does not fit the schema
    here, so the reader hands it over whole; separators in quoted cells are not counted."""
    options = _options(separator) | {"columnNameOfCorruptRecord": RAW}
    records = spark.read.options(**options).schema(f"_c0 string, {RAW} string").csv(path)
    # The reader does not answer for the column of whole records alone.
    widest = records.agg(F.max(_separators(RAW, separator)).alias("n"), F.count("_c0").alias("cells")).first()
    return 1 + (widest["n"] or 0)


def _lines(spark: SparkSession, path: str, separator: str) -> tuple[DataFrame, int]:
    """Cells and places of records that are lines, and the number of cells."""
    width = grid_width(spark, path, separator)
    records = spark.read.options(**_options(separator)).schema(_cell_schema(width)).csv(path)
    file, block = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    return records.select("*", file, block, F.monotonically_increasing_id().alias("place")), width


def _multiline(spark: SparkSession, path: str, separator: str) -> tuple[DataFrame, int]:
    """The same of records with line breaks in quoted cells."""
    records = cut_records(kept_grid(load_chunks(spark, path, separator)))
    width = 1 + (records.agg(F.max(_separators("record", separator))).first()[0] or 0)
    cells = F.from_csv("record", _cell_schema(width), _options(separator, multiline=True))
    return records.select("file", "block", "place", cells.alias("x")).select("x.*", "file", "block", "place"), width


def _cell_schema(width: int) -> str:
    return ", ".join(f"_c{i} string" for i in range(width))


def load_grid(spark: SparkSession, path: str, separator: str = ",", multiline: bool = False) -> DataFrame:
    """``source, file, block, row_idx, cells`` of the text files below ``path``, with as many
    cells in every row as the widest has. Blank lines are no rows.

    ``row_idx`` (file, block, place) sorts rows by file and by their order in it, however
    Spark packs files into tasks. With ``multiline``, quoted cells may hold line breaks;
    such files are split like all others (:mod:`.records`)."""
    records, width = (_multiline if multiline else _lines)(spark, path, separator)
    names = [f"_c{i}" for i in range(width)]
    source = F.regexp_replace(F.regexp_extract("file", "[^/]*$", 0), r"\.[^.]*$", "")
    source = F.url_decode(F.replace(source, F.lit("+"), F.lit("%2B")))
    first = F.when(F.startswith(names[0], F.lit(BOM)), F.substring(names[0], 2, 2**31 - 1)).otherwise(F.col(names[0]))
    cells = F.array(*[present_text(c) for c in (first, *map(F.col, names[1:]))])
    return records.select(source.alias("source"), "file", "block", F.struct("file", "block", "place").alias("row_idx"), cells.alias("cells"))


def head_rows(grid: DataFrame, rows: int = HEADER_SCAN_ROWS) -> DataFrame:
    """The first rows of every source, renumbered from 0.

    Only the first split of a file can hold them, and the rank filter cuts every task
    down to a few rows per source before anything moves."""
    if "block" in grid.columns:
        grid = grid.where(F.col("block") == 0).drop("block")
    order = Window.partitionBy("source").orderBy("row_idx")
    ranked = grid.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= rows).select(
        "source", (F.col("rank") - 1).cast("bigint").alias("row_idx"), "cells"
    )


def header_score(cells: Column) -> Column:
    """Distinct texts minus numbers in one grid row."""
    number = lambda c: F.coalesce(c.rlike(NUMBER_TEXT), F.lit(False))
    texts = F.filter(cells, lambda c: c.isNotNull() & ~number(c) & (F.trim(c) != ""))
    numbers = F.filter(cells, lambda c: number(c))
    return F.size(F.array_distinct(texts)) - F.size(numbers)


def detect_header(grid: DataFrame, max_scan: int = HEADER_SCAN_ROWS) -> DataFrame:
    """``source, header_row, score, header``: the first best row of the first ``max_scan``
    ones, or row 0 where no row scores above 0. Rows are numbered from 0 per source."""
    score = header_score(F.col("cells"))
    best = (
        grid.where(F.col("row_idx") < max_scan)
        .select("source", "row_idx", "cells", (-score).alias("down"))
        .groupBy("source")
        .agg(
            F.min(F.struct("down", "row_idx", "cells")).alias("best"),
            F.min(F.struct("row_idx", "cells")).alias("first"),
        )
    )
    found = F.col("best.down") < 0
    return best.select(
        "source",
        F.when(found, F.col("best.row_idx")).otherwise(F.lit(0)).cast("bigint").alias("header_row"),
        F.when(found, -F.col("best.down")).otherwise(F.lit(0)).cast("bigint").alias("score"),
        F.when(found, F.col("best.cells")).otherwise(F.col("first.cells")).alias("header"),
    )


def first_header(grid: DataFrame, max_scan: int = HEADER_SCAN_ROWS) -> list[str | None] | None:
    """The header of a folder of files: that of its first file with any rows."""
    start = grid.where(F.col("block") == 0).agg(F.min("row_idx").alias("row")).first()["row"]
    if start is None:
        return None
    file = grid.where((F.col("file") == start["file"]) & (F.col("block") == 0))
    rows = [(start["file"], i, r["cells"]) for i, r in enumerate(file.orderBy("row_idx").select("cells").take(max_scan))]
    head = local_frame(grid.sparkSession, rows, "source string, row_idx bigint, cells array<string>")
    return detect_header(head, max_scan).first()["header"]


def below_headers(grid: DataFrame, header: list[str | None], max_scan: int = HEADER_SCAN_ROWS) -> DataFrame:
    """The rows of all files without their title rows and headers: a file begins below the
    first of its first ``max_scan`` rows that equals ``header``, or at its top if none does.

    Expects a grid that was written (:func:`kept_grid`), so that places do not change. As
    many heads reach the driver as files, which it lists anyway."""
    order = Window.partitionBy("file").orderBy("row_idx")
    ranked = grid.where(F.col("block") == 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_scan)
    same = F.col("cells").eqNullSafe(F.array(*[F.lit(c).cast("string") for c in header]))
    heads = ranked.where(same).groupBy("file").agg(F.min("row_idx.place").alias("head")).collect()
    if not heads:
        return grid
    heads = local_frame(grid.sparkSession, [tuple(r) for r in heads], "file string, head bigint")
    above = (F.col("block") == 0) & (F.col("row_idx.place") <= F.col("head"))
    return grid.join(heads, "file", "left").where(~F.coalesce(above, F.lit(False))).select(*grid.columns)


def kept_grid(grid: DataFrame) -> DataFrame:
    """A grid, or chunks of one, written to the shared folder of the session and read back: text is parsed
    once, and rows keep their places whatever executors come and go."""
    folder = shared_folder(grid.sparkSession)
    grid.write.parquet(folder)
    return grid.sparkSession.read.schema(grid.schema).parquet(folder)


def promote_header(grid: DataFrame, header_row: int, names: list[str]) -> DataFrame:
    """Rows below the header of one source as named text columns, with source order."""
    body = grid.where(F.col("row_idx") > header_row)
    return body.select(
        *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)],
        F.col("row_idx").alias(ROW),
    )


def column_facts(body: DataFrame) -> DataFrame:
    """``position, filled, integers, wide, numbers, truths``: what the cells of every column
    hold. One pass answers how wide the grid is, which columns are empty and how the
    others are to be typed."""
    cells = body.select(F.posexplode("cells").alias("position", "cell"))
    text = F.trim("cell")
    return cells.groupBy("position").agg(
        F.count("cell").alias("filled"),
        F.count_if(text.rlike(INTEGER_TEXT) & text.try_cast("bigint").isNotNull()).alias("integers"),
        F.count_if(text.rlike(INTEGER_TEXT)).alias("wide"),
        F.count_if(text.rlike(NUMBER_TEXT)).alias("numbers"),
        F.count_if(text.isin(TRUTH_TEXTS)).alias("truths"),
    )


def _typed(cell: Column, facts) -> Column:
    text = F.trim(cell)
    for target, field in TABLES.items():
        if facts[field] == facts["filled"]:
            return text.cast(target)
    return cell


def grid_to_table(body: DataFrame, header: list[str | None]) -> DataFrame:
    """The rows below the headers as a clean table: no empty rows or columns, cleaned names,
    numbers and truth values typed, rows numbered in source order."""
    facts = {r["position"]: r for r in column_facts(body).collect()}  # one row per column
    width = max([len(header), *[p + 1 for p in facts]])
    kept = [i for i in range(width) if i in facts and facts[i]["filled"] > 0]
    raw = header_names(header, width)
    names = clean_names([raw[i] for i in kept])
    some = F.exists("cells", lambda c: c.isNotNull())
    columns = [
        _typed(F.get("cells", F.lit(i)), facts[i]).alias(n) for i, n in zip(kept, names)
    ]
    return body.where(some).select(*columns, F.col("row_idx").alias(ROW))
