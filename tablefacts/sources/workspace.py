"""Workspaces: every table of a folder, by name."""

from __future__ import annotations

import re
import warnings
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ROW
from .cleanup import clean_table, normalize_missing
from .grid import HEADER_SCAN_ROWS, below_headers, first_header, grid_to_table, kept_grid, load_grid

TEXT_FORMATS = {"csv": ",", "tsv": "\t"}
TYPED_FORMATS = ("parquet", "orc", "json")
COMPRESSED = r"(?:\.(?:gz|bz2|deflate))?"


def _known(suffix: str) -> bool:
    return suffix in TEXT_FORMATS or suffix in TYPED_FORMATS


def list_tables(spark: SparkSession, folder: str) -> dict[str, tuple[str, str]]:
    """``name -> (path, format)`` for every child of a folder: a file, or a folder of
    files. Works on any file system Spark reads; only paths are listed. The format is the
    suffix of the child, else that of its files, either also before that of a compression.
    Two children of one name (``a.csv`` and ``a.tsv``), or two formats in one child, are an
    error, as one would hide the other; children of no known format are named in a warning."""
    root = folder.rstrip("/")
    inside = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "", root).strip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    child = F.regexp_extract("path", "/" + re.escape(inside) + "/([^/]+)", 1)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)" + COMPRESSED + "$", 1))
    found = files.select(child.alias("child"), suffix.alias("suffix")).distinct().collect()
    children: dict[str, set[str]] = {}
    for row in found:
        children.setdefault(row["child"], set()).add(row["suffix"])
    tables, skipped = {}, []
    for child, suffixes in sorted(children.items()):
        stem, own = re.fullmatch(r"(.*?)(?:\.([^.]*))?" + COMPRESSED, child).groups()
        named = own is not None and _known(own.lower())
        known = {own.lower()} if named else set(filter(_known, suffixes))
        if not known:
            skipped.append(child)
            continue
        name, path = stem if named else child, f"{root}/{child}"
        if len(known) > 1:
            raise ValueError(f"{path} holds files of several formats: {', '.join(sorted(known))}")
        if name in tables:
            raise ValueError(f"two tables are named {name}: {tables[name][0]} and {path}")
        tables[name] = (path, known.pop())
    if skipped:
        warnings.warn(f"no tables, left out of {root}: {', '.join(skipped)}", stacklevel=2)
    return tables


def load_table(
    spark: SparkSession,
    path: str,
    file_format: str,
    header_detection: bool = True,
    clean: bool = False,
    keep_order: bool = False,
    multiline: bool = False,
    header_scan: int = HEADER_SCAN_ROWS,
) -> DataFrame:
    """One table. Text grids are always cleaned and typed; typed sources only lose
    their NaN values unless ``clean`` asks for empty rows and columns to go too.

    A text grid is parsed once, into the shared folder. A header is looked for in the first
    ``header_scan`` rows of every file; ``multiline`` reads line breaks in quoted cells."""
    if file_format in TEXT_FORMATS:
        grid = kept_grid(load_grid(spark, path, TEXT_FORMATS[file_format], multiline))
        scan = header_scan if header_detection else 1
        header = first_header(grid, scan)
        if header is None:
            return spark.createDataFrame([], f"{ROW} bigint")
        table = grid_to_table(below_headers(grid, header, scan), header)
    else:
        table = spark.read.format(file_format).load(path)
        if keep_order and file_format == "parquet":
            place = F.struct(
                F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("idx")
            )
            table = table.select("*", place.alias(ROW))
        table = clean_table(table) if clean else normalize_missing(table)
    return table if keep_order else table.drop(ROW)


def load_workspace(
    spark: SparkSession,
    folder: str,
    header_detection: bool = True,
    clean: bool = False,
    keep_order: bool = False,
    multiline: Collection[str] = (),
    header_scan: int = HEADER_SCAN_ROWS,
) -> dict[str, DataFrame]:
    """All tables of a folder by name. Reading stays lazy for typed sources; a text grid is
    parsed and looked through at once. ``multiline`` names the text tables whose quoted
    cells hold line breaks."""
    return {
        name: load_table(spark, path, file_format, header_detection, clean, keep_order, name in multiline, header_scan)
        for name, (path, file_format) in list_tables(spark, folder).items()
    }
