"""Profiles of tables that grow: only files that were not seen before are read.

Per file of a table a state is kept: one row of counts, sums and extremes per column, the
counts of its texts (by their first characters and a digest) and of its numbers. All of it
merges by addition, so a profile is put together from the states of the files that are there
now, and files that went away or were written anew simply no longer take part.

States are written in batches. A batch counts once its last part is complete, so a run that
dies leaves nothing behind that is read; where two runs read the same file, one batch is used.
A file is known by its path, size and time of change, a state also by the schema of its table.
"""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from collections.abc import Collection
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import (
    BOOLEAN,
    DATETIME,
    DATETIME_INFERRED,
    FLOAT,
    INTEGER,
    TEXT,
    col,
    data_columns,
    dtype_of,
    float_parts,
    label_of,
    local_frame,
)
from ..functions.dates import parse_date, pattern_of
from ..functions.formats import iso_text
from ..operators import profile as P
from .cleanup import normalize_missing
from .sinks import GRACE, _children, _last_write, _path
from .workspace import list_tables

MOST_RANKED = 1_000_000
"""Rows of the kept numbers around a median that are grouped and ranked."""

STEPS = 64
"""Quantiles that cut a bracket; each pass leaves one or two of its parts."""

SKETCH_SIZE = 800
MERGE_GROUPS = 64

FACTS = (
    "rows bigint, non_null bigint, int_sum decimal(38,0), lead double, rest double, avg double, m2 double, "
    "low double, high double, int_low bigint, int_high bigint, first timestamp_ntz, last timestamp_ntz, trues bigint"
)


def refresh_profile(
    spark: SparkSession,
    folder: str,
    state: str,
    tables: Collection[str] | None = None,
    top_n: int = P.TOP_VALUES,
) -> DataFrame:
    """Profile of the parquet tables of a folder, as ``profile_workspace`` has it, from the
    states kept below ``state``; files without a state are read and get one.

    Tables of other formats are an error: land them first (``sources.sinks.land``). Distinct
    numbers are kept as they are, so the state of a column without repeats is as large as the
    column."""
    listed = list_tables(spark, folder)
    wanted = {n: listed[n] for n in (listed if tables is None else tables)}
    if not wanted:
        raise ValueError("no tables")
    other = sorted(n for n, (_, file_format) in wanted.items() if file_format != "parquet")
    if other:
        raise ValueError(f"not parquet, land them first: {', '.join(other)}")
    rows = [r for n, (path, _) in wanted.items() for r in _Table(spark, n, path, state).profile(top_n)]
    return P._to_frame(spark, rows)


def unread_files(spark: SparkSession, path: str, state: str, name: str) -> list[str]:
    """The files of a table that the next refresh will read."""
    table = _Table(spark, name, path, state)
    return sorted(table.unknown().values())


def sweep_states(spark: SparkSession, state: str, grace: float = GRACE) -> list[str]:
    """Remove batches that never were completed and were not written to for ``grace`` seconds."""
    removed = []
    for table in _children(spark, state):
        for shape in _children(spark, f"{state}/{table}"):
            for batch in _children(spark, f"{state}/{table}/{shape}"):
                place = f"{state}/{table}/{shape}/{batch}"
                if not _complete(spark, place) and _last_write(spark, place) <= time.time() - grace:
                    files, gone = _path(spark, place)
                    files.delete(gone, True)
                    removed.append(batch)
    return removed


def _complete(spark: SparkSession, batch: str) -> bool:
    files, done = _path(spark, f"{batch}/facts/_SUCCESS")
    return files.exists(done)


def _plain(path: Column) -> Column:
    """A path as listings write it, with one slash after the scheme."""
    return F.regexp_replace(path, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def _file_id(path: Column, size: Column, changed: Column) -> Column:
    parts = (_plain(path), size.cast("string"), F.unix_millis(changed).cast("string"))
    return F.xxhash64(F.concat_ws("|", *parts))


class _Table:
    """One table and the states of its files."""

    def __init__(self, spark: SparkSession, name: str, path: str, state: str):
        self.spark, self.name, self.path = spark, name, path
        self.source = spark.read.parquet(path)
        self.frame = normalize_missing(self.source)
        self.columns = data_columns(self.frame)
        self.labels = {c: label_of(dtype_of(self.frame, c)) for c in self.columns}
        self.texts = [c for c in self.columns if self.labels[c] == TEXT]
        self.numbers = [c for c in self.columns if self.labels[c] in (INTEGER, FLOAT)]
        shape = hashlib.sha256(self.frame.schema.json().encode()).hexdigest()[:16]
        folder = re.sub(r"[^A-Za-z0-9.-]", lambda m: f"_{ord(m[0]):x}_", name)
        self.root = f"{state.rstrip('/')}/{folder}/{shape}"
        self.files = self._list()

    # ---- files -----------------------------------------------------------------

    def _list(self) -> dict[int, str]:
        """The files there now. Spark's own reader holds such a list on the driver as well."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        made = _file_id(F.col("path"), F.col("length"), F.col("modificationTime"))
        rows = found.load(self.path).select(made.alias("file"), "path").collect()
        files = {r["file"]: r["path"] for r in rows}
        if len(files) < len(rows):
            raise ValueError(f"two files of {self.path} have one hash")
        return files

    def batches(self) -> list[str]:
        places = [f"{self.root}/{b}" for b in _children(self.spark, self.root)]
        return [p for p in places if _complete(self.spark, p)]

    def owners(self) -> dict[int, str]:
        """The batch that holds the state of each present file; the first, if several do."""
        places = self.batches()
        if not places:
            return {}
        facts = self.spark.read.parquet(*[f"{p}/facts" for p in places])
        rows = facts.groupBy("file").agg(F.min("batch").alias("batch")).collect()
        return {r["file"]: r["batch"] for r in rows if r["file"] in self.files}

    def unknown(self) -> dict[int, str]:
        kept = self.owners()
        return {f: p for f, p in self.files.items() if f not in kept}

    # ---- states ----------------------------------------------------------------

    def _read(self, paths: list[str]) -> DataFrame:
        """The rows of some files, with the id of their file."""
        reader = self.spark.read.schema(self.source.schema)
        files, place = _path(self.spark, self.path)
        if files.getFileStatus(place).isDirectory():
            reader = reader.option("basePath", self.path)
        escaped = [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths]
        at = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
        made = _file_id(at, F.col("_metadata.file_size"), F.col("_metadata.file_modification_time"))
        raw = reader.parquet(*escaped)
        return normalize_missing(raw.select(made.alias("file"), *[col(c).alias(f"c{i}") for i, c in enumerate(self.columns)]))

    def _facts(self, name: str, at: Column) -> Column:
        label = self.labels[name]
        made = {"rows": F.count(F.lit(1)), "non_null": F.count(at)}
        if label in (INTEGER, FLOAT):
            v = at.cast("double")
            lead, rest = float_parts(v)
            # Merged by the usual formula for two parts: squares around each file's own mean.
            made |= {"avg": F.avg(v), "m2": F.var_pop(v) * F.count(v)}
            if label == INTEGER:
                whole = at.cast("bigint")
                made |= {"int_sum": F.sum(at.cast("decimal(20,0)")), "int_low": F.min(whole), "int_high": F.max(whole)}
            else:
                made |= {"lead": F.sum(lead), "rest": F.sum(rest), "low": F.min(v), "high": F.max(v)}
        elif label == BOOLEAN:
            made["trues"] = F.count_if(at)
        elif label == DATETIME:
            t = at.cast("timestamp_ntz")
            made |= {"non_null": F.count(t), "first": F.min(t), "last": F.max(t)}
        fields = [made.get(n, F.lit(None)).cast(t).alias(n) for n, t in (f.split() for f in FACTS.split(", "))]
        return F.struct(F.lit(self.columns.index(name)).alias("ordinal"), *fields)

    def keep_states(self) -> None:
        """Read the files without a state, once per kind of column, and keep theirs."""
        new = self.unknown()
        if not new or not self.columns:
            return
        df, batch = self._read(list(new.values())), f"batch-{uuid.uuid4().hex}"
        at = {c: F.col(f"c{i}") for i, c in enumerate(self.columns)}
        if self.texts:
            self._write(self._text_counts(df, at), batch, "texts")
        if self.numbers:
            self._write(self._number_counts(df, at), batch, "numbers")
        aggs = [self._facts(c, at[c]).alias(f"f{i}") for i, c in enumerate(self.columns)]
        wide = df.groupBy("file").agg(*aggs)
        facts = wide.select("file", F.inline(F.array(*[F.col(f"f{i}") for i in range(len(aggs))])))
        # Files without rows have a state as well, or they would be read again each time.
        known = local_frame(self.spark, [(f,) for f in new], "file bigint")
        self._write(known.join(facts, "file", "left"), batch, "facts")

    def _write(self, states: DataFrame, batch: str, part: str) -> None:
        states.withColumn("batch", F.lit(batch)).write.parquet(f"{self.root}/{batch}/{part}")

    def _text_counts(self, df: DataFrame, at: dict[str, Column]) -> DataFrame:
        ids = [str(i) for i in range(len(self.texts))]
        cells = df.select("file", *[at[c].alias(i) for i, c in zip(ids, self.texts)])
        cells = cells.unpivot(["file"], ids, "column", "value").where(F.col("value").isNotNull())
        head = F.substring("value", 1, P.KEY_LENGTH).alias("head")
        date = F.when(pattern_of(F.col("value")).isNotNull(), F.trim("value")).alias("date")
        keys = cells.select("file", "column", head, P._digest(), date)
        return keys.groupBy("file", "column", "head", "digest", "date").agg(F.count(F.lit(1)).alias("count"))

    def _number_counts(self, df: DataFrame, at: dict[str, Column]) -> DataFrame:
        ids = [str(i) for i in range(len(self.numbers))]
        cells = df.select("file", *[at[c].cast("double").alias(i) for i, c in zip(ids, self.numbers)])
        cells = cells.unpivot(["file"], ids, "column", "value").where(F.col("value").isNotNull())
        counts = cells.groupBy("file", "column", "value").agg(F.count(F.lit(1)).alias("count"))
        return counts.sortWithinPartitions("column", "value")  # brackets then skip row groups

    def _states(self, part: str) -> DataFrame:
        """The states of the present files, each from its one batch."""
        batches = sorted(set(self.owned.values()))
        states = self.spark.read.parquet(*[f"{self.root}/{b}/{part}" for b in batches])
        mine = local_frame(self.spark, list(self.owned.items()), "file bigint, batch string")
        return states.join(mine, ["file", "batch"], "left_semi")

    # ---- profiles --------------------------------------------------------------

    def profile(self, top_n: int) -> list[dict]:
        self.keep_states()
        empty = [{"table": self.name, "row_count": 0, "column_count": 0, "note": P.NOTE_EMPTY}]
        if not self.files or not self.columns:
            return empty
        self.owned = self.owners()
        stats = self._merged()
        rows = max((s["rows"] for s in stats.values()), default=0)
        if not rows:
            return empty
        dates = self._dates() if self.texts else {}
        texts = self._text_stats([c for c in self.texts if c not in dates], top_n) if self.texts else {}
        medians = counted_medians(self._states("numbers")) if self.numbers else {}
        out = []
        for i, c in enumerate(self.columns):
            label = DATETIME_INFERRED if c in dates else self.labels[c]
            raw = dates.get(c) or stats[c]
            number = self.numbers.index(c) if c in self.numbers else None
            row = {"table": self.name, "ordinal": i, "column": c, "label": label}
            row |= {"row_count": rows, "column_count": len(self.columns)}
            out.append(row | P._finish(label, rows, raw, medians.get(str(number)), raw.get("int_sum"), texts.get(c)))
        return out

    def _merged(self) -> dict[str, dict]:
        facts = self._states("facts").where(F.col("ordinal").isNotNull())
        both = facts.groupBy("ordinal").agg(
            *[F.sum(n).alias(n) for n in ("rows", "non_null", "int_sum", "trues")],
            (F.sum("lead") + F.coalesce(F.sum("rest"), F.lit(0.0))).alias("sum"),
            (F.sum(F.col("avg") * F.col("non_null")) / F.sum("non_null")).alias("mean"),
            *[F.min(n).alias(n) for n in ("low", "int_low", "first")],
            *[F.max(n).alias(n) for n in ("high", "int_high", "last")],
        ).select(
            "*", iso_text(F.col("first")).alias("min_date"), iso_text(F.col("last")).alias("max_date"),
            F.timestamp_diff("DAY", F.col("first"), F.col("last")).alias("date_range_days"),
        ).collect()
        means = local_frame(self.spark, [(r["ordinal"], r["mean"]) for r in both], "ordinal int, mean double")
        away = F.col("avg") - F.col("mean")
        squares = facts.join(means, "ordinal").groupBy("ordinal").agg(
            F.sum(F.col("m2") + F.col("non_null") * away * away).alias("m2")
        )
        m2 = {r["ordinal"]: r["m2"] for r in squares.collect()}
        stats = {}
        for r in both:
            name, raw = self.columns[r["ordinal"]], r.asDict()
            integer = self.labels[name] == INTEGER
            raw["min"], raw["max"] = (raw["int_low"], raw["int_high"]) if integer else (raw["low"], raw["high"])
            n, spread = raw["non_null"], m2[r["ordinal"]]
            raw["std_dev"] = (spread / (n - 1)) ** 0.5 if n > 1 and spread is not None else None
            raw["true_count"], raw["false_count"] = raw["trues"], None if raw["trues"] is None else n - raw["trues"]
            stats[name] = raw
        return stats

    def _dates(self) -> dict[str, dict]:
        """Statistics of the text columns that hold dates, by the rules of a full profile."""
        counts = self._states("texts")
        seen = counts.groupBy("column", pattern_of(F.col("date")).alias("pattern")).agg(F.sum("count").alias("values"))
        formats = P.date_patterns(self.texts, seen.collect())
        if not formats:
            return {}
        ids = {str(self.texts.index(c)): p for c, p in formats.items()}
        time = F.lit(None).cast("timestamp_ntz")
        text = F.coalesce("date", "head")
        for i, pattern in ids.items():
            time = F.when(F.col("column") == i, parse_date(text, pattern)).otherwise(time)
        parsed = counts.where(F.col("column").isin(list(ids))).select("column", "count", time.alias("t"))
        first, last = F.min("t"), F.max("t")
        rows = parsed.groupBy("column").agg(
            F.sum("count").alias("values"),
            F.coalesce(F.sum(F.when(F.col("t").isNotNull(), F.col("count"))), F.lit(0)).alias("non_null"),
            iso_text(first).alias("min_date"),
            iso_text(last).alias("max_date"),
            F.timestamp_diff("DAY", first, last).alias("date_range_days"),
        ).collect()
        found = {self.texts[int(r["column"])]: r.asDict() for r in rows}
        return {c: r for c, r in found.items() if P._is_dates({"dates": r, "non_null": r["values"]})}

    def _text_stats(self, wanted: list[str], top_n: int) -> dict[str, dict]:
        ids = [str(self.texts.index(c)) for c in wanted]
        counts = self._states("texts").where(F.col("column").isin(ids))
        merged = counts.groupBy("column", "head", "digest").agg(F.sum("count").alias("count"))
        rows = P._summary(merged, top_n).collect()
        stats = {self.texts[int(r["column"])]: r.asDict() for r in rows if r["rank"] is None}
        listed = P._listed(self.frame, self.texts, [r for r in rows if r["rank"] is not None])
        for c, _, value, count in listed:
            stats[c].setdefault("top_values", []).append((value, count))
        return stats


# ---- medians of counted numbers --------------------------------------------------


def _within(bounds: dict[str, tuple[float | None, float | None]]) -> Column:
    """Rows of each column above its lower bound and not above its upper one."""
    parts = []
    for column, (low, high) in bounds.items():
        here = F.col("column") == column
        here = here if low is None else here & (F.col("value") > low)
        parts.append(here if high is None else here & (F.col("value") <= high))
    return reduce(or_, parts)


def counted_medians(counts: DataFrame) -> dict[str, float]:
    """Exact median per column of ``column, value, count``, where a value may have many rows.

    A sketch of the rows cuts the bracket of a column into parts, their counts are added up,
    and the part with the median is the next bracket, until it holds few rows; those are
    grouped and ranked. Where equal values keep a bracket from shrinking they combine before
    the shuffle."""
    sizes = {r["column"]: (r["rows"], r["n"]) for r in counts.groupBy("column").agg(F.count(F.lit(1)).alias("rows"), F.sum("count").alias("n")).collect()}
    total = {c: n for c, (_, n) in sizes.items()}
    rows = {c: k for c, (k, _) in sizes.items()}
    bounds: dict[str, tuple[float | None, float | None]] = {c: (None, None) for c in sizes}
    below = dict.fromkeys(sizes, 0)
    wide = [c for c in sizes if rows[c] > MOST_RANKED]
    while wide:
        inside = counts.where(_within({c: bounds[c] for c in wide}))
        cuts = _cuts(inside)
        grid = F.create_map(*[x for c in wide for x in (F.lit(c), F.array(*map(F.lit, cuts[c])))])
        graded = inside.select("column", "value", "count", grid[F.col("column")].alias("grid"))
        upto = [F.when(F.col("value") <= F.col("grid")[j], F.col("count")) for j in range(STEPS + 1)]
        less = [F.count(u).alias(f"rows{j}") for j, u in enumerate(upto)]
        added = graded.groupBy("column").agg(*less, *[F.coalesce(F.sum(u), F.lit(0)).alias(f"n{j}") for j, u in enumerate(upto)])
        still = []
        for r in added.collect():
            c = r["column"]
            low, high = bounds[c]
            first, last = (total[c] - 1) // 2 - below[c], total[c] // 2 - below[c]
            under = [j for j in range(STEPS + 1) if r[f"n{j}"] <= first]
            over = [j for j in range(STEPS + 1) if r[f"n{j}"] > last]
            left = rows[c]
            if over:
                high, left = cuts[c][over[0]], r[f"rows{over[0]}"]
            if under:
                low, left = cuts[c][under[-1]], left - r[f"rows{under[-1]}"]
                below[c] += r[f"n{under[-1]}"]
            if MOST_RANKED < left < rows[c]:
                still.append(c)
            bounds[c], rows[c] = (low, high), left
        wide = still
    if not bounds:
        return {}
    near = counts.where(_within(bounds)).groupBy("column", "value").agg(F.sum("count").alias("n"))
    running = Window.partitionBy("column").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    place = near.withColumn("upto", F.sum("n").over(running))

    def value_at(half: dict[str, int]) -> Column:
        rank = F.create_map(*[x for c, r in half.items() for x in (F.lit(c), F.lit(r))])[F.col("column")]
        return F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank), F.col("value")))

    first = {c: (n - 1) // 2 - below[c] for c, n in total.items()}
    last = {c: n // 2 - below[c] for c, n in total.items()}
    middle = place.groupBy("column").agg(value_at(first).alias("a"), value_at(last).alias("b"))
    return {r["column"]: (r["a"] + r["b"]) / 2 for r in middle.collect()}


def _cuts(inside: DataFrame) -> dict[str, list[float]]:
    """Evenly spaced quantiles of the rows of each column."""
    steps = F.array(*[F.lit(j / STEPS) for j in range(STEPS + 1)])
    size = F.lit(SKETCH_SIZE)
    parts = inside.groupBy("column", (F.spark_partition_id() % MERGE_GROUPS).alias("g")).agg(
        F.kll_sketch_agg_double("value", size).alias("s")
    )
    merged = parts.groupBy("column").agg(F.kll_merge_agg_double("s", size).alias("s"))
    return {r["column"]: r["q"] for r in merged.select("column", F.kll_sketch_get_quantile_double("s", steps).alias("q")).collect()}
