"""Aggregate-only profiles of tables: one row per column, never a source row.

A table is read a few times, each time only the columns concerned: text columns for the
shapes of their values and how many differ, then one aggregate over all columns, one frequency table of the
text columns, and the median passes. These three are submitted together. Only their results, a few numbers per column, reach the
driver.
"""

from __future__ import annotations

from decimal import Decimal
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    BOOLEAN,
    DATETIME_INFERRED,
    FLOAT,
    INTEGER,
    TEXT,
    col,
    data_columns,
    dtype_of,
    float_sum,
    label_of,
    local_frame,
)
from ..functions.dates import parse_date, pattern_of, pattern_order
from ..functions.formats import iso_text
from ..functions.names import match_key
from .median import exact_medians

# Limits and notes of a profile.
TOP_VALUES = 5
CONDENSED_TOP_VALUES = 3
IDENTIFIER_MIN_VALUES = 10
IDENTIFIER_MIN_RATIO = 0.9
DATE_MIN_RATIO = 0.5
NOTE_MISSING = "all values missing"
NOTE_IDENTIFIER = "identifier-like column, top values suppressed"
NOTE_EMPTY = "table is empty or has no data rows"
NOTE_UNSUPPORTED = "unsupported type"

KEY_LENGTH = 128
"""Texts are counted by so many leading characters and, if longer, a digest of the whole,
so the shuffle does not carry long texts."""

SKETCH_ERROR = 0.02
VARIED_FROM = 50_000
VARIED_RATIO = 0.5
"""A text column is varied from so many distinct values and such a share of its values on:
combining before the shuffle hardly helps, so only hashes of its values are moved."""

MOST_CANDIDATES = 100_000
"""Values of varied columns that are looked up to rank equal counts by their text."""

COLUMNS_PER_JOB = 64
TEXT_COLUMNS_PER_JOB = 32

PROFILE_SCHEMA = (
    "table string, ordinal int, column string, label string, row_count bigint, "
    "column_count int, count bigint, non_null bigint, missing_pct double, sum double, "
    "mean double, median double, min double, max double, std_dev double, "
    "int_sum decimal(38,0), int_min bigint, int_max bigint, min_date string, "
    "max_date string, date_range_days bigint, true_count bigint, false_count bigint, "
    "true_pct double, unique_values bigint, identifier_like boolean, "
    "top_values array<struct<value:string,count:bigint>>, note string"
)


# ---- type labels ---------------------------------------------------------------


def text_shapes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Date pattern per text column, from all its values."""
    return text_facts(df, columns)[0]


def text_facts(df: DataFrame, columns: list[str]) -> tuple[dict[str, str], set[str]]:
    """Date pattern per text column, and the columns whose values mostly differ, by one scan.

    The pattern is that of most values (the first in the list of shapes if several are as
    common), for columns of which half of the values look like dates. Distinct values are
    estimated by sketches, one per pattern, as a value has one pattern; they only choose how
    a column is counted, never what is reported."""
    formats, varied = {}, set()
    for start in range(0, len(columns), TEXT_COLUMNS_PER_JOB):
        chunk = columns[start : start + TEXT_COLUMNS_PER_JOB]
        cells = _cells(df, chunk).select("column", "value", pattern_of(F.col("value")).alias("pattern"))
        counts = cells.groupBy("column", "pattern").agg(
            F.count(F.lit(1)).alias("values"), F.approx_count_distinct("value", SKETCH_ERROR).alias("distinct")
        ).collect()
        for i, c in enumerate(chunk):
            own = [r for r in counts if r["column"] == str(i)]
            distinct = sum(r["distinct"] for r in own)
            if distinct >= max(VARIED_FROM, VARIED_RATIO * sum(r["values"] for r in own)):
                varied.add(c)
        formats |= date_patterns(chunk, counts)
    return formats, varied


def date_patterns(columns: list[str], counts: list) -> dict[str, str]:
    """Pattern per column of dates, from ``column, pattern, values`` with columns by number."""
    formats = {}
    for i, c in enumerate(columns):
        own = [r for r in counts if r["column"] == str(i)]
        dates = sorted((r for r in own if r["pattern"]), key=lambda r: (-r["values"], pattern_order(r["pattern"])))
        if dates and sum(r["values"] for r in dates) >= DATE_MIN_RATIO * sum(r["values"] for r in own):
            formats[c] = dates[0]["pattern"]
    return formats


def datetime_ratio(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Per text column how many of its values are dates in its one pattern."""
    parts = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(pattern).alias("pattern"),
            F.count(col(c)).alias("non_null"),
            F.count(parse_date(col(c), pattern)).alias("parsed"),
        ).alias(str(i))
        for i, (c, pattern) in enumerate(formats.items())
    ]
    row = df.agg(*parts).select(F.inline(F.array(*[F.col(str(i)) for i in range(len(parts))])))
    ratio = F.when(F.col("non_null") > 0, F.col("parsed") / F.col("non_null"))
    inferred = F.coalesce((ratio >= DATE_MIN_RATIO) & (F.col("parsed") > 0), F.lit(False))
    return row.select("*", ratio.alias("ratio"), inferred.alias("is_datetime"))


def infer_types(df: DataFrame) -> DataFrame:
    """``ordinal, column, label`` per column."""
    names = data_columns(df)
    labels = {c: label_of(dtype_of(df, c)) for c in names}
    text = [c for c in names if labels[c] == TEXT]
    formats = text_shapes(df, text)
    if formats:
        for row in datetime_ratio(df, formats).collect():
            if row["is_datetime"]:
                labels[row["column"]] = DATETIME_INFERRED
    rows = [(i, c, labels[c]) for i, c in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column string, label string")


# ---- one aggregate over all columns --------------------------------------------


def _numeric_stats(c: Column, integer: bool) -> list[Column]:
    v = c.cast("double")
    exact = F.try_sum(c.cast("bigint")) if integer else F.lit(None).cast("bigint")
    return [
        F.count(c).alias("non_null"),
        exact.alias("int_sum"),
        (F.lit(None).cast("double") if integer else float_sum(v)).alias("sum"),
        F.min(c.cast("bigint") if integer else v).alias("min"),
        F.max(c.cast("bigint") if integer else v).alias("max"),
        F.stddev_samp(v).alias("std_dev"),
    ]


def _datetime_stats(c: Column) -> list[Column]:
    t = c.cast("timestamp_ntz")
    return [
        F.count(t).alias("non_null"),
        iso_text(F.min(t)).alias("min_date"),
        iso_text(F.max(t)).alias("max_date"),
        F.timestamp_diff("DAY", F.min(t), F.max(t)).alias("date_range_days"),
    ]


def _boolean_stats(c: Column) -> list[Column]:
    return [
        F.count(c).alias("non_null"),
        F.count_if(c).alias("true_count"),
        F.count_if(~c).alias("false_count"),
    ]


def _column_stats(df: DataFrame, name: str, label: str | None, pattern: str | None) -> list[Column]:
    c = col(name)
    if label in (INTEGER, FLOAT):
        return _numeric_stats(c, label == INTEGER)
    if label == BOOLEAN:
        return _boolean_stats(c)
    if label == TEXT:
        stats = [F.count(c).alias("non_null")]
        if pattern:
            stats.append(F.struct(*_datetime_stats(parse_date(c, pattern))).alias("dates"))
        return stats
    if label is None:
        return [F.count(c).alias("non_null")]
    return _datetime_stats(c)


def _scan_stats(df: DataFrame, plan: list[tuple[str, str | None, str | None]]) -> tuple[int, dict]:
    """Row count and the raw statistics of every column, a few columns per job."""
    stats, rows = {}, 0
    for start in range(0, max(len(plan), 1), COLUMNS_PER_JOB):
        chunk = plan[start : start + COLUMNS_PER_JOB]
        aggs = [F.struct(*_column_stats(df, *p)).alias(f"c{i}") for i, p in enumerate(chunk)]
        row = df.agg(F.count(F.lit(1)).alias("rows"), *aggs).first()
        rows = row["rows"]
        for i, (name, _, _) in enumerate(chunk):
            stats[name] = row[f"c{i}"].asDict()
    return rows, stats


def _exact_sums(df: DataFrame, names: list[str]) -> dict[str, Decimal]:
    """Integer sums that do not fit a bigint."""
    row = df.agg(*[F.sum(col(c).cast("decimal(20,0)")).alias(str(i)) for i, c in enumerate(names)])
    return dict(zip(names, row.first()))


# ---- frequencies of text values ------------------------------------------------


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, value`` of all non-null values; columns by number, to keep rows small."""
    ids = [str(i) for i in range(len(columns))]
    values = df.select(*[col(c).cast("string").alias(i) for i, c in zip(ids, columns)])
    return values.unpivot([], ids, "column", "value").where(F.col("value").isNotNull())


def _digest() -> Column:
    return F.when(F.length("value") > KEY_LENGTH, F.unhex(F.sha2("value", 256))).alias("digest")


def value_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, head, digest, count`` of all non-null values, for any number of columns:
    the first characters of a value, and a digest of it if it has more.

    Equal values are combined before the shuffle, so a frequent value costs nothing."""
    head = F.substring("value", 1, KEY_LENGTH).alias("head")
    keys = _cells(df, columns).select("column", head, _digest())
    return keys.groupBy("column", "head", "digest").agg(F.count(F.lit(1)).alias("count"))


def _hashes() -> list[Column]:
    """128 bits of a value, by which equal values are found without moving them."""
    return [F.xxhash64("value").alias("h1"), F.xxhash64(F.lit("second"), "value").alias("h2")]


def hashed_frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, h1, h2, count`` of all non-null values: as :func:`value_frequencies`, with
    sixteen bytes in the place of the value."""
    keys = _cells(df, columns).select("column", *_hashes())
    return keys.groupBy("column", "h1", "h2").agg(F.count(F.lit(1)).alias("count"))


def _rollup(frequencies: DataFrame) -> DataFrame:
    distinct = F.count(F.lit(1))
    values = F.sum("count")
    flagged = (values >= IDENTIFIER_MIN_VALUES) & (distinct / values >= IDENTIFIER_MIN_RATIO)
    return frequencies.groupBy("column").agg(
        values.alias("non_null"),
        distinct.alias("unique_values"),
        flagged.alias("identifier_like"),
    )


def _top(frequencies: DataFrame, n: int) -> DataFrame:
    """The most frequent values per column, equal counts by key. The rank filter lets Spark
    cut every task down to ``n`` rows per column before the shuffle."""
    order = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("head"), F.asc_nulls_first("digest"))
    ranked = frequencies.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n).select("column", "rank", "head", "digest", "count")


def _listed(df: DataFrame, columns: list[str], top: list) -> list[tuple[str, int, str, int]]:
    """Column, rank, whole value and count of the top values, a few per column. The table
    is read again only where one of them is longer than its key."""
    wanted = [(r["column"], bytes(r["digest"])) for r in top if r["digest"] is not None]
    whole = {}
    if wanted:
        digests = local_frame(df.sparkSession, wanted, "column string, digest binary")
        texts = _cells(df, columns).select("column", "value", _digest()).join(digests, ["column", "digest"])
        whole = {(r["column"], bytes(r["digest"])): r["value"] for r in texts.distinct().collect()}
    listed = []
    for r in sorted(top, key=lambda r: (int(r["column"]), r["rank"])):
        value = r["head"] if r["digest"] is None else whole[r["column"], bytes(r["digest"])]
        listed.append((columns[int(r["column"])], r["rank"], value, r["count"]))
    return listed


def _named(df: DataFrame, columns: list[str]) -> Column:
    names = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(str(i)), F.lit(c))])
    return names[F.col("column")].alias("column")


def top_values(df: DataFrame, columns: list[str], n: int = TOP_VALUES) -> DataFrame:
    """``column, rank, value, count``: most frequent values, equal counts by their first
    :data:`KEY_LENGTH` characters, then by digest."""
    top = _top(value_frequencies(df, columns), n).collect()
    return local_frame(df.sparkSession, _listed(df, columns, top), "column string, rank int, value string, count bigint")


def identifier_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, non_null, unique_values, identifier_like``."""
    rolled = _rollup(hashed_frequencies(df, columns))
    return rolled.select(_named(df, columns), "non_null", "unique_values", "identifier_like")


def _summary(frequencies: DataFrame, n: int) -> DataFrame:
    """A row per column, then the ``n`` top values of each column that may show any."""
    rolled = _rollup(frequencies)
    shown = F.broadcast(rolled.where(~F.col("identifier_like")).select("column"))  # one row a column
    # Not a semi join: that one moves below the count, and the values are counted twice.
    top = _top(frequencies.join(shown, "column"), n)
    return rolled.unionByName(top, allowMissingColumns=True)


def _varied_stats(df: DataFrame, columns: list[str], n: int) -> dict[str, dict]:
    """Statistics of text columns whose values mostly differ.

    Distinct values are counted by their hashes, exactly but for hashes of 128 bits that
    meet. Most such columns are identifiers, which show no top values. For the others the
    n-th highest count proves that no value below it can be listed; the values with that
    count or more are looked up, and ranked with their texts. If too many have equal counts,
    the column is counted by its texts."""
    counts = hashed_frequencies(df, columns).persist()
    try:
        stats = {columns[int(r["column"])]: r.asDict() for r in _rollup(counts).collect()}
        shown = [c for c in columns if c in stats and not stats[c]["identifier_like"]]
        if shown:
            ids = [str(columns.index(c)) for c in shown]
            order = Window.partitionBy("column").orderBy(F.desc("count"))
            ranked = counts.where(F.col("column").isin(ids)).withColumn("rank", F.row_number().over(order))
            least = {r["column"]: r["least"] for r in ranked.where(F.col("rank") <= n).groupBy("column").agg(F.min("count").alias("least")).collect()}
            bounds = F.create_map(*[x for k, v in least.items() for x in (F.lit(k), F.lit(v))])
            found = counts.where(F.col("count") >= bounds[F.col("column")])
            if found.count() <= MOST_CANDIDATES:
                head = F.substring("value", 1, KEY_LENGTH).alias("head")
                cells = _cells(df, columns).where(F.col("column").isin(ids)).select("column", head, _digest(), *_hashes())
                frequencies = cells.join(found, ["column", "h1", "h2"]).select("column", "head", "digest", "count").distinct()
                top = _top(frequencies, n).collect()
            else:
                named = value_frequencies(df, shown).withColumn("column", F.element_at(F.array(*map(F.lit, ids)), F.col("column").cast("int") + 1))
                top = _top(named, n).collect()
            for c, _, value, count in _listed(df, columns, top):
                stats[c].setdefault("top_values", []).append((value, count))
    finally:
        counts.unpersist()
    return stats


def _text_stats(df: DataFrame, columns: list[str], n: int, varied: set[str]) -> dict[str, dict]:
    """Statistics of text columns: of varied ones by hashes, of others from one frequency table."""
    stats: dict[str, dict] = {}
    hashed, columns = [c for c in columns if c in varied], [c for c in columns if c not in varied]
    for start in range(0, len(hashed), TEXT_COLUMNS_PER_JOB):
        stats |= _varied_stats(df, hashed[start : start + TEXT_COLUMNS_PER_JOB], n)
    for start in range(0, len(columns), TEXT_COLUMNS_PER_JOB):
        chunk = columns[start : start + TEXT_COLUMNS_PER_JOB]
        rows = _summary(value_frequencies(df, chunk), n).collect()
        stats |= {chunk[int(r["column"])]: r.asDict() for r in rows if r["rank"] is None}
        for c, _, value, count in _listed(df, chunk, [r for r in rows if r["rank"] is not None]):
            stats[c].setdefault("top_values", []).append((value, count))
    return stats


# ---- profiles ------------------------------------------------------------------


def _one_digit(x: float) -> float:
    return round(x * 10) / 10


def _four_digits(x: float | None) -> float | None:
    return None if x is None or x != x else round(float(x), 4)


def _is_dates(raw: dict) -> bool:
    parsed = raw["dates"]["non_null"] if raw.get("dates") else 0
    return parsed > 0 and parsed >= DATE_MIN_RATIO * raw["non_null"]


def profile_table(df: DataFrame, name: str = "", top_n: int = TOP_VALUES) -> DataFrame:
    """Profile of one table: a row per column, or one note row if it has no rows."""
    return _to_frame(df.sparkSession, _profile_rows(df, name, top_n))


def _to_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = [f.split()[0] for f in PROFILE_SCHEMA.split(", ")]
    listed = [r | {"top_values": r.get("top_values") and [{"value": v, "count": n} for v, n in r["top_values"]]} for r in rows]
    return local_frame(spark, [tuple(r.get(n) for n in names) for r in listed], PROFILE_SCHEMA)


def _profile_rows(df: DataFrame, name: str, top_n: int) -> list[dict]:
    columns = data_columns(df)
    labels = {c: label_of(dtype_of(df, c)) for c in columns}
    df = df.select(
        *[
            F.nanvl(col(c), F.lit(None)).alias(c) if _may_be_nan(dtype_of(df, c)) else col(c)
            for c in columns
        ]
    )
    text = [c for c in columns if labels[c] == TEXT]
    formats, varied = text_facts(df, text)
    numeric = [c for c in columns if labels[c] in (INTEGER, FLOAT)]

    # Texts without a date pattern are only read for their frequencies, which also count
    # their values; all other columns share the scan.
    listed = [c for c in text if c not in formats]
    scanned = [(c, labels[c], formats.get(c)) for c in columns if c not in listed]
    with ThreadPool(2) as pool:
        medians_job = pool.apply_async(exact_medians, (df, numeric))
        texts_job = pool.apply_async(_text_stats, (df, listed, top_n, varied))
        rows, stats = _scan_stats(df, scanned)
        medians, texts = medians_job.get(), texts_job.get()
    stats |= {c: texts.get(c, {"non_null": 0}) for c in listed}
    if rows == 0:
        return [{"table": name, "row_count": 0, "column_count": 0, "note": NOTE_EMPTY}]

    dated = {c for c in formats if _is_dates(stats[c])}
    texts |= _text_stats(df, [c for c in formats if c not in dated and c not in texts], top_n, varied)
    overflown = [
        c for c in numeric if labels[c] == INTEGER and stats[c]["non_null"] and stats[c]["int_sum"] is None
    ]
    sums = _exact_sums(df, overflown) if overflown else {}

    out = []
    for i, c in enumerate(columns):
        label = DATETIME_INFERRED if c in dated else labels[c]
        raw = stats[c]["dates"] if c in dated else stats[c]
        row = {"table": name, "ordinal": i, "column": c, "label": label}
        row |= {"row_count": rows, "column_count": len(columns)}
        out.append(row | _finish(label, rows, raw, medians.get(c), sums.get(c), texts.get(c)))
    return out


def _may_be_nan(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def _finish(label, rows: int, raw: dict, median, exact_sum, text: dict | None) -> dict:
    """The statistics of one column, rounded as they are reported."""
    if label is None:
        return {"note": NOTE_UNSUPPORTED}
    n = raw["non_null"]
    if n == 0:
        return {"count": 0, "non_null": 0, "note": NOTE_MISSING}
    done = {"count": rows, "non_null": n, "missing_pct": _one_digit((rows - n) / rows * 100)}
    if label in (INTEGER, FLOAT):
        done |= {k: _four_digits(raw[k]) for k in ("min", "max", "std_dev")}
        done["median"] = _four_digits(median)
        if label == INTEGER:
            exact = exact_sum if exact_sum is not None else Decimal(raw["int_sum"])
            done |= {"int_sum": exact, "int_min": raw["min"], "int_max": raw["max"]}
            done |= {"sum": float(exact), "mean": _four_digits(float(exact) / n)}
        else:
            done |= {"sum": _four_digits(raw["sum"]), "mean": _four_digits(raw["sum"] / n)}
    elif label == BOOLEAN:
        done |= {"true_count": raw["true_count"], "false_count": raw["false_count"]}
        done["true_pct"] = _one_digit(raw["true_count"] / n * 100)
    elif label == TEXT:
        done |= {k: text.get(k) for k in ("unique_values", "identifier_like", "top_values")}
        done["note"] = NOTE_IDENTIFIER if text["identifier_like"] else None
    else:
        done |= {k: raw[k] for k in ("min_date", "max_date", "date_range_days")}
    return done


def profile_workspace(tables: dict[str, DataFrame], top_n: int = TOP_VALUES) -> DataFrame:
    """Profiles of all tables, a few tables at a time."""
    if not tables:
        raise ValueError("no tables")
    spark = next(iter(tables.values())).sparkSession
    with ThreadPool(min(8, len(tables))) as pool:
        profiles = pool.starmap(_profile_rows, [(df, n, top_n) for n, df in tables.items()])
    return _to_frame(spark, [row for rows in profiles for row in rows])


KIND_FIELDS = {
    "numeric": ["sum", "mean", "median", "min", "max", "std_dev"],
    "datetime": ["min_date", "max_date", "date_range_days"],
    "boolean": ["true_count", "false_count", "true_pct"],
    "categorical": ["unique_values", "identifier_like"],
}


def _kind(df: DataFrame, columns: list[str] | None, kind: str) -> DataFrame:
    wanted = columns or data_columns(df)
    profile = profile_table(df.select(*[col(c) for c in wanted]))
    label = F.substring_index("label", " ", 1)
    rows = profile.where((label == kind) | F.col("note").eqNullSafe(NOTE_MISSING))
    return rows.select("column", "count", "non_null", "missing_pct", *KIND_FIELDS[kind], "note")


def profile_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return _kind(df, columns, "numeric")


def profile_datetime(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return _kind(df, columns, "datetime")


def profile_boolean(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return _kind(df, columns, "boolean")


def profile_categorical(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return _kind(df, columns, "categorical")


# ---- what is derived from a profile --------------------------------------------


def condense(profile: DataFrame) -> DataFrame:
    """The few statistics a spec writer needs; top values cut to three."""
    return profile.select(
        "table",
        "row_count",
        F.when(F.col("column").isNull(), F.col("note")).alias("note"),
        "ordinal",
        "column",
        F.coalesce("label", F.when(F.col("column").isNotNull(), F.lit("unknown"))).alias("type"),
        "sum",
        "mean",
        "int_sum",
        "min_date",
        "max_date",
        "unique_values",
        F.slice("top_values", 1, CONDENSED_TOP_VALUES).alias("top_values"),
        F.when(F.col("identifier_like"), F.lit(True)).alias("identifier_like"),
    )


def profile_to_json(profile: DataFrame) -> DataFrame:
    """``table, json`` with one document per table; absent statistics are left out.

    Works on full and on condensed profiles. A table contributes as many rows as it has
    columns, so gathering them is bounded by the schema."""
    table_level = ("table", "row_count", "column_count", "ordinal", "column")
    mixed = {"sum": "int_sum", "min": "int_min", "max": "int_max"}
    fields = []
    for name in profile.columns:
        if name in table_level or name in mixed.values():
            continue
        value = F.col(name)
        if name in mixed and mixed[name] in profile.columns:
            whole = F.col(mixed[name]).cast("variant")
            value = F.when(F.col(mixed[name]).isNotNull(), whole).otherwise(value.cast("variant"))
        elif name == "top_values":
            value = F.map_from_entries(value)
        fields.append(value.alias("inferred_type" if name == "label" else name))
    entry = F.struct(F.col("ordinal"), F.col("column").alias("key"), F.struct(*fields).alias("value"))
    head = [c for c in ("row_count", "column_count") if c in profile.columns]
    documents = profile.groupBy("table").agg(
        *[F.first(c).alias(c) for c in head],
        F.max(F.when(F.col("column").isNull(), F.col("note"))).alias("note"),
        F.array_sort(F.collect_list(F.when(F.col("column").isNotNull(), entry.dropFields("value")))).alias("order"),
        F.map_from_entries(
            F.collect_list(F.when(F.col("column").isNotNull(), F.struct(F.col("column"), entry["value"])))
        ).alias("by_name"),
    )
    ordered = F.map_from_entries(
        F.transform("order", lambda o: F.struct(o["key"].alias("key"), F.col("by_name")[o["key"]].alias("value")))
    )
    return documents.select(
        "table",
        F.to_json(F.struct(F.col("table").alias("sheet_name"), *head, "note", ordered.alias("columns"))).alias("json"),
    )


def drop_identifier_columns(specs: DataFrame, profile: DataFrame) -> DataFrame:
    """Specs without the identifier-like columns of their table in ``data_columns``."""
    flagged = (
        profile.where(F.col("identifier_like"))
        .groupBy(F.col("table").alias("source_sheet"))
        .agg(F.collect_set(match_key(F.col("column"))).alias("hidden"))
    )
    hidden = F.coalesce("hidden", F.array().cast("array<string>"))
    kept = F.filter("data_columns", lambda c: ~F.array_contains(hidden, match_key(c)))
    joined = specs.join(flagged, "source_sheet", "left")
    return joined.withColumn("data_columns", kept).select(*specs.columns)
