"""Date texts: the formats known and which one a sample value has."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of date texts, the Spark pattern each is read with, and the range
# a time must lie in.
DATE_SHAPES = [
    (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"),
    (r"\d{8}", "yyyyMMdd"),
    (r"\d{4}-\d{1,2}", "yyyy-M"),
    (r"\d{4}", "yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"),
    (r"\d{1,2}/\d{1,2}/\d{2}", "M/d/yy"),
    (r"\d{1,2}-\d{1,2}-\d{4}", "M-d-yyyy"),
    (r"\d{1,2}\.\d{1,2}\.\d{4}", "M.d.yyyy"),
    (r"[A-Za-z]{3} \d{1,2}, \d{4}", "MMM d, yyyy"),
    (r"[A-Za-z]{4,9} \d{1,2}, \d{4}", "MMMM d, yyyy"),
    (r"\d{1,2} [A-Za-z]{3} \d{4}", "d MMM yyyy"),
    (r"\d{1,2} [A-Za-z]{4,9} \d{4}", "d MMMM yyyy"),
    (r"\d{1,2}-[A-Za-z]{3}-\d{4}", "d-MMM-yyyy"),
    (r"\d{1,2}-[A-Za-z]{3}-\d{2}", "d-MMM-yy"),
    (r"[A-Za-z]{3} \d{4}", "MMM yyyy"),
]
TIME_SHAPES = [
    (r"", ""),
    (r" \d{1,2}:\d{2}", " H:mm"),
    (r" \d{1,2}:\d{2} [AaPp][Mm]", " h:mm a"),
    (r" \d{1,2}:\d{2}:\d{2} [AaPp][Mm]", " h:mm:ss a"),
    (r" \d{1,2}:\d{2}:\d{2}", " H:mm:ss"),
    (r" \d{1,2}:\d{2}:\d{2}\.\d{1,6}", " H:mm:ss.SSSSSS"),
    (r"T\d{1,2}:\d{2}:\d{2}", "'T'H:mm:ss"),
    (r"T\d{1,2}:\d{2}:\d{2}\.\d{1,6}", "'T'H:mm:ss.SSSSSS"),
    (r"T\d{1,2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:\d{2})", "'T'H:mm:ssXXX"),
    (r"T\d{1,2}:\d{2}:\d{2}\.\d{1,6}(?:Z|[+-]\d{2}:\d{2})", "'T'H:mm:ss.SSSSSSXXX"),
    (r" \d{1,2}:\d{2}:\d{2}(?:Z|[+-]\d{2}:\d{2})", " H:mm:ssXXX"),
]
FIRST_TIME, LAST_TIME = "1677-09-21 00:12:43.145225", "2262-04-11 23:47:16.854775"

SHORTEST_DATE_TEXT, LONGEST_DATE_TEXT = 4, 40


def guess_format(value: str) -> str | None:
    """Spark pattern of one date text, month first unless that cannot be."""
    for date_shape, date_pattern in DATE_SHAPES:
        for time_shape, time_pattern in TIME_SHAPES:
            if re.fullmatch(date_shape + time_shape, value):
                if date_pattern.startswith("M") and value[:2].isdigit() and int(value[:2]) > 12:
                    date_pattern = date_pattern.replace("M", "?").replace("d", "M").replace("?", "d")
                return date_pattern + time_pattern
    return None


def looks_like_date(c: Column) -> Column:
    """Whether a text has one of the known shapes; long texts are not looked into."""
    dates = "|".join(shape for shape, _ in DATE_SHAPES)
    times = "|".join(shape for shape, _ in TIME_SHAPES)
    short = F.octet_length(F.trim(c)).between(SHORTEST_DATE_TEXT, LONGEST_DATE_TEXT)
    return short & F.trim(c).rlike(f"^(?:{dates})(?:{times})$")


def pattern_of(c: Column) -> Column:
    """The Spark pattern of a date text, as ``guess_format`` has it; null for other texts."""
    text, date, time = F.trim(c), None, None
    any_time = "(?:" + "|".join(shape for shape, _ in TIME_SHAPES) + ")"
    any_date = "(?:" + "|".join(shape for shape, _ in DATE_SHAPES) + ")"
    for shape, pattern in DATE_SHAPES:
        here, found = text.rlike(f"^{shape}{any_time}$"), F.lit(pattern)
        if pattern.startswith("M") and not pattern.startswith("MMM"):
            day_first = F.lit(pattern.replace("M", "?").replace("d", "M").replace("?", "d"))
            found = F.when(F.regexp_extract(text, r"^\d+", 0).cast("int") > 12, day_first).otherwise(found)
        date = F.when(here, found) if date is None else date.when(here, found)
    for shape, pattern in TIME_SHAPES:
        here = text.rlike(f"^{any_date}{shape}$")
        time = F.when(here, F.lit(pattern)) if time is None else time.when(here, F.lit(pattern))
    return F.when(looks_like_date(c), F.concat(date, time))


def pattern_order(pattern: str) -> tuple[int, int]:
    """The place of a pattern among the known ones."""
    for i, (_, date) in enumerate(DATE_SHAPES):
        swapped = date.replace("M", "?").replace("d", "M").replace("?", "d")
        for known in (date, swapped):
            for k, (_, time) in enumerate(TIME_SHAPES):
                if pattern == known + time:
                    return i, k
    return len(DATE_SHAPES), 0


def parse_date(c: Column, pattern: str) -> Column:
    """The text read with one pattern; anything else, or out of range, is missing."""
    time = F.try_to_timestamp(F.trim(c), F.lit(pattern)).cast("timestamp_ntz")
    first, last = (F.lit(t).cast("timestamp_ntz") for t in (FIRST_TIME, LAST_TIME))
    return F.when(time.between(first, last), time)
