"""Benchmark decontamination by templates.

Texts become sequences of words in which numbers, units (words after a number from a fixed
list) and names (capitalised words inside a sentence) are typed placeholders. Windows of
five such words are joined by hash. As names depend on letter case, a second set of windows
has them as words without case, and either set is enough. A document is contaminated by an item if it has at
least 0.8 of the item's windows, and if 0.8 of them have the item's own values (a copy with
a few edits) or the slots agree: along the alignment with most matches, or any with 0.8 of
the windows, all slots but a fifth (or one) follow a map from values of the item to values
of the document. Different names of the item are different names in the document; different
numbers may become equal. So a question with other numbers or names in it is found, and a
text that only has the same frame and breaks the map in more slots is not.

Documents send only windows that pass a bitmap of the benchmark's hashes. The bitmap has a
fixed size; with a benchmark too large for it more windows pass, and the join is the same.
A document with 0.8 of an item's windows has at least one of any fifth of them (and one
more), so documents and items first meet by each item's rarest windows, counted over all
documents; a beginning that many items share brings no pairs. Of pairs that meet, all
windows of the item are compared.

Null and empty texts have no windows; texts and items of fewer than five words are one
window. Items of three or four words are also looked for inside longer texts, by their own
words without letter case; shorter ones only match whole texts. Windows of placeholders alone are left out of the first set; in the second, those of
numbers and units alone have their values in place of placeholders. Ids may be null; equal items count
once. Rows that repeat are judged each on its own. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import (
    WordHashes,
    as_bytes,
    bitmap_of,
    bounded_batches,
    in_batches,
    in_bitmap,
    materialize,
    row_parts,
    rows_of,
    signed,
    window_hashes,
    with_row_key,
)

WINDOW, SHARE = 5, 0.8
#: Items of so many words are looked for inside longer texts, by their own words.
SHORT = (3, 4)
#: Slots that may break the map from item to document: this share, or one.
BROKEN = 0.2
NUMBER, UNIT, NAME = b"\x01number", b"\x01unit", b"\x01name"
TYPES = [None, NUMBER, UNIT, NAME]
MARKS = np.array([0] + [xxhash.xxh3_64_intdigest(m) for m in TYPES[1:]], dtype=np.uint64)
#: What tells apart the hashes of windows without letter case, and of those by their values.
FOLDED, LITERAL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Fixed list of units.
UNITS = set(
    "mm cm m km in ft yd mi mg g kg lb lbs oz t ml l s sec secs second seconds min mins minute minutes h hr hrs hour "
    "hours day days week weeks month months year years mph kmh w kw kwh v a hz khz mhz ghz kb mb gb tb percent pct "
    "dollar dollars euro euros cent cents meter meters metre metres kilometer kilometers kilometre kilometres mile "
    "miles gram grams kilogram kilograms liter liters litre litres degree degrees".split()
)
#: Words, numbers, and what ends a sentence.
TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,:/]\d+)*|[.!?:\n\r|\"“”]+")
SENTENCE_END = set(".!?:\n\r|\"“”")


def folded(token: str) -> str:
    low = token.lower()
    return low if low.isascii() else token.casefold()


class TokenHashes(WordHashes):
    """Hashes of tokens without letter case; the last three bits say what a token may be by
    itself: 1 number, 2 unit, 4 name, all of them the end of a sentence."""

    def __missing__(self, token: str) -> int:
        if len(self) >= self.MOST:
            self.clear()
        if token[0] in SENTENCE_END:
            h = self[token] = 7
            return h
        low, name = folded(token), token[0].isupper() and not token.isupper()
        flags = (1 if token[0].isdecimal() else 0) | (2 if low in UNITS else 0) | (4 if name else 0)
        h = self[token] = self.of(low.encode()) >> 3 << 3 | flags
        return h


def typed(texts: list[str], hashes: TokenHashes) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of texts one after the other, their hashes, their types (places in TYPES)
    and where each text begins in them, with the end of the last."""
    each = [TOKEN.findall(text) for text in texts]
    parts = list(chain.from_iterable(each))
    own = hashes.all(parts)
    flags = (own & np.uint64(7)).astype(np.int8)
    is_token = flags < 7
    at = np.flatnonzero(is_token)
    bounds = np.searchsorted(at, np.cumsum([0, *map(len, each)]))
    # The first word of a sentence is no name.
    within = np.ones(len(at), dtype=bool)
    within[1:] = at[1:] == at[:-1] + 1
    begins = np.zeros(len(at), dtype=bool)
    begins[bounds[:-1][bounds[:-1] < len(at)]] = True
    flags, own = flags[at], own[at]
    types = flags & 1
    types[1:][(flags[1:] & 2 > 0) & (types[:-1] == 1) & ~begins[1:]] = 2
    types[(flags & 4 > 0) & (types == 0) & within & ~begins] = 3
    tokens = parts if len(at) == len(parts) else [parts[k] for k in at.tolist()]
    return tokens, own ^ flags.astype(np.uint64), types, bounds


def values_of(tokens: list[str], types: list[int], but: int = 0) -> list[str]:
    """The value of each number, unit and name; '' for words and for type ``but``."""
    return [folded(t) if k and k != but else "" for t, k in zip(tokens, types)]


def template(text: str) -> tuple[list[bytes], list[str]]:
    """The words of a text with typed placeholders, and the value of each ('' for words)."""
    tokens, _, types, _ = typed([text], TokenHashes())
    return [TYPES[k] or folded(t).encode() for t, k in zip(tokens, types)], values_of(tokens, types.tolist())


def inside(bounds: np.ndarray, size: int) -> np.ndarray:
    """Where runs of ``size`` tokens begin that lie within one text."""
    if bounds[-1] < size:
        return np.empty(0, dtype=np.int64)
    fits = np.ones(bounds[-1] - size + 1, dtype=bool)
    for back in range(1, size):
        cut = bounds[1:-1] - back
        fits[cut[(cut >= 0) & (cut < len(fits))]] = False
    return np.flatnonzero(fits)


def windows_of(own: np.ndarray, types: np.ndarray, bounds: np.ndarray, size: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """For both sets of windows, their hashes and their first words.

    Set 0 has placeholders for numbers, units and names. Set 1 doesn't depend on letter
    case: names are words in it, and windows without a word have their values."""
    at = inside(bounds, size)
    if not len(at):
        return [(own[:0], at), (own[:0], at)]
    plain = np.where((types == 1) | (types == 2), MARKS[types], own)
    words = window_hashes(plain, size)[at]
    found, other = words, words ^ FOLDED
    if (types == 3).any():
        found = window_hashes(np.where(types == 3, MARKS[3], plain), size)[at]

    def with_words(is_word: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(is_word)])
        return sums[at + size] - sums[at] > 0

    typed_only = ~with_words(types == 0)
    bare = ~with_words((types == 0) | (types == 3))
    if bare.any():
        other[bare] = window_hashes(own, size)[at][bare] ^ LITERAL
    return [(found[~typed_only], at[~typed_only]), (other, at)]


def all_windows(own: np.ndarray, types: np.ndarray, bounds: np.ndarray, sizes: list[int] | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(way, hashes, first words) of all sets of windows; texts of fewer than five words
    are one window."""
    yield from ((way, *w) for way, w in enumerate(windows_of(own, types, bounds)))
    lengths = np.diff(bounds)
    for k in np.flatnonzero((lengths > 0) & (lengths < WINDOW)).tolist():
        n, part = int(lengths[k]), slice(bounds[k], bounds[k + 1])
        for way, (hashes, at) in enumerate(windows_of(own[part], types[part], np.array([0, n]), n)):
            yield way, hashes, at + bounds[k]
        if sizes is None and n in SHORT:
            yield n - 1, window_hashes(own[part], n) ^ LITERAL, bounds[k : k + 1]
    for size in sizes or []:
        at = inside(bounds, size)
        if len(at):
            yield size - 1, window_hashes(own, size)[at] ^ LITERAL, at


#: Texts are looked at together up to so many characters, as most are short.
TOGETHER = 1 << 15


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, str]]]:
    """Rows in groups of about ``TOGETHER`` characters; longer texts by themselves."""
    held, size = [], 0
    for f, i, data in rows_of(batches):
        held.append((f, i, data.decode("utf-8", "replace")))
        size += len(data)
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


WINDOWS = pa.schema([("f", pa.int64()), ("i", pa.int64()), ("way", pa.int64()), ("place", pa.int64()), ("hash", pa.int64()), ("slots", pa.list_(pa.string()))])
WINDOWS_SQL = "f long, i long, way long, place long, hash long, slots array<string>"


def _windows(bitmap: bytes | None, sizes: list[int] | None = None):
    """The windows of texts; given a bitmap, only those that pass it.

    Short windows are a set for each of ``sizes``, numbered by one less than their size; for
    items, ``sizes`` is None, and those of three or four words have the one of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()

        def rows():
            for group in together(batches):
                tokens, own, types, bounds = typed([t for _, _, t in group], hashes)
                for way, found, at in all_windows(own, types, bounds, sizes):
                    if bitmap is not None and len(found):
                        passed = in_bitmap(bitmap, found)
                        found, at = found[passed], at[passed]
                    texts = np.searchsorted(bounds, at, side="right") - 1
                    for h, p, k in zip(signed(found).tolist(), at.tolist(), texts.tolist()):
                        # Short windows are equal in all values.
                        end = min(p + WINDOW, bounds[k + 1]) if way < 2 else p
                        yield *group[k][:2], way, p - int(bounds[k]), h, values_of(tokens[p:end], types[p:end].tolist(), 3 if way else 0)

        return in_batches(rows(), WINDOWS)

    return run


def broken_slots(slots: list[tuple[str, str]]) -> int:
    """How many (value of the item, value of the document) break the best map between them."""
    goes = {}
    for (own, value), n in Counter(slots).most_common():
        goes.setdefault(own, (value, n))
    kept = sum(n for _, n in goes.values())
    taken: set[str] = set()
    # The map's direction is from the item on, but two names don't become one.
    for own, (value, n) in sorted(goes.items(), key=lambda x: (-x[1][1], x[0] != x[1][0], x[0])):
        if own[0].isdigit() or own in UNITS:
            continue
        if value in taken:
            kept -= n
        taken.add(value)
    return len(slots) - kept


LINES = pa.schema([("rf", pa.int64()), ("ri", pa.int64()), ("item", pa.int64()), ("way", pa.int64()), ("line", pa.int64()), ("n", pa.int64()), ("agree", pa.bool_())])
LINES_SQL = "rf long, ri long, item long, way long, line long, n long, agree boolean"


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether the slots along lines agree."""

    def rows():
        for rf, ri, item, way, line, n, slots in rows_of(batches):
            broken = broken_slots([(z["own"], z["value"]) for z in slots])
            yield rf, ri, item, way, line, n, broken <= max(1, BROKEN * len(slots))

    return in_batches(rows(), LINES)


def at_least(share: float, name: str) -> Column:
    """Whether ``name`` is at least that share of the item's windows."""
    return F.col(name) >= F.lit(float(share)) * F.col("windows") - F.lit(1e-9)


def shared_windows(found: DataFrame, item_windows: DataFrame, sizes: DataFrame, share: float) -> DataFrame:
    """All windows that an item shares with a document that has one of its rarest.

    Of ``windows`` windows, less than ``least`` of them missing, any ``windows - least + 1``
    hold one that is there. The order within an item goes by counts over all documents; the
    window function has one item's rows, which its own length bounds."""
    counts = found.groupBy("way", "hash").agg(F.count(F.lit(1)).alias("seen"))
    order = Window.partitionBy("item", "way").orderBy(F.coalesce("seen", F.lit(0)), "hash", "at")
    ranked = item_windows.select("item", "way", "hash", "at").join(counts, ["way", "hash"], "left").withColumn("rank", F.row_number().over(order))
    least = F.ceil(F.lit(float(share)) * F.col("windows") - F.lit(1e-9))
    rare = ranked.join(sizes, ["item", "way"]).where((F.col("rank") <= F.col("windows") - least + 1) & (F.col("seen") > 0))
    met = found.select("rf", "ri", "way", "hash").join(rare.select("way", "hash", "item"), ["way", "hash"]).select("rf", "ri", "item", "way").distinct()
    return met.join(item_windows, ["item", "way"]).join(found, ["rf", "ri", "way", "hash"])


def matches(keyed: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(rf, ri, item_id, hits, windows, agree) for every document (with a row key), item and
    set of windows of which it has at least ``share`` of the item's."""
    text = as_bytes("text").alias("data")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    items = materialize(items.select("*", F.monotonically_increasing_id().alias("item")))
    item_windows = items.select("item", F.lit(0).cast("long").alias("z"), text).mapInArrow(_windows(None), WINDOWS_SQL)
    item_windows = materialize(item_windows.select(F.col("f").alias("item"), "way", F.col("place").alias("at"), "hash", F.col("slots").alias("own")))
    sizes = item_windows.groupBy("item", "way").agg(F.count(F.lit(1)).alias("windows"))
    bitmap = bitmap_of(item_windows.select("hash"))
    short = sorted(r["way"] + 1 for r in item_windows.where("way >= 2").select("way").distinct().collect())
    found = keyed.select(*row_parts(), text).mapInArrow(_windows(bitmap, short), WINDOWS_SQL)
    found = materialize(found.select(F.col("f").alias("rf"), F.col("i").alias("ri"), "way", "place", "hash", "slots"))
    pairs = materialize(shared_windows(found, item_windows, sizes, share))
    most = partial(at_least, share)
    literal = F.count_distinct(F.when(F.col("own") == F.col("slots"), F.col("at"))).alias("literal")
    enough = pairs.groupBy("rf", "ri", "item", "way").agg(F.count_distinct("at").alias("hits"), literal).join(sizes, ["item", "way"]).where(most("hits"))
    aligned = pairs.join(enough.where(~most("literal")).select("rf", "ri", "item", "way"), ["rf", "ri", "item", "way"], "left_semi")
    slots = F.transform(F.arrays_zip("own", "slots"), lambda z, k: F.struct((F.col("at") + k).alias("at"), z["own"].alias("own"), z["slots"].alias("value")))
    slots = F.filter(slots, lambda z: (z["own"] != "") & (z["value"] != ""))
    lines = aligned.select("rf", "ri", "item", "way", (F.col("place") - F.col("at")).alias("line"), "at", slots.alias("slots"))
    # An item's own length bounds what meets here.
    lines = lines.groupBy("rf", "ri", "item", "way", "line").agg(F.count_distinct("at").alias("n"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("s"))
    lines = lines.mapInArrow(_agreeing, LINES_SQL).join(sizes, ["item", "way"])
    best = lines.groupBy("rf", "ri", "item", "way").agg(F.max(F.struct("n", "agree")).alias("best"), F.max(F.col("agree") & most("n")).alias("whole"))
    names = items.select("item", "item_id")
    agree = most("literal") | F.coalesce(F.col("best.agree") | F.col("whole"), F.lit(False))
    return enough.join(best, ["rf", "ri", "item", "way"], "left").join(names, "item").select("rf", "ri", "item_id", "hits", "windows", agree.alias("agree"))


def contaminated_rows(keyed: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(rf, ri, items, similarity) of the contaminated rows."""
    hits = matches(keyed, benchmark, share).where("agree")
    return hits.groupBy("rf", "ri").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"), F.max(F.col("hits") / F.col("windows")).alias("similarity")
    )


def find_contamination(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, contaminated, items, similarity for every row of ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    keyed = with_row_key(docs.select("doc_id", "text"))
    found = contaminated_rows(keyed, benchmark, share)
    rows = keyed.select(*row_parts(), F.col("doc_id").cast("long").alias("doc_id")).join(found, ["rf", "ri"], "left")
    return rows.select(
        "doc_id", F.col("similarity").isNotNull().alias("contaminated"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` without the contaminated ones; columns may have any names."""
    bounded_batches(docs.sparkSession)
    own = [F.col(f"`{c}`").alias(f"d_{c}") for c in docs.columns]
    keyed = with_row_key(docs.select(*own, "text"))
    found = contaminated_rows(keyed, benchmark, share).select("rf", "ri")
    kept = keyed.select(*[f"`d_{c}`" for c in docs.columns], *row_parts()).join(found, ["rf", "ri"], "left_anti")
    return kept.select(*[F.col(f"`d_{c}`").alias(c) for c in docs.columns])
