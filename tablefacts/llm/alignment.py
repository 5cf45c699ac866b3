"""Which tokens of two tokenizers cover the same bytes.

Each text is encoded twice, with a byte-level BPE (A) and a piece BPE with byte fallback (B,
which puts a space before the text; A gets that space with the text). The ends of the
tokens in bytes are two rising lists. Where both lists hold an end, the text is cut into
groups, the smallest runs of A and of B tokens over the same bytes.

The ends are compared along a diagonal: with a shift between the indexes of A and B, slices
of doubling length are equal while tokens stand one to one, and such a stretch is jumped
over as a whole. Where slices differ, halving finds the place; the irregular group there is
resolved token by token, and its counts give the next shift.

A link is a pair of an A and a B token that end together. Links are counted over all
documents by the pair of their ids; a document's links are then valued by these counts.

Null and empty texts, and texts whose tokens don't give their bytes back, have no tokens:
zeros and an empty list of groups. Repeated rows count as rows of their own, null ids stay
null; an empty table gives an empty result. Columns of ``docs`` other than doc_id and text
don't matter, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ROW, bounded_batches, materialize, rows_of, with_row_key

FOLDER = "/opt/tokenizers"
#: The public pattern by which byte-level BPE cuts a text before merging, a fixed value.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ends that are compared one by one before slices are.
NEAR = 8
#: Characters of the texts that are aligned at once, besides one text.
BATCH_CHARS = 200_000
#: Pairs of ids whose counts are sent to every task (16 bytes each); more are joined by a shuffle.
MOST_PAIRS = 2_000_000

ALIGNED = pa.schema(
    [
        ("doc_id", pa.int64()), ("rf", pa.int64()), ("ri", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
        ("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())),
    ]
)


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for
    themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoders:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        import tiktoken

        letters, model = byte_letters(), json.loads(a_file)
        special = {t["content"] for t in model["added_tokens"] if t["special"]}
        # ids follow the order of the merges, so they are the ranks
        ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.a = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.a_file = a_file
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in names]) for names in (self.a_bytes, self.b_bytes))

    @cache  # noqa: B019
    def plain_a(self):
        """A slower encoder by the same file, for texts that the other can't take."""
        from tokenizers import Tokenizer

        slow = Tokenizer.from_str(self.a_file.decode())
        slow.encode_special_tokens = True
        return slow

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of a text with a space before it; None if they don't give its bytes back."""
        raw = f" {text}".encode()
        b = self.b.encode(text)
        try:
            a = self.a.encode_to_numpy(f" {text}", disallowed_special=())
        except ValueError:  # white space too long for its pattern's stack
            a = np.array(self.plain_a().encode(f" {text}", add_special_tokens=False).ids)
        # tokens of A are slices of the bytes, so they are whole if they are as long
        if self.sizes_a[a].sum() != len(raw) or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        return a, np.array(b, np.int32)


def irregular_groups(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """The groups between two rising lists of ends (with the same last end) that are not one
    to one: from and to which index of ``a``, and of ``b``."""
    i, j, last = 0, 0, len(a)
    found = []
    while i < last:
        x, y, near = a[i], b[j], i + NEAR
        while x == y and i < near:  # short stretches end by end
            i += 1
            j += 1
            if i == last:
                return found
            x, y = a[i], b[j]
        if x == y:  # long ones by slices of doubling, then of halving length
            step = NEAR
            while (to := i + step) <= last and a[i:to] == b[j : j + step]:
                i = to
                j += step
                step += step
            while step > 1:
                step >>= 1
                if (to := i + step) <= last and a[i:to] == b[j : j + step]:
                    i = to
                    j += step
            if i == last:
                return found
            x, y = a[i], b[j]
        p, q = i, j
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i += 1
        j += 1
        found.append((p, i, q, j))
    return found


def common_cuts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group of two lists of ends the index of its last token in either list."""
    found = np.array(irregular_groups(a.tolist(), b.tolist()), np.int64).reshape(-1, 4)
    cuts = []
    for ends, begin, after in ((a, found[:, 0], found[:, 1]), (b, found[:, 2], found[:, 3])):
        steps = np.zeros(len(ends) + 1, np.int64)  # inside a group, but at its last token, nothing is cut
        np.add.at(steps, begin, 1)
        np.add.at(steps, after - 1, -1)
        cuts.append(np.flatnonzero(np.cumsum(steps[:-1]) == 0))
    return cuts[0], cuts[1]


class GroupWriter:
    """Groups of ids as text: ``a1,a2|b1;`` and so on."""

    def __init__(self, n: int):
        self.sizes = np.array([len(str(k)) for k in range(n)])
        # the digits of an id in the low bytes of a number, with room for a separator
        self.digits = np.array([int.from_bytes(str(k).encode(), "little") for k in range(n)], np.uint64)

    def write(self, a: np.ndarray, b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The text of all groups, each with its ``;``, and where in it each group ends."""
        ids, marks = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint64)
        before = np.concatenate(([0], cuts_b[:-1] + 1))  # tokens of b in earlier groups
        at_a = np.arange(len(a)) + np.repeat(before, np.diff(cuts_a, prepend=-1))
        at_b = np.arange(len(b)) + np.repeat(cuts_a + 1, np.diff(cuts_b, prepend=-1))
        ids[at_a], ids[at_b] = a, b
        marks[at_a[cuts_a]], marks[at_b[cuts_b]] = ord("|"), ord(";")
        sizes = self.sizes[ids]
        letters = (self.digits[ids] | marks << (8 * sizes).astype(np.uint64)).astype("<u8").view(np.uint8)
        return letters[letters != 0].tobytes(), np.cumsum(sizes + 1)[at_b[cuts_b]]


def _aligner(a_file, b_file) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def aligned(rows, encoders, writer):
        """One batch. The texts of all its rows are aligned as one, as every text's end is common."""
        got = [encoders.encode(text) if text else None for *_, text in rows]
        n_a, n_b = (np.array([len(x[k]) if x else 0 for x in got]) for k in (0, 1))
        a, b = (np.concatenate([np.zeros(0, np.int32), *(x[k] for x in got if x)]).astype(np.int64) for k in (0, 1))
        text, said, starts, pairs = b"", np.zeros(0, np.int64), np.zeros(len(rows) + 1, np.int64), np.zeros(0, np.int64)
        if len(a):
            cuts_a, cuts_b = common_cuts(encoders.sizes_a[a].cumsum(), encoders.sizes_b[b].cumsum())
            text, said = writer.write(a, b, cuts_a, cuts_b)
            pairs = a[cuts_a] << 32 | b[cuts_b]
            starts[1:] = np.searchsorted(cuts_a, n_a.cumsum())
        groups = [text[said[p - 1] if p else 0 : said[q - 1] - 1].decode() if q > p else "" for p, q in zip(starts, starts[1:])]
        counted = [np.unique(pairs[p:q], return_counts=True) for p, q in zip(starts, starts[1:])]
        offsets = pa.array(np.cumsum([0, *(len(x) for x, _ in counted)]), pa.int32())
        doc_id, rf, ri, _ = zip(*rows)
        columns = [doc_id, rf, ri, n_a, n_b, np.diff(starts), groups]
        arrays = [pa.array(c, f.type) for c, f in zip(columns, ALIGNED)]
        for k, kind in ((0, np.int64), (1, np.int32)):
            values = np.concatenate([x[k] for x in counted]).astype(kind)
            arrays.append(pa.ListArray.from_arrays(offsets, pa.array(values)).cast(ALIGNED.field(7 + k).type))
        return pa.RecordBatch.from_arrays(arrays, schema=ALIGNED)

    def run(batches):
        encoders = Encoders(a_file.value, b_file.value)
        writer = GroupWriter(max(len(encoders.a_bytes), len(encoders.b_bytes)))
        held, size = [], 0
        for row in rows_of(batches):
            held.append(row)
            size += len(row[-1] or "")
            if size >= BATCH_CHARS:
                yield aligned(held, encoders, writer)
                held, size = [], 0
        if held:
            yield aligned(held, encoders, writer)

    return run


def align_tokens(docs: DataFrame, a_path: str = f"{FOLDER}/byte_bpe_50k.json", b_path: str = f"{FOLDER}/piece_bpe_32k.model") -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_a, n_b, n_groups, ``groups`` (the ids of
    each group as ``a1,a2|b1``, joined by ``;``), and the pairs of ids (A's in the upper half
    of a long) that its links have, with how often. rf and ri tell equal rows apart.

    The files are read by the driver and sent along; they have a few megabytes."""
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    files = [spark.sparkContext.broadcast(open(p, "rb").read()) for p in (a_path, b_path)]  # noqa: SIM115
    rows = with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = rows.select("doc_id", F.col(f"{ROW}.f").alias("rf"), F.col(f"{ROW}.i").alias("ri"), "text")
    schema = "doc_id long, rf long, ri long, n_a long, n_b long, n_groups long, groups string, pairs array<long>, times array<int>"
    return rows.mapInArrow(_aligner(*files), schema)


def links_of(aligned: DataFrame) -> DataFrame:
    """A row for each pair of ids that a document's links have: rf, ri, pair, times."""
    zipped = F.explode(F.arrays_zip("pairs", "times"))
    return aligned.select("rf", "ri", zipped.alias("x")).select("rf", "ri", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """How many links of all documents have a pair of ids, and whether no other A id has
    more links with its B id: pair, links, best."""
    counts = links_of(aligned).groupBy("pair").agg(F.sum("times").alias("links"))
    counts = materialize(counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))))
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    return counts.join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def value_links(aligned: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``aligned`` (a written table: it is read twice) without pairs and times, with n_links,
    n_best (links whose pair is the commonest of its B id) and count_sum (the corpus-wide
    counts of its links, added up). Counts of up to ``most_pairs`` pairs are broadcast."""
    counts = materialize(pair_counts(aligned))
    if counts.count() <= most_pairs:
        counts = F.broadcast(counts)
    found = links_of(aligned).join(counts, "pair").groupBy("rf", "ri")
    valued = found.agg(
        F.sum("times").alias("n_links"),
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("links")).alias("count_sum"),
    )
    zero = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("n_links", "n_best", "count_sum")]
    rest = [c for c in aligned.columns if c not in ("pairs", "times")]
    return aligned.select(*rest).join(valued, ["rf", "ri"], "left").select(*rest, *zero)


def alignment_digests(docs: DataFrame, **paths: str) -> DataFrame:
    """Counts of tokens, groups and links of every document, and a digest of its groups."""
    aligned = align_tokens(docs, **paths)
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    kept = materialize(aligned.select("doc_id", "rf", "ri", "n_a", "n_b", "n_groups", "pairs", "times", digest))
    return value_links(kept).drop("rf", "ri")
