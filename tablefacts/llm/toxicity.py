"""Toxicity by weak supervision.

1. Voters. A lexicon of word beginnings, short words and runs of letters inside words is
   mined from a bounded sample of labelled training documents (all that are far commoner in
   toxic ones than chance allows), beside a fixed seed list. Lexicon voters are groups of its entries; pattern voters look at how often, how
   densely and how variedly entries come, at entries that share a line, and at shouting.
   A voter says 1 (toxic), -1 (clean) or 0 (nothing).
2. Label model. The votes of all documents are counted by pattern (3 to the power of the
   voters bounds the table). A generative model of two classes with a mean vote per voter
   and class (accuracy) and a common covariance (correlation of voters) is fitted to the
   patterns by expectation maximisation; known training labels stay as they are. Voters
   that repeat each other share their weight through the covariance.
3. Classifier. A linear model on counts of the whole text is fitted to the posterior labels
   of a bounded sample of documents, and scores every document.

Labels are learned from training rows only; lang, source and id never enter a score. Null
and empty texts have no words and score like any text without entries. Rows without an id
are scored like the others. Without any labels the seed list alone votes.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, in_batches, materialize, row_parts, rows_of, scratch, with_row_key
from .linear import fit, held_out, linear, probability, sigmoid, training_labels
from .near_dedup import near_dedup

#: Fixed seed list of insults.
SEEDS = ["idiot", "moron", "loser", "scum", "stupid", "pathetic", "worthless", "disgusting", "trash", "clown"]
#: Lengths of word beginnings that may become entries. Shorter words may as a whole.
SHORTEST, LONGEST = 4, 9
#: Lengths of letter runs inside words that may, and in scripts without blanks.
GRAMS, DENSE_GRAMS = (4, 5, 6), (2, 3, 4)
DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
#: First character of entries that are whole words, and runs.
WHOLE, RUN = "=", "*"
#: Entries that a task counts before it passes them on.
MOST_COUNTED = 200_000
#: Groups of entries, each a lexicon voter.
GROUPS = 3
#: Documents whose posterior labels the classifier is fitted on, at most.
MOST_FITTED = 20_000
#: From this score on a document is rejected.
REJECT = 0.7
VOTERS = ["often", "dense", "varied", "together", "seeds", "shouting"] + [f"group{k}" for k in range(GROUPS)]
FEATURES = ["hits", "hits_twice", "distinct", "density", "together", "seeds", "words", "shouting"]

WORD = re.compile(r"[^\W\d_]+")


def runs_of(word: str) -> set[str]:
    """The runs of letters inside a word that may be entries."""
    if DENSE.search(word):
        return {word[k : k + n] for n in DENSE_GRAMS for k in range(len(word) - n + 1)}
    return {word[k : k + n] for n in GRAMS for k in range(1, len(word) - n + 1)}


def candidates(word: str) -> list[str]:
    """All entries that a word may bring."""
    found = [word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1)]
    return found + ([WHOLE + word] if len(word) < SHORTEST else []) + [RUN + r for r in runs_of(word)]


def _counted(allowed: set[str] | None):
    """Per task: in how many documents each entry is, and how often, up to three times in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("entry", pa.string()), ("docs", pa.int64()), ("uses", pa.int64())])

        def rows():
            counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for (text,) in rows_of(batches):
                found: Counter = Counter()
                for word, n in Counter(WORD.findall(text.decode("utf-8", "replace").lower())).items():
                    for entry in candidates(word):
                        if allowed is None or entry in allowed:
                            found[entry] += n
                for entry, n in found.items():
                    c = counts[entry]
                    c[0] += 1
                    c[1] += min(n, 3)
                if len(counts) > MOST_COUNTED:
                    yield from ((k, a, b) for k, (a, b) in counts.items())
                    counts.clear()
            yield from ((k, a, b) for k, (a, b) in counts.items())

        return in_batches(rows(), schema)

    return run


def entry_counts(texts: DataFrame, allowed: set[str] | None = None) -> DataFrame:
    """(entry, docs, uses) over ``texts`` (text)."""
    counts = texts.select("text").mapInArrow(_counted(allowed), "entry string, docs long, uses long")
    return counts.groupBy("entry").agg(F.sum("docs").alias("docs"), F.sum("uses").alias("uses"))


def families(toxic_of: dict[str, int]) -> list[str]:
    """Of all entries that mark toxic documents, one for each family."""
    kept: set[str] = set()
    for entry in sorted((e for e in toxic_of if e[0] != WHOLE), key=lambda e: (len(e), e)):
        if entry[0] == RUN:
            inner = entry[1:]
            if any(RUN + inner[a:b] in kept for a in range(len(inner)) for b in range(a + 2, len(inner) + 1)):
                continue
        elif any(entry[:k] in kept for k in range(SHORTEST, len(entry))):
            continue  # a longer entry says nothing new
        kept.add(entry)
    longer: dict[str, list[str]] = defaultdict(list)
    for entry in sorted(toxic_of):
        longer[entry[:-1]].append(entry)
    # Of a family, the longest beginning that is in as many toxic documents.
    longest = {e for e in toxic_of if e[0] == WHOLE}
    for entry in kept:
        while entry[0] != RUN and (same := [e for e in longer[entry] if toxic_of[e] >= 0.95 * toxic_of[entry]]):
            entry = same[0]
        longest.add(entry)
    return sorted(longest)


#: Similarity of the sets of shingles from which on training documents are copies, in hundredths.
COPIES = 80


def different_documents(docs: DataFrame, training: DataFrame) -> DataFrame:
    """(text, label) of the training documents, of a group of copies the first of each label.

    Copies of one toxic document would make all of its rare words look like insults. A page
    with insults in it is no copy of the clean one."""
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(training), "doc_id")
    sample = materialize(sample.select("doc_id", "text", "label"))
    keyed = with_row_key(sample).select(*row_parts(), "doc_id", "text", "label")
    groups = near_dedup(sample, COPIES).select("rf", "ri", "component_id")
    first = F.min(F.struct("doc_id", "rf", "ri")).alias("first")
    first = keyed.select("rf", "ri", "doc_id", "label").join(groups, ["rf", "ri"]).groupBy("component_id", "label").agg(first)
    kept = first.select(F.col("first.rf").alias("rf"), F.col("first.ri").alias("ri"))
    return keyed.join(kept, ["rf", "ri"]).select(as_bytes("text").alias("text"), "label")


def mine_lexicon(docs: DataFrame, training: DataFrame) -> list[str]:
    """Beginnings, short words and inner runs that mark toxic documents, one for each family.

    An entry must be in so many toxic documents, and so much more often used than once in
    each, that less than one entry of its kind would be there by chance; of a family of
    beginnings the shortest such one counts, at its full common length."""
    with scratch(docs.sparkSession):
        sample = materialize(different_documents(docs, training), outlive=True)
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return []
    counts = materialize(entry_counts(sample.where("label = 1")).where("docs > 1"))
    kind = F.when(F.col("entry").startswith(WHOLE), WHOLE).when(F.col("entry").startswith(RUN), RUN).otherwise("")
    kinds = {r["kind"]: max(2, r["count"]) for r in counts.groupBy(kind.alias("kind")).count().collect()}
    base = toxic / (toxic + clean)
    # Each further use counts half a document.
    evidence = (F.col("docs") + (F.col("uses") - F.col("docs")) / 2) * float(-np.log(base))
    needed = F.lit(0.0)
    for k, many in kinds.items():
        needed = F.when(kind == k, F.lit(float(np.log(many)))).otherwise(needed)
    # The bounded sample bounds what comes here.
    toxic_of = {r["entry"]: r["docs"] for r in counts.where(evidence > needed).select("entry", "docs").collect()}
    clean_of = {r["entry"]: r["docs"] for r in entry_counts(sample.where("label = 0"), set(toxic_of)).collect()}
    return families({e: d for e, d in toxic_of.items() if d / toxic > 25 * clean_of.get(e, 0) / clean})


class Lexicon:
    """Looks words up by their beginnings, whole if they are short, then by runs inside;
    remembers words while there are not too many."""

    def __init__(self, entries: list[str]):
        self.entries = {e: k for k, e in enumerate(entries)}
        self.sizes = sorted({len(e) for e in entries if e[0] not in (WHOLE, RUN)})
        self.runs = any(e[0] == RUN for e in entries)
        self.seen: dict[str, int] = {}

    def find(self, word: str) -> int:
        k = self.seen.get(word)
        if k is None:
            k = next((self.entries[word[:s]] for s in self.sizes if word[:s] in self.entries), -1)
            if k < 0 and len(word) < SHORTEST:
                k = self.entries.get(WHOLE + word, -1)
            if k < 0 and self.runs:
                k = min((self.entries[RUN + r] for r in runs_of(word) if RUN + r in self.entries), default=-1)
            if len(self.seen) > 300_000:
                self.seen.clear()
            self.seen[word] = k
        return k


def measure(text: str, lexicon: Lexicon, seeds: Lexicon) -> list[float]:
    """What voters and classifier look at: counts over the whole text, then group hits."""
    words, hits, together, groups = 0, [], 0, [0] * GROUPS
    seeded = 0
    for line in text.lower().splitlines():
        here = 0
        found = WORD.findall(line)
        words += len(found)
        for word in found:
            k = lexicon.find(word)
            if k >= 0:
                hits.append(k)
                here += 1
                groups[k % GROUPS] += 1
            seeded += seeds.find(word) >= 0
        together = max(together, here)
    upper = sum(1 for c in text if c.isupper())
    shouting = upper / max(1, len(text))
    return [float(len(hits)), float(len(set(hits))), float(together), float(seeded), float(words), shouting, *map(float, groups)]


def measured(docs: DataFrame, entries: list[str]) -> Column:
    """A column of measures of the text of ``docs``."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon, seeds = Lexicon(entries), Lexicon(SEEDS)
        for texts in parts:
            yield pd.Series([measure(t or "", lexicon, seeds) for t in texts])

    return run(F.col("text"))


def votes(m: Column) -> Column:
    """The votes as an array of -1, 0, 1."""
    hits, distinct, together, seeded, words, shouting = (m[k] for k in range(6))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    found = [
        vote(hits >= 2, hits == 0),
        vote((hits >= 2) & (hits * 400 >= words), hits == 0),
        vote(distinct >= 2, distinct == 0),
        vote(together >= 2, F.lit(False)),
        vote(seeded >= 2, F.lit(False)),
        vote(shouting > 0.5, F.lit(False)),
        *[vote(m[6 + k] >= 1, F.lit(False)) for k in range(GROUPS)],
    ]
    return F.array(*[v.cast("int") for v in found])


def label_model(patterns: np.ndarray, counts: np.ndarray, labels: np.ndarray, prior: float, steps: int = 50):
    """(weights, intercept) of the log odds of class 1 given votes.

    ``labels`` is 1, 0 or -1 (unknown) per row of patterns. Starts from the first voter and
    keeps the known labels fixed."""
    p = np.where(labels >= 0, labels, np.where(patterns[:, 0] > 0, 0.9, np.where(patterns[:, 0] < 0, 0.02, prior)))
    v, n = patterns.astype(float), counts.astype(float)
    for _ in range(steps):
        n1, n0 = (n * p).sum() + 1, (n * (1 - p)).sum() + 1
        m1, m0 = (v * (n * p)[:, None]).sum(0) / n1, (v * (n * (1 - p))[:, None]).sum(0) / n0
        r1, r0 = v - m1, v - m0
        cov = (r1 * (n * p)[:, None]).T @ r1 + (r0 * (n * (1 - p))[:, None]).T @ r0
        cov = cov / (n1 + n0) + 0.05 * np.eye(v.shape[1])
        w = np.linalg.solve(cov, m1 - m0)
        b = -0.5 * (m1 + m0) @ w + np.log(n1 / n0)
        new = np.where(labels >= 0, labels, sigmoid(v @ w + b))
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return w, b


def features_of(m: Column) -> Column:
    hits, distinct, together, seeded, words, shouting = (m[k] for k in range(6))
    density = hits / F.greatest(words, F.lit(20.0))
    return F.array(
        F.log1p(hits), (hits >= 2).cast("double"), F.least(distinct, F.lit(4.0)), F.least(density * 100, F.lit(10.0)),
        F.least(together, F.lit(4.0)), F.log1p(seeded), F.log1p(words), shouting,
    )


def train(docs: DataFrame, labels: DataFrame, whole: bool = False) -> tuple[np.ndarray, DataFrame]:
    """(classifier weights, measures): the latter has doc_id and measures of every row and, if
    ``whole``, all columns of ``docs`` as ``d_`` and their name, so that nothing need be joined
    or measured again."""
    bounded_batches(docs.sparkSession)
    known = materialize(training_labels(labels, "toxic"))
    entries = mine_lexicon(docs, known) or list(SEEDS)
    own = [F.col(f"`{c}`").alias(f"d_{c}") for c in docs.columns] if whole else []
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), measured(docs, entries).alias("m"), *own))
    # The sample of labels is bounded, so that it may go to every task.
    voted = rows.join(F.broadcast(known), "doc_id", "left").select("doc_id", "m", votes(F.col("m")).alias("v"), F.coalesce("label", F.lit(-1)).alias("label"))
    table = voted.groupBy("v", "label").agg(F.count(F.lit(1)).alias("n")).orderBy("v", "label").collect()
    if not table:
        return np.zeros(len(FEATURES) + 1), rows
    patterns = np.array([r["v"] for r in table])
    given, n = np.array([r["label"] for r in table]), np.array([r["n"] for r in table])
    prior = float((n[given == 1].sum() + 1) / (n[given >= 0].sum() + 10))
    w, b = label_model(patterns, n, given, prior)

    total = int(n.sum())
    share = F.pmod(F.xxhash64("doc_id", "m", F.lit(5)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, MOST_FITTED / max(1, total)))
    grouped = lambda rows: rows.groupBy(features_of(F.col("m")).alias("x"), "v").agg(F.count(F.lit(1)).alias("n"))
    order = [F.xxhash64("x", "v", F.lit(7)), "x", "v"]
    sample = grouped(voted.where(share)).orderBy(*order).limit(2 * MOST_FITTED).collect()
    if not sample:
        sample = grouped(voted).orderBy(*order).limit(MOST_FITTED).collect()
    sample.sort(key=lambda r: (r["x"], r["v"]))
    x, v = np.array([r["x"] for r in sample]), np.array([r["v"] for r in sample], dtype=float)
    weights = fit(x, sigmoid(v @ w + b), np.array([r["n"] for r in sample], dtype=float))
    return weights, rows


def score_of(m: Column, weights: np.ndarray) -> Column:
    return probability(linear(features_of(m), weights))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text)."""
    weights, rows = train(docs, labels)
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_of(F.col("m"), weights).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= REJECT).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    weights, rows = train(docs, labels, whole=True)
    return rows.where(score_of(F.col("m"), weights) < REJECT).select(*[F.col(f"`d_{c}`").alias(c) for c in docs.columns])
