"""Quality by hierarchical empirical Bayes.

A linear classifier on measures of the whole text, fitted on a bounded sample of labelled
training rows, gives each document its own evidence. Sums of it by host and by path within
host, over all documents, give posteriors: a path is shrunk toward its host and a host
toward the global mean, each by as many pseudo documents as the spread between the groups
warrants (method of moments), so that a site with few documents says little. A document's
own evidence is left out of its site's. How much the site counts beside the document is
fitted on the training rows.

Null hosts and paths are groups of their own. Null and empty texts have measures of zero.
Rows without an id are scored and never trained on. Without labels every score is one half.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize
from .linear import fit, held_out, linear, probability, training_labels

#: From this score on a document is of good quality.
KEEP = 0.5
TOKEN, LETTERS = re.compile(r"\S+"), re.compile(r"[^\W\d_]+")
MEASURES = [
    "words", "word_length", "symbol_words", "bar_words", "shout_words", "upper", "digits", "symbols",
    "distinct", "most_common", "repeated_lines", "repeats_in_row", "stops", "line_words", "short_words", "long_words",
]


def measure(text: str) -> list[float]:
    """The measures of a text in the order of MEASURES."""
    words = TOKEN.findall(text)
    n, chars = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(MEASURES)
    lower = [w.lower().strip(".,;:!?") for w in words]
    counts = Counter(lower)
    lines = [x for x in text.splitlines() if x.strip()]
    odd = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:!?\"')")
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        odd / n,
        sum(w == "|" for w in words) / n,
        sum(w.endswith("!!") for w in words) / n,
        sum(c.isupper() for c in text) / chars,
        sum(c.isdigit() for c in text) / chars,
        sum(not (c.isalnum() or c.isspace()) for c in text) / chars,
        len(counts) / n**0.75,
        counts.most_common(1)[0][1] / n,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(a == b for a, b in zip(lower, lower[1:])) / n,
        sum(text.count(c) for c in ".!?") / n,
        float(np.log1p(n / max(1, len(lines)))),
        sum(len(w) <= 3 for w in lower) / n,
        sum(len(w) > 12 for w in lower) / n,
    ]


def measures(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([measure(t or "") for t in texts])

    return run(text)


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def pseudo_documents(groups: DataFrame, mean: str, n: str, around: Column, spread: float, most: float = 1e5) -> float:
    """How many documents the prior of a group counts for: what is left of the spread
    between group means after that of chance."""
    weight, gap = F.col(n), F.pow(F.col(mean) - around, 2)
    row = groups.agg(F.sum(weight * gap).alias("seen"), F.sum(weight).alias("n"), F.count(F.lit(1)).alias("groups")).first()
    if not row["n"] or row["groups"] < 2:
        return most
    between = (row["seen"] - spread * (row["groups"] - 1)) / row["n"]
    return float(min(most, max(1.0, spread / between))) if between > 0 else most


def score_quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, held_out, own (the document's evidence), site (its path's posterior), score,
    predicted and kept for every row of ``docs`` (doc_id, text, host and path columns)."""
    bounded_batches(docs.sparkSession)
    known = materialize(training_labels(labels, "quality"))
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")).alias(n) for c, n in ((host, "host"), (path, "path"))],
            measures(F.col("text")).alias("m"),
        )
    )
    # One row per labelled document: labels are bounded, rows that repeat an id are not.
    sample = rows.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min("m").alias("m")).select("m", "label").collect()
    sample.sort(key=lambda r: (r["m"], r["label"]))
    x, y = np.array([r["m"] for r in sample]).reshape(-1, len(MEASURES)), np.array([r["label"] for r in sample], dtype=float)
    weights = fit(x, y)
    own = probability(linear(F.col("m"), weights))
    rows = rows.select("doc_id", "host", "path", own.alias("own"))

    whole = rows.agg(F.avg("own").alias("mean"), F.var_pop("own").alias("spread")).first()
    mean, spread = whole["mean"] or 0.5, max(whole["spread"] or 0.0, 1e-6)
    paths = materialize(rows.groupBy("host", "path").agg(F.sum("own").alias("path_sum"), F.count(F.lit(1)).alias("path_n")))
    hosts = paths.groupBy("host").agg(F.sum("path_sum").alias("host_sum"), F.sum("path_n").alias("host_n"))
    sites = paths.join(hosts, "host").withColumn("path_mean", F.col("path_sum") / F.col("path_n")).withColumn("host_mean", F.col("host_sum") / F.col("host_n"))
    sites = materialize(sites)
    prior = F.lit(float(mean))
    host_prior = pseudo_documents(sites.select("host", "host_mean", "host_n").distinct(), "host_mean", "host_n", prior, spread)
    path_prior = pseudo_documents(sites, "path_mean", "path_n", F.col("host_mean"), spread)

    # The site's posterior from its other documents.
    host_mean = (host_prior * prior + F.col("host_sum") - F.col("own")) / (host_prior + F.col("host_n") - 1)
    path_mean = (path_prior * F.col("host_post") + F.col("path_sum") - F.col("own")) / (path_prior + F.col("path_n") - 1)
    sited = rows.join(sites, ["host", "path"]).withColumn("host_post", host_mean).withColumn("site", path_mean)
    sited = sited.select("doc_id", "own", "site", _logit(F.col("own")).alias("a"), (_logit(F.col("site")) - _logit(prior)).alias("b"))
    pairs = sited.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("a", "b")).alias("p")).select("p.*", "label").collect()
    pairs.sort()
    both = fit(np.array([(r["a"], r["b"]) for r in pairs]).reshape(-1, 2), np.array([r["label"] for r in pairs], dtype=float))
    score = probability(both[2] + F.col("a") * float(both[0]) + F.col("b") * float(max(both[1], 0.0)))
    scored = sited.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "own", "site", score.alias("score"))
    good = F.col("score") >= KEEP
    return scored.select("*", good.cast("int").alias("predicted"), good.alias("kept"))
