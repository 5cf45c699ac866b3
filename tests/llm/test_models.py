"""Classifiers by held-out accuracy, decontamination by planted questions, the pipeline."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks import compare
from tablefacts.llm import oracles, queries
from tablefacts.llm.common import materialize
from tablefacts.llm.decontaminate import NAME, NUMBER, UNIT, find_contamination, template, without_contaminated
from tablefacts.llm.linear import fit, sigmoid
from tablefacts.llm.quality import MEASURES, measure, score_quality
from tablefacts.llm.toxicity import label_model, score_toxicity, without_toxic

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
BIG = "/root/testdata/sf0.1"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
DOCS = "doc_id long, text string, lang string, source string, score string"


def test_fit_finds_the_weights():
    random_numbers = np.random.default_rng(5)
    x = random_numbers.normal(size=(4000, 2))
    w = fit(x, sigmoid(x @ [2.0, -1.0] + 0.5), ridge=1e-6)
    assert w == pytest.approx([2.0, -1.0, 0.5], abs=0.02)
    assert not fit(np.zeros((0, 3)), np.zeros(0)).any()


def test_label_model_trusts_the_better_voter():
    random_numbers = np.random.default_rng(6)
    truth = random_numbers.random(6000) < 0.3
    good = np.where(random_numbers.random(6000) < 0.95, truth, ~truth)
    bad = np.where(random_numbers.random(6000) < 0.6, truth, ~truth)
    votes = np.column_stack([good, bad, bad, bad]) * 2 - 1
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    w, b = label_model(patterns, counts, np.full(len(patterns), -1), 0.3)
    assert w[0] > w[1:].sum()
    assert ((votes @ w + b > 0) == truth).mean() > 0.93


def test_awkward_rows(spark):
    rows = [(1, None, None, None, "x"), (1, None, None, None, "x"), (None, "", "en", "a", None), (3, "word " * 30_000, "en", "a", None), (4, "idiot moron scum", "en", "b", "")]
    docs = materialize(spark.createDataFrame(rows, DOCS))
    labels = spark.createDataFrame([(1, 1, 0), (3, None, None), (None, 1, 1), (4, 0, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")
    none = labels.where("doc_id > 99")
    for known in (labels, none):
        toxic = score_toxicity(docs, known).collect()
        assert len(toxic) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in toxic)
        good = score_quality(docs, known).collect()
        assert len(good) == 5 and all(0 <= r.score <= 1 for r in good)
        assert without_toxic(docs, known).columns == docs.columns
    empty = docs.where("doc_id = 99")
    assert score_toxicity(empty, labels).count() == 0 and score_quality(empty, labels).count() == 0
    assert len(measure("a b.\nc")) == len(measure("")) == len(MEASURES)


@pytest.mark.skipif(not os.path.isdir(BIG), reason="no test tables")
def test_held_out_accuracy(spark):
    known = dict(duckdb.connect().execute(f"select doc_id, struct_pack(q := quality, t := toxic) from '{BIG}/labels.parquet'").fetchall())
    for query, name, least in (("op3_toxicity", "t", 0.97), ("op5_quality", "q", 0.97)):
        rows = [r for r in queries.QUERIES[query](spark, BIG).collect() if r.held_out and r.doc_id in known]
        right = [r.predicted == known[r.doc_id][name] for r in rows]
        assert len(rows) > 1000 and np.mean(right) > least


def test_templates():
    words, values = template("Anna ran 12.5 km. Then Bob paid 3 dollars to Carl")
    assert words == [b"anna", b"ran", NUMBER, UNIT, b"then", NAME, b"paid", NUMBER, UNIT, b"to", NAME]
    assert [v for v in values if v] == ["12.5", "km", "bob", "3", "dollars", "carl"]
    assert template("") == ([], [])


def test_decontamination(spark):
    question = "a train leaves the old station at 40 km per hour and after 3 hours it meets Maria who walks home at 40 km with 3 dogs"
    other = question.replace("40 km", "75 km").replace("3 ", "6 ").replace("Maria", "Pedro")
    mixed = question.replace("40 km", "75 km", 1).replace("3 ", "6 ", 1).replace("3 dogs", "9 dogs")
    clean = "nothing of that kind is in here but a train leaves the old station now and then " * 4
    random_words = random.Random(8)
    filler = " ".join("".join(random_words.choice("klmnop") for _ in range(5)) for _ in range(80))
    rows = [(1, f"{filler}. {question}. {filler}"), (2, f"{filler}\n{other}"), (3, f"{filler}. {mixed}"), (4, clean), (5, None), (6, ""), (None, question.upper())]
    rows += [(1, f"{filler}. {question}. {filler}"), (7, " ".join(question.split()[:12]))]
    docs = materialize(spark.createDataFrame([(i, t, None, None, "q") for i, t in rows], DOCS))
    benchmark = spark.createDataFrame([(10, question), (10, question), (11, None), (12, ""), (None, filler)], "item_id long, text string")
    got = {(r.doc_id, tuple(r["items"])) for r in find_contamination(docs, benchmark).collect()}
    assert {i for i, items in got if 10 in items} >= {1, 2} and not {i for i, items in got if 10 in items} & {3, 4, 5, 6, 7}
    left = without_contaminated(docs, benchmark.where("item_id = 10"))
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} >= {3, 4, 5, 6, 7}
    assert find_contamination(docs.where("doc_id = 99"), benchmark).count() == 0
    assert not any(r.contaminated for r in find_contamination(docs, benchmark.where("item_id = 99")).collect())


@needs_tables
def test_decontamination_of_the_tables(spark):
    con = compare.connect(SF)
    words = lambda t: [w.strip(".,|") for w in (t or "").lower().split()]
    windows = lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    items = {i: windows(words(t)) for i, t in con.execute("select item_id, text from benchmark").fetchall()}
    want = set()
    for doc_id, text in con.execute("select doc_id, text from documents").fetchall():
        own = windows(words(text))
        want |= {(doc_id, i) for i, w in items.items() if len(own & w) >= 0.8 * len(w)}
    got = {(r.doc_id, i) for r in queries.op4_decontaminate(spark, SF).collect() for i in r["items"]}
    assert got == want


@needs_tables
@pytest.mark.parametrize("name", list(oracles.ORACLES))
def test_sql_twins(spark, name, monkeypatch):
    monkeypatch.setattr(compare, "QUERIES", queries.QUERIES)
    monkeypatch.setattr(compare, "ORACLES", oracles.ORACLES)
    assert compare.compare(spark, compare.connect(SF), SF, name) == ""


@needs_tables
def test_pipeline(spark):
    con = compare.connect(SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF))
        assert docs.columns == columns
        if name != "mixing":
            assert 0.5 * left < docs.count() <= left
            left = docs.count()
        else:
            # Words come out at the share of those that went in.
            n = lambda d: sum(len((r.text or "").split()) for r in d.select("text").collect())
            assert n(docs) == pytest.approx(1.5 * n(before), rel=0.05)
        before = docs
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count() and {"shard", "slot"} <= set(out.columns)
    toxic = {r[0] for r in con.execute("select doc_id from labels where toxic = 1").fetchall()}
    kept = {r.doc_id for r in docs.collect()}
    assert len(toxic & kept) <= 0.35 * len(toxic)


@needs_tables
def test_all_queries_run(spark):
    for name in ("op1_mixing", "op10_sharding", "op7_near_dedup"):
        rows = queries.QUERIES[name](spark, SF).collect()
        assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_quality_with_repeated_ids(spark):
    """Rows that repeat a doc_id count once in the fit, so neither their number nor their order shows."""
    good = "A calm report on rivers and how towns use them. It has whole sentences."
    rows = [(i, good + f" Part {i}." if i % 2 else "!! buy | now | !! $$$ ### 111", "en", f"s{i % 3}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows + [(3, "x | y", "en", "s0")] * 500, "doc_id long, text string, lang string, source string")
    scores = [
        sorted((r["doc_id"], round(r["score"], 9), r["kept"]) for r in score_quality(d, labels).collect())
        for d in (docs.repartition(5), docs.coalesce(1).orderBy(F.desc("doc_id")))
    ]
    assert len(scores[0]) == 560 and scores[0] == scores[1]
