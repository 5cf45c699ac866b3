"""Top-k search, Merkle manifest and token alignment against brute force, on awkward rows."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablefacts.llm import alignment, merkle, topk
from tablefacts.llm.common import materialize

rng = random.Random(11)

# ---- top-k search ----------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, score long, rank int, part string"
NAN, INF = float("nan"), float("inf")


def vector(n=6):
    return [rng.uniform(-1, 1) for _ in range(n)]


SAME = vector()
AWKWARD = [None, [], [None, 1.0], [NAN, 0.0], [INF, 1.0], [0.0] * 6, [0.5], [1e30, -1e30, 1.0], *[SAME] * 15, *[vector() for _ in range(60)], *[vector(9) for _ in range(9)]]
ROWS = [(None if k == 11 else k // 2 * 2 if k > 80 else k, v, 1, 2, "x") for k, v in enumerate(AWKWARD)]


def expected_top(rows, every, k):
    whole = [
        (i, [int(np.floor(1024 * np.float64(np.float32(x)))) for x in v])
        for i, v, *_ in rows
        if v is not None and all(x is not None and np.isfinite(np.float32(x)) for x in v)
    ]
    held = lambda x: max(-(2**63), min(2**63 - 1, x))
    whole = [(i, [held(x) for x in v]) for i, v in whole]
    out = []
    for n, (i, q) in enumerate(whole):
        if i is not None and i % every == 0:
            scores = [(-held(sum(x * y for x, y in zip(q, v))), j is None, j or 0) for m, (j, v) in enumerate(whole) if m != n]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, pack", [(4096, 1024), (16, 3)])
def test_top_k(spark, monkeypatch, block, pack):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "PACK", pack)
    frame = materialize(spark.createDataFrame(ROWS, VECTORS).repartition(3))
    got = topk.top_k(frame, F.col("vec_id") % 5 == 0, 4)
    assert sorted(map(tuple, got.collect()), key=repr) == expected_top(ROWS, 5, 4)


def test_top_k_of_few_and_of_none(spark):
    few = [(0, [1.0], 1, 1, ""), (0, [1.0], 1, 1, "")]
    assert sorted(map(tuple, topk.top_k(spark.createDataFrame(few, VECTORS), F.col("vec_id") % 100 == 0).collect())) == [(0, 1, 0, 1024**2)] * 2
    assert topk.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0).collect() == []


def test_threshold_stops_early_and_loses_nothing():
    values = np.random.default_rng(3).integers(-1000, 1000, (3000, 3)).astype(float)
    values[:, 0] *= 50  # one list decides, so the threshold falls soon
    lists = np.argsort(values, axis=0, kind="stable").T
    query = np.array([100.0, 1.0, -2.0])
    places, scores = topk.threshold_search(values, lists, query, 5, None, np.array([7]))
    whole = values @ query
    whole[7] = -np.inf
    assert len(places) < 100 and sorted(scores)[-5:] == sorted(whole)[-5:]
    none, _ = topk.threshold_search(values, lists, query, 5, int(whole.max()) + 1, np.array([], int))
    assert len(none) <= 1


# ---- Merkle manifest -------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root int, h string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    i, text, lang, source, n, *_ = row
    values = [i, source, lang, None if n is None else n + more, text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def brute_tree(digests):
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for k, p in enumerate(at):
            run = level[p // 2 * 2 : p // 2 * 2 + 2]
            paths[k].append(("".join(run[: p % 2]), "".join(run[p % 2 + 1 :])))
            at[k] = p // 2
        level = [h(*level[k : k + 2]) for k in range(0, len(level), 2)]
    return level[0], paths


def expected_manifest(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted(langs[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for x in names]
    trees = [brute_tree([leaf_of(r) for r in g]) for g in groups]
    root, above = brute_tree([t[0] for t in trees])
    out = []
    for group, (subroot, paths), up in zip(groups, trees, above):
        for r, path in zip(group, paths):
            path = [*path, *up]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = leaf_of(r, int(tampered))
            for before, after in path:
                folded = h(before, folded, after)
            out.append((r[0], leaf_of(r), subroot, root, h(*[x for step in path for x in step]), folded, folded == root))
    return sorted(out, key=repr)


def documents(n, langs):
    rows = [(k, f"text {k} é", rng.choice(langs), rng.choice([None, "a", "ü"]), k, "x", 1, "y") for k in range(n)]
    rows += [(None, None, None, None, None, "x", 1, "y"), (3, "", "", "", 0, "x", 1, "y"), (1, "long " * 50_000, "xx", None, 5, "x", 1, "y")]
    return [*rows, rows[0], rows[0], (rows[0][0], "other", *rows[0][2:])]


@pytest.mark.parametrize("n, langs, bits", [(40, ["de", "en", None, "Ä"], 2), (75, ["en"], 3), (300, ["a", "b", "c", "d", "e"], 9), (0, ["en"], 9)])
def test_manifest(spark, monkeypatch, n, langs, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    rows = documents(n, langs) if n else [(7, "one", "en", None, None, "x", 1, "y")]
    got = merkle.document_manifest(spark.createDataFrame(rows, DOCS).repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == expected_manifest(rows)


def test_manifest_of_other_columns_and_of_none(spark):
    frame = spark.createDataFrame([(k, f"v{k}", k % 2) for k in range(9)], "k int, v string, g int")
    got = merkle.merkle_manifest(frame, ["k", "v"], "g", "k")
    assert got.count() == 9 and got.select("root").distinct().count() == 1 and got.select("subroot").distinct().count() == 2
    assert got.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert got.where(merkle.fold(F.sha2("leaf", 256), F.col("proof")) == F.col("root")).count() == 0
    assert merkle.document_manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_manifest_plan_moves_no_digests_by_joins(spark):
    rows = spark.createDataFrame(documents(20, ["en"]), DOCS)
    keyed = rows.select(F.lit(0).alias("g"), F.col("doc_id").alias("rank"), F.lit(26).cast("long").alias("n"), F.col("text").alias("h"), F.struct("doc_id").alias("own"))
    plan = merkle.tree(keyed, ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


# ---- alignment of tokens ---------------------------------------------------------

TEXTS = [
    None, "", " ", "   two   spaces  ", "plain words stand one to one here", "a▁b", "<|endoftext|> <s> </s> <unk> <0x41>", "Ünïcode — “text” 你好 " * 5,
    "zzxqj wvutsk qpmnbv " * 40, "line\nbreak\ttab\x0bvt\x85nel　wide", " " * 200_000 + "x", "y" * 20_000, "no" + "\x00" + "zero", "plain words stand one to one here",
]


def expected_alignment(rows, encoders):
    per, counts = [], Counter()
    for i, text in rows:
        a, b = (encoders.a.encode_ordinary(f" {text}"), encoders.b.encode(text)) if text and len(text) < 100_000 else ([], [])
        if text and len(text) >= 100_000:
            a, b = encoders.plain_a().encode(f" {text}", add_special_tokens=False).ids, encoders.b.encode(text)
        if not text or b"".join(encoders.b_bytes[x] for x in b) != f" {text}".encode():
            a, b = [], []
        ends_a, ends_b = (list(accumulate(len(names[x]) for x in ids)) for ids, names in ((a, encoders.a_bytes), (b, encoders.b_bytes)))
        common, groups, links = set(ends_a) & set(ends_b), [], []
        for ids, ends, side in ((a, ends_a, 0), (b, ends_b, 1)):
            runs = [[]]
            for x, e in zip(ids, ends):
                runs[-1].append(str(x))
                if e in common:
                    runs.append([])
            groups.append([",".join(r) for r in runs[:-1]])
        last_a, last_b = dict(zip(ends_a, a)), dict(zip(ends_b, b))
        links = [(last_a[e], last_b[e]) for e in common]
        counts.update(links)
        per.append((i, len(a), len(b), ";".join(f"{x}|{y}" for x, y in zip(*groups)), links))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return sorted(
        (
            (i, n_a, n_b, len(links), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
             hashlib.sha256(groups.encode()).hexdigest() if links else "")
            for i, n_a, n_b, groups, links in per
        ),
        key=repr,
    )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def encoders():
    files = [open(f"{alignment.FOLDER}/{name}", "rb").read() for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.Encoders(*files)


@pytest.mark.parametrize("most_pairs", [alignment.MOST_PAIRS, 0])
def test_alignment(spark, monkeypatch, encoders, most_pairs):
    monkeypatch.setattr(alignment.value_links, "__defaults__", (most_pairs,))
    ids = [None, 3, 3, *range(4, len(TEXTS) + 1)]
    rows = [(i, t, 1, "g", 2) for i, t in zip(ids, TEXTS)]
    rows += rows[4:6]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_a long, groups string, rf long").repartition(3)
    got = alignment.alignment_digests(frame).select(*COLUMNS)
    assert sorted(map(tuple, got.collect()), key=repr) == expected_alignment([r[:2] for r in rows], encoders)
    assert alignment.alignment_digests(frame.limit(0)).collect() == []


def test_whole_alignment_of_documents(spark, encoders):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = alignment.alignment_digests(docs).select(*COLUMNS)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == expected_alignment(rows, encoders)


def test_fast_encoder_agrees_with_the_file(encoders):
    texts = [f" {t}" for t in TEXTS if t]
    assert [encoders.a.encode_ordinary(t) for t in texts if len(t) < 100_000] == [
        encoders.plain_a().encode(t, add_special_tokens=False).ids for t in texts if len(t) < 100_000
    ]


def test_irregular_groups_of_random_ends():
    for _ in range(300):
        n = rng.randint(1, 200)
        a, b = (sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n}) for _ in range(2))
        cuts_a, cuts_b = alignment.common_cuts(np.array(a), np.array(b))
        common = sorted(set(a) & set(b))
        assert [a[x] for x in cuts_a] == common == [b[x] for x in cuts_b]
