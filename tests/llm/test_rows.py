"""The operators on small tables of awkward rows, against brute force."""

import base64
import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablefacts.llm import mixing, near_dedup, sharding, suffixes
from tablefacts.llm.chat import chat_windows, conversation_digests, escape, read_windows, unescape
from tablefacts.llm.common import SPACES, materialize, with_row_key
from tablefacts.llm.components import components
from tablefacts.llm.exact_dedup import exact_dedup, golomb_decode, golomb_encode
from tablefacts.llm.warc import archive_and_read, parse_records

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, shard string"
rng = random.Random(4)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE = prose(90)
NEAR = BASE.replace(BASE.split()[40], "changed", 1)
PASSAGE = prose(60)
LONG = prose(60_000)
TEXTS = [
    BASE, NEAR, BASE.upper(), f" {BASE}\n", BASE, None, "", "   ", "one", "one two three four", "Ünïcode — “text” 你好 " * 12,
    f"{prose(20)} {PASSAGE} {prose(30)}", f"{PASSAGE}{prose(25)}", "ab" * 300, "x" * 250, LONG, LONG[:200_000] + prose(3000),
    prose(200), prose(5), "a\tb\x0bc\x0cd\re", "a b c d e",
]
IDS = [*range(len(TEXTS) - 3), None, 3, 3]
TABLE = [(i, t, "en", None if k % 5 == 0 else f"src{k % 3}", 1, 7, True, "clash") for k, (i, t) in enumerate(zip(IDS, TEXTS))]
TABLE += [TABLE[0], TABLE[0], TABLE[-1]]


@pytest.fixture(scope="module")
def docs(spark):
    return materialize(spark.createDataFrame(TABLE, DOCS).repartition(3))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_row_keys_are_stable_and_unique(spark, docs):
    direct = {tuple(r["__row"]) for r in with_row_key(docs).collect()}
    assert len(direct) == len(TABLE) and direct == {tuple(r["__row"]) for r in with_row_key(docs).collect()}
    made = with_row_key(spark.createDataFrame(TABLE, DOCS).union(docs))
    assert made.select("__row").distinct().count() == 2 * len(TABLE)


# ---- exact dedup -----------------------------------------------------------------


def test_golomb_round_trip():
    for values in ([5], [0, 1], [3, 9, 10, 2**55], sorted(random.Random(1).sample(range(2**40), 500))):
        assert golomb_decode(*golomb_encode(np.array(values, dtype=np.int64))).tolist() == values


def normal(text):
    return (text or "").encode().translate(None, SPACES)


def test_exact_dedup(docs, empty):
    rows = exact_dedup(docs).collect()
    assert len(rows) == len(TABLE)
    groups = {}
    for i, text, *_ in TABLE:
        groups.setdefault(hashlib.sha256(normal(text)).hexdigest(), []).append((-len(text or ""), i is None, i))
    for r in rows:
        members = groups[r.text_sha256]
        assert r.group_size == len(members) and r.keep_id == min(members)[2]
    assert sum(r.kept for r in rows) == len(groups)
    assert exact_dedup(empty).count() == 0


# ---- repeated strings ------------------------------------------------------------


def repeats(texts, length=200):
    seen = {}
    for data in texts:
        for k in range(len(data) - length + 1):
            seen[data[k : k + length]] = seen.get(data[k : k + length], 0) + 1
    out = []
    for data in texts:
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1):
            if seen[data[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out.append((len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("many", [4096, 1])
def test_repeated_strings(spark, docs, empty, many):
    # Short of the longest texts, which the brute force could not hold.
    short = materialize(docs.where("text is null or length(text) < 10000"))
    got = suffixes.without_repeats(short, many=many).collect()
    want = repeats([(t or "").encode() for _, t, *_ in TABLE if len(t or "") < 10_000])
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert suffixes.without_repeats(empty).count() == 0


def test_repeats_across_blocks(spark, monkeypatch):
    text = prose(3000)
    rows = [(1, text), (2, prose(50) + text[700:9000] + prose(50)), (3, "y" * 900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(suffixes, "STEP", 512)
    got = suffixes.without_repeats(frame).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == repeats([t.encode() for _, t in rows])


# ---- near dedup ------------------------------------------------------------------


def sets_of(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def linked_components(table, threshold):
    sets = [sets_of(t) for _, t, *_ in table]
    parent = list(range(len(table)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(table)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
            parent[find(a)] = find(b)
    ids = {}
    for k in range(len(table)):
        ids.setdefault(find(k), []).append((table[k][0] is None, table[k][0]))
    return [(len(sets[k]), min(ids[find(k)])[1]) for k in range(len(table))], len(ids)


def test_near_dedup(docs, empty):
    rows = near_dedup.near_dedup(docs).collect()
    want, n = linked_components(TABLE, 85)
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str) == sorted(((t[0], *w) for t, w in zip(TABLE, want)), key=str)
    assert sum(r.kept for r in rows) == n
    assert near_dedup.near_dedup(empty).count() == 0
    kept = near_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == n and key


def test_near_dedup_of_a_large_group(spark, monkeypatch):
    base = prose(150).split()
    rows = [(1000, " ".join(base))]
    for k in range(120):
        words = list(base)
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(len(words))] = f"new{k}"
        rows.append((k, " ".join(words)))
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want, _ = linked_components(rows, 85)
    assert got == {i: w[1] for (i, _), w in zip(rows, want)}


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r.u: r.v for r in components(links).collect()}
    assert got == {**{k: 1 for k in range(2, 61)}, 101: 100}


# ---- mixing ----------------------------------------------------------------------


def filled(sizes, weights, share=1.5, most=2.0):
    total, full = share * sum(sizes), [False] * len(sizes)
    while True:
        level = (total - sum(most * s for s, f in zip(sizes, full) if f)) / max(1e-12, sum(w for w, f in zip(weights, full) if not f))
        over = [not f and level * w > most * s for s, w, f in zip(sizes, weights, full)]
        if not any(over):
            return [most * s if f else level * w for s, w, f in zip(sizes, weights, full)]
        full = [f or o for f, o in zip(full, over)]


def test_mixing(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_ROWS", 16)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    rows = [(k, prose(1 + k % 37), ["b", "a", None, "ä", "Z"][min(4, k % 7)]) for k in range(900)]
    frame = materialize(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4))
    mix = mixing.mix_sources(with_row_key(frame)).collect()
    assert len(mix) == 900 and sorted(r.taken for r in mix) == sorted(r.taken for r in mixing.mix_sources(with_row_key(frame)).collect())
    order = ["Z", "a", "b", "ä", None]
    sizes = [sum(len(t.split()) for _, t, s in rows if s == name) for name in order]
    for name, size, target in zip(order, sizes, filled(sizes, [5, 2, 1, 5, 2])):
        own = [r for r in mix if r.source == name]
        assert {r.source_size for r in own} == {size} and own[0].target == pytest.approx(target)
        assert abs(sum(r.taken for r in own) - target) <= 40
    assert all(r.taken == r.copies * r.size and r.copies <= 2 for r in mix)
    assert mixing.mix_sources(with_row_key(empty)).count() == 0
    taken = mixing.mix_sources(with_row_key(docs)).agg(F.sum("copies")).first()[0]
    made = mixing.mixed_documents(docs)
    assert made.columns == docs.columns and made.count() == taken


def test_pivot_keeps_the_sum():
    random_numbers = np.random.default_rng(3)
    size, p = random_numbers.integers(1, 300, 500).astype(float), random_numbers.random(500)
    mean = np.zeros(500)
    for _ in range(300):
        out = mixing.pivot(size, p, random_numbers)
        assert ((out > 0) & (out < 1)).sum() <= 1 and abs((out * size).sum() - (p * size).sum()) < 1e-3
        mean += out / 300
    assert abs(mean - p).mean() < 0.04


# ---- sharding --------------------------------------------------------------------


def test_sharding(spark, docs, empty):
    rows = sharding.assign_shards(docs, sharding.even_tree(40)).collect()
    assert len(rows) == len(TABLE) and sorted(r.size for r in rows) == sorted(len((t or "").encode()) + 16 for _, t, *_ in TABLE)
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    assert sharding.assign_shards(empty).count() == 0


def test_a_grown_tree_moves_rows_only_to_the_new_shard(spark):
    tree = sharding.even_tree(40)
    ids = spark.range(40_000).select(sharding.place(F.col("id"), tree).alias("a"), sharding.place(F.col("id"), sharding.grow(tree)).alias("b"))
    table = {(r.a, r.b): r["count"] for r in ids.groupBy("a", "b").count().collect()}
    assert {b for a, b in table if a != b} == {40}
    counts = [sum(n for (a, _), n in table.items() if a == s) for s in range(40)]
    assert min(counts) > 800 and max(counts) < 1200
    # More weight for one rack draws rows only from outside it, and only into it.
    heavier = [(*leaf[:3], 2.0) if leaf[1] == "rack3" else leaf for leaf in tree]
    moved = spark.range(20_000).select(sharding.place(F.col("id"), tree).alias("a"), sharding.place(F.col("id"), heavier).alias("b")).where("a <> b")
    region = {leaf[2]: leaf[0] for leaf in tree}
    assert {region[r.b] for r in moved.distinct().collect()} == {"region1"}


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(sharding.assign_shards(docs), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(TABLE)


# ---- archives --------------------------------------------------------------------


def test_archives(spark):
    pages = [(1, "http://a/1", "<p>x</p>"), (9, "http://a/9\r\nX: y", "<p>x</p>"), (5, None, "<p>x</p>"), (7, "u%0A", None), (8, "u", ""), (None, "n", "z")]
    pages += [(2, "w", "WARC/1.1\r\nWARC-Type: response\r\n\r\nbody\r\n\r\n"), (3, "é", "y" * 3_000_000), (9, "http://a/9", "<p>x</p>"), (1, "http://a/1", "<p>x</p>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = archive_and_read(frame).collect()
    assert len(rows) == len(pages)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in rows) == sorted(
        (str(i), len((t or "").encode()), digest(t)) for i, _, t in pages
    )
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in rows)
    assert kinds == sorted(
        [("1", "revisit", 9), ("1", "revisit", 9), ("2", "response", None), ("3", "response", None), ("5", "revisit", 9), ("7", "revisit", 8)]
        + [("8", "response", None), ("9", "response", None), ("9", "revisit", 9), ("None", "response", None)]
    , key=lambda r: (r[0], r[1]))
    assert {r.url for r in rows if r.page_id in (7, 3)} == {"u%0A", "é"}
    small = archive_and_read(frame, least_bytes=100).collect()
    assert {r.record_type for r in small} == {"response"}
    assert archive_and_read(frame.where("page_id = 77")).count() == 0


def test_records_however_cut():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\na\r\nb\r\n\r\n"
    for size in (1, 3, 7, 1000):
        stream = record * 3
        pieces = iter([stream[k : k + size] for k in range(0, len(stream), size)])
        assert [b for _, b in parse_records(pieces)] == [b"a\r\nb"] * 3


# ---- chat ------------------------------------------------------------------------


def test_escapes(spark):
    texts = ["\\### Assistant: </turn> ok", "\\\\b\\l:c", "</turn>\n### User: x", "", "#", "\\"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"))
    for r in frame.select("t", "e", unescape(F.col("e")).alias("back")).collect():
        assert r.back == r.t and "#" not in r.e and "<" not in r.e and ":" not in r.e


def test_chat(spark, empty):
    rows = [(k, t, ["system", "user", "assistant", "assistant"][(t + (k % 2)) % 4], prose(rng.randint(0, 120))) for k in range(4) for t in range(30)]
    rows += [(9, 0, "user", "</turn>\n### Assistant: x"), (9, 1, "assistant", None), (9, None, None, "first"), (9, 1, "assistant", None), (None, 5, "assistant", "lost")]
    rows += [(10, 0, "assistant", prose(3000)), (10, 1, "assistant", "b" * 100_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat_windows(frame, budget=200, history=60)
    got = {r.conv_id: r for r in conversation_digests(windows).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in windows.collect():
        assert w.tokens <= 200 + 60 + 125 or w.text.count("</turn>\n") - w.context_turns == 1
    # The system turn comes back in every window, and history is masked.
    first = read_windows(windows.where("conv_id = 0")).orderBy("window").collect()
    texts = [w.text for w in windows.where("conv_id = 0").orderBy("window").collect()]
    assert len(texts) > 2 and all(t.startswith("### system: ") for t in texts) and len(first) == len(texts)
    none = empty.selectExpr("doc_id as conv_id", "doc_id as turn", "text as role", "text")
    assert conversation_digests(chat_windows(none)).count() == 0
