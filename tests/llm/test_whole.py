"""Documents that the text operators once lost."""

import random

from tablefacts.llm.common import materialize
from tablefacts.llm import decontaminate
from tablefacts.llm.decontaminate import broken_slots, find_contamination, without_contaminated
from tablefacts.llm.toxicity import RUN, WHOLE, Lexicon, different_documents, families, mine_lexicon

DOCS = "doc_id long, text string, lang string, source string, score string"


def test_decontamination_with_broken_maps(spark):
    pears = "on the market stall lay 5 apples beside 3 pears and nobody wanted to buy any of them before noon"
    twos = "the old baker sold 2 loaves in the morning and 2 cakes at night so how much was left over"
    words = random.Random(9)
    tale = [("".join(words.choice("klmnop") for _ in range(5)) if k % 12 else "Maria") for k in range(1, 120)]
    edited = tale[:59] + ["Pedro"] + tale[60:]
    frame = "at {} men left and {} came then {} sat while {} ate but at {} all slept"
    rows = [
        (1, pears.replace("5", "4").replace("3", "4")), (2, twos.replace("2 loaves", "4 loaves").replace("2 cakes", "7 cakes")),
        (3, " ".join(edited)), (4, frame.format(5, 6, 7, 8, 9)),
    ]
    assert tale[59] == "Maria"
    items = [(1, pears), (2, twos), (3, " ".join(tale)), (4, frame.format(2, 2, 3, 3, 2))]
    docs = materialize(spark.createDataFrame([(i, t, None, None, "q") for i, t in rows], DOCS))
    got = {r.doc_id: r["items"] for r in find_contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: [1], 2: [2], 3: [3], 4: []}
    assert broken_slots([("2", "4"), ("3", "4"), ("2", "4")]) == 0 and broken_slots([("2", "4"), ("2", "7")]) == 1
    assert broken_slots([("anna", "lea"), ("tom", "lea"), ("anna", "lea")]) == 1 and broken_slots([]) == 0


def test_decontamination_in_another_letter_case(spark):
    item = "in the harbour of Genoa old captain Marco met Lucia and Paolo. They sailed 30 miles to Elba where Rosa sold the straße maps to Pietro for 12 euros"
    bare = "Anna 5 Bob 3 Carl 7 Dora 12 Emil 40"
    numbers = "3 14 15 92 65 35 89"
    texts = [item.lower(), item.upper(), item.title(), item.replace(".", ""), item.lower().replace("30", "45").replace("12", "8"), f"so {bare} then", numbers]
    texts += [item.replace("Marco", "Anton").replace("Lucia", "Berta"), "Gina 8 Hugo 9 Ivan 2 Jana 11 Kurt 50", "1 2 3 4 5 6 7", item.lower()[:60]]
    docs = materialize(spark.createDataFrame([(i, t, None, None, "q") for i, t in enumerate(texts)], DOCS))
    benchmark = spark.createDataFrame([(1, item), (2, bare), (3, numbers)], "item_id long, text string")
    got = [r["items"] for r in find_contamination(docs, benchmark).orderBy("doc_id").collect()]
    assert got == [[1]] * 5 + [[2], [3], [1], [], [], []]


def test_short_items_long_texts_and_clashing_columns(spark):
    words = random.Random(12)
    prose = lambda n: " ".join("".join(words.choice("klmnop") for _ in range(5)) for _ in range(n))
    question = prose(30)
    items = [(1, "quick Brown foxes"), (2, "seven 7 green rivers"), (3, "lonely pair"), (4, question)]
    texts = [
        f"{prose(20)} QUICK brown foxes {prose(20)}", "Quick brown foxes", f"{prose(5)} seven 7 green rivers", f"{prose(5)} seven 8 green rivers",
        f"{prose(9)} lonely pair", "Lonely pair!", f"{prose(200_000)} {question} {prose(10)}", f"{prose(9)} quick brown", None, "",
    ]
    docs = spark.createDataFrame([(i, t, "a", "b", "c", "d", "e") for i, t in enumerate(texts)], "doc_id long, text string, item string, way string, rf string, __row string, d_text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = [r["items"] for r in find_contamination(docs, benchmark).orderBy("doc_id").collect()]
    assert got == [[1], [1], [2], [], [], [3], [4], [], [], []]
    left = without_contaminated(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted(left.collect()) == sorted(r for r in docs.collect() if not got[r.doc_id])


def test_a_beginning_that_many_items_share_brings_no_pairs(spark, monkeypatch):
    words = random.Random(13)
    prose = lambda n: " ".join("".join(words.choice("klmnop") for _ in range(5)) for _ in range(n))
    stem = prose(12)
    items = [(k, f"{stem} {prose(10)}") for k in range(200)]
    rows = [(k, f"{stem} {prose(4)}") for k in range(100)] + [(100, f"{prose(3)} {items[5][1]} {prose(3)}")]
    # 0.8 of the windows: 15 of 18 (the last three words are others), then 14.
    edited = items[7][1].split()
    rows += [(101, " ".join([*edited[:-3], "x", "y", "z"])), (102, " ".join([*edited[:-4], "w", "x", "y", "z"]))]
    kept = []
    monkeypatch.setattr(decontaminate, "shared_windows", lambda *a, of=decontaminate.shared_windows: kept.append(of(*a)) or kept[-1])
    docs = materialize(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r["items"] for r in find_contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect() if r.contaminated}
    assert got == {100: [5], 101: [7]}
    assert kept[0].count() < 2 * 2 * 3 * 18


def test_lexicon_keeps_rare_and_short_insults(spark):
    words = random.Random(10)
    word = lambda letters, n: "".join(words.choice(letters) for _ in range(n))
    insults = sorted({word("qxzvw", 9) for _ in range(600)})
    rows = []
    for k in range(3600):
        text = [word("abcde", 5) for _ in range(12)]
        if k < 900:
            text += [insults[(k * 4 + j) % len(insults)] for j in range(4)]
        if k < 100:
            text += ["xyz", f"{word('ab', 3)}kjhgf{word('ab', 2)}", "fghi" * 3 if k < 2 else "an"]
        if 100 <= k < 200:
            text += ["今日は" + word("一二三四五", 2) + "馬鹿" + word("一二三四五", 2)]
        rows.append((k, " ".join(text)))
    docs = materialize(spark.createDataFrame([(i, t, None, None, "q") for i, t in rows], DOCS))
    labels = spark.createDataFrame([(k, int(k < 900)) for k in range(3600)], "doc_id long, label int")
    lexicon = Lexicon(mine_lexicon(docs, labels))
    assert sum(lexicon.find(w) >= 0 for w in insults) > 0.99 * len(insults)
    assert lexicon.find("xyz") >= 0 and lexicon.find("bbakjhgfab") >= 0 and lexicon.find("一馬鹿二") >= 0
    assert not any(lexicon.find(word("abcde", 5)) >= 0 for _ in range(50)) and lexicon.find("xy") < 0
    assert families({"idio": 5, "idiot": 5, WHOLE + "ass": 4, RUN + "diot": 5, RUN + "diots": 5}) == [RUN + "diot", WHOLE + "ass", "idiot"]


def test_only_copies_of_one_label_count_once(spark):
    words = random.Random(11)
    prose = lambda n: " ".join("".join(words.choice("klmnop") for _ in range(5)) for _ in range(n))
    page = prose(40)
    rows = [(k, f"{page} {prose(50)}", 1) for k in range(40)]  # a shared passage, similarity about 0.27
    rows += [(100 + k, f"{page} {prose(1)}", 1) for k in range(5)]  # copies
    rows += [(50, f"{page} x", 0), (200, None, 0), (201, "", 1)]
    docs = materialize(spark.createDataFrame([(i, t, None, None, "q") for i, t, _ in rows], DOCS))
    labels = spark.createDataFrame([(i, n) for i, _, n in rows], "doc_id long, label int")
    got = different_documents(docs, labels).collect()
    assert sum(r.label for r in got) == 42 and len(got) == 44
