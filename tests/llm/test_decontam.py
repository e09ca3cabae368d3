import random

import pytest
from brute import smith_waterman
from conftest import documents, hard_rows, prose
from hypothesis import given
from hypothesis import strategies as st

import numpy as np

from weft.llm import decontam

ITEMS = "item_id long, text string, word_start long"


def bench(spark, rnd):
    rows = [(i, prose(rnd, 35)) for i in range(20)] + [(20, None), (21, ""), (22, "too short"), (None, prose(rnd, 30)), (23, prose(rnd, 9))]
    return spark.createDataFrame([(*r, 1) for r in rows], ITEMS), dict(rows)


@given(st.lists(st.integers(0, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), max_size=25))
def test_alignment_equals_the_plain_one(a, b):
    assert decontam.align(np.array(a), np.array(b, dtype=np.int64))[0] == smith_waterman(a, b)


def test_copies_edits_and_clean_texts(spark):
    rnd = random.Random(6)
    items, texts = bench(spark, rnd)
    rows, want = [], set()
    for i in range(20):
        w = texts[i].split()
        kind = i % 4
        if kind == 1:  # every seventh word replaced
            w[::7] = [f"other{j}" for j in range(len(w[::7]))]
        elif kind == 2:  # words left out and put in
            w = [x for j, x in enumerate(w) if j % 9] + ["more", "words"]
        elif kind == 3:
            w = [x.upper() + "," for x in w]
        rows.append((i, f"{prose(rnd, 60)} {' '.join(w)} {prose(rnd, 60)}", "en", "s"))
        want.add((i, i))
    rows += [(100 + i, prose(rnd, 150), "en", "s") for i in range(40)] + [(200, texts[23], "en", "s")]
    want.add((200, 23))
    got = decontam.find(documents(spark, rows), items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_seeds_equal_aligning_everything(spark):
    """Against aligning every item with every text."""
    rnd = random.Random(7)
    items, texts = bench(spark, rnd)
    docs = [(i, prose(rnd, 30) + " " + " ".join(w for w in texts[rnd.randrange(20)].split() if rnd.random() > 0.15) + " " + prose(rnd, 30), "en", "s") for i in range(40)]
    want = {}
    for d, text, *_ in docs:
        for k, t in texts.items():
            if k is not None and t and len(a := decontam.words(t)) >= 8 and (s := smith_waterman(a, decontam.words(text)) / (2 * len(a))) >= 0.5:
                want[d, k] = s
    got = {(r.doc_id, r.item_id): r.score for r in decontam.find(documents(spark, docs), items).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    rnd = random.Random(8)
    items, texts = bench(spark, rnd)
    df = documents(spark, [(i, prose(rnd, 20) + " " + texts[i], "en", "s") for i in range(20)])
    whole = sorted(map(tuple, decontam.find(df, items).collect()))
    assert len(list(decontam.blocks(items, most=80))) > 5
    monkeypatch.setattr(decontam.blocks, "__defaults__", (80,))
    assert sorted(map(tuple, decontam.find(df, items).collect())) == whole
    assert decontam.clean(df, items).count() == 0


def test_a_leak_into_most_documents_is_found(spark):
    rnd = random.Random(9)
    items, texts = bench(spark, rnd)
    df = documents(spark, [(i, prose(rnd, 40) + " " + texts[3], "en", "s") for i in range(50)])
    assert {r.item_id for r in decontam.find(df, items).collect()} == {3} and decontam.find(df, items).count() == 50


def test_an_edited_copy_is_found_beside_many_of_its_opening(spark):
    """Its intact words are the frequent ones; the rarer rest of the item is changed."""
    rnd = random.Random(10)
    w = prose(rnd, 15).split()
    items = spark.createDataFrame([(1, " ".join(w), 1)], ITEMS)
    edited = [x if j not in (7, 10, 13) else "other" for j, x in enumerate(w)]
    rows = [(i, f"{prose(rnd, 20, ['pad'])} {' '.join(w[:7])} {prose(rnd, 20, ['pad'])}", "en", "s") for i in range(200)]
    rows += [(300 + i, " ".join(w), "en", "s") for i in range(30)] + [(400, " ".join(edited), "en", "s")]
    got = {r.doc_id: r.score for r in decontam.find(documents(spark, rows), items).collect()}
    assert got[400] == pytest.approx(0.7) and set(got) == {*range(300, 330), 400}


def test_copies_without_three_words_in_a_row(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight", 1)], ITEMS)
    texts = ["one two x four five x seven eight", "one x two x three x four x five x six x seven x eight", "one two x x x three x x x four x eight"]
    got = decontam.find(documents(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), items).collect()
    assert {r.doc_id: r.score for r in got} == {0: 10 / 16, 1: 9 / 16}


@given(st.lists(st.integers(0, 5), min_size=1, max_size=12), st.lists(st.integers(0, 9), max_size=60), st.sampled_from([0.3, 0.5, 0.8, 1.0]))
def test_bounds_lose_nothing(item, text, least):
    """Against aligning the item with the whole text."""
    index = decontam.build([1], [[f"w{x}" for x in item]])
    want = smith_waterman(item, text) / (2 * len(item))
    got = decontam.match(index, " ".join(f"w{x}" for x in text), least)
    assert [r[1] for r in got] == ([want] if want >= least else [])


def test_long_texts_are_cut_without_loss(monkeypatch):
    rnd = random.Random(12)
    monkeypatch.setattr(decontam, "SEGMENT", 40)
    monkeypatch.setattr(decontam, "CELLS", 50)
    items = [[rnd.choice("abcdefgh") for _ in range(rnd.randint(8, 12))] for _ in range(6)]
    index = decontam.build(list(range(6)), items)
    for _ in range(20):
        text = [rnd.choice("abcdefghxyzuvw") for _ in range(300)]
        want = {i: s for i, w in enumerate(items) if (s := smith_waterman(w, text) / (2 * len(w))) >= 0.5}
        assert {r[0]: r[1] for r in decontam.match(index, " ".join(text), 0.5)} == want


def test_items_without_an_id_are_cleaned_away(spark):
    text = prose(random.Random(13), 20)
    items = spark.createDataFrame([(None, text, 1)], ITEMS)
    df = documents(spark, [(1, text, "en", "s"), (2, "clean", "en", "s")])
    assert [r.doc_id for r in decontam.clean(df, items).collect()] == [2] and decontam.find(df, items).count() == 0


def test_hard_rows_and_none(spark, hard, empty):
    items, _ = bench(spark, random.Random(1))
    assert decontam.find(hard, items).count() == 0
    assert decontam.clean(hard, items).count() == len(hard_rows()) and decontam.clean(hard, items).columns == hard.columns
    assert decontam.find(empty, items).count() == 0 == decontam.find(hard, items.limit(0)).count()


def test_short_items_match_as_they_stand(spark):
    items = spark.createDataFrame([(1, "one red fox ran home", 1), (2, "yes", 1), (3, "", 1), (4, "one red fox ran away now", 1)], ITEMS)
    docs = [(1, "so One red, fox ran home. One red fox ran home", "en", "s"), (2, "one red fox walked home", "en", "s"), (3, "yes", "en", "s"), (4, "yes of course", "en", "s"), (None, "one red fox ran home", "en", "s"), (5, "", "en", "s"), (6, None, "en", "s")]
    df = documents(spark, docs)
    got = {(r.doc_id, r.item_id, r.score, r.word_start, r.word_end) for r in decontam.find(df, items).collect()}
    assert got == {(1, 1, 1.0, 1, 6), (3, 2, 1.0, 0, 1), (None, 1, 1.0, 0, 5)}
    assert {r.doc_id for r in decontam.clean(df, items).collect()} == {2, 4, 5, 6}


def test_stage_on_hard_rows(hard, empty, spark):
    items = spark.createDataFrame([(1, hard_rows()[0][1], 1), (None, hard_rows()[11][1][:200], 1)], ITEMS)
    got = decontam.clean(hard, items)
    assert got.columns == hard.columns and sorted(repr(r.doc_id) for r in got.collect()) == sorted(repr(r[0]) for r in hard_rows() if r[1] is None or not (r[1].startswith(hard_rows()[0][1]) or hard_rows()[11][1][:200] in r[1]))
    assert decontam.clean(empty, items).count() == 0 == decontam.find(empty, items).count()
