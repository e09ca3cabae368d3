import random
import re
import time

import numpy as np
import pytest
from conftest import documents, hard_rows, prose
from hypothesis import given
from hypothesis import strategies as st

from weft.llm import toxicity


def corpus(rnd, n):
    rows, marks = [], []
    for i in range(n):
        w = prose(rnd, rnd.randint(20, 60)).split()
        bad = rnd.random() < 0.3
        if bad:
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(["you idiot", "moron", "you are pathetic", "1d1ot", "zorgle"]))
        rows.append((i, " ".join(w), "en", "s"))
        marks.append((i, 1, int(bad)))
    return rows, marks


def test_held_out_accuracy(spark):
    rows, marks = corpus(random.Random(1), 500)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = [r for r in toxicity.op6(documents(spark, rows), labels).collect() if r.held_out]
    want = {m[0]: m[2] for m in marks}
    assert len(got) > 60 and np.mean([r.predicted == want[r.doc_id] for r in got]) > 0.9


def test_hard_rows(hard, empty, labels):
    got = toxicity.op6(hard, labels).collect()
    assert len(got) == len(hard_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.op6(empty, labels).count() == 0
    assert {r.score for r in toxicity.op6(hard, labels.limit(0)).collect()} == {0.0}


def test_isotonic_is_monotone_and_least_squares():
    rng = np.random.default_rng(1)
    m = rng.normal(size=200)
    y = (rng.random(200) < 1 / (1 + np.exp(-m))).astype(float)
    knots, values = toxicity.isotonic(m, y)
    fit = np.interp(m, knots, values)
    order = np.argsort(m)
    assert (np.diff(fit[order]) >= -1e-12).all() and abs(fit.sum() - y.sum()) < 1e-6
    assert ((fit - y) ** 2).sum() <= ((m > 0) - y).__pow__(2).sum()


def test_obfuscated_words_count():
    f = dict(zip(toxicity.NAMES, toxicity.features(b"You are an 1d10t, m*ron, stuuupid", frozenset()), strict=True))
    assert f["masked_hits"] == 3 and f["second"] > 0
    assert toxicity.features(b"", frozenset()) == [0.0] * len(toxicity.NAMES)


def test_repeated_ids_train_once(spark):
    rows, marks = corpus(random.Random(2), 200)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    once = toxicity.train(documents(spark, rows), labels)
    again = toxicity.train(documents(spark, rows + rows[:50] * 20), labels.union(labels))
    assert once.learned == again.learned and np.array_equal(once.values, again.values)


def test_words_and_trees_come_from_rows_that_do_not_calibrate(spark):
    rows, marks = corpus(random.Random(3), 300)
    held = {r.doc_id for r in documents(spark, rows).selectExpr("doc_id", "pmod(xxhash64(doc_id, 'calibrate'), 4) = 0 held").collect() if r.held}
    rows = [(i, t + " leaked" * (i in held and m[2] == 1), *more) for (i, t, *more), m in zip(rows, marks, strict=True)]
    model = toxicity.train(documents(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert b"zorgle" in model.learned and b"leaked" not in model.learned


def test_one_tree_equals_brute_force():
    """The first split is the best of all features and bins; leaves are ridge means."""
    rng = np.random.default_rng(6)
    b = rng.integers(0, 8, (60, 3)).astype(np.uint8)
    g, h = rng.normal(size=60) + (b[:, 1] > 4), np.full(60, 0.25)

    def gain(left):
        parts = ((g[m].sum() ** 2 / (h[m].sum() + 1)) for m in (left, ~left))
        return sum(parts) - g.sum() ** 2 / (h.sum() + 1)

    able = {(j, c): gain(b[:, j] <= c) for j in range(3) for c in range(8) if min(h[b[:, j] <= c].sum(), h[b[:, j] > c].sum()) >= 2}
    feature, cut, leaf = toxicity.grow(b, g, h)
    assert (feature[0], cut[0]) == max(able, key=able.get)
    got = toxicity._margin(b, [(feature, cut, leaf)], 0.0)
    node = np.zeros(60, int)
    for _ in range(toxicity.DEPTH):
        node = np.array([2 * k + 1 + int(b[i, feature[k]] > cut[k]) for i, k in enumerate(node)])
    for k in set(node):
        assert np.allclose(got[node == k], -g[node == k].sum() / (h[node == k].sum() + 1) * toxicity.RATE)


OLD = re.compile(rb"[0-9@$!|]+[a-z][a-z0-9@$!*|._-]*[a-z]|[a-z]+[0-9@$!*|._-][a-z0-9@$!*|._-]*[a-z]")


@given(st.binary(max_size=0) | st.lists(st.sampled_from([bytes([c]) for c in b"abz019@$!|*._- ,\xc3"]), max_size=25).map(b"".join))
def test_masked_words_are_those_of_the_plain_pattern(raw):
    assert toxicity.masked_words(raw) == OLD.findall(raw)


@given(st.lists(st.sampled_from([b"f", b"u", b"c", b"k", b"*", b"i", b"d", b"o", b"t"]), min_size=1, max_size=6).map(b"".join))
def test_stars_stand_for_letters(word):
    like = re.compile(re.escape(word).replace(rb"\*", rb"[a-z]"))
    assert toxicity.unmasked(word, frozenset()) == any(like.fullmatch(w) for w in toxicity.INSULT)


@pytest.mark.parametrize("text", [b"a", b"f*ck ", b"f*ck", b"1", b"a1", b"!", b"\n", b" ", b"A", b"you ", b"1a*b "])
def test_a_megabyte_of_anything_takes_seconds(text):
    began = time.time()
    toxicity.features(text * (1_000_000 // len(text)), frozenset())
    assert time.time() - began < 20
