import random

import numpy as np
import pytest
from brute import split, targets
from conftest import documents, hard_rows, prose

from pyspark.sql import functions as F

from weft.llm import mixing


def check(rows, got, share):
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(split(r[1]))
    want, taken = targets(sizes), {}
    out = got.collect()
    assert sorted((repr(r.doc_id), r["size"]) for r in out) == sorted((repr(r[0]), len(split(r[1]))) for r in rows)
    for r in out:
        assert 0 <= r.taken <= 3 * r["size"] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(share * t, 3)


def test_sources_come_near_their_targets(spark):
    rnd = random.Random(1)
    rows = [(i, prose(rnd, int(rnd.lognormvariate(4, 1)) + 1), "en", rnd.choice(["a", "b", "b", "b", "b", "b", "é", None])) for i in range(800)]
    df = documents(spark, rows)
    check(rows, mixing.op1(df), 0.01)
    one, two = (sorted(map(tuple, mixing.op1(d).collect()), key=repr) for d in (df, df.repartition(7)))
    assert one == two


def test_many_blocks(spark):
    rnd = random.Random(2)
    rows = [(i, prose(rnd, rnd.randint(1, 60)), "en", "ab"[i % 2]) for i in range(900)]
    got = mixing.copies(documents(spark, rows), block=40).selectExpr("doc_id", "size", "source_size", "target", "size * copies taken", "source")
    check(rows, got, 0.01)


def test_caps_share_the_excess(spark):
    rows = [(1, "a " * 10, "en", "a"), (2, "b " * 1000, "en", "b"), (3, "c " * 10, "en", "c"), (4, "", "en", "d"), (5, "e " * 300, "en", "e")]
    check(rows, mixing.op1(documents(spark, rows)), 0.6)


def test_hard_rows_and_none(hard, empty):
    rows = hard_rows()
    assert mixing.op1(hard).count() == len(rows)
    assert mixing.op1(empty).count() == 0 == mixing.mix(empty).count()
    assert mixing.mix(hard).columns == hard.columns


def test_flight_keeps_totals_and_expectation():
    rng = np.random.default_rng(5)
    size = rng.integers(1, 400, 60)
    taken = np.zeros(60)
    for seed in range(300):
        x = np.full(60, 0.3)
        mixing.flight(x, size, np.random.default_rng(seed))
        assert ((x > 0) & (x < 1)).sum() <= 2
        assert x.sum() == pytest.approx(18) and x @ size == pytest.approx(0.3 * size.sum())
        taken += x
    assert np.abs(taken / 300 - 0.3).max() < 0.12


def test_stage_repeats_documents(spark):
    rnd = random.Random(4)
    rows = [(i, prose(rnd, 20), "en", "abc"[i % 3]) for i in range(90)]
    df = documents(spark, rows)
    n = {r.doc_id: r.copies for r in mixing.copies(df).collect()}
    got = mixing.mix(df).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {k: v for k, v in n.items() if v}


def test_stage_takes_what_the_mix_takes(spark):
    """Null and repeated ids keep their own copies, beside columns of any name."""
    rnd = random.Random(6)
    rows = [(i, prose(rnd, 10), "en", "a") for i in range(300)] + [(None, prose(rnd, 10), "en", "b") for _ in range(150)] + [(None, "w " * 10, "en", "b")] * 100 + [(7, "w " * 10, "en", "b")] * 50
    df = documents(spark, rows).withColumns({c: F.lit("x") for c in ("__size", "__d", "mix_row", "row", "mark", "copies")})
    want = {r.source: r.taken for r in mixing.op1(df).groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    got = mixing.mix(df)
    assert got.columns == df.columns
    words = {r.source: r.n for r in got.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    assert words == want and sum(want.values()) == 6000


def test_landing_minds_words_and_documents():
    rng = np.random.default_rng(3)
    for n in (1, 5, 14, 30, 42):
        size, x = rng.integers(5, 2000, n), rng.random(n)
        due, count = float(x @ size), float(x.sum())
        mixing.land(x, size, due, count)
        assert set(x) <= {0.0, 1.0}
        if n >= 30:
            assert abs(x @ size - due) <= 40 and abs(x.sum() - count) <= 3
