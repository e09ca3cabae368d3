import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm import vector_search

ROWS = "vec_id long, embedding array<float>, label int, mark string, cell int, vector string, b int"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, "m", 1, "v", 1) for i, e in rows], ROWS)


def brute(rows, k=20, every=20):
    """Every pair, scored and sorted."""
    def whole(e):
        if e is None or any(x is None or not math.isfinite(x) for x in e):
            return None
        return [math.floor(64 * float(np.float32(x))) for x in e]

    rows = [(i, v) for i, e in rows if (v := whole(e)) is not None]
    out = []
    for q, a in {(i, tuple(v)) for i, v in rows if i is not None and math.fmod(i, every) == 0}:
        got = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i is None, i or 0) for i, b in rows if i != q)[:k]
        out += [(q, r, None if null else i, -s) for r, (s, null, i) in enumerate(got, 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@given(st.integers(1, 40), st.integers(0, 2**32 - 1))
@settings(max_examples=60, deadline=None)
def test_bounds_hold(width, seed):
    rnd = np.random.default_rng(seed)
    q, x = (np.floor(rnd.normal(0, 10 ** rnd.integers(0, 4), (5, width))) for _ in range(2))
    x[0] = q[0]
    for parts in vector_search.LEVELS:
        assert (vector_search.segments(q, parts) @ vector_search.segments(x, parts).T >= q @ x.T).all()


@given(st.integers(0, 2**32 - 1))
@settings(max_examples=20, deadline=None)
def test_pruned_equals_all_pairs(seed):
    rnd = np.random.default_rng(seed)
    x = np.floor(rnd.normal(0, 3, (3000, 8)) + rnd.integers(-9, 9, (3, 8))[rnd.integers(0, 3, 3000)])
    q, ids = x[:300], np.arange(3000)
    i, d, s = vector_search.best(q, ids[:300], x, ids, 7)
    all_ = q @ x.T
    all_[np.arange(300), np.arange(300)] = -np.inf
    for n in range(300):
        want = np.lexsort((ids, -all_[n]))[:7]
        assert d[i == n].tolist() == want.tolist() and s[i == n].tolist() == all_[n][want].tolist()


def test_hard_rows(spark):
    rnd = random.Random(1)
    some = [(i, [rnd.gauss(0, 0.3) for _ in range(12)]) for i in range(0, 90)]
    hot = [rnd.gauss(0, 0.3) for _ in range(12)]
    rows = some + [(100 + i, hot) for i in range(50)]  # a third of all rows are one vector
    rows += [(200, None), (220, [0.1, None]), (240, [float("nan")]), (260, [float("inf")]), (280, []), (300, [0.5]), (320, [0.3] * 30), (-40, hot), (None, hot), (None, None)]
    rows += [(400, hot), (400, hot), (400, some[0][1]), (500, [0.0] * 12), (520, [-0.0] * 12)]
    assert found(vector_search.op11(frame(spark, rows))) == brute(rows)


def test_numbers_that_doubles_do_not_hold(spark):
    rows = [(0, [float(np.float32(1e6)), 3.0]), (1, [float(np.float32(1e6)), 5.0]), (2, [float(np.float32(-2e6)), 7.0]), (20, [0.01, 0.02])]
    assert found(vector_search.op11(frame(spark, rows))) == brute(rows)
    with pytest.raises(Exception, match="too large|OverflowError"):
        vector_search.op11(frame(spark, [(0, [1e30]), (1, [1e30])])).collect()


def test_more_blocks_change_nothing(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([0.1, 0.2, -0.3]) for _ in range(6)]) for i in range(700)]  # many ties
    want = found(vector_search.op11(frame(spark, rows)))
    monkeypatch.setattr(vector_search, "QUERIES", 10)
    monkeypatch.setattr(vector_search, "ROWS", 100)
    assert found(vector_search.op11(frame(spark, rows))) == want == brute(rows)


def test_empty(spark):
    assert found(vector_search.op11(frame(spark, []).limit(0))) == []
    assert found(vector_search.op11(frame(spark, [(1, [0.5])]))) == []
    assert found(vector_search.op11(frame(spark, [(0, [0.5])]))) == []
