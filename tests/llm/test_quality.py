import math
import random
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from brute import base_rules
from conftest import documents, hard_rows, prose

from weft.llm import quality

COLS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def check(rows, got):
    want = sorted((repr(r[0]), *base_rules(r[1])) for r in rows)
    assert sorted((repr(r["doc_id"]), *(r[c] for c in COLS)) for r in got.collect()) == want


def test_base_rules_on_hard_rows(hard, labels):
    check(hard_rows(), quality.op5(hard, labels))


def test_base_rules_on_repeating_texts(spark, labels):
    rnd = random.Random(2)
    few = ["a", "b", "#c", "d|", "e<"]
    rows = [(i, rnd.choice(["\n", " ", "\n\n", "\t"]).join(prose(rnd, rnd.randint(1, 6), few).replace("1", "") for _ in range(rnd.randint(1, 30))), "en", "s") for i in range(60)]
    check(rows, quality.op5(documents(spark, rows), labels))


def test_verdict_prefers_the_trusted_kind(spark):
    rnd = random.Random(3)
    good, bad = ["calm", "clear", "prose"], ["buy", "click", "win"]
    rows = [(i, prose(rnd, 80, good if i % 2 else bad), "en", "s") for i in range(80)]
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.op5(documents(spark, rows), marks).collect()}
    assert sum(got[i] for i in range(80) if i % 2) >= 38 and not any(got[i] for i in range(0, 80, 2))


def test_every_trusted_document_counts(spark):
    """Of 21,000 trusted documents those with the largest hashes hold a word of their own; half of them are counted like all others."""
    ids = [r[0] for r in spark.range(21_000).selectExpr("id", "xxhash64(id) h").orderBy("h", "id").select("id").collect()]
    rows = [(i, "common" if n < 20_000 else "rare") for n, i in enumerate(ids)]
    marks = spark.range(21_000).selectExpr("id doc_id", "1 quality", "0 toxic")
    got = quality.op5(spark.createDataFrame(rows, "doc_id long, text string"), marks).where(f"doc_id = {ids[-1]}").first()
    assert abs(got.score) < 0.5


def test_trusted_ids_by_bitmap_or_join(spark, monkeypatch):
    ids = [-70_000, -32_768, -5, -1, 0, 1, 2, 7, 8, 9, 32_767, 32_768, 32_769, 65_536, 65_537, 2**40, None]
    docs = spark.createDataFrame([(i, str(i)) for i in [*ids, 1]], "doc_id long, text string")
    good = spark.createDataFrame([(i,) for i in ids[::2] if i is not None], "doc_id long")
    for most in (quality.BITMAPS, 0):
        monkeypatch.setattr(quality, "BITMAPS", most)
        assert sorted(r.doc_id for r in quality._marked(docs, good).collect()) == sorted(i for i in [*ids, 1] if i in ids[::2] and i is not None)


def test_plan_is_native(hard, labels):
    plan = quality.op5(hard, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_without_labels_or_rows(hard, empty, labels):
    assert quality.op5(empty, labels).count() == 0
    got = quality.op5(hard, labels.limit(0))
    assert got.where("kept = base_failed").count() == 0


def spark_hash(*parts):
    """Spark's xxhash64 over texts and numbers, signed."""
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else struct.pack("<q", p), h)
    return h - (1 << 64) if h >> 63 else h


def test_verdicts_equal_brute_force(spark):
    """Counts, ratios, threshold and verdict in plain Python."""
    rnd = random.Random(11)
    good, bad = [f"g{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    text = lambda share: " ".join(rnd.choice(good if rnd.random() < share else bad) for _ in range(rnd.randint(30, 120)))
    docs = [(i, text(rnd.choice([0.95, 0.5, 0.1])), "en", "s") for i in range(300)] + [(300, None, "en", "s"), (301, "one", "en", "s"), (302, "", "en", "s")]
    marks = [(i, int(i % 3 == 0), 0) for i in range(200)]
    df = documents(spark, docs)
    got = {r.doc_id: r for r in quality.op5(df, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    words = {i: (t or "").split() for i, t, *_ in docs}
    cells = lambda w: [spark_hash(*k) % quality.BUCKETS for a, b in zip(w, [*w[1:], ""], strict=False) for k in ((a,), (a, b))]
    trusted = [i for i, q, _ in marks if q]
    counted = {i for i in trusted if spark_hash(i, "half") % 2 == 0}
    raw, kept = Counter(), Counter()
    for i, w in words.items():
        raw.update(cells(w))
        kept.update(cells(w) if i in counted else [])
    a, b = sum(raw.values()) + 0.5 * quality.BUCKETS, sum(kept.values()) + 0.5 * quality.BUCKETS
    ratio = lambda c: round(math.log((kept[c] + 0.5) / b) - math.log((raw[c] + 0.5) / a), 6)
    score = {i: sum(map(ratio, cells(w))) / (2 * len(w)) if w else 0.0 for i, w in words.items()}
    least = np.percentile([score[i] for i in trusted if i not in counted and len(words[i]) >= 50], 100 * quality.TAIL)
    for i, r in got.items():
        assert r.score == pytest.approx(score[i], abs=1e-9)
        if abs(score[i] - least) > 1e-9:
            assert r.kept == (not r.base_failed and score[i] >= least)
    assert 0 < sum(r.kept for r in got.values()) < len(got)
