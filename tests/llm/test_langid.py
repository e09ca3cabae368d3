import random

from conftest import documents, hard_rows
from pyspark.sql import functions as F

from weft.llm import langid
from weft.llm.common import crc_fold

PARTS = {"en": ["th", "ing", "wh", "ed", "ough", "ly"], "de": ["sch", "ein", "ung", "ich", "ü", "tz"], "fr": ["eau", "é", "tion", "que", "oi", "ê"]}


def rows(rnd, n):
    out = []
    for i in range(n):
        lang = rnd.choice(list(PARTS))
        out.append((i, " ".join("".join(rnd.choice(PARTS[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(3, 40))), lang, "s"))
    return out


def test_held_out_accuracy(spark):
    data = rows(random.Random(1), 400)
    got = langid.op8(documents(spark, data))
    lang = {r[0]: r[2] for r in data}
    held = [r for r in got.collect() if r.held_out]
    assert len(held) > 80 and sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in held)


def test_folds_are_by_crc(spark):
    import zlib

    df = spark.range(50).select(F.col("id").alias("i"), crc_fold(F.col("id"), 3).alias("f"))
    assert all(r.f == zlib.crc32(str(r.i).encode()) % 3 for r in df.collect())


def test_hard_rows(hard, empty):
    got = langid.op8(hard).collect()
    assert len(got) == len(hard_rows())
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {4, 5, 6} <= und and not und & {1, 7, 8, 9, 13, 14}
    assert langid.op8(empty).count() == 0
    assert langid.op8(hard.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred != 'und'").count() == 0


def test_stage_keeps_clean_documents(spark):
    data = rows(random.Random(2), 300) + [(900, "123 ... !!", "en", "s"), (901, None, "en", "s")]
    got = langid.keep_identified(documents(spark, data))
    ids = {r.doc_id for r in got.collect()}
    assert got.columns == documents(spark, data).columns and not ids & {900, 901} and len(ids) >= 297


def test_signs_are_no_letters(spark):
    got = langid.op8(documents(spark, rows(random.Random(3), 60) + [(900, "x² ½".replace("x", ""), "en", "s"), (901, "① Ⅷ 12", "en", "s"), (902, "1 é", "fr", "s")]))
    assert {r.doc_id for r in got.collect() if r.lang_pred == "und"} == {900, 901}


def test_sample_is_bounded_and_exact(spark):
    """The smallest hashes of each language, one text an id, however often rows repeat."""
    data = [(i, "word", "en" if i % 10 else "de", "s") for i in range(3000)]
    df = documents(spark, data + data[:400] * 5)
    got = {(r.doc_id, r.lang) for r in langid.some_ids(df, 40).collect()}
    order = df.selectExpr("doc_id", "lang", "xxhash64(doc_id) h").distinct().collect()
    want = {(r.doc_id, r.lang) for lang in ("en", "de") for r in sorted((r for r in order if r.lang == lang), key=lambda r: r.h)[:40]}
    assert got == want


def test_long_texts_in_pieces():
    import numpy as np

    rng = np.random.default_rng(1)
    raw = rng.integers(97, 123, 3 * langid.PIECE + 17).astype(np.uint8)
    model = langid.Model(["a", "b"], rng.normal(size=(1 << langid.BITS, 2)).astype(np.float32), np.zeros(2), 1.0, 0.0)
    z = model.logits[langid.buckets(raw)].mean(axis=0, dtype=np.float64)
    best, score = model.predict(raw)
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    assert best == p.argmax() and abs(score - p[best]) < 1e-3


def test_stage_keeps_clashing_columns(hard, empty):
    more = {c: F.lit("x") for c in ("lang_pred", "lang_score", "lang_rejected", "__lang")}
    got = langid.keep_identified(hard.withColumns(more))
    assert got.columns == hard.withColumns(more).columns and got.where("lang_rejected != 'x'").count() == 0
    assert langid.keep_identified(empty).count() == 0
