import random

from brute import repeats
from conftest import documents, hard_rows, prose
from pyspark.sql import functions as F

from weft.llm import substring


def check(rows, got):
    want = sorted((repr(r[0]), *w) for r, w in zip(rows, repeats([r[:2] for r in rows]), strict=True))
    assert sorted((repr(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == want


def test_hard_rows(hard):
    check(hard_rows(), substring.op4(hard))


def test_empty(empty):
    assert substring.op4(empty).count() == 0


def test_overlapping_passages(spark):
    """Passages just below, at and over the window, at text ends, doubled, and across three documents."""
    rnd = random.Random(8)
    pool = [prose(rnd, n) for n in (12, 13, 14, 25, 40)]
    rows = []
    for i in range(60):
        parts = [prose(rnd, rnd.randint(0, 20)), rnd.choice(pool), prose(rnd, rnd.randint(0, 3)), rnd.choice(pool), "of of of " * rnd.randint(0, 9)]
        rows.append((rnd.randint(1, 40), " ".join(p for p in parts if p), "en", "s"))
    check(rows, substring.op4(documents(spark, rows).repartition(5)))


def test_few_blocks_or_many(spark, hard):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "17")
        check(hard_rows(), substring.op4(hard))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stage_cuts_only_repeats(hard):
    rows = {(r.doc_id, i): r for i, r in enumerate(substring.cut_repeats(hard).select("doc_id", "text", "n_chars").collect())}
    texts = {d: r.text for (d, _), r in rows.items() if d is not None}
    assert texts[1] and texts[2] == "" and texts[4] is None and texts[6] == " \t\n\x0b\x0c\r " and texts[3] == "tail"
    assert all(r.n_chars == len(r.text or "") for r in rows.values())
    assert substring.cut_repeats(hard).columns == hard.columns
    assert substring.cut_repeats(hard).where(F.col("k") != 1).count() == 0


def test_large_blocks_are_dealt_out_again(spark, monkeypatch):
    """A frequent anchor: every block is too large at first."""
    monkeypatch.setattr(substring, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(substring, "BATCH_BYTES", 4000)
    rnd = random.Random(11)
    shared = prose(rnd, 30)
    rows = [(i, f"{prose(rnd, 9)} one frequent gram of five {prose(rnd, 9)} {shared if i % 3 == 0 else ''} {prose(rnd, 5)}", "en", "s") for i in range(150)]
    df = documents(spark, rows).repartition(4)
    check(rows, substring.op4(df))


def test_blocks_follow_the_size_of_the_texts(spark, monkeypatch):
    """Many blocks' worth of different texts: none is dealt out again, let alone time after time."""
    rounds, keep = [], substring.materialize

    def count(df, label):
        rounds.append(label)
        assert len(rounds) < 4
        return keep(df, label)

    monkeypatch.setattr(substring, "materialize", count)
    monkeypatch.setattr(substring, "BLOCK_BYTES", 20_000)
    rnd = random.Random(15)
    shared = prose(rnd, 30)
    rows = [(i, f"{prose(rnd, 120)} {shared if i % 3 == 0 else ''} {prose(rnd, 50)}", "en", "s") for i in range(500)]
    check(rows, substring.op4(documents(spark, rows).repartition(4)))
    assert len(rounds) == 1


def test_texts_without_an_id_are_told_apart(spark):
    rnd = random.Random(12)
    known = prose(rnd, 40)
    rows = [(1, known, "en", "s")] + [(None, f"{known} {prose(rnd, i % 30)}", "en", "s") for i in range(200)] + [(None, known, "en", "s")] * 50
    check(rows, substring.op4(documents(spark, rows)))


def test_factors_are_copies(spark):
    """Every factor's words stand in its reference, and its neighbours do not go on there."""
    rnd = random.Random(13)
    pool = [prose(rnd, n) for n in (20, 30, 45)]
    texts = {i: " ".join([prose(rnd, 6), rnd.choice(pool), prose(rnd, 4), rnd.choice(pool)]) for i in range(40)}
    got = substring.factors(documents(spark, [(i, t, "en", "s") for i, t in texts.items()])).collect()
    assert len(got) > 40
    for f in got:
        copied = " ".join(texts[f.id].split()[f.start : f.start + f.n + substring.WINDOW - 1])
        assert f.reference < f.id and f" {copied} " in f" {texts[f.reference]} "


def test_stage_with_clashing_columns(spark):
    rnd = random.Random(14)
    a = prose(rnd, 30)
    df = documents(spark, [(1, a, "en", "s"), (2, a + " tail", "en", "s")]).withColumns({c: F.lit("x") for c in ("__id", "__runs", "rlz_id", "rlz_runs", "rlz_kept", "start")})
    got = substring.cut_repeats(df)
    assert got.columns == df.columns and {r.doc_id: (r.text, r.rlz_kept) for r in got.collect()} == {1: (a, "x"), 2: ("tail", "x")}
