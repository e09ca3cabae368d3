import random

import numpy as np
import pyarrow as pa
from brute import components, fingerprint
from conftest import documents, hard_rows, prose
from pyspark.sql import functions as F

from weft.llm import near_dup
from weft.llm.components import components as connect


def check(rows, got):
    prints = [fingerprint(t) for _, t, *_ in rows]
    want = sorted((repr(r[0]), f"{p:016x}", repr(c)) for r, p, c in zip(rows, prints, components([r[0] for r in rows], prints), strict=True))
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in got.collect()) == want


def test_hard_rows(hard):
    check(hard_rows(), near_dup.op3(hard))


def test_empty(empty):
    assert near_dup.op3(empty).count() == 0


def test_golay_code_is_perfect():
    code = near_dup._golay()
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 1 << 23, 2000)
    index = near_dup.decode(x, code)
    word = x ^ code[1][code[0][x >> 11] ^ (x & 0x7FF)]
    assert (np.bitwise_count(x ^ word) <= 3).all() and (word >> 11 == index).all()
    near = x ^ (1 << rnd.integers(0, 23, 2000))
    flips = np.array([0] + [1 << i for i in range(23)])
    assert all(set(near_dup.decode(a ^ flips, code)) & set(near_dup.decode(b ^ flips, code)) for a, b in zip(x, near, strict=True))


def test_no_link_is_lost(spark):
    """All pairs at every distance up to three share a key, and the components agree."""
    rnd = random.Random(3)
    prints = [0, (1 << 64) - 1]
    for _ in range(150):
        p = rnd.getrandbits(64)
        prints.append(p)
        for _ in range(rnd.randint(0, 4)):
            p ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4)))
            prints.append(p)
    ids = rnd.sample(range(10_000), len(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(zip(ids, signed, strict=True)), "doc_id long, fp long")
    got = {r.fp: r.component_id for r in near_dup.group(df).collect()}
    assert [got[s] for s in signed] == components(ids, prints)


def test_large_buckets_are_dealt_out_again(spark):
    """One segment is the same in all fingerprints, so its buckets are large; the components agree with brute force."""
    rnd = random.Random(4)
    prints = []
    for _ in range(300):
        p = rnd.getrandbits(25)
        prints.append(p)
        for _ in range(rnd.randint(0, 3)):
            p ^= sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4)))
            prints.append(p)
    prints = sorted(set(prints))
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long").repartition(3)
    got = {r.node % (1 << 64): r.component for r in connect(near_dup.links(df, most=6)).collect()}
    want = components(list(range(len(prints))), prints)
    together = {}
    for p, c in zip(prints, want, strict=True):
        together.setdefault(c, set()).add(got.get(p, p))
    assert all(len(x) == 1 for x in together.values())
    assert len(set().union(*together.values())) == len(together)


def test_buckets_come_whole_or_back():
    """A sorted stream in small batches: runs up to the bound are linked, larger ones come back whole."""
    rnd = np.random.default_rng(6)
    k = np.sort(np.concatenate([rnd.integers(0, 50, 400), np.full(900, 20), np.full(700, 50)]))
    fp = rnd.permutation(len(k)).astype(np.int64) << 20
    batches = [pa.RecordBatch.from_arrays([pa.array(k[i : i + 90]), pa.array(fp[i : i + 90])], ["k", "fp"]) for i in range(0, len(k), 90)]
    for pool in (100, 500, 10_000):
        near_dup.POOL, before = pool, near_dup.POOL
        try:
            out = pa.Table.from_batches(list(near_dup._link(300)(iter(batches))))
        finally:
            near_dup.POOL = before
        back = [(u, v) for large, u, v in zip(*(c.to_pylist() for c in out.columns), strict=True) if large]
        assert sorted(back) == sorted((a, b) for a, b in zip(k.tolist(), fp.tolist(), strict=True) if a in (20, 50))


def test_forest_of_a_large_group():
    rnd = np.random.default_rng(2)
    fp = np.unique(np.uint64(77) ^ (np.uint64(1) << rnd.integers(0, 64, 500).astype(np.uint64)))
    edges = near_dup.forest(fp.view(np.int64))
    assert sum(len(b) for _, b in edges) == len(fp) - 1


def test_long_chains_connect(spark):
    n = 700
    order = list(range(n))
    random.Random(1).shuffle(order)
    df = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:], strict=False)] + [(5000, 5001), (5001, 5001), (None, 3)], "u long, v long")
    got = {r.node: r.component for r in connect(df).collect()}
    assert got == dict.fromkeys(range(n), 0) | {5000: 5000, 5001: 5000}


def test_stage_keeps_one_of_each_group(hard):
    rows = near_dup.keep_one(hard)
    assert rows.columns == hard.columns
    ids = [r.doc_id for r in rows.collect()]
    known = sorted(i for i in ids if i is not None)
    assert known == sorted(set(known)) and 1 in known and 2 not in known and ids.count(None) == 2


def test_stage_picks_one_version_of_an_id(spark):
    rows = [(1, "a b c d e f", "en", "s"), (1, "u v w x y z", "en", "s"), (2, "k l m n o p", "en", "s"), (None, "a b c d e f", "en", "s")]
    df = documents(spark, rows).withColumn("dup_first", F.lit("x"))
    first, again = (sorted((repr(r.doc_id), r.text) for r in near_dup.keep_one(d).collect()) for d in (df, df.repartition(3)))
    assert first == again and len(first) == 3 and near_dup.keep_one(df).columns == df.columns
    kept = df.where("doc_id = 1").orderBy(F.xxhash64("text")).first().text
    assert ("1", kept) in first


def texts_kept(df):
    return sorted((r.doc_id, r.text) for r in near_dup.keep_one(df).collect())


def test_versions_lose_no_text(spark):
    rnd = random.Random(8)
    a, own = prose(rnd, 60), [prose(rnd, 60) for _ in range(20)]
    rows = [(3, a)] + [(5 + i, t) for i, b in enumerate(own) for t in (a, b)]
    assert texts_kept(documents(spark, [(*r, "en", "s") for r in rows])) == [(3, a)] + [(5 + i, b) for i, b in enumerate(own)]
    # the smallest id stays with one of its texts, so the other one's copy stays too
    x, y = sorted((prose(rnd, 60), prose(rnd, 60)), key=lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0])
    rows = [(1, x), (1, y), (9, y), (9, y), (10, y)]
    assert texts_kept(documents(spark, [(*r, "en", "s") for r in rows])) == [(1, x), (9, y)]


def test_stage_equals_brute_force_on_versions(spark):
    rnd = random.Random(9)
    texts = [prose(rnd, 50) for _ in range(25)]
    rows = [(rnd.randrange(40), rnd.choice(texts)) for _ in range(90)]
    mark = {r.t: r.m for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("m")).collect()}
    open_, want = {t: {d for d, x in rows if x == t} for t in texts if any(x == t for _, x in rows)}, {}
    while open_ := {t: s for t, ds in open_.items() if t not in want.values() and (s := ds - want.keys())}:
        leads = {}
        for t, ds in open_.items():
            leads.setdefault(min(ds), []).append(t)
        want |= {d: min(ts, key=mark.get) for d, ts in leads.items()}
    assert texts_kept(documents(spark, [(*r, "en", "s") for r in rows])) == sorted(want.items())


def test_long_chains_need_no_round_limit(spark):
    n = 3000
    edges = spark.range(n).select((F.col("id") * 7919 % n).alias("u")).select("u", (F.col("u") + 1).alias("v")).repartition(13)
    got = connect(edges).collect()
    assert len(got) == n + 1 and {r.component for r in got} == {0}
