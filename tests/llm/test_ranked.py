import math
import random
import re
from collections import Counter

from conftest import documents, hard_rows, prose

from weft.llm import ranked_search

ITEMS = "item_id long, text string, item long, terms string, n long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    """Every document scored for every item."""
    texts = [(d, t) for d, text in docs if (t := terms(text))]
    nn, ll = len(texts), sum(len(t) for _, t in texts)
    df = Counter(x for _, t in texts for x in set(t))
    out = []
    for item, text in items:
        asked = terms(text)
        scored = []
        for d, t in texts:
            tf, m = Counter(t), 25 + (75 * len(t) * nn) // ll
            s = sum(math.floor(1000 * math.log((2 * nn + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * tf[x]) // (1000 * tf[x] + 8 * m)) for x in asked if tf[x])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def bench(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", 1) for r in rows], ITEMS)


def both(spark, docs, items):
    got = ranked_search.op13(documents(spark, [(d, t, "en", "s") for d, t in docs]), bench(spark, items))
    assert found(got) == brute(docs, items)


def test_hard_rows(spark):
    docs = [r[:2] for r in hard_rows()]
    words = docs[0][1].split()
    items = [(0, " ".join(words[:20])), (1, "Alpha1 ALPHA2, alpha2-beta3!"), (2, None), (3, ""), (4, "中文 ÜNÏCODE Ünïcode naïve"), (None, " ".join(words[30:40])), (5, "nowhere"), (6, " ".join(words) * 5), (7, "two"), (8, "word_two")]
    both(spark, docs, items)


def test_random_with_ties(spark):
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rnd.choices(vocabulary, [1 / (i + 1) for i in range(40)], k=n))
    docs = [(rnd.randrange(10**6), text(rnd.randint(1, 60))) for _ in range(500)] + [(i, "w1 w2 w39") for i in range(250)]
    both(spark, docs, [(i, text(rnd.randint(1, 30))) for i in range(25)])


def test_more_blocks_change_nothing(spark, monkeypatch):
    rnd = random.Random(4)
    docs = [(i, prose(rnd, 40)) for i in range(200)]
    items = [(i, prose(rnd, 15)) for i in range(12)]
    for name, value in (("DOCS", 30), ("POSTINGS", 500), ("TERMS", 20), ("STEP", 1), ("BITS", 1 << 15)):
        monkeypatch.setattr(ranked_search, name, value)
    both(spark, docs, items)


def test_stops_early(spark):
    """On a shard whose best documents lead every list, few documents are scored."""
    import pyarrow as pa

    n = 5000
    table = pa.table({"doc_id": list(range(n)), "n": [10] * 50 + [400] * (n - 50), "terms": pa.array([[b"a", b"b"]] * n, pa.list_(pa.binary())), "tfs": [[5, 5]] * 50 + [[1, 1]] * (n - 50)})
    shard = ranked_search.Shard(table, {b"a": 0, b"b": 1}, n, sum(table.column("n").to_pylist()))
    scored = []
    plain = shard.scores
    shard.scores = lambda docs: scored.append(len(docs)) or plain(docs)
    docs, _ = shard.top(ranked_search.np.array([0, 1]), ranked_search.np.array([3, 4]), 10)
    assert sorted(docs) == list(range(10)) and sum(scored) < n / 10


def test_empty(spark, empty):
    items = bench(spark, [(1, "alpha")])
    assert found(ranked_search.op13(empty, items)) == []
    assert found(ranked_search.op13(documents(spark, [(1, "alpha", "en", "s")]), items.limit(0))) == []
    assert found(ranked_search.op13(documents(spark, [(1, None, "en", "s"), (2, "..", "en", "s")]), items)) == []
