import hashlib
import random
import re
import zlib
from collections import defaultdict

from weft.llm import prefix_trie

ROWS = "conv_id long, turn long, role string, text string, c long, d long, n long, mark string, node long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, 1, "m", 1) for r in rows], ROWS)


def brute(rows):
    own = defaultdict(list)
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + seq[h:])
    nodes = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    out = []
    for p, members in nodes.items():
        under = [(q, m) for q, m in nodes.items() if q[: len(p)] == p]
        kids = [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p]
        leaves = [q for q, _ in under if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in nodes)]
        saved = sum((len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q, m in under if q)
        stop = sorted(c for c in members if built[c] == p)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(",".join(map(str, stop)).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def some(rnd, n, most=7):
    text = ["a b", "c", "", None, "d e f", "g\th\ni"]
    return [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(text)) for c in n for t in range(rnd.randint(1, most))]


def test_random_conversations(spark):
    rows = some(random.Random(1), range(90))
    assert found(prefix_trie.op12(frame(spark, rows))) == brute(rows)


def test_hard_rows(spark):
    rnd = random.Random(2)
    rows = some(rnd, [*range(-25, 25, 3), 40, 41, 57])
    hot = [("user", "one two"), ("assistant", "three"), ("user", "four five six")]
    rows += [(1000 + 20 * i, t, *x) for i in range(30) for t, x in enumerate(hot)]  # a third of all are copies
    rows += [(7001, None, "user", "late"), (7001, 0, "user", "x"), (7001, 0, "user", "y"), (7001, 0, "user", "y"), (7001, None, None, None)]
    rows += [(None, 0, "user", "nobody"), (None, None, None, None), (7002, -3, "user", "word " * 50_000), (7003, 0, "", "")]
    rows += [(8000, t, "user", f"turn {t % 3}") for t in range(300)] + [(8001, t, "user", f"turn {t % 3}") for t in range(290)]
    assert found(prefix_trie.op12(frame(spark, rows))) == brute(rows)
    assert found(prefix_trie.op12(frame(spark, rows[::-1]))) == brute(rows)


def test_blocks_that_are_cut(spark, monkeypatch):
    rows = [(c, t, "user", f"{t % 5} {c if t > 60 else ''}") for c in (0, 20, 21, 40) for t in range(100)]
    monkeypatch.setattr(prefix_trie, "CUT", 2)
    monkeypatch.setattr(prefix_trie, "STEP", 8)
    assert found(prefix_trie.op12(frame(spark, rows))) == brute(rows)


def test_turnless(spark):
    rows = [(c, 0, "user", "x") for c in range(1, 12)]  # no conversation 0 to borrow from
    want = brute(rows)
    assert found(prefix_trie.op12(frame(spark, rows))) == want and any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in want)
    alone = [(2, 0, "user", "x")]
    assert found(prefix_trie.op12(frame(spark, alone))) == brute(alone)


def test_empty(spark):
    got = prefix_trie.op12(frame(spark, []).limit(0))
    assert got.columns == prefix_trie.NODE and found(got) == []
    assert found(prefix_trie.op12(frame(spark, [(None, 1, "user", "x")]))) == []
