import random
import time

from pyspark.sql import functions as F

from weft import catalog
from weft.functions.text import char_jaccard, days_since, keyword_match, memory_keywords, task_keywords
from weft.operators import memory

AS_OF = "2024-12-31T00:00:00Z"


def test_keywords(spark):
    df = spark.createDataFrame([("数据分析 Py py3 the THE a",), (None,)], "t string")
    rows = df.select(memory_keywords("t").alias("m"), task_keywords("t").alias("k")).collect()
    assert rows[0].m == ["数据分析", "the", "the"]
    assert set(rows[0].k) == {"数据", "据分", "分析", "py", "py3", "the"} and rows[1].m == [] == rows[1].k


def test_similarity_and_dates(spark):
    one = spark.range(1).select(char_jaccard(F.lit("abc"), F.lit("abd")).alias("a"), char_jaccard(F.lit(""), F.lit("a")).alias("b"), days_since(F.lit("2024-01-01"), AS_OF).alias("c"), days_since(F.lit("2024-01-01"), AS_OF, 999.0).alias("d"), days_since(F.lit("2024-12-01T00:00:00Z"), AS_OF).alias("e")).first()
    assert (one.a, one.b, one.c, one.d, one.e) == (0.5, 0.0, 365.0, 999.0, 30.0)


def test_profile_merge_is_sequential(spark):
    items = spark.createDataFrame([("c", 0, "likes tea", "x", True), ("c", 1, "tea", "x", False)], "category string, pos long, content string, updated_at string, stale boolean")
    inc = spark.createDataFrame([(0, "c", "tea"), (1, "c", "likes tea and milk"), (2, None, "new"), (3, "c", "")], "seq long, category string, content string")
    got = {(r.category, r.pos): (r.content, r.stale) for r in memory.merge_profile(items, inc, AS_OF).collect()}
    # the first item that contains "tea" takes it; the next increment then contains that item
    assert got == {("c", 0): ("likes tea and milk", False), ("c", 1): ("tea", False), ("其他", 0): ("new", False)}


def test_topic_merge(spark):
    ent = spark.createDataFrame([("s", i, t, "old", "2024-12-30T00:00:00Z" if i else "2024-01-01T00:00:00Z") for i, t in enumerate(["abcdefgh", "xyz", "qrs"])], "slug string, pos long, title string, task string, date string")
    inc = spark.createDataFrame([("s", "abcdefgh!", "new"), ("t", "fresh", "new")], "slug string, title string, task string")
    got = {(r.slug, r.pos): (r.title, r.task) for r in memory.merge_topics(ent, inc, AS_OF).collect()}
    assert got == {("s", 0): ("abcdefgh", "new"), ("s", 1): ("xyz", "old"), ("s", 2): ("qrs", "old"), ("t", 0): ("fresh", "new")}


def test_profile_budget(spark):
    rows = [("u", 0, "a", 0, "x" * 10, False), ("u", 0, "a", 1, "x" * 90, False), ("u", 0, "a", 2, "y", False), ("u", 1, "b", 0, "zz", True)]
    df = spark.createDataFrame(rows, "user string, cat_pos int, category string, pos int, content string, stale boolean")
    got = memory.profile_block(df, 60).first().block.split("\n")
    assert got == ["## a", "- " + "x" * 10, "- (...更多偏好已省略)", "## b", "- ⚠️ [可能已过时] zz"]


def _plain_merge(items, increments):
    """One category: (content, stale) after increments, comparing all pairs."""
    kept = [[c, s] for c, s in items]
    for x in increments:
        if x:
            hit = next((k for k in kept if k[0] is not None and (x in k[0] or k[0] in x)), None)
            if hit:
                hit[:] = [x, False]
            else:
                kept.append([x, False])
    return kept


def test_profile_merge_equals_the_plain_fold(spark):
    rnd = random.Random(2)
    text = lambda: "".join(rnd.choice("ab ") for _ in range(rnd.choice([0, 1, 3, 5, 9, 70])))
    base = ["".join(rnd.choice("abcdefgh") for _ in range(90)) for _ in range(6)]
    some = lambda: rnd.choice([text(), base[rnd.randrange(6)], base[rnd.randrange(6)][rnd.randrange(9) : rnd.randrange(60, 90)]])
    want, old, new = {}, [], []
    for c in "wxyz":
        items, more = [(some(), rnd.random() < 0.5) for _ in range(8)], [some() for _ in range(40)]
        items.append((None, True))
        old += [(c, i, t, "2024-01-01", s) for i, (t, s) in enumerate(items)]
        new += [(i, c, t) for i, t in enumerate(more)]
        want[c] = _plain_merge(items, more)
    got = memory.merge_profile(spark.createDataFrame(old, "category string, pos long, content string, updated_at string, stale boolean"), spark.createDataFrame(new, "seq long, category string, content string"), "2025-01-01").orderBy("category", "pos").collect()
    assert {c: [[r.content, r.stale] for r in got if r.category == c] for c in "wxyz"} == want


def test_profile_merge_query_takes_whole_texts_and_categories(spark, sf):
    groups = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        groups.setdefault("-".join(x for x in (r.source, r.lang) if x is not None), []).append(r)
    want = {c: _plain_merge([(r.text, False) for r in rs if r.doc_id % 2 == 0], [r.text for r in rs if r.doc_id % 2]) for c, rs in groups.items()}
    got = {}
    for r in catalog.QUERIES["mg01_profile_merge"](spark, sf).orderBy("category", "pos").collect():
        got.setdefault(r.category, []).append([r.content, r.stale])
    assert got == want


def test_profile_block_query_has_one_block_a_user(spark, sf):
    users = [r.user for r in catalog.QUERIES["wn04_profile_block"](spark, sf).collect()]
    assert sorted(users) == sorted(r.source for r in spark.read.parquet(f"{sf}/documents.parquet").select("source").distinct().collect())


def test_search_scores_a_text_once_and_as_its_keywords_say(spark):
    """The plan holds the patterns once; a title that only begins the text's first word counts as a word of its own."""
    rnd = random.Random(4)
    some = lambda: "".join(rnd.choice(["the", "thing", "nat", "ion", "hat", "x", "T", " ", " ", "\n", "_", "是", "国家"]) for _ in range(rnd.randrange(8)))
    rows = [("s", i, t, x, "2024-12-30T00:00:00Z") for i in range(150) for x in [some()] for t in [rnd.choice([some(), x[:3], x.split("\n")[0], x])]]
    rows += [("s", 150, "nat", "nationx", "2024-12-30T00:00:00Z"), ("s", 151, None, "nat", "2024-12-30T00:00:00Z"), ("s", 152, "nat", None, "2024-12-30T00:00:00Z")]
    entries = spark.createDataFrame(rows, "slug string, pos long, title string, text string, date string")
    topics = spark.createDataFrame([("s", 0, "s", [])], "slug string, topic_pos long, title string, keywords array<string>")
    for query in ("the thing nation", "国家 that"):
        got = memory.search(topics, entries, query, AS_OF, 1000)
        words = memory_keywords(F.concat_ws(" ", "title", "text"))
        want = entries.select("pos", keyword_match(memory_keywords(F.lit(query)), words).alias("m")).where("m > 0")
        assert {r.pos: round(r.raw, 9) for r in got.collect()} == {r.pos: round(0.7 * r.m * 0.5 ** (1 / 30), 9) for r in want.collect()}
        assert got._jdf.queryExecution().optimizedPlan().toString().count("thin|" if "thing" in query else "hat|") == 1


def test_related_equals_all_pairs(monkeypatch):
    """In blocks of any size: pieces of each other, near copies, repeated letters, wide characters, empty and null."""
    for seed in range(60):
        rnd = random.Random(seed)
        monkeypatch.setattr(memory, "BLOCK_CHARS", rnd.choice([7, 64, 1000, 1 << 20]))
        monkeypatch.setattr(memory, "MOST_AT_ONCE", rnd.choice([1, 5, 1 << 22]))
        letters = rnd.choice(["a", "ab", "abc😀是", "abcdefgh "])
        base = ["".join(rnd.choice(letters) for _ in range(rnd.choice([1, 5, 90, 300]))) for _ in range(4)]
        cut = lambda x: x[rnd.randrange(len(x)) :][: rnd.randrange(len(x) + 1)]
        texts = list(dict.fromkeys([None, ""][seed % 3 :] + [cut(rnd.choice(base)) + rnd.choice(["", "", "a", "b"]) for _ in range(40)]))
        starts, others = memory.related(texts)
        for i, x in enumerate(texts):
            want = {j for j, y in enumerate(texts) if x is not None and y is not None and (x in y or y in x)}
            assert set(others[starts[i] : starts[i + 1]].tolist()) == want


def test_related_takes_little_time_a_character():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(5000)]
    texts = [" ".join(rnd.choices(words, k=720)) for _ in range(3000)]  # twelve million characters
    texts += [x[5:n] for x, n in zip(texts, (9, 20, 40, 80, 500), strict=False)]
    began = time.process_time()
    starts, others = memory.related(texts)
    assert time.process_time() - began < 8
    assert all(3000 + i in others[starts[i] : starts[i + 1]] for i in range(5))
