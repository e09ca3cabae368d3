import math
import time

import duckdb
import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft import catalog
from weft.functions import calc, html, markdown
from weft.functions.prose_json import balanced, from_prose


def test_json_in_prose(spark):
    cases = ['{"a": 1}', 'x\n```json\n{"b": 2}\n```\ny', 'pre {"a":"}"} post', "no json", "bad { then {\"c\": [1]}", None]
    got = [r.j for r in spark.createDataFrame([(c,) for c in cases], "t string").select(from_prose("t").alias("j")).collect()]
    assert got == ['{"a": 1}', '{"b": 2}', '{"a":"}"}', "{}", '{"c": [1]}', "{}"]


@given(st.dictionaries(st.text(max_size=5), st.text(max_size=8), max_size=3), st.text(alphabet="abc \n", max_size=10))
def test_balanced_finds_what_was_put_in(obj, around):
    import json

    assert json.loads(balanced(around + json.dumps(obj) + around)) == obj


@given(st.integers(-999, 999), st.integers(1, 99), st.sampled_from("+-*/%"))
def test_calculator_is_python(a, b, op):
    assert calc.evaluate(f"({a}) {op} {b}") == pytest.approx(float(eval(f"({a}) {op} {b}")))


def test_calculator_refuses():
    assert [calc.evaluate(x) for x in ("__import__('os')", "'a'", "1/0", "2 // 1", "9**99999999", "", None, "True")] == [None] * 8


def test_page_text_and_links():
    page = "<html><script>x<y</script><p> a &amp; <b>b</b> </p><a href='/1'> one </a><a>no</a><a href=2>two</a>"
    assert html.page_text(page) == "a &bonenotwo" and html.anchors(page) == ["one", "two"]
    assert html.page_text(None) == "" and html.readme("<article class='markdown-body entry-content'><h1>T</h1> t</article>") == "T\nt"
    assert html.readme("<div id=readme><p>no</p><article class=markdown-body>yes</article></div>") == "yes" and html.readme("<div itemprop=text>t</div>") == "t"
    assert html.readme("<div id=readme>x</div>") == "" == html.readme("<article class=markdown-body>x</article>")


def test_references_without_a_semicolon_are_text():
    page = "<title>a&amp;&amp</title><p>&copy; &copy &ampx; &#233;&#233 x&y</p><a href='?a=1&copy=2'>l&amp</a>"
    assert html.page_text(page) == "a&&amp© &copy &ampx; é&#233 x&yl&amp" and html.anchors(page) == ["l&amp"]
    assert next(html.tree(page).all("a")).attrs == {"href": "?a=1&copy=2"}


def test_long_pages_keep_their_whole_text(spark, tmp_path):
    pages = [(1, "<p>" + "ab &amp; c" * 1000 + "</p><p>end</p>"), (2, "<p>x</p>" * 2001), (3, "<p>é</p>" * 2000), (4, "")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in catalog.QUERIES["pa07_text"](spark, str(tmp_path)).collect()}
    assert got == {1: "ab & c" * 1000 + "end", 2: "x" * 2001, 3: "é" * 2000, 4: ""}
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(con.sql(catalog.ORACLE["pa07_text"]).fetchall())


def test_slides(spark):
    df = spark.createDataFrame([(1, "# T\n## sub\n\n## Sec\n- a\n\t- b\n1. one\n> q\n![x](p.png)\ntext\n---\nloose\n### Page\n# later")], "id int, body string")
    deck = sorted((tuple(r)[1:] for r in markdown.slide_rows(df, "id").collect()), key=repr)
    assert deck == [
        (0, None, "title", "T", "sub", None, None, None),
        (1, 0, "section", "Sec", "", "bullet", "a", 0),
        (1, 1, "section", "Sec", "", "bullet", "b", 1),
        (1, 2, "section", "Sec", "", "numbered", "one", None),
        (1, 3, "section", "Sec", "", "quote", "q", None),
        (1, 4, "section", "Sec", "", "image", "p.png", None),
        (1, 5, "section", "Sec", "", "paragraph", "text", None),
        (2, 0, "content", "", "", "paragraph", "loose", None),
        (3, 0, "content", "Page", "", "paragraph", "# later", None),
    ]


def test_slides_of_other_shapes(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "---\n***"), (4, "## a\n## b"), (5, "x\n# T\n---\n## s"), (6, "only"), (6, "only")], "id int, body string")
    got = sorted((tuple(r)[:5] for r in markdown.slide_rows(df, "id").collect()), key=repr)
    assert got == [(4, 0, None, "section", "a"), (4, 1, None, "section", "b"), (5, 0, 0, "content", ""), (5, 1, None, "title", "T"), (5, 2, None, "section", "s"), (6, 0, 0, "content", ""), (6, 0, 0, "content", "")]


def test_topic_round_trip(spark):
    entries = [{"date": "2024-01-01", "title": "t", "task": "a", "approach": "b", "lessons": "x\ny", "user_feedback": "", "user_adjustment": "z"}]
    df = spark.createDataFrame([(1, markdown.topic_text("T", entries))], "id int, body string")
    assert [{k: v for k, v in r.asDict().items() if k not in ("id", "pos")} for r in markdown.topic_rows(df, "id").collect()] == entries


def test_front_matter():
    assert markdown.front_matter("no") == ({}, "no")
    meta, body = markdown.front_matter("---\nname: n\ntotal: 3\n---\nbody\n")
    assert (meta, body) == ({"name": "n", "total": 3}, "body")
    with pytest.raises(ValueError):
        markdown.skill("---\nname: n\n---\nx")
    assert markdown.skill("---\nname: n\ntype: user\ndescription: d\n---\nx")["body"] == "x"


def test_profile_round_trip(spark):
    body = "# P\n## a\n- ⚠️ old\n- new\n\n## b\n* other"
    df = spark.createDataFrame([("u", body)], "user string, body string")
    rows = markdown.profile_rows(df, "user")
    assert [(r.category, r.content, r.stale, r.confidence) for r in rows.orderBy("pos").collect()] == [("a", "old", True, 0.5), ("a", "new", False, 1.0), ("b", "other", False, 1.0)]
    again = markdown.profile_rows(markdown.profile_text(rows, "user"), "user")
    assert again.exceptAll(rows).count() == 0 == rows.exceptAll(again).count()


def test_a_long_profile_is_read_line_by_line(spark):
    """Items of 100,000 lines; work that grows with their square takes many minutes."""
    body = "- lost\n## \n##  a \n" + "\n".join(f"- c{i}" if i % 3 else "x" for i in range(150_000)) + "\n##   \n- lost too\n## b\n* ⚠️ last"
    df = spark.createDataFrame([("u", body), ("u", "## a\n- one"), (None, None)], "user string, body string")
    began = time.monotonic()
    got = {(r.category, r.stale): (r.n, r.low, r.high) for r in markdown.profile_rows(df, "user").groupBy("category", "stale").agg(F.count("*").alias("n"), F.min("pos").alias("low"), F.max("pos").alias("high")).collect()}
    assert got == {("a", False): (100_001, 0, 99_999), ("b", True): (1, 100_000, 100_000)} and time.monotonic() - began < 120


def test_summary(spark):
    from weft.functions.text import summary

    df = spark.createDataFrame([("## 功能概述\n\nwhat it does\n## x",), ("y" * 300,)], "b string").select(F.length(summary("b")).alias("n"))
    assert [r.n for r in df.collect()] == [12, 200]


@given(st.lists(st.lists(st.sampled_from(["1", "2.5", "0", "03", "7.", ".5", "10", "123456789012345", "1e3", "x", "+", "-", "*", "/", "%", "**", "(", ")", " ", "//", "\0"]), min_size=1, max_size=7).map("".join), min_size=1, max_size=12))
def test_batches_equal_single_expressions(texts):
    texts = [*texts, *texts, *(t.replace("2.5", "3.25").replace("10", "0") for t in texts), None]
    got = calc.evaluate_all(pd.Series(texts, dtype=object))
    want = [calc.evaluate(t) for t in texts]
    assert [None if math.isnan(x) else repr(float(x)) for x in got] == [None if w is None or math.isnan(w) else repr(w) for w in want]
