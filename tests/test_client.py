import io
import zipfile
from xml.dom import minidom

import pytest

from weft.client import Client
from weft.functions.markdown import slide_rows
from weft.sources import deck


def test_a_conversation(spark, tmp_path):
    c = Client(spark, str(tmp_path), lambda ms: f"{len(ms)} so far")
    s = c.create("first")
    assert c.create("first") == s and c.load(s).count() == 0
    assert [c.send(s, "hi"), c.send(s, "again")] == ["1 so far", "3 so far"]
    assert [r.text for r in c.load(s).orderBy("pos").collect()] == ["hi", "1 so far", "again", "3 so far"]
    assert [(r.session_id, r.preview) for r in c.list().collect()] == [(s, "hi")]
    with pytest.raises(ValueError):
        c.send(s, "x" * 10_001)
    assert c.delete(s)
    with pytest.raises(KeyError):
        c.load(s)


def test_decks(spark):
    df = spark.createDataFrame([(1, "# T & co\n## sub\n## S\n### P\n- a <b>\n- c"), (2, "just text")], "id long, body string")
    rows = slide_rows(df, "id")
    made = {r.id: r for r in deck.decks(rows, "id").collect()}
    z = zipfile.ZipFile(io.BytesIO(made[1].deck))
    for name in z.namelist():
        minidom.parseString(z.read(name))
    assert sum(n.startswith("ppt/slides/slide") for n in z.namelist()) == 3 and b"a &lt;b&gt;" in z.read("ppt/slides/slide3.xml")
    assert {r.id: (r.slides, r.title, r.section, r.content) for r in deck.slide_counts(rows, "id").collect()} == {1: (3, 1, 1, 1), 2: (1, 0, 0, 1)}


def test_many_decks_are_made_a_few_at_once(spark, monkeypatch):
    monkeypatch.setattr(deck, "AT_ONCE", 2)
    rows = slide_rows(spark.createDataFrame([(i, "# a\n### page\n- one") for i in range(7)], "id long, body string").coalesce(1), "id")
    assert sorted((r.id, r["size"] == len(r.deck) > 0) for r in deck.decks(rows, "id").collect()) == [(i, True) for i in range(7)]
