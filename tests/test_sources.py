from weft.operators.policy import Policy
from weft.sources import files, repositories, stores


def test_files(spark, tmp_path):
    p = str(tmp_path / "d" / "a.txt")
    assert files.read_file(spark, p).startswith("error: no such file")
    files.write_file(spark, p, "héllo")
    files.append_file(spark, p, "!")
    assert files.read_file(spark, p) == "héllo!" and files.kind(spark, p) == "file"
    (tmp_path / "d" / "bad").write_bytes(b"\xff\xfe")
    (tmp_path / "d" / "sub").mkdir()
    assert "not UTF-8" in files.read_file(spark, str(tmp_path / "d" / "bad"))
    assert files.read_file(spark, str(tmp_path / "d")).startswith("error: not a file")
    got = files.list_directory(spark, str(tmp_path / "d"))
    assert [(r.name, r.is_dir, r.size) for r in got.where("name not like '.%'").collect()] == [("a.txt", False, 7), ("bad", False, 2), ("sub", True, None)]
    assert files.delete(spark, str(tmp_path / "d")) and files.kind(spark, p) == "none"


def test_sessions_round_trip(spark, tmp_path):
    rows = [("s", i, "user", f"t{i}", "user_input", i + 1) for i in range(3)] + [("z", 0, "user", "x" * 150, "user_input", 1)]
    df = spark.createDataFrame(rows, "session_id string, pos int, role string, text string, message_type string, turn_index int")
    stores.write_sessions(df, str(tmp_path / "s"))
    back = stores.read_sessions(spark, str(tmp_path / "s"))
    assert sorted((r.session_id, r.pos, r.text) for r in back.collect()) == sorted((r[0], r[1], r[3]) for r in rows)
    assert {r.session_id: len(r.preview) for r in stores.list_sessions(spark, str(tmp_path / "s")).collect()} == {"s": 2, "z": 100}


def test_memory_stores(spark, tmp_path):
    topics = spark.createDataFrame([("s", "T")], "slug string, title string")
    ent = spark.createDataFrame([("s", 0, "2024-01-01", "t", "a", "b", "x\ny", "", "")], "slug string, pos int, date string, title string, task string, approach string, lessons string, user_feedback string, user_adjustment string")
    stores.write_topics(topics, ent, str(tmp_path / "t"))
    assert stores.read_topics(spark, str(tmp_path / "t")).select(*ent.columns).exceptAll(ent).count() == 0
    stay, gone = stores.archive_entry(ent, "s", 0)
    assert (stay.count(), gone.count()) == (0, 1)
    assert stores.read_index(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "x.json").write_text('{"slug": "s", "pos": 1}\nbroken')
    assert stores.read_index(spark, str(tmp_path / "i")).count() == 1


def test_configuration(tmp_path):
    (tmp_path / "p.yaml").write_text("policies:\n  - subject: '*'\n    action: 'read_*'\n    resource: '*'\n    effect: allow\n  - action: x\n")
    assert stores.load_policies(str(tmp_path / "p.yaml")) == [Policy("*", "read_*", "*", "allow"), Policy("*", "x", "*", "deny")]
    assert stores.load_policies(str(tmp_path / "none")) == [] and stores.load_session_config(str(tmp_path / "none")).keep_recent_turns == 3
    (tmp_path / "m.json").write_text('{"mcpServers": {"a": {"command": "x"}, "b": {"url": "u"}, "c": {}}}')
    assert set(stores.load_servers(str(tmp_path / "m.json"))) == {"a", "b"}
    (tmp_path / "hi.txt").write_text("hello {name}")
    p = stores.Prompts(str(tmp_path), {"b": "built"})
    assert p.fill("hi", name="x") == "hello x" and "warning" in p.fill("hi") and p.load("b") == "built"


def test_repository_requests(spark):
    df = spark.createDataFrame([("https://github.com/a/b, bad ,https://github.com/a/b,",)], "urls string")
    got = repositories.requested(df)
    assert [(r.pos, r.url, r.valid) for r in got.orderBy("pos").collect()] == [(1, "https://github.com/a/b", True), (2, "bad", False)]
    pages = spark.createDataFrame([("https://github.com/a/b", "<div id='readme'><article class='markdown-body'>" + "x" * 9000 + "</article></div>")], "url string, html string")
    assert {r.url: (r.ok, len(r.text or "")) for r in repositories.readmes(got, pages).collect()} == {"https://github.com/a/b": (True, 8000), "bad": (False, 0)}
