import random
import re
import time

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from weft.llm import chat

DDL = "conv_id long, turn long, role string, text string, pos string, block string, names string"


def talk(rnd, n, marked=0.0):
    rows = []
    for c in range(n):
        for t in range(rnd.randint(1, 9)):
            role = "user" if t % 2 == 0 else "assistant"
            text = "ask " * rnd.randint(2, 12) + "?" if role == "user" else "say " * rnd.randint(30, 150)
            mark = rnd.choice([f"{role.title()}: ", f"### {role}\n", f"<|{role}|>", f"[{role}] "]) if rnd.random() < marked else ""
            rows.append((c, t, role, mark + text, "p", "b", "n"))
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return chat.train(spark.createDataFrame(talk(random.Random(1), 80), DDL))


def test_roles_come_back(spark, model):
    got = chat.parse(spark.createDataFrame(talk(random.Random(2), 60, 0.3), DDL), model).collect()
    assert sum(r.role == r.role_pred for r in got) / len(got) > 0.95


def test_blocks_equal_plain_viterbi(spark, model):
    rnd = random.Random(3)
    texts = [rnd.choice(["user: hi?", "x " * rnd.randint(1, 90), "", "one two ?"]) for _ in range(900)]
    df = spark.createDataFrame([(7, i, None, t, "p", "b", "n") for i, t in enumerate(texts)], DDL)
    emit = np.stack([model.score(chat.look(t, i == 0)) for i, t in enumerate(texts)])
    best = chat.trace(model.start, model.step, emit)
    got = [model.roles.index(r.role_pred) for r in chat.parse(df, model).orderBy("turn").collect()]
    score = lambda p: model.start[p[0]] + sum(emit[i, s] for i, s in enumerate(p)) + sum(model.step[a, b] for a, b in zip(p, p[1:], strict=False))
    assert len(got) == 900 and score(got) == pytest.approx(score(best), rel=1e-12)  # equally good paths may differ


def test_viterbi_equals_all_paths(model):
    import itertools

    rng = np.random.default_rng(4)
    emit = rng.normal(size=(6, len(model.roles)))
    best = max(itertools.product(range(len(model.roles)), repeat=6), key=lambda p: model.start[p[0]] + sum(emit[i, s] for i, s in enumerate(p)) + sum(model.step[a, b] for a, b in zip(p, p[1:], strict=False)))
    assert tuple(chat.trace(model.start, model.step, emit)) == best


@pytest.mark.parametrize(("text", "want"), [("User: hi", "<|user|>\nhi\n<|end|>"), ("### Assistant\nyes", "<|assistant|>\nyes\n<|end|>"), ("<|im_start|>system\nbe kind", "<|system|>\nbe kind\n<|end|>"), ("Note: this", "<|user|>\nNote: this\n<|end|>"), (None, "<|user|>\n\n<|end|>")])
def test_rendering(text, want):
    role = chat.marker(text or "")[0] or "user"
    assert chat.render(role, text) == want


def test_hard_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 1, "assistant", "y"), (None, None, None, None), (2, 10**9, "user", "z"), (2, -5, "system", "w"), (3, 0, "odd role", "v")]
    df = spark.createDataFrame([(*r, "p", "b", "n") for r in rows], DDL)
    got = chat.op9(df).collect()
    assert len(got) == len(rows) and all(r.role_pred and r.rendered for r in got)
    assert chat.op9(df.limit(0)).count() == 0
    unlabelled = chat.parse(df, chat.train(df.limit(0)))
    assert {r.role_pred for r in unlabelled.collect()} <= {"assistant", "system", "user"}


def test_large_ids_keep_apart_beside_nulls(spark):
    rows = [(2**60 + 1, 0, "user", "one"), (2**60 + 3, 0, "user", "two"), (None, 0, "user", "none"), (-1, 0, "user", "minus"), (2**60 + 1, None, "user", "zero")]
    df = spark.createDataFrame([(*r, "p", "b", "n") for r in rows], DDL).coalesce(1)
    got = {(r.conv_id, r.turn, r.rendered.split("\n")[1]) for r in chat.op9(df).collect()}
    assert got == {(r[0], r[1], r[3]) for r in rows}


def test_equal_turn_numbers_and_long_transcripts(spark):
    """One transcript over many blocks and partitions, with null and equal turn numbers; repeated rows stay."""
    rows = [(None, i // 900 if i % 3 else None, "user" if i % 2 else "assistant", f"line {i}") for i in range(1500)] + [(None, 1, "user", "same")] * 300
    df = spark.createDataFrame([(*r, "p", "b", "n") for r in rows], DDL)
    got = chat.op9(df).collect()
    said = sorted(r.rendered.split("\n")[1] for r in got)
    assert said == sorted(r[3] for r in rows) and all(r.conv_id is None for r in got)


def test_one_row_holds_a_transcript(spark, model):
    text = "User: is it four?\nplease say\n\nAssistant: yes\nAnswer: 4\nHuman: thanks\nNote: no marker"
    got = chat.parse(spark.createDataFrame([(1, 0, None, text, "p", "b", "n")], DDL), model).first()
    assert got.role_pred == "user"
    assert got.rendered == "<|user|>\nis it four?\nplease say\n<|end|>\n<|assistant|>\nyes\n4\n<|end|>\n<|user|>\nthanks\nNote: no marker\n<|end|>"


def test_counts_overrule_markers(spark):
    """Where assistants open with "User:", the counts say so."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "Q what ?" if t % 2 == 0 else "User: " + "say " * 40) for c in range(300) for t in range(4)]
    model = chat.train(spark.createDataFrame([(*r, "p", "b", "n") for r in rows], DDL))
    assert model.emit["marker=user"][model.roles.index("assistant")] > model.emit["marker=user"][model.roles.index("user")]


def test_counts_equal_brute_force(spark):
    from collections import Counter

    rows = talk(random.Random(9), 40, 0.3)
    model = chat.train(spark.createDataFrame(rows, DDL))
    step = Counter((a[2], b[2]) for a, b in zip(rows, rows[1:], strict=False) if a[0] == b[0])
    want = np.array([[1.0 + step[a, b] for b in model.roles] for a in model.roles])
    assert np.allclose(np.exp(model.step), want / want.sum(axis=1, keepdims=True))
    turns = Counter(r[2] for r in rows)
    asks = Counter(r[2] for r in rows if r[3].strip().endswith("?"))
    assert np.allclose(np.exp(model.emit["asks=True"]), [(1 + asks[r]) / (2 + turns[r]) for r in model.roles])


OLD = re.compile(r"\s*(?:<\|\s*(?:im_start\|>)?\s*([A-Za-z]+)\s*(?:\|>)?|\[\s*([A-Za-z]+)\s*\]\s*:?|#{1,6}\s*([A-Za-z]+)\s*:?[ \t]*(?:\n|$)|\**\s*([A-Za-z]+)\s*\**\s*(?:\(\d+\))?\s*:(?!/))")


@given(st.lists(st.sampled_from(["user", "User", "x", "bot", "**", "*", "#", "###", ":", "\n", " ", "\t", "[", "]", "<|", "|>", "im_start|>", "(2)", "/", "hi there"]), max_size=12))
def test_markers_are_those_of_the_plain_pattern(parts):
    """Against a pattern that may take back what it has read: the same roles and the same text after them."""
    text = "".join(parts)
    m = OLD.match(text)
    role, at = chat.marker(text)
    want = chat.NAMES.get(next(g for g in m.groups() if g).lower()) if m else None
    assert role == want and (not role or text[at:].strip() == text[m.end() :].strip())


@pytest.mark.parametrize("text", ["\n", " ", "\t", "a", "*", "#", "user\n", "a ", "*\n", "[", "<|", "#a ", "user:\n", "(1)", "# user \n\n"])
def test_a_megabyte_of_anything_takes_seconds(text):
    began = time.time()
    for end in ("", "x"):
        parts = chat.segments(text * (1_000_000 // len(text)) + end, ["user", "assistant", "system"])
        for p in parts[:1000]:
            chat.look(p, False)
    assert time.time() - began < 20
