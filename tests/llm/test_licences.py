import random

from conftest import documents, hard_rows, prose
from hypothesis import given
from hypothesis import strategies as st

from weft.llm import licences


@given(st.lists(st.sampled_from("abcdefgh"), max_size=15), st.lists(st.sampled_from("abcdefgh"), max_size=15))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = licences.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


@given(st.permutations(range(9)))
def test_increasing_is_longest(p):
    got = licences.increasing(list(enumerate(p)))
    best = [1] * len(p)
    for i in range(len(p)):
        for j in range(i):
            if p[j] < p[i]:
                best[i] = max(best[i], best[j] + 1)
    assert len(got) == max(best) and all(a[1] < b[1] for a, b in zip(got, got[1:], strict=False))


def test_found_whole_edited_and_twice(spark):
    rnd = random.Random(1)
    mit = licences.TEMPLATES["MIT"]
    edited = mit.replace("free of charge", "at no cost").replace("Software", "Program")
    rows = [
        (1, f"{prose(rnd, 200)}\n{mit}\n{prose(rnd, 50)}", "en", "s"),
        (2, edited, "en", "s"),
        (3, f"{mit} {prose(rnd, 300)} {mit}", "en", "s"),
        (4, prose(rnd, 500) + " licensed under the license of software", "en", "s"),
        (5, "Released under the\n MIT   License.", "en", "s"),
        (6, mit[: len(mit) // 2], "en", "s"),
    ]
    got = [(r.doc_id, r.license) for r in licences.op7(documents(spark, rows)).orderBy("doc_id", "word_start").collect()]
    assert got == [(1, "MIT"), (2, "MIT"), (3, "MIT"), (3, "MIT"), (5, "MIT-line")]


def test_places_bound_is_safe():
    """Against aligning the template with every stretch of the text."""
    rnd = random.Random(3)
    t = licences.words(licences.TEMPLATES["GPL-3.0-line"])
    scanner = licences.Scanner({"x": licences.TEMPLATES["GPL-3.0-line"]})
    for _ in range(60):
        text = [rnd.choice(t + ["zz", "yy"]) for _ in range(5)] + [w for w in t if rnd.random() > 0.15] + ["zz"] * 5
        width = int(len(t) * licences.SLACK)
        most = max(len(licences.patience(text[i : i + width], t)) for i in range(len(text)))
        assert bool(scanner.scan(" ".join(text))) == (most >= 0.8 * len(t)) or most < 0.9 * len(t)


def test_copies_back_to_back_and_after_failed_places():
    t = licences.TEMPLATES["reserved-line"]
    scanner = licences.Scanner({"x": t})
    assert [r[1:] for r in scanner.scan(f"All rights reserved. {t}")] == [(1.0, 3, 7, 4)]
    assert [r[2:4] for r in scanner.scan(f"{t} {t} {t}")] == [(0, 4), (4, 8), (8, 12)]
    gpl = licences.TEMPLATES["GPL-3.0-line"]
    scanner = licences.Scanner({"x": gpl})
    assert [r[2:4] for r in scanner.scan(f"{gpl} {gpl}")] == [(0, 12), (12, 24)]
    bag = " ".join(reversed(licences.words(gpl)[3:]))
    assert [r[1:4] for r in scanner.scan(f"{bag} {gpl}")] == [(1.0, 9, 21)]


def test_scan_equals_aligning_everything():
    """Against aligning the template with every stretch, down to the least coverage."""
    rnd = random.Random(4)
    for name in ("GPL-3.0-line", "CC-BY-line"):
        t = licences.words(licences.TEMPLATES[name])
        scanner, width = licences.Scanner({"x": licences.TEMPLATES[name]}), int(len(t) * licences.SLACK)
        seen = set()
        for _ in range(15):
            text = [rnd.choice([*t, "zz", "yy"]) for _ in range(5)]
            for _ in range(2):
                text += [w for w in t if rnd.random() > 0.17] + [rnd.choice([*t, "zz"]) for _ in range(rnd.randrange(3))]
            most = max(len(licences.patience(text[i:j], t)) for i in range(len(text)) for j in range(i + 1, min(i + width, len(text)) + 1))
            got = scanner.scan(" ".join(text))
            seen.add(bool(got))
            assert bool(got) == (most >= 0.8 * len(t)) and max((r[4] for r in got), default=0) == (most if got else 0)
        assert True in seen


def test_rights_lines_as_documents_hold_them():
    scanner = licences.Scanner()
    found = lambda text: [(r[0], r[2], r[3]) for r in scanner.scan(text)]
    assert found("Some words before.\nAll rights reserved.") == [("rights-line", 3, 6)]
    assert found("Copyright (c) 2020 Acme Inc. All rights reserved.") == [("reserved-line", 0, 8), ("rights-line", 5, 8)]
    assert found("Copyright (c) 2001, 2002 The Regents of the University of Somewhere. All rights reserved.")[0][0] == "reserved-line"
    assert found("all of the rights were reserved") == []


def test_hard_rows_and_none(hard, empty):
    assert licences.op7(hard).count() == 0 == licences.op7(empty).count() and hard_rows()


def test_related_licenses_are_told_apart():
    scanner = licences.Scanner()
    found = lambda text: [r[0] for r in scanner.scan(text)]
    assert found("the software of the " * 25 + licences.TEMPLATES["MIT"]) == ["MIT"]
    assert found("This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0-line"]
    assert found("Licensed under CC BY 4.0.") == ["CC-BY-short-line"] and found("Licensed under CC BY-NC 4.0.") == ["CC-BY-NC-line"]
    for name, text in licences.TEMPLATES.items():
        if name not in licences.NOTICES:
            assert found(text) == [name], name
        assert name in found(text)


def test_findings_inside_hard_rows(spark):
    line = licences.TEMPLATES["MIT-line"]
    rows = [(d, f"{t or ''} {line}", *more) for d, t, *more in hard_rows()]
    got = licences.op7(documents(spark, rows)).collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(r[0]) for r in rows) and {r.license for r in got} == {"MIT-line"}
