import time

import pytest

from weft.llm import html_extract as h

ARTICLE = "<h1>Title here</h1><p>First paragraph, with <b>bold</b> &amp; more   words\n in it &lt;ok&gt;.</p><p>Short.</p><ul><li>one item</li><li>two items</li></ul>"
WANT = "Title here\nFirst paragraph, with bold & more words in it <ok>.\nShort.\none item\ntwo items"
LONG = "this text is long enough to look like an article's paragraph, but nobody should take it for one at all " * 2
PARTS = {
    "nav": '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>',
    "header": '<header class="site-header"><p>Site name</p><nav><a href="/x">x</a></nav></header>',
    "footer": f'<footer><p>&copy; 2024 someone</p><p>{LONG}</p></footer>',
    "ad": f'<div class="ad">Buy now. {LONG}</div>',
    "notice": f'<div class="cookie-notice"><p>We use cookies. {LONG}</p></div>',
    "sidebar": f'<aside class="sidebar"><h3>Popular</h3><p>{LONG}</p></aside>',
    "comments": f'<section class="comments"><h2>Comments</h2><div class="comment"><p>{LONG}</p></div><div class="comment"><p>ok</p></div></section>',
    "form": f'<form><p>{LONG}</p><input><button>Go</button></form>',
    "script": f'<script>var a = "</p><p>{LONG}";</script><style>p{{x:y}}</style><!-- <p>{LONG}</p> --><noscript>{LONG}</noscript>',
}


@pytest.fixture(scope="module")
def model():
    return h.trained()


@pytest.mark.parametrize("part", PARTS)
@pytest.mark.parametrize("frame", ["<article>{}</article>", '<main><article class="post">{}</article></main>', '<div class="content">{}</div>'])
def test_boilerplate_goes(model, part, frame):
    for page in (PARTS[part] + frame.format(ARTICLE), frame.format(ARTICLE) + PARTS[part], frame.format(ARTICLE + PARTS[part])):
        assert h.extract(f"<html><head><title>t</title></head><body>{page}</body></html>", model) == WANT


PLAIN = [f"<header>{x}</header>" for x in ("<h1>Site name</h1>", "<p>Site name</p>", "<div>Site name</div>", "Site name", "<h1>Site</h1><p>What the site is about, in some words</p>", '<div><a href="/">Site</a></div><nav><a href="/a">Home</a></nav>')]
PLAIN += [f"<footer>{x}</footer>" for x in ("Copyright 2020 Foo", "<p>Contact us by mail</p>", "<div>© 2020 Foo. All rights reserved.</div>", "<p>About the site, in a few words more than that</p><ul><li><a href='/i'>Imprint</a></li></ul>")]


@pytest.mark.parametrize("part", PLAIN)
@pytest.mark.parametrize("frame", ["<article>{}</article>", '<main><article class="post">{}</article></main>', '<div class="content">{}</div>', "<main>{}</main>"])
def test_plain_headers_and_footers_go(model, part, frame):
    """Without class, id or role, before and after the article."""
    for page in (part + frame.format(ARTICLE), frame.format(ARTICLE) + part, part + PARTS["nav"] + frame.format(ARTICLE) + PARTS["sidebar"]):
        assert h.extract(f"<html><body>{page}</body></html>", model) == WANT


def test_an_article_keeps_its_own_header(model):
    page = ARTICLE.replace("<h1>Title here</h1>", "<header><h1>Title here</h1></header>")
    for site in ("", PLAIN[0], PLAIN[3] + PARTS["nav"]):
        assert h.extract(f"<html><body>{site}<article>{page}</article>{PLAIN[6]}</body></html>", model) == WANT


@pytest.mark.parametrize("line", ["All rights reserved.", "Copyright 2020 Foo", "© 2021 someone, all rights reserved"])
def test_legal_lines_of_the_article_stay(model, line):
    page = ARTICLE.replace("Short.", line)
    for frame in ("<article>{}</article>", '<div class="content">{}</div>'):
        assert h.extract(f"<html><body>{PARTS['nav']}{frame.format(page)}{PARTS['footer']}</body></html>", model) == WANT.replace("Short.", line)


def test_layout_tables(model):
    menu, foot = '<tr><td><a href="/">Home</a> <a href="/a">About</a></td></tr>', "<tr><td>Copyright 2020 Foo</td></tr>"
    for body in (f"<tr><td>{ARTICLE}</td></tr>", f'<tr><td><a href="/">Home</a> <a href="/a">About</a></td><td>{ARTICLE}</td></tr>'):
        assert h.extract(f"<html><body><table>{menu}{body}{foot}</table></body></html>", model) == WANT


@pytest.mark.parametrize("page", ["\n", " ", "a", "<form>", "<div>", "<p>", "<b>", "</div>", "<form><div>", "<li>", "<table><tr><td>", "f*ck ", "<!--", "&amp;", "<a href='"])
def test_a_megabyte_of_anything_takes_seconds(model, page):
    began = time.time()
    h.extract(page * (1_000_000 // len(page)), model)
    assert time.time() - began < 30


@pytest.mark.parametrize("raw", ["<script>for(i=0;i<n;i++){f()}</script>", "<SCRIPT>if(a<b)f()</Script >", "<script><!-- x=1</script>", "<style>a<b{}</style>", "<script>s='</p>'+'</scripts>'</script>"])
def test_a_raw_element_ends_at_its_own_end_tag(model, raw):
    assert h.extract(f"<html><body><article>{raw}{ARTICLE}{raw}</article></body></html>", model) == WANT


def test_formulas_in_articles_stay(model):
    page = ARTICLE.replace("Short.", "Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.")
    assert h.extract(f"<html><body><article>{page}</article></body></html>", model) == WANT.replace("Short.", "Let x=2 hold.")


def test_held_out_layouts(model):
    wrong = total = 0
    for html, states in h.labelled_pages(120, 99):
        page = h.Page(html)
        for p, s, n in zip(model.content(page), states, page.words, strict=True):
            total += n > 0
            wrong += n > 0 and (p > 0.5) != (s == h.CONTENT)
    assert wrong / total < 0.05


def test_marginals_equal_enumeration(model):
    """Sum-product against adding up all labellings of a small tree."""
    import itertools
    import math

    page = h.Page("<body><div class='ad'>x y</div><article><p>some words are here</p><p>b</p></article></body>")
    own = [[math.exp(sum(model.weights.get(t, (0, 0, 0))[s] for t in names)) for s in range(3)] for names in h.traits(page)]
    total, content = 0.0, [0.0] * len(own)
    for states in itertools.product(range(3), repeat=len(own)):
        p = math.prod(own[i][s] for i, s in enumerate(states)) * math.prod(model.pair[states[page.parent[i]]][states[i]] for i in range(1, len(own)))
        total += p
        for i, s in enumerate(states):
            content[i] += p * (s == 1)
    assert model.content(page) == pytest.approx([c / total for c in content], rel=1e-6)


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<>", "</p></div>", "<p", "<!-- open", "<script>never closed <p>x</p>", "<div " * 500, "<b><i><p>" * 300])
def test_broken_pages(model, page):
    assert isinstance(h.extract(page, model), str)


def test_unclosed_tags(model):
    assert h.extract("<article><h1>T t</h1><p><b>one two three four five six.<br><p>seven eight nine ten eleven twelve</article>", model) == "T t\none two three four five six.\nseven eight nine ten eleven twelve"


def test_rows(spark):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", 1), (1, "u", f"<article>{ARTICLE}</article>", 1), (None, None, None, None), (2, "v", "", 0), (3, "w", "plain text", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in h.op2(df).collect()), key=repr)
    assert got == sorted([(1, WANT, len(WANT))] * 2 + [(None, "", 0), (2, "", 0), (3, "plain text", 10)], key=repr)
    assert h.op2(df.limit(0)).count() == 0


def test_signs_of_comparison_are_text(model):
    page = ARTICLE.replace("Short.", "5 < 6 and x<y here, a<b too.")
    assert h.extract(f"<html><body><article>{page}</article></body></html>", model) == WANT.replace("Short.", "5 < 6 and x<y here, a<b too.")


def test_a_form_around_the_page(model):
    page = f'<form id="aspnet">{PARTS["nav"]}<article>{ARTICLE}</article>{PARTS["form"]}{PARTS["footer"]}</form>'
    assert h.extract(f"<html><body>{page}</body></html>", model) == WANT


def test_very_long_pages_are_read_whole(model):
    many = "".join(f"<p>paragraph {i} holds some words of the article</p>" for i in range(20_000))
    got = h.extract(f"<html><body>{PARTS['nav']}<article>{many}</article>{PARTS['footer']}</body></html>", model).split("\n")
    assert len(got) == 20_000 and got[-1] == "paragraph 19999 holds some words of the article"
