import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirefold.llm import html_extract as m

from ..oracle import DATA

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title></head><body class="page sidebar-left"><header><a href="/">Site</a></header><div id="cookie-notice">We use cookies.</div>'
    '<div class="main-menu"><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></div><div class="content"><h1>Head &amp; line</h1><p>First with <b>bo</b>ld &lt;x&gt; text.'
    "<p>Second one is here,<br>longer than the first.<ul><li>Item one is short</li><li>two</li></ul><table><tr><td>c1<td>c2</table><div class='ad-box'>Buy now</div><form>Name <input></form>"
    '<p>Last paragraph.</p><div class="comments"><p>Nice read, thanks a lot. I will come back.</p></div></div><aside>Side text</aside><footer>(c) me</footer><script>if(a<b){"</p>"}</script></body></html>'
)


def test_page():
    assert m.main_text(PAGE) == "Head & line First with bold <x> text. Second one is here, longer than the first. Item one is short two c1 c2 Last paragraph."
    assert m.main_text("") == m.main_text("<p></p>") == "" and m.main_text("plain text only, without markup.") == "plain text only, without markup."
    assert len(m.main_text("<p>a.</p>" * 20_000)) == 59_999 and m.main_text("<div>" * 5_000 + "deep text, deep text.") == "deep text, deep text."


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=9), st.data())
def test_minimum_cut(gain, data):
    n = len(gain)
    edges = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.floats(0, 3)), max_size=14))
    edges = [e for e in edges if e[0] != e[1]]

    def cost(side):
        return sum(-g for g, s in zip(gain, side, strict=True) if g < 0 and s) + sum(g for g, s in zip(gain, side, strict=True) if g > 0 and not s) + sum(c for a, b, c in edges if side[a] != side[b])

    best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
    assert cost(m.minimum_cut(gain, edges)) == pytest.approx(best, abs=1e-6)


def test_query(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in m.op3_html_extraction(spark, DATA).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h\d)>", article)]
        assert r.text == " ".join(x for x in blocks if x) and r.n_chars == len(r.text)


def test_rows(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (None, PAGE)], "page_id long, html string")
    assert sorted(r.n_chars for r in m.extract(df).collect())[:2] == [0, 0]
    assert m.extract(df.limit(0)).collect() == []


def test_wrappers_and_comments():
    page = '<body><div id="page" class="has-sidebar"><article class="post"><h1>Head</h1><p>Main text.</p></article><div class="comments"><article class="comment"><p>First! I like it.</p></article></div></div></body>'
    assert m.main_text(page) == "Head Main text."


def test_long_doubtful_page():
    """Tens of thousands of blocks that nothing but their neighbours decides, and elements that never close."""
    kinds = ("<div>short one</div>", "<li>item</li>", "<div>" + "word " * 12 + ".</div>", "<div><a href=x>link text</a></div>")
    page = "<body><div>" + "".join(kinds[i * i % 7 % 4] for i in range(40_000)) + "</div>"
    assert len(m.main_text(page)) > 100_000
    assert len(m.main_text("<div><span>one more line of text here. " * 20_000)) > 100_000


LONG = "This paragraph goes on and on about something else than the article does, " * 4 + "and then it ends."


@pytest.mark.parametrize("around", ["<div>", "<div id=content>", '<div class="entry-content post">', "<form action=/>"])
@pytest.mark.parametrize("box", ["<aside>", "<form>", "<div class=ad>", "<div class=notice>", "<section class=comments>", "<aside><article>"])
@pytest.mark.parametrize("n", [1, 6])
def test_long_boilerplate_in_an_article(around, box, n):
    """Also with the article's paragraphs on both sides, and where a form holds the whole page."""
    tag, name = (x[1:].split(" ")[0].strip(">") for x in (around, box))
    inner = box + f"<p>{LONG}</p>" * n + ("</article>" if "<article>" in box else "") + f"</{name}>"
    page = f"<body>{around}<article><p>{LONG} First.</p>{inner}<p>{LONG} Last.</p></article></{tag}></body>"
    if around.startswith("<form") and box == "<form>":
        return  # forms do not nest
    assert m.main_text(page) == f"{LONG} First. {LONG} Last."


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def learnt(pages):
    return m.Model().fit(pages[:120])


def test_learnt_without_marks(pages, learnt):
    """Pages that were not learnt from, in a template that marks nothing: no article, navigation or footer, no classes."""
    right = of = changed = 0
    for page in pages[120:]:
        want = m.main_text(page)
        plain = re.sub(r"<(/?)(?:article|nav|footer)\b[^>]*>", r"<\1div>", page).replace(' class="ad"', "")
        found, own, content = m.labelled(plain, learnt)
        held = m.labelled(page, learnt)[2]
        assert len(found) == len(held) and m.main_text(page, learnt) == want
        of += len(found)
        right += sum(a == b for a, b in zip(content, held, strict=True))
        changed += sum((x > 0) != c for x, c in zip(own, content, strict=True))
    assert right >= 0.97 * of, (right, of, changed)
    print(f"{right} of {of} blocks right, {changed} changed by the cut")


def test_names_are_learnt(pages):
    """A name that stands around boilerplate only speaks against a block elsewhere, and one around articles for it."""
    renamed = [p.replace('<div class="ad">', '<div class="qx7">').replace("<article>", '<article><section class="zz3">').replace("</article>", "</section></article>") for p in pages[:120]]
    model = m.Model().fit(renamed)
    text = "Something is said here that might be either."
    assert model.names[".qx7"] < -0.5 and model.names[".zz3"] > 0.2
    against, plain, speaks = (m.labelled(f"<section class={c}>{text}</section>", model)[1][0] for c in ("qx7", "none", "zz3"))
    assert against < plain - 0.5 and speaks > plain + 0.2


def test_the_cut_decides():
    """A short line between paragraphs is kept, the same line among links is not."""
    line, para = "<div>A short line</div>", f"<p>{'Long paragraphs say much, and say it well. ' * 5}</p>"
    link = "<div><a href=x>Some link</a></div>"
    assert "A short line" in m.main_text(para + para + line + para) and "A short line" not in m.main_text(link * 3 + line + link * 3)
    _, own, content = m.labelled(para + line + para, m.Model())
    assert (own[1] > 0) != content[1]


@pytest.mark.parametrize("name", "sidebar-left left-sidebar ad-wrapper nav-open comments-layout aside toc alert discussion commentlist teaser popular".split())
def test_names_of_boilerplate(name):
    page = f"<body><div id=content><p>{LONG} First.</p><div class={name}><p>{LONG}</p></div><p>{LONG} Last.</p></div></body>"
    assert m.main_text(page) == f"{LONG} First. {LONG} Last."
    framed = f"<body><div class=left-sidebar><article><p>{LONG} First.</p></article></div></body>"
    assert m.main_text(framed) == f"{LONG} First."


def test_repeated_pages_and_clashing_columns(spark, none):
    rows = [(1, PAGE, 7, "x"), (1, PAGE, 7, "x"), (2, None, 8, "y")]
    df = spark.createDataFrame(rows, "page_id long, html string, N_CHARS int, h string")
    model = m.learn(df)
    got = m.extract(df, model=model).collect()
    assert m.extract(df).columns == ["page_id", "html", "h", "text", "n_chars"] and got[0].text == got[1].text != "" and [r.n_chars for r in got if r.page_id == 2] == [0]
    assert m.learn(df.limit(0)).names == {} and m.learn(df, sample_bytes=1).names == {}
