"""op12 against pages whose main text is known, and against a plain reading with the standard parser."""

import html
import random
import re
from html.parser import HTMLParser

import pytest

from lotloom.llm import html_text

LONG = "The house on the hill was old and it had stood there for as long as anyone in the village could say, with a garden that they all knew."
WORDS = "the of and house river stone to in a light that was tree cloud with old for garden".split()


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n)).capitalize() + "."


class Plain(HTMLParser):
    """Text of <article> elements, less what stands in marked elements; blocks end at any block element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.out, self.now = [], [], []

    def cut(self):
        text = " ".join("".join(self.now).split())
        if text:
            self.out.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.now.append(" ")
        elif tag in html_text.BLOCKS or tag in ("nav", "script", "style", "title"):
            self.cut()
            self.stack.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.stack):
            self.cut()
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        inside = any(t == "article" for t, _ in self.stack)
        marked = any(t in ("aside", "form", "nav", "footer", "script", "style", "title") or c in ("comments", "ad", "cookie-notice") for t, c in self.stack)
        if inside and not marked:
            self.now.append(data)


def made(rng):
    """A page with an article of long, short and odd blocks, and boilerplate around and in it."""
    body = []
    for _ in range(rng.randint(1, 9)):
        body.append(rng.choice([
            f"<p>{html.escape(prose(rng, rng.choice([1, 3, 8, 40, 200])))}</p>", f"<h2>{prose(rng, 3)}</h2>", "<p>x&nbsp;&lt;y&gt;  &amp;\n\tz</p>", f"<ul><li>{prose(rng, 4)}</li><li>{prose(rng, 30)}</li></ul>",
            f"<p>{prose(rng, 40)} <a href='/a'>and <b>a</b> link</a> {prose(rng, 9)}<br>{prose(rng, 3)}", '<div class="ad">Buy the best of all now</div>', f"<aside>{prose(rng, 60)}</aside>", "<script>if (a < b) { x = '<p>no</p>'; }</script>",
            '<form><label>Name</label><input name="n"><select><option>a</select></form>', "<!-- <p>gone</p> -->", f"<blockquote>{prose(rng, 20)}</blockquote>",
        ]))
    rng.shuffle(body)
    return (f"<!DOCTYPE html><html><head><title>T &amp; t</title><style>p > a {{}}</style></head><body class='with-sidebar'><header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></ul></nav>"
            f"<div class='cookie-notice'>{prose(rng, 30)}</div><article><h1>{prose(rng, 4)}</h1>{''.join(body)}<div class='comments'><p>{prose(rng, 50)}</p></div></article><footer>&copy; all of us</footer>")


def test_pages_are_read_as_the_standard_parser_reads_them():
    rng = random.Random(8)
    for _ in range(300):
        page = made(rng)
        plain = Plain()
        plain.feed(page)
        plain.close()
        plain.cut()
        assert html_text.main_text(page) == "\n".join(plain.out), page


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("   ", ""), ("<p>", ""), ("Only words", "Only words"), ("a<br>b", "a b"), ("1 < 2 <3 and <b>4</b>", "1 < 2 <3 and 4"),
    (f"<div><a href=/>Home</a> <a href=/n>News</a></div><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div><a href=/x>More</a></div><p>© 2024 us</p>", f"{LONG}\nShort.\n{LONG}"),
    (f"<p>Menu line</p><p>Another line</p><p>A third</p><p>{LONG}</p><p>{LONG}</p><p>Tail</p><p>End</p><p>Last</p>", f"A third\n{LONG}\n{LONG}\nTail"),
    (f"<h2>Title</h2><p>{LONG}</p><h2>See also</h2><ul><li><a href=/1>one of them</a></li></ul>", f"Title\n{LONG}"),
    (f"<article><p>Tiny.</p></article><p>{LONG}</p>", f"Tiny.\n{LONG}"),
    (f"<main><p>{LONG}</p><p>w x y z. {'Zqx vbn ' * 60}</p></main>", f"{LONG}\nw x y z. {'Zqx vbn ' * 60}".strip()),
    (f"<article><article class=comment><p>{LONG}</p></article><p>{LONG} &eacute;&#233;&#x1F600;&am &copy</p></article>", f"{LONG} éé\U0001f600&am ©"),
    (f"<div hidden><p>{LONG}</p></div><div style='display: none'>{LONG}</div><div role=navigation>{LONG}</div><section id=mainContent>{LONG}</section><textarea>{LONG}</textarea>", LONG),
    (f"<article><header><h1>Head</h1></header><p class='a\">b'>{LONG}</p><p title=\"a > b\">{LONG}", f"Head\n{LONG}\n{LONG}"),
    (f"<div title='ad\"><p>{LONG}</p>", LONG), ("<article><p>cut <a href='x", "cut"), ("<script>never ended <p>a</p>", ""), (f"<P>{LONG}</P><SCRIPT>x</Script ><p>{LONG}</p>", f"{LONG}\n{LONG}"),
])
def test_rules(page, want):
    assert html_text.main_text(page) == want


def test_neighbours():
    """(text, links, heading, marked, article): open blocks between decided ones."""
    good, bad, open_ = (LONG, 0.0, False, False, 0), ("link " * 9, 0.9, False, False, 0), ("short", 0.0, False, False, 0)
    marked, heading = ("menu", 0.0, False, True, 0), ("head", 0.0, True, False, 0)
    assert html_text.labels([bad, open_, good, open_, open_, bad]) == [False, False, True, True, False, False]
    assert html_text.labels([bad, heading, good, heading, bad]) == [False, True, True, False, False]
    assert html_text.labels([marked, open_, good, open_, marked]) == [False, True, True, True, False]
    assert html_text.labels([open_, good, open_]) == [False, True, False]
    assert html_text.labels([marked, open_, open_]) == [False, True, True]
    assert html_text.labels([(*bad[:4], 1), (*open_[:4], 2), (*bad[:4], 1)]) == [False, True, False]
    assert html_text.labels([]) == []


def test_table(spark):
    rng = random.Random(1)
    pages = [(k, f"http://p.example/{k}", made(rng)) for k in range(60)] + [(1, None, None), (None, "u", ""), (2, "u", f"<article>{f'<p>{LONG}</p>' * 20_000}</article>")] + [(3, "u", f"<p>{LONG}")] * 2
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = html_text.extracted(df.selectExpr("*", "'x' as text", "1 as n_chars"))
    assert got.schema.simpleString() == "struct<page_id:bigint,url:string,text:string,n_chars:bigint>"
    want = [(p, u, html_text.main_text(h), len(html_text.main_text(h))) for p, u, h in pages]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert html_text.extracted(df.limit(0)).count() == 0


def test_given_pages(spark):
    """The articles of the given table, as a plain cut of their markup has them."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html_of = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.op12_html_text(spark, "/root/testdata/sf0.01").collect():
        article = re.search("<article>(.*?)</article>", html_of[r.page_id], re.S).group(1)
        cut = [" ".join(html.unescape(b).split()) for b in re.split("</?(?:p|h1|b|br)>", article)]
        assert r.text == "\n".join(x for x in cut if x)
