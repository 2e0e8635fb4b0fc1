from __future__ import annotations

import html as entities
import re

import pyarrow as pa

from docspark.llm import html_extract as H, queries

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T &amp; t</title><style>p{{margin:0}}</style><script>var t="</p><p>x";if(a<b)track({n});</script></head>
<body class="post"><!-- note <p>not text</p> --><header><h1>Site name</h1><p>Slogan</p></header><nav><ul><li><a href="/a">Menu {n}</a></li><li>Two</ul></nav><div class="cookie-notice">We use cookies {n}</div>
<div id="sidebar-left"><p>Side {n}</p></div><div class="ad">Buy {n}</div>{body}<div class="comments"><article class="comment"><p>First! {n}</p></article></div><form><label>Mail</label><input name=x><button>Go</button></form>
<aside>Related</aside><noscript>Enable</noscript><footer>&copy; me {n}</footer></body></html>"""


def brute(page: str) -> str:
    """The one plain article of a page, by its tags."""
    m = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    blocks = re.split(r"</?(?:p|h1)>", m[1]) if m else []
    texts = [" ".join(entities.unescape(re.sub(r"<[^>]*(?:>|\Z)", " ", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_all_pages_are_brute_force(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.op8_html_extraction(spark, sf_dir).collect():
        assert r.text == brute(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_article_without_what_surrounds_it():
    body = '<article><h1>Head &lt;1&gt;</h1><p>One <b>bold</b>\n\t and   <i>more</i>&nbsp;&eacute;<br>next<p>Two <a href="x">link</a><script>no()</script><ul><li>a<li>b</ul><div class="share">Tweet</div><p>Same line</p><p>Same line</p></article>'
    want = "Head <1>\nOne bold and more é next\nTwo link\na\nb\nSame line\nSame line"
    assert H.extract([PAGE.format(n=1, body=body)]) == [want]
    assert H.extract([PAGE.format(n=k, body=body) for k in range(5)]) == [want] * 5


def test_an_articles_own_header_stays():
    page = '<header class="site-header">Site</header><div class="masthead">Top</div><article><header class="post-header"><h1>Title</h1></header><div class="entry-header">By me</div><p>Text</p><div class="post-footer">Filed</div></article>'
    assert H.extract([page]) == ["Title\nBy me\nText"]


def test_pages_without_an_article_lose_their_template():
    body = lambda k: f"<div><div><p>Breadcrumb home</p></div><div><p>Story {k} begins here.</p><p>It goes on, number {k * 7}.</p></div><div><p>All rights reserved</p></div></div>"
    got = H.extract([PAGE.format(n=k, body=body(k)) for k in range(6)])
    assert got == [f"Story {k} begins here.\nIt goes on, number {k * 7}." for k in range(6)]


def test_copies_keep_their_text():
    page = PAGE.format(n=1, body="<article><p>The very same text.</p></article>")
    assert H.extract([page] * 40) == ["The very same text."] * 40


def test_broken_markup():
    for source, want in [
        ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\nb"), ("<article><p>cut <b>o", "cut o"), ("<article><p>x &am", "x &am"), ("<article><p>x</p><scr", "x"), ("<!-- open <p>x", ""), ("a < b and c > d", "a < b and c > d"),
        ("<script>never closed <p>x", ""), ("<article><p title='a>b'>q</p></article>", "q"), ("<ARTICLE><P>Up</P></ARTICLE>", "Up"), ("<article></div><p>x</p></article>", "x"), ("<p>&#8364; &#x41; &amp;lt; &bogus;</p>", "€ A &lt; &bogus;"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n2\n3"), ("<article>" + "<div>" * 3000 + "deep", "deep"), ("<article><p>" + "w " * 100_000 + "</p>", ("w " * 100_000).strip()),
    ]:
        assert H.extract([source]) == [want], source[:60]


def test_classes_share_vectors_and_nest():
    pages = [H.Page(PAGE.format(n=k, body="<div>" + "<p>x</p>" * k + "</div>")) for k in range(1, 6)]
    template = H.deduce(pages)
    assert template and all(any(t in template for t in p.tokens) for p in pages)
    assert H.deduce(pages[:1]) == set() and H.deduce([pages[0]] * 3) == set()


def test_query_over_odd_rows(spark, tmp_path):
    body = "<article><p>Text {}</p></article>"
    rows = [(i, f"https://Hot.example.org/{i}", PAGE.format(n=i, body=body.format(i))) for i in range(150)]
    rows += [(200, None, "<p>no url"), (201, "not a url", "<p>odd"), (202, "http://a.b/", None), (203, "http://a.b/", ""), (203, "http://a.b/", ""), (None, "http://a.b/", "<article>null id")]
    spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, host string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((str(r.page_id), r.url or "", r.text, r.n_chars) for r in queries.op8_html_extraction(spark, str(tmp_path)).collect())
    want = [(str(i), f"https://Hot.example.org/{i}", f"Text {i}") for i in range(150)] + [("200", "", "no url"), ("201", "not a url", "odd"), ("202", "http://a.b/", ""), ("203", "http://a.b/", ""), ("203", "http://a.b/", ""), ("None", "http://a.b/", "null id")]
    assert got == sorted((*w, len(w[2])) for w in want)
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert H.main_text(none).collect() == []


def test_constant_boxes_inside_an_article_go():
    body = lambda k: f'<article><h1>Story {k}</h1><p>It was told on day {k} by {k * 7} people, and again on day {k + 1}.</p><div class="x7"><p>Try our app</p></div><p>The end.</p></article>'
    want = [f"Story {k}\nIt was told on day {k} by {k * 7} people, and again on day {k + 1}.\nThe end." for k in range(8)]
    assert H.extract([PAGE.format(n=k, body=body(k)) for k in range(8)]) == want
    assert H.extract([PAGE.format(n=k, body=body(1)) for k in range(8)]) == [want[1].replace("\nThe", "\nTry our app\nThe")] * 8  # copies


def test_an_article_counts_where_it_holds_the_bulk():
    story = "<p>A long story that fills the page and is not in the small element.</p>" * 3
    assert H.extract([f'<div id="main-image"><p>Caption</p></div><div class="c">{story}</div>'])[0].count("long story") == 3
    assert H.extract([f'<div class="c">{story}</div><article><p>Teaser</p></article>'])[0].count("long story") == 3
    assert H.extract(["<div>Small</div><article><p>The article's own text.</p></article>"]) == ["The article's own text."]


LINE = "Number {} of many lines, written to be a paragraph of the usual length, so that two of them are not a menu, nor a notice, nor a slogan."


def test_near_copies_and_shared_passages_keep_their_text():
    lines = [LINE.format(k) for k in range(6)]
    page = lambda own: "<div>" + "".join(f"<p>{x}</p>" for x in own) + "</div>"
    other = [[LINE.format(f"{k}/{j}") for j in range(4)] for k in range(8)]
    made = [lines, [*lines[:5], "Changed."], [*other[0], lines[0]], *other[1:]]  # a near copy, and a passage in a third page
    for n in (2, 3, len(made)):
        assert H.extract([page(x) for x in made[:n]]) == ["\n".join(x) for x in made[:n]]


def test_no_group_of_a_large_host_is_small():
    body = "<html><body><div><p>Home and more</p></div><div><p>Story {0} begins here and goes on for {0} days.</p></div></body></html>"
    for n in (33, 65, 66):
        rows = [["one.example"] * n, [0] * n, list(range(n)), ["u"] * n, [body.format(i) for i in range(n)]]
        batch = pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["host", "salt", "page_id", "url", "html"])
        got = [r for b in H._groups(H._press([batch])) for r in b.to_pylist()]
        assert [(r["page_id"], r["text"]) for r in got] == [(i, f"Story {i} begins here and goes on for {i} days.") for i in range(n)]


def test_an_id_of_a_heading_or_text_is_no_name():
    assert H.extract(['<article><h2 id="related-work">Related work</h2><p id="footer">x</p><p><span id="ad">y</span></p></article>']) == ["Related work\nx\ny"]
    assert H.extract(['<article><h2>Head</h2><div id="related-work"><p>Other</p></div><p class="promo">Buy</p><p>x</p></article>']) == ["Head\nx"]


def test_a_line_goes_on_around_what_is_left_out():
    for source, want in [
        ('<article><p>Hello <span class="ad">buy</span> world</p></article>', "Hello world"), ('<article><p>Hello <span class="ad">buy <b>now</b></span>, world <button>Go</button> on</p><p>z</p></article>', "Hello , world on\nz"),
        ('<article><p>a <span class="ad">never closed</p><p>b</p></article>', "a\nb"), ('<article><p>a <span class="ad">one <span class="promo">two</span> three</span> b</p></article>', "a b"),
        ('<article>a <div class="ad"><p>block</p></div> b</article>', "a\nb"), ('<article><p>a <span class="ad">cut', "a"), ('<article><p>a <span hidden><p>odd</p></span> b</p></article>', "a\nodd\nb"),
    ]:  # fmt: skip  (a paragraph ends the one it begins in, and the span with it)
        assert H.extract([source]) == [want], source


def test_formulas_are_text():
    assert H.extract(["<article><p>if <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p></article>"]) == ["if x=1 holds"]
    assert H.extract(['<article><p>if <math><semantics><mi>x</mi><annotation encoding="t">\\x</annotation></semantics></math> holds</p></article>']) == ["if x holds"]


def test_an_empty_template_changes_pages_with_articles(monkeypatch):
    body = lambda k: f'<article><h1>Story {k}</h1><p>It was told on day {k} by {k * 7} people.</p><div class="x7"><p>Try our app</p></div></article>'
    pages = [PAGE.format(n=k, body=body(k)) for k in range(40)]
    want = [f"Story {k}\nIt was told on day {k} by {k * 7} people." for k in range(40)]
    assert H.extract(pages) == want
    monkeypatch.setattr(H, "deduce", lambda pages: set())
    assert H.extract(pages) == [x + "\nTry our app" for x in want]
