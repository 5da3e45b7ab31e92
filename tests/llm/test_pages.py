"""HTML extraction and WARC archives."""

from __future__ import annotations

import hashlib
import html
import re

import pytest

from preciario.llm import queries, style_tree, warc
from tests.comparing import connect, differences

SF = "/root/testdata/sf0.01"
PAGES = "page_id long, url string, html string, style int, host string, digest string, first long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x", "y", 5) for i, u, h in rows], PAGES)


def text_of(page):
    return style_tree.main_text(page, {})


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("a < b &amp; c &lt;d&gt; &#233;&eacute;", "a < b & c <d> éé"),
        ("<p>one  \n two<p>three</p>four", "one two\nthree\nfour"),
        ("<article><h1>T</h1><p><b>T<br><p>x <i>y</i>z</p></article>", "T\nT\nx yz"),
        ("<script>if (a<b) '</p>'</script><p>x<style>p{}</style></p><!-- <p>no</p> -->", "x"),
        ("<script>never ends", ""),
        ("<p title='a > b'>x</p><p title=\"never ends>y</p>", "x\ny"),
        ("<nav>m</nav><header>h</header><main><header><h1>T</h1></header>b<aside>s</aside><form>f</form></main><footer>f</footer>", "T\nb"),
        ("<div class='cookie-notice'>c</div><article>a<div id='comments'>no</div></article><div class=ad>x</div>", "a"),
        ("<article>one</article><p>not</p><article>two</article>", "one\ntwo"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table></div></p>e", "a\nb\nc\nd\ne"),
    ],
)
def test_pages(page, text):
    assert text_of(page) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body class='has-sidebar'><p>a</p></body>", "a"),
        ("<body class='sidebar'><p>a</p></body>", "a"),
        ("<div class='content with-sidebar'><p>a</p></div><div class='sidebar'>b</div><div id='nav-menu'>c</div>", "a"),
        ("<div>x</div><article class='post category-social'>a</article>", "a"),
        ("<article class='related'>a</article>", "a"),
        ("<article><header class='entry-header'><h1>T</h1></header>a</article>", "T\na"),
        ("<article><div class='header'><h1>T</h1></div>a<div class='share'>s</div></article><div class='header'>h</div>", "T\na"),
        ("<div class='page-header'><h1>T</h1></div><p>a</p>", "T\na"),
        ("<div class='modal'><article><p>the text</p></article></div><p>b</p>", "the text"),
        ("<div class='related'><article>t</article></div><p>the text</p>", "the text"),
        ("<form><nav>n</nav><p>the text</p><label>l</label></form>", "the text"),
        ("<form class='search'><article>a</article><aside>b</aside></form>", "a"),
        ("<p>the text of the page</p><form><p>send</p></form>", "the text of the page"),
    ],
)
def test_names_and_forms_around_the_article(page, text):
    assert text_of(page) == text


ARTICLE = "<article><h1>T</h1><p>the story of the page</p></article>"


@pytest.mark.parametrize(
    "comments",
    [
        "<article class='comment'>I say</article>",
        "<div class='comment-list'><div>I say</div></div>",
        "<section id='comments-section'><p>I say</p></section>",
        "<div class='post-comments'>I say</div>",
        "<ol class='commentlist'><li>I say</ol>",
        "<div id='respond'>say</div>",
    ],
)
def test_comments_are_not_the_article(comments):
    assert text_of(ARTICLE + comments) == text_of(f"<article><h1>T</h1><p>the story of the page</p>{comments}</article>") == "T\nthe story of the page"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<header class='x'>h</header><div class='site-header'>h</div><div class='main-nav'>n</div><p>the text</p><div class='site-footer'>f</div>", "the text"),
        ("<div class='cookie-bar'>c</div><p>the text</p><div class='newsletter-form'>n</div><p hidden>h</p><p style='color:red;display: none'>d</p>", "the text"),
        ("<div data-id='share' data-role=\"nav\" data-class='ad'><p>long story</p></div><p>b</p>", "long story\nb"),
        ("<body class='comments-open'><div class='has-comments'><p>a</p></div></body>", "a"),
        ("<article class='post has-comments'>a</article>", "a"),
        ("<article><p>read on</p></article><div><p>a body that is much longer than its teaser</p></div>", "read on\na body that is much longer than its teaser"),
        ("<article><p>a story</p><aside><p>a quote that was pulled</p></aside><aside><a href=x>more</a> <a href=y>links</a></aside></article>", "a story\na quote that was pulled"),
    ],
)
def test_attributes_teasers_and_quotes(page, text):
    assert text_of(page) == text


def test_long_page():
    """Megabytes of text, and of one unclosed element after the other."""
    page = "<nav>m</nav><div>" + "".join(f"<p>word {i} <b>bold</b>" for i in range(60000)) + "</div>"
    assert text_of(page) == "\n".join(f"word {i} bold" for i in range(60000))


def test_importance_decides_without_article_tags(spark):
    """Pages of the driver with the article tag and all names taken away: the template goes by the style tree alone."""
    rows, want = [], {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").where("html IS NOT NULL").collect():
        inner = re.search("<article>(.*?)</article>", r.html, re.S).group(1)
        box = "<section><h2>Our promise</h2><p>Fixed words of the site</p></section>"
        rows.append((r.page_id, "http://one.example/x", f"<html><body><div><div>{box}</div><div>{inner}</div><address><p>All rights kept here</p></address></div></body></html>"))
        want[r.page_id] = text_of(f"<div>{inner}</div>")
    found = {r.page_id: r.text for r in style_tree.extract(pages(spark, rows)).collect()}
    assert sum(found[i] == want[i] for i in want) / len(want) > 0.95
    assert all("Fixed words" in text_of(h) and "rights kept" in text_of(h) for _, _, h in rows)  # without the model both stay


def test_deep_page():
    assert text_of("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_template_is_learnt(spark):
    """No name or tag gives the template away; pages of the host do."""
    box = "<div class='box'><p>Fixed words of the site</p></div>"
    rows = [(i, "http://user@Site.example:80/p", f"<div class='w'>{box}<div class='t'><p>Story {i} told {i * 7}</p><p>More {i}</p></div></div>") for i in range(12)]
    rows += [(50, "http://alone.example", rows[0][2]), (51, None, "<p>no url</p>"), (52, "http://x", None), (None, "http://x", ""), (53, "", "<p>a</p>"), (53, "", "<p>a</p>")]
    got = {(r.page_id, r.text, r.n_chars) for r in style_tree.extract(pages(spark, rows)).collect()}
    want = {(i, f"Story {i} told {i * 7}\nMore {i}") for i in range(12)} | {(50, "Fixed words of the site\nStory 0 told 0\nMore 0"), (51, "no url"), (52, ""), (None, ""), (53, "a")}
    assert got == {(i, t, len(t)) for i, t in want}
    assert style_tree.extract(pages(spark, rows)).count() == len(rows) and style_tree.extract(pages(spark, [])).count() == 0


def test_same_article_on_every_page_stays(spark):
    rows = [(i, "http://h/", f"<nav>{i}</nav><article><h1>T</h1><p>same</p></article>") for i in range(9)]
    assert {r.text for r in style_tree.extract(pages(spark, rows)).collect()} == {"T\nsame"}


def test_copies_are_no_template(spark):
    """Copies of one page, alone on their host or among other pages; the box of the varied pages still goes."""
    box = "<div class='box'><p>Fixed words of the site</p></div>"
    copy = "<div class='w'>{}<div class='t'><p>Copied story</p><table class='x'><tr><td>cell</table></div></div>"
    rows = [(i, "http://only", copy.format("")) for i in range(9)]
    rows += [(100 + i, "http://some", copy.format(box)) for i in range(9)]
    rows += [(200 + i, "http://some", f"<div class='w'>{box}<div class='t'><p>Story {i} told {i * 7}</p></div></div>") for i in range(12)]
    got = {r.page_id: r.text for r in style_tree.extract(pages(spark, rows).repartition(5)).collect()}
    want = {i: "Copied story\ncell" for i in (*range(9), *range(100, 109))} | {200 + i: f"Story {i} told {i * 7}" for i in range(12)}
    assert got == want


def test_op2_whole_table(spark):
    got = {r.page_id: r.text for r in queries.QUERIES["op2_html"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        lines = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1)>", "\n", article.replace("<br>", " "))).split("\n")
        assert got[r.page_id] == "\n".join(x for x in (" ".join(html.unescape(line).split()) for line in lines) if x)


def test_archives(spark, tmp_path):
    long = "x" * 100
    rows = [(5, "http://a/", long), (3, "http://b/\r\nX: y", long), (9, None, long), (1, "u", "x" * 99), (2, "u", "x" * 99), (4, "u", None), (6, "u", ""), (7, "u", "é" * 50), (8, "u", "é" * 50)]
    rows += [(3, "again", long), (None, "u", long), (10, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n" + "日本" * 90000), (None, "u", "only nulls" * 20), (None, "u", "only nulls" * 20)]
    got = sorted(map(tuple, warc.round_trip(pages(spark, rows), str(tmp_path / "w")).collect()), key=repr)
    want = []
    for key, _, page in rows:
        data = (page or "").encode()
        same = [k for k, _, h in rows if (h or "").encode() == data and k is not None]
        first = min(same, default=None) if len(data) >= 100 else None
        again = first is not None and key != first
        want.append((key, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=repr)
    captures = warc.assemble(warc.read_archives(spark, str(tmp_path / "w"))).collect()
    assert len(captures) == len(rows) and all(len(c.requests) == len(c.metadata) == 1 for c in captures)
    assert sorted(bytes(c.response.payload) for c in captures if c.response.record_type == "response" and len(c.response.payload) > 1000) == [rows[11][2].encode()]
    assert warc.round_trip(pages(spark, []), str(tmp_path / "none")).count() == 0


def test_incomplete_chains(spark):
    columns = "record_type string, record_id string, concurrent_to string, n int"
    rows = [("response", "a", None, 1), ("metadata", "m", "r", 2), ("request", "r", "a", 3), ("metadata", "m2", "a", 4), ("request", "x", "gone", 5), ("metadata", None, None, 6), ("revisit", None, None, 7)]
    got = warc.assemble(spark.createDataFrame(rows, columns)).collect()
    assert sorted(((c.response.n if c.response else 0), [x.n for x in c.requests], sorted(x.n for x in c.metadata)) for c in got) == [(0, [], [6]), (0, [5], []), (1, [3], [2, 4]), (7, [], [])]


def test_records_with_clashing_columns(spark):
    names = ("via", "through", "capture_id", "n", "__record")
    rows = [("response", "a", None, *names), ("request", "r", "a", *names), ("metadata", "m", "r", *names)]
    got = warc.assemble(spark.createDataFrame(rows, "record_type string, record_id string, concurrent_to string, " + ", ".join(f"`{c}` string" for c in names))).collect()
    assert [(c.capture_id, c.response.via, c.requests[0].through, c.metadata[0].capture_id) for c in got] == [("a", "via", "through", "capture_id")]


def test_cut_archive():
    import io

    whole = warc.record("metadata", {"WARC-Record-ID": "<a>"}, b"x: y\r\n")
    assert [warc.parsed(m)[1] for m in warc.members(io.BytesIO(whole * 3))] == ["<a>"] * 3
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.members(io.BytesIO(whole + whole[:-9])))


def test_op10_equals_oracle(spark):
    assert differences(queries.QUERIES["op10_warc"](spark, SF), connect(SF), queries.ORACLES["op10_warc"]) == []
