"""Templates of hosts and the main text of their pages."""

import re

import pytest

from scriptoria.llm import html_template as ht
from scriptoria.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string"


def text(html):
    return ht.main_text(ht.read(html)[1], set())


def test_reading():
    assert text("<article><h1>A &amp; B</h1><p>one <b>two</b>\n three<p>four<br>five</article><footer>no</footer>") == "A & B\none two three\nfour five"
    assert text('<nav>menu</nav><div class="ad">buy</div><main><p>x</p><aside>y</aside><form>f</form><script>var t="</p>"</script><style>p{}</style>z</main>') == "x\nz"
    assert text('<article><header><h1>T</h1>by me</header><p>body</p><section class="comments"><p>first!</p></section></article>') == "T\nbody"
    assert text("<body><div class='cookie-notice'>ok?</div><div>plain</div></body>") == "plain"
    assert text("<div id='content'><p>in</p></div><p>out</p>") == "in"
    assert text("<article><p>cut <b>here") == "cut here"
    assert text("<!-- x --><article>a<!-- b -->c<![CDATA[d]]><p>&eacute;&#233;&lt;p&gt;</article>") == "acd\néé<p>"
    assert text("") == "" and text("<<>><a href='<b>'>&nbsp;</a>") == "<<>>"
    assert text("<article><ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2</table></article>") == "a\nb\nc\n1\n2"
    assert text("<ARTICLE><P>Up</P></ARTICLE><FOOTER>no") == "Up"


@pytest.mark.parametrize("name", ["home no-sidebar", "has-sidebar", "comments-open", "layout with-sidebar", "has-header"])
def test_names_of_wrappers_hide_nothing(name):
    rest = '<div class="sidebar">side</div><div class="comments"><article>first!</article></div>'
    assert text(f"<body class='{name}'><article><p>x</p></article>{rest}</body>") == "x"
    assert text(f"<div class='{name}'><article><p>x</p></article>{rest}</div>") == "x"
    assert text(f"<div><article class='{name}'><h1>T</h1><p>x</p></article>{rest}</div>") == "T\nx"
    assert text(f"<div class='{name}'><div class='{name}'><main><p>x</p></main>{rest}</div></div>") == "x"
    assert text(f"<div class='{name}'><p>a long story, with no article marked</p><div class='sidebar'>side</div></div>") == "a long story, with no article marked"


def test_named_articles_beside_plain_ones_stay_out():
    assert text("<article><p>x</p><article class='comment'>c</article></article><article class='promo'>buy</article>") == "x"


def test_titles_in_named_headers_stay():
    assert text("<article><div class='article-header'><h1>T</h1>by me</div><p>x</p></article>") == "T\nx"
    assert text("<div class='site-header'><h1>Site</h1></div><article><p>x</p></article>") == "x"
    assert text("<div class='content'><div class='article-header'><h1>T</h1></div><p>some words</p></div>") == "T\nsome words"


@pytest.mark.parametrize("html,expected", [
    ("<article><p>x <button>Subscribe</button> y</p></article>", "x y"),
    ("<article><p>x<button><div>Sub</div><p>scribe</p></button>y</p></article>", "xy"),
    ("<article><p>a <svg><text>z</text></svg>b <select><option>o<option>p</select>c <object>q</object><canvas>w</canvas>d</p></article>", "a b c d"),
    ("<article><p>see <span class=ad>BUY NOW</span> it</p></article>", "see it"),
    ("<article><p>a long paragraph <span class='ad'>BUY</p><p>next</p></article>", "a long paragraph\nnext"),
    ("<article>Lead text <a class='comment-link'>3 comments<p>next</p></a></article>", "Lead text"),
    ("<article><p>one <span class=ad>x<p>two</span> more</p><p>three</p></article>", "one\ntwo more\nthree"),
    ("<article><p>a <b>b<p>c</b> d</p><p>e</article>", "a b\nc d\ne"),
    ("<article><p>q <button>Sub</p><p>r</p></article>", "q\nr"),
    ("<article><a class=promo><div>Buy</div></a><p>k</p></article>", "k"),
])
def test_text_is_judged_by_its_own_open_tags(html, expected):
    assert text(html) == expected


@pytest.mark.parametrize("name", ["related-work", "menu-card", "search-warrant", "ad-hoc"])
def test_names_that_only_contain_a_word_hide_nothing_in_an_article(name):
    assert text(f"<article><p>x</p><section class='{name}'><p>y</p></section><p class='{name}'>z</p></article>") == "x\ny\nz"


@pytest.mark.parametrize("name", ["ad", "comment-list", "related-posts", "comment-12", "share buttons", "site-menu"])
def test_names_of_furniture_count_in_an_article(name):
    assert text(f"<article><p>x</p><section class='{name}'><p>y</p></section></article>") == "x"


@pytest.mark.parametrize("piece,kept", [("<b>x ", "x "), ("<div>x", "x\n"), ("<span class=ad>b</span> word ", "word ")])
def test_long_deep_and_unclosed_markup_loses_nothing(piece, kept):
    assert text("<article>" + piece * 5000 + "</article>") == (kept * 5000).strip()


def page(i, body, extra=""):
    return (i, f"http://h.example/{i}", f"<html><body><div class=top><p>Welcome to us</p></div>{extra}<div class=x1><p>{body}</p></div><div class=bottom><p>All rights</p></div></body></html>")


def test_template_tells_fixed_text_where_no_article_is_marked(spark):
    rows = [page(i, f"story number {i}") for i in range(8)] + [(99, "http://other.example/", "<p>alone</p>"), (100, None, None), (101, "odd", "")]
    out = {r["page_id"]: r["extracted"] for r in ht.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(out[i]["text"] == f"story number {i}" for i in range(8))
    assert out[99]["text"] == "alone" and out[100]["text"] == out[101]["text"] == ""
    assert [s["slot"] for s in out[3]["slots"]] == ["/html/body/div.x1/p"] or out[3]["slots"][0]["slot"].startswith("/html/body")


def test_classes_nest(spark):
    rows = [page(i, f"story {i}", "<ul><li>a</li><li>b</li></ul>" * (i % 3)) for i in range(9)]
    tokens = {t["path"]: t for r in ht.templates(spark.createDataFrame(rows, SCHEMA)).collect() for t in r["tokens"] if t["kind"] == ht.TAG}
    assert tokens["/html/body"]["class"] == tokens["/html/body/div.top"]["class"] == tokens["/html/body/div.top"]["parent"]
    assert "/html/body/ul" not in tokens or tokens["/html/body/ul"]["class"] != tokens["/html/body"]["class"]


def test_a_paragraph_shared_by_pages_stays_in_an_article(spark):
    rows = [(i, "http://h.example/", "<nav>m</nav><article><p>shared words</p></article>") for i in range(5)]
    df = spark.createDataFrame(rows + rows[:2], SCHEMA).withColumn("host", ht.F.lit(1)).withColumn("tokens", ht.F.lit(2))
    out = ht.extract(df)
    assert out.columns == [*df.columns, "extracted"]
    assert [r["extracted"]["text"] for r in out.collect()] == ["shared words"] * 7


def marked(i, body):
    """A page with an article and a notice in it that no tag or class name tells from the story."""
    return (i, f"http://m.example/{i}", f"<html><body><main><section><p>{body}</p></section><section class=x2><p>Read us daily</p></section></main></body></html>")


def test_template_tells_fixed_text_inside_an_article(spark):
    rows = [marked(i, f"story number {i // 2 if i < 4 else i}") for i in range(8)]
    out = {r["page_id"]: r["extracted"]["text"] for r in ht.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    # two pages share a story: no tag has its vector, so it is not the template's
    assert out == {i: f"story number {i // 2 if i < 4 else i}" for i in range(8)}


def test_an_article_of_fixed_text_only_is_kept(spark):
    rows = [(i, f"http://k.example/{i}", f"<html><body><main><h1>Title</h1><p>same words</p></main><footer>{i}</footer></body></html>") for i in range(5)]
    assert {r["extracted"]["text"] for r in ht.extract(spark.createDataFrame(rows, SCHEMA)).collect()} == {"Title\nsame words"}


@pytest.mark.parametrize("pages,copies", [(1, 2), (1, 5), (2, 1), (2, 4)])
def test_copies_and_pairs_of_pages_lose_nothing(spark, pages, copies):
    """Rows of one html are one page, and what two pages share is not yet the host's."""
    rows = [(10 * i + c, f"http://c.example/{i}?{c}", f"<html><body><div><p>shared</p></div><div class=b><p>own {i}</p></div></body></html>") for i in range(pages) for c in range(copies)]
    out = {r["page_id"]: r["extracted"]["text"] for r in ht.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {i: f"shared\nown {i // 10}" for i, _, _ in rows}


def test_copies_do_not_make_text_fixed(spark):
    """Three pages of 40 share a text; their many copies do not make it one of half the host's."""
    html = lambda i: f"<html><body><div><p>own {i}</p></div>{'<div class=c><p>shared</p></div>' if i < 3 else ''}</body></html>"
    rows = [(i, f"http://d.example/{i}?{c}", html(i)) for i in range(40) for c in range(30 if i < 3 else 1)]
    out = {r["page_id"]: r["extracted"]["text"] for r in ht.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {i: f"own {i}\nshared" if i < 3 else f"own {i}" for i in range(40)}


@pytest.mark.parametrize("share,fixed", [(49, False), (50, True)])
def test_the_share_of_pages_is_exact(spark, share, fixed):
    """A box on just half of a host's 100 pages is template, one on 49 is not; copies of pages change neither."""
    box = "<div class=box><p>on some pages</p></div><div class=end><p>and so on</p></div>"
    html = lambda i: f"<html><body><div class=own><p>own {i}</p></div>{box if i < share else ''}</body></html>"
    rows = [(i, f"http://e.example/{i}?{c}", html(i)) for i in range(100) for c in range(1 + 3 * (i % 5 == 0) + 7 * (i == 99))]
    out = {r["page_id"]: r["extracted"]["text"] for r in ht.extract(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()}
    assert out == {i: f"own {i}" if fixed or i >= share else f"own {i}\non some pages\nand so on" for i in range(100)}


def test_classes_decide_where_names_say_nothing(spark):
    """One name for the story and for what every page repeats: only the template tells them apart."""
    def html(i):
        return f"<html><body><article><section class='menu-card'><p>today's dish {i}</p></section><section class='menu-bill'><p>Pay at the till</p></section></article></body></html>"
    rows = [(i, f"http://n.example/{i}", html(i)) for i in range(6)]
    out = {r["page_id"]: r["extracted"]["text"] for r in ht.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {i: f"today's dish {i}" for i in range(6)}


def test_query_against_plain_rule(spark):
    """In the test pages every block of the article is a heading or a paragraph."""
    import html as entities

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = QUERIES["op2_html_extraction"](spark, FOLDER).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<br>|</?b>", " ", b)).split()) for b in re.split(r"</?(?:h1|p)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("rows", [[], [(None, None, None), (None, None, None)]])
def test_small_tables(spark, rows):
    assert [r["extracted"]["text"] for r in ht.extract(spark.createDataFrame(rows, SCHEMA)).collect()] == [""] * len(rows)
