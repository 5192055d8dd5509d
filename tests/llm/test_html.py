"""HTML extraction: reading, inference, and what is content."""

import re

import pytest

from tidemark.llm.html import Extractor, absorb, extract, fold, infer_wrappers, load, merge, read


def wrapper_of(*pages):
    return merge([fold(read(p)[0]) for p in pages])


def text_of(page, *others):
    return Extractor(wrapper_of(page, *others)).blocks(page)


PLAIN = "<html><body><nav><ul><li><a href=x>Home</a></li><li>About</li></ul></nav><article><h1>T{0}</h1><p>One {0}</p><p>Two</p></article><footer>f</footer></body></html>"


def test_pattern_has_repeats_and_options():
    w = wrapper_of(PLAIN.format(1), PLAIN.format(2).replace("<footer>f</footer>", ""))
    assert w.pattern() == "<#root><html><body><nav><ul>(<li>#</li>)+</ul></nav><article><h1>#</h1>(<p>#</p>)+</article>(<footer>#</footer>)?</body></html></#root>"
    assert w.pages == 2


def test_group_that_repeats_is_a_loop():
    w = wrapper_of("<div><h2>a</h2><p>b</p><h2>c</h2><p>d</p><p>e</p></div>")
    assert "((<h2>#</h2>)?(<p>#</p>)*)+" in w.pattern()


def test_merging_order_changes_nothing_that_matters():
    pages = [PLAIN.format(i) + ("<div class=ad>x</div>" if i % 2 else "") for i in range(6)]
    a = wrapper_of(*pages)
    b = absorb(wrapper_of(*pages[:3]), wrapper_of(*pages[3:]))
    assert a.pattern() == b.pattern()
    assert load(a.dump()).pattern() == a.pattern()


def test_content_without_regions():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header>site</header><div class="cookie-notice">we use cookies</div><aside>side</aside><div id="menu-main"><ul><li>m</li></ul></div>
    <article><h1>Head&amp;line</h1><p>First &lt;b&gt; <b>bold</b>text<br>line&nbsp;two</p><form><p>mail</p><button>go</button></form>
    <div class="share">share</div><blockquote>Quote<p>inner</p></blockquote><!-- note --><noscript>js</noscript>
    <section class="comments"><p>first!</p></section></article><div class="ad">buy</div><footer>(c)</footer></body></html>"""
    assert text_of(page) == ["Head&line", "First <b> boldtext line two", "Quote", "inner"]


def test_unclosed_ends_and_stray_signs():
    page = "<body><nav><ul><li>m<article><h1>T</h1><p><b>One<br><p>a < b & c<p>Two<ul><li>x<li>y</ul></article><footer>f"
    assert text_of(page) == ["T", "One", "a < b & c", "Two", "x", "y"]


def test_content_without_an_article():
    page = "<body><div><a href=1>one</a> <a href=2>two</a></div><div><h2>Title {0}</h2><p>Body text {0} that is long enough.</p><p>More {0}.</p></div><div>All rights reserved, always</div></body>"
    pages = [page.format(i) for i in range(4)]
    assert text_of(pages[1], *[p for p in pages if p != pages[1]]) == ["Title 1", "Body text 1 that is long enough.", "More 1."]


@pytest.mark.parametrize(("page", "want"), [
    ("<body><div id='header'>Site</div><div class='post-content'><h1>T</h1><p>Body of the text</p></div><div class='sidebarLeft'>s</div><div id=footer>f</div></body>", ["T", "Body of the text"]),
    ("<body><main><p>crumbs</p><article><header><h1>T</h1></header><p>B</p><footer>tags</footer></article><aside>x</aside></main></body>", ["T", "B"]),
    ("<body><main><h1>T</h1><p>B</p><div class='share-buttons'>s</div></main><div>other</div></body>", ["T", "B"]),
    ("<body><article><h1>T</h1><p>B</p><section id=comments><h3>2 comments</h3><article><p>c</p></article></section></article></body>", ["T", "B"]),
    ("<body><div role='main'><p>B</p></div><div role=complementary><p>c</p></div></body>", ["B"]),
    ("<body class='has-sidebar'><article class='with-ads'><p>B</p><ins class='adsbygoogle'></ins></article></body>", ["B"]),
    ("<body><article><table><tr><td>a</td><td>b &lt; c</td></tr></table><pre>x\n  y</pre><dl><dt>k<dd>v</dl></article></body>", ["a", "b < c", "x y", "k", "v"]),
])
def test_kinds_of_pages(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize("word", ["sidebar", "share", "social", "sponsored", "subscribe", "related", "reply", "promo", "newsletter", "widget"])
def test_words_late_in_a_long_class_list_count(word):
    classes = f"border col flex gap grid lg md order rounded shadow {word}"
    assert text_of(f"<body><article><p>B</p><div class='{classes}'><p>x</p></div></article></body>") == ["B"]
    assert text_of("<body><article><p>B</p><div class='border col flex gap grid lg md order rounded shadow'><p>x</p></div></article></body>") == ["B", "x"]


@pytest.mark.parametrize(("inner", "want"), [
    ("<p class='notice-text'>x</p>", ["x"]), ("<div class='social-history'><p>x</p></div>", ["x"]), ("<p class='ad-hoc'>x</p>", ["x"]), ("<section class='menu-of-the-day'><p>x</p></section>", ["x"]),
    ("<p class=notice>x</p>", []), ("<div class='notice-text'><p>x</p></div>", []), ("<div class='ad-slot'>x</div>", []), ("<div id='comments-list'><p>x</p></div>", []), ("<aside><p>x</p></aside>", []),
    ("<p>f <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math></p>", ["f x=1"]), ("<object data=a><p>in place</p></object>", ["in place"]), ("<button>go</button>", []),
])
def test_names_inside_an_article(inner, want):
    assert text_of(f"<body><article><h1>T</h1><p>B</p>{inner}</article></body>") == ["T", "B", *want]


def test_a_teaser_does_not_hide_the_story():
    page = "<body><article><p>teaser</p></article><div><h1>Story</h1><p>" + "long text " * 30 + "</p><p>" + "and more " * 20 + "</p></div></body>"
    assert [b.split()[0] for b in text_of(page)] == ["Story", "long", "and"]


SOUP = """<body><div class=c1><div><a href=/>Start</a> <a href=/n>News</a> <a href=/s>{menu}</a></div></div><div class=c2>The paper of the town since 1901</div>
<div class=c3><div class=c4><h2>{title}</h2><div>Share this story with your friends</div><p>{first}</p><p>{second}</p><div class=c5>{third}</div></div>
<div class=c6>Read also what others read, every day, in our morning letter with all that matters to you and yours.</div></div>
<div class=c7>Printed by the town press, all rights kept. Imprint and data protection, terms and conditions of use.</div></body>"""


def soup(i):
    return SOUP.format(menu=f"Part {i}", title=f"Title {i}", first=f"First text number {i} here", second=f"Second {i * i} text", third=f"Third {i + 7} part")


def test_the_wrapper_tells_template_from_content_without_names():
    pages = [soup(i) for i in range(6)]
    for i, page in enumerate(pages):
        others = [p for p in pages if p is not page]
        assert text_of(page, *others) == [f"Title {i}", f"First text number {i} here", f"Second {i * i} text", f"Third {i + 7} part"]
        assert "Share this story with your friends" in text_of(page)  # which the page alone can't tell


def test_the_wrapper_finds_a_short_story_under_any_name():
    page = "<body><div class=widget><h1>T {0}</h1><p>Story {0} is short.</p></div><div class=x>" + "Always the same long words of the house. " * 20 + "</div></body>"
    pages = [page.format(i) for i in range(4)]
    assert text_of(pages[2], *pages[:2], pages[3]) == ["T 2", "Story 2 is short."]


def test_copies_make_no_template():
    odd = "<body><div><h2>Once</h2><section><p>Only here, but copied</p></section></div></body>"
    assert text_of(odd, *[odd] * 9, *[soup(i) for i in range(5)]) == ["Once", "Only here, but copied"]


def test_deep_pages():
    for tag in ("div", "section", "article", "ul"):
        page = f"<{tag}>" * 10_000 + "<p>deep text</p><p>b</p>" + f"</{tag}>" * 10_000
        assert text_of(page, page.replace("deep", "low"), page + "<p>x</p>") == ["deep text", "b"]
        w = wrapper_of(page, page)
        assert load(w.dump()).pattern() == w.pattern()
    assert text_of("<article>" + "".join(f"<div class='k{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}'>d{i}</div>" for i in range(3000)) + "</article>") == [f"d{i}" for i in range(3000)]


def test_long_rows_align():
    names = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqrst"]
    row = lambda keep, x: "<article>" + "".join(f"<div class={n}>{n} {x}</div>" for n in names if keep(n)) + "</article>"
    w = wrapper_of(row(lambda n: n[1] != "k", 1), row(lambda n: n[0] != "b", 2), row(lambda n: True, 3))
    article = w.kids[0]
    assert [k.sig for k in article.kids] == [f"div.{n}" for n in names] and not article.loop
    assert {k.sig[4:] for k in article.kids if k.opt} == {n for n in names if n[1] == "k" or n[0] == "b"}


def test_comment_article_is_left_out():
    page = "<body><article><p>main</p><article class='comment'><p>c</p></article></article></body>"
    assert text_of(page) == ["main"]


@pytest.mark.parametrize("page", ["", "<", "<p", "no markup", "<!-- open", "<script>x", "</p>", "<a title=\"x>y", "&amp;"])
def test_odd_pages_do_not_fail(page):
    text_of(page)


def test_long_page_is_read_whole():
    page = "<article>" + "".join(f"<p>p{i}</p><h2>h{i}</h2>" for i in range(20_000)) + "</article>"
    assert len(text_of(page)) == 40_000


def slow_text(page):
    """The tables' pages by cutting out their article with plain patterns; they have no other text in it than headings and blocks."""
    import html

    page = re.sub(r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>", "", page or "")
    inside = re.search(r"(?s)<article>(.*?)(?:</article>|<footer>|\Z)", page)
    if not inside:
        return None
    parts = re.split(r"</?(?:h1|p)>", re.sub(r"<br>", " ", inside[1]))
    texts = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in parts]
    return "\n".join(t for t in texts if t)


def test_query_against_plain_patterns(spark):
    sf_dir = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    from tidemark.llm.html import op3_html_extraction

    out = op3_html_extraction(spark, sf_dir).collect()
    assert len(out) == len(pages)
    for r in out:
        assert r.text == slow_text(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_odd_columns(spark):
    pages = spark.createDataFrame([("http://a.x/1", PLAIN.format(1), {"a": 1}, 5)], "`the.url` string, html string, m map<string,int>, N_chars int")
    out = extract(pages, url_col="the.url")
    assert out.columns == ["the.url", "m", "text", "n_chars"] and out.first().text == "T1\nOne 1\nTwo"


def test_frames(spark):
    rows = [(1, "http://a.x/1", PLAIN.format(1), "z"), (2, "http://A.x/2", PLAIN.format(2), None), (3, None, None, "z"), (None, "nohost", "", "z"), (1, "http://a.x/1", PLAIN.format(1), "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = {(r.page_id, r.url): (r.text, r.n_chars) for r in extract(pages).collect()}
    assert out[(1, "http://a.x/1")] == ("T1\nOne 1\nTwo", 12)
    assert out[(2, "http://A.x/2")] == ("T2\nOne 2\nTwo", 12)
    assert out[(3, None)] == ("", 0) and out[(None, "nohost")] == ("", 0)
    assert extract(pages).count() == 5
    assert extract(pages.limit(0)).count() == 0
    wrappers = {r.host: r.pages for r in infer_wrappers(pages).collect()}
    assert set(wrappers) == {"a.x", ""}
