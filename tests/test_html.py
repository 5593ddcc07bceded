import pytest
from harness import one
from pyspark.sql import functions as F

from webstrata.functions import html as H
from webstrata.functions import quality as Q
from webstrata.operators import pages as P


def value(spark, column, **cols):
    return one(spark, **cols).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("html, want", [
    ('<a href="/a">x</a><a href=b>y</a>', ["https://h.com/a", "https://h.com/d/b"]),
    ('<a href="/a#x"></a><a href="/a"></a>', ["https://h.com/a"]),
    ('<a href="mailto:x@y.z"></a><a href="tel:1"></a><a href="javascript:x()"></a><a href="ftp://f/"></a>', []),
    ('<a href="">e</a><a>n</a><a href="  /s ">s</a>', ["https://h.com/s"]),
    ('<a href="//cdn.com/x">', ["https://cdn.com/x"]),
    ('<base href="https://base.com/b/"><a href="c">', ["https://base.com/b/c"]),
    ("<a class='q' href='/q?a=1&amp;b=2'>", ["https://h.com/q?a=1&b=2"]),
    ('<!-- <a href="/hidden"> --><script>"<a href=\'/js\'>"</script><a href="/ok"', []),
    ('<!-- <a href="/hidden"> --><A HREF="/up">', ["https://h.com/up"]),
    ('<p>broken <a href="/z"><b>', ["https://h.com/z"]), ("", []),
])
def test_links(spark, html, want):
    assert value(spark, H.page_links(F.col("h"), F.col("u")), h=html, u="https://h.com/d/e") == want


PAGE = """<html lang="en-US"><head><title> A &amp; B </title>
<meta name="description" content=" Desc "><meta name="author" content="Me">
<meta property="og:title" content="OG"><meta property="og:image" content="/1"><meta property="og:image" content="/2">
<meta property="og:type" content=""><meta name="twitter:card" content="a"><meta name="twitter:card" content="b">
<link rel="canonical" href="https://h.com/c">
<script type="application/ld+json">{"@type": "Article", "name": "n"}</script>
<script type="application/ld+json">[{"@type": "X"}, 5]</script>
<script type="application/ld+json">{"@graph": [{"@type": "G"}, {"a": 1}]}</script>
<script type="application/ld+json">{"plain": 1}</script><script type="application/ld+json">{bad</script>
</head><body><nav>menu</nav><article><h1>Head</h1><p>Body <b>text</b>.</p></article><footer>foot</footer></body></html>"""


def test_metadata(spark):
    m = value(spark, H.all_metadata(F.col("h")), h=PAGE)
    assert m["og"] == {"title": ["OG"], "image": ["/1", "/2"]}
    assert m["twitter"] == {"card": "b"}
    assert (m["meta"]["language"], m["meta"]["canonical"], m["meta"]["description"]) == ("en", "https://h.com/c", "Desc")
    assert m["meta"]["keywords"] is None
    cl = '<meta http-equiv="content-language" content="de">'
    assert value(spark, H.standard_meta(F.col("h"))["language"], h=cl) == "de"


def test_json_ld(spark):
    items = P.json_ld_items(one(spark, html=PAGE)).select(F.expr("to_json(item)").alias("j")).collect()
    assert sorted(r["j"] for r in items) == sorted([
        '{"@type":"Article","name":"n"}', '{"@type":"X"}', '{"@type":"G"}', '{"a":1}',
    ])


def test_text(spark):
    text = value(spark, H.structural_text(F.col("h")), h=PAGE)
    assert text == "# A & B\n\nDesc\n\nA & B\nHead\nBody\ntext\n."
    assert value(spark, H.structural_text(F.col("h")), h="<div></div>") == ""
    long = "<p>" + "x" * 20_000
    assert len(value(spark, H.structural_text(F.col("h")), h=long)) == 20_000
    assert len(value(spark, H.structural_text(F.col("h"), H.EXCERPT), h=long)) == 10_000
    assert value(spark, H.html_to_markdown(F.col("h")), h="<article><h2>T</h2><p>" + "w " * 40 + "</p><ul><li><a href='/q'>L</a></li></ul></article>") == (
        "## T\n\n" + ("w " * 40).strip() + "\n\n- [L](/q)"
    )


def test_sections(spark):
    html = "<header>H</header><nav>N</nav><main>M</main><div class='hero'>B</div><footer>F</footer>"
    only = value(spark, H.filter_sections(F.col("h"), include=["body"], verbosity="compact"), h=html)
    assert only == "M"
    none = value(spark, H.filter_sections(F.col("h"), exclude=["body", "header"], verbosity="compact"), h=html)
    assert none == "N\nB\nF"
    plain = value(spark, H.filter_sections(F.col("h"), exclude=["body"], verbosity="compact"), h="<html><body>x</body></html>")
    assert plain == ""


def test_images(spark):
    html = '<img src="a.png" alt=" A " width="10" height="5%"><img src="data:image/x"><img alt="q"><img src="https://c/d">'
    rows = P.image_rows(one(spark, url="https://h.com/p/", html=html)).collect()
    assert [(r["position"], r["image_url"], r["alt"], r["width"], r["height"]) for r in rows] == [
        (1, "https://h.com/p/a.png", "A", 10, None), (2, "data:image/x", "", None, None), (3, "https://c/d", "", None, None),
    ]
    kept = P.image_rows(one(spark, url="https://h.com/p/", html=html), drop_data_uris=True).collect()
    assert [r["position"] for r in kept] == [1, 2]


@pytest.mark.parametrize("text, want", [
    ("api_key=abc123", "api_key=[REDACTED]"), ("Password: hunter2 x", "Password: [REDACTED] x"),
    ("https://a.b/?token=abc&x=1", "https://a.b/?token=[REDACTED]&x=1"),
    ("X-API-Key: zzz", "X-API-Key: [REDACTED]"), ("Authorization: Bearer abcdef.ghi", "Authorization: Bearer [REDACTED]"),
    ("use sk-abcdef12 now", "use sk-[REDACTED] now"), ("api_key=sk-foo12345", "api_key=[REDACTED]"), ("nothing", "nothing"),
])
def test_redact(spark, text, want):
    assert value(spark, H.redact(F.col("t")), t=text) == want


def test_description(spark):
    col = H.extract_description(F.col("t"))
    long = "This sentence is long enough to be used as a description and it keeps going until it passes one hundred. Then more."
    assert value(spark, col, t="# H\nshort\n" + long) == long[: long.index(". Then") + 1]
    assert value(spark, col, t="We use cookies to make this site work nicely for you.\n![i](x)\n" + long).startswith("This sentence")
    words = "word " * 100
    assert value(spark, col, t=words) == words.strip()[:300].rstrip() + "..."
    assert value(spark, col, t="tiny") == "tiny"
    two = "A first line that has thirty characters\nA second line that also has thirty characters"
    assert value(spark, col, t=two) == two.replace("\n", " ")


def test_titles(spark):
    col = H.pick_title([F.col("a")], F.col("m"), F.col("u"))
    assert value(spark, col, a="", m="x\n# Head \n", u="https://h.com/z") == "Head"
    assert value(spark, col, a="", m="", u="https://h.com/my-page_one/") == "My Page_One"


LONG = "This is a substantive paragraph with more than sixty characters in it, really."


@pytest.mark.parametrize("md, title, gates, score", [
    ("", "", ("fail", "fail", "fail"), 0.0),
    ("\n\n".join([LONG] * 20), "A proper long title", ("pass", "pass", "pass"), 1.0),
    ("[a](b)\n[c](d)\n[e](f)\n[g](h)", "", ("fail", "fail", "pass"), 0.49),
    ("Access denied. You have been blocked. Cloudflare", "", ("fail", "fail", "fail"), 0.14),
    ("Error: request failed", "", ("fail", "fail", "fail"), 0.2),
    (LONG + "\n\nThis site uses cookies", "", ("warn", "warn", "warn"), 0.39),
])
def test_quality(spark, md, title, gates, score):
    row = Q.assess_quality(one(spark, md=md, title=title), "md", F.col("title")).first()
    assert (row["boilerplate"], row["completeness"], row["block_detected"]) == gates
    assert row["score"] == pytest.approx(score, abs=0.011)


def test_barriers(spark):
    def verdict(**kw):
        cols = {"t": "", "u": "", "c": "", "h": ""} | kw
        return value(spark, Q.classify_barrier(*[F.col(x) for x in "tuch"]), **cols)

    body = "x" * 200
    assert verdict()["barrier_type"] == "empty"
    assert verdict(c=body)["detected"] is False
    one_signal = verdict(c=body, t="Just a moment...")
    assert (one_signal["barrier_type"], one_signal["confidence"]) == ("cloudflare", 0.7)
    two = verdict(c=body, t="Just a moment...", u="https://x/?__cf_chl=1")
    assert two["confidence"] == 0.9
    assert verdict(c=body, h="<div class='h-captcha'>")["provider"] == "hcaptcha"
    assert verdict(c=body + " security verification")["barrier_type"] == "suspicious"


def test_errors(spark):
    col = Q.classify_error(F.col("m"), F.col("c"))
    assert value(spark, col, m="x", c="TIMEOUT") == "timeout"
    assert value(spark, col, m="getaddrinfo failed", c="") == "dns_error"
    assert value(spark, col, m="Connection timed out", c="") == "connection_error"
    assert value(spark, col, m="read timed out", c="zzz") == "timeout"
    assert value(spark, col, m="boom", c="") == "scrape_error"


def test_fenced_json(spark):
    col = H.fenced_json(F.col("t"))
    assert value(spark, col, t='{"a":1}') == '{"a":1}'
    assert value(spark, col, t='x ```json\n{"a":1}\n``` y') == '{"a":1}'
    assert value(spark, col, t="no") is None


def test_chapters(spark):
    text = "*** START OF THE PROJECT GUTENBERG EBOOK X ***\nintro\nCHAPTER I\none\nCHAPTER II\ntwo\n*** END OF THE PROJECT GUTENBERG EBOOK X ***"
    rows = P.chapter_rows(one(spark, text=text)).collect()
    assert [(r["title"], r["content"]) for r in rows] == [("CHAPTER", "I\none"), ("CHAPTER", "II\ntwo")]
    assert P.chapter_rows(one(spark, text="just text")).first()["title"] == ""


@pytest.mark.parametrize("raw, want", [
    ("A&#8217;s &eacute;", "A\u2019s \u00e9"), ("&#38;amp;", "&amp;"), ("&amp;lt;", "&lt;"), ("&#x1F600;&#X41;", "\U0001f600A"),
    ("&nbsp;&copy;&hellip;", "\u00a0\u00a9\u2026"), ("&bogus; &; &#; &#x; a&b", "&bogus; &; &#; &#x; a&b"),
    ("&#0;&#xD800;&#1114112;", "\ufffd" * 3), ("&#128;&#150;", "\u20ac\u2013"), ("&NotEqualTilde;", "\u2242\u0338"),
    ("no reference", "no reference"), ("&lt;&gt;&quot;&apos;&#39;", "<>\"''"),
])
def test_character_references(spark, raw, want):
    assert value(spark, H.decode_entities(F.col("h")), h=raw) == want


def test_references_in_links_and_texts(spark):
    page = (
        '<title>A&#8217;s &eacute;</title><meta name="description" content="d &#169;">'
        '<a href="/a&#47;b">x</a><a href="/q?a=1&#38;b=2#top">y</a><a href="/c&amp;d">z</a>'
    )
    assert value(spark, H.page_links(F.col("h"), F.col("u")), h=page, u="https://h.com/") == [
        "https://h.com/a/b", "https://h.com/q?a=1&b=2", "https://h.com/c&d"]
    assert value(spark, H.page_title(F.col("h")), h=page) == "A\u2019s \u00e9"
    assert value(spark, H.structural_text(F.col("h")), h=page).startswith("# A\u2019s \u00e9\n\nd \u00a9")


def test_markdown_of_links_with_markup_and_preformatted_text(spark):
    page = (
        "<article>" + "<p>long enough to be the article of this page, by far</p>"
        '<a href="/x"><b>bold</b> link</a><pre>one\n  two\n\n\nthree</pre></article>'
    )
    text = value(spark, H.html_to_markdown(F.col("h")), h=page)
    assert "[**bold** link](/x)" in text and "one\n  two\n\n\nthree" in text


def test_meta_needs_the_key_before_the_value(spark):
    page = (
        '<html xml:lang="xx" lang="en-US"><meta content="late" name="author"><META Name="Author" Content="first">'
        "<meta name=author content='second'><meta property='og:title' content=' t '><meta property='OG:x' content=y>"
        '<link href="/b" rel="Canonical">'
    )
    meta = {k: value(spark, c, h=page) for k, c in H.standard_meta(F.col("h")).items()}
    assert (meta["author"], meta["language"], meta["canonical"], meta["robots"]) == ("first", "en", None, None)
    assert value(spark, H.canonical_href(F.col("h"), True), h=page) == "/b"
    assert value(spark, H.og_tags(F.col("h")), h=page) == {"title": ["t"], "x": ["y"]}


NESTED = [
    # Inner end tags do not end the outer element.
    ("<p>a</p><nav>n1<nav>n2</nav>TAIL</nav><p>b</p>", "a\nb"),
    ("<header>x<header>y</header>z</header>a<footer><footer></footer>f</footer>b", "a\nb"),
    ("<nav>n<header>h</header>m</nav>a", "a"),
    # An element without an end tag ends with the one around it.
    ("<div><nav>menu</div><p>a</p>", "a"),
    ("<body><p>a</p><nav>menu</body>", "a"),
    # End tags without a start do nothing.
    ("a</nav>b<nav>n</nav>c", "a\nb\nc"),
    ("<div>a</nav></div><nav>n<ul><li>m</nav><p>b</p>", "a\nb"),
    # Case, attributes, void and empty elements; names that only begin alike.
    ('<NAV class="x">n<br>m<img src="i"></NAV >a', "a"),
    ("<nav/>a<navy>b</navy>", "a\nb"),
    ("<script>var s = '<nav>';</script>a<nav>n</nav>b", "a\nb"),
    ("<!-- <nav> -->a<footer>f</footer>", "a"),
    ("plain", "plain"),
    ("", ""),
]


@pytest.mark.parametrize("html, want", NESTED)
def test_nested_elements(spark, html, want):
    assert value(spark, H.structural_text(F.col("h")), h=html) == want


SECTIONS = [
    ("<nav>n1<nav>n2</nav>n3</nav><p>a</p>", ["navigation"], "a"),
    ("<aside>s<aside>t</aside>u</aside><p>a</p><nav>n</nav>", ["sidebar"], "a\nn"),
    ('<div class="big banner">x<div>y</div>z</div><div>a</div>', ["banner"], "a"),
    ("<div class=hero>x<div class='banner'>y</div>z</div>a<div><div>b</div></div>", ["banner"], "a\nb"),
    ('<div class="site-banner">x</div><div data-x="banner">a</div>', ["banner"], "x\na"),
    ("<header>h<nav>n</nav></header><main>a<aside>s</aside></main>", ["header", "sidebar"], "a"),
    ("<main>m<article>a</article>e</main>tail", ["body"], "tail"),
]


@pytest.mark.parametrize("html, exclude, want", SECTIONS)
def test_nested_sections(spark, html, exclude, want):
    assert value(spark, H.filter_sections(F.col("h"), exclude=exclude, verbosity="compact"), h=html) == want


def test_nested_elements_of_one_page_at_any_depth(spark):
    deep = "<nav>" * 300 + "x" + "</nav>" * 300 + "a" + "<div>" * 500 + "b" + "</div>" * 500
    assert value(spark, H.structural_text(F.col("h")), h=deep) == "a\nb"
