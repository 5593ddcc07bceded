import pytest
from harness import one
from pyspark.sql import functions as F

from webstrata.functions import urls as U


def value(spark, column, **cols):
    return one(spark, **cols).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("url, want", [
    ("https://Example.com/", "https://example.com/"),
    ("https://example.com", "https://example.com/"),
    ("HTTP://example.com:80/a/", "http://example.com/a"),
    ("https://example.com:443/a/./b/../c", "https://example.com/a/c"),
    ("https://example.com:8443/a", "https://example.com:8443/a"),
    ("https://example.com/a?z=1&a=2#frag", "https://example.com/a?a=2&z=1"),
    ("https://example.com/../../x//y", "https://example.com/x/y"),
    ("https://example.com/p;v=1?q=1", "https://example.com/p;v=1?q=1"),
    ("a/b/", "a/b"),
])
def test_normalize(spark, url, want):
    assert value(spark, U.normalize_url(F.col("u")), u=url) == want


def test_cache_key_keeps_fragment_and_lowers_path(spark):
    url = "HTTPS://Example.com/Path/?B=2&A=1#Frag"
    assert value(spark, U.cache_url(F.col("u")), u=url) == "https://example.com/path?a=1&b=2#Frag"


@pytest.mark.parametrize("href, want", [
    ("b", "https://h.com/x/b"), ("/b", "https://h.com/b"), ("../b", "https://h.com/b"),
    ("./", "https://h.com/x/"), ("//c.com/d", "https://c.com/d"), ("?q=1", "https://h.com/x/a?q=1"),
    ("#f", "https://h.com/x/a?o=1#f"), ("", "https://h.com/x/a?o=1#z"), ("mailto:a@b", "mailto:a@b"),
    ("b?x=1#y", "https://h.com/x/b?x=1#y"), ("../../../b", "https://h.com/b"), ("b/..", "https://h.com/x/"),
])
def test_resolve(spark, href, want):
    assert value(spark, U.resolve_url(F.col("h"), F.col("b")), h=href, b="https://h.com/x/a?o=1#z") == want


@pytest.mark.parametrize("url, private", [
    ("http://10.0.0.1/", True), ("http://172.31.9.1/", True), ("http://172.32.0.1/", False),
    ("http://192.168.1.1:8080/x", True), ("http://127.0.0.1", True), ("http://169.254.169.254/", True),
    ("http://100.100.100.200/", True), ("http://100.128.0.1/", False), ("http://8.8.8.8/", False),
    ("http://[::1]/", True), ("http://[fd12::1]/", True), ("http://[fe80::1]/", True),
    ("http://[2001:db8::1]/", False), ("http://x.docker.internal/", True), ("/relative", True),
    ("https://example.com/", False), ("http://240.0.0.1/", True), ("http://1.2.3.400/", False),
])
def test_private(spark, url, private):
    assert value(spark, U.is_private_host(F.col("u")), u=url) is private


def test_private_with_host_table(spark):
    urls = spark.createDataFrame(
        [("http://a.com", False), ("http://b.com", True), ("http://c.com", None)], "u string, p boolean"
    )
    got = urls.select(U.is_private_host(F.col("u"), F.col("p")).alias("x")).collect()
    assert [r["x"] for r in got] == [False, True, True]


@pytest.mark.parametrize("url, base, want", [
    ("https://example.com/a", "example.com", "internal"), ("https://docs.example.com", "example.com", "subdomain"),
    ("https://a.b.example.com", "EXAMPLE.com", "subdomain"), ("https://notexample.com", "example.com", "external"),
    ("/x", "example.com", "internal"), ("https://example.com:8080/", "example.com", "internal"),
])
def test_link_class(spark, url, base, want):
    assert value(spark, U.classify_link(F.col("u"), F.col("b")), u=url, b=base) == want


def test_globs_and_filters(spark):
    assert U.glob_to_regex("/blog/**") == "^/blog/.*$"
    assert U.glob_to_regex("/a?/*.html") == "^/a./[^/]*\\.html$"
    col = F.col("u")
    assert value(spark, U.match_path(col, ["/blog/*"]), u="https://x.com/blog/p")
    assert not value(spark, U.match_path(col, ["/blog/*"]), u="https://x.com/blog/p/q")
    assert not value(spark, U.match_path(col, ["/**"], ["/blog/**"]), u="https://x.com/blog/p")
    assert value(spark, U.match_path(col, None, ["("], True), u="https://x.com/(")  # unusable pattern
    why = value(spark, U.filter_reason(col, ["/a"], ["/b*"]), u="https://x.com/bc")
    assert (why["reason"], why["pattern"]) == ("exclude_paths", "/b*")
    assert value(spark, U.filter_reason(col, ["/a"], None), u="https://x.com/z")["reason"] == "include_paths"
    assert value(spark, U.filter_reason(col, ["/a"], None), u="https://x.com/a") is None


@pytest.mark.parametrize("url, score", [
    ("https://x.com/login", -9999), ("https://a.b/c/d?utm_source=x", -5000), ("https://mit.edu/", 1),
    ("https://en.wikipedia.org/wiki/X", 4), ("https://a.dev", -1), ("https://a.dev/x", 0),
    ("https://reddit.com/r/x/y", 0),
])
def test_score(spark, url, score):
    assert value(spark, U.score_url(F.col("u")), u=url) == score


@pytest.mark.parametrize("url, category", [
    ("https://docs.python.org", "docs"), ("https://www.github.com/a", "reference"),
    ("https://api.x.com/", "api"), ("https://blog.cnn.com/", "blog"), ("https://edition.cnn.com", "news"),
    ("https://old.reddit.com", "social"), ("https://a.substack.com", "blog"), ("https://q.net", "unknown"),
    ("nohost", "unknown"),
])
def test_category(spark, url, category):
    assert value(spark, U.domain_category(F.col("u")), u=url) == category


def test_entities(spark):
    def found(url):
        rows = value(spark, U.extract_entities(F.col("u")), u=url)
        return {r["kind"]: r["value"] for r in rows}

    assert found("https://nvd.nist.gov/vuln/detail/CVE-2024-3094") == {"cve": "CVE-2024-3094"}
    assert found("https://www.abuseipdb.com/check/1.2.3.4")["ip"] == "1.2.3.4"
    assert found("https://crt.sh/?q=example.com&x=1")["cert_domain"] == "example.com"
    assert found("https://youtu.be/dQw4w9WgXcQ")["video_id"] == "dQw4w9WgXcQ"
    assert found("https://www.youtube.com/watch?a=b&v=dQw4w9WgXcQ&t=1")["video_id"] == "dQw4w9WgXcQ"
    assert found("https://www.gutenberg.org/ebooks/11")["book_id"] == "11"
    assert found("https://attack.mitre.org/techniques/T1059")["attack_id"] == "T1059"


def test_routes_highest_priority_wins(spark):
    routes = [("example", "low", 10), ("example\\.com/a", "high", 20), ("example", "later", 10)]
    assert value(spark, U.route_url(F.col("u"), routes), u="https://example.com/a") == "high"
    assert value(spark, U.route_url(F.col("u"), routes), u="https://example.com/b") == "low"
    assert value(spark, U.route_url(F.col("u"), routes), u="https://q.com") == "generic"


def test_filenames(spark):
    name = U.derive_filename(F.col("u"), F.col("t"))
    assert value(spark, name, u="https://x.com/a/b.pdf", t="text/html") == "b.pdf"
    assert value(spark, name, u="https://x.com/a/b", t="application/pdf; q") == "b.pdf"
    assert value(spark, name, u="https://x.com", t="image/png") == "download.png"
