"""Golden cases, and the paths for large tables against brute force."""

import decimal
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from webstrata.operators import cache as C
from webstrata.operators import dedup as D
from webstrata.operators import graph as G
from webstrata.operators import index as I
from webstrata.operators import jobs as J
from webstrata.operators import memory as M
from webstrata.operators import monitor as W
from webstrata.operators import ordered
from webstrata.operators import robots as R
from webstrata.operators import search as S
from webstrata.session import checkpoint_root
from webstrata.sources import sitemaps as L


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ------------------------------------------------------------------ slices

def rows(df, *cols):  # noqa: F811
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def shapes():
    """Rows (id, key, at, v): hot key, NULL key, one key only, one order value only."""
    rng = random.Random(7)
    mixed = [
        (i, "hot" if i % 3 else rng.choice(["a", "b", None]), rng.choice([None, *range(60)]), rng.choice([None, 1, 2, 3]))
        for i in range(600)
    ]
    one = [(i, None, i // 7, rng.choice([None, 5])) for i in range(300)]
    tied = [(i, rng.choice(["x", None]), 4, i % 4 or None) for i in range(300)]
    return {"mixed": mixed, "null key": one, "all tied": tied, "empty": []}


def in_key(data):
    """Rows of each key in order (at, id), NULL first."""
    groups = {}
    for r in sorted(data, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        groups.setdefault(r[1], []).append(r)
    return groups


@pytest.fixture(scope="module", params=list(shapes()))
def shape(spark, request):
    data = shapes()[request.param]
    return data, spark.createDataFrame(data, "id long, key string, at long, v int").repartition(3)


@pytest.mark.parametrize("slices", [None, 1, 2, 17])
def test_running_values_equal_brute_force(shape, slices):
    data, df = shape
    sliced = ordered.with_slices(df, ["key"], ["at", "id"], slices)
    order = (["key"], ["at", "id"])
    out = ordered.running_sum(sliced, *order, F.col("v"), "total")
    out = ordered.carry_last(out, *order, "v", "upto", True)
    out = ordered.carry_last(out, *order, "v", "before", False)
    out = ordered.previous(out, *order, ["id", "v"])
    got = ordered.unsliced(out).select("id", "total", "upto", "before", F.col("prev.id").alias("p"))
    want = []
    for group in in_key(data).values():
        total = last = prev = None
        for i, _, _, v in group:
            before, total = last, (total or 0) + v if v is not None else total
            last = last if v is None else v
            want.append((i, total, last, before, prev))
            prev = i
    assert rows(got, *got.columns) == sorted(want, key=repr)
    ranked = ordered.rank_in_key(df, ["key"], ["at", "id"], "n")
    assert rows(ranked, "id", "n") == sorted(
        ((r[0], n) for g in in_key(data).values() for n, r in enumerate(g, 1)), key=repr)


def test_slices_follow_each_other_and_cut_ties(spark):
    df = spark.range(1000).select(F.lit("k").alias("key"), F.lit(1).alias("at"))
    sliced = ordered.with_slices(df, ["key"], ["at"], 10)
    counts = [r["count"] for r in sliced.groupBy(ordered.SLICE).count().collect()]
    assert len(counts) > 5 and max(counts) < 300
    ranks = [r["n"] for r in ordered.running_sum(sliced, ["key"], ["at"], F.lit(1), "n").collect()]
    assert sorted(ranks) == list(range(1, 1001))


@pytest.mark.parametrize("start, stop", [(0, 10), (190, 450), (590, 5000), (0, 600), (5000, 6000)])
def test_rows_between(spark, start, stop):
    data = shapes()["mixed"]
    df = spark.createDataFrame(data, "id long, key string, at long, v int")
    want = [r[0] for r in sorted(data, key=lambda r: (r[2] is not None, r[2] or 0, r[0]))][start:stop]
    for slices in (None, 1, 13):
        got = ordered.rows_between(df, ["at", "id"], start, stop, slices).collect()
        assert sorted(r["id"] for r in got) == sorted(want)


@pytest.mark.parametrize("k", [0, 1, 57, 400, 999, 1000, 9000])
def test_kth_smallest_cut(spark, k):
    rng = random.Random(3)
    data = [(decimal.Decimal(rng.randrange(2**64)), rng.choice([0.1, 0.2, 0.2, 0.3])) for _ in range(1000)]
    df = spark.createDataFrame(data, "id decimal(20,0), s double")
    got = {r["id"] for r in df.where(ordered.kth_smallest_cut(df, "s", "id", k, 9)).collect()}
    assert got == {i for i, _ in sorted(data, key=lambda r: (r[1], r[0]))[:k]}


# ------------------------------------------------------------------ pacing

def brute_audit(requests):
    last, out = {}, {}
    for rid, dom, now, delay in sorted(requests, key=lambda r: (r[2], r[0])):
        late = dom in last and now - last[dom] < delay
        out[rid] = "delay" if late else "proceed"
        if not late:
            last[dom] = now
    return out


@pytest.mark.parametrize("slices", [None, 1, 7, 40])
@pytest.mark.parametrize("kind", ["mixed", "null key", "all tied", "long delay", "no delay"])
def test_politeness(spark, slices, kind):
    rng = random.Random(11)
    data = []
    for i in range(700):
        dom = None if kind == "null key" or i % 5 == 0 else ("hot" if i % 3 else f"d{i % 4}")
        at = 5.0 if kind == "all tied" else float(rng.randrange(1200)) / 4
        gap = {"long delay": 200.0, "no delay": 0.0}.get(kind, {"hot": 2.0}.get(dom, 7.5))
        data.append((i, dom, at, gap))
    df = spark.createDataFrame(data, "request_id long, domain string, seconds double, crawl_delay double")
    got = R.politeness_audit(df, slices=slices).collect()
    assert {r["request_id"]: r["action"] for r in got} == brute_audit(data) and len(got) == 700
    assert all(r["wait_seconds"] > 0 for r in got if r["action"] == "delay")


@pytest.mark.parametrize("gap", [1.0, 90.0, 5000.0])
def test_pacing_spreads_one_key_over_tasks(spark, monkeypatch, gap):
    """One key, every distinct time a possible entry: no task sees more than one slice of it."""
    data = [(i, "only", i * 0.5, gap) for i in range(2000)]
    df = spark.createDataFrame(data, "request_id long, domain string, seconds double, crawl_delay double").repartition(5)
    seen = spark.sparkContext.accumulator(0)
    plain = R._exits

    def watched(*args):
        run = plain(*args)

        def counted(group, pdf):
            if len(pdf) > 400:
                seen.add(1)
            return run(group, pdf)

        return counted

    monkeypatch.setattr(R, "_exits", watched)
    got = R.politeness_audit(df, slices=20).collect()
    assert {r["request_id"]: r["action"] for r in got} == brute_audit(data)
    assert seen.value == 0


# ------------------------------------------------------------------ robots

ROBOTS = {
    "a.com": "User-agent: *\nDisallow: /private\nDisallow: /*.pdf$\nCrawl-delay: 3\nSitemap: https://a.com/s.xml",
    "b.com": "User-agent: other\nDisallow: /\nUser-agent: bot\nDisallow: /b",
    "c.com": "User-agent: *\nDisallow:\nAllow: /x", "d.com": "", "e.com": "User-agent: *\r\nDisallow: /\r\n",
    "f.com": "User-agent: *\nUser-agent: other\nDisallow: /lost",
}


@pytest.mark.parametrize("url, allowed", [
    ("https://a.com/", True), ("https://a.com/private/x", False), ("https://a.com/d/x.pdf", False),
    ("https://a.com/d/x.pdf.html", True), ("https://a.com/?q=/private", True), ("https://b.com/b", False),
    ("https://b.com/c", True), ("https://c.com/x", True), ("https://d.com/x", True), ("https://e.com", False),
    ("https://f.com/lost", True), ("https://unknown.com/", True),
])
def test_robots(spark, url, allowed):
    robots = spark.createDataFrame(list(ROBOTS.items()), "domain string, text string")
    got = R.robots_check(spark.createDataFrame([(url,)], "url string"), robots).first()
    assert got["allowed"] is allowed
    assert R.robots_check(spark.createDataFrame([(url,)], "url string"), robots, ignore_robots=True).first()["allowed"]


def test_robots_values(spark):
    robots = spark.createDataFrame(list(ROBOTS.items()), "domain string, text string")
    a = R.parse_robots(robots).where("domain = 'a.com'").first()
    assert (a["crawl_delay"], a["sitemaps"]) == (3.0, ["https://a.com/s.xml"])
    named = R.parse_robots(robots, agents=("*", "other")).where("domain = 'f.com'").first()
    assert named["disallow"] == ["/lost"]


# ------------------------------------------------------------------ cache

@pytest.mark.parametrize("max_age, min_age, age, data, want", [
    (0, None, 5, True, "bypass"), (None, None, 5, True, "bypass"), (10, None, None, False, "miss"),
    (10, None, 5, True, "hit"), (10, None, 10, True, "stale"), (None, 10, None, False, "error"),
    (None, 10, 500, True, "hit"), (10, 10, None, False, "error"), (10, 5, 5, True, "hit"),
    (10, 5, 50, True, "stale"), (None, 5, 5, False, "error"),
])
def test_cache_matrix(spark, max_age, min_age, age, data, want):
    df = spark.createDataFrame([(max_age, min_age, age, data)], "a long, b long, c long, d boolean")
    assert df.select(C.decide(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("x")).first()["x"] == want


def test_cache_decision_sliced_equals_plain(spark):
    rng = random.Random(5)
    req = spark.createDataFrame(
        [(i, f"u{rng.randrange(3) * rng.randrange(2)}", rng.randrange(10**6), rng.choice([None, 0, 5000, 90000]), rng.choice([None, 7])) for i in range(800)],
        "request_id long, url string, ms long, max_age_ms long, min_age_ms long")
    ent = spark.createDataFrame(
        [(f"u{rng.randrange(3)}", i * 2000 + 1, 60000, i % 5 > 0) for i in range(400)],
        "url string, cached_ms long, ttl_ms long, has_data boolean")
    cols = ("request_id", "age_ms", "decision")
    assert rows(C.cache_decision(req, ent), *cols) == rows(C.cache_decision(req, ent, 9), *cols)


def test_history_and_ttl(spark):
    versions = [(i, "u", t, s) for i, (t, s) in enumerate([
        ("a", "http"), ("a", "http"), ("b", "http"), ("c", "http"), ("d", "http"), ("e", "http"), ("f", "adapter"), ("g", "http")])]
    df = spark.createDataFrame(versions, "seq long, url string, text string, source string")
    for size in (None, 4):
        h = C.freshness_history(df, "url", ["seq"], "text", size)
        got = {r["seq"]: (r["fetch_count"], r["change_count"], r["ttl"]) for r in C.adaptive_ttl(h).collect()}
        assert got == {0: (1, 0, 3600), 1: (2, 0, 7200), 2: (3, 1, 3600), 3: (4, 2, 3600), 4: (5, 3, 1800), 5: (6, 4, 1800), 7: (8, 6, 300)}


def test_ttl_policy(spark):
    urls = spark.createDataFrame([("https://news.a.com/x",), ("https://a.com",), ("https://b.com",)], "url string")
    policy = spark.createDataFrame([("a.com", 100), ("news.a.com", 30)], "pattern string, ttl int")
    got = {r["url"]: r["ttl"] for r in R.resolve_ttl(urls, policy).collect()}
    assert got == {"https://news.a.com/x": 60, "https://a.com": 100, "https://b.com": 3600}


# ------------------------------------------------------------------ dedup

def brute_canonical(pages, alias):
    kept, claimed, out = set(), set(), {}
    for pos, node, target in pages:
        dup = target is not None and (target in kept or (alias and target in claimed))
        out[pos] = dup
        if not dup:
            kept.add(node)
            if target:
                claimed.add(target)
    return out


@pytest.mark.parametrize("alias", [False, True])
def test_canonical_chains(spark, alias):
    rng = random.Random(2)
    pages, data = [], []
    for pos in range(300):
        target = rng.choice([None, pos - 1, rng.randrange(300), 0])
        target = None if target in (None, pos, -1) else f"https://h.com/p{target}"
        pages.append((pos, f"https://h.com/p{pos}", target))
        tag = f'<link rel="canonical" href="{target}/">' if target else "<p>"
        data.append((pos, f"https://h.com/p{pos}", tag))
    df = spark.createDataFrame(data, "pos long, url string, html string")
    got = D.mark_canonical_duplicates(df, "pos", alias_rule=alias).collect()
    assert {r["pos"]: r["canonical_duplicate"] for r in got} == brute_canonical(pages, alias)


def test_best_version(spark):
    from webstrata.operators import pages as P
    data = [
        ("a", 1, 0.1), ("a", 2, 0.5), ("a", 3, 0.9),  # the first acceptable tier, not the best score
        ("b", 1, 0.1), ("b", 2, 0.2), ("b", 3, 0.2),  # best effort: highest score, then the earlier tier
        ("c", 1, None), ("c", 2, 0.0), ("d", 4, None), (None, 2, 0.31),
    ]
    got = P.best_version(spark.createDataFrame(data, "url string, tier int, score double"), ["url"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        ("a", 2, 0.5, False), ("b", 2, 0.2, True), ("c", 1, None, False), ("d", 4, None, False), (None, 2, 0.31, False),
    ], key=str)


def test_content_layer(spark):
    df = spark.createDataFrame([(0, "a", "x"), (1, "b", "x"), (2, "c", " "), (3, "d", " "), (4, "e", "y")], "pos long, url string, md string")
    kept, dropped = D.dedup_content(df, "pos", "md")
    assert [r[0] for r in rows(kept, "pos")] == [0, 2, 3, 4]
    assert rows(dropped, "pos", "error_code") == [(1, "DUPLICATE_CONTENT")]


# ------------------------------------------------------------------ graph

def test_crawl_depth_and_scope(spark):
    site = {"/": ["/a", "/b", "https://sub.h.com/s", "https://ext.com/"], "/a": ["/a/1", "/b"], "/a/1": ["/a/1/z"], "/a/1/z": [], "/b": ["/missing"]}
    pages = spark.createDataFrame(
        [("https://h.com" + p, "".join(f'<a href="{x}">' for x in ls)) for p, ls in site.items()] + [("https://sub.h.com/s", "")],
        "url string, html string")
    def crawl(**kw):
        return {r["node"].removeprefix("https://"): r["depth"] for r in G.crawl("https://h.com", pages, G.CrawlOptions(**kw)).collect()}

    assert crawl(max_depth=2) == {"h.com/": 0, "h.com/a": 1, "h.com/b": 1, "h.com/a/1": 2}
    assert crawl(max_depth=1, allow_subdomains=True)["sub.h.com/s"] == 1
    assert len(crawl(max_depth=9, max_pages=3)) == 3
    assert "h.com/b" not in crawl(max_depth=3, exclude=("/b",))
    seeds = spark.createDataFrame([(0, "https://h.com/a/1/z"), (1, "https://h.com/tag/x")], "pos long, url string")
    got = G.crawl("https://h.com", pages, G.CrawlOptions(sitemap_mode="only"), seeds)
    assert rows(got, "node", "depth") == [("https://h.com/", 0), ("https://h.com/a/1/z", 0)]


# ------------------------------------------------------------------ sitemaps

def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    maps = [
        ("https://h/i.xml", f"<sitemapindex {ns}><sitemap><loc>https://h/1.xml</loc></sitemap><sitemap><loc>https://h/2.xml</loc></sitemap><sitemap><loc>https://h/i.xml</loc></sitemap></sitemapindex>"),
        ("https://h/1.xml", f"<urlset {ns}><url><loc> https://h/a#x </loc></url><url><loc>ftp://no</loc></url></urlset>"),
        ("https://h/2.xml", f"<urlset {ns}><url><loc>https://h/b</loc></url><url><loc>https://h/a</loc></url></urlset>"),
        ("https://h/bad.xml", "<urlset><url><loc>https://h/q"), ("https://h/t.txt", "https://h/text"),
    ]
    df = spark.createDataFrame(maps, "sitemap_url string, xml string")
    assert rows(L.parse_sitemaps(df), "sitemap_url", "url") == [
        ("https://h/1.xml", "https://h/a"), ("https://h/2.xml", "https://h/a"), ("https://h/2.xml", "https://h/b")]
    roots = spark.createDataFrame([("https://h/i.xml", 0)], "root_url string, pos int")
    assert [r["url"] for r in L.expand_sitemap_index(roots, df, limit=5).collect()] == ["https://h/a", "https://h/b"]


def test_pages_open_only_their_files(spark, tmp_path):
    rng = random.Random(5)
    data = [(i, None if i % 50 == 0 else rng.randrange(30), f"v{i}") for i in range(900)]
    df = spark.createDataFrame(data, "id long, k int, v string").repartition(4)
    table = L.store_pages(df, ["k", "id"], slices=9)
    assert table.rows == 900
    ordered_ids = [i for i, _, _ in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))]
    before = sorted(p.name for p in __import__("pathlib").Path(table.path).rglob("*.parquet"))
    for offset in (0, 37, 450, 880, 899, 900, 5000):
        page = table.page(offset, 40)
        assert page.columns == ["id", "k", "v", "next_offset"]
        rows_ = page.collect()
        assert sorted(r["id"] for r in rows_) == sorted(ordered_ids[offset:offset + 40])
        assert {r["next_offset"] for r in rows_} <= {offset + 40 if offset + 40 < 900 else None}
        assert len(page.inputFiles()) <= 2
    assert sorted(p.name for p in __import__("pathlib").Path(table.path).rglob("*.parquet")) == before


def test_write_llms_txt(spark, tmp_path):
    pages = spark.createDataFrame([(0, "s.com", "https://s.com/", "T", "D"), (1, "s.com", "https://s.com/u", "U", "")],
                                  "pos int, site string, url string, title string, description string")
    lines = L.llms_txt_lines(pages.withColumn("home", F.lit("https://s.com")), "site", "pos", "home", "2024-01-31", "X")
    L.write_llms_txt(lines, "site", str(tmp_path / "out"))
    text = "\n".join(r["value"] for f in sorted((tmp_path / "out" / "site=s.com").glob("part-*")) for r in spark.read.text(str(f)).collect())
    assert text.startswith("# s.com\n\n> Auto-generated by X.") and "- [T](https://s.com/): D\n- [U](https://s.com/u)\n" in text


# ------------------------------------------------------------------ search

def brute_top(x, q, k, groups=None):
    out = []
    for qi, qv, qg in q:
        s = [(-round(float(np.dot(qv, v) / (np.linalg.norm(qv) * np.linalg.norm(v))), 6), i) for i, v, g in x if groups is None or g == qg]
        out += [(qi, i, -a) for a, i in sorted(s)[:k]]
    return sorted(out)


@pytest.mark.parametrize("group", [None, "g"])
@pytest.mark.parametrize("lists,part_rows", [(256, 16_384), (5, 7), (1, 100)])
def test_vector_search(spark, lists, part_rows, group):
    rng = np.random.default_rng(4)
    x = [(i, rng.integers(-2, 3, 6).astype(float) + 0.5, i % 3) for i in range(500)]
    q = [(1000 + i, rng.integers(-2, 3, 6).astype(float) + 0.5, i % 3) for i in range(40)]
    xs = spark.createDataFrame([(i, v.tolist(), g) for i, v, g in x], "id long, embedding array<double>, g int")
    qs = spark.createDataFrame([(i, v.tolist(), g) for i, v, g in q], "query_id long, query_vector array<double>, g int")
    got = S.vector_search(xs, qs, 7, group=group, lists=lists, part_rows=part_rows).collect()
    want = brute_top(x, q, 7, group)
    assert [(a, b) for a, b, _ in want] == sorted((r["query_id"], r["id"]) for r in got) or sorted(
        (r["query_id"], round(r["similarity"], 5)) for r in got) == sorted((a, round(c, 5)) for a, _, c in want)


def test_vector_search_skips_lists(spark):
    """Well separated clusters: a query reads its own list and nothing else."""
    from webstrata.operators import nearest as N
    rng = np.random.default_rng(1)
    base = np.eye(20)
    x = [(i, (base[i % 20] + rng.normal(0, 0.01, 20)).tolist()) for i in range(2000)]
    xs = spark.createDataFrame(x, "id long, embedding array<double>")
    qs = spark.createDataFrame([(i, base[i].tolist()) for i in range(20)], "query_id long, query_vector array<double>")
    seen = spark.sparkContext.accumulator(0)
    scorer = N._scorer

    def counting(k):
        score = scorer(k)

        def run(held, queries):
            seen.add(len(held[0]) * len(queries))
            return score(held, queries)

        return run

    N._scorer = counting
    try:
        got = N.vector_search(xs, qs, 3).collect()
    finally:
        N._scorer = scorer
    assert {(r["query_id"], r["id"] % 20) for r in got} == {(i, i) for i in range(20)} and len(got) == 60
    assert seen.value < 2 * 20 * 100  # of 40,000 pairs


def test_vector_search_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows_ = [(1, [1.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [None, 1.0]), (6, [0.0, 0.0]), (7, [-1.0, 0.0]), (8, [])]
    xs = spark.createDataFrame([(i, v, None) for i, v in rows_], "id long, embedding array<double>, g string")
    qs = spark.createDataFrame([(i + 10, v, None) for i, v in rows_], "query_id long, query_vector array<double>, g string")
    for group in (None, "g"):
        got = sorted((r["query_id"], r["rank"], r["id"], r["similarity"]) for r in S.vector_search(xs, qs, 5, group=group).collect())
        assert got == [
            (11, 1, 1, 1.0), (11, 2, 6, 0.0), (11, 3, 7, -1.0), (16, 1, 1, 0.0), (16, 2, 6, 0.0), (16, 3, 7, 0.0),
            (17, 1, 7, 1.0), (17, 2, 6, 0.0), (17, 3, 1, -1.0),
        ]
    assert S.vector_search(xs.where("id = 2"), qs, 5).count() == 0
    assert S.vector_search(xs, qs.limit(0), 5).count() == 0


def test_vector_search_sends_a_query_once_to_a_shelf(spark, monkeypatch):
    """Random vectors, of which no list can be skipped: what is shuffled grows with shelves, not lists."""
    from webstrata.operators import nearest as N
    rng = np.random.default_rng(5)
    x = [(i, rng.normal(size=8), 0) for i in range(1000)]
    xs = spark.createDataFrame([(i, v.tolist()) for i, v, _ in x], "id long, embedding array<double>")
    qs = spark.createDataFrame([(i, v.tolist()) for i, v, _ in x[:100]], "query_id long, query_vector array<double>")
    sent, meet = [], N.meet

    def counting(held, streamed, *rest):
        sent.append(streamed.count())
        return meet(held, streamed, *rest)

    monkeypatch.setattr(N, "meet", counting)
    got = N.vector_search(xs, qs, 3).collect()
    assert sorted((r["query_id"], r["id"]) for r in got) == [(a, b) for a, b, _ in brute_top(x, x[:100], 3, None)]
    assert sum(sent) <= 2 * 100  # one shelf, searched first and for the rest
    near = sorted((r["query_id"], r["id"]) for r in N.vector_search(xs, qs, 3, least=0.8).collect())
    assert near == sorted((r["query_id"], r["id"]) for r in got if r["similarity"] >= 0.8)


def test_vector_search_starts_near_the_query(spark, monkeypatch):
    """Vectors of one cone, where nearly every list reaches around a query: few pairs are left for the exact comparison."""
    from webstrata.operators import nearest as N
    rng = np.random.default_rng(9)
    topics = rng.exponential(size=(40, 24))
    x = [(i, rng.poisson(3 * topics[i % 40] + 4).astype(float), 0) for i in range(6000)]
    xs = spark.createDataFrame([(i, v.tolist()) for i, v, _ in x], "id long, embedding array<double>")
    qs = spark.createDataFrame([(i, v.tolist()) for i, v, _ in x[:200]], "query_id long, query_vector array<double>")
    seen, exact = spark.sparkContext.accumulator(0), N._exact

    def counting(asked, units, row, col):
        seen.add(len(row))
        return exact(asked, units, row, col)

    monkeypatch.setattr(N, "_exact", counting)
    got = N.vector_search(xs, qs, 3).collect()
    assert sorted((r["query_id"], r["id"]) for r in got) == [(a, b) for a, b, _ in brute_top(x, x[:200], 3, None)]
    assert seen.value < 0.0045 * 200 * 6000


def test_vector_search_ties_of_copies_and_zero_vectors(spark):
    """More equal scores than k: the lowest ids are kept."""
    rng = np.random.default_rng(6)
    base = [rng.normal(size=5) for _ in range(4)] + [np.zeros(5)]
    x = [(i, base[i % 5].tolist()) for i in range(3000)]
    xs = spark.createDataFrame(x, "id long, embedding array<double>")
    qs = spark.createDataFrame([(i, base[i].tolist()) for i in range(5)], "query_id long, query_vector array<double>")
    got = sorted((r["query_id"], r["rank"], r["id"]) for r in S.vector_search(xs, qs, 4).collect())
    want = [(q, n + 1, q + 5 * n) for q in range(4) for n in range(4)] + [(4, n + 1, n) for n in range(4)]
    assert got == want


def test_embedding_counts_every_word_once(spark):
    """Counts by sorted codes equal counts word by word; a vector is computed once per row."""
    import hashlib
    texts = ["", None, "a", "b a b  c\n b", "x " * 300 + "y z", " ".join(f"w{i % 70}" for i in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for r in S.embed(df, F.col("t"), "e", dim=32, kind="double", max_chars=5000).collect():
        want = np.zeros(32)
        for w in (texts[r["i"]] or "").split():
            h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            want[h % 32] += 1 if h >= 2**31 else -1
        size = np.sqrt((want * want).sum())
        assert r["e"] == (want / size if size else want).tolist()
    filtered = S.embed(df, F.col("t"), "e").where("size(e) > 0 AND e IS NOT NULL AND forall(e, x -> x < 2)")
    assert filtered._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1


def test_one_group_holds_most_rows(spark):
    rng = np.random.default_rng(8)
    x = [(i, rng.normal(size=4), "hot" if i % 10 else f"u{i}") for i in range(600)]
    q = [(i, v, g) for i, v, g in x[:60]]
    xs = spark.createDataFrame([(i, v.tolist(), g) for i, v, g in x], "id long, embedding array<double>, g string")
    qs = spark.createDataFrame([(i, v.tolist(), g) for i, v, g in q], "query_id long, query_vector array<double>, g string")
    got = S.vector_search(xs, qs, 4, group="g", lists=8, part_rows=20).collect()
    assert sorted((r["query_id"], r["id"]) for r in got) == [(a, b) for a, b, _ in brute_top(x, q, 4, "g")]


def brute_keywords(docs, queries, k):
    import re
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    held = {i: split(t) for i, t in docs.items()}
    df = {}
    for ws in held.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    want = []
    for qi, text in queries.items():
        scores = []
        for i, ws in held.items():
            s = sum((1 + np.log(ws.count(w))) * np.log(1 + len(docs) / df[w]) for w in set(split(text)) if w in ws)
            if s:
                scores.append((-round(float(s), 6), i))
        want += [(qi, i, n + 1) for n, (_, i) in enumerate(sorted(scores)[:k])]
    return sorted(want, key=repr)


@pytest.mark.parametrize("block_docs", [512, 7, 1])
def test_keyword_search(spark, block_docs):
    # "the" is in every document; some words are rare, one document is long.
    vocabulary = ["the", "a", "fox", "dog", "cat", "sun"] + [f"w{i}" for i in range(40)]
    docs = {i: "the " + " ".join(random.Random(i).choices(vocabulary, k=30 if i else 3000)) for i in range(300)}
    docs |= {900: None, 901: "", 902: "--"}
    queries = {0: "fox dog", 1: "the sun", 2: "missing", 3: "cat", 4: "the", 5: "w1 W2 w3, the!", 6: None}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    q = spark.createDataFrame(list(queries.items()), "query_id long, query_text string")
    index = S.keyword_index(d, block_docs=block_docs)
    want = brute_keywords(docs, queries, 5)
    assert rows(S.search_index(index, q, 5), "query_id", "id", "rank") == want
    if block_docs == 7:
        assert rows(S.keyword_search(d, q, 5), "query_id", "doc_id", "rank") == want


def test_keyword_thresholds_skip_blocks(spark):
    """A block whose bound is below the threshold is not read again."""
    from webstrata.operators import keyword as K
    docs = [(i, "common " * (50 if i < 3 else 1) + "x") for i in range(400)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(1, "common")], "query_id long, query_text string")
    seen = spark.sparkContext.accumulator(0)
    scorer = K._scorer

    def counting(k, decimals):
        score = scorer(k, decimals)

        def run(held, queries):
            seen.add(1)
            return score(held, queries)

        return run

    K._scorer = counting
    try:
        got = K.search_index(K.keyword_index(d, block_docs=4), q, 3).collect()
    finally:
        K._scorer = scorer
    assert sorted(r["id"] for r in got) == [0, 1, 2]
    assert seen.value <= 18  # of about 100 blocks


def test_keyword_index_merges_batches_and_repeated_ids(spark):
    """Lists of many batches become one per block and word; rows of one id are one document."""
    from webstrata.operators import keyword as K
    rng = random.Random(12)
    docs = [(i % 170 if i % 170 else None, " ".join(rng.choices([f"w{j}" for j in range(25)], k=rng.randrange(12)))) for i in range(240)]
    docs += [(5000 + i, t) for i, t in enumerate((None, "", "--", "W1 w1, é1"))]
    want = {}
    for i, t in docs:
        for w in (t or "").lower().replace("--", "").replace(",", "").split():
            if i is not None:
                want.setdefault(w, {}).setdefault(i, 0)
                want[w][i] += 1
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        d = spark.createDataFrame(docs, "doc_id long, text string")
        index = K.keyword_index(d, block_docs=60)
        found = index.postings.collect()
        some = K.keyword_index(d, vocabulary=spark.createDataFrame([("w1",), ("w7",), ("none",)], "word string")).postings.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = {}
    for r in found:
        assert r["ids"] == sorted(set(r["ids"])) and r["top"] == max(r["tfs"])
        assert not set(got.setdefault(r["word"], {})) & set(r["ids"])
        got[r["word"]] |= dict(zip(r["ids"], r["tfs"], strict=True))
    assert got == want and index.documents == len(docs)
    assert len(found) == len({(r["block"], r["word"]) for r in found}) and len({r["block"] for r in found}) > 1
    assert {r["word"]: dict(zip(r["ids"], r["tfs"], strict=True)) for r in some} == {w: want[w] for w in ("w1", "w7")}


def test_keyword_queries_travel_as_numbers(spark, monkeypatch):
    """Bounds need no row per query, word and block; a query is one row of word numbers."""
    from webstrata.operators import keyword as K
    docs = {i: " ".join(random.Random(i).choices([f"w{j}" for j in range(60)], k=20)) for i in range(200)}
    queries = {q: " ".join(random.Random(-q).choices([f"w{j}" for j in range(70)], k=15)) for q in range(1, 30)}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    q = spark.createDataFrame(list(queries.items()), "query_id long, query_text string")
    sent, meet = [], K.meet

    def counting(held, streamed, keys, *rest):
        sent.append((keys, dict(streamed.dtypes)["terms"], streamed.count()))
        return meet(held, streamed, keys, *rest)

    monkeypatch.setattr(K, "meet", counting)
    got = K.search_index(K.keyword_index(d, block_docs=4), q, 3)
    assert rows(got, "query_id", "id", "rank") == brute_keywords(docs, queries, 3)
    assert {kind for _, kind, _ in sent} == {"array<bigint>"}
    (bounds,) = [n for keys, _, n in sent if keys == ["set"]]
    assert bounds <= 29 * K.BLOCKS_PER_CORE * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("dense,sums", [(0, 1 << 22), (2, 1 << 22), (2, 1), (1 / 128, 1 << 22)])
def test_keyword_scores_of_common_and_rare_words(monkeypatch, dense, sums):
    """Words summed by a matrix product, one by one, and in halves of the queries score the same."""
    import pyarrow as pa

    from webstrata.operators import keyword as K
    monkeypatch.setattr(K, "DENSE", dense)
    monkeypatch.setattr(K, "CHUNK_SUMS", sums)
    monkeypatch.setattr(K, "CHUNK_DOCS", 16)
    rng = np.random.default_rng(3)
    tf = rng.poisson(0.5, size=(12, 90)) * (rng.random((12, 90)) < np.linspace(0.02, 1, 12)[:, None])
    nos, idf = rng.permutation(12) * 10 + (1 << 33), rng.random(12) + 0.5
    held = pa.array([
        {"no": int(nos[w]), "idf": float(idf[w]), "ids": (np.flatnonzero(tf[w]) * 3 - 50).tolist(), "tfs": tf[w][tf[w] > 0].tolist()}
        for w in range(12) if tf[w].any()
    ], pa.struct([("no", pa.int64()), ("idf", pa.float64()), ("ids", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32()))]))
    asked = [rng.choice(12, size=n, replace=False) for n in (1, 3, 12, 5, 2, 8)]
    queries = pa.array([
        {"query_id": q, "edge": -np.inf if q % 2 else 1.0, "terms": [int(nos[w]) for w in ws] + [7]} for q, ws in enumerate(asked)
    ], pa.struct([("query_id", pa.int64()), ("edge", pa.float64()), ("terms", pa.list_(pa.int64()))]))
    got = K._scorer(4, 6)(K._held(held), queries).to_pylist()
    weight = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * idf[:, None]
    want = []
    for q, ws in enumerate(asked):
        score = np.round(weight[ws].sum(axis=0), 6)
        best = sorted((-s, d * 3 - 50) for d, s in enumerate(score) if s > 0 and (q % 2 or s >= 1.0))[:4]
        want += [(q, d, round(-s, 6)) for s, d in best]
    assert sorted((r["query_id"], r["id"], round(r["score"], 6)) for r in got) == sorted(want)


def test_hashed_vectors(spark):
    import hashlib
    texts = [None, "", "  ", "One one TWO", "a b c " * 200, "é ß\tx"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["e"] for r in S.embed(df, F.col("t"), "e", dim=32).collect()}
    for i, text in enumerate(texts):
        want = np.zeros(32)
        for w in (text or "")[:2000].lower().split():
            h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            want[h % 32] += 1 if h >= 2**31 else -1
        size = np.linalg.norm(want)
        assert np.allclose(got[i], want / size if size else want, atol=1e-6)


def test_overlap_score(spark):
    df = spark.createDataFrame(
        [("a b", "B c a"), ("a b", "x"), ("", "a"), (None, None), ("A  a", " a ")], "q string, t string"
    )
    assert [r[0] for r in df.select(S.overlap_score(F.col("q"), F.col("t"))).collect()] == [1.0, 0.0, 0.0, 0.0, 1.0]


def test_retrieve_rejects_unknown_mode():
    with pytest.raises(ValueError):
        S.retrieve("other", None, None, 5)


def test_retention_and_eviction(spark):
    assert I.eviction_count(10, 10) == 0
    assert I.eviction_count(300_000, 250_000) == 55_000
    now = 400 * I.DAY_MS
    df = spark.createDataFrame([("news", now, 0, 0), ("docs", 0, 500, 50), ("zzz", None, 0, 1)], "c string, t long, a long, n long")
    got = df.select(I.retention_score(F.col("c"), F.col("t"), F.col("a"), F.col("n"), F.lit(now)).alias("s")).collect()
    assert [r["s"] for r in got] == [0.3, round(1.2 * 0.1 + 1 + 1, 4), round(0.8 * 0.5 + 0.05, 4)]


# ------------------------------------------------------------------ citations, jobs, monitors

def test_eviction_keeps_every_row_once(spark):
    rng = random.Random(1)
    data = [(i, None if i % 60 == 7 else rng.randrange(20) / 10) for i in range(200)]
    kept, gone = I.evict(spark.createDataFrame(data, "id long, retention_score double"), 150)
    order = [i for i, _ in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))]
    assert sorted(r["id"] for r in gone.collect()) == sorted(order[:150])
    assert sorted(r["id"] for r in kept.collect()) == sorted(order[150:])


def test_citations(spark):
    answers = spark.createDataFrame([(1, "a [1] b [2](x) c [1] d [9] [2]"), (2, "none")], "answer_id long, text string")
    sources = spark.createDataFrame([(1, 1, "u1", "t1"), (1, 2, "u2", "t2"), (2, 1, "v", "w")], "answer_id long, idx int, url string, title string")
    assert rows(M.cite_inline(answers, sources), "idx", "url") == [(1, "u1"), (2, "u2")]
    texts, cited = M.cite_compact(answers, sources)
    assert rows(texts, "resolved_text") == [("a [1](u1) b [2](x) c [1](u1) d [9] [2](u2)",), ("none",)]
    texts, cited = M.resolve_citations(answers, sources)
    assert rows(texts, "resolved_text")[0] == ("a [1](u1) b [2](x) c [1] d [9] [2](u2)",)
    assert rows(cited, "idx", "marker_text", "resolved_text") == [(1, "[1]", "[1](u1)"), (2, "[2]", "[2](u2)")]


def test_rate_limit_parser():
    assert J.parse_limit("10/60s") == (10, 60) and J.parse_limit("5/30") == (5, 30)
    for bad in ("10", "a/b", "0/60s", "5/-1"):
        with pytest.raises(ValueError):
            J.parse_limit(bad)


def test_job_state_machine(spark):
    events = [(1, 1, "created"), (1, 2, "cancelled"), (1, 3, "completed"), (2, 1, "created"), (3, 1, "created"), (3, 2, "completed"), (3, 3, "failed")]
    df = spark.createDataFrame(events, "job long, ts long, event string")
    assert rows(J.job_status(df, "job", ["ts"]), "job", "status") == [(1, "cancelled"), (2, "processing"), (3, "completed")]


def test_changes_and_diff(spark):
    texts = ["", "a\nb", "a\nb", "a\nc", "", "z"]
    df = spark.createDataFrame([(i, "m", t) for i, t in enumerate(texts)], "seq long, m string, text string")
    for size in (None, 4):
        got = {r["seq"]: r for r in W.detect_changes(df, "m", "seq", "text", True, size).collect()}
        assert [got[i]["changed"] for i in range(6)] == [False, False, False, True, True, False]
        assert got[3]["diff"] == "--- previous\n+++ current\n@@ -1,2 +1,2 @@\n a\n-b+c"
        assert (got[3]["previous_length"], got[3]["current_length"]) == (3, 3)


def test_memory_walk(spark):
    memory = spark.createDataFrame([(1, [1.0, 0.0], 0, 100), (2, [0.99, 0.1], 0, 10**9), (3, [0.0, 1.0], 0, 10**9)],
                                   "id long, embedding array<double>, created_ms long, expires_ms long")
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, [-1.0, 0.3])], "query_id long, query_vector array<double>")
    got = {r["query_id"]: r for r in M.memory_query(queries, memory, 1000, 3600).collect()}
    assert (got[7]["hit"], got[7]["memory_id"], got[7]["freshness"]) == (True, 2, "fresh")
    assert (got[8]["hit"], got[8]["memory_id"]) == (False, None)


def test_threshold_alert_needs_hold(spark):
    from webstrata.operators import metrics as X
    data = [("q", i * 60_000_000, i, v) for i, v in enumerate([200, 200, 1, 200, 200, 200, 200, 200, 200, 200])]
    df = spark.createDataFrame(data, "l string, us long, id long, v int")
    got = X.threshold_alerts(df, "l", "us", "id", F.col("v") > 100, 300).collect()
    assert [(r["started_us"], r["fired_us"], r["samples"]) for r in got] == [(180_000_000, 480_000_000, 7)]


def test_no_cross_joins_in_registered_plans(spark, folder):
    """No registered batch query plans a Cartesian product or a nested-loop join."""
    import __spark_entry__ as entry
    from webstrata.plans.registry import BUILDERS

    names = [n for n in BUILDERS if "stream" not in n]
    for name in sorted(names):
        plan = entry.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


# ------------------------------------------------------------------ crawl limits, shared folder, feeds, CSV

def site(spark):
    pages = {"": "/a /b", "/a": "/c /d", "/b": "/d /e", "/c": "", "/d": "/f", "/e": "", "/f": ""}
    return spark.createDataFrame(
        [(f"https://h.com{p}", "".join(f'<a href="{x}">x</a>' for x in links.split())) for p, links in pages.items()],
        "url string, html string")


@pytest.mark.parametrize("limit, want", [
    (0, "ab cdef"), (1, " "), (2, "a "), (3, "ab "), (4, "abc "), (5, "abcd "), (6, "abcde "), (99, "abcdef ")])
def test_crawl_stops_in_queue_order(spark, limit, want):
    got = G.crawl("https://h.com", site(spark), G.CrawlOptions(max_depth=9, max_pages=limit)).collect()
    assert {r["node"].rsplit("/", 1)[1] for r in got} == {*want.replace(" ", ""), ""}


def test_crawl_seeds_count_and_come_first(spark):
    seeds = spark.createDataFrame([(0, "https://h.com/e"), (1, "https://h.com/f")], "pos long, url string")
    got = G.crawl("https://h.com", site(spark), G.CrawlOptions(max_pages=1), seeds).collect()
    assert [r["node"] for r in got] == ["https://h.com/f"]


def test_crawl_filters_see_addresses_as_written(spark):
    pages = spark.createDataFrame(
        [("https://h.com/", '<a href="/blog/">b</a><a href="/blog/x">x</a>'), ("https://h.com/blog/", ""), ("https://h.com/blog/x", "")],
        "url string, html string")
    got = G.crawl("https://h.com/", pages, G.CrawlOptions(include=("/", "/blog/*"))).collect()
    assert {r["node"] for r in got} == {"https://h.com/", "https://h.com/blog", "https://h.com/blog/x"}


def test_unsigned_ids_from_index_to_search(spark):
    ids = [decimal.Decimal(x) for x in (1, 2**63 - 1, 2**63, 2**64 - 1)]
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in ids], "id decimal(20,0), embedding array<float>")
    hits = S.vector_search(df, spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, query_vector array<float>"), 3)
    assert [r["id"] for r in hits.orderBy("rank").collect()] == ids[:3]
    kept, gone = I.evict(df.withColumn("retention_score", F.lit(0.5)), 3)
    assert (kept.count(), gone.count()) == (0, 4)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Nothing:
        def __getattr__(self, name):
            return lambda *a: self

        def isDefined(self):
            return False

    class Context:
        master, _jsc = "spark://host:7077", Nothing()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        checkpoint_root(Session())
