"""Sources, de-duplication, traversal, robots and cache queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from webstrata.functions import html as H
from webstrata.functions import quality as Q
from webstrata.functions import urls as U
from webstrata.operators import cache as C
from webstrata.operators import dedup as D
from webstrata.operators import graph as G
from webstrata.operators import ordered
from webstrata.operators import pages as P
from webstrata.operators import ranking
from webstrata.operators import robots as R
from webstrata.plans import ansi as A
from webstrata.plans.registry import query
from webstrata.plans.text_queries import RICH, links_sql, structural_sql
from webstrata.session import checkpoint_root
from webstrata.sources import sitemaps as S

# ------------------------------------------------------------------ flagship


def site_report(t):
    """Per-host report: normalise, extract, de-duplicate, score, aggregate.

    Each page is parsed once, in the scan stage, into a row of a few numbers.
    Both de-duplication layers are aggregates over those narrow rows, combined
    before their shuffle, so no page text moves and no copy group is gathered.
    """
    html, url = F.col("html"), F.col("url")
    parsed = U.compute_once(
        t.pages.select("page_id", "url", "html"),
        text=H.structural_text(html), title=H.page_title(html),
        n_links=F.size(H.page_links(html, url)),
    ).drop("html")
    rows = Q.assess_quality(parsed, "text", F.col("title")).select(
        "page_id", U.normalize_url(url).alias("url_key"),
        # Blank texts are nobody's copy.
        F.coalesce(D.content_hash(F.col("text")), F.col("page_id").cast("string")).alias("content_key"),
        U.hostname(url).alias("host"), "n_links", F.length("text").alias("chars"), "score",
    )
    row = F.struct("content_key", "host", "n_links", "chars", "score")
    by_url = rows.groupBy("url_key").agg(
        F.min("page_id").alias("page_id"), F.min_by(row, "page_id").alias("r")
    ).select("page_id", "r.*")
    by_text = by_url.groupBy("content_key").agg(
        F.min_by(F.struct("host", "n_links", "chars", "score"), "page_id").alias("r")
    ).select("r.*")
    return by_text.groupBy("host").agg(
        F.count("*").alias("pages"), F.sum("n_links").alias("links"), F.sum("chars").alias("chars"),
        F.round(F.avg("score"), 6).alias("mean_score"),
        F.sum(F.when(Q.quality_acceptable(F.col("score")), 1).otherwise(0)).alias("accepted"),
    )


from webstrata.plans.text_queries import GATES  # noqa: E402

query("site_report", f"""WITH {links_sql('SELECT page_id, url, html FROM pages')},
nl AS (SELECT page_id, count(*) AS n_links FROM links GROUP BY 1),
p AS (SELECT * FROM pages),
x AS (SELECT page_id, url, {A.host('url')} AS host, {A.normalize('url')} AS url_key, {structural_sql()} AS text,
 regexp_extract(html, {A.q(H.TITLE_PATTERN)}, 1) AS rt FROM p),
y AS (SELECT page_id AS doc_id, host, text, {A.decode(A.strip('rt'))} AS title,
 row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS r FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r2 FROM y WHERE r = 1),
d AS (SELECT * FROM z WHERE r2 = 1 OR trim(text) = ''), {GATES}
SELECT st.host, count(*) AS pages, sum(coalesce(n_links, 0)) AS links, sum(length(text)) AS chars,
 round(avg(score), 6) AS mean_score, sum(CASE WHEN score >= 0.3 THEN 1 ELSE 0 END) AS accepted
FROM st LEFT JOIN nl ON st.doc_id = nl.page_id GROUP BY 1""")(site_report)

# ------------------------------------------------------------------ sources


@query("src1_batch_pages", f"""WITH w AS (SELECT DISTINCT {A.normalize('url')} AS url_key FROM pages)
SELECT w.url_key, p.page_id, length(p.html) AS html_chars FROM w JOIN pages p ON {A.normalize('p.url')} = w.url_key""")
def src1_batch_pages(t):
    wanted = t.pages.select(U.normalize_url(F.col("url")).alias("url_key")).distinct()
    stored = t.pages.withColumn("url_key", U.normalize_url(F.col("url")))
    return stored.join(wanted, "url_key").select(
        "url_key", "page_id", F.length("html").alias("html_chars")
    )


SITEMAPS = """
SELECT 'https://s.example.com/map' || page_id || '.xml' AS sitemap_url, page_id,
 CASE WHEN page_id % 17 = 5 THEN '<urlset><url><loc>https://broken' WHEN page_id % 19 = 3 THEN 'https://text.example/only'
 WHEN page_id * 2 + 2 < (SELECT count(*) FROM {pages}) AND page_id < 7 THEN
  '<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><sitemap><loc> https://s.example.com/map' || (page_id * 2 + 1) ||
  '.xml </loc></sitemap><sitemap><loc>https://s.example.com/map' || (page_id * 2 + 2) || '.xml</loc></sitemap></sitemapindex>'
 ELSE '<?xml version="1.0"?><sm:urlset xmlns:sm="http://x"><sm:url><sm:loc>' || replace(url, '&', '&amp;') || '</sm:loc></sm:url><sm:url><sm:loc>https://s.example.com/p/' ||
  (page_id % 50) || '#f</sm:loc></sm:url><sm:url><sm:loc>ftp://no</sm:loc></sm:url></sm:urlset>' END AS xml FROM {pages}"""
_leaf = "NOT (page_id % 17 = 5 OR page_id % 19 = 3 OR (page_id * 2 + 2 < (SELECT count(*) FROM pages) AND page_id < 7))"


@query("src2_parse_sitemaps", f"""
SELECT 'https://s.example.com/map' || page_id || '.xml' AS sitemap_url, 0 AS pos, regexp_replace(url, '#.*$', '') AS url FROM pages WHERE {_leaf}
UNION ALL SELECT 'https://s.example.com/map' || page_id || '.xml', 1, 'https://s.example.com/p/' || (page_id % 50) FROM pages WHERE {_leaf}""")
def src2_parse_sitemaps(t):
    return S.parse_sitemaps(t.sql(SITEMAPS))


@query("src3_sitemap_index", f"""WITH RECURSIVE w AS (SELECT 0 AS id, 0 AS depth UNION
 SELECT w.id * 2 + c, w.depth + 1 FROM w, (SELECT 1 AS c UNION ALL SELECT 2) k
 WHERE w.depth < 3 AND w.id < 7 AND w.id * 2 + 2 < (SELECT count(*) FROM pages) AND NOT (w.id % 17 = 5 OR w.id % 19 = 3)),
l AS (SELECT p.* FROM pages p JOIN w ON p.page_id = w.id WHERE {_leaf})
SELECT DISTINCT url FROM (SELECT regexp_replace(url, '#.*$', '') AS url FROM l
UNION ALL SELECT 'https://s.example.com/p/' || (page_id % 50) FROM l)""")
def src3_sitemap_index(t):
    maps = t.sql(SITEMAPS)
    roots = maps.groupBy().agg(F.min("page_id").alias("first")).select(
        F.concat(F.lit("https://s.example.com/map"), F.col("first"), F.lit(".xml")).alias("root_url"),
        F.lit(0).alias("pos"),
    )
    return S.expand_sitemap_index(roots, maps).select("url")


ROBOTS = """SELECT page_id, 'site' || page_id || '.example.com' AS domain, CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'User-agent: *
Disallow: /en/1
Disallow: /*.html$
# comment
Allow: /en/2
Crawl-delay: ' || (page_id % 4) || '
Sitemap: https://site' || page_id || '.example.com/s1.xml' WHEN 2 THEN 'User-agent: other
Disallow: /
User-agent: bot
Disallow: /fr
Crawl-delay: bad
Crawl-delay: 2.5
sitemap: https://m' || page_id || '.example/x.xml
sitemap: https://m' || page_id || '.example/y.xml' WHEN 3 THEN 'Disallow: /before
user-agent: *
user-agent: googlebot
Disallow: /g
Sitemap: https://hidden.example/z.xml' WHEN 4 THEN 'User-Agent: *
Disallow:
Disallow: /a(b)+*c' ELSE 'User-agent: *
Disallow: /' END AS text FROM {pages}"""


@query("src4_discover_sitemaps", """WITH r AS (SELECT page_id, 'site' || page_id || '.example.com' AS domain FROM pages)
SELECT domain, k AS pos, CASE page_id % 6 WHEN 1 THEN 'https://' || domain || '/s1.xml'
 WHEN 2 THEN 'https://m' || page_id || '.example/' || CASE k WHEN 0 THEN 'x' ELSE 'y' END || '.xml'
 WHEN 3 THEN 'https://hidden.example/z.xml'
 ELSE 'https://' || domain || CASE k WHEN 0 THEN '/sitemap.xml' ELSE '/sitemap_index.xml' END END AS sitemap_url
FROM r, (SELECT 0 AS k UNION ALL SELECT 1) x WHERE NOT (page_id % 6 IN (1, 3) AND k = 1)""")
def src4_discover_sitemaps(t):
    return S.discover_sitemaps(t.sql(ROBOTS))


FEEDS = """SELECT page_id, '<rss xmlns:dc="http://d" xmlns:content="http://c"><channel><title>c</title><item><title>T' || page_id || '</title><link>https://f.example/p/' || page_id ||
 '</link><description>D &amp; d</description><dc:creator>C' || (page_id % 9) || '</dc:creator><pubDate>P</pubDate><content:encoded><![CDATA[<p>x</p>]]></content:encoded></item>' ||
 '<item><title>no link</title></item><item><link>https://f.example/q/' || page_id || '/</link></item></channel></rss>' AS feed_xml FROM {pages}"""


@query("src5_parse_feeds", """SELECT page_id, 0 AS pos, 'T' || page_id AS title, 'https://f.example/p/' || page_id AS link, 'D & d' AS description,
 'C' || (page_id % 9) AS creator, 'P' AS pub_date, '<p>x</p>' AS content FROM pages
UNION ALL SELECT page_id, 2, '', 'https://f.example/q/' || page_id || '/', NULL, NULL, NULL, NULL FROM pages""")
def src5_parse_feeds(t):
    return S.parse_feeds(t.sql(FEEDS), ["page_id"])


@query("src5_find_feed_item", """SELECT 'https://f.example/p/' || page_id || '/' AS url, 'https://f.example/p/' || page_id AS link FROM pages
UNION ALL SELECT 'https://other.example/s/q' || page_id || '?x=1', 'https://f.example/s/q' || page_id || '?y' FROM pages
UNION ALL SELECT 'https://z.example/' || page_id || '/index.html', 'https://g.example/' || min(page_id) OVER () || '/index.html' FROM pages""")
def src5_find_feed_item(t):
    items = t.sql("""SELECT page_id AS pos, 'https://f.example/p/' || page_id AS link FROM {pages}
      UNION ALL SELECT page_id, 'https://f.example/s/q' || page_id || '?y' FROM {pages}
      UNION ALL SELECT page_id, 'https://g.example/' || page_id || '/index.html' FROM {pages}
      UNION ALL SELECT page_id + 1000000000, 'https://f.example/p/' || page_id FROM {pages}""")
    wanted = t.sql("""SELECT 'https://f.example/p/' || page_id || '/' AS url FROM {pages}
      UNION ALL SELECT 'https://other.example/s/q' || page_id || '?x=1' FROM {pages}
      UNION ALL SELECT 'https://z.example/' || page_id || '/index.html' FROM {pages}""")
    return S.find_feed_items(items, wanted).select("url", "link")


QUOTED = """SELECT doc_id, lang, source, n_chars, 'say "' || source || '",' || chr(10) || text AS text FROM {documents}"""


@query("src6_csv_documents", f"SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha FROM ({QUOTED})")
def src6_csv_documents(t):
    folder = _scratch(t.spark, "csv")
    t.sql(QUOTED).write.options(**S.CSV_OPTIONS).csv(folder)
    rows = S.read_csv_documents(t.spark, folder, "doc_id long, lang string, source string, n_chars long, text string")
    return rows.select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha"))


def _scratch(spark, name: str) -> str:
    """New folder below the shared checkpoint folder (a local one in tests)."""
    import uuid

    return f"{checkpoint_root(spark).rstrip('/')}/webstrata-{name}-{uuid.uuid4().hex}"


LLMS = """SELECT page_id, url, 'Page ' || page_id AS title, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'About ' || page_id END AS description FROM {pages}"""
_host_of = A.host("url")


@query("src7_llms_txt", f"""WITH p AS (SELECT {_host_of} AS site, * FROM ({LLMS})),
s AS (SELECT site, min('https://' || site) AS home FROM p GROUP BY 1)
SELECT site, 1 AS part, page_id AS n, '- [' || title || '](' || url || ')' || CASE WHEN description <> '' THEN ': ' || description ELSE '' END AS line FROM p
UNION ALL SELECT site, 0, i, CASE i WHEN 0 THEN '# ' || site WHEN 2 THEN '> Auto-generated by Webstrata. This file helps AI agents discover and prioritize content on ' || home || '.' ELSE '' END
 FROM s, (SELECT unnest([0, 1, 2, 3]) AS i)
UNION ALL SELECT site, 2, i, CASE i WHEN 1 THEN '---' WHEN 2 THEN '> This llms.txt was auto-generated by Webstrata on 2024-01-31.' ELSE '' END
 FROM s, (SELECT unnest([0, 1, 2]) AS i)""")
def src7_llms_txt(t):
    p = t.sql(LLMS).withColumn("site", U.hostname(F.col("url"))).withColumn(
        "home", F.concat(F.lit("https://"), F.col("site"))
    )
    return S.llms_txt_lines(p, "site", "page_id", "home", "2024-01-31", "Webstrata")


@query("src8_paginate", """SELECT event_id, user_id, CASE WHEN 3000 + 1024 < (SELECT count(*) FROM events) THEN 4024 END AS next_offset
FROM events ORDER BY event_id LIMIT 1024 OFFSET 3000""")
def src8_paginate(t):
    return S.paginate(t.events.select("event_id", "user_id"), ["event_id"], offset=3000)


# ------------------------------------------------------------------ dedup


@query("d1_dedup_url", f"""SELECT min(page_id) AS page_id, {A.normalize('url')} AS url_key FROM
 (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000000, upper(left(url, 12)) || substr(url, 13) || '#again' FROM pages) GROUP BY 2""")
def d1_dedup_url(t):
    both = t.sql("""SELECT page_id, url FROM {pages} UNION ALL
      SELECT page_id + 1000000000, upper(substr(url, 1, 12)) || substr(url, 13) || '#again' FROM {pages}""")
    return D.dedup_url(both, ["page_id"]).select("page_id", "url_key")


COPIES = """SELECT doc_id, source AS url, text FROM {documents} UNION ALL
SELECT doc_id + 1000000000, source, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE 'copied page' END FROM {documents}"""


@query("d2_dedup_content", f"""WITH c AS ({COPIES}), r AS (SELECT doc_id, trim(text) <> '' AND
 row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS dup FROM c)
SELECT doc_id, CASE WHEN dup THEN 'duplicate_content' ELSE 'kept' END AS outcome FROM r""")
def d2_dedup_content(t):
    kept, dropped = D.dedup_content(t.sql(COPIES), "doc_id", "text")
    return kept.select("doc_id", F.lit("kept").alias("outcome")).unionByName(
        dropped.select("doc_id", F.col("error_type").alias("outcome"))
    )


# A page names page_id / 2 as canonical (chains), itself, or another host.
CANONICALS = """SELECT page_id, 'https://c.example.com/p/' || page_id || CASE WHEN page_id % 2 = 0 THEN '/' ELSE '' END AS url,
 CASE WHEN page_id % 7 = 6 THEN '<link rel="canonical" href="https://elsewhere.example.org/p/1">'
  WHEN page_id % 5 = 4 THEN '<link href="/p/' || page_id || '" rel=canonical>'
  WHEN page_id % 4 = 1 THEN '<link href=''/p/' || CAST(floor(page_id / 2) AS BIGINT) || ''' rel="canonical" />'
  ELSE '<link rel="canonical" href="/p/' || CAST(floor(page_id / 2) AS BIGINT) || '/">' END AS html,
 'text ' || (page_id % 90) AS text FROM {pages}"""
_edge = "page_id % 7 <> 6 AND page_id % 5 <> 4 AND page_id > 0"
CANON_SQL = f"""WITH RECURSIVE k AS (SELECT page_id, page_id AS at, 0 AS steps FROM pages UNION ALL
 SELECT k.page_id, CAST(floor(k.at / 2) AS BIGINT), steps + 1 FROM k WHERE k.at % 7 <> 6 AND k.at % 5 <> 4 AND k.at > 0),
c AS (SELECT page_id, max(steps) % 2 = 1 AS dup FROM k GROUP BY 1)"""


@query("d3_dedup_canonical", CANON_SQL + " SELECT page_id, dup AS canonical_duplicate FROM c")
def d3_dedup_canonical(t):
    return D.canonical_verdicts(t.sql(CANONICALS), "page_id").select("page_id", "canonical_duplicate")


@query("d4_dedup_all", CANON_SQL + """, m AS (SELECT page_id, dup, page_id % 90 AS h FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY dup, h ORDER BY page_id) AS r FROM m)
SELECT CASE WHEN dup THEN 'duplicate_canonical' WHEN r > 1 THEN 'duplicate_content' ELSE 'kept' END AS outcome, count(*) AS rows
FROM f GROUP BY 1""")
def d4_dedup_all(t):
    kept, dropped = D.dedup_all(t.sql(CANONICALS), "page_id", "text")
    rows = kept.select(F.lit("kept").alias("outcome")).unionByName(
        dropped.select(F.col("error_type").alias("outcome"))
    )
    return rows.groupBy("outcome").agg(F.count("*").alias("rows"))


RESULTS = """SELECT user_id AS query_id, event_id % 3 AS list_no, event_id AS pos, 'https://r.example/' || CAST(floor(value) AS BIGINT) AS url FROM {events}"""


@query("d5_merge_results", f"""WITH r AS ({RESULTS}), f AS (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY list_no, pos) AS a FROM r),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY list_no, pos) AS rank FROM f WHERE a = 1)
SELECT query_id, list_no, pos, url, rank FROM g WHERE rank <= 10""")
def d5_merge_results(t):
    return ranking.merge_results(t.sql(RESULTS), "query_id", ["list_no", "pos"], 10)


# ------------------------------------------------------------------ graph

# A site whose page n links to pages 2n+1 and 2n+2, up, and outside.
SITE = """SELECT page_id, 'https://site.example.com/p/' || page_id AS url, '<nav><a href="/p/' || (page_id * 2 + 1) || '#x">a</a><a href="' || (page_id * 2 + 2) ||
 '">b</a><a href="/p/' || CAST(floor(page_id / 2) AS BIGINT) || '/">up</a><a href="https://docs.site.example.com/d' || page_id || '">s</a><a href="http://10.0.0.1/' || page_id ||
 '">x</a><a href="https://ext.example.org/' || (page_id % 5) || '">e</a></nav>' || html AS html FROM {pages}"""
BFS_SQL = """WITH RECURSIVE e AS (SELECT page_id AS s, page_id * 2 + 1 AS d FROM pages UNION ALL SELECT page_id, page_id * 2 + 2 FROM pages
 UNION ALL SELECT page_id, CAST(floor(page_id / 2) AS BIGINT) FROM pages),
w AS (SELECT 0::BIGINT AS n, 0 AS depth UNION SELECT e.d, w.depth + 1 FROM w JOIN e ON w.n = e.s JOIN pages p ON p.page_id = e.d WHERE w.depth < {depth})
SELECT 'https://site.example.com/p/' || n AS node, min(depth) AS depth FROM w GROUP BY n"""


@query("g1_crawl", BFS_SQL.replace("{depth}", "5"))
def g1_crawl(t):
    return G.crawl("https://site.example.com/p/0", t.sql(SITE), G.CrawlOptions(max_depth=5))


# The same walk in queue order, by the level and then the link that found a node.
def _queue_sql(limit, seeds="SELECT 0::BIGINT AS n, 0::BIGINT AS o", keep="TRUE", depth=9, links=2):
    return f"""WITH RECURSIVE e AS (SELECT page_id AS s, page_id * 2 + 1 AS d, 0 AS pos FROM pages UNION ALL SELECT page_id, page_id * 2 + 2, 1 FROM pages
 UNION ALL SELECT page_id, CAST(floor(page_id / 2) AS BIGINT), 2 FROM pages), se AS ({seeds}),
w AS (SELECT n, 0 AS depth, [o] AS way FROM se UNION ALL
 SELECT e.d, w.depth + 1, list_append(w.way, e.pos) FROM w JOIN e ON w.n = e.s JOIN pages p ON p.page_id = e.d
 WHERE w.depth < {depth} AND e.pos < {links} AND ({keep})),
b AS (SELECT n, min(depth) AS depth, arg_min(way, (depth, way)) AS way FROM w GROUP BY n),
r AS (SELECT *, row_number() OVER (ORDER BY depth, way) AS r FROM b)
SELECT 'https://site.example.com/p/' || n AS node, depth FROM r {f'WHERE r <= {limit}' if limit else ''}"""


# Links up lead to pages already seen, so a page is found by its parent alone.
@query("g1_crawl_max_pages", _queue_sql(21))
def g1_crawl_max_pages(t):
    return G.crawl("https://site.example.com/p/0", t.sql(SITE), G.CrawlOptions(max_depth=9, max_pages=21))


@query("g1_crawl_filters", _queue_sql(None, keep="NOT contains(e.d::VARCHAR, '4')", depth=40))
def g1_crawl_filters(t):
    options = G.CrawlOptions(max_depth=40, max_pages=0, include=("/p/*",), exclude=("/p/*4*",))
    return G.crawl("https://site.example.com/p/0", t.sql(SITE), options)


@query("g3_sitemap_include", _queue_sql(30, depth=3, links=3, seeds="""SELECT page_id * 3 AS n, -page_id AS o FROM (SELECT page_id FROM pages ORDER BY 1 LIMIT 29)
 WHERE page_id > 0 AND page_id * 3 IN (SELECT page_id FROM pages) UNION ALL SELECT 0, 1"""))
def g3_sitemap_include(t):
    seeds = t.sql("SELECT page_id AS pos, 'https://site.example.com/p/' || (page_id * 3) AS url FROM {pages}")
    return G.crawl("https://site.example.com/p/0", t.sql(SITE), G.CrawlOptions(max_depth=3, max_pages=30), seeds)


@query("g3_sitemap_skip", _queue_sql(None, depth=4))
def g3_sitemap_skip(t):
    seeds = t.sql("SELECT page_id AS pos, 'https://site.example.com/p/' || (page_id * 3) AS url FROM {pages}")
    options = G.CrawlOptions(max_depth=4, max_pages=0, sitemap_mode="skip")
    return G.crawl("https://site.example.com/p/0", t.sql(SITE), options, seeds)


@query("g1_host_graph", f"""WITH RECURSIVE {links_sql('SELECT page_id, url, html FROM pages')},
hp AS (SELECT DISTINCT {A.host('url')} AS h, {A.path('dst_url')} AS p FROM links),
s AS (SELECT 'h:' || min(h) AS n FROM hp),
e AS (SELECT 'h:' || h AS s, 'p:' || p AS d FROM hp UNION ALL SELECT 'p:' || p, 'h:' || h FROM hp),
w AS (SELECT n, 0 AS depth FROM s UNION SELECT e.d, w.depth + 1 FROM w JOIN e ON w.n = e.s WHERE w.depth < 2)
SELECT n AS node, min(depth) AS depth FROM w GROUP BY 1""")
def g1_host_graph(t):
    links = P.extract_links(t.pages, ["page_id"])
    pairs = links.select(
        F.concat(F.lit("h:"), U.hostname(F.col("url"))).alias("host"),
        F.concat(F.lit("p:"), U.path(F.col("dst_url"))).alias("path"),
    ).distinct()
    pairs = G.cut_lineage(pairs)  # read twice: once per direction
    edges = pairs.select(F.col("host").alias("src"), F.col("path").alias("dst")).unionByName(
        pairs.select(F.col("path").alias("src"), F.col("host").alias("dst"))
    )
    start = pairs.agg(F.min("host").alias("node"))
    return G.traverse(start, edges, G.CrawlOptions(max_depth=2, max_pages=10**9))


SEEDS = """SELECT page_id AS pos, 'https://seed.example.com' || CASE page_id % 6 WHEN 0 THEN '/tag/' WHEN 1 THEN '/a/../b/' ELSE '/c/' END || (page_id % 31) AS url FROM {pages}"""


@query("g2_seed_frontier", f"""WITH s AS (SELECT * FROM ({SEEDS}) ORDER BY pos LIMIT 99),
k AS (SELECT pos, url, {A.normalize('url')} AS node FROM s WHERE NOT regexp_matches({A.path('url')}, {A.q(U.LOW_VALUE_REGEX)}))
SELECT node, arg_min(url, pos) AS url, -min(pos) AS queue_pos FROM k WHERE node <> 'https://seed.example.com/c/4' GROUP BY 1""")
def g2_seed_frontier(t):
    return G.seed_frontier("https://seed.example.com/c/4", t.sql(SEEDS), max_pages=100)


@query("g3_sitemap_only", f"""WITH s AS (SELECT page_id AS pos, 'https://site.example.com/p/' || (page_id * 3) AS url FROM pages)
SELECT DISTINCT s.url AS node, 0 AS depth FROM s JOIN pages p ON s.pos * 3 = p.page_id
UNION SELECT 'https://site.example.com/p/0', 0""")
def g3_sitemap_only(t):
    seeds = t.sql("SELECT page_id AS pos, 'https://site.example.com/p/' || (page_id * 3) AS url FROM {pages}")
    options = G.CrawlOptions(max_depth=4, max_pages=10**9, sitemap_mode="only")
    return G.crawl("https://site.example.com/p/0", t.sql(SITE), options, seeds)


@query("g4_expand_links", f"""WITH {links_sql(SITE)}, c AS (SELECT url AS src, dst_url, pos, {A.host('dst_url')} AS h FROM links),
k AS (SELECT *, CASE WHEN h = 'site.example.com' THEN 'internal' WHEN h LIKE '%.site.example.com' THEN 'subdomain' ELSE 'external' END AS link_class FROM c)
SELECT src, {A.normalize('dst_url')} AS dst, dst_url, link_class, CASE link_class WHEN 'internal' THEN 0 WHEN 'subdomain' THEN 1 ELSE 2 END AS class_rank, pos
FROM k WHERE h <> '10.0.0.1'""")
def g4_expand_links(t):
    options = G.CrawlOptions(allow_subdomains=True, allow_external=True)
    return G.expand_links(t.sql(SITE), "site.example.com", options)


@query("g5_map_site", f"""WITH {links_sql(SITE)}, k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS r FROM links
 WHERE {A.host('dst_url')} = 'site.example.com')
SELECT page_id, dst_url AS link, r - 1 AS pos FROM k WHERE r <= 4 AND contains(lower(dst_url), '/p/1')""")
def g5_map_site(t):
    return G.map_site(t.sql(SITE), ["page_id"], limit=4, search="/P/1").select("page_id", "link", "pos")


LINKLESS = SITE.replace("|| html AS html", "AS html").replace("'<nav>", "CASE WHEN page_id % 4 = 0 THEN '' ELSE '' END || '<nav>")
DISCOVER = f"""SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN '<p>none</p>' ELSE html END AS html FROM ({LINKLESS})"""


@query("g6_discover_pages", f"""WITH {links_sql(f"SELECT page_id, 'https://site.example.com' AS url, html FROM ({DISCOVER})")},
k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS r FROM links WHERE {A.host('dst_url')} = 'site.example.com')
SELECT page_id, dst_url AS page_url, r - 1 AS pos FROM k WHERE r <= 2
UNION ALL SELECT page_id, 'https://site.example.com/p/' || page_id, 0 FROM pages WHERE page_id % 4 = 0""")
def g6_discover_pages(t):
    return G.discover_pages(t.sql(DISCOVER), ["page_id"], 2).select("page_id", "page_url", "pos")


JOB_ROWS = """SELECT user_id AS job_id, event_id, CASE event_type WHEN 'click' THEN 'page' WHEN 'view' THEN 'queued' WHEN 'signup' THEN 'dedup' WHEN 'error' THEN 'error'
 ELSE CASE WHEN event_id % 2 = 0 THEN 'robots' ELSE 'filtered' END END AS kind,
 CASE event_id % 4 WHEN 0 THEN 'robots_blocked' WHEN 1 THEN 'timeout' ELSE 'http_error' END AS error_type, event_type <> 'error' AS success, ts FROM {events}"""


@query("g7_crawl_summary", f"""SELECT job_id, count(*) FILTER (kind IN ('page', 'queued', 'dedup')) AS total, count(*) FILTER (kind = 'page') AS completed,
 count(*) FILTER (kind IN ('error', 'dedup')) AS errors, count(*) FILTER (kind = 'robots') AS robots_blocked, count(*) FILTER (kind = 'filtered') AS filtered_out
 FROM ({JOB_ROWS}) GROUP BY 1""")
def g7_crawl_summary(t):
    return G.crawl_summary(t.sql(JOB_ROWS), "job_id", "kind")


@query("g8_first_successes", f"""WITH j AS ({JOB_ROWS}), r AS (SELECT job_id, event_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS rank FROM j WHERE success)
SELECT job_id, event_id, rank FROM r WHERE rank <= 3""")
def g8_first_successes(t):
    return ranking.first_successes(t.sql(JOB_ROWS), "job_id", ["ts", "event_id"], 3).select(
        "job_id", "event_id", "rank"
    )


@query("g9_error_report", f"""WITH j AS (SELECT * FROM ({JOB_ROWS}) WHERE NOT success)
SELECT job_id, 'errors' AS section, error_type, count(*) AS rows FROM j GROUP BY ALL
UNION ALL SELECT job_id, 'robots_blocked', error_type, count(*) FROM j WHERE error_type = 'robots_blocked' GROUP BY ALL""")
def g9_error_report(t):
    return G.error_report(t.sql(JOB_ROWS).where("NOT success").select("job_id", "error_type"), "job_id")


# ------------------------------------------------------------------ robots

P_RULES = """SELECT page_id, domain, k.kind, k.value, k.pos FROM (SELECT page_id, 'site' || page_id || '.example.com' AS domain FROM pages) r, LATERAL (
 SELECT 'disallow' AS kind, '/en/1' AS value, 0 AS pos WHERE page_id % 6 = 1 UNION ALL SELECT 'disallow', '/*.html$', 1 WHERE page_id % 6 = 1
 UNION ALL SELECT 'crawl_delay', (page_id % 4) || '.0', 0 WHERE page_id % 6 = 1
 UNION ALL SELECT 'sitemap', 'https://' || domain || '/s1.xml', 0 WHERE page_id % 6 = 1
 UNION ALL SELECT 'disallow', '/fr', 0 WHERE page_id % 6 = 2 UNION ALL SELECT 'crawl_delay', '2.5', 0 WHERE page_id % 6 = 2
 UNION ALL SELECT 'sitemap', 'https://m' || page_id || '.example/x.xml', 0 WHERE page_id % 6 = 2
 UNION ALL SELECT 'sitemap', 'https://m' || page_id || '.example/y.xml', 1 WHERE page_id % 6 = 2
 UNION ALL SELECT 'disallow', '/a(b)+*c', 0 WHERE page_id % 6 = 4 UNION ALL SELECT 'disallow', '/', 0 WHERE page_id % 6 = 5) k"""


@query("p1_parse_robots", f"SELECT domain, kind, value, pos FROM ({P_RULES})")
def p1_parse_robots(t):
    return R.robots_rules(t.sql(ROBOTS))


def regex_sql(p):
    esc = rf"regexp_replace({p}, '([.^$+?{{}}\[\]\\|()])', '\\\1', 'g')"
    return rf"'^' || regexp_replace(replace({esc}, '*', '.*'), '\\\$$', '$')"


@query("p2_robots_regex", f"SELECT domain, value, {regex_sql('value')} AS regex FROM ({P_RULES}) WHERE kind = 'disallow'")
def p2_robots_regex(t):
    return R.robots_rules(t.sql(ROBOTS)).where("kind = 'disallow'").select(
        "domain", "value", R.robots_regex(F.col("value")).alias("regex")
    )


VISITS = """SELECT page_id, 'https://site' || (page_id + CASE WHEN page_id % 5 = 0 THEN 1000000 ELSE 0 END) || '.example.com' || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN '/en/1x' WHEN 2 THEN '/fr?a.html' ELSE '/x.html' END AS url FROM {pages}
UNION ALL SELECT page_id + 500000, 'https://site' || page_id || '.example.com/a(b)+zzc?q=/en/1' FROM {pages}"""


@query("p3_robots_check", f"""WITH v AS ({VISITS}), h AS (SELECT page_id, url, {A.host('url')} AS host, CASE WHEN {A.path('url')} = '' THEN '/' ELSE {A.path('url')} END AS p FROM v),
r AS (SELECT domain, value, pos, {regex_sql('value')} AS rx FROM ({P_RULES}) WHERE kind = 'disallow'),
m AS (SELECT h.page_id, arg_min(r.value, r.pos) AS rule FROM h JOIN r ON h.host = r.domain AND regexp_matches(h.p, r.rx) GROUP BY 1)
SELECT h.page_id, h.url, m.rule, m.rule IS NULL AS allowed FROM h LEFT JOIN m ON h.page_id = m.page_id""")
def p3_robots_check(t):
    return R.robots_check(t.sql(VISITS), t.sql(ROBOTS)).select("page_id", "url", "rule", "allowed")


REQUESTS = """SELECT event_id AS request_id, 'host' || (user_id % 3) AS domain, event_id * 7 % 5 + event_id * 0.75 AS seconds, 20.0 + 10.0 * (user_id % 3) AS crawl_delay FROM {events}"""


@query("p4_politeness_audit", f"""WITH RECURSIVE r AS ({REQUESTS}),
w AS (SELECT domain, min(seconds) AS a FROM r GROUP BY 1 UNION ALL
 SELECT w.domain, min(r.seconds) FROM w JOIN r ON r.domain = w.domain AND r.seconds >= w.a + r.crawl_delay GROUP BY 1),
o AS (SELECT r.*, row_number() OVER (PARTITION BY r.domain, r.seconds ORDER BY request_id) AS k,
 (r.domain, r.seconds) IN (SELECT (domain, a) FROM w) AS hit FROM r),
v AS (SELECT o.request_id, o.domain, o.seconds, o.crawl_delay, hit AND k = 1 AS ok, w.a FROM o ASOF LEFT JOIN w ON o.domain = w.domain AND o.seconds >= w.a)
SELECT request_id, domain, CASE WHEN ok THEN 'proceed' ELSE 'delay' END AS action,
 CASE WHEN ok THEN 0 ELSE round(crawl_delay - (seconds - a), 6) END::DOUBLE AS wait_seconds FROM v""")
def p4_politeness_audit(t):
    req = t.sql(REQUESTS).select(
        "request_id", "domain", F.col("seconds").cast("double").alias("seconds"),
        F.col("crawl_delay").cast("double").alias("crawl_delay"),
    )
    return R.politeness_audit(req).select("request_id", "domain", "action", "wait_seconds")


POLICY = """SELECT 'example.com' AS pattern, 300 AS ttl UNION ALL SELECT 'example.org', 90000 UNION ALL SELECT 'example.net', 10
UNION ALL SELECT pattern, 1200 FROM (SELECT DISTINCT """ + "regexp_replace(regexp_replace(url, '^https?://', ''), '[/?#].*$', '') AS pattern FROM {pages} WHERE url LIKE '%://blog.%')"


@query("p5_resolve_ttl", f"""WITH p AS ({POLICY}), u AS (SELECT page_id, url, {A.host('url')} AS h FROM pages),
m AS (SELECT page_id, arg_max(ttl, length(pattern)) AS t FROM u JOIN p ON h = pattern OR ends_with(h, '.' || pattern) GROUP BY 1)
SELECT u.page_id, u.url, greatest(60, least(86400, CAST(trunc(coalesce(m.t, 3600) * 2.0) AS INTEGER))) AS ttl FROM u LEFT JOIN m ON u.page_id = m.page_id""")
def p5_resolve_ttl(t):
    return R.resolve_ttl(t.pages.select("page_id", "url"), t.sql(POLICY), factor=2.0)


# ------------------------------------------------------------------ cache

REQ = """SELECT event_id AS request_id, 'https://c.example/' || user_id AS url, ts, CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 3600000 WHEN 2 THEN 86400000 WHEN 3 THEN NULL ELSE 600000000 END AS max_age_ms,
 CASE event_id % 7 WHEN 0 THEN 1000 WHEN 1 THEN 5 ELSE 0 END AS min_age_ms FROM {events} WHERE event_type <> 'purchase'"""
ENT = """SELECT 'https://c.example/' || user_id AS url, ts, 43200000 * (1 + event_id % 9) AS ttl_ms, event_id % 11 <> 0 AS has_data FROM {events} WHERE event_type = 'purchase'"""


@query("c1_cache_decision", f"""WITH r AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM ({REQ})), e AS (SELECT *, epoch_us(ts) // 1000 AS cms FROM ({ENT})),
m AS (SELECT r.request_id, arg_max(struct_pack(cms := e.cms, ttl := e.ttl_ms, d := e.has_data), e.cms) AS x FROM r JOIN e ON r.url = e.url AND e.cms <= r.ms GROUP BY 1),
j AS (SELECT r.*, CASE WHEN r.ms < x.cms + greatest(1, x.ttl // 1000) * 1000 THEN r.ms - x.cms END AS age_ms, coalesce(x.d, false) AS d FROM r LEFT JOIN m ON r.request_id = m.request_id)
SELECT request_id, url, age_ms, CASE WHEN coalesce(max_age_ms, 0) = 0 AND coalesce(min_age_ms, 0) = 0 THEN 'bypass'
 WHEN age_ms IS NULL AND min_age_ms > 0 THEN 'error' WHEN age_ms IS NULL THEN 'miss' WHEN min_age_ms > 0 AND NOT d THEN 'error'
 WHEN max_age_ms > 0 AND age_ms >= max_age_ms THEN 'stale' ELSE 'hit' END AS decision FROM j""")
def c1_cache_decision(t):
    req = t.sql(REQ).withColumn("ms", ordered.epoch_ms(F.col("ts")))
    ent = t.sql(ENT).withColumn("cached_ms", ordered.epoch_ms(F.col("ts")))
    return C.cache_decision(req, ent)


NOW_MS = 1706000000000  # fixed clock of the report


@query("c2_live_entries", f"""SELECT url, epoch_us(ts) // 1000 AS cached_ms, ttl_ms FROM ({ENT})
WHERE {NOW_MS} < epoch_us(ts) // 1000 + greatest(1, ttl_ms // 1000) * 1000""")
def c2_live_entries(t):
    ent = t.sql(ENT).withColumn("cached_ms", ordered.epoch_ms(F.col("ts")))
    return C.live_entries(ent, F.lit(NOW_MS)).select("url", "cached_ms", "ttl_ms")


@query("c5_cache_age", f"SELECT url, {NOW_MS} - epoch_us(ts) // 1000 AS age_ms FROM ({ENT})")
def c5_cache_age(t):
    ent = t.sql(ENT).withColumn("cached_ms", ordered.epoch_ms(F.col("ts")))
    return C.cache_age_ms(ent, F.lit(NOW_MS)).select("url", "age_ms")


# Every document is fetched twice, the second time unchanged.
VERSIONS = """SELECT doc_id * 2 AS doc_id, source AS url, text FROM {documents} UNION ALL SELECT doc_id * 2 + 1, source, text FROM {documents}"""
HISTORY_SQL = f"""WITH v AS ({VERSIONS}), h AS (SELECT doc_id, url, sha256(text) AS content_hash FROM v),
l AS (SELECT *, lag(content_hash) OVER w AS p, row_number() OVER w AS fetch_count, min(doc_id) OVER (PARTITION BY url) AS first_fetched FROM h WINDOW w AS (PARTITION BY url ORDER BY doc_id)),
s AS (SELECT *, sum(CASE WHEN p <> content_hash THEN 1 ELSE 0 END) OVER (PARTITION BY url ORDER BY doc_id) AS change_count FROM l)"""


@query("c3_freshness_history", HISTORY_SQL + " SELECT doc_id, url, content_hash, fetch_count, first_fetched, change_count FROM s")
def c3_freshness_history(t):
    return C.freshness_history(t.sql(VERSIONS), "url", ["doc_id"], "text").select(
        "doc_id", "url", "content_hash", "fetch_count", "first_fetched", "change_count"
    )


@query("c4_adaptive_ttl", HISTORY_SQL + """ SELECT doc_id, url, change_count, CASE WHEN change_count >= 5 THEN least(300, t) ELSE t END AS ttl FROM (SELECT *, CAST(CASE WHEN change_count = 0 AND p IS NOT NULL THEN 7200 WHEN change_count >= 3 THEN 1800 ELSE 3600 END AS INTEGER) AS t FROM s)""")
def c4_adaptive_ttl(t):
    history = C.freshness_history(t.sql(VERSIONS), "url", ["doc_id"], "text")
    return C.adaptive_ttl(history).select("doc_id", "url", "change_count", "ttl")
