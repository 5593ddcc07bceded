"""URL queries: normalisation, classes, filters, scores, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from webstrata.functions import urls as U
from webstrata.operators import ranking
from webstrata.plans import ansi as A
from webstrata.plans.registry import query

# Page URLs plus harder spellings made from the page key.
URLS = """
SELECT page_id, 0 AS v, url FROM {pages}
UNION ALL SELECT page_id, 1, 'HTTPS://User@Site' || (page_id % 97) ||
  '.Example.COM:443/A/./b/../C' || page_id || '/?z=1&b=2&a=' || page_id || '#Top' FROM {pages}
UNION ALL SELECT page_id, 2, 'http://site' || (page_id % 97) ||
  '.example.com:8080//x//y/../../../w/;p=' || page_id || '?q' FROM {pages}
UNION ALL SELECT page_id, 3, CASE page_id % 12
  WHEN 0 THEN 'https://docs.python.org/tag/' WHEN 1 THEN 'https://www.youtube.com/watch?v=abcdefghijk&n='
  WHEN 2 THEN 'http://en.wikipedia.org/wiki/P/' WHEN 3 THEN 'https://github.com/apache/spark'
  WHEN 4 THEN 'https://www.reuters.com/page/' WHEN 5 THEN 'https://old.reddit.com/search/'
  WHEN 6 THEN 'https://mit.edu/Login/' WHEN 7 THEN 'https://m.youtube.com'
  WHEN 8 THEN 'https://api.site.gov/Authors/' WHEN 9 THEN 'https://x.substack.com/p/?utm_id='
  WHEN 10 THEN 'https://nvd.nist.gov/vuln/detail/CVE-2024-1' ELSE 'https://1.2.3.4:9/f/' END || page_id
  FROM {pages}
UNION ALL SELECT page_id, 4, 'http://' || (page_id % 256) || '.' || ((page_id * 7) % 256) ||
  '.' || (page_id % 3) || '.1/x?k=' || page_id FROM {pages}
UNION ALL SELECT page_id, 5, 'relative/path' || page_id || '#frag' FROM {pages}
"""
SQL_URLS = f"WITH u AS ({URLS}) "


def _simple(name, columns, sql_columns):
    """Query that projects expressions over the URL set."""

    @query(name, SQL_URLS + f"SELECT page_id, v, url, {sql_columns} FROM u")
    def _build(t):
        u = F.col("url")
        return t.sql(URLS).select("page_id", "v", "url", *columns(u))


_simple(
    "u1_normalize_url",
    lambda u: [U.normalize_url(u).alias("key"), U.normalize_url(u, True).alias("key_no_query")],
    f"{A.normalize('url')} AS key, {A.normalize('url', True)} AS key_no_query",
)

_low_path = f"lower({A.path('url')})"
_low_query = f"lower({A.query('url')})"
_simple(
    "u2_cache_url",
    lambda u: [U.cache_url(u).alias("key"), U.url_sha(U.cache_url(u)).alias("key_sha")],
    f"""{A.scheme('url')} || '://' || lower({A.netloc('url')}) ||
    CASE WHEN {_low_path} = '/' THEN '/' ELSE regexp_replace({_low_path}, '/+$', '') END ||
    {A.prefixed('?', A.sort_params(_low_query))} || {A.prefixed('#', A.fragment('url'))} AS key,
    sha256(key) AS key_sha""",
)

_simple(
    "u3_extract_domain",
    lambda u: [U.extract_domain(u).alias("host"), U.extract_domain(u, True).alias("origin")],
    f"""{A.host('url')} AS host, CASE WHEN host = '' THEN '' ELSE {A.scheme('url')} || '://' ||
    host || {A.prefixed(':', A.port('url'))} END AS origin""",
)


@query("u4_same_origin", SQL_URLS + f"""
SELECT a.page_id, a.v, {A.scheme('a.url')} = {A.scheme('b.url')} AND
  lower({A.netloc('a.url')}) = lower({A.netloc('b.url')}) AS same_origin
FROM u a JOIN u b ON a.page_id = b.page_id AND b.v = 0""")
def u4_same_origin(t):
    u = t.sql(URLS)
    first = u.where("v = 0").select("page_id", F.col("url").alias("first_url"))
    return u.join(first, "page_id").select(
        "page_id", "v", U.is_same_origin(F.col("url"), F.col("first_url")).alias("same_origin")
    )


_num = " + ".join(
    f"CAST(split_part(h, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4)
)
_blocks = " OR ".join(
    f"n BETWEEN {U.v4_to_int(f)} AND {U.v4_to_int(f) + 2 ** (32 - b) - 1}"
    for f, b in U.PRIVATE_V4_BLOCKS
)
U5_SQL = SQL_URLS + f""", h AS (SELECT page_id, v, url, {A.host('url')} AS h FROM u),
n AS (SELECT *, CASE WHEN regexp_matches(h, {A.q(U.V4_PATTERN)}) THEN {_num} END AS n FROM h)
SELECT page_id, v, url, CASE WHEN h = '' OR h LIKE '%.docker.internal' THEN true
  WHEN n IS NOT NULL THEN ({_blocks}) OR {A.in_list('h', U.METADATA_V4)}
  ELSE false END AS private FROM n"""


@query("u5_private_host", U5_SQL)
def u5_private_host(t):
    return t.sql(URLS).select(
        "page_id", "v", "url", U.is_private_host(F.col("url")).alias("private")
    )


_cls = f"""CASE WHEN {A.host('url')} IN ('', 'example.com') THEN 'internal'
  WHEN {A.host('url')} LIKE '%.example.com' THEN 'subdomain' ELSE 'external' END"""
_simple(
    "u6_classify_link",
    lambda u: [U.classify_link(u, F.lit("Example.com")).alias("link_class")],
    f"{_cls} AS link_class",
)


@query("u7_filter_links", SQL_URLS + f"""
SELECT page_id, v, url FROM u WHERE {_cls} IN ('internal', 'subdomain')""")
def u7_filter_links(t):
    u = t.sql(URLS)
    return u.where(U.in_scope(F.col("url"), F.lit("example.com"), subdomains=True))


INCLUDE = ["/en/**", "/fr/*", "/wiki/?/*"]
EXCLUDE = ["/en/2*", "**.html"]
_inc = " OR ".join(f"regexp_matches(p, {A.q(U.glob_to_regex(g))})" for g in INCLUDE)
_exc = " OR ".join(f"regexp_matches(p, {A.q(U.glob_to_regex(g))})" for g in EXCLUDE)
_PATHS = SQL_URLS + f", p AS (SELECT *, {A.path('url')} AS p FROM u) "


@query("u8_match_path", _PATHS + f"SELECT page_id, v, url FROM p WHERE NOT ({_exc}) AND ({_inc})")
def u8_match_path(t):
    return t.sql(URLS).where(U.match_path(F.col("url"), INCLUDE, EXCLUDE))


@query("u9_glob_regex", SQL_URLS + """
SELECT page_id, v, url FROM u WHERE regexp_matches(url, '^https://[^/]*\\.example\\.org/.*/.[0-9]*$')""")
def u9_glob_regex(t):
    glob = U.glob_to_regex("https://*.example.org/**/?") [:-1] + "[0-9]*$"
    return t.sql(URLS).where(F.col("url").rlike(glob))


@query("u10_filter_reason", _PATHS + f"""
SELECT page_id, v, url, CASE WHEN {_exc} THEN 'exclude_paths' ELSE 'include_paths' END AS reason,
  CASE {' '.join(f"WHEN regexp_matches(p, {A.q(U.glob_to_regex(g))}) THEN {A.q(g)}" for g in EXCLUDE)} END AS pattern
FROM p WHERE ({_exc}) OR NOT ({_inc})""")
def u10_filter_reason(t):
    why = U.filter_reason(F.col("url"), INCLUDE, EXCLUDE)
    return t.sql(URLS).withColumn("why", why).where("why IS NOT NULL").select(
        "page_id", "v", "url", "why.reason", "why.pattern"
    )


U11 = """SELECT page_id, url, url || '/child' AS link FROM {pages}
UNION ALL SELECT page_id, url, 'https://other.example.org/z' || page_id FROM {pages}
UNION ALL SELECT page_id, url, url FROM {pages}"""


@query("u11_child_paths", f"""WITH l AS ({U11}),
p AS (SELECT *, regexp_replace({A.path('url')}, '/+$', '') || '/' AS pre, {A.path('link')} AS lp FROM l)
SELECT page_id, url, link FROM p WHERE {A.host('url')} <> {A.host('link')} OR
 (starts_with(CASE WHEN lp = '' THEN '/' ELSE lp END, pre) AND lp <> rtrim(pre, '/'))""")
def u11_child_paths(t):
    return t.sql(U11).where(U.is_child_path(F.col("link"), F.col("url")))


_low_value = f"regexp_matches({A.path('url')}, {A.q(U.LOW_VALUE_REGEX)})"
_simple(
    "u12_low_value_url",
    lambda u: [U.is_low_value_url(u).alias("low_value")],
    f"{_low_value} AS low_value",
)

_h, _p = A.host("url"), f"lower({A.path('url')})"


def _pt(test, value):
    return f"CASE WHEN {test} THEN {value} ELSE 0 END"


SCORE_SQL = f"""CASE WHEN {A.any_of(_p, U.SKIP_PATHS)} THEN -9999
 WHEN contains({A.query('url')}, 'utm_') THEN -5000 ELSE
 {_pt(f"{_h} LIKE '%.edu'", 2)} + {_pt(A.any_of(_h, ['wikipedia.org']), 2)} +
 {_pt(A.any_of(_h, ['github.com']), 2)} + {_pt(A.any_of(_h, ['youtube.com', 'youtu.be']), 2)} +
 {_pt(A.any_of(_h, U.HIGH_QUALITY_HOSTS), 2)} +
 {_pt(f"{_h} LIKE '%.gov' OR {_h} LIKE '%.org'", 1)} + {_pt(A.any_of(_h, U.KNOWN_BLOGS), 1)} +
 {_pt(A.any_of(_h, U.LOW_QUALITY_HOSTS), -1)} +
 CASE WHEN length({_p}) - length(replace({_p}, '/', '')) >= 2 THEN 1
   WHEN {_p} IN ('', '/') THEN -1 ELSE 0 END END"""
_simple("u13_score_url", lambda u: [U.score_url(u).alias("score")], f"{SCORE_SQL} AS score")


@query("u14_rank_urls", SQL_URLS + f""", s AS (SELECT v AS query_id, page_id, url, {SCORE_SQL} AS score FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS rank
  FROM s WHERE score > -1000)
SELECT query_id, page_id, url, score, rank FROM r WHERE rank <= 20""")
def u14_rank_urls(t):
    u = t.sql(URLS).withColumnRenamed("v", "query_id")
    return ranking.rank_urls(u, "query_id", "page_id", max_urls=20)


_video = f"({A.in_list(_h, U.VIDEO_HOSTS)} OR {A.in_list(f'regexp_replace({_h}, {A.q(chr(94) + 'www.')}, {A.q('')})', U.VIDEO_HOSTS)})"
_simple(
    "u15_video_platform", lambda u: [U.is_video_platform(u).alias("video")], f"{_video} AS video"
)


@query("u16_pick_sources", SQL_URLS + f""", s AS (SELECT page_id AS query_id, v AS pos, url, {_video} AS video,
  (page_id + v) % 3 <> 0 AS success FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY video, pos) AS rank FROM s WHERE success)
SELECT query_id, pos, url, video, rank FROM r WHERE rank <= 2""")
def u16_pick_sources(t):
    u = t.sql(URLS).select(
        F.col("page_id").alias("query_id"), F.col("v").alias("pos"), "url",
        ((F.col("page_id") + F.col("v")) % 3 != 0).alias("success"),
    )
    return ranking.pick_sources(u, "query_id", "pos", min_sources=2)


_loc = f"regexp_replace(lower({A.netloc('url')}), '^www\\.', '')"
CATEGORY_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches({_loc}, {A.q(rx)}) THEN {A.q(c)}" for c, rx in U.category_rules()
) + " ELSE 'unknown' END"
_simple(
    "u17_domain_category",
    lambda u: [U.domain_category(u).alias("category")],
    f"{CATEGORY_SQL} AS category",
)

ROUTES = [
    (r"^https?://(?:www\.)?github\.com/", "code_host", 200),
    (r"^https?://[^/]+/en/", "english", 100),
    (r"^https?://blog\.", "blog", 150),
    (r"youtube\.com/watch", "video", 200),
    (r"/vuln/detail/CVE-", "vulnerability", 200),
]
_routes = sorted(ROUTES, key=lambda r: -r[2])
_simple(
    "u18_route_urls",
    lambda u: [U.route_url(u, ROUTES).alias("handler")],
    "CASE " + " ".join(f"WHEN regexp_matches(url, {A.q(p)}) THEN {A.q(h)}" for p, h, _ in _routes)
    + " ELSE 'generic' END AS handler",
)


@query("u19_extract_entities", SQL_URLS + " SELECT page_id, v, kind, value FROM (" + " UNION ALL ".join(
    f"SELECT page_id, v, '{k}' AS kind, regexp_extract(url, {A.q(rx)}, 1) AS value FROM u"
    for k, rx in U.ENTITY_PATTERNS) + ") WHERE value <> ''")
def u19_extract_entities(t):
    return t.sql(URLS).select(
        "page_id", "v", F.inline(U.extract_entities(F.col("url")))
    )


def _names(table, col):
    return "CASE " + " ".join(f"WHEN {col} = {A.q(k)} THEN {A.q(v)}" for k, v in table.items()) + f" ELSE {col} END"


@query("u20_translate_categories", f"""
WITH n AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'web' WHEN 1 THEN 'video' WHEN 2 THEN 'news'
  WHEN 3 THEN lang ELSE '' END AS s, CASE doc_id % 4 WHEN 0 THEN 'research' WHEN 1 THEN 'github'
  WHEN 2 THEN 'pdf' ELSE '' END AS c FROM documents),
m AS (SELECT doc_id, {_names(U.SOURCE_NAMES, 's')} AS s, {_names(U.CATEGORY_NAMES, 'c')} AS c FROM n)
SELECT doc_id, CASE WHEN s = '' AND c = '' THEN 'general' WHEN s = '' THEN c
  WHEN c = '' OR c = s THEN s ELSE s || ',' || c END AS categories FROM m""")
def u20_translate_categories(t):
    s = F.expr("CASE doc_id % 5 WHEN 0 THEN 'web' WHEN 1 THEN 'video' WHEN 2 THEN 'news' WHEN 3 THEN lang ELSE '' END")
    c = F.expr("CASE doc_id % 4 WHEN 0 THEN 'research' WHEN 1 THEN 'github' WHEN 2 THEN 'pdf' ELSE '' END")
    return t.documents.select(
        "doc_id",
        F.array_join(U.translate_categories(F.array(s), F.array(c)), ",").alias("categories"),
    )


U21 = "SELECT page_id, url, CASE page_id % 9 " + " ".join(
    f"WHEN {i} THEN '{h}'" for i, h in enumerate([
        "../up/./page", "/root//x/", "//cdn.example.net/lib.js", "?only=query", "#frag",
        "https://abs.example.com/a/../b", "plain.html?x=1#y", "", ])
) + " ELSE './' END AS href FROM {pages}"


@query("u21_resolve_url", f"WITH r AS ({U21}) SELECT page_id, url, href, {A.resolve('href', 'url')} AS resolved FROM r")
def u21_resolve_url(t):
    return t.sql(U21).select(
        "page_id", "url", "href", U.resolve_url(F.col("href"), F.col("url")).alias("resolved")
    )
