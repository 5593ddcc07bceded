"""HTML, text, quality and barrier queries over pages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from webstrata.functions import html as H
from webstrata.functions import quality as Q
from webstrata.functions import urls as U
from webstrata.operators import pages as P
from webstrata.plans import ansi as A
from webstrata.plans.registry import query

# Pages whose head carries the tags that the stored pages lack, built from the
# page key and the stored markup.
RICH = """
SELECT page_id, url, '<html lang="' || CASE page_id % 3 WHEN 0 THEN 'en-GB' WHEN 1 THEN 'fr' ELSE 'de-x' END ||
 '"><head><title> T' || page_id || ' &amp; more </title><base href="https://base' || (page_id % 7) || '.example.com/dir/">' ||
 '<meta name="description" content=" About ' || page_id || ' "><meta name=''author'' content=''A' || (page_id % 5) || '''>' ||
 '<meta property="og:title" content="OG ' || page_id || '"><meta property="og:image" content="/i' || page_id || '.png">' ||
 '<meta property="og:image" content="/j.png"><meta property="og:empty" content="">' ||
 '<meta property="og:description" content="ogd ' || page_id || '">' ||
 '<meta name="twitter:card" content="summary"><meta name="twitter:card" content="large' || (page_id % 2) || '">' ||
 '<meta property="article:published_time" content="2024-01-0' || (1 + page_id % 9) || '">' ||
 '<link rel="canonical" href="/en/' || (page_id % 40) || '">' ||
 '<script type="application/ld+json"> {"@type":"Article","name":"N' || page_id || '"} </script>' ||
 '<script type=''application/ld+json''>{"@graph":[{"@type":"A","n":' || page_id || '},{"@type":"B"}]}</script>' ||
 '<script type="application/ld+json">{broken</script></head><body><header>Head</header><img src="/a' || page_id ||
 '.png" alt=" Alt " width="10" height="x"><img src="data:image/png;base64,AA"><img alt="none">' ||
 '<pre><code>x = ' || page_id || '</code></pre><p>Use <code>y</code> and <code>y</code></p>' ||
 '<iframe src="https://arxiv.org/pdf/' || page_id || '.pdf"></iframe><div class="hero big">Hero</div><aside>Side</aside>' ||
 '<a href="../up">u</a><a href="mailto:a@b.c">m</a><a href="#x">h</a><a href="Q?a=1#z">q</a>' || html || '</body></html>' AS html
FROM {pages}
"""
SQL_RICH = f"WITH p AS ({RICH}) "

_hrefs = (
    f"list_filter(list_transform({A.start_tags(A.live('html'), 'a')}, "
    f"lambda x: {A.strip(A.attribute('x', 'href'))}), lambda x: x IS NOT NULL AND x <> '')"
)
_base = """regexp_extract(html, '(?is)<base\\s[^>]*?href\\s*=\\s*["'']?([^"''\\s>]+)', 1)"""


def links_sql(source: str) -> str:
    """CTEs ``links``(page_id, url, dst_url, pos) over a page source."""
    return f"""src AS ({source}),
hr AS (SELECT page_id, url, CASE WHEN {_base} = '' THEN url ELSE {_base} END AS b, {_hrefs} AS hs FROM src),
hx AS (SELECT page_id, url, b, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM hr),
ab AS (SELECT page_id, url, i, regexp_replace({A.resolve('h', 'b')}, '(?s)#.*$', '') AS dst_url FROM hx),
li AS (SELECT page_id, url, dst_url, min(i) AS i FROM ab
  WHERE {A.scheme('dst_url')} IN ('http', 'https', '') GROUP BY ALL),
links AS (SELECT page_id, url, dst_url,
  row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos FROM li)"""


BOTH_PAGES = "SELECT page_id, url, html FROM {pages} UNION ALL SELECT page_id + 1000000000, url, html FROM (" + RICH + ")"


@query("h1_extract_links", f"WITH {links_sql(BOTH_PAGES)} SELECT page_id, dst_url, pos FROM links")
def h1_extract_links(t):
    return P.extract_links(t.sql(BOTH_PAGES), keys=["page_id"]).select("page_id", "dst_url", "pos")


@query("h2_json_ld", SQL_RICH + """,
b AS (SELECT page_id, unnest(regexp_extract_all(html,
  '(?is)<script[^>]*type=["'']application/ld\\+json["''][^>]*>(.*?)</script>', 1)) AS body FROM p),
j AS (SELECT page_id, try_cast(trim(body) AS JSON) AS j FROM b),
g AS (SELECT page_id, unnest(CASE WHEN json_type(j, '$."@graph"') = 'ARRAY' THEN json_extract(j, '$."@graph"[*]')
  ELSE [j] END) AS item FROM j WHERE j IS NOT NULL)
SELECT page_id, item->>'$."@type"' AS item_type, item->>'$.name' AS name FROM g""")
def h2_json_ld(t):
    return P.json_ld_items(t.sql(RICH)).select(
        "page_id",
        F.expr("variant_get(item, '$[\"@type\"]', 'string')").alias("item_type"),
        F.expr("variant_get(item, '$.name', 'string')").alias("name"),
    )


def _pairs_sql(attr, prefix):
    tags = f"list_filter({A.start_tags('html', 'meta')}, lambda x: regexp_matches({A.raw_attribute('x', attr)}, '(?i)^{prefix}:'))"
    return f"""SELECT page_id, i, {A.raw_attribute('tag', attr)} AS k, {A.raw_attribute(A.after('tag', attr), 'content')} AS v
      FROM (SELECT page_id, unnest({tags}) AS tag, generate_subscripts({tags}, 1) AS i FROM p)"""


@query("h3_og_tags", SQL_RICH + f""", k AS ({_pairs_sql('property', 'og')})
SELECT page_id, regexp_replace(trim(k), '^og:', '') AS property,
  string_agg(trim(v), '|' ORDER BY i) AS content FROM k WHERE trim(v) <> '' GROUP BY 1, 2""")
def h3_og_tags(t):
    return t.sql(RICH).select("page_id", F.explode(H.og_tags(F.col("html")))).select(
        "page_id", F.col("key").alias("property"), F.array_join("value", "|").alias("content")
    )


@query("h4_twitter_tags", SQL_RICH + f""", k AS ({_pairs_sql('name', 'twitter')})
SELECT page_id, regexp_replace(trim(k), '^twitter:', '') AS property, arg_max(trim(v), i) AS content
FROM k WHERE trim(v) <> '' GROUP BY 1, 2""")
def h4_twitter_tags(t):
    return t.sql(RICH).select("page_id", F.explode(H.twitter_tags(F.col("html")))).select(
        "page_id", F.col("key").alias("property"), F.col("value").alias("content")
    )


def _ext(pattern):
    return f"regexp_extract(html, {A.q(pattern)}, 1)"


def _nn(text):
    return f"nullif({A.strip(text)}, '')"


_canonical = A.first_value("html", "link", "rel", "canonical", "href")
_lang = A.raw_attribute(A.start_tags("html", "html") + "[1]", "lang")
_meta_cols = ", ".join(
    [f"{_canonical} AS canonical",
     f"coalesce(nullif(regexp_extract({A.strip(_lang)}, '^([^-]*)', 1), ''), "
     f"{A.first_value('html', 'meta', 'http-equiv', 'content-language', 'content')}) AS language"]
    + [f"{A.first_value('html', 'meta', a, n, 'content')} AS {f}" for f, a, n in H.META_FIELDS]
)


@query("h5_standard_meta", f"WITH p AS ({BOTH_PAGES}) SELECT page_id, {_meta_cols} FROM p")
def h5_standard_meta(t):
    cols = H.standard_meta(F.col("html"))
    return t.sql(BOTH_PAGES).select("page_id", *[c.alias(n) for n, c in cols.items()])


_title = A.decode(A.strip(_ext(H.TITLE_PATTERN)))
_desc = f"coalesce({A.decode(A.first_value('html', 'meta', 'name', 'description', 'content'))}, '')"
_ogd = A.decode(A.first_value("html", "meta", "property", "og:description", "content"))


@query("h6_light_meta", f"""WITH p AS ({BOTH_PAGES}) SELECT page_id, nullif({_title}, '') AS title,
 nullif({_desc}, '') AS description, nullif({_ogd}, '') AS og_description FROM p""")
def h6_light_meta(t):
    cols = H.light_meta(F.col("html"))
    return t.sql(BOTH_PAGES).select("page_id", *[c.alias(n) for n, c in cols.items()])


_json_blocks = """len(list_filter(regexp_extract_all(html,
  '(?is)<script[^>]*type=["'']application/ld\\+json["''][^>]*>(.*?)</script>', 1), lambda b: trim(b) <> ''))"""


@query("h7_all_metadata", SQL_RICH + f"""SELECT page_id, {_json_blocks} AS json_ld_blocks,
 regexp_extract(html, '(?i)og:title" content="([^"]*)', 1) AS og_title,
 'large' || (page_id % 2) AS twitter_card, {_canonical} AS canonical FROM p""")
def h7_all_metadata(t):
    m = t.sql(RICH).select("page_id", H.all_metadata(F.col("html")).alias("m"))
    return m.select(
        "page_id", F.size("m.json_ld").alias("json_ld_blocks"),
        F.col("m.og")["title"][0].alias("og_title"),
        F.col("m.twitter")["card"].alias("twitter_card"), F.col("m.meta.canonical").alias("canonical"),
    )


_body = A.plain_text(A.drop_elements("html", ["script", "style", *H.NON_CONTENT], comments=True))


def structural_sql(cap=None):
    cut = f"[1:{cap}]" if cap else ""
    return (
        f"(concat_ws(chr(10) || chr(10), CASE WHEN {_title} <> '' THEN '# ' || {_title} END, "
        f"nullif({_desc}, ''), nullif({_body}, ''))){cut}"
    )


@query("h8_structural_text", f"WITH p AS ({BOTH_PAGES}) SELECT page_id, {structural_sql(H.EXCERPT)} AS text FROM p")
def h8_structural_text(t):
    return t.sql(BOTH_PAGES).select("page_id", H.structural_text(F.col("html"), H.EXCERPT).alias("text"))


def markdown_sql(markup):
    out = rf"regexp_replace({markup}, '[ \t\r\n]+', ' ', 'g')"
    out = f"regexp_replace({out}, {A.q(H.LINK_RULE)}, '[\\2](\\1)', 'g')"
    for pattern, mark in H.MARKDOWN_RULES:
        mark = " || ".join(A.q(m) if m != "\n" else "chr(10)" for m in _cut(mark))
        out = f"regexp_replace({out}, {A.q(pattern)}, {mark}, 'g')"
    out = f"regexp_replace({out}, '(?s)<[^>]*>', '', 'g')"
    out = rf"regexp_replace({out}, '[ \t]*\n[ \t]*', chr(10), 'g')"
    out = rf"regexp_replace({out}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return A.strip(A.decode(out))


def _cut(mark):
    """Newlines of a replacement kept apart from its other characters."""
    parts, rest = [], mark
    while rest.startswith("\n"):
        parts.append("\n")
        rest = rest[1:]
    return parts + ([rest] if rest else [])


_block = "coalesce(" + ", ".join(
    f"nullif(regexp_extract(m, '(?is)<{n}\\b[^>]*>(.*)</{n}\\s*>', 1), '')" for n in ("article", "main", "body")
) + ", m)"
MARKDOWN_CTES = (
    f"lm AS (SELECT *, {A.live('html')} AS m FROM p), "
    f"md AS (SELECT page_id, url, html, {markdown_sql(_block)} AS k FROM lm)"
)


@query("h9_markdown", f"""WITH p AS ({BOTH_PAGES}), {MARKDOWN_CTES}
SELECT page_id, CASE WHEN length(k) < 50 THEN {structural_sql(H.EXCERPT)} ELSE k END AS markdown FROM md""")
def h9_markdown(t):
    return t.sql(BOTH_PAGES).select("page_id", H.html_to_markdown(F.col("html")).alias("markdown"))


_no_nav = A.drop_elements(A.drop_elements("html", [], comments=True), ["header", "nav", "aside", "footer"])


@query("h10_filter_sections", f"""WITH p AS ({BOTH_PAGES}),
c AS (SELECT page_id, {A.plain_text(_no_nav)} AS x, {A.drop_elements(_no_nav, ['script', 'style'])} AS m FROM p)
SELECT page_id, {A.strip('x[1:300]')} || CASE WHEN length(x) > 300 THEN chr(10) || '...' ELSE '' END AS compact,
 {markdown_sql(_block)} AS standard FROM c""")
def h10_filter_sections(t):
    drop = ["header", "navigation", "sidebar", "footer"]
    html = F.col("html")
    return t.sql(BOTH_PAGES).select(
        "page_id",
        H.filter_sections(html, exclude=drop, verbosity="compact").alias("compact"),
        H.filter_sections(html, include=["body", "banner"], verbosity="standard").alias("standard"),
    )


_ex_links = f"""SELECT page_id, h, i FROM (SELECT page_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM (
  SELECT page_id, list_transform(list_filter(list_transform({A.start_tags(A.live('html'), 'a')},
   lambda x: {A.strip(A.attribute('x', 'href'))}),
   lambda x: x IS NOT NULL AND NOT regexp_matches(x, '^(mailto:|javascript:|tel:|#)')),
   lambda x: CASE WHEN {_base} = '' THEN x ELSE {A.resolve('x', _base)} END) AS hs FROM p))"""


@query("h11_extras", f"""WITH p AS ({BOTH_PAGES}), a AS ({_ex_links}),
d AS (SELECT page_id, h, min(i) AS i FROM a GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS r FROM d),
l AS (SELECT page_id, string_agg(h, ' ' ORDER BY r) AS links FROM r WHERE r <= 5 GROUP BY 1)
SELECT p.page_id, coalesce(links, '') AS links,
 CASE WHEN p.page_id >= 1000000000 THEN '/a' || (p.page_id - 1000000000) || '.png' ELSE '' END AS images,
 CASE WHEN p.page_id >= 1000000000 THEN 'x = ' || (p.page_id - 1000000000) || '|y' ELSE '' END AS code
FROM p LEFT JOIN l ON p.page_id = l.page_id""")
def h11_extras(t):
    html = F.col("html")
    return t.sql(BOTH_PAGES).select(
        "page_id",
        F.array_join(H.extra_links(html, 5), " ").alias("links"),
        F.array_join(H.extra_images(html, 5), " ").alias("images"),
        F.array_join(H.extra_code(html, 5), "|").alias("code"),
    )


@query("h12_images", SQL_RICH + f""", i AS (SELECT page_id, url, unnest(ts) AS x, generate_subscripts(ts, 1) AS i FROM
 (SELECT page_id, url, {A.start_tags(A.live('html'), 'img')} AS ts FROM p)),
s AS (SELECT page_id, url, i, {A.strip(A.attribute('x', 'src'))} AS src, {A.strip(A.attribute('x', 'alt'))} AS alt,
 try_cast({A.strip(A.attribute('x', 'width'))} AS INTEGER) AS width,
 try_cast({A.strip(A.attribute('x', 'height'))} AS INTEGER) AS height FROM i)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS position,
 CASE WHEN regexp_matches(src, '^(http:|https:|data:)') THEN src ELSE {A.resolve('src', 'url')} END AS image_url,
 coalesce(alt, '') AS alt, width, height FROM s WHERE src IS NOT NULL AND src <> ''""")
def h12_images(t):
    return P.image_rows(t.sql(RICH)).select(
        "page_id", "position", "image_url", "alt", "width", "height"
    )


@query("h13_embedded_content", f"""WITH p AS ({BOTH_PAGES}) SELECT page_id,
 {A.any_of('lower(html)', H.EMBED_TAGS)} AND
 {A.any_of('lower(html)', H.EMBED_EXTENSIONS + H.EMBED_DOMAINS + H.EMBED_PATHS)} AS embedded FROM p""")
def h13_embedded_content(t):
    return t.sql(BOTH_PAGES).select("page_id", H.has_embedded_content(F.col("html")).alias("embedded"))


# Documents with markdown marks, secrets and chapter headings mixed in.
NOTES = """SELECT doc_id, source, lang, text FROM {documents}
UNION ALL SELECT doc_id + 1000000000, source, lang, '# ' || source || '
- one
[link](http://x.example/' || doc_id || ')
api_key=abc' || doc_id || ' password: hunter2 https://a.example/?token=zz&x=1 Bearer abcdef.' || doc_id || ' sk-secret' || doc_id || '
We use cookies on this site, read the policy.
' || substr(text, 1, 400) || '
CHAPTER I. ' || lang || '
Body one of ' || doc_id || '
Part 2
' || text FROM {documents}"""
SQL_NOTES = f"WITH n AS ({NOTES}) "


@query("h14_looks_like_markdown", SQL_NOTES + f"""SELECT doc_id, len(list_filter(string_split({A.strip('text')}[1:2000], chr(10)),
 lambda s: regexp_matches({A.strip('s')}, {A.q(H.MARKDOWN_LINE)}))) >= 3 AS markdown FROM n""")
def h14_looks_like_markdown(t):
    return t.sql(NOTES).select("doc_id", H.looks_like_markdown(F.col("text")).alias("markdown"))


@query("h15_description", SQL_NOTES + f""", l AS (SELECT doc_id, text,
  list_transform(string_split(text, chr(10)), lambda s: {A.strip('s')}) AS ls FROM n),
g AS (SELECT doc_id, text, list_filter(ls, lambda s: length(s) >= 30 AND NOT regexp_matches(s, '^[#!\\[>]') AND NOT
  {A.any_of('lower(s)', H.BOILERPLATE_SIGNALS)}) AS gs,
  list_filter(ls, lambda s: length(s) >= 30 AND NOT regexp_matches(s, '^[#!]'))[1:1] AS sp FROM l),
k AS (SELECT doc_id, text, CASE WHEN len(gs) > 0 THEN gs ELSE sp END AS c FROM g),
d AS (SELECT doc_id, text, c, CASE WHEN length(c[1]) > 100 THEN c[1] ELSE
  list_reduce(c[3:], lambda a, s: CASE WHEN length(a) >= 100 THEN a ELSE a || ' ' || s END,
   c[1] || coalesce(' ' || c[2], '')) END AS x FROM k),
e AS (SELECT *, least(100, length(x)) AS h FROM d),
f AS (SELECT *, regexp_extract(x[h + 1:], '(?s)^(.*?[.!?])(?:\\s|$)', 1) AS sn FROM e)
SELECT doc_id, CASE WHEN len(c) = 0 THEN {A.strip('text[1:300]')} ELSE {A.strip("CASE WHEN sn <> '' THEN x[1:h] || sn WHEN length(x) > 300 THEN rtrim(x[1:300]) || '...' ELSE x END")} END AS description
FROM f""")
def h15_description(t):
    return t.sql(NOTES).select("doc_id", H.extract_description(F.col("text")).alias("description"))


H16 = """SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN 'OG ' || page_id ELSE '' END AS og_title,
 CASE WHEN page_id % 3 = 1 THEN '
 # Head ' || page_id || '
 text' ELSE 'no heading' END AS markdown, url || '/my-page_' || page_id || '/' AS long_url FROM {pages}"""


@query("h16_pick_title", f"""WITH p AS ({H16}) SELECT page_id, CASE page_id % 3 WHEN 0 THEN og_title WHEN 1 THEN 'Head ' || page_id
 ELSE 'My Page_' || page_id END AS title FROM p""")
def h16_pick_title(t):
    return t.sql(H16).select(
        "page_id",
        H.pick_title([F.col("og_title")], F.col("markdown"), F.col("long_url")).alias("title"),
    )


def redact_sql(text):
    for pattern, replacement in H.REDACTIONS:
        rep = replacement.replace("$1", "\\1")
        text = f"regexp_replace({text}, {A.q('(?i)' + pattern)}, {A.q(rep)}, 'g')"
    return text


@query("h17_redact", SQL_NOTES + f"SELECT doc_id, {redact_sql('text')} AS text FROM n")
def h17_redact(t):
    return t.sql(NOTES).select("doc_id", H.redact(F.col("text")).alias("text"))


@query("h18_split_chapters", SQL_NOTES + f""", m AS (SELECT doc_id, text,
 string_split(regexp_replace(text, {A.q(H.CHAPTER_PATTERN)}, chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS ps FROM n),
c AS (SELECT doc_id, unnest(CASE WHEN len(ps) <= 1 THEN [chr(2) || text] ELSE ps[2:] END) AS c,
 generate_subscripts(CASE WHEN len(ps) <= 1 THEN [text] ELSE ps[2:] END, 1) AS chapter_no FROM m)
SELECT doc_id, chapter_no, {A.strip("split_part(c, chr(2), 1)")} AS title,
 {A.strip("split_part(c, chr(2), 2)")} AS content FROM c""")
def h18_split_chapters(t):
    return P.chapter_rows(t.sql(NOTES)).select("doc_id", "chapter_no", "title", "content")


POSTINGS = """SELECT doc_id, '<script type="application/ld+json">{"@type":"JobPosting","title":"Job ' || doc_id ||
 '","hiringOrganization":{"name":"' || source || '"},"employmentType":"' ||
 CASE doc_id % 3 WHEN 0 THEN 'FULL-TIME' WHEN 1 THEN 'contract' ELSE 'Seasonal ' END ||
 '","baseSalary":{"value":{"minValue":' || (doc_id % 50) || ',"maxValue":' || (doc_id % 50 + 9) ||
 '}},"datePosted":"2024-02-0' || (1 + doc_id % 9) || 'T00:00:00","jobLocation":[{"address":{"addressLocality":"' || lang ||
 '","addressRegion":"R' || (doc_id % 4) || '"}}]}</script>' AS html FROM {documents}"""


@query("h19_job_postings", f"""WITH p AS ({POSTINGS}) SELECT doc_id, 'Job ' || doc_id AS title, source AS company,
 CASE doc_id % 3 WHEN 0 THEN 'Full-Time' WHEN 1 THEN 'Contract' ELSE 'Seasonal' END AS employment_type,
 CAST(doc_id % 50 AS VARCHAR) AS salary_min, CAST(doc_id % 50 + 9 AS VARCHAR) AS salary_max,
 '2024-02-0' || (1 + doc_id % 9) AS date_posted, lang AS location, 'R' || (doc_id % 4) AS region FROM documents""")
def h19_job_postings(t):
    return P.job_postings(t.sql(POSTINGS), ["doc_id"]).select(
        "doc_id", "title", "company", "employment_type", "salary_min", "salary_max",
        "date_posted", "location", "region",
    )


CVES = """SELECT doc_id, '{"id":"CVE-2024-' || (10000 + doc_id) || '","descriptions":[{"lang":"es","value":"hola"},{"lang":"en","value":"flaw in ' ||
 source || '"}],"metrics":{"cvssMetricV31":[{"cvssData":{"baseScore":' || (doc_id % 10) || '.5,"baseSeverity":"' ||
 CASE WHEN doc_id % 10 > 6 THEN 'HIGH' ELSE 'LOW' END || '","vectorString":"AV:N"},"exploitabilityScore":1.5}]' ||
 CASE WHEN doc_id % 2 = 0 THEN ',"cvssMetricV40":[{"cvssData":{"baseScore":7.25}}]' ELSE '' END ||
 '},"weaknesses":[{"description":[{"lang":"en","value":"CWE-' || (doc_id % 90) || '"},{"lang":"en","value":"NVD-other"}]}],' ||
 '"references":[{"url":"https://r.example/' || doc_id || '","tags":["' || CASE WHEN doc_id % 3 = 0 THEN 'Exploit' ELSE 'Patch' END ||
 '"]}],"configurations":[{"nodes":[{"cpeMatch":[{"criteria":"cpe:2.3:a:v:' || source || '","vulnerable":true},' ||
 '{"criteria":"cpe:2.3:o:linux","vulnerable":false,"versionEndExcluding":"5.' || (doc_id % 20) || '"}]}]}]}' AS record FROM {documents}"""


@query("h20_flatten_cve", f"""SELECT doc_id, 'CVE-2024-' || (10000 + doc_id) AS cve_id, 'flaw in ' || source AS description,
 doc_id % 10 + 0.5 AS cvss_v3, CASE WHEN doc_id % 2 = 0 THEN 7.25 END AS cvss_v4,
 CASE WHEN doc_id % 10 > 6 THEN 'HIGH' ELSE 'LOW' END AS severity, 'CWE-' || (doc_id % 90) AS weaknesses,
 doc_id % 3 = 0 AS exploited, c.criteria, c.vulnerable, c.version_range FROM documents,
 LATERAL (SELECT 'cpe:2.3:a:v:' || source AS criteria, true AS vulnerable, 'any' AS version_range UNION ALL
  SELECT 'cpe:2.3:o:linux', false, '<5.' || (doc_id % 20)) c""")
def h20_flatten_cve(t):
    return P.flatten_cve(t.sql(CVES), ["doc_id"]).select(
        "doc_id", "cve_id", "description", "cvss_v3", "cvss_v4", "severity",
        F.array_join("weaknesses", ",").alias("weaknesses"), "exploited", "criteria",
        "vulnerable", "version_range",
    )


CERTS = """SELECT event_id AS id, 'site' || (user_id % 20) || '.example.com' AS domain,
 'www' || user_id || '.example.com' AS common_name, 'C=US, O=Example Trust Services, CN=Issuing Authority ' || event_type AS issuer_name,
 CAST(ts AS STRING) AS not_before, CAST(ts AS STRING) AS not_after FROM {events}"""


@query("h21_cert_listing", f"""WITH c AS ({CERTS.replace('AS STRING', 'AS VARCHAR')}),
r AS (SELECT *, count(*) OVER (PARTITION BY domain) AS certificate_count,
 row_number() OVER (PARTITION BY domain ORDER BY id) AS rank FROM c)
SELECT domain, rank, certificate_count, common_name, issuer_name[1:40] AS issuer, not_before[1:10] AS not_before,
 not_after[1:10] AS not_after FROM r WHERE rank <= 20""")
def h21_cert_listing(t):
    return P.cert_listing(t.sql(CERTS), "domain", "id", 20)


SIZES = """SELECT page_id, CASE page_id % 4 WHEN 0 THEN page_id || ' × 600 px' WHEN 1 THEN page_id || 'x20' WHEN 2 THEN 'wide' ELSE '' END AS note,
 url, CASE page_id % 5 WHEN 0 THEN 'application/pdf; charset=x' WHEN 1 THEN 'IMAGE/PNG' WHEN 2 THEN 'text/html' WHEN 3 THEN 'text/csv' ELSE '' END AS content_type FROM {pages}"""


@query("h22_parse_resolution", f"""WITH s AS ({SIZES}) SELECT page_id,
 try_cast(regexp_extract(note, '^([0-9]+)\\s*[×x]\\s*([0-9]+)', 1) AS INTEGER) AS width,
 try_cast(regexp_extract(note, '^([0-9]+)\\s*[×x]\\s*([0-9]+)', 2) AS INTEGER) AS height FROM s""")
def h22_parse_resolution(t):
    w, h = H.parse_resolution(F.col("note"))
    return t.sql(SIZES).select("page_id", w.alias("width"), h.alias("height"))


_fn = f"regexp_extract(regexp_replace(coalesce(nullif({A.path('url')}, ''), nullif({A.query('url')}, ''), 'download'), '/+$', ''), '([^/]*)$', 1)"
_ext_case = "CASE trim(split_part(content_type, ';', 1)) " + " ".join(
    f"WHEN {A.q(k)} THEN {A.q(v)}" for k, v in U.TYPE_EXTENSIONS.items()) + " ELSE '' END"


@query("h23_binary_type", f"""WITH s AS ({SIZES}) SELECT page_id,
 {A.in_list("lower(trim(split_part(content_type, ';', 1)))", U.BINARY_TYPES)} OR
 regexp_matches(lower(content_type), '^(image|audio|video)/') AS is_binary,
 CASE WHEN contains({_fn}, '.') THEN {_fn} ELSE {_fn} || {_ext_case} END AS filename FROM s""")
def h23_binary_type(t):
    return t.sql(SIZES).select(
        "page_id", U.is_binary_type(F.col("content_type")).alias("is_binary"),
        U.derive_filename(F.col("url"), F.col("content_type")).alias("filename"),
    )


# ------------------------------------------------------------------ quality

BLOCKED = """SELECT doc_id, text, source FROM {documents}
UNION ALL SELECT doc_id + 1000000000, CASE doc_id % 8
 WHEN 0 THEN 'Access Denied. You have been blocked' WHEN 1 THEN 'Error: request failed' WHEN 2 THEN ' '
 WHEN 3 THEN 'Please verify you are human. reCAPTCHA. Just a moment' WHEN 4 THEN '[a](b) nav
[c](d)
[e](f)
text' WHEN 5 THEN 'Your IP has been blocked. Session timed out' WHEN 6 THEN substr(text, 1, 300) || '

' || substr(text, 1, 500) ELSE text || '

Cookie consent' END, source FROM {documents}"""
SQL_BLOCKED = f"WITH d AS ({BLOCKED}), "

_ls = f"list_filter(list_transform(string_split(text, chr(10)), lambda s: {A.strip('s')}), lambda s: s <> '')"
_link = A.q(Q.LINK_LINE)
GATES = f"""b1 AS (SELECT *, {_ls} AS ls, {A.strip('text')} AS tx FROM d),
b2 AS (SELECT *, len(list_filter(ls, lambda s: regexp_matches(s, {_link}))) / greatest(len(ls), 1) AS ratio,
 len(list_filter(ls, lambda s: length(s) > 60 AND NOT regexp_matches(s, {_link}))) AS solid,
 length(tx) AS n, len(list_filter(string_split(tx, chr(10) || chr(10)), lambda x: {A.strip('x')} <> '')) >= 2 AS paras,
 {' + '.join(f"CAST(regexp_matches(lower(text), {A.q(p)}) AS INTEGER)" for p in Q.BLOCK_PATTERNS)} AS hits,
 {' + '.join(f"CAST(contains(lower(text), {A.q(p)}) AS INTEGER)" for p in Q.ERROR_WORDS)} AS errs,
 CASE WHEN title <> '' THEN length({A.strip('title')}) >= 10 ELSE length(tx) >= 200 END AS tok FROM b1),
g AS (SELECT *, CASE WHEN tx = '' THEN 0.0 WHEN ratio > 0.7 AND solid < 2 THEN 0.2 WHEN ratio > 0.5 AND solid < 2 THEN 0.4
  WHEN solid >= 5 THEN 1.0 WHEN solid >= 3 THEN 0.85 WHEN solid >= 1 THEN 0.6 ELSE 0.3 END::DOUBLE AS s1,
 CASE WHEN tx = '' THEN 0.0 WHEN n < 200 AND NOT paras THEN 0.1 WHEN n < 200 THEN 0.3 WHEN NOT paras THEN 0.4
  WHEN n >= 1000 AND tok THEN 1.0 WHEN n >= 500 THEN 0.85 ELSE 0.6 END::DOUBLE AS s2,
 CASE WHEN tx = '' THEN 0.0 WHEN hits >= 3 THEN 0.05 WHEN hits >= 2 THEN 0.15 WHEN hits >= 1 THEN 0.3
  WHEN n < 200 AND errs >= 2 THEN 0.2 ELSE 1.0 END::DOUBLE AS s3 FROM b2),
st AS (SELECT *, CASE WHEN tx = '' THEN 'fail' WHEN s1 IN (1.0, 0.85) THEN 'pass' WHEN s1 IN (0.4, 0.6) THEN 'warn' ELSE 'fail' END AS t1,
 CASE WHEN tx = '' OR s2 = 0.1 THEN 'fail' WHEN s2 IN (1.0, 0.85) THEN 'pass' ELSE 'warn' END AS t2,
 CASE WHEN s3 = 1.0 THEN 'pass' WHEN s3 = 0.3 THEN 'warn' ELSE 'fail' END AS t3,
 round(CAST(CAST(s1 * 0.3 + s2 * 0.3 + s3 * 0.4 AS VARCHAR) AS DECIMAL(38,20)), 2)::DOUBLE AS score FROM g)"""
GATE_DOCS = SQL_BLOCKED.replace("SELECT doc_id, text, source", "SELECT doc_id, text, source, '' AS title").replace(
    "ELSE text || '", "ELSE text || '") .replace("END, source FROM", "END, source, '' FROM") + GATES


@query("q1_boilerplate", GATE_DOCS + " SELECT doc_id, s1 AS gate_score, t1 AS gate_status FROM st")
def q1_boilerplate(t):
    return t.sql(BLOCKED).select(
        "doc_id", Q.check_boilerplate(F.col("text")).alias("g")
    ).select("doc_id", F.col("g.score").alias("gate_score"), F.col("g.status").alias("gate_status"))


@query("q2_completeness", GATE_DOCS.replace(", '' AS title", ", source AS title").replace("END, source, ''", "END, source, source")
       + " SELECT doc_id, s2 AS gate_score, t2 AS gate_status FROM st")
def q2_completeness(t):
    return t.sql(BLOCKED).select(
        "doc_id", Q.check_completeness(F.col("text"), F.col("source")).alias("g")
    ).select("doc_id", F.col("g.score").alias("gate_score"), F.col("g.status").alias("gate_status"))


@query("q3_block_page", GATE_DOCS + " SELECT doc_id, s3 AS gate_score, t3 AS gate_status FROM st")
def q3_block_page(t):
    return t.sql(BLOCKED).select(
        "doc_id", Q.check_block_page(F.col("text")).alias("g")
    ).select("doc_id", F.col("g.score").alias("gate_score"), F.col("g.status").alias("gate_status"))


QUALITY_SQL = GATE_DOCS + """, q AS (SELECT doc_id, source, score, t1 AS boilerplate, t2 AS completeness, t3 AS block_detected,
 coalesce(nullif(concat_ws(', ', CASE WHEN t1 <> 'pass' THEN 'boilerplate:' || t1 END,
  CASE WHEN t2 <> 'pass' THEN 'completeness:' || t2 END, CASE WHEN t3 <> 'pass' THEN 'block:' || t3 END), ''),
  'all checks passed') AS detail FROM st)"""


@query("q4_assess_quality", QUALITY_SQL + " SELECT doc_id, score, boilerplate, completeness, block_detected, detail FROM q")
def q4_assess_quality(t):
    return Q.assess_quality(t.sql(BLOCKED), "text").drop("text", "source")


@query("q4_quality_vs_labels", QUALITY_SQL + """ SELECT l.quality AS label, count(*) AS documents,
 round(avg(q.score), 6) AS mean_score, sum(CASE WHEN q.score >= 0.3 THEN 1 ELSE 0 END) AS accepted
 FROM q JOIN labels l ON q.doc_id = l.doc_id GROUP BY 1""")
def q4_quality_vs_labels(t):
    scored = Q.assess_quality(t.sql(BLOCKED), "text").select("doc_id", "score")
    return (
        scored.join(t.labels, "doc_id").groupBy(F.col("quality").alias("label"))
        .agg(
            F.count("*").alias("documents"), F.round(F.avg("score"), 6).alias("mean_score"),
            F.sum(F.when(F.col("score") >= 0.3, 1).otherwise(0)).alias("accepted"),
        )
    )


@query("q5_quality_acceptable", QUALITY_SQL + " SELECT doc_id, score FROM q WHERE score >= 0.3")
def q5_quality_acceptable(t):
    scored = Q.assess_quality(t.sql(BLOCKED), "text").select("doc_id", "score")
    return scored.where(Q.quality_acceptable(F.col("score")))


@query("q6_best_version", QUALITY_SQL + """, v AS (SELECT source AS url, doc_id AS tier, score, score >= 0.3 AS ok FROM q),
r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ok DESC, CASE WHEN ok THEN tier ELSE 0 END, score DESC, tier) AS r FROM v)
SELECT url, tier, score FROM r WHERE r = 1""")
def q6_best_version(t):
    versions = Q.assess_quality(t.sql(BLOCKED), "text").select(
        F.col("source").alias("url"), F.col("doc_id").alias("tier"), "score"
    )
    return P.best_version(versions, ["url"]).drop("best_effort")


BARRIERS = """SELECT page_id, url || CASE page_id % 11 WHEN 1 THEN '?__cf_chl=1' WHEN 2 THEN '/.well-known/ddos-guard' WHEN 3 THEN '//substack.com/iframe' ELSE '' END AS url,
 CASE page_id % 7 WHEN 1 THEN 'Just a moment...' WHEN 2 THEN 'DDoS-Guard' WHEN 3 THEN '403 Forbidden' ELSE 'Title' END AS title,
 CASE page_id % 5 WHEN 1 THEN '' WHEN 2 THEN 'Too many requests, rate limit hit' WHEN 3 THEN substr(html, 1, 400) || ' security verification' ELSE html END AS content,
 CASE page_id % 13 WHEN 1 THEN html || '<div class="g-recaptcha">' WHEN 2 THEN html || '<iframe data-sitekey="k" src="/challenge">'
  WHEN 3 THEN '' ELSE html END AS html FROM {pages}"""
_ti, _ur, _co, _ht = "lower(title)", "lower(url)", "lower(content)", "lower(html)"
_first = f"""list_filter([CASE WHEN length(content) < 100 THEN 'empty' END,
 CASE WHEN {A.any_of(_ti, Q._low(Q.CLOUDFLARE_SIGNS) + ['attention required', '403 forbidden'])} THEN 'cloudflare-title' END,
 CASE WHEN {A.any_of(_ur, ['cf_chl', 'challenge-platform'])} THEN 'cloudflare-url' END,
 CASE WHEN {A.any_of(_ti, Q._low(Q.DDOS_GUARD_SIGNS))} THEN 'ddos-guard-title' END,
 CASE WHEN contains({_ur}, 'ddos-guard') THEN 'ddos-guard-url' END,
 CASE WHEN {A.any_of(_co, ['rate limit', 'too many requests'])} THEN 'rate-limit' END,
 CASE WHEN {A.any_of(_ur, Q.FRAME_REDIRECTS)} OR {A.any_of(_ht, Q.FRAME_REDIRECTS)} THEN 'substack-redirect' END], lambda x: x IS NOT NULL)"""
_fall = f"CASE WHEN {A.any_of(_co, Q._low(Q.CLOUDFLARE_SIGNS + Q.DDOS_GUARD_SIGNS + Q.FRAME_REDIRECTS))} THEN ['content-match'] ELSE [] END"
_widget = " ".join(f"WHEN {A.any_of(_ht, s)} THEN {A.q(p)}" for p, s in Q.CAPTCHA_WIDGETS)


@query("q7_classify_barrier", f"""WITH b AS ({BARRIERS}), f AS (SELECT *, {_first} AS fs FROM b),
s AS (SELECT *, CASE WHEN len(fs) > 0 THEN list_sort(fs) ELSE {_fall} END AS ss,
 CASE {_widget} WHEN contains({_ht}, '<iframe') AND contains({_ht}, 'sitekey') AND
  {A.any_of(_ht, ['captcha', 'challenge'])} THEN 'generic' END AS provider FROM f),
j AS (SELECT *, array_to_string(ss, ', ') AS js FROM s)
SELECT page_id, provider, provider IS NOT NULL OR (content = '' AND html = '') OR len(ss) > 0 AS detected,
 CASE WHEN provider IS NOT NULL THEN 'captcha' WHEN content = '' AND html = '' THEN 'empty'
  {' '.join(f"WHEN contains(js, {A.q(w)}) THEN {A.q(n)}" for w, n in Q.BARRIER_ORDER)} END AS barrier_type,
 CASE WHEN provider = 'generic' THEN 0.85 WHEN provider IS NOT NULL OR (content = '' AND html = '') THEN 0.95
  WHEN len(ss) = 0 THEN 0 ELSE least(0.95, round(0.5 + 0.2 * len(ss), 2)) END::DOUBLE AS confidence,
 CASE WHEN provider = 'generic' THEN 'Definitive generic CAPTCHA widget' WHEN provider IS NOT NULL THEN
  'Definitive ' || provider || ' widget' WHEN content = '' AND html = '' THEN 'No content returned'
  WHEN len(ss) = 0 THEN 'No barrier signals detected' ELSE 'Matched signals: ' || js END AS detail FROM j""")
def q7_classify_barrier(t):
    b = t.sql(BARRIERS)
    v = Q.classify_barrier(*[F.col(c) for c in ("title", "url", "content", "html")])
    return b.select("page_id", v.alias("b")).select("page_id", "b.*")


@query("q8_bot_challenge", f"""WITH b AS ({BARRIERS}) SELECT page_id,
 {A.any_of(_ti, Q._low(Q.CLOUDFLARE_SIGNS + Q.DDOS_GUARD_SIGNS))} OR
 {A.any_of(_ur, ['cf_chl', 'challenge-platform', 'ddos-guard'])} AS challenge FROM b""")
def q8_bot_challenge(t):
    return t.sql(BARRIERS).select(
        "page_id", Q.is_bot_challenge(F.col("title"), F.col("url")).alias("challenge")
    )


ERRORS = """SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'getaddrinfo failed' WHEN 1 THEN 'Connection refused by ' || user_id
 WHEN 2 THEN 'HTTP 503 from host' WHEN 3 THEN 'Request timed out' WHEN 4 THEN 'parse problem' WHEN 5 THEN 'Connection timed out'
 WHEN 6 THEN '404 Not Found' WHEN 7 THEN 'DNS issue' ELSE event_type END AS message,
 CASE event_id % 10 WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'AUTH_ERROR' WHEN 2 THEN 'CAPTCHA_UNRESOLVED' WHEN 3 THEN 'OTHER' ELSE '' END AS code FROM {events}"""
_codes = " ".join(f"WHEN code = {A.q(k)} THEN {A.q(v)}" for k, v in Q.ERROR_CODES.items())
_words = " ".join(f"WHEN {A.any_of('lower(message)', w)} THEN {A.q(k)}" for k, w in Q.ERROR_MESSAGES)


@query("q9_classify_error", f"""WITH e AS ({ERRORS}) SELECT event_id,
 CASE {_codes} {_words} ELSE 'scrape_error' END AS error_type FROM e""")
def q9_classify_error(t):
    return t.sql(ERRORS).select(
        "event_id", Q.classify_error(F.col("message"), F.col("code")).alias("error_type")
    )


ENGINES = """SELECT user_id AS query_id, event_type AS engine, count(*) - 12 AS results FROM {events} GROUP BY user_id, event_type"""


@query("q10_search_health", f"""WITH e AS ({ENGINES}), a AS (SELECT query_id, count(*) AS engines_total,
 sum(CASE WHEN results > 0 THEN 1 ELSE 0 END) AS engines_responding,
 sum(CASE WHEN engine <> 'error' AND results > 0 THEN results ELSE 0 END) AS urls FROM e GROUP BY 1)
SELECT query_id, engines_total, engines_responding, engines_responding > 0 AND urls = 0 AS empty_result,
 engines_responding < engines_total / 2 AS degraded,
 CASE WHEN engines_responding < engines_total / 2 THEN 'Degraded: ' || engines_responding || '/' || engines_total || ' engines returned results'
  WHEN engines_responding > 0 AND urls = 0 THEN 'All ' || engines_total || ' engines responded but returned no results'
  ELSE 'Healthy: ' || engines_responding || '/' || engines_total || ' engines returned results' END AS detail FROM a""")
def q10_search_health(t):
    rows = t.sql(ENGINES).withColumn(
        "urls", F.when((F.col("engine") != "error") & (F.col("results") > 0), F.col("results")).otherwise(0)
    )
    return P.search_health(rows, "query_id")
