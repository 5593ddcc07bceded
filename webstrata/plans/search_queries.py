"""Vector, keyword, memory, citation and session queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from webstrata.functions import html as H
from webstrata.functions import urls as U
from webstrata.functions import vectors as V
from webstrata.operators import index as I
from webstrata.operators import memory as M
from webstrata.operators import ordered, ranking
from webstrata.operators import search as S
from webstrata.plans import ansi as A
from webstrata.plans.registry import query
from webstrata.plans.url_queries import CATEGORY_SQL
from webstrata.session import cut_lineage

DAY = 86_400_000
NOW = 1_706_745_600_000  # 2024-02-01, the fixed clock of every report here


def _cos(a, b):
    a, b = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    return f"round(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))), 6)"


def _hashed_sql(name: str, source: str, text: str, chars: int = 2000) -> str:
    """CTEs ``name`` (id, slot, v) and ``name_n`` (id, size): hashed word counts of ``source`` (id, ...)."""
    words = f"regexp_split_to_array(lower(left({text}, {chars})), '[ \\t\\n\\r\\f\\v]+')"
    return f"""{name}_h AS (SELECT id, CAST('0x' || left(md5(w), 8) AS UBIGINT) AS h FROM (SELECT id, unnest({words}) AS w FROM {source}) WHERE w <> ''),
{name} AS MATERIALIZED (SELECT id, h % 256 AS slot, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS v FROM {name}_h GROUP BY 1, 2),
{name}_n AS MATERIALIZED (SELECT s.id, sqrt(coalesce(sum(v * v), 0)) AS size FROM {source} s LEFT JOIN {name} USING (id) GROUP BY 1)"""


@query("r1_embed", f"""WITH d AS (SELECT doc_id AS id, text FROM documents), {_hashed_sql('e', 'd', 'text')},
p AS (SELECT id, string_agg(slot || ':' || CAST(round(v / size * 1000000) AS BIGINT), ',' ORDER BY slot) AS parts FROM e JOIN e_n USING (id) WHERE v <> 0 GROUP BY 1)
SELECT e_n.id AS doc_id, 256 AS dim, CASE WHEN size > 0 THEN 1.0 ELSE 0.0 END AS norm, coalesce(parts, '') AS parts FROM e_n LEFT JOIN p USING (id)""")
def r1_embed(t):
    """The non-zero components of each text vector, in millionths, and its norm."""
    e = S.embed(t.documents.select("doc_id", "text"), F.col("text"), kind="double")
    slots = F.transform("embedding", lambda x, i: F.when(x != 0, F.concat_ws(":", i, F.round(x * 1_000_000).cast("long"))))
    return e.select(
        "doc_id", F.size("embedding").alias("dim"), F.round(V.norm(F.col("embedding")), 4).alias("norm"),
        F.array_join(F.array_compact(slots), ",").alias("parts"),
    )


@query("r2_url_id", """SELECT page_id, CAST(CAST('0x' || left(sha256(url), 16) AS UBIGINT) AS VARCHAR) AS point_id FROM pages""")
def r2_url_id(t):
    return t.pages.select("page_id", U.url_id(F.col("url")).cast("string").alias("point_id"))


# Index of every second host and a batch of everything, so that merge finds
# rows on both sides, on one side, and repeated URLs.
INDEX = """SELECT 'https://' || CASE vec_id % 6 WHEN 0 THEN 'docs.' WHEN 1 THEN 'blog.' WHEN 2 THEN 'api.' ELSE '' END || CASE vec_id % 4 WHEN 0 THEN 'reuters.com' WHEN 1 THEN 'reddit.com' WHEN 2 THEN 'github.com' ELSE 'site.example' END || '/v/' || vec_id AS url,
 vec_id, 'Title ' || vec_id AS title, embedding, label, CAST(vec_id * 37 % 400 AS BIGINT) AS age_days, CAST(vec_id * 13 % 150 AS BIGINT) AS access_count, CAST(vec_id % 25 AS BIGINT) AS crawl_count FROM {embeddings}"""


def _index(t):
    df = t.sql(INDEX)
    now = F.lit(NOW)
    return df.select(
        "url", "title", U.domain_category(F.col("url")).alias("category"),
        (now - (F.col("age_days") + 10) * DAY).alias("first_indexed_ms"),
        F.when(F.col("vec_id") % 17 != 0, now - F.col("age_days") * DAY).alias("last_indexed_ms"),
        "crawl_count", "access_count", F.array(F.lit("base")).alias("models"),
        F.create_map(F.lit("base"), F.col("embedding")).alias("vectors"), "vec_id",
    )


def _score_sql(cat, last, access, crawls, now):
    weights = " ".join(f"WHEN '{k}' THEN {v}" for k, v in I.CATEGORY_WEIGHTS.items())
    s = (
        f"(CASE {cat} {weights} ELSE 0.8 END)::DOUBLE * (CASE WHEN {last} IS NULL THEN 0.5::DOUBLE ELSE greatest(0.1, least(1.0, "
        f"exp(-(greatest(0, ({now} - {last}) // {DAY})) / 90.0::DOUBLE))) END) + least({access}, 100) * 0.01::DOUBLE + least({crawls}, 20) * 0.05::DOUBLE"
    )
    return f"round(CAST(CAST({s} AS VARCHAR) AS DECIMAL(38,20)), 4)::DOUBLE"


IX_SQL = f"""ix AS (SELECT *, {CATEGORY_SQL} AS category, {NOW} - (age_days + 10) * {DAY} AS first_ms,
 CASE WHEN vec_id % 17 <> 0 THEN {NOW} - age_days * {DAY} END AS last_ms FROM ({INDEX}))"""
BATCH = """SELECT vec_id AS pos, url, 'New ' || vec_id AS title, embedding FROM (""" + INDEX + """) x WHERE label % 2 = 0
UNION ALL SELECT vec_id + 1000000, url || CASE WHEN vec_id % 2 = 0 THEN '' ELSE '/new' END, 'Newer ' || vec_id, embedding FROM (""" + INDEX + """) y"""


@query("r3_upsert_index", f"""WITH {IX_SQL}, b AS (SELECT url, arg_max(title, pos) AS title FROM ({BATCH}) GROUP BY 1),
m AS (SELECT coalesce(ix.url, b.url) AS url, b.title IS NOT NULL AS fresh, coalesce(b.title, ix.title) AS title, coalesce(first_ms, {NOW}) AS first_indexed_ms,
 CASE WHEN b.title IS NOT NULL THEN {NOW} ELSE last_ms END AS last_indexed_ms, coalesce(crawl_count, 0) + CASE WHEN b.title IS NOT NULL THEN 1 ELSE 0 END AS crawl_count,
 coalesce(access_count, 0) AS access_count FROM ix FULL JOIN b ON ix.url = b.url)
SELECT url, title, first_indexed_ms, last_indexed_ms, crawl_count, access_count, {CATEGORY_SQL} AS category,
 {_score_sql(f'({CATEGORY_SQL})', 'last_indexed_ms', 'access_count', 'crawl_count', NOW)} AS retention_score FROM m""")
def r3_upsert_index(t):
    merged = I.upsert_index(_index(t).drop("vec_id", "category"), t.sql(BATCH), NOW, "base")
    return merged.select(
        "url", "title", "first_indexed_ms", "last_indexed_ms", "crawl_count", "access_count",
        "category", "retention_score",
    )


# A batch goes in, the lowest rows go out, and the rest is searched by its own ids.
@query("src9_bulk_index", f"""WITH {IX_SQL}, b AS (SELECT url, arg_max(title, pos) AS title, arg_max(embedding, pos) AS embedding FROM ({BATCH}) GROUP BY 1),
m AS (SELECT coalesce(ix.url, b.url) AS url, coalesce(b.embedding, ix.embedding) AS embedding,
 CASE WHEN b.title IS NOT NULL THEN {NOW} ELSE last_ms END AS last_ms, coalesce(crawl_count, 0) + CASE WHEN b.title IS NOT NULL THEN 1 ELSE 0 END AS crawl_count,
 coalesce(access_count, 0) AS access_count FROM ix FULL JOIN b ON ix.url = b.url),
s AS (SELECT *, CAST('0x' || left(sha256(url), 16) AS UBIGINT) AS id, {_score_sql(f'({CATEGORY_SQL})', 'last_ms', 'access_count', 'crawl_count', NOW)} AS score FROM m),
o AS (SELECT *, row_number() OVER (ORDER BY score, id) AS r, count(*) OVER () AS n FROM s), kept AS (SELECT * FROM o WHERE r > n - 300 + 100),
qv AS (SELECT max(vec_id) AS query_id, arg_max(embedding, vec_id) AS query_vector FROM embeddings GROUP BY label, vec_id % 20),
c AS (SELECT query_id, id, url, {_cos('query_vector', 'embedding')} AS similarity FROM qv, kept),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM c)
SELECT query_id, rank, id::VARCHAR AS id, url, similarity FROM z WHERE rank <= 3""")
def src9_bulk_index(t):
    merged = cut_lineage(I.upsert_index(_index(t).drop("vec_id", "category"), t.sql(BATCH), NOW, "base"))
    kept, _ = I.evict(merged, max_docs=300)
    hits = S.vector_search(kept.withColumn("embedding", F.col("vectors")["base"]), _query_vectors(t), 3)
    return hits.join(kept.select("id", "url"), "id").select(
        "query_id", "rank", F.col("id").cast("string").alias("id"), "url", "similarity"
    )


@query("r4_add_vectors", f"""WITH {IX_SQL} SELECT url, CASE WHEN label % 2 = 0 THEN 'base,wide' ELSE 'base' END AS models,
 CASE WHEN label % 2 = 0 THEN 2 ELSE 1 END AS n_vectors FROM ix""")
def r4_add_vectors(t):
    new = t.sql(INDEX).where("label % 2 = 0").select("url", "embedding")
    both = I.add_vectors(_index(t), new, "wide")
    return both.select("url", F.array_join("models", ",").alias("models"), F.size("vectors").alias("n_vectors"))


SCORED_SQL = f"WITH {IX_SQL}, sc AS (SELECT *, {_score_sql('category', 'last_ms', 'access_count', 'crawl_count', NOW)} AS score FROM ix)"


def _scored(t):
    return _index(t).withColumn("retention_score", I.retention_score(
        F.col("category"), F.col("last_indexed_ms"), F.col("access_count"), F.col("crawl_count"), F.lit(NOW)
    ))


@query("r5_retention_score", SCORED_SQL + " SELECT url, category, score AS retention_score FROM sc")
def r5_retention_score(t):
    return _scored(t).select("url", "category", "retention_score")


@query("r6_evict", SCORED_SQL + """, n AS (SELECT count(*) AS n FROM sc), r AS (SELECT *, row_number() OVER (ORDER BY score, vec_id) AS r FROM sc)
SELECT vec_id, score AS retention_score FROM r, n WHERE r <= n - 300 + 100""")
def r6_evict(t):
    _, gone = I.evict(_scored(t), max_docs=300, id_col="vec_id")
    return gone.select("vec_id", "retention_score")


HITS = "SELECT user_id * 3 AS id, value FROM {events} WHERE event_type = 'view'"


@query("r7_track_access", f"""WITH {IX_SQL}, h AS (SELECT id, count(*) AS n FROM ({HITS}) GROUP BY 1)
SELECT vec_id AS id, access_count + coalesce(n, 0) AS access_count, CASE WHEN n > 0 THEN {NOW} END AS last_accessed_ms FROM ix LEFT JOIN h ON vec_id = id""")
def r7_track_access(t):
    ix = _index(t).withColumnRenamed("vec_id", "id")
    return I.track_access(ix, t.sql(HITS), NOW).select("id", "access_count", "last_accessed_ms")


@query("r8_delete_and_stats", f"""SELECT count(*) AS documents, 250000 AS max_documents FROM embeddings
WHERE vec_id NOT IN (SELECT id FROM ({HITS}))""")
def r8_delete_and_stats(t):
    ix = _index(t).withColumnRenamed("vec_id", "id")
    return I.index_stats(I.delete_points(ix, t.sql(HITS).select("id").distinct()), 250_000)


# Queries are the centroid-like vectors of each (label, residue) group.
def _query_vectors(t, residues=20):
    q = t.embeddings.groupBy("label", (F.col("vec_id") % residues).alias("r")).agg(
        F.max_by("embedding", "vec_id").alias("query_vector"), F.max("vec_id").alias("query_id")
    )
    return q.select("query_id", "query_vector")


QV_SQL = "qv AS (SELECT max(vec_id) AS query_id, arg_max(embedding, vec_id) AS query_vector FROM embeddings GROUP BY label, vec_id % 20)"


@query("r9_vector_search", f"""WITH {QV_SQL}, s AS (SELECT query_id, vec_id AS id, {_cos('query_vector', 'embedding')} AS similarity FROM qv, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""")
def r9_vector_search(t):
    index = t.embeddings.withColumnRenamed("vec_id", "id")
    return S.vector_search(index, _query_vectors(t), 10)


# Documents as pages of a corpus; every twentieth one asks for pages like it.
CORPUS = """SELECT doc_id AS id, 'https://d.example/' || doc_id AS url, coalesce(source, '') || ' ' || coalesce(lang, '') AS title, text FROM {documents}"""
CORPUS_SQL = f"""dc AS (SELECT *, coalesce(title, '') || ' ' || coalesce(text, '') AS whole, text[1:200] AS description FROM ({CORPUS}))"""
ASKING_SQL = "ak AS (SELECT id, title, text FROM dc WHERE id % 20 = 0 AND trim(coalesce(text, '')) <> '')"


def _corpus(t):
    return t.sql(CORPUS)


def _asking(t):
    return _corpus(t).where("id % 20 = 0").select(F.col("id").alias("query_id"), "title", "text")


def _pairs_sql(name: str, q: str, d: str, pairs: str, decimals: int = 12) -> str:
    """CTE ``name`` (query_id, id, sim): cosine of hashed vectors ``q`` and ``d`` for ``pairs`` (query_id, id)."""
    return f"""{name}_dot AS (SELECT a.id AS query_id, b.id, sum(a.v * b.v) AS x FROM {q} a JOIN {d} b ON a.slot = b.slot GROUP BY 1, 2),
{name} AS MATERIALIZED (SELECT p.*, CASE WHEN qn.size > 0 AND dn.size > 0 THEN round(coalesce(x, 0) / (qn.size * dn.size), {decimals}) ELSE 0 END AS sim
 FROM {pairs} p JOIN {q}_n qn ON p.query_id = qn.id JOIN {d}_n dn ON p.id = dn.id LEFT JOIN {name}_dot k ON p.query_id = k.query_id AND p.id = k.id)"""


def _keyword_sql(name: str, queries: str, corpus: str, text: str, k: int) -> str:
    """CTE ``name`` (query_id, id, score, rank): tf-idf top-k of ``corpus`` (id, text) for ``queries`` (query_id, asked)."""
    wd = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
    return f"""{name}_q AS MATERIALIZED (SELECT DISTINCT query_id, unnest({wd.format('asked')}) AS word FROM {queries}),
{name}_t AS (SELECT id, unnest({wd.format(text)}) AS word FROM {corpus}),
{name}_c AS MATERIALIZED (SELECT id, word, count(*) AS tf FROM {name}_t SEMI JOIN {name}_q USING (word) GROUP BY ALL),
{name}_i AS (SELECT word, ln(1 + (SELECT count(*) FROM {corpus})::DOUBLE / count(*)) AS idf FROM {name}_c GROUP BY 1),
{name}_s AS (SELECT query_id, id, round(sum((1 + ln(tf)) * idf), 6) AS score FROM {name}_q JOIN {name}_i USING (word) JOIN {name}_c USING (word) GROUP BY ALL),
{name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_s QUALIFY rank <= {k})"""


@query("r10_find_similar", f"""WITH {CORPUS_SQL}, {ASKING_SQL}, qt AS (SELECT id, title || ' ' || left(text, 3000) AS asked FROM ak),
{_hashed_sql('hq', 'qt', 'asked')}, {_hashed_sql('hd', 'dc', 'whole')}, allp AS (SELECT qt.id AS query_id, dc.id FROM qt, dc),
{_pairs_sql('s', 'hq', 'hd', 'allp')}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s)
SELECT query_id, rank, url, description FROM r JOIN dc USING (id) WHERE rank <= 5""")
def r10_find_similar(t):
    corpus = S.build_corpus(_corpus(t))
    return S.find_similar(corpus, _asking(t), 5).select("query_id", "rank", "url", "description")


@query("r11_find_similar_web", f"""WITH {CORPUS_SQL}, {ASKING_SQL},
kq AS (SELECT id AS query_id, title || ' ' || CASE WHEN instr(text, chr(10) || chr(10)) > 0 THEN string_split(text, chr(10) || chr(10))[1] ELSE left(text, 500) END AS asked FROM ak),
{_keyword_sql('kw', 'kq', 'dc', 'whole', 10)},
qt AS (SELECT id, left(text, 5000) AS asked FROM ak), cd AS (SELECT id, title || ' ' || coalesce(description, '') AS shown FROM dc),
{_hashed_sql('hq', 'qt', 'asked')}, {_hashed_sql('hd', 'cd', 'shown')}, cand AS (SELECT query_id, id, rank AS pos FROM kw),
{_pairs_sql('s', 'hq', 'hd', 'cand')}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, pos) AS rank FROM s)
SELECT query_id, rank, url, round(sim, 6) AS similarity FROM r JOIN dc USING (id) WHERE rank <= 5""")
def r11_find_similar_web(t):
    corpus = S.build_corpus(_corpus(t))
    return S.find_similar_web(corpus, _asking(t), 5).select("query_id", "rank", "url", "similarity")


CANDS = """SELECT label AS query_id, vec_id AS pos, CASE WHEN vec_id % 50 = 0 THEN CAST(NULL AS STRING) ELSE 'u' || vec_id END AS url, embedding FROM {embeddings}"""
LQ_SQL = "lq AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS query_vector FROM embeddings GROUP BY 1)"


def _label_queries(t):
    return t.embeddings.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("query_vector"))


@query("r11_similar_candidates", f"""WITH {LQ_SQL}, s AS (SELECT e.label AS query_id, vec_id AS pos, {_cos('query_vector', 'embedding')} AS similarity FROM embeddings e JOIN lq ON e.label = lq.query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, pos) AS rank FROM s) SELECT query_id, pos, similarity, rank FROM r WHERE rank <= 10""")
def r11_similar_candidates(t):
    return S.similar_from_candidates(_label_queries(t), t.sql(CANDS), 10).select("query_id", "pos", "similarity", "rank")


@query("r12_semantic_rerank", f"""WITH {LQ_SQL}, s AS (SELECT e.label AS query_id, vec_id AS pos, round(list_dot_product(CAST(query_vector AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 12) AS similarity FROM embeddings e JOIN lq ON e.label = lq.query_id)
SELECT query_id, pos, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, pos) AS rank FROM s""")
def r12_semantic_rerank(t):
    return S.semantic_rerank(_label_queries(t), t.sql(CANDS)).select("query_id", "pos", "similarity", "rank")


PAIRS = """SELECT CAST(doc_id % 40 AS BIGINT) AS query_id, doc_id AS pos, lang || ' ' || source || ' the of' AS query_text, text FROM {documents}"""


@query("r13_pair_rerank", f"""WITH p AS ({PAIRS}), w AS (SELECT query_id, pos, list_distinct(regexp_split_to_array(lower(query_text), '\\s+')) AS q, regexp_split_to_array(lower(text), '\\s+') AS x FROM p),
s AS (SELECT query_id, pos, round(len(list_filter(q, lambda z: list_contains(x, z))) / len(q), 6) AS score FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM s) SELECT * FROM r WHERE rank <= 5""")
def r13_pair_rerank(t):
    return S.pair_rerank(t.sql(PAIRS), "query_text", "text", 5).select("query_id", "pos", "score", "rank")


KW_HITS = "SELECT user_id AS query_id, event_id AS pos, 'u' || CAST(floor(value / 4) AS BIGINT) AS url FROM {events} WHERE event_type = 'click'"
VEC_HITS = "SELECT user_id AS query_id, event_id AS pos, 'u' || CAST(floor(value / 3) AS BIGINT) AS url FROM {events} WHERE event_type = 'view'"


@query("r14_hybrid_merge", f"""WITH a AS (SELECT 0 AS list_no, * FROM ({KW_HITS}) UNION ALL SELECT 1, * FROM ({VEC_HITS})),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY list_no, pos) AS f FROM a),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY list_no, pos) AS rank FROM f WHERE f = 1)
SELECT query_id, url, list_no, rank FROM r WHERE rank <= 10""")
def r14_hybrid_merge(t):
    return S.hybrid_merge(t.sql(KW_HITS), t.sql(VEC_HITS), 10).select("query_id", "url", "list_no", "rank")


@query("r15_retrieve_modes", f"""WITH {CORPUS_SQL}, kq AS (SELECT item_id AS query_id, text AS asked FROM benchmark), qt AS (SELECT query_id AS id, asked FROM kq),
{_keyword_sql('kw', 'kq', 'dc', 'whole', 10)}, {_hashed_sql('hq', 'qt', 'asked')}, {_hashed_sql('hd', 'dc', 'whole')},
allp AS (SELECT qt.id AS query_id, dc.id FROM qt, dc), {_pairs_sql('s', 'hq', 'hd', 'allp')},
vec AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s QUALIFY rank <= 10),
sm AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, kw.rank) AS rank FROM kw JOIN s USING (query_id, id)),
ov AS (SELECT query_id, id, rank AS pos, list_filter(list_distinct(regexp_split_to_array(lower(trim(regexp_replace(asked, '\\s+', ' ', 'g'))), ' ')), lambda w: w <> '') AS q,
 regexp_split_to_array(lower(trim(regexp_replace(coalesce(description, ''), '\\s+', ' ', 'g'))), ' ') AS x FROM kw JOIN kq USING (query_id) JOIN dc USING (id)),
hy AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN len(q) > 0 THEN round(len(list_filter(q, lambda w: list_contains(x, w))) / len(q), 6) ELSE 0 END DESC, pos) AS rank FROM ov),
a AS (SELECT 0 AS l, query_id, rank AS pos, id FROM kw UNION ALL SELECT 1, query_id, rank, id FROM vec),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY l, pos) AS f FROM a),
hv AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY l, pos) AS rank FROM f WHERE f = 1)
SELECT mode, query_id, 'https://d.example/' || id AS url, rank FROM (SELECT 'keyword' AS mode, query_id, id, rank FROM kw UNION ALL SELECT 'vector', query_id, id, rank FROM vec
UNION ALL SELECT 'semantic', query_id, id, rank FROM sm UNION ALL SELECT 'hybrid', query_id, id, rank FROM hy UNION ALL SELECT 'hybrid_vector', query_id, id, rank FROM hv WHERE rank <= 10)""")
def r15_retrieve_modes(t):
    corpus = S.build_corpus(_corpus(t))
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    keyword, vector = (cut_lineage(hits(corpus, queries, 10)) for hits in (S.keyword_hits, S.vector_hits))
    out = None
    for mode in S.MODES:
        rows = S.retrieve(mode, corpus, queries, 10, keyword=keyword, vector=vector).select(F.lit(mode).alias("mode"), "query_id", "url", "rank")
        out = rows if out is None else out.unionByName(rows)
    return out


_wd = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


@query("r16_keyword_search", f"""WITH q AS (SELECT DISTINCT item_id AS query_id, unnest({_wd}) AS word FROM benchmark),
v AS (SELECT DISTINCT word FROM q), tk AS (SELECT doc_id, unnest({_wd}) AS word FROM documents),
c AS (SELECT doc_id, word, count(*) AS tf FROM tk SEMI JOIN v ON tk.word = v.word GROUP BY ALL),
i AS (SELECT word, ln(1 + (SELECT count(*) FROM documents)::DOUBLE / count(*)) AS idf FROM c GROUP BY 1),
s AS (SELECT query_id, doc_id, round(sum((1 + ln(tf)) * idf), 6) AS score FROM q JOIN i USING (word) JOIN c USING (word) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 10""")
def r16_keyword_search(t):
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return S.keyword_search(t.documents.select("doc_id", "text"), queries, 10)


@query("r17_backfill_vectors", f"""WITH {IX_SQL} SELECT count(*) AS docs_total, count(*) AS docs_processed, 'dual_write' AS phase,
 min(64) AS small_dim FROM ix""")
def r17_backfill_vectors(t):
    new = t.sql(INDEX).where("label % 2 = 0").select("url", "embedding")
    started = I.add_vectors(_index(t), new, "wide")
    done = I.backfill_vectors(started, "wide", "base", dim=64)
    return done.agg(
        F.count("*").alias("docs_total"),
        F.sum(F.map_contains_key("vectors", "wide").cast("long")).alias("docs_processed"),
        F.when(F.min(F.map_contains_key("vectors", "wide").cast("int")) == 1, "dual_write").otherwise("backfilling").alias("phase"),
        F.min(F.size(F.col("vectors")["wide"])).alias("small_dim"),
    )


@query("r17_migration_progress", f"""WITH {IX_SQL} SELECT count(*) AS docs_total, count(*) FILTER (label % 2 = 0) AS docs_processed, 'backfilling' AS phase FROM ix""")
def r17_migration_progress(t):
    new = t.sql(INDEX).where("label % 2 = 0").select("url", "embedding")
    return I.migration_progress(I.add_vectors(_index(t), new, "wide"), "wide")


BUCKETS = """SELECT user_id AS query_id, event_id AS pos, CASE event_type WHEN 'view' THEN 'web' WHEN 'click' THEN 'images' WHEN 'signup' THEN 'news' ELSE 'other' END AS source FROM {events}"""


@query("r18_bucket_results", f"""SELECT query_id, source, pos, row_number() OVER (PARTITION BY query_id, source ORDER BY pos) AS position FROM ({BUCKETS}) WHERE source <> 'other'""")
def r18_bucket_results(t):
    return S.bucket_results(t.sql(BUCKETS))


# ------------------------------------------------------------------ memory

MEMORY = """SELECT vec_id AS id, embedding, vec_id % 3 AS user_id, CAST(vec_id AS BIGINT) % 40 AS age_days, CASE WHEN vec_id % 11 = 0 THEN '' WHEN vec_id % 13 = 0 THEN 'Error: x' ELSE 'artifact ' || vec_id END AS artifact FROM {embeddings}"""
TTL = 30 * 86400


def _memory(t):
    created = F.lit(NOW) - F.col("age_days") * DAY
    return t.sql(MEMORY).select(
        "id", "embedding", "user_id", "artifact", created.alias("created_ms"),
        (created + TTL * 1000).alias("expires_ms"),
    )


def _mem_queries(t):
    # Small shifts of stored vectors, so that some queries are near and some are not.
    shifted = F.zip_with(
        "embedding", F.reverse("embedding"), lambda a, b: (a + b * F.lit(0.4) * (F.col("label") % 3)).cast("float")
    )
    return t.embeddings.select(
        F.col("vec_id").alias("query_id"), shifted.alias("query_vector"), (F.col("vec_id") % 3).alias("user_id"), "label"
    )


MQ_SQL = f"""mq AS (SELECT vec_id AS query_id, vec_id % 3 AS user_id, list_transform(list_zip(embedding, list_reverse(embedding)), lambda p: CAST(p[1]::DOUBLE + p[2]::DOUBLE * 0.4 * (label % 3) AS FLOAT)) AS query_vector FROM embeddings),
me AS (SELECT *, {NOW} - age_days * {DAY} AS created_ms, {NOW} - age_days * {DAY} + {TTL * 1000} AS expires_ms FROM ({MEMORY}))"""


def _memory_sql(extra, memory="me", more=""):
    return f"""WITH {MQ_SQL}{more}, s AS (SELECT query_id, id, {_cos('query_vector', 'embedding')} AS similarity, created_ms, expires_ms FROM mq JOIN {memory} AS me ON {extra}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s),
b AS (SELECT query_id, arg_min(id, rank) AS memory_id, arg_min(similarity, rank) AS similarity, arg_min(created_ms, rank) AS c FROM r WHERE rank <= 5 AND similarity >= 0.85 AND expires_ms > {NOW} GROUP BY 1)
SELECT mq.query_id, memory_id IS NOT NULL AS hit, memory_id, similarity, CASE WHEN c IS NULL THEN NULL WHEN ({NOW} - c) / 1000 < {TTL} / 4 THEN 'fresh' WHEN ({NOW} - c) / 1000 < {TTL} / 2 THEN 'aging' ELSE 'stale' END AS freshness
FROM mq LEFT JOIN b ON mq.query_id = b.query_id"""


@query("m1_memory_query", _memory_sql("true"))
def m1_memory_query(t):
    return M.memory_query(_mem_queries(t), _memory(t), NOW, TTL)


@query("m1_memory_query_by_user", _memory_sql("mq.user_id = me.user_id"))
def m1_memory_query_by_user(t):
    return M.memory_query(_mem_queries(t), _memory(t), NOW, TTL, per_user=True)


@query("m2_freshness", f"""SELECT id, CASE WHEN age_days * 86400 < {TTL} / 4 THEN 'fresh' WHEN age_days * 86400 < {TTL} / 2 THEN 'aging' ELSE 'stale' END AS freshness FROM ({MEMORY})""")
def m2_freshness(t):
    return _memory(t).select("id", M.freshness((F.lit(NOW) - F.col("created_ms")) / 1000, TTL).alias("freshness"))


@query("m3_memory_store", f"""SELECT id, {NOW} - age_days * {DAY} + {TTL * 1000} AS expires_ms FROM ({MEMORY})
UNION ALL SELECT id + 1000000, {NOW + TTL * 1000} FROM ({MEMORY}) WHERE artifact <> '' AND artifact NOT LIKE 'Error:%' AND id % 7 <> 0""")
def m3_memory_store(t):
    batch = t.sql(MEMORY).select(
        (F.col("id") + 1000000).alias("id"), "artifact",
        F.when(F.col("id") % 7 != 0, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>")).alias("sources"),
    )
    return M.memory_store(_memory(t), batch, NOW, TTL).select("id", "expires_ms")


@query("m4_memory_sweep", f"SELECT id FROM ({MEMORY}) WHERE age_days >= 30")
def m4_memory_sweep(t):
    m = _memory(t)
    return M.memory_sweep(m.select("id"), m, NOW)


@query("m5_memory_delete_get", f"""SELECT 'kept' AS part, id FROM ({MEMORY}) WHERE id NOT IN (SELECT user_id FROM events)
UNION ALL SELECT 'got', id FROM ({MEMORY}) WHERE id IN (SELECT user_id FROM events) AND age_days < 30""")
def m5_memory_delete_get(t):
    ids = t.events.select(F.col("user_id").alias("id")).distinct()
    kept = M.memory_delete(_memory(t), ids).select(F.lit("kept").alias("part"), "id")
    return kept.unionByName(M.memory_get(_memory(t), ids, NOW).select(F.lit("got").alias("part"), "id"))


@query("m6_batch_query", f"""WITH {MQ_SQL} SELECT count(*) AS queries, count(*) AS answered FROM mq""")
def m6_batch_query(t):
    answers = M.memory_query(_mem_queries(t), _memory(t), NOW, TTL)
    return answers.agg(F.count("*").alias("queries"), F.countDistinct("query_id").alias("answered"))


# A batch of artifacts is stored, its bad ones turned away, and a batch of queries asks old and new ones.
_STORED = f""", me2 AS (SELECT id, embedding, created_ms, expires_ms FROM me UNION ALL SELECT id + 1000000, list_reverse(embedding), {NOW}, {NOW + TTL * 1000} FROM me
 WHERE artifact <> '' AND artifact NOT LIKE 'Error:%' AND id % 7 <> 0)"""


@query("m6_batch_store_and_query", _memory_sql("true", "me2", _STORED))
def m6_batch_store_and_query(t):
    batch = t.sql(MEMORY).select(
        (F.col("id") + 1000000).alias("id"), "artifact", F.reverse("embedding").alias("embedding"),
        F.when(F.col("id") % 7 != 0, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>")).alias("sources"),
    )
    return M.memory_query(_mem_queries(t), M.memory_store(_memory(t), batch, NOW, TTL), NOW, TTL)


USERS = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'key' || user_id ELSE '' END AS api_key, CASE event_id % 4 WHEN 1 THEN 'Bearer tok' || user_id ELSE '' END AS auth,
 CASE event_id % 4 WHEN 2 THEN ' 10.0.0.' || (user_id % 250) || ' , 1.1.1.1' ELSE '' END AS forwarded, '192.0.2.' || (user_id % 200) AS peer FROM {events}"""


@query("m7_derive_user", f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN left(sha256(api_key), 16) WHEN 1 THEN left(sha256(replace(auth, 'Bearer ', '')), 16)
 WHEN 2 THEN trim(split_part(forwarded, ',', 1)) ELSE peer END AS user_key FROM ({USERS})""")
def m7_derive_user(t):
    cols = [F.col(c) for c in ("api_key", "auth", "forwarded", "peer")]
    return t.sql(USERS).select("event_id", M.derive_user(*cols).alias("user_key"))


CTX = """SELECT doc_id % 50 AS query_id, doc_id AS pos, 'https://www.' || source || '.example.com/' || doc_id AS url, 'T' || doc_id AS title, text AS markdown FROM {documents}"""


@query("m8_build_context", f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS r FROM ({CTX}))
SELECT query_id, count(*) AS sources, string_agg('[' || r || '] Source: ' || url || chr(10) || 'Title: ' || title || chr(10) || chr(10) || 'Source: ' || url || ' (domain: ' || {A.host('url')} || ')' || chr(10) || chr(10) || markdown[1:8000],
 chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY r) AS context FROM d WHERE r <= 4 GROUP BY 1""")
def m8_build_context(t):
    return M.build_context(t.sql(CTX), 4)


ANSWERS = """SELECT doc_id AS answer_id, 'A [1] and [2](http://x) then [' || (doc_id % 6) || '] or [1] [99] end [' || (doc_id % 4) || ']' || lang AS text FROM {documents}"""
SOURCES = " UNION ALL ".join(
    f"SELECT doc_id AS answer_id, {k} AS idx, 'https://s.example/{k}/' || doc_id AS url, 'S{k}' AS title FROM {{documents}}" for k in (1, 2, 3, 4)
)
_marks = f"""an AS ({ANSWERS}), so AS ({SOURCES}), mk AS (SELECT answer_id, unnest(regexp_extract_all(text, '\\[([0-9]+)\\]', 1)) AS m, generate_subscripts(regexp_extract_all(text, '\\[([0-9]+)\\]', 1), 1) AS i FROM an)"""


@query("m9_cite_inline", f"""WITH {_marks}, f AS (SELECT mk.answer_id, idx, url, min(i) AS i FROM mk JOIN so ON mk.answer_id = so.answer_id AND CAST(m AS INT) = idx GROUP BY ALL)
SELECT answer_id, idx, url, i - 1 AS first_pos FROM f""")
def m9_cite_inline(t):
    return M.cite_inline(t.sql(ANSWERS), t.sql(SOURCES))


def _sub(text, n, once=False):
    """Link open markers of number n; linked ones are hidden behind chr(1)."""
    return f"regexp_replace({text}, '\\[{n}\\]', '[{n}](https://s.example/{n}/' || answer_id || ')'{'' if once else ', ' + A.q('g')})"


_guard = "replace(text, '[2](', chr(1))"
_all4 = _guard
for _n in (1, 2, 3, 4):
    _all4 = _sub(_all4, _n)
_first4 = _guard
for _n in (1, 2, 3, 4):
    _first4 = _sub(_first4, _n, once=True)


@query("m10_cite_compact", f"WITH an AS ({ANSWERS}) SELECT answer_id, replace({_all4}, chr(1), '[2](') AS resolved_text FROM an")
def m10_cite_compact(t):
    texts, _ = M.cite_compact(t.sql(ANSWERS), t.sql(SOURCES))
    return texts


@query("m11_resolve_citations", f"WITH an AS ({ANSWERS}) SELECT answer_id, replace({_first4}, chr(1), '[2](') AS resolved_text FROM an")
def m11_resolve_citations(t):
    texts, _ = M.resolve_citations(t.sql(ANSWERS), t.sql(SOURCES))
    return texts


@query("m11_resolved_list", f"""WITH {_marks}, f AS (SELECT DISTINCT mk.answer_id, idx, url, title FROM mk JOIN so ON mk.answer_id = so.answer_id AND CAST(m AS INT) = idx)
SELECT answer_id, idx, url, title, '[' || idx || ']' AS marker_text, '[' || idx || ']' AS resolved_text FROM f""")
def m11_resolved_list(t):
    _, cited = M.resolve_citations(t.sql(ANSWERS), t.sql(SOURCES), "inline")
    return cited.drop("first_pos")


FENCED = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' {"a": ' || doc_id || '} ' WHEN 1 THEN 'Sure:
```json
{"a": ' || doc_id || '}
``` done' WHEN 2 THEN 'x ```
{"a": ' || doc_id || '}
```' WHEN 3 THEN 'no json ' || doc_id ELSE '```json
{broken
```' END AS text FROM {documents}"""


@query("m12_fenced_json", "SELECT doc_id, CASE WHEN doc_id % 5 < 3 THEN '{\"a\": ' || doc_id || '}' END AS json FROM documents")
def m12_fenced_json(t):
    return t.sql(FENCED).select("doc_id", H.fenced_json(F.col("text")).alias("json"))


@query("m13_trim_passage", """SELECT doc_id, trim(CASE WHEN length(text) > 500 THEN regexp_replace(text[1:500], '(?s) [^ ]*$', '') ELSE text END, ' ' || chr(9) || chr(10) || chr(13)) AS passage FROM documents""")
def m13_trim_passage(t):
    return t.documents.select("doc_id", H.trim_passage(F.col("text"), 500).alias("passage"))


ITEM_RESULTS = "SELECT doc_id % 200 AS item_id, doc_id AS pos, 'https://e.example/' || doc_id AS url FROM {documents}"
PAGE_TEXT = "SELECT 'https://e.example/' || doc_id AS url, text AS markdown, doc_id % 4 <> 0 AS success FROM {documents}"


@query("m14_enrichment_inputs", f"""WITH r AS (SELECT item_id, arg_min(url, pos) AS url FROM ({ITEM_RESULTS}) GROUP BY 1)
SELECT d.doc_id AS item_id, concat_ws(' ', d.lang, d.n_chars, 'pricing') AS query, r.url, p.markdown[1:8000] AS content
FROM documents d LEFT JOIN r ON d.doc_id = r.item_id LEFT JOIN ({PAGE_TEXT}) p ON r.url = p.url""")
def m14_enrichment_inputs(t):
    items = t.documents.select(F.col("doc_id").alias("item_id"), "lang", "n_chars")
    return M.enrichment_inputs(items, ["lang", "n_chars"], t.sql(ITEM_RESULTS), t.sql(PAGE_TEXT), "pricing")


@query("m15_attach_contents", f"""WITH p AS (SELECT * FROM ({PAGE_TEXT}) WHERE success AND markdown <> '')
SELECT r.item_id, r.pos, r.url, p.markdown FROM ({ITEM_RESULTS}) r LEFT JOIN p ON r.url = p.url""")
def m15_attach_contents(t):
    return M.attach_contents(t.sql(ITEM_RESULTS), t.sql(PAGE_TEXT))


SRC_ROWS = """SELECT user_id AS run_id, event_id AS seq, 'https://m.example/' || CAST(floor(value) AS BIGINT) AS url, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'T' || event_id END AS title,
 CASE WHEN event_id % 4 = 0 THEN event_id END AS chars FROM {events}"""


@query("m16_merge_sources", f"""SELECT run_id, url, min(seq) AS seq, arg_max(title, seq) FILTER (title IS NOT NULL) AS title, arg_max(chars, seq) FILTER (chars IS NOT NULL) AS chars
FROM ({SRC_ROWS}) GROUP BY 1, 2""")
def m16_merge_sources(t):
    return M.merge_sources(t.sql(SRC_ROWS), ["run_id"], "seq", ["title", "chars"])


@query("m17_session_transcript", """SELECT conv_id, turn, role, row_number() OVER w AS step_index, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset"
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def m17_session_transcript(t):
    return M.session_transcript(t.conversations, "conv_id", "turn", "text").select(
        "conv_id", "turn", "role", "step_index", "offset"
    )


REFS = "SELECT conv_id, 'ref_' || turn || '_1' AS ref_id, 'https://r.example/' || turn AS url, role AS title, length(text) AS char_count FROM {conversations} WHERE role = 'assistant'"


@query("m17_session_export", f"""WITH s AS (SELECT conv_id, count(*) AS steps, sum(length(text)) AS artifact_length FROM conversations GROUP BY 1),
r AS (SELECT conv_id, count(*) AS refs, sum(char_count) AS ref_chars FROM ({REFS}) GROUP BY 1) SELECT s.*, r.refs, r.ref_chars FROM s LEFT JOIN r ON s.conv_id = r.conv_id""")
def m17_session_export(t):
    return M.session_export(t.conversations, t.sql(REFS), "conv_id", "text")


@query("m18_resolve_refs", f"SELECT r.* FROM ({REFS}) r WHERE CAST(split_part(ref_id, '_', 2) AS BIGINT) % 2 = 1")
def m18_resolve_refs(t):
    ids = t.sql("SELECT conv_id, 'ref_' || (turn * 2 + 1) || '_1' AS ref_id FROM {conversations}")
    more = t.sql("SELECT conv_id, 'ref_' || turn || '_1' AS ref_id FROM {conversations} WHERE turn % 2 = 1")
    return M.resolve_refs(ids.unionByName(more), t.sql(REFS), ["conv_id", "ref_id"])


@query("m19_memory_admit", f"SELECT id FROM ({MEMORY}) WHERE artifact <> '' AND artifact NOT LIKE 'Error:%' AND id % 7 <> 0")
def m19_memory_admit(t):
    batch = t.sql(MEMORY).select(
        "id", "artifact",
        F.when(F.col("id") % 7 != 0, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>")).alias("sources"),
    )
    return M.memory_admit(batch).select("id")


@query("m20_memory_reuse", f"""WITH a AS ({_memory_sql('mq.user_id = me.user_id')})
SELECT query_id, CASE WHEN hit AND freshness IN ('fresh', 'aging') AND query_id % 5 <> 0 THEN 'reuse' ELSE 'run' END AS decision FROM a""")
def m20_memory_reuse(t):
    q = _mem_queries(t)
    hits = M.memory_query(q, _memory(t), NOW, TTL, per_user=True)
    forced = q.select("query_id", (F.col("query_id") % 5 == 0).alias("force_fresh"))
    return M.memory_reuse(forced, hits).select("query_id", "decision")


STEP_ROWS = """SELECT user_id AS session_id, CAST(floor(value / 10) AS BIGINT) AS step, event_id AS pos, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'https://b.example/' || event_id END AS url, CASE WHEN event_id % 2 = 0 THEN 'T' || event_id ELSE '' END AS title FROM {events}"""


@query("m21_build_refs", f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY session_id, step ORDER BY pos) AS n FROM ({STEP_ROWS})),
k AS (SELECT *, 'ref_' || step || '_' || n AS ref_id, row_number() OVER (PARTITION BY session_id, step ORDER BY n) AS p FROM n WHERE url <> '')
SELECT session_id, step, url, ref_id, CASE WHEN p <= 10 THEN '- [' || CASE WHEN title <> '' THEN title ELSE url END || '](' || url || ') `' || ref_id || '`' END AS listed_line FROM k""")
def m21_build_refs(t):
    return M.build_refs(t.sql(STEP_ROWS), "session_id", "step", "pos").select(
        "session_id", "step", "url", "ref_id", "listed_line"
    )
