"""Registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webstrata.llm import (
    chat, langid, manifest, media, mixing, packing, quality, simhash, subvector, topk, toxicity, warc, wordbpe,
)
from webstrata.llm.shared import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Register a builder ``(read) -> DataFrame``; ``read(table)`` gives a table."""

    def wrap(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return build(lambda table: spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet"))

        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return wrap


@register("op1_simhash_bktree")
def op1(read):
    return simhash.near_duplicates(read("documents"))


@register("op2_bin_slack_packing")
def op2(read):
    return packing.pack(read("documents"))


@register("op3_image_archive")
def op3(read):
    return media.round_trip(read("documents"))


@register("op4_sharded_warc", """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS head FROM pages)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)
    FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to
FROM p
""")
def op4(read):
    return warc.round_trip(read("pages"))


@register("op5_golden_mixing", """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5('0:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (
  SELECT source, sum(size)::HUGEINT AS ss,
    1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w,
    row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
t AS (SELECT sum(ss)::HUGEINT AS total, count(*) AS k FROM s),
b AS (SELECT *, greatest(1, ceil(total / greatest(131072, 1024 * k)))::HUGEINT AS block FROM t),
o AS (
  SELECT *, coalesce(sum(3 * ss) OVER (a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS below,
    sum(w) OVER (a ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS above
  FROM s WINDOW a AS (ORDER BY ss / w, i)),
level AS (
  SELECT below, above FROM o, t WHERE (total - below) * w <= 3 * ss * above ORDER BY ss / w, i LIMIT 1),
target AS (
  SELECT s.*, CASE WHEN w * (total - below) > 3 * ss * above THEN 3 * ss * above ELSE w * (total - below) END AS num,
    above, total FROM s, t, level),
span AS (
  SELECT *, sum(num) OVER (ORDER BY i)::HUGEINT AS upto FROM target),
bound AS (
  SELECT *, (upto - num) * 4294967296 // greatest(total * above, 1) AS low,
    upto * 4294967296 // greatest(total * above, 1) AS high FROM span),
slot AS (
  SELECT (x * 2654435769) % 4294967296 AS u
  FROM b, range(0, (SELECT ceil(total / block) FROM b)::BIGINT) r(x)),
filled AS (
  SELECT bound.i, count(slot.u) AS slots, any_value((2 * num + above) // (2 * above)) AS words
  FROM bound LEFT JOIN slot ON u >= low AND u < high GROUP BY bound.i),
laid AS (
  SELECT d.*, ss, num, above, words, slots,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM d JOIN bound ON d.source IS NOT DISTINCT FROM bound.source JOIN filled USING (i))
SELECT doc_id, size, ss::BIGINT AS source_size, num::DOUBLE / above::DOUBLE AS target,
  CASE WHEN size = 0 THEN 0 ELSE
    (words // ss) * size + greatest(0, least(pos + size, words % ss) - pos) END::BIGINT AS taken, slots
FROM laid
""")
def op5(read):
    return mixing.taken(read("documents"), exact=True)


@register("op6_subword_toxicity")
def op6(read):
    return toxicity.assess(read("documents"), read("labels"))


@register("op7_crf_quality")
def op7(read):
    return quality.assess(read("documents"), read("labels"))


@register("op8_snapshot_collapse_chat", """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM t),
c AS (
  SELECT conv_id, count(*) AS turns, list(coalesce(role, '\x00') || chr(1) || coalesce(text, '\x00') ORDER BY pos) AS s
  FROM n GROUP BY conv_id),
kept AS (
  SELECT conv_id, turns FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c AS d WHERE d.s[1] = c.s[1] AND d.turns > c.turns AND d.s[1:c.turns] = c.s)
  QUALIFY row_number() OVER (PARTITION BY s ORDER BY conv_id NULLS LAST) = 1)
SELECT n.conv_id, ((pos - 1) // 1024)::INTEGER AS part, turns,
  string_agg('<|im_start|>' || replace(coalesce(role, 'unknown'), '<|im_', '<| im_') || chr(10)
    || replace(coalesce(text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
FROM n JOIN kept ON n.conv_id IS NOT DISTINCT FROM kept.conv_id GROUP BY n.conv_id, part, turns
""")
def op8(read):
    return chat.render(read("conversations"))


@register("op9_cover_tree_topk", """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id
    ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id)::INTEGER AS rank,
  c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
QUALIFY rank <= 5
""")
def op9(read):
    return topk.top_k(read("embeddings"))


@register("op10_cross_parsing_language")
def op10(read):
    return langid.identify(read("documents"))


@register("op11_distinct_word_bpe")
def op11(read):
    return wordbpe.round_trip(read("documents"))


def _kmeans_sql(rounds: int = 5) -> str:
    steps = []
    for r in range(rounds + 1):
        # One row per vector: its nearest centroid of this round.
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT v.vec_id, v.e, c.c, list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i]))) AS distance
  FROM v, c{r} AS c QUALIFY row_number() OVER (PARTITION BY v.n ORDER BY distance, c.c) = 1)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c, list(m ORDER BY d) AS e FROM (
    SELECT c, d, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m
    FROM (SELECT c, unnest(range(1, 65)) AS d, unnest(e) AS x FROM a{r}) GROUP BY c, d) GROUP BY c
  UNION ALL SELECT c, e FROM c{r} WHERE c NOT IN (SELECT c FROM a{r}))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, [floor(256 * x::DOUBLE)::HUGEINT FOR x IN embedding] AS e, row_number() OVER () AS n FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, e) - 1 AS c, e FROM v QUALIFY c < 40),
{", ".join(steps)},
s AS (SELECT c, sum(distance) AS cluster_inertia FROM a{rounds} GROUP BY c)
SELECT vec_id, c::INTEGER AS cluster, distance::BIGINT AS distance, cluster_inertia::BIGINT AS cluster_inertia,
  (SELECT sum(cluster_inertia) FROM s)::BIGINT AS inertia,
  sha256(array_to_string([x::VARCHAR FOR x IN f.e], ',')) AS centroid_sha256
FROM a{rounds} JOIN s USING (c) JOIN c{rounds} AS f USING (c)
"""


@register("op12_subvector_kmeans", _kmeans_sql())
def op12(read):
    return subvector.cluster(read("embeddings"))


@register("op13_octopus_manifest", """
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS n, doc_id, lang, n_chars,
    [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text] AS plain,
    [doc_id::VARCHAR, source, lang, (n_chars + 1)::VARCHAR, text] AS other,
    -- crc32 of the decimal id, bit by bit
    xor(4294967295, list_reduce(
      list_concat([4294967295::BIGINT], [ord(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, step: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS crc
  FROM documents),
leaf AS MATERIALIZED (
  SELECT n, doc_id, lang,
    sha256(array_to_string([coalesce(strlen(x) || ':' || x, '-') FOR x IN plain], '')) AS h,
    CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL
      THEN sha256(array_to_string([coalesce(strlen(x) || ':' || x, '-') FOR x IN other], '')) END AS altered
  FROM d),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h, n) - 1 AS pos FROM leaf),
t AS MATERIALIZED (
  SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM leaf GROUP BY lang),
node(tree, level, pos, size, h) AS (
  SELECT tree, 0, p.pos, t.n, p.h FROM placed p JOIN t ON p.lang IS NOT DISTINCT FROM t.lang
  UNION ALL
  SELECT tree, level + 1, pos // 2, (any_value(size) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM node WHERE size > 1 GROUP BY tree, level, pos // 2),
subroot AS MATERIALIZED (SELECT tree, h FROM node WHERE size = 1),
top(level, pos, size, h) AS (
  SELECT 0, tree, (SELECT count(*) FROM subroot), h FROM subroot
  UNION ALL
  SELECT level + 1, pos // 2, (any_value(size) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM top WHERE size > 1 GROUP BY level, pos // 2),
-- Proofs, level by level: the siblings so far and the folded digest.
walk(n, tree, level, pos, size, proof, f) AS (
  SELECT p.n, tree, 0, p.pos, t.n, '', coalesce(p.altered, p.h)
  FROM placed p JOIN t ON p.lang IS NOT DISTINCT FROM t.lang
  UNION ALL
  SELECT w.n, w.tree, w.level + 1, w.pos // 2, (w.size + 1) // 2, w.proof || coalesce(s.h, ''),
    sha256(CASE WHEN w.pos % 2 = 1 THEN s.h || f ELSE f || coalesce(s.h, '') END)
  FROM walk w LEFT JOIN node s ON s.tree = w.tree AND s.level = w.level AND s.pos = xor(w.pos, 1)
  WHERE w.size > 1),
climb(n, level, pos, size, proof, f) AS (
  SELECT n, 0, tree, (SELECT count(*) FROM subroot), proof, f FROM walk WHERE size = 1
  UNION ALL
  SELECT w.n, w.level + 1, w.pos // 2, (w.size + 1) // 2, w.proof || coalesce(s.h, ''),
    sha256(CASE WHEN w.pos % 2 = 1 THEN s.h || f ELSE f || coalesce(s.h, '') END)
  FROM climb w LEFT JOIN top s ON s.level = w.level AND s.pos = xor(w.pos, 1)
  WHERE w.size > 1),
root AS (SELECT h FROM top WHERE size = 1)
SELECT p.doc_id, p.h AS leaf, subroot.h AS subroot, root.h AS root, sha256(c.proof) AS proof_sha256,
  c.f AS folded_root, c.f = root.h AS verified
FROM placed p JOIN t ON p.lang IS NOT DISTINCT FROM t.lang JOIN subroot USING (tree)
  JOIN climb c ON c.n = p.n AND c.size = 1, root
""")
def op13(read):
    return manifest.audit(read("documents"))
