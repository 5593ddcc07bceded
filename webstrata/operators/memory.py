"""Research memory, context assembly, citations, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions import html as H
from webstrata.functions import urls as U
from webstrata.operators import ordered, ranking, search

THRESHOLD = 0.85
CANDIDATES = 5


# ------------------------------------------------------------------ memory

def freshness(age_seconds: Column, ttl_seconds: Column | int) -> Column:
    ttl = ttl_seconds if isinstance(ttl_seconds, Column) else F.lit(ttl_seconds)
    return F.when(age_seconds < ttl / 4, "fresh").when(age_seconds < ttl / 2, "aging").otherwise("stale")


def memory_query(
    queries: DataFrame, memory: DataFrame, now_ms: int, ttl_seconds: int,
    threshold: float = THRESHOLD, per_user: bool = False,
) -> DataFrame:
    """Best live artifact per query: (query_id, hit, memory_id, similarity, freshness).

    ``queries``: query_id, query_vector (and user_id); ``memory``: id,
    embedding, created_ms, expires_ms (and user_id). With ``per_user`` the user
    filter comes before the ranking. The five nearest vectors
    are walked in order; one below the threshold ends the walk, an expired one
    is skipped.
    """
    near = search.vector_search(
        memory, queries, CANDIDATES, decimals=search.RANK_DECIMALS, group="user_id" if per_user else None, least=threshold
    )
    live = near.where(F.col("similarity") >= threshold).join(
        memory.where(F.col("expires_ms") > now_ms).select("id", "created_ms"), "id"
    )
    best = live.groupBy("query_id").agg(
        F.min_by(F.struct("id", "similarity", "created_ms"), "rank").alias("best")
    )
    age = (F.lit(now_ms) - F.col("best.created_ms")) / 1000
    return queries.select("query_id").join(best, "query_id", "left").select(
        "query_id", F.col("best").isNotNull().alias("hit"), F.col("best.id").alias("memory_id"),
        F.round("best.similarity", 6).alias("similarity"),
        F.when(F.col("best").isNotNull(), freshness(age, ttl_seconds)).alias("freshness"),
    )


def memory_admit(batch: DataFrame) -> DataFrame:
    """Artifacts worth storing: text, not an error, at least one source."""
    return batch.where(
        (F.coalesce("artifact", F.lit("")) != "") & ~F.col("artifact").startswith("Error:")
        & (F.coalesce(F.size("sources"), F.lit(0)) > 0)
    )


def memory_store(memory: DataFrame, batch: DataFrame, now_ms: int, ttl_seconds: int) -> DataFrame:
    """Memory with the admitted rows of a batch appended; ids come with the batch."""
    fresh = memory_admit(batch).withColumns({
        "created_ms": F.lit(now_ms).cast("long"),
        "expires_ms": F.lit(now_ms + ttl_seconds * 1000).cast("long"),
    })
    return memory.unionByName(fresh, allowMissingColumns=True)


def memory_sweep(vectors: DataFrame, artifacts: DataFrame, now_ms: int) -> DataFrame:
    """Vectors whose artifact is gone or expired."""
    return vectors.join(artifacts.where(F.col("expires_ms") > now_ms).select("id"), "id", "left_anti")


def memory_delete(memory: DataFrame, ids: DataFrame) -> DataFrame:
    return memory.join(ids, "id", "left_anti")


def memory_get(memory: DataFrame, ids: DataFrame, now_ms: int) -> DataFrame:
    return memory.where(F.col("expires_ms") > now_ms).join(ids, "id", "left_semi")


def memory_reuse(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Reuse a fresh or aging hit unless the query forces a new run."""
    good = F.coalesce(F.col("hit") & F.col("freshness").isin("fresh", "aging"), F.lit(False))
    return queries.join(hits, "query_id", "left").withColumn(
        "decision", F.when(good & ~F.col("force_fresh"), "reuse").otherwise("run")
    )


def derive_user(api_key: Column, authorization: Column, forwarded: Column, peer: Column) -> Column:
    """Scope key: hash of the API key, else the first forwarded address, else the peer."""
    bearer = H.strip_space(F.regexp_replace(F.coalesce(authorization, F.lit("")), "^Bearer ", ""))
    key = F.coalesce(F.nullif(api_key, F.lit("")), bearer)
    hop = H.strip_space(F.split(F.coalesce(forwarded, F.lit("")), ",")[0])
    return F.when(key != "", F.substring(F.sha2(key, 256), 1, 16)).when(hop != "", hop).otherwise(peer)


# ------------------------------------------------------------------ context

SEPARATOR = "\n\n---\n\n"


def source_document(url: Column, markdown: Column, max_chars: int = 8000) -> Column:
    return F.concat(
        F.lit("Source: "), url, F.lit(" (domain: "), U.extract_domain(url), F.lit(")\n\n"),
        F.substring(markdown, 1, max_chars),
    )


def build_context(docs: DataFrame, max_sources: int) -> DataFrame:
    """(query_id, context, sources): numbered source blocks in order.

    ``docs``: query_id, pos, url, title, markdown. The caller's source limit
    bounds the rows per query before any text is gathered.
    """
    top = ranking.top_k(docs, ["query_id"], ["pos"], max_sources)
    block = F.concat(
        F.lit("["), F.col("rank"), F.lit("] Source: "), F.col("url"), F.lit("\nTitle: "),
        F.coalesce("title", F.lit("")), F.lit("\n\n"), source_document(F.col("url"), F.col("markdown")),
    )
    parts = top.withColumn("block", block).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("parts")
    )
    return parts.select(
        "query_id", F.array_join(F.transform("parts", lambda p: p["block"]), SEPARATOR).alias("context"),
        F.size("parts").alias("sources"),
    )


# ------------------------------------------------------------------ citations

def _split_markers(text: Column, unlinked_only: bool) -> Column:
    """Text cut behind every ``[N]``: each piece ends with at most one marker."""
    marked = F.regexp_replace(text, r"(\[[0-9]+\])", "$1\u0001")
    if unlinked_only:
        marked = F.replace(marked, F.lit("\u0001("), F.lit("("))
    return F.split(marked, "\u0001")


MARKER_END = r"\[([0-9]+)\]$"


def citation_pieces(answers: DataFrame, sources: DataFrame, unlinked_only: bool) -> DataFrame:
    """(answer_id, pos, piece, idx, url, title): text pieces joined to their source."""
    pieces = answers.select(
        "answer_id", F.posexplode(_split_markers(F.col("text"), unlinked_only)).alias("pos", "piece")
    ).withColumn("idx", F.regexp_extract("piece", MARKER_END, 1).try_cast("int"))
    return pieces.join(sources.select("answer_id", "idx", "url", "title"), ["answer_id", "idx"], "left")


def cite_inline(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct cited sources in order of first appearance: (answer_id, idx, url, first_pos)."""
    return citation_pieces(answers, sources, False).where("url IS NOT NULL").groupBy(
        "answer_id", "idx"
    ).agg(F.min("pos").alias("first_pos"), F.first("url").alias("url"))


def _linked(df: DataFrame, replace: Column) -> DataFrame:
    link = F.concat(F.lit("["), F.col("idx"), F.lit("]("), F.col("url"), F.lit(")"))
    piece = F.when(
        replace, F.concat(F.regexp_replace("piece", r"\[[0-9]+\]$", ""), link)
    ).otherwise(F.col("piece"))
    return df.withColumn("piece", piece)


def _reassemble(df: DataFrame) -> DataFrame:
    """Pieces of one answer back into its text (an answer is one row of input)."""
    return df.groupBy("answer_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("parts")
    ).select(
        "answer_id", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("resolved_text")
    )


def cite_compact(answers: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts with every open marker linked, citations sorted by number)."""
    pieces = citation_pieces(answers, sources, True)
    known = F.col("url").isNotNull()
    cited = pieces.where(known).groupBy("answer_id", "idx").agg(F.first("url").alias("url"))
    return _reassemble(_linked(pieces, known)), cited


def resolve_citations(answers: DataFrame, sources: DataFrame, style: str = "compact") -> tuple[DataFrame, DataFrame]:
    """(texts, citations with marker and resolved text); compact links the first marker only."""
    compact = style == "compact"
    pieces = citation_pieces(answers, sources, compact)
    known = pieces.where("url IS NOT NULL")
    first = known.groupBy("answer_id", "idx").agg(
        F.min("pos").alias("pos"), F.first("url").alias("url"), F.first("title").alias("title")
    )
    marker = F.concat(F.lit("["), F.col("idx"), F.lit("]"))
    resolved = F.concat(marker, F.lit("("), F.col("url"), F.lit(")")) if compact else marker
    cited = first.select(
        "answer_id", "idx", "url", "title", marker.alias("marker_text"),
        resolved.alias("resolved_text"), F.col("pos").alias("first_pos"),
    )
    if not compact:
        return answers.select("answer_id", F.col("text").alias("resolved_text")), cited
    flagged = pieces.join(
        first.select("answer_id", "pos", F.lit(True).alias("is_first")), ["answer_id", "pos"], "left"
    )
    return _reassemble(_linked(flagged, F.coalesce("is_first", F.lit(False)))), cited


# ------------------------------------------------------------------ enrichment

def enrichment_inputs(
    items: DataFrame, values: list[str], results: DataFrame, pages: DataFrame, hint: str = "",
    max_chars: int = 8000,
) -> DataFrame:
    """Search text of each item, its top result and the start of that page."""
    query = F.concat_ws(" ", *[F.col(v).cast("string") for v in values], F.nullif(F.lit(hint), F.lit("")))
    top = results.groupBy("item_id").agg(F.min_by("url", "pos").alias("url"))
    page = pages.select("url", F.substring("markdown", 1, max_chars).alias("content"))
    return items.select("item_id", query.alias("query")).join(top, "item_id", "left").join(page, "url", "left")


def attach_contents(results: DataFrame, pages: DataFrame) -> DataFrame:
    """Page text joined to hits; a hit without a usable page stays as it is."""
    usable = pages.where("success AND markdown <> ''").select("url", "markdown")
    return results.join(usable, "url", "left")


def merge_sources(sources: DataFrame, keys: list[str], order: str, fields: list[str]) -> DataFrame:
    """One row per source URL: later non-null fields override, first position kept."""
    return sources.groupBy(*keys, "url").agg(
        F.min(order).alias(order),
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields],
    )


# ------------------------------------------------------------------ sessions

def session_transcript(steps: DataFrame, session: str, order: str, content: str) -> DataFrame:
    """Steps with their 1-based index and the offset of their section in the artifact.

    The artifact of a session is its sections in this order; it stays as rows,
    so a session of any length is spread over tasks.
    """
    sliced = ordered.with_slices(steps, [session], [order])
    numbered = ordered.running_sum(sliced, [session], [order], F.lit(1), "step_index")
    ends = ordered.running_sum(numbered, [session], [order], F.length(content), "__end")
    return ordered.unsliced(ends).withColumn("offset", F.col("__end") - F.length(content)).drop("__end")


def session_export(steps: DataFrame, refs: DataFrame, session: str, content: str) -> DataFrame:
    """(session, steps, artifact_length, refs, ref_chars) per session."""
    by_step = steps.groupBy(session).agg(
        F.count("*").alias("steps"), F.sum(F.length(content)).alias("artifact_length")
    )
    by_ref = refs.groupBy(session).agg(
        F.count("*").alias("refs"), F.sum("char_count").alias("ref_chars")
    )
    return by_step.join(by_ref, session, "left")


def build_refs(results: DataFrame, session: str, step: str, pos: str, listed: int = 10) -> DataFrame:
    """References ``ref_<step>_<n>``: rows without a URL are numbered but not kept."""
    numbered = ordered.rank_in_key(results, [session, step], [pos], "n")
    kept = numbered.where(F.coalesce("url", F.lit("")) != "").withColumn(
        "ref_id", F.concat(F.lit("ref_"), F.col(step), F.lit("_"), F.col("n"))
    )
    place = ordered.rank_in_key(kept, [session, step], ["n"], "__place")
    label = F.coalesce(F.nullif("title", F.lit("")), F.col("url"))
    line = F.concat(F.lit("- ["), label, F.lit("]("), F.col("url"), F.lit(") `"), F.col("ref_id"), F.lit("`"))
    return place.withColumn("listed_line", F.when(F.col("__place") <= listed, line)).drop("__place", "n")


def resolve_refs(ids: DataFrame, refs: DataFrame, keys: list[str]) -> DataFrame:
    """Stored references of the wanted ids; missing ones are left out."""
    return refs.join(ids.select(*keys).distinct(), keys, "left_semi")
