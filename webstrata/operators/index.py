"""Vector index maintenance: upsert, access, retention, eviction, migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions import urls as U
from webstrata.operators import ordered, search

# Weight of a retention category.
CATEGORY_WEIGHTS = {
    "news": 0.3, "social": 0.4, "blog": 0.6, "api": 0.7, "unknown": 0.8, "reference": 1.0,
    "docs": 1.2,
}
DECAY_DAYS = 90.0
DAY_MS = 86_400_000


def retention_score(category: Column, last_indexed_ms: Column, access: Column, crawls: Column, now_ms: Column) -> Column:
    """Weight × recency + access boost + crawl boost, four decimals; no date counts 0.5."""
    table = F.create_map(*[F.lit(x) for kv in CATEGORY_WEIGHTS.items() for x in kv])
    weight = F.coalesce(F.try_element_at(table, category), F.lit(0.8))
    days = F.greatest(F.lit(0), F.floor((now_ms - last_indexed_ms) / DAY_MS))
    recency = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.exp(-days / DECAY_DAYS)))
    access_part = F.least(F.coalesce(access, F.lit(0)), F.lit(100)) * 0.01
    crawl_part = F.least(F.coalesce(crawls, F.lit(0)), F.lit(20)) * 0.05
    return F.round(
        weight * F.when(last_indexed_ms.isNull(), 0.5).otherwise(recency) + access_part + crawl_part, 4
    )


def upsert_index(index: DataFrame, batch: DataFrame, now_ms: int, model: str) -> DataFrame:
    """Merge of an index with a batch of (pos, url, title, embedding).

    A URL repeated in the batch counts once, its last row wins (aggregate with
    map-side combine). One full outer join on the URL. First date, access
    numbers and models survive; crawl count goes up by one.
    """
    last = batch.groupBy("url").agg(
        F.max_by(F.struct("title", "embedding"), "pos").alias("new")
    )
    both = index.withColumn("old", F.struct(*[c for c in index.columns if c != "url"])).select(
        "url", "old"
    ).join(last, "url", "full_outer")
    fresh, known = F.col("new").isNotNull(), F.col("old").isNotNull()
    now = F.lit(now_ms).cast("long")
    added = F.map_from_arrays(F.array(F.lit(model)), F.array(F.col("new.embedding")))
    old_vectors = F.coalesce(F.col("old.vectors"), F.map_from_arrays(
        F.array().cast("array<string>"), F.array().cast("array<array<float>>")
    ))
    keep = F.map_filter(old_vectors, lambda k, _v: k != model)
    merged = both.select(
        U.url_id(F.col("url")).alias("id"), "url",
        F.when(fresh, F.col("new.title")).otherwise(F.col("old.title")).alias("title"),
        U.domain_category(F.col("url")).alias("category"),
        F.coalesce("old.first_indexed_ms", now).alias("first_indexed_ms"),
        F.when(fresh, now).otherwise(F.col("old.last_indexed_ms")).alias("last_indexed_ms"),
        (F.coalesce("old.crawl_count", F.lit(0)) + F.when(fresh, 1).otherwise(0)).cast("long").alias("crawl_count"),
        F.coalesce("old.access_count", F.lit(0)).cast("long").alias("access_count"),
        F.when(known, F.col("old.models")).otherwise(F.array(F.lit(model))).alias("models"),
        F.when(fresh, F.map_concat(keep, added)).otherwise(old_vectors).alias("vectors"),
    )
    return merged.withColumn("retention_score", retention_score(
        F.col("category"), F.col("last_indexed_ms"), F.col("access_count"), F.col("crawl_count"), now
    ))


def add_vectors(index: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """Dual write: vectors (url, embedding) of another model next to the old ones."""
    joined = index.join(vectors.withColumnRenamed("embedding", "__e"), "url", "left")
    added = F.map_from_arrays(F.array(F.lit(model)), F.array("__e"))
    has = F.col("__e").isNotNull()
    return (
        joined
        .withColumn("vectors", F.when(has, F.map_concat(
            F.map_filter("vectors", lambda k, _v: k != model), added)).otherwise(F.col("vectors")))
        .withColumn("models", F.when(has, F.array_union("models", F.array(F.lit(model)))).otherwise(F.col("models")))
        .drop("__e")
    )


def eviction_count(rows: int, max_docs: int) -> int:
    return 0 if rows <= max_docs else rows - max_docs + max(100, int(max_docs * 0.02))


def evict(index: DataFrame, max_docs: int, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """(kept, evicted): the lowest scores go, NULL first, ids decide between equal scores.

    ``id_col`` is unique and of any type that sorts, such as the unsigned ids
    of ``upsert_index``. No global sort: see ``kth_smallest_cut``.
    """
    k = eviction_count(index.count(), max_docs)
    gone = ordered.kth_smallest_cut(index, "retention_score", id_col, k)
    return index.where(~gone), index.where(gone)


def track_access(index: DataFrame, hits: DataFrame, now_ms: int) -> DataFrame:
    """Adds the hits (id) of a batch to the access count."""
    counted = hits.groupBy("id").agg(F.count("*").alias("__hits"))
    joined = index.join(counted, "id", "left")
    return joined.withColumns({
        "access_count": F.col("access_count") + F.coalesce("__hits", F.lit(0)),
        "last_accessed_ms": F.when(F.col("__hits").isNotNull(), F.lit(now_ms).cast("long")),
    }).drop("__hits")


def delete_points(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids, "id", "left_anti")


def index_stats(index: DataFrame, max_docs: int) -> DataFrame:
    return index.agg(F.count("*").alias("documents")).withColumn("max_documents", F.lit(max_docs).cast("long"))


def backfill_vectors(index: DataFrame, model: str, old_model: str, encoder=None, dim: int = 256) -> DataFrame:
    """Vectors of a new model for the rows that lack them, from title and URL."""
    missing = ~F.map_contains_key("vectors", model)
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), "url")
    fresh = search.embed(index.where(missing), text, "__e", encoder, dim=dim)
    done = (
        fresh.withColumn("vectors", F.map_concat(
            "vectors", F.map_from_arrays(F.array(F.lit(model)), F.array("__e"))))
        .withColumn("models", F.array_union("models", F.array(F.lit(old_model), F.lit(model)))).drop("__e")
    )
    return index.where(~missing).unionByName(done)


def migration_progress(index: DataFrame, model: str, cutover: bool = False) -> DataFrame:
    """(docs_total, docs_processed, phase)."""
    counts = index.agg(
        F.count("*").alias("docs_total"),
        F.sum(F.map_contains_key("vectors", model).cast("long")).alias("docs_processed"),
    )
    done = F.col("docs_processed")
    phase = (
        F.when(F.lit(cutover), "cutover").when(done == 0, "idle")
        .when(done < F.col("docs_total"), "backfilling").otherwise("dual_write")
    )
    return counts.withColumn("phase", phase)
