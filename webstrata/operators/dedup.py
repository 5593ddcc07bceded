"""De-duplication layers: URL, canonical link, content hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions import html as H
from webstrata.functions import urls as U
from webstrata.operators import ranking
from webstrata.session import cut_lineage


def dedup_url(pages: DataFrame, order: list[str], url: str = "url") -> DataFrame:
    """First page per normalised URL."""
    keyed = pages.withColumn("url_key", U.normalize_url(F.col(url)))
    return ranking.first_per_key(keyed, ["url_key"], order)


def content_hash(text: Column) -> Column:
    """SHA-256 of the text; NULL when blank, so blank texts never match."""
    return F.when(H.strip_space(text) != "", F.sha2(text, 256))


def mark_content_duplicates(pages: DataFrame, order: str, text: str) -> DataFrame:
    """Adds ``content_hash`` and ``is_duplicate``; ``order`` is a unique number.

    The first row of each hash is found with a map-side-combined aggregate over
    two narrow columns, and rows are matched to it by their unique order value:
    a group of copies holding a third of the table is never gathered.
    """
    hashed = pages.withColumn("content_hash", content_hash(F.col(text)))
    firsts = (
        hashed.where("content_hash IS NOT NULL").groupBy("content_hash")
        .agg(F.min(order).alias(order)).select(order, F.lit(True).alias("__first"))
    )
    return hashed.join(firsts, order, "left").withColumn(
        "is_duplicate", F.col("content_hash").isNotNull() & F.col("__first").isNull()
    ).drop("__first")


def dedup_content(pages: DataFrame, order: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(kept pages, error rows of the dropped ones)."""
    marked = mark_content_duplicates(pages, order, text)
    dropped = marked.where("is_duplicate").select(
        order, "url", F.lit("Duplicate content (identical markdown hash)").alias("error"),
        F.lit("duplicate_content").alias("error_type"),
        F.lit("DUPLICATE_CONTENT").alias("error_code"),
    )
    return marked.where("NOT is_duplicate").drop("is_duplicate"), dropped


def canonical_target(html: Column, url: Column) -> Column:
    """Resolved canonical URL on the same host, other than the page; else NULL."""
    href = H.canonical_href(html, either_order=True)
    resolved = U.resolve_url(href, url)
    other = F.rtrim(resolved, F.lit("/")) != F.rtrim(url, F.lit("/"))
    return F.when(other & (U.hostname(resolved) == U.hostname(url)), resolved)


def canonical_verdicts(
    pages: DataFrame, order: str, url: str = "url", html: str = "html", alias_rule: bool = False
) -> DataFrame:
    """(order, canonical_url, canonical_duplicate) of every page, without its text.

    A page is dropped when an earlier kept page is its canonical target. That
    makes a chain "dropped iff my target is kept", which is decided by pointer
    doubling: the number of rounds is the logarithm of the longest chain. With
    ``alias_rule`` a page is also dropped when an earlier kept page names the
    same target, so only the first page naming a target can be kept. Each page
    is parsed once, into one narrow written row.
    """
    nodes = cut_lineage(pages.select(
        F.col(order).alias("pos"), F.rtrim(F.col(url), F.lit("/")).alias("node"),
        canonical_target(F.col(html), F.col(url)).alias("target_url"),
    )).withColumn("target", F.rtrim("target_url", F.lit("/")))
    owners = nodes.groupBy("node").agg(F.min("pos").alias("owner"))
    linked = (
        nodes.where("target IS NOT NULL")
        .join(owners.withColumnRenamed("node", "target"), "target", "left")
        .withColumn("next", F.when(F.col("owner") < F.col("pos"), F.col("owner")))
    )
    if alias_rule:
        claims = linked.groupBy("target").agg(F.min("pos").alias("claim"))
        linked = linked.join(claims, "target").withColumn("late", F.col("claim") < F.col("pos"))
    else:
        linked = linked.withColumn("late", F.lit(False))
    # value: dropped flag once known; parity: flips between here and ``next``.
    links = linked.select(
        "pos", F.when(~F.col("late"), F.col("next")).alias("next"), F.col("late").alias("dropped")
    ).where("next IS NOT NULL OR dropped").withColumn("flips", F.when(F.col("next").isNull(), 0).otherwise(1))
    state = cut_lineage(links)
    while True:
        ahead = state.select(
            F.col("pos").alias("next"), F.col("next").alias("n2"),
            F.col("dropped").alias("d2"), F.col("flips").alias("f2"),
        )
        step = state.join(ahead, "next", "left").select(
            "pos", F.col("n2").alias("next"),
            # Without a row ahead the chain ends at a kept page.
            F.when(F.col("next").isNull(), F.col("dropped"))
            .otherwise(F.coalesce("d2", F.lit(False))).alias("dropped"),
            F.when(F.col("next").isNull(), F.col("flips"))
            .otherwise(F.col("flips") + F.coalesce("f2", F.lit(0))).alias("flips"),
        )
        state = cut_lineage(step)
        if state.where("next IS NOT NULL").isEmpty():
            break
    verdict = state.select("pos", (F.col("dropped") != (F.col("flips") % 2 == 1)).alias("dropped"))
    return nodes.join(verdict, "pos", "left").select(
        F.col("pos").alias(order), F.col("target_url").alias("canonical_url"),
        F.coalesce("dropped", F.lit(False)).alias("canonical_duplicate"),
    )


def mark_canonical_duplicates(pages: DataFrame, order: str, **options) -> DataFrame:
    """The pages with ``canonical_url`` (target) and ``canonical_duplicate``."""
    return pages.join(canonical_verdicts(pages, order, **options), order)


def dedup_canonical(pages: DataFrame, order: str, **options) -> tuple[DataFrame, DataFrame]:
    """(kept pages, error rows of the dropped ones); only dropped ids meet the pages."""
    gone = cut_lineage(canonical_verdicts(pages, order, **options).where("canonical_duplicate"))
    dropped = pages.select(order, options.get("url", "url")).join(gone, order).select(
        order, F.col(options.get("url", "url")).alias("url"),
        F.concat(F.lit("Duplicate canonical URL: "), F.col("canonical_url")).alias("error"),
        F.lit("duplicate_canonical").alias("error_type"),
        F.lit("DUPLICATE_CANONICAL").alias("error_code"), "canonical_url",
    )
    return pages.join(gone.select(order), order, "left_anti"), dropped


def dedup_all(pages: DataFrame, order: str, text: str, **options) -> tuple[DataFrame, DataFrame]:
    """Canonical layer first, then content, both error tables united."""
    kept, canonical = dedup_canonical(pages, order, **options)
    kept, content = dedup_content(kept, order, text)
    return kept, canonical.unionByName(content, allowMissingColumns=True)
