"""Crawl operators over a stored page corpus: expansion, traversal, reports."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions import html as H
from webstrata.functions import urls as U
from webstrata.operators import ordered, ranking
from webstrata.session import bucketed, cut_lineage


@dataclass(frozen=True)
class CrawlOptions:
    max_depth: int = 3
    max_pages: int = 10_000
    allow_subdomains: bool = False
    allow_external: bool = False
    entire_domain: bool = True
    ignore_query: bool = False
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    regex_on_full_url: bool = False
    sitemap_mode: str = "include"


def expand_links(pages: DataFrame, base_host: str, options: CrawlOptions = CrawlOptions()) -> DataFrame:
    """(src, dst, dst_url, class_rank, pos) of the links a crawl would follow.

    One narrow stage per page: extract, keep the crawl's scope, drop private
    hosts among external links, keep child paths unless the whole domain is on.
    Internal links come first, then subdomains, then external ones.
    """
    dst, src, host = F.col("dst_url"), F.col("url"), F.col("dst_host")
    found = pages.select(
        "url", F.posexplode(H.page_links(F.col("html"), F.col("url"))).alias("pos", "dst_url")
    )
    # Host and keys once per link; the filters below only compare them.
    parts = U.compute_once(
        found, dst_host=U.hostname(dst), src_host=U.hostname(src),
        src=U.normalize_url(src, options.ignore_query), dst=U.normalize_url(dst, options.ignore_query),
    )
    wanted = U.scope_classes(options.allow_subdomains, options.allow_external)
    scoped = parts.where(U.host_class(host, F.lit(base_host.lower())).isin(wanted)).withColumn(
        "link_class", U.host_class(host, F.col("src_host"))
    )
    safe = scoped
    if options.allow_external:
        safe = safe.where((F.col("link_class") != "external") | ~U.is_private_name(host))
    if not options.entire_domain:
        safe = safe.where(U.is_child_path(dst, src))
    rank = F.when(F.col("link_class") == "internal", 0).when(F.col("link_class") == "subdomain", 1).otherwise(2)
    return safe.select("src", "dst", "dst_url", "link_class", rank.alias("class_rank"), "pos")


def passes_filters(url: Column, options: CrawlOptions) -> Column:
    target = F.regexp_replace(url, r"\?[^#]*", "") if options.ignore_query else url
    return U.match_path(target, options.include, options.exclude, options.regex_on_full_url)


#: Hexadecimal digits of a position in the queue key.
DIGITS = 12


def _digits(value: Column) -> Column:
    return F.lpad(F.hex(value.cast("long")), DIGITS, "0")


def traverse(
    start: DataFrame, edges: DataFrame, options: CrawlOptions, nodes: DataFrame | None = None
) -> DataFrame:
    """Breadth-first levels: (node, depth), each node at its smallest depth.

    ``start`` has ``node`` and may have ``ord``, its place in the queue;
    ``edges`` has (src, dst) and may have (class_rank, pos), the order in which
    a page queues its links; ``nodes`` limits the walk to stored pages. At most
    ``max_pages`` nodes are reached, the first in queue order; 0 is no limit.

    The edges are stored once, bucketed by their source, and read in place at
    every level. A node's place in the queue is a text key, its parent's key
    and its place on that page, so no level is sorted or numbered; only the level
    that exceeds ``max_pages`` is cut, by counting. Every level is one join of the
    frontier with the edges, combined to distinct targets before the shuffle, one
    anti join with the nodes already reached, and one write, which keeps plans
    short and lets a lost executor be replaced without walking again.
    """
    def stored(df: DataFrame) -> DataFrame:
        return df if nodes is None else df.join(nodes, "node", "left_semi")

    def level(df: DataFrame, room: int | None) -> tuple[DataFrame, int]:
        """Nodes of a level with their key in the queue, cut to ``room``."""
        found = cut_lineage(df)
        size = found.count()
        if room is not None and size > room:
            return cut_lineage(found.where(ordered.kth_smallest_cut(found, "key", "node", room))), room
        return found, size

    limit = options.max_pages if options.max_pages > 0 else None
    # Links of one page that share a place follow each other by address.
    placed = {"class_rank", "pos"} <= set(edges.columns)
    for name in ("class_rank", "pos"):
        if name not in edges.columns:
            edges = edges.withColumn(name, F.lit(0))
    place = F.concat(F.col("class_rank").cast("string"), _digits(F.col("pos")))
    targets = stored(edges.withColumnRenamed("dst", "node"))
    links = bucketed(targets.groupBy("src", "node").agg(F.min(place).alias("place")), "src")
    if "ord" not in start.columns:
        start = start.withColumn("ord", F.lit(0))
    seeds = stored(start.groupBy("node").agg(F.min("ord").alias("first")))
    key = F.concat(_digits(F.col("first") + (1 << 4 * DIGITS - 1)), F.col("node"), F.lit("\x00"))
    frontier, size = level(seeds.select("node", F.lit(0).alias("depth"), key.alias("key")), limit)
    reached, total = frontier.select("node", "depth"), size
    for depth in range(1, options.max_depth + 1):
        if size == 0 or (limit is not None and total >= limit):
            break
        parents = frontier.select(F.col("node").alias("src"), F.col("key").alias("parent"))
        own = F.col("place") if placed else F.concat("place", "node", F.lit("\x00"))
        found = (
            parents.join(links, "src").groupBy("node").agg(F.min(F.concat("parent", own)).alias("key"))
            .join(reached.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "key")
        )
        frontier, size = level(found, None if limit is None else limit - total)
        reached, total = reached.unionByName(frontier.select("node", "depth")), total + size
    return reached


def crawl(
    start_url: str, pages: DataFrame, options: CrawlOptions = CrawlOptions(),
    sitemap_urls: DataFrame | None = None,
) -> DataFrame:
    """(node, depth) of a crawl over stored pages.

    Sitemap modes: ``include`` adds sitemap pages at depth 0, visited in reverse
    order before the start page, ``skip`` ignores them, ``only`` takes them
    without following links. Path filters see addresses as they are written.
    Pages of hosts that the crawl cannot reach are not parsed.
    """
    spark = pages.sparkSession
    start = spark.createDataFrame([(start_url,)], "url string")
    host = start.select(U.hostname(F.col("url")).alias("h")).first()["h"]
    keyed = pages.withColumn("node", U.normalize_url(F.col("url"), options.ignore_query))
    seeds = start.select("url", U.normalize_url(F.col("url"), options.ignore_query).alias("node"), F.lit(1).alias("ord"))
    parsed = keyed
    if sitemap_urls is not None and options.sitemap_mode != "skip":
        extra = seed_frontier(start_url, sitemap_urls, options.max_pages, options.ignore_query)
        seeds = seeds.unionByName(extra.select("url", "node", F.col("queue_pos").alias("ord")))
    elif not options.allow_external:
        wanted = U.scope_classes(options.allow_subdomains, options.allow_external)
        inside = U.host_class(U.hostname(F.col("url")), F.lit(host.lower())).isin(wanted)
        parsed = keyed.where(inside | (F.col("url") == start_url))
    edges = expand_links(parsed, host, options)
    if options.sitemap_mode == "only":
        options = replace(options, max_depth=0)
    if options.include or options.exclude:
        seeds = seeds.where(passes_filters(F.col("url"), options))
        edges = edges.where(passes_filters(F.col("dst_url"), options))
    # Every level asks which targets are stored: keep the keys, not the pages.
    return traverse(seeds, edges, options, cut_lineage(keyed.select("node").distinct()))


def seed_frontier(
    start_url: str, sitemap_urls: DataFrame, max_pages: int, ignore_query: bool = False
) -> DataFrame:
    """Sitemap rows (pos, url) → (node, url, queue_pos), in the order they are visited.

    The cap of ``max_pages - 1`` comes before any filter; rows end up in
    reverse order, ahead of the start URL.
    """
    cap = max_pages - 1
    capped = ordered.rows_between(sitemap_urls, ["pos"], 0, cap) if cap > 0 else sitemap_urls
    keyed = capped.where(~U.is_low_value_url(F.col("url"))).withColumn(
        "node", U.normalize_url(F.col("url"), ignore_query)
    )
    start_key = U.normalize_url(F.lit(start_url), ignore_query)
    firsts = ranking.first_per_key(keyed.where(F.col("node") != start_key), ["node"], ["pos"])
    return firsts.select("node", "url", (-F.col("pos")).alias("queue_pos"))


def map_site(
    pages: DataFrame, keys: list[str], limit: int, search: str | None = None,
    subdomains: bool = False, external: bool = False,
) -> DataFrame:
    """Links of each page in scope: the limit applies before the search."""
    base = U.hostname(F.col("url"))
    links = F.slice(
        F.filter(
            H.page_links(F.col("html"), F.col("url")),
            lambda u: U.in_scope(u, base, subdomains, external),
        ), 1, limit,
    )
    rows = pages.select(*keys, "url", F.posexplode(links).alias("pos", "link"))
    return rows.where(F.lower("link").contains(search.lower())) if search else rows


def discover_pages(pages: DataFrame, keys: list[str], max_pages: int = 50) -> DataFrame:
    """Same-host links resolved from the site root, else the page itself."""
    origin = U.extract_domain(F.col("url"), include_scheme=True)
    links = F.slice(
        F.filter(
            H.page_links(F.col("html"), origin),
            lambda u: U.in_scope(u, U.hostname(F.col("url"))),
        ), 1, max_pages,
    )
    return pages.select(
        *keys, "url",
        F.posexplode(F.when(F.size(links) > 0, links).otherwise(F.array("url"))).alias("pos", "page_url"),
    )


def crawl_summary(events: DataFrame, job: str, kind: str) -> DataFrame:
    """Counts per job from rows of kind page / queued / dedup / error / robots / filtered."""
    def n(*kinds: str) -> Column:
        return F.sum(F.when(F.col(kind).isin(list(kinds)), 1).otherwise(0))

    return events.groupBy(job).agg(
        n("page", "queued", "dedup").alias("total"), n("page").alias("completed"),
        n("error", "dedup").alias("errors"), n("robots").alias("robots_blocked"),
        n("filtered").alias("filtered_out"),
    )


def error_report(errors: DataFrame, job: str) -> DataFrame:
    """Errors per job and type; robots-blocked rows counted again on their own line."""
    blocked = errors.where("error_type = 'robots_blocked'").withColumn("section", F.lit("robots_blocked"))
    rows = errors.withColumn("section", F.lit("errors")).unionByName(blocked)
    return rows.groupBy(job, "section", "error_type").agg(F.count("*").alias("rows"))


def site_summary(rows: DataFrame, host: str, kind: str) -> DataFrame:
    """Rows per host and kind with sub-totals."""
    return rows.rollup(host, kind).agg(F.count("*").alias("rows"))
