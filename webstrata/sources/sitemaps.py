"""Sitemap, feed, robots and file sources; llms.txt sink; paged reads."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from webstrata.functions import html as H
from webstrata.functions import urls as U
from webstrata.operators import ordered, ranking
from webstrata.session import checkpoint_root, cut_lineage, remove_at_end

# Where sitemaps are looked for without a robots.txt line.
COMMON_SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml"]
MAX_SITEMAP_DEPTH = 3


def strip_namespaces(xml: Column) -> Column:
    """Element names without prefix, so one schema reads every dialect."""
    return F.regexp_replace(xml, r"<(/?)[A-Za-z_][A-Za-z0-9_.\-]*:", "<$1")


def _locations(xml: Column, item: str) -> Column:
    parsed = F.from_xml(strip_namespaces(xml), f"{item} array<struct<loc:string>>")
    return F.filter(
        F.transform(parsed[item], lambda e: H.strip_space(e["loc"])), lambda u: u.isNotNull() & (u != "")
    )


def is_root(xml: Column, name: str) -> Column:
    """True when the first element is ``name`` (any prefix)."""
    return F.regexp_extract(xml, r"(?s)<([A-Za-z_][A-Za-z0-9_:.\-]*)", 1).rlike(rf"^(?:.*:)?{name}$")


def parse_sitemaps(sitemaps: DataFrame, url: str = "sitemap_url", xml: str = "xml") -> DataFrame:
    """(sitemap_url, pos, url) of every ``urlset``: http(s) only, fragment cut.

    Malformed XML and text sitemaps give no rows.
    """
    locs = F.filter(_locations(F.col(xml), "url"), lambda u: u.rlike("^https?://"))
    rows = sitemaps.where(is_root(F.col(xml), "urlset")).select(
        url, F.posexplode(locs).alias("pos", "loc")
    )
    return rows.select(url, "pos", U.strip_fragment(F.col("loc")).alias("url"))


def sitemap_children(sitemaps: DataFrame, url: str = "sitemap_url", xml: str = "xml") -> DataFrame:
    return sitemaps.where(is_root(F.col(xml), "sitemapindex")).select(
        F.col(url).alias("parent"),
        F.posexplode(_locations(F.col(xml), "sitemap")).alias("pos", "child"),
    )


def expand_sitemap_index(
    roots: DataFrame, sitemaps: DataFrame, max_depth: int = MAX_SITEMAP_DEPTH, limit: int | None = None
) -> DataFrame:
    """Page URLs below root sitemaps (root_url, pos), each sitemap and URL once.

    Walks the index level by level; ``path`` keeps the position of every step,
    so ordering by it gives the depth-first order in which the files are read.
    """
    children = sitemap_children(sitemaps).select("parent", F.col("pos").alias("child_pos"), "child")
    level = cut_lineage(roots.select(
        F.col("root_url").alias("sitemap_url"), F.array(F.col("pos").cast("long")).alias("path")
    ))
    reached = level
    for _ in range(max_depth):
        nxt = level.join(children, level["sitemap_url"] == children["parent"]).select(
            F.col("child").alias("sitemap_url"),
            F.concat("path", F.array(F.col("child_pos").cast("long"))).alias("path"),
        )
        nxt = nxt.groupBy("sitemap_url").agg(F.min("path").alias("path"))
        level = cut_lineage(nxt.join(reached, "sitemap_url", "left_anti").select("sitemap_url", "path"))
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    once = reached.groupBy("sitemap_url").agg(F.min("path").alias("path"))
    urls = (
        parse_sitemaps(sitemaps).join(once, "sitemap_url")
        .groupBy("url").agg(F.min(F.concat("path", F.array(F.col("pos").cast("long")))).alias("path"))
    )
    return urls.orderBy("path").limit(limit) if limit else urls


def discover_sitemaps(robots: DataFrame, domain: str = "domain", text: str = "text") -> DataFrame:
    """(domain, pos, sitemap_url) from robots.txt, else the common paths."""
    listed = F.transform(
        F.filter(F.split(F.col(text), r"\r?\n|\r"), lambda s: F.lower(s).startswith("sitemap:")),
        lambda s: H.strip_space(F.substr(s, F.lit(9))),
    )
    common = F.array(*[F.concat(F.lit("https://"), F.col(domain), F.lit(p)) for p in COMMON_SITEMAP_PATHS])
    found = F.when(F.size(listed) > 0, listed).otherwise(common)
    return robots.select(domain, F.posexplode(found).alias("pos", "sitemap_url"))


FEED_SCHEMA = (
    "channel struct<item:array<struct<title:string,link:string,description:string,"
    "creator:string,pubDate:string,encoded:string>>>"
)


def parse_feeds(feeds: DataFrame, keys: list[str], xml: str = "feed_xml") -> DataFrame:
    """RSS items (title, link, description, creator, pub_date, content) with a link."""
    items = F.from_xml(strip_namespaces(F.col(xml)), FEED_SCHEMA)["channel"]["item"]
    rows = feeds.select(*keys, F.posexplode(items).alias("pos", "item"))
    return rows.where("item.link IS NOT NULL AND item.link <> ''").select(
        *keys, "pos", F.coalesce("item.title", F.lit("")).alias("title"), "item.link",
        "item.description", "item.creator", F.col("item.pubDate").alias("pub_date"),
        F.col("item.encoded").alias("content"),
    )


def find_feed_items(items: DataFrame, targets: DataFrame, url: str = "url") -> DataFrame:
    """Item of each wanted URL: same link, else same last path part."""
    def slug(u: Column) -> Column:
        return F.regexp_extract(F.regexp_replace(F.regexp_replace(u, r"\?.*$", ""), r"/+$", ""), r"([^/]*)$", 1)

    wanted = targets.select(url, F.regexp_replace(F.col(url), r"/+$", "").alias("target"), slug(F.col(url)).alias("slug"))
    # One item per link and one per last path part, so no target meets many.
    by_link = ranking.first_per_key(
        items.withColumn("target", F.regexp_replace("link", r"/+$", "")), ["target"], ["pos", "link"]
    )
    exact = wanted.join(by_link, "target").withColumn("match", F.lit(0)).drop("target", "slug")
    # Second try only for targets without an exact hit.
    rest = wanted.join(exact.select(url).distinct(), url, "left_anti")
    last_part = ranking.first_per_key(items.withColumn("slug", slug(F.col("link"))), ["slug"], ["pos", "link"])
    by_slug = rest.join(last_part, "slug").withColumn("match", F.lit(1)).drop("target", "slug")
    return ranking.first_per_key(exact.unionByName(by_slug), [url], ["match", "pos", "link"]).drop("match")


# Quoted fields may hold line ends and doubled quotes.
CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def read_csv_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV rows with a header; pass a schema to avoid the extra inference pass."""
    reader = spark.read.options(**CSV_OPTIONS)
    return (reader.schema(schema) if schema else reader).csv(path)


def csv_row_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows per CSV file."""
    return (
        spark.read.options(**CSV_OPTIONS).csv(path)
        .groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("rows"))
    )


def llms_txt_lines(pages: DataFrame, site: str, order: str, site_url: str, stamp: str, maker: str) -> DataFrame:
    """(site, line_no, line): header, one entry per page, footer.

    The file is kept as ordered lines rather than one string per site, so a
    site of any size is written by many tasks.
    """
    entry = F.concat(
        F.lit("- ["), F.col("title"), F.lit("]("), F.col("url"), F.lit(")"),
        F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(": "), F.col("description"))).otherwise(""),
    )
    body = pages.select(site, F.lit(1).alias("part"), F.col(order).cast("long").alias("n"), entry.alias("line"))
    sites = pages.groupBy(site).agg(F.min(site_url).alias("home"))
    head = F.array(
        F.concat(F.lit("# "), F.col(site)), F.lit(""),
        F.concat(
            F.lit(f"> Auto-generated by {maker}. This file helps AI agents discover and prioritize content on "),
            F.col("home"), F.lit("."),
        ), F.lit(""),
    )
    foot = F.array(
        F.lit(""), F.lit("---"),
        F.lit(f"> This llms.txt was auto-generated by {maker} on {stamp}."),
    )
    frame = [
        sites.select(site, F.lit(part).alias("part"), F.posexplode(lines).alias("n", "line"))
        .withColumn("n", F.col("n").cast("long"))
        for part, lines in ((0, head), (2, foot))
    ]
    return frame[0].unionByName(body).unionByName(frame[1])


def write_llms_txt(lines: DataFrame, site: str, path: str) -> None:
    """One folder per site; files in it read in name order give the text."""
    (
        lines.repartitionByRange(site, "part", "n").sortWithinPartitions(site, "part", "n")
        .select(site, "line").write.mode("overwrite").partitionBy(site).text(path)
    )


PAGE_CHUNK = max(1, (10 * 1024 * 1024) // (10 * 1024))


@dataclass(frozen=True)
class Paged:
    """A table in order, one sorted folder per slice; ``slices`` has the rows of each."""

    spark: SparkSession
    path: str
    schema: StructType
    slices: tuple[tuple[int, int], ...]

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.slices)

    def page(self, offset: int, chunk: int = PAGE_CHUNK) -> DataFrame:
        """Rows ``offset`` .. ``offset + chunk`` in order, with ``next_offset`` (NULL on the last page).

        Only the slices that hold the page are opened, and nothing is written.
        """
        needed, ahead = [], 0
        for number, rows in self.slices:
            if ahead < offset + chunk and offset < ahead + rows:
                needed.append((number, ahead))
            ahead += rows
        following = offset + chunk if offset + chunk < ahead else None
        out = None
        for number, before in needed:
            part = self.spark.read.schema(self.schema).parquet(f"{self.path}/__folder={number}")
            part = part.where(F.col(LINE).between(offset - before, offset + chunk - before - 1))
            out = part if out is None else out.unionByName(part)
        if out is None:
            out = self.spark.createDataFrame([], self.schema)
        return out.drop(LINE).withColumn("next_offset", F.lit(following).cast("long"))


LINE = "__line"


def store_pages(df: DataFrame, order: list[str], slices: int | None = None) -> Paged:
    """``df`` range-partitioned and sorted by ``order`` once, to be read page by page.

    Rows that agree in ``order`` keep one place from page to page. The driver
    holds one number per slice. The table goes when the driver ends.
    """
    spark = df.sparkSession
    columns = [*order, ordered.ROW]
    marked = df.withColumn(ordered.ROW, F.monotonically_increasing_id())
    dealt = marked.repartitionByRange(slices, *columns) if slices else marked.repartitionByRange(*columns)
    # The place in a slice is the low part of the running id behind the sort.
    lined = dealt.sortWithinPartitions(*columns).withColumn(LINE, F.monotonically_increasing_id())
    low = F.col(LINE).bitwiseAND(F.lit((1 << 33) - 1))
    numbered = lined.withColumn(ordered.SLICE, F.shiftright(LINE, 33).cast("int")).withColumn(LINE, low).drop(ordered.ROW)
    path = f"{checkpoint_root(spark).rstrip('/')}/webstrata-pages-{uuid.uuid4().hex}"
    numbered.withColumn("__folder", F.col(ordered.SLICE)).write.partitionBy("__folder").parquet(path)
    remove_at_end(spark, path)
    whole = spark.read.schema(numbered.schema).parquet(path)
    counts = sorted((r[ordered.SLICE], r["count"]) for r in whole.groupBy(ordered.SLICE).count().collect())
    return Paged(spark, path, numbered.drop(ordered.SLICE).schema, tuple(counts))


def paginate(df: DataFrame, order: list[str], offset: int, chunk: int = PAGE_CHUNK) -> DataFrame:
    """One page of rows in order; ``store_pages`` serves more than one page of a table."""
    return store_pages(df, order).page(offset, chunk)
