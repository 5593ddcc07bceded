"""Row-producing operators over pages: links, images, records, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.functions import html as H
from webstrata.functions import quality as Q
from webstrata.functions import urls as U
from webstrata.operators import ranking


def extract_links(pages: DataFrame, keys: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """(keys, url, dst_url, pos); one narrow stage, duplicates removed per page."""
    links = H.page_links(F.col(html), F.col(url))
    return pages.select(*keys, url, F.posexplode(links).alias("pos", "dst_url"))


def classified_links(pages: DataFrame, keys: list[str], url: str = "url", html: str = "html") -> DataFrame:
    links = extract_links(pages, keys, url, html)
    return links.withColumn("link_class", U.classify_link(F.col("dst_url"), U.hostname(F.col(url))))


def json_ld_items(pages: DataFrame, html: str = "html") -> DataFrame:
    """One ``item`` (variant) per JSON-LD object; graphs and lists unwrapped."""
    blocks = pages.withColumn("block", F.explode(H.json_ld_blocks(F.col(html))))
    parsed = blocks.withColumn("doc", F.try_parse_json("block")).where("doc IS NOT NULL")
    is_list = F.col("block").startswith("[")
    graph = F.expr("try_variant_get(doc, '$[\"@graph\"]', 'array<variant>')")
    listed = F.expr("try_variant_get(doc, '$', 'array<variant>')")
    worth = F.expr(
        "coalesce(try_variant_get(doc, '$[\"@type\"]', 'string'), "
        "try_variant_get(doc, '$.name', 'string'), try_variant_get(doc, '$.url', 'string'), '') <> ''"
    )
    items = F.coalesce(
        F.when(is_list, listed), graph, F.when(worth & ~is_list, F.array(F.col("doc")))
    )
    return (
        parsed.withColumn("item", F.explode(items)).drop("block", "doc")
        .where(F.expr("schema_of_variant(item) LIKE 'OBJECT%'"))
    )


def image_rows(pages: DataFrame, url: str = "url", html: str = "html", drop_data_uris: bool = False) -> DataFrame:
    found = H.images(F.col(html), F.col(url), drop_data_uris)
    return pages.select(
        *[c for c in pages.columns if c != html], F.posexplode(found).alias("pos", "image")
    ).select(
        "*", (F.col("pos") + 1).alias("position"), F.col("image.url").alias("image_url"),
        "image.alt", "image.width", "image.height",
    ).drop("pos", "image")


def chapter_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    body = H.strip_book_boilerplate(F.col(text))
    return docs.select(
        *[c for c in docs.columns if c != text],
        F.posexplode(H.split_chapters(body)).alias("pos", "chapter"),
    ).select("*", (F.col("pos") + 1).alias("chapter_no"), "chapter.title", "chapter.content").drop(
        "pos", "chapter"
    )


# Readable names of employment types.
EMPLOYMENT_TYPES = {
    "direct hire": "Direct Hire", "contract": "Contract", "contract-to-hire": "Contract-to-Hire",
    "full-time": "Full-Time", "part-time": "Part-Time", "temporary": "Temporary",
}


def employment_type(value: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in EMPLOYMENT_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(value))), F.trim(value))


def job_postings(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """One row per JobPosting object found in the JSON-LD of a page."""
    items = json_ld_items(pages, html)

    def get(path: str, kind: str = "string") -> Column:
        return F.expr(f"try_variant_get(item, '{path}', '{kind}')")

    def either(*paths: str) -> Column:
        return F.coalesce(*[get(p) for p in paths], F.lit(""))

    types = F.coalesce(get("$.employmentType", "array<string>"), F.array(get("$.employmentType")))
    industries = F.coalesce(get("$.industry", "array<string>"), F.array(get("$.industry")))
    return items.where(get('$["@type"]') == "JobPosting").select(
        *keys,
        either("$.title").alias("title"),
        either("$.hiringOrganization.name", "$.hiringOrganization").alias("company"),
        F.array_join(F.transform(F.array_compact(types), employment_type), ", ").alias("employment_type"),
        either("$.baseSalary.value.minValue", "$.baseSalary.value").alias("salary_min"),
        either("$.baseSalary.value.maxValue").alias("salary_max"),
        F.substring(either("$.datePosted"), 1, 10).alias("date_posted"),
        F.array_join(F.array_compact(industries), ", ").alias("industry"),
        either("$.jobLocation[0].address.addressLocality", "$.jobLocation.address.addressLocality").alias("location"),
        either("$.jobLocation[0].address.addressRegion", "$.jobLocation.address.addressRegion").alias("region"),
    )


_METRIC = "array<struct<cvssData:struct<baseScore:double,baseSeverity:string,vectorString:string>,exploitabilityScore:double>>"
_CPE = (
    "array<struct<criteria:string,vulnerable:boolean,versionStartIncluding:string,"
    "versionStartExcluding:string,versionEndIncluding:string,versionEndExcluding:string>>"
)
CVE_SCHEMA = (
    "id string, descriptions array<struct<lang:string,value:string>>, "
    f"metrics struct<cvssMetricV31:{_METRIC},cvssMetricV30:{_METRIC},cvssMetricV40:{_METRIC}>, "
    "weaknesses array<struct<description:array<struct<lang:string,value:string>>>>, "
    "references array<struct<url:string,tags:array<string>>>, "
    f"configurations array<struct<cpeMatch:{_CPE},nodes:array<struct<cpeMatch:{_CPE},"
    f"children:array<struct<cpeMatch:{_CPE}>>>>>>"
)


def flatten_cve(records: DataFrame, keys: list[str], json: str = "record") -> DataFrame:
    """One row per affected product of a vulnerability record."""
    r = records.select(*keys, F.from_json(F.col(json), CVE_SCHEMA).alias("r"))
    english = F.filter("r.descriptions", lambda d: d["lang"] == "en")
    v3 = F.coalesce(
        F.try_element_at("r.metrics.cvssMetricV31", F.lit(1)),
        F.try_element_at("r.metrics.cvssMetricV30", F.lit(1)),
    )
    v4 = F.try_element_at("r.metrics.cvssMetricV40", F.lit(1))
    empty = F.lit(None).cast(_CPE)
    none = F.array().cast(_CPE)
    configs = F.coalesce(F.col("r.configurations"), F.array())
    nodes = F.flatten(F.transform(configs, lambda c: F.coalesce(c["nodes"], F.array())))
    children = F.flatten(F.transform(nodes, lambda n: F.coalesce(n["children"], F.array())))
    cpes = F.concat(*[
        F.flatten(F.transform(group, lambda n: F.coalesce(n["cpeMatch"], empty, none)))
        for group in (configs, nodes, children)
    ])
    flat = r.select(
        *keys,
        F.col("r.id").alias("cve_id"),
        F.coalesce(
            F.try_element_at(english, F.lit(1))["value"],
            F.try_element_at("r.descriptions", F.lit(1))["value"], F.lit(""),
        ).alias("description"),
        v3["cvssData"]["baseScore"].alias("cvss_v3"),
        v3["cvssData"]["baseSeverity"].alias("severity"),
        v3["cvssData"]["vectorString"].alias("vector_v3"),
        v3["exploitabilityScore"].alias("exploitability_v3"),
        v4["cvssData"]["baseScore"].alias("cvss_v4"),
        v4["cvssData"]["vectorString"].alias("vector_v4"),
        F.filter(
            F.flatten(F.transform("r.weaknesses", lambda w: F.transform(w["description"], lambda d: d["value"]))),
            lambda v: v.startswith("CWE-"),
        ).alias("weaknesses"),
        F.coalesce(
            F.exists("r.references", lambda x: F.array_contains(x["tags"], "Exploit")), F.lit(False)
        ).alias("exploited"),
        F.transform("r.references", lambda x: x["url"]).alias("references"),
        F.explode_outer(cpes).alias("cpe"),
    )
    start = F.coalesce(
        F.col("cpe.versionStartIncluding"), F.concat(F.lit(">"), F.col("cpe.versionStartExcluding"))
    )
    end = F.coalesce(
        F.col("cpe.versionEndIncluding"), F.concat(F.lit("<"), F.col("cpe.versionEndExcluding"))
    )
    out = flat.select(
        "*", F.col("cpe.criteria").alias("criteria"),
        F.coalesce(F.col("cpe.vulnerable"), F.lit(True)).alias("vulnerable"),
        F.coalesce(F.nullif(F.concat_ws(" - ", start, end), F.lit("")), F.lit("any")).alias("version_range"),
    ).drop("cpe")
    return out


def best_version(versions: DataFrame, keys: list[str], tier: str = "tier", score: str = "score") -> DataFrame:
    """One fetched version per key: the first tier of acceptable quality, else the best effort.

    Tiers are tried in order; a version below the quality threshold is passed on to
    the next tier and kept as a fallback, of which the highest score counts, then
    the earlier tier. Adds ``best_effort`` (no tier was acceptable). A version that
    was not scored is acceptable. One aggregate with map-side combine, whatever a
    key's size.
    """
    ok = Q.quality_acceptable(F.col(score))
    order = F.struct(
        (~ok).alias("poor"), F.when(ok, F.col(tier)).alias("first"), (-F.col(score)).alias("down"), F.col(tier).alias("tier")
    )
    rest = [c for c in versions.columns if c not in keys]
    best = versions.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest], (~ok).alias("best_effort")), order).alias("__best")
    )
    return best.select(*keys, "__best.*")


def cert_listing(certs: DataFrame, domain: str, order: str, n: int = 20) -> DataFrame:
    """First ``n`` certificates per domain with the domain's total.

    The total is an aggregate joined back to at most ``n`` rows per domain, so
    a hot domain never sits whole in one window.
    """
    totals = certs.groupBy(domain).agg(F.count("*").alias("certificate_count"))
    firsts = ranking.top_k(certs, [domain], [order], n)
    return firsts.join(totals, domain).select(
        domain, "rank", "certificate_count", "common_name",
        F.substring(F.coalesce(F.col("issuer_name"), F.lit("")), 1, 40).alias("issuer"),
        F.substring(F.coalesce(F.col("not_before"), F.lit("")), 1, 10).alias("not_before"),
        F.substring(F.coalesce(F.col("not_after"), F.lit("")), 1, 10).alias("not_after"),
    )


def search_health(engine_rows: DataFrame, query: str) -> DataFrame:
    """Engine rows (query, results, urls) → one health row per query."""
    agg = engine_rows.groupBy(query).agg(
        F.count("*").alias("engines_total"),
        F.sum(F.when(F.col("results") > 0, 1).otherwise(0)).alias("engines_responding"),
        F.sum("urls").alias("urls"),
    )
    total, up = F.col("engines_total"), F.col("engines_responding")
    empty = (up > 0) & (F.col("urls") == 0)
    degraded = up < total / 2
    ratio = F.concat(up, F.lit("/"), total, F.lit(" engines returned results"))
    return agg.select(
        query, "engines_total", "engines_responding", empty.alias("empty_result"),
        degraded.alias("degraded"),
        F.when(degraded, F.concat(F.lit("Degraded: "), ratio))
        .when(empty, F.concat(F.lit("All "), total, F.lit(" engines responded but returned no results")))
        .otherwise(F.concat(F.lit("Healthy: "), ratio)).alias("detail"),
    )
