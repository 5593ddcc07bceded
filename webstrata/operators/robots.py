"""Robots rules, politeness audit and cache lifetimes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webstrata.functions import html as H
from webstrata.functions import urls as U
from webstrata.operators import ordered
from webstrata.session import cut_lineage

AGENTS = ("*", "bot")
DEFAULT_DELAY = 1.0


def _value(line: Column) -> Column:
    return H.strip_space(F.regexp_extract(line, r"^[^:]*:(.*)$", 1))


def parse_robots(robots: DataFrame, text: str = "text", agents: Sequence[str] = AGENTS) -> DataFrame:
    """Adds ``disallow`` (array), ``crawl_delay`` and ``sitemaps`` (array).

    A robots file is one row, so rules stay in that row: the text is cut at
    every User-agent line, and only the blocks of our agents are read. A later
    User-agent line replaces the earlier one; Allow lines are ignored.
    ``agents`` are the lower-case names that apply, add the crawler's own name.
    """
    blocks = F.split(
        F.regexp_replace(F.col(text), r"(?im)^[ \t]*user-agent:", "\u0001user-agent:"), "\u0001"
    )
    ours = F.filter(
        blocks,
        lambda b: b.startswith("user-agent:")
        & F.lower(_value(F.regexp_extract(b, r"^([^\r\n]*)", 1))).isin(list(agents)),
    )
    lines = F.filter(
        F.transform(F.flatten(F.transform(ours, lambda b: F.split(b, r"\r?\n|\r"))), H.strip_space),
        lambda s: (s != "") & ~s.startswith("#"),
    )

    def of(kind: str) -> Column:
        return F.transform(
            F.filter("__lines", lambda s: F.lower(s).startswith(kind + ":")), _value
        )

    delays = F.filter(
        F.transform(of("crawl-delay"), lambda v: v.try_cast("double")), lambda v: v.isNotNull()
    )
    return (
        robots.withColumn("__lines", lines)
        .withColumn("disallow", F.filter(of("disallow"), lambda p: p != ""))
        .withColumn("crawl_delay", F.try_element_at(delays, F.lit(-1)))
        .withColumn("sitemaps", of("sitemap")).drop("__lines")
    )


def robots_rules(robots: DataFrame, domain: str = "domain", **options) -> DataFrame:
    """(domain, kind, value, pos) rows of the parsed rules."""
    parsed = parse_robots(robots, **options)
    delay = F.when(F.col("crawl_delay").isNotNull(), F.array(F.col("crawl_delay").cast("string")))
    kinds = [("disallow", F.col("disallow")), ("crawl_delay", delay), ("sitemap", F.col("sitemaps"))]

    def tag(kind: str, values: Column) -> Column:
        return F.transform(
            F.coalesce(values, F.array().cast("array<string>")),
            lambda v, i: F.struct(F.lit(kind).alias("kind"), v.alias("value"), i.alias("pos")),
        )

    tagged = F.flatten(F.array(*[tag(kind, values) for kind, values in kinds]))
    return parsed.select(domain, F.inline(tagged))


def robots_regex(pattern: Column) -> Column:
    """``*`` any text, a final ``$`` the end; everything else literal."""
    escaped = F.regexp_replace(pattern, r"([.^$+?{}\[\]\\|()])", r"\\$1")
    starred = F.replace(escaped, F.lit("*"), F.lit(".*"))
    return F.concat(F.lit("^"), F.regexp_replace(starred, r"\\\$$", r"\$"))


def blocking_rule(path: Column, disallow: Column) -> Column:
    """First rule that matches the path; NULL when the path is open."""
    return F.try_element_at(
        F.filter(
            disallow,
            # Plain prefixes need no regex.
            lambda p: F.when(~p.contains("*") & ~p.contains("$"), path.startswith(p))
            .otherwise(F.regexp_like(path, robots_regex(p))),
        ),
        F.lit(1),
    )


def robots_check(
    urls: DataFrame, robots: DataFrame, ignore_robots: bool = False, **options
) -> DataFrame:
    """Adds ``allowed`` and ``rule``; hosts without a robots file are open.

    One equi-join on the host. ``robots`` has one row per domain, so a host
    that owns a third of the URLs makes one side uneven and AQE splits it.
    """
    rules = parse_robots(robots, **options).select(F.col("domain").alias("host"), "disallow")
    joined = urls.withColumn("host", U.hostname(F.col("url"))).join(rules, "host", "left")
    target = F.coalesce(F.nullif(U.path(F.col("url")), F.lit("")), F.lit("/"))
    rule = F.lit(None).cast("string") if ignore_robots else blocking_rule(target, F.col("disallow"))
    return joined.withColumn("rule", rule).withColumn("allowed", F.col("rule").isNull()).drop("disallow")


# ------------------------------------------------------------------ pacing

def _admit(times: np.ndarray, delay: float, last: float) -> tuple[np.ndarray, np.ndarray]:
    """(last admitted time before each request, admitted flag) of sorted times.

    A request is admitted when ``delay`` has passed since the last admitted one,
    so the scan jumps from one admitted request to the next.
    """
    seen, admitted = np.full(len(times), np.nan), np.zeros(len(times), dtype=bool)
    ready = times - delay
    i = 0 if np.isnan(last) else int(np.searchsorted(ready, last, side="left"))
    seen[:i] = last
    while i < len(times):
        seen[i], admitted[i] = last, True
        last = times[i]
        j = max(int(np.searchsorted(ready, last, side="left")), i + 1)
        seen[i + 1:j] = last
        i = j
    return seen, admitted


def _exits(key: str, slice_: str, seconds: str, delay: str, first: str):
    """Where a slice of sorted times leaves each of its possible entries.

    A chain enters a slice at the first request at or after (last admitted +
    delay). Since the last admitted time is not after the slice's first, only
    distinct times within one delay of it can be that entry; the first slice of a
    key is entered at its first time.
    """
    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf[seconds].to_numpy(dtype=float))
        gap = float(pdf[delay].iloc[0])
        starts = np.unique(times[: int(np.searchsorted(times, times[0] + gap, side="right")) + 1])
        if group[1] == pdf[first].iloc[0]:
            starts = starts[:1]
        last = starts.copy()
        while True:  # all chains of the slice step together
            at = np.maximum(np.searchsorted(times - gap, last, side="left"), np.searchsorted(times, last, side="right"))
            goes_on = at < len(times)
            if not goes_on.any():
                break
            last[goes_on] = times[at[goes_on]]
        if np.any(times - gap >= times):  # no delay: everything is admitted, whatever came before
            starts = last = np.array([np.nan])
        return pd.DataFrame({key: [group[0]] * len(starts), slice_: group[1], "gap": gap, "enter": starts, "leave": last})

    return run


def _reached(nodes: DataFrame, key: str) -> DataFrame:
    """Nodes (node, key, slice, gap, enter, leave, root) that the chain of their key goes through.

    The node after a node is the first one at or after its exit plus the delay,
    found in one ordered pass over all of them. Pointers are then doubled: after
    round r a node points 2**r steps ahead and all nodes within 2**r steps of a
    root are known, so the rounds number the logarithm of the slices of a key.
    Joins are on single nodes, so a key of any size is spread over all tasks.
    """
    down, kind, back = "__down", "__kind", "__back"
    entries = nodes.select(
        key, (F.col("gap") - F.col("enter")).alias(down), F.lit(0).alias(kind), (-F.col(ordered.SLICE)).alias(back),
        "node", F.lit(None).cast("long").alias("asks"),
    )
    probes = nodes.select(
        key, (-F.col("leave")).alias(down), F.lit(1).alias(kind), F.lit(0).alias(back),
        F.lit(None).cast("long").alias("node"), F.col("node").alias("asks"),
    )
    # Backwards in time, by (time - delay) against the exit as in ``_admit``; of nodes
    # at one time the earliest slice is met last.
    order = [down, kind, back]
    sliced = ordered.with_slices(entries.unionByName(probes), [key], order)
    met = ordered.carry_last(sliced, [key], order, "node", "next", include_current=True)
    after = met.where(F.col(kind) == 1).select(F.col("asks").alias("node"), "next")
    state = cut_lineage(nodes.select("node", "root").join(after, "node").select("node", "next", F.col("root").alias("reached")))
    while state.where("next IS NOT NULL").limit(1).count():
        ahead = state.select(F.col("node").alias("next"), F.col("next").alias("far"))
        found = state.where("reached AND next IS NOT NULL").select(F.col("next").alias("node"), F.lit(True).alias("found")).distinct()
        state = cut_lineage(
            state.join(ahead, "next", "left").join(found, "node", "left")
            .select("node", F.col("far").alias("next"), (F.col("reached") | F.coalesce("found", F.lit(False))).alias("reached"))
        )
    return nodes.join(state.where("reached").select("node"), "node", "left_semi")


def greedy_scan(
    requests: DataFrame, key: str, seconds: str, order: str, delay: str, slices: int | None = None
) -> DataFrame:
    """Adds ``admitted`` and ``last_admitted`` (before the row): a row is admitted
    when ``delay`` seconds have passed since the last admitted row of its key.

    The verdict of a row depends on the whole chain before it. The table is cut
    into slices; every slice of a key that spans several tells where it would
    leave each possible entry, the true path through these is found by pointer
    doubling, and every slice is scanned once from its true entry. No task holds
    more than one slice of a key. ``delay`` is constant per key; a NULL key is a
    key like any other.
    """
    base = ordered.with_slices(requests, [key], [seconds, order], slices)
    key_type, slice_ = dict(base.dtypes)[key], ordered.SLICE
    per_key = Window.partitionBy(key)
    # One row per slice of a key.
    spans = cut_lineage(base.select(key, slice_).distinct().select(
        key, slice_, F.min(slice_).over(per_key).alias("first"), F.max(slice_).over(per_key).alias("last")
    ))
    long = spans.where("first < last").select(key, slice_, "first")
    edge = ordered.join_summary(base.select(key, slice_, seconds, delay), long, [key]).where("first IS NOT NULL")
    nodes = cut_lineage(
        edge.groupBy(key, slice_).applyInPandas(
            _exits(key, slice_, seconds, delay, "first"),
            f"`{key}` {key_type}, `{slice_}` int, gap double, enter double, leave double",
        )
        .where("enter IS NOT NULL AND NOT isnan(enter)").withColumn("node", F.monotonically_increasing_id())
    )
    rooted = ordered.join_summary(nodes, long, [key]).withColumn("root", F.col(slice_) == F.col("first")).drop("first")
    path = _reached(rooted, key).select(key, slice_, "leave")
    before = per_key.orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    entries = ordered.join_summary(spans.select(key, slice_), path, [key]).select(
        key, slice_, F.last("leave", ignorenulls=True).over(before).alias("entry")
    )
    columns = [*base.columns, "last_admitted", "admitted"]

    def rescan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([seconds, order, ordered.ROW], kind="stable").reset_index(drop=True)
        pdf["last_admitted"], pdf["admitted"] = _admit(
            pdf[seconds].to_numpy(dtype=float), float(pdf[delay].iloc[0]), float(pdf["entry"].iloc[0])
        )
        return pdf[columns]

    schema = ", ".join(f"`{n}` {t}" for n, t in base.dtypes) + ", last_admitted double, admitted boolean"
    scanned = ordered.join_summary(base, entries.where("entry IS NOT NULL"), [key]).groupBy(key, slice_).applyInPandas(rescan, schema)
    return ordered.unsliced(scanned).withColumn(
        "last_admitted", F.when(~F.isnan("last_admitted"), F.col("last_admitted"))
    )


def politeness_audit(
    requests: DataFrame, key: str = "domain", seconds: str = "seconds", order: str = "request_id",
    delay: str = "crawl_delay", slices: int | None = None,
) -> DataFrame:
    """Adds ``action`` (proceed / delay) and ``wait_seconds`` to a request log."""
    scanned = greedy_scan(requests, key, seconds, order, delay, slices)
    wait = F.round(F.col(delay) - (F.col(seconds) - F.col("last_admitted")), 6)
    return (
        scanned.withColumn("action", F.when(F.col("admitted"), "proceed").otherwise("delay"))
        .withColumn("wait_seconds", F.when(F.col("admitted"), 0.0).otherwise(wait))
        .drop("last_admitted", "admitted")
    )


# ------------------------------------------------------------------ lifetimes

DEFAULT_TTL, MIN_TTL, MAX_TTL = 3600, 60, 86400
STABLE_FACTOR, VOLATILE_FACTOR, VOLATILE_CAP = 2.0, 0.5, 300


def host_suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def clamp_ttl(base_ttl: Column, factor: Column | float = 1.0) -> Column:
    factor = factor if isinstance(factor, Column) else F.lit(factor)
    return F.greatest(F.lit(MIN_TTL), F.least((base_ttl * factor).cast("int"), F.lit(MAX_TTL)))


def resolve_ttl(urls: DataFrame, policy: DataFrame, factor: Column | float = 1.0) -> DataFrame:
    """Adds ``ttl``: longest host-suffix rule of ``policy`` (pattern, ttl), clamped.

    The suffix test is an equi-join: distinct hosts are spread over their
    suffixes, matched once, and joined back, so URLs are never multiplied.
    """
    hosted = urls.withColumn("host", U.hostname(F.col("url")))
    matched = (
        hosted.select("host").distinct()
        .select("host", F.explode(host_suffixes(F.col("host"))).alias("pattern"))
        .join(policy, "pattern")
        .groupBy("host").agg(F.max_by("ttl", F.length("pattern")).alias("policy_ttl"))
    )
    ttl = clamp_ttl(F.coalesce(F.col("policy_ttl"), F.lit(DEFAULT_TTL)), factor)
    return hosted.join(matched, "host", "left").withColumn("ttl", ttl).drop("policy_ttl", "host")
