"""Job, session, budget and research-event accounting."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webstrata.operators import ordered
from webstrata.operators.robots import greedy_scan


def parse_limit(text: str) -> tuple[int, int]:
    """``"10/60s"`` → (10, 60)."""
    match = re.fullmatch(r"\s*(-?\d+)\s*/\s*(-?\d+)s?\s*", text)
    if not match:
        raise ValueError(f"invalid rate limit {text!r}, expected 'count/window'")
    limit, window = int(match[1]), int(match[2])
    if limit <= 0 or window <= 0:
        raise ValueError(f"rate limit values must be positive: {text!r}")
    return limit, window


def rate_limit(events: DataFrame, key: str, us: str, order: str, limit: int, window_seconds: int) -> DataFrame:
    """Adds window_no, allowed and remaining: fixed windows, counted in arrival order."""
    windowed = events.withColumn("window_no", F.floor(F.col(us) / (window_seconds * 1_000_000)).cast("long"))
    sliced = ordered.with_slices(windowed, [key, "window_no"], [us, order])
    counted = ordered.running_sum(sliced, [key, "window_no"], [us, order], F.lit(1), "__n")
    return ordered.unsliced(counted).withColumns({
        "allowed": F.col("__n") <= limit, "remaining": F.greatest(F.lit(0), limit - F.col("__n")).cast("long"),
    }).drop("__n")


def search_budget(events: DataFrame, request: str, us: str, order: str, budget: int) -> DataFrame:
    """Adds accepted: the first ``budget`` searches of a request."""
    counted = ordered.rank_in_key(events, [request], [us, order], "__n")
    return counted.withColumn("accepted", F.col("__n") <= budget).drop("__n")


TERMINAL = ["completed", "failed", "cancelled"]


def job_status(job_events: DataFrame, job: str, order: list[str]) -> DataFrame:
    """(job, status): the first terminal event decides, later ones are ignored."""
    ended = F.col("event").isin(TERMINAL)
    return job_events.groupBy(job).agg(
        F.coalesce(F.min_by("event", F.when(ended, F.struct(*order))), F.lit("processing")).alias("status")
    )


def job_counters(job_events: DataFrame, job: str, ms: str) -> DataFrame:
    """Completed pages, duration and credits per job.

    Rows are of event created / completed / page_done / page; credits are the
    completed pages, or the listed pages when none was counted.
    """
    def at(event: str) -> Column:
        return F.min(F.when(F.col("event") == event, F.col(ms)))

    def n(event: str) -> Column:
        return F.sum(F.when(F.col("event") == event, 1).otherwise(0))

    agg = job_events.groupBy(job).agg(
        n("page_done").alias("completed"), n("page").alias("pages"),
        (at("completed") - at("created")).alias("duration_ms"),
    )
    return agg.withColumn("credits", F.when(F.col("completed") > 0, F.col("completed")).otherwise(F.col("pages")))


def active_jobs(jobs: DataFrame, order: list, kind: str | None = None, status: str = "processing", limit: int = 50) -> DataFrame:
    """Jobs in a status, oldest first, at most ``limit``."""
    rows = jobs.where(F.col("status") == status)
    return (rows.where(F.col("kind") == kind) if kind else rows).orderBy(*order).limit(limit)


def count_active(jobs: DataFrame, kind: str | None = None) -> DataFrame:
    rows = jobs.where("status = 'processing'")
    return (rows.where(F.col("kind") == kind) if kind else rows).agg(F.count("*").alias("active"))


def counters(events: DataFrame, name: str, seconds: str, order: str, ttl: float) -> DataFrame:
    """(name, started, value): a counter lives ``ttl`` seconds from its first
    increment, later increments do not extend it, and then it starts again."""
    timed = events.withColumn("__ttl", F.lit(float(ttl)))
    scanned = greedy_scan(timed, name, seconds, order, "__ttl")
    started = F.when(F.col("admitted"), F.col(seconds)).otherwise(F.col("last_admitted"))
    return scanned.groupBy(name, started.alias("started")).agg(F.count("*").alias("value"))


def sessionize(events: DataFrame, key: str, us: str, order: str, gap_seconds: int) -> DataFrame:
    """Adds session_no: a new session after ``gap_seconds`` without a step."""
    sliced = ordered.with_slices(events, [key], [us, order])
    before = ordered.previous(sliced, [key], [us, order], [us])
    fresh = F.when(F.col(f"prev.{us}").isNull() | (F.col(us) - F.col(f"prev.{us}") >= gap_seconds * 1_000_000), 1).otherwise(0)
    return ordered.unsliced(ordered.running_sum(before, [key], [us, order], fresh, "session_no")).drop("prev")


def session_windows(events: DataFrame, key: str, us: str, order: str, gap_seconds: int) -> DataFrame:
    """(key, session_no, steps, first_us, last_us)."""
    return sessionize(events, key, us, order, gap_seconds).groupBy(key, "session_no").agg(
        F.count("*").alias("steps"), F.min(us).alias("first_us"), F.max(us).alias("last_us")
    )


# ------------------------------------------------------------------ research events

EVENT_SCHEMA = (
    "state string, strategy string, queries array<string>, reasoning string, `pass` int, "
    "total_passes int, url string, title string, relevance string, source string, chars long, "
    "char_count long, sources array<string>, content string"
)


def read_research_events(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Parsed payload next to run_id, seq, type; source objects become JSON text."""
    return events.withColumn("p", F.from_json(F.col(payload), EVENT_SCHEMA)).drop(payload)


def source_url(item: Column) -> Column:
    """URL of a source given as an object or as plain text."""
    return F.coalesce(F.get_json_object(item, "$.url"), F.when(~item.startswith("{"), item))


def fold_research_events(parsed: DataFrame) -> DataFrame:
    """Final state per run, as aggregates instead of a row-by-row fold.

    Each field is decided by the last event that writes it; ``max_by`` combines
    inside partitions, so a run of any length needs no single-task scan.
    """
    kind = F.col("type")

    def last(value: Column, *types: str) -> Column:
        return F.max_by(value, F.when(kind.isin(list(types)), F.col("seq")))

    status = (
        F.when(kind == "status", F.col("p.state")).when(kind == "done", F.lit("completed"))
        .when(kind == "error", F.lit("failed"))
    )
    return parsed.groupBy("run_id").agg(
        last(status, "status", "done", "error").alias("status"),
        last(F.col("p.strategy"), "research_plan").alias("strategy"),
        last(F.col("p.pass"), "research_pass").alias("pass_number"),
        last(F.col("p.total_passes"), "research_pass").alias("total_passes"),
        F.coalesce(last(kind == "done", "done", "error"), F.lit(False)).alias("completed"),
        last(F.when(kind == "error", F.coalesce("p.content", F.lit(""))), "done", "error").alias("error"),
    )


def research_source_urls(parsed: DataFrame) -> DataFrame:
    """(run_id, url, first_seq) of every source named by a scrape, source list or final event."""
    single = parsed.where("type = 'source_scraped'").select("run_id", "seq", F.lit(0).alias("i"), F.col("p.url").alias("url"))
    listed = parsed.where("type IN ('sources', 'done')").select(
        "run_id", "seq", F.posexplode("p.sources").alias("i", "item")
    ).select("run_id", "seq", "i", source_url(F.col("item")).alias("url"))
    both = single.unionByName(listed).where("url <> ''")
    return both.groupBy("run_id", "url").agg(F.min(F.struct("seq", "i")).alias("first")).select(
        "run_id", "url", F.col("first.seq").alias("first_seq")
    )


def research_pending(parsed: DataFrame) -> DataFrame:
    """(run_id, url) still pending: the last pending list minus pages scraped after it."""
    resets = parsed.where("type IN ('sources_pending', 'sources', 'done')")
    last = resets.groupBy("run_id").agg(
        F.max_by(F.struct("seq", "type", "p.sources"), "seq").alias("r")
    ).where("r.type = 'sources_pending'")
    wanted = last.select("run_id", F.col("r.seq").alias("since"), F.explode("r.sources").alias("item")).select(
        "run_id", "since", source_url(F.col("item")).alias("url")
    ).where("url <> ''")
    scraped = parsed.where("type = 'source_scraped'").groupBy("run_id", F.col("p.url").alias("url")).agg(
        F.max("seq").alias("scraped_seq")
    )
    open_rows = wanted.join(scraped, ["run_id", "url"], "left").where(
        "scraped_seq IS NULL OR scraped_seq < since"
    )
    return open_rows.select("run_id", "url")
