"""Structured Streaming twins of the incremental operators.

Aggregates run in update mode: every micro-batch appends its changed groups to a
log folder, and the newest row of a group is its value. Windowed aggregates
declare a watermark, which drops later rows and ends their state. Operators whose
rule reaches back over rows (``state``) keep a value per key with an event-time
timer that removes it. A micro-batch is applied in time order; disorder across
batches within the watermark is not repaired.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from webstrata.operators.jobs import TERMINAL
from webstrata.operators.ordered import epoch_us
from webstrata.session import checkpoint_root, cut_lineage, remove_at_end, scratch
from webstrata.streaming import state

WATERMARK = "10 minutes"
#: Rows of one file of a replayed micro-batch.
FILE_ROWS = 500_000
#: Buckets that keys are dealt to where a call takes many keys; part of the state, so not to be changed for a stream that runs.
KEY_BUCKETS = 1024
#: Times inside keys are written in full.
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: Seconds that ended jobs and runs are kept.
RETENTION = 30 * 86400


def read_stream(spark: SparkSession, folder: str, table: str, max_files: int = 1000) -> DataFrame:
    """File stream over one parquet table of a folder, ``max_files`` per micro-batch.

    Watermarks need instants, so zone-less timestamps are read as UTC.
    """
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    rows = spark.readStream.option("maxFilesPerTrigger", max_files).schema(schema).parquet(f"{folder}/{table}.parquet*")
    return rows.select(*[
        F.timestamp_micros(epoch_us(F.col(n))).alias(n) if t == "timestamp_ntz" else F.col(n)
        for n, t in rows.dtypes
    ])


def _folders(spark: SparkSession) -> tuple[str, str]:
    base = f"{checkpoint_root(spark).rstrip('/')}/webstrata-stream-{uuid.uuid4().hex}"
    return base + "/out", base + "/state"


def replay(rows: DataFrame, batch: Column, event_time: str = "ts") -> DataFrame:
    """A stream that brings ``rows`` in the micro-batches that ``batch`` (0, 1, ...) names.

    Every batch is written as equally many files of at most about ``FILE_ROWS`` rows
    and read in order, so late rows can be offered on purpose and a stream be
    compared with its batch query over several micro-batches. No batch goes through
    one task.
    """
    spark = rows.sparkSession
    folder = f"{checkpoint_root(spark).rstrip('/')}/webstrata-replay-{uuid.uuid4().hex}"
    numbered = rows.withColumn("__batch", batch.cast("int"))
    if dict(rows.dtypes)[event_time] == "timestamp_ntz":
        numbered = numbered.withColumn(event_time, F.timestamp_micros(epoch_us(F.col(event_time))))
    # The rows are computed once, not once for every batch.
    with scratch(spark):
        numbered = cut_lineage(numbered)
        counted = numbered.where("__batch IS NOT NULL").groupBy("__batch").count().agg(F.max("__batch"), F.max("count")).first()
        files = max(1, -(-(counted[1] or 0) // FILE_ROWS))
        for number in range(-1 if counted[0] is None else counted[0] + 1):
            part, at = numbered.where(F.col("__batch") == number).drop("__batch"), f"{folder}/batch={number}"
            (part.coalesce(1) if files == 1 else part.repartition(files)).write.parquet(at)
            # Tasks without rows write nothing; a micro-batch is a number of files.
            for _ in range(files - len(spark.read.schema(part.schema).parquet(at).inputFiles()) if files > 1 else 0):
                part.limit(0).coalesce(1).write.mode("append").parquet(at)
    remove_at_end(spark, folder)
    schema = numbered.drop("__batch").schema
    return spark.readStream.option("maxFilesPerTrigger", files).schema(schema).parquet(f"{folder}/*")


def _run(writer) -> None:
    """Run a stream over what is available, with a state store that knows timers."""
    spark, conf = writer._spark, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, state.PROVIDER)
    try:
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(conf) if before is None else spark.conf.set(conf, before)


def run_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run an update-mode stream over what is available; newest row per key."""
    spark = stream.sparkSession
    out, place = _folders(spark)

    def log(batch: DataFrame, number: int) -> None:
        # Overwriting the batch's own folder makes a repeated batch harmless.
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    _run(stream.writeStream.outputMode("update").foreachBatch(log).option("checkpointLocation", place))
    rows = spark.read.schema(f"{_ddl(stream)}, batch long").parquet(out)
    values = [c for c in stream.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, "v.*")


def run_appends(stream: DataFrame) -> DataFrame:
    """Run an append-mode stream into a parquet folder and read it back."""
    spark = stream.sparkSession
    out, place = _folders(spark)
    _run(
        stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", place)
    )
    return spark.read.schema(_ddl(stream)).parquet(out)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def rate_limit_windows(events: DataFrame, key: str, limit: int, window_seconds: int) -> DataFrame:
    """(key, window_start, requests, allowed) per fixed window."""
    counted = events.withWatermark("ts", WATERMARK).groupBy(
        key, F.window("ts", f"{window_seconds} seconds").alias("w")
    ).agg(F.count("*").alias("requests"))
    return counted.select(
        key, F.col("w.start").alias("window_start"), "requests",
        F.least(F.col("requests"), F.lit(limit)).alias("allowed"),
    )


def _keyed(rows: DataFrame, keys: list[str], processor: state.Timed, schema: str, mode: str = "append") -> DataFrame:
    """``processor`` over rows (with ``ts``) per key, under the watermark."""
    processor.columns = tuple(StructType.fromDDL(schema).names)
    return rows.withWatermark("ts", WATERMARK).groupBy(*keys).transformWithState(
        processor, schema, mode, "EventTime"
    )


def _seconds() -> Column:
    return F.unix_micros("ts") / 1_000_000


def _at(seconds: str) -> Column:
    return F.timestamp_micros(((F.col(seconds) + state.ORIGIN) * 1_000_000).cast("long"))


def rate_limit(events: DataFrame, key: str, limit: int, window_seconds: int) -> DataFrame:
    """Verdict per event (key, event_id, window_no, allowed, remaining) of (key, event_id, ts)."""
    timed = events.select(key, "event_id", "ts", F.unix_micros("ts").alias("us"))
    kind = dict(events.dtypes)[key]
    return _keyed(
        timed, [key], state.RateLimit(key, limit, window_seconds),
        f"`{key}` {kind}, event_id long, window_no long, allowed boolean, remaining long",
    )


def crawl_progress(events: DataFrame, job: str, kind: str, retention: float = RETENTION) -> DataFrame:
    """Running page / error / progress counts per job; a job is kept ``retention`` seconds after its last event."""
    marked = events.select(
        job, "ts", _seconds().alias("seconds"), *[F.when(F.col(kind) == v, 1).otherwise(0).alias(f"{v}s") for v in ("page", "error")],
        F.lit(1).alias("events"),
    )
    return _keyed(
        marked, [job], state.Totals(("pages", "errors", "events"), retention),
        f"`{job}` {dict(events.dtypes)[job]}, pages long, errors long, events long", "update",
    )


def _plain(column: str, kind: str) -> Column:
    """A key column as JSON can carry it: instants as microseconds, one zero."""
    if kind == "timestamp":
        return F.unix_micros(column)
    return (F.col(column) + F.lit(0).cast(kind)).cast(kind) if kind in ("float", "double") else F.col(column)


def new_urls(stream: DataFrame, keys: list[str], ttl: float) -> DataFrame:
    """First sight of each key, and the first one ``ttl`` seconds after that, and so on: (keys, seconds).

    State is kept by ``KEY_BUCKETS`` buckets of keys, so that calls do not grow with the keys.
    """
    kinds = [dict(stream.dtypes)[k] for k in keys]
    named = F.to_json(F.struct(*[_plain(k, kind).alias(f"k{i}") for i, (k, kind) in enumerate(zip(keys, kinds, strict=True))]), EXACT)
    timed = stream.select(named.alias("key"), (F.unix_micros("ts") / 1_000_000).alias("seconds"))
    dealt = timed.select("*", F.pmod(F.xxhash64("key"), F.lit(KEY_BUCKETS)).alias("bucket"), _at("seconds").alias("ts"))
    seen = dealt.withWatermark("ts", WATERMARK).groupBy("bucket").transformWithStateInPandas(
        state.FirstSights(ttl), "key string, seconds double", "append", "EventTime"
    )
    schema = ", ".join(f"k{i} {'long' if kind == 'timestamp' else kind}" for i, kind in enumerate(kinds))
    back = seen.select(F.from_json("key", schema, EXACT).alias("k"), "seconds")
    return back.select(*[
        (F.timestamp_micros(f"k.k{i}") if kind == "timestamp" else F.col(f"k.k{i}")).alias(k)
        for i, (k, kind) in enumerate(zip(keys, kinds, strict=True))
    ], "seconds")


def running_counters(events: DataFrame, ttl: float) -> DataFrame:
    """(name, started, value) of counters over (name, seconds): each lives ``ttl``
    seconds from its first increment and then starts again."""
    return _keyed(
        events.select("name", "seconds", _at("seconds").alias("ts")), ["name"], state.Lifetimes(ttl),
        "name string, started double, value long", "update",
    )


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Closed sessions of a key."""
    grouped = events.withWatermark("ts", WATERMARK).groupBy(key, F.session_window("ts", gap).alias("s"))
    return grouped.agg(F.count("*").alias("steps")).select(
        key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "steps"
    )


def job_status(events: DataFrame, job: str, retention: float = RETENTION) -> DataFrame:
    """(job_id, status): the first terminal event of a job decides; a job is kept
    ``retention`` seconds after its last event."""
    rows = events.select(F.col(job).alias("job_id"), "ts", _seconds().alias("seconds"), "event_id", "event")
    return _keyed(rows, ["job_id"], state.JobStatus(tuple(TERMINAL), retention), "job_id long, status string", "update")


def politeness(requests: DataFrame) -> DataFrame:
    """Admit or delay requests (domain, request_id, seconds, crawl_delay) as they arrive.

    State per domain is the last admitted time, for one delay. The size of a batch
    (``maxFilesPerTrigger``) bounds what one domain brings at a time.
    """
    rows = requests.select("domain", "request_id", "seconds", "crawl_delay", _at("seconds").alias("ts"))
    return _keyed(rows, ["domain"], state.Pacing(), "domain string, request_id long, action string")


def research_state(parsed: DataFrame, retention: float = RETENTION) -> DataFrame:
    """Projection of research runs over parsed events (run_id, seq, type, ts, p).

    ``kind = 'state'``: the run's status, plan, pass, error and pending pages, anew
    in every micro-batch that changes it; ``kind = 'source'``: a page the run
    names, once.
    """
    rows = parsed.select(
        "run_id", "seq", "type", "ts", _seconds().alias("seconds"), "p.state", "p.strategy", F.col("p.pass").alias("pass_no"), "p.total_passes", "p.url", "p.sources", "p.content"
    )
    return _keyed(rows, ["run_id"], state.Research(retention), state.Research.OUTPUT, "append")


def run_research(stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(newest state per run, sources) of a ``research_state`` stream over what is available."""
    spark = stream.sparkSession
    out, place = _folders(spark)

    def log(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    _run(stream.writeStream.outputMode("append").foreachBatch(log).option("checkpointLocation", place))
    rows = spark.read.schema(f"{_ddl(stream)}, batch long").parquet(out)
    fields = ["status", "strategy", "pass_number", "total_passes", "completed", "error", "pending"]
    states = rows.where("kind = 'state'").groupBy("run_id").agg(F.max_by(F.struct(*fields), "batch").alias("v"))
    return states.select("run_id", "v.*"), rows.where("kind = 'source'").select("run_id", "url", "first_seq")
