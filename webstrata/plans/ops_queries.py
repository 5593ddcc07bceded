"""Monitor, rate limit, job, stream and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from webstrata.operators import jobs as J
from webstrata.operators import metrics as X
from webstrata.operators import monitor as W
from webstrata.operators import ordered
from webstrata.functions import urls as U
from webstrata.plans import ansi as A
from webstrata.plans.registry import query
from webstrata.streaming import streams as T

# ------------------------------------------------------------------ monitors

# Every document is checked three times in a row: as it is, unchanged, and gone.
CHECKS = """SELECT doc_id * 3 AS doc_id, source AS monitor_id, text FROM {documents}
UNION ALL SELECT doc_id * 3 + 1, source, text FROM {documents} UNION ALL SELECT doc_id * 3 + 2, source, '' FROM {documents} WHERE n_chars > 1000"""
CHANGE_SQL = f"""WITH c AS (SELECT *, lag(text) OVER (PARTITION BY monitor_id ORDER BY doc_id) AS p FROM ({CHECKS})),
k AS (SELECT *, coalesce(p <> '' AND p <> text, false) AS changed FROM c)"""


@query("x1_detect_changes", CHANGE_SQL + """ SELECT doc_id, monitor_id, changed, CASE WHEN changed THEN 'changed' ELSE 'unchanged' END AS last_result,
 CASE WHEN changed THEN length(p) END AS previous_length, CASE WHEN changed THEN length(text) END AS current_length FROM k""")
def x1_detect_changes(t):
    return W.detect_changes(t.sql(CHECKS), "monitor_id", "doc_id", "text").drop("text")


@query("x2_unified_diff", CHANGE_SQL + """ SELECT doc_id, changed, changed AS has_header FROM k""")
def x2_unified_diff(t):
    d = W.detect_changes(t.sql(CHECKS), "monitor_id", "doc_id", "text", with_diff=True)
    return d.select("doc_id", "changed", F.col("diff").startswith("--- previous\n+++ current\n@@").alias("has_header"))


@query("x3_diff_stats", CHANGE_SQL + """, s AS (SELECT doc_id, list_distinct(string_split(coalesce(p, ''), chr(10))) AS a, list_distinct(string_split(text, chr(10))) AS b FROM k)
SELECT doc_id, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS added, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS removed FROM s""")
def x3_diff_stats(t):
    return W.change_stats(t.sql(CHECKS), "monitor_id", "doc_id", "text")


@query("x4_check_history", f"""WITH r AS (SELECT user_id AS monitor_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events)
SELECT monitor_id, event_id, rank FROM r WHERE rank <= 50""")
def x4_check_history(t):
    checks = t.events.withColumnRenamed("user_id", "monitor_id")
    return W.check_history(checks, "monitor_id", [F.desc("ts"), F.desc("event_id")]).select(
        "monitor_id", "event_id", "rank"
    )


FOUND = "SELECT user_id AS monitor_id, event_id, 'https://n.example/' || CAST(floor(value) AS BIGINT) AS url FROM {events} WHERE event_type = 'click'"
SEEN = "SELECT user_id AS monitor_id, 'https://n.example/' || CAST(floor(value) AS BIGINT) AS url FROM {events} WHERE event_type = 'view'"


@query("x5_new_results", f"SELECT f.* FROM ({FOUND}) f ANTI JOIN ({SEEN}) s ON f.monitor_id = s.monitor_id AND f.url = s.url")
def x5_new_results(t):
    return W.new_results(t.sql(FOUND), t.sql(SEEN), ["monitor_id"])


@query("x6_monitor_status", """WITH m AS (SELECT DISTINCT user_id + CASE WHEN user_id % 9 = 0 THEN 1000000 ELSE 0 END AS monitor_id FROM events)
SELECT m.monitor_id, arg_max(event_type, event_id) AS last_result, max(event_id) AS last_checked FROM m LEFT JOIN events e ON m.monitor_id = e.user_id GROUP BY 1""")
def x6_monitor_status(t):
    monitors = t.sql("SELECT DISTINCT user_id + CASE WHEN user_id % 9 = 0 THEN 1000000 ELSE 0 END AS monitor_id FROM {events}")
    checks = t.events.select(F.col("user_id").alias("monitor_id"), F.col("event_type").alias("result"), "event_id")
    return W.monitor_status(monitors, checks, "monitor_id", F.col("event_id"))


# ------------------------------------------------------------------ limits, jobs

def _events(t):
    return t.events.withColumn("us", ordered.epoch_us(F.col("ts")))


def _batch(t, batches=4):
    """Number of the micro-batch of an event: consecutive events in equally long batches."""
    last = t.events.agg(F.max("event_id")).first()[0] or 0
    return lambda event_id: F.floor(F.col(event_id) * batches / (last + 1))


RATE_SQL = """WITH w AS (SELECT event_id, event_type, epoch_us(ts) // 60000000 AS window_no, row_number() OVER (PARTITION BY event_type, epoch_us(ts) // 3600000000 ORDER BY ts, event_id) AS n, epoch_us(ts) // 3600000000 AS h FROM events)
SELECT event_id, event_type, h AS window_no, n <= 2 AS allowed, greatest(0, 2 - n) AS remaining FROM w"""


@query("t1_rate_limit", RATE_SQL)
def t1_rate_limit(t):
    limit, window = J.parse_limit("2/3600s")
    return J.rate_limit(_events(t), "event_type", "us", "event_id", limit, window).select(
        "event_id", "event_type", "window_no", "allowed", "remaining"
    )




@query("t1_rate_limit_verdicts_stream", RATE_SQL)
def t1_rate_limit_verdicts_stream(t):
    """A verdict per event, as the events come."""
    limit, window = J.parse_limit("2/3600s")
    stream = T.replay(t.events.select("event_id", "event_type", "ts"), _batch(t)("event_id"))
    return T.run_appends(T.rate_limit(stream, "event_type", limit, window)).select(
        "event_id", "event_type", "window_no", "allowed", "remaining"
    )


@query("t1_rate_limit_stream", """SELECT user_id, epoch_us(ts) // 3600000000 AS window_no, count(*) AS requests, least(count(*), 2) AS allowed FROM events GROUP BY 1, 2""")
def t1_rate_limit_stream(t):
    stream = T.rate_limit_windows(T.read_stream(t.spark, t.folder, "events"), "user_id", 2, 3600)
    done = T.run_updates(stream, ["user_id", "window_start"])
    hour = F.floor(F.unix_micros("window_start") / 3_600_000_000).cast("long")
    return done.select("user_id", hour.alias("window_no"), "requests", "allowed")


PROGRESS = "CASE event_type WHEN 'view' THEN 'page' WHEN 'error' THEN 'error' ELSE 'progress' END"


@query("t2_crawl_progress", f"""SELECT user_id AS job_id, count(*) FILTER (event_type = 'view') AS pages, count(*) FILTER (event_type = 'error') AS errors, count(*) AS events FROM events GROUP BY 1""")
def t2_crawl_progress(t):
    events = T.replay(t.events, _batch(t)("event_id")).select(
        F.col("user_id").alias("job_id"), F.expr(PROGRESS).alias("kind"), "ts"
    )
    return T.run_updates(T.crawl_progress(events, "job_id", "kind"), ["job_id"])


_k = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"
RESEARCH = f"""SELECT user_id AS run_id, event_id AS seq, type, CASE type
 WHEN 'status' THEN '{{"state":"s' || k || '"}}' WHEN 'research_plan' THEN '{{"strategy":"st' || k || '","queries":["a","b"]}}'
 WHEN 'research_pass' THEN '{{"pass":' || (k % 5) || ',"total_passes":5}}' WHEN 'source_scraped' THEN '{{"url":"u' || (k % 12) || '","title":"t"}}'
 WHEN 'sources_pending' THEN '{{"sources":[{{"url":"u' || (k % 12) || '","title":"x"}},{{"url":"u' || (k % 7) || '"}},{{"title":"none"}}]}}'
 WHEN 'sources' THEN '{{"sources":["u' || (k % 12) || '",{{"url":"w' || (k % 3) || '"}}]}}'
 WHEN 'done' THEN '{{"sources":["d' || (k % 4) || '"]}}' ELSE '{{"content":"e' || k || '"}}' END AS payload
FROM (SELECT user_id, event_id, k, CASE event_type WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 'status' ELSE 'research_plan' END
 WHEN 'view' THEN 'source_scraped' WHEN 'click' THEN CASE WHEN k % 3 = 0 THEN 'research_pass' ELSE 'sources_pending' END
 WHEN 'purchase' THEN CASE WHEN k % 4 = 0 THEN 'done' ELSE 'sources' END ELSE 'error' END AS type
 FROM (SELECT user_id, event_id, event_type, {_k} AS k FROM {{events}}) e) x"""
RESEARCH_SQL = f"WITH r AS ({RESEARCH})"


def _research(t):
    return J.read_research_events(t.sql(RESEARCH))


STATE_SQL = RESEARCH_SQL + """, s AS (SELECT run_id, arg_max(CASE type WHEN 'status' THEN payload->>'$.state' WHEN 'done' THEN 'completed' ELSE 'failed' END, seq) FILTER (type IN ('status', 'done', 'error')) AS status,
 arg_max(payload->>'$.strategy', seq) FILTER (type = 'research_plan') AS strategy,
 arg_max(CAST(payload->>'$.pass' AS INT), seq) FILTER (type = 'research_pass') AS pass_number, arg_max(CAST(payload->>'$.total_passes' AS INT), seq) FILTER (type = 'research_pass') AS total_passes,
 arg_max(type, seq) FILTER (type IN ('done', 'error')) AS last_end, arg_max(payload->>'$.content', seq) FILTER (type = 'error') AS err FROM r GROUP BY 1)
SELECT run_id, status, strategy, pass_number, total_passes, coalesce(last_end = 'done', false) AS completed, CASE WHEN last_end = 'error' THEN err END AS error FROM s"""


@query("t3_research_state", STATE_SQL)
def t3_research_state(t):
    return J.fold_research_events(_research(t))


_src = """x AS (SELECT run_id, seq, type, 0 AS i, payload->>'$.url' AS url FROM r WHERE type = 'source_scraped' UNION ALL
 SELECT run_id, seq, type, i, CASE WHEN json_type(s) = 'VARCHAR' THEN s->>'$' ELSE s->>'$.url' END FROM (SELECT run_id, seq, type, unnest(json_extract(payload, '$.sources[*]')) AS s,
  generate_subscripts(json_extract(payload, '$.sources[*]'), 1) AS i FROM r WHERE type IN ('sources', 'done', 'sources_pending')))"""


SOURCES_SQL = RESEARCH_SQL + f", {_src} SELECT run_id, url, min(seq) AS first_seq FROM x WHERE type <> 'sources_pending' AND url IS NOT NULL GROUP BY 1, 2"


@query("t3_research_sources", SOURCES_SQL)
def t3_research_sources(t):
    return J.research_source_urls(_research(t))


PENDING_SQL = RESEARCH_SQL + f""", {_src}, l AS (SELECT run_id, max(seq) AS since, arg_max(type, seq) AS type FROM r WHERE type IN ('sources_pending', 'sources', 'done') GROUP BY 1),
p AS (SELECT x.run_id, l.since, x.url FROM x JOIN l ON x.run_id = l.run_id AND x.seq = l.since WHERE l.type = 'sources_pending' AND x.url IS NOT NULL)
SELECT run_id, url FROM p WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.run_id = p.run_id AND x.url = p.url AND x.type = 'source_scraped' AND x.seq > p.since)"""


@query("t3_research_pending", PENDING_SQL)
def t3_research_pending(t):
    return J.research_pending(_research(t))


def _research_stream(t):
    """(states, sources) of the research events, replayed in four micro-batches."""
    events = t.sql(RESEARCH).join(t.events.select(F.col("event_id").alias("seq"), "ts"), "seq")
    stream = J.read_research_events(T.replay(events, _batch(t)("seq")))
    return T.run_research(T.research_state(stream))


@query("t3_research_state_stream", STATE_SQL)
def t3_research_state_stream(t):
    return _research_stream(t)[0].drop("pending")


@query("t3_research_pending_stream", PENDING_SQL.replace("SELECT run_id, url FROM p", "SELECT DISTINCT run_id, url FROM p"))
def t3_research_pending_stream(t):
    return _research_stream(t)[0].select("run_id", F.explode("pending").alias("url"))


@query("t3_research_sources_stream", SOURCES_SQL)
def t3_research_sources_stream(t):
    return _research_stream(t)[1].where("url <> ''")


JOBS = "CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'page' ELSE 'page_done' END"
STATUS_SQL = """SELECT user_id AS job_id, coalesce(arg_min(CASE event_type WHEN 'purchase' THEN 'completed' ELSE 'failed' END, (ts, event_id)) FILTER (event_type IN ('purchase', 'error')), 'processing') AS status FROM events GROUP BY 1"""


def _job_events(df):
    return df.select(F.col("user_id").alias("job_id"), "event_id", "ts", F.expr(JOBS).alias("event"))


@query("t4_job_status", STATUS_SQL)
def t4_job_status(t):
    return J.job_status(_job_events(t.events), "job_id", ["ts", "event_id"])


@query("t4_job_status_stream", STATUS_SQL)
def t4_job_status_stream(t):
    events = _job_events(T.replay(t.events, _batch(t)("event_id")))
    return T.run_updates(T.job_status(events, "job_id"), ["job_id"])


@query("t5_job_counters", """WITH c AS (SELECT user_id AS job_id, count(*) FILTER (event_type = 'click') AS completed, count(*) FILTER (event_type = 'view') AS pages,
 min(epoch_us(ts) // 1000) FILTER (event_type = 'purchase') - min(epoch_us(ts) // 1000) FILTER (event_type = 'signup') AS duration_ms FROM events GROUP BY 1)
SELECT *, CASE WHEN completed > 0 THEN completed ELSE pages END AS credits FROM c""")
def t5_job_counters(t):
    events = _job_events(t.events).withColumn("ms", ordered.epoch_ms(F.col("ts")))
    return J.job_counters(events, "job_id", "ms")


@query("t6_new_urls_stream", """SELECT DISTINCT user_id, event_type FROM events""")
def t6_new_urls_stream(t):
    events = T.replay(t.events.select("user_id", "event_type", "ts", "event_id"), _batch(t)("event_id"))
    return T.run_appends(T.new_urls(events, ["user_id", "event_type"], 400 * 86400)).select("user_id", "event_type")


@query("t6_seen_expiry_stream", f"""WITH RECURSIVE r AS (SELECT user_id, event_type, epoch_us(ts) / 1000000.0::DOUBLE AS seconds FROM events),
w AS (SELECT user_id, event_type, min(seconds) AS a FROM r GROUP BY 1, 2 UNION ALL
 SELECT w.user_id, w.event_type, min(r.seconds) FROM w JOIN r ON r.user_id = w.user_id AND r.event_type = w.event_type AND r.seconds >= w.a + {5 * 86400} GROUP BY 1, 2, w.a)
SELECT user_id, event_type, CAST(round(a * 1000000) AS BIGINT) AS seen_us FROM w""")
def t6_seen_expiry_stream(t):
    """A key is new again five days after it was last new."""
    events = T.replay(t.events.select("user_id", "event_type", "ts", "event_id"), _batch(t)("event_id"))
    seen = T.run_appends(T.new_urls(events, ["user_id", "event_type"], 5 * 86400))
    return seen.select("user_id", "event_type", F.round(F.col("seconds") * 1_000_000).cast("long").alias("seen_us"))


T7 = "SELECT event_type AS name, event_id, CAST(event_id * 2 AS DOUBLE) AS seconds FROM {events}"


T7_SQL = f"""WITH RECURSIVE r AS ({T7}), w AS (SELECT name, min(seconds) AS a FROM r GROUP BY 1 UNION ALL
 SELECT w.name, min(r.seconds) FROM w JOIN r ON r.name = w.name AND r.seconds >= w.a + 600 GROUP BY 1)
SELECT r.name, w.a AS started, count(*) AS value FROM r ASOF JOIN w ON r.name = w.name AND r.seconds >= w.a GROUP BY 1, 2"""


@query("t7_counters", T7_SQL)
def t7_counters(t):
    return J.counters(t.sql(T7), "name", "seconds", "event_id", 600)


@query("t7_counters_stream", T7_SQL)
def t7_counters_stream(t):
    events = T.replay(t.events, _batch(t)("event_id")).select(
        F.col("event_type").alias("name"), (F.col("event_id") * 2).cast("double").alias("seconds")
    )
    return T.run_updates(T.running_counters(events, 600), ["name", "started"])


GAP = 6 * 3600
SESSIONS_SQL = f"""WITH l AS (SELECT user_id, event_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR us - p >= {GAP * 1000000} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session_no FROM l)"""


@query("t8_sessionize", SESSIONS_SQL + " SELECT user_id, session_no, count(*) AS steps, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY 1, 2")
def t8_sessionize(t):
    return J.session_windows(_events(t).select("user_id", "us", "event_id"), "user_id", "us", "event_id", GAP)


@query("t8_sessions_stream", SESSIONS_SQL + f""", g AS (SELECT user_id, session_no, count(*) AS steps, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY 1, 2)
SELECT user_id, first_us, steps FROM g WHERE last_us + {GAP * 1000000} <= ((SELECT max(us) FROM s) // 1000) * 1000 - 600000000""")
def t8_sessions_stream(t):
    stream = T.sessions(T.read_stream(t.spark, t.folder, "events"), "user_id", f"{GAP} seconds")
    return T.run_appends(stream).select("user_id", F.unix_micros("session_start").alias("first_us"), "steps")


@query("t9_watermark", "SELECT event_type, count(*) AS rows FROM events GROUP BY 1")
def t9_watermark(t):
    """Rows in order are never late: the watermarked stream keeps all of them."""
    events = T.read_stream(t.spark, t.folder, "events").withWatermark("ts", T.WATERMARK)
    counted = events.groupBy("event_type").agg(F.count("*").alias("rows"))
    return T.run_updates(counted, ["event_type"])


# Every fiftieth event of the first batch comes with the last one. A batch is held
# against the watermark of all batches but the one before it.
LATE = "CASE WHEN event_id % 50 = 7 AND event_id * 4 // (top + 1) = 0 THEN 3 ELSE event_id * 4 // (top + 1) END"


@query("t9_late_rows", f"""WITH e AS (SELECT event_type, epoch_us(ts) AS us, {LATE} AS b FROM events, (SELECT max(event_id) AS top FROM events)),
m AS (SELECT a.b, max(e.us) // 1000 * 1000 - 600000000 AS mark FROM (SELECT DISTINCT b FROM e) a LEFT JOIN e ON e.b <= a.b - 2 GROUP BY 1)
SELECT event_type, us // 3600000000 AS window_no, count(*) AS rows FROM e JOIN m USING (b) WHERE mark IS NULL OR (us // 3600000000 + 1) * 3600000000 > mark GROUP BY 1, 2""")
def t9_late_rows(t):
    """Rows whose window closed before they came are dropped, and only those."""
    number = _batch(t)("event_id")
    late = F.when((F.col("event_id") % 50 == 7) & (number == 0), 3).otherwise(number)
    events = T.replay(t.events.select("event_id", "event_type", "ts"), late).withWatermark("ts", T.WATERMARK)
    counted = events.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("rows"))
    hour = F.floor(F.unix_micros("w.start") / 3_600_000_000).cast("long")
    done = T.run_updates(counted.select("event_type", hour.alias("window_no"), "rows"), ["event_type", "window_no"])
    return done


@query("t10_search_budget", """SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 5 AS accepted FROM events""")
def t10_search_budget(t):
    return J.search_budget(_events(t).select("event_id", "user_id", "us"), "user_id", "us", "event_id", 5).drop("us")


@query("p4_politeness_stream", """WITH RECURSIVE r AS (SELECT event_id AS request_id, 'h' || (user_id % 3) AS domain, CAST(event_id AS DOUBLE) AS seconds FROM events),
w AS (SELECT domain, min(seconds) AS a FROM r GROUP BY 1 UNION ALL SELECT w.domain, min(r.seconds) FROM w JOIN r ON r.domain = w.domain AND r.seconds >= w.a + 7.0 GROUP BY 1)
SELECT request_id, domain, CASE WHEN (domain, seconds) IN (SELECT (domain, a) FROM w) THEN 'proceed' ELSE 'delay' END AS action FROM r""")
def p4_politeness_stream(t):
    requests = T.replay(t.events, _batch(t)("event_id")).select(
        F.col("event_id").alias("request_id"), F.concat(F.lit("h"), F.col("user_id") % 3).alias("domain"),
        F.col("event_id").cast("double").alias("seconds"), F.lit(7.0).alias("crawl_delay"),
    )
    return T.run_appends(T.politeness(requests))


# ------------------------------------------------------------------ metrics

BUCKETS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0]


@query("a1_counter", "SELECT event_type, user_id % 10 AS shard, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def a1_counter(t):
    events = t.events.withColumn("shard", F.col("user_id") % 10)
    return X.counter(events, ["event_type", "shard"], F.col("value")).withColumn("value", F.round("value", 4))


@query("a2_histogram", f"""WITH b AS (SELECT unnest([{', '.join(map(str, BUCKETS))}, 'Infinity'::DOUBLE]) AS le)
SELECT event_type, CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(le AS VARCHAR) END AS le, count(*) FILTER (value <= le) AS cumulative, count(*) AS total_count, round(sum(value), 4) AS total_sum FROM events, b GROUP BY event_type, b.le""")
def a2_histogram(t):
    h = X.histogram(t.events, ["event_type"], "value", BUCKETS)
    le = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string"))
    return h.withColumn("le", le).withColumn("total_sum", F.round("total_sum", 4))


@query("a3_gauge", "SELECT event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def a3_gauge(t):
    return X.gauge(t.events, ["event_type"], "value", ["ts", "event_id"])


def _hq(q):
    cases = []
    for i, b in enumerate(BUCKETS):
        below = f"c{i - 1}" if i else "0"
        low = BUCKETS[i - 1] if i else 0.0
        cases.append(f"WHEN c{i} >= {q} * n THEN CASE WHEN c{i} > {below} THEN {low}::DOUBLE + {b - low}::DOUBLE * ({q}::DOUBLE * n - {below}) / (c{i} - {below}) ELSE {low} END")
    return f"round(CASE {' '.join(cases)} ELSE {BUCKETS[-1]} END, 6) AS p{int(q * 100)}"


@query("a4_latency_quantiles", f"""WITH c AS (SELECT event_type, count(*) AS n, {', '.join(f'count(*) FILTER (value <= {b}) AS c{i}' for i, b in enumerate(BUCKETS))} FROM events GROUP BY 1)
SELECT event_type, {_hq(0.5)}, {_hq(0.95)}, {_hq(0.99)} FROM c""")
def a4_latency_quantiles(t):
    return X.histogram_quantiles(t.events, ["event_type"], "value", BUCKETS)


@query("a4_approx_quantiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def a4_approx_quantiles(t):
    return X.approx_quantiles(t.events, ["event_type"], "value")


A5_SQL = """WITH m AS (SELECT event_type, epoch_us(ts) // 60000000 AS m, count(*) AS n FROM events GROUP BY 1, 2),
s AS (SELECT event_type, m + k AS minute, sum(n) / 300.0::DOUBLE AS rate FROM m, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY 1, 2),
h AS (SELECT *, minute - row_number() OVER (PARTITION BY event_type ORDER BY minute) AS run FROM s WHERE rate > 0.005)
SELECT event_type, min(minute) AS started, max(minute) AS ended, count(*) AS minutes FROM h GROUP BY event_type, run HAVING count(*) >= 5"""


@query("a5_error_rate_alerts", A5_SQL)
def a5_error_rate_alerts(t):
    return X.error_rate_alerts(_events(t), "event_type", "us", threshold=0.005)


@query("a6_threshold_alerts", """WITH s AS (SELECT event_type, event_id, epoch_us(ts) AS us, value > 20 AS bad, sum(CASE WHEN value > 20 THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS run FROM events),
b AS (SELECT *, min(us) OVER (PARTITION BY event_type, run) AS started_us FROM s WHERE bad)
SELECT event_type, started_us, min(us) FILTER (us - started_us >= 300000000) AS fired_us, count(*) AS samples FROM b GROUP BY event_type, run, started_us HAVING max(us) - started_us >= 300000000""")
def a6_threshold_alerts(t):
    events = _events(t).select("event_type", "us", "event_id", "value")
    return X.threshold_alerts(events, "event_type", "us", "event_id", F.col("value") > 20, 300)


JOB_TABLE = """SELECT event_id AS id, CASE event_type WHEN 'signup' THEN 'crawl' WHEN 'view' THEN 'scrape' ELSE 'agent' END AS kind, CASE event_id % 3 WHEN 0 THEN 'processing' WHEN 1 THEN 'completed' ELSE 'failed' END AS status, value FROM {events}"""


@query("a7_active_jobs", f"SELECT id, kind FROM ({JOB_TABLE}) WHERE status = 'processing' AND kind = 'crawl' ORDER BY id LIMIT 50")
def a7_active_jobs(t):
    return J.active_jobs(t.sql(JOB_TABLE), ["id"], kind="crawl").select("id", "kind")


@query("a8_count_active", f"SELECT count(*) AS active FROM ({JOB_TABLE}) WHERE status = 'processing'")
def a8_count_active(t):
    return J.count_active(t.sql(JOB_TABLE))


@query("a9_job_metrics", f"""WITH b AS (SELECT unnest([{', '.join(map(str, BUCKETS))}, 'Infinity'::DOUBLE]) AS le)
SELECT kind, status, CASE WHEN isinf(le) THEN '+Inf' ELSE CAST(le AS VARCHAR) END AS le, count(*) FILTER (value <= le) AS cumulative, count(*) AS total_count FROM ({JOB_TABLE}), b WHERE status <> 'processing' GROUP BY kind, status, b.le""")
def a9_job_metrics(t):
    ended = t.sql(JOB_TABLE).where("status <> 'processing'")
    h = X.histogram(ended, ["kind", "status"], "value", BUCKETS).drop("total_sum")
    return h.withColumn("le", F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string")))


@query("a10_mean_latency", "SELECT event_type, epoch_us(ts) // 3600000000 AS window_no, round(sum(value) / count(value), 6) AS mean FROM events GROUP BY 1, 2")
def a10_mean_latency(t):
    return X.mean_latency(_events(t), "event_type", "us", "value")


@query("a11_site_summary", f"""SELECT {A.host('url')} AS host, CASE page_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'dedup' ELSE 'page' END AS kind, count(*) AS rows FROM pages GROUP BY ROLLUP (1, 2)""")
def a11_site_summary(t):
    from webstrata.operators.graph import site_summary

    rows = t.pages.select(
        U.hostname(F.col("url")).alias("host"),
        F.expr("CASE page_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'dedup' ELSE 'page' END").alias("kind"),
    )
    return site_summary(rows, "host", "kind")


@query("a12_distinct_urls", f"SELECT {A.host('url')} AS host, count(DISTINCT {A.normalize('url')}) AS distinct_values, true AS approx_close FROM pages GROUP BY 1")
def a12_distinct_urls(t):
    rows = t.pages.select(U.hostname(F.col("url")).alias("host"), U.normalize_url(F.col("url")).alias("key"))
    exact = X.distinct_counts(rows, "host", "key")
    approx = X.distinct_counts(rows, "host", "key", approximate=True).withColumnRenamed("distinct_values", "approx")
    close = F.abs(F.col("approx") - F.col("distinct_values")) <= F.greatest(F.lit(1), F.col("distinct_values") * 0.1)
    return exact.join(approx, "host").select("host", "distinct_values", close.alias("approx_close"))
