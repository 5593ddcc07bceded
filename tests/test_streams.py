"""Streams over several micro-batches: late rows, state that ends, equality with the batch query."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from webstrata.operators import jobs as J
from webstrata.operators import robots as R
from webstrata.streaming import streams as T

UTC = dt.timezone.utc


def at(minutes):
    return dt.datetime(2024, 1, 1, tzinfo=UTC) + dt.timedelta(minutes=minutes)


def events(spark, rows):
    """(event_id, key, minutes, batch) as a table with ts."""
    return spark.createDataFrame([(i, k, at(m), b) for i, k, m, b in rows], "event_id long, k string, ts timestamp, b int")


def held(spark, path, variable="value"):
    rows = spark.read.format("statestore").option("stateVarName", variable).load(path)
    return sorted(r[0] for r in rows.select("key.*").collect())


def run_with_state(stream, path, mode="update"):
    def ignore(batch, number):
        batch.count()

    T._run(stream.writeStream.outputMode(mode).foreachBatch(ignore).option("checkpointLocation", str(path)))


def test_rate_limit_over_batches_equals_the_batch(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), i * 0.7, i // 60) for i in range(240)]
    df = events(spark, rows)
    got = T.run_appends(T.rate_limit(T.replay(df.drop("b"), F.floor(F.col("event_id") / 60)), "k", 3, 600))
    want = J.rate_limit(df.withColumn("us", F.unix_micros("ts")), "k", "us", "event_id", 3, 600)
    columns = ["event_id", "k", "window_no", "allowed", "remaining"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_late_events_get_no_verdict(spark):
    # The last batch brings one event behind the watermark and one within it.
    rows = [(1, "a", 0, 0), (2, "a", 300, 1), (3, "a", 600, 2), (4, "a", 100, 3), (5, "a", 595, 3), (6, "a", 601, 3)]
    df = events(spark, rows)
    got = T.run_appends(T.rate_limit(T.replay(df, F.col("b")), "k", 5, 600))
    assert sorted(r["event_id"] for r in got.collect()) == [1, 2, 3, 5, 6]


@pytest.mark.parametrize("kind", ["jobs", "totals", "research", "pacing", "limit"])
def test_state_ends(spark, tmp_path, kind):
    """Keys seen ten days ago are gone from the state store, the last one is still there."""
    day = 1440
    rows = [(1, "1", 0, 0), (2, "2", 10 * day, 1), (3, "3", 20 * day, 2), (4, "3", 20 * day + 5, 3)]
    df = events(spark, rows).withColumn("id", F.col("k").cast("long"))
    stream = T.replay(df, F.col("b"))
    if kind == "jobs":
        out = T.job_status(stream.withColumn("event", F.lit("completed")), "id", retention=86400)
    elif kind == "totals":
        out = T.crawl_progress(stream.withColumn("kind", F.lit("page")), "id", "kind", retention=86400)
    elif kind == "limit":
        out = T.rate_limit(stream, "id", 2, 3600)
    elif kind == "pacing":
        out = T.politeness(stream.select(
            F.col("k").alias("domain"), F.col("event_id").alias("request_id"),
            F.unix_seconds("ts").cast("double").alias("seconds"), F.lit(3600.0).alias("crawl_delay"),
        ))
    else:
        parsed = J.read_research_events(stream.select(
            F.col("id").alias("run_id"), F.col("event_id").alias("seq"), F.lit("source_scraped").alias("type"), "ts",
            F.concat(F.lit('{"url":"u'), "k", F.lit('"}')).alias("payload"),
        ))
        out = T.research_state(parsed, retention=86400)
    mode = "update" if kind in ("jobs", "totals") else "append"
    run_with_state(out, tmp_path / "state", mode)
    assert [str(k) for k in held(spark, str(tmp_path / "state"))] == ["3"]
    if kind == "research":
        assert [str(k) for k in held(spark, str(tmp_path / "state"), "named")] == ["3"]


def test_first_sights_return_after_their_lifetime(spark):
    rows = [(1, "a", 0, 0), (2, "a", 30, 0), (3, "b", 40, 1), (4, "a", 59, 1), (5, "a", 60, 2), (6, "a", 200, 3), (7, "b", 201, 3)]
    got = T.run_appends(T.new_urls(T.replay(events(spark, rows), F.col("b")), ["k"], 3600))
    start = at(0).timestamp()
    assert sorted((r["k"], (r["seconds"] - start) / 60) for r in got.collect()) == [
        ("a", 0), ("a", 60), ("a", 200), ("b", 40), ("b", 201),
    ]


def sights(rows, ttl):
    """(key, seconds) of rows (key, seconds, batch): a lifetime begins with the first row that none covers."""
    out, began = [], {}
    for _, key, at in sorted((b, k, s) for k, s, b in rows):
        if key not in began or at >= began[key] + ttl:
            began[key] = at
            out.append((key, at))
    return sorted(out)


@pytest.mark.parametrize("few", [0, 16])
def test_first_sights_take_many_keys_with_a_call(few):
    """The calls do not grow with the keys, and state is read and written once for all keys of a call."""
    import pandas as pd

    from webstrata.streaming import state

    class Clock:
        def getCurrentWatermarkInMs(self):
            return 0

    class Handle:
        value, timers, writes = None, set(), 0

        def getValueState(self, name, schema):
            return self

        def get(self):
            return self.value

        def update(self, value):
            self.value, self.writes = value, self.writes + 1

        def clear(self):
            self.value = None

        def registerTimer(self, at):
            self.timers = self.timers | {at}

        def deleteTimer(self, at):
            self.timers = self.timers - {at}

    rng = random.Random(11)
    rows = [(f'{{"k0":"{rng.randrange(150)}"}}', float(rng.randrange(b * 500, b * 500 + 500)), b) for b in range(3) for _ in range(900)]
    seen = state.FirstSights(120.0)
    seen.FEW = few
    handle = Handle()
    seen.init(handle)
    got = []
    for b in range(3):
        frame = pd.DataFrame([(k, s) for k, s, own in rows if own == b], columns=["key", "seconds"])
        for out in seen.handleInputRows((1,), iter([frame[:400], frame[400:]]), Clock()):
            got += list(out.itertuples(index=False, name=None))
    assert sorted(got) == sights(rows, 120.0)
    assert handle.writes == 3 and len(handle.timers) == 1


def test_first_sights_of_odd_keys(spark):
    """NULL, NaN, zeros, long numbers and instants of different batches are the keys that grouping sees, and come back unchanged."""
    odd = [
        (2**53 + 1, "a\nb", 0.0, at(0.00001)), (2**53, "a\nb", -0.0, at(0.00001)), (2**53 + 1, "a\nb", -0.0, at(0.00001)),
        (None, None, None, None), (None, "null", float("nan"), None), (7, "", 1e300, at(0.00002)), (7, "\"é\\", 0.1, None),
    ]
    rows = [(*k, at(m), b) for b, m in enumerate((0, 30, 70)) for k in odd]
    df = spark.createDataFrame(rows, "id long, k string, x double, t timestamp, ts timestamp, b int")
    got = T.run_appends(T.new_urls(T.replay(df, F.col("b")), ["id", "k", "x", "t"], 3600)).collect()
    distinct = {str(tuple(r)) for r in df.select("id", "k", F.col("x") + 0.0, "t").distinct().collect()}
    assert len(distinct) == 6 and {str(tuple(r)[:4]) for r in got} == distinct and len(got) == 12


def test_first_sights_of_rows_without_a_time(spark):
    """Rows without a time are no sights, also where a whole call has no others."""
    rows = [("a", None, 0), ("b", None, 0), ("b", at(1), 0), ("c", None, 1), ("b", at(70), 1), ("a", at(71), 1)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, b int")
    got = T.run_appends(T.new_urls(T.replay(df, F.col("b")), ["k"], 3600)).collect()
    start = at(0).timestamp()
    assert sorted((r["k"], (r["seconds"] - start) / 60) for r in got) == [("a", 71), ("b", 1), ("b", 70)]


def test_first_sights_end_in_the_state(spark, tmp_path):
    """Keys leave the state at the end of their lifetime, others of the same bucket stay."""
    day = 1440
    rows = [(i, f"k{i}", 0, 0) for i in range(40)] + [(50, "k50", 10 * day, 1), (51, "k51", 10 * day + 30, 2), (52, "k52", 10 * day + 50, 3)]
    before = T.KEY_BUCKETS
    try:
        T.KEY_BUCKETS = 2
        run_with_state(T.new_urls(T.replay(events(spark, rows), F.col("b")), ["k"], 3600), tmp_path / "state", "append")
    finally:
        T.KEY_BUCKETS = before
    left = spark.read.format("statestore").option("stateVarName", "value").load(str(tmp_path / "state"))
    names = [bytes(r[0]).decode() for r in left.select("value.keys").collect()]
    assert sorted(x for n in names for x in n.split("\n")) == ['{"k0":"k50"}', '{"k0":"k51"}', '{"k0":"k52"}']


def test_pacing_over_batches_equals_the_audit(spark):
    rng = random.Random(3)
    rows = [(i, f"d{rng.randrange(3)}", i * 0.4) for i in range(400)]
    df = spark.createDataFrame([(i, d, s, at(s), 5.0) for i, d, s in rows], "request_id long, domain string, seconds double, ts timestamp, crawl_delay double")
    got = T.run_appends(T.politeness(T.replay(df, F.floor(F.col("request_id") / 50))))
    want = R.politeness_audit(df.drop("ts"))
    columns = ["domain", "request_id", "action"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_research_over_batches(spark):
    payloads = [
        ("status", '{"state":"started"}'), ("research_plan", '{"strategy":"wide"}'),
        ("research_pass", '{"pass":1,"total_passes":3}'), ("sources_pending", '{"sources":[{"url":"u1"},{"url":"u2"},{"title":"none"}]}'),
        ("source_scraped", '{"url":"u1","title":"t"}'), ("sources", '{"sources":["u1",{"url":"u3"}]}'),
        ("sources_pending", '{"sources":["u4","u5"]}'), ("source_scraped", '{"url":"u5"}'), ("error", '{"content":"x"}'),
    ]
    df = spark.createDataFrame([(7, i, k, p, at(i)) for i, (k, p) in enumerate(payloads)], "run_id long, seq long, type string, payload string, ts timestamp")
    for size in (1, 3, 9):
        stream = J.read_research_events(T.replay(df, F.floor(F.col("seq") / size)))
        states, sources = T.run_research(T.research_state(stream))
        (row,) = states.collect()
        assert row.asDict() == {
            "run_id": 7, "status": "failed", "strategy": "wide", "pass_number": 1, "total_passes": 3,
            "completed": False, "error": "x", "pending": ["u4"],
        }
        assert sorted((r["url"], r["first_seq"]) for r in sources.collect()) == [("u1", 4), ("u3", 5), ("u5", 7)]


def test_replay_deals_a_batch_to_many_files(spark, monkeypatch):
    """Batches of several files, some of them empty, still come batch by batch, each in order."""
    monkeypatch.setattr(T, "FILE_ROWS", 50)
    rng = random.Random(7)
    rows = [(i, rng.choice("abc"), i * 0.7, 0 if i < 200 else 1 if i < 203 else 2) for i in range(300)]
    df = events(spark, rows)
    stream = T.replay(df, F.col("b"))
    counts = []
    T._run(stream.writeStream.foreachBatch(lambda batch, n: counts.append(batch.count())))
    assert counts == [200, 3, 97]
    got = T.run_appends(T.rate_limit(T.replay(df.drop("b"), F.floor(F.col("event_id") / 100)), "k", 3, 600))
    want = J.rate_limit(df.withColumn("us", F.unix_micros("ts")), "k", "us", "event_id", 3, 600)
    columns = ["event_id", "k", "window_no", "allowed", "remaining"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_empty_stream(spark):
    empty = events(spark, []).select("event_id", "k", "ts")
    stream = T.replay(empty.unionByName(events(spark, [(1, "a", 0, 0)]).select("event_id", "k", "ts")), F.lit(0))
    assert T.run_appends(T.rate_limit(stream, "k", 1, 60)).count() == 1
