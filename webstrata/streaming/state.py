"""Keyed state with event-time timers for the streaming twins.

Every processor keeps one small value per key and a time at which it stops to
matter; a timer at that time removes it, so state does not outlive its use. Where
the rule itself ends (a pause has passed, a window or lifetime is over) removal
changes no result; jobs and runs are kept for a retention after their end.
Rows of a key in one micro-batch are taken together and in order. With many keys
the calls per key decide, so a processor works on plain rows, reads its state once
and writes it once; ``FirstSights`` takes a bucket of keys with each call.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_left
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: the state store that keyed state with timers needs.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Seconds added to clocks that start at 0, as event time: time 0 is the first watermark and would be late.
ORIGIN = 86_400.0


class Timed(StatefulProcessor):
    """A value per key (``SCHEMA``, whose last field ``until`` is in milliseconds) that ends at ``until``.

    ``outputs`` gives the values of the result's ``columns`` for the rows of a key.
    """

    SCHEMA = "until long"
    columns: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        named = Row(*self.columns)
        return iter([named(*out) for out in self.outputs(key, rows, timerValues)])

    def stored(self) -> tuple | None:
        value = self.value.get()
        return None if value is None else tuple(value)[:-1]

    def store(self, value: tuple, until: float, timer_values) -> None:
        """Keep ``value`` up to ``until``; one that is over already is not kept."""
        end = math.ceil(until)
        if end <= timer_values.getCurrentWatermarkInMs():
            self.clear()
            return
        self.value.update((*value, end))
        self.handle.registerTimer(end)

    def keep(self, value: tuple, last: float | None, retention: float, timer_values) -> None:
        """Keep ``value`` for ``retention`` seconds after ``last``; rows without a time count as of the watermark."""
        last = timer_values.getCurrentWatermarkInMs() / 1000 if last is None else last
        self.store(value, (last + retention) * 1000, timer_values)

    def clear(self) -> None:
        self.value.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # A value that was extended since has a later timer of its own.
        value = self.value.get()
        if value is not None and value[-1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.clear()
        return iter(())

    def close(self) -> None:
        pass


def _late(seconds: float | None) -> tuple[bool, float | None]:
    """Sorts rows without a time behind the others."""
    return (seconds is None, seconds)


def _times(rows) -> list[float]:
    return sorted(float(r["seconds"]) for r in rows if r["seconds"] is not None)


class RateLimit(Timed):
    """Verdict per event: fixed windows, counted in order."""

    SCHEMA = "windows array<long>, counts array<long>, until long"

    def __init__(self, key: str, limit: int, seconds: int):
        self.key, self.limit, self.length = key, limit, seconds * 1_000_000

    def outputs(self, key, rows, timerValues):
        known = self.stored() or ((), ())
        counts = dict(zip(known[0], known[1], strict=True))
        out = []
        for us, event in sorted((r["us"], r["event_id"]) for r in rows if r["us"] is not None):
            window = us // self.length
            place = counts[window] = counts.get(window, 0) + 1
            out.append((key[0], event, window, place <= self.limit, max(0, self.limit - place)))
        # Rows of a closed window are late and no longer come.
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        still = {w: n for w, n in counts.items() if (w + 1) * self.length > mark}
        if still:
            self.store((list(still), list(still.values())), (max(still) + 1) * self.length / 1000, timerValues)
        return out


class Pacing(Timed):
    """Admit or delay requests; the last admitted time matters for one delay."""

    SCHEMA = "last double, until long"

    def outputs(self, key, rows, timerValues):
        import numpy as np

        from webstrata.operators.robots import _admit

        own = sorted(((r["seconds"], r["request_id"], r["crawl_delay"]) for r in rows), key=itemgetter(0, 1))
        delay = float(own[0][2])
        known = self.stored()
        times = np.array([r[0] for r in own], float)
        _, admitted = _admit(times, delay, known[0] if known else np.nan)
        last = float(times[admitted][-1]) if admitted.any() else known[0]
        self.store((last,), (last + delay + ORIGIN) * 1000, timerValues)
        return [(key[0], r[1], "proceed" if a else "delay") for r, a in zip(own, admitted, strict=True)]


class Lifetimes(Timed):
    """Counters that live ``ttl`` seconds from their first increment and then start again."""

    SCHEMA = "started double, value long, until long"

    def __init__(self, ttl: float):
        self.ttl = ttl

    def lifetimes(self, rows, timer_values) -> list[tuple]:
        """(started, value) of every lifetime that these rows belong to."""
        times = _times(rows)
        known = self.stored()
        started, value = known or (None, 0)
        out, at = [], 0
        while at < len(times):  # one step per lifetime, not per row
            if started is None or times[at] >= started + self.ttl:
                started, value = times[at], 0
            stop = bisect_left(times, started + self.ttl)
            value, at = value + stop - at, stop
            out.append((started, value))
        if out:
            self.store((started, value), (started + self.ttl + ORIGIN) * 1000, timer_values)
        return out

    def outputs(self, key, rows, timerValues):
        return [(*key, *lifetime) for lifetime in self.lifetimes(rows, timerValues)]


class FirstSights(StatefulProcessor):
    """The rows that start a lifetime: first sight of a key, and again after ``ttl`` seconds.

    Takes many keys at a time: the group is a bucket of keys, its rows name theirs
    (``key``, without line breaks) and ``seconds``. The state of a bucket is one value,
    the keys that are alive with the times of their first sight, from which each key
    goes at the end of its lifetime, when a timer tells or with the next rows.
    """

    SCHEMA = "keys binary, started binary, until long"
    #: With no more keys than this left, they are followed one by one.
    FEW = 16

    def __init__(self, ttl: float):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.SCHEMA)

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        import pandas as pd

        parts = [p for p in ((r["key"].to_numpy(), r["seconds"].to_numpy(np.float64)) for r in rows) if len(p[0])]
        known, began, until = self._stored()
        names, codes = known, np.zeros(0, np.int64)
        seconds = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0)
        if parts:
            codes, names = pd.factorize(np.concatenate([known, *(p[0] for p in parts)]))
            codes = codes[len(known):]
        started = np.full(len(names), -np.inf)
        started[:len(known)] = began
        timed = ~np.isnan(seconds)
        of, at = self._sights(codes[timed], seconds[timed], started)
        self._keep(names, started, until, timerValues)
        yield pd.DataFrame({"key": names[of], "seconds": at})

    def _sights(self, codes, seconds, started):
        """(key, time) of new sights of keys (by number); ``started`` moves on to the last one of each."""
        import numpy as np

        order = np.lexsort((seconds, codes))
        codes, times = codes[order], seconds[order]
        keys, low = np.unique(codes, return_index=True)
        high = np.append(low, len(codes))[1:]
        of, at = [np.zeros(0, np.int64)], [np.zeros(0)]
        while len(keys) > self.FEW:
            # The first row of each key that its lifetime does not cover, by bisection.
            end, stop = started[keys] + self.ttl, high.copy()
            while (open_ := low < stop).any():
                middle = (low + stop) // 2
                covered = np.zeros(len(keys), bool)
                covered[open_] = times[middle[open_]] < end[open_]
                low = np.where(open_ & covered, middle + 1, low)
                stop = np.where(open_ & ~covered, middle, stop)
            left = low < high
            keys, low, high = keys[left], low[left], high[left]
            started[keys] = times[low]
            of.append(keys)
            at.append(times[low])
        for key, first, last in zip(keys.tolist(), low.tolist(), high.tolist(), strict=True):
            own = times[first:last].tolist()
            found, place = [], bisect_left(own, started[key] + self.ttl)
            while place < len(own):
                found.append(own[place])
                place = bisect_left(own, own[place] + self.ttl, place)
            if found:
                started[key] = found[-1]
                of.append(np.full(len(found), key))
                at.append(np.array(found))
        return np.concatenate(of), np.concatenate(at)

    def _stored(self):
        """(keys, their first sights, end of the first lifetime to end)."""
        import numpy as np

        value = self.value.get()
        if value is None:
            return np.zeros(0, object), np.zeros(0), None
        return np.array(bytes(value[0]).decode().split("\n"), object), np.frombuffer(bytes(value[1]), np.float64), value[2]

    def _keep(self, names, started, until: int | None, timer_values) -> None:
        """Store the keys that are alive; ``until`` is the timer that stands."""
        import numpy as np

        ends = np.full(len(names), -np.inf)
        seen = started > -np.inf
        ends[seen] = np.ceil((started[seen] + self.ttl + ORIGIN) * 1000)
        alive = ends > timer_values.getCurrentWatermarkInMs()
        first = int(ends[alive].min()) if alive.any() else None
        if until is not None and until != first:
            self.handle.deleteTimer(until)
        if first is None:
            self.value.clear()
            return
        self.value.update(("\n".join(names[alive]).encode(), started[alive].tobytes(), first))
        if until != first:
            self.handle.registerTimer(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        names, started, until = self._stored()
        if until is not None and until <= expiredTimerInfo.getExpiryTimeInMs():
            # The timer that expired goes by itself.
            self._keep(names, started, None, timerValues)
        return iter(())

    def close(self) -> None:
        pass


class JobStatus(Timed):
    """Status of a job: the first terminal event decides; kept ``retention`` seconds after the last event."""

    SCHEMA = "status string, until long"

    def __init__(self, terminal: tuple[str, ...], retention: float):
        self.terminal, self.retention = terminal, retention

    def outputs(self, key, rows, timerValues):
        own = sorted(((_late(r["seconds"]), r["event_id"], r["event"]) for r in rows), key=itemgetter(0, 1))
        known = self.stored()
        status = known[0] if known else "processing"
        if status not in self.terminal:
            status = next((event for _, _, event in own if event in self.terminal), status)
        last = max((at for (_, at), _, _ in own if at is not None), default=None)
        self.keep((status,), last, self.retention, timerValues)
        return [(key[0], status)]


class Totals(Timed):
    """Running totals of 0/1 columns per job, kept ``retention`` seconds after the last event."""

    SCHEMA = "totals array<long>, until long"

    def __init__(self, added: tuple[str, ...], retention: float):
        self.added, self.retention = added, retention

    def outputs(self, key, rows, timerValues):
        known = self.stored()
        totals = list(known[0]) if known else [0] * len(self.added)
        last = None
        for r in rows:
            last = r["seconds"] if last is None else max(last, r["seconds"] or last)
            totals = [n + r[c] for n, c in zip(totals, self.added, strict=True)]
        self.keep((totals,), last, self.retention, timerValues)
        return [(key[0], *totals)]


class Research(Timed):
    """Projection of a research run: plan, pass, pending pages, sources, status.

    Yields one ``state`` row per run and micro-batch and one ``source`` row per
    page, when it is first named. A run is kept ``retention`` seconds after its
    last event; pages named are a map of their own, which gets one entry of new
    pages per micro-batch that names some.
    """

    SCHEMA = (
        "status string, strategy string, pass_number int, total_passes int, completed boolean, error string, "
        "pending array<string>, until long"
    )
    OUTPUT = (
        "run_id long, kind string, status string, strategy string, pass_number int, total_passes int, "
        "completed boolean, error string, pending array<string>, url string, first_seq long"
    )

    def __init__(self, retention: float):
        self.retention = retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.named = handle.getMapState("named", "first_seq long", "urls array<string>")

    def clear(self) -> None:
        super().clear()
        self.named.clear()

    def outputs(self, key, rows, timerValues):
        known = self.stored()
        status, strategy, number, total, done, error, pending = known or (None, None, None, None, False, None, [])
        # Pages waiting, the event that listed them last, and pages fetched after it.
        waiting, scraped, first, latest = list(pending or []), set(), {}, None
        for r in sorted(rows, key=itemgetter("seq")):
            kind = r["type"]
            latest = r["seconds"] if latest is None else max(latest, r["seconds"] or latest)
            if kind == "status":
                status = r["state"]
            elif kind == "research_plan":
                strategy = r["strategy"]
            elif kind == "research_pass":
                number, total = r["pass_no"], r["total_passes"]
            elif kind == "source_scraped":
                if r["url"] is not None:
                    scraped.add(r["url"])
                    first.setdefault(r["url"], r["seq"])
            elif kind in ("done", "error"):
                status = "completed" if kind == "done" else "failed"
                done, error = kind == "done", None if kind == "done" else r["content"] or ""
            if kind in ("sources_pending", "sources", "done"):
                urls = [u for u in _urls(r["sources"]) if u]
                waiting, scraped = urls if kind == "sources_pending" else [], set()
                if kind != "sources_pending":
                    for url in urls:
                        first.setdefault(url, r["seq"])
        pending = sorted(set(waiting) - scraped)
        value = (status, strategy, number, total, bool(done), error, pending)
        self.keep(value, latest, self.retention, timerValues)
        first.pop("", None)
        found = self._new_sources(first, known is not None)
        state = (key[0], "state", status, strategy, number, total, bool(done), error, pending, None, None)
        return [state, *((key[0], "source", *[None] * 7, url, seq) for url, seq in found.items())]

    def _new_sources(self, first: dict[str, int], known: bool) -> dict[str, int]:
        """Of pages and the events that name them, those named for the first time."""
        before = {url for (urls,) in self.named.values() for url in urls} if known and first else ()
        new = {u: s for u, s in first.items() if u not in before}
        if new:
            self.named.updateValue((next(iter(new.values())),), (list(new),))
        return new


def _urls(items) -> list[str | None]:
    """URL of each source, given as JSON text of an object or as plain text."""
    out = []
    for item in items or ():
        if item is not None and item.startswith("{"):
            value = json.loads(item).get("url")
            out.append(value if isinstance(value, str) else None)
        else:
            out.append(item)
    return out
