"""Keyed streams with a clock: quarantine, reorder, window close, late rows, completeness, absence.

The clock is the `arrived` column of the rows, never the wall clock, so a replay gives the same rows. A key's rows are taken in the
order of arrival; for a key without rows the stream's watermark over `arrived` is the clock, and timers fire behind it. Every state is
bounded as its function says, and goes when the clock has passed its last use by the time that is given. Rows without a key or an
arrival are left out, and so are rows that arrive more than `slack` out of order between micro-batches.

What waits in a state when a run ends is read from the run's state store: run_and_drain() turns it into rows.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from vantage.runtime import shared_dir
from vantage.streaming.ordered import in_order


def timed(rows: DataFrame, key: str, step: Callable, output: str, state: str, slack: str, order: list[str]) -> DataFrame:
    """rows.groupBy(key) with a state and timers over `arrived`.

    step(key, found, values, clock) takes a key, an iterator over its new rows, its state or None, and the watermark in ms; found has no
    rows when a timer fires. A key with many new rows is taken in pieces, one call each. It returns (output rows, new state or None, time of the next timer in ms).
    """
    names = StructType.fromDDL(output).names
    marked = rows.filter(F.col(key).isNotNull() & F.col("arrived").isNotNull()).withColumn("ms", F.unix_millis("arrived")).withWatermark("arrived", slack)

    def run(group, frames, handle):
        clock = handle.getCurrentWatermarkMs()
        existed, values = handle.exists, handle.get if handle.exists else None
        pieces = [pd.DataFrame()] if handle.hasTimedOut else in_order((f.drop(columns=[key, "arrived"]) for f in frames), ["ms", *order])
        timer = 0
        for found in pieces:
            out, values, timer = step(group[0], found.itertuples(index=False), values, clock)
            if out:
                yield pd.DataFrame(out, columns=names)
        if values is not None:
            handle.update(values)
            handle.setTimeoutTimestamp(max(timer, clock) + 1)
        elif existed:
            handle.remove()

    return marked.groupBy(key).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.EventTimeTimeout)


def run_and_drain(stream: DataFrame, name: str, drain: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a stream over all that is there now, and add what drain() makes of the states that are left.

    drain() takes (the key's columns, the state's columns) and gives rows like the stream's, which are the last of the run.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/vantage/stream-{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{base}/table").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    left = spark.read.format("statestore").load(f"{base}/state").select("key.*", "value.groupState.*")
    return spark.read.schema(stream.schema).parquet(f"{base}/table").unionByName(drain(left))


# ---- quarantine of sources


def quarantine(points: DataFrame, rate: float = 0.5, least: int = 100, cooldown: int = 30_000, tick: int = 1_000, slack: str = "1 minute") -> DataFrame:
    """(source, point_id, shed, tripped) of points (source, point_id, good, arrived).

    A source's counts of good and bad points halve at every tick (ms), and start anew below 0.01. When at least `least` points count and
    more than `rate` of them are bad, the source trips: what arrives within `cooldown` ms is shed and not counted, and its counts
    start anew. A null `good` is bad. The state is four numbers, and goes when the counts have faded and the cooldown is over.
    """

    def step(source, found, values, clock):
        good, bad, until, last = values or (0.0, 0.0, 0, 0)
        out = []
        for r in found:
            fade = 0.5 ** min(max(r.ms // tick - last // tick, 0), 1000)
            good, bad, last = good * fade, bad * fade, max(r.ms, last)
            if good + bad < 0.01:
                good = bad = 0.0
            shed = r.ms < until
            if not shed:
                good, bad = (good + 1, bad) if r.good else (good, bad + 1)
            trip = not shed and good + bad >= least and bad / (good + bad) > rate
            if trip:
                good, bad, until = 0.0, 0.0, r.ms + cooldown
            out.append((source, r.point_id, shed, trip))
        ticks = 0
        while (good + bad) * 0.5**ticks >= 0.01:
            ticks += 1
        over = max(until, (last // tick + ticks) * tick)
        return out, None if clock >= over and not out else (good, bad, until, last), over

    known = points.select(F.col("source").cast("string").alias("source"), "point_id", F.coalesce("good", F.lit(False)).alias("good"), "arrived")
    return timed(known, "source", step, "source string, point_id long, shed boolean, tripped boolean", "good double, bad double, until long, last long", slack, ["point_id"])


# ---- rows in the order of their numbers


class Reorder:
    """The buffer of one source: rows come out in the order of their numbers, each once.

    It starts at the least number once more than `depth` rows wait or the first has waited `delay` ms; later it waits so long for a missing
    number and then gives up all numbers before the least that waits.
    """

    def __init__(self, depth: int, delay: int, values: tuple | None = None):
        self.depth, self.delay = depth, delay
        self.started, self.next, waiting, self.stalled, self.seen = values or (False, 0, [], 0, 0)
        self.waiting = list(waiting)
        heapq.heapify(self.waiting)

    def values(self) -> tuple:
        return self.started, self.next, sorted(self.waiting), self.stalled, self.seen

    def push(self, seq: int, now: int) -> list[tuple[int, int]]:
        """The (number, numbers given up before it) that can go out when a row arrives; a number that went out already gives nothing."""
        self.seen = now
        if self.started and seq < self.next:
            return []
        if not self.waiting:
            self.stalled = now
        heapq.heappush(self.waiting, seq)
        out = self._ready() if self.started else []
        return out or (self._advance(now) if len(self.waiting) > self.depth else [])

    def flush(self, now: int) -> list[tuple[int, int]]:
        return self._advance(now) if self.waiting and now - self.stalled >= self.delay else []

    def _advance(self, now: int) -> list[tuple[int, int]]:
        least = self.waiting[0]
        gap, self.started, self.next = (least - self.next if self.started else 0), True, least
        out = self._ready()
        self.stalled = now
        return [(out[0][0], gap), *out[1:]]

    def _ready(self) -> list[tuple[int, int]]:
        out = []
        while self.waiting and self.waiting[0] <= self.next:
            if heapq.heappop(self.waiting) == self.next:
                out.append((self.next, 0))
                self.next += 1
        return out


BUFFER = "started boolean, next long, waiting array<long>, stalled long, seen long"


def reordered(points: DataFrame, depth: int = 8, delay: int = 2_000, ttl: int = 60_000, slack: str = "1 minute") -> DataFrame:
    """(source, seq, gap) of points (source, seq, arrived), in order and each once; gap: numbers given up just before a row.

    The state holds at most depth + 1 numbers, and goes `ttl` ms after the last row if none waits. leftovers() gives what waits at the end.
    """

    def step(source, found, values, clock):
        buffer, out, rows = Reorder(depth, delay, values), [], 0
        for rows, r in enumerate(found, 1):
            out += buffer.flush(r.ms)
            out += buffer.push(r.seq, r.ms)
        if not rows:
            out += buffer.flush(clock)
        timer = buffer.stalled + delay if buffer.waiting else buffer.seen + ttl
        kept = rows or buffer.waiting or clock < timer
        return [(source, *x) for x in out], buffer.values() if kept else None, timer

    known = points.filter("seq IS NOT NULL").select(F.col("source").cast("string").alias("source"), F.col("seq").cast("long").alias("seq"), "arrived")
    return timed(known, "source", step, "source string, seq long, gap long", BUFFER, slack, ["seq"])


def leftovers(states: DataFrame) -> DataFrame:
    """(source, seq, gap) of what waits in the states of reordered()."""
    waiting = F.array_distinct("waiting")
    before = lambda x, k: F.when(k > 0, F.get(waiting, k - 1) + 1).otherwise(F.when(F.col("started"), F.col("next")).otherwise(x))
    return states.select("source", F.explode(F.transform(waiting, lambda x, k: F.struct(x.alias("seq"), (x - before(x, k)).alias("gap")))).alias("r")).select("source", "r.*")


# ---- windows that say why they closed


def closed_windows(points: DataFrame, size: int, lateness: int, every: int, slack: str = "1 minute") -> DataFrame:
    """(series, start_us, n, total, reason) of points (series, us, cents, arrived); times in ms, us in microseconds.

    A window closes by `watermark` when its series' latest time less `lateness` reaches its end, and as `idle` when the clock less `lateness`
    has at one of the ticks that come every `every` ms. Rows of a closed window are left out. The state is the open windows, which the clock
    closes, and the latest time; still_open() gives those that a run's end closes.
    """
    span = size * 1000

    def step(series, found, values, clock):
        starts, ns, totals, newest, closed, seen = values or ([], [], [], None, 0, 0)
        held, out = {s: (n, t) for s, n, t in zip(starts, ns, totals, strict=True)}, []

        def close(mark, reason):
            nonlocal closed
            for s in sorted(x for x in held if x + span <= mark):
                out.append((series, s, *held.pop(s), reason))
            closed = max(closed, mark)

        rows = 0
        for rows, r in enumerate(found, 1):
            tick = r.ms // every * every
            if tick > seen:
                close((tick - lateness) * 1000, "idle")
            seen = max(seen, r.ms)
            start = r.us // span * span
            if start + span > closed:
                n, total = held.get(start, (0, 0))
                held[start] = (n + 1, total + (0 if r.cents != r.cents else int(r.cents)))
            newest = max(newest if newest is not None else r.us, r.us)
            close(newest - lateness * 1000, "watermark")
        if not rows:
            close((clock // every * every - lateness) * 1000, "idle")
        due = (min(held) + span) // 1000 + lateness if held else seen + lateness + size
        timer = -(-due // every) * every
        kept = sorted(held)
        state = (kept, [held[s][0] for s in kept], [held[s][1] for s in kept], newest, closed, seen)
        return out, state if held or rows or clock < timer else None, timer

    known = points.filter("us IS NOT NULL").select(F.col("series").cast("string").alias("series"), "us", F.col("cents").cast("double").alias("cents"), "arrived")
    state = "starts array<long>, ns array<long>, totals array<long>, newest long, closed long, seen long"
    return timed(known, "series", step, "series string, start_us long, n long, total long, reason string", state, slack, ["us"])


def still_open(states: DataFrame) -> DataFrame:
    """The open windows of closed_windows() when a run ends: they close as `shutdown` and are partial."""
    w = states.select("series", F.explode(F.arrays_zip("starts", "ns", "totals")).alias("w"))
    return w.select("series", F.col("w.starts").alias("start_us"), F.col("w.ns").alias("n"), F.col("w.totals").alias("total"), F.lit("shutdown").alias("reason"))


# ---- late rows and completeness, by the watermark of each source


def late_tagged(events: DataFrame, delay: int, allowed: int, ttl: int = 86_400_000, slack: str = "1 hour") -> DataFrame:
    """(source, event_id, behind_us, reason) of events (source, event_id, us, arrived), every row once.

    behind_us is how far a row is behind its source's latest time less `delay` ms, 0 if it isn't. reason is null for rows in time, `allowed`
    for rows at most `allowed` ms behind and `beyond` for others, which belong in a side output. The state is one number.
    """

    def step(source, found, values, clock):
        newest, seen = values or (None, 0)
        out = []
        for r in found:
            behind = 0 if newest is None else max(0, newest - delay * 1000 - r.us)
            out.append((source, r.event_id, behind, None if not behind else "allowed" if behind <= allowed * 1000 else "beyond"))
            newest, seen = r.us if newest is None else max(newest, r.us), r.ms
        return out, (newest, seen) if out or clock < seen + ttl else None, seen + ttl

    known = events.filter("us IS NOT NULL").select(F.col("source").cast("string").alias("source"), "event_id", "us", "arrived")
    return timed(known, "source", step, "source string, event_id long, behind_us long, reason string", "newest long, seen long", slack, ["event_id"])


def late_level(late: Column, rows: Column, warn: float = 0.0005, page: float = 0.005) -> Column:
    """The service level of a share of late rows: ok, warn or page."""
    return F.when(late / rows >= page, "page").when(late / rows >= warn, "warn").otherwise("ok")


def completeness(events: DataFrame, size: int, delay: int, allowed: int, ttl: int = 86_400_000, slack: str = "1 hour") -> DataFrame:
    """(source, start_us, class, n, late_after_emit, watermark_us) of events (source, event_id, us, arrived); each window twice.

    A window is shown as `provisional` when its source's watermark, the latest time less `delay` ms, reaches its end, and as `final` `allowed` ms later;
    rows that come between are late_after_emit, rows behind the final one are left out (late_tagged() keeps them). watermark_us is the
    watermark that showed it. The state is the windows between their first row and their final row.
    """
    span = size * 1000

    def step(source, found, values, clock):
        starts, ns, first, newest, seen = values or ([], [], [], None, 0)
        held, out, rows = {s: [n, f] for s, n, f in zip(starts, ns, first, strict=True)}, [], 0
        for rows, r in enumerate(found, 1):
            mark = (newest if newest is not None else r.us) - delay * 1000
            start = r.us // span * span
            if newest is None or start + span + allowed * 1000 > mark:
                held.setdefault(start, [0, -1])[0] += 1
            newest, seen = r.us if newest is None else max(newest, r.us), r.ms
            mark = newest - delay * 1000
            for s in sorted(x for x in held if x + span <= mark):
                if held[s][1] < 0:
                    held[s][1] = held[s][0]
                    out.append((source, s, "provisional", held[s][0], 0, mark))
                if s + span + allowed * 1000 <= mark:
                    n, shown = held.pop(s)
                    out.append((source, s, "final", n, n - shown, mark))
        kept = sorted(held)
        state = (kept, [held[s][0] for s in kept], [held[s][1] for s in kept], newest, seen)
        return out, state if rows or clock < seen + ttl else None, seen + ttl

    known = events.filter("us IS NOT NULL").select(F.col("source").cast("string").alias("source"), "event_id", "us", "arrived")
    output = "source string, start_us long, class string, n long, late_after_emit long, watermark_us long"
    return timed(known, "source", step, output, "starts array<long>, ns array<long>, first array<long>, newest long, seen long", slack, ["event_id"])


# ---- what did not come


def absences(events: DataFrame, within: int, grace: int, slack: str = "1 hour") -> DataFrame:
    """(key, event_id, status) for each expecting row of events (key, event_id, expects, arrived).

    Where `expects` is true a row opens an expectation for the next `within` ms, and any other row of the key meets all that are open: `timely`. One
    that the clock passes is `missing`; a row within `grace` ms after that makes it `late` as well. The state is the expectations
    of the last within + grace ms.
    """

    def step(key, found, values, clock):
        due, ids, missed = ([], [], []) if values is None else map(list, values)
        waiting, out = [list(x) for x in zip(due, ids, missed, strict=True)], []

        def pass_by(now):
            for x in waiting:
                if x[0] < now and not x[2]:
                    x[2] = True
                    out.append((key, x[1], "missing"))
            waiting[:] = [x for x in waiting if x[0] + grace >= now]

        rows = 0
        for rows, r in enumerate(found, 1):
            pass_by(r.ms)
            if r.expects:
                waiting.append([r.ms + within, r.event_id, False])
            else:
                out.extend((key, x[1], "late" if x[2] else "timely") for x in waiting)
                waiting.clear()
        if not rows:
            pass_by(clock)
        timer = min((x[0] + (grace if x[2] else 0) for x in waiting), default=0)
        return out, tuple([x[k] for x in waiting] for k in range(3)) if waiting else None, timer

    known = events.select(F.col("key").cast("string").alias("key"), "event_id", F.coalesce("expects", F.lit(False)).alias("expects"), "arrived")
    return timed(known, "key", step, "key string, event_id long, status string", "due array<long>, ids array<long>, missed array<boolean>", slack, ["event_id"])
