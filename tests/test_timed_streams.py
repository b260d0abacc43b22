"""Streams with a clock: golden sequences, several micro-batches against one, and states that go."""

import datetime as dt
import random

import pytest

from tests.test_keyed_streams import stream
from vantage.streaming import timed as T
from vantage.streaming import windows as S

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def us(seconds):
    return int((START - dt.datetime(1970, 1, 1)).total_seconds() + seconds) * 1_000_000


def test_reorder_begins_at_the_least_number():
    buffer = T.Reorder(2, 1000)
    assert [buffer.push(seq, 100_000) for seq in (3, 1, 2, 4)] == [[], [], [(1, 0), (2, 0), (3, 0)], [(4, 0)]]


def test_reorder_gives_up_after_the_delay():
    buffer = T.Reorder(8, 50)
    assert buffer.push(1, 100_000) == [] and buffer.flush(101_000) == [(1, 0)]
    assert buffer.push(3, 102_000) == [] and buffer.push(4, 102_000) == []
    assert buffer.flush(102_010) == [] and buffer.flush(103_000) == [(3, 1), (4, 0)]


def test_reorder_leaves_out_what_went_out():
    buffer = T.Reorder(1, 1000)
    assert buffer.push(1, 0) == [] and buffer.push(2, 0) == [(1, 0), (2, 0)]
    assert buffer.push(1, 0) == [] and buffer.push(2, 0) == [] and buffer.values()[2] == []


def test_reorder_holds_no_more_than_its_depth():
    buffer = T.Reorder(4, 3_600_000)
    buffer.push(99, 0)
    assert buffer.flush(3_600_000) == [(99, 0)]
    for seq in range(101, 201):
        buffer.push(seq, 3_600_000)
        assert len(buffer.values()[2]) <= 5


def states(spark, base):
    return spark.read.format("statestore").load(f"{base}/state")


def run(spark, df, base):
    query = df.writeStream.format("parquet").option("path", f"{base}/table").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/table")


def test_reorder_timers_leftovers_and_ttl(spark, tmp_path):
    schema = "source string, seq long, arrived timestamp"
    # 3 is lost and the clock passes; b ends with a gap; c falls silent and its state goes
    batches = [[("a", 1, at(0)), ("a", 0, at(0)), ("c", 7, at(0))], [("a", 2, at(5)), ("a", 4, at(6)), ("b", 5, at(6))], [("b", 90, at(400)), ("b", 88, at(400))], [("b", 91, at(401))], [("a", 4, at(402))]]
    points = stream(spark, tmp_path, batches, schema)
    found = run(spark, T.reordered(points, depth=8, delay=2_000, ttl=60_000, slack="10 seconds"), tmp_path)
    assert sorted(map(tuple, found.collect())) == [("a", 0, 0), ("a", 1, 0), ("a", 2, 0), ("a", 4, 1), ("b", 5, 0), ("c", 7, 0)]
    left = states(spark, tmp_path).select("key.*", "value.groupState.*")
    # the source a came back after its state was gone, so its last row waits for a new start
    assert sorted(map(tuple, T.leftovers(left).collect())) == [("a", 4, 0), ("b", 88, 82), ("b", 90, 1), ("b", 91, 0)]
    assert sorted(r.source for r in left.collect()) == ["a", "b"]


def quarantined(rows, rate, least, cooldown, tick):
    """A plain simulation, point by point."""
    out, held = [], {}
    for source, point_id, good, when in sorted(rows, key=lambda r: (r[3], r[1])):
        ms = us(0) // 1000 + round((when - START).total_seconds() * 1000)
        s = held.setdefault(source, {"ok": 0.0, "bad": 0.0, "until": 0, "tick": ms // tick})
        while s["tick"] < ms // tick:
            s["tick"] += 1
            s["ok"], s["bad"] = s["ok"] / 2, s["bad"] / 2
            if s["ok"] + s["bad"] < 0.01:
                s["ok"] = s["bad"] = 0.0
        shed = ms < s["until"]
        tripped = False
        if not shed:
            s["ok" if good else "bad"] += 1
            total = s["ok"] + s["bad"]
            if total >= least and s["bad"] / total > rate:
                tripped, s["ok"], s["bad"], s["until"] = True, 0.0, 0.0, ms + cooldown
        out.append((source, point_id, shed, tripped))
    return sorted(out)


def test_quarantine_over_batches_is_a_plain_simulation(spark, tmp_path):
    r = random.Random(4)
    rows, now = [], 0.0
    for k in range(900):
        now += r.choice([0.1, 0.4, 1.0]) + (40 if k % 300 == 299 else 0)
        source = r.choice("abc")
        good = {"a": k > 450 or r.random() < 0.2, "b": r.random() < 0.9, "c": r.random() < 0.5}[source]
        rows.append((source, k, good, at(round(now, 1))))
    expected = quarantined(rows, 0.5, 5, 30_000, 10_000)
    trips = [x for x in expected if x[3]]
    again = {s: sum(x[0] == s for x in trips) for s in "abc"}
    assert again["a"] > 1 and again["b"] == 0 and any(x[2] for x in expected)  # trips, cools down, is counted anew, trips again
    assert not any(x[2] for x in expected if x[0] == "a" and x[1] > 700)  # and is taken once it is good
    batches = [rows[k : k + 130] for k in range(0, 900, 130)]
    points = stream(spark, tmp_path, batches, "source string, point_id long, good boolean, arrived timestamp")
    found = run(spark, T.quarantine(points, least=5, tick=10_000), tmp_path)
    assert sorted(map(tuple, found.collect())) == expected


def test_quarantine_state_goes(spark, tmp_path):
    batches = [[("a", 1, False, at(0)), (None, 2, True, at(1))], [("b", 3, True, at(600))], [("b", 4, None, at(1200))], [("b", 5, True, at(1201))]]
    points = stream(spark, tmp_path, batches, "source string, point_id long, good boolean, arrived timestamp")
    assert sorted(map(tuple, run(spark, T.quarantine(points), tmp_path).collect())) == [("a", 1, False, False), ("b", 3, False, False), ("b", 4, False, False), ("b", 5, False, False)]
    assert [r.key.source for r in states(spark, tmp_path).collect()] == ["b"]


def test_windows_close_for_three_reasons(spark, tmp_path):
    hour = 3600
    rows = lambda *x: [(s, us(t), c, at(t + 1)) for s, t, c in x]
    # a: the next row comes before the tick that closes the window; b falls silent and the clock closes it; both are open at the end
    batches = [rows(("a", 10, 1), ("a", 20, None), ("b", 30, 5)), rows(("a", hour + 600 + 5, 7)), rows(("a", 3 * hour, 9), ("b", 3 * hour + 1, 2)), rows(("a", 30, 100), ("b", 3 * hour + 2, 4))]
    points = stream(spark, tmp_path, [[(s, u, c, a) for s, u, c, a in b] for b in batches], "series string, us long, cents long, arrived timestamp")
    found = T.run_and_drain(T.closed_windows(points, hour * 1000, 600_000, 420_000, slack="4 hours"), "close", T.still_open)
    assert sorted(map(tuple, found.collect())) == [
        ("a", us(0), 2, 1, "watermark"), ("a", us(hour), 1, 7, "idle"), ("a", us(3 * hour), 1, 9, "shutdown"),
        ("b", us(0), 1, 5, "idle"), ("b", us(3 * hour), 2, 6, "shutdown"),
    ]


def test_silent_series_is_closed_by_a_timer(spark, tmp_path):
    batches = [[("a", us(0), 1, at(1))], [("b", us(9000), 1, at(9001))], [("b", us(9010), 1, at(9011))]]
    points = stream(spark, tmp_path, batches, "series string, us long, cents long, arrived timestamp")
    found = run(spark, T.closed_windows(points, 3_600_000, 600_000, 60_000), tmp_path)
    assert [tuple(r) for r in found.collect()] == [("a", us(0), 1, 1, "idle")]


def late_rows(seed=7, n=600):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        t = k * 20
        wait = r.choice([1, 1, 1, 1, 400, 2000])
        rows.append((r.choice("ab"), k, us(t), at(t + wait)))
    return sorted(rows, key=lambda x: (x[3], x[1]))


def test_late_rows_stay_in_one_of_two_outputs(spark, tmp_path):
    rows = late_rows()
    newest, expected = {}, []
    for s, k, u, _ in rows:
        behind = max(0, newest.get(s, u) - 300_000_000 - u)
        expected.append((s, k, behind, None if not behind else "allowed" if behind <= 600_000_000 else "beyond"))
        newest[s] = max(newest.get(s, u), u)
    events = stream(spark, tmp_path, [rows[k : k + 150] for k in range(0, 600, 150)], "source string, event_id long, us long, arrived timestamp")
    tagged = run(spark, T.late_tagged(events, 300_000, 600_000), tmp_path)
    main, side = tagged.filter("reason IS NULL OR reason = 'allowed'"), tagged.filter("reason = 'beyond'")
    assert sorted(r.event_id for r in main.unionAll(side).collect()) == list(range(600)) and 0 < side.count() < 200
    assert sorted(map(tuple, tagged.collect()), key=lambda x: x[1]) == sorted(expected, key=lambda x: x[1])


@pytest.mark.parametrize(("late", "level"), [(0, "ok"), (4, "ok"), (5, "warn"), (49, "warn"), (50, "page")])
def test_late_level(spark, late, level):
    from pyspark.sql import functions as F

    assert spark.range(1).select(T.late_level(F.lit(late), F.lit(10_000))).first()[0] == level


def test_windows_are_provisional_then_final(spark, tmp_path):
    rows = late_rows(9)
    events = lambda name, parts: stream(spark, tmp_path / name, parts, "source string, event_id long, us long, arrived timestamp")
    one = run(spark, T.completeness(events("one", [rows]), 600_000, 60_000, 900_000), tmp_path / "one")
    many = run(spark, T.completeness(events("many", [rows[k : k + 77] for k in range(0, 600, 77)]), 600_000, 60_000, 900_000), tmp_path / "many")
    found = sorted(map(tuple, many.collect()))
    assert found == sorted(map(tuple, one.collect()))
    first, last = ({r[:2]: r for r in found if r[2] == kind} for kind in ("provisional", "final"))
    assert last.keys() <= first.keys() and any(r[4] for r in last.values())
    for k, r in last.items():
        assert r[3] == first[k][3] + r[4] and r[5] >= k[1] + 1_500_000_000 and first[k][5] >= k[1] + 600_000_000


def test_absence_is_told(spark, tmp_path):
    # x is met in time; y is never met, and a timer tells; z is met too late; two expectations of w are met at once
    batches = [[("x", 1, True, at(0)), ("y", 2, True, at(0)), ("z", 3, True, at(0)), ("w", 4, True, at(1)), ("w", 5, True, at(2))], [("x", 6, False, at(50)), ("w", 7, False, at(60))], [("z", 8, False, at(130)), ("v", 9, False, at(5000))], [("v", 10, True, at(9000)), ("y", 11, False, at(9000))], [("v", 12, None, at(9001))]]
    events = stream(spark, tmp_path, batches, "key string, event_id long, expects boolean, arrived timestamp")
    found = run(spark, T.absences(events, 100_000, 60_000, slack="1 minute"), tmp_path)
    assert sorted(map(tuple, found.collect())) == [("v", 10, "timely"), ("w", 4, "timely"), ("w", 5, "timely"), ("x", 1, "timely"), ("y", 2, "missing"), ("z", 3, "late"), ("z", 3, "missing")]
    assert states(spark, tmp_path).count() == 0
