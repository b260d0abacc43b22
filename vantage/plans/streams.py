"""Queries that run streams over the events table until all of it is read."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vantage.catalog import query
from vantage.functions.time import DAY, HOUR, whole, window_start
from vantage.operators import metrics as M
from vantage.plans.metrics import PT
from vantage.sources.tables import EV, events as ev, table
from vantage.streaming import keyed as K
from vantage.streaming import windows as S

TTL = "365 days"
CLOSED = """WITH {EV}, m AS (SELECT max(us) - 600000000 AS mark FROM ev), w AS (SELECT us - us % {size} AS start_us, {key}, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM ev GROUP BY ALL)
 SELECT start_us, {name}, n, total FROM w, m WHERE start_us + {size} <= mark"""


@query("T01_watermark_close", CLOSED.format(EV=EV, size=3600000000, key="event_type", name="event_type"))
def t01(spark, sf_dir):
    """Hourly windows close once the latest time less ten minutes has passed their end."""
    return S.run_to_table(S.windowed(S.read_events(spark, sf_dir), "1 hour", "10 minutes", ["event_type"]), "t01")


@query("T02_tumbling_append", CLOSED.format(EV=EV, size=86400000000, key="user_id", name="user_id"))
def t02(spark, sf_dir):
    return S.run_to_table(S.windowed(S.read_events(spark, sf_dir), "1 day", "10 minutes", ["user_id"]), "t02")


@query("T03_sliding", f"""WITH {EV}, m AS (SELECT max(us) - 600000000 AS mark FROM ev), e AS (SELECT event_type, unnest([us // 3600000000, us // 3600000000 - 1, us // 3600000000 - 2]) * 3600000000 AS start_us, cents FROM ev)
 SELECT start_us, event_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM e, m WHERE start_us + 10800000000 <= mark GROUP BY ALL""")
def t03(spark, sf_dir):
    return S.run_to_table(S.windowed(S.read_events(spark, sf_dir), "3 hours", "10 minutes", ["event_type"], slide="1 hour"), "t03")


@query("T04_sessions", f"""WITH {EV}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) < 1800000000 THEN 0 ELSE 1 END AS new FROM ev), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS sess FROM g),
 x AS (SELECT user_id, min(us) AS start_us, max(us) + 1800000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, sess) SELECT x.* FROM x, (SELECT max(us) - 600000000 AS mark FROM ev) WHERE end_us <= mark""")
def t04(spark, sf_dir):
    return S.run_to_table(S.sessions(S.read_events(spark, sf_dir), "30 minutes", "10 minutes"), "t04")


@query("T07_dedup", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def t07(spark, sf_dir):
    """Every event twice in the stream, once in the result."""
    e = S.read_events(spark, sf_dir)
    once = S.distinct_within(e.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")), "event_id", "1 hour")
    return S.run_to_table(once.select("event_id"), "t07").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("T13_versioned_upserts", f"WITH {EV} SELECT event_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM ev GROUP BY 1")
def t13(spark, sf_dir):
    stream = S.read_events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("cents").alias("total"))
    return S.run_upserts(stream, "t13", ["event_type"]).drop("version")


@query("T14_completeness_class", f"WITH {EV}, w AS (SELECT us - us % 86400000000 AS start_us, count(*) AS n, count(*) FILTER (event_id % 20 = 0) AS late FROM ev GROUP BY 1) SELECT start_us, n - late AS provisional, n AS final, late AS late_after_emit FROM w")
def t14(spark, sf_dir):
    """What a window showed first, what it shows at last, and how many rows came between."""
    late = F.count_if(F.col("event_id") % 20 == 0)
    w = ev(spark, sf_dir).groupBy(window_start("us", DAY).alias("start_us")).agg((F.count("*") - late).alias("provisional"), F.count("*").alias("final"), late.alias("late_after_emit"))
    return w


@query("T15_split_watermarks", f"WITH {EV}, m AS (SELECT event_type = 'error' AS slow, max(us) AS newest FROM ev GROUP BY 1), w AS (SELECT us - us % 3600000000 AS start_us, event_type, count(*) AS n FROM ev GROUP BY ALL) SELECT start_us, w.event_type, n FROM w JOIN m ON m.slow = (w.event_type = 'error') WHERE start_us + 3600000000 <= newest - CASE WHEN slow THEN 7200000000 ELSE 600000000 END")
def t15(spark, sf_dir):
    """Producers with long delays have a watermark of their own, so that the others need not wait."""
    e = S.read_events(spark, sf_dir)
    slow = S.run_to_table(S.windowed(e.filter(F.col("event_type") == "error"), "1 hour", "2 hours", ["event_type"]), "t15a")
    fast = S.run_to_table(S.windowed(e.filter(F.col("event_type") != "error"), "1 hour", "10 minutes", ["event_type"]), "t15b")
    return slow.unionByName(fast).select("start_us", "event_type", "n")


@query("T16_stream_stream_join", f"WITH {EV} SELECT a.event_id AS left_id, b.event_id AS right_id FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.us >= a.us AND b.us <= a.us + 3600000000 WHERE a.event_type = 'view' AND b.event_type = 'click'")
def t16(spark, sf_dir):
    e = lambda kind: S.read_events(spark, sf_dir).filter(F.col("event_type") == kind)
    return S.run_to_table(S.interval_join(e("view"), e("click"), "1 hour", "1 HOUR"), "t16")


@query("T17_stream_static", f"WITH {EV} SELECT event_id, c_mktsegment FROM ev JOIN customer ON c_custkey = user_id")
def t17(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return S.run_to_table(S.read_events(spark, sf_dir).join(c, "user_id").select("event_id", "c_mktsegment"), "t17")


@query("T19_absence", f"WITH {EV}, g AS (SELECT user_id % 10 AS producer, unnest(generate_series((SELECT min(us) // 86400000000 FROM ev), (SELECT max(us) // 86400000000 FROM ev))) AS day FROM ev GROUP BY 1), p AS (SELECT DISTINCT user_id % 10 AS producer, us // 86400000000 AS day FROM ev WHERE k > 70 AND event_type = 'purchase') SELECT producer, day FROM g EXCEPT SELECT producer, day FROM p")
def t19(spark, sf_dir):
    """Producers and days without the purchase that was due."""
    e = ev(spark, sf_dir).withColumn("producer", F.col("user_id") % 10).withColumn("day", whole(F.col("us"), DAY))
    days = e.agg(F.min("day").alias("a"), F.max("day").alias("z"))
    grid = e.select("producer").distinct().crossJoin(F.broadcast(days)).select("producer", F.explode(F.sequence("a", "z")).alias("day"))
    return grid.join(e.filter((F.col("k") > 70) & (F.col("event_type") == "purchase")), ["producer", "day"], "left_anti")


@query("T20_cdc_apply", f"WITH {EV}, c AS (SELECT user_id AS key, event_id AS lsn, cents, event_type = 'error' AS deleted FROM ev) SELECT key, arg_max(cents, lsn) AS cents FROM c GROUP BY key HAVING NOT arg_max(deleted, lsn)")
def t20(spark, sf_dir):
    """The last change of each key by log number; deletes leave nothing, snapshot rows lose to any change."""
    log = S.read_events(spark, sf_dir).select("ts", F.col("user_id").alias("key"), F.col("event_id").alias("lsn"), "cents", (F.col("event_type") == "error").alias("deleted"))
    row = F.struct("lsn", "cents", "deleted")
    snapshot = F.struct(F.lit(-1).cast("long").alias("lsn"), F.lit(0).cast("long").alias("cents"), F.lit(False).alias("deleted"))
    both = log.select("ts", "key", F.explode(F.array(row, snapshot)).alias("c")).select("ts", "key", "c.*")
    applied = S.run_to_table(K.changes_applied(both, TTL), "t20").groupBy("key").agg(F.max_by(F.struct("cents", "deleted"), "lsn").alias("v"))
    return applied.filter(~F.col("v.deleted")).select("key", "v.cents")


@query("T21_transaction_complete", f"WITH {EV}, t AS (SELECT event_id // 4 AS tx, count(*) AS n FROM ev WHERE event_id % 97 <> 0 GROUP BY 1) SELECT tx FROM t WHERE n = 4")
def t21(spark, sf_dir):
    """Transactions of four rows, shown when the fourth is there; one row in 97 never comes."""
    e = S.read_events(spark, sf_dir).filter(F.col("event_id") % 97 != 0)
    rows = e.select(whole(F.col("event_id"), 4).alias("tx"), F.col("event_id").alias("row_id"), F.lit(4).alias("expected"), "ts")
    return S.run_to_table(K.complete_transactions(rows), "t21").select("tx")


@query("T22_salted_windows", f"WITH {EV}, m AS (SELECT max(us) - 600000000 AS mark FROM ev), w AS (SELECT us - us % 3600000000 AS start_us, event_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM ev GROUP BY ALL) SELECT start_us, event_type, n, total FROM w, m WHERE start_us + 3600000000 <= mark")
def t22(spark, sf_dir):
    return S.run_to_table(S.salted_windows(S.read_events(spark, sf_dir), "1 hour", "10 minutes", "event_type", 8), "t22")


@query("T23_idempotent_counters", f"WITH {EV} SELECT user_id, count(*) AS n FROM ev GROUP BY 1")
def t23(spark, sf_dir):
    """Events of a user, of which one in 50 comes twice."""
    e = S.read_events(spark, sf_dir).select("ts", "user_id", "event_id")
    twice = F.when(F.col("event_id") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    counts = S.run_to_table(K.counted_once(e.withColumn("copy", F.explode(twice)), ttl=TTL), "t23")
    return counts.groupBy("user_id").agg(F.max("n").alias("n"))


@query("T24_stream_batch_delta", f"WITH {EV}, m AS (SELECT max(us) - 600000000 AS mark FROM ev) SELECT count(DISTINCT (us // 3600000000, event_type)) AS windows, 0 AS off FROM ev, m WHERE us - us % 3600000000 + 3600000000 <= mark")
def t24(spark, sf_dir):
    """Closed windows of the stream against the same windows in batch: how many there are, and how many differ."""
    streamed = t01(spark, sf_dir)
    batch = ev(spark, sf_dir).groupBy(window_start("us", HOUR).alias("start_us"), "event_type").agg(F.count("*").alias("b"))
    j = streamed.join(batch, ["start_us", "event_type"], "left")
    return j.agg(F.countDistinct("start_us", "event_type").alias("windows"), F.count_if(F.coalesce(F.col("n") != F.col("b"), F.lit(True))).cast("int").alias("off"))


@query("T06_late_side_output", f"WITH {EV}, i AS (SELECT event_id, us, us + CASE WHEN event_id % 20 = 0 THEN ((event_id * 7919) % 1000) * 1000000 ELSE 1000000 END AS arrived FROM ev), s AS (SELECT *, max(us) OVER (ORDER BY arrived, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM i) SELECT event_id FROM s WHERE us < seen - 300000000")
def t06(spark, sf_dir):
    """Rows behind the watermark when they arrive, kept with their ids; the batch form, by time slots of arrival.

    The latest time seen before a row is the running maximum inside its slot and the maximum over the slots before it.
    """
    wait = F.when(F.col("event_id") % 20 == 0, (F.col("event_id") * 7919) % 1000).otherwise(1)
    i = ev(spark, sf_dir).withColumn("arrived", F.col("us") + wait * 1_000_000).withColumn("slot", whole(F.col("arrived"), HOUR))
    inside = Window.partitionBy("slot").orderBy("arrived", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    slots = i.groupBy("slot").agg(F.max("us").alias("most"))  # one row an hour
    before = slots.select("slot", F.max("most").over(Window.partitionBy(F.lit(0)).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    seen = F.greatest(F.max("us").over(inside), F.col("earlier"))
    return i.join(before, "slot").withColumn("seen", seen).filter(F.col("us") < F.col("seen") - 300_000_000).select("event_id")


@query("T10_source_budget", f"""WITH RECURSIVE {PT}, h AS (SELECT source, us // 3600000000 AS h, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS bad FROM pt GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h) AS nth FROM h), f AS (SELECT source, nth, CAST(n AS DOUBLE) AS n, CAST(bad AS DOUBLE) AS bad FROM o WHERE nth = 1 UNION ALL SELECT o.source, o.nth, f.n / 2 + o.n, f.bad / 2 + o.bad FROM f JOIN o ON o.source = f.source AND o.nth = f.nth + 1) SELECT source, CAST(count(*) FILTER (n >= 3 AND bad > 0.5 * n) AS INT) AS trips FROM f GROUP BY 1""")
def t10(spark, sf_dir):
    """Sources whose bad points use up a budget that halves every hour: a fold over each source's hours."""
    p = M.points_from_events(ev(spark, sf_dir))
    hours = p.groupBy("source", whole(F.col("us"), HOUR).alias("h")).agg(F.count("*").alias("n"), F.count_if(F.col("event_id") % 3 == 0).alias("bad"))
    rows = hours.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("h", "n", "bad"))).alias("rows"))
    step = lambda s, r: F.struct((s["n"] / 2 + r["n"]).alias("n"), (s["bad"] / 2 + r["bad"]).alias("bad"), (s["trips"] + ((s["n"] / 2 + r["n"] >= 3) & (s["bad"] / 2 + r["bad"] > 0.5 * (s["n"] / 2 + r["n"]))).cast("int")).alias("trips"))
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("bad"), F.lit(0).alias("trips"))
    return rows.select("source", F.aggregate("rows", start, step).alias("s")).select("source", "s.trips")
