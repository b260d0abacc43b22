"""Queries for streams with a clock. Rows arrive a second after their time, one in twenty up to 1,000 seconds after it."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.catalog import query
from vantage.functions.time import whole
from vantage.sources.tables import EV
from vantage.streaming import timed as T
from vantage.streaming import windows as S

SECOND, MINUTE, HOUR, DAY = 1_000, 60_000, 3_600_000, 86_400_000
ARRIVED = """{EV}, i AS (SELECT CAST(user_id % {sources} AS VARCHAR) AS source, event_id, us, us + CASE WHEN event_id % 20 = 0 THEN ((event_id * 7919) % 1000) * 1000000 ELSE 1000000 END AS arrived FROM ev WHERE user_id IS NOT NULL),
 s AS (SELECT *, row_number() OVER w AS nth, max(us) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, max(us) OVER (w ROWS UNBOUNDED PRECEDING) AS newest FROM i WINDOW w AS (PARTITION BY source ORDER BY arrived // 1000, event_id)),
 t AS (SELECT source, event_id, us, nth, newest - 60000000 AS mark, seen, greatest(0, coalesce(seen - 60000000 - us, 0)) AS behind_us FROM s)"""
TEN, TWO = (ARRIVED.format(EV=EV, sources=n) for n in (10, 2))


def arriving(spark, sf_dir, sources):
    """The events as a stream with `us`, the name of one of some sources, and the time of arrival."""
    us = F.unix_micros("ts")
    wait = F.when(F.col("event_id") % 20 == 0, (F.col("event_id") * 7919) % 1000).otherwise(1)
    return S.read_events(spark, sf_dir).select("event_id", us.alias("us"), "cents", "event_type", "user_id", (F.col("user_id") % sources).cast("string").alias("source"), F.timestamp_micros(us + wait * 1_000_000).alias("arrived"))


@query("T10_quarantine_stream", f"""WITH RECURSIVE {TEN}, o AS (SELECT source, nth, event_id, arrived // 1000 AS ms, CASE WHEN event_id % 3 <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS good FROM s),
 f AS (SELECT source, 0::BIGINT AS nth, 0::BIGINT AS event_id, 0.0::DOUBLE AS g, 0.0::DOUBLE AS b, 0::BIGINT AS until, 0::BIGINT AS last, false AS shed, false AS tripped FROM o WHERE nth = 1
 UNION ALL SELECT source, nth, event_id, CASE WHEN trip THEN 0.0 ELSE g END, CASE WHEN trip THEN 0.0 ELSE b END, CASE WHEN trip THEN ms + 21600000 ELSE until END, ms, shed, trip FROM (
 SELECT *, NOT shed AND g + b >= 3 AND b / (g + b) > 0.5 AS trip FROM (
 SELECT source, nth, event_id, ms, until, shed, CASE WHEN g + b < 0.01 THEN 0.0 ELSE g END + CASE WHEN shed THEN 0.0 ELSE good END AS g, CASE WHEN g + b < 0.01 THEN 0.0 ELSE b END + CASE WHEN shed THEN 0.0 ELSE 1 - good END AS b FROM (
 SELECT o.source, o.nth, o.event_id, o.ms, o.good, f.until, o.ms < f.until AS shed, f.g * pow(0.5, least(o.ms // 3600000 - f.last // 3600000, 1000)) AS g, f.b * pow(0.5, least(o.ms // 3600000 - f.last // 3600000, 1000)) AS b FROM f JOIN o ON o.source = f.source AND o.nth = f.nth + 1))))
 SELECT source, event_id AS point_id, shed, tripped FROM f WHERE nth > 0""")
def t10_stream(spark, sf_dir):
    """Each point of ten sources, taken or shed: a source trips when most of its fading counts are bad, and cools down for six hours."""
    p = arriving(spark, sf_dir, 10).select("source", F.col("event_id").alias("point_id"), (F.col("event_id") % 3 != 0).alias("good"), "arrived")
    return S.run_to_table(T.quarantine(p, least=3, cooldown=6 * HOUR, tick=HOUR, slack="1 hour"), "t10")


@query("T08_reorder_timed", """WITH p AS (SELECT CAST(event_id % 10 AS VARCHAR) AS source, event_id // 10 AS seq FROM events WHERE event_id % 97 <> 0)
 SELECT source, seq, coalesce(seq - lag(seq) OVER (PARTITION BY source ORDER BY seq) - 1, 0) AS gap FROM p""")
def t08_timed(spark, sf_dir):
    """Points of ten sources, one a second, up to four seconds late and some twice, one in 97 never: a missing number is given up after
    ten seconds or when more than eight wait, and what waits at the end goes out, too."""
    e = S.read_events(spark, sf_dir).filter(F.col("event_id") % 97 != 0)
    seq = whole(F.col("event_id"), 10)
    copies = F.explode(F.when(F.col("event_id") % 50 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    p = e.select((F.col("event_id") % 10).alias("source"), seq.alias("seq"), copies.alias("copy"))
    arrived = F.timestamp_seconds(86_400 + F.col("seq") + (F.col("seq") * 7) % 5 + F.col("copy"))
    return T.run_and_drain(T.reordered(p.select("source", "seq", arrived.alias("arrived")), depth=8, delay=10 * SECOND), "t08", T.leftovers)


@query("T09_close_stream", f"""WITH {EV}, r AS (SELECT event_type AS series, us, cents, (us + 1000000) // 1000 AS ms, row_number() OVER (PARTITION BY event_type ORDER BY (us + 1000000) // 1000, us) AS nth FROM ev WHERE event_type IS NOT NULL),
 c AS (SELECT max(ms) - 60000 AS clock FROM r), w AS (SELECT series, us - us % 3600000000 AS start_us, count(*) AS n, CAST(coalesce(sum(cents), 0) AS BIGINT) AS total FROM r GROUP BY ALL),
 d AS (SELECT *, ((start_us + 4200000000) // 1000 + 419999) // 420000 * 420000 AS due_ms FROM w), b AS (SELECT d.series, d.start_us, d.n, d.total, d.due_ms, min(nth) FILTER (ms >= due_ms) AS idle, min(nth) FILTER (us >= start_us + 4200000000) AS passed FROM d JOIN r ON r.series = d.series GROUP BY ALL)
 SELECT series, start_us, n, total, CASE WHEN passed < idle OR idle IS NULL AND passed IS NOT NULL THEN 'watermark' WHEN idle IS NOT NULL OR due_ms <= clock THEN 'idle' ELSE 'shutdown' END AS reason FROM b, c""")
def t09_stream(spark, sf_dir):
    """Hourly windows of each event type with why they closed: a later row, the clock (which ticks every seven minutes), or the end of the run."""
    p = arriving(spark, sf_dir, 1).select(F.col("event_type").alias("series"), "us", "cents", F.timestamp_micros(F.col("us") + 1_000_000).alias("arrived"))
    return T.run_and_drain(T.closed_windows(p, HOUR, 10 * MINUTE, 7 * MINUTE), "t09", T.still_open)


@query("T06_late_stream", f"""WITH {TWO} SELECT source, event_id, CAST(behind_us AS BIGINT) AS behind_us, CASE WHEN behind_us = 0 THEN NULL WHEN behind_us <= 240000000 THEN 'allowed' ELSE 'beyond' END AS reason FROM t""")
def t06_stream(spark, sf_dir):
    """Every row once: in time, late but allowed for, or for the side output."""
    return S.run_to_table(T.late_tagged(arriving(spark, sf_dir, 2), MINUTE, 4 * MINUTE), "t06")


@query("T06_late_level", f"""WITH {TWO}, l AS (SELECT source, count(*) AS total, count(*) FILTER (behind_us > 240000000) AS late FROM t GROUP BY 1)
 SELECT source, total, late, CASE WHEN late / total >= 0.005 THEN 'page' WHEN late / total >= 0.0005 THEN 'warn' ELSE 'ok' END AS level FROM l""")
def t06_level(spark, sf_dir):
    """Each source's share of rows in the side output, against its two limits."""
    rows = t06_stream(spark, sf_dir).groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("reason") == "beyond").alias("late"))
    return rows.withColumn("level", T.late_level(F.col("late"), F.col("total")))


@query("T14_completeness_stream", f"""WITH {TWO}, a AS (SELECT source, us - us % 3600000000 AS start_us, nth FROM t WHERE seen IS NULL OR us - us % 3600000000 + 3840000000 > seen - 60000000),
 w AS (SELECT source, start_us, min(nth) AS first FROM a GROUP BY ALL), k AS (SELECT w.*, class, wait, start_us + 3600000000 + wait AS due FROM w, (VALUES ('provisional', 0), ('final', 240000000)) v(class, wait)),
 e AS (SELECT k.source, k.start_us, class, min(nth) AS showing, arg_min(mark, nth) AS watermark_us FROM k JOIN t ON t.source = k.source AND nth >= first AND mark >= due GROUP BY ALL),
 n AS (SELECT e.source, e.start_us, class, watermark_us, count(*) AS n FROM e JOIN a ON a.source = e.source AND a.start_us = e.start_us AND a.nth <= showing GROUP BY ALL)
 SELECT n.source, n.start_us, n.class, n.n, CASE WHEN n.class = 'final' THEN n.n - p.n ELSE 0 END AS late_after_emit, n.watermark_us FROM n JOIN n p ON p.source = n.source AND p.start_us = n.start_us AND p.class = 'provisional'""")
def t14_stream(spark, sf_dir):
    """Hourly windows of each source as shown first and at last, with the watermark that showed them and the rows between."""
    return S.run_to_table(T.completeness(arriving(spark, sf_dir, 2), HOUR, MINUTE, 4 * MINUTE), "t14")


@query("T19_absence_stream", f"""WITH {EV}, r AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id, event_type = 'signup' AS expects, (us + 1000000) // 1000 AS ms FROM ev WHERE user_id IS NOT NULL AND event_type IN ('signup', 'purchase')),
 o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, event_id) AS nth, max(ms) OVER (PARTITION BY key) AS last FROM r), c AS (SELECT max(ms) - 3600000 AS clock FROM r),
 x AS (SELECT a.key, a.event_id, a.ms + 86400000 AS due, a.last, min(p.ms) AS met FROM o a LEFT JOIN o p ON p.key = a.key AND NOT p.expects AND p.nth > a.nth WHERE a.expects GROUP BY ALL)
 SELECT key, event_id, 'timely' AS status FROM x WHERE met <= due UNION ALL SELECT key, event_id, 'late' FROM x WHERE met > due AND met <= due + 86400000
 UNION ALL SELECT key, event_id, 'missing' FROM x, c WHERE (met IS NULL OR met > due) AND (due < last OR due < clock)""")
def t19_stream(spark, sf_dir):
    """A purchase is expected within a day of each signup: timely, missing, or missing and then late."""
    e = arriving(spark, sf_dir, 1).filter(F.col("event_type").isin("signup", "purchase"))
    rows = e.select(F.col("user_id").alias("key"), "event_id", (F.col("event_type") == "signup").alias("expects"), F.timestamp_micros(F.col("us") + 1_000_000).alias("arrived"))
    return S.run_to_table(T.absences(rows, DAY, DAY), "t19")
