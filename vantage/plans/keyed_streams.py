"""Queries for streams with a state of their own a key, and for how windows end."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.catalog import query
from vantage.functions.time import HOUR, whole, window_start
from vantage.sources.tables import EV, events as ev
from vantage.streaming import keyed as K
from vantage.streaming import windows as S

MOVES = " ".join(f"WHEN {{s}} = '{a}' AND {{k}} = '{kind}' THEN '{b}'" for a, kinds in K.LIFECYCLE.items() for kind, b in kinds.items())
TTL = "365 days"
STEP = "CASE " + MOVES + " END"


@query("T18_lifecycle", f"""WITH RECURSIVE {EV}, e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS n FROM ev),
 r AS (SELECT user_id, event_id, n, coalesce({STEP.format(s="'new'", k="event_type")}, 'new') AS state, {STEP.format(s="'new'", k="event_type")} IS NOT NULL AS legal FROM e WHERE n = 1
 UNION ALL SELECT e.user_id, e.event_id, e.n, coalesce({STEP.format(s="r.state", k="e.event_type")}, r.state), {STEP.format(s="r.state", k="e.event_type")} IS NOT NULL FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
 SELECT user_id, event_id, state, legal FROM r""")
def t18(spark, sf_dir):
    """Each event with its user's state after it; illegal ones are marked."""
    return S.run_to_table(K.lifecycle(S.read_events(spark, sf_dir), ttl=TTL), "t18")


@query("T05_custom_trigger", f"""WITH {EV}, n AS (SELECT user_id, event_id, row_number() OVER w AS seen, CAST(sum(cents) OVER w AS BIGINT) AS total FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING))
 SELECT * FROM n WHERE seen % 10 = 0""")
def t05(spark, sf_dir):
    """One window a user, forever, that shows itself at every tenth row."""
    return S.run_to_table(K.every_nth(S.read_events(spark, sf_dir), ttl=TTL), "t05")


@query("T08_reorder_stream", """WITH p AS (SELECT event_id % 10 AS source, event_id // 10 AS seq, event_id % 97 = 0 AS lost FROM events), l AS (SELECT source, coalesce(max(seq) FILTER (lost), -1) AS last FROM p GROUP BY 1),
 k AS (SELECT p.*, last, count(*) FILTER (NOT lost AND seq > last) OVER (PARTITION BY p.source) AS after FROM p JOIN l ON l.source = p.source), o AS (SELECT source, seq FROM k WHERE NOT lost AND (seq < last OR after >= 8 OR last = -1))
 SELECT source, seq, seq - coalesce(lag(seq) OVER (PARTITION BY source ORDER BY seq), -1) - 1 AS gap FROM o""")
def t08(spark, sf_dir):
    """Points of ten sources arrive up to four places late and some twice, one in 97 never; what waits at the end stays in the buffer."""
    e = S.read_events(spark, sf_dir).filter(F.col("event_id") % 97 != 0)
    seq = whole(F.col("event_id"), 10)
    p = e.select("ts", (F.col("event_id") % 10).alias("source"), seq.alias("seq"), (seq + (seq * 7) % 5).alias("arrived"), "event_id")
    twice = F.when(F.col("event_id") % 50 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return S.run_to_table(K.reorder(p.withColumn("copy", F.explode(twice)).withColumn("arrived", F.col("arrived") + F.col("copy")), ttl=TTL), "t08")


@query("T09_close_reason", f"""WITH {EV}, c AS (SELECT max(us) AS clock FROM ev), w AS (SELECT user_id, us - us % 3600000000 AS start_us, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total, max(us) AS newest FROM ev GROUP BY ALL)
 SELECT user_id, start_us, n, total, CASE WHEN start_us + 3600000000 <= clock - 600000000 THEN 'watermark' WHEN newest <= clock - 1200000000 THEN 'idle' ELSE 'shutdown' END AS reason FROM w, c""")
def t09(spark, sf_dir):
    """Why each window closed: the watermark passed it, its series fell idle, or the run ended (then it is partial).

    The clock is a parameter of the query: the newest event, never the wall clock.
    """
    e = ev(spark, sf_dir)
    clock = F.broadcast(e.agg(F.max("us").alias("clock")))  # one row
    w = e.groupBy("user_id", window_start("us", HOUR).alias("start_us")).agg(F.count("*").alias("n"), F.sum("cents").alias("total"), F.max("us").alias("newest"))
    passed, idle = F.col("start_us") + HOUR <= F.col("clock") - 600_000_000, F.col("newest") <= F.col("clock") - 1_200_000_000
    return w.crossJoin(clock).select("user_id", "start_us", "n", "total", F.when(passed, "watermark").when(idle, "idle").otherwise("shutdown").alias("reason"))


@query("T26_progress", f"""WITH {EV}, m AS (SELECT max(us) - 600000000 AS mark FROM ev), w AS (SELECT us - us % 3600000000 AS start_us, event_type, count(*) AS n FROM ev GROUP BY ALL), c AS (SELECT CAST(count(*) AS BIGINT) AS windows, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_closed FROM w, m WHERE start_us + 3600000000 <= mark)
 SELECT (SELECT count(*) FROM events) AS input_rows, CAST(0 AS BIGINT) AS late_rows, windows, rows_closed FROM c""")
def t26(spark, sf_dir):
    """Rows that a stream read, dropped as late, and closed windows over, as the stream itself reports them."""
    closed, progress = S.run_with_progress(S.windowed(S.read_events(spark, sf_dir), "1 hour", "10 minutes", ["event_type"]), "t26")
    out = closed.agg(F.count("*").alias("windows"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_closed"))
    return out.select(F.lit(progress["input_rows"]).cast("long").alias("input_rows"), F.lit(progress["late_rows"]).cast("long").alias("late_rows"), "windows", "rows_closed")
