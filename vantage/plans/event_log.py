"""Queries over the events table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.catalog import query
from vantage.functions.time import DAY, HOUR, MINUTE, whole, window_start
from vantage.operators import temporal as T
from vantage.operators.heavy import heavy_hitters
from vantage.sources.tables import EV, events as ev

ING = "ing AS (SELECT *, us + CASE WHEN event_id % 20 = 0 THEN ((event_id * 7919) % 1000) * 1000000 ELSE 1000000 END AS ingest_us FROM ev)"


def ingested(spark, sf_dir) -> DataFrame:
    """Events with an ingest time; one in twenty is late."""
    wait = F.when(F.col("event_id") % 20 == 0, (F.col("event_id") * 7919) % 1000).otherwise(1)
    return ev(spark, sf_dir).withColumn("ingest_us", F.col("us") + wait * 1_000_000)


def hash32(column: str) -> Column:
    """A hash of 32 bits that any engine can compute: the first digits of MD5."""
    return F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 8), 16, 10).cast("long")


@query("S02_envelope", f"""WITH {EV} SELECT event_id, event_type, us, 'producer-' || CAST(user_id % 4 AS VARCHAR) AS producer, 1 AS schema_version, 'tenant-' || CAST(user_id % 7 AS VARCHAR) AS tenant FROM ev""")
def s02(spark, sf_dir):
    """Envelopes read with a fixed schema, never an inferred one."""
    raw = ev(spark, sf_dir).select(F.to_json(F.struct("event_id", "event_type", "us", F.concat(F.lit("producer-"), F.col("user_id") % 4).alias("producer"), F.lit(1).alias("schema_version"), F.concat(F.lit("tenant-"), F.col("user_id") % 7).alias("tenant"))).alias("line"))
    fixed = "event_id long, event_type string, us long, producer string, schema_version int, tenant string"
    return raw.select(F.from_json("line", fixed).alias("e")).select("e.*")


@query("S06_last_version", f"""WITH {EV} SELECT user_id, max(event_id) AS version, arg_max(cents, event_id) AS cents FROM ev GROUP BY user_id""")
def s06(spark, sf_dir):
    """The highest version of each key wins."""
    return ev(spark, sf_dir).groupBy("user_id").agg(F.max("event_id").alias("version"), F.max_by("cents", "event_id").alias("cents"))


@query("S07_routing", f"""WITH {EV} SELECT 'archive' AS destination, count(*) AS n FROM ev UNION ALL SELECT 'hot', count(*) FILTER (event_type IN ('error','purchase')) FROM ev UNION ALL SELECT 'siem', count(*) FILTER (event_type = 'error') FROM ev UNION ALL SELECT 'dead', count(*) FILTER (value < 1) FROM ev""")
def s07(spark, sf_dir):
    """One pass sends a row to all its destinations."""
    e = ev(spark, sf_dir)
    to = F.array_compact(F.array(F.lit("archive"), F.when(F.col("event_type").isin("error", "purchase"), "hot"), F.when(F.col("event_type") == "error", "siem"), F.when(F.col("value") < 1, "dead")))
    return e.select(F.explode(to).alias("destination")).groupBy("destination").agg(F.count("*").alias("n"))


@query("S08_dead_letters", f"""WITH {EV} SELECT event_id, CASE WHEN value < 1 THEN 'value' WHEN k IS NULL OR k = 0 THEN 'props' END AS reason, 'validate' AS stage FROM ev WHERE value < 1 OR k IS NULL OR k = 0""")
def s08(spark, sf_dir):
    reason = F.when(F.col("value") < 1, "value").when(F.col("k").isNull() | (F.col("k") == 0), "props")
    return ev(spark, sf_dir).withColumn("reason", reason).filter(F.col("reason").isNotNull()).select("event_id", "reason", F.lit("validate").alias("stage"))


@query("S09_reproducible_export", f"""WITH {EV}, {ING} SELECT count(*) FILTER (ingest_us <= 1704500000000000) AS exported, count(*) FILTER (ingest_us > 1704500000000000) AS late, CAST(count(*) FILTER (ingest_us > 1704500000000000) AS DOUBLE) / count(*) AS late_share FROM ing WHERE us >= 1704153600000000 AND us < 1704500000000000""")
def s09(spark, sf_dir):
    """A range of event time, cut at an ingest time so that a repeat gives the same rows."""
    e = ingested(spark, sf_dir).filter((F.col("us") >= 1704153600000000) & (F.col("us") < 1704500000000000))
    late = F.col("ingest_us") > 1704500000000000
    return e.agg(F.count_if(~late).alias("exported"), F.count_if(late).alias("late"), (F.count_if(late) / F.count("*")).alias("late_share"))


@query("S10_amendments", f"""WITH {EV}, {ING} SELECT event_id, us, ingest_us FROM ing WHERE us < 1704240000000000 AND ingest_us > 1704240000000000""")
def s10(spark, sf_dir):
    """Rows of a closed window that arrived after its cutoff."""
    return ingested(spark, sf_dir).filter((F.col("us") < 1704240000000000) & (F.col("ingest_us") > 1704240000000000)).select("event_id", "us", "ingest_us")


@query("S14_hot_cold_view", f"""WITH {EV} SELECT event_type, count(*) AS n FROM ev GROUP BY 1""")
def s14(spark, sf_dir):
    """Hot and cold tables meet at a boundary without overlap."""
    e, edge = ev(spark, sf_dir), 1704672000000000
    both = e.filter(F.col("us") >= edge).unionByName(e.filter(F.col("us") < edge))
    return both.groupBy("event_type").agg(F.count("*").alias("n"))


@query("S15_final_view", f"""WITH {EV}, w AS (SELECT (us - (((us) % 86400000000) + 86400000000) % 86400000000) AS day, count(*) AS n FROM ev GROUP BY 1), m AS (SELECT max(us) AS newest FROM ev) SELECT day, n, CASE WHEN day + 86400000000 <= newest - 3600000000 THEN 'final' ELSE 'provisional' END AS class FROM w, m""")
def s15(spark, sf_dir):
    e = ev(spark, sf_dir)
    newest = e.agg(F.max("us").alias("newest"))
    days = e.groupBy(window_start("us", DAY).alias("day")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(newest))
    return days.select("day", "n", F.when(F.col("day") + DAY <= F.col("newest") - HOUR, "final").otherwise("provisional").alias("class"))


@query("S19_incremental_read", f"""WITH {EV}, m AS (SELECT max(us) AS newest FROM ev) SELECT event_id FROM ev, m WHERE us > 1704400000000000 AND us <= newest - 3600000000""")
def s19(spark, sf_dir):
    """From the last successful mark to now less a late buffer."""
    e = ev(spark, sf_dir)
    ceiling = e.agg((F.max("us") - HOUR).alias("upto"))
    return e.crossJoin(F.broadcast(ceiling)).filter((F.col("us") > 1704400000000000) & (F.col("us") <= F.col("upto"))).select("event_id")


@query("S20_missing_runs", f"""WITH {EV}, g AS (SELECT unnest(generate_series(min(us) // 3600000000, max(us) // 3600000000)) AS h FROM ev), r AS (SELECT DISTINCT us // 3600000000 AS h FROM ev WHERE event_id % 3 = 0) SELECT h FROM g WHERE h NOT IN (SELECT h FROM r)""")
def s20(spark, sf_dir):
    """Hours of the schedule without a run."""
    e = ev(spark, sf_dir).withColumn("h", whole(F.col("us"), HOUR))
    grid = e.agg(F.min("h").alias("a"), F.max("h").alias("z")).select(F.explode(F.sequence("a", "z")).alias("h"))
    return grid.join(e.filter(F.col("event_id") % 3 == 0).select("h").distinct(), "h", "left_anti")


@query("S23_ranged_replace", f"""WITH {EV} SELECT (us - (((us) % 86400000000) + 86400000000) % 86400000000) AS day, count(*) AS n FROM ev WHERE NOT ((us - (((us) % 86400000000) + 86400000000) % 86400000000) = 1704153600000000 AND event_type = 'error') GROUP BY 1""")
def s23(spark, sf_dir):
    """A backfill drops its range and puts the new rows there."""
    e = ev(spark, sf_dir).withColumn("day", window_start("us", DAY))
    old = e.groupBy("day").agg(F.count("*").alias("n"))
    new = e.filter((F.col("day") == 1704153600000000) & (F.col("event_type") != "error")).groupBy("day").agg(F.count("*").alias("n"))
    return old.filter(F.col("day") != 1704153600000000).unionByName(new)


@query("P02_future_skew", f"""WITH {EV}, m AS (SELECT max(us) - 86400000000 AS now FROM ev) SELECT event_id FROM ev, m WHERE us <= now + 300000000""")
def p02(spark, sf_dir):
    e = ev(spark, sf_dir)
    return e.crossJoin(F.broadcast(e.agg((F.max("us") - DAY).alias("now")))).filter(F.col("us") <= F.col("now") + 5 * MINUTE).select("event_id")


@query("P03_clamp_time", f"""WITH {EV}, {ING} SELECT event_id, CASE WHEN event_id % 53 = 0 THEN ingest_us ELSE us END AS event_us, us AS reported_us, event_id % 53 = 0 AS clamped FROM ing""")
def p03(spark, sf_dir):
    """Implausible event times become the ingest time; what was reported stays."""
    e = ingested(spark, sf_dir)
    wild = F.when(F.col("event_id") % 53 == 0, F.col("us") + 40 * DAY).otherwise(F.col("us"))
    far = (wild > F.col("ingest_us") + DAY) | (wild < F.col("ingest_us") - 30 * DAY)
    return e.select("event_id", F.when(far, F.col("ingest_us")).otherwise(wild).alias("event_us"), F.col("us").alias("reported_us"), far.alias("clamped"))


@query("P12_levels", f"""WITH {EV} SELECT event_type AS level_raw, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 2 WHEN 'purchase' THEN 3 WHEN 'error' THEN 4 ELSE 2 END AS level, count(*) AS n FROM ev GROUP BY ALL""")
def p12(spark, sf_dir):
    rank = F.create_map(*[F.lit(x) for p in {"view": 1, "click": 2, "signup": 2, "purchase": 3, "error": 4}.items() for x in p])
    return ev(spark, sf_dir).groupBy(F.col("event_type").alias("level_raw"), F.coalesce(rank[F.col("event_type")], F.lit(2)).alias("level")).agg(F.count("*").alias("n"))


@query("P20_head_sampling", f"""WITH {EV} SELECT event_id, user_id, 10.0::DOUBLE AS weight FROM ev WHERE CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR)),1,8)) AS BIGINT) < 429496729""")
def p20(spark, sf_dir):
    """All rows of a sampled user; each stands for ten."""
    return ev(spark, sf_dir).filter(hash32("user_id") < 429496729).select("event_id", "user_id", F.lit(10.0).alias("weight"))


@query("P21_rate_sampling", f"""WITH {EV}, r AS (SELECT event_type, least(1.0, 500.0 / count(*)) AS rate FROM ev GROUP BY 1) SELECT event_id, 1 / rate AS weight FROM ev JOIN r USING (event_type) WHERE CAST(('0x' || substr(md5(CAST(event_id AS VARCHAR)),1,8)) AS BIGINT) < rate * 4294967296.0""")
def p21(spark, sf_dir):
    """Each key's rate is its target over what was observed before sampling."""
    e = ev(spark, sf_dir)
    rates = e.groupBy("event_type").agg(F.least(F.lit(1.0), 500.0 / F.count("*")).alias("rate"))
    return e.join(rates, "event_type").filter(hash32("event_id") < F.col("rate") * 4294967296.0).select("event_id", (1 / F.col("rate")).alias("weight"))


@query("P22_tail_sampling", f"""WITH {EV}, t AS (SELECT *, user_id * 100000 + us // 86400000000 AS trace FROM ev), m AS (SELECT trace, bool_or(event_type = 'error') AS keep FROM t GROUP BY 1) SELECT t.event_id FROM t JOIN m USING (trace) WHERE keep OR CAST(('0x' || substr(md5(CAST(trace AS VARCHAR)),1,8)) AS BIGINT) < 42949672""")
def p22(spark, sf_dir):
    """Traces with an error whole, and one in a hundred of the others."""
    t = ev(spark, sf_dir).withColumn("trace", F.col("user_id") * 100000 + whole(F.col("us"), DAY))
    kept = t.withColumn("keep", F.max(F.col("event_type") == "error").over(Window.partitionBy("trace")))
    return kept.filter(F.col("keep") | (hash32("trace") < 42949672)).select("event_id")


@query("P23_never_sample", f"""WITH {EV} SELECT event_id FROM ev WHERE event_type = 'error' OR value > 400 OR user_id = 7 OR CAST(('0x' || substr(md5(CAST(event_id AS VARCHAR)),1,8)) AS BIGINT) < 42949672""")
def p23(spark, sf_dir):
    guard = (F.col("event_type") == "error") | (F.col("value") > 400) | (F.col("user_id") == 7)
    return ev(spark, sf_dir).filter(guard | (hash32("event_id") < 42949672)).select("event_id")


@query("P33_null_key_guard", f"""WITH {EV} SELECT CASE WHEN k IS NULL OR k = 0 THEN 'aside' ELSE 'keyed' END AS route, count(*) AS n FROM ev GROUP BY 1""")
def p33(spark, sf_dir):
    return ev(spark, sf_dir).groupBy(F.when(F.col("k").isNull() | (F.col("k") == 0), "aside").otherwise("keyed").alias("route")).agg(F.count("*").alias("n"))


@query("J01_asof_left", f"""WITH {EV} SELECT c.event_id, c.user_id, v.cents AS last_view FROM (SELECT * FROM ev WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT user_id, us, max(cents) AS cents FROM ev WHERE event_type = 'view' GROUP BY ALL) v ON c.user_id = v.user_id AND c.us >= v.us""")
def j01(spark, sf_dir):
    e = ev(spark, sf_dir)
    views = e.filter(F.col("event_type") == "view").groupBy("user_id", "us").agg(F.max("cents").alias("cents"))
    out = T.asof_join(e.filter(F.col("event_type") == "click").select("event_id", "user_id", "us"), views, "user_id", "us", "cents", "last_view").select("event_id", "user_id", "last_view")
    return out


@query("J02_asof_inner", f"""WITH {EV} SELECT * FROM (SELECT c.event_id, c.user_id, v.cents AS last_view FROM (SELECT * FROM ev WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT user_id, us, max(cents) AS cents FROM ev WHERE event_type = 'view' GROUP BY ALL) v ON c.user_id = v.user_id AND c.us >= v.us) WHERE last_view IS NOT NULL""")
def j02(spark, sf_dir):
    e = ev(spark, sf_dir)
    views = e.filter(F.col("event_type") == "view").groupBy("user_id", "us").agg(F.max("cents").alias("cents"))
    out = T.asof_join(e.filter(F.col("event_type") == "click").select("event_id", "user_id", "us"), views, "user_id", "us", "cents", "last_view").select("event_id", "user_id", "last_view")
    return out.filter(F.col("last_view").isNotNull())


@query("J03_latest_before", f"""WITH {EV} SELECT c.event_id, c.user_id, v.cents AS last_view FROM (SELECT * FROM ev WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT user_id, us, max(cents) AS cents FROM ev WHERE event_type = 'view' GROUP BY ALL) v ON c.user_id = v.user_id AND c.us >= v.us""")
def j03(spark, sf_dir):
    """The correlated form; its pairs grow with the square of a key's rows, so asof_join() is for large keys."""
    e = ev(spark, sf_dir)
    views = e.filter(F.col("event_type") == "view").select("user_id", F.col("us").alias("v_us"), "cents")
    clicks = e.filter(F.col("event_type") == "click").select("event_id", "user_id", "us")
    best = clicks.join(views, "user_id").filter(F.col("v_us") <= F.col("us")).groupBy("event_id").agg(F.max_by("cents", F.struct("v_us", "cents")).alias("last_view"))
    return clicks.join(best, "event_id", "left").select("event_id", "user_id", "last_view")


@query("J06_attribution", f"""WITH {EV}, v AS (SELECT user_id, us, arg_max(event_id, event_id) AS id FROM ev WHERE event_type = 'view' GROUP BY ALL) SELECT c.user_id, c.event_id AS outcome, CASE WHEN c.us - v.us <= 86400000000 THEN v.id END AS touch FROM (SELECT * FROM ev WHERE event_type = 'purchase') c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.us >= v.us""")
def j06(spark, sf_dir):
    e = ev(spark, sf_dir)
    views = e.filter(F.col("event_type") == "view").groupBy("user_id", "us").agg(F.max("event_id").alias("id"))
    return T.attribute(views, e.filter(F.col("event_type") == "purchase").withColumnRenamed("event_id", "id"), "user_id", DAY)


@query("J07_interval_join", f"""WITH {EV} SELECT a.event_id AS signup, b.event_id AS purchase FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.us >= a.us AND b.us <= a.us + 21600000000 WHERE a.event_type = 'signup'""")
def j07(spark, sf_dir):
    """An asymmetric interval: 0 to 6 hours after."""
    e = ev(spark, sf_dir)
    a = e.filter(F.col("event_type") == "signup").select(F.col("event_id").alias("signup"), "user_id", F.col("us").alias("a_us"))
    b = e.filter(F.col("event_type") == "purchase").select(F.col("event_id").alias("purchase"), "user_id", F.col("us").alias("b_us"))
    # both sides meet on a slot of the interval's width, so that a hot user is split by time
    slot = lambda c, d=0: (whole(F.col(c), 6 * HOUR) + d).alias("slot")
    wide = a.select("*", F.explode(F.array(slot("a_us"), slot("a_us", 1))).alias("slot"))
    return wide.join(b.select("*", slot("b_us")), ["user_id", "slot"]).filter(F.col("b_us").between(F.col("a_us"), F.col("a_us") + 6 * HOUR)).select("signup", "purchase")


@query("J08_outer_interval_join", f"""WITH {EV}, m AS (SELECT a.event_id AS signup, count(*) AS n FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.us >= a.us AND b.us <= a.us + 21600000000 WHERE a.event_type = 'signup' GROUP BY 1) SELECT event_id AS signup, coalesce(n, 0) AS purchases FROM ev LEFT JOIN m ON event_id = signup WHERE event_type = 'signup'""")
def j08(spark, sf_dir):
    """What found nothing becomes a row."""
    e = ev(spark, sf_dir)
    found = j07(spark, sf_dir).groupBy("signup").agg(F.count("*").alias("n"))
    return e.filter(F.col("event_type") == "signup").select(F.col("event_id").alias("signup")).join(found, "signup", "left").select("signup", F.coalesce("n", F.lit(0)).alias("purchases"))


@query("J10_versioned_rules", f"""WITH {EV}, r(rule, valid_from, lim) AS (VALUES ('a', 0, 100), ('b', 1704153600000000, 200), ('c', 1704326400000000, 300)), x AS (SELECT *, lead(valid_from) OVER (ORDER BY valid_from) AS valid_to FROM r) SELECT event_id, rule, value > lim AS over FROM ev JOIN x ON us >= valid_from AND (valid_to IS NULL OR us < valid_to)""")
def j10(spark, sf_dir):
    """The rules in force at the event's time."""
    rules = spark.createDataFrame([("a", 0, 100), ("b", 1704153600000000, 200), ("c", 1704326400000000, 300)], "rule string, valid_from long, lim int")
    until = rules.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(F.lit(0)).orderBy("valid_from")))
    live = (F.col("us") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("us") < F.col("valid_to")))
    return ev(spark, sf_dir).join(F.broadcast(until), live).select("event_id", "rule", (F.col("value") > F.col("lim")).alias("over"))


@query("J11_lifecycle_fold", f"""WITH {EV} SELECT user_id, arg_max(event_type, event_id) AS state, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS purchases, min(us) AS first_us, max(us) AS last_us FROM ev GROUP BY 1""")
def j11(spark, sf_dir):
    return ev(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("state"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query("J12_semi_join", f"""WITH {EV} SELECT count(*) AS n FROM ev WHERE user_id IN (SELECT user_id FROM ev WHERE event_type = 'purchase' AND value > 400)""")
def j12(spark, sf_dir):
    e = ev(spark, sf_dir)
    return e.join(e.filter((F.col("event_type") == "purchase") & (F.col("value") > 400)).select("user_id"), "user_id", "left_semi").agg(F.count("*").alias("n"))


@query("A11_salted_sum", f"""WITH {EV} SELECT event_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM ev GROUP BY 1""")
def a11(spark, sf_dir):
    return T.salted_sum(ev(spark, sf_dir), "event_type", "cents", 16, F.col("event_id"))


@query("A12_adaptive_salting", f"""WITH {EV} SELECT event_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM ev GROUP BY 1""")
def a12(spark, sf_dir):
    return T.adaptive_salted_sum(ev(spark, sf_dir), "event_type", "cents", 0.25, 16, F.col("event_id"))


@query("A13_rollups", f"""WITH {EV} SELECT event_type, (us - (((us) % 86400000000) + 86400000000) % 86400000000) AS start_us, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM ev GROUP BY ALL""")
def a13(spark, sf_dir):
    return T.rollup_levels(ev(spark, sf_dir), [MINUTE, HOUR, DAY], "event_type", "us", "cents")[-1]


@query("A14_hopping_counters", f"""WITH {EV}, b AS (SELECT user_id, us // 3600000000 AS b, count(*) AS n FROM ev GROUP BY ALL) SELECT user_id, b, n, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY b RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS BIGINT) AS n6, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY b RANGE BETWEEN 23 PRECEDING AND CURRENT ROW) AS BIGINT) AS n24 FROM b""")
def a14(spark, sf_dir):
    b = ev(spark, sf_dir).groupBy("user_id", whole(F.col("us"), HOUR).alias("b")).agg(F.count("*").alias("n"))
    last = lambda k: F.sum("n").over(Window.partitionBy("user_id").orderBy("b").rangeBetween(1 - k, 0))
    return b.select("user_id", "b", "n", last(6).alias("n6"), last(24).alias("n24"))


@query("A15_pane_sliding", f"""WITH {EV}, e AS (SELECT event_type, unnest([us // 3600000000, us // 3600000000 + 1, us // 3600000000 + 2, us // 3600000000 + 3]) AS pane, cents FROM ev) SELECT event_type, pane, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM e GROUP BY ALL""")
def a15(spark, sf_dir):
    """Sliding windows of four panes: rows are summed once, then panes are."""
    panes = ev(spark, sf_dir).groupBy("event_type", whole(F.col("us"), HOUR).alias("p")).agg(F.count("*").alias("n"), F.sum("cents").alias("total"))
    spread = panes.select("event_type", F.explode(F.sequence(F.col("p"), F.col("p") + 3)).alias("pane"), "n", "total")
    return spread.groupBy("event_type", "pane").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query("A16_decayed_counter", f"""WITH {EV}, m AS (SELECT max(us) AS now FROM ev) SELECT user_id, round(sum(exp(-(now - us) / 86400000000.0)), 6) AS decayed FROM ev, m GROUP BY user_id""")
def a16(spark, sf_dir):
    e = ev(spark, sf_dir)
    now = F.broadcast(e.agg(F.max("us").alias("now")))
    return e.crossJoin(now).groupBy("user_id").agg(F.round(F.sum(F.exp(-(F.col("now") - F.col("us")) / float(DAY))), 6).alias("decayed"))


@query("A17_distincts", f"""WITH {EV} SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT k) AS keys FROM ev GROUP BY 1""")
def a17(spark, sf_dir):
    """Exact, and by bitmap where the domain is small."""
    marks = lambda c: F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position(c)))
    return ev(spark, sf_dir).groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), marks(F.col("k") + 1).alias("keys"))


@query("A18_percentiles", f"""WITH {EV} SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM ev GROUP BY 1""")
def a18(spark, sf_dir):
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = ev(spark, sf_dir).groupBy("event_type").agg(p.alias("p"))
    return out.select("event_type", *[F.round(F.col("p")[k], 6).alias(n) for k, n in enumerate(("p50", "p95", "p99"))])


@query("A19_latest_version", f"""WITH {EV} SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(cents, event_id) AS cents FROM ev GROUP BY 1""")
def a19(spark, sf_dir):
    return ev(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"), F.max_by("cents", "event_id").alias("cents"))


@query("A20_week_over_week", f"""WITH {EV}, m AS (SELECT max(us) AS now FROM ev), c AS (SELECT user_id, count(*) FILTER (us > now - 604800000000) AS this, count(*) FILTER (us <= now - 604800000000 AND us > now - 1209600000000) AS last FROM ev, m GROUP BY 1 HAVING count(*) >= 20) SELECT user_id, this, last, CAST(this - last AS DOUBLE) / nullif(last, 0) AS change FROM c ORDER BY this - last DESC, user_id LIMIT 10""")
def a20(spark, sf_dir):
    e = ev(spark, sf_dir)
    c = e.crossJoin(F.broadcast(e.agg(F.max("us").alias("now")))).groupBy("user_id").agg(
        F.count_if(F.col("us") > F.col("now") - 7 * DAY).alias("this"), F.count_if((F.col("us") <= F.col("now") - 7 * DAY) & (F.col("us") > F.col("now") - 14 * DAY)).alias("last"), F.count("*").alias("n"))
    c = c.filter(F.col("n") >= 20).withColumn("change", (F.col("this") - F.col("last")) / F.nullif("last", F.lit(0)))
    return c.orderBy(F.desc(F.col("this") - F.col("last")), "user_id").limit(10).select("user_id", "this", "last", "change")


@query("A21_funnel", f"""WITH {EV}, e AS (SELECT user_id, us, event_id, event_type FROM ev), v AS (SELECT * FROM e WHERE event_type = 'view'), c AS (SELECT * FROM e WHERE event_type = 'click'), p AS (SELECT * FROM e WHERE event_type = 'purchase'),
 two AS (SELECT v.user_id, v.us AS start, c.us, c.event_id FROM v JOIN c ON c.user_id = v.user_id AND (c.us, c.event_id) > (v.us, v.event_id) AND c.us - v.us <= 172800000000), three AS (SELECT DISTINCT two.user_id FROM two JOIN p ON p.user_id = two.user_id AND (p.us, p.event_id) > (two.us, two.event_id) AND p.us - two.start <= 172800000000)
 SELECT user_id, CAST(CASE WHEN user_id IN (SELECT user_id FROM three) THEN 3 WHEN user_id IN (SELECT user_id FROM two) THEN 2 WHEN user_id IN (SELECT user_id FROM v) THEN 1 ELSE 0 END AS INT) AS depth FROM e WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1""")
def a21(spark, sf_dir):
    return T.funnel(ev(spark, sf_dir), "user_id", ["view", "click", "purchase"], 2 * DAY)


@query("A22_sequence_count", f"""WITH {EV}, s AS (SELECT user_id, string_agg(substr(event_type, 1, 1), '' ORDER BY us, event_id) AS seq FROM ev GROUP BY 1) SELECT user_id, CAST(len(regexp_extract_all(seq, 'v+c')) AS INT) AS matches, CAST(length(seq) AS INT) AS n FROM s""")
def a22(spark, sf_dir):
    return T.count_runs_then(ev(spark, sf_dir), "user_id", "view", "click", ["view", "click", "purchase", "signup", "error"])


@query("A25_red", f"""WITH {EV} SELECT event_type, (us - (((us) % 86400000000) + 86400000000) % 86400000000) AS day, count(*) AS n, count(*) FILTER (k % 10 = 0) AS errors, CAST(count(*) FILTER (k % 10 = 0) AS DOUBLE) / count(*) AS ratio, count(*) / 86400.0 AS rate FROM ev GROUP BY ALL""")
def a25(spark, sf_dir):
    bad = F.count_if(F.col("k") % 10 == 0)
    return ev(spark, sf_dir).groupBy("event_type", window_start("us", DAY).alias("day")).agg(F.count("*").alias("n"), bad.alias("errors"), (bad / F.count("*")).alias("ratio"), (F.count("*") / 86400.0).alias("rate"))


@query("A26_use", f"""WITH {EV} SELECT user_id % 10 AS resource, CAST(sum(cents) AS DOUBLE) / (count(*) * 49000) AS utilisation, count(*) FILTER (k > 90) AS saturated, count(*) FILTER (event_type = 'error') AS errors, CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) / nullif(count(*) FILTER (event_type IN ('view', 'click')), 0) AS hit_rate FROM ev GROUP BY 1""")
def a26(spark, sf_dir):
    kind = lambda *x: F.count_if(F.col("event_type").isin(*x))
    return ev(spark, sf_dir).groupBy((F.col("user_id") % 10).alias("resource")).agg((F.sum("cents") / (F.count("*") * 49000)).alias("utilisation"), F.count_if(F.col("k") > 90).alias("saturated"), kind("error").alias("errors"), (kind("view") / F.nullif(kind("view", "click"), F.lit(0))).alias("hit_rate"))


@query("A27_error_budget", f"""WITH {EV} SELECT user_id % 7 AS tenant, count(*) FILTER (event_type <> 'error') AS good, count(*) AS total, CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*) / 0.1 AS burn_rate, 0.1 * count(*) - count(*) FILTER (event_type = 'error') AS budget_left FROM ev GROUP BY 1""")
def a27(spark, sf_dir):
    bad = F.count_if(F.col("event_type") == "error")
    return ev(spark, sf_dir).groupBy((F.col("user_id") % 7).alias("tenant")).agg((F.count("*") - bad).alias("good"), F.count("*").alias("total"), (bad / F.count("*") / 0.1).alias("burn_rate"), (0.1 * F.count("*") - bad).alias("budget_left"))


@query("A28_burn_alerts", f"""WITH {EV}, h AS (SELECT us // 3600000000 AS h, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM ev GROUP BY 1), w AS (SELECT h, CAST(bad AS DOUBLE) / n AS short, CAST(sum(bad) OVER (ORDER BY h RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS DOUBLE) / sum(n) OVER (ORDER BY h RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS long FROM h) SELECT h FROM w WHERE short > 0.3 AND long > 0.22""")
def a28(spark, sf_dir):
    """A short and a long window must both burn."""
    h = ev(spark, sf_dir).groupBy(whole(F.col("us"), HOUR).alias("h")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))
    # the hours are few: one row an hour, whatever the number of events
    w = Window.partitionBy(F.lit(0)).orderBy("h").rangeBetween(-5, 0)
    return h.filter(F.lit(True)).withColumn("long", F.sum("bad").over(w) / F.sum("n").over(w)).filter((F.col("bad") / F.col("n") > 0.3) & (F.col("long") > 0.22)).select("h")


@query("A29_freshness", f"""WITH {EV}, {ING}, d AS (SELECT * FROM ing UNION ALL SELECT * FROM ing WHERE event_id % 50 = 0) SELECT user_id % 7 AS tenant, max(ingest_us - us) AS worst_us, CAST(count(DISTINCT event_id) AS DOUBLE) / (count(DISTINCT event_id) + 5) AS completeness, CAST(count(*) - count(DISTINCT event_id) AS DOUBLE) / count(*) AS duplicate_ratio FROM d GROUP BY 1""")
def a29(spark, sf_dir):
    e = ingested(spark, sf_dir)
    d = e.unionByName(e.filter(F.col("event_id") % 50 == 0))
    ids = F.countDistinct("event_id")
    return d.groupBy((F.col("user_id") % 7).alias("tenant")).agg(F.max(F.col("ingest_us") - F.col("us")).alias("worst_us"), (ids / (ids + 5)).alias("completeness"), ((F.count("*") - ids) / F.count("*")).alias("duplicate_ratio"))


@query("A30_volume_reconciliation", f"""WITH {EV}, a AS (SELECT user_id % 7 AS tenant, us // 86400000000 AS day, count(*) AS n FROM ev GROUP BY ALL), b AS (SELECT user_id % 7 AS tenant, us // 86400000000 AS day, count(*) AS n FROM ev WHERE event_id % 97 <> 0 GROUP BY ALL) SELECT tenant, day, coalesce(a.n, 0) AS left_n, coalesce(b.n, 0) AS right_n, abs(coalesce(a.n, 0) - coalesce(b.n, 0)) <= 0.005 * coalesce(a.n, 0) AS within FROM a FULL JOIN b USING (tenant, day)""")
def a30(spark, sf_dir):
    e = ev(spark, sf_dir)
    by = lambda d, n: d.groupBy((F.col("user_id") % 7).alias("tenant"), whole(F.col("us"), DAY).alias("day")).agg(F.count("*").alias(n))
    both = by(e, "left_n").join(by(e.filter(F.col("event_id") % 97 != 0), "right_n"), ["tenant", "day"], "full").fillna(0, ["left_n", "right_n"])
    return both.withColumn("within", F.abs(F.col("left_n") - F.col("right_n")) <= 0.005 * F.col("left_n"))


@query("A33_sequence_gaps", f"""WITH {EV} SELECT user_id % 10 AS stream, max(event_id // 10) - min(event_id // 10) + 1 - count(DISTINCT event_id // 10) AS missing FROM ev WHERE event_id % 97 <> 0 GROUP BY 1 HAVING max(event_id // 10) - min(event_id // 10) + 1 - count(DISTINCT event_id // 10) > 0""")
def a33(spark, sf_dir):
    seq = whole(F.col("event_id"), 10)
    gap = F.max(seq) - F.min(seq) + 1 - F.countDistinct(seq)
    return ev(spark, sf_dir).filter(F.col("event_id") % 97 != 0).groupBy((F.col("user_id") % 10).alias("stream")).agg(gap.alias("missing")).filter(F.col("missing") > 0)


@query("A34_weighted_estimates", f"""WITH {EV}, s AS (SELECT event_type, value, 10.0 AS w FROM ev WHERE CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR)),1,8)) AS BIGINT) < 429496729) SELECT event_type, CAST(sum(w) AS DOUBLE) AS estimate, round(CAST(sum(w * value) AS DOUBLE), 4) AS total FROM s GROUP BY 1""")
def a34(spark, sf_dir):
    s = ev(spark, sf_dir).filter(hash32("user_id") < 429496729).withColumn("w", F.lit(10.0))
    return s.groupBy("event_type").agg(F.sum("w").alias("estimate"), F.round(F.sum(F.col("w") * F.col("value")), 4).alias("total"))


@query("A35_capped_labels", f"""WITH {EV}, t AS (SELECT k FROM ev GROUP BY k ORDER BY count(*) DESC, k LIMIT 20) SELECT CASE WHEN k IN (SELECT k FROM t) THEN CAST(k AS VARCHAR) ELSE 'other' END AS label, count(*) AS n FROM ev GROUP BY 1""")
def a35(spark, sf_dir):
    e = ev(spark, sf_dir)
    top = e.groupBy("k").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(20).select("k", F.lit(True).alias("kept"))
    label = F.when(F.col("kept"), F.col("k").cast("string")).otherwise("other")
    return e.join(F.broadcast(top), "k", "left").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("A36_keep_failures", f"""WITH {EV} SELECT event_type, count(*) AS n, 'sum' AS kind, NULL::BIGINT AS event_id FROM ev WHERE event_type <> 'error' GROUP BY 1 UNION ALL SELECT event_type, 1, 'row', event_id FROM ev WHERE event_type = 'error' UNION ALL SELECT event_type, 1, 'sample', event_id FROM ev WHERE event_type <> 'error' AND CAST(('0x' || substr(md5(CAST(event_id AS VARCHAR)),1,8)) AS BIGINT) < 21474836""")
def a36(spark, sf_dir):
    e = ev(spark, sf_dir)
    fine, bad = e.filter(F.col("event_type") != "error"), e.filter(F.col("event_type") == "error")
    row = lambda d, kind: d.select("event_type", F.lit(1).cast("long").alias("n"), F.lit(kind).alias("kind"), "event_id")
    sums = fine.groupBy("event_type").agg(F.count("*").alias("n")).withColumns({"kind": F.lit("sum"), "event_id": F.lit(None).cast("long")})
    return sums.unionByName(row(bad, "row")).unionByName(row(fine.filter(hash32("event_id") < 21474836), "sample"))


@query("A37_stage_counters", f"""WITH {EV} SELECT count(*) AS received, count(*) FILTER (value >= 1) AS valid, count(*) FILTER (value >= 1 AND k > 0) AS stored, count(*) - count(*) FILTER (value >= 1) AS lost_validate, count(*) FILTER (value >= 1) - count(*) FILTER (value >= 1 AND k > 0) AS lost_store FROM ev""")
def a37(spark, sf_dir):
    valid, stored = F.count_if(F.col("value") >= 1), F.count_if((F.col("value") >= 1) & (F.col("k") > 0))
    return ev(spark, sf_dir).agg(F.count("*").alias("received"), valid.alias("valid"), stored.alias("stored"), (F.count("*") - valid).alias("lost_validate"), (valid - stored).alias("lost_store"))


@query("A38_heartbeats", f"""WITH {EV}, c AS (SELECT user_id % 10 AS producer, us // 3600000000 AS h, count(*) AS claimed FROM ev GROUP BY ALL), a AS (SELECT user_id % 10 AS producer, us // 3600000000 AS h, count(*) AS arrived FROM ev WHERE event_id % 97 <> 0 GROUP BY ALL) SELECT producer, h, claimed, coalesce(arrived, 0) AS arrived FROM c LEFT JOIN a USING (producer, h) WHERE claimed <> coalesce(arrived, 0)""")
def a38(spark, sf_dir):
    e = ev(spark, sf_dir)
    by = lambda d, n: d.groupBy((F.col("user_id") % 10).alias("producer"), whole(F.col("us"), HOUR).alias("h")).agg(F.count("*").alias(n))
    both = by(e, "claimed").join(by(e.filter(F.col("event_id") % 97 != 0), "arrived"), ["producer", "h"], "left").fillna(0, ["arrived"])
    return both.filter(F.col("claimed") != F.col("arrived"))


@query("A39_canaries", f"""WITH {EV}, c AS (SELECT event_id FROM ev WHERE event_id % 200 = 0), d AS (SELECT * FROM ev WHERE event_id % 97 <> 0 UNION ALL SELECT * FROM ev WHERE event_id % 400 = 0) SELECT c.event_id, count(d.event_id) AS seen, count(d.event_id) = 1 AS passed FROM c LEFT JOIN d USING (event_id) GROUP BY 1""")
def a39(spark, sf_dir):
    e = ev(spark, sf_dir)
    d = e.filter(F.col("event_id") % 97 != 0).unionByName(e.filter(F.col("event_id") % 400 == 0)).groupBy("event_id").agg(F.count("*").alias("seen"))
    out = e.filter(F.col("event_id") % 200 == 0).select("event_id").join(d, "event_id", "left").fillna(0, ["seen"])
    return out.withColumn("passed", F.col("seen") == 1)


@query("A47_decline_mix", f"""WITH {EV}, n AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS nxt FROM ev) SELECT k % 5 AS code, k % 5 < 2 AS soft, count(*) AS n, CAST(count(*) FILTER (nxt = 'purchase') AS DOUBLE) / count(*) AS retry_success FROM n WHERE event_type = 'error' GROUP BY ALL""")
def a47(spark, sf_dir):
    n = ev(spark, sf_dir).withColumn("next", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("us", "event_id")))
    code = (F.col("k") % 5).alias("code")
    return n.filter(F.col("event_type") == "error").groupBy(code, (F.col("k") % 5 < 2).alias("soft")).agg(F.count("*").alias("n"), (F.count_if(F.col("next") == "purchase") / F.count("*")).alias("retry_success"))


@query("A58_column_profile", f"""WITH {EV} SELECT 'k' AS col, CAST(count(*) FILTER (k IS NULL OR k = 0) AS DOUBLE) / count(*) AS null_rate, CAST(min(k) AS DOUBLE) AS low, CAST(max(k) AS DOUBLE) AS high FROM ev UNION ALL SELECT 'value', CAST(count(*) FILTER (value IS NULL) AS DOUBLE) / count(*), min(value), max(value) FROM ev""")
def a58(spark, sf_dir):
    """All columns in one pass."""
    e = ev(spark, sf_dir)
    one = e.agg(*[F.struct(F.lit(c).alias("col"), (F.count_if(bad) / F.count("*")).alias("null_rate"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(c) for c, bad in (("k", F.col("k").isNull() | (F.col("k") == 0)), ("value", F.col("value").isNull()))])
    return one.select(F.inline(F.array("k", "value")))


@query("A59_share_drift", f"""WITH {EV}, d AS (SELECT us // 86400000000 AS day, event_type, count(*) AS n FROM ev GROUP BY ALL), s AS (SELECT day, event_type, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY day) AS share FROM d) SELECT day, event_type, share, share - avg(share) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS drift FROM s""")
def a59(spark, sf_dir):
    d = ev(spark, sf_dir).groupBy(whole(F.col("us"), DAY).alias("day"), "event_type").agg(F.count("*").alias("n"))
    s = d.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("day")))
    before = Window.partitionBy("event_type").orderBy("day").rowsBetween(-7, -1)
    return s.select("day", "event_type", "share", (F.col("share") - F.avg("share").over(before)).alias("drift"))


@query("A60_psi", f"""WITH {EV}, b AS (SELECT least(9, CAST(floor(value / 50) AS BIGINT)) AS bin, us < 1704672000000000 AS old FROM ev), c AS (SELECT bin, count(*) FILTER (old) + 1 AS p, count(*) FILTER (NOT old) + 1 AS q FROM b GROUP BY 1), s AS (SELECT bin, p / CAST(sum(p) OVER () AS DOUBLE) AS p, q / CAST(sum(q) OVER () AS DOUBLE) AS q FROM c) SELECT round(sum((p - q) * ln(p / q)), 8) AS psi FROM s""")
def a60(spark, sf_dir):
    c = ev(spark, sf_dir).groupBy(F.least(F.lit(9), F.floor(F.col("value") / 50)).alias("bin")).agg((F.count_if(F.col("us") < 1704672000000000) + 1).alias("p"), (F.count_if(F.col("us") >= 1704672000000000) + 1).alias("q"))
    sums = c.agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    p, r = F.col("p") / F.col("sp"), F.col("q") / F.col("sq")
    return c.crossJoin(F.broadcast(sums)).agg(F.round(F.sum((p - r) * F.log(p / r)), 8).alias("psi"))


@query("A63_lateness", f"""WITH {EV}, {ING} SELECT round(quantile_cont((ingest_us - us) / 1e6, 0.5), 4) AS p50, round(quantile_cont((ingest_us - us) / 1e6, 0.99), 4) AS p99, count(*) FILTER (ingest_us - us > 60000000) AS over_minute FROM ing""")
def a63(spark, sf_dir):
    lag = (F.col("ingest_us") - F.col("us")) / 1e6
    return ingested(spark, sf_dir).agg(F.round(F.percentile(lag, 0.5), 4).alias("p50"), F.round(F.percentile(lag, 0.99), 4).alias("p99"), F.count_if(F.col("ingest_us") - F.col("us") > MINUTE).alias("over_minute"))


@query("A64_k_anonymity", f"""WITH {EV} SELECT k, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM ev GROUP BY ALL HAVING count(DISTINCT user_id) >= 10""")
def a64(spark, sf_dir):
    """Groups are kept by their subjects, not their rows."""
    return ev(spark, sf_dir).groupBy("k", "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users")).filter(F.col("users") >= 10)


@query("A66_quota_state", f"""WITH {EV}, h AS (SELECT user_id % 7 AS tenant, us // 3600000000 AS h, count(*) AS n FROM ev GROUP BY ALL), r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY tenant ORDER BY h RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS n2 FROM h) SELECT tenant, h, CASE WHEN n2 > 16 THEN 'emergency' WHEN n2 > 12 THEN 'sustained' WHEN n > 8 THEN 'burst' ELSE 'normal' END AS state FROM r""")
def a66(spark, sf_dir):
    h = ev(spark, sf_dir).groupBy((F.col("user_id") % 7).alias("tenant"), whole(F.col("us"), HOUR).alias("h")).agg(F.count("*").alias("n"))
    two = F.sum("n").over(Window.partitionBy("tenant").orderBy("h").rangeBetween(-1, 0))
    return h.withColumn("n2", two).select("tenant", "h", F.when(F.col("n2") > 16, "emergency").when(F.col("n2") > 12, "sustained").when(F.col("n") > 8, "burst").otherwise("normal").alias("state"))


@query("A77_heavy_hitters", f"""WITH {EV} SELECT user_id, count(*) AS n FROM ev GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20""")
def a77(spark, sf_dir):
    """Bounded counters in each task choose candidates, which a second pass counts."""
    return heavy_hitters(ev(spark, sf_dir), "user_id", 20)


@query("A78_facets", f"""WITH {EV}, f AS (SELECT 'type' AS facet, event_type AS value, count(*) AS n FROM ev GROUP BY ALL UNION ALL SELECT 'key', CAST(k % 10 AS VARCHAR), count(*) FROM ev GROUP BY ALL) SELECT facet, value, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY facet) AS share FROM f""")
def a78(spark, sf_dir):
    one = F.inline(F.array(F.struct(F.lit("type").alias("facet"), F.col("event_type").alias("value")), F.struct(F.lit("key").alias("facet"), (F.col("k") % 10).cast("string").alias("value"))))
    f = ev(spark, sf_dir).select(one).groupBy("facet", "value").agg(F.count("*").alias("n"))
    return f.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("facet")))


@query("A86_key_skew", f"""WITH {EV}, c AS (SELECT user_id, count(*) AS n FROM ev GROUP BY 1) SELECT round(quantile_cont(n, 0.5), 4) AS p50, round(quantile_cont(n, 0.99), 4) AS p99, max(n) AS most, CAST(max(n) AS DOUBLE) / sum(n) AS top_share FROM c""")
def a86(spark, sf_dir):
    c = ev(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    return c.agg(F.round(F.percentile("n", 0.5), 4).alias("p50"), F.round(F.percentile("n", 0.99), 4).alias("p99"), F.max("n").alias("most"), (F.max("n") / F.sum("n")).alias("top_share"))


@query("A88_dirty_buckets", f"""WITH {EV} SELECT us // 3600000000 AS h, count(*) AS n FROM ev GROUP BY 1""")
def a88(spark, sf_dir):
    """Late rows mark buckets; only those are rebuilt from raw rows."""
    e = ev(spark, sf_dir).withColumn("h", whole(F.col("us"), HOUR))
    late = F.col("event_id") % 20 == 0
    old = e.filter(~late).groupBy("h").agg(F.count("*").alias("n"))
    dirty = e.filter(late).select("h").distinct()
    rebuilt = e.join(dirty, "h", "left_semi").groupBy("h").agg(F.count("*").alias("n"))
    return old.join(dirty, "h", "left_anti").unionByName(rebuilt)


@query("A90_backlog", f"""WITH {EV} SELECT event_type, max(k) AS worst, CAST(sum(k) AS BIGINT) AS total, arg_max(user_id, k * 1000000 - user_id) AS worst_user FROM ev GROUP BY 1""")
def a90(spark, sf_dir):
    return ev(spark, sf_dir).groupBy("event_type").agg(F.max("k").alias("worst"), F.sum("k").alias("total"), F.max_by("user_id", F.struct("k", -F.col("user_id"))).alias("worst_user"))


@query("A92_expected_arrivals", f"""WITH {EV}, h AS (SELECT us // 3600000000 AS h, count(*) AS n FROM ev GROUP BY 1), w AS (SELECT h, n, avg(n) OVER (PARTITION BY h % 24 ORDER BY h ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS expected FROM h) SELECT h, n, expected FROM w WHERE n < 0.6 * expected""")
def a92(spark, sf_dir):
    h = ev(spark, sf_dir).groupBy(whole(F.col("us"), HOUR).alias("h")).agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.col("h") % 24).orderBy("h").rowsBetween(-7, -1)
    return h.withColumn("expected", F.avg("n").over(before)).filter(F.col("n") < 0.6 * F.col("expected"))


@query("A94_record_age", f"""WITH {EV}, {ING} SELECT event_type, CASE WHEN ingest_us - us <= 5000000 THEN 5 WHEN ingest_us - us <= 60000000 THEN 60 ELSE 1000 END AS le, count(*) AS n FROM ing GROUP BY ALL""")
def a94(spark, sf_dir):
    age = F.col("ingest_us") - F.col("us")
    return ingested(spark, sf_dir).groupBy("event_type", F.when(age <= 5_000_000, 5).when(age <= MINUTE, 60).otherwise(1000).alias("le")).agg(F.count("*").alias("n"))


@query("W01_sessions", f"""WITH {EV}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) <= 1800000000 THEN 0 ELSE 1 END AS new FROM ev), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM s GROUP BY ALL""")
def w01(spark, sf_dir):
    return T.sessions(ev(spark, sf_dir), "user_id", "us", 30 * MINUTE, "event_id")


@query("W03_keep_latest", f"""WITH {EV} SELECT user_id, event_id, event_type FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) = 1""")
def w03(spark, sf_dir):
    return T.latest_per_key(ev(spark, sf_dir), ["user_id"], [F.desc("us"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("W05_velocity", f"""WITH {EV} SELECT event_id, count(*) OVER h AS n_hour, CAST(coalesce(sum(cents) OVER h, 0) AS BIGINT) AS sum_hour, count(*) OVER d AS n_day, CAST(coalesce(sum(cents) OVER d, 0) AS BIGINT) AS sum_day FROM ev WINDOW h AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING), d AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING)""")
def w05(spark, sf_dir):
    return T.trailing(ev(spark, sf_dir), "user_id", "us", {"hour": HOUR, "day": DAY}, "cents").select("event_id", "n_hour", "sum_hour", "n_day", "sum_day")


@query("W07_age_novelty", f"""WITH {EV} SELECT event_id, us - min(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS age_us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) = 1 AS first_use FROM ev""")
def w07(spark, sf_dir):
    at = Window.partitionBy("user_id").orderBy("us", "event_id")
    pair = Window.partitionBy("user_id", "event_type").orderBy("us", "event_id")
    return ev(spark, sf_dir).select("event_id", (F.col("us") - F.min("us").over(at)).alias("age_us"), (F.row_number().over(pair) == 1).alias("first_use"))


@query("W08_distinct_in_window", f"""WITH {EV} SELECT a.event_id, count(DISTINCT b.user_id) AS users FROM ev a JOIN ev b ON a.k = b.k AND b.us <= a.us AND b.us >= a.us - 86400000000 GROUP BY 1""")
def w08(spark, sf_dir):
    return T.trailing_distinct(ev(spark, sf_dir), "k", "us", "user_id", DAY).select("event_id", F.col("n").alias("users"))


@query("W10_rolling_breaker", f"""WITH {EV}, r AS (SELECT event_id, count(*) OVER w AS n, count(*) FILTER (event_type = 'error') OVER w AS bad FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 259200000000 PRECEDING AND CURRENT ROW)) SELECT event_id FROM r WHERE n >= 5 AND CAST(bad AS DOUBLE) / n > 0.4""")
def w10(spark, sf_dir):
    span = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3 * DAY, 0)
    r = ev(spark, sf_dir).withColumn("n", F.count("*").over(span)).withColumn("bad", F.sum((F.col("event_type") == "error").cast("int")).over(span))
    return r.filter((F.col("n") >= 5) & (F.col("bad") / F.col("n") > 0.4)).select("event_id")


@query("W12_card_testing", f"""WITH {EV} SELECT k, us // 86400000000 AS day, count(DISTINCT user_id) AS users, CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*) AS failed FROM ev WHERE value < 50 GROUP BY ALL HAVING count(DISTINCT user_id) >= 3 AND CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) / count(*) >= 0.3""")
def w12(spark, sf_dir):
    failed = F.count_if(F.col("event_type") == "error") / F.count("*")
    out = ev(spark, sf_dir).filter(F.col("value") < 50).groupBy("k", whole(F.col("us"), DAY).alias("day")).agg(F.countDistinct("user_id").alias("users"), failed.alias("failed"))
    return out.filter((F.col("users") >= 3) & (F.col("failed") >= 0.3))


@query("W13_context", f"""WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM ev), h AS (SELECT user_id, rn FROM n WHERE event_type = 'error' AND value > 200) SELECT DISTINCT n.event_id FROM n JOIN h ON n.user_id = h.user_id AND n.rn BETWEEN h.rn - 2 AND h.rn + 2""")
def w13(spark, sf_dir):
    """Rows around a hit, whatever the filter says of them."""
    n = ev(spark, sf_dir).withColumn("hit", ((F.col("event_type") == "error") & (F.col("value") > 200)).cast("int"))
    around = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(-2, 2)
    return n.withColumn("near", F.max("hit").over(around)).filter(F.col("near") == 1).select("event_id")


@query("W14_week_ago", f"""WITH {EV}, h AS (SELECT us // 3600000000 AS h, count(*) AS n FROM ev GROUP BY 1) SELECT a.h, a.n, a.n - b.n AS delta FROM h a LEFT JOIN h b ON b.h = a.h - 168""")
def w14(spark, sf_dir):
    h = ev(spark, sf_dir).groupBy(whole(F.col("us"), HOUR).alias("h")).agg(F.count("*").alias("n"))
    return h.join(h.select((F.col("h") + 168).alias("h"), F.col("n").alias("old")), "h", "left").select("h", "n", (F.col("n") - F.col("old")).alias("delta"))


@query("W15_adaptive_baseline", f"""WITH {EV}, d AS (SELECT user_id, us // 86400000000 AS day, CAST(sum(cents) AS BIGINT) AS c FROM ev GROUP BY ALL), b AS (SELECT *, avg(c) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS base FROM d) SELECT user_id, day, c FROM b WHERE c > greatest(2 * base, 20000) OR c > 100000""")
def w15(spark, sf_dir):
    d = ev(spark, sf_dir).groupBy("user_id", whole(F.col("us"), DAY).alias("day")).agg(F.sum("cents").alias("c"))
    base = F.avg("c").over(Window.partitionBy("user_id").orderBy("day").rowsBetween(-5, -1))
    return d.withColumn("base", base).filter((F.col("base").isNotNull() & (F.col("c") > F.greatest(2 * F.col("base"), F.lit(20000)))) | (F.col("base").isNull() & (F.col("c") > 20000)) | (F.col("c") > 100000)).select("user_id", "day", "c")


@query("W16_gap_fill", f"""WITH {EV}, g AS (SELECT unnest(generate_series(min(us) // 86400000000, max(us) // 86400000000)) AS day FROM ev), u AS (SELECT DISTINCT event_type FROM ev), c AS (SELECT us // 86400000000 AS day, event_type, count(*) AS n FROM ev WHERE k > 50 GROUP BY ALL) SELECT day, event_type, coalesce(n, 0) AS n, n IS NULL AS no_data FROM g CROSS JOIN u LEFT JOIN c USING (day, event_type)""")
def w16(spark, sf_dir):
    """Zero and no data stay apart."""
    e = ev(spark, sf_dir).withColumn("day", whole(F.col("us"), DAY))
    grid = e.groupBy("event_type").agg(F.lit(1)).select("event_type").crossJoin(F.broadcast(e.agg(F.min("day").alias("a"), F.max("day").alias("z")))).select("event_type", F.explode(F.sequence("a", "z")).alias("day"))
    c = e.filter(F.col("k") > 50).groupBy("day", "event_type").agg(F.count("*").alias("n"))
    return grid.join(c, ["day", "event_type"], "left").select("day", "event_type", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("no_data"))


@query("W18_illegal_transitions", f"""WITH {EV}, s AS (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS prev FROM ev) SELECT event_id, prev, event_type FROM s WHERE prev IS NOT NULL AND (prev, event_type) NOT IN (('view','click'),('click','purchase'),('view','view'),('click','click'),('signup','view'),('purchase','view'),('error','view'),('view','error'))""")
def w18(spark, sf_dir):
    legal = spark.createDataFrame([x.split(">") for x in "view>click click>purchase view>view click>click signup>view purchase>view error>view view>error".split()], "prev string, event_type string")
    s = ev(spark, sf_dir).withColumn("prev", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("us", "event_id"))).filter(F.col("prev").isNotNull())
    return s.join(F.broadcast(legal), ["prev", "event_type"], "left_anti").select("event_id", "prev", "event_type")


@query("W21_timeline", f"""WITH {EV} SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_type, event_id) AS place FROM ev""")
def w21(spark, sf_dir):
    return ev(spark, sf_dir).select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("us", "event_type", "event_id")).cast("long").alias("place"))


@query("K03_newest_page", f"""WITH {EV} SELECT event_id, us FROM ev WHERE event_type = 'error' ORDER BY us DESC, event_id DESC LIMIT 50""")
def k03(spark, sf_dir):
    return ev(spark, sf_dir).filter(F.col("event_type") == "error").orderBy(F.desc("us"), F.desc("event_id")).limit(50).select("event_id", "us")


@query("K08_top_per_tenant", f"""WITH {EV}, d AS (SELECT user_id % 7 AS tenant, k, count(*) AS n FROM ev GROUP BY ALL) SELECT tenant, k, n, row_number() OVER (PARTITION BY tenant ORDER BY n DESC, k) AS place FROM d QUALIFY place <= 10""")
def k08(spark, sf_dir):
    d = ev(spark, sf_dir).groupBy((F.col("user_id") % 7).alias("tenant"), "k").agg(F.count("*").alias("n"))
    at = F.row_number().over(Window.partitionBy("tenant").orderBy(F.desc("n"), "k")).cast("long")
    return d.withColumn("place", at).filter(F.col("place") <= 10)


@query("U01_union_streams", f"""WITH {EV} SELECT event_type, count(*) AS n, min(us) AS oldest FROM ev GROUP BY 1""")
def u01(spark, sf_dir):
    e = ev(spark, sf_dir)
    parts = [e.filter(F.col("user_id") % 3 == k).drop("k" if k else "props_") for k in range(3)]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True).groupBy("event_type").agg(F.count("*").alias("n"), F.min("us").alias("oldest"))


@query("D06_retry_schedule", f"""WITH {EV}, s(code, step, wait) AS (VALUES (0, 1, 3600), (0, 2, 86400), (1, 1, 86400)) SELECT event_id, step, us + CAST(wait AS BIGINT) * 1000000 AS retry_us FROM ev JOIN s ON k % 5 = code WHERE event_type = 'error'""")
def d06(spark, sf_dir):
    plan = F.create_map(F.lit(0), F.array(F.lit(3600), F.lit(86400)), F.lit(1), F.array(F.lit(86400)))
    e = ev(spark, sf_dir).filter((F.col("event_type") == "error") & (F.col("k") % 5 < 2))
    return e.select("event_id", "us", F.posexplode(plan[(F.col("k") % 5).cast("int")])).select("event_id", (F.col("pos") + 1).alias("step"), (F.col("us") + F.col("col").cast("long") * 1_000_000).alias("retry_us"))


@query("G06_component_churn", f"""WITH {EV}, a AS (SELECT DISTINCT user_id, k FROM ev WHERE us < 1704672000000000), b AS (SELECT DISTINCT user_id, k FROM ev WHERE us >= 1704672000000000) SELECT user_id, count(*) FILTER (a.k IS NULL) AS gained, count(*) FILTER (b.k IS NULL) AS lost FROM a FULL JOIN b USING (user_id, k) GROUP BY 1""")
def g06(spark, sf_dir):
    e = ev(spark, sf_dir)
    a = e.filter(F.col("us") < 1704672000000000).select("user_id", "k", F.lit(1).alias("a")).distinct()
    b = e.filter(F.col("us") >= 1704672000000000).select("user_id", "k", F.lit(1).alias("b")).distinct()
    return a.join(b, ["user_id", "k"], "full").groupBy("user_id").agg(F.count_if(F.col("a").isNull()).alias("gained"), F.count_if(F.col("b").isNull()).alias("lost"))


@query("J25_point_in_time", f"""WITH {EV}, l AS (SELECT event_id, user_id, us FROM ev WHERE event_type = 'purchase') SELECT l.event_id, count(*) FILTER (e.us < l.us) AS seen_before, count(*) AS leaky FROM l JOIN ev e ON e.user_id = l.user_id GROUP BY 1""")
def j25(spark, sf_dir):
    """Features as of the decision beside what looking ahead would give."""
    e = ev(spark, sf_dir)
    before = Window.partitionBy("user_id").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    f = e.withColumn("seen_before", F.count("*").over(before)).withColumn("leaky", F.count("*").over(Window.partitionBy("user_id")))
    return f.filter(F.col("event_type") == "purchase").select("event_id", "seen_before", "leaky")


@query("J26_parity", f"""WITH {EV} SELECT 'value' AS feature, CAST(count(*) FILTER (event_id % 211 = 0) AS DOUBLE) / count(*) AS mismatch, CAST(count(*) FILTER (event_id % 211 = 0) AS DOUBLE) / count(*) <= 0.005 AS passed FROM ev UNION ALL SELECT 'k', 0, true""")
def j26(spark, sf_dir):
    e = ev(spark, sf_dir)
    served = e.select("event_id", F.when(F.col("event_id") % 211 == 0, F.col("value") + 1).otherwise(F.col("value")).alias("s_value"), F.col("k").alias("s_k"))
    both = e.join(served, "event_id").select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), (F.abs(F.col(c) - F.col("s_" + c)) > 1e-9).alias("off")) for c in ("value", "k")])))
    return both.groupBy("feature").agg((F.count_if("off") / F.count("*")).alias("mismatch")).withColumn("passed", F.col("mismatch") <= 0.005)
