"""Queries over metric points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantage.catalog import query
from vantage.functions.time import HOUR, MINUTE, window_start
from vantage.operators import metrics as M
from vantage.sources.tables import EV, events

PT = EV + """, pt0 AS (SELECT event_id, 'svc' || CAST(user_id % 5 AS VARCHAR) AS service, event_type AS name, CAST(user_id % 3 AS VARCHAR) AS region,
 CASE event_type WHEN 'click' THEN 'counter' WHEN 'view' THEN 'gauge' ELSE 'histogram' END AS kind, value, cents, us,
 'pod-' || CAST(user_id % 10 AS VARCHAR) AS source FROM ev),
 pt1 AS (SELECT *, service || chr(31) || name || chr(31) || 'region=' || region AS series FROM pt0),
 pt AS (SELECT *, row_number() OVER (PARTITION BY source, series ORDER BY event_id) AS seq FROM pt1)"""
W = "us - ((us % 3600000000) + 3600000000) % 3600000000"


def points(spark, sf_dir) -> DataFrame:
    return M.points_from_events(events(spark, sf_dir))


def broken(spark, sf_dir) -> DataFrame:
    """Points with faults planted by id, so that every rule of validation has work."""
    p = points(spark, sf_dir)
    return (
        p.withColumn("service", F.when(F.col("event_id") % 101 == 0, "").otherwise(F.col("service")))
        .withColumn("source", F.when(F.col("event_id") % 103 == 0, None).otherwise(F.col("source")))
        .withColumn("kind", F.when(F.col("event_id") % 107 == 0, "timer").otherwise(F.col("kind")))
        .withColumn("value", F.when(F.col("event_id") % 109 == 0, float("nan")).otherwise(F.col("value")))
    )


BAD = PT + """, bad AS (SELECT event_id, us, cents, series, CASE WHEN event_id % 101 = 0 THEN 'service' WHEN event_id % 103 = 0 THEN 'source'
 WHEN event_id % 107 = 0 THEN 'kind' WHEN event_id % 109 = 0 THEN 'value' END AS error FROM pt)"""
FOLD = """SELECT series, {w} AS start_us, count(*) AS n, CAST(sum(cents) AS BIGINT) AS sum_cents, min(cents) AS min_cents, max(cents) AS max_cents,
 arg_max(cents, us * 1000 - seq) AS last_cents, max(us) AS last_us, CAST(sum(cents) AS DOUBLE) / count(*) AS mean_cents FROM {t} GROUP BY ALL"""


@query("S01_point_ingest", f"WITH {BAD} SELECT event_id, coalesce(error, '') AS reason, error IS NULL AS accepted FROM bad")
def s01(spark, sf_dir):
    checked = M.validate(broken(spark, sf_dir))
    return checked.select("event_id", F.coalesce("error", F.lit("")).alias("reason"), F.col("error").isNull().alias("accepted"))


@query("P01_validate", f"WITH {BAD} SELECT coalesce(error, 'ok') AS error, count(*) AS n FROM bad GROUP BY ALL")
def p01(spark, sf_dir):
    return M.validate(broken(spark, sf_dir)).groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count("*").alias("n"))


@query("P06_series_key", f"WITH {PT} SELECT event_id, series FROM pt")
def p06(spark, sf_dir):
    return points(spark, sf_dir).select("event_id", "series")


@query("P07_partition_id", f"WITH {PT} SELECT DISTINCT series, CAST('0x' || substr(md5(series), 1, 8) AS BIGINT) % 16 AS partition FROM pt")
def p07(spark, sf_dir):
    return points(spark, sf_dir).select("series", (F.conv(F.substring(F.md5("series"), 1, 8), 16, 10).cast("long") % 16).alias("partition")).distinct()


@query("P08_selector", f"WITH {PT} SELECT series, event_id FROM pt WHERE service = 'svc1' AND region = '2' AND {W} + 3600000000 >= 1704153600000000 AND {W} < 1704240000000000")
def p08(spark, sf_dir):
    """Equal service, a subset of labels, and windows that overlap [from, to): end >= from and start < to."""
    start = window_start("us", HOUR)
    p = points(spark, sf_dir).filter((F.col("service") == "svc1") & (F.col("labels")["region"] == "2"))
    return p.filter((start + HOUR >= 1704153600000000) & (start < 1704240000000000)).select("series", "event_id")


@query("X23_label_subset", f"WITH {PT} SELECT event_id, region = '1' AS matches FROM pt")
def x23(spark, sf_dir):
    wanted = F.create_map(F.lit("region"), F.lit("1"))
    return points(spark, sf_dir).select("event_id", F.forall(F.map_entries(wanted), lambda e: F.col("labels")[e["key"]] == e["value"]).alias("matches"))


@query("X08_window_bounds", f"WITH {EV} SELECT event_id, {W} AS start_us, {W} + 3600000000 AS end_us, (us - 1800000000000000) - (((us - 1800000000000000) % 3600000000) + 3600000000) % 3600000000 AS early_us FROM ev")
def x08(spark, sf_dir):
    """Window bounds, also for times before 1970."""
    start = window_start("us", HOUR)
    return events(spark, sf_dir).select("event_id", start.alias("start_us"), (start + HOUR).alias("end_us"), window_start(F.col("us") - 1800000000000000, HOUR).alias("early_us"))


@query("A01_series_fold", f"WITH {PT} " + FOLD.format(w=W, t="pt"))
def a01(spark, sf_dir):
    return M.fold(M.validate(points(spark, sf_dir)).filter(F.col("error").isNull()), HOUR)


@query("S22_bounded_run", f"WITH {BAD}, good AS (SELECT * FROM bad WHERE error IS NULL) SELECT 'aggregates' AS part, count(*) AS n, CAST(sum(c) AS BIGINT) AS cents FROM (SELECT series, {W} AS w, sum(cents) AS c FROM good GROUP BY ALL) UNION ALL SELECT 'errors:' || error, count(*), 0 FROM bad WHERE error IS NOT NULL GROUP BY error UNION ALL SELECT 'received', count(*), 0 FROM bad")
def s22(spark, sf_dir):
    """One bounded run: aggregates, errors and statistics of the same points."""
    checked = M.validate(broken(spark, sf_dir))
    folded = M.fold(checked.filter(F.col("error").isNull()), HOUR)
    bad = checked.filter(F.col("error").isNotNull()).groupBy("error").agg(F.count("*").alias("n"))
    return (
        folded.agg(F.lit("aggregates").alias("part"), F.count("*").alias("n"), F.sum("sum_cents").alias("cents"))
        .unionByName(bad.select(F.concat(F.lit("errors:"), "error").alias("part"), "n", F.lit(0).cast("long").alias("cents")))
        .unionByName(checked.agg(F.lit("received").alias("part"), F.count("*").alias("n"), F.lit(0).cast("long").alias("cents")))
    )


DELTA = f"""d AS (SELECT series, source, {W} AS start_us, cents, lag(cents) OVER (PARTITION BY series, source, {W} ORDER BY seq) AS prev FROM pt WHERE kind = 'counter')
 SELECT series, start_us, CAST(sum(CASE WHEN prev IS NULL THEN 0 WHEN cents < prev THEN cents ELSE cents - prev END) AS BIGINT) AS delta_cents,
 count(*) FILTER (cents < prev) AS resets, CAST(sum(CASE WHEN prev IS NULL THEN 0 WHEN cents < prev THEN cents ELSE cents - prev END) AS DOUBLE) / 3600.0 AS rate FROM d GROUP BY ALL"""


@query("A02_counter_delta", f"WITH {PT}, {DELTA}")
def a02(spark, sf_dir):
    return M.counter_deltas(points(spark, sf_dir), HOUR)


@query("T11_ordered_stream_fold", f"WITH {PT}, {DELTA}")
def t11(spark, sf_dir):
    """The counter fold after points came scrambled and were put in order by seq."""
    scrambled = points(spark, sf_dir).repartition("event_id")
    return M.counter_deltas(scrambled, HOUR)


@query("A03_gauge_last", f"""WITH {PT}, g AS (SELECT series, {W} AS start_us, cents, us, seq, max(us) OVER (PARTITION BY series, {W} ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM pt WHERE kind = 'gauge')
 SELECT series, start_us, arg_max(cents, us * 1000 - seq) AS last_cents, count(*) FILTER (us < seen) AS out_of_order FROM g GROUP BY ALL""")
def a03(spark, sf_dir):
    return M.gauge_last(points(spark, sf_dir), HOUR)


SK = "sk AS (SELECT name, CAST(ceil(round(ln(value) / ln(1.025), 9)) AS BIGINT) AS bucket, count(*) AS n FROM pt GROUP BY ALL)"
QUANT = """r AS (SELECT name, bucket, sum(n) OVER (PARTITION BY name ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY name) AS total FROM sk)
 SELECT name, CAST(max(total) AS BIGINT) AS n, round(2 * pow(1.025, arg_min(bucket, upto)) / 2.025, 6) AS value FROM r WHERE upto >= greatest(1, ceil({q} * total)) GROUP BY name"""


@query("A04_sketch_quantile", f"WITH {PT}, {SK}, " + QUANT.format(q=0.95))
def a04(spark, sf_dir):
    return M.sketch_quantile(M.sketch(points(spark, sf_dir), ["name"]), ["name"], 0.95)


@query("A05_sketch_merge", f"WITH {PT}, {SK}, " + QUANT.format(q=0.5))
def a05(spark, sf_dir):
    """Sketches of each source, merged, answer as one sketch of all points."""
    return M.sketch_quantile(M.merge_sketches(M.sketch(points(spark, sf_dir), ["name", "source"]), ["name"]), ["name"], 0.5)


@query("A06_merge_aggregates", f"""WITH {PT}, f AS (SELECT series, source, {W} AS start_us, count(*) AS n, sum(cents) AS s, min(cents) AS mi, max(cents) AS ma, arg_max(cents, us * 1000 - seq) AS l, max(us) AS lu FROM pt GROUP BY ALL)
 SELECT series, start_us, CAST(sum(n) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS sum_cents, min(mi) AS min_cents, max(ma) AS max_cents, arg_max(l, CAST(lu AS HUGEINT) * 1000000 + l) AS last_cents, CAST(sum(n) AS DOUBLE) / 3600.0 AS per_second FROM f GROUP BY ALL""")
def a06(spark, sf_dir):
    p = points(spark, sf_dir)
    keyed = M.fold(p.withColumn("series", F.concat_ws("\x1e", "series", "source")), HOUR)
    return M.merge_aggregates(keyed.withColumn("series", F.substring_index("series", "\x1e", 1)), HOUR)


@query("A07_window_quality", f"""WITH {PT}, q AS (SELECT series, {W} AS start_us, us, seq, max(us) OVER (PARTITION BY series ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen,
 lag(seq) OVER (PARTITION BY series, source ORDER BY seq) AS prev FROM pt WHERE event_id % 97 <> 0)
 SELECT series, start_us, count(*) FILTER (us < seen - 60000000) AS late, CAST(coalesce(sum(greatest(seq - prev - 1, 0)), 0) AS BIGINT) AS gaps, count(*) FILTER (us < seen) AS out_of_order,
 count(*) FILTER (us < seen - 60000000) > 0 OR coalesce(sum(greatest(seq - prev - 1, 0)), 0) > 0 AS partial FROM q GROUP BY ALL""")
def a07(spark, sf_dir):
    return M.window_quality(points(spark, sf_dir).filter(F.col("event_id") % 97 != 0), HOUR, MINUTE)


@query("A08_error_report", f"""WITH {BAD}, r AS (SELECT *, row_number() OVER (PARTITION BY error ORDER BY event_id) AS pos FROM bad WHERE error IS NOT NULL)
 SELECT error, count(*) AS n, string_agg(CASE WHEN pos <= 32 THEN CAST(event_id AS VARCHAR) END, ',' ORDER BY event_id) AS first_ids, count(*) FILTER (pos > 32) AS dropped_detail FROM r GROUP BY error""")
def a08(spark, sf_dir):
    return M.error_report(M.validate(broken(spark, sf_dir)))


@query("A09_pipeline_stats", f"""WITH {BAD} SELECT count(*) AS received, count(*) FILTER (error IS NULL) AS folded, count(*) FILTER (error IS NOT NULL) AS rejected, count(DISTINCT series) AS series, min(us) AS oldest_us, max(us) AS newest_us FROM bad""")
def a09(spark, sf_dir):
    return M.validate(broken(spark, sf_dir)).agg(
        F.count("*").alias("received"), F.count_if(F.col("error").isNull()).alias("folded"), F.count_if(F.col("error").isNotNull()).alias("rejected"),
        F.countDistinct("series").alias("series"), F.min("us").alias("oldest_us"), F.max("us").alias("newest_us"),
    )


@query("A10_store_occupancy", f"""WITH {PT}, f AS (SELECT series, {W} AS w FROM pt GROUP BY ALL), m AS (SELECT max(w) - 86400000000 AS keep FROM f)
 SELECT count(DISTINCT series) AS series, count(*) AS aggregates, min(w) AS oldest, max(w) AS newest, count(*) FILTER (w < keep) AS evicted FROM f, m""")
def a10(spark, sf_dir):
    """What a store would hold, and what a day of retention would evict."""
    folded = M.fold(points(spark, sf_dir), HOUR)
    newest = folded.agg((F.max("start_us") - 24 * HOUR).alias("keep"))
    return folded.crossJoin(F.broadcast(newest)).agg(
        F.countDistinct("series").alias("series"), F.count("*").alias("aggregates"), F.min("start_us").alias("oldest"), F.max("start_us").alias("newest"), F.count_if(F.col("start_us") < F.col("keep")).alias("evicted")
    )


@query("A65_label_cardinality", f"WITH {PT} SELECT name, count(DISTINCT series) AS series, count(DISTINCT service) AS services, count(DISTINCT region) AS regions, count(DISTINCT service) * count(DISTINCT region) AS bound FROM pt GROUP BY name")
def a65(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("region", F.col("labels")["region"])
    out = p.groupBy("name").agg(F.countDistinct("series").alias("series"), F.countDistinct("service").alias("services"), F.countDistinct("region").alias("regions"))
    return out.withColumn("bound", F.col("services") * F.col("regions"))


@query("A67_source_quarantine", f"WITH {PT} SELECT source, count(*) AS total, count(*) FILTER (event_id % 11 = 0 OR source = 'pod-3') AS bad, CAST(count(*) FILTER (event_id % 11 = 0 OR source = 'pod-3') AS DOUBLE) / count(*) AS share FROM pt GROUP BY source HAVING count(*) >= 20 AND CAST(count(*) FILTER (event_id % 11 = 0 OR source = 'pod-3') AS DOUBLE) / count(*) > 0.5")
def a67(spark, sf_dir):
    """Sources whose share of bad points exceeds a half after at least 20 points."""
    bad = (F.col("event_id") % 11 == 0) | (F.col("source") == "pod-3")
    out = points(spark, sf_dir).groupBy("source").agg(F.count("*").alias("total"), F.count_if(bad).alias("bad")).withColumn("share", F.col("bad") / F.col("total"))
    return out.filter((F.col("total") >= 20) & (F.col("share") > 0.5))


@query("K01_query_page", f"WITH {PT}, f AS (SELECT series, {W} AS start_us, count(*) AS n FROM pt GROUP BY ALL) SELECT * FROM f ORDER BY start_us, series LIMIT 100")
def k01(spark, sf_dir):
    return M.fold(points(spark, sf_dir), HOUR).select("series", "start_us", "n").orderBy("start_us", "series").limit(100)


@query("K02_emit_order", f"WITH {PT}, f AS (SELECT series, {W} AS start_us, count(*) AS n FROM pt GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY start_us ORDER BY series) AS place FROM f")
def k02(spark, sf_dir):
    folded = M.fold(points(spark, sf_dir), HOUR).select("series", "start_us", "n")
    return folded.withColumn("place", F.row_number().over(Window.partitionBy("start_us").orderBy("series")).cast("long"))


@query("W04_reorder", f"""WITH {PT}, a AS (SELECT * FROM pt WHERE event_id % 97 <> 0 UNION ALL SELECT * FROM pt WHERE event_id % 50 = 0), o AS (SELECT series, source, seq, arg_min(cents, event_id) AS cents, count(*) - 1 AS dups FROM a GROUP BY ALL)
 SELECT series, source, seq, cents, dups, coalesce(seq - lag(seq) OVER (PARTITION BY series, source ORDER BY seq) - 1, 0) AS gap FROM o""")
def w04(spark, sf_dir):
    p = points(spark, sf_dir)
    return M.reorder(p.filter(F.col("event_id") % 97 != 0).unionByName(p.filter(F.col("event_id") % 50 == 0)))


@query("S05_merge_upsert", f"""WITH {PT} SELECT series, {W} AS start_us, count(*) AS n, CAST(sum(cents) AS BIGINT) AS sum_cents, min(cents) AS min_cents, max(cents) AS max_cents FROM pt GROUP BY ALL""")
def s05(spark, sf_dir):
    """Two batches upserted into one store by merging equal keys rather than overwriting them."""
    p = points(spark, sf_dir)
    first, second = (M.fold(p.filter(F.col("event_id") % 2 == k), HOUR) for k in (0, 1))
    return M.merge_aggregates(first.unionByName(second), HOUR).select("series", "start_us", "n", "sum_cents", "min_cents", "max_cents")


@query("T12_failure_isolation", f"WITH {PT} SELECT series, count(*) FILTER (event_id % 109 <> 0) AS folded, count(*) FILTER (event_id % 109 = 0) AS dropped, count(*) FILTER (event_id % 109 = 0) > 0 AS partial FROM pt GROUP BY series")
def t12(spark, sf_dir):
    """A value that doesn't parse drops its row alone and marks the series partial."""
    raw = F.when(F.col("event_id") % 109 == 0, F.lit("oops")).otherwise(F.col("cents").cast("string"))
    parsed = points(spark, sf_dir).withColumn("parsed", raw.try_cast("long"))
    return parsed.groupBy("series").agg(F.count("parsed").alias("folded"), F.count_if(F.col("parsed").isNull()).alias("dropped")).withColumn("partial", F.col("dropped") > 0)
