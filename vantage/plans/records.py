"""Queries over records of several tables: parsing, layouts, trees, claims and extension points."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantage.catalog import query
from vantage.functions.time import DAY, HOUR, MINUTE, whole
from vantage.operators.graph import closure
from vantage.operators.nearest import within
from vantage.operators.temporal import capped_sessions
from vantage.runtime import shared_dir
from vantage.sources.tables import EV, LI, OR, events as ev, lineitem, orders, table


def tree(spark, sf_dir) -> DataFrame:
    """Parts as a tree: each hangs on the part of a tenth of its key."""
    return table(spark, sf_dir, "part").filter(F.col("p_partkey") > 0).select(F.col("p_partkey").alias("a"), whole(F.col("p_partkey"), 10).alias("b"))


@query("S03_cdc_records", f"""WITH {EV} SELECT event_id AS lsn, user_id AS key, CASE event_type WHEN 'error' THEN 'd' WHEN 'signup' THEN 'c' ELSE 'u' END AS op, us // 1000 AS ts_ms FROM ev""")
def s03(spark, sf_dir):
    """Change records by a fixed nested schema; the event time is the source's own."""
    op = F.when(F.col("event_type") == "error", "d").when(F.col("event_type") == "signup", "c").otherwise("u")
    source = F.struct(whole(F.col("us"), 1000).alias("ts_ms"), F.col("event_id").alias("lsn"))
    raw = ev(spark, sf_dir).select(F.to_json(F.struct(op.alias("op"), F.struct(F.col("user_id").alias("key")).alias("after"), source.alias("source"))).alias("line"))
    schema = "op string, after struct<key: long>, source struct<ts_ms: long, lsn: long>"
    return raw.select(F.from_json("line", schema).alias("r")).select("r.source.lsn", "r.after.key", "r.op", "r.source.ts_ms")


@query("S04_lake_layout", f"""WITH {EV} SELECT us // 86400000000 AS dt, count(*) AS n FROM ev WHERE us // 86400000000 < 19730 GROUP BY 1""")
def s04(spark, sf_dir):
    """Partitions by day, sorted inside; the filter prunes whole folders."""
    path = f"{shared_dir(spark)}/vantage/lake-{uuid.uuid4().hex}"
    e = ev(spark, sf_dir).withColumn("dt", whole(F.col("us"), DAY))
    e.repartition("dt").sortWithinPartitions("dt", "event_type", "us").write.partitionBy("dt").parquet(path)
    return spark.read.parquet(path).filter(F.col("dt") < 19730).groupBy(F.col("dt").cast("long").alias("dt")).agg(F.count("*").alias("n"))


@query("S13_compaction", f"""WITH {EV} SELECT count(*) AS n, CAST(sum(cents) AS BIGINT) AS total, true AS fewer FROM ev""")
def s13(spark, sf_dir):
    base = f"{shared_dir(spark)}/vantage/compact-{uuid.uuid4().hex}"
    e = ev(spark, sf_dir)
    e.repartition(16, "event_id").write.parquet(f"{base}/small")
    small = spark.read.parquet(f"{base}/small")
    files = small.select(F.input_file_name().alias("f")).distinct().count()
    small.repartitionByRange(2, "us").sortWithinPartitions("us").write.parquet(f"{base}/large")
    large = spark.read.parquet(f"{base}/large").withColumn("f", F.input_file_name())
    return large.agg(F.count("*").alias("n"), F.sum("cents").alias("total"), (F.countDistinct("f") < files).alias("fewer"))


@query("S18_file_control", f"""WITH {OR}, f AS (SELECT o_orderkey // 500 AS file, CAST(sum(cents) AS BIGINT) AS checksum FROM o GROUP BY 1) SELECT file, CASE file % 3 WHEN 0 THEN 'skip' WHEN 1 THEN 'corrected' ELSE 'new' END AS status FROM f""")
def s18(spark, sf_dir):
    f = orders(spark, sf_dir).groupBy(whole(F.col("o_orderkey"), 500).alias("file")).agg(F.sum("cents").alias("checksum"))
    control = f.filter(F.col("file") % 3 < 2).select("file", (F.col("checksum") + F.col("file") % 3).alias("seen"))
    status = F.when(F.col("seen").isNull(), "new").when(F.col("seen") == F.col("checksum"), "skip").otherwise("corrected")
    return f.join(control, "file", "left").select("file", status.alias("status"))


@query("P04_unit_repair", f"""WITH {EV} SELECT event_id, CASE event_id % 3 WHEN 0 THEN us // 1000000 * 1000000 WHEN 1 THEN us // 1000 * 1000 ELSE us END AS us FROM ev""")
def p04(spark, sf_dir):
    """Seconds, milliseconds or microseconds, told by magnitude."""
    e = ev(spark, sf_dir)
    raw = F.when(F.col("event_id") % 3 == 0, whole(F.col("us"), 1_000_000)).when(F.col("event_id") % 3 == 1, whole(F.col("us"), 1000)).otherwise(F.col("us"))
    fixed = F.when(F.col("raw") < 10**11, F.col("raw") * 1_000_000).when(F.col("raw") < 10**14, F.col("raw") * 1000).otherwise(F.col("raw"))
    return e.withColumn("raw", raw).select("event_id", fixed.alias("us"))


@query("P05_timestamp_formats", f"""WITH {EV} SELECT event_id, us // 1000000 AS seconds, event_id % 4 = 3 AS failed FROM ev WHERE event_id % 4 <> 3 UNION ALL SELECT event_id, NULL, true FROM ev WHERE event_id % 4 = 3""")
def p05(spark, sf_dir):
    """Several formats in turn; what fits none is flagged, not dropped."""
    ts = F.timestamp_seconds(whole(F.col("us"), 1_000_000))
    text = F.when(F.col("event_id") % 4 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 4 == 1, F.date_format(ts, "dd/MM/yyyy HH:mm:ss")).when(F.col("event_id") % 4 == 2, F.date_format(ts, "yyyyMMddHHmmss")).otherwise("soon")
    formats = ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyyMMddHHmmss")
    parsed = F.coalesce(*[F.try_to_timestamp(F.col("t"), F.lit(f)) for f in formats])
    return ev(spark, sf_dir).withColumn("t", text).select("event_id", F.unix_seconds(parsed).alias("seconds"), parsed.isNull().alias("failed"))


@query("P13_flatten", f"""WITH {EV} SELECT event_id, k AS props_k, '{{"z":' || CAST(user_id AS VARCHAR) || '}}' AS props_deep FROM ev""")
def p13(spark, sf_dir):
    """Fields down to a depth become columns, what lies deeper stays JSON."""
    deep = F.struct(F.col("user_id").alias("z"))
    return ev(spark, sf_dir).select("event_id", F.struct("k", deep.alias("deep")).alias("props")).select("event_id", F.col("props.k").alias("props_k"), F.to_json("props.deep").alias("props_deep"))


@query("P14_key_cap", f"""WITH {EV}, c AS (SELECT user_id % 7 AS tenant, k, count(*) AS n FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY n DESC, k) AS pos FROM c) SELECT tenant, CASE WHEN pos <= 10 THEN CAST(k AS VARCHAR) ELSE 'overflow' END AS key, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY ALL""")
def p14(spark, sf_dir):
    c = ev(spark, sf_dir).groupBy((F.col("user_id") % 7).alias("tenant"), "k").agg(F.count("*").alias("n"))
    pos = F.row_number().over(Window.partitionBy("tenant").orderBy(F.desc("n"), "k"))
    named = c.withColumn("key", F.when(pos <= 10, F.col("k").cast("string")).otherwise("overflow"))
    return named.groupBy("tenant", "key").agg(F.sum("n").alias("n"))


@query("P15_logfmt", f"""WITH {EV} SELECT event_id, event_type AS level, CAST(user_id AS VARCHAR) AS usr FROM ev""")
def p15(spark, sf_dir):
    line = F.concat(F.lit("at=info level="), "event_type", F.lit(" usr="), F.col("user_id").cast("string"), F.lit(" note=x"))
    keys, values = (F.regexp_extract_all("line", F.lit(r"(\w+)=(\S+)"), F.lit(k)) for k in (1, 2))
    m = ev(spark, sf_dir).withColumn("line", line).select("event_id", F.map_from_arrays(keys, values).alias("m"))
    return m.select("event_id", F.col("m")["level"].alias("level"), F.col("m")["usr"].alias("usr"))


@query("A24_histogram_quantile", f"""WITH {EV}, b AS (SELECT event_type, CAST(floor(value / 50) AS BIGINT) AS b, count(*) AS n FROM ev GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY b) AS upto, sum(n) OVER (PARTITION BY event_type) AS total FROM b), h AS (SELECT event_type, min(b) AS b FROM c WHERE upto >= 0.9 * total GROUP BY 1) SELECT c.event_type, round(50 * (c.b + (0.9 * total - (upto - n)) / n), 6) AS p90 FROM c JOIN h USING (event_type, b)""")
def a24(spark, sf_dir):
    """Linear interpolation inside the bucket that holds the rank."""
    b = ev(spark, sf_dir).groupBy("event_type", F.floor(F.col("value") / 50).alias("b")).agg(F.count("*").alias("n"))
    c = b.withColumn("upto", F.sum("n").over(Window.partitionBy("event_type").orderBy("b"))).withColumn("total", F.sum("n").over(Window.partitionBy("event_type")))
    hit = c.filter(F.col("upto") >= 0.9 * F.col("total")).groupBy("event_type").agg(F.min_by(F.struct("b", "n", "upto", "total"), "b").alias("h")).select("event_type", "h.*")
    return hit.select("event_type", F.round(50 * (F.col("b") + (0.9 * F.col("total") - (F.col("upto") - F.col("n"))) / F.col("n")), 6).alias("p90"))


@query("A79_query_profile", r"""SELECT regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[0-9]+', '?', 'g') AS shape, count(*) AS calls, CAST(sum(len(html)) AS BIGINT) AS total FROM pages GROUP BY 1""")
def a79(spark, sf_dir):
    """Calls of one shape once their literals are gone."""
    shape = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]+", ""), "[0-9]+", "?")
    return table(spark, sf_dir, "pages").groupBy(shape.alias("shape")).agg(F.count("*").alias("calls"), F.sum(F.length("html")).alias("total"))


@query("W02_capped_sessions", f"""WITH RECURSIVE {EV}, e AS (SELECT user_id, us, us - lag(us) OVER (PARTITION BY user_id ORDER BY us) > 1800000000 AS gap FROM ev), s AS (SELECT user_id, min(us) AS t FROM e GROUP BY 1 UNION ALL SELECT s.user_id, min(e.us) AS t FROM s JOIN e ON e.user_id = s.user_id AND e.us > s.t AND (e.gap OR e.us - s.t > 7200000000) GROUP BY s.user_id) SELECT user_id, count(*) AS sessions FROM s GROUP BY 1""")
def w02(spark, sf_dir):
    """Sessions of a user that a gap over 30 minutes or a length over 2 hours ends, whatever the day."""
    return capped_sessions(ev(spark, sf_dir), "user_id", 30 * MINUTE, 2 * HOUR)


@query("W20_local_day", f"""WITH {EV} SELECT strftime((make_timestamp(us) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin', '%Y-%m-%d') AS day, count(*) AS n FROM ev GROUP BY 1""")
def w20(spark, sf_dir):
    """Calendar days of a zone, of 23 to 25 hours."""
    local = F.from_utc_timestamp(F.timestamp_micros("us"), "Europe/Berlin")
    return ev(spark, sf_dir).groupBy(F.date_format(local, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("X09_locale_numbers", f"""WITH {OR} SELECT o_orderkey, cents FROM o""")
def x09(spark, sf_dir):
    # 1.234,56 in one locale and 1,234.56 in the other
    plain = F.format_number(F.col("cents") / 100, 2)
    es = F.col("o_orderkey") % 2 == 0
    text = F.when(es, F.translate(plain, ",.", ".,")).otherwise(plain)
    back = F.when(es, F.translate(F.translate("t", ".", ""), ",", ".")).otherwise(F.translate("t", ",", ""))
    return orders(spark, sf_dir).withColumn("t", text).select("o_orderkey", F.round(back.cast("decimal(18,2)") * 100).cast("long").alias("cents"))


@query("X10_quantities", r"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{4,}')) AS digits FROM documents) SELECT doc_id, digits, count(*) AS n FROM x GROUP BY ALL""")
def x10(spark, sf_dir):
    """Runs of digits; units and number words are not covered."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{4,}"), F.lit(0))).alias("digits")).groupBy("doc_id", "digits").agg(F.count("*").alias("n"))


@query("X12_cue_flags", r"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations) SELECT conv_id, turn, list_has_any(w, ['not', 'no', 'never']) AS negated, list_has_any(w, ['must', 'shall', 'the']) AS obliged FROM t""")
def x12(spark, sf_dir):
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    has = lambda *x: F.arrays_overlap("w", F.array(*[F.lit(v) for v in x]))
    return table(spark, sf_dir, "conversations").withColumn("w", w).select("conv_id", "turn", has("not", "no", "never").alias("negated"), has("must", "shall", "the").alias("obliged"))


@query("X16_span_cover", r"""SELECT doc_id, greatest(0, least(n_chars, 400) - 200) AS covered, greatest(0, least(n_chars, 400) - 200) >= 100 AS relevant FROM documents""")
def x16(spark, sf_dir):
    """How much of the evidence span 200..400 a document's own span covers."""
    covered = F.greatest(F.lit(0), F.least(F.col("n_chars"), F.lit(400)) - 200)
    return table(spark, sf_dir, "documents").select("doc_id", covered.alias("covered"), (covered >= 100).alias("relevant"))


@query("R18_spans_after_rechunking", r"""WITH c AS (SELECT doc_id, unnest(generate_series(0, greatest(0, n_chars - 1) // 300)) AS i, n_chars FROM documents) SELECT doc_id, i AS chunk FROM c WHERE greatest(0, least(n_chars, (i + 1) * 300, 700) - greatest(i * 300, 500)) >= 100""")
def r18(spark, sf_dir):
    """A label is a span, so it finds its chunks however the text is cut."""
    last = whole(F.greatest(F.lit(0).cast("long"), F.col("n_chars") - 1), 300)
    c = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    cover = F.least(F.col("n_chars"), (F.col("chunk") + 1) * 300, F.lit(700)) - F.greatest(F.col("chunk") * 300, F.lit(500))
    return c.filter(cover >= 100).select("doc_id", "chunk")


@query("X18_effective_dates", f"""WITH {OR} SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE us // 86400000000 END AS day, o_orderkey % 5 = 0 AS inferred FROM o""")
def x18(spark, sf_dir):
    date = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd")
    text = F.when(F.col("o_orderkey") % 5 == 0, "no date").otherwise(F.concat(F.lit("Effective "), date, F.lit(" for all")))
    found = F.try_to_date(F.nullif(F.regexp_extract("t", r"Effective (\d{4}-\d{2}-\d{2})", 1), F.lit("")))
    return orders(spark, sf_dir).withColumn("t", text).select("o_orderkey", F.unix_date(found).cast("long").alias("day"), found.isNull().alias("inferred"))


@query("X24_json_diff", f"""WITH {EV}, s AS (SELECT event_id, event_type, k, lag(event_type) OVER w AS t0, lag(k) OVER w AS k0, lag(event_id) OVER w AS id0 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, concat_ws(',', CASE WHEN k <> k0 THEN 'k' END, CASE WHEN event_type <> t0 THEN 'type' END) AS changed FROM s WHERE id0 IS NOT NULL""")
def x24(spark, sf_dir):
    row = F.create_map(F.lit("k"), F.col("k").cast("string"), F.lit("type"), F.col("event_type"))
    s = ev(spark, sf_dir).withColumn("after", row).withColumn("before", F.lag("after").over(Window.partitionBy("user_id").orderBy("event_id"))).filter(F.col("before").isNotNull())
    diff = F.map_filter(F.map_zip_with("before", "after", lambda n, a, b: ~a.eqNullSafe(b)), lambda n, v: v)
    return s.select("event_id", F.array_join(F.array_sort(F.map_keys(diff)), ",").alias("changed"))


@query("X25_call_price", f"""WITH {LI} SELECT l_orderkey, l_linenumber, l_partkey, qty * 3 + tax * 15 AS micro, CASE WHEN qty * 3 + tax * 15 > 150 THEN 'high' WHEN qty * 3 + tax * 15 > 80 THEN 'mid' ELSE 'low' END AS tier FROM li""")
def x25(spark, sf_dir):
    micro = F.col("qty") * 3 + F.col("tax") * 15
    return lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", micro.alias("micro"), F.when(micro > 150, "high").when(micro > 80, "mid").otherwise("low").alias("tier"))


@query("X26_drain_time", f"""WITH {EV} SELECT user_id % 10 AS grp, us // 3600000000 AS h, CAST(sum(k) AS DOUBLE) / (1000 - count(*)) AS minutes FROM ev GROUP BY ALL""")
def x26(spark, sf_dir):
    return ev(spark, sf_dir).groupBy((F.col("user_id") % 10).alias("grp"), whole(F.col("us"), HOUR).alias("h")).agg((F.sum("k") / (1000 - F.count("*"))).alias("minutes"))


@query("G08_lineage_closure", r"""WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 10 AS b FROM part WHERE p_partkey > 0), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a, b FROM c""")
def g08(spark, sf_dir):
    """Every part with all that it hangs on."""
    return closure(tree(spark, sf_dir))


@query("G09_amplification", r"""WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 10 AS b FROM part WHERE p_partkey > 0), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT b AS node, round(CAST(sum(x.p_retailprice) AS DOUBLE) / any_value(y.p_retailprice), 6) AS amplification FROM c JOIN part x ON x.p_partkey = c.a JOIN part y ON y.p_partkey = c.b GROUP BY 1""")
def g09(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    down = closure(tree(spark, sf_dir)).join(p, F.col("a") == F.col("p_partkey")).groupBy("b").agg(F.sum("p_retailprice").alias("below"))
    return down.join(p, F.col("b") == F.col("p_partkey")).select(F.col("b").alias("node"), F.round(F.col("below") / F.col("p_retailprice"), 6).alias("amplification"))


@query("G10_blast_radius", r"""WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 10 AS b FROM part WHERE p_partkey > 0), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT b AS node, count(*) AS dependents FROM c GROUP BY 1""")
def g10(spark, sf_dir):
    return closure(tree(spark, sf_dir)).groupBy(F.col("b").alias("node")).agg(F.count("*").alias("dependents"))


@query("G11_hierarchy_grants", r"""WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 10 AS b FROM part WHERE p_partkey > 0), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT DISTINCT a AS tenant FROM c WHERE b IN (7, 12) UNION SELECT p_partkey FROM part WHERE p_partkey IN (7, 12)""")
def g11(spark, sf_dir):
    granted = closure(tree(spark, sf_dir)).filter(F.col("b").isin(7, 12)).select(F.col("a").alias("tenant"))
    return granted.unionByName(table(spark, sf_dir, "part").filter(F.col("p_partkey").isin(7, 12)).select(F.col("p_partkey").alias("tenant"))).distinct()


@query("G05_triangles", f"""WITH {EV}, e AS (SELECT DISTINCT least(user_id, user_id // 2 + k) AS a, greatest(user_id, user_id // 2 + k) AS b FROM ev WHERE user_id <> user_id // 2 + k) SELECT count(*) AS triangles FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b""")
def g05(spark, sf_dir):
    other = whole(F.col("user_id"), 2) + F.col("k")
    e = ev(spark, sf_dir).filter(F.col("user_id") != other).select(F.least("user_id", other).alias("a"), F.greatest("user_id", other).alias("b")).distinct()
    # edges lead from the end of lesser degree, so no id has more than about the root of twice the edges to pair up
    degree = e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    both = e.join(degree.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    low, high = F.struct(F.col("da").alias("d"), F.col("a").alias("id")), F.struct(F.col("db").alias("d"), F.col("b").alias("id"))
    e = both.select(F.least(low, high)["id"].alias("a"), F.greatest(low, high)["id"].alias("b"))
    paths = e.select("a", F.col("b").alias("m")).join(e.select(F.col("a").alias("m"), "b"), "m")
    return paths.join(e, ["a", "b"]).agg(F.count("*").alias("triangles"))


@query("R22_claim_lines", r"""SELECT conv_id, turn, 'C' || CAST(turn AS VARCHAR) AS claim, 'S' || CAST(conv_id % 5 AS VARCHAR) AS cite, len(text) AS n FROM conversations""")
def r22(spark, sf_dir):
    line = F.concat(F.lit("C"), F.col("turn").cast("string"), F.lit(" [S"), (F.col("conv_id") % 5).cast("string"), F.lit("] "), "text")
    part = lambda k: F.regexp_extract("line", r"(?s)^(C\d+) \[(S\d+)\] (.*)$", k)
    c = table(spark, sf_dir, "conversations").withColumn("line", line)
    return c.select("conv_id", "turn", part(1).alias("claim"), part(2).alias("cite"), F.length(part(3)).cast("long").alias("n"))


@query("R23_trajectory_score", r"""SELECT conv_id, (CASE WHEN count(*) <= 8 THEN 1.0 ELSE 0.0 END + CASE WHEN count(*) FILTER (role = 'assistant') > 0 THEN 1.0 ELSE 0.0 END + CASE WHEN max(len(text)) < 2000 THEN 1.0 ELSE 0.0 END) / 3 AS score FROM conversations GROUP BY 1""")
def r23(spark, sf_dir):
    one = lambda ok: F.when(ok, 1.0).otherwise(0.0)
    score = (one(F.count("*") <= 8) + one(F.count_if(F.col("role") == "assistant") > 0) + one(F.max(F.length("text")) < 2000)) / 3
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(score.alias("score"))


@query("R24_live_versions", r"""SELECT doc_id % 100 AS doc, max(doc_id) AS live, count(*) - 1 AS superseded FROM documents GROUP BY 1""")
def r24(spark, sf_dir):
    """The newest requested version wins."""
    return table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 100).alias("doc")).agg(F.max("doc_id").alias("live"), (F.count("*") - 1).alias("superseded"))


@query("R25_deletion_audit", r"""SELECT doc_id, doc_id % 700 AS lag_seconds FROM documents WHERE doc_id % 11 = 0 AND doc_id % 700 > 300""")
def r25(spark, sf_dir):
    """Deleted documents that a store still held after 300 seconds."""
    gone = table(spark, sf_dir, "documents").filter(F.col("doc_id") % 11 == 0).select("doc_id", (F.col("doc_id") % 700).alias("lag_seconds"))
    return gone.filter(F.col("lag_seconds") > 300)


@query("R27_selective_recall", r"""WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id) SELECT query_id, vec_id, score FROM p WHERE score >= 0.15 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 3""")
def r27(spark, sf_dir):
    """Every fiftieth vector's three nearest others of its label."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return within(v.filter(F.col("vec_id") % 50 == 0).withColumnRenamed("vec_id", "query_id"), v, "label", 0.15, 3).select("query_id", "vec_id", "score")


@query("R29_policy_audit", r"""SELECT conv_id % 4 AS release, avg(CASE WHEN len(text) < 100 THEN 1.0 ELSE 0.0 END) AS abstained, avg(CASE WHEN len(text) < 100 THEN 1.0 ELSE 0.0 END) <= 0.3 AS passed FROM conversations WHERE role = 'assistant' GROUP BY 1""")
def r29(spark, sf_dir):
    share = F.avg(F.when(F.length("text") < 100, 1.0).otherwise(0.0))
    return table(spark, sf_dir, "conversations").filter("role = 'assistant'").groupBy((F.col("conv_id") % 4).alias("release")).agg(share.alias("abstained"), (share <= 0.3).alias("passed"))


@query("R03_page_blocks", r"""WITH b AS (SELECT page_id, regexp_split_to_array(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<head\b.*?</head>|<footer\b.*?</footer>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?i)</?(?:p|h[1-6]|li|td|div|article|section|br)\b[^>]*>') AS parts FROM pages), e AS (SELECT page_id, generate_subscripts(parts, 1) - 1 AS pos, trim(regexp_replace(regexp_replace(unnest(parts), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS text FROM b) SELECT page_id, pos, length(text) AS n FROM e WHERE text <> ''""")
def r03(spark, sf_dir):
    """Blocks of a page without its navigation."""
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style|nav|head|footer)\b.*?</\1>", " "), r"(?s)<!--.*?-->", " ")
    blocks = F.split(body, r"(?i)</?(?:p|h[1-6]|li|td|div|article|section|br)\b[^>]*>")
    b = table(spark, sf_dir, "pages").select("page_id", F.posexplode(blocks).alias("pos", "raw"))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", "<[^>]*>", ""), r"\s+", " "))
    return b.select("page_id", "pos", text.alias("text")).filter(F.col("text") != "").select("page_id", F.col("pos").cast("long").alias("pos"), F.length("text").cast("long").alias("n"))


@query("E01_row_transform", f"""WITH {EV} SELECT event_id, CASE WHEN event_id % 109 = 0 THEN NULL ELSE cents * 2 END AS value, event_id % 109 = 0 AS failed FROM ev""")
def e01(spark, sf_dir):
    """A caller's transform before the fold; its failures stay in their rows."""
    def transform(df):
        return df.withColumn("value", F.when(F.col("event_id") % 109 == 0, F.lit("x")).otherwise((F.col("cents") * 2).cast("string")).try_cast("long"))

    return ev(spark, sf_dir).transform(transform).select("event_id", "value", F.col("value").isNull().alias("failed"))


@query("E05_conflict_policy", r"""SELECT source AS key, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY 1""")
def e05(spark, sf_dir):
    """The policy that picks a value is a parameter."""
    def resolve(df, policy):
        return df.groupBy(F.col("source").alias("key")).agg(policy("n_chars").alias("v"))

    d = table(spark, sf_dir, "documents")
    low, high = resolve(d, F.min).withColumnRenamed("v", "least"), resolve(d, F.max).withColumnRenamed("v", "most")
    return low.join(high, "key")


@query("T25_replay", r"""SELECT count(*) AS n, max(event_id) AS last FROM events""")
def t25(spark, sf_dir):
    """A replay at a bounded rate until all is read."""
    from vantage.streaming.windows import read_events, run_to_table

    return run_to_table(read_events(spark, sf_dir, files=1).select("event_id"), "t25").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
