"""Queries over orders, lines and customers: money, reconciliation, rules and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.catalog import query
from vantage.functions.time import DAY, whole
from vantage.operators import quality as Q
from vantage.operators import temporal as T
from vantage.sources.tables import LI, OR, lineitem as li, orders, table

JR = "j AS (SELECT l_orderkey, 'part:' || CAST(l_partkey AS VARCHAR) AS account, us, cents FROM li UNION ALL SELECT l_orderkey, 'cash', us, -cents FROM li)"


def journal(spark, sf_dir) -> DataFrame:
    """Two entries for each line that sum to zero."""
    sides = F.array(F.struct(F.concat(F.lit("part:"), "l_partkey").alias("account"), F.col("cents").alias("cents")), F.struct(F.lit("cash").alias("account"), (-F.col("cents")).alias("cents")))
    return li(spark, sf_dir).select("l_orderkey", "us", F.explode(sides).alias("e")).select("l_orderkey", "us", "e.account", "e.cents")


def fired() -> Column:
    """Names of the rules that a line meets."""
    return F.array_compact(F.array(F.when(F.col("qty") > 40, "big"), F.when(F.col("cents") > 5000000, "dear"), F.when(F.col("disc") >= 9, "cheap")))


def edges(spark, sf_dir, most: int) -> DataFrame:
    """Distinct (order, part) edges of the parts with at most `most` orders."""
    e = li(spark, sf_dir).select("l_orderkey", "l_partkey").distinct()
    degree = e.groupBy("l_partkey").agg(F.count("*").alias("degree")).filter(F.col("degree") <= most)
    return e.join(degree, "l_partkey").select("l_orderkey", "l_partkey", "degree")


@query("S11_manifest", f"""WITH {LI} SELECT l_orderkey // 1000 AS chunk, count(*) AS n, min(us) AS first_us, max(us) AS last_us, CAST(sum(cents) AS BIGINT) AS total FROM li GROUP BY 1""")
def s11(spark, sf_dir):
    return li(spark, sf_dir).groupBy(whole(F.col("l_orderkey"), 1000).alias("chunk")).agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.sum("cents").alias("total"))


@query("S12_file_catalogue")
def s12(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "_metadata")
    return t.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n"), F.max("_metadata.file_size").alias("bytes"), F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"))


@query("S16_time_travel", f"""WITH {OR} SELECT o_custkey, arg_max(cents, CAST(us AS HUGEINT) * 100000 + o_orderkey) AS cents FROM o WHERE us <= 883612800000000 GROUP BY 1""")
def s16(spark, sf_dir):
    """The table as it stood at a time."""
    return orders(spark, sf_dir).filter(F.col("us") <= 883612800000000).groupBy("o_custkey").agg(F.max_by("cents", F.struct("us", "o_orderkey")).alias("cents"))


@query("S17_trailer_check", f"""WITH {LI} SELECT l_orderkey, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM li GROUP BY 1 HAVING l_orderkey % 10 <> 0""")
def s17(spark, sf_dir):
    """Only files whose details equal their trailer are published."""
    d = li(spark, sf_dir).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("cents").alias("total"))
    trailer = d.select("l_orderkey", F.when(F.col("l_orderkey") % 10 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("t_n"), F.col("total").alias("t_total"))
    return d.join(trailer, "l_orderkey").filter((F.col("n") == F.col("t_n")) & (F.col("total") == F.col("t_total"))).select("l_orderkey", "n", "total")


@query("S21_retention", f"""WITH {OR} SELECT o_orderkey, CASE WHEN o_custkey % 50 = 0 THEN 'hold' WHEN us > 930000000000000 THEN 'hot' WHEN us > CASE WHEN o_custkey % 7 = 0 THEN 800000000000000 ELSE 880000000000000 END THEN 'warm' ELSE 'archive' END AS tier FROM o""")
def s21(spark, sf_dir):
    """A tenant's own policy, else the default; a legal hold wins."""
    override = F.when(F.col("o_custkey") % 7 == 0, 800000000000000)
    tier = F.when(F.col("o_custkey") % 50 == 0, "hold").when(F.col("us") > 930000000000000, "hot").when(F.col("us") > F.coalesce(override, F.lit(880000000000000)), "warm").otherwise("archive")
    return orders(spark, sf_dir).select("o_orderkey", tier.alias("tier"))


@query("S24_backfill_chunks", f"""WITH {OR} SELECT o_orderkey // 1000 AS chunk, count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS filled, CAST(sum(cents) AS BIGINT) AS total FROM o GROUP BY 1""")
def s24(spark, sf_dir):
    """Only nulls are filled, so a repeat changes nothing."""
    o = orders(spark, sf_dir).withColumn("old", F.when(F.col("o_orderkey") % 3 != 0, F.col("cents")))
    done = o.withColumn("new", F.coalesce("old", "cents"))
    return done.groupBy(whole(F.col("o_orderkey"), 1000).alias("chunk")).agg(F.count("*").alias("n"), F.count_if(F.col("old").isNull()).alias("filled"), F.sum("new").alias("total"))


@query("P09_tenant_isolation", f"""WITH {OR} SELECT o_orderkey, cents FROM o WHERE o_custkey % 7 = 3""")
def p09(spark, sf_dir):
    return orders(spark, sf_dir).filter(F.col("o_custkey") % 7 == 3).select("o_orderkey", "cents")


@query("P10_grants_mask", f"""SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN c_name END AS c_name, c_mktsegment FROM customer WHERE c_nationkey < 10""")
def p10(spark, sf_dir):
    grants = spark.createDataFrame([(k, k < 5) for k in range(10)], "c_nationkey int, sees_name boolean")
    c = table(spark, sf_dir, "customer").join(F.broadcast(grants), "c_nationkey")
    return c.select("c_custkey", F.when(F.col("sees_name"), F.col("c_name")).alias("c_name"), "c_mktsegment")


@query("P24_hash_sample", f"""WITH {OR} SELECT o_orderkey FROM o WHERE CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)),1,8)) AS BIGINT) % 100 < CASE o_orderpriority WHEN '1-URGENT' THEN 10 ELSE 2 END""")
def p24(spark, sf_dir):
    """A stratified sample that a repeat draws again."""
    h = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 8), 16, 10).cast("long")
    return orders(spark, sf_dir).filter(h % 100 < F.when(F.col("o_orderpriority") == "1-URGENT", 10).otherwise(2)).select("o_orderkey")


@query("P27_masking", f"""SELECT c_custkey, sha256('s1' || c_name) AS token, substr(c_name, 1, 8) || '***' AS partial, NULL::VARCHAR AS dropped FROM customer""")
def p27(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.concat(F.lit("s1"), "c_name"), 256).alias("token"), F.concat(F.substring("c_name", 1, 8), F.lit("***")).alias("partial"), F.lit(None).cast("string").alias("dropped"))


@query("P30_identity_hash", f"""WITH {LI} SELECT l_orderkey, l_linenumber, l_partkey, sha256(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, cents, qty, us)) AS id FROM li""")
def p30(spark, sf_dir):
    cols = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents", "qty", "us")]
    return li(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", F.sha2(F.concat_ws("|", *cols), 256).alias("id"))


@query("P31_vocabulary", f"""WITH {OR} SELECT 'status' AS name, 'validity' AS dimension, CAST(count(*) FILTER (o_orderstatus IN ('O','F')) AS DOUBLE)/count(*) AS share, 0.9 AS threshold, 'error' AS severity, CAST(count(*) FILTER (o_orderstatus IN ('O','F')) AS DOUBLE)/count(*) >= 0.9 AS passed FROM o""")
def p31(spark, sf_dir):
    return Q.run_checks(orders(spark, sf_dir), [("status", "validity", F.col("o_orderstatus").isin("O", "F"), 0.9, "error")])


@query("P32_sargable_range", f"""WITH {LI} SELECT l_orderkey, l_linenumber, l_partkey FROM li WHERE us >= 883612800000000 AND us < 886291200000000""")
def p32(spark, sf_dir):
    """A month as a range on the column itself, which reaches the scan."""
    t = table(spark, sf_dir, "lineitem").filter("l_shipdate >= TIMESTAMP_NTZ'1998-01-01' AND l_shipdate < TIMESTAMP_NTZ'1998-02-01'")
    return t.select("l_orderkey", "l_linenumber", "l_partkey")


@query("P34_normalise", f"""SELECT c_custkey, nullif(trim(c_mktsegment), '') AS segment, lower(c_name) AS name, CAST(round(c_acctbal*100) AS BIGINT) AS cents FROM customer""")
def p34(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.nullif(F.trim("c_mktsegment"), F.lit("")).alias("segment"), F.lower("c_name").alias("name"), F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))


@query("P35_case_collisions", f"""WITH c AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END AS k FROM customer) SELECT lower(k) AS folded, count(DISTINCT k) AS spellings FROM c GROUP BY 1 HAVING count(DISTINCT k) > 1""")
def p35(spark, sf_dir):
    k = F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    return table(spark, sf_dir, "customer").groupBy(F.lower(k).alias("folded")).agg(F.countDistinct(k).alias("spellings")).filter(F.col("spellings") > 1)


@query("J04_temporal_join", f"""WITH {OR}, v AS (SELECT o_custkey, us AS vf, arg_max(cents, cents) AS cents FROM o WHERE o_orderkey % 2 = 0 GROUP BY ALL), i AS (SELECT *, lead(vf) OVER (PARTITION BY o_custkey ORDER BY vf) AS vt FROM v) SELECT o.o_orderkey, i.cents AS price FROM o JOIN i ON o.o_custkey = i.o_custkey AND o.us >= vf AND (vt IS NULL OR o.us < vt) WHERE o_orderkey % 2 = 1""")
def j04(spark, sf_dir):
    """valid_from <= t < valid_to, as a running last value instead of a range join."""
    o = orders(spark, sf_dir)
    v = o.filter(F.col("o_orderkey") % 2 == 0).groupBy("o_custkey", "us").agg(F.max("cents").alias("cents"))
    return T.asof_join(o.filter(F.col("o_orderkey") % 2 == 1).select("o_orderkey", "o_custkey", "us"), v, "o_custkey", "us", "cents", "price").filter(F.col("price").isNotNull()).select("o_orderkey", "price")


@query("J05_scd2", f"""WITH {OR}, c AS (SELECT o_custkey, us, o_orderstatus, o_orderkey FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey, us ORDER BY o_orderkey) = 1), d AS (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY us) AS b FROM c), e AS (SELECT * FROM d WHERE b IS NULL OR b <> o_orderstatus) SELECT o_custkey, o_orderstatus, us AS valid_from, lead(us) OVER (PARTITION BY o_custkey ORDER BY us) AS valid_to, lead(us) OVER (PARTITION BY o_custkey ORDER BY us) IS NULL AS is_current FROM e""")
def j05(spark, sf_dir):
    c = T.latest_per_key(orders(spark, sf_dir), ["o_custkey", "us"], [F.asc("o_orderkey")])
    return T.validity(c, "o_custkey", "us", "o_orderstatus")


@query("J09_enrichment", f"""WITH {OR} SELECT o_orderkey, CASE WHEN c_custkey % 20 = 0 OR c_custkey IS NULL THEN 'unknown' ELSE c_mktsegment END AS segment FROM o LEFT JOIN customer ON o_custkey = c_custkey""")
def j09(spark, sf_dir):
    """A miss becomes unknown; the planner broadcasts the dimension only if it is small."""
    dim = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 20 != 0).select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return orders(spark, sf_dir).join(dim, "o_custkey", "left").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("unknown")).alias("segment"))


@query("J16_three_way", f"""WITH {OR} SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'only_left' WHEN o_orderkey % 10 = 0 THEN 'tolerated' ELSE 'matched' END AS class, CASE WHEN o_orderkey % 400 = 0 THEN 0 ELSE 2 END AS postings, count(*) AS n FROM o GROUP BY ALL""")
def j16(spark, sf_dir):
    """Authorisations, clearing and postings of the same orders."""
    auth = orders(spark, sf_dir)
    clearing = auth.filter(F.col("o_orderkey") % 50 != 0).select("o_orderkey", (F.col("cents") + (F.col("o_orderkey") % 10 == 0).cast("int")).alias("cents"))
    posted = auth.filter(F.col("o_orderkey") % 400 != 0).select("o_orderkey", F.explode(F.array("cents", -F.col("cents"))).alias("c")).groupBy("o_orderkey").agg(F.count("*").alias("p"))
    both = Q.reconcile(auth, clearing, ["o_orderkey"], "cents", tolerance=1).join(posted, "o_orderkey", "left")
    return both.groupBy("class", F.coalesce("p", F.lit(0)).cast("int").alias("postings")).agg(F.count("*").alias("n"))


@query("J17_tolerance_match", f"""WITH {OR} SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'break' WHEN o_orderkey % 5 = 0 THEN 'amount' WHEN o_orderkey % 3 = 0 THEN 'date' ELSE 'exact' END AS stage FROM o""")
def j17(spark, sf_dir):
    a = orders(spark, sf_dir).select("o_orderkey", "us", "cents")
    k = F.col("o_orderkey")
    b = a.select("o_orderkey", F.when(k % 5 == 0, F.col("us")).when(k % 3 == 0, F.col("us") + DAY).otherwise(F.col("us")).alias("b_us"), F.when(k % 17 == 0, F.col("cents") + 500).when(k % 5 == 0, F.col("cents") + 2).otherwise(F.col("cents")).alias("b_cents"))
    j = a.join(b, "o_orderkey")
    days, gap = F.abs(F.col("us") - F.col("b_us")), F.abs(F.col("cents") - F.col("b_cents"))
    stage = F.when((days == 0) & (gap == 0), "exact").when((days <= 2 * DAY) & (gap == 0), "date").when((days <= 2 * DAY) & (gap <= 2), "amount").otherwise("break")
    return j.select("o_orderkey", stage.alias("stage"))


@query("J18_row_diff", f"""WITH {OR} SELECT o_orderkey, CASE WHEN o_orderkey % 70 = 0 THEN 'removed' ELSE 'changed' END AS change FROM o WHERE o_orderkey % 70 = 0 OR o_orderkey % 90 = 1""")
def j18(spark, sf_dir):
    a = orders(spark, sf_dir).select("o_orderkey", F.col("cents").alias("x"))
    b = orders(spark, sf_dir).filter(F.col("o_orderkey") % 70 != 0).select("o_orderkey", F.when(F.col("o_orderkey") % 90 == 1, None).otherwise(F.col("cents")).alias("y"), F.lit(True).alias("there"))
    j = a.join(b, "o_orderkey", "full").filter(F.col("there").isNull() | ~F.col("x").eqNullSafe(F.col("y")))
    return j.select("o_orderkey", F.when(F.col("there").isNull(), "removed").otherwise("changed").alias("change"))


@query("J19_orphans", f"""WITH {LI} SELECT l_orderkey, l_linenumber, l_partkey FROM li WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 100 <> 0)""")
def j19(spark, sf_dir):
    o = orders(spark, sf_dir).filter(F.col("o_orderkey") % 100 != 0)
    return li(spark, sf_dir).join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber", "l_partkey")


@query("J20_top_per_group", f"""WITH {OR}, t AS (SELECT o_custkey, o_orderkey, cents FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY cents DESC, o_orderkey) <= 3) SELECT * FROM t ORDER BY cents DESC, o_orderkey LIMIT 50""")
def j20(spark, sf_dir):
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("cents"), "o_orderkey"))
    return orders(spark, sf_dir).select("o_custkey", "o_orderkey", "cents").withColumn("at", at).filter(F.col("at") <= 3).drop("at").orderBy(F.desc("cents"), "o_orderkey").limit(50)


@query("J21_dimension_semi", f"""WITH {OR} SELECT count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM o WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def j21(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "MACHINERY").select(F.col("c_custkey").alias("o_custkey"))
    return orders(spark, sf_dir).join(c, "o_custkey", "left_semi").agg(F.count("*").alias("n"), F.sum("cents").alias("total"))


@query("J22_cooccurrence", f"""WITH {LI}, d AS (SELECT DISTINCT l_orderkey, l_suppkey % 20 AS r FROM li) SELECT a.r AS a, b.r AS b, count(*) AS n FROM d a JOIN d b ON a.l_orderkey = b.l_orderkey AND a.r < b.r GROUP BY ALL HAVING count(*) >= 5""")
def j22(spark, sf_dir):
    d = li(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_suppkey") % 20)).alias("r"))
    # at most 20 rules an order, so at most 190 pairs
    pair = F.flatten(F.transform("r", lambda x: F.transform(F.filter("r", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return d.select(F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")).filter(F.col("n") >= 5)


@query("J23_backoff", f"""WITH {LI}, p AS (SELECT l_partkey, avg(cents) AS m FROM li GROUP BY 1 HAVING count(*) >= 30), s AS (SELECT l_suppkey, avg(cents) AS m FROM li GROUP BY 1 HAVING count(*) >= 30), g AS (SELECT avg(cents) AS m FROM li) SELECT l_orderkey, l_linenumber, li.l_partkey, round(coalesce(p.m, s.m, g.m), 4) AS profile, CASE WHEN p.m IS NOT NULL THEN 'part' WHEN s.m IS NOT NULL THEN 'supplier' ELSE 'all' END AS level FROM li LEFT JOIN p ON li.l_partkey = p.l_partkey LEFT JOIN s ON li.l_suppkey = s.l_suppkey, g""")
def j23(spark, sf_dir):
    l = li(spark, sf_dir)
    mean = lambda key, out: l.groupBy(key).agg(F.avg("cents").alias(out), F.count("*").alias("n")).filter(F.col("n") >= 30).drop("n")
    j = l.join(mean("l_partkey", "p"), "l_partkey", "left").join(mean("l_suppkey", "s"), "l_suppkey", "left").crossJoin(F.broadcast(l.agg(F.avg("cents").alias("g"))))
    level = F.when(F.col("p").isNotNull(), "part").when(F.col("s").isNotNull(), "supplier").otherwise("all")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.coalesce("p", "s", "g"), 4).alias("profile"), level.alias("level"))


@query("J24_grain_guard", f"""WITH {LI} SELECT 'orders' AS side, max(n) AS most, max(n) = 1 AS one FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey) UNION ALL SELECT 'lines', max(n), max(n) = 1 FROM (SELECT count(*) AS n FROM li GROUP BY l_orderkey)""")
def j24(spark, sf_dir):
    most = lambda d, key, name: d.groupBy(key).agg(F.count("*").alias("n")).agg(F.lit(name).alias("side"), F.max("n").alias("most"), (F.max("n") == 1).alias("one"))
    return most(orders(spark, sf_dir), "o_orderkey", "orders").unionByName(most(li(spark, sf_dir), "l_orderkey", "lines"))


@query("J27_evidence_pack", f"""WITH {OR} SELECT o_orderkey, c_mktsegment, n_name, (SELECT count(*) FROM orders) >= 0 AS has_model FROM o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def j27(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "n_name")
    return orders(spark, sf_dir).join(c, "o_custkey").select("o_orderkey", "c_mktsegment", "n_name", F.lit(True).alias("has_model"))


@query("J29_two_way_sync", f"""SELECT c_custkey, c_name AS name, c_mktsegment AS segment, c_custkey % 13 = 0 AS conflict FROM customer""")
def j29(spark, sf_dir):
    """Side a owns the name, side b the segment; a contested segment is a conflict."""
    c = table(spark, sf_dir, "customer")
    a = c.select("c_custkey", F.col("c_name").alias("a_name"), F.when(F.col("c_custkey") % 13 == 0, "other").otherwise(F.col("c_mktsegment")).alias("a_segment"))
    b = c.select("c_custkey", F.lit("stale").alias("b_name"), F.col("c_mktsegment").alias("b_segment"))
    j = a.join(b, "c_custkey", "full")
    return j.select("c_custkey", F.col("a_name").alias("name"), F.col("b_segment").alias("segment"), (~F.col("a_segment").eqNullSafe(F.col("b_segment"))).alias("conflict"))


@query("J30_versioned_enrichment", f"""WITH {LI} SELECT l_orderkey, l_linenumber, l_partkey, p_brand, p_size % 3 AS dim_version FROM li JOIN part ON l_partkey = p_partkey""")
def j30(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", (F.col("p_size") % 3).alias("dim_version"))
    return li(spark, sf_dir).join(p, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "p_brand", "dim_version")


@query("A31_rate_decomposition", f"""WITH {OR} SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(count(*) FILTER (cents > 20000000) AS DOUBLE)/count(*) AS rate FROM o GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())""")
def a31(spark, sf_dir):
    o = orders(spark, sf_dir)
    return o.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), (F.count_if(F.col("cents") > 20000000) / F.count("*")).alias("rate"))


@query("A32_daily_rollup", f"""WITH {LI} SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(qty) AS BIGINT) AS qty, CAST(sum(cents * (100 - disc)) AS BIGINT) AS net FROM li GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def a32(spark, sf_dir):
    return li(spark, sf_dir).rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"), F.sum(F.col("cents") * (100 - F.col("disc"))).alias("net"))


@query("A40_balance", f"""WITH {LI}, {JR} SELECT account, CAST(sum(cents) AS BIGINT) AS balance FROM j WHERE us <= 883612800000000 GROUP BY 1""")
def a40(spark, sf_dir):
    return Q.balance(journal(spark, sf_dir), "account", 883612800000000)


@query("A41_snapshot_delta", f"""WITH {LI}, {JR} SELECT account, CAST(sum(cents) AS BIGINT) AS balance FROM j GROUP BY 1""")
def a41(spark, sf_dir):
    """The latest snapshot and what came after it."""
    j = journal(spark, sf_dir)
    snapshot = Q.balance(j, "account", 883612800000000)
    later = j.filter(F.col("us") > 883612800000000).groupBy("account").agg(F.sum("cents").alias("balance"))
    return snapshot.unionByName(later).groupBy("account").agg(F.sum("balance").alias("balance"))


@query("A42_balanced_groups", f"""WITH {LI}, {JR} SELECT l_orderkey, CAST(sum(cents) AS BIGINT) AS off FROM j WHERE NOT (l_orderkey % 400 = 0 AND account = 'cash') GROUP BY 1 HAVING sum(cents) <> 0""")
def a42(spark, sf_dir):
    j = journal(spark, sf_dir).filter(~((F.col("l_orderkey") % 400 == 0) & (F.col("account") == "cash")))
    return j.groupBy("l_orderkey").agg(F.sum("cents").alias("off")).filter(F.col("off") != 0)


@query("A43_memo_residue", f"""WITH {OR} SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN -cents ELSE cents END) AS BIGINT) AS residue FROM o WHERE us < 883612800000000 - 604800000000 GROUP BY 1 HAVING sum(CASE WHEN o_orderstatus = 'F' THEN -cents ELSE cents END) <> 0""")
def a43(spark, sf_dir):
    signed = F.when(F.col("o_orderstatus") == "F", -F.col("cents")).otherwise(F.col("cents"))
    return orders(spark, sf_dir).filter(F.col("us") < 883612800000000 - 7 * DAY).groupBy("o_custkey").agg(F.sum(signed).alias("residue")).filter(F.col("residue") != 0)


@query("A44_payout", f"""WITH {OR}, a AS (SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN cents ELSE 0 END) - sum(cents) // 20 - sum(CASE WHEN o_orderkey % 50 = 0 THEN cents ELSE 0 END) AS BIGINT) AS available FROM o GROUP BY 1) SELECT o_custkey, available FROM a WHERE available >= 100000""")
def a44(spark, sf_dir):
    part = lambda cond: F.sum(F.when(cond, F.col("cents")).otherwise(0))
    available = part(F.col("o_orderstatus") == "O") - F.floor(F.sum("cents") / 20).cast("long") - part(F.col("o_orderkey") % 50 == 0)
    return orders(spark, sf_dir).groupBy("o_custkey").agg(available.alias("available")).filter(F.col("available") >= 100000)


@query("A45_payment_status", f"""WITH {LI}, c AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS refunded, count(*) FILTER (l_linestatus = 'F') AS captured FROM li GROUP BY 1) SELECT l_orderkey, CASE WHEN refunded = n THEN 'refunded' WHEN refunded > 0 THEN 'partially_refunded' WHEN captured = n THEN 'captured' WHEN captured > 0 THEN 'partially_captured' ELSE 'authorised' END AS status FROM c""")
def a45(spark, sf_dir):
    c = li(spark, sf_dir).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_if(F.col("l_linestatus") == "F").alias("c"))
    status = F.when(F.col("r") == F.col("n"), "refunded").when(F.col("r") > 0, "partially_refunded").when(F.col("c") == F.col("n"), "captured").when(F.col("c") > 0, "partially_captured").otherwise("authorised")
    return c.select("l_orderkey", status.alias("status"))


@query("A46_dispute_ratio", f"""WITH {OR}, m AS (SELECT us // 2592000000000 AS month, count(*) AS n, count(*) FILTER (o_orderkey % 120 = 0) AS disputes FROM o GROUP BY 1) SELECT month, n, disputes, CASE WHEN CAST(disputes AS DOUBLE)/n >= 0.009 THEN 'breach' WHEN CAST(disputes AS DOUBLE)/n >= 0.0065 THEN 'warn' ELSE 'ok' END AS state FROM m""")
def a46(spark, sf_dir):
    m = orders(spark, sf_dir).groupBy(whole(F.col("us"), 30 * DAY).alias("month")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderkey") % 120 == 0).alias("disputes"))
    ratio = F.col("disputes") / F.col("n")
    return m.withColumn("state", F.when(ratio >= 0.009, "breach").when(ratio >= 0.0065, "warn").otherwise("ok"))


@query("A48_duplicate_charges", f"""WITH {LI}, d AS (SELECT l_orderkey, l_linenumber, l_partkey, us - lag(us) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY us, l_orderkey, l_linenumber) AS gap FROM li) SELECT l_orderkey, l_linenumber, l_partkey FROM d WHERE gap <= 604800000000""")
def a48(spark, sf_dir):
    at = Window.partitionBy("l_partkey", "l_suppkey").orderBy("us", "l_orderkey", "l_linenumber")
    return li(spark, sf_dir).withColumn("gap", F.col("us") - F.lag("us").over(at)).filter(F.col("gap") <= 7 * DAY).select("l_orderkey", "l_linenumber", "l_partkey")


@query("A49_cost_budget", f"""WITH {LI}, c AS (SELECT l_suppkey % 7 AS tenant, l_orderkey, l_linenumber, l_partkey, us, qty * 3 AS cost FROM li), r AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY tenant, us ORDER BY l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM c) SELECT l_orderkey, l_linenumber, l_partkey, spent, spent > 300 AS breach FROM r""")
def a49(spark, sf_dir):
    day = Window.partitionBy("tenant", "us").orderBy("l_orderkey", "l_linenumber", "l_partkey").rowsBetween(Window.unboundedPreceding, 0)
    c = li(spark, sf_dir).withColumn("tenant", F.col("l_suppkey") % 7).withColumn("spent", F.sum(F.col("qty") * 3).over(day))
    return c.select("l_orderkey", "l_linenumber", "l_partkey", "spent", (F.col("spent") > 300).alias("breach"))


@query("A50_showback", f"""WITH {LI}, m AS (SELECT l_suppkey % 7 AS line, us // 2592000000000 AS month, CAST(sum(cents) AS BIGINT) AS cost FROM li GROUP BY ALL) SELECT line, month, cost, cost - lag(cost) OVER (PARTITION BY line ORDER BY month) AS delta FROM m""")
def a50(spark, sf_dir):
    m = li(spark, sf_dir).groupBy((F.col("l_suppkey") % 7).alias("line"), whole(F.col("us"), 30 * DAY).alias("month")).agg(F.sum("cents").alias("cost"))
    return m.withColumn("delta", F.col("cost") - F.lag("cost").over(Window.partitionBy("line").orderBy("month")))


@query("A51_call_ledger", f"""WITH {LI}, r AS (SELECT l_orderkey, CAST(sum(qty) AS BIGINT) AS tokens FROM li GROUP BY 1) SELECT count(*) AS runs, round(quantile_cont(tokens, 0.99), 4) AS p99, (SELECT CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE)/count(*) FROM li) AS escalated FROM r""")
def a51(spark, sf_dir):
    l = li(spark, sf_dir)
    runs = l.groupBy("l_orderkey").agg(F.sum("qty").alias("tokens"), F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("e"))
    return runs.agg(F.count("*").alias("runs"), F.round(F.percentile("tokens", 0.99), 4).alias("p99"), (F.sum("e") / F.sum("n")).alias("escalated"))


@query("A52_cost_per_outcome", f"""WITH {OR} SELECT o_orderpriority, count(*) AS settled, CAST(sum(cents) AS DOUBLE) / nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS per_accepted FROM o WHERE us < 930000000000000 GROUP BY 1""")
def a52(spark, sf_dir):
    return orders(spark, sf_dir).filter(F.col("us") < 930000000000000).groupBy("o_orderpriority").agg(F.count("*").alias("settled"), (F.sum("cents") / F.nullif(F.count_if(F.col("o_orderstatus") == "F"), F.lit(0))).alias("per_accepted"))


@query("A53_blended_rate", f"""WITH {LI} SELECT l_returnflag, round(CAST(sum(cents * (100 - disc)) AS DOUBLE) / sum(cents * 100), 8) AS rate, CAST(sum(cents * disc) AS BIGINT) AS residual FROM li GROUP BY 1""")
def a53(spark, sf_dir):
    return li(spark, sf_dir).groupBy("l_returnflag").agg(F.round(F.sum(F.col("cents") * (100 - F.col("disc"))) / F.sum(F.col("cents") * 100), 8).alias("rate"), F.sum(F.col("cents") * F.col("disc")).alias("residual"))


@query("A54_allocation", f"""WITH {LI}, g AS (SELECT l_orderkey, l_linenumber, l_partkey, qty, 10000 AS total, sum(qty) OVER (PARTITION BY l_orderkey) AS w FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, CAST(sum(qty) AS BIGINT) AS qty FROM li GROUP BY ALL)), f AS (SELECT *, total * qty // w AS base, total * qty % w AS rest FROM g), h AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY rest DESC, l_linenumber) AS pos, total - sum(base) OVER (PARTITION BY l_orderkey) AS l FROM f) SELECT l_orderkey, l_linenumber, CAST(base + CASE WHEN pos <= l THEN 1 ELSE 0 END AS BIGINT) AS amount FROM h""")
def a54(spark, sf_dir):
    g = li(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(F.sum("qty").alias("qty")).withColumn("total", F.lit(10000).cast("long"))
    return Q.allocate(g, "l_orderkey", "l_linenumber", "qty", "total").select("l_orderkey", "l_linenumber", "amount")


@query("A55_rounding", f"""WITH {LI} SELECT l_orderkey, l_linenumber, l_partkey, (cents * tax + 50) // 100 AS half_up, CASE WHEN cents * tax % 100 = 50 THEN (cents * tax // 100) + (cents * tax // 100) % 2 ELSE (cents * tax + 50) // 100 END AS half_even, cents * tax // 100 AS truncated FROM li""")
def a55(spark, sf_dir):
    x = (F.col("cents") * F.col("tax")).cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")
    return li(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", F.round(x, 0).cast("long").alias("half_up"), F.bround(x, 0).cast("long").alias("half_even"), F.floor(x).cast("long").alias("truncated"))


@query("A56_chunk_checksums", f"""WITH {OR} SELECT o_orderkey // 500 AS chunk, count(*) AS n, md5(string_agg(md5(concat_ws('|', coalesce(CAST(o_orderkey AS VARCHAR),'~'), coalesce(CAST(o_custkey AS VARCHAR),'~'), coalesce(CAST(cents AS VARCHAR),'~'))), '' ORDER BY o_orderkey)) AS checksum FROM o GROUP BY 1""")
def a56(spark, sf_dir):
    return Q.chunk_checksums(orders(spark, sf_dir), "o_orderkey", ["o_orderkey", "o_custkey", "cents"], 500)


@query("A57_migration_invariants", f"""WITH {OR} SELECT 'rows' AS what, count(*) AS v FROM o UNION ALL SELECT 'total', CAST(sum(cents) AS BIGINT) FROM o UNION ALL SELECT 'nulls', count(*) FILTER (o_custkey IS NULL) FROM o UNION ALL SELECT 'status:' || o_orderstatus, count(*) FROM o GROUP BY o_orderstatus""")
def a57(spark, sf_dir):
    o = orders(spark, sf_dir)
    one = o.agg(F.count("*").alias("rows"), F.sum("cents").alias("total"), F.count_if(F.col("o_custkey").isNull()).alias("nulls"))
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("v")) for c in ("rows", "total", "nulls")])))
    return rows.unionByName(o.groupBy(F.concat(F.lit("status:"), "o_orderstatus").alias("what")).agg(F.count("*").alias("v")))


@query("A61_rate_bands", f"""WITH {OR}, r AS (SELECT o_orderstatus, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM o) AS rate FROM o GROUP BY 1) SELECT o_orderstatus, rate, rate BETWEEN 0.2 AND 0.5 AS in_band FROM r""")
def a61(spark, sf_dir):
    o = orders(spark, sf_dir)
    r = o.groupBy("o_orderstatus").agg(F.count("*").alias("n")).crossJoin(F.broadcast(o.agg(F.count("*").alias("all")))).withColumn("rate", F.col("n") / F.col("all"))
    return r.select("o_orderstatus", "rate", F.col("rate").between(0.2, 0.5).alias("in_band"))


@query("A62_check_runner", f"""WITH {OR} SELECT 'key' AS name, 'completeness' AS dimension, CAST(count(*) FILTER (o_custkey IS NOT NULL) AS DOUBLE)/count(*) AS share, 1.0 AS threshold, 'error' AS severity, count(*) FILTER (o_custkey IS NULL) = 0 AS passed FROM o UNION ALL SELECT 'amount', 'validity', CAST(count(*) FILTER (cents > 100000) AS DOUBLE)/count(*), 0.999, 'warn', CAST(count(*) FILTER (cents > 100000) AS DOUBLE)/count(*) >= 0.999 FROM o""")
def a62(spark, sf_dir):
    return Q.run_checks(orders(spark, sf_dir), [("key", "completeness", F.col("o_custkey").isNotNull(), 1.0, "error"), ("amount", "validity", F.col("cents") > 100000, 0.999, "warn")])


@query("A68_rule_performance", f"""WITH {LI}, f AS (SELECT 'big' AS rule, l_returnflag = 'R' AS hit FROM li WHERE qty > 40 UNION ALL SELECT 'dear', l_returnflag = 'R' FROM li WHERE cents > 5000000 UNION ALL SELECT 'cheap', l_returnflag = 'R' FROM li WHERE disc >= 9) SELECT rule, count(*) AS fires, CAST(count(*) AS DOUBLE) / nullif(count(*) FILTER (hit), 0) AS one_in FROM f GROUP BY 1""")
def a68(spark, sf_dir):
    f = li(spark, sf_dir).select(F.explode(fired()).alias("rule"), "l_returnflag")
    return f.groupBy("rule").agg(F.count("*").alias("fires"), (F.count("*") / F.nullif(F.count_if(F.col("l_returnflag") == "R"), F.lit(0))).alias("one_in"))


@query("A69_marginal_contribution", f"""WITH {LI}, f AS (SELECT (CASE WHEN qty > 40 THEN 1 ELSE 0 END) + (CASE WHEN cents > 5000000 THEN 1 ELSE 0 END) + (CASE WHEN disc >= 9 THEN 1 ELSE 0 END) AS n, CASE WHEN qty > 40 THEN 'big' WHEN cents > 5000000 THEN 'dear' ELSE 'cheap' END AS rule, l_returnflag FROM li) SELECT rule, count(*) AS alone, count(*) FILTER (l_returnflag = 'R') AS alone_hits FROM f WHERE n = 1 GROUP BY 1""")
def a69(spark, sf_dir):
    """What only one rule caught would be lost without it."""
    f = li(spark, sf_dir).select(fired().alias("rules"), "l_returnflag").filter(F.size("rules") == 1)
    return f.groupBy(F.col("rules")[0].alias("rule")).agg(F.count("*").alias("alone"), F.count_if(F.col("l_returnflag") == "R").alias("alone_hits"))


@query("A71_segment_thresholds", f"""WITH {LI}, b AS (SELECT l_returnflag AS segment, disc AS band, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS bad FROM li GROUP BY ALL) SELECT segment, band, CAST(sum(bad) OVER w AS BIGINT) AS caught, CAST(sum(n - bad) OVER w AS BIGINT) AS blocked_good FROM b WHERE n >= 30 WINDOW w AS (PARTITION BY segment ORDER BY band DESC)""")
def a71(spark, sf_dir):
    b = li(spark, sf_dir).groupBy(F.col("l_returnflag").alias("segment"), F.col("disc").alias("band")).agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("bad")).filter(F.col("n") >= 30)
    w = Window.partitionBy("segment").orderBy(F.desc("band"))
    return b.select("segment", "band", F.sum("bad").over(w).alias("caught"), F.sum(F.col("n") - F.col("bad")).over(w).alias("blocked_good"))


@query("A72_holdout", f"""WITH {LI}, h AS (SELECT l_returnflag, l_linestatus = 'F' AS bad FROM li WHERE CAST(('0x' || substr(md5(CAST(l_orderkey AS VARCHAR)),1,8)) AS BIGINT) % 1000 < 30 AND disc >= 8) SELECT l_returnflag, round(count(*) / 0.03, 4) AS estimate, CAST(count(*) FILTER (bad) AS DOUBLE)/count(*) AS precision FROM h GROUP BY 1""")
def a72(spark, sf_dir):
    h = F.conv(F.substring(F.md5(F.col("l_orderkey").cast("string")), 1, 8), 16, 10).cast("long")
    d = li(spark, sf_dir).filter((h % 1000 < 30) & (F.col("disc") >= 8))
    return d.groupBy("l_returnflag").agg(F.round(F.count("*") / 0.03, 4).alias("estimate"), (F.count_if(F.col("l_linestatus") == "F") / F.count("*")).alias("precision"))


@query("A75_fairness", f"""WITH {LI}, g AS (SELECT l_returnflag AS grp, count(*) AS n, count(*) FILTER (disc >= 8) AS flagged, count(*) FILTER (disc >= 8 AND l_linestatus = 'F') AS tp, count(*) FILTER (l_linestatus = 'F') AS pos FROM li GROUP BY 1) SELECT grp, CAST(flagged AS DOUBLE)/n AS selection, CAST(tp AS DOUBLE)/nullif(pos,0) AS tpr, CAST(tp AS DOUBLE)/nullif(flagged,0) AS ppv, CAST(flagged-tp AS DOUBLE)/nullif(n-pos,0) AS fpr FROM g""")
def a75(spark, sf_dir):
    flag, bad = F.col("disc") >= 8, F.col("l_linestatus") == "F"
    g = li(spark, sf_dir).groupBy(F.col("l_returnflag").alias("grp")).agg(F.count("*").alias("n"), F.count_if(flag).alias("f"), F.count_if(flag & bad).alias("tp"), F.count_if(bad).alias("pos"))
    over = lambda a, b: a / F.nullif(b, F.lit(0))
    return g.select("grp", (F.col("f") / F.col("n")).alias("selection"), over(F.col("tp"), F.col("pos")).alias("tpr"), over(F.col("tp"), F.col("f")).alias("ppv"), over(F.col("f") - F.col("tp"), F.col("n") - F.col("pos")).alias("fpr"))


@query("A76_target_encoding", f"""WITH {LI}, d AS (SELECT l_partkey, us, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM li GROUP BY ALL), c AS (SELECT *, coalesce(sum(n) OVER w, 0) AS pn, coalesce(sum(r) OVER w, 0) AS pr FROM d WINDOW w AS (PARTITION BY l_partkey ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT l_partkey, us, CAST(pn AS BIGINT) AS seen, (CAST(pr AS DOUBLE) + 0.25 * 20) / (pn + 20) AS encoded FROM c""")
def a76(spark, sf_dir):
    d = li(spark, sf_dir).groupBy("l_partkey", "us").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    w = Window.partitionBy("l_partkey").orderBy("us").rowsBetween(Window.unboundedPreceding, -1)
    c = d.withColumn("seen", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("hits", F.coalesce(F.sum("r").over(w), F.lit(0)))
    return c.select("l_partkey", "us", "seen", ((F.col("hits") + 0.25 * 20) / (F.col("seen") + 20)).alias("encoded"))


@query("A82_shortfall", f"""WITH {OR}, d AS (SELECT us // 86400000000 AS day, count(*) AS a, count(*) FILTER (o_orderkey % 8 <> 0) AS b FROM o GROUP BY 1) SELECT day, a - b AS missing, CAST(a - b AS DOUBLE)/a AS share, abs(CAST(a - b AS DOUBLE)/a - 0.125) < 0.02 AS one_in_eight FROM d WHERE a > b""")
def a82(spark, sf_dir):
    d = orders(spark, sf_dir).groupBy(whole(F.col("us"), DAY).alias("day")).agg(F.count("*").alias("a"), F.count_if(F.col("o_orderkey") % 8 != 0).alias("b")).filter(F.col("a") > F.col("b"))
    share = (F.col("a") - F.col("b")) / F.col("a")
    return d.select("day", (F.col("a") - F.col("b")).alias("missing"), share.alias("share"), (F.abs(share - 0.125) < 0.02).alias("one_in_eight"))


@query("A83_bias_monitor", f"""WITH {OR}, d AS (SELECT o_orderpriority, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE 1 END AS s FROM o WHERE o_orderkey % 10 < 5) SELECT o_orderpriority, CAST(count(*) FILTER (s > 0) AS DOUBLE)/count(*) AS up, CAST(count(*) FILTER (s > 0) AS DOUBLE)/count(*) > 0.7 AS biased FROM d GROUP BY 1""")
def a83(spark, sf_dir):
    d = orders(spark, sf_dir).filter(F.col("o_orderkey") % 10 < 5)
    up = F.count_if(F.col("o_orderkey") % 4 != 0) / F.count("*")
    return d.groupBy("o_orderpriority").agg(up.alias("up"), (up > 0.7).alias("biased"))


@query("A84_breaks", f"""WITH {OR}, b AS (SELECT * FROM o WHERE o_orderkey % 17 = 0) SELECT count(*) AS open, count(*) FILTER (us < 930000000000000) AS aged, CAST(sum(cents) AS DOUBLE) / (SELECT sum(cents) FROM o) AS value_share FROM b""")
def a84(spark, sf_dir):
    broken = F.col("o_orderkey") % 17 == 0
    return orders(spark, sf_dir).agg(F.count_if(broken).alias("open"), F.count_if(broken & (F.col("us") < 930000000000000)).alias("aged"), (F.sum(F.when(broken, F.col("cents"))) / F.sum("cents")).alias("value_share"))


@query("A87_progress", f"""WITH {OR} SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'failed' WHEN o_orderkey % 7 = 0 THEN 'pending' ELSE 'applied' END AS state, count(*) AS n, min(o_orderkey) AS first_key, min(us) AS oldest_us FROM o GROUP BY 1""")
def a87(spark, sf_dir):
    state = F.when(F.col("o_orderkey") % 50 == 0, "failed").when(F.col("o_orderkey") % 7 == 0, "pending").otherwise("applied")
    return orders(spark, sf_dir).groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.min("us").alias("oldest_us"))


@query("A89_weighted_forecast", f"""WITH {LI}, w AS (SELECT l_suppkey, CAST(sum(qty * qty) AS DOUBLE) / sum(qty) AS width, median(qty) AS p50 FROM li GROUP BY 1) SELECT l_suppkey, width * 1000 AS forecast, CAST(p50 AS DOUBLE) * 1000 AS by_median FROM w""")
def a89(spark, sf_dir):
    w = li(spark, sf_dir).groupBy("l_suppkey").agg((F.sum(F.col("qty") * F.col("qty")) / F.sum("qty")).alias("width"), F.percentile("qty", 0.5).alias("p50"))
    return w.select("l_suppkey", (F.col("width") * 1000).alias("forecast"), (F.col("p50") * 1000).alias("by_median"))


@query("A91_global_from_regions", f"""WITH {OR} SELECT o_orderpriority, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM o JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def a91(spark, sf_dir):
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_regionkey")
    regional = orders(spark, sf_dir).join(c, "o_custkey").groupBy("n_regionkey", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("cents").alias("total"))
    return regional.groupBy("o_orderpriority").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query("A93_restricted_release", f"""SELECT c_nationkey, c_mktsegment, count(DISTINCT c_custkey) AS n FROM customer GROUP BY ALL HAVING count(DISTINCT c_custkey) >= 12""")
def a93(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.countDistinct("c_custkey").alias("n")).filter(F.col("n") >= 12)


@query("W06_deviation", f"""WITH {LI}, d AS (SELECT l_orderkey, l_linenumber, l_partkey, cents, max(cents) OVER (PARTITION BY l_partkey ORDER BY us RANGE BETWEEN 31536000000000 PRECEDING AND 1 PRECEDING) AS m, avg(cents) OVER (PARTITION BY l_partkey ORDER BY us RANGE BETWEEN 31536000000000 PRECEDING AND 1 PRECEDING) AS a FROM li) SELECT l_orderkey, l_linenumber, l_partkey, CAST(cents AS DOUBLE) / m AS to_max, cents / a AS to_mean FROM d WHERE m IS NOT NULL""")
def w06(spark, sf_dir):
    w = Window.partitionBy("l_partkey").orderBy("us").rangeBetween(-365 * DAY, -1)
    d = li(spark, sf_dir).withColumn("m", F.max("cents").over(w)).withColumn("a", F.avg("cents").over(w)).filter(F.col("m").isNotNull())
    return d.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("cents") / F.col("m")).alias("to_max"), (F.col("cents") / F.col("a")).alias("to_mean"))


@query("W11_probe_detector", f"""WITH {LI}, p AS (SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER w AS n, min(cents) OVER w AS lo, max(cents) OVER w AS hi FROM li WINDOW w AS (PARTITION BY l_suppkey ORDER BY us RANGE BETWEEN 2592000000000 PRECEDING AND CURRENT ROW)) SELECT l_orderkey, l_linenumber, l_partkey FROM p WHERE n >= 2 AND hi <= 1.1 * lo""")
def w11(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy("us").rangeBetween(-30 * DAY, 0)
    p = li(spark, sf_dir).withColumn("n", F.count("*").over(w)).withColumn("lo", F.min("cents").over(w)).withColumn("hi", F.max("cents").over(w))
    return p.filter((F.col("n") >= 2) & (F.col("hi") <= 1.1 * F.col("lo"))).select("l_orderkey", "l_linenumber", "l_partkey")


@query("W17_running_balance", f"""WITH {LI} SELECT l_orderkey, l_linenumber, l_partkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN -cents ELSE cents END) OVER (PARTITION BY l_suppkey ORDER BY us, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM li""")
def w17(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy("us", "l_orderkey", "l_linenumber", "l_partkey").rowsBetween(Window.unboundedPreceding, 0)
    signed = F.when(F.col("l_returnflag") == "R", -F.col("cents")).otherwise(F.col("cents"))
    return li(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", F.sum(signed).over(w).alias("balance"))


@query("W19_fan_out", f"""WITH {LI}, f AS (SELECT l_orderkey, CAST(sum(qty) AS BIGINT) AS n FROM li GROUP BY 1) SELECT round(quantile_cont(n, 0.5), 4) AS p50, round(quantile_cont(n, 0.9), 4) AS p90, round(quantile_cont(n, 0.99), 4) AS p99, round(quantile_cont(n, 0.99) / quantile_cont(n, 0.5), 6) AS ratio FROM f""")
def w19(spark, sf_dir):
    f = li(spark, sf_dir).groupBy("l_orderkey").agg(F.sum("qty").alias("n")).agg(F.percentile("n", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))).alias("p"))
    return f.select(*[F.round(F.col("p")[k], 4).alias(x) for k, x in enumerate(("p50", "p90", "p99"))], F.round(F.col("p")[2] / F.col("p")[0], 6).alias("ratio"))


@query("W22_mule_features", f"""WITH {OR} SELECT o_orderkey, count(*) OVER w AS n7, us - lag(us) OVER (PARTITION BY o_custkey ORDER BY us, o_orderkey) AS dormant_us FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY us RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW)""")
def w22(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("us").rangeBetween(-7 * DAY, 0)
    at = Window.partitionBy("o_custkey").orderBy("us", "o_orderkey")
    return orders(spark, sf_dir).select("o_orderkey", F.count("*").over(w).alias("n7"), (F.col("us") - F.lag("us").over(at)).alias("dormant_us"))


@query("K04_review_queue", f"""WITH {LI} SELECT l_orderkey, l_linenumber, l_partkey, cents * disc AS loss FROM li ORDER BY loss DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100""")
def k04(spark, sf_dir):
    return li(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", (F.col("cents") * F.col("disc")).alias("loss")).orderBy(F.desc("loss"), "l_orderkey", "l_linenumber", "l_partkey").limit(100)


@query("K05_queue_by_cluster", f"""WITH {LI} SELECT l_orderkey, max(cents * disc) AS worst, count(*) AS n FROM li GROUP BY 1""")
def k05(spark, sf_dir):
    return li(spark, sf_dir).groupBy("l_orderkey").agg(F.max(F.col("cents") * F.col("disc")).alias("worst"), F.count("*").alias("n"))


@query("K06_top_k", f"""WITH {OR} SELECT o_custkey, o_orderkey, cents FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY cents DESC, o_orderkey) <= 2""")
def k06(spark, sf_dir):
    at = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("cents"), "o_orderkey"))
    return orders(spark, sf_dir).withColumn("at", at).filter(F.col("at") <= 2).select("o_custkey", "o_orderkey", "cents")


@query("K07_percentile_cut", f"""WITH {OR}, c AS (SELECT o_custkey, CAST(sum(cents) AS BIGINT) AS total FROM o GROUP BY 1), t AS (SELECT quantile_cont(total, 0.99) AS cut FROM c) SELECT o_custkey, total FROM c, t WHERE total > cut""")
def k07(spark, sf_dir):
    c = orders(spark, sf_dir).groupBy("o_custkey").agg(F.sum("cents").alias("total"))
    cut = c.agg(F.percentile("total", 0.99).alias("cut"))
    return c.crossJoin(F.broadcast(cut)).filter(F.col("total") > F.col("cut")).select("o_custkey", "total")


@query("U02_determinism_diff", f"""WITH {LI} SELECT count(*) AS n FROM li WHERE l_orderkey % 1000 = 0""")
def u02(spark, sf_dir):
    a = li(spark, sf_dir)
    b = a.withColumn("cents", F.when(F.col("l_orderkey") % 1000 == 0, F.col("cents") + 1).otherwise(F.col("cents")))
    return a.exceptAll(b).agg(F.count("*").alias("n"))


@query("U03_diff_report", f"""WITH {OR} SELECT CASE WHEN o_orderkey % 70 = 0 THEN 'only_left' WHEN o_orderkey % 90 = 1 THEN 'differs' ELSE 'matched' END AS class, count(*) AS n FROM o GROUP BY 1""")
def u03(spark, sf_dir):
    a = orders(spark, sf_dir)
    b = a.filter(F.col("o_orderkey") % 70 != 0).withColumn("cents", F.col("cents") + (F.col("o_orderkey") % 90 == 1).cast("int"))
    return Q.reconcile(a, b, ["o_orderkey"], "cents").groupBy("class").agg(F.count("*").alias("n"))


@query("X20_minor_units", f"""WITH {OR} SELECT o_orderkey, cents // CASE o_custkey % 3 WHEN 0 THEN 100 ELSE 1 END AS minor, CASE o_custkey % 3 WHEN 0 THEN 'JPY' WHEN 1 THEN 'EUR' ELSE 'USD' END AS currency FROM o""")
def x20(spark, sf_dir):
    currency = F.element_at(F.array(F.lit("JPY"), F.lit("EUR"), F.lit("USD")), (F.col("o_custkey") % 3 + 1).cast("int"))
    places = F.create_map(F.lit("JPY"), F.lit(100), F.lit("EUR"), F.lit(1), F.lit("USD"), F.lit(1))
    return orders(spark, sf_dir).select("o_orderkey", F.floor(F.col("cents") / places[currency]).cast("long").alias("minor"), currency.alias("currency"))


@query("X22_keyed_hash", f"""SELECT c_custkey, sha256('key' || sha256('key' || c_name)) AS h FROM customer""")
def x22(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2(F.concat(F.lit("key"), F.sha2(F.concat(F.lit("key"), "c_name"), 256)), 256).alias("h"))


@query("X27_canonical", f"""WITH {OR} SELECT o_orderkey, concat_ws('|', coalesce(CAST(o_custkey AS VARCHAR), '∅'), CAST(cents AS VARCHAR), CAST(us AS VARCHAR), rtrim(o_orderpriority)) AS canonical FROM o""")
def x27(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", F.concat_ws("|", F.coalesce(F.col("o_custkey").cast("string"), F.lit("∅")), F.col("cents").cast("string"), F.col("us").cast("string"), F.rtrim("o_orderpriority")).alias("canonical"))


@query("D01_rule_pack", f"""WITH {LI} SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(',', CASE WHEN qty > 40 THEN 'big' END, CASE WHEN cents > 5000000 THEN 'dear' END, CASE WHEN disc >= 9 THEN 'cheap' END) AS rules, CASE WHEN qty > 40 THEN 'review' WHEN cents > 5000000 THEN 'block' ELSE 'none' END AS action FROM li""")
def d01(spark, sf_dir):
    """All rules that fire, and the first action; the rule cheap is in shadow mode and acts on nothing."""
    action = F.when(F.col("qty") > 40, "review").when(F.col("cents") > 5000000, "block").otherwise("none")
    return li(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(fired(), ",").alias("rules"), action.alias("action"))


@query("D02_escalation_cap", f"""WITH {LI} SELECT l_orderkey, l_linenumber, l_partkey, least(1, (CASE WHEN qty > 40 THEN 1 ELSE 0 END) + (CASE WHEN cents > 5000000 THEN 1 ELSE 0 END) + (CASE WHEN disc >= 9 THEN 1 ELSE 0 END)) AS steps FROM li""")
def d02(spark, sf_dir):
    return li(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", F.least(F.size(fired()), F.lit(1)).alias("steps"))


@query("D03_random_boundary", f"""WITH {LI} SELECT l_orderkey, l_linenumber, l_partkey, cents > 5000000 * (0.92 + 0.16 * (CAST(('0x' || substr(md5(CAST(l_suppkey AS VARCHAR)),1,8)) AS BIGINT) / 4294967296.0)) AS over FROM li""")
def d03(spark, sf_dir):
    part = F.conv(F.substring(F.md5(F.col("l_suppkey").cast("string")), 1, 8), 16, 10).cast("long") / 4294967296.0
    return li(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", (F.col("cents") > 5000000 * (0.92 + 0.16 * part)).alias("over"))


@query("D04_policy_verdict", f"""WITH {OR}, v AS (SELECT o_orderkey, us, cents, count(*) OVER w AS n, CAST(coalesce(sum(cents) OVER w, 0) AS BIGINT) AS s FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY us RANGE BETWEEN 7776000000000 PRECEDING AND 1 PRECEDING)) SELECT o_orderkey, CASE WHEN o_orderkey % 30 > 27 THEN 'deny' WHEN n >= 3 OR s >= 50000000 THEN 'human' WHEN cents > 40000000 THEN 'human' ELSE 'approve' END AS verdict FROM v""")
def d04(spark, sf_dir):
    """Return window, then refund velocity of 90 days, then the tier's ceiling."""
    w = Window.partitionBy("o_custkey").orderBy("us").rangeBetween(-90 * DAY, -1)
    v = orders(spark, sf_dir).withColumn("n", F.count("*").over(w)).withColumn("s", F.coalesce(F.sum("cents").over(w), F.lit(0)))
    verdict = F.when(F.col("o_orderkey") % 30 > 27, "deny").when((F.col("n") >= 3) | (F.col("s") >= 50000000), "human").when(F.col("cents") > 40000000, "human").otherwise("approve")
    return v.select("o_orderkey", verdict.alias("verdict"))


@query("D05_set_action_guard", f"""WITH {LI} SELECT l_suppkey, count(DISTINCT l_orderkey) AS affected, count(DISTINCT l_orderkey) > 50 AS needs_approval FROM li WHERE disc >= 5 GROUP BY 1""")
def d05(spark, sf_dir):
    n = F.countDistinct("l_orderkey")
    return li(spark, sf_dir).filter(F.col("disc") >= 5).groupBy("l_suppkey").agg(n.alias("affected"), (n > 50).alias("needs_approval"))


@query("D07_reason", f"""WITH {LI}, m AS (SELECT avg(qty) AS mq, avg(cents) AS mc FROM li) SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN qty > 40 THEN 'rule:big' WHEN cents > 5000000 THEN 'rule:dear' WHEN qty / mq >= cents / mc THEN 'feature:qty' ELSE 'feature:cents' END AS reason FROM li, m""")
def d07(spark, sf_dir):
    l = li(spark, sf_dir)
    m = F.broadcast(l.agg(F.avg("qty").alias("mq"), F.avg("cents").alias("mc")))
    top = F.when(F.col("qty") / F.col("mq") >= F.col("cents") / F.col("mc"), "feature:qty").otherwise("feature:cents")
    reason = F.when(F.col("qty") > 40, "rule:big").when(F.col("cents") > 5000000, "rule:dear").otherwise(top)
    return l.crossJoin(m).select("l_orderkey", "l_linenumber", "l_partkey", reason.alias("reason"))


@query("A80_wilson", f"""SELECT quality, count(*) AS n, count(*) FILTER (toxic = 1) AS k, round((CAST(count(*) FILTER (toxic = 1) AS DOUBLE)/count(*) + 1.96*1.96/(2*count(*)) - 1.96*sqrt((CAST(count(*) FILTER (toxic = 1) AS DOUBLE)/count(*))*(1-CAST(count(*) FILTER (toxic = 1) AS DOUBLE)/count(*))/count(*) + 1.96*1.96/(4.0*count(*)*count(*))))/(1+1.96*1.96/count(*)), 8) AS low FROM labels GROUP BY 1""")
def a80(spark, sf_dir):
    g = table(spark, sf_dir, "labels").groupBy("quality").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("k"))
    return g.withColumn("low", F.round(Q.wilson(F.col("k"), F.col("n"))[0], 8))


@query("A70_threshold_sweep", f"""WITH b AS (SELECT CAST(floor(len(text) / 500.0) AS BIGINT) AS band, count(*) AS n, count(*) FILTER (toxic = 1) AS bad FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT band, CAST(sum(bad) OVER (ORDER BY band DESC) AS BIGINT) AS caught, CAST(sum(n - bad) OVER (ORDER BY band DESC) AS BIGINT) AS false_alarms FROM b""")
def a70(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.length("text") / 500.0).alias("band"))
    b = table(spark, sf_dir, "labels").join(d, "doc_id").groupBy("band").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("bad"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("band"))  # one row a band
    return b.select("band", F.sum("bad").over(w).alias("caught"), F.sum(F.col("n") - F.col("bad")).over(w).alias("false_alarms"))


@query("A73_calibration", f"""WITH s AS (SELECT least(0.99, len(text) / 5000.0) AS p, toxic FROM labels JOIN documents USING (doc_id)) SELECT CAST(floor(p * 10) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 8) AS mean_p, avg(toxic) AS rate FROM s GROUP BY 1""")
def a73(spark, sf_dir):
    """A reliability table: predicted against found, by bin."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(0.99), F.length("text") / 5000.0).alias("p"))
    s = table(spark, sf_dir, "labels").join(d, "doc_id")
    return s.groupBy(F.floor(F.col("p") * 10).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 8).alias("mean_p"), F.avg("toxic").alias("rate"))


@query("A74_prior_correction", f"""WITH s AS (SELECT doc_id, least(0.99, len(text) / 5000.0) AS p FROM documents) SELECT doc_id, round(p * 0.1 / (p * 0.1 + 1 - p), 8) AS corrected FROM s""")
def a74(spark, sf_dir):
    p = F.least(F.lit(0.99), F.length("text") / 5000.0)
    return table(spark, sf_dir, "documents").select("doc_id", F.round(p * 0.1 / (p * 0.1 + 1 - p), 8).alias("corrected"))


@query("A81_judge_corrected", f"""SELECT doc_id // 100 AS week, count(*) AS flagged, count(*) FILTER (toxic = 1) AS confirmed, count(*) FILTER (toxic = 1) / 0.8 AS corrected FROM labels GROUP BY 1""")
def a81(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy(whole(F.col("doc_id"), 100).alias("week")).agg(F.count("*").alias("flagged"), F.count_if(F.col("toxic") == 1).alias("confirmed"), (F.count_if(F.col("toxic") == 1) / 0.8).alias("corrected"))


@query("G01_edges", f"""WITH {LI}, d AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS degree FROM li GROUP BY 1) SELECT DISTINCT li.l_orderkey, li.l_partkey, degree FROM li JOIN d USING (l_partkey) WHERE degree <= 40""")
def g01(spark, sf_dir):
    """Orders joined to their parts; parts of too high a degree say nothing and go."""
    return edges(spark, sf_dir, 40)


@query("G02_components", f"""WITH RECURSIVE {LI}, d AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS degree FROM li GROUP BY 1), e AS (SELECT DISTINCT 'o' || l_orderkey AS a, 'p' || l_partkey AS b FROM li JOIN d USING (l_partkey) WHERE degree <= 20), near AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e), r AS (SELECT 0 AS k, a AS id, min(b) AS root FROM near GROUP BY a UNION ALL SELECT k + 1, near.a, min(r.root) FROM r JOIN near ON near.b = r.id WHERE k < 40 GROUP BY k, near.a) SELECT id, root FROM r WHERE k = 40""")
def g02(spark, sf_dir):
    from vantage.operators.graph import components

    e = edges(spark, sf_dir, 20).select(F.concat(F.lit("o"), "l_orderkey").alias("a"), F.concat(F.lit("p"), "l_partkey").alias("b"))
    return components(e)


@query("G04_hops", f"""WITH {LI}, e AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM li), f AS (SELECT DISTINCT o FROM e WHERE o % 500 = 0), s1 AS (SELECT DISTINCT s FROM e JOIN f USING (o)), o2 AS (SELECT DISTINCT o FROM e JOIN s1 USING (s)) SELECT DISTINCT o, CASE WHEN o % 500 = 0 THEN 0 ELSE 2 END AS hops FROM o2""")
def g04(spark, sf_dir):
    from vantage.operators.graph import hops

    e = li(spark, sf_dir).select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s")).distinct()
    both = e.select(F.concat(F.lit("o"), "o").alias("a"), F.concat(F.lit("s"), "s").alias("b"))
    seeds = e.filter(F.col("o") % 500 == 0).select(F.concat(F.lit("o"), "o").alias("id")).distinct()
    found = hops(both, seeds, 2).filter(F.col("id").startswith("o"))
    return found.select(F.substring("id", 2, 20).cast("long").alias("o"), "hops")


@query("G07_neighbourhood", f"""WITH {LI}, e AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM li), p1 AS (SELECT DISTINCT p FROM e WHERE o = 7) SELECT DISTINCT e.o FROM e JOIN p1 USING (p)""")
def g07(spark, sf_dir):
    e = li(spark, sf_dir).select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()
    return e.join(e.filter(F.col("o") == 7).select("p"), "p", "left_semi").select("o").distinct()


@query("G03_entity_summary", f"""WITH {LI}, s AS (SELECT l_suppkey, count(*) AS n, count(DISTINCT l_orderkey) AS orders, count(*) FILTER (l_returnflag = 'R') AS bad FROM li GROUP BY 1) SELECT l_suppkey, n, orders, bad, CAST(bad AS DOUBLE)/n AS bad_rate, round(percent_rank() OVER (ORDER BY n), 8) AS size_rank FROM s""")
def g03(spark, sf_dir):
    s = li(spark, sf_dir).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"), F.count_if(F.col("l_returnflag") == "R").alias("bad"))
    # ranks over sizes, not entities: one row for each distinct size
    sizes = s.groupBy("n").agg(F.count("*").alias("c"))
    below = F.coalesce(F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    all_of = F.sum("c").over(Window.partitionBy(F.lit(0)))
    rank = sizes.select("n", F.round(below / F.nullif(all_of - 1, F.lit(0)), 8).alias("size_rank"))
    return s.join(rank, "n").select("l_suppkey", "n", "orders", "bad", (F.col("bad") / F.col("n")).alias("bad_rate"), "size_rank")
