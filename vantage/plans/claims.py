"""Queries over quantities, calculations and claims that orders are written out as."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.catalog import query
from vantage.functions.time import DAY, whole
from vantage.operators import claims as C
from vantage.sources.tables import LI, OR, lineitem as li, orders

MONTHS_ES = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()
LOCALES = ["en-US", "es-ES", "en-IN", "es-MX"]


@query("X10_typed_quantities", f"""WITH {OR}, t AS (SELECT o_orderkey, o_orderkey % 4 AS kind, cents / 100.0 AS price, CAST(strftime(to_timestamp(us // 1000000), '%Y%m%d') AS DOUBLE) AS day, o_custkey FROM o)
 SELECT o_orderkey, CAST(CASE WHEN kind = 2 THEN o_custkey * 100000.0 ELSE price END AS DOUBLE) AS value, ['USD', 'EUR', 'INR', 'MXN'][kind + 1] AS unit FROM t
 UNION ALL SELECT o_orderkey, day, 'DATE' FROM t WHERE kind < 2 UNION ALL SELECT o_orderkey, floor(day / 10000), NULL FROM t WHERE kind < 2""")
def x10_typed(spark, sf_dir):
    """Prices and dates of orders, written in four locales and read again."""
    o = orders(spark, sf_dir)
    kind, plain = F.col("o_orderkey") % 4, F.format_number(F.col("cents") / 100, 2)
    day = F.date_add(F.lit("1970-01-01").cast("date"), whole(F.col("us"), DAY).cast("int"))
    spanish = F.element_at(F.array(*map(F.lit, MONTHS_ES)), F.month(day))
    text = (
        F.when(kind == 0, F.concat(F.lit("A price of $"), plain, F.lit(" on "), day.cast("string"), F.lit(".")))
        .when(kind == 1, F.concat(F.lit("Un precio de "), F.translate(plain, ",.", ".,"), F.lit(" euros el "), F.dayofmonth(day).cast("string"), F.lit(" de "), spanish, F.lit(" de "), F.year(day).cast("string"), F.lit(".")))
        .when(kind == 2, F.concat(F.lit("A price of "), F.col("o_custkey").cast("string"), F.lit(" lakh rupees.")))
        .otherwise(F.concat(F.lit("Un precio de $"), plain))
    )
    t = o.select("o_orderkey", text.alias("text"), F.element_at(F.array(*map(F.lit, LOCALES)), (kind + 1).cast("int")).alias("locale"))
    return t.select("o_orderkey", F.inline(C.quantities(F.col("text"), F.col("locale"))["found"]))


@query("X13_calc_brackets", f"""WITH {LI} SELECT l_orderkey, l_linenumber, CASE WHEN disc = 0 THEN NULL ELSE round((qty + tax) * (cents - 3.0 * qty) / disc - -(tax), 4) END AS value FROM li""")
def x13_brackets(spark, sf_dir):
    """Each line's arithmetic with brackets and a sign before one; a division by zero has no value."""
    text = F.format_string("(%d + %d) * (%d - 3.0 * %d) / %d - -(%d)", "qty", "tax", "cents", "qty", "disc", "tax")
    return li(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(C.evaluated(text)["value"], 4).alias("value"))


VERDICTS = f"""{OR}, v AS (SELECT o_orderkey // 4 AS answer_id, o_orderkey, o_custkey % 6 AS kind, cents, CASE o_custkey % 6 WHEN 1 THEN 'quantity not in evidence: ' || regexp_replace(CAST(CAST(cents + 1 AS DECIMAL(18,2)) / 100 AS DECIMAL(18,2))::VARCHAR, '\\.?0+$', '') || ' USD'
 WHEN 2 THEN 'negation added' WHEN 3 THEN 'obligation added' WHEN 4 THEN 'scope swapped: contractor' WHEN 5 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'accepted by judge' ELSE 'rejected by judge' END END AS reason FROM o),
 w AS (SELECT *, kind = 0 OR reason = 'accepted by judge' AS accepted FROM v)"""


def order_claims(spark, sf_dir):
    """A sentence on each order, and a claim that cites it: right, or wrong in one of five ways."""
    o = orders(spark, sf_dir).select(whole(F.col("o_orderkey"), 4).alias("answer_id"), "o_orderkey", (F.col("o_custkey") % 6).alias("kind"), "cents", F.col("o_custkey").alias("n"))
    price = lambda more: F.concat(F.lit("$"), F.format_number((F.col("cents") + more) / 100, 2))
    about = F.concat(F.lit(" order up to "), F.col("n").cast("string"), F.lit(" items for "))
    claim = lambda who, may, more=0: F.concat(F.lit(f"{who} {may}"), about, price(more), F.lit("."))
    kind = F.col("kind")
    text = F.when(kind == 1, claim("Employees", "can", 1)).when(kind == 2, claim("Employees", "cannot")).when(kind == 3, claim("Employees", "must")).when(kind == 4, claim("Contractors", "can")).otherwise(claim("Employees", "can"))
    named = lambda x: F.concat(F.lit(x), F.col("o_orderkey").cast("string"))
    none = F.lit(None).cast("string")
    claims = o.select("answer_id", named("C").alias("cid"), F.col("o_orderkey").alias("nth"), text.alias("text"), F.lit("en-US").alias("locale"), F.array(named("S")).alias("cites"), none.alias("qualifies"), none.alias("calc"), none.alias("question"), "kind", "o_orderkey")
    # a section a sentence, so that no sentence stands beside another
    context = o.select("answer_id", named("S").alias("sid"), claim("Employees", "may").alias("text"), F.lit("en-US").alias("locale"), F.col("answer_id").alias("doc_id"), F.col("o_orderkey").alias("section"), F.lit(1).alias("ordinal"), F.array().cast("array<string>").alias("doc_scope"))
    return claims, context, lambda premise, said: F.when(F.col("kind") == 5, 0.8).otherwise(0.97), lambda premise, said: F.col("o_orderkey") % 2 == 0


@query("R21_verified_claims", f"WITH {VERDICTS} SELECT o_orderkey, accepted, reason FROM w")
def r21_claims(spark, sf_dir):
    """Each claim on an order: accepted or not, and why."""
    return C.verify_claims(*order_claims(spark, sf_dir)).select("o_orderkey", "accepted", F.get("reasons", F.lit(0)).alias("reason"))


@query("R21_answer_status", f"WITH {VERDICTS} SELECT answer_id, CASE WHEN count(*) FILTER (accepted) = count(*) THEN 'VERIFIED' WHEN count(*) FILTER (accepted) > 0 THEN 'PARTIAL' ELSE 'DROPPED' END AS status FROM w GROUP BY 1")
def r21_answers(spark, sf_dir):
    """Answers of up to four claims: verified, in part, or dropped."""
    return C.verify_answers(*order_claims(spark, sf_dir))[0]
