"""Sentences, chunks of whole sentences, arithmetic in claims, and claims checked against what they cite.

Scores of outside models enter as columns: an entailment score, and a judge's answer that is null when it gave none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: abbreviations whose full stop ends no sentence, openings of a qualifier
ABBREVIATIONS = "e.g. i.e. etc. no. dr. mr. ms. vs. approx. dept. sr. sra. art. pág. núm. aprox. ud. uds. rs.".split()
QUALIFIERS = ("However", "Except", "This does not apply", "Sin embargo", "Esto no aplica", "लेकिन")
NEGATIONS = ["not", "no", "never", "without", "cannot"]
OBLIGATIONS = ["must", "shall", "required", "mandatory"]

_HELD, _CUT = "\x02", "\x01"
_ABBREVIATION = "(?iu)(^|[ \\x02])(" + "|".join(a.replace(".", "\\.") for a in ABBREVIATIONS) + ") "


def sentences(text: Column, lang: Column | None = None) -> Column:
    """Array of sentences; white space is one space. A Hindi text also ends them at a danda. Null or blank: an empty array.

    A full stop inside a number has no space after it; one after an abbreviation holds its space until texts are cut.
    """
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))
    for _ in range(2):  # the second pass meets abbreviations that follow one another
        plain = F.regexp_replace(plain, _ABBREVIATION, f"$1$2{_HELD}")
    end = lambda marks: F.regexp_replace(plain, f"([{marks}][\"')»”]*) ", f"$1{_CUT}")
    cut = end(".?!") if lang is None else F.when(lang == "hi", end(".?!।")).otherwise(end(".?!"))
    parts = F.transform(F.split(cut, _CUT), lambda s: F.trim(F.translate(s, _HELD, " ")))
    return F.filter(parts, lambda s: s != "")


def sentence_chunks(docs: DataFrame, target: int = 400, most: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk, n_tokens, chunk_text): whole sentences packed greedily up to `target` words.

    A sentence that opens with a qualifier stays with the one before it while `most` holds; a longer sentence stands alone.
    A text without sentences gives no chunk. One fold over a document's sentences; nothing is shuffled.
    """
    count = lambda s: F.size(F.split(s, " "))
    unit = lambda s: F.struct(s.alias("s"), count(s).alias("n"), F.array_contains(F.array(*[F.startswith(s, F.lit(q)) for q in QUALIFIERS]), True).alias("q"))
    units = F.transform(sentences(F.col(text)), unit)
    start = F.struct(F.array().cast("array<struct<t:string,n:int>>").alias("done"), F.lit("").alias("t"), F.lit(0).alias("n"))

    def step(a: Column, u: Column) -> Column:
        fits = a["n"] + u["n"] <= F.when(u["q"], most).otherwise(target)
        first = a["n"] == 0
        done = F.when(first | fits, a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["t"].alias("t"), a["n"].alias("n")))))
        more = F.when(first, u["s"]).when(fits, F.concat(a["t"], F.lit(" "), u["s"])).otherwise(u["s"])
        return F.struct(done.alias("done"), more.alias("t"), F.when(fits, a["n"] + u["n"]).otherwise(u["n"]).alias("n"))

    def finish(a: Column) -> Column:
        return F.when(a["n"] > 0, F.concat(a["done"], F.array(F.struct(a["t"].alias("t"), a["n"].alias("n"))))).otherwise(a["done"])

    packed = docs.select(key, F.posexplode(F.aggregate(units, start, step, finish)).alias("chunk", "c"))
    return packed.select(key, "chunk", F.col("c.n").cast("long").alias("n_tokens"), F.col("c.t").alias("chunk_text"))


def recompute(calc: Column) -> Column:
    """The value of a sum of products such as `2 * 3 + 8 / 4 - 1`; null where it does not evaluate.

    Multiplication and division go before addition and subtraction, from the left. There are no brackets: a text with
    them, a division by zero or anything else gives null.
    """
    number = r"-?[0-9]+(\.[0-9]+)?"
    compact = F.regexp_replace(calc, " ", "")
    good = F.regexp_like(compact, F.lit(f"^{number}([-+*/]{number})*$"))
    marked = F.regexp_replace(F.regexp_replace(compact, r"(?<=[0-9])\+", " "), r"(?<=[0-9])-", " -")  # a minus goes with its term
    signed = F.transform(F.split(F.regexp_replace(marked, "--", ""), " "), _product)
    return F.when(good, F.aggregate(signed, F.lit(0.0), lambda a, x: a + x))


def _product(term: Column) -> Column:
    factors = F.split(F.regexp_replace(term, r"([*/])", " $1"), " ")
    step = lambda a, f: F.when(f.startswith("*"), a * F.substring(f, 2, 99).cast("double")).when(f.startswith("/"), F.try_divide(a, F.substring(f, 2, 99).cast("double"))).otherwise(f.cast("double"))
    return F.aggregate(factors, F.lit(1.0), step)


def check_calc(calc: Column, evidence: Column) -> Column:
    """'pass', or why not: the stated result is missing or wrong, or an operand is not among the evidence's numbers."""
    expr, stated = F.split(calc, "=")[0], F.trim(F.get(F.split(calc, "="), F.lit(1))).try_cast("double")
    value = recompute(expr)
    operands = F.transform(F.regexp_extract_all(expr, F.lit(r"[0-9]+(?:\.[0-9]+)?"), 0), lambda x: x.cast("double"))
    return (
        F.when(~F.contains(calc, F.lit("=")), "no result")
        .when(value.isNull() | stated.isNull(), "does not evaluate")
        .when(F.size(F.array_except(operands, evidence)) > 0, "operand not in evidence")
        .when(F.abs(value - stated) > F.greatest(F.lit(0.005), F.abs(stated) * 1e-9), "wrong result")
        .otherwise("pass")
    )


def numbers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[0-9]+"), 0))


def verify(claims: DataFrame, evidence: DataFrame, low: float = 0.5, high: float = 0.92) -> DataFrame:
    """claims (claim_id, cite, claim, judge) against evidence (cite, sentence), one row a claim with its status.

    In order: a citation that is there, numbers that the evidence holds, the same polarity, an obligation only from one;
    then the share of the claim's words in the evidence: from `high` supported, below `low` rejected, and the judge's
    boolean between them. A judge without an answer rejects. `cite` is unique in evidence; a claim without words is rejected.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), 0))
    has = lambda c, cues: F.arrays_overlap(words(c), F.array(*map(F.lit, cues)))
    c, s = F.col("claim"), F.col("sentence")
    share = F.size(F.array_intersect(words(c), words(s))) / F.nullif(F.size(words(c)), F.lit(0))
    j = claims.join(evidence, "cite", "left").withColumn("score", F.round(share, 6))
    status = (
        F.when(s.isNull(), "no citation")
        .when(F.size(F.array_except(numbers(c), numbers(s))) > 0, "quantity not in evidence")
        .when(has(c, NEGATIONS) != has(s, NEGATIONS), "polarity differs")
        .when(has(c, OBLIGATIONS) & ~has(s, OBLIGATIONS), "obligation added")
        .when(F.col("score") >= high, "supported")
        .when(F.coalesce(F.col("score"), F.lit(0.0)) < low, "rejected")
        .when(F.coalesce("judge", F.lit(False)), "supported by judge")
        .otherwise("rejected by judge")
    )
    return j.select("claim_id", "score", status.alias("status"))


def rerank(pairs: DataFrame, queries: DataFrame, docs: DataFrame, embed: Callable[[Column], Column], score: Callable[[Column, Column], Column], top: int, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """(query, doc, score, rank): pairs (query, doc) ranked by a caller's models over queries (query, q) and docs (doc, d).

    embed: from a text column to a vector column; score: from two vector columns to a number, null where the model gave no
    answer; such pairs come last and have the rank null. Ties go to the lesser doc. Each text is embedded once, and only
    vectors meet the pairs.
    """
    left, right = queries.select(query, embed(F.col("q")).alias("x")), docs.select(doc, embed(F.col("d")).alias("y"))
    met = pairs.select(query, doc).join(left, query).join(right, doc)
    scored = met.select(query, doc, F.round(score(F.col("x"), F.col("y")), 6).alias("score"))
    at = F.row_number().over(Window.partitionBy(query).orderBy(F.col("score").desc_nulls_last(), doc)).cast("long")
    ranked = scored.withColumn("rank", F.when(F.col("score").isNotNull(), at))
    return ranked.filter(F.coalesce(F.col("rank") <= top, F.lit(True)))


def gated(claims: DataFrame, entails: Callable[[DataFrame], Column], judge: Callable[[DataFrame], Column], least: float = 0.5) -> DataFrame:
    """claims with `verdict`, from a caller's entailment score and judge. Without an answer (null) of either, a claim fails.

    pass: the score is at least `least` and the judge agrees; fail: either is below or against; unanswered: either is null.
    """
    number, answer = entails(claims), judge(claims)
    verdict = F.when(number.isNull() | answer.isNull(), "unanswered").when((number >= least) & answer, "pass").otherwise("fail")
    return claims.withColumn("verdict", verdict)


def stale(rows: DataFrame, now: Column, us: str, limit_us: int) -> DataFrame:
    """rows with `age_us` by the clock `now`, a column the caller gives, and whether that exceeds the limit."""
    age = now - F.col(us)
    return rows.withColumn("age_us", age).withColumn("stale", age > limit_us)
