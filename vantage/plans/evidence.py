"""Queries over sentences, chunks, claims, quantised vectors and channels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vantage.catalog import query
from vantage.functions.time import DAY, whole
from vantage.operators import evidence as V
from vantage.operators import nearest as N
from vantage.operators import text as X
from vantage.plans.corpus import PAIRS, TOKENS, token_pairs
from vantage.sources.tables import EV, LI, events as ev, lineitem as li, table

ABBR = "|".join(a.replace(".", "\\.") for a in V.ABBREVIATIONS)
HELD = f"regexp_replace({{}}, '(?i)(^|[ \\x02])({ABBR}) ', '\\1\\2' || chr(2), 'g')"
CUT = r"""regexp_replace({}, '([.?!]["'')»”]*) ', '\1' || chr(1), 'g')"""
SENTENCES = f"""s AS (SELECT doc_id, list_filter(list_transform(string_split({CUT.format(HELD.format(HELD.format("trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))")))}, chr(1)), lambda x: trim(replace(x, chr(2), ' '))), lambda x: x <> '') AS parts FROM documents)"""


@query("X11_sentences", f"WITH {SENTENCES}, e AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS nth, unnest(parts) AS sentence FROM s) SELECT doc_id, nth, length(sentence) AS n, md5(sentence) AS h FROM e")
def x11(spark, sf_dir):
    """Every sentence of every document with its place, length and digest."""
    s = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(V.sentences(F.col("text"), F.col("lang"))).alias("nth", "sentence"))
    return s.select("doc_id", F.col("nth").cast("long").alias("nth"), F.length("sentence").cast("long").alias("n"), F.md5(F.col("sentence").cast("binary")).alias("h"))


@query("R02_sentence_chunks", f"""WITH RECURSIVE {SENTENCES}, e AS (SELECT doc_id, generate_subscripts(parts, 1) AS nth, unnest(parts) AS s FROM s), u AS (SELECT *, len(string_split(s, ' ')) AS n, {" OR ".join(f"starts_with(s, '{q}')" for q in V.QUALIFIERS)} AS q FROM e), f AS (SELECT doc_id, nth, 0 AS chunk, n AS held FROM u WHERE nth = 1 UNION ALL SELECT u.doc_id, u.nth, f.chunk + CASE WHEN f.held + u.n <= CASE WHEN u.q THEN 512 ELSE 400 END THEN 0 ELSE 1 END, CASE WHEN f.held + u.n <= CASE WHEN u.q THEN 512 ELSE 400 END THEN f.held + u.n ELSE u.n END FROM f JOIN u ON u.doc_id = f.doc_id AND u.nth = f.nth + 1) SELECT doc_id, CAST(chunk AS INT) AS chunk, CAST(sum(n) AS BIGINT) AS n_tokens, string_agg(s, ' ' ORDER BY nth) AS chunk_text FROM f JOIN u USING (doc_id, nth) GROUP BY doc_id, chunk""")
def r02(spark, sf_dir):
    """Chunks of whole sentences. Tested: in order they hold each document's sentences, and bounds hold."""
    return V.sentence_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))


CALC = f"""WITH {LI} SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 0 THEN 'operand not in evidence' WHEN l_linenumber % 7 = 0 THEN 'does not evaluate' WHEN l_partkey % 10 = 3 THEN 'wrong result' ELSE 'pass' END AS status FROM li"""


@query("X13_calc", CALC)
def x13(spark, sf_dir):
    """Each line's price arithmetic as text, recomputed: some have a foreign operand, brackets, or a wrong result."""
    t = li(spark, sf_dir)
    qty, price, tax = F.col("qty"), F.col("cents"), F.col("tax")
    off = F.when(F.col("l_partkey") % 10 == 3, 1).otherwise(0)
    foreign = F.col("l_linenumber") % 5 == 0
    result = qty * price - tax + off
    calc = F.when(foreign, F.format_string("%d * %d - %d + 987654321.5 = %d", qty, price, tax, result)).when(F.col("l_linenumber") % 7 == 0, F.format_string("(%d * %d) - %d = %d", qty, price, tax, result)).otherwise(F.format_string("%d * %d - %d = %d", qty, price, tax, result))
    return t.select("l_orderkey", "l_linenumber", V.check_calc(calc, F.array(*[c.cast("double") for c in (qty, price, tax)])).alias("status"))


COSINE = "list_cosine_similarity(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"


@query("R19_quantised_recall", f"""WITH v AS (SELECT vec_id, embedding AS e, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 127 / greatest(list_max(list_transform(embedding, lambda y: abs(CAST(y AS DOUBLE)))), 1e-9)) AS BIGINT)) AS q FROM embeddings),
 p AS (SELECT a.vec_id AS query_id, b.vec_id, round({COSINE.format("a.e", "b.e")}, 6) AS exact, round({COSINE.format("a.q", "b.q")}, 6) AS rough FROM v a, v b WHERE a.vec_id % 100 = 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, vec_id) AS place, row_number() OVER (PARTITION BY query_id ORDER BY rough DESC, vec_id) AS seat FROM p),
 f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, vec_id) AS final FROM k WHERE seat <= 20)
 SELECT query_id, count(*) AS found FROM f WHERE final <= 10 AND place <= 10 GROUP BY 1""")
def r19(spark, sf_dir):
    """Of the ten exact neighbours of every hundredth vector, how many a search over 8-bit vectors finds: 20 kept, then rescored."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return N.quantised_recall(v.filter(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "query_id"), v)


@query("R19_index_recall")
def r19_index(spark, sf_dir):
    """The ten neighbours of every hundredth vector that an index of random projections finds, of the ten that an exact search finds."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = v.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return N.recall(N.approximate(asked, v, N.fit(v), 10), N.exact(asked, v, 10, -2.0))


def _any(words: str, cues: list[str]) -> str:
    return f"list_has_any({words}, {cues!r})"


@query("R21_claim_verdicts", rf"""WITH c AS (SELECT conv_id, turn, text, lag(CASE WHEN role <> 'system' THEN text END) OVER (PARTITION BY conv_id ORDER BY turn) AS sentence, role FROM conversations),
 w AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS a, list_distinct(regexp_extract_all(lower(sentence), '[a-z]+')) AS b, list_distinct(regexp_extract_all(text, '[0-9]+')) AS na, list_distinct(regexp_extract_all(sentence, '[0-9]+')) AS nb FROM c WHERE role = 'assistant'),
 z AS (SELECT *, round(len(list_intersect(a, b)) / nullif(len(a), 0), 6) AS score FROM w)
 SELECT conv_id * 1000 + turn AS claim_id, CASE WHEN sentence IS NULL THEN NULL ELSE score END AS score, CASE WHEN sentence IS NULL THEN 'no citation' WHEN NOT list_has_all(nb, na) THEN 'quantity not in evidence' WHEN {_any('a', V.NEGATIONS)} <> {_any('b', V.NEGATIONS)} THEN 'polarity differs'
 WHEN {_any('a', V.OBLIGATIONS)} AND NOT {_any('b', V.OBLIGATIONS)} THEN 'obligation added' WHEN score >= 0.92 THEN 'supported' WHEN coalesce(score, 0) < 0.5 THEN 'rejected' WHEN turn % 3 = 0 THEN 'supported by judge' ELSE 'rejected by judge' END AS status FROM z""")
def r21(spark, sf_dir):
    """Each assistant turn as a claim that cites the turn before it; the judge answers every third turn."""
    t = table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 1000 + F.col("turn")
    before = F.lag(F.when(F.col("role") != "system", F.col("text"))).over(Window.partitionBy("conv_id").orderBy("turn"))
    turns = t.withColumn("sentence", before).filter(F.col("role") == "assistant")
    claims = turns.select(key.alias("claim_id"), key.alias("cite"), F.col("text").alias("claim"), F.when(F.col("turn") % 3 == 0, True).alias("judge"))
    return V.verify(claims, turns.filter(F.col("sentence").isNotNull()).select(key.alias("cite"), "sentence"))


@query("E04_channels", f"""WITH {EV}, d AS (SELECT user_id, us // 86400000000 AS step, count(*) AS appended, count(DISTINCT event_type) AS writers, arg_max(cents, event_id) AS last FROM ev GROUP BY ALL)
 SELECT user_id, step, appended, CASE WHEN writers = 1 THEN last END AS last_value, writers > 1 AS conflict FROM d""")
def e04(spark, sf_dir):
    """Channels of a run's step: what was appended, the last value, and whether two writers wrote it (then it has none)."""
    d = ev(spark, sf_dir).groupBy("user_id", whole(F.col("us"), DAY).alias("step")).agg(F.count("*").alias("appended"), F.countDistinct("event_type").alias("writers"), F.max_by("cents", "event_id").alias("last"))
    return d.select("user_id", "step", "appended", F.when(F.col("writers") == 1, F.col("last")).alias("last_value"), (F.col("writers") > 1).alias("conflict"))


SLOTS = f"list_transform(range(16), lambda i: CAST(len(list_filter(list_transform({TOKENS}, lambda w: CAST('0x' || substr(md5(w), 32, 1) AS BIGINT)), lambda x: x = i)) AS DOUBLE))"


@query("E02_models", f"""WITH {PAIRS}, p AS (SELECT query_id, doc_id, {SLOTS.replace("text", "b.text")} AS x, {SLOTS.replace("text", "o.text")} AS y FROM m JOIN benchmark b ON b.item_id = query_id JOIN documents o USING (doc_id) WHERE common > 0), c AS (SELECT query_id, doc_id, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE round(list_cosine_similarity(x, y), 6) END AS score FROM p), r AS (SELECT *, CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, doc_id) END AS rank FROM c) SELECT query_id, doc_id, score, rank FROM r WHERE coalesce(rank <= 10, true)""")
def e02(spark, sf_dir):
    """An embedder and a reranker handed in as column functions; one that gives no answer for some pairs."""
    def embed(text):
        slot = F.transform(X.tokens(text), lambda w: F.conv(F.substring(F.md5(w), 32, 1), 16, 10).cast("int"))
        # the slots are the one element of an array, so that they are worked out once a text and not once a number
        counts = F.transform(F.array(slot), lambda s: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.size(F.filter(s, lambda x: x == i)).cast("double")))
        return F.get(counts, F.lit(0))

    def score(a, b):
        return F.when(F.col("doc_id") % 13 != 0, X.cosine(a, b))

    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("d"))
    return V.rerank(token_pairs(spark, sf_dir), q, d, embed, score, 10)


@query("E03_gates", r"""SELECT conv_id, turn, CASE WHEN length(text) % 11 = 0 OR length(text) % 7 = 0 THEN 'unanswered' WHEN (length(text) % 100) / 100.0 >= 0.5 AND contains(text, 'th') THEN 'pass' ELSE 'fail' END AS verdict FROM conversations WHERE role = 'assistant'""")
def e03(spark, sf_dir):
    """An entailment score and a judge handed in as column functions; without an answer a claim fails closed."""
    n = F.length("text")
    claims = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    found = V.gated(claims, lambda _: F.when(n % 11 != 0, (n % 100) / 100), lambda _: F.when(n % 7 != 0, F.contains(F.col("text"), F.lit("th"))))
    return found.select("conv_id", "turn", "verdict")


@query("E06_clock", f"""WITH {EV}, c AS (SELECT max(us) AS now FROM ev), t AS (SELECT event_type, us, now, 0 AS later FROM ev, c UNION ALL SELECT event_type, us, now + 86400000000, 1 FROM ev, c) SELECT event_type, CAST(later AS INT) AS later, count(*) FILTER (now - us > 172800000000) AS stale, min(now - us) AS least_us FROM t GROUP BY ALL""")
def e06(spark, sf_dir):
    """The same rows by two clocks: that of the newest row, and a day later."""
    e = ev(spark, sf_dir).crossJoin(F.broadcast(ev(spark, sf_dir).agg(F.max("us").alias("now"))))  # one row
    clocks = [V.stale(e, F.col("now") + k * DAY, "us", 2 * DAY).withColumn("later", F.lit(k)) for k in (0, 1)]
    both = clocks[0].unionByName(clocks[1])
    return both.groupBy("event_type", "later").agg(F.count_if("stale").alias("stale"), F.min("age_us").alias("least_us"))
