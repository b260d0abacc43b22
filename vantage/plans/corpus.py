"""Queries over documents, pages, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantage.catalog import ORACLES, query
from vantage.functions.time import whole
from vantage.operators import text as X
from vantage.operators import trigrams as G
from vantage.operators.nearest import all_scores
from vantage.sources.tables import table


# the tokens of X.tokens() in SQL
TOKENS = "list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN (" + ",".join(f"'{w}'" for w in X.STOP_WORDS) + "))"


def benchmark(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def relevant(spark, sf_dir) -> DataFrame:
    """(query_id, doc_id) of the documents that hold a benchmark text whole."""
    return X.holders(benchmark(spark, sf_dir), table(spark, sf_dir, "documents"))


@query("X01_tokens", r"""SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','in','is','it','its','of','on','or','that','the','to','was','with'))) AS n, md5(array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','in','is','it','its','of','on','or','that','the','to','was','with')), ' ')) AS h FROM documents""")
def x01(spark, sf_dir):
    t = X.tokens("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("h"))


@query("X02_unicode_tokens", r"""SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}'']+')) AS n FROM documents""")
def x02(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}']+"), F.lit(0))).cast("long").alias("n"))


@query("X03_hash_embedding", r"""WITH t AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','in','is','it','its','of','on','or','that','the','to','was','with'))) AS w FROM documents), c AS (SELECT doc_id, CAST('0x' || substr(md5(w), 31, 2) AS BIGINT) AS slot, count(*) AS n FROM t GROUP BY ALL) SELECT doc_id, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 8) AS v FROM c""")
def x03(spark, sf_dir):
    """Counts of tokens in 256 slots, of length one; the empty slots are left out."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.tokens("text")).alias("w"))
    slot = F.conv(F.substring(F.md5("w"), 31, 2), 16, 10).cast("long")
    c = t.groupBy("doc_id", slot.alias("slot")).agg(F.count("*").alias("n"))
    return c.select("doc_id", "slot", F.round(F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("doc_id"))), 8).alias("v"))


@query("X04_cosine", r"""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0) SELECT query_id, vec_id, round(list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM embeddings, q""")
def x04(spark, sf_dir):
    """Every hundredth vector as a query against all."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return all_scores(v.filter(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "query_id"), v)


# every hundredth item is a query; a pair that shares no token scores nothing and has no row
PAIRS = f"""q AS (SELECT item_id AS query_id, list_distinct({TOKENS}) AS q, lower(substr(text, 1, 12)) AS phrase FROM benchmark WHERE item_id % 100 = 0), d AS (SELECT doc_id, lower(text) AS low, list_distinct({TOKENS}) AS t FROM documents), m AS (SELECT *, len(list_intersect(q, t)) AS common, len(list_distinct(list_concat(q, t))) AS either FROM d, q)"""


def token_pairs(spark, sf_dir) -> DataFrame:
    """(query_id, doc_id, both, a, b): the tokens that a query and a document share, and how many each has."""
    q = table(spark, sf_dir, "benchmark").filter(F.col("item_id") % 100 == 0).select(F.col("item_id").alias("query_id"), F.array_distinct(X.tokens("text")).alias("q"))
    t = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(X.tokens("text")).alias("t"))
    ours = q.select("query_id", F.size("q").alias("a"), F.explode("q").alias("word"))
    theirs = t.select("doc_id", F.size("t").alias("b"), F.explode("t").alias("word"))
    return theirs.join(ours, "word").groupBy("query_id", "doc_id", "a", "b").agg(F.count("*").alias("both"))


@query("X05_jaccard", f"""WITH {PAIRS} SELECT query_id, doc_id, CAST(common AS DOUBLE) / either AS j FROM m WHERE common > 0""")
def x05(spark, sf_dir):
    return token_pairs(spark, sf_dir).select("query_id", "doc_id", (F.col("both") / (F.col("a") + F.col("b") - F.col("both"))).alias("j"))


@query("X06_lexical_score", f"""WITH {PAIRS} SELECT query_id, doc_id, round(least(1.0, 0.6 * common / len(q) + 0.25 * common / either + CASE WHEN contains(low, phrase) THEN 0.2 ELSE 0 END) + 1e-9, 6) AS score FROM m WHERE common > 0""")
def x06(spark, sf_dir):
    """Cover of the query's tokens, overlap and a bonus for its first letters, for pairs that share a token."""
    q = table(spark, sf_dir, "benchmark").filter(F.col("item_id") % 100 == 0).select(F.col("item_id").alias("query_id"), F.lower(F.substring("text", 1, 12)).alias("phrase"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("low"))
    p = token_pairs(spark, sf_dir).join(q, "query_id").join(d, "doc_id")
    score = 0.6 * (F.col("both") / F.col("a")) + 0.25 * (F.col("both") / (F.col("a") + F.col("b") - F.col("both"))) + F.when(F.contains("low", F.col("phrase")), 0.2).otherwise(0.0)
    return p.select("query_id", "doc_id", F.round(F.least(F.lit(1.0), score) + 1e-9, 6).alias("score"))


@query("X07_freshness", r"""SELECT doc_id, round(pow(0.5, (doc_id % 365) / 90.0), 8) AS freshness, doc_id % 365 > 180 AS stale FROM documents""")
def x07(spark, sf_dir):
    age = F.col("doc_id") % 365
    return table(spark, sf_dir, "documents").select("doc_id", F.round(F.pow(F.lit(0.5), age / 90.0), 8).alias("freshness"), (age > 180).alias("stale"))


@query("X14_normalise", r"""SELECT doc_id, len(trim(regexp_replace(replace(replace(text, chr(173), ''), chr(64257), 'fi'), '\s+', ' ', 'g'))) AS n FROM documents""")
def x14(spark, sf_dir):
    """Soft hyphens, ligatures and white space; compatibility forms stay."""
    t = F.replace(F.replace("text", F.lit("\u00ad"), F.lit("")), F.lit("\ufb01"), F.lit("fi"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(F.trim(F.regexp_replace(t, r"\s+", " "))).cast("long").alias("n"))


@query("X15_parse_quality", r"""WITH d AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '[a-zA-Z]')) AS DOUBLE) / greatest(1, len(text)) AS r FROM documents) SELECT doc_id, CASE WHEN r >= 0.75 THEN 'accept' WHEN r >= 0.6 THEN 'review' WHEN r >= 0.3 THEN 'reparse' ELSE 'reject' END AS action FROM d""")
def x15(spark, sf_dir):
    r = F.length(F.regexp_replace("text", "[^a-zA-Z]", "")) / F.greatest(F.lit(1), F.length("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(r >= 0.75, "accept").when(r >= 0.6, "review").when(r >= 0.3, "reparse").otherwise("reject").alias("action"))


@query("X17_identifiers", r"""WITH i AS (SELECT doc_id, unnest(regexp_extract_all(text, 'AKIA[0-9A-Z]{16}')) AS code FROM documents) SELECT doc_id, code, count(*) AS n FROM i GROUP BY ALL""")
def x17(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("AKIA[0-9A-Z]{16}"), F.lit(0))).alias("code")).groupBy("doc_id", "code").agg(F.count("*").alias("n"))


@query("X19_language_tag", r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-zäöüßéèêñçáíóú]+') AS w FROM documents), s AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ('the','of','and','to','in','is','that'))) AS en, len(list_filter(w, lambda x: x IN ('der','die','und','das','den','ist','von'))) AS de, len(list_filter(w, lambda x: x IN ('le','la','les','et','une','est','que'))) AS fr, len(list_filter(w, lambda x: x IN ('el','los','las','una','del','por','su'))) AS es FROM t) SELECT doc_id, CASE WHEN en >= de AND en >= fr AND en >= es THEN 'en' WHEN de >= fr AND de >= es THEN 'de' WHEN fr >= es THEN 'fr' ELSE 'es' END AS tag FROM s""")
def x19(spark, sf_dir):
    marks = {"en": "the of and to in is that", "de": "der die und das den ist von", "fr": "le la les et une est que", "es": "el los las una del por su"}
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-zäöüßéèêñçáíóú]+"), F.lit(0))
    held = lambda m: F.size(F.filter("w", lambda x: x.isin(*m.split())))
    s = table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).select("doc_id", *[held(m).alias(n) for n, m in marks.items()])
    c = F.col
    tag = F.when((c("en") >= c("de")) & (c("en") >= c("fr")) & (c("en") >= c("es")), "en").when((c("de") >= c("fr")) & (c("de") >= c("es")), "de").when(c("fr") >= c("es"), "fr").otherwise("es")
    return s.select("doc_id", tag.alias("tag"))


@query("X21_parent_domain", r"""SELECT page_id, regexp_extract(regexp_extract(url, '://([^/?#]+)', 1), '([^.]+\.[^.]+)$', 1) AS domain FROM pages""")
def x21(spark, sf_dir):
    host = F.regexp_extract("url", "://([^/?#]+)", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.substring_index(host, ".", -2).alias("domain"))


@query("A23_tunnelling", r"""WITH h AS (SELECT regexp_extract(url, '://([^/?#]+)', 1) AS host, url FROM pages), g AS (SELECT regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS domain, host, url FROM h) SELECT domain, count(*) AS n, count(DISTINCT host) AS hosts, CAST(count(DISTINCT host) AS DOUBLE)/count(*) AS ratio, avg(len(url)) AS mean_length FROM g GROUP BY 1 HAVING count(*) >= 10""")
def a23(spark, sf_dir):
    host = F.regexp_extract("url", "://([^/?#]+)", 1)
    g = table(spark, sf_dir, "pages").select(F.substring_index(host, ".", -2).alias("domain"), host.alias("host"), F.length("url").alias("len"))
    out = g.groupBy("domain").agg(F.count("*").alias("n"), F.countDistinct("host").alias("hosts"), F.avg("len").alias("mean_length"))
    return out.filter(F.col("n") >= 10).withColumn("ratio", F.col("hosts") / F.col("n"))


@query("P11_role_visibility", r"""SELECT doc_id FROM documents WHERE source IN ('src0','src1','src2')""")
def p11(spark, sf_dir):
    """The union over a principal's known roles; an unknown role adds nothing."""
    roles = spark.createDataFrame([("analyst", "src0"), ("analyst", "src1"), ("support", "src1"), ("support", "src2"), ("other", "src9")], "role string, source string")
    seen = roles.filter(F.col("role").isin("analyst", "support", "nobody")).select("source").distinct()
    return table(spark, sf_dir, "documents").join(F.broadcast(seen), "source", "left_semi").select("doc_id")


@query("P16_multiline", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), s AS (SELECT doc_id, sum(CASE WHEN regexp_matches(line, '^[A-E]') OR i = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS rec FROM l) SELECT doc_id, CAST(rec AS BIGINT) AS rec, count(*) AS lines FROM s GROUP BY ALL""")
def p16(spark, sf_dir):
    """A line that looks like a start begins a record; the others continue it."""
    l = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    start = ((F.col("i") == 0) | F.col("line").rlike("^[A-E]")).cast("int")
    rec = F.sum(start).over(Window.partitionBy("doc_id").orderBy("i"))
    return l.select("doc_id", rec.alias("rec")).groupBy("doc_id", "rec").agg(F.count("*").alias("lines"))


@query("P17_log_search", r"""SELECT doc_id FROM documents WHERE lang = 'en' AND contains(text, 'password') AND regexp_matches(text, 'password=[0-9a-f]+') ORDER BY doc_id DESC LIMIT 100""")
def p17(spark, sf_dir):
    hit = (F.col("lang") == "en") & F.contains("text", F.lit("password")) & F.col("text").rlike("password=[0-9a-f]+")
    return table(spark, sf_dir, "documents").filter(hit).orderBy(F.desc("doc_id")).limit(100).select("doc_id")


@query("P18_literal_prefilter", r"""SELECT doc_id FROM documents WHERE regexp_matches(text, 'tok(en|ens) = "[0-9a-f]{8}')""")
def p18(spark, sf_dir):
    # the literal that every match must hold is tested first; the pattern itself decides
    return table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("tok"))).filter(F.col("text").rlike("tok(en|ens) = \"[0-9a-f]{8}")).select("doc_id")


@query("P19_trigram_index", r"""SELECT doc_id FROM documents WHERE contains(lower(text), 'idiot')""")
def p19(spark, sf_dir):
    """Only blocks of documents that hold all trigrams of the word are read; each text is verified."""
    return G.search(G.build(table(spark, sf_dir, "documents")), "idiot")


@query("P19_blocks_read", r"""WITH g AS (SELECT doc_id // 64 AS block, bool_or(contains(lower(text), 'idi')) AND bool_or(contains(lower(text), 'dio')) AND bool_or(contains(lower(text), 'iot')) AS candidate FROM documents GROUP BY 1) SELECT count(*) AS blocks, count(*) FILTER (candidate) AS to_read FROM g""")
def p19_blocks(spark, sf_dir):
    """How many blocks there are, and how many a search for the word reads."""
    index = G.build(table(spark, sf_dir, "documents"))
    read = G.candidates(index, "idiot").agg(F.count("*").alias("to_read"))
    return index.texts.agg(F.countDistinct("block").alias("blocks")).crossJoin(read)  # one row each


@query("P25_redaction", r"""SELECT doc_id, len(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '\b\d{3}-\d{2}-\d{4}\b', '[SSN]', 'g'), 'AKIA[0-9A-Z]{16}', '[AWS_KEY]', 'g')) AS n, concat_ws(',', CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') THEN 'EMAIL' END, CASE WHEN regexp_matches(text, '\b\d{3}-\d{2}-\d{4}\b') THEN 'SSN' END, CASE WHEN regexp_matches(text, 'AKIA[0-9A-Z]{16}') THEN 'AWS_KEY' END) AS labels FROM documents""")
def p25(spark, sf_dir):
    text, labels = X.redact(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(text).cast("long").alias("n"), F.array_join(labels, ",").alias("labels"))


@query("P26_card_redaction", r"""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b\d{13,16}\b')) AS c FROM documents), v AS (SELECT doc_id, list_sum(list_transform(range(1, length(c) + 1), lambda i: CASE WHEN (length(c) - i) % 2 = 0 THEN CAST(c[i] AS INT) WHEN CAST(c[i] AS INT) > 4 THEN CAST(c[i] AS INT) * 2 - 9 ELSE CAST(c[i] AS INT) * 2 END)) AS s FROM c) SELECT doc_id, count(*) AS cards FROM v WHERE s % 10 = 0 GROUP BY 1""")
def p26(spark, sf_dir):
    cards = F.filter(F.regexp_extract_all("text", F.lit(X.CARD), F.lit(0)), X.luhn)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(cards).cast("long").alias("cards")).filter(F.col("cards") > 0)


@query("P28_injection_flags", r"""SELECT conv_id, turn, regexp_matches(text, '(?i)(ignore (all|previous) instructions|system prompt|you are now|disregard|act as)') AS flagged FROM conversations""")
def p28(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").rlike(r"(?i)(ignore (all|previous) instructions|system prompt|you are now|disregard|act as)").alias("flagged"))


@query("P29_input_guard", r"""SELECT conv_id, turn, CASE WHEN len(text) > 600 THEN 'too_long' WHEN regexp_matches(text, '(?i)(ignore (all|previous) instructions|system prompt|you are now|disregard|act as)') THEN 'injection' ELSE 'ok' END AS reason FROM conversations""")
def p29(spark, sf_dir):
    reason = F.when(F.length("text") > 600, "too_long").when(F.col("text").rlike(r"(?i)(ignore (all|previous) instructions|system prompt|you are now|disregard|act as)"), "injection").otherwise("ok")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", reason.alias("reason"))


@query("J13_hydration_gate", r"""SELECT doc_id FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 4 <> 3 AND (source IN ('src0','src1') OR doc_id % 5 = 0)""")
def j13(spark, sf_dir):
    """Active documents with a live version, by access list or open to all."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    live = d.filter((F.col("doc_id") % 9 != 0) & (F.col("doc_id") % 4 != 3))
    acl = spark.createDataFrame([("src0",), ("src1",)], "source string")
    allowed = live.join(F.broadcast(acl), "source", "left_semi").select("doc_id")
    return allowed.unionByName(live.filter(F.col("doc_id") % 5 == 0).select("doc_id")).distinct()


@query("J14_delivery_check", r"""SELECT doc_id // 3 AS answer, bool_and(doc_id % 9 <> 0) AS deliverable FROM documents GROUP BY 1""")
def j14(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(whole(F.col("doc_id"), 3).alias("answer")).agg(F.bool_and(F.col("doc_id") % 9 != 0).alias("deliverable"))


@query("J15_restore_replay", r"""SELECT doc_id FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 6 <> 1""")
def j15(spark, sf_dir):
    """A snapshot less later deletions and superseded versions."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.join(d.filter(F.col("doc_id") % 11 == 0), "doc_id", "left_anti").join(d.filter(F.col("doc_id") % 6 == 1), "doc_id", "left_anti")


@query("J28_glossary", r"""WITH g(term, more) AS (VALUES ('the', 'article'), ('and', 'conjunction')), t AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS term FROM benchmark) SELECT item_id, more AS term FROM t JOIN g USING (term) UNION ALL SELECT item_id, term FROM t""")
def j28(spark, sf_dir):
    g = spark.createDataFrame([("the", "article"), ("and", "conjunction")], "term string, more string")
    t = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("term"))
    return t.unionByName(t.join(F.broadcast(g), "term").select("item_id", F.col("more").alias("term")))


CHUNKS = """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS para FROM documents), w AS (SELECT doc_id, para, list_filter(regexp_split_to_array(body, '[ \\t]+'), lambda x: x <> '') AS w FROM p), k AS (SELECT *, len(w) AS n, greatest(1, CAST(ceil((len(w) - {overlap}) / ({size} - {overlap})) AS BIGINT)) AS k FROM w WHERE len(w) > 0), m AS (SELECT *, CASE WHEN k > 1 AND n - (k - 1) * ({size} - {overlap}) < {least} THEN k - 1 ELSE k END AS m FROM k), i AS (SELECT *, unnest(range(m)) AS i FROM m), c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para, i) - 1 AS position, length(array_to_string(w[i * ({size} - {overlap}) + 1 : CASE WHEN i = m - 1 THEN n ELSE i * ({size} - {overlap}) + {size} END], ' ')) AS n FROM i)"""


@query("R01_chunks", CHUNKS.format(size=120, overlap=24, least=20) + " SELECT doc_id, position, n FROM c")
def r01(spark, sf_dir):
    return X.chunks(table(spark, sf_dir, "documents")).select("doc_id", "position", F.length("text").cast("long").alias("n"))


@query("R04_page_furniture", r"""WITH l AS (SELECT DISTINCT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT source, line, count(*) AS n FROM l GROUP BY ALL), s AS (SELECT source, count(*) AS docs FROM documents GROUP BY 1) SELECT source, line, n FROM c JOIN s USING (source) WHERE n > 0.03 * docs AND len(line) > 10""")
def r04(spark, sf_dir):
    """Lines on more than a share of a source's pages."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    c = d.select("source", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line")).filter(F.length("line") > 10).groupBy("source", "line").agg(F.count("*").alias("n"))
    return c.join(d.groupBy("source").agg(F.count("*").alias("docs")), "source").filter(F.col("n") > 0.03 * F.col("docs")).select("source", "line", "n")


@query("R05_bm25", r"""WITH d0 AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','in','is','it','its','of','on','or','that','the','to','was','with')) AS t FROM documents), p AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, unnest(t) AS term, len(t) AS len FROM d0) GROUP BY ALL),
 s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d0), qt AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','in','is','it','its','of','on','or','that','the','to','was','with')))) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
 sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score FROM qt JOIN p USING (term) JOIN df USING (term), s GROUP BY ALL),
 bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 20) SELECT query_id, doc_id, score, rank FROM bm""")
def r05(spark, sf_dir):
    return X.bm25(benchmark(spark, sf_dir), table(spark, sf_dir, "documents"))


@query("R06_dense", r"""WITH dn AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q, embeddings v), dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM dn WHERE score > 0 QUALIFY rank <= 20) SELECT query_id, vec_id, score, rank FROM dr""")
def r06(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return X.dense(v.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding"), v)


@query("R07_rrf", r"""WITH d0 AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','in','is','it','its','of','on','or','that','the','to','was','with')) AS t FROM documents), p AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, unnest(t) AS term, len(t) AS len FROM d0) GROUP BY ALL),
 s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d0), qt AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','in','is','it','its','of','on','or','that','the','to','was','with')))) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
 sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score FROM qt JOIN p USING (term) JOIN df USING (term), s GROUP BY ALL),
 bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 20), f AS (SELECT query_id, doc_id, 1.0 / (60 + rank) AS part FROM bm UNION ALL SELECT query_id, doc_id, 2.0 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY doc_id)) FROM bm) SELECT query_id, doc_id, round(CAST(sum(part) AS DOUBLE), 8) AS score FROM f GROUP BY ALL""")
def r07(spark, sf_dir):
    first = X.bm25(benchmark(spark, sf_dir), table(spark, sf_dir, "documents")).select("query_id", "doc_id", "rank")
    second = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")).cast("long"))
    return X.fuse([(first, 1.0), (second, 2.0)], "doc_id")


@query("R08_hybrid", ORACLES["R05_bm25"].rsplit(" SELECT query_id, doc_id, score, rank FROM bm", 1)[0] + f""", t AS (SELECT query_id, bm.doc_id, list_distinct({TOKENS.replace("text", "d.text")}) AS t, list_distinct({TOKENS.replace("text", "b.text")}) AS q FROM bm JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id), r AS (SELECT query_id, doc_id, 0.6 * len(list_intersect(q, t)) / len(q) + 0.25 * len(list_intersect(q, t)) / len(list_distinct(list_concat(q, t))) AS rerank FROM t), x AS (SELECT query_id, doc_id, round(0.8 * rerank + 0.2 * pow(0.5, (doc_id % 365) / 90.0), 6) AS score FROM r WHERE rerank >= 0.05) SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x QUALIFY rank <= 5""")
def r08(spark, sf_dir):
    """Candidates, fusion, lexical rerank with a floor, and freshness."""
    d, q = table(spark, sf_dir, "documents"), benchmark(spark, sf_dir)
    best = X.bm25(q, d).select("query_id", "doc_id", "rank")
    fused = X.fuse([(best, 1.0)], "doc_id")
    t = fused.join(d.select("doc_id", F.array_distinct(X.tokens("text")).alias("t")), "doc_id").join(q.select("query_id", F.array_distinct(X.tokens("text")).alias("q")), "query_id")
    rerank = 0.6 * F.size(F.array_intersect("q", "t")) / F.size("q") + 0.25 * X.jaccard(F.col("q"), F.col("t"))
    fresh = F.pow(F.lit(0.5), (F.col("doc_id") % 365) / 90.0)
    scored = t.withColumn("rerank", rerank).filter(F.col("rerank") >= 0.05).withColumn("score", F.round(0.8 * F.col("rerank") + 0.2 * fresh, 6))
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", at.cast("long")).filter(F.col("rank") <= 5).select("query_id", "doc_id", "score", "rank")


DENSE = """{name} AS (SELECT {id}, slot, count(*) AS n FROM (SELECT {id}, CAST('0x' || substr(md5(unnest(t)), 31, 2) AS BIGINT) AS slot FROM (SELECT {id}, {tokens} AS t FROM {table})) GROUP BY ALL), {name}_len AS (SELECT {id}, sqrt(sum(n * n)) AS length FROM {name} GROUP BY 1)"""


@query("R08_hybrid_dense", ORACLES["R05_bm25"].rsplit(" SELECT query_id, doc_id, score, rank FROM bm", 1)[0] + ", " + DENSE.format(name="dv", id="doc_id", tokens=TOKENS, table="documents") + ", " + DENSE.format(name="qv", id="item_id", tokens=TOKENS, table="benchmark") + f""",
 dn AS (SELECT item_id AS query_id, doc_id, round(sum(dv.n * qv.n) / max(dv_len.length) / max(qv_len.length), 6) AS score FROM dv JOIN qv USING (slot) JOIN dv_len USING (doc_id) JOIN qv_len USING (item_id) GROUP BY ALL), dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dn WHERE score > 0 QUALIFY rank <= 20),
 fa AS (SELECT query_id, doc_id, round(CAST(sum(1.0 / (60 + rank)) AS DOUBLE), 8) AS fused FROM (SELECT query_id, doc_id, rank FROM bm UNION ALL SELECT query_id, doc_id, rank FROM dr) GROUP BY ALL), fu AS (SELECT query_id, doc_id FROM fa QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, doc_id) <= 12),
 t AS (SELECT query_id, fu.doc_id, list_distinct({TOKENS.replace("text", "d.text")}) AS t, list_distinct({TOKENS.replace("text", "b.text")}) AS q FROM fu JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = query_id), r AS (SELECT query_id, doc_id, 0.6 * len(list_intersect(q, t)) / len(q) + 0.25 * len(list_intersect(q, t)) / len(list_distinct(list_concat(q, t))) AS rerank FROM t), x AS (SELECT query_id, doc_id, round(0.8 * rerank + 0.2 * pow(0.5, (doc_id % 365) / 90.0), 6) AS score FROM r WHERE rerank >= 0.05) SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x QUALIFY rank <= 5""")
def r08_dense(spark, sf_dir):
    """Twenty by words and twenty by vectors, fused, twelve reranked, with a floor and freshness, the best five."""
    d, q = table(spark, sf_dir, "documents").select("doc_id", "text"), benchmark(spark, sf_dir)
    return X.hybrid(q, d, age_days=F.col("doc_id") % 365)


@query("R09_conflicts", r"""WITH c AS (SELECT source AS key, n_chars % 3 AS value, max(doc_id) AS ver FROM documents GROUP BY ALL) SELECT key, arg_max(value, ver) AS resolved, count(*) AS candidates FROM c GROUP BY key HAVING count(*) > 1""")
def r09(spark, sf_dir):
    """The freshest of several values wins; how many there were stays known."""
    c = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("key"), (F.col("n_chars") % 3).alias("value")).agg(F.max("doc_id").alias("at"))
    return c.groupBy("key").agg(F.max_by("value", "at").alias("resolved"), F.count("*").alias("candidates")).filter(F.col("candidates") > 1)


@query("R10_near_duplicates", r"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [trim(text)] ELSE list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL), l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE common >= 0.9 * (p.n + q.n - common) - 1e-9), r AS (SELECT doc_id, doc_id AS low FROM documents UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.doc_id) SELECT doc_id, min(low) AS cluster FROM r GROUP BY 1""")
def r10(spark, sf_dir):
    return X.near_duplicates(table(spark, sf_dir, "documents"))


@query("R11_leak_overlap", r"""WITH w AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), b AS (SELECT DISTINCT id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w)), x AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), d AS (SELECT DISTINCT id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM x)), n AS (SELECT id, count(*) AS n FROM b GROUP BY 1) SELECT d.id AS doc_id, b.id AS item_id, CAST(count(*) AS DOUBLE) / any_value(n) AS overlap FROM d JOIN b USING (g) JOIN n ON n.id = b.id GROUP BY ALL HAVING CAST(count(*) AS DOUBLE) / any_value(n) >= 0.5""")
def r11(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", X.shingles(F.col("text")).alias("s"))
    b = b.select("item_id", F.size("s").alias("n"), F.explode("s").alias("g"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.shingles(F.col("text"))).alias("g"))
    hit = d.join(b, "g").groupBy("doc_id", "item_id").agg((F.count("*") / F.first("n")).alias("overlap"))
    return hit.filter(F.col("overlap") >= 0.5)


@query("R12_diversity", r"""WITH d0 AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','in','is','it','its','of','on','or','that','the','to','was','with')) AS t FROM documents), p AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, unnest(t) AS term, len(t) AS len FROM d0) GROUP BY ALL),
 s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d0), qt AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','in','is','it','its','of','on','or','that','the','to','was','with')))) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
 sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score FROM qt JOIN p USING (term) JOIN df USING (term), s GROUP BY ALL),
 bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 20), d AS (SELECT bm.*, row_number() OVER (PARTITION BY query_id, doc_id % 10 ORDER BY rank) AS k FROM bm) SELECT query_id, doc_id, rank FROM d WHERE k <= 1""")
def r12(spark, sf_dir):
    best = X.bm25(benchmark(spark, sf_dir), table(spark, sf_dir, "documents"))
    at = F.row_number().over(Window.partitionBy("query_id", F.col("doc_id") % 10).orderBy("rank"))
    return best.withColumn("k", at).filter(F.col("k") <= 1).select("query_id", "doc_id", "rank")


@query("R13_admission", r"""WITH d0 AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','in','is','it','its','of','on','or','that','the','to','was','with')) AS t FROM documents), p AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, unnest(t) AS term, len(t) AS len FROM d0) GROUP BY ALL),
 s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d0), qt AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','in','is','it','its','of','on','or','that','the','to','was','with')))) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
 sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score FROM qt JOIN p USING (term) JOIN df USING (term), s GROUP BY ALL),
 bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 20), a AS (SELECT query_id, doc_id, rank, score, sum(n_chars // 5) OVER (PARTITION BY query_id ORDER BY rank) AS spent FROM bm JOIN documents USING (doc_id)) SELECT query_id, doc_id FROM a WHERE rank = 1 OR (score >= 5 AND rank <= 8 AND spent <= 3000)""")
def r13(spark, sf_dir):
    best = X.bm25(benchmark(spark, sf_dir), table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    spent = F.sum(whole(F.col("n_chars"), 5)).over(Window.partitionBy("query_id").orderBy("rank"))
    ok = (F.col("rank") == 1) | ((F.col("score") >= 5) & (F.col("rank") <= 8) & (F.col("spent") <= 3000))
    return best.withColumn("spent", spent).filter(ok).select("query_id", "doc_id")


@query("R14_sufficiency", r"""WITH d0 AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','in','is','it','its','of','on','or','that','the','to','was','with')) AS t FROM documents), p AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, unnest(t) AS term, len(t) AS len FROM d0) GROUP BY ALL),
 s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d0), qt AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','in','is','it','its','of','on','or','that','the','to','was','with')))) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
 sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score FROM qt JOIN p USING (term) JOIN df USING (term), s GROUP BY ALL),
 bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 20) SELECT query_id, max(score) AS best, max(score) < 20 AS abstain FROM bm GROUP BY 1""")
def r14(spark, sf_dir):
    return X.bm25(benchmark(spark, sf_dir), table(spark, sf_dir, "documents")).groupBy("query_id").agg(F.max("score").alias("best"), (F.max("score") < 20).alias("abstain"))


@query("R15_neighbours", r"""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), h AS (SELECT doc_id, i FROM s WHERE contains(line, 'idiot')) SELECT DISTINCT s.doc_id, s.i FROM s JOIN h ON s.doc_id = h.doc_id AND s.i BETWEEN h.i - 2 AND h.i + 2""")
def r15(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    near = F.max(F.contains("line", F.lit("idiot"))).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(-2, 2))
    return s.withColumn("near", near).filter("near").select("doc_id", (F.col("i") + 1).cast("long").alias("i"))


@query("R16_recall", r"""WITH d0 AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','in','is','it','its','of','on','or','that','the','to','was','with')) AS t FROM documents), p AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, unnest(t) AS term, len(t) AS len FROM d0) GROUP BY ALL),
 s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d0), qt AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','in','is','it','its','of','on','or','that','the','to','was','with')))) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
 sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score FROM qt JOIN p USING (term) JOIN df USING (term), s GROUP BY ALL),
 bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 20), rel AS (SELECT item_id AS query_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)) SELECT rel.query_id, count(*) AS relevant, count(bm.doc_id) AS found, CAST(count(bm.doc_id) AS DOUBLE)/count(*) AS recall FROM rel LEFT JOIN bm ON rel.query_id = bm.query_id AND rel.doc_id = bm.doc_id AND bm.rank <= 5 GROUP BY 1""")
def r16(spark, sf_dir):
    best = X.bm25(benchmark(spark, sf_dir), table(spark, sf_dir, "documents"), top=5).select("query_id", "doc_id", F.lit(1).alias("hit"))
    j = relevant(spark, sf_dir).join(best, ["query_id", "doc_id"], "left")
    return j.groupBy("query_id").agg(F.count("*").alias("relevant"), F.count("hit").alias("found"), (F.count("hit") / F.count("*")).alias("recall"))


@query("R17_recall_by_language", r"""WITH d0 AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','in','is','it','its','of','on','or','that','the','to','was','with')) AS t FROM documents), p AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, unnest(t) AS term, len(t) AS len FROM d0) GROUP BY ALL),
 s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d0), qt AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','in','is','it','its','of','on','or','that','the','to','was','with')))) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
 sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score FROM qt JOIN p USING (term) JOIN df USING (term), s GROUP BY ALL),
 bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 20), rel AS (SELECT item_id AS query_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)) SELECT lang, count(*) AS relevant, CAST(count(bm.doc_id) AS DOUBLE)/count(*) AS recall FROM rel JOIN documents d ON d.doc_id = rel.doc_id LEFT JOIN bm ON rel.query_id = bm.query_id AND rel.doc_id = bm.doc_id AND bm.rank <= 5 GROUP BY 1""")
def r17(spark, sf_dir):
    best = X.bm25(benchmark(spark, sf_dir), table(spark, sf_dir, "documents"), top=5).select("query_id", "doc_id", F.lit(1).alias("hit"))
    j = relevant(spark, sf_dir).join(best, ["query_id", "doc_id"], "left").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return j.groupBy("lang").agg(F.count("*").alias("relevant"), (F.count("hit") / F.count("*")).alias("recall"))


@query("A85_release_gate", r"""WITH d0 AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','in','is','it','its','of','on','or','that','the','to','was','with')) AS t FROM documents), p AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, unnest(t) AS term, len(t) AS len FROM d0) GROUP BY ALL),
 s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM d0), qt AS (SELECT item_id AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','in','is','it','its','of','on','or','that','the','to','was','with')))) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
 sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score FROM qt JOIN p USING (term) JOIN df USING (term), s GROUP BY ALL),
 bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0 QUALIFY rank <= 20), rel AS (SELECT item_id AS query_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)), r AS (SELECT lang, CAST(count(bm.doc_id) AS DOUBLE)/count(*) AS recall FROM rel JOIN documents d ON d.doc_id = rel.doc_id LEFT JOIN bm ON rel.query_id = bm.query_id AND rel.doc_id = bm.doc_id AND bm.rank <= 5 GROUP BY 1) SELECT lang, recall, recall >= CASE lang WHEN 'en' THEN 0.7 ELSE 0.6 END AS passed FROM r""")
def a85(spark, sf_dir):
    need = F.when(F.col("lang") == "en", 0.7).otherwise(0.6)
    return r17(spark, sf_dir).select("lang", "recall", (F.col("recall") >= need).alias("passed"))


@query("R20_groundedness", r"""WITH s AS (SELECT conv_id, turn, unnest(string_split(text, '.')) AS sent FROM conversations WHERE role = 'assistant'), t AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(sent), '[a-z0-9]+'), lambda w: w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','in','is','it','its','of','on','or','that','the','to','was','with'))) AS t FROM s), e AS (SELECT conv_id, list_distinct(flatten(list(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','in','is','it','its','of','on','or','that','the','to','was','with'))))) AS e FROM conversations WHERE role = 'user' GROUP BY 1) SELECT t.conv_id, turn, coalesce(avg(CASE WHEN len(t) >= 3 THEN CASE WHEN len(list_intersect(t, e)) >= 0.5 * len(t) THEN 1.0 ELSE 0.0 END END), 1.0) AS grounded FROM t JOIN e ON t.conv_id = e.conv_id GROUP BY ALL""")
def r20(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    e = c.filter("role = 'user'").select("conv_id", F.explode(X.tokens("text")).alias("w")).groupBy("conv_id").agg(F.collect_set("w").alias("e"))
    none = c.filter("role = 'user'").select("conv_id").distinct().join(e, "conv_id", "left").select("conv_id", F.coalesce("e", F.array().cast("array<string>")).alias("e"))
    s = c.filter("role = 'assistant'").select("conv_id", "turn", F.explode(F.split("text", "[.]")).alias("s")).select("conv_id", "turn", F.array_distinct(X.tokens("s")).alias("t"))
    ok = F.when(F.size("t") >= 3, F.when(F.size(F.array_intersect("t", "e")) >= 0.5 * F.size("t"), 1.0).otherwise(0.0))
    return s.join(none, "conv_id").groupBy("conv_id", "turn").agg(F.coalesce(F.avg(ok), F.lit(1.0)).alias("grounded"))


@query("R26_cached_answers", r"""SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN '[source removed]' ELSE text END AS rendered FROM conversations WHERE role = 'assistant'""")
def r26(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return c.select("conv_id", "turn", F.when(F.col("conv_id") % 9 == 0, "[source removed]").otherwise(F.col("text")).alias("rendered"))


@query("R28_staleness", r"""SELECT doc_id, doc_id % 400 AS age_days FROM documents WHERE doc_id % 400 > 180""")
def r28(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 400).alias("age_days")).filter(F.col("age_days") > 180)


@query("W09_no_progress", r"""WITH c AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','in','is','it','its','of','on','or','that','the','to','was','with'))) AS t, lag(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: w NOT IN ('a','an','and','are','as','at','be','by','for','from','has','in','is','it','its','of','on','or','that','the','to','was','with')))) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) SELECT conv_id, turn, CASE WHEN b IS NOT NULL AND len(list_distinct(list_concat(t, b))) > 0 THEN CAST(len(list_intersect(t, b)) AS DOUBLE)/len(list_distinct(list_concat(t, b))) ELSE 0 END >= 0.85 AS stuck FROM c""")
def w09(spark, sf_dir):
    t = F.array_distinct(X.tokens("text"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t")).withColumn("b", F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.select("conv_id", "turn", F.coalesce(X.jaccard(F.col("t"), F.col("b")) >= 0.85, F.lit(False)).alias("stuck"))


@query("W23_recent_n", r"""SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3""")
def w23(spark, sf_dir):
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, sf_dir, "conversations").withColumn("at", at).filter(F.col("at") <= 3).select("conv_id", "turn")


@query("U04_candidate_intersection", r"""SELECT doc_id FROM documents WHERE contains(text, 'the') AND contains(text, 'ing')""")
def u04(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.filter(F.contains("text", F.lit("the"))).select("doc_id").intersect(d.filter(F.contains("text", F.lit("ing"))).select("doc_id"))


@query("U05_purge_audit", r"""SELECT doc_id FROM documents WHERE doc_id % 11 <> 0 EXCEPT SELECT doc_id FROM labels""")
def u05(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("doc_id") % 11 != 0).select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("E07_chunk_table_function", CHUNKS.format(size=60, overlap=12, least=10) + " SELECT doc_id, count(*) AS chunks FROM c GROUP BY 1")
def e07(spark, sf_dir):
    return X.chunks(table(spark, sf_dir, "documents"), size=60, overlap=12, least=10).groupBy("doc_id").agg(F.count("*").alias("chunks"))
