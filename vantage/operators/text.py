"""Text: tokens, chunks, retrieval and its evaluation, redaction, near duplicates."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from vantage.operators.nearest import SCORED, exact, meet, ranked, row_best
from vantage.runtime import discard, settle, small_batches

# fixed values
STOP_WORDS = "a an and are as at be by for from has in is it its of on or that the to was with".split()
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
AWS_KEY = r"AKIA[0-9A-Z]{16}"
CARD = r"\b\d{13,16}\b"


def tokens(text: str | Column) -> Column:
    """Lower-cased runs of a-z and 0-9 without stop words."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; 0 if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def chunks(docs: DataFrame, size: int = 120, overlap: int = 24, least: int = 20) -> DataFrame:
    """(doc_id, position, text): word windows over each paragraph; a last window shorter than `least` joins the one before.

    Paragraphs are separated by line feeds here; every window but the first of a paragraph repeats `overlap` words.
    """
    step = size - overlap
    paragraphs = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("para", "body"))
    words = paragraphs.select("doc_id", "para", F.filter(F.split("body", r"[ \t]+"), lambda w: w != "").alias("w")).filter(F.size("w") > 0)
    n = F.size("w")
    windows = F.greatest(F.lit(1), F.ceil((n - overlap) / step)).cast("int")
    full = words.withColumn("k", windows).withColumn("last", n - (F.col("k") - 1) * step)
    merged = F.when((F.col("k") > 1) & (F.col("last") < least), F.col("k") - 1).otherwise(F.col("k"))
    cut = full.withColumn("m", merged)
    piece = F.posexplode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: F.array_join(F.slice("w", i * step + 1, F.when(i == F.col("m") - 1, n - i * step).otherwise(F.lit(size))), " ")))
    out = cut.select("doc_id", "para", piece.alias("i", "text"))
    at = Window.partitionBy("doc_id").orderBy("para", "i")
    return out.select("doc_id", (F.row_number().over(at) - 1).cast("long").alias("position"), "text")


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, tf, length)."""
    t = docs.select(key, tokens(text).alias("t"))
    return t.select(key, F.explode("t").alias("term"), F.size("t").alias("length")).groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


# places after a character that is no letter or digit and before one that is
WORD_START = r"(?<=[^\p{L}\p{N}])(?=[\p{L}\p{N}])"


def _grams(text: str, width: int, at: str = "") -> Column:
    """Every run of `width` characters of a text, repeats included, or those at places that match `at`; none of a shorter text.

    One pass of a pattern: substring() would count from a text's beginning at each place.
    """
    return F.regexp_extract_all(F.col(text), F.lit(f"(?s){at}(?=(.{{{width}}}))"), F.lit(1))


def holders(queries: DataFrame, docs: DataFrame, width: int = 16) -> DataFrame:
    """(query_id, doc_id), each pair once: the documents whose text holds a query's text whole.

    Of the runs of `width` characters only those that start a word inside a text become rows, as hashes, in queries and
    documents alike, so a document that holds a query has the query's first such run too. A query without one, because it is
    short or has no second word, is found by its own beginning among all runs of that length. Each candidate is then tested on the whole texts. The time grows with the texts' length, however long one is.
    Cases: a null text holds nothing and is held by nothing; an empty query is held by every text that isn't null; rows that
    repeat or share an id give a pair once.
    """
    hashed = lambda grams: F.transform(grams, lambda g: F.xxhash64(g))
    starting = lambda text: hashed(_grams(text, width, WORD_START))
    own = queries.select("query_id", F.col("text").alias("q")).filter(F.col("q").isNotNull())
    start = F.substring("q", 1, width)
    first = own.select("query_id", F.try_element_at(starting("q"), F.lit(1)).alias("key"), F.xxhash64(start).alias("whole"), F.length(start).alias("n"))
    # written, so that the planner knows how small they are before it decides how to join
    keys = settle(first.select("query_id", F.coalesce("key", "whole").alias("key"), F.when(F.col("key").isNull(), F.col("n")).alias("n")), "item_keys")
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    runs = lambda grams: texts.select("doc_id", F.explode(F.array_distinct(grams)).alias("key"))
    found = runs(starting("text")).join(keys.filter(F.col("n").isNull()), "key").select("query_id", "doc_id")
    for n in [r.n for r in keys.select("n").filter(F.col("n").isNotNull()).distinct().collect()]:  # at most width + 1 numbers
        some = runs(hashed(_grams("text", n))) if n else texts.select("doc_id", F.xxhash64(F.lit("")).alias("key"))
        found = found.unionByName(some.join(keys.filter(F.col("n") == n), "key").select("query_id", "doc_id"))
    pairs = settle(found.distinct(), "candidates")
    discard(keys)
    return texts.join(pairs, "doc_id").join(own, "query_id").filter(F.contains("text", F.col("q"))).select("query_id", "doc_id").distinct()


def bm25(queries: DataFrame, docs: DataFrame, top: int = 20, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank): the best documents of many queries at once.

    Only terms that some query holds are kept of a document. Blocks of documents meet blocks of queries as matrices and keep their best, so no row is
    made for a term, document and query. Scores are rounded to 6 places, ties go to the lesser id.
    """
    words = queries.select("query_id", F.explode(F.array_distinct(tokens("text"))).alias("word"))
    codes = settle(words.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "bm25_codes")  # written, so that a word keeps its number
    terms = words.join(codes, "word").select("query_id", "term")
    t = docs.select("doc_id", tokens("text").alias("t")).select("doc_id", F.explode("t").alias("word"), F.size("t").alias("length"))
    # other words go before anything is shuffled; the rows that are left are read for the counts and for the scores
    hit = t.join(codes, "word").groupBy("doc_id").agg(F.first("length").alias("length"), F.collect_list("term").alias("terms"))
    hit = settle(hit, "bm25_terms")
    size = docs.select("doc_id", F.size(tokens("text")).alias("length")).agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    df = hit.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = terms.join(df, "term").crossJoin(F.broadcast(size)).select("query_id", "term", idf.alias("idf"), "mean")
    asked = settle(weighed.groupBy("query_id").agg(F.collect_list("term").alias("terms"), F.collect_list("idf").alias("idf"), F.first("mean").alias("mean")), "bm25_queries")

    def score(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        names, code = np.unique(np.concatenate(q["terms"].to_list()), return_inverse=True)
        weights = np.zeros((len(q), len(names)))
        np.add.at(weights, (np.repeat(np.arange(len(q)), q["terms"].map(len)), code), np.concatenate(q["idf"].to_list()))
        ids, first, own = np.unique(d["vec_id"].to_numpy(), return_index=True, return_inverse=True)
        norm = k1 * (1 - b + b * d["length"].to_numpy()[first] / q["mean"].iloc[0])
        row, held = np.repeat(own, d["terms"].map(len)), np.concatenate(d["terms"].to_list())
        code = np.minimum(np.searchsorted(names, held), len(names) - 1)
        row, code = row[names[code] == held], code[names[code] == held]
        order = np.argsort(row, kind="stable")
        row, code = row[order], code[order]
        scores = np.zeros((len(q), len(ids)))
        step = max(1, 2_000_000 // len(names))  # documents of a matrix
        for at in range(0, len(ids), step):
            n = min(step, len(ids) - at)
            lo, hi = np.searchsorted(row, (at, at + n))
            tf = np.bincount((row[lo:hi] - at) * len(names) + code[lo:hi], minlength=n * len(names)).reshape(n, len(names)).astype(np.float64)
            part = np.divide(tf * (k1 + 1), tf + norm[at : at + n, None], out=np.zeros_like(tf), where=tf > 0)
            scores[:, at : at + n] = weights @ part.T
        return row_best(q["query_id"].to_numpy(), ids, scores, top)

    scored = meet(asked, hit.withColumnRenamed("doc_id", "vec_id"), score, SCORED, (256, 4096))
    return ranked(scored.filter(F.col("score") > 0), top).withColumnRenamed("vec_id", "doc_id")


def dense(queries: DataFrame, vectors: DataFrame, top: int = 20) -> DataFrame:
    """(query_id, vec_id, score, rank) by cosine: a stated query set against all vectors, in blocks."""
    return exact(queries, vectors, top)


def fuse(lists: list[tuple[DataFrame, float]], id_column: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, id, rank) lists with weights."""
    out = None
    for ranked, weight in lists:
        part = ranked.select("query_id", id_column, (weight / (k + F.col("rank"))).alias("part"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("query_id", id_column).agg(F.round(F.sum("part"), 8).alias("score"))


def slot_vectors(texts: DataFrame, key: str, slots: int = 256) -> DataFrame:
    """(key, embedding): counts of the tokens of each text in `slots` slots by their hashes. Texts without tokens are left out."""
    slot = F.conv(F.substring(F.md5("w"), 31, 2), 16, 10).cast("int") % slots
    counts = texts.select(key, F.explode(tokens("text")).alias("w")).groupBy(key, slot.alias("slot")).agg(F.count("*").cast("double").alias("n"))
    by_slot = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m"))  # at most one entry a slot
    return by_slot.select(key, F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0))).alias("embedding"))


def hybrid(queries: DataFrame, docs: DataFrame, age_days: Column, each: int = 20, reranked: int = 12, floor: float = 0.05, top: int = 5, half_life: float = 90.0) -> DataFrame:
    """(query_id, doc_id, score, rank): the best of two searches of queries (query_id, text) over docs (doc_id, text).

    `each` documents by BM25 and as many by the cosine of hashed counts are fused by their ranks; the `reranked` best of them are scored by the words they share with the query, those below
    `floor` go, and a fifth of the score is freshness, which halves in half_life days. Ties go to the lesser doc_id.
    """
    by_words = bm25(queries, docs, each).select("query_id", "doc_id", "rank")
    vectors = slot_vectors(docs, "doc_id").withColumnRenamed("doc_id", "vec_id")
    by_vector = exact(slot_vectors(queries, "query_id"), vectors, each).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    fused = fuse([(by_words, 1.0), (by_vector, 1.0)], "doc_id")
    order = Window.partitionBy("query_id")
    fused = fused.withColumn("at", F.row_number().over(order.orderBy(F.desc("score"), "doc_id"))).filter(F.col("at") <= reranked).select("query_id", "doc_id")
    own = lambda df, key, name: df.select(key, F.array_distinct(tokens("text")).alias(name))
    t = fused.join(own(docs, "doc_id", "t"), "doc_id").join(own(queries, "query_id", "q"), "query_id")
    rerank = 0.6 * F.size(F.array_intersect("q", "t")) / F.size("q") + 0.25 * jaccard(F.col("q"), F.col("t"))
    fresh = F.pow(F.lit(0.5), age_days / half_life)
    scored = t.withColumn("rerank", rerank).filter(F.col("rerank") >= floor).withColumn("score", F.round((1 - 0.2) * F.col("rerank") + 0.2 * fresh, 6))
    at = F.row_number().over(order.orderBy(F.desc("score"), "doc_id")).cast("long")
    return scored.withColumn("rank", at).filter(F.col("rank") <= top).select("query_id", "doc_id", "score", "rank")


def redact(text: Column) -> tuple[Column, Column]:
    """The text with addresses, numbers and keys replaced, and the labels of what was found."""
    kinds = (("EMAIL", EMAIL), ("SSN", SSN), ("AWS_KEY", AWS_KEY))
    labels = F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, p in kinds]))
    for name, pattern in kinds:
        text = F.regexp_replace(text, pattern, f"[{name}]")
    return text, labels


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    value = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(F.filter(value, lambda v: v.isNotNull()), F.lit(0), lambda s, v: s + v) % 10 == 0


def shingles(text: Column, n: int = 5, between: str = r"[^a-z0-9]+") -> Column:
    """Distinct runs of n words; shorter texts have one of all their words."""
    words = F.filter(F.split(F.lower(text), between), lambda x: x != "")
    # the words are bound once as a variable, else every run would split the text anew
    runs = F.transform(F.array(words), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " ")))
    return F.array_distinct(F.element_at(runs, 1))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(n: int) -> Callable:
    """(doc_id, id, s) for texts (doc_id, whole, w): sorted hashes of the distinct runs of n words from hashes of words, and their digest.

    Shorter texts have one run of all their words, a text without words the hash of the whole.
    """

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 100):
                some = batch.slice(first, 100)
                size = pc.list_value_length(some.column("w")).to_numpy().astype(np.int64)
                words = np.append(some.column("w").flatten().to_numpy(zero_copy_only=False).astype(np.int64), 0).view(np.uint64)
                count = np.maximum(size - n + 1, 1)
                own = np.repeat(np.arange(len(size)), count)
                at = np.arange(len(own)) + np.repeat(np.cumsum(size) - size - (np.cumsum(count) - count), count)
                length = np.minimum(size, n)[own]
                key = _mix(length.astype(np.uint64))
                for k in range(n):
                    key = np.where(k < length, _mix(key ^ words[np.minimum(at + k, len(words) - 1)]), key)
                whole = some.column("whole").to_numpy().view(np.uint64)
                key = np.where(length == 0, _mix(whole[own]), key).view(np.int64)
                order = np.lexsort((key, own))
                key, own = key[order], own[order]
                fresh = np.append(True, (key[1:] != key[:-1]) | (own[1:] != own[:-1]))
                key, own = key[fresh], own[fresh]
                ends = np.searchsorted(own, np.arange(len(size) + 1))
                ids = [hashlib.md5(key[a:z].tobytes()).hexdigest() for a, z in zip(ends[:-1], ends[1:], strict=True)]
                sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key, pa.int64()))
                yield pa.record_batch({"doc_id": some.column("doc_id"), "id": pa.array(ids, pa.string()), "s": sets})

    return run


def _signed(hashes: int, rows: int) -> Callable:
    """(id, sig, bands) for sets (id, s): a byte of each minimum hash, and the hashes of the bands."""
    seeds = _mix(np.arange(1, hashes + 1).astype(np.uint64))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                sets = [np.array(x, np.int64).view(np.uint64) for x in some.column("s").to_pylist()]
                starts = np.cumsum([0, *(len(x) for x in sets[:-1])])
                flat = np.concatenate(sets)
                low = np.stack([np.minimum.reduceat(_mix(flat ^ k), starts) for k in seeds], axis=1)
                bands = []
                for b in range(0, hashes - rows + 1, rows):
                    h = np.full(len(sets), b + 1, np.uint64)
                    for r in range(rows):
                        h = _mix(h ^ low[:, b + r])
                    bands.append(h.view(np.int64))
                sig = [x.tobytes() for x in (_mix(low) & np.uint64(255)).astype(np.uint8)]
                yield pa.record_batch({"id": some.column("id"), "sig": pa.array(sig, pa.binary()), "bands": pa.array(np.stack(bands, axis=1).tolist(), pa.list_(pa.int64()))})

    return run


def _stars(alike: Callable[[list], np.ndarray], column: str) -> Callable:
    """For rows (block, id, column) sorted by block: each row of a block with the least row it is joined to."""

    def links(ids: list, values: list) -> list[tuple[str, str]]:
        if len(ids) < 2:
            return []
        x, y = np.nonzero(np.triu(alike(values), 1))
        root = np.arange(len(ids))
        while len(x):
            before = root.copy()
            np.minimum.at(root, x, root[y])
            np.minimum.at(root, y, root[x])
            root = root[root]
            if np.array_equal(root, before):
                break
        return [(ids[k], ids[r]) for k, r in enumerate(root.tolist()) if r != k]

    def run(batches):
        block, ids, values = None, [], []
        for batch in batches:
            out = []
            for b, i, v in zip(*(batch.column(c).to_pylist() for c in ("block", "id", column)), strict=True):
                if b != block:
                    out += links(ids, values)
                    block, ids, values = b, [], []
                ids.append(i)
                values.append(v)
            yield pa.record_batch({"a": pa.array([x for x, _ in out], pa.string()), "b": pa.array([y for _, y in out], pa.string())})
        out = links(ids, values)
        yield pa.record_batch({"a": pa.array([x for x, _ in out], pa.string()), "b": pa.array([y for _, y in out], pa.string())})

    return run


def _rough(least: float) -> Callable:
    """Which signatures agree in about `least` of their hashes: four standard deviations are allowed."""

    def alike(values):
        sig = np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)
        floor = (least - 4 * np.sqrt(least * (1 - least) / sig.shape[1])) * sig.shape[1]
        return np.stack([(sig == x).sum(1) for x in sig]) >= floor

    return alike


def _exact(least: float) -> Callable:
    def alike(values):
        n = len(values)
        size = np.array([len(x) for x in values], np.float64)
        row = np.repeat(np.arange(n), size.astype(np.int64))
        _, code = np.unique(np.concatenate([np.array(x, np.int64) for x in values]), return_inverse=True)
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        common = np.zeros((n, n), np.float32)
        for at in range(0, int(code[-1]) + 1, 2048):
            a, z = np.searchsorted(code, (at, at + 2048))
            part = np.zeros((n, 2048), np.float32)
            part[row[a:z], code[a:z] - at] = 1
            common += part @ part.T
        both = common.astype(np.float64)
        return both >= least * (size[:, None] + size[None, :] - both) - 1e-9

    return alike


def _block_pairs(rows: DataFrame, group: str, blocks: Column) -> DataFrame:
    """rows with a column block: a group's rows are dealt to blocks, and every two blocks meet."""
    cut = rows.withColumn("__n", blocks.cast("int")).withColumn("__own", F.pmod(F.xxhash64("id"), "__n").cast("int"))
    met = cut.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    block = F.xxhash64(group, F.least("__own", "__other"), F.greatest("__own", "__other"))
    return met.withColumn("block", block).repartition("block").sortWithinPartitions("block", "id")


def near_duplicates(docs: DataFrame, least: float = 0.9, hashes: int = 128, rows: int = 4, block: int = 512) -> DataFrame:
    """(doc_id, cluster): clusters of documents whose shingle sets have Jaccard similarity of at least `least`.

    Words are runs of letters and digits of any script; a text without words is its own shingle. A shingle is
    the hash of its words' hashes, so no string is made for one. Texts of equal sets are one node. All members of a band's bucket are compared on their signatures, in pairs of blocks
    where there are many; what seems similar gives coarse classes. All sets of a coarse class are compared exactly in the
    same way, and clusters are the components of those links. No row is made for a pair.
    """
    from vantage.operators.graph import components

    small_batches(docs.sparkSession)
    plain = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(F.lower(plain), r"[^\p{L}\p{M}\p{N}]+"), lambda x: x != "")
    hashed = docs.select("doc_id", F.xxhash64(F.trim(plain)).alias("whole"), F.transform(words, lambda x: F.xxhash64(x)).alias("w"))
    schema = StructType([docs.schema["doc_id"]]).add("id", "string").add("s", ArrayType(LongType()))
    sets = settle(hashed.mapInArrow(_runs(5), schema), "shingle_sets")
    nodes = settle(sets.groupBy("id").agg(F.min("doc_id").alias("first"), F.first("s").alias("s")), "shingle_nodes")
    signed = settle(nodes.select("id", "s").mapInArrow(_signed(hashes, rows), "id string, sig binary, bands array<long>"), "signatures")
    buckets = signed.select("id", F.explode("bands").alias("band"))
    many = buckets.groupBy("band").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    held = buckets.join(many, "band").join(signed.select("id", "sig"), "id")
    near = _block_pairs(held, "band", F.ceil(2 * F.col("n") / block)).select("block", "id", "sig").mapInArrow(_stars(_rough(least), "sig"), "a string, b string")
    coarse = components(near).join(nodes.select("id", "s"), "id")
    sums = coarse.groupBy("root").agg(F.count("*").alias("n"))
    exact = _block_pairs(coarse.join(sums, "root"), "root", F.ceil(2 * F.col("n") / block)).select("block", "id", "s")
    found = components(exact.mapInArrow(_stars(_exact(least), "s"), "a string, b string"))
    named = nodes.select("id", "first").join(found, "id", "left").withColumn("root", F.coalesce("root", "id"))
    heads = named.groupBy("root").agg(F.min("first").alias("cluster"))
    return sets.select("doc_id", "id").join(named.select("id", "root"), "id").join(heads, "root").select("doc_id", "cluster")
