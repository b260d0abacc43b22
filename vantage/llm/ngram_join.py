"""Self-join of texts whose sets of five-word shingles have Jaccard similarity 0.8 or more, by chosen paths.

1. Texts with equal shingle sets are one node from here on, however many copies there are.
2. Chosen paths. A set is embedded as 128 minimum hashes, its tokens. In each run, a set goes down from the root into one
   bucket for each token whose hash with the path falls below 1 / (0.8 * 128), on average 1.25 of them. Buckets of at
   most `brute` sets are compared pair by pair on the tokens; larger ones split again on further tokens, and what is
   still larger after `depth` levels is compared in pairs of blocks. Runs repeat until the target recall at the deepest
   level that splits; sets that no run took below the second level need no more runs than that level does. Sets that
   seem similar in a bucket are joined to one of them, not to all, which gives coarse classes.
3. Each coarse class is verified on the whole shingle sets, in pairs of blocks of bounded size. A block pair yields, for
   each set, its number of links and one edge, never the pairs. Edges give the classes, sums the numbers of links.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage.llm.arrays import U64, mix, slices, starts, texts
from vantage.llm.words import word_hashes
from vantage.operators.graph import components
from vantage.runtime import discard, settle, unused

WORDS = 5
TOKENS = 128
ROUGH = 0.68  # least share of equal tokens; 3.4 standard deviations below 0.8
_ODD = mix(np.arange(1, TOKENS + 1).astype(U64)).astype(np.uint32) | np.uint32(1)
_PLUS = mix(np.arange(1001, TOKENS + 1001).astype(U64)).astype(np.uint32)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The size of each text's set and the sorted hashes of all sets in a row. A text of 1 to 4 words has one shingle."""
    counts, words = word_hashes(column)
    at = starts(counts)
    n = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(n)), n)
    first = at[row] + np.arange(len(row)) - starts(n)[row]
    last = at[row + 1]
    h = np.zeros(len(row), U64)
    for k in range(WORDS):
        here = first + k
        inside = here < last
        h = np.where(inside, mix(h * U64(0x9E3779B97F4A7C15) + words[np.minimum(here, len(words) - 1)] + U64(k)), h) if len(words) else h
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return np.bincount(row[new], minlength=len(n)), h[new]


def _set_ids(sizes: np.ndarray, hashes: np.ndarray) -> list[bytes]:
    at = starts(sizes)
    return [xxhash.xxh3_128_digest(hashes[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def signatures(sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Minimum hashes of 32 bits, one row a set; an empty set has zeros."""
    out = np.zeros((len(sizes), TOKENS), np.uint32)
    full = np.flatnonzero(sizes)
    if len(full):
        at = starts(sizes)[:-1][full]
        low = (hashes >> U64(32)).astype(np.uint32)
        for j in range(TOKENS):
            out[full, j] = np.minimum.reduceat(low * _ODD[j] + _PLUS[j], at)
    return out


def _children(path: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) for every token chosen on a path."""
    token = mix(tokens.astype(U64) * U64(TOKENS) + np.arange(TOKENS, dtype=U64) + U64(1))
    h = mix(path[:, None] ^ token)
    row, j = np.nonzero(h < U64(int(2**64 / (threshold * TOKENS))))
    return row, mix(h[row, j] + U64(0x5851F42D4C957F2D))


def members(docs: DataFrame, threshold: float, runs: int) -> DataFrame:
    """(doc_id, text_hash, id, n, paths, tokens): each text's set by its 128-bit hash, the set's size, its buckets below the
    root of every run, and its minimum hashes, cut to a byte each.

    Buckets below the root are chosen on the whole minimum hashes; further down, a byte tells a bucket's sets apart.
    """

    def run(batches):
        roots = mix(np.arange(1, runs + 1).astype(U64))
        for batch in slices(batches, "text", 2 << 20):
            sizes, hashes = shingle_sets(texts(batch))
            tokens = signatures(sizes, hashes)
            row, path = (np.concatenate(x) for x in zip(*[_children(np.full(len(tokens), r), tokens, threshold) for r in roots], strict=True))
            order = np.argsort(row, kind="stable")
            at = starts(np.bincount(row, minlength=len(tokens)) * 8)
            paths = pa.Array.from_buffers(pa.large_binary(), len(tokens), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(path[order].tobytes())])
            small = (mix(tokens) >> U64(56)).astype(np.uint8)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "id": pa.array(_set_ids(sizes, hashes), pa.binary()), "n": pa.array(sizes, pa.int32()), "paths": paths.cast(pa.binary()), "tokens": pa.array([x.tobytes() for x in small], pa.binary())})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return own.mapInArrow(run, "doc_id long, text_hash long, id binary, n int, paths binary, tokens binary")


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, TOKENS)


def _first(batches):
    """A row for each bucket below the root."""
    for batch in batches:
        raw = batch.column("paths").to_pylist()
        row = np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw])
        yield pa.record_batch({"path": pa.array(np.frombuffer(b"".join(raw), np.int64)), "id": batch.column("id").take(pa.array(row))})


def _further(threshold: float) -> Callable:
    """A row for each bucket below the column path."""

    def split(batches):
        for batch in slices(batches, "tokens", 1 << 20):
            row, child = _children(batch.column("path").to_numpy().view(U64), _tokens(batch.column("tokens")), threshold)
            yield pa.record_batch({"path": pa.array(child.view(np.int64)), "id": batch.column("id").take(pa.array(row))})

    return split


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches, whole; a table holds one or more of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(key)
        values = column.to_numpy(zero_copy_only=False)
        last = int(np.flatnonzero(values != values[-1])[-1]) + 1 if (values != values[-1]).any() else 0
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        elif held and held[-1].column(key)[-1] != column[0]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _edges_of(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """For each of n points, the least point it is joined with through the pairs (x, y)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, x, root[y])
        np.minimum.at(root, y, root[x])
        root = root[root]
        if np.array_equal(root, before):
            return root


def _rough(batches):
    """Stars over the sets of each bucket that seem similar."""
    for table in _groups(batches, "path"):
        table = table.combine_chunks()
        path = table.column("path").to_numpy()
        tokens, ids = _tokens(table.column("tokens")), table.column("id").combine_chunks()
        edge = np.append(np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]])), len(path))
        x, y = [], []
        size = np.diff(edge)
        for step in range(1, int(size.max())):  # pairs at this distance in their bucket, for all buckets at once
            a = np.concatenate([np.arange(s, e - step) for s, e in zip(edge[:-1][size > step], edge[1:][size > step], strict=True)])
            for at in range(0, len(a), 50_000):
                some = a[at : at + 50_000]
                good = some[(tokens[some] == tokens[some + step]).sum(1) >= ROUGH * TOKENS]
                x.append(good)
                y.append(good + step)
        if x:
            root = _edges_of(np.concatenate(x), np.concatenate(y), len(path))
            far = np.flatnonzero(root != np.arange(len(path)))
            yield pa.record_batch({"a": ids.take(pa.array(far)), "b": ids.take(pa.array(root[far]))})


def runs_for(recall: float, levels: int = 2) -> int:
    """Runs that find this share of the pairs at the threshold, which have one common child a level on average."""
    miss = 0.0
    for _ in range(max(2, levels)):
        miss = math.exp(miss - 1)
    return math.ceil(math.log(1 - recall) / math.log(miss))


def _roots(threshold: float, first: int, last: int) -> Callable:
    """A row for each bucket below the roots of the runs from first to last - 1."""

    def split(batches):
        roots = mix(np.arange(first + 1, last + 1).astype(U64))
        for batch in slices(batches, "tokens", 1 << 20):
            tokens = _tokens(batch.column("tokens"))
            for r in roots:
                row, child = _children(np.full(len(tokens), r), tokens, threshold)
                yield pa.record_batch({"path": pa.array(child.view(np.int64)), "id": batch.column("id").take(pa.array(row))})

    return split


def _coarse_classes(sets: DataFrame, threshold: float, recall: float) -> DataFrame:
    made: list[DataFrame] = []
    found = components(coarse_edges(sets, threshold, recall=recall, made=made))
    for table in made:
        discard(table)
    return found


def _buckets(paths: DataFrame, tokens: DataFrame, threshold: float, brute: int, depth: int, made: list[DataFrame]) -> tuple[list[DataFrame], list[DataFrame], int]:
    """Buckets (path, id) to compare, the sets (id) that went below the second level, and the levels that were made."""
    buckets: list[DataFrame] = []
    deep: list[DataFrame] = []
    for level in range(depth):
        many = paths.groupBy("path").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
        live = settle(paths.join(many, "path"), "buckets")
        made.append(live)
        buckets.append(live.filter(F.col("n") <= brute).select("path", "id"))
        large = live.filter(F.col("n") > brute)
        if large.isEmpty():
            break
        if level + 1 < depth:
            if level:
                deep.append(large.select("id"))
            paths = large.select("path", "id").join(tokens, "id").mapInArrow(_further(threshold), "path long, id binary").distinct()
        else:  # pairs of blocks, so that a pair of sets still meets
            blocks = F.ceil(2 * F.col("n") / brute).cast("int")
            own = F.pmod(F.xxhash64("id"), blocks).cast("int")
            cut = large.select("path", "id", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
            buckets.append(cut.select(F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other")).alias("path"), "id").distinct())
    return buckets, deep, level + 1


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def coarse_edges(sets: DataFrame, threshold: float = 0.8, brute: int = 2048, depth: int = 10, recall: float = 0.998, made: list[DataFrame] | None = None) -> DataFrame:
    """(a, b): candidate links between different sets (id, paths, tokens), as stars over the similar sets of a bucket.

    The paths are those of runs_for(recall) runs. Where a run goes below the second level, its pairs are missed more
    often, so the sets there take more runs, until there are enough for the deepest level made. The tables that the result
    reads are added to `made`.
    """
    made = [] if made is None else made
    tokens = sets.select("id", "tokens")
    buckets, deep, levels = _buckets(sets.select("id", "paths").mapInArrow(_first, "path long, id binary"), tokens, threshold, brute, depth, made)
    done, need = runs_for(recall), runs_for(recall, levels)
    again = settle(tokens.join(_union(deep).distinct(), "id", "left_semi"), "deep_sets") if deep else None
    made += [again] if deep else []
    while deep and done < need:
        more, _, levels = _buckets(again.mapInArrow(_roots(threshold, done, need), "path long, id binary"), again, threshold, brute, depth, made)
        buckets += more
        done, need = need, max(need, runs_for(recall, levels))
    held = _union(buckets).join(tokens, "id").select("path", "id", "tokens")
    return held.repartition("path").sortWithinPartitions("path", "id").mapInArrow(_rough, "a binary, b binary")


def _exact(threshold: float) -> Callable:
    """Links within each block pair: one row a set, with its number of links and the set it is joined to."""

    def pairs(sets: list[np.ndarray], side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(sets)
        size = np.array([len(s) for s in sets], np.float64)
        if n <= 6:
            x, y = np.triu_indices(n, 1)
            fits = np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y])
            fits &= (side[x] != side[y]) | (side[x] == 2)
            x, y = x[fits], y[fits]
            both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(x, y, strict=True)], np.float64)
        else:
            row = np.repeat(np.arange(n), size.astype(np.int64))
            _, code, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            shared = many > 1
            name = np.cumsum(shared) - 1
            on = shared[code]
            row, code = row[on], name[code[on]]
            order = np.argsort(code, kind="stable")
            row, code = row[order], code[order]
            total = int(shared.sum())
            common = np.zeros((n, n), np.float32)
            for at in range(0, total, 2048):
                a, z = np.searchsorted(code, (at, at + 2048))
                part = np.zeros((n, min(2048, total - at)), np.float32)
                part[row[a:z], code[a:z] - at] = 1
                common += part @ part.T
            x, y = np.triu_indices(n, 1)
            apart = (side[x] != side[y]) | (side[x] == 2)
            x, y = x[apart], y[apart]
            both = common[x, y].astype(np.float64)
        linked = both >= threshold * (size[x] + size[y] - both) - 1e-9
        return x[linked], y[linked]

    def run(batches):
        for table in _groups(_once(batches), "block"):
            table = table.combine_chunks()
            block = table.column("block").to_numpy()
            ids, sides = table.column("id").combine_chunks(), table.column("side").to_numpy()
            raw = table.column("hashes").to_pylist()
            edge = np.append(np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])), len(block))
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                x, y = pairs([np.frombuffer(r, U64) for r in raw[s:e]], sides[s:e])
                links = np.bincount(np.concatenate([x, y]), minlength=e - s)
                root = _edges_of(x, y, e - s)
                on = np.flatnonzero(links)
                yield pa.record_batch({"a": ids.take(pa.array(s + on)), "links": pa.array(links[on], pa.int64()), "b": ids.take(pa.array(s + root[on]))})

    return run


def join_texts(docs: DataFrame, threshold: float = 0.8, recall: float = 0.998, block_shingles: int = 300_000, block_sets: int = 2048) -> DataFrame:
    """One row for each document: (doc_id, class_id, n_links, n_copies).

    class_id: the least doc_id of the class, which holds all copies of a text and all texts joined by links, directly or
    through others. n_links: how many different shingle sets have similarity of at least `threshold` with the text's.
    n_copies: rows with the same shingle set, the row itself included.

    Cases: texts without words (null, empty or only marks) are copies of each other; texts of 1 to 4 words have one
    shingle of all words; case and marks don't matter; repeated rows count as copies; a null doc_id gets its class's id,
    null if all are null; different texts may share a doc_id, or have none; texts that tie are all linked; texts of any length
    are taken whole; an empty table gives no rows; columns other than doc_id and text are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = settle(members(own, threshold, runs_for(recall)), "members")
    # a set's text is found again by the least doc_id and the text's hash, so neither null ids nor shared ones are a hot key
    text_hash = F.coalesce(F.min_by("text_hash", "doc_id"), F.first("text_hash")).alias("text_hash")
    sets = settle(rows.groupBy("id").agg(F.min("doc_id").alias("first"), text_hash, F.first("n").alias("n"), F.first("paths").alias("paths"), F.first("tokens").alias("tokens"), F.count("*").alias("copies")), "sets")
    coarse = _coarse_classes(sets.filter(F.col("n") > 0), threshold, recall)
    nodes = coarse.join(sets.select("id", "first", "text_hash", "n"), "id")
    # a class's sets are dealt to blocks of about block_shingles and at most about block_sets; each set goes to the pairs of its block with every block
    sums = nodes.groupBy("root").agg(F.ceil(F.greatest(F.sum("n") / block_shingles, F.count("*") / block_sets)).cast("int").alias("blocks"))
    nodes = nodes.join(sums, "root").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def hashes(batches):
        for batch in slices(batches, "text", 2 << 20):
            sizes, flat = shingle_sets(texts(batch))
            at = starts(sizes).tolist()
            found = pa.array(_set_ids(sizes, flat), pa.binary())
            out = pa.array([flat[a:z].tobytes() for a, z in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.record_batch([found, out, *(batch.column(x) for x in ("id", "root", "blocks", "own"))], names=["found", "hashes", "id", "root", "blocks", "own"])

    wanted = nodes.select("first", F.col("text_hash").alias("its_hash"), "id", "root", "blocks", "own")
    hashed = own.withColumn("text_hash", F.xxhash64("text"))
    picked = hashed.join(wanted, F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("text_hash") == F.col("its_hash")))
    whole = picked.mapInArrow(hashes, "found binary, hashes binary, id binary, root binary, blocks int, own int").filter(F.col("found") == F.col("id")).drop("found")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = whole.select("id", "root", "own", "hashes", other)
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(low == high, 2).when(F.col("own") == low, 0).otherwise(1).cast("int")
    dealt = dealt.select(F.xxhash64("root", low, high).alias("block"), "id", side.alias("side"), "hashes")
    ordered = dealt.repartition("block").sortWithinPartitions("block", "id")
    links = settle(ordered.mapInArrow(_exact(threshold), "a binary, links long, b binary"), "links")
    classes = components(links)
    counts = links.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("n_links"))
    node = sets.select("id", "first", "copies").join(classes, "id", "left").join(counts, "id", "left").withColumn("root", F.coalesce("root", "id"))
    heads = node.groupBy("root").agg(F.min("first").alias("class_id"))
    node = node.join(heads, "root").select("id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("copies").alias("n_copies"))
    return rows.select("doc_id", "id").join(node, "id").select("doc_id", "class_id", "n_links", "n_copies")


def _once(batches):
    """Each set once in a block: documents may repeat their doc_id. Rows come sorted by block and id."""
    last = None
    for batch in batches:
        keys = list(zip(batch.column("block").to_pylist(), batch.column("id").to_pylist(), strict=True))
        keep = [k for k, x in enumerate(keys) if x != (keys[k - 1] if k else last)]
        last = keys[-1] if keys else last
        yield batch.take(pa.array(keep, pa.int64()))


def keep_one(docs: DataFrame, threshold: float = 0.8, recall: float = 0.998) -> DataFrame:
    """docs with one document of each class of join_texts(): that of the least doc_id, once. Null doc_ids are kept."""
    found = join_texts(docs, threshold, recall)
    keep = found.filter(F.col("class_id") == F.col("doc_id")).select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi")
    name = unused(docs, "hash")
    once = kept.withColumn(name, F.xxhash64("text")).dropDuplicates(["doc_id", name])  # pre-aggregated, so a repeated row is no hot key
    return once.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()).select(*docs.columns))
