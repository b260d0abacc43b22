"""Prefix trie of conversations by whole-sequence collapse.

1. A turn becomes a fingerprint of its role and text and its number of words; texts are read once and not shuffled. A prefix
   is known by two running polynomials of its turns' fingerprints (122 bits).
2. Identical conversations become one weighted sequence with the list of those that end there. Only the smallest member of
   each goes on. Sequences that are no proper prefix of another, by anti-join, are the leaves.
3. Each sequence gives its prefixes with its weight; summed by prefix they are the nodes. A node belongs to the sequence of
   its smallest member, and what it saves is added along that sequence, so subtree sums need no walk over the trie: a
   subtree holds all nodes of the sequences through its top, less those above the top.

A conversation, a first turn or a group of copies may hold any share of all rows: rows of a conversation are numbered over
range partitions (running.py), copies and common prefixes are counted before the shuffle, and the children of the parents
that have most of them find their parent in a broadcast of at most 1,000 rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.llm.running import running
from vantage.runtime import discard, settle

CHUNK = 4096
HEAVY = 1000


@dataclass
class Trie:
    """nodes: (a, b) is the node's key; conv_id its smallest member. ends: (a, b, first, ids) lists the conversations that end at a
    node in ascending order, at most 4,096 a row; rows of a node follow each other by `first`."""

    nodes: DataFrame
    ends: DataFrame


def turn_marks(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, f1, f2, words, tie) of each turn; rows without a conv_id are left out, null roles and texts are empty."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    lane = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    kept = conversations.filter(F.col("conv_id").isNotNull())
    return kept.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), lane(1).alias("f1"), lane(17).alias("f2"), words.alias("words"), F.monotonically_increasing_id().alias("tie"))


def numbered(marks: DataFrame) -> DataFrame:
    """marks with `rank`, from 1 in each conversation: by turn, null first; turns with one number by fingerprint."""
    return running(settle(marks, "turn_marks"), "conv_id", [F.col("turn").asc_nulls_first(), "f1", "f2", "tie"], "rank", name="turn_ranks")


def shared_heads(ranked: DataFrame, base: Column, taken: Column, most: int) -> DataFrame:
    """Conversations that begin with the first turns of another: (conv_id, part, rank, f1, f2, words).

    base: whose turns come first; taken: how many of them, at most `most`, in place of as many of the conversation's own. Both are expressions of conv_id.
    """
    columns = ["rank", "f1", "f2", "words"]
    own = ranked.filter(F.col("rank") > taken).select("conv_id", F.lit(1).alias("part"), *columns)
    heads = ranked.filter(F.col("rank") <= most).groupBy(F.col("conv_id").alias("base")).agg(F.collect_list(F.struct(*columns)).alias("head"))
    convs = ranked.filter("rank = 1").select("conv_id", base.alias("base"))
    turns = convs.join(heads, "base").select("conv_id", taken.alias("taken"), F.explode("head").alias("t")).filter("t.rank <= taken")
    return turns.select("conv_id", F.lit(0).alias("part"), *(F.col(f"t.{x}").alias(x) for x in columns)).unionByName(own)


def end_lists(last: DataFrame) -> DataFrame:
    """(a, b, depth, first, n, ids) from (conv_id, a, b, depth): ascending conversations of each sequence, at most CHUNK a row."""
    schema = "a long, b long, depth long, first long, n long, ids array<long>"
    most = CHUNK

    def lists(batches):
        for batch in batches:
            a, b, depth, ids = (batch.column(x).to_numpy() for x in ("a", "b", "depth", "conv_id"))
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            begin = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
            at = np.flatnonzero((np.arange(len(a)) - begin) % most == 0)
            n = np.diff(np.append(at, len(a)))
            values = pa.ListArray.from_arrays(pa.array(np.append(at, len(a)), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(b[at]), pa.array(depth[at]), pa.array(ids[at]), pa.array(n), values], ["a", "b", "depth", "first", "n", "ids"])

    return last.select("a", "b", "depth", "conv_id").repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(lists, schema)


def prefix_trie(turns: DataFrame, convs: DataFrame) -> Trie:
    """The trie of conversations. turns: (conv_id, part, rank, f1, f2, words), in the order of part and rank; convs: every conv_id,
    those without turns too.

    nodes: (a, b, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens); saved_tokens adds up, over the
    subtree, words of the last turn for each member but one. Cases: no conversations, no nodes; a conversation without turns is a member of
    the root alone.
    """
    roots = convs.select("conv_id", F.lit(-1).alias("part"), *(F.lit(0).cast("long").alias(x) for x in ("rank", "f1", "f2", "words")))
    placed = running(turns.unionByName(roots), "conv_id", ["part", "rank"], "place", prints={"a": "f1", "b": "f2"}, name="prefixes")
    prefixes = placed.select("conv_id", (F.col("place") - 1).alias("depth"), "a", "b", F.col("a_before").alias("up_a"), F.col("b_before").alias("up_b"), "words")

    last = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("a", "b"), "depth").alias("k"), F.max("depth").alias("depth")).select("conv_id", "k.a", "k.b", "depth")
    ends = settle(end_lists(last), "end_lists")
    sequences = settle(ends.groupBy("a", "b").agg(F.min("first").alias("conv_id"), F.sum("n").alias("weight"), F.min("depth").alias("length")), "sequences")
    paths = settle(prefixes.join(sequences.select("conv_id", "weight", "length"), "conv_id"), "paths")
    discard(placed)
    inner = paths.filter("depth < length").select("a", "b").distinct()
    leaves = sequences.join(inner, ["a", "b"], "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    weighted = paths.join(leaves, "conv_id", "left").groupBy("a", "b")
    sums = [F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("up_a").alias("up_a"), F.min("up_b").alias("up_b"), F.sum("weight").alias("n_convs"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.max("words").alias("words")]
    nodes = settle(weighted.agg(*sums).withColumn("saves", (F.col("n_convs") - 1) * F.col("words")), "trie_nodes")

    along = running(nodes, "conv_id", ["depth"], "nth", sums={"so_far": "saves"}, name="trie_saved")
    totals = nodes.groupBy("conv_id").agg(F.sum("saves").alias("total"))
    through = paths.join(totals, "conv_id").groupBy("a", "b").agg(F.sum("total").alias("through"))
    children = nodes.filter("depth > 0").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    known = along.join(through, ["a", "b"]).join(children, ["a", "b"], "left")
    saved = (F.col("through") - F.col("so_far") + F.col("saves")).alias("saved_tokens")
    known = known.select("a", "b", "conv_id", "depth", "up_a", "up_b", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", saved)
    known = settle(known, "trie_known")
    for x in (along, paths, sequences):
        discard(x)

    share = max(1, known.count() // HEAVY)  # at most HEAVY parents have more children than this
    many = known.filter(F.col("n_children") > share).select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    below = known.filter("depth > 0").join(F.broadcast(many), ["up_a", "up_b"], "left")
    near = below.filter("parent_conv_id IS NOT NULL")
    rest = below.filter("parent_conv_id IS NULL").drop("parent_conv_id").join(parents, ["up_a", "up_b"])
    top = known.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    found = top.unionByName(near).unionByName(rest)
    return Trie(found.select("a", "b", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), ends)


def end_digests(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of the ascending decimal conv_ids, comma-joined. A list is hashed in one task, since a digest has one
    order, but in pieces of bounded size."""

    def digests(batches):
        at, sha = None, None
        for batch in batches:
            keys = list(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True))
            out = []
            for key, ids in zip(keys, batch.column("ids"), strict=True):
                text = ",".join(map(str, ids.as_py()))
                if key == at:
                    sha.update(b"," + text.encode())
                else:
                    if at is not None:
                        out.append((*at, sha.hexdigest()))
                    at, sha = key, hashlib.sha256(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["a", "b", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([sha.hexdigest()])], ["a", "b", "ends_sha256"])

    rows = ends.select("a", "b", "first", "ids").repartition("a", "b").sortWithinPartitions("a", "b", "first")
    return rows.mapInArrow(digests, "a long, b long, ends_sha256 string")


def rebuilt_trie(conversations: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """One row a node of the trie of rebuilt conversations: conversation c begins with the first crc32(c) % most turns of
    conversation c - c % group.

    Cases: a null role or text is empty; null turns come first, turns with one number in the order of their fingerprints; repeated rows
    are turns of their own; rows without a conv_id are left out; texts of any length count whole; an empty table gives no rows; other columns are ignored.
    """
    c = F.col("conv_id")
    ranked = numbered(turn_marks(conversations))
    turns = shared_heads(ranked, c - c % group, F.crc32(c.cast("string").cast("binary")) % most, most - 1)
    trie = prefix_trie(turns, ranked.filter("rank = 1").select("conv_id"))
    out = trie.nodes.join(end_digests(trie.ends), ["a", "b"], "left")
    return out.drop("a", "b").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
