"""Structure faults of conversations and their cheapest repair, found once for each signature suffix.

A row's signature letter tells its role (system, user, assistant or another, by the first letter) and whether it is sound, must go
(blank or said before) or is cut off. A repair is a row of edits that turns the roles into `(s?(ua)+)?`: Keep, Rerole, Delete
and Insert. What the rest of a conversation costs depends on its remaining letters and the grammar's state alone, so
signatures share their suffixes as nodes of an acyclic automaton: sorted by their reversed letters, signatures that
end alike follow each other, and each node's cost-to-go and best audit are worked out once for each state, for all conversations.

Signatures are cut into blocks of BLOCK letters, counted from the end, so a conversation of any length is spread over tasks. Behind
a block the four states' costs differ by small numbers only, and blocks with the same letters and the same differences are
solved together. Long conversations pass these differences from block to block by small tables of costs from state to state.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vantage.llm.arrays import slices
from vantage.llm.running import running
from vantage.runtime import discard, settle

BLOCK = 256
HEAVY = 1000
SPACE = " \t\n\x0b\x0c\r"
# fixed values: costs of the edits
RENAME, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
# states: nothing yet, after a system row, after a user row, after an assistant row
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = (USER, USER, ASSISTANT, USER)  # the state that an inserted or renamed row leads to
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLE = {USER: "user", ASSISTANT: "assistant"}
END = (0, 2 * INSERT, INSERT, 0)  # what each state costs where nothing follows
END_AUDIT = ("", "II", "I", "")
# signature letters: role by row, soundness by column
LETTERS = ("sSz", "uUv", "aAb", "oOp")
MEANS = {c: (row[0], k) for row in LETTERS for k, c in enumerate(row)}
LEGAL = {"su", "ua", "au"}
NEVER = 1 << 40


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults put in by crc32(`conv_id:turn`) % 20; nulls are one space."""
    shown = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def with_marks(rows: DataFrame) -> DataFrame:
    """rows as (cid, turn, role, text) with fingerprints f1 and f2 of role and text; cid is conv_id as text, a null one a space."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    lane = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    return rows.select(key().alias("cid"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), lane(1).alias("f1"), lane(17).alias("f2"))


def key() -> Column:
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))


def fault_rows(marked: DataFrame) -> DataFrame:
    """(cid, turn, f1, f2, tie, fault, letter): the first fault of each row that with_marks() gave, and its signature letter.

    A row is blank, or a duplicate of an earlier row of its conversation, or truncated if its last letter ends no sentence.
    """
    said = F.rtrim(F.col("text"), F.lit(SPACE))
    cut = ~F.substring(said, -1, 1).isin(".", "!", "?")
    narrow = marked.select("cid", "turn", "f1", "f2", F.monotonically_increasing_id().alias("tie"), F.substring("role", 1, 1).alias("initial"), (said == "").alias("blank"), cut.alias("cut"))
    again = F.row_number().over(Window.partitionBy("cid", "f1", "f2").orderBy(F.col("turn").asc_nulls_first(), "tie")) > 1
    fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(F.col("cut"), "truncated").otherwise("")
    place = F.when(F.col("fault") == "", 1).when(F.col("fault") == "truncated", 3).otherwise(2)
    letters = F.when(F.col("initial") == "s", LETTERS[0]).when(F.col("initial") == "u", LETTERS[1]).when(F.col("initial") == "a", LETTERS[2]).otherwise(LETTERS[3])
    return settle(narrow, "turn_marks").withColumn("fault", fault).select("cid", "turn", "f1", "f2", "tie", "fault", F.substring(letters, place, F.lit(1)).alias("letter"))


def signatures(faults: DataFrame) -> DataFrame:
    """(cid, block, signature): the letters of each conversation in blocks of at most BLOCK, block 0 at its end."""
    down = [F.col("turn").desc_nulls_last(), F.col("f1").desc(), F.col("f2").desc(), F.col("tie").desc()]
    rows = running(faults.select("cid", "turn", "f1", "f2", "tie", "letter"), "cid", down, "back", name="turns_back")
    placed = rows.select("cid", F.floor((F.col("back") - 1) / BLOCK).alias("block"), "back", "letter")
    listed = placed.groupBy("cid", "block").agg(F.sort_array(F.collect_list(F.struct("back", "letter")), asc=False).alias("rows"))
    out = settle(listed.select("cid", "block", F.array_join(F.col("rows.letter"), "").alias("signature")), "signatures")
    discard(rows)
    return out


def step(letter: str, cost: tuple, audit: tuple, exits: tuple) -> tuple[tuple, tuple, tuple]:
    """The node before another one: for each state the least cost-to-go, the audit and the state behind the block.

    Each edit leads from a state to one other state at most, so among equally cheap edits the least letter begins the least audit.
    """
    role, soundness = MEANS[letter]
    options = []
    for q in range(4):
        found = [(DELETE + cost[q], "D", q)]
        if soundness != 1:
            more = CUT_OFF if soundness == 2 else 0
            if role in KEPT[q]:
                found.append((more + cost[KEPT[q][role]], "K", KEPT[q][role]))
            found.append((more + RENAME + cost[AFTER[q]], "R", AFTER[q]))
        options.append(min(found))
    best = list(options)
    for q in (USER, ASSISTANT, START, SYSTEM):
        to = AFTER[q]
        other = options[to] if q in (USER, ASSISTANT) else best[to]
        best[q] = min(options[q], (INSERT + other[0], "I", to))
    out: list = [None] * 4
    for q in sorted(range(4), key=lambda q: (best[q][1] == "I", q in (START, SYSTEM))):
        c, edit, to = best[q]
        out[q] = (c, "I" + out[to][1], out[to][2]) if edit == "I" else (c, edit + audit[to], exits[to])
    return tuple(zip(*out, strict=True))


def solutions(blocks: DataFrame) -> DataFrame:
    """(signature, follow, audits, exits, costs, illegal) of each different block: for each of the four states the best audit, the state
    behind the block and the cost of the edits; illegal counts neighbours in it. follow: what each state costs behind the block.
    """
    schema = "signature string, follow string, audits array<string>, exits array<int>, costs array<int>, illegal long"

    def solve(batches):
        follow, text, nodes = None, "", []
        for batch in batches:
            out = []
            for now, signature in zip(batch.column("follow").to_pylist(), batch.column("signature").to_pylist(), strict=True):
                if now != follow:
                    follow, text = now, ""
                    nodes = [(tuple(map(int, now.split(","))), ("",) * 4, tuple(range(4)))]
                same, most = 0, min(len(text), len(signature))
                while same < most and text[-1 - same] == signature[-1 - same]:
                    same += 1
                del nodes[same + 1 :]
                for letter in reversed(signature[: len(signature) - same]):
                    nodes.append(step(letter, *nodes[-1]))
                text = signature
                cost, audit, exits = nodes[-1]
                roles = [MEANS[c][0] for c in signature]
                illegal = sum(a + b not in LEGAL for a, b in zip(roles, roles[1:], strict=False))
                out.append((signature, follow, list(audit), list(exits), [cost[q] - nodes[0][0][exits[q]] for q in range(4)], illegal))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(ANSWER.names, x, strict=True)) for x in out], ANSWER)

    tail = F.reverse("signature")
    different = blocks.select("follow", "signature").distinct()
    return different.repartitionByRange("follow", tail).sortWithinPartitions("follow", tail).mapInArrow(solve, schema)


ANSWER = pa.schema([("signature", pa.string()), ("follow", pa.string()), ("audits", pa.list_(pa.string())), ("exits", pa.list_(pa.int32())), ("costs", pa.list_(pa.int32())), ("illegal", pa.int64())])


@lru_cache(10_000)
def crossing(signature: str) -> tuple:
    """Least cost from each state before a block to each state behind it."""
    columns = []
    for end in range(4):
        node = (tuple(0 if q == end else NEVER for q in range(4)), ("",) * 4, (0,) * 4)
        for letter in reversed(signature):
            node = step(letter, *node)
        columns.append(node[0])
    return tuple(zip(*columns, strict=True))


def with_follow(blocks: DataFrame) -> DataFrame:
    """blocks of long conversations with `follow`, the cost of each state behind the block, least 0. Costs across the blocks are found
    apart; what goes through one task in order is a small table a block."""

    def across(batches):
        for batch in batches:
            costs = [[x for row in crossing(s) for x in row] for s in batch.column("signature").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(costs, pa.list_(pa.int64()))], ["cid", "block", "signature", "costs"])

    def passed(batches):
        at, costs = None, END
        for batch in batches:
            follow = []
            for cid, block in zip(batch.column("cid").to_pylist(), batch.column("costs").to_pylist(), strict=True):
                if cid != at:
                    at, costs = cid, END
                follow.append(",".join(map(str, costs)))
                costs = [min(block[4 * q + e] + costs[e] for e in range(4)) for q in range(4)]
                costs = [x - min(costs) for x in costs]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("cid", "block", "signature")), pa.array(follow, pa.string())], ["cid", "block", "signature", "follow"])

    tables = blocks.mapInArrow(across, "cid string, block long, signature string, costs array<long>")
    return tables.repartition("cid").sortWithinPartitions("cid", "block").mapInArrow(passed, "cid string, block long, signature string, follow string")


def chained(solved: DataFrame) -> DataFrame:
    """(cid, audit, cost, illegal) of conversations of several blocks, from the first block (the highest number) on."""

    def walk(batches):
        at, state, parts, cost, illegal, last = None, START, [], 0, 0, ""

        def row():
            return {"cid": at, "audit": "".join(parts) + END_AUDIT[state], "cost": cost + END[state], "illegal": illegal}

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["cid"] != at:
                    if at is not None:
                        out.append(row())
                    at, state, parts, cost, illegal, last = r["cid"], START, [], 0, 0, ""
                parts.append(r["audits"][state])
                cost += r["costs"][state]
                roles = last + MEANS[r["signature"][0]][0]
                illegal += r["illegal"] + (len(roles) == 2 and roles not in LEGAL)
                last = MEANS[r["signature"][-1]][0]
                state = r["exits"][state]
            if out:
                yield pa.RecordBatch.from_pylist(out, AUDIT)
        if at is not None:
            yield pa.RecordBatch.from_pylist([row()], AUDIT)

    return solved.repartition("cid").sortWithinPartitions("cid", F.col("block").desc()).mapInArrow(walk, "cid string, audit string, cost long, illegal long")


AUDIT = pa.schema([("cid", pa.string()), ("audit", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())])


def audits(blocks: DataFrame) -> DataFrame:
    """(cid, audit, cost, illegal): the cheapest edits of each conversation, of equally cheap ones the least in ASCII."""
    long = blocks.filter("block > 0").select("cid").distinct()
    short = blocks.join(long, "cid", "left_anti").withColumn("follow", F.lit(",".join(map(str, END))))
    followed = settle(short.unionByName(with_follow(blocks.join(long, "cid", "left_semi"))), "signatures_followed")
    answers = settle(solutions(followed), "signature_answers")
    names = ["signature", "follow"]
    # signatures that many conversations have are at most HEAVY; they go out to all tasks, the others are shuffled
    counts = followed.groupBy(*names).count()
    often = settle(counts.filter(F.col("count") > max(1, followed.count() // HEAVY)).join(answers, names).drop("count"), "signature_often")
    near = followed.join(F.broadcast(often), names)
    rest = followed.join(F.broadcast(often.select(*names)), names, "left_anti").join(answers, names)
    solved = near.unionByName(rest)
    exit_state = F.col("exits")[START]
    end_audit, end_cost = (F.array(*map(F.lit, x)) for x in (END_AUDIT, END))
    alone = solved.join(long, "cid", "left_anti").select("cid", F.concat(F.col("audits")[START], F.get(end_audit, exit_state)).alias("audit"), (F.col("costs")[START] + F.get(end_cost, exit_state)).cast("long").alias("cost"), "illegal")
    return settle(alone.unionByName(chained(solved.join(long, "cid", "left_semi"))), "audits")


def repaired(marked: DataFrame, found: DataFrame) -> DataFrame:
    """(cid, place, role, text): the rows of each conversation after its audit's edits, from 0 on. Whole conversations pass through their
    task row by row."""
    return _edited(marked, found, "cid string, place long, role string, text string", _rows)


def repaired_digests(marked: DataFrame, found: DataFrame) -> DataFrame:
    """(cid, repaired_sha256) of the repaired rows as `role:text`, joined by newlines."""
    return _edited(marked, found, "cid string, repaired_sha256 string", _digests)


def _edited(marked: DataFrame, found: DataFrame, schema: str, write) -> DataFrame:
    told = found.select("cid", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(0).cast("long").alias("f1"), F.lit(0).cast("long").alias("f2"), F.lit("").alias("role"), F.col("audit").alias("text"))
    rows = told.unionByName(marked.withColumn("kind", F.lit(1)))
    order = ["cid", "kind", F.col("turn").asc_nulls_first(), "f1", "f2"]
    return rows.repartition("cid").sortWithinPartitions(*order).select("cid", "kind", "role", "text").mapInArrow(lambda batches: write(_edits(batches)), schema)


def _edits(batches):
    """(cid, role, text) of each repaired row; (cid, None, None) after the last one of a conversation."""
    at, audit, k, state = None, "", 0, START

    def inserted():
        nonlocal k, state
        while k < len(audit) and audit[k] == "I":
            k, state = k + 1, AFTER[state]
            yield at, ROLE[state], ""

    for batch in slices(batches, "text"):
        for cid, kind, role, text in zip(*(batch.column(x).to_pylist() for x in ("cid", "kind", "role", "text")), strict=True):
            if kind == 0:
                if at is not None:
                    yield from inserted()
                    yield at, None, None
                at, audit, k, state = cid, text, 0, START
                continue
            yield from inserted()
            edit, k = audit[k], k + 1
            if edit == "K":
                state = KEPT[state][role[0]]
                yield at, role, text
            elif edit == "R":
                state = AFTER[state]
                yield at, ROLE[state], text
    if at is not None:
        yield from inserted()
        yield at, None, None


def _rows(edits):
    place, out, size = 0, [], 0
    for cid, role, text in edits:
        if role is None:
            place = 0
            continue
        out.append((cid, place, role, text))
        place, size = place + 1, size + len(text)
        if len(out) >= 1000 or size >= 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["cid", "place", "role", "text"])
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["cid", "place", "role", "text"])


def _digests(edits):
    out, sha, first = [], hashlib.sha256(), True
    for cid, role, text in edits:
        if role is not None:
            sha.update(f"{role}:{text}".encode() if first else f"\n{role}:{text}".encode())
            first = False
            continue
        out.append((cid, sha.hexdigest()))
        sha, first = hashlib.sha256(), True
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["cid", "repaired_sha256"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["cid", "repaired_sha256"])


def repair_digest(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Faults, the cheapest audit and a digest of the repaired rows, one row for each conv_id of convs.

    Cases: rows of a conversation come by turn, null first; rows with one turn in the order of their fingerprints; a repeated row is a duplicate;
    null roles and texts are empty; a null conv_id is a conversation of its own; a role of no letter or another letter must be renamed or
    deleted; texts of any length count whole; a conversation without rows has zeros, an empty audit and the digest of nothing; an empty table
    gives no rows; other columns are ignored.
    """
    marked = with_marks(rows)
    faults = settle(fault_rows(marked), "turn_faults")
    kinds = ["blank", "duplicate", "truncated"]
    counts = faults.groupBy("cid").agg(*(F.count_if(F.col("fault") == x).alias(x) for x in kinds))
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    gaps = faults.select("cid", "turn").distinct().groupBy("cid").agg(F.coalesce(span, F.lit(0)).alias("gaps"))
    found = audits(signatures(faults))
    ids = convs.select("conv_id", key().alias("cid")).distinct()
    out = ids.join(counts, "cid", "left").join(gaps, "cid", "left").join(found, "cid", "left").join(repaired_digests(marked, found), "cid", "left")
    numbers = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", *kinds, "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
