"""Conversation operators against plain loops, on odd conversations and on long ones that several partitions share."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from tests.oracle import connect, differences
from vantage.llm import conversation_repair, conversation_trie, queries
from vantage.llm.running import BASES, PRIME, running

SCHEMA = "conv_id long, turn long, role string, text string, place string, f1 string, part int, rank double, a int, count string"
CLASH = ("p", "f", 3, 0.5, 1, "c")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def odd(seed=1, convs=60):
    """Rows of conversations with few different texts: copies, shared heads, gaps, nulls, repeated rows, and one long conversation."""
    r = random.Random(seed)
    texts = ["", None, "  \n", "one two", "Yes.", "No?", "a\tb  c.", "x" * 3000 + " y."]
    out = []
    for c in range(convs):
        like = random.Random(c % 7)
        n = 300 if c == 20 else like.randint(0, 6)
        for t in range(n):
            out.append((c, None if t == 0 and c % 11 == 3 else t * (2 if c % 13 == 5 else 1), like.choice(["user", "assistant", "system", None]), like.choice(texts)))
        if c % 17 == 4:
            out.append((c, 90, r.choice(["user", "tool", ""]), r.choice(texts)))
    out += [(-5, 0, "user", "Yes."), (7, 6, "user", "Yes."), (7, 6, "user", "Yes."), (10**12, None, None, None)]
    r.shuffle(out)
    return out


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*x, *CLASH) for x in rows], SCHEMA).repartition(parts)


def test_running_over_many_partitions(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot"] * 6 + ["b", "c", "d"]), k, r.randrange(-(10**6), 10**18), r.randrange(PRIME)) for k in range(5000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        df = spark.createDataFrame(rows, "key string, k long, x long, f long")
        found = running(df, "key", ["k"], "n", {"total": "x"}, {"a": "f", "b": "f"})
        assert found.columns == ["key", "k", "x", "f", "n", "total", "a", "a_before", "b", "b_before"]
        got = {(x.key, x.k): x for x in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    state = defaultdict(lambda: (0, 0, 0, 0))
    for key, k, x, f in sorted(rows):
        n, total, a, b = state[key]
        n, total = n + 1, (total + x + 2**63) % 2**64 - 2**63
        state[key] = (n, total, (a + f * pow(BASES[0], n, PRIME)) % PRIME, (b + f * pow(BASES[1], n, PRIME)) % PRIME)
        row = got[key, k]
        assert (row.n, row.total, row.a, row.b) == state[key] and (row.a_before, row.b_before) == (a, b)


def trie_by_loops(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    conv = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        conv[c] = own.get(base, [])[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c, seq in conv.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    below = {k: [m for m in nodes if m[: len(k)] == k] for k in nodes}
    out = []
    for k, members in nodes.items():
        saved = sum((len(nodes[m]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) if m else 0) for m in below[k])
        leaves = sum(len(below[m]) == 1 for m in below[k])
        ends = sorted(c for c in members if len(conv[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), sum(len(m) == len(k) + 1 for m in below[k]), leaves, saved, sha(",".join(map(str, ends)))))
    return out


def keyed(rows):
    return sorted(rows, key=lambda r: (r[0], r[1]))


def without_ties(rows):
    """Rows of which no two of a conversation share a turn but differ."""
    seen = {}
    return [x for x in rows if seen.setdefault((x[0], x[1]), x[2:]) == x[2:]]


def test_trie_is_what_loops_give(spark):
    for seed in (1, 2):
        rows = without_ties(odd(seed))
        found = conversation_trie.rebuilt_trie(frame(spark, rows))
        assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert keyed(map(tuple, found.collect())) == keyed(trie_by_loops(rows))


def test_end_lists_and_parents_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "CHUNK", 2)
    monkeypatch.setattr(conversation_trie, "HEAVY", 5)
    rows = without_ties(odd(3))
    found = conversation_trie.rebuilt_trie(frame(spark, [*rows, (None, 1, "user", "lost")]))
    assert keyed(map(tuple, found.collect())) == keyed(trie_by_loops(rows))


def test_trie_of_nothing_and_turnless(spark):
    assert conversation_trie.rebuilt_trie(frame(spark, [], 1)).collect() == []
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in range(1, 20)}
    c = next(c for c in h if h[c])  # its only turn gives way to a conversation that is absent
    assert [tuple(r) for r in conversation_trie.rebuilt_trie(frame(spark, [(c, 0, "user", "gone")])).collect()] == [(c, 0, None, 1, 0, 1, 0, sha(str(c)))]


def test_trie_query_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert differences(queries.queries()["op13_conversation_trie"](spark, sf), connect(sf), queries.oracle_sql()["op13_conversation_trie"]) == ""


def cheapest(rows):
    """(cost, audit, repaired rows) of role, text and fault rows: all edits tried, the least pair taken."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    fits = {"": "su", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    best = {(len(rows), q): (0, "", ()) for q in ("", "a")}
    inf = (10**9, "", ())
    for i in range(len(rows), -1, -1):
        role, text, fault = rows[i] if i < len(rows) else (None, None, None)
        base = {}
        for q in after:
            options = [best.get((i, q), inf)] if i == len(rows) else []
            if i < len(rows):
                add = lambda c, e, row, to: options.append((c + best[i + 1, to][0], e + best[i + 1, to][1], row + best[i + 1, to][2]))  # noqa: B023, E731
                add(2, "D", (), q)
                more = 5 if fault == "truncated" else 0
                if fault not in ("blank", "duplicate"):
                    if role[:1] and role[0] in fits[q]:
                        add(more, "K", ((role, text),), role[0])
                    add(more + 1, "R", ((name[after[q]], text),), after[q])
            base[q] = min(options, key=lambda x: x[:2])
        for _ in range(4):  # insertions, until nothing changes
            for q, to in after.items():
                c, audit, row = base[to]
                base[q] = min(base[q], (c + 5, "I" + audit, ((name[to], ""), *row)), key=lambda x: x[:2])
        best |= {(i, q): x for q, x in base.items()}
    return best[0, ""]


def repaired_by_loops(rows):
    conv = defaultdict(list)
    for c, turn, role, text in rows:
        conv[c]
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k:
            row = (turn is not None, turn or 0, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            conv[c] += [row] * (2 if k == 3 else 1)
    out = []
    for c, found in conv.items():
        found.sort()
        said, marked, counts = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for _, _, role, text in found:
            last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in said else "truncated" if last[0] not in ".!?" else None
            said.add((role, text))
            marked.append((role, text, fault))
            if fault:
                counts[fault] += 1
        turns = [t for known, t, _, _ in found if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, kept = cheapest(marked)
        out.append((c, gaps, *counts.values(), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in kept))))
    return out


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0]))


def some_conversations(seed):
    r = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No?", "cut", "", " \t", None, "Long. " * 900, "a b", "Fine!"] + [f"text {k}." for k in range(12)]
    rows = without_ties(odd(seed))
    for c in range(100, 260):
        n = 700 if c == 107 else r.randint(0, 9)
        rows += [(c, t, r.choice(roles), r.choice(texts)) for t in range(n)]
    return [*rows, (None, 1, "user", "Here."), (None, None, "assistant", "There.")]


def test_repair_is_the_cheapest_of_all(spark, monkeypatch):
    for seed, block in ((1, 256), (2, 3)):
        monkeypatch.setattr(conversation_repair, "BLOCK", block)
        rows = some_conversations(seed)
        df = frame(spark, rows)
        found = conversation_repair.repair_digest(conversation_repair.damaged(df), df)
        assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert by_id(map(tuple, found.collect())) == by_id(repaired_by_loops(rows))


def test_repaired_rows_follow_the_grammar(spark):
    df = frame(spark, some_conversations(5))
    marked = conversation_repair.with_marks(conversation_repair.damaged(df))
    found = conversation_repair.audits(conversation_repair.signatures(conversation_repair.fault_rows(marked)))
    initials = defaultdict(dict)
    for r in conversation_repair.repaired(marked, found).collect():
        initials[r.cid][r.place] = r.role[0]
    assert len(initials) > 100
    for x in initials.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(x[k] for k in range(len(x))))


def test_repair_of_nothing(spark):
    empty = frame(spark, [], 1)
    assert conversation_repair.repair_digest(conversation_repair.damaged(empty), empty).collect() == []
    gone = next(t for t in range(100) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    df = frame(spark, [(3, gone, "user", "Dropped.")])
    assert [tuple(r) for r in conversation_repair.repair_digest(conversation_repair.damaged(df), df).collect()] == [(3, 0, 0, 0, 0, 0, 0, "", sha(""))]


def test_repair_query_over_whole_conversations(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert by_id(map(tuple, queries.queries()["op11_conversation_repair"](spark, sf).collect())) == by_id(repaired_by_loops(rows))
