"""Re-Pair grammars over token ids: frequent neighbours become nonterminals until no pair is frequent.

A shard holds documents one after the other. END closes a document and never pairs, so a rule never spans two documents
and each document is a range of symbols. A round counts the neighbouring pairs that can still be frequent, exactly, and
replaces them, the more frequent first where they overlap; a pair that others leave too few places waits for the next
round with its new count. Symbols stay at their positions in a linked list, so a round only looks at positions whose pair
is frequent or has just changed: a pair of older symbols never becomes more frequent.
"""

from __future__ import annotations

import struct

import numpy as np

from vantage.llm.arrays import gather, starts

MAGIC = b"VRP2"
HEAD = "<4sBBIIIQII"
END = 0  # the symbol that closes a document; terminals follow, then rules in the order they were made


def _every_other(linked: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Mask of the pairs that count: in a run of one symbol, every other one. linked: whether a pair's right symbol is
    the next pair's left one."""
    follows = np.zeros(len(key), bool)
    follows[1:] = linked & (key[1:] == key[:-1])
    if not follows.any():
        return ~follows
    place = np.arange(len(key))
    return (place - np.maximum.accumulate(np.where(follows, 0, place))) % 2 == 0


def _winners(rank: np.ndarray, linked: np.ndarray, passes: int = 4) -> np.ndarray:
    """Mask of pairs without overlap: those of less rank than both neighbours, and again among what these leave."""
    last = np.int64(1) << 40
    rank = rank.astype(np.int64)
    won = np.zeros(len(rank), bool)
    for _ in range(passes):
        before, after = np.full(len(rank), last), np.full(len(rank), last)
        before[1:] = np.where(linked, rank[:-1], last)
        after[:-1] = np.where(linked, rank[1:], last)
        win = (rank < last) & (rank < before) & (rank <= after)
        if not win.any():
            break
        won |= win
        rank[win] = last
        rank[1:][win[:-1] & linked] = last
        rank[:-1][win[1:] & linked] = last
    return won


def build(symbols: np.ndarray, first_rule: int, least: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The shortened sequence, the rules as rows (left, right), and how many rules each round made.

    Ends when no pair occurs `least` times without overlap.
    """
    n = len(symbols)
    sym = np.append(symbols.astype(np.int64), END)
    nxt = np.arange(1, n + 2)
    nxt[n] = n
    prv = np.arange(-1, n)
    prv[0] = n
    alive, live = np.ones(n + 1, bool), np.ones(n + 1, bool)
    alive[n] = False
    rules, made, symbol = [], [], first_rule
    while True:
        live[n] = False
        at = np.flatnonzero(live)
        a, b = sym[at], sym[nxt[at]]
        inner = (a != END) & (b != END)
        live[at[~inner]] = False
        at, key = at[inner], (a[inner] << 32) | b[inner]
        if not len(at):
            break
        linked = nxt[at[:-1]] == at[1:]
        counts = _every_other(linked, key)
        order = np.argsort(key)
        ordered = key[order]
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        many = np.add.reduceat(counts[order].astype(np.int64), edge)
        worth = many >= least
        name = np.empty(len(at), np.int64)
        name[order] = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(key))))
        good = worth[name]
        live[at[~good]] = False
        if not worth.any():
            break
        by_count = np.flatnonzero(worth)
        by_count = by_count[np.argsort(-many[by_count], kind="stable")]
        rank = np.empty(len(edge), np.int64)
        rank[by_count] = np.arange(len(by_count))
        good &= counts
        at, pick = at[good], rank[name[good]]
        won = _winners(pick, nxt[at[:-1]] == at[1:])
        taken = np.bincount(pick[won], minlength=len(by_count))
        used = np.flatnonzero(taken >= least)  # never empty: the most frequent pair wins all its places
        number = np.full(len(by_count), -1)
        number[used] = np.arange(len(used))
        won &= number[pick] >= 0
        where, rule = at[won], number[pick[won]]
        pairs = ordered[edge[by_count[used]]]
        rules.append(np.stack([pairs >> 32, pairs & 0xFFFFFFFF], 1))
        made.append(len(used))
        gone = nxt[where]
        sym[where] = symbol + rule
        nxt[where] = nxt[gone]
        prv[nxt[where]] = where
        alive[gone] = live[gone] = False
        live[where] = True
        live[prv[where]] = True
        symbol += len(used)
    return sym[alive], np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), made


class Expansions:
    """What each symbol stands for: END, the terminals, then rules in the order they were made."""

    def __init__(self, terminals: np.ndarray, rules: np.ndarray, made: list[int], end_id: int):
        size = len(terminals) + 1
        data, start, length = [np.append(np.uint32(end_id), terminals).astype(np.uint32)], np.arange(size), np.ones(size, np.int64)
        whole, at = data[0], 0
        for n in made:
            ids, each = gather(whole, start, length, rules[at : at + n].astype(np.int64).ravel())
            own = each.reshape(-1, 2).sum(1)
            start = np.concatenate([start, len(whole) + starts(own)[:-1]])
            length = np.concatenate([length, own])
            whole = np.concatenate([whole, ids])
            at += n
        self.data, self.start, self.length = whole, start, length

    def of(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of symbols in a row, and how many each gives."""
        return gather(self.data, self.start, self.length, symbols.astype(np.int64))


def _code(x: np.ndarray, width: int) -> bytes:
    """Numbers of 2 or 4 bytes, or of 3: the low two of all, then the high one of all."""
    if width == 3:
        return (x & 0xFFFF).astype("<u2").tobytes() + (x >> 16).astype("u1").tobytes()
    return x.astype(f"<u{width}").tobytes()


def write(doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray, end_id: int, least: int = 5) -> bytes:
    """One shard's bytes: header, document ids, symbols of each document, terminals, rules, rule lengths, sequence.

    counts: ids of each document, the end id included as the last. A rule costs two symbols and a length, so a pair pays
    from its fifth place on.
    """
    last = np.zeros(len(ids), bool)
    last[starts(counts)[1:] - 1] = True
    seen = np.zeros(int(ids.max()) + 1, bool)
    seen[ids[~last]] = True
    terminals = np.flatnonzero(seen)
    dense = np.cumsum(seen)
    out, rules, made = build(np.where(last, END, dense[ids]), len(terminals) + 1, least)
    per_doc = np.diff(np.concatenate([[-1], np.flatnonzero(out == END)]))
    size = len(terminals) + 1 + len(rules)
    width = 2 if size <= 1 << 16 else 3 if size <= 1 << 24 else 4
    lengths = Expansions(terminals, rules, made, end_id).length[len(terminals) + 1 :]
    wide = 2 if not len(lengths) or lengths.max() < 1 << 16 else 4
    null = np.array([x is None for x in doc_ids])
    names = np.array([0 if x is None else x for x in doc_ids], "<i8")
    head = struct.pack(HEAD, MAGIC, width, wide, end_id, len(counts), len(made), len(out), len(rules), len(terminals))
    parts = [np.array(made, "<u4"), np.packbits(null), names, per_doc.astype("<u4"), terminals.astype("<u4")]
    return b"".join([head, *(x.tobytes() for x in parts), _code(rules.ravel(), width), _code(lengths, wide), _code(out, width)])


class Shard:
    """A shard read back; documents decode together or one at a time."""

    def __init__(self, raw: bytes):
        magic, width, wide, end_id, docs, rounds, symbols, rules, terminals = struct.unpack_from(HEAD, raw)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize(HEAD)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(raw, kind, n, at)
            at += x.nbytes
            return x

        def decode(width: int, n: int) -> np.ndarray:
            low = take("<u2" if width == 3 else f"<u{width}", n)
            return low.astype(np.int64) + (take("u1", n).astype(np.int64) << 16) if width == 3 else low

        made = take("<u4", rounds).tolist()
        self.null = np.unpackbits(take("u1", -(-docs // 8)), count=docs).astype(bool)
        self.doc_ids = take("<i8", docs)
        self.symbols_of = take("<u4", docs).astype(np.int64)
        known = take("<u4", terminals)
        pairs = decode(width, 2 * rules).reshape(-1, 2)
        lengths = decode(wide, rules)
        self.sequence = decode(width, symbols)
        self.expansions = Expansions(known, pairs, made, end_id)
        if not np.array_equal(self.expansions.length[terminals + 1 :], lengths):
            raise ValueError("rule lengths don't agree with the rules")

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each document has."""
        ids, n = self.expansions.of(self.sequence)
        return ids, np.diff(starts(n)[starts(self.symbols_of)])

    def document(self, k: int, skip: int = 0, most: int | None = None) -> np.ndarray:
        """Ids skip..skip+most of the k-th document; only the symbols that hold them are expanded."""
        a = int(self.symbols_of[:k].sum())
        some = self.sequence[a : a + int(self.symbols_of[k])].astype(np.int64)
        at = starts(self.expansions.length[some])
        most = int(at[-1]) - skip if most is None else most
        i, j = int(np.searchsorted(at, skip, side="right")) - 1, int(np.searchsorted(at, skip + most, side="left"))
        ids, _ = self.expansions.of(some[max(i, 0) : j])
        return ids[skip - int(at[max(i, 0)]) :][:most]
