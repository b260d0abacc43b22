"""Grammar inference: probabilistic automata from sample strings by state merging on a prefix tree.

States are merged when the shares with which strings end there, and go on with each symbol, agree within Hoeffding
bounds, and those of their descendants do too. A symbol is a class of characters, which are alike within it. Classes that
share most of their positions in the samples are joined, else random credentials would spread over as many prefixes as
there are samples; a character that nearly all samples have at one position is a symbol of its own there.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np

# classes of characters: digits, the letters of hexadecimal numbers apart, the rest as themselves
_CLASSES = {"digit": "0123456789", "hexlow": "abcdef", "low": "ghijklmnopqrstuvwxyz", "hexup": "ABCDEF", "up": "GHIJKLMNOPQRSTUVWXYZ"}
SYMBOL = {c: name for name, chars in _CLASSES.items() for c in chars} | {c: c for c in "+/_.=-"}
SIZE = {name: len(chars) for name, chars in _CLASSES.items()} | {c: 1 for c in "+/_.=-"}
FEW = 8  # at most so many of the longest texts are walked one by one
FLOOR = 0.05  # weight of what was never seen, spread over all symbols and the end


class Automaton:
    """A stochastic automaton as lists indexed by state: visits, ends and transitions {symbol: [state, count]}."""

    def __init__(self, samples: list[str], join: bool = True, alpha: float = 0.01, least: int = 12):
        self.n, self.ends, self.to = [0], [0], [{}]
        fixed = self._join_classes(samples if join else [])
        for text in samples:
            at = 0
            self.n[0] += 1
            for k, c in enumerate(text):
                s = ("is", c) if fixed.get(k) == c else self.name[c] if c in self.name else "other"
                if s not in self.to[at]:
                    self.to[at][s] = [len(self.n), 0]
                    self.n.append(0)
                    self.ends.append(0)
                    self.to.append({})
                step = self.to[at][s]
                step[1] += 1
                at = step[0]
                self.n[at] += 1
            self.ends[at] += 1
        self.gap, self.least = math.sqrt(0.5 * math.log(2 / alpha)), least
        self._merge()

    def _join_classes(self, samples: list[str]) -> dict[int, str]:
        """Set the class of each character; give the characters that are fixed at a position."""
        at: dict[int, Counter] = {}
        for text in samples:
            for k, c in enumerate(text):
                at.setdefault(k, Counter())[c] += 1
        fixed = {k: c for k, n in at.items() for c, m in n.most_common(1) if m >= 0.95 * len(samples) and m > 1}
        shares: dict[str, dict[int, float]] = {}
        for k, n in at.items():
            if k not in fixed:
                for c, m in n.items():
                    own = shares.setdefault(SYMBOL.get(c, "other"), {})
                    own[k] = own.get(k, 0) + m / n.total()
        joined = {x: x for x in SIZE}
        for x in shares:
            for y in shares:
                both = sum(shares[x].get(k, 0) >= 0.05 and shares[y].get(k, 0) >= 0.05 for k in at)
                if x < y and 2 * both >= len({*shares[x], *shares[y]}) and x in joined and y in joined:
                    old, new = joined[y], joined[x]
                    joined = {z: new if g == old else g for z, g in joined.items()}
        self.name = {c: joined[x] for c, x in SYMBOL.items()}
        self.size = Counter(self.name.values())
        return fixed

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) > self.gap * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _alike(self, a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            p, q = todo.pop()
            n, m = self.n[p], self.n[q]
            if (p, q) in seen or n < self.least or m < self.least:
                continue
            seen.add((p, q))
            if self._differ(self.ends[p], n, self.ends[q], m):
                return False
            for s in {*self.to[p], *self.to[q]}:
                x, y = self.to[p].get(s), self.to[q].get(s)
                if self._differ(x[1] if x else 0, n, y[1] if y else 0, m):
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def _fold(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            self.n[p] += self.n[q]
            self.ends[p] += self.ends[q]
            for s, (state, count) in self.to[q].items():
                if s in self.to[p]:
                    self.to[p][s][1] += count
                    todo.append((self.to[p][s][0], state))
                else:
                    self.to[p][s] = [state, count]

    def _merge(self) -> None:
        red = [0]
        while True:
            known = set(red)
            blue = [(self.n[step[0]], step[0], p, s) for p in red for s, step in self.to[p].items() if step[0] not in known]
            if not blue:
                break
            _, b, p, s = max(blue, key=lambda x: (x[0], -x[1]))
            for r in red:
                if self._alike(r, b):
                    self.to[p][s][0] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)
        self.states = red
        self._tabulate()

    def step(self, at: int, c: str) -> tuple[float, int]:
        """Natural log of the share of a character in a state, and the next state; -1 is the state without any transition."""
        to, kinds = self.to[at] if at >= 0 else {}, len(self.size) + 1
        s = self.name.get(c, "other")
        own, seen = to.get(("is", c)), to.get(s)
        share = FLOOR / kinds / self.size.get(s, 32)
        if seen:
            share += (1 - FLOOR) * seen[1] / self.n[at] / self.size.get(s, 32)
        if own:
            share += (1 - FLOOR) * own[1] / self.n[at]
        return math.log(share), own[0] if own else seen[0] if seen else -1

    def end(self, at: int) -> float:
        """Natural log of the share of strings that end in a state."""
        own = (1 - FLOOR) * self.ends[at] / self.n[at] if at >= 0 and self.n[at] else 0
        return math.log(own + FLOOR / (len(self.size) + 1))

    def _tabulate(self) -> None:
        """step() and end() of all states as arrays; the last column stands for characters that no transition names."""
        chars = sorted({*self.name, *(s[1] for p in self.states for s in self.to[p] if isinstance(s, tuple))})
        place = {p: k for k, p in enumerate([*self.states, -1])}
        steps = [[self.step(p, c) for c in [*chars, ""]] for p in place]
        self.known = np.array([ord(c) for c in chars], np.uint32)
        self.logs = np.array([[x for x, _ in row] for row in steps])
        self.next = np.array([[place[x] for _, x in row] for row in steps])
        self.last = np.array([self.end(p) for p in place])

    def scores(self, texts: list[str]) -> np.ndarray:
        """Natural log of the likelihood of each whole text.

        All texts go on by a character at a time while many are left; the few longest go on one by one.
        """
        length = np.array([len(x) for x in texts], np.int64)
        order = np.argsort(-length, kind="stable")
        length = length[order]
        points = np.frombuffer("".join(texts[k] for k in order.tolist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        column = np.searchsorted(self.known, points)
        column[self.known[np.minimum(column, len(self.known) - 1)] != points] = len(self.known)
        first = np.cumsum(length) - length
        out, state = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        common = int(length[FEW]) if len(texts) > FEW else 0
        for k in range(common):
            live = int(np.searchsorted(-length, -k))
            at, c = state[:live], column[first[:live] + k]
            out[:live] += self.logs[at, c]
            state[:live] = self.next[at, c]
        for j in range(int(np.searchsorted(-length, -common))):
            at, sum_ = int(state[j]), float(out[j])
            for c in column[first[j] + common : first[j] + length[j]].tolist():
                sum_ += self.logs.item(at, c)
                at = self.next.item(at, c)
            state[j], out[j] = at, sum_
        found = np.empty(len(texts))
        found[order] = out + self.last[state]
        return found


class Letters:
    """Strings of letters that are drawn one by one, each by its share in the samples: what a string is likely to be that no
    automaton's prefix tree holds."""

    def __init__(self, samples: list[str]):
        counts = Counter("".join(samples))
        total, kinds = counts.total() + len(samples) + 1, len(counts) + len(SYMBOL) + 1
        self.known = np.array(sorted(map(ord, counts)) or [0], np.uint32)
        share = [counts.get(chr(k), 0) for k in self.known.tolist()] + [0]
        self.logs = np.log((np.array(share) + 0.5) / (total + 0.5 * kinds))
        self.last = math.log((len(samples) + 1) / total)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Natural log of the likelihood of each whole text."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        column = np.minimum(np.searchsorted(self.known, points), len(self.known) - 1)
        sums = np.concatenate([[0.0], np.cumsum(np.where(self.known[column] == points, self.logs[column], self.logs[-1]))])
        ends = np.cumsum([0, *map(len, texts)])
        return sums[ends[1:]] - sums[ends[:-1]] + self.last
