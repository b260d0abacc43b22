"""Keyed streaming operators with a state of their own.

Each state is a few numbers (or at most `depth` waiting rows) a key, and goes after `ttl` of event time without a row of its key. A key's rows of one micro-batch are sorted in its
task, in pieces where they are many (ordered.py).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from vantage.streaming.ordered import in_order

# fixed values: state after each kind of event, by state; what is absent is illegal
LIFECYCLE = {
    "new": {"signup": "active", "view": "new"},
    "active": {"view": "active", "click": "engaged", "error": "failed"},
    "engaged": {"view": "engaged", "click": "engaged", "purchase": "customer", "error": "failed"},
    "customer": {"view": "customer", "click": "customer", "purchase": "customer", "error": "failed"},
    "failed": {"signup": "active"},
}


def _stateful(events: DataFrame, key: str, step, output: str, state: str, ttl: str | None = None, clock: str = "ts") -> DataFrame:
    """A state a key. With `ttl`, the state goes once the latest time of all rows is `ttl` past the key's own latest, and rows so late are left out."""
    if ttl is None:
        return events.groupBy(key).applyInPandasWithState(step, output, state, "append", GroupStateTimeout.NoTimeout)

    def kept(group, frames, handle):
        if handle.hasTimedOut:
            handle.remove()
            return
        newest = 0

        def timed():
            nonlocal newest
            for f in frames:
                newest = max(newest, int(f["__ms"].max()) if f["__ms"].notna().any() else 0)
                yield f

        yield from step(group, timed(), handle)
        if handle.exists:
            handle.setTimeoutTimestamp(max(newest, handle.getCurrentWatermarkMs()) + 1)

    marked = events.withColumn("__ms", F.unix_millis(clock)).withWatermark(clock, ttl)
    return marked.groupBy(key).applyInPandasWithState(kept, output, state, "append", GroupStateTimeout.EventTimeTimeout)


def lifecycle(events: DataFrame, moves: dict[str, dict[str, str]] = LIFECYCLE, start: str = "new", ttl: str | None = None) -> DataFrame:
    """(user_id, event_id, state, legal): an illegal event leaves the state alone and is marked, for a side output.

    Rows without a user share one key; a null event type is illegal in every state.
    """

    def step(key, frames, state):
        at = state.get[0] if state.exists else start
        for rows in in_order(frames, ["ts", "event_id"]):
            states, legal = [], []
            for kind in rows["event_type"]:
                to = moves.get(at, {}).get(kind)
                at = to or at
                states.append(at)
                legal.append(to is not None)
            yield pd.DataFrame({"user_id": rows["user_id"], "event_id": rows["event_id"], "state": states, "legal": legal})
        state.update((at,))

    return _stateful(events, "user_id", step, "user_id long, event_id long, state string, legal boolean", "at string", ttl)


def every_nth(events: DataFrame, n: int = 10, ttl: str | None = None) -> DataFrame:
    """(user_id, event_id, seen, total): one global window a key that shows its count and sum at every n-th row."""

    def step(key, frames, state):
        seen, total = state.get if state.exists else (0, 0)
        for rows in in_order(frames, ["ts", "event_id"]):
            rows = rows.reset_index(drop=True)
            counts = seen + pd.Series(range(1, len(rows) + 1), index=rows.index)
            sums = total + rows["cents"].fillna(0).astype("int64").cumsum()
            seen, total = int(counts.iloc[-1]), int(sums.iloc[-1])
            on = counts % n == 0
            yield pd.DataFrame({"user_id": rows["user_id"][on], "event_id": rows["event_id"][on], "seen": counts[on], "total": sums[on]})
        state.update((seen, total))

    return _stateful(events, "user_id", step, "user_id long, event_id long, seen long, total long", "seen long, total long", ttl)


def reorder(points: DataFrame, depth: int = 8, ttl: str | None = None) -> DataFrame:
    """(source, seq, gap): rows in order of seq, each once; gap is how many numbers were given up just before a row.

    points holds (source, seq, arrived). Rows wait for a missing predecessor until `depth` of them wait; then the missing
    numbers are given up. Numbers that were passed already are duplicates and are left out. The buffer starts when `depth`
    rows wait or the first number, 0, is there.
    """

    def step(key, frames, state):
        next_seq, waiting = (state.get[0], set(state.get[1])) if state.exists else (0, set())
        for rows in in_order((f[["arrived", "seq"]] for f in frames), ["arrived", "seq"]):
            out = []
            for seq in rows["seq"].tolist():
                if seq >= next_seq:
                    waiting.add(seq)
                gap = 0
                if len(waiting) >= depth and next_seq not in waiting:
                    least = min(waiting)
                    gap, next_seq = least - next_seq, least
                while next_seq in waiting:
                    waiting.remove(next_seq)
                    out.append((key[0], next_seq, gap))
                    gap, next_seq = 0, next_seq + 1
            yield pd.DataFrame(out, columns=["source", "seq", "gap"])
        state.update((next_seq, sorted(waiting)))

    return _stateful(points, "source", step, "source long, seq long, gap long", "next_seq long, waiting array<long>", ttl)


def changes_applied(changes: DataFrame, ttl: str | None = None) -> DataFrame:
    """(key, lsn, cents, deleted): the newest change of a key, once for each micro-batch that brings a newer one.

    changes holds (key, lsn, cents, deleted); those without an lsn are left out. The state is the highest log number seen, deletes included, so a change that
    comes again or late, and a snapshot row (lsn -1) after any change, does nothing.
    """

    def step(key, frames, state):
        seen = state.get[0] if state.exists else -2
        last = pd.concat([f.nlargest(1, "lsn") for f in frames]).nlargest(1, "lsn")
        if int(last["lsn"].iloc[0]) > seen:
            state.update((int(last["lsn"].iloc[0]),))
            yield last[["key", "lsn", "cents", "deleted"]]

    return _stateful(changes.filter("lsn IS NOT NULL"), "key", step, "key long, lsn long, cents long, deleted boolean", "lsn long", ttl)


def complete_transactions(rows: DataFrame, wait: str = "1 hour", buckets: int = 1024) -> DataFrame:
    """(tx, n): each transaction when as many different rows as its `expected` have come; what the watermark passes without
    them is given up, and it leaves the state.

    rows holds (tx, row_id, expected, ts); a row that comes again counts once, rows with a null among them are left out. A state holds the open
    transactions of a bucket, so that Python is called once a bucket and micro-batch; a complete one keeps one row until the watermark passes it.
    """
    names = ["tx", "row_id", "ms", "done"]

    def step(key, frames, state):
        clock = state.getCurrentWatermarkMs()
        held = pd.DataFrame(dict(zip(names, state.get, strict=True)) if state.exists else {c: [] for c in names}).astype({"tx": "int64", "row_id": "int64", "ms": "int64", "done": bool})
        new = [] if state.hasTimedOut else [f[["tx", "row_id", "ms", "expected"]].assign(done=False) for f in frames]
        pool = pd.concat([held.assign(expected=-1), *new])
        by_tx = pool.groupby("tx")
        newest, done, expected = by_tx["ms"].max(), by_tx["done"].max(), by_tx["expected"].max()
        n = pool.drop_duplicates(["tx", "row_id"]).groupby("tx").size()
        full = ~done & (expected >= 0) & (n >= expected)
        if full.any():
            yield pd.DataFrame({"tx": full.index[full], "n": n[full].to_numpy()})
        kept = pool.drop_duplicates(["tx", "row_id"])
        kept = kept.assign(ms=kept["tx"].map(newest), done=kept["tx"].map(done | full))
        kept = kept[(kept["ms"] >= clock) & ~(kept["done"] & kept.duplicated("tx"))]
        if len(kept):
            state.update(tuple(kept[c].tolist() for c in names))
            state.setTimeoutTimestamp(max(int(kept["ms"].min()), clock) + 1)
        elif state.exists:
            state.remove()

    known = rows.select("tx", "row_id", "expected", "ts").dropna().withColumn("ms", F.unix_millis("ts")).withColumn("bucket", F.pmod(F.xxhash64("tx"), F.lit(buckets)))
    keyed = known.withWatermark("ts", wait).groupBy("bucket")
    return keyed.applyInPandasWithState(step, "tx long, n long", "tx array<long>, row_id array<long>, ms array<long>, done array<boolean>", "append", GroupStateTimeout.EventTimeTimeout)


def counted_once(events: DataFrame, ring: int = 64, ttl: str | None = None) -> DataFrame:
    """(user_id, n): a key's count after each micro-batch that raises it; an event among the last `ring` ids is a replay.

    Rows without a user or an id are left out. The ring bounds the state, so a replay is caught while no more than `ring` newer events of its key have come.
    """

    def step(key, frames, state):
        n, last = (state.get[0], state.get[1]) if state.exists else (0, [])
        held, before = dict.fromkeys(last), n
        for f in frames:
            for x in f["event_id"].tolist():
                if x not in held:
                    n += 1
                    held[x] = None
                    if len(held) > ring:
                        del held[next(iter(held))]
        state.update((n, list(held)))
        if n > before:
            yield pd.DataFrame({"user_id": [key[0]], "n": [n]})

    known = events.filter("user_id IS NOT NULL AND event_id IS NOT NULL")
    return _stateful(known, "user_id", step, "user_id long, n long", "n long, last array<long>", ttl)
