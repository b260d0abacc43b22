"""Rows of a key in order, in pieces, and transactions in buckets."""

import random

import pandas as pd

from vantage.operators import trigrams as G
from vantage.streaming import keyed as K
from vantage.streaming import ordered as O


def test_in_order_with_runs_in_files(monkeypatch):
    monkeypatch.setattr(O, "HELD", 50)
    monkeypatch.setattr(O, "PIECE", 7)
    r = random.Random(3)
    for n in (0, 1, 49, 50, 51, 333):
        rows = [(r.randrange(40), k, r.choice(["x", None]), r.choice([1.5, None])) for k in range(n)]
        r.shuffle(rows)
        frames = [pd.DataFrame(rows[k : k + 11], columns=["ms", "id", "s", "v"]) for k in range(0, n, 11)]
        pieces = list(O.in_order(iter(frames), ["ms", "id"]))
        assert all(0 < len(p) <= 7 for p in pieces)
        got = [(a, b, c, None if v != v else v) for p in pieces for a, b, c, v in p.itertuples(index=False)]
        assert [(a, b, None if c is None or c != c else c, v) for a, b, c, v in got] == sorted(rows, key=lambda x: x[:2])


def test_nulls_come_last_in_every_piece(monkeypatch):
    monkeypatch.setattr(O, "HELD", 4)
    monkeypatch.setattr(O, "PIECE", 2)
    values = [3.0, None, 1.0, 2.0, None, 0.0, 5.0, 4.0]
    frames = [pd.DataFrame({"v": values[k : k + 2]}) for k in (0, 2, 4, 6)]
    got = pd.concat(O.in_order(frames, ["v"]))["v"].tolist()
    assert got[:6] == [0, 1, 2, 3, 4, 5] and all(x != x for x in got[6:])


def test_transactions_share_a_state():
    """A bucket's rows go through one state: Python is called once a bucket, not once a transaction."""
    import inspect

    assert "buckets" in inspect.signature(K.complete_transactions).parameters


def test_folders_do_not_grow_with_blocks(spark, monkeypatch):
    monkeypatch.setattr(G, "SHELVES", 5)
    docs = spark.createDataFrame([(k, "needle" if k in (3, 777) else f"text {k}") for k in range(1000)], "doc_id long, text string")
    index = G.build(docs, size=8)
    assert index.texts.select("shelf").distinct().count() <= 6 and index.texts.select("block").distinct().count() == 125
    assert sorted(x.doc_id for x in G.search(index, "Needle").collect()) == [3, 777]
