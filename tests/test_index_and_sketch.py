"""Trigram blocks and bounded counters, against plain loops."""

import random
from collections import Counter

from vantage.operators import heavy as H
from vantage.operators import trigrams as G


def test_search_reads_candidate_blocks_only(spark):
    r = random.Random(1)
    rows = [(k, " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(20)) + (" The Needle!" if k in (70, 400) else " need lee" if k == 130 else "")) for k in range(500)] + [(600, None), (601, ""), (602, "ab")]
    index = G.build(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), size=32)
    found = G.search(index, "neeDLe")
    assert sorted(x.doc_id for x in found.collect()) == [70, 400]
    blocks = sorted(x.block for x in G.candidates(index, "needle").collect())
    assert blocks == [70 // 32, 400 // 32]  # the text with `need lee` has not all trigrams
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan, plan  # folders of other blocks are not opened
    assert sorted(x.doc_id for x in G.search(index, "ab").collect()) == [602] and G.search(index, "zebra").collect() == []
    assert index.postings.count() == index.postings.distinct().count()


def top(values, k):
    return sorted(((v, n) for v, n in Counter(v for v in values if v is not None).items()), key=lambda x: (-x[1], x[0]))[:k]


def test_heavy_hitters_with_few_counters(spark):
    r = random.Random(2)
    values = [r.choice([1, 2, 3, 4]) if r.random() < 0.6 else r.randrange(5, 4000) for _ in range(20_000)] + [None] * 9000
    r.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(5)
    lows = H.sketch(df, "v", 32).collect()
    true = Counter(values)
    for v in (1, 2, 3, 4):  # the bound holds
        low, lost = sum(x.low for x in lows if x.v == v), sum(x.lost for x in lows)
        assert low <= true[v] <= low + lost
    assert len(lows) <= 5 * 33 and sum(x.lost for x in lows) <= 20_000 / 33
    assert [tuple(x) for x in H.heavy_hitters(df, "v", 4, counters=32).collect()] == top(values, 4)
    # no value stands out from the bound: all are counted
    assert [tuple(x) for x in H.heavy_hitters(df, "v", 50, counters=32).collect()] == top(values, 50)


def test_heavy_hitters_of_texts_ties_and_nothing(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("b",), ("a",)], "v string")
    assert [tuple(x) for x in H.heavy_hitters(df, "v", 2).collect()] == [("a", 2), ("b", 2)]
    assert [tuple(x) for x in H.heavy_hitters(df, "v", 9).collect()] == [("a", 2), ("b", 2), ("c", 1)]
    assert H.heavy_hitters(df.filter("v = 'z'"), "v", 3).collect() == []
