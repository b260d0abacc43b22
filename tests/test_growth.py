"""Steps whose rows must not grow with the square of a table, and their odd rows."""

import math
import random

import numpy as np
import pyarrow as pa

from vantage import catalog
from vantage.operators import nearest as N
from vantage.operators import temporal as T
from vantage.operators import text as X

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_scores_in_blocks_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(N, "VECTORS", 40)
    monkeypatch.setattr(N, "QUERIES", 8)
    r = np.random.default_rng(1)
    x = r.standard_normal((60, 8)).round(3)
    x[7] = 0
    rows = [(k, None if k in (10, 33) else x[k].tolist(), k % 3) for k in range(60)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    q = v.filter("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    found = N.all_scores(q, v)
    got = {(a, b): s for a, b, s in map(tuple, found.collect())}
    assert len(got) == 12 * 60
    x = x.astype(np.float32).astype(np.float64)
    for (a, b), s in got.items():
        if a == 10 or b in (10, 33):
            assert s is None
        else:
            size = math.sqrt((x[a] @ x[a]) * (x[b] @ x[b]))
            assert abs(s - (x[a] @ x[b] / size if size else 0)) < 2e-6
    known = [k for k in range(60) if k not in (10, 33)]
    want = []
    for a in (k for k in known if k % 5 == 0):
        near = sorted(((-got[a, b], b) for b in known if b != a and b % 3 == a % 3 and got[a, b] >= 0.15))[:3]
        want += [(a, b, -s, at + 1) for at, (s, b) in enumerate(near)]
    assert sorted(map(tuple, N.within(q, v, "label", 0.15, 3).collect())) == sorted(want)


def test_pairs_of_vectors_are_no_rows(spark):
    for name in ("X04_cosine", "R19_quantised_recall", "R27_selective_recall"):
        p = plan(catalog.QUERIES[name](spark, SMALL))
        assert "FlatMapCoGroupsInPandas" in p and "zip_with" not in p, name
    asked = {r.query_id for r in catalog.QUERIES["R27_selective_recall"](spark, SMALL).collect()}
    assert any(k % 100 == 50 for k in asked)  # every fiftieth vector asks


def test_quantised_halves_go_away_from_zero():
    assert N.quantised(np.array([[127.0, 0.5, -0.5, 1.49, -2.5]])).tolist() == [[127, 1, -1, 1, -3]]
    assert N.quantised(np.zeros((1, 2))).tolist() == [[0, 0]]


def test_distinct_values_in_a_trailing_width(spark):
    r = random.Random(4)
    rows = [(k, r.choice(["a", "b", None]), r.choice([None, *range(40)]), r.choice([None, 1, 2, 3, 4])) for k in range(400)]
    e = spark.createDataFrame(rows, "id long, k string, us long, user long").repartition(3)
    found = T.trailing_distinct(e, "k", "us", "user", 6)
    want = [(i, len({u for _, b, s, u in rows if b == k and s is not None and t - 6 <= s <= t} - {None})) for i, k, t, _ in rows if k is not None and t is not None]
    assert sorted((x.id, x.n) for x in found.collect()) == want
    assert "collect_set" not in plan(catalog.QUERIES["W08_distinct_in_window"](spark, SMALL))


def test_shingles_from_hashes_of_words():
    r = random.Random(5)
    texts = [[], [], ["a"], ["a", "b", "c"], ["a", "b", "c", "d"], ["b", "a", "c", "d"], *[[r.choice("abc") for _ in range(r.randint(0, 60))] for _ in range(300)]]
    code = {w: r.getrandbits(63) for w in "abc" + "d"}
    whole = [7, 8, *range(100, 100 + len(texts) - 2)]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "whole": pa.array(whole), "w": pa.array([[code[w] for w in t] for t in texts], pa.list_(pa.int64()))})
    got = [x for b in X._runs(5)([batch, batch.slice(3, 0)]) for x in b.to_pylist()]
    plain = [{tuple(t[i : i + 5]) for i in range(max(len(t) - 4, 1))} if t else {("", whole[k])} for k, t in enumerate(texts)]
    assert [x["doc_id"] for x in got] == list(range(len(texts)))
    assert [len(x["s"]) for x in got] == [len(p) for p in plain] and all(x["s"] == sorted(set(x["s"])) for x in got)
    for x, p in zip(got[:60], plain, strict=False):
        for y, q in zip(got[:60], plain, strict=False):
            assert len(set(x["s"]) & set(y["s"])) == len(p & q) and (x["id"] == y["id"]) == (p == q)
