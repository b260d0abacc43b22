"""BM25 in blocks against plain loops."""

import math
import random
from collections import Counter

from vantage.operators import text as X


def test_bm25_against_loops_without_rows_for_pairs(spark):
    r = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    docs = [(k, " ".join(r.choice(words) for _ in range(r.randrange(0, 40)))) for k in range(120)] + [(500, None), (501, "the of")]
    queries = [(k, " ".join(r.choice([*words, "absent"]) for _ in range(6))) for k in range(9)] + [(50, ""), (51, "absent the")]
    found = X.bm25(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(4), top=7)
    assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().executedPlan().toString()
    held = {d: [w for w in t.split() if w not in X.STOP_WORDS] for d, t in docs if t is not None}
    mean, df = sum(map(len, held.values())) / len(held), Counter(w for t in held.values() for w in set(t))
    want = []
    for q, text in queries:
        scores = {}
        for d, t in held.items():
            tf = Counter(t)
            parts = [math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in set(text.split()) if tf[w]]
            if round(sum(parts), 6) > 0:
                scores[d] = round(sum(parts), 6)
        want += [(q, d, s, at + 1) for at, (d, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:7])]
    got = sorted(map(tuple, found.collect()), key=lambda x: (x[0], x[3]))
    assert [(q, d, k) for q, d, _, k in got] == [(q, d, k) for q, d, _, k in want]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))
