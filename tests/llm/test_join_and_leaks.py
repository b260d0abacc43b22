import random
import re
import time
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.data import docs, plain, rows, words
from vantage.llm import decontamination, ngram_join


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(items):
    """doc -> (class, links, copies) by comparing all pairs."""
    sets = defaultdict(list)
    for i, t in items:
        sets[shingles(t)].append(i)
    nodes = list(sets)
    root = {x: x for x in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = defaultdict(int)
    for k, a in enumerate(nodes):
        for b in nodes[:k]:
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[top(a)] = top(b)
    least = defaultdict(lambda: 1 << 60)
    for x in nodes:
        least[top(x)] = min(least[top(x)], *sets[x])
    return sorted((i, least[top(x)], links[x], len(sets[x])) for x in nodes for i in sets[x])


def edited(text, n, r):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def test_join_against_all_pairs(spark):
    r = random.Random(3)
    base = [words(120, 900 + k) for k in range(4)]
    items = [(i, t) for i, t, *_ in rows()]
    for k in range(160):
        items.append((1000 + k, edited(base[k % 4], r.choice([0, 1, 2, 3, 4, 6]), r)))
    found = ngram_join.join_texts(spark.createDataFrame(items, "doc_id long, text string"), block_shingles=2000).collect()
    assert sorted(map(tuple, found)) == brute(items)


def test_buckets_too_large_at_every_level_are_compared_in_blocks(spark):
    r = random.Random(4)
    items = [(k, edited(words(150, 77), r.choice([0, 1, 2]), r)) for k in range(80)]
    own = spark.createDataFrame(items, "doc_id long, text string")
    rows_ = ngram_join.members(own, 0.8, 3)
    sets = rows_.dropDuplicates(["id"])
    edges = ngram_join.coarse_edges(sets, brute=4, depth=2)
    from vantage.operators.graph import components

    assert components(edges).select("root").distinct().count() == 1


def test_join_edge_cases(spark):
    assert ngram_join.join_texts(docs(spark, [])).count() == 0
    assert ngram_join.keep_one(docs(spark, [])).count() == 0
    found = {r.doc_id: r for r in ngram_join.join_texts(docs(spark)).collect()}
    assert found[0].class_id == found[1].class_id == found[2].class_id == 0
    assert found[4].class_id == 3 and found[40].class_id == 3 and found[40].n_links == 1 and found[3].n_copies == 3
    kept = ngram_join.keep_one(docs(spark))
    assert kept.columns == docs(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.class_id for r in found.values()})


def test_null_and_shared_doc_ids_lose_no_links(spark):
    a = words(60, 900)
    found = ngram_join.join_texts(spark.createDataFrame([(None, a), (None, a + " extra word"), (2, a + " other words")], "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.class_id, r.n_links, r.n_copies) for r in found.collect()) == [(0, 2, 2, 1), (0, 2, 2, 1), (2, 2, 2, 1)]
    nobody = ngram_join.join_texts(spark.createDataFrame([(None, a), (None, a + " extra word"), (None, "something else")], "doc_id long, text string"))
    assert sorted((r.n_links, r.class_id) for r in nobody.collect()) == [(0, None), (1, None), (1, None)]
    r = random.Random(8)
    for shared in (5, None):  # all rows have one doc_id, or none
        texts_ = [edited(words(80, 40 + k % 12), r.choice([0, 1, 2]), r) for k in range(90)]
        sets = [frozenset(tuple(x.split()[i : i + 5]) for i in range(max(1, len(x.split()) - 4))) for x in texts_]
        different = set(sets)
        links = sorted(sum(len(s & t) / len(s | t) >= 0.8 for t in different if t != s) for s in sets)
        found = ngram_join.join_texts(spark.createDataFrame([(shared, x) for x in texts_], "doc_id long, text string"))
        assert sorted(x.n_links for x in found.collect()) == links


def plain_edits(item, text):
    row = [0] * (len(text) + 1)
    for k, c in enumerate(item, 1):
        new = [k]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_leaks_with_edits_are_found(spark):
    r = random.Random(5)
    items = [words(30, 500 + k) for k in range(6)] + ["short", None, "", words(30, 500)]
    texts, planted = [], []
    for k in range(60):
        x = list(items[k % 6])
        for _ in range(r.randint(0, int(0.06 * len(x)))):
            p, kind = r.randrange(len(x)), r.random()
            x[p : p + (kind < 0.7)] = [] if kind < 0.3 else [r.choice("xyz")]
        texts.append(words(r.randint(0, 60), 9000 + k) + "\n" + "".join(x).upper() + " " + words(20, 9900 + k))
        planted.append(k % 6)
    clean = [words(80, 7000 + k) for k in range(30)] + [None, "", "short"]
    bench = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(items)], "item_id long, text string, doc_id string")
    found = decontamination.find_leaks(plain(spark, texts + clean), bench).collect()
    got = {(x.doc_id, x.item_id) for x in found}
    assert all((d, i) in got for d, i in enumerate(planted))
    assert all(d < 60 for d, _ in got) and all((d, 9) in got for d, i in enumerate(planted) if i == 0)
    for x in found:
        part = (texts[x.doc_id].lower().replace("\n", " "))[x.start : x.end]
        assert plain_edits(items[x.item_id], part) == x.edits <= 0.06 * x.item_chars
    sliced = decontamination.find_leaks(plain(spark, texts + clean), bench, slice_chars=200).collect()
    assert sorted(map(tuple, sliced)) == sorted(map(tuple, found))
    kept = decontamination.drop_leaked(plain(spark, texts + clean), bench)
    assert sorted(x.doc_id for x in kept.collect()) == list(range(60, 60 + len(clean)))


def places(item, text, most):
    """Ends of every place of item in text within `most` edits, by plain alignment with a free start."""
    row = list(range(len(item) + 1))
    out = []
    for j, d in enumerate(text, 1):
        new = [0]
        for k, c in enumerate(item, 1):
            new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (c != d)))
        row = new
        if row[-1] <= most:
            out.append(j)
    return out


def scan(item, text):
    items = decontamination.Items([(1, item)], 0.06)
    codes = decontamination.fold(text)
    return decontamination.regions(np.concatenate([codes, np.zeros(decontamination.Q, np.uint32)]), np.array([0, len(codes) + decontamination.Q]), items)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from(["ab", "abcdefgh", "a"]), st.integers(17, 60), st.booleans())
def test_no_place_is_missed_and_none_made_up(seed, letters, size, repeat):
    r = random.Random(seed)
    item = "".join(r.choice(letters) for _ in range(size))
    item = (item[:3] * size)[:size] if repeat else item
    text = "".join(r.choice(letters) for _ in range(r.randint(0, 80)))
    for _ in range(r.randint(0, 3)):
        x = list(item)
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(x))
            x[k : k + r.randint(0, 1)] = r.choice(["", "z", "a"])
        text += "".join(x) + "".join(r.choice(letters) for _ in range(r.randint(0, 30)))
    most = int(0.06 * len(item))
    want, found = places(item, text, most), scan(item, text)
    assert bool(want) == bool(found)
    for _, _, a, z, edits in found:
        assert plain_edits(item, text[a:z]) == edits <= most
    loose = decontamination.Items([(1, item)], 0.06).loose[0]
    for end in want:  # every place overlaps one that is reported, or in a repetitive text lies near it
        assert any(abs(z - end) <= (3 if loose else 1) * (len(item) + most) for _, _, a, z, _ in found)


def test_repetitive_texts_take_time_in_proportion():
    start = time.process_time()
    found = scan("ab" * 150, "ab" * 250_000)
    assert found and time.process_time() - start < 60


def test_leaks_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_leaks(docs(spark), bench).count() == 0
    assert decontamination.find_leaks(docs(spark, []), spark.createDataFrame([(1, words(20, 1))], "item_id long, text string")).count() == 0
    assert decontamination.drop_leaked(docs(spark), bench).count() == len(rows())


def test_pairs_in_buckets_split_deep_are_found(spark):
    assert [ngram_join.runs_for(0.998, k) for k in (1, 2, 3, 10)] == [10, 10, 14, 37]
    r = random.Random(6)
    passage, items = words(100, 60), []
    for k in range(300):  # all share half of their shingles; texts 2 k and 2 k + 1 are at about 0.8
        own = words(110, 4000 + k)
        items += [(2 * k, f"{passage} {own}"), (2 * k + 1, f"{passage} {edited(own, 4, r)}")]
    want = {k for k in range(300) if len((a := shingles(items[2 * k][1])) & (b := shingles(items[2 * k + 1][1]))) >= 0.8 * len(a | b)}
    own = ngram_join.members(spark.createDataFrame(items, "doc_id long, text string"), 0.8, ngram_join.runs_for(0.998))
    from vantage.operators.graph import components

    found = components(ngram_join.coarse_edges(own, brute=4)).join(own.select("id", "doc_id"), "id").collect()
    root = {x.doc_id: x.root for x in found}
    lost = [k for k in want if root.get(2 * k, 0) != root.get(2 * k + 1, 1)]
    assert len(want) > 200 and len(lost) <= 0.02 * len(want)


def test_blocks_of_few_sets_keep_all_links(spark):
    r = random.Random(7)
    items = [(k, edited(words(60, 5), r.choice([0, 1]), r)) for k in range(30)]
    found = ngram_join.join_texts(spark.createDataFrame(items, "doc_id long, text string"), block_sets=4).collect()
    assert sorted(map(tuple, found)) == brute(items)
