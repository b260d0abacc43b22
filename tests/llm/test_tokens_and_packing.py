import zlib
from functools import lru_cache
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.data import docs, rows
from vantage.llm import grammar, packing, token_files
from vantage.llm.tokens import WordTokenizer

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def coder():
    return WordTokenizer(FILE)


def best_fit(lengths, capacity):
    """Sequences that best fit, longest first, needs without any reduction."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def ids_of(coder, text):
    return coder.library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aA'st .,<|>é\n\t")), max_size=40), min_size=1, max_size=5))
def test_words_one_by_one_give_the_ids_of_whole_texts(texts):
    coder = WordTokenizer(FILE) if not hasattr(test_words_one_by_one_give_the_ids_of_whole_texts, "coder") else test_words_one_by_one_give_the_ids_of_whole_texts.coder
    test_words_one_by_one_give_the_ids_of_whole_texts.coder = coder
    counts, ids = coder.encode(pa.array(texts, pa.large_string()))
    at = 0
    for text, n in zip(texts, counts, strict=True):
        assert ids[at : at + n].tolist() == ids_of(coder, text)
        at += n


@pytest.mark.parametrize("text", ["<|endoftext|>", "a <|startoftext|>b", "x<|endoftext|>. <|endoftext", "É<|endoftext|>é über naïve"])
def test_special_strings_are_read_as_the_library_reads_them(coder, text):
    assert coder.encode(pa.array([text], pa.large_string()))[1].tolist() == ids_of(coder, text)


def test_packing_places_every_piece_once(spark, coder):
    found = packing.pack(docs(spark), FILE, max_tokens=256).collect()
    want = sorted((i, ids_of(coder, t) + [0]) for i, t, *_ in rows())
    pieces = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in found)
    assert pieces == sorted((i, s, len(x[s : s + 256]), crc(x[s : s + 256])) for i, x in want for s in range(0, len(x), 256))
    fill = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 256
    assert len(fill) <= best_fit([r.length for r in found], 256)


def test_packing_of_an_empty_table(spark):
    assert packing.pack(docs(spark, []), FILE).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plans_hold_every_piece_and_no_sequence_overflows(histogram):
    plan = packing.plan_sequences(histogram, 40)
    seen, fill = {}, {}
    for length, a, b, first, offset in plan.tolist():
        seen[length] = seen.get(length, 0) + b - a
        for k in range(b - a):
            fill.setdefault(first + k, []).append((offset, length))
    assert seen == histogram
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 40
    assert len(fill) <= best_fit([k for k, n in histogram.items() for _ in range(n)], 40)


def fewest(lengths, capacity):
    """The fewest sequences, by trying every set that holds the longest piece."""

    @lru_cache(None)
    def best(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        out = len(left)
        for n in range(len(rest) + 1):
            for pick in {x for x in combinations(rest, n) if first + sum(x) <= capacity}:
                after = list(rest)
                for x in pick:
                    after.remove(x)
                out = min(out, 1 + best(tuple(after)))
        return out

    return best(tuple(sorted(lengths, reverse=True)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 31), min_size=1, max_size=8))
def test_what_is_fixed_leaves_an_optimal_packing(lengths):
    left = np.bincount(lengths, minlength=32)
    for w in set(lengths):
        beside = packing.dominant_set(left, w)
        if beside is not None:
            rest = list(lengths)
            for x in (w, *beside):
                rest.remove(x)
            assert w + sum(beside) <= 31
            assert 1 + fewest(rest, 31) == fewest(lengths, 31)


@pytest.mark.parametrize("lengths, want", [((20, 11, 16, 15), 2), ((12, 12, 10, 9, 9, 10), 2), ((20, 8, 8, 8, 3, 15), 2)])
def test_plans_that_reach_the_optimum(lengths, want):
    histogram = {x: lengths.count(x) for x in lengths}
    assert fewest(lengths, 31) == want
    plan = packing.plan_sequences(histogram, 31)
    assert max(first + b - a for _, a, b, first, _ in plan.tolist()) == want


def test_a_piece_beside_which_three_fit_is_not_fixed_with_the_longest():
    assert packing.dominant_set(np.bincount([16, 13, 11, 7, 5, 5, 5], minlength=32), 16) is None
    assert fewest((16, 13, 11, 7, 5, 5, 5), 31) == 2


def test_exact_complements_are_fixed_first():
    plan = packing.plan_sequences({30: 5, 10: 5, 20: 2}, 40)
    assert len({r[3] for r in plan.tolist() for _ in [0]}) and max(r[3] + r[2] - r[1] for r in plan.tolist()) == 6


def test_token_files_round_trip(spark, coder):
    files = token_files.write_files(docs(spark), FILE, shard_tokens=500)
    assert files.count() > 3
    found = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.read_files(files).collect())
    at, want = 0, []
    for i, text in sorted(((i, t) for i, t, *_ in rows()), key=lambda x: x[0]):
        x = ids_of(coder, text) + [2]
        want.append((at, i, len(x), crc(x)))
        at += len(x)
    assert found == want


def test_token_files_of_an_empty_table_and_null_ids(spark):
    assert token_files.encode_and_read(docs(spark, []), FILE).count() == 0
    some = spark.createDataFrame([(None, "a b"), (1, None)], "doc_id long, text string")
    assert [(r.doc_id, r.start) for r in token_files.encode_and_read(some, FILE).orderBy("start").collect()] == [(None, 0), (1, 3)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=30), min_size=1, max_size=6))
def test_grammar_round_trip_and_random_access(lists):
    docs_ = [np.array([*x, 9], np.uint32) for x in lists]
    counts = np.array([len(x) for x in docs_])
    raw = grammar.write(list(range(len(docs_))), np.concatenate(docs_), counts, 9, least=2)
    shard = grammar.Shard(raw)
    ids, n = shard.documents()
    assert n.tolist() == counts.tolist() and ids.tolist() == np.concatenate(docs_).tolist()
    for k, x in enumerate(docs_):
        assert shard.document(k).tolist() == x.tolist()
        assert shard.document(k, 1, 2).tolist() == x[1:3].tolist()


def pairs_without_overlap(seq):
    """How often each pair occurs in a sequence, every other one of a run; END (0) never pairs."""
    found, before = {}, None
    for k in range(len(seq) - 1):
        pair = (seq[k], seq[k + 1])
        if 0 in pair or (pair == before and seq[k] == seq[k + 1]):
            before = None
            continue
        found[pair] = found.get(pair, 0) + 1
        before = pair
    return found


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=300), st.integers(2, 5))
def test_no_pair_stays_frequent(symbols, least):
    seq, rules, made = grammar.build(np.array(symbols, np.int64), 5, least)
    assert sum(made) == len(rules)
    assert max(pairs_without_overlap(seq.tolist()).values(), default=0) < least
    expanded = {k: [k] for k in range(5)}
    for k, (left, right) in enumerate(rules.tolist(), 5):
        expanded[k] = expanded[left] + expanded[right]
    assert [x for s in seq.tolist() for x in expanded[s]] == symbols


def test_grammar_shortens_repetition():
    x = np.array([1, 2, 3, 4] * 512 + [9], np.uint32)
    shard = grammar.Shard(grammar.write([0], x, np.array([len(x)]), 9))
    assert len(shard.sequence) < 12
    assert shard.expansions.length.max() >= 256
    assert shard.document(0, 1001, 5).tolist() == x[1001:1006].tolist()


def test_symbols_wider_than_two_bytes(rng=np.random.default_rng(3)):
    x = np.append(rng.permutation(70_000), 9).astype(np.uint32)
    shard = grammar.Shard(grammar.write([None], x, np.array([len(x)]), 9))
    assert shard.documents()[0].tolist() == x.tolist() and shard.null.tolist() == [True]


def test_a_doc_id_that_fills_several_parts(spark, coder):
    some = spark.createDataFrame([(5, f"word {k}") for k in range(60)] + [(k, "a") for k in (-(2**63), 1, 9)], "doc_id long, text string")
    files = token_files.write_files(some, FILE)
    assert files.select("part").distinct().count() > 1
    found = token_files.read_files(files).orderBy("start").collect()
    assert [r.doc_id for r in found] == [-(2**63), 1] + [5] * 60 + [9]
    assert sorted(r.ids_crc32 for r in found if r.doc_id == 5) == sorted(crc(ids_of(coder, f"word {k}") + [2]) for k in range(60))
