"""Piece ids against the model's library, which merges; whole texts, odd texts and texts made of the vocabulary's own parts."""

import hashlib
import random

import public_tokenizers
import pytest
from tests.llm.data import docs, plain, rows
from vantage.llm import pieces, queries

FILE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def coder():
    return pieces.PieceEncoder(FILE, limit=300)  # so that chunks and pairs are forgotten, too


def test_ids_are_the_library_s(coder):
    r = random.Random(5)
    letters = "abcdeinorst  ▁\n\r\t{};().,'\"éü日本한🙂\x00<0x0A>"
    parts = list(coder.id)
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(3000)]
    texts += ["".join(r.choice(parts) for _ in range(r.randint(0, 15))).replace("▁", " ") for _ in range(3000)]
    texts += ["", " ", "\n", "  a  b ", " " * 37, "a" * 5000, "ab" * 4000, "日" * 3000, "</s><s> <unk>"]
    assert [coder.encode(x).tolist() for x in texts] == coder.library.encode(texts)


def test_backtracking_gives_up_longest_matches(coder):
    given_up = [x for x in ("▁" + a + b for a in ("th", "an", "wher", "in", "un", "re") for b in ("eabouts", "ergy", "ctions", "deredness", "ation", "ability")) if [t for t in coder.tokens(x)] != [t for _, t in coder.automaton.iter_long(x)]]
    assert given_up  # the greedy row of longest matches is wrong for some of these words
    for x in given_up:
        assert coder.ids(coder.tokens(x)) == coder.library.encode(x[1:])


def test_replay_agrees_with_merging_both(coder):
    r = random.Random(2)
    tokens = sorted(coder.shorter)

    def merged(text):
        parts = list(text)
        while len(parts) > 1:
            found = [coder.score.get(a + b, pieces.NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            if max(found) == pieces.NEVER:
                break
            k = found.index(max(found))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    for _ in range(3000):
        a, b = r.choice(tokens), r.choice(tokens)
        assert coder.fits(a, b) == (merged(a + b) == [a, b]), (a, b)


def expected(coder, found):
    out = []
    for doc_id, text in found:
        ids = [*coder.library.encode(text or ""), 2]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(coder.library.decode(ids))))
    return sorted(out)


def test_query_over_whole_documents(spark, coder):
    found = queries.queries()["op12_piece_codes"](spark, "/root/testdata/sf0.001")
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, found.collect())) == expected(coder, texts)


def test_odd_documents_and_other_columns(spark, coder):
    assert sorted(map(tuple, pieces.piece_digest(docs(spark), FILE).collect())) == expected(coder, [r[:2] for r in rows()])
    odd = plain(spark, ["x y", None]).selectExpr("doc_id", "text", "'mine' AS ids", "'too' AS _ids")
    coded = pieces.encode_pieces(odd, FILE)
    assert coded.columns == ["doc_id", "ids", "_ids", "__ids"] and sorted(map(tuple, coded.collect())) == [(0, "mine", "too", [*coder.library.encode("x y"), 2]), (1, "mine", "too", [2])]
    back = pieces.decode_pieces(pieces.encode_pieces(plain(spark, ["x y", None, "  two\nlines  "]), FILE, None), FILE)
    assert sorted(r.text for r in back.collect()) == ["", "  two\nlines  ", "x y"]
    assert pieces.piece_digest(docs(spark, []), FILE).collect() == []
