import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.data import docs as odd_docs
from tests.llm.data import rows, words
from tests.llm.test_join_and_leaks import brute, edited
from vantage.runtime import settle

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_act_and_keep_clean_documents(spark, tmp_path):
    line = "A footer that many of these documents share"
    docs, labels = [], []
    for k in range(300):
        bad = k % 10 == 0
        text = words(60, k) + (" idiot scum moron idiot" if bad else "")
        docs.append((k, f"{text}\n{line if 100 <= k < 120 else 'own line ' + words(5, k + 5000)}", "en", "s", 1))
        labels.append((k, int(k % 10 == 0)))
    docs += [(1000, docs[1][1], "en", "s", 1), (1001, docs[1][1] + " more", "en", "s", 1), (1002, words(50, 8) + " " + words(30, 777), "en", "s", 1), (1003, None, "en", "s", None), (1, docs[1][1], "en", "s", 1)]
    base = str(tmp_path)
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(0, words(30, 777))], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    steps = dict(corpus_pipeline.STAGES)
    now = spark.read.parquet(f"{base}/documents.parquet")
    ids = lambda d: sorted(r.doc_id for r in d.collect())
    for name in list(steps)[:-1]:
        before, now = now, settle(steps[name](spark, now, base), name)
        assert now.columns == [c.split()[0] for c in COLUMNS.split(", ")]
        if name == "toxicity":
            gone = set(ids(before)) - set(ids(now))
            assert {k for k in range(0, 300, 10)} - gone == set() and all(k % 10 == 0 for k in gone)
        if name == "line_dedup":
            assert ids(before) == ids(now) and not any(line in (r.text or "") for r in now.collect())
            assert all(r.n_chars == len(r.text) for r in now.collect())
        if name == "ngram_join":
            assert set(ids(before)) - set(ids(now)) == {1000, 1001} and ids(now).count(1) == 1
        if name == "decontamination":
            assert set(ids(before)) - set(ids(now)) == {1002}
    packed = steps["packing"](spark, now, base)
    assert {r.doc_id for r in packed.collect()} == set(ids(now))
    assert sorted(r.length for r in corpus_pipeline.run(spark, base).collect()) == sorted(r.length for r in packed.collect())


def test_odd_documents_go_through_every_stage(spark, tmp_path):
    """Nulls, empty and long texts, repeats and clashing names; then no rows at all."""
    spark.createDataFrame([(3, 0), (4, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for some in (None, [], [(None, None, *[None] * 10), (None, "a null id", *[None] * 10)]):
        now = odd_docs(spark, some)
        columns, n = now.columns, now.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = settle(stage(spark, now, str(tmp_path)), name)
            assert now.columns == columns
        assert now.count() <= n and (n == 0 or now.count() > 0)
        packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert packed.filter("piece = 0").count() == now.count()
    assert len(rows()) > 30


def fewest_edits(item: str, text: str) -> int:
    """Edits from the item to the nearest part of the text, by the whole table of edit distances."""
    last = np.arange(len(item) + 1)
    best, own = len(item), np.array([ord(c) for c in item])
    for c in text:
        now = np.empty_like(last)
        now[0] = 0
        now[1:] = np.minimum(last[:-1] + (own != ord(c)), last[1:] + 1)
        now = np.minimum.accumulate(now - np.arange(len(now))) + np.arange(len(now))
        last, best = now, min(best, int(now[-1]))
    return best


def plain_pipeline(docs: dict, toxic: set, items: list[str]) -> dict:
    """doc_id -> text after the first four stages, by loops over all documents, lines, pairs and places."""
    docs = {k: t or "" for k, t in docs.items() if k not in toxic}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()
    often = Counter(x for t in docs.values() for x in {key(line) for line in t.split("\n")})
    docs = {k: "\n".join(line for line in t.split("\n") if not key(line) or often[key(line)] < 10) for k, t in docs.items()}
    docs = {k: docs[k] for k, least, *_ in brute(list(docs.items())) if k == least}
    fold = lambda t: " ".join(t.lower().split())
    return {k: t for k, t in docs.items() if all(fewest_edits(fold(x), fold(t)) > 0.06 * len(fold(x)) for x in items)}


def test_run_against_loops(spark, tmp_path):
    r = random.Random(9)
    items = [words(25, 5000 + k) for k in range(3)]
    docs, toxic = {}, set()
    shared = ["  Shared line number one ", "another LINE that is shared", "a line of nine documents"]
    for k in range(240):
        lines = [words(r.randrange(20, 60), k), words(12, k + 2000)]
        if k % 8 == 0:
            lines[0] += " idiot scum moron idiot scum"
            toxic.add(k)
        for n, line in enumerate(shared):
            if (n < 2 and k % (7 + n) == 3) or (n == 2 and 100 <= k < 109):
                lines.insert(r.randrange(3), line.upper() if r.random() < 0.3 else line)
        docs[k] = "\n".join(lines)
    clean = [k for k in docs if k not in toxic]
    for k in range(300, 340):  # copies, near copies and looser ones
        docs[k] = edited(docs[r.choice(clean)], r.choice([0, 0, 1, 2, 3, 5]), r)
    for k in range(400, 424):  # items whole, with slips of the pen, and with too many
        item = list(items[k % 3])
        for _ in range(r.choice([0, 2, 5, 30, 60])):
            item[r.randrange(len(item))] = r.choice("xyz")
        docs[k] = f"{words(20, k + 3000)} {''.join(item)} {words(20, k + 4000)}"
    docs |= {500: None, 501: "", 502: words(3000, 502), 503: "one"}
    spark.createDataFrame([(k, t, "en", "s", None) for k, t in docs.items()], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k in toxic)) for k in range(240)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = plain_pipeline(docs, toxic, items)
    assert 0 < sum(k >= 400 for k in want) < 28 and 0 < sum(300 <= k < 400 for k in want) < 40
    coder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {k: [*coder.encode(t, add_special_tokens=False).ids, 0] for k, t in want.items()}
    pieces = {(k, n): x[n * 2048 : (n + 1) * 2048] for k, x in ids.items() for n in range(-(-len(x) // 2048))}
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(x.doc_id, x.piece) for x in found} == set(pieces) and len(found) == len(pieces)
    for x in found:
        own = pieces[x.doc_id, x.piece]
        assert (x.start, x.length, x.ids_crc32) == (2048 * x.piece, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    held: dict[int, list] = {}
    for x in sorted(found, key=lambda x: x.offset):
        held.setdefault(x.sequence_id, []).append(x)
    for rows_ in held.values():
        assert [x.offset for x in rows_] == [sum(y.length for y in rows_[:n]) for n in range(len(rows_))]
        assert sum(x.length for x in rows_) <= 2048
    assert len(held) == -(-sum(map(len, ids.values())) // 2048)
