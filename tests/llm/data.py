"""Small tables with nulls, empty and long texts, ties, repeated rows and extra columns of clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, part int, score double, __text string, marked binary, hash string, _hash long"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "lo", "mi", "ne", "su", "ta", "ri"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def rows() -> list[tuple]:
    common = "This line stands in a great many documents"
    texts = {0: None, 1: "", 2: "   \n\t ", 3: words(40, 3), 4: words(40, 3), 5: words(4000, 5), 6: "one", 7: "Ünïcödé ÀÉ don't 12 a1-b2 <|endoftext|>\u3000日本語。"}
    out = {k: v for k, v in texts.items()}
    for k in range(10, 40):
        out[k] = f"{words(30, k)}\n{common if k % 2 else common.upper() + '  '}\n{words(12, k + 1000)}"
    out[40] = words(40, 3) + " extra"
    return [(k, t, "en", "src", None if t is None else len(t), "clash", 7, 0.5, "t", b"m", "h", 3) for k, t in out.items()] + [(3, out[3], "en", "src", 1, "clash", 7, 0.5, "t", b"m", "h", 3)]


def docs(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def plain(spark, texts: list) -> "DataFrame":  # noqa: F821
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
