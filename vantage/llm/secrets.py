"""Secret scans: fixed patterns, and automata learned from labelled credentials that score every candidate.

Labelled credentials are the values that the patterns find, by kind, and examples of formats that no pattern names: those
of a table that the caller gives, or drawn from descriptions of formats in public documentation (EXAMPLES). The other runs of
credential characters in the corpus are the counterexamples, those without letters, those without small letters and others apart. Each sample is the `sample` distinct strings with the least hashes, so
they are drawn from the whole corpus and have a bound; strings are learned whole, and those longer than LONGEST_SAMPLE are
no samples. A candidate is any run of at least 8 credential characters, a pattern's credential included. Its score is by
how many nats a character the best automaton of credentials finds it likelier than the best of the others does; outside the
patterns' spans it is a secret where that exceeds a margin.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vantage.llm.arrays import list_parts, slices, texts
from vantage.llm.automata import Automaton, Letters
from vantage.runtime import discard, settle

ASSIGN = re.compile(r"(?ia)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "format")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
NOT_RUN = "[^A-Za-z0-9+/_.=-]+"
LEAST_RUN, LONGEST_SAMPLE = 8, 4096
PLAIN = ("number", "capitals", "word")  # runs outside the patterns' spans: without letters, without small ones, and others
CAPITALS = re.compile("[^a-z]*")
NUMBER = re.compile("[0-9+/_.=-]*")
# fixed values: parts of credential formats, each an own text or (characters, least and most of them)
_HEX, _ALNUM, _UPPER, _BASE64 = "0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
EXAMPLES = {
    "code host token": ["ghp_", (_ALNUM, 36, 36)],
    "payment key": ["sk_live_", (_ALNUM, 24, 24)],
    "access id": ["AKIA", (_UPPER, 8, 16)],
    "unique id": [(_HEX, 8, 8), "-", (_HEX, 4, 4), "-", (_HEX, 4, 4), "-", (_HEX, 4, 4), "-", (_HEX, 12, 12)],
    "padded base 64": [(_BASE64, 42, 43), "="],
    "short hex": [(_HEX, 20, 31)],
    "letters and digits": [(_ALNUM, 20, 64)],
}
SPANS = "array<struct<start:int,end:int,kind:string,score:double>>"


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of the patterns, leftmost and without overlap within a kind."""
    out = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= 8:
            out.append((m.start(), m.end(), "assign", m[2]))
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _marked(column: pa.Array) -> Iterator[tuple[int, str, list]]:
    """(row, text, spans) of the texts with the patterns' spans; the patterns run where a cheaper test finds a trace."""
    trace = pc.match_substring_regex(column, r"(?i:passw|secret|token|api_?key)|AKIA[A-Z0-9]{12}|[0-9a-f]{32}")
    for row in np.flatnonzero(trace.to_numpy(zero_copy_only=False)).tolist():
        text = column[row].as_py()
        if base := base_spans(text):
            yield row, text, base


def _runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row, code, names): the distinct candidates of each text, as codes into their names."""
    per_text, runs = list_parts(pc.ascii_split_whitespace(pc.replace_substring_regex(column, NOT_RUN, " ")))
    row = np.repeat(np.arange(len(per_text)), per_text)
    long = pc.greater_equal(pc.binary_length(runs), LEAST_RUN)
    coded = runs.filter(long).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return row[long.to_numpy(zero_copy_only=False)], codes, coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def candidates(text: str, base: list) -> Iterator[tuple[int, int]]:
    """Runs of at least 8 credential characters that touch no base span; base comes by start."""
    at, reach = 0, -1
    for m in RUN.finditer(text):
        a, b = m.span()
        while at < len(base) and base[at][0] < b:
            reach = max(reach, base[at][1])
            at += 1
        if reach <= a:
            yield a, b


def labelled(docs: DataFrame, sample: int) -> list[tuple[str, str]]:
    """(kind, value): for each kind of credential and for plain runs, the `sample` distinct strings of least hash."""

    def gather(batches):
        least: dict[str, dict[str, int]] = {}

        def add(kind: str, values) -> None:
            held = least.setdefault(kind, {})
            held |= {v: xxhash.xxh3_64_intdigest(v) >> 1 for v in values if len(v) <= LONGEST_SAMPLE}
            if len(held) > sample:
                least[kind] = dict(sorted(held.items(), key=lambda x: (x[1], x[0]))[:sample])

        def add_plain(values) -> None:
            parts: tuple[list, list, list] = ([], [], [])
            for v in values:
                parts[0 if NUMBER.fullmatch(v) else 1 if CAPITALS.fullmatch(v) else 2].append(v)
            for kind, some in zip(PLAIN, parts, strict=True):
                add(kind, some)

        for batch in slices(batches, "text"):
            column = texts(batch)
            base_rows = []
            for row, text, base in _marked(column):
                base_rows.append(row)
                for _, _, kind, value in base:
                    add(kind, [value])
                add_plain({text[a:b] for a, b in candidates(text, base)})
            row, codes, names = _runs(column)
            add_plain([names[k] for k in np.unique(codes[~np.isin(row, base_rows)]).tolist()])
        rows = [(kind, h, v) for kind, held in least.items() for v, h in held.items()]
        if rows:
            kind, h, v = zip(*rows, strict=True)
            yield pa.record_batch({"kind": pa.array(kind), "h": pa.array(h, pa.int64()), "value": pa.array(v)})

    rows = settle(docs.select("text").mapInArrow(gather, "kind string, h long, value string").distinct(), "labelled")
    kinds = [*KINDS[:-1], *PLAIN]
    parts = [rows.filter(F.col("kind") == k).orderBy("h", "value").limit(sample) for k in kinds]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    found = [(r.kind, r.value) for r in out.collect()]
    discard(rows)
    return found


def examples(formats: dict[str, list] = EXAMPLES, each: int = 400) -> list[tuple[str, str]]:
    """(kind, value): `each` strings of each format, the same ones every time."""
    out = []
    for kind, parts in formats.items():
        r = random.Random(kind)
        draw = lambda x, r=r: x if isinstance(x, str) else "".join(r.choices(x[0], k=r.randint(x[1], x[2])))
        out += [(f"example {kind}", "".join(map(draw, parts))) for _ in range(each)]
    return out


def _alphabet(value: str) -> str:
    """Credentials of different alphabets are different formats; one automaton would give all the widest."""
    return "hex" if re.fullmatch("[0-9a-f]*", value) else "letters and digits" if value.isalnum() else "any"


def learn(docs: DataFrame, sample: int = 1500, given: list[tuple[str, str]] = ()) -> dict[str, Automaton | Letters]:
    """An automaton for each kind and alphabet of credentials found, for each kind given, and for plain runs. sample bounds
    what reaches the driver of each kind."""
    found: dict[str, list[str]] = {}
    for kind, value in given:
        found.setdefault(kind, []).append(value)
    for kind, value in labelled(docs, sample):
        found.setdefault(kind if kind in PLAIN else f"{kind} {_alphabet(value)}", []).append(value)
    models = {kind: Automaton(sorted(values), join=kind not in PLAIN) for kind, values in found.items()}
    # a plain run that leaves the automaton of plain runs is still made of their letters
    return models | {f"{kind} letters": Letters(found[kind]) for kind in PLAIN if kind in found}


def given_labels(given: DataFrame, sample: int) -> list[tuple[str, str]]:
    """(kind, value) of a caller's labelled credentials: the `sample` distinct ones of least hash of each kind; null and longest ones are left out."""
    known = given.select(F.concat(F.lit("given "), F.col("kind").cast("string")).alias("kind"), F.col("value").cast("string").alias("value")).filter((F.length("value") > 0) & (F.length("value") <= LONGEST_SAMPLE) & F.col("kind").isNotNull()).distinct()
    at = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("value"), "value"))
    return [(r.kind, r.value) for r in known.withColumn("at", at).filter(F.col("at") <= sample).orderBy("kind", "at").collect()]


def likelihoods(words: list[str], automata: dict[str, Automaton | Letters]) -> np.ndarray:
    """By how many nats a character the best automaton of credentials beats that of plain runs; -inf without any."""
    length = np.array([len(x) for x in words], np.float64)
    score = {kind: a.scores(words) for kind, a in automata.items()}
    is_plain = lambda kind: kind.split(" ")[0] in PLAIN
    plain = [x for kind, x in score.items() if is_plain(kind)] or [-4.5 * length]
    secret = [x for kind, x in score.items() if not is_plain(kind)] or [np.full(len(words), -np.inf)]
    return (np.max(secret, axis=0) - np.max(plain, axis=0)) / length


def find_secrets(docs: DataFrame, sample: int = 1500, margin: float = 0.5, given: DataFrame | None = None) -> DataFrame:
    """One row for each document: (doc_id, spans), spans an array of (start, end, kind, score) by start, then kind.

    given: labelled credentials (kind, value) besides those that the patterns find, of which the `sample` least by hash of each kind count;
    unset: examples().

    Positions are code points, ends exclusive. A pattern's span has the score of its credential and stays whatever it is.
    Cases: a null or empty text has no spans; equal texts have equal spans; texts and runs of any length are scored whole; kinds may overlap each other; without any
    labelled credential only the patterns count; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    more = examples() if given is None else given_labels(given, sample)
    given = spark.sparkContext.broadcast(learn(own, sample, more))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))

    def scan(batches):
        automata, known = given.value, {}

        def score(words) -> list[float]:
            new = list({x: None for x in words if x not in known})
            if new:
                known.update(zip(new, likelihoods(new, automata).tolist(), strict=True))
            return [known[x] for x in words]

        for batch in slices(batches, "text"):
            if len(known) > 400_000:
                known.clear()
            column = texts(batch)
            out: list[list[dict]] = [[] for _ in range(len(column))]
            marked = {row: base for row, _, base in _marked(column)}
            row, codes, names = _runs(column)
            likely = np.array(score(names)) > margin
            spans: list[tuple] = []  # (row, start, end, kind, string) of all that is scored
            for k in sorted({*marked, *row[likely[codes]].tolist()}):
                base, text = marked.get(k, []), column[k].as_py()
                spans += [(k, a, b, name, value) for a, b, name, value in base]
                spans += [(k, a, b, "format", text[a:b]) for a, b in candidates(text, base)]
            scored = zip(spans, score([x[4] for x in spans]), strict=True)
            for (k, a, b, name, _), x in sorted(scored, key=lambda x: (x[0][:2], KINDS.index(x[0][3]))):
                if name != "format" or x > margin:
                    out[k].append({"start": a, "end": b, "kind": name, "score": x})
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "spans": pa.array(out, kind)})

    return own.mapInArrow(scan, f"doc_id long, spans {SPANS}")


def secret_digest(docs: DataFrame, sample: int = 1500) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of find_secrets()."""
    found = find_secrets(docs, sample)
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"] != "format")
    many = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", many("assign"), many("access"), many("hex"), F.sha2(F.array_join(F.transform(base, line), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans"), many("format"))
