"""Piece ids of whole texts by merge-type encoding with backtracking, and the way back.

A merge-type encoder joins the best-scored neighbours again and again. Its result is the one row of tokens in which each
token is what merging gives for its own letters, and each two neighbours are what merging gives for the letters of both.
So a chunk is encoded from left to right with the longest vocabulary match at each place (an Aho-Corasick automaton finds
all matches in one pass); a token is taken only if its letters and those of the token before it merge again to the same two
tokens; if that fails for all matches of a place, the place is marked in a bitfield and the token before it gives way to
its next shorter match. Each place fails once at most, so the time is in proportion to the length.

No vocabulary piece continues with a space mark after another letter, so chunks that begin with space marks are encoded
alone, each different one once in a worker while it is among the last `limit` to twice `limit` different ones.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from itertools import chain, groupby

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from vantage.llm.arrays import list_parts, slices, starts
from vantage.runtime import unused

SPACE = "▁"
NEVER = float("-inf")


class PieceEncoder:
    """Encodes chunks with the vocabulary and scores of a model file; `limit` bounds the chunks and pairs that are kept."""

    def __init__(self, file: str, limit: int = 320_000):
        self.library = model = sentencepiece.SentencePieceProcessor(model_file=file)
        plain = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
        self.id = {model.id_to_piece(k): k for k in plain}
        self.score = {model.id_to_piece(k): model.get_score(k) for k in plain}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = all(model.is_byte(k) for k in self.bytes)
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.id))
        self.chunk = re.compile(self._chunks())
        self.limit = limit
        self.built: dict[str, list[tuple[float, str, str]] | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.known_before = self.known
        tokens = {x for x in self.id if self.merges(x)}
        self.shorter = {x: next((x[:k] for k in range(len(x) - 1, 0, -1) if x[:k] in tokens), x[0]) for x in tokens if len(x) > 1}
        self.automaton = ahocorasick.Automaton()
        for x in tokens:
            self.automaton.add_word(x, x)
        self.automaton.make_automaton()

    def _chunks(self) -> str:
        """A pattern of chunks that no piece reaches across: space marks and the letters of longer pieces, cut before a mark that
        no piece holds after a letter; and runs of all other letters."""
        longer = [x for x in self.id if len(x) > 1]
        if any(SPACE in x.lstrip(SPACE) for x in longer):
            return "(?s:.+)"
        every = {c for x in longer for c in x} - {SPACE}
        marks = "".join(c for c in ".,;:!?" if not any(a.isalpha() and b == c for x in longer for a, b in zip(x, x[1:], strict=False)))
        letters, alpha = (re.escape("".join(sorted(c for c in every if c.isalpha() or not only))) for only in (False, True))
        rest = f"{SPACE}*[{letters}]+|{SPACE}+|[^{letters}{SPACE}]+"
        return f"{SPACE}*[{alpha}]+(?=[{marks}])|{rest}" if marks else rest

    def merges(self, token: str) -> list[tuple[float, str, str]] | None:
        """How merging builds a token from its letters: after each step its score, the first part and the last part.

        The best-scored neighbours join first, the leftmost of equals. None if that does not end with the token; a last step
        of score minus infinity ends the list.
        """
        if token not in self.built:
            parts, steps, score = list(token), [], self.score
            while len(parts) > 1:
                found = [score.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
                best = max(found)
                if best == NEVER:
                    break
                k = found.index(best)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
                steps.append((best, parts[0], parts[-1]))
            self.built[token] = [*steps, (NEVER, token, token)] if len(parts) == 1 else None
        return self.built[token]

    def fits(self, left: str, right: str) -> bool:
        """Whether merging gives both tokens again for the letters of both: their steps are replayed in the order of the scores,
        until the parts on both sides of the border would join first, or no step is left.
        """
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.limit:
                self.pairs.clear()
            known = self.pairs[key] = self._replay(left, right)
        return known

    def _replay(self, left: str, right: str) -> bool:
        score, a, b = self.score, iter(self.merges(left)), iter(self.merges(right))
        last, first = left[-1], right[0]
        (next_left, _, grown), (next_right, begun, _) = next(a), next(b)
        while True:
            across = score.get(last + first, NEVER)
            if across > next_left and across >= next_right:
                return False
            if next_left == next_right == NEVER:
                return True
            if next_left >= next_right:
                last = grown
                next_left, _, grown = next(a)
            else:
                first = begun
                next_right, begun, _ = next(b)

    def longest_at(self, text: str, at: int) -> str:
        """The longest token at a place; a letter that no token begins with stands alone."""
        end, token = next(self.automaton.iter_long(text[at : at + self.longest]), (0, ""))
        return token if token and end + 1 == len(token) else text[at]

    def tokens(self, text: str) -> list[str]:
        """The tokens of a chunk of any length."""
        out, at = [], 0
        for end, token in self.automaton.iter_long(text):
            if end + 1 - len(token) > at:
                out.extend(text[at : end + 1 - len(token)])
            out.append(token)
            at = end + 1
        out.extend(text[at:])
        pairs, fits = self.pairs, self.fits
        for k in range(1, len(out)):
            known = pairs.get((out[k - 1], out[k]))
            if not (fits(out[k - 1], out[k]) if known is None else known):
                return self._backtrack(text, out[:k])
        return out

    def _backtrack(self, text: str, out: list[str]) -> list[str]:
        """Go on from tokens that fit each other, where the longest match next to them does not."""
        at, end, shorter = sum(map(len, out)), len(text), self.shorter
        failed = bytearray(end // 8 + 1)
        token = self.longest_at(text, at)
        while at < end:
            while token is not None:
                to = at + len(token)
                if not failed[to >> 3] >> (to & 7) & 1 and (not out or self.fits(out[-1], token)):
                    break
                token = shorter.get(token)
            if token is not None:
                out.append(token)
                at = to
                token = self.longest_at(text, at) if at < end else None
                continue
            failed[at >> 3] |= 1 << (at & 7)
            if not out:
                raise ValueError("no row of tokens fits this vocabulary")
            before = out.pop()  # gives way to its next shorter match
            at -= len(before)
            token = shorter.get(before)
        return out

    def ids(self, tokens: list[str]) -> list[int]:
        """Ids of tokens; a letter that the vocabulary lacks gives its bytes' ids, or one unknown id for a run of them."""
        found = self.id
        try:
            return [found[x] for x in tokens]
        except KeyError:
            if self.fallback:
                return list(chain.from_iterable([found[x]] if x in found else (self.bytes[b] for b in x.encode()) for x in tokens))
            return list(chain.from_iterable([self.unknown] if lost else (found[x] for x in run) for lost, run in groupby(tokens, lambda x: x not in found)))

    def _learn(self, chunk: str) -> bytes:
        found = self.known_before.get(chunk) or array("i", self.ids(self.tokens(chunk))).tobytes()
        if len(chunk) <= 64:
            if len(self.known) >= self.limit:
                self.known_before, self.known = self.known, {}
            self.known[chunk] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, without an end id."""
        known, learn = self.known.get, self._learn  # a text that starts a new generation goes on with the old one
        return np.frombuffer(b"".join([known(x) or learn(x) for x in self.chunk.findall(self.library.normalize(text))]), np.int32)


@lru_cache(2)
def encoder(file: str) -> PieceEncoder:
    """One encoder a worker process and file."""
    return PieceEncoder(file)


def encode_pieces(docs: DataFrame, file: str, end_id: int | None = 2, column: str = "text", ids: str = "ids") -> DataFrame:
    """docs with an array of the piece ids of each whole text in place of the text, end_id last if there is one.

    Cases: a null or empty text holds the end id alone; texts of any length are taken whole, in memory of their own length; repeated rows
    and texts that tie give rows of equal ids; an empty table gives no rows; other columns stay as they are, and where one is
    called like `ids` already, that name with underscores before it is taken.
    """
    name = unused(docs.drop(column), ids)
    schema = StructType([f for f in docs.schema if f.name != column]).add(name, ArrayType(IntegerType(), False), False)
    end = np.array([] if end_id is None else [end_id], np.int32)

    def run(batches):
        coder = encoder(file)
        for batch in slices(batches, column):
            found = [coder.encode(x or "") for x in batch.column(column).to_pylist()]
            n = np.fromiter(map(len, found), np.int64, len(found)) + len(end)
            flat = np.concatenate([x for ids in found for x in (ids, end)])
            lists = pa.ListArray.from_arrays(pa.array(starts(n), pa.int32()), pa.array(flat))
            rest = [k for k in batch.schema.names if k != column]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), lists], [*rest, name])

    return docs.mapInArrow(run, schema)


def decode_pieces(rows: DataFrame, file: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with the text of each array of ids after it, as the model's library decodes it.

    Cases: a null or empty array gives an empty text; control ids give no letters, bytes that are no UTF-8 the replacement letter; an
    empty table gives no rows; other columns stay, `text` gets underscores before it where that name is taken.
    """
    name = unused(rows, text)
    schema = StructType([*rows.schema]).add(name, StringType(), False)

    def run(batches):
        model = encoder(file).library
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
                n, flat = list_parts(part.column(ids).fill_null([]))
                at, flat = starts(n).tolist(), flat.to_numpy()
                found = [model.decode(flat[a:b].tolist()) if b > a else "" for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string())], [*part.schema.names, name])

    return rows.mapInArrow(run, schema)


def piece_digest(docs: DataFrame, file: str, end_id: int | None = 2) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document's ids and of the text that they decode to."""
    rows = decode_pieces(encode_pieces(docs.select("doc_id", "text"), file, end_id), file)
    numbers = F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(numbers, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
