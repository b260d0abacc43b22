"""Token ids of many texts by a public tokenizer of the word kind: one library call for each distinct piece.

White space separates words for this tokenizer whatever stands around it, and within a word its letters form one
piece and the punctuation before and after them one piece each. So a text's ids are the ids of its pieces in a row.
Pieces of Latin letters and ASCII punctuation are looked up one by one; any other word goes to the library whole. A piece
of lower-case letters needs no normalizing or splitting, so the library's model merges it at once.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vantage.llm.arrays import gather, list_parts, starts

_PUNCT = r"[!-&(-/:;=>?@\[-`{}~]"
_WORD = rf"^(?P<lead>{_PUNCT}*)(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>{_PUNCT}*)$"
_PLAIN = "^[a-zß-öø-ÿ]+$"
_SPECIAL = r"<\|(startoftext|endoftext)\|>"
# the library's spelling of the UTF-8 bytes of the letters above: bytes that print stand for themselves, the others follow from U+0100 on
_PRINT = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE = {b: chr(b) for b in _PRINT} | {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINT)}
_AS_BYTES = {c: "".join(_BYTE[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}


class WordTokenizer:
    """Encodes Arrow text arrays; keeps the ids of up to `limit` distinct pieces."""

    def __init__(self, file: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.data = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    def _keep(self, pieces: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        n, at = len(pieces), len(self.known)
        while self.used + len(ids) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        while at + n > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.data[self.used : self.used + len(ids)] = ids
        self.start[at : at + n] = self.used + starts(lengths)[:-1]
        self.length[at : at + n] = lengths
        self.used += len(ids)
        for k, piece in enumerate(pieces, at):
            self.known[piece] = k

    def _learn(self, pieces: list[str]) -> None:
        plain = pc.match_substring_regex(pa.array(pieces, pa.large_string()), _PLAIN).to_numpy(zero_copy_only=False)
        words = [p for p, x in zip(pieces, plain, strict=True) if x]
        rest = [p for p, x in zip(pieces, plain, strict=True) if not x]
        merge = self.library.model.tokenize
        coded = [[t.id for t in merge(w if w.isascii() else w.translate(_AS_BYTES))] for w in words]
        coded += [x.ids for x in self.library.encode_batch(rest, add_special_tokens=False)] if rest else []
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        self._keep(words + rest, lengths, np.fromiter(chain.from_iterable(coded), np.uint32, int(lengths.sum())))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text, and all ids in a row."""
        per_text, flat = list_parts(pc.ascii_split_whitespace(texts))
        if not len(flat):
            return np.zeros(len(texts), np.int64), np.zeros(0, np.uint32)
        coded = flat.dictionary_encode()
        chunks = coded.dictionary
        parts = pc.extract_regex(chunks, _WORD)
        fits = pc.and_not(pc.is_valid(parts), pc.match_substring_regex(chunks, _SPECIAL))
        word = pc.if_else(fits, pc.utf8_lower(parts.field("word")), chunks)
        lead, tail = (pc.if_else(fits, parts.field(x), "") for x in ("lead", "tail"))
        pieces = pa.concat_arrays([lead, word, tail]).dictionary_encode()
        names = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) + len(names) > self.limit:
            self._clear()
        missing = [x for x in names if x not in self.known]
        if missing:
            self._learn(missing)
        known = self.known
        place = np.fromiter((known[x] for x in names), np.int64, len(names))
        order = place[pieces.indices.to_numpy()].reshape(3, -1).T.ravel()
        data, n = gather(self.data, self.start, self.length, order)
        n = n.reshape(-1, 3).sum(1)
        ids, each = gather(data, starts(n)[:-1], n, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
        return np.diff(starts(each)[starts(per_text)]), ids


_LOADED: dict[str, WordTokenizer] = {}


def tokenizer(file: str) -> WordTokenizer:
    """One tokenizer a worker process and file."""
    if file not in _LOADED:
        _LOADED[file] = WordTokenizer(file)
    return _LOADED[file]
