"""Words of texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from vantage.llm.arrays import U64, list_parts


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many words each text has, and the hashes of all words in a row.

    A word is a run of letters, digits and combining marks, lower-cased.
    """
    plain = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\p{L}\p{N}\p{M}]+", " ")
    per_text, words = list_parts(pc.ascii_split_whitespace(pc.ascii_trim(plain, characters=" ")))
    if not len(words):
        return np.zeros(len(texts), np.int64), np.zeros(0, U64)
    coded = words.dictionary_encode()
    names = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names), U64, len(names))
    codes = coded.indices.to_numpy(zero_copy_only=False)
    if b"" in names:  # a text without words splits into one empty piece
        real = codes != names.index(b"")
        row = np.repeat(np.arange(len(per_text)), per_text)[real]
        per_text, codes = np.bincount(row, minlength=len(per_text)), codes[real]
    return per_text, hashes[codes]
