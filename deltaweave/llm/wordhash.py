"""Words of whole texts as 64-bit hashes, and rolling hashes over them, as whole-array operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def words_of(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Runs of characters other than ASCII white space, of all texts in turn, and the count of each text; null counts as empty.

    ``lower`` turns A-Z (and nothing else) to lower case.
    """
    texts = pc.fill_null(texts, "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words = pc.list_flatten(split)
    full = np.asarray(pc.binary_length(words), np.int64) > 0
    counts = np.asarray(pc.list_value_length(split), np.int64)
    of = np.repeat(np.arange(len(texts)), counts)
    return words.filter(pa.array(full)), np.bincount(of[full], minlength=len(texts)).astype(np.int64)


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    names = coded.dictionary.cast(pa.binary()).to_pylist()
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    return table[np.asarray(coded.indices, np.int64)]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * _ODD[0]
    h = h ^ (h >> np.uint64(32))
    h = h * _ODD[1]
    return h ^ (h >> np.uint64(29))


def rolling(words: np.ndarray, width: int, kind: int = 0) -> np.ndarray:
    """A hash of the ``width`` words from each position on; positions without so many words are left out."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, width):
        out *= _ODD[kind]
        out += words[i : i + n]
    return mix(out)


def inside(counts: np.ndarray, width: int) -> np.ndarray:
    """Positions (in all texts' words) from which ``width`` words of one text follow."""
    starts = np.cumsum(counts) - counts
    many = np.maximum(counts - width + 1, 0)
    before = np.cumsum(many) - many
    return np.repeat(starts - before, many) + np.arange(int(many.sum()))
