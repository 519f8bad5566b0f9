"""Token ids of whole texts with a BPE tokenizer whose pre-tokens never cross white space.

Since no pre-token crosses ASCII white space, a text's ids are the concatenation of its words' ids.
Words and pre-tokens repeat, so a batch is reduced to its distinct words, those to their distinct
pre-tokens, and only pre-tokens that this worker has not kept go to the tokenizers library, many in
one text.  Splitting, numbering and putting together are whole-array operations.  Texts of any
length are handled alike: nothing is cut.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pre-tokens that one worker keeps at most, and the longest that outlive a thinning, in characters.
CACHE_PIECES, KEEP_PIECE = 700_000, 10
#: Words of these characters are cut into pre-tokens here, all others by the tokenizers library.
PLAIN = r"^[!-~\x{a1}-\x{ac}\x{ae}-\x{12f}\x{131}-\x{17e}]*$"
#: The tokenizer's own pre-token pattern, for lower-cased plain words.
PIECES = r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"
#: The two commonest kinds of words, for which that pattern needs no search: letters, and letters before other signs.
LETTERS, SIGNED = r"^\p{L}+$", r"^(\p{L}+)([^\s\p{L}\p{N}]+)$"


def ragged(starts: np.ndarray, lengths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Concatenation of ``values[s : s + n]`` over all starts and lengths."""
    before = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))]


def spaced(words: pa.StringArray) -> pa.StringArray:
    """Lower-cased plain words with a space after each pre-token (or none after the last)."""
    other = pc.invert(pc.match_substring_regex(words, LETTERS))
    rest = words.filter(other)
    signed = pc.match_substring_regex(rest, SIGNED)
    hard = pc.invert(signed)
    parted = pc.replace_with_mask(rest, signed, pc.replace_substring_regex(rest.filter(signed), SIGNED, r"\1 \2"))
    parted = pc.replace_with_mask(parted, hard, pc.replace_substring_regex(rest.filter(hard), PIECES, r"\1 "))
    return pc.replace_with_mask(words, other, parted)


class Ragged:
    """Runs of values: the value list and each run's start and length."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray):
        self.values, self.lengths = values, lengths
        self.starts = np.cumsum(lengths) - lengths

    def take(self, runs: np.ndarray, of: np.ndarray) -> Ragged:
        """New runs: each is the concatenation of ``of`` of the given runs in turn."""
        lengths = self.lengths[runs]
        values = ragged(self.starts[runs], lengths, self.values)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(of)]
        return Ragged(values, np.diff(ends, prepend=0))


class WordEncoder:
    """Ids of texts; ``path`` is a tokenizers JSON file whose pre-tokens end in ``</w>``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = "|".join(re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values())
        self.fast = Tokenizer.from_file(path)  # for plain lower-case pre-tokens with spaces between
        self.fast.normalizer = None
        self.fast.encode_special_tokens = True
        self.fast.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.pieces: dict[str, bytes] = {}

    def _learn(self, unseen: list[str]) -> list[bytes]:
        """Ids of plain pre-tokens, encoded as texts of many and cut where a pre-token ends."""
        texts = [" ".join(unseen[i : i + 500]) for i in range(0, len(unseen), 500)]
        found = self.fast.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.asarray(x.ids, "<u4") for x in found])
        ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        packed = ids.tobytes()
        assert len(ends) == len(unseen)
        return [packed[at:end] for at, end in zip([0, *ends], ends)]

    def _pieces(self, shown: list[str]) -> Ragged:
        """Ids of distinct pre-tokens."""
        packed = list(map(self.pieces.get, shown))
        at = [i for i, x in enumerate(packed) if x is None and shown[i]]
        if at:
            new = [shown[i] for i in at]
            if len(self.pieces) + len(new) > CACHE_PIECES:
                self.pieces = {p: v for p, v in self.pieces.items() if len(p) <= KEEP_PIECE}
                if len(self.pieces) > CACHE_PIECES // 2:
                    self.pieces = {}
            for i, piece, ids in zip(at, new, self._learn(new)):
                self.pieces[piece] = packed[i] = ids
        packed = [x or b"" for x in packed]
        return Ragged(np.frombuffer(b"".join(packed), "<u4"), np.fromiter(map(len, packed), np.int64, len(packed)) // 4)

    def _words(self, words: pa.StringArray) -> Ragged:
        """Ids of distinct words."""
        plain = np.asarray(pc.match_substring_regex(words, PLAIN))
        if self.special:  # their texts are single ids, which the tokenizers library gives
            plain = plain & ~np.asarray(pc.match_substring_regex(words, self.special))
        cut = pc.ascii_split_whitespace(spaced(pc.utf8_lower(words.filter(pa.array(plain)))))
        many = np.asarray(pc.list_value_length(cut), np.int64)
        numbered = pc.list_flatten(cut).dictionary_encode()
        out = self._pieces(numbered.dictionary.to_pylist()).take(np.asarray(numbered.indices, np.int64), many)
        if plain.all():
            return out
        other = [np.asarray(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(words.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)]
        both = Ragged(np.concatenate([out.values, *other]), np.concatenate([out.lengths, [len(x) for x in other]]).astype(np.int64))
        place = np.empty(len(plain), np.int64)
        place[plain] = np.arange(plain.sum())
        place[~plain] = plain.sum() + np.arange((~plain).sum())
        return both.take(place, np.ones(len(plain), np.int64))

    def encode(self, texts: pa.StringArray) -> Ragged:
        """Ids of each text; null counts as empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        many = np.asarray(pc.list_value_length(split), np.int64)
        numbered = pc.list_flatten(split).dictionary_encode()
        return self._words(numbered.dictionary).take(np.asarray(numbered.indices, np.int64), many)

    def packed(self, texts: pa.StringArray) -> list[memoryview]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        found = self.encode(texts)
        view = memoryview(found.values.astype("<u4").tobytes())
        return [view[4 * a : 4 * (a + n)] for a, n in zip(found.starts.tolist(), found.lengths.tolist())]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for ``path``."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def slices(batches: Iterable[pa.RecordBatch], texts: str = "text", most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of batches with about ``most`` bytes of text each, for bounded memory."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(texts))
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
        edges = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
        last = 0
        for edge in [*edges.tolist(), batch.num_rows]:
            if edge > last:
                yield batch.slice(last, edge - last)
            last = edge
