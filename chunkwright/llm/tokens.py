"""Exact token ids of a public BPE vocabulary, with each different piece encoded once per worker.

Where a file's normalizer and pre-tokenizer are those stated in `RULE`, which drop white space and never join across
it, the ids of a text are the ids of its words in order. Words of ASCII letters, digits and signs and the letters
U+00C0 to U+00FF are cut into pieces for a whole column at once, and pieces go straight to the library's BPE model;
all other words (apostrophes, other scripts, special-token strings) go through the whole library pipeline. With any
other file every text goes through that pipeline as a whole.
"""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from chunkwright.llm.common import buffer, ranges, strings

#: Cached pieces per worker; the cache is emptied when a column finds it full, which changes only speed.
CACHE_WORDS = 500_000

#: Kinds of bytes: separators, letters, digits, signs, the lead byte of U+00C0 to U+00FF, and all that only the library cuts.
_SPACE, _LETTER, _DIGIT, _SIGN, _LEAD, _OTHER = range(6)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[33:127] = _SIGN
_KINDS[[10, 32]] = _SPACE
_KINDS[48:58] = _DIGIT
_KINDS[65:91] = _KINDS[97:123] = _LETTER
_KINDS[[ord("'"), ord("<")]] = _OTHER
_KINDS[0xC3] = _LEAD
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# The normalizer and pre-tokenizer of a file whose words can be encoded one by one.
RULE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def vocabulary_path(path: str | None = None) -> str:
    """The tokenizer file: the given one, or the public 49k word vocabulary."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes columns of texts to flat id arrays with row offsets."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = vocabulary_path(path)
        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        self.by_words = spec["model"]["type"] == "BPE" and all(spec[k] == v for k, v in RULE.items()) and spec["truncation"] is None
        if not self.by_words:
            return
        self.model = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []})).model
        self.signs = self._signs()
        self.clear()

    @staticmethod
    def _signs() -> dict[int, str]:
        """The byte-level alphabet: printable bytes stand for themselves, the rest follow from code point 256."""
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts = self.counts = np.zeros(0, np.int64)

    def _add(self, fresh: pa.Array, whole: list[bool]) -> None:
        """Encode pieces that are not known yet; those of `whole` are words for the library."""
        ids, counts = array("I"), np.empty(len(fresh), np.int64)
        tokenize, encode, signs = self.model.tokenize, self.whole.encode, self.signs
        for k, (piece, odd) in enumerate(zip(fresh.to_pylist(), whole, strict=True)):
            if odd:
                own = encode(piece, add_special_tokens=False).ids
            else:
                own = [t.id for t in tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(signs))]
            ids.extend(own)
            counts[k] = len(own)
        end = self.used + len(ids)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(end - len(self.pool), len(self.pool)), np.uint32)])
        self.pool[self.used : end] = np.frombuffer(ids, np.uint32)
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.used = end
        self.known = pa.concat_arrays([self.known, fresh])

    def _encode_whole(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.whole.encode_batch([t or "" for t in col.to_pylist()], add_special_tokens=False)]
        ids = np.concatenate([np.array(f, np.uint32) for f in found]) if found else np.zeros(0, np.uint32)
        return ids, np.concatenate([[0], np.cumsum([len(f) for f in found], dtype=np.int64)])

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, offsets of rows); null is the empty text."""
        if not self.by_words:
            return self._encode_whole(col)
        data, offsets = buffer(col)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        begin, pieces, odd = _pieces(data, offsets)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if len(self.known) > CACHE_WORDS:
            self.clear()
        coded = pieces.dictionary_encode()
        which = coded.indices.to_numpy()
        places = pc.index_in(coded.dictionary, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        new = places < 0
        if new.any():
            places[new] = np.arange(len(self.known), len(self.known) + int(new.sum()))
            whole = np.zeros(len(places), bool)
            whole[which[odd]] = True
            self._add(coded.dictionary.filter(pa.array(new)), whole[new].tolist())
        starts, counts = self.starts[places], self.counts[places]
        counts, starts = counts[which], starts[which]
        ids = self.pool[ranges(starts, counts)]
        before = np.concatenate([[0], np.cumsum(counts)])
        return ids, before[np.searchsorted(begin, offsets, side="left")]


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.StringArray, np.ndarray]:
    """(place of each piece in the buffer, the pieces, which of them are words that only the library cuts).

    Pieces are runs of letters, single digits and runs of signs, in lower case; a word with any other character stays as it is.
    """
    kind, text = _KINDS[data], _LOWER[data]
    lead = np.flatnonzero(kind == _LEAD)
    if len(lead):
        after = np.minimum(lead + 1, len(data) - 1)
        letter = (data[after] != 0x97) & (data[after] != 0xB7)  # the two signs among them
        kind[lead] = np.where(letter, _LETTER, _OTHER)
        kind[after[letter]] = _LETTER
        text[after[letter & (data[after] <= 0x9E)]] += 0x20
    heads = offsets[:-1][np.diff(offsets) > 0]
    new = kind != _SPACE
    keep = new.copy()
    new[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    new[heads] = keep[heads]
    other = np.flatnonzero(kind == _OTHER)
    if len(other):
        edge = ~keep
        edge[heads] = True
        edge = np.append(np.flatnonzero(edge), len(data))
        word = np.unique(np.searchsorted(edge, other, side="right") - 1)
        first, size = edge[word], edge[word + 1] - edge[word]
        size -= ~keep[first]
        first += ~keep[first]
        inside = ranges(first, size)
        text[inside] = data[inside]
        new[inside] = False
        new[first] = True
    begin = np.flatnonzero(new)
    odd = np.searchsorted(begin, first) if len(other) else np.zeros(0, np.int64)
    at = np.cumsum(keep, dtype=np.int32)
    return begin, strings(text[keep], np.append(at[begin] - 1, at[-1])), odd


_coders: dict[tuple, WordEncoder] = {}


def word_encoder(path: str | None = None) -> WordEncoder:
    """The worker's encoder of a file: it stays for later tasks, as reading a vocabulary takes longer than many a task."""
    path = vocabulary_path(path)
    at = os.stat(path)
    key = (path, at.st_mtime_ns, at.st_size)
    if key not in _coders:
        _coders.clear()
        _coders[key] = WordEncoder(path)
    return _coders[key]
