"""Token ids of many texts by a word-level tokenizer, each distinct word encoded once."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from reportloom.llm.common import words_of

DEFAULT = "word_bpe_49k.json"
# Marks behind a Latin letter at the end of a word are tokens of their own, so the word is looked up
# without them. The capital I with a dot is left out: in lower case it ends in a mark itself.
TAIL = r"([a-z0-9À-ÖØ-öø-įı-ɏ])([.,;:!?#$%&*)]+[ \n])"
CACHE_WORDS = 400_000
BLOCK_WORDS = 2000


def tokenizer_path(path: str | None = None) -> str:
    """``path``, or the default file of the installed vocabularies."""
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


class WordTokenizer:
    """Ids of whole texts, equal to the library's ``encode(text, add_special_tokens=False)``.

    Fit for tokenizers that split at white space, drop it and mark the end of every word
    (``</w>``). Distinct words are encoded once and kept while there are
    at most CACHE_WORDS of them; words of letters are encoded many at a time and told apart
    by the mark of their last token. ``plain_specials`` treats the names of special
    tokens as ordinary text.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = plain_specials
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.last[i] = token.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _encode(self, words: list[str], alone: bool) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of every word."""
        if alone:
            ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), np.array([len(i) for i in ids], np.int64)
        flats, sizes = [], []
        blocks = [words[i:i + BLOCK_WORDS] for i in range(0, len(words), BLOCK_WORDS)]
        for block, found in zip(blocks, self.tokenizer.encode_batch_fast([" ".join(b) for b in blocks], add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(self.last[ids])
            if len(ends) == len(block) and (not len(ids) or ends[-1] == len(ids) - 1):
                flats.append(ids)
                sizes.append(np.diff(ends, prepend=-1))
            else:  # a word of several parts: tell them apart one by one
                ids, size = self._encode(block, True)
                flats.append(ids)
                sizes.append(size)
        if not flats:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate(flats), np.concatenate(sizes)

    def _learn(self, vocabulary: pa.Array, listed: list[str]) -> None:
        missing = [w not in self.slots for w in listed]
        new = vocabulary.filter(pa.array(missing, pa.bool_()))
        letters = pc.utf8_is_alpha(new)
        flats, sizes, slots = [self.flat], [self.sizes], self.slots
        for part, alone in ((new.filter(letters).to_pylist(), False), (new.filter(pc.invert(letters)).to_pylist(), True)):
            ids, size = self._encode(part, alone)
            base = len(slots)
            slots.update(zip(part, range(base, base + len(part))))
            flats.append(ids)
            sizes.append(size)
        self.flat, self.sizes = np.concatenate(flats), np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of every text."""
        lower = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), TAIL, r"\1 \2")
        owner, vocabulary, codes = words_of(lower)
        if len(self.slots) > CACHE_WORDS:
            self._clear()
        listed = vocabulary.to_pylist()
        self._learn(vocabulary, listed)
        slot = np.fromiter((self.slots[w] for w in listed), np.int64, len(listed))[codes]
        size = self.sizes[slot]
        total = int(size.sum())
        places = np.repeat(self.starts[slot] - (np.cumsum(size) - size), size) + np.arange(total)
        counts = np.bincount(owner, weights=size, minlength=len(texts)).astype(np.int64)
        return self.flat[places], counts


_LOADED: dict[tuple, WordTokenizer] = {}


def word_tokenizer(path: str, plain_specials: bool = False) -> WordTokenizer:
    """The tokenizer of this Python worker; later tasks find it loaded, with the words that it knows."""
    key = (path, plain_specials)
    if key not in _LOADED:
        _LOADED[key] = WordTokenizer(path, plain_specials)
    return _LOADED[key]
