"""Byte-level BPE encoding and decoding by a pair occurrence index.

All new pre-tokens of a batch are one array of symbols. An index maps each pair of
neighbours to its places; active ranks are applied in ascending order, each to all
of its places at once, and the lists of the pairs around a merge are updated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from reportloom.llm.common import text_slices

DEFAULT = "byte_bpe_50k.json"
# Fixed value: the pattern that splits a text before merges, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_UNITS = 500_000
MARKS = frozenset(".,;:!?")


def tokenizer_path(path: str | None = None) -> str:
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file, and its byte.

    Printable Latin-1 bytes stand for themselves, the others for the letters from 256 on.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PairIndexBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocabulary = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.byte_ids = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.byte_ids[byte] = vocabulary[letter]
        self.ranks = {(vocabulary[a] << 32) | vocabulary[b]: r for r, (a, b) in enumerate(merges)}
        keys = np.array(sorted(self.ranks), np.int64)
        self.keys, self.key_ranks = keys, np.array([self.ranks[k] for k in keys.tolist()], np.int64)
        self.left = np.array([vocabulary[a] for a, _ in merges], np.int64)
        self.right = np.array([vocabulary[b] for _, b in merges], np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")")
        size = max([*vocabulary.values(), *self.specials.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocabulary.items():
            self.token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.specials.items():
            self.token_bytes[i] = token.encode("utf-8")
        self.pattern = regex.compile(PATTERN)
        self.names = [str(i) for i in range(size)]
        # Per unit: its ids as 32-bit numbers, the same in decimal, and the bytes they decode to.
        self.units: dict[str, tuple[bytes, str, bytes]] = {}
        self.parts: dict[str, list[int]] = {}

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is none."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], -1)

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of every piece; pieces are merged together but never across their borders."""
        sizes = np.array([len(p) for p in pieces], np.int64)
        ids = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(ids)
        if not n:
            return [[] for _ in pieces]
        piece = np.repeat(np.arange(len(pieces)), sizes)
        # Neighbours as a linked list; -1 ends a piece.
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes)[sizes > 0]
        after[ends - 1] = -1
        before[(np.cumsum(sizes) - sizes)[sizes > 0]] = -1
        alive = np.ones(n, bool)
        first = np.flatnonzero(after >= 0)
        places: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Enters the pairs that begin at ``at`` into the index."""
            rank = self._ranks_of(ids[at], ids[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate(([0], cuts))].tolist() if len(rank) else [], np.split(at, cuts)):
                if r not in places:
                    places[r] = []
                    heapq.heappush(active, r)
                places[r].append(part)

        enter(first)
        while active:
            rank = heapq.heappop(active)
            listed = places.pop(rank)
            at = np.sort(np.concatenate(listed)) if len(listed) > 1 else listed[0]
            # Earlier merges may have changed what is at a place.
            at = at[alive[at] & (ids[at] == self.left[rank])]
            at = at[after[at] >= 0]
            at = at[ids[after[at]] == self.right[rank]]
            if len(at) > 1:  # a place may have been entered twice
                at = at[np.concatenate(([True], at[1:] != at[:-1]))]
            if not len(at):
                continue
            if self.left[rank] == self.right[rank] and len(at) > 1:
                # In a run of equal symbols every second pair, from the left, is merged.
                head = np.ones(len(at), bool)
                head[1:] = after[at[:-1]] != at[1:]
                run_start = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            second = after[at]
            third = after[second]
            ids[at] = self.merged[rank]
            alive[second] = False
            after[at] = third
            back = third >= 0
            before[third[back]] = at[back]
            left = before[at]
            enter(np.sort(np.concatenate((left[left >= 0], at[back]))))
        kept, owner = ids[alive], piece[alive]
        cuts = np.cumsum(np.bincount(owner, minlength=len(pieces)))[:-1]
        return [part.tolist() for part in np.split(kept, cuts)]

    def _units_of(self, text: str) -> list[str]:
        """The text in parts that may be split on their own: a cut before a blank and a visible character is safe."""
        parts = text.split(" ")
        units = [parts[0]] if parts[0] else []
        units += [" " + p for p in parts[1:]]
        if "  " in text or text.endswith(" ") or regex.search(r" \s", text) or (units and units[0][:1].isspace()):
            return [u for u in regex.split(r"(?= \S)", text, flags=regex.V1) if u]
        return units

    def _parts_of(self, unit: str) -> list[str]:
        """The unit cut by PATTERN; the two commonest forms need no search."""
        body = unit[1:] if unit[:1] == " " else unit
        if body.isalpha():
            return [unit]
        if body[-1:] in MARKS and body[:-1].isalpha():
            return [unit[:-1], body[-1]]
        return self.pattern.findall(unit)

    def _unit(self, ids: list[int]) -> tuple[bytes, str, bytes]:
        names, coded = self.names, array("I", ids)
        return coded.tobytes(), ",".join([names[i] for i in ids]), self.decode_bytes(ids)

    def learn(self, units: list[str]) -> None:
        """Enters new units."""
        known = self.parts
        split = [self._parts_of(unit) for unit in units]
        new = list({part for parts in split for part in parts if part not in known})
        known.update(zip(new, self.merge_all([p.encode("utf-8") for p in new])))
        for unit, parts in zip(units, split):
            ids = known[parts[0]] if len(parts) == 1 else list(chain.from_iterable([known[p] for p in parts]))
            self.units[unit] = self._unit(ids)

    def decode_bytes(self, ids) -> bytes:
        return b"".join([self.token_bytes[i] for i in ids])

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def prepare(self, texts: list[str]) -> list[list[str]]:
        """Units of every text, all of them learned; special tokens are units of their own."""
        if len(self.units) > CACHE_UNITS:
            self.units, self.parts = {}, {}
        for content, i in self.specials.items():
            self.units[content] = self._unit([i])
        out = []
        for text in texts:
            if any(s in text for s in self.specials):
                units = []
                for part in self.special.split(text):
                    units += [part] if part in self.specials else self._units_of(part)
            else:
                units = self._units_of(text)
            out.append(units)
        known = self.units
        self.learn(list({u for units in out for u in units if u not in known}))
        return out

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        return [array("I", b"".join([self.units[u][0] for u in units])).tolist() for units in self.prepare(texts)]


_LOADED: dict[str, PairIndexBpe] = {}


def pair_index_bpe(path: str) -> PairIndexBpe:
    """The encoder of this Python worker; later tasks find it loaded."""
    if path not in _LOADED:
        _LOADED[path] = PairIndexBpe(path)
    return _LOADED[path]


def _each(documents: DataFrame, make, schema: str) -> DataFrame:
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(make, schema)


def encode_documents(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the ids of the whole text of every document; no text counts as an empty one."""
    path = tokenizer_path(path)

    def run(batches):
        coder = pair_index_bpe(path)
        for batch in batches:
            for start, stop in text_slices(batch.column("text")):
                ids = coder.encode_batch(batch.column("text").slice(start, stop - start).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, stop - start), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"]
                )

    return _each(documents, run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids); no ids give an empty text."""
    path = tokenizer_path(path)

    def run(batches):
        coder = pair_index_bpe(path)
        for batch in batches:
            texts = [coder.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, number of ids, digest of the ids and digest of the text decoded from them.

    Encodes and decodes in one pass, so ids need not leave the worker: the
    digests are fed from the ids and decoded bytes of each unit. Empty or absent texts have
    no ids, repeated rows are encoded alike, an empty table gives an empty result.
    """
    path = tokenizer_path(path)

    def run(batches):
        coder = pair_index_bpe(path)
        for batch in batches:
            for start, stop in text_slices(batch.column("text"), 16 << 20):
                counts, coded, decoded = [], [], []
                for units in coder.prepare(batch.column("text").slice(start, stop - start).to_pylist()):
                    found = [coder.units[u] for u in units]
                    counts.append(sum([len(f[0]) for f in found]) // 4)
                    coded.append(hashlib.sha256(",".join([f[1] for f in found]).encode()).hexdigest())
                    text = b"".join([f[2] for f in found]).decode("utf-8", errors="replace")
                    decoded.append(hashlib.sha256(text.encode("utf-8")).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, stop - start), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return _each(documents, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
