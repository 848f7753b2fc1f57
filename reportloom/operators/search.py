"""All occurrences of many keywords in all texts, by a q-gram index of the keywords."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reportloom.operators.dictionary import number_terms
from reportloom.session import materialize

BLOCK_KEYWORDS = 100_000  # keywords that travel to the tasks at once
SLICE_CHARS = 1 << 21     # characters searched at once; a longer text stands alone
GRAM = 3
BITS = 21                 # of a code point
GAP = (1 << BITS) - 1     # no code point; stands between texts, so no match reaches over


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Every q consecutive code points as one number."""
    n = max(len(codes) - q + 1, 0)
    out = np.zeros(n, np.int64)
    for k in range(q):
        out = (out << BITS) | codes[k:k + n]
    return out


def _ragged(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... inside every group of the given sizes."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


@dataclass
class GramIndex:
    """The keywords of a block by one gram each, the rarest it has among all keywords; shorter keywords are their gram."""

    codes: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    tables: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # q, grams, first entry of each, keywords, offsets

    @classmethod
    def of(cls, keywords: list[str]) -> GramIndex:
        codes = _codes("".join(keywords))
        sizes = np.array([len(k) for k in keywords], np.int64)
        starts = np.cumsum(sizes) - sizes
        tables = []
        for q in range(1, GRAM + 1):
            own = np.flatnonzero(sizes >= GRAM) if q == GRAM else np.flatnonzero(sizes == q)
            if not len(own):
                continue
            many = sizes[own] - q + 1
            offset, owner = _ragged(many), np.repeat(np.arange(len(own)), many)
            grams = _grams(codes, q)[np.repeat(starts[own], many) + offset]
            _, place, often = np.unique(grams, return_inverse=True, return_counts=True)
            best = np.lexsort((offset, often[place], owner))[np.cumsum(many) - many]
            order = best[np.argsort(grams[best], kind="stable")]
            keys, first = np.unique(grams[order], return_index=True)
            tables.append((q, keys, np.append(first, len(order)), own[owner[order]], offset[order]))
        return cls(codes, starts, sizes, tables)

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, keyword) of every occurrence, overlapping ones too."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for q, keys, first, keyword, offset in self.tables:
            grams = _grams(text, q)
            at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            place = np.flatnonzero(keys[at] == grams)
            at = at[place]
            many = first[at + 1] - first[at]
            entry = np.repeat(first[at], many) + _ragged(many)
            start, which = np.repeat(place, many) - offset[entry], keyword[entry]
            inside = (start >= 0) & (start + self.sizes[which] <= len(text))
            start, which, k = start[inside], which[inside], 0
            while len(start):  # compare place by place; what is done is found, what differs is dropped
                done = self.sizes[which] == k
                if done.any():
                    found.append((start[done], which[done]))
                    start, which = start[~done], which[~done]
                same = text[start + k] == self.codes[self.starts[which] + k]
                start, which, k = start[same], which[same], k + 1
        start, which = (np.concatenate(v) for v in zip(*found))
        order = np.lexsort((which, start))
        return start[order], which[order]


def _slices(sizes: list[int]):
    """(from, to) of consecutive texts of about SLICE_CHARS together."""
    start, room = 0, SLICE_CHARS
    for k, size in enumerate(sizes):
        if k > start and size > room:
            yield start, k
            start, room = k, SLICE_CHARS
        room -= size
    if start < len(sizes):
        yield start, len(sizes)


def keyword_blocks(keywords: DataFrame, keyword: str = "keyword", size: int = BLOCK_KEYWORDS) -> tuple[DataFrame, int]:
    """(block, keyword) of the distinct, lower-case, non-empty keywords, and the number of blocks."""
    lowered = keywords.select(F.lower(keyword).alias("keyword")).filter("keyword <> ''")
    numbered = number_terms(lowered, "keyword", "number")
    blocks = materialize(numbered.select(F.floor(F.col("number") / size).alias("block"), "keyword"), "keyword-blocks")
    return blocks, blocks.agg(F.coalesce(F.max("block") + 1, F.lit(0))).first()[0]


def occurrences(
    reports: DataFrame, keywords: DataFrame, text: str = "content", key: str = "record_id", once: bool = False,
    block_keywords: int = BLOCK_KEYWORDS,
) -> DataFrame:
    """``(key, keyword, start, matched)``: every occurrence of every keyword in the lower-case text.

    No word boundaries; overlapping occurrences count; ``start`` counts code points from 0 and ``matched`` is what
    the text itself has there. ``once`` gives the first occurrence of a keyword in a text only. Keywords are searched
    in blocks of bounded size, each of which travels to all texts; an absent text or keyword is nowhere.
    """
    blocks, n = keyword_blocks(keywords, size=block_keywords)
    spark = reports.sparkSession
    rows = reports.select(F.col(key), F.col(text).alias("_text"), F.lower(text).alias("_lower")).filter("_text is not null")
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, keyword string, start int, matched string"
    found = None
    for block in range(n):
        listed = [r.keyword for r in blocks.filter(F.col("block") == block).select("keyword").collect()]  # at most block_keywords
        shared = spark.sparkContext.broadcast((GramIndex.of(listed), listed))

        def run(batches, shared=shared):
            index, listed = shared.value
            for batch in batches:
                lower, own = batch.column("_lower").to_pylist(), batch.column("_text").to_pylist()
                for low, high in _slices([len(t) for t in lower]):
                    sizes = np.array([len(t) + 1 for t in lower[low:high]])
                    edges = np.cumsum(sizes) - sizes
                    codes = _codes("\0".join(lower[low:high]) + "\0")
                    codes[edges + sizes - 1] = GAP
                    start, which = index.search(codes)
                    document = np.searchsorted(edges, start, side="right") - 1
                    start = start - edges[document]
                    if once:
                        _, first = np.unique(document * len(listed) + which, return_index=True)
                        start, which, document = start[first], which[first], document[first]
                    if not len(start):
                        continue
                    document = document + low
                    matched = [own[d][s:s + len(listed[w])] for d, s, w in zip(document.tolist(), start.tolist(), which.tolist())]
                    yield pa.RecordBatch.from_arrays([
                        batch.column(key).take(pa.array(document)), pa.array([listed[w] for w in which.tolist()], pa.string()),
                        pa.array(start.astype(np.int32)), pa.array(matched, pa.string()),
                    ], names=[key, "keyword", "start", "matched"])

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found
