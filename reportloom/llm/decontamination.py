"""Benchmark decontamination with a distributed positional inverted index.

The training corpus becomes index segments: for every term of some megabytes of whole documents the
sorted positions of its tokens. Windows of benchmark words are looked up by
intersecting offset-adjusted position lists from the rarest term on; what
stays are exact phrases, and on the way places where all terms lie near each other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from reportloom.llm.common import text_slices, words_of
from reportloom.session import large_rows, materialize

WINDOW = 10
REACH = 20  # words on either side of the rarest term that count as near
BLOCK_WORDS = 200_000  # benchmark words that travel to the tasks at once
SLICE = 4 << 20  # bytes of text in a segment; a longer text is one by itself
ROW_GROUP = 16 << 20  # bytes of segments that a writer holds at once
SEGMENT = "segment long, doc_id array<long>, n_words array<long>, terms array<string>, counts binary, positions binary"
BLOCK = "block long, items array<string>, n_words array<int>, terms array<string>, codes binary"
MATCH = "segment long, doc_no int, item string, kind string, start long, stop long"

# Separators become blanks, capitals small letters; every other byte stands for itself.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def folded(texts: pa.Array) -> pa.Array:
    """The texts with capitals A-Z made small and every other ASCII byte but digits and letters a blank."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return texts
    edges = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1]
    raw = _FOLD[np.frombuffer(data, np.uint8)[edges[0]:edges[-1]]]
    return type(texts).from_buffers(len(texts), pa.py_buffer(edges - edges[0]), pa.py_buffer(raw))


def _one(values) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def _texts(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.select(key.alias(name), F.coalesce("text", F.lit("")).alias("text"))


def build_index(documents: DataFrame) -> DataFrame:
    """Segments of the positional index over all tokens, written to the shared folder.

    A segment holds whole documents: their ids and word counts, the terms, and for every term
    its positions, counted through the segment. A term belongs to every segment that has
    it, so frequent terms are lists of many segments and of no single task.
    """
    def run(batches):
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start, stop in text_slices(batch.column("text"), SLICE):
                own = batch.slice(start, stop - start)
                owner, terms, codes = words_of(folded(own.column("text")))
                keys = np.sort((codes << 32) | np.arange(len(codes)))
                counts = np.bincount(codes, minlength=len(terms))
                yield pa.RecordBatch.from_arrays([
                    pa.array([at], pa.int64()), _one(own.column("doc_id")), _one(pa.array(np.bincount(owner, minlength=own.num_rows))),
                    _one(terms.cast(pa.string())), pa.array([counts.astype("<u4").tobytes()], pa.binary()),
                    pa.array([(keys & 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary()),
                ], names=_names(SEGMENT))
                at += 1

    texts = _texts(documents, F.col("doc_id").cast("long"), "doc_id")
    with large_rows(documents.sparkSession, 256):
        return materialize(texts.mapInArrow(run, SEGMENT), "positional-index", **{"parquet.block.size": str(ROW_GROUP)})


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The words of all items in blocks of bounded size, written to the shared folder.

    An item longer than a block is cut with an overlap, so that no window is lost.
    """
    def run(batches):
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            owner, terms, codes = words_of(folded(batch.column("text")))
            edges = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            parts, size, blocks = [], 0, []
            for k in np.flatnonzero(np.diff(edges)):
                low, end = int(edges[k]), int(edges[k + 1])
                while True:
                    high = min(end, low + block_words)
                    if parts and size + high - low > block_words:
                        blocks.append(parts)
                        parts, size = [], 0
                    parts.append((int(k), low, high))
                    size += high - low
                    if high == end:
                        break
                    low = high - WINDOW + 1
            for parts in [*blocks, parts] if parts else []:
                words = np.concatenate([codes[i:j] for _, i, j in parts])
                used, places = np.unique(words, return_inverse=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([at], pa.int64()), _one(batch.column("item").take(pa.array([k for k, _, _ in parts]))),
                    _one(pa.array([j - i for _, i, j in parts], pa.int32())), _one(terms.take(pa.array(used)).cast(pa.string())),
                    pa.array([places.astype("<u4").tobytes()], pa.binary()),
                ], names=_names(BLOCK))
                at += 1

    texts = _texts(benchmark, F.coalesce(F.col("item_id").cast("string"), F.lit("")), "item")
    return materialize(texts.mapInArrow(run, BLOCK), "benchmark-blocks")


@dataclass
class Windows:
    """Windows of equal length: the term of every place, and the item each comes from."""

    terms: np.ndarray
    items: np.ndarray


def windows_of(codes: np.ndarray, sizes: np.ndarray, length: int = WINDOW) -> list[Windows]:
    """All windows by length: ``length`` consecutive words of an item, or the whole of a shorter one."""
    starts = np.cumsum(sizes) - sizes
    out = []
    for n in np.unique(np.minimum(sizes, length)):
        items = np.flatnonzero(sizes >= length) if n == length else np.flatnonzero(sizes == n)
        many = sizes[items] - n + 1
        places = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(starts[items], many)
        out.append(Windows(codes[places[:, None] + np.arange(n)], np.repeat(items, many)))
    return out


@dataclass
class Segment:
    """One segment of the index in memory."""

    edges: np.ndarray    # where the words of each document begin, with the end of the last
    terms: pa.Array
    counts: np.ndarray
    positions: np.ndarray

    def places_of(self, terms: pa.Array) -> np.ndarray:
        """The segment's number of every term, -1 for those it does not have."""
        found = pc.index_in(terms, value_set=self.terms)
        return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def lists(self) -> np.ndarray:
        """All position lists as one sorted array: term times the size of the segment, plus position."""
        return np.repeat(np.arange(len(self.counts)) * self.size, self.counts) + self.positions

    @property
    def size(self) -> int:
        return int(self.edges[-1])


def look_up(segment: Segment, windows: Windows, known: np.ndarray, lists: np.ndarray | None, reach: int = REACH):
    """((window, place) near matches, (window, start) phrases) of windows of one length in one segment.

    ``known`` gives the segment's number of each term. A place is a token of the window's rarest term that has all
    other terms within ``reach`` words in its document; a phrase starts where every list, moved by
    the offset of its term, has the same position.
    """
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not segment.size or not len(windows.terms):
        return none, none
    terms = known[windows.terms]
    often = np.where(terms >= 0, segment.counts[terms], 0)
    alive = np.flatnonzero(often.min(axis=1) > 0)  # a window with an absent term is nowhere
    if not len(alive):
        return none, none
    lists = segment.lists() if lists is None else lists
    order = np.argsort(often[alive], axis=1, kind="stable")
    terms, size, n = np.take_along_axis(terms[alive], order, 1), segment.size, terms.shape[1]
    first = np.concatenate([[0], np.cumsum(segment.counts)])
    many = segment.counts[terms[:, 0]].astype(np.int64)
    which = np.repeat(np.arange(len(alive)), many)
    place = segment.positions[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[terms[:, 0]], many)].astype(np.int64)

    def nearest(low: np.ndarray, term: np.ndarray) -> np.ndarray:
        """The first position from ``low`` on in the term's list; the size of the segment if there is none."""
        at = np.searchsorted(lists, term * size + low)
        found = lists[np.minimum(at, len(lists) - 1)] - term * size
        return np.where((at < len(lists)) & (found >= low) & (found < size), found, size)

    for k in range(1, n):
        document = np.searchsorted(segment.edges, place, side="right") - 1
        low, high = np.maximum(place - reach, segment.edges[document]), np.minimum(place + reach, segment.edges[document + 1] - 1)
        stays = nearest(low, terms[which, k]) <= high
        which, place = which[stays], place[stays]
    near = (alive[which], place)
    start = place - order[which, 0]
    document = np.searchsorted(segment.edges, place, side="right") - 1
    inside = (start >= segment.edges[document]) & (start + n <= segment.edges[document + 1])
    which, start = which[inside], start[inside]
    for k in range(1, n):
        wanted = start + order[which, k]
        stays = nearest(wanted, terms[which, k]) == wanted
        which, start = which[stays], start[stays]
    return near, (alive[which], start)


def _merged(segment: Segment, item: np.ndarray, low: np.ndarray, high: np.ndarray):
    """(document, item, start, stop) of overlapping spans of an item joined, places counted in the document."""
    order = np.lexsort((low, item))
    item, low, high = item[order], low[order], high[order]
    document = np.searchsorted(segment.edges, low, side="right") - 1
    if not len(item):
        return document, item, low, high
    # Spans of one length and order: the largest end so far is the last one.
    opens = np.ones(len(item), bool)
    opens[1:] = (item[1:] != item[:-1]) | (document[1:] != document[:-1]) | (low[1:] > high[:-1])
    at = np.flatnonzero(opens)
    start, stop = low[at], high[np.append(at[1:], len(item)) - 1]
    return document[at], item[at], start - segment.edges[document[at]], stop - segment.edges[document[at]]


def find_matches(index: DataFrame, blocks: DataFrame, reach: int = REACH) -> DataFrame:
    """Phrases and near places of all benchmark windows: MATCH rows, places counted in words of the document.

    Blocks are the stated query set: each travels to all segments by itself, bounded by BLOCK_WORDS. Windows of an item that
    overlap in a document are one span. Kind is ``phrase`` or ``near``; a phrase is near as well.
    """
    context = index.sparkSession.sparkContext
    found = None
    for row in blocks.select("block").orderBy("block").collect():  # one number per block
        block = blocks.filter(F.col("block") == row.block).first()
        shared = context.broadcast((block["items"], np.array(block["n_words"], np.int64), block["terms"], np.frombuffer(block["codes"], "<u4")))

        def run(batches, shared=shared):
            items, sizes, terms, codes = shared.value
            groups, wanted = windows_of(codes, sizes), pa.array(terms, pa.string())
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1)
                    words = row.column("n_words").flatten().to_numpy(zero_copy_only=False)
                    segment = Segment(
                        np.concatenate([[0], np.cumsum(words)]).astype(np.int64), row.column("terms").flatten(),
                        np.frombuffer(row.column("counts")[0].as_py(), "<u4").astype(np.int64),
                        np.frombuffer(row.column("positions")[0].as_py(), "<u4"),
                    )
                    known, lists = segment.places_of(wanted), None
                    out = []
                    for group in groups:
                        if lists is None and len(group.terms) and (known[group.terms].min(axis=1) >= 0).any():
                            lists = segment.lists()
                        near, phrases = look_up(segment, group, known, lists, reach)
                        at = np.searchsorted(segment.edges, near[1], side="right") - 1
                        low, high = np.maximum(near[1] - reach, segment.edges[at]), np.minimum(near[1] + reach + 1, segment.edges[at + 1])
                        out.append(("near", _merged(segment, group.items[near[0]], low, high)))
                        n = group.terms.shape[1]
                        out.append(("phrase", _merged(segment, group.items[phrases[0]], phrases[1], phrases[1] + n)))
                    for kind, (document, item, start, stop) in out:
                        if len(item):
                            yield pa.RecordBatch.from_arrays([
                                pa.array(np.full(len(item), row.column("segment")[0].as_py())), pa.array(document.astype(np.int32)),
                                pa.array([items[i] for i in item], pa.string()), pa.array([kind] * len(item), pa.string()),
                                pa.array(start), pa.array(stop),
                            ], names=_names(MATCH))

        part = index.drop("doc_id").mapInArrow(run, MATCH)
        found = part if found is None else found.unionByName(part)
    return index.sparkSession.createDataFrame([], MATCH) if found is None else found


def _covered(spans: Column) -> Column:
    """Words in the union of sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        spans, start,
        lambda s, x: F.struct(
            F.greatest(s["reach"], x["stop"]).alias("reach"),
            (s["n"] + F.greatest(x["stop"] - F.greatest(x["start"], s["reach"]), F.lit(0).cast("long"))).alias("n"),
        ), lambda s: s["n"],
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, words, words hit by an exact window, items hit, their digest, ``contaminated``, and items near.

    Texts that are absent or have no words are hit by nothing, and such items have no window; an
    absent item_id counts as an empty one, items that share an id are one. Repeated rows get a row each, an empty table
    of documents gives no rows, an empty benchmark hits nothing; other columns are ignored. The matches of a document
    are joined to it by segment and place, so no id or passage gathers rows.
    """
    index = build_index(documents)
    # Written here, so that few segments are read at once or wait on their way to Python.
    with large_rows(index.sparkSession):
        matches = materialize(find_matches(index, benchmark_blocks(benchmark, block_words)), "matches")
    per_document = matches.groupBy("segment", "doc_no").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "phrase", F.struct("start", "stop")))).alias("spans"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "phrase", F.col("item")))).alias("items"),
        F.count_distinct("item").alias("n_near"),
    )
    rows = index.select("segment", F.posexplode(F.arrays_zip("doc_id", "n_words")).alias("doc_no", "of"))
    joined = rows.select("segment", "doc_no", "of.doc_id", "of.n_words").join(per_document, ["segment", "doc_no"], "left")
    hit = F.coalesce(_covered(F.col("spans")), F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near_items"),
    )
