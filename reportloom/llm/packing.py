"""Packing of documents into windows of fixed size by best-fit decreasing.

Overlong documents are first cut into full windows. The rest of each document is
put, longest first, into the open window with the least room that still suffices;
a segment tree over remaining capacities finds it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from reportloom.llm.common import text_slices
from reportloom.llm.tokens import tokenizer_path, word_tokenizer
from reportloom.session import materialize

WINDOW = 2048
END_ID = 1
PIECES_PER_TASK = 100_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cut(ids: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(start, length, checksum) of the pieces of one document."""
    raw = ids.astype("<u4").tobytes()
    starts = range(0, len(ids), window)
    return [(s, min(window, len(ids) - s), zlib.crc32(raw[4 * s:4 * (s + window)])) for s in starts]


def _piece_batches(path: str, window: int, with_ids: bool):
    def run(batches):
        tokenizer = word_tokenizer(path)
        for batch in batches:
            for start, stop in text_slices(batch.column("text")):
                ids, counts = tokenizer.encode(batch.column("text").slice(start, stop - start))
                ends = np.cumsum(counts)
                docs = batch.column("doc_id").slice(start, stop - start).to_pylist()
                rows, kept = [], []
                for doc, end, count in zip(docs, ends.tolist(), counts.tolist()):
                    own = np.append(ids[end - count:end], np.uint32(END_ID))
                    rows += [(doc, at, length, crc, count + 1) for at, length, crc in _cut(own, window)]
                    if with_ids:
                        kept += [own[at:at + window] for at in range(0, count + 1, window)]
                if rows:
                    columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                    if with_ids:
                        columns.append(pa.array(kept, pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def cut_documents(documents: DataFrame, path: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``window`` tokens of every document; each document ends with END_ID.

    ``with_ids`` adds the ids themselves.
    """
    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    schema = PIECE + (", ids array<long>" if with_ids else "")
    return rows.mapInArrow(_piece_batches(tokenizer_path(path), window, with_ids), schema)


class RoomTree:
    """Segment tree over remaining capacities: how many open windows have each."""

    def __init__(self, window: int):
        self.half = 1 << window.bit_length()
        self.count = [0] * (2 * self.half)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _change(self, room: int, by: int) -> None:
        node = room + self.half
        while node:
            self.count[node] += by
            node >>= 1

    def add(self, room: int, number: int) -> None:
        self.open[room].append(number)
        self._change(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out (window, room) with the least room of at least ``need``."""
        node = need + self.half
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.half:
                node *= 2
                if not self.count[node]:
                    node += 1
        room = node - self.half
        number = self.open[room].pop()
        self._change(room, -1)
        return number, room


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of every piece, and the number of windows."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, used = RoomTree(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.tightest(need)
        if found is None:
            number, room = used, window
            used += 1
        else:
            number, room = found
        where[i], offset[i] = number, window - room
        if room > need:
            tree.add(room - need, number)
    return where, offset, used


def _pack_partition(window: int):
    def run(batches):
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        # The order in which rows arrive may change when a task is repeated; theirs may not.
        order = ["length", "doc_id", "start", "ids_crc32", "doc_tokens"]
        rows = rows.sort_by([(c, "ascending") for c in order])
        where, offset, _ = best_fit_decreasing(rows.column("length").to_numpy(), window)
        first = TaskContext.get().partitionId() << 33
        rows = rows.append_column("sequence_id", pa.array(where + first)).append_column("offset", pa.array(offset))
        yield from rows.to_batches(max_chunksize=10_000)
    return run


def pack(pieces: DataFrame, window: int = WINDOW, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of at most ``window`` tokens.

    Pieces are dealt evenly, in no relation to any key, to as many tasks as
    their number needs, each of which packs about ``per_task`` of them; a task leaves
    a few windows that are not full, so padding does not grow with the
    number of tasks in proportion. Sequence ids are unique, not consecutive.
    """
    tasks = max(1, -(-pieces.count() // per_task))
    dealt = pieces.repartition(tasks)
    return dealt.mapInArrow(_pack_partition(window), f"{PIECE}, sequence_id long, offset long")


def pack_documents(documents: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    An empty text, or none, is the single token END_ID. Repeated rows are
    packed as often as they occur, rows without doc_id like others, other columns are ignored.
    An empty table gives an empty result.
    """
    return pack(materialize(cut_documents(documents, path, window), "pieces"), window)
