"""Filter interaction audit over a sparse document-term matrix.

Words are encoded by a global dictionary and documents become rows of CSR shards. Row sums (words)
and nonzero counts (distinct words) decide two of five filters; the other three come from the
characters and from equal texts. All orders of the filters are then read off the 32
combinations of failures in each part.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from reportloom.llm.common import text_slices, words_of
from reportloom.operators.dictionary import number_terms
from reportloom.session import materialize

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
SYMBOLS = b"#$%&*|"
# Shards of a task share a codebook until it has this many words; it then starts another.
CODEBOOK_WORDS = 400_000

SHARD = (
    "grp long, shard long, doc_id array<long>, part array<string>, digest array<binary>, chars array<int>, capitals array<int>, "
    "symbols array<boolean>, indptr binary, indices binary, data binary, words array<string>"
)
ROW = "doc_id long, part string, digest binary, n_words long, n_distinct long, chars int, capitals int, symbols boolean"


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same counts in as few bytes as the largest needs."""
    most = int(values.max(initial=0))
    return values.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4")


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each text begins, the end of the last one included."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[edges[0]:edges[-1]], edges - edges[0]


def _per_text(hits: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many of the marked bytes lie in each text."""
    return np.diff(np.searchsorted(np.flatnonzero(hits), edges)).astype(np.int32)


def _sparse(texts: pa.Array):
    """(indptr, column of each nonzero, its count, vocabulary) of a slice of texts."""
    owner, vocabulary, codes = words_of(texts)
    width = max(len(vocabulary), 1)
    cells, counts = np.unique(owner.astype(np.int64) * width + codes, return_counts=True)
    indptr = np.searchsorted(cells, np.arange(len(texts) + 1) * width)
    return indptr, cells % width, counts, vocabulary


def _row_order(indptr: np.ndarray, columns: np.ndarray, counts: np.ndarray, width: int):
    """The nonzeros of every row by ascending column."""
    rows = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    order = np.argsort(rows * np.int64(max(width, 1)) + columns, kind="stable")
    return columns[order], counts[order]


class _Codebook:
    """Slices of one task over one growing vocabulary."""

    def __init__(self, grp: int):
        self.grp, self.words, self.slices = grp, pa.array([], pa.string()), []

    def add(self, slice_rows: tuple, texts: pa.Array) -> None:
        indptr, columns, counts, vocabulary = _sparse(texts)
        vocabulary = vocabulary.cast(pa.string())
        known = pc.index_in(vocabulary, value_set=self.words)
        new = pc.is_null(known)
        places = pc.fill_null(known, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = new.to_numpy(zero_copy_only=False).astype(bool)
        places[fresh] = len(self.words) + np.arange(int(fresh.sum()))
        self.words = pa.concat_arrays([self.words, vocabulary.filter(new)])
        self.slices.append((slice_rows, indptr, places[columns] if len(columns) else columns, counts))

    def shards(self, first: int):
        """Record batches, one a slice; the words, by their bytes, stand in the first."""
        order = pc.sort_indices(self.words).to_numpy().astype(np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        listed = self.words.take(pa.array(order))
        for k, (rows, indptr, columns, counts) in enumerate(self.slices):
            columns, counts = _row_order(indptr, rank[columns] if len(columns) else columns, counts, len(order))
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            yield pa.RecordBatch.from_arrays([
                pa.array([self.grp], pa.int64()), pa.array([first + k], pa.int64()), *(one(v) for v in rows),
                pa.array([indptr.astype("<i8").tobytes()], pa.binary()), pa.array([columns.astype("<u4").tobytes()], pa.binary()),
                pa.array([_narrow(counts).tobytes()], pa.binary()), one(listed if k == 0 else pa.array([], pa.string())),
            ], names=[c.split(" ")[0] for c in SHARD.split(", ")])


def build_shards(documents: DataFrame) -> DataFrame:
    """CSR shards with columns numbered inside a codebook, written to the shared folder.

    A row holds the documents of some megabytes of whole text: their ids, parts, figures of their characters, and
    the three arrays of the matrix. Columns are places in the sorted words of the codebook.
    """
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("part"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        at = TaskContext.get().partitionId() << 32
        book, made = _Codebook(at), 0
        table = np.zeros(256, bool)
        table[list(SYMBOLS)] = True
        for batch in batches:
            for start, stop in text_slices(batch.column("text")):
                own = batch.slice(start, stop - start)
                text = own.column("text")
                raw, edges = _bytes_of(text)
                digests = [hashlib.sha256(raw[i:j]).digest() for i, j in zip(edges[:-1], edges[1:])]
                rows = (
                    own.column("doc_id"), own.column("part"), pa.array(digests, pa.binary()), pc.utf8_length(text).cast(pa.int32()),
                    pa.array(_per_text((raw >= 65) & (raw <= 90), edges)), pa.array(_per_text(table[raw], edges) > 0),
                )
                book.add(rows, text)
                if len(book.words) >= CODEBOOK_WORDS:
                    yield from book.shards(at + made)
                    made += len(book.slices)
                    book = _Codebook(at + made)
        yield from book.shards(at + made)

    return materialize(texts.mapInArrow(run, SHARD), "csr-shards")


def codebooks(shards: DataFrame) -> DataFrame:
    """(grp, ids): the global number of every word of a codebook, in the order of its columns.

    The dictionary numbers words by their bytes, the order that columns of a codebook have
    too, so the sorted numbers are the list. A codebook is bounded by CODEBOOK_WORDS and one slice of text.
    """
    words = shards.filter(F.size("words") > 0).select("grp", F.explode("words").alias("word"))
    dictionary = number_terms(words, "word", "word_id")
    return words.join(dictionary, "word").groupBy("grp").agg(F.sort_array(F.collect_list("word_id")).alias("ids"))


class Csr:
    """Some documents of the matrix, with global columns."""

    def __init__(self, indptr: bytes, indices: bytes, data: bytes, ids: np.ndarray):
        self.indptr = np.frombuffer(indptr, "<i8")
        local = np.frombuffer(indices, "<u4")
        self.indices = ids[local] if len(local) else np.zeros(0, np.int64)
        size = len(data) // max(len(local), 1)
        self.data = np.frombuffer(data, f"<u{size}").astype(np.int64) if len(local) else np.zeros(0, np.int64)

    def row_sums(self) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(self.data)])[self.indptr])

    def row_nonzeros(self) -> np.ndarray:
        """Distinct columns of every row."""
        starts = np.zeros(len(self.indices) + 1, bool)
        starts[:-1] = True
        starts[1:-1] = self.indices[1:] != self.indices[:-1]
        starts[self.indptr] = True  # an equal word in the next row counts there again
        starts[-1] = False
        return np.diff(np.concatenate([[0], np.cumsum(starts)])[self.indptr])


def document_rows(documents: DataFrame) -> DataFrame:
    """One row per document: part, digest of the text, words, distinct words, and figures of its characters."""
    shards = build_shards(documents)
    whole = shards.drop("words").join(codebooks(shards), "grp", "left")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids = row.column("ids").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                csr = Csr(*(row.column(c)[0].as_py() for c in ("indptr", "indices", "data")), ids)
                own = {c: row.column(c).flatten() for c in ("doc_id", "part", "digest", "chars", "capitals", "symbols")}
                yield pa.RecordBatch.from_arrays([
                    own["doc_id"], own["part"], own["digest"], pa.array(csr.row_sums()), pa.array(csr.row_nonzeros().astype(np.int64)),
                    own["chars"], own["capitals"], own["symbols"],
                ], names=[c.split(" ")[0] for c in ROW.split(", ")])

    return whole.mapInArrow(run, ROW)


def _bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def failure_mask() -> Column:
    """Filters A to D that a row of ``document_rows`` fails, as bits."""
    fails = {
        "A": F.col("n_words") < 50, "B": 100 * F.col("n_distinct") < 65 * F.col("n_words"),
        "C": 100 * F.col("capitals").cast("long") > 5 * F.col("chars").cast("long"), "D": F.col("symbols"),
    }
    return sum((F.when(failed, _bit(name)).otherwise(0) for name, failed in fails.items()), F.lit(0))


def failure_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the set of filters they fail.

    Of equal texts all but those with the least doc_id fail E; rows without doc_id neither fail nor decide it. Copies are
    counted per text, part and label before the least id is spread over them, so a large group of copies is a few rows.
    """
    marks = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")
    ).filter("doc_id is not null").groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    own = rows.select("doc_id", "part", "digest", failure_mask().alias("mask"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    marked = own.filter("doc_id is not null").join(marks, "doc_id", "left").select("doc_id", "part", "digest", "mask", flag("good"), flag("toxic"))
    plain = own.filter("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    kinds = ["digest", "part", "mask", "good", "toxic"]
    named = marked.groupBy(*kinds, "doc_id").agg(F.count("*").alias("n"))
    groups = named.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    groups = groups.withColumn("free", F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0))
    split = groups.select("part", "good", "toxic", F.inline(F.array(
        F.struct(F.col("mask"), F.col("free").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(_bit("E"))).alias("mask"), (F.col("n") - F.col("free")).alias("n")),
    )))
    every = split.unionByName(plain.select("part", "good", "toxic", "mask", F.lit(1).cast("long").alias("n")))
    only = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return every.groupBy("part", "mask").agg(F.sum("n").alias("total"), only("good"), only("toxic")).withColumnRenamed("total", "n")


def _steps() -> Column:
    """Every order with its steps: the filter's bit and the bits of those before it."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, name in enumerate(order):
            out.append((k + 1, "".join(order), _bit(name), before))
            before |= _bit(name)
    steps, orders, own, earlier = (F.array(*map(F.lit, v)) for v in zip(*out))
    return F.explode(F.arrays_zip(orders.alias("filter_order"), steps.alias("step"), own.alias("own"), earlier.alias("before")))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step, with the counts of that step.

    An absent text counts as empty, an absent source as the part with an empty name; rows that repeat count each. Labels of an id that
    occurs twice count if any of them says so; other columns are ignored, and an empty table gives no rows.
    A part is 32 counts by then, of which each of its 600 steps is a sum.
    """
    counts = failure_counts(document_rows(documents), labels).filter("n > 0")
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))  # at most 32
    at = parts.select("part", "counts", _steps().alias("at")).select("part", "counts", "at.*")

    def total(what: Column | str, condition) -> Column:
        value = (lambda c: c[what]) if isinstance(what, str) else what
        return F.aggregate(
            F.filter("counts", condition), F.lit(0).cast("long"), lambda s, c: s + value(c).cast("long")
        )

    own, before = F.col("own"), F.col("before")
    fails = lambda c: c["mask"].bitwiseAND(own) != 0
    earlier = lambda c: c["mask"].bitwiseAND(before) != 0
    here = lambda c: fails(c) & ~earlier(c)
    return at.select(
        "part", "filter_order", "step",
        total("n", lambda c: c["mask"].bitwiseAND(own.bitwiseOR(before)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda c: fails(c) & earlier(c)).alias("redundant"),
        total("n", lambda c: c["mask"] == own).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        # Of k failing filters each comes first in 120 / k of all orders.
        total(lambda c: c["n"] * F.lit(120) / F.bit_count(c["mask"]), fails).alias("shapley"),
    )
