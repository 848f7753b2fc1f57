"""Term weights as blocks of whole documents, so that no step moves a row per document and term."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from reportloom.functions.constants import ENGLISH_STOP_WORDS
from reportloom.functions.text import tokens
from reportloom.operators.vectors import term_counts
from reportloom.session import WRITES, large_rows, materialize, materialize_buckets, settings

BLOCK_TOKENS = 2_000_000  # tokens of a block, about; a document is never split
PART_CLUSTERS = 32  # clusters whose means meet a block at once
MOST_CELLS = 1 << 21  # products held at once
BLOCK = "block long, docs array<{key}>, ends binary, columns binary, tf binary, terms array<string>, held array<int>"


def small(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs; their width follows from their number."""
    most = int(values.max(initial=0))
    return values.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def numbers(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}") if n else np.zeros(0, np.uint8)


@dataclass
class WeightBlocks:
    """TF-IDF weights of documents at unit length: counts in blocks, with the document frequencies of their terms."""

    table: DataFrame  # block, docs, ends, columns, tf, terms, df and, once placed, labelled: (place, cluster, times)
    key: str
    n_docs: int
    buckets: int
    placed: bool = False

    @property
    def kind(self) -> str:
        return self.table.schema["docs"].dataType.elementType.simpleString()


MARK = "\u0001"  # between a group and its term; no character of a word


def _listed(docs: DataFrame, text: str, key: str, stop_words: Sequence[str], group: Column | None) -> DataFrame:
    """(key, _terms, _tf) of every document with a term; a key of several rows is one document, its terms counted over all of them."""
    words = F.filter(tokens(text), lambda w: ~w.isin(*stop_words)) if stop_words else tokens(text)
    named = docs.select(key, text).filter(F.col(key).isNotNull())
    told = lambda terms: terms if group is None else F.transform(terms, lambda t: F.concat(group, F.lit(MARK), t))
    plain = lambda rows: rows.select(key, told(words).alias("_terms"), F.lit(None).cast("array<long>").alias("_tf"))
    with settings(docs.sparkSession, WRITES):
        single = named.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    if single:
        return plain(named).filter(F.size("_terms") > 0)
    marked = named.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    several = term_counts(marked.filter("_n > 1"), text, key, stop_words).groupBy(key).agg(
        F.collect_list(F.struct("term", "tf")).alias("_t")
    ).select(key, told(F.transform("_t", lambda t: t["term"])).alias("_terms"), F.transform("_t", lambda t: t["tf"]).alias("_tf"))
    return plain(marked.filter("_n = 1")).unionByName(several).filter(F.size("_terms") > 0)


def _one(values) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def term_blocks(docs: DataFrame, text: str, key: str, stop_words: Sequence[str], buckets: int, group: Column | None = None) -> DataFrame:
    """The sparse count matrix in blocks of documents, each with its own terms and the number of its documents that hold them."""
    schema = BLOCK.format(key=docs.schema[key].dataType.simpleString())
    names = [field.split(" ")[0] for field in schema.split(", ")]
    most = BLOCK_TOKENS

    def block(at: int, parts: list) -> pa.RecordBatch:
        keys, sizes, flat, times = zip(*parts)
        keys, sizes, times = pa.concat_arrays(keys), np.concatenate(sizes), np.concatenate(times)
        coded = pa.concat_arrays(flat).dictionary_encode()
        many = len(coded.dictionary)
        cells, inverse = np.unique(np.repeat(np.arange(len(sizes)), sizes) * many + coded.indices.to_numpy(), return_inverse=True)
        tf = np.bincount(inverse, times).astype(np.int64)
        columns = cells % many
        return pa.RecordBatch.from_arrays([
            pa.array([at], pa.int64()), _one(keys), pa.array([small(np.bincount(cells // many, minlength=len(sizes)).cumsum())], pa.binary()),
            pa.array([small(columns)], pa.binary()), pa.array([small(tf)], pa.binary()),
            _one(coded.dictionary), _one(pa.array(np.bincount(columns, minlength=many), pa.int32())),
        ], names=names)

    def run(batches):
        at, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            sizes = pc.list_value_length(batch.column("_terms")).to_numpy().astype(np.int64)
            for rows in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1):
                if not len(rows):
                    continue
                some = batch.slice(rows[0], len(rows))
                own = sizes[rows]
                times = np.ones(own.sum(), np.int64)
                counted = some.column("_tf")
                times[np.repeat(counted.is_valid().to_numpy(zero_copy_only=False), own)] = counted.flatten().to_numpy(zero_copy_only=False)
                if parts and size + len(times) > most:
                    yield block(at, parts)
                    at, parts, size = at + 1, [], 0
                parts.append((some.column(key), own, some.column("_terms").flatten(), times))
                size += len(times)
        if parts:
            yield block(at, parts)

    return materialize_buckets(_listed(docs, text, key, stop_words, group).mapInArrow(run, schema), "term-blocks", buckets, "block")


def tfidf_blocks(
    docs: DataFrame, text: str = "content", key: str = "record_id", stop_words: Sequence[str] = ENGLISH_STOP_WORDS, group: Column | None = None,
) -> WeightBlocks:
    """The weights of ``tfidf`` with its defaults, without a row per document and term.

    Blocks are written once and stay where they are; only their distinct terms are shuffled, with the
    number of documents that hold them, and document frequencies go back. Rows without a key are one document that
    counts among the documents, as in ``tfidf``, but has no weights. With a ``group``, a text made from the key, terms are told
    apart by it, so frequencies count inside groups.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = term_blocks(docs, text, key, stop_words, buckets, group)
    unkeyed = term_counts(docs.filter(F.col(key).isNull()), text, key, stop_words).select(
        F.lit(None).cast("long").alias("block"), F.lit(None).cast("int").alias("place"), "term", F.lit(1).alias("held"))
    placed = made.select("block", F.posexplode(F.arrays_zip("terms", "held")).alias("place", "t")).select(
        "block", "place", F.col("t.terms").alias("term"), F.col("t.held").alias("held"))
    counted = placed.unionByName(unkeyed).withColumn("df", F.sum("held").over(Window.partitionBy("term")))

    def run(rows: pa.Table) -> pa.Table:
        df = np.empty(len(rows), np.int64)
        df[rows.column("place").to_numpy()] = rows.column("df").to_numpy()
        return pa.table([rows.column("block").slice(0, 1), pa.array([small(df)], pa.binary())], names=["block", "df"])

    found = counted.filter("block is not null").select("block", "place", "df").groupBy("block").applyInArrow(run, "block long, df binary")
    frequencies = materialize_buckets(found, "document-frequencies", buckets, "block")
    return WeightBlocks(made.drop("held").join(frequencies, "block"), key, docs.count(), buckets)


def place_labels(blocks: WeightBlocks, labels: DataFrame) -> WeightBlocks:
    """The blocks with the labels of their documents, and the number of labels of a key; only keys and labels are moved."""
    key = blocks.key
    counted = labels.select(key, "cluster").withColumn("times", F.count("*").over(Window.partitionBy(key)))
    rows = blocks.table.select("block", F.posexplode("docs").alias("place", key)).join(counted, key)
    listed = rows.groupBy("block").agg(F.collect_list(F.struct("place", "cluster", "times")).alias("labelled"))
    return replace(blocks, table=blocks.table.join(materialize_buckets(listed, "block-labels", blocks.buckets, "block"), "block"), placed=True)


def _cells(rows, k: int):
    """(starts, sizes) of the documents of a block, (tf, columns) of their cells, and df, terms and keys."""
    terms, keys = (rows.column(c).slice(k, 1) for c in ("terms", "docs"))
    terms, keys = (pa.concat_arrays(x.chunks).flatten() if isinstance(x, pa.ChunkedArray) else x.flatten() for x in (terms, keys))
    ends = numbers(rows.column("ends")[k].as_py(), len(keys)).astype(np.int64)
    cells = int(ends[-1])
    columns = numbers(rows.column("columns")[k].as_py(), cells).astype(np.int64)
    df = numbers(rows.column("df")[k].as_py(), len(terms)).astype(np.float64)
    starts = np.concatenate([[0], ends[:-1]])
    return starts, ends - starts, numbers(rows.column("tf")[k].as_py(), cells), columns, df, terms, keys


def _matrix(rows, k: int, n_docs: int):
    """(starts, sizes) of the documents of a block, (weights, columns) of their cells, and terms and keys."""
    starts, sizes, tf, columns, df, terms, keys = _cells(rows, k)
    weights = tf * (np.log((n_docs + 1.0) / (df + 1.0)) + 1.0)[columns]
    weights /= np.repeat(np.sqrt(np.add.reduceat(weights * weights, starts)), sizes)
    return starts, sizes, weights, columns, terms, keys


def _labelled(rows, k: int) -> tuple[np.ndarray, pa.Array]:
    """(places, clusters) of the labels of a block."""
    own = rows.column("labelled").slice(k, 1)
    own = (pa.concat_arrays(own.chunks) if isinstance(own, pa.ChunkedArray) else own).flatten()
    return own.field("place").to_numpy(zero_copy_only=False).astype(np.int64), own.field("cluster")


def _written(df: DataFrame, name: str) -> DataFrame:
    with large_rows(df.sparkSession):
        return materialize(df, name)


def cluster_sums(blocks: WeightBlocks) -> DataFrame:
    """``(cluster, term, total, docs)``: summed weights and the number of labels whose document holds the term."""
    n_docs = blocks.n_docs
    kind = blocks.table.schema["labelled"].dataType.elementType["cluster"].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                starts, sizes, weights, columns, terms, _ = _matrix(batch, k, n_docs)
                places, clusters = _labelled(batch, k)
                known = clusters.is_valid().to_numpy(zero_copy_only=False)
                places, coded = places[known], clusters.filter(pa.array(known)).dictionary_encode()
                many = sizes[places]
                at = np.arange(many.sum()) + np.repeat(starts[places] - (np.cumsum(many) - many), many)
                cell, inverse = np.unique(np.repeat(coded.indices.to_numpy().astype(np.int64), many) * len(terms) + columns[at], return_inverse=True)
                total, docs = np.bincount(inverse, weights[at]), np.bincount(inverse)
                for low in range(0, len(cell), 100_000):
                    some = slice(low, low + 100_000)
                    yield pa.RecordBatch.from_arrays([
                        coded.dictionary.take(pa.array(cell[some] // len(terms))), terms.take(pa.array(cell[some] % len(terms))),
                        pa.array(total[some]), pa.array(docs[some], pa.int64()),
                    ], names=["cluster", "term", "total", "docs"])

    partial = blocks.table.mapInArrow(run, f"cluster {kind}, term string, total double, docs long")
    return _written(partial.groupBy("cluster", "term").agg(F.sum("total").alias("total"), F.sum("docs").alias("docs")), "cluster-sums")


def squared_lengths(blocks: WeightBlocks) -> DataFrame:
    """``(key, _own)``: the squared length of every labelled document."""
    key, n_docs = blocks.key, blocks.n_docs

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                starts, _, weights, _, _, keys = _matrix(batch, k, n_docs)
                places = np.unique(_labelled(batch, k)[0])
                own = np.add.reduceat(weights * weights, starts)[places]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(places)), pa.array(own)], names=[key, "_own"])

    return _written(blocks.table.mapInArrow(run, f"`{key}` {blocks.kind}, _own double"), "lengths")


def products(blocks: WeightBlocks, center: DataFrame, own_only: bool = False) -> DataFrame:
    """``(key, other, dot)`` of labelled documents with the means of clusters, or with those of their own clusters.

    The means of a block's terms travel to it, once per block; clusters meet it in parts, so that a
    task holds a bounded number of means.
    """
    key, n_docs = blocks.key, blocks.n_docs
    kind = center.schema["cluster"].dataType.simpleString()
    parts = -(-center.select("cluster").distinct().count() // PART_CLUSTERS)
    by = ["block"] if parts <= 1 else ["block", "_part"]
    means = center.select("term", F.col("cluster").alias("other"), "centroid")
    table = blocks.table
    if parts > 1:
        means = means.withColumn("_part", F.pmod(F.xxhash64("other"), F.lit(parts)).cast("int"))
        table = table.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    wanted = blocks.table.select("block", F.posexplode("terms").alias("place", "term")).join(means, "term").select(
        *[F.col(c).alias(f"{c}_of") for c in by], "place", "other", "centroid")

    def run(wanted: pa.Table, rows: pa.Table) -> pa.Table:
        found = [[], [], []]
        if len(wanted) and len(rows):
            starts, sizes, weights, columns, terms, keys = _matrix(rows, 0, n_docs)
            coded = wanted.column("other").combine_chunks().dictionary_encode()
            coded = pa.concat_arrays(coded.chunks) if isinstance(coded, pa.ChunkedArray) else coded
            width = len(coded.dictionary)
            mean = np.zeros((len(terms), width))
            mean[wanted.column("place").to_numpy(), coded.indices.to_numpy()] = wanted.column("centroid").to_numpy()
            places, clusters = _labelled(rows, 0)
            asked = np.zeros((len(keys), width), bool)
            if own_only:
                code = pc.index_in(clusters, value_set=coded.dictionary)
                known = code.is_valid().to_numpy(zero_copy_only=False)
                asked[places[known], code.drop_null().to_numpy()] = True
            else:
                asked[places] = True
            ends, low = starts + sizes, 0
            while low < len(keys):
                high = max(low + 1, int(np.searchsorted(ends, starts[low] + MOST_CELLS // width, "right")))
                cells = slice(starts[low], ends[high - 1])
                dots = np.add.reduceat(mean[columns[cells]] * weights[cells, None], starts[low:high] - starts[low])
                doc, other = np.nonzero(asked[low:high] & (dots != 0))
                for to, values in zip(found, (doc + low, other, dots[doc, other])):
                    to.append(values)
                low = high
            doc, other, dots = (np.concatenate(x) for x in found)
            return pa.table([keys.take(pa.array(doc)), coded.dictionary.take(pa.array(other)), pa.array(dots)], names=[key, "other", "dot"])
        return empty

    empty = pa.table([_nothing(blocks.table.schema["docs"].dataType.elementType), _nothing(center.schema["cluster"].dataType), pa.array([], pa.float64())], names=[key, "other", "dot"])
    done = wanted.groupBy(*[f"{c}_of" for c in by]).cogroup(table.groupBy(*by)).applyInArrow(run, f"`{key}` {blocks.kind}, other {kind}, dot double")
    return _written(done, "products")


def _nothing(kind) -> pa.Array:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.array([], to_arrow_type(kind))


def group_vocabulary(blocks: WeightBlocks) -> DataFrame:
    """``(group, vocabulary)``: the number of terms of every group of blocks that tell terms apart by groups."""
    terms = blocks.table.select(F.explode("terms").alias("t")).distinct()
    before = F.length("t") - F.length(F.substring_index("t", MARK, -1)) - 1
    return _written(terms.groupBy(F.substr("t", F.lit(1), before).alias("group")).agg(F.count("*").alias("vocabulary")), "group-vocabulary")


def unit_sums(blocks: WeightBlocks, sizes: dict) -> DataFrame:
    """``(cluster, sid, total)``: the summed unit weights of rows whose key is ``(cluster, sid)``, by frequencies inside a cluster of ``sizes`` rows."""
    kind = blocks.table.schema["docs"].dataType.elementType["cluster"].dataType.simpleString()

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                starts, many, tf, columns, df, _, keys = _cells(batch, k)
                coded = keys.field("cluster").dictionary_encode()
                n = np.array([sizes[c] for c in coded.dictionary.to_pylist()], np.float64)[coded.indices.to_numpy()]
                weights = tf * (np.log((np.repeat(n, many) + 1.0) / (df[columns] + 1.0)) + 1.0)
                total = np.add.reduceat(weights, starts) / np.sqrt(np.add.reduceat(weights * weights, starts))
                yield pa.RecordBatch.from_arrays([keys.field("cluster"), keys.field("sid"), pa.array(total)], names=["cluster", "sid", "total"])

    return _written(blocks.table.mapInArrow(run, f"cluster {kind}, sid string, total double"), "unit-sums")
