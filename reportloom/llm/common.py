"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

# Characters that separate words: the blank and 0x09 to 0x0D.
BLANKS = r"\x20\x09-\x0D"
SLICE_BYTES = 8 << 20
MASK64 = (1 << 64) - 1


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def private(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held_out(doc_id: Column) -> Column:
    """True for the rows that no classifier may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, target: str, per_class: int, max_chars: int):
    """(texts, labels, weights) to fit a classifier on; their size does not grow with the input.

    Per class the ``per_class`` labelled ids that come first by hash are taken, held-out
    ids excepted; of their texts, in the same order, as many as have ``max_chars``
    characters together. A weight tells how many labelled rows a row of its
    class stands for. This is the only place where a number of rows is bounded.
    """
    spark = documents.sparkSession
    usable = (
        labels.select("doc_id", F.col(target).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    shares = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    order = F.xxhash64("doc_id", F.lit(7))
    firsts = [usable.filter(F.col("label") == v).orderBy(order, "doc_id").limit(per_class) for v in (0, 1)]
    # At most 2 * per_class rows of two numbers: the size of these broadcasts is bounded.
    ids = firsts[0].unionByName(firsts[1])
    texts = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    sizes = texts.select("doc_id", F.length("text").alias("chars")).collect()
    kept, room = [], max_chars
    for row in sorted(sizes, key=lambda r: (xxhash.xxh64_intdigest(str(r.doc_id)), r.doc_id)):
        if row.chars <= room:
            kept.append((row.doc_id,))
            room -= row.chars
    chosen = spark.createDataFrame(kept, "chosen long")
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen"), "left_semi").collect()
    rows.sort(key=lambda r: r.doc_id)
    target_values = np.array([r.label for r in rows], dtype=np.float64)
    taken = np.maximum(np.bincount(target_values.astype(int), minlength=2), 1)
    weights = np.array([shares.get(0, 1) / taken[0], shares.get(1, 1) / taken[1]])[target_values.astype(int)]
    return [r.text for r in rows], target_values, weights / weights.mean() if len(weights) else weights


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """Consecutive (start, stop) ranges of rows of about ``limit`` bytes each; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, stop
        start = stop


def words_of(texts: pa.Array):
    """(document of each word, vocabulary, code of each word in it), words in text order."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(flat), 0)
    mask = full.to_numpy(zero_copy_only=False).astype(bool)
    encoded = flat.filter(full).dictionary_encode()
    return owner[mask], encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def hash_words(vocabulary: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every entry."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in vocabulary.to_pylist()), dtype=np.uint64, count=len(vocabulary))


def mix(values: np.ndarray, salt: int) -> np.ndarray:
    """Hash of 64-bit values (the finaliser of splitmix64 over value + salt)."""
    with np.errstate(over="ignore"):
        x = values + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & MASK64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
