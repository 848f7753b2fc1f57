"""Token counts of documents in flat, unindexed token files.

A file is a plain row of 16-bit ids in which one id ends a document. Files are cut into
blocks, blocks are searched for that id with vector operations, and
documents that reach over block borders are stitched together by a prefix scan over the blocks.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from reportloom.llm.common import text_slices
from reportloom.llm.tokens import tokenizer_path, word_tokenizer
from reportloom.session import materialize, scratch_path

END_ID = 49407  # <|endoftext|> of the default vocabulary; as ordinary text it never occurs
BLOCK_BYTES = 4 << 20
ID_BYTES = 2


def write_token_files(documents: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes one flat file per partition into ``folder`` and gives (file, ordinal, doc_id) of its documents.

    A file is written under a name of its own and then renamed, so a repeated or speculative
    task leaves the same file. Reading the result writes the files.
    """
    source = tokenizer_path(path)

    def run(batches):
        tokenizer = word_tokenizer(source, plain_specials=True)
        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.tokens"
        part, ordinal = f"{root}/.{uuid.uuid4().hex}", 0
        with store.open_output_stream(part) as out:
            for batch in batches:
                for start, stop in text_slices(batch.column("text")):
                    ids, counts = tokenizer.encode(batch.column("text").slice(start, stop - start))
                    # One end id behind every document.
                    flat = np.insert(ids, np.cumsum(counts), end_id)
                    out.write(flat.astype("<u2").tobytes())
                    n = stop - start
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * n), pa.array(np.arange(ordinal, ordinal + n)), batch.column("doc_id").slice(start, n)],
                        names=["file", "ordinal", "doc_id"],
                    )
                    ordinal += n
        store.move(part, f"{root}/{name}")

    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "file string, ordinal long, doc_id long")


def file_blocks(spark: SparkSession, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, file, block, at, size) of the blocks of all files in ``folder``; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokens").load(folder).select("path", "length")
    files = files.filter("length > 0").withColumn("file", F.element_at(F.split("path", "/"), -1))
    numbers = F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block_bytes))
    blocks = files.select("path", "file", "length", F.explode(numbers).alias("block"))
    at = F.col("block") * block_bytes
    return blocks.select("path", "file", "block", at.alias("at"), F.least(F.lit(block_bytes), F.col("length") - at).alias("size"))


def _search(end_id: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(path) as file:
                    raw = file.read_at(row["size"], row["at"])
                ids = np.frombuffer(raw, "<u2")
                ends = np.flatnonzero(ids == end_id) + row["at"] // ID_BYTES
                yield pa.RecordBatch.from_pylist([{
                    "file": row["file"], "block": row["block"], "stop": row["at"] // ID_BYTES + len(ids), "ends": ends.tolist(),
                }], schema=pa.schema([("file", pa.string()), ("block", pa.int64()), ("stop", pa.int64()), ("ends", pa.list_(pa.int64()))]))
    return run


def count_tokens(spark: SparkSession, folder: str, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of every document in the files of ``folder``.

    The end id is not counted. Ids behind the last end id of a file are a document
    that is not ``closed``. Documents of any length may reach over any number of
    blocks. Empty files have none.
    """
    blocks = file_blocks(spark, folder, block_bytes)
    # Blocks are of one size: dealt evenly, each is a unit of work of its own.
    tasks = max(1, min(blocks.count(), 4 * spark.sparkContext.defaultParallelism))
    found = blocks.repartition(tasks).mapInArrow(_search(end_id), "file string, block long, stop long, ends array<long>")
    found = materialize(found, "block-ends")
    # The scan runs over the blocks of one file, in order; a block is one short row.
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("file", "block", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"), "stop")
    summary = summary.select(
        "file", "block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"),
        F.coalesce(F.max("last").over(order) + 1, F.lit(0)).alias("carry"),
    )
    stitched = found.join(summary, ["file", "block"])
    starts = F.concat(F.array("carry"), F.transform("ends", lambda e: e + 1))
    each = stitched.select("file", "base", F.posexplode(F.arrays_zip(
        F.slice(starts, F.lit(1), F.size("ends")).alias("start"), F.col("ends").alias("stop")
    )).alias("k", "doc")).select(
        "file", (F.col("base") + F.col("k")).alias("ordinal"), F.col("doc.start").alias("start"),
        (F.col("doc.stop") - F.col("doc.start")).alias("n_tokens"), F.lit(True).alias("closed"),
    )
    tails = found.groupBy("file").agg(F.sum(F.size("ends")).alias("ordinal"), F.max(F.try_element_at("ends", F.lit(-1))).alias("last"), F.max("stop").alias("stop"))
    start = F.coalesce(F.col("last") + 1, F.lit(0))
    tails = tails.filter(F.col("stop") > start).select("file", "ordinal", start.alias("start"), (F.col("stop") - start).alias("n_tokens"), F.lit(False).alias("closed"))
    return each.unionByName(tails)


def document_token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens of every document, counted in flat files written from them.

    An empty or absent text has no tokens. Repeated rows are counted each,
    rows without doc_id too; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    folder = scratch_path(spark, "tokens")
    listed = materialize(write_token_files(documents, folder, path), "token-files")
    if listed.isEmpty():
        return listed.select("doc_id", F.col("ordinal").alias("n_tokens"))
    counts = count_tokens(spark, folder).select("file", "ordinal", "n_tokens")
    return listed.join(counts, ["file", "ordinal"]).select("doc_id", "n_tokens")
