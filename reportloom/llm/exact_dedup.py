"""Exact dedup with two-pass Bloom filtering.

The first pass sets a bit for every hash position that two rows or more hit.
In the second pass only rows whose positions are all set are shuffled
and compared by digest; the rest are known to be alone and pass straight through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from reportloom.llm.common import private

PAGE = 15  # a page of the filter has 2 ** PAGE bits, 4 KiB
LEAST_BITS, MOST_BITS = 20, 28  # per hash function, as powers of two


def filter_bits(rows: int) -> int:
    """Power of two with about 16 bits a row; at most MOST_BITS, so both filters together stay under 64 MiB."""
    return min(MOST_BITS, max(LEAST_BITS, (16 * max(rows, 1)).bit_length()))


def positions(text: Column, bits: int) -> list[Column]:
    """The places of a text in the filters, one for each of two hash functions."""
    hashed = F.xxhash64(text)
    mask = F.lit((1 << bits) - 1).cast("long")
    return [hashed.bitwiseAND(mask), F.shiftrightunsigned(hashed, 64 - bits)]


def repeated_positions(texts: DataFrame, text: str, bits: int) -> DataFrame:
    """Pages (which, page, bitmap) of the positions that several rows hit."""
    first, second = positions(F.col(text), bits)
    hits = texts.select(F.inline(F.array(
        F.struct(F.lit(0).alias("which"), first.alias("at")), F.struct(F.lit(1).alias("which"), second.alias("at"))
    )))
    often = hits.groupBy("which", "at").count().filter("count > 1")
    return often.groupBy("which", F.shiftright("at", PAGE).alias("page")).agg(
        F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit((1 << PAGE) - 1).cast("long"))).alias("bitmap")
    )


def _is_set(bitmap: Column, at: Column) -> Column:
    inside = at.bitwiseAND(F.lit((1 << PAGE) - 1).cast("long")).cast("int")
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(inside, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, inside.bitwiseAND(F.lit(7))) == 1, F.lit(False))


def possibly_repeated(df: DataFrame, text: str, bits: int, flag: str) -> DataFrame:
    """``df`` with ``flag``: False for texts that occur once for certain."""
    pages = repeated_positions(df.select(text), text, bits)
    out = df
    for which, at in enumerate(positions(F.col(text), bits)):
        # At most 2 ** (bits - PAGE) pages of 4 KiB: the broadcast is bounded by MOST_BITS.
        side = F.broadcast(pages.filter(F.col("which") == which).select(F.col("page").alias(f"_page{which}"), F.col("bitmap").alias(f"_bitmap{which}")))
        out = out.withColumn(f"_at{which}", at)
        out = out.join(side, F.shiftright(f"_at{which}", PAGE) == F.col(f"_page{which}"), "left")
    hit = _is_set(F.col("_bitmap0"), F.col("_at0")) & _is_set(F.col("_bitmap1"), F.col("_at1"))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), hit.alias(flag))


def _flagged(documents: DataFrame, columns: list[str]) -> DataFrame:
    rows = documents.select(*(F.col(f"`{c}`") for c in columns)).withColumn("text", F.coalesce("text", F.lit("")))
    rows = possibly_repeated(rows, "text", filter_bits(documents.count()), "_maybe")
    return rows.withColumn("text_sha256", F.sha2(F.col("text"), 256))


def exact_groups(documents: DataFrame) -> DataFrame:
    """doc_id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of every document.

    Equal texts are one group, absent ones count as empty. The row with the
    largest doc_id stays; rows without doc_id come last, and of rows that agree
    in text and doc_id one stays. Only ids and digests of possibly repeated texts are shuffled.
    Groups are counted from partial counts, and the join that spreads
    their figures may split a large one. Other columns are ignored.
    """
    rows = _flagged(documents, ["doc_id", "text"]).drop("text")
    alone = rows.filter(~F.col("_maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    maybe = rows.filter("_maybe").select("doc_id", "text_sha256")
    groups = maybe.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    again = Window.partitionBy("text_sha256", "doc_id").orderBy("doc_id")
    joined = maybe.withColumn("_again", F.row_number().over(again)).join(groups, "text_sha256")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_again") == 1)
    return alone.unionByName(joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"))


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of every text, the one that exact_groups keeps, with the columns of ``documents``.

    Copies are reduced to one row on the map side already, so a large group
    moves at most once per task. Of rows that agree in text and doc_id the one
    whose other columns hash highest stays.
    """
    columns, whole = documents.columns, private(documents, "_row")
    packed = documents.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in columns)).alias(whole))
    packed = packed.withColumn("_order", F.xxhash64(whole))
    rows = _flagged(packed, ["doc_id", "text", whole, "_order"]).drop("text")
    best = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "_order")
    kept = rows.filter("_maybe").groupBy("text_sha256").agg(F.max_by(whole, best).alias(whole))
    return rows.filter(~F.col("_maybe")).select(f"{whole}.*").unionByName(kept.select(f"{whole}.*"))
