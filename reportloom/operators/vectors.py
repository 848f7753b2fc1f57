"""Term weights as a long table, ranking, and pairs of nearly equal documents."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from reportloom.functions.constants import ENGLISH_STOP_WORDS
from reportloom.functions.text import tokens
from reportloom.operators.small import top_n
from reportloom.session import materialize, materialize_buckets


def term_counts(
    docs: DataFrame, text: str = "content", key: str = "record_id",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS, min_chars: int = 2, bigrams: bool = False,
) -> DataFrame:
    """``(key, term, tf)`` for tokens of at least two word characters."""
    words = tokens(text, min_chars)
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(*stop_words))
    if bigrams:
        staged = docs.select(key, words.alias("_w"))
        pairs = F.transform(
            F.arrays_zip(
                F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0))).alias("a"),
                F.slice("_w", 2, F.greatest(F.size("_w") - 1, F.lit(0))).alias("b"),
            ),
            lambda p: F.concat_ws(" ", p["a"], p["b"]),
        )
        terms = staged.select(key, F.explode(F.concat("_w", pairs)).alias("term"))
    else:
        terms = docs.select(key, F.explode(words).alias("term"))
    return terms.groupBy(key, "term").agg(F.count("*").alias("tf"))


def document_count(docs: DataFrame) -> Column:
    """Number of rows as a scalar subquery."""
    return docs.select(F.count("*")).scalar()


def vocabulary(
    counts: DataFrame, n_docs: Column, min_df: int | float = 1, max_df: int | float = 1.0,
    max_features: int | None = None,
) -> DataFrame:
    """Terms with document and corpus frequency inside the given bounds.

    Whole numbers are document counts, fractions are shares of all documents.
    All terms are kept unless ``max_features`` asks for the most frequent ones.
    """
    stats = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    stats = stats.withColumn("n_docs", n_docs.cast("double"))
    low = F.lit(min_df) if isinstance(min_df, int) else F.col("n_docs") * min_df
    high = F.lit(max_df) if isinstance(max_df, int) else F.col("n_docs") * max_df
    kept = stats.filter((F.col("df") >= low) & (F.col("df") <= high))
    return top_n(kept, max_features, "cf", "term") if max_features else kept


def in_vocabulary(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    return counts.join(vocab, "term")


def tf_weight(scheme: str, key: str = "record_id") -> Column:
    tf = F.col("tf").cast("double")
    if scheme == "raw":
        return tf
    if scheme == "log":
        return F.log1p(tf)
    if scheme == "binary":
        return F.lit(1.0)
    if scheme == "augmented":
        return 0.5 + 0.5 * tf / F.max("tf").over(Window.partitionBy(key))
    raise ValueError(f"unknown tf scheme: {scheme}")


def idf_weight(scheme: str) -> Column:
    n, df = F.col("n_docs"), F.col("df")
    if scheme == "smooth":
        return F.log((n + 1) / (df + 1)) + 1
    if scheme == "standard":
        return F.log(n / df) + 1
    if scheme == "probabilistic":
        # NULL when every document has the term (the logarithm of zero).
        return F.when(n > df, F.log((n - df) / df))
    raise ValueError(f"unknown idf scheme: {scheme}")


def weighted_terms(
    vocab_counts: DataFrame, key: str = "record_id", tf_scheme: str = "raw",
    idf_scheme: str = "smooth", norm: bool = True,
) -> DataFrame:
    """The counted terms with their ``weight``, each document scaled to length one."""
    raw = vocab_counts.withColumn("weight", tf_weight(tf_scheme, key) * idf_weight(idf_scheme))
    if norm:
        length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key)))
        raw = raw.withColumn("weight", F.try_divide(F.col("weight"), length))
    return raw


def tfidf_weights(
    vocab_counts: DataFrame, key: str = "record_id", tf_scheme: str = "raw",
    idf_scheme: str = "smooth", norm: bool = True,
) -> DataFrame:
    """``(key, term, weight)``, each document scaled to length one."""
    return weighted_terms(vocab_counts, key, tf_scheme, idf_scheme, norm).select(key, "term", "weight")


def tfidf(
    docs: DataFrame, text: str = "content", key: str = "record_id",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS, min_df: int | float = 1,
    max_df: int | float = 1.0, max_features: int | None = None,
    tf_scheme: str = "raw", idf_scheme: str = "smooth", norm: bool = True,
) -> DataFrame:
    # Written: the vocabulary and the weights both read them, and the texts are taken apart once.
    counts = materialize(term_counts(docs, text, key, stop_words), "term-counts")
    vocab = vocabulary(counts, document_count(docs), min_df, max_df, max_features)
    return tfidf_weights(in_vocabulary(counts, vocab), key, tf_scheme, idf_scheme, norm)


def bm25(
    docs: DataFrame, text: str = "content", key: str = "record_id",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS, min_df: int | float = 1,
    max_df: int | float = 1.0, max_features: int | None = None, k1: float = 1.5, b: float = 0.75,
) -> DataFrame:
    """BM25 weight of every document term; lengths count vocabulary terms."""
    counts = materialize(term_counts(docs, text, key, stop_words), "term-counts")
    vocab = vocabulary(counts, document_count(docs), min_df, max_df, max_features)
    # The mean runs over all documents, also those without a vocabulary term.
    average = vocab.select((F.sum("cf") / F.max("n_docs")).alias("avg")).scalar()
    known = in_vocabulary(counts, vocab)
    length = F.sum("tf").over(Window.partitionBy(key))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    norm = 1 - b + b * length / average
    return known.withColumn(
        "weight", (k1 + 1) * F.col("tf") / (k1 * norm + F.col("tf")) * idf
    ).select(key, "term", "weight")


def unit_length(weights: DataFrame, key: str = "record_id") -> DataFrame:
    """Weights scaled so that every document has length one."""
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key)))
    return weights.withColumn("weight", F.try_divide(F.col("weight"), length)).select(key, "term", "weight")


def _signs(hashes: np.ndarray, dims: int) -> np.ndarray:
    """+1 or -1 per term and direction, from the bits of rehashed terms."""
    out = np.empty((len(hashes), dims), np.float32)
    with np.errstate(over="ignore"):
        for k in range(0, dims, 64):
            x = hashes.view(np.uint64) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8).reshape(-1, 8), axis=1)
            out[:, k:k + 64] = bits[:, :dims - k]
    out *= 2.0
    out -= 1.0
    return out


def projected(weights: DataFrame, dims: int = 256, key: str = "record_id") -> DataFrame:
    """``(key, vector)``: signed random projections of all weights of a document, ``dims`` numbers.

    No term is left out or shares a place with another: each has its own signs in all directions. Dot products
    of unit vectors keep to about 1 / sqrt(dims). Directions are hashes, so nothing is fitted or broadcast.
    """
    listed = weights.groupBy(key).agg(F.collect_list(F.xxhash64("term")).alias("_h"), F.collect_list(F.col("weight")).alias("_w"))

    def run(batches):
        for batch in batches:
            hashes, own = batch.column("_h"), batch.column("_w")
            ends = np.asarray(hashes.offsets)
            flat = hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            weight = own.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
            edges = ends - ends[0]
            out = np.zeros((len(hashes), dims), np.float64)
            for k in range(len(hashes)):
                for low in range(edges[k], edges[k + 1], 1 << 14):
                    at = slice(low, min(low + (1 << 14), edges[k + 1]))
                    out[k] += weight[at] @ _signs(flat[at], dims)
            out /= np.sqrt(dims)
            vector = pa.ListArray.from_arrays(pa.array(np.arange(len(hashes) + 1, dtype=np.int32) * dims), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(key), vector], names=[key, "vector"])

    return listed.mapInArrow(run, f"`{key}` {weights.schema[key].dataType.simpleString()}, vector array<double>")


def rank_documents(weights: DataFrame, query: Sequence[str], k: int = 10, key: str = "record_id") -> DataFrame:
    """Documents with the highest summed weight of the query terms."""
    scored = weights.filter(F.col("term").isin(*query)).groupBy(key).agg(
        F.round(F.sum("weight"), 4).alias("score")
    )
    return top_n(scored, k, "score", key)


# Rounding of sums of products; bounds and thresholds give way by so much.
SLACK = 1e-9


# --- pairs of nearly equal documents -----------------------------------------

def document_vectors(weighted: DataFrame, key: str = "record_id") -> DataFrame:
    """One row per document: its terms, rarest first, and a vector signature.

    Of every term the vector has df, term, weight, tf and ``after``: the length of what follows it.
    """
    upto = F.sum(F.col("weight") * F.col("weight")).over(
        Window.partitionBy(key).orderBy("df", "term").rowsBetween(Window.unboundedPreceding, 0)
    )
    listed = weighted.withColumn("after", F.sqrt(F.greatest(F.lit(1.0) - upto, F.lit(0.0))))
    vectors = listed.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("df", "term", "weight", "tf", "after"))).alias("vector")
    )
    counted = F.transform("vector", lambda t: F.concat_ws(":", t["term"], t["tf"].cast("string")))
    return vectors.withColumn("signature", F.sha2(F.array_join(counted, ","), 256))


def copy_groups(vectors: DataFrame, key: str = "record_id") -> DataFrame:
    """Documents with equal vectors collapse to their lowest id and a count.

    Only ids are grouped; the vector of the lowest id is fetched by id.
    """
    groups = vectors.groupBy("signature").agg(F.min(key).alias("rep"), F.count("*").alias("copies"))
    first = vectors.select(F.col(key).alias("rep"), "vector")
    return groups.join(first, "rep").select("signature", "rep", "vector", "copies")


BLOCK_TERMS = 1 << 23  # leading terms of a block of vectors
CLUSTER_PART = 1024  # vectors that are compared with as many others at once
MOST_CELLS = 1 << 22  # sums or products a task holds at once


def leading_terms(groups: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(rep, rest, terms, weights): the terms a similar partner must share one of, rarest first.

    The tail of frequent terms left out has a length below the threshold, so it alone cannot reach it with
    any unit vector; ``rest`` is that length. A term of one document brings nobody together.
    """
    bound = threshold * threshold - SLACK
    lead = F.filter("vector", lambda t: t["after"] * t["after"] + t["weight"] * t["weight"] >= bound)
    cut = groups.select("rep", lead.alias("_lead")).filter(F.size("_lead") > 0)
    shared = cut.select("rep", F.element_at("_lead", -1)["after"].alias("rest"), F.filter("_lead", lambda t: t["df"] > 1).alias("_lead"))
    return shared.filter(F.size("_lead") > 0).select(
        "rep", "rest", F.transform("_lead", lambda t: t["term"]).alias("terms"), F.transform("_lead", lambda t: t["weight"]).alias("weights")
    )


def _flat(rows: pa.Table, column: str) -> pa.Array:
    return pa.concat_arrays([pc.list_flatten(c) for c in rows.column(column).chunks])


def _sizes(rows: pa.Table) -> np.ndarray:
    return pc.list_value_length(rows.column("terms")).to_numpy().astype(np.int64)


def _places(*sides: pa.Table) -> tuple[list[np.ndarray], int]:
    """Numbers of the terms of each side, as many as there are terms in all."""
    flat = [_flat(side, "terms") for side in sides]
    coded = pa.concat_arrays(flat).dictionary_encode()
    places = coded.indices.to_numpy().astype(np.int64)
    return np.split(places, np.cumsum([len(f) for f in flat])[:-1]), len(coded.dictionary)


def _entries(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every leading term: row, weight and length of what follows; of every row: length of its tail."""
    sizes, rest = _sizes(rows), rows.column("rest").to_numpy()
    row, weight = np.repeat(np.arange(len(sizes)), sizes), _flat(rows, "weights").to_numpy()
    upto = np.cumsum(weight * weight)
    after = upto[np.cumsum(sizes) - 1][row] - upto + (rest * rest)[row]
    return row, weight, np.sqrt(np.maximum(after, 0.0)), rest


def _met(left: pa.Table, right: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two blocks that may reach the threshold."""
    (own, other), n_terms = _places(left, right)
    row, weight, after, rest = _entries(left)
    to_row, to_weight, to_after, to_rest = _entries(right)
    order = np.argsort(other, kind="stable")
    to_row, to_weight, to_after = to_row[order], to_weight[order], to_after[order]
    counts = np.bincount(other, minlength=n_terms)
    starts, meets = (np.cumsum(counts) - counts)[own], counts[own]
    ends, width = np.cumsum(_sizes(left)), len(to_rest)
    work = np.concatenate([[0], np.cumsum(meets)])[np.concatenate([[0], ends])]
    found, low = [], 0
    while low < len(ends):
        high = min(low + max(MOST_CELLS // width, 1), int(np.searchsorted(work, work[low] + MOST_CELLS, "right")) - 1)
        high = max(high, low + 1)
        at = slice(ends[low - 1] if low else 0, ends[high - 1])
        entry = np.repeat(np.arange(at.start, at.stop), meets[at])
        posting = np.arange(len(entry)) + np.repeat(starts[at] - (np.cumsum(meets[at]) - meets[at]), meets[at])
        cell = (row[entry] - low) * width + to_row[posting]
        shared = np.bincount(cell, weight[entry] * to_weight[posting], (high - low) * width)
        last = np.full((high - low) * width, -1)
        last[cell] = np.arange(len(cell))  # the last of equal cells stays: the most frequent shared term
        cell = np.flatnonzero(last >= 0)
        last, mine, its = last[cell], low + cell // width, cell % width
        beyond = np.maximum(rest[mine] * to_after[posting[last]], to_rest[its] * after[entry[last]])
        kept = shared[cell] + beyond >= threshold - SLACK
        found.append((mine[kept], its[kept]))
        low = high
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def candidate_pairs(groups: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs that may reach the threshold, by norm bounds; no similar pair is missing.

    Vectors meet on their leading terms and the products of shared ones are summed. What is shared beyond
    lies behind the last shared leading term of one vector and in the tail of the other,
    so the product of these lengths bounds it. Leading terms are dealt into blocks of vectors and every block
    meets every other in one task, so pairs that merely share a term never leave it: leading terms
    travel once per block, candidates are all that is written.
    """
    kind = groups.schema["rep"].dataType.simpleString()
    leads = materialize(leading_terms(groups, threshold), "leading-terms")
    entries = leads.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(-(-entries // BLOCK_TERMS), min(6, 1 + entries // 100_000))
    dealt = leads.withColumn("_block", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int"))
    left = dealt.withColumn("_other", F.explode(F.sequence("_block", F.lit(blocks - 1))))
    right = dealt.select(
        "rep", "rest", "terms", "weights", F.explode(F.sequence(F.lit(0), "_block")).alias("_block"), F.col("_block").alias("_other")
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("rep").combine_chunks(), right.column("rep").combine_chunks()
        if not len(ids[0]) or not len(ids[1]):
            return pa.table([i.slice(0, 0) for i in ids], names=["left_id", "right_id"])
        a, b = (i.take(pa.array(at)) for i, at in zip(ids, _met(left, right, threshold)))
        first = pc.less(a, b)
        if left.column("_block")[0] == left.column("_other")[0]:  # every pair is met in both orders
            return pa.table([a.filter(first), b.filter(first)], names=["left_id", "right_id"])
        return pa.table([pc.if_else(first, a, b), pc.if_else(first, b, a)], names=["left_id", "right_id"])

    by = ("_block", "_other")
    columns = ["rep", "rest", "terms", "weights", *by]
    return left.select(*columns).groupBy(*by).cogroup(right.select(*columns).groupBy(*by)).applyInArrow(
        run, f"left_id {kind}, right_id {kind}"
    )


def _cosines(pairs: pa.Table, vectors: pa.Table) -> np.ndarray:
    """Cosines of pairs of vectors; a vector is laid out once and met with all of its partners."""
    (places,), n_terms = _places(vectors)
    weights, ends = _flat(vectors, "weights").to_numpy(), np.concatenate([[0], np.cumsum(_sizes(vectors))])
    ids = vectors.column("rep").combine_chunks()
    left, right = (pc.index_in(pairs.column(c), value_set=ids).to_numpy() for c in ("left_id", "right_id"))
    out, laid, at = np.empty(len(left)), np.zeros(n_terms), None
    for k in np.argsort(left, kind="stable"):
        if left[k] != at:
            if at is not None:
                laid[places[ends[at]:ends[at + 1]]] = 0.0
            at = left[k]
            laid[places[ends[at]:ends[at + 1]]] = weights[ends[at]:ends[at + 1]]
        its = slice(ends[right[k]], ends[right[k] + 1])
        out[k] = laid[places[its]] @ weights[its]
    return out


def similar_pairs(groups: DataFrame, threshold: float = 0.8) -> DataFrame:
    """All pairs of distinct vectors with cosine >= threshold (exact).

    Candidates are dealt out by the lowest partner of their left vector, in parts of about ``CLUSTER_PART`` vectors a side.
    A vector travels once to each part it is a candidate in, not once per pair.
    """
    kind = groups.schema["rep"].dataType.simpleString()
    pairs = materialize(candidate_pairs(groups, threshold), "candidate-pairs")
    lowest = pairs.groupBy(F.col("right_id").alias("left_id")).agg(F.min("left_id").alias("_lowest"))
    placed = pairs.join(lowest, "left_id", "left").withColumn("_lead", F.coalesce("_lowest", "left_id")).drop("_lowest")
    sides = placed.select("_lead", F.explode(F.array("left_id", "right_id")).alias("rep")).distinct()
    parts = sides.groupBy("_lead").agg(F.ceil(F.count("*") / CLUSTER_PART).alias("_parts"))
    part = lambda c: F.pmod(F.xxhash64(c), F.col("_parts")).alias(f"_{c}")
    placed = materialize(placed.join(parts, "_lead").select("left_id", "right_id", "_lead", part("left_id"), part("right_id")), "placed-pairs")
    by = ("_lead", "_left_id", "_right_id")
    asked = placed.select(*[F.col(c).alias(f"{c}_of") for c in by], F.explode(F.array("left_id", "right_id")).alias("rep")).distinct()
    shared = F.filter("vector", lambda t: t["df"] > 1)
    vectors = groups.select("rep", F.transform(shared, lambda t: t["term"]).alias("terms"), F.transform(shared, lambda t: t["weight"]).alias("weights"))

    def run(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
        cosine = _cosines(pairs, vectors)
        return pairs.select(["left_id", "right_id"]).append_column("cosine", pa.array(cosine)).filter(pa.array(cosine >= threshold - SLACK))

    return placed.groupBy(*by).cogroup(asked.join(vectors, "rep").groupBy(*[f"{c}_of" for c in by])).applyInArrow(
        run, f"left_id {kind}, right_id {kind}, cosine double"
    )


def grouped_vectors(
    docs: DataFrame, text: str = "content", key: str = "record_id",
    min_df: int | float = 1, max_df: int | float = 1.0, max_features: int | None = None,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """Vector signature per document, and the groups of equal vectors."""
    counts = materialize(term_counts(docs, text, key, stop_words), "term-counts")
    known = in_vocabulary(counts, vocabulary(counts, document_count(docs), min_df, max_df, max_features))
    # Read several times, by the copy groups and by the pairs; dealt by key, so that they are not shuffled for it.
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors = materialize_buckets(document_vectors(weighted_terms(known, key), key), "vectors", buckets, key)
    return vectors.select(key, "signature"), copy_groups(vectors, key)


def similar_documents(
    docs: DataFrame, threshold: float = 0.8, text: str = "content", key: str = "record_id", **options,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vector signature per document, copy groups, similar pairs of groups."""
    signatures, groups = grouped_vectors(docs, text, key, **options)
    return signatures, groups, similar_pairs(groups, threshold)
