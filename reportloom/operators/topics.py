"""Topics and what is derived from them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from reportloom.functions.constants import ENGLISH_STOP_WORDS
from reportloom.functions.text import clean_text_for_modeling, tokens
from reportloom.operators.blocks import numbers, small
from reportloom.operators.dictionary import number_terms
from reportloom.operators.search import occurrences
from reportloom.operators.small import top_n_per_group
from reportloom.operators.vectors import term_counts
from reportloom.session import discard, materialize, materialize_buckets


class TopicModel:
    """A fitted model with its tables; all of them are DataFrames."""

    def __init__(self, words: DataFrame, shares: DataFrame, documents: DataFrame, fit: DataFrame):
        self.words = words          # topic, word, weight (whole vocabulary; the weights of a topic sum to 1)
        self.shares = shares        # record_id, topic, share
        self.documents = documents  # record_id, clean, copies
        self.fit = fit              # step, log_likelihood, objective (with the priors)

    def top_words(self, n: int = 10) -> DataFrame:
        return top_n_per_group(self.words, "topic", n, F.desc("weight"), F.asc("word"))

    def mean_shares(self) -> DataFrame:
        return self.shares.groupBy("topic").agg(F.avg("share").alias("mean_share"))


def start_weights(ids: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Uneven first weights of terms, by a hash of term and topic."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64)[:, None] * np.uint64(k) + np.arange(k, dtype=np.uint64) + np.uint64(seed * 1_000_003 + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return 0.5 + ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def expectation(
    rows: np.ndarray, columns: np.ndarray, tf: np.ndarray, theta: np.ndarray, phi: np.ndarray, alpha: float, inner: int = 3,
) -> tuple[np.ndarray, np.ndarray, float]:
    """(new topic shares of documents, expected counts of terms, log-likelihood before) for counts in coordinates.

    The shares of documents are improved a few times for given words, then the counts are shared out; no
    step lowers the objective.
    """
    weights, fit = phi[columns], None
    for _ in range(inner):
        joint = theta[rows] * weights
        total = joint.sum(axis=1)
        if fit is None:
            fit = float(tf @ np.log(total))
        expected = joint * (tf / total)[:, None]
        theta = np.stack([np.bincount(rows, expected[:, t], len(theta)) for t in range(theta.shape[1])], axis=1) + alpha
        theta /= theta.sum(axis=1, keepdims=True)
    joint = theta[rows] * weights
    expected = joint * (tf / joint.sum(axis=1))[:, None]
    counts = np.stack([np.bincount(columns, expected[:, t], len(phi)) for t in range(theta.shape[1])], axis=1)
    return theta, counts, fit


SHARD_ROWS = 250_000  # counts of a block, about; a document is never split
SHARD_CHARS = 16_000_000, 64_000_000  # characters of a shard, about: no fewer for the sake of more tasks, no more for memory
SHARD_TOPICS = 5  # with more topics than these a shard has fewer characters
BLOCK = "shard long, first long, docs array<{key}>, n_terms long, terms binary, ends binary, columns binary, tf binary, new array<string>"


def _shard_numbers(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers that hash partitioning deals to ``n`` partitions, one each."""
    found = spark.range(64 * n + 64).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("part")).agg(F.min("id").alias("id"))
    return [r["id"] for r in found.collect()]


def count_blocks(texts: DataFrame, key: str, shards: Sequence[int], stop_words: Sequence[str], block_rows: int = SHARD_ROWS) -> DataFrame:
    """The sparse count matrix of ``(key, clean)``, in blocks of documents; shards of blocks share a numbering of their terms.

    Only texts are shuffled. A block lists its terms by their place in the shard, and the terms that are new in the shard.
    """
    n = len(shards)
    words = F.filter(tokens("clean"), lambda w: ~w.isin(*stop_words)) if stop_words else tokens("clean")
    own = F.element_at(F.lit(list(shards)), (F.pmod(F.xxhash64(key), F.lit(n)) + 1).cast("int")).cast("long")
    dealt = texts.filter(F.col(key).isNotNull()).withColumn("shard", own).repartition(n, "shard")
    if not texts.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        dealt = dealt.groupBy("shard", key).agg(F.concat_ws(" ", F.collect_list("clean")).alias("clean"))
    schema = BLOCK.format(key=texts.schema[key].dataType.simpleString())
    names = [field.split(" ")[0] for field in schema.split(", ")]

    def run(batches):
        held: dict[int, list] = {}
        known: dict[int, pa.Array] = {}
        done: dict[int, int] = {}

        def block(shard: int) -> pa.RecordBatch:
            keys, sizes, flat = (pa.concat_arrays(parts) for parts in zip(*held.pop(shard)))
            coded = flat.dictionary_encode()
            many, sizes = max(len(coded.dictionary), 1), sizes.to_numpy()
            rows = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
            cells, tf = np.unique(rows * many + coded.indices.to_numpy(), return_counts=True)
            seen = known.get(shard, pa.array([], pa.string()))
            place = pc.index_in(coded.dictionary, value_set=seen).to_numpy(zero_copy_only=False)
            fresh = np.isnan(place) if place.dtype.kind == "f" else np.zeros(len(place), bool)
            at = np.where(fresh, 0, place).astype(np.int64)
            at[fresh] = len(seen) + np.arange(fresh.sum())
            new = coded.dictionary.filter(pa.array(fresh))
            known[shard] = pa.concat_arrays([seen, new])
            first = done.get(shard, 0)
            done[shard] = first + len(keys)
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int64()), pa.array([first], pa.int64()), one(keys),
                pa.array([len(at)], pa.int64()), pa.array([small(at)], pa.binary()),
                pa.array([np.bincount(cells // many, minlength=len(sizes)).cumsum().astype("<i8").tobytes()], pa.binary()),
                pa.array([small(cells % many)], pa.binary()), pa.array([small(tf)], pa.binary()), one(new),
            ], names=names)

        for batch in batches:
            shard_of = batch.column("shard").to_numpy()
            listed = batch.column("_w")
            sizes = pc.list_value_length(listed).to_numpy()
            for shard in np.unique(shard_of):
                rows = np.flatnonzero((shard_of == shard) & (sizes > 0))
                if not len(rows):
                    continue
                for some in np.split(rows, np.flatnonzero(np.diff(np.cumsum(sizes[rows]) // block_rows)) + 1):
                    at = pa.array(some)
                    mine = listed.take(at)
                    held.setdefault(int(shard), []).append((batch.column(key).take(at), pc.list_value_length(mine), mine.flatten()))
                    if sum(len(part[2]) for part in held[int(shard)]) >= block_rows:
                        yield block(int(shard))
        for shard in [*held]:
            yield block(shard)

    listed = dealt.select("shard", key, words.alias("_w")).filter(F.size("_w") > 0)
    return materialize_buckets(listed.mapInArrow(run, schema), "count-blocks", n, "shard")


def _em_step(blocks: DataFrame, right: DataFrame, k: int, alpha: float) -> DataFrame:
    """One step over the blocks, which stay where they are: expected counts per term, shares per document, likelihood before.

    Of the right side a row with a term has its place and weights, one without a document's place and shares. The
    result has a row per term, a row per document with its shard, and one with the likelihood and the prior.
    """
    schema = "shard long, place long, term_id long, " + ", ".join(f"s{t} double" for t in range(k)) + ", fit double, prior double"
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table({name: pa.array([], pa.float64() if i > 2 else pa.int64()) for i, name in enumerate(names)})
        term = np.asarray(right.column("term_id").is_valid())
        place = right.column("place").to_numpy()
        cells = np.stack([right.column(f"p{t}").to_numpy() for t in range(k)], axis=1)
        weights = np.empty((int(term.sum()), k))
        weights[place[term]] = cells[term]
        ids = np.empty(len(weights), np.int64)
        ids[place[term]] = right.column("term_id").filter(pa.array(term)).to_numpy()
        ends = left.column("ends").to_pylist()
        own = np.full((sum(len(raw) // 8 for raw in ends), k), 1.0 / k)
        own[place[~term]] = cells[~term]
        theta, counts, fit = np.empty_like(own), np.zeros_like(weights), 0.0
        prior = alpha * float(np.log(own).sum())
        for i, raw in enumerate(ends):
            upto = np.frombuffer(raw, "<i8")
            many, first = int(upto[-1]), left.column("first")[i].as_py()
            columns, tf = (numbers(left.column(c)[i].as_py(), many) for c in ("columns", "tf"))
            terms = numbers(left.column("terms")[i].as_py(), left.column("n_terms")[i].as_py()).astype(np.int64)
            rows = np.repeat(np.arange(len(upto)), np.diff(upto, prepend=0))
            at = slice(first, first + len(upto))
            theta[at], found, likely = expectation(rows, columns.astype(np.int64), tf.astype(np.float64), own[at], weights[terms], alpha)
            counts[terms] += found
            fit += likely
        shard, docs = left.column("shard")[0].as_py(), len(own)
        stacked = np.vstack([counts, theta, np.zeros((1, k))])
        kinds = [pa.nulls(len(ids), pa.int64()), pa.nulls(1, pa.int64())]
        last = lambda value: pa.concat_arrays([pa.nulls(len(stacked) - 1, pa.float64()), pa.array([value], pa.float64())])
        return pa.table([
            pa.concat_arrays([kinds[0], pa.array(np.full(docs, shard)), kinds[1]]), pa.concat_arrays([kinds[0], pa.array(np.arange(docs)), kinds[1]]),
            pa.concat_arrays([pa.array(ids), pa.nulls(docs + 1, pa.int64())]), *(pa.array(stacked[:, t]) for t in range(k)), last(fit), last(prior),
        ], names=names)

    done = blocks.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(run, schema)
    sums = [F.sum(c).alias(c) for c in (*(f"s{t}" for t in range(k)), "fit", "prior")]
    return materialize(done.groupBy("shard", "place", "term_id").agg(*sums), "topic-step")


def _weights_after(out: DataFrame, k: int, beta: float, n_terms: int) -> DataFrame:
    """(term_id, p0, p1, ...): the weights of terms from the expected counts of a step, every topic summing to 1."""
    sums = out.filter("term_id is not null")
    totals = sums.agg(*[F.coalesce(F.sum(f"s{t}"), F.lit(0.0)).alias(f"s{t}") for t in range(k)]).first()  # one row of sums
    return sums.select("term_id", *[((F.col(f"s{t}") + beta) / (totals[f"s{t}"] + n_terms * beta)).alias(f"p{t}") for t in range(k)])


def fit_topics(
    docs: DataFrame, k: int = 5, text: str = "content", key: str = "record_id", iterations: int = 12, seed: int = 42,
    deduplicate: bool = True, stop_words: Sequence[str] = ENGLISH_STOP_WORDS, alpha: float = 0.1, beta: float = 0.01,
    shard_rows: int = SHARD_ROWS,
) -> TopicModel:
    """Topics of the cleaned corpus by EM with Dirichlet priors; equal cleaned texts count once.

    Every term has a number and weights of its own. Counts are blocks of documents in as many shards as tasks run at
    once, or more, as a task holds a shard; they are written by shard and never shuffled. A step brings the weights of its terms and the shares of its documents
    to each shard, and expected counts go back to be summed per term, so weights are a table partitioned by term and
    neither vocabulary nor documents reach the driver. Tables of a step are deleted when the next one is written. ``alpha`` and ``beta`` are added to the counts of a topic in a document
    and of a term in a topic.
    """
    clean = docs.select(key, clean_text_for_modeling(text).alias("clean")).filter("clean <> ''")
    if deduplicate:
        clean = clean.groupBy(F.sha2("clean", 256).alias("_same")).agg(
            F.min(F.struct(key, "clean")).alias("first"), F.count("*").alias("copies")
        ).select(f"first.{key}", "first.clean", "copies")
    else:
        clean = clean.withColumn("copies", F.lit(1).cast("long"))
    clean = materialize(clean, "clean")
    spark = clean.sparkSession
    size = clean.agg(F.coalesce(F.sum(F.length("clean")), F.lit(0))).first()[0]
    least, most = SHARD_CHARS[0], SHARD_CHARS[1] * SHARD_TOPICS // max(k, SHARD_TOPICS)
    shards = _shard_numbers(spark, max(1, min(spark.sparkContext.defaultParallelism, -(-size // least)), -(-size // most)))
    blocks = count_blocks(clean.select(key, "clean"), key, shards, stop_words, shard_rows)
    # Blocks list their new terms in the order of places; a shard's blocks follow each other by their first document.
    before = F.sum(F.size("new")).over(Window.partitionBy("shard").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    placed = blocks.select("shard", F.coalesce(before, F.lit(0)).alias("_before"), "new").select(
        "shard", "_before", F.posexplode("new").alias("_i", "term")).select("shard", (F.col("_before") + F.col("_i")).alias("place"), "term")
    # Terms of documents without a key have a number and a first weight, as they have counts.
    unkeyed = term_counts(clean.filter(F.col(key).isNull()), "clean", key, stop_words).select("term")
    dictionary = number_terms(placed.select("term").unionByName(unkeyed), "term")
    vocabulary = materialize_buckets(
        placed.join(dictionary, "term").select("shard", "place", "term_id").repartition(4 * len(shards), "term_id"), "shard-terms", 4 * len(shards), "term_id")

    def first(batches):
        for batch in batches:
            w = start_weights(batch.column("term_id").to_numpy(), k, seed)
            yield pa.RecordBatch.from_arrays([batch.column("term_id"), *(pa.array(w[:, t]) for t in range(k))], names=["term_id", *(f"p{t}" for t in range(k))])

    weights = ", ".join(f"p{t} double" for t in range(k))
    raw = materialize(dictionary.select("term_id").mapInArrow(first, f"term_id long, {weights}"), "topic-start")
    started = raw.agg(F.count("*").alias("n"), *[F.sum(f"p{t}").alias(f"p{t}") for t in range(k)]).first()  # one row of sums
    phi = raw.select("term_id", *[(F.col(f"p{t}") / (started[f"p{t}"] or 1.0)).alias(f"p{t}") for t in range(k)])
    left = blocks.select("shard", "first", "n_terms", "terms", "ends", "columns", "tf")
    theta = None
    steps, last = [], raw
    for step in range(iterations):
        right = vocabulary.join(phi, "term_id").select("shard", "place", "term_id", *[f"p{t}" for t in range(k)])
        if theta is not None:
            right = right.unionByName(theta.select("shard", "place", F.lit(None).cast("long").alias("term_id"), *[F.col(f"s{t}").alias(f"p{t}") for t in range(k)]))
        out = _em_step(left, right, k, alpha)
        prior = phi.select(sum((F.sum(F.log(f"p{t}")) for t in range(k)), F.lit(0.0)) * beta).first()[0]  # one number
        found = out.agg(F.sum("fit").alias("fit"), F.sum("prior").alias("prior")).first()  # one row of sums
        steps.append((step, found["fit"], None if found["fit"] is None or prior is None else found["fit"] + found["prior"] + prior))
        theta = out.filter("shard is not null")
        phi = _weights_after(out, k, beta, started["n"])
        discard(last)  # weights and shares come from this step now
        last = out
    fit = spark.createDataFrame(steps, "step int, log_likelihood double, objective double")
    topics = F.explode(F.arrays_zip(F.array(*map(F.lit, range(k))).alias("topic"), F.array(*[f"p{t}" for t in range(k)]).alias("weight")))
    words = phi.join(dictionary, "term_id").select(F.col("term").alias("word"), topics.alias("_t")).select("_t.topic", "word", "_t.weight")
    shares = _document_shares(blocks, theta, clean, key, k)
    return TopicModel(materialize(words, "topic_words"), materialize(shares, "topic_shares"), clean, fit)


def _document_shares(blocks: DataFrame, theta: DataFrame, clean: DataFrame, key: str, k: int) -> DataFrame:
    """(key, topic, share) of every document with at least one term."""
    listed = blocks.select("shard", "first", F.posexplode("docs").alias("_i", key)).select("shard", (F.col("first") + F.col("_i")).alias("place"), key)
    shares = F.posexplode(F.array(*[f"s{t}" for t in range(k)])).alias("topic", "share")
    # A key of several cleaned texts is listed as often.
    return listed.join(theta, ["shard", "place"]).join(clean.select(key), key).select(key, shares)


def topic_export(model: TopicModel, n: int = 10) -> DataFrame:
    """JSON text per topic: leading words, total weight, mean share."""
    totals = model.words.groupBy("topic").agg(F.sum("weight").alias("total_weight"))
    listed = model.top_words(n).groupBy("topic").agg(
        F.sort_array(F.collect_list(F.struct("rank", "word", "weight"))).alias("words")
    )
    joined = listed.join(totals, "topic").join(model.mean_shares(), "topic")
    return joined.select("topic", F.to_json(F.struct(*joined.columns)).alias("json"))


def topic_insights(
    model: TopicModel, docs: DataFrame, key: str = "record_id", n_words: int = 50, n_docs: int = 10,
    excerpt_length: int | None = None,
) -> DataFrame:
    """Label, words with document counts, leading documents and prevalence.

    Counts and prevalence are over documents: a text counts as often as it occurs.
    ``excerpt_length`` cuts the texts of the leading documents.
    """
    frequency = model.documents.select(
        "copies", F.explode(F.array_distinct(F.split("clean", " "))).alias("word")
    ).groupBy("word").agg(F.sum("copies").alias("documents"))
    words = model.top_words(n_words).filter(F.length("word") > 1).join(frequency, "word", "left")
    word_list = words.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct(
        "rank", "word", "weight", F.coalesce("documents", F.lit(0)).alias("documents")
    ))).alias("words"))
    best = top_n_per_group(
        model.shares.filter("share > 0.01"), "topic", n_docs, F.desc("share"), F.asc(key)
    )
    text = F.col("content")
    excerpt = text
    if excerpt_length is not None:
        cut = F.concat(F.substring(text, 1, excerpt_length), F.lit("..."))
        excerpt = F.when(F.length(text) > excerpt_length, cut).otherwise(text)
    # At most ``n_docs`` rows a topic travel to the texts, not the texts to them.
    doc_list = docs.select(key, "title", F.col("date_of_report").cast("string").alias("date"), excerpt.alias("summary")).join(
        F.broadcast(best), key
    ).groupBy("topic").agg(F.sort_array(F.collect_list(F.struct(
        "rank", key, "title", "date", F.col("share").alias("relevance"), "summary"
    ))).alias("documents"))
    counted = model.shares.join(model.documents.select(key, "copies"), key)
    present = F.sum(F.when(F.col("share") > 0.05, F.col("copies")).otherwise(0))
    prevalence = counted.groupBy("topic").agg(F.round(100.0 * present / F.sum("copies"), 1).alias("prevalence"))
    leading = F.transform(F.slice("words", 1, 5), lambda w: w["word"])
    return word_list.join(doc_list, "topic", "left").join(prevalence, "topic").select(
        "topic", F.initcap(F.array_join(F.slice(leading, 1, 3), " & ")).alias("label"),
        F.concat(F.lit("Topic frequently mentions: "), F.array_join(leading, ", ")).alias("description"),
        "words", "documents", "prevalence",
    )


def topic_coherence(docs: DataFrame, topic_words: DataFrame, text: str = "content", key: str = "record_id") -> DataFrame:
    """Mean number of documents that contain both words of a pair, per topic.

    Pairs that never occur together are dropped. Documents collapse to the set of
    topic words they contain before pairs are formed.
    """
    found = occurrences(docs, topic_words.select(F.col("word").alias("keyword")), text, key, once=True).select(key, "keyword")
    words = topic_words.select("topic", F.col("word")).distinct()
    rows = found.join(words, F.lower("word") == F.col("keyword")).groupBy(key, "topic").agg(
        F.sort_array(F.collect_set("word")).alias("present")
    ).filter(F.size("present") > 1)
    sets = rows.groupBy("topic", "present").agg(F.count("*").alias("n"))
    first = sets.select("topic", "present", "n", F.posexplode("present").alias("i", "word_a"))
    pairs = first.select(
        "topic", "n", "word_a", F.explode(F.slice("present", F.col("i") + 2, F.size("present"))).alias("word_b")
    ).groupBy("topic", "word_a", "word_b").agg(F.sum("n").alias("together"))
    return pairs.groupBy("topic").agg(F.round(F.avg("together"), 4).alias("coherence"))


def overall_coherence(per_topic: DataFrame) -> DataFrame:
    return per_topic.agg(F.round(F.coalesce(F.avg("coherence"), F.lit(0.0)), 4).alias("coherence"))


def word_edges(words: DataFrame, max_words: int = 30, min_similarity: float = 0.9) -> DataFrame:
    """Similar word pairs by the cosine of their topic weights.

    Only the ``max_words`` heaviest words (at most a hundred) take part.
    """
    heaviest = words.groupBy("word").agg(F.sum("weight").alias("total")).orderBy(
        F.desc("total"), "word"
    ).limit(max_words)
    rows = words.join(heaviest, "word", "left_semi")
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("word")))
    unit = rows.withColumn("w", F.try_divide(F.col("weight"), length))
    per_topic = unit.groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("word", "w"))).alias("ws"))
    first = per_topic.select("ws", F.posexplode("ws").alias("i", "x"))
    pairs = first.select("x", F.explode(F.slice("ws", F.col("i") + 2, F.size("ws"))).alias("y"))
    return pairs.groupBy(F.col("x.word").alias("word_a"), F.col("y.word").alias("word_b")).agg(
        F.sum(F.col("x.w") * F.col("y.w")).alias("similarity")
    ).filter(F.col("similarity") > min_similarity)


def word_network(words: DataFrame, max_words: int = 30, min_similarity: float = 0.9, min_connections: int = 5) -> DataFrame:
    """Nodes with enough connections, their degree, and the network's density."""
    edges = word_edges(words, max_words, min_similarity)
    ends = edges.select(F.explode(F.array("word_a", "word_b")).alias("word"))
    nodes = ends.groupBy("word").agg(F.count("*").alias("degree")).filter(F.col("degree") >= min_connections)
    kept = edges.join(nodes.select(F.col("word").alias("word_a")), "word_a", "left_semi").join(
        nodes.select(F.col("word").alias("word_b")), "word_b", "left_semi"
    )
    n_edges = kept.select(F.count("*")).scalar()
    size = F.count("*").over(Window.partitionBy())  # at most max_words rows
    return nodes.select(
        "word", "degree", n_edges.alias("edges"),
        F.round(F.try_divide(2.0 * n_edges, size * (size - 1)), 4).alias("density"),
    )
