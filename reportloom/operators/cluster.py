"""Document clustering and cluster description."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from reportloom.functions.constants import ENGLISH_STOP_WORDS
from reportloom.functions.text import clean_text_for_modeling, split_sentences
from reportloom.operators import blocks as B
from reportloom.operators.small import top_n_per_group, with_each
from reportloom.operators.vectors import bm25, projected, tfidf, unit_length
from reportloom.operators.ward import MICRO, cluster_features, micro_clusters, ward_cuts, ward_merges
from reportloom.session import materialize


DIMS = 128
KS = range(2, 9)  # numbers of clusters to try


def model_vectors(
    docs: DataFrame, text: str = "content", key: str = "record_id", dims: int = DIMS,
    min_df: int = 1, stop_words: Sequence[str] = ENGLISH_STOP_WORDS, weighting: str = "tfidf", tf_scheme: str = "raw", idf_scheme: str = "smooth",
) -> DataFrame:
    """``(key, features)``: TF-IDF or BM25 weights of all terms at unit length, projected to ``dims`` numbers.

    ``weighting`` is ``tfidf``, with the schemes given, or ``bm25``. Terms are not hashed to places; documents without a term are left out.
    """
    if weighting == "tfidf":
        weights = tfidf(docs, text, key, stop_words, min_df, tf_scheme=tf_scheme, idf_scheme=idf_scheme)
    elif weighting == "bm25":
        weights = unit_length(bm25(docs, text, key, stop_words, min_df), key)
    else:
        raise ValueError(f"unknown weighting: {weighting}")
    return projected(weights, dims, key).select(key, array_to_vector("vector").alias("features"))


def _fit(vectors: DataFrame, k: int, method: str, seed: int) -> DataFrame:
    kind = BisectingKMeans if method == "bisecting" else KMeans
    model = kind(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(vectors)
    return model.transform(vectors)


def _labeller(vectors: DataFrame, ks: Sequence[int], method: str, seed: int, micro: int) -> Callable[[int], DataFrame]:
    """Labels for a number of clusters. Ward's tree is built once and cut for every number."""
    if method != "ward":
        return lambda k: _fit(vectors, k, method, seed)
    assigned = materialize(micro_clusters(vectors, micro, seed), "micro")
    features = materialize(cluster_features(assigned), "features")
    cuts = ward_cuts(features, ward_merges(features), ks)
    # A row per micro-cluster, so at most ``micro`` rows travel.
    return lambda k: assigned.join(F.broadcast(cuts.filter(F.col("k") == k).drop("k")), "micro")


def choose_clusters(
    vectors: DataFrame, ks: Sequence[int] | None = None, min_cluster_size: int = 3,
    method: str = "kmeans", seed: int = 42, key: str = "record_id", micro: int = MICRO,
) -> tuple[DataFrame, DataFrame]:
    """Best labelling and the metrics of every number of clusters tried.

    ``method`` is ``kmeans``, ``bisecting``, or ``ward`` through ``micro`` micro-clusters. Solutions with a tiny cluster or a size ratio over ten are skipped; the rest
    score silhouette · (1 − ratio/20). If none is left the best silhouette wins.
    """
    vectors = materialize(vectors, "vectors")
    spark = vectors.sparkSession
    n_docs = vectors.count()
    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")
    label = _labeller(vectors, ks or KS, method, seed, micro)
    tried, labelled = [], {}
    for k in ks or KS:
        if k > n_docs:
            continue
        labels = label(k)
        sizes = [r["n"] for r in labels.groupBy("cluster").agg(F.count("*").alias("n")).collect()]
        if len(sizes) < 2:
            continue
        silhouette = evaluator.evaluate(labels)
        ratio = max(sizes) / min(sizes)
        ok = min(sizes) >= min_cluster_size and ratio <= 10
        tried.append((k, len(sizes), silhouette, ratio, silhouette * (1 - ratio / 20), ok))
        labelled[k] = labels
    if not tried:
        k = min(ks or KS)
        labelled[k] = label(k)
        best = k
    else:
        valid = [t for t in tried if t[5]]
        best = max(valid, key=lambda t: t[4])[0] if valid else max(tried, key=lambda t: t[2])[0]
    metrics = spark.createDataFrame(
        [(*t, t[0] == best) for t in tried],
        "k int, clusters int, silhouette double, balance_ratio double, score double, "
        "eligible boolean, chosen boolean",
    )
    return labelled[best].select(key, "cluster"), metrics


def cluster_documents(docs: DataFrame, text: str = "content", key: str = "record_id", **options) -> tuple[DataFrame, DataFrame]:
    """Clean, vectorise and cluster a corpus; documents without text are left out."""
    vector_options = {
        n: options.pop(n) for n in ("min_df", "dims", "stop_words", "weighting", "tf_scheme", "idf_scheme") if n in options
    }
    # Written: the terms and the number of documents both read it, and the texts are cleaned once.
    clean = materialize(docs.select(key, clean_text_for_modeling(text).alias("clean")).filter("clean <> ''"), "clean")
    return choose_clusters(model_vectors(clean, "clean", key, **vector_options), key=key, **options)


def optimise_parameters(
    docs: DataFrame, grid: dict[str, Sequence] | None = None,
    text: str = "content", key: str = "record_id", seed: int = 42,
) -> DataFrame:
    """Score every parameter combination: silhouette − 0.1·|clusters − target|.

    Vectors are built once, for the most directions; fewer are their first numbers. Labels are made once per (directions,
    target); combinations that share them reuse the result.
    """
    grid = grid or {"target": [3, 5, 7, 10], "min_cluster_size": [2, 3, 5], "dims": [64, 128, 256]}
    names = ["target", "min_cluster_size", "dims"]
    clean = docs.select(key, clean_text_for_modeling(text).alias("clean")).filter("clean <> ''")
    clean = materialize(clean, "clean")
    most = max(grid["dims"])
    widest = materialize(model_vectors(clean, "clean", key, most), "vectors")
    vectors, fitted, rows = {most: widest}, {}, []
    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")
    for target, smallest, dims in product(*[grid[n] for n in names]):
        if dims not in vectors:
            first = F.slice(vector_to_array("features"), 1, dims)
            scaled = F.transform(first, lambda x: x * float(most / dims) ** 0.5)
            vectors[dims] = materialize(widest.select(key, array_to_vector(scaled).alias("features")), "vectors")
        if (dims, target) not in fitted:
            labels = _fit(vectors[dims], target, "kmeans", seed)
            sizes = [r["n"] for r in labels.groupBy("cluster").agg(F.count("*").alias("n")).collect()]
            fitted[dims, target] = (sizes, evaluator.evaluate(labels) if len(sizes) > 1 else 0.0)
        sizes, silhouette = fitted[dims, target]
        kept = sum(1 for s in sizes if s >= smallest)
        rows.append((target, smallest, dims, kept, silhouette, silhouette - abs(kept - target) * 0.1))
    return docs.sparkSession.createDataFrame(
        rows, "target int, min_cluster_size int, dims int, clusters int, silhouette double, score double",
    ).orderBy(F.desc("score"), "target", "min_cluster_size", "dims")


# --- description of given clusters: weights (key, term, weight) or blocks of them, labels (key, cluster)

def cluster_sizes(labels: DataFrame) -> DataFrame:
    """Size, share and balance ratio of every cluster."""
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("size"))
    everything = Window.partitionBy()  # one row per cluster
    return sizes.withColumns({
        "size_pct": F.round(F.col("size") * 100.0 / F.sum("size").over(everything), 1),
        "balance_ratio": F.round(
            F.max("size").over(everything) / F.min("size").over(everything), 4
        ),
    })


Weights = DataFrame | B.WeightBlocks


def members(weights: Weights, labels: DataFrame, key: str = "record_id") -> Weights:
    """``(key, cluster, times, term, weight)``: the weights of labelled documents, written once for all steps that read them.

    ``times`` is the number of labels of a key, as often as its weights are listed. Weights that were just scaled
    per document are dealt out by key already, so that this join moves labels only. What was made here may be handed
    on as the weights of the functions below. Blocks get the labels of their documents instead, no weight is moved.
    """
    if isinstance(weights, B.WeightBlocks):
        return weights if weights.placed else B.place_labels(weights, labels)
    if "times" in weights.columns:
        return weights
    counted = labels.withColumn("times", F.count("*").over(Window.partitionBy(key)))
    return materialize(weights.join(counted.select(key, "cluster", "times"), key).select(key, "cluster", "times", "term", "weight"), "members")


def centroids(weights: Weights, labels: DataFrame, key: str = "record_id") -> DataFrame:
    """Mean weight per cluster and term; documents without the term count as 0."""
    if isinstance(weights, B.WeightBlocks):
        return _centroids(members(weights, labels, key), labels)
    placed = weights if "times" in weights.columns else weights.join(labels, key)
    return _centroids(placed, labels)


def _centroids(placed: Weights, labels: DataFrame) -> DataFrame:
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("size"))
    if isinstance(placed, B.WeightBlocks):
        sums = B.cluster_sums(placed)
    else:
        sums = placed.groupBy("cluster", "term").agg(
            F.sum("weight").alias("total"), F.count("*").alias("docs")
        )
    return sums.join(F.broadcast(sizes), "cluster").select(  # a row per cluster
        "cluster", "term", (F.col("total") / F.col("size")).alias("centroid"), "docs", "size"
    )


def cluster_terms(weights: Weights, labels: DataFrame, n: int = 20, key: str = "record_id") -> DataFrame:
    """Top terms: centroid weight × frequency in the cluster over frequency overall."""
    center = materialize(centroids(weights, labels, key), "centroids")
    n_docs = labels.select(F.count("*")).scalar()
    totals = center.groupBy("term").agg(F.sum("docs").alias("term_docs"))
    in_cluster = F.col("docs") / F.col("size")
    overall = F.col("term_docs") / n_docs
    scored = center.filter("centroid > 0").join(totals, "term").select(
        "cluster", "term",
        F.round(F.col("centroid") * in_cluster / (overall + 1e-10), 6).alias("score"),
        F.round(in_cluster, 4).alias("cluster_frequency"),
        F.round(overall, 4).alias("total_frequency"),
    )
    return top_n_per_group(scored, "cluster", n, F.desc("score"), F.asc("term"))


def representative_documents(weights: Weights, labels: DataFrame, key: str = "record_id") -> DataFrame:
    """Cosine of each document to the centroid of its cluster."""
    placed = members(weights, labels, key)
    center = materialize(_centroids(placed, labels).select("cluster", "term", "centroid"), "centroids")
    lengths = center.groupBy("cluster").agg(
        F.sqrt(F.sum(F.col("centroid") * F.col("centroid"))).alias("length")
    )
    if isinstance(placed, B.WeightBlocks):
        # A key with several labels in one cluster lists its weights as often.
        times = labels.groupBy(key, "cluster").agg(F.count("*").alias("_n"))
        found = B.products(placed, center, own_only=True).withColumnRenamed("other", "cluster").join(B.squared_lengths(placed), key)
        dots = found.join(times, [key, "cluster"]).select(
            key, "cluster", (F.col("dot") * F.col("_n")).alias("dot"), F.sqrt(F.col("_own") * F.col("_n")).alias("own")
        )
    else:
        dots = placed.drop("times").join(center, ["cluster", "term"]).groupBy(key, "cluster").agg(
            F.sum(F.col("weight") * F.col("centroid")).alias("dot"),
            F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("own"),
        )
    similarity = F.try_divide(F.col("dot"), F.col("own") * F.col("length"))
    return labels.join(dots, [key, "cluster"], "left").join(F.broadcast(lengths), "cluster", "left").select(
        key, "cluster", F.round(F.coalesce(similarity, F.lit(0.0)), 4).alias("similarity")
    )


def cohesion(weights: Weights, labels: DataFrame, key: str = "record_id") -> DataFrame:
    """Mean cosine inside each cluster over all pairs, diagonal included.

    For unit vectors that is the squared length of their mean, so no pair is formed;
    small cosines are not cut off. A document without terms counts as zero.
    """
    square = F.col("centroid") * F.col("centroid")
    means = centroids(weights, labels, key).groupBy("cluster").agg(F.sum(square).alias("_c"))
    sizes = labels.groupBy("cluster").agg(F.count("*").alias("size"))
    return sizes.join(means, "cluster", "left").select(
        "cluster", "size", F.round(F.coalesce("_c", F.lit(0.0)), 4).alias("cohesion")
    )


def _distances(placed: Weights, center: DataFrame, labels: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Squared length of every document; per cluster: size, squared length of the mean, mean squared length; and products.

    The products ``(key, other, dot)`` of documents with the means of clusters are over shared terms. They are summed in
    one pass over the members and written, one row per document and cluster.
    """
    # A key with several labels lists its weights as often.
    once = F.col("weight") / F.col("times")
    in_blocks = isinstance(placed, B.WeightBlocks)
    squares = B.squared_lengths(placed) if in_blocks else placed.groupBy(key).agg(F.sum(F.col("weight") * once).alias("_own"))
    own = labels.join(squares, key, "left")
    own = materialize(own.select(key, "cluster", F.coalesce("_own", F.lit(0.0)).alias("own")), "lengths")
    norms = center.groupBy("cluster").agg(F.sum(F.col("centroid") * F.col("centroid")).alias("norm"))
    stats = own.groupBy("cluster").agg(F.count("*").alias("size"), F.avg("own").alias("mean_own"))
    stats = materialize(stats.join(norms, "cluster", "left").na.fill(0.0, ["norm"]), "cluster-stats")
    if in_blocks:
        return own, stats, B.products(placed, center)
    # The means of a term are one list of at most a row per cluster, so a weight travels once, whatever the number of clusters.
    listed = center.groupBy("term").agg(F.collect_list(F.struct(F.col("cluster").alias("other"), "centroid")).alias("_means"))
    met = placed.select(key, "term", once.alias("_once")).join(listed, "term")
    dots = met.select(key, "_once", F.inline("_means")).groupBy(key, "other").agg(F.sum(F.col("_once") * F.col("centroid")).alias("dot"))
    return own, stats, materialize(dots, "products")


def silhouette(weights: Weights, labels: DataFrame, key: str = "record_id") -> DataFrame:
    """Silhouette of every document of a given labelling, in squared distances, without pairs of documents.

    The mean squared distance to a cluster follows from its mean and mean squared length. Documents meet clusters on
    shared terms only. A cluster without a shared term is at least as far as the nearest of all
    clusters would be without one, so the two smallest mean lengths stand for all of them. A cluster of
    one document has silhouette 0.
    """
    placed = members(weights, labels, key)
    center = materialize(_centroids(placed, labels), "centroids")
    return _silhouette(*_distances(placed, center, labels, key), key)


def _silhouette(own: DataFrame, stats: DataFrame, dots: DataFrame, key: str) -> DataFrame:
    sizes = stats.select(F.col("cluster").alias("other"), "size", "mean_own")
    known = own.join(dots, key, "left").join(F.broadcast(sizes), "other", "left")
    apart = F.greatest(F.col("own") - 2 * F.col("dot") + F.col("mean_own"), F.lit(0.0))
    here = F.col("cluster") == F.col("other")
    per = known.groupBy(key, "cluster", "own").agg(
        F.max(F.when(here, F.col("dot"))).alias("_dot"), F.min(F.when(~here, apart)).alias("_near")
    )
    # Two clusters with the smallest mean squared length: one of them is not the document's own.
    least = stats.orderBy("mean_own", "cluster").limit(2).agg(
        F.sort_array(F.collect_list(F.struct("mean_own", "cluster"))).alias("two")
    ).select("two").scalar()
    other = F.get(F.filter("_two", lambda c: c["cluster"] != F.col("cluster")), F.lit(0))["mean_own"]
    n = F.col("size")
    inside = F.greatest(F.col("own") - 2 * F.coalesce("_dot", F.lit(0.0)) + F.col("mean_own"), F.lit(0.0)) * n / (n - 1)
    scored = per.join(F.broadcast(stats.select("cluster", "size", "mean_own")), "cluster").withColumn("_two", least).withColumns({
        "_a": F.when(n > 1, inside), "_b": F.least("_near", F.col("own") + other),
    })
    value = F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), F.lit(0.0))
    return scored.select(key, "cluster", value.alias("silhouette"))


def cluster_quality(weights: Weights, labels: DataFrame, key: str = "record_id") -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin index and mean silhouette from per-cluster sums."""
    placed = members(weights, labels, key)
    center = materialize(_centroids(placed, labels), "centroids")
    own, stats, products = _distances(placed, center, labels, key)
    # A key with several labels in one cluster counted as often in the product with its own mean.
    times = labels.groupBy(key, "cluster").agg(F.count("*").alias("_n"))
    dots = products.join(times, (products[key] == times[key]) & (products["other"] == times["cluster"])).groupBy(products[key]).agg(
        F.sum(F.col("dot") * F.col("_n")).alias("dot")
    )
    distance = F.greatest(F.col("own") - 2 * F.coalesce("dot", F.lit(0.0)) + F.col("norm"), F.lit(0.0))
    per_cluster = own.join(dots, key, "left").join(F.broadcast(stats), "cluster").groupBy("cluster").agg(
        F.count("*").alias("size"), F.sum(distance).alias("within"),
        F.avg(F.sqrt(distance)).alias("spread"), F.max("norm").alias("norm"),
    )
    per_cluster = materialize(per_cluster, "per-cluster")  # a row per cluster
    overall = center.groupBy("term").agg(
        F.sum(F.col("centroid") * F.col("size")).alias("total")
    ).agg(F.sum(F.col("total") * F.col("total"))).scalar()
    totals = per_cluster.agg(
        F.sum("size").alias("n"), F.count("*").cast("int").alias("k"),
        F.sum(F.col("norm") * F.col("size")).alias("between"), F.sum("within").alias("within"),
    )
    between = F.col("between") - overall / F.col("n")
    calinski = F.try_divide(between * (F.col("n") - F.col("k")), F.col("within") * (F.col("k") - 1))
    return totals.select(
        F.col("n").alias("documents"), F.col("k").alias("clusters"),
        F.round(calinski, 4).alias("calinski_harabasz"),
        F.round(_davies_bouldin(per_cluster, center), 4).alias("davies_bouldin"),
        F.round(_silhouette(own, stats, products, key).select(F.avg("silhouette")).scalar(), 4).alias("silhouette"),
    )


def _davies_bouldin(per_cluster: DataFrame, center: DataFrame) -> Column:
    """Mean over clusters of the worst ratio of spread to gap; a cluster per row, met with the others by key."""
    shared = center.select("cluster", "term", "centroid")
    dots = shared.join(
        shared.select(F.col("cluster").alias("other"), "term", F.col("centroid").alias("_c")), "term"
    ).groupBy("cluster", "other").agg(F.sum(F.col("centroid") * F.col("_c")).alias("dot"))
    pairs = with_each(
        per_cluster.select("cluster", F.col("spread").alias("_s"), F.col("norm").alias("_n")),
        per_cluster.withColumnRenamed("cluster", "other"), "other", "spread", "norm",
    ).filter(F.col("cluster") != F.col("other"))
    joined = pairs.join(dots, ["cluster", "other"], "left")
    gap = F.sqrt(F.greatest(F.col("_n") + F.col("norm") - 2 * F.coalesce("dot", F.lit(0.0)), F.lit(0.0)))
    worst = joined.groupBy("cluster").agg(F.max(F.coalesce(F.try_divide(F.col("_s") + F.col("spread"), gap), F.lit(0.0))).alias("worst"))
    return worst.select(F.avg("worst")).scalar()


def cluster_summary(terms: DataFrame, sizes: DataFrame, max_length: int | None = None) -> DataFrame:
    """A sentence per cluster from its leading terms and its size."""
    cut = (lambda c: c) if max_length is None else (lambda c: F.substring(c, 1, max_length))
    listed = terms.groupBy("cluster").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda t: t["term"]).alias("t")
    )
    n = F.col("size")
    band = _size_band(n)
    size = F.size("t")
    lead = F.concat(
        F.lit("This cluster focuses on "), F.get("t", F.lit(0)), F.lit(", "), F.get("t", F.lit(1)),
        F.lit(" and "), F.get("t", F.lit(2)), F.lit("."),
    )
    related = F.when(size > 3, F.concat(
        F.lit(" Related concepts include "), F.array_join(F.slice("t", 4, 3), ", "), F.lit(".")
    )).otherwise("")
    small = F.concat(
        F.lit("Small cluster with "), n.cast("string"), F.lit(" documents focusing on general themes.")
    )
    top = F.slice("t", 1, 5)
    count = F.size(top)
    focus = (
        F.when(count >= 2, F.concat(
            F.lit("This cluster focuses on "), F.array_join(F.slice(top, 1, count - 1), ", "),
            F.lit(" and "), F.get(top, count - 1), F.lit("."),
        ))
        .when(count == 1, F.concat(F.lit("This cluster focuses on "), F.get(top, F.lit(0)), F.lit(".")))
        .otherwise("This cluster contains miscellaneous documents.")
    )
    joined = sizes.join(listed, "cluster", "left").withColumn(
        "t", F.coalesce("t", F.array().cast("array<string>"))
    )
    return joined.select(
        "cluster", "size",
        F.when(F.size("t") >= 3, cut(F.concat(lead, band, related)))
        .otherwise(small).alias("summary"),
        F.when(F.size("t") == 0, "No significant terms found for this cluster.")
        .otherwise(F.concat(focus, band)).alias("overview"),
    )


def _size_band(n: Column) -> Column:
    return (
        F.when(n > 10, F.concat(F.lit(" This is a major theme appearing in "), n.cast("string"), F.lit(" documents.")))
        .when(n > 5, F.concat(F.lit(" This theme appears in "), n.cast("string"), F.lit(" documents.")))
        .otherwise(F.concat(F.lit(" This is a smaller theme with "), n.cast("string"), F.lit(" documents.")))
    )


def within_budget(
    ranked: DataFrame, group: str, length: Column, max_length: int, *order: Column
) -> DataFrame:
    """Leading rows of each group whose lengths add up to the budget at most.

    Stops at the first row that does not fit. Every row has at least one
    character, so more than ``max_length`` rows can never be chosen and each
    group is cut to that many before its running total is built.
    """
    rows = ranked.withColumn("_len", length).filter("_len > 0")
    cut = top_n_per_group(_leading(rows, group, max_length, *order), group, max_length, *order, rank="position")
    running = F.sum("_len").over(
        Window.partitionBy(group).orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    )
    return cut.withColumn("_total", running).filter(F.col("_total") <= max_length).drop("_len", "_total")


BUDGET_PARTS = 256  # parts of a group that are cut on their own


def _leading(rows: DataFrame, group: str, max_length: int, *order: Column) -> DataFrame:
    """Rows that may fit the budget, found inside parts of each group, so no task reads a whole group.

    A row behind one that exceeds the budget in its own part exceeds it in the group too. The first one that
    does stays in every part, so the running total of the group stops where it did.
    """
    parts = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(BUDGET_PARTS)))
    ahead = F.sum("_len").over(
        Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return parts.withColumn("_ahead", F.coalesce(ahead, F.lit(0))).filter(F.col("_ahead") <= max_length).drop("_part", "_ahead")


def extractive_summary(
    docs: DataFrame, labels: DataFrame, max_length: int = 500, text: str = "content",
    key: str = "record_id", stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
) -> DataFrame:
    """Highest scoring sentences of each cluster, up to a length, with source.

    The score is the mean TF-IDF weight of a sentence over the vocabulary of its
    cluster. Equal sentences share their term counts, so each is weighted once. Texts move once, to their labels;
    sentences are ranked by their numbers and only the chosen ones are read again.
    """
    labelled = docs.select(key, text).join(labels.select(key, "cluster"), key)
    sentences = materialize(split_sentences(labelled, text, [key, "cluster"]).select(
        F.monotonically_increasing_id().alias("_row"), "cluster", key, "sentence_idx", "sentence",
        F.concat_ws("|", key, "sentence_idx").alias("sid"),
    ), "sentences")
    known = sentences.filter(F.col("cluster").isNotNull())
    # A row per cluster.
    sizes = {r["cluster"]: r["n"] for r in known.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    blocks = B.tfidf_blocks(known.select(F.struct("cluster", "sid").alias("_of"), "sentence"), "sentence", "_of", stop_words, F.col("_of.cluster").cast("string"))
    width = B.group_vocabulary(blocks)
    scores = B.unit_sums(blocks, sizes).withColumn("group", F.col("cluster").cast("string")).join(F.broadcast(width), "group").select(
        "cluster", "sid", F.round(F.col("total") / F.col("vocabulary"), 10).alias("score")
    )
    lean = sentences.select("_row", "cluster", key, "sentence_idx", "sid", F.length("sentence").alias("_chars"))
    ranked = materialize(lean.join(scores, ["cluster", "sid"], "left").na.fill(0.0, ["score"]).drop("sid"), "ranked")
    chosen = within_budget(
        ranked, "cluster", F.col("_chars"), max_length,
        F.desc("score"), F.asc(key), F.asc("sentence_idx"),
    )
    # Their lengths keep to the budget, so few rows a cluster travel to the texts.
    return sentences.select("_row", "sentence").join(F.broadcast(chosen), "_row").select("cluster", "position", key, "sentence", "score")


def size_defaults(docs: DataFrame) -> DataFrame:
    """Parameter defaults for the number of documents."""
    n = F.col("n")
    smallest = F.when(n < 10, 2).when(n < 20, 3).when(n < 50, 4).otherwise(5)
    return docs.agg(F.count("*").cast("int").alias("n")).select(
        F.col("n").alias("documents"),
        smallest.alias("min_cluster_size"),
        F.when(n < 20, 2000).when(n < 50, 3000).when(n < 100, 4000).otherwise(5000).alias("max_features"),
        F.greatest(F.lit(2), F.floor(n * 0.05).cast("int")).alias("min_docs"),
        F.least(F.floor(n * 0.95).cast("int"), n - smallest).alias("max_docs"),
    )


def cluster_records(docs: DataFrame, representative: DataFrame, key: str = "record_id") -> DataFrame:
    """Full records of the cluster members, best match first."""
    return docs.join(representative, key).orderBy("cluster", F.desc("similarity"), key)


def cluster_export(summaries: DataFrame, terms: DataFrame, representative: DataFrame, docs: DataFrame, key: str = "record_id", documents: int = 10) -> DataFrame:
    """One JSON text per cluster: metadata, terms and leading documents."""
    term_list = terms.groupBy("cluster").agg(
        F.sort_array(F.collect_list(F.struct("rank", "term", "score"))).alias("terms")
    )
    best = top_n_per_group(representative, "cluster", documents, F.desc("similarity"), F.asc(key))
    meta = docs.select(key, "title", F.col("date_of_report").cast("string").alias("date"))
    doc_list = best.join(meta, key).groupBy("cluster").agg(
        F.sort_array(F.collect_list(F.struct("rank", key, "title", "date", "similarity"))).alias("documents")
    )
    joined = summaries.join(term_list, "cluster", "left").join(doc_list, "cluster", "left")
    return joined.select("cluster", F.to_json(F.struct(*joined.columns)).alias("json"))
