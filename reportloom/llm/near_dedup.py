"""Near-duplicate detection by fast similarity sketching, banding and exact verification.

Every class of equal shingle sets gets one sketch of T coordinates: in rounds,
each shingle is thrown into a bin, and a bin keeps the least value; the later
rounds throw all shingles into one bin after the other, so that every
coordinate is filled for certain. Classes whose sketches agree in a band are candidates, which
are confirmed on their full sets and joined to components.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from reportloom.llm.common import hash_words, mix, private, text_slices, words_of
from reportloom.session import materialize

WORDS = 5
T = 384  # coordinates of a sketch at most
MISSED = 3e-7  # of pairs at the very threshold so many may share no band
EMPTY = np.uint64((1 << 64) - 1)


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): the longest bands that miss at most ``MISSED`` of the pairs at ``percent``.

    48 bands of 8 coordinates at 85, 50 of 6 at 80; of pairs above the threshold fewer are
    missed. A low threshold that ``T`` coordinates do not serve takes bands of one and more coordinates.
    """
    def bands(rows: int) -> int:
        shared = (percent / 100) ** rows
        return 1 if shared >= 1 else math.ceil(math.log(MISSED) / math.log1p(-max(shared, 1e-12)))

    rows = max((r for r in range(1, T + 1) if bands(r) * r <= T), default=1)
    return bands(rows), rows


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles, sorted by both.

    Words are those of the text with A-Z in lower case; a text of one to four words is
    one shingle, a text without words has none.
    """
    owner, vocabulary, codes = words_of(pc.ascii_lower(pc.fill_null(texts, "")))
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = hash_words(vocabulary)[codes]
    counts = np.bincount(owner, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    place = np.arange(len(codes)) - first[owner]
    last = np.minimum(place + WORDS, counts[owner]) - place  # words in the window from here
    starts = (place + WORDS <= counts[owner]) | ((place == 0) & (counts[owner] < WORDS))
    at = np.flatnonzero(starts)
    value = mix(last[at].astype(np.uint64), 1)
    for k in range(WORDS):
        inside = k < last[at]
        word = hashes[np.minimum(at + k, len(hashes) - 1)]
        value = np.where(inside, mix(value ^ word, k + 2), value)
    doc = owner[at]
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def sketches(doc: np.ndarray, value: np.ndarray, n_docs: int, t: int = T) -> np.ndarray:
    """Sketch of every document (rows of ``t`` values); documents without shingles keep EMPTY.

    A coordinate is the round in which the bin was filled, above 44 bits of hash, so an
    earlier round always wins and the least hash of that round is kept.
    """
    out = np.full(n_docs * t, EMPTY, np.uint64)
    for turn in range(2 * t):
        if not len(doc):
            break
        hashed = mix(value, 100 + turn)
        low = hashed & np.uint64((1 << 44) - 1)
        if turn < t:
            bins = ((hashed >> np.uint64(44)) * np.uint64(t)) >> np.uint64(20)
        else:
            bins = np.full(len(doc), turn - t, np.uint64)
        np.minimum.at(out, doc * t + bins.astype(np.int64), (np.uint64(turn) << np.uint64(44)) | low)
        # A document whose bins are all filled takes part in no further round.
        present = np.unique(doc)
        open_docs = present[(out.reshape(n_docs, t)[present] == EMPTY).any(axis=1)]
        if len(open_docs) < len(present):
            stay = np.zeros(n_docs, bool)
            stay[open_docs] = True
            doc, value = doc[stay[doc]], value[stay[doc]]
    return out.reshape(n_docs, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for every band of every row; the number of the band is part of it."""
    keys = np.empty((len(sketch), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(sketch), band + 1, np.uint64)
        for k in range(rows):
            key = mix(key ^ sketch[:, band * rows + k], 7)
        keys[:, band] = key
    return keys


def _sketch_batches(bands: int, rows: int):
    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for start, stop in text_slices(texts):
                n = stop - start
                doc, value = shingle_sets(texts.slice(start, n))
                size = np.bincount(doc, minlength=n)
                edges = np.concatenate(([0], np.cumsum(size)))
                raw = value.tobytes()
                names = [
                    hashlib.blake2b(raw[8 * edges[i]:8 * edges[i + 1]], digest_size=16).digest() if size[i] else None
                    for i in range(n)
                ]
                keys = band_keys(sketches(doc, value, n, bands * rows), bands, rows).view(np.int64)
                offsets = np.arange(0, (n + 1) * bands, bands, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, n), batch.column("text_hash").slice(start, n), pa.array(size, pa.int64()),
                     pa.array(names, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1)))],
                    names=["doc_id", "text_hash", "n_shingles", "node", "bands"],
                )

    return run


def _set_batches(batches):
    for batch in batches:
        texts = batch.column("text")
        for start, stop in text_slices(texts):
            n = stop - start
            doc, value = shingle_sets(texts.slice(start, n))
            offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").slice(start, n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(value.view(np.int64)))],
                names=["node", "shingles"],
            )


def sketch_documents(documents: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (names the set; null if empty) and bands of every document."""
    bands, length = banding(percent)
    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(_sketch_batches(bands, length), "doc_id long, text_hash long, n_shingles long, node binary, bands array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have an intersection of at least ``percent`` of their union.

    A member of many pairs is joined last, where its own small set is copied to
    the parts that the join is split into.
    """
    left = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("b_set")), "b")
    both = left.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("a_set")), "a")
    common = F.size(F.array_intersect("a_set", "b_set"))
    return both.filter(100 * common >= percent * (F.size("a_set") + F.size("b_set") - common)).select("a", "b")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): every linked node with the least node that it can reach.

    Large-star and small-star steps in turn: each step points the neighbours of a
    node at its least neighbour. Counts are reduced on the map side, the
    joins may be split, and every step is written down. Stops when nothing changes.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = materialize(edges, "component-links")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = materialize(small.unionByName(joined.select("u", F.col("m").alias("v"))).distinct(), "component-links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


def _candidate_sets(documents: DataFrame, sketched: DataFrame, pairs: DataFrame) -> DataFrame:
    """Full sets of the nodes in ``pairs``, made again from one text of each."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    one = sketched.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
    one = one.select("node", F.col("row.doc_id").alias("doc_id"), F.col("row.text_hash").alias("text_hash"))
    texts = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    found = texts.alias("t").join(
        one.alias("o"), F.col("t.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("t.text_hash") == F.col("o.text_hash"))
    ).select("o.node", "t.text").dropDuplicates(["node"])
    return found.mapInArrow(_set_batches, "node binary, shingles array<long>")


def near_links(documents: DataFrame, sketched: DataFrame, percent: int = 85) -> DataFrame:
    """(node, label) of all nodes that are linked with others.

    First every member of a band's bucket is compared with the head of that bucket, the member
    that shares most buckets with others. Then,
    in buckets that still hold several components, members of different
    components are compared if their sizes, without the shingles that only one
    node holds, allow the similarity; members of one component need no
    comparison. So a large group of near copies costs one comparison per
    member and bucket, and no link between components is missed.
    """
    nodes = sketched.filter("node is not null").groupBy("node").agg(
        F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    rows = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = materialize(rows.join(shared, "bucket"), "buckets")
    # The text that others were copied from shares more buckets than they do among each other.
    weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
    heads = members.join(weights, "node").groupBy("bucket").agg(F.max(F.struct("weight", "node"))["node"].alias("head"))
    pairs = members.join(heads, "bucket").filter("head <> node")
    pairs = materialize(pairs.select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct(), "head-pairs")
    sets = materialize(_candidate_sets(documents, sketched, pairs), "sets")
    links = materialize(verified(pairs, sets, percent), "links")
    labels = materialize(components(links), "labels")
    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).drop("size")
    mixed = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    open_rows = materialize(named.join(mixed.select("bucket"), "bucket"), "open-buckets")
    able = _able_nodes(open_rows.select("node", "n").distinct(), sets, percent)
    sides = open_rows.join(able, "node").join(nodes.select("node", "bands"), "node")
    a, b = (sides.select("bucket", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "own", "label", "bands"))) for side in "ab")
    # Of several buckets that two nodes share only the first brings them together.
    most = F.least(F.col("n_a") - F.col("own_a"), F.col("n_b") - F.col("own_b"))
    fits = (
        (F.col("label_a") != F.col("label_b")) & (F.col("node_a") < F.col("node_b"))
        & (100 * most >= percent * (F.col("n_a") + F.col("n_b") - most))
        & (F.array_intersect("bands_a", "bands_b")[0] == F.col("bucket"))
    )
    rest = a.join(b, "bucket").filter(fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    rest = materialize(rest.join(pairs, ["a", "b"], "left_anti"), "rest-pairs")
    more = materialize(verified(rest, sets, percent), "links")
    if more.isEmpty():
        return labels
    # Only the components that further links join are labelled anew.
    over = more
    for side in "ab":
        over = over.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"_{side}")), side, "left")
        over = over.withColumn(side, F.coalesce(f"_{side}", side)).drop(f"_{side}")
    merged = materialize(components(over).select(F.col("node").alias("label"), F.col("label").alias("final")), "labels")
    alone = merged.join(labels, merged["label"] == labels["node"], "left_anti").select(F.col("label").alias("node"), "final")
    final = labels.join(merged, "label", "left").select("node", F.coalesce("final", "label").alias("label"))
    return final.unionByName(alone.select("node", F.col("final").alias("label")))


def _able_nodes(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, own): the nodes that may have a link at all, and how many shingles only they hold.

    What a node alone holds is in no intersection, so a node of which more than
    the allowed difference is its own has no link. Without such nodes the others' own
    shingles are counted once more.
    """
    able = nodes
    for _ in range(2):
        listed = able.select("node").join(sets, "node").select("node", F.explode("shingles").alias("shingle"))
        single = listed.groupBy("shingle").agg(F.count("*").alias("held"), F.min("node").alias("node")).filter("held = 1")
        own = single.groupBy("node").agg(F.count("*").alias("own"))
        counted = able.select("node", "n").join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
        able = materialize(counted.filter(100 * F.col("own") <= (100 - percent) * F.col("n")), "able-nodes")
    return able.select("node", "own")


def near_duplicates(documents: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document, with its text_hash.

    ``component_id`` is the least doc_id that links reach, the document's own
    included; ``kept`` tells whether it is the document's own. Texts without words are linked with nothing, rows
    without doc_id take part like others but name no component. Repeated rows
    are equal sets; an empty table gives an empty result.
    """
    sketched = materialize(sketch_documents(documents, percent), "sketches")
    labels = near_links(documents, sketched, percent)
    slim = sketched.select("doc_id", "text_hash", "n_shingles", "node")
    classes = slim.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    labelled = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    named = labelled.join(least, "label").select("node", "component_id")
    empty = slim.filter("node is null").withColumn("component_id", F.col("doc_id"))
    full = slim.filter("node is not null").join(named, "node")
    out = full.select("doc_id", "text_hash", "n_shingles", "component_id").unionByName(empty.drop("node"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_first(documents: DataFrame, percent: int = 85) -> DataFrame:
    """The documents that are first in their component, with their own columns.

    Documents are matched by doc_id and text; only the names of those to be dropped are joined.
    """
    marked = near_duplicates(documents, percent).filter(~F.col("kept"))
    own_id, own_hash = private(documents, "_dropped_id"), private(documents, "_dropped_hash")
    dropped = marked.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).distinct()
    own, hashed = F.col("doc_id").cast("long"), private(documents, "_text_hash")
    rows = documents.withColumn(hashed, F.xxhash64("text"))
    gone: Column = own.eqNullSafe(F.col(own_id)) & (F.col(hashed) == F.col(own_hash))
    return rows.join(dropped, gone, "left_anti").drop(hashed)
