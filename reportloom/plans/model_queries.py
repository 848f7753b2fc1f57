"""Term weight, similarity, clustering and topic queries."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from reportloom.functions.constants import ENGLISH_STOP_WORDS
from reportloom.operators import blocks as B, cluster as K, topics as O, vectors as X, ward as W
from reportloom.plans.registry import query
from reportloom.plans.tables import DOCS_SQL, docs, table
from reportloom.plans.text_queries import SENTENCES_SQL, sql_list
from reportloom.session import materialize, scratch_path
from reportloom.sources.files import read_json_lines, write_json_lines

_COUNTS = f"""counts AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (
      SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents)
      WHERE NOT list_contains({sql_list(ENGLISH_STOP_WORDS)}, term) GROUP BY 1, 2),
    nd AS (SELECT count(*)::DOUBLE AS n FROM documents)"""
_VOCAB = f"""{_COUNTS}, vocab AS MATERIALIZED (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, any_value(n) AS n FROM counts CROSS JOIN nd
      GROUP BY term),
    vc AS (SELECT doc_id, counts.term, tf, df, n FROM counts JOIN vocab USING (term))"""


def _weights_sql(tf: str = "tf", idf: str = "ln((n + 1) / (df + 1)) + 1") -> str:
    return f"""{_VOCAB}, raw_w AS (SELECT doc_id, term, ({tf}) * ({idf}) AS w FROM vc),
    wt AS MATERIALIZED (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw_w)"""


def _counts(spark, d):
    return X.term_counts(docs(spark, d))


def _vocab(spark, d):
    r = docs(spark, d)
    return X.vocabulary(X.term_counts(r), X.document_count(r))


def _weights(spark, d, tf="raw", idf="smooth"):
    return X.tfidf(docs(spark, d), tf_scheme=tf, idf_scheme=idf)


def _blocks(spark, d):
    """Weights in blocks of documents, for the description of clusters."""
    return B.tfidf_blocks(docs(spark, d))


def _labels(spark, d):
    """The language of a document serves as its cluster."""
    return docs(spark, d).select("record_id", F.col("lang").alias("cluster"))


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 4) for c in columns})


def _by_doc(df):
    return df.withColumnRenamed("record_id", "doc_id")


@query("x1_term_counts", f"WITH {_COUNTS} SELECT doc_id, term, tf FROM counts")
def _(spark, d):
    return _by_doc(_counts(spark, d))


@query("x1_vocabulary", f"WITH {_VOCAB} SELECT term, df, cf FROM vocab")
def _(spark, d):
    return _vocab(spark, d).select("term", "df", "cf")


@query("x1_bigrams", f"""
    WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({sql_list(ENGLISH_STOP_WORDS)}, x)) AS w FROM documents),
    b AS (SELECT doc_id, unnest(list_zip(w[:-2], w[2:])) AS p FROM w WHERE len(w) > 1),
    t AS (SELECT p[1] || ' ' || p[2] AS term FROM b)
    SELECT term, count(*) AS cf FROM t GROUP BY 1
""")
def _(spark, d):
    both = X.term_counts(docs(spark, d), bigrams=True)
    return both.filter(F.contains("term", F.lit(" "))).groupBy("term").agg(F.sum("tf").alias("cf"))


_TF = {
    "raw": "tf", "log": "ln(1 + tf)", "binary": "1.0",
    "augmented": "0.5 + 0.5 * tf / max(tf) OVER (PARTITION BY doc_id)",
}


@query("x2_tf_schemes", f"""
    WITH {_VOCAB} SELECT doc_id, term, tf::DOUBLE AS raw, round(ln(1 + tf), 4) AS log, 1.0::DOUBLE AS binary,
      round(0.5 + 0.5 * tf / max(tf) OVER (PARTITION BY doc_id), 4) AS augmented FROM vc
""")
def _(spark, d):
    known = X.in_vocabulary(_counts(spark, d), _vocab(spark, d))
    return _by_doc(known.select("record_id", "term", *[F.round(X.tf_weight(s), 4).alias(s) for s in _TF]))


@query("x3_idf_schemes", f"""
    WITH {_COUNTS}, v AS (SELECT term, count(*) AS df, any_value(n) AS n FROM counts CROSS JOIN nd GROUP BY 1)
    SELECT term, round(ln((n + 1) / (df + 1)) + 1, 4) AS smooth, round(ln(n / df) + 1, 4) AS standard,
      CASE WHEN n > df THEN round(ln((n - df) / df), 4) END AS probabilistic FROM v
""")
def _(spark, d):
    r = docs(spark, d)
    vocab = X.vocabulary(X.term_counts(r), X.document_count(r))
    return vocab.select("term", *[F.round(X.idf_weight(s), 4).alias(s) for s in ("smooth", "standard", "probabilistic")])


@query("x4_tfidf", f"WITH {_weights_sql()} SELECT doc_id, term, round(weight, 4) AS weight FROM wt")
def _(spark, d):
    return _by_doc(_rounded(_weights(spark, d), "weight"))


@query("x4_tfidf_log_standard", f"WITH {_weights_sql('ln(1 + tf)', 'ln(n / df) + 1')} SELECT doc_id, term, round(weight, 4) AS weight FROM wt")
def _(spark, d):
    return _by_doc(_rounded(_weights(spark, d, "log", "standard"), "weight"))


_BM25 = f"""{_VOCAB}, len AS (SELECT doc_id, sum(tf) AS dl FROM vc GROUP BY 1),
    av AS (SELECT sum(tf) / any_value(n) AS avgdl FROM vc),
    bm AS (SELECT doc_id, term, 2.5 * tf / (1.5 * (0.25 + 0.75 * dl / avgdl) + tf) * ln((n - df + 0.5) / (df + 0.5) + 1) AS weight
      FROM vc JOIN len USING (doc_id) CROSS JOIN av)"""


def _bm25(spark, d):
    return X.bm25(docs(spark, d))


@query("x5_bm25", f"WITH {_BM25} SELECT doc_id, term, round(weight, 4) AS weight FROM bm")
def _(spark, d):
    return _by_doc(_rounded(_bm25(spark, d), "weight"))


@query("x6_rank_documents", f"""
    WITH {_BM25} SELECT doc_id, round(sum(weight), 4) AS score FROM bm WHERE term IN ('attion', 'thanedble', 'tion') GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 20
""")
def _(spark, d):
    return _by_doc(X.rank_documents(_bm25(spark, d), ["attion", "thanedble", "tion"], 20))


_PAIRS = f"""{_weights_sql()}, sig AS MATERIALIZED (SELECT doc_id, string_agg(term || ':' || tf, ',' ORDER BY term) AS s FROM vc GROUP BY 1),
    rep AS MATERIALIZED (SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS rep FROM sig),
    rw AS MATERIALIZED (SELECT doc_id, term, weight FROM wt WHERE doc_id IN (SELECT rep FROM rep)),
    pairs AS MATERIALIZED (SELECT a.doc_id AS left_id, b.doc_id AS right_id, sum(a.weight * b.weight) AS cosine
      FROM rw a JOIN rw b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING sum(a.weight * b.weight) >= 0.8 - 1e-9)"""


# Documents with equal vectors are one group; j9 lists the groups' members.
@query("x7_similar_pairs", f"WITH {_PAIRS} SELECT left_id, right_id, round(cosine, 4) AS cosine FROM pairs")
def _(spark, d):
    return _rounded(X.similar_documents(docs(spark, d), 0.8)[2], "cosine")


@query("j9_copy_groups", f"""
    WITH {_PAIRS} SELECT doc_id, rep, count(*) OVER (PARTITION BY rep) AS copies FROM rep
""")
def _(spark, d):
    signatures, groups = X.grouped_vectors(docs(spark, d))
    return signatures.join(groups.select("signature", "rep", "copies"), "signature").select(
        F.col("record_id").alias("doc_id"), "rep", "copies")


@query("x8_cluster_documents")
def _(spark, d):
    return K.cluster_documents(docs(spark, d))[0]


@query("x8_cluster_metrics")
def _(spark, d):
    return K.cluster_documents(docs(spark, d))[1]


@query("x8_cluster_metrics_bm25")
def _(spark, d):
    return K.cluster_documents(docs(spark, d), weighting="bm25")[1]


@query("x8_ward_documents")
def _(spark, d):
    return K.cluster_documents(docs(spark, d), method="ward")[0]


@query("x8_ward_metrics")
def _(spark, d):
    return K.cluster_documents(docs(spark, d), method="ward")[1]


def _embedded(spark, d):
    """Vectors of the embeddings table whose entries are all finite."""
    whole = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = table(spark, d, "embeddings").filter(whole)
    return rows.select(F.col("vec_id").alias("record_id"), array_to_vector("embedding").alias("features"), "label")


@query("x8_ward_merges")
def _(spark, d):
    return W.ward_merges(W.cluster_features(W.micro_clusters(materialize(_embedded(spark, d), "embedded"))))


_FEATURES = """feats AS (SELECT label AS micro, count(DISTINCT vec_id) AS size, sum(x * x) AS squares FROM (
      SELECT vec_id, label, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label IS NOT NULL) GROUP BY 1),
    sums AS (SELECT label AS micro, pos, sum(x) AS t FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos
      FROM embeddings WHERE label IS NOT NULL) GROUP BY 1, 2)"""


@query("x8_cluster_features", f"""
    WITH {_FEATURES} SELECT micro, size, round(any_value(squares), 4) AS squares, round(sum(t * t), 3) AS total_square
    FROM feats JOIN sums USING (micro) GROUP BY 1, 2
""")
def _(spark, d):
    # The given labels serve as micro-clusters.
    found = W.cluster_features(_embedded(spark, d).filter("label is not null"), "label")
    total = F.aggregate("total", F.lit(0.0), lambda a, x: a + x * x)
    return found.select("micro", "size", F.round("squares", 4).alias("squares"), F.round(total, 3).alias("total_square"))


# The cheapest merge of all is the first of the tree.
@query("x8_ward_first_merge", f"""
    WITH {_FEATURES}, pairs AS (SELECT a.micro AS "left", b.micro AS "right", any_value(f.size + g.size) AS size,
        sqrt(2 * any_value(f.size * g.size / (f.size + g.size)::DOUBLE) * sum((a.t / f.size - b.t / g.size) ** 2)) AS height
      FROM sums a JOIN feats f ON f.micro = a.micro JOIN sums b ON b.pos = a.pos AND b.micro > a.micro JOIN feats g ON g.micro = b.micro GROUP BY 1, 2)
    SELECT "left", "right", size, round(height, 4) AS height FROM pairs ORDER BY pairs.height, 1, 2 LIMIT 1
""")
def _(spark, d):
    merges = W.ward_merges(W.cluster_features(_embedded(spark, d).filter("label is not null"), "label"))
    return merges.filter("step = 0").select("left", "right", "size", F.round("height", 4).alias("height"))


_CLUSTER = f"""{_weights_sql()}, lab AS (SELECT doc_id, lang AS cluster FROM documents),
    size AS (SELECT cluster, count(*) AS size FROM lab GROUP BY 1),
    cen AS MATERIALIZED (SELECT cluster, term, sum(weight) / any_value(size) AS centroid, count(*) AS docs, any_value(size) AS size
      FROM wt JOIN lab USING (doc_id) JOIN size USING (cluster) GROUP BY 1, 2)"""


_TERMS = f"""{_CLUSTER}, sc AS (SELECT cluster, term, round(centroid * (docs::DOUBLE / size) / (td / n + 1e-10), 6) AS score,
        round(docs::DOUBLE / size, 4) AS cluster_frequency, round(td / n, 4) AS total_frequency
      FROM cen JOIN (SELECT term, sum(docs)::DOUBLE AS td FROM cen GROUP BY 1) USING (term) CROSS JOIN nd),
    terms AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term)::INT AS rank FROM sc QUALIFY rank <= 20)"""


@query("x9_cluster_terms", f"WITH {_TERMS} SELECT * FROM terms")
def _(spark, d):
    return K.cluster_terms(_blocks(spark, d), _labels(spark, d))


@query("x10_representative_documents", f"""
    WITH {_CLUSTER}, cl AS (SELECT cluster, sqrt(sum(centroid * centroid)) AS length FROM cen GROUP BY 1),
    dots AS (SELECT doc_id, cluster, sum(weight * centroid) AS dot, sqrt(sum(weight * weight)) AS own FROM wt JOIN lab USING (doc_id) JOIN cen USING (cluster, term) GROUP BY 1, 2)
    SELECT lab.doc_id, lab.cluster, coalesce(round(dot / (own * length), 4), 0) AS similarity FROM lab LEFT JOIN dots USING (doc_id, cluster) LEFT JOIN cl USING (cluster)
""")
def _(spark, d):
    return _by_doc(K.representative_documents(_blocks(spark, d), _labels(spark, d)))


@query("j3_cluster_records", f"""
    WITH {DOCS_SQL}, {_CLUSTER}, cl AS (SELECT cluster, sqrt(sum(centroid * centroid)) AS length FROM cen GROUP BY 1),
    dots AS (SELECT doc_id, cluster, sum(weight * centroid) AS dot, sqrt(sum(weight * weight)) AS own FROM wt JOIN lab USING (doc_id) JOIN cen USING (cluster, term) GROUP BY 1, 2)
    SELECT record_id, title, coroner_area, lab.cluster, coalesce(round(dot / (own * length), 4), 0) AS similarity
    FROM docs JOIN lab ON lab.doc_id = record_id LEFT JOIN dots ON dots.doc_id = record_id LEFT JOIN cl ON cl.cluster = lab.cluster
""")
def _(spark, d):
    best = K.representative_documents(_blocks(spark, d), _labels(spark, d))
    return K.cluster_records(docs(spark, d).select("record_id", "title", "coroner_area"), best)


@query("x11_cluster_sizes", f"""
    WITH size AS (SELECT lang AS cluster, count(*) AS size FROM documents GROUP BY 1)
    SELECT cluster, size, round(size * 100.0 / sum(size) OVER (), 1)::DOUBLE AS size_pct,
      round(max(size) OVER () / (min(size) OVER ())::DOUBLE, 4) AS balance_ratio FROM size
""")
def _(spark, d):
    return K.cluster_sizes(_labels(spark, d))


@query("x11_cohesion", f"""
    WITH {_CLUSTER} SELECT size.cluster, size.size, round(coalesce(sum(centroid * centroid), 0), 4) AS cohesion
    FROM size LEFT JOIN cen ON cen.cluster = size.cluster GROUP BY 1, 2
""")
def _(spark, d):
    return K.cohesion(_blocks(spark, d), _labels(spark, d))


@query("x12_cluster_quality", f"""
    WITH {_CLUSTER}, norms AS (SELECT cluster, sum(centroid * centroid) AS norm FROM cen GROUP BY 1),
    own AS (SELECT doc_id, sum(weight * weight) AS own FROM wt GROUP BY 1),
    dots AS (SELECT doc_id, sum(weight * centroid) AS dot FROM wt JOIN lab USING (doc_id) JOIN cen USING (cluster, term) GROUP BY 1),
    dist AS (SELECT lab.doc_id, cluster, greatest(coalesce(own, 0) - 2 * coalesce(dot, 0) + coalesce(norm, 0), 0) AS d2
      FROM lab LEFT JOIN own USING (doc_id) LEFT JOIN dots USING (doc_id) LEFT JOIN norms USING (cluster)),
    per AS (SELECT cluster, count(*) AS size, sum(d2) AS within, avg(sqrt(d2)) AS spread, coalesce(any_value(norm), 0) AS norm FROM dist LEFT JOIN norms USING (cluster) GROUP BY 1),
    tot AS (SELECT sum(t * t) AS t2 FROM (SELECT sum(centroid * size) AS t FROM cen GROUP BY term)),
    lm AS (SELECT lab.doc_id, lab.cluster, coalesce(own, 0) AS own, other.cluster AS other, other.size AS size, msq FROM lab LEFT JOIN own USING (doc_id)
      CROSS JOIN (SELECT cluster, count(*) AS size, avg(coalesce(own, 0)) AS msq FROM lab LEFT JOIN own USING (doc_id) GROUP BY 1) other),
    dc AS (SELECT doc_id, cen.cluster AS other, sum(weight * centroid) AS dot FROM wt JOIN cen USING (term) GROUP BY 1, 2),
    ds AS (SELECT doc_id, lm.cluster, lm.other, size, greatest(own - 2 * coalesce(dot, 0) + msq, 0) AS d FROM lm LEFT JOIN dc USING (doc_id, other)),
    sil AS (SELECT doc_id, max(CASE WHEN cluster = other AND size > 1 THEN d * size / (size - 1) END) AS a, min(CASE WHEN cluster <> other THEN d END) AS b FROM ds GROUP BY 1),
    cd AS (SELECT a.cluster AS a, b.cluster AS b, sum(a.centroid * b.centroid) AS dot FROM cen a JOIN cen b USING (term) GROUP BY 1, 2),
    r AS (SELECT p.cluster, max((p.spread + q.spread) / sqrt(p.norm + q.norm - 2 * coalesce(dot, 0))) AS worst
      FROM per p JOIN per q ON p.cluster <> q.cluster LEFT JOIN cd ON cd.a = p.cluster AND cd.b = q.cluster GROUP BY 1),
    s AS (SELECT sum(size) AS n, count(*) AS k, sum(norm * size) AS ns, sum(within) AS w FROM per)
    SELECT n::BIGINT AS documents, k::INT AS clusters, round((ns - t2 / n) * (n - k) / (w * (k - 1)), 4) AS calinski_harabasz,
      (SELECT round(avg(worst), 4) FROM r) AS davies_bouldin,
      (SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 4) FROM sil) AS silhouette FROM s CROSS JOIN tot
""")
def _(spark, d):
    return K.cluster_quality(_blocks(spark, d), _labels(spark, d))


@query("x12_document_silhouette", f"""
    WITH {_CLUSTER}, own AS (SELECT doc_id, sum(weight * weight) AS own FROM wt GROUP BY 1),
    o AS (SELECT lab.doc_id, cluster, coalesce(own, 0) AS own FROM lab LEFT JOIN own USING (doc_id)),
    st AS (SELECT cluster AS other, count(*) AS size, avg(own) AS msq FROM o GROUP BY 1),
    dc AS (SELECT doc_id, cen.cluster AS other, sum(weight * centroid) AS dot FROM wt JOIN cen USING (term) GROUP BY 1, 2),
    ds AS (SELECT o.doc_id, cluster, st.other, size, greatest(own - 2 * coalesce(dot, 0) + msq, 0) AS d
      FROM o CROSS JOIN st LEFT JOIN dc ON dc.doc_id = o.doc_id AND dc.other = st.other),
    sil AS (SELECT doc_id, cluster, max(CASE WHEN cluster = other AND size > 1 THEN d * size / (size - 1) END) AS a, min(CASE WHEN cluster <> other THEN d END) AS b FROM ds GROUP BY 1, 2)
    SELECT doc_id, cluster, round(CASE WHEN a IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END, 4)::DOUBLE AS silhouette FROM sil
""")
def _(spark, d):
    return _by_doc(_rounded(K.silhouette(_blocks(spark, d), _labels(spark, d)), "silhouette"))


_BAND = "CASE WHEN size > 10 THEN ' This is a major theme appearing in ' || size || ' documents.' WHEN size > 5 THEN ' This theme appears in ' || size || ' documents.' ELSE ' This is a smaller theme with ' || size || ' documents.' END"


@query("x13_cluster_summary", f"""
    WITH {_TERMS}, t AS (SELECT cluster, list(term ORDER BY rank) AS t FROM terms GROUP BY 1)
    SELECT cluster, size, ('This cluster focuses on ' || t[1] || ', ' || t[2] || ' and ' || t[3] || '.' || {_BAND} || ' Related concepts include ' || array_to_string(t[4:6], ', ') || '.') AS summary,
      'This cluster focuses on ' || array_to_string(t[1:4], ', ') || ' and ' || t[5] || '.' || {_BAND} AS overview
    FROM size JOIN t USING (cluster)
""")
def _(spark, d):
    labels = _labels(spark, d)
    return K.cluster_summary(K.cluster_terms(_blocks(spark, d), labels), K.cluster_sizes(labels))


@query("x14_extractive_summary", f"""
    WITH {SENTENCES_SQL}, st AS MATERIALIZED (SELECT lang AS cluster, record_id, sentence_idx, sentence FROM sent JOIN documents ON doc_id = record_id),
    c AS MATERIALIZED (SELECT cluster, record_id, sentence_idx, term, count(*) AS tf FROM (
        SELECT cluster, record_id, sentence_idx, unnest(regexp_extract_all(lower(sentence), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM st)
      WHERE NOT list_contains({sql_list(ENGLISH_STOP_WORDS)}, term) GROUP BY ALL),
    ns AS (SELECT cluster, count(*)::DOUBLE AS n FROM st GROUP BY 1),
    df AS (SELECT cluster, term, count(*) AS df FROM c GROUP BY 1, 2),
    v AS (SELECT cluster, count(*) AS v FROM df GROUP BY 1),
    w AS (SELECT c.*, tf * (ln((n + 1) / (df + 1)) + 1) AS w FROM c JOIN df USING (cluster, term) JOIN ns USING (cluster)),
    sc AS (SELECT cluster, record_id, sentence_idx, sum(w) / sqrt(sum(w * w)) AS t FROM w GROUP BY ALL),
    r AS (SELECT st.*, coalesce(round(t / v, 10), 0) AS score FROM st LEFT JOIN sc USING (cluster, record_id, sentence_idx) LEFT JOIN v USING (cluster)),
    p AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, record_id, sentence_idx)::INT AS position,
      sum(length(sentence)) OVER (PARTITION BY cluster ORDER BY score DESC, record_id, sentence_idx ROWS UNBOUNDED PRECEDING) AS total FROM r)
    SELECT cluster, position, record_id, sentence, round(score, 6) AS score FROM p WHERE total <= 5000
""")
def _(spark, d):
    found = K.extractive_summary(docs(spark, d), _labels(spark, d), max_length=5000)
    return found.withColumn("score", F.round("score", 6))


@query("w6_length_budget", """
    WITH r AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM documents WHERE n_chars > 0)
    SELECT source, doc_id FROM r WHERE total <= 40000
""")
def _(spark, d):
    rows = docs(spark, d).select(F.col("coroner_area").alias("source"), F.col("record_id").alias("doc_id"), "n_chars")
    return K.within_budget(rows, "source", F.col("n_chars"), 40000, F.desc("n_chars"), F.asc("doc_id")).select("source", "doc_id")


@query("x15_topic_words")
def _(spark, d):
    return O.fit_topics(docs(spark, d), 5).top_words(10)


@query("x15_topic_shares")
def _(spark, d):
    return O.fit_topics(docs(spark, d), 5).mean_shares()


@query("x15_document_shares")
def _(spark, d):
    return _by_doc(O.fit_topics(docs(spark, d), 5).shares)


@query("x16_topic_insights")
def _(spark, d):
    r = docs(spark, d)
    found = O.topic_insights(O.fit_topics(r, 5), r)
    return found.select("topic", "label", "description", "prevalence", F.size("words").alias("words"), F.size("documents").alias("documents"))


_TOPIC_WORDS = {0: ["attion", "ering", "erble", "thanea"], 1: ["queaux", "tion", "oned", "aned"], 2: ["zzz", "qqq"]}


@query("x17_topic_coherence", """
    WITH w(topic, word) AS (VALUES """ + ", ".join(f"({t}, '{w}')" for t, ws in _TOPIC_WORDS.items() for w in ws) + """),
    p AS (SELECT a.topic, a.word AS x, b.word AS y FROM w a JOIN w b ON a.topic = b.topic AND a.word < b.word),
    c AS (SELECT topic, x, y, count(*) AS n FROM p JOIN documents ON contains(lower(text), x) AND contains(lower(text), y) GROUP BY 1, 2, 3)
    SELECT topic::INT AS topic, round(avg(n), 4) AS coherence FROM c GROUP BY 1
""")
def _(spark, d):
    words = spark.createDataFrame([(t, w) for t, ws in _TOPIC_WORDS.items() for w in ws], "topic int, word string")
    return O.topic_coherence(docs(spark, d), words)


@query("x18_word_network")
def _(spark, d):
    return O.word_network(O.fit_topics(docs(spark, d), 5).words, 100, 0.6, 1)


@query("x19_parameter_grid")
def _(spark, d):
    grid = {"target": [3, 5], "min_cluster_size": [2, 5], "dims": [64, 128]}
    return K.optimise_parameters(docs(spark, d), grid)


@query("x20_size_defaults", """
    WITH c AS (SELECT count(*)::INT AS n FROM documents), s AS (SELECT n, CASE WHEN n < 10 THEN 2 WHEN n < 20 THEN 3 WHEN n < 50 THEN 4 ELSE 5 END AS m FROM c)
    SELECT n AS documents, m AS min_cluster_size, CASE WHEN n < 20 THEN 2000 WHEN n < 50 THEN 3000 WHEN n < 100 THEN 4000 ELSE 5000 END AS max_features,
      greatest(2, floor(n * 0.05)::INT) AS min_docs, least(floor(n * 0.95)::INT, n - m) AS max_docs FROM s
""")
def _(spark, d):
    return K.size_defaults(docs(spark, d))


@query("s9_topic_export")
def _(spark, d):
    return O.topic_export(O.fit_topics(docs(spark, d), 5))


def _cluster_export(spark, d):
    r, labels = docs(spark, d), _labels(spark, d)
    weights = K.members(_blocks(spark, d), labels)
    terms = materialize(K.cluster_terms(weights, labels), "cluster-terms")  # a few rows a cluster, read twice
    return K.cluster_export(
        K.cluster_summary(terms, K.cluster_sizes(labels)), terms, K.representative_documents(weights, labels), r)


def _exported(spark, d, field, kind):
    """A list of the export, written as JSON lines and read again."""
    path = scratch_path(spark, "export")
    write_json_lines(_cluster_export(spark, d), path)
    found = read_json_lines(spark, path, f"cluster string, size long, {field} array<struct<{kind}>>")
    return found.select("cluster", "size", F.inline(field))


@query("s10_cluster_export")
def _(spark, d):
    return _cluster_export(spark, d)


@query("s10_exported_terms", f"WITH {_TERMS} SELECT cluster, size.size, rank, term, score FROM terms JOIN size USING (cluster)")
def _(spark, d):
    return _exported(spark, d, "terms", "rank: int, term: string, score: double")


@query("s10_exported_documents", f"""
    WITH {DOCS_SQL}, {_CLUSTER}, cl AS (SELECT cluster, sqrt(sum(centroid * centroid)) AS length FROM cen GROUP BY 1),
    dots AS (SELECT doc_id, cluster, sum(weight * centroid) AS dot, sqrt(sum(weight * weight)) AS own FROM wt JOIN lab USING (doc_id) JOIN cen USING (cluster, term) GROUP BY 1, 2),
    best AS (SELECT lab.doc_id AS record_id, lab.cluster, coalesce(round(dot / (own * length), 4), 0) AS similarity FROM lab LEFT JOIN dots USING (doc_id, cluster) LEFT JOIN cl USING (cluster)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY similarity DESC, record_id)::INT AS rank FROM best QUALIFY rank <= 10)
    SELECT cluster, size.size, rank, record_id, title, similarity FROM ranked JOIN docs USING (record_id) JOIN size USING (cluster)
""")
def _(spark, d):
    return _exported(spark, d, "documents", "rank: int, record_id: long, title: string, similarity: double")
