"""The pipeline, stage by stage, against plain versions; the folder's registration."""

import numpy as np

import brute
import corpus_pipeline
from reportloom.llm import quality_rules as rules
from test_tokens import check_packing

LEAST = [least for _, _, least in rules.FEATURES]


def plain_stages(rows):
    """Rows (doc_id, text, lang, source) after each stage but the last."""
    stats = [brute.statistics(r.text) for r in rows]
    d2 = brute.robust_distances(stats, [f"={r.lang}\t={r.source}" for r in rows], LEAST)
    rows = [r for r, s, d in zip(rows, stats, d2) if not s["base_failed"] and d <= 50.0]
    yield {r.doc_id: r.text for r in rows}
    last = {}
    for r in rows:
        last[r.text] = max(r.doc_id, last.get(r.text, r.doc_id))
    kept = {i: t for t, i in last.items()}
    yield kept
    component = brute.near_components(list(kept.items()), 80)
    kept = {i: t for i, t in kept.items() if component[i] == i}
    yield kept
    masked = {}
    for i, text in kept.items():
        out, at = "", 0
        for start, _, _, stop in brute.all_spans(text, brute.WEAK):
            if start >= at:
                out += text[at:start] + "[secret]"
            at = max(at, stop)
        masked[i] = out + text[at:]
    yield masked


def test_stages_equal_plain_versions(spark, sf_dir, documents, tmp_path):
    docs = documents
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:-1], plain_stages(documents.collect())):
        out = stage(spark, docs, sf_dir)
        assert out.columns == documents.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert {r.doc_id: r.text for r in docs.collect()} == expected, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    check_packing([(r.doc_id, r.text) for r in docs.collect()], pieces)
    whole = corpus_pipeline.run(spark, sf_dir)
    key = lambda p: (p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens)
    assert sorted(map(key, whole.collect())) == sorted(map(key, pieces))


def test_stages_on_edge_rows(spark, edge, nothing, sf_dir):
    for table in (edge, nothing):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            if name != "packing":
                assert docs.columns == edge.columns, name
        assert docs.count() >= 0


def test_quality_stage_rejects(spark, sf_dir, documents):
    kept = corpus_pipeline.STAGES[0][1](spark, documents, sf_dir).count()
    assert 0 < kept < documents.count()
    assert np.isfinite(kept)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} <= {n.split("_")[0] for n in names}
    assert set(entry.oracle_sql()) <= set(names)
