"""Packing, BPE and token counts against the tokenizers library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import brute
from brute import EDGE
from reportloom.llm import bpe, packing, token_counts, tokens
from reportloom.llm.queries import QUERIES

LETTERS = list("abcABCéÉßσΣ 's.,!?#$<|>endoftext  \n\t́̇İK‍9٣\x1c\x85\xa0") + ["<|endoftext|>", "'ll", "hello", "  ", "。", "한국"]


def odd_texts(n=4000, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("plain", [False, True])
def test_word_tokenizer_equals_library(plain):
    path = tokens.tokenizer_path()
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = plain
    texts = odd_texts()
    ids, counts = tokens.WordTokenizer(path, plain).encode(pa.array(texts))
    ends = np.cumsum(counts)
    for text, end, n in zip(texts, ends, counts):
        assert library.encode(text, add_special_tokens=False).ids == ids[end - n:end].tolist(), repr(text)


def test_cache_limit_changes_nothing(monkeypatch):
    texts = pa.array(odd_texts(300))
    expected = tokens.WordTokenizer(tokens.tokenizer_path()).encode(texts)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 5)
    again = tokens.WordTokenizer(tokens.tokenizer_path())
    for _ in range(2):
        got = again.encode(texts)
        assert np.array_equal(got[0], expected[0]) and np.array_equal(got[1], expected[1])


def check_packing(rows, pieces, window=2048):
    library = Tokenizer.from_file(tokens.tokenizer_path())
    ids = [library.encode(t or "", add_special_tokens=False).ids + [packing.END_ID] for _, t in rows]
    expected = sorted(
        (str(i), s, min(window, len(own) - s), brute.checksum(own[s:s + window]), len(own))
        for (i, _), own in zip(rows, ids) for s in range(0, len(own), window)
    )
    assert sorted((str(p.doc_id), p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == expected
    filled = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled.get(p.sequence_id, 0)
        filled[p.sequence_id] = p.offset + p.length
    assert max(filled.values(), default=0) <= window
    return filled


def test_packing_of_documents(spark, sf_dir, documents):
    filled = check_packing([(r.doc_id, r.text) for r in documents.collect()], QUERIES["op4_packing"](spark, sf_dir).collect())
    total = sum(filled.values())
    assert len(filled) <= total / 2048 * 1.02 + 1


def test_packing_edge(edge):
    check_packing([(r[0], r[1]) for r in EDGE], packing.pack_documents(edge).collect())
    with_ids = packing.cut_documents(edge, with_ids=True).collect()
    assert all(brute.checksum(r.ids) == r.ids_crc32 and len(r.ids) == r.length for r in with_ids)


def test_packing_over_several_tasks(spark, edge):
    pieces = packing.cut_documents(edge)
    check_packing([(r[0], r[1]) for r in EDGE], packing.pack(pieces, per_task=4).collect())


def test_best_fit_decreasing_equals_plain_search():
    rng = np.random.default_rng(5)
    for window in (7, 64, 100):
        lengths = rng.integers(1, window + 1, 300)
        where, offset, used = packing.best_fit_decreasing(lengths, window)
        room = []
        for i in np.argsort(-lengths, kind="stable"):
            fits = [r for r in room if r >= lengths[i]]
            if fits:
                room[room.index(min(fits))] -= lengths[i]
            else:
                room.append(window - lengths[i])
        sums = np.bincount(where, weights=lengths, minlength=used)
        assert sorted(window - sums) == sorted(room)
        for k in range(used):
            own = np.argsort(offset[where == k])
            assert (np.cumsum(lengths[where == k][own]) - lengths[where == k][own] == offset[where == k][own]).all()


def test_bpe_equals_library():
    library = Tokenizer.from_file(bpe.tokenizer_path())
    coder = bpe.PairIndexBpe(bpe.tokenizer_path())
    texts = odd_texts() + ["a" * 1001, "aaab" * 50, " " * 33, "\n\n \n  x", " lead", "trail "]
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert coder.encode_batch(texts) == expected
    assert [coder.decode(i) for i in expected] == [library.decode(i, skip_special_tokens=False) for i in expected]


def check_bpe(rows, got):
    library = Tokenizer.from_file(bpe.tokenizer_path())
    expected = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((str(i), len(ids), brute.sha256(",".join(map(str, ids))), brute.sha256(library.decode(ids, skip_special_tokens=False))))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(expected)


def test_bpe_of_documents(spark, sf_dir, documents):
    check_bpe([(r.doc_id, r.text) for r in documents.collect()], QUERIES["op7_bpe_round_trip"](spark, sf_dir).collect())


def test_bpe_edge(edge):
    check_bpe([(r[0], r[1]) for r in EDGE], bpe.round_trip(edge).collect())
    texts = sorted(str((r.doc_id, r.text)) for r in bpe.decode_ids(bpe.encode_documents(edge)).collect())
    assert texts == sorted(str((r[0], r[1] or "")) for r in EDGE)


def test_broken_ids_decode_to_replacement():
    coder = bpe.PairIndexBpe(bpe.tokenizer_path())
    library = Tokenizer.from_file(bpe.tokenizer_path())
    ids = library.encode("é", add_special_tokens=False).ids + [int(coder.byte_ids[0xC3])]
    assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_token_counts_of_documents(spark, sf_dir, documents, edge):
    library = Tokenizer.from_file(tokens.tokenizer_path())
    library.encode_special_tokens = True
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = sorted((r.doc_id, r.n_tokens) for r in QUERIES["op8_token_counts"](spark, sf_dir).collect())
    assert got == sorted((r.doc_id, count(r.text)) for r in documents.collect())
    got = sorted((str(r.doc_id), r.n_tokens) for r in token_counts.document_token_counts(edge).collect())
    assert got == sorted((str(r[0]), count(r[1])) for r in EDGE)


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
def test_separator_scan_over_any_blocks(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    expected = []
    for name in ("a", "b", "c", "empty"):
        ids = rng.integers(4, 9, 0 if name == "empty" else int(rng.integers(1, 400))).astype("<u2")
        ids[rng.random(len(ids)) < 0.05] = 3
        if name == "b":
            ids[-1] = 3
        (tmp_path / f"{name}.tokens").write_bytes(ids.tobytes())
        parts, start = np.flatnonzero(ids == 3).tolist(), 0
        for k, stop in enumerate(parts):
            expected.append((f"{name}.tokens", k, start, stop - start, True))
            start = stop + 1
        if start < len(ids):
            expected.append((f"{name}.tokens", len(parts), start, len(ids) - start, False))
    got = token_counts.count_tokens(spark, str(tmp_path), end_id=3, block_bytes=block).collect()
    assert sorted(tuple(r) for r in got) == sorted(expected)


@pytest.mark.parametrize("run", [packing.pack_documents, bpe.round_trip, bpe.encode_documents, token_counts.document_token_counts])
def test_empty_table(run, nothing):
    assert run(nothing).count() == 0


def test_digest_of_no_ids():
    assert hashlib.sha256(b"").hexdigest() == brute.sha256("")
