"""LM scoring by masked pseudo-likelihood.

A window network sees two words on either side of a hidden one and predicts it; the
conditional log-probabilities of all words of a document, summed up, are its score. Words are cells of
a two-level table: the network predicts the group and the member in it, and
corpus counts give the share of the cell in its member.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reportloom.llm.common import hash_words, text_slices, words_of
from reportloom.session import materialize

SIDE = 2
GROUPS, MEMBERS, CELLS = 64, 64, 64  # a word is one of 64 ** 3 cells
WORDS = GROUPS * MEMBERS
EDGE = WORDS  # stands for the place before the first and behind the last word
WIDTH = 24
TOKENS_AT_ONCE = 1 << 15
TURNS = 3  # of learning; each takes its share of the slices, and networks are averaged after each
SLICE = 2 << 20  # bytes of text in a row of the token table
TOKENS = "turn int, doc_id array<long>, n_words array<long>, words binary, cells binary"


def cells_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, cell) of every word, in order."""
    owner, vocabulary, codes = words_of(texts)
    if not len(codes):
        return owner, np.zeros(0, np.int64)
    cells = (hash_words(vocabulary) % np.uint64(WORDS * CELLS)).astype(np.int64)
    return owner, cells[codes]


def windows_of(owner: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Per word the words before and behind it; EDGE where the document ends."""
    n = len(words)
    out = np.full((2 * SIDE, n), EDGE, np.int64)  # a place after the other, as they are read
    for k, shift in enumerate((*range(-SIDE, 0), *range(1, SIDE + 1))):
        here = slice(max(0, -shift), n - max(0, shift))
        there = slice(max(0, shift), n - max(0, -shift))
        if n > abs(shift):
            out[k, here] = np.where(owner[here] == owner[there], words[there], EDGE)
    return out.T


@dataclass
class Network:
    """Parameters by name, as 32-bit numbers."""

    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, counts: np.ndarray, seed: int = 3) -> Network:
        """Small random weights; the biases are the corpus shares, so learning starts from them."""
        rng = np.random.default_rng(seed)
        words = counts.reshape(GROUPS, MEMBERS, CELLS).sum(axis=2) + 1.0
        draw = lambda *size: rng.normal(0, 0.1, size).astype(np.float32)
        return cls({
            "embed": draw(WORDS + 1, WIDTH), "place": np.ones((2 * SIDE, WIDTH), np.float32),
            "group": np.zeros((WIDTH, GROUPS), np.float32), "group0": np.log(words.sum(axis=1)).astype(np.float32),
            "member": np.zeros((GROUPS, WIDTH, MEMBERS), np.float32), "member0": np.log(words).astype(np.float32),
        })

    def context(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state of every window and, by place, the embedded words it is made of."""
        words = np.take(self.p["embed"], np.ascontiguousarray(around.T), axis=0)
        total = np.einsum("kij,kj->ij", words, self.p["place"])
        return np.tanh(total, out=total), words

    def log_probabilities(self, around: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Log-probability of every word given those around it."""
        p, group, member = self.p, words // MEMBERS, words % MEMBERS
        c, _ = self.context(around)
        logits = c @ p["group"]
        logits += p["group0"]
        out = logits[np.arange(len(words)), group] - _log_sum(logits)
        order = np.argsort(group.astype(np.uint8), kind="stable")
        edges = np.searchsorted(group[order], np.arange(GROUPS + 1))
        c, member, inner = c[order], member[order], np.empty(len(words), np.float32)
        for g in range(GROUPS):
            at = slice(edges[g], edges[g + 1])
            if at.stop > at.start:
                logits = c[at] @ p["member"][g]
                logits += p["member0"][g]
                inner[at] = logits[np.arange(len(logits)), member[at]] - _log_sum(logits)
        out[order] += inner
        return out

    def learn(self, around: np.ndarray, words: np.ndarray, squares: dict[str, np.ndarray], rate: float) -> None:
        """One Adagrad step on a batch of windows."""
        p, n = self.p, len(words)
        # Windows of a group stand together from the start, so nothing is put back in order.
        order = np.argsort((words // MEMBERS).astype(np.uint8), kind="stable")
        around, words = around.T[:, order].T, words[order]
        group, member, here = words // MEMBERS, words % MEMBERS, np.arange(n)
        c, embedded = self.context(around)
        off = c @ p["group"]
        off += p["group0"]
        _soften(off)
        off[here, group] -= 1
        slopes = {"group": c.T @ off, "group0": off.sum(axis=0)}
        dc = off @ p["group"].T
        groups, first = np.unique(group, return_index=True)
        parts = [slice(i, j) for i, j in zip(first, [*first[1:], n])]
        own = p["member"][groups]
        off = np.empty((n, MEMBERS), np.float32)
        for w, b, at in zip(own, p["member0"][groups], parts):
            np.matmul(c[at], w, out=off[at])
            off[at] += b
        _soften(off)
        off[here, member] -= 1
        slopes["member"], slopes["member0"] = np.empty_like(own), np.empty((len(groups), MEMBERS), np.float32)
        for k, (w, at) in enumerate(zip(own, parts)):
            np.matmul(c[at].T, off[at], out=slopes["member"][k])
            slopes["member0"][k] = off[at].sum(axis=0)
            dc[at] += off[at] @ w.T
        dt = dc * (1 - c * c)
        # Only the rows of words and groups in the batch have a slope; the others stay as they are.
        flat = around.T.ravel().astype(np.uint16)
        sorted_at = np.argsort(flat, kind="stable")
        flat = flat[sorted_at]
        begins = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if n else np.zeros(0, np.int64)
        seen = flat[begins].astype(np.int64)
        moved = (p["place"][:, None] * dt).reshape(-1, WIDTH)
        slopes["embed"] = np.add.reduceat(moved[sorted_at], begins, axis=0)
        slopes["place"] = np.stack([np.einsum("ij,ij->j", e, dt) for e in embedded])
        for name, slope in slopes.items():
            rows = {"embed": seen, "member": groups, "member0": groups}.get(name, slice(None))
            slope /= n
            square = squares[name][rows] + slope ** 2
            squares[name][rows] = square
            p[name][rows] -= rate * slope / np.sqrt(square)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def filled(self, flat: np.ndarray) -> Network:
        out, at = {}, 0
        for k in sorted(self.p):
            size = self.p[k].size
            out[k] = flat[at:at + size].reshape(self.p[k].shape).astype(np.float32)
            at += size
        return Network(out)


def _lower(x: np.ndarray) -> np.ndarray | np.float32:
    """Takes off, in place, what keeps exponentials finite: one number for all rows, or each row's own where rows lie far apart."""
    most = x.max(initial=-np.inf)
    if most - x.min(initial=np.inf) > 60:
        most = x.max(axis=1, keepdims=True)
    x -= most
    return most


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Logarithm of the summed exponentials of every row; ``x`` is used up."""
    most = _lower(x)
    np.exp(x, out=x)
    return np.ravel(most) + np.log(x @ np.ones(x.shape[1], np.float32))


def _soften(x: np.ndarray) -> None:
    """Every row becomes its softmax, in place."""
    _lower(x)
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], np.float32))[:, None]


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


def token_table(documents: DataFrame) -> DataFrame:
    """One row per slice of documents, written to the shared folder: ids, words in each, and all words as cells.

    Words are made once; counting, learning and scoring read them as three bytes each: the word of
    the network and its cell. ``turn`` deals slices out to the turns of learning, by their place in a partition.
    """
    def run(batches):
        place = 0
        for batch in batches:
            for start, stop in text_slices(batch.column("text"), SLICE):
                n = stop - start
                owner, cells = cells_of(batch.column("text").slice(start, n))
                one = lambda v: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), v)
                yield pa.RecordBatch.from_arrays([
                    pa.array([place % TURNS], pa.int32()), one(batch.column("doc_id").slice(start, n)), one(pa.array(np.bincount(owner, minlength=n))),
                    pa.array([(cells // CELLS).astype("<u2").tobytes()], pa.binary()), pa.array([(cells % CELLS).astype("u1").tobytes()], pa.binary()),
                ], names=[c.split(" ")[0] for c in TOKENS.split(", ")])
                place += 1

    return materialize(_texts(documents).mapInArrow(run, TOKENS), "lm-tokens")


def _words_and_cells(batch: pa.RecordBatch):
    """Per row of the token table: words and full cell numbers."""
    for words, cells in zip(batch.column("words").to_pylist(), batch.column("cells").to_pylist()):
        words = np.frombuffer(words, "<u2").astype(np.int64)
        yield words, words * CELLS + np.frombuffer(cells, "u1")


def corpus_counts(tokens: DataFrame) -> np.ndarray:
    """How often the words of each cell occur in all documents; as many numbers as there are cells."""
    def run(batches):
        total = np.zeros(WORDS * CELLS, np.int64)
        for batch in batches:
            for _, cells in _words_and_cells(batch):
                total += np.bincount(cells, minlength=WORDS * CELLS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    rows = tokens.select("words", "cells").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(WORDS * CELLS, np.int64)
    counts[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def train(tokens: DataFrame, counts: np.ndarray, turns: int = TURNS, batch: int = 4096, rate: float = 0.15) -> Network:
    """All windows once: in every turn the partitions learn from the slices of that turn, from a common network, and are averaged.

    The rate falls from turn to turn. Averages are summed up in a tree of tasks, so the driver meets a few networks, however many
    partitions there are. A network is of fixed size.
    """
    add = lambda a, b: (a[0] + b[0], a[1] + b[1])
    network = Network.fresh(counts)
    context = tokens.sparkSession.sparkContext
    for turn in range(turns):
        shared = context.broadcast(network)
        step = rate / 1.6 ** turn

        def run(batches, shared=shared, step=step):
            own = Network({k: v.copy() for k, v in shared.value.p.items()})
            squares = {k: np.full(v.shape, 1e-5, np.float32) for k, v in own.p.items()}
            seen = 0
            for record in batches:
                for raw, sizes in zip(record.column("words").to_pylist(), record.column("n_words")):
                    words = np.frombuffer(raw, "<u2").astype(np.int64)
                    around = windows_of(_owners(sizes.values), words)
                    size = min(batch, max(256, len(words) // 64))  # a short slice is learnt from in more than a few steps
                    for i in range(0, len(words), size):
                        own.learn(around[i:i + size], words[i:i + size], squares, step)
                    seen += len(words)
            if seen:
                total = own.flat().astype(np.float64) * seen
                yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([total.tobytes()], pa.binary())], names=["n", "total"])

        part = tokens.filter(F.col("turn") == turn).select("words", "n_words")
        results = part.mapInArrow(run, "n long, total binary").rdd.map(lambda r: (r.n, np.frombuffer(r.total, np.float64)))
        # Sums and not a look for a first row, which would train a partition twice.
        n, total = results.treeAggregate((0, 0.0), add, add, 3)
        if n:
            network = network.filled(total / n)
    return network


def _owners(sizes: pa.Array) -> np.ndarray:
    """The document of every word, from the words in each document."""
    sizes = sizes.to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(sizes)), sizes)


def score_documents(documents: DataFrame) -> DataFrame:
    """doc_id, n_tokens, log_likelihood and its mean per token of every whole document.

    Counts are taken from all words and the network learns from all windows, each once. A text without words, or none, has no
    tokens, likelihood 0 and no mean. Repeated rows get the same score; an
    empty table gives an empty result.
    """
    tokens = token_table(documents)
    counts = corpus_counts(tokens)
    return score_tokens(tokens, counts, train(tokens, counts))


def score_tokens(tokens: DataFrame, counts: np.ndarray, network: Network) -> DataFrame:
    """The scores of the documents of a token table by a given network."""
    shared = tokens.sparkSession.sparkContext.broadcast((network, cell_shares(counts)))  # of fixed size

    def run(batches):
        network, inside = shared.value
        for batch in batches:
            for k, (words, cells) in enumerate(_words_and_cells(batch)):
                sizes = batch.column("n_words")[k].values
                owner, n = _owners(sizes), len(sizes)
                around = windows_of(owner, words)
                scores = inside[cells].astype(np.float64)
                for i in range(0, len(words), TOKENS_AT_ONCE):
                    at = slice(i, i + TOKENS_AT_ONCE)
                    scores[at] += network.log_probabilities(around[at], words[at])
                total, size = np.bincount(owner, weights=scores, minlength=n).astype(np.float64), sizes.to_numpy(zero_copy_only=False)
                mean = pa.array(total / np.maximum(size, 1), mask=size == 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[k].values, pa.array(size), pa.array(total), mean],
                    names=["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"],
                )

    return tokens.select("doc_id", "n_words", "words", "cells").mapInArrow(
        run, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double"
    )


def cell_shares(counts: np.ndarray) -> np.ndarray:
    """Logarithm of every cell's share of its word in the corpus, with one added to each count."""
    table = counts.reshape(WORDS, CELLS) + 1.0
    return np.log(table / table.sum(axis=1, keepdims=True)).ravel().astype(np.float32)
