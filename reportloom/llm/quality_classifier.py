"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded by a small network; gated
attention, learned from document labels alone, weighs the passages, and the
weighted representation is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from reportloom.llm.common import held_out, labelled_sample, text_slices, words_of

PER_CLASS, MAX_CHARS = 2500, 12_000_000
PASSAGE = 64  # words
SHAPES = 64  # buckets of word shapes
HIDDEN, GATES = 32, 16
PER_WORD = 6
DIMENSIONS = SHAPES + PER_WORD + 4


def shape(word: str) -> str:
    """Kinds of characters in their order, repeats once: a lower, A upper, 0 digit, else the mark itself."""
    out = []
    for c in word:
        kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "a" if c.isalpha() else c if c < "\x7f" else "?"
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


def word_features(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Shape bucket, and length, letters, capitals, digits, marks and runs of marks of every word."""
    buckets, numbers = np.zeros(len(vocabulary), np.int64), np.zeros((len(vocabulary), PER_WORD))
    known: dict[str, int] = {}
    for i, word in enumerate(vocabulary):
        kinds = shape(word)
        if kinds not in known:
            known[kinds] = xxhash.xxh32_intdigest(kinds) % SHAPES
        buckets[i] = known[kinds]
        n = len(word)
        if word.isalpha():
            upper = n if word.isupper() else sum(map(str.isupper, word)) if word[:1].isupper() else 0
            numbers[i] = (n, 1.0, upper / n, 0.0, 0.0, 0.0)
        else:
            letters, digits = sum(map(str.isalpha, word)), sum(map(str.isdigit, word))
            marks = n - letters - digits
            numbers[i] = (n, letters / n, sum(map(str.isupper, word)) / n, digits / n, marks / n, float(marks > 1))
    return buckets, numbers


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, features) of every passage; a text without words is one empty passage."""
    n = len(texts)
    owner, vocabulary, codes = words_of(texts)
    counts = np.bincount(owner, minlength=n)
    parts = np.maximum(1, -(-counts // PASSAGE))
    doc = np.repeat(np.arange(n), parts)
    first_part = np.cumsum(parts) - parts
    first_word = np.cumsum(counts) - counts
    x = np.zeros((len(doc), DIMENSIONS))
    place = np.arange(len(codes)) - first_word[owner]
    own = first_part[owner] + place // PASSAGE
    size = np.bincount(own, minlength=len(doc))
    if len(codes):
        buckets, numbers = word_features(vocabulary.to_pylist())
        flat = np.bincount(own * SHAPES + buckets[codes], minlength=len(doc) * SHAPES)
        x[:, :SHAPES] = flat.reshape(len(doc), SHAPES)
        for k in range(PER_WORD):
            x[:, SHAPES + k] = np.bincount(own, weights=numbers[codes, k], minlength=len(doc))
        # A word that stood in the document before, and one that follows itself.
        key = owner * (int(codes.max()) + 1) + codes
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(codes))
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(codes))
        twice[1:] = key[1:] == key[:-1]
        x[:, SHAPES + PER_WORD] = np.bincount(own, weights=again, minlength=len(doc))
        x[:, SHAPES + PER_WORD + 1] = np.bincount(own, weights=twice, minlength=len(doc))
        x[:, :SHAPES + PER_WORD + 2] /= np.maximum(size, 1)[:, None]
    x[:, SHAPES + PER_WORD + 2] = np.log1p(size)
    x[:, SHAPES + PER_WORD + 3] = np.log1p(counts)[doc]
    return doc, x


@dataclass
class Attention:
    """Parameters of the network by name, and the scaling of its input."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, x: np.ndarray, seed: int = 5) -> Attention:
        rng = np.random.default_rng(seed)
        draw = lambda a, b: rng.normal(0, (1 / a) ** 0.5, (a, b))
        p = {
            "encode": draw(DIMENSIONS, HIDDEN), "encode0": np.zeros(HIDDEN),
            "tan": draw(HIDDEN, GATES), "gate": draw(HIDDEN, GATES), "weigh": draw(GATES, 1)[:, 0],
            "score": draw(HIDDEN, 1)[:, 0], "score0": np.zeros(1),
        }
        if not len(x):
            x = np.zeros((1, DIMENSIONS))
        return cls(x.mean(axis=0), np.maximum(x.std(axis=0), 0.02), p)

    def forward(self, x: np.ndarray, starts: np.ndarray):
        """Log odds of every bag, and what backpropagation needs. A bag's passages stand together."""
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["encode"] + p["encode0"])
        a, g = np.tanh(h @ p["tan"]), 1 / (1 + np.exp(-(h @ p["gate"])))
        raw = (a * g) @ p["weigh"]
        sizes = np.diff(np.append(starts, len(x)))
        raw = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), sizes))
        share = raw / np.repeat(np.add.reduceat(raw, starts), sizes)
        z = np.add.reduceat(share[:, None] * h, starts, axis=0)
        return z @ p["score"] + p["score0"][0], (x, h, a, g, share, z, sizes)

    def gradients(self, state, off: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x, h, a, g, share, z, sizes = state
        each = np.repeat(off, sizes)
        pull = h @ p["score"]
        middle = np.repeat(np.add.reduceat(share * pull, starts), sizes)
        raw = each * share * (pull - middle)
        ag = raw[:, None] * p["weigh"]
        da, dg = ag * g * (1 - a * a), ag * a * g * (1 - g)
        dh = (each * share)[:, None] * p["score"] + da @ p["tan"].T + dg @ p["gate"].T
        dx = dh * (1 - h * h)
        return {
            "encode": x.T @ dx, "encode0": dx.sum(axis=0), "tan": h.T @ da, "gate": h.T @ dg,
            "weigh": (a * g).T @ raw, "score": z.T @ off, "score0": np.array([off.sum()]),
        }


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray, rounds: int = 12, rate: float = 0.01, batch: int = 128, l2: float = 1e-4, seed: int = 5) -> Attention:
    """Adam over batches of documents, on the weighted logistic loss of the document labels."""
    features = [passages(pa.array(texts[i:i + 500], pa.string())) for i in range(0, len(texts), 500)]
    bags = [x[np.searchsorted(doc, k):np.searchsorted(doc, k + 1)] for doc, x in features for k in range(int(doc.max()) + 1)]
    model = Attention.fresh(np.concatenate(bags) if bags else np.zeros((0, DIMENSIONS)), seed)
    if not len(texts):
        return model
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            chosen = order[i:i + batch]
            sizes = np.array([len(bags[k]) for k in chosen])
            starts = np.cumsum(sizes) - sizes
            logit, state = model.forward(np.concatenate([bags[k] for k in chosen]), starts)
            off = weights[chosen] * (1 / (1 + np.exp(-logit)) - labels[chosen]) / len(chosen)
            step += 1
            for k, slope in model.gradients(state, off, starts).items():
                slope = slope + l2 * model.p[k]
                m[k] = 0.9 * m[k] + 0.1 * slope
                v2[k] = 0.999 * v2[k] + 0.001 * slope ** 2
                model.p[k] = model.p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def score_texts(model: Attention, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text its score, the number of its passages and the place of the weightiest."""
    doc, x = passages(texts)
    starts = np.searchsorted(doc, np.arange(len(texts)))
    logit, state = model.forward(x, starts)
    share, sizes = state[4], state[6]
    top = np.repeat(np.maximum.reduceat(share, starts), sizes) == share
    places = np.flatnonzero(top)
    first = places[np.searchsorted(doc[places], np.arange(len(texts)))]
    return 1 / (1 + np.exp(-np.clip(logit, -40, 40))), sizes, first - starts


def score_documents(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> DataFrame:
    """doc_id, held_out, score, predicted, number of passages and the one with most attention.

    Fitted on at most ``2 * per_class`` labelled documents with ``max_chars`` characters together,
    none of them held out. Only texts are read for a score. Absent texts count as empty ones,
    one passage without words; repeated rows get the same score, an
    empty table gives an empty result.
    """
    model = fit(*labelled_sample(documents, labels, "quality", per_class, max_chars))
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches):
        for batch in batches:
            for start, stop in text_slices(batch.column("text")):
                score, n, top = score_texts(shared.value, batch.column("text").slice(start, stop - start))
                own = [batch.column(c).slice(start, stop - start) for c in ("doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(score), pa.array(n, pa.int64()), pa.array(top, pa.int64())],
                    names=["doc_id", "held_out", "score", "n_passages", "top_passage"],
                )

    rows = documents.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double, n_passages long, top_passage long")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "top_passage")
