"""Toxicity: a linear-chain conditional random field tags toxic tokens.

The chain runs over the words of a sentence. Its tokens are labelled from
document labels: in a toxic document, words that toxic documents hold far more often than
others. Marginals from forward-backward give the offending spans and, summed up, the
score of a document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from reportloom.llm.common import held_out, labelled_sample, text_slices, words_of
from reportloom.llm.near_dedup import EMPTY, shingle_sets, sketches

PER_CLASS, MAX_CHARS = 2500, 6_000_000
BUCKETS = 1 << 18
PREFIXES = (5, 6, 7, 8)
ENDS = (".", "!", "?")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CORE = re.compile(r"^[\W_]+|[\W_]+$")


def core(word: str) -> str:
    """The word in lower case without marks around it."""
    return CORE.sub("", word).lower()


def features(word: str) -> list[int]:
    """Buckets of the word, its beginnings and its end."""
    w = core(word)
    return [xxhash.xxh32_intdigest(f) % BUCKETS for f in ("w" + w, "s" + w[-4:], *(w[:k] for k in PREFIXES))]


def feature_table(vocabulary: list[str]) -> np.ndarray:
    """Features of every word, a row each."""
    width = 2 + len(PREFIXES)
    return np.fromiter((f for w in vocabulary for f in features(w)), np.int32, width * len(vocabulary)).reshape(-1, width)


@dataclass
class Chain:
    """Weights of the field; label 0 and the step from 0 to 0 score nothing."""

    weights: np.ndarray
    bias: float = 0.0
    to_one: float = -2.0
    to_zero: float = 0.0
    stay_one: float = 0.0
    calibration: tuple[float, float, float] = (-3.0, 1.0, 0.0)

    def emissions(self, found: np.ndarray) -> np.ndarray:
        return self.weights[found].sum(axis=1) + self.bias if len(found) else np.zeros(0)


def sentences(owner: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the sentences: a word with a final mark, or the last of a text, ends one."""
    if not len(owner):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    final = ends.copy()
    final[:-1] |= owner[1:] != owner[:-1]
    final[-1] = True
    stops = np.flatnonzero(final) + 1
    starts = np.concatenate(([0], stops[:-1]))
    return starts, stops - starts


def forward_backward(chain: Chain, e: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Log odds of label 1 of every token: forward part and backward part.

    All sentences go forward together; the longest last. Their cost is that of their tokens.
    """
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")
    forward, backward = np.zeros(len(e)), np.zeros(len(e))
    for t in range(longest):
        at = starts[:active[t]] + t
        if t == 0:
            forward[at] = e[at] + chain.to_one
        else:
            r = forward[at - 1]
            forward[at] = e[at] + np.logaddexp(chain.to_one, chain.stay_one + r) - np.logaddexp(0.0, chain.to_zero + r)
    for t in range(longest - 2, -1, -1):
        at = starts[:active[t + 1]] + t
        ahead = e[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(chain.to_zero, chain.stay_one + ahead) - np.logaddexp(0.0, chain.to_one + ahead)
    return forward, backward


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def without_near_copies(texts: list[str], t: int = 32) -> list[int]:
    """Places of the texts that share less than a quarter of a small sketch with an earlier one."""
    whole = pa.array(texts, pa.string())
    rows = (
        row for start, stop in text_slices(whole, 1 << 20)
        for row in sketches(*shingle_sets(whole.slice(start, stop - start)), stop - start, t)
    )
    owners: dict[tuple[int, int], int] = {}
    kept = []
    for i, row in enumerate(rows):
        if row[0] == EMPTY:
            kept.append(i)
            continue
        found = Counter(owners[k] for k in enumerate(row.tolist()) if k in owners)
        if found and max(found.values()) >= t // 4:
            continue
        kept.append(i)
        for k in enumerate(row.tolist()):
            owners.setdefault(k, i)
    return kept


def stems(word: str) -> list[str]:
    """The word and its beginnings, marked by a final hyphen."""
    return [word, *(word[:k] + "-" for k in PREFIXES if len(word) > k)] if word else []


def telling_stems(sets: list[set], labels: np.ndarray, least_z: float = 3.0, purity: float = 0.8) -> set:
    """Words and beginnings of words that mark label 1, found one after the other.

    One must be in 2 % of the toxic documents and five of them, and of the documents that hold it ``purity`` must be
    toxic. After each find only documents that none explains count for
    the next one, so chance companions are not taken for others.
    """
    toxic_sets = [s for s, y in zip(sets, labels) if y == 1]
    least = max(5, math.ceil(0.02 * len(toxic_sets)))
    # Only what is in enough toxic documents is looked at again; a longer beginning can't be in
    # more documents than a shorter one, so each length is counted for what is left of the last.
    whole: Counter = Counter()
    for level, k in enumerate((*PREFIXES, None)):
        counts: Counter = Counter()
        for s in toxic_sets:
            left = (w for w in s if level == 0 or len(w) <= PREFIXES[level - 1] or w[:PREFIXES[level - 1]] + "-" in whole)
            counts.update(s & set(left) if k is None else {w[:k] + "-" for w in left if len(w) > k})
        whole.update({t: a for t, a in counts.items() if a >= least})
    usual = {t: t for t in whole}  # one string for each, however many documents hold it
    toxic = [{usual[t] for w in s for t in stems(w) if t in usual} for s in toxic_sets]
    clean: Counter = Counter()
    for s, y in zip(sets, labels):
        if y == 0:
            clean.update({t for w in s for t in stems(w) if t in usual})
    n, n_clean = len(toxic), max(1, int((labels == 0).sum()))

    def z(a: int, b: int) -> float:
        gap = math.log((a + .5) / (n - a + .5)) - math.log((b + .5) / (n_clean - b + .5))
        return gap / math.sqrt(1 / (a + .5) + 1 / (n - a + .5) + 1 / (b + .5) + 1 / (n_clean - b + .5))

    pure = {t for t in usual if whole[t] >= purity * (whole[t] + clean[t]) and z(whole[t], clean[t]) >= least_z}
    rest, found = [s & pure for s in toxic], set()
    while True:
        counts = Counter(t for s in rest for t in s)
        best = max(((z(a, clean[t]), t) for t, a in counts.items() if a >= least), default=(0.0, ""))
        if best[0] < least_z:
            break
        found.add(best[1])
        rest = [s for s in rest if best[1] not in s]
    # Those that always stand beside found ones tell as much if they are nearly as frequent.
    floor = 0.3 * max((whole[t] for t in found), default=0)
    return found | {t for t in pure if found and whole[t] >= max(least, floor)}


def _expected_steps(chain: Chain, e: np.ndarray, forward: np.ndarray, backward: np.ndarray, ahead: np.ndarray, part: int = 100_000) -> np.ndarray:
    """Expected number of steps 0-0, 0-1, 1-0 and 1-1 into the tokens ``ahead``."""
    total = np.zeros(4)
    for i in range(0, len(ahead), part):
        at = ahead[i:i + part]
        r, later = forward[at - 1], e[at] + backward[at]
        scores = np.stack([np.zeros(len(at)), chain.to_one + later, r + chain.to_zero, r + chain.stay_one + later])
        scores = np.exp(scores - scores.max(axis=0))
        total += (scores / scores.sum(axis=0)).sum(axis=1)
    return total


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray, rounds: int = 25, l2: float = 1e-6) -> Chain:
    """Fits the field by gradient steps on the likelihood of the token labels, then the document score."""
    chain = Chain(np.zeros(BUCKETS))
    if not len(texts) or labels.min() == labels.max():
        return chain
    kept = without_near_copies(texts)
    texts, labels, weights = [texts[i] for i in kept], labels[kept], weights[kept]
    owner, vocabulary, codes = words_of(pa.array(texts, pa.string()))
    listed = vocabulary.to_pylist()
    cores = np.array([core(w) for w in listed], dtype=object)
    edges = np.searchsorted(owner, np.arange(len(texts) + 1))
    sets = [set(cores[codes[edges[i]:edges[i + 1]]]) - {""} for i in range(len(texts))]
    telling = telling_stems(sets, labels)
    marked = np.array([not telling.isdisjoint(stems(c)) for c in cores], bool)
    y = (marked[codes] & (labels[owner] == 1)).astype(np.float64)
    found = feature_table(listed)
    ends = np.array([w.endswith(ENDS) for w in listed], bool)[codes]
    del sets, cores, texts
    starts, sizes = sentences(owner, ends)
    inner = np.ones(len(codes), bool)
    inner[starts] = False
    ahead = np.flatnonzero(inner)  # tokens with one before them in the sentence
    square = np.full(BUCKETS, 1e-8)
    steps = np.full(4, 1e-8)
    for _ in range(rounds):
        e = chain.emissions(found)[codes]
        forward, backward = forward_backward(chain, e, starts, sizes)
        p = _sigmoid(forward + backward)
        off = np.bincount(codes, weights=p - y, minlength=len(listed))
        gradient = np.zeros(BUCKETS)
        for k in range(found.shape[1]):
            gradient += np.bincount(found[:, k], weights=off, minlength=BUCKETS)
        gradient += l2 * len(codes) * chain.weights / 100
        square += gradient ** 2
        chain.weights = chain.weights - 0.7 * gradient / np.sqrt(square)
        expected = _expected_steps(chain, e, forward, backward, ahead)
        before, now = y[ahead - 1], y[ahead]
        first = float((p[starts] - y[starts]).sum())
        slopes = np.array([
            float((p - y).sum()), expected[1] - ((1 - before) * now).sum() + first,
            expected[2] - (before * (1 - now)).sum(), expected[3] - (before * now).sum(),
        ])
        steps += slopes ** 2
        change = 0.3 * slopes / np.sqrt(steps)
        chain.bias -= change[0]
        chain.to_one -= change[1]
        chain.to_zero -= change[2]
        chain.stay_one -= change[3]
    e = chain.emissions(found)[codes]
    odds = sum(forward_backward(chain, e, starts, sizes))
    chain.calibration = _calibrate(*evidence(odds, owner, len(labels)), labels, weights)
    return chain


def evidence(odds: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: log of the expected number of toxic tokens (bounded below), and the largest log odds."""
    total = np.bincount(owner, weights=_sigmoid(odds), minlength=n)
    most = np.full(n, -12.0)
    np.maximum.at(most, owner, np.clip(odds, -12, 12))
    return np.log(total + 1e-3), most


def _calibrate(total: np.ndarray, most: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic fit of the document labels by Newton steps."""
    x = np.stack([np.ones(len(total)), total, most], axis=1)
    theta = np.zeros(3)
    for _ in range(30):
        p = _sigmoid(x @ theta)
        gradient = x.T @ (weights * (p - labels)) + 0.5 * theta * [0, 1, 1]
        hessian = (x * (weights * p * (1 - p) + 1e-6)[:, None]).T @ x + 0.5 * np.diag([0, 1, 1])
        step = np.linalg.solve(hessian, gradient)
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(t) for t in theta)


def _offsets(text: str, hit: list[int]) -> list[tuple[int, int]]:
    """Spans of the words with the given places; neighbours become one span."""
    wanted, out, last = set(hit), [], -2
    for k, word in enumerate(WORD.finditer(text)):
        if k in wanted:
            if last == k - 1:
                out[-1] = (out[-1][0], word.end())
            else:
                out.append(word.span())
            last = k
    return out


def tag(chain: Chain, texts: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Score of every text and its offending spans as start:end in code points, comma-joined."""
    n = len(texts)
    owner, vocabulary, codes = words_of(texts)
    listed = vocabulary.to_pylist()
    found = feature_table(listed)
    ends = np.array([w.endswith(ENDS) for w in listed], bool)[codes] if len(codes) else np.zeros(0, bool)
    e = chain.emissions(found)[codes] if len(codes) else np.zeros(0)
    odds = sum(forward_backward(chain, e, *sentences(owner, ends)))
    total, most = evidence(odds, owner, n)
    a, b, c = chain.calibration
    score = _sigmoid(a + b * total + c * most)
    spans = [""] * n
    hits = np.flatnonzero(odds > 0)
    first = np.searchsorted(owner, np.arange(n))
    for i in np.unique(owner[hits]).tolist():
        own = hits[owner[hits] == i] - first[i]
        spans[i] = ",".join(f"{s}:{t}" for s, t in _offsets(texts[i].as_py(), own.tolist()))
    return score, spans


def score_documents(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted and offending spans of every document.

    Fitted on at most ``2 * per_class`` labelled documents with ``max_chars`` characters
    together, none of them held out; without labels of both kinds the scores
    stay low. Only texts are read for a score. Absent texts count as empty ones and get the score of no
    evidence, repeated rows the same one; an empty table gives an empty result.
    """
    chain = fit(*labelled_sample(documents, labels, "toxic", per_class, max_chars))
    shared = documents.sparkSession.sparkContext.broadcast(chain)  # BUCKETS numbers, whatever the input

    def run(batches):
        for batch in batches:
            for start, stop in text_slices(batch.column("text")):
                score, spans = tag(shared.value, batch.column("text").slice(start, stop - start))
                own = [batch.column(c).slice(start, stop - start) for c in ("doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(score), pa.array(spans)], names=["doc_id", "held_out", "score", "spans"])

    rows = documents.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double, spans string")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
