"""Embedding whitening by Chebyshev-filtered subspace iteration.

The covariance is never formed: every application to a block of directions is a pass over the
distributed vectors, centred before multiplying. A polynomial recurrence of such passes damps the unwanted part of the
spectrum, QR and Rayleigh-Ritz follow, and directions are locked once their residual is certified.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reportloom.session import materialize

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
BLOCK_BYTES = 8 << 20
CERTIFIED = 1e-13  # residual norm, relative to the largest eigenvalue
DIRECT_BYTES = 32 << 20  # sums of tasks that are added on the driver without a tree
BLOCK = "n int, x binary, width int"
ROW = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

Multiply = Callable[[np.ndarray], np.ndarray]


def _whole(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are whole vectors of ``d`` finite numbers, those as floor(64 c))."""
    lists = batch.column("embedding")
    sizes = np.diff(np.asarray(lists.offsets))
    flat = lists.flatten()
    good = lists.is_valid().to_numpy(zero_copy_only=False).astype(bool) & (sizes == d)
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
    own = np.repeat(np.arange(len(sizes)), np.where(lists.is_valid().to_numpy(zero_copy_only=False), sizes, 0))
    good &= np.bincount(own, weights=~np.isfinite(values), minlength=len(sizes)) == 0
    rows = np.flatnonzero(good)
    return rows, np.floor(SCALE * values[good[own]].reshape(len(rows), d))


def _packed(x: np.ndarray) -> tuple[bytes, int]:
    """Whole numbers in as few bytes as they need; as doubles if they are beyond all of these."""
    most = np.abs(x).max(initial=0)
    for kind in ("<i2", "<i4"):
        if most <= np.iinfo(kind).max:
            return x.astype(kind).tobytes(), np.dtype(kind).itemsize
    return x.astype("<f8").tobytes(), 8


def _unpacked(batch: pa.RecordBatch, d: int):
    for n, raw, width in zip(*(batch.column(c).to_pylist() for c in ("n", "x", "width"))):
        yield np.frombuffer(raw, "<f8" if width == 8 else f"<i{width}").reshape(n, d).astype(np.float64)


def usual_size(embeddings: DataFrame) -> tuple[int, int]:
    """(number of entries most vectors have, number of these vectors); zeros if there are none."""
    sizes = embeddings.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).count()
    first = sizes.orderBy(F.desc("count"), F.desc("d")).first()
    return (first["d"], first["count"]) if first else (0, 0)


def pass_tasks(n: int, d: int) -> int:
    """Tasks of a pass: about a megabyte of packed entries each, and of 64 MB once there are many."""
    size = 2 * n * d
    return max(1, min(-(-size // (1 << 20)), max(64, -(-size // (64 << 20)))))


def vector_blocks(embeddings: DataFrame, n: int, d: int) -> DataFrame:
    """All whole vectors as blocks of whole numbers floor(64 c), written to the shared folder.

    Every pass reads them again, so small input files are read by few tasks, without a shuffle.
    """
    def run(batches):
        many = max(1, BLOCK_BYTES // (8 * d))
        for batch in batches:
            for start in range(0, batch.num_rows, many):
                x = _whole(batch.slice(start, many), d)[1]
                if len(x):
                    raw, width = _packed(x)
                    yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), pa.array([raw], pa.binary()), pa.array([width], pa.int32())], names=["n", "x", "width"])

    return materialize(embeddings.select("embedding").coalesce(pass_tasks(n, d)).mapInArrow(run, BLOCK), "vector-blocks")


@dataclass
class Vectors:
    """The distributed vectors with their number and exact sums."""

    blocks: DataFrame
    d: int
    n: int = 0
    sums: list[int] | None = None

    def __post_init__(self):
        self.tasks = self.blocks.rdd.getNumPartitions()

    def total(self, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum of ``of(vectors of a block)`` over all blocks: one sum a task, these in a tree of tasks if they are many."""
        d = self.d

        def run(batches):
            total = None
            for batch in batches:
                for x in _unpacked(batch, d):
                    part = of(x)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total).tobytes()], pa.binary())], names=["total"])

        none = np.asarray(of(np.zeros((1, d)))) * 0
        parts, add = self.blocks.mapInArrow(run, "total binary"), lambda a, b: a + b
        if self.tasks * none.nbytes <= DIRECT_BYTES:  # a sum a task, all together of bounded size
            return sum((np.frombuffer(r.total, none.dtype).reshape(none.shape) for r in parts.collect()), none)
        sums = parts.rdd.map(lambda r: np.frombuffer(r.total, none.dtype))
        return np.asarray(sums.treeAggregate(none.ravel(), add, add, 2)).reshape(none.shape)

    def measure(self) -> None:
        """Number and exact sums. Halves of the entries are added apart, so that large ones do not overflow."""
        low = 1 << 24

        def of(x):
            high = np.floor(x / low)
            return np.concatenate([[len(x)], (x - high * low).sum(axis=0), high.sum(axis=0)])

        got = self.total(of)
        self.n = int(got[0])
        self.sums = [int(a) + low * int(b) for a, b in zip(got[1:1 + self.d], got[1 + self.d:])]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def multiply(self, q: np.ndarray) -> np.ndarray:
        """The covariance times ``q``: one pass, every block centred before multiplying."""
        context = self.blocks.sparkSession.sparkContext
        shared = context.broadcast((q, self.mean))  # dimensions times directions

        def of(x):
            q, mean = shared.value
            centred = x - mean
            return centred.T @ (centred @ q)

        out = self.total(of) / self.n
        shared.unpersist()
        return out

    def trace(self) -> float:
        mean = self.mean
        return float(self.total(lambda x: np.array([((x - mean) ** 2).sum()]))[0]) / self.n

    def identity_error(self, whitener: np.ndarray) -> float:
        """Largest entry of the whitened vectors' covariance minus the identity."""
        mean, k = self.mean, whitener.shape[1]

        def of(x):
            w = (x - mean) @ whitener
            return np.concatenate([w.T @ w, w.sum(axis=0)[None]])

        got = self.total(of) / self.n
        return float(np.abs(got[:k] - np.outer(got[k], got[k]) - np.eye(k)).max(initial=0.0))


def lower_bound(multiply: Multiply, d: int, rng: np.random.Generator, steps: int = 10) -> float:
    """Below the spectrum with high certainty: the least Ritz value of a few Lanczos steps less its residual, or 0."""
    q, before, diagonal, beside = rng.normal(size=d), np.zeros(d), [], [0.0]
    q /= np.linalg.norm(q)
    basis = []
    for _ in range(min(steps, d)):
        basis.append(q)
        r = multiply(q[:, None])[:, 0]
        diagonal.append(q @ r)
        r = r - diagonal[-1] * q - beside[-1] * before
        r -= np.array(basis).T @ (np.array(basis) @ r)
        beside.append(np.linalg.norm(r))
        if beside[-1] <= 1e-10 * abs(diagonal[0]):
            break
        before, q = q, r / beside[-1]
    t = np.diag(diagonal) + np.diag(beside[1:len(diagonal)], 1) + np.diag(beside[1:len(diagonal)], -1)
    return max(0.0, float(np.linalg.eigvalsh(t)[0] - beside[-1]))


def _filtered(multiply: Multiply, q: np.ndarray, vq: np.ndarray, degree: int, low: float, cut: float, top: float) -> np.ndarray:
    """The Chebyshev polynomial of the covariance that is small on [low, cut], times ``q``; ``vq`` is its first product.

    Scaled so that directions at ``top`` keep their length.
    """
    half, centre = max((cut - low) / 2, 1e-14 * top), (cut + low) / 2
    sigma = first = half / (top - centre)
    before, here = q, (vq - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, here = here, (multiply(here) - centre * here) * (2 * after / half) - before * (sigma * after)
        sigma = after
    return here


def leading_components(
    multiply: Multiply, d: int, k: int = COMPONENTS, guard: int = 12, most_degree: int = 16, seed: int = 5,
) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, unit eigenvectors as columns, largest residual) of a covariance known by its products.

    The block has ``guard`` directions more than asked for. The degree follows from the spectrum found so far: no
    direction may grow 10^8 times more than the last wanted one. If cycles pass without all
    directions certified, more guard directions join, up to the whole space, where Rayleigh-Ritz alone is exact.
    """
    rng = np.random.default_rng(seed)
    k = min(k, d)
    low = lower_bound(multiply, d, rng) if d > k + guard else 0.0
    locked, values, worst = np.zeros((d, 0)), [], 0.0
    block = np.linalg.qr(rng.normal(size=(d, min(d, k + guard))))[0]
    for cycle in range(1, 200):
        image = multiply(block)
        theta, turn = np.linalg.eigh((block.T @ image + image.T @ block) / 2)
        turn = turn[:, ::-1]
        theta, block, image = theta[::-1], block @ turn, image @ turn
        top = max([*values[:1], float(theta[0])])
        residual = np.linalg.norm(image - block * theta, axis=0)
        whole = locked.shape[1] + block.shape[1] >= d
        limit = max(CERTIFIED * top, 0.0)
        many = 0
        while many < min(k - len(values), block.shape[1]) and (residual[many] <= limit or whole):
            many += 1
        worst = max([worst, *residual[:many].tolist()])
        locked, values = np.hstack([locked, block[:, :many]]), [*values, *theta[:many].tolist()]
        if len(values) >= k or top <= 0:
            break
        block, image, theta = block[:, many:], image[:, many:], theta[many:]
        if cycle % 8 == 0:
            more = min(d - locked.shape[1], 2 * block.shape[1]) - block.shape[1]
            extra = rng.normal(size=(d, more))
            block = np.hstack([block, extra])
        else:
            cut, wanted = float(theta[-1]), float(theta[k - len(values) - 1])
            half, centre = max((cut - low) / 2, 1e-14 * top), (cut + low) / 2
            grow = lambda value: float(np.arccosh(max(1.0, (value - centre) / half)))
            spread = grow(float(theta[0])) - grow(wanted)
            degree = int(np.clip(18.4 / max(spread, 1e-9), 2, most_degree))
            block = _filtered(multiply, block, image, degree, low, cut, float(theta[0]))
        for _ in range(2):
            block = block - locked @ (locked.T @ block)
            block = np.linalg.qr(block)[0]
    order = np.argsort(values)[::-1][:k]
    vectors = np.linalg.qr(locked[:, order])[0] if len(order) else locked
    signs = np.sign(np.sum(vectors * locked[:, order], axis=0)) if len(order) else 1.0
    return np.array(values)[order], vectors * signs, worst


def _exact_deviation(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum of (n x - S)^2 per vector, in whole numbers; null where it is beyond 64 bits."""
    most = n * float(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if most ** 2 * x.shape[1] < 2 ** 62:
        off = n * x.astype(np.int64) - np.array(sums, np.int64)
        return pa.array((off * off).sum(axis=1))
    listed = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return pa.array([v if v < 1 << 63 else None for v in listed], pa.int64())


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: number of vectors, exact deviation, whitened value, share explained, identity error.

    Vectors that are null, empty, hold null, NaN or infinite entries, or have another length than most, are dropped and not
    counted. The shift of all entries by a million cancels in every result. Components without variance
    (below 10^-12 of the largest) have no whitened value and no rows, so equal vectors alone give no rows, and
    neither does an empty table. Repeated rows count each; other columns are ignored.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    spark, (d, many) = embeddings.sparkSession, usual_size(rows)
    if not d:
        return spark.createDataFrame([], ROW)
    vectors = Vectors(vector_blocks(rows, many, d), d)
    vectors.measure()
    if not vectors.n:
        return spark.createDataFrame([], ROW)
    values, directions, _ = leading_components(vectors.multiply, d, components)
    keep = values > 1e-12 * max(values.max(initial=0.0), 1e-300)
    values, whitener = values[keep], directions[:, keep] / np.sqrt(values[keep])
    trace, error, mean, n, sums = vectors.trace(), vectors.identity_error(whitener), vectors.mean, vectors.n, vectors.sums
    explained, k = values / trace if len(values) else values, len(values)

    def run(batches):
        for batch in batches:
            good, x = _whole(batch, d)
            whitened = (x - mean) @ whitener
            spread = pa.array(np.repeat(np.arange(len(good)), k))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(good)).take(spread), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(good))),
                pa.array(np.full(len(spread), n)), _exact_deviation(x, n, sums).take(spread), pa.array(whitened.ravel()),
                pa.array(np.tile(explained, len(good))), pa.array(np.full(len(spread), error)),
            ], names=[c.split(" ")[0] for c in ROW.split(", ")])

    return rows.mapInArrow(run, ROW)
