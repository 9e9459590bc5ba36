"""Embedding whitening by an incremental eigendecomposition.

The covariance is never gathered row by row on one machine. Each partition keeps the eigenvalues and eigenvectors of the
scatter of the rows it has met and folds in the next row as a centred rank-one update: the new eigenvalues are the roots of
the secular equation, the new eigenvectors follow from the roots, and what the update does not touch is deflated. Spectra
of partitions are combined in a tree, each step again a sequence of rank-one updates (one for each scaled eigenvector of the
smaller side, one for the distance of the means). A last pass over the rows projects the exact covariance on the combined
basis (Rayleigh-Ritz), which removes what rounding has left.

A task runs several independent decompositions side by side (lanes), so that every numpy call works on all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from msgrisk.llm.common import Scratch, arrow_map

#: Rows that one task decomposes, bytes of all its lanes' bases, and spectra merged by one task of the tree.
TASK_ROWS, LANE_BYTES, FAN_IN = 8_192, 8 << 20, 16
_EPS = np.finfo(np.float64).eps
_SPECTRUM = "part long, n long, mean binary, roots binary, basis binary"


@dataclass
class Spectra:
    """Lanes of running decompositions: counts, means, eigenvalues and eigenvectors (columns) of the scatter."""

    n: np.ndarray
    mean: np.ndarray
    roots: np.ndarray
    basis: np.ndarray

    @classmethod
    def empty(cls, lanes: int, dim: int) -> Spectra:
        eye = np.broadcast_to(np.eye(dim), (lanes, dim, dim)).copy()
        return cls(np.zeros(lanes), np.zeros((lanes, dim)), np.zeros((lanes, dim)), eye)

    def fold(self, rows: np.ndarray, present: np.ndarray) -> None:
        """One further row for each lane that has one."""
        offset = np.where(present[:, None], rows - self.mean, 0.0)
        self.roots, self.basis = rank_one(self.roots, self.basis, offset, self.n / (self.n + 1))
        self.n = self.n + present
        self.mean = self.mean + offset / np.maximum(self.n, 1)[:, None]

    def half(self, which: slice) -> Spectra:
        return Spectra(self.n[which], self.mean[which], self.roots[which], self.basis[which])

    def absorb(self, other: Spectra) -> None:
        """Add the rows of the other lanes: a rank-one update for each of their eigenvectors, one for the means."""
        lanes, dim = self.roots.shape
        for j in range(dim):
            arrow = other.basis[:, :, j] * np.sqrt(np.maximum(other.roots[:, j], 0))[:, None]
            if arrow.any():
                self.roots, self.basis = rank_one(self.roots, self.basis, arrow, np.ones(lanes))
        total = self.n + other.n
        offset = other.mean - self.mean
        self.roots, self.basis = rank_one(self.roots, self.basis, offset, self.n * other.n / np.maximum(total, 1))
        self.mean = self.mean + offset * (other.n / np.maximum(total, 1))[:, None]
        self.n = total

    def joined(self) -> Spectra:
        """All lanes in one."""
        lanes = self
        while len(lanes.n) > 1:
            k = len(lanes.n) // 2
            first, second, rest = lanes.half(slice(0, k)), lanes.half(slice(k, 2 * k)), lanes.half(slice(2 * k, None))
            first.absorb(second)
            lanes = Spectra(*(np.concatenate([getattr(first, f), getattr(rest, f)]) for f in ("n", "mean", "roots", "basis")))
        return lanes


def _deflate_close(d: np.ndarray, z: np.ndarray, basis: np.ndarray, tolerance: np.ndarray) -> None:
    """Rotate pairs of (almost) equal poles, in place, so that only one of them keeps a component of the update."""
    lanes, dim = d.shape
    row = np.arange(lanes)
    order = np.argsort(d, axis=1, kind="stable")
    held = np.full(lanes, -1)
    for step in range(dim):
        at = order[:, step]
        live = z[row, at] != 0
        pair = np.flatnonzero(live & (held >= 0))
        if len(pair):
            p, q = held[pair], at[pair]
            size = np.hypot(z[pair, p], z[pair, q])
            c, s = z[pair, q] / size, z[pair, p] / size
            near = np.abs((d[pair, q] - d[pair, p]) * c * s) <= tolerance[pair]
            pair, p, q, size, c, s = pair[near], p[near], q[near], size[near], c[near], s[near]
            if len(pair):
                z[pair, p], z[pair, q] = 0.0, size
                dp, dq = d[pair, p], d[pair, q]
                d[pair, p], d[pair, q] = dp * c * c + dq * s * s, dp * s * s + dq * c * c
                up, uq = basis[pair, :, p].copy(), basis[pair, :, q].copy()
                basis[pair, :, p], basis[pair, :, q] = up * c[:, None] - uq * s[:, None], up * s[:, None] + uq * c[:, None]
        held = np.where(live, at, held)


def secular_roots(d: np.ndarray, z2: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Roots of ``1 + sum(z2 / (d - root))``, one right of each of the first ``count`` poles (ascending) of a lane.

    Returns the poles seen from each root's origin (the nearer pole), the roots from there, and the origins: differences
    of a root and a pole keep full precision. A root is stepped by the two-pole interpolation of both halves of the sum; a
    step that leaves the root's bracket becomes a halving.
    """
    dim = d.shape[1]
    j = np.arange(dim)
    own = j < count[:, None]
    last = j == count[:, None] - 1
    right = np.where(last, d + z2.sum(axis=1, keepdims=True), np.roll(d, -1, axis=1))
    gap = np.where(own, right - d, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        middle = 1 + (z2[:, None, :] / (d[:, None, :] - (d + gap / 2)[:, :, None])).sum(axis=2)
    from_right = own & ~last & (middle < 0)
    origin = np.where(from_right, right, d)
    poles = d[:, None, :] - origin[:, :, None]
    low = np.where(from_right, -gap / 2, np.where(middle < 0, gap / 2, 0.0))
    high = np.where(from_right, 0.0, np.where(middle < 0, gap, gap / 2))
    # First guess: the two poles around a root as they are, all others as they stand in the middle.
    left_pole = np.where(from_right, -gap, 0.0)
    near, next_ = z2, np.where(last, 0.0, np.roll(z2, -1, axis=1))
    rest = middle + (near - next_) / (gap / 2)
    half = rest * gap + near + next_
    bend = np.sqrt(np.maximum(half * half - 4 * rest * near * gap, 0.0))
    with np.errstate(divide="ignore", invalid="ignore"):
        guess = left_pole + np.where(half >= 0, 2 * near * gap / (half + bend), (half - bend) / (2 * rest))
    root = np.where((guess > low) & (guess < high), guess, (low + high) / 2)
    # Only the rows of roots that still move are evaluated again.
    at = np.nonzero(own)
    seen, weight, below = poles[at], z2[at[0]], j[None, :] <= at[1][:, None]
    one_at, two_at = left_pole[at], np.where(last, 2 * gap, left_pole + gap)[at]
    low, high, here = low[at], high[at], root[at]
    for _ in range(60):
        far = seen - here[:, None]
        share = weight / far
        value = 1 + share.sum(axis=1)
        settled = np.abs(value) <= 1e-9 * (1 + np.abs(share).sum(axis=1))
        share /= far
        slope = share.sum(axis=1)
        slope_low = np.einsum("ij,ij->i", share, below)
        low, high = np.where(value < 0, here, low), np.where(value < 0, high, here)
        one, two = one_at - here, two_at - here
        c = value - one * slope_low - two * (slope - slope_low)
        a = (one + two) * value - one * two * slope
        b = one * two * value
        bend = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            new = here + np.where(a <= 0, (a - bend) / (2 * c), 2 * b / (a + bend))
        here = np.where((new > low) & (new < high), new, np.where(settled, here, (low + high) / 2))
        root[at] = here
        moving = ~settled & (high - low > 4 * _EPS * np.abs(here))
        if not moving.any():
            break
        at = tuple(x[moving] for x in at)
        seen, weight, below, one_at, two_at, low, high, here = (x[moving] for x in (seen, weight, below, one_at, two_at, low, high, here))
    return poles, root, origin


def rank_one(d: np.ndarray, basis: np.ndarray, x: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of ``basis diag(d) basis' + weight x x'`` for each lane, ``weight`` >= 0."""
    z = np.matmul(x[:, None, :], basis)[:, 0, :] * np.sqrt(weight)[:, None]
    length = np.sqrt((z * z).sum(axis=1))
    if not length.any():
        return d, basis
    tolerance = 8 * _EPS * np.maximum(np.abs(d).max(axis=1), length * length)
    z[np.abs(z) * length[:, None] <= tolerance[:, None]] = 0.0
    live = z != 0
    ranked = np.sort(np.where(live, d, np.inf), axis=1)
    with np.errstate(invalid="ignore"):
        close = np.diff(ranked, axis=1) <= 2 * tolerance[:, None]
    if close.any():
        d, basis = d.copy(), basis.copy()
        _deflate_close(d, z, basis, tolerance)
        live = z != 0
    count = live.sum(axis=1)
    order = np.argsort(np.where(live, d, np.inf), axis=1, kind="stable")
    old, z = np.take_along_axis(d, order, axis=1), np.take_along_axis(z, order, axis=1)
    basis = np.take_along_axis(basis, order[:, None, :], axis=2)
    dim = d.shape[1]
    own = np.arange(dim) < count[:, None]
    # Poles of deflated columns stand out of the way; their weight is zero.
    beyond = np.where(own, old, 0.0).max(axis=1) + (z * z).sum(axis=1) + 1
    d = np.where(own, old, beyond[:, None] * (2 + np.arange(dim)))
    poles, root, origin = secular_roots(d, z * z, count)
    far = poles - root[:, :, None]
    # The update for which the computed roots are exact (Gu and Eisenstat) keeps the eigenvectors orthogonal.
    both = own[:, :, None] & own[:, None, :]
    apart = d[:, :, None] - d[:, None, :]
    diagonal = np.eye(dim, dtype=bool)[None]
    ratio = np.where(both, -far / np.where(diagonal | ~both, 1.0, apart), 1.0)
    exact = np.sqrt(np.abs(ratio.prod(axis=1)))
    vectors = np.where(both, np.copysign(exact, z)[:, None, :] / far, np.where(diagonal, 1.0, 0.0))
    vectors /= np.sqrt((vectors * vectors).sum(axis=2, keepdims=True))
    return np.where(own, origin + root, old), np.matmul(basis, vectors.transpose(0, 2, 1))


def _spectrum_row(part: int, s: Spectra) -> dict[str, list]:
    return {"part": [part], "n": [int(s.n[0])], "mean": [s.mean[0].tobytes()], "roots": [s.roots[0].tobytes()], "basis": [s.basis[0].tobytes()]}


def _spectra(rows: pd.DataFrame, dim: int) -> Spectra:
    return Spectra(
        rows["n"].to_numpy(dtype=np.float64), np.stack([np.frombuffer(b) for b in rows["mean"]]),
        np.stack([np.frombuffer(b) for b in rows["roots"]]), np.stack([np.frombuffer(b).reshape(dim, dim) for b in rows["basis"]]),
    )


def integers(column: pa.Array, scale: float) -> np.ndarray:
    """``floor(scale * entry)`` of equally long vectors as long integers; beyond 2**62 they stay at 2**62."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat * scale), -(2.0**62), 2.0**62).astype(np.int64).reshape(len(column), -1)


def _keys(values: np.ndarray) -> list[bytes]:
    """One byte string for each row: a width and the entries in that width, the narrowest that holds them all."""
    size = np.maximum(values.max(axis=1), -(values.min(axis=1) + 1))
    out: list[bytes] = [b""] * len(values)
    width = np.select([size < 1 << 7, size < 1 << 15, size < 1 << 31], [1, 2, 4], 8)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        raw, step = values[at].astype(f"<i{w}").tobytes(), w * values.shape[1]
        for k, i in enumerate(at.tolist()):
            out[i] = b"%d" % w + raw[k * step : (k + 1) * step]
    return out


def _unkeyed(column: pa.Array, dim: int) -> np.ndarray:
    keys = column.to_pylist()
    out = np.empty((len(keys), dim), dtype=np.int64)
    by_width: dict[int, list[int]] = {}
    for i, key in enumerate(keys):
        by_width.setdefault(key[0] - 48, []).append(i)
    for w, at in by_width.items():
        out[at] = np.frombuffer(b"".join(keys[i][1:] for i in at), dtype=f"<i{w}").reshape(len(at), dim)
    return out


def _summed(df: DataFrame, work) -> dict[int, float]:
    """Place by place sums over tasks of the numbers that ``work`` gives once for each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = work(batch)
                total = part if total is None else total + part
        if total is not None:
            yield {"place": np.arange(len(total)), "value": total}

    return {r["place"]: r["value"] for r in arrow_map(df, task, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()}


def _integer_sums(fit: DataFrame, dim: int) -> list[int]:
    """Exact sums of all entries by dimension."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = [0] * dim
        for batch in batches:
            if batch.num_rows:
                values = _unkeyed(batch.column("key"), dim)
                wide = np.abs(values.astype(np.float64)).max() * len(values) >= 2.0**62
                total = [a + int(b) for a, b in zip(total, (values.astype(object) if wide else values).sum(axis=0))]
        yield {"place": list(range(dim)), "value": [str(t) for t in total]}

    rows = arrow_map(fit, task, "place int, value string").groupBy("place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    return [int(v) for _, v in sorted((r["place"], r["value"]) for r in rows.collect())]


def combined_basis(fit: DataFrame, dim: int, n: int, centre: np.ndarray) -> np.ndarray:
    """An orthonormal basis close to the eigenvectors of the rows' covariance: lanes, tasks, then a tree of tasks."""
    parts = -(-n // TASK_ROWS)
    lanes = int(max(1, min(16, LANE_BYTES // (8 * dim * dim))))

    def decompose(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        spectra = Spectra.empty(lanes, dim)
        for batch in batches:
            values = _unkeyed(batch.column("key"), dim) - centre
            for a in range(0, len(values), lanes):
                rows = values[a : a + lanes]
                short = lanes - len(rows)
                spectra.fold(np.pad(rows, ((0, short), (0, 0))), np.arange(lanes) < len(rows))
        yield _spectrum_row(TaskContext.get().partitionId(), spectra.joined())

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        return pd.DataFrame(_spectrum_row(int(rows["part"].iloc[0]) // FAN_IN, _spectra(rows, dim).joined()))

    spectra = arrow_map(fit.select("key").repartition(parts), decompose, _SPECTRUM)
    while parts > 1:
        spectra = spectra.groupBy(F.floor(F.col("part") / FAN_IN).alias("group")).applyInPandas(merge, _SPECTRUM)
        parts = -(-parts // FAN_IN)
    row = spectra.collect()[0]
    roots, basis = np.frombuffer(row["roots"]), np.frombuffer(row["basis"]).reshape(dim, dim)
    return np.linalg.qr(basis[:, np.argsort(-roots)])[0]


@dataclass
class Whitening:
    """A fitted whitening: sums of the integer vectors, components (columns), their eigenvalues and shares."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.asarray([s / self.n for s in self.sums])

    def project(self, values: np.ndarray) -> np.ndarray:
        return (values - self.mean) @ (self.components / np.sqrt(self.values))

    def deviations(self, values: np.ndarray) -> list[int | None]:
        """Exact sums of ``(n x - sums)**2``; none where no long holds the sum."""
        largest = self.n * np.abs(values.astype(np.float64)).max() + max(abs(s) for s in self.sums)
        if largest**2 * values.shape[1] < 2.0**62:
            apart = self.n * values - np.asarray(self.sums, dtype=np.int64)
            return (apart * apart).sum(axis=1).tolist()
        exact = [sum((self.n * x - s) ** 2 for x, s in zip(row, self.sums)) for row in values.tolist()]
        return [v if v < 2**63 else None for v in exact]


def usable_vectors(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """Rows (id, vec) whose vector is neither null nor empty and holds only finite entries."""
    finite = F.forall(vector_column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.size(vector_column) > 0).where(finite).select(F.col(id_column).alias("id"), F.col(vector_column).alias("vec"))


def fit_whitening(rows: DataFrame, scale: float = 64.0, components: int = 16) -> tuple[Whitening, int] | None:
    """The whitening of the distinct integer vectors of ``rows`` (id, vec) and their dimension; None without rows."""
    scratch = Scratch(rows.sparkSession)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            column = batch.column("vec")
            sizes = np.diff(column.offsets.to_numpy()) if batch.num_rows else np.zeros(0, dtype=int)
            for dim in np.unique(sizes).tolist():
                part = column.filter(pa.array(sizes == dim))
                keys = _keys(integers(part, scale))
                yield {"dim": [dim] * len(keys), "key": keys}

    fit = scratch.keep(arrow_map(rows.select("vec"), keyed, "dim int, key binary").distinct())
    lengths = fit.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not lengths:
        scratch.drop(fit)
        return None
    dim, n = lengths[0]["dim"], lengths[0]["count"]
    own = fit.where(F.col("dim") == dim).select("key")
    sums = _integer_sums(own, dim)
    mean = np.asarray([s / n for s in sums])
    basis = combined_basis(own, dim, n, mean)

    def squared(batch: pa.RecordBatch) -> np.ndarray:
        part = (_unkeyed(batch.column("key"), dim) - mean) @ basis
        return (part.T @ part).ravel()

    found = _summed(own, squared)
    ritz = np.asarray([found[i] for i in range(dim * dim)]).reshape(dim, dim) / n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    spread = float(np.trace(ritz))
    kept = np.flatnonzero(values[:components] > spread * dim * _EPS)
    axes = basis @ turn[:, kept]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(kept))] < 0, -1.0, 1.0)
    fitted = Whitening(n, sums, axes, values[kept], values[kept] / spread if spread else values[kept])
    if len(kept):

        def white(batch: pa.RecordBatch) -> np.ndarray:
            part = fitted.project(_unkeyed(batch.column("key"), dim))
            return np.concatenate([(part.T @ part).ravel(), part.sum(axis=0)])

        k = len(kept)
        found = _summed(own, white)
        flat = np.asarray([found[i] for i in range(k * k + k)]) / n
        covariance = flat[: k * k].reshape(k, k) - np.outer(flat[k * k :], flat[k * k :])
        fitted.identity_error = float(np.abs(covariance - np.eye(k)).max())
    scratch.drop(fit)
    return fitted, dim


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: float = 64.0, components: int = 16) -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error): up to ``components`` for each usable vector.

    Entries become ``floor(scale * entry)``; a constant added to all of them changes no result. The fit weighs every
    distinct integer vector once, output has every usable row, repeated rows and null ids included. Null or empty vectors
    and vectors with null or non-finite entries have no rows. Vectors of different lengths have no common covariance: the
    length that most distinct vectors have is fitted (ties: the longer), others have no rows. Components without
    variance (one distinct vector, constant or dependent entries) have no rows either, as whitened has no value there.
    ``deviation`` is null where a long cannot hold it; equal eigenvalues leave their components free within their space.
    Other columns of the input are not read. An empty table gives no rows.
    """
    schema = f"{id_column} {dict(vectors.dtypes)[id_column]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable_vectors(vectors, id_column, vector_column)
    fitted = fit_whitening(rows, scale, components)
    if fitted is None or not len(fitted[0].values):
        return vectors.sparkSession.createDataFrame([], schema)
    model, dim = fitted
    count = len(model.values)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = integers(batch.column("vec"), scale)
            yield {
                id_column: batch.column("id").take(pa.array(np.repeat(np.arange(len(values)), count))),
                "component": np.tile(np.arange(1, count + 1), len(values)),
                "n": np.full(len(values) * count, model.n),
                "deviation": [v for v in model.deviations(values) for _ in range(count)],
                "whitened": model.project(values).ravel(),
                "explained": np.tile(model.explained, len(values)),
                "identity_error": np.full(len(values) * count, model.identity_error),
            }

    return arrow_map(rows.where(F.size("vec") == dim), task, schema)
