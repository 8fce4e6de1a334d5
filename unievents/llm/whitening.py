"""Whitening of integer vectors by the leading components of their covariance.

Sums and centred scatter are gathered by Spark over the different vectors. The covariance,
a matrix of (vector length) squared whatever the number of rows, is brought to tridiagonal
form by Householder reflections; bisection by Sturm counts gives its leading eigenvalues
and inverse iteration, orthogonalised within clusters, their vectors. All rows are then
projected by the broadcast components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unievents.llm.common import keep, pick

EPS = np.finfo(float).eps


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of Q'AQ for a symmetric A, and the unit Householder vectors
    (reflection k acts on the entries from k + 1) whose product is Q."""
    a = np.array(matrix, float)
    vectors = []
    for k in range(len(a) - 2):
        x = a[k + 1:, k].copy()
        tall = np.abs(x[1:]).max(initial=0.0)
        v = np.zeros_like(x)
        if tall > 0:
            scale = max(tall, abs(x[0]))
            v = x / scale
            v[0] += np.copysign(np.linalg.norm(v), v[0])
            v /= np.linalg.norm(v)
            below = a[k + 1:, k + 1:]
            p = below @ v
            w = 2 * (p - (v @ p) * v)
            below -= np.outer(v, w) + np.outer(w, v)
            a[k + 1:, k] -= 2 * v * (v @ a[k + 1:, k])
            a[k, k + 1:] = a[k + 1:, k]
        vectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), vectors


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of eigenvalues of the tridiagonal matrix below each value of ``at``."""
    least = np.finfo(float).tiny / EPS
    square = off * off
    q = diagonal[0] - at
    count = (q < 0).astype(np.int64)
    for k in range(1, len(diagonal)):
        q = np.where(np.abs(q) < least, -least, q)
        q = diagonal[k] - at - square[k - 1] / q
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, wanted: int) -> np.ndarray:
    """The ``wanted`` largest eigenvalues, falling, each by bisection to the last bits."""
    n = len(diagonal)
    reach = np.abs(np.r_[off, 0]) + np.abs(np.r_[0, off])
    low, high = (diagonal - reach).min(), (diagonal + reach).max()
    wide = max(abs(low), abs(high)) * EPS * n + np.finfo(float).tiny
    lo, hi = np.full(wanted, low - wide), np.full(wanted, high + wide)
    rank = n - np.arange(wanted)  # eigenvalue k has so many eigenvalues up to itself
    for _ in range(2000):
        mid = lo + (hi - lo) / 2
        open_ = (mid > lo) & (mid < hi)
        if not open_.any():
            break
        below = sturm_counts(diagonal, off, mid) >= rank
        hi = np.where(open_ & below, mid, hi)
        lo = np.where(open_ & ~below, mid, lo)
    return np.minimum.accumulate(lo + (hi - lo) / 2)


def _solver(diagonal: np.ndarray, off: np.ndarray, value: float, norm: float):
    """Solver of (T - value) x = b by elimination with row exchanges; zero pivots are tiny."""
    n = len(diagonal)
    d, up, up2, low = (diagonal - value).tolist(), [*off.tolist(), 0.0], [0.0] * n, [*off.tolist(), 0.0]
    least = EPS * norm
    factor, swapped = [0.0] * n, [False] * n
    for k in range(n - 1):
        if abs(low[k]) > abs(d[k]):
            swapped[k] = True
            d[k], low[k] = low[k], d[k]
            up[k], d[k + 1] = d[k + 1], up[k]
            up2[k], up[k + 1] = up[k + 1], 0.0
        if abs(d[k]) < least:
            d[k] = least
        factor[k] = low[k] / d[k]
        d[k + 1] -= factor[k] * up[k]
        up[k + 1] -= factor[k] * up2[k]
    if abs(d[-1]) < least:
        d[-1] = least

    def solve(b: np.ndarray) -> np.ndarray:
        x = b.tolist()
        for k in range(n - 1):
            if swapped[k]:
                x[k], x[k + 1] = x[k + 1], x[k]
            x[k + 1] -= factor[k] * x[k]
        for k in range(n - 1, -1, -1):
            rest = x[k] - (up[k] * x[k + 1] if k + 1 < n else 0.0) - (up2[k] * x[k + 2] if k + 2 < n else 0.0)
            x[k] = rest / d[k]
        return np.array(x)

    return solve


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, seed: int = 12) -> np.ndarray:
    """A unit vector (row) for each of the falling ``values``. Eigenvalues nearer to their
    neighbour than a thousandth of the norm form a cluster; each of its vectors is made
    orthogonal to those before it in every iteration."""
    rng = np.random.default_rng(seed)
    n = len(diagonal)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    found, first, last = np.zeros((len(values), n)), 0, None
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            first = k
        near = value if last is None else min(value, last - 2 * EPS * norm)  # equal values must not meet one vector
        last = near
        solve = _solver(diagonal, off, near, norm)
        x = rng.normal(size=n)
        for _ in range(6):
            for _ in range(2):
                x -= found[first:k].T @ (found[first:k] @ x)
            x = solve(x / np.linalg.norm(x))
            x /= np.abs(x).max()
        for _ in range(2):
            x -= found[first:k].T @ (found[first:k] @ x)
            x /= np.linalg.norm(x)
        found[k] = x
    return found


def principal(covariance: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit components as rows): at most ``wanted`` and none beyond the
    rank. The largest entry of a component (the first of equals) is positive."""
    n = len(covariance)
    diagonal, off, reflections = tridiagonal(covariance)
    values = leading_eigenvalues(diagonal, off, min(wanted, n))
    values = values[values > n * EPS * max(values.max(initial=0.0), 0.0)]
    found = eigenvectors(diagonal, off, values)
    for k in range(len(reflections) - 1, -1, -1):
        v, tail = reflections[k], found[:, k + 1:]
        tail -= 2 * np.outer(tail @ v, v)
    for row in found:
        row *= np.sign(row[np.argmax(np.abs(row) > np.abs(row).max() * (1 - 1e-9))]) if row.size else 1
    return values, found


@dataclass
class Whitening:
    """What projects vectors of one length. ``middle`` is the nearest integer to the mean and
    ``rest`` the exact remainder S - n * middle, so that x - S/n loses no digit."""

    n: int
    middle: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float = float("nan")

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.middle).astype(float) - self.rest / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.values)[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums of (n * x - S) squared, exact."""
        near = x - self.middle
        most = self.n * int(np.abs(near).max(initial=0)) + self.n
        if most * most * max(x.shape[1], 1) < 1 << 63:
            return ((self.n * near - self.rest) ** 2).sum(axis=1).tolist()
        return [sum((self.n * int(a) - int(r)) ** 2 for a, r in zip(row, self.rest)) for row in near]


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = 8192) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(rows of one vector length, that length, their matrix), a bounded number at once."""
    for batch in batches:
        sizes = batch.column("d").to_numpy()
        for d in np.unique(sizes):
            some = batch.filter(pa.array(sizes == d))
            for at in range(0, some.num_rows, rows):
                part = some.slice(at, rows)
                yield part, int(d), part.column("x").flatten().to_numpy().reshape(part.num_rows, d)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for _, d, x in _blocks(batches):
        exact = int(np.abs(x).max(initial=0)) * len(x) < 1 << 62
        part = x.sum(axis=0).tolist() if exact else [sum(map(int, c)) for c in x.T]
        n, total = found.get(d, (0, [0] * d))
        found[d] = n + len(x), [a + b for a, b in zip(total, part)]
    for d, (n, total) in found.items():
        yield pa.record_batch({"d": pa.array([d] * d, pa.int32()), "i": pa.array(range(d), pa.int32()),
                               "n": pa.array([n] * d, pa.int64()), "total": pa.array(total, pa.int64())})


def _products(frame: DataFrame, value) -> dict[int, dict[tuple[int, int], float]]:
    """Sums over all rows of the products of any two entries of ``value(d, x)``, and (i, -1)
    of the entries. A task adds up its own rows; entry pairs reach the driver, no rows."""
    def gather(batches):
        found: dict[int, list] = {}
        for _, d, x in _blocks(batches):
            y = value(d, x)
            held = found.setdefault(d, [0.0, 0.0])
            held[0] = held[0] + y.T @ y
            held[1] = held[1] + y.sum(axis=0)
        for d, (square, total) in found.items():
            i, j = np.triu_indices(len(total))
            i, j, v = np.r_[i, np.arange(len(total))], np.r_[j, np.full(len(total), -1)], np.r_[square[i, j], total]
            yield pa.record_batch({"d": pa.array(np.full(len(i), d, np.int32)), "i": pa.array(i.astype(np.int32)),
                                   "j": pa.array(j.astype(np.int32)), "v": pa.array(v)})

    out: dict[int, dict[tuple[int, int], float]] = {}
    for r in frame.mapInArrow(gather, "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r["d"], {})[r["i"], r["j"]] = r["v"]
    return out


def _covariance(sums: dict[tuple[int, int], float], n: int) -> np.ndarray:
    size = 1 + max(i for i, _ in sums)
    total, mean = np.zeros((size, size)), np.zeros(size)
    for (i, j), v in sums.items():
        if j < 0:
            mean[i] = v / n
        else:
            total[i, j] = total[j, i] = v
    return total / n - np.outer(mean, mean)


def fit_whitening(fit: DataFrame, components: int) -> dict[int, Whitening]:
    """A whitening for each vector length of ``fit`` (d: length, x: array<bigint>), whose
    rows count as they are. Vectors are taken relative to the nearest integer to their mean
    before they are multiplied: those products are exact whole numbers, which add up to the
    same in any order, and what is left of the mean is at most a half."""
    means: dict[int, tuple[int, list[int]]] = {}
    sums = fit.mapInArrow(_sums, "d int, i int, n bigint, total bigint").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    for r in sums.orderBy("d", "i").collect():
        means.setdefault(r["d"], (r["n"], []))[1].append(r["total"])
    middles = {d: np.array([(2 * s + n) // (2 * n) for s in total], np.int64) for d, (n, total) in means.items()}
    found = {}
    for d, products in _products(fit, lambda d, x: (x - middles[d]).astype(float)).items():
        n, total = means[d]
        rest = np.array([s - n * int(m) for s, m in zip(total, middles[d])], np.int64)
        covariance = _covariance(products, n)
        values, vectors = principal(covariance, components)
        found[d] = Whitening(n, middles[d], rest, values, vectors, values / max(np.trace(covariance), np.finfo(float).tiny))
    measured = _products(fit.where(F.col("d").isin([d for d, w in found.items() if len(w.values)])), lambda d, x: found[d].project(x))
    for d, products in measured.items():
        found[d].identity_error = float(np.abs(_covariance(products, found[d].n) - np.eye(len(found[d].values))).max())
    return found


def grid(vector: Column, scale: int, shift: int) -> Column:
    """The entries as whole numbers: floor(scale * c) + shift, c as double."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))) + F.lit(shift).cast("bigint"))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16,
           scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each
    vector and component.

    Entries become whole numbers x (``grid``). The fit list holds every different x vector
    once (n of them, sums S): copies weigh no more than one. whitened: x - S/n projected on
    the component, over the root of its eigenvalue; deviation: sum of (n*x - S) squared,
    exact; explained: the eigenvalue's share of the trace; identity_error: largest entry of
    the whitened fit list's measured covariance minus the identity.

    Null vectors and those with null or non-finite entries give no rows; empty vectors have
    no components and give none either. Repeated rows and null ids are rows like others.
    Vectors of each length are a list of their own. Components beyond the rank (also all of
    a list of one vector) are left out, as nothing can be scaled to one along them. Equal
    eigenvalues give some orthogonal vectors of their space. Other columns of any name are
    ignored. No rows give no rows. Numbers that leave 64 bits (entries, sums, deviations)
    raise an error.

    The driver gets (length squared) / 2 numbers per length, whatever the number of rows.
    """
    plain = pick(vectors, id=id_col, v=vector_col)
    fine = F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = plain.where(fine & (F.size("v") > 0)).select("id", grid(F.col("v"), scale, shift).alias("x")).withColumn("d", F.size("x"))
    fit = keep(rows.select("d", "x").distinct(), "fit")
    shared = vectors.sparkSession.sparkContext.broadcast(fit_whitening(fit, components))

    def project(batches):
        for part, d, x in _blocks(batches, 2048):
            w = shared.value[d]
            k = len(w.values)
            if not k:
                continue
            n, y = len(x), w.project(x)
            each = np.repeat(np.arange(n), k)
            yield pa.record_batch({
                "id": part.column("id").take(pa.array(each)), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                "n": pa.array(np.full(n * k, w.n, np.int64)), "deviation": pa.array(w.deviations(x), pa.int64()).take(pa.array(each)),
                "whitened": pa.array(y.ravel()), "explained": pa.array(np.tile(w.explained, n)),
                "identity_error": pa.array(np.full(n * k, w.identity_error))})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(project, f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
