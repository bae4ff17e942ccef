"""Whitening of embeddings by components of their covariance, found by spectral divide and conquer.

The polar factor of a shifted covariance (by QDWH iterations, which need QR decompositions and products only) tells eigenvalues above
the shift from those below: (U + I) / 2 projects on the invariant subspace of the former. A basis of it and of its complement splits the matrix in two, which
are split again until single components are left.

Spark finds the distinct vectors, their sums and their covariance; the driver decomposes the covariance, dims x dims numbers however many rows there
are, and the rows are whitened with the broadcast components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skytrace.sources.storage import Scratch

EPS = np.finfo(float).eps


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by dynamically weighted Halley iterations."""
    n = len(a)
    x = a / np.linalg.norm(a)
    low = EPS  # no singular value that counts is smaller
    eye = np.eye(n)
    for _ in range(20):
        d = np.cbrt(4 * (1 - low**2) / low**4)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * root))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack((np.sqrt(wc) * x, eye)))
        new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        change = np.linalg.norm(new - x)
        x = new
        if low > 1 - 10 * EPS and change < np.cbrt(EPS):
            break
    return x


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below a shift; None if ``a`` is a multiple of the identity but for rounding."""
    n = len(a)
    diagonal = np.diag(a)
    middle = diagonal.mean()
    if np.linalg.norm(a - middle * np.eye(n)) <= 4 * n * EPS * scale:
        return None
    places = np.unique(diagonal)
    # a shift between the least and the largest element of the diagonal has eigenvalues on either side
    shifts = np.concatenate(([np.median(diagonal)], (places[1:] + places[:-1]) / 2, [middle]))
    shifts = shifts[np.argsort(np.abs(shifts - np.median(diagonal)), kind="stable")]
    best = None
    for jitter in (0.0, 1e-6, -1e-6, 1e-3, -1e-3):
        for shift in shifts[:8]:
            u = polar(a - (shift + jitter * np.linalg.norm(a - middle * np.eye(n))) * np.eye(n))
            projector = (u + np.eye(n)) / 2
            k = round(float(np.trace(projector)))
            if not 0 < k < n:
                continue
            wrong = np.linalg.norm(projector @ projector - projector)  # an eigenvalue at the shift is on neither side
            if wrong > 1e-8:
                continue
            start = np.argsort(-np.linalg.norm(projector, axis=0), kind="stable")[:k]
            q = projector[:, start]
            for _ in range(3):
                q, _ = np.linalg.qr(projector @ q)
            full, _ = np.linalg.qr(np.hstack((q, np.eye(n) - q @ q.T)))
            above, below = full[:, :k], full[:, k:n]
            left = np.linalg.norm(below.T @ a @ above)
            if best is None or left < best[0]:
                best = left, above, below
            if left <= 8 * n * EPS * scale:
                return above, below
    if best is None:
        raise ArithmeticError("no shift splits the covariance")
    return best[1:]


def eigen_components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, by divide and conquer."""
    v = (v + v.T) / 2
    scale = float(np.linalg.norm(v)) or 1.0
    done: list[np.ndarray] = []
    open_ = [np.eye(len(v))]
    while open_:
        basis = open_.pop()
        if basis.shape[1] == 1:
            done.append(basis)
            continue
        parts = _split(basis.T @ v @ basis, scale)
        if parts is None:
            done += [basis[:, i : i + 1] for i in range(basis.shape[1])]
        else:
            open_ += [basis @ p for p in parts]
    vectors = np.hstack(done) if done else np.zeros((0, 0))
    if len(v):
        vectors = np.linalg.qr(vectors)[0]
    values = np.einsum("ij,ij->j", vectors, v @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Whitening:
    """What whitens: number and sums of the fitted vectors, eigenvalues, unit eigenvectors as columns, the trace of the covariance."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n times the vectors less their mean, exact."""
        return _scaled(x, self.n, self.sums)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) / self.n @ (self.vectors / np.sqrt(self.values))


def _scaled(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - sums`` in 64-bit integers, or in Python's where those don't hold it."""
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max((abs(int(s)) for s in sums), default=0)
    if top < 1 << 62:
        return x * np.int64(n) - np.array([int(s) for s in sums], np.int64)
    return x.astype(object) * n - np.array([int(s) for s in sums], object)


def deviations(centred: np.ndarray) -> list[int]:
    """The sum of squares of each row, exact."""
    top = max(abs(int(centred.max(initial=0))), abs(int(centred.min(initial=0))))
    if centred.shape[1] * top * top < 1 << 63:
        return (centred.astype(np.int64) ** 2).sum(1).tolist()
    return [sum(int(c) ** 2 for c in row) for row in centred]


def quantised(vector: Column, scale: int, offset: int) -> Column:
    """``floor(scale * c) + offset`` of each entry; null for a vector that is null or has a null, NaN or infinite entry."""
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return F.when(~F.exists(vector, bad), F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(offset)))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _summed(vectors: DataFrame, of: Callable[[np.ndarray], np.ndarray], kind: str) -> dict[int, np.ndarray | int]:
    """The sum over all vectors of an array that ``of`` gives for a batch: each task adds up its own, Spark the tasks' entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = of(_matrix(batch.column(0).slice(lo, 4096))).ravel()
                total = part if total is None else total + part
        if total is not None:
            for lo in range(0, len(total), 1 << 16):
                part = total[lo : lo + (1 << 16)]
                values = [int(x) for x in part] if part.dtype == object else part
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + len(part))), pa.array(values, arrow)], ["at", "value"])

    arrow = pa.decimal128(38) if kind == "decimal(38,0)" else pa.float64()
    parts = vectors.mapInArrow(run, f"at long, value {kind}").groupBy("at").agg(F.sum("value").alias("value"))
    return {r["at"]: r["value"] for r in parts.collect()}  # as many as entries, whatever the rows


def _square(entries: dict, dims: int) -> np.ndarray:
    out = np.zeros(dims * dims)
    out[list(entries)] = list(entries.values())
    return out.reshape(dims, dims)


def fit_whitening(vectors: DataFrame, most: int = 16, max_dims: int = 4096) -> Whitening | None:
    """Fit to a table of one array column of longs, each distinct vector once; None if there is none.

    Components without variance (beyond rounding) are left out. ``max_dims`` bounds what comes to the driver: dims x dims numbers, else an error.
    """
    lengths = vectors.select(F.size(vectors.columns[0]).alias("dims")).groupBy("dims").agg(F.count("*").alias("n")).limit(2).collect()
    if not lengths or lengths[0]["dims"] == 0:
        return None
    if len(lengths) > 1 or lengths[0]["dims"] > max_dims:
        raise ValueError(f"vectors must have one length, {max_dims} at most")
    dims, n = lengths[0]["dims"], lengths[0]["n"]
    by_dim = _summed(vectors, lambda x: x.astype(object).sum(0) if len(x) else np.zeros(dims, object), "decimal(38,0)")
    sums = np.array([int(by_dim[i]) for i in range(dims)], object)

    def gram(x: np.ndarray) -> np.ndarray:
        c = (_scaled(x, n, sums) / n).astype(float)
        return c.T @ c

    covariance = _square(_summed(vectors, gram, "double"), dims) / n
    values, components = eigen_components(covariance)
    rank = min(most, int((values > dims * 8 * EPS * np.trace(covariance)).sum()))
    fit = Whitening(n, sums, values[:rank], components[:, :rank], float(np.trace(covariance)))
    if rank:

        def moments(x: np.ndarray) -> np.ndarray:
            w = fit.apply(x).astype(float)
            return np.concatenate((w.sum(0), (w.T @ w).ravel()))  # w has no mean but for rounding, which is taken off below

        total = _summed(vectors, moments, "double")
        mean = np.array([total[i] for i in range(rank)]) / n
        spread = np.array([total[rank + i] for i in range(rank * rank)]).reshape(rank, rank) / n - np.outer(mean, mean)
        fit.identity_error = float(np.abs(spread - np.eye(rank)).max())
    return fit


def whiten_embeddings(embeddings: DataFrame, vector_col: str = "embedding", most: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """A row for each vector and component: ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Rows whose vector is null, or has null, NaN or infinite entries, are left out. Vectors become integers,
    ``floor(scale * c) + offset``, and each distinct one counts once in the fit, so a vector that many rows repeat weighs as
    much as any other; the rows that repeat it all have their results. All vectors must have one length (else an error), and entries
    and deviations must fit 64-bit integers (else an error). An empty table, empty vectors and components without variance (as of a single
    distinct vector) give no rows. Other columns are kept but for the vector; those with names of new ones are replaced.
    """
    spark = embeddings.sparkSession
    new = {"component": "int", "n": "long", "deviation": "long", "whitened": "double", "explained": "double", "identity_error": "double"}
    rest = [c for c in embeddings.columns if c != vector_col and c not in new]
    rows = embeddings.select(*(F.col(c) for c in rest), quantised(F.col(vector_col), scale, offset).alias("__x")).where("__x IS NOT NULL")
    scratch = Scratch(spark, "whitening")
    fit = fit_whitening(scratch.write(rows.select("__x").distinct(), "distinct"), most)
    scratch.finish()
    schema = T.StructType([*(f for f in rows.schema if f.name != "__x"), *(T.StructField(k, T._parse_datatype_string(v)) for k, v in new.items())])
    if fit is None:
        return spark.createDataFrame([], schema)
    rank, shares = len(fit.values), fit.values / fit.trace if fit.trace else fit.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows if rank else 0, 4096):
                part = batch.slice(lo, 4096)
                x, size = _matrix(part.column("__x")), part.num_rows
                again = np.repeat(np.arange(size), rank)
                columns = {c: part.column(c).take(pa.array(again)) for c in rest} | {
                    "component": pa.array(np.tile(np.arange(1, rank + 1, dtype=np.int32), size)),
                    "n": pa.array(np.full(size * rank, fit.n, np.int64)),
                    "deviation": pa.array(deviations(fit.centred(x)), pa.int64()).take(pa.array(again)),
                    "whitened": pa.array(fit.apply(x).astype(float).ravel()),
                    "explained": pa.array(np.tile(shares, size)),
                    "identity_error": pa.array(np.full(size * rank, fit.identity_error)),
                }
                yield pa.RecordBatch.from_arrays([columns[c] for c in schema.names], schema.names)

    return rows.mapInArrow(run, schema)
