"""Whitening of embeddings with a weighted multiplicity covariance.

Every entry c becomes the long x = floor(64 c) + 1000000. Equal x vectors are one class with a count; the fit uses each class with
weight one or with its count. Sums are exact integers; the covariance is a weighted product of centred matrices that every task forms
over its own classes, so only width x width numbers leave a task and their sum reaches the driver. There the eigenvectors are taken.
Each class is whitened once and the result joins back to its rows, so a vector that fills a third of the table costs one class and
then a join whose row side can be split.

Vectors of different lengths are separate fits. Defined results: rows whose vector is null, empty or holds null or non-finite entries
are dropped; a null vec_id stays null; repeated rows are returned each; an entry whose x is beyond +-2^52 is taken as that bound; a
component without variance (eigenvalue at most 1e-12 of the largest) is not one and gets no rows, so a table with one distinct vector,
like an empty one, gives no rows; a deviation beyond a long is null. Extra columns are ignored."""
from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from bourseflow.llm.common import stored

OFFSET, SCALE, BOUND = 1_000_000, 64, 2**52
LONG = 2**63 - 1


@dataclass(frozen=True)
class Settings:
    components: int = 16
    weights: str = "one"             # or "count": a class weighs as many rows as have it
    flat: float = 1e-12              # eigenvalues up to this share of the largest are no components


@dataclass(frozen=True)
class Fit:
    """What the tasks need to whiten vectors of one length; its size is set by the length alone."""
    n: int
    sums: tuple[int, ...]            # of x - OFFSET
    axes: np.ndarray                 # length x components, unit eigenvectors
    values: np.ndarray               # eigenvalues of all components, falling
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """x: integer rows, less OFFSET."""
        return (x - self.mean) @ self.axes / np.sqrt(self.values[:self.axes.shape[1]])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; the offset cancels."""
        most = self.n * max(1, int(np.abs(x).max(initial=0))) + max(map(abs, self.sums), default=0)
        exact = np.int64 if most * most * x.shape[1] <= LONG else object
        d = x.astype(exact) * self.n - np.array(self.sums, exact)
        return [int(v) if v <= LONG else None for v in (d * d).sum(axis=1)]


def rows_of(vectors: DataFrame) -> DataFrame:
    """vec_id, x (less OFFSET) and a 128-bit key of x, for the rows that remain."""
    e = F.col("embedding")
    fine = (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    bound = F.lit(float(BOUND))
    x = F.transform(e, lambda v: F.floor(F.greatest(F.least(v.cast("double") * SCALE, bound), -bound)).cast("long"))
    return (vectors.where(F.coalesce(fine, F.lit(False))).select("vec_id", x.alias("x"))
            .select("vec_id", "x", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(13), "x").alias("h2")))


def classes_of(rows: DataFrame) -> DataFrame:
    """Each distinct x once: its key, width, number of rows and vector. Equal vectors are counted before the shuffle."""
    return rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.first("x").alias("x")).withColumn("width", F.size("x"))


def _matrix(rows: pa.RecordBatch, width: int) -> np.ndarray:
    return pc.list_flatten(rows.column("x")).to_numpy(zero_copy_only=False).reshape(-1, width)


def _by_width(batch: pa.RecordBatch):
    for width in pc.unique(batch.column("width")).to_pylist():
        yield width, batch.filter(pc.equal(batch.column("width"), width))


def _weights(rows: pa.RecordBatch, s: Settings) -> np.ndarray:
    return rows.column("copies").to_numpy(zero_copy_only=False) if s.weights == "count" else np.ones(rows.num_rows, np.int64)


def exact_sums(classes: DataFrame, s: Settings) -> dict[int, tuple[int, tuple[int, ...]]]:
    """By width: weight of all classes and weighted sums of x, exact."""
    def run(batches):
        held: dict[int, tuple[int, list[int]]] = {}
        for b in batches:
            for width, rows in _by_width(b):
                x, w = _matrix(rows, width), _weights(rows, s)
                safe = int(np.abs(x).max(initial=0)) * int(w.sum()) <= LONG
                total = [int(v) for v in (w.astype(np.int64 if safe else object) @ x.astype(np.int64 if safe else object))]
                n, old = held.get(width, (0, [0] * width))
                held[width] = n + int(w.sum()), [a + v for a, v in zip(old, total)]
        for width, (n, total) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([width] * (width + 1), pa.int32()), pa.array(range(-1, width), pa.int32()),
                                              pa.array([Decimal(v) for v in (n, *total)], pa.decimal128(38, 0))], ["width", "at", "total"])
    parts = classes.select("x", "width", "copies").mapInArrow(run, "width int, at int, total decimal(38,0)")
    got: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("width", "at").agg(F.sum("total").alias("total")).collect():      # width + 1 rows for each width
        got.setdefault(r.width, {})[r.at] = int(r.total)
    return {width: (v[-1], tuple(v[i] for i in range(width))) for width, v in got.items()}


def _summed_products(classes: DataFrame, run) -> dict[int, np.ndarray]:
    """Sum of the symmetric matrices that `run` gives in each task, as rows (width, i, upper part of row i)."""
    parts = classes.select("x", "width", "copies").mapInArrow(run, "width int, i int, row array<double>")
    entries = parts.select("width", "i", F.posexplode("row").alias("k", "v")).groupBy("width", "i", "k").agg(F.sum("v").alias("v"))
    rows = entries.groupBy("width", "i").agg(F.sort_array(F.collect_list(F.struct("k", "v")))["v"].alias("row"))
    out: dict[int, np.ndarray] = {}
    for r in rows.collect():                                 # one matrix for each width
        m = out.setdefault(r.width, np.zeros((r.i + len(r.row), r.i + len(r.row))))
        m[r.i, r.i:] = m[r.i:, r.i] = r.row
    return out


def _emit(held: dict[int, np.ndarray]):
    for width, m in held.items():
        rows = [m[i, i:].tolist() for i in range(len(m))]
        yield pa.RecordBatch.from_arrays([pa.array([width] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int32()),
                                          pa.array(rows, pa.list_(pa.float64()))], ["width", "i", "row"])


def covariances(classes: DataFrame, sums: dict[int, tuple[int, tuple[int, ...]]], s: Settings) -> dict[int, np.ndarray]:
    """Weighted covariance of x by width: centred first, then multiplied."""
    mean = {width: np.array([t / n for t in total]) for width, (n, total) in sums.items()}

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for width, rows in _by_width(b):
                centred = _matrix(rows, width) - mean[width]
                held[width] = held.get(width, 0) + (centred * _weights(rows, s)[:, None]).T @ centred
        yield from _emit(held)
    return {width: m / sums[width][0] for width, m in _summed_products(classes, run).items()}


def fitted(classes: DataFrame, s: Settings = Settings()) -> dict[int, Fit]:
    """One fit for each vector length of the stored classes."""
    if s.weights not in ("one", "count"):
        raise ValueError(f"weights are 'one' or 'count', not {s.weights!r}")
    sums, out = exact_sums(classes, s), {}
    for width, v in covariances(classes, sums, s).items():
        values, axes = np.linalg.eigh(v)
        values, axes = values[::-1], axes[:, ::-1]
        real = int((values > s.flat * max(values[0], 0)).sum()) if values[0] > 0 else 0
        out[width] = Fit(*sums[width], axes[:, :min(s.components, real)].copy(), values.copy(), float(np.trace(v)))
    return out


def whitened(classes: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """h1, h2, width, deviation, whitened (one entry per component) of each class."""
    def run(batches):
        for b in batches:
            for width, rows in _by_width(b):
                fit, x = fits[width], _matrix(rows, width)
                y = fit.whiten(x)
                at = pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("h1"), rows.column("h2"), rows.column("width"), pa.array(fit.deviations(x), pa.int64()),
                     pa.ListArray.from_arrays(at, pa.array(y.ravel()))], ["h1", "h2", "width", "deviation", "whitened"])
    return classes.select("h1", "h2", "width", "x").mapInArrow(
        run, "h1 long, h2 long, width int, deviation long, whitened array<double>")


def identity_errors(classes: DataFrame, fits: dict[int, Fit], s: Settings) -> dict[int, float]:
    """Largest absolute entry of the whitened fit list's covariance less the identity, measured over all classes again.

    Each task adds a row of ones to the whitened vectors, so one product has both the sums and the squares."""
    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for width, rows in _by_width(b):
                y, w = fits[width].whiten(_matrix(rows, width)), _weights(rows, s)
                y = np.column_stack([y, np.ones(len(y))])
                held[width] = held.get(width, 0) + (y * w[:, None]).T @ y
        yield from _emit(held)
    out = {}
    for width, m in _summed_products(classes, run).items():
        m = m / fits[width].n
        k = len(m) - 1
        out[width] = float(np.abs(m[:k, :k] - np.outer(m[:k, k], m[:k, k]) - np.eye(k)).max(initial=0.0))
    return out


def whiten(vectors: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, dict[int, Fit], dict[int, float]]:
    """One row per remaining row (vec_id, width, deviation, whitened array), the fits and their identity errors by width."""
    rows = rows_of(vectors)
    classes = stored(classes_of(rows), "vector-classes")
    fits = fitted(classes, s)
    once = stored(whitened(classes, fits), "whitened-classes")
    back = rows.select("vec_id", "h1", "h2").join(once, ["h1", "h2"]).select("vec_id", "width", "deviation", "whitened")
    return back, fits, identity_errors(classes, fits, s)


def components_of(vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per remaining row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error, width."""
    back, fits, errors = whiten(vectors, s)
    facts = [(width, k + 1, fit.n, float(fit.values[k] / fit.trace), errors[width])
             for width, fit in fits.items() for k in range(fit.axes.shape[1])]
    # components x widths rows
    told = F.broadcast(vectors.sparkSession.createDataFrame(facts, "width int, component int, n long, explained double, identity_error double"))
    long = back.select("vec_id", "width", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return (long.withColumn("component", F.col("k") + 1).join(told, ["width", "component"])
            .select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "width"))
