"""K-means for many models at once: one pass over the rows serves every number of clusters and every restart.

A pass returns, from each task, the sums per model and cluster; Spark adds them up, and the driver sees one row per model and
cluster. Starts are drawn one centre a pass, each row with a chance in proportion to its squared distance from the centres
drawn before; a start of k centres begins the start of k + 1, so one chain of draws per restart serves every k. The draw is a
race by a hash of the key, so it does not depend on how rows are partitioned.

Rows must hold no nulls in their coordinates. A cluster that loses all rows keeps its centre; with fewer distinct rows than
clusters the surplus ones repeat the first centre and stay empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship

MAX_ITER, TOLERANCE = 300, 1e-4  # the tolerance: squared movement of all centres of a model


@dataclass
class Fit:
    centres: np.ndarray
    sizes: np.ndarray
    squares: np.ndarray  # sums of the squared norms of the rows of each cluster
    cost: float


def _matrix(batch: pa.RecordBatch, dims: Sequence[str]) -> np.ndarray:
    return np.column_stack([batch.column(d).to_numpy(zero_copy_only=False) for d in dims])


def _far(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    far = np.zeros((len(x), len(centres)))
    for j in range(x.shape[1]):
        far += (x[:, j, None] - centres[None, :, j]) ** 2
    return far


def _step_sums(models: Sequence[np.ndarray], dims: Sequence[str]) -> Callable:
    d = len(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(c), d + 3)) for c in models]  # rows, cost, squares, coordinates
        for batch in batches:
            x = _matrix(batch, dims)
            norms = (x ** 2).sum(axis=1)
            for centres, total in zip(models, sums):
                far = _far(x, centres)
                own = far.argmin(axis=1)
                for at, weights in enumerate([None, far.min(axis=1), norms, *x.T]):
                    total[:, at] += np.bincount(own, weights, minlength=len(centres))
        every = np.concatenate(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(models)), [len(c) for c in models]), pa.int32()),
             pa.array(np.concatenate([np.arange(len(c)) for c in models]), pa.int32()), pa.array(every[:, 0].astype(np.int64)),
             *[pa.array(every[:, i].copy()) for i in range(1, d + 3)]],
            names=["model", "cluster", "n", "cost", "squares", *[f"s{j}" for j in range(d)]])

    return run


def step(rows: DataFrame, dims: Sequence[str], models: Sequence[Sequence[Sequence[float]]]) -> DataFrame:
    """One assignment of all rows by all models: ``n``, ``cost``, ``squares`` and the coordinate sums ``s0``, ``s1``, ... per
    (``model``, ``cluster``). The first of equally near centres counts."""
    ship(rows.sparkSession)
    given = [np.array(c, float) for c in models]
    sums = ["cost", "squares", *[f"s{j}" for j in range(len(dims))]]
    schema = "model int, cluster int, n long, " + ", ".join(f"{c} double" for c in sums)
    parts = rows.select(*dims).mapInArrow(_step_sums(given, dims), schema)
    return parts.groupBy("model", "cluster").agg(*[F.sum(c).alias(c) for c in ["n", *sums]])


def _sums(rows: DataFrame, dims: Sequence[str], models: Sequence[np.ndarray]) -> list[np.ndarray]:
    """The rows of ``step``, one array [clusters, 3 + dimensions] per model."""
    out = [np.zeros((len(c), len(dims) + 3)) for c in models]
    for r in step(rows, dims, models).collect():
        out[r["model"]][r["cluster"]] = r[2:]
    return out


def _mixed(bits: np.ndarray) -> np.ndarray:
    """Bits spread evenly (the usual 64-bit finaliser)."""
    with np.errstate(over="ignore"):
        bits = (bits ^ (bits >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        bits = (bits ^ (bits >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return bits ^ (bits >> np.uint64(31))


def _races(drawn: Sequence[np.ndarray], seeds: Sequence[int], dims: Sequence[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.inf, None)] * len(drawn)
        for batch in batches:
            x = _matrix(batch, dims)
            bits = batch.column("_h").to_numpy(zero_copy_only=False).view(np.uint64)
            for i, centres in enumerate(drawn):
                weight = _far(x, centres).min(axis=1) if len(centres) else np.ones(len(x))
                salt = np.uint64((seeds[i] * 1_000_003 + len(centres) + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
                chance = ((_mixed(bits ^ salt) >> np.uint64(11)) + 0.5) / (1 << 53)
                with np.errstate(divide="ignore"):
                    time = np.where(weight > 0, -np.log(chance) / weight, np.inf)
                at = int(time.argmin()) if len(time) else 0
                if len(time) and time[at] < best[i][0]:
                    best[i] = (time[at], x[at])
        found = [(i, t, at.tolist()) for i, (t, at) in enumerate(best) if at is not None]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.float64()),
             pa.array([f[2] for f in found], pa.list_(pa.float64()))], names=["model", "time", "point"])

    return run


def starts(rows: DataFrame, dims: Sequence[str], key: str, k: int, seeds: Sequence[int]) -> list[np.ndarray]:
    """For each seed a chain of k centres; its first centres are the start for fewer clusters."""
    ship(rows.sparkSession)
    hashed = rows.select(*dims, F.xxhash64(key).alias("_h"))
    drawn = [np.empty((0, len(dims))) for _ in seeds]
    for _ in range(k):
        times = hashed.mapInArrow(_races(drawn, seeds, dims), "model int, time double, point array<double>")
        first = {r["model"]: r["point"] for r in times.groupBy("model").agg(
            F.min(F.struct("time", "point"))["point"].alias("point")).collect()}
        if not first and not len(drawn[0]):
            raise ValueError("no rows to cluster")
        drawn = [np.vstack([c, first[i] if i in first else c[0]]) for i, c in enumerate(drawn)]
    return drawn


def best_fits(rows: DataFrame, dims: Sequence[str], key: str, ks: Sequence[int], restarts: int, seed: int) -> list[Fit]:
    """For each k the restart with the least cost. Models that no longer move leave the passes."""
    chains = starts(rows, dims, key, max(ks), [seed + i for i in range(restarts)])
    models = [chains[i][:k] for k in ks for i in range(restarts)]
    moving = list(range(len(models)))
    for _ in range(MAX_ITER):
        if not moving:
            break
        still = []
        for m, sums in zip(moving, _sums(rows, dims, [models[m] for m in moving])):
            n = sums[:, :1]
            new = np.where(n > 0, sums[:, 3:] / np.maximum(n, 1), models[m])
            if ((new - models[m]) ** 2).sum() > TOLERANCE:
                still.append(m)
            models[m] = new
        moving = still
    fits = [Fit(c, s[:, 0].astype(np.int64), s[:, 2], float(s[:, 1].sum())) for c, s in zip(models, _sums(rows, dims, models))]
    return [min(fits[i * restarts:(i + 1) * restarts], key=lambda f: f.cost) for i in range(len(ks))]


def _silhouette_sums(models: Sequence[np.ndarray], stats: Sequence[np.ndarray], dims: Sequence[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(models)), 0
        for batch in batches:
            x = _matrix(batch, dims)
            rows += len(x)
            norms = (x ** 2).sum(axis=1)
            for m, (centres, s) in enumerate(zip(models, stats)):
                own, n, line = _far(x, centres).argmin(axis=1), s[:, 0], np.arange(len(x))
                with np.errstate(divide="ignore", invalid="ignore"):
                    mean = norms[:, None] + s[None, :, 2] / n - 2 * (x @ (s[:, 3:] / n[:, None]).T)
                    mean[:, n == 0] = np.inf  # an empty cluster is nobody's neighbour
                    inside = mean[line, own] * n[own] / (n[own] - 1)
                    mean[line, own] = np.inf
                    outside = mean.min(axis=1)
                    value = np.where(outside < np.inf, (outside - inside) / np.maximum(outside, inside), 0.0)
                total[m] += np.where((n[own] > 1) & np.isfinite(value), value, 0.0).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models)), pa.int32()), pa.array(total),
                                          pa.array(np.full(len(models), rows), pa.int64())], names=["model", "total", "n"])

    return run


def silhouettes(rows: DataFrame, dims: Sequence[str], models: Sequence[Sequence[Sequence[float]]]) -> DataFrame:
    """``model`` and its mean ``silhouette_squared``, by squared distances: two passes for all models. A row alone in its
    cluster, or without another cluster, counts 0."""
    given = [np.array(c, float) for c in models]
    parts = rows.select(*dims).mapInArrow(_silhouette_sums(given, _sums(rows, dims, given), dims),
                                          "model int, total double, n long")
    return parts.groupBy("model").agg((F.sum("total") / F.sum("n")).alias("silhouette_squared"))
