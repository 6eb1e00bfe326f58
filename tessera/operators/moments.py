"""Mergeable centred moments, and what can be fitted from them without reading the rows again.

A set of rows is known by its number, its means and the sums of centred products. Two sets merge
exactly (the pairwise update of means and products), so tasks reduce their rows to one small
matrix each, and nothing is lost to large means as in sums of raw products.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """Number of rows, means and sums of centred products of some columns."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        if not len(x):
            return Moments(0, np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2))
        mean = x.mean(axis=0)
        return Moments(len(x), mean, (x - mean).T @ (x - mean))

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n or not other.n:
            return self
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.products + other.products + np.outer(gap, gap) * (self.n * other.n / n))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def reduced(df: DataFrame, start, step, merge, tasks: int = 8):
    """merge() over all rows of df: a task starts from start(), takes Arrow batches by step(), and sends one value.

    The values of the tasks are merged by a few tasks before the driver merges theirs.
    """
    import pickle

    def fold(batches):
        total = start()
        for batch in batches:
            total = step(total, batch)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["value"])

    def join(batches):
        total = start()
        for batch in batches:
            for value in batch.column("value").to_pylist():
                total = merge(total, pickle.loads(value))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["value"])

    total = start()
    for r in df.mapInArrow(fold, "value binary").repartition(tasks).mapInArrow(join, "value binary").collect():
        total = merge(total, pickle.loads(r["value"]))
    return total


def with_target(df: DataFrame, features: str = "features") -> DataFrame:
    """x (array, the target last) of the rows that have a target."""
    return df.filter("y IS NOT NULL").select(F.concat(vector_to_array(features), F.array(F.col("y").cast("double"))).alias("x"))


def moments(rows: DataFrame) -> Moments | None:
    """Of the array column x, by one aggregation; None without rows."""

    def step(total, batch):
        if not batch.num_rows:
            return total
        some = Moments.of(_matrix(batch.column("x")))
        return some if total is None else total + some

    return reduced(rows, lambda: None, step, lambda a, b: b if a is None else a if b is None else a + b)


def target_moments(df: DataFrame, features: str = "features") -> tuple[Moments, Moments]:
    """Moments of (features, y) over the rows that have a target and, with 0 for it, over the others: one pass."""
    y = F.col("y").cast("double")
    rows = df.select(F.concat(vector_to_array(features), F.array(F.coalesce(y, F.lit(0.0)))).alias("x"), y.isNotNull().alias("has"))

    def step(total, batch):
        if not batch.num_rows:
            return total
        x, has = _matrix(batch.column("x")), batch.column("has").to_numpy(zero_copy_only=False)
        return merge(total, (Moments.of(x[has]), Moments.of(x[~has])))

    def merge(a, b):
        return b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])

    found = reduced(rows, lambda: None, step, merge)
    if found is None:
        raise ValueError("a window has no rows")
    return found


def descend(h: np.ndarray, b: np.ndarray, lasso: np.ndarray, ridge: np.ndarray, start: np.ndarray, tolerance: float = 1e-12, sweeps: int = 100_000) -> np.ndarray:
    """The w that minimises w'hw / 2 - b'w + sum lasso |w| + sum ridge w^2 / 2, by cyclic coordinate descent with covariance updates."""
    w, size = start.copy(), np.diag(h) + ridge
    pull = b - h @ w
    live = np.flatnonzero(size > 0)
    for _ in range(sweeps):
        moved = 0.0
        for j in live:
            aim = pull[j] + h[j, j] * w[j]
            new = np.sign(aim) * max(abs(aim) - lasso[j], 0.0) / size[j]
            step = new - w[j]
            if step:
                pull -= step * h[j]
                w[j] = new
                moved = max(moved, abs(step))
        if moved <= tolerance * max(1.0, np.abs(w).max(initial=0.0)):
            break
    return w


def elastic_net_path(m: Moments, alphas: Sequence[float], ratios: Sequence[float], ridge_below: float = 0.05) -> dict[tuple[float, float], tuple[np.ndarray, float]]:
    """Weights and intercept of every (alpha, l1), for the rows with moments m (target last).

    Minimises |y - Xw|^2 / 2n + alpha l1 |w|_1 + alpha (1 - l1) |w|^2 / 2 on columns of unit
    (population) deviation; below `ridge_below` it is ridge, where alpha counts against the sum of squares. Each l1 goes
    from the largest alpha down and starts where the last one ended. Constant columns get 0.
    """
    sd = np.sqrt(np.diag(m.products)[:-1] / max(1, m.n))
    live = sd > 1e-12
    scale = np.where(live, sd, 1.0)
    h = m.products[:-1, :-1] / np.outer(scale, scale) / m.n * np.outer(live, live)
    b = m.products[:-1, -1] / scale / m.n * live
    out, ones = {}, np.ones(len(b))
    for l1 in ratios:
        w = np.zeros(len(b))
        for alpha in sorted(alphas, reverse=True):
            if l1 < ridge_below:
                w = np.linalg.lstsq(h + alpha / m.n * np.diag(live.astype(float)), b, rcond=None)[0]
            else:
                w = descend(h, b, alpha * l1 * ones, alpha * (1 - l1) * ones, w)
            raw = np.where(live, w / scale, 0.0)
            out[float(alpha), float(l1)] = raw, float(m.mean[-1] - raw @ m.mean[:-1])
    return out


def zero_r2(m: Moments, weights: np.ndarray, level: float) -> float | None:
    """1 - sum of squared errors over sum of squares of a linear model, on the rows with moments m (target last)."""
    full = np.append(-weights, 1.0)
    off = m.mean[-1] - weights @ m.mean[:-1] - level
    total = m.products[-1, -1] + m.n * m.mean[-1] ** 2
    return float(1 - (full @ m.products @ full + m.n * off * off) / total) if total > 0 else None


def huber_paths(df: DataFrame, alpha: float, l1: float, epsilons: Sequence[float], features: str = "features", steps: int = 20, tolerance: float = 1e-8) -> tuple[dict[float, tuple[np.ndarray, float]], int]:
    """Weights and intercept of Huber loss with an elastic-net penalty for every epsilon, and the passes taken.

    Proximal Newton: one pass gives every epsilon the loss, the gradient and the second moments
    of the rows inside its bounds; the model so made is minimised on the driver by coordinate
    descent. A step that raises the objective is halved and tried again by the next pass.
    """
    rows = df.filter("y IS NOT NULL").select(F.concat(vector_to_array(features), F.array(F.lit(1.0), F.col("y").cast("double"))).alias("x")).cache()
    start = moments(rows)
    if start is None:
        rows.unpersist()
        return {float(e): (np.zeros(0), 0.0) for e in epsilons}, 1
    k, n = len(start.mean) - 1, start.n
    free = np.append(np.ones(k - 1), 0.0)  # the intercept is not penalised
    lasso, ridge = alpha * l1 * free, alpha * (1 - l1) * free
    raw = start.products + n * np.outer(start.mean, start.mean)
    # from the least-squares solution, which needs no pass of its own
    first = descend(raw[:-1, :-1] / n, raw[:-1, -1] / n, lasso, ridge, np.zeros(k))
    now = {float(e): None for e in epsilons}  # accepted: point, objective, gradient, second moments
    tried = {e: first for e in now}
    passes, open_ = 1, set(now)
    while open_ and passes < steps:
        ask = {e: tried[e] for e in open_}

        def step(total, batch, ask=ask):
            z = _matrix(batch.column("x"))
            for e, w in ask.items() if len(z) else ():
                x, r = z[:, :-1], z[:, -1] - z[:, :-1] @ w
                inside = np.abs(r) <= e
                loss = np.where(inside, r * r / 2, e * np.abs(r) - e * e / 2).sum()
                part = loss, x.T @ np.clip(r, -e, e), x[inside].T @ x[inside]
                total[e] = tuple(p + q for p, q in zip(total[e], part, strict=True)) if e in total else part
            return total

        def merge(a, b):
            return {e: tuple(p + q for p, q in zip(a[e], b[e], strict=True)) if e in a and e in b else a.get(e, b.get(e)) for e in {*a, *b}}

        found = reduced(rows, dict, step, merge)
        passes += 1
        for e in list(open_):
            loss, pull, second = (v / n for v in found[e])
            w = tried[e]
            value = loss + (lasso * np.abs(w)).sum() + (ridge * w * w).sum() / 2
            if now[e] is not None and value > now[e][1] + 1e-15 * max(1.0, abs(now[e][1])):
                tried[e] = (now[e][0] + w) / 2
                if np.abs(tried[e] - now[e][0]).max() <= tolerance:
                    open_.discard(e)
                continue
            before, now[e] = now[e], (w, value)
            h = second + 1e-12 * max(1e-300, np.trace(second)) * np.eye(k)
            tried[e] = descend(h, h @ w + pull, lasso, ridge, w)
            if np.abs(tried[e] - w).max() <= tolerance:
                open_.discard(e)
                if before is None:
                    now[e] = (w, value)
    rows.unpersist()
    return {e: (w[0][:-1], float(w[0][-1])) for e, w in now.items()}, passes
