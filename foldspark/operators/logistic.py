"""Logistic regression by Newton steps that serve many fits in one pass.

A cross-validated path asks for folds x penalties models of the same rows.
Each Newton step sends all current weights to the tasks, which return the sums
of gradients and Hessians of all models at once; a path of fifty models costs
a handful of passes. L1 and elastic-net penalties and wide problems go through
the lock-step solver of ``sparse``, and so do the fits that Newton steps do not end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sparse

# Default inverse penalties of the cross-validated models.
CS = np.logspace(-4, 4, num=10)
MAX_NEWTON = 600          # weights per model (classes x width)
NO_FOLD = -1
MORE_STEPS = 40           # of the other solver, for fits that Newton steps did not end; it warns of those still open


@dataclass(frozen=True)
class Task:
    """One fit: rows outside ``without`` (all rows for -1) with inverse penalty C (inf for none)."""

    without: int
    c: float


def _design(b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = b.drop(columns=["_f", "_y"]).to_numpy(dtype=float)
    return np.column_stack([x, np.ones(len(b))]), b["_y"].to_numpy(dtype=int), b["_f"].to_numpy(dtype=int)


def _probabilities(z: np.ndarray) -> np.ndarray:
    """Class probabilities of a score matrix; one column means binary."""
    if z.shape[1] == 1:
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
        return np.column_stack([1 - p, p])
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _rows(df: DataFrame, features: Sequence[str], y: str, fold: str | None) -> DataFrame:
    folds = F.col(fold).cast("int") if fold else F.lit(0)
    return df.select(folds.alias("_f"), *[F.col(c).cast("double") for c in features], F.col(y).cast("int").alias("_y"))


def newton_fits(df: DataFrame, features: Sequence[str], tasks: Sequence[Task], n_classes: int, y: str = "y",
                fold: str | None = None, steps: int = 25, tol: float = 1e-7) -> dict[Task, np.ndarray]:
    """Weights (outputs x [features, intercept]) per task; one output for binary, else one per class.

    Minimises sum of losses + |w|^2 / 2C with a free intercept. Each pass also
    returns the loss, and a step that raised it is halved.
    """
    outs = 1 if n_classes == 2 else n_classes
    width = len(features) + 1
    if outs * width > MAX_NEWTON:
        raise ValueError("too wide for Newton steps; LinearCV takes the lock-step solver")
    rows = _rows(df, features, y, fold).persist()
    ridge = np.ones(width)
    ridge[-1] = 0.0
    weights = {t: np.zeros((outs, width)) for t in tasks}
    steps_taken = {t: np.zeros((outs, width)) for t in tasks}
    best = {t: np.inf for t in tasks}
    live = list(tasks)
    for _ in range(steps):
        now = [(i, t.without, weights[t]) for i, t in enumerate(live)]

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = outs * width
            grad, hess, loss, count = {}, {}, {}, {}
            for b in batches:
                x, label, f = _design(b)
                for i, without, w in now:
                    on = f != without
                    xs, ys = x[on], label[on]
                    p = _probabilities(xs @ w.T)
                    mine = np.clip(p[np.arange(len(ys)), ys], 1e-300, None)
                    loss[i] = loss.get(i, 0.0) - np.log(mine).sum()
                    count[i] = count.get(i, 0) + len(ys)
                    if outs == 1:
                        q = p[:, 1]
                        grad[i] = grad.get(i, 0.0) + (q - ys) @ xs
                        hess[i] = hess.get(i, 0.0) + (xs * (q * (1 - q))[:, None]).T @ xs
                    else:
                        hot = np.eye(outs)[ys]
                        grad[i] = grad.get(i, 0.0) + ((p - hot).T @ xs).ravel()
                        h = np.empty((m, m))
                        for a in range(outs):
                            for c in range(outs):
                                v = p[:, a] * ((a == c) - p[:, c])
                                h[a * width:(a + 1) * width, c * width:(c + 1) * width] = (xs * v[:, None]).T @ xs
                        hess[i] = hess.get(i, 0.0) + h
            for i in loss:
                flat = np.concatenate([[loss[i], count[i]], np.ravel(grad[i]), np.ravel(hess[i])])
                yield pd.DataFrame({"i": i, "j": np.arange(len(flat)), "v": flat})

        got = rows.mapInPandas(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
        still = []
        for i, part in got.groupby("i"):
            t, m = live[int(i)], outs * width
            flat = np.zeros(2 + m + m * m)
            flat[part["j"]] = part["v"]
            w = weights[t]
            pen = np.tile(ridge / t.c if np.isfinite(t.c) else ridge * 0.0, outs)
            value = flat[0] + 0.5 * float(pen @ (w.ravel() ** 2))
            if value > best[t] + 1e-9 * abs(best[t]):
                steps_taken[t] = steps_taken[t] / 2
                weights[t] = w - steps_taken[t]
                still.append(t)
                continue
            gain = best[t] - value
            best[t] = value
            grad = flat[2:2 + m] + pen * w.ravel()
            hess = flat[2 + m:].reshape(m, m) + np.diag(pen)
            step = -np.linalg.lstsq(hess, grad, rcond=1e-12)[0].reshape(outs, width)
            if np.abs(grad).max() / max(flat[1], 1.0) < tol or gain < 1e-10 * abs(value):
                continue
            steps_taken[t] = step
            weights[t] = w + step
            still.append(t)
        live = still
        if not live:
            break
    rows.unpersist()
    if live:                                                # not ended in so many steps: go on with the other solver
        n = {t: df.filter(F.col(fold) != t.without).count() if fold else df.count() for t in live}
        fits = {t: sparse.Fit(t.without, 0.0, 0.0 if np.isinf(t.c) else 1.0 / (t.c * n[t])) for t in live}
        with sparse.Rows(df, features, y, fold=fold) as packed:
            solved = sparse.solve(packed, list(fits.values()), "log", outs, max_steps=MORE_STEPS, start={fits[t]: weights[t] for t in live})
        weights |= {t: solved[fits[t]].weights for t in live}
    return weights


def held_out_losses(df: DataFrame, features: Sequence[str], fits: dict[Task, np.ndarray], y: str = "y",
                    fold: str = "cv_fold") -> pd.DataFrame:
    """Mean log loss of every fit on its own left-out fold, in one pass."""
    now = [(i, t.without, w) for i, (t, w) in enumerate(fits.items()) if t.without != NO_FOLD]

    def losses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = {i: np.zeros(2) for i, _, _ in now}
        for b in batches:
            x, label, f = _design(b)
            for i, without, w in now:
                on = f == without
                if on.any():
                    p = _probabilities(x[on] @ w.T)[np.arange(on.sum()), label[on]]
                    acc[i] += [-np.log(np.clip(p, 2.2e-16, 1 - 2.2e-16)).sum(), on.sum()]
        yield pd.DataFrame([(i, *v) for i, v in acc.items()], columns=["i", "loss", "n"])

    got = _rows(df, features, y, fold).mapInPandas(losses, "i int, loss double, n double").groupBy("i").agg(
        (F.sum("loss") / F.sum("n")).alias("loss")).toPandas().set_index("i")["loss"]
    tasks = list(fits)
    return pd.DataFrame([(tasks[i].without, tasks[i].c, got[i]) for i, _, _ in now], columns=["fold", "c", "loss"])


def cv_path(df: DataFrame, features: Sequence[str], n_classes: int, cs: Sequence[float] = tuple(CS), y: str = "y",
            fold: str = "cv_fold", n_folds: int = 5) -> tuple[pd.DataFrame, dict[Task, np.ndarray]]:
    """Mean held-out log loss per C, and the fits of all folds and of all rows."""
    tasks = [Task(f, float(c)) for c in cs for f in [*range(n_folds), NO_FOLD]]
    fits = newton_fits(df, features, tasks, n_classes, y, fold)
    losses = held_out_losses(df, features, fits, y, fold)
    mean = losses.groupby("c", as_index=False)["loss"].mean().sort_values("c")
    return mean, fits
