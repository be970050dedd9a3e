"""Linear models from Gram matrices.

One pass over the rows builds a (d+2) x (d+2) cross-product matrix per fold;
sums, complements and held-out errors of every penalty then come from those
small matrices. Rows never leave the executors. Features should be on a
common scale; columns of zeros are harmless.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import _c
from .ranks import spread

MAX_WIDTH = 2_000
# Default penalty grid of the cross-validated linear models.
ALPHAS = 2.0 ** np.arange(-14, 15)


class Grams:
    """Cross products of [features, 1, y] per fold."""

    def __init__(self, features: Sequence[str], per_fold: dict[int, np.ndarray]):
        self.features, self.per_fold = list(features), per_fold
        self.total = sum(per_fold.values())

    def without(self, fold: int) -> np.ndarray:
        return self.total - self.per_fold[fold]


def fold_grams(df: DataFrame, features: Sequence[str], y: str = "y", fold: str | None = None) -> Grams:
    """Accumulate X'X, X'y, y'y per fold inside tasks, then add the task results by matrix row."""
    d = len(features)
    if d > MAX_WIDTH:
        raise ValueError(f"{d} features exceed the Gram limit of {MAX_WIDTH}; use the iterative solver")
    folds = F.col(fold).cast("int") if fold else F.lit(0)
    rows = df.select(folds.alias("_f"), *[_c(c).cast("double") for c in features], F.col(y).cast("double").alias("_y"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            f = b["_f"].to_numpy()
            m = np.column_stack([b.drop(columns=["_f", "_y"]).to_numpy(dtype=float), np.ones(len(b)), b["_y"]])
            for k in np.unique(f):
                part = m[f == k]
                acc[int(k)] = acc.get(int(k), 0.0) + part.T @ part
        for k, g in acc.items():
            yield pd.DataFrame({"f": k, "i": np.arange(len(g)), "v": list(g)})

    parts = rows.mapInPandas(partial, "f int, i int, v array<double>")
    cells = parts.select("f", "i", F.posexplode("v").alias("j", "v"))
    summed = cells.groupBy("f", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for k, g in summed.groupby("f"):
        m = np.zeros((d + 2, d + 2))
        m[g["i"], g["j"]] = g["v"]
        out[int(k)] = m
    return Grams(features, out)


def centred(g: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray, np.ndarray, float]:
    """n, mean x, mean y, centred X'X, X'y, y'y of a raw Gram matrix."""
    d = len(g) - 2
    n = g[d, d]
    mx, my = g[:d, d] / n, g[d, d + 1] / n
    return n, mx, my, g[:d, :d] - n * np.outer(mx, mx), g[:d, d + 1] - n * mx * my, g[d + 1, d + 1] - n * my * my


def held_out_mse(g: np.ndarray, w: np.ndarray, b: float) -> float:
    """Mean squared error on the rows of a Gram matrix, without reading them."""
    v = np.concatenate([w, [b, -1.0]])
    return float(v @ g @ v / g[-2, -2])


def _intercept(mx: np.ndarray, my: float, w: np.ndarray) -> float:
    return float(my - mx @ w)


def ridge(g: np.ndarray, alpha: float = 0.0) -> tuple[np.ndarray, float]:
    """min |y - Xw|^2 + alpha |w|^2; alpha 0 is least squares of minimum norm."""
    _, mx, my, sxx, sxy, _ = centred(g)
    values, vectors = np.linalg.eigh(sxx)
    keep = values > max(values.max(), 0.0) * 1e-12
    denom = np.where(keep, values, 0.0) + alpha
    w = vectors @ np.where(denom > 0, (vectors.T @ sxy) / np.where(denom > 0, denom, 1.0), 0.0)
    return w, _intercept(mx, my, w)


def elastic_net(g: np.ndarray, alpha: float, l1_ratio: float = 1.0, start: np.ndarray | None = None,
                max_iter: int = 100_000, tol: float = 1e-9) -> tuple[np.ndarray, float]:
    """min |y - Xw|^2 / 2n + alpha (l1_ratio |w|_1 + (1 - l1_ratio) |w|^2 / 2) by coordinate descent."""
    n, mx, my, sxx, sxy, _ = centred(g)
    q, c = sxx / n, sxy / n
    w = np.zeros(len(c)) if start is None else start.copy()
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    r = c - q @ w
    for _ in range(max_iter):
        moved = 0.0
        for j in range(len(w)):
            if q[j, j] <= 1e-14:
                continue
            rho = r[j] + q[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (q[j, j] + l2)
            if new != w[j]:
                r -= q[:, j] * (new - w[j])
                moved = max(moved, abs(new - w[j]) * np.sqrt(q[j, j]))
                w[j] = new
        if moved < tol:
            break
    return w, _intercept(mx, my, w)


def forward_path(g: np.ndarray, max_features: int | None = None) -> list[tuple[np.ndarray, float]]:
    """Orthogonal matching pursuit: refitted models with 1, 2, ... features."""
    _, mx, my, sxx, sxy, syy = centred(g)
    active: list[int] = []
    out = []
    w = np.zeros(len(sxy))
    for _ in range(min(max_features or len(sxy), len(sxy))):
        corr = np.abs(sxy - sxx @ w)
        corr[active] = -1.0
        corr[np.diag(sxx) <= 1e-12 * max(np.diag(sxx).max(), 1e-300)] = -1.0
        j = int(np.argmax(corr))
        if corr[j] <= 1e-12 * max(syy, 1e-300):
            break
        active.append(j)
        w = np.zeros(len(sxy))
        w[active] = np.linalg.lstsq(sxx[np.ix_(active, active)], sxy[active], rcond=None)[0]
        out.append((w, _intercept(mx, my, w)))
    return out


def fit_penalised(g: np.ndarray, l1: float = 0.0, l2: float = 0.0) -> tuple[np.ndarray, float]:
    """One fit by two penalties: ridge adds ``l2``; lasso and elastic net mix l1 + l2."""
    if l1 == 0:
        return ridge(g, l2)
    return elastic_net(g, l1 + l2, l1 / (l1 + l2))


# --------------------------------------------------------------------------
# cross-validated paths


def ridge_loo_path(df: DataFrame, grams: Grams, alphas: Sequence[float] = tuple(ALPHAS), y: str = "y") -> pd.DataFrame:
    """Leave-one-out mean squared error per penalty: one more pass, leverages from the eigenbasis."""
    n, mx, my, sxx, sxy, _ = centred(grams.total)
    values, vectors = np.linalg.eigh(sxx)
    values = np.maximum(values, 0.0)
    alphas = np.asarray(alphas, dtype=float)
    shrink = 1.0 / (values[:, None] + alphas[None, :])              # d x alphas
    weights = vectors @ (shrink * (vectors.T @ sxy)[:, None])        # d x alphas
    rows = df.select(*[_c(c).cast("double") for c in grams.features], F.col(y).cast("double").alias("_y"))

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sse, count = np.zeros(len(alphas)), 0
        for b in batches:
            x = b.drop(columns=["_y"]).to_numpy(dtype=float) - mx
            z = x @ vectors
            lever = 1.0 / n + (z * z) @ shrink
            e = (b["_y"].to_numpy()[:, None] - my - x @ weights) / np.maximum(1.0 - lever, 1e-12)
            sse += (e * e).sum(axis=0)
            count += len(b)
        yield pd.DataFrame({"i": np.arange(len(alphas)), "sse": sse, "n": count})

    got = rows.mapInPandas(errors, "i int, sse double, n long").groupBy("i").agg(
        F.sum("sse").alias("sse"), F.sum("n").alias("n")).toPandas().sort_values("i")
    return pd.DataFrame({"alpha": alphas, "mse": (got["sse"] / got["n"]).to_numpy()})


def elastic_cv_path(grams: Grams, alphas: Sequence[float] = tuple(ALPHAS), l1_ratios: Sequence[float] = (1.0,)) -> pd.DataFrame:
    """Held-out error per (l1_ratio, alpha) averaged over folds; no further pass over the rows."""
    rows = []
    for ratio in l1_ratios:
        errors = {a: [] for a in alphas}
        for f, own in grams.per_fold.items():
            start = None
            for a in sorted(alphas, reverse=True):
                w, b = elastic_net(grams.without(f), a, ratio, start)
                start = w
                errors[a].append(held_out_mse(own, w, b))
        rows += [(ratio, a, float(np.mean(e))) for a, e in errors.items()]
    return pd.DataFrame(rows, columns=["l1_ratio", "alpha", "mse"])


def forward_cv_path(grams: Grams) -> pd.DataFrame:
    """Held-out error per number of selected features."""
    paths = {f: forward_path(grams.without(f)) for f in grams.per_fold}
    longest = min(len(p) for p in paths.values())
    rows = [(k + 1, float(np.mean([held_out_mse(grams.per_fold[f], *paths[f][k]) for f in paths]))) for k in range(longest)]
    return pd.DataFrame(rows, columns=["n_features", "mse"])
