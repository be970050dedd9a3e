"""Cross-validated linear models: penalty search, fixed-penalty out-of-fold predictions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gram as G
from . import logistic as L
from . import sparse as W
from .prep import TargetTransform, fit_target_transform
from .ranks import SMALL_ROWS

REG_TYPES = ("l2", "l1", "elasticnet", "omp")


def dot(features: Sequence[str], w: Sequence[float], b: float) -> Column:
    """Linear score as an array fold, so the plan stays small for any width."""
    xs = F.array(*[F.col(f).cast("double") for f in features])
    ws = F.array(*[F.lit(float(v)) for v in w])
    products = F.zip_with(xs, ws, lambda x, v: x * v)
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v) + F.lit(float(b))


def class_scores(features: Sequence[str], w: np.ndarray, n_classes: int) -> Column:
    """Log odds (binary) or log probabilities (multiclass) of weights x [features, intercept]."""
    if n_classes == 2:
        return dot(features, w[0, :-1], w[0, -1])
    z = F.array(*[dot(features, r[:-1], r[-1]) for r in w])
    top = F.array_max(z)
    lse = F.log(F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))) + top
    return F.transform(z, lambda v: v - lse)


@dataclass
class LinearCV:
    """Linear or logistic regression whose penalty is chosen by cross-validation.

    ``fit`` expects numeric feature columns, ``y`` (number or class code) and a
    fold column for the penalty search (not needed for ridge, which uses
    leave-one-out). ``hot`` may name a column of positions that are one.

    The solver follows the width: one Gram pass, or Newton steps for classes, as
    long as their matrices stay small; beyond that, with ``hot``, with an l1 part
    for classes and for one-vs-rest, all fits of the search go through lock-step
    L-BFGS. There ridge is searched by the folds instead of leave-one-out.
    """

    task: str
    reg_type: str = "l2"
    reg_coefs: Sequence[float] | str = "auto"
    y_transform: str = "standard"
    n_classes: int | None = None
    n_folds: int = 5
    l1_ratio: Sequence[float] | float = 0.5
    fold: str = "cv_fold"
    multiclass: str = "auto"                   # multinomial, or ovr: one class against the rest
    hot: str | None = None
    hot_width: int = 0
    features: list[str] = field(default_factory=list)
    coef: float | None = None
    best_l1_ratio: float | None = None
    weights: np.ndarray | None = None
    path: pd.DataFrame | None = None
    transform: TargetTransform | None = None

    def __post_init__(self):
        if self.reg_type not in REG_TYPES:
            raise ValueError(f"unknown penalty {self.reg_type}")
        if self.reg_type == "omp" and self.task != "regression":
            raise ValueError("omp is not supported for classification")

    def _ratios(self) -> list[float]:
        return list(self.l1_ratio) if isinstance(self.l1_ratio, (list, tuple)) else [self.l1_ratio]

    @property
    def outputs(self) -> int:
        return self.n_classes if self.task == "multiclass" else 1

    @property
    def loss(self) -> str:
        if self.task == "regression":
            return "squared"
        return "ovr" if self.multiclass == "ovr" and self.task == "multiclass" else "log"

    @property
    def is_wide(self) -> bool:
        """Does the lock-step solver take the fit?"""
        if self.hot or self.loss == "ovr":
            return True
        if self.task == "regression":
            return len(self.features) > G.MAX_WIDTH and self.reg_type != "omp"
        return self.reg_type != "l2" or self.outputs * (len(self.features) + 1) > L.MAX_NEWTON

    def _set(self, features: Sequence[str], hot: str | None, hot_width: int) -> None:
        self.features, self.hot, self.hot_width = list(features), hot, hot_width
        if hot and self.reg_type == "omp":
            raise ValueError("omp needs dense features")

    def _packed(self, df: DataFrame) -> W.Rows:
        """Rows for the lock-step solver; regression targets are transformed."""
        if self.task == "regression":
            df = df.withColumn("_z", self.transform.forward(F.col("y")))
        fold = self.fold if self.fold in df.columns else None
        return W.Rows(df, self.features, "_z" if self.task == "regression" else "y", self.hot, self.hot_width, fold)

    def _penalty(self, coef: float, l1_ratio: float | None, without: int, sizes: dict[int, int]) -> W.Fit:
        """The mean-loss form of a penalty: alpha of ridge and C of classes go with the number of rows."""
        n = sum(v for f, v in sizes.items() if f != without)
        if self.task == "regression" and self.reg_type == "l2":
            return W.Fit(without, 0.0, coef / n)
        if self.task != "regression":
            coef = 0.0 if np.isinf(coef) else 1.0 / (coef * n)
        ratio = {"l1": 1.0, "l2": 0.0}.get(self.reg_type, 0.5 if l1_ratio is None else l1_ratio)
        return W.Fit(without, coef * ratio, coef * (1 - ratio))

    def _sizes(self, df: DataFrame) -> dict[int, int]:
        fold = F.col(self.fold).cast("int") if self.fold in df.columns else F.lit(0)
        return {r["f"]: r["n"] for r in df.filter("y IS NOT NULL").groupBy(fold.alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()}

    def _fit_wide(self, df: DataFrame) -> None:
        if self.task == "regression":
            self.transform = fit_target_transform(df, self.y_transform)
        default = G.ALPHAS if self.task == "regression" else L.CS
        coefs = tuple(default) if isinstance(self.reg_coefs, str) else tuple(self.reg_coefs)
        ratios = {"l1": [1.0], "l2": [None]}.get(self.reg_type) or self._ratios()
        sizes, rows = self._sizes(df), []
        with self._packed(df) as packed:
            grid = {(r, float(c), f): self._penalty(c, r, f, sizes) for r in ratios for c in coefs for f in range(self.n_folds)}
            losses = W.held_out(packed, W.solve(packed, list(grid.values()), self.loss, self.outputs), self.loss)
            for r in ratios:
                rows += [(r, float(c), float(np.nanmean([losses[grid[r, float(c), f]] for f in range(self.n_folds)]))) for c in coefs]
            value = "mse" if self.task == "regression" else "loss"
            self.path = pd.DataFrame(rows, columns=["l1_ratio", "alpha" if self.task == "regression" else "c", value])
            best = self.path.loc[self.path[value].idxmin()]
            self.coef, self.best_l1_ratio = float(best.iloc[1]), None if self.reg_type == "l2" else float(best["l1_ratio"])
            last = self._penalty(self.coef, self.best_l1_ratio, W.NO_FOLD, sizes)
            self.weights = W.solve(packed, [last], self.loss, self.outputs)[last].weights

    def fit(self, df: DataFrame, features: Sequence[str], hot: str | None = None, hot_width: int = 0) -> LinearCV:
        self._set(features, hot, hot_width)
        if self.is_wide:
            self._fit_wide(df)
        elif self.task == "regression":
            self._fit_regression(df)
        else:
            self._fit_classes(df)
        return self

    def _fit_regression(self, df: DataFrame) -> None:
        self.transform = fit_target_transform(df, self.y_transform)
        z = df.withColumn("_z", self.transform.forward(F.col("y")))
        alphas = tuple(G.ALPHAS) if isinstance(self.reg_coefs, str) else tuple(self.reg_coefs)
        if self.reg_type == "l2":
            grams = G.fold_grams(z, self.features, "_z")
            self.path = G.ridge_loo_path(z, grams, alphas, "_z")
            self.coef = float(self.path.loc[self.path["mse"].idxmin(), "alpha"])
        else:
            grams = G.fold_grams(z, self.features, "_z", self.fold)
            if self.reg_type == "omp":
                self.path = G.forward_cv_path(grams)
                self.coef = int(self.path.loc[self.path["mse"].idxmin(), "n_features"]) if len(self.path) else 0
            else:
                ratios = [1.0] if self.reg_type == "l1" else self._ratios()
                self.path = G.elastic_cv_path(grams, alphas, ratios)
                best = self.path.loc[self.path["mse"].idxmin()]
                self.coef, self.best_l1_ratio = float(best["alpha"]), float(best["l1_ratio"])
        self.weights = self._solve(grams.total, self.coef, self.best_l1_ratio)

    def _solve(self, g: np.ndarray, coef: float, l1_ratio: float | None) -> np.ndarray:
        if self.reg_type == "l2":
            w, b = G.ridge(g, coef)
        elif self.reg_type == "omp":
            path = G.forward_path(g, int(coef))
            w, b = path[-1] if path else (np.zeros(len(self.features)), G.centred(g)[2])
        else:
            w, b = G.elastic_net(g, coef, 1.0 if l1_ratio is None else l1_ratio)
        return np.append(w, b)[None, :]

    def _fit_classes(self, df: DataFrame) -> None:
        cs = tuple(L.CS) if isinstance(self.reg_coefs, str) else tuple(self.reg_coefs)
        self.path, fits = L.cv_path(df, self.features, self.n_classes, cs, "y", self.fold, self.n_folds)
        self.coef = float(self.path.loc[self.path["loss"].idxmin(), "c"])
        self.weights = fits[L.Task(L.NO_FOLD, self.coef)]

    def fit_fixed(self, df: DataFrame, features: Sequence[str], coef: float, l1_ratio: float | None = None,
                  hot: str | None = None, hot_width: int = 0) -> LinearCV:
        """Fit with a given penalty and no search; C = inf means no penalty for classes."""
        self._set(features, hot, hot_width)
        self.coef, self.best_l1_ratio = coef, l1_ratio
        if self.task == "regression":
            self.transform = fit_target_transform(df, self.y_transform)
        if self.is_wide:
            one = self._penalty(coef, l1_ratio, W.NO_FOLD, self._sizes(df))
            with self._packed(df) as packed:
                self.weights = W.solve(packed, [one], self.loss, self.outputs)[one].weights
        elif self.task == "regression":
            z = df.withColumn("_z", self.transform.forward(F.col("y")))
            self.weights = self._solve(G.fold_grams(z, self.features, "_z").total, coef, l1_ratio)
        else:
            task = L.Task(L.NO_FOLD, float(coef))
            self.weights = L.newton_fits(df, self.features, [task], self.n_classes)[task]
        return self

    def score_column(self, weights: np.ndarray | None = None) -> Column:
        """Prediction: value, log odds, or log probabilities."""
        w = self.weights if weights is None else weights
        if self.task == "regression":
            return self.transform.inverse(dot(self.features, w[0, :-1], w[0, -1]))
        return class_scores(self.features, w, self.n_classes)

    def _from_scores(self, z: Column) -> Column:
        """Prediction from an array of scores, one for each output."""
        if self.task == "regression":
            return self.transform.inverse(F.get(z, F.lit(0)))
        if self.outputs == 1:
            return F.get(z, F.lit(0))
        if self.loss == "ovr":                              # the classes' chances, scaled to one
            z = F.transform(z, lambda v: -F.greatest(-v, F.lit(0.0)) - F.log1p(F.exp(-F.abs(v))))
        top = F.array_max(z)
        total = F.log(F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))) + top
        return F.transform(z, lambda v: v - total)

    def predict(self, df: DataFrame) -> DataFrame:
        if self.is_wide:
            return W.with_scores(df, self.weights, self.features, self.hot).withColumn("pred", self._from_scores(F.col("_z"))).drop("_z")
        return df.withColumn("pred", self.score_column())

    def _cross_val_wide(self, df: DataFrame, coef: float, l1_ratio: float | None) -> DataFrame:
        sizes = self._sizes(df)
        fits = {f: self._penalty(coef, l1_ratio, f, sizes) for f in range(self.n_folds)}
        with self._packed(df) as packed:
            solved = W.solve(packed, list(fits.values()), self.loss, self.outputs)
        weights = np.concatenate([solved[one].weights for one in fits.values()])
        scored = W.with_scores(df, weights, self.features, self.hot)
        own = F.slice("_z", F.col(self.fold).cast("int") * self.outputs + 1, F.lit(self.outputs))
        return scored.withColumn("pred", self._from_scores(own)).drop("_z")

    def cross_val_predict(self, df: DataFrame, coef: float | None = None, l1_ratio: float | None = None) -> DataFrame:
        """Out-of-fold predictions with a fixed penalty (the best one by default).

        All folds are fitted from one pass; each row picks the weights of its
        own fold.
        """
        coef = self.coef if coef is None else coef
        l1_ratio = self.best_l1_ratio if l1_ratio is None else l1_ratio
        if self.is_wide:
            return self._cross_val_wide(df, coef, l1_ratio)
        folds = range(self.n_folds)
        if self.task == "regression":
            z = df.withColumn("_z", self.transform.forward(F.col("y")))
            grams = G.fold_grams(z, self.features, "_z", self.fold)
            per = {f: self._solve(grams.without(f), coef, l1_ratio) for f in grams.per_fold}
        else:
            tasks = [L.Task(f, float(coef)) for f in folds]
            per = {t.without: w for t, w in L.newton_fits(df, self.features, tasks, self.n_classes, "y", self.fold).items()}
        value = F.coalesce(*[F.when(F.col(self.fold) == f, self.score_column(w)) for f, w in per.items()])
        return df.withColumn("pred", value)

    def coefficients(self) -> pd.DataFrame:
        names = [*self.features, *(f"{self.hot}:{i}" for i in range(self.hot_width)), "intercept"]
        return pd.DataFrame([(k, n, float(v)) for k, r in enumerate(self.weights) for n, v in zip(names, r)],
                            columns=["output", "feature", "value"])


def small_frame(df: DataFrame, table: pd.DataFrame, schema: str) -> DataFrame:
    if len(table) > SMALL_ROWS:
        raise ValueError("not a small table")
    return df.sparkSession.createDataFrame(table, schema)
