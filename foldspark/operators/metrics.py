"""Metrics as grouped aggregates over (run, subset, seed, ...).

Input rows carry a truth column (number, or class code) and a prediction column
(number, binary logit, or array of class logits). Undefined scores are NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import EPS, argmax, clip, sigmoid, symlog
from ..session import cut
from . import ranks, weighted
from .resample import FULL, resample

# Is a higher value of the metric better?
HIGHER_IS_BETTER = {
    "r2": True, "r2_symlog": True, "d2_absolute_error": True, "quantile_mse_d2": True,
    "roc_auc": True, "balanced_accuracy": True, "log_loss": False, "neg_log_loss": True,
    "median_absolute_error": False, "neg_median_absolute_error": True,
    "boosting_RMSE": False, "boosting_Logloss": False, "boosting_MultiClass": False, "boosting_AUC": True,
}
# Metrics of default scoring and of model selection per task.
EVAL_METRICS = {
    "regression": ["r2", "d2_absolute_error"],
    "binary": ["neg_log_loss", "roc_auc"],
    "multiclass": ["neg_log_loss", "balanced_accuracy"],
}
SELECTION_METRIC = {"regression": "r2", "binary": "neg_log_loss", "multiclass": "neg_log_loss"}
TASK_METRICS = {
    "regression": ["r2", "r2_symlog", "d2_absolute_error", "median_absolute_error",
                   "neg_median_absolute_error", "quantile_mse_d2"],
    "binary": ["roc_auc", "balanced_accuracy", "log_loss", "neg_log_loss"],
    "multiclass": ["balanced_accuracy", "log_loss", "neg_log_loss"],
}
LOGIT_LIMIT = 1e10


def _finite(*cols: Column) -> Column:
    """Aggregate test: no infinite value in any of the columns."""
    top = reduce(lambda a, b: a & b, [F.max(F.abs(c)) < F.lit(float("inf")) for c in cols])
    return top


def _ratio_score(err: Column, spread: Column, defined: Column) -> Column:
    """1 - err/spread, with the convention for a spread of zero: 1 if exact, else 0."""
    value = F.when(spread > 0, 1 - err / spread).when(err == 0, 1.0).otherwise(0.0)
    return F.when(defined, value)


def _r2(y: Column, p: Column) -> Column:
    n = F.count(y)
    return _ratio_score(F.sum((y - p) * (y - p)), F.var_pop(y) * n, _finite(y, p) & (n >= 2))


def r2(df: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    return df.groupBy(*by).agg(_r2(F.col(y), F.col(pred)).alias("score"))


def r2_symlog(df: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    logs = df.select(*by, symlog(y).alias("y"), symlog(pred).alias("pred"))
    return r2(logs, by)


def d2_absolute_error(df: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """1 - mean absolute error over that of the group's median."""
    rows = df.select(*by, F.col(y).cast("double").alias("y"), F.col(pred).cast("double").alias("pred"))
    med = ranks.exact_quantiles(rows, by, "y", [0.5], name="_q")
    if by:
        rows = ranks.join_same(rows, ranks.fit_small(med), list(by), "left")
        centre = F.get(F.col("_q"), F.lit(0))
    else:
        found = med.first()
        centre = F.lit(found["_q"][0] if found and found["_q"] else None).cast("double")
    n = F.count("y")
    score = _ratio_score(F.sum(F.abs(F.col("y") - F.col("pred"))), F.sum(F.abs(F.col("y") - centre)),
                         _finite(F.col("y"), F.col("pred")) & (n >= 2))
    return rows.groupBy(*by).agg(score.alias("score"))


def median_absolute_error(df: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    err = df.select(*by, F.abs(F.col(y) - F.col(pred)).cast("double").alias("e"))
    score = ranks.exact_quantiles(err, by, "e", [0.5]).select(*by, F.get("q", F.lit(0)).alias("score"))
    return ranks.join_same(err.select(*by).distinct(), score, list(by), "left") if by else score


def roc_auc(df: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Share of (positive, negative) pairs in order, ties counted half.

    Rows collapse to distinct scores before any ordering, so ties and hot
    scores cost one row each.
    """
    by = list(by)
    is_pos = (F.col(y) == 1).cast("long")
    levels = df.groupBy(*by, clip(pred, -LOGIT_LIMIT, LOGIT_LIMIT).alias("_s")).agg(
        F.sum(is_pos).alias("pos"), F.sum(1 - is_pos).alias("neg"))
    cum = ranks.running_sums(levels, by, "_s", ["neg"])
    won = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return cum.groupBy(*by).agg(F.when(pairs > 0, won / pairs).alias("score"))


def balanced_accuracy(df: DataFrame, by: Sequence[str], n_classes: int, y: str = "y", pred: str = "pred") -> DataFrame:
    """Mean recall over classes; NULL unless every declared class occurs."""
    kind = df.schema[pred].dataType.typeName()
    guess = argmax(pred) if kind == "array" else (F.col(pred) > 0).cast("int")
    recall = df.groupBy(*by, F.col(y).alias("_y")).agg(F.avg((guess == F.col(y)).cast("double")).alias("_r"))
    return recall.groupBy(*by).agg(F.when(F.count("_r") == n_classes, F.avg("_r")).alias("score"))


def _true_probability(y: str, pred: str, kind: str) -> Column:
    if kind != "array":
        return sigmoid(F.when(F.col(y) == 1, F.col(pred)).otherwise(-F.col(pred)))
    top = F.array_max(pred)
    total = F.aggregate(F.col(pred), F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
    return F.exp(F.get(F.col(pred), F.col(y)) - top) / total


def log_loss(df: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """Mean negative log probability of the true class, probabilities clipped by machine epsilon."""
    p = _true_probability(y, pred, df.schema[pred].dataType.typeName())
    return df.groupBy(*by).agg(F.avg(-F.log(clip(p, EPS, 1 - EPS))).alias("score"))


def quantile_mse_d2(df: DataFrame, by: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """r2 between the truth-quantiles of the truth and of the prediction.

    A value's quantile is the mean of the shares of truth below it and up to it.
    """
    by = list(by)
    rows = df.select(*by, F.col(y).cast("double").alias("_t"), F.col(pred).cast("double").alias("_p"))
    values = rows.select(*by, F.col("_t").alias("_v"), F.lit(1).cast("long").alias("_c")).unionByName(
        rows.select(*by, F.col("_p").alias("_v"), F.lit(0).cast("long").alias("_c")))
    levels = values.groupBy(*by, "_v").agg(F.sum("_c").alias("_c"))
    cum = ranks.running_sums(levels, by, "_v", ["_c"])
    # twice the quantile times n, a whole number; the factor cancels in r2
    quant = cum.select(*by, "_v", (2 * F.col("cum__c") - F.col("_c")).cast("double").alias("_k"))
    pairs = rows.groupBy(*by, "_t", "_p").agg(F.count(F.lit(1)).alias("_m"))
    pairs = ranks.join_same(pairs, quant.withColumnsRenamed({"_v": "_t", "_k": "_kt"}), by, strict=["_t"])
    pairs = ranks.join_same(pairs, quant.withColumnsRenamed({"_v": "_p", "_k": "_kp"}), by, strict=["_p"])
    n, m = F.sum("_m"), F.col("_m")
    # the mean of the quantiles of n truths is exactly n (as a count) by symmetry
    t, p = F.col("_kt"), F.col("_kp")
    sse = F.sum(m * (t - p) * (t - p))
    agg = pairs.groupBy(*by).agg(n.alias("n"), sse.alias("sse"), F.sum(m * t).alias("st"), F.sum(m * t * t).alias("stt"))
    spread = F.col("stt") - F.col("st") * F.col("st") / F.col("n")
    return agg.select(*by, _ratio_score(F.col("sse"), spread, F.col("n") >= 2).alias("score"))


def metric(df: DataFrame, by: Sequence[str], name: str, n_classes: int | None = None,
           y: str = "y", pred: str = "pred") -> DataFrame:
    """Score table (by..., score) of one metric."""
    if name.startswith("neg_"):
        plain = metric(df, by, name[4:], n_classes, y, pred)
        return plain.withColumn("score", -F.col("score"))
    if name == "balanced_accuracy":
        return balanced_accuracy(df, by, n_classes, y, pred)
    plain_metrics = {"r2": r2, "r2_symlog": r2_symlog, "d2_absolute_error": d2_absolute_error,
                     "median_absolute_error": median_absolute_error, "roc_auc": roc_auc,
                     "log_loss": log_loss, "quantile_mse_d2": quantile_mse_d2}
    if name not in plain_metrics:
        raise ValueError(f"unknown metric {name}")
    return plain_metrics[name](df, by, y, pred)


def _fused(df: DataFrame, by: list[str], names: list[str], y: str, pred: str) -> DataFrame:
    """Metrics that one aggregate can answer together, in long form."""
    rows = df
    if "d2_absolute_error" in names:
        med = ranks.exact_quantiles(df.select(*by, F.col(y).cast("double").alias("_y")), by, "_y", [0.5], name="_q")
        rows = ranks.join_same(df, ranks.fit_small(med), by, "left")
    t, p = F.col(y), F.col(pred)
    defined = _finite(t, p) & (F.count(t) >= 2)
    centre = F.get(F.col("_q"), F.lit(0))
    exprs = {
        "r2": lambda: _r2(t, p),
        "r2_symlog": lambda: _r2(symlog(t), symlog(p)),
        "d2_absolute_error": lambda: _ratio_score(F.sum(F.abs(t - p)), F.sum(F.abs(t - centre)), defined),
        "log_loss": lambda: F.avg(-F.log(clip(_true_probability(y, pred, df.schema[pred].dataType.typeName()),
                                              EPS, 1 - EPS))),
        "neg_log_loss": lambda: F.avg(F.log(clip(_true_probability(y, pred, df.schema[pred].dataType.typeName()),
                                                 EPS, 1 - EPS))),
    }
    wide = rows.groupBy(*by).agg(*[exprs[n]().alias(n) for n in names])
    return wide.unpivot(by, names, "metric", "score")


FUSED = {"r2", "r2_symlog", "d2_absolute_error", "log_loss", "neg_log_loss"}


def score_groups(df: DataFrame, by: Sequence[str], names: Sequence[str], n_classes: int | None = None,
                 y: str = "y", pred: str = "pred") -> DataFrame:
    """Long score table (by..., metric, score)."""
    by, names = list(by), list(dict.fromkeys(names))
    together = [n for n in names if n in FUSED]
    parts = [_fused(df, by, together, y, pred)] if together else []
    for n in names:
        if n not in FUSED:
            parts.append(metric(df, by, n, n_classes, y, pred).select(*by, F.lit(n).alias("metric"), "score"))
    return reduce(DataFrame.unionByName, parts)


def _weighted(rows: DataFrame, by: Sequence[str], names: Sequence[str], n_classes: int | None,
              seeds: Sequence[int | None]) -> DataFrame | None:
    """Scores of a Poisson bootstrap (by..., bootstrap_seed, metric, score) from weights; None for too many groups."""
    log_p = hit = score = None
    kind = rows.schema["pred"].dataType.typeName()
    if {"log_loss", "neg_log_loss"} & set(names):
        log_p = F.log(clip(_true_probability("y", "pred", kind), EPS, 1 - EPS))
    if "balanced_accuracy" in names:
        hit = (argmax("pred") if kind == "array" else (F.col("pred") > 0).cast("int")) == F.col("y")
    if "roc_auc" in names:
        score = clip("pred", -LOGIT_LIMIT, LOGIT_LIMIT)
    return weighted.scores(rows, by, names, seeds, n_classes, log_p, hit, score)


def score_all(df: DataFrame, names: Sequence[str], subsets: Sequence[str] | None = None,
              seeds: Sequence[int | None] | None = None, n_classes: int | None = None,
              y: str = "y", pred: str = "pred", extra: Sequence[str] = (), method: str = "exact") -> DataFrame:
    """Score table (extra..., subset, metric, bootstrap_seed, score) over subsets x metrics x seeds."""
    rows = df if subsets is None else df.filter(F.col("subset").isin(*subsets))
    rows = rows.select("row_id", *extra, "subset", y, pred)
    seeds, scores = list(seeds) if seeds else [None], None
    if method == "poisson" and len(seeds) > 1 and set(names) <= weighted.METRICS:
        # several passes sum the rows
        rows = cut(rows.withColumnsRenamed({y: "y", pred: "pred"}))
        y, pred = "y", "pred"
        scores = _weighted(rows, [*extra, "subset"], names, n_classes, seeds)
    if scores is None:
        drawn = resample(rows, [*extra, "subset"], seeds, method)
        scores = score_groups(drawn, [*extra, "subset", "bootstrap_seed"], names, n_classes, y, pred)
    seed = F.when(F.col("bootstrap_seed") != FULL, F.col("bootstrap_seed"))
    return scores.select(*extra, "subset", "metric", seed.alias("bootstrap_seed"), "score")


def default_scoring(df: DataFrame, task: str, subsets: Sequence[str] = ("val", "test"), n_classes: int | None = None,
                    y: str = "y", pred: str = "pred", extra: Sequence[str] = (), n_bootstraps: int = 50,
                    method: str = "exact") -> DataFrame:
    """The task's metrics on the full sample and on 50 bootstraps; absent subsets drop out."""
    return score_all(df, EVAL_METRICS[task], subsets, [None, *range(n_bootstraps)], n_classes, y, pred, extra, method)


def direction(names: Sequence[str]) -> Column:
    """+1 or -1 by metric name column value."""
    return F.coalesce(*[F.when(F.col("metric") == n, 1.0 if HIGHER_IS_BETTER[n] else -1.0) for n in names])
