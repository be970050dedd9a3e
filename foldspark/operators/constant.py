"""The baseline every model must beat: mean of the target or log prior of the classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import ranks


def _statistics(task: str, n_classes: int | None) -> list[Column]:
    if task == "regression":
        return [F.sum("y").alias("s0")]
    return [F.count(F.when(F.col("y") == k, 1)).cast("double").alias(f"s{k}") for k in range(n_classes)]


def _prediction(task: str, n_classes: int | None) -> Column:
    share = [F.col(f"s{k}") / F.nullif("n", F.lit(0)) for k in range(n_classes or 1)]
    if task == "regression":
        return share[0]
    logs = [F.when(F.col("n") > 0, F.coalesce(F.log(s), F.lit(float("-inf")))) for s in share]
    return logs[1] - logs[0] if task == "binary" else F.array(*logs)


def fit_constant(train: DataFrame, task: str, n_classes: int | None = None):
    """The constant: a number, a log odds, or a list of log priors."""
    row = train.agg(F.count(F.lit(1)).alias("n"), *_statistics(task, n_classes))
    return row.select(_prediction(task, n_classes).alias("c")).first()["c"]


def predict_constant(df: DataFrame, constant) -> DataFrame:
    value = F.array(*[F.lit(v) for v in constant]) if isinstance(constant, list) else F.lit(constant)
    return df.withColumn("pred", value)


def cross_val_constant(df: DataFrame, task: str, n_classes: int | None = None, fold: str = "cv_fold") -> DataFrame:
    """Out-of-fold constants: one aggregate per fold, total minus own share, joined back as a tiny table."""
    stats = _statistics(task, n_classes)
    names = ["n", *[f"s{k}" for k in range(len(stats))]]
    per = df.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), *stats)
    every = W.partitionBy()
    rest = per.select(fold, *[(F.sum(c).over(every) - F.col(c)).alias(c) for c in names])
    table = ranks.fit_small(rest.select(fold, _prediction(task, n_classes).alias("pred")))
    return df.join(table, fold)
