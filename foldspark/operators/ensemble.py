"""Averages and stages of several predictions of the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def average(members: DataFrame, n_classes: int | None = None, pred: str = "pred") -> DataFrame:
    """Mean prediction per row over members; ``t`` is summed, NULL when any member has none.

    ``n_members`` shows rows that some member did not predict.
    """
    if n_classes:
        mean = F.array(*[F.avg(F.get(pred, F.lit(i))) for i in range(n_classes)])
    else:
        mean = F.avg(pred)
    t = F.when(F.count("t") == F.count(F.lit(1)), F.sum("t"))
    return members.groupBy("row_id").agg(mean.alias(pred), t.alias("t"), F.count(F.lit(1)).alias("n_members"))


def cumulative_average(members: DataFrame, pred: str = "pred", pos: str = "pos", n_classes: int | None = None) -> DataFrame:
    """Running mean over members in order; ``t`` runs until the first member without one."""
    w = W.partitionBy("row_id").orderBy(pos).rowsBetween(W.unboundedPreceding, W.currentRow)
    if n_classes:
        mean = F.array(*[F.avg(F.get(pred, F.lit(i))).over(w) for i in range(n_classes)])
    else:
        mean = F.avg(pred).over(w)
    t = F.when(F.count("t").over(w) == F.count(F.lit(1)).over(w), F.sum("t").over(w))
    return members.select("row_id", pos, mean.alias(pred), t.alias("t"))


def prefix_sum(increments: DataFrame, start: int = 0, end: int = 0, extra: Sequence[str] = ()) -> DataFrame:
    """Prediction from rounds [start, end); end 0 means all rounds."""
    kept = increments.filter(F.col("round") >= start)
    if end:
        kept = kept.filter(F.col("round") < end)
    return kept.groupBy("row_id", *extra).agg(F.sum("increment").alias("pred"))


def staged(increments: DataFrame, eval_period: int = 1) -> DataFrame:
    """Prediction after every ``eval_period``-th round, and after the last one."""
    w = W.partitionBy("row_id").orderBy("round").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.max("round").over(W.partitionBy("row_id"))
    out = increments.select("row_id", "round", F.sum("increment").over(w).alias("pred"), last.alias("_last"))
    due: Column = (F.col("round") + 1) % eval_period == 0
    return out.filter(due | (F.col("round") == F.col("_last"))).drop("_last")
