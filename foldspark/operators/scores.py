"""Score tables (subset, metric, bootstrap_seed, score): comparison, bootstrap statistics, selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.scalar import shorten
from . import ranks

KEYS = ["subset", "metric", "bootstrap_seed"]


def get(scores: DataFrame, subset: str, metric: str, seed: int | None = None) -> DataFrame:
    return scores.filter((F.col("subset") == subset) & (F.col("metric") == metric)
                         & F.col("bootstrap_seed").eqNullSafe(F.lit(seed).cast("int")))


def get_value(scores: DataFrame, subset: str, metric: str, seed: int | None = None) -> float:
    """The one score with these keys; an error when there is none or more than one."""
    found = get(scores, subset, metric, seed).take(2)
    if len(found) != 1:
        raise KeyError(f"{len(found)} scores for ({subset}, {metric}, {seed})")
    return found[0]["score"]


def by_metric(scores: DataFrame, subset: str, extra: Sequence[str] = ()) -> DataFrame:
    """Full-sample scores of a subset as a map metric -> score."""
    full = scores.filter((F.col("subset") == subset) & F.col("bootstrap_seed").isNull())
    entries = F.array_sort(F.collect_list(F.struct("metric", "score")))
    return full.groupBy(*extra).agg(F.map_from_entries(entries).alias("scores"))


def bootstraps(scores: DataFrame, subset: str, metric: str) -> DataFrame:
    return scores.filter((F.col("subset") == subset) & (F.col("metric") == metric)
                         & F.col("bootstrap_seed").isNotNull())


def bootstrap_quantiles(scores: DataFrame, subset: str, metric: str, probs: Sequence[float] = (0.1, 0.9),
                        by: Sequence[str] = ()) -> DataFrame:
    return ranks.exact_quantiles(bootstraps(scores, subset, metric), by, "score", probs)


def deltas(left: DataFrame, right: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Full outer difference; NULL seeds match each other, one-sided rows have a NULL score."""
    keys = [*extra, *KEYS]
    l = left.select(*[F.col(k).alias(f"l_{k}") for k in keys], F.col("score").alias("l_score"), F.lit(1).alias("l_"))
    r = right.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("score").alias("r_score"), F.lit(1).alias("r_"))
    on = [F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}")) for k in keys]
    side = F.when(F.col("r_").isNull(), "left").when(F.col("l_").isNull(), "right").otherwise("both")
    return l.join(r, on, "full").select(
        *[F.coalesce(f"l_{k}", f"r_{k}").alias(k) for k in keys],
        (F.col("l_score") - F.col("r_score")).alias("score"), side.alias("side"))


def strict_deltas(left: DataFrame, right: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Differences of two tables that must match one to one."""
    both = deltas(left, right, extra)
    if not both.filter("side <> 'both'").isEmpty():
        raise ValueError("the two score tables have different keys")
    return both.drop("side")


def concat(*tables: DataFrame, tasks: Sequence[str] | None = None) -> DataFrame:
    """Rows of all tables; they must have the same columns and, where ``tasks`` names them, one task type."""
    if tasks is not None and len(set(tasks)) > 1:
        raise ValueError(f"tables of different task types: {sorted(set(tasks))}")
    if any(set(t.columns) != set(tables[0].columns) for t in tables):
        raise ValueError("the tables have different columns")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def bootstrap_matrix(scores: DataFrame, subset: str, metric: str, folds: Sequence[int],
                     extra: Sequence[str] = ("dataset",)) -> DataFrame:
    """Long matrix (extra..., fold, bootstrap_seed, score); a missing fold is a row of NULLs.

    The seeds come from whichever folds are present; a dataset without any has no rows.
    """
    boots = bootstraps(scores, subset, metric).select(*extra, "fold", "bootstrap_seed", "score")
    seeds = boots.groupBy(*extra, "bootstrap_seed").agg(F.lit(1).alias("_")).drop("_")
    grid = seeds.withColumn("fold", F.explode(F.array(*[F.lit(int(f)) for f in folds])))
    return grid.join(boots, [*extra, "fold", "bootstrap_seed"], "left")


def bootstrap_gain(matrix: DataFrame, by: Sequence[str] = ("dataset",), folds: Sequence[int] | None = None) -> DataFrame:
    """Share of positive minus share of negative differences; NULL when any is missing."""
    if folds is not None:
        matrix = matrix.filter(F.col("fold").isin(*folds))
    complete = F.count("score") == F.count(F.lit(1))
    if folds is not None:
        complete = complete & (F.count_distinct("fold") == len(set(folds)))
    sign = F.avg(F.signum("score"))
    return matrix.groupBy(*by).agg(F.when(complete, sign).alias("gain"))


def gains_summary(gains: DataFrame, label: str = "dataset", max_size: int = 30) -> DataFrame:
    return (gains.filter(F.col("gain").isNotNull())
            .select(shorten(label, max_size).alias("label"), "gain").orderBy("gain", "label"))


def seed_coverage(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Seeds present per fold group, and whether they are the seeds of the whole dataset."""
    per = scores.filter(F.col("bootstrap_seed").isNotNull()).groupBy(*by, "fold").agg(
        F.count_distinct("bootstrap_seed").alias("n_seeds"))
    whole = scores.filter(F.col("bootstrap_seed").isNotNull()).groupBy(*by).agg(
        F.count_distinct("bootstrap_seed").alias("n_all"))
    return per.join(whole, list(by)).select(
        *by, "fold", "n_seeds", (F.col("n_seeds") == F.col("n_all")).alias("aligned"))


def best_of(options: DataFrame, by: Sequence[str], order: str = "option_order", higher: bool | Column = True) -> DataFrame:
    """Best-scoring option per group; the first option wins ties, missing scores are skipped."""
    value = F.col("score") if higher is True else (-F.col("score") if higher is False else F.col("score") * higher)
    ranked = options.filter(F.col("score").isNotNull())
    best = ranked.groupBy(*by).agg(F.min(F.struct((-value).alias("_v"), F.col(order).alias("_o"),
                                                  F.struct(*[c for c in options.columns if c not in by]).alias("_r")))
                                   .alias("_b"))
    return best.select(*by, "_b._r.*")


def last_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
