"""Bootstrap resampling as row repetition.

A resampled table holds each drawn row once per draw, under a
``bootstrap_seed``; every metric is then an ordinary grouped aggregate. The
full sample has seed -1 internally and NULL in score tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import with_poisson, with_u63
from . import ranks

FULL = -1


def _seeds(seeds: Sequence[int | None]) -> Column:
    return F.array(*[F.lit(s).cast("int") for s in seeds if s is not None])


def _full(df: DataFrame, seeds: Sequence[int | None]) -> DataFrame | None:
    return df.withColumn("bootstrap_seed", F.lit(FULL)) if None in seeds else None


def resample_exact(df: DataFrame, parts: Sequence[str], seeds: Sequence[int | None]) -> DataFrame:
    """N draws with replacement out of the N rows of each part, for every seed.

    Draw number j of seed b takes the row with index u63(b, j) mod N. The draws
    are shuffled once on (part, index), a key that cannot be skewed beyond the
    draw counts, and gather their row by an equi join.
    """
    parts = list(parts)
    full = _full(df, seeds)
    if all(s is None for s in seeds):
        return full
    indexed = ranks.dense_index(ranks.spread(df, "row_id"), parts)
    sizes = df.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
    slots = indexed.select(*parts, F.col("idx").alias("_slot"))
    if parts:
        slots = slots.join(ranks.fit_small(sizes), parts)
    else:
        slots = slots.withColumn("_n", F.lit(sizes.first()["_n"]))
    draws = ranks.spread(slots, "_slot").withColumn("bootstrap_seed", F.explode(_seeds(seeds)))
    draws = with_u63(draws, "_u", F.col("bootstrap_seed"), "_slot")
    # coalesce: a key that cannot be NULL keeps the join from testing the whole hash for NULL in the scan
    at = F.coalesce(F.col("_u") % F.col("_n"), F.lit(0).cast("long"))
    draws = draws.select(*parts, "bootstrap_seed", at.alias("idx"))
    drawn = draws.join(indexed, [*parts, "idx"]).select(*df.columns, "bootstrap_seed")
    return drawn if full is None else full.unionByName(drawn)


def resample_poisson(df: DataFrame, parts: Sequence[str], seeds: Sequence[int | None]) -> DataFrame:
    """Each row repeated Poisson(1) times per seed: one pass, no shuffle, size N in expectation.

    ``parts`` is unused: a row's weight does not depend on its part.
    """
    full = _full(df, seeds)
    if all(s is None for s in seeds):
        return full
    spread = ranks.spread(df, "row_id").withColumn("bootstrap_seed", F.explode(_seeds(seeds)))
    spread = with_poisson(spread, "_w", F.col("bootstrap_seed"))
    # the outer explode leaves a NULL for weight 0; testing that NULL, not the weight, keeps the
    # optimizer from copying the hash into a filter at the scan
    copies = F.explode_outer(F.array_repeat(F.lit(1), F.col("_w").cast("int")))
    drawn = spread.withColumn("_one", copies).filter("_one is not null").drop("_one", "_w")
    return drawn if full is None else full.unionByName(drawn)


def resample(df: DataFrame, parts: Sequence[str], seeds: Sequence[int | None], method: str = "exact") -> DataFrame:
    if method not in ("exact", "poisson"):
        raise ValueError(f"unknown bootstrap method {method}")
    return (resample_exact if method == "exact" else resample_poisson)(df, parts, seeds)
