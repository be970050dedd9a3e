"""Order statistics that never put one whole group into one task.

Three primitives carry every rank, quantile and cumulative sum of the package:

* ``row_thresholds``  - rows standing at given ranks of a uniformly spread key,
  found with a histogram pass and a look at the few buckets that matter;
* ``running_sums``    - cumulative sums over value order, computed inside value
  buckets and shifted by bucket offsets when a group is hot;
* ``exact_quantiles`` - exact interpolated (and weighted) quantiles.

``fit_small`` is the other half of the design: a fit step reduces to a small
table, its size is checked, and only then it is broadcast. A table above the
limit stays an ordinary DataFrame and is joined by shuffle (AQE splits skew).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from . import quantiles

SMALL_ROWS = 50_000
QUANTILE_BYTES = 8 << 20
CUTS = 1024          # value buckets of a hot group, found in two steps of 32
SIDE = 32


def _conf(df: DataFrame, key: str, default: int) -> int:
    return int(df.sparkSession.conf.get(f"foldspark.{key}", str(default)))


def plan_bytes(df: DataFrame) -> int:
    """Bytes a plan reads: the optimizer's sizes of its sources after pruning, no job.

    The estimate of the root would multiply the sides of every join.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a small input one partition per core before work that multiplies its rows.

    An input above 128 MB per core, or of a file of 4 MB for every core, already has
    enough partitions and passes through without a shuffle. Partitioning by key
    stays the same on a retry.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = plan_bytes(df)
    if size >= cores * (128 << 20) or (size >= cores * (4 << 20) and len(df.inputFiles()) >= cores):
        return df
    return df.repartition(cores, *keys)


def is_large(df: DataFrame) -> bool:
    """Does the plan exceed what one window group may hold without buckets?"""
    return plan_bytes(df) > _conf(df, "rank.plainBytes", 512 << 20)


def hash_bits(df: DataFrame) -> int:
    """Histogram resolution: about 64 MB of input per bucket, 16 to 65,536 buckets."""
    chunk = _conf(df, "rank.bucketBytes", 64 << 20)
    return min(16, max(4, (plan_bytes(df) // chunk).bit_length()))


def local_table(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame | None:
    """The result as a driver-built table, or None when it has more than ``limit`` rows."""
    table = df.limit(limit + 1).toArrow()
    if table.num_rows > limit:
        return None
    rows = df.sparkSession.createDataFrame(table, schema=df.schema)
    return rows


def fit_small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """Broadcast a fitted table after checking its row count, else leave it distributed."""
    local = local_table(df, limit)
    return df if local is None else F.broadcast(local)


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
              strict: Sequence[str] = ()) -> DataFrame:
    """Join on keys where NULL equals NULL (and on ``strict`` keys where it does not); keys come from the left."""
    names = {k: f"_same_{k}" for k in [*keys, *strict]}
    right = right.withColumnsRenamed(names)
    on = [left[k].eqNullSafe(right[names[k]]) for k in keys] + [left[k] == right[names[k]] for k in strict]
    return left.join(right, on, how).drop(*names.values())


# --------------------------------------------------------------------------
# thresholds of a uniform key


def hash_bucket(bits: int) -> Callable[[Column], Column]:
    return lambda key: F.shiftright(key, 32 - bits)


def width_bucket(lo: int, hi: int, bits: int) -> Callable[[Column], Column]:
    """Equal-width buckets of an integer key known to lie in [lo, hi]."""
    n = 1 << bits
    width = max(1, -(-(hi - lo + 1) // n))
    return lambda key: F.floor((key - F.lit(lo)) / F.lit(width)).cast("long")


def row_thresholds(
    df: DataFrame,
    parts: Sequence[str],
    ranks: Column,
    bucket: Callable[[Column], Column],
    extra: DataFrame | None = None,
) -> DataFrame:
    """Rows at given 1-based ranks of the order (``key``, ``row_id``) inside each part.

    ``ranks`` builds an array of struct(slot, rank) from the part's row count
    ``n`` and from the columns of ``extra`` (one row per part). Rank 0 yields
    the pair (-1, -1), which is below every row. Only the buckets that hold a
    wanted rank are read again; nothing else is shuffled.
    """
    parts = list(parts)
    keyed = df.withColumn("_b", bucket(F.col("key")))
    hist = keyed.groupBy(*parts, "_b").agg(F.count(F.lit(1)).alias("cnt"))
    order = W.partitionBy(*parts).orderBy("_b")
    whole = W.partitionBy(*parts)
    hist = hist.withColumn("hi", F.sum("cnt").over(order)).withColumn("n", F.sum("cnt").over(whole))
    if extra is not None:
        hist = join_same(hist, extra, parts)
    first = F.col("hi") == F.col("cnt")
    wanted = (
        hist.withColumn("lo", F.col("hi") - F.col("cnt"))
        .withColumn("t", F.explode(ranks))
        .select(*parts, "_b", "lo", "hi", first.alias("first"), F.col("t.slot").alias("slot"),
                F.col("t.rank").cast("long").alias("rank"))
        .filter(((F.col("rank") > F.col("lo")) & (F.col("rank") <= F.col("hi")))
                | ((F.col("rank") <= 0) & F.col("first")))
    )
    wanted = fit_small(wanted.select(*parts, "_b", "slot", (F.col("rank") - F.col("lo")).alias("r"),
                                     (F.col("rank") <= 0).alias("none")))
    per_bucket = wanted.filter(~F.col("none")).groupBy(*parts, "_b").agg(
        F.collect_list(F.struct("slot", "r")).alias("ts"))
    inside = W.partitionBy(*parts, "_b").orderBy("key", "row_id")
    found = (
        join_same(keyed.select(*parts, "_b", "key", "row_id"),
                  F.broadcast(per_bucket) if local_hint(wanted) else per_bucket, parts, strict=["_b"])
        .withColumn("rn", F.row_number().over(inside).cast("long"))
        .withColumn("t", F.explode(F.filter("ts", lambda t: t["r"] == F.col("rn"))))
        .select(*parts, F.col("t.slot").alias("slot"), "key", "row_id")
    )
    low = F.lit(-1).cast("long")
    empty = wanted.filter("none").select(*parts, "slot", low.alias("key"), low.alias("row_id"))
    return found.unionByName(empty)


def local_hint(df: DataFrame) -> bool:
    """Is the plan backed by a driver-built table (so its size was checked)?"""
    return plan_bytes(df) < (256 << 20)


# --------------------------------------------------------------------------
# value buckets of hot groups


def value_cuts(df: DataFrame, parts: Sequence[str], value: str) -> DataFrame | None:
    """Cut points per hot part as a checked local table; None when there is no hot part.

    Cut points come from a bounded sketch and only decide balance: any cut
    points give the same result. They are collected once, so both readers of a
    bucketed table see the same buckets.
    """
    probs = F.array(*[F.lit(i / CUTS) for i in range(1, CUTS)])
    hot = (
        df.groupBy(*parts)
        .agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(value, probs, F.lit(4 * CUTS)).alias("_cuts"))
        .filter(F.col("_n") > _conf(df, "rank.hotRows", 2_000_000))
        .drop("_n")
    )
    local = local_table(hot, 5_000)
    return None if local is None or local.isEmpty() else local


def _bucket_of(value: Column, cuts: Column) -> Column:
    coarse_cuts = F.transform(F.sequence(F.lit(1), F.lit(SIDE - 1)), lambda j: F.get(cuts, j * SIDE - 1))
    coarse = F.size(F.filter(coarse_cuts, lambda c: c <= value))
    fine = F.size(F.filter(F.slice(cuts, coarse * SIDE + 1, F.lit(SIDE - 1)), lambda c: c <= value))
    return F.when(cuts.isNull(), F.lit(0)).otherwise(coarse * SIDE + fine)


def bucketed(df: DataFrame, parts: Sequence[str], value: str) -> DataFrame | None:
    """Add the value bucket ``_b``; None when a plain window is good enough."""
    if not is_large(df):
        return None
    cuts = value_cuts(df, parts, value)
    if cuts is None:
        return None
    if parts:
        df = join_same(df, F.broadcast(cuts), list(parts), "left")
    else:
        values = cuts.first()["_cuts"]
        df = df.withColumn("_cuts", F.array(*[F.lit(v) for v in values]))
    return df.withColumn("_b", _bucket_of(F.col(value), F.col("_cuts"))).drop("_cuts")


def running_sums(df: DataFrame, parts: Sequence[str], value: str, cols: Sequence[str]) -> DataFrame:
    """Add ``cum_<col>``: sum of the column over rows of the part up to this value."""
    parts = list(parts)
    split = bucketed(df, parts, value)
    if split is None:
        w = W.partitionBy(*parts).orderBy(value)
        return df.select("*", *[F.sum(c).over(w).alias(f"cum_{c}") for c in cols])
    w = W.partitionBy(*parts, "_b").orderBy(value)
    inner = split.select("*", *[F.sum(c).over(w).alias(f"_in_{c}") for c in cols])
    totals = split.groupBy(*parts, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    before = W.partitionBy(*parts).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*parts, "_b", *[
        F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in cols])
    joined = join_same(inner, fit_small(offsets, 5_000_000 // CUTS * 8), parts, strict=["_b"])
    return joined.select(*df.columns, *[
        (F.col(f"_in_{c}") + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in cols])


def dense_index(df: DataFrame, parts: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """Add ``idx``: 0-based position of the row inside its part, in row id order."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    return (running_sums(ones, parts, row_id, ["_one"])
            .withColumn("idx", F.col("cum__one") - 1).drop("_one", "cum__one"))


# --------------------------------------------------------------------------
# quantiles


def exact_quantiles(
    df: DataFrame,
    parts: Sequence[str],
    value: str,
    probs: Sequence[float],
    weight: str | None = None,
    name: str = "q",
) -> DataFrame:
    """One row per part with the array ``name`` of linearly interpolated quantiles."""
    parts, probs = list(parts), [float(p) for p in probs]
    df = df.filter(F.col(value).isNotNull())
    wanted = F.array(*[F.lit(p) for p in probs])
    # a percentile holds all values of a group in one task
    if plan_bytes(df) > min(QUANTILE_BYTES, _conf(df, "rank.plainBytes", QUANTILE_BYTES)):
        got = quantiles.held_out(df, parts, value, probs, weight)
        if got is not None:
            schema = T.StructType([*[df.schema[c] for c in parts], T.StructField(name, T.ArrayType(T.DoubleType()))])
            return df.sparkSession.createDataFrame([(*k[:-1], q) for k, q in got.items()] or ([] if parts else [(None,)]), schema)
    split = bucketed(df, parts, value)
    if split is None:
        args = [value, wanted] + ([F.col(weight)] if weight else [])
        return df.groupBy(*parts).agg(F.percentile(*args).alias(name))
    w = F.col(weight) if weight else F.lit(1).cast("long")
    split = split.select(*parts, "_b", F.col(value).cast("double").alias("_v"), w.alias("_w"))
    hist = split.groupBy(*parts, "_b").agg(F.sum("_w").alias("_c"))
    order = W.partitionBy(*parts).orderBy("_b")
    hist = hist.withColumn("_hi", F.sum("_c").over(order)).withColumn(
        "_n", F.sum("_c").over(W.partitionBy(*parts)))
    slots = []
    for i, p in enumerate(probs):
        pos = F.lit(p) * (F.col("_n") - 1)
        for side, at in ((0, F.floor(pos)), (1, F.ceil(pos))):
            slots.append(F.struct(F.lit(2 * i + side).alias("slot"), (at + 1).cast("long").alias("rank"),
                                  (pos - F.floor(pos)).alias("frac")))
    lo = F.col("_hi") - F.col("_c")
    targets = (
        hist.withColumn("_lo", lo).withColumn("t", F.explode(F.array(*slots)))
        .filter((F.col("t.rank") > F.col("_lo")) & (F.col("t.rank") <= F.col("_hi")))
        .groupBy(*parts, "_b")
        .agg(F.collect_list(F.struct(F.col("t.slot").alias("slot"), F.col("t.frac").alias("frac"),
                                     (F.col("t.rank") - F.col("_lo")).alias("r"))).alias("_ts"))
    )
    levels = (
        join_same(split, fit_small(targets), parts, strict=["_b"])
        .groupBy(*parts, "_b", "_v").agg(F.sum("_w").alias("_w"), F.first("_ts").alias("_ts"))
    )
    cum = F.sum("_w").over(W.partitionBy(*parts, "_b").orderBy("_v"))
    hits = (
        levels.withColumn("_cum", cum)
        .withColumn("t", F.explode(F.filter("_ts", lambda t: (t["r"] <= F.col("_cum"))
                                            & (t["r"] > F.col("_cum") - F.col("_w")))))
        .select(*parts, F.col("t.slot").alias("slot"), F.col("t.frac").alias("frac"), "_v")
    )
    by_slot = hits.groupBy(*parts).agg(
        F.array_sort(F.collect_list(F.struct("slot", "_v", "frac"))).alias("_s"))
    pick = F.transform(F.sequence(F.lit(0), F.lit(len(probs) - 1)), lambda i: (
        F.get(F.col("_s"), i * 2)["_v"]
        + F.get(F.col("_s"), i * 2)["frac"]
        * (F.get(F.col("_s"), i * 2 + 1)["_v"] - F.get(F.col("_s"), i * 2)["_v"])))
    return by_slot.select(*parts, pick.alias(name))
