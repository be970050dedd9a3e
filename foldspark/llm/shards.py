"""Sharding by sampled splitters: near-equal bytes, equal texts side by side.

Records are ordered by (hash of the text, hash of the id, row). A size-weighted sample
of keys gives quantile boundaries that cut the order into fine ranges, each a small part
of a shard; their exact sizes are counted, and overfull ranges are cut again: a text whose
copies exceed ``1/HEAVY`` of a shard is cut among its copies, any other range between
texts. A shard is a run of fine ranges whose end lies next to its multiple of the mean, so
copies of one text share a shard unless they are too many for near-equal sizes. Positions
are ranks inside fine ranges plus offsets, so no task ever holds a shard.

Bounds: the driver and the broadcasts hold ``OVERSAMPLE`` keys and one row for each fine
range; there are ``FINE * n_shards`` of them, about, whatever the input. Defined cases: a
null text has no bytes and checksum 0; null ids and repeated rows are placed like others;
an empty table gives no rows; with fewer rows than shards some shards stay empty.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm.common import cut

FINE, OVERSAMPLE, HEAVY, ROUNDS = 40, 16, 20, 6


def records(docs: DataFrame, overhead: int = 16) -> DataFrame:
    """The narrow columns that place a record, written once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("k"), F.xxhash64("doc_id").alias("t"),
        F.monotonically_increasing_id().alias("r")))


def place(bounds: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """How many bounds (sorted, compared column by column) are at or before each record."""
    first, value = bounds[0], columns[0]
    out = np.searchsorted(first, value, "right")
    if len(bounds) == 1 or not len(first):
        return out
    low = np.searchsorted(first, value, "left")
    for at in np.unique(low[out > low]):
        rows = np.flatnonzero((low == at) & (out > low))
        end = out[rows[0]]
        out[rows] = at + place([b[at:end] for b in bounds[1:]], [c[rows] for c in columns[1:]])
    return out


def _placed(rows: DataFrame, bounds: list[tuple[int, int, int]]) -> DataFrame:
    spread = [np.array([b[i] for b in bounds], np.int64) for i in range(3)]
    held = rows.sparkSession.sparkContext.broadcast(spread)          # FINE * n_shards keys at most, about

    def assign(frames):
        for f in frames:
            f["fine"] = place(held.value, [f[c].to_numpy() for c in "ktr"]).astype(np.int64)
            yield f

    return rows.mapInPandas(assign, "doc_id long, size long, text_crc32 long, k long, t long, r long, fine long")


def _sampled(rows: DataFrame, step: float, salt: int) -> pd.DataFrame:
    """Keys drawn with chance size / step (at most 1), each with the bytes it stands for."""
    chance = F.col("size") / F.lit(step)
    draw = F.pmod(F.xxhash64("k", "t", "r", F.lit(salt)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    kept = rows.where(draw < chance).select(*rows.columns, F.greatest(F.col("size").cast("double"), F.lit(step)).alias("w"))
    return kept.toPandas()


def _quantiles(sample: pd.DataFrame, whole_texts: bool, step: float) -> list[tuple[int, int, int]]:
    """A bound wherever another ``step`` of bytes is full."""
    sample = sample.sort_values(["k", "t", "r"], ignore_index=True)
    if whole_texts:
        sample = sample.groupby("k", as_index=False)["w"].sum()
    full = np.floor(np.cumsum(sample["w"].to_numpy()) / step)
    at = np.flatnonzero(np.diff(full) > 0) + 1
    low = np.iinfo(np.int64).min
    if whole_texts:
        return [(int(k), low, low) for k in sample["k"].iloc[at]]
    return [(int(k), int(t), int(r)) for k, t, r in sample[["k", "t", "r"]].iloc[at].itertuples(index=False)]


def split_ranges(rows: DataFrame, n_shards: int) -> tuple[list[tuple[int, int, int]], pd.DataFrame]:
    """Bounds of the fine ranges, and the bytes and rows of each range that holds any."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    goal = max(total / n_shards / FINE, 1.0)
    bounds = sorted(set(_quantiles(_sampled(rows, goal / OVERSAMPLE, 0), True, goal)))
    heavy: set[int] = set()
    for salt in range(1, ROUNDS + 1):
        placed = _placed(rows, bounds)
        sizes = placed.groupBy("fine").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).toPandas()
        over = sizes[(sizes["bytes"] > 2 * goal) & (sizes["n"] > 1)]
        if over.empty or salt == ROUNDS:
            break
        fines = [int(x) for x in over["fine"]]
        inside = placed.where(F.col("fine").isin(fines))
        # texts too large for one range: at most HEAVY * n_shards
        texts = inside.groupBy("k").agg(F.sum("size").alias("b"), F.count("*").alias("n")).where(
            (F.col("b") > total / n_shards / HEAVY) & (F.col("n") > 1))
        own = {int(r["k"]) for r in texts.select("k").collect()}
        new: set[tuple[int, int, int]] = set()
        low = np.iinfo(np.int64).min
        for k in own - heavy:
            new |= {(k, low, low)} | ({(k + 1, low, low)} if k < np.iinfo(np.int64).max else set())
        more = _sampled(inside, goal / OVERSAMPLE, salt)
        for _, part in more.groupby("fine"):
            hot = part["k"].isin(own)
            for k, copies in part[hot].groupby("k"):
                new |= set(_quantiles(copies, False, goal))
            new |= set(_quantiles(part[~hot], True, goal / 2))
        heavy |= own
        if new <= set(bounds):
            break
        bounds = sorted(set(bounds) | new)
    return bounds, sizes.sort_values("fine", ignore_index=True)


def shard_of_ranges(sizes: pd.DataFrame, n_shards: int) -> pd.DataFrame:
    """Each range's shard and the rows before it there: a shard ends at the range end nearest to its share."""
    ends = sizes["bytes"].cumsum().to_numpy(np.float64)
    starts = np.concatenate([[0.0], ends])
    total = ends[-1] if len(ends) else 0.0
    marks = np.arange(1, n_shards) * total / n_shards
    at = np.searchsorted(starts, marks)
    at = np.where(np.abs(starts[np.maximum(at - 1, 0)] - marks) <= np.abs(starts[np.minimum(at, len(ends))] - marks), at - 1, at)
    shard = np.searchsorted(np.maximum.accumulate(at), np.arange(len(ends)), "right") if len(ends) else np.array([], int)
    out = sizes.assign(shard=shard.astype(np.int64))
    out["before"] = out.groupby("shard")["n"].cumsum() - out["n"]
    return out[["fine", "shard", "before"]]


def shard_records(docs: DataFrame, n_shards: int = 40, overhead: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: one row for each row of docs; slots are gapless from 0 in each shard."""
    rows = records(docs, overhead)
    bounds, sizes = split_ranges(rows, n_shards)
    ranges = shard_of_ranges(sizes, n_shards).astype("int64")
    offsets = rows.sparkSession.createDataFrame(ranges, "fine long, shard long, before long")
    rank = F.row_number().over(Window.partitionBy("fine").orderBy("k", "t", "r")) - 1
    ranked = _placed(rows, bounds).withColumn("rank", rank)
    return ranked.join(F.broadcast(offsets), "fine").select(       # one row for each fine range
        "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
        (F.col("before") + F.col("rank")).cast("long").alias("slot"))
