"""Exact quantiles of large groups: counts in bins, then a look at the few bins that hold a wanted rank.

A sketch of each group gives cut points, which are divided further; tasks count values
between them. The counts tell in which bin each rank stands, and only rows of those bins are
read again, where they collapse to values. With ``fold`` the quantiles are those of the rows
outside each fold: counts are kept by fold, so no row is copied to the folds it trains.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups, cut points of the sketch, and bins of all groups and folds together that the driver looks at.
MOST_GROUPS, CUTS, MOST_BINS, GROUP_BINS = 5_000, 512, 2_000_000, 1 << 16
#: Rows that a task counts at once; bins whose rows of interest lie in one task.
COUNT_ROWS, CHUNK = 200_000, 1024


def _numpy(batch, i: int) -> np.ndarray:
    return batch.column(i).to_numpy(zero_copy_only=False)


def _fine(cuts: Sequence[float] | None, bins: int) -> np.ndarray:
    """Cut points between which a group's values are counted."""
    c = np.unique(np.array([v for v in cuts or [] if np.isfinite(v)], float))
    if len(c) < 2:
        return c
    k = max(1, bins // len(c))
    return np.unique(np.append((c[:-1, None] + (c[1:] - c[:-1])[:, None] * (np.arange(k) / k)).ravel(), c[-1]))


def held_out(df: DataFrame, parts: Sequence[str], value: str, probs: Sequence[float], weight: str | None = None,
             fold: str | None = None, n_folds: int = 1) -> dict[tuple, list[float]] | None:
    """(parts..., fold) -> interpolated quantiles of the rows outside the fold (all rows, fold 0, without ``fold``).

    Groups without such a row are left out; None where there are too many groups.
    """
    parts, probs, spark = list(parts), np.array(probs, float), df.sparkSession
    rows = df.filter(F.col(value).isNotNull())
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    which = F.col(fold).cast("int") if fold else F.lit(-1)
    rows = rows.select(*parts, F.col(value).cast("double").alias("_v"), w.alias("_w"), which.alias("_f")).filter("_f IS NOT NULL")
    sketch = F.percentile_approx("_v", F.array(*[F.lit(i / CUTS) for i in range(CUTS + 1)]), F.lit(4 * CUTS))
    found = rows.groupBy(*parts).agg(sketch.alias("_q")).limit(MOST_GROUPS + 1).collect()
    if len(found) > MOST_GROUPS or len(found) * n_folds * len(probs) > MOST_BINS:
        return None
    if not found:
        return {}
    bins = int(np.clip(MOST_BINS // (len(found) * n_folds), 64, GROUP_BINS))
    cuts = spark.sparkContext.broadcast([_fine(r["_q"], bins) for r in found])
    if parts:
        kinds = [df.schema[c].dataType.simpleString() for c in parts]
        numbers = spark.createDataFrame([(*[r[c] for c in parts], i) for i, r in enumerate(found)],
                                        ", ".join([*(f"_by{i} {k}" for i, k in enumerate(kinds)), "_g int"]))
        same = F.lit(True)
        for i, c in enumerate(parts):
            same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
        rows = rows.join(F.broadcast(numbers), same)
    else:
        rows = rows.withColumn("_g", F.lit(0))
    rows = rows.select("_g", "_f", "_v", "_w")

    def bin_of(batch) -> tuple[np.ndarray, np.ndarray]:
        g, v = _numpy(batch, 0), _numpy(batch, 2)
        at = np.zeros(len(g), np.int64)
        for one in np.unique(g):
            mine = g == one
            at[mine] = np.searchsorted(cuts.value[one], v[mine], side="right")
        return g, at

    def count(batches):
        held: dict[tuple[int, int], np.ndarray] = {}
        waiting: list[tuple] = []

        def add():
            g, at, f, n = (np.concatenate(x) for x in zip(*waiting))
            waiting.clear()
            for one in np.unique(g):
                mine = np.flatnonzero(g == one)
                for own in np.unique(f[mine]):
                    here = mine[f[mine] == own]
                    key = int(one), int(own)
                    held[key] = held.get(key, 0.0) + np.bincount(at[here], n[here], len(cuts.value[one]) + 1)

        for batch in batches:
            waiting.append((*bin_of(batch), _numpy(batch, 1), _numpy(batch, 3)))
            if sum(len(x[0]) for x in waiting) > COUNT_ROWS:
                add()
        if waiting:
            add()
        for (one, own), n in held.items():
            some = np.flatnonzero(n)
            yield pa.record_batch([np.full(len(some), one, np.int32), np.full(len(some), own, np.int32), some.astype(np.int32), n[some]],
                                  ["_g", "_f", "_bin", "n"])

    counts = rows.mapInArrow(count, "_g int, _f int, _bin int, n double").groupBy("_g", "_f", "_bin").agg(F.sum("n").alias("n")).toArrow()
    cg, cf, cb, cn = (counts.column(c).to_numpy() for c in ("_g", "_f", "_bin", "n"))
    wanted: dict[int, list] = {}                              # group -> (fold, bins, ranks inside them) of lower and upper neighbours
    position: dict[tuple[int, int], np.ndarray] = {}
    for one in range(len(found)):
        own = cg == one
        total = np.bincount(cb[own], cn[own], len(cuts.value[one]) + 1)
        for f in range(n_folds):
            n = total if not fold else total - np.bincount(cb[own & (cf == f)], cn[own & (cf == f)], len(total))
            end = np.cumsum(n)
            if end[-1] <= 0:
                continue
            at = position[one, f] = probs * (end[-1] - 1)
            ranks = np.concatenate([np.floor(at), np.ceil(at)])
            b = np.searchsorted(end, ranks, side="right")
            wanted.setdefault(one, []).append((f, b, ranks - (end[b] - n[b])))
    told = spark.sparkContext.broadcast(wanted)

    def inside(batches):
        for batch in batches:
            g, at = bin_of(batch)
            keep = np.zeros(len(g), bool)
            for one in np.unique(g):
                if one in told.value:
                    mine = g == one
                    need = np.zeros(len(cuts.value[one]) + 1, bool)
                    need[np.concatenate([b for _, b, _ in told.value[one]])] = True
                    keep[mine] = need[at[mine]]
            if keep.any():
                cols = (g[keep], _numpy(batch, 1)[keep], at[keep], _numpy(batch, 2)[keep] + 0.0)
                order = np.lexsort(cols[::-1])
                cols = [c[order] for c in cols]
                new = np.ones(len(order), bool)
                new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
                starts = np.flatnonzero(new)
                g, f, b, v = (c[starts] for c in cols)
                yield pa.record_batch([g.astype(np.int32), f.astype(np.int32), b.astype(np.int32), v, np.add.reduceat(_numpy(batch, 3)[keep][order], starts)],
                                      ["_g", "_f", "_bin", "_v", "n"])

    levels = rows.mapInArrow(inside, "_g int, _f int, _bin int, _v double, n double").groupBy("_g", "_f", "_bin", "_v").agg(F.sum("n").alias("n"))

    def pick(table: pa.Table) -> pa.Table:
        f, b, v, n = (table.column(c).to_numpy() for c in ("_f", "_bin", "_v", "n"))
        one, order = table.column("_g")[0].as_py(), np.lexsort((v, b))
        f, b, v, n = f[order], b[order], v[order], n[order]
        out = [[], [], []]
        for own, bins, ranks in told.value[one]:
            slots = np.flatnonzero(bins // CHUNK == b[0] // CHUNK)
            if len(slots):
                here = np.where(f == own, 0.0, n) if fold else n
                end = np.cumsum(here)
                start = np.searchsorted(b, bins[slots], side="left")
                begin = np.where(start > 0, end[np.maximum(start - 1, 0)], 0.0)
                hit = np.searchsorted(end, begin + ranks[slots], side="right")
                out[0].append(np.full(len(slots), own, np.int32))
                out[1].append(slots.astype(np.int32))
                out[2].append(v[hit])
        f, slot, v = (np.concatenate(x) if x else np.zeros(0) for x in out)
        return pa.table({"_g": pa.array(np.full(len(f), one), pa.int32()), "_f": pa.array(f, pa.int32()), "slot": pa.array(slot, pa.int32()), "v": pa.array(v, pa.float64())})

    picked = levels.withColumn("_chunk", (F.col("_bin") / CHUNK).cast("int")).groupBy("_g", "_chunk").applyInArrow(
        pick, "_g int, _f int, slot int, v double").toArrow()
    pg, pf, ps, pv = (picked.column(c).to_numpy() for c in ("_g", "_f", "slot", "v"))
    ends = {k: np.full(2 * len(probs), np.nan) for k in position}
    for k, values in ends.items():
        mine = (pg == k[0]) & (pf == k[1])
        values[ps[mine]] = pv[mine]
    out = {}
    for (one, f), values in ends.items():
        at, (a, b) = position[one, f], values.reshape(2, -1)
        low, high = np.floor(at), np.ceil(at)
        # infinite neighbours have no way between them
        q = np.where(a == b, a, a * (high - at) + b * (at - low))
        out[(*[found[one][c] for c in parts], f)] = q.tolist()
    return out
