"""Bootstrap scores from weights: every row is read once for all seeds and is never repeated.

A Poisson bootstrap draws a row as often as its keyed hash says, so a metric of a seed is a
metric of weighted rows. A task computes the weights of a batch for all seeds at once (the
same hash as ``hashing.with_poisson``, a row per seed of one matrix) and adds sums; what
leaves it are some sums per group and seed.

* Means, variances and recalls follow from weighted sums.
* For the median that the absolute error is compared with, values fall into bins. The
  weights of the bins show which of them holds a seed's median, and the rows of those few
  are read again, where they collapse to values; the other bins only give sums.
* Pairs in order (AUC) are counted in buckets of scores: pairs inside a bucket by a sort of
  its rows, pairs of two buckets from the buckets' sums. A score that many rows share is a
  bucket of its own and collapses in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.hashing import MASK, MIX, POISSON_CUTS, STRIDE, WORD, mix_int
from ..session import cut
from . import ranks
from .resample import FULL

#: Groups whose facts the driver may hold; beyond that rows are repeated instead.
MOST_GROUPS = 5_000
#: Bins of the values of a group, and of all groups together; rows of a bucket of scores, and their number.
BINS, MOST_BINS, BUCKET_ROWS, BUCKETS = 500, 20_000, 100_000, 256
#: Groups that a task holds before it lets their sums go.
HELD_GROUPS = 10_000


def _turn(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint32(16))) * np.uint32(MIX)


def poisson_weights(ids: np.ndarray, seeds: Sequence[int]) -> np.ndarray:
    """(seeds, rows) weights of row ids; the seed ``FULL`` weighs every row one."""
    rid = ids.astype(np.int64).view(np.uint64)
    low, high = _turn((rid & np.uint64(MASK)).astype(np.uint32)), _turn((rid >> np.uint64(32)).astype(np.uint32))
    keys = np.array([mix_int((s * STRIDE + 1) % WORD) for s in seeds], np.uint32)
    x = _turn(_turn(low[None, :] ^ keys[:, None]) ^ high[None, :])
    x ^= x >> np.uint32(16)
    out = np.zeros(x.shape, np.uint8)
    for c in POISSON_CUTS:
        out += x >= np.uint32(c)
    out[[i for i, s in enumerate(seeds) if s == FULL]] = 1
    return out


def _numpy(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return batch.column(i).to_numpy(zero_copy_only=False)


def weighted_sums(df: DataFrame, by: Sequence[str], values: Mapping[str, Column], seeds: Sequence[int]) -> DataFrame:
    """(by..., bootstrap_seed, _w, values...): weighted sums over the rows of each group, without groups nobody drew.

    ``by`` are number columns without NULL, ``df`` has ``row_id``; a NULL value adds nothing.
    """
    by, names, seeds = list(by), list(values), list(seeds)
    rows = df.select(*by, F.coalesce(F.col("row_id").cast("long"), F.lit(0).cast("long")).alias("_id"),
                     *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(n) for n, v in values.items()])
    keys = [rows.schema[c] for c in by]
    schema = T.StructType([*keys, T.StructField("bootstrap_seed", T.IntegerType()), T.StructField("_w", T.DoubleType()),
                           *[T.StructField(n, T.DoubleType()) for n in names]])

    def emit(held: dict[tuple, np.ndarray]) -> Iterator[pa.RecordBatch]:
        sums = np.stack(list(held.values()))                          # (groups, seeds, 1 + values)
        group, seed = np.nonzero(sums[:, :, 0] > 0)
        groups = list(held)
        cols = [np.array([g[i] for g in groups])[group] for i in range(len(by))]
        cols += [np.array(seeds, np.int32)[seed], *(sums[group, seed, j] for j in range(len(names) + 1))]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], schema.names)

    types = [{"int": pa.int32(), "bigint": pa.int64()}.get(f.dataType.simpleString(), pa.float64()) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            k, cols = len(by), [_numpy(batch, i) for i in range(len(by))]
            order = np.lexsort(cols[::-1])
            cols = [c[order] for c in cols]
            new = np.zeros(len(order), bool)
            new[0] = True
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(new)
            weights = poisson_weights(_numpy(batch, k)[order], seeds)
            x = np.column_stack([np.ones(len(order)), *(_numpy(batch, k + 1 + j)[order] for j in range(len(names)))])
            if len(order) >= 8 * len(starts):
                w = weights.astype(float)
                sums = np.stack([w[:, a:b] @ x[a:b] for a, b in zip(starts, [*starts[1:], len(order)])])
            else:
                sums = np.stack([np.add.reduceat(weights * x[:, j], starts, axis=1).T for j in range(x.shape[1])], axis=2)
            for g, s in zip(zip(*[c[starts].tolist() for c in cols]), sums):
                held[g] = held[g] + s if g in held else s
            if len(held) > HELD_GROUPS:
                yield from emit(held)
                held = {}
        if held:
            yield from emit(held)

    parts = rows.mapInArrow(run, schema)
    return parts.groupBy(*by, "bootstrap_seed").agg(*[F.sum(c).alias(c) for c in ["_w", *names]])


# --------------------------------------------------------------------------
# groups


def _finite(c: Column) -> Column:
    return F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))


def _numbered(df: DataFrame, by: Sequence[str], facts: Sequence[Column]) -> tuple[list, DataFrame, DataFrame] | None:
    """Facts of each group on the driver, the table of group numbers ``_g``, and df with ``_g``; None for too many groups."""
    found = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *facts).limit(MOST_GROUPS + 1).collect()
    if len(found) > MOST_GROUPS:
        return None
    schema = T.StructType([*[T.StructField(f"_by{i}", df.schema[c].dataType) for i, c in enumerate(by)], T.StructField("_g", T.IntegerType())])
    numbers = df.sparkSession.createDataFrame([(*[r[c] for c in by], i) for i, r in enumerate(found)], schema)
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return found, numbers.withColumnsRenamed({f"_by{i}": c for i, c in enumerate(by)}), df.join(F.broadcast(numbers), same).drop(
        *[f"_by{i}" for i in range(len(by))])


def _of_group(values: Sequence[float]) -> Column:
    """The value that a list by group number has for a row."""
    return F.get(F.lit([float(v) for v in values]), F.col("_g"))


# --------------------------------------------------------------------------
# absolute errors


def _ratio(err: Column, spread: Column, defined: Column) -> Column:
    return F.when(defined, F.when(spread > 0, 1 - err / spread).when(err == 0, 1.0).otherwise(0.0))


def _medians(rows: DataFrame, bins: DataFrame, totals: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """(_g, bootstrap_seed, median, first, last, inside): weighted medians, the bins that hold them, and the sum of
    the distances from them in these bins.

    The bins' weights tell in which bins the middle of each seed lies; only the rows of those are read again.
    """
    key = ["_g", "bootstrap_seed"]
    at = F.lit(0.5) * (F.col("n_y") - 1)
    middle = totals.filter("n_y > 0 and odd = 0").select(*key, at.alias("at"), F.floor(at).cast("double").alias("lo"), F.ceil(at).cast("double").alias("hi"))
    up_to = F.sum("_w").over(W.partitionBy(*key).orderBy("_bin"))
    held = bins.filter("_bin >= 0").withColumn("end", up_to).withColumn("begin", F.col("end") - F.col("_w")).join(middle, key)
    held = cut(held.filter("end > lo and begin <= hi").select(*key, "_bin", "begin", "at", "lo", "hi"))
    wanted = [r["k"] for r in held.select((F.col("_g") * BINS + F.col("_bin")).alias("k")).distinct().collect()]
    inside = rows.filter((F.col("_bin") >= 0) & (F.col("_g") * BINS + F.col("_bin")).isin(wanted))
    values = cut(weighted_sums(inside.withColumn("_v", F.col("y") + 0.0), ["_g", "_bin", "_v"], {}, seeds)).join(held, [*key, "_bin"])
    values = values.withColumn("up", F.col("begin") + F.sum("_w").over(W.partitionBy(*key, "_bin").orderBy("_v")))
    found = values.groupBy(*key, "at", "lo", "hi").agg(
        F.min(F.when(F.col("up") > F.col("lo"), F.col("_v"))).alias("a"), F.min(F.when(F.col("up") > F.col("hi"), F.col("_v"))).alias("b"),
        F.min("_bin").alias("first"), F.max("_bin").alias("last"))
    median = F.when(F.col("lo") == F.col("hi"), F.col("a")).otherwise(
        F.col("a") * (F.col("hi") - F.col("at")) + F.col("b") * (F.col("at") - F.col("lo")))
    found = cut(found.select(*key, median.alias("median"), "first", "last"))
    spread = values.select(*key, "_v", "_w").join(found, key).groupBy(*key).agg(F.sum(F.col("_w") * F.abs(F.col("_v") - F.col("median"))).alias("inside"))
    return found.join(spread, key)


def _errors(df: DataFrame, by: Sequence[str], names: Sequence[str], seeds: Sequence[int]) -> DataFrame | None:
    """r2 and d2_absolute_error in wide form (by..., bootstrap_seed, names...)."""
    y, p = F.col("y"), F.col("pred")
    probs = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    given = _numbered(df, by, [F.percentile_approx(F.when(_finite(y), y), probs, F.lit(4 * BINS)).alias("_q")])
    if given is None:
        return None
    facts, numbers, rows = given
    # fewer bins for many groups: their sums stay small
    step = max(1, BINS * len(facts) // MOST_BINS)
    cuts = [np.unique(np.array((r["_q"] or [])[step - 1::step], float)) for r in facts]
    centre = [r["_q"][BINS // 2 - 1] if r["_q"] else 0.0 for r in facts]

    def place(batches):
        for batch in batches:
            g, x = _numpy(batch, 0), batch.column(2).fill_null(np.nan).to_numpy(zero_copy_only=False)
            at = np.full(len(g), -1, np.int32)
            for one in np.unique(g):
                mine = np.flatnonzero((g == one) & np.isfinite(x))
                at[mine] = np.searchsorted(cuts[one], x[mine], side="right")
            yield pa.record_batch([*batch.columns, pa.array(at, pa.int32())], ["_g", "row_id", "y", "pred", "_bin"])

    rows = rows.select("_g", F.col("row_id").cast("long").alias("row_id"), "y", "pred").mapInArrow(
        place, "_g int, row_id long, y double, pred double, _bin int")
    fine, d = _finite(y), F.when(_finite(y), y - _of_group(centre))
    both = fine & _finite(p)
    sums = {"n_y": y.isNotNull(), "n_p": p.isNotNull(), "odd": (y.isNotNull() & ~fine) | (p.isNotNull() & ~_finite(p)),
            "s1": d, "s2": d * d, "n_e": both, "e1": F.when(both, F.abs(y - p)), "e2": F.when(both, (y - p) * (y - p))}
    bins = cut(weighted_sums(rows, ["_g", "_bin"], sums, seeds))
    key = ["_g", "bootstrap_seed"]
    totals = cut(bins.groupBy(*key).agg(*[F.sum(c).alias(c) for c in sums]))
    n = F.col("n_y")
    defined = (n >= 2) & (F.col("n_p") > 0) & (F.col("odd") == 0)
    err = lambda c: F.when(F.col("n_e") > 0, F.col(c))
    out = {"r2": _ratio(err("e2"), F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / n, F.lit(0.0)), defined)}
    if "d2_absolute_error" in names:
        medians = _medians(rows, bins, totals, seeds)
        off = F.col("median") - _of_group(centre)             # sums of y are kept as distances from the centre
        outside = F.when(F.col("_bin") < F.col("first"), F.col("_w") * off - F.col("s1")).when(
            F.col("_bin") > F.col("last"), F.col("s1") - F.col("_w") * off)
        far = bins.filter("_bin >= 0").join(medians, key).groupBy(*key).agg(
            (F.coalesce(F.sum(outside), F.lit(0.0)) + F.first("inside")).alias("spread"))
        out["d2_absolute_error"] = _ratio(err("e1"), F.col("spread"), defined)
        totals = totals.join(far, key, "left")
    return totals.select("_g", "bootstrap_seed", *[out[k].alias(k) for k in names]).join(F.broadcast(numbers), "_g").drop("_g")


# --------------------------------------------------------------------------
# pairs in order


def _bucket_pairs(seeds: Sequence[int]):
    """Map the rows (_g, _at, _s, is_pos, _id) of one bucket to its sums and ordered pairs by seed."""

    def run(table: pa.Table) -> pa.Table:
        s, pos, ids = (table.column(c).to_numpy() for c in ("_s", "is_pos", "_id"))
        order = np.argsort(s, kind="stable")
        s, pos, ids = s[order], pos[order], ids[order]
        k = len(seeds)
        won, lose, p_all, tail = np.zeros(k), np.zeros(k), np.zeros(k), None      # tail: value, pos, neg of the last level
        for a in range(0, len(s), 8192):
            own = s[a:a + 8192]
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            w = poisson_weights(ids[a:a + 8192], seeds).astype(float)
            up = pos[a:a + 8192].astype(float)
            p, n = np.add.reduceat(w * up, starts, axis=1), np.add.reduceat(w * (1 - up), starts, axis=1)
            if tail is not None:
                if tail[0] == own[0]:
                    p[:, 0] += tail[1]
                    n[:, 0] += tail[2]
                else:
                    won += tail[1] * (lose + tail[2] / 2)
                    lose += tail[2]
                    p_all += tail[1]
            tail = (own[-1], p[:, -1].copy(), n[:, -1].copy())
            p, n = p[:, :-1], n[:, :-1]
            before = lose[:, None] + np.cumsum(n, axis=1) - n
            won += (p * (before + n / 2)).sum(axis=1)
            lose += n.sum(axis=1)
            p_all += p.sum(axis=1)
        won += tail[1] * (lose + tail[2] / 2)
        lose += tail[2]
        p_all += tail[1]
        g, at = table.column("_g")[0].as_py(), table.column("_at")[0].as_py()
        return pa.table({"_g": pa.array([g] * k, pa.int32()), "bootstrap_seed": pa.array(list(seeds), pa.int32()),
                         "_at": pa.array([at] * k, pa.int32()), "p": p_all, "n": lose, "won": won})

    return run


def _auc(df: DataFrame, by: Sequence[str], score: Column, seeds: Sequence[int]) -> DataFrame | None:
    """(by..., bootstrap_seed, roc_auc) for the groups with labelled rows; a missing score is below every other."""
    rows = df.filter("y IS NOT NULL").select(*by, "row_id", score.alias("_s"), (F.col("y") == 1).cast("long").alias("is_pos"))
    probs = F.array(*[F.lit(i / BUCKETS) for i in range(1, BUCKETS)])
    given = _numbered(rows, by, [F.percentile_approx("_s", probs, F.lit(4 * BUCKETS)).alias("_q")])
    if given is None:
        return None
    facts, numbers, rows = given
    cuts, hot = [], []
    for r in facts:
        step = max(1, BUCKETS // max(1, min(BUCKETS, r["_n"] // BUCKET_ROWS)))
        chosen = (r["_q"] or [])[step - 1::step] if step < BUCKETS else []
        values, times = np.unique(np.array(chosen, float), return_counts=True)
        cuts.append(values)
        hot.append(values[times > 1])

    def place(batches):
        for batch in batches:
            g, s = _numpy(batch, 0), batch.column(2)
            at, value = np.full(len(g), -1, np.int32), s.fill_null(0.0).to_numpy(zero_copy_only=False)
            level, known = ~s.is_valid().to_numpy(zero_copy_only=False), s.is_valid().to_numpy(zero_copy_only=False)
            for one in np.unique(g):
                mine = np.flatnonzero((g == one) & known)
                at[mine] = 2 * np.searchsorted(cuts[one], value[mine], side="right")
                same = np.isin(value[mine], hot[one])
                at[mine[same]] -= 1
                level[mine[same]] = True
            yield pa.record_batch([batch.column(0), pa.array(at, pa.int32()), pa.array(value, pa.float64()), batch.column(3),
                                   batch.column(1), pa.array(level)], ["_g", "_at", "_s", "is_pos", "row_id", "level"])

    placed = rows.select("_g", F.coalesce(F.col("row_id").cast("long"), F.lit(0).cast("long")).alias("row_id"),
                         F.col("_s").cast("double").alias("_s"), "is_pos").mapInArrow(
        place, "_g int, _at int, _s double, is_pos long, row_id long, level boolean")
    each = "_g int, bootstrap_seed int, _at int, p double, n double, won double"
    parts = placed.filter("not level").select("_g", "_at", "_s", "is_pos", F.col("row_id").alias("_id")).groupBy("_g", "_at").applyInArrow(
        _bucket_pairs(list(seeds)), each)
    if any(len(h) for h in hot) or not rows.filter("_s IS NULL").isEmpty():
        levels = weighted_sums(placed.filter("level"), ["_g", "_at"], {"p": F.col("is_pos"), "n": 1 - F.col("is_pos")}, seeds)
        parts = parts.unionByName(levels.select("_g", "bootstrap_seed", "_at", "p", "n", (F.col("p") * F.col("n") / 2).alias("won")))
    before = W.partitionBy("_g", "bootstrap_seed").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    ordered = cut(parts).withColumn("won", F.col("won") + F.col("p") * F.coalesce(F.sum("n").over(before), F.lit(0.0)))
    pairs = F.sum("p") * F.sum("n")
    auc = ordered.groupBy("_g", "bootstrap_seed").agg(F.when(pairs > 0, F.sum("won") / pairs).alias("roc_auc"))
    return auc.join(F.broadcast(numbers), "_g").drop("_g")


# --------------------------------------------------------------------------
# means


def _means(df: DataFrame, by: Sequence[str], log_p: Column | None, hit: Column | None, n_classes: int | None, seeds: Sequence[int]) -> DataFrame | None:
    """(by..., bootstrap_seed, mean_log, balanced_accuracy): mean log probability, mean recall where every class occurs."""
    given = _numbered(df, by, [])
    if given is None:
        return None
    _, numbers, rows = given
    hit = F.lit(None).cast("boolean") if hit is None else hit
    log_p = F.lit(None).cast("double") if log_p is None else log_p
    rows = rows.select("_g", "row_id", F.coalesce(F.col("y").cast("long"), F.lit(-1).cast("long")).alias("_c"), hit.alias("hit"), log_p.alias("l"))
    sums = cut(weighted_sums(rows, ["_g", "_c"], {"n_l": F.col("l").isNotNull(), "l": F.col("l"), "n_h": F.col("hit").isNotNull(), "h": F.col("hit")}, seeds))
    recall = F.when(F.col("n_h") > 0, F.col("h") / F.col("n_h"))
    out = sums.groupBy("_g", "bootstrap_seed").agg(
        F.when(F.sum("n_l") > 0, F.sum("l") / F.sum("n_l")).alias("mean_log"),
        F.when(F.count(recall) == (n_classes or -1), F.avg(recall)).alias("balanced_accuracy"))
    return out.join(F.broadcast(numbers), "_g").drop("_g")


METRICS = {"r2", "d2_absolute_error", "roc_auc", "balanced_accuracy", "log_loss", "neg_log_loss"}


def scores(rows: DataFrame, by: Sequence[str], names: Sequence[str], seeds: Sequence[int | None], n_classes: int | None,
           log_p: Column | None = None, hit: Column | None = None, score: Column | None = None) -> DataFrame | None:
    """Long score table (by..., bootstrap_seed, metric, score) of the Poisson bootstrap; None for too many groups.

    ``rows`` has row_id, y, pred and the columns ``by``. ``log_p`` is the log probability of the true class,
    ``hit`` tells whether the class is the guessed one, ``score`` is what pairs are ordered by.
    """
    by, names = list(by), list(dict.fromkeys(names))
    drawn = [FULL if s is None else s for s in seeds]
    tables = []
    errors = [n for n in names if n in ("r2", "d2_absolute_error")]
    if errors:
        wide = _errors(rows.withColumns({"y": F.col("y").cast("double"), "pred": F.col("pred").cast("double")}), by, errors, drawn)
        if wide is None:
            return None
        tables.append(wide.unpivot([*by, "bootstrap_seed"], errors, "metric", "score"))
    means = [n for n in names if n in ("log_loss", "neg_log_loss", "balanced_accuracy")]
    if means or "roc_auc" in names:
        wide = _means(rows, by, log_p, hit if "balanced_accuracy" in names else None, n_classes, drawn)
        auc = _auc(rows, by, score, drawn) if "roc_auc" in names else None
        if wide is None or (auc is None and "roc_auc" in names):
            return None
        if auc is not None:
            wide = ranks.join_same(wide, auc, [*by, "bootstrap_seed"], "left")
        wide = wide.withColumns({"neg_log_loss": F.col("mean_log"), "log_loss": -F.col("mean_log")})
        tables.append(wide.unpivot([*by, "bootstrap_seed"], [n for n in names if n not in errors], "metric", "score"))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
