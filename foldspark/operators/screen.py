"""Single-feature screening: all features in one long table, never a loop over columns.

A long row is (row_id, feature, x, y...). Fits per (feature, evaluated fold)
come from sufficient statistics: total minus the fold's own share. Trees look
at distinct values only, so their cost follows the levels of a feature.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.pvalue import pearson_pvalue
from ..functions.scalar import nan_to_null, sigmoid
from ..session import cut
from . import prep, ranks
from .resample import FULL, resample


def long_features(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ("row_id", "y")) -> DataFrame:
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(keep), list(cols), "feature", "x")


# --------------------------------------------------------------------------
# correlation


def pearson(long: DataFrame, seeds: Sequence[int | None] = (None,), classes: Sequence[int] | None = None,
            with_pvalue: bool = True, method: str = "exact") -> DataFrame:
    """(feature, label_code, bootstrap_seed, r, n, pvalue); more than two classes go one against the rest.

    Missing x drop out before resampling.
    """
    rows = resample(long.filter(F.col("x").isNotNull()), ["feature"], list(seeds), method)
    codes = [None] if classes is None or len(classes) <= 2 else list(classes)
    y = F.col("y").cast("double")
    target = [y if k is None else (F.col("y") == k).cast("double") for k in codes]
    n = F.count(F.lit(1)).alias("n")
    wide = rows.groupBy("feature", "bootstrap_seed").agg(
        n, *[nan_to_null(F.corr("x", t)).alias(f"r{i}") for i, t in enumerate(target)])
    cells = F.explode(F.array(*[F.struct(F.lit(k).cast("int").alias("k"), F.col(f"r{i}").alias("r"))
                                for i, k in enumerate(codes)]))
    out = wide.select("feature", F.when(F.col("bootstrap_seed") != FULL, F.col("bootstrap_seed")).alias("bootstrap_seed"),
                      "n", cells.alias("c")).select("feature", F.col("c.k").alias("label_code"), "bootstrap_seed",
                                                    F.col("c.r").alias("r"), "n")
    if with_pvalue:
        out = out.withColumn("pvalue", pearson_pvalue(F.col("r"), F.col("n")))
    return out


# --------------------------------------------------------------------------
# line through one feature, out of fold

LINE_SUMS = ("n", "sx", "sy", "sxx", "sxy", "nm", "sm")


def line_params(long: DataFrame, fold: str = "cv_fold") -> DataFrame:
    """(feature, fold, x0, slope, level, missing_level): least squares on the other folds.

    A missing value has an indicator of its own, so its level is the mean
    target of missing rows; without any in training it sits at the mean x.
    """
    centre = ranks.fit_small(long.groupBy("feature").agg(F.coalesce(F.avg("x"), F.lit(0.0)).alias("cx"),
                                                         F.avg("y").alias("cy")))
    d = long.join(centre, "feature")
    x, y = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    has = F.col("x").isNotNull()
    sums = {"n": F.count(F.when(has, 1)), "sx": F.sum(x), "sy": F.sum(F.when(has, y)), "sxx": F.sum(x * x),
            "sxy": F.sum(x * y), "nm": F.count(F.when(~has, 1)), "sm": F.sum(F.when(~has, y))}
    per = d.groupBy("feature", fold, "cx", "cy").agg(*[F.coalesce(s, F.lit(0)).alias(k) for k, s in sums.items()])
    all_folds = W.partitionBy("feature")
    rest = per.select("feature", fold, "cx", "cy", *[(F.sum(k).over(all_folds) - F.col(k)).alias(k) for k in sums])
    return _line_of(rest, fold)


def _line_of(rest: DataFrame, fold: str) -> DataFrame:
    """The lines from the sums (n, sx, sy, sxx, sxy, nm, sm) of the training rows, as distances from (cx, cy)."""
    n = F.nullif("n", F.lit(0))                            # no value outside the fold: the missing rows' mean, a flat line
    mx, my = F.col("sx") / n, F.col("sy") / n
    missing = F.col("cy") + F.col("sm") / F.nullif("nm", F.lit(0))
    sxx = F.col("sxx") - n * mx * mx
    slope = F.when(sxx > 0, (F.col("sxy") - n * mx * my) / sxx).otherwise(0.0)
    return rest.select("feature", fold, F.coalesce(F.col("cx") + mx, "cx").alias("x0"), F.coalesce(slope, F.lit(0.0)).alias("slope"),
                       F.coalesce(F.col("cy") + my, missing).alias("level"),
                       F.coalesce(missing, F.col("cy") + my).alias("missing_level"))


def line_predictions(long: DataFrame, fold: str = "cv_fold") -> DataFrame:
    """Out-of-fold predictions (row_id, feature, y, pred)."""
    params = ranks.fit_small(line_params(long, fold))
    value = F.when(F.col("x").isNull(), F.col("missing_level")).otherwise(
        F.col("level") + F.col("slope") * (F.col("x") - F.col("x0")))
    return long.join(params, ["feature", fold]).select("row_id", "feature", fold, "y", value.alias("pred"))


def cross_line_predictions(long: DataFrame, kind: str, n_folds: int = 5, fold: str = "cv_fold") -> DataFrame:
    """Out-of-fold predictions (row_id, feature, y, pred) of lines on a quantile transform refitted for every fold.

    A row is transformed once for every fold inside a batch, which leaves the sums of the
    folds it trains, and once more by its own fold's knots for its prediction.
    """
    knots = long.sparkSession.sparkContext.broadcast(prep.cross_knots(long, n_folds, fold))
    centre = 0.5 if kind == "quantile_uniform" else 0.0
    means = {r["feature"]: r["m"] for r in long.groupBy("feature").agg(F.avg("y").alias("m")).collect()}

    def moved(x, feature, f):
        q = knots.value.get((feature, f))
        return np.full(len(x), np.nan) if q is None else prep.between_knots(x, q, kind)

    def add(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            names, x, y, own = batch.column(0).to_pandas(), *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            for feature, at in names.groupby(names).indices.items():
                xs, ys, fs = x[at], y[at] - (means[feature] or 0.0), own[at]
                known_y = ~np.isnan(ys)
                for f in range(n_folds):
                    z, out = moved(xs, feature, f), fs != f
                    has = out & ~np.isnan(z)
                    both, lost = has & known_y, out & np.isnan(z)
                    d, e = z[has] - centre, z[both] - centre
                    s = np.array([has.sum(), d.sum(), ys[both].sum(), (d * d).sum(), (e * ys[both]).sum(), lost.sum(), ys[lost & known_y].sum()])
                    held[feature, f] = held.get((feature, f), 0.0) + s
        if held:
            yield pa.record_batch([pa.array([k[0] for k in held]), pa.array([k[1] for k in held], pa.int32()),
                                   *np.stack(list(held.values())).T], ["feature", fold, *LINE_SUMS])

    rows = long.filter(F.col(fold).isNotNull()).select("feature", "x", F.col("y").cast("double").alias("y"), F.col(fold).cast("int").alias(fold), "row_id")
    sums = rows.mapInArrow(add, f"feature string, {fold} int, " + ", ".join(f"{k} double" for k in LINE_SUMS)).groupBy("feature", fold).agg(
        *[F.sum(k).alias(k) for k in LINE_SUMS]).collect()
    whole = long.sparkSession.createDataFrame([(r["feature"], r[fold], centre, means[r["feature"]], *[r[k] for k in LINE_SUMS]) for r in sums],
                                              f"feature string, {fold} int, cx double, cy double, " + ", ".join(f"{k} double" for k in LINE_SUMS))
    lines = {(r["feature"], r[fold]): r for r in _line_of(whole, fold).collect()}

    def value(r, z):
        none = lambda v: np.nan if v is None else v
        line = none(r["level"]) + none(r["slope"]) * (z - none(r["x0"]))
        return np.where(np.isnan(z), none(r["missing_level"]), line)

    def predict(batches):
        for batch in batches:
            names, x, own = batch.column(0).to_pandas(), *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 3))
            pred = np.full(len(x), np.nan)
            for feature, at in names.groupby(names).indices.items():
                for f in np.unique(own[at]):
                    mine = at[own[at] == f]
                    if (feature, int(f)) in lines:
                        pred[mine] = value(lines[feature, int(f)], moved(x[mine], feature, int(f)))
            yield pa.record_batch([batch.column(4), batch.column(0), batch.column(2), pa.array(pred, pa.float64(), mask=np.isnan(pred))],
                                  ["row_id", "feature", "y", "pred"])

    return rows.mapInArrow(predict, T.StructType([long.schema["row_id"], *[rows.schema[c] for c in ("feature", "y")], T.StructField("pred", T.DoubleType())]))


def logistic_params(long: DataFrame, n_folds: int = 5, steps: int = 8, fold: str = "cv_fold") -> DataFrame:
    """(feature, fold, mu, sd, a, b, missing_logit): unpenalised one-feature logistic fits.

    Every Newton step is one aggregate over the long table that serves all
    features and all folds; the parameters are a few numbers per feature.
    """
    folds = range(n_folds)
    has = F.col("x").isNotNull()

    def but(f: int, c: Column) -> Column:
        return F.when(F.col(fold) != f, c)

    first = []
    for f in folds:
        first += [F.avg(but(f, F.col("x"))).alias(f"mu{f}"), F.stddev_pop(but(f, F.col("x"))).alias(f"sd{f}"),
                  F.avg(but(f, F.when(has, F.col("y")))).alias(f"p{f}"),
                  F.avg(but(f, F.when(~has, F.col("y")))).alias(f"q{f}")]
    base = {r["feature"]: r for r in long.groupBy("feature").agg(*first).collect()}

    def logit(p: float | None, other: float) -> float:
        p = other if p is None else p
        p = min(max(p, 1e-9), 1 - 1e-9)
        return float(np.log(p / (1 - p)))

    long = long.persist()      # read once per Newton step; lost blocks are recomputed
    state = {(c, f): [logit(r[f"p{f}"], 0.5), 0.0] for c, r in base.items() for f in folds}
    spark = long.sparkSession
    for _ in range(steps):
        rows = [(c, [base[c][f"mu{f}"] or 0.0 for f in folds], [base[c][f"sd{f}"] or 1.0 for f in folds],
                 [state[c, f][0] for f in folds], [state[c, f][1] for f in folds]) for c in base]
        now = F.broadcast(spark.createDataFrame(
            rows, "feature string, mu array<double>, sd array<double>, a array<double>, b array<double>"))
        d = long.filter(has).join(now, "feature")
        aggs = []
        for f in folds:
            at = F.lit(f)
            z = (F.col("x") - F.get("mu", at)) / F.get("sd", at)
            p = sigmoid(F.get("a", at) + F.get("b", at) * z)
            w, r = p * (1 - p), F.col("y") - p
            for name, c in (("r0", r), ("r1", r * z), ("w0", w), ("w1", w * z), ("w2", w * z * z)):
                aggs.append(F.sum(but(f, c)).alias(f"{name}_{f}"))
        for r in d.groupBy("feature").agg(*aggs).collect():
            for f in folds:
                r0, r1, w0, w1, w2 = (r[f"{k}_{f}"] or 0.0 for k in ("r0", "r1", "w0", "w1", "w2"))
                step = np.linalg.lstsq(np.array([[w0, w1], [w1, w2]]), np.array([r0, r1]), rcond=None)[0]
                step = np.clip(step, -5.0, 5.0)
                state[r["feature"], f][0] += float(step[0])
                state[r["feature"], f][1] += float(step[1])
    long.unpersist()
    out = [(c, f, base[c][f"mu{f}"] or 0.0, base[c][f"sd{f}"] or 1.0, *state[c, f],
            logit(base[c][f"q{f}"], base[c][f"p{f}"] or 0.5)) for c in base for f in folds]
    return spark.createDataFrame(
        out, f"feature string, {fold} int, mu double, sd double, a double, b double, missing_logit double")


def logistic_predictions(long: DataFrame, n_folds: int = 5, fold: str = "cv_fold") -> DataFrame:
    params = F.broadcast(logistic_params(long, n_folds, fold=fold))
    value = F.when(F.col("x").isNull(), F.col("missing_logit")).otherwise(
        F.col("a") + F.col("b") * (F.col("x") - F.col("mu")) / F.col("sd"))
    return long.join(params, ["feature", fold]).select("row_id", "feature", fold, "y", value.alias("pred"))


# --------------------------------------------------------------------------
# trees of one feature


def fold_levels(long: DataFrame, sums: Sequence[Column], n_folds: int = 5, fold: str = "cv_fold") -> DataFrame:
    """Levels (feature, eval_fold, x, m, n, s0, s1...) of the training rows of each evaluated fold.

    Rows collapse to distinct values per fold first; only those levels are
    copied to the folds they train. A missing x takes the training mean and
    the flag m = 1, as a second feature the tree may split on.
    """
    k = len(sums)
    per = cut(long.groupBy("feature", fold, "x").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(f"s{i}") for i, s in enumerate(sums)]))
    others = F.filter(F.array(*[F.lit(f) for f in range(n_folds)]), lambda f: f != F.col(fold))
    spread = per.withColumn("eval_fold", F.explode(others))
    mean = ranks.fit_small(
        spread.filter(F.col("x").isNotNull()).groupBy("feature", "eval_fold")
        .agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mx")))
    filled = spread.join(mean, ["feature", "eval_fold"], "left")
    return filled.groupBy("feature", "eval_fold", F.coalesce("x", "mx", F.lit(0.0)).alias("x"),
                          F.col("x").isNull().cast("int").alias("m")).agg(
        F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])


def best_splits(levels: DataFrame, parts: Sequence[str], k: int = 1) -> DataFrame:
    """Best split per part: (parts..., on_m, thr, gain).

    Gain is the drop of the summed squared error (of Gini impurity for class
    sums). Thresholds lie midway between neighbouring values; the lowest
    threshold wins ties, and the missing flag only wins when strictly better.
    """
    parts = list(parts)
    names = [f"s{i}" for i in range(k)]
    by_x = levels.groupBy(*parts, "x").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names])
    cum = ranks.running_sums(by_x, parts, "x", ["n", *names])
    totals = ranks.fit_small(levels.groupBy(*parts).agg(F.sum("n").alias("tn"), *[F.sum(s).alias(f"t{s}") for s in names],
                                       F.sum(F.when(F.col("m") == 0, F.col("n"))).alias("mn"),
                                       *[F.sum(F.when(F.col("m") == 0, F.col(s))).alias(f"m{s}") for s in names]))

    def gain(n_left: Column, left: Sequence[Column]) -> Column:
        n_right = F.col("tn") - n_left
        out = F.lit(0.0)
        for s, l in zip(names, left):
            r = F.col(f"t{s}") - l
            out = out + l * l / n_left + r * r / n_right - F.col(f"t{s}") * F.col(f"t{s}") / F.col("tn")
        return F.when((n_left > 0) & (n_right > 0), out)

    joined = cum.join(totals, parts)
    scored = joined.select(*parts, "x", gain(F.nullif("cum_n", F.lit(0)), [F.col(f"cum_{s}") for s in names]).alias("gain"))
    top = scored.filter(F.col("gain").isNotNull()).groupBy(*parts).agg(
        F.max(F.struct("gain", (-F.col("x")).alias("nx"))).alias("b"))
    top = top.select(*parts, F.col("b.gain").alias("gain"), (-F.col("b.nx")).alias("x"))
    following = by_x.select(*parts, F.col("x").alias("_x2")).join(ranks.fit_small(top), parts).filter("_x2 > x")
    midway = following.groupBy(*parts, "gain", "x").agg(F.min("_x2").alias("_x2")).select(
        *parts, F.lit(False).alias("on_m"), ((F.col("x") + F.col("_x2")) / 2).alias("thr"), "gain")
    flag = totals.filter("mn < tn and mn > 0").select(
        *parts, F.lit(True).alias("on_m"), F.lit(0.5).alias("thr"),
        gain(F.nullif("mn", F.lit(0)), [F.col(f"m{s}") for s in names]).alias("gain"))
    both = midway.unionByName(flag).filter("gain > 1e-12")
    pick = both.groupBy(*parts).agg(F.max(F.struct("gain", (~F.col("on_m")).alias("first"), "thr", "on_m")).alias("b"))
    return pick.select(*parts, "b.on_m", "b.thr", "b.gain")


def _side(on_m: str, thr: str) -> Column:
    """0 left, 1 right, 0 where there is no split."""
    right = F.when(F.col(on_m), F.col("m") == 1).otherwise(F.col("x") > F.col(thr))
    return F.coalesce(right, F.lit(False)).cast("int")


def tree_predictions(long: DataFrame, sums: Sequence[Column], max_leaves: int = 2, n_folds: int = 5,
                     fold: str = "cv_fold") -> DataFrame:
    """Out-of-fold leaf means (row_id, feature, y, leaf means array) of a tree with two or three leaves."""
    if max_leaves not in (2, 3):
        raise ValueError("screening trees have two or three leaves")
    k, parts = len(sums), ["feature", "eval_fold"]
    # one pass over the rows; every later step reads the levels, from reliable storage
    levels = cut(fold_levels(long, sums, n_folds, fold))
    root = ranks.fit_small(best_splits(levels, parts, k).select(
        *parts, F.col("on_m").alias("m0"), F.col("thr").alias("t0")))
    sided = levels.join(root, parts, "left").withColumn("side", _side("m0", "t0"))
    splits = root
    if max_leaves == 3:
        child = best_splits(sided.select(*parts, "side", "x", "m", "n", *[f"s{i}" for i in range(k)]), [*parts, "side"], k)
        best = child.groupBy(*parts).agg(F.max(F.struct("gain", (-F.col("side")).alias("first"), "side", "on_m", "thr")).alias("b"))
        second = best.select(*parts, F.col("b.side").alias("side1"), F.col("b.on_m").alias("m1"), F.col("b.thr").alias("t1"))
        splits = ranks.fit_small(root.join(second, parts, "left"))

    def leaf(df: DataFrame) -> DataFrame:
        out = df.join(splits, parts, "left").withColumn("side", _side("m0", "t0"))
        if max_leaves == 3:
            deeper = F.when(F.col("side") == F.col("side1"), _side("m1", "t1")).otherwise(0)
            out = out.withColumn("leaf", F.col("side") * 2 + F.coalesce(deeper, F.lit(0)))
        else:
            out = out.withColumn("leaf", F.col("side"))
        return out

    means = ranks.fit_small(leaf(levels).groupBy(*parts, "leaf").agg(
        F.array(*[F.sum(f"s{i}") / F.sum("n") for i in range(k)]).alias("value")))
    centre = ranks.fit_small(levels.filter("m = 0").groupBy(*parts).agg(
        (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mx")))
    rows = long.withColumnRenamed(fold, "eval_fold").join(centre, parts, "left").withColumn(
        "m", F.col("x").isNull().cast("int")).withColumn("x", F.coalesce("x", "mx", F.lit(0.0)))
    return leaf(rows).join(means, [*parts, "leaf"], "left").select("row_id", "feature", "eval_fold", "y", "value")
