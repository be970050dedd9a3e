"""Feature preparation: fitted on training rows, applied to all rows.

Fitting reduces to per-feature numbers (moments, quantile knots) or to
vocabulary tables; applying is one projection, plus one join per
target-encoded feature. Features are fitted together: moments of all numeric
columns in one aggregate, quantiles of all of them in one long table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import normal
from ..functions.scalar import clip, symexp, symlog
from ..session import cut
from . import quantiles, ranks
from .splits import kfold, stratified_kfold

NUM_KINDS = ("identity", "standard", "robust", "quantile_uniform", "quantile_normal")
CAT_KINDS = ("one_hot_encoding", "target_encoding")
MAX_KNOTS = 1000
MIN_FREQUENCY = 10
TARGET_FOLDS = 25
DUMMY = "__dummy__"
#: One-hot positions of a feature that become dense columns; a wider one goes into the list of positions HOT.
DENSE_WIDTH = 64
HOT = "__hot__"


# --------------------------------------------------------------------------
# numeric features


@dataclass
class NumericFit:
    """Numbers of one fitted numeric feature."""

    kind: str
    mean: float | None = None
    sd: float | None = None
    n_missing: int = 0
    quartiles: list[float] | None = None
    knots: list[float] | None = None
    fill: float | None = None

    @property
    def dropped(self) -> bool:
        return self.mean is None

    def scaled(self, x: Column) -> Column:
        """The transform without imputation."""
        x = x.cast("double")
        if self.kind == "identity":
            return x
        if self.kind == "standard":
            return (x - F.lit(self.mean)) / F.lit(self.sd or 1.0)
        if self.kind == "robust":
            q1, med, q3 = self.quartiles
            return (x - F.lit(med)) / F.lit((q3 - q1) or 1.0)
        return empirical_cdf(x, self.knots, self.kind)

    def columns(self, name: str) -> list[Column]:
        if self.dropped:
            return []
        out = [F.coalesce(self.scaled(F.col(name)), F.lit(self.fill)).alias(name)]
        if self.n_missing:
            out.append(F.col(name).isNull().cast("double").alias(f"{name}__missing"))
        return out


def knot_probs(n_rows: int) -> list[float]:
    k = max(1, min(MAX_KNOTS, n_rows))
    return [0.0] if k == 1 else [i / (k - 1) for i in range(k)]


def empirical_cdf(x: Column, knots: Sequence[float], kind: str = "quantile_uniform") -> Column:
    """Interpolated distribution function, or the normal score of it.

    A repeated knot gets the middle of its range of references.
    """
    q = np.asarray(knots, dtype=float)
    refs = np.linspace(0.0, 1.0, len(q))
    edge = normal.NORMAL_TAIL if kind == "quantile_normal" else 0.0

    @F.pandas_udf("double")
    def look_up(values: pd.Series) -> pd.Series:
        v = values.to_numpy(dtype=float, na_value=np.nan)
        out = 0.5 * (np.interp(v, q, refs) - np.interp(-v, -q[::-1], -refs[::-1]))
        out[v + edge > q[-1] if edge else v == q[-1]] = 1.0
        out[v - edge < q[0] if edge else v == q[0]] = 0.0
        if kind == "quantile_normal":
            out = normal.ppf(out)
        return pd.Series(out).where(~np.isnan(v), None)

    return look_up(x)


def between_knots(w: np.ndarray, q: np.ndarray, kind: str) -> np.ndarray:
    """``empirical_cdf`` of an array; NaN stays NaN."""
    edge = normal.NORMAL_TAIL if kind == "quantile_normal" else 0.0
    refs = np.linspace(0.0, 1.0, len(q))
    u = 0.5 * (np.interp(w, q, refs) - np.interp(-w, -q[::-1], -refs[::-1]))
    u[w + edge > q[-1] if edge else w == q[-1]] = 1.0
    u[w - edge < q[0] if edge else w == q[0]] = 0.0
    return normal.ppf(u) if kind == "quantile_normal" else u


def empirical_cdf_by_key(x: Column, key: Column, knots: Mapping[str, Sequence[float]],
                         kind: str = "quantile_uniform") -> Column:
    """``empirical_cdf`` where each row names its own knot list."""
    tables = {k: np.asarray(v, dtype=float) for k, v in knots.items()}

    @F.pandas_udf("double")
    def look_up(values: pd.Series, keys: pd.Series) -> pd.Series:
        v = values.to_numpy(dtype=float, na_value=np.nan)
        out = np.full(len(v), np.nan)
        for k, at in keys.groupby(keys).indices.items():
            if k not in tables:                            # no value outside the fold: nothing to compare with
                continue
            out[at] = between_knots(v[at], tables[k], kind)
        return pd.Series(out).where(~np.isnan(out), None)

    return look_up(x, key)


def cross_quantiles(long: DataFrame, kind: str, n_folds: int, fold: str = "cv_fold") -> DataFrame:
    """Copies (feature, eval_fold, ...) of a long table whose x is the quantile transform
    fitted on the rows outside the evaluated fold: one quantile job for all features and folds."""
    spread = long.withColumn("eval_fold", F.explode(F.array(*[F.lit(f) for f in range(n_folds)])))
    key = F.concat_ws("|", "feature", F.col("eval_fold").cast("string"))
    knots = {f"{c}|{f}": list(q) for (c, f), q in cross_knots(long, n_folds, fold).items()}
    return spread.withColumn("x", empirical_cdf_by_key(F.col("x"), key, knots, kind))


def cross_knots(long: DataFrame, n_folds: int, fold: str = "cv_fold") -> dict[tuple[str, int], np.ndarray]:
    """(feature, fold) -> knots of the rows outside the fold, where these hold a value; no row is copied."""
    sizes = long.filter(F.col(fold).isNotNull()).groupBy("feature", fold).agg(F.count(F.lit(1)).alias("n")).collect()
    total: dict[str, int] = {}
    for r in sizes:
        total[r["feature"]] = total.get(r["feature"], 0) + r["n"]
    own = {(r["feature"], r[fold]): r["n"] for r in sizes}
    n = min((m for m in (t - own.get((c, f), 0) for c, t in total.items() for f in range(n_folds)) if m), default=1)
    got = quantiles.held_out(long, ["feature"], "x", knot_probs(n), fold=fold, n_folds=n_folds)
    if got is not None:
        return {k: np.array(q, float) for k, q in got.items()}
    spread = long.withColumn("eval_fold", F.explode(F.array(*[F.lit(f) for f in range(n_folds)]))).filter(F.col(fold) != F.col("eval_fold"))
    return {(r["feature"], r["eval_fold"]): np.array(r["q"], float)
            for r in ranks.exact_quantiles(spread, ["feature", "eval_fold"], "x", knot_probs(n)).collect()}


def from_quantile(z: Column, knots: Sequence[float], kind: str) -> Column:
    """Inverse of ``empirical_cdf``."""
    q = np.asarray(knots, dtype=float)
    refs = np.linspace(0.0, 1.0, len(q))

    @F.pandas_udf("double")
    def back(values: pd.Series) -> pd.Series:
        v = values.to_numpy(dtype=float, na_value=np.nan)
        u = normal.cdf(v) if kind == "quantile_normal" else v
        return pd.Series(np.interp(u, refs, q)).where(~np.isnan(v), None)

    return back(z)


def feature_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                      by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, q): quantiles of many columns from one long table."""
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(by), list(cols), "feature", "value")
    return ranks.exact_quantiles(long, [*by, "feature"], "value", probs)


def cross_feature_knots(rows: DataFrame, cols: Sequence[str], n_folds: int, fold: str = "cv_fold") -> dict[int, dict[str, list[float]]]:
    """Fold -> column -> knots of the rows outside the fold, all from the same passes; empty where they are fitted one by one."""
    sizes = [r["n"] for r in rows.filter(F.col(fold).isNotNull()).groupBy(fold).agg(F.count(F.lit(1)).alias("n")).collect()]
    if not cols or not sizes or sum(sizes) - max(sizes) < MAX_KNOTS:
        return {}
    long = rows.select(fold, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot([fold], list(cols), "feature", "value")
    got = quantiles.held_out(long, ["feature"], "value", knot_probs(MAX_KNOTS), fold=fold, n_folds=n_folds)
    out: dict[int, dict[str, list[float]]] = {}
    for (c, f), q in (got or {}).items():
        out.setdefault(f, {})[c] = q
    return out


def fit_numeric(train: DataFrame, kinds: Mapping[str, str], knots: Mapping[str, Sequence[float]] | None = None) -> dict[str, NumericFit]:
    """Fit all numeric features; columns without any value are dropped. ``knots`` of quantile transforms may be given."""
    if not kinds:
        return {}
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in kinds:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_pop(x).alias(f"s_{c}"), F.count(x).alias(f"n_{c}")]
    row = train.agg(*aggs).first()
    n = row["_n"]
    fits = {c: NumericFit(k, row[f"m_{c}"], row[f"s_{c}"], n - row[f"n_{c}"]) for c, k in kinds.items()}
    robust = [c for c, k in kinds.items() if k == "robust" and not fits[c].dropped]
    quant = [c for c, k in kinds.items() if k.startswith("quantile") and not fits[c].dropped]
    for c in quant if knots and set(quant) <= set(knots) else []:
        fits[c].knots = list(knots[c])
    for cols, probs, slot in ((robust, [0.25, 0.5, 0.75], "quartiles"), ([c for c in quant if fits[c].knots is None], knot_probs(n), "knots")):
        if cols:
            for r in feature_quantiles(train, cols, probs).collect():
                setattr(fits[r["feature"]], slot, list(r["q"]))
    for c, f in fits.items():
        if f.kind == "identity":
            f.fill = f.mean
        elif f.kind == "standard":
            f.fill = 0.0
        elif f.kind == "robust" and not f.dropped:
            q1, med, q3 = f.quartiles
            f.fill = (f.mean - med) / ((q3 - q1) or 1.0)
    unknown = [c for c in quant if fits[c].n_missing]
    if unknown:
        means = train.agg(*[F.avg(fits[c].scaled(F.col(c))).alias(c) for c in unknown]).first()
        for c in unknown:
            fits[c].fill = means[c]
    for c in quant:
        fits[c].fill = fits[c].fill if fits[c].fill is not None else 0.0
    return fits


# --------------------------------------------------------------------------
# categories


def category_counts(train: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, category, n), missing as its own NULL category."""
    long = train.select(*by, *cols).unpivot(list(by), list(cols), "feature", "category")
    return long.groupBy(*by, "feature", "category").agg(F.count(F.lit(1)).alias("n"))


def one_hot_vocab(train: DataFrame, cols: Sequence[str], min_frequency: int = MIN_FREQUENCY,
                  drop: str | None = "if_binary") -> DataFrame:
    """(feature, category, n, is_frequent, idx): output position of each category.

    Frequent categories stand in sort order with missing last; all infrequent
    ones share the position after them. With ``if_binary`` the first of exactly
    two positions is dropped (idx -1), with ``first`` always.
    """
    counts = category_counts(train, cols).withColumn("is_frequent", F.col("n") >= min_frequency)
    feature = W.partitionBy("feature")
    frequent = counts.filter("is_frequent").withColumn(
        "pos", F.row_number().over(feature.orderBy(F.col("category").asc_nulls_last())) - 1)
    sizes = counts.groupBy("feature").agg(
        F.sum(F.col("is_frequent").cast("int")).alias("n_frequent"),
        F.max((~F.col("is_frequent")).cast("int")).alias("has_infrequent"))
    placed = frequent.unionByName(counts.filter("not is_frequent").withColumn("pos", F.lit(None).cast("int")))
    width = F.col("n_frequent") + F.col("has_infrequent")
    cut = F.when((width == 2) & F.lit(drop == "if_binary") | F.lit(drop == "first"), 1).otherwise(0)
    return placed.join(ranks.fit_small(sizes), "feature").select(
        "feature", "category", "n", "is_frequent",
        (F.coalesce("pos", "n_frequent") - cut).cast("int").alias("idx"),
        (width - cut).cast("int").alias("width"))


def one_hot_width(counts: DataFrame, min_frequency: int = MIN_FREQUENCY, drop: str | None = "if_binary") -> DataFrame:
    """Number of one-hot columns per feature from a category count table."""
    frequent = F.sum((F.col("n") >= min_frequency).cast("int"))
    rare = F.max((F.col("n") < min_frequency).cast("int"))
    total = F.col("total")
    less = F.when((F.lit(drop == "first")) | ((total == 2) & F.lit(drop == "if_binary")), 1).otherwise(0)
    return counts.groupBy("feature").agg((frequent + rare).alias("total")).select(
        "feature", (total - less).cast("int").alias("width"))


def one_hot_index(df: DataFrame, vocab: DataFrame, col: str) -> DataFrame:
    """Add ``<col>__idx``: the position that is one, NULL for all zeros (dropped or unknown).

    A category unseen in training takes the infrequent position when there is one.
    """
    mine = vocab.filter(F.col("feature") == col)
    rare = mine.filter("not is_frequent").agg(F.max("idx").alias("i")).first()["i"]
    table = mine.filter("is_frequent").select(F.col("category").alias("_cat"), F.col("idx").alias("_idx"))
    joined = df.join(ranks.fit_small(table), F.col(col).eqNullSafe(F.col("_cat")), "left")
    idx = F.coalesce("_idx", F.lit(rare).cast("int"))
    return joined.withColumn(f"{col}__idx", F.when(idx >= 0, idx)).drop("_cat", "_idx")


def choose_encoding(train: DataFrame, cols: Sequence[str], target_width: int = 1) -> DataFrame:
    """Target encoding where it is narrower than one-hot encoding."""
    widths = one_hot_width(category_counts(train, cols))
    kind = F.when(F.lit(target_width) < F.col("width"), "target_encoding").otherwise("one_hot_encoding")
    return widths.select("feature", "width", kind.alias("encoding"))


# --------------------------------------------------------------------------
# target encoding


def _with_encoding(df: DataFrame, centre: float) -> DataFrame:
    """Add ``enc``: empirical-Bayes blend of category mean and overall mean.

    Reads n, s1, s2 of the category and n0, s0, q0 of all rows (sums of centred
    y and of its square). The steps are separate projections, so generated code
    computes each once.
    """
    n, n0 = F.nullif("n", F.lit(0)), F.nullif("n0", F.lit(0))
    out = df.withColumns({"_mi": F.col("s1") / n, "_m0": F.col("s0") / n0})
    out = out.withColumns({
        "_vi": F.greatest(F.col("s2") / n - F.col("_mi") * F.col("_mi"), F.lit(0.0)),
        "_a": F.greatest(F.col("q0") / n0 - F.col("_m0") * F.col("_m0"), F.lit(0.0)) * n})
    out = out.withColumn("_w", F.col("_a") / F.nullif(F.col("_a") + F.col("_vi"), F.lit(0.0)))
    blend = F.col("_w") * F.col("_mi") + (1 - F.col("_w")) * F.col("_m0")
    return out.withColumn("enc", F.coalesce(blend, F.col("_m0")) + F.lit(centre))


@dataclass
class TargetFit:
    """Encoding tables of one feature and one target column."""

    col: str
    full: DataFrame             # (_cat, enc)
    crossed: DataFrame          # (_cat, fold, enc), encoding for training rows of the fold
    full_mean: float
    fold_means: dict[int, float] = field(default_factory=dict)


def fit_target(train: DataFrame, cols: Sequence[str], y: str = "y", fold: str = "te_fold") -> dict[str, TargetFit]:
    """Fit all features in two aggregates; ``fold`` numbers the cross-fitting folds of the training rows."""
    centre = train.agg(F.avg(y)).first()[0] or 0.0
    d = F.col(y) - F.lit(centre)
    long = train.select(fold, d.alias("d"), *cols).unpivot([fold, "d"], list(cols), "feature", "_cat")
    # the cells are the only thing read from the rows; both encodings and the totals come from them
    cells = cut(long.groupBy("feature", "_cat", fold).agg(
        F.count(F.lit(1)).alias("n"), F.sum("d").alias("s1"), F.sum(F.col("d") * F.col("d")).alias("s2")))
    totals = cells.filter(F.col("feature") == cols[0]).groupBy(fold).agg(
        *[F.sum(k).alias(k) for k in ("n", "s1", "s2")]).collect()
    n, s1, s2 = (sum(r[k] for r in totals) for k in ("n", "s1", "s2"))
    per_cat = cells.groupBy("feature", "_cat").agg(
        *[F.sum(k).alias(k) for k in ("n", "s1", "s2")],
        F.collect_list(F.struct(F.col(fold).alias("f"), "n", "s1", "s2")).alias("cells"))
    whole = per_cat.withColumns({"n0": F.lit(n), "s0": F.lit(s1), "q0": F.lit(s2)})
    full = _with_encoding(whole, centre).select("feature", "_cat", "enc")
    # complement of each fold, for the folds in which the category occurs (others never look it up)
    rest = F.broadcast(train.sparkSession.createDataFrame(
        [(r[fold], n - r["n"], s1 - r["s1"], s2 - r["s2"]) for r in totals], f"{fold} int, n0 long, s0 double, q0 double"))
    inside = per_cat.withColumn("c", F.explode("cells")).select(
        "feature", "_cat", F.col("c.f").alias(fold), (F.col("n") - F.col("c.n")).alias("n"),
        (F.col("s1") - F.col("c.s1")).alias("s1"), (F.col("s2") - F.col("c.s2")).alias("s2")).join(rest, fold)
    crossed = _with_encoding(inside, centre).select("feature", "_cat", fold, "enc")
    means = {r[fold]: (s1 - r["s1"]) / (n - r["n"]) + centre for r in totals if n > r["n"]}
    return {c: TargetFit(c, full.filter(F.col("feature") == c).drop("feature"),
                         crossed.filter(F.col("feature") == c).drop("feature"), s1 / n + centre, means)
            for c in cols}


def apply_target(df: DataFrame, fit: TargetFit, name: str | None = None, fold: str | None = None) -> DataFrame:
    """Add the encoding; with ``fold`` rows that have a fold number get the cross-fitted value."""
    name = name or f"{fit.col}__te"
    full = ranks.fit_small(fit.full.select(F.col("_cat").alias("_c1"), F.col("enc").alias("_e1")))
    out = df.join(full, F.col(fit.col).eqNullSafe(F.col("_c1")), "left").drop("_c1")
    value = F.coalesce("_e1", F.lit(fit.full_mean))
    if fold:
        crossed = ranks.fit_small(fit.crossed.select(
            F.col("_cat").alias("_c2"), F.col(fold).alias("_f2"), F.col("enc").alias("_e2")))
        out = out.join(crossed, F.col(fit.col).eqNullSafe(F.col("_c2")) & (F.col(fold) == F.col("_f2")), "left")
        value = F.when(F.col(fold).isNotNull(), F.col("_e2")).otherwise(value)
        out = out.withColumn(name, value).drop("_c2", "_f2", "_e2", "_e1")
    else:
        out = out.withColumn(name, value).drop("_e1")
    return out


def target_folds(train: DataFrame, label: str | None = None, seed: int = 0, k: int = TARGET_FOLDS,
                 to: DataFrame | None = None) -> DataFrame:
    """Cross-fitting folds of the training rows (or of ``to``, by them): stratified when a class label is given."""
    if label is None:
        return kfold(train, k, seed, "te_fold", to)
    return stratified_kfold(train, k, label, seed, "te_fold", to)


# --------------------------------------------------------------------------
# all features together


@dataclass
class FeatureSpace:
    """Fitted transforms of a dataset; ``apply`` yields ``features`` as numeric columns.

    One-hot features wider than ``DENSE_WIDTH`` share one column ``hot`` instead, the list
    of a row's positions below ``hot_width`` that are one. Their vocabularies stay tables.
    """

    numeric: dict[str, NumericFit]
    vocab: dict[str, list[tuple]]
    target: dict[str, list[TargetFit]]
    order: list[str]
    features: list[str] = field(default_factory=list)
    wide: DataFrame | None = None               # vocabularies of the wide features
    offsets: dict[str, int] = field(default_factory=dict)
    hot_width: int = 0

    @property
    def hot(self) -> str | None:
        return HOT if self.offsets else None

    def apply(self, df: DataFrame, keep: Sequence[str], fold: str | None = None) -> DataFrame:
        for c, fits in self.target.items():
            for j, fit in enumerate(fits):
                df = apply_target(df, fit, f"{c}__te{j}", fold)
        for c in self.offsets:
            df = one_hot_index(df, self.wide, c)
        cols: list[Column] = []
        for c in self.order:
            if c in self.offsets:
                continue
            if c in self.numeric:
                cols += self.numeric[c].columns(c)
            elif c in self.vocab:
                cols += one_hot_columns(c, self.vocab[c])
            else:
                cols += [F.col(f"{c}__te{j}") for j in range(len(self.target[c]))]
        cols.append(F.lit(0.0).alias(DUMMY))
        if self.offsets:
            places = F.array(*[F.col(f"{c}__idx") + at for c, at in self.offsets.items()])
            cols.append(F.filter(places, lambda i: i.isNotNull()).alias(HOT))
        out = df.select(*keep, *cols)
        self.features = [c for c in out.columns if c not in keep and c != HOT]
        return out

    def hot_names(self) -> DataFrame:
        """(position, feature, category) of the wide features; a NULL category with ``rare`` stands for all rare ones."""
        start = F.coalesce(*[F.when(F.col("feature") == c, at) for c, at in self.offsets.items()])
        named = self.wide.filter(F.col("feature").isin(list(self.offsets)) & (F.col("idx") >= 0)).withColumn("position", start + F.col("idx"))
        return named.filter("is_frequent").select("position", "feature", "category", F.lit(False).alias("rare")).unionByName(
            named.filter("not is_frequent").select("position", "feature", F.lit(None).cast("string").alias("category"), F.lit(True).alias("rare")).distinct())


def one_hot_columns(col: str, vocab: Sequence[tuple]) -> list[Column]:
    """0/1 columns of a feature from its (category, is_frequent, idx, width) rows."""
    if not vocab:
        return []
    width = vocab[0][3]
    known = [v[0] for v in vocab if v[1] and v[0] is not None]
    has_null = any(v[0] is None for v in vocab if v[1])
    rare = [v for v in vocab if not v[1]]
    out: list[Column] = [F.lit(0.0)] * width
    for category, frequent, idx, _ in vocab:
        if frequent and idx >= 0:
            out[idx] = F.col(col).eqNullSafe(F.lit(category)).cast("double")
    if rare and rare[0][2] >= 0:
        other = ~F.coalesce(F.col(col).isin(*known), F.lit(False)) if known else F.lit(True)
        if has_null:
            other = other & F.col(col).isNotNull()
        out[rare[0][2]] = other.cast("double")
    return [c.alias(f"{col}__{i}") for i, c in enumerate(out)]


def fit_features(train: DataFrame, kinds: Mapping[str, str], y: str = "y", n_classes: int | None = None,
                 dense_width: int = DENSE_WIDTH, min_frequency: int = MIN_FREQUENCY,
                 knots: Mapping[str, Sequence[float]] | None = None) -> FeatureSpace:
    """Fit a transform per column; ``train`` needs ``te_fold`` when a column is target encoded.

    ``n_classes`` (> 2) gives one encoding per class of the coded label.
    """
    numeric = fit_numeric(train, {c: k for c, k in kinds.items() if k in NUM_KINDS}, knots)
    hot = [c for c, k in kinds.items() if k == "one_hot_encoding"]
    vocab: dict[str, list[tuple]] = {c: [] for c in hot}
    wide, offsets, hot_width = None, {}, 0
    if hot:
        table = cut(one_hot_vocab(train, hot, min_frequency))
        widths = {r["feature"]: r["width"] for r in table.groupBy("feature").agg(F.max("width").alias("width")).collect()}
        for c in hot:
            if widths.get(c, 0) > dense_width:
                offsets[c], hot_width, wide = hot_width, hot_width + widths[c], table
        # rare categories share a position, so one row of them says all
        rare = table.filter("not is_frequent").groupBy("feature", "idx", "width").agg(F.lit(None).cast("string").alias("category"))
        small = table.filter("is_frequent").select("feature", "category", "is_frequent", "idx", "width").unionByName(
            rare.select("feature", "category", F.lit(False).alias("is_frequent"), "idx", "width"))
        for r in small.filter(~F.col("feature").isin(list(offsets))).collect():
            vocab[r["feature"]].append((r["category"], r["is_frequent"], r["idx"], r["width"]))
        vocab = {c: sorted(v, key=lambda v: v[2]) for c, v in vocab.items()}
    te = [c for c, k in kinds.items() if k == "target_encoding"]
    target: dict[str, list[TargetFit]] = {c: [] for c in te}
    if te:
        ys = ([F.col(y).cast("double")] if not n_classes or n_classes <= 2
              else [(F.col(y) == k).cast("double") for k in range(n_classes)])
        for one in ys:
            fits = fit_target(train.withColumn("_ty", one), te, "_ty")
            for c in te:
                target[c].append(fits[c])
    unknown = set(kinds.values()) - set(NUM_KINDS) - set(CAT_KINDS)
    if unknown:
        raise ValueError(f"unknown transforms {unknown}")
    return FeatureSpace(numeric, vocab, target, list(kinds), wide=wide, offsets=offsets, hot_width=hot_width)


# --------------------------------------------------------------------------
# target transforms


@dataclass
class TargetTransform:
    """Invertible transform of a regression target."""

    kind: str
    mean: float = 0.0
    sd: float = 1.0
    knots: list[float] | None = None

    def forward(self, y: Column) -> Column:
        if self.kind == "none":
            return y
        if self.kind == "symlog":
            return symlog(y)
        if self.kind == "standard":
            return (y - F.lit(self.mean)) / F.lit(self.sd)
        return empirical_cdf(y, self.knots, self.kind)

    def inverse(self, z: Column) -> Column:
        if self.kind == "none":
            return z
        if self.kind == "symlog":
            return symexp(z)
        if self.kind == "standard":
            return z * F.lit(self.sd) + F.lit(self.mean)
        return from_quantile(z, self.knots, self.kind)


def fit_target_transform(train: DataFrame, kind: str, y: str = "y") -> TargetTransform:
    if kind in ("none", "symlog"):
        return TargetTransform(kind)
    if kind == "standard":
        m, s = train.agg(F.avg(y), F.stddev_pop(y)).first()
        return TargetTransform(kind, m, s or 1.0)
    if kind not in ("quantile_uniform", "quantile_normal"):
        raise ValueError(f"unknown target transform {kind}")
    n = train.count()
    q = ranks.exact_quantiles(train.select(F.col(y).cast("double").alias("v")), [], "v", knot_probs(n)).first()["q"]
    return TargetTransform(kind, knots=list(q))


# --------------------------------------------------------------------------
# profiles


def value_ranges(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per numeric feature: 5%-95% range, else min-max, else 0-1, with the count of distinct values."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "feature", "value")
    q = ranks.exact_quantiles(long, ["feature"], "value", [0.05, 0.95])
    ends = long.groupBy("feature").agg(F.min("value").alias("mn"), F.max("value").alias("mx"))
    lo, hi = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    flat, one = lo == hi, F.col("mn") == F.col("mx")
    return q.join(ends, "feature").select(
        "feature", F.when(flat & one, 0.0).when(flat, F.col("mn")).otherwise(lo).alias("vmin"),
        F.when(flat & one, 1.0).when(flat, F.col("mx")).otherwise(hi).alias("vmax"))


def scaled_clip(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Numeric columns scaled to their range and clipped to [0, 1]."""
    ranges = {r["feature"]: (r["vmin"], r["vmax"]) for r in value_ranges(df, cols).collect()}
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, *[
        clip((F.col(c) - F.lit(ranges[c][0])) / F.lit(ranges[c][1] - ranges[c][0]), 0, 1).alias(c) for c in cols])
