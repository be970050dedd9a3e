"""Row assignment: folds, holdouts, cross-validation.

A split never moves the data. The fit step finds a handful of boundary rows in
a keyed-hash order (see ``ranks.row_thresholds``); the apply step compares each
row with those boundaries in the scan. Inputs carry ``row_id`` and, for class
splits, a label column.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.hashing import with_u32
from . import ranks


def set_fold(df: DataFrame, fold: int, reversed_: bool = False, fold_col: str = "fold") -> DataFrame:
    """Rows of the fold become test, the rest trainval (swapped when reversed)."""
    here, rest = ("trainval", "test") if reversed_ else ("test", "trainval")
    return df.withColumn("subset", F.when(F.col(fold_col) == fold, here).otherwise(rest))


def _above(me: Column, other: Column) -> Column:
    """me > other, where NULL is below every value."""
    return F.coalesce(me > other, me.isNotNull() & other.isNull())


def _after(boundaries: Column, most: int, key: str = "key") -> Column:
    """How many of the boundary rows (``most`` or fewer) stand before this row; plain comparisons, so generated code counts them."""
    total = F.lit(0)
    for i in range(most):
        b = F.get(boundaries, F.lit(i))
        later = _above(F.col(key), b["key"]) | (F.col(key).eqNullSafe(b["key"]) & _above(F.col("row_id"), b["row_id"]))
        total = total + F.when(b.isNotNull() & later, 1).otherwise(0)
    return total


def _keyed(df: DataFrame, seed: int | None) -> tuple[DataFrame, object]:
    """Order key of a shuffled (seeded) or an unshuffled split, and its buckets."""
    if seed is not None:
        return with_u32(df, {"key": seed}), ranks.hash_bucket(ranks.hash_bits(df))
    lo, hi = df.agg(F.min("row_id"), F.max("row_id")).first()
    return (df.withColumn("key", F.col("row_id")),
            ranks.width_bucket(lo or 0, hi or 0, ranks.hash_bits(df)))


def _boundaries(df: DataFrame, parts: list[str], rank_list: Column, bucket, extra=None) -> DataFrame:
    at = ranks.row_thresholds(df.select(*parts, "key", "row_id"), parts, rank_list, bucket, extra)
    return at.groupBy(*parts).agg(F.collect_list(F.struct("key", "row_id")).alias("_at"))


def _with_boundaries(df: DataFrame, parts: list[str], bounds: DataFrame, how: str = "inner") -> DataFrame:
    if parts:
        return ranks.join_same(df, ranks.fit_small(bounds), parts, how)      # rows without a label are a class of their own
    row = bounds.first()
    pairs = [F.struct(F.lit(b["key"]).cast("long").alias("key"), F.lit(b["row_id"]).cast("long").alias("row_id"))
             for b in (row["_at"] if row else [])]
    return df.withColumn("_at", F.array(*pairs).cast("array<struct<key:bigint,row_id:bigint>>"))


def _evaluate(to: DataFrame, seed: int | None, parts: list[str], bounds: DataFrame, name: str, most: int) -> DataFrame:
    """Every row of ``to`` with its fold by boundaries that were fitted on other rows; NULL for a class these lacked.

    The comparison is part of the scan: no row meets another by its id.
    """
    keyed = with_u32(to, {"_split_key": seed}) if seed is not None else to.withColumn("_split_key", F.col("row_id"))
    marked = _with_boundaries(keyed, parts, bounds, "left")
    fold = F.when(F.col("_at").isNotNull(), _after(F.col("_at"), most, "_split_key").cast("int"))
    return marked.withColumn(name, fold).drop("_at", "_split_key")


def _val_rank(ratio: float) -> Column:
    return F.array(F.struct(F.lit(0).alias("slot"), F.ceil(F.lit(float(ratio)) * F.col("n")).alias("rank")))


def holdout(df: DataFrame, ratio: float, seed: int = 0, label: str | None = None,
            ensure_all_classes: bool = False, classes: str | None = None) -> DataFrame:
    """Add ``subset`` = train or val; val is the first ceil(ratio * n) rows of a hash order.

    The same seed with a larger ratio keeps every earlier val row. With
    ``label`` the rule holds inside each class. With ``ensure_all_classes`` a
    class of column ``classes`` that fell wholly into val gives its first row
    to train.
    """
    parts = [label] if label else []
    keyed, bucket = _keyed(df, seed)
    cut = _with_boundaries(keyed, parts, _boundaries(keyed, parts, _val_rank(ratio), bucket))
    out = cut.withColumn("subset", F.when(_after(F.col("_at"), 1) == 0, "val").otherwise("train")).drop("_at")
    if ensure_all_classes:
        lonely = (
            out.groupBy(classes)
            .agg(F.max((F.col("subset") == "train").cast("int")).alias("_in_train"),
                 F.min(F.struct("key", "row_id")).alias("_first"))
            .filter("_in_train = 0").select(classes, F.col("_first.row_id").alias("_move"))
        )
        out = out.join(ranks.fit_small(lonely), classes, "left").withColumn(
            "subset", F.when(F.col("row_id") == F.col("_move"), "train").otherwise(F.col("subset"))
        ).drop("_move")
    return out.drop("key")


def _even_ranks(k: int) -> Column:
    """Last rank of each of the first k-1 folds when n rows are cut into k even runs."""
    n = F.col("n")
    return F.array(*[
        F.struct(F.lit(i).alias("slot"),
                 (F.floor(n / k) * (i + 1) + F.least(F.lit(i + 1), n % k)).alias("rank"))
        for i in range(k - 1)])


def kfold(df: DataFrame, k: int, seed: int | None = 0, fold_name: str = "cv_fold", to: DataFrame | None = None) -> DataFrame:
    """Add the fold 0..k-1 of a shuffled (or, without a seed, contiguous) K-fold.

    With ``to`` the folds are fitted on df and given to the rows of ``to``.
    """
    keyed, bucket = _keyed(df, seed)
    bounds = _boundaries(keyed, [], _even_ranks(k), bucket)
    if to is not None:
        return _evaluate(to, seed, [], bounds, fold_name, k - 1)
    cut = _with_boundaries(keyed, [], bounds)
    return cut.withColumn(fold_name, _after(F.col("_at"), k - 1).cast("int")).drop("_at", "key")


def class_blocks(df: DataFrame, label: str) -> DataFrame:
    """Per class: size and offset of its block when classes stand in order of first appearance."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("size"), F.min("row_id").alias("_first"))
    before = W.partitionBy().orderBy("_first").rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("_first")


def stratified_kfold(df: DataFrame, k: int, label: str, seed: int | None = 0,
                     fold_name: str = "cv_fold", to: DataFrame | None = None) -> DataFrame:
    """Add the fold of a stratified K-fold.

    Fold i receives as many rows of a class as the class block [start, start +
    size) has positions p with p mod k = i; rows fill folds in key order. With
    ``to`` the folds are fitted on df and given to the rows of ``to``.
    """
    keyed, bucket = _keyed(df, seed)
    blocks = ranks.fit_small(class_blocks(df, label))
    start, end = F.col("start"), F.col("start") + F.col("size")

    def up_to(n: Column, i: int) -> Column:
        """How many of the first n positions fall to folds 0..i."""
        return F.floor(n / k) * (i + 1) + F.least(n % k, F.lit(i + 1))

    slots = [F.struct(F.lit(i).alias("slot"), (up_to(end, i) - up_to(start, i)).alias("rank")) for i in range(k - 1)]
    bounds = _boundaries(keyed, [label], F.array(*slots), bucket, blocks)
    if to is not None:
        return _evaluate(to, seed, [label], bounds, fold_name, k - 1)
    cut = _with_boundaries(keyed, [label], bounds)
    return cut.withColumn(fold_name, _after(F.col("_at"), k - 1).cast("int")).drop("_at", "key")


def spread_lonely_classes(df: DataFrame, label: str, fold_name: str = "cv_fold") -> DataFrame:
    """A class found in one fold only gives its first row to fold 0 (or 1)."""
    lonely = (
        df.groupBy(label)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(fold_name).alias("_lo"), F.max(fold_name).alias("_hi"),
             F.min("row_id").alias("_move"))
        .filter("_lo = _hi and _n > 1")
        .select(label, "_move", F.when(F.col("_lo") == 0, 1).otherwise(0).alias("_to"))
    )
    moved = df.join(ranks.fit_small(lonely), label, "left")
    return moved.withColumn(
        fold_name, F.when(F.col("row_id") == F.col("_move"), F.col("_to")).otherwise(F.col(fold_name))
    ).drop("_move", "_to")


def singleton_classes(df: DataFrame, label: str) -> DataFrame:
    """Classes with one row: no K-fold can keep them in every training part."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).filter("n = 1")


def train_val(df: DataFrame, fold: int, fold_name: str = "cv_fold",
              to_subsets: tuple[str | None, str | None] = ("train", "val")) -> DataFrame:
    """Add ``subset`` from a fold column; a None name leaves those rows without a subset."""
    train, val = to_subsets
    return df.withColumn("subset", F.when(F.col(fold_name) == fold, F.lit(val)).otherwise(F.lit(train)))


@dataclass(frozen=True)
class Splitter:
    """A named split: ``none``, ``holdout{ratio}_seed{s}`` or ``cv{k}_seed{s}_fold{i}``."""

    method: str = "none"
    val_ratio: float = 0.2
    n_folds: int = 5
    fold_idx: int = 0
    random_seed: int = 0
    stratified: bool = True
    ensure_all_classes: bool = False
    from_subset: str = "trainval"
    to_subsets: tuple[str | None, str | None] = ("train", "val")

    def __post_init__(self):
        if self.method not in ("none", "holdout", "cv"):
            raise ValueError(f"unknown split method {self.method}")
        if self.random_seed < 0:
            raise ValueError("negative seeds do not survive the split name")
        if self.method == "cv" and not 0 <= self.fold_idx < self.n_folds:
            raise ValueError("fold index out of range")

    def __str__(self) -> str:
        if self.method == "holdout":
            return f"holdout{self.val_ratio}_seed{self.random_seed}"
        if self.method == "cv":
            return f"cv{self.n_folds}_seed{self.random_seed}_fold{self.fold_idx}"
        return "none"

    @classmethod
    def from_string(cls, name: str) -> Splitter:
        if name == "none":
            return cls()
        if m := re.fullmatch(r"holdout([0-9.]+)_seed([0-9]+)", name):
            return cls("holdout", val_ratio=float(m[1]), random_seed=int(m[2]))
        if m := re.fullmatch(r"cv([0-9]+)_seed([0-9]+)_fold([0-9]+)", name):
            return cls("cv", n_folds=int(m[1]), random_seed=int(m[2]), fold_idx=int(m[3]))
        raise ValueError(f"not a split name: {name}")

    def assign(self, rows: DataFrame, label: str | None = None) -> DataFrame:
        """(row_id, subset) of the new subsets for rows of the source subset."""
        if self.method == "none":
            return rows.select("row_id", F.lit(self.from_subset).alias("subset"))
        if self.method == "holdout":
            out = holdout(rows, self.val_ratio, self.random_seed,
                          ensure_all_classes=self.ensure_all_classes and label is not None, classes=label)
            train, val = self.to_subsets
            out = out.withColumn("subset", F.when(F.col("subset") == "val", F.lit(val)).otherwise(F.lit(train)))
        else:
            if label and self.stratified:
                out = stratified_kfold(rows, self.n_folds, label, self.random_seed)
            else:
                out = kfold(rows, self.n_folds, self.random_seed)
            if label and self.ensure_all_classes:
                if not singleton_classes(rows, label).isEmpty():
                    raise ValueError("a class has one row only; it cannot be in every training part")
                out = spread_lonely_classes(out, label)
            out = train_val(out, self.fold_idx, to_subsets=self.to_subsets)
        return out.filter(F.col("subset").isNotNull()).select("row_id", "subset")

    def mark(self, source: DataFrame, to: DataFrame, label: str | None = None, name: str = "subset") -> DataFrame:
        """``to`` with the subset that each row has, or would have, among the rows of the source subset."""
        if self.ensure_all_classes and label is not None:
            raise ValueError("rows that are moved for their class are found by id; use assign")
        train, val = self.to_subsets
        if self.method == "none":
            return to.withColumn(name, F.lit(self.from_subset))
        if self.method == "holdout":
            keyed, bucket = _keyed(source, self.random_seed)
            out = _evaluate(to, self.random_seed, [], _boundaries(keyed, [], _val_rank(self.val_ratio), bucket), "_fold_of", 1)
            first = F.col("_fold_of") == 0
        else:
            if label and self.stratified:
                out = stratified_kfold(source, self.n_folds, label, self.random_seed, "_fold_of", to)
            else:
                out = kfold(source, self.n_folds, self.random_seed, "_fold_of", to)
            first = F.col("_fold_of") == self.fold_idx
        return out.withColumn(name, F.when(first, F.lit(val)).otherwise(F.lit(train))).drop("_fold_of")

    def split(self, subsets: DataFrame, rows: DataFrame, label: str | None = None) -> DataFrame:
        """Add this split's subsets to a (row_id, subset) table."""
        if self.method == "none":
            return subsets
        source = subsets.filter(F.col("subset") == self.from_subset).select("row_id")
        part = self.assign(rows.join(source, "row_id", "left_semi"), label)
        replaced = [s for s in self.to_subsets if s is not None]
        return subsets.filter(~F.col("subset").isin(*replaced)).unionByName(part)


def lineage(*splitters: Splitter) -> str:
    return ";".join(str(s) for s in splitters)


SPLIT_PATTERNS = {
    "holdout": r"^holdout([0-9.]+)_seed([0-9]+)$",
    "cv": r"^cv([0-9]+)_seed([0-9]+)_fold([0-9]+)$",
}


def parse_split_column(df: DataFrame, col: str = "split") -> DataFrame:
    """Method and parameters of split names held in a column."""
    name, h, c = F.col(col), SPLIT_PATTERNS["holdout"], SPLIT_PATTERNS["cv"]
    is_h, is_c = name.rlike(h), name.rlike(c)
    seed = F.when(is_h, F.regexp_extract(name, h, 2)).when(is_c, F.regexp_extract(name, c, 2))
    return (
        df.withColumn("method", F.when(is_h, "holdout").when(is_c, "cv").when(name == "none", "none"))
        .withColumn("val_ratio", F.when(is_h, F.regexp_extract(name, h, 1)).cast("double"))
        .withColumn("n_folds", F.when(is_c, F.regexp_extract(name, c, 1)).cast("int"))
        .withColumn("random_seed", seed.cast("int"))
        .withColumn("fold_idx", F.when(is_c, F.regexp_extract(name, c, 3)).cast("int"))
    )
