"""Projections, subsets and checks over a dataset table or a prediction table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .ranks import SMALL_ROWS, fit_small, local_table


def xy(df: DataFrame, features: Sequence[str], target: str = "y") -> DataFrame:
    return df.select("row_id", *features, F.col(target).alias("TARGET"))


def subset_rows(df: DataFrame, subsets: DataFrame, name: str) -> DataFrame:
    """Rows of a named subset; the membership table is narrow, so only its ids move."""
    ids = subsets.filter(F.col("subset") == name).select("row_id")
    return df.join(ids, "row_id", "left_semi")


def rows_by_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows for an explicit (pos, row_id) list; repeats stay repeated, ``pos`` keeps the order."""
    return ids.select("pos", "row_id").join(df, "row_id")


def vocabulary(df: DataFrame, col: str, name: str = "code") -> DataFrame:
    """Distinct values with 0-based codes in sort order."""
    values = df.select(col).filter(F.col(col).isNotNull()).distinct()
    local = local_table(values, SMALL_ROWS)
    if local is not None:
        ranked = local.withColumn(name, (F.row_number().over(W.orderBy(col)) - 1).cast("int"))
        return F.broadcast(ranked)
    indexed = values.orderBy(col).rdd.zipWithIndex().map(lambda r: (r[0][0], r[1]))
    return df.sparkSession.createDataFrame(indexed, f"{col} {values.schema[0].dataType.simpleString()}, {name} long")


def label_codes(df: DataFrame, label: str = "y", name: str = "label_code") -> DataFrame:
    return df.join(vocabulary(df, label, name), label, "left")


def unseen_labels(df: DataFrame, label: str = "y", seen: str = "trainval", checked: str = "test") -> DataFrame:
    """Labels observed in one subset and never in the other."""
    per = df.groupBy(label).agg(
        F.max((F.col("subset") == seen).cast("int")).alias("_seen"),
        F.max((F.col("subset") == checked).cast("int")).alias("_checked"))
    return per.filter("_checked = 1 and _seen = 0").select(label)


def fold_coverage(df: DataFrame, n_folds: int = 10) -> DataFrame:
    """Rows per fold with the number of rows whose fold is missing, out of range or repeated."""
    per_row = df.groupBy("row_id").agg(F.count(F.lit(1)).alias("times"), F.min("fold").alias("fold"))
    bad = (F.col("times") != 1) | F.col("fold").isNull() | ~F.col("fold").between(0, n_folds - 1)
    return per_row.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(bad.cast("long")).alias("n_bad"))


def describe(df: DataFrame, features: Sequence[str], task_type: str) -> DataFrame:
    return df.groupBy("subset").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "subset", "n_rows", F.lit(len(features)).alias("n_features"), F.lit(task_type).alias("task_type"))


def validate_predictions(preds: DataFrame, truth: DataFrame, task_type: str, n_classes: int | None = None,
                         pred: str = "pred", label: str = "y") -> DataFrame:
    """One row of defect counts; a valid prediction table has zeros only."""
    if task_type == "multiclass":
        shape = F.coalesce(F.size(pred), F.lit(-1)) != n_classes
    else:
        shape = F.lit(False)
    joined = preds.select("row_id", F.col(pred).alias("p"), F.lit(1).alias("_p"), shape.alias("_shape")).join(
        truth.select("row_id", F.col(label).alias("_y"), F.lit(1).alias("_t")), "row_id", "full")

    def n(cond):
        return F.count(F.when(cond, 1))

    return joined.agg(
        n(F.col("_p").isNull()).alias("missing_pred"), n(F.col("_t").isNull()).alias("missing_truth"),
        n(F.col("_shape")).alias("wrong_size"), n(F.col("_p").isNotNull() & F.col("p").isNull()).alias("null_pred"),
        n(F.col("_t").isNotNull() & F.col("_y").isNull()).alias("null_truth"),
        F.count(F.lit(1)).alias("n_rows"))


def subset_difference(subsets: DataFrame, whole: str, minus: str) -> DataFrame:
    """Row ids of one subset that are not in another, from one grouped pass."""
    flags = subsets.groupBy("row_id").agg(
        F.max((F.col("subset") == whole).cast("int")).alias("a"),
        F.max((F.col("subset") == minus).cast("int")).alias("b"))
    return flags.filter("a = 1 and b = 0").select("row_id")


def subset_checks(subsets: DataFrame, parts: Sequence[str], whole: str) -> DataFrame:
    """Overlap of the parts, and rows by which their union differs from the whole."""
    in_parts = F.sum(F.col("subset").isin(*parts).cast("int"))
    in_whole = F.max((F.col("subset") == whole).cast("int"))
    per_row = subsets.groupBy("row_id").agg(in_parts.alias("k"), in_whole.alias("w"))
    return per_row.agg(
        F.count(F.when(F.col("k") > 1, 1)).alias("n_overlap"),
        F.count(F.when((F.col("k") > 0) != (F.col("w") > 0), 1)).alias("n_differ"),
        F.count(F.when(F.col("w") > 0, 1)).alias("n_whole"))


def residual_target(rows: DataFrame, init: DataFrame, label: str = "y", pred: str = "pred") -> DataFrame:
    """Target minus an initial prediction, matched on row id."""
    return rows.join(init.select("row_id", F.col(pred).alias("init")), "row_id").withColumn(
        "residual", F.col(label) - F.col("init"))


def join_truth(preds: DataFrame, truth: DataFrame, label: str = "y") -> DataFrame:
    return preds.join(truth.select("row_id", F.col(label).alias("truth")), "row_id")


def fill_missing_category(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL becomes the column's own word for missing, or the new category ``missing``.

    Fixed values, in order of preference: missing, unknown, none (any case).
    """
    words = ["missing", "unknown", "none"]
    # one pass: per column and word, the first category (in sort order) spelled like the word
    found = df.agg(*[F.min(F.when(F.lower(c) == w, F.col(c))).alias(f"{c}__{w}") for c in cols for w in words]).first()
    fills = {}
    for c in cols:
        fills[c] = next((found[f"{c}__{w}"] for w in words if found[f"{c}__{w}"] is not None), "missing")
    return df.fillna(fills)


def infer_roles(df: DataFrame, skip: Sequence[str] = ("row_id", "y", "fold", "subset")) -> DataFrame:
    """Role of each feature column: category if text, bool or at most two distinct values.

    Distinct values are only counted up to three per numeric column: the running
    set of a ``min``/``max``/other test answers the <= 2 question without a
    distinct shuffle.
    """
    cols = [f for f in df.schema.fields if f.name not in skip]
    aggs = []
    for f in cols:
        lo, hi = F.min(f.name), F.max(f.name)
        aggs += [lo.alias(f"{f.name}__lo"), hi.alias(f"{f.name}__hi"), F.count(f.name).alias(f"{f.name}__n")]
    bounds = df.agg(*aggs).first()
    numeric = [f.name for f in cols if f.dataType.simpleString() not in ("string", "boolean")]
    between = df.agg(F.lit(1).alias("_"), *[
        F.max(((F.col(c) != F.lit(bounds[f"{c}__lo"])) & (F.col(c) != F.lit(bounds[f"{c}__hi"]))).cast("int"))
        .alias(c) for c in numeric]).first()
    out = []
    for f in cols:
        few = f.name in numeric and not between[f.name]
        role = "category" if f.name not in numeric or few else "numeric"
        out.append((f.name, f.dataType.simpleString(), int(bounds[f"{f.name}__n"]), role))
    return df.sparkSession.createDataFrame(out, "feature string, dtype string, n_present long, role string")


def infer_task_type(df: DataFrame, label: str = "y") -> DataFrame:
    """Regression for a numeric target, else binary (two classes) or multiclass."""
    kind = df.schema[label].dataType.simpleString()
    classes = df.select(label).filter(F.col(label).isNotNull()).distinct().agg(F.count(F.lit(1)).alias("n_classes"))
    if kind in ("string", "boolean"):
        task = (F.when(F.col("n_classes") == 2, "binary").when(F.col("n_classes") > 2, "multiclass"))
    else:
        task = F.lit("regression")
    return classes.select("n_classes", task.alias("task_type"))


def dense_class_table(df: DataFrame, label: str) -> DataFrame:
    return fit_small(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")))
