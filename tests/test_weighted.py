"""Poisson bootstrap scores from weights against scores of repeated rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldspark.functions.hashing import with_poisson
from foldspark.operators import metrics as M
from foldspark.operators import weighted
from foldspark.operators.resample import FULL, resample

SEEDS = [None, *range(12)]


def _repeated(df, names, n_classes=None, extra=()):
    drawn = resample(df, [*extra, "subset"], SEEDS, "poisson")
    out = M.score_groups(drawn, [*extra, "subset", "bootstrap_seed"], names, n_classes)
    return out.withColumn("bootstrap_seed", F.when(F.col("bootstrap_seed") != FULL, F.col("bootstrap_seed")))


def _rows(df, extra=()):
    return {tuple(r[c] for c in (*extra, "subset", "metric", "bootstrap_seed")): r["score"] for r in df.collect()}


def _same(df, names, n_classes=None, extra=()):
    want = _rows(_repeated(df, names, n_classes, extra), extra)
    got = _rows(M.score_all(df, names, None, SEEDS, n_classes, extra=extra, method="poisson"), extra)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (got[k] is None) == (v is None), (k, v, got[k])
        assert v is None or got[k] == pytest.approx(v, rel=1e-9, abs=1e-9), (k, v, got[k])


def _regression(n=4000, seed=0):
    r = np.random.default_rng(seed)
    y = r.normal(1000, 3, n)
    return pd.DataFrame({"row_id": r.integers(0, 1 << 40, n), "subset": r.choice(["train", "test"], n), "y": y, "pred": y + r.normal(0, 1, n)})


@pytest.fixture
def no_repeats(monkeypatch):
    def fail(*_, **__):
        raise AssertionError("rows are repeated")

    monkeypatch.setattr(M, "resample", fail)


def test_weights_are_those_of_the_columns(spark):
    ids = np.array([0, 1, 2, 7, 1 << 33, (1 << 40) + 5, -3, 2**62], np.int64)
    df = spark.createDataFrame([(int(i), s) for i in ids for s in range(40)], "row_id long, s int")
    want = {(r["row_id"], r["s"]): r["w"] for r in with_poisson(df, "w", F.col("s")).collect()}
    got = weighted.poisson_weights(ids, range(40))
    assert all(got[s, i] == want[int(v), s] for s in range(40) for i, v in enumerate(ids))


@pytest.mark.parametrize("kind", ["plain", "odd", "ties", "one value", "few rows"])
def test_errors(spark, no_repeats, kind):
    pdf = _regression()
    if kind == "ties":
        pdf["y"] = (pdf["y"] / 2).round()
    elif kind == "one value":
        pdf["y"] = 0.1
    elif kind == "few rows":
        pdf = pdf.head(3)
    df = spark.createDataFrame(pdf)
    if kind == "odd":
        i = F.col("row_id")
        df = df.withColumns({"y": F.when(i % 5 != 0, F.when(i % 1999 == 1, float("inf")).otherwise(F.col("y"))),
                             "pred": F.when(i % 7 != 0, F.when(i % 2111 == 1, float("nan")).otherwise(F.col("pred"))),
                             "subset": F.when(i % 3 != 0, F.col("subset"))})
        nothing = df.limit(20).withColumns({"subset": F.lit("none"), "y": F.lit(None).cast("double")})
        df = df.unionByName(nothing).localCheckpoint()
    _same(df, ["r2", "d2_absolute_error"])


def test_weights_that_follow_the_truth(spark, no_repeats, monkeypatch):
    """A seed whose weights grow with the truth has its median far from that of all rows."""
    monkeypatch.setattr(weighted, "MOST_BINS", 300)
    df = with_poisson(spark.range(4000).withColumn("row_id", F.col("id") * 7), "w", F.lit(5)).select(
        "row_id", F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("subset"),
        (F.col("w") * 1000 + F.col("id") % 997).cast("double").alias("y"), (F.col("id") % 89).cast("double").alias("pred"))
    _same(df.localCheckpoint(), ["d2_absolute_error"])


@pytest.mark.parametrize("buckets", [1, 8])
def test_binary(spark, no_repeats, monkeypatch, buckets):
    monkeypatch.setattr(weighted, "BUCKET_ROWS", 8000 // buckets)
    monkeypatch.setattr(weighted, "HELD_GROUPS", 2)
    r = np.random.default_rng(1)
    n = 20_000
    pdf = pd.DataFrame({"row_id": np.arange(n), "subset": r.choice(["val", "test"], n), "fit": r.integers(0, 2, n), "y": r.integers(0, 2, n)})
    pdf["pred"] = np.where(r.random(n) < 0.4, 0.5, r.normal(0, 2, n).round(3)) + pdf["y"]
    i = F.col("row_id")
    df = spark.createDataFrame(pdf).withColumns({"y": F.when(i % 11 != 0, F.col("y").cast("int")), "pred": F.when(i % 13 != 0, F.col("pred"))})
    _same(df, ["neg_log_loss", "roc_auc"], 2, ["fit"])
    _same(df.withColumn("pred", F.lit(0.25)), ["roc_auc", "balanced_accuracy"], 2)
    _same(df.filter("y = 1"), ["roc_auc", "log_loss", "balanced_accuracy"], 2)


def test_classes(spark, no_repeats):
    r = np.random.default_rng(2)
    n = 5000
    rows = [(int(i), "test" if i % 3 else "val", int(c) if i % 17 else None, [float(v) for v in p] if i % 19 else None)
            for i, c, p in zip(range(n), r.integers(0, 3, n), r.normal(0, 1, (n, 3)))]
    df = spark.createDataFrame(rows, "row_id long, subset string, y int, pred array<double>")
    _same(df, ["neg_log_loss", "balanced_accuracy"], 3)
    _same(df.filter("y < 2 or subset = 'val'"), ["neg_log_loss", "balanced_accuracy"], 3)
