"""Quantiles of large groups by bins, and one-feature lines on transforms refitted for every fold."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldspark.operators import prep, quantiles, ranks, screen


def _long(n=6000, seed=0):
    r = np.random.default_rng(seed)
    pdf = pd.DataFrame({"row_id": np.arange(n), "cv_fold": r.integers(0, 5, n), "y": r.normal(50, 2, n)})
    a = pdf.assign(feature="a", x=np.where(r.random(n) < 0.3, 1.5, np.exp(r.normal(0, 3, n))) + 0.001 * pdf["y"].round())
    b = pdf.assign(feature="b", x=r.integers(0, 7, n).astype(float))
    return pd.concat([a, b]).sample(frac=1, random_state=seed)


@pytest.fixture
def long(spark):
    df = spark.createDataFrame(_long()).withColumn("x", F.when(F.col("row_id") % 9 != 0, F.col("x")))
    return df.withColumn("y", F.when(F.col("row_id") % 23 != 0, F.col("y"))).localCheckpoint()


def test_quantiles_outside_each_fold(long, monkeypatch):
    monkeypatch.setattr(quantiles, "CHUNK", 16)
    probs = [0.0, 0.1, 0.25, 0.5, 0.333, 0.9, 1.0]
    got = quantiles.held_out(long, ["feature"], "x", probs, fold="cv_fold", n_folds=5)
    pdf = long.toPandas().dropna(subset=["x"])
    assert len(got) == 10
    for (c, f), q in got.items():
        want = np.quantile(pdf[(pdf["feature"] == c) & (pdf["cv_fold"] != f)]["x"], probs)
        assert q == pytest.approx(want.tolist(), rel=1e-12)


def test_a_large_group_is_no_percentile(spark, monkeypatch, long):
    """The values of a group do not meet in one task's map."""
    want = {r["feature"]: r["q"] for r in ranks.exact_quantiles(long, ["feature"], "x", [0.2, 0.5, 0.99]).collect()}
    monkeypatch.setattr(ranks, "QUANTILE_BYTES", 1)
    monkeypatch.setattr(ranks.F, "percentile", lambda *_: pytest.fail("percentile of a large group"))
    got = {r["feature"]: r["q"] for r in ranks.exact_quantiles(long, ["feature"], "x", [0.2, 0.5, 0.99]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    none = ranks.exact_quantiles(long.filter("row_id < 0"), ["feature"], "x", [0.5])
    assert none.count() == 0
    assert ranks.exact_quantiles(long.filter("row_id < 0").select("x"), [], "x", [0.5]).first()["q"] is None


@pytest.mark.parametrize("kind", ["quantile_uniform", "quantile_normal"])
def test_lines_on_refitted_transforms(long, kind):
    """Against a line through copies of all rows for every fold."""
    spread = prep.cross_quantiles(long, kind, 5)
    named = spread.withColumns({"feature": F.concat_ws("|", "feature", F.col("eval_fold").cast("string")),
                                "held": (F.col("cv_fold") == F.col("eval_fold")).cast("int")})
    rows = screen.line_predictions(named, "held").filter("held = 1")
    want = {(r["row_id"], r["feature"][0]): r["pred"] for r in rows.collect()}
    got = {(r["row_id"], r["feature"]): r["pred"] for r in screen.cross_line_predictions(long, kind).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v, rel=1e-9) for k, v in want.items())


def test_knots_of_all_folds_from_the_same_passes(spark, monkeypatch):
    pdf = _long()
    wide = spark.createDataFrame(pdf[pdf["feature"] == "a"]).withColumn("x", F.when(F.col("row_id") % 9 != 0, F.col("x"))).localCheckpoint()
    knots = prep.cross_feature_knots(wide, ["x"], 5)
    assert prep.cross_feature_knots(wide.limit(100), ["x"], 5) == {}
    for f in range(5):
        train = wide.filter(F.col("cv_fold") != f)
        want = prep.fit_numeric(train, {"x": "quantile_uniform"})["x"]
        with monkeypatch.context() as m:
            m.setattr(prep, "feature_quantiles", lambda *_: pytest.fail("fitted for each fold"))
            got = prep.fit_numeric(train, {"x": "quantile_uniform"}, knots[f])["x"]
        assert got.knots == pytest.approx(want.knots, rel=1e-12)
        assert got.fill == pytest.approx(want.fill, rel=1e-9)
