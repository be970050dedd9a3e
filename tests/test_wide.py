"""The lock-step solver and the sparse one-hot space, against closed forms, gradients and the narrow solvers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.operators import gram, logistic, prep, sparse
from foldspark.operators.linear import LinearCV


def wide_table(spark, n=400, d=30, classes=3, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    w = rng.normal(size=d) * (rng.random(d) < 0.3)
    z = x @ w + rng.normal(size=n)
    y, k = np.round(z, 3), np.digitize(z, np.quantile(z, np.arange(1, classes) / classes))
    cols = [f"x{i}" for i in range(d)]
    rows = [(i, *map(float, x[i]), float(y[i]), int(k[i]), int(k[i] > 0), i % 5) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, " + ", ".join(f"{c} double" for c in cols) + ", r double, k int, b int, cv_fold int")
    return df.repartition(3), cols, x, y, k


def violation(x, y, w, loss, fit):
    """The largest subgradient entry of the objective at w, by its definition."""
    z = x @ w[:, :-1].T + w[:, -1]
    _, slope = sparse.log_loss(z, y.astype(float), loss)
    g = np.column_stack([slope.T @ x / len(y) + fit.l2 * w[:, :-1], slope.mean(axis=0)])
    free = np.zeros_like(w, bool)
    free[:, -1] = True
    held = np.where(w > 0, g + fit.l1, np.where(w < 0, g - fit.l1, np.sign(g) * np.maximum(np.abs(g) - fit.l1, 0)))
    return np.abs(np.where(free, g, held)).max()


@pytest.mark.parametrize(("loss", "y", "outputs"), [("squared", "r", 1), ("log", "b", 1), ("log", "k", 3), ("ovr", "k", 3)])
def test_all_fits_are_stationary(spark, loss, y, outputs):
    df, cols, x, r, k = wide_table(spark)
    target = {"r": r, "k": k, "b": (k > 0).astype(int)}[y]
    fold = np.arange(len(r)) % 5
    fits = [sparse.Fit(f, l1, l2) for f in (-1, 0, 3) for l1, l2 in ((0.0, 0.01), (0.02, 0.0), (0.05, 0.01), (5.0, 0.0))]
    with sparse.Rows(df, cols, y, fold="cv_fold") as rows:
        solved = sparse.solve(rows, fits, loss, outputs, tol=1e-6)
        losses = sparse.held_out(rows, solved, loss)
    for f, s in solved.items():
        on = fold != f.without
        assert s.converged and violation(x[on], target[on], s.weights, loss, f) < 2e-5
        if f.l1 == 5.0:
            assert not s.weights[:, :-1].any()              # zeros are exact
        if f.without >= 0:
            z = x[~on] @ s.weights[:, :-1].T + s.weights[:, -1]
            want = sparse.log_loss(z, target[~on].astype(float), loss)[0].mean() * (2 if loss == "squared" else 1)
            assert abs(losses[f] - want) < 1e-9


def test_groups_of_fits_and_odd_rows(spark, monkeypatch):
    df, cols, *_ = wide_table(spark, 80, 4)
    fits = [sparse.Fit(f, 0.0, 0.1) for f in range(5)]
    with sparse.Rows(df, cols, "b", fold="cv_fold") as rows:
        want = sparse.solve(rows, fits, "log")
        monkeypatch.setattr(sparse, "SENT_BYTES", 1)
        got = sparse.solve(rows, fits, "log")
        assert all(np.allclose(got[f].weights, want[f].weights, atol=1e-6) for f in fits)
        with pytest.warns(UserWarning, match="did not converge"):
            assert not sparse.solve(rows, fits[:1], "log", max_steps=1)[fits[0]].converged
    with sparse.Rows(df.limit(0), cols, "b") as rows, pytest.raises(ValueError, match="no rows"):
        sparse.solve(rows, [sparse.Fit()], "log")
    with sparse.Rows(df.withColumn("x0", F.lit(None)), cols, "b") as rows:      # a missing number is 0
        assert abs(sparse.solve(rows, [sparse.Fit(l2=0.1)], "log")[sparse.Fit(l2=0.1)].weights[0, 0]) < 1e-9


def test_wide_fits_agree_with_the_narrow_solvers(spark, monkeypatch):
    df, cols, *_ = wide_table(spark, d=6)
    reg, many = df.withColumn("y", F.col("r")), df.withColumn("y", F.col("k"))
    narrow = [LinearCV("regression").fit(reg, cols), LinearCV("regression", "l1").fit(reg, cols), LinearCV("multiclass", n_classes=3).fit(many, cols)]
    fixed = [LinearCV("regression", y_transform="none").fit_fixed(reg, cols, 8.0), LinearCV("regression", "elasticnet").fit_fixed(reg, cols, 0.1, 0.5)]
    folds = [{r["row_id"]: r["pred"] for r in m.cross_val_predict(d).collect()} for m, d in zip(narrow, (reg, reg, many))]
    monkeypatch.setattr(gram, "MAX_WIDTH", 1)
    monkeypatch.setattr(logistic, "MAX_NEWTON", 1)
    wide = [LinearCV("regression").fit(reg, cols), LinearCV("regression", "l1").fit(reg, cols), LinearCV("multiclass", n_classes=3).fit(many, cols)]
    assert all(m.is_wide for m in wide)
    assert narrow[1].coef == wide[1].coef and narrow[2].coef == wide[2].coef
    assert np.allclose(narrow[1].path["mse"], wide[1].path["mse"], atol=1e-5)
    assert np.allclose(narrow[2].path["loss"], wide[2].path["loss"], atol=1e-4)
    for m, w in ((narrow[1], wide[1]), (narrow[2], wide[2])):
        a, b = m.weights - (m.weights.mean(0) if len(m.weights) > 1 else 0), w.weights - (w.weights.mean(0) if len(w.weights) > 1 else 0)
        assert np.abs(a - b).max() < 1e-3
    for want, make in zip(fixed, (lambda: LinearCV("regression", y_transform="none").fit_fixed(reg, cols, 8.0),
                                  lambda: LinearCV("regression", "elasticnet").fit_fixed(reg, cols, 0.1, 0.5))):
        assert np.abs(want.weights - make().weights).max() < 1e-4
    for m, d, want in zip(wide[1:], (reg, many), folds[1:]):
        got = {r["row_id"]: r["pred"] for r in m.cross_val_predict(d).collect()}
        assert all(np.allclose(got[i], want[i], atol=2e-3) for i in want)


def test_one_against_the_rest(spark):
    df, cols, x, _, k = wide_table(spark, d=5)
    df = df.withColumn("y", F.col("k"))
    model = LinearCV("multiclass", n_classes=3, multiclass="ovr").fit_fixed(df, cols, 0.5)
    for c in range(3):
        alone = LinearCV("binary", n_classes=2).fit_fixed(df.withColumn("y", (F.col("k") == c).cast("int")), cols, 0.5)
        assert np.abs(alone.weights[0] - model.weights[c]).max() < 1e-4
    p = np.array([r["pred"] for r in model.predict(df).orderBy("row_id").collect()])
    s = 1 / (1 + np.exp(-(x @ model.weights[:, :-1].T + model.weights[:, -1])))
    assert np.allclose(np.exp(p), s / s.sum(axis=1, keepdims=True), atol=1e-9)


def test_hundreds_of_columns_and_ten_classes(spark):
    df, cols, _, _, k = wide_table(spark, 500, 700, 10, 3)
    binary = LinearCV("binary", n_classes=2, reg_coefs=[0.001, 0.01], n_folds=2).fit(
        df.withColumn("y", F.col("b")).withColumn("cv_fold", F.col("cv_fold") % 2), cols)
    assert binary.is_wide and len(binary.path) == 2
    ten = LinearCV("multiclass", n_classes=10).fit_fixed(df.withColumn("y", F.col("k")), cols, 0.01)
    assert ten.weights.shape == (10, 701)


def test_a_regression_beyond_the_gram_limit(spark):
    rng = np.random.default_rng(4)
    n, d = 300, 2500
    x = rng.normal(size=(n, d))
    y = x[:, :3].sum(axis=1) + 0.1 * rng.normal(size=n)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), i % 3) for i in range(n)], "row_id long, v array<double>, y double, cv_fold int")
    df = df.select("row_id", "y", "cv_fold", *[F.get("v", F.lit(i)).alias(f"x{i}") for i in range(d)])
    model = LinearCV("regression", y_transform="none").fit_fixed(df, [f"x{i}" for i in range(d)], 50.0)
    xc, yc = x - x.mean(0), y - y.mean()
    want = xc.T @ np.linalg.solve(xc @ xc.T + 50.0 * np.eye(n), yc)
    assert np.abs(model.weights[0, :-1] - want).max() < 1e-4


def category_rows(spark, n, n_categories):
    return spark.range(n).selectExpr(
        "id AS row_id", f"CASE WHEN id % 50 = 0 THEN NULL ELSE concat('c', id % {n_categories}) END AS big",
        "CASE WHEN id % 3 = 0 THEN 'u' WHEN id % 3 = 1 THEN 'v' ELSE 'w' END AS small", "id / 10.0D AS num",
        f"(id % {n_categories}) % 2 + id % 3 + 0.0D AS y", f"CAST(floor(id / {n_categories}) % 5 AS int) AS cv_fold")


def test_sparse_space_equals_the_dense_one(spark):
    df = category_rows(spark, 3000, 150)
    kinds = {"num": "standard", "big": "one_hot_encoding", "small": "one_hot_encoding"}
    thin, wide = prep.fit_features(df, kinds, dense_width=1000), prep.fit_features(df, kinds)
    assert wide.hot and not thin.hot and wide.hot_width == 148
    new = df.limit(40).withColumn("big", F.when(F.col("row_id") % 4 == 0, "unseen").otherwise(F.col("big")))
    a = {r["row_id"]: r for r in thin.apply(new, ["row_id"]).collect()}
    b = {r["row_id"]: r for r in wide.apply(new, ["row_id"]).collect()}
    assert [f for f in wide.features if not f.startswith("big__")] == wide.features
    for i, r in a.items():
        assert [j for j in range(148) if r[f"big__{j}"]] == b[i][prep.HOT]
        assert all(r[f] == b[i][f] for f in wide.features)
    names = {r["position"]: r for r in wide.hot_names().collect()}
    assert len(names) == 148 and names[0]["feature"] == "big"
    one = LinearCV("regression").fit_fixed(thin.apply(df, ["row_id", "y"]), thin.features, 3.0)
    ready = wide.apply(df, ["row_id", "y", "cv_fold"])
    two = LinearCV("regression").fit_fixed(ready, wide.features, 3.0, None, wide.hot, wide.hot_width)
    x, y = (sorted((r["row_id"], r["pred"]) for r in m.predict(d).collect()) for m, d in ((one, thin.apply(df, ["row_id"])), (two, ready)))
    assert np.allclose(x, y, atol=1e-4)
    found = LinearCV("regression", reg_coefs=[2.0, 50.0], n_folds=3).fit(ready, wide.features, wide.hot, wide.hot_width)
    assert found.coef == 2.0 and len(found.coefficients()) == len(wide.features) + 149
    folds = found.cross_val_predict(ready.withColumn("cv_fold", F.col("cv_fold") % 3))
    assert folds.filter("abs(pred - y) < 0.4").count() > 2400


def test_rare_categories_share_a_position(spark):
    df = spark.range(1000).selectExpr("id AS row_id", "CASE WHEN id < 900 THEN concat('k', id % 80) ELSE concat('rare', id) END AS c", "id + 0.0D AS y")
    space = prep.fit_features(df, {"c": "one_hot_encoding"})
    got = {r["row_id"]: r[prep.HOT] for r in space.apply(df, ["row_id"]).collect()}
    assert space.hot_width == 81 and {tuple(got[i]) for i in range(900, 1000)} == {(80,)} and len({tuple(v) for v in got.values()}) == 81


def test_hundreds_of_thousands_of_categories(spark, monkeypatch):
    """The vocabulary stays a table and is joined by shuffle."""
    df = category_rows(spark, 120_000, 60_000)
    space = prep.fit_features(df, {"big": "one_hot_encoding"}, min_frequency=2)
    assert space.hot_width > 55_000 and not space.vocab["big"]
    ready = space.apply(df, ["row_id", "y"])
    assert ready.selectExpr("count(*)", f"min(size({prep.HOT}))", f"count(DISTINCT {prep.HOT})").first()[:2] == (120_000, 1)
    model = LinearCV("regression").fit_fixed(ready, space.features, 1.0, None, space.hot, space.hot_width)
    assert model.weights.shape == (1, len(space.features) + space.hot_width + 1)
