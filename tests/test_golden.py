"""Hand-computed values and invariants."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from foldspark.dataset import Dataset, Predictions, Spec
from foldspark.functions import normal, pvalue, scalar
from foldspark.functions.hashing import with_u32
from foldspark.operators import curves, gram, logistic, metrics, prep, ranks, resample, rows, screen
from foldspark.operators import scores as S
from foldspark.operators import splits as K
from foldspark.sources import ledger as L
from foldspark.sources import tables as T
from foldspark.store import check_name


def preds(spark, values, task, n_classes=None, t=None):
    return Predictions(spark.createDataFrame(values, "row_id long, subset string, y double, pred double"
                                             if task == "regression" else
                                             "row_id long, subset string, y int, pred double"), task, n_classes, t)


def test_r2_by_subset(spark):
    p = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    y = [0.0, 1.0, 2.0, 3.0, 4.0, 4.0]
    part = ["train", "train", "val", "test", "test", "test"]
    x = preds(spark, [(i, part[i], y[i], p[i]) for i in range(6)], "regression")
    assert x.score("r2") == pytest.approx(0.925)
    assert x.subset("train").score("r2") == pytest.approx(1)
    assert x.subset("trainval").score("r2") == pytest.approx(1)
    assert x.subset("test").score("r2") == pytest.approx(-0.5)


def test_degenerate_regression(spark):
    flat = [(i, "test", 2.0, 2.0 if i else 3.0) for i in range(3)]
    assert preds(spark, flat, "regression").score("r2") == 0.0
    exact = [(i, "test", 2.0, 2.0) for i in range(3)]
    assert preds(spark, exact, "regression").score("d2_absolute_error") == 1.0
    assert preds(spark, [(0, "test", 1.0, 1.0)], "regression").score("r2") is None
    inf = [(0, "test", 1.0, float("inf")), (1, "test", 2.0, 1.0)]
    assert preds(spark, inf, "regression").score("r2") is None


def test_binary(spark):
    good = preds(spark, [(0, "test", 0, -1.0), (1, "test", 1, 1.0)], "binary", 2)
    assert good.score("roc_auc") == 1
    got = [r["probability"] for r in good.probabilities().orderBy("row_id").collect()]
    assert got == pytest.approx([0.26894142, 0.73105858])
    bad = preds(spark, [(0, "test", 0, 2.0), (1, "test", 1, -1.0)], "binary", 2)
    assert bad.score("roc_auc") == 0
    assert [r["probability"] for r in bad.probabilities().orderBy("row_id").collect()] == pytest.approx([0.88079708, 0.26894142])
    one_class = preds(spark, [(0, "test", 1, 2.0), (1, "test", 1, -1.0)], "binary", 2)
    assert one_class.score("roc_auc") is None and one_class.score("balanced_accuracy") is None
    huge = preds(spark, [(0, "test", 0, 1e12), (1, "test", 1, -1e12)], "binary", 2)
    assert np.isfinite(huge.score("log_loss")) and huge.score("roc_auc") == 0


@pytest.mark.parametrize("shift", [0.0, 10.0])
def test_softmax_is_shift_invariant(spark, shift):
    df = spark.createDataFrame([([-1.0 + shift, shift, 1.0 + shift],)], "x array<double>")
    assert df.select(scalar.softmax("x").alias("p")).first()["p"] == pytest.approx([0.09003057, 0.24472847, 0.66524096])


def test_averaging(spark):
    one = preds(spark, [(0, "test", 0.0, 0.0), (1, "test", 1.0, 1.0), (2, "test", 1.0, 2.0)], "regression", t=1.0)
    two = preds(spark, [(0, "test", 0.0, 0.0), (1, "test", 1.0, 1.0), (2, "test", 1.0, 0.0)], "regression")
    mean = Predictions.average([one, two])
    assert mean.score("r2") == pytest.approx(1) and mean.t is None
    first, both = Predictions.cumulative_average([one, two])
    assert first.score("r2") == pytest.approx(-0.5) and first.t == 1
    assert both.score("r2") == pytest.approx(1) and both.t is None


def test_subset_by_list_keeps_repeats(spark):
    data = Dataset(spark.createDataFrame([(i, float(i + 1)) for i in range(4)], "row_id long, y double"), Spec("d", "regression"))
    ids = spark.createDataFrame([(0, 3), (1, 0), (2, 3)], "pos int, row_id long")
    assert [r["y"] for r in data.subset_by_ids(ids).orderBy("pos").collect()] == [4.0, 1.0, 4.0]


def test_names(spark):
    names = [("aaa bbb", True, True), ("aaa bbb/ccc", False, True), ("aaa bbb?", False, False), ("aaa\\ bbb", False, False),
             ("aaa:bbb", False, False), ("aaa*bbb", False, False), ("aaa<bbb", False, False), ("aaa>bbb", False, False),
             ("aaa|bbb", False, False), ("..", False, False)]
    df = spark.createDataFrame(names, "name string, plain boolean, slash boolean")
    got = df.select("plain", "slash", scalar.valid_name("name").alias("a"), scalar.valid_name("name", allow_slash=True).alias("b"))
    assert all(r["plain"] == r["a"] and r["slash"] == r["b"] for r in got.collect())
    with pytest.raises(ValueError):
        check_name("a/b")


def test_split_names():
    for s in (K.Splitter(), K.Splitter("holdout", val_ratio=0.1), K.Splitter("cv", n_folds=7, fold_idx=3, random_seed=5)):
        assert str(K.Splitter.from_string(str(s))) == str(s)
    for bad in ("holdout0.1_seed-1", "cv5_seed0", "x"):
        with pytest.raises(ValueError):
            K.Splitter.from_string(bad)
    with pytest.raises(ValueError):
        K.Splitter("holdout", random_seed=-1)
    assert L.parse_folds("3") == [3] and L.parse_folds("2-4") == [2, 3, 4]
    with pytest.raises(ValueError):
        L.parse_folds("2-")


@pytest.mark.parametrize("n", [1, 7, 100, 1003])
def test_split_properties(spark, n):
    df = spark.range(n).withColumnRenamed("id", "row_id").withColumn("y", (F.col("row_id") % 3).cast("string"))
    small = {r["row_id"] for r in K.holdout(df, 0.1, 4).filter("subset = 'val'").collect()}
    large = {r["row_id"] for r in K.holdout(df, 0.4, 4).filter("subset = 'val'").collect()}
    assert small <= large and len(small) == -(-n // 10) and len(large) == int(np.ceil(0.4 * n))
    for folds in (K.kfold(df, 5, 1), K.kfold(df, 5, None), K.stratified_kfold(df, 5, "y", 2)):
        counts = {r["cv_fold"]: r["count"] for r in folds.groupBy("cv_fold").count().collect()}
        assert sum(counts.values()) == n and set(counts) <= set(range(5))
        sizes = [counts.get(f, 0) for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_stratified_blocks_by_hand(spark):
    """Independent numpy statement of the block rule."""
    rng = np.random.default_rng(0)
    y = rng.choice(list("bac"), size=203, p=[0.6, 0.3, 0.1])
    df = spark.createDataFrame([(i, str(c)) for i, c in enumerate(y)], "row_id long, y string")
    got = {r["row_id"]: r["cv_fold"] for r in K.stratified_kfold(df, 4, "y", None).collect()}
    seen = list(dict.fromkeys(y))
    ordered = np.sort([seen.index(c) for c in y])
    want = {}
    for k, c in enumerate(seen):
        alloc = [int(np.sum(ordered[i::4] == k)) for i in range(4)]
        for r, f in zip(np.flatnonzero(y == c), np.repeat(range(4), alloc)):
            want[int(r)] = int(f)
    assert got == want


def test_lonely_and_single_classes(spark):
    df = spark.createDataFrame([(0, "a", 1), (1, "a", 1), (2, "b", 0), (3, "b", 0), (4, "c", 2)], "row_id long, y string, cv_fold int")
    got = {r["row_id"]: r["cv_fold"] for r in K.spread_lonely_classes(df, "y").collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0, 4: 2}
    assert [r["y"] for r in K.singleton_classes(df, "y").collect()] == ["c"]


def test_best_iteration_matches_loop(spark):
    def loop(curve, patience):
        last = max(i for i, v in enumerate(curve) if v is not None)
        best, stopped = 0, False
        for i, v in enumerate(curve[:last + 1]):
            if i > best + patience:
                stopped = True
                break
            if v is not None and curve[best] is not None and v > curve[best]:
                best = i
        return best, stopped

    rng = np.random.default_rng(1)
    data = []
    for c in range(60):
        v = [None if rng.random() < 0.1 else float(x) for x in rng.integers(0, 12, 40)]
        v[5] = 3.0
        data.append(v)
    df = spark.createDataFrame([(c, s, x) for c, v in enumerate(data) for s, x in enumerate(v)], "curve_id int, step int, score double")
    got = {r["curve_id"]: (r["best_iter"], r["stopped"]) for r in curves.best_iteration(df, 6).collect()}
    assert got == {c: loop(v, 6) for c, v in enumerate(data)}


# -- rank primitives -------------------------------------------------------


def _skewed(spark):
    """A third of the rows in one group, a third of that on one value."""
    df = with_u32(spark.range(6000).withColumnRenamed("id", "row_id"), {"u": 3, "w": 4})
    g = F.when(F.col("row_id") % 3 == 0, 0).otherwise(F.col("row_id") % 50)
    v = F.when(F.col("row_id") % 9 == 0, 7.0).otherwise((F.col("u") % 1000) / 10.0)
    return df.select("row_id", g.alias("g"), v.alias("v"), (F.col("w") % 4 + 1).alias("w"))


def test_bucketed_paths_equal_plain_ones(spark, small_ranks):
    df = _skewed(spark)
    pdf = df.toPandas()
    assert ranks.bucketed(df, ["g"], "v") is not None
    for probs in ([0.5], [0.05, 0.25, 0.5, 0.95]):
        got = {r["g"]: list(r["q"]) for r in ranks.exact_quantiles(df, ["g"], "v", probs).collect()}
        for g, part in pdf.groupby("g"):
            assert got[g] == pytest.approx(list(np.quantile(part["v"], probs)))
    weighted = {r["g"]: r["q"][0] for r in ranks.exact_quantiles(df, ["g"], "v", [0.5], "w").collect()}
    for g, part in pdf.groupby("g"):
        assert weighted[g] == pytest.approx(np.median(np.repeat(part["v"], part["w"])))
    cum = ranks.running_sums(df.groupBy("g", "v").agg(F.sum("w").alias("w")), ["g"], "v", ["w"]).toPandas()
    for g, part in cum.sort_values(["g", "v"]).groupby("g"):
        assert list(part["cum_w"]) == list(part["w"].cumsum())
    idx = ranks.dense_index(df, ["g"]).toPandas()
    for _, part in idx.sort_values("row_id").groupby("g"):
        assert list(part["idx"]) == list(range(len(part)))


def test_auc_by_brute_force(spark, small_ranks):
    df = with_u32(spark.range(700).withColumnRenamed("id", "row_id"), {"a": 1, "b": 2})
    df = df.select("row_id", (F.col("a") % 3 == 0).cast("int").alias("y"), ((F.col("b") % 40) / 4.0).alias("pred"), F.lit("x").alias("g"))
    p = df.toPandas()
    pos, neg = p[p.y == 1].pred.to_numpy(), p[p.y == 0].pred.to_numpy()
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert metrics.roc_auc(df, ["g"]).first()["score"] == pytest.approx(want)


def test_exact_bootstrap_draws_n_of_n(spark):
    df = spark.range(400).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("string").alias("subset"))
    drawn = resample.resample_exact(df, ["subset"], [None, 0, 1])
    counts = {(r["subset"], r["bootstrap_seed"]): r["count"] for r in drawn.groupBy("subset", "bootstrap_seed").count().collect()}
    assert counts == {(s, b): 200 for s in "01" for b in (-1, 0, 1)}
    mean = resample.resample_poisson(df, [], list(range(50))).count() / (400 * 50)
    assert abs(mean - 1) < 0.03


# -- preparation -----------------------------------------------------------


def test_missing_words(spark):
    df = spark.createDataFrame([("None", None), (None, "x"), ("UNKNOWN", None)], "a string, b string")
    got = rows.fill_missing_category(df, ["a", "b"]).collect()
    assert [r["a"] for r in got] == ["None", "UNKNOWN", "UNKNOWN"] and [r["b"] for r in got] == ["missing", "x", "missing"]


def test_all_missing_column_is_dropped_and_constant_scales(spark):
    df = spark.createDataFrame([(0, None, 5.0), (1, None, 5.0)], "row_id long, a double, b double")
    space = prep.fit_features(df, {"a": "standard", "b": "standard"})
    out = space.apply(df, ["row_id"])
    assert space.features == ["b", "__dummy__"] and [r["b"] for r in out.collect()] == [0.0, 0.0]


def test_normal_scores():
    from statistics import NormalDist

    p = np.linspace(0.0005, 0.9995, 999)
    want = np.array([NormalDist().inv_cdf(x) for x in p])
    assert np.abs(normal.ppf(p) - want).max() < 1e-7
    assert np.abs(normal.cdf(want) - p).max() < 2e-7
    assert normal.ppf(np.array([0.0, 1.0])) == pytest.approx([-5.1993376, 5.1993376], abs=1e-6)


def test_pvalue():
    # Student t with 1 and 2 degrees of freedom have closed forms
    r = 0.5
    t1 = r * np.sqrt(1 / (1 - r * r))
    assert pvalue.pearson_p(r, 3) == pytest.approx(1 - 2 / np.pi * np.arctan(t1))
    t2 = r * np.sqrt(2 / (1 - r * r))
    assert pvalue.pearson_p(r, 4) == pytest.approx(1 - t2 / np.sqrt(2 + t2 * t2))
    assert pvalue.pearson_p(0.0, 50) == pytest.approx(1.0) and pvalue.pearson_p(0.9, 2) == 1.0


# -- models ----------------------------------------------------------------


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    x[:, 3] = 0.0
    y = x[:, 0] * 2 - x[:, 1] + 0.3 * rng.normal(size=300) + 4
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i]), i % 5, int(y[i] > 4), int(min(2, max(0, y[i] // 3))))
                                for i in range(300)], "row_id long, a double, b double, c double, d double, y double, cv_fold int, z int, k int")
    return df, x, y


COLS = ["a", "b", "c", "d"]


def test_linear_fits(table):
    df, x, y = table
    g = gram.fold_grams(df, COLS, fold="cv_fold")
    xc, yc = x - x.mean(0), y - y.mean()
    w, b = gram.ridge(g.total)
    assert np.abs(xc.T @ (yc - xc @ w)).max() < 1e-8 and w[3] == 0
    w, _ = gram.ridge(g.total, 10.0)
    assert np.abs(xc.T @ (yc - xc @ w) - 10 * w).max() < 1e-8
    w, _ = gram.elastic_net(g.total, 0.1)
    grad = xc.T @ (yc - xc @ w) / len(y)
    assert np.all(np.abs(grad) <= 0.1 + 1e-7) and np.allclose(grad[w != 0], 0.1 * np.sign(w[w != 0]), atol=1e-7)
    w, b = gram.ridge(g.without(2), 1.0)
    own = np.arange(300) % 5 == 2
    assert gram.held_out_mse(g.per_fold[2], w, b) == pytest.approx(np.mean((y[own] - x[own] @ w - b) ** 2))


def test_leave_one_out_by_refitting(table):
    df, x, y = table
    path = gram.ridge_loo_path(df, gram.fold_grams(df, COLS), [1.0, 8.0])
    for alpha, mse in path.itertuples(index=False):
        errors = []
        for i in range(len(y)):
            keep = np.arange(len(y)) != i
            # leaving a row out of a centred ridge fit: refit slope and mean without it
            mx, my = x[keep].mean(0), y[keep].mean()
            xc, yc = x[keep] - mx, y[keep] - my
            w = np.linalg.solve(xc.T @ xc + alpha * np.eye(4), xc.T @ yc)
            errors.append((y[i] - my - (x[i] - mx) @ w) ** 2)
        assert mse == pytest.approx(np.mean(errors), rel=1e-6)


def test_forward_path(table):
    df, x, y = table
    path = gram.forward_path(gram.fold_grams(df, COLS).total)
    assert [int(np.count_nonzero(w)) for w, _ in path] == [1, 2, 3] and path[0][0][0] != 0


def test_newton_is_stationary_and_agrees_with_spark_ml(table):
    df, x, _ = table
    for col, n in (("z", 2), ("k", 3)):
        task = logistic.Task(logistic.NO_FOLD, 0.5)
        w = logistic.newton_fits(df, COLS, [task], n, col)[task]
        vec = VectorAssembler(inputCols=COLS, outputCol="v").transform(df.withColumn(col, df[col].cast("double")))
        ml = LogisticRegression(featuresCol="v", labelCol=col, regParam=1 / (0.5 * df.count()), standardization=False, maxIter=200, tol=1e-8,
                                family="binomial" if n == 2 else "multinomial").fit(vec)
        other = np.column_stack([ml.coefficientMatrix.toArray(), ml.interceptVector.toArray()])
        assert np.abs((w - w.mean(0))[:, :4] - (other - other.mean(0))[:, :4]).max() < 1e-3 if n > 2 else np.abs(w - other).max() < 1e-3


def test_screening_trees_by_brute_force(spark):
    rng = np.random.default_rng(2)
    n = 120
    x = rng.integers(0, 15, n).astype(float)
    miss = rng.random(n) < 0.15
    y = np.where(x > 8, 3.0, 0.0) + np.where(miss, -4.0, 0.0) + rng.normal(size=n) * 0.1
    df = spark.createDataFrame([(i, "f", None if miss[i] else float(x[i]), float(y[i]), i % 5) for i in range(n)],
                               "row_id long, feature string, x double, y double, cv_fold int")

    def best(xs, ms, ys):
        top = (1e-12, None)
        base = ys.sum() ** 2 / len(ys)
        levels = np.unique(xs)
        for lo, hi in zip(levels, levels[1:]):
            left = xs <= lo
            gain = ys[left].sum() ** 2 / left.sum() + ys[~left].sum() ** 2 / (~left).sum() - base
            if gain > top[0] + 1e-9:
                top = (gain, ("x", (lo + hi) / 2))
        if 0 < ms.sum() < len(ms):
            gain = ys[~ms].sum() ** 2 / (~ms).sum() + ys[ms].sum() ** 2 / ms.sum() - base
            if gain > top[0] + 1e-9:
                top = (gain, ("m", 0.5))
        return top

    def side(split, xs, ms):
        return xs > split[1] if split[0] == "x" else ms

    for leaves in (2, 3):
        got = {r["row_id"]: r["value"][0] for r in screen.tree_predictions(df, [F.col("y")], leaves).collect()}
        for f in range(5):
            tr = np.arange(n) % 5 != f
            filled = np.where(miss, x[tr & ~miss].mean(), x)
            _, root = best(filled[tr], miss[tr], y[tr])
            leaf = side(root, filled, miss).astype(int) * 2
            if leaves == 3:
                options = []
                for s in (0, 2):
                    at = tr & (leaf == s)
                    options.append((*best(filled[at], miss[at], y[at]), s))
                gain, split, s = max(options, key=lambda o: o[0])
                leaf = leaf + np.where(leaf == s, side(split, filled, miss).astype(int), 0)
            for i in np.flatnonzero(~tr):
                assert got[i] == pytest.approx(y[tr & (leaf == leaf[i])].mean())


# -- scores, names, catalog ------------------------------------------------


def test_null_seed_matches_itself_and_strict_deltas(spark):
    a = spark.createDataFrame([("val", "r2", None, 0.5), ("val", "r2", 0, 0.4)], "subset string, metric string, bootstrap_seed int, score double")
    b = a.withColumn("score", F.col("score") - 0.1)
    assert sorted(round(r["score"], 6) for r in S.strict_deltas(a, b).collect()) == [0.1, 0.1]
    with pytest.raises(ValueError):
        S.strict_deltas(a, b.filter("bootstrap_seed is null"))
    assert S.get_value(a, "val", "r2") == 0.5
    with pytest.raises(KeyError):
        S.get_value(a, "val", "r2", 7)


def test_catalog_file_and_filters(spark, tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text('{"a": {"task_type": "BINARY", "n_samples": 100, "n_samples_trainval": 90, "n_samples_test": 10, "n_features": 4},'
                    ' "b[x]": {"task_type": "regression", "n_samples": 50, "n_samples_trainval": 45, "n_samples_test": 5, "n_features": 9}}')
    cat = T.with_reversed(T.read_catalog(spark, str(path)))
    assert cat.filter("name = 'a[rev]'").first()["n_samples_trainval"] == 10
    keep = T.filter_catalog(cat, exclude=["b[x]"], min_trainval_samples=10, max_trainval_samples=90)
    assert {r["name"] for r in keep.collect()} == {"a[rev]"}
