"""Store, recipes and the grid runner end to end on a tiny dataset."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspark.dataset import Dataset, Spec
from foldspark.operators.metrics import score_groups
from foldspark.operators.splits import Splitter
from foldspark.plans import recipes as C
from foldspark.store import Store

SCORING = C.Scoring(n_bootstraps=2, method="poisson")


def make(spark, task):
    rng = np.random.default_rng(3)
    n = 240
    x = rng.normal(size=(n, 2))
    cat = rng.choice(["u", "v", "w"], n)
    z = x[:, 0] + (cat == "u") + 0.2 * rng.normal(size=n)
    y = {"regression": z, "binary": np.where(z > 0.3, "yes", "no"),
         "multiclass": np.where(z > 0.8, "p", np.where(z > 0, "q", "r"))}[task]
    classes = {"regression": (), "binary": ("no", "yes"), "multiclass": ("p", "q", "r")}[task]
    kind = "double" if task == "regression" else "string"
    data = [(i, float(x[i, 0]), float(x[i, 1]), str(cat[i]), float(y[i]) if kind == "double" else str(y[i]), i % 10) for i in range(n)]
    df = spark.createDataFrame(data, f"row_id long, a double, b double, c string, y {kind}, fold int")
    return Dataset(df, Spec(f"tiny_{task}", task, ("a", "b"), ("c",), classes))


def full_score(scores, subset, metric):
    return scores.filter((F.col("subset") == subset) & (F.col("metric") == metric) & F.col("bootstrap_seed").isNull()).first()["score"]


def test_dataset_folds_and_reversal(spark):
    data = make(spark, "binary")
    one, back = data.set_fold(4), data.set_fold(4, reversed_=True)
    assert one.subset("test").count() == 24 and back.subset("trainval").count() == 24
    assert one.subset("test").join(one.subset("trainval"), "row_id", "left_semi").isEmpty()
    split = one.split(Splitter("holdout", val_ratio=0.25))
    assert split.subset("val").count() == 54 and split.metadata["split"] == "holdout0.25_seed0"


def test_store_round_trip_and_grid(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.save_dataset(make(spark, "regression"))
    assert {r["name"] for r in store.list_datasets().collect()} == {"tiny_regression", "tiny_regression[rev]"}
    assert store.load_dataset("tiny_regression[rev]", 0).subset("test").count() == 216
    names = ["Linear_l2_num_standard", "Boosting_init[Linear_l2_num_standard:none:predictions]"]
    out = C.run_grid(store, store.list_datasets(rev=False), [0], names, splits=["none", "cv5_seed0_fold0"], scoring=SCORING,
                     overrides={"max_rounds": 3, "patience": 1, "recut": 1, "depth": 2}, skip_failed=False)
    assert {r["status"] for r in out.collect()} == {"done"} and out.count() == 2
    again = C.run_grid(store, store.list_datasets(rev=False), [0], names, splits=["none", "cv5_seed0_fold0"], scoring=SCORING)
    assert again.isEmpty()
    key = ("tiny_regression", 0, "Linear_l2_num_standard", "none")
    assert store.result_exists(key) and full_score(store.load_field(key, "scores"), "test", "r2") > 0.3
    assert store.load_field(key, "nothing") is None
    table = store.summary({"linear": ("Linear_l2_num_standard", "none", "test", "r2")}, folds=[0, 1], explode_folds=True)
    assert table.filter("dataset = 'tiny_regression' and fold = 0").first()["linear"] > 0.3
    assert store.readiness().count() == 1
    store.delete_result(key)
    assert not store.result_exists(key)


@pytest.mark.parametrize("name,task", [("Linear_l2_OHE_standard", "binary"), ("Linear_l2_TE_standard", "multiclass"),
                                       ("SingleFeature_Num_Tree3Leaves", "binary"), ("SingleFeature_Num_Correlation", "multiclass"),
                                       ("SingleFeature_Num_Linear_QuantileUniform", "binary")])
def test_recipes(spark, name, task):
    one = C.make(name)
    one.scoring = SCORING
    out = one.run(make(spark, task).set_fold(0), {})
    if "scores" in out:
        prior = C.make("ConstantPredictor")
        prior.scoring = SCORING
        base = prior.run(make(spark, task).set_fold(0), {})["scores"]
        assert full_score(out["scores"], "test", "neg_log_loss") > full_score(base, "test", "neg_log_loss")
    else:
        assert next(iter(out.values())).count() > 0


def test_empty_feature_set_gives_no_ranking(spark):
    """Only the dummy column is left: AUC is exactly one half."""
    data = make(spark, "binary")
    bare = Dataset(data.frame.drop("a", "b"), Spec("bare", "binary", (), ("c",), ("no", "yes"))).set_fold(0)
    one = C.make("Linear_l2_num_standard")
    one.scoring = SCORING
    preds = one.run(bare, {})["predictions"].join(bare.coded().frame.select("row_id", "y"), "row_id").withColumn("g", F.lit(1))
    assert score_groups(preds, ["g"], ["roc_auc"], 2).first()["score"] == 0.5
