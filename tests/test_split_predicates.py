"""Splits as predicates: the same rows as by id, without a join on ids."""

import pytest
from pyspark.sql import functions as F

from foldspark.dataset import Dataset, Spec
from foldspark.operators.splits import Splitter, kfold

SPLITS = ["holdout0.3_seed1", "cv5_seed0_fold2", "cv3_seed4_fold0", "none"]


def data(spark, task):
    y = "id % 7 + 0.0D" if task == "regression" else "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 5 = 0 THEN 'a' ELSE 'b' END"
    df = spark.range(500).selectExpr("id * 3 AS row_id", "id AS key", "id % 4 AS _x", f"{y} AS y", "CAST(id % 10 AS int) AS fold")
    return Dataset(df.repartition(3), Spec("d", task, ("key", "_x"), (), () if task == "regression" else ("a", "b"))).set_fold(3)


@pytest.mark.parametrize("task", ["regression", "binary"])
@pytest.mark.parametrize("name", SPLITS)
def test_the_same_rows_as_by_id(spark, task, name):
    one, split = data(spark, task), Splitter.from_string(name)
    got = one.split(split).frame
    label = None if task == "regression" else "y"
    by_id = split.assign(one.subset("trainval").select("row_id", *([label] if label else [])), label)
    want = {r["row_id"]: r["subset"] for r in by_id.collect()} if name != "none" else {}
    rows = got.collect()
    assert got.columns == one.frame.columns and len(rows) == 500
    for r in rows:
        assert r["part"] == ("test" if r["fold"] == 3 else want.get(r["row_id"], "train")) and r["key"] * 3 == r["row_id"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan or task == "binary" and "row_id" not in plan.split("Join")[1].split("\n")[0]


def test_nested_and_discarded_sides(spark):
    one = data(spark, "binary").split(Splitter("holdout", 0.2)).split(Splitter("cv", from_subset="train", to_subsets=("train", None)))
    counts = {r["part"]: r["count"] for r in one.frame.groupBy("part").count().collect()}
    assert counts["test"] == 50 and counts["val"] == 90 and counts["train"] == 288
    whole = data(spark, "binary").split(Splitter("cv", n_folds=4, ensure_all_classes=True))
    assert whole.subset("val").count() + whole.subset("train").count() == 450


def test_folds_of_other_rows(spark):
    df = spark.range(100).selectExpr("id AS row_id")
    for seed in (0, None):
        inside = df.filter("row_id % 2 = 0")
        want = {r["row_id"]: r["cv_fold"] for r in kfold(inside, 4, seed).collect()}
        got = {r["row_id"]: r["cv_fold"] for r in kfold(inside, 4, seed, to=df).collect()}
        assert len(got) == 100 and all(got[i] == f for i, f in want.items()) and set(got.values()) == {0, 1, 2, 3}
    none = kfold(df.limit(0), 4, 0, to=df)
    assert none.agg(F.max("cv_fold")).first()[0] == 0


def test_comparisons_are_generated_code(spark):
    """Folds are counted without a function over arrays, which Spark interprets row by row."""
    rows = spark.range(50).select(F.col("id").alias("row_id"))
    plan = kfold(rows, 5, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan
