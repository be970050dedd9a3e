"""Results do not depend on size, and NULL labels, groups and empty folds keep their rows."""

import pytest
from pyspark.sql import functions as F

from foldspark import session
from foldspark.functions.hashing import with_u32, with_u63
from foldspark.operators import metrics, prep, ranks, screen, splits
from foldspark.operators import scores as S


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.range(100).select(F.col("id").alias("row_id"), F.when(F.col("id") % 10 != 0, F.col("id") % 3).alias("y"))


def test_rows_without_a_label_stay(labelled):
    assert splits.holdout(labelled, 0.2, label="y").count() == 100
    for seed in (0, None):
        folds = splits.stratified_kfold(labelled, 5, "y", seed)
        assert folds.count() == 100
        per = folds.filter("y is null").groupBy("cv_fold").count().collect()
        assert sorted(r["count"] for r in per) == [2] * 5


def test_ids_above_32_bits_part(spark):
    low = spark.range(4000)
    ids = low.union(low.select((F.col("id") + (1 << 32)).alias("id"))).union(low.select((F.col("id") + (5 << 33)).alias("id")))
    hashed = with_u32(ids.withColumnRenamed("id", "row_id"), {"a": 1, "b": 2})
    assert hashed.groupBy("a", "b").count().filter("count > 1").count() == 0
    assert hashed.agg(F.avg("a")).first()[0] / (1 << 32) == pytest.approx(0.5, abs=0.02)
    wide = with_u63(ids.withColumnRenamed("id", "row_id"), "u", F.lit(3), "row_id")
    assert wide.select("u").distinct().count() == 12_000


def test_null_groups_in_large_and_small_form(spark, small_ranks):
    df = spark.range(400).select((F.col("id") % 2 == 0).alias("even"), (F.col("id") % 17).cast("double").alias("v"), F.lit(1).alias("one"))
    df = df.select(F.when(F.col("even"), F.lit("a")).alias("g"), "v", "one").repartition(4)
    large = ranks.running_sums(df, ["g"], "v", ["one"]), ranks.exact_quantiles(df, ["g"], "v", [0.25, 0.5])
    rows = [sorted(map(str, x.collect())) for x in large]
    spark.conf.set("foldspark.rank.plainBytes", str(1 << 40))
    plain = ranks.running_sums(df, ["g"], "v", ["one"]), ranks.exact_quantiles(df, ["g"], "v", [0.25, 0.5])
    assert rows == [sorted(map(str, x.collect())) for x in plain]
    assert len(rows[0]) == 400 and len(rows[1]) == 2


def test_a_group_without_truth_keeps_its_row(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.5), ("b", None, 1.0), (None, 3.0, 3.0), (None, 4.0, 4.5)], "g string, y double, pred double")
    got = {(r.g, r.metric): r.score for r in metrics.score_groups(df, ["g"], ["r2", "d2_absolute_error"]).collect()}
    assert len(got) == 6 and got["b", "r2"] is None and got["b", "d2_absolute_error"] is None
    assert got[None, "d2_absolute_error"] == pytest.approx(0.5)
    assert metrics.median_absolute_error(df, ["g"]).count() == 3
    assert metrics.quantile_mse_d2(df.filter("y is not null"), ["g"]).count() == 2


def test_a_feature_seen_in_one_fold_only(spark):
    rows = spark.range(100).select(F.col("id").alias("row_id"), F.lit("f").alias("feature"), (F.col("id") % 5).cast("int").alias("cv_fold"),
                                   F.when(F.col("id") % 5 == 0, F.col("id").cast("double")).alias("x"), F.col("id").cast("double").alias("y"))
    lines = screen.line_predictions(rows)
    assert lines.count() == 100 and lines.filter("pred is null").count() == 0
    assert screen.tree_predictions(rows, [F.col("y")], 2).count() == 100
    assert screen.tree_predictions(rows, [F.col("y")], 3).count() == 100
    assert prep.cross_quantiles(rows, "quantile_uniform", 5).count() == 500


def test_score_tables_of_two_tasks_do_not_join(spark):
    a = spark.createDataFrame([(1,)], "x int")
    assert S.concat(a, a, tasks=["binary", "binary"]).count() == 2
    with pytest.raises(ValueError):
        S.concat(a, a, tasks=["binary", "regression"])
    with pytest.raises(ValueError):
        S.concat(a, a.withColumnRenamed("x", "z"))


def test_scratch_needs_a_shared_folder():
    assert session.local_folder("local[4]") and session.local_folder("local")
    for master in ("local-cluster[2,1,1024]", "yarn", "spark://host:7077", "k8s://https://host"):
        with pytest.raises(ValueError):
            session.local_folder(master)


def test_only_kept_tables_are_removed(spark):
    table, path = session.kept_table(spark.range(3).toDF("id"))
    assert table.count() == 3
    session.remove_table(spark, path)
    with pytest.raises(ValueError):
        session.remove_table(spark, "/tmp/other")
