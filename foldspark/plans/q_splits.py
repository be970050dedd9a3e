"""Queries: row assignment, subsets and their checks."""

from pyspark.sql import functions as F

from ..operators import rows as R
from ..operators import splits as K
from . import sqltext as S
from . import views as V
from .registry import query

_HASH0 = S.u32(0, "row_id")


@query("load_dataset_fold", S.with_views("v_reg") + """
SELECT row_id, c_acctbal, n_year, n_mod, o_orderpriority, y, CASE WHEN fold = 3 THEN 'test' ELSE 'trainval' END AS subset
FROM v_reg""")
def load_dataset_fold(t):
    return K.set_fold(V.v_reg(t), 3).select(
        "row_id", "c_acctbal", "n_year", "n_mod", "o_orderpriority", "y", "subset")


@query("set_fold", """
SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 10 = 4 THEN 'test' ELSE 'trainval' END AS subset FROM orders""")
def set_fold(t):
    return K.set_fold(V._order_rows(t), 4).select("row_id", "subset")


@query("set_fold_reversed", """
SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 10 = 4 THEN 'trainval' ELSE 'test' END AS subset FROM orders""")
def set_fold_reversed(t):
    return K.set_fold(V._order_rows(t), 4, reversed_=True).select("row_id", "subset")


@query("fold_assignment", """
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n_rows, CAST(sum(CAST(times <> 1 AS BIGINT)) AS BIGINT) AS n_bad
FROM (SELECT o_orderkey, count(*) AS times, min(o_orderkey % 10) AS fold FROM orders GROUP BY 1) GROUP BY 1""")
def fold_assignment(t):
    return R.fold_coverage(V._order_rows(t))


@query("xy_projection", S.with_views("v_bin") + """
SELECT row_id, c_acctbal, n_year, n_mod, o_orderpriority, o_orderstatus, c_mktsegment, y AS "TARGET" FROM v_bin""")
def xy_projection(t):
    return R.xy(V.v_bin(t), V.NUM + V.CAT)


@query("subset_rows", """
SELECT o_orderkey AS row_id, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 0""")
def subset_rows(t):
    df = t.orders.select(F.col("o_orderkey").alias("row_id"), "o_totalprice", "o_orderstatus")
    subsets = K.set_fold(V._order_rows(t), 0).select("row_id", "subset")
    return R.subset_rows(df, subsets, "trainval")


@query("subset_by_ids", """
SELECT CAST(l_partkey AS BIGINT) AS row_id, p_brand, p_retailprice, count(*) AS n_positions,
  CAST(sum(l_orderkey) AS BIGINT) AS sum_pos
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def subset_by_ids(t):
    """Parts looked up by the id list of the line items: the list repeats ids and order is a column."""
    ids = t.lineitem.select(F.col("l_orderkey").alias("pos"), F.col("l_partkey").alias("row_id"))
    parts = t.part.select(F.col("p_partkey").alias("row_id"), "p_brand", "p_retailprice")
    return R.rows_by_ids(parts, ids).groupBy("row_id", "p_brand", "p_retailprice").agg(
        F.count(F.lit(1)).alias("n_positions"), F.sum("pos").alias("sum_pos"))


@query("label_codes", S.with_views("v_mc_signal") + """
SELECT row_id, y, CAST(dense_rank() OVER (ORDER BY y) - 1 AS INTEGER) AS label_code FROM v_mc_signal""")
def label_codes(t):
    return R.label_codes(V.v_mc_signal(t).select("row_id", "y"))


@query("unseen_test_classes", S.with_views("v_rare") + """
SELECT DISTINCT cat AS y FROM v_rare WHERE fold = 0 AND cat NOT IN (SELECT cat FROM v_rare WHERE fold <> 0)""")
def unseen_test_classes(t):
    df = K.set_fold(V.v_rare(t).select("row_id", F.col("cat").alias("y"), "fold"), 0)
    return R.unseen_labels(df)


@query("predictions_subset", S.with_views("p_reg") + "SELECT row_id, y, pred_a FROM p_reg WHERE subset = 'test'")
def predictions_subset(t):
    return V.p_reg(t).filter(F.col("subset") == "test").select("row_id", "y", "pred_a")


@query("validate_predictions", S.with_views("p_mc") + """
SELECT count(*) FILTER (WHERE NOT has_p) AS missing_pred, count(*) FILTER (WHERE NOT has_t) AS missing_truth,
  count(*) FILTER (WHERE has_p AND len(p) <> 3) AS wrong_size, count(*) FILTER (WHERE has_p AND p IS NULL) AS null_pred,
  count(*) FILTER (WHERE has_t AND y IS NULL) AS null_truth, count(*) AS n_rows
FROM (SELECT a.row_id IS NOT NULL AS has_p, b.row_id IS NOT NULL AS has_t, a.p, b.y FROM
  (SELECT row_id, CASE WHEN row_id % 7 = 0 THEN logits[1:2] ELSE logits END AS p FROM p_mc WHERE row_id % 5 <> 0) a
  FULL JOIN (SELECT row_id, y FROM p_mc WHERE row_id % 11 <> 0) b ON a.row_id = b.row_id)""")
def validate_predictions(t):
    """Damaged copies of a prediction and a truth table, so that every defect occurs."""
    p = V.p_mc(t)
    rid = F.col("row_id")
    preds = p.filter(rid % 5 != 0).select(
        "row_id", F.when(rid % 7 == 0, F.slice("logits", 1, 2)).otherwise(F.col("logits")).alias("pred"))
    return R.validate_predictions(preds, p.filter(rid % 11 != 0), "multiclass", 3)


def _holdout_sql(view: str, part: str = "") -> str:
    return S.with_views(view) + f"""
SELECT row_id, CASE WHEN rn <= ceil(0.2 * n) THEN 'val' ELSE 'train' END AS subset FROM (
  SELECT row_id, row_number() OVER ({part} ORDER BY {_HASH0}, row_id) AS rn, count(*) OVER ({part}) AS n FROM {view})"""


@query("holdout_split", _holdout_sql("v_reg"))
def holdout_split(t):
    return K.holdout(V.v_reg(t).select("row_id"), 0.2, 0).select("row_id", "subset")


@query("holdout_stratified", _holdout_sql("v_mc_signal", "PARTITION BY y"))
def holdout_stratified(t):
    return K.holdout(V.v_mc_signal(t).select("row_id", "y"), 0.2, 0, label="y").select("row_id", "subset")


@query("holdout_all_classes", S.with_views("v_rare", more=f"""
h AS MATERIALIZED (SELECT row_id, cat, hk, CASE WHEN rn <= ceil(0.7 * n) THEN 'val' ELSE 'train' END AS subset FROM (
  SELECT row_id, cat, hk, row_number() OVER (ORDER BY hk, row_id) AS rn, count(*) OVER () AS n
  FROM (SELECT row_id, cat, {S.u32(5, 'row_id')} AS hk FROM v_rare)))""") + """
SELECT h.row_id, h.cat, CASE WHEN h.row_id = m.row_id THEN 'train' ELSE h.subset END AS subset
FROM h LEFT JOIN (SELECT cat, arg_min(row_id, (hk, row_id)) AS row_id FROM h GROUP BY cat
  HAVING count(*) FILTER (WHERE subset = 'train') = 0) m USING (cat)""")
def holdout_all_classes(t):
    df = V.v_rare(t).select("row_id", "cat")
    return K.holdout(df, 0.7, 5, ensure_all_classes=True, classes="cat").select("row_id", "cat", "subset")


@query("kfold_split", f"""
SELECT row_id, CAST(ntile(5) OVER (ORDER BY {S.u32(1, 'row_id')}, row_id) - 1 AS INTEGER) AS cv_fold
FROM (SELECT o_orderkey AS row_id FROM orders)""")
def kfold_split(t):
    return K.kfold(t.orders.select(F.col("o_orderkey").alias("row_id")), 5, seed=1)


@query("kfold_contiguous", """
SELECT o_orderkey AS row_id, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS cv_fold FROM orders""")
def kfold_contiguous(t):
    return K.kfold(t.orders.select(F.col("o_orderkey").alias("row_id")), 5, seed=None)


def strat_cte(source: str, label: str, k: int, order: str, name: str = "folds") -> str:
    """CTEs giving the stratified fold of each row by the block rule."""
    return f"""
blk AS MATERIALIZED (SELECT lab, n, CAST(coalesce(sum(n) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
  FROM (SELECT {label} AS lab, count(*) AS n, min(row_id) AS f FROM {source} GROUP BY 1)),
rng AS MATERIALIZED (SELECT lab, i, sum(a) OVER (PARTITION BY lab ORDER BY i) AS hi FROM (
  SELECT lab, i, CAST(floor((s + n - 1 - i) / {k}.0) - floor((s - 1 - i) / {k}.0) AS BIGINT) AS a
  FROM blk, (SELECT unnest(range({k})) AS i))),
{name} AS MATERIALIZED (SELECT row_id, lab, CAST((SELECT count(*) FROM rng g WHERE g.lab = r.lab AND g.hi < r.rn) AS INTEGER) AS cv_fold
  FROM (SELECT row_id, {label} AS lab, row_number() OVER (PARTITION BY {label} ORDER BY {order}) AS rn FROM {source}) r)"""


@query("stratified_kfold", S.with_views("v_mc_signal", more=strat_cte("v_mc_signal", "y", 5, S.u32(2, "row_id") + ", row_id"))
       + "SELECT row_id, lab AS y, cv_fold FROM folds")
def stratified_kfold(t):
    return K.stratified_kfold(V.v_mc_signal(t).select("row_id", "y"), 5, "y", seed=2)


@query("kfold_contiguous_stratified", S.with_views("v_bin", more=strat_cte("v_bin", "y", 5, "row_id"))
       + "SELECT row_id, lab AS y, cv_fold FROM folds")
def kfold_contiguous_stratified(t):
    return K.stratified_kfold(V.v_bin(t).select("row_id", "y"), 5, "y", seed=None)


@query("kfold_all_classes", S.with_views("v_rare", more=f"""
f AS MATERIALIZED (SELECT row_id, cat, CAST(ntile(5) OVER (ORDER BY {S.u32(3, 'row_id')}, row_id) - 1 AS INTEGER) AS cv_fold FROM v_rare),
m AS MATERIALIZED (SELECT cat, count(*) AS n, min(cv_fold) AS lo, max(cv_fold) AS hi, min(row_id) AS move FROM f GROUP BY cat)""") + """
SELECT f.row_id, f.cat, CAST(CASE WHEN n > 1 AND lo = hi AND f.row_id = move THEN CASE WHEN lo = 0 THEN 1 ELSE 0 END
  ELSE f.cv_fold END AS INTEGER) AS cv_fold, n = 1 AS is_error FROM f JOIN m USING (cat)""")
def kfold_all_classes(t):
    df = V.v_rare(t).select("row_id", "cat")
    out = K.spread_lonely_classes(K.kfold(df, 5, seed=3), "cat")
    alone = K.ranks.fit_small(K.singleton_classes(df, "cat").select("cat", F.lit(True).alias("is_error")))
    return out.join(alone, "cat", "left").select(
        "row_id", "cat", "cv_fold", F.coalesce("is_error", F.lit(False)).alias("is_error"))


@query("cv_train_val", f"""
SELECT row_id, CASE WHEN cv_fold = 2 THEN 'val' ELSE 'train' END AS subset FROM (
  SELECT row_id, ntile(5) OVER (ORDER BY {S.u32(1, 'row_id')}, row_id) - 1 AS cv_fold
  FROM (SELECT o_orderkey AS row_id FROM orders))""")
def cv_train_val(t):
    folds = K.kfold(t.orders.select(F.col("o_orderkey").alias("row_id")), 5, seed=1)
    return K.train_val(folds, 2).select("row_id", "subset")


@query("nested_split", f"""
WITH o AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 10 = 0 THEN 'test' ELSE 'trainval' END AS s FROM orders),
tv AS MATERIALIZED (SELECT row_id, row_number() OVER (ORDER BY {_HASH0}, row_id) AS rn, count(*) OVER () AS n FROM o WHERE s = 'trainval'),
h AS MATERIALIZED (SELECT row_id, CASE WHEN rn <= ceil(0.1 * n) THEN 'val' ELSE 'train' END AS s FROM tv),
k AS (SELECT row_id, ntile(3) OVER (ORDER BY {_HASH0}, row_id) - 1 AS f FROM h WHERE s = 'train')
SELECT subset, lineage, count(*) AS n_rows, CAST(sum(row_id) AS BIGINT) AS sum_ids FROM (
  SELECT row_id, s AS subset FROM o UNION ALL SELECT row_id, s FROM h
  UNION ALL SELECT row_id, 'inner_val' FROM k WHERE f = 1),
  (SELECT 'holdout0.1_seed0;cv3_seed0_fold1' AS lineage) GROUP BY ALL""")
def nested_split(t):
    """Outer fold, then a holdout of trainval, then one fold of the new train part; train side of it discarded."""
    rows_ = V._order_rows(t)
    subsets = K.set_fold(rows_, 0).select("row_id", "subset")
    outer = K.Splitter("holdout", val_ratio=0.1)
    inner = K.Splitter("cv", n_folds=3, fold_idx=1, from_subset="train", to_subsets=(None, "inner_val"))
    for s in (outer, inner):
        subsets = s.split(subsets, rows_.select("row_id"))
    return subsets.withColumn("lineage", F.lit(K.lineage(outer, inner))).groupBy("subset", "lineage").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("row_id").alias("sum_ids"))


@query("parse_split_names", S.with_views("v_runs") + r"""
SELECT split, CASE WHEN split LIKE 'holdout%' THEN 'holdout' WHEN split LIKE 'cv%' THEN 'cv' ELSE 'none' END AS method,
  CAST(nullif(regexp_extract(split, '^holdout([0-9.]+)_seed([0-9]+)$', 1), '') AS DOUBLE) AS val_ratio,
  CAST(nullif(regexp_extract(split, '^cv([0-9]+)_seed([0-9]+)_fold([0-9]+)$', 1), '') AS INTEGER) AS n_folds,
  CAST(nullif(regexp_extract(split, '_seed([0-9]+)', 1), '') AS INTEGER) AS random_seed,
  CAST(nullif(regexp_extract(split, '_fold([0-9]+)$', 1), '') AS INTEGER) AS fold_idx, count(*) AS n_runs
FROM v_runs GROUP BY ALL""")
def parse_split_names(t):
    per = V.v_runs(t).groupBy("split").agg(F.count(F.lit(1)).alias("n_runs"))
    return K.parse_split_column(per)


@query("subset_difference", f"""
SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY {_HASH0}, row_id) AS rn, count(*) OVER () AS n
  FROM (SELECT o_orderkey AS row_id FROM orders)) WHERE rn > ceil(0.2 * n)""")
def subset_difference(t):
    """Whole table minus the val rows of a holdout."""
    rows_ = t.orders.select(F.col("o_orderkey").alias("row_id"))
    whole = rows_.withColumn("subset", F.lit("trainval"))
    return R.subset_difference(whole.unionByName(K.holdout(rows_, 0.2, 0)), "trainval", "val")


@query("subset_checks", "SELECT 0::BIGINT AS n_overlap, 0::BIGINT AS n_differ, count(*) AS n_whole FROM orders")
def subset_checks(t):
    """Train and val of a holdout are disjoint and make up the whole table."""
    rows_ = t.orders.select(F.col("o_orderkey").alias("row_id"))
    whole = rows_.withColumn("subset", F.lit("trainval"))
    return R.subset_checks(whole.unionByName(K.holdout(rows_, 0.2, 0)), ["train", "val"], "trainval")


@query("dataset_describe", """
SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'test' ELSE 'trainval' END AS subset, count(*) AS n_rows,
  CAST(6 AS INTEGER) AS n_features, 'regression' AS task_type FROM orders GROUP BY 1""")
def dataset_describe(t):
    return R.describe(K.set_fold(V._order_rows(t), 0), V.NUM + V.CAT, "regression")


@query("infer_column_roles", S.with_views("v_nulls") + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, '{d}' AS dtype, count({c}) AS n_present,
  CASE WHEN '{d}' = 'string' OR count(DISTINCT {c}) <= 2 THEN 'category' ELSE 'numeric' END AS role FROM v_nulls\n"""
    for c, d in [("c_acctbal", "double"), ("n_year", "double"), ("n_mod", "double"), ("o_orderpriority", "string"),
                 ("o_orderstatus", "string"), ("c_mktsegment", "string")]))
def infer_column_roles(t):
    return R.infer_roles(V.v_nulls(t).select("row_id", *V.NUM, *V.CAT))


@query("feature_roles", """
SELECT role, string_agg(feature, ',' ORDER BY feature) AS features FROM (
  SELECT 'quality' AS feature, CASE WHEN count(DISTINCT quality) <= 2 THEN 'category' ELSE 'numeric' END AS role FROM labels
  UNION ALL SELECT 'toxic', CASE WHEN count(DISTINCT toxic) <= 2 THEN 'category' ELSE 'numeric' END FROM labels
  UNION ALL SELECT 'n_chars', CASE WHEN count(DISTINCT n_chars) <= 2 THEN 'category' ELSE 'numeric' END
    FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT 'lang', 'category' UNION ALL SELECT 'source', 'category') GROUP BY role""")
def feature_roles(t):
    """Numeric and category feature lists; a numeric column with two values is a category."""
    df = t.documents.join(t.labels, "doc_id").select("lang", "source", "n_chars", "quality", "toxic")
    roles = R.infer_roles(df)
    return roles.groupBy("role").agg(F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("features"))


@query("infer_task_type", S.with_views("v_reg", "v_bin", "v_mc_signal") + """
SELECT 'v_reg' AS target, count(DISTINCT y) AS n_classes, 'regression' AS task_type FROM v_reg
UNION ALL SELECT 'v_bin', count(DISTINCT y), CASE WHEN count(DISTINCT y) = 2 THEN 'binary' WHEN count(DISTINCT y) > 2 THEN 'multiclass' END FROM v_bin
UNION ALL SELECT 'v_mc_signal', count(DISTINCT y), CASE WHEN count(DISTINCT y) = 2 THEN 'binary' WHEN count(DISTINCT y) > 2 THEN 'multiclass' END FROM v_mc_signal""")
def infer_task_type(t):
    out = None
    for name in ("v_reg", "v_bin", "v_mc_signal"):
        one = R.infer_task_type(getattr(V, name)(t).select("y")).select(F.lit(name).alias("target"), "*")
        out = one if out is None else out.unionByName(one)
    return out
