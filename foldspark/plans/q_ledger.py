"""Queries: catalog, ledger, grids, names."""

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..sources import ledger as L
from ..sources import tables as T
from . import sqltext as S
from . import views as V
from .registry import query

# Dataset name, table, id column, task type, feature count.
DATASETS = [
    ("orders", "o_orderkey", "regression", 6), ("customer", "c_custkey", "regression", 4),
    ("part", "p_partkey", "regression", 5), ("supplier", "s_suppkey", "binary", 3),
    ("lineitem", "l_orderkey", "multiclass", 10), ("events", "event_id", "multiclass", 5),
    ("embeddings", "vec_id", "multiclass", 64), ("documents", "doc_id", "multiclass", 4),
]


def _catalog(t):
    return T.catalog_of([
        T.catalog_row(getattr(t, name).select((F.col(key) % 10).alias("fold")), name, task, n)
        for name, key, task, n in DATASETS])


CATALOG_SQL = " UNION ALL ".join(
    f"""SELECT '{name}' AS name, '{task}' AS task_type, count(*) AS n_samples,
  count(*) FILTER (WHERE {key} % 10 <> 0) AS n_samples_trainval, count(*) FILTER (WHERE {key} % 10 = 0) AS n_samples_test,
  CAST({n} AS INTEGER) AS n_features FROM {name}\n""" for name, key, task, n in DATASETS)
_REV = f"""WITH c AS ({CATALOG_SQL}), r AS (SELECT * FROM c UNION ALL
SELECT name || '[rev]', task_type, n_samples, n_samples_test, n_samples_trainval, n_features FROM c)"""


@query("catalog_scan", CATALOG_SQL)
def catalog_scan(t):
    return _catalog(t)


@query("catalog_with_reversed", _REV + " SELECT * FROM r")
def catalog_with_reversed(t):
    return T.with_reversed(_catalog(t))


@query("catalog_filter", _REV + """ SELECT name, task_type, n_features FROM r WHERE NOT (name LIKE 'p%' OR name = 'customer[rev]')
AND task_type IN ('regression', 'multiclass') AND n_samples_trainval >= 60 AND n_samples_trainval < 100000
AND n_features >= 4 AND n_features < 64""")
def catalog_filter(t):
    return T.filter_catalog(T.with_reversed(_catalog(t)), ["p*", "customer[rev]"], ["regression", "multiclass"],
                            60, 100_000, 4, 64).select("name", "task_type", "n_features")


@query("large_dataset_flag", f"""WITH c AS ({CATALOG_SQL})
SELECT name, n_samples * sqrt(n_features) * CASE WHEN task_type = 'regression' THEN 1 WHEN task_type = 'binary' THEN 2 ELSE 3 END > 1000000 AS is_large FROM c""")
def large_dataset_flag(t):
    classes = F.when(F.col("task_type") == "regression", 1).when(F.col("task_type") == "binary", 2).otherwise(3)
    return T.large_dataset_flag(_catalog(t).withColumn("n_classes", classes)).select("name", "is_large")


@query("dataset_roundtrip", S.with_views("v_nulls") + f"""
SELECT row_id, c_acctbal, c_mktsegment, o_orderstatus, fold, {S.rnd('y')} AS y FROM v_nulls""")
def dataset_roundtrip(t):
    """Write a dataset, read it back."""
    path = L.scratch(t.spark, "dataset")
    V.v_nulls(t).select("row_id", "c_acctbal", "c_mktsegment", "o_orderstatus", "fold", "y").write.parquet(path)
    return T.read_dataset(t.spark, path).withColumn("y", X.zero_safe_round("y"))


def _stored(t):
    path = L.scratch(t.spark, "ledger")
    L.append(V.v_runs(t), path)
    return path


@query("ledger_write_read", S.with_views("v_runs") + f"""
SELECT dataset, fold, pipeline, split, finished_at, run_id, {S.rnd('score')} AS score FROM v_runs""")
def ledger_write_read(t):
    return L.read(t.spark, _stored(t)).withColumn("score", X.zero_safe_round("score"))


@query("ledger_list", S.with_views("v_runs") + """
SELECT DISTINCT dataset, fold, pipeline, split FROM v_runs WHERE (dataset LIKE 'ds1%' OR dataset = 'ds33[rev]') AND fold IN (2, 7)
AND (pipeline LIKE 'Linear%' OR pipeline = 'Boosting_init[Linear_l2_OHE_standard:none:model]') AND split LIKE '%seed0%'""")
def ledger_list(t):
    return L.list_results(V.v_runs(t), datasets=["ds1*", "ds33[rev]"], folds=[2, 7],
                          pipelines=["Linear*", "Boosting_init[Linear_l2_OHE_standard:none:model]"], splits="*seed0*")


@query("glob_match", S.with_views("v_runs") + """
SELECT dataset, count(*) AS n_runs FROM v_runs WHERE dataset LIKE 'ds_5' OR regexp_matches(dataset, '^ds[2-4].$')
OR dataset = 'ds999[rev]' GROUP BY 1""")
def glob_match(t):
    hit = X.glob_match("dataset", ["ds?5", "ds[2-4]?", "ds999[rev]"])
    return V.v_runs(t).filter(hit).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_runs"))


_RUNS = [(p, "none") for p in V.RUN_NAMES.values()]
_RUNS_SQL = ", ".join(f"('{p}', 'none')" for p, _ in _RUNS)
_GRID = f"""d AS (SELECT DISTINCT dataset FROM v_runs),
g AS MATERIALIZED (SELECT dataset, CAST(fold AS INTEGER) AS fold, pipeline, split FROM d, (SELECT unnest(range(10)) AS fold), (VALUES {_RUNS_SQL}) r(pipeline, split))"""


def _work(t, runs):
    return L.grid(runs.select("dataset").distinct(), range(10), _RUNS)


@query("task_grid", S.with_views("v_runs", more=_GRID) + "SELECT * FROM g")
def task_grid(t):
    return _work(t, V.v_runs(t))


@query("pending_tasks", S.with_views("v_runs", more=_GRID) + "SELECT * FROM g ANTI JOIN v_runs USING (dataset, fold, pipeline, split)")
def pending_tasks(t):
    runs = V.v_runs(t)
    return L.pending(_work(t, runs), runs)


_REQS = {("Boosting_init[Linear_l2_OHE_standard:none:model]", "none"): [("Linear_l2_OHE_standard", "none")],
         ("Boosting_baseline", "none"): [("Linear_l2_num_standard", "none"), ("ConstantPredictor", "none")]}


@query("ready_tasks", S.with_views("v_runs", more=_GRID + """,
k AS MATERIALIZED (SELECT DISTINCT dataset, fold, pipeline FROM v_runs WHERE split = 'none')""") + """
SELECT *, CASE WHEN pipeline LIKE 'Boosting_init%' THEN EXISTS (SELECT 1 FROM k WHERE k.dataset = g.dataset AND k.fold = g.fold AND k.pipeline = 'Linear_l2_OHE_standard')
  WHEN pipeline = 'Boosting_baseline' THEN EXISTS (SELECT 1 FROM k WHERE k.dataset = g.dataset AND k.fold = g.fold AND k.pipeline = 'Linear_l2_num_standard')
    AND EXISTS (SELECT 1 FROM k WHERE k.dataset = g.dataset AND k.fold = g.fold AND k.pipeline = 'ConstantPredictor')
  ELSE true END AS is_ready FROM g""")
def ready_tasks(t):
    runs = V.v_runs(t)
    return L.ready(_work(t, runs), _REQS, runs)


@query("task_order", S.with_views("v_runs", more=_GRID) + """SELECT ord, dataset, fold, pipeline FROM (
SELECT * FROM (SELECT 'dataset' AS ord, * FROM g ORDER BY dataset, fold, pipeline, split LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'fold' AS ord, * FROM g ORDER BY fold DESC, dataset DESC, pipeline, split LIMIT 1))""")
def task_order(t):
    """First task in dataset-major order, and the first one of the last (fold, dataset) pair."""
    work = _work(t, V.v_runs(t))
    first = L.ordered(work, "dataset").limit(1).select(F.lit("dataset").alias("ord"), "dataset", "fold", "pipeline")
    last = work.orderBy(F.desc("fold"), F.desc("dataset"), "pipeline", "split").limit(1)
    return first.unionByName(last.select(F.lit("fold").alias("ord"), "dataset", "fold", "pipeline"))


@query("fold_range", """
SELECT CAST(o_orderkey % 10 AS INTEGER) AS fold, count(*) AS n_rows FROM orders WHERE o_orderkey % 10 BETWEEN 2 AND 5 GROUP BY 1""")
def fold_range(t):
    """Rows of the folds named by a range text."""
    wanted = t.orders.select((F.col("o_orderkey") % 10).cast("int").alias("fold"))
    return wanted.filter(F.col("fold").isin(*L.parse_folds("2-5"))).groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"))


@query("param_grid", """
SELECT p_brand, target_scaling, CAST(depth AS INTEGER) AS depth, count(*) AS n_parts FROM part,
(VALUES ('symlog'), ('standard'), ('none')) a(target_scaling), (VALUES (1), (6)) b(depth) GROUP BY ALL""")
def param_grid(t):
    """Parameter grid per part brand."""
    brands = t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_parts"))
    return L.param_grid(brands, target_scaling=["symlog", "standard", "none"], depth=[1, 6])


@query("ledger_load_fields", S.with_views("v_runs") + f"""
SELECT dataset, fold, pipeline, split, {S.rnd('score')} AS score FROM v_runs WHERE pipeline = 'Linear_l2_OHE_standard'""")
def ledger_load_fields(t):
    stored = L.read(t.spark, _stored(t), ["score"])
    return L.select_results(stored, pipelines="Linear_l2_OHE_standard").withColumn("score", X.zero_safe_round("score"))


@query("ledger_load_field", S.with_views("v_runs", more=_GRID) + f"""
SELECT dataset, fold, {S.rnd('score')} AS score FROM g LEFT JOIN v_runs USING (dataset, fold, pipeline, split) WHERE pipeline = 'ConstantPredictor'""")
def ledger_load_field(t):
    """One field for every cell of the grid, NULL where no result is stored."""
    runs = V.v_runs(t)
    work = L.grid(runs.select("dataset").distinct(), range(10), [("ConstantPredictor", "none")])
    return work.join(runs.select(*L.KEY, "score"), L.KEY, "left").select("dataset", "fold", X.zero_safe_round("score").alias("score"))


@query("ledger_delete", S.with_views("v_runs") + """
SELECT dataset, fold, pipeline, split, run_id FROM v_runs WHERE NOT (pipeline = 'ConstantPredictor' AND fold < 5)""")
def ledger_delete(t):
    """Delete by tombstone, then compact into a new directory and read that."""
    path, into = _stored(t), L.scratch(t.spark, "ledger")
    gone = L.read(t.spark, path, ["run_id"]).filter("pipeline = 'ConstantPredictor' and fold < 5")
    L.delete(gone, path, F.lit("2100-01-01"))
    L.compact(t.spark, path, into)
    return L.read(t.spark, into, ["run_id"])


@query("result_age", S.with_views("v_runs") + """
SELECT dataset, fold, pipeline, split, CAST(epoch(TIMESTAMP '2030-01-01') - epoch(finished_at) AS BIGINT) AS age_seconds FROM v_runs""")
def result_age(t):
    return L.result_age(V.v_runs(t), F.lit("2030-01-01"))


_FIELDS = {"constant": ("ConstantPredictor", "none", "score"), "linear": ("Linear_l2_OHE_standard", "none", "score")}
_SUMMARY = S.with_views("v_runs", more="""
b AS (SELECT dataset, CAST(fold AS INTEGER) AS fold FROM (SELECT DISTINCT dataset FROM v_runs), (SELECT unnest(range(10)) AS fold)),
w AS (SELECT dataset, fold, max(score) FILTER (WHERE pipeline = 'ConstantPredictor' AND split = 'none') AS constant,
  max(score) FILTER (WHERE pipeline = 'Linear_l2_OHE_standard' AND split = 'none') AS linear FROM v_runs GROUP BY ALL),
s AS MATERIALIZED (SELECT dataset, fold, round(constant, 6) AS constant, round(linear, 6) AS linear FROM b LEFT JOIN w USING (dataset, fold))""")


def _summary(t):
    runs = V.v_runs(t)
    out = L.summary(runs.select("dataset").distinct(), runs, _FIELDS)
    return out.withColumns({f: F.round(f, 6) for f in _FIELDS})


@query("summary_exploded", _SUMMARY + "SELECT * FROM s")
def summary_exploded(t):
    return _summary(t)


@query("summary_by_dataset", _SUMMARY + """
SELECT dataset, list(constant ORDER BY fold) AS constant, list(linear ORDER BY fold) AS linear FROM s GROUP BY dataset""")
def summary_by_dataset(t):
    return L.summary_by_dataset(_summary(t), list(_FIELDS))


@query("readiness_matrix", S.with_views("v_runs") + "SELECT dataset, fold, " + ", ".join(
    f"""round(max(CASE WHEN pipeline = '{p}' AND split = 'none' THEN
  ln(least(greatest(CAST(epoch(TIMESTAMP '2000-01-01') - epoch(finished_at) AS DOUBLE), 10), 253800)) END), 6) AS "{p} : none"\n"""
    for p, _ in _RUNS) + "FROM v_runs GROUP BY ALL")
def readiness_matrix(t):
    grid = L.readiness(V.v_runs(t), _RUNS, now=F.lit("2000-01-01"))
    return grid.select("dataset", "fold", *[F.round(F.col(f"`{p} : {s}`"), 6).alias(f"{p} : {s}") for p, s in _RUNS])


@query("valid_names", r"""
SELECT name, NOT (name IN ('.', '..') OR regexp_matches(name, '[?\\:<>|"]') OR contains(name, '**') OR contains(name, '/') OR contains(name, '*')) AS plain,
  NOT (name IN ('.', '..') OR regexp_matches(name, '[?\\:<>|"]') OR contains(name, '**') OR contains(name, '*')) AS with_slash,
  NOT (name IN ('.', '..') OR regexp_matches(name, '[?\\:<>|"]') OR contains(name, '**') OR contains(name, '/')) AS with_star, count(*) AS n
FROM (SELECT DISTINCT url AS name, page_id FROM pages UNION ALL SELECT p_name, p_partkey FROM part
  UNION ALL SELECT p_type || CASE p_size % 4 WHEN 0 THEN '*' WHEN 1 THEN '**' WHEN 2 THEN '|' ELSE '' END, p_partkey FROM part) GROUP BY ALL""")
def valid_names(t):
    """Name checks over page addresses, part names and part types with odd endings."""
    tail = F.element_at(F.array(F.lit("*"), F.lit("**"), F.lit("|"), F.lit("")), (F.col("p_size") % 4 + 1).cast("int"))
    names = (t.pages.select(F.col("url").alias("name"), "page_id").distinct().select("name")
             .unionByName(t.part.select(F.col("p_name").alias("name")))
             .unionByName(t.part.select(F.concat("p_type", tail).alias("name"))))
    per = names.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return per.select("name", X.valid_name("name").alias("plain"), X.valid_name("name", allow_slash=True).alias("with_slash"),
                      X.valid_name("name", allow_single_star=True).alias("with_star"), "n")


@query("parse_run_names", S.with_views("v_runs") + r"""
SELECT pipeline, regexp_extract(pipeline, '^([^\[]+)', 1) AS base,
  nullif(regexp_extract(pipeline, '\[(.*)\]$', 1), '') AS params,
  CASE WHEN contains(pipeline, '[') THEN string_split(regexp_extract(pipeline, '\[(.*)\]$', 1), ':')[1] END AS init_run,
  CASE WHEN contains(pipeline, '[') THEN string_split(regexp_extract(pipeline, '\[(.*)\]$', 1), ':')[2] END AS init_split,
  CASE WHEN contains(pipeline, '[') THEN string_split(regexp_extract(pipeline, '\[(.*)\]$', 1), ':')[3] END AS init_field,
  count(*) AS n_runs FROM v_runs GROUP BY ALL""")
def parse_run_names(t):
    """Base name and parameters of run names such as ``Name[run:split:field]``."""
    per = V.v_runs(t).groupBy("pipeline").agg(F.count(F.lit(1)).alias("n_runs"))
    params = F.regexp_extract("pipeline", r"\[(.*)\]$", 1)
    out = per.select("pipeline", F.regexp_extract("pipeline", r"^([^\[]+)", 1).alias("base"),
                     F.when(params != "", params).alias("params"), "n_runs")
    parts = F.split("params", ":")
    return out.withColumns({"init_run": F.get(parts, F.lit(0)), "init_split": F.get(parts, F.lit(1)),
                            "init_field": F.get(parts, F.lit(2))})
