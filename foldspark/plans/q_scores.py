"""Queries: score tables and scalar functions."""

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import scores as C
from . import sqltext as S
from . import views as V
from .registry import query

_K = ["dataset", "fold"]


def _run(t, flag):
    return V.v_scores(t).filter(F.col("run") == flag).drop("run")


_PAIR = """
a AS MATERIALIZED (SELECT * FROM v_scores WHERE run = 'A'), r AS MATERIALIZED (SELECT * FROM v_scores WHERE run = 'R'),
dl AS MATERIALIZED (SELECT coalesce(a.dataset, r.dataset) AS dataset, coalesce(a.fold, r.fold) AS fold, coalesce(a.subset, r.subset) AS subset,
  coalesce(a.metric, r.metric) AS metric, coalesce(a.bootstrap_seed, r.bootstrap_seed) AS bootstrap_seed, a.score - r.score AS score,
  CASE WHEN r.dataset IS NULL THEN 'left' WHEN a.dataset IS NULL THEN 'right' ELSE 'both' END AS side
  FROM a FULL JOIN r ON a.dataset = r.dataset AND a.fold = r.fold AND a.subset = r.subset AND a.metric = r.metric
  AND a.bootstrap_seed IS NOT DISTINCT FROM r.bootstrap_seed)"""


def _deltas(t):
    return C.deltas(_run(t, "A"), _run(t, "R"), _K)


@query("score_deltas", S.with_views("v_scores", more=_PAIR) + f"""
SELECT dataset, fold, subset, metric, bootstrap_seed, {S.rnd('score')} AS score FROM dl WHERE side = 'both'""")
def score_deltas(t):
    return _deltas(t).filter("side = 'both'").drop("side").withColumn("score", X.zero_safe_round("score"))


@query("score_deltas_unmatched", S.with_views("v_scores", more=_PAIR) + "SELECT subset, metric, side, count(*) AS n_keys FROM dl GROUP BY ALL")
def score_deltas_unmatched(t):
    """How many keys match or stand on one side only."""
    return _deltas(t).groupBy("subset", "metric", "side").agg(F.count(F.lit(1)).alias("n_keys"))


@query("score_deltas_outer", S.with_views("v_scores", more=_PAIR) + f"""
SELECT dataset, fold, subset, metric, bootstrap_seed, {S.rnd('score')} AS score, side FROM dl""")
def score_deltas_outer(t):
    return _deltas(t).withColumn("score", X.zero_safe_round("score"))


@query("bootstrap_alignment", S.with_views("v_scores", more=_PAIR) + """
SELECT dataset, subset, fold, n_seeds, n_seeds = n_all AS aligned FROM
  (SELECT dataset, subset, fold, count(DISTINCT bootstrap_seed) AS n_seeds FROM a GROUP BY ALL HAVING count(bootstrap_seed) > 0)
  JOIN (SELECT dataset, subset, count(DISTINCT bootstrap_seed) AS n_all FROM a GROUP BY ALL) USING (dataset, subset)""")
def bootstrap_alignment(t):
    return C.seed_coverage(_run(t, "A"), ["dataset", "subset"])


@query("scores_get", S.with_views("v_scores") + f"""
SELECT run, dataset, fold, {S.rnd('score')} AS score FROM v_scores WHERE subset = 'val' AND metric = 'r2' AND bootstrap_seed IS NULL""")
def scores_get(t):
    return C.get(V.v_scores(t), "val", "r2").select("run", *_K, X.zero_safe_round("score").alias("score"))


@query("scores_by_metric", S.with_views("v_scores") + f"""
SELECT run, dataset, fold, {S.rnd("max(score) FILTER (WHERE metric = 'r2')")} AS r2,
  {S.rnd("max(score) FILTER (WHERE metric = 'd2_absolute_error')")} AS d2 FROM v_scores
WHERE subset = 'test' AND bootstrap_seed IS NULL GROUP BY ALL""")
def scores_by_metric(t):
    """The metric map of each run, shown as two columns."""
    m = C.by_metric(V.v_scores(t), "test", ["run", *_K])
    return m.select("run", *_K, X.zero_safe_round(F.try_element_at("scores", F.lit("r2"))).alias("r2"),
                    X.zero_safe_round(F.try_element_at("scores", F.lit("d2_absolute_error"))).alias("d2"))


@query("scores_bootstraps", S.with_views("v_scores") + f"""
SELECT run, dataset, fold, bootstrap_seed, {S.rnd('score')} AS score FROM v_scores
WHERE subset = 'val' AND metric = 'd2_absolute_error' AND bootstrap_seed IS NOT NULL""")
def scores_bootstraps(t):
    return C.bootstraps(V.v_scores(t), "val", "d2_absolute_error").select(
        "run", *_K, "bootstrap_seed", X.zero_safe_round("score").alias("score"))


@query("bootstrap_quantiles", S.with_views("v_scores") + f"""
SELECT run, dataset, {S.rnd('quantile_cont(score, 0.1)')} AS q10, {S.rnd('quantile_cont(score, 0.9)')} AS q90 FROM v_scores
WHERE subset = 'val' AND metric = 'r2' AND bootstrap_seed IS NOT NULL GROUP BY ALL""")
def bootstrap_quantiles(t):
    q = C.bootstrap_quantiles(V.v_scores(t), "val", "r2", (0.1, 0.9), ["run", "dataset"])
    return q.select("run", "dataset", X.zero_safe_round(F.get("q", F.lit(0))).alias("q10"),
                    X.zero_safe_round(F.get("q", F.lit(1))).alias("q90"))


_MATRIX = _PAIR + """,
bs AS MATERIALIZED (SELECT * FROM dl WHERE side = 'both' AND subset = 'val' AND metric = 'r2' AND bootstrap_seed IS NOT NULL AND fold <> 3),
mx AS MATERIALIZED (SELECT g.dataset, g.fold, g.bootstrap_seed, bs.score FROM
  (SELECT dataset, CAST(f AS INTEGER) AS fold, bootstrap_seed FROM (SELECT DISTINCT dataset, bootstrap_seed FROM bs), (SELECT unnest(range(10)) AS f)) g
  LEFT JOIN bs ON bs.dataset = g.dataset AND bs.fold = g.fold AND bs.bootstrap_seed = g.bootstrap_seed)"""


def _matrix(t):
    """Difference of runs A and R on val r2 with fold 3 never stored."""
    d = _deltas(t).filter("side = 'both' and fold <> 3")
    return C.bootstrap_matrix(d, "val", "r2", range(10))


@query("bootstrap_matrix", S.with_views("v_scores", more=_MATRIX) + f"SELECT dataset, fold, bootstrap_seed, {S.rnd('score')} AS score FROM mx")
def bootstrap_matrix(t):
    return _matrix(t).select("dataset", "fold", "bootstrap_seed", X.zero_safe_round("score").alias("score"))


@query("bootstrap_gain", S.with_views("v_scores", more=_MATRIX) + f"""
SELECT dataset, fold, {S.rnd('CASE WHEN count(score) = count(*) THEN avg(sign(score)) END')} AS gain FROM mx GROUP BY ALL""")
def bootstrap_gain(t):
    """Gain per dataset and fold; a fold with a missing score has none."""
    return C.bootstrap_gain(_matrix(t), ["dataset", "fold"]).withColumn("gain", X.zero_safe_round("gain"))


@query("gains_summary", S.with_views("v_scores", more=_MATRIX) + f"""
SELECT CASE WHEN length(l) < 12 THEN l ELSE left(l, 6) || '...' || right(l, 3) END AS label, gain FROM (
  SELECT 'dataset_' || dataset || '_fold_' || fold AS l, {S.rnd('CASE WHEN count(score) = count(*) THEN avg(sign(score)) END')} AS gain
  FROM mx GROUP BY dataset, fold) WHERE gain IS NOT NULL ORDER BY 2, 1""")
def gains_summary(t):
    gains = C.bootstrap_gain(_matrix(t), ["dataset", "fold"])
    named = gains.select(F.concat(F.lit("dataset_"), "dataset", F.lit("_fold_"), "fold").alias("dataset"),
                         X.zero_safe_round("gain").alias("gain"))
    return C.gains_summary(named, max_size=12)


@query("scores_concat", S.with_views("v_scores") + """
SELECT dataset, subset, metric, count(*) AS n_scores, count(bootstrap_seed) AS n_boot FROM v_scores WHERE run IN ('A', 'N') GROUP BY ALL""")
def scores_concat(t):
    both = C.concat(_run(t, "A"), _run(t, "N"))
    return both.groupBy("dataset", "subset", "metric").agg(
        F.count(F.lit(1)).alias("n_scores"), F.count("bootstrap_seed").alias("n_boot"))


def _best_sql(keys: str, where: str) -> str:
    return S.with_views("v_scores") + f"""SELECT {keys}, run, {S.rnd('score')} AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, run) AS rn FROM v_scores WHERE {where}) WHERE rn = 1"""


def _options(t, where):
    order = F.when(F.col("run") == "A", 0).when(F.col("run") == "N", 1).otherwise(2)
    return V.v_scores(t).filter(where).withColumn("option_order", order)


@query("select_best_run", _best_sql("dataset, fold", "subset = 'val' AND metric = 'r2' AND bootstrap_seed IS NULL"))
def select_best_run(t):
    """Best of three runs per dataset and fold by the selection metric; the first run wins ties."""
    best = C.best_of(_options(t, "subset = 'val' and metric = 'r2' and bootstrap_seed is null"), _K)
    return best.select(*_K, "run", X.zero_safe_round("score").alias("score"))


@query("select_best_preproc", _best_sql("dataset, fold, subset, bootstrap_seed", "metric = 'r2' AND bootstrap_seed IS NOT NULL"))
def select_best_preproc(t):
    """Best transform per feature: seeds stand for features, runs for transforms."""
    best = C.best_of(_options(t, "metric = 'r2' and bootstrap_seed is not null"), [*_K, "subset", "bootstrap_seed"])
    return best.select(*_K, "subset", "bootstrap_seed", "run", X.zero_safe_round("score").alias("score"))


@query("select_best_alpha", S.with_views("v_scores") + f"""
SELECT dataset, {S.rnd('avg(alpha)')} AS alpha FROM (SELECT dataset, run, pow(2.0::DOUBLE, bootstrap_seed - 14) AS alpha FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset, run ORDER BY m DESC, bootstrap_seed) AS rn FROM (
    SELECT dataset, run, bootstrap_seed, round(avg(score), 9) AS m FROM v_scores WHERE metric = 'r2' AND bootstrap_seed BETWEEN 0 AND 19 GROUP BY ALL))
  WHERE rn = 1) GROUP BY dataset""")
def select_best_alpha(t):
    """Best of 20 penalties by the mean score over folds, averaged over classes (runs stand for classes)."""
    path = V.v_scores(t).filter("metric = 'r2' and bootstrap_seed between 0 and 19")
    mean = path.groupBy("dataset", "run", "bootstrap_seed").agg(F.round(F.avg("score"), 9).alias("score"))
    best = C.best_of(mean, ["dataset", "run"], order="bootstrap_seed")
    alpha = F.pow(F.lit(2.0), F.col("bootstrap_seed") - 14)
    return best.groupBy("dataset").agg(X.zero_safe_round(F.avg(alpha)).alias("alpha"))


@query("symlog_symexp", f"""
SELECT o_orderkey AS row_id, {S.rnd('sign(x) * ln(1 + abs(x))')} AS logged, {S.rnd('x', 3)} AS restored
FROM (SELECT o_orderkey, o_totalprice - 150000 AS x FROM orders)""")
def symlog_symexp(t):
    df = t.orders.select(F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") - 150000).alias("x"))
    logged = X.symlog("x")
    return df.select("row_id", X.zero_safe_round(logged).alias("logged"), X.zero_safe_round(X.symexp(logged), 3).alias("restored"))


@query("probabilities_binary", S.with_views("p_bin") + f"SELECT row_id, {S.rnd('1 / (1 + exp(-logit))')} AS p FROM p_bin")
def probabilities_binary(t):
    return V.p_bin(t).select("row_id", X.zero_safe_round(X.sigmoid("logit")).alias("p"))


@query("probabilities_multiclass", S.with_views("p_mc") + "SELECT row_id, " + ", ".join(
    S.rnd(f"exp(logits[{i}]) / (exp(logits[1]) + exp(logits[2]) + exp(logits[3]))") + f" AS p{i}" for i in (1, 2, 3)) + " FROM p_mc")
def probabilities_multiclass(t):
    p = V.p_mc(t).select("row_id", X.softmax("logits").alias("p"))
    return p.select("row_id", *[X.zero_safe_round(F.get("p", F.lit(i))).alias(f"p{i + 1}") for i in range(3)])


@query("binary_logit", S.with_views("p_bin") + f"SELECT row_id, {S.rnd('ln(1 / (1 + exp(-logit))) - ln(1 - 1 / (1 + exp(-logit)))')} AS logit FROM p_bin")
def binary_logit(t):
    """Log odds rebuilt from the two class probabilities."""
    p = V.p_bin(t).select("row_id", X.sigmoid("logit").alias("p1"), X.sigmoid(-F.col("logit")).alias("p0"))
    return p.select("row_id", X.zero_safe_round(X.log_odds("p0", "p1")).alias("logit"))


@query("linear_projection", f"""
SELECT o_orderkey AS row_id, {S.rnd('(o_totalprice + 1) * 4.0::DOUBLE / 500000 - 2', 5)} AS x FROM orders""")
def linear_projection(t):
    x = X.linear_projection("o_totalprice", (-1, 499_999), (-2, 2))
    return t.orders.select(F.col("o_orderkey").alias("row_id"), X.zero_safe_round(x, 5).alias("x"))
