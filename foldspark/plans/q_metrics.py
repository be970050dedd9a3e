"""Queries: metrics, bootstraps, ensembles and curves."""

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import curves as C
from ..operators import ensemble as E
from ..operators import metrics as M
from ..operators import resample as B
from ..operators import rows as R
from . import sqltext as S
from . import views as V
from .registry import query


def _out(df, *keys):
    return df.select(*keys, X.zero_safe_round("score").alias("score"))


R2 = """CASE WHEN count(*) < 2 OR max(abs({y})) = 'inf' OR max(abs({p})) = 'inf' THEN NULL
  WHEN var_pop({y}) > 0 THEN 1 - sum(({y} - {p}) * ({y} - {p})) / (var_pop({y}) * count(*))
  WHEN sum(({y} - {p}) * ({y} - {p})) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"""


def d2_sql(source: str, by: str, y: str = "y", p: str = "pred_a") -> str:
    return f"""SELECT {by}, CASE WHEN sum(abs({y} - med)) > 0 THEN 1 - sum(abs({y} - {p})) / sum(abs({y} - med))
  WHEN sum(abs({y} - {p})) = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM
  (SELECT *, quantile_cont({y}, 0.5) OVER (PARTITION BY {by}) AS med FROM {source}) GROUP BY {by}"""


def auc_sql(source: str, by: str) -> str:
    return f"""SELECT {by}, CASE WHEN sum(pos) * sum(neg) > 0 THEN
    sum(pos * (cneg - neg / 2.0::DOUBLE)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) END AS score FROM (
  SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY s) AS cneg FROM (
    SELECT {by}, least(greatest(logit, -1e10), 1e10) AS s, sum(y) AS pos, sum(1 - y) AS neg FROM {source} GROUP BY ALL)) GROUP BY {by}"""


LLB = "avg(-ln(least(greatest(1 / (1 + exp(CASE WHEN y = 1 THEN -logit ELSE logit END)), 2.220446049250313e-16), 1 - 2.220446049250313e-16)))"
LLM = ("avg(-ln(least(greatest(exp(logits[y + 1]) / (exp(logits[1]) + exp(logits[2]) + exp(logits[3])), 2.220446049250313e-16), "
       "1 - 2.220446049250313e-16)))")
SYM = "sign({0}) * ln(1 + abs({0}))"


def _reg(t):
    return V.p_reg(t).withColumn("pred", F.col("pred_a"))


@query("metric_r2", S.with_views("p_reg") + f"SELECT subset, {S.rnd(R2.format(y='y', p='pred_a'))} AS score FROM p_reg GROUP BY subset")
def metric_r2(t):
    return _out(M.r2(_reg(t), ["subset"]), "subset")


@query("metric_r2_symlog", S.with_views("p_reg") + f"""SELECT subset, {S.rnd(R2.format(y='a', p='b'))} AS score FROM
  (SELECT subset, {SYM.format('y')} AS a, {SYM.format('pred_a')} AS b FROM p_reg) GROUP BY subset""")
def metric_r2_symlog(t):
    return _out(M.r2_symlog(_reg(t), ["subset"]), "subset")


@query("metric_d2_absolute_error", S.with_views("p_reg") + f"SELECT subset, {S.rnd('score')} AS score FROM ({d2_sql('p_reg', 'subset')})")
def metric_d2_absolute_error(t):
    return _out(M.d2_absolute_error(_reg(t), ["subset"]), "subset")


@query("metric_median_absolute_error", S.with_views("p_reg") + f"""
SELECT subset, {S.rnd('quantile_cont(abs(y - pred_a), 0.5)')} AS score FROM p_reg GROUP BY subset""")
def metric_median_absolute_error(t):
    return _out(M.median_absolute_error(_reg(t), ["subset"]), "subset")


@query("metric_quantile_mse_d2", S.with_views("p_reg", more="""
tr AS MATERIALIZED (SELECT subset, y AS v, count(*) AS c FROM p_reg GROUP BY ALL),
al AS MATERIALIZED (SELECT subset, v, max(c) AS c FROM (SELECT subset, v, c FROM tr UNION ALL SELECT subset, pred_a, 0 FROM p_reg) GROUP BY ALL),
q AS MATERIALIZED (SELECT subset, v, sum(c) OVER (PARTITION BY subset ORDER BY v) - c / 2.0::DOUBLE AS k FROM al),
pr AS MATERIALIZED (SELECT p.subset, a.k / n AS tq, b.k / n AS pq FROM p_reg p JOIN q a ON a.subset = p.subset AND a.v = p.y
  JOIN q b ON b.subset = p.subset AND b.v = p.pred_a JOIN (SELECT subset, count(*) AS n FROM p_reg GROUP BY 1) s ON s.subset = p.subset)""")
       + f"SELECT subset, {S.rnd(R2.format(y='tq', p='pq'))} AS score FROM pr GROUP BY subset")
def metric_quantile_mse_d2(t):
    return _out(M.quantile_mse_d2(_reg(t), ["subset"]), "subset")


@query("metric_roc_auc", S.with_views("p_bin") + f"SELECT subset, {S.rnd('score')} AS score FROM ({auc_sql('p_bin', 'subset')})")
def metric_roc_auc(t):
    return _out(M.roc_auc(V.p_bin(t), ["subset"], pred="logit"), "subset")


_BA = """SELECT subset, {r} AS score FROM (SELECT subset, CASE WHEN count(*) = {k} THEN avg(r) END AS s FROM
  (SELECT subset, y, avg(CAST({hit} AS DOUBLE)) AS r FROM {v} GROUP BY ALL) GROUP BY subset)"""


@query("metric_balanced_accuracy_binary", S.with_views("p_bin") + _BA.format(
    r=S.rnd("s"), k=2, v="p_bin", hit="CAST(logit > 0 AS INTEGER) = y"))
def metric_balanced_accuracy_binary(t):
    return _out(M.balanced_accuracy(V.p_bin(t), ["subset"], 2, pred="logit"), "subset")


@query("metric_balanced_accuracy_multiclass", S.with_views("p_mc") + _BA.format(
    r=S.rnd("s"), k=3, v="p_mc", hit="list_position(logits, list_max(logits)) - 1 = y"))
def metric_balanced_accuracy_multiclass(t):
    return _out(M.balanced_accuracy(V.p_mc(t), ["subset"], 3, pred="logits"), "subset")


@query("metric_log_loss_binary", S.with_views("p_bin") + f"SELECT subset, {S.rnd(LLB)} AS score FROM p_bin GROUP BY subset")
def metric_log_loss_binary(t):
    return _out(M.log_loss(V.p_bin(t), ["subset"], pred="logit"), "subset")


@query("metric_log_loss_multiclass", S.with_views("p_mc") + f"SELECT subset, {S.rnd(LLM)} AS score FROM p_mc GROUP BY subset")
def metric_log_loss_multiclass(t):
    return _out(M.log_loss(V.p_mc(t), ["subset"], pred="logits"), "subset")


@query("score_masked", S.with_views("p_reg") + f"""
SELECT subset, {S.rnd(R2.format(y='y', p='pred_a'))} AS score FROM p_reg WHERE y > 150000 GROUP BY subset""")
def score_masked(t):
    """A metric on the rows of a mask, applied inside each subset."""
    return _out(M.r2(_reg(t).filter(F.col("y") > 150000), ["subset"]), "subset")


@query("score_indexed", S.with_views("p_reg") + f"""
SELECT subset, {S.rnd(R2.format(y='y', p='pred_a'))} AS score FROM p_reg JOIN lineitem ON l_orderkey = row_id GROUP BY subset""")
def score_indexed(t):
    """A metric on an index list with repeats: the order keys of all line items."""
    idx = t.lineitem.select(F.col("l_orderkey").alias("row_id"))
    return _out(M.r2(_reg(t).join(idx, "row_id"), ["subset"]), "subset")


_SEED = "CAST(NULL AS INTEGER) AS bootstrap_seed"


@query("score_all_regression", S.with_views("p_reg") + f"""
SELECT subset, metric, {_SEED}, {S.rnd('score')} AS score FROM (
SELECT subset, 'r2' AS metric, {R2.format(y='y', p='pred_a')} AS score FROM p_reg GROUP BY subset
UNION ALL SELECT subset, 'r2_symlog', {R2.format(y='a', p='b')} FROM (SELECT subset, {SYM.format('y')} AS a, {SYM.format('pred_a')} AS b FROM p_reg) GROUP BY subset
UNION ALL SELECT subset, 'd2_absolute_error', score FROM ({d2_sql('p_reg', 'subset')})
UNION ALL SELECT subset, 'neg_median_absolute_error', -quantile_cont(abs(y - pred_a), 0.5) FROM p_reg GROUP BY subset)""")
def score_all_regression(t):
    names = ["r2", "r2_symlog", "d2_absolute_error", "neg_median_absolute_error"]
    return _out(M.score_all(_reg(t), names), "subset", "metric", "bootstrap_seed")


@query("score_all_binary", S.with_views("p_bin") + f"""
SELECT subset, metric, {_SEED}, {S.rnd('score')} AS score FROM (
SELECT subset, 'neg_log_loss' AS metric, -({LLB}) AS score FROM p_bin GROUP BY subset
UNION ALL SELECT subset, 'roc_auc', score FROM ({auc_sql('p_bin', 'subset')})
UNION ALL SELECT subset, 'balanced_accuracy', score FROM ({_BA.format(r='s', k=2, v='p_bin', hit='CAST(logit > 0 AS INTEGER) = y')}))""")
def score_all_binary(t):
    return _out(M.score_all(V.p_bin(t), ["neg_log_loss", "roc_auc", "balanced_accuracy"], n_classes=2, pred="logit"),
                "subset", "metric", "bootstrap_seed")


@query("score_all_multiclass", S.with_views("p_mc") + f"""
SELECT subset, metric, {_SEED}, {S.rnd('score')} AS score FROM (
SELECT subset, 'neg_log_loss' AS metric, -({LLM}) AS score FROM p_mc GROUP BY subset
UNION ALL SELECT subset, 'balanced_accuracy', score FROM ({_BA.format(r='s', k=3, v='p_mc', hit='list_position(logits, list_max(logits)) - 1 = y')}))""")
def score_all_multiclass(t):
    return _out(M.score_all(V.p_mc(t), ["neg_log_loss", "balanced_accuracy"], n_classes=3, pred="logits"),
                "subset", "metric", "bootstrap_seed")


def exact_draws(view: str, cols: str, where: str = "") -> str:
    """CTE of resampled rows: seed -1 is the full sample."""
    return f"""
ix AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY row_id) - 1 AS idx,
  count(*) OVER (PARTITION BY subset) AS n FROM {view} {where}),
dr AS MATERIALIZED (SELECT subset, seed, {S.u63('seed', 'idx')} % n AS idx FROM ix, (SELECT unnest(range(50)) AS seed)),
rs AS MATERIALIZED (SELECT subset, -1 AS seed, {cols} FROM ix UNION ALL
  SELECT dr.subset, dr.seed, {cols} FROM dr JOIN ix ON ix.subset = dr.subset AND ix.idx = dr.idx)"""


_NULLSEED = "CAST(CASE WHEN seed >= 0 THEN seed END AS INTEGER) AS bootstrap_seed"


@query("default_scoring", S.with_views("p_reg", more=exact_draws("p_reg", "y, pred_a", "WHERE subset IN ('val', 'test')")) + f"""
SELECT subset, metric, {_NULLSEED}, {S.rnd('score')} AS score FROM (
  SELECT subset, seed, 'r2' AS metric, {R2.format(y='y', p='pred_a')} AS score FROM rs GROUP BY subset, seed
  UNION ALL SELECT subset, seed, 'd2_absolute_error', score FROM ({d2_sql('rs', 'subset, seed')}))""")
def default_scoring(t):
    return _out(M.default_scoring(_reg(t), "regression"), "subset", "metric", "bootstrap_seed")


@query("default_scoring_binary_poisson", S.with_views("p_bin", more=f"""
pw AS MATERIALIZED (SELECT subset, seed, y, logit, {S.u32('seed', 'row_id')} AS u FROM p_bin, (SELECT unnest(range(50)) AS seed) WHERE subset IN ('val', 'test')),
rs AS MATERIALIZED (SELECT subset, -1 AS seed, y, logit FROM p_bin WHERE subset IN ('val', 'test') UNION ALL
  SELECT subset, seed, y, logit FROM (SELECT *, unnest(range({S.poisson1('u')})) FROM pw))""") + f"""
SELECT subset, metric, {_NULLSEED}, {S.rnd('score')} AS score FROM (
  SELECT subset, seed, 'neg_log_loss' AS metric, -({LLB}) AS score FROM rs GROUP BY subset, seed
  UNION ALL SELECT subset, seed, 'roc_auc', score FROM ({auc_sql('rs', 'subset, seed')}))""")
def default_scoring_binary_poisson(t):
    """Default scoring of a binary task with Poisson weights instead of exact draws: one pass, no shuffle."""
    return _out(M.default_scoring(V.p_bin(t), "binary", pred="logit", n_classes=2, method="poisson"),
                "subset", "metric", "bootstrap_seed")


@query("bootstrap_resample", S.with_views("p_reg", more=exact_draws("p_reg", "row_id, y")) + """
SELECT subset, CAST(seed AS INTEGER) AS bootstrap_seed, count(*) AS n_draws, count(DISTINCT row_id) AS n_distinct,
  CAST(sum(row_id) AS BIGINT) AS sum_ids FROM rs WHERE seed >= 0 GROUP BY subset, seed""")
def bootstrap_resample(t):
    rows_ = V.p_reg(t).select("row_id", "subset", "y")
    drawn = B.resample_exact(rows_, ["subset"], list(range(50)))
    # distinct rows by two plain aggregates instead of a distinct expand
    per = drawn.groupBy("subset", "bootstrap_seed", "row_id").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("subset", "bootstrap_seed").agg(
        F.sum("c").alias("n_draws"), F.count(F.lit(1)).alias("n_distinct"),
        F.sum(F.col("row_id") * F.col("c")).alias("sum_ids"))


@query("truth_join_preds", S.with_views("p_reg") + "SELECT p.row_id, pred_a AS pred, o_totalprice AS truth FROM p_reg p JOIN orders ON o_orderkey = p.row_id")
def truth_join_preds(t):
    truth = t.orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("y"))
    return R.join_truth(V.p_reg(t).select("row_id", F.col("pred_a").alias("pred")), truth)


@query("residual_target", S.with_views("p_reg") + f"SELECT row_id, {S.rnd('y - pred_a')} AS residual FROM p_reg")
def residual_target(t):
    p = V.p_reg(t)
    out = R.residual_target(p.select("row_id", "y"), p.select("row_id", F.col("pred_a").alias("pred")))
    return out.select("row_id", X.zero_safe_round("residual").alias("residual"))


def _members(t):
    p = V.p_reg(t)
    one = p.select("row_id", F.lit(0).alias("pos"), F.col("pred_a").alias("pred"), F.lit(1.0).alias("t"))
    two = p.select("row_id", F.lit(1).alias("pos"), F.col("pred_b").alias("pred"),
                   F.when(F.col("fold") < 5, 2.0).alias("t"))
    return one.unionByName(two)


@query("ensemble_average", S.with_views("p_reg") + f"""
SELECT row_id, {S.rnd('(pred_a + pred_b) / 2')} AS pred, CASE WHEN fold < 5 THEN 3.0::DOUBLE END AS t, 2::BIGINT AS n_members FROM p_reg""")
def ensemble_average(t):
    return E.average(_members(t)).withColumn("pred", X.zero_safe_round("pred"))


@query("ensemble_cumulative_average", S.with_views("p_reg") + f"""
SELECT row_id, CAST(0 AS INTEGER) AS pos, {S.rnd('pred_a')} AS pred, 1.0::DOUBLE AS t FROM p_reg
UNION ALL SELECT row_id, CAST(1 AS INTEGER), {S.rnd('(pred_a + pred_b) / 2')}, CASE WHEN fold < 5 THEN 3.0::DOUBLE END FROM p_reg""")
def ensemble_cumulative_average(t):
    return E.cumulative_average(_members(t)).withColumn("pred", X.zero_safe_round("pred"))


def best_iter_sql(source: str, rounds: int) -> str:
    return f"""
m1 AS MATERIALIZED (SELECT curve_id, step, score, max(score) OVER e AS top, first_value(score) OVER (PARTITION BY curve_id ORDER BY step) AS f,
  max(CASE WHEN score IS NOT NULL THEN step END) OVER (PARTITION BY curve_id) AS lst FROM {source}
  WINDOW e AS (PARTITION BY curve_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m2 AS MATERIALIZED (SELECT curve_id, step, coalesce(step = 0 OR (f IS NOT NULL AND score > top), false) AS b FROM m1 WHERE step <= lst),
m3 AS MATERIALIZED (SELECT *, max(CASE WHEN b THEN step END) OVER (PARTITION BY curve_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bb FROM m2),
m4 AS MATERIALIZED (SELECT *, min(CASE WHEN step > bb + {rounds} THEN step END) OVER (PARTITION BY curve_id) AS st FROM m3),
bi AS MATERIALIZED (SELECT curve_id, max(CASE WHEN b AND (st IS NULL OR step < st) THEN step END) AS best_iter, bool_or(st IS NOT NULL) AS stopped FROM m4 GROUP BY 1)"""


@query("early_stopping_best_iter", S.with_views("v_curve", more=best_iter_sql("v_curve", 40)) + "SELECT curve_id, best_iter, stopped FROM bi")
def early_stopping_best_iter(t):
    return C.best_iteration(V.v_curve(t), 40)


@query("recalc_best_iter", S.with_views("v_curve", more="sc AS MATERIALIZED (SELECT curve_id, step, -(-score) AS score FROM v_curve)," + best_iter_sql("sc", 50))
       + "SELECT curve_id, best_iter, stopped, stopped AS valid FROM bi")
def recalc_best_iter(t):
    """Half of the curves are stored as a loss (sign flipped); the direction column undoes it."""
    higher = F.col("curve_id") % 2 == 0
    stored = V.v_curve(t).select("curve_id", "step", higher.alias("higher"),
                                 F.when(higher, F.col("score")).otherwise(-F.col("score")).alias("score"))
    return C.recalculate(stored, 50, ["curve_id"])
