"""Queries: correlations, single-feature models, constant predictors."""

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import constant as N
from ..operators import metrics as M
from ..operators import prep as P
from ..operators import screen as G
from ..operators import splits as K
from ..session import cut
from . import q_metrics as QM
from . import sqltext as S
from . import views as V
from .q_splits import strat_cte
from .registry import query

_TRAIN = "fold <> 0"


def _long_sql(source: str, y: str = "y", extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT row_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS x, {y} AS y {extra} FROM {source}" for c in V.NUM)


def _train_long(t, view):
    return G.long_features(view(t).filter(_TRAIN), V.NUM)


@query("pearson_by_feature", S.with_views("v_nulls", more=f"lg AS MATERIALIZED ({_long_sql('(SELECT * FROM v_nulls WHERE fold <> 0)')})") + f"""
SELECT feature, {S.rnd('corr(x, y)')} AS r, count(*) AS n FROM lg WHERE x IS NOT NULL GROUP BY feature""")
def pearson_by_feature(t):
    return G.pearson(_train_long(t, V.v_nulls), with_pvalue=False).select("feature", X.zero_safe_round("r").alias("r"), "n")


@query("pearson_pvalue")
def pearson_pvalue(t):
    return G.pearson(_train_long(t, V.v_nulls)).select("feature", "r", "n", "pvalue")


@query("pearson_one_vs_rest", S.with_views("v_mc_signal", more=f"lg AS MATERIALIZED ({_long_sql('(SELECT * FROM v_mc_signal WHERE fold <> 0)')})") + f"""
SELECT feature, CAST(k AS INTEGER) AS label_code, {S.rnd('corr(x, CAST(ascii(y) - 97 = k AS DOUBLE))')} AS r, count(*) AS n
FROM lg, (SELECT unnest(range(3)) AS k) GROUP BY feature, k""")
def pearson_one_vs_rest(t):
    df = V.v_mc_signal(t).withColumn("y", F.expr("cast(ascii(y) - 97 as int)"))
    long = G.long_features(df.filter(_TRAIN), V.NUM)
    return G.pearson(long, classes=[0, 1, 2], with_pvalue=False).select(
        "feature", "label_code", X.zero_safe_round("r").alias("r"), "n")


@query("feature_correlation_bootstrap", S.with_views("v_nulls", more=f"""
lg AS MATERIALIZED ({_long_sql('(SELECT * FROM v_nulls WHERE fold <> 0)')}),
pw AS MATERIALIZED (SELECT feature, x, y, seed, {S.u32('seed', 'row_id')} AS u FROM lg, (SELECT unnest(range(50)) AS seed) WHERE x IS NOT NULL),
rs AS MATERIALIZED (SELECT feature, x, y, seed, unnest(range({S.poisson1('u')})) FROM pw)""") + f"""
SELECT feature, CAST(seed AS INTEGER) AS bootstrap_seed, {S.rnd('corr(x, y)')} AS r, count(*) AS n FROM rs GROUP BY feature, seed""")
def feature_correlation_bootstrap(t):
    """Fifty bootstrap correlations per numeric feature on the training rows."""
    out = G.pearson(_train_long(t, V.v_nulls), list(range(50)), with_pvalue=False, method="poisson")
    return out.select("feature", "bootstrap_seed", X.zero_safe_round("r").alias("r"), "n")


def _folded(t, view, strat=None):
    """Trainval rows with the folds an unshuffled 5-fold cross-validation gives them."""
    df = view(t).filter(_TRAIN)
    return K.kfold(df, 5, seed=None) if strat is None else K.stratified_kfold(df, 5, strat, seed=None)


_FOLDS = f"""
tv AS MATERIALIZED (SELECT *, CAST(ntile(5) OVER (ORDER BY row_id) - 1 AS INTEGER) AS cv_fold FROM {{view}} WHERE {_TRAIN}),
lg AS MATERIALIZED ({_long_sql('tv', extra=', cv_fold')})"""
_LINE = """,
pr AS MATERIALIZED (SELECT k.feature, k.f, avg(x) AS mx, avg(CASE WHEN x IS NOT NULL THEN y END) AS my, regr_slope(y, x) AS b, avg(CASE WHEN x IS NULL THEN y END) AS mm
  FROM lg JOIN (SELECT DISTINCT feature, cv_fold AS f FROM lg) k ON k.feature = lg.feature AND k.f <> lg.cv_fold GROUP BY ALL),
pd AS MATERIALIZED (SELECT lg.feature, y, CASE WHEN x IS NULL THEN coalesce(mm, my) ELSE my + b * (x - mx) END AS p
  FROM lg JOIN pr ON pr.feature = lg.feature AND pr.f = lg.cv_fold)"""
_SCORED = f"""SELECT feature, metric, {S.rnd('score', 5)} AS score FROM (
SELECT feature, 'r2' AS metric, {QM.R2.format(y='y', p='p')} AS score FROM pd GROUP BY feature
UNION ALL SELECT feature, 'd2_absolute_error', score FROM ({QM.d2_sql('pd', 'feature', p='p')}))"""


def _scored(preds):
    out = M.score_groups(preds, ["feature"], M.EVAL_METRICS["regression"])
    return out.select("feature", "metric", X.zero_safe_round("score", 5).alias("score"))


@query("single_feature_linear", S.with_views("v_nulls", more=_FOLDS.format(view="v_nulls") + _LINE) + _SCORED)
def single_feature_linear(t):
    long = G.long_features(_folded(t, V.v_nulls), V.NUM, ("row_id", "y", "cv_fold"))
    return _scored(G.line_predictions(long))


def transformed_line_predictions(df, cols, kind):
    """Out-of-fold line predictions on a quantile transform refitted for every fold."""
    # several passes read the rows
    long = G.long_features(cut(df.select("row_id", "y", "cv_fold", *cols)), cols, ("row_id", "y", "cv_fold"))
    return G.cross_line_predictions(long, kind)


from .q_prep import knots_sql  # noqa: E402

_QU_PARTS = []
for _c in V.NUM:
    for _f in range(5):
        _src = f"s_{_c}_{_f}"
        _QU_PARTS.append(f"{_src} AS MATERIALIZED (SELECT row_id, y, cv_fold, {_c} AS {_c}{_f} FROM tv)")
        _QU_PARTS.append(knots_sql(_src, f"{_c}{_f}", f"cv_fold <> {_f}").strip())
_QU_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {f} AS f, cv_fold, y, u AS x FROM s_{c}_{f} JOIN u_{c}{f} USING (row_id)" for c in V.NUM for f in range(5))


@query("single_feature_qu", S.with_views("v_nulls", more=_FOLDS.format(view="v_nulls") + "," + ",\n".join(_QU_PARTS) + f""",
ql AS MATERIALIZED ({_QU_LONG}),
pr AS MATERIALIZED (SELECT feature, f, avg(x) AS mx, avg(CASE WHEN x IS NOT NULL THEN y END) AS my, regr_slope(y, x) AS b,
  avg(CASE WHEN x IS NULL THEN y END) AS mm FROM ql WHERE cv_fold <> f GROUP BY ALL),
pd AS MATERIALIZED (SELECT feature, y, CASE WHEN x IS NULL THEN coalesce(mm, my) ELSE my + b * (x - mx) END AS p
  FROM ql JOIN pr USING (feature, f) WHERE cv_fold = f)""") + _SCORED)
def single_feature_qu(t):
    return _scored(transformed_line_predictions(_folded(t, V.v_nulls), V.NUM, "quantile_uniform"))


@query("single_feature_qn")
def single_feature_qn(t):
    return _scored(transformed_line_predictions(_folded(t, V.v_nulls), V.NUM, "quantile_normal"))


@query("single_feature_logistic")
def single_feature_logistic(t):
    df = _folded(t, V.v_bin, "y").withColumn("y", (F.col("y") == "O").cast("int"))
    long = G.long_features(df, V.NUM, ("row_id", "y", "cv_fold"))
    out = M.score_groups(G.logistic_predictions(long), ["feature"], M.EVAL_METRICS["binary"], 2)
    return out.select("feature", "metric", F.round("score", 4).alias("score"))


_STUMP = """,
lv AS MATERIALIZED (SELECT k.feature, k.f, x, count(*) AS n, sum(y) AS s FROM lg JOIN (SELECT DISTINCT feature, cv_fold AS f FROM lg) k
  ON k.feature = lg.feature AND k.f <> lg.cv_fold GROUP BY ALL),
"""


def split_sql(name: str, source: str, parts: str) -> str:
    """CTE of the best split (thr, gain) per part of a level table."""
    return f"""{name} AS MATERIALIZED (SELECT {parts}, arg_max(thr, (gain, -x)) AS thr, max(gain) AS gain FROM (
  SELECT {parts}, x, (x + nx) / 2 AS thr, cs * cs / cn + (ts - cs) * (ts - cs) / (tn - cn) - ts * ts / tn AS gain FROM (
    SELECT {parts}, x, lead(x) OVER w AS nx, sum(n) OVER w AS cn, sum(s) OVER w AS cs, sum(n) OVER (PARTITION BY {parts}) AS tn,
      sum(s) OVER (PARTITION BY {parts}) AS ts FROM {source} WINDOW w AS (PARTITION BY {parts} ORDER BY x)) WHERE nx IS NOT NULL) GROUP BY {parts})"""


def _tree(t, leaves):
    df = _folded(t, V.v_reg_signal)
    long = G.long_features(df, V.NUM, ("row_id", "y", "cv_fold"))
    preds = G.tree_predictions(long, [F.col("y")], leaves).select("row_id", "feature", "y", F.get("value", F.lit(0)).alias("pred"))
    return _scored(preds)


@query("single_feature_stump", S.with_views("v_reg_signal", more=_FOLDS.format(view="v_reg_signal") + _STUMP + split_sql("r0", "lv", "feature, f") + """,
vl AS MATERIALIZED (SELECT feature, f, x > thr AS side, sum(s) / sum(n) AS v FROM lv JOIN r0 USING (feature, f) GROUP BY ALL),
pd AS MATERIALIZED (SELECT lg.feature, y, v AS p FROM lg JOIN r0 ON r0.feature = lg.feature AND r0.f = lg.cv_fold
  JOIN vl ON vl.feature = lg.feature AND vl.f = lg.cv_fold AND vl.side = (lg.x > r0.thr))""") + _SCORED)
def single_feature_stump(t):
    return _tree(t, 2)


@query("single_feature_tree3", S.with_views("v_reg_signal", more=_FOLDS.format(view="v_reg_signal") + _STUMP + split_sql("r0", "lv", "feature, f") + """,
l1 AS MATERIALIZED (SELECT lv.*, x > thr AS side FROM lv JOIN r0 USING (feature, f)),
""" + split_sql("r1", "l1", "feature, f, side") + """,
r2 AS MATERIALIZED (SELECT feature, f, arg_max(side, gain) AS side1, arg_max(thr, gain) AS thr1 FROM r1 GROUP BY ALL),
vl AS MATERIALIZED (SELECT feature, f, side, side = side1 AND x > thr1 AS deep, sum(s) / sum(n) AS v FROM l1 JOIN r2 USING (feature, f) GROUP BY ALL),
pd AS MATERIALIZED (SELECT lg.feature, y, v AS p FROM lg JOIN r0 ON r0.feature = lg.feature AND r0.f = lg.cv_fold
  JOIN r2 ON r2.feature = lg.feature AND r2.f = lg.cv_fold
  JOIN vl ON vl.feature = lg.feature AND vl.f = lg.cv_fold AND vl.side = (lg.x > r0.thr) AND vl.deep = ((lg.x > r0.thr) = side1 AND lg.x > thr1))""") + _SCORED)
def single_feature_tree3(t):
    return _tree(t, 3)


# --------------------------------------------------------------------------
# constant predictors


@query("constant_predictor_regression", f"""
WITH f AS MATERIALIZED (SELECT o_totalprice AS y, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS cv_fold FROM orders),
p AS MATERIALIZED (SELECT f.cv_fold, y, (ts - s) / (tn - n) AS p FROM f JOIN (SELECT cv_fold, sum(y) AS s, count(*) AS n, sum(sum(y)) OVER () AS ts,
  sum(count(*)) OVER () AS tn FROM f GROUP BY 1) g USING (cv_fold))
SELECT cv_fold, metric, {S.rnd('score')} AS score FROM (
SELECT cv_fold, 'r2' AS metric, {QM.R2.format(y='y', p='p')} AS score FROM p GROUP BY cv_fold
UNION ALL SELECT cv_fold, 'd2_absolute_error', score FROM ({QM.d2_sql('p', 'cv_fold', p='p')}))""")
def constant_predictor_regression(t):
    """Contiguous 5-fold; each fold is predicted by the mean of the others; scores per fold."""
    rows = t.orders.select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("y"))
    preds = N.cross_val_constant(K.kfold(rows, 5, seed=None), "regression")
    out = M.score_groups(preds, ["cv_fold"], M.EVAL_METRICS["regression"])
    return out.select("cv_fold", "metric", X.zero_safe_round("score").alias("score"))


def _class_sql(view: str, n: int) -> str:
    names = "FO" if n == 2 else "abc"
    lp = ", ".join(f"ln((sum(c{k}) OVER () - c{k}) / CAST(sum(n) OVER () - n AS DOUBLE)) AS l{k}" for k in range(n))
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE lab = '{names[k]}') AS DOUBLE) AS c{k}" for k in range(n))
    loss = "CASE lab " + " ".join(f"WHEN '{names[k]}' THEN l{k}" for k in range(n)) + " END"
    return S.with_views(view, more=strat_cte(view, "y", 5, "row_id") + f""",
pr AS MATERIALIZED (SELECT cv_fold, {lp} FROM (SELECT cv_fold, count(*) AS n, {counts} FROM folds GROUP BY 1))""") + f"""
SELECT cv_fold, 'neg_log_loss' AS metric, {S.rnd(f'avg({loss})')} AS score FROM folds JOIN pr USING (cv_fold) GROUP BY cv_fold
UNION ALL SELECT cv_fold, '{'roc_auc' if n == 2 else 'balanced_accuracy'}', {'0.5::DOUBLE' if n == 2 else S.rnd('1 / 3.0::DOUBLE')} FROM folds GROUP BY cv_fold"""


def _class_constant(t, view, names, task):
    code = F.coalesce(*[F.when(F.col("y") == c, F.lit(i)) for i, c in enumerate(names)])
    folds = K.stratified_kfold(view(t).select("row_id", "y"), 5, "y", seed=None).withColumn("y", code)
    preds = N.cross_val_constant(folds, task, len(names))
    out = M.score_groups(preds, ["cv_fold"], M.EVAL_METRICS[task], len(names))
    return out.select("cv_fold", "metric", X.zero_safe_round("score").alias("score"))


@query("constant_predictor_binary", _class_sql("v_bin", 2))
def constant_predictor_binary(t):
    return _class_constant(t, V.v_bin, ["F", "O"], "binary")


@query("constant_predictor_multiclass", _class_sql("v_mc_signal", 3))
def constant_predictor_multiclass(t):
    return _class_constant(t, V.v_mc_signal, V.CLASSES, "multiclass")
