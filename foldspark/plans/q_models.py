"""Queries: linear models, logistic models, boosting. Features are prepared on folds 1..9."""

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import boosting as T
from ..operators import ensemble as E
from ..operators import gram as G
from ..operators import linear as L
from ..operators import logistic as LG
from ..operators import metrics as M
from ..operators import prep as P
from ..operators import ranks
from ..operators import splits as K
from . import sqllinear as Q
from . import sqltext as S
from . import views as V
from .registry import query

_TRAIN = "fold <> 0"
_KINDS = {**{c: "standard" for c in V.NUM}, **{c: "one_hot_encoding" for c in V.CAT}}


def prepared(t, view, kinds=None, labels=None):
    """Numeric training table with folds: row_id, y, cv_fold and the feature list."""
    df = view(t).filter(_TRAIN)
    if labels:
        df = K.stratified_kfold(df, 5, "y", seed=None)
        df = df.withColumn("y", F.coalesce(*[F.when(F.col("y") == c, F.lit(i)) for i, c in enumerate(labels)]))
    else:
        df = K.kfold(df, 5, seed=None)
    space = P.fit_features(df, kinds or _KINDS)
    return space.apply(df, ["row_id", "y", "cv_fold"]), space.features


def _coefs(df, features, w, b, digits=6):
    rows = [(n, round(float(v), digits) + 0.0) for n, v in zip([*features, "intercept"], [*w, b])]
    return df.sparkSession.createDataFrame(rows, "feature string, value double")


def _path(df, table, schema):
    """A path with its errors rounded."""
    return L.small_frame(df, table, schema).withColumn("mse", X.zero_safe_round("mse"))


def _gram(t, fold=None):
    df, features = prepared(t, V.v_reg_signal)
    m, s = df.agg(F.avg("y"), F.stddev_pop("y")).first()
    z = df.withColumn("y", (F.col("y") - m) / s)
    return z, G.fold_grams(z, features, "y", fold)


@query("ols_fit", Q.ridge("v_reg_signal", 0.0))
def ols_fit(t):
    df, g = _gram(t)
    return _coefs(df, g.features, *G.ridge(g.total))


@query("ridge_fit", Q.ridge("v_reg_signal", 100.0))
def ridge_fit(t):
    df, g = _gram(t)
    return _coefs(df, g.features, *G.ridge(g.total, 100.0))


@query("lasso_fit", Q.elastic("v_reg_signal", 0.01, 0.0))
def lasso_fit(t):
    df, g = _gram(t)
    return _coefs(df, g.features, *G.fit_penalised(g.total, l1=0.01))


@query("elasticnet_fit", Q.elastic("v_reg_signal", 0.01, 0.01))
def elasticnet_fit(t):
    df, g = _gram(t)
    return _coefs(df, g.features, *G.fit_penalised(g.total, l1=0.01, l2=0.01))


_ONE = S.with_views("v_reg_signal", more=f"""
tr AS MATERIALIZED (SELECT c_acctbal AS x, y FROM v_reg_signal WHERE {_TRAIN}),
st AS MATERIALIZED (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM tr),
z AS MATERIALIZED (SELECT (x - mx) / sx AS x, (y - my) / sy AS y FROM tr, st),
q AS (SELECT sum(x * x) AS sxx, sum(x * y) AS sxy, count(*) AS n FROM z)""")


@query("linear_one_feature", _ONE + f"""
SELECT 'ols' AS model, {S.rnd('sxy / sxx')} AS slope FROM q UNION ALL SELECT 'ridge', {S.rnd('sxy / (sxx + 100)')} FROM q
UNION ALL SELECT 'lasso', {S.rnd('sign(sxy) * greatest(abs(sxy / n) - 0.01, 0) / (sxx / n)')} FROM q
UNION ALL SELECT 'elasticnet', {S.rnd('sign(sxy) * greatest(abs(sxy / n) - 0.01, 0) / (sxx / n + 0.01)')} FROM q""")
def linear_one_feature(t):
    """The four penalised fits on one standardised feature, where each has a closed form."""
    df, _ = prepared(t, V.v_reg_signal, {"c_acctbal": "standard"})
    m, s = df.agg(F.avg("y"), F.stddev_pop("y")).first()
    g = G.fold_grams(df.withColumn("y", (F.col("y") - m) / s), ["c_acctbal"]).total
    fits = {"ols": G.ridge(g), "ridge": G.ridge(g, 100.0), "lasso": G.fit_penalised(g, 0.01),
            "elasticnet": G.fit_penalised(g, 0.01, 0.01)}
    return t.spark.createDataFrame([(k, round(float(w[0]), 6)) for k, (w, _) in fits.items()], "model string, slope double")


@query("ridge_loo_path", Q.loo_path("v_reg_signal"))
def ridge_loo_path(t):
    df, g = _gram(t)
    return _path(df, G.ridge_loo_path(df, g), "alpha double, mse double")


@query("lasso_cv_path", Q.elastic_path("v_reg_signal", 1.0))
def lasso_cv_path(t):
    df, g = _gram(t, "cv_fold")
    return _path(df, G.elastic_cv_path(g), "l1_ratio double, alpha double, mse double")


@query("elasticnet_cv_path", Q.elastic_path("v_reg_signal", 0.5))
def elasticnet_cv_path(t):
    df, g = _gram(t, "cv_fold")
    return _path(df, G.elastic_cv_path(g, l1_ratios=[0.5]), "l1_ratio double, alpha double, mse double")


@query("forward_selection_path", Q.forward_path("v_reg_signal"))
def forward_selection_path(t):
    df, g = _gram(t, "cv_fold")
    return _path(df, G.forward_cv_path(g), "n_features long, mse double")


@query("logistic_binary", Q.logistic("v_bin", "O", 1.0))
def logistic_binary(t):
    df, features = prepared(t, V.v_bin, labels=["F", "O"])
    task = LG.Task(LG.NO_FOLD, 1.0)
    w = LG.newton_fits(df, features, [task], 2)[task]
    return _coefs(df, features, w[0, :-1], w[0, -1], 5)


@query("logistic_multiclass")
def logistic_multiclass(t):
    df, features = prepared(t, V.v_mc_signal, labels=V.CLASSES)
    task = LG.Task(LG.NO_FOLD, 1.0)
    w = LG.newton_fits(df, features, [task], 3)[task]
    rows = [(k, n, round(float(v), 5) + 0.0) for k, r in enumerate(w) for n, v in zip([*features, "intercept"], r)]
    return t.spark.createDataFrame(rows, "label_code int, feature string, value double")


@query("logistic_cv_path")
def logistic_cv_path(t):
    df, features = prepared(t, V.v_bin, labels=["F", "O"])
    return L.small_frame(df, LG.cv_path(df, features, 2)[0], "c double, loss double")


@query("cross_val_predict_linear", S.with_views("v_reg_signal", more=f"""
tv AS MATERIALIZED (SELECT row_id, c_acctbal AS x, y, CAST(ntile(5) OVER (ORDER BY row_id) - 1 AS INTEGER) AS f FROM v_reg_signal WHERE {_TRAIN}),
st AS MATERIALIZED (SELECT avg(x) AS mx, stddev_pop(x) AS sx FROM tv),
pr AS MATERIALIZED (SELECT k.f, avg(x) AS ax, avg(y) AS ay, regr_sxy(y, x) / (regr_sxx(y, x) + 100 * any_value(sx) * any_value(sx)) AS b FROM tv JOIN
  (SELECT DISTINCT f FROM tv) k ON k.f <> tv.f, st GROUP BY k.f)""") + f"""
SELECT row_id, tv.f AS cv_fold, {S.rnd('ay + b * (x - ax)', 3)} AS pred FROM tv JOIN pr ON pr.f = tv.f""")
def cross_val_predict_linear(t):
    """Out-of-fold ridge predictions with a fixed penalty of 100 on one standardised feature."""
    df, features = prepared(t, V.v_reg_signal, {"c_acctbal": "standard"})
    model = L.LinearCV("regression", reg_coefs=[100.0]).fit(df, features)
    return model.cross_val_predict(df, coef=100.0).select("row_id", "cv_fold", X.zero_safe_round("pred", 3).alias("pred"))


# --------------------------------------------------------------------------
# staged predictions and learning curves


def _stages(t):
    """Increments of 20 rounds per order: a geometric approach to the price with keyed noise."""
    p = V.p_reg(t)
    r = F.explode(F.sequence(F.lit(0), F.lit(19))).alias("round")
    long = p.select("row_id", "subset", "y", "pred_a", r)
    return long.select("row_id", "subset", "y", "round", (F.col("pred_a") * F.pow(F.lit(0.5), F.col("round") + 1)).alias("increment"))


_ST = """sg AS MATERIALIZED (SELECT row_id, subset, y, CAST(r AS INTEGER) AS round, pred_a * pow(0.5::DOUBLE, r + 1) AS increment
  FROM p_reg, (SELECT unnest(range(20)) AS r)),
cs AS MATERIALIZED (SELECT row_id, subset, y, round, sum(increment) OVER (PARTITION BY row_id ORDER BY round) AS pred FROM sg)"""


@query("staged_predictions", S.with_views("p_reg", more=_ST) + f"""
SELECT row_id, round, {S.rnd('pred', 3)} AS pred FROM cs WHERE (round + 1) % 4 = 0 OR round = 19""")
def staged_predictions(t):
    return E.staged(_stages(t).select("row_id", "round", "increment"), 4).select(
        "row_id", "round", X.zero_safe_round("pred", 3).alias("pred"))


@query("learning_curve", S.with_views("p_reg", more=_ST) + f"""
SELECT subset, round, {S.rnd('sqrt(avg((y - pred) * (y - pred)))', 3)} AS rmse FROM cs GROUP BY ALL""")
def learning_curve(t):
    """RMSE per subset and round."""
    long = _stages(t)
    staged = E.staged(long.select("row_id", "round", "increment"))
    e = staged.join(V.p_reg(t).select("row_id", "subset", "y"), "row_id").withColumn("e", F.col("y") - F.col("pred"))
    return e.groupBy("subset", "round").agg(X.zero_safe_round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 3).alias("rmse"))


@query("staged_auc", S.with_views("p_bin", more=f"""
sg AS MATERIALIZED (SELECT CAST(s AS INTEGER) AS step, y, round(logit + (50 - s) * (({S.u01(21, 'row_id')}) - 0.5) / 5, 3) AS logit FROM p_bin, (SELECT unnest(range(50)) AS s)),
lv AS MATERIALIZED (SELECT step, logit, sum(y) AS pos, sum(1 - y) AS neg FROM sg GROUP BY ALL),
cm AS MATERIALIZED (SELECT *, sum(neg) OVER (PARTITION BY step ORDER BY logit) AS cn FROM lv)""") + f"""
SELECT step, {S.rnd('sum(pos * (cn - neg / 2.0::DOUBLE)) / (CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE))')} AS score FROM cm GROUP BY step""")
def staged_auc(t):
    """AUC of fifty prediction vectors of the same rows in one grouped pass."""
    from ..functions.hashing import with_u01

    p = with_u01(ranks.spread(V.p_bin(t), "row_id"), {"u": 21})
    step = F.explode(F.sequence(F.lit(0), F.lit(49))).alias("step")
    rows = p.select("y", "logit", "u", step)
    noisy = rows.select("step", "y", F.round(F.col("logit") + (50 - F.col("step")) * (F.col("u") - 0.5) / 5, 3).alias("logit"))
    return M.roc_auc(noisy, ["step"], pred="logit").select("step", X.zero_safe_round("score").alias("score"))


def _boost_rows(t, view, labels=None):
    df = view(t)
    if labels:
        df = df.withColumn("y", F.coalesce(*[F.when(F.col("y") == c, F.lit(i)) for i, c in enumerate(labels)]))
    return df.select("row_id", "y", "fold", *V.NUM, *V.CAT), [*V.NUM, *V.CAT]


def _boosting(task, n_classes=None):
    """Boosting with the recipe's rounds, patience and depth."""
    from .recipes import BoostingRecipe as R

    return T.Boosting(task, n_classes, depth=R.depth, learning_rate=R.learning_rate, max_rounds=R.max_rounds,
                      early_stopping_rounds=R.patience)


@query("boosting_fit")
def boosting_fit(t):
    """Multiclass boosting until early stopping ends it; log loss of each subset."""
    rows, features = _boost_rows(t, V.v_mc_signal, V.CLASSES)
    model = _boosting("multiclass", 3)
    model.fit(rows.filter("fold > 1"), features, rows.filter("fold = 1"))
    scored = V.with_subset(model.predict(rows))
    return M.score_groups(scored, ["subset"], ["neg_log_loss", "balanced_accuracy"], 3)


@query("boosting_with_init")
def boosting_with_init(t):
    """Boosting on top of a linear fit: the start prediction is a column, trees learn the rest."""
    rows, features = _boost_rows(t, V.v_reg_signal)
    g = G.fold_grams(rows.filter("fold > 1"), ["c_acctbal", "n_mod"]).total
    w, b = G.ridge(g)
    rows = rows.withColumn("init", L.dot(["c_acctbal", "n_mod"], w, b))
    model = _boosting("regression")
    model.fit(rows.filter("fold > 1"), features, rows.filter("fold = 1"), init="init")
    scored = V.with_subset(model.predict(rows, init="init"))
    both = scored.select("subset", "y", F.explode(F.array(
        F.struct(F.lit("init").alias("model"), F.col("init").alias("pred")),
        F.struct(F.lit("boosted").alias("model"), F.col("pred").alias("pred")))).alias("c")).select("subset", "y", "c.*")
    return M.score_groups(both, ["subset", "model"], ["r2"])




_FEW = ["n_year", "n_dec", *V.CAT]


def _rounds_sql(rounds: int, depth: int) -> str:
    """The same boosting as unrolled SQL: histograms of every level, the best split of all nodes, leaves, margins."""
    values = ", ".join(f"({i}, CAST({c} AS VARCHAR), {('n_year', 'n_dec').index(c) if c.startswith('n_') else 9})" for i, c in enumerate(_FEW))
    sql = S.with_views("v_reg_signal", more=f"""
base AS MATERIALIZED (SELECT row_id, y, fold, n_year, n_mod % 10 AS n_dec, {', '.join(V.CAT)} FROM v_reg_signal),
cell AS MATERIALIZED (SELECT row_id, fold > 1 AS train, f, v, num < 9 AS numeric, if(num < 9, CAST(v AS DOUBLE), NULL) AS x
  FROM (SELECT row_id, fold, unnest([{', '.join(f"{{'f': {i}, 'v': CAST({c} AS VARCHAR), 'num': {0 if c.startswith('n_') else 9}}}" for i, c in enumerate(_FEW))}], recursive := true) FROM base)),
border AS MATERIALIZED (SELECT f, x, CAST(row_number() OVER (PARTITION BY f ORDER BY x) AS INTEGER) AS code FROM (SELECT DISTINCT f, x FROM cell WHERE numeric AND train)
  QUALIFY x < max(x) OVER (PARTITION BY f)),
known AS MATERIALIZED (SELECT f, v, CAST(row_number() OVER (PARTITION BY f ORDER BY count(*) DESC, v) AS INTEGER) AS code FROM cell WHERE NOT numeric AND train GROUP BY f, v),
coded AS MATERIALIZED (SELECT row_id, train, cell.f, numeric, CAST(if(numeric, 1 + (SELECT count(*) FROM border b WHERE b.f = cell.f AND b.x < cell.x), coalesce(known.code, 0)) AS INTEGER) AS code
  FROM cell LEFT JOIN known ON known.f = cell.f AND known.v = cell.v),
choice AS MATERIALIZED (SELECT f, code, true AS numeric FROM border UNION ALL SELECT f, code, false FROM known),
m0 AS MATERIALIZED (SELECT row_id, fold > 1 AS train, y, (SELECT avg(y) FROM base WHERE fold > 1) AS m FROM base)""")
    for r in range(1, rounds + 1):
        sql += f""",
n{r}_0 AS (SELECT row_id, train, y - m AS g, 0 AS node FROM m{r - 1})"""
        for k in range(depth):
            now = f"{r}_{k}"
            sql += f""",
h{now} AS MATERIALIZED (SELECT node, f, code, sum(g) AS g, count(*) AS n FROM n{now} JOIN coded USING (row_id) WHERE n{now}.train GROUP BY ALL),
t{now} AS MATERIALIZED (SELECT node, sum(g) AS g, count(*) AS n FROM n{now} WHERE train GROUP BY node),
b{now} AS MATERIALIZED (SELECT f, code, numeric FROM (SELECT c.f, c.code, c.numeric, t.node, t.g, t.n, coalesce(sum(h.g), 0) AS lg, coalesce(sum(h.n), 0) AS ln
    FROM choice c CROSS JOIN t{now} t LEFT JOIN h{now} h ON h.node = t.node AND h.f = c.f AND if(c.numeric, h.code <= c.code, h.code = c.code) GROUP BY ALL)
  GROUP BY f, code, numeric ORDER BY sum(lg * lg / (ln + 3.0::DOUBLE) + (g - lg) * (g - lg) / (n - ln + 3.0::DOUBLE)) DESC, f, code LIMIT 1),
n{r}_{k + 1} AS MATERIALIZED (SELECT n.row_id, n.train, n.g, n.node + if(if(b.numeric, c.code > b.code, c.code <> b.code), {1 << k}, 0) AS node
  FROM n{now} n JOIN coded c USING (row_id) JOIN b{now} b ON b.f = c.f)"""
        sql += f""",
v{r} AS (SELECT node, 0.1::DOUBLE * sum(g) / (count(*) + 3.0::DOUBLE) AS v FROM n{r}_{depth} WHERE train GROUP BY node),
m{r} AS MATERIALIZED (SELECT o.row_id, o.train, o.y, o.m + coalesce(v, 0) AS m FROM m{r - 1} o JOIN n{r}_{depth} n USING (row_id) LEFT JOIN v{r} USING (node))"""
    parts = " UNION ALL ".join(f"SELECT {r - 1} AS round, row_id, y, m FROM m{r}" for r in range(1, rounds + 1))
    return sql + f"""
SELECT CAST(round AS INTEGER) AS round, CASE fold WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS subset, count(*) AS n, {S.rnd('sqrt(avg((p.y - m) * (p.y - m)))', 3)} AS rmse,
       {S.rnd('sum(m * (1 + p.row_id % 7))', 0)} AS mark
FROM ({parts}) p JOIN base USING (row_id) GROUP BY ALL"""


@query("boosting_rounds", _rounds_sql(4, 3))
def boosting_rounds(t):
    """Learning curve of a fitted model: four rounds of depth three, error of each round and subset."""
    rows = V.with_subset(V.v_reg_signal(t).withColumn("n_dec", F.col("n_mod") % 10))
    model = T.Boosting("regression", depth=3, max_rounds=4).fit(rows.filter("fold > 1"), _FEW)
    staged = model.staged(rows.select("row_id", "subset", "y", *_FEW))
    e = F.col("y") - F.col("pred")
    return staged.groupBy("round", "subset").agg(
        F.count(F.lit(1)).alias("n"), X.zero_safe_round(F.sqrt(F.avg(e * e)), 3).alias("rmse"),
        X.zero_safe_round(F.sum(F.col("pred") * (1 + F.col("row_id") % 7)), 0).alias("mark"))
