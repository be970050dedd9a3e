"""Queries: feature preparation. Training rows are folds 1..9, applied to all rows."""

from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import prep as P
from ..operators import rows as R
from ..operators.ranks import fit_small
from . import sqltext as S
from . import views as V
from .registry import query

_TRAIN = "fold <> 0"


def _numeric(t, kind):
    df = V.v_nulls(t)
    fits = P.fit_numeric(df.filter(_TRAIN), {c: kind for c in V.NUM})
    cols = [c for f in V.NUM for c in fits[f].columns(f)]
    out = df.select("row_id", *cols)
    return out.withColumns({c: X.zero_safe_round(c) for c in out.columns if c != "row_id"})


def _num_sql(expr, fill):
    """Columns of the three numeric features; only c_acctbal has missing values."""
    cols = [f"{S.rnd(f'coalesce({expr.format(c=c)}, {fill.format(c=c)})')} AS {c}" for c in V.NUM]
    cols.append(S.rnd("CAST(c_acctbal IS NULL AS DOUBLE)") + " AS c_acctbal__missing")
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, quantile_cont({c}, 0.25) AS a_{c}, "
                      f"quantile_cont({c}, 0.5) AS b_{c}, quantile_cont({c}, 0.75) AS c_{c}" for c in V.NUM)
    return S.with_views("v_nulls", more=f"st AS MATERIALIZED (SELECT {stats} FROM v_nulls WHERE {_TRAIN})") + \
        f"SELECT row_id, {', '.join(cols)} FROM v_nulls, st"


@query("impute_mean_indicator", _num_sql("{c}", "m_{c}"))
def impute_mean_indicator(t):
    return _numeric(t, "identity")


@query("standard_scale", _num_sql("({c} - m_{c}) / s_{c}", "0"))
def standard_scale(t):
    return _numeric(t, "standard")


@query("robust_scale", _num_sql("({c} - b_{c}) / (c_{c} - a_{c})", "(m_{c} - b_{c}) / (c_{c} - a_{c})"))
def robust_scale(t):
    return _numeric(t, "robust")


def knots_sql(source: str, c: str, where: str, k: int = 1000) -> str:
    """CTE kn_<c>: distinct knots with first and last reference and the next knot's."""
    return f"""
kq_{c} AS MATERIALIZED (SELECT unnest(quantile_cont(CAST({c} AS DOUBLE), [x / {k - 1}.0::DOUBLE FOR x IN range({k})])) AS v, unnest(range({k})) AS i
  FROM {source} WHERE {where}),
kn_{c} AS MATERIALIZED (SELECT v, lo, hi, lead(v) OVER (ORDER BY v) AS nv, lead(lo) OVER (ORDER BY v) AS nlo FROM (
  SELECT v, min(i) / {k - 1}.0::DOUBLE AS lo, max(i) / {k - 1}.0::DOUBLE AS hi FROM kq_{c} GROUP BY v)),
u_{c} AS MATERIALIZED (SELECT s.row_id, CASE WHEN s.{c} IS NULL THEN NULL WHEN k.v IS NULL THEN 0.0
    WHEN k.nv IS NULL THEN CASE WHEN s.{c} = (SELECT min(v) FROM kn_{c}) THEN 0.0 ELSE 1.0 END
    WHEN s.{c} = k.v THEN CASE WHEN k.lo = 0 THEN 0.0 ELSE (k.lo + k.hi) / 2 END
    ELSE k.hi + (s.{c} - k.v) * (k.nlo - k.hi) / (k.nv - k.v) END AS u
  FROM {source} s ASOF LEFT JOIN kn_{c} k ON s.{c} >= k.v)"""


_QU = S.with_views("v_nulls", more=",".join(knots_sql("v_nulls", c, _TRAIN) for c in V.NUM) + f""",
mu AS (SELECT avg(u) AS m FROM u_c_acctbal JOIN v_nulls USING (row_id) WHERE {_TRAIN})""") + f"""
SELECT v.row_id, {S.rnd('coalesce(a.u, m)')} AS c_acctbal, {S.rnd('CAST(a.u IS NULL AS DOUBLE)')} AS c_acctbal__missing,
  {S.rnd('b.u')} AS n_year, {S.rnd('c.u')} AS n_mod
FROM v_nulls v JOIN u_c_acctbal a USING (row_id) JOIN u_n_year b USING (row_id) JOIN u_n_mod c USING (row_id), mu"""


@query("quantile_uniform", _QU)
def quantile_uniform(t):
    return _numeric(t, "quantile_uniform")


@query("quantile_normal")
def quantile_normal(t):
    return _numeric(t, "quantile_normal")


_VOCAB = f"""
ct AS MATERIALIZED (SELECT 'cat' AS feature, cat AS category, count(*) AS n FROM v_rare WHERE {_TRAIN} GROUP BY ALL
  UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM v_rare WHERE {_TRAIN} GROUP BY ALL
  UNION ALL SELECT 'half', CASE WHEN o_orderpriority < '3' THEN 'high' END, count(*) FROM v_rare WHERE {_TRAIN} GROUP BY ALL),
sz AS MATERIALIZED (SELECT feature, count(*) FILTER (WHERE n >= 10) AS nf, max(CAST(n < 10 AS INTEGER)) AS hr FROM ct GROUP BY 1),
vc AS MATERIALIZED (SELECT feature, category, n, n >= 10 AS is_frequent,
  CAST(CASE WHEN n >= 10 THEN row_number() OVER (PARTITION BY feature, n >= 10 ORDER BY category NULLS LAST) - 1 ELSE nf END
    - CASE WHEN nf + hr = 2 THEN 1 ELSE 0 END AS INTEGER) AS idx,
  CAST(nf + hr - CASE WHEN nf + hr = 2 THEN 1 ELSE 0 END AS INTEGER) AS width FROM ct JOIN sz USING (feature))"""
_HOT = ["cat", "o_orderstatus", "half"]


def _rare(t):
    return V.v_rare(t).withColumn("half", F.when(F.col("o_orderpriority") < "3", "high"))


@query("one_hot_vocab", S.with_views("v_rare", more=_VOCAB) + "SELECT * FROM vc")
def one_hot_vocab(t):
    return P.one_hot_vocab(_rare(t).filter(_TRAIN), _HOT)


@query("one_hot_encode", S.with_views("v_rare", more=_VOCAB) + """
SELECT row_id, CASE WHEN i1 >= 0 THEN i1 END AS cat__idx, CASE WHEN i2 >= 0 THEN i2 END AS half__idx FROM (
SELECT v.row_id, coalesce(a.idx, (SELECT max(idx) FROM vc WHERE feature = 'cat' AND NOT is_frequent)) AS i1,
  coalesce(b.idx, (SELECT max(idx) FROM vc WHERE feature = 'half' AND NOT is_frequent)) AS i2
FROM v_rare v LEFT JOIN (SELECT * FROM vc WHERE feature = 'cat') a ON v.cat = a.category
LEFT JOIN (SELECT * FROM vc WHERE feature = 'half') b ON b.category IS NOT DISTINCT FROM CASE WHEN v.o_orderpriority < '3' THEN 'high' END)""")
def one_hot_encode(t):
    df = _rare(t)
    vocab = fit_small(P.one_hot_vocab(df.filter(_TRAIN), _HOT))
    out = P.one_hot_index(P.one_hot_index(df, vocab, "cat"), vocab, "half")
    return out.select("row_id", "cat__idx", "half__idx")


@query("ohe_output_size", S.with_views("v_rare", more=_VOCAB) + "SELECT DISTINCT feature, width FROM vc")
def ohe_output_size(t):
    return P.one_hot_width(P.category_counts(_rare(t).filter(_TRAIN), _HOT))


@query("choose_encoding", S.with_views("v_rare", more=_VOCAB) + """
SELECT DISTINCT feature, width, CASE WHEN 3 < width THEN 'target_encoding' ELSE 'one_hot_encoding' END AS encoding FROM vc""")
def choose_encoding(t):
    return P.choose_encoding(_rare(t).filter(_TRAIN), _HOT, target_width=3)


def te_sql(y: str, folds: str = "") -> str:
    """CTEs: encodings of cat for target y; cross-fitted ones by fold f when folds are given."""
    enc = """CASE WHEN v0 * n + vi > 0 THEN v0 * n / (v0 * n + vi) * mi + (1 - v0 * n / (v0 * n + vi)) * m0 ELSE m0 END"""
    full = f"""
g0 AS MATERIALIZED (SELECT avg({y}) AS m0, var_pop({y}) AS v0 FROM tr),
ef AS MATERIALIZED (SELECT cat, {enc} AS enc FROM (SELECT cat, count(*) AS n, avg({y}) AS mi, var_pop({y}) AS vi FROM tr GROUP BY 1), g0)"""
    if not folds:
        return full
    return full + f""",
gf AS MATERIALIZED (SELECT k.te_fold, avg({y}) AS m0, var_pop({y}) AS v0 FROM tr, (SELECT DISTINCT te_fold FROM tr) k WHERE tr.te_fold <> k.te_fold GROUP BY 1),
ec AS MATERIALIZED (SELECT cat, te_fold, {enc} AS enc FROM (
  SELECT cat, k.te_fold, count(*) AS n, avg({y}) AS mi, var_pop({y}) AS vi FROM tr, (SELECT DISTINCT te_fold FROM tr) k WHERE tr.te_fold <> k.te_fold GROUP BY ALL)
  JOIN gf USING (te_fold))"""


@query("target_encode_full", S.with_views("v_rare", more="tr AS MATERIALIZED (SELECT * FROM v_rare WHERE fold <> 0)," + te_sql("y")) + f"""
SELECT row_id, {S.rnd('coalesce(enc, m0)', 5)} AS enc FROM v_rare LEFT JOIN ef USING (cat), g0""")
def target_encode_full(t):
    """Full-fit encoding of every row, folds unused."""
    df = V.v_rare(t).select("row_id", "cat", "y", "fold")
    fit = P.fit_target(df.filter(_TRAIN).withColumn("te_fold", F.lit(0)), ["cat"])["cat"]
    return P.apply_target(df, fit).select("row_id", X.zero_safe_round("cat__te", 5).alias("enc"))


_K25 = f"""tr AS MATERIALIZED (SELECT *, CAST(ntile(25) OVER (ORDER BY {S.u32(0, 'row_id')}, row_id) - 1 AS INTEGER) AS te_fold
  FROM v_rare WHERE fold <> 0),"""


def _with_folds(df, label=None):
    """All rows with the cross-fitting fold of training rows."""
    train = df.filter(_TRAIN)
    folded = P.target_folds(train.select("row_id", *([label] if label else [])), label, to=df)
    return folded.withColumn("te_fold", F.when(F.expr(_TRAIN), F.col("te_fold")))


@query("target_encode_crossfit", S.with_views("v_rare", more=_K25 + te_sql("y", "k")) + f"""
SELECT v.row_id, {S.rnd('CASE WHEN v.fold = 0 THEN coalesce(ef.enc, m0) ELSE coalesce(ec.enc, gm0) END', 5)} AS enc
FROM v_rare v LEFT JOIN ef ON ef.cat = v.cat LEFT JOIN tr ON tr.row_id = v.row_id
LEFT JOIN (SELECT te_fold AS tf, m0 AS gm0 FROM gf) x ON x.tf = tr.te_fold
LEFT JOIN ec ON ec.cat = v.cat AND ec.te_fold = tr.te_fold, g0""")
def target_encode_crossfit(t):
    df = _with_folds(V.v_rare(t).select("row_id", "cat", "y", "fold"))
    fit = P.fit_target(df.filter(_TRAIN), ["cat"])["cat"]
    return P.apply_target(df, fit, fold="te_fold").select("row_id", X.zero_safe_round("cat__te", 5).alias("enc"))


@query("target_encode_multiclass", S.with_views("v_rare", "v_mc_signal") + " UNION ALL ".join(f"""
SELECT row_id, {k} AS label_code, {S.rnd('coalesce(enc, m0)')} AS enc FROM (
  WITH tr AS MATERIALIZED (SELECT r.cat, CAST(m.y = '{c}' AS DOUBLE) AS y FROM v_rare r JOIN v_mc_signal m USING (row_id) WHERE r.fold <> 0), {te_sql('y')}
  SELECT row_id, enc, m0 FROM v_rare LEFT JOIN ef USING (cat), g0)""" for k, c in enumerate(V.CLASSES)))
def target_encode_multiclass(t):
    """One encoding per class, in long form."""
    labels = V.v_mc_signal(t).select("row_id", F.expr("cast(ascii(y) - 97 as int)").alias("y"))
    df = V.v_rare(t).select("row_id", "cat", "fold").join(labels, "row_id")
    space = P.fit_features(df.filter(_TRAIN).withColumn("te_fold", F.lit(0)), {"cat": "target_encoding"}, n_classes=3)
    wide = space.apply(df, ["row_id"])
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"cat__te{k}").alias("e")) for k in range(3)]))
    return wide.select("row_id", cells.alias("c")).select(
        "row_id", F.col("c.k").alias("label_code"), X.zero_safe_round("c.e").alias("enc"))


@query("combine_transforms", S.with_views("v_nulls", more=f"""
st AS MATERIALIZED (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s, quantile_cont(n_mod, 0.25) AS a, quantile_cont(n_mod, 0.5) AS b,
  quantile_cont(n_mod, 0.75) AS c FROM v_nulls WHERE {_TRAIN})""") + f"""
SELECT row_id, {S.rnd('coalesce((c_acctbal - m) / s, 0)')} AS c_acctbal, {S.rnd('CAST(c_acctbal IS NULL AS DOUBLE)')} AS c_acctbal__missing,
  {', '.join(f"CAST(o_orderstatus = '{x}' AS DOUBLE) AS o_orderstatus__{i}" for i, x in enumerate('FOP'))},
  {S.rnd('(n_mod - b) / (c - a)')} AS n_mod, 0.0::DOUBLE AS __dummy__ FROM v_nulls, st""")
def combine_transforms(t):
    """Three transforms in one projection, other columns dropped, a zero column appended."""
    df = V.v_nulls(t)
    space = P.fit_features(df.filter(_TRAIN), {"c_acctbal": "standard", "o_orderstatus": "one_hot_encoding", "n_mod": "robust"})
    out = space.apply(df, ["row_id"])
    return out.withColumns({c: X.zero_safe_round(c) for c in ("c_acctbal", "c_acctbal__missing", "n_mod")})


@query("fill_missing_categorical", S.with_views("v_nulls") + """
SELECT row_id, coalesce(c_mktsegment, 'missing') AS c_mktsegment, coalesce(s, 'UNKNOWN') AS s FROM (
  SELECT row_id, c_mktsegment, CASE WHEN row_id % 3 = 0 THEN NULL WHEN row_id % 3 = 1 THEN 'UNKNOWN' ELSE 'None' END AS s FROM v_nulls)""")
def fill_missing_categorical(t):
    """One column without a word for missing, one that has two (unknown wins over none)."""
    k = F.col("row_id") % 3
    df = V.v_nulls(t).select("row_id", "c_mktsegment", F.when(k == 1, "UNKNOWN").when(k == 2, "None").alias("s"))
    return R.fill_missing_category(df, ["c_mktsegment", "s"])


@query("target_transform_roundtrip", S.with_views("v_reg") + f"""
SELECT kind, {S.rnd('max(err)', 2)} AS max_error, count(*) AS n_rows FROM
  (SELECT unnest(['none', 'symlog', 'standard', 'quantile_uniform']) AS kind, 0.0::DOUBLE AS err FROM v_reg) GROUP BY kind""")
def target_transform_roundtrip(t):
    """Largest relative error (percent of the value range) of each target transform and its inverse inside the training range."""
    df = V.v_reg(t).select("row_id", "y")
    kinds = ["none", "symlog", "standard", "quantile_uniform"]
    cols = []
    for k in kinds:
        f = P.fit_target_transform(df, k)
        cols.append(F.abs(f.inverse(f.forward(F.col("y"))) - F.col("y")).alias(k))
    long = df.select(*cols).unpivot([], kinds, "kind", "err")
    return long.groupBy("kind").agg(X.zero_safe_round(F.max("err") / 500_000, 2).alias("max_error"),
                                    F.count(F.lit(1)).alias("n_rows"))


@query("feature_profile", S.with_views("v_nulls") + " UNION ALL ".join(f"""
SELECT '{c}' AS feature, {S.rnd('CASE WHEN a = b AND mn = mx THEN 0 WHEN a = b THEN mn ELSE a END')} AS vmin,
  {S.rnd('CASE WHEN a = b AND mn = mx THEN 1 WHEN a = b THEN mx ELSE b END')} AS vmax, CAST(NULL AS BIGINT) AS n_categories FROM (
  SELECT quantile_cont({c}, 0.05) AS a, quantile_cont({c}, 0.95) AS b, min({c}) AS mn, max({c}) AS mx FROM v_nulls)""" for c in V.NUM)
       + "".join(f" UNION ALL SELECT '{c}', NULL, NULL, count(DISTINCT {c}) FROM v_nulls" for c in V.CAT))
def feature_profile(t):
    df = V.v_nulls(t)
    num = P.value_ranges(df, V.NUM).select("feature", X.zero_safe_round("vmin").alias("vmin"),
                                           X.zero_safe_round("vmax").alias("vmax"), F.lit(None).cast("long").alias("n_categories"))
    counts = P.category_counts(df, V.CAT).groupBy("feature").agg(F.count("category").alias("n_categories"))
    null = F.lit(None).cast("double")
    return num.unionByName(counts.select("feature", null.alias("vmin"), null.alias("vmax"), "n_categories"))


@query("feature_scaled_clip", S.with_views("v_nulls") + "SELECT row_id, " + ", ".join(
    S.rnd(f"CASE WHEN {c} IS NOT NULL THEN least(greatest(({c} - a_{c}) / (b_{c} - a_{c}), 0), 1) END") + f" AS {c}" for c in V.NUM)
       + " FROM v_nulls, (SELECT " + ", ".join(f"quantile_cont({c}, 0.05) AS a_{c}, quantile_cont({c}, 0.95) AS b_{c}" for c in V.NUM) + " FROM v_nulls)")
def feature_scaled_clip(t):
    out = P.scaled_clip(V.v_nulls(t).select("row_id", *V.NUM), V.NUM)
    return out.select("row_id", *[F.when(F.col(c).isNotNull(), X.zero_safe_round(c)).alias(c) for c in V.NUM])


