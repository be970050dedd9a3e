"""SQL of the linear models: Gram matrices as lists, solved by Gauss-Jordan steps and coordinate descent in recursions."""

from __future__ import annotations

from ..operators.gram import ALPHAS
from . import sqltext as S
from . import views as V

_TRAIN = "fold <> 0"


def _hot(c: str) -> str:
    return f"[if({c} = v, 1.0::DOUBLE, 0.0) FOR v IN k_{c}]"


def design(view: str, fold: str = "0", target: str | None = None) -> str:
    """CTEs: ``names``, ``rows_`` (f, x with a last 1 and the target), of the training rows with standardised numbers."""
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in V.NUM) + ", "
    if target is None:
        stats, target = f"{stats} avg(y) AS my, stddev_pop(y) AS sy, ", "(y - my) / sy"
    kinds = ", ".join(f"list(DISTINCT {c} ORDER BY {c}) AS k_{c}" for c in V.CAT)
    numbers = "[" + ", ".join(f"({c} - m_{c}) / s_{c}" for c in V.NUM) + "]"
    x = " || ".join([numbers, *map(_hot, V.CAT), "[0.0::DOUBLE, 1.0]"])
    names = " || ".join([str([*V.NUM]), *(f"['{c}__' || i FOR i IN range(len(k_{c}))]" for c in V.CAT), "['__dummy__']"])
    group = " || ".join([str([0] * len(V.NUM)), *(f"[{i} FOR v IN k_{c}]" for i, c in enumerate(V.CAT, 1)), "[99]"])
    return f"""tr AS MATERIALIZED (SELECT *, {fold} AS f FROM {view} WHERE {_TRAIN}),
st AS MATERIALIZED (SELECT {stats} {kinds} FROM tr),
names AS MATERIALIZED (SELECT {names} AS names, {group} AS grp FROM st),
rows_ AS MATERIALIZED (SELECT f, ({x}) || [{target}] AS x FROM tr, st)"""


#: Cross products per fold as a list of lists; the last two columns are the constant and the target.
GRAMS = """cell AS MATERIALIZED (SELECT f, i, j, sum(x[i] * x[j]) AS v FROM rows_, (SELECT unnest(range(1, 60)) AS i) a, (SELECT unnest(range(1, 60)) AS j) b
  WHERE i <= len(x) AND j <= len(x) GROUP BY ALL),
line AS MATERIALIZED (SELECT f, i, list(v ORDER BY j) AS v FROM cell GROUP BY ALL),
own AS MATERIALIZED (SELECT f, list(v ORDER BY i) AS g FROM line GROUP BY f)"""

#: n, means, and the centred products of a matrix ``g`` with features 1..d, the constant d + 1 and the target d + 2.
CENTRED = """shape AS MATERIALIZED (SELECT *, len(g) - 2 AS d, g[len(g) - 1][len(g) - 1] AS n FROM given),
centred AS MATERIALIZED (SELECT * EXCLUDE (g), g, [g[i][d + 1] / n FOR i IN range(1, d + 1)] AS mx, g[d + 1][d + 2] / n AS my,
  [[g[i][j] - g[i][d + 1] * g[j][d + 1] / n FOR j IN range(1, d + 1)] FOR i IN range(1, d + 1)] AS sxx,
  [g[i][d + 2] - g[i][d + 1] * g[d + 1][d + 2] / n FOR i IN range(1, d + 1)] AS sxy,
  g[d + 2][d + 2] - g[d + 1][d + 2] * g[d + 1][d + 2] / n AS syy FROM shape)"""


def start(view: str, fold: str = "0", given: str = "SELECT g FROM own") -> str:
    return S.with_views(view, more=", ".join([design(view, fold), GRAMS, f"given AS MATERIALIZED ({given})", CENTRED])).replace(
        "WITH ", "WITH RECURSIVE ", 1)


def gauss_jordan(source: str, name: str = "solved") -> str:
    """CTE (key, m): the reduced form of every matrix of a source (key, m, d), whose first d columns become the unit matrix."""
    return f""",
{name}_step(key, k, d, m) AS (SELECT key, 1, d, m FROM ({source}) UNION ALL
  SELECT key, k + 1, d, [if(i = k, p, [m[i][j] - m[i][k] * p[j] FOR j IN range(1, len(p) + 1)]) FOR i IN range(1, len(m) + 1)]
  FROM (SELECT *, [v / m[k][k] FOR v IN m[k]] AS p FROM {name}_step WHERE k <= d)),
{name} AS (SELECT key, m FROM {name}_step WHERE k = d + 1)"""


def coefficients(w: str) -> str:
    """Rows (feature, value) of the weights of a table (w, mx, my)."""
    return f""",
found AS (SELECT names, w, my - list_dot_product(mx, w) AS b FROM ({w}), names)
SELECT unnest(names || ['intercept']) AS feature, unnest([{S.rnd('v')} FOR v IN w || [b]]) AS value FROM found"""


def ridge(view: str, alpha: float) -> str:
    """Ridge, or with alpha 0 least squares of minimum norm: the sums of one-hot groups and the empty column are held at 0."""
    held = f"if(i = j, {alpha}, 0.0)" if alpha else "if(grp[i] > 0 AND grp[i] = grp[j], n, 0.0)"
    source = f"SELECT 0 AS key, d, [[sxx[i][j] + {held} FOR j IN range(1, d + 1)] || [sxy[i]] FOR i IN range(1, d + 1)] AS m FROM centred, names"
    return start(view) + gauss_jordan(source) + coefficients("SELECT [r[d + 1] FOR r IN m] AS w, mx, my FROM solved, centred")


def descent(source: str, sweeps: int) -> str:
    """CTE ``fitted`` (key..., w): coordinate descent on a source (key, q, c, l1, l2)."""
    return f""",
problem AS MATERIALIZED ({source}),
walk(key, k, w) AS (SELECT key, 0, [0.0::DOUBLE FOR v IN c] FROM problem UNION ALL
  SELECT key, k + 1, w[:j - 1] || [if(q[j][j] <= 1e-14, 0.0, sign(rho) * greatest(abs(rho) - l1, 0) / (q[j][j] + l2))] || w[j + 1:]
  FROM (SELECT walk.*, q, l1, l2, k % len(c) + 1 AS j, c[k % len(c) + 1] - list_dot_product(q[k % len(c) + 1], w)
        + q[k % len(c) + 1][k % len(c) + 1] * w[k % len(c) + 1] AS rho FROM walk JOIN problem USING (key) WHERE k < {sweeps} * len(c))),
fitted AS (SELECT walk.key, w FROM walk JOIN problem USING (key) WHERE k = {sweeps} * len(c))"""


_MEAN = "[[v / n FOR v IN r] FOR r IN sxx] AS q, [v / n FOR v IN sxy] AS c"


def elastic(view: str, l1: float, l2: float) -> str:
    source = f"SELECT 0 AS key, {_MEAN}, {l1} AS l1, {l2} AS l2 FROM centred"
    return start(view) + descent(source, 300) + coefficients("SELECT w, mx, my FROM fitted, centred")


#: Folds of the training rows in order of their ids, and the products of all other folds.
FOLD = "CAST(ntile(5) OVER (ORDER BY row_id) - 1 AS INTEGER)"
OTHERS = """SELECT f, [[list_sum([o.g[i][j] FOR o IN rest]) FOR j IN range(1, len(held) + 1)] FOR i IN range(1, len(held) + 1)] AS g, held
  FROM (SELECT a.f, a.g AS held, list({'g': b.g}) AS rest FROM own a JOIN own b ON a.f <> b.f GROUP BY ALL)"""
_LOSS = "list_dot_product([list_dot_product(r, v) FOR r IN held], v) / held[len(held) - 1][len(held) - 1]"


def elastic_path(view: str, ratio: float) -> str:
    alphas = ", ".join(repr(float(a)) for a in ALPHAS)
    source = f"""SELECT {{'f': f, 'alpha': alpha}} AS key, {_MEAN}, alpha * {ratio} AS l1, alpha * {1 - ratio} AS l2
  FROM centred, (SELECT unnest([{alphas}]) AS alpha)"""
    return start(view, FOLD, OTHERS) + descent(source, 250) + f""",
weighed AS (SELECT key.alpha AS alpha, held, w || [my - list_dot_product(mx, w), -1.0] AS v FROM fitted JOIN centred ON centred.f = key.f)
SELECT {ratio}::DOUBLE AS l1_ratio, alpha, {S.rnd(f'avg({_LOSS})')} AS mse FROM weighed GROUP BY alpha"""


def loo_path(view: str) -> str:
    """Leave-one-out errors from the inverse of every penalised matrix."""
    alphas = ", ".join(repr(float(a)) for a in ALPHAS)
    source = f"""SELECT alpha AS key, d, [[sxx[i][j] + if(i = j, alpha, 0.0) FOR j IN range(1, d + 1)] || [if(i = j, 1.0::DOUBLE, 0.0) FOR j IN range(1, d + 1)]
  FOR i IN range(1, d + 1)] AS m FROM centred, (SELECT unnest([{alphas}]) AS alpha)"""
    return start(view) + gauss_jordan(source) + f""",
inverse AS MATERIALIZED (SELECT key AS alpha, [r[d + 1:] FOR r IN m] AS a, [list_dot_product(r[d + 1:], sxy) FOR r IN m] AS w, mx, n, d FROM solved, centred),
flat AS MATERIALIZED (SELECT x, [x[i] - mx[i] FOR i IN range(1, d + 1)] AS z, n FROM rows_, centred),
error AS (SELECT alpha, (x[len(x)] - list_dot_product(z, w)) / (1 - 1 / flat.n - list_dot_product([list_dot_product(r, z) FOR r IN a], z)) AS e FROM flat, inverse)
SELECT alpha, {S.rnd('avg(e * e)')} AS mse FROM error GROUP BY alpha"""


def forward_path(view: str) -> str:
    """Matching pursuit by pivots: a swept matrix holds the refitted weights and the other features' products with the residual."""
    return start(view, FOLD, OTHERS) + """,
path(f, k, d, m, act, diag, syy) AS (SELECT f, 0, d, [sxx[i] || [sxy[i]] FOR i IN range(1, d + 1)], [0 FOR v IN sxy], [sxx[i][i] FOR i IN range(1, d + 1)], syy
  FROM centred UNION ALL
  SELECT f, k + 1, d, [if(i = j, p, [m[i][c] - m[i][j] * p[c] FOR c IN range(1, d + 2)]) FOR i IN range(1, d + 1)], act[:j - 1] || [1] || act[j + 1:], diag, syy
  FROM (SELECT *, [v / m[j][j] FOR v IN m[j]] AS p FROM (SELECT *, list_position(corr, list_max(corr)) AS j FROM (
    SELECT *, [if(act[i] = 1 OR diag[i] <= 1e-12 * list_max(diag), -1.0, abs(m[i][d + 1])) FOR i IN range(1, d + 1)] AS corr FROM path)
    WHERE list_max(corr) > 1e-12 * syy))),
weighed AS (SELECT k, held, path.f, w || [my - list_dot_product(mx, w), -1.0] AS v
  FROM (SELECT *, [if(act[i] = 1, m[i][d + 1], 0.0) FOR i IN range(1, d + 1)] AS w FROM path WHERE k > 0) path JOIN centred USING (f))
""" + f"SELECT CAST(k AS BIGINT) AS n_features, {S.rnd(f'avg({_LOSS})')} AS mse FROM weighed GROUP BY k HAVING count(*) = 5"


def logistic(view: str, positive: str, c: float, steps: int = 9) -> str:
    """Newton steps from zero, each of them one pass over the rows; all weights but the intercept are penalised."""
    sql = S.with_views(view, more=design(view, target=f"CAST(y = '{positive}' AS DOUBLE)")).replace("WITH ", "WITH RECURSIVE ", 1)
    sql += """,
w0 AS (SELECT [0.0::DOUBLE FOR v IN names] || [0.0] AS w, len(names) + 1 AS d FROM names)"""
    for k in range(1, steps + 1):
        was = f"w{k - 1}"
        sql += f""",
p{k} AS MATERIALIZED (SELECT x, 1 / (1 + exp(-list_dot_product(x[:d], w))) AS p FROM rows_, {was}),
c{k} AS (SELECT i, j, sum(p * (1 - p) * x[i] * x[j]) AS h, sum(if(j = 1, (p - x[len(x)]) * x[i], 0.0)) AS g
  FROM p{k}, (SELECT unnest(range(1, 60)) AS i) a, (SELECT unnest(range(1, 60)) AS j) b WHERE i < len(x) AND j < len(x) GROUP BY ALL),
l{k} AS (SELECT i, list(h + if(i = j AND i < d, 1 / {c}::DOUBLE, 0.0) ORDER BY j) || [sum(g) + if(i < any_value(d), any_value(w)[i] / {c}, 0.0)] AS r
  FROM c{k}, {was} GROUP BY i)"""
        sql += gauss_jordan(f"SELECT 0 AS key, len(list(r)) AS d, list(r ORDER BY i) AS m FROM l{k}", f"s{k}")
        sql += f""",
w{k} AS MATERIALIZED (SELECT [w[i] - m[i][d + 1] FOR i IN range(1, d + 1)] AS w, d FROM s{k}, {was})"""
    return sql + f"""
SELECT unnest(names || ['intercept']) AS feature, unnest([{S.rnd('v', 5)} FOR v IN w]) AS value FROM w{steps}, names"""
