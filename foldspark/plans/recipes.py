"""Named evaluation runs and the grid runner.

A recipe turns a dataset with a fold and a split into result tables (scores,
predictions, coefficients, correlations). Requirements name results of other
recipes; the runner resolves them in stages, so one call finishes a chain.
"""

from __future__ import annotations

import re
import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..operators import boosting, constant, curves, metrics, prep, ranks, screen
from ..operators import scores as S
from ..operators import splits as K
from ..operators.linear import LinearCV
from ..session import cut
from ..sources import ledger as L
from ..store import Store

Req = tuple[str, str]
REGISTRY: dict[str, type[Recipe]] = {}
CV = 5


def recipe(cls: type[Recipe]) -> type[Recipe]:
    REGISTRY[cls.__name__] = cls
    return cls


def make(name: str) -> Recipe:
    """Instantiate ``Name`` or ``Name[parameter]``."""
    base, _, rest = name.partition("[")
    if base not in REGISTRY:
        raise KeyError(f"no recipe {base}")
    return REGISTRY[base](rest.removesuffix("]")) if rest else REGISTRY[base]()


@dataclass
class Scoring:
    """How much bootstrap a run stores."""

    n_bootstraps: int = 50
    method: str = "exact"

    def __call__(self, preds: DataFrame, data: Dataset, subsets: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
        return metrics.default_scoring(preds, data.spec.task, subsets, data.spec.n_classes, extra=extra,
                                       n_bootstraps=self.n_bootstraps, method=self.method)


@dataclass
class Recipe:
    param: str = ""
    scoring: Scoring = field(default_factory=Scoring)

    def splits(self) -> dict[str, list[Req]]:
        return {"none": []}

    def run(self, data: Dataset, prev: Mapping[Req, Mapping[str, DataFrame]]) -> dict[str, DataFrame]:
        raise NotImplementedError

    def needed_fields(self) -> list[str]:
        return ["scores", "predictions"]


def with_cv(data: Dataset, name: str = "cv_fold") -> DataFrame:
    """Trainval rows with the folds of an unshuffled cross-validation."""
    rows = data.subset("trainval")
    if data.spec.task == "regression":
        return K.kfold(rows, CV, None, name)
    return K.stratified_kfold(rows, CV, "y", None, name)


def _cross_val(preds: DataFrame) -> DataFrame:
    return preds.withColumn("subset", F.lit("cross_val"))


@recipe
class ConstantPredictor(Recipe):
    def run(self, data, prev):
        data = data.coded()
        value = constant.fit_constant(data.subset("train"), data.spec.task, data.spec.n_classes)
        preds = constant.predict_constant(data.frame.withColumnRenamed("part", "subset"), value)
        folds = constant.cross_val_constant(with_cv(data), data.spec.task, data.spec.n_classes)
        scores = self.scoring(preds, data, ["train", "val", "test"]).unionByName(
            self.scoring(_cross_val(folds), data, ["cross_val"]))
        return {"scores": scores, "predictions": preds.select("row_id", "pred")}


class LinearRecipe(Recipe):
    """Prepare features, choose the penalty, score all parts and the cross-validation."""

    reg_type = "l2"
    y_transform = "standard"
    num_transform = "standard"
    cat_transform = "skip"

    def kinds(self, data: Dataset, train: DataFrame, prev) -> dict[str, str]:
        out = {c: self.num_transform for c in data.num_features if self.num_transform != "skip"}
        if self.cat_transform == "auto" and data.cat_features:
            width = data.spec.n_classes if data.spec.task == "multiclass" else 1
            chosen = prep.choose_encoding(train, data.cat_features, width).collect()
            out.update({r["feature"]: r["encoding"] for r in chosen})
        elif self.cat_transform != "skip":
            out.update({c: self.cat_transform for c in data.cat_features})
        return out

    def _space(self, data: Dataset, rows: DataFrame, is_train, kinds: Mapping[str, str],
               knots: Mapping[str, Sequence[float]] | None = None) -> tuple[DataFrame, prep.FeatureSpace]:
        """Apply transforms fitted on the training rows to all rows."""
        fold = None
        if "target_encoding" in kinds.values():
            fold = "te_fold"
            label = None if data.spec.task == "regression" else "y"
            inside = rows.filter(is_train).select("row_id", *([label] if label else []))
            # several passes fit the encodings
            rows = cut(prep.target_folds(inside, label, to=rows).withColumn("te_fold", F.when(is_train, F.col("te_fold"))))
        n = data.spec.n_classes if data.spec.task == "multiclass" else None
        space = prep.fit_features(rows.filter(is_train), kinds, "y", n, knots=knots)
        keep = [c for c in ("row_id", "y", "part", "cv_fold", "fit_fold") if c in rows.columns]
        return space.apply(rows, keep, fold), space

    def run(self, data, prev):
        # the fits below read the rows many times: write the coded, folded table once
        data = data.coded()
        data = replace(data, frame=cut(data.frame))
        task, n = data.spec.task, data.spec.n_classes
        is_train = F.col("part") == "train"
        train = data.subset("train")
        if task == "regression":
            rows = K.kfold(train.select("row_id"), CV, None, "fit_fold", data.frame)
        else:
            rows = K.stratified_kfold(train.select("row_id", "y"), CV, "y", None, "fit_fold", data.frame)
        rows = rows.withColumn("fit_fold", F.when(is_train, F.col("fit_fold")))
        kinds = self.kinds(data, train, prev)
        ready, space = self._space(data, rows, is_train, kinds)
        model = LinearCV(task, self.reg_type, y_transform=self.y_transform, n_classes=n, n_folds=CV, fold="fit_fold")
        model.fit(ready.filter(is_train), space.features, space.hot, space.hot_width)
        preds = model.predict(ready).select("row_id", F.col("part").alias("subset"), "y", "pred")

        out_of_fold = None
        cv_rows = cut(with_cv(data))
        knots = prep.cross_feature_knots(cv_rows, [c for c, k in kinds.items() if k.startswith("quantile")], CV)
        for f in range(CV):
            outside = F.col("cv_fold") != f
            part, own = self._space(data, cv_rows, outside, kinds, knots.get(f))
            one = LinearCV(task, self.reg_type, reg_coefs=[model.coef], y_transform=self.y_transform, n_classes=n,
                           n_folds=CV, fold="cv_fold", l1_ratio=model.best_l1_ratio or 0.5)
            one.fit_fixed(part.filter(outside), own.features, model.coef, model.best_l1_ratio, own.hot, own.hot_width)
            held = one.predict(part.filter(F.col("cv_fold") == f)).select("row_id", "y", "pred")
            out_of_fold = held if out_of_fold is None else out_of_fold.unionByName(held)
        scores = self.scoring(preds, data, ["train", "val", "test"]).unionByName(
            self.scoring(_cross_val(out_of_fold), data, ["cross_val"]))
        coefs = data.frame.sparkSession.createDataFrame(model.coefficients(), "output int, feature string, value double")
        return {"scores": scores, "predictions": preds.select("row_id", "pred"), "coefs": coefs}


@recipe
class Linear_l2_OHE_standard(LinearRecipe):
    cat_transform = "one_hot_encoding"


@recipe
class Linear_l2_TE_standard(LinearRecipe):
    cat_transform = "target_encoding"


@recipe
class Linear_l1_num_standard(LinearRecipe):
    reg_type = "l1"


@recipe
class Linear_l2_num_standard(LinearRecipe):
    pass


@recipe
class Linear_l2_num_quantileUniform(LinearRecipe):
    num_transform = "quantile_uniform"


@recipe
class Linear_l2_num_quantileNormal(LinearRecipe):
    num_transform = "quantile_normal"


@recipe
class Linear_l2_num_auto(Recipe):
    """The best of three numeric transforms by cross-validated score; the first wins ties."""

    options = ("Linear_l2_num_standard", "Linear_l2_num_quantileUniform", "Linear_l2_num_quantileNormal")

    def splits(self):
        return {"none": [(o, "none") for o in self.options]}

    def run(self, data, prev):
        data = data.coded()
        metric = metrics.SELECTION_METRIC[data.spec.task]
        best = max(self.options, key=lambda o: S.get_value(prev[o, "none"]["scores"], "cross_val", metric))
        preds = data.frame.select("row_id", F.col("part").alias("subset"), "y").join(prev[best, "none"]["predictions"], "row_id")
        chosen = data.frame.sparkSession.createDataFrame([(best,)], "scaling string")
        return {"scores": self.scoring(preds, data, ["val", "test"]), "predictions": preds.select("row_id", "pred"),
                "choices": chosen}


@recipe
class SingleFeature_Num_Correlation(Recipe):
    def run(self, data, prev):
        data = data.coded()
        long = screen.long_features(data.subset("train"), data.num_features)
        classes = list(range(data.spec.n_classes)) if data.spec.n_classes else None
        out = screen.pearson(long, list(range(self.scoring.n_bootstraps)), classes, method=self.scoring.method)
        return {"correlations": out}


class SingleFeatureRecipe(Recipe):
    """Out-of-fold predictions of every numeric feature on its own, scored per feature."""

    transform = "standard"

    def predictions(self, data: Dataset, long: DataFrame) -> DataFrame:
        raise NotImplementedError

    def run(self, data, prev):
        data = data.coded()
        long = screen.long_features(with_cv(data), data.num_features, ("row_id", "y", "cv_fold"))
        preds = _cross_val(self.predictions(data, long))
        return {"feature_scores": self.scoring(preds, data, ["cross_val"], extra=["feature"])}


class SingleFeatureLinear(SingleFeatureRecipe):
    def predictions(self, data, long):
        task = data.spec.task
        if self.transform != "standard" and task == "regression":
            return screen.cross_line_predictions(long, self.transform, CV)
        if self.transform != "standard":
            spread = prep.cross_quantiles(long, self.transform, CV)
            held = (F.col("cv_fold") == F.col("eval_fold")).cast("int")
            long = spread.withColumns({"feature": F.concat_ws("|", "feature", F.col("eval_fold").cast("string")), "cv_fold": held})
        if task == "regression":
            preds = screen.line_predictions(long)
        elif task == "binary":
            preds = screen.logistic_predictions(long, CV if self.transform == "standard" else 2)
        else:
            raise NotImplementedError("one-feature multinomial fits go through multiclass_predictions")
        if self.transform != "standard":
            preds = preds.filter("cv_fold = 1").withColumn("feature", F.substring_index("feature", "|", 1))
        return preds.select("row_id", "feature", "y", "pred")

    def run(self, data, prev):
        if data.spec.task != "multiclass":
            return super().run(data, prev)
        data = data.coded()
        parts = []
        for c in data.num_features:
            one = MulticlassFeature(scoring=self.scoring)
            one.num_transform, one.only = self.transform, c
            parts.append(one.out_of_fold(data).withColumn("feature", F.lit(c)))
        preds = _cross_val(S.concat(*parts))
        return {"feature_scores": self.scoring(preds, data, ["cross_val"], extra=["feature"])}


class MulticlassFeature(LinearRecipe):
    """Unpenalised multinomial fit on one transformed feature."""

    only = ""

    def out_of_fold(self, data: Dataset) -> DataFrame:
        out, rows = None, with_cv(data)
        for f in range(CV):
            outside = F.col("cv_fold") != f
            part, own = self._space(data, rows, outside, {self.only: self.num_transform})
            one = LinearCV("multiclass", n_classes=data.spec.n_classes, fold="cv_fold")
            one.fit_fixed(part.filter(outside), own.features, float("inf"), None)
            held = one.predict(part.filter(F.col("cv_fold") == f)).select("row_id", "y", "pred")
            out = held if out is None else out.unionByName(held)
        return out


@recipe
class SingleFeature_Num_Linear_Standard(SingleFeatureLinear):
    pass


@recipe
class SingleFeature_Num_Linear_QuantileUniform(SingleFeatureLinear):
    transform = "quantile_uniform"


@recipe
class SingleFeature_Num_Linear_QuantileNormal(SingleFeatureLinear):
    transform = "quantile_normal"


@recipe
class SingleFeature_Num_Tree2Leaves(SingleFeatureRecipe):
    leaves = 2

    def predictions(self, data, long):
        if data.spec.task == "regression":
            trees = screen.tree_predictions(long, [F.col("y")], self.leaves)
            return trees.select("row_id", "feature", "y", F.get("value", F.lit(0)).alias("pred"))
        k = data.spec.n_classes
        trees = screen.tree_predictions(long, [(F.col("y") == i).cast("double") for i in range(k)], self.leaves)
        logs = F.transform("value", lambda p: F.coalesce(F.log(p), F.lit(float("-inf"))))
        if k > 2:
            return trees.select("row_id", "feature", "y", logs.alias("pred"))
        return trees.select("row_id", "feature", "y", (F.get(logs, F.lit(1)) - F.get(logs, F.lit(0))).alias("pred"))


@recipe
class SingleFeature_Num_Tree3Leaves(SingleFeature_Num_Tree2Leaves):
    leaves = 3


@recipe
class Linear_l2_num_featureWisePreproc(LinearRecipe):
    """Each numeric feature takes the transform that scored best on its own."""

    options = {"standard": "SingleFeature_Num_Linear_Standard",
               "quantile_uniform": "SingleFeature_Num_Linear_QuantileUniform",
               "quantile_normal": "SingleFeature_Num_Linear_QuantileNormal"}

    def splits(self):
        return {"none": [(p, "none") for p in self.options.values()]}

    def needed_fields(self):
        return ["feature_scores"]

    def kinds(self, data, train, prev):
        metric = metrics.SELECTION_METRIC[data.spec.task]
        tables = [S.get(prev[p, "none"]["feature_scores"], "cross_val", metric).select(
            "feature", "score", F.lit(k).alias("kind"), F.lit(i).alias("option_order"))
            for i, (k, p) in enumerate(self.options.items())]
        best = {r["feature"]: r["kind"] for r in S.best_of(S.concat(*tables), ["feature"]).collect()}
        return {c: best[c] for c in data.num_features if c in best}


class BoostingRecipe(Recipe):
    # early stopping ends a fit long before the limit
    max_rounds, patience, recut, depth, learning_rate = 100_000, 500, 50, 6, 0.1

    def splits(self):
        return {f"cv5_seed0_fold{i}": [] for i in range(5)}

    def start_of(self, data: Dataset, prev) -> DataFrame | None:
        """Start predictions (row_id, pred), if any."""
        return None

    def run(self, data, prev):
        return self.run_many([(data, prev)])[0]

    def run_many(self, tasks: Sequence[tuple[Dataset, Mapping]]) -> list[dict[str, DataFrame]]:
        """Results of several tasks on datasets of one shape (folds, splits): one lock-step fit, one prediction, one scoring."""
        datasets = [d.fill_missing_categorical().coded() for d, _ in tasks]
        starts = [self.start_of(d, prev) for d, (_, prev) in zip(datasets, tasks)]
        features, spec = datasets[0].spec.features, datasets[0].spec
        rows = []
        for i, (d, start) in enumerate(zip(datasets, starts)):
            one = d.frame.select(F.lit(i).alias("fit"), "row_id", "y", F.col("part").alias("role"), *[F.col(f"`{c}`") for c in features])
            rows.append(one if start is None else one.join(start.select("row_id", F.col("pred").alias("init")), "row_id", "left"))
        rows, init = cut(S.concat(*rows)), None if starts[0] is None else "init"
        like = boosting.Boosting(spec.task, spec.n_classes, depth=self.depth, learning_rate=self.learning_rate,
                                 max_rounds=self.max_rounds, early_stopping_rounds=self.patience, use_best=False)
        models = boosting.fit_many(like, rows, len(tasks), features, init)
        session = rows.sparkSession
        curves_of = session.createDataFrame([(i, s, v) for i, m in enumerate(models) for s, v in m.curve], "curve_id int, step int, score double")
        best = {r["curve_id"]: (r["best_iter"], bool(r["stopped"])) for r in curves.best_iteration(curves_of, self.recut).collect()}
        kept = [best[i][0] + 1 for i in range(len(tasks))]
        preds = cut(boosting.predict_many(models, rows, [(0, n) for n in kept], init, "fit").select(
            "fit", "row_id", F.col("role").alias("subset"), "y", "pred"), by="fit")
        scores = cut(self.scoring(preds, datasets[0], ["val", "test"], extra=["fit"]), by="fit")
        out = []
        for i, m in enumerate(models):
            curve = session.createDataFrame([(s, v, *best[i]) for s, v in m.curve], "step int, score double, best_iter int, stopped boolean")
            out.append({"scores": scores.filter(F.col("fit") == i).drop("fit"),
                        "predictions": preds.filter(F.col("fit") == i).select("row_id", "pred"), "curve": curve})
        return out


@recipe
class Boosting_baseline(BoostingRecipe):
    pass


@dataclass(frozen=True)
class Start:
    """Where a boosting run takes its start predictions from."""

    recipe: str
    split: str = "none"
    field: str = "predictions"

    @property
    def stored(self) -> str:
        """A stored model stands for its predictions."""
        return {"model": "predictions"}.get(self.field, self.field)

    def key(self, here: str) -> tuple[str, str]:
        return self.recipe, {"same": here}.get(self.split, self.split)


@recipe
class Boosting_init(BoostingRecipe):
    """Boosting from stored predictions; parameter ``recipe:split:field``, split ``same`` is the current one."""

    FORM = re.compile(r"(?P<recipe>[^:]+)(:(?P<split>[^:]*))?(:(?P<field>[^:]*))?")

    @property
    def start(self) -> Start:
        found = self.FORM.fullmatch(self.param or "Linear_l2_OHE_standard")
        if found is None:
            raise ValueError(f"not of the form recipe:split:field: {self.param!r}")
        return Start(**{k: v for k, v in found.groupdict().items() if v})

    def splits(self):
        own = super().splits()
        return {here: [self.start.key(here)] for here in own}

    def start_of(self, data, prev):
        return prev[self.start.key(data.metadata["split"])][self.start.stored]


# --------------------------------------------------------------------------
# the grid


def run_task(store: Store, key: tuple[str, int, str, str], scoring: Scoring, overrides: Mapping[str, object] | None = None) -> float:
    """Run and store one task; returns the seconds it took."""
    dataset, fold, name, split = key
    one = make(name)
    one.scoring = scoring
    for k, v in (overrides or {}).items():
        if hasattr(one, k):
            setattr(one, k, v)
    data = store.load_dataset(dataset, fold).split(K.Splitter.from_string(split))
    wanted = one.needed_fields()
    prev = {r: store.load_result((dataset, fold, *r), wanted) for r in one.splits()[split]}
    began = time.monotonic()
    fields = one.run(data, prev)
    took = time.monotonic() - began
    store.save_result(key, fields, took)
    return took


def run_together(store: Store, keys: Sequence[tuple[str, int, str, str]], scoring: Scoring,
                 overrides: Mapping[str, object] | None = None) -> float:
    """Run and store tasks of one recipe and dataset that share their jobs; returns the seconds of each."""
    one = make(keys[0][2])
    one.scoring = scoring
    for k, v in (overrides or {}).items():
        if hasattr(one, k):
            setattr(one, k, v)
    needs, wanted = one.splits(), one.needed_fields()

    def load(key):
        dataset, fold, _, split = key
        data = store.load_dataset(dataset, fold).split(K.Splitter.from_string(split))
        return data, {r: store.load_result((dataset, fold, *r), wanted) for r in needs[split]}

    with ThreadPoolExecutor(max_workers=8) as pool:        # small jobs of the splits' boundaries and the ledger
        tasks = list(pool.map(load, keys))
    began = time.monotonic()
    fields = one.run_many(tasks)
    took = (time.monotonic() - began) / len(keys)
    store.save_results(list(zip(keys, fields)), took)
    return took


def batches(tasks: Sequence[tuple[str, int, str, str]]) -> list[list[tuple[str, int, str, str]]]:
    """Tasks of one recipe and dataset together where the recipe can share jobs, else one by one."""
    out: dict[object, list] = {}
    for key in tasks:
        shared = hasattr(make(key[2]), "run_many")
        out.setdefault((key[0], key[2]) if shared else key, []).append(key)
    return list(out.values())


def run_grid(store: Store, datasets: DataFrame, folds: Sequence[int], names: Sequence[str], splits: Sequence[str] | None = None,
             scoring: Scoring | None = None, order: str = "dataset", try_once: bool = False, parallel: int = 1,
             overrides: Mapping[str, object] | None = None, skip_failed: bool = True) -> DataFrame:
    """Run everything in the grid that is not stored yet, requirements first.

    The grid, the done check and the requirement check are joins on the
    ledger; each stage runs the tasks that became ready. Boosting tasks of one
    recipe and dataset are one lock-step fit; others share the session through
    a few driver threads, and Spark schedules their jobs.
    Returns (dataset, fold, pipeline, split, status, seconds).
    """
    needs: dict[Req, list[Req]] = {}
    for n in names:
        for s, reqs in make(n).splits().items():
            if splits is None or s in splits:
                needs[n, s] = reqs
    work = L.grid(datasets.select(F.col("name").alias("dataset")), folds, list(needs))
    if try_once:
        first = L.ordered(work, order).select("dataset", "fold").limit(1)
        work = work.join(ranks.fit_small(first), ["dataset", "fold"], "left_semi")
    status: dict[tuple, tuple[str, float | None]] = {}
    while True:
        done = store.runs().select(*L.KEY)
        state = L.ready(L.pending(work, done), needs, done)
        tasks = [tuple(r[c] for c in L.KEY) for r in L.ordered(state.filter("is_ready"), order).collect()]
        tasks = [k for k in tasks if k not in status]
        if not tasks:
            break

        def attempt(keys):
            try:
                if len(keys) > 1:
                    return keys, ("done", run_together(store, keys, scoring or Scoring(), overrides))
                return keys, ("done", run_task(store, keys[0], scoring or Scoring(), overrides))
            except Exception as e:
                if not skip_failed:
                    raise
                return keys, (f"failed: {type(e).__name__}: {str(e)[:200]}", None)

        with ThreadPoolExecutor(max_workers=parallel) as pool:
            for keys, result in pool.map(attempt, batches(tasks)):
                status.update(dict.fromkeys(keys, result))
    blocked = L.pending(work, store.runs().select(*L.KEY)).collect()
    for r in blocked:
        status.setdefault(tuple(r[c] for c in L.KEY), ("requirement missing", None))
    rows = [(*k, s, t) for k, (s, t) in sorted(status.items())]
    return store.spark.createDataFrame(rows, "dataset string, fold int, pipeline string, split string, status string, seconds double")
