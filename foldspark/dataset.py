"""Datasets, predictions and scores as thin handles on DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import ensemble, metrics, rows, scores
from .operators import splits as K

TASKS = ("regression", "binary", "multiclass")


@dataclass(frozen=True)
class Spec:
    """What a dataset is: its name, task, column roles and class names."""

    name: str
    task: str
    numeric: tuple[str, ...] = ()
    category: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()

    def __post_init__(self):
        if self.task not in TASKS:
            raise ValueError(f"unknown task type {self.task}")

    @property
    def n_classes(self) -> int | None:
        return len(self.classes) or None

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.category]


@dataclass(frozen=True)
class Dataset:
    """Rows (row_id, features, y, fold, part); ``part`` is train, val or test.

    ``trainval`` means train and val together. Class labels stay text in ``y``;
    ``coded`` turns them into class numbers.
    """

    frame: DataFrame
    spec: Spec
    metadata: dict = field(default_factory=dict)

    def set_fold(self, fold: int, reversed_: bool = False) -> Dataset:
        test = F.col("fold") == fold
        test = ~test if reversed_ else test
        meta = {**self.metadata, "fold": fold}
        meta.pop("split", None)
        return replace(self, frame=self.frame.withColumn("part", F.when(test, "test").otherwise("train")), metadata=meta)

    def subset(self, name: str) -> DataFrame:
        if name == "trainval":
            return self.frame.filter(F.col("part") != "test")
        return self.frame.filter(F.col("part") == name)

    def subset_by_ids(self, ids: DataFrame) -> DataFrame:
        return rows.rows_by_ids(self.frame, ids)

    @property
    def num_features(self) -> list[str]:
        return list(self.spec.numeric)

    @property
    def cat_features(self) -> list[str]:
        return list(self.spec.category)

    def xy(self) -> DataFrame:
        return rows.xy(self.frame, self.spec.features)

    def coded(self) -> Dataset:
        if self.spec.task == "regression" or dict(self.frame.dtypes)["y"] == "int":
            return self
        code = F.coalesce(*[F.when(F.col("y") == c, F.lit(i)) for i, c in enumerate(self.spec.classes)])
        return replace(self, frame=self.frame.withColumn("y", code))

    def split(self, splitter: K.Splitter) -> Dataset:
        """Split the trainval rows into train and val; other rows keep their part."""
        if splitter.method == "none":
            return self
        label = None if self.spec.task == "regression" else "y"
        source = self.subset(splitter.from_subset)
        ids = source.select("row_id", *([label] if label else []))
        if splitter.ensure_all_classes and label:          # single rows move, so rows meet by id
            moved = self.frame.join(splitter.assign(ids, label).withColumnRenamed("subset", "_new"), "row_id", "left")
        else:
            moved = splitter.mark(ids, self.frame, label, "_new")
        inside = F.col("part") != "test" if splitter.from_subset == "trainval" else F.col("part") == splitter.from_subset
        names = [self.metadata["split"]] if "split" in self.metadata else []
        return replace(self, frame=moved.withColumn("part", F.when(inside, F.col("_new")).otherwise(F.col("part")))
                       .filter(F.col("part").isNotNull()).drop("_new"),                  # a discarded side leaves
                       metadata={**self.metadata, "split": ";".join([*names, str(splitter)])})

    def fill_missing_categorical(self) -> Dataset:
        return replace(self, frame=rows.fill_missing_category(self.frame, self.spec.category))

    def describe(self) -> DataFrame:
        return rows.describe(self.frame.withColumnRenamed("part", "subset"), self.spec.features, self.spec.task)

    def unseen_test_classes(self) -> DataFrame:
        return rows.unseen_labels(self.frame.withColumn(
            "subset", F.when(F.col("part") == "test", "test").otherwise("trainval")))


@dataclass(frozen=True)
class Predictions:
    """Rows (row_id, subset, y, pred) of one model; ``t`` is the time inference took."""

    frame: DataFrame
    task: str
    n_classes: int | None = None
    t: float | None = None

    def subset(self, name: str) -> Predictions:
        keep = F.col("subset") != "test" if name == "trainval" else F.col("subset") == name
        return replace(self, frame=self.frame.filter(keep), t=None)

    def masked(self, condition) -> Predictions:
        return replace(self, frame=self.frame.filter(condition), t=None)

    def indexed(self, ids: DataFrame) -> Predictions:
        """Rows by an id list; repeats count repeatedly."""
        return replace(self, frame=self.frame.join(ids.select("row_id"), "row_id"), t=None)

    def probabilities(self) -> DataFrame:
        from .functions.scalar import sigmoid, softmax

        if self.task == "regression":
            raise ValueError("probabilities exist for binary and multiclass tasks")
        p = sigmoid("pred") if self.task == "binary" else softmax("pred")
        return self.frame.withColumn("probability", p)

    def score(self, metric: str) -> float | None:
        if metric not in metrics.TASK_METRICS[self.task]:
            raise ValueError(f"{metric} is not a metric of {self.task} tasks")
        rows_ = self.frame.withColumn("_all", F.lit(1))
        got = metrics.metric(rows_, ["_all"], metric, self.n_classes).first()
        return None if got is None else got["score"]

    def score_all(self, names: Sequence[str], subsets: Sequence[str] | None = None,
                  seeds: Sequence[int | None] | None = None, method: str = "exact") -> DataFrame:
        return metrics.score_all(self.frame, names, subsets, seeds, self.n_classes, method=method)

    def default_scoring(self, subsets: Sequence[str] = ("val", "test"), n_bootstraps: int = 50,
                        method: str = "exact") -> DataFrame:
        return metrics.default_scoring(self.frame, self.task, subsets, self.n_classes,
                                       n_bootstraps=n_bootstraps, method=method)

    @staticmethod
    def _members(items: Sequence[Predictions]) -> DataFrame:
        parts = [p.frame.select("row_id", F.lit(i).alias("pos"), "pred", F.lit(p.t).cast("double").alias("t"))
                 for i, p in enumerate(items)]
        return scores.concat(*parts)

    @staticmethod
    def _sum_t(items: Sequence[Predictions]) -> float | None:
        ts = [p.t for p in items]
        return None if None in ts else sum(ts)

    @classmethod
    def average(cls, items: Sequence[Predictions]) -> Predictions:
        first = items[0]
        k = first.n_classes if first.task == "multiclass" else None
        members = cls._members(items)
        mean = ensemble.average(members, k).select("row_id", "pred")
        held = members.groupBy("row_id").agg(F.count("pred").alias("_n"))
        whole = F.when(F.col("_n") == len(items), F.col("pred")).otherwise(
            F.raise_error(F.concat(F.lit("a member has no prediction for row "), F.col("row_id").cast("string"))).cast(
                mean.schema["pred"].dataType))
        mean = mean.join(held, "row_id").select("row_id", whole.alias("pred"))
        return replace(first, frame=first.frame.drop("pred").join(mean, "row_id"), t=cls._sum_t(items))

    @classmethod
    def cumulative_average(cls, items: Sequence[Predictions]) -> list[Predictions]:
        return [cls.average(items[:i + 1]) for i in range(len(items))]
