"""The result ledger: append-only Parquet tables of runs, the latest row of a key wins.

A key is (dataset, fold, pipeline, split). Directories exist per (pipeline,
split) only - their number is bounded by the code that writes, while datasets
and folds stay sorted columns - so a ledger of millions of results does not
become millions of files. Deleting appends a tombstone; ``compact`` rewrites
the live rows into a new directory.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import glob_match
from ..session import scratch  # noqa: F401  (part of the ledger's interface)

KEY = ["dataset", "fold", "pipeline", "split"]


def append(results: DataFrame, path: str) -> None:
    rows = results if "deleted" in results.columns else results.withColumn("deleted", F.lit(False))
    (rows.repartition("pipeline", "split", F.pmod(F.xxhash64("dataset", "fold"), F.lit(32)))
     .sortWithinPartitions("pipeline", "split", "dataset", "fold")
     .write.mode("append").partitionBy("pipeline", "split").parquet(path))


def read_all(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest(rows: DataFrame) -> DataFrame:
    """Live rows: the newest row per key unless it is a tombstone."""
    others = [c for c in rows.columns if c not in KEY]
    newest = rows.groupBy(*KEY).agg(F.max(F.struct("finished_at", *[c for c in others if c != "finished_at"])).alias("_v"))
    return newest.filter(~F.col("_v.deleted")).select(*KEY, *[F.col(f"_v.{c}").alias(c) for c in others if c != "deleted"])


def read(spark: SparkSession, path: str, fields: Sequence[str] | None = None) -> DataFrame:
    """Live rows; with ``fields`` only those columns leave the files."""
    rows = read_all(spark, path)
    if fields is not None:
        rows = rows.select(*KEY, "finished_at", "deleted", *[f for f in fields if f != "finished_at"])
        return latest(rows).select(*KEY, *fields)
    return latest(rows)


def delete(keys: DataFrame, path: str, at: Column) -> None:
    """Append tombstones for the keys."""
    old = read_all(keys.sparkSession, path)
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in old.schema.fields
             if f.name not in (*KEY, "finished_at", "deleted")]
    append(keys.select(*KEY, at.cast("timestamp").alias("finished_at"), F.lit(True).alias("deleted"), *empty), path)


def compact(spark: SparkSession, path: str, into: str) -> None:
    append(read(spark, path), into)


def select_results(results: DataFrame, datasets="*", folds="*", pipelines="*", splits="*") -> DataFrame:
    """Results whose key parts match a glob, an exact name, or a list of either."""
    return results.filter(
        glob_match("dataset", datasets) & glob_match(F.col("fold").cast("string"), folds)
        & glob_match("pipeline", pipelines) & glob_match("split", splits))


def list_results(results: DataFrame, **patterns) -> DataFrame:
    return select_results(results.select(*KEY), **patterns).distinct()


def parse_folds(text: str) -> list[int]:
    """``N`` or ``N1-N2`` (inclusive)."""
    m = re.fullmatch(r"(\d+)(?:-(\d+))?", text)
    if not m:
        raise ValueError(f"bad fold range {text!r}")
    lo = int(m[1])
    hi = int(m[2]) if m[2] else lo
    if hi < lo:
        raise ValueError(f"empty fold range {text!r}")
    return list(range(lo, hi + 1))


def _spread(df: DataFrame, name: str, values: Sequence) -> DataFrame:
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def grid(datasets: DataFrame, folds: Sequence[int], runs: Sequence[tuple[str, str]]) -> DataFrame:
    """Work grid: every dataset with every fold and (pipeline, split).

    The short lists live in the code, so the product is an explode per dataset
    and needs no join at all.
    """
    out = _spread(datasets.select("dataset"), "fold", list(folds))
    pairs = F.array(*[F.struct(F.lit(p).alias("pipeline"), F.lit(s).alias("split")) for p, s in runs])
    return out.withColumn("_r", F.explode(pairs)).select("dataset", "fold", "_r.pipeline", "_r.split")


def param_grid(base: DataFrame, **lists: Sequence) -> DataFrame:
    """Every combination of the parameter lists for every row of the base table."""
    for name, values in lists.items():
        base = _spread(base, name, values)
    return base


def pending(work: DataFrame, results: DataFrame) -> DataFrame:
    """Work without a stored result."""
    return work.join(results.select(*KEY), KEY, "left_anti")


def ready(work: DataFrame, requirements: Mapping[tuple[str, str], Sequence[tuple[str, str]]],
          results: DataFrame) -> DataFrame:
    """Work whose required results all exist; a run without requirements is ready at once."""
    needs = F.lit(None).cast("array<struct<pipeline:string,split:string>>")
    for (p, s), reqs in requirements.items():
        if reqs:
            arr = F.array(*[F.struct(F.lit(a).alias("pipeline"), F.lit(b).alias("split")) for a, b in reqs])
            needs = F.when((F.col("pipeline") == p) & (F.col("split") == s), arr).otherwise(needs)
    asked = work.withColumn("_need", F.explode_outer(needs))
    done = results.select("dataset", "fold", F.struct("pipeline", "split").alias("_need"), F.lit(1).alias("_ok"))
    found = asked.join(done, ["dataset", "fold", "_need"], "left")
    ok = F.min((F.col("_need").isNull() | F.col("_ok").isNotNull()).cast("int")) == 1
    return found.groupBy(*KEY).agg(ok.alias("is_ready"))


def ordered(work: DataFrame, order: str = "dataset") -> DataFrame:
    """Dataset-major or fold-major order of tasks."""
    first = ["dataset", "fold"] if order == "dataset" else ["fold", "dataset"]
    return work.orderBy(*first, "pipeline", "split")


def summary(datasets: DataFrame, results: DataFrame, fields: Mapping[str, tuple[str, str, str]],
            folds: Sequence[int] = tuple(range(10))) -> DataFrame:
    """One row per (dataset, fold), one column per (pipeline, split, field).

    All columns come from a single pivoting aggregate over the ledger, not
    from one join per column. A score of zero stays zero.
    """
    base = _spread(datasets.select("dataset"), "fold", list(folds))
    cells = [F.max(F.when((F.col("pipeline") == p) & (F.col("split") == s), F.col(f))).alias(col)
             for col, (p, s, f) in fields.items()]
    wanted = F.lit(False)
    for p, s, _ in fields.values():
        wanted = wanted | ((F.col("pipeline") == p) & (F.col("split") == s))
    wide = results.filter(wanted).groupBy("dataset", "fold").agg(*cells)
    return base.join(wide, ["dataset", "fold"], "left")


def summary_by_dataset(exploded: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Fold arrays per dataset, in fold order, missing folds as NULL entries."""
    cells = F.array_sort(F.collect_list(F.struct("fold", *fields)))
    per = exploded.groupBy("dataset").agg(cells.alias("_c"))
    return per.select("dataset", *[F.col("_c").getField(f).alias(f) for f in fields])


def natural_order(col: str) -> list[Column]:
    """Sort text by its letters, then by its first number as a number."""
    return [F.regexp_extract(col, r"^(\D*)", 1), F.regexp_extract(col, r"^\D*(\d*)", 1).try_cast("long"), F.col(col)]


def readiness(results: DataFrame, columns: Sequence[tuple[str, str]], now: Column | None = None,
              lo: float = 10.0, hi: float = 84600.0 * 3) -> DataFrame:
    """Grid of (dataset, fold) by (pipeline, split): done flag, or log of the clipped age in seconds."""
    if now is None:
        cell = F.lit(1.0)
    else:
        age = (now.cast("timestamp").cast("long") - F.col("finished_at").cast("timestamp").cast("long")).cast("double")
        cell = F.log(F.least(F.greatest(age, F.lit(lo)), F.lit(hi)))
    tagged = results.select("dataset", "fold", F.concat("pipeline", F.lit(" : "), "split").alias("run"), cell.alias("v"))
    cells = [F.max(F.when(F.col("run") == f"{p} : {s}", F.col("v"))).alias(f"{p} : {s}") for p, s in columns]
    return tagged.groupBy("dataset", "fold").agg(*cells)


def result_age(results: DataFrame, now: Column) -> DataFrame:
    secs = now.cast("timestamp").cast("long") - F.col("finished_at").cast("timestamp").cast("long")
    return results.select(*KEY, secs.alias("age_seconds"))

