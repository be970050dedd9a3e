"""Derived views the registered queries run on, in Spark and as oracle text.

The tables hold no missing values and no learnable target, so both are derived
with keyed hashes. All views keep the size of the table they come from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import with_u01, with_u32
from ..operators.ranks import spread
from . import sqltext as S
from .registry import Tables

NUM = ["c_acctbal", "n_year", "n_mod"]
CAT = ["o_orderpriority", "o_orderstatus", "c_mktsegment"]
CLASSES = ["a", "b", "c"]


def v_base(t: Tables) -> DataFrame:
    """Orders with their customer: three numeric and three category features."""
    # test files hold one partition each; larger inputs pass through spread untouched
    o, c = spread(t.orders, "o_orderkey"), t.customer
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("row_id"), "c_acctbal",
        F.year("o_orderdate").cast("double").alias("n_year"),
        (F.col("o_custkey") % 97).cast("double").alias("n_mod"),
        *CAT, "o_totalprice", (F.col("o_orderkey") % 10).cast("int").alias("fold"))


S.view("v_base", [], """
SELECT o_orderkey AS row_id, c_acctbal, CAST(year(o_orderdate) AS DOUBLE) AS n_year,
  CAST(o_custkey % 97 AS DOUBLE) AS n_mod, o_orderpriority, o_orderstatus, c_mktsegment, o_totalprice,
  CAST(o_orderkey % 10 AS INTEGER) AS fold
FROM orders JOIN customer ON o_custkey = c_custkey""")


def v_reg(t: Tables) -> DataFrame:
    return v_base(t).withColumn("y", F.col("o_totalprice"))


S.view("v_reg", ["v_base"], "SELECT *, o_totalprice AS y FROM v_base")


def v_reg_signal(t: Tables) -> DataFrame:
    return with_u01(v_base(t), {"u": 7}).withColumn(
        "y", 2 * F.col("c_acctbal") + F.when(F.col("c_mktsegment") == "BUILDING", 500.0).otherwise(0.0)
        + 1000 * (F.col("u") - 0.5)).drop("u")


S.view("v_reg_signal", ["v_base"], f"""
SELECT *, 2 * c_acctbal + CASE WHEN c_mktsegment = 'BUILDING' THEN 500.0::DOUBLE ELSE 0 END
  + 1000 * ({S.u01(7, 'row_id')} - 0.5) AS y FROM v_base""")


def v_bin(t: Tables) -> DataFrame:
    z = F.col("c_acctbal") / 1000 + 4 * (F.col("u") - 0.5)
    return with_u01(v_base(t), {"u": 8}).withColumn("y", F.when(z > 4.5, "O").otherwise("F")).drop("u")


S.view("v_bin", ["v_base"], f"""
SELECT *, CASE WHEN c_acctbal / 1000 + 4 * ({S.u01(8, 'row_id')} - 0.5) > 4.5 THEN 'O' ELSE 'F' END AS y
FROM v_base""")


def v_mc_signal(t: Tables) -> DataFrame:
    z = F.col("c_acctbal") / 1000 + 3 * (F.col("u") - 0.5)
    return with_u01(v_base(t), {"u": 9}).withColumn(
        "y", F.when(z < 3, "a").when(z < 6, "b").otherwise("c")).drop("u")


S.view("v_mc_signal", ["v_base"], f"""
SELECT *, CASE WHEN z < 3 THEN 'a' WHEN z < 6 THEN 'b' ELSE 'c' END AS y FROM
  (SELECT *, c_acctbal / 1000 + 3 * ({S.u01(9, 'row_id')} - 0.5) AS z FROM v_base)""")


def v_nulls(t: Tables) -> DataFrame:
    return with_u32(v_reg_signal(t), {"u1": 1, "u2": 2}).withColumns({
        "c_acctbal": F.when(F.col("u1") % 10 != 0, F.col("c_acctbal")),
        "c_mktsegment": F.when(F.col("u2") % 10 != 0, F.col("c_mktsegment")),
    }).drop("u1", "u2")


S.view("v_nulls", ["v_reg_signal"], f"""
SELECT * REPLACE (CASE WHEN {S.u32(1, 'row_id')} % 10 <> 0 THEN c_acctbal END AS c_acctbal,
  CASE WHEN {S.u32(2, 'row_id')} % 10 <> 0 THEN c_mktsegment END AS c_mktsegment) FROM v_reg_signal""")


def v_rare(t: Tables) -> DataFrame:
    """Orders with a long-tailed category of about 190 values."""
    return with_u32(v_reg_signal(t), {"u3": 3, "u4": 4, "u5": 5}).withColumn(
        "cat", F.least(F.col("u3") % 200, F.col("u4") % 200, F.col("u5") % 200).cast("string")).drop("u3", "u4", "u5")


S.view("v_rare", ["v_reg_signal"], f"""
SELECT *, CAST(least({S.u32(3, 'row_id')} % 200, {S.u32(4, 'row_id')} % 200, {S.u32(5, 'row_id')} % 200)
  AS VARCHAR) AS cat FROM v_reg_signal""")

_SUBSET_SQL = "CASE WHEN fold = 0 THEN 'test' WHEN fold = 1 THEN 'val' ELSE 'train' END"


def with_subset(df: DataFrame) -> DataFrame:
    fold = F.col("fold")
    return df.withColumn("subset", F.when(fold == 0, "test").when(fold == 1, "val").otherwise("train"))


def _order_rows(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("row_id"), "o_totalprice",
                           (F.col("o_orderkey") % 10).cast("int").alias("fold"))


def p_reg(t: Tables) -> DataFrame:
    """Two noisy predictions of the order price, with truth and subset."""
    y = F.col("o_totalprice")
    return with_u01(with_subset(_order_rows(t)), {"a": 10, "b": 11}).select(
        "row_id", "subset", "fold", y.alias("y"),
        (y + 20000 * (F.col("a") - 0.5)).alias("pred_a"), (y + 20000 * (F.col("b") - 0.5)).alias("pred_b"))


S.view("p_reg", [], f"""
SELECT row_id, {_SUBSET_SQL} AS subset, fold, y, y + 20000 * ({S.u01(10, 'row_id')} - 0.5) AS pred_a,
  y + 20000 * ({S.u01(11, 'row_id')} - 0.5) AS pred_b
FROM (SELECT o_orderkey AS row_id, o_totalprice AS y, CAST(o_orderkey % 10 AS INTEGER) AS fold FROM orders)""")


def p_bin(t: Tables) -> DataFrame:
    """Binary logits with ties; class F is 0 and class O is 1."""
    return with_subset(v_bin(t)).select(
        "row_id", "subset", "fold", (F.col("y") == "O").cast("int").alias("y"),
        F.round(F.col("c_acctbal") / 2000 - 2, 1).alias("logit"))


S.view("p_bin", ["v_bin"], f"""
SELECT row_id, {_SUBSET_SQL} AS subset, fold, CAST(y = 'O' AS INTEGER) AS y,
  round(c_acctbal / 2000 - 2, 1) AS logit FROM v_bin""")


def p_mc(t: Tables) -> DataFrame:
    """Three-class logits; classes a, b, c are 0, 1, 2."""
    return with_u01(with_subset(v_mc_signal(t)), {"u12": 12, "u13": 13, "u14": 14}).select(
        "row_id", "subset", "fold", F.expr("cast(ascii(y) - 97 as int)").alias("y"),
        F.array(*[F.col(f"u{s}") * 2 - 1 for s in (12, 13, 14)]).alias("logits"))


S.view("p_mc", ["v_mc_signal"], f"""
SELECT row_id, {_SUBSET_SQL} AS subset, fold, CAST(ascii(y) - 97 AS INTEGER) AS y,
  [{', '.join(S.u01(s, 'row_id') + ' * 2 - 1' for s in (12, 13, 14))}] AS logits FROM v_mc_signal""")


def v_curve(t: Tables) -> DataFrame:
    """Validation curves of 300 orders each, with inner and trailing gaps."""
    rid = F.col("row_id")
    cid, step = F.floor(rid / 300.0).cast("long"), (rid % 300).cast("int")
    o = with_u32(t.orders.select(F.col("o_orderkey").alias("row_id")), {"u": 15, "g": 19})
    o = o.select(cid.alias("curve_id"), step.alias("step"), "u", "g")
    step = F.col("step")
    bump = (F.col("u") % 1000) / F.lit(2000.0) - (step - 100) * (step - 100) / F.lit(10000.0)
    gap = (step > 250 + F.col("curve_id") % 40) | (F.col("g") % 50 == 0)
    return o.select("curve_id", "step", F.when(~gap | (step == 0), bump).alias("score"))


S.view("v_curve", [], f"""
SELECT curve_id, step, CASE WHEN step = 0 OR NOT (step > 250 + curve_id % 40 OR {S.u32(19, 'rid')} % 50 = 0)
  THEN ({S.u32(15, 'rid')} % 1000) / 2000.0::DOUBLE - (step - 100) * (step - 100) / 10000.0::DOUBLE END AS score
FROM (SELECT o_orderkey AS rid, CAST(floor(o_orderkey / 300.0) AS BIGINT) AS curve_id,
      CAST(o_orderkey % 300 AS INTEGER) AS step FROM orders)""")

# Names used for the five priorities and three statuses in the ledger view.
RUN_NAMES = {"1-URGENT": "ConstantPredictor", "2-HIGH": "Linear_l2_num_standard",
             "3-MEDIUM": "Linear_l2_OHE_standard", "4-NOT SPECIFIED": "Boosting_baseline",
             "5-LOW": "Boosting_init[Linear_l2_OHE_standard:none:model]"}
SPLIT_NAMES = {"O": "none", "F": "holdout0.1_seed0", "P": "cv5_seed0_fold2"}


def _case(col: str, names: dict) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items())
    return f"CASE {col} {whens} ELSE 'other' END"


def v_runs(t: Tables) -> DataFrame:
    """A run ledger: one stored result per (dataset, fold, pipeline, split), the latest order wins."""
    o = t.orders.select(
        F.concat(F.lit("ds"), (F.col("o_custkey") % 1000).cast("string"),
                 F.when(F.col("o_custkey") % 3 == 0, "[rev]").otherwise("")).alias("dataset"),
        (F.col("o_orderkey") % 10).cast("int").alias("fold"),
        F.expr(_case("o_orderpriority", RUN_NAMES)).alias("pipeline"),
        F.expr(_case("o_orderstatus", SPLIT_NAMES)).alias("split"),
        F.struct("o_orderdate", "o_orderkey", "o_totalprice").alias("v"))
    return o.groupBy("dataset", "fold", "pipeline", "split").agg(F.max("v").alias("v")).select(
        "dataset", "fold", "pipeline", "split", F.col("v.o_orderdate").alias("finished_at"),
        F.col("v.o_orderkey").alias("run_id"),
        ((F.col("v.o_totalprice").cast("long") % 2001) / F.lit(1000.0) - 1).alias("score"))


S.view("v_runs", [], f"""
SELECT dataset, fold, pipeline, split, v.d AS finished_at, v.k AS run_id,
  (CAST(trunc(v.p) AS BIGINT) % 2001) / 1000.0::DOUBLE - 1 AS score
FROM (SELECT dataset, fold, pipeline, split, max(v) AS v FROM (
  SELECT 'ds' || CAST(o_custkey % 1000 AS VARCHAR) || CASE WHEN o_custkey % 3 = 0 THEN '[rev]' ELSE '' END AS dataset,
    CAST(o_orderkey % 10 AS INTEGER) AS fold, {_case('o_orderpriority', RUN_NAMES)} AS pipeline,
    {_case('o_orderstatus', SPLIT_NAMES)} AS split,
    {{'d': o_orderdate, 'k': o_orderkey, 'p': o_totalprice}} AS v FROM orders) GROUP BY ALL)""")


def v_scores(t: Tables) -> DataFrame:
    """Score tables of three runs (A, N, R); a NULL seed is the full sample.

    The score is built from whole numbers, so both engines agree to the bit.
    """
    l = t.lineitem
    seed = (F.col("l_partkey") % 21 - 1).cast("int")
    keyed = l.select(
        F.col("l_returnflag").alias("run"),
        F.concat(F.lit("d"), (F.col("l_suppkey") % 4).cast("string")).alias("dataset"),
        (F.col("l_orderkey") % 10).cast("int").alias("fold"),
        F.when(F.col("l_linestatus") == "O", "val").otherwise("test").alias("subset"),
        F.when(F.col("l_linenumber") % 2 == 0, "r2").otherwise("d2_absolute_error").alias("metric"),
        F.when(seed >= 0, seed).alias("bootstrap_seed"),
        F.round(F.col("l_discount") * 100).cast("long").alias("c"))
    keys = ["run", "dataset", "fold", "subset", "metric", "bootstrap_seed"]
    return keyed.groupBy(*keys).agg(
        ((F.sum("c") - 5 * F.count(F.lit(1))) / (100.0 * F.count(F.lit(1)))).alias("score"))


S.view("v_scores", [], """
SELECT run, dataset, fold, subset, metric, bootstrap_seed,
  CAST(sum(c) - 5 * count(*) AS DOUBLE) / (100.0::DOUBLE * count(*)) AS score
FROM (SELECT l_returnflag AS run, 'd' || CAST(l_suppkey % 4 AS VARCHAR) AS dataset,
  CAST(l_orderkey % 10 AS INTEGER) AS fold, CASE WHEN l_linestatus = 'O' THEN 'val' ELSE 'test' END AS subset,
  CASE WHEN l_linenumber % 2 = 0 THEN 'r2' ELSE 'd2_absolute_error' END AS metric,
  CASE WHEN l_partkey % 21 > 0 THEN CAST(l_partkey % 21 - 1 AS INTEGER) END AS bootstrap_seed,
  CAST(round(l_discount * 100) AS BIGINT) AS c FROM lineitem)
GROUP BY ALL""")
