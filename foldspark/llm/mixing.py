"""Temperature mixing of sources, in DataFrame functions only.

Shares p of the sources' tokens become weights p^a / sum(p^a). The exponent a is bisected:
the largest a whose weights reach the target entropy, raised where needed until no source
is repeated beyond the limit. Quotas of the token budget are then realised as block
permutations: a source's documents fall into hashed blocks, every epoch passes through
all blocks in an order of its own, and the last epoch stops where the quota is full,
inside a block after the last document that begins before it.

Sources are rows, never columns. A source of any size is split into at most ``MAX_BLOCKS``
blocks, so no task holds a source; the exponent comes from one row of per-source sums.
Tokens are estimated from bytes unless a column of real counts is named.
Defined cases: a null text has no tokens, and documents without tokens appear once in every
full epoch; a null source is a source of its own; an empty table gives no rows; repeated
rows are separate documents; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm.common import cut, fresh

TARGET_ENTROPY, MAX_REPEATS, BLOCK_TOKENS, MAX_BLOCKS, STEPS = 0.9, 4.0, 1 << 16, 4096, 60


def estimated_tokens(text: Column) -> Column:
    """A token for every four bytes of UTF-8, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / F.lit(4)).cast("long")


def _bisect(low: Column, high: Column, ok_high) -> Column:
    """The end of [low, high] where ok_high begins to hold, by STEPS halvings."""
    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        good = ok_high(mid)
        return F.struct(F.when(good, s["lo"]).otherwise(mid).alias("lo"), F.when(good, mid).otherwise(s["hi"]).alias("hi"))

    begin = F.struct(low.alias("lo"), high.alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), begin, step)


def _entropy(shares: Column, a: Column) -> Column:
    """Entropy of the weights p^a, as ln Z - a * sum(p^a ln p) / Z."""
    zero = F.struct(F.lit(0.0).alias("z"), F.lit(0.0).alias("s"))
    sums = F.aggregate(shares, zero, lambda acc, p: F.struct(
        (acc["z"] + F.pow(p, a)).alias("z"), (acc["s"] + F.pow(p, a) * F.ln(p)).alias("s")))
    return F.element_at(F.transform(F.array(sums), lambda x: F.ln(x["z"]) - a * x["s"] / x["z"]), 1)


def exponent(sources: DataFrame, target_entropy: float, max_repeats: float) -> dict[str, float]:
    """alpha, and the sums that turn it into weights, from (source, tokens) rows with tokens > 0."""
    one = sources.where(F.col("tokens") > 0).agg(
        F.coalesce(F.sum("tokens"), F.lit(0)).cast("double").alias("total"), F.array_sort(F.collect_list(F.col("tokens").cast("double"))).alias("t"))
    one = one.select("total", F.transform("t", lambda x: x / F.col("total")).alias("p"))
    top, least = F.array_max("p"), F.array_min("p")
    flat = _bisect(F.lit(0.0), F.lit(1.0), lambda a: _entropy(F.col("p"), a) < F.lit(target_entropy) * F.ln(F.size("p")))["lo"]
    enough = _entropy(F.col("p"), F.lit(1.0)) >= F.lit(target_entropy) * F.ln(F.size("p"))
    few = _bisect(F.lit(0.0), F.lit(1.0), lambda a: F.pow(top / least, 1 - a) <= F.lit(max_repeats))["hi"]
    few = F.when(top / least <= F.lit(max_repeats), F.lit(0.0)).otherwise(few)
    done = one.select("total", F.size("p").alias("k"), F.col("p"),
                      F.greatest(F.when(enough, F.lit(1.0)).otherwise(flat), few).alias("alpha")).select(
        "total", "k", "alpha", F.array_max("p").alias("top"),
        F.aggregate("p", F.lit(0.0), lambda acc, p: acc + F.pow(p, F.col("alpha"))).alias("z"))
    row = done.first()
    return {c: row[c] for c in ("total", "k", "alpha", "top", "z")}


def quotas(sources: DataFrame, budget: int | None, target_entropy: float, max_repeats: float) -> DataFrame:
    """Per source its weight, quota, full epochs, what the last epoch takes, and its blocks.

    budget None is the smallest one that uses every document at least once.
    """
    m = exponent(sources, target_entropy, max_repeats)
    if not m["total"]:
        share, weight, quota = F.lit(0.0), F.lit(0.0), F.lit(0).cast("long")
    else:
        share = F.col("tokens") / F.lit(m["total"])
        weight = F.when(share > 0, F.pow(share, F.lit(m["alpha"])) / F.lit(m["z"])).otherwise(0.0)
        needed = m["total"] * m["top"] * m["z"] / m["top"] ** m["alpha"]
        quota = F.round(weight * F.lit(float(needed if budget is None else budget))).cast("long")
        quota = F.greatest(quota, F.col("tokens")) if budget is None else quota
    full = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1)
    return sources.withColumn("weight", weight).withColumn("quota", quota).select(
        "source", "tokens", "weight", "quota", full.cast("int").alias("epochs"),
        F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("tokens") / BLOCK_TOKENS))).cast("int").alias("blocks"),
        F.lit(m["alpha"]).cast("double").alias("alpha"))


def draws(rows: DataFrame, budget: int | None = None, target_entropy: float = TARGET_ENTROPY,
          max_repeats: float = MAX_REPEATS, seed: int = 0, tokens: str = "tokens") -> DataFrame:
    """(row, doc_id, source, tokens, weight, quota, epoch, block, block_rank, turn) for every use of a document.

    rows has (row, doc_id, source, tokens) and is read several times; ``tokens`` names its column
    of counts. Reading order: epoch, block_rank, turn.
    """
    rows = rows.select("row", "doc_id", "source", token_counts(tokens).alias("tokens"))
    sources = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    plan = cut(quotas(sources, budget, target_entropy, max_repeats))
    same = rows["source"].eqNullSafe(plan["source"])
    placed = rows.join(plan.select("source", "blocks"), same).select(
        rows["row"], rows["doc_id"], rows["source"], rows["tokens"],
        F.pmod(F.xxhash64("doc_id", "row", F.lit(seed)), F.col("blocks").cast("long")).cast("int").alias("block"))
    sizes = placed.groupBy("source", "block").agg(F.sum("tokens").alias("held"))
    # every epoch has its own order of blocks; at most MAX_BLOCKS rows for a source and epoch
    order = Window.partitionBy("source", "epoch").orderBy(F.xxhash64("block", "epoch", F.lit(seed)), "block")
    turns = sizes.join(plan.withColumnRenamed("source", "s"), sizes["source"].eqNullSafe(F.col("s"))).select(
        sizes["source"], "block", "held", "weight", "quota", "epochs", "alpha",
        (F.col("quota") - F.col("epochs") * F.col("tokens")).alias("rest"),
        F.explode(F.sequence(F.lit(0), F.col("epochs"))).alias("epoch"))
    ranked = turns.withColumn("block_rank", F.row_number().over(order) - 1).withColumn(
        "begun", F.sum("held").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    ranked = ranked.withColumn("left", F.when(F.col("epoch") < F.col("epochs"), F.col("held")).otherwise(
        F.greatest(F.lit(0).cast("long"), F.least(F.col("held"), F.col("rest") - F.coalesce("begun", F.lit(0))))))
    taken = ranked.where((F.col("epoch") < F.col("epochs")) | (F.col("left") > 0)).select(
        F.col("source").alias("s"), F.col("block").alias("b"), "weight", "quota", "alpha", "epoch", "block_rank", "left",
        ((F.col("left") >= F.col("held")) | (F.col("epoch") < F.col("epochs"))).alias("whole"))
    match = placed["source"].eqNullSafe(F.col("s")) & (placed["block"] == F.col("b"))
    used = placed.join(taken, match).drop("s", "b").withColumn("turn", F.xxhash64("row", "epoch", F.lit(seed + 1)))
    inside = Window.partitionBy("source", "block").orderBy("turn", "row").rowsBetween(Window.unboundedPreceding, -1)
    edge = used.where(~F.col("whole")).withColumn("mx_before", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    edge = edge.where(F.col("mx_before") < F.col("left")).drop("mx_before")
    return used.where(F.col("whole")).unionByName(edge).drop("left", "whole")


def token_counts(tokens: str | None) -> Column:
    """The column of real counts (NULL: none) where it is named, else the estimate from bytes."""
    if tokens is None:
        return estimated_tokens(F.col("text"))
    return F.coalesce(F.col(tokens).cast("long"), F.lit(0).cast("long"))


def token_rows(docs: DataFrame, tokens: str | None = None) -> DataFrame:
    """Narrow rows of docs, written once; ``row`` tells repeated rows apart. ``tokens`` names a column of real counts."""
    return cut(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                           F.col("source").cast("string").alias("source"),
                           token_counts(tokens).alias("tokens")))


def mixed(docs: DataFrame, budget: int | None = None, target_entropy: float = TARGET_ENTROPY,
          max_repeats: float = MAX_REPEATS, seed: int = 0, tokens: str | None = None) -> DataFrame:
    """The rows of docs, each as often as its source's weight asks for; ``tokens`` names a column of real counts."""
    row, times = fresh(docs, "mx_row"), fresh(docs, "mx_times")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    narrow = numbered.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                             F.col("source").cast("string").alias("source"), token_counts(tokens).alias("tokens"))
    uses = draws(narrow, budget, target_entropy, max_repeats, seed).groupBy(F.col("row").alias(row)).agg(
        F.count("*").cast("int").alias(times))
    repeated = numbered.join(uses, row).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return repeated.select(*(F.col(f"`{c}`") for c in docs.columns))
