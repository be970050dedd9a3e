"""Keyed integer hashes: the only source of randomness in this package.

A keyed hash of (seed, row id) gives the same answer on every executor, on
every retry and in any partitioning, which ``rand()`` does not. The mixing is
plain 64-bit arithmetic inside generated code, about ten times cheaper than
``md5``. It is laid out as a few projections, because one nested expression
would repeat its argument exponentially.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 1 << 32
MASK = WORD - 1
# Multiplier of the integer mix and the seed stride.
MIX = 73244475
STRIDE = 2654435

# Poisson(1) cumulative probabilities scaled to 32 bits.
POISSON_CUTS = [
    1580030168, 3160060337, 3950075421, 4213413783, 4279248373, 4292415291,
    4294609777, 4294923276, 4294962463, 4294966817, 4294967252,
]


def _fold(x: Column) -> Column:
    return x.bitwiseXOR(F.shiftright(x, 16))


def _turn(x: Column) -> Column:
    return (_fold(x) * F.lit(MIX)).bitwiseAND(F.lit(MASK))


def mix_int(x: int) -> int:
    """The same bijection of [0, 2^32) for a driver-side number."""
    for _ in range(2):
        x = ((x ^ (x >> 16)) * MIX) % WORD
    return x ^ (x >> 16)


def with_u32(df: DataFrame, seeds: Mapping[str, int | Column], row_id: str = "row_id") -> DataFrame:
    """Add one uniform integer in [0, 2^32) per name, keyed by its seed and the row id."""
    keep = df.columns
    # never NULL, so joins and filters on a hash push no null test of the whole expression into the scan
    rid = F.coalesce(F.col(row_id).cast("long"), F.lit(0).cast("long"))
    # the high word enters behind the key: two ids that meet under one seed part under the others
    high = _turn(F.shiftright(rid, 32).bitwiseAND(F.lit(MASK)))
    keyed = {n: s for n, s in seeds.items() if isinstance(s, Column)}
    first = [(s.cast("long") * F.lit(STRIDE) + F.lit(1)).bitwiseAND(F.lit(MASK)) for s in keyed.values()]
    out = df.select(*keep, _turn(rid.bitwiseAND(F.lit(MASK))).alias("_m"), high.alias("_h"), *[
        _turn(_turn(F.coalesce(c, F.lit(0).cast("long")))).alias(f"_k_{n}") for n, c in zip(keyed, first)])

    def key(n: str, s) -> Column:
        return _fold(F.col(f"_k_{n}")) if n in keyed else F.lit(mix_int((s * STRIDE + 1) % WORD))

    out = out.select(*keep, *[
        _turn(F.col("_m").bitwiseXOR(key(n, s))).bitwiseXOR(F.col("_h")).alias(f"_d_{n}") for n, s in seeds.items()])
    return out.select(*keep, *[_fold(_turn(F.col(f"_d_{n}"))).alias(n) for n in seeds])


def with_u01(df: DataFrame, seeds: Mapping[str, int | Column], row_id: str = "row_id") -> DataFrame:
    """Add one uniform number in [0, 1) per name."""
    out = with_u32(df, seeds, row_id)
    return out.withColumns({n: F.col(n).cast("double") / F.lit(float(WORD)) for n in seeds})


def with_u63(df: DataFrame, name: str, seed: Column, row_id: str) -> DataFrame:
    """Add a uniform integer in [0, 2^63), for draws out of any number of rows."""
    seed = seed.cast("long") * 2
    out = with_u32(df, {"_hi": seed, "_lo": seed + 1}, row_id)
    return out.withColumn(name, F.shiftright("_hi", 1) * F.lit(WORD) + F.col("_lo")).drop("_hi", "_lo")


def with_poisson(df: DataFrame, name: str, seed: Column, row_id: str = "row_id") -> DataFrame:
    """Add a Poisson(1) weight by inverting the distribution function of the hash."""
    out = with_u32(df, {"_u": seed}, row_id)
    total = F.lit(0).cast("long")
    for c in POISSON_CUTS:
        total = total + (F.col("_u") >= F.lit(c)).cast("long")
    return out.withColumn(name, total).drop("_u")
