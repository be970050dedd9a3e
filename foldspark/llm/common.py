"""Small helpers of the corpus operators."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame

from foldspark.session import cut, scratch  # noqa: F401  (used by the operators)

#: The white space of words and lines, and the letters that fold.
SPACES = "\t\n\x0b\x0c\r "
WORD_GAP = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def partitions(df: DataFrame, per_task: int = 32 << 20) -> int:
    """Shuffle partitions for a written table: the session's number, more where a task would pass ``per_task`` bytes."""
    held = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(held, -(-size // per_task))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not use yet, in any case of letters."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = f"_{name}"
    return name
