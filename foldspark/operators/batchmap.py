"""Ordered parallel maps of a user function over pandas batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_in_chunks(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, n_chunks: int,
                  pos: str = "pos") -> DataFrame:
    """Apply ``function`` to ``n_chunks`` contiguous ranges of ``pos``; the output keeps ``pos``.

    Each chunk arrives as Arrow batches of bounded size, so the function must
    not depend on seeing a chunk whole.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield function(b)

    return df.repartitionByRange(n_chunks, F.col(pos)).mapInPandas(run, schema)


def map_in_batches(df: DataFrame, function: Callable[..., pd.DataFrame], schema: str, **kwargs) -> DataFrame:
    """Stream the table through ``function`` batch by batch, without any shuffle.

    Batch size follows ``spark.sql.execution.arrow.maxRecordsPerBatch``; Spark
    pulls the next batch only when the last one has been consumed.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield function(b, **kwargs)

    return df.mapInPandas(run, schema)
