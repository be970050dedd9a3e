"""A corpus from raw documents to token ids: each stage is one of the corpus operators.

run() applies the stages to the documents table; every stage's result is written to the
shared folder as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.llm import bagminhash, lines, mixing, pieces, quality
from foldspark.llm import queries as _queries  # noqa: F401  (registers the operators' queries)
from foldspark.plans.registry import QUERIES
from foldspark.session import cut


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality.keep_good(docs)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; n_chars follows the text."""
    return lines.drop_repeated_lines(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return bagminhash.one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources again up to their source's quota."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text, and whether they decode to it."""
    out, names = pieces.encoded(docs.select("doc_id", "text", "lang", "source"), keep_text=False)
    return out.select("doc_id", "lang", "source", *(F.col(v).alias(k) for k, v in names.items()))


STAGES = [
    ("quality rules", good_documents),
    ("line dedup", without_repeated_lines),
    ("near-duplicates", one_of_near_copies),
    ("source mixing", mixed_sources),
    ("token ids", token_ids),
]

#: Near-duplicate signatures and shortest paths have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs


QUERIES["pipeline"] = run
