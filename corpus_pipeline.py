"""Training corpus from raw documents: each stage keeps, drops or remakes all rows of the one before.

Language ID drops documents whose language is rejected. Exact dedup and the n-gram Jaccard join
keep one document of each group of copies and near copies. Mixing draws the sources' blocks to
their target weights. Encoding turns the mix into SentencePiece ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairkit.llm import exact_dedup, language_id, mixing, ngram_join, piece_bpe
from pairkit.session import materialize, tune

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
# Rows that Spark hands to a Python worker at a time. Whole texts are large, and what a worker has
# once taken from the system stays with it over all stages.
BATCH_ROWS = 512


def bounded(stage: Stage) -> Stage:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language_id", bounded(language_id.stage)),
    ("exact_dedup", bounded(exact_dedup.stage)),
    ("ngram_join", bounded(ngram_join.stage)),
    ("mixing", bounded(mixing.stage)),
    ("sentencepiece", bounded(piece_bpe.stage)),
]

# The language models and the multinomial draws have no SQL; the tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
