"""A training corpus from raw documents in five stages.

Each stage reads what its predecessor kept, is written as Parquet and read again.
All stages but the last return the columns of ``documents``; ``n_chars`` follows
the text where a stage rewrites it. Every stage is judged on its own input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontaminate, language, lines, minmax
from quire.llm.common import read
from quire.session import materialise


#: Rows of a batch that tasks hand to Python. Whole texts are long rows: with Spark's
#: default of 10,000 the buffers of two tasks take more of an executor than the stage itself.
BATCH_ROWS = 1_000


def _short_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents in none of the languages, or without text, go."""
    _short_batches(spark)
    return language.accepted(
        docs, model=language.fit(docs), declared=F.col("lang"), host=F.col("source")
    )


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: lines that ten sources or more share go; every document stays."""
    _short_batches(spark)
    return lines.removed(docs).withColumn("n_chars", F.length("text").cast("long"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each group of near copies (five words, 0.8) one document stays."""
    _short_batches(spark)
    return minmax.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold benchmark passages go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the ids of each text, and whether they decode to it."""
    _short_batches(spark)
    coded = bpe.encoded(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return coded.select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("decodes"),
    )


STAGES = [
    ("language", known_language),
    ("lines", without_boilerplate),
    ("near_copies", without_near_copies),
    ("benchmark", without_benchmark),
    ("tokens", as_tokens),
]

#: Language identification and exact BPE are beyond SQL; tests hold every stage
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
