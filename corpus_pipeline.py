"""From raw documents to token ids: five stages, each over all rows its predecessor kept.

Every stage takes (spark, docs, folder). All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailveil.llm import bpe, decontaminate, jaccard, rows, secrets, toxicity

#: Stage results depend on a trained model, which SQL does not express.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop the documents that compress like toxic text."""
    return toxicity.keep_ordinary(docs, toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies: word 5-shingles, similarity 0.8 or more."""
    return jaccard.one_of_each(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drop the rows whose text holds a window of a benchmark item; rows are told apart by number, as ids may be null or repeat."""
    number = "row" + "_" * max(len(name) for name in docs.columns)
    numbered = rows.stage(docs.withColumn(number, F.monotonically_increasing_id()))
    judged = decontaminate.contamination(numbered.select(F.col(number).alias("doc_id"), "text"), spark.read.parquet(f"{folder}/benchmark.parquet"))
    leaks = rows.stage(judged.where("contaminated").select(F.col("doc_id").alias(number)))
    return numbered.join(leaks, number, "left_anti").select(docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Replace every secret by a mark."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Encode every text and decode it again: token counts and digests."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), digests=True)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", drop_contaminated),
          ("secrets", mask_secrets), ("bpe", encode)]


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the documents of a folder, each written and read again."""
    docs = rows.documents(spark, folder)
    for _, work in STAGES[:-1]:
        docs = rows.stage(work(spark, docs, folder))
    return encode(spark, docs, folder)


__all__ = ["ORACLE_SQL", "STAGES", "run"]
