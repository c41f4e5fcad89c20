"""The learned history kept up to date from a stream of observation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from mailveil.sources.history import learn


def observation_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def learn_stream(observations: DataFrame, history_path: str, checkpoint: str):
    """Append clean observations batch by batch.

    ``learn`` leaves out rows the history already holds, so a batch that is run again after a
    failure adds nothing.
    """
    return (observations.writeStream.foreachBatch(lambda batch, _: learn(batch, history_path))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
