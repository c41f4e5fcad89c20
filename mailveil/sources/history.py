"""The learned history: a parquet table of clean observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["capture_id", "session_id"]


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def endpoint_history(history: DataFrame, endpoint_key: str) -> DataFrame:
    """One endpoint's rows in time order; the filter reaches the scan."""
    return history.where(F.col("endpoint_key") == endpoint_key).orderBy("ts", "session_id")


def feature_history(history: DataFrame, limit: int = 5000) -> DataFrame:
    """Newest non-empty feature rows; the limit is the feature (a bounded reference window)."""
    return history.where(F.size("features") > 0).orderBy(F.desc("ts"), F.desc("session_id")).limit(limit)


def unlearned(observations: DataFrame, history: DataFrame | None) -> DataFrame:
    """Clean rows the history does not hold yet, one per (capture, session)."""
    fresh = observations.where("clean").dropDuplicates(KEYS)
    return fresh if history is None else fresh.join(history.select(*KEYS), KEYS, "left_anti")


def learn(observations: DataFrame, path: str) -> None:
    """Append clean rows, by day, so that later scans can prune.

    Repeating a run adds nothing: rows already stored are left out by key.
    """
    spark = observations.sparkSession
    try:
        stored = spark.read.parquet(path)
    except Exception as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        stored = None
    rows = unlearned(observations, stored)
    day = F.date_from_unix_date((F.col("ts") / 86400).cast("int"))
    rows.withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)
