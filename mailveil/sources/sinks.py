"""Report, audit and export sinks. Every sink writes from the executors."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_assets(spark: SparkSession, path: str) -> DataFrame:
    """Asset weights from a JSON object {asset: weight} to rows (asset, weight)."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,double>").alias("m"))
    return text.select(F.explode("m").alias("asset", "weight"))


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    """One JSON table per report part."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def append_audit(rows: DataFrame, folder: str) -> None:
    """One JSON row per analysed capture, kept for good."""
    rows.write.mode("append").json(folder)


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(folder)


def as_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys plus the whole row as JSON text."""
    return df.select(*keys, F.to_json(F.struct(*df.columns)).alias("json"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)
