"""Arrow batches through Python in bounded slices, and what the operators share about keys and stages."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from mailveil.session import cut_lineage, ship_package

#: Text bytes that one call of a batch function sees, unless a single row is longer.
SLICE_BYTES = 4 << 20

Batch = Callable[..., dict[str, Any]]


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch of at most so many text bytes; a longer row comes alone."""
    weights = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
            weights += np.diff(np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1]).astype(np.int64)
    ends = np.cumsum(weights)
    first = 0
    while first < batch.num_rows:
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(first, last - first)
        first = last


def give_back() -> None:
    """Return freed memory to the system; a reused Python worker would hold the most that any task before it needed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def per_batch(df: DataFrame, schema: pa.Schema, work: Batch, most: int = SLICE_BYTES) -> DataFrame:
    """Map slices of the input's batches: `work` takes the columns in order and returns the columns of `schema`.

    A column may be a numpy array, a list or an Arrow array. Rows may become more or fewer.
    """
    ship_package(df.sparkSession)
    df = df.toDF(*(f"c{k}" for k in range(len(df.columns))))  # whatever the columns are called

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = piece = made = None
        for batch in batches:
            for piece in slices(batch, most):
                made = work(*piece.columns)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f, x in ((f, made[f.name]) for f in schema)], schema=schema)
        del batch, piece, made
        give_back()

    return df.mapInArrow(run, from_arrow_schema(schema))


def fold(key: str | Column, parts: int) -> Column:
    """The fold of a row: crc32 of its key as text, modulo `parts`. A null key counts as fold -1."""
    return F.coalesce(F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % parts, F.lit(-1)).cast("int")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def stage(df: DataFrame) -> DataFrame:
    """Write a step to the shared folder and go on from there; shuffle files below it may go."""
    staged = cut_lineage(df)
    release(df.sparkSession)
    return staged


def release(spark: SparkSession) -> None:
    """Have Spark's cleaner remove the shuffle files that no live plan refers to, which it finds by garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in staged:
        context = df.sparkSession.sparkContext
        for path in {name.rpartition("/")[0] for name in df.inputFiles()}:
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            if where.getName().startswith("stage-"):
                where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def bitmap(spark: SparkSession, hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """One bit for each hash value, by its lowest `bits` bits: at most 2**bits / 8 bytes come to the driver.

    A set bit means "may be there". However many values there are, the size stays; only more bits are set.
    """
    words = (hashes.select(F.col(column).bitwiseAND(F.lit((1 << bits) - 1)).alias("slot"))
             .selectExpr("cast(shiftright(slot, 6) as int) as word", "shiftleft(1L, cast(slot & 63 as int)) as bit")
             .groupBy("word").agg(F.bit_or("bit").alias("mask")).toPandas())
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64).view(np.uint64)
    return out


def maybe_in(bitmap_words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values have their bit set."""
    slot = values & np.uint64(len(bitmap_words) * 64 - 1)
    return (bitmap_words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, most: int) -> DataFrame:
    """text and label of at most `most` labelled documents that are not held out, staged.

    The documents come in the order of a hash of their id, so the sample does not depend on how rows are stored. Unlabelled
    and null ids are left out; an id labelled twice counts with its larger label.
    """
    chosen = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return stage(texts.join(F.broadcast(chosen), "doc_id").select("text", "label"))  # at most `most` rows are broadcast


def logistic(features: np.ndarray, labels: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression, the intercept last, by Newton's method."""
    x = np.hstack([features, np.ones((len(features), 1))])
    ridge = np.eye(x.shape[1]) * penalty
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (labels - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
