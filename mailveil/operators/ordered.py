"""Ordered computations that stay parallel inside one hot key.

A plain window puts a whole key into one task. Here each key is first cut into
chunks, where the chunk value never decreases along the sort order. A tiny table
holds one summary per (key, chunk); a window over that table carries state across
chunks, and the row-level window runs per (key, chunk). The result equals the plain
window over the key, row for row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SUMMARY = "_chunk_summary"


def _join_carry(df: DataFrame, carry: DataFrame, keys: list[str], chunk: str) -> DataFrame:
    return df.join(carry, [*keys, chunk])


def number_rows(df: DataFrame, keys: list[str], order: list[str], chunk: str, out: str) -> DataFrame:
    """Dense 1..n numbering per key along ``order``, computed chunk by chunk."""
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = (df.groupBy(*keys, chunk).agg(F.count("*").alias("_n"))
             .select(*keys, chunk, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    return (_join_carry(df, carry, keys, chunk)
            .withColumn(out, (F.col("_before") + F.row_number().over(inside)).cast("bigint")).drop("_before"))


def preceding(df: DataFrame, keys: list[str], order: list[str], chunk: str | None,
              sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None,
              last: dict[str, Column] | None = None) -> DataFrame:
    """Values over all rows strictly before the current one, per key.

    ``sums`` start at 0, ``maxima`` and ``last`` (last non-null value) start at null. Without a ``chunk`` each key is one
    plain window: for keys that are known to be small, whose rows then move once and need no summary.
    """
    sums, maxima, last = sums or {}, maxima or {}, last or {}
    if chunk is None:
        before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select(*df.columns, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for n, c in sums.items()],
                         *[F.max(c).over(before).alias(n) for n, c in maxima.items()], *[F.last(c, ignorenulls=True).over(before).alias(n) for n, c in last.items()])
    position = F.struct(*order)
    values = df.withColumns({f"_v_{n}": c for n, c in {**sums, **maxima, **last}.items()})
    summary = values.groupBy(*keys, chunk).agg(
        *[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums],
        *[F.max(f"_v_{n}").alias(f"_s_{n}") for n in maxima],
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), position)).alias(f"_s_{n}") for n in last])
    across = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *keys, chunk,
        *[F.sum(f"_s_{n}").over(across).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_s_{n}").over(across).alias(f"_c_{n}") for n in maxima],
        *[F.last(f"_s_{n}", ignorenulls=True).over(across).alias(f"_c_{n}") for n in last])
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = _join_carry(values, carry, keys, chunk)
    zero = F.lit(0)
    result = joined.select(
        *df.columns,
        *[(F.coalesce(F.sum(f"_v_{n}").over(inside), zero) + F.coalesce(F.col(f"_c_{n}"), zero)).alias(n) for n in sums],
        *[F.greatest(F.max(f"_v_{n}").over(inside), F.col(f"_c_{n}")).alias(n) for n in maxima],
        *[F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(inside), F.col(f"_c_{n}")).alias(n) for n in last])
    return result
