"""Benchmark decontamination by winnowing.

Words are runs of digits, ASCII letters (case does not count) and non-ASCII characters. A window is `SPAN` consecutive
words of an item; an item of fewer words is one window as a whole. Of the k-gram hashes in each window the smallest is its
fingerprint, on both sides alike, so equal windows always meet: a shared span of `SPAN` words cannot be missed. Document
windows whose fingerprint is among the items' (first asked of a bitmap of fixed size, then in the join) are extended to the
whole window, compared by two 64-bit hashes (fingerprint and window). A word inside a found window is hit.

Null and wordless texts have no words and hit nothing; wordless items have no window. Rows that repeat a doc_id are judged
each for itself; repeated items count by their item_id once. Other columns are left out, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailveil.llm import rows, words

SPAN, GRAM, BITS = 10, 5, 24

_HIT = pa.struct([("size", pa.int32()), ("pos", pa.int32()), ("mark", pa.int64()), ("span", pa.int64())])
SCANNED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(_HIT))])
ITEM_WINDOWS = pa.schema([("item_id", pa.int64()), ("size", pa.int32()), ("mark", pa.int64()), ("span", pa.int64())])


def winnow(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, fingerprints and whole-window hashes of all windows of `size` words that stay in one text."""
    inside = words.within(offsets, size)
    if not len(inside):
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    gram = min(GRAM, size)
    grams = words.window_hashes(hashes, gram, seed=100 + size)
    least = grams[: len(inside)].copy()
    for k in range(1, size - gram + 1):
        np.minimum(least, grams[k:k + len(inside)], out=least)
    at = np.flatnonzero(inside)
    return at, least[at], words.window_hashes(hashes, size, seed=200 + size)[at]


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, window size, fingerprint and window hash, one row for each different window of an item."""

    def work(item_id, text):
        hashes, offsets = words.word_hashes(text, words.ALNUM)
        counts, owner = np.diff(offsets), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        found = []
        for size in range(1, SPAN + 1):
            at, mark, span = winnow(hashes, offsets, size)
            mine = counts[owner[at]] >= SPAN if size == SPAN else counts[owner[at]] == size
            found.append((owner[at][mine], np.full(int(mine.sum()), size), mark[mine], span[mine]))
        own, sizes, marks, spans = (np.concatenate(x) for x in zip(*found, strict=True))
        return {"item_id": item_id.take(pa.array(own)), "size": sizes, "mark": marks.view(np.int64), "span": spans.view(np.int64)}

    return rows.per_batch(items.select(F.col("item_id").cast("long"), "text"), ITEM_WINDOWS, work).distinct()


def scan(docs: DataFrame, sizes: list[int], known: np.ndarray) -> DataFrame:
    """row, doc_id, n_words and the windows whose fingerprint may be among the items'."""

    def work(row, doc_id, text):
        hashes, offsets = words.word_hashes(text, words.ALNUM)
        found = []
        for size in sizes:
            at, mark, span = winnow(hashes, offsets, size)
            keep = rows.maybe_in(known, mark)
            found.append((np.full(int(keep.sum()), size, np.int32), at[keep], mark[keep], span[keep]))
        size, at, mark, span = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 2)
        owner = np.searchsorted(offsets, at, "right") - 1
        order = np.argsort(owner, kind="stable")
        pos = (at - offsets[owner])[order].astype(np.int32)
        hits = pa.StructArray.from_arrays([pa.array(size[order].astype(np.int32)), pa.array(pos), pa.array(mark[order].view(np.int64)), pa.array(span[order].view(np.int64))], fields=list(_HIT))
        ends = np.searchsorted(owner[order], np.arange(len(offsets)))
        return {"row": row, "doc_id": doc_id, "n_words": np.diff(offsets), "hits": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), hits)}

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.per_batch(source, SCANNED, work)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of `docs`."""
    spark = docs.sparkSession
    windows = rows.stage(item_windows(items))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # SPAN values at most
    scanned = rows.stage(scan(docs, sizes, rows.bitmap(spark, windows, "mark", BITS)))
    hits = scanned.where(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    key = ["size", "mark", "span"]
    true = hits.join(windows.select(*key).distinct(), key, "left_semi")
    earlier = Window.partitionBy("row").orderBy("pos", "size").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.col("pos") + F.col("size")
    covered = (true.withColumn("before", F.coalesce(F.max(reach).over(earlier), F.lit(0)))
               .groupBy("row").agg(F.sum(F.greatest(F.lit(0), reach - F.greatest("pos", "before"))).cast("long").alias("n_hit")))
    named = (hits.select("row", *key).distinct().join(windows, key).where(F.col("item_id").isNotNull()).select("row", F.col("item_id").cast("string").alias("item")).distinct()
             .groupBy("row").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items")))
    found = covered.join(named, "row", "left")
    return (scanned.select("row", "doc_id", "n_words").join(found, "row", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                    F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every document against every benchmark item."""
    return contamination(rows.documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT DISTINCT doc_id, item_id, k, i FROM dw JOIN bw USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM m)) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
