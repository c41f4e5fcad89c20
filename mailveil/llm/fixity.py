"""Merkle fixity audit of replicated WARC archives.

Every record is hashed with its offset; the leaves of an archive are grouped by ordered offset ranges, ranges by wider ranges,
up to one root for each archive and one for the collection. Two replicas are compared from the root down: a level's nodes are
joined only below branches that differ, so sound archives cost their roots alone. What differs at the leaves is damaged
(`changed`), missing from the replica (`missing`) or not in the original (`extra`).

A node's digest is the SHA-256 of its children's digests in order of their ranges; a range has at most `FANOUT` children, so
no group grows with the data. Null payloads count as empty. Records that repeat an archive and offset are one leaf: the
digest of their sorted digests. Null archives or offsets are a leaf of archive -1 or offset -1. Equal replicas, and two empty
tables, give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailveil.llm import rows

#: Ranges hold 2**SHIFT narrower ones; the narrowest span 2**UNIT bytes, the widest 2**(UNIT + SHIFT * LEVELS).
SHIFT, UNIT, LEVELS = 5, 12, 4
PER_ARCHIVE = 1000


def leaves(records: DataFrame) -> DataFrame:
    """archive, offset, length and digest of every record."""
    payload = F.coalesce("payload", F.lit("").cast("binary"))
    one = records.select(F.coalesce(F.col("archive").cast("long"), F.lit(-1)).alias("archive"), F.coalesce(F.col("offset").cast("long"), F.lit(-1)).alias("offset"),
                         F.length(payload).cast("long").alias("length"), F.sha2(payload, 256).alias("digest"))
    return one.groupBy("archive", "offset").agg(F.max("length").alias("length"), F.count("*").alias("m"), F.min("digest").alias("first"), F.array_sort(F.collect_list("digest")).alias("all")).select(
        "archive", "offset", "length", F.when(F.col("m") == 1, F.col("first")).otherwise(F.sha2(F.array_join("all", ""), 256)).alias("digest"))


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Nodes (archive, range, digest) by level, leaves' narrowest ranges first, the archives' roots and the collection's ranges last."""

    def over(nodes: DataFrame, archive, at) -> DataFrame:
        return (nodes.select(archive.alias("archive"), at.alias("range"), F.struct("archive", F.col("at"), "digest").alias("child"))
                .groupBy("archive", "range").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("child")), lambda c: F.concat_ws(":", c["archive"], c["at"], c["digest"])), ","), 256).alias("digest")))

    levels, nodes = [], leaf.withColumnRenamed("offset", "at")
    for level in range(LEVELS + 1):
        at = F.shiftright("at", UNIT if level == 0 else SHIFT)
        nodes = rows.stage(over(nodes, F.col("archive"), at))
        levels.append(nodes)
        nodes = nodes.withColumnRenamed("range", "at")
    return levels


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """archive, offset, length, length_replica and finding of every record in which two replicas differ.

    Both tables need archive, offset and payload; other columns are left out.
    """
    left, right = rows.stage(leaves(original)), rows.stage(leaves(replica))
    a, b = tree(left), tree(right)
    open_ = None
    for level in range(LEVELS, -1, -1):
        one, two = a[level], b[level].withColumnRenamed("digest", "other")
        if open_ is not None:
            below = open_.withColumnRenamed("range", "above")
            one = one.withColumn("above", F.shiftright("range", SHIFT)).join(below, ["archive", "above"], "left_semi").drop("above")
            two = two.withColumn("above", F.shiftright("range", SHIFT)).join(below, ["archive", "above"], "left_semi").drop("above")
        open_ = rows.stage(one.join(two, ["archive", "range"], "full").where(~F.col("digest").eqNullSafe(F.col("other"))).select("archive", "range"))
    spot = F.shiftright("offset", UNIT).alias("range")
    one = left.withColumn("range", spot).join(open_, ["archive", "range"], "left_semi").drop("range")
    two = right.withColumn("range", spot).join(open_, ["archive", "range"], "left_semi").select("archive", "offset", F.col("length").alias("length_replica"), F.col("digest").alias("other"))
    finding = F.when(F.col("other").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("changed")
    return (one.join(two, ["archive", "offset"], "full").where(~F.col("digest").eqNullSafe(F.col("other")))
            .select("archive", "offset", "length", "length_replica", finding.alias("finding")))


def archived(pages: DataFrame) -> DataFrame:
    """Pages as WARC response records: archive, offset and payload, PER_ARCHIVE page ids to a file in order of page_id."""
    body = F.coalesce("html", F.lit("")).cast("binary")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    records = pages.select("page_id", "url", F.floor(F.col("page_id") / PER_ARCHIVE).cast("long").alias("archive"), F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary")).alias("payload"))
    before = Window.partitionBy("archive").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum(F.octet_length("payload")).over(before), F.lit(0)).cast("long"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """All pages as archives against a replica of them that lost some records and in which others were overwritten.

    The replica is derived from the table: by the MD5 of its page_id a record is lost (first byte 00) or its last byte
    overwritten (first byte 01).
    """
    records = rows.stage(archived(spark.read.parquet(f"{folder}/pages.parquet")))
    mark = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2)
    damaged = F.concat(F.expr("substring(payload, 1, length(payload) - 1)"), F.lit("?").cast("binary"))
    replica = records.where(mark != "00").withColumn("payload", F.when(mark == "01", damaged).otherwise(F.col("payload")))
    return audit(records, replica)


SQL = r"""
WITH r AS (SELECT page_id, page_id // 1000 AS archive, md5(CAST(page_id AS VARCHAR))[1:2] AS mark,
    strlen('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: '
      || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)) + strlen(coalesce(html, '')) + 4 AS length FROM pages),
o AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM r)
SELECT CAST(archive AS BIGINT) AS archive, CAST(spot AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length, CAST(CASE mark WHEN '01' THEN length END AS BIGINT) AS length_replica,
  CASE mark WHEN '00' THEN 'missing' ELSE 'changed' END AS finding
FROM o WHERE mark IN ('00', '01')
"""
