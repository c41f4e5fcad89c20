"""IMAP commands beside their tagged answers, by equality on the tag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailveil.operators import dialogue
from mailveil.operators.ordered import number_rows


def _use_number(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Number the uses of a tag, so that a tag used twice meets its own answers in order."""
    chunked = rows.withColumn("_part", F.floor(F.col("line_no") / dialogue.LINES_PER_PART).cast("bigint"))
    return number_rows(chunked, [*keys, "tag"], ["line_no"], "_part", "use").drop("_part")


def _beside(asked: DataFrame, told: DataFrame, keys: list[str]) -> DataFrame:
    """The n-th use of a tag beside its n-th answer, by two windows that leave every session where its lines are."""
    both = asked.withColumn("_told", F.lit(False)).unionByName(told.withColumn("_told", F.lit(True)), allowMissingColumns=True)
    used = both.withColumn("use", F.row_number().over(Window.partitionBy(*keys, "tag", "_told").orderBy("line_no")))
    pair = Window.partitionBy(*keys, "tag", "use").orderBy("_told")
    met = used.withColumns({c: F.lead(c).over(pair) for c in ("status", "answer")}).where(~F.col("_told"))
    return met.select(*keys, "tag", "line_no", "verb", "arg", "status", "answer")


def commands(client_lines: DataFrame, server_lines: DataFrame, keys: list[str], whole: bool = False) -> DataFrame:
    """Every tagged command with its status and answer; an unanswered one keeps nulls.

    ``whole`` says that every stream was short enough to be read as one row.
    """
    words = F.split("line", " ", 3)
    asked = client_lines.where(F.size(words) >= 2).select(
        *keys, "line_no", F.get(words, F.lit(0)).alias("tag"), F.upper(F.get(words, F.lit(1))).alias("verb"),
        F.get(words, F.lit(2)).alias("arg"))
    told = server_lines.where(~F.col("line").rlike(r"^[*+]")).select(
        *keys, "line_no", F.get(words, F.lit(0)).alias("tag"), F.upper(F.get(words, F.lit(1))).alias("status"), F.col("line").alias("answer"))
    if whole:
        return _beside(asked, told, keys)
    answers = _use_number(told, keys).drop("line_no")
    return _use_number(asked, keys).join(answers, [*keys, "tag", "use"], "left").drop("use")


def capability_lists(server_lines: DataFrame, keys: list[str]) -> DataFrame:
    """Upper-case capability words of each server line that carries a list."""
    listed = F.regexp_extract("line", r"(?i)CAPABILITY ([^\]]*)", 1)
    return server_lines.where(listed != "").select(*keys, "line_no", F.filter(
        F.split(F.upper(listed), r"\s+"), lambda c: c != "").alias("capabilities"))


def login_events(rows: DataFrame, keys: list[str]) -> DataFrame:
    """LOGIN commands as credential events; the password is dropped here."""
    given = F.regexp_extract_all("arg", F.lit(r'("(?:[^"\\]|\\.)*"|\S+)'), F.lit(1))
    bare = F.transform(given, lambda a: F.when(a.startswith('"'), F.substring(a, F.lit(2), F.length(a) - 2)).otherwise(a))
    return rows.where("verb = 'LOGIN'").withColumn("_a", bare).select(
        *keys, "line_no", F.lit("IMAP-LOGIN").alias("mechanism"), F.get("_a", F.lit(0)).alias("username"),
        F.coalesce(F.get("_a", F.lit(1)) != "", F.lit(False)).alias("secret_exposed"), (F.col("status") == "OK").alias("accepted"))
