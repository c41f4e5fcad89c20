"""Byte streams to dialogue rows: lines, replies, turns, upgrade points, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailveil.functions import text as tx
from mailveil.operators.ordered import number_rows, preceding

LINES_PER_PART = 4096     # rows per chunk of an ordered scan over lines
SHORT_CHARS = 1 << 16     # a stream up to this size may be one row
TRANSCRIPT_ROWS = 80
TRANSCRIPT_CHARS = 220


def as_text(streams: DataFrame) -> DataFrame:
    """Hex chunk rows to latin-1 text, one character per byte."""
    return streams.withColumn("text", F.decode(F.unhex("hex_bytes"), "ISO-8859-1")).drop("hex_bytes")


def cut_text(df: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Whole texts as bounded chunk rows."""
    last = F.floor((F.length("text") - 1) / size).cast("bigint")
    cut = df.where(F.length("text") > 0).select(*keys, "text", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk"))
    off = F.col("chunk") * size
    return cut.select(*keys, "chunk", off.alias("off"), F.substring(F.col("text"), (off + 1).cast("int"), F.lit(size)).alias("text"))


def _whole_lines(chunks: DataFrame, keys: list[str], dealt: bool) -> DataFrame:
    """Lines of streams that one row may hold and no chunk is missing from: the chunks are dealt once, nothing moves after that.

    The number of parts is named, as texts that compress well would else be gathered into parts too large for memory.
    """
    parts = F.array_sort(F.collect_list(F.struct("chunk", "text")))
    placed = chunks if dealt else chunks.repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    whole = placed.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda c: c["text"]), "").alias("_text"), F.min("off").alias("_begin"))
    cut = whole.select(*keys, "_begin", F.split("_text", "\n").alias("_pieces"))
    rows = cut.select(*keys, "_begin", F.size("_pieces").alias("_n"), F.posexplode("_pieces").alias("_pos", "_raw"))
    inside = Window.partitionBy(*keys).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    complete = F.col("_pos") < F.col("_n") - 1
    return rows.select(
        *keys, F.col("_pos").cast("bigint").alias("line_no"), (F.col("_begin") + F.coalesce(F.sum(F.length("_raw") + 1).over(inside), F.lit(0))).alias("off"),
        F.rtrim("_raw", F.lit("\r")).alias("line"), complete.alias("complete"),
        (F.length("_raw") + complete.cast("int")).cast("bigint").alias("size")).where(F.col("complete") | (F.col("line") != ""))


def stream_lines(chunks: DataFrame, keys: list[str], chunked: bool = True, whole: bool = False, dealt: bool = False) -> DataFrame:
    """Lines of chunked streams: number, byte offset, text, whether a newline ended it, and the bytes it takes with its end.

    Input rows are (keys…, chunk, off, text). A chunk yields its pieces; the newline count
    before each chunk numbers them; pieces of a line that crosses a border meet by number. ``chunked`` says that a stream may
    be too long for one task's scan, ``whole`` that every stream is complete and has up to SHORT_CHARS characters,
    ``dealt`` that such streams lie in one partition each already.
    """
    if whole:
        return _whole_lines(chunks, keys, dealt)
    breaks = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    counted = preceding(chunks.withColumn("_part", F.floor(F.col("chunk") / LINES_PER_PART).cast("bigint")),
                        keys, ["chunk"], "_part" if chunked else None, sums={"_before": breaks})
    pieces = counted.select(*keys, "chunk", "off", "_before", F.posexplode(F.split("text", "\n")).alias("pos", "piece"))
    inside = Window.partitionBy(*keys, "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.select(
        *keys, "chunk", (F.col("_before") + F.col("pos")).alias("line_no"), "piece", "pos",
        (F.col("off") + F.coalesce(F.sum(F.length("piece") + 1).over(inside), F.lit(0))).alias("piece_off"))
    # a piece that is not the first of its chunk begins right after a newline
    ends = F.max(F.struct("chunk", "pos"))
    lines = placed.groupBy(*keys, "line_no").agg(
        F.array_sort(F.collect_list(F.struct("chunk", "piece"))).alias("_parts"), F.min("piece_off").alias("off"),
        ends.alias("_end"))
    text = F.array_join(F.transform("_parts", lambda p: p["piece"]), "")
    last = placed.groupBy(*keys).agg(F.max("line_no").alias("_last"))
    complete = F.col("line_no") < F.col("_last")
    return (lines.join(last, keys).withColumn("_raw", text).select(
        *keys, "line_no", "off", F.regexp_replace("_raw", r"\r+\z", "").alias("line"), complete.alias("complete"),
        (F.length("_raw") + complete.cast("int")).cast("bigint").alias("size"))
        .where(F.col("complete") | (F.col("line") != "")))


def before_tls(lines: DataFrame, tls: DataFrame, keys: list[str]) -> DataFrame:
    """Complete lines that start before their direction switched to TLS."""
    return (lines.where("complete").join(tls.select(*keys, "tls_off"), keys, "left")
            .where(F.col("tls_off").isNull() | (F.col("off") < F.col("tls_off"))).drop("tls_off", "complete"))


def reply_lines(lines: DataFrame, keys: list[str], chunked: bool = True) -> DataFrame:
    """Server lines with the number of the reply they belong to: '250-' continues, '250 ' ends."""
    final = (F.length("line") < 4) | (F.substring("line", 4, 1) != "-")
    parted = lines.withColumn("_part", F.floor(F.col("line_no") / LINES_PER_PART).cast("bigint"))
    return preceding(parted, keys, ["line_no"], "_part" if chunked else None, sums={"reply_no": F.when(final, 1).otherwise(0)}).drop("_part")


def smtp_replies(lines: DataFrame, keys: list[str], chunked: bool = True) -> DataFrame:
    """One row per reply: code and text of its first line, number of lines."""
    first = F.min_by("line", "line_no")
    return (reply_lines(lines, keys, chunked).groupBy(*keys, "reply_no").agg(
        first.alias("_first"), F.count("*").alias("lines"), F.min("off").alias("off"), F.min("line_no").alias("first_line"))
        .select(*keys, F.col("reply_no").cast("bigint").alias("reply_no"),
                F.coalesce(F.substring("_first", 1, 3).try_cast("int"), F.lit(0)).alias("code"),
                F.substring(F.col("_first"), F.lit(5), F.length("_first")).alias("reply"), "lines", "off", "first_line"))


def pair_turns(commands: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """The n-th command beside the n-th reply; an unanswered command keeps nulls."""
    return commands.join(replies, [*keys, "turn"], "left")


def capabilities(tokens: Column) -> Column:
    """First word of every capability line, upper case."""
    return F.transform(tokens, lambda t: F.upper(F.split_part(t, F.lit(" "), F.lit(1))))


def upgrade_offered(caps: Column, protocol: Column) -> Column:
    """Null while no capability list was seen."""
    verb = F.when(protocol == "POP3", "STLS").otherwise("STARTTLS")
    return F.when(caps.isNotNull(), F.array_contains(caps, verb))


def mangled_indicators(caps: Column, protocol: Column) -> Column:
    """One text per capability that looks like an overwritten upgrade verb."""
    label = F.when(protocol == "SMTP", "EHLO").otherwise(protocol)
    pop = protocol == "POP3"
    target = F.when(pop, "STLS").otherwise("STARTTLS")
    hits = F.filter(caps, lambda c: F.when(pop, tx.looks_mangled(c, "STLS")).otherwise(tx.looks_mangled(c, "STARTTLS")))
    return F.transform(hits, lambda c: F.concat(label, F.lit(" capability '"), c, F.lit("' looks like an overwritten "), target))


def refusal_indicator(protocol: Column, requested: Column, code: Column, answer: Column) -> Column:
    """Text when the upgrade was asked for and refused; null otherwise."""
    ok = (F.when(protocol == "SMTP", code == 220).when(protocol == "IMAP", F.upper(F.split_part(answer, F.lit(" "), F.lit(2))) == "OK")
          .otherwise(answer.startswith("+OK")))
    verb = F.when(protocol == "POP3", "STLS").otherwise("STARTTLS")
    shown = F.when(protocol == "SMTP", F.concat(code.cast("string"), F.lit(" "), answer)).otherwise(answer)
    return F.when(requested & answer.isNotNull() & ~ok, F.concat(verb, F.lit(" refused with '"), shown, F.lit("'")))


def tls_offsets(chunks: DataFrame, keys: list[str], start: DataFrame | None = None) -> DataFrame:
    """First byte offset of a TLS handshake record (0x16 0x03) in each stream, from ``start`` on.

    A record header may straddle two chunks, so each chunk is read with the first byte of the next.
    """
    following = chunks.select(*keys, (F.col("chunk") - 1).alias("chunk"), F.substring("text", 1, 1).alias("_next"))
    read = chunks.join(following, [*keys, "chunk"], "left").withColumn("_text", F.concat("text", F.coalesce("_next", F.lit(""))))
    if start is not None:
        read = read.join(start.select(*keys, "start_off"), keys, "left")
    begin = F.coalesce("start_off", F.lit(0)) if start is not None else F.lit(0)
    skip = F.greatest(begin - F.col("off"), F.lit(0)).cast("int")
    at = F.instr(F.substring(F.col("_text"), skip + 1, F.length("_text")), "\u0016\u0003")
    hit = F.when(at > 0, F.col("off") + skip + at - 1)
    return read.groupBy(*keys).agg(F.min(hit).alias("tls_off"))


def injection_indicator(side: str, verb: Column, cleartext: Column) -> Column:
    """Text for cleartext that sits between the accepted upgrade and the first TLS record."""
    lines = F.filter(F.transform(F.split(cleartext, "\n"), lambda x: F.regexp_replace(x, r"\A\s+|\s+\z", "")), lambda x: x != "")
    verbs = F.slice(F.transform(lines, lambda x: F.upper(F.regexp_replace(F.split_part(x, F.lit(" "), F.lit(1)), r"\s+$", ""))), 1, 5)
    shown = F.coalesce(F.nullif(F.array_join(verbs, ", "), F.lit("")), F.lit("binary"))
    size = F.length(cleartext).cast("string")
    if side == "client":
        text = F.concat(F.lit("client sent "), size, F.lit(" bytes of cleartext after "), verb,
                        F.lit(" and before TLS (commands: "), shown, F.lit(")"))
    else:
        text = F.concat(F.lit("server sent "), size, F.lit(" bytes of cleartext after accepting "), verb,
                        F.lit(" and before TLS (answers: "), shown, F.lit(")"))
    return F.when(F.length(cleartext) > 0, text)


def transcript(events: DataFrame, keys: list[str], rows: int = TRANSCRIPT_ROWS) -> DataFrame:
    """The first events of each session, text cut to a fixed width and redacted where it holds a secret."""
    chunked = events.withColumn("_part", F.floor(F.col("ordinal") / LINES_PER_PART).cast("bigint"))
    numbered = number_rows(chunked, keys, ["ordinal"], "_part", "pos").where(F.col("pos") <= rows)
    shown = F.when(F.col("kind").isin("auth", "cmd"), tx.safe_line(F.col("text"))).otherwise(F.col("text"))
    return numbered.select(*keys, "pos", "dir", "kind", F.substring(shown, 1, TRANSCRIPT_CHARS).alias("text"))


def classify() -> Column:
    """Session class; the first match wins."""
    codes = F.coalesce(F.col("codes"), F.array().cast("array<string>"))
    return (F.when(F.size("strip_indicators") > 0, "STARTTLS stripped")
            .when(F.size("injection_indicators") > 0, "Command injection")
            .when(F.array_contains(codes, "cert_change"), "Certificate swapped")
            .when(F.array_contains(codes, "downgrade"), "Downgraded")
            .when(F.coalesce("server_hello_seen", F.lit(False)), F.col("version_name")).otherwise("Cleartext"))


def class_kind(label: Column) -> Column:
    attacks = ("STARTTLS stripped", "Command injection", "Certificate swapped", "Downgraded")
    return F.when(label.isin(*attacks), "bad").when(label == "Cleartext", "clear").otherwise("tls")
