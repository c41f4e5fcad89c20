"""Segments to conversations to byte streams.

Input: one row per TCP segment (capture_id, frame, ts, src, sport, dst, dport, seq,
flags, payload). Payload bytes travel only where bytes are the answer; every counter
works on lengths.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailveil import dims
from mailveil.operators.ordered import number_rows, preceding
from mailveil.session import cut_lineage

FLOW = ["capture_id", "conv_key", "conv_no"]
STREAM = [*FLOW, "dir"]
MOD32 = 4294967296
CHUNK_BYTES = 65536          # stream bytes per stored chunk row
SCAN_BYTES = 1 << 20         # stream offsets per chunk of an ordered scan
PAIR_BUCKETS = 1 << 20       # hash buckets in which the segments of address pairs are counted
HOT_SEGMENTS = 200_000       # segments of a bucket beyond which its pairs are scanned in chunks

SYN, FIN, RST, ACK = 2, 1, 4, 16


def bit(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) != 0


def bare_syn(flags: Column) -> Column:
    return bit(flags, SYN) & ~bit(flags, ACK)


def flag_text(flags: Column) -> Column:
    """Set flags in fixed order, '-' when none is set."""
    names = [(2, "SYN"), (16, "ACK"), (8, "PSH"), (1, "FIN"), (4, "RST"), (32, "URG")]
    text = F.concat_ws(", ", *[F.when(bit(flags, m), n) for m, n in names])
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("-"))


def side(ip: Column, port: Column) -> Column:
    return F.struct(ip.alias("ip"), port.cast("bigint").alias("port"))


def with_conv_key(segments: DataFrame) -> DataFrame:
    """Canonical conversation key: both (ip, port) sides, smaller first."""
    a, b = side(F.col("src"), F.col("sport")), side(F.col("dst"), F.col("dport"))
    return segments.withColumn("conv_key", F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))


def rel_seq(seq: Column, base: Column) -> Column:
    """Signed distance from base in 32-bit sequence space."""
    d = F.pmod(seq - base, F.lit(MOD32))
    return F.when(d >= MOD32 // 2, d - MOD32).otherwise(d)


def split_conversations(segments: DataFrame) -> DataFrame:
    """Number the conversations of each pair: a bare SYN after a close opens the next.

    ``closed`` counts FIN/RST segments before the row. A bare SYN splits when that count
    has moved on since the previous bare SYN. Only control segments matter for finding
    the splits; every segment then counts the splits up to and including itself.
    """
    keyed = with_conv_key(segments).withColumn("_second", F.floor(F.col("ts")).cast("bigint"))
    keys, order = ["capture_id", "conv_key"], ["ts", "frame"]
    control = keyed.where(bit(F.col("flags"), SYN | FIN | RST)).select(*keys, *order, "_second", "flags")
    closing = F.when(bit(F.col("flags"), FIN | RST), 1).otherwise(0)
    counted = preceding(control, keys, order, "_second", sums={"closed": closing})
    previous = preceding(counted, keys, order, "_second", last={"at_syn": F.when(bare_syn(F.col("flags")), F.col("closed"))})
    opens = previous.where(bare_syn(F.col("flags")) & (F.col("closed") > F.coalesce("at_syn", F.lit(0)))).select(
        "capture_id", "frame", F.lit(1).alias("_open"))
    marked = keyed.join(opens, ["capture_id", "frame"], "left").withColumn("_open", F.coalesce("_open", F.lit(0)))
    out = preceding(marked, keys, order, "_second", sums={"_opened": F.col("_open")})
    return out.withColumn("conv_no", (F.col("_opened") + F.col("_open")).cast("bigint")).drop("_opened", "_open", "_second")


def assign_roles(convs: DataFrame) -> DataFrame:
    """Client and server of every conversation, with the reason.

    Bare-SYN sender, else SYN/ACK sender is the server, else the mail port, else the lower port.
    """
    when = F.struct("ts", "frame")
    sender = F.struct(side(F.col("src"), F.col("sport")).alias("own"), side(F.col("dst"), F.col("dport")).alias("peer"),
                      F.col("seq").alias("seq"))
    is_syn = bare_syn(F.col("flags"))
    is_synack = bit(F.col("flags"), SYN) & bit(F.col("flags"), ACK)
    per = convs.groupBy(*FLOW).agg(
        F.min_by(sender, F.when(is_syn, when)).alias("_syn"), F.min_by(sender, F.when(is_synack, when)).alias("_synack"),
        F.count_if(is_syn).alias("_n_syn"), F.count_if(is_synack).alias("_n_synack"))
    a, b = F.col("conv_key.a"), F.col("conv_key.b")
    mail_a, mail_b = a["port"].isin(*dims.MAIL_PORTS), b["port"].isin(*dims.MAIL_PORTS)
    by_port = (F.when(mail_a & ~mail_b, a).when(mail_b & ~mail_a, b)
               .when(a["port"] < b["port"], a).otherwise(b))
    server = (F.when(F.col("_n_syn") > 0, F.col("_syn.peer")).when(F.col("_n_synack") > 0, F.col("_synack.own")).otherwise(by_port))
    out = per.withColumn("server", server)
    client = F.when(F.col("server") == a, b).otherwise(a)
    reason = (F.when(F.col("_n_syn") > 0, "SYN without ACK").when(F.col("_n_synack") > 0, "sender of SYN/ACK is server")
              .otherwise("no handshake captured; inferred from ports (low confidence)"))
    return out.select(*FLOW, client.alias("client"), "server", reason.alias("role_reason"),
                      ((F.col("_n_syn") > 0) & (F.col("_n_synack") > 0)).alias("handshake_seen"),
                      F.when(F.col("_n_syn") > 0, F.col("_syn.seq")).alias("client_isn"),
                      F.when(F.col("_n_synack") > 0, F.col("_synack.seq")).alias("server_isn"))


def directed(convs: DataFrame, roles: DataFrame) -> DataFrame:
    """Data segments with direction and initial sequence number of their stream."""
    data = convs.where(F.length("payload") > 0)
    joined = data.join(roles, FLOW)
    from_client = side(F.col("src"), F.col("sport")) == F.col("client")
    return (joined.withColumn("dir", F.when(from_client, "C").otherwise("S"))
            .withColumn("isn", F.when(F.col("dir") == "C", F.col("client_isn")).otherwise(F.col("server_isn")))
            .select(*STREAM, "frame", "ts", "seq", "isn", "payload"))


# ---------------------------------------------------------------------------
# Reassembly
# ---------------------------------------------------------------------------
def place(segments: DataFrame, stream: list[str] = STREAM) -> DataFrame:
    """Stream offset of every data segment: after the ISN, else from the earliest sequence number.

    The earliest number is the circular minimum: when the numbers wrap (they span half the
    space or more), it is the smallest one in the upper half.
    """
    half = MOD32 // 2
    wraps = F.max("seq") - F.min("seq") >= half
    lowest = F.when(wraps, F.min(F.when(F.col("seq") >= half, F.col("seq")))).otherwise(F.min("seq"))
    # only streams whose handshake was not captured need this pass
    bases = segments.where("isn IS NULL").groupBy(*stream).agg(lowest.alias("_lowest"))
    base = F.when(F.col("isn").isNotNull(), F.pmod(F.col("isn") + 1, F.lit(MOD32))).otherwise(F.col("_lowest"))
    near = (segments.join(bases, stream, "left").withColumn("off", rel_seq(F.col("seq"), base))
            .withColumn("len", F.length("payload").cast("bigint")).drop("_lowest"))
    # signed distances are the offsets as long as none is far out; streams with one are few, and often there is none
    far = near.groupBy(*stream).agg(F.max(F.abs("off")).alias("_far")).where(F.col("_far") >= MOD32 // 4).select(*stream)
    if far.isEmpty():
        return near.drop("isn")
    return near.join(far, stream, "left_anti").drop("isn").unionByName(_unwrapped(near.join(far, stream, "left_semi"), stream))


def _unwrapped(rows: DataFrame, stream: list[str]) -> DataFrame:
    """Offsets past the 32 bits of sequence numbers: the sum of the signed steps from one segment to the next that arrived.

    A step back or forth is below 2**31 bytes, however far the stream has come, so the sum counts every wrap. Both scans run in
    chunks of arrival time. Without an initial sequence number the lowest offset is 0.
    """
    order = ["ts", "frame"]
    timed = rows.withColumn("_second", F.floor(F.col("ts")).cast("bigint"))
    stepped = preceding(timed, stream, order, "_second", last={"_before": F.col("seq")})
    step = F.when(F.col("_before").isNull(), F.col("off")).otherwise(rel_seq(F.col("seq"), F.col("_before")))
    summed = preceding(stepped.withColumn("_step", step), stream, order, "_second", sums={"_sum": F.col("_step")})
    placed = summed.withColumn("off", (F.col("_sum") + F.col("_step")).cast("bigint"))
    lowest = placed.where("isn IS NULL").groupBy(*stream).agg(F.min("off").alias("_lowest"))
    return (placed.join(lowest, stream, "left").withColumn("off", F.col("off") - F.coalesce("_lowest", F.lit(0)))
            .drop("isn", "_second", "_before", "_step", "_sum", "_lowest"))


def _heads(placed: DataFrame, stream: list[str]) -> DataFrame:
    """The one segment per offset that can add bytes: longest, then first to arrive.

    Copies fold away in a map-side combine, so a segment sent a billion times is one row here.
    """
    rank = F.struct((-F.col("len")).alias("neg"), "ts", "frame")
    return (placed.where("off >= 0").groupBy(*stream, "off")
            .agg(F.max("len").alias("len"), F.min(rank).alias("_head"), F.count("*").alias("copies"))
            .select(*stream, "off", "len", "copies", F.col("_head.ts").alias("ts"), F.col("_head.frame").alias("frame")))


def surviving_spans(placed: DataFrame, stream: list[str] = STREAM) -> DataFrame:
    """What each offset contributes: cursor before it, gap, trimmed overlap, surviving span.

    The cursor is the running maximum of segment ends; it is scanned in chunks of the
    offset range, so one long stream still runs in many tasks.
    """
    heads = _heads(placed, stream).withColumn("_part", F.floor(F.col("off") / SCAN_BYTES).cast("bigint"))
    scanned = preceding(heads, stream, ["off"], "_part", maxima={"reach": F.col("off") + F.col("len")})
    return _contribution(scanned.withColumn("cursor", F.coalesce("reach", F.lit(0))), stream)


def _contribution(heads: DataFrame, stream: list[str], *more: str) -> DataFrame:
    """Gap, trimmed overlap and surviving span of heads that know their cursor."""
    end = F.col("off") + F.col("len")
    covered = end <= F.col("cursor")
    return heads.select(
        *stream, "off", "len", "copies", "ts", "frame", "cursor", covered.alias("covered"),
        F.greatest(F.col("off") - F.col("cursor"), F.lit(0)).alias("gap"),
        F.when(~covered, F.greatest(F.col("cursor") - F.col("off"), F.lit(0))).otherwise(0).alias("trim"),
        F.when(~covered, F.greatest("off", "cursor")).alias("start"),
        F.when(~covered, end - F.greatest("off", "cursor")).alias("kept"), *more)


def spans(contributions: DataFrame, stream: list[str] = STREAM) -> DataFrame:
    """Provenance: (stream offset, length, frame, ts) of every byte range that survived."""
    return contributions.where("NOT covered").select(
        *stream, F.col("start").alias("span_off"), F.col("kept").alias("span_len"), "frame", "ts")


def out_of_order(placed: DataFrame, stream: list[str] = STREAM) -> DataFrame:
    """How often a segment arrived with a lower offset than the one before it."""
    chunked = placed.select(*stream, "ts", "frame", "off", F.floor(F.col("ts")).cast("bigint").alias("_second"))
    seen = preceding(chunked, stream, ["ts", "frame"], "_second", last={"prev": F.col("off")})
    return seen.groupBy(*stream).agg(F.count_if(F.col("off") < F.col("prev")).alias("out_of_order"))


def with_payload(found: DataFrame, placed: DataFrame, stream: list[str] = STREAM) -> DataFrame:
    """Bring the bytes of surviving spans back by frame, unless they are with them."""
    if "payload" in found.columns:
        return found.where("NOT covered")
    return found.where("NOT covered").join(placed.select(*stream, "frame", "payload"), [*stream, "frame"])


def _pieces(df: DataFrame, stream: list[str], start: Column, length: Column, chunk_bytes: int) -> DataFrame:
    """Cut [start, start+length) at chunk borders: one row per chunk touched."""
    first, last = F.floor(start / chunk_bytes), F.floor((start + length - 1) / chunk_bytes)
    cut = df.where(length > 0).withColumns({"_from": start, "_to": start + length}).withColumn(
        "chunk", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    lo = F.greatest(F.col("_from"), F.col("chunk") * chunk_bytes)
    hi = F.least(F.col("_to"), (F.col("chunk") + 1) * chunk_bytes)
    return cut.withColumns({"piece_off": lo, "piece_len": hi - lo})


def assemble(contributions: DataFrame, placed: DataFrame, stream: list[str] = STREAM,
             chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The byte streams as bounded chunk rows: (stream, chunk, off, hex text of the bytes).

    A stream of any length is many rows, so no row and no group outgrows ``chunk_bytes``.
    Gaps are zero bytes, which keeps every offset stable.
    """
    bodies = with_payload(contributions, placed, stream)
    cut = _pieces(bodies, stream, F.col("start"), F.col("kept"), chunk_bytes)
    skip = (F.col("piece_off") - F.col("off")).cast("int")
    data = cut.select(*stream, "chunk", "piece_off",
                      F.substring("payload", skip + 1, F.col("piece_len").cast("int")).alias("part"), F.lit(0).alias("zeros"))
    holes = _pieces(contributions.where("gap > 0"), stream, F.col("cursor"), F.col("gap"), chunk_bytes)
    # bytes travel as they are and a hole as its length; both become hex text in the aggregate
    zeros = holes.select(*stream, "chunk", "piece_off", F.lit(None).cast("binary").alias("part"), F.col("piece_len").cast("int").alias("zeros"))
    ordered = F.array_sort(F.collect_list(F.struct("piece_off", "part", "zeros")))
    shown = F.transform(ordered, lambda p: F.coalesce(F.hex(p["part"]), F.repeat(F.lit("00"), p["zeros"])))
    return (data.unionByName(zeros).groupBy(*stream, "chunk")
            .agg(F.min("piece_off").alias("off"), F.array_join(shown, "").alias("hex_bytes")))


def conflicts(placed: DataFrame, contributions: DataFrame, streams: DataFrame, stream: list[str] = STREAM,
              chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Overlaps whose bytes disagree with what the stream kept, counted per segment.

    The overlapped part of a segment is cut at chunk borders and compared by an equi-join
    on (stream, chunk); the chunk side has one row per key.
    """
    body = placed
    if "overlap" not in placed.columns:
        info = contributions.select(*stream, "off", F.col("frame").alias("head_frame"), "cursor", "covered", "trim")
        body = placed.where("off >= 0").join(info, [*stream, "off"])
        head = F.col("frame") == F.col("head_frame")
        body = body.withColumn("overlap", F.when(head & ~F.col("covered"), F.col("trim")).otherwise(F.col("len")))
    cut = _pieces(body, stream, F.col("off"), F.col("overlap"), chunk_bytes)
    own = F.hex(F.substring("payload", (F.col("piece_off") - F.col("off") + 1).cast("int"), F.col("piece_len").cast("int")))
    joined = cut.withColumn("_own", own).join(
        streams.select(*stream, "chunk", F.col("off").alias("chunk_off"), "hex_bytes"), [*stream, "chunk"])
    kept = F.substring("hex_bytes", (2 * (F.col("piece_off") - F.col("chunk_off")) + 1).cast("int"), (2 * F.col("piece_len")).cast("int"))
    return (joined.groupBy(*stream, "frame").agg(F.bool_or(F.col("_own") != kept).alias("conflict"))
            .groupBy(*stream).agg(F.count_if("conflict").alias("overlap_conflicts")))


def stream_stats(placed: DataFrame, contributions: DataFrame, conflicting: DataFrame | None = None,
                 stream: list[str] = STREAM) -> DataFrame:
    """The seven counters of every stream."""
    arrived = placed.groupBy(*stream).agg(F.count("*").alias("segments"))
    built = contributions.groupBy(*stream).agg(
        F.sum(F.col("copies") - 1 + F.col("covered").cast("bigint")).alias("retransmissions"),
        F.count_if(F.col("trim") > 0).alias("overlaps_trimmed"), F.count_if(F.col("gap") > 0).alias("gaps"),
        F.max(F.col("off") + F.col("len")).alias("bytes"))
    out = arrived.join(built, stream, "left").join(out_of_order(placed, stream), stream, "left")
    if conflicting is not None:
        out = out.join(conflicting, stream, "left")
    else:
        out = out.withColumn("overlap_conflicts", F.lit(0))
    names = ["retransmissions", "overlaps_trimmed", "gaps", "bytes", "out_of_order", "overlap_conflicts"]
    return out.select(*stream, "segments", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names])


def build_flows(convs: DataFrame, roles: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per conversation with data: times, frame count, both directions' counters."""
    times = convs.groupBy(*FLOW).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"),
                                     F.count("*").alias("frames"), F.min(F.struct("ts", "frame")).alias("_first"))
    counters = ["segments", "retransmissions", "out_of_order", "overlaps_trimmed", "overlap_conflicts", "gaps", "bytes"]
    both = stats.groupBy(*FLOW).agg(*[
        F.coalesce(F.sum(F.when(F.col("dir") == d, F.col(c))), F.lit(0)).alias(f"{name}_{c}")
        for d, name in (("C", "client"), ("S", "server")) for c in counters])
    return (times.join(roles, FLOW).join(both, FLOW).where("client_bytes + server_bytes > 0")
            .withColumn("first_frame", F.col("_first.frame")).drop("_first"))


# ---------------------------------------------------------------------------
# Conversations, roles and reassembly in one pass
# ---------------------------------------------------------------------------
def trace(segments: DataFrame, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """Every segment with its conversation, roles, direction, stream offset and what it adds to the stream.

    Also copies and cursor where head is set (the one segment per offset that can add bytes), and ``prev_off``, the offset
    that arrived before. Segments are dealt once, by address pair; all steps are windows inside these partitions. Pairs with
    very many segments, found by hash bucket, go through the chunked scans instead; what falls into their bucket goes along.
    """
    keyed = with_conv_key(segments)
    bucket = F.pmod(F.xxhash64("capture_id", "conv_key"), F.lit(PAIR_BUCKETS))
    hot = [r[0] for r in keyed.groupBy(bucket.alias("b")).count().where(F.col("count") > hot_segments).select("b").collect()]
    if not hot:
        return _traced(keyed, segments)
    return _traced(keyed.where(~bucket.isin(hot)), segments).unionByName(_traced_in_chunks(keyed.where(bucket.isin(hot)).select(segments.columns)))


def _traced(keyed: DataFrame, segments: DataFrame) -> DataFrame:
    # a hash in front of the keys settles nearly every comparison of the sorts
    pair, order = ["_hash", "capture_id", "conv_key"], ["ts", "frame"]
    flow, stream = [*pair, "conv_no"], [*pair, "conv_no", "dir"]
    first, last = Window.unboundedPreceding, Window.unboundedFollowing

    def over(keys: list[str], begin: int, end: int) -> Window:
        return Window.partitionBy(*keys).orderBy(*order).rowsBetween(begin, end)

    a, b, forward = F.col("conv_key.a"), F.col("conv_key.b"), F.col("_forward")
    flags, seq = F.col("flags"), F.col("seq")
    is_syn, is_synack = bare_syn(flags), bit(flags, SYN) & bit(flags, ACK)
    # the two ends are in the key already, so only which of them sent travels along
    rows = keyed.withColumn("_forward", side(F.col("src"), F.col("sport")) == a).drop("src", "sport", "dst", "dport")
    rows = rows.repartition("capture_id", "conv_key").withColumn("_hash", F.xxhash64("capture_id", "conv_key"))
    # a bare SYN opens a conversation if a segment closed the pair after, or with, the bare SYN before it
    rows = rows.withColumn("_closed", F.last(F.when(bit(flags, FIN | RST), True).when(is_syn, False), True).over(over(pair, first, -1)))
    opens = is_syn & F.coalesce("_closed", F.lit(False))
    rows = rows.withColumn("conv_no", F.sum(F.when(opens, 1).otherwise(0)).over(over(pair, first, 0)).cast("bigint")).drop("_closed")

    when, sender = F.struct(*order), F.struct(forward.alias("forward"), seq.alias("seq"))
    rows = rows.withColumns({"_syn": F.min_by(sender, F.when(is_syn, when)).over(over(flow, first, last)),
                             "_synack": F.min_by(sender, F.when(is_synack, when)).over(over(flow, first, last)), "first_frame": F.first("frame").over(over(flow, first, last))})
    mail_a, mail_b = a["port"].isin(*dims.MAIL_PORTS), b["port"].isin(*dims.MAIL_PORTS)
    by_port = F.when(mail_a & ~mail_b, a).when(mail_b & ~mail_a, b).when(a["port"] < b["port"], a).otherwise(b)
    syn, synack = F.col("_syn").isNotNull(), F.col("_synack").isNotNull()
    # which end serves and why are two marks until the rows are finished, as addresses would go through every window
    rows = rows.withColumns({
        "_serves": F.when(syn, ~F.col("_syn.forward")).when(synack, F.col("_synack.forward")).otherwise(by_port == a), "_why": F.when(syn, 0).when(synack, 1).otherwise(2),
        "handshake_seen": syn & synack, "client_isn": F.col("_syn.seq"), "server_isn": F.col("_synack.seq"), "len": F.length("payload").cast("bigint")}).drop("_syn", "_synack")
    rows = rows.withColumn("dir", F.when((a == b) | (forward != F.col("_serves")), "C").otherwise("S")).withColumn("_data", F.coalesce(F.col("len") > 0, F.lit(False)))

    own = [*stream, "_data"]
    half, isn = MOD32 // 2, F.when(F.col("dir") == "C", F.col("client_isn")).otherwise(F.col("server_isn"))
    rows = rows.withColumns({"_low": F.min("seq").over(over(own, first, last)), "_top": F.max("seq").over(over(own, first, last)),
                             "_upper": F.min(F.when(seq >= half, seq)).over(over(own, first, last)), "_before": F.lag("seq").over(Window.partitionBy(*own).orderBy(*order))})
    lowest = F.when(F.col("_top") - F.col("_low") >= half, F.col("_upper")).otherwise(F.col("_low"))
    rows = rows.withColumn("_base", F.when(isn.isNotNull(), F.pmod(isn + 1, F.lit(MOD32))).otherwise(lowest)).drop("_low", "_top", "_upper")
    near = rel_seq(seq, F.col("_base"))
    step = F.when(F.col("_before").isNull(), near).otherwise(rel_seq(seq, F.col("_before")))
    rows = rows.withColumns({"_far": F.max(F.abs(near)).over(over(own, first, last)) >= MOD32 // 4, "_sum": F.sum(step).over(over(own, first, 0)).cast("bigint")})
    rows = rows.withColumn("_start", F.when(isn.isNull(), F.min("_sum").over(over(own, first, last))).otherwise(0))
    rows = rows.withColumns({
        "off": F.when(F.col("_data"), F.when(F.col("_far"), F.col("_sum") - F.col("_start")).otherwise(near)).cast("bigint"),
        "prev_off": F.when(F.col("_data") & F.col("_before").isNotNull(), F.when(F.col("_far"), F.col("_sum") - step - F.col("_start")).otherwise(rel_seq(F.col("_before"), F.col("_base")))).cast("bigint")})
    rows = rows.drop("_base", "_before", "_far", "_sum", "_start", "_data").withColumns({"_in": F.coalesce(F.col("off") >= 0, F.lit(False)), "_neg": -F.col("len")})

    at = Window.partitionBy(*stream, "_in", "off").orderBy("_neg", *order)
    rows = rows.withColumns({"_rank": F.row_number().over(at), "copies": F.count("*").over(at.rowsBetween(first, last))})
    reach = F.max(F.col("off") + F.col("len")).over(Window.partitionBy(*stream, "_in").orderBy("off", "_neg", *order).rowsBetween(first, -1))
    rows = rows.withColumn("cursor", F.coalesce(reach, F.lit(0))).withColumn("head", F.col("_in") & (F.col("_rank") == 1))
    why = F.col("_why")
    rows = rows.withColumns({"server": F.when(F.col("_serves"), a).otherwise(b), "client": F.when(F.col("_serves"), b).otherwise(a),
                             "role_reason": F.when(why == 0, "SYN without ACK").when(why == 1, "sender of SYN/ACK is server").otherwise("no handshake captured; inferred from ports (low confidence)")})
    ends = [F.when(forward, x[f]).otherwise(y[f]).cast(dict(segments.dtypes)[name]).alias(name) for name, x, y, f in (("src", a, b, "ip"), ("sport", a, b, "port"), ("dst", b, a, "ip"), ("dport", b, a, "port"))]
    return rows.select(*TRACE[:-len(ADDED)], *ends, *[F.when(F.col("head"), F.col(c)).alias(c) if c in ("copies", "cursor") else F.col(c) for c in ADDED])


#: What a traced segment adds to its row, and all its columns but the four of its ends.
ADDED = ["dir", "client", "server", "role_reason", "handshake_seen", "client_isn", "server_isn", "first_frame", "len", "off", "prev_off", "head", "copies", "cursor"]
TRACE = [*FLOW, "frame", "ts", "seq", "flags", "payload", *ADDED]


def _traced_in_chunks(segments: DataFrame) -> DataFrame:
    """The same rows by the chunked scans, which spread one pair over many tasks."""
    convs = cut_lineage(split_conversations(segments))
    roles = cut_lineage(assign_roles(convs))
    begun = convs.groupBy(*FLOW).agg(F.min(F.struct("ts", "frame"))["frame"].alias("first_frame"))
    placed = cut_lineage(place(directed(convs, roles)))
    found = cut_lineage(surviving_spans(placed)).select(*STREAM, "frame", F.lit(True).alias("head"), "copies", "cursor")
    chunked = placed.select(*STREAM, "ts", "frame", "off", F.floor(F.col("ts")).cast("bigint").alias("_second"))
    seen = preceding(chunked, STREAM, ["ts", "frame"], "_second", last={"prev_off": F.col("off")}).drop("ts", "_second")
    from_client = side(F.col("src"), F.col("sport")) == F.col("client")
    rows = convs.join(roles.join(begun, FLOW), FLOW).withColumn("dir", F.when(from_client, "C").otherwise("S")).withColumn("len", F.length("payload").cast("bigint"))
    rows = rows.join(seen, [*STREAM, "frame"], "left").join(found, [*STREAM, "frame"], "left").withColumn("head", F.coalesce("head", F.lit(False)))
    return rows.select(*TRACE[:-len(ADDED)], "src", "sport", "dst", "dport", *ADDED)


def placed_of(traced: DataFrame, stream: list[str] = STREAM) -> DataFrame:
    """Data segments at their offsets, with the bytes of each that overlap what the stream holds."""
    covered = F.col("off") + F.col("len") <= F.col("cursor")
    overlap = F.when(F.col("head") & ~covered, F.greatest(F.col("cursor") - F.col("off"), F.lit(0))).when(F.col("off") >= 0, F.col("len"))
    return traced.where("len > 0").select(*stream, "frame", "ts", "seq", "payload", "len", "off", overlap.alias("overlap"))


def contributions_of(traced: DataFrame, stream: list[str] = STREAM) -> DataFrame:
    """What each offset contributes, as `surviving_spans` says, with the bytes."""
    return _contribution(traced.where("head"), stream, "payload")


#: What all segments of a conversation say alike. As grouping keys they leave only numbers to aggregate, which needs no sort.
ROLES = ("client", "server", "role_reason", "handshake_seen", "client_isn", "server_isn")


def roles_of(traced: DataFrame) -> DataFrame:
    """Client and server of every conversation, as `assign_roles` says."""
    return traced.select(*FLOW, *ROLES).distinct()


def _counters(group: Callable[[Column], Column]) -> dict[str, Column]:
    """The counters that arrival and reassembly give, over the rows that `group` lets through."""
    end, head = F.col("off") + F.col("len"), F.col("head")
    covered = end <= F.col("cursor")
    return {"segments": F.count_if(group(F.col("len") > 0)), "retransmissions": F.sum(F.when(group(head), F.col("copies") - 1 + covered.cast("bigint"))),
            "out_of_order": F.count_if(group(F.col("off") < F.col("prev_off"))), "overlaps_trimmed": F.count_if(group(head & ~covered & (F.col("cursor") > F.col("off")))),
            "gaps": F.count_if(group(head & (F.col("off") > F.col("cursor")))), "bytes": F.max(F.when(group(head), end))}


def stats_of(traced: DataFrame, conflicting: DataFrame) -> DataFrame:
    """The seven counters of every stream, as `stream_stats` says."""
    counted = traced.where("len > 0").groupBy(*STREAM).agg(*[c.alias(n) for n, c in _counters(lambda c: c).items()])
    names = ["retransmissions", "overlaps_trimmed", "gaps", "bytes", "out_of_order", "overlap_conflicts"]
    return counted.join(conflicting, STREAM, "left").select(*STREAM, "segments", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in names])


def flows_of(traced: DataFrame, conflicting: DataFrame, flow: list[str] = FLOW) -> DataFrame:
    """One row per conversation with data, as `build_flows` says, in one aggregate; conflicts meet it by `flow`."""
    sides = {name: F.col("dir") == d for d, name in (("C", "client"), ("S", "server"))}
    counters = {f"{name}_{c}": F.coalesce(expr, F.lit(0)).cast("bigint") for name, mine in sides.items() for c, expr in _counters(lambda x, mine=mine: x & mine).items()}
    per = traced.groupBy(*dict.fromkeys([*flow, *FLOW]), *ROLES, "first_frame").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("frames"), *[c.alias(n) for n, c in counters.items()])
    clash = conflicting.groupBy(*flow).agg(*[F.sum(F.when(mine, F.col("overlap_conflicts"))).alias(f"{name}_overlap_conflicts") for name, mine in sides.items()])
    out = per.where("client_bytes + server_bytes > 0").join(clash, flow, "left")
    return out.withColumns({f"{name}_overlap_conflicts": F.coalesce(f"{name}_overlap_conflicts", F.lit(0)).cast("bigint") for name in sides})


def frames_for_range(spans_df: DataFrame, ranges: DataFrame, keys: list[str], bucket: int = CHUNK_BYTES) -> DataFrame:
    """Frames that carry any byte of [lo, hi): a range join kept inside an equi key.

    Both sides are cut into offset buckets, so rows meet only when they share stream and
    bucket; the exact overlap test follows and duplicates fold in the set.
    """
    lo, hi = F.col("span_off"), F.col("span_off") + F.col("span_len")
    left = spans_df.select(*keys, lo.alias("_a"), hi.alias("_b"), "frame").withColumn(
        "_bucket", F.explode(F.sequence(F.floor(F.col("_a") / bucket), F.floor((F.col("_b") - 1) / bucket))))
    right = ranges.where("hi > lo").withColumn(
        "_bucket", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor((F.col("hi") - 1) / bucket))))
    met = right.join(left, [*keys, "_bucket"]).where((F.col("_a") < F.col("hi")) & (F.col("_b") > F.col("lo")))
    return met.groupBy(*ranges.columns).agg(F.sort_array(F.collect_set("frame")).alias("frames"))


def number_sessions(flows: DataFrame) -> DataFrame:
    """S001… per capture by start time, smallest frame first on ties.

    One chunk is one hour of one capture, so a capture that holds most flows is numbered in parallel.
    """
    chunked = flows.withColumn("_hour", F.floor(F.col("start_ts") / 3600).cast("bigint"))
    return (number_rows(chunked, ["capture_id"], ["start_ts", "first_frame"], "_hour", "session_no")
            .withColumn("session_id", F.format_string("S%03d", F.col("session_no"))).drop("_hour"))


def unclassified(flows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Flows on a mail port that no dialogue claimed, with the reason."""
    on_mail_port = F.col("server.port").isin(*dims.MAIL_PORTS) | F.col("client.port").isin(*dims.MAIL_PORTS)
    rest = flows.where(on_mail_port).join(sessions.select(*FLOW), FLOW, "left_anti")
    has_bytes = (F.col("client_bytes") > 0) | (F.col("server_bytes") > 0)

    def plain(name: str) -> Column:
        return F.concat(F.col(f"{name}.ip"), F.lit(":"), F.col(f"{name}.port"))

    return rest.select("capture_id", plain("client").alias("client"), plain("server").alias("server"), "client_bytes",
                       "server_bytes", "frames", F.when(has_bytes, "no known mail protocol on either side")
                       .otherwise("no payload captured").alias("reason"))


def flow_totals(flows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Flows, mail sessions and other flows of every capture."""
    mail = sessions.groupBy("capture_id").agg(F.count("*").alias("mail_sessions"))
    return (flows.groupBy("capture_id").agg(F.count("*").alias("flows")).join(mail, "capture_id", "left")
            .withColumn("mail_sessions", F.coalesce("mail_sessions", F.lit(0)))
            .withColumn("non_mail_flows", F.col("flows") - F.col("mail_sessions")))
