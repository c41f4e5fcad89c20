"""Reassembly, ordered scans and byte ranges against hand cases and brute force."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from mailveil.operators import dialogue, flows
from mailveil.operators.ordered import number_rows, preceding

STREAM = ["s"]


def segs(spark, rows, isn=100):
    data = [("a", i + 1, float(i), seq, isn, payload) for i, (seq, payload) in enumerate(rows)]
    return spark.createDataFrame(data, "s string, frame long, ts double, seq long, isn long, payload binary")


def rebuilt(spark, rows, isn=100, chunk=4):
    placed = flows.place(segs(spark, rows, isn), STREAM)
    parts = flows.surviving_spans(placed, STREAM)
    streams = flows.assemble(parts, placed, STREAM, chunk)
    clash = flows.conflicts(placed, parts, streams, STREAM, chunk)
    body = b"".join(bytes.fromhex(r.hex_bytes) for r in streams.orderBy("chunk").collect())
    return body, flows.stream_stats(placed, parts, clash, STREAM).first()


def test_worked_example(spark):
    body, st = rebuilt(spark, [(107, b"world"), (101, b"hello "), (101, b"hello "), (104, b"lo world")])
    assert body == b"hello world"
    assert (st.out_of_order, st.retransmissions, st.overlaps_trimmed, st.overlap_conflicts) == (1, 2, 1, 0)


def test_gap_conflict_and_wrap(spark):
    body, st = rebuilt(spark, [(101, b"abc"), (107, b"xyz")])
    assert body == b"abc\0\0\0xyz" and st.gaps == 1
    body, st = rebuilt(spark, [(101, b"abcdef"), (104, b"XXXghi")])
    assert body == b"abcdefghi" and st.overlap_conflicts == 1 and st.overlaps_trimmed == 1
    body, _ = rebuilt(spark, [(4294967295, b"ab"), (1, b"cd")], isn=4294967294)
    assert body == b"abcd"
    body, _ = rebuilt(spark, [(1, b"cd"), (4294967295, b"ab")], isn=None)
    assert body == b"abcd"


def test_random_streams_match_plain_statement(spark):
    rng = random.Random(5)
    for _ in range(3):
        rows = [(101 + rng.randrange(60), bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 12)))) for _ in range(25)]
        out, trims, gaps, again, bad = bytearray(), 0, 0, 0, 0
        for off, _, _, p in sorted((s - 101, -len(p), i, p) for i, (s, p) in enumerate(rows)):
            end = off + len(p)
            if end <= len(out):
                again += 1
                bad += bytes(out[off:end]) != p
                continue
            if off > len(out):
                gaps += 1
                out += bytes(off - len(out))
            if off < len(out):
                trims += 1
                bad += bytes(out[off:]) != p[:len(out) - off]
            out += p[len(out) - off:]
        body, st = rebuilt(spark, rows)
        assert body == bytes(out)
        assert (st.retransmissions, st.overlaps_trimmed, st.gaps, st.overlap_conflicts) == (again, trims, gaps, bad)


def test_frames_for_range(spark):
    spans = spark.createDataFrame([("a", 0, 10, 4), ("a", 10, 5, 6), ("a", 15, 20, 8)], "s string, span_off long, span_len long, frame long")
    ranges = spark.createDataFrame([("a", 8, 12), ("a", 5, 5)], "s string, lo long, hi long")
    got = {(r.lo, r.hi): r.frames for r in flows.frames_for_range(spans, ranges, STREAM, bucket=7).collect()}
    assert got == {(8, 12): [4, 6]}


def test_ordered_scans_equal_plain_windows(spark):
    rng = random.Random(3)
    rows = [(rng.choice("kk" "q"), i, rng.randrange(9) if rng.random() < 0.7 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o long, v long").withColumn("c", F.floor(F.col("o") / 16))
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    got = number_rows(preceding(df, ["k"], ["o"], "c", sums={"s": F.col("v")}, maxima={"m": F.col("v")}, last={"l": F.col("v")}), ["k"], ["o"], "c", "n")
    want = df.select("k", "o", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.max("v").over(w).alias("m"),
                     F.last("v", True).over(w).alias("l"), F.row_number().over(Window.partitionBy("k").orderBy("o")).alias("n"))
    cols = ["k", "o", "s", "m", "l", "n"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_lines_cross_chunk_borders(spark):
    text = "220 hi\r\n250-first line\r\n250 done\r\ntail"
    docs = spark.createDataFrame([("d", text)], "s string, text string")
    rows = dialogue.stream_lines(dialogue.cut_text(docs, STREAM, 5), STREAM).orderBy("line_no").collect()
    assert [(r.off, r.line, r.complete) for r in rows] == [
        (0, "220 hi", True), (8, "250-first line", True), (24, "250 done", True), (34, "tail", False)]
    replies = dialogue.smtp_replies(dialogue.stream_lines(dialogue.cut_text(docs, STREAM, 5), STREAM).where("complete"), STREAM)
    assert [(r.code, r.lines, r.reply) for r in replies.orderBy("reply_no").collect()] == [(220, 1, "hi"), (250, 2, "first line")]


def test_port_reuse_opens_a_new_conversation(spark):
    rows = [(1, 2), (2, 18), (3, 24), (4, 17), (5, 2), (6, 24), (7, 2)]
    df = spark.createDataFrame([("c", f, float(f), "10.0.0.1", 4000, "10.0.0.2", 25, 0, fl) for f, fl in rows],
                               "capture_id string, frame long, ts double, src string, sport long, dst string, dport long, seq long, flags long")
    got = {r.frame: r.conv_no for r in flows.split_conversations(df).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 1, 7: 1}


def hello(extensions):
    block = b"".join(code.to_bytes(2) + len(data).to_bytes(2) + data for code, data in extensions)
    return b"\x03\x03" + bytes(32) + b"\x00" + bytes.fromhex("0002c02f") + b"\x01\x00" + len(block).to_bytes(2) + block


def test_hello_lists_end_where_their_length_fields_say(spark):
    """Bytes behind a list belong to nothing; an empty extension has an empty list."""
    from mailveil.operators import handshake
    name = b"mail.example"
    trailing = hello([(0, (len(name) + 3).to_bytes(2) + b"\x00" + len(name).to_bytes(2) + name + b"more"), (10, bytes.fromhex("0002001d0017")),
                      (11, bytes.fromhex("01000708")), (43, bytes.fromhex("0203040909"))])
    rows = [("a", "C", "handshake", 1, 0, trailing), ("b", "C", "handshake", 1, 0, hello([(10, b""), (11, b"")]))]
    messages = spark.createDataFrame(rows, "key string, dir string, kind string, msg_type int, pos int, body binary")
    a, b = handshake.client_hello(messages).orderBy("key").collect()
    assert (a.sni, a.raw_groups, a.ec_point_formats, a.raw_versions) == ("mail.example", [29], [0], [772])
    assert (b.sni, b.raw_groups, b.ec_point_formats, b.raw_versions) == (None, [], [], None)


def test_record_flow_keeps_every_message(spark):
    from mailveil.operators import handshake
    rows = [("k", "C", "handshake", 11, pos, 0, 0) for pos in range(45)] + [("k", "C", "sealed", 3, 45, 0, 0)]
    messages = spark.createDataFrame(rows, "key string, dir string, kind string, msg_type int, pos int, level int, description int")
    flow = handshake.record_flow(messages).first()["flow"]
    assert len(flow) == 46 and flow[-1] == "encrypted records ×3"


def test_wall_clock_shows_milliseconds(spark):
    from mailveil.operators import packets
    rows = spark.createDataFrame([("c", 0.0), ("c", 90000.25)], "capture_id string, ts double")
    assert [r.time_text for r in packets.with_times(rows).orderBy("ts").collect()] == ["00:00:00.000", "01:00:00.250"]


def test_offsets_past_32_bits(spark):
    gap = (1 << 31) - 1000
    for isn in (100, 4294967290, None):
        first = 101 if isn is None else (isn + 1) % (1 << 32)
        # in order, then one that comes late, then on past the second wrap
        wanted = [0, gap, 2 * gap, 2 * gap - 50, 3 * gap, 4 * gap + 7, 4 * gap + 3, 5 * gap]
        rows = [((first + off) % (1 << 32), b"abcd") for off in wanted]
        placed = flows.place(segs(spark, rows, isn).repartition(3), STREAM)
        assert [r.off for r in placed.orderBy("frame").collect()] == wanted and max(wanted) > 1 << 33
        kept = flows.surviving_spans(placed, STREAM)
        assert [(r.start, r.kept) for r in kept.where("NOT covered").orderBy("start").collect()] == sorted([(o, 4) for o in wanted if o != 4 * gap + 7] + [(4 * gap + 7, 4)])


def test_unwrapping_leaves_short_streams_alone(spark):
    short = segs(spark, [(107, b"world"), (101, b"hello "), (99, b"x")])
    long_ = segs(spark, [(107, b"a"), (107 + (1 << 30), b"b")]).withColumn("s", F.lit("b"))
    both = flows.place(short.unionByName(long_), STREAM)
    assert sorted((r.s, r.off) for r in both.collect()) == [("a", -2), ("a", 0), ("a", 6), ("b", 6), ("b", 6 + (1 << 30))]
