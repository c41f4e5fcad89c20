"""The one-pass trace of segments against the chunked scans it stands in for."""

import random

from pyspark.sql import functions as F

from mailveil.operators import flows

SEGMENT = "capture_id string, frame long, ts double, src string, sport int, dst string, dport int, seq long, flags int, payload binary"


def traffic(spark):
    """Reused ports, lost handshakes, copies, overlaps, gaps, late segments, numbers that wrap, and offsets past 32 bits."""
    rng, rows, frame = random.Random(11), [], 0
    for flow in range(12):
        ends = ("10.0.0.1", 4000 + flow % 5, "10.0.0.2", (25, 8080, 143)[flow % 5 % 3])
        base = {side: (rng.randrange(1 << 32) if flow % 2 else (1 << 32) - 20) for side in (0, 1)}
        far, at = flow == 7, flow * 50.0
        plan = ([(0, 2, base[0], b""), (1, 18, base[1], b"")] if flow % 4 else []) + [
            (0 if flow == 7 else rng.randrange(2), 24, None, bytes(rng.choice(b"ab") for _ in range(rng.randrange(9)))) for _ in range(25)] + [(0, 17, base[0], b"")]
        for k, (side, flag, seq, payload) in enumerate(plan):
            frame += 1
            step = 1 + (k * (1 << 30) if far else rng.randrange(40))
            src, dst = (ends[:2], ends[2:]) if side == 0 else (ends[2:], ends[:2])
            rows.append((f"c{flow % 5 % 2}", frame, at + k // 2, *src, *dst, (base[side] + step) % (1 << 32) if seq is None else seq, flag, payload))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SEGMENT)


def told(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_trace_equals_the_chunked_scans(spark):
    segments = traffic(spark)
    plain, mixed = flows.trace(segments).cache(), flows.trace(segments, hot_segments=60)  # some pairs by one way, some by the other
    assert told(plain) == told(mixed)
    assert plain.where("off >= 4294967296").count() > 0 and plain.where("conv_no > 0").count() > 0


def test_trace_tells_what_the_steps_tell(spark):
    segments = traffic(spark)
    convs = flows.split_conversations(segments).cache()
    roles = flows.assign_roles(convs).cache()
    parts = flows.surviving_spans(flows.place(flows.directed(convs, roles)).cache())
    traced = flows.trace(segments).cache()
    assert told(flows.contributions_of(traced).drop("payload")) == told(parts)
    assert told(flows.roles_of(traced)) == told(roles)


def test_trace_deals_segments_once(spark):
    """Payloads cross the network once, however many steps read them."""
    plan = flows.trace(traffic(spark).repartition(4).where(F.col("frame") > 0))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_short_keys_are_scanned_without_summaries(spark):
    from mailveil.operators import dialogue
    from mailveil.operators.ordered import preceding
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.choice("ab"), i, rng.randrange(9) if rng.random() < 0.7 else None) for i in range(200)], "k string, o long, v long").withColumn("c", F.floor(F.col("o") / 16))
    values = {"sums": {"s": F.col("v")}, "maxima": {"m": F.col("v")}, "last": {"l": F.col("v")}}
    plain = preceding(df, ["k"], ["o"], None, **values)
    assert told(plain) == told(preceding(df, ["k"], ["o"], "c", **values))
    lines = spark.createDataFrame([("a", k, "250-x" if k % 3 else "250 x") for k in range(9)], "flow_id string, line_no long, line string")
    short = dialogue.reply_lines(lines, ["flow_id"], chunked=False)
    assert told(short) == told(dialogue.reply_lines(lines, ["flow_id"]))
    assert "Join" not in short._jdf.queryExecution().executedPlan().toString()
