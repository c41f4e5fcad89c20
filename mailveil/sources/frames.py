"""Frames to TCP segments, as column expressions over the hex text of each frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Link types, ether types and IPv6 extension headers.
ETHERNET, LINUX_SLL, LINUX_SLL2, BSD_NULL, RAW_IP = 1, 113, 276, 0, (101, 228, 229)
SUPPORTED = (ETHERNET, LINUX_SLL, LINUX_SLL2, BSD_NULL, *RAW_IP)
VLAN_WALK = r"^.{24}(?:(?:8100|88A8|9100).{4})*"
IPV6_EXTENSIONS = (0, 43, 60, 51, 135, 139, 140)


def number(hex_text: Column, byte: Column | int, size: int) -> Column:
    """Big-endian unsigned value of ``size`` bytes at a 0-based byte offset."""
    start = (F.lit(byte) if isinstance(byte, int) else byte) * 2 + 1
    return F.conv(F.substring(hex_text, start.cast("int"), F.lit(size * 2)), 16, 10).cast("bigint")


def ipv4_text(hex_text: Column, byte: Column) -> Column:
    return F.concat_ws(".", *[number(hex_text, byte + i, 1).cast("string") for i in range(4)])


def ipv6_groups(hex_text: Column, byte: Column) -> Column:
    """Eight groups without leading zeros, not yet folded."""
    full = F.regexp_replace(F.lower(F.substring(hex_text, (byte * 2 + 1).cast("int"), F.lit(32))), "(.{4})(?!$)", "$1:")
    return F.regexp_replace(full, "(^|:)0{1,3}(?=[0-9a-f])", "$1")


def fold_zeros(groups: Column) -> Column:
    """Canonical text: the longest run of zero groups, the first of equals, becomes '::'."""
    runs = F.array_sort(F.transform(F.array_distinct(F.regexp_extract_all(groups, F.lit(r"(?:^|(?<=:))(0(?::0)+)(?=:|$)"), F.lit(1))),
                                    lambda r: F.struct((-F.length(r)).alias("n"), r.alias("r"))))
    run = F.get(runs, F.lit(0))["r"]
    at = F.instr(F.concat(F.lit(":"), groups, F.lit(":")), F.concat(F.lit(":"), run, F.lit(":")))
    left = F.rtrim(F.substring(groups, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")), F.lit(":"))
    right = F.ltrim(F.substring(groups, (at + F.length(run)).cast("int"), F.lit(64)), F.lit(":"))
    return F.when(run.isNull(), groups).otherwise(F.concat(left, F.lit("::"), right))


def _locate_ip(df: DataFrame) -> DataFrame:
    """IP version and its byte offset for every link type; null version means not IP."""
    h, size, link = F.col("h"), F.length("h") / 2, F.col("linktype")
    tags = F.length(F.regexp_extract(h, VLAN_WALK, 0)) / 2
    ether_at = F.when(link == ETHERNET, tags).when(link == LINUX_SLL, 14.0).when(link == LINUX_SLL2, 0.0)
    payload_at = F.when(link == ETHERNET, tags + 2).when(link == LINUX_SLL, 16.0).when(link == LINUX_SLL2, 20.0)
    df = df.withColumns({"_ether_at": ether_at, "_payload_at": payload_at})
    ether = F.when(size >= F.col("_payload_at"), number(h, F.col("_ether_at"), 2))
    family_le = F.conv(F.concat(*[F.substring(h, 7 - 2 * i, 2) for i in range(4)]), 16, 10).cast("bigint")
    family = F.when(family_le < 256, family_le).otherwise(number(h, 0, 4))
    raw = F.floor(number(h, 0, 1) / 16)
    version = (F.when(link.isin(ETHERNET, LINUX_SLL, LINUX_SLL2), F.when(ether == 0x0800, 4).when(ether == 0x86DD, 6))
               .when(link == BSD_NULL, F.when(size < 4, None).when(family == 2, 4).when(family.isin(10, 24, 28, 30), 6))
               .when(link.isin(*RAW_IP), F.when(raw.isin(4, 6), raw)))
    start = F.coalesce(F.col("_payload_at"), F.when(link == BSD_NULL, 4.0).otherwise(0.0))
    return df.withColumns({"ip_version": version.cast("int"), "ip_at": start.cast("bigint")}).drop("_ether_at", "_payload_at")


def _walk_extensions(h: Column, ip_at: Column, end: Column) -> Column:
    """Follow IPv6 extension headers: struct<next, at, status>, one step per possible header."""
    first = F.struct(number(h, ip_at + 6, 1).alias("next"), (ip_at + 40).alias("at"), F.lit("walk").alias("status"))

    def step(s: Column, _: Column) -> Column:
        more = (s["status"] == "walk") & s["next"].isin(*IPV6_EXTENSIONS, 44)
        short, fragment = end - s["at"] < 8, s["next"] == 44
        size = F.when(s["next"] == 51, (number(h, s["at"] + 1, 1) + 2) * 4).otherwise((number(h, s["at"] + 1, 1) + 1) * 8)
        onward = F.struct(number(h, s["at"], 1).alias("next"), (s["at"] + size).alias("at"), F.lit("walk").alias("status"))
        stop = F.struct(s["next"].alias("next"), s["at"].alias("at"),
                        F.when(short, "truncated").otherwise("fragment").alias("status"))
        return F.when(~more, s).when(short | fragment, stop).otherwise(onward)

    steps = F.sequence(F.lit(1), F.greatest(F.floor((end - ip_at) / 8), F.lit(1)).cast("int"))
    return F.aggregate(steps, first, step)


def decode(frames: DataFrame) -> DataFrame:
    """Every frame with its outcome: tcp, non_ip, non_tcp, fragment or truncated."""
    df = _locate_ip(frames.where("frame IS NOT NULL").withColumn("h", F.hex("data")))
    h, at, size = F.col("h"), F.col("ip_at"), (F.length("h") / 2).cast("bigint")
    v4, v6 = F.col("ip_version") == 4, F.col("ip_version") == 6
    total, plen = number(h, at + 2, 2), number(h, at + 4, 2)
    fragmented = number(h, at + 6, 2).bitwiseAND(F.lit(0x3FFF)) != 0
    have = size - at
    end = (F.when(v4 & (total > 0) & (total <= have), at + total)
           .when(v6 & (plen > 0), F.least(at + 40 + plen, size)).otherwise(size))
    df = df.withColumn("end", end)
    df = df.withColumn("ext", F.when(v6 & (have >= 40), _walk_extensions(h, at, F.col("end"))))
    ip_state = (F.when(F.col("ip_version").isNull(), "non_ip")
                .when((v4 & (have < 20)) | (v6 & (have < 40)), "truncated").when(v4 & fragmented, "fragment")
                .when(v4 & (number(h, at + 9, 1) != 6), "non_tcp").when(v6 & (F.col("ext.status") != "walk"), F.col("ext.status"))
                .when(v6 & (F.col("ext.next") != 6), "non_tcp"))
    tcp_at = F.when(v4, at + number(h, at, 1).bitwiseAND(F.lit(15)) * 4).otherwise(F.col("ext.at"))
    df = df.withColumns({"_state": ip_state, "tcp_at": tcp_at})
    head = F.floor(number(h, F.col("tcp_at") + 12, 1) / 16) * 4
    room = F.col("end") - F.col("tcp_at")
    outcome = F.coalesce("_state", F.when((room < 20) | (head < 20) | (head > room), "truncated").otherwise("tcp"))
    # one generated row per frame: later filters on the outcome stay above the decoding
    # instead of repeating its expressions inside a pushed-down predicate
    row = F.struct(outcome.alias("outcome"), (F.col("tcp_at") + head).alias("data_at"), F.col("tcp_at"), F.col("ip_at"),
                   F.col("ip_version"), F.col("end"), F.col("h"))
    return df.select("capture_id", "frame", "ts_ns", "linktype", "data", F.inline(F.array(row)))


def segments(decoded: DataFrame) -> DataFrame:
    """TCP segments of decoded frames."""
    h, tcp, ip = F.col("h"), F.col("tcp_at"), F.col("ip_at")
    v4 = F.col("ip_version") == 4
    found = decoded.where("outcome = 'tcp'").withColumns({
        "_src": F.when(v4, ipv4_text(h, ip + 12)).otherwise(ipv6_groups(h, ip + 8)),
        "_dst": F.when(v4, ipv4_text(h, ip + 16)).otherwise(ipv6_groups(h, ip + 24))})
    src, dst = (F.when(v4, F.col(c)).otherwise(fold_zeros(F.col(c))) for c in ("_src", "_dst"))
    size = (F.col("end") - F.col("data_at")).cast("int")
    return found.select(
        "capture_id", "frame", (F.col("ts_ns") / 1_000_000_000).alias("ts"), src.alias("src"), dst.alias("dst"),
        number(h, tcp, 2).alias("sport"), number(h, tcp + 2, 2).alias("dport"), number(h, tcp + 4, 4).alias("seq"),
        number(h, tcp + 8, 4).alias("ack"), number(h, tcp + 12, 2).bitwiseAND(F.lit(0x1FF)).alias("flags"),
        F.substring(F.col("data"), (F.col("data_at") + 1).cast("int"), size).alias("payload"))


def read_stats(decoded: DataFrame) -> DataFrame:
    """Reading counters of every capture, as one aggregation over the outcomes."""
    def count(outcome: str) -> Column:
        return F.count_if(F.col("outcome") == outcome)

    return decoded.groupBy("capture_id").agg(
        F.count("*").alias("frames"), count("tcp").alias("tcp_segments"), count("non_ip").alias("non_ip"),
        count("non_tcp").alias("non_tcp"), count("fragment").alias("fragments_skipped"), count("truncated").alias("truncated"),
        F.sort_array(F.collect_set("linktype")).alias("link_types"),
        F.sort_array(F.collect_set(F.when(~F.col("linktype").isin(*SUPPORTED), F.col("linktype")))).alias("unsupported_link_types"))
