"""Capture files read by byte ranges: the same frames and notes as one walk, whatever the range, also through damage."""

import bz2
import gzip
import lzma
import random
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from mailveil.sources import captures, ranges


def classic(rng, order="<", unit=1000, n=60, least=0):
    magic = 0xA1B2C3D4 if unit == 1000 else 0xA1B23C4D
    out = [struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)]
    for i in range(n):
        body = rng.randbytes(rng.choice([least, 1, 40, 300])) if rng.random() < 0.8 else out[-1]   # records within records
        out.append(struct.pack(order + "IIII", 1_500_000_000 + i, i, len(body), len(body)) + body)
    return b"".join(out)


def block(order, kind, body):
    body += bytes(-len(body) % 4)
    return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


def sections(rng, parts=3, n=25):
    out = []
    for part in range(parts):
        order = "<>"[part % 2]
        out.append(block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1)))
        for i in range(n):
            if i in (0, 7):
                out.append(block(order, 1, struct.pack(order + "HHI", 1 + i, 0, 0) + struct.pack(order + "HHB3xHH", 9, 1, rng.choice([6, 9, 3, 0x8A, 25]), 0, 0)))
            data = rng.randbytes(rng.randrange(90)) if rng.random() < 0.8 else out[-1]
            kind = rng.choice([6, 6, 2, 3, 4])
            head = {6: struct.pack(order + "IIIII", rng.randrange(3), 0, rng.getrandbits(32), len(data), len(data)), 3: struct.pack(order + "I", len(data)), 4: b"",
                    2: struct.pack(order + "HHIIII", rng.randrange(3), 0, 0, rng.getrandbits(32), len(data), len(data))}[kind]
            out.append(block(order, kind, head + data))
    return b"".join(out)


def rows_of(df):
    rows = df.select(F.regexp_extract("capture_id", "[^/]+$", 0).alias("f"), "frame", "ts_ns", "linktype", "data", "note").collect()
    return sorted(((r.f, r.frame or 0, r.ts_ns, r.linktype, bytes(r.data or b""), r.note) for r in rows), key=repr)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, at = random.Random(5), tmp_path_factory.mktemp("captures with space")
    plain = classic(rng)
    files = {"little": plain, "big": classic(rng, ">"), "nano": classic(rng, "<", 1), "cut": plain[:-7], "tail": plain + b"\xaa\xbb", "head": plain[:20], "bare": plain[:24],
             "zeros": classic(rng, least=0, n=15) + struct.pack("<IIII", 0, 0, 0, 0) * 20, "long": plain + struct.pack("<IIII", 1_500_000_000, 1, 1 << 27, 1 << 27) + plain[24:],
             "foreign": b"%PDF-1.4 and more", "empty": b"", "next": sections(rng), "nextcut": sections(rng)[:-9],
             "nextbad": sections(rng, 1) + struct.pack("<II", 6, 5) + sections(rng, 2), "odd": sections(rng, 1) + struct.pack("<II", 4, 13) + b"x" + struct.pack("<I", 13) + sections(rng, 1)}
    for name, content in files.items():
        (at / f"{name}.pcap").write_bytes(content)
    for suffix, pack in {"gz": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress, "zst": zstandard.compress}.items():
        (at / f"packed.pcap.{suffix}").write_bytes(pack(plain))
    (at / "torn.pcap.gz").write_bytes(gzip.compress(plain)[:900])
    (at / "archive.pcap").write_bytes(b"PK\3\4 and more")
    return at


def test_ranges_equal_one_walk(spark, folder):
    whole = rows_of(ranges.frames(spark, str(folder), tasks=4))
    assert rows_of(ranges.frames(spark, str(folder), range_bytes=700, tasks=4)) == whole
    # the reader of whole contents, where both define the case alike
    apart = {"torn.pcap.gz", "archive.pcap", "foreign.pcap"}
    other = [r for r in rows_of(captures.frames(captures.captures(spark, str(folder)))) if r[0] not in apart]
    assert [r for r in whole if r[0] not in apart] == other
    notes = {r[0]: r[5] for r in whole if r[5]}
    assert notes["foreign.pcap"].startswith("not a pcap") and notes["archive.pcap"].startswith("not a pcap") and notes["torn.pcap.gz"].startswith("could not unwrap gzip")
    assert notes["head.pcap"] == "truncated pcap global header" and "empty.pcap" not in notes and "bare.pcap" not in {r[0] for r in whole}


def test_ranges_shorter_than_records_settle_or_fall_back(spark, folder):
    names = ["little.pcap", "next.pcap", "cut.pcap", "odd.pcap", "long.pcap"]
    pattern = str(folder) + "/{" + ",".join(names) + "}"
    assert rows_of(ranges.frames(spark, pattern, range_bytes=61, tasks=4)) == rows_of(ranges.frames(spark, pattern, tasks=4))


def test_reading_goes_on_behind_damage(spark, folder):
    pattern = str(folder) + "/{long,nextbad}.pcap"
    whole = rows_of(ranges.frames(spark, pattern, resume=True, tasks=4))
    assert whole == rows_of(ranges.frames(spark, pattern, range_bytes=500, resume=True, tasks=4))
    stopped = rows_of(ranges.frames(spark, pattern, tasks=4))
    for name, times in (("long.pcap", 2), ("nextbad.pcap", 3)):
        count = [sum(r[0] == name and r[5] is None for r in rows) for rows in (whole, stopped)]
        assert count[0] > count[1] * (times - 0.8), (name, count)
        assert [r[5] for r in whole if r[0] == name and r[5]][0].endswith("found")


@pytest.mark.parametrize("order", "<>")
def test_blocks_that_read_alike_three_bytes_off(spark, tmp_path, monkeypatch, order):
    """Short blocks that end in zeros are chains in the other byte order too; a guess takes the file's own, and wrong ones do not spread."""
    head = block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(order, 1, struct.pack(order + "HHI", 1, 0, 0))
    body = b"".join(block(order, 6, struct.pack(order + "IIIII", 0, 0, k, 40, 40) + bytes([k % 9]) * (37 if k % 5 else 40) + bytes(3 if k % 5 else 0)) for k in range(400))
    (tmp_path / "zeros.pcapng").write_bytes(head + body)
    rounds, real = [], ranges._checked
    monkeypatch.setattr(ranges, "_checked", lambda df: rounds.append(1) or real(df))
    whole = rows_of(ranges.frames(spark, str(tmp_path), tasks=4))
    assert len(whole) == 400 and rows_of(ranges.frames(spark, str(tmp_path), range_bytes=500, tasks=4)) == whole
    assert len(rounds) == 2  # one for each reading: every guess was right
    monkeypatch.setattr(ranges.Blocks, "_shadow", lambda self, at, way: False)
    rounds.clear()
    assert rows_of(ranges.frames(spark, str(tmp_path), range_bytes=500, tasks=4)) == whole


def test_ranges_share_tasks(spark, folder):
    """A range is a few numbers; a task for each would cost more than its reading."""
    assert ranges.frames(spark, str(folder), range_bytes=100).rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
