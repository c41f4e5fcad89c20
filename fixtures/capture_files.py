"""Stand-in capture files: the frames of every capture as one file, for readers that split files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PCAPNG = "ascii(right(capture_id, 1)) % 2 = 1"   # odd captures are pcapng with an interface for each link type, the others classic
LINKTYPE = f"CASE WHEN {PCAPNG} THEN linktype ELSE 1 END"


def _block(kind: int, body: bytes) -> bytes:
    body += bytes(-len(body) % 4)
    return struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)


def _writer(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from mailveil.sources.ranges import located
        where, inner = located(folder)
        current, out, interfaces = None, None, {}
        for batch in batches:
            for capture, following, linktype, ts, data in zip(*(batch[c] for c in ("capture_id", "pcapng", "linktype", "ts", "data"))):
                if capture != current:
                    if out:
                        out.close()
                    current, interfaces = capture, {}
                    out = where.open_output_stream(f"{inner}/{capture}.{'pcapng' if following else 'pcap'}")
                    out.write(_block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) if following else struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
                if following:
                    if linktype not in interfaces:
                        interfaces[linktype] = len(interfaces)
                        out.write(_block(1, struct.pack("<HHI", linktype, 0, 0)))
                    ticks = ts * 1_000_000
                    out.write(_block(6, struct.pack("<IIIII", interfaces[linktype], ticks >> 32, ticks & 0xFFFFFFFF, len(data), len(data)) + data))
                else:
                    out.write(struct.pack("<IIII", ts, 0, len(data), len(data)) + data)
        if out:
            out.close()
        yield pd.DataFrame({"written": [current]}).astype("string")
    return write


def write_files(frames: DataFrame, folder: str) -> None:
    """One file for each capture, its frames in order; a task run again writes the same bytes over."""
    from mailveil.session import ship_package
    from mailveil.sources.ranges import located
    where, inner = located(folder)
    where.create_dir(inner, recursive=True)
    ship_package(frames.sparkSession)
    rows = (frames.select("capture_id", "frame", F.expr(PCAPNG).alias("pcapng"), "linktype", "ts", F.unhex("data_hex").alias("data"))
            .repartition("capture_id").sortWithinPartitions("capture_id", "frame"))
    rows.mapInPandas(_writer(folder), "written string").write.format("noop").mode("overwrite").save()
