"""Capture files of any size, read by byte ranges.

A file is cut into ranges of equal length, one task's work each. A range looks for the first place where
record headers plausibly follow one another, walks to the first record that begins past its end, and
reports where it began and ended. A beginning is right when it equals the end of the range before it; by
induction from the file's header, a file whose ranges all agree is read exactly as one walk would read it.
Ranges that began at a wrong place are walked again from the right one; a file that does not settle in
`ROUNDS` rounds is read by one task, in bounded memory. Compressed files cannot be entered in the
middle and are one range. A task holds one record (64 MiB; 128 MiB for a pcapng block) and one
batch of frames. What a pcapng range must know of its section, the interfaces described before it, is a few
numbers for each and travels with the range.

Files are listed by Spark and opened in the tasks through pyarrow, by the same URI.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import BinaryIO
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from mailveil.session import cut_lineage, ship_package
from mailveil.sources.captures import (BATCH, CAPTURE_PATH, COMPRESSION_MAGIC, FRAME_SCHEMA, MAX_BLOCK, MAX_RECORD,
                                       PCAP_MAGIC, PCAPNG_MAGIC, _table, _tick_ns)

RANGE_BYTES = 1 << 27
ROUNDS = 6
STOPPED, OPEN = -1, -2       # ends of ranges: nothing more is read; the next range begins where it finds a record
WHOLE = (1 << 63) - 1
CHUNK, BATCH_BYTES = 1 << 20, 1 << 23
CHAIN = 3                    # headers that must follow one another at a guessed beginning
YEARS = 10 * 366 * 86400     # a guessed record lies this near to the file's first one
SECTION = 0x0A0D0D0A
BLOCKS = [1, 2, 3, 4, 5, 6, 10, 0x0BAD, 0x40000BAD]   # fixed values: block types

DEFINITION = "array<struct<section boolean, linktype int, num string, den string>>"
RANGE_SCHEMA = ("capture_id string, part bigint, lo bigint, hi bigint, kind string, guess bigint, guess_order string, start bigint, "
                f"start_order string, end bigint, end_order string, frames bigint, definitions {DEFINITION}")
READ_SCHEMA = "capture_id string, part bigint, hi bigint, start bigint, start_order string, base bigint, known array<struct<linktype int, num string, den string>>"


class Bytes:
    """Bytes at any position of a file or of a decompressed stream, through one buffer."""

    def __init__(self, opener: Callable[[], BinaryIO], seekable: bool):
        self._opener, self._seekable = opener, seekable
        self._file, self._next, self._base, self._buffer = opener(), 0, 0, b""

    def at(self, position: int, size: int) -> bytes:
        """`size` bytes at a position, fewer only where the file ends."""
        offset = position - self._base
        if not 0 <= offset <= len(self._buffer) - size:
            if 0 <= offset <= len(self._buffer) and self._base + len(self._buffer) == self._next:
                self._buffer = self._buffer[offset:]
            else:
                self._go(position)
                self._buffer = b""
            self._base, offset = position, 0
            parts, missing = [self._buffer], max(size, CHUNK) - len(self._buffer)
            while missing > 0 and (got := self._file.read(missing)):
                parts.append(got)
                missing -= len(got)
                self._next += len(got)
            self._buffer = b"".join(parts)
        return self._buffer[offset:offset + size]

    def _go(self, position: int) -> None:
        if self._seekable:
            self._file.seek(position)
        else:
            if position < self._next:
                self._file.close()
                self._file, self._next = self._opener(), 0
            while self._next < position and (got := self._file.read(min(CHUNK, position - self._next))):
                self._next += len(got)
        self._next = position

    def close(self) -> None:
        self._file.close()


def located(path: str) -> tuple:
    """pyarrow's file system of a path or URI as Spark writes it, and the path in it."""
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@")) if "://" in path else (fs.LocalFileSystem(), path)


def _raw(path: str) -> BinaryIO:
    where, inner = located(path)
    return where.open_input_file(inner)


def _plain(path: str, compression: str) -> BinaryIO:
    raw = _raw(path)
    if compression == "zstd":
        import zstandard
        return zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
    module = __import__({"gzip": "gzip", "bzip2": "bz2", "xz": "lzma"}[compression])
    return module.open(raw, "rb")


def open_bytes(path: str) -> tuple[Bytes, str]:
    """The file's bytes without their compression, and the compression's name ('' when none)."""
    plain = Bytes(lambda: _raw(path), True)
    head = plain.at(0, 8).hex().upper()
    compression = next((name for magic, name in COMPRESSION_MAGIC if head.startswith(magic)), "")
    if compression in ("gzip", "bzip2", "xz", "zstd"):
        plain.close()
        return Bytes(lambda: _plain(path, compression), False), compression
    return plain, compression


@dataclass
class Walk:
    """What is known at a place of a file: byte order and interfaces; where the walk ended."""

    order: str
    interfaces: list = field(default_factory=list)
    definitions: list = field(default_factory=list)
    end: int = STOPPED


class Classic:
    """Records of a classic capture."""

    first = 24

    def __init__(self, data: Bytes, magic: str):
        self.data, (self.order, self.unit) = data, PCAP_MAGIC[magic]
        header = data.at(0, 40)
        self.complete = len(header) >= 24
        self.linktype = struct.unpack_from(self.order + "I", header, 20)[0] & 0x0FFFFFFF if self.complete else None
        self.epoch = struct.unpack_from(self.order + "I", header, 24)[0] if len(header) == 40 else 0
        self.note = None if self.complete else "truncated pcap global header"

    def _plausible(self, buffer: bytes) -> np.ndarray:
        count = len(buffer) - 15
        second, fraction, size, original = (np.ndarray((count,), self.order + "u4", buffer, o, (1,)) for o in (0, 4, 8, 12))
        near = np.abs(second.astype(np.int64) - self.epoch) <= YEARS
        return near & (fraction < 1_000_000_000 // self.unit) & (size > 0) & (size <= MAX_RECORD) & (size <= original)

    def find(self, lo: int, hi: int) -> tuple[int, str]:
        """First place in [lo, hi) where CHAIN records, or the last ones of the file, follow one another."""
        while lo < hi:
            buffer = self.data.at(lo, min(CHUNK, hi - lo + 15))
            if len(buffer) < 16:
                break
            for offset in np.flatnonzero(self._plausible(buffer)):
                if self._chained(lo + int(offset)):
                    return lo + int(offset), self.order
            lo += len(buffer) - 15
        return OPEN, self.order

    def _chained(self, at: int) -> bool:
        for _ in range(CHAIN):
            header = self.data.at(at, 16)
            if not header:
                return True
            if len(header) < 16 or not self._plausible(header)[0]:
                return False
            size = struct.unpack_from(self.order + "I", header, 8)[0]
            if not self.data.at(at + 15 + size, 1):
                return False
            at += 16 + size
        return True

    def read(self, at: int, hi: int, walk: Walk, payload: bool, resume: bool) -> Iterator[tuple]:
        """(ts_ns, linktype, bytes, note) of the records that begin in [at, hi)."""
        while at < hi:
            header = self.data.at(at, 16)
            if len(header) < 16:
                if header:
                    yield None, None, None, "file ends mid-record header; trailing bytes ignored"
                return
            seconds, fraction, size, _ = struct.unpack(self.order + "IIII", header)
            if size > MAX_RECORD:
                if not resume:
                    yield None, None, None, f"record claims {size:,} bytes; stopped reading"
                    return
                yield None, None, None, f"record at byte {at:,} claims {size:,} bytes; went on at the next record found"
                at, _ = self.find(at + 1, hi)
                if at == OPEN:
                    walk.end = OPEN
                    return
                continue
            data = self.data.at(at + 16, size) if payload else None
            if size and (len(data) < size if payload else not self.data.at(at + 15 + size, 1)):
                yield None, None, None, "file ends mid-record; final partial frame ignored"
                return
            yield seconds * 1_000_000_000 + fraction * self.unit, self.linktype, data, None
            at += 16 + size
        walk.end = at


class Blocks:
    """Blocks of a pcapng capture."""

    first, note, complete = 0, None, True

    def __init__(self, data: Bytes):
        self.data, self.order = data, ">" if data.at(8, 4) == b"\x1a\x2b\x3c\x4d" else "<"

    def _header(self, at: int, order: str) -> tuple[int, int, str] | None:
        head = self.data.at(at, 12)
        if len(head) < 12:
            return None
        if head[:4] == b"\x0a\x0d\x0d\x0a":
            order = "<" if head[8:] == b"\x4d\x3c\x2b\x1a" else ">"
        return (*struct.unpack_from(order + "II", head), order)

    def _chained(self, at: int, order: str) -> bool:
        for _ in range(CHAIN):
            if not self.data.at(at, 1):
                return True
            header = self._header(at, order)
            if header is None:
                return False
            kind, size, order = header
            if (kind != SECTION and kind not in BLOCKS) or not 12 <= size <= MAX_BLOCK or size % 4:
                return False
            if self.data.at(at + size - 4, 4) != struct.pack(order + "I", size):
                return False
            at += size
        return True

    def _shadow(self, at: int, order: str) -> bool:
        """Whether a chain is more likely that of the file's own byte order, read three bytes off.

        Short blocks that end in zeros read alike in the other order from three bytes before (little-endian) or behind (big-endian).
        """
        if order == self.order or self.data.at(at, 4) == b"\x0a\x0d\x0d\x0a":
            return False
        twin = at + 3 if order == ">" else at - 3
        return twin >= 0 and self._chained(twin, self.order)

    def find(self, lo: int, hi: int) -> tuple[int, str]:
        """First place in [lo, hi) where CHAIN blocks, or the last ones of the file, follow one another."""
        while lo < hi:
            buffer = self.data.at(lo, min(CHUNK, hi - lo + 11))
            if len(buffer) < 12:
                break
            kinds = {o: np.ndarray((len(buffer) - 11,), o + "u4", buffer, 0, (1,)) for o in "<>"}
            for offset in np.flatnonzero(np.isin(kinds["<"], BLOCKS + [SECTION]) | np.isin(kinds[">"], BLOCKS)):
                for order in "<>":
                    if self._chained(lo + int(offset), order) and not self._shadow(lo + int(offset), order):
                        return lo + int(offset), self._header(lo + int(offset), order)[2]
            lo += len(buffer) - 11
        return OPEN, self.order

    def read(self, at: int, hi: int, walk: Walk, payload: bool, resume: bool) -> Iterator[tuple]:
        """(ts_ns, linktype, bytes, note) of the packet blocks that begin in [at, hi)."""
        while at < hi:
            head = self.data.at(at, 12)
            if len(head) < 8:
                return
            section = head[:4] == b"\x0a\x0d\x0d\x0a"
            order = walk.order if not section else "<" if head[8:] == b"\x4d\x3c\x2b\x1a" else ">"
            kind, size = struct.unpack_from(order + "II", head)
            if not 12 <= size <= MAX_BLOCK:
                if not resume:
                    yield None, None, None, f"implausible pcapng block length ({size:,} bytes); stopped reading"
                    return
                yield None, None, None, f"block at byte {at:,} claims {size:,} bytes; went on at the next block found"
                at, walk.order = self.find(at + 1, hi)
                if at == OPEN:
                    walk.end = OPEN
                    return
                continue
            if not self.data.at(at + size - 1, 1):
                yield None, None, None, "file ends mid-block; final partial block ignored"
                return
            if section:
                walk.order, walk.interfaces = order, []
                walk.definitions = [(True, 0, 0, 0)]   # what came before no longer matters
            elif kind in (1, 2, 3, 6):
                block = self.data.at(at + 8, size - 12 if payload or kind == 1 else min(size - 12, 20))
                yield from self._packet(kind, block, walk)
            at += size
        walk.end = at

    def _packet(self, kind: int, body: bytes, walk: Walk) -> Iterator[tuple]:
        if kind == 3:
            yield 0, (walk.interfaces[0][0] if walk.interfaces else 1), body[4:], None
        elif kind == 1 and len(body) >= 8:
            interface = (struct.unpack_from(walk.order + "H", body)[0], *_tick_ns(body[8:], walk.order))
            walk.interfaces.append(interface)
            walk.definitions.append((False, *interface))
        elif kind in (2, 6) and len(body) >= 20:
            index = struct.unpack_from(walk.order + ("I" if kind == 6 else "H"), body)[0]
            high, low, captured = struct.unpack_from(walk.order + "III", body, 4)
            linktype, num, den = walk.interfaces[index] if index < len(walk.interfaces) else (1, 1000, 1)
            yield ((high << 32) | low) * num // den, linktype, body[20:20 + captured], None


def _container(data: Bytes) -> Classic | Blocks | None:
    magic = data.at(0, 4).hex().upper()
    return Classic(data, magic) if magic in PCAP_MAGIC else Blocks(data) if magic == PCAPNG_MAGIC else None


def _walked(path: str, part: int, hi: int, start: tuple[int, str] | None, lo: int, resume: bool) -> tuple | None:
    """A range's row without path and part: kind, guess, start, end, frames and what it defines."""
    data, compression = open_bytes(path)
    try:
        container = None if compression else _container(data)
        if container is None or not container.complete:
            # compressed, foreign and headless files are one range
            if part:
                return None
            begin = (0, "<")
            return WHOLE, compression or "whole", *begin, *begin, STOPPED, "<", 0, []
        guess = (container.first, container.order) if part == 0 else container.find(max(lo, container.first), hi)
        begin = start or guess
        walk, frames = Walk(begin[1], end=begin[0]), 0
        if 0 <= begin[0] < hi:
            walk.end = STOPPED
            frames = sum(row[3] is None for row in container.read(begin[0], hi, walk, False, resume))
        return hi, "plain", *guess, *begin, walk.end, walk.order, frames, walk.definitions
    finally:
        data.close()


def _index(resume: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    names = [c.split()[0] for c in RANGE_SCHEMA.split(", ")[:13]]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, part, lo, hi, start, order in zip(*(batch[c] for c in ("capture_id", "part", "lo", "hi", "start", "start_order"))):
                known = None if pd.isna(start) else (int(start), order)
                if (row := _walked(path, int(part), int(hi), known, int(lo), resume)) is None:
                    continue
                definitions = [{"section": s, "linktype": t, "num": str(n), "den": str(d)} for s, t, n, d in row[-1]]
                rows.append((path, part, lo, *row[:-1], definitions))
            if rows:
                yield pd.DataFrame(rows, columns=names)
    return walk


def _begin(path: str, data: Bytes, compression: str) -> Classic | Blocks | str:
    try:
        container = _container(data)
    except Exception as err:  # whatever a decompressor raises ends in a note
        return f"could not unwrap {compression}: {err}"
    if container is None:
        return f"not a pcap or pcapng capture (magic {data.at(0, 4).hex()})"
    return container if container.complete else container.note


def _frames_of(path: str, hi: int, start: int, order: str, known: list, resume: bool) -> Iterator[tuple]:
    data, compression = None, ""
    try:
        data, compression = open_bytes(path)
        container = _begin(path, data, compression)
        if isinstance(container, str):
            yield None, None, None, container
            return
        if hi == WHOLE:
            start, order = container.first, container.order
        yield from container.read(start, hi, Walk(order, list(known)), True, resume)
    except Exception as err:
        if not compression:
            raise
        yield None, None, None, f"could not unwrap {compression}: {err}"
    finally:
        if data is not None:
            data.close()


def _reader(resume: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for path, hi, start, order, base, known in zip(*(batch[c] for c in ("capture_id", "hi", "start", "start_order", "base", "known"))):
                number, known = int(base), [(k["linktype"], int(k["num"]), int(k["den"])) for k in known]
                for ts_ns, linktype, data, note in _frames_of(path, int(hi), int(start), order, known, resume):
                    number += note is None
                    ts_ns = None if ts_ns is None or ts_ns > WHOLE else ts_ns   # a clock past 64 bits is unknown
                    rows.append((path, number if note is None else None, ts_ns, linktype, data, note))
                    held += len(data or b"")
                    if len(rows) >= BATCH or held >= BATCH_BYTES:
                        yield _table(rows)
                        rows, held = [], 0
        if rows:
            yield _table(rows)
    return read


def _in_file() -> WindowSpec:
    return Window.partitionBy("capture_id").orderBy("part")


def _checked(ranges: DataFrame) -> DataFrame:
    """Ranges with the beginning each is due (`due`, `due_order`); those after a sure end of reading go.

    Before the first range that began at a wrong place all ranges are right, so an end of reading there is sure.
    """
    before, order_before = F.lag("end").over(_in_file()), F.lag("end_order").over(_in_file())
    own = (F.col("part") == 0) | (before == OPEN)
    due = ranges.withColumns({"due": F.when(own, F.col("guess")).otherwise(before),
                              "due_order": F.when(own, F.col("guess_order")).otherwise(order_before)})
    # an order without a position means nothing
    due = due.withColumn("wrong", (F.col("due") != F.col("start")) | ((F.col("due") >= 0) & (F.col("due_order") != F.col("start_order"))))
    due = due.withColumn("unsure", F.coalesce(F.lag("wrong").over(_in_file()), F.lit(False)))
    earlier = _in_file().rowsBetween(Window.unboundedPreceding, -1)
    wrong_before = F.coalesce(F.max("wrong").over(_in_file()), F.lit(False))
    due = due.withColumn("sure_stop", (F.col("end") == STOPPED) & ~wrong_before)
    return (due.withColumn("behind", F.coalesce(F.max("sure_stop").over(earlier), F.lit(False)))
            .where("not behind").drop("sure_stop", "behind"))


def _settled(ranges: DataFrame, tasks: int, resume: bool) -> DataFrame:
    """Ranges that all begin where the range before them ends.

    A range behind a wrong one may be right, as the end it was held against is not sure. So every other round leaves it alone until
    the one before it was walked again; else one wrong guess would spread to the end of its file, a range a round.
    """
    kept = [f.split()[0] for f in RANGE_SCHEMA.split(", ")[:13]]
    for turn in range(ROUNDS + 1):
        checked = cut_lineage(_checked(ranges))
        wrong = checked.where("wrong")
        if wrong.isEmpty():
            return checked.select(kept)
        if turn % 2 == 0:
            wrong = wrong.where("NOT unsure")
        if turn == ROUNDS:
            unsettled = checked.where("wrong").select("capture_id").distinct()
            whole = (checked.join(unsettled, "capture_id", "left_semi").where("part = 0")
                     .withColumns({"hi": F.lit(WHOLE), "definitions": F.lit(None).cast(DEFINITION)}))
            return checked.join(unsettled, "capture_id", "left_anti").select(kept).unionByName(whole.select(kept))
        again = (wrong.withColumns({"start": F.col("due"), "start_order": F.col("due_order")})
                 .select("capture_id", "part", "lo", "hi", "start", "start_order").repartition(tasks, "capture_id", "part"))
        still = F.col("wrong") & F.col("unsure") if turn % 2 == 0 else F.lit(False)
        ranges = checked.where(~F.col("wrong") | still).select(kept).unionByName(again.mapInPandas(_index(resume), RANGE_SCHEMA))
    raise AssertionError


def frames(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, resume: bool = False,
           tasks: int | None = None) -> DataFrame:
    """One row per frame of every capture file below a folder, numbered from 1 in each file.

    A row without frame number carries a reading note. An implausible record length ends a file, as nothing
    after it is certain; with `resume` reading goes on at the next place where CHAIN records follow one
    another. The result does not depend on `range_bytes`. `tasks` share the ranges: unless given, one for each RANGE_BYTES
    and four for each core at least, but no more than there are ranges. Empty files give no row, foreign files and
    damaged compressed ones a note.
    """
    ship_package(spark)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .where(F.col("path").rlike(CAPTURE_PATH) & (F.col("length") > 0))
             .select(F.col("path").alias("capture_id"), "length"))
    if tasks is None:
        length = F.col("length")
        ranges, full = files.agg(F.sum(F.ceil(length / range_bytes)), F.ceil(F.sum(length) / RANGE_BYTES)).first()
        tasks = max(1, min(int(ranges or 1), max(int(full or 1), 4 * spark.sparkContext.defaultParallelism), 50_000))
    cut = (files.select("capture_id", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / range_bytes))).alias("part"))
           .select("capture_id", F.col("part").cast("bigint").alias("part"), (F.col("part") * range_bytes).cast("bigint").alias("lo"),
                   F.least(F.col("length"), (F.col("part") + 1) * range_bytes).cast("bigint").alias("hi"),
                   F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("string").alias("start_order"))
           .repartition(tasks, "capture_id", "part"))
    index = _settled(cut_lineage(cut.mapInPandas(_index(resume), RANGE_SCHEMA)), tasks, resume)
    earlier = _in_file().rowsBetween(Window.unboundedPreceding, -1)
    # definitions of earlier ranges, from the last section on
    told = F.flatten(F.collect_list("definitions").over(earlier))
    size, back = F.array_size("told"), F.array_position(F.reverse(F.transform("told", lambda t: t["section"])), True)
    since = F.slice("told", (F.when(back > 0, size - back + 1).otherwise(0) + 1).cast("int"), size)
    todo = (index.withColumn("told", F.coalesce(told, F.array().cast(DEFINITION)))
            .withColumns({"base": F.coalesce(F.sum("frames").over(earlier), F.lit(0)),
                          "known": F.transform(since, lambda t: F.struct(t["linktype"].alias("linktype"), t["num"].alias("num"), t["den"].alias("den")))})
            .where((F.col("start") >= 0) & (F.col("start") < F.col("hi")))
            .select("capture_id", "part", "hi", "start", "start_order", "base", "known"))
    return cut_lineage(todo).repartition(tasks, "capture_id", "part").mapInPandas(_reader(resume), FRAME_SCHEMA)
