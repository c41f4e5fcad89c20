"""URL filters: a sorted array of 64-bit digests, mapped from a file and probed by vectorised binary search.

A rule is a host, a path and an action (`allow` or `block`). It fits its host and all subdomains of it, if the URL's path
starts with the rule's. Of several that fit, the one whose host and path together are longest wins; at equal length the
longer host does. A URL that no rule fits is allowed: the method's verdict on a key it does not hold.

The list becomes segments of keys: every host that has rules, with the lengths of their paths, and every host with path, with
its action. Keys are sorted by their XXH64 digest. Spark sorts them by range and the driver copies one segment after the
other into the shared folder, so it never holds the list; an executor fetches each file once and all its workers map it, so
a list may be larger than a worker's memory and costs the executor's disk only. A batch of URLs asks first for the suffixes
of its hosts and then, for hosts found, for as many path prefixes as they have path lengths. Keys of equal digest are told
apart by the stored text, which every hit is compared with.

No URL is shuffled, so hot hosts cost nothing. Null URLs and those without `://` have an empty host and path and no rule. A
null host or path of a rule counts as empty; an action that is not one of the two fails the job. Rules that repeat a host and
path count once, as `block` if they disagree. Empty lists and tables, repeated rows and further columns are fine.
"""

from __future__ import annotations

import mmap
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailveil.llm import rows
from mailveil.session import shared_folder, ship_package

ALLOW, BLOCK = 0, 1
VERDICTS = ("allow", "block")
#: Keys of one segment: what a sorting task and the driver hold at once.
SEGMENT_KEYS = 1_000_000
COPY_BYTES = 1 << 20

#: The rules of the registered query: action, host and path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

Digest = Callable[[bytes], int]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first `://` up to `/`, `?` or `#`, with A-Z in lower case; and what follows that up to `?` or `#`."""
    start = F.locate("://", url)
    rest = F.when(F.coalesce(start, F.lit(0)) > 0, F.substr(url, start + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def host_key(host: bytes) -> bytes:
    return b"h" + host


def rule_key(host: bytes, path: bytes) -> bytes:
    return struct.pack("<q", len(host)) + host + path


class Segment:
    """Keys sorted by digest, in one buffer.

    It starts with the number of keys; the digests, the ends of the keys' texts and the ends of their values follow, then the
    texts and the values. All numbers take 64 bits.
    """

    def __init__(self, data: bytes | mmap.mmap) -> None:
        whole = pa.py_buffer(data)
        n = struct.unpack_from("<q", data)[0]
        at = np.cumsum([8, 8 * n, 8 * (n + 1), 8 * (n + 1)])
        text_ends = whole.slice(at[1], 8 * (n + 1))
        self.ends = np.frombuffer(whole.slice(at[2], 8 * (n + 1)), np.int64)
        size = int(np.frombuffer(text_ends, np.int64)[-1])
        self.digests = np.frombuffer(whole.slice(at[0], 8 * n), np.uint64)
        self.texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, text_ends, whole.slice(at[3], size)])
        self.values = np.frombuffer(whole.slice(at[3] + size, 8 * int(self.ends[-1])), np.int64)

    @staticmethod
    def pack(digests: np.ndarray, texts: list[bytes], values: list[list[int]]) -> bytes:
        ends = [np.concatenate([[0], np.cumsum([len(x) for x in column])]).astype(np.int64).tobytes() for column in (texts, values)]
        flat = np.array([v for some in values for v in some], np.int64)
        return b"".join([struct.pack("<q", len(texts)), digests.astype(np.uint64).tobytes(), *ends, *texts, flat.tobytes()])

    def find(self, asked: np.ndarray, wanted: pa.Array) -> np.ndarray:
        """The place of each key, or -1: a binary search of all digests at once, then a comparison of texts."""
        found = np.full(len(asked), -1, np.int64)
        spot = np.searchsorted(self.digests, asked)
        unsure = np.arange(len(asked))
        while len(unsure):  # again only where digests collide
            unsure = unsure[spot[unsure] < len(self.digests)]
            unsure = unsure[self.digests[spot[unsure]] == asked[unsure]]
            same = pc.equal(self.texts.take(pa.array(spot[unsure])), wanted.take(pa.array(unsure))).to_numpy(zero_copy_only=False).astype(bool)
            found[unsure[same]] = spot[unsure[same]]
            unsure = unsure[~same]
            spot[unsure] += 1
        return found


class DigestArray:
    """Segments in the order of their digests; equal digests lie in one segment."""

    def __init__(self, segments: list[Segment], digest: Digest = xxhash.xxh64_intdigest) -> None:
        self.segments, self.digest = segments, digest
        self.firsts = np.array([s.digests[0] for s in segments], np.uint64)

    def find(self, texts: list[bytes]) -> list[np.ndarray | None]:
        """The values stored for each key, None for a key that is not held."""
        out: list[np.ndarray | None] = [None] * len(texts)
        if not self.segments or not texts:
            return out
        asked = np.fromiter(map(self.digest, texts), np.uint64, len(texts))
        owner = np.searchsorted(self.firsts, asked, "right") - 1
        for k in np.unique(owner[owner >= 0]):
            segment, mine = self.segments[k], np.flatnonzero(owner == k)
            places = segment.find(asked[mine], pa.array([texts[i] for i in mine], pa.large_binary()))
            for i, place in zip(mine[places >= 0], places[places >= 0], strict=True):
                out[i] = segment.values[segment.ends[place]:segment.ends[place + 1]]
        return out

    def judge(self, hosts: list[bytes], paths: list[bytes], longest: int) -> tuple[list[str | None], list[int]]:
        """The winning rule of each URL, as host and path in one, and its action. No rule's host has more than `longest` bytes."""
        suffixes, owners, asked = {}, [], []
        for host in hosts:
            if host in suffixes:
                continue
            suffixes[host] = []
            start = 0 if len(host) <= longest else host.find(b".", len(host) - longest - 1) + 1 or None
            while start is not None:
                owners.append((host, host[start:]))
                asked.append(host_key(host[start:]))
                start = host.find(b".", start) + 1 or None
        for (host, suffix), lengths in zip(owners, self.find(asked), strict=True):
            if lengths is not None:
                suffixes[host].append((suffix, lengths.tolist()))
        tries = [(len(suffix) + n, len(suffix), row, suffix + path[:n], rule_key(suffix, path[:n]))
                 for row, (host, path) in enumerate(zip(hosts, paths, strict=True)) for suffix, lengths in suffixes[host] for n in lengths if n <= len(path)]
        rules, actions, best = [None] * len(hosts), [ALLOW] * len(hosts), [(-1, -1)] * len(hosts)
        for (size, own, row, text, _), value in zip(tries, self.find([t[-1] for t in tries]), strict=True):
            if value is not None and (size, own) > best[row]:
                best[row], rules[row], actions[row] = (size, own), text.decode(), int(value[0])
        return rules, actions


def keys_of(rules: DataFrame) -> DataFrame:
    """text and values of every key that a table of rules (host, path, action) needs."""
    one = rules.select(F.coalesce("host", F.lit("")).cast("binary").alias("host"), F.coalesce("path", F.lit("")).cast("binary").alias("path"),
                       F.when(F.col("action") == "block", BLOCK).when(F.col("action") == "allow", ALLOW)
                       .otherwise(F.raise_error(F.lit("a rule's action is allow or block"))).cast("long").alias("action"))
    single = one.groupBy("host", "path").agg(F.max("action").alias("action"))
    hosts = single.groupBy("host").agg(F.array_sort(F.collect_set(F.length("path").cast("long"))).alias("values"))  # lengths only, few for any host
    length = F.unhex(F.regexp_replace(F.lpad(F.hex(F.length("host")), 16, "0"), "(..)(..)(..)(..)(..)(..)(..)(..)", "$8$7$6$5$4$3$2$1"))
    return (single.select(F.concat(length, "host", "path").alias("text"), F.array("action").alias("values"))
            .unionByName(hosts.select(F.concat(F.lit("h").cast("binary"), F.col("host")).alias("text"), "values")))


def segments_of(rules: DataFrame, digest: Digest = xxhash.xxh64_intdigest, most: int = SEGMENT_KEYS) -> Iterator[bytes]:
    """The packed segments of a table of rules, in order, one at a time."""
    keys = rows.stage(keys_of(rules))
    count = keys.count()
    flip = np.uint64(1 << 63)  # Spark sorts signed numbers

    def digests(text: pa.Array, values: pa.Array) -> dict:
        made = np.fromiter(map(digest, text.to_pylist()), np.uint64, len(text))
        return {"digest": (made ^ flip).view(np.int64), "text": text, "values": values}

    schema = pa.schema([("digest", pa.int64()), ("text", pa.binary()), ("values", pa.list_(pa.int64()))])
    parts = max(1, -(-count // most))
    dealt = rows.per_batch(keys, schema, digests).repartitionByRange(parts, "digest").sortWithinPartitions("digest", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, schema)
        if table.num_rows:
            made = table["digest"].to_numpy().view(np.uint64) ^ flip
            yield pa.RecordBatch.from_arrays([pa.array([Segment.pack(made, table["text"].to_pylist(), table["values"].to_pylist())], pa.binary())], ["data"])

    packed = rows.stage(dealt.mapInArrow(pack, "data binary").select(F.spark_partition_id().alias("part"), "data"))
    for row in packed.orderBy("part").toLocalIterator():
        yield bytes(row["data"])
    rows.discard(keys, packed)


def share(spark: SparkSession, data: bytes) -> str:
    """Put bytes into the shared folder and have every executor fetch them; the name by which workers find the file."""
    name = f"digests-{uuid.uuid4().hex}"
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    out = where.getFileSystem(context._jsc.hadoopConfiguration()).create(where)
    for start in range(0, len(data), COPY_BYTES):
        out.write(bytearray(data[start:start + COPY_BYTES]))
    out.close()
    context.addFile(where.toString())
    return name


def _mapped(name: str) -> Segment:
    with open(SparkFiles.get(name), "rb") as file:
        return Segment(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of every page under a table of rules (host, path, action)."""
    spark = pages.sparkSession
    ship_package(spark)
    names = [share(spark, data) for data in segments_of(rules)]
    longest = rules.agg(F.coalesce(F.max(F.octet_length("host")), F.lit(0))).first()[0]
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])
    opened = []  # a worker's own copy: mapped at its first batch

    def work(page_id: pa.Array, host: pa.Array, path: pa.Array) -> dict:
        if not opened:
            opened.append(DigestArray([_mapped(name) for name in names]))
        found, actions = opened[0].judge(host.cast(pa.binary()).to_pylist(), path.cast(pa.binary()).to_pylist(), longest)
        return {"page_id": page_id, "host": host, "path": path, "rule": found, "verdict": [VERDICTS[a] for a in actions]}

    host, path = host_and_path(F.col("url"))
    return rows.per_batch(pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")), schema, work)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's URL under RULES."""
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    return judge(spark.read.parquet(f"{folder}/pages.parquet"), rules)


SQL = r"""
WITH r(action, h, p) AS (VALUES """ + ", ".join(f"('{action}', '{host}', '{path}')" for action, host, path in RULES) + r"""),
u AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT k, h || p AS rule, action FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(h || p) DESC, length(h) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM s LEFT JOIN f USING (k)
"""
