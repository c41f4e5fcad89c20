"""Vector code compression: product quantisation in whole numbers, with distances taken in the Walsh-Hadamard domain.

Components become floor(SCALE * x). A vector is cut into PARTS parts, each of which gets the index of the nearest of ENTRIES
entries of its position's codebook. Parts and entries are padded with zeros to a power of two and transformed by the integer
Walsh-Hadamard matrix H, rows in order of sequency. As H'H = w I, the squared distance is the sum of squared differences of
coefficients over w, exactly. The sum is run up coefficient by coefficient, low sequencies first; an entry goes as soon as
its sum exceeds the full distance of another entry of that part, so ties are never cut and the lowest index keeps them.

Codebooks start as the parts of the first ENTRIES vectors by vec_id. Each round adds up, in every task, what its entries hold;
the sums of at most PARTS * ENTRIES * (width + 1) cells come to the driver, whatever the data. A round is a pass over the input
columns; nothing is shuffled but those sums. Numbers beyond 64 bits, as huge components make them, are Python integers on the
same way; sums travel in limbs of 40 bits.

Rows whose vector is null or holds null, NaN or infinite components are left out. Rows that repeat a vec_id all count; starting
entries order them by their components; a null vec_id comes last. Fewer rows than ENTRIES make shorter codebooks. The length of
vectors is that of the first one; it is padded with zeros to a multiple of PARTS. A vector of another length keeps its row
with a null code and error and takes part in nothing. An error over 2**63 - 1 is null; a label's error is the sum
of those that are known, or null if there are none or the sum is over that limit. Empty tables give no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailveil.llm import rows
from mailveil.session import ship_package

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LIMB = 40
CHUNK = 2048


def walsh(width: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of a power of two, rows by number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < width:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((np.diff(h, axis=1) != 0).sum(1), kind="stable")]


def transform(parts: np.ndarray) -> np.ndarray:
    """Coefficients of parts (..., width), padded with zeros to the next power of two."""
    width = parts.shape[-1]
    return parts @ walsh(1 << max(0, width - 1).bit_length())[:, :width].T.astype(parts.dtype)


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite numbers: 64-bit where no distance can leave 64 bits, Python integers otherwise."""
    width = -(-vectors.shape[1] // PARTS)
    safe = 2.0 ** 30 / max(1, 1 << max(0, width - 1).bit_length())  # differences of coefficients stay below 2**31 / sqrt(width)
    if not vectors.size or np.abs(vectors).max() * SCALE < safe:
        return np.floor(vectors * SCALE).astype(np.int64)
    return np.array([[int(x) * SCALE if abs(x) >= 2.0 ** 52 else int(np.floor(x * SCALE)) for x in row] for row in vectors.tolist()], object)


def split(whole: np.ndarray) -> np.ndarray:
    """(rows, PARTS, width): consecutive parts of padded vectors."""
    width = -(-whole.shape[1] // PARTS)
    padded = np.zeros((len(whole), PARTS * width), whole.dtype)
    padded[:, :whole.shape[1]] = whole
    return padded.reshape(len(whole), PARTS, width)


def nearest(coefficients: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part and its squared distance, both given by coefficients (rows, w) and (entries, w)."""
    n, w = coefficients.shape
    picked, distance = np.zeros(n, np.int64), np.zeros(n, coefficients.dtype)
    for start in range(0, n, CHUNK):
        x = coefficients[start:start + CHUNK]
        part, entry = (i.ravel() for i in np.indices((len(x), len(entries))))
        run = np.zeros(len(part), x.dtype)
        bound = None
        for k in range(w):
            run = run + (x[part, k] - entries[entry, k]) ** 2
            if k + 1 == w or bound is not None and len(part) == len(x):
                continue
            # the entry that leads so far, measured in full: what has already run beyond that cannot be nearest
            lead = _leaders(part, run, len(x))
            full = ((x - entries[entry[lead]]) ** 2).sum(1)
            bound = full if bound is None else np.minimum(bound, full)
            stays = run <= bound[part]
            part, entry, run = part[stays], entry[stays], run[stays]
        lead = _leaders(part, run, len(x))
        picked[start:start + CHUNK], distance[start:start + CHUNK] = entry[lead], run[lead]
    return picked, distance // w


def _leaders(part: np.ndarray, run: np.ndarray, n: int) -> np.ndarray:
    """For each part the place of its smallest sum, the first of equals; candidates come part by part, entries ascending."""
    starts = np.searchsorted(part, np.arange(n))
    least = np.minimum.reduceat(run, starts)
    hits = np.flatnonzero(run == least[part])
    return hits[np.searchsorted(part[hits], np.arange(n))]


def usable(table: DataFrame) -> DataFrame:
    """vec_id, vector and label of the rows whose vectors are whole."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"), F.col("label").alias("label")).where(F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)))


def _matrix(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors of the given length, and these vectors."""
    lengths = np.diff(vectors.offsets.to_numpy())
    fits = np.flatnonzero(lengths == size)
    flat = vectors.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
    return fits, flat.reshape(len(fits), size)


def codebooks(kept: DataFrame, size: int, start: np.ndarray) -> list[np.ndarray]:
    """The entries of each part position after ROUNDS rounds, from the first vectors (rows, PARTS, width)."""
    ship_package(kept.sparkSession)
    books = [start[:, p] for p in range(PARTS)]
    width = start.shape[2]
    schema = pa.schema([("cell", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())])

    def one_round(books: list[np.ndarray]) -> list[np.ndarray]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((PARTS, len(books[0]), width + 1), object)
            for batch in batches:
                _, vectors = _matrix(batch.column(0), size)
                for begin in range(0, len(vectors), 1 << 14):
                    parts = split(whole_numbers(vectors[begin:begin + (1 << 14)]))
                    for p in range(PARTS):
                        picked, _ = assign(parts[:, p], books[p])
                        for e in np.unique(picked):
                            mine = parts[picked == e, p]
                            sums[p, e, :width] += mine.sum(0)
                            sums[p, e, width] += len(mine)
            cells = [(c, value) for c, value in enumerate(sums.ravel()) if value]
            flat = [(c, k, limb) for c, value in cells for k, limb in limbs(int(value))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in flat], schema.field(k).type) for k in range(3)], schema=schema)

        merged = kept.select("vector").mapInArrow(work, "cell int, limb int, value long").groupBy("cell", "limb").agg(F.sum("value").alias("value")).collect()
        sums = np.zeros(PARTS * len(books[0]) * (width + 1), object)
        for cell, limb, value in merged:
            sums[cell] += value << (LIMB * limb)
        sums = sums.reshape(PARTS, len(books[0]), width + 1)
        return [as_small(np.array([[s // row[width] for s in row[:width]] if row[width] else list(old) for row, old in zip(sums[p], books[p], strict=True)], object)) for p in range(PARTS)]

    for _ in range(ROUNDS):
        books = one_round(books)
    return books


def limbs(value: int) -> Iterator[tuple[int, int]]:
    """A number as limbs of LIMB bits, the last one signed; equal places of many numbers may be added up."""
    k = 0
    while not -(1 << LIMB) <= value < 1 << LIMB:
        yield k, value & ((1 << LIMB) - 1)
        value >>= LIMB
        k += 1
    yield k, value


def as_small(numbers: np.ndarray) -> np.ndarray:
    """64-bit integers if all are far from the limit."""
    width = 1 << max(0, numbers.shape[-1] - 1).bit_length()
    return numbers.astype(np.int64) if all(abs(x) < 2 ** 30 // width for x in numbers.ravel()) else numbers


def assign(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (rows, width) and its squared distance."""
    if parts.dtype != entries.dtype:
        parts, entries = parts.astype(object), entries.astype(object)
    return nearest(transform(parts), transform(entries))


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def compress(table: DataFrame) -> DataFrame:
    """vec_id, code, error, label, label_error and codebooks_sha256 of every row with a whole vector: table has vec_id, embedding and label."""
    kept = usable(table)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vec_id", "vector").limit(1).collect()
    size = len(first[0]["vector"]) if first else 0
    start = kept.where(F.size("vector") == size).orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(ENTRIES).collect()
    begin = split(whole_numbers(np.array([r["vector"] for r in start], float).reshape(len(start), size)))
    books = [as_small(b.astype(object)) for b in codebooks(kept, size, begin)] if start else []
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])

    def work(vec_id: pa.Array, vector: pa.Array, label: pa.Array) -> dict:
        fits, vectors = _matrix(vector, size)
        code, error = np.full(len(vector), None, object), np.full(len(vector), None, object)
        if len(fits):
            parts = split(whole_numbers(vectors))
            picked, distance = zip(*(assign(parts[:, p], books[p]) for p in range(PARTS)), strict=True)
            code[fits] = [bytes(row).hex() for row in np.stack(picked, 1).astype(np.uint8)]
            error[fits] = sum(d.astype(object) for d in distance)
        return {"vec_id": vec_id, "label": label, "code": code, "error": pa.array([e if e is not None and e < 1 << 63 else None for e in error], pa.int64())}

    coded = rows.stage(rows.per_batch(kept.select("vec_id", "vector", F.col("label").cast("string")), schema, work))
    labels = rows.stage(coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))).withColumnRenamed("label", "of")
    total = F.expr("if(total < 9223372036854775808, cast(total as long), null)")
    return (coded.join(labels, F.col("label").eqNullSafe(F.col("of")), "left")
            .select("vec_id", "code", "error", total.alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256")))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings, compressed."""
    return compress(spark.read.parquet(f"{folder}/embeddings.parquet"))


def _sql() -> str:
    assigned = """a{k} AS MATERIALIZED (SELECT r, part, e, v, d FROM (SELECT x.r, x.part, x.v, b.e,
    list_sum(list_transform(list_zip(x.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN b{k} b USING (part)) QUALIFY row_number() OVER (PARTITION BY r, part ORDER BY d, e) = 1)"""
    moved = """b{n} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT part, e, list(CAST(floor_sum AS BIGINT) ORDER BY i) AS c FROM (
    SELECT part, e, i, (sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_sum FROM a{k}, range(1, 1 + len(v)) s(i) GROUP BY part, e, i) GROUP BY part, e) m USING (part, e))"""
    steps = [text.format(k=k, n=k + 1) for k in range(ROUNDS) for text in (assigned, moved)] + [assigned.format(k=ROUNDS)]
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS v FROM k, range({PARTS}) p(part)),
b0 AS MATERIALIZED (SELECT part, r - 1 AS e, v AS c FROM x WHERE r <= {ENTRIES}),
""" + ",\n".join(steps) + f""",
c AS (SELECT r, lower(string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY part)) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN c USING (r), h
"""


SQL = _sql()
