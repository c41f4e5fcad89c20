"""Source divergence audit: how the word shares of each source differ from those of its peers in a language.

Gustavson's row accumulation. The index is term-major: a row for each kept (lang, term) with its postings (source, count). Blocks
of terms go through tasks; there each source, as a row, scatters its terms through the postings of the block into a dense
accumulator with one cell for each peer. So a task emits one sum for each pair of sources, never a row for each pair of postings.

A term that a source lacks still has a share there, its zero baseline z. Let f be the difference of two shares. A block's sum
over all kept terms, of source g against peer h, is that of the baselines alone, f(zg, zh) for each kept term, plus corrections:
f(p, zh) - f(zg, zh) for each of g's terms, taken for each distinct count at once; the same for h's; and for terms of both, which
the scatter finds, f(p, q) - f(p, zh) - f(zg, q) + f(zg, zh). Everything is in 64-bit integers: shares stay below 2**31, and
so do sums of differences, which are at most the sums of shares.

Sources of a language are cut into tiles of `TILE`; a task accumulates one pair of tiles over one block of terms, so its memory
has a bound. A block has at least as many postings as its tiles have cells, so the sums never outnumber the postings. Words are counted in Python for each batch and flushed when the counts get large; Spark adds them up. Nothing is
collected; only counts of rows come to the driver. Small tables are broadcast by Spark's own measure of their staged size.

Null text, lang and source count as ''. A row is a document, repeated ids are not merged; doc_id and other columns are never
read. Texts of any length are counted in pieces. Languages without kept terms have pairs of value 0 and no terms; empty tables
give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailveil.llm import rows
from mailveil.session import ship_package

SCALE, ADDED, LEAST_DOCUMENTS, TOP = 1_000_000_000, 2, 10, 10
#: Sources that a task accumulates against as many others; least postings of a block; distinct counts held before they are flushed.
TILE, BLOCK_POSTINGS, FLUSH = 512, 16_000, 400_000
PIECE = 1 << 22

#: A-Z in lower case, what is neither a letter nor part of a longer character as a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, occurrences and documents, in parts that are to be added up."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("documents", pa.int64())])
    ship_package(docs.sparkSession)
    piece_bytes, most = PIECE, FLUSH

    def pieces(text: bytes) -> Iterator[list[bytes]]:
        """The terms of a text, a few megabytes at a time, cut between terms."""
        text, start = text.translate(_LETTERS), 0
        while start < len(text):
            stop = len(text) if len(text) - start <= piece_bytes else text.find(b" ", start + piece_bytes)
            stop = len(text) if stop < 0 else stop
            yield text[start:stop].split(b" ")
            start = stop

    def flush(counts: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, documents) in counts.items():
            n.pop(b"", None)
            terms = list(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()),
                                              pa.array(list(n.values()), pa.int64()), pa.array([documents[t] for t in terms], pa.int64())], schema=schema)
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, size = {}, 0
        for batch in batches:
            for piece in rows.slices(batch):
                for lang, source, text in zip(*(c.to_pylist() for c in piece.columns[:2]), piece.column(2).cast(pa.binary()).to_pylist(), strict=True):
                    if (lang, source) not in counts:
                        counts[lang, source] = Counter(), Counter()
                    n, documents = counts[lang, source]
                    before, seen = len(n), set()
                    for terms in pieces(text):
                        n.update(terms)
                        seen.update(terms)
                    documents.update(seen)
                    size += len(n) - before
                    if size > most:
                        yield from flush(counts)
                        size = 0
        yield from flush(counts)
        rows.give_back()

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")), text).mapInArrow(run, "lang string, source string, term string, n long, documents long")


def index(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """The term-major index, staged: lang, term, n and postings (source, n) of the terms in at least so many documents of a language."""
    merged = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    return rows.stage(merged.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("postings"))
                      .where(F.col("documents") >= least).select("lang", "term", "n", "postings"))


def share(count: str, total: str, kept: str) -> str:
    """SQL of 1 + floor(SCALE * (count + ADDED) / (total + ADDED * kept)): long division, three digits at a time, so no product leaves 64 bits."""
    whole = f"({total} + {ADDED} * {kept})"
    one = f"(1000 * ({count} + {ADDED}))"
    two = f"(1000 * ({one} % {whole}))"
    three = f"(1000 * ({two} % {whole}))"
    return f"(1 + 1000000 * ({one} div {whole}) + 1000 * ({two} div {whole}) + ({three} div {whole}))"


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def sources(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """A row for each occurring lang and source, staged: its number and tile in the language, total count, zero baseline and the language's figures."""
    every = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    totals = terms.select("lang", F.explode("postings").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("total"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"), F.sum(F.size("postings")).alias("postings"))
    in_lang = Window.partitionBy("lang")
    return rows.stage(every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
                      .withColumn("number", F.row_number().over(in_lang.orderBy("source")) - 1).withColumn("peers", F.count("*").over(in_lang))
                      .withColumn("zero", F.expr(f"if(kept = 0, 1, {share('0L', 'total', 'kept')})"))
                      .withColumn("tile", F.expr(f"cast(number div {TILE} as int)")).withColumn("tiles", F.expr(f"cast((peers - 1) div {TILE} + 1 as int)"))
                      .withColumn("cells", F.pow(F.least("peers", F.lit(TILE)), 2).cast("long"))
                      .withColumn("blocks", F.expr(f"cast(greatest(1, postings div greatest({BLOCK_POSTINGS}, cells)) as int)")))


def accumulate(postings: pa.Table, peers: pa.Table, first: int, second: int, block: int) -> pa.Table:
    """The sums of one block of terms between the sources of two tiles: postings (term, number, tile, p), peers (source, number, tile, zero, kept)."""
    f = difference
    tile, number, zero = (peers[c].to_numpy().astype(np.int64) for c in ("tile", "number", "zero"))
    sides = [np.flatnonzero(tile == t) for t in (first, second)]
    sides = [s[np.argsort(number[s])] for s in sides]
    z = [zero[s] for s in sides]
    term = postings["term"].combine_chunks().dictionary_encode()
    term, owner, at, p = term.indices.to_numpy().astype(np.int64), *(postings[c].to_numpy() for c in ("number", "tile", "p"))
    of = []  # each side's postings: term, place among the side's sources, p
    for t, side in zip((first, second), sides, strict=True):
        mine = np.flatnonzero(at == t)
        of.append((term[mine], np.searchsorted(number[side], owner[mine]), p[mine]))
    sums = np.zeros((len(sides[0]), len(sides[1])), np.int64)
    if block == 0 and peers.num_rows:
        sums += int(peers["kept"][0].as_py()) * f(z[0][:, None], z[1][None, :])

    for k, (_, place, shares) in enumerate(of):  # every term against the peers' zero baselines, once for each distinct share
        for g in np.unique(place):
            values, times = np.unique(shares[place == g], return_counts=True)
            row = np.zeros(len(z[1 - k]), np.int64)
            for start in range(0, len(values), 1024):
                row += (times[start:start + 1024, None] * (f(values[start:start + 1024, None], z[1 - k][None, :]) - f(z[k][g], z[1 - k])[None, :])).sum(0)
            if k == 0:
                sums[g] += row
            else:
                sums[:, g] += row

    terms, places, shares = of[1]  # the second side's postings, term by term
    order = np.argsort(terms, kind="stable")
    places, shares = places[order], shares[order]
    starts = np.searchsorted(terms[order], np.arange(term.max(initial=-1) + 2))
    for g in np.unique(of[0][1]):  # a source scatters its terms through them
        mine = of[0][1] == g
        from_, length = starts[of[0][0][mine]], starts[of[0][0][mine] + 1] - starts[of[0][0][mine]]
        at = np.repeat(from_ - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        own, q, h, base = np.repeat(of[0][2][mine], length), shares[at], places[at], z[0][g]
        np.add.at(sums[g], h, f(own, q) - f(own, z[1][h]) - f(base, q) + f(base, z[1][h]))

    names = peers["source"].combine_chunks()
    g, h = (x.ravel() for x in np.meshgrid(*sides, indexing="ij"))
    value, apart = sums.ravel(), g != h
    g, h, value = g[apart], h[apart], value[apart]
    if first != second:
        g, h, value = np.concatenate([g, h]), np.concatenate([h, g]), np.concatenate([value, value])
    return pa.table({"source": names.take(pa.array(g)), "item": names.take(pa.array(h)), "value": pa.array(value, pa.int64())})


def pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item and value of every two sources of a language: postings have lang, term, number, p, tile, tiles and blocks."""

    def tiled(df: DataFrame) -> DataFrame:
        """A row for each pair of tiles that its tile is in."""
        return df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumn("first", F.least("tile", "other")).withColumn("second", F.greatest("tile", "other"))

    key = ["lang", "first", "second", "block"]
    left = tiled(postings.withColumn("block", F.expr("cast(pmod(xxhash64(term), blocks) as int)"))).select(*key, "term", "number", "tile", "p")
    right = tiled(groups.toDF(*groups.columns).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))).select(*key, "source", "number", "tile", "zero", "kept")
    ship_package(groups.sparkSession)

    def work(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        lang, first, second, block = (x.as_py() for x in key)
        made = accumulate(left, right, first, second, block)
        return pa.table([pa.array([lang] * made.num_rows, pa.string()), *made.columns], ["lang", *made.column_names])

    parts = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(work, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: each source's divergence from all peers, and the terms it favours most over its language."""
    terms = index(docs, least)
    groups = sources(docs, terms)
    flat = (terms.select("lang", "term", F.col("n").alias("lang_n"), F.explode("postings").alias("x")).select("lang", "term", "lang_n", F.col("x.source").alias("source"), F.col("x.n").alias("n"))
            .join(groups.drop("zero", "peers", "cells", "postings"), ["lang", "source"]).withColumn("p", F.expr(share("n", "total", "kept"))))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    peers = pairs(flat, groups).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(ranked))
    favoured = (flat.withColumn("q", F.expr(share("lang_n", "lang_total", "kept"))).where("p > q")
                .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
                .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return peers.select(columns).unionByName(favoured.select(columns))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """All documents: every two sources of a language, and ten terms of each source."""
    return audit(rows.documents(spark, folder))


SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS MATERIALIZED (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
l AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
c AS MATERIALIZED (SELECT t.lang, source, term, count(*) AS n FROM t JOIN l USING (lang, term) GROUP BY t.lang, source, term),
v AS MATERIALIZED (SELECT lang, count(*) AS v, sum(n) AS total FROM l GROUP BY lang),
g AS MATERIALIZED (SELECT s.lang, s.source, coalesce(v.v, 0) AS v, v.total AS lang_total, coalesce(sum(c.n), 0) AS total
    FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN v USING (lang) LEFT JOIN c ON s.lang = c.lang AND s.source = c.source GROUP BY s.lang, s.source, v.v, v.total),
p AS MATERIALIZED (SELECT g.lang, g.source, l.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * g.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (l.n + 2)) // (g.lang_total + 2 * g.v)::HUGEINT AS q
    FROM g JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every
QUALIFY part = 'pair' OR rank <= 10
"""
