"""Exact n-gram Jaccard join by pivots and metric regions.

A document is a point of the Jaccard metric space: the set of its word shingles. Documents with equal sets are one class.
The pivots of the first level are the one-shingle sets: {s} is nearest to the documents that hold s, ties between the pivots
of one document go by a global order, and the region of a pivot holds the documents that may be within the radius of one
whose nearest pivot it is. By the triangle inequality on set sizes a document must be replicated to its first
n - ceil(0.85 n) + 1 pivots for that, and two documents of a region only compare if their sizes allow the radius.

The order puts pivots of large regions last. Documents that still lie in large regions consist of frequent shingles almost
entirely; those regions are joined again, with documents as pivots: centres with the fewest rare shingles. A member is
written as its difference from the centre, the shingles that just one of both has. That gives its distance from the centre
at once, and two members differ in just what one of their differences has. Members not both within the radius of the
centre must share part of their differences then, and only members that meet at such a shared shingle, placed early enough
in both, are compared: again a join on shingles, with those foreign to the centre first. Members of one component are not
compared. Every candidate is verified on its whole sets, so the result is exact; nothing is capped. All tables are one row
per document, shingle of a prefix or a difference, or candidate pair.

Shingles are 63-bit hashes of words, sets are compared by a 128-bit digest; accidental collisions are not resolved.
Null, empty and wordless texts have empty sets, link with nothing and are their own component. Rows that repeat a doc_id
are placed each by its own text. Other columns are left out, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailveil.llm import rows, words
from mailveil.llm.components import components

SHINGLE, PERCENT = 4, 85
#: Members from which a region is large; the part of the shingles that is counted to find large ones ahead; bits of the bitmaps.
LARGE, COUNTED, BITS = 48, 0.35, 24
AROUND = 16

_TOP = np.uint64(1 << 63)


class Sets:
    """The distinct shingles of each text of a column: sorted by row, then by the global order."""

    def __init__(self, text: pa.Array, size: int, late: np.ndarray | None = None):
        hashes, offsets = words.word_hashes(text, words.SPACED)
        counts = np.diff(offsets)
        n = len(counts)
        row = np.repeat(np.arange(n), counts)
        full = words.within(offsets, size)
        values, owner = words.window_hashes(hashes, size)[full], row[: len(full)][full]
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            whole = np.concatenate([words.mix(words.window_hashes(hashes[offsets[k]:offsets[k + 1]], int(counts[k]), seed=50)) for k in short])
            values, owner = np.concatenate([values, whole]), np.concatenate([owner, short])
        values = values >> np.uint64(1)
        if late is not None:
            values = values | np.where(rows.maybe_in(late, values), _TOP, np.uint64(0))
        self._in_text = values, owner
        self._arrange(values, owner, n)

    def _arrange(self, values: np.ndarray, owner: np.ndarray, n: int) -> None:
        order = np.lexsort((values, owner))
        values, owner = values[order], owner[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        self.values, self.owner = values[new], owner[new]
        self.sizes = np.bincount(self.owner, minlength=n)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def only_around(self, marked: np.ndarray, reach: int) -> None:
        """Leave the shingles that stand at most `reach` places from a marked one in the texts."""
        values, owner = self._in_text
        counts = np.concatenate([[0], np.cumsum(rows.maybe_in(marked, values))])
        at = np.arange(len(values))
        close = counts[np.minimum(at + reach + 1, len(values))] > counts[np.maximum(at - reach, 0)]
        self._arrange(values[close], owner[close], len(self.sizes))

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        plain = self.values & ~_TOP
        out = []
        for seed in (1, 2):
            sums = np.zeros(len(plain) + 1, np.uint64)
            np.cumsum(words.mix(plain + np.uint64(seed * 0x51ED270B7A1)), out=sums[1:])
            out.append((sums[self.starts[1:]] - sums[self.starts[:-1]]).view(np.int64))
        return out[0], out[1]

    def lists(self, keep: np.ndarray) -> pa.Array:
        kept = np.concatenate([[0], np.cumsum(keep)])[self.starts]
        return pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), pa.array(self.values[keep].view(np.int64)))


def least_shared(size: Column, percent: int) -> Column:
    """How many of its shingles a set of this size shares with any other in the radius: ceil(percent * size / 100)."""
    return F.floor((size * percent + 99) / 100)


def frequent(docs: DataFrame, size: int, large: int) -> np.ndarray:
    """A bitmap of shingles that at least `large` documents hold.

    First those of a part of the hash range are counted, then the others that stand near one of those found: passages that
    many documents share are long. Any set of shingles may come late in the order, so what is missed costs time only.
    """
    limit = np.uint64(int(COUNTED * 2.0**63))

    def counting(found: np.ndarray | None) -> DataFrame:
        def work(text):
            sets = Sets(text, size)
            if found is None:
                wanted = sets.values[sets.values < limit]
            else:
                sets.only_around(found, AROUND)
                wanted = sets.values[sets.values >= limit]
            values, counts = np.unique(wanted, return_counts=True)
            return {"s": values.view(np.int64), "n": counts}

        counted = rows.per_batch(docs.select("text"), pa.schema([("s", pa.int64()), ("n", pa.int64())]), work)
        return counted.groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= large)

    found = rows.bitmap(docs.sparkSession, counting(None), "s", BITS)
    rows.release(docs.sparkSession)
    return found | rows.bitmap(docs.sparkSession, counting(found), "s", BITS)


PLACED = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64()), ("n_late", pa.int32()), ("pivots", pa.list_(pa.int64()))])


def placed(docs: DataFrame, size: int, percent: int, late: np.ndarray) -> DataFrame:
    """doc_id, set size, digest, the pivots whose regions a document belongs to, and how many of them come late."""

    def work(doc_id, text):
        sets = Sets(text, size, late)
        n = sets.sizes
        reach = n - (n * percent + 99) // 100 + 1
        keep = np.arange(len(sets.values)) - sets.starts[sets.owner] < reach[sets.owner]
        late_kept = np.bincount(sets.owner[keep & (sets.values >= _TOP)], minlength=len(n))
        d1, d2 = sets.digests()
        return {"doc_id": doc_id, "n": n.astype(np.int32), "d1": d1, "d2": d2, "n_late": late_kept.astype(np.int32), "pivots": sets.lists(keep)}

    return rows.per_batch(docs.select("doc_id", "text"), PLACED, work)


HELD = pa.schema([("doc_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def whole_sets(docs: DataFrame, wanted: DataFrame, size: int, late: np.ndarray) -> DataFrame:
    """c and shingles of the wanted classes (c, doc_id, d1, d2), read from the texts again."""
    asked = rows.bitmap(docs.sparkSession, wanted.select(F.xxhash64("doc_id").alias("h")), "h", BITS)

    def work(key, doc_id, text):
        mine = rows.maybe_in(asked, key.to_numpy(zero_copy_only=False).view(np.uint64))
        text, doc_id = text.filter(pa.array(mine)), doc_id.filter(pa.array(mine))
        sets = Sets(text, size, late)
        d1, d2 = sets.digests()
        return {"doc_id": doc_id, "d1": d1, "d2": d2, "shingles": sets.lists(np.ones(len(sets.values), bool))}

    held = rows.per_batch(docs.where(F.col("doc_id").isNotNull()).select(F.xxhash64("doc_id"), "doc_id", "text"), HELD, work)
    key = ["doc_id", "d1", "d2"]
    return held.groupBy(*key).agg(F.first("shingles").alias("shingles")).join(wanted, key).select("c", "shingles")


def linked(shared: Column, both: Column, percent: int) -> Column:
    """Whether sets of `both` shingles together, so many of them shared, are within the radius."""
    return shared * 100 >= (both - shared) * percent


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the candidate pairs (a, b) whose whole sets are within the radius, with the number of shared shingles."""
    first, second = sets.select(F.col("c").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("c").alias("b"), F.col("shingles").alias("y"))
    shared = pairs.join(first, "a").join(second, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), (F.size("x") + F.size("y")).alias("both"))
    return rows.stage(shared.where(linked(F.col("shared"), F.col("both"), percent)).select("a", "b", "shared"))


def may_link(shared: Column, percent: int) -> Column:
    """Whether so many shared pivots leave room for the radius: all others come from what lies beyond the pivots of one side."""
    n = F.col("na") + F.col("nb")
    beyond = F.greatest(least_shared(F.col("na"), percent), least_shared(F.col("nb"), percent)) - 1
    return (shared + beyond) * (100 + percent) >= n * percent


def jaccard_links(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """The documents with their classes (doc_id, n, c) and links that connect just what all links connect (a, b, shared).

    Classes without shingles have a null c. Copies within a class are linked by it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    late = frequent(docs, size, large)
    digest = ["d1", "d2", "n"]
    while True:
        place = rows.stage(placed(docs, size, percent, late))
        classes = rows.stage(place.where(F.col("n") > 0).groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.first("n_late").alias("n_late"), F.first("pivots").alias("pivots"))
                             .where(F.col("rep").isNotNull()).withColumn("c", F.monotonically_increasing_id()))
        member = classes.select("c", "n", "n_late", F.explode("pivots").alias("s"))
        inside = rows.stage(member.where(F.col("s") >= 0).withColumn("m", F.count("*").over(Window.partitionBy("s"))).where(F.col("m") > 1))
        if inside.where(F.col("m") > large).isEmpty():
            break
        # These pivots go to the end of the order too.
        late = late | rows.bitmap(docs.sparkSession, inside.where(F.col("m") > large // 2).select("s").distinct(), "s", BITS)
        rows.discard(place, classes, inside)

    one, two = (inside.select("s", *(F.col(k).alias(k + x) for k in ("c", "n", "n_late"))) for x in "ab")
    near = (one.join(two, "s").where((F.col("ca") < F.col("cb")) & (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent))
            .groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.count("*").alias("k"), *(F.first(k).alias(k) for k in ("na", "nb", "n_latea", "n_lateb"))))
    near = near.where(may_link(F.col("k") + F.least("n_latea", "n_lateb"), percent)).select("a", "b")

    # What is late in a member's pivots, and the centres of those regions: the members with the fewest rare shingles.
    near = rows.stage(near)
    rare = (F.floor((F.col("n") * (100 - percent)) / 100) + 1 - F.col("n_late")).cast("int").alias("rare")
    region = classes.where(F.col("n_late") > 0).select("c", "n", rare, F.explode(F.filter("pivots", lambda s: s < 0)).alias("s"))
    centre = region.groupBy("s").agg(F.min(F.struct("rare", "c", "n")).alias("best"))
    crowd = rows.stage(region.join(centre, "s").select("c", "n", F.col("best.c").alias("centre"), F.col("best.n").alias("nc")).distinct())
    wanted = near.select(F.col("a").alias("c")).union(near.select(F.col("b").alias("c"))).union(crowd.select("c")).distinct()
    sets = rows.stage(whole_sets(docs, rows.stage(wanted.join(classes.select("c", F.col("rep").alias("doc_id"), "d1", "d2"), "c")), size, late))
    links = verified(near, sets, percent)
    if not crowd.isEmpty():
        links = _around(crowd, links, sets, percent)
    copies = place.select("doc_id", *digest).join(classes.select("c", *digest), digest, "left").select("doc_id", "n", "c")
    return copies, links


def _around(crowd: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links, those of members of large regions with their centres, and those left between different components there.

    A member's difference x from its centre holds what just one of both has, what the centre lacks first and what many
    documents hold after the rest of it. Members a and b share (na + nb - xa - xb) / 2 shingles and those that both
    differences have. If they need none of the latter, both are within the radius of the centre and in its component.
    """
    mine, centres = sets.select("c", F.col("shingles").alias("own")), sets.select(F.col("c").alias("centre"), F.col("shingles").alias("of_centre"))

    def ordered(x: Column, y: Column) -> Column:
        return F.array_sort(F.transform(F.array_except(x, y), lambda s: s.bitwiseXOR(F.lit(-(1 << 63)))))

    difference = F.concat(ordered(F.col("own"), F.col("of_centre")), ordered(F.col("of_centre"), F.col("own")))
    differing = rows.stage(crowd.join(mine, "c").join(centres, "centre").select("c", "n", "centre", "nc", difference.alias("difference")).withColumn("x", F.size("difference")))
    both = F.col("n") + F.col("nc")
    shared = ((both - F.col("x")) / 2).cast("int")
    star = (differing.where((F.col("c") != F.col("centre")) & linked(shared, both, percent))
            .select(F.least("c", "centre").alias("a"), F.greatest("c", "centre").alias("b"), shared.alias("shared")).distinct())
    links = rows.stage(links.unionByName(star))

    found = components(links.select("a", "b")).withColumnRenamed("node", "c")
    known = rows.stage(crowd.select("c", "centre").join(found, "c", "left").select("c", "centre", F.coalesce("root", "c").alias("root")))
    sizes = known.groupBy("centre", "root").agg(F.count("*").alias("m"))
    main = sizes.groupBy("centre").agg(F.max(F.struct("m", "root")).alias("top"), F.count("*").alias("parts")).where(F.col("parts") > 1)
    apart = rows.stage(known.join(main.select("centre", F.col("top.root").alias("main")), "centre"))
    at = rows.stage(differing.join(apart, ["c", "centre"]).select("c", "centre", "root", "main", "n", "x", F.posexplode("difference").alias("pos", "s")))

    one, two = (at.select("centre", "s", "main", *(F.col(k).alias(k + x) for k in ("c", "n", "x", "root", "pos"))) for x in "ab")
    one, two = one.where(F.col("roota") != F.col("main")), two.drop("main")
    n, x = F.col("na") + F.col("nb"), F.col("xa") + F.col("xb")
    need = F.ceil((2 * percent * n - (100 + percent) * (n - x)) / (2 * (100 + percent)))
    meet = ((F.col("roota") != F.col("rootb")) & ((F.col("rootb") == F.col("main")) | (F.col("ca") < F.col("cb")))
            & (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
            & (F.col("posa") <= F.col("xa") - need) & (F.col("posb") <= F.col("xb") - need))
    met = one.join(two, ["centre", "s"]).where(meet).select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
    return links.unionByName(verified(rows.stage(met), sets, percent))


def groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, large: int = LARGE) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id reachable by links, for every row of `docs`."""
    members, links = jaccard_links(docs, size, percent, large)
    members = rows.stage(members)
    found = components(links.select("a", "b")).withColumnRenamed("node", "c")
    rooted = members.join(found, "c", "left").withColumn("root", F.coalesce("root", "c"))
    # Staged, so that no aggregate's partitioning keeps Spark from splitting a large component in the join.
    least = rows.stage(rooted.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("least")))
    return (rooted.join(least, "root", "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every document."""
    return groups(rows.documents(spark, folder))


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs`, all columns, with one document of each component: the one with its smallest doc_id.

    An id that several texts bear stays if it is the smallest of any of their components; rows with equal id and text are
    one. Rows without an id stay.
    """
    found = rows.stage(groups(docs, size, percent))
    per_id = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("m"), F.max(F.col("component_id") == F.col("doc_id")).alias("stays"))
    gone = rows.stage(per_id.where(~F.col("stays")).select("doc_id"))
    repeated = rows.stage(per_id.where(F.col("m") > 1).select("doc_id"))
    left = docs.join(gone, "doc_id", "left_anti")
    return (left.join(repeated, "doc_id", "left_anti").unionByName(left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(docs.columns))
