"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A window (a word between spaces, in lower
case) is compressed with each; its gain is how many bytes fewer the toxic dictionary needs. It is written `TIMES` times in a
row for that: a single short word would be stored as it is, whatever a dictionary knows of it, while its copies cost the
same few bytes with either. Both dictionaries are used as plain content, so that words neither knows cost the same. Windows whose gain reaches
calibrated thresholds are hits, and a calibrated logistic curve of the number and share of hits gives the score.

Toxic documents consist of ordinary words for the most part, so their windows are contrasted first: byte runs of `GRAMS`
that occur in a far larger share of the toxic training documents than of the others are kept, and the toxic dictionary is
trained on the stretches of windows that those runs cover, the ordinary one on windows without them. Training reads at most `SAMPLE` labelled rows; scoring reads
every text whole. Empty, null and wordless texts have no hits and get the curve's value there. Rows that repeat an id are
scored each for itself; other columns are left out. If no label is 1, nothing is a hit.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailveil.llm import rows

SAMPLE, FOLDS, CUT = 16_000, 5, 0.5
GRAMS, CONTRAST, LEAST_DOCS, LEAST_SHARE = (5, 8, 11), 8.0, 4, 0.02
TIMES = 8
#: Thresholds of the gain that the curve weighs, and the one whose share of all windows it weighs too.
GAINS, SHARED = range(1, 8), 3
#: Bounds of what training brings to the driver: runs, and different windows of each kind.
RUNS, WINDOWS = 8192, 30_000
ORDINARY_BYTES, TOXIC_BYTES = 1 << 19, 1 << 17
#: Text bytes whose runs or windows are counted at once: a byte gives up to three different runs, each an object of its own.
COUNTED_BYTES = 1 << 18


def windows(text: str) -> list[bytes]:
    return [b" " + w + b" " for w in text.lower().encode().split()]


def runs(window: bytes) -> list[bytes]:
    return [window[k:k + size] for size in GRAMS for k in range(len(window) - size + 1)]


def stretches(window: bytes, wanted: set[bytes]) -> list[bytes]:
    """The parts of a window that wanted runs cover."""
    out, end = [], 0
    for begin, stop in sorted((k, k + size) for size in GRAMS for k in range(len(window) - size + 1) if window[k:k + size] in wanted):
        if out and begin <= end:
            end = max(end, stop)
            out[-1] = (out[-1][0], end)
        else:
            end = stop
            out.append((begin, stop))
    return [window[a:b] for a, b in out]


@dataclass
class Model:
    """The two dictionaries, and the curve's weights of the hits at each threshold, the share of hits, and 1."""

    ordinary: bytes
    toxic: bytes
    curve: tuple[float, ...] = (0.0,) * (len(GAINS) + 2)

    @cached_property
    def _pair(self):
        import zstandard as zs

        settings = zs.ZstdCompressionParameters(
            window_log=20, hash_log=17, chain_log=17, search_log=5, min_match=4, strategy=zs.STRATEGY_LAZY2,
            format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        pair = []
        for content in (self.ordinary, self.toxic):
            dictionary = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(compression_params=settings)
            pair.append(zs.ZstdCompressor(dict_data=dictionary, compression_params=settings))
        return pair

    def gain(self, window: bytes) -> int:
        ordinary, toxic = self._pair
        window *= TIMES
        return len(ordinary.compress(window)) - len(toxic.compress(window))

    def gains(self, texts: list[str]) -> list[list[int]]:
        """The positive gains of each text's windows; every different window is compressed once."""
        if not self.toxic:
            return [[] for _ in texts]
        split = [windows(t) for t in texts]
        known = {w: g for w in set().union(*split) if (g := self.gain(w)) > 0}
        return [[] if known.keys().isdisjoint(ws) else [known[w] for w in ws if w in known] for ws in split]

    def score(self, texts: list[str]) -> np.ndarray:
        features = shape(self.gains(texts), [len(t.split()) for t in texts])
        return rows.sigmoid(features @ np.array(self.curve[:-1]) + self.curve[-1])


def shape(gains: list[list[int]], words: list[int]) -> np.ndarray:
    """What the curve weighs: hits at each threshold and the share of hits, on logarithmic scales."""
    out = np.zeros((len(gains), len(GAINS) + 1))
    for row, (found, n) in enumerate(zip(gains, words, strict=True)):
        if found:
            out[row, :-1] = [sum(g >= least for g in found) for least in GAINS]
            out[row, -1] = 1000 * out[row, SHARED - GAINS[0]] / max(1, n)
    return np.log1p(out)


def _dictionary(samples: dict[bytes, int], size: int) -> bytes:
    """A dictionary trained on the samples; samples that fit it whole, or are too few to train on, are its content themselves."""
    import zstandard as zs

    ordered = sorted(samples, key=lambda s: (samples[s], s))
    if sum(map(len, ordered)) <= size:
        return b"".join(ordered)
    try:
        return zs.train_dictionary(size, [s for s in ordered for _ in range(min(samples[s], 50))], k=32, d=6, threads=0).as_bytes()
    except zs.ZstdError:
        return b"".join(ordered)[-size:]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit both dictionaries and the calibration on at most `sample` labelled rows of the training folds."""
    chosen = rows.labelled_sample(docs, labels, "toxic", rows.fold("doc_id", FOLDS) == 0, sample)
    sizes = {r["label"]: r["count"] for r in chosen.groupBy("label").count().collect()}
    if not sizes.get(1):
        return Model(b"", b"")

    def count_runs(text, label):
        found: list[Counter] = [Counter(), Counter()]
        for t, y in zip(text.to_pylist(), label.to_pylist(), strict=True):
            found[y].update({r for w in set(windows(t)) for r in runs(w)})
        every = list(set(found[0]) | set(found[1]))
        return {"run": every, "toxic": [found[1][r] for r in every], "ordinary": [found[0][r] for r in every]}

    counted = rows.per_batch(chosen, pa.schema([("run", pa.binary()), ("toxic", pa.int64()), ("ordinary", pa.int64())]), count_runs, COUNTED_BYTES)
    share = (F.col("toxic") / float(sizes[1])) / ((F.col("ordinary") + 0.5) / float(sizes.get(0, 0) + 1))
    contrast = (counted.groupBy("run").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
                .where((F.col("toxic") >= min(sizes[1], max(LEAST_DOCS, LEAST_SHARE * sizes[1]))) & (share >= CONTRAST)).orderBy(F.desc("toxic"), "run").limit(RUNS))
    wanted = {bytes(r["run"]) for r in contrast.collect()}

    def count_windows(text, label):
        found: list[Counter] = [Counter(), Counter()]
        for t, y in zip(text.to_pylist(), label.to_pylist(), strict=True):
            ws = windows(t)
            found[y].update((s for w in ws for s in stretches(w, wanted)) if y else (w for w in ws if wanted.isdisjoint(runs(w))))
        return {"window": list(found[0]) + list(found[1]), "label": [0] * len(found[0]) + [1] * len(found[1]), "n": list(found[0].values()) + list(found[1].values())}

    seen = rows.per_batch(chosen, pa.schema([("window", pa.binary()), ("label", pa.int32()), ("n", pa.int64())]), count_windows, COUNTED_BYTES).groupBy("label", "window").agg(F.sum("n").alias("n"))
    samples = [{bytes(r["window"]): r["n"] for r in seen.where(F.col("label") == y).orderBy(F.desc("n"), "window").limit(WINDOWS).collect()} for y in (0, 1)]
    return _calibrate(Model(_dictionary(samples[0], ORDINARY_BYTES), _dictionary(samples[1], TOXIC_BYTES)), chosen)


def _calibrate(model: Model, chosen: DataFrame) -> Model:
    """Fit the curve to the labels of the sample."""

    def work(text, label):
        texts = text.to_pylist()
        return {"label": label, "gains": model.gains(texts), "words": [len(t.split()) for t in texts]}

    seen = rows.per_batch(chosen, pa.schema([("label", pa.int32()), ("gains", pa.list_(pa.int32())), ("words", pa.int64())]), work).toPandas()
    weights = rows.logistic(shape([list(g) for g in seen["gains"]], seen["words"].tolist()), seen["label"].to_numpy(float))
    model.curve = tuple(map(float, weights))
    return model


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""

    def work(doc_id, held_out, text):
        return {"doc_id": doc_id, "held_out": held_out, "score": model.score(text.to_pylist())}

    source = docs.select(F.col("doc_id").cast("long"), rows.fold("doc_id", FOLDS) == 0, F.coalesce("text", F.lit("")))
    return rows.per_batch(source, SCORED, work).withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, by a model of the labelled ones outside the held-out fold."""
    docs = rows.documents(spark, folder)
    return score(docs, train(docs, spark.read.parquet(f"{folder}/labels.parquet")))


def keep_ordinary(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, all columns, that the model does not take for toxic."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names, text_at = docs.columns, docs.columns.index("text")

    def work(*columns):
        fine = pa.array(model.score([t or "" for t in columns[text_at].to_pylist()]) < CUT)
        return {name: column.filter(fine) for name, column in zip(names, columns, strict=True)}

    return rows.per_batch(docs, to_arrow_schema(docs.schema), work)
