"""Quality rules with line labelling: a linear-chain conditional random field marks each line content or boilerplate.

The base rules are counts over the whole text. The field's states are content and boilerplate; its features are indicators
of each line (length, symbols, capitals, digits, ending, repeats, place) and the transitions between neighbouring lines. It
is trained here on at most `SAMPLE` labelled documents: the lines of those of label 0 count as boilerplate, of label 1 as
content, but for lines that repeat an earlier one or are mostly symbols. Viterbi decoding finds the best labels, and a
document is kept if content lines hold at least `CONTENT` of its words' characters and no base rule fails.

A line without a word takes no part. Null and empty texts have no words, so they fail the base rules. Rows that repeat an id
are judged each for itself; other columns are left out. Without both labels all lines are content. Whether word windows are
equal is told by 64-bit hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailveil.llm import rows, words
from mailveil.llm.features import SYMBOLS

SAMPLE, CONTENT = 3000, 0.5
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
ROUNDS, RATE, PENALTY = 150, 0.5, 1e-3

_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
#: Upper bounds of the bins of each measured value; a last bin takes the rest.
_BOUNDS = [("words", (1, 3, 8, 20, 60)), ("symbols", (0.0, 0.02, 0.08, 0.2)), ("capitals", (0.02, 0.08, 0.3, 0.6)), ("digits", (0.0, 0.05, 0.2)), ("word length", (2.5, 4.0, 6.5, 9.0))]
_FLAGS = ("always", "repeats", "stops", "shouts", "link or bar", "bullet", "first", "last", "distinct words low", "words end in symbols")
_STARTS = np.concatenate([[0], np.cumsum([len(b) + 1 for _, b in _BOUNDS])])
N_FEATURES = int(_STARTS[-1]) + len(_FLAGS)
_SET = set(SYMBOLS)


def line_features(text: str) -> tuple[list[list[int]], list[int], list[bool]]:
    """Of the lines with a word: active features, characters of words, and whether the form alone shows boilerplate."""
    out, sizes, plain = [], [], []
    seen = set()
    lines = [(b, w) for b in text.encode().split(b"\n") if (w := b.split())]
    for k, (line, found) in enumerate(lines):
        n, size = len(found), sum(map(len, found))
        symbols = len(line) - len(line.translate(None, SYMBOLS))
        values = (n, symbols / size, (len(line) - len(line.translate(None, _UPPER))) / size, (len(line) - len(line.translate(None, _DIGIT))) / size, size / n)
        active = [int(_STARTS[f]) + sum(v > bound for bound in bounds) for f, (v, (_, bounds)) in enumerate(zip(values, _BOUNDS, strict=True))]
        repeats = line in seen
        seen.add(line)
        ending = sum(w[-1] in _SET for w in found)
        flags = (True, repeats, line.rstrip()[-1:] in b".!?", line.count(b"!!") * 5 > n, b"http" in line or b" | " in line, line.lstrip()[:1] in b"-*>#", k == 0, k == len(lines) - 1,
                 len(set(found)) * 2 < n and n > 8, ending * 3 > n)
        out.append(active + [int(_STARTS[-1]) + f for f, on in enumerate(flags) if on])
        sizes.append(size)
        plain.append(repeats or symbols * 3 > size)
    return out, sizes, plain


@dataclass
class Field:
    """Weights of the features for boilerplate (content has 0), and of the transitions [from, to]."""

    weights: np.ndarray
    moves: np.ndarray

    def boilerplate(self, lines: list[list[int]]) -> list[bool]:
        """The best labels of a text's lines, by Viterbi's recursion."""
        if not lines:
            return []
        weights, ((cc, cb), (bc, bb)) = self.weights, self.moves.tolist()
        content, junk, back = 0.0, float(weights[lines[0]].sum()), []
        for active in lines[1:]:
            own = float(weights[active].sum())
            a, b, c, d = content + cc, junk + bc, content + cb, junk + bb
            back.append((b > a, d > c))
            content, junk = max(a, b), max(c, d) + own
        state = junk > content
        out = [state]
        for to_content, to_junk in reversed(back):
            state = to_junk if state else to_content
            out.append(state)
        return out[::-1]


def fit(texts: list[tuple[list[list[int]], list[bool]]]) -> Field:
    """Maximise the likelihood of the label sequences by gradient steps over forward-backward marginals."""
    texts = [t for t in texts if t[0]]
    weights, moves = np.zeros(N_FEATURES), np.zeros((2, 2))
    if not texts or len({y for _, ys in texts for y in ys}) < 2:
        weights[int(_STARTS[-1])] = -1.0
        return Field(weights, moves)
    texts.sort(key=lambda t: -len(t[0]))
    lengths = np.array([len(t[0]) for t in texts])
    total = int(lengths.sum())
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    x = np.zeros((total, N_FEATURES))
    for row, active in enumerate(a for t, _ in texts for a in t):
        x[row, active] = 1
    y = np.array([v for _, ys in texts for v in ys], int)
    inner = np.ones(total, bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (y[at - 1], y[at]), 1)
    speed_w, speed_m = np.zeros_like(weights), np.zeros_like(moves)
    for _ in range(ROUNDS):
        score = np.stack([np.zeros(total), x @ weights], 1)
        ahead, behind = np.zeros((total, 2)), np.zeros((total, 2))
        ahead[starts] = score[starts]
        for t in range(1, int(lengths[0])):  # all texts of more than t lines at once; they come longest first
            r = starts[: int(np.searchsorted(-lengths, -t, "left"))] + t
            ahead[r] = score[r] + np.logaddexp(ahead[r - 1, :1] + moves[0], ahead[r - 1, 1:] + moves[1])
        for t in range(int(lengths[0]) - 2, -1, -1):
            r = starts[: int(np.searchsorted(-lengths, -t - 1, "left"))] + t
            later = score[r + 1] + behind[r + 1]
            behind[r] = np.logaddexp(later[:, :1] + moves[:, 0], later[:, 1:] + moves[:, 1])
        norm = np.logaddexp.reduce(ahead[starts + lengths - 1], axis=1)
        norm = np.repeat(norm, lengths)
        junk = np.exp(ahead[:, 1] + behind[:, 1] - norm)
        joint = np.exp(ahead[at - 1][:, :, None] + moves + (score[at] + behind[at])[:, None, :] - norm[at][:, None, None])
        step_w = x.T @ (y - junk) / total - PENALTY * weights
        step_m = (seen_moves - joint.sum(0)) / total - PENALTY * moves
        speed_w, speed_m = 0.9 * speed_w + step_w, 0.9 * speed_m + step_m
        weights, moves = weights + RATE * speed_w, moves + RATE * speed_m
    return Field(weights, moves)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """A field of the lines of at most `sample` documents with a quality label."""
    chosen = rows.labelled_sample(docs, labels, "quality", F.lit(False), sample)

    def work(text, label):
        found = [line_features(t) for t in text.to_pylist()]
        return {"lines": [f for f, _, _ in found], "junk": [[p or y == 0 for p in plain] for (_, _, plain), y in zip(found, label.to_pylist(), strict=True)]}

    schema = pa.schema([("lines", pa.list_(pa.list_(pa.int32()))), ("junk", pa.list_(pa.bool_()))])
    seen = rows.per_batch(chosen, schema, work).orderBy(F.xxhash64("lines")).collect()
    return fit([(r["lines"], r["junk"]) for r in seen])


def repeated_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: words, and words in windows of WINDOW words that the text has twice or more."""
    hashes, offsets = words.word_hashes(text, words.SPACED, lower=False)
    counts = np.diff(offsets)
    whole = np.flatnonzero(words.within(offsets, WINDOW))
    owner = np.searchsorted(offsets, whole, "right") - 1
    keys = words.mix(words.window_hashes(hashes, WINDOW)[whole] + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marks = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(marks, whole[twice], 1)
    np.add.at(marks, whole[twice] + WINDOW, -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(marks)[:-1] > 0)])
    return counts, hit[offsets[1:]] - hit[offsets[:-1]]


JUDGED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
                    ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_lines", pa.int64()), ("n_content_lines", pa.int64()), ("content_share", pa.float64())])


def judge(docs: DataFrame, field: Field, content: float = CONTENT) -> DataFrame:
    """The base counts, the verdict, and the lines' labels in numbers, for every row."""

    def work(doc_id, text):
        counts, repeated = repeated_words(text)
        out: dict = {f.name: [] for f in JUDGED}
        for t in text.to_pylist():
            found, sizes, _ = line_features(t)
            junk = field.boilerplate(found)
            lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
            share = sum(s for s, j in zip(sizes, junk, strict=True) if not j) / max(1, sum(sizes))
            for name, value in (("word_chars", len(t.translate(_NO_SPACE))), ("n_symbols", sum(t.count(chr(c)) for c in SYMBOLS)), ("n_dup_lines", len(lines) - len(set(lines))),
                                ("n_lines", len(found)), ("n_content_lines", len(junk) - sum(junk)), ("content_share", share)):
                out[name].append(value)
        failed = (counts < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * counts)
        return out | {"doc_id": doc_id, "n_words": counts, "n_repeat_words": repeated, "base_failed": failed, "kept": ~failed & (np.array(out["content_share"]) >= content)}

    return rows.per_batch(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))), JUDGED, work)


_NO_SPACE = {ord(c): None for c in " \t\n\v\f\r"}


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, by a field trained on labelled ones."""
    docs = rows.documents(spark, folder)
    return judge(docs, train(docs, spark.read.parquet(f"{folder}/labels.parquet")))
