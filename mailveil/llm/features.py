"""Numbers that describe the form of a text, for the quality models. They use the text alone."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np

#: Characters that hint at markup, prices or noise (a fixed set).
SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_STOPS = b".!?"
#: A word that ends in a symbol.
_MARKED = re.compile(rb"[#*$%&|<>][ \n\t\r\v\f]")
_PUNCTUATION = b",;:'\"()-"

NAMES = ["words", "chars_per_word", "symbol_share", "upper_share", "digit_share", "stop_share", "punctuation_share", "other_share", "distinct_words", "top_word", "top_three_words",
         "repeated_pairs", "lines", "repeated_lines", "words_per_line", "short_lines", "words_per_stop", "symbol_words", "shout_marks", "word_length_spread", "space_share", "single_char_words"]


def share(data: bytes, of: bytes) -> float:
    return (len(data) - len(data.translate(None, of))) / max(1, len(data))


def describe(text: str) -> list[float]:
    """The values of NAMES; an empty text has zeros."""
    data = text.encode()
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    top = [c for _, c in counts.most_common(3)]
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in data.split(b"\n") if x.strip()]
    in_line = [len(x.split()) for x in lines]
    stops = len(data) - len(data.translate(None, _STOPS))
    plain = _UPPER + _LOWER + _DIGIT + SYMBOLS + _STOPS + _PUNCTUATION + b" \n\t\r\v\f"
    return [float(np.log1p(n)), float(lengths.mean()), share(data, SYMBOLS), share(data, _UPPER), share(data, _DIGIT), stops / len(data), share(data, _PUNCTUATION),
            len(data.translate(None, plain)) / len(data), len(counts) / n, top[0] / n, sum(top) / n, 1 - pairs / max(1, n - 1), float(np.log1p(len(lines))),
            1 - len(set(lines)) / len(lines), n / len(lines), sum(k < 4 for k in in_line) / len(lines), n / (1 + stops), len(_MARKED.findall(data)) / n,
            data.count(b"!!") / n, float(lengths.std()), share(data, b" \n\t\r\v\f"), float((lengths == 1).mean())]


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([describe(t) for t in texts], float).reshape(len(texts), len(NAMES))
