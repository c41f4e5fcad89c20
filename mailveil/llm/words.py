"""Words, hashes and word windows of whole columns of text, as numpy arrays over the UTF-8 bytes of an Arrow column.

Texts are cut into blocks of a few megabytes, so the working memory stays the same however long a text is. A null text
has no words. Word boundaries are single-byte classes, hence exact on UTF-8: bytes of longer characters are word bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 17
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def byte_class(out: str) -> bytes:
    """A translation table: 1 for the byte values of words, 0 for those of `out`, the separators."""
    table = bytearray(b"\x01" * 256)
    for value in out.encode("latin-1"):
        table[value] = 0
    return bytes(table)


#: Words of everything but the six ASCII white-space characters.
SPACED = byte_class(" \t\n\v\f\r")
#: Words of digits, letters and whatever is not ASCII.
ALNUM = byte_class("".join(chr(c) for c in range(128) if not chr(c).isalnum()))

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: a bijection whose every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of the multiplier and of its inverse along a block."""
    powers = np.ones((2, BLOCK + 1), np.uint64)
    for row, base in ((0, _MULTIPLIER), (1, _INVERSE)):
        size = 1
        while size <= BLOCK:  # doubling: the second half is the first one times base ** size
            more = min(size, BLOCK + 1 - size)
            powers[row, size:size + more] = powers[row, :more] * np.uint64(pow(base, size, 1 << 64))
            size += more
    return powers[0], powers[1]


def _edges(block: bytes, inside: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block."""
    word = np.frombuffer(b"\0" + block.translate(inside) + b"\0", np.uint8)
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[0::2], edge[1::2]


def _hashes(block: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the words, wherever they stand."""
    powers, inverse = _powers()
    sums = np.zeros(len(block) + 1, np.uint64)
    np.multiply(np.frombuffer(block, np.uint8), powers[: len(block)], out=sums[1:])
    np.cumsum(sums, out=sums)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def _long_word(block: bytes) -> np.uint64:
    powers, _ = _powers()
    total, shift = 0, 1
    for at in range(0, len(block), BLOCK):
        piece = np.frombuffer(block[at:at + BLOCK], np.uint8)
        total += int((piece * powers[: len(piece)]).sum(dtype=np.uint64)) * shift
        shift = shift * pow(_MULTIPLIER, len(piece), 1 << 64) % (1 << 64)
    return mix(np.array([(total + len(block)) % (1 << 64)], np.uint64))[0]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), ends


def word_hashes(column: pa.Array, inside: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words of a column in order, and the n + 1 offsets that share them out to its rows.

    With `lower` the case of A-Z does not count.
    """
    data, offsets = buffers(column)
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for first, last, begin, end in _blocks(data, offsets, inside):
        block = data[begin:end].tobytes()
        block = block.translate(_LOWER) if lower else block
        starts, ends = _edges(block, inside)
        if len(block) > BLOCK:  # one word longer than a block
            values = np.array([_long_word(block[a:b]) for a, b in zip(starts, ends, strict=True)], np.uint64)
        else:
            if last - first > 1 and len(starts):  # a text's end separates words too: cut those that run on into the next text
                cuts = np.unique(offsets[first + 1:last] - begin)
                after = np.searchsorted(starts, cuts, "right") - 1
                cuts = cuts[(after >= 0) & (starts[np.maximum(after, 0)] < cuts) & (ends[np.maximum(after, 0)] > cuts)]
                starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
            values = _hashes(block, starts, ends)
        hashes.append(values)
        if last - first == 1:
            counts[first] += len(starts)
        else:
            counts[first:last] += np.diff(np.searchsorted(starts, offsets[first:last + 1] - begin))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])


def _blocks(data: np.ndarray, offsets: np.ndarray, inside: bytes) -> Iterator[tuple[int, int, int, int]]:
    """Rows [first, last) and bytes [begin, end): as many whole texts as fit a block, or one piece of a longer text."""
    row, rows = 0, len(offsets) - 1
    gaps = np.frombuffer(inside, np.uint8) == 0
    while row < rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1)
        begin, end = int(offsets[row]), int(offsets[last])
        if end - begin <= BLOCK:
            if end > begin:
                yield row, last, begin, end
        else:
            while begin < end:
                stop = min(begin + BLOCK, end)
                if stop < end:
                    gap = np.flatnonzero(gaps[data[begin:stop]])
                    if len(gap):
                        stop = begin + int(gap[-1]) + 1
                    else:  # the word goes on: take all of it
                        while stop < end and not gaps[data[stop - 1]]:
                            gap = np.flatnonzero(gaps[data[stop:stop + BLOCK]])
                            stop = stop + int(gap[0]) + 1 if len(gap) else min(stop + BLOCK, end)
                yield row, last, begin, stop
                begin = stop
        row = last


def window_hashes(words: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """The hash of each run of `size` words, by the position of its first word; runs ignore where texts end."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64((_MULTIPLIER * (2 * seed + 1)) % (1 << 64) | 1)
    total = words[:n].copy()
    for k in range(1, size):
        total *= base
        total += words[k:k + n]
    return mix(total)


def within(offsets: np.ndarray, size: int) -> np.ndarray:
    """Which positions begin a run of `size` words that stays in one text, for window_hashes' result."""
    n = int(offsets[-1]) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return rows[:n] == rows[size - 1:]
