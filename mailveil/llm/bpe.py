"""Byte-level BPE encoding and decoding of whole texts by tree concatenation.

A text of at most `leaf` characters is encoded at once. A longer one is halved down to leaves, which are encoded side by
side; two neighbours are then joined by encoding a window of tokens around the seam anew. The window grows until its first
and last tokens equal those the two sides have there. A sequence whose neighbouring tokens are all right is the right
sequence, so the agreed join is the library's own result. Texts longer than `shard` characters are shared out over the
cluster first: their shards are encoded in tasks of their own, then joined by the same tree.

Null texts count as empty and have no ids. The string of a special token in a text is that token, as the library does it.
Repeated rows are encoded each for itself; other columns are left out.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from mailveil.llm import rows

LEAF, SHARD = 4096, 1 << 18
#: Tokens that must agree at either end of a window, and a window's first reach into each side.
AGREE, REACH = 4, 12

ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Codec:
    """A tokenizer file and what joining needs of it."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        byte = _alphabet()
        special = set(self.special)
        self.bytes = [b""] * self.library.get_vocab_size(with_added_tokens=True)
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = token.encode() if token in special else bytes(byte[c] for c in token)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.int32) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str], leaf: int = LEAF) -> list[np.ndarray]:
        """The ids of each text."""
        short = [k for k, t in enumerate(texts) if len(t) <= leaf]
        out: list = [None] * len(texts)
        for k, ids in zip(short, self.plain([texts[k] for k in short]), strict=True):
            out[k] = ids
        for k, t in enumerate(texts):
            if out[k] is None:
                out[k] = self._long(t, leaf)
        return out

    def _long(self, text: str, leaf: int) -> np.ndarray:
        """Special tokens part a text for good; the stretches between them are encoded as trees."""
        stretches = [text]
        for token in self.special:
            stretches = [y for x in stretches for y in ([x] if x == token or x in self.special else _between(x, token))]
        done = [self._tree(x, leaf) for x in stretches if x]
        return np.concatenate(done) if done else np.zeros(0, np.int32)

    def _tree(self, text: str, leaf: int) -> np.ndarray:
        parts = 1
        while len(text) > leaf * parts:
            parts *= 2
        cuts = [len(text) * k // parts for k in range(parts + 1)]
        return self.join_all(self.plain([text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]))

    def join_all(self, level: list[np.ndarray]) -> np.ndarray:
        """Join neighbours pairwise, level by level."""
        while len(level) > 1:
            pairs = [self.join(level[k], level[k + 1]) for k in range(0, len(level) - 1, 2)]
            level = pairs + ([level[-1]] if len(level) % 2 else [])
        return level[0]

    def _starts_inside(self, token: int) -> bool:
        return 0x80 <= self.bytes[token][0] < 0xC0

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of both texts in a row, by windows that grow around the seam until both sides agree."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        reach = REACH
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            while i > 0 and self._starts_inside(left[i]):
                i -= 1
            while j < len(right) and self._starts_inside(right[j]):
                j += 1
            window = b"".join(self.bytes[t] for t in np.concatenate([left[i:], right[:j]])).decode()
            (made,) = self.plain([window])
            whole_left, whole_right = i == 0, j == len(right)
            if len(made) >= 2 * AGREE or whole_left and whole_right:
                begins = whole_left or len(left) - i >= AGREE and np.array_equal(made[:AGREE], left[i:i + AGREE])
                ends = whole_right or j >= AGREE and np.array_equal(made[-AGREE:], right[j - AGREE:j])
                if begins and ends:
                    return np.concatenate([left[:i], made, right[j:]])
            reach *= 2

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.library.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)


def _between(text: str, token: str) -> list[str]:
    pieces = text.split(token)
    return [y for x in pieces[:-1] for y in (x, token)] + pieces[-1:]


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _digests(doc_id, ids: list[np.ndarray], tool: Codec) -> dict:
    return {"doc_id": doc_id, "n_tokens": [len(x) for x in ids],
            "ids_sha256": [hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in tool.decode(ids)]}


def _results(doc_id, ids: list[np.ndarray], tool: Codec) -> dict:
    return {"doc_id": doc_id, "n_tokens": [len(x) for x in ids], "ids": [x.tolist() for x in ids], "decoded": tool.decode(ids)}


def encode_documents(docs: DataFrame, tokenizer: str, digests: bool = False, leaf: int = LEAF, shard: int = SHARD) -> DataFrame:
    """doc_id, n_tokens, and the ids and decoded text, or their SHA-256 digests.

    `tokenizer` is the path of a byte-level BPE file that every worker can read. The ids' digest is that of the decimal
    ids joined by commas, the text's that of its UTF-8 bytes.
    """
    schema, shape = (DIGESTS, _digests) if digests else (ENCODED, _results)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def short(doc_id, text):
        tool = codec(tokenizer)
        return shape(doc_id, tool.encode(text.to_pylist(), leaf), tool)

    def cut(row, doc_id, text):
        made = [(r, d, k, t[k * shard:(k + 1) * shard]) for r, d, t in zip(row.to_pylist(), doc_id.to_pylist(), text.to_pylist(), strict=True) for k in range(-(-len(t) // shard))]
        return dict(zip(("row", "doc_id", "part", "text"), map(list, zip(*made, strict=True)), strict=True)) if made else {k: [] for k in ("row", "doc_id", "part", "text")}

    def encode_shard(row, doc_id, part, text):
        return {"row": row, "doc_id": doc_id, "part": part, "ids": [x.tobytes() for x in codec(tokenizer).encode(text.to_pylist(), leaf)]}

    def join(group: pa.Table) -> pa.Table:
        tool = codec(tokenizer)
        group = group.sort_by("part")
        whole = tool.join_all([np.frombuffer(x.as_py(), np.int32) for x in group["ids"]])
        return pa.table(shape(group["doc_id"][:1].to_pylist(), [whole], tool), schema=schema)

    # A special token at a shard's seam would be cut in two, so a text that holds one goes the other way.
    apart = (F.length("text") > shard) & ~F.contains("text", F.lit("<|"))
    whole = rows.per_batch(docs.where(~apart), schema, short, 1 << 20)
    key = [("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int32())]
    shards = rows.per_batch(docs.where(apart).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), pa.schema([*key, ("text", pa.string())]), cut).repartition("row", "part")
    long = rows.per_batch(shards, pa.schema([*key, ("ids", pa.binary())]), encode_shard).groupBy("row").applyInArrow(join, from_arrow_schema(schema))
    return whole.unionByName(long)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, encoded with the 50k byte-level vocabulary and decoded again, as digests."""
    import public_tokenizers

    return encode_documents(rows.documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), digests=True)
