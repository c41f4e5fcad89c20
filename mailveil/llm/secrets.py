"""Secret scanning by assignment-aware lexing.

A base set of spans comes from three fixed patterns (assignments to sensitive names, access key ids, long hexadecimal runs).
The lexer then reads source and configuration syntax: `name = literal`, `name: literal`, `"name": "literal"`, `name := x`,
`name => x`, `name: type = x`, `table["name"] = x` and `<name>literal</name>`, with quoted or bare literals, names as values and sums of both. Names bound to literals earlier in the text are
constants, and a target that receives a constant receives its literals. A literal is scored by how sensitive the target's
name is times how much it looks like a key; those of at least `LEAST` are added as spans of kind `literal`, unless a base
span covers them already. Offsets count code points, ends are exclusive.

Null texts are empty and hold nothing. Each row is judged for itself; other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailveil.llm import rows

LEAST = 0.5
KINDS = ("assign", "access", "hex", "literal")

_ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS](?:[wW][oO][rR][dD]|[wW][dD])|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_WORDS = ("passw", "secret", "token", "apikey", "api_key")

#: A name, an operator, and the first term of a value; only at the start of a name, so that the scan stays linear.
_TARGET = re.compile(r"""(?<![\w.$-])["']?([A-Za-z_$][\w.$-]*+)(?:["'](?:[ \t]*+\])?)?+[ \t]*+(?::[ \t]*+&?(?:'static[ \t]++)?([A-Za-z_][\w.]*+)((?:\[[^\]\n="']{0,80}\]|<[^>\n="']{0,80}>)?+\??+(?:[ \t]*+\|[ \t]*+[A-Za-z_][\w.]*+)*+)[ \t]*+=(?![=>])|:=|=>|=(?!=)|:(?![:/]))[ \t]*+""")
#: An element of a configuration file that holds nothing but a text.
_ELEMENT = re.compile(r"""<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>\s*+(?:<!\[CDATA\[\s*+)?([^<>\s]+?)\s*+(?:\]\]>\s*+)?</\1\s*+>""")
#: Names of types, which are no constants: any other word between ":" and "=" may be a target itself, as in `note: key = literal`.
_TYPES = {"any", "auto", "bytes", "char", "final", "object", "str", "string", "text", "varchar"}
_TERM = re.compile(r"""(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|([^\s,;#"'(){}\[\]<>+]++))(?:[ \t]*+(\+)[ \t]*+)?""")

#: How sensitive a part of a name is.
_SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "apikey": 1.0, "token": 0.9, "credential": 0.9,
              "credentials": 0.9, "privatekey": 1.0, "accesskey": 1.0, "auth": 0.8, "bearer": 0.8, "signature": 0.7, "salt": 0.7}
_PAIRS = {("api", "key"), ("private", "key"), ("access", "key"), ("secret", "key"), ("encryption", "key"), ("client", "key"), ("pass", "phrase"), ("pass", "word")}
_STAND_IN = re.compile(r"(?i)^(?:changeme|example|placeholder|your[_-].*|x{4,}|\*{3,}|<.*>|\$\{.*\}|\{\{.*\}\}|none|null|true|false)$")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


def sensitivity(name: str) -> float:
    """From 0 to 1, by the words that a name is made of."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    most = max((_SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    return 1.0 if any(p in _PAIRS for p in zip(parts, parts[1:], strict=False)) else most


def strength(literal: str) -> float:
    """From 0 to 1: long, mixed and evenly spread characters look like a key; plain words and stand-ins do not."""
    if len(literal) < 8 or _STAND_IN.match(literal) or any(c.isspace() for c in literal):
        return 0.0
    kinds = sum(any(f(c) for c in literal) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    if kinds < 2:
        return 0.0
    n = len(literal)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    return min(1.0, entropy / 3.0)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, kinds by their place in KINDS."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the literals that reach a sensitive name, directly or through constants."""
    if "=" not in text and ":" not in text and "</" not in text:
        return []
    bound: dict[str, frozenset[tuple[int, int]]] = {}
    found = set()
    for m in _TARGET.finditer(text):
        at, literals, more = m.end(), set(), True
        while more and (t := _TERM.match(text, at)):
            group = next(k for k in (1, 2, 3) if t[k] is not None)
            if group == 3 and t[3] in bound:
                literals |= bound[t[3]]
            else:
                literals.add((t.start(group), t.end(group)))
            at, more = t.end(), t[4] is not None
        if not literals:
            continue
        for name in (m[1], m[2]) if m[2] and not m[3] and m[2].lower() not in _TYPES else (m[1],):
            bound[name] = frozenset(literals)
            if weight := sensitivity(name):
                found.update((a, b) for a, b in literals if weight * strength(text[a:b]) >= LEAST)
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            if (weight := sensitivity(m[1])) and weight * strength(m[2]) >= LEAST:
                found.add((m.start(2), m.end(2)))
    return sorted(found)


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and all spans, by start, kind and end."""
    base = base_spans(text)
    added, reach, k = [], 0, 0
    for a, b in lexed_spans(text):
        while k < len(base) and base[k][0] <= a:
            reach = max(reach, base[k][2])
            k += 1
        if b > reach:
            added.append((a, 3, b))
    return base, sorted(base + added)


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


SCANNED = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, their digest, and all spans as kind:start:end joined by commas."""

    def work(doc_id, text):
        out: dict = {f.name: [] for f in SCANNED}
        for t in text.to_pylist():
            base, every = spans(t)
            kinds = Counter(k for _, k, _ in base)
            for name, value in (("n_assign", kinds[0]), ("n_access", kinds[1]), ("n_hex", kinds[2]), ("base_sha256", hashlib.sha256(_joined(base).encode()).hexdigest()), ("spans", _joined(every))):
                out[name].append(value)
        return out | {"doc_id": doc_id}

    return rows.per_batch(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))), SCANNED, work)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """`docs` with its columns, and in `text` a mark for every found span; overlapping spans share one. n_chars follows."""
    names = docs.columns
    text_at = names.index("text")

    def work(*columns):
        out = []
        for t in columns[text_at].to_pylist():
            if t is not None and (every := spans(t)[1]):
                pieces, at = [], 0
                for a, _, b in every:
                    if b > at:
                        pieces += [t[at:a], mark] if a >= at else []
                        at = b
                t = "".join([*pieces, t[at:]])
            out.append(t)
        return dict(zip(names, columns, strict=True)) | {"text": out}

    from pyspark.sql.pandas.types import to_arrow_schema

    made = rows.per_batch(docs, to_arrow_schema(docs.schema), work)
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else made


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every document."""
    return scan(rows.documents(spark, folder))
