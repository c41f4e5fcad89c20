"""URL filter, source divergence and vector codes against brute force, and their edge cases."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from mailveil.llm import divergence, urls, vector_codes

RULES = "action string, host string, path string"
PAGES = "page_id long, url string, host string, html string, verdict int"


def judged(spark, pages, rules):
    made = urls.judge(spark.createDataFrame([(k, u, "x", "y", 1) for k, u in pages], PAGES), spark.createDataFrame(rules, RULES))
    return sorted(map(tuple, made.collect()), key=repr)


def brute_url(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len((h + p).encode()), len(h.encode()), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls_equal_brute_force(spark):
    rng = random.Random(5)
    parts = ["a", "b", "example", "com", "net", "ü"]
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in
                  ((".".join(rng.choices(parts, k=rng.randint(1, 3))), rng.choice(["", "/", "/e", "/en/", "/ü/x"])) for _ in range(60))}.values())
    pages = [(k, rng.choice(["http://", "HTTPS://", ""]) + ".".join(rng.choices([*parts, "A", "Com", ""], k=rng.randint(1, 5))) + rng.choice(["", "/", "/en/x", "/ü/xy#/en/", "?q=/en/", "/e?://b", ":80/en/"]))
             for k in range(400)]
    assert judged(spark, pages, rules) == sorted(((k, *brute_url(u, rules)) for k, u in pages), key=repr)


def test_urls_edges(spark):
    pages = [(None, "http://a.net/es/"), (1, None), (1, ""), (1, "no scheme"), (2, "http://" + "a." * 50_000 + "net/fr/" + "x" * 100_000), (3, "://net/es/"), (4, "x://net"), (4, "x://net")]
    rules = [*urls.RULES, ("allow", "net", "/es/"), (*("block", None, None),)]
    rows = judged(spark, pages, rules)
    by_id = {(r[0], r[1][-5:], r[2][:4]): (r[3], r[4]) for r in rows}
    assert len(rows) == 8 and by_id[1, "", ""] == ("", "block") and by_id[3, "net", "/es/"] == ("net/es/", "block")
    assert by_id[2, "a.net", "/fr/"] == ("net/fr/", "block") and by_id[4, "net", ""] == (None, "allow")
    assert by_id[None, "a.net", "/es/"] == ("net/es/", "block")
    assert judged(spark, pages[:1], []) == [(None, "a.net", "/es/", None, "allow")] and judged(spark, [], urls.RULES) == []
    with pytest.raises(Exception, match="allow or block"):
        judged(spark, pages, [("deny", "a", "/")])


@pytest.mark.parametrize("digest", [lambda b: len(b) % 3, lambda b: 7, lambda b: zlib.crc32(b) % 9 << 60])
def test_colliding_digests_in_small_segments(spark, digest):
    rules = spark.createDataFrame([("block", f"h{k % 7}.org", f"/{'p' * (k % 5)}{k}/") for k in range(50)], RULES)
    array = urls.DigestArray([urls.Segment(data) for data in urls.segments_of(rules, digest, most=9)], digest)
    held = [urls.rule_key(f"h{k % 7}.org".encode(), f"/{'p' * (k % 5)}{k}/".encode()) for k in range(50)]
    assert [v.tolist() for v in array.find(held)] == [[1]] * 50
    assert array.find([urls.host_key(b"h9.org"), urls.rule_key(b"h1.org", b"/p2/")]) == [None, None]


def brute_divergence(docs, least):
    import re
    counts, frequency, totals, groups = {}, Counter(), Counter(), set()
    for _, text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        counts.setdefault((lang, source), Counter()).update(terms)
        totals.update((lang, t) for t in terms)
        frequency.update((lang, t) for t in set(terms))
    out = []
    for lang, source in groups:
        kept = [t for (of, t), n in frequency.items() if of == lang and n >= least]
        total = lambda c: sum(c[t] for t in kept)
        share = lambda c, t: 1 + 10 ** 9 * (c[t] + 2) // (total(c) + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        own, whole = counts[lang, source], Counter({t: totals[lang, t] for t in kept})
        pair = [(sum(f(share(own, t), share(counts[of, other], t)) for t in kept), other) for of, other in groups if of == lang and other != source]
        term = [(f(share(own, t), share(whole, t)), t) for t in kept if own[t] and share(own, t) > share(whole, t)]
        for part, items, most in (("pair", pair, None), ("term", term, 10)):
            ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(ordered)]
    return sorted(out)


def test_divergence_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 3)
    monkeypatch.setattr(divergence, "BLOCK_POSTINGS", 5)
    rng = random.Random(2)
    words = [f"w{chr(97 + k)}" for k in range(20)] + ["Über", "ÜBER", "x1y", "日本"]
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(0, 30))) if rng.random() > 0.1 else None, rng.choice(["en", "de", None, "fr"]) if k < 240 else "rare", rng.choice([None, "s1", "s2", "s3", "s4", "s5", "s6", "s7", "é"]))
            for k in range(250)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, lang string, source string, term int, n int").repartition(5)
    assert sorted(map(tuple, divergence.audit(df, least=8).collect())) == brute_divergence(docs, 8)


def test_divergence_edges(spark, monkeypatch):
    kind = "doc_id long, text string, lang string, source string"
    assert divergence.audit(spark.createDataFrame([], kind)).collect() == []
    nothing = spark.createDataFrame([(1, None, None, "a"), (1, "", None, "b")], kind)
    assert sorted(map(tuple, divergence.audit(nothing).collect())) == [("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)]
    monkeypatch.setattr(divergence, "PIECE", 64)
    monkeypatch.setattr(divergence, "FLUSH", 5)
    long_ = spark.createDataFrame([(k, "Aa b1b-c " * 5000 + "x" * 300, "en", f"s{k % 2}") for k in range(12)], kind).coalesce(1)
    total = {r["term"]: r["n"] for r in divergence.index(long_).collect()}
    assert total == {"aa": 60_000, "b": 120_000, "c": 60_000, "x" * 300: 12}


def test_shares_are_exact_beyond_64_bit_products(spark):
    count, total, kept = 10 ** 14 + 7, 3 * 10 ** 15 + 11, 12345
    got = spark.sql(f"SELECT {divergence.share(f'{count}L', f'{total}L', f'{kept}L')}").first()[0]
    assert got == 1 + 10 ** 9 * (count + 2) // (total + 2 * kept)


def brute_codes(table):
    kept = sorted(((i, list(v), label) for i, v, label in table if v is not None and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0], r[1]))
    whole = [[int(np.floor(x * 4096)) for x in v] for _, v, _ in kept]
    width = len(whole[0]) // 8
    part = lambda v, p: v[p * width:(p + 1) * width]
    books = [[part(v, p) for v in whole[:16]] for p in range(8)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda v, p: min((distance(part(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(6):
        for p in range(8):
            held = {}
            for v in whole:
                held.setdefault(pick(v, p)[1], []).append(part(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*held[k], strict=True)] if k in held else e for k, e in enumerate(books[p])]
    picks = [[pick(v, p) for p in range(8)] for v in whole]
    errors = [sum(d for d, _ in row) for row in picks]
    sums = Counter()
    for (_, _, label), error in zip(kept, errors, strict=True):
        sums[label] += error
    return sorted(((i, "".join(f"{k:02x}" for _, k in row), e if e < 1 << 63 else None, sums[label] if sums[label] < 1 << 63 else None) for (i, _, label), row, e in zip(kept, picks, errors, strict=True)), key=repr), vector_codes.digest(books)


@pytest.mark.parametrize(("size", "scale"), [(16, 0.1), (40, 3.0), (24, 2.0 ** 16.4)])
def test_codes_equal_brute_force(spark, size, scale):
    rng = np.random.default_rng(size)
    table = [(int(k), [float(np.float32(x)) for x in rng.normal(0, scale, size)], int(k % 3) if k % 7 else None) for k in rng.permutation(120)]
    table += [table[3], (500, None, 1), (501, [float("nan")] * size, 1), (502, [None] * size, 1), (503, [float("-inf")] + [0.0] * (size - 1), 1)]
    table += [(600 + k, [0.5] * size, 9) for k in range(20)]
    df = spark.createDataFrame([(*r, "x") for r in table], "vec_id long, embedding array<double>, label int, code string").repartition(5)
    rows = vector_codes.compress(df).collect()
    want, digest = brute_codes(table)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in rows), key=repr) == want
    assert {r["codebooks_sha256"] for r in rows} == {digest}


def test_codes_edges(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], kind)).collect() == []
    rows = vector_codes.compress(spark.createDataFrame([(None, [1.0] * 8, 1), (3, [2.0] * 8, None), (3, [2.0] * 8, None), (9, [1.0], 1)], kind)).collect()
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in rows), key=repr) == [(3, "00" * 8, 0, 0), (3, "00" * 8, 0, 0), (9, None, None, 0), (None, "02" * 8, 0, 0)]
    huge = vector_codes.compress(spark.createDataFrame([(k, [3e38 if k else -3e38] * 8, k) for k in range(3)], kind)).collect()
    assert [(r["code"], r["error"]) for r in sorted(huge)] == [("00" * 8, 0), ("01" * 8, 0), ("01" * 8, 0)]


def test_early_elimination_keeps_the_nearest_entry():
    rng = np.random.default_rng(0)
    for width in (1, 3, 8, 20):
        parts, entries = rng.integers(-5, 5, (3000, width)), rng.integers(-5, 5, (16, width))
        every = ((parts[:, None] - entries[None]) ** 2).sum(2)
        picked, distance = vector_codes.assign(parts, entries)
        assert (picked == every.argmin(1)).all() and (distance == every.min(1)).all()
    h = vector_codes.walsh(16)
    assert (h @ h.T == 16 * np.eye(16, dtype=int)).all() and [int((np.diff(r) != 0).sum()) for r in h] == list(range(16))


def test_packed_segment_round_trip():
    segment = urls.Segment(urls.Segment.pack(np.array([1, 5, 5], np.uint64), [b"a", b"", b"c"], [[0], [2, 3], []]))
    assert segment.find(np.array([5, 5, 1, 9], np.uint64), pa.array([b"c", b"", b"b", b"a"], pa.large_binary())).tolist() == [2, 1, -1, -1]
