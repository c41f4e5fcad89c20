"""Operators beside plain versions of their contracts on the small tables, and accuracy on held-out rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import public_tokenizers
import pyarrow as pa
import pytest

from mailveil.llm import bpe, decontaminate, fixity, jaccard, lines, pitman_yor, quality, secrets, toxicity

SMALL, MEDIUM, LARGE = (f"/root/testdata/{x}" for x in ("sf0.001", "sf0.01", "sf0.1"))
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_tree_concatenation_equals_the_library():
    tool = bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))
    draw = random.Random(3)
    alphabets = ["abcdefg'sstrellmd", "' sre \t\n", "  \n 　 a'b", "éñ漢字🙂😀", "0123456789a", "!?'#$ ..", "the of ing tion "]
    for _ in range(800):
        text = "".join("".join(draw.choice(a) for _ in range(draw.randint(1, 60))) + draw.choice(["", "<|endoftext|>"]) for a in draw.sample(alphabets, 4))
        assert tool.encode([text], leaf=draw.choice([1, 2, 3, 7, 20]))[0].tolist() == tool.library.encode(text, add_special_tokens=False).ids


def test_encoding_in_shards(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tool = bpe.Codec(path)
    out = by_id(bpe.encode_documents(spark.read.parquet(f"{SMALL}/documents.parquet"), path, leaf=300, shard=1500))
    for k, t in texts.items():
        assert out[k]["ids"] == tool.library.encode(t, add_special_tokens=False).ids and out[k]["decoded"] == t


def test_jaccard_components(spark, texts):
    sets = {}
    for k, t in texts.items():
        w = SPACED.findall(lower(t))
        sets[k] = {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    holders = defaultdict(list)
    for k in sorted(sets):
        for j, shared in Counter(j for s in sets[k] for j in holders[s]).items():
            if 100 * shared >= 85 * (len(sets[k]) + len(sets[j]) - shared):
                a, b = sorted((find(k), find(j)))
                root[b] = a
        for s in sets[k]:
            holders[s].append(k)
    want = {k: (len(sets[k]), find(k)) for k in sets}
    for large in (3, 48):  # nearly every region is large, or none is
        out = by_id(jaccard.groups(spark.read.parquet(f"{SMALL}/documents.parquet"), large=large))
        assert {k: (r["n_shingles"], r["component_id"]) for k, r in out.items()} == want


def test_near_copies_of_one_base(spark):
    draw = random.Random(1)
    base = [f"w{k}" for k in range(120)]
    rows = [(0, " ".join(base))]
    for k in range(1, 120):
        w = list(base)
        for _ in range(draw.randint(0, 7)):
            w[draw.randrange(len(w))] = f"x{draw.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    sets = {k: {tuple(t.split()[i:i + 4]) for i in range(117)} for k, t in rows}
    root = list(range(120))
    changed = True
    while changed:
        changed = False
        for a in range(120):
            for b in range(a):
                if root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
                    changed = True
    out = by_id(jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string"), large=10))
    assert [out[k]["component_id"] for k in range(120)] == root


@pytest.mark.parametrize("module", [decontaminate, fixity])
def test_sql(spark, module):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{MEDIUM}/{table}.parquet'")
    df = module.query(spark, MEDIUM)
    want = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in df.columns)} FROM ({module.SQL})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, want))


def test_line_rules(spark, texts):
    out = by_id(lines.query(spark, SMALL))
    for k, t in texts.items():
        w = SPACED.findall(t)
        runs = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if runs[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        own = [x for x in t.split("\n") if SPACED.search(x)]
        r = out[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(own) - len(set(own)), len(hit))
        assert r["base_failed"] == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and not (r["base_failed"] and r["kept"])


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    field = lines.Field(np.linspace(-1, 1, lines.N_FEATURES), np.array([[0.4, -0.3], [-0.6, 0.5]]))
    draw = random.Random(2)
    for _ in range(20):
        seq = [[draw.randrange(lines.N_FEATURES) for _ in range(3)] for _ in range(6)]
        value = lambda ys: sum(field.weights[a].sum() * y for a, y in zip(seq, ys, strict=True)) + sum(field.moves[a, b] for a, b in zip(ys, ys[1:], strict=False))  # noqa: E731, B023
        assert tuple(map(int, field.boilerplate(seq))) == max(itertools.product((0, 1), repeat=6), key=value)


@pytest.mark.parametrize("head", [200_000, 500])
def test_language_model_base_and_gain(spark, texts, head, monkeypatch):
    monkeypatch.setattr(pitman_yor, "HEAD", head)
    out = by_id(pitman_yor.query(spark, SMALL))
    tokens = {k: [*SPACED.findall(lower(t)), None] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in texts}
    counts = Counter(w for k in texts if not held[k] for w in tokens[k])
    total, kinds = sum(counts.values()), len(counts)
    for k, r in out.items():
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(tokens[k]), sum(w in counts for w in tokens[k]), total)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens[k]), rel_tol=1e-9)
    assert sum(r["score"] for r in out.values() if r["held_out"]) > sum(r["base_score"] for r in out.values() if r["held_out"])


def test_contexts_are_the_most_frequent_words_of_all_slices(spark, monkeypatch):
    """A word that is never among a slice's own most frequent ones may still be the most frequent of all."""
    monkeypatch.setattr(pitman_yor, "SLICE", 1)  # a text is a slice
    texts = spark.createDataFrame([(" ".join(["common", *(f"w{k}x{j} w{k}x{j}" for j in range(200))]),) for k in range(30)], "text string")
    assert pitman_yor.frequent_words(texts)[0] == pitman_yor.words.word_hashes(pa.array(["common"]), pitman_yor.words.SPACED)[0][0]


def test_predictive_probabilities_sum_to_one(spark):
    texts = spark.createDataFrame([(k, f"a b c{k % 7} a d{k % 3}") for k in range(40)], "doc_id long, text string").select("text")
    seated, state = pitman_yor.seat(pitman_yor.counts(texts, pitman_yor.frequent_words(texts)))
    found = seated.collect()
    for u in range(pitman_yor.BEGIN + 1):
        mass = sum(dict(zip(r["us"], r["adds"], strict=True)).get(u, 0.0) + state.back_off[u] * r["p0"] for r in found) + state.back_off[u] * state.unknown
        assert abs(mass - 1) < 0.1  # totals are those of the sweep before


@pytest.mark.parametrize(("module", "label", "least"), [(toxicity, "toxic", 0.97), (quality, "quality", 0.97)])
def test_held_out_accuracy(spark, module, label, least):
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{LARGE}/labels.parquet").collect()}
    held = [r for r in module.query(spark, LARGE).collect() if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= least * len(held) and all(0 <= r["score"] <= 1 for r in held)


def test_secret_base(spark, texts):
    pattern = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    out = by_id(secrets.query(spark, SMALL))
    for k, t in texts.items():
        found = [(m.start(), 0, m.end(), "assign") for m in pattern.finditer(t) if len(m[1]) >= 8]
        found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        joined = ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(found))
        assert out[k]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and set(filter(None, joined.split(","))) <= set(out[k]["spans"].split(","))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    left = docs
    for _, work in corpus_pipeline.STAGES[:-1]:
        left = corpus_pipeline.rows.stage(work(spark, left, SMALL))
        assert left.columns == docs.columns
    kept = {r["doc_id"]: r["text"] for r in left.collect()}
    out = by_id(corpus_pipeline.run(spark, SMALL))
    assert out.keys() == kept.keys() and 0 < len(kept) < docs.count()
    assert all(out[k]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for k, t in kept.items())
    assert all(not secrets.spans(t)[0] for t in kept.values())
