"""Hand cases for text rules, certificate names, scores, models and sinks."""

import itertools
import json
import math

import pytest
from pyspark.sql import functions as F

from mailveil import dims
from mailveil.functions import net
from mailveil.functions import text as tx
from mailveil.operators import certificates, models, scoring
from mailveil.sources import captures, history, sinks


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*columns).collect()]


def test_mangled_tokens(spark):
    cases = [("XXXXXXXX", True), ("STARTTLS", False), ("STARTTLX", True), ("STARXXXS", True), ("PIPELINE", False), ("SIZE", False)]
    got = values(spark, [(t,) for t, _ in cases], "t string", tx.looks_mangled(F.col("t"), "STARTTLS"))
    assert [g[0] for g in got] == [e for _, e in cases]


def test_redaction_never_echoes_a_secret(spark):
    lines = ["PASS hunter2", "AUTH PLAIN AGEAYg==", "a1 LOGIN bob secret", "EHLO host", "AGFsaWNlAHMzY3JldA=="]
    got = [g[0] for g in values(spark, [(x,) for x in lines], "x string", tx.safe_line(F.col("x")))]
    assert got == ["PASS [redacted]", "AUTH PLAIN [redacted]", "a1 LOGIN [redacted]", "EHLO host", "[redacted SASL token]"]


@pytest.mark.parametrize("host,pattern,expected", [
    ("mx.a.com", "*.a.com", True), ("x.y.a.com", "*.a.com", False), ("a.com", "*.a.com", False),
    ("mx.a.com", "m*.a.com", False), ("a.com", "*.com", False), ("mx.a.com", "mx.a.com", True)])
def test_wildcards(spark, host, pattern, expected):
    assert values(spark, [(host, pattern)], "h string, p string", certificates.dns_match(F.col("h"), F.col("p"))) == [(expected,)]


def test_private_addresses_match_the_standard_library(spark):
    import ipaddress
    ips = ["10.1.2.3", "172.15.0.1", "172.16.0.1", "172.31.9.9", "172.32.0.1", "192.0.0.9", "192.0.0.8", "192.0.2.7", "192.0.1.7", "198.17.0.1",
           "198.19.0.1", "198.51.100.7", "203.0.113.9", "239.1.1.1", "240.0.0.1", "8.8.8.8", "100.64.0.1", "169.254.1.1", "::1", "fd00::1", "fe80::1",
           "febf::1", "fec0::1", "2001:db8::5", "2001:4860::1", "2001:10::1", "2002::1", "2606:4700::1", "not an ip"]
    got = values(spark, [(x,) for x in ips], "x string", "x", net.is_private(F.col("x")))
    for ip, private in got:
        assert private == (ip != "not an ip" and ipaddress.ip_address(ip).is_private), ip


def test_one_critical_caps_the_posture(spark):
    findings = spark.createDataFrame([("c", "STRIP-001", "e:25", "critical")], "capture_id string, rule_id string, endpoint string, severity string")
    flags = spark.createDataFrame([("c", 1, False, False)], "capture_id string, sessions long, cleartext_content boolean, unverified_tls boolean")
    caps = spark.createDataFrame([("c",), ("empty",)], "capture_id string")
    rows = {r.capture_id: r for r in scoring.posture(caps, flags, findings).collect()}
    assert (rows["c"].earned_score, rows["c"].score, rows["c"].grade) == (70, 59, "F")
    assert rows["empty"].score is None and rows["empty"].grade == "—" and not rows["empty"].assessed


def test_suite_grades(spark):
    grades = {r.suite: r.grade for r in dims.cipher_suites(spark).collect()}
    assert grades["TLS_AES_128_GCM_SHA256"] == "A" and grades["TLS_RSA_WITH_AES_128_CBC_SHA"] == "C"
    assert grades["TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA"] == "B" and grades["TLS_RSA_WITH_3DES_EDE_CBC_SHA"] == "F"


def test_shapley_equals_brute_force(spark):
    base = {f: dims.FEATURE_REFERENCE.get(f, 0.0) for f in dims.FEATURES}
    row = {**base, "tls_version": 2.0, "injection": 1.0, "cleartext_auth": 1.0, "overlap_conflicts": 0.4}

    def f(v):
        return v["tls_version"] * (1 + 3 * v["injection"]) + 10 * v["cleartext_auth"] * v["overlap_conflicts"] + v["injection"]

    groups = [(g, n) for g, n in dims.FEATURE_GROUPS if any(row[x] != base[x] for x in n)]
    expected = {}
    for g, names in groups:
        others, phi = [x for x in groups if x[0] != g], 0.0
        for size in range(len(others) + 1):
            for chosen in itertools.combinations(others, size):
                have = {**base, **{x: row[x] for _, ns in chosen for x in ns}}
                w = math.factorial(size) * math.factorial(len(groups) - size - 1) / math.factorial(len(groups))
                phi += w * (f({**have, **{x: row[x] for x in names}}) - f(have))
        expected[g] = phi
    df = spark.createDataFrame([("c", 1, *[row[x] for x in dims.FEATURES])], "capture_id string, session_id long, " + ", ".join(f"{x} double" for x in dims.FEATURES))
    score = lambda d: d.withColumn("f", F.expr("tls_version * (1 + 3 * injection) + 10 * cleartext_auth * overlap_conflicts + injection"))
    got = {r.feature_group: r.phi for r in models.shapley(df, score).collect()}
    assert got.keys() == expected.keys()
    assert all(abs(got[g] - expected[g]) < 1e-5 for g in got)
    assert abs(sum(got.values()) - (f(row) - f(base))) < 1e-5


def test_history_learns_each_session_once(spark, tmp_path):
    rows = spark.createDataFrame([("c", 1, "e", 10, True), ("c", 2, "e", 20, False), ("c", 1, "e", 10, True)],
                                 "capture_id string, session_id long, endpoint_key string, ts long, clean boolean")
    path = str(tmp_path / "history")
    history.learn(rows, path)
    history.learn(rows, path)
    assert [r.session_id for r in history.read_history(spark, path).collect()] == [1]


def test_capture_files_and_sinks(spark, tmp_path):
    import gzip
    import struct
    body = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + struct.pack("<IIII", 5, 7, 4, 4) + b"\1\2\3\4"
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one.pcap.gz").write_bytes(gzip.compress(body))
    (tmp_path / "two.pcap").write_bytes(body + b"\0\0")
    (tmp_path / "note.txt").write_text("no capture")
    files = captures.captures(spark, str(tmp_path))
    assert files.count() == 2
    status = captures.capture_status(files).collect()
    assert sorted(r.compression for r in status) == ["", "gzip"] and all(r.error is None for r in status)
    rows = captures.frames(files).collect()
    assert sorted((r.frame, r.ts_ns) for r in rows if r.note is None) == [(1, 5_000_007_000)] * 2
    assert [r.note for r in rows if r.note] == ["file ends mid-record header; trailing bytes ignored"]
    (tmp_path / "assets.json").write_text(json.dumps({"10.0.0.1": 1.5, "default": 0.5}))
    assert {r.asset: r.weight for r in sinks.load_assets(spark, str(tmp_path / "assets.json")).collect()} == {"10.0.0.1": 1.5, "default": 0.5}
    audit = spark.createDataFrame([("c", 59)], "capture_id string, score int")
    sinks.append_audit(audit, str(tmp_path / "audit"))
    sinks.append_audit(audit, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 2


def test_history_follows_a_stream(spark, tmp_path):
    from mailveil.streaming.history import learn_stream, observation_stream
    rows = spark.createDataFrame([("c", i, "e", 10 * i, i % 2 == 0) for i in range(6)],
                                 "capture_id string, session_id long, endpoint_key string, ts long, clean boolean")
    rows.write.parquet(str(tmp_path / "in"))
    for run in ("one", "two"):   # a second query over the same files must add nothing
        stream = observation_stream(spark, str(tmp_path / "in"), rows.schema)
        learn_stream(stream, str(tmp_path / "out"), str(tmp_path / run)).awaitTermination()
    assert sorted(r.session_id for r in history.read_history(spark, str(tmp_path / "out")).collect()) == [0, 2, 4]
