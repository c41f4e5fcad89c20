"""Queries over the stand-in mail traffic, and their reference SQL: what each kind of dialogue was written to mean."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtures import capture_files, mail
from mailveil.plans import views
from mailveil.plans.mail import MailAnalysis, MailTraffic
from mailveil.session import cut_lineage, shared_folder
from mailveil.sources import ranges

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHUNK = 64  # small chunks, so that dialogues cross chunk borders


def query(build):
    QUERIES[build.__name__] = build
    return build


@lru_cache(maxsize=4)
def traffic(spark: SparkSession, d: str) -> MailTraffic:
    segments = views.view(spark, d, "v_mail_segments").withColumn("payload", F.unhex("payload_hex")).drop("payload_hex", "from_client")
    return MailTraffic(cut_lineage(segments), CHUNK)


def _text(column: str, sep: str = " | ") -> F.Column:
    return F.array_join(column, sep).alias(column)


@query
def mail_sessions(spark, d):
    return traffic(spark, d).sessions.select(
        "capture_id", "session_id", "client_ip", "client_port", "endpoint_key", "protocol", "mode", "identified_by", "one_sided", "server_name", "greeting_verb", _text("capabilities", " "),
        "starttls_offered", "starttls_requested", "starttls_response", F.col("tls_client_offset").cast("bigint").alias("tls_client_offset"), F.col("tls_server_offset").cast("bigint").alias("tls_server_offset"),
        F.col("cleartext_message_bytes").alias("message_bytes"), _text("cleartext_commands", " "), _text("strip_indicators"), _text("injection_indicators"))


@query
def mail_auth_events(spark, d):
    return traffic(spark, d).sessions.select("capture_id", "session_id", F.explode("auth_events").alias("e")).select("capture_id", "session_id", "e.*")


@query
def mail_unclassified_flows(spark, d):
    return traffic(spark, d).unclassified


@query
def mail_flow_totals(spark, d):
    return traffic(spark, d).totals


CERTIFICATES = [(b"leaf", "CN=mx.example.org", "CN=top", False, "RSA", 2048, "mx.example.org"), (b"top", "CN=top", "CN=top", True, "RSA", 2048, "")]


@lru_cache(maxsize=4)
def analysis(spark: SparkSession, d: str) -> MailAnalysis:
    facts = [(hashlib.sha256(der).hexdigest(), subject, issuer, own, kind, bits, "sha256", [names] if names else [], own, True, True, ["digital_signature"], None, 0, 1_200_000_000, True) for der, subject, issuer, own, kind, bits, names in CERTIFICATES]
    known = spark.createDataFrame(facts, "sha256 string, subject string, issuer string, self_signed boolean, key_type string, key_bits int, signature_hash string, sans array<string>, is_ca boolean, eku_server_auth boolean, has_sct boolean, key_usage array<string>, der_error string, not_before long, not_after long, signed_by_next boolean")
    anchors = spark.createDataFrame([("CN=top",)], "subject string")
    return MailAnalysis(traffic(spark, d), known, anchors, spark.createDataFrame([("default", 1.0)], "asset string, weight double"))


@query
def mail_handshakes(spark, d):
    t = traffic(spark, d)
    return t.handshakes.select("capture_id", "session_id", "client_hello_seen", "server_hello_seen", "version", "cipher_suite", "sni", _text("alpn", ","), F.array_join(F.col("signature_algorithms").cast("array<string>"), ",").alias("signature_algorithms"),
                               "hello_retry", _text("errors"), "complete", "secure_renegotiation", "extended_master_secret")


@query
def mail_message_order(spark, d):
    return traffic(spark, d).message_order.select("capture_id", "session_id", "dir", _text("flow", " > "))


@query
def mail_certificates(spark, d):
    return traffic(spark, d).certificates.select("capture_id", "session_id", F.col("position").cast("bigint").alias("position"), "sha256")


@query
def mail_transcript(spark, d):
    return traffic(spark, d).transcript.select("capture_id", "session_id", "ordinal", "dir", "kind", "text", "lo", "hi")


@query
def mail_transcript_frames(spark, d):
    return traffic(spark, d).transcript_frames


@query
def mail_findings(spark, d):
    return analysis(spark, d).findings.select("capture_id", "session_id", "endpoint", "rule_id", "severity")


@query
def mail_posture(spark, d):
    """Grade and score of every capture, from its packets, after baseline and escalation."""
    return analysis(spark, d).posture


@query
def mail_priorities(spark, d):
    """All findings ranked within their capture; session ids are texts to the end."""
    return analysis(spark, d).ranked.select("capture_id", "priority", "session_id", "rule_id", "severity", "risk")


@query
def capture_range_frames(spark, d):
    """All frames of whole capture files, read by ranges of 64 KiB that begin in the middle of records."""
    folder = f"{shared_folder(spark)}/captures-{uuid.uuid4().hex}"
    capture_files.write_files(cut_lineage(views.view(spark, d, "v_frames")), folder)
    rows = ranges.frames(spark, folder, range_bytes=1 << 16)
    return rows.select(F.regexp_extract("capture_id", r"([^/]+)\.pcap(ng)?$", 1).alias("capture_id"), "frame", "ts_ns", "linktype",
                       F.md5("data").alias("data_hash"), "note")


# --------------------------------------------------------------------------- reference SQL
def _value(value) -> str:
    return "NULL" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def _quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _by_kind(name: str, render: Callable) -> str:
    return "CASE kind " + " ".join(f"WHEN {k} THEN {render(x.meant[name])}" for k, x in enumerate(mail.KINDS) if x.meant) + " END"


def _commands(text: str) -> str:
    """`A<x>B` repeats ' x' once for each fill between A and B."""
    if "<" not in text:
        return _quoted(text)
    before, rest = text.split("<")
    middle, after = rest.split(">")
    return f"concat({_quoted(before)}, repeat({_quoted(' ' + middle)}, cast(n AS int)), {_quoted(' ' + after.lstrip())})"


MAIL_KINDS = ", ".join(str(k) for k, x in enumerate(mail.KINDS) if x.meant)
SESSIONS = views.with_clause(["v_mail"]) + f""", numbered AS (
  SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY ts, k) AS session_no FROM v_mail WHERE kind IN ({MAIL_KINDS})),
named AS (SELECT *, concat('S', lpad(cast(session_no AS varchar), cast(greatest(3, length(cast(session_no AS varchar))) AS int), '0')) AS session_id FROM numbered)"""

SQL = {
    "capture_range_frames": views.with_clause(["v_frames"]) + f""" SELECT capture_id, row_number() OVER (PARTITION BY capture_id ORDER BY frame) AS frame, ts * 1000000000 AS ts_ns, {capture_files.LINKTYPE} AS linktype,
  md5(unhex(data_hex)) AS data_hash, NULL AS note FROM v_frames""",
    "mail_sessions": SESSIONS + f""" SELECT capture_id, session_id, client_ip, client_port, concat(server_ip, ':', server_port) AS endpoint_key, {", ".join(
        f"{_by_kind(name, render)}{cast} AS {out}" for name, render, cast, out in [
            ("protocol", _quoted, "", "protocol"), ("mode", _quoted, "", "mode"), ("identified_by", _quoted, "", "identified_by"), ("one_sided", _value, "", "one_sided"), ("server_name", _quoted, "", "server_name"),
            ("greeting_verb", _quoted, "", "greeting_verb"), ("capabilities", _quoted, "", "capabilities"), ("starttls_offered", _value, "::boolean", "starttls_offered"), ("starttls_requested", _value, "", "starttls_requested"),
            ("starttls_response", _quoted, "", "starttls_response"), ("tls_client_offset", _value, "::bigint", "tls_client_offset"), ("tls_server_offset", _value, "::bigint", "tls_server_offset"),
            ("message_bytes", _value, "::bigint", "message_bytes"), ("commands", _commands, "", "cleartext_commands"), ("strip", _quoted, "", "strip_indicators"),
            ("inject", lambda x: x if x.startswith("CASE") else _quoted(x), "", "injection_indicators")])} FROM named""",
    "mail_auth_events": SESSIONS + f""" SELECT capture_id, session_id, split_part(a, ' ', 1) AS mechanism, split_part(a, ' ', 2) AS username, split_part(a, ' ', 3) = 'true' AS secret_exposed, split_part(a, ' ', 4) = 'true' AS accepted
  FROM (SELECT *, {_by_kind('auth', _quoted)} AS a FROM named) WHERE a <> ''""",
    "mail_unclassified_flows": views.with_clause(["v_mail"]) + f""" SELECT capture_id, concat(client_ip, ':', client_port) AS client, concat(server_ip, ':', server_port) AS server, length(client_hex) // 2 AS client_bytes, length(server_hex) // 2 AS server_bytes,
  cast(2 + ceil(length(client_hex) / {2 * mail.SEGMENT}.0) + ceil(length(server_hex) / {2 * mail.SEGMENT}.0) + CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END AS bigint) AS frames, 'no known mail protocol on either side' AS reason FROM v_mail WHERE kind = 12""",
    "mail_flow_totals": views.with_clause(["v_mail"]) + f" SELECT capture_id, count(*) AS flows, count(*) FILTER (WHERE kind IN ({MAIL_KINDS})) AS mail_sessions, count(*) FILTER (WHERE kind NOT IN ({MAIL_KINDS})) AS non_mail_flows FROM v_mail GROUP BY capture_id",
    "mail_handshakes": SESSIONS + """ SELECT capture_id, session_id, true AS client_hello_seen, true AS server_hello_seen, 771::bigint AS version, 49199::bigint AS cipher_suite, 'mx.example.org' AS sni, 'smtp' AS alpn, '1027' AS signature_algorithms,
  false AS hello_retry, '' AS errors, kind <> 4 AS complete, true AS secure_renegotiation, true AS extended_master_secret FROM named WHERE kind IN (1, 4, 8, 9)""",
    "mail_message_order": SESSIONS + """ SELECT capture_id, session_id, dir, concat(CASE dir WHEN 'C' THEN 'ClientHello' ELSE 'ServerHello > Certificate' END, CASE WHEN kind <> 4 THEN concat(' > ChangeCipherSpec > encrypted records ×',
  CASE kind WHEN 1 THEN CASE dir WHEN 'C' THEN 3 ELSE 2 END WHEN 8 THEN 1 ELSE 2 END) ELSE '' END) AS flow FROM named, (VALUES ('C'), ('S')) AS t(dir) WHERE kind IN (1, 4, 8, 9)""",
    "mail_certificates": SESSIONS + """ SELECT capture_id, session_id, position::bigint AS position, sha256(name) AS sha256 FROM named, (VALUES (0, 'leaf'), (1, 'top')) AS t(position, name) WHERE kind IN (1, 4, 8, 9)""",
    "mail_findings": SESSIONS + f""", hits(kind, rule_id, severity, least_n) AS (VALUES {", ".join(f"({kind}, '{rule}', '{level}', {least})" for kind, rule, level, least in mail.FINDINGS)})
SELECT capture_id, session_id, concat(coalesce({_by_kind('server_name', _quoted)}, server_ip), ':', server_port) AS endpoint, rule_id, severity FROM named JOIN hits USING (kind) WHERE n >= least_n""",
}
