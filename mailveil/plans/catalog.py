"""Every registered query, by area. Each takes (spark, folder) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailveil import dims
from mailveil.functions import text as tx
from mailveil.operators import baseline, certificates, contributions, dialogue, flows, handshake, imap, models, packets, rules, scoring, smtp
from mailveil.operators.ordered import number_rows
from mailveil.plans import reports, views
from mailveil.plans.corpus import AS_OF, Analysis, Streams, history_and_current
from mailveil.session import cut_lineage
from mailveil.sources import captures, frames, history, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def text(col: str, sep: str = " | ") -> F.Column:
    return F.array_join(col, sep).alias(col)


# --------------------------------------------------------------------------- rules
def _finding_rows(df: DataFrame) -> DataFrame:
    return df.select("capture_id", "session_id", "endpoint", "rule_id", "severity", text("evidence"),
                     "exploitability", "confidence")


@query
def rules_transport(spark, d):
    a = Analysis(spark, d)
    return _finding_rows(rules.evaluate(a.facts, rules.TRANSPORT))


@query
def rules_handshake(spark, d):
    a = Analysis(spark, d)
    return _finding_rows(rules.evaluate(a.facts, rules.HANDSHAKE, credentials=False))


@query
def rules_certificate(spark, d):
    a = Analysis(spark, d)
    return _finding_rows(rules.evaluate(a.facts, rules.CERTIFICATE, credentials=False))


@query
def rule_fire_counts(spark, d):
    return rules.fire_counts(Analysis(spark, d, staged=True).all_findings)


@query
def cipher_suite_profiles(spark, d):
    used = views.view(spark, d, "v_handshakes").groupBy(F.col("cipher_suite").alias("code")).agg(
        F.count("*").alias("sessions"))
    return dims.cipher_suites(spark).join(used, "code", "left").select(
        F.col("code").cast("bigint").alias("code"), "suite", "kx", "enc", "mac", "forward_secrecy", "aead", "tls13",
        text("weaknesses", ","), "grade", F.coalesce("sessions", F.lit(0)).alias("sessions"))


@query
def certificate_chains(spark, d):
    a = Analysis(spark, d)
    return a.chains.select(
        "capture_id", "session_id", "present", F.col("n_certs").cast("bigint").alias("n_certs"), "absent_kind",
        "hostname", "expired", "not_yet_valid", "days_to_expiry", "self_signed", "hostname_match",
        "chain_links_ok", "trusted", "trust_detail")


# --------------------------------------------------------------------------- baseline
def _deviation_rows(df: DataFrame) -> DataFrame:
    return df.select("capture_id", "session_id", "endpoint_key", "code", "rule_id", "severity", "exploitability", text("evidence"))


@query
def baseline_observations(spark, d):
    a = Analysis(spark, d)
    return a.observations.select(
        "capture_id", "session_id", "endpoint_key", "starttls_offered", "tls_used", "version", "cipher", "grade",
        "ja3s", "cert_fp", "cert_issuer", "self_signed", "trusted", "clean")


@query
def baseline_deviations(spark, d):
    history, current = history_and_current(spark, d)
    return _deviation_rows(baseline.deviations(current, history))


@query
def baseline_escalation(spark, d):
    a = Analysis(spark, d, staged=True)
    rows = baseline.escalate(a.findings, a.deviations)
    return rows.where("escalated_from IS NOT NULL").select(
        "capture_id", "session_id", "rule_id", "severity", "escalated_from")


@query
def baseline_session_deviations(spark, d):
    a = Analysis(spark, d, staged=True)
    return _deviation_rows(a.deviations)


@query
def baseline_clean_final(spark, d):
    a = Analysis(spark, d, staged=True)
    found = a.deviations
    return baseline.settle_clean(a.observations, a.all_findings, found).select(
        "capture_id", "session_id", "clean")


@query
def endpoint_profiles(spark, d):
    rows = baseline.endpoint_profiles(views.view(spark, d, "v_observations"))
    entries = F.transform(F.map_entries("versions"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.withColumn("versions", F.coalesce(F.array_join(entries, ","), F.lit("")))


@query
def endpoint_mixed_offers(spark, d):
    return baseline.mixed_offers(views.view(spark, d, "v_observations"))


@query
def history_unlearned(spark, d):
    stored, current = history_and_current(spark, d)
    repeated = current.unionByName(current)   # a repeated run must add nothing
    known = stored.unionByName(current.where(F.col("session_id") % 10 == 0))
    return history.unlearned(repeated, known).select("capture_id", "session_id", "endpoint_key")


@query
def history_newest_features(spark, d):
    rows = views.view(spark, d, "v_observations").withColumn(
        "features", F.when(F.col("grade").isNotNull(), F.array(F.col("version").cast("double")))
        .otherwise(F.array().cast("array<double>")))
    return history.feature_history(rows).select("capture_id", "session_id", "ts")


@query
def history_of_endpoint(spark, d):
    return history.endpoint_history(views.view(spark, d, "v_observations"), "203.0.113.8:25").select(
        "capture_id", "session_id", "ts", "tls_used", "version")


# --------------------------------------------------------------------------- features
@query
def session_feature_vector(spark, d):
    a = Analysis(spark, d, staged=True)
    return a.features


# --------------------------------------------------------------------------- scoring
@query
def finding_risk(spark, d):
    a = Analysis(spark, d, staged=True)
    return a.scored.select("capture_id", "session_id", "rule_id", F.round("exposure", 4).alias("exposure"),
                                          "criticality", "risk")


@query
def session_risk(spark, d):
    a = Analysis(spark, d, staged=True)
    risk = scoring.session_rule_risk(a.sessions, a.all_findings)
    model = F.when(F.col("session_id") % 3 != 0, (F.col("session_id") % 101).cast("double"))
    outlier = F.col("session_id") % 17 == 0
    return risk.select("*", scoring.blend(F.col("rule_risk"), model, outlier).alias("risk"))


@query
def finding_priority(spark, d):
    a = Analysis(spark, d, staged=True)
    return a.ranked.select("capture_id", "session_id", "rule_id", "severity", "risk", "priority")


@query
def unique_issues(spark, d):
    a = Analysis(spark, d, staged=True)
    return scoring.unique_issues(scoring.merge_rule_ids(a.all_findings))


@query
def severity_counts(spark, d):
    a = Analysis(spark, d, staged=True)
    return scoring.severity_counts(a.all_findings, ["capture_id"])


@query
def endpoint_scores(spark, d):
    a = Analysis(spark, d, staged=True)
    return scoring.endpoint_scores(a.sessions, a.all_findings).withColumn(
        "score", F.col("score").cast("bigint"))


@query
def posture_by_capture(spark, d):
    a = Analysis(spark, d, staged=True)
    rows = a.posture
    return rows.select("capture_id", "sessions", "assessed", F.col("score").cast("bigint").alias("score"), "grade",
                       F.col("earned_score").cast("bigint").alias("earned_score"), "unique_issues", *dims.SEVERITIES,
                       text("floor_reasons"))


@query
def capture_flags(spark, d):
    a = Analysis(spark, d)
    return scoring.capture_flags(a.facts)


@query
def severity_gate(spark, d):
    return scoring.severity_gate(Analysis(spark, d, staged=True).all_findings, "critical")


# --------------------------------------------------------------------------- flows and streams
CHUNK = 64   # small chunks, so that the stand-in streams cross chunk borders


def _end(name: str) -> F.Column:
    return F.concat(F.col(f"{name}.ip"), F.lit(":"), F.col(f"{name}.port"))


def _pair() -> list[F.Column]:
    return [F.concat(F.col("conv_key.a.ip"), F.lit(":"), F.col("conv_key.a.port")).alias("side_a"),
            F.concat(F.col("conv_key.b.ip"), F.lit(":"), F.col("conv_key.b.port")).alias("side_b"), "conv_no"]


@query
def flow_conversations(spark, d):
    return Streams(spark, d).conversations.select("capture_id", "frame", *_pair())


@query
def flow_roles(spark, d):
    return Streams(spark, d, staged=True).roles.select(
        "capture_id", *_pair(), _end("client").alias("client"), _end("server").alias("server"), "role_reason", "handshake_seen")


@query
def stream_offsets(spark, d):
    return Streams(spark, d, staged=True).placed.select("capture_id", *_pair(), "dir", "frame", "off", "len")


@query
def stream_spans(spark, d):
    return Streams(spark, d, staged=True).spans.select("capture_id", *_pair(), "dir", "span_off", "span_len", "frame")


@query
def stream_bytes(spark, d):
    return Streams(spark, d, staged=True, chunk_bytes=CHUNK).streams.select(
        "capture_id", *_pair(), "dir", "chunk", "off", "hex_bytes")


@query
def stream_statistics(spark, d):
    return Streams(spark, d, staged=True, chunk_bytes=CHUNK).stats.select(
        "capture_id", *_pair(), "dir", "segments", "retransmissions", "out_of_order", "overlaps_trimmed",
        "overlap_conflicts", "gaps", "bytes")


@query
def flow_records(spark, d):
    return Streams(spark, d, staged=True, chunk_bytes=CHUNK).flows.select(
        "capture_id", *_pair(), _end("client").alias("client"), _end("server").alias("server"), "start_ts", "end_ts", "frames",
        "client_bytes", "server_bytes", "client_gaps", "server_gaps", "client_retransmissions", "server_retransmissions",
        "client_overlap_conflicts", "server_overlap_conflicts")


@query
def frames_for_byte_ranges(spark, d):
    s = Streams(spark, d, staged=True)
    ranges = s.spans.select(*flows.STREAM).distinct().select(
        *flows.STREAM, F.explode(F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in (
            (0, 10), (20, 60), (100, 101), (30, 30))])).alias("r")).select(*flows.STREAM, "r.lo", "r.hi")
    return flows.frames_for_range(s.spans, ranges, flows.STREAM, bucket=CHUNK).select(
        "capture_id", *_pair(), "dir", F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"), text("frames", ","))


@query
def session_numbers(spark, d):
    return Streams(spark, d, staged=True, chunk_bytes=CHUNK).numbered.select("capture_id", *_pair(), "session_no", "session_id")


@query
def unclassified_flows(spark, d):
    s = Streams(spark, d, staged=True, chunk_bytes=CHUNK)
    return flows.unclassified(s.flows, s.mail_flows)


@query
def flow_totals(spark, d):
    s = Streams(spark, d, staged=True, chunk_bytes=CHUNK)
    return flows.flow_totals(s.flows, s.mail_flows)


# --------------------------------------------------------------------------- packets
@query
def packet_list(spark, d):
    return Streams(spark, d, staged=True, chunk_bytes=CHUNK).packets.select(
        "capture_id", "position", "frame", "src", "sport", "dst", "dport", "proto", "service", "flags", "len", "session_id",
        "info", "truncated")


@query
def packet_filter_counts(spark, d):
    return packets.packet_filters(Streams(spark, d, staged=True, chunk_bytes=CHUNK).packets)


@query
def packet_times(spark, d):
    convs = Streams(spark, d).segments.where(F.col("ts") % 172800 == 0)
    near = Streams(spark, d).segments.where(F.col("ts") % 172800 != 0).select(
        F.concat("capture_id", F.lit("/"), F.floor(F.col("ts") / 864000)).alias("capture_id"), "frame",
        (F.floor(F.col("ts") / 864000) * 864000 + F.pmod(F.col("frame"), F.lit(40000)) / 2).alias("ts"))
    both = convs.select("capture_id", "frame", F.col("ts").cast("double").alias("ts")).unionByName(near)
    return packets.with_times(both).select("capture_id", "frame", "time_text")


# --------------------------------------------------------------------------- dialogue
def _document_lines(spark: SparkSession, d: str) -> DataFrame:
    """Every line of every document, read as chunked streams."""
    docs = views.table(spark, d, "documents").select(F.col("doc_id").alias("stream_id"), "text")
    return dialogue.stream_lines(dialogue.cut_text(docs, ["stream_id"], 4096), ["stream_id"])


@query
def dialogue_lines(spark, d):
    return _document_lines(spark, d).select(
        "stream_id", "line_no", F.col("off").cast("bigint").alias("off"), F.md5("line").alias("line_hash"), "complete")


@query
def dialogue_reply_groups(spark, d):
    code = (200 + 50 * (F.col("line_no") % 3)).cast("string")
    wire = _document_lines(spark, d).withColumn("line", F.concat(
        code, F.when(F.col("line_no") % 4 != 3, "-").otherwise(" "), "line"))
    return dialogue.smtp_replies(wire, ["stream_id"]).select(
        "stream_id", "reply_no", "code", "lines", F.md5("reply").alias("reply_hash"), F.col("off").cast("bigint").alias("off"))


@query
def dialogue_turn_pairs(spark, d):
    rows = views.view(spark, d, "v_dialogue").withColumn("_part", F.floor(F.col("ordinal") / 1024))
    sides = {s: number_rows(rows.where(F.col("dir") == s), ["session_id"], ["ordinal", "text"], "_part", "turn").select(
        "session_id", "turn", F.md5("text").alias(name)) for s, name in (("C", "command"), ("S", "reply"))}
    return dialogue.pair_turns(sides["C"], sides["S"], ["session_id"])


@query
def dialogue_transcript(spark, d):
    kinds = F.array(*[F.lit(k) for k in ("cmd", "reply", "auth", "banner", "caps")])
    events = _document_lines(spark, d).select(
        "stream_id", F.col("line_no").alias("ordinal"), F.when(F.col("line_no") % 2 == 0, "C").otherwise("S").alias("dir"),
        F.element_at(kinds, (F.col("line_no") % 5 + 1).cast("int")).alias("kind"),
        F.when(F.col("line_no") % 10 == 2, F.concat(F.lit("AUTH PLAIN "), "line")).otherwise(F.col("line")).alias("text"))
    return dialogue.transcript(events, ["stream_id"])


@query
def redacted_lines(spark, d):
    verbs = F.array(*[F.lit(v) for v in ("PASS ", "AUTH PLAIN ", "a1 LOGIN ", "auth scram-sha-256 ", "EHLO ", "  user ", "x.9 authenticate login ", "")])
    lines = _document_lines(spark, d)
    text_col = F.concat(F.element_at(verbs, (F.col("line_no") % 8 + 1).cast("int")), "line")
    blob = F.when(F.col("line_no") % 16 == 15, F.base64(F.encode(F.md5("line"), "UTF-8"))).otherwise(text_col)
    return lines.select("stream_id", "line_no", F.md5(tx.safe_line(blob)).alias("shown_hash"))


@query
def protocol_identification(spark, d):
    h = views.view(spark, d, "v_heads")
    found = tx.identify(F.col("client_head"), F.col("server_head"), F.col("server_port"))
    return h.select("session_id", found.alias("f"), tx.hostname_from(F.regexp_replace("server_head", r"^(220[ -]|\* OK |\+OK )", "")).alias("server_name")).select(
        "session_id", "f.protocol", "f.mode", "f.identified_by", "server_name")


@query
def mangled_capabilities(spark, d):
    h = views.view(spark, d, "v_heads")
    protocol = F.when(F.col("session_id") % 3 == 0, "SMTP").when(F.col("session_id") % 3 == 1, "IMAP").otherwise("POP3")
    caps = dialogue.capabilities(F.array(F.concat("token", F.lit(" x")), F.lit("size 100")))
    return h.select("session_id", protocol.alias("protocol"), caps.alias("caps")).select(
        "session_id", F.array_join("caps", " ").alias("caps"), dialogue.upgrade_offered(F.col("caps"), F.col("protocol")).alias("offered"),
        F.array_join(dialogue.mangled_indicators(F.col("caps"), F.col("protocol")), " | ").alias("indicators"))


@query
def sasl_events(spark, d):
    h = views.view(spark, d, "v_heads")
    event = tx.sasl_event(F.col("mechanism"), F.split("responses", " "), F.col("session_id") % 2 == 0)
    return h.select("session_id", event.alias("e")).select("session_id", "e.mechanism", "e.username", "e.secret_exposed", "e.accepted")


@query
def upgrade_refusals(spark, d):
    h = views.view(spark, d, "v_sessions")
    answers = F.array(*[F.lit(a) for a in ("2.0.0 ready", "a1 OK begin", "+OK begin", "4.7.0 not now", "a1 NO refused", "-ERR off")])
    answer = F.when(F.col("session_id") % 7 != 6, F.element_at(answers, (F.col("session_id") % 6 + 1).cast("int")))
    code = F.when(F.col("session_id") % 6 == 0, 220).otherwise(454)
    return h.select("session_id", dialogue.refusal_indicator(F.col("protocol"), F.col("starttls_requested"), code, answer).alias("indicator"))


@query
def upgrade_points(spark, d):
    s = Streams(spark, d, staged=True, chunk_bytes=CHUNK)
    start = s.spans.groupBy(*flows.STREAM).agg(F.min("span_len").alias("start_off"))
    found = dialogue.tls_offsets(s.text_chunks, flows.STREAM, start).join(start, flows.STREAM)
    gap = found.select(*flows.STREAM, F.col("start_off").alias("lo"), F.col("tls_off").alias("hi"), F.lit("x").alias("ident"), "tls_off")
    read = packets.read_ranges(s.text_chunks, gap.where("hi > lo"), flows.STREAM, "ident", CHUNK)
    text_of = F.coalesce("context", F.lit(""))
    told = F.when(F.col("dir") == "C", dialogue.injection_indicator("client", F.lit("STARTTLS"), text_of)).otherwise(
        dialogue.injection_indicator("server", F.lit("STARTTLS"), text_of))
    return gap.join(read, [*flows.STREAM, "ident"], "left").select(
        "capture_id", *_pair(), "dir", "tls_off", F.md5(told).alias("injection_hash"))


@query
def session_classes(spark, d):
    a = Analysis(spark, d, staged=True)
    label = dialogue.classify()
    return (a.facts.join(baseline.deviation_codes(a.deviations), ["capture_id", "session_id"], "left")
            .select("capture_id", "session_id", label.alias("label"), dialogue.class_kind(label).alias("kind")))


# --------------------------------------------------------------------------- captures and frames
def _frames(spark: SparkSession, d: str) -> DataFrame:
    return cut_lineage(views.view(spark, d, "v_frames")).select(
        "capture_id", "frame", (F.col("ts") * 1_000_000_000).alias("ts_ns"), F.col("linktype").cast("int").alias("linktype"),
        F.unhex("data_hex").alias("data"))


def _capture_files(spark: SparkSession, d: str) -> DataFrame:
    return cut_lineage(views.view(spark, d, "v_captures").select("capture_id", F.unhex("content_hex").alias("content")))


@query
def capture_container_status(spark, d):
    return captures.capture_status(_capture_files(spark, d))


@query
def capture_frames(spark, d):
    return captures.frames(_capture_files(spark, d)).select(
        "capture_id", "frame", "ts_ns", "linktype", F.md5(F.hex("data")).alias("data_hash"), "note")


@query
def decoded_segments(spark, d):
    return frames.segments(frames.decode(_frames(spark, d))).select(
        "capture_id", "frame", "src", "dst", "sport", "dport", "seq", "flags", F.hex("payload").alias("payload_hex"))


@query
def capture_read_stats(spark, d):
    rows = frames.read_stats(frames.decode(_frames(spark, d)))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("link_types", "unsupported_link_types")})


# --------------------------------------------------------------------------- TLS bytes
def _messages(spark: SparkSession, d: str) -> DataFrame:
    wire = cut_lineage(views.view(spark, d, "v_wire").select(
        F.concat_ws("/", "capture_id", "session_id").alias("key"), F.unhex("client_hex").alias("C"), F.unhex("server_hex").alias("S")))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("dir"), F.col(s).alias("data")) for s in "CS"]))
    return cut_lineage(handshake.handshake_messages(wire.select("key", sides.alias("s")).select("key", "s.*")))


@query
def handshake_facts(spark, d):
    rows = handshake.handshakes(_messages(spark, d))
    alerts = F.transform("alerts", lambda a: F.concat_ws(":", a["level"], a["description"]))
    return rows.withColumn("alerts", F.array_join(alerts, ",")).withColumns(
        {c: F.array_join(F.coalesce(c, F.array().cast("array<bigint>")), ",") for c in ("client_ciphers", "supported_groups", "client_supported_versions", "server_extensions")})


@query
def handshake_message_order(spark, d):
    return handshake.record_flow(_messages(spark, d)).withColumn("flow", F.array_join("flow", " > "))


@query
def handshake_labels(spark, d):
    h = views.view(spark, d, "v_handshakes")
    group = F.col("selected_group").cast("bigint")
    issue = F.when(F.col("version").isin(512, 768), "critical").when(F.col("version").isin(769, 770), "high")
    return h.select("capture_id", "session_id", dims.version_name(F.col("version")).alias("version_name"),
                    dims.version_ordinal(F.col("version")).cast("bigint").alias("ordinal"), issue.alias("issue"),
                    dims.suite_name(F.col("cipher_suite")).alias("cipher_name"), dims.group_name(group).alias("group_name"),
                    dims.lookup(dims.GROUP_BITS, group).cast("bigint").alias("group_bits"), group.isin(*dims.WEAK_GROUPS).alias("weak_group"),
                    dims.alert_name(F.split_part("alerts_text", F.lit(":"), F.lit(2)).try_cast("bigint")).alias("alert"))


# --------------------------------------------------------------------------- certificates
@query
def certificate_names(spark, d):
    h = views.view(spark, d, "v_sessions")
    hosts = F.array(*[F.lit(x) for x in ("mx.a.com", "x.y.a.com", "a.com", "MX.A.COM.", "10.0.0.1", "other.org")])
    pattern = F.array(*[F.lit(x) for x in ("*.a.com", "mx.a.com", "*.com", "m*.a.com", "10.0.0.1", "", "*.y.a.com")])
    sans = F.filter(F.array(F.element_at(pattern, (F.floor(F.col("session_id") / 6) % 7 + 1).cast("int"))), lambda s: s != "")
    host = F.element_at(hosts, (F.col("session_id") % 6 + 1).cast("int"))
    subject = F.concat(F.lit("O=Acme\\, Inc,CN="), F.element_at(hosts, (F.floor(F.col("session_id") / 42) % 6 + 1).cast("int")))
    return h.select("capture_id", "session_id", certificates.cn_of(subject).alias("cn"),
                    certificates.hostname_matches(host, sans, subject).alias("matches"))


@query
def certificate_path_failures(spark, d):
    raw = F.array(*[F.lit(x) for x in ("cert is not valid at validation time", "candidates exhausted: all candidates", "Unsupported curve",
                                       "basic constraints violated", "odd (encountered processing <Certificate>)", "EXPIRED subject name")])
    s = views.view(spark, d, "v_sessions")
    text_of = certificates.explain_failure(F.element_at(raw, (F.col("session_id") % 6 + 1).cast("int")), F.col("session_id") % 3 + 1, F.lit("CN=X"))
    return s.select("capture_id", "session_id", text_of.alias("detail"))


@query
def certificate_inventory(spark, d):
    a = Analysis(spark, d)
    return certificates.cert_inventory(a.chains, a.sessions).select(
        "sha256", "role", F.col("cert.subject").alias("subject"), "endpoints", "sessions")


@query
def certificate_unobservable(spark, d):
    a = Analysis(spark, d)
    return a.chains.where("NOT present").groupBy("capture_id", "absent_kind", "reason_absent").agg(F.count("*").alias("sessions"))


def _checks(spark, d):
    a = Analysis(spark, d)
    return certificates.cert_checks(a.chains, a.sessions, F.lit(AS_OF))


@query
def certificate_checks(spark, d):
    return _checks(spark, d).select("sha256", "check", "state")


@query
def certificate_verdicts(spark, d):
    return certificates.cert_verdict(_checks(spark, d)).select("sha256", "failed", "severity", "label")


@query
def certificate_counts(spark, d):
    return certificates.verdict_counts(certificates.cert_verdict(_checks(spark, d)))


# --------------------------------------------------------------------------- reports
@query
def report_finding_groups(spark, d):
    return reports.finding_groups(Analysis(spark, d, staged=True).ranked).drop("title")


@query
def report_top_groups(spark, d):
    return reports.top_groups(reports.finding_groups(Analysis(spark, d, staged=True).ranked)).select(
        "capture_id", "place", "rule_id", "endpoint", "severity", "priority", "findings")


@query
def report_terminal_top(spark, d):
    return reports.terminal_top(Analysis(spark, d, staged=True).ranked).select(
        "capture_id", "place", "rule_id", "endpoint", "severity", "risk", "times")


@query
def report_endpoints(spark, d):
    a = Analysis(spark, d, staged=True)
    scores = scoring.endpoint_scores(a.sessions, a.all_findings)
    issues = scoring.unique_issues(scoring.merge_rule_ids(a.all_findings))
    return reports.endpoint_table(a.facts, scores, issues).withColumn("score", F.col("score").cast("bigint"))


@query
def report_sessions(spark, d):
    a = Analysis(spark, d, staged=True)
    return reports.session_table(a.facts, a.all_findings, scoring.session_rule_risk(a.sessions, a.all_findings))


@query
def report_kpis(spark, d):
    a = Analysis(spark, d, staged=True)
    return reports.kpis(a.facts, scoring.unique_issues(scoring.merge_rule_ids(a.all_findings)))


@query
def report_severity_shares(spark, d):
    return reports.severity_shares(Analysis(spark, d, staged=True).all_findings)


@query
def report_channels(spark, d):
    return reports.channels(Analysis(spark, d).sessions)


@query
def report_protocols(spark, d):
    return reports.protocols(Analysis(spark, d).sessions)


@query
def report_versions(spark, d):
    return reports.versions(Analysis(spark, d).facts)


@query
def report_finding_search(spark, d):
    rows = reports.search_findings(Analysis(spark, d, staged=True).all_findings, ["critical", "high"], "STARTTLS")
    return rows.select("capture_id", "session_id", "rule_id", "severity")


@query
def report_session_detail(spark, d):
    a = Analysis(spark, d, staged=True)
    return reports.session_detail(a.facts, a.all_findings, 8).select(
        "capture_id", "session_id", "endpoint", "protocol", "mode", "version_name", "cipher_name", text("rules", " "))


@query
def report_capture_meta(spark, d):
    a = Analysis(spark, d)
    return reports.capture_meta(a.sessions, a.captures)


@query
def report_corpus_rollup(spark, d):
    return reports.corpus_rollup(Analysis(spark, d, staged=True).posture)


@query
def report_verdicts(spark, d):
    a = Analysis(spark, d, staged=True)
    label = dialogue.classify()
    classes = a.facts.join(baseline.deviation_codes(a.deviations), ["capture_id", "session_id"], "left").select(
        "capture_id", dialogue.class_kind(label).alias("kind"))
    return reports.verdicts(a.posture, classes)


@query
def report_caveats(spark, d):
    a = Analysis(spark, d, staged=True)
    return reports.caveats(a.posture, a.sessions)


@query
def report_timeline(spark, d):
    return reports.timeline(Analysis(spark, d).facts).withColumn("step", F.col("step").cast("bigint"))


@query
def report_timeline_findings(spark, d):
    a = Analysis(spark, d, staged=True)
    return reports.attach_findings(reports.timeline(a.facts), a.all_findings).withColumn("step", F.col("step").cast("bigint"))


@query
def report_section_counts(spark, d):
    a = Analysis(spark, d, staged=True)
    return reports.section_counts(a.facts, a.all_findings, a.certificates)


@query
def session_export(spark, d):
    a = Analysis(spark, d, staged=True)
    return reports.flat_sessions(a.facts, a.features, a.all_findings, scoring.session_rule_risk(a.sessions, a.all_findings))


@query
def report_json_rows(spark, d):
    return sinks.as_json(Analysis(spark, d).sessions.select("capture_id", "session_id", "protocol", "mode", "starttls_offered", "capabilities"),
                         ["capture_id", "session_id"])


# --------------------------------------------------------------------------- models
def _labelled(spark, d):
    a = Analysis(spark, d, staged=True)
    risks = scoring.session_rule_risk(a.sessions, a.all_findings)
    return cut_lineage(a.features.join(risks, ["capture_id", "session_id"]))


@query
def group_splits(spark, d):
    return views.view(spark, d, "v_sessions").select("capture_id", "session_id", models.split_of(F.col("endpoint_key")).alias("split"))


@query
def model_metrics(spark, d):
    s = views.view(spark, d, "v_sessions")
    rows = s.select(models.split_of(F.col("endpoint_key")).alias("split"), (F.col("session_id") % 101).cast("double").alias("y"),
                    (F.col("session_id") % 101 + F.col("session_id") % 7 - 3).cast("double").alias("p"))
    return models.regression_metrics(rows, ["split"], "y", "p")


def _closed_form(df: DataFrame) -> DataFrame:
    total = F.lit(0.0)
    for i, name in enumerate(dims.FEATURES):
        total = total + F.col(name) * (i % 5 + 1.5)
    return df.withColumn("f", total)


@query
def risk_explanations(spark, d):
    a = Analysis(spark, d, staged=True)
    return models.top_contributions(models.shapley(cut_lineage(a.features), _closed_form)).select(
        "capture_id", "session_id", "feature_group", "phi")


@query
def risk_model_predictions(spark, d):
    rows = _labelled(spark, d).withColumn("split", models.split_of(F.col("capture_id")))
    model = models.train_risk(rows.where("split = 'train'"))
    return models.predict_risk(model, rows).select("capture_id", "session_id", "split", "rule_risk", "model_risk")


@query
def risk_model_explanations(spark, d):
    """What each group of features adds to the fitted model's risk; only groups that add something."""
    rows = _labelled(spark, d).withColumn("split", models.split_of(F.col("capture_id")))
    told = contributions.contributions(models.train_risk(rows.where("split = 'train'")), rows)
    return told.where(F.abs("phi") >= 0.05).select("capture_id", "session_id", "feature_group", F.round("phi", 1).alias("phi"))


@query
def risk_explanation_sums(spark, d):
    """Per split: sessions explained, and whether all their groups' values add up to the model's risk minus the reference's."""
    rows = _labelled(spark, d).withColumn("split", models.split_of(F.col("capture_id")))
    model = models.train_risk(rows.where("split = 'train'"))
    told = contributions.contributions(model, rows).groupBy("capture_id", "session_id").agg(F.sum("phi").alias("total"), F.max("risk").alias("risk"), F.max("reference_risk").alias("base"), F.count("*").alias("groups"))
    said = models.predict_risk(model, rows, None).select("capture_id", "session_id", "split", "model_risk")
    near = (F.abs(F.col("total") - (F.col("model_risk") - F.col("base"))) < 1e-6) & (F.abs(F.col("risk") - F.col("model_risk")) < 1e-6) & (F.col("groups") == len(dims.FEATURE_GROUPS))
    return said.join(told.hint("merge"), ["capture_id", "session_id"], "left").groupBy("split").agg(F.count("*").alias("sessions"), F.count_if(F.coalesce(near, F.lit(False))).alias("exact"))


@query
def isolation_forest_outliers(spark, d):
    rows = cut_lineage(Analysis(spark, d, staged=True).features)
    keys = ["capture_id", "session_id"]
    return models.flag_outliers(models.anomaly_scores(rows, models.isolation_forest(rows, keys), keys))


def _outlier_findings(a: Analysis) -> DataFrame:
    rows, keys = cut_lineage(a.features), ["capture_id", "session_id"]
    flags = cut_lineage(models.flag_outliers(models.anomaly_scores(rows, models.isolation_forest(rows, keys), keys)))
    return models.outlier_findings(flags, rows, a.sessions)


@query
def outlier_findings(spark, d):
    """The ML-001 finding of every session that the forest flags."""
    return _outlier_findings(Analysis(spark, d, staged=True)).select(
        "capture_id", "session_id", "endpoint", "rule_id", "severity", text("evidence", " | "), "exploitability", "confidence")


@query
def session_blended_risk(spark, d):
    """Risk of every session from all findings, outliers included, blended with the fitted model's prediction."""
    a = Analysis(spark, d, staged=True)
    risks = scoring.session_rule_risk(a.sessions, a.all_findings)
    rows = cut_lineage(a.features.join(risks, ["capture_id", "session_id"]).withColumn("split", models.split_of(F.col("capture_id"))))
    predicted = models.predict_risk(models.train_risk(rows.where("split = 'train'")), rows)
    known = ["capture_id", "session_id", "rule_id", "severity", "exploitability"]
    findings = a.all_findings.select(known).unionByName(_outlier_findings(a).select(known))
    return scoring.session_risk(a.sessions, findings, predicted)


@query
def outlier_reasons(spark, d):
    return models.outlier_reasons(cut_lineage(Analysis(spark, d, staged=True).features), ["capture_id", "session_id"])


@query
def detection_by_variant(spark, d):
    return models.detection_rates(views.view(spark, d, "v_expected"), views.view(spark, d, "v_detected"), "variant")


@query
def detection_by_protocol(spark, d):
    return models.detection_rates(views.view(spark, d, "v_expected"), views.view(spark, d, "v_detected"), "protocol")


@query
def clean_step_check(spark, d):
    return models.clean_steps(views.view(spark, d, "v_expected"), views.view(spark, d, "v_detected"), "variant")


@query
def extraction_agreement(spark, d):
    a = views.view(spark, d, "v_handshakes")
    b = a.select("session_id", F.when(F.col("session_id") % 50 == 0, 0).otherwise(F.col("version")).alias("version"),
                 F.when(F.col("session_id") % 70 == 0, None).otherwise(F.col("cipher_suite")).alias("cipher_suite"), "sni")
    return models.agreement(a, b, "session_id", ["version", "cipher_suite", "sni"])


# --------------------------------------------------------------------------- dialogues held as texts
def _by_length(texts: DataFrame, work: Callable[[DataFrame, bool], DataFrame]) -> DataFrame:
    """``work(texts, whole)`` over dialogues whose sides one row may hold and, where there are longer ones, over those in chunks."""
    size = F.greatest(F.coalesce(F.length("client_text"), F.lit(0)), F.coalesce(F.length("server_text"), F.lit(0)))
    far = texts.where(size > dialogue.SHORT_CHARS)
    if far.isEmpty():
        return work(texts, True)
    return work(texts.where(size <= dialogue.SHORT_CHARS), True).unionByName(work(far, False))


# --------------------------------------------------------------------------- SMTP dialogue
def _smtp(spark: SparkSession, d: str, work: Callable[[DataFrame, DataFrame, bool], DataFrame]) -> DataFrame:
    """``work(events, server lines, whole)`` of the SMTP stand-ins, read as chunked streams."""
    keys = ["session_id"]

    def read(texts: DataFrame, whole: bool) -> DataFrame:
        stage = (lambda df: df) if whole else cut_lineage

        def lines(side: str) -> DataFrame:
            text_rows = texts.select("session_id", F.col(f"{side}_text").alias("text"))
            return stage(dialogue.stream_lines(dialogue.cut_text(text_rows, keys, CHUNK), keys, whole=whole).where("complete"))

        server = lines("server")
        return work(stage(smtp.events(lines("client").select(*keys, "line_no", "line"), stage(dialogue.smtp_replies(server, keys, not whole)), keys, whole)), server, whole)

    return _by_length(views.view(spark, d, "v_smtp"), read)


@query
def smtp_events(spark, d):
    return _smtp(spark, d, lambda rows, server, whole: rows).select("session_id", "line_no", "kind", F.when(F.col("kind") == "command", F.col("verb")).alias("verb"), "reply_no", "code")


@query
def smtp_sessions(spark, d):
    return _smtp(spark, d, lambda rows, server, whole: smtp.sessions(rows, server, ["session_id"], whole)).withColumns(
        {"capabilities": F.array_join("capabilities", " "), "strip_indicators": F.array_join("strip_indicators", " | ")})


@query
def smtp_auth_events(spark, d):
    return _smtp(spark, d, lambda rows, server, whole: smtp.auth_events(rows, ["session_id"]))


# --------------------------------------------------------------------------- IMAP dialogue
def _imap_lines(texts: DataFrame, side: str, whole: bool) -> DataFrame:
    base = texts.select("session_id", F.col(f"{side}_text").alias("text"))
    return dialogue.stream_lines(dialogue.cut_text(base, ["session_id"], CHUNK), ["session_id"], whole=whole).where("complete")


def _imap_commands(spark: SparkSession, d: str) -> DataFrame:
    return _by_length(views.view(spark, d, "v_imap"), lambda texts, whole: imap.commands(
        _imap_lines(texts, "client", whole), _imap_lines(texts, "server", whole), ["session_id"], whole))


@query
def imap_commands(spark, d):
    return _imap_commands(spark, d).select("session_id", "line_no", "tag", "verb", "status", "answer")


@query
def imap_capabilities(spark, d):
    return _by_length(views.view(spark, d, "v_imap"), lambda texts, whole: imap.capability_lists(
        _imap_lines(texts, "server", whole), ["session_id"])).select("session_id", "line_no", text("capabilities", " "))


@query
def imap_login_events(spark, d):
    return imap.login_events(_imap_commands(spark, d), ["session_id"])
