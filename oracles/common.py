"""Building blocks of the reference SQL, in DuckDB's dialect."""

from __future__ import annotations

from mailveil import dims
from mailveil.plans.views import with_clause

SUITES = f"""suites AS (
  SELECT *, CASE WHEN suite LIKE 'UNKNOWN%' THEN '?' WHEN tls13 THEN 'A'
      WHEN anon OR export OR nullc OR rc4 OR b64 THEN 'F' WHEN fs AND ad THEN 'A' WHEN fs THEN 'B' ELSE 'C' END AS grade,
    concat_ws(',', CASE WHEN anon THEN 'anonymous' END, CASE WHEN export THEN 'export-grade' END,
      CASE WHEN nullc THEN 'null-cipher' END, CASE WHEN rc4 THEN 'rc4' END, CASE WHEN b64 THEN '64-bit-block' END,
      CASE WHEN NOT tls13 AND mac = 'MD5' THEN 'md5-mac' END, CASE WHEN NOT fs THEN 'no-fs' END,
      CASE WHEN NOT tls13 AND enc LIKE '%CBC%' AND NOT anon AND NOT nullc THEN 'cbc' END) AS weak
  FROM (SELECT *, NOT classic AS tls13,
      NOT classic OR kx IN ('ECDHE', 'DHE') AS fs, NOT classic OR regexp_matches(enc, 'GCM|CCM|POLY1305') AS ad,
      classic AND enc = 'NULL' AS nullc, classic AND enc LIKE '%RC4%' AS rc4,
      classic AND regexp_matches(enc, 'DES|IDEA|RC2') AS b64
    FROM (SELECT code, suite, suite LIKE '%\\_WITH\\_%' ESCAPE '\\' AS classic,
        CASE WHEN suite LIKE '%\\_WITH\\_%' ESCAPE '\\' THEN split_part(split_part(substr(suite, 5), '_WITH_', 1), '_', 1)
             ELSE 'ECDHE/DHE (TLS 1.3)' END AS kx,
        suite LIKE '%anon%' AS anon, split_part(suite, '_WITH_', 1) LIKE '%EXPORT%' AS export,
        regexp_extract(regexp_replace(substr(suite, 5), '^.*_WITH_', ''), '_(SHA384|SHA256|SHA|MD5)$', 1) AS mac,
        regexp_replace(regexp_replace(substr(suite, 5), '^.*_WITH_', ''), '_(SHA384|SHA256|SHA|MD5)$', '') AS enc
      FROM (VALUES {dims.values_sql(dims.SUITE_NAMES.items())}) AS t(code, suite))))"""

ANCHORS = """anchors AS (
  SELECT DISTINCT concat('O=Trust,CN=Issuing CA ', s_suppkey % 5) AS subject FROM supplier
  UNION ALL SELECT 'CN=Root CA,O=Trust' WHERE (SELECT count(*) FROM region) > 0)"""


def suite_name_sql(col: str) -> str:
    return (f"CASE WHEN {col} IS NOT NULL THEN coalesce((SELECT suite FROM suites WHERE code = {col}), "
            f"concat('UNKNOWN_0x', upper(lpad(to_hex({col}), 4, '0')))) END")


def version_name_sql(col: str) -> str:
    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in dims.VERSION_NAMES.items())
    return f"CASE WHEN {col} IS NULL THEN 'none' ELSE CASE {col} {cases} ELSE concat('0x', lower(lpad(to_hex({col}), 4, '0'))) END END"


def port_class_sql(col: str) -> str:
    return (f"CASE WHEN {col} = 25 THEN 'relay' WHEN {col} IN (587, 465) THEN 'submission' "
            f"WHEN {col} IN (143, 110, 993, 995) THEN 'access' ELSE 'nonstandard' END")


CHAINS = f"""links AS (
  SELECT capture_id, session_id, position, (issuer <> lead(subject) OVER w OR NOT signed_by_next) AS broken,
    lead(subject) OVER w IS NULL AS last_one
  FROM v_certificates WINDOW w AS (PARTITION BY capture_id, session_id ORDER BY position)),
chain_agg AS (
  SELECT c.capture_id, c.session_id, count(*) AS n_certs,
    CASE WHEN count(*) > 1 THEN NOT bool_or(coalesce(l.broken, false) AND NOT l.last_one) END AS chain_links_ok,
    arg_max(c.issuer, c.position) AS last_issuer,
    string_agg(CASE WHEN lower(c.signature_hash) IN ('md5', 'sha1') AND NOT (c.self_signed AND c.position > 0)
      THEN concat('cert #', c.position, ' (', c.subject, ') signed with ', upper(c.signature_hash)) END, ' | ' ORDER BY c.position) AS weak_sig,
    arg_min(concat(c.subject, ' | ', c.der_error), c.position) FILTER (WHERE c.der_error IS NOT NULL) AS bad_der
  FROM v_certificates c JOIN links l USING (capture_id, session_id, position) GROUP BY ALL),
chains AS (
  SELECT *, CASE WHEN NOT present OR named IS NULL THEN NULL
      WHEN sans_text = '' THEN lower(regexp_extract(leaf_subject, 'CN=([^,]*)', 1)) = named
      ELSE list_bool_or(list_transform(string_split(lower(sans_text), ','), lambda s: s = named OR (s LIKE '*.%.%' AND substr(s, 3) = regexp_extract(named, '^[^.]*\\.(.*)$', 1)))) END AS hostname_match,
    CASE WHEN NOT present THEN NULL WHEN self_signed THEN false WHEN sans_text = '' THEN NULL
      ELSE anchored AND coalesce(chain_links_ok, true) AND NOT expired AND NOT not_yet_valid END AS trusted
  FROM (SELECT h.capture_id, h.session_id, s.start_ts,
    coalesce(a.n_certs, 0) AS n_certs,
    coalesce(a.n_certs, 0) > 0 AND h.client_hello_seen AND coalesce(h.version <> 772, true) AS present,
    CASE WHEN NOT h.client_hello_seen THEN 'no_tls' WHEN h.version = 772 THEN 'tls13' WHEN coalesce(a.n_certs, 0) > 0 THEN NULL
      WHEN {suite_name_sql('h.cipher_suite')} LIKE '%anon%' THEN 'anonymous' WHEN h.server_hello_seen THEN 'resumed' ELSE 'missing' END AS absent_kind,
    coalesce(nullif(h.sni, ''), s.server_name) AS hostname, lower(coalesce(nullif(h.sni, ''), s.server_name)) AS named,
    l.subject AS leaf_subject, l.issuer AS leaf_issuer, l.self_signed, l.key_type, l.key_bits, l.signature_hash, l.sans_text,
    l.is_ca, l.eku_server_auth, l.not_before, l.not_after, l.sha256, a.chain_links_ok, a.last_issuer, a.weak_sig, a.bad_der,
    s.start_ts > l.not_after AS expired, s.start_ts < l.not_before AS not_yet_valid,
    cast(floor((l.not_after - s.start_ts) / 86400) AS bigint) AS days_to_expiry,
    a.last_issuer IN (SELECT subject FROM anchors) AS anchored
  FROM v_handshakes h JOIN v_sessions s USING (capture_id, session_id)
  LEFT JOIN chain_agg a USING (capture_id, session_id)
  LEFT JOIN v_certificates l ON l.capture_id = h.capture_id AND l.session_id = h.session_id AND l.position = 0))"""

FACTS = f"""facts AS (
  SELECT s.*, h.client_hello_seen, h.server_hello_seen, h.version, h.client_legacy_version, h.server_legacy_version,
    h.client_versions_text, h.client_ciphers_text, h.cipher_suite, h.compression, h.groups_text, h.selected_group,
    h.ecdhe_curve, h.dh_bits, h.alerts_text, h.secure_renegotiation, h.extended_master_secret, h.downgrade_sentinel,
    h.fallback_scsv, h.server_extensions_text, h.ja3s, h.session_id IS NOT NULL AS has_handshake,
    c.present, c.absent_kind, c.hostname, c.leaf_subject, c.leaf_issuer, c.self_signed, c.key_type, c.key_bits, c.signature_hash,
    c.sans_text, c.is_ca, c.eku_server_auth, c.not_before, c.not_after, c.sha256, c.chain_links_ok, c.weak_sig, c.bad_der, c.expired,
    c.not_yet_valid, c.days_to_expiry, c.hostname_match, c.trusted, c.n_certs, c.last_issuer,
    {port_class_sql('s.server_port')} AS pc, CASE WHEN s.protocol = 'POP3' THEN 'STLS' ELSE 'STARTTLS' END AS up,
    CASE WHEN s.caps_text = '' THEN '(none)' ELSE s.caps_text END AS caps_shown,
    {version_name_sql('h.version')} AS version_name, {suite_name_sql('h.cipher_suite')} AS cipher_name,
    CASE WHEN h.cipher_suite IS NOT NULL THEN coalesce(x.grade, '?') END AS cgrade, coalesce(x.weak, '') AS weak, coalesce(x.fs, false) AS fs,
    coalesce(x.ad, false) AS ad, coalesce(x.tls13, false) AS tls13, coalesce(x.kx, 'unknown') AS kx, coalesce(x.enc, 'unknown') AS enc,
    coalesce(nullif(h.ecdhe_curve, 0), h.selected_group) AS grp,
    (s.greeting_verb = 'HELO' AND EXISTS (SELECT 1 FROM v_sessions o WHERE o.capture_id = s.capture_id AND o.endpoint = s.endpoint AND o.greeting_verb = 'EHLO')) AS ehlo_elsewhere
  FROM v_sessions s LEFT JOIN v_handshakes h USING (capture_id, session_id)
  LEFT JOIN chains c USING (capture_id, session_id) LEFT JOIN suites x ON x.code = h.cipher_suite)"""


def rule(rule_id, severity, when, evidence, exploit, confidence=0.9):
    return (f"SELECT capture_id, session_id, endpoint, endpoint_key, '{rule_id}' AS rule_id, {severity} AS severity, "
            f"{evidence} AS evidence, {exploit} AS exploitability, {confidence} AS confidence FROM facts WHERE {when}")


_CMDS = "array_to_string(string_split(commands_text, ' ')[1:{n}], ', ')"
_CLEAR = "NOT tls_used AND mode <> 'implicit'"
_WHO = ("concat(auth_mech, ' for user ''', coalesce(auth_user, '(unknown user)'), ''' (', CASE WHEN auth_accepted THEN 'accepted' "
        "WHEN NOT auth_accepted THEN 'rejected' ELSE 'outcome not observed' END, ')')")
_OFFERED = "(CASE WHEN client_versions_text <> '' THEN client_versions_text ELSE cast(client_legacy_version AS varchar) END)"
_GROUPS = "CASE grp " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in dims.GROUP_NAMES.items()) + " END"
_BROKEN = "regexp_matches(weak, 'anonymous|export-grade|null-cipher|rc4|64-bit-block|md5-mac')"

TRANSPORT_RULES = [
    rule("STRIP-001", "'critical'", "strip_text <> ''", "concat(strip_text, ' | capabilities seen: ', caps_shown)", 0.9),
    rule("INJ-001", "'critical'", "inject_text <> ''", "inject_text", 0.8),
    rule("PLAIN-001", "CASE WHEN pc = 'relay' THEN 'medium' ELSE 'high' END",
         f"{_CLEAR} AND starttls_offered IS NOT NULL AND NOT starttls_offered AND strip_text = ''",
         "concat('capabilities: ', caps_shown, ' | port class: ', pc)", 1.0),
    rule("PLAIN-002", "'medium'", f"{_CLEAR} AND coalesce(starttls_offered, false) AND NOT starttls_requested",
         f"concat('server advertised ', up, '; client continued with ', {_CMDS.format(n=6)})", 1.0),
    rule("PLAIN-003", "'medium'", f"{_CLEAR} AND starttls_offered IS NULL AND commands_text <> '' AND strip_text = ''",
         f"concat('commands: ', {_CMDS.format(n=8)}, ' | server TLS capability not observed')", 1.0),
    rule("CRED-001", "'critical'", "auth_mech IS NOT NULL AND auth_exposed",
         f"concat({_WHO}, '; password/token crossed the wire unencrypted (secret not stored)')", 1.0, 0.98),
    rule("CRED-002", "'medium'", "auth_mech IS NOT NULL AND NOT auth_exposed", f"concat({_WHO}, ': offline-crackable')", 0.6),
    rule("DATA-001", "'high'", "cleartext_bytes <> 0",
         "concat(cleartext_bytes, ' bytes of message data outside TLS (content not stored)')", 1.0),
    rule("TCP-001", "'medium'", "overlap_conflicts > 0",
         "concat(overlap_conflicts, ' overlapping segment(s) disagreed with earlier bytes')", 0.5, 0.7),
    rule("PORT-001", "'low'", "pc = 'nonstandard'", "concat('identified from banner: ''', banner, '''')", 0.3),
    rule("STRIP-002", "CASE WHEN ehlo_elsewhere THEN 'high' ELSE 'medium' END",
         "protocol = 'SMTP' AND NOT tls_used AND greeting_verb = 'HELO'",
         "concat('client greeted with HELO on port ', server_port, ' | ', CASE WHEN ehlo_elsewhere THEN 'the same endpoint answered EHLO in "
         "other sessions in this capture, so ESMTP is available and something suppressed it here' ELSE 'no extensions were offered because "
         "none were requested; STARTTLS could never have been used' END, ' | no capability line was tampered with, so capability comparison "
         "cannot see this')", 0.9, "CASE WHEN ehlo_elsewhere THEN 0.9 ELSE 0.7 END"),
]
H = "coalesce(client_hello_seen, false)"
TLS_RULES = [
    rule("TLS-007", "CASE WHEN alerts_text = '2:86' THEN 'high' ELSE 'medium' END", f"{H} AND (alerts_text LIKE '2:%' OR NOT server_hello_seen)",
         "concat('alerts: ', CASE alerts_text WHEN '2:86' THEN 'inappropriate_fallback (TLS_FALLBACK_SCSV defence triggered: a downgrade was "
         "attempted)' WHEN '2:40' THEN 'handshake_failure' ELSE 'no ServerHello' END)", 0.3),
    rule("TLS-001", "CASE WHEN version <= 768 THEN 'critical' ELSE 'high' END", f"{H} AND server_hello_seen AND version <= 770",
         "concat('negotiated ', version_name, ' (ServerHello legacy_version 0x', lower(lpad(to_hex(server_legacy_version), 4, '0')), "
         "CASE WHEN list_contains(string_split(server_extensions_text, ','), '43') THEN ', supported_versions ext' ELSE '' END, ') | ', "
         "CASE version WHEN 769 THEN 'TLS 1.0 is deprecated by RFC 8996' WHEN 770 THEN 'TLS 1.1 is deprecated by RFC 8996' ELSE "
         "'SSL is prohibited by RFC 6176 and RFC 7568' END)", 0.5),
    rule("TLS-002", "CASE WHEN regexp_matches(weak, 'anonymous|export-grade|null-cipher') THEN 'critical' ELSE 'high' END", f"{H} AND {_BROKEN}",
         "concat('negotiated 0x', upper(lpad(to_hex(cipher_suite), 4, '0')), ' ', cipher_name, ' (grade ', cgrade, ') | ', replace(weak, ',', ', '))", 0.5),
    rule("TLS-003", "'medium'", f"{H} AND cipher_suite IS NOT NULL AND NOT fs AND NOT tls13 AND weak NOT LIKE '%anonymous%'",
         "concat(cipher_name, ' uses ', kx, ' key transport')", 0.4),
    rule("TLS-004", "'low'", f"{H} AND enc LIKE '%CBC%' AND NOT {_BROKEN}", "concat(cipher_name, ': MAC-then-encrypt')", 0.3),
    rule("TLS-005", "CASE WHEN dh_bits <= 768 THEN 'critical' WHEN dh_bits <= 1024 THEN 'high' ELSE 'medium' END", f"{H} AND dh_bits < 2048",
         "concat('ServerKeyExchange DH prime is ', dh_bits, ' bits')", 0.5),
    rule("TLS-013a", "'medium'", f"{H} AND grp IN (19, 21)", f"concat('group ', {_GROUPS}, ' (', CASE grp WHEN 19 THEN 192 ELSE 224 END, ' bits)')", 0.4),
    rule("TLS-008", "'high'", f"{H} AND compression <> 0", "concat('compression method ', compression)", 0.4),
    rule("TLS-009", "'medium'", f"{H} AND server_hello_seen AND NOT secure_renegotiation", "'ServerHello lacks renegotiation_info'", 0.3),
    rule("TLS-012", "'low'", f"{H} AND NOT extended_master_secret AND version = 771", "'TLS 1.2 without RFC 7627 EMS (triple-handshake class)'", 0.2),
    rule("TLS-010", "'high'", f"{H} AND downgrade_sentinel IS NOT NULL AND client_versions_text LIKE '%772%'",
         "concat('ServerHello.random ends with DOWNGRD marker (', downgrade_sentinel, ') while negotiating ', version_name)", 0.6),
    rule("TLS-011", "'low'", f"{H} AND fallback_scsv", "'ClientHello carries TLS_FALLBACK_SCSV: this is a retry at a lower version'", 0.3),
    rule("TLS-006", "'low'", f"{H} AND EXISTS (SELECT 1 FROM suites WHERE list_contains(string_split(client_ciphers_text, ','), cast(code AS varchar)) AND regexp_matches(suites.weak, 'anonymous|export-grade|null-cipher|rc4'))",
         "concat('offered: ', (SELECT string_agg(suite, ', ' ORDER BY suite) FROM suites WHERE list_contains(string_split(client_ciphers_text, ','), cast(code AS varchar)) AND regexp_matches(suites.weak, 'anonymous|export-grade|null-cipher|rc4')))", 0.2),
    rule("TLS-013b", "'high'", f"{H} AND server_hello_seen AND client_ciphers_text <> '' AND NOT list_contains(string_split(client_ciphers_text, ','), cast(cipher_suite AS varchar))",
         "concat('selected ', cipher_name, ' | client offered ', len(string_split(client_ciphers_text, ',')), ' suites, not including it')", 0.9),
    rule("TLS-014", "'high'", f"{H} AND server_hello_seen AND NOT list_contains(string_split({_OFFERED}, ','), cast(version AS varchar))",
         f"concat('negotiated ', version_name, ' | client offered ', array_to_string(list_transform(string_split({_OFFERED}, ','), lambda v: concat('0x', lower(to_hex(cast(v AS bigint))))), ', '))", 0.9),
    rule("TLS-015", "'medium'", f"{H} AND server_hello_seen AND groups_text <> '' AND NOT list_contains(string_split(groups_text, ','), cast(selected_group AS varchar))",
         "concat('group ', selected_group, ' is not in the client''s supported_groups')", 0.6, 0.8),
]
_REASON = "CASE absent_kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {
    "tls13": "TLS 1.3 sends certificates encrypted, so none can be seen",
    "anonymous": "the key exchange was anonymous and used no certificate",
    "resumed": "the session was resumed, and its certificate shown in a handshake outside this capture",
}.items()) + " END"
TRUST_DETAIL = """CASE WHEN sans_text = '' THEN 'leaf has no DNS subjectAltName; path validation skipped'
  WHEN expired OR not_yet_valid THEN 'no path could be built, as one of its certificates was not valid at the time of the capture'
  WHEN n_certs = 1 THEN concat('the trust store does not know the issuer, and the server sent no intermediate: its chain is incomplete (issuer: ', last_issuer, ')')
  ELSE concat('the trust store does not know ''', last_issuer, ''', where the chain ends: a private CA, or the server leaves out an intermediate') END"""
CERT_RULES = [
    rule("CERT-012", "'info'", "absent_kind = 'resumed'", f"concat({_REASON}, ' | expiry, hostname and trust were not checked for this session')", 0.0, 1.0),
    rule("CERT-014", "'critical'", "absent_kind = 'anonymous'", f"concat({_REASON}, ' | the channel is encrypted to an unauthenticated peer; trivially man-in-the-middled')", 1.0, 1.0),
    rule("CERT-013", "'medium'", "absent_kind = 'missing' AND tls_used",
         "'the Certificate message is absent from the capture and the handshake is not TLS 1.3 | no certificate check could be performed for this session'", 0.2, 0.6),
    rule("CERT-010", "'info'", "absent_kind = 'tls13'", _REASON, 0.0, 1.0),
    rule("CERT-001", "'high'", "present AND (expired OR not_yet_valid)",
         "CASE WHEN expired THEN concat('notAfter ', not_after, ' (', -days_to_expiry, ' days before capture) | ', leaf_subject) ELSE concat('notBefore ', not_before) END", 0.6),
    rule("CERT-009", "'low'", "present AND NOT expired AND NOT not_yet_valid AND days_to_expiry < 30",
         "concat('notAfter ', not_after, ' (', days_to_expiry, ' days left at capture time)')", 0.1),
    rule("CERT-002", "CASE WHEN pc = 'relay' THEN 'medium' ELSE 'high' END", "present AND self_signed",
         "concat('subject = issuer = ', leaf_subject, ' | sha256 ', substr(sha256, 1, 32), '...')", 0.7),
    rule("CERT-003", "'high'", "present AND NOT hostname_match",
         "concat('expected ''', hostname, ''' | certificate names: ', CASE WHEN sans_text <> '' THEN replace(sans_text, ',', ', ') ELSE leaf_subject END)", 0.7),
    rule("CERT-004", "'high'", "present AND ((key_type IN ('RSA', 'DSA') AND key_bits < 2048) OR (key_type LIKE 'EC-%' AND key_bits < 256))",
         "concat(key_type, ' ', key_bits, '-bit public key')", 0.5),
    rule("CERT-005", "'high'", "present AND weak_sig IS NOT NULL", "weak_sig", 0.4),
    rule("CERT-006", "'medium'", "present AND NOT chain_links_ok",
         "'the chain shown is unordered, or one of its certificates does not sign the one before it'", 0.3),
    rule("CERT-007", "'medium'", "present AND NOT trusted AND NOT self_signed", f"concat({TRUST_DETAIL}, ' | issuer: ', leaf_issuer)", 0.6),
    rule("CERT-011", "'low'", "present AND bad_der IS NOT NULL", "bad_der", 0.1, 1.0),
    rule("CERT-008", "'low'", "present AND (is_ca OR NOT eku_server_auth)",
         "CASE WHEN is_ca THEN 'leaf has BasicConstraints CA:TRUE' ELSE 'leaf EKU lacks serverAuth' END", 0.2),
]


def round1(expr: str, digits: int = 1) -> str:
    """Round the double's own decimal digits, not a value scaled in binary first."""
    return f"cast(round(cast({expr} AS decimal(38, 15)), {digits}) AS double)"


def union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


FINDINGS = f"findings AS ({union(TRANSPORT_RULES + TLS_RULES + CERT_RULES)})"


def facts_with(*ctes: str) -> str:
    """WITH list up to the wide fact row, plus any further parts."""
    return ",\n".join([with_clause(["v_certificates", "v_handshakes", "v_sessions"]), SUITES, ANCHORS, CHAINS, FACTS, *ctes])
