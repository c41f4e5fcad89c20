"""Reference SQL of the certificate and report queries."""

from __future__ import annotations

from mailveil import dims
from mailveil.plans.views import with_clause
from oracles import baseline as b
from oracles import common as c

RANKED = b.FULL + ", " + b.CONTEXT + ", " + b.scored("all_findings") + f""", ranked AS (SELECT *,
  row_number() OVER (PARTITION BY capture_id ORDER BY risk DESC, {b.RANKS.format(col='severity')}, rule_id, session_id, evidence) AS priority FROM scored)"""
GROUPS = RANKED + """, grp AS (SELECT capture_id, rule_id, endpoint, severity, min(priority) AS priority, arg_min(session_id, priority) AS first_session, count(*) AS findings, max(risk) AS risk FROM ranked GROUP BY ALL)"""
RISKS = f"""rr AS (SELECT s.capture_id, s.session_id, coalesce(round(100::double * (1::double - product(1::double - {b.WEIGHT.format(col='f.severity')} * (0.6::double + 0.4::double * f.exploitability))), 1), 0) AS rule_risk
  FROM v_sessions s LEFT JOIN all_findings f USING (capture_id, session_id) GROUP BY ALL)"""
SEEN = c.facts_with() + """, seen AS (SELECT x.*, v.session_id AS sid, v.capture_id AS cap, v.endpoint, h.present, h.expired AS ch_exp, h.days_to_expiry AS ch_days, h.hostname_match, h.self_signed AS leaf_ss,
    h.chain_links_ok, h.trusted, h.n_certs, CASE WHEN x.position = 0 THEN 0 WHEN x.self_signed THEN 2 ELSE 1 END AS role_rank
  FROM v_certificates x JOIN chains h USING (capture_id, session_id) JOIN v_sessions v USING (capture_id, session_id) WHERE h.present)"""
AS_OF = 946684800
CHECKS = SEEN + f""", per AS (SELECT sha256, min(role_rank) AS rr, any_value(key_type) AS key_type, any_value(key_bits) AS key_bits, any_value(signature_hash) AS sig, any_value(not_after) AS na,
    arg_min(self_signed, position) AS ss, arg_min(is_ca, (position, is_ca)) AS is_ca, arg_min(eku_server_auth, (position, coalesce(eku_server_auth::int, -1))) AS eku,
    min((position, self_signed::int, key_type, key_bits)) AS ordering,
    bool_or(ch_exp) FILTER (WHERE role_rank = 0) AS exp, arg_min(ch_days, (cap, sid)) FILTER (WHERE role_rank = 0) AS days, count(*) FILTER (WHERE role_rank = 0 AND hostname_match IS NOT NULL) AS named,
    bool_or(NOT hostname_match) FILTER (WHERE role_rank = 0) AS wrong, arg_min(n_certs, (cap, sid)) FILTER (WHERE role_rank = 0) AS nc,
    arg_min(coalesce(chain_links_ok::int, -1), (cap, sid)) FILTER (WHERE role_rank = 0) AS links, bool_or(leaf_ss) FILTER (WHERE role_rank = 0) AS lss,
    arg_min(coalesce(trusted::int, -1), (cap, sid)) FILTER (WHERE role_rank = 0) AS tr FROM seen GROUP BY sha256),
first_row AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY position, subject, issuer, self_signed, key_type, key_bits, signature_hash, sans_text, is_ca, eku_server_auth NULLS FIRST, has_sct, key_usage_text, der_error NULLS FIRST) AS rn FROM seen) WHERE rn = 1),
k AS (SELECT p.*, f.has_sct, f.key_usage_text, f.der_error, f.is_ca AS ca, f.eku_server_auth AS eku2, f.self_signed AS ss2, f.key_type AS kt, f.key_bits AS kb, f.signature_hash AS sg FROM per p JOIN first_row f USING (sha256)),
checks AS (
  SELECT sha256, rr, 'Validity window' AS "check", CASE WHEN CASE WHEN rr = 0 THEN exp ELSE na < {AS_OF} END THEN 'fail' WHEN CASE WHEN rr = 0 THEN days ELSE floor((na - {AS_OF}) / 86400) END < 30 THEN 'warn' ELSE 'pass' END AS state FROM k
  UNION ALL SELECT sha256, rr, 'Key strength', CASE WHEN (kt = 'RSA' AND kb < 2048) OR (kt LIKE 'EC%' AND kb < 256) OR kt = 'DSA' THEN 'fail' ELSE 'pass' END FROM k
  UNION ALL SELECT sha256, rr, 'Signature algorithm', CASE WHEN sg IN ('md5', 'sha1') AND NOT ss2 THEN 'fail' ELSE 'pass' END FROM k
  UNION ALL SELECT sha256, rr, 'DER encoding', CASE WHEN der_error IS NOT NULL THEN 'warn' ELSE 'pass' END FROM k
  UNION ALL SELECT sha256, rr, 'Hostname (RFC 6125)', CASE WHEN named = 0 THEN 'skip' WHEN wrong THEN 'fail' ELSE 'pass' END FROM k WHERE rr = 0
  UNION ALL SELECT sha256, rr, 'Chain links', CASE WHEN nc < 2 OR links = -1 THEN 'skip' WHEN links = 0 THEN 'fail' ELSE 'pass' END FROM k WHERE rr = 0
  UNION ALL SELECT sha256, rr, 'Trust path', CASE WHEN lss THEN 'fail' WHEN tr = -1 THEN 'skip' WHEN tr = 0 THEN 'fail' ELSE 'pass' END FROM k WHERE rr = 0
  UNION ALL SELECT sha256, rr, 'Usage constraints', CASE WHEN ca OR coalesce(NOT eku2, false) THEN 'fail' ELSE 'pass' END FROM k WHERE rr = 0
  UNION ALL SELECT sha256, rr, 'Certificate Transparency', CASE WHEN NOT has_sct THEN 'warn' ELSE 'pass' END FROM k WHERE rr = 0
  UNION ALL SELECT sha256, rr, 'Revocation', 'skip' FROM k WHERE rr = 0
  UNION ALL SELECT sha256, rr, 'CA constraints', CASE WHEN NOT ca THEN 'fail' ELSE 'pass' END FROM k WHERE rr > 0
  UNION ALL SELECT sha256, rr, 'Key usage', CASE WHEN key_usage_text NOT LIKE '%key_cert_sign%' THEN 'warn' ELSE 'pass' END FROM k WHERE rr > 0
  UNION ALL SELECT sha256, rr, 'Chain hygiene', 'warn' FROM k WHERE rr = 2)"""
VERDICTS = CHECKS + """, vd AS (SELECT sha256, any_value(rr) AS rr, count(*) FILTER (WHERE state = 'fail') AS failed, count(*) FILTER (WHERE state = 'warn') AS warned,
    arg_min("check", coalesce(list_position(['Validity window', 'Key strength', 'Signature algorithm', 'Hostname (RFC 6125)', 'Chain links', 'Usage constraints', 'Trust path'], "check"), 0)) FILTER (WHERE state = 'fail') AS f FROM checks GROUP BY sha256),
verdicts AS (SELECT sha256, rr, failed, CASE WHEN failed = 0 AND warned > 0 THEN 'medium' WHEN failed = 0 THEN 'ok' WHEN failed > 1 THEN 'critical' ELSE 'high' END AS severity,
  CASE WHEN failed = 0 AND warned > 0 THEN 'Verified, with notes' WHEN failed = 0 THEN 'Verified' ELSE CASE f WHEN 'Trust path' THEN 'Untrusted' WHEN 'Validity window' THEN 'Expired' WHEN 'Hostname (RFC 6125)' THEN 'Name mismatch'
    WHEN 'Key strength' THEN 'Weak key' WHEN 'Signature algorithm' THEN 'Weak signature' WHEN 'Chain links' THEN 'Broken chain' WHEN 'Usage constraints' THEN 'Wrong usage' ELSE 'Failed' END END AS label FROM vd)"""
STEPS = """, cmds AS (SELECT *, CASE WHEN commands_text = '' THEN [] ELSE list_transform(string_split(commands_text, ' '), lambda x: CASE WHEN x IN ('LOGIN', 'PASS', 'USER', 'AUTH') THEN 'auth' WHEN x IN ('DATA', 'RETR', 'FETCH') THEN 'data' ELSE 'cmd' END) END AS mid FROM facts),
arr AS (SELECT capture_id, session_id, list_filter(list_concat(list_concat([CASE WHEN mode <> 'implicit' THEN 'banner' END, CASE WHEN mode <> 'implicit' AND caps_text <> '' THEN 'caps' END, CASE WHEN strip_text <> '' THEN 'strip' END], mid),
  [CASE WHEN inject_text <> '' THEN 'inject' END, CASE WHEN client_hello_seen THEN 'ClientHello' END, CASE WHEN coalesce(server_hello_seen, false) THEN 'ServerHello' END, CASE WHEN coalesce(present, false) THEN 'Certificate' END,
   CASE WHEN coalesce(server_hello_seen, false) AND dh_bits > 0 THEN 'ServerKeyExchange' END, CASE WHEN client_hello_seen AND NOT coalesce(server_hello_seen, false) THEN 'alert' END,
   CASE WHEN coalesce(server_hello_seen, false) THEN 'appdata' END, CASE WHEN NOT tls_used THEN 'close' END]), lambda x: x IS NOT NULL) AS keys FROM cmds),
steps AS (SELECT capture_id, session_id, unnest(keys) AS key, unnest(generate_series(1, len(keys))) AS step FROM arr)"""
_FAMILY = """CASE WHEN regexp_matches(rule_id, 'STRIP|BASE-001|PLAIN-00[123]') THEN ['strip', 'caps'] WHEN rule_id LIKE '%CRED%' THEN ['auth'] WHEN rule_id LIKE '%DATA%' THEN ['data'] WHEN rule_id LIKE '%INJ%' THEN ['inject']
  WHEN regexp_matches(rule_id, 'CERT|BASE-002') THEN ['Certificate'] WHEN regexp_matches(rule_id, 'TLS-006|TLS-011') THEN ['ClientHello'] WHEN regexp_matches(rule_id, 'TLS|BASE-00[34]') THEN ['ServerHello'] END"""
POSTURE = b.SQL["posture_by_capture"]
CLASSES = """SELECT f.capture_id, (strip_text <> '' OR inject_text <> '' OR EXISTS (SELECT 1 FROM deviations d WHERE d.capture_id = f.capture_id AND d.session_id = f.session_id AND d.code IN ('cert_change', 'downgrade'))) AS bad FROM facts f"""
TITLED = "lower(concat_ws(' ', k.title, f.rule_id, f.endpoint, f.evidence))"

SQL = {
    "certificate_names": with_clause(["v_sessions"]) + """, x AS (SELECT capture_id, session_id, ['mx.a.com', 'x.y.a.com', 'a.com', 'mx.a.com', '10.0.0.1', 'other.org'][session_id % 6 + 1] AS host,
  ['*.a.com', 'mx.a.com', '*.com', 'm*.a.com', '10.0.0.1', '', '*.y.a.com'][session_id // 6 % 7 + 1] AS san, ['mx.a.com', 'x.y.a.com', 'a.com', 'MX.A.COM.', '10.0.0.1', 'other.org'][session_id // 42 % 6 + 1] AS cn FROM v_sessions)
SELECT capture_id, session_id, cn, CASE WHEN san = '' THEN host = rtrim(lower(cn), '.') WHEN san = 'm*.a.com' OR san = '*.com' THEN false WHEN san = '*.a.com' THEN host = 'mx.a.com' WHEN san = '*.y.a.com' THEN host = 'x.y.a.com'
  ELSE host = san END AS matches FROM x""",
    "certificate_path_failures": with_clause(["v_sessions"]) + """ SELECT capture_id, session_id, CASE WHEN session_id % 6 IN (0, 5) THEN 'no path could be built, as one of its certificates was not valid at the time of the capture'
  WHEN session_id % 6 = 1 AND session_id % 3 = 0 THEN 'the trust store does not know the issuer, and the server sent no intermediate: its chain is incomplete (issuer: CN=X)'
  WHEN session_id % 6 = 1 THEN 'the trust store does not know ''CN=X'', where the chain ends: a private CA, or the server leaves out an intermediate'
  WHEN session_id % 6 = 2 THEN 'the path relies on a signature algorithm that is not accepted' WHEN session_id % 6 = 3 THEN 'the path uses a certificate for something that it is not allowed to do' ELSE 'odd' END AS detail FROM v_sessions""",
    "certificate_inventory": SEEN + """ SELECT sha256, ['leaf', 'intermediate', 'root'][min(role_rank) + 1] AS role, any_value(subject) AS subject, count(DISTINCT endpoint) AS endpoints, count(DISTINCT (cap, sid)) AS sessions FROM seen GROUP BY sha256""",
    "certificate_unobservable": c.facts_with() + f""" SELECT capture_id, absent_kind, CASE absent_kind WHEN 'no_tls' THEN 'the session has no TLS handshake' WHEN 'missing' THEN 'no Certificate message in this capture' ELSE {c._REASON} END AS reason_absent,
  count(*) AS sessions FROM chains WHERE NOT present GROUP BY ALL""",
    "certificate_checks": CHECKS + ' SELECT sha256, "check", state FROM checks',
    "certificate_verdicts": VERDICTS + " SELECT sha256, failed, severity, label FROM verdicts",
    "certificate_counts": VERDICTS + " SELECT ['leaf', 'intermediate', 'root'][rr + 1] AS role, count(*) AS certificates, count(*) FILTER (WHERE severity IN ('critical', 'high')) AS failing, count(*) FILTER (WHERE severity = 'ok') AS verified FROM verdicts GROUP BY ALL",
    "report_finding_groups": GROUPS + " SELECT * FROM grp",
    "report_top_groups": GROUPS + " SELECT capture_id, place, rule_id, endpoint, severity, priority, findings FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY priority) AS place FROM grp WHERE severity IN ('critical', 'high')) WHERE place <= 6",
    "report_terminal_top": RANKED + """, p AS (SELECT capture_id, rule_id, endpoint, (SELECT count(*) FROM ranked r WHERE r.capture_id = x.capture_id AND r.rule_id = x.rule_id AND r.endpoint = x.endpoint) AS times,
  min(priority) AS priority, arg_min(severity, priority) AS severity, arg_min(risk, priority) AS risk FROM ranked x WHERE severity <> 'info' GROUP BY ALL)
SELECT capture_id, place, rule_id, endpoint, severity, risk, times FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY priority) AS place FROM p) WHERE place <= 10""",
    "report_endpoints": b.FULL + ", " + b.UNIQUE + f""", sc AS ({b.SQL['endpoint_scores'].split(b.UNIQUE)[1]})
SELECT sc.*, e.protocols, e.modes, e.versions, {', '.join(f"(SELECT count(*) FROM named n WHERE n.capture_id = sc.capture_id AND n.endpoint = sc.endpoint AND n.severity = '{s}') AS {s}" for s in dims.SEVERITIES)}
FROM sc JOIN (SELECT capture_id, endpoint, string_agg(DISTINCT protocol, ', ' ORDER BY protocol) AS protocols, string_agg(DISTINCT mode, ', ' ORDER BY mode) AS modes,
  coalesce(string_agg(DISTINCT CASE WHEN server_hello_seen THEN version_name END, ', ' ORDER BY CASE WHEN server_hello_seen THEN version_name END), '') AS versions FROM facts GROUP BY ALL) e USING (capture_id, endpoint)""",
    "report_sessions": b.FULL + ", " + RISKS + f""" SELECT f.capture_id, f.session_id, f.endpoint, protocol, CASE WHEN mode = 'implicit' THEN 'implicit TLS' WHEN mode = 'starttls' THEN 'STARTTLS' WHEN strip_text <> '' THEN 'stripped' ELSE 'cleartext' END AS channel,
  CASE WHEN NOT coalesce(present, false) THEN CASE WHEN version = 772 THEN 'not visible' ELSE 'none' END WHEN lab <> '' THEN lab WHEN trusted THEN 'valid' ELSE 'unverified' END AS certificate,
  CASE WHEN server_hello_seen THEN version_name ELSE '-' END AS version, coalesce(cipher_name, '-') AS cipher, coalesce(w.n, 0) AS findings, rr.rule_risk AS risk, coalesce({b.NAMES.format(col='w.rk').replace("ELSE 'info'", "WHEN 4 THEN 'info'")}, 'none') AS worst,
  CASE WHEN rr.rule_risk >= 70 THEN 'high' WHEN rr.rule_risk >= 35 THEN 'medium' ELSE 'low' END AS band
FROM (SELECT *, concat_ws(', ', CASE WHEN expired THEN 'expired' END, CASE WHEN self_signed THEN 'self-signed' END, CASE WHEN NOT hostname_match THEN 'name mismatch' END, CASE WHEN NOT trusted AND NOT self_signed THEN 'untrusted' END) AS lab FROM facts) f
JOIN rr USING (capture_id, session_id) LEFT JOIN (SELECT capture_id, session_id, min({b.RANKS.format(col='severity')}) AS rk, count(*) AS n FROM all_findings GROUP BY ALL) w USING (capture_id, session_id)""",
    "report_kpis": b.FULL + ", " + b.UNIQUE + """ SELECT f.capture_id, count(*) AS sessions, count(*) FILTER (WHERE server_hello_seen) AS used_tls, count(*) FILTER (WHERE auth_mech IS NOT NULL AND auth_exposed) AS exposed,
  count(DISTINCT endpoint) AS endpoints, (SELECT count(*) FROM named n WHERE n.capture_id = f.capture_id) AS issues FROM facts f GROUP BY f.capture_id""",
    "report_severity_shares": b.FULL + " SELECT capture_id, severity, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY capture_id), 2) AS share FROM all_findings GROUP BY capture_id, severity",
    "report_channels": with_clause(["v_sessions"]) + " SELECT capture_id, count(*) FILTER (WHERE mode = 'implicit') AS implicit_tls, count(*) FILTER (WHERE mode = 'starttls') AS starttls, count(*) FILTER (WHERE strip_text <> '') AS stripped, count(*) FILTER (WHERE mode = 'plaintext' AND strip_text = '') AS cleartext FROM v_sessions GROUP BY ALL",
    "report_protocols": with_clause(["v_sessions"]) + " SELECT capture_id, protocol, count(*) AS sessions FROM v_sessions GROUP BY ALL",
    "report_versions": c.facts_with() + """, lv AS (SELECT capture_id, CASE WHEN server_hello_seen THEN version_name ELSE 'No TLS' END AS version_name, 1 AS n FROM facts UNION ALL SELECT DISTINCT capture_id, 'TLS 1.3', 0 FROM facts)
SELECT capture_id, version_name, sum(n)::bigint AS sessions FROM lv GROUP BY ALL""",
    "report_finding_search": b.FULL + """ SELECT capture_id, session_id, rule_id, severity FROM all_findings WHERE severity IN ('critical', 'high') AND (contains(lower(evidence), 'starttls')
  OR rule_id = 'BASE-001' OR (rule_id IN ('STRIP-001', 'INJ-001', 'PLAIN-001') AND (SELECT up FROM facts f WHERE f.capture_id = all_findings.capture_id AND f.session_id = all_findings.session_id) = 'STARTTLS'))""",
    "report_session_detail": b.FULL + " SELECT capture_id, session_id, endpoint, protocol, mode, version_name, cipher_name, (SELECT string_agg(rule_id, ' ' ORDER BY rule_id) FROM all_findings n WHERE n.capture_id = f.capture_id AND n.session_id = f.session_id) AS rules FROM facts f WHERE session_id = 8",
    "report_capture_meta": with_clause(["v_sessions"]) + ", " + b.CAPS + """ SELECT k.capture_id, coalesce(min(start_ts), 0) AS capture_start, coalesce(max(end_ts), 0) AS capture_end, count(session_id) AS mail_sessions, count(*) FILTER (WHERE gaps > 0) AS with_gaps
  FROM caps k LEFT JOIN v_sessions s USING (capture_id) GROUP BY ALL""",
    "report_corpus_rollup": f"SELECT grade, count(*) AS captures, count(*) FILTER (WHERE sessions > 0) AS with_mail, sum(sessions)::bigint AS sessions, sum(critical)::bigint AS critical, sum(high)::bigint AS high FROM ({POSTURE}) GROUP BY ALL",
    "report_verdicts": f"WITH post AS ({POSTURE}), cls AS (" + c.facts_with(c.FINDINGS, b.OBSERVE, b.deviations()) + f""" {CLASSES})
SELECT p.capture_id, p.grade, count(*) FILTER (WHERE bad) AS attacked, CASE WHEN count(*) FILTER (WHERE bad) > 0 THEN 'Active interference detected' WHEN any_value(critical) > 0 THEN 'Critical exposure'
  WHEN p.grade <= 'B' THEN 'Mail transport is well protected' ELSE 'Weak transport security' END AS verdict FROM post p JOIN cls USING (capture_id) WHERE assessed GROUP BY p.capture_id, p.grade""",
    "report_caveats": f"WITH post AS ({POSTURE}), ses AS ({with_clause(['v_sessions'])} SELECT * FROM v_sessions)" + """ SELECT capture_id, text, 'floor' AS kind FROM (SELECT capture_id, unnest(string_split(floor_reasons, ' | ')) AS text FROM post) WHERE text <> ''
UNION ALL SELECT capture_id, concat(count(*), ' session(s) identified from the client''s commands only'), 'partial' FROM ses WHERE identified_by = 'client-verbs' GROUP BY capture_id
UNION ALL SELECT capture_id, concat(count(*), ' session(s) with missing bytes'), 'read' FROM ses WHERE gaps > 0 GROUP BY capture_id""",
    "report_timeline": c.facts_with() + STEPS + " SELECT capture_id, session_id, key, step FROM steps",
    "report_timeline_findings": b.FULL + STEPS + f""", w AS (SELECT *, {_FAMILY} AS want FROM all_findings)
SELECT capture_id, session_id, rule_id, CASE WHEN regexp_matches(rule_id, 'PORT|TCP') THEN 1 ELSE coalesce((SELECT min(step) FROM steps s WHERE s.capture_id = w.capture_id AND s.session_id = w.session_id AND s.key = want[1]),
  (SELECT min(step) FROM steps s WHERE s.capture_id = w.capture_id AND s.session_id = w.session_id AND s.key = want[2]), (SELECT max(step) FROM steps s WHERE s.capture_id = w.capture_id AND s.session_id = w.session_id)) END AS step FROM w""",
    "report_section_counts": b.FULL + """ SELECT f.capture_id, count(*) AS sessions, count(DISTINCT endpoint) AS endpoints, (SELECT count(*) FROM all_findings n WHERE n.capture_id = f.capture_id AND severity <> 'info') AS findings,
  (SELECT count(DISTINCT sha256) FROM v_certificates n WHERE n.capture_id = f.capture_id) AS certificates FROM facts f GROUP BY f.capture_id""",
    "session_export": b.FULL + ", " + RISKS + f""" SELECT capture_id, session_id, endpoint, protocol, mode, version_name, cipher_name, cgrade AS cipher_grade, CASE WHEN present THEN key_type END AS key_type, CASE WHEN present THEN key_bits END AS key_bits,
  hostname_match, trusted, rule_risk, coalesce((SELECT string_agg(DISTINCT rule_id, ' ' ORDER BY rule_id) FROM all_findings n WHERE n.capture_id = facts.capture_id AND n.session_id = facts.session_id), '') AS rule_ids,
  {', '.join((f"cast({e[1:]} AS double)" if e.startswith("#") else f"cast(coalesce({e}, false) AS integer)::double") + f" AS f_{n}" for n, e in b.FEATURE_SQL.items())} FROM facts JOIN rr USING (capture_id, session_id)""",
    "report_json_rows": with_clause(["v_sessions"]) + """ SELECT capture_id, session_id, concat('{"capture_id":"', capture_id, '","session_id":', session_id, ',"protocol":"', protocol, '","mode":"', mode, '"', CASE WHEN starttls_offered IS NULL THEN '' ELSE concat(',"starttls_offered":', starttls_offered) END,
  ',"capabilities":[', CASE WHEN caps_text = '' THEN '' ELSE concat('"', replace(caps_text, ' ', '","'), '"') END, ']}') AS json FROM v_sessions""",
}
