"""Reference SQL of the baseline, feature and scoring queries."""

from __future__ import annotations

from mailveil import dims
from mailveil.plans.views import with_clause
from oracles import common as c

RANKS = "CASE {col} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END"
WEIGHT = "CASE {col} WHEN 'critical' THEN 1.0::double WHEN 'high' THEN 0.7 WHEN 'medium' THEN 0.4 WHEN 'low' THEN 0.15 ELSE 0.0 END"
PENALTY = "CASE {col} WHEN 'critical' THEN 30 WHEN 'high' THEN 12 WHEN 'medium' THEN 5 WHEN 'low' THEN 1 ELSE 0 END"
NAMES = "CASE {col} WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END"
GRADE = "CASE WHEN {col} >= 90 THEN 'A' WHEN {col} >= 80 THEN 'B' WHEN {col} >= 70 THEN 'C' WHEN {col} >= 60 THEN 'D' ELSE 'F' END"
ORDINAL = "CASE {col} WHEN 512 THEN 1 WHEN 768 THEN 1 WHEN 769 THEN 2 WHEN 770 THEN 3 WHEN 771 THEN 4 WHEN 772 THEN 5 ELSE 0 END"
PLACE = "CASE {col} WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 WHEN 'F' THEN 3 END"

OBSERVE = """obs AS (
  SELECT capture_id, session_id, endpoint_key, start_ts AS ts, CASE WHEN mode = 'implicit' THEN true ELSE starttls_offered END AS starttls_offered,
    coalesce(server_hello_seen, false) AS tls_used, version, cipher_suite AS cipher, cgrade AS grade, ja3s,
    CASE WHEN present THEN sha256 END AS cert_fp, CASE WHEN present THEN leaf_issuer END AS cert_issuer,
    CASE WHEN present THEN self_signed END AS self_signed, CASE WHEN present THEN trusted END AS trusted, strip_text,
    NOT EXISTS (SELECT 1 FROM findings f WHERE f.capture_id = facts.capture_id AND f.session_id = facts.session_id AND f.severity = 'critical') AS clean
  FROM facts)"""


def deviations(obs: str = "obs", history: str | None = None) -> str:
    """Peers by an explicit self-join, which is what leave-one-out means."""
    stored = (f" UNION ALL SELECT o.capture_id, o.session_id, h.*, 0 AS src FROM {obs} o JOIN {history} h ON h.endpoint_key = o.endpoint_key AND h.clean"
              if history else "")
    return f"""peers AS (
  SELECT o.capture_id AS oc, o.session_id AS os, p.*, 1 AS src FROM {obs} o JOIN {obs} p ON p.capture_id = o.capture_id AND p.endpoint_key = o.endpoint_key
    AND p.session_id <> o.session_id AND p.clean{stored}),
peer_stats AS (SELECT oc, os, count(*) AS n, count(*) FILTER (WHERE starttls_offered IS NOT NULL OR tls_used) AS informative,
    count(*) FILTER (WHERE coalesce(starttls_offered, false) OR tls_used) AS offered, count(cert_fp) AS n_fp, count(version) AS n_version,
    count(grade) AS n_grade, count(ja3s) AS n_ja3s, count(cert_issuer) AS n_issuer, list(DISTINCT cert_fp) AS fps, list(DISTINCT cert_issuer) AS issuers, list(DISTINCT ja3s) AS js
  FROM peers GROUP BY oc, os HAVING count(*) >= 3),
peer_versions AS (SELECT oc, os, arg_max(version, k) AS usual, max(k) AS k FROM (SELECT oc, os, version, count(*) AS k FROM peers WHERE version IS NOT NULL GROUP BY ALL) GROUP BY ALL),
peer_grades AS (SELECT oc, os, arg_max(grade, k) AS usual, max(k) AS k FROM (SELECT oc, os, grade, count(*) AS k FROM peers WHERE grade IS NOT NULL GROUP BY ALL) GROUP BY ALL),
peer_fps AS (SELECT oc, os, string_agg(concat(substr(cert_fp, 1, 16), '... x', k), ', ' ORDER BY k DESC, first_src, first_ts, first_id) AS known FROM (
  SELECT *, row_number() OVER (PARTITION BY oc, os ORDER BY k DESC, first_src, first_ts, first_id) AS r FROM (
    SELECT oc, os, cert_fp, count(*) AS k, arg_min(src, (src, ts, session_id)) AS first_src, arg_min(ts, (src, ts, session_id)) AS first_ts, arg_min(session_id, (src, ts, session_id)) AS first_id
    FROM peers WHERE cert_fp IS NOT NULL GROUP BY oc, os, cert_fp)) WHERE r <= 2 GROUP BY ALL),
judged AS (SELECT o.*, s.*, v.usual AS usual_v, v.k AS kv, g.usual AS usual_g, g.k AS kg, f.known,
    s.informative >= 3 AND s.offered / s.informative >= 0.8 AND NOT o.tls_used AND (coalesce(NOT o.starttls_offered, false) OR o.strip_text <> '') AS f_drop,
    o.cert_fp IS NOT NULL AND s.n_fp >= 3 AND NOT list_contains(s.fps, o.cert_fp) AND (coalesce(o.self_signed, false) OR coalesce(NOT o.trusted, false)
      OR (s.n_issuer > 0 AND NOT coalesce(list_contains(s.issuers, o.cert_issuer), false))) AS f_cert,
    coalesce(o.version IS NOT NULL AND v.k / s.n_version >= 0.8 AND {ORDINAL.format(col='o.version')} < {ORDINAL.format(col='v.usual')}, false) AS f_old,
    coalesce(g.k / s.n_grade >= 0.8 AND {PLACE.format(col='o.grade')} > {PLACE.format(col='g.usual')}, false) AS f_weak0,
    o.ja3s IS NOT NULL AND s.n_ja3s >= 3 AND NOT list_contains(s.js, o.ja3s) AS f_new0
  FROM {obs} o JOIN peer_stats s ON s.oc = o.capture_id AND s.os = o.session_id
  LEFT JOIN peer_versions v ON v.oc = s.oc AND v.os = s.os LEFT JOIN peer_grades g ON g.oc = s.oc AND g.os = s.os LEFT JOIN peer_fps f ON f.oc = s.oc AND f.os = s.os),
deviations AS (
  SELECT capture_id, session_id, endpoint_key, 'starttls_drop' AS code, 'BASE-001' AS rule_id, 'critical' AS severity, 0.9 AS exploitability,
    concat('endpoint offered TLS in ', offered, ' of ', informative, ' baseline sessions; this session: ', CASE WHEN NOT starttls_offered THEN 'capability absent' ELSE 'no TLS' END,
      CASE WHEN strip_text <> '' THEN concat(' | ', strip_text) ELSE '' END) AS evidence FROM judged WHERE f_drop
  UNION ALL SELECT capture_id, session_id, endpoint_key, 'cert_change', 'BASE-002', 'critical', 0.8,
    concat('presented ', substr(cert_fp, 1, 16), '... (issuer ', coalesce(cert_issuer, 'None'), ') | baseline certificates: ', known, ' | new certificate is ',
      CASE WHEN self_signed THEN 'self-signed' WHEN NOT trusted THEN 'untrusted' ELSE 'from a new issuer' END) FROM judged WHERE f_cert
  UNION ALL SELECT capture_id, session_id, endpoint_key, 'downgrade', 'BASE-003', 'high', 0.6,
    concat('negotiated ', {c.version_name_sql('version')}, '; endpoint normally negotiates ', {c.version_name_sql('usual_v')}, ' (', kv, '/', n_version, ' sessions)') FROM judged WHERE f_old
  UNION ALL SELECT capture_id, session_id, endpoint_key, 'downgrade', 'BASE-003', 'high', 0.6,
    concat('cipher grade ', grade, '; endpoint normally grade ', usual_g) FROM judged WHERE f_weak0 AND NOT f_old
  UNION ALL SELECT capture_id, session_id, endpoint_key, 'new_ja3s', 'BASE-004', 'low', 0.3,
    concat('JA3S ', ja3s, ' not seen in known fingerprint(s)') FROM judged WHERE f_new0 AND NOT f_drop AND NOT f_cert AND NOT f_old AND NOT f_weak0)"""


ALL_FINDINGS = """reasons AS (SELECT capture_id, session_id, bool_or(code = 'starttls_drop') AS dropped, bool_or(code = 'cert_change') AS changed FROM deviations GROUP BY ALL),
raised AS (
  SELECT f.*, f.severity <> 'critical' AND ((f.rule_id IN ('STRIP-001', 'PLAIN-001', 'PLAIN-003') AND coalesce(dropped, false)) OR (f.rule_id IN ('CERT-002', 'CERT-003', 'CERT-007') AND coalesce(changed, false))) AS up
  FROM findings f LEFT JOIN reasons USING (capture_id, session_id)),
all_findings AS (
  SELECT capture_id, session_id, endpoint, endpoint_key, rule_id, CASE WHEN up THEN 'critical' ELSE severity END AS severity, CASE WHEN up THEN severity END AS escalated_from,
    evidence, exploitability, confidence FROM raised
  UNION ALL SELECT d.capture_id, d.session_id, s.endpoint, d.endpoint_key, d.rule_id, d.severity, NULL, d.evidence, d.exploitability, 0.8
  FROM deviations d JOIN v_sessions s USING (capture_id, session_id))"""

FULL = c.facts_with(c.FINDINGS, OBSERVE, deviations(), ALL_FINDINGS)
DEV_COLS = "SELECT capture_id, session_id, endpoint_key, code, rule_id, severity, cast(exploitability AS double) AS exploitability, evidence FROM deviations"

PRIVATE = ("({ip} LIKE '10.%' OR {ip} LIKE '172.20.%' OR {ip} LIKE '198.51.100.%' OR {ip} LIKE '203.0.113.%' OR {ip} LIKE 'fd00:%' OR {ip} LIKE '2001:db8:%')")
CONTEXT = f"""assets AS (
  SELECT concat('10.1.0.', n_nationkey * 2 + 1) AS asset, 1.0 + n_nationkey / 50 AS weight FROM nation
  UNION ALL SELECT concat('93.184.216.', n_nationkey, ':25'), 1.5 FROM nation
  UNION ALL SELECT concat('mx', n_nationkey, '.example.org'), 1.25 FROM nation WHERE n_nationkey < 5
  UNION ALL SELECT 'default', 0.9 FROM nation WHERE n_nationkey = 0),
context AS (SELECT s.capture_id, s.session_id,
  CASE {c.port_class_sql('s.server_port')} WHEN 'relay' THEN 0.85::double WHEN 'nonstandard' THEN 0.9 ELSE 1.0 END
    * CASE WHEN {PRIVATE.format(ip='s.client_ip')} AND {PRIVATE.format(ip='s.server_ip')} THEN 0.8::double ELSE 1.0 END AS exposure,
  coalesce((SELECT weight FROM assets WHERE asset = s.endpoint_key), (SELECT weight FROM assets WHERE asset = s.server_ip),
    (SELECT weight FROM assets WHERE asset = s.endpoint), (SELECT weight FROM assets WHERE asset = s.server_name), (SELECT weight FROM assets WHERE asset = 'default'), 1.0)::double AS criticality
  FROM v_sessions s)"""


def scored(src: str) -> str:
    return f"""scored AS (SELECT f.*, x.exposure, x.criticality,
  {c.round1(f"least(100.0::double, 100.0::double * {WEIGHT.format(col='f.severity')} * x.exposure * (0.5::double + 0.5::double * f.exploitability) * x.criticality)")} AS risk
  FROM {src} f JOIN context x USING (capture_id, session_id))"""


UNIQUE = f"""uniq AS (SELECT capture_id, replace(replace(rule_id, 'TLS-013a', 'TLS-013'), 'TLS-013b', 'TLS-013') AS rule_id, endpoint,
  min({RANKS.format(col='severity')}) AS rank FROM all_findings GROUP BY ALL),
named AS (SELECT capture_id, rule_id, endpoint, {NAMES.format(col='rank')} AS severity FROM uniq)"""
FLAGS = """flags AS (SELECT capture_id, count(*) AS sessions, bool_or(cleartext_bytes <> 0) AS cleartext_content,
  bool_or(tls_used AND has_handshake AND NOT coalesce(present, false)) AS unverified_tls FROM facts GROUP BY ALL)"""
CAPS = "caps AS (SELECT DISTINCT concat('cap', s_suppkey % 23) AS capture_id FROM supplier)"
COUNTS = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in dims.SEVERITIES)

_ONE = "cast(coalesce({e}, false) AS integer)::double AS {n}"
FEATURE_SQL = {
    **{f"proto_{p.lower()}": f"protocol = '{p}'" for p in ("SMTP", "IMAP", "POP3")},
    **{f"port_{p}": f"pc = '{p}'" for p in ("relay", "submission", "access", "nonstandard")},
    "mode_ordinal": "#CASE mode WHEN 'starttls' THEN 1.0 WHEN 'implicit' THEN 2.0 ELSE 0.0 END",
    "tls_version": f"#CASE WHEN server_hello_seen THEN {ORDINAL.format(col='version')} ELSE 0 END",
    "forward_secrecy": "server_hello_seen AND cipher_suite IS NOT NULL AND fs",
    "aead": "server_hello_seen AND cipher_suite IS NOT NULL AND ad",
    "cipher_grade": "#CASE WHEN server_hello_seen THEN CASE cgrade WHEN 'A' THEN 0 WHEN 'B' THEN 1 WHEN 'C' THEN 2 WHEN 'F' THEN 3 WHEN '?' THEN 2 ELSE 0 END ELSE 4 END",
    "weak_dh_or_curve": "server_hello_seen AND (coalesce(dh_bits < 2048, false) OR coalesce(grp IN (19, 21), false))",
    "compression": "server_hello_seen AND compression <> 0",
    "downgrade_signal": "server_hello_seen AND (downgrade_sentinel IS NOT NULL OR fallback_scsv)",
    "handshake_failed": "client_hello_seen AND (alerts_text LIKE '2:%' OR NOT server_hello_seen)",
    "cert_visible": "present", "cert_expired": "present AND (expired OR not_yet_valid)", "cert_self_signed": "present AND self_signed",
    "cert_hostname_mismatch": "present AND NOT hostname_match", "cert_untrusted": "present AND NOT trusted",
    "cert_key_weakness": "#CASE WHEN NOT coalesce(present, false) THEN 0 ELSE round(greatest(0::double, 1::double - key_bits / CASE WHEN key_type LIKE 'EC%' THEN 256 ELSE 2048 END), 3) END",
    "cert_weak_sig": "present AND signature_hash IN ('md5', 'sha1')",
    "starttls_offered": "coalesce(starttls_offered, false) OR mode = 'implicit'", "strip_indicator": "strip_text <> ''", "injection": "inject_text <> ''",
    "cleartext_auth": "auth_mech IS NOT NULL AND auth_exposed", "weak_auth": "auth_mech IS NOT NULL AND NOT auth_exposed",
    "cleartext_data": "#round(least(ln(1 + greatest(cleartext_bytes, 0)::double) / 12, 1::double), 3)",
    "overlap_conflicts": "#least(greatest(overlap_conflicts, 0), 5) / 5",
    **{f"base_{k}": f"EXISTS (SELECT 1 FROM deviations d WHERE d.capture_id = facts.capture_id AND d.session_id = facts.session_id AND d.code = '{k}')"
       for k in ("starttls_drop", "cert_change", "downgrade", "new_ja3s")},
}
FEATURE_LIST = ", ".join(f"cast({e[1:]} AS double) AS {n}" if e.startswith("#") else _ONE.format(e=e, n=n) for n, e in FEATURE_SQL.items())
V_OBS = with_clause(["v_observations"])

SQL = {
    "baseline_observations": c.facts_with(c.FINDINGS, OBSERVE) + """ SELECT capture_id, session_id, endpoint_key, starttls_offered, tls_used,
  version, cipher, grade, ja3s, cert_fp, cert_issuer, self_signed, trusted, clean FROM obs""",
    "baseline_deviations": V_OBS + ", " + """hist AS (SELECT * FROM v_observations WHERE capture_id = 'stored'),
cur AS (SELECT * FROM v_observations WHERE capture_id <> 'stored'), """ + deviations("cur", "hist") + DEV_COLS,
    "baseline_session_deviations": c.facts_with(c.FINDINGS, OBSERVE, deviations()) + DEV_COLS,
    "baseline_escalation": FULL + " SELECT capture_id, session_id, rule_id, severity, escalated_from FROM all_findings WHERE escalated_from IS NOT NULL",
    "baseline_clean_final": FULL + """ SELECT o.capture_id, o.session_id, NOT EXISTS (SELECT 1 FROM all_findings f WHERE f.capture_id = o.capture_id AND f.session_id = o.session_id
  AND f.severity IN ('critical', 'high')) AND NOT EXISTS (SELECT 1 FROM deviations d WHERE d.capture_id = o.capture_id AND d.session_id = o.session_id) AS clean FROM obs o""",
    "endpoint_profiles": V_OBS + f"""SELECT o.endpoint_key, count(*) AS sessions, round(avg(cast(starttls_offered AS integer)), 2) AS starttls_rate,
  round(avg(cast(tls_used AS integer)), 2) AS tls_rate, count(DISTINCT cert_fp) AS certificates, count(DISTINCT ja3s) AS fingerprints,
  coalesce((SELECT string_agg(concat(nm, '=', n), ',' ORDER BY nm) FROM (SELECT {c.version_name_sql('version')} AS nm, count(*) AS n FROM v_observations i
    WHERE i.endpoint_key = o.endpoint_key AND version IS NOT NULL GROUP BY ALL)), '') AS versions FROM v_observations o GROUP BY o.endpoint_key""",
    "endpoint_mixed_offers": V_OBS + """SELECT endpoint_key, count(*) AS known, round(avg(cast(starttls_offered AS integer)), 4) AS offer_rate
  FROM v_observations WHERE starttls_offered IS NOT NULL GROUP BY ALL HAVING round(avg(cast(starttls_offered AS integer)), 4) BETWEEN 0.2 AND 0.8""",
    "history_unlearned": V_OBS + """SELECT capture_id, session_id, endpoint_key FROM v_observations WHERE capture_id <> 'stored' AND clean AND session_id % 10 <> 0""",
    "history_newest_features": V_OBS + """SELECT capture_id, session_id, ts FROM v_observations WHERE grade IS NOT NULL ORDER BY ts DESC, session_id DESC LIMIT 5000""",
    "history_of_endpoint": V_OBS + """SELECT capture_id, session_id, ts, tls_used, version FROM v_observations WHERE endpoint_key = '203.0.113.8:25'""",
    "session_feature_vector": c.facts_with(c.FINDINGS, OBSERVE, deviations()) + f" SELECT capture_id, session_id, {FEATURE_LIST} FROM facts",
    "finding_risk": FULL + ", " + CONTEXT + ", " + scored("all_findings") + """ SELECT capture_id, session_id, rule_id,
  round(exposure, 4) AS exposure, criticality, risk FROM scored""",
    "session_risk": FULL + f""", rr AS (SELECT s.capture_id, s.session_id, coalesce(round(100::double * (1::double - product(1::double - {WEIGHT.format(col='f.severity')} * (0.6::double + 0.4::double * f.exploitability))), 1), 0) AS rule_risk
  FROM v_sessions s LEFT JOIN all_findings f USING (capture_id, session_id) GROUP BY ALL)
SELECT capture_id, session_id, rule_risk, round(least(100::double, CASE WHEN session_id % 3 <> 0 THEN 0.6::double * rule_risk + 0.4::double * (session_id % 101) ELSE rule_risk END
  + CASE WHEN session_id % 17 = 0 THEN 10 ELSE 0 END), 1) AS risk FROM rr""",
    "finding_priority": FULL + ", " + CONTEXT + ", " + scored("all_findings") + f""" SELECT capture_id, session_id, rule_id, severity, risk,
  row_number() OVER (PARTITION BY capture_id ORDER BY risk DESC, {RANKS.format(col='severity')}, rule_id, session_id, evidence) AS priority FROM scored""",
    "unique_issues": FULL + ", " + UNIQUE + " SELECT * FROM named",
    "severity_counts": FULL + f" SELECT capture_id, {COUNTS} FROM all_findings GROUP BY ALL",
    "endpoint_scores": FULL + ", " + UNIQUE + f""" SELECT capture_id, endpoint, sessions, issues, score, {GRADE.format(col='score')} AS grade FROM (
  SELECT s.capture_id, s.endpoint, s.sessions, coalesce(u.issues, 0) AS issues,
    cast(CASE WHEN coalesce(u.crit, 0) > 0 THEN least(59, greatest(0, 100 - u.pen)) ELSE greatest(0, 100 - coalesce(u.pen, 0)) END AS bigint) AS score
  FROM (SELECT capture_id, endpoint, count(*) AS sessions FROM v_sessions GROUP BY ALL) s
  LEFT JOIN (SELECT capture_id, endpoint, count(*) AS issues, sum({PENALTY.format(col='severity')}) AS pen, count(*) FILTER (WHERE severity = 'critical') AS crit FROM named GROUP BY ALL) u USING (capture_id, endpoint))""",
    "capture_flags": c.facts_with(FLAGS) + " SELECT * FROM flags",
    "severity_gate": FULL + f""" SELECT capture_id, {NAMES.format(col=f"min({RANKS.format(col='severity')})")} AS worst,
  min({RANKS.format(col='severity')}) <= 0 AS fails FROM all_findings GROUP BY capture_id""",
    "posture_by_capture": FULL + ", " + UNIQUE + ", " + FLAGS + ", " + CAPS + f""", base AS (
  SELECT k.capture_id, coalesce(g.sessions, 0) AS sessions, coalesce(g.cleartext_content, false) AS ct, coalesce(g.unverified_tls, false) AS uv,
    cast(greatest(0, 100 - coalesce((SELECT sum({PENALTY.format(col='severity')}) FROM named n WHERE n.capture_id = k.capture_id), 0)) AS bigint) AS earned_score,
    (SELECT count(*) FROM named n WHERE n.capture_id = k.capture_id) AS unique_issues,
    {', '.join(f"(SELECT count(*) FROM all_findings n WHERE n.capture_id = k.capture_id AND severity = '{s}') AS {s}" for s in dims.SEVERITIES)}
  FROM caps k LEFT JOIN flags g USING (capture_id)),
capped AS (SELECT *, CASE WHEN critical > 0 AND 59 < earned_score THEN 59 WHEN ct AND 60 < earned_score THEN 60 WHEN uv AND 95 < earned_score THEN 95 END AS bind FROM base),
final AS (SELECT *, cast(least(earned_score, coalesce(bind, earned_score)) AS bigint) AS sc FROM capped)
SELECT capture_id, sessions, sessions > 0 AS assessed, CASE WHEN sessions > 0 THEN sc END AS score, CASE WHEN sessions > 0 THEN {GRADE.format(col='sc')} ELSE '—' END AS grade,
  earned_score, unique_issues, critical, high, medium, low, info,
  concat_ws(' | ', CASE WHEN critical > 0 AND 59 < earned_score THEN 'a critical finding — this caps the capture at F' END,
    CASE WHEN ct AND 60 < earned_score THEN concat('message content crossed the network unencrypted — ', CASE WHEN bind = 60 THEN 'this caps the capture at D' ELSE 'on its own that would cap the capture at D' END) END,
    CASE WHEN uv AND 95 < earned_score THEN concat('some TLS sessions had no observable certificate — ', CASE WHEN bind = 95 THEN 'this caps the capture at A' ELSE 'on its own that would cap the capture at A' END) END) AS floor_reasons
FROM final""",
}
