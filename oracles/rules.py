"""Reference SQL of the rule, certificate and cipher queries."""

from __future__ import annotations

from oracles import baseline as b
from oracles import common as c

FINDING_COLS = "capture_id, session_id, endpoint, rule_id, severity, evidence, cast(exploitability AS double) AS exploitability, cast(confidence AS double) AS confidence"


def _rules(parts):
    return c.facts_with(f"findings AS ({c.union(parts)})") + f" SELECT {FINDING_COLS} FROM findings"


SQL = {
    "rules_transport": _rules(c.TRANSPORT_RULES),
    "rules_handshake": _rules(c.TLS_RULES),
    "rules_certificate": _rules(c.CERT_RULES),
    "rule_fire_counts": b.FULL + f"""
SELECT k.rule_id, k.title, k.severity_text, count(f.session_id) AS fired
FROM (VALUES {c.dims.values_sql(c.dims.RULE_CATALOG)}) AS k(rule_id, title, severity_text)
LEFT JOIN all_findings f USING (rule_id) GROUP BY ALL""",
    "cipher_suite_profiles": f"""WITH {c.SUITES}
SELECT x.code::bigint AS code, x.suite, x.kx, x.enc, x.mac, x.fs AS forward_secrecy, x.ad AS aead, x.tls13, x.weak AS weaknesses, x.grade,
  coalesce(n.sessions, 0) AS sessions FROM suites x LEFT JOIN (SELECT cipher_suite, count(*) AS sessions FROM ({c.with_clause(['v_handshakes'])}
  SELECT * FROM v_handshakes) GROUP BY 1) n ON n.cipher_suite = x.code""",
    "certificate_chains": c.facts_with() + f"""
SELECT capture_id, session_id, present, n_certs, absent_kind, hostname, expired, not_yet_valid,
  CASE WHEN present THEN days_to_expiry END AS days_to_expiry, self_signed, hostname_match, chain_links_ok, trusted,
  CASE WHEN NOT present THEN NULL WHEN self_signed THEN 'self-signed leaf certificate' WHEN trusted THEN 'chains to a trusted root' ELSE {c.TRUST_DETAIL} END AS trust_detail
FROM chains""",
}
