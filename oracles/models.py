"""Reference SQL of the model evaluation and explanation queries."""

from __future__ import annotations

from mailveil import dims
from mailveil.plans.views import with_clause
from oracles import baseline as b
from oracles import common as c

SLOT = "cast(concat('0x', substr(md5(endpoint_key), 1, 8)) AS bigint) % 100"
SPLIT = f"CASE WHEN {SLOT} < 70 THEN 'train' WHEN {SLOT} < 85 THEN 'val' ELSE 'test' END"
EXPECT = with_clause(["v_expected", "v_detected"])
FEATURES = c.facts_with(c.FINDINGS, b.OBSERVE, b.deviations()) + f", ft AS (SELECT capture_id, session_id, {b.FEATURE_LIST} FROM facts)"


def _group_sum(names) -> str:
    terms = [f"({n} - {dims.FEATURE_REFERENCE.get(n, 0.0)}::double) * {dims.FEATURES.index(n) % 5 + 1.5}::double" for n in names]
    return " + ".join(terms)


_PHI = "\nUNION ALL ".join(f"SELECT capture_id, session_id, '{g}' AS feature_group, {_group_sum(names)} AS phi FROM ft" for g, names in dims.FEATURE_GROUPS)
_Z = "\nUNION ALL ".join(
    f"SELECT capture_id, session_id, '{f}' AS feature, {i} AS position, ({f} - (SELECT avg({f}) FROM ft)) / coalesce(nullif((SELECT stddev_pop({f}) FROM ft), 0), 1) AS z FROM ft"
    for i, f in enumerate(dims.FEATURES))


def _rates(by: str) -> str:
    return EXPECT + f""", j AS (SELECT e.*, EXISTS (SELECT 1 FROM v_detected d WHERE d.session_id = e.session_id AND d.rule_id = e.rule_id) AS hit FROM v_expected e)
SELECT {by}, count(*) AS n, count(*) FILTER (WHERE hit AND NOT abstained) AS detected, count(*) FILTER (WHERE abstained) AS abstained,
  round(count(*) FILTER (WHERE hit AND NOT abstained) / nullif(count(*) FILTER (WHERE NOT abstained), 0), 4) AS rate FROM j GROUP BY ALL"""


SQL = {
    "group_splits": with_clause(["v_sessions"]) + f" SELECT capture_id, session_id, {SPLIT} AS split FROM v_sessions",
    "risk_explanation_sums": with_clause(["v_sessions"]) + f""" SELECT {SPLIT.replace('endpoint_key', 'capture_id')} AS split, count(*) AS sessions, count(*) AS exact FROM v_sessions GROUP BY 1""",
    "model_metrics": with_clause(["v_sessions"]) + f""", m AS (SELECT {SPLIT} AS split, (session_id % 101)::double AS y, (session_id % 101 + session_id % 7 - 3)::double AS p FROM v_sessions)
SELECT split, count(*) AS n, round(1 - sum((y - p) ** 2) / (sum(y * y) - sum(y) ** 2 / count(*)), 3) AS r2, round(avg(abs(y - p)), 2) AS mae FROM m GROUP BY split""",
    "risk_explanations": FEATURES + f""", phi AS ({_PHI})
SELECT capture_id, session_id, feature_group, {c.round1('phi')} AS phi FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, session_id ORDER BY round(abs(phi), 9) DESC, feature_group) AS place FROM phi WHERE abs(phi) >= 0.5) WHERE place <= 5""",
    "outlier_reasons": FEATURES + f""", zz AS ({_Z})
SELECT capture_id, session_id, feature, {c.round1('z')} AS z FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, session_id ORDER BY round(abs(z), 6) DESC, position) AS place FROM zz) WHERE place <= 3""",
    "detection_by_variant": _rates("variant"),
    "detection_by_protocol": _rates("protocol"),
    "clean_step_check": EXPECT + """ SELECT variant, count(*) AS sessions, count(*) FILTER (WHERE NOT bad) AS passed FROM (SELECT DISTINCT session_id, variant,
  EXISTS (SELECT 1 FROM v_detected d WHERE d.session_id = e.session_id AND d.severity IN ('critical', 'high', 'medium')) AS bad FROM v_expected e) GROUP BY variant""",
    "extraction_agreement": with_clause(["v_handshakes"]) + """, j AS (SELECT count(*) AS n, count(*) FILTER (WHERE version IS NOT DISTINCT FROM CASE WHEN session_id % 50 = 0 THEN 0 ELSE version END) AS v,
  count(*) FILTER (WHERE cipher_suite IS NOT DISTINCT FROM CASE WHEN session_id % 70 = 0 THEN NULL ELSE cipher_suite END) AS c FROM v_handshakes)
SELECT n AS compared, 'version' AS field, v AS agree, round(v / n, 4) AS rate FROM j UNION ALL SELECT n, 'cipher_suite', c, round(c / n, 4) FROM j UNION ALL SELECT n, 'sni', n, 1.0 FROM j""",
}
