"""Reference SQL of the SMTP dialogue: what each stand-in session was written to mean."""

from __future__ import annotations

# (variant, line_no, kind, verb, reply_no, code) after the greeting line
ROWS = [
    (0, 1, "command", "MAIL", 2, 250), (0, 2, "command", "RCPT", 3, 250), (0, 3, "command", "DATA", 4, 354), (0, 4, "body", None, None, None),
    (0, 5, "body", None, None, None), (0, 6, "body", None, None, None), (0, 7, "body", None, None, None), (0, 8, "body-end", None, 5, 250), (0, 9, "command", "QUIT", 6, 221),
    (1, 1, "command", "DATA", 2, 503), (1, 2, "command", "RSET", 3, 250), (1, 3, "command", "DATA", 4, 354), (1, 4, "body", None, None, None), (1, 5, "body-end", None, 5, 250), (1, 6, "command", "QUIT", 6, 221),
    (2, 1, "command", "AUTH", 2, 334), (2, 2, "auth-response", None, 3, 334), (2, 3, "auth-response", None, 4, 235), (2, 4, "command", "QUIT", 5, 221),
    (3, 1, "command", "AUTH", 2, 535), (3, 2, "command", "NOOP", 3, 250), (3, 3, "command", "QUIT", 4, 221),
    (4, 1, "command", "STARTTLS", 2, 454), (4, 2, "command", "MAIL", 3, 250), (4, 3, "command", "QUIT", 4, 221),
]


def _row(r) -> str:
    return "(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")"


SQL = {
    "smtp_events": f"""SELECT o_orderkey AS session_id, line_no, kind, verb, reply_no, code FROM orders JOIN (VALUES {', '.join(map(_row, ROWS))}) AS t(variant, line_no, kind, verb, reply_no, code) ON o_orderkey % 5 = variant
UNION ALL SELECT o_orderkey, 0, 'command', CASE WHEN o_orderkey % 7 = 0 THEN 'HELO' ELSE 'EHLO' END, 1, 250 FROM orders""",
    "smtp_sessions": """SELECT o_orderkey AS session_id, [5, 5, 3, 4, 4][o_orderkey % 5 + 1] AS commands, CASE WHEN o_orderkey % 7 = 0 THEN 'HELO' ELSE 'EHLO' END AS greeting_verb,
  CASE WHEN o_orderkey % 7 <> 0 THEN CASE WHEN o_orderkey % 5 = 4 THEN 'SIZE XXXXXXXX' ELSE 'SIZE STARTTLS' END END AS capabilities, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 5 <> 4 END AS starttls_offered,
  o_orderkey % 5 = 4 AS starttls_requested, false AS starttls_accepted,
  CASE o_orderkey % 5 WHEN 0 THEN 12 + 2 + 6 + 7 + length(cast(o_custkey AS varchar)) + 3 WHEN 1 THEN 10 ELSE 0 END AS message_bytes,
  CASE WHEN o_orderkey % 5 = 4 THEN concat(CASE WHEN o_orderkey % 7 <> 0 THEN 'EHLO capability ''XXXXXXXX'' looks like an overwritten STARTTLS | ' ELSE '' END, 'STARTTLS refused with ''454 later''') ELSE '' END AS strip_indicators FROM orders""",
    "smtp_auth_events": """SELECT o_orderkey AS session_id, CASE o_orderkey % 5 WHEN 2 THEN 'LOGIN' ELSE 'PLAIN' END AS mechanism, concat(CASE o_orderkey % 5 WHEN 2 THEN 'user' ELSE 'u' END, o_custkey) AS username,
  true AS secret_exposed, o_orderkey % 5 = 2 AS accepted FROM orders WHERE o_orderkey % 5 IN (2, 3)""",
    "imap_commands": """SELECT o_orderkey AS session_id, 0 AS line_no, 'a1' AS tag, 'CAPABILITY' AS verb, 'OK' AS status, 'a1 OK done' AS answer FROM orders
UNION ALL SELECT o_orderkey, 1, 'a2', ['LOGIN', 'STARTTLS', 'NOOP'][o_orderkey % 3 + 1], CASE WHEN o_orderkey % 2 = 0 THEN 'OK' ELSE 'NO' END, CASE WHEN o_orderkey % 2 = 0 THEN 'a2 OK first' ELSE 'a2 NO first' END FROM orders
UNION ALL SELECT o_orderkey, 3, 'a2', 'LOGOUT', CASE WHEN o_orderkey % 5 <> 0 THEN 'OK' END, CASE WHEN o_orderkey % 5 <> 0 THEN 'a2 OK out' END FROM orders""",
    "imap_capabilities": """SELECT o_orderkey AS session_id, 0 AS line_no, 'IMAP4REV1 STARTTLS' AS capabilities FROM orders
UNION ALL SELECT o_orderkey, 1, CASE WHEN o_orderkey % 4 = 0 THEN 'IMAP4REV1 XXXXXXXX' ELSE 'IMAP4REV1 STARTTLS' END FROM orders""",
    "imap_login_events": """SELECT o_orderkey AS session_id, 1 AS line_no, 'IMAP-LOGIN' AS mechanism, concat('u', o_custkey) AS username, true AS secret_exposed, o_orderkey % 2 = 0 AS accepted FROM orders WHERE o_orderkey % 3 = 0""",
}
