"""Mail conversations as TCP segments, one for every order: thirteen kinds of dialogue, of a length that depends on the order.

A dialogue is written as text with two marks: `<fill>` stands for the kind's filler, repeated by the order's key, and `<size>` for
the bytes which that takes. `EXPECTED` states, by kind, what a session of it means; the reference SQL is made of these rows.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

from mailveil.plans import views

SEGMENT = 40
FILLS = 7


def b64(text: str) -> str:
    return base64.b64encode(text.encode()).decode()


def crlf(*lines: str) -> str:
    return "".join(f"{line}\r\n" for line in lines)


def record(kind: int, body: bytes) -> str:
    return (bytes([kind, 3, 3]) + len(body).to_bytes(2, "big") + body).decode("latin-1")


def message(kind: int, body: bytes) -> bytes:
    return bytes([kind]) + len(body).to_bytes(3, "big") + body


def hello_c() -> str:
    name = b"mx.example.org"
    sni = b"\x00\x00" + (len(name) + 5).to_bytes(2, "big") + (len(name) + 3).to_bytes(2, "big") + b"\x00" + len(name).to_bytes(2, "big") + name
    exts = sni + b"\x00\x10\x00\x07\x00\x05\x04smtp" + b"\x00\x0d\x00\x04\x00\x02\x04\x03"
    return record(22, message(1, b"\x03\x03" + b"c" * 32 + b"\x00" + b"\x00\x04\xc0\x2f\x00\x0a" + b"\x01\x00" + len(exts).to_bytes(2, "big") + exts))


def hello_s() -> str:
    exts = b"\xff\x01\x00\x01\x00\x00\x17\x00\x00"
    hello = message(2, b"\x03\x03" + b"s" * 32 + b"\x00" + b"\xc0\x2f" + b"\x00" + len(exts).to_bytes(2, "big") + exts)
    certificate = message(11, b"\x00\x00\x0d" + b"\x00\x00\x04" + b"leaf" + b"\x00\x00\x03" + b"top")
    whole = hello + certificate  # split over two records, in the middle of a message
    return record(22, whole[:50]) + record(22, whole[50:])


def sealed(n: int) -> str:
    return record(20, b"\x01") + "".join(record(23, b"xx") for _ in range(n))


@dataclass(frozen=True)
class Kind:
    """A dialogue; `meant` are the columns of its session row, SQL where n (fills) matters."""

    port: int
    client: str
    server: str
    fill: str = ""
    meant: dict | None = None


def _meant(protocol: str, **more) -> dict:
    base = {"protocol": protocol, "mode": "plaintext", "identified_by": "banner", "one_sided": False, "server_name": None, "greeting_verb": None, "capabilities": "", "starttls_offered": None,
            "starttls_requested": False, "starttls_response": None, "tls_client_offset": None, "tls_server_offset": None, "message_bytes": "0", "commands": "", "auth": "", "strip": "", "inject": ""}
    return base | more


EHLO = crlf("220 mx.example.org ready", "250-mx.example.org", "250-SIZE 9", "250 STARTTLS")
EHLO_CAPS = {"server_name": "mx.example.org", "greeting_verb": "EHLO", "capabilities": "SIZE STARTTLS", "starttls_offered": True}

KINDS = [
    Kind(25, crlf("EHLO c", "MAIL FROM:<a>", "RCPT TO:<b>", "DATA", "Subject: x", "") + "<fill>" + crlf(".", "QUIT"), EHLO + crlf("250 ok", "250 ok", "354 go", "250 queued", "221 bye"), "DATA of a message\r\n",
         _meant("SMTP", **EHLO_CAPS, message_bytes="17 + 19 * n", commands="EHLO MAIL RCPT DATA QUIT")),
    Kind(587, crlf("EHLO c", "STARTTLS") + hello_c() + sealed(3), EHLO + crlf("220 go") + hello_s() + sealed(2), "",
         _meant("SMTP", **EHLO_CAPS, mode="starttls", starttls_requested=True, starttls_response="220 go", tls_client_offset=18, tls_server_offset=80, commands="EHLO STARTTLS")),
    Kind(8025, crlf("EHLO c", "DATA") + "<fill>" + crlf("DATA", "body", ".", "AUTH LOGIN", b64("ann"), b64("pw"), "QUIT"),
         crlf("220 mx.example.org ready", "250-mx", "250 HELP", "503 no") + "<fill>" + crlf("354 go", "250 queued", "334 VXNlcm5hbWU6", "334 UGFzc3dvcmQ6", "235 in", "221 bye"), "250 DATA 5\r\n",
         _meant("SMTP", server_name="mx.example.org", greeting_verb="EHLO", capabilities="HELP", starttls_offered=False, message_bytes="9", commands="EHLO DATA<250>DATA AUTH QUIT", auth="LOGIN ann true true")),
    Kind(25, crlf("EHLO c", "BDAT <size>") + "<fill>" + crlf("BDAT 3 LAST") + "\nxy" + crlf("AUTH PLAIN " + b64("\0bob\0pw"), "QUIT"), crlf("220 mx.example.org ready", "250-mx.example.org", "250-SIZE 9", "250 XXXXXXXX", "250 ok", "250 ok", "535 no", "221 bye"), "QUIT\r\n..",
         _meant("SMTP", **EHLO_CAPS | {"capabilities": "SIZE XXXXXXXX", "starttls_offered": False}, message_bytes="8 * n + 3", commands="EHLO BDAT BDAT AUTH QUIT", auth="PLAIN bob true false",
                strip="EHLO capability 'XXXXXXXX' looks like an overwritten STARTTLS")),
    Kind(587, crlf("EHLO c", "STARTTLS") + "<fill>" + hello_c(), EHLO + crlf("220 go") + hello_s(), "RSET\r\n",
         _meant("SMTP", **EHLO_CAPS, mode="starttls", starttls_requested=True, starttls_response="220 go", tls_client_offset="18 + 6 * n", tls_server_offset=80, commands="EHLO STARTTLS",
                inject="CASE WHEN n > 0 THEN concat('client sent ', 6 * n, ' bytes of cleartext after STARTTLS and before TLS (commands: ', substr(repeat(', RSET', least(n, 5)), 3), ')') ELSE '' END")),
    Kind(143, crlf("a1 CAPABILITY", "a2 LOGIN {3}") + "cid" + crlf(' "p w"', "a3 APPEND box {<size>}") + "<fill>" + crlf("", "a4 FETCH 1 BODY[]", "a5 LOGOUT"),
         crlf("* OK [ALERT] mx.example.org ready", "* CAPABILITY IMAP4rev1 STARTTLZ", "a1 OK", "+ go", "a2 OK in", "+ go", "a3 OK", "* 1 FETCH (BODY[] {<size>}") + "<fill>" + crlf(")", "a4 OK done", "* BYE", "a5 OK"), "a4 OK in the middle of a message\r\nthat is read as bytes, not lines\r\n"[:64],
         _meant("IMAP", server_name="mx.example.org", capabilities="IMAP4REV1 STARTTLZ", starttls_offered=False, message_bytes="64 * n + CASE WHEN n > 3 THEN 64 * n ELSE 0 END", commands="CAPABILITY LOGIN APPEND FETCH LOGOUT",
                auth="IMAP-LOGIN cid true true", strip="IMAP capability 'STARTTLZ' looks like an overwritten STARTTLS")),
    Kind(143, crlf("a1 STARTTLS", "a2 AUTHENTICATE PLAIN", b64("\0dan\0pw")) + "<fill>" + crlf("a9 LOGOUT"), crlf("* OK ready", "a1 NO later", "+ ", "a2 OK in", "* BYE", "a9 OK bye"), "x NOOP\r\n",
         _meant("IMAP", starttls_requested=True, starttls_response="a1 NO later", commands="STARTTLS AUTHENTICATE<NOOP> LOGOUT", auth="PLAIN dan true true", strip="STARTTLS refused with 'a1 NO later'")),
    Kind(110, crlf("CAPA", "USER eve", "PASS pw", "RETR 1", "QUIT"), crlf("+OK mx.example.org ready", "+OK list", "TOP", "STLS", ".", "+OK", "+OK in", "+OK message") + "<fill>" + crlf("..", ".", "+OK bye"), "+OK of a message\r\n",
         _meant("POP3", server_name="mx.example.org", capabilities="TOP STLS", starttls_offered=True, message_bytes="18 * n + 7", commands="CAPA USER PASS RETR QUIT", auth="USER/PASS eve true true")),
    Kind(110, crlf("CAPA", "STLS") + hello_c() + sealed(1), crlf("+OK ready", "+OK list", "STLS", ".", "+OK go") + hello_s() + sealed(1), "",
         _meant("POP3", mode="starttls", capabilities="STLS", starttls_offered=True, starttls_requested=True, starttls_response="+OK go", tls_client_offset=12, tls_server_offset=38, commands="CAPA STLS")),
    Kind(993, hello_c() + sealed(2), hello_s() + sealed(2), "", _meant("IMAP", mode="implicit", tls_client_offset=0, tls_server_offset=0)),
    Kind(2525, crlf("EHLO c", "MAIL FROM:<a>", "RCPT TO:<b>", "DATA", "x") + "<fill>" + "cut", "", "body line\r\n",
         _meant("SMTP", identified_by="client-verbs", one_sided=True, greeting_verb="EHLO", message_bytes="6 + 11 * n", commands="EHLO MAIL RCPT DATA")),
    Kind(8080, crlf("GET / HTTP/1.1", "") + "<fill>", crlf("HTTP/1.1 200 OK", ""), "line\r\n"),
    Kind(25, crlf("hello") + "<fill>", crlf("world"), "line\r\n"),
]


#: What the rules say of each kind: (kind, rule, severity, from how many fills on).
FINDINGS = [(0, "DATA-001", "high", 0), (0, "PLAIN-002", "medium", 0), (2, "CRED-001", "critical", 0), (2, "DATA-001", "high", 0), (2, "PLAIN-001", "high", 0), (2, "PORT-001", "low", 0),
            (3, "CRED-001", "critical", 0), (3, "DATA-001", "high", 0), (3, "STRIP-001", "critical", 0), (4, "INJ-001", "critical", 1), (5, "CRED-001", "critical", 0), (5, "DATA-001", "high", 1),
            (5, "STRIP-001", "critical", 0), (6, "CRED-001", "critical", 0), (6, "STRIP-001", "critical", 0), (7, "CRED-001", "critical", 0), (7, "DATA-001", "high", 0), (7, "PLAIN-002", "medium", 0),
            (10, "DATA-001", "high", 0), (10, "PLAIN-003", "medium", 0), (10, "PORT-001", "low", 0)]


def _hex(text: str) -> str:
    return text.encode("latin-1").hex().upper()


def _pieces(side: str, fill: str) -> str:
    """SQL of a dialogue's hex text; n counts the fills."""
    expr = []
    for k, part in enumerate(side.split("<fill>")):
        if k:
            expr.append(f"repeat('{_hex(fill)}', cast(n AS int))")
        for j, text in enumerate(part.split("<size>")):
            if j:
                expr.append(f"hex(cast(n * {len(fill)} AS varchar(20)))")
            if text:
                expr.append(f"'{_hex(text)}'")
    return f"concat({', '.join(expr)})" if len(expr) > 1 else expr[0] if expr else "''"


def _case(values: list[str]) -> str:
    return "CASE kind " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


VIEWS = {"v_mail": f"""
SELECT k, kind, n, capture_id, ts, client_ip, client_port, server_ip, {_case([str(x.port) for x in KINDS])} AS server_port, {_case([_pieces(x.client, x.fill) for x in KINDS])} AS client_hex, {_case([_pieces(x.server, x.fill) for x in KINDS])} AS server_hex
FROM (SELECT o_orderkey AS k, o_orderkey % {len(KINDS)} AS kind, o_custkey % {FILLS} AS n, concat('cap', o_orderkey % 20) AS capture_id, $SEC(o_orderdate) AS ts, concat('10.', cast(floor(o_orderkey / 50000) AS bigint), '.', cast(floor(o_orderkey / 200) AS bigint) % 250, '.', o_orderkey % 200) AS client_ip,
    20000 + o_orderkey % 40000 AS client_port, concat('203.0.113.', o_custkey % 20) AS server_ip FROM orders) AS base
""", "v_mail_segments": f"""
SELECT capture_id, k * 1000 + CASE WHEN step < 0 THEN 2 + step WHEN from_client THEN 2 * step + 4 ELSE 2 * step + 5 END AS frame, ts + CASE WHEN step < 0 THEN 0 ELSE 1 + step END AS ts, CASE WHEN step = -2 THEN 2 WHEN step = -1 THEN 18 ELSE 24 END AS flags, from_client,
  cast((isn + CASE WHEN step < 0 THEN 0 ELSE 1 + spot * {SEGMENT} END) % 4294967296 AS bigint) AS seq, CASE WHEN step < 0 THEN '' ELSE substr(whole, cast(spot * {2 * SEGMENT} + 1 AS int), {2 * SEGMENT}) END AS payload_hex,
  CASE WHEN from_client THEN client_ip ELSE server_ip END AS src, CASE WHEN from_client THEN client_port ELSE server_port END AS sport, CASE WHEN from_client THEN server_ip ELSE client_ip END AS dst, CASE WHEN from_client THEN server_port ELSE client_port END AS dport
FROM (SELECT *, CASE WHEN step >= count THEN step - count ELSE step END AS spot FROM (
    SELECT *, 0 AS count, -2 AS step FROM (SELECT *, true AS from_client, client_hex AS whole, 4294967200 + k % 90 AS isn FROM v_mail) AS c0
    UNION ALL SELECT *, 0 AS count, -1 AS step FROM (SELECT *, false AS from_client, server_hex AS whole, k % 90 AS isn FROM v_mail) AS s0
    UNION ALL SELECT *, $SERIES(cast(count - 1 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS int)) AS step FROM (SELECT *, cast(floor((length(whole) + {2 * SEGMENT - 1}) / {2 * SEGMENT}) AS bigint) AS count FROM (
      SELECT *, true AS from_client, client_hex AS whole, 4294967200 + k % 90 AS isn FROM v_mail UNION ALL SELECT *, false AS from_client, server_hex AS whole, k % 90 AS isn FROM v_mail) AS two) AS counted WHERE count > 0) AS steps) AS placed
"""}
views.VIEWS.update(VIEWS)
