"""Reference SQL of the packet list and the dialogue queries."""

from __future__ import annotations

from mailveil import dims
from mailveil.plans.views import with_clause
from oracles import baseline, common
from oracles.flows import FLOWS, KEY

SECRET = r"'(?i)^(\s*(?:PASS|APOP|AUTH|LOGIN|USER)\b|\s*[A-Za-z0-9._-]+\s+(?:LOGIN|AUTHENTICATE)\b)\s*((?:PLAIN|LOGIN|CRAM-MD5|DIGEST-MD5|XOAUTH2|EXTERNAL|SCRAM-[A-Z0-9-]+)\b)?'"


def safe(line: str) -> str:
    return (f"CASE WHEN length(trim({line}, ' ')) >= 12 AND regexp_full_match(trim({line}, ' '), '[A-Za-z0-9+/]+={{0,2}}') THEN '[redacted SASL token]' "
            f"WHEN regexp_extract({line}, {SECRET}, 1) <> '' THEN concat(regexp_extract({line}, {SECRET}, 1), "
            f"CASE WHEN regexp_extract({line}, {SECRET}, 2) <> '' THEN concat(' ', regexp_extract({line}, {SECRET}, 2)) ELSE '' END, ' [redacted]') ELSE {line} END")


TEXTS = FLOWS + f""",
texts AS (SELECT {KEY}, dir, string_agg(concat(repeat(chr(0), cast(gap AS int)), substr(payload, cast(start - off + 1 AS int))), '' ORDER BY off) AS t FROM kinds WHERE NOT covered GROUP BY ALL),
tls AS (SELECT {KEY}, dir, CASE WHEN position(concat(chr(22), chr(3)) IN t) > 0 THEN position(concat(chr(22), chr(3)) IN t) - 1 END AS tls_off FROM texts)"""

MSG = "CASE unicode(substr(payload, 6, 1)) " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in dims.HANDSHAKE_NAMES.items() if k != 15) + " END"
PACKETS = TEXTS + f""",
tag AS (SELECT c.capture_id, c.side_a, c.side_b, c.conv_no, c.frame, c.ts, c.src, c.sport, c.dst, c.dport, c.flags, c.payload, length(c.payload) AS len,
    k.dir, k.start AS so, x.t, m.session_no, CASE WHEN m.session_no IS NOT NULL THEN CASE m.sport WHEN 25 THEN 'SMTP' WHEN 110 THEN 'POP3' ELSE 'IMAP' END END AS protocol,
    m.session_no IS NOT NULL AND coalesce(k.start >= l.tls_off, false) AS after_tls,
    length(c.payload) >= 5 AND unicode(c.payload) BETWEEN 20 AND 23 AND unicode(substr(c.payload, 2, 1)) = 3 AS head,
    row_number() OVER (PARTITION BY c.capture_id ORDER BY c.frame) AS position, false AS truncated
  FROM conv c LEFT JOIN (SELECT * FROM kinds WHERE NOT covered) k USING (capture_id, side_a, side_b, conv_no, frame)
  LEFT JOIN texts x ON x.capture_id = c.capture_id AND x.side_a = c.side_a AND x.side_b = c.side_b AND x.conv_no = c.conv_no AND x.dir = k.dir
  LEFT JOIN tls l ON l.capture_id = c.capture_id AND l.side_a = c.side_a AND l.side_b = c.side_b AND l.conv_no = c.conv_no AND l.dir = k.dir
  LEFT JOIN mail m ON m.capture_id = c.capture_id AND m.side_a = c.side_a AND m.side_b = c.side_b AND m.conv_no = c.conv_no),
ctx AS (SELECT *, so = 0 OR substr(t, cast(so AS int), 1) = chr(10) AS at_line, substr(t, cast(so + 1 AS int)) AS body, position(chr(10) IN substr(t, cast(so + 1 AS int), cast(len AS int))) AS nl FROM tag),
lined AS (SELECT *, CASE WHEN so IS NULL THEN substr(split_part(payload, concat(chr(13), chr(10)), 1), 1, 90)
    ELSE rtrim(substr(split_part(CASE WHEN at_line THEN body ELSE substr(body, cast(nl + 1 AS int)) END, chr(10), 1), 1, 90), chr(13)) END AS line,
  coalesce(nullif(concat_ws(', ', CASE WHEN flags & 2 <> 0 THEN 'SYN' END, CASE WHEN flags & 16 <> 0 THEN 'ACK' END, CASE WHEN flags & 8 <> 0 THEN 'PSH' END,
    CASE WHEN flags & 1 <> 0 THEN 'FIN' END, CASE WHEN flags & 4 <> 0 THEN 'RST' END, CASE WHEN flags & 32 <> 0 THEN 'URG' END), ''), '-') AS flag_names FROM ctx),
packets AS (SELECT capture_id, position, frame, src, sport, dst, dport, CASE WHEN len = 0 THEN 'TCP' WHEN after_tls OR head THEN 'TLS' ELSE coalesce(protocol, 'TCP') END AS proto,
  coalesce(protocol, '—') AS service, flag_names AS flags, len, CASE WHEN session_no IS NOT NULL THEN concat('S', lpad(cast(session_no AS varchar), cast(greatest(3, length(cast(session_no AS varchar))) AS int), '0')) END AS session_id,
  CASE WHEN len = 0 THEN flag_names WHEN after_tls AND NOT head THEN concat('TLS record data, continued (', len, ' bytes)')
    WHEN head THEN CASE WHEN unicode(payload) = 22 AND {MSG} IS NOT NULL THEN concat('TLS Handshake: ', {MSG}) ELSE concat('TLS Handshake (', len, ' bytes)') END
    WHEN so IS NOT NULL AND NOT at_line AND nl = 0 THEN concat('… continues the previous line (', len, ' bytes)')
    WHEN regexp_full_match(line, '[\\x20-\\x7e\\t]+') THEN concat(CASE WHEN so IS NULL OR at_line THEN '' ELSE '… ' END, {safe('line')}) ELSE concat(len, ' bytes of data') END AS info, truncated FROM lined)"""

LINES = """WITH pieces AS (SELECT doc_id AS stream_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no FROM documents WHERE text <> ''),
offs AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY stream_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS off,
  line_no < max(line_no) OVER (PARTITION BY stream_id) AS complete FROM pieces),
lines AS (SELECT stream_id, line_no, off, rtrim(line, chr(13)) AS line, complete FROM offs WHERE complete OR line <> '')"""
VERBS = "['PASS ', 'AUTH PLAIN ', 'a1 LOGIN ', 'auth scram-sha-256 ', 'EHLO ', '  user ', 'x.9 authenticate login ', '']"
HEADS = with_clause(["v_heads"])
_SEP = r"(?:[\s:]|$)"
_VERB = {
    "SMTP": r"(?im)^\s*(EHLO|HELO|MAIL\s+FROM|RCPT\s+TO|STARTTLS|DATA|BDAT|QUIT|RSET|NOOP|VRFY)" + _SEP,
    "IMAP": r"(?im)^\s*[A-Za-z0-9._-]{1,32}\s+(CAPABILITY|LOGIN|AUTHENTICATE|STARTTLS|SELECT|EXAMINE|LIST|LOGOUT|NOOP|ID|FETCH|UID)" + _SEP,
    "POP3": r"(?im)^\s*(USER|PASS|APOP|STLS|CAPA|RETR|LIST|UIDL|STAT|QUIT|DELE|TOP)" + _SEP,
}
_CLIENT = " ".join(f"WHEN len(list_distinct(list_transform(regexp_extract_all(client_head, '{p}', 1), lambda v: upper(regexp_replace(v, '\\s+', ' ', 'g'))))) >= 2 THEN '{n}'" for n, p in _VERB.items())


def _mangled(target: str) -> str:
    return (f"(up <> '{target}' AND length(up) = {len(target)} AND (regexp_matches(up, '^(X+|A+)$') OR hamming(CASE WHEN length(up) = {len(target)} THEN up ELSE '{target}' END, '{target}') <= {max(1, len(target) // 4)} OR contains(up, 'XXX')))")


SQL = {
    "packet_list": PACKETS + " SELECT capture_id, position, frame, src, sport, dst, dport, proto, service, flags, len, session_id, info, truncated FROM packets",
    "packet_filter_counts": PACKETS + """ SELECT capture_id, count(*) AS all_rows, count(*) FILTER (WHERE len > 0) AS with_payload, count(*) FILTER (WHERE proto = 'TLS') AS tls,
  count(*) FILTER (WHERE len > 0 AND proto <> 'TLS' AND info NOT LIKE '%bytes of data') AS cleartext, count(*) FILTER (WHERE proto IN ('SMTP', 'IMAP', 'POP3')) AS mail FROM packets GROUP BY ALL""",
    "packet_times": with_clause(["v_segments"]) + """, rows AS (SELECT capture_id, frame, ts::double AS ts FROM v_segments WHERE ts % 172800 = 0
  UNION ALL SELECT concat(capture_id, '/', ts // 864000), frame, (ts // 864000) * 864000 + (frame % 40000) / 2 FROM v_segments WHERE ts % 172800 <> 0),
b AS (SELECT *, ts - min(ts) OVER (PARTITION BY capture_id) AS dt, max(ts) OVER (PARTITION BY capture_id) - min(ts) OVER (PARTITION BY capture_id) > 86400 AS absolute FROM rows)
SELECT capture_id, frame, CASE WHEN absolute THEN concat(strftime(make_timestamp(cast(floor(ts) AS bigint) * 1000000), '%H:%M:%S'), '.000') WHEN dt < 600 THEN printf('%.3f', dt)
  WHEN dt >= 3600 THEN concat(cast(floor(dt / 3600) AS bigint), ':', printf('%02d', cast(floor((dt % 3600) / 60) AS bigint)), ':', lpad(printf('%.1f', dt % 60), 4, '0'))
  ELSE concat(printf('%02d', cast(floor(dt / 60) AS bigint)), ':', lpad(printf('%.1f', dt % 60), 4, '0')) END AS time_text FROM b""",
    "dialogue_lines": LINES + " SELECT stream_id, line_no, off, md5(line) AS line_hash, complete FROM lines",
    "dialogue_reply_groups": LINES + """, wire AS (SELECT stream_id, line_no, off, concat(200 + 50 * (line_no % 3), CASE WHEN line_no % 4 <> 3 THEN '-' ELSE ' ' END, line) AS w FROM lines),
g AS (SELECT *, coalesce(sum((substr(w, 4, 1) <> '-')::int) OVER (PARTITION BY stream_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS reply_no FROM wire)
SELECT stream_id, reply_no, arg_min(cast(substr(w, 1, 3) AS int), line_no) AS code, count(*) AS lines, md5(arg_min(substr(w, 5), line_no)) AS reply_hash, min(off) AS off FROM g GROUP BY ALL""",
    "dialogue_turn_pairs": with_clause(["v_dialogue"]) + """, n AS (SELECT *, row_number() OVER (PARTITION BY session_id, dir ORDER BY ordinal, text) AS turn FROM v_dialogue)
SELECT c.session_id, c.turn, md5(c.text) AS command, md5(s.text) AS reply FROM n c LEFT JOIN n s ON s.session_id = c.session_id AND s.turn = c.turn AND s.dir = 'S' WHERE c.dir = 'C'""",
    "dialogue_transcript": LINES + f""", e AS (SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY line_no) AS pos, CASE WHEN line_no % 2 = 0 THEN 'C' ELSE 'S' END AS dir,
  ['cmd', 'reply', 'auth', 'banner', 'caps'][line_no % 5 + 1] AS kind, CASE WHEN line_no % 10 = 2 THEN concat('AUTH PLAIN ', line) ELSE line END AS raw FROM lines)
SELECT stream_id, pos, dir, kind, substr(CASE WHEN kind IN ('auth', 'cmd') THEN {safe('raw')} ELSE raw END, 1, 220) AS text FROM e WHERE pos <= 80""",
    "redacted_lines": LINES + f""", r AS (SELECT stream_id, line_no, CASE WHEN line_no % 16 = 15 THEN to_base64(encode(md5(line))) ELSE concat({VERBS}[line_no % 8 + 1], line) END AS raw FROM lines)
SELECT stream_id, line_no, md5({safe('raw')}) AS shown_hash FROM r""",
    "protocol_identification": HEADS + f""", c AS (SELECT *, (unicode(client_head) = 22 OR unicode(server_head) = 22) AS imp, CASE {_CLIENT} END AS by_client,
  CASE WHEN regexp_matches(server_head, '^(220|421|554)[ -]') THEN 'SMTP' WHEN regexp_matches(server_head, '^\\* (OK|PREAUTH|BYE)') THEN 'IMAP' WHEN regexp_matches(server_head, '^(\\+OK|-ERR)') THEN 'POP3'
    WHEN regexp_matches(server_head, '^(220|250|421|554)\\r?\\n') THEN 'SMTP' END AS by_banner FROM v_heads)
SELECT session_id, CASE WHEN imp THEN CASE server_port WHEN 465 THEN 'SMTP' WHEN 993 THEN 'IMAP' WHEN 995 THEN 'POP3' ELSE 'UNKNOWN' END ELSE coalesce(by_banner, by_client, 'UNKNOWN') END AS protocol,
  CASE WHEN imp THEN 'implicit' WHEN coalesce(by_banner, by_client) IS NULL THEN 'unknown' ELSE 'plaintext' END AS mode,
  CASE WHEN imp OR by_banner IS NOT NULL THEN 'banner' ELSE 'client-verbs' END AS identified_by,
  CASE o_mod WHEN 0 THEN regexp_extract(server_head, 'mx[0-9]+\\.example\\.org') WHEN 1 THEN 'mx.example.net' END AS server_name
FROM (SELECT *, CASE WHEN server_head LIKE '220 mx%' THEN 0 WHEN server_head LIKE '* OK%' THEN 1 END AS o_mod FROM c)""",
    "mangled_capabilities": HEADS + f""", u AS (SELECT session_id, upper(token) AS up, ['SMTP', 'IMAP', 'POP3'][session_id % 3 + 1] AS protocol FROM v_heads)
SELECT session_id, concat(up, ' SIZE') AS caps, up = CASE WHEN protocol = 'POP3' THEN 'STLS' ELSE 'STARTTLS' END AS offered,
  CASE WHEN protocol = 'POP3' THEN CASE WHEN {_mangled('STLS')} THEN concat('POP3 capability ''', up, ''' looks like an overwritten STLS') ELSE '' END
    ELSE CASE WHEN {_mangled('STARTTLS')} THEN concat(CASE WHEN protocol = 'SMTP' THEN 'EHLO' ELSE 'IMAP' END, ' capability ''', up, ''' looks like an overwritten STARTTLS') ELSE '' END END AS indicators FROM u""",
    "sasl_events": HEADS + """, j AS (SELECT h.session_id, h.mechanism, o.o_custkey AS c FROM v_heads h JOIN orders o ON o.o_orderkey = h.session_id)
SELECT session_id, upper(mechanism) AS mechanism, CASE session_id % 8 WHEN 0 THEN concat('u', c) WHEN 1 THEN concat('user', c) WHEN 2 THEN concat('u', c) WHEN 3 THEN concat('u', c) WHEN 4 THEN concat('u', c)
  WHEN 6 THEN concat('user', c) END AS username, session_id % 8 IN (0, 1, 3) AS secret_exposed, session_id % 2 = 0 AS accepted FROM j""",
    "upgrade_refusals": with_clause(["v_sessions"]) + """, a AS (SELECT *, CASE WHEN session_id % 7 <> 6 THEN ['2.0.0 ready', 'a1 OK begin', '+OK begin', '4.7.0 not now', 'a1 NO refused', '-ERR off'][session_id % 6 + 1] END AS answer,
  CASE WHEN session_id % 6 = 0 THEN 220 ELSE 454 END AS code FROM v_sessions)
SELECT session_id, CASE WHEN starttls_requested AND answer IS NOT NULL AND NOT CASE protocol WHEN 'SMTP' THEN code = 220 WHEN 'IMAP' THEN upper(split_part(answer, ' ', 2)) = 'OK' ELSE answer LIKE '+OK%' END
  THEN concat(CASE WHEN protocol = 'POP3' THEN 'STLS' ELSE 'STARTTLS' END, ' refused with ''', CASE WHEN protocol = 'SMTP' THEN concat(code, ' ') ELSE '' END, answer, '''') END AS indicator FROM a""",
    "upgrade_points": TEXTS + f""", st AS (SELECT {KEY}, dir, min(len - (start - off)) AS so FROM kinds WHERE NOT covered GROUP BY ALL),
pt AS (SELECT *, position(concat(chr(22), chr(3)) IN substr(t, cast(so + 1 AS int))) AS p FROM texts JOIN st USING (capture_id, side_a, side_b, conv_no, dir)),
cl AS (SELECT *, CASE WHEN p > 1 THEN substr(t, cast(so + 1 AS int), cast(p - 1 AS int)) ELSE '' END AS c FROM pt),
vb AS (SELECT *, array_to_string(list_transform(list_filter(list_transform(string_split(c, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), lambda x: upper(split_part(x, ' ', 1)))[1:5], ', ') AS verbs FROM cl)
SELECT {KEY}, dir, CASE WHEN p > 0 THEN so + p - 1 END AS tls_off, CASE WHEN c <> '' THEN md5(CASE WHEN dir = 'C' THEN concat('client sent ', length(c), ' bytes of cleartext after STARTTLS and before TLS (commands: ', CASE WHEN verbs = '' THEN 'binary' ELSE verbs END, ')')
  ELSE concat('server sent ', length(c), ' bytes of cleartext after accepting STARTTLS and before TLS (answers: ', CASE WHEN verbs = '' THEN 'binary' ELSE verbs END, ')') END) END AS injection_hash FROM vb""",
    "session_classes": common.facts_with(common.FINDINGS, baseline.OBSERVE, baseline.deviations()) + """, k AS (SELECT f.*, (SELECT count(*) FROM deviations d WHERE d.capture_id = f.capture_id AND d.session_id = f.session_id AND d.code = 'cert_change') AS cc,
  (SELECT count(*) FROM deviations d WHERE d.capture_id = f.capture_id AND d.session_id = f.session_id AND d.code = 'downgrade') AS dg FROM facts f),
l AS (SELECT capture_id, session_id, CASE WHEN strip_text <> '' THEN 'STARTTLS stripped' WHEN inject_text <> '' THEN 'Command injection' WHEN cc > 0 THEN 'Certificate swapped' WHEN dg > 0 THEN 'Downgraded'
  WHEN coalesce(server_hello_seen, false) THEN version_name ELSE 'Cleartext' END AS label FROM k)
SELECT *, CASE WHEN label IN ('STARTTLS stripped', 'Command injection', 'Certificate swapped', 'Downgraded') THEN 'bad' WHEN label = 'Cleartext' THEN 'clear' ELSE 'tls' END AS kind FROM l""",
}
