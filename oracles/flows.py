"""Reference SQL of conversations, roles and reassembly, by plain windows."""

from __future__ import annotations

from mailveil.plans.views import with_clause

CONV = with_clause(["v_segments"]) + """,
sides AS (SELECT *, CASE WHEN from_client THEN src ELSE dst END AS cip, CASE WHEN from_client THEN sport ELSE dport END AS cport,
  CASE WHEN from_client THEN dst ELSE src END AS sip, CASE WHEN from_client THEN dport ELSE sport END AS sp,
  flags & 2 <> 0 AND flags & 16 = 0 AS bare, flags & 2 <> 0 AND flags & 16 <> 0 AS synack, flags & 5 <> 0 AS closing FROM v_segments),
counted AS (SELECT *, coalesce(sum(closing::int) OVER (PARTITION BY capture_id, cip, cport, sip, sp ORDER BY ts, frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM sides),
seen AS (SELECT *, last_value(CASE WHEN bare THEN closed END IGNORE NULLS) OVER (PARTITION BY capture_id, cip, cport, sip, sp ORDER BY ts, frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS at_syn FROM counted),
conv AS (SELECT *, concat(cip, ':', cport) AS side_a, concat(sip, ':', sp) AS side_b,
  cast(sum((bare AND closed > coalesce(at_syn, 0))::int) OVER (PARTITION BY capture_id, cip, cport, sip, sp ORDER BY ts, frame) AS bigint) AS conv_no FROM seen)"""

ROLES = CONV + """,
r0 AS (SELECT capture_id, side_a, side_b, conv_no, any_value(sp) AS bport, any_value(cport) AS aport, count(*) FILTER (WHERE bare) AS n_syn, count(*) FILTER (WHERE synack) AS n_sa,
    arg_min(from_client, (ts, frame)) FILTER (WHERE bare) AS syn_from_a, arg_min(from_client, (ts, frame)) FILTER (WHERE synack) AS sa_from_a,
    arg_min(seq, (ts, frame)) FILTER (WHERE bare) AS syn_seq, arg_min(seq, (ts, frame)) FILTER (WHERE synack) AS sa_seq FROM conv GROUP BY ALL),
r1 AS (SELECT *, CASE WHEN n_syn > 0 THEN syn_from_a WHEN n_sa > 0 THEN NOT sa_from_a WHEN bport IN (24, 25, 26, 110, 143, 465, 587, 993, 995, 2525) THEN true ELSE bport < aport END AS a_client FROM r0),
roles AS (SELECT capture_id, side_a, side_b, conv_no, a_client, CASE WHEN a_client THEN side_a ELSE side_b END AS client, CASE WHEN a_client THEN side_b ELSE side_a END AS server,
    CASE WHEN n_syn > 0 THEN 'SYN without ACK' WHEN n_sa > 0 THEN 'sender of SYN/ACK is server' ELSE 'no handshake captured; inferred from ports (low confidence)' END AS role_reason,
    n_syn > 0 AND n_sa > 0 AS handshake_seen, CASE WHEN n_syn > 0 THEN syn_seq END AS c_isn, CASE WHEN n_sa > 0 THEN sa_seq END AS s_isn FROM r1)"""

PLACED = ROLES + """,
dirs AS (SELECT c.*, r.a_client, CASE WHEN c.from_client = r.a_client THEN 'C' ELSE 'S' END AS dir, CASE WHEN c.from_client = r.a_client THEN r.c_isn ELSE r.s_isn END AS isn
  FROM conv c JOIN roles r USING (capture_id, side_a, side_b, conv_no) WHERE payload <> ''),
firsts AS (SELECT *, first_value(seq) OVER (PARTITION BY capture_id, side_a, side_b, conv_no, dir ORDER BY ts, frame) AS f FROM dirs),
rels AS (SELECT *, CASE WHEN (seq - f + 4294967296) % 4294967296 >= 2147483648 THEN (seq - f + 4294967296) % 4294967296 - 4294967296 ELSE (seq - f + 4294967296) % 4294967296 END AS rel FROM firsts),
bases AS (SELECT *, CASE WHEN isn IS NOT NULL THEN (isn + 1) % 4294967296 ELSE (f + min(rel) OVER (PARTITION BY capture_id, side_a, side_b, conv_no, dir) + 4294967296) % 4294967296 END AS base FROM rels),
placed AS (SELECT capture_id, side_a, side_b, conv_no, dir, frame, ts, payload, length(payload) AS len,
  CASE WHEN (seq - base + 4294967296) % 4294967296 >= 2147483648 THEN (seq - base + 4294967296) % 4294967296 - 4294967296 ELSE (seq - base + 4294967296) % 4294967296 END AS off FROM bases)"""

BUILT = PLACED + """,
walked AS (SELECT *, coalesce(max(off + len) OVER (PARTITION BY capture_id, side_a, side_b, conv_no, dir ORDER BY off, -len, ts, frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cursor
  FROM placed WHERE off >= 0),
kinds AS (SELECT *, off + len <= cursor AS covered, greatest(off - cursor, 0) AS gap, CASE WHEN off + len > cursor THEN greatest(cursor - off, 0) ELSE 0 END AS trim,
  greatest(off, cursor) AS start FROM walked),
bodies AS (SELECT capture_id, side_a, side_b, conv_no, dir, string_agg(concat(repeat('00', cast(gap AS int)), hex(substr(payload, cast(start - off + 1 AS int)))), '' ORDER BY off) AS full_hex
  FROM kinds WHERE NOT covered GROUP BY ALL)"""

STATS = BUILT + """,
late AS (SELECT capture_id, side_a, side_b, conv_no, dir, count(*) AS segments, count(*) FILTER (WHERE off < prev) AS out_of_order FROM (
  SELECT *, lag(off) OVER (PARTITION BY capture_id, side_a, side_b, conv_no, dir ORDER BY ts, frame) AS prev FROM placed) GROUP BY ALL),
clash AS (SELECT k.*, CASE WHEN covered THEN hex(payload) <> substr(full_hex, cast(2 * off + 1 AS int), cast(2 * len AS int))
  WHEN trim > 0 THEN hex(substr(payload, 1, cast(trim AS int))) <> substr(full_hex, cast(2 * off + 1 AS int), cast(2 * trim AS int)) ELSE false END AS bad
  FROM kinds k JOIN bodies USING (capture_id, side_a, side_b, conv_no, dir)),
built AS (SELECT capture_id, side_a, side_b, conv_no, dir, count(*) FILTER (WHERE covered) AS retransmissions, count(*) FILTER (WHERE trim > 0) AS overlaps_trimmed,
  count(*) FILTER (WHERE gap > 0) AS gaps, count(*) FILTER (WHERE bad) AS overlap_conflicts, max(off + len) AS bytes FROM clash GROUP BY ALL),
stats AS (SELECT capture_id, side_a, side_b, conv_no, dir, segments, coalesce(retransmissions, 0) AS retransmissions, out_of_order, coalesce(overlaps_trimmed, 0) AS overlaps_trimmed,
  coalesce(overlap_conflicts, 0) AS overlap_conflicts, coalesce(gaps, 0) AS gaps, coalesce(bytes, 0) AS bytes FROM late LEFT JOIN built USING (capture_id, side_a, side_b, conv_no, dir))"""

_SUMS = ", ".join(f"coalesce(sum({c}) FILTER (WHERE dir = '{d}'), 0)::bigint AS {n}_{c}" for d, n in (("C", "client"), ("S", "server"))
                  for c in ("bytes", "gaps", "retransmissions", "overlap_conflicts"))
FLOWS = STATS + f""",
both_dirs AS (SELECT capture_id, side_a, side_b, conv_no, {_SUMS} FROM stats GROUP BY ALL),
flows AS (SELECT *, (SELECT min(frame) FROM conv c WHERE c.capture_id = x.capture_id AND c.side_a = x.side_a AND c.side_b = x.side_b AND c.conv_no = x.conv_no AND c.ts = x.start_ts) AS first_frame,
    cast(split_part(server, ':', 2) AS int) AS sport, cast(split_part(client, ':', 2) AS int) AS cport FROM (
  SELECT t.*, r.client, r.server, b.* EXCLUDE (capture_id, side_a, side_b, conv_no) FROM (SELECT capture_id, side_a, side_b, conv_no, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS frames FROM conv GROUP BY ALL) t
  JOIN roles r USING (capture_id, side_a, side_b, conv_no) JOIN both_dirs b USING (capture_id, side_a, side_b, conv_no) WHERE client_bytes + server_bytes > 0) x),
mail AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY start_ts, first_frame) AS session_no FROM flows WHERE sport IN (25, 110, 143))"""

KEY = "capture_id, side_a, side_b, conv_no"
SQL = {
    "flow_conversations": CONV + f" SELECT {KEY}, frame FROM conv",
    "flow_roles": ROLES + f" SELECT {KEY}, client, server, role_reason, handshake_seen FROM roles",
    "stream_offsets": PLACED + f" SELECT {KEY}, dir, frame, off, len FROM placed",
    "stream_spans": BUILT + f" SELECT {KEY}, dir, start AS span_off, len - (start - off) AS span_len, frame FROM kinds WHERE NOT covered",
    "stream_bytes": BUILT + f""" SELECT {KEY}, dir, chunk, chunk * 64 AS off, substr(full_hex, cast(chunk * 128 + 1 AS int), 128) AS hex_bytes FROM (
  SELECT *, unnest(generate_series(0, (length(full_hex) // 2 - 1) // 64)) AS chunk FROM bodies)""",
    "stream_statistics": STATS + f" SELECT {KEY}, dir, segments, retransmissions, out_of_order, overlaps_trimmed, overlap_conflicts, gaps, bytes FROM stats",
    "flow_records": FLOWS + f""" SELECT {KEY}, client, server, start_ts, end_ts, frames, client_bytes, server_bytes, client_gaps, server_gaps, client_retransmissions, server_retransmissions,
  client_overlap_conflicts, server_overlap_conflicts FROM flows""",
    "frames_for_byte_ranges": BUILT + f""", r(lo, hi) AS (VALUES (0::bigint, 10::bigint), (20, 60), (100, 101), (30, 30))
SELECT {KEY}, dir, lo, hi, string_agg(cast(frame AS varchar), ',' ORDER BY frame) AS frames FROM (SELECT DISTINCT {KEY}, dir, lo, hi, frame FROM kinds, r
  WHERE NOT covered AND hi > lo AND start < hi AND off + len > lo) GROUP BY ALL""",
    "session_numbers": FLOWS + f" SELECT {KEY}, session_no, concat('S', lpad(cast(session_no AS varchar), cast(greatest(3, length(cast(session_no AS varchar))) AS int), '0')) AS session_id FROM mail",
    "unclassified_flows": FLOWS + f""" SELECT capture_id, client, server, client_bytes, server_bytes, frames, 'no known mail protocol on either side' AS reason FROM flows f
  WHERE (sport IN (25, 110, 143) OR cport IN (25, 110, 143)) AND NOT EXISTS (SELECT 1 FROM mail m WHERE m.capture_id = f.capture_id AND m.side_a = f.side_a AND m.side_b = f.side_b AND m.conv_no = f.conv_no)""",
    "flow_totals": FLOWS + """ SELECT capture_id, count(*) AS flows, (SELECT count(*) FROM mail m WHERE m.capture_id = f.capture_id) AS mail_sessions,
  count(*) - (SELECT count(*) FROM mail m WHERE m.capture_id = f.capture_id) AS non_mail_flows FROM flows f GROUP BY capture_id""",
}
