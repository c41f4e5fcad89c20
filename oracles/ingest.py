"""Reference SQL of the capture and frame queries: what the bytes were built from."""

from __future__ import annotations

from mailveil.plans.views import with_clause

CAPS, FRAMES = with_clause(["v_captures"]), with_clause(["v_frames"])
OUTCOME = """CASE WHEN fault = 4 THEN 'non_ip' WHEN fault = 2 AND shape < 4 THEN 'non_ip' WHEN fault = 1 THEN 'fragment' WHEN fault = 0 THEN 'non_tcp'
  WHEN fault = 3 THEN 'truncated' ELSE 'tcp' END"""


def _ip(col: str) -> str:
    part = [f"cast(split_part({col}, '.', {i}) AS bigint)" for i in range(1, 5)]
    return (f"CASE WHEN shape = 7 THEN concat('2001:db8::', lower(hex({part[0]} * 256 + {part[1]})), ':', lower(hex({part[2]} * 256 + {part[3]}))) ELSE {col} END")


SQL = {
    "capture_container_status": CAPS + """ SELECT capture_id, cast(length(content_hex) // 2 AS bigint) AS bytes, CASE WHEN form = 4 THEN NULL WHEN form < 3 THEN 'pcap' WHEN form = 3 THEN 'pcapng' ELSE 'unknown' END AS kind,
  CASE WHEN form = 4 THEN 'zip' ELSE '' END AS compression, CASE form WHEN 4 THEN 'this is a .zip archive, not a capture' WHEN 5 THEN 'the file is empty' WHEN 6 THEN 'not a pcap or pcapng capture (magic 25504446)' END AS error,
  sha256(unhex(content_hex)) AS sha256 FROM v_captures""",
    "capture_frames": CAPS + """ SELECT capture_id, 1 AS frame, ts * 1000000000 + 7000 AS ts_ns, linktype, md5(data_hex) AS data_hash, NULL AS note FROM v_captures WHERE form < 4
  UNION ALL SELECT capture_id, 2, (ts + 1) * 1000000000, linktype, md5(data_hex), NULL FROM v_captures WHERE form = 1
  UNION ALL SELECT capture_id, NULL, NULL, NULL, NULL, 'file ends mid-record header; trailing bytes ignored' FROM v_captures WHERE form = 0""",
    "decoded_segments": FRAMES + f""" SELECT capture_id, frame, {_ip('src')} AS src, {_ip('dst')} AS dst, sport, dport, seq, flags, hex(payload) AS payload_hex FROM v_frames WHERE {OUTCOME} = 'tcp'""",
    "capture_read_stats": FRAMES + f""", o AS (SELECT *, {OUTCOME} AS outcome FROM v_frames)
SELECT capture_id, count(*) AS frames, count(*) FILTER (WHERE outcome = 'tcp') AS tcp_segments, count(*) FILTER (WHERE outcome = 'non_ip') AS non_ip, count(*) FILTER (WHERE outcome = 'non_tcp') AS non_tcp,
  count(*) FILTER (WHERE outcome = 'fragment') AS fragments_skipped, count(*) FILTER (WHERE outcome = 'truncated') AS truncated,
  array_to_string(list_transform(list_sort(list(DISTINCT linktype)), lambda x: cast(x AS varchar)), ',') AS link_types, CASE WHEN bool_or(linktype = 147) THEN '147' ELSE '' END AS unsupported_link_types FROM o GROUP BY capture_id""",
}
