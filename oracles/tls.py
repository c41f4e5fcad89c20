"""Reference SQL of the TLS queries: the facts the bytes were built from."""

from __future__ import annotations

from mailveil import dims
from mailveil.plans.views import with_clause
from oracles import common

W = with_clause(["v_wire"])
_A, _B = "49199,49200,5,3,52,2,49171,47,10", "4865,4866,4867,49199,49200,49171,47,10,158,49195"
CIPHERS = f"concat(CASE WHEN session_id % 3 = 2 THEN '{_A}' ELSE '{_B}' END, CASE WHEN fallback_scsv THEN ',22016' ELSE '' END, ',255')"
CEXT = "concat(CASE WHEN sni IS NULL THEN '' ELSE '0,' END, '10,11', CASE WHEN session_id % 3 <> 2 THEN ',43' ELSE '' END)"
SEXT = "CASE WHEN version = 772 THEN '43,51' ELSE concat_ws(',', CASE WHEN secure_renegotiation THEN '65281' END, CASE WHEN extended_master_secret THEN '23' END) END"
CURVE = "CASE WHEN dh_bits IS NULL AND version <> 772 AND cipher_suite IN (49171, 49195, 49199, 49200) THEN ecdhe_curve END"
_NAME = common.suite_name_sql("cipher_suite")
_GROUP = " ".join(f"WHEN {k} THEN '{v}'" for k, v in dims.GROUP_NAMES.items())
_BITS = " ".join(f"WHEN {k} THEN {v}" for k, v in dims.GROUP_BITS.items())
_ALERT = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.ALERT_NAMES.items())

SQL = {
    "handshake_facts": W + f""" SELECT concat(capture_id, '/', session_id) AS key, client_hello_seen, server_hello_seen, version, client_legacy_version, server_legacy_version, sni, cipher_suite, compression,
  CASE WHEN version = 772 THEN 29 ELSE {CURVE} END AS selected_group, {CURVE} AS ecdhe_curve, CASE WHEN server_hello_seen THEN dh_bits END AS dh_bits, alerts_text AS alerts,
  CASE WHEN client_hello_seen THEN {CIPHERS} ELSE '' END AS client_ciphers, CASE WHEN client_hello_seen THEN '29,23,24' ELSE '' END AS supported_groups, client_versions_text AS client_supported_versions,
  CASE WHEN server_hello_seen THEN {SEXT} ELSE '' END AS server_extensions, CASE WHEN client_hello_seen THEN fallback_scsv END AS fallback_scsv,
  CASE WHEN server_hello_seen THEN secure_renegotiation WHEN client_hello_seen THEN true END AS secure_renegotiation, extended_master_secret, downgrade_sentinel,
  CASE WHEN client_hello_seen THEN md5(concat('771,', replace({CIPHERS}, ',', '-'), ',', replace({CEXT}, ',', '-'), ',29-23-24,0')) END AS ja3,
  CASE WHEN server_hello_seen THEN md5(concat(server_legacy_version, ',', cipher_suite, ',', replace({SEXT}, ',', '-'))) END AS ja3s,
  client_hello_seen AND server_hello_seen AND alerts_text NOT LIKE '2:%' AS complete FROM v_wire WHERE client_hex <> '' OR server_hex <> ''""",
    "handshake_message_order": W + """ SELECT concat(capture_id, '/', session_id) AS key, 'C' AS dir, concat_ws(' > ', 'ClientHello', CASE WHEN alert_c <> '' THEN 'Alert warning close_notify' END,
  CASE WHEN server_hello_seen THEN 'ChangeCipherSpec > encrypted records ×2' END) AS flow FROM v_wire WHERE client_hex <> ''
UNION ALL SELECT concat(capture_id, '/', session_id), 'S', concat_ws(' > ', CASE WHEN sh <> '' THEN 'ServerHello' END, CASE WHEN sh <> '' AND ske <> '' THEN 'ServerKeyExchange' END,
  CASE alerts_text WHEN '2:40' THEN 'Alert fatal handshake_failure' WHEN '2:86' THEN 'Alert fatal inappropriate_fallback' END,
  CASE WHEN server_hello_seen THEN 'ChangeCipherSpec > encrypted records ×1' END) FROM v_wire WHERE server_hex <> ''""",
    "handshake_labels": with_clause(["v_handshakes"]) + f", {common.SUITES} " + f""" SELECT capture_id, session_id, {common.version_name_sql('version')} AS version_name,
  CASE version WHEN 768 THEN 1 WHEN 769 THEN 2 WHEN 770 THEN 3 WHEN 771 THEN 4 WHEN 772 THEN 5 ELSE 0 END AS ordinal, CASE WHEN version = 768 THEN 'critical' WHEN version IN (769, 770) THEN 'high' END AS issue,
  {_NAME} AS cipher_name, CASE selected_group {_GROUP} END AS group_name, CASE selected_group {_BITS} END AS group_bits, selected_group IN (19, 21) AS weak_group,
  CASE split_part(alerts_text, ':', 2) {_ALERT} END AS alert FROM v_handshakes""",
}
