"""Derivation views: the domain tables expressed over the given star schema.

The star schema holds no packets, so each domain table is a row-local SELECT over
one base table (no join, no shuffle, no global ordering), written in the SQL that
Spark and DuckDB share. ``$SEC(x)`` (epoch seconds) and ``$SERIES(n)`` (one row per
0..n) and ``$B64(x)`` (base64 of a text) mark the expressions they spell apart.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS: dict[str, str] = {}

VIEWS["v_sessions"] = """
SELECT capture_id, session_id, client_ip, client_port, server_ip, server_port, server_name, protocol,
  mode, start_ts, end_ts, starttls_offered, starttls_requested, cleartext_bytes, overlap_conflicts, gaps,
  greeting_verb, identified_by, caps_text, commands_text, strip_text, inject_text, tls_used, banner,
  CASE WHEN mode <> 'implicit' AND session_id % 5 = 0 THEN 'PLAIN'
       WHEN mode <> 'implicit' AND session_id % 5 = 1 THEN 'CRAM-MD5' END AS auth_mech,
  CASE WHEN session_id % 15 = 0 THEN NULL ELSE concat('user', session_id % 97) END AS auth_user,
  (session_id % 5 = 0) AS auth_exposed,
  CASE WHEN session_id % 7 = 0 THEN NULL ELSE session_id % 2 = 0 END AS auth_accepted,
  CASE WHEN instr(server_host, ':') > 0 THEN concat('[', server_host, ']:', server_port)
       ELSE concat(server_host, ':', server_port) END AS endpoint,
  CASE WHEN instr(server_ip, ':') > 0 THEN concat('[', server_ip, ']:', server_port)
       ELSE concat(server_ip, ':', server_port) END AS endpoint_key
FROM (SELECT *, coalesce(server_name, server_ip) AS server_host,
    mode <> 'plaintext' AS tls_used,
    concat('220 ', coalesce(server_name, 'mail'), ' ESMTP ready') AS banner,
    CASE WHEN mode = 'implicit' THEN '' WHEN starttls_offered THEN 'PIPELINING SIZE STARTTLS 8BITMIME'
         WHEN session_id % 6 = 0 THEN 'PIPELINING XXXXXXXX SIZE' ELSE 'PIPELINING SIZE' END AS caps_text,
    CASE WHEN mode = 'implicit' OR session_id % 11 = 0 THEN ''
         WHEN protocol = 'SMTP' THEN concat(coalesce(greeting_verb, 'EHLO'), ' MAIL RCPT DATA RSET NOOP VRFY HELP QUIT')
         WHEN protocol = 'IMAP' THEN 'CAPABILITY LOGIN SELECT FETCH LOGOUT' ELSE 'USER PASS STAT RETR QUIT' END AS commands_text,
    CASE WHEN mode = 'implicit' THEN ''
         WHEN session_id % 6 = 0 AND NOT coalesce(starttls_offered, false) THEN 'capability XXXXXXXX looks like an overwritten STARTTLS'
         WHEN session_id % 31 = 0 AND mode = 'plaintext' THEN 'STARTTLS refused with 454 TLS not available' ELSE '' END AS strip_text,
    CASE WHEN mode = 'starttls' AND session_id % 37 = 0 THEN 'client sent 12 bytes of cleartext after STARTTLS before TLS' ELSE '' END AS inject_text
  FROM (SELECT concat('cap', o_custkey % 20) AS capture_id, o_orderkey AS session_id,
      CASE o_orderkey % 4 WHEN 0 THEN concat('10.20.0.', o_orderkey % 200) WHEN 1 THEN concat('198.51.100.', o_orderkey % 200)
           WHEN 2 THEN concat('151.101.1.', o_orderkey % 200) ELSE concat('fd00::', o_orderkey % 200) END AS client_ip,
      40000 + o_orderkey % 20000 AS client_port,
      CASE o_custkey % 5 WHEN 0 THEN concat('93.184.216.', o_custkey % 50) WHEN 1 THEN concat('10.1.0.', o_custkey % 50)
           WHEN 2 THEN concat('203.0.113.', o_custkey % 50) WHEN 3 THEN concat('2001:db8::', o_custkey % 50)
           ELSE concat('172.20.1.', o_custkey % 50) END AS server_ip,
      CASE o_orderkey % 8 WHEN 0 THEN 25 WHEN 1 THEN 465 WHEN 2 THEN 587 WHEN 3 THEN 143 WHEN 4 THEN 993
           WHEN 5 THEN 110 WHEN 6 THEN 995 ELSE 2525 END AS server_port,
      CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE concat('mx', o_custkey % 10, '.example.org') END AS server_name,
      CASE WHEN o_orderkey % 8 IN (3, 4) THEN 'IMAP' WHEN o_orderkey % 8 IN (5, 6) THEN 'POP3' ELSE 'SMTP' END AS protocol,
      CASE WHEN o_orderkey % 8 IN (1, 4, 6) THEN 'implicit' WHEN o_orderstatus = 'F' THEN 'plaintext' ELSE 'starttls' END AS mode,
      $SEC(o_orderdate) + o_orderkey % 86400 AS start_ts,
      $SEC(o_orderdate) + o_orderkey % 86400 + o_orderkey % 300 AS end_ts,
      CASE WHEN o_orderkey % 8 IN (1, 4, 6) THEN NULL WHEN o_orderpriority = '1-URGENT' THEN false
           WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE true END AS starttls_offered,
      (o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') OR o_orderstatus <> 'F') AS starttls_requested,
      CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 8 NOT IN (1, 4, 6) THEN cast(floor(o_totalprice) AS bigint) ELSE 0 END AS cleartext_bytes,
      CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey % 7 ELSE 0 END AS overlap_conflicts,
      CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS gaps,
      CASE WHEN o_orderkey % 8 NOT IN (0, 2, 7) THEN NULL WHEN o_orderkey % 9 = 0 THEN 'HELO' ELSE 'EHLO' END AS greeting_verb,
      CASE WHEN o_orderkey % 41 = 0 THEN 'client-verbs' ELSE 'banner' END AS identified_by
    FROM orders) AS base) AS named
"""

VIEWS["v_handshakes"] = """
SELECT capture_id, session_id, client_hello_seen, server_hello_seen,
  CASE WHEN server_hello_seen THEN wire_version END AS version,
  CASE WHEN client_hello_seen THEN 771 END AS client_legacy_version,
  CASE WHEN server_hello_seen THEN least(wire_version, 771) END AS server_legacy_version,
  CASE WHEN client_hello_seen AND session_id % 3 <> 2 THEN '772,771' ELSE '' END AS client_versions_text,
  CASE WHEN client_hello_seen AND session_id % 3 = 2 THEN '49199,49200,5,3,52,2,49171,47,10'
       WHEN client_hello_seen THEN '4865,4866,4867,49199,49200,49171,47,10,158,49195' ELSE '' END AS client_ciphers_text,
  CASE WHEN NOT server_hello_seen THEN NULL
       WHEN wire_version = 772 THEN 4865 + session_id % 3
       ELSE CASE session_id % 14 WHEN 0 THEN 49199 WHEN 1 THEN 49200 WHEN 2 THEN 49171 WHEN 3 THEN 47 WHEN 4 THEN 10
         WHEN 5 THEN 5 WHEN 6 THEN 52 WHEN 7 THEN 3 WHEN 8 THEN 1 WHEN 9 THEN 22 WHEN 10 THEN 158 WHEN 11 THEN 4
         WHEN 12 THEN 65000 ELSE 49195 END END AS cipher_suite,
  CASE WHEN NOT server_hello_seen THEN NULL WHEN session_id % 43 = 0 THEN 1 ELSE 0 END AS compression,
  CASE WHEN client_hello_seen THEN '29,23,24' ELSE '' END AS groups_text,
  CASE WHEN NOT server_hello_seen THEN NULL WHEN session_id % 47 = 0 THEN 25 WHEN session_id % 5 = 0 THEN NULL ELSE 29 END AS selected_group,
  CASE WHEN server_hello_seen AND session_id % 19 = 0 THEN 19 END AS ecdhe_curve,
  CASE WHEN server_hello_seen AND wire_version <> 772 AND session_id % 14 IN (6, 9, 10)
       THEN CASE session_id % 4 WHEN 0 THEN 512 WHEN 1 THEN 1024 WHEN 2 THEN 1536 ELSE 2048 END END AS dh_bits,
  CASE WHEN client_hello_seen AND session_id % 58 = 0 THEN '2:86' WHEN client_hello_seen AND session_id % 29 = 0 THEN '2:40'
       WHEN session_id % 23 = 0 THEN '1:0' ELSE '' END AS alerts_text,
  CASE WHEN session_id % 6 = 5 OR NOT client_hello_seen THEN NULL ELSE concat('mx', session_id % 10, '.example.org') END AS sni,
  CASE WHEN NOT server_hello_seen THEN NULL WHEN wire_version = 772 THEN true ELSE session_id % 16 <> 3 END AS secure_renegotiation,
  CASE WHEN NOT server_hello_seen OR wire_version = 772 THEN NULL ELSE session_id % 18 <> 5 END AS extended_master_secret,
  CASE WHEN server_hello_seen AND wire_version <> 772 AND session_id % 21 = 0 THEN 'TLS1.2' END AS downgrade_sentinel,
  (client_hello_seen AND session_id % 59 = 0) AS fallback_scsv,
  CASE WHEN server_hello_seen THEN CASE WHEN wire_version = 772 THEN '43,51' ELSE '65281,23' END ELSE '' END AS server_extensions_text,
  CASE WHEN server_hello_seen THEN md5(concat(endpoint_key, wire_version, CASE WHEN session_id % 71 = 0 THEN 'n' ELSE '' END)) END AS ja3s
FROM (SELECT session_id, capture_id, endpoint_key, session_id % 53 <> 0 AS client_hello_seen,
    (session_id % 53 <> 0 AND session_id % 29 <> 0) AS server_hello_seen,
    CASE WHEN session_id % 10 < 4 THEN 772 WHEN session_id % 10 < 8 THEN 771 WHEN session_id % 10 = 8 THEN 769
         WHEN session_id % 20 = 9 THEN 770 ELSE 768 END AS wire_version
  FROM v_sessions WHERE tls_used) AS base
"""

VIEWS["v_certificates"] = """
SELECT capture_id, session_id, position, subject, issuer, self_signed, key_type, key_bits, signature_hash, sans_text,
  is_ca, eku_server_auth, has_sct, key_usage_text, der_error, not_before, not_after, signed_by_next,
  md5(concat(subject, issuer, key_bits, signature_hash, not_after)) AS sha256
FROM (SELECT capture_id, session_id, position,
    CASE WHEN position = 0 THEN concat('CN=mx', session_id % 10, '.example.org,O=Mail ', session_id % 5)
         WHEN position = 1 THEN concat('O=Trust,CN=Issuing CA ', session_id % 7) ELSE 'CN=Root CA,O=Trust' END AS subject,
    CASE WHEN position = 0 AND session_id % 12 = 0 THEN concat('CN=mx', session_id % 10, '.example.org,O=Mail ', session_id % 5)
         WHEN position = 0 THEN concat('O=Trust,CN=Issuing CA ', CASE WHEN session_id % 26 = 1 THEN 99 ELSE session_id % 7 END)
         ELSE 'CN=Root CA,O=Trust' END AS issuer,
    ((position = 0 AND session_id % 12 = 0) OR position = 2) AS self_signed,
    CASE WHEN position = 0 AND session_id % 9 = 4 THEN 'EC-secp256r1' WHEN position = 0 AND session_id % 33 = 7 THEN 'DSA' ELSE 'RSA' END AS key_type,
    CASE WHEN position = 0 AND session_id % 9 = 4 THEN CASE WHEN session_id % 4 = 0 THEN 224 ELSE 256 END
         WHEN position = 0 AND session_id % 8 = 3 THEN 1024 ELSE 2048 END AS key_bits,
    CASE WHEN position = 0 AND session_id % 15 = 2 THEN 'sha1' WHEN position = 2 THEN 'md5' ELSE 'sha256' END AS signature_hash,
    CASE WHEN position > 0 OR session_id % 14 = 6 THEN '' WHEN session_id % 4 = 1 THEN '*.example.org,example.org'
         ELSE concat('mx', (session_id + session_id % 3) % 10, '.example.org') END AS sans_text,
    (position > 0 OR session_id % 39 = 3) AS is_ca,
    CASE WHEN position > 0 THEN NULL WHEN session_id % 27 = 2 THEN false WHEN session_id % 27 = 3 THEN NULL ELSE true END AS eku_server_auth,
    (session_id % 3 <> 0) AS has_sct,
    CASE WHEN position = 0 THEN 'digital_signature' WHEN session_id % 7 = 5 THEN 'crl_sign' ELSE 'key_cert_sign,crl_sign' END AS key_usage_text,
    CASE WHEN position = 0 AND session_id % 49 = 8 THEN 'invalid length encoding' END AS der_error,
    915148800 + 86400 * (session_id % 5) * (1 - least(position, 1)) AS not_before,
    CASE WHEN position = 0 THEN 788918400 + 86400 * (session_id % 5) * 1000 ELSE 2524608000 END AS not_after,
    (session_id % 26 <> 1 OR position > 0) AS signed_by_next
  FROM (SELECT *, $SERIES(session_id % 3) AS position FROM v_handshakes
    WHERE server_hello_seen AND version <> 772 AND coalesce(cipher_suite, 0) <> 52 AND session_id % 22 <> 9) AS chain) AS base
"""

VIEWS["v_observations"] = """
SELECT CASE WHEN event_id % 4 = 0 THEN 'stored' ELSE concat('cap', event_id % 3) END AS capture_id,
  event_id AS session_id, concat('203.0.113.', user_id % 250, ':25') AS endpoint_key,
  $SEC(ts) AS ts,
  CASE event_type WHEN 'signup' THEN NULL WHEN 'error' THEN false ELSE true END AS starttls_offered,
  (event_type IN ('view', 'click', 'purchase')) AS tls_used,
  CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN NULL WHEN value < 1 THEN 769
       WHEN value < 6 THEN 771 ELSE 772 END AS version,
  CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN NULL WHEN value > 55 THEN 'C'
       WHEN user_id % 3 = 0 AND value > 40 THEN 'B' ELSE 'A' END AS grade,
  CASE WHEN event_type IN ('view', 'click', 'purchase') THEN md5(concat('j', user_id % 50, CASE WHEN event_id % 97 = 0 THEN event_id ELSE 0 END)) END AS ja3s,
  CASE WHEN event_type IN ('view', 'click') THEN md5(concat('c', user_id, CASE WHEN event_id % 83 = 0 THEN event_id ELSE event_id % 2 END)) END AS cert_fp,
  CASE WHEN event_type IN ('view', 'click') THEN concat('CN=CA ', CASE WHEN event_id % 166 = 83 THEN 9 ELSE user_id % 2 END) END AS cert_issuer,
  CASE WHEN event_type IN ('view', 'click') THEN event_id % 249 = 0 END AS self_signed,
  CASE WHEN event_type IN ('view', 'click') AND event_id % 5 <> 4 THEN event_id % 7 <> 3 END AS trusted,
  event_id % 11 <> 0 AS clean,
  CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'capability XXXXXXXX looks like an overwritten STARTTLS' ELSE '' END AS strip_text
FROM events
"""

VIEWS["v_segments"] = """
SELECT capture_id, frame, ts, flags, payload,
  CASE WHEN flags IN (2, 18) THEN 4294967289 ELSE seq0 END AS seq, from_client,
  CASE WHEN from_client THEN client_ip ELSE server_ip END AS src, CASE WHEN from_client THEN client_port ELSE server_port END AS sport,
  CASE WHEN from_client THEN server_ip ELSE client_ip END AS dst, CASE WHEN from_client THEN server_port ELSE client_port END AS dport
FROM (SELECT *, CASE WHEN flags NOT IN (2, 18) AND tagged THEN concat(chr(22), chr(3), chr(3), 'ab', chr(cast(1 + frame % 3 AS int)), substr(payload0, 7)) ELSE payload0 END AS payload
 FROM (SELECT concat('cap', l_orderkey % 20) AS capture_id, (l_partkey % 7 = 0 AND l_quantity >= 6 AND l_tax < 0.08) AS tagged,
  (((l_orderkey * 8 + l_linenumber) * 51 + cast(l_quantity AS bigint)) * 100003 + l_partkey) * 1009 + l_suppkey % 1009 AS frame,
  $SEC(l_shipdate) AS ts, concat('10.20.0.', l_orderkey % 200) AS client_ip, 40000 + l_orderkey % 3000 AS client_port,
  concat('203.0.113.', l_orderkey % 50) AS server_ip,
  CASE l_orderkey % 4 WHEN 0 THEN 25 WHEN 1 THEN 143 WHEN 2 THEN 110 ELSE 8080 END AS server_port,
  l_suppkey % 5 <> 0 AS from_client,
  CASE WHEN l_linenumber = 1 AND l_linestatus = 'F' THEN 24 WHEN l_linenumber = 1 THEN 2 WHEN l_linenumber = 2 AND l_suppkey % 5 = 0 THEN 18
       WHEN l_linenumber = 7 THEN 17 WHEN l_partkey % 31 = 0 THEN 20 ELSE 24 END AS flags,
  cast((4294967290 + (l_linenumber - 1) * 25) % 4294967296 AS bigint) AS seq0,
  CASE WHEN l_tax >= 0.08 THEN '' ELSE substr(repeat(concat(md5(cast(CASE WHEN l_returnflag = 'R' THEN l_partkey ELSE l_orderkey END AS varchar(20))), chr(10)), 9),
      (l_linenumber - 1) * 25 + 1, cast(l_quantity AS int)) END AS payload0
FROM lineitem) AS plain) AS base
"""

VIEWS["v_dialogue"] = """
SELECT conv_id AS session_id, turn AS ordinal, CASE WHEN role = 'user' THEN 'C' ELSE 'S' END AS dir, text FROM conversations
"""

VIEWS["v_heads"] = """
SELECT o_orderkey AS session_id, CASE o_orderkey % 5 WHEN 0 THEN 465 WHEN 1 THEN 993 WHEN 2 THEN 995 WHEN 3 THEN 25 ELSE 4433 END AS server_port,
  CASE o_custkey % 11 WHEN 0 THEN concat('220 mx', o_custkey % 7, '.example.org ESMTP', chr(13), chr(10)) WHEN 1 THEN concat('* OK [mx.example.net] ready', chr(13), chr(10))
    WHEN 2 THEN concat('+OK <1896.697@Host.Example.COM.>', chr(13), chr(10)) WHEN 3 THEN concat('250', chr(13), chr(10)) WHEN 4 THEN concat(chr(22), chr(3), chr(1), 'x')
    WHEN 5 THEN '554-no' WHEN 6 THEN '-ERR busy' WHEN 7 THEN 'hello' ELSE '' END AS server_head,
  CASE o_orderkey % 9 WHEN 0 THEN concat('EHLO a', chr(13), chr(10), 'MAIL  FROM:<x>', chr(13), chr(10)) WHEN 1 THEN concat('a1 login u p', chr(13), chr(10), 'a2 SELECT INBOX', chr(13), chr(10))
    WHEN 2 THEN concat('USER a', chr(13), chr(10), 'PASS b', chr(13), chr(10)) WHEN 3 THEN concat('LIST', chr(13), chr(10), 'LIST 2', chr(13), chr(10)) WHEN 4 THEN concat('noop', chr(13), chr(10), 'QUIT', chr(13), chr(10))
    WHEN 5 THEN concat(chr(22), chr(3), chr(1), 'y') WHEN 6 THEN 'GET / HTTP/1.1' ELSE '' END AS client_head,
  CASE o_orderkey % 13 WHEN 0 THEN 'XXXXXXXX' WHEN 1 THEN 'STARTTLS' WHEN 2 THEN 'STARTTLX' WHEN 3 THEN 'starttls' WHEN 4 THEN 'STARXXXS' WHEN 5 THEN 'AAAAAAAA' WHEN 6 THEN 'PIPELINE'
    WHEN 7 THEN 'STLS' WHEN 8 THEN 'XXXX' WHEN 9 THEN 'STLX' WHEN 10 THEN 'UIDL' WHEN 11 THEN 'STAXXTLS' ELSE 'SIZE' END AS token,
  CASE o_orderkey % 8 WHEN 0 THEN 'plain' WHEN 1 THEN 'LOGIN' WHEN 2 THEN 'CRAM-MD5' WHEN 3 THEN 'XOAUTH2' WHEN 4 THEN 'SCRAM-SHA-256' WHEN 5 THEN 'PLAIN' WHEN 6 THEN 'LOGIN' ELSE 'EXTERNAL' END AS mechanism,
  CASE o_orderkey % 8 WHEN 0 THEN $B64(concat('', chr(0), 'u', o_custkey, chr(0), 'secret')) WHEN 1 THEN concat($B64(concat('user', o_custkey)), ' ', $B64('pw'))
    WHEN 2 THEN $B64(concat('u', o_custkey, ' 0123abcd')) WHEN 3 THEN $B64(concat('user=u', o_custkey, chr(1), 'auth=Bearer t', chr(1), chr(1)))
    WHEN 4 THEN $B64(concat('n,,n=u', o_custkey, ',r=abc')) WHEN 5 THEN 'not base64!' WHEN 6 THEN $B64(concat('user', o_custkey)) ELSE '=' END AS responses
FROM orders
"""

VIEWS["v_expected"] = """
SELECT doc_id AS session_id, CASE WHEN toxic = 1 THEN 'CRED-001' WHEN quality = 0 THEN 'TLS-002' ELSE 'PORT-001' END AS rule_id,
  concat('variant', doc_id % 6) AS variant, CASE doc_id % 3 WHEN 0 THEN 'SMTP' WHEN 1 THEN 'IMAP' ELSE 'POP3' END AS protocol,
  (doc_id % 29 = 0) AS abstained FROM labels
"""

VIEWS["v_detected"] = """
SELECT doc_id AS session_id, CASE WHEN n_chars % 5 = 0 THEN 'CRED-001' WHEN n_chars % 5 = 1 THEN 'TLS-002' ELSE 'PORT-001' END AS rule_id,
  CASE WHEN n_chars % 5 = 0 THEN 'critical' WHEN n_chars % 5 = 1 THEN 'high' ELSE 'low' END AS severity FROM documents
"""


VIEWS["v_smtp"] = """
SELECT o_orderkey AS session_id, concat(CASE WHEN o_orderkey % 7 = 0 THEN 'HELO c' ELSE 'EHLO c' END, chr(13), chr(10), CASE o_orderkey % 5
   WHEN 0 THEN concat('MAIL FROM:<a>', chr(13), chr(10), 'RCPT TO:<b>', chr(13), chr(10), 'DATA', chr(13), chr(10), 'Subject: x', chr(13), chr(10), '', chr(13), chr(10), 'DATA', chr(13), chr(10), concat('body ', o_custkey), chr(13), chr(10), '.', chr(13), chr(10), 'QUIT', chr(13), chr(10))
   WHEN 1 THEN concat('DATA', chr(13), chr(10), 'RSET', chr(13), chr(10), 'DATA', chr(13), chr(10), 'hello', chr(13), chr(10), '.', chr(13), chr(10), 'QUIT', chr(13), chr(10))
   WHEN 2 THEN concat('AUTH LOGIN', chr(13), chr(10), $B64(concat('user', o_custkey)), chr(13), chr(10), $B64('pw'), chr(13), chr(10), 'QUIT', chr(13), chr(10))
   WHEN 3 THEN concat(concat('AUTH PLAIN ', $B64(concat('', chr(0), 'u', o_custkey, chr(0), 'pw'))), chr(13), chr(10), 'NOOP', chr(13), chr(10), 'QUIT', chr(13), chr(10))
   ELSE concat('STARTTLS', chr(13), chr(10), 'MAIL FROM:<a>', chr(13), chr(10), 'QUIT', chr(13), chr(10)) END) AS client_text,
  concat('220 mx.example.org ready', chr(13), chr(10), CASE WHEN o_orderkey % 7 = 0 THEN '250 mx' ELSE concat('250-mx', chr(13), chr(10), '250-SIZE 100', chr(13), chr(10), CASE WHEN o_orderkey % 5 = 4 THEN '250 XXXXXXXX' ELSE '250 STARTTLS' END) END, chr(13), chr(10), CASE o_orderkey % 5
   WHEN 0 THEN concat('250 ok', chr(13), chr(10), '250 ok', chr(13), chr(10), '354 go', chr(13), chr(10), '250 queued', chr(13), chr(10), '221 bye', chr(13), chr(10))
   WHEN 1 THEN concat('503 no', chr(13), chr(10), '250 reset', chr(13), chr(10), '354 go', chr(13), chr(10), '250 queued', chr(13), chr(10), '221 bye', chr(13), chr(10))
   WHEN 2 THEN concat('334 VXNlcm5hbWU6', chr(13), chr(10), '334 UGFzc3dvcmQ6', chr(13), chr(10), '235 ok', chr(13), chr(10), '221 bye', chr(13), chr(10))
   WHEN 3 THEN concat('535 bad', chr(13), chr(10), '250 ok', chr(13), chr(10), '221 bye', chr(13), chr(10))
   ELSE concat('454 later', chr(13), chr(10), '250 ok', chr(13), chr(10), '221 bye', chr(13), chr(10)) END) AS server_text
FROM orders
"""


VIEWS["v_imap"] = """
SELECT o_orderkey AS session_id, concat('a1 CAPABILITY', chr(13), chr(10), 'a2 ', CASE WHEN o_orderkey % 3 = 0 THEN concat('login u', o_custkey, ' "p w"') WHEN o_orderkey % 3 = 1 THEN 'STARTTLS' ELSE 'NOOP' END, chr(13), chr(10),
    'junk', chr(13), chr(10), 'a2 LOGOUT', chr(13), chr(10)) AS client_text,
  concat('* OK [CAPABILITY IMAP4rev1 starttls] ready', chr(13), chr(10), '* CAPABILITY IMAP4rev1 ', CASE WHEN o_orderkey % 4 = 0 THEN 'XXXXXXXX' ELSE 'STARTTLS' END, chr(13), chr(10), 'a1 OK done', chr(13), chr(10),
    'a2 ', CASE WHEN o_orderkey % 2 = 0 THEN 'OK' ELSE 'NO' END, ' first', chr(13), chr(10), '* BYE', chr(13), chr(10), CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('a2 OK out', chr(13), chr(10)) END) AS server_text
FROM orders
"""


def _hex(expr: str, digits: int) -> str:
    """Big-endian hex text of a number; the same words in both dialects."""
    return f"lpad(hex(cast({expr} AS bigint)), {digits}, '0')"


def _little(expr: str, digits: int) -> str:
    big = _hex(expr, digits)
    return "concat(" + ", ".join(f"substr({big}, {i}, 2)" for i in range(digits - 1, 0, -2)) + ")"


def _ip_hex(col: str) -> str:
    return "concat(" + ", ".join(_hex(f"split_part({col}, '.', {i})", 2) for i in range(1, 5)) + ")"


_TCP = (f"concat({_hex('sport', 4)}, {_hex('dport', 4)}, {_hex('seq', 8)}, '00000000', '5', {_hex('flags', 3)}, 'FFFF00000000', hex(payload))")

VIEWS["v_frames"] = f"""
SELECT capture_id, frame, ts, src, dst, sport, dport, seq, flags, payload, shape, fault, linktype,
  CASE WHEN fault = 4 THEN concat('FFFF', ip_hex) WHEN fault = 2 AND shape < 4 THEN concat('020000000001020000000002', '0806', ip_hex)
    WHEN shape < 4 THEN concat('020000000001020000000002', '0800', ip_hex) WHEN shape = 4 THEN concat('020000000001020000000002', '8100002A', '0800', ip_hex)
    WHEN shape = 5 THEN concat('0000000100060200000000010000', '0800', ip_hex) WHEN shape = 6 THEN ip_hex
    WHEN shape = 7 THEN concat('020000000001020000000002', '86DD', ip_hex) WHEN shape = 8 THEN concat('0800000000000001000100060200000000010000', ip_hex)
    ELSE concat('02000000', ip_hex) END AS data_hex
FROM (SELECT *, CASE WHEN fault = 4 THEN 147 WHEN shape IN (0, 1, 2, 3, 4, 7) THEN 1 WHEN shape = 5 THEN 113 WHEN shape = 6 THEN 101 WHEN shape = 8 THEN 276 ELSE 0 END AS linktype,
    CASE WHEN shape = 7 THEN concat('60000000', {_hex('length(tcp_hex) / 2 + 8', 4)}, '0040', '20010DB80000000000000000', {_ip_hex('src')}, '20010DB80000000000000000', {_ip_hex('dst')},
        CASE WHEN fault = 1 THEN '2C' WHEN fault = 0 THEN '11' ELSE '06' END, '00000000000000', tcp_hex)
      ELSE concat('4500', {_hex('length(tcp_hex) / 2 + 20', 4)}, '0000', CASE WHEN fault = 1 THEN '2000' ELSE '0000' END, '40', CASE WHEN fault = 0 THEN '11' ELSE '06' END, '0000',
        {_ip_hex('src')}, {_ip_hex('dst')}, tcp_hex) END AS ip_hex
  FROM (SELECT *, CASE WHEN fault = 3 THEN substr(full_hex, 1, 20) ELSE full_hex END AS tcp_hex
    FROM (SELECT *, frame % 10 AS shape, frame % 37 AS fault, {_TCP} AS full_hex FROM v_segments) AS whole) AS cut) AS wrapped
"""

_SHB = "0A0D0D0A1C0000004D3C2B1A01000000FFFFFFFFFFFFFFFF1C000000"
_PAD = "repeat('00', cast((4 - size % 4) % 4 AS int))"
VIEWS["v_captures"] = f"""
SELECT concat('file', frame) AS capture_id, ts, frame AS source_frame, linktype, form, data_hex, size,
  CASE form WHEN 0 THEN concat('D4C3B2A1020004000000000000000000FFFF0000', {_little('linktype', 8)}, {_little('ts', 8)}, {_little('7', 8)}, {_little('size', 8)}, {_little('size', 8)}, data_hex, 'AABB')
    WHEN 1 THEN concat('A1B2C3D400020004000000000000000000000FFF', {_hex('linktype', 8)}, {_hex('ts', 8)}, {_hex('7', 8)}, {_hex('size', 8)}, {_hex('size', 8)}, data_hex,
      {_hex('ts + 1', 8)}, {_hex('0', 8)}, {_hex('size', 8)}, {_hex('size', 8)}, data_hex)
    WHEN 2 THEN concat('4D3CB2A1020004000000000000000000FFFF0000', {_little('linktype', 8)}, {_little('ts', 8)}, {_little('7000', 8)}, {_little('size', 8)}, {_little('size', 8)}, data_hex)
    WHEN 3 THEN concat('{_SHB}', '0100000020000000', {_little('linktype', 4)}, '0000FFFF0000', '090001000900000000000000', '20000000',
      '06000000', {_little('32 + size + (4 - size % 4) % 4', 8)}, '00000000', {_little('floor((ts * 1000000000 + 7000) / 4294967296)', 8)}, {_little('(ts * 1000000000 + 7000) % 4294967296', 8)},
      {_little('size', 8)}, {_little('size', 8)}, data_hex, {_PAD}, {_little('32 + size + (4 - size % 4) % 4', 8)})
    WHEN 4 THEN '504B0304AABBCCDD' WHEN 5 THEN '' ELSE '255044462D312E34' END AS content_hex
FROM (SELECT *, CASE WHEN frame % 101 < 3 THEN 4 + frame % 101 ELSE frame % 4 END AS form, length(data_hex) / 2 AS size FROM v_frames) AS sized
"""


def _sized(text: str, digits: int = 4) -> str:
    """Length-prefixed hex block."""
    return f"concat({_hex(f'length({text}) / 2', digits)}, {text})"


VIEWS["v_wire"] = f"""
SELECT *, CASE WHEN ch = '' THEN '' ELSE concat('160301', {_sized("concat('01', " + _sized('ch', 6) + ")")}, alert_c, CASE WHEN server_hello_seen THEN '1403030001011703030004DEADBEEF1703030002BEEF' ELSE '' END) END AS client_hex,
  concat(CASE WHEN sh = '' THEN '' ELSE concat('160303', {_sized("concat('02', " + _sized('sh', 6) + ", CASE WHEN ske = '' THEN '' ELSE concat('0C', " + _sized('ske', 6) + ") END)")}) END, alert_s,
    CASE WHEN server_hello_seen THEN '1403030001011703030004DEADBEEF' ELSE '' END) AS server_hex
FROM (SELECT *, CASE WHEN client_hello_seen THEN concat('0303', random_a, '00', {_sized('ciphers')}, '0100', {_sized('cexts')}) ELSE '' END AS ch,
    CASE WHEN server_hello_seen THEN concat({_hex('server_legacy_version', 4)}, random_b, '00', {_hex('cipher_suite', 4)}, {_hex('compression', 2)}, {_sized('sexts')}) ELSE '' END AS sh,
    CASE WHEN alerts_text = '2:40' THEN '15030300020228' WHEN alerts_text = '2:86' THEN '15030300020256' ELSE '' END AS alert_s,
    CASE WHEN alerts_text = '1:0' THEN '15030300020100' ELSE '' END AS alert_c
  FROM (SELECT *, upper(concat(md5(cast(session_id AS varchar(20))), md5(concat('x', session_id)))) AS random_a,
      concat(upper(substr(concat(md5(concat('y', session_id)), md5(concat('z', session_id))), 1, 48)), CASE WHEN downgrade_sentinel IS NOT NULL THEN '444F574E47524401' ELSE '00112233445566AA' END) AS random_b,
      concat('0A0A', CASE WHEN session_id % 3 = 2 THEN 'C02FC030000500030034' || '0002C013002F000A' ELSE '130113021303C02FC030C013002F000A009EC02B' END, CASE WHEN fallback_scsv THEN '5600' ELSE '' END, '00FF') AS ciphers,
      concat(CASE WHEN sni IS NULL THEN '' ELSE concat('0000', {_hex('length(sni) + 5', 4)}, {_hex('length(sni) + 3', 4)}, '00', {_hex('length(sni)', 4)}, hex(sni)) END,
        '000A000A00081A1A001D00170018', '000B00020100', CASE WHEN session_id % 3 <> 2 THEN '002B0007062A2A03040303' ELSE '' END) AS cexts,
      CASE WHEN version = 772 THEN concat('002B00020304', '00330024001D0020', upper(md5('k')), upper(md5('l'))) ELSE concat(CASE WHEN secure_renegotiation THEN 'FF01000100' ELSE '' END, CASE WHEN extended_master_secret THEN '00170000' ELSE '' END) END AS sexts,
      CASE WHEN dh_bits IS NOT NULL THEN concat({_hex('dh_bits / 8', 4)}, '80', repeat('00', cast(dh_bits / 8 - 1 AS int)), '000102000103')
        WHEN ecdhe_curve IS NOT NULL AND version <> 772 AND cipher_suite IN (49171, 49195, 49199, 49200) THEN '030013' ELSE '' END AS ske
    FROM v_handshakes) AS parts) AS built
"""


def _requires(text: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b{v}\b", text)]


def _closure(names: list[str]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in _requires(VIEWS[name]):
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for n in names:
        visit(n)
    return ordered


def _render(text: str, dialect: str) -> str:
    form = (r"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', \1)" if dialect == "spark"
            else r"cast(floor(epoch(\1)) AS bigint)")
    text = re.sub(r"\$SEC\((\w+)\)", form, text)
    series = r"explode(sequence(0, \1))" if dialect == "spark" else r"unnest(generate_series(0, \1))"
    depth3 = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
    text = re.sub(r"\$B64(" + depth3 + ")", r"base64\1" if dialect == "spark" else r"to_base64(encode\1)", text)
    return re.sub(r"\$SERIES\(([^)]*)\)", series, text)


def with_clause(names: list[str]) -> str:
    """WITH list for DuckDB, in dependency order."""
    parts = [f"{n} AS ({_render(VIEWS[n], 'duckdb').strip()})" for n in _closure(names)]
    return "WITH " + ",\n".join(parts)


@lru_cache(maxsize=256)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=256)
def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derivation view as a DataFrame (lazy; nothing is registered globally)."""
    names = _closure([name])
    bases = [t for t in TABLES if any(re.search(rf"\bFROM {t}\b", VIEWS[n]) for n in names)]
    ctes = []
    for n in names:
        text = _render(VIEWS[n], "spark")
        for t in bases:
            text = re.sub(rf"\bFROM {t}\b", f"FROM {{{t}}}", text)
        ctes.append(f"{n} AS ({text})")
    sql = "WITH " + ", ".join(ctes) + f" SELECT * FROM {name}"
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in bases})


def words(name: str, sep: str = " ") -> F.Column:
    """Delimited text to array<string>; empty text is the empty array."""
    return F.filter(F.split(F.col(name), sep), lambda x: x != "")


def ints(name: str) -> F.Column:
    return words(name, ",").cast("array<bigint>")


@lru_cache(maxsize=256)
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session records with their list columns."""
    df = view(spark, sf_dir, "v_sessions")
    auth = F.when(F.col("auth_mech").isNotNull(), F.array(F.struct(
        F.col("auth_mech").alias("mechanism"), F.col("auth_user").alias("username"),
        F.col("auth_exposed").alias("secret_exposed"), F.col("auth_accepted").alias("accepted"))))
    empty = "array<struct<mechanism:string,username:string,secret_exposed:boolean,accepted:boolean>>"
    return df.select(
        "*", words("caps_text").alias("capabilities"), words("commands_text").alias("cleartext_commands"),
        words("strip_text", "\\|").alias("strip_indicators"),
        words("inject_text", "\\|").alias("injection_indicators"),
        F.coalesce(auth, F.array().cast(empty)).alias("auth_events"),
    ).drop("caps_text", "commands_text", "strip_text", "inject_text",
           "auth_mech", "auth_user", "auth_exposed", "auth_accepted")


@lru_cache(maxsize=256)
def handshakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "v_handshakes")
    alerts = F.transform(words("alerts_text", ","), lambda a: F.struct(
        F.split_part(a, F.lit(":"), F.lit(1)).cast("bigint").alias("level"),
        F.split_part(a, F.lit(":"), F.lit(2)).cast("bigint").alias("description")))
    return df.select(
        "*", ints("client_versions_text").alias("client_supported_versions"),
        ints("client_ciphers_text").alias("client_ciphers"), ints("groups_text").alias("supported_groups"),
        ints("server_extensions_text").alias("server_extensions"), alerts.alias("alerts"),
    ).drop("client_versions_text", "client_ciphers_text", "groups_text", "alerts_text", "server_extensions_text")


@lru_cache(maxsize=256)
def certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = view(spark, sf_dir, "v_certificates")
    return df.select("*", words("sans_text", ",").alias("sans"), words("key_usage_text", ",").alias("key_usage")) \
        .drop("sans_text", "key_usage_text")
