"""Session rows from byte streams: hand-made dialogues, and random ones against a plain reader of two strings."""

import base64
import random
import re

import pytest

from mailveil.operators import dialogue, sessions, transcript
from mailveil.session import cut_lineage

TLS = b"\x16\x03\x01\x00\x04abcd"


CHUNK = 16


def read(spark, flows):
    """The dialogues of flows (id, server port, client bytes, server bytes)."""
    texts = [(k, d, t.decode("latin-1")) for k, _, c, s in flows for d, t in (("C", c), ("S", s))]
    chunks = dialogue.cut_text(spark.createDataFrame(texts, "flow_id string, dir string, text string"), ["flow_id", "dir"], CHUNK)
    return sessions.read(chunks, spark.createDataFrame([(k, p) for k, p, _, _ in flows], "flow_id string, server_port int"), CHUNK)


def crlf(*lines):
    return b"".join((x if isinstance(x, bytes) else x.encode("latin-1")) + b"\r\n" for x in lines)


def b64(text):
    return base64.b64encode(text.encode()).decode()


def hand_made():
    imap_big = b"x" * 300
    return [
        ("relay", 25, crlf("EHLO c", "MAIL FROM:<a>", "RCPT TO:<b>", "DATA", "Subject: DATA", "", "DATA", "..", ".", "QUIT", "NOOP"),
         crlf("220 mx.example.org hi", "250-mx", "250-SIZE 10", "250 starttls", "250 ok", "250 ok", "354 go", "250 queued", "221 bye", "250 no")),
        ("refused", 25, crlf("EHLO c", *["DATA"] * 40, "RSET", "DATA", "one", ".", "AUTH LOGIN", b64("ann"), b64("pw"), "QUIT"),
         crlf("220 x", "250 x", *["503 no"] * 40, "250 reset", "354 go", "250 queued", "334 VXNlcm5hbWU6", "334 UGFzc3dvcmQ6", "235 in", "221 bye")),
        ("empty body", 25, crlf("HELO c", "DATA", ".", "QUIT", ".", "NOOP"), crlf("220 x", "250 x", "354 go", "250 queued", "221 bye")),
        ("cut body", 25, crlf("EHLO c", "DATA", "one") + b"two", crlf("220 x", "250 x", "354 go")),
        ("lf body", 2525, b"EHLO c\nDATA\nab\n.\nQUIT\n", b"220 x\n250 x\n354 go\n250 ok\n221 bye\n"),
        ("bdat", 25, crlf("EHLO c", "BDAT 7") + b"QUIT\r\n.BDAT 3 LAST\r\nabcQUIT\r\nBDAT 99999\r\nxy", crlf("220 x", "250 x", "250 ok", "250 ok", "221 bye")),
        ("bdat cut", 25, crlf("EHLO c", "BDAT -4", "BDAT x", "BDAT 999") + b"xy", crlf("220 x", "250 x", "250 ok", "250 ok")),
        ("starttls", 587, crlf("EHLO c", "STARTTLS") + TLS + crlf("EHLO again"), crlf("220 x", "250-x", "250 STARTTLS", "220 go") + TLS),
        ("inject", 587, crlf("EHLO c", "STARTTLS", "MAIL FROM:<evil>", "RCPT x") + TLS, crlf("220 x", "250-x", "250 STARTTLS", "220 go", "250 ok") + b"\x15\x03\x01" + TLS),
        ("alert first", 587, crlf("EHLO c", "STARTTLS") + b"\x15\x03\x01\x00\x02\x01\x00" + TLS, crlf("220 x", "250 x", "220 go")),
        ("stays clear", 587, crlf("EHLO c", "STARTTLS", "MAIL FROM:<a>"), crlf("220 x", "250-x", "250 XXXXXXXX", "220 go", "250 ok")),
        ("no tls seen", 587, crlf("EHLO c", "STARTTLS"), crlf("220 x", "250 x", "220 go")),
        ("denied", 25, crlf("EHLO c", "STARTTLS", "AUTH PLAIN " + b64("\0bob\0pw"), "AUTH PLAIN", "*", "QUIT"), crlf("220 x", "250-x", "250 STARTTLX", "454 4.7 later", "535 no", "334 ", "501 off")),
        ("client only", 25, crlf("EHLO c", "MAIL FROM:<a>", "DATA", "body", ".", "QUIT"), b""),
        ("implicit", 993, TLS, TLS), ("web", 443, TLS, TLS), ("noise", 25, b"hello\r\n", b"world\r\n"),
        ("imap", 1143, crlf("a1 CAPABILITY", "a2 LOGIN {5}") + b"an\r\nn" + crlf(" {2+}") + b"pw" + crlf("", "a3 APPEND box {300}") + imap_big + crlf("", "a4 FETCH 1 BODY[]", "a5 LOGOUT", "a6 NOOP"),
         crlf("* OK [CAPABILITY IMAP4rev1 STARTTLS] mx.example.org ready", "* CAPABILITY IMAP4rev1 STARTTLZ", "a1 OK", "+ go", "a2 OK [CAPABILITY IMAP4rev1] in", "+ go", "a3 OK", "* 1 FETCH (BODY[] {26}") +
         crlf("a4 OK not an answer {99}") + crlf(")", "a4 OK done", "* BYE", "a5 OK")),
        ("imap auth", 143, crlf("a1 AUTHENTICATE PLAIN", b64("\0cid\0pw"), "a2 AUTHENTICATE PLAIN " + b64("\0dan\0"), "junk", "a3 NOOP", "a4 NOOP"),
         crlf("* OK hi", "+ ", "a1 OK in", "a2 NO bad", "a4 OK late", "a3 OK lost")),
        ("imap tls", 143, crlf("a1 STARTTLS") + TLS, crlf("* OK hi", "* CAPABILITY X", "a1 OK go") + TLS),
        ("imap no", 143, crlf("a1 STARTTLS", "a2 LOGIN eve \"p w\""), crlf("* OK hi", "a1 BAD no", "a2 NO")),
        ("pop", 110, crlf("CAPA", "USER ann ", "PASS pw", "LIST", "RETR 1", "TOP 1 0", "UIDL 4", "QUIT", "STAT"),
         crlf("+OK mx.example.org ready", "+OK list", "TOP", "STLX", ".", "+OK", "+OK in", "+OK 1", "1 120", ".", "+OK 120 octets", "+OK not an answer", "..", ".", "-ERR no", "+OK 4 x", "+OK bye")),
        ("pop auth", 8110, crlf("AUTH", "AUTH PLAIN", b64("\0bob\0pw"), "APOP cat 00", "STLS", "PASS"), crlf("+OK", "+OK", "PLAIN", ".", "+ ", "-ERR", "+OK", "-ERR no", "+OK")),
        ("pop cut", 110, crlf("CAPA", "RETR 1"), crlf("+OK", "-ERR", "+OK", "body", "more") + b"unfinished"),
        ("pop tls", 110, crlf("CAPA", "STLS") + TLS, crlf("+OK", "+OK", "STLS", ".", "+OK go") + TLS),
    ]


def test_smtp_bodies(hand):
    r = hand["relay"]
    assert (r.cleartext_message_bytes, r.cleartext_commands) == (30, ["EHLO", "MAIL", "RCPT", "DATA", "QUIT"])
    assert (r.banner, r.server_name, r.greeting_verb, r.capabilities, r.starttls_offered) == ("mx.example.org hi", "mx.example.org", "EHLO", ["SIZE", "STARTTLS"], True)
    r = hand["refused"]
    assert r.cleartext_message_bytes == 8 and len(r.cleartext_commands) == 45
    assert [tuple(a) for a in r.auth_events] == [("LOGIN", "ann", True, True)]
    assert hand["empty body"].cleartext_message_bytes == len(crlf(".", "QUIT", ".")) and hand["empty body"].cleartext_commands == ["HELO", "DATA", "NOOP"]
    assert (hand["cut body"].cleartext_message_bytes, hand["lf body"].cleartext_message_bytes, hand["client only"].cleartext_message_bytes) == (8, 5, 9)
    assert hand["lf body"].cleartext_commands == ["EHLO", "DATA", "QUIT"]
    r = hand["bdat"]
    assert (r.cleartext_message_bytes, r.cleartext_commands) == (10, ["EHLO", "BDAT", "BDAT", "QUIT"])
    assert hand["bdat cut"].cleartext_message_bytes == 2
    assert hand["client only"].identified_by == "client-verbs" and hand["client only"].one_sided


def test_upgrades(hand):
    r = hand["starttls"]
    assert (r.mode, r.starttls_response, r.tls_client_offset, r.tls_server_offset) == ("starttls", "220 go", 18, 36)
    assert r.cleartext_commands == ["EHLO", "STARTTLS"] and r.injection_indicators == [] and r.tls_used
    r = hand["inject"]
    assert r.tls_client_offset == 44 and r.injection_indicators == [
        "client sent 26 bytes of cleartext after STARTTLS and before TLS (commands: MAIL, RCPT)",
        "server sent 11 bytes of cleartext after accepting STARTTLS and before TLS (answers: 250, \x15\x03\x01)"]
    assert (hand["alert first"].tls_client_offset, hand["alert first"].injection_indicators) == (18, [])
    r = hand["stays clear"]
    assert not r.tls_used and r.strip_indicators == ["EHLO capability 'XXXXXXXX' looks like an overwritten STARTTLS", "STARTTLS was accepted, yet the dialogue went on in cleartext"]
    assert "the capture ends there" in hand["no tls seen"].notes[0] and hand["no tls seen"].strip_indicators == []
    r = hand["denied"]
    assert r.strip_indicators == ["EHLO capability 'STARTTLX' looks like an overwritten STARTTLS", "STARTTLS refused with '454 4.7 later'"] and not r.starttls_accepted
    assert [tuple(a) for a in r.auth_events] == [("PLAIN", "bob", True, False), ("PLAIN", None, False, False)]
    assert (hand["implicit"].protocol, hand["implicit"].mode, hand["implicit"].tls_client_offset) == ("IMAP", "implicit", 0)
    assert "web" not in hand and "noise" not in hand


def test_imap(hand):
    r = hand["imap"]
    assert r.cleartext_commands == ["CAPABILITY", "LOGIN", "APPEND", "FETCH", "LOGOUT"] and r.cleartext_message_bytes == 326
    assert [tuple(a) for a in r.auth_events] == [("IMAP-LOGIN", "an\r\nn", True, True)]
    assert (r.server_name, r.capabilities, r.starttls_offered) == ("mx.example.org", ["IMAP4REV1"], False)
    assert r.strip_indicators == ["IMAP capability 'STARTTLZ' looks like an overwritten STARTTLS"] and "unusual port" in r.notes[-1]
    r = hand["imap auth"]
    assert [tuple(a) for a in r.auth_events] == [("PLAIN", "cid", True, True), ("PLAIN", "dan", False, False)] and r.cleartext_commands == ["AUTHENTICATE", "AUTHENTICATE", "NOOP", "NOOP"]
    r = hand["imap tls"]
    assert (r.mode, r.starttls_response, r.tls_client_offset, r.tls_server_offset, r.starttls_offered) == ("starttls", "a1 OK go", 13, 35, False)
    assert hand["imap no"].strip_indicators == ["STARTTLS refused with 'a1 BAD no'"] and tuple(hand["imap no"].auth_events[0]) == ("IMAP-LOGIN", "eve", True, False)


def test_pop3(hand):
    r = hand["pop"]
    assert r.cleartext_commands == ["CAPA", "USER", "PASS", "LIST", "RETR", "TOP", "UIDL", "QUIT"] and r.cleartext_message_bytes == 26
    assert [tuple(a) for a in r.auth_events] == [("USER/PASS", "ann", True, True)] and r.server_name == "mx.example.org"
    assert r.capabilities == ["TOP", "STLX"] and r.starttls_offered is False and r.strip_indicators == ["POP3 capability 'STLX' looks like an overwritten STLS"]
    r = hand["pop auth"]
    assert [tuple(a) for a in r.auth_events] == [("PLAIN", "bob", True, False), ("APOP", "cat", False, True), ("USER/PASS", None, False, True)]
    assert r.strip_indicators == ["STLS refused with '-ERR no'"]
    assert (hand["pop cut"].cleartext_message_bytes, hand["pop cut"].capabilities, hand["pop cut"].starttls_offered) == (12, [], False)
    assert (hand["pop tls"].tls_client_offset, hand["pop tls"].tls_server_offset, hand["pop tls"].starttls_offered) == (12, 27, True)


class Side:
    """One direction as a string with a cursor."""

    def __init__(self, data):
        self.data, self.at = data, 0

    def line(self):
        stop = self.data.find("\n", self.at)
        if stop < 0 or re.match(r"[\x14-\x17]\x03", self.data[self.at:self.at + 2]):
            return None
        text, self.at = self.data[self.at:stop].rstrip("\r"), stop + 1
        return text

    def skip(self, n):
        before, self.at = self.at, min(self.at + n, len(self.data))
        return self.at - before


def plain_smtp(c, s, out):
    def reply():
        first = text = s.line()
        while text is not None and text[3:4] == "-":
            text = s.line()
        return None if first is None else first[:3]

    paired = bool(s.data)
    reply()
    while (text := c.line()) is not None:
        verb, _, arg = text.partition(" ")
        verb = verb.upper()
        if not verb:
            continue
        out["commands"].append(verb)
        if verb == "BDAT":
            size = arg.split()[0] if arg.split() else "0"
            out["bytes"] += c.skip(int(size) if size.isdigit() else 0)
        code = reply()
        if verb == "AUTH":
            while code == "334":
                given = c.line()
                if given is None:
                    code = None
                elif given != "*":
                    code = reply()
                    continue
                break
            out["auth"].append(None if code is None else code == "235")
        elif verb == "DATA" and (code == "354" or not paired):
            found = [m.end() for p in (r"\r\n\.\r\n", r"\n\.\n") for m in [re.compile(p).search(c.data, c.at)] if m]
            out["bytes"] += c.skip((found[0] if found else len(c.data)) - c.at)
            if code == "354":
                reply()
        elif verb == "QUIT":
            break
        elif verb == "STARTTLS" and code == "220":
            out["starts"] = (c.at, s.at)
            break


def plain_pop3(c, s, out):
    s.line()
    while (text := c.line()) is not None:
        verb, _, arg = text.partition(" ")
        verb = verb.upper()
        out["commands"].append(verb)
        answer, begin = s.line(), s.at
        ok = None if answer is None else answer.startswith("+OK")
        bare = verb == "AUTH" and arg.split(" ")[0] == ""
        if ok and (verb in ("CAPA", "RETR", "TOP") or bare or verb in ("LIST", "UIDL") and not arg.strip()):
            while s.line() not in (None, "."):
                pass
            out["bytes"] += s.at - begin if verb in ("RETR", "TOP") else 0
        elif verb == "AUTH" and not bare:
            while answer is not None and answer.startswith("+ "):
                answer = s.line() if c.line() is not None else None
            ok = None if answer is None else answer.startswith("+OK")
        if verb in ("PASS", "APOP") or verb == "AUTH" and not bare:
            out["auth"].append(ok)
        if verb == "QUIT":
            break
        if verb == "STLS" and ok:
            out["starts"] = (c.at, s.at)
            break


def plain_imap(c, s, out):
    def logical(side, mine):
        text = whole = side.line()
        while text is not None and (m := re.search(r"\{(\d+)(\+?)\}\Z", text)):
            n = int(m[1])
            if mine and not m[2]:
                logical(s, False)
            side.skip(n)
            out["bytes"] += n if n >= 256 or not mine else 0
            text = side.line() or ""
            whole += " " + text
        return whole

    logical(s, False)
    while (text := logical(c, True)) is not None:
        words = text.split(" ")
        if len(words) < 2:
            continue
        verb, status = words[1].upper(), None
        out["commands"].append(verb)
        while (answer := logical(s, False)) is not None:
            if answer.startswith("* "):
                continue
            if answer.startswith("+") and verb == "AUTHENTICATE":
                if c.line() is None:
                    break
            elif answer.startswith(words[0] + " "):
                status = answer.split(" ")[1].upper() == "OK"
                break
        if verb in ("LOGIN", "AUTHENTICATE"):
            out["auth"].append(status)
        if verb == "LOGOUT":
            break
        if verb == "STARTTLS" and status:
            out["starts"] = (c.at, s.at)
            break


def dialogue_of(rng, protocol):
    """Both sides of a dialogue in which anything may be missing, refused or out of step."""
    lines = {"SMTP": (["EHLO c", "DATA", "DATA", "data x", "BDAT 3", "BDAT 12 LAST", "BDAT", "AUTH LOGIN", "AUTH PLAIN eA==", "*", ".", ".", "", " x", "body", "QUIT", "STARTTLS", "RSET", "\x16\x03"],
                      ["250 ok", "250-a", "354 go", "354 go", "334 x", "334 ", "235 in", "220 go", "503 no", "", "\x17\x03x"]),
             "POP3": (["CAPA", "LIST", "LIST 1", "UIDL", "RETR 1", "TOP 1 1", "AUTH", "AUTH PLAIN", "AUTH  x", "USER u", "PASS p", "APOP u x", "STLS", "QUIT", "NOOP", "", "*"],
                      ["+OK", "+OK x", "-ERR", ".", ".", "..", "+ ", "+", "line", "STLS", ""]),
             "IMAP": (["a NOOP", "b LOGIN u p", "a LOGIN {3}", "b APPEND x {300+}", "c APPEND {2}", "a AUTHENTICATE PLAIN", "a AUTHENTICATE PLAIN eA==", "x", "c LOGOUT", "b STARTTLS", "", "c FETCH {0}", "lit"],
                      ["* x", "+ go", "+", "a OK x", "b OK x", "c OK x", "a NO", "b BAD {4}", "* y {12}", "* z {0}", "c OK {900}", "txt", "\x15\x03"])}[protocol]

    if protocol == "IMAP":  # a response to a challenge that announces a literal is read with it, which the plain reader does not do
        left_out = rng.choice(["AUTHENTICATE", "{"])
        lines = [x for x in lines[0] if left_out not in x], lines[1]

    def side(pool, begin, most):
        out = begin
        for _ in range(rng.randint(0, most)):
            out += rng.choice(pool) + rng.choice(["\r\n"] * 8 + ["\n", ""] + ["x" * 9])
        return out

    hello = {"SMTP": "220 x\r\n", "POP3": "+OK x\r\n", "IMAP": "* OK x\r\n"}[protocol]
    return side(lines[0], "", 14), side(lines[1], hello, 14)


def random_flows():
    rng = random.Random(11)
    flows = []
    for k in range(900):
        protocol = rng.choice(["SMTP", "SMTP", "POP3", "IMAP"])
        c, s = dialogue_of(rng, protocol)
        if protocol == "SMTP" and k % 9 == 0:
            c, s = "EHLO c\r\nRSET\r\n" + c, ""
        flows.append((f"{protocol} {k}", {"SMTP": 25, "POP3": 110, "IMAP": 143}[protocol], c.encode("latin-1"), s.encode("latin-1")))
    return flows


REPLAYS = {
    "r smtp": (25, crlf("EHLO c", "AUTH LOGIN", b64("ann"), b64("pw"), "DATA", "private", ".", "STARTTLS", "RSET") + TLS,
               crlf("220 hi", "250-x", "250 STARTTLS", "334 u", "334 p", "235 in", "354 go", "250 kept", "220 go") + TLS),
    "r imap": (143, crlf("a1 LOGIN u p", "a2 FETCH 1", "a3 AUTHENTICATE PLAIN", b64("x")), crlf("* OK hi", "a1 OK", *[f"* {k}" for k in range(6)], "* 7 FETCH {3}") + b"abc" + crlf(")", "a2 OK", "+ ", "a3 NO")),
    "r pop": (110, crlf("PASS pw", "RETR 1"), crlf("+OK hi", "+OK in", "+OK message", "x", ".")),
}


@pytest.fixture(scope="module")
def everything(spark):
    """Every dialogue of this module in one reading, staged."""
    return read(spark, hand_made() + random_flows() + [(k, *v) for k, v in REPLAYS.items()])


@pytest.fixture(scope="module")
def hand(everything):
    return {r["flow_id"]: r for r in sessions.facts(everything).collect()}


def test_random_dialogues_equal_a_plain_reader(hand):
    got, wrong = {k: r for k, r in hand.items() if k[0] in "SPI" and k[-1].isdigit()}, []
    for name, _, c, s in random_flows():
        out = {"commands": [], "auth": [], "bytes": 0, "starts": None}
        {"S": plain_smtp, "P": plain_pop3, "I": plain_imap}[name[0]](Side(c.decode("latin-1")), Side(s.decode("latin-1")), out)
        r = got.get(name)
        if re.match(rb"[\x14-\x17]\x03", c) or r is None:  # encrypted from the first byte
            continue
        mine = (r.cleartext_commands, [a.accepted for a in r.auth_events], r.cleartext_message_bytes, r.starttls_accepted)
        if mine != (out["commands"], out["auth"], out["bytes"], out["starts"] is not None):
            wrong.append((name, c, s, mine, out))
    assert len(got) > 850 and not wrong, (len(wrong), wrong[:2])


@pytest.fixture(scope="module")
def replays(everything):
    rows = transcript.entries(everything, everything.asked, everything.moved).where("flow_id LIKE 'r %'")
    return cut_lineage(rows)


def test_transcript_tiles_both_streams_and_hides_secrets(spark, replays):
    _, c, s = REPLAYS["r smtp"]
    rows = replays.where("flow_id = 'r smtp'")
    got = [(r.dir, r.kind, r.text) for r in rows.orderBy("ordinal").collect()]
    assert got == [("S", "banner", "220 hi"), ("C", "cmd", "EHLO c"), ("S", "caps", "250 x"), ("C", "auth", "AUTH LOGIN"), ("S", "reply", "334 u"), ("C", "auth", "[secret]"), ("S", "reply", "334 p"), ("C", "auth", "[secret]"),
                   ("S", "reply", "235 in"), ("C", "cmd", "DATA"), ("S", "reply", "354 go"), ("C", "data", "[message: 12 bytes, not kept]"), ("S", "reply", "250 kept"), ("C", "starttls", "STARTTLS"), ("S", "starttls", "220 go"),
                   ("C", "inject", "RSET (6 bytes of cleartext before TLS)")]
    for side, text in (("C", c), ("S", s)):
        mine = [(r.lo, r.hi) for r in rows.where(f"dir = '{side}'").orderBy("ordinal").collect()]
        assert mine[0][0] == 0 and all(a[1] == b[0] for a, b in zip(mine, mine[1:])) and mine[-1][1] == text.index(TLS)
    spans = spark.createDataFrame([("r smtp", "C", k * 5, 5, 100 + k) for k in range(20)] + [("r smtp", "S", 0, 1000, 9)], "flow_id string, dir string, span_off long, span_len long, frame long")
    found = {(r.ordinal, r.dir, r.frame) for r in transcript.frames(rows, spans, 16).collect()}
    want = {(r.ordinal, r.dir, f) for r in rows.collect() for f, a, b in ([(100 + k, k * 5, k * 5 + 5) for k in range(20)] if r.dir == "C" else [(9, 0, 1000)]) if a < r.hi and b > r.lo}
    assert found == want


def test_transcript_of_imap_and_pop3(replays):
    rows = replays.where("flow_id = 'r imap'")
    assert [(r.dir, r.text) for r in rows.orderBy("ordinal").collect()] == [("S", "* OK hi"), ("C", "a1 LOGIN u [secret]"), ("S", "a1 OK"), ("C", "a2 FETCH 1"), ("S", "* 0"), ("S", "* 1"), ("S", "* 2"), ("S", "* 3"), ("S", "a2 OK"),
                                                                            ("C", "a3 AUTHENTICATE PLAIN"), ("S", "+ "), ("C", "[secret]"), ("S", "a3 NO")]
    rows = replays.where("flow_id = 'r pop'")
    assert [(r.dir, r.kind, r.text) for r in rows.orderBy("ordinal").collect()] == [("S", "banner", "+OK hi"), ("C", "auth", "PASS [secret]"), ("S", "reply", "+OK in"), ("C", "cmd", "RETR 1"),
                                                                                    ("S", "data", "+OK message  [message: 6 bytes, not kept]")]
