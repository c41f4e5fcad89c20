"""Dialogues short enough for one row: as in chunks, but dealt to tasks once."""

import random

import pytest

from mailveil.operators import dialogue, imap, smtp
from mailveil.plans import catalog, views

KEYS = ["s"]
FOLDER = "/root/testdata/sf0.001"


def lines_of(spark, texts, whole):
    df = spark.createDataFrame(list(enumerate(texts)), "s long, text string")
    return dialogue.stream_lines(dialogue.cut_text(df, KEYS, 7), KEYS, whole=whole)


def told(df):
    return sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


def exchanges(df):
    """Times that rows move between tasks, a broadcast included."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange " in line and "Reused" not in line for line in plan.splitlines())


@pytest.fixture
def unbroadcast(spark):
    """Joins as large tables have them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_whole_lines_equal_lines_in_chunks(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \r\n\n") for _ in range(rng.randrange(60))) for _ in range(80)] + ["\n", "\r\n\r\r\n", "x", "a\r"]
    whole, chunked = lines_of(spark, texts, True), lines_of(spark, texts, False)
    assert told(whole) == told(chunked) and [f.dataType for f in whole.select(*chunked.columns).schema][1:3] == [f.dataType for f in chunked.schema][1:3]


def test_imap_pairs_of_whole_dialogues(spark):
    rng = random.Random(6)
    said = ["".join(rng.choice(["a1 NOOP\r\n", "a2 LOGIN u \"p w\"\r\n", "junk\r\n", "a1\r\n", "\r\n", "a2 select x"]) for _ in range(rng.randrange(9))) for _ in range(60)]
    answered = ["".join(rng.choice(["* OK hi\r\n", "a1 OK done\r\n", "a2 NO\r\n", "+ go\r\n", "a2 OK x\r\n", "\r\n"]) for _ in range(rng.randrange(9))) for _ in range(60)]
    pairs = [imap.commands(lines_of(spark, said, w).where("complete"), lines_of(spark, answered, w).where("complete"), KEYS, w) for w in (True, False)]
    assert told(pairs[0]) == told(pairs[1]) and set(pairs[0].columns) == set(pairs[1].columns)


def test_long_dialogues_go_in_chunks(spark, monkeypatch):
    """A dialogue over the limit is read in chunks and lost nowhere."""
    want = told(catalog.imap_commands(spark, FOLDER))
    least, most = views.view(spark, FOLDER, "v_imap").selectExpr("min(length(server_text))", "max(length(server_text))").first()
    assert least < most
    monkeypatch.setattr(dialogue, "SHORT_CHARS", least)
    assert told(catalog.imap_commands(spark, FOLDER)) == want


def test_imap_dialogues_move_once(spark, unbroadcast):
    assert exchanges(catalog.imap_commands(spark, FOLDER)) == 2 and exchanges(catalog.imap_login_events(spark, FOLDER)) == 2


def test_smtp_events_of_whole_dialogues(spark):
    """Refused and accepted DATA, bodies that hold commands, SASL answers, replies that are missing: one fold equals the rounds."""
    rng = random.Random(7)
    client = ["EHLO c", "helo c", "DATA", "data x", ".", "body", "", " x", "AUTH LOGIN", "AUTH PLAIN eA==", "dXNlcg==", "STARTTLS", "RSET"]
    server = ["220 hi", "250-mx", "250-STARTTLS", "250 XXXXXXXX", "354 go", "354 go", "334 VXNlcm5hbWU6", "235 ok", "503 no", "junk", "454 later"]
    said = ["".join(rng.choice(client) + "\r\n" for _ in range(rng.randrange(14))) for _ in range(150)]
    answered = ["".join(rng.choice(server) + "\r\n" for _ in range(rng.randrange(12))) for _ in range(150)]
    found = []
    for whole in (True, False):
        heard = lines_of(spark, answered, whole).where("complete")
        rows = smtp.events(lines_of(spark, said, whole).where("complete"), dialogue.smtp_replies(heard, KEYS, not whole), KEYS, whole).cache()
        found.append([told(rows), told(smtp.auth_events(rows, KEYS)), told(smtp.sessions(rows, heard, KEYS, whole)), set(rows.columns)])
    assert found[0] == found[1] and len(found[0][0]) > 500 and found[0][1]


def test_smtp_dialogues_move_once(spark, unbroadcast):
    """Both sides once; capabilities read the server's lines again."""
    for query, most in ((catalog.smtp_events, 2), (catalog.smtp_auth_events, 2), (catalog.smtp_sessions, 3)):
        assert exchanges(query(spark, FOLDER)) <= most
