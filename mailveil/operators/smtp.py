"""The SMTP dialogue as joins and ordered scans over line and reply rows.

Every client line outside a message body takes one reply, and so does the '.' that ends a
body. Counting those lines gives each its reply number; the reply then tells whether a DATA
was accepted and whether the next line answers a SASL challenge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailveil.functions import text as tx
from mailveil.operators import dialogue
from mailveil.operators.ordered import preceding
from mailveil.session import cut_lineage

PART = "_part"


def _verb():
    return F.upper(F.split_part("line", F.lit(" "), F.lit(1)))


def _turns(lines: DataFrame, replies: DataFrame, refused: DataFrame | None, keys: list[str]) -> DataFrame:
    """Lines with body state, reply number and reply, given the DATA commands known as refused."""
    order = ["line_no"]
    rows = lines.withColumns({PART: F.floor(F.col("line_no") / dialogue.LINES_PER_PART).cast("bigint"), "verb": _verb()})
    if refused is None:
        rows = rows.withColumn("_refused", F.lit(False))
    else:
        rows = rows.join(refused.select(*keys, "line_no", F.lit(True).alias("_refused")), [*keys, "line_no"], "left") \
            .withColumn("_refused", F.coalesce("_refused", F.lit(False)))
    marker = F.when((F.col("verb") == "DATA") & ~F.col("_refused"), "open").when(F.col("line") == ".", "close")
    rows = preceding(rows, keys, order, PART, last={"_mark": marker})
    rows = rows.withColumn("in_body", F.coalesce(F.col("_mark") == "open", F.lit(False)))
    takes = F.when(F.col("in_body"), F.col("line") == ".").otherwise(F.col("verb") != "")
    rows = preceding(rows.withColumn("takes", takes), keys, order, PART, sums={"_before": F.col("takes").cast("int")})
    numbered = rows.withColumn("reply_no", F.when(F.col("takes"), F.col("_before") + 1).cast("bigint"))
    return numbered.join(replies.select(*keys, "reply_no", "code", "reply"), [*keys, "reply_no"], "left").drop("_mark", "_before")


def _folded(lines: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """Lines with body state, reply number, reply and the reply before it, by one fold over each session's lines.

    Replies are numbered from 0 without gaps, as ``reply_lines`` numbers them. The fold keeps what a line cannot tell alone:
    how many lines took a reply before it, and whether it lies in a body.
    """
    told = replies.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("reply_no", "code", "reply"))).alias("_told"))
    carried = [c for c in lines.columns if c not in keys and c != "line_no"]
    said = lines.withColumn("verb", _verb()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", *carried, "verb"))).alias("_said"))

    def step(at: Column, line: Column) -> Column:
        dot = line["line"] == "."
        takes = F.when(at["body"], dot).otherwise(line["verb"] != "")
        accepted = F.when(line["verb"] == "DATA", F.coalesce(F.get("_told", at["n"] + 1)["code"] == 354, F.lit(True))).otherwise(False)
        return F.struct((at["n"] + takes.cast("int")).alias("n"), F.when(at["body"], ~dot).otherwise(accepted).alias("body"),
                        F.concat(at["places"], F.array(F.struct(at["n"].alias("n"), at["body"].alias("body"), takes.alias("takes")))).alias("places"))

    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("body"), F.array().cast("array<struct<n:int,body:boolean,takes:boolean>>").alias("places"))
    placed = said.join(told, keys, "left").withColumn("_places", F.aggregate("_said", start, step, lambda at: at["places"]))
    rows = F.zip_with("_said", "_places", lambda line, at: F.struct(
        line.alias("line"), at.alias("at"), F.when(at["takes"], F.get("_told", at["n"] + 1)).alias("answer"),
        F.when(at["n"] > 0, F.coalesce(F.get("_told", at["n"])["code"], F.lit(0))).alias("prev")))
    return placed.select(*keys, F.explode(rows).alias("_r")).select(
        *keys, F.when(F.col("_r.at.takes"), F.col("_r.at.n") + 1).cast("bigint").alias("reply_no"), "_r.line.*", F.col("_r.at.body").alias("in_body"),
        F.col("_r.at.takes").alias("takes"), F.col("_r.answer.code").alias("code"), F.col("_r.answer.reply").alias("reply"), F.col("_r.prev").alias("_prev"))


def _settled(lines: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``_folded`` for sessions of any length, by ordered scans.

    A refused DATA opens no body, which moves every later line to another reply. Refusals are
    settled one per session and round, until none is left; a round reads only those sessions.
    """
    settled, refused, pending = None, None, lines
    while True:
        rows = cut_lineage(_turns(pending, replies, refused, keys))
        wrong = rows.where((F.col("verb") == "DATA") & ~F.col("in_body") & ~F.col("_refused") & (F.col("code") != 354))
        firsts = cut_lineage(wrong.groupBy(*keys).agg(F.min("line_no").alias("line_no")))
        done = rows.join(firsts.select(*keys), keys, "left_anti")
        settled = done if settled is None else settled.unionByName(done)
        if firsts.isEmpty():
            break
        pending = pending.join(firsts.select(*keys), keys, "left_semi")
        refused = firsts if refused is None else refused.unionByName(firsts)
    return preceding(settled, keys, ["line_no"], PART, last={"_prev": F.when(F.col("takes"), F.coalesce("code", F.lit(0)))}).drop("_refused")


def events(lines: DataFrame, replies: DataFrame, keys: list[str], whole: bool = False) -> DataFrame:
    """Client lines as events: command, auth response, body, end of body.

    ``whole`` says that every stream was short enough to be read as one row.
    """
    coded = _folded(lines, replies, keys) if whole else _settled(lines, replies, keys)
    answers = ~F.col("in_body") & F.coalesce(F.col("_prev") == 334, F.lit(False))
    kind = (F.when(F.col("in_body"), F.when(F.col("line") == ".", "body-end").otherwise("body"))
            .when(answers, "auth-response").when(F.col("verb") != "", "command"))
    out = coded.withColumn("kind", kind)
    is_auth = (F.col("kind") == "command") & (F.col("verb") == "AUTH")
    out = preceding(out, keys, ["line_no"], None if whole else PART, last={"_auth": F.when(is_auth, F.col("line_no"))})
    return out.withColumn("auth_no", F.when(is_auth, F.col("line_no")).when(F.col("kind") == "auth-response", F.col("_auth"))) \
        .drop("_auth", "_prev", "takes", PART)


def auth_events(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per AUTH command, its responses decoded and the secret dropped at once."""
    start = F.col("kind") == "command"
    words = F.split("line", " ", 3)
    response = F.when(start, F.get(words, F.lit(2))).otherwise(F.col("line"))
    per = rows.where("auth_no IS NOT NULL").withColumn("_response", response).groupBy(*keys, "auth_no").agg(
        F.max(F.when(start, F.get(words, F.lit(1)))).alias("mechanism"),
        F.array_sort(F.collect_list(F.when(F.col("_response").isNotNull(), F.struct("line_no", "_response")))).alias("_given"),
        F.max_by(F.col("code") == 235, "line_no").alias("accepted"))
    given = F.transform("_given", lambda g: g["_response"])
    return per.select(*keys, tx.sasl_event(F.col("mechanism"), given, F.col("accepted")).alias("event")).select(*keys, "event.*")


def _body_size(eol: int = 2) -> Column:
    return F.when(F.col("kind") == "body-end", F.lit(1 + eol)).otherwise(F.length("line") + eol)


def message_bytes(rows: DataFrame, keys: list[str], eol: int = 2) -> DataFrame:
    """Bytes of message bodies outside TLS, terminator included."""
    return rows.where("in_body").groupBy(*keys).agg(F.sum(_body_size(eol)).cast("bigint").alias("message_bytes"))


def sessions(rows: DataFrame, server_lines: DataFrame, keys: list[str], whole: bool = False) -> DataFrame:
    """Greeting, capabilities, upgrade state and indicators of every session.

    ``whole`` says that every stream was short enough to be read as one row.
    """
    command = F.col("kind") == "command"
    greeted = command & F.col("verb").isin("EHLO", "HELO")
    listing = command & (F.col("verb") == "EHLO") & (F.col("code") == 250)
    per = rows.groupBy(*keys).agg(
        F.count_if(command).alias("commands"), F.min_by("verb", F.when(greeted, F.col("line_no"))).alias("greeting_verb"),
        F.max_by("reply_no", F.when(listing, F.col("line_no"))).alias("reply_no"),
        F.min_by(F.struct("code", "reply"), F.when(command & (F.col("verb") == "STARTTLS"), F.col("line_no"))).alias("u"),
        F.sum(F.when(F.col("in_body"), _body_size())).cast("bigint").alias("message_bytes"))
    told = dialogue.reply_lines(server_lines, keys, not whole).withColumn("reply_no", F.col("reply_no").cast("bigint"))
    if not whole:   # a reply may be long there: only the one that answers the greeting is gathered
        per = cut_lineage(per)
        told = told.join(per.select(*keys, "reply_no"), [*keys, "reply_no"], "left_semi")
    rest = F.struct("reply_no", "line_no", F.substring(F.col("line"), F.lit(5), F.length("line")).alias("rest"))
    listed = told.groupBy(*keys).agg(F.array_sort(F.collect_list(rest)).alias("_told"))
    caps = F.filter("_told", lambda r: r["reply_no"] == F.col("reply_no"))
    tokens = F.transform(F.slice("_caps", 2, F.greatest(F.size("_caps") - 1, F.lit(0))), lambda x: x["rest"])
    smtp = F.lit("SMTP")
    out = (per.join(listed, keys, "left").withColumn("_caps", caps)
           .withColumn("capabilities", F.when(F.size("_caps") > 0, dialogue.capabilities(tokens))))
    requested = F.col("u").isNotNull()
    refusal = F.array_compact(F.array(dialogue.refusal_indicator(smtp, requested, F.col("u.code"), F.col("u.reply"))))
    mangled = F.coalesce(dialogue.mangled_indicators(F.col("capabilities"), smtp), F.array().cast("array<string>"))
    return out.select(*keys, "commands", "greeting_verb", "capabilities",
                      dialogue.upgrade_offered(F.col("capabilities"), smtp).alias("starttls_offered"), requested.alias("starttls_requested"),
                      F.coalesce(F.col("u.code") == 220, F.lit(False)).alias("starttls_accepted"),
                      F.coalesce("message_bytes", F.lit(0)).alias("message_bytes"), F.concat(mangled, refusal).alias("strip_indicators"))
