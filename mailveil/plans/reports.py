"""Report queries over sessions, facts and ranked findings. Each returns a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailveil import dims
from mailveil.operators import scoring

KEYS = ["capture_id", "session_id"]
GROUP = ["capture_id", "rule_id", "endpoint", "severity"]


def finding_groups(ranked: DataFrame) -> DataFrame:
    """One row per (rule, endpoint, severity): the finding with the best priority and how many there are."""
    return ranked.groupBy(*GROUP).agg(
        F.min("priority").alias("priority"), F.min_by("title", "priority").alias("title"),
        F.min_by("session_id", "priority").alias("first_session"), F.count("*").alias("findings"),
        F.max("risk").alias("risk"))


def group_sessions(ranked: DataFrame) -> DataFrame:
    """The sessions behind each group, as rows (a group may hold most of a corpus)."""
    return ranked.select(*GROUP, "session_id", "priority")


def top_groups(groups: DataFrame, n: int = 6) -> DataFrame:
    """The first n critical or high groups of every capture."""
    order = Window.partitionBy("capture_id").orderBy("priority")
    return (groups.where(F.col("severity").isin("critical", "high"))
            .withColumn("place", F.row_number().over(order)).where(F.col("place") <= n))


def terminal_top(ranked: DataFrame, n: int = 10) -> DataFrame:
    """First finding per (rule, endpoint) without info rows, with its repeat count."""
    per = ranked.groupBy("capture_id", "rule_id", "endpoint").agg(
        F.count("*").alias("times"),
        F.min(F.when(F.col("severity") != "info", F.struct("priority", "severity", "risk", "title"))).alias("f"))
    order = Window.partitionBy("capture_id").orderBy("priority")
    rows = per.where("f IS NOT NULL").select("capture_id", "rule_id", "endpoint", "times", "f.*")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def endpoint_table(facts: DataFrame, scores: DataFrame, issues: DataFrame) -> DataFrame:
    """Per endpoint: protocols, modes, versions, sessions, grade and issues by severity."""
    def joined(col: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(col)), ", ")   # at most a handful of values

    seen = F.when(F.col("server_hello_seen"), F.col("version_name"))
    per = facts.groupBy("capture_id", "endpoint").agg(
        joined(F.col("protocol")).alias("protocols"), joined(F.col("mode")).alias("modes"), joined(seen).alias("versions"))
    by_severity = scoring.severity_counts(issues, ["capture_id", "endpoint"])
    return (scores.join(per, ["capture_id", "endpoint"]).join(by_severity, ["capture_id", "endpoint"], "left")
            .withColumns({s: F.coalesce(s, F.lit(0)) for s in dims.SEVERITIES}))


def mode_label() -> Column:
    return (F.when(F.col("mode") == "implicit", "implicit TLS").when(F.col("mode") == "starttls", "STARTTLS")
            .when(F.size("strip_indicators") > 0, "stripped").otherwise("cleartext"))


def certificate_label() -> Column:
    shown = F.coalesce(F.col("present"), F.lit(False))
    bad = F.array_join(F.array_compact(F.array(
        F.when(F.col("expired"), "expired"), F.when(F.col("self_signed"), "self-signed"),
        F.when(F.col("hostname_match") == F.lit(False), "name mismatch"),
        F.when((F.col("trusted") == F.lit(False)) & ~F.col("self_signed"), "untrusted"))), ", ")
    return (F.when(~shown, F.when(F.col("version") == 0x0304, "not visible").otherwise("none"))
            .when(bad != "", bad).when(F.col("trusted"), "valid").otherwise("unverified"))


def risk_band(risk: Column) -> Column:
    return F.when(risk >= 70, "high").when(risk >= 35, "medium").otherwise("low")


def session_table(facts: DataFrame, findings: DataFrame, risks: DataFrame) -> DataFrame:
    """Every session with its labels, worst severity, finding count and risk."""
    worst = findings.groupBy(*KEYS).agg(F.min(dims.sev_rank(F.col("severity"))).alias("rank"), F.count("*").alias("findings"))
    return (facts.select(*KEYS, "endpoint", "protocol", mode_label().alias("channel"), certificate_label().alias("certificate"),
                         F.when(F.col("server_hello_seen"), F.col("version_name")).otherwise("-").alias("version"),
                         F.coalesce("cipher_name", F.lit("-")).alias("cipher"))
            .join(worst, KEYS, "left").join(risks.select(*KEYS, F.col("rule_risk").alias("risk")), KEYS)
            .withColumns({"worst": F.coalesce(dims.sev_name(F.col("rank")), F.lit("none")),
                          "findings": F.coalesce("findings", F.lit(0)), "band": risk_band(F.col("risk"))}).drop("rank"))


def kpis(facts: DataFrame, issues: DataFrame) -> DataFrame:
    """Headline numbers of every capture."""
    base = facts.groupBy("capture_id").agg(
        F.count("*").alias("sessions"), F.count_if(F.col("server_hello_seen")).alias("used_tls"),
        F.count_if(F.exists("auth_events", lambda e: e["secret_exposed"])).alias("exposed"))
    ends = facts.select("capture_id", "endpoint").distinct().groupBy("capture_id").agg(F.count("*").alias("endpoints"))
    distinct = issues.groupBy("capture_id").agg(F.count("*").alias("issues"))
    return base.join(ends, "capture_id").join(distinct, "capture_id", "left").withColumn("issues", F.coalesce("issues", F.lit(0)))


def severity_shares(findings: DataFrame) -> DataFrame:
    """Percentage of findings per severity; the totals are joined, not windowed."""
    per = findings.groupBy("capture_id", "severity").agg(F.count("*").alias("n"))
    total = per.groupBy("capture_id").agg(F.sum("n").alias("total"))
    return per.join(total, "capture_id").select("capture_id", "severity", "n", F.round(100 * F.col("n") / F.col("total"), 2).alias("share"))


def channels(sessions: DataFrame) -> DataFrame:
    stripped = F.size("strip_indicators") > 0
    return sessions.groupBy("capture_id").agg(
        F.count_if(F.col("mode") == "implicit").alias("implicit_tls"), F.count_if(F.col("mode") == "starttls").alias("starttls"),
        F.count_if(stripped).alias("stripped"), F.count_if((F.col("mode") == "plaintext") & ~stripped).alias("cleartext"))


def protocols(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("capture_id", "protocol").agg(F.count("*").alias("sessions"))


def versions(facts: DataFrame) -> DataFrame:
    """Sessions of each version, all of them; TLS 1.3 is always shown."""
    label = F.when(F.col("server_hello_seen"), F.col("version_name")).otherwise("No TLS")
    counted = facts.groupBy("capture_id", label.alias("version_name")).agg(F.count("*").alias("sessions"))
    always = facts.select("capture_id").distinct().select("capture_id", F.lit("TLS 1.3").alias("version_name"), F.lit(0).cast("bigint").alias("sessions"))
    return (counted.unionByName(always)
            .groupBy("capture_id", "version_name").agg(F.sum("sessions").alias("sessions")))


def search_findings(findings: DataFrame, severities: list[str], text: str) -> DataFrame:
    """Findings of chosen severities whose shown text contains the words."""
    shown = F.lower(F.concat_ws(" ", "title", "rule_id", "endpoint", F.array_join("evidence", " ")))
    return findings.where(F.col("severity").isin(*severities) & shown.contains(text.lower()))


def session_detail(facts: DataFrame, findings: DataFrame, session_id, capture_id: str | None = None) -> DataFrame:
    """Everything known about one session; the filters reach the scans."""
    one = F.col("session_id") == session_id
    if capture_id is not None:
        one = one & (F.col("capture_id") == capture_id)
    rules = findings.where(one).groupBy(*KEYS).agg(F.sort_array(F.collect_list("rule_id")).alias("rules"))
    return facts.where(one).join(rules, KEYS, "left")


def capture_meta(facts: DataFrame, captures: DataFrame) -> DataFrame:
    """First and last activity and session counts of every capture."""
    per = facts.groupBy("capture_id").agg(F.min("start_ts").alias("capture_start"), F.max("end_ts").alias("capture_end"),
                                          F.count("*").alias("mail_sessions"), F.count_if(F.col("gaps") > 0).alias("with_gaps"))
    return captures.join(per, "capture_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("capture_start", "capture_end", "mail_sessions", "with_gaps")})


def corpus_rollup(posture: DataFrame) -> DataFrame:
    """How many captures were analysed, held mail, and which grades they got."""
    return posture.groupBy("grade").agg(
        F.count("*").alias("captures"), F.count_if(F.col("sessions") > 0).alias("with_mail"),
        F.sum("sessions").alias("sessions"), F.sum("critical").alias("critical"), F.sum("high").alias("high"))


def verdicts(posture: DataFrame, classes: DataFrame) -> DataFrame:
    """One line per assessed capture."""
    attacked = classes.groupBy("capture_id").agg(F.count_if(F.col("kind") == "bad").alias("attacked"))
    line = (F.when(F.col("attacked") > 0, "Active interference detected").when(F.col("critical") > 0, "Critical exposure")
            .when(F.col("grade") <= "B", "Mail transport is well protected").otherwise("Weak transport security"))
    return posture.where("assessed").join(attacked, "capture_id", "left").select(
        "capture_id", "grade", F.coalesce("attacked", F.lit(0)).alias("attacked"), line.alias("verdict"))


def caveats(posture: DataFrame, sessions: DataFrame) -> DataFrame:
    """What bounds the claims of a report: floors, one-sided sessions, missing bytes."""
    floors = posture.select("capture_id", F.explode("floor_reasons").alias("text")).withColumn("kind", F.lit("floor"))
    partial = (sessions.where("identified_by = 'client-verbs'").groupBy("capture_id").agg(F.count("*").alias("n"))
               .select("capture_id", F.concat("n", F.lit(" session(s) identified from the client's commands only")).alias("text"),
                       F.lit("partial").alias("kind")))
    missing = (sessions.where("gaps > 0").groupBy("capture_id").agg(F.count("*").alias("n"))
               .select("capture_id", F.concat("n", F.lit(" session(s) with missing bytes")).alias("text"), F.lit("read").alias("kind")))
    return floors.unionByName(partial).unionByName(missing)


def section_counts(facts: DataFrame, findings: DataFrame, certificates: DataFrame) -> DataFrame:
    """How many entries each report section holds."""
    base = facts.groupBy("capture_id").agg(F.count("*").alias("sessions"))
    ends = facts.select("capture_id", "endpoint").distinct().groupBy("capture_id").agg(F.count("*").alias("endpoints"))
    told = findings.where("severity <> 'info'").groupBy("capture_id").agg(F.count("*").alias("findings"))
    certs = certificates.select("capture_id", "sha256").distinct().groupBy("capture_id").agg(F.count("*").alias("certificates"))
    out = base.join(ends, "capture_id").join(told, "capture_id", "left").join(certs, "capture_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("findings", "certificates")})


# Which timeline events a rule family attaches to, in order of preference.
ATTACH = [
    ("STRIP|BASE-001|PLAIN-00[123]", ["strip", "caps"]), ("CRED", ["auth"]), ("DATA", ["data"]), ("INJ", ["inject"]),
    ("CERT|BASE-002", ["Certificate"]), ("TLS-006|TLS-011", ["ClientHello"]), ("TLS|BASE-00[34]", ["ServerHello"]),
    ("PORT|TCP", ["first"]),
]


def timeline(facts: DataFrame) -> DataFrame:
    """The steps of a session in order: greeting, dialogue, upgrade, TLS messages, close."""
    hello, seen = F.col("client_hello_seen"), F.coalesce("server_hello_seen", F.lit(False))
    clear = F.col("mode") != "implicit"

    def step(cond: Column, key: str) -> Column:
        return F.when(cond, F.lit(key))

    commands = F.transform("cleartext_commands", lambda c: F.when(c.isin("LOGIN", "PASS", "USER", "AUTH"), "auth")
                           .when(c.isin("DATA", "RETR", "FETCH"), "data").otherwise("cmd"))
    keys = F.array_compact(F.concat(
        F.array(step(clear, "banner"), step(clear & (F.size("capabilities") > 0), "caps"), step(F.size("strip_indicators") > 0, "strip")),
        commands,
        F.array(step(F.size("injection_indicators") > 0, "inject"), step(hello, "ClientHello"), step(seen, "ServerHello"),
                step(F.coalesce("present", F.lit(False)), "Certificate"), step(seen & (F.col("dh_bits") > 0), "ServerKeyExchange"),
                step(hello & ~seen, "alert"), step(seen, "appdata"), step(~F.col("tls_used"), "close"))))
    return facts.select(*KEYS, F.posexplode(keys).alias("pos", "key")).withColumn("step", F.col("pos") + 1).drop("pos")


def attach_findings(steps: DataFrame, findings: DataFrame) -> DataFrame:
    """Each finding beside the first step of its family, else the last step.

    Steps fold to one row per (session, event) first; findings meet them by equality.
    """
    first = steps.groupBy(*KEYS, "key").agg(F.min("step").alias("at"))
    last = steps.groupBy(*KEYS).agg(F.max("step").alias("last"))
    wanted = F.array().cast("array<string>")
    for pattern, keys in reversed(ATTACH):
        wanted = F.when(F.col("rule_id").rlike(pattern), F.array(*map(F.lit, keys))).otherwise(wanted)
    rows = findings.select(*KEYS, "rule_id", F.get(wanted, F.lit(0)).alias("key1"), F.get(wanted, F.lit(1)).alias("key2"))
    for key in ("key1", "key2"):
        side = first.select(*KEYS, F.col("key").alias(key), F.col("at").alias(f"at_{key}"))
        rows = rows.join(side, [*KEYS, key], "left")
    at = F.when(F.col("key1") == "first", 1).otherwise(F.coalesce("at_key1", "at_key2", "last"))
    return rows.join(last, KEYS, "left").select(*KEYS, "rule_id", at.alias("step"))


def flat_sessions(facts: DataFrame, features: DataFrame, findings: DataFrame, risks: DataFrame) -> DataFrame:
    """One wide row per session: provenance, crypto, certificate facts, rule ids, risk, features."""
    rules = findings.groupBy(*KEYS).agg(F.array_join(F.sort_array(F.collect_set("rule_id")), " ").alias("rule_ids"))
    named = features.select(*KEYS, *[F.col(f).alias(f"f_{f}") for f in dims.FEATURES])
    return (facts.select(*KEYS, "endpoint", "protocol", "mode", "version_name", "cipher_name", "cipher_grade",
                         F.col("leaf.key_type").alias("key_type"), F.col("leaf.key_bits").alias("key_bits"), "hostname_match", "trusted")
            .join(rules, KEYS, "left").join(risks.select(*KEYS, "rule_risk"), KEYS).join(named, KEYS)
            .withColumn("rule_ids", F.coalesce("rule_ids", F.lit(""))))
