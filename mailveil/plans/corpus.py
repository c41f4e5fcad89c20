"""The analysis steps wired together over the derivation views.

``Analysis`` holds one lazy DataFrame per step. Steps that several later steps read
are written once to the checkpoint folder when ``staged`` is set, so a fan-out never
recomputes the joins below it and a lost executor restarts from the stage, not the scan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailveil import dims
from mailveil.operators import baseline, certificates, dialogue, features, flows, packets, rules, scoring
from mailveil.plans import views
from mailveil.session import cut_lineage

AS_OF = 946684800  # epoch seconds used to date CA certificates in reports


class Analysis:
    def __init__(self, spark: SparkSession, folder: str, staged: bool = False):
        self.spark, self.folder, self.staged = spark, folder, staged

    def _stage(self, df: DataFrame) -> DataFrame:
        return cut_lineage(df) if self.staged else df

    # ------------------------------------------------------------------ inputs
    @cached_property
    def sessions(self) -> DataFrame:
        return views.sessions(self.spark, self.folder)

    @cached_property
    def handshakes(self) -> DataFrame:
        return views.handshakes(self.spark, self.folder)

    @cached_property
    def certificates(self) -> DataFrame:
        return views.certificates(self.spark, self.folder)

    @cached_property
    def trust_anchors(self) -> DataFrame:
        issuing = views.table(self.spark, self.folder, "supplier").select(
            F.concat(F.lit("O=Trust,CN=Issuing CA "), F.col("s_suppkey") % 5).alias("subject")).distinct()
        root = views.table(self.spark, self.folder, "region").select(F.lit("CN=Root CA,O=Trust").alias("subject")).distinct()
        return issuing.union(root)

    @cached_property
    def assets(self) -> DataFrame:
        """Asset weights by address, endpoint, name and default."""
        nation = views.table(self.spark, self.folder, "nation")
        n = F.col("n_nationkey")
        by_ip = nation.select(F.concat(F.lit("10.1.0."), n * 2 + 1).alias("asset"), (1.0 + n / 50).alias("weight"))
        by_key = nation.select(F.concat(F.lit("93.184.216."), n, F.lit(":25")).alias("asset"), F.lit(1.5).alias("weight"))
        by_name = nation.where(n < 5).select(F.concat(F.lit("mx"), n, F.lit(".example.org")).alias("asset"),
                                             F.lit(1.25).alias("weight"))
        rest = nation.where(n == 0).select(F.lit("default").alias("asset"), F.lit(0.9).alias("weight"))
        return by_ip.union(by_key).union(by_name).union(rest)

    @cached_property
    def captures(self) -> DataFrame:
        """All captures under analysis, also those without a mail session."""
        return views.table(self.spark, self.folder, "supplier").select(
            F.concat(F.lit("cap"), F.col("s_suppkey") % 23).alias("capture_id")).distinct()

    # ------------------------------------------------------------------ steps
    @cached_property
    def chains(self) -> DataFrame:
        return certificates.chains(self.sessions, self.handshakes, self.certificates, self.trust_anchors)

    @cached_property
    def facts(self) -> DataFrame:
        wide = rules.session_facts(self.sessions, self.handshakes, self.chains)
        return self._stage(rules.mark_ehlo_elsewhere(wide, self.sessions))

    @cached_property
    def findings(self) -> DataFrame:
        return self._stage(rules.evaluate(self.facts))

    @cached_property
    def scored(self) -> DataFrame:
        return scoring.score_findings(self.all_findings, self.sessions, self.assets)

    @cached_property
    def observations(self) -> DataFrame:
        return self._stage(baseline.observe(self.facts, self.findings))

    @cached_property
    def deviations(self) -> DataFrame:
        return self._stage(baseline.deviations(self.observations))

    @cached_property
    def all_findings(self) -> DataFrame:
        """Rule findings after escalation, plus the baseline's own findings."""
        raised = baseline.escalate(self.findings, self.deviations)
        own = baseline.as_findings(self.deviations, self.sessions)
        return self._stage(raised.unionByName(own.withColumn("escalated_from", F.lit(None).cast("string"))))

    @cached_property
    def features(self) -> DataFrame:
        return features.features(self.facts, baseline.deviation_codes(self.deviations))

    @cached_property
    def ranked(self) -> DataFrame:
        return scoring.prioritise(self.scored)

    @cached_property
    def posture(self) -> DataFrame:
        return scoring.posture(self.captures, scoring.capture_flags(self.facts), self.all_findings)


def history_and_current(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Observation rows split into stored history and the captures under analysis."""
    rows = views.view(spark, folder, "v_observations").withColumn("strip_indicators", views.words("strip_text", "\\|"))
    return rows.where("capture_id = 'stored'"), rows.where("capture_id <> 'stored'")


class Streams:
    """Segments to streams for one corpus, with the fan-out points staged."""

    def __init__(self, spark: SparkSession, folder: str, staged: bool = False, chunk_bytes: int = flows.CHUNK_BYTES):
        self.spark, self.folder, self.staged, self.chunk_bytes = spark, folder, staged, chunk_bytes

    def _stage(self, df: DataFrame) -> DataFrame:
        return cut_lineage(df) if self.staged else df

    @cached_property
    def segments(self) -> DataFrame:
        return views.view(self.spark, self.folder, "v_segments")

    @cached_property
    def conversations(self) -> DataFrame:
        """Every segment with its conversation, place in the stream and contribution."""
        return self._stage(flows.trace(self.segments))

    @cached_property
    def roles(self) -> DataFrame:
        return flows.roles_of(self.conversations)

    @cached_property
    def placed(self) -> DataFrame:
        return flows.placed_of(self.conversations)

    @cached_property
    def contributions(self) -> DataFrame:
        return flows.contributions_of(self.conversations)

    @cached_property
    def spans(self) -> DataFrame:
        return flows.spans(self.contributions)

    @cached_property
    def streams(self) -> DataFrame:
        return flows.assemble(self.contributions, self.placed, chunk_bytes=self.chunk_bytes)

    @cached_property
    def conflicts(self) -> DataFrame:
        return flows.conflicts(self.placed, self.contributions, self.streams, chunk_bytes=self.chunk_bytes)

    @cached_property
    def stats(self) -> DataFrame:
        return flows.stats_of(self.conversations, self.conflicts)

    @cached_property
    def flows(self) -> DataFrame:
        return self._stage(flows.flows_of(self.conversations, self.conflicts))

    @cached_property
    def mail_flows(self) -> DataFrame:
        """Flows whose server side is a mail port, one-sided and short ones included."""
        return self.flows.where(F.col("server.port").isin(25, 110, 143))

    @cached_property
    def numbered(self) -> DataFrame:
        return flows.number_sessions(self.mail_flows)

    @cached_property
    def text_chunks(self) -> DataFrame:
        return self._stage(dialogue.as_text(self.streams))

    @cached_property
    def mail_sessions(self) -> DataFrame:
        """Numbered mail flows with the protocol and each direction's TLS offset."""
        protocol = dims.lookup({25: "SMTP", 110: "POP3", 143: "IMAP"}, F.col("server.port"))
        offsets = dialogue.tls_offsets(self.text_chunks, flows.STREAM).groupBy(*flows.FLOW).agg(
            F.max(F.when(F.col("dir") == "C", F.col("tls_off"))).alias("tls_client_off"),
            F.max(F.when(F.col("dir") == "S", F.col("tls_off"))).alias("tls_server_off"))
        return (self.numbered.select(*flows.FLOW, "session_id", protocol.alias("protocol"), "client", "server")
                .join(offsets, flows.FLOW, "left"))

    @cached_property
    def packets(self) -> DataFrame:
        part = F.floor(F.col("frame") / 4_000_000_000_000).cast("bigint")   # frame numbers are sparse here
        return packets.packet_rows(self.conversations, self.mail_sessions, self.text_chunks, self.chunk_bytes,
                                   frame_part=part)
