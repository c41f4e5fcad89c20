"""Steps of the analysis that must not deal its wide rows again."""

from mailveil.operators import rules
from mailveil.plans.corpus import Analysis

FOLDER = "/root/testdata/sf0.001"


def test_greetings_do_not_move_wide_rows(spark):
    """Wide rows meet the answer by session, and the flags are those of a plain search."""
    rows = [("c", 1, "e", "HELO"), ("c", 2, "e", "EHLO"), ("c", 3, "f", "HELO"), ("d", 4, "e", "HELO"), ("c", 5, "e", None), ("c", 6, None, "HELO"), ("c", 7, None, "EHLO"), ("c", 8, "e", "HELO")]
    sessions = spark.createDataFrame(rows, "capture_id string, session_id long, endpoint string, greeting_verb string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for told in (sessions, None):
            out = rules.mark_ehlo_elsewhere(sessions.selectExpr("*", "repeat('x', 9) as wide"), told)
            assert {r.session_id: r.ehlo_elsewhere for r in out.collect()} == {k: k in (1, 8) for k in range(1, 9)}
            joins = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "LeftOuter" in line]
            assert joins and all("session_id" in line for line in joins)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rules_are_evaluated_once(spark):
    """Baselines and escalation read the findings; both would evaluate every rule if they were no stage."""
    assert all("/stage-" in name for name in Analysis(spark, FOLDER, staged=True).findings.inputFiles())
