"""A cross-section of registered queries beside their SQL on the smallest folder."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
import check_oracle  # noqa: E402

import __spark_entry__ as entrypoint  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["rules_transport", "baseline_deviations", "stream_statistics", "redacted_lines", "handshake_labels", "history_unlearned"])
def test_query_equals_sql(spark, name):
    text, _, ok = check_oracle.compare(spark, check_oracle.connect(FOLDER), FOLDER, name, entrypoint.queries()[name], entrypoint.oracle_sql()[name])
    assert ok, text


def test_every_sql_has_a_query():
    from oracles import all_sql
    assert set(all_sql()) <= set(entrypoint.queries())
