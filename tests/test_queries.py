"""Registered queries beside their SQL. QUERIES=all runs every one; the default is a spread."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import connect, difference

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
SPREAD = (
    "message_faults",
    "canonical_events",
    "label_arrivals",
    "event_timeline",
    "feature_table_stream",
    "rule_flags",
    "rules_report_by_window",
    "quantiles_three_ways",
    "equal_mass_bins",
    "decide_expected_loss",
    "decide_many_settings",
    "case_view",
    "encoded_inputs",
    "stream_decisions",
)
NAMES = list(entry.queries()) if os.environ.get("QUERIES") == "all" else SPREAD


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_a_name_in_one_module_only():
    from checks import ALL

    names = [n for module in ALL for n in module.QUERIES]
    assert len(names) == len(set(names))
    assert set(names) <= set(entry.queries())  # the optional llm queries come on top
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    verdict = difference(spark, duck, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert verdict.startswith(("ok", "rows-only")), verdict


def test_entry(spark):
    df = entry.entry(spark)
    assert {"split", "loss_total", "pr_auc"} <= set(df.columns) and df.count() >= 1
