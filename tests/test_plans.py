"""Physical plans: what reaches the scan, and what must never appear."""

import re

import pytest

import __spark_entry__ as entry

NO_PAIRS = ["flt_cidr", "join_rule_match", "rule_count", "rule_near", "rule_backtest", "join_ioc", "join_ioc_semi", "score_risk", "join_asset", "join_geoip",
            "join_user_identity", "join_sequence", "join_baseline_asof", "agg_dashboard_cards", "agg_mitre_heatmap", "win_failed_auth_5m", "win_unique_dst_5m",
            "win_interarrival", "win_zscore_mad", "feat_beacon", "st_brute_force", "comp_certin_counts", "audit_chain_gaps", "role_permission_matrix", "alert_update"]


def plan(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def query(spark, root, name):
    return entry.queries()[name](spark, root)


@pytest.mark.parametrize("name", NO_PAIRS)
def test_no_pairing_of_all_rows(spark, root, name):
    text = plan(query(spark, root, name))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_tenant_and_time_reach_the_scan(spark, root):
    assert "PartitionFilters: [isnotnull(tenant_id" in plan(query(spark, root, "flt_tenant"))
    assert "GreaterThanOrEqual(ts" in plan(query(spark, root, "flt_time_range"))
    for name in ("flt_time_range", "flt_relative_time", "rule_fp_rate", "rule_backtest", "scan_tail"):
        assert re.search(r"PartitionFilters: \[[^\]]*event_day", plan(query(spark, root, name))), name


def test_only_needed_columns_are_read(spark, root):
    text = plan(query(spark, root, "agg_event_volume"))
    assert "raw" not in text.split("ReadSchema:")[1].splitlines()[0]


def test_all_rules_need_no_shuffle(spark, root):
    assert "Exchange" not in plan(query(spark, root, "join_rule_match"))


def test_top_k_is_cut_before_the_shuffle(spark, root):
    text = plan(query(spark, root, "ord_topk_group"))
    assert text.index("WindowGroupLimit") < text.index("Exchange") or text.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("name", ["score_risk", "join_ioc_semi"])
def test_events_without_a_hit_are_not_moved(spark, root, name):
    """Events are read in two branches; the one of events that fail the filter has no exchange and no join."""
    df = query(spark, root, name)
    text = plan(df)
    rest = text[text.index("Union"):]
    first = rest[:[m.start() for m in re.finditer("Scan parquet", rest)][0]]
    assert "Exchange" not in first and "Join" not in first and text.count("Subquery") >= 1

