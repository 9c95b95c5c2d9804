"""A cross-section of registered queries against their SQL at the smallest scale."""

import duckdb
import pytest
from check_sql import TABLES, compare

import __spark_entry__ as entry

PICKED = ["flt_cidr", "join_rule_match", "rule_count", "join_ioc", "score_risk", "alert_windows", "alert_assemble", "alert_notify_rate",
          "norm_cef_map", "norm_leef_map", "norm_json_map", "norm_syslog_5424", "norm_timestamp", "join_geoip", "join_baseline_asof",
          "win_unique_dst_5m", "win_failed_auth_5m", "feat_beacon", "comp_certin_counts", "audit_chain_build", "audit_chain_verify",
          "st_brute_force", "st_brute_force_expiring", "st_rate_limit", "sink_archive_parquet", "st_stream_join", "rule_catalog"]


@pytest.fixture(scope="module")
def con(root):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", PICKED)
def test_query_matches_sql(spark, con, root, name):
    ok, note = compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], root)
    assert ok, note


def test_every_query_has_sql_and_entry_runs(spark):
    assert set(entry.QUERIES) == set(entry.SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
