"""Catalogue queries against SQL on the smallest tables; ``python check.py`` runs all of them."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
import check

SF = "/root/testdata/sf0.001"
SAMPLE = ["scan_log_dir", "parse_nginx_strict", "parse_syslog_5424", "detect_all", "detect_all_classic",
          "sliding_count", "report_summary_classic", "campaigns_with_gap", "sink_text_report", "alert_outbox",
          "stream_sliding_count", "scale_features", "build_prompts"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for table in check.TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, con, name):
    ok, note = check.compare(spark, con, name, SF)
    assert ok, note


def test_entry(spark):
    rows = {(r.section, r.name): r.value for r in contract.entry(spark).collect()}
    assert rows["totals", "lines_processed"] == 1000 and rows["totals", "threats"] > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
