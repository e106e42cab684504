"""What queries do once, however many detectors read it."""

import pytest
from pyspark.sql import functions as F

from threatlens import session
from threatlens.operators import respond
from threatlens.plans import queries as catalogue
from threatlens.sources import windows

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["detect_all_classic", "filter_threats", "alert_outbox", "campaigns_with_gap", "sort_types",
                                  "block_decisions", "union_distinct_ips", "first_block", "filter_blockable"])
def test_detectors_read_parsed_entries(spark, name):
    text = plan(catalogue.QUERIES[name](spark, SF))
    assert "events.parquet" not in text             # lines are parsed before, once


def test_listed_blocks_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Spark takes a table of files for as small as its files, whatever is exploded from it."""
    monkeypatch.setattr(respond, "CROWD", 3)
    rows = [(i, "1.1.1.1" if i % 2 else f"2.2.2.{i % 5}", i * 600) for i in range(200)]
    entries = spark.createDataFrame(rows, "id long, ip string, s long").select("id", "ip", F.timestamp_seconds("s").alias("ts"))
    spark.createDataFrame([("1.1.1.1", 20_000, 30_000), ("2.2.2.4", 0, 0), ("1.1.1.1", 60_000, 9_000)], "ip string, s long, duration int") \
        .select("ip", F.timestamp_seconds("s").alias("blocked_at"), "duration").write.parquet(str(tmp_path / "blocks"))
    found = respond.blocked_entries(entries, spark.read.parquet(str(tmp_path / "blocks")))
    expected = sorted(i for i, ip, s in rows if ip == "2.2.2.4" or ip == "1.1.1.1" and (20_000 <= s < 50_000 or 60_000 <= s < 69_000))
    assert sorted(r.id for r in found.collect()) == expected and len(expected) > 40
    joins = [line for line in plan(found).splitlines() if "blocked_at" in line and "Join" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_block_numbers_are_counted_in_short_slices(spark, tmp_path, monkeypatch):
    """Blocks of many lengths that span slices; later values of a key win."""
    monkeypatch.setattr(windows, "SLICE", 4)
    lines = []
    for i in range(60):
        lines += [f"Event ID: {i}", "Level: Error", *[f"note {n}" for n in range(i % 9)], f"Description: d{i}", f"Level: L{i}"]
    (tmp_path / "a.txt").write_text("\n".join(["before", *lines]))
    events = windows.scan_blocks(spark, str(tmp_path / "a.txt"))
    assert sorted((r.event_id, r.level, r.message) for r in events.collect() if r.level != "INFORMATION") == [
        (i, f"L{i}", f"d{i}") for i in range(60)]
    text = plan(events)
    assert "slice" in text[text.index("Window"):]       # no window over a whole split


def test_drops_have_a_file_per_core(spark, monkeypatch):
    paths = []
    fresh = session.fresh_path
    monkeypatch.setattr(session, "fresh_path", lambda spark, name: paths.append(fresh(spark, name)) or paths[-1])
    catalogue._in_drops(spark, SF, lambda events: None, n=1)
    assert len(spark.read.parquet(paths[0]).inputFiles()) == spark.sparkContext.defaultParallelism
