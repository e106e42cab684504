"""Tables that streams and reports keep: closed sessions, newest rows, observed counts, address sketches."""

from datetime import datetime, timedelta, timezone

from loglines import line
from pyspark.sql import functions as F

from threatlens.operators import parsers, reports
from threatlens.streaming import counters, tail

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)
FOUND = "source_ip string, ts timestamp, threat_type string"


def drop(spark, path, rows):
    spark.createDataFrame([(ip, BASE + timedelta(minutes=m), kind) for ip, m, kind in rows], FOUND) \
        .coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(FOUND).parquet(path)


def test_closed_sessions_leave_the_state(spark, tmp_path):
    """Sessions come out once, when closed; what is still open is all that the state holds."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([("a", 1, "X"), ("a", 20, "X"), ("b", 5, "X")], [("a", 10, "X"), ("a", 100, "X")], [("c", 400, "Y")]):
        stream = drop(spark, path, rows).withWatermark("ts", "15 minutes")
        query = (counters.closed_sessions(stream, "30 minutes").writeStream.format("parquet").option("path", out)
                 .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        query.awaitTermination()
    found = spark.read.parquet(out).collect()
    got = sorted((r.ip, (r.session_start.replace(tzinfo=timezone.utc) - BASE).seconds // 60,
                  (r.last_seen.replace(tzinfo=timezone.utc) - BASE).seconds // 60, r.attempts) for r in found)
    assert got == [("a", 1, 20, 3), ("a", 100, 100, 1), ("b", 5, 5, 1)]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1       # the session of c


def test_newest_rows_of_a_repeated_batch(spark, tmp_path):
    table = tail.NewestRows(str(tmp_path / "newest"), 5)
    schema = "seq struct<part:string,pos:bigint>, det int"

    def batch(numbers):
        return spark.createDataFrame([(("p", i), d) for i in numbers for d in (0, 1)], schema)
    expected = []
    for batch_id, numbers in enumerate((range(2), range(2, 6), [], range(6, 7))):
        for _ in range(2):                              # the second run is the repetition
            table.process(batch(numbers), batch_id)
        expected = sorted(expected + [(i, d) for i in numbers for d in (0, 1)])[-5:]
        assert sorted((r.seq.pos, r.det) for r in table.rows(spark).collect()) == expected
    assert len(list((tmp_path / "newest").glob("version=*"))) == 2


def test_counts_are_observed_by_the_job_that_writes(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("\n".join([line(), "junk", "", "# note", line(path="/x"), "more junk"]))
    lines = spark.read.text(str(source))
    tracker, group = spark.sparkContext.statusTracker(), "observed"
    spark.sparkContext.setJobGroup(group, "")
    row = parsers.write_with_quality(lines, str(tmp_path / "out")).first()
    spark.sparkContext.setJobGroup("other", "")
    assert (row.lines_parsed, row.parse_errors, row.success_rate) == (2, 2, 50.0)
    assert row.asDict() == parsers.parse_quality(lines).first().asDict()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert len(tracker.getJobIdsForGroup(group)) <= 2               # one that writes, one that shows the row
    none = parsers.write_with_quality(lines.limit(0), str(tmp_path / "none")).first()
    assert (none.lines_parsed, none.parse_errors, none.success_rate) == (0, 0, 0.0)


def test_sketches_merge_without_rows(spark):
    entries = spark.range(30_000).select(F.concat(F.lit("f"), F.col("id") % 7).alias("file"),
                                         F.concat(F.lit("10."), F.col("id") % 9000).alias("ip"))
    threats = entries.where("file <> 'f3'").select("file", F.col("ip").alias("source_ip"))
    per_file = reports.file_sketches(entries, threats, "file")
    total = reports.merge_sketches(per_file).first()
    assert (total.files, total.lines, total.threats) == (7, 30_000, threats.count())
    assert abs(total.unique_ips - 9000) <= 3 * reports.SKETCH_ERROR * 9000
    exact = threats.select("source_ip").distinct().count()
    assert abs(total.unique_attackers - exact) <= 3 * reports.SKETCH_ERROR * exact
    sizes = per_file.select(F.length("ips").alias("n")).agg(F.max("n")).first()[0]
    assert sizes < 20_000
    none = reports.merge_sketches(reports.file_sketches(entries.limit(0), threats.limit(0), "file")).first()
    assert none.unique_ips == 0 and none.files == 0
