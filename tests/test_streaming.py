from datetime import datetime, timedelta, timezone

from loglines import line
from pyspark.sql import functions as F
from test_sliding import START, deque_counts

from threatlens.operators import detect, parsers
from threatlens.streaming import counters, tail


def drops(spark, batches, path):
    """Parquet drops read one per micro-batch."""
    for rows in batches:
        spark.createDataFrame([(k, START + timedelta(seconds=t), ("p", i)) for k, t, i in rows],
                              "ip string, ts timestamp, seq struct<part:string,pos:bigint>") \
            .coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_counter_equals_batch_and_counts_late_rows(spark, tmp_path):
    rows = [("hot" if i % 3 else "b", i // 4, i) for i in range(240)]
    batches = [rows[:80], rows[80:160], rows[160:] + [("late", -5000, 999)]]
    stream = drops(spark, batches, str(tmp_path / "in"))
    counter = counters.SlidingCounter(str(tmp_path / "out"), window_seconds=10, lateness_seconds=30)
    counter.start(stream, str(tmp_path / "cp"), poll_interval=None).awaitTermination()
    got = {r.seq.pos: r.window_count for r in counter.results(spark).collect()}
    assert got == deque_counts(rows, 10)
    assert counter.progress(spark).agg(F.sum("late")).first()[0] == 1
    # A repeated batch overwrites its own output.
    counter.process(spark.createDataFrame(
        [(k, START + timedelta(seconds=t), ("p", i)) for k, t, i in batches[2]],
        "ip string, ts timestamp, seq struct<part:string,pos:bigint>"), 2)
    assert {r.seq.pos: r.window_count for r in counter.results(spark).collect()} == got


def test_only_new_files_and_stop(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "old.log").write_text(line(path="/?q=<script>") + "\n")
    stream = tail.parse_detect(tail.stream_lines(spark, str(folder)))
    checkpoint, seen = str(tmp_path / "cp"), []
    tail.skip_existing(stream, checkpoint)
    query = tail.watch(stream, checkpoint, lambda batch, i: seen.extend(batch.collect()), 0.2)
    (folder / "new.log").write_text("\n".join([line(path="/../x"), "", "junk", line(path="/ok")]))
    query.processAllAvailable()
    query.stop()
    assert [r.threat_type for r in seen] == ["PATH_TRAVERSAL"] and not query.isActive


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    texts = [line(f"1.1.1.{i % 5}", "/?q=<script>" if i % 2 else "/../a", second=i) for i in range(60)]
    (folder / "a.log").write_text("\n".join(texts[:30]))
    (folder / "b.log").write_text("\n".join(texts[30:]))
    stream = tail.parse_detect(tail.stream_lines(spark, str(folder), files_per_batch=1))
    table = tail.drain(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    lines = spark.createDataFrame([(t, ("p", i)) for i, t in enumerate(texts)],
                                  "value string, seq struct<part:string,pos:bigint>")
    batch = detect.detect_patterns(parsers.parse_nginx(lines))
    columns = ["threat_type", "source_ip", "ts", "payload"]
    assert sorted(table.select(columns).collect()) == sorted(batch.select(columns).collect())
    stats = tail.drain_latest(tail.live_stats(stream), str(tmp_path / "s"), str(tmp_path / "scp"), "complete")
    assert {r.threat_type: r["count"] for r in stats.collect()} == {"XSS": 30, "PATH_TRAVERSAL": 30}


def test_blocks_once_per_ttl(spark, tmp_path):
    schema = "source_ip string, ts timestamp, threat_type string, severity string"
    base = datetime(2024, 1, 1, tzinfo=timezone.utc)
    for i, (ip, minutes) in enumerate([("a", 0), ("a", 5), ("b", 6), ("c", 200), ("c", 210), ("a", 300)]):
        spark.createDataFrame([(ip, base + timedelta(minutes=minutes), "XSS", "HIGH")], schema) \
            .coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema) \
        .option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = tail.drain(tail.block_stream(stream, "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted((r.ip, r.blocked_at.hour, r.blocked_at.minute) for r in got.collect()) == [
        ("a", 0, 0), ("a", 5, 0), ("b", 0, 6), ("c", 3, 20)]


def test_live_totals_count_each_address_once(spark, tmp_path):
    schema = "source_ip string, severity string"
    lines_in, found_in = str(tmp_path / "lines"), str(tmp_path / "found")
    totals = tail.LiveTotals(str(tmp_path / "totals"))
    assert tuple(totals.rows(spark).first()) == (0, 0, 0, 0)
    drops = [[("a", "LOW"), ("a", "LOW"), ("b", "HIGH")], [("a", "CRITICAL"), ("c", None), (None, "HIGH")], [("b", "HIGH"), ("b", "LOW")]]
    expected = [(4, 3, 2, 1), (8, 6, 3, 2), (12, 8, 3, 2)]
    for drop, wanted in zip(drops, expected):
        spark.range(4).coalesce(1).write.mode("append").parquet(lines_in)
        spark.createDataFrame(drop, schema).coalesce(1).write.mode("append").parquet(found_in)
        entries = spark.readStream.schema("id bigint").parquet(lines_in)
        found = spark.readStream.schema(schema).parquet(found_in)
        totals.start(entries, found, str(tmp_path / "cp"), poll_interval=None).awaitTermination()
        assert tuple(totals.rows(spark).first()) == wanted
    # A batch that is repeated after a failure replaces what it wrote.
    again = spark.createDataFrame([("b", "HIGH", False), ("b", "LOW", False)], schema + ", line boolean").unionByName(
        spark.range(4).selectExpr("CAST(NULL AS STRING) source_ip", "CAST(NULL AS STRING) severity", "true line"))
    totals.process(again, 2)
    assert tuple(totals.rows(spark).first()) == expected[-1]
