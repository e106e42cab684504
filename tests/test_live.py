"""The live detector and blocks against batches and plain loops."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from loglines import line
from pyspark.sql import functions as F
from test_sliding import START, deque_counts

from threatlens.operators import detect, parsers
from threatlens.streaming import live, tail

CONFIG = {"detection": {"brute_force": {"threshold": 4, "window": 20}, "ddos": {"threshold": 6, "window": 10}}}
_ROWS = "ip string, ts timestamp, seq struct<part:string,pos:bigint>"


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Each partition of a stateful stream opens a store and a worker of its own."""
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def feed(spark, path, rows):
    spark.createDataFrame([(k, START + timedelta(seconds=t), ("p", i)) for k, t, i in rows], _ROWS) \
        .coalesce(1).write.mode("append").parquet(path)


def counts(spark, batches, tmp_path, **options):
    """Runs the counter anew, from its checkpoint, after each batch."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        feed(spark, path, rows)
        stream = spark.readStream.schema(_ROWS).parquet(path)
        found = live.counted(stream, [live.Counter("c", F.lit(True), 10, 1)], **options)
        table = tail.drain(found, out, str(tmp_path / "cp"))
    return table


def test_counts_on_arrival_equal_the_batch(spark, tmp_path):
    rows = [("hot" if i % 3 else "b", i // 4, i) for i in range(240)]
    found = counts(spark, [rows[:70], rows[70:71], rows[71:]], tmp_path, lateness="5 seconds")
    assert {r.seq.pos: r.window_count for r in found.collect()} == deque_counts(rows, 10)


def test_waiting_counts_do_not_depend_on_the_order_of_arrival(spark, tmp_path):
    rows = [("hot" if i % 3 else "b", i // 4, i) for i in range(240)]
    draw, late = random.Random(4), []
    batches = [[], [], [], []]
    for r in rows:
        at = min(r[1] // 20, 2)
        if draw.random() < 0.2:
            late.append(r)
            at += 1
        batches[at].append(r)
    for b in batches:
        draw.shuffle(b)
    found = counts(spark, [*batches, [("end", 10_000, 999)], [("end", 20_000, 1000)]], tmp_path, lateness="45 seconds", wait=True)
    got = {r.seq.pos: r.window_count for r in found.collect() if r.ip != "end"}
    assert late and got == deque_counts(rows, 10)
    assert found.where("seq.pos = 999").count() == 1        # the last heartbeat itself still waits
    assert found.where("seq.pos = 1000").count() == 0


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    rows = [("a", t, t) for t in range(40)]
    found = counts(spark, [rows, [("x", 1000, 500)], [("a", 5, 600), ("a", 995, 601)]], tmp_path, lateness="10 seconds")
    got = {r.seq.pos: r.window_count for r in found.collect()}
    assert 600 not in got and got[601] == 1 and got[39] == 11


@pytest.mark.parametrize("profile", ["strict", "classic"])
def test_live_findings_equal_the_batch(spark, tmp_path, profile):
    draw, texts = random.Random(8), []
    for i in range(300):
        path = draw.choice(["/login", "/?q=<script>", "/ok", "/../../x"])
        texts.append(line(f"9.9.9.{draw.randrange(3)}", path, draw.choice([200, 401]), second=i // 3))
    lines_of = [(t, ("p", i)) for i, t in enumerate(texts)]
    schema = "value string, seq struct<part:string,pos:bigint>"
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for a, b in ((0, 120), (120, 121), (121, 300)):
        spark.createDataFrame(lines_of[a:b], schema).coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        table = tail.drain(live.detect_all(stream, profile=profile, config=CONFIG, lateness="30 seconds"), out, str(tmp_path / "cp"))
    batch = detect.detect_all(parsers.parse_nginx(spark.createDataFrame(lines_of, schema), profile), CONFIG, profile)
    columns = ["seq", "det", "threat_type", "severity", "source_ip", "ts", "description", "payload", "target", "raw_log"]
    assert sorted(table.select(columns).collect()) == sorted(batch.select(columns).collect())
    assert table.where("threat_type = 'BRUTE_FORCE'").count() > 20 and table.columns == batch.columns


def test_blocks_end_and_start_again(spark, tmp_path):
    schema = "source_ip string, ts timestamp, threat_type string, severity string, det int, seq struct<part:string,pos:bigint>"
    base, draw = datetime(2024, 1, 1, tzinfo=timezone.utc), random.Random(2)
    rows = sorted((draw.randrange(0, 4000), i, draw.choice("abc"), draw.choice(["HIGH", "CRITICAL", "LOW"])) for i in range(400))
    until, expected = {}, []
    for second, i, ip, severity in rows:
        if severity != "LOW" and second >= until.get(ip, 0):
            until[ip] = second + 100
            expected.append((ip, second, f"t{i}"))
    path = str(tmp_path / "in")
    for a, b in ((0, 90), (90, 91), (91, 260), (260, 400)):
        made = [(ip, base + timedelta(seconds=s), f"t{i}", severity, 1, ("p", i)) for s, i, ip, severity in rows[a:b]]
        draw.shuffle(made)
        spark.createDataFrame(made, schema).repartition(3).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        table = tail.drain(live.blocks(stream, 100, "1 minute"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r.ip, int((r.blocked_at.replace(tzinfo=timezone.utc) - base).total_seconds()), r.threat_type) for r in table.collect())
    assert got == sorted(expected) and len(got) > 60
