import random
from collections import defaultdict, deque
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from threatlens.operators import behaviour, sliding
from threatlens.operators.sliding import latest_counts, sliding_count

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def deque_counts(rows, window):
    """One row at a time, in time order and arrival order within a time."""
    seen, out = defaultdict(deque), {}
    for key, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        q = seen[key]
        while q and q[0] < t - window:
            q.popleft()
        q.append(t)
        out[i] = len(q)
    return out


def frame(spark, rows, slice_rows=16):
    return spark.createDataFrame(
        [(k, START + timedelta(seconds=t), (f"{i // slice_rows:06d}", i)) for k, t, i in rows],
        "key string, ts timestamp, seq struct<part:string,pos:bigint>")


def counted(df, window, **options):
    out = sliding_count(df, F.col("key"), F.col("ts"), F.col("seq"), window, **options)
    return {r.seq.pos: r.window_count for r in out.select("seq", "window_count").collect()}


@pytest.mark.parametrize("window,fraction", [(60, 1), (5, 1), (60, 0.25)])
def test_equals_a_deque_with_ties_and_hot_keys(spark, window, fraction):
    rng = random.Random(window)
    # One key holds half of all rows, and many rows share a second.
    rows = [("hot" if rng.random() < 0.5 else rng.choice("abc"), rng.randint(0, 1500) * fraction, i)
            for i in range(1500)]
    rows += [("hot", 700, i) for i in range(1500, 1800)]
    expected = deque_counts(rows, window)
    for parts in (1, 8):
        assert counted(frame(spark, rows).repartition(parts), window) == expected
    assert counted(frame(spark, rows), window, at_least=12) == {i: n for i, n in expected.items() if n >= 12}


def test_bounds_nulls_and_old_times(spark):
    rows = [("a", 0, 0), ("a", 60, 1), ("a", 121, 2), (None, 5, 3)]
    assert counted(frame(spark, rows), 60) == {0: 1, 1: 2, 2: 1}
    early = [("a", -2_000_000_000 + t, i) for i, t in enumerate(range(0, 3000, 7))]
    assert counted(frame(spark, early), 60) == deque_counts(early, 60)
    assert counted(frame(spark, [("a", 0, 0)]).filter("false"), 60) == {}


def test_history_continues_a_count(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), t // 3, t) for t in range(300)]
    first, second = frame(spark, rows[:150]), frame(spark, rows[150:])
    expected = deque_counts(rows, 20)
    got = counted(second, 20, history=latest_counts(first, F.col("key"), F.col("ts")))
    assert got == {i: n for i, n in expected.items() if i >= 150}


def test_no_task_holds_a_hot_key(spark):
    df = frame(spark, [("hot", t, t) for t in range(2000)])
    plan = sliding_count(df, F.col("key"), F.col("ts"), F.col("seq"), 60)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    # Every shuffle spreads a key over time as well.
    alone = [part for part in physical.split("hashpartitioning(")[1:]
             if not any(c in part[:60] for c in ("_us", "_cell", "_stretch"))]
    assert not alone


def test_groups_do_not_grow_with_the_rows_of_a_hot_key(spark):
    """Ten times the rows at microsecond times: no group of cells or hours gets longer."""
    def widths(n):
        us = F.floor(F.col("id") * (7_200_000_000 / n)).cast("bigint")
        points = spark.range(n).select(F.lit("hot").alias("_key"), us.alias("_us"), F.lit("p").alias("_part"),
                                       F.lit(1).cast("bigint").alias("_n"), F.lit(1).alias("_kind"))
        assert points.select("_us").distinct().count() == n
        cell = F.floor(F.col("_us") / sliding.CELL_US)
        cells = points.select(cell.alias("c"), F.floor(cell / sliding.GROUP_CELLS).alias("g")).distinct()
        ranked = sliding.ranked(points).agg(F.max("_rank"), F.count_distinct("_rank")).first()
        assert tuple(ranked) == (n - 1, n)
        return cells.groupBy("g").count().agg(F.max("count")).first()[0], cells.select("g").distinct().count()
    assert widths(20_000) == widths(200_000) == (sliding.GROUP_CELLS, 2)


def test_port_scan(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "y"]), rng.randint(0, 300), rng.randint(1, 30)) for _ in range(400)]
    df = spark.createDataFrame([(ip, START + timedelta(seconds=s), p) for ip, s, p in rows],
                               "ip string, ts timestamp, port int")
    found = behaviour.detect_port_scan(df, F.col("port"), 60, 8, 10)
    base = int(START.timestamp())
    expected = {}
    for start in range(base - 60, base + 310, 10):
        for ip in "xy":
            ports = {p for i, s, p in rows if i == ip and start <= base + s < start + 60}
            if len(ports) >= 8:
                expected[ip, start] = len(ports)
    assert {(r.ip, int(r.window_start.replace(tzinfo=timezone.utc).timestamp())): r.ports
            for r in found.collect()} == expected


def test_beaconing(spark):
    rows = [("bot", "/c2", t * 3600) for t in range(60)] + [("man", "/c2", t) for t in (0, 3, 500, 90000, 90001,
                                                                                    200000, 200500, 300000, 300001, 5e5)]
    df = spark.createDataFrame([(ip, p, START + timedelta(seconds=t)) for ip, p, t in rows],
                               "ip string, path string, ts timestamp")
    found = behaviour.detect_beaconing(df).collect()
    assert [(r.ip, r.events, r.mean_gap) for r in found] == [("bot", 60, 3600.0)]
