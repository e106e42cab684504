"""Port scans and block terms against plain loops, with a hot address."""

import random
from datetime import timedelta

from pyspark.sql import functions as F
from test_sliding import START

from threatlens.operators import behaviour, respond


def touches(draw, n):
    out = []
    for _ in range(n):
        ip = "hot" if draw.random() < 0.6 else draw.choice("abc")
        out.append((ip, draw.choice([22, 22, 22, draw.randrange(30)]), draw.randrange(400) * 1_000_000 + draw.choice([0, 0, 1, 999_999])))
    return out


def test_port_scans_equal_a_loop(spark):
    draw = random.Random(5)
    rows = touches(draw, 700) + [("a", None, 5), (None, 3, 5)]
    df = spark.createDataFrame([(ip, port, START + timedelta(microseconds=us)) for ip, port, us in rows] + [("a", 7, None)],
                               "ip string, port int, ts timestamp").repartition(5)
    for window, threshold in ((10, 4), (60, 12), (1, 2)):
        expected = set()
        for ip, port, us in rows:
            if ip is None or port is None:
                continue
            held = {p for i, p, u in rows if i == ip and p is not None and us - window * 1_000_000 <= u <= us}
            if len(held) >= threshold:
                expected.add((ip, us, len(held)))
        found = behaviour.port_scans(df, F.col("port"), window, threshold).collect()
        base = START.replace(tzinfo=None)
        got = [(r.ip, round((r.ts - base).total_seconds() * 1_000_000), r.ports) for r in found]
        assert len(got) == len(set(got)) and set(got) == expected and expected


def test_block_terms_spread_a_hot_address(spark):
    """Half of the entries from one address; terms that follow each other, one without an end, one too long for bins."""
    draw = random.Random(6)
    rows = [(i, "hot" if i % 2 else f"u{draw.randrange(9)}", draw.randrange(20 * 86400)) for i in range(4000)]
    df = spark.createDataFrame([(i, ip, START + timedelta(seconds=t)) for i, ip, t in rows] + [(-1, "hot", None), (-2, None, START)],
                               "id long, ip string, ts timestamp").repartition(40)
    terms = [("hot", 1000, 50_000), ("hot", 60_000, 86_400), ("hot", 900_000, 1), ("u1", 5, 0), ("u2", 100, 10 ** 9), ("u3", 0, 30)]
    blocks = spark.createDataFrame([(ip, START + timedelta(seconds=t), d) for ip, t, d in terms],
                                   "ip string, blocked_at timestamp, duration int")

    def met(ip, t):
        return any(ip == b and t >= at and (d == 0 or t < at + d) for b, at, d in terms)
    expected = sorted(i for i, ip, t in rows if met(ip, t))
    found = respond.blocked_entries(df, blocks)
    assert sorted(r.id for r in found.collect()) == expected and found.columns == df.columns
    rest = sorted(r.id for r in respond.blocked_entries(df, blocks, blocked=False).collect())
    assert rest == sorted({i for i, _, _ in rows} - set(expected) | {-1, -2})
    # The keys that entries are dealt by: no one holds more than a small part of the hot address.
    keyed = df.where("ip = 'hot'").groupBy("ip", F.floor(F.unix_seconds("ts") / (respond.BIN_HOURS * 3600)),
                                           F.pmod(F.spark_partition_id(), F.lit(respond.COPIES))).count()
    assert keyed.agg(F.max("count")).first()[0] <= 30
