import random
from urllib.parse import unquote, unquote_plus

import pytest
from pyspark.sql import functions as F

from threatlens.functions import lookup, text
from threatlens.operators import whitelist


def apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def random_texts(n=400):
    rng = random.Random(5)
    return ["".join(rng.choice(["%", "2", "7", "5", "z", "+", "a", "%27", "%2527", "é", "/", "?", "&", " "])
                    for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_decoding_equals_the_language(spark):
    def twice(s):
        once = unquote_plus(s)
        return unquote_plus(once) if "%" in once else once
    texts = random_texts() + ["100%", "%zz", "%2527", "a+b", ""]
    assert apply(spark, texts, text.url_decode_once) == [unquote(t) for t in texts]
    assert apply(spark, texts, text.url_decode_twice) == [twice(t) for t in texts]


def test_small_functions(spark):
    texts = random_texts(100)
    assert apply(spark, texts, text.query_params) == [
        0 if "?" not in t else t.split("?", 1)[1].count("&") + 1 for t in texts]
    assert apply(spark, texts, text.normalize_path) == [t.lower().split("?")[0] for t in texts]
    odd = ["<a>", "a'b", "x..y", "../x", "[]{}", "plain|"]
    assert apply(spark, odd, text.special_char_count) == [sum(c in "'\";|<>{}()[]" for c in t) for t in odd]
    assert apply(spark, odd, text.has_special_chars) == [1, 1, 0, 1, 0, 0]
    assert apply(spark, ["  x \t\n", "\x85\xa0"], text.strip) == ["x", ""]
    assert apply(spark, ["see 1.2.3.4", "from 1.1.1.1 x addr=2.2.2.2", "SRC: 3.3.3.3", "none"], text.extract_ip) == [
        "1.2.3.4", "1.1.1.1", "3.3.3.3", "0.0.0.0"]
    assert apply(spark, ["HIGH", "odd", "LOW"], lookup.severity_rank) == [2, 0, 0]


@pytest.mark.parametrize("value", [-17, -16, -1, 0, 15, 16, 1_705_312_800_000_000, 2**52 + 1])
def test_floor_div(spark, value):
    got = spark.range(1).select(text.floor_div(F.lit(value).cast("bigint"), 16).alias("q")).first().q
    assert got == value // 16


def test_replies(spark):
    whole = '{"is_threat": true, "threat_type": "X", "severity": "LOW", "confidence": 0.5, "reason": "r"}'
    texts = [whole, f"```json\n{whole}\n```", f"so: {whole} ok", '{"severity": "HIGH"}', "nothing", "[1]", ""]
    loose = apply(spark, texts, lambda c: lookup.reply(c)["severity"])
    assert loose == ["LOW", "LOW", "LOW", "HIGH", None, None, None]
    strict = apply(spark, texts, lambda c: lookup.reply(c, True).isNotNull())
    assert strict == [True, True, False, False, False, False, False]


def test_addresses(spark):
    import ipaddress
    texts = ["1.2.3.4", "255.255.255.255", "01.2.3.4", "1.2.3", "256.1.1.1", "a.b.c.d", "::1", "1.2.3.4.5", ""]

    def number(t):
        try:
            return int(ipaddress.IPv4Address(t))
        except ValueError:
            return None
    assert apply(spark, texts, whitelist.ipv4_number) == [number(t) for t in texts]


def test_networks_by_predicate_join_and_function_agree(spark):
    rng = random.Random(3)
    ips = [f"10.{rng.randint(0, 3)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}" for _ in range(500)]
    ips += ["bad", "2001:db8::5", "2001:db9::5", "::ffff:10.0.0.1"]
    nets = [f"10.{i % 4}.{rng.randint(0, 255)}.0/{rng.choice([17, 20, 24, 30])}" for i in range(100)]
    nets += ["10.3.0.0/16", "2001:db8::/32", "junk"]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    import ipaddress
    parsed = [ipaddress.ip_network(n, strict=False) for n in nets if n != "junk"]

    def hidden(ip):
        try:
            return any(ipaddress.ip_address(ip) in n for n in parsed)
        except ValueError:
            return False
    expected = sorted(ip for ip in ips if not hidden(ip))
    assert sorted(r.ip for r in whitelist.exclude_networks(df, nets).collect()) == expected
    few = ["10.3.0.0/16", "2001:db8::/32"]
    parsed = [ipaddress.ip_network(n) for n in few]
    assert sorted(r.ip for r in whitelist.exclude_networks(df, few).collect()) == sorted(
        ip for ip in ips if not hidden(ip))
    table = whitelist.range_table(spark, whitelist.merged_ranges(["0.0.0.0/0"]))
    assert {r.ip for r in whitelist.anti_join_ranges(df, table).collect()} == {
        "bad", "2001:db8::5", "2001:db9::5", "::ffff:10.0.0.1"}


def test_ipv6_networks_equal_the_address_parser(spark):
    """Spellings of valid and broken addresses; short lists as predicates, long ones as joins; no Python in the plan."""
    import ipaddress
    draw = random.Random(9)
    texts = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", ":::", "1:2:3", "12345::",
             "fe80::1%eth0", "fe80::1%", "::ffff:10.0.0.1", "::10.0.0.256", "1:2:3:4:5:6:10.0.0.1", "1:2:3:4:5:6:7:10.0.0.1",
             "10.0.0.1", ":1", "1:", "g::1", "2001:DB8::A", "", " ::1", "1.2.3.4::", "::1.2.3.4:5", "0:0:0:0:0:0:0:00001"]
    for _ in range(400):
        value = ipaddress.IPv6Address(draw.getrandbits(128) if draw.random() < 0.4 else
                                      (0x20010db8 << 96) + (draw.randrange(6) << 90) + draw.randrange(1 << 20))
        text = draw.choice([str(value), value.exploded, str(value).upper()])
        texts.append(text if draw.random() < 0.9 else text.replace(draw.choice(text), draw.choice([":", "", "x", "::"]), 1))
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "ip string")

    def parsed(text):
        try:
            return ipaddress.IPv6Address(text)
        except ValueError:
            return None
    digits = {r.ip: r.d for r in df.select("ip", whitelist.ipv6_digits(F.col("ip")).alias("d")).collect()}
    assert digits == {t: None if t is None or parsed(t) is None else f"{int(parsed(t)):032x}" for t in [*texts, None]}
    few = ["2001:db8::/33", "2001:db8:0:0:8000::/67", "::1", "fe80::/10", "10.0.0.0/8"]
    many = few + [str(ipaddress.ip_network(((0x20010db8 << 96) + (draw.getrandbits(40) << 40), 88), strict=False)) for _ in range(90)]
    for nets in (few, many, ["::/0"]):
        listed = [ipaddress.ip_network(n) for n in nets]

        def hidden(text):
            try:
                return text is not None and any(ipaddress.ip_address(text) in n for n in listed)
            except ValueError:
                return False
        kept = whitelist.exclude_networks(df, nets)
        assert sorted((r.ip or "null") for r in kept.collect()) == sorted(t or "null" for t in [*texts, None] if not hidden(t))
        assert "Python" not in kept._jdf.queryExecution().executedPlan().toString()
