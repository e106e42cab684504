import random
import re
from urllib.parse import unquote, unquote_plus

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from loglines import line
from pyspark.sql import functions as F

from threatlens import rules
from threatlens.operators import detect, parsers, whitelist

BF = {"detection": {"brute_force": {"threshold": 5, "window": 60}, "ddos": {"threshold": 6, "window": 60}}}
PIECES = ["union", "ſelect", "SELECT", " ", "'", " OR ", "1", "=", "--", "../", "..\\", "%2e%2e/", "<script", ">",
          "<img x", "onerror", "onload =", "alert", "(", "document.", "cookie", "/etc/passwd", "/ETC/hosts", "drop ",
          "table", ";", "exec", "information_schema", "%27", "%2527", "+", "a", "é", "javascript", ":", "boot.ini",
          "c:\\windows\\system32", "/proc/self", "into\u00a0outfile", "database()", "&#39;", "sleep(1)", "char(", "1=1"]


def found(df):
    return sorted((r.seq.pos, r.threat_type) for r in df.select("seq", "threat_type").collect())


def all_patterns():
    return [(r, p) for profile in rules.PROFILES.values() for r in profile.rules for p in r.patterns]


@pytest.mark.parametrize("rule,pattern", all_patterns(), ids=lambda x: x if isinstance(x, str) else x.name)
def test_hints_never_exclude_a_match(rule, pattern):
    @settings(max_examples=60, deadline=None)
    @given(st.from_regex(re.compile(pattern, re.ASCII), fullmatch=True))
    def check(sample):
        if sample.isascii():
            low = sample.lower()
            assert any(all(h in low for h in needed) for needed in rule.hints)
    check()


def strict_expected(path, agent):
    def decode(s):
        once = unquote_plus(s)
        return unquote_plus(once) if "%" in once else once
    # What the parser makes of the request line.
    m = re.match(rules.ACCESS_STRICT_LINE, line(path=path, agent=agent))
    if not m:
        return None
    dp = decode(f"{m[4]} {(m[5] or 'HTTP/1.1').strip()}")
    texts = {"path": dp, "path_and_referrer": dp + " " + decode(m[8] or "-"), "user_agent": m[9] or ""}
    return {r.threat_type for r in rules.STRICT.rules if any(re.search(p, texts[r.text]) for p in r.patterns)}


def test_random_requests_equal_one_by_one_matching(lines):
    rng = random.Random(11)
    paths = ["/" + "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 6))) for _ in range(600)]
    agents = [rng.choice(["Mozilla/5.0", "SQLmap/1", "curl/7", "Nikto", "w3af", "x"]) for _ in paths]
    df = lines([line(path=p, agent=a) for p, a in zip(paths, agents)])
    got = {}
    for pos, kind in found(detect.detect_patterns(parsers.parse_nginx(df))):
        got.setdefault(pos, set()).add(kind)
    for i, (p, a) in enumerate(zip(paths, agents)):
        assert got.get(i, set()) == (strict_expected(p, a) or set()), (p, a)
    classic = {}
    for r in detect.detect_patterns(parsers.parse_nginx(df, "classic"), profile="classic").collect():
        classic.setdefault(r.seq.pos, {})[r.threat_type] = r.payload
    for i, (p, a) in enumerate(zip(paths, agents)):
        m = re.match(rules.NGINX_CLASSIC_LINE, line(path=p, agent=a))
        expected = {}
        for r in rules.CLASSIC.rules:
            subject = m[8] if r.text == "user_agent" else unquote(m[4])
            hit = next((re.search(x, subject) for x in r.patterns if re.search(x, subject)), None)
            if hit:
                expected[r.threat_type] = subject[:200] if r.text == "user_agent" else hit[0][:200]
        assert classic.get(i, {}) == expected, (p, a)


def test_sample_lines(lines):
    texts = [line("198.51.100.1", "/catalog/lamps?page=3"), line("198.51.100.2", "/lamps?sort=price UNION ALL SELECT 1"),
             line("198.51.100.3", "/lamps?maker=7%27+or+%27c%27%3D%27c", agent="sqlmap/1.8.2"),
             line("198.51.100.4", "/media?f=../../srv/keys", 404), line("198.51.100.5", "/find?q=<script>alert(7)</script>"),
             line("198.51.100.6", "/lamps", referrer="https://x.example/?q=<script>")]
    rows = detect.detect_all(parsers.parse_nginx(lines(texts)))
    assert found(rows) == [(1, "SQL_INJECTION"), (2, "SQL_INJECTION"), (2, "SUSPICIOUS_UA"), (3, "PATH_TRAVERSAL"),
                           (4, "XSS"), (5, "XSS")]
    first = rows.filter("seq.pos = 2 and threat_type = 'SQL_INJECTION'").first()
    assert (first.severity, first.confidence, first.source_ip) == ("CRITICAL", 0.95, "198.51.100.3")
    assert first.payload == "/lamps?maker=7' or 'c'='c HTTP/1.1" and first.description == "SQL Injection from 198.51.100.3"
    agent = rows.filter("threat_type = 'SUSPICIOUS_UA'").first()
    assert agent.description == "Suspicious UA from 198.51.100.3: sqlmap/1.8.2"
    exported = detect.threat_dict(rows).columns
    assert exported == ["threat_type", "severity", "source_ip", "timestamp", "description", "payload", "confidence",
                        "raw_log", "detection_method"]


def test_harmless_requests(entries):
    rows = [("1.1.1.1", p, 200, a, 0) for p in ("/about/team", "/api/v1/products?page=2", "/articles/what-is-javascript",
                                                "/downloads/report.pdf", "/100%", "/%zz")
            for a in ("Mozilla/5.0 Chrome/120.0", "")]
    assert found(detect.detect_all(entries(rows), BF)) == []


def test_flags(entries):
    df = entries([("1.1.1.1", "/?q=<script>", 200, "sqlmap", 0)])
    off = {"detection": {n: {"enabled": False} for n in ("xss", "suspicious_ua", "brute_force")}}
    assert found(detect.detect_all(df, off)) == []
    # The classic profile has no switch for agents.
    assert found(detect.detect_all(df, off, "classic")) == [(0, "SUSPICIOUS_UA")]


def test_bruteforce_thresholds(entries):
    rows = [("9.9.9.9", "/wp-login.php", 401, "M", i) for i in range(11)] + [("8.8.8.8", "/login", 404, "M", i) for i in
                                                                            range(4)]
    got = detect.detect_bruteforce(entries(rows), BF).orderBy("seq").collect()
    assert [r.window_count for r in got] == list(range(5, 12))
    assert [r.severity for r in got] == ["HIGH"] * 5 + ["CRITICAL"] * 2
    assert got[0].description == "Brute force: 5 failed attempts in 60s from 9.9.9.9" and got[0].confidence == 1.0
    spread = [("9.9.9.9", "/login", 401, "M", i * 61) for i in range(8)]
    assert detect.detect_bruteforce(entries(spread), BF).count() == 0
    assert detect.detect_bruteforce(entries([("9.9.9.9", "/login", 401, "M", i * 15) for i in range(5)]), BF).count() == 1


def test_classic_bruteforce_and_floods(entries):
    rows = [("9.9.9.9", "/Login?x=1", 200, "M", 0)] * 7
    got = detect.detect_all(entries(rows, "classic"), BF, "classic").orderBy("seq", "det").collect()
    assert [(r.seq.pos, r.threat_type) for r in got] == [(4, "BRUTE_FORCE"), (5, "BRUTE_FORCE"), (5, "DDOS"),
                                                        (6, "BRUTE_FORCE"), (6, "DDOS")]
    assert got[2].severity == "CRITICAL" and got[2].details == {"count": "6", "threshold": "6"}


def test_whitelists_come_before_counting(entries):
    rows = [("10.10.10.10", "/login", 401, "M", i) for i in range(6)]
    rows += [("192.168.7.7", "/?q=<script>", 200, "M", 0), ("5.5.5.5", "/?q=<script>", 200, "x GoogleBOT y", 0),
             ("not-an-ip", "/?q=<script>", 200, "M", 0)]
    config = BF | {"whitelist": {"ips": ["10.10.10.10", "192.168.0.0/16", "oops"], "user_agents": ["GoogleBot"]}}
    assert found(detect.detect_all(entries(rows), config)) == [(8, "XSS")]
    # The classic profile compares texts, so the network entry hides nothing.
    assert [k for k in found(detect.detect_all(entries(rows, "classic"), config, "classic")) if k[1] == "XSS"] == [
        (6, "XSS"), (8, "XSS")]
    extra = {"whitelist": {"paths": ["/log*"], "user_agents_regex": ["google.*y$"]}}
    assert whitelist.apply(entries(rows), extra).filter("path = '/login'").count() == 0


def test_audit(entries):
    rows = whitelist.audit(entries([("10.1.1.1", "/", 200, "M", 0)] * 3), ["10.0.0.0/8", "10.1.1.1", "x"]).collect()
    got = {r.entry: (r.valid, r.broad, r.addresses, r.rows_hidden) for r in rows}
    assert got == {"10.0.0.0/8": (True, True, 2.0 ** 24, 3), "10.1.1.1": (True, False, 1.0, 3),
                   "x": (False, False, None, 0)}


def test_result_does_not_depend_on_partitions(entries):
    rng = random.Random(4)
    rows = [(rng.choice(["1.1.1.1", "2.2.2.2"]), rng.choice(["/login", "/?q=<script>", "/a"]), rng.choice([200, 401]),
             "M", rng.randint(0, 200)) for _ in range(300)]
    df = entries(rows)
    results = [found(detect.detect_all(df.repartition(n), BF)) for n in (1, 2, 8)]
    assert results[0] == results[1] == results[2] and len(results[0]) > 50


def test_custom_rules(spark):
    df = spark.createDataFrame([(1, "API_KEY=abc and more"), (2, "none")], "id int, t string")
    custom = [{"name": "k", "pattern": "(?i)api_key=[a-z]+", "severity": "critical", "threat_type": "LEAK"},
              {"name": "w", "pattern": "more|none", "severity": "low", "threat_type": "WORD"}]
    got = detect.detect_custom(df, custom, F.col("t")).orderBy("id", "rule_no").collect()
    assert [(r.id, r.rule, r.severity, r.payload) for r in got] == [
        (1, "k", "CRITICAL", "API_KEY=abc"), (1, "w", "LOW", "more"), (2, "w", "LOW", "none")]


def test_a_table_of_six_thousand_rules(spark):
    table = spark.createDataFrame([(i, f"r{i}", f"(?i)needle{i}x") for i in range(6000)],
                                  "rule_no int, name string, pattern string")
    rows = spark.createDataFrame([(1, "a NEEDLE5999X"), (2, "needle7x needle3x"), (3, "nothing"), (4, None)],
                                 "id int, line string")
    found = {r.id: r.name for r in detect.match_rule_table(rows, table, "line").collect()}
    assert found == {1: "r5999", 2: "r3"}
