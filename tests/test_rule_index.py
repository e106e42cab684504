"""Rules by their literals against every pattern on every row."""

import random
import re

import pytest

from threatlens.operators import detect, rule_index


@pytest.mark.parametrize("pattern, literal", [
    ("(?i)union.+select", "select"), ("sqlmap", "sqlmap"), ("a|bcd", None), ("(a|b)cde", "cde"), ("abcd?", "abc"), ("ab*", None),
    ("abc+d", "abc"), (r"\d{3}-\d{2}xyz", "xyz"), (r"10\.0\.0\.1 ", "10.0.0.1 "), ("[abc]def[^]x]ghij", None), (r"\x41bcd", None),
    ("(?x)abc def", None), (r"\Qabc\E", None), ("abc{2,3}def", "def"), ("(x(y|z)\\)w)PQR", "pqr"), ("é12", None), ("", None),
    ("^abc$", "abc"), ("abc\\", None), ("(?:abc", None), ("[\\]abc]xyz", "xyz"), ("a{0}bcde", "bcde")])
def test_literals(pattern, literal):
    assert rule_index.required_literal(pattern) == literal


def test_every_match_holds_the_literal():
    draw = random.Random(1)
    atoms = ["a", "b", "c", "abc", "ca", ".", "[ab]", "(a|b)", "(ab)+", "c?", "b*", "a{2}", r"\.", r"\w", "(?:b|ca)?"]
    checked = 0
    for _ in range(3000):
        pattern = draw.choice(["", "(?i)"]) + "".join(draw.choice(atoms) for _ in range(draw.randrange(1, 6)))
        literal = rule_index.required_literal(pattern)
        for _ in range(6):
            text = "".join(draw.choice("abcABC.x") for _ in range(draw.randrange(14)))
            if literal and re.search(pattern, text):
                checked += 1
                assert literal in text.lower(), (pattern, text)
    assert checked > 30


def test_index_equals_every_pattern(spark):
    draw = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "Omega", "sigma", "x1", "y22"]
    rows = [(i, " ".join(draw.choice(words) + str(draw.randrange(60)) for _ in range(draw.randrange(7)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "ab")]
    rules = [(n, f"(?i){draw.choice(words)}{draw.randrange(60)}\\b") for n in range(400)]
    rules += [(400, "^[xy]"), (401, "(alpha|beta)5[0-9]"), (402, "zz?")]
    df = spark.createDataFrame(rows, "id int, line string").repartition(4)
    table = spark.createDataFrame([(n, p, f"r{n}") for n, p in rules], "rule_no int, pattern string, name string")
    expected = {}
    for i, line in rows:
        hit = next((n for n, p in rules if line is not None and re.search(p, line)), None)
        if hit is not None:
            expected[i] = f"r{hit}"
    found = detect.match_rule_table(df, table, "line")
    assert {r.id: r.name for r in found.collect()} == expected and len(expected) > 200
    assert found.count() == len(expected)
    every = {(r["_row"].id, r.rule_no) for r in rule_index.matches(df, rule_index.build(df, table, "line"), "line").collect()}
    assert every == {(i, n) for i, line in rows for n, p in rules if line is not None and re.search(p, line)}


def test_rows_are_shuffled_for_listed_grams_only(spark, monkeypatch):
    rows = [(i, f"10.0.{i // 100}.{i % 100} - GET /a/long/path/that/every/row/has?q={'x' * 50}") for i in range(2000)]
    df = spark.createDataFrame(rows, "id int, line string").repartition(4)
    table = spark.createDataFrame([(i, rf"^10\.0\.{i // 100}\.{i % 100} ") for i in range(2000)], "rule_no int, pattern string")
    index = rule_index.build(df, table, "line")
    assert max(r["count"] for r in index.groupBy("gram").count().collect()) <= 5      # rules that share a key, of 2,000
    found = {(r["_row"].id, r.rule_no) for r in rule_index.matches(df, index, "line").collect()}
    assert found == {(i, i) for i in range(2000)}
    monkeypatch.setattr(rule_index, "MOST", 10)                                       # joined by a shuffle
    assert {(r["_row"].id, r.rule_no) for r in rule_index.matches(df, index, "line").collect()} == found
