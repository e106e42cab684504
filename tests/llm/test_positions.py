"""The positional index against a scan of every text for every window."""

import hashlib
import random
import re

import numpy as np
import pytest

from threatlens.llm import catalogue, positions, shared

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=10):
    """(doc_id, n_words, hit places, item ids) of every document."""
    out = []
    for doc_id, text in docs:
        w, hit, held = words(text), set(), set()
        for item_id, item in items:
            t = words(item)
            for i in range(max(1, len(t) - window + 1)) if t else ():
                phrase = t[i:i + window]
                for at in range(len(w) - len(phrase) + 1):
                    if w[at:at + len(phrase)] == phrase:
                        hit.update(range(at, at + len(phrase)))
                        if item_id is not None:
                            held.add(item_id)
        out.append((doc_id, len(w), hit, held))
    return out


def as_rows(found):
    return [(r.doc_id, r.n_words, tuple(p for x in r.hit for p in range(x.first, x.first + x.length)), tuple(r.items))
            for r in found]


def expected(docs, items):
    return [(d, n, tuple(sorted(hit)), tuple(sorted(map(str, held)))) for d, n, hit, held in brute(docs, items)]


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and then sleeps all day long in the sun"),
         (2, "one"), (3, "Same words here"), (10, "the the the the"), (4, ""), (5, None), (6, "--- !!"),
         (None, "çödé 中文 text"), (2, "one"), (7, "word word word word word word word word word word word word"),
         (8, "The quick brown fox jumps over the lazy dog and nothing else of the former item at all")]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory, odd_rows):
    draw = random.Random(11)
    rows = [(r[0], r[1]) for r in odd_rows]
    vocabulary = "the quick brown fox jumps over lazy dog and then sleeps one same here x y z".split()
    for i in range(100, 220):
        text = [draw.choice(vocabulary) for _ in range(draw.randrange(1, 90))]
        for _ in range(draw.randrange(3)):
            item = draw.choice(ITEMS)[1] or ""
            cut = item.split()
            a = draw.randrange(len(cut) + 1)
            at = draw.randrange(len(text))
            text[at:at] = cut[a:a + draw.randrange(4, 16)]
        rows.append((i, draw.choice([" ", ", ", "\n"]).join(text)))
    rows += [(300, rows[-1][1])] * 2 + [(301, ITEMS[0][1].upper() + "\x00" + ITEMS[0][1])]
    path = str(tmp_path_factory.mktemp("positions") / "documents.parquet")
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, term string, shard int") \
        .repartition(3).write.parquet(path)
    items = spark.createDataFrame([(*r, "z") for r in ITEMS], "item_id long, text string, places string")
    return shared.prepare(spark).read.parquet(path), rows, items


@pytest.mark.parametrize("limits", [{}, {"SHARD_DOCS": 3}, {"SHARD_WORDS": 50}, {"MAX_TERMS": 20}, {"MAX_TERMS": 1}])
def test_contamination_equals_brute_force(corpus, keys, monkeypatch, limits):
    """Any size of shards, and any number of passes, gives the same rows."""
    for name, value in limits.items():
        monkeypatch.setattr(positions, name, value)
    docs, rows, items = corpus
    found = as_rows(positions.contamination(docs, items).collect())
    assert keys(found) == keys(expected(rows, ITEMS))
    assert sum(bool(f[2]) for f in found) > 40


def test_given_documents(spark, given, keys):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    asked = [tuple(r) for r in items.select("item_id", "text").collect()]
    whole = brute([tuple(r) for r in given.select("doc_id", "text").collect()], asked)
    found = catalogue.QUERIES["op13_decontamination"](spark, "/root/testdata/sf0.001").collect()
    assert keys([tuple(f) for f in found]) == keys([
        (d, n, len(hit), len(held), hashlib.sha256(",".join(sorted(map(str, held))).encode()).hexdigest(), bool(hit))
        for d, n, hit, held in whole])


def test_exact_matches(corpus, keys):
    docs, rows, items = corpus
    found = {(r.doc_id, r.item_id, r.first, r.length) for r in positions.matches(docs, items).collect()}
    made = set()
    for doc_id, text in rows:
        w = words(text)
        for item_id, item in ITEMS:
            t = words(item)
            for i in range(max(1, len(t) - 9)) if t else ():
                made |= {(doc_id, item_id, at, len(t[i:i + 10])) for at in range(len(w))
                         if w[at:at + len(t[i:i + 10])] == t[i:i + 10]}
    assert found == made and len(made) > 100


def test_proximity_matches(spark, corpus, tmp_path):
    """Every term within some words of the rarest one, whatever the order; documents do not mix."""
    path = str(tmp_path / "documents.parquet")
    texts = ["alpha x x beta x gamma", "gamma beta alpha", "alpha" + " x" * 9 + " beta gamma", "beta gamma", "alpha x"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = spark.read.parquet(path)
    assert {r.doc_id for r in positions.matches(docs, items, within=5).collect()} == {0, 1}
    assert {r.doc_id for r in positions.matches(docs, items, within=12).collect()} == {0, 1, 2}
    with pytest.raises(Exception, match="stay below"):
        positions.matches(docs, items, within=5000).collect()


def test_empty_tables(none, corpus, spark):
    docs, rows, items = corpus
    assert positions.contamination(none, items).count() == 0 == positions.matches(none, items).count()
    found = positions.contamination(docs, items.limit(0)).collect()
    assert len(found) == len(rows) and not any(r.hit or r["items"] for r in found)
    assert np.array_equal(positions.words(b"A\x00b-C9\xc3\xa9"), [b"a", b"b", b"c9\xc3\xa9"])


def test_shards_are_answered_where_they_are_read(corpus, monkeypatch):
    """No list is shuffled, a shard is one row, and row groups stay small however many shards a task writes."""
    import pyarrow.parquet as pq
    docs, rows, items = corpus
    found = positions.contamination(docs, items)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(positions, "SHARD_DOCS", 2)
    monkeypatch.setattr(positions, "ROW_GROUP", 2000)
    some = next(positions._passes(positions.phrases(items)))
    index = positions.stored(docs, positions._terms(some))
    shards = [r.shard for r in index.select("shard").collect()]
    assert len(set(shards)) == len(shards) >= len(rows) / 2
    for path in {f.removeprefix("file://") for f in index.inputFiles()}:
        written = pq.ParquetFile(path).metadata
        assert max((written.row_group(i).num_rows for i in range(written.num_row_groups)), default=0) < 12
