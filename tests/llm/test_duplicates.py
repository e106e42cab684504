"""Exact and SimHash duplicates against brute force."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from threatlens.llm import components, exact, shared, simhash

LOWER = {i: i + 32 for i in range(65, 91)}


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_labels(prints):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


@pytest.mark.parametrize("name", ["odd", "given"])
def test_classes_equal_brute_force(name, request, keys):
    docs = request.getfixturevalue(name)
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    labels = brute_labels(prints)
    smallest = {}
    for r, lab in zip(rows, labels):
        if r.doc_id is not None:
            smallest[lab] = min(smallest.get(lab, r.doc_id), r.doc_id)
    expected = keys([(r.doc_id, p, smallest.get(lab)) for r, p, lab in zip(rows, prints, labels)])
    found = simhash.classes(docs).collect()
    assert keys([(r.doc_id, r.fingerprint % 2 ** 64, r.component_id) for r in found]) == expected
    kept = simhash.representatives(docs)
    assert kept.count() == len(set(labels)) and kept.columns == docs.columns


def test_empty_tables(none):
    assert simhash.classes(none).count() == exact.duplicates(none).count() == 0
    assert simhash.representatives(none).count() == exact.survivors(none).count() == 0


@pytest.mark.parametrize("bucket", [4096, 2])
def test_pairs_at_every_distance(spark, bucket):
    """Random flips of a few centres, and many fingerprints that share a segment; both levels of the index."""
    draw = random.Random(5)
    prints = {0, 2 ** 64 - 1}
    for _ in range(12):
        centre = draw.getrandbits(64)
        for _ in range(12):
            changed = centre
            for bit in draw.sample(range(64), draw.randrange(6)):
                changed ^= 1 << bit
            prints.add(changed)
    shared_half = draw.getrandbits(32)
    prints |= {shared_half << 32 | draw.getrandbits(5) for _ in range(30)}
    signed = sorted(p - 2 ** 64 if p >> 63 else p for p in prints)
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    found = {tuple(sorted((r.a, r.b))) for r in simhash.near_pairs(df, bucket=bucket).collect()}
    assert found == {(a, b) for i, a in enumerate(signed) for b in signed[i + 1:] if (a ^ b).__and__(2 ** 64 - 1).bit_count() <= 3}


def test_long_chains_are_one_component(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (7000, 7000)]
    found = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {found[i] for i in range(201)} == {0} and found[1001] == 1000 and found[7000] == 7000
    assert not components.components(spark.createDataFrame([], "a long, b long")).count()


def test_small_graphs_take_few_rounds_and_files(spark, monkeypatch):
    """One crowded group of 600 links and many pairs: what a round costs must not follow the shuffle partitions."""
    draw = random.Random(3)
    ids = draw.sample(range(-2 ** 40, 2 ** 40), 1200)
    links = [(ids[i], ids[i + 1]) for i in range(600)] + [(ids[i], ids[i + 1]) for i in range(602, 1200, 2)]
    links += draw.sample(links, 50) + [(ids[1199], ids[1199])]
    draw.shuffle(links)
    files, real = [], shared.staged

    def staged(rows, name, *read):
        out = real(rows, name, *read)
        files.append((name, len(out.inputFiles())))
        return out
    monkeypatch.setattr(shared, "staged", staged)
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    expected = {i: min(ids[:601]) for i in ids[:601]}
    expected |= {i: min(ids[k:k + 2]) for k in range(602, 1200, 2) for i in ids[k:k + 2]}
    assert found == expected
    assert max(n for _, n in files) <= spark.sparkContext.defaultParallelism
    assert sum(name == "labels" for name, _ in files) <= 23      # eleven rounds; passed on node by node, 73


@pytest.mark.parametrize("name", ["odd", "given"])
def test_exact_equals_brute_force(name, request, keys):
    docs = request.getfixturevalue(name)
    rows = docs.select("doc_id", "text").collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.text or "").translate(LOWER), []).append(r.doc_id)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    found = exact.duplicates(docs).select("doc_id", "keep_id", "group_size", F.lower(F.hex("digest")).alias("sha"),
                                          (F.col("row_no") == F.col("keep_row")).alias("kept")).collect()
    norm = [(r.text or "").translate(LOWER) for r in rows]
    assert keys([tuple(f)[:4] for f in found]) == keys(
        [(r.doc_id, top[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for r, t in zip(rows, norm)])
    assert sorted(f.sha for f in found if f.kept) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    assert all(f.doc_id == f.keep_id for f in found if f.kept)
    kept = exact.survivors(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_cuckoo_index_grows_deletes_and_verifies():
    index = exact.CuckooIndex(4)
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, d in enumerate(digests):
        index.put(d, i)
    assert index.live == 3000 and index.buckets > 4
    assert all(index.get(d) == i for i, d in enumerate(digests))
    assert all(index.delete(d) for d in digests[::2]) and not index.delete(digests[0])
    assert index.live == 1500 and index.get(digests[2]) is None and index.get(digests[3]) == 3
    twin = digests[3][:10] + b"\0" * 22             # the same buckets and fingerprint, another text
    assert index.get(twin) is None
    index.put(twin, -1)
    assert index.get(twin) == -1 and index.get(digests[3]) == 3
    for d in digests[::2]:
        index.put(d, 0)
    assert index.live == 3001 and len(dict(index.items())) == 3001


def test_same_bucket_digests_force_growth():
    """More digests of one fingerprint and bucket than eight slots: doubling parts them by higher bits."""
    index = exact.CuckooIndex(4)
    digests = [(i << 2).to_bytes(8, "little") + b"\x01\x00" + bytes(22) for i in range(40)]
    for d in digests:
        index.put(d, d)
    assert all(index.get(d) == d for d in digests)


def test_index_update(spark):
    first = spark.createDataFrame([(1, "A"), (2, "b"), (3, "a")], "doc_id long, text string")
    from threatlens.llm import shared
    shared.prepare(spark)
    index = exact.build(exact.digests(first), 3)
    gone = spark.createDataFrame([(9, "B"), (9, "unknown")], "doc_id long, text string")
    new = spark.createDataFrame([(7, "a"), (8, "c")], "doc_id long, text string")
    found = {(r.keep_id, r.group_size) for r in exact.update(index, new, gone).collect()}
    assert found == {(7, 3), (8, 1)}


def test_near_stage_equals_brute_force(spark, tmp_path):
    """The pipeline's stage keeps the smallest id of each group, also of a large group of near copies."""
    draw = random.Random(3)

    def edited(words, changes):
        words = list(words)
        for at in draw.sample(range(len(words)), changes):
            words[at] = f"w{draw.randrange(10 ** 6)}"
        return words
    texts = []
    for n in (6, 20, 150, 400, 900):
        for _ in range(5):
            base = [f"w{draw.randrange(5000)}" for _ in range(n)]
            texts += [base, base[:-1]] + [edited(base, c) for c in {1, max(1, n // 200), max(1, n // 60)}]
    hot = [f"w{draw.randrange(5000)}" for _ in range(600)]
    texts += [edited(hot, draw.randrange(1, 4)) for _ in range(80)]
    texts = [" ".join(t) for t in texts] + ["", " ", None, "One", "one", "a b", "A  b"]
    draw.shuffle(texts)
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    label = brute_labels([brute_fingerprint(t) for t in texts])
    assert len({i for i, x in enumerate(label) if x != i}) > 60
    kept = corpus_pipeline.near_stage(spark, spark.read.parquet(path), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))


def test_near_stage_on_odd_rows(spark, odd, none):
    texts = [r.text for r in odd.collect()]
    assert corpus_pipeline.near_stage(spark, odd, "").count() == len(set(brute_labels([brute_fingerprint(t) for t in texts])))
    assert corpus_pipeline.near_stage(spark, none, "").count() == 0
