"""Quality, weak rules and language: held-out accuracy and brute-force counts."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from threatlens.llm import language, quality, weak_rules

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def larger(spark, given):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def in_fold(doc_id, folds, fold):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def test_quality_on_held_out_documents(larger, labels):
    truth = {r.doc_id: r.quality for r in labels.collect()}
    found = quality.scored(larger, labels).collect()
    assert len(found) == larger.count()
    assert all(f.held_out == in_fold(f.doc_id, 3, 1) and f.predicted == (f.score >= 0.5) for f in found)
    tested = [(f.score, truth[f.doc_id]) for f in found if f.held_out and f.doc_id in truth]
    good, bad = [s for s, q in tested if q == 1], [s for s, q in tested if q == 0]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.97 and np.mean([(s >= 0.5) == q for s, q in tested]) > 0.95


def test_quality_ignores_held_out_labels(larger, labels):
    from pyspark.sql import functions as F
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((f.doc_id, f.score) for f in quality.scored(larger, x).collect()) for x in (labels, flipped))
    assert a == b


def test_quality_of_odd_rows(odd, none, spark, labels):
    found = quality.scored(odd, labels.where("doc_id < 0")).collect()
    assert len(found) == 16 and {f.score for f in found} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(6)] + [(7, None), (8, 9)], "doc_id long, quality int")
    assert {f.score for f in quality.scored(odd, one).collect()} == {1.0}
    two = spark.createDataFrame([(i, i % 2) for i in range(15)] + [(3, 1), (4, 0)], "doc_id long, quality int")
    scores = [f.score for f in quality.scored(odd, two).collect()]
    assert len(scores) == 16 and all(0 <= s <= 1 for s in scores)
    assert not quality.scored(none, labels).count()
    assert quality.accepted(odd, one).columns == odd.columns and quality.accepted(odd, one).count() == 16


def test_cached_factors_give_gaussian_densities():
    draw = np.random.default_rng(1)
    d = len(quality.NAMES)
    x = [draw.normal(size=(400, d)) @ draw.normal(size=(d, d)), draw.normal(1, 2, size=(900, d))]
    sums = {c: np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()]) for c, v in enumerate(x)}
    model = quality.fit(sums, shrinkage=0.2, ridge=0.0)
    logs = []
    for v in x:
        s = np.cov(v.T, bias=True)
        s = 0.8 * s + 0.2 * np.diag(s.diagonal())
        gap = x[1][:50] - v.mean(0)
        logs.append(np.log(len(v)) - (np.einsum("ij,jk,ik->i", gap, np.linalg.inv(s), gap) + np.linalg.slogdet(s)[1]) / 2)
    assert np.allclose(model.score(x[1][:50]), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500))))


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(covered), n < 10 or 100 * len(covered) > 20 * n)


@pytest.mark.parametrize("name", ["odd", "larger"])
def test_rule_counts_equal_brute_force(name, request, keys):
    docs = request.getfixturevalue(name)
    found = weak_rules.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                           "n_repeat_words", "base_failed").collect()
    rows = docs.select("doc_id", "text").collect()
    assert keys([tuple(f) for f in found]) == keys([(r.doc_id, *brute_counts(r.text)) for r in rows])


def test_verdicts_follow_the_votes(larger, labels, none, keys):
    judged = weak_rules.judged(larger)
    rules = weak_rules.votes()
    rows = judged.select("doc_id", "base_failed", "posterior", "kept", *[v.alias(k) for k, v in rules.items()]).collect()
    patterns = Counter(tuple(r[4:]) for r in rows)
    prior, accuracy = weak_rules.estimate(dict(patterns), len(rules))
    for r in rows:
        p = 1 / (1 + np.exp(-weak_rules.log_odds(tuple(r[4:]), prior, accuracy)))
        assert abs(p - r.posterior) < 1e-9 and r.kept == (not r.base_failed and r.posterior >= 0.5)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    good = [r.posterior >= 0.5 for r in rows if truth.get(r.doc_id) == 1]
    bad = [r.kept for r in rows if truth.get(r.doc_id) == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2
    assert not weak_rules.judged(none).count()


def test_estimation_finds_the_reliable_rules():
    """Votes drawn from known accuracies, one rule near chance; EM recovers them without labels."""
    draw = np.random.default_rng(7)
    true = [0.95, 0.9, 0.85, 0.6]
    patterns = Counter()
    for _ in range(20_000):
        label = int(draw.random() < 0.7)
        patterns[tuple(2 if draw.random() < 0.2 else label if draw.random() < a else 1 - label for a in true)] += 1
    prior, accuracy = weak_rules.estimate(dict(patterns), 4)
    assert abs(prior - 0.7) < 0.03
    assert np.allclose([np.mean(a) for a in accuracy], true, atol=0.04)


def drawn_votes(draw, n, share, bad, good):
    """Vote rows of rules with the given accuracies on bad and on good texts; a fifth abstains."""
    rows = []
    for _ in range(n):
        label = int(draw.random() < share)
        rows.append(tuple(2 if draw.random() < 0.2 else label if draw.random() < (bad, good)[label][r] else 1 - label
                          for r in range(len(bad))))
    return rows


def test_estimation_converges_on_clean_corpora():
    """99 % good texts: a bound of the prior must not end the search."""
    bad, good = [0.9] * 6, [0.95] * 6
    prior, accuracy = weak_rules.estimate(dict(Counter(drawn_votes(np.random.default_rng(5), 60_000, 0.99, bad, good))), 6)
    assert abs(prior - 0.99) < 0.003
    assert np.allclose([a for a, _ in accuracy], bad, atol=0.05) and np.allclose([a for _, a in accuracy], good, atol=0.01)


def test_estimation_on_counts_equals_rows():
    """The same EM written over single rows with arrays."""
    rows = drawn_votes(np.random.default_rng(6), 3000, 0.8, [0.9, 0.8, 0.7], [0.85, 0.9, 0.75])
    votes, prior, right = np.array(rows), 0.5, np.full((3, 2), 0.8)
    for _ in range(weak_rules.ROUNDS):
        odds = np.log(prior / (1 - prior)) + sum(
            np.where(votes[:, r] == 1, np.log(right[r, 1] / (1 - right[r, 0])),
                     np.where(votes[:, r] == 0, np.log((1 - right[r, 1]) / right[r, 0]), 0)) for r in range(3))
        p = 1 / (1 + np.exp(-odds))
        new = np.array([[(((1 - p) * (votes[:, r] == 0)).sum() + 1) / (((1 - p) * (votes[:, r] != 2)).sum() + 1.25),
                         ((p * (votes[:, r] == 1)).sum() + 1) / ((p * (votes[:, r] != 2)).sum() + 1.25)] for r in range(3)])
        new = np.clip(new, weak_rules.LEAST, weak_rules.MOST)
        moved = max(abs(p.mean() - prior), np.abs(new - right).max())
        prior, right = p.mean(), new
        if moved < weak_rules.TOLERANCE:
            break
    found_prior, found = weak_rules.estimate(dict(Counter(rows)), 3)
    assert abs(found_prior - prior) < 1e-6 and np.allclose(found, right, atol=1e-6)


def test_rules_stay_in_the_engine(larger):
    from tests.llm.plans import native
    assert native(weak_rules.judged(larger)) and native(weak_rules.measured(larger))


def test_language_on_held_out_documents(larger, keys):
    truth = {r.doc_id: r.lang for r in larger.collect()}
    found = language.identify(larger).collect()
    assert len(found) == len(truth) and all(f.held_out == in_fold(f.doc_id, 4, 2) for f in found)
    assert np.mean([f.lang_pred == truth[f.doc_id] for f in found if f.held_out]) > 0.97
    assert keys([tuple(f) for f in found]) == keys([tuple(f) for f in language.identify(larger).collect()])


def test_language_of_odd_rows(odd, odd_rows, none, spark):
    found = language.identify(odd).collect()
    assert len(found) == len(odd_rows) and all(0 <= f.score <= 1 for f in found)
    assert {f.lang_pred for f in found if f.doc_id in (0, 1, 2)} == {"und"}
    assert {f.lang_pred for f in found} <= {"en", "de", "fr", "es", "und"}
    unknown = language.identify(odd.withColumn("lang", odd.lang.substr(9, 1)).where("lang <> ''")).collect()
    assert not unknown and not language.identify(none).count()
    from pyspark.sql import functions as F
    assert {f.lang_pred for f in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_presence_kernel_equals_sets():
    def kernel(a, b):
        grams = [{t[i:i + n] for n in range(1, 5) for i in range(len(t) - n + 1)} for t in (a, b)]
        return len(grams[0] & grams[1]) / np.sqrt(len(grams[0]) * len(grams[1]))
    rows = []
    texts = [language.letters(t) for t in ("The cat, the HAT 99", "that chat was here")]
    for t in texts:
        row = np.zeros(language.DIMENSIONS, np.float32)
        language.mark(t, row)
        rows.append(row)
    dense = (rows[0] @ rows[1]) / np.sqrt(rows[0].sum() * rows[1].sum())
    assert abs(dense - kernel(*texts)) < 0.02       # hashing may join a few n-grams


def test_blocks_of_a_long_text_are_seamless(monkeypatch):
    text = language.letters("sphinx of black quartz judge my vow " * 30)
    whole, cut = (np.zeros(language.DIMENSIONS, np.uint8) for _ in range(2))
    language.mark(text, whole)
    monkeypatch.setattr(language, "_BLOCK", 37)
    language.mark(text, cut)
    assert (whole == cut).all()
