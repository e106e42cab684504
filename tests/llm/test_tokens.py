"""Token files and packing: exact against the library, exact round trips."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given as sampled
from hypothesis import settings
from hypothesis import strategies as st

from threatlens.llm import packing, token_files, tokens

VOCABULARY = tokens.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(VOCABULARY)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def sums(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


_PARTS = st.sampled_from([*"ab Zé'st\n\t 1.!²\x1c\x85\xa0中́🙂<|>\r\x0b\xad", "<|endoftext|>", "<|endof"])


@settings(max_examples=400, deadline=None)
@sampled(st.lists(st.lists(_PARTS, max_size=40).map("".join), max_size=6))
def test_encoder_equals_the_library(library, texts):
    found = tokens.encoder(VOCABULARY).encode(texts)
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == [library(t) for t in texts]


def test_full_caches_start_anew(library):
    small = tokens.Encoder(VOCABULARY, entries=3)
    for text in ["one two three four five", "six seven one two", "eight nine ten", "one two"]:
        assert np.frombuffer(small.encode([text])[0], "<u4").tolist() == library(text)


@pytest.mark.parametrize("name", ["odd", "given"])
def test_files_round_trip(name, request, library, tmp_path, keys):
    docs = request.getfixturevalue(name)
    found = token_files.write_and_read(docs, f"file://{tmp_path}/ids").collect()
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    expected = {i: sorted(library(r.text) + [2] for r in rows if r.doc_id == i) for i in {r.doc_id for r in rows}}
    start = 0
    for f in sorted(found, key=lambda f: f.start):
        assert f.start == start
        start += f.n_tokens
    assert [f.doc_id for f in sorted(found, key=lambda f: f.start)] == [r.doc_id for r in rows]
    assert keys([(f.doc_id, f.n_tokens, f.ids_crc32) for f in found]) == keys(
        [(i, len(x), sums(x)) for i, lists in expected.items() for x in lists])


def test_files_have_the_format(given, library, tmp_path):
    manifest = token_files.write(given, str(tmp_path / "ids"))
    parts = token_files.bases(manifest)
    assert parts[0]["base"] == 0 and sum(p["n_docs"] for p in parts) == given.count()
    texts = dict(given.select("doc_id", "text").collect())
    for part in parts:
        ids, offsets, docs, nulls = token_files.open_part(str(tmp_path / "ids"), part)
        assert ids.dtype == np.uint16 and offsets.dtype == np.uint64 and len(offsets) == len(docs) + 1
        for i in range(0, len(docs), 7):
            assert ids[int(offsets[i]):int(offsets[i + 1])].tolist() == library(texts[int(docs[i])]) + [2]
    with pytest.raises(ValueError):
        token_files.local_path("hdfs://host/x")


def test_no_documents(none, tmp_path):
    assert not token_files.write_and_read(none, str(tmp_path / "ids")).count()
    assert not packing.pack(none).count()


@pytest.mark.parametrize("name", ["odd", "given"])
def test_packing_is_whole_and_tight(name, request, library):
    docs = request.getfixturevalue(name)
    found = packing.pack(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    expected = Counter()
    for r in rows:
        ids = library(r.text) + [2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[r.doc_id, n, a, b - a, sums(ids[a:b])] += 1
    assert Counter((f.doc_id, f.piece, f.start, f.length, f.ids_crc32) for f in found) == expected
    check_sequences(found)


def check_sequences(found):
    sequences = {}
    for f in found:
        sequences.setdefault(f.sequence_id, []).append((f.offset, f.length))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences)


@pytest.mark.parametrize("lengths", [
    [1024, 1024, 1], [1] * 3000, [700, 324, 700, 162, 162, 700, 108, 108, 108], [5] * 500 + [1019],
    [513] * 10, [3, 7, 1000] * 50])
def test_plans_hold_every_piece(lengths):
    made = packing.plan(Counter(lengths))
    held = Counter()
    for used, times in made:
        assert sum(n * k for n, k in used.items()) <= 1024 and times > 0
        for n, k in used.items():
            held[n] += k * times
    assert held == Counter(lengths)


def test_exact_combinations_fill_sequences():
    """A single, a pair and a triple complement leave nothing over."""
    assert sum(t for _, t in packing.plan(Counter([700, 324, 700, 162, 162, 700, 108, 108, 108]))) == 3


def test_plan_is_close_to_the_bound():
    draw = random.Random(3)
    counts = Counter(min(1023, int(draw.lognormvariate(5, 1.2)) + 1) for _ in range(200_000))
    made = packing.plan(counts)
    least = -(-sum(n * k for n, k in counts.items()) // 1024)
    assert sum(t for _, t in made) <= least * 1.002 and len(made) < 20_000
