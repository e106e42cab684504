"""Alignment against whole texts, token by token and pair by pair."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given as sampled
from hypothesis import settings
from hypothesis import strategies as st

from threatlens.llm import alignment, tokens

A_FILE, B_FILE = alignment.default_models()


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    letters = {v: k for k, v in tokens.byte_letters().items()}

    def a_tokens(text):
        ids = a.encode(text, add_special_tokens=False).ids
        return [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids]

    def b_tokens(text):
        out = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            byte = piece.startswith("<0x") and len(piece) == 6
            out.append((i, bytes([int(piece[3:5], 16)]) if byte else piece.replace("▁", " ").encode()))
        return out
    return a_tokens, b_tokens


def brute(libraries, texts):
    """Rows as the contract words them."""
    aligned = []
    for text in texts:
        a, b = ([], []) if not text else (libraries[0](" " + text), libraries[1](text))
        whole = (" " + (text or "")).encode()
        if b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
            aligned.append(None)
            continue
        spans = [[], []]
        for side, tokens_ in zip(spans, (a, b)):
            at = 0
            for i, data in tokens_:
                side.append((i, at, at + len(data)))
                at += len(data)
        linked = [(x[0], y[0]) for x in spans[0] for y in spans[1] if max(x[1], y[1]) < min(x[2], y[2])]
        groups, starts = [], [0, 0]
        for end in sorted({x[2] for x in spans[0]} & {x[2] for x in spans[1]}):
            sides = []
            for k in (0, 1):
                stop = next(i for i, x in enumerate(spans[k]) if x[2] == end) + 1
                sides.append(",".join(str(x[0]) for x in spans[k][starts[k]:stop]))
                starts[k] = stop
            groups.append("|".join(sides))
        aligned.append((len(a), len(b), groups, linked))
    held = Counter(p for x in aligned if x for p in set(x[3]))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return [(0, 0, 0, 0, 0, 0, "") if x is None else
            (x[0], x[1], len(x[2]), len(x[3]), sum(held[p] == most[p[0]] for p in x[3]), sum(held[p] for p in x[3]),
             hashlib.sha256(";".join(x[2]).encode()).hexdigest()) for x in aligned]


_PARTS = st.sampled_from([*"ab Zé'st\n\t 1.!²\x1c\x85\xa0中́🙂<|>\r\x0b\xad▁\x00日本語ñ", "  ", "   ", " the", "ing ",
                          "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>"])


@settings(max_examples=250, deadline=None)
@sampled(st.lists(st.lists(_PARTS, max_size=25).map("".join), max_size=5))
def test_words_equal_whole_texts(libraries, texts):
    found = list(alignment.aligner(A_FILE, B_FILE).align(texts))
    for text, made, row in zip(texts, found, brute(libraries, texts), strict=True):
        if made is None:
            assert row[6] == "", text
            continue
        numbers, groups, pairs = made
        assert (*numbers, len(pairs), hashlib.sha256(groups.encode()).hexdigest()) == (*row[:4], row[6]), text


_MARKED = st.sampled_from([*"aéŁz.,;:!?*$%&#\n' \t9×ß'", "der", "\n", "\nIl", ".\n", "'s", "...", "***", " ", " word", "\r\n", "中", "\u0250"])


@settings(max_examples=250, deadline=None)
@sampled(st.lists(st.lists(_MARKED, max_size=25).map("".join), max_size=5))
def test_parts_of_words_equal_whole_texts(libraries, texts):
    found = list(alignment.aligner(A_FILE, B_FILE).align(texts))
    for text, made, row in zip(texts, found, brute(libraries, texts), strict=True):
        assert (made is None) == (row[6] == ""), text
        if made is not None:
            numbers, groups, pairs = made
            assert (*numbers, len(pairs), hashlib.sha256(groups.encode()).hexdigest()) == (*row[:4], row[6]), text


@pytest.mark.parametrize("cut", [True, False])
def test_shared_parts_are_aligned_once(libraries, cut):
    """A hundred words of ten heads and ten tails; whole words where the model has pieces across borders."""
    heads = ["haus", "été", "Weg", "rue", "Łan", "sin", "go", "Ähre", "mar", "noe"]
    tails = [".", ",", "!!", ".***", "$$$", ".\nDas", "\nIl", ";", ":\nOù?", "#"]
    made = alignment.Aligner(A_FILE, B_FILE)
    assert made.b.cut_at_borders
    made.b.cut_at_borders = cut
    text = " ".join(h + t for h in heads for t in tails)
    numbers, groups, pairs = next(made.align([text]))
    expected = brute(libraries, [text])[0]
    assert (*numbers, len(pairs), hashlib.sha256(groups.encode()).hexdigest()) == (*expected[:4], expected[6])
    assert len(made._texts) <= 45 if cut else len(made._texts) > 100


def test_full_caches_start_anew(libraries):
    small = alignment.Aligner(A_FILE, B_FILE, entries=2)
    for text in ("one two three", "two three four", "one five"):
        assert next(small.align([text]))[0][2] == brute(libraries, [text])[0][2]


def test_refined_cuts():
    """Two tokens inside one character, and widths that contradict the spans."""
    ends, cut = np.array([1, 4, 4, 5]), np.array([True, False, True, True])
    assert alignment.refined(ends, cut, np.array([1, 2, 1, 1])).tolist() == [1, 3, 4, 5]
    assert alignment.refined(ends, cut, np.array([1, 2, 2, 1])) is None
    left, right = alignment.links(np.array([2, 5, 6]), np.array([1, 3, 6]))
    assert list(zip(left, right)) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2)]


@pytest.mark.parametrize("limits", [{}, {"PART_DOCS": 2}, {"PART_LINKS": 40}])
@pytest.mark.parametrize("name", ["odd", "given"])
def test_alignment_equals_brute_force(name, request, libraries, keys, monkeypatch, limits):
    if name == "given" and limits:
        limits = {k: 30 * v for k, v in limits.items()}
    for key, value in limits.items():
        monkeypatch.setattr(alignment, key, value)
    docs = request.getfixturevalue(name)
    rows = docs.select("doc_id", "text").collect()
    texts = [r.text if r.text is None or len(r.text) < 40_000 else r.text for r in rows]
    if name == "odd":               # the brute force compares all tokens of a text with all others
        docs, rows, texts = docs.where("length(text) < 20000 or text is null"), *zip(*[
            (r, r.text) for r in rows if r.text is None or len(r.text) < 20_000])
    else:
        kept = [r for r in rows if len(r.text) < 3000]
        docs, rows, texts = docs.where("length(text) < 3000"), kept, [r.text for r in kept]
    found = alignment.align(docs).collect()
    assert keys([tuple(f) for f in found]) == keys([(r.doc_id, *x) for r, x in zip(rows, brute(libraries, list(texts)))])


def test_long_and_no_documents(odd, none):
    assert alignment.align(none).count() == 0
    long = [r for r in alignment.align(odd.where("doc_id = 8")).collect()]
    assert len(long) == 1 and long[0].n_a > 20_000 and long[0].n_best <= long[0].n_links == long[0].count_sum
