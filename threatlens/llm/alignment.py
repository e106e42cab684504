"""Cross-tokenizer alignment by byte spans.

Two tokenizers cut the same bytes: A is a byte-level BPE of the ``tokenizers``
library over a space and the text, B a byte-fallback model of ``sentencepiece``
over the text, which puts the space there itself.  The libraries' own spans are
coarse cuts: A gives characters, and several tokens may share one; B gives
places where its byte tokens have no width.  Inside a coarse span the bytes that
the tokens decode to refine the cuts.  Where both end at the same byte a group
ends; two tokens are linked if their byte ranges overlap.

Neither tokenizer joins anything across a space that follows a non-space, so
texts are cut there and each distinct word of a batch is aligned once; words are
kept in a bounded cache.  A text's groups and links are those of its words.  Nor
does either join a Latin letter to the marks or the line break after it: words of
only these are cut there too, and what they share is aligned once.  A model with
a piece that crosses such a place has its words aligned whole.

The count of an id pair is the number of documents that link it.  Documents come
in parts of bounded size; each part lists its distinct pairs, the counts are
summed over parts, and every part gets back the counts of its own pairs only, so
nothing of the size of the vocabularies' product is broadcast or collected.

Null and empty texts have no tokens, nor have texts whose bytes a tokenizer does
not give back (U+2581 reads as a space).  Special tokens' strings are plain text.
Rows with equal ids are counted and answered one by one.  Texts are read whole.
An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlens.llm import shared, tokens

#: A part is closed at so many documents or links.
PART_DOCS, PART_LINKS = 4000, 2_000_000
_WORDS_PER_CALL = 2000
_ALIGNED = ("part long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "pairs array<long>, times array<int>")
ROWS = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
_CUT = re.compile(r"(?<=\S)(?= )")
_LETTER, _MARK = r"[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]", r"[.,;:!?*$%&#]"
#: Words that are cut into their letters, the marks after them, and a line break with the letters after it; and where.
_PARTED = re.compile(rf"{_LETTER}+(?:{_MARK}*\n{_LETTER}+)*{_MARK}*")
_BORDER = re.compile(rf"(?<={_LETTER})(?={_MARK}|\n)|(?<={_MARK})(?=\n)")
B_BITS = 32


def default_models() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def refined(ends: np.ndarray, cut: np.ndarray, lengths: np.ndarray) -> np.ndarray | None:
    """Byte ends of tokens from coarse ones.

    ``cut`` marks the tokens that end where their coarse span ends; between two cuts the
    decoded lengths decide.  None if they do not add up to the coarse spans.
    """
    total = np.cumsum(lengths)
    at = np.flatnonzero(cut)
    if not len(at) or at[-1] != len(cut) - 1 or not np.array_equal(ends[at], total[at]):
        return None
    before = np.concatenate([[-1], at])[np.searchsorted(at, np.arange(len(cut)), "left")]
    base = np.where(before < 0, 0, ends[before])
    return np.where(cut, ends, base + total - np.where(before < 0, 0, total[before]))


class ByteTokens:
    """Tokenizer A: ids and byte ends of strings."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer
        self._whole = Tokenizer.from_file(vocabulary)
        self._whole.encode_special_tokens = True        # their strings are plain text
        self._lengths = tokens.byte_lengths(self._whole)
        self.size = len(self._lengths)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        made = self._whole.encode(text, add_special_tokens=False)
        ids = np.array(made.ids, "i8")
        starts, stops = np.fromiter(chain.from_iterable(made.offsets), "i8", 2 * len(ids)).reshape(-1, 2).T
        if text.isascii():
            bytes_at = stops
        else:
            letters = np.frombuffer(text.encode("utf-32-le"), "<u4")
            widths = 1 + (letters > 0x7F).astype("i8") + (letters > 0x7FF) + (letters > 0xFFFF)
            bytes_at = np.concatenate([[0], np.cumsum(widths)])[stops]
        cut = np.append(starts[1:] >= stops[:-1], True) if len(ids) else np.empty(0, bool)
        ends = refined(bytes_at, cut, self._lengths[ids])
        return None if ends is None else (ids, ends)


class PieceTokens:
    """Tokenizer B: ids and byte ends of strings, in the bytes of a space and the string."""

    def __init__(self, model: str):
        import sentencepiece
        self._model = sentencepiece.SentencePieceProcessor(model_file=model)
        self._bytes = [self._decoded(i) for i in range(self._model.get_piece_size())]
        self._lengths = np.array([len(b) for b in self._bytes], "i8")
        self.size = len(self._bytes)
        #: Whether no piece crosses a border, so that both sides of it are encoded alike apart.
        self.cut_at_borders = not any(_BORDER.search(self._model.id_to_piece(i)) for i in range(self.size))

    def _decoded(self, i: int) -> bytes:
        piece = self._model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._model.is_byte(i) else piece.replace("\u2581", " ").encode()

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        pieces = self._model.encode(text, return_type="proto", num_threads=1).pieces
        ids = [p.id for p in pieces]
        if b"".join([self._bytes[i] for i in ids]) != b" " + text.encode():
            return None
        ends = np.array([p.end for p in pieces], "i8")      # a piece begins where the one before it ends
        cut = np.diff(ends, prepend=0) > 0      # tokens without width share a character with the next, or are the space
        ids = np.array(ids, "i8")
        found = refined(ends + 1, cut, self._lengths[ids])
        return None if found is None else (ids, found)


def links(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the tokens of both sides whose byte ranges overlap; both sides tile the same bytes."""
    starts = np.concatenate([[0], a_ends[:-1]])
    low = np.searchsorted(b_ends, starts, "right")
    n = np.searchsorted(b_ends, a_ends, "left") - low + 1
    left = np.repeat(np.arange(len(a_ends)), n)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(n) - n - low, n)


class _Pool(tokens._Pool):
    """Runs of pair keys by slot."""

    def __init__(self):
        super().__init__()
        self.ids = np.empty(1 << 16, "i8")


class Aligner:
    """Aligns words; ``entries`` bounds the words known, and a full cache starts anew.

    A word has a slot: its counts, its groups as text, and its links as pair keys.  Slot 0
    is for words whose bytes do not come back.  A word of several parts has the negative
    number of a run of slots, those of its letters and of its tails.
    """

    def __init__(self, vocabulary: str, model: str, entries: int = 700_000):
        self.a, self.b = ByteTokens(vocabulary), PieceTokens(model)
        self._entries = entries
        #: Ids as text with the mark that follows: within a side, between sides, between groups.
        self._written = [f"{i}{mark}" for n in (self.a.size, self.b.size) for i in range(n) for mark in ",|;"]
        self._widths = np.array([len(x) for x in self._written], "i8")
        self._forget()

    def _forget(self) -> None:
        self._slots: dict[str, int] = {}
        self._tails: dict[str, int] = {}        # slots of marks, and of a line break with letters
        self._texts, self._pairs, self._runs = [""], _Pool(), _Pool()
        self._numbers = [np.zeros((1, 3), "i8")]

    def align(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str, np.ndarray] | None]:
        """Per text: tokens of A and B and groups, the groups as text, and all pair keys; None if it has no tokens."""
        if len(self._slots) > self._entries:
            self._forget()
        cut = [text.split(" ") if text else [] for text in texts]
        distinct = set(chain.from_iterable(cut))
        loose = {w for w in distinct if not w or w[0].isspace()}
        if loose:
            for i, words in enumerate(cut):
                if words and not loose.isdisjoint(words):
                    cut[i] = _words(texts[i])
            distinct = set(chain.from_iterable(cut))
        self._learn(distinct.difference(self._slots))
        if len(self._numbers) > 1:
            self._numbers = [np.concatenate(self._numbers)]
        find, written = self._slots.__getitem__, self._texts.__getitem__
        for words in cut:
            at = np.fromiter(map(find, words), "i8", len(words))
            if not at.all() or not len(at):
                yield None
                continue
            at = self._parts(at)
            yield self._numbers[0].take(at, 0).sum(0), ";".join(map(written, at.tolist())), self._pairs.gather(at)[0]

    def _parts(self, at: np.ndarray) -> np.ndarray:
        """The slots with those of its parts in place of each run."""
        run = at < 0
        lengths = np.ones(len(at), "i8")
        lengths[run] = self._runs.lengths[-at[run]]
        out = np.repeat(at, lengths)
        out[np.repeat(run, lengths)] = self._runs.gather(-at[run])[0]
        return out

    def _learn(self, new: set[str]) -> None:
        whole, parted = [], {}
        for word in new:
            if self.b.cut_at_borders and not word.isalpha() and _PARTED.fullmatch(word):
                parted[word] = _BORDER.split(word)
            else:
                whole.append(word)
        whole += {parts[0] for parts in parted.values()}.difference(new, self._slots)
        self._learn_whole(whole)
        tails = sorted({tail for parts in parted.values() for tail in parts[1:]}.difference(self._tails))
        for at in range(0, len(tails), _WORDS_PER_CALL):
            # A letter before each tail: marks would join those of another tail, and the first text must be a word.
            some = [x for tail in tails[at:at + _WORDS_PER_CALL] for x in (" a", tail)]
            first = self._align(some)
            self._tails.update(zip(some[1::2], range(first + 1, first + len(some), 2) if first else repeat(0)))
        runs, lengths = [], []
        for word, (head, *rest) in parted.items():
            run = [self._slots[head], *map(self._tails.__getitem__, rest)]
            if len(run) > 1 and min(run) > 0:
                self._slots[word] = -len(self._runs.starts) - len(lengths)
                runs += run
                lengths.append(len(run))
            elif word not in self._slots:
                self._slots[word] = self._align([" " + word])
        self._runs.add(np.array(runs, "i8"), np.array(lengths, "i8"))

    def _learn_whole(self, words: list[str]) -> None:
        together, alone = [], []
        for word in words:
            (alone if not word or word[-1] == " " or word[0].isspace() or "\u2581" in word else together).append(word)
        for at in range(0, len(together), _WORDS_PER_CALL):
            some = together[at:at + _WORDS_PER_CALL]
            first = self._align([" " + word for word in some])
            if first:
                self._slots.update(zip(some, range(first, first + len(some))))
            else:
                alone += some
        for word in alone:
            self._slots[word] = self._align([" " + word])

    def _align(self, words: list[str]) -> int:
        """Aligns texts, the first of which begins with a space, in one call of each library.

        Gives the slot of the first, the others follow; 0 if the bytes do not come back.
        """
        joined = "".join(words)
        a, b = self.a.spans(joined), self.b.spans(joined[1:])
        if a is None or b is None or not len(a[1]) or not len(b[1]) or a[1][-1] != b[1][-1]:
            return 0
        (a_ids, a_ends), (b_ids, b_ends) = a, b
        word_ends = np.cumsum([len(w.encode()) for w in words])
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        last_group = np.searchsorted(common, word_ends)
        if last_group[-1] >= len(common) or not np.array_equal(common[last_group], word_ends):
            return 0
        left, right = links(a_ends, b_ends)
        link_cuts = np.searchsorted(a_ends[left], word_ends, "right")
        first = len(self._texts)
        self._pairs.add((a_ids[left] << B_BITS) | b_ids[right], np.diff(link_cuts, prepend=0))
        a_cuts, b_cuts = (np.searchsorted(x, common, "right") for x in (a_ends, b_ends))
        self._numbers.append(np.diff(np.stack([a_cuts[last_group], b_cuts[last_group], last_group + 1], 1), axis=0,
                                     prepend=np.zeros((1, 3), "i8")))
        # All tokens in the order of their groups, A before B; the mark after each says what follows.
        place = np.concatenate([2 * np.searchsorted(common, a_ends), 2 * np.searchsorted(common, b_ends) + 1])
        order = np.argsort(place, kind="stable")
        code = 3 * np.concatenate([a_ids, b_ids + self.a.size])[order]
        code[:-1] += np.minimum(np.diff(place[order]), 1) + (place[order][:-1] & np.diff(place[order]))
        code[-1] += 2
        ends = np.cumsum(self._widths[code])[np.searchsorted(place[order], 2 * last_group + 1, "right") - 1]
        text = "".join(map(self._written.__getitem__, code.tolist()))
        self._texts += [text[i:j - 1] for i, j in zip([0, *ends.tolist()], ends.tolist())]
        return first


def _words(text: str) -> list[str]:
    """Parts that follow a space between non-spaces; white space at the end stays with the last."""
    found = _CUT.split(" " + text)
    if len(found) > 1 and found[-1].isspace():
        found[-2:] = ["".join(found[-2:])]
    return [part[1:] for part in found]


@functools.lru_cache(maxsize=1)
def aligner(vocabulary: str, model: str) -> Aligner:
    """One per Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # one task, one core
    return Aligner(vocabulary, model)


_NONE = np.empty(0, "i8")


def aligned(docs: DataFrame, vocabulary: str, model: str) -> DataFrame:
    """Each document's counts, the digest of its groups, and its distinct links with their numbers."""
    names = [f.split(" ")[0] for f in _ALIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, n_docs, n_links = TaskContext.get().partitionId() << 32, 0, 0, 0
        for batch in tokens.larger(batches):
            parts, counts, digests, pairs, times = [], [], [], [], []
            for found in aligner(vocabulary, model).align(batch["text"].to_pylist()):
                if found is None:
                    one, digest, keys, n = (0, 0, 0, 0), "", _NONE, _NONE
                else:
                    numbers, groups, every = found
                    keys, n = np.unique(every, return_counts=True)
                    one, digest = (*numbers.tolist(), len(every)), hashlib.sha256(groups.encode()).hexdigest()
                n_docs, n_links = n_docs + 1, n_links + len(keys)
                parts.append(task + number)
                counts.append(one)
                digests.append(digest)
                pairs.append(keys)
                times.append(n)
                if n_docs >= PART_DOCS or n_links >= PART_LINKS:
                    number, n_docs, n_links = number + 1, 0, 0
            columns = [pa.array(c, pa.int64()) for c in zip(*counts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.int64()), batch["doc_id"].cast(pa.int64()), *columns, pa.array(digests, pa.string()),
                 _lists(pairs, "i8"), _lists(times, "i4")], names)
    return docs.select("doc_id", "text").mapInArrow(run, _ALIGNED)


def _lists(arrays: list[np.ndarray], kind: str) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays).astype(kind)))


def pair_counts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(part, pair, n): how many documents link each pair, and the same per part."""
    per_part = shared.staged(rows.select("part", F.explode("pairs").alias("pair")).groupBy("part", "pair").agg(
        F.count("*").alias("n")), "part-pairs")
    return per_part, shared.staged(per_part.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")


def align(docs: DataFrame, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    """Per row of ``docs``: tokens of both sides, groups, links, links of the best pairs, and the sum of their counts."""
    shared.prepare(docs.sparkSession)
    given = default_models()
    rows = shared.staged(aligned(docs, vocabulary or given[0], model or given[1]), "aligned")
    per_part, counts = pair_counts(rows)
    most = counts.groupBy(F.shiftright("pair", B_BITS).alias("a")).agg(F.max("n").alias("most"))
    known = counts.withColumn("a", F.shiftright("pair", B_BITS)).join(most, "a").select(
        "pair", "n", (F.col("n") == F.col("most")).alias("best"))
    asked = per_part.select("part", "pair").join(known, "pair")
    return rows.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(_scored, ROWS)


def _scored(rows: pa.Table, asked: pa.Table) -> pa.Table:
    """The documents of a part with the counts of its pairs."""
    order = np.argsort(asked["pair"].to_numpy())
    pair, n, best = (asked[c].to_numpy()[order] for c in ("pair", "n", "best"))
    sums, bests = np.zeros(rows.num_rows, "i8"), np.zeros(rows.num_rows, "i8")
    at = 0
    for batch in rows.to_batches():
        lists, times = batch["pairs"], batch["times"].flatten().to_numpy()
        where = np.searchsorted(pair, lists.flatten().to_numpy())
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        for out, value in ((sums, n), (bests, best.astype("i8"))):
            total = np.concatenate([[0], np.cumsum(times * value[where])])
            out[at:at + batch.num_rows] = np.diff(total[offsets])
        at += batch.num_rows
    return rows.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"]).append_column(
        "n_best", pa.array(bests)).append_column("count_sum", pa.array(sums)).append_column("groups_sha256", rows["groups_sha256"])
