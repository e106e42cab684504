"""Repeated sentence spans across documents.

Texts are cut into sentences; every run of several consecutive sentences is
hashed, the hashes are joined over the whole corpus, and all occurrences of a
run but the first are repeats: the sentences that they cover are removed.  The
first occurrence is the one in the smallest ``doc_id``, nearest its beginning,
so one copy of any repeated passage stays.

A run starts at a sentence and takes as few sentences as hold ``WORDS`` words,
``RUN`` at least: stock phrases are no repeats.  A sentence ends after ``.``,
``!``, ``?`` or ``|`` at white space or at a line break; past ``LONG`` words it also
ends at words chosen by their hash, so that passages without marks are cut alike
wherever they stand.  Sentences are compared by their words, runs by 128-bit
hashes.

Null and empty texts have no sentences and stay as they are.  Rows with equal
ids are separate documents, in file order.  A null id comes last.  An empty
table gives no rows.  Other columns do not matter.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlens.llm import shared

RUN = 3
WORDS = 20
LONG = 8

_WORD = re.compile(rb"([^\x20\x09-\x0D]+)([\x20\x09-\x0D]*)")
_MARKS = frozenset(b".!?|")
_RUNS = "row_no long, doc_id long, place int, sentences int, digest binary"
ROWS = "row_no long, doc_id long, removed array<int>, text string"


def sentences(text: bytes) -> list[tuple[int, int, list[bytes]]]:
    """(start, end, words) of each sentence in bytes; the white space after a sentence belongs to it."""
    out, words, start, at = [], [], 0, len(text) - len(text.lstrip())
    for word, gap in _WORD.findall(text):
        words.append(word)
        at += len(word) + len(gap)
        if word[-1] in _MARKS or b"\n" in gap or (len(words) >= LONG and not zlib.crc32(word) & 3):
            out.append((start, at, words))
            start, words = at, []
    if words:
        out.append((start, len(text), words))
    return out


def _plain(text: bytes) -> tuple[list[bytes], list[int]]:
    """The words of each sentence, joined by spaces, and their number; without places, lines are cut by themselves."""
    found, sizes = [], []
    for line in text.split(b"\n"):
        words, start = line.split(), 0
        for i, word in enumerate(words, 1):
            if word[-1] in _MARKS or (i - start >= LONG and not zlib.crc32(word) & 3):
                found.append(b" ".join(words[start:i]))
                sizes.append(i - start)
                start = i
        if start < len(words):
            found.append(b" ".join(words[start:]))
            sizes.append(len(words) - start)
    return found, sizes


def runs(text: bytes, size: int = RUN, least: int = WORDS) -> list[tuple[int, int, bytes]]:
    """(index of the first sentence, number of sentences, digest) of every run."""
    found, sizes = _plain(text)
    out = []
    end, held = 0, 0        # sentences before ``end`` from ``i`` on hold ``held`` words
    for i in range(len(found)):
        while end < len(found) and (end - i < size or held < least):
            held += sizes[end]
            end += 1
        if end - i < size or held < least:
            break           # the text ends first, here and for all later starts
        out.append((i, end - i, xxhash.xxh128_digest(b"\n".join(found[i:end]))))
        held -= sizes[i]
    return out


def repeated_runs(docs: DataFrame, size: int = RUN, least: int = WORDS) -> DataFrame:
    """row_no, place, sentences and first_id of every run that is not the first of its kind."""
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [runs(t, size, least) for t in shared.raw_texts(batch["text"])]
        row = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
        places = list(zip(*(r for f in found for r in f))) or [[]] * 3
        return pa.RecordBatch.from_arrays(
            [batch["row_no"].take(row), batch["doc_id"].take(row),
             *[pa.array(c, k) for c, k in zip(places, (pa.int32(), pa.int32(), pa.binary()))]],
            ["row_no", "doc_id", "place", "sentences", "digest"])
    every = shared.staged(shared.by_batch(shared.numbered(docs, "doc_id", "text"), make, _RUNS), "sentence-runs")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no", "place")
    groups = shared.staged(every.groupBy("digest").agg(F.count("*").alias("n"), F.min(first).alias("first"))
                           .where(F.col("n") > 1), "repeated-runs")
    joined = shared.look_up(every, groups, "digest", "n", every.count())
    return joined.where(first != F.col("first")).select(
        "row_no", "place", "sentences", F.col("first.doc_id").alias("first_id"))


def deduplicated(docs: DataFrame, size: int = RUN, least: int = WORDS) -> DataFrame:
    """row_no, doc_id, removed (indices of sentences, null for none) and the text left, of every row.

    ``docs`` must be read from files.
    """
    shared.prepare(docs.sparkSession)
    covered = repeated_runs(docs, size, least).groupBy("row_no").agg(
        F.collect_set(F.struct("place", "sentences")).alias("places"))
    covered = shared.staged(covered, "covered-runs")
    rows = shared.numbered(docs, "doc_id", "text").join(covered, "row_no", "left")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        gone, left = [], []
        for raw, places in zip(batch["text"].cast(pa.binary()).to_pylist(), batch["places"].to_pylist()):
            out = {i for p in places or () for i in range(p["place"], p["place"] + p["sentences"])}
            if out:
                raw = b"".join(raw[a:b] for i, (a, b, _) in enumerate(sentences(raw)) if i not in out)
            gone.append(sorted(out) if out else None)
            left.append(raw)
        return pa.RecordBatch.from_arrays(
            [batch["row_no"], batch["doc_id"], pa.array(gone, pa.list_(pa.int32())),
             pa.array(left, pa.binary()).cast(pa.string())], ["row_no", "doc_id", "removed", "text"])
    return shared.by_batch(rows.select("row_no", "doc_id", "text", "places"), make, ROWS)
