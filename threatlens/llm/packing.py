"""Best-fit packing of token sequences by exact-complement hashing.

Documents longer than the capacity are cut into pieces of exactly the capacity;
the first piece takes what is left over.  How pieces are combined depends on
their lengths alone, so the plan is made from the histogram of lengths - at
most ``capacity`` rows, whatever the corpus - and says "this combination, so
many times".  Single lengths, pair sums and triple sums are indexed; the
largest length left takes a combination that fills its gap exactly, as often
as the counts allow, and else the best fit, the largest length that still fits.
Every step uses up a length or at least halves its count, so the plan stays
small: at most capacity x log2(documents) combinations.

Pieces find their places by rank: the n-th piece of a length.  Ranks are exact
and need no window over a length that holds many rows: tasks number their own
pieces per length, and prefix sums over (length, task) give the bases.

Null and empty texts are one piece with the end id.  Repeated rows are packed
as often as they occur.  An empty table gives no rows.  Other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threatlens.llm import shared, tokens

CAPACITY = 1024
_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, ordinal long"
ROWS = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = tokens.END_ID) -> DataFrame:
    """One row per piece, numbered per task and length."""
    names = [f.split(" ")[0] for f in _PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, encoder = TaskContext.get().partitionId(), np.zeros(capacity + 1, "i8"), tokens.encoder(vocabulary)
        for batch in tokens.larger(batches):
            ids, offsets = tokens.with_end(*encoder.encode_column(batch["text"]), end_id)
            totals = np.diff(offsets)
            cuts = -(-totals // capacity)
            doc = np.repeat(np.arange(len(totals)), cuts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            first = (totals - 1) % capacity + 1         # the first piece takes what is left over
            start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[doc])
            data = memoryview(ids.astype("<u4")).cast("B")
            at = 4 * (offsets[doc] + start)
            sums = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start),
                 pa.array(length, pa.int32()), pa.array(sums, pa.int64()), pa.array(np.full(len(doc), part), pa.int32()),
                 pa.array(_ordinals(length, seen))], names)
    return docs.select("doc_id", "text").mapInArrow(run, _PIECES)


def _ordinals(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How many pieces of the same length the task had before each; ``seen`` goes on counting."""
    order = np.argsort(lengths, kind="stable")
    ranked, counts = lengths[order], np.bincount(lengths, minlength=len(seen))
    out = np.empty(len(lengths), "i8")
    out[order] = np.arange(len(lengths)) - (np.cumsum(counts) - counts)[ranked] + seen[ranked]
    seen += counts
    return out


class _Sums:
    """Which sums one, two or three of the lengths left can make."""

    def __init__(self, left: np.ndarray):
        have = (left > 0).astype("i8")
        have[0] = 0
        self.cap = len(left)
        self.pair = np.convolve(have, have)[:self.cap] > 0
        self.triple = np.convolve(self.pair.astype("i8"), have)[:self.cap] > 0

    def exact(self, gap: int, left: np.ndarray) -> list[int]:
        """Lengths of a sum of ``gap`` that the counts left allow, fewest pieces first; [] if none."""
        if left[gap] > 0:
            return [gap]
        if self.pair[gap] and (found := _pair(gap, left)):
            return found
        if self.triple[gap]:
            for a in np.flatnonzero(left[1:gap - 1])[::-1] + 1:     # the longest first
                if self.pair[gap - a]:
                    left[a] -= 1
                    found = _pair(gap - int(a), left)
                    left[a] += 1
                    if found:
                        return [int(a), *found]
        return []


def _pair(total: int, left: np.ndarray) -> list[int]:
    low = np.arange(1, total // 2 + 1)
    if not len(low):
        return []
    fits = np.minimum(left[low], left[total - low])
    if total % 2 == 0:
        fits[-1] = left[total // 2] // 2
    best = int(np.argmax(fits))             # the pair that can be used most often
    return [total - int(low[best]), int(low[best])] if fits[best] > 0 else []


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations and how often each is used: ({length: times in one sequence}, sequences)."""
    left = np.zeros(capacity + 1, "i8")
    for length, n in counts.items():
        left[length] = n
    made = [({capacity: 1}, int(left[capacity]))] if left[capacity] else []
    left = left[:capacity].copy()
    sums = _Sums(left)
    while left.any():
        used: Counter = Counter()
        gap, rest = capacity, left.copy()
        while gap:
            chosen = sums.exact(gap, rest) if used and gap < capacity else []
            if not chosen:
                fitting = np.flatnonzero(rest[1:gap + 1])
                if not len(fitting):
                    break
                chosen = [int(fitting[-1]) + 1]
            for length in chosen:
                used[length] += 1
                rest[length] -= 1
                gap -= length
        times = min(int(left[length]) // k for length, k in used.items())
        before = left > 0
        for length, k in used.items():
            left[length] -= k * times
        made.append((dict(used), times))
        if ((left > 0) != before).any():
            sums = _Sums(left)
    return made


def places(made: list[tuple[dict[int, int], int]], capacity: int = CAPACITY) -> dict[int, np.ndarray]:
    """For each length the runs of ranks that one combination takes: first rank, sequences, first sequence, offset."""
    rank, runs, sequence = Counter(), defaultdict(list), 0
    for used, times in made:
        offset = 0
        for length, k in used.items():
            runs[length].append((rank[length], times, sequence, offset))
            rank[length] += k * times
            offset += k * length
        sequence += times
    return {length: np.array(r, "i8") for length, r in runs.items()}


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with the sequence that holds it and its place there."""
    shared.prepare(docs.sparkSession)
    cut = shared.staged(pieces(docs, vocabulary or tokens.default_vocabulary(), capacity), "pieces")
    tallies = shared.staged(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "tallies")
    counts = {r.length: r.n for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = places(plan(counts, capacity), capacity)     # bounded by the capacity, not by the corpus
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = tallies.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = cut.join(ranked, ["length", "part"])

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length = batch["length"].to_numpy()
        rank = batch["base"].to_numpy() + batch["ordinal"].to_numpy()
        sequence, offset = np.zeros(len(length), "i8"), np.zeros(len(length), "i8")
        for one in np.unique(length):
            at = np.flatnonzero(length == one)
            run = runs[int(one)]
            first, times, base, begin = run[np.searchsorted(run[:, 0], rank[at], "right") - 1].T
            again, which = np.divmod(rank[at] - first, times)
            sequence[at], offset[at] = base + which, begin + again * one
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["piece"], batch["start"], batch["length"].cast(pa.int64()), batch["ids_crc32"],
             pa.array(sequence), pa.array(offset)],
            ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return shared.by_batch(rows, place, ROWS)
