"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by document: a shard holds some documents that one
task reads (at most ``SHARD_DOCS``, or fewer with many words) and stores, for
each term of the tests, the sorted places of that term among the words of the
shard.  Places of different documents are ``GAP`` apart, so no phrase crosses
two of them.  A shard is one row of a table in the shared folder and is answered
where it is read, by itself: lists are never shuffled, and a lost executor costs
the shards it was working on.  The table's row groups are bounded in bytes, so a
task holds some shards at a time, however many it reads.

A phrase is answered from its rarest term: the places of that term in the shard,
less its offset in the phrase, are candidate beginnings, and the lists of the
other terms, rarest first, are intersected with them at their own offsets.  A
phrase with a term that a shard lacks is given up at once.

Only terms of the tests are stored: others cannot be asked for.  They go to the
tasks as sorted 64-bit hashes, ``MAX_TERMS`` (16 MB) at a time: larger test sets
are cut into groups of items, each answered by a pass of its own.

Words are lower-cased in ASCII and cut at every ASCII character that is no
letter or digit.  An item's phrases are its windows of ``WINDOW`` consecutive
words; an item of fewer words, but not none, is one phrase.  Null and empty
texts have no words.  Long texts are read whole.  Items of equal id count as
one; an item without an id marks words but is not counted or listed.  Repeated
documents are answered one by one.  An empty table of documents gives no rows,
an empty one of items no hits.  Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlens import session
from threatlens.llm import shared

WINDOW = 10
SHARD_DOCS, SHARD_WORDS = 1000, 1 << 20
ROW_GROUP = 16 << 20    # bytes of shards that are written or read together
GAP = 1 << 10           # more than any reach of a phrase; see ``_reach``
MAX_TERMS = 1 << 21
_SEED = 42
_KEPT = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()
INDEX = "shard long, docs binary, terms binary, starts binary, places binary"


def words(text: bytes) -> list[bytes]:
    return text.translate(_KEPT).split()


def term(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, _SEED) >> 1     # never negative, as signed 64-bit


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, terms): the distinct phrases of each item."""
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, found = [], []
        for item_id, text in zip(batch["item_id"].to_pylist(), shared.raw_texts(batch["text"])):
            terms = [term(w) for w in words(text)]
            windows = {tuple(terms[i:i + window]) for i in range(max(1, len(terms) - window + 1))} if terms else ()
            ids += [item_id] * len(windows)
            found += map(list, sorted(windows))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, batch["item_id"].type), pa.array(found, pa.list_(pa.int64()))], ["item_id", "terms"])
    kind = items.schema["item_id"].dataType.simpleString()
    return shared.by_batch(items.select("item_id", "text"), make, f"item_id {kind}, terms array<long>").distinct()


def build(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """The index of ``docs`` for the given sorted term hashes: a row per shard."""
    known = {int(t): i for i, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, cache = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            texts, at = shared.raw_texts(batch["text"]), 0
            while at < len(texts):
                ids, counts, total = [], [], 0
                begin = at
                while at < len(texts) and at - begin < SHARD_DOCS and total < SHARD_WORDS:
                    found = words(texts[at])
                    for new in [w for w in set(found) if w not in cache]:
                        cache[new] = known.get(term(new), -1)
                    ids.append(np.fromiter(map(cache.__getitem__, found), "i4", len(found)))
                    counts.append(len(found))
                    total += len(found)
                    at += 1
                if len(cache) > 1_000_000:
                    cache = {}
                yield _shard((part << 32) + number, batch["doc_id"][begin:at], ids, np.array(counts, "i8"), terms)
                number += 1
    return docs.select("doc_id", "text").mapInArrow(run, INDEX)


def _shard(shard: int, doc_ids: pa.Array, ids: list[np.ndarray], counts: np.ndarray, terms: np.ndarray) -> pa.RecordBatch:
    base = np.cumsum(counts + GAP) - counts - GAP
    flat = np.concatenate(ids)
    at = np.flatnonzero(flat >= 0)
    place = at + np.repeat(base - np.cumsum(counts) + counts, counts)[at]
    order = np.argsort(flat[at], kind="stable")
    held, first = np.unique(flat[at][order], return_index=True)
    directory = np.stack([np.asarray(doc_ids.is_null()).astype("<i8"), doc_ids.fill_null(0).cast(pa.int64()).to_numpy(), counts])
    columns = [directory.astype("<i8"), terms[held].astype("<i8"), np.append(first, len(order)).astype("<i8"),
               place[order].astype("<i4")]
    return pa.RecordBatch.from_arrays([pa.array([shard]), *(pa.array([c.tobytes()], pa.binary()) for c in columns)],
                                      ["shard", "docs", "terms", "starts", "places"])


def stored(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """The index, written to the shared folder in row groups of about ``ROW_GROUP`` bytes, and read back."""
    index = build(docs, terms)
    path = session.fresh_path(docs.sparkSession, "positions")
    index.write.option("parquet.block.size", ROW_GROUP).option("parquet.page.size.row.check.min", 1).parquet(path)
    return docs.sparkSession.read.schema(index.schema).parquet(path)


class Shard:
    """The lists of one shard, a row of the index."""

    def __init__(self, row: dict):
        self.no_id, self.doc_ids, self.counts = np.frombuffer(row["docs"], "<i8").reshape(3, -1)
        self.bases = np.cumsum(self.counts + GAP) - self.counts - GAP
        self._place_of = {t: i for i, t in enumerate(np.frombuffer(row["terms"], "<i8").tolist())}
        starts = np.frombuffer(row["starts"], "<i8")
        self._starts, self._sizes = starts.tolist(), np.diff(starts).tolist()
        self._places = np.frombuffer(row["places"], "<i4")

    def list_of(self, term: int) -> np.ndarray:
        i = self._place_of[term]
        return self._places[self._starts[i]:self._starts[i + 1]]

    def _by_rarity(self, terms: list[int]) -> list[int] | None:
        """Indices of the terms, those of the shortest lists first; None if one has no list."""
        if any(t not in self._place_of for t in terms):
            return None
        return sorted(range(len(terms)), key=lambda i: self._sizes[self._place_of[terms[i]]])

    def exact(self, terms: list[int]) -> np.ndarray:
        """Places where the phrase begins."""
        order = self._by_rarity(terms)
        if order is None:
            return _NONE
        begins = self.list_of(terms[order[0]]) - order[0]
        for i in order[1:]:
            if not len(begins):
                break
            begins = begins[_held(self.list_of(terms[i]), begins + i)]
        return begins

    def near(self, terms: list[int], within: int) -> np.ndarray:
        """Places of the phrase's rarest term that have each other term at most ``within`` words away."""
        if within >= GAP:
            raise ValueError(f"within must stay below {GAP}")
        order = self._by_rarity(terms)
        if order is None:
            return _NONE
        at = self.list_of(terms[order[0]])
        for i in order[1:]:
            other = self.list_of(terms[i])
            at = at[np.searchsorted(other, at - within, "left") < np.searchsorted(other, at + within, "right")]
        return at

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bases, places, "right") - 1


_NONE = np.empty(0, "i4")


def _held(places: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Which of the places asked for are in the sorted list."""
    at = np.minimum(np.searchsorted(places, asked), len(places) - 1)
    return places[at] == asked


def _passes(asked: DataFrame) -> Iterator[list[tuple]]:
    """The phrases in runs of at most ``MAX_TERMS`` terms, by item; one run for all but huge test sets."""
    some, size = [], 0
    for row in asked.orderBy(F.col("item_id").cast("string")).toLocalIterator():
        if some and size + len(row.terms) > MAX_TERMS:
            yield some
            some, size = [], 0
        some.append((row.item_id, row.terms))
        size += len(row.terms)
    yield some


def _answered(index: DataFrame, answer: Callable[[Shard], pa.Table], schema: str) -> DataFrame:
    """What each shard answers, where it is read; shards are bounded."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                out = answer(Shard(row))
                yield from out.append_column("shard", pa.array([row["shard"]] * out.num_rows, pa.int64())).to_batches()
    return index.mapInArrow(run, f"{schema}, shard long")


def _item_groups(some: list[tuple]) -> dict[tuple, list]:
    asked = defaultdict(list)
    for item_id, terms in some:
        asked[tuple(terms)].append(item_id)
    return asked


def _reach(some: list[tuple]) -> None:
    if any(len(terms) >= GAP for _, terms in some):
        raise ValueError(f"phrases must stay below {GAP} words")


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, within: int | None = None) -> DataFrame:
    """(doc_id, item_id, first, length): exact occurrences of the items' phrases, ``first`` counting words from 0.

    With ``within``, proximity matches: ``first`` is a place of the phrase's rarest term in its shard that
    has each other term of the phrase at most so many words away, in any order.
    """
    shared.prepare_small(docs.sparkSession)
    kind = "string" if items.schema["item_id"].dataType.simpleString() == "string" else "bigint"
    out = None
    for some in _passes(shared.staged(phrases(items, window), "test-phrases")):
        _reach(some)
        asked = _item_groups(some)
        index = stored(docs, _terms(some))

        found = _answered(index, _matched(asked, within, kind), f"doc_id long, item_id {kind}, first long, length long").drop("shard")
        out = found if out is None else out.unionByName(found)
    return out


def _matched(asked: dict[tuple, list], within: int | None, kind: str) -> Callable[[Shard], pa.Table]:
    types = [pa.int64(), pa.string() if kind == "string" else pa.int64(), pa.int64(), pa.int64()]

    def answer(shard: Shard) -> pa.Table:
        rows = []
        for terms, item_ids in asked.items():
            places = shard.exact(terms) if within is None else shard.near(terms, within)
            held = shard.document(places)
            rows += [(None if shard.no_id[d] else int(shard.doc_ids[d]), item, int(p - shard.bases[d]), len(terms))
                     for d, p in zip(held, places) for item in item_ids]
        columns = list(zip(*rows)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "item_id", "first", "length"])
    return answer


def _terms(some: list[tuple]) -> np.ndarray:
    return np.unique(np.array([t for _, terms in some for t in terms], "i8"))


ROWS = "doc long, doc_id long, n_words long, hit array<struct<first:long,length:long>>, items array<string>"


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, the ranges of words that phrases hit (apart, in order), and the items found."""
    shared.prepare_small(docs.sparkSession)
    found = []
    for some in _passes(shared.staged(phrases(items, window), "test-phrases")):
        _reach(some)
        asked = {terms: [str(i) for i in item_ids if i is not None] for terms, item_ids in _item_groups(some).items()}
        index = stored(docs, _terms(some))

        found.append(_answered(index, _hit(asked), ROWS))
    if len(found) == 1:
        return found[0].drop("shard", "doc")
    return _together(found)


def _hit(asked: dict[tuple, list[str]]) -> Callable[[Shard], pa.Table]:
    def answer(shard: Shard) -> pa.Table:
        begins, lengths, held = [_NONE], [_NONE], defaultdict(set)
        for terms, item_ids in asked.items():
            places = shard.exact(terms)
            if len(places):
                begins.append(places)
                lengths.append(np.full(len(places), len(terms)))
                for d in np.unique(shard.document(places)).tolist():
                    held[d].update(item_ids)
        first, length, doc = _united(shard, np.concatenate(begins), np.concatenate(lengths))
        n = len(shard.counts)
        ranges = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()),
            pa.StructArray.from_arrays([pa.array(first, pa.int64()), pa.array(length, pa.int64())], ["first", "length"]))
        return pa.table({"doc": pa.array(np.arange(n)), "doc_id": pa.array(shard.doc_ids, mask=shard.no_id > 0),
                         "n_words": pa.array(shard.counts), "hit": ranges,
                         "items": pa.array([sorted(held.get(d, ())) for d in range(n)], pa.list_(pa.string()))})
    return answer


def _together(found: list[DataFrame]) -> DataFrame:
    """The answers of several passes, whose shards hold the same documents."""
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)

    def run(table: pa.Table) -> pa.Table:
        by_doc = defaultdict(list)
        for row in table.to_pylist():
            by_doc[row["doc"]].append(row)
        out = []
        for _, some in sorted(by_doc.items()):
            first, length = _overlaid(np.array([[r["first"], r["length"]] for row in some for r in row["hit"]], "i8").reshape(-1, 2))
            out.append(some[0] | {"hit": [{"first": a, "length": b} for a, b in zip(first.tolist(), length.tolist())],
                                  "items": sorted({i for row in some for i in row["items"]})})
        return pa.Table.from_pylist(out, table.schema)
    return rows.groupBy("shard").applyInArrow(run, f"{ROWS}, shard long").drop("shard", "doc")


def _overlaid(ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges (first, length) with overlapping and touching ones as one, in order."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    begins, ends = ranges[:, 0], np.maximum.accumulate(ranges.sum(1))
    if not len(begins):
        return _NONE, _NONE
    opens = np.concatenate([[True], begins[1:] > ends[:-1]])
    first = begins[opens]
    return first, ends[np.concatenate([opens[1:], [True]])] - first


def _united(shard: Shard, begins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hit ranges of a shard: first word in its document, words, document; gaps keep documents apart."""
    first, length = _overlaid(np.stack([begins, lengths], 1))
    doc = shard.document(first)
    return first - shard.bases[doc], length, doc
