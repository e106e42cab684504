"""Exact duplicates through a sharded cuckoo-filter index of text digests.

The key of a text is the SHA-256 of its UTF-8 bytes with A-Z in lower case; of
equal texts the row with the largest ``doc_id`` stays.  Tasks first reduce
their own rows to one entry per digest, entries go to shards by digest, and
each shard holds a cuckoo filter: two candidate buckets of four 16-bit
fingerprints.  A hit on a fingerprint is checked against the full 256-bit
digest stored with the slot, so false hits never merge texts.  If an insertion
finds no free slot, the table doubles and is refilled from the stored keys.
Deleting a digest empties its slot.

Rows with equal text and equal id: the first in file order stays.  Null texts
count as empty, a null ``doc_id`` as smaller than any other.  An empty table
gives no rows.  Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatlens.llm import shared

SLOTS = 4
KICKS = 200
#: Digests a shard is made for; a shard that gets more only grows its table.
SHARD_DIGESTS = 500_000

_DIGESTS = "row_no long, doc_id long, digest binary"
_ENTRIES = "digest binary, keep_id long, keep_row long, group_size long"


def digest_of(text: bytes) -> bytes:
    """``bytes.lower`` changes A-Z only."""
    return hashlib.sha256(text.lower()).digest()


class CuckooIndex:
    """Live digests and what is known of each, with insertion, deletion and growth."""

    def __init__(self, buckets: int = 1024):
        self._buckets = 1 << max(2, (buckets - 1).bit_length())
        self._marks = np.zeros(self._buckets * SLOTS, np.uint16)    # 0: empty
        self._slots: list[int] = [-1] * (self._buckets * SLOTS)     # index into the stored keys
        self._keys: list[bytes | None] = []
        self._values: list = []
        self._turn = 0
        self.live = 0

    def _address(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        first = int.from_bytes(digest[:8], "little") & (self._buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        """The partner bucket; the partner of the partner is the bucket again."""
        return bucket ^ (mark * 0x9E3779B1 & (self._buckets - 1))

    def _slot(self, digest: bytes) -> int:
        mark, first, second = self._address(digest)
        for bucket in (first, second):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self._marks[at] == mark and self._keys[self._slots[at]] == digest:
                    return at
        return -1

    def get(self, digest: bytes):
        at = self._slot(digest)
        return None if at < 0 else self._values[self._slots[at]]

    def put(self, digest: bytes, value) -> None:
        """Inserts a digest, or replaces the value of a live one."""
        at = self._slot(digest)
        if at >= 0:
            self._values[self._slots[at]] = value
            return
        self._keys.append(digest)
        self._values.append(value)
        self.live += 1
        self._insert(len(self._keys) - 1)

    def delete(self, digest: bytes) -> bool:
        at = self._slot(digest)
        if at < 0:
            return False
        self._keys[self._slots[at]] = self._values[self._slots[at]] = None
        self._marks[at], self._slots[at] = 0, -1
        self.live -= 1
        return True

    def _insert(self, key: int) -> None:
        mark, first, second = self._address(self._keys[key])
        for bucket in (first, second):
            if self._free(bucket, mark, key):
                return
        bucket = second
        for _ in range(KICKS):
            self._turn += 1
            at = bucket * SLOTS + self._turn % SLOTS        # one of the four moves to its other bucket
            moved, self._marks[at] = int(self._marks[at]), mark
            key, self._slots[at] = self._slots[at], key
            mark, bucket = moved, self._other(bucket, moved)
            if self._free(bucket, mark, key):
                return
        self._grow()

    def _free(self, bucket: int, mark: int, key: int) -> bool:
        for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if self._marks[at] == 0:
                self._marks[at], self._slots[at] = mark, key
                return True
        return False

    def _grow(self) -> None:
        """Twice the buckets, filled from the stored keys, the one without a slot among them."""
        kept = [(k, v) for k, v in zip(self._keys, self._values) if k is not None]
        grown = CuckooIndex(self._buckets * 2)
        for k, v in kept:
            grown.put(k, v)
        self.__dict__.update(grown.__dict__)

    @property
    def buckets(self) -> int:
        return self._buckets

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, v) for k, v in zip(self._keys, self._values) if k is not None)


def digests(docs: DataFrame) -> DataFrame:
    """row_no, doc_id and digest of every row."""
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [digest_of(t) for t in shared.raw_texts(batch["text"])]
        return pa.RecordBatch.from_arrays([batch["row_no"], batch["doc_id"], pa.array(found, pa.binary())],
                                          ["row_no", "doc_id", "digest"])
    return shared.by_batch(shared.numbered(docs, "doc_id", "text"), make, _DIGESTS)


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (keep_id, keep_row, size) the larger id, then the earlier row; sizes add up."""
    def rank(x):
        return (x[0] is not None, x[0] or 0, -x[1])
    top = a if rank(a) >= rank(b) else b
    return top[0], top[1], a[2] + b[2]


def _rows(index: CuckooIndex, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    found: list[tuple] = []
    for digest, value in index.items():
        found.append((digest, *value))
        if len(found) == size:
            yield _batch(found)
            found = []
    if found:
        yield _batch(found)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      ["digest", "keep_id", "keep_row", "group_size"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feeds entries to an index and gives back one for each live digest; size -1 deletes."""
    index = CuckooIndex()
    for batch in batches:
        for digest, *value in zip(*(c.to_pylist() for c in batch.columns)):
            if value[2] < 0:
                index.delete(digest)
                continue
            known = index.get(digest)
            index.put(digest, tuple(value) if known is None else _better(known, tuple(value)))
    yield from _rows(index)


def _sharded(entries: DataFrame, rows: int) -> DataFrame:
    shards = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // SHARD_DIGESTS))
    return entries.repartition(shards, F.substring("digest", 11, 8))


def build(found: DataFrame, rows: int) -> DataFrame:
    """The index of all ``rows`` digests in ``found``: one entry for each text."""
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _merge(pa.RecordBatch.from_arrays(
            [b["digest"], b["doc_id"], b["row_no"], pa.array(np.ones(b.num_rows, "i8"))],
            ["digest", "keep_id", "keep_row", "group_size"]) for b in batches if b.num_rows)
    return _sharded(found.mapInArrow(local, _ENTRIES), rows).mapInArrow(_merge, _ENTRIES)


def update(index: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """The index after withdrawing the texts of ``deleted`` and then adding those of ``inserted``."""
    spark = shared.prepare(index.sparkSession)
    gone = digests(deleted).select("digest", F.lit(None).cast("long").alias("keep_id"),
                                   F.lit(0).cast("long").alias("keep_row"), F.lit(-1).cast("long").alias("group_size"))
    new = build(digests(inserted), inserted.count())
    steps = [rows.select("*", F.lit(i).alias("step")) for i, rows in enumerate((index, gone, new))]
    rows = steps[0].unionByName(steps[1]).unionByName(steps[2])
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(shards, F.substring("digest", 11, 8)).sortWithinPartitions("step").drop("step")
            .mapInArrow(_merge, _ENTRIES))


def duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: row_no, doc_id, digest, keep_id, keep_row, group_size."""
    shared.prepare(docs.sparkSession)
    found = shared.staged(digests(docs), "digests")
    total = found.count()
    groups = shared.staged(build(found, total), "digest-index")
    return shared.look_up(found, groups, "digest", "group_size", total)


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; ``docs`` must be read from files."""
    stay = duplicates(docs).where("row_no = keep_row")
    return shared.only_rows(docs, stay)
