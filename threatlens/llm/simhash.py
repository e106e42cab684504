"""SimHash near duplicates by multi-index hashing.

A fingerprint has 64 bits, one for each bit position that is set in more than
half of the hashes of a text's word shingles.  Texts link when fingerprints
differ in at most three bits.  Such fingerprints agree, up to one bit, in one
of their two 32-bit segments: so each distinct fingerprint is entered in a
table under both segments, and looks up the Hamming ball of radius one around
each.  Of two segments that differ in one bit, one has that bit set; it is
enough that every fingerprint clears its set bits in turn, which halves the
ball.  Fetched pairs are kept if the complete distance is at most three.

Equal fingerprints are one row from the start, so copies never form pairs.  A
segment value shared by more than ``bucket`` distinct fingerprints gets a
second level: the other segment, then within three bits, is cut in two 16-bit
parts, one of which agrees up to one bit, and the join takes that part too.

A text without words has fingerprint zero and links like any other.  Rows with
equal ids count as separate rows of the same text or not; each gets its row.
Null ids are never the smallest of a component unless all its ids are null.
An empty table gives no rows.  Other columns do not matter.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlens.llm import shared
from threatlens.llm.components import components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BUCKET = 4096
_BLOCK = 1 << 16        # shingles hashed at a time: memory does not grow with the text
_ASKED = 17             # keys that a fingerprint looks up in a segment: its own, and half its bits cleared
_PRINTS = "row_no long, doc_id long, fingerprint long"


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The fingerprint of UTF-8 bytes, unsigned; ``bytes.split`` cuts at x20 and x09-x0D only."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        m = min(_BLOCK, n - at)
        runs = map(b" ".join, zip(*(words[at + i:at + i + m] for i in range(size)))) if len(words) >= size \
            else [b" ".join(words)]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, m)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """row_no, doc_id and fingerprint (its bits as a signed long) of every row."""
    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, size) for t in shared.raw_texts(batch["text"])], np.uint64)
        return pa.RecordBatch.from_arrays([batch["row_no"], batch["doc_id"], pa.array(found.view(np.int64))],
                                          ["row_no", "doc_id", "fingerprint"])
    return shared.by_batch(shared.numbered(docs, "doc_id", "text"), make, _PRINTS)


def _bits(width: int) -> Column:
    return F.array(*[F.lit(1 << i).cast("long") for i in range(width)])


def _segment(column: str, which: int, width: int = 32) -> Column:
    return F.shiftrightunsigned(F.col(column), which * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _keyed(which: int, value: Column, width: int = 32) -> Column:
    """A segment's number and value in one long."""
    return value.bitwiseOR(F.lit(which << width).cast("long"))


def _with_number(which: int):
    return lambda value: _keyed(which, value)


def _cleared(value: Column, width: int = 32) -> Column:
    """The values with one set bit less."""
    return F.transform(F.filter(_bits(width), lambda bit: value.bitwiseAND(bit) != 0), lambda bit: value - bit)


def near_pairs(prints: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): distinct fingerprints of the column ``fingerprint`` that differ in at most ``max_bits`` bits.

    A pair may come twice, once from each segment.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments and balls of radius one reach up to three bits")
    table = prints.select(F.col("fingerprint").alias("b"), F.explode(F.array(
        *[_keyed(i, _segment("fingerprint", i)) for i in range(2)])).alias("key"))
    balls = F.array(*[F.struct(F.lit(True).alias("same"), F.array(_keyed(i, _segment("fingerprint", i))).alias("keys"))
                      for i in range(2)],
                    *[F.struct(F.lit(False).alias("same"), F.transform(
                        _cleared(_segment("fingerprint", i)), _with_number(i)).alias("keys"))
                      for i in range(2)])
    probes = prints.select(F.col("fingerprint").alias("a"), F.inline(balls)).select(
        "a", "same", F.explode("keys").alias("key"))
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits) & (~F.col("same") | (F.col("a") < F.col("b")))
    stored = 2 * prints.count()
    busy = shared.staged(table.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("key"),
                         "busy-segments", stored)
    if not busy.limit(1).count():
        return shared.dealt(probes.join(table, "key").where(near).select("a", "b"), (1 + _ASKED) * stored)
    calm = probes.join(busy, "key", "left_anti").join(table, "key").where(near).select("a", "b")
    return calm.unionByName(_second_level(probes.join(busy, "key"), table.join(busy, "key"), near))


def _second_level(probes: DataFrame, table: DataFrame, near: Column) -> DataFrame:
    """Pairs of busy segment values: also one 16-bit part of the other segment agrees up to one bit."""
    def other(column):      # key bit 32 tells which segment the key is of
        return F.when(F.shiftright("key", 32) == 0, _segment(column, 1)).otherwise(_segment(column, 0)).alias("other")

    def parts():
        return [F.shiftrightunsigned("other", 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")) for i in range(2)]

    def flipped(i, part):
        return lambda bit: _keyed(i, part.bitwiseXOR(bit), 16)
    stored = table.select("*", other("b")).select("b", "key", F.explode(F.array(
        *[_keyed(i, p, 16) for i, p in enumerate(parts())])).alias("part"))
    asked = probes.select("*", other("a")).select("a", "same", "key", F.explode(F.concat(*[
        F.transform(F.concat(F.array(F.lit(0).cast("long")), _bits(16)),
                    flipped(i, p)) for i, p in enumerate(parts())])).alias("part"))
    return asked.join(stored, ["key", "part"]).where(near).select("a", "b").distinct()


def classes(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: row_no, doc_id, fingerprint, component_id and component_row.

    ``component_id`` is the smallest id that links reach; ``component_row`` is the
    first of the rows that have it, so exactly one row of a component is its own.
    """
    shared.prepare(docs.sparkSession)
    found = shared.staged(fingerprints(docs, size), "fingerprints")
    rows = found.count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no")).alias("first")
    prints = shared.staged(found.groupBy("fingerprint").agg(F.count("*").alias("copies"), first), "prints", rows)
    links = shared.staged(near_pairs(prints.select("fingerprint"), max_bits), "near-pairs")
    labels = components(links).withColumnRenamed("node", "fingerprint")
    linked = prints.join(labels, "fingerprint")
    linked = shared.staged(linked, "linked-prints", rows)
    roots = shared.staged(linked.groupBy("label").agg(F.min("first").alias("root"), F.count("*").alias("members")),
                          "components", rows)
    placed = shared.look_up(linked, roots, "label", "members", linked.count())
    alone = prints.join(labels, "fingerprint", "left_anti").select("fingerprint", "copies", F.col("first").alias("root"))
    every = placed.select("fingerprint", "copies", "root").unionByName(alone)
    joined = shared.dealt(shared.look_up(found, every, "fingerprint", "copies", rows), rows)
    return joined.select("row_no", "doc_id", "fingerprint", F.col("root.doc_id").alias("component_id"),
                         F.col("root.row_no").alias("component_row"))


def representatives(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component, with its columns; ``docs`` must be read from files."""
    stay = classes(docs, size, max_bits).where("row_no = component_row")
    return shared.only_rows(docs, stay)
