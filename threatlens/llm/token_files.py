"""Token-id output: flat unsigned integer files with 64-bit document offsets, read by memory mapping.

Documents are range-partitioned by ``doc_id``; each task encodes its own range
and writes three flat files per part, whose names carry the part number:

* ``part-N.ids``      token ids, 16 bits wide if the vocabulary fits, else 32, little-endian
* ``part-N.offsets``  unsigned 64-bit, one more than documents: where each document begins in the part
* ``part-N.docs``     signed 64-bit document ids, then one byte per document that is 1 where the id is null

A part's base, the tokens and documents of all parts before it, is a prefix sum
over the manifest (one row per part).  Files appear under their names by one
atomic rename, and a repeated task writes the same bytes, so a lost executor
costs its tasks only.  The folder must be a file system that all executors
mount, as memory mapping needs one.

Null and empty texts hold the end id only.  Documents with equal ids follow in
the order of their texts; null ids come first.  An empty table writes no part
and reads back as no rows.  Other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlens import session
from threatlens.llm import shared, tokens

MANIFEST = "part int, n_docs long, n_tokens long, id_bytes int"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def local_path(folder: str) -> str:
    """The mounted path of a folder given as a path or a ``file:`` URI."""
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    if "://" in folder:
        raise ValueError(f"token files need a mounted folder, not {folder}")
    return folder


def part_path(folder: str, part: int, kind: str) -> str:
    return os.path.join(folder, f"part-{part:06d}.{kind}")


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = tokens.END_ID) -> DataFrame:
    """Writes the token files of ``docs`` and returns their manifest."""
    vocabulary = vocabulary or tokens.default_vocabulary()
    target = local_path(folder)
    os.makedirs(target, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, mark = context.partitionId(), f"{context.taskAttemptId()}.tmp"
        encoder, out = None, None
        offsets, ids, nulls = [np.zeros(1, "i8")], [], []
        for batch in tokens.larger(batches):
            if out is None:
                encoder = tokens.encoder(vocabulary)
                width = np.dtype("<u2" if max(encoder.vocabulary_size - 1, end_id) < 1 << 16 else "<u4")
                out = open(part_path(target, part, f"ids.{mark}"), "wb")
            found, ends = tokens.with_end(*encoder.encode_column(batch["text"]), end_id)
            out.write(found.astype(width).tobytes())
            offsets.append(offsets[-1][-1] + ends[1:])
            ids.append(batch["doc_id"].fill_null(0).to_numpy())
            nulls.append(batch["doc_id"].is_null().to_numpy(zero_copy_only=False))
        if out is None:
            return
        out.close()
        _place(part_path(target, part, f"ids.{mark}"), part_path(target, part, "ids"))
        n_docs, n_tokens = sum(map(len, ids)), int(offsets[-1][-1])
        _save(np.concatenate(offsets).astype("<u8").tobytes(), target, part, "offsets", mark)
        _save(np.concatenate(ids).astype("<i8").tobytes() + np.concatenate(nulls).astype("u1").tobytes(), target, part,
              "docs", mark)
        yield pa.RecordBatch.from_pylist([{
            "part": part, "n_docs": n_docs, "n_tokens": n_tokens, "id_bytes": width.itemsize}],
            pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("id_bytes", pa.int32())]))

    order = ["doc_id", "tie"]
    ordered = (docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange(*order)
               .sortWithinPartitions(*order, "text").select("doc_id", "text"))
    return session.stage(ordered.mapInArrow(run, MANIFEST), os.path.join(folder, "manifest"))


def _place(made: str, final: str) -> None:
    os.replace(made, final)


def _save(data: bytes, folder: str, part: int, kind: str, mark: str) -> None:
    made = part_path(folder, part, f"{kind}.{mark}")
    with open(made, "wb") as out:
        out.write(data)
    _place(made, part_path(folder, part, kind))


def bases(manifest: DataFrame) -> list[dict]:
    """Each part with the tokens and documents before it; as many rows as there are parts."""
    parts = sorted((r.asDict() for r in manifest.collect()), key=lambda r: r["part"])
    before = itertools.accumulate((p["n_tokens"] for p in parts), initial=0)
    ahead = itertools.accumulate((p["n_docs"] for p in parts), initial=0)
    return [p | {"base": b, "first_doc": d} for p, b, d in zip(parts, before, ahead)]


def open_part(folder: str, part: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Memory maps of a part: ids, offsets, document ids, null marks."""
    folder, n = local_path(folder), part["n_docs"]
    ids = np.memmap(part_path(folder, part["part"], "ids"), f"<u{part['id_bytes']}", "r")
    offsets = np.memmap(part_path(folder, part["part"], "offsets"), "<u8", "r")
    path = part_path(folder, part["part"], "docs")
    return ids, offsets, np.memmap(path, "<i8", "r", shape=n), np.memmap(path, "u1", "r", offset=8 * n, shape=n)


def read(spark: SparkSession, folder: str, rows_per_batch: int = 10_000) -> DataFrame:
    """One row per document, from the files: its place in the whole corpus and a checksum of its ids."""
    parts = bases(spark.read.schema(MANIFEST).parquet(os.path.join(folder, "manifest")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                ids, offsets, docs, nulls = open_part(folder, parts[i])
                for at in range(0, parts[i]["n_docs"], rows_per_batch):
                    to = min(at + rows_per_batch, parts[i]["n_docs"])
                    ends = np.asarray(offsets[at:to + 1]).astype("i8")
                    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends, ends[1:])]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.array(docs[at:to]), mask=np.array(nulls[at:to], bool)),
                        pa.array(ends[:-1] + parts[i]["base"]), pa.array(np.diff(ends)),
                        pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
    return spark.range(0, len(parts), 1, max(1, len(parts))).mapInArrow(run, ROWS)


def write_and_read(docs: DataFrame, folder: str, vocabulary: str | None = None) -> DataFrame:
    shared.prepare(docs.sparkSession)
    write(docs, folder, vocabulary)
    return read(docs.sparkSession, folder)
