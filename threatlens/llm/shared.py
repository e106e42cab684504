"""Helpers the corpus operators share: sessions, row numbers, staged tables, skew-proof look-ups."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlens import session

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: A key counts as hot from this share of all rows on, so at most 1,000 keys can be hot.
HOT_SHARE = 1000
HOT_LEAST = 1000

#: Rows of a few numbers that a task should have at least, before another task is worth its start and its file.
TASK_ROWS = 1 << 17


def prepare(spark: SparkSession) -> SparkSession:
    """Batches to Python are bounded in rows and bytes, whatever the length of a text.

    Python workers find this package as the driver did, also where PYTHONPATH does not say so.
    """
    session.prepare(spark)
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if _ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, known]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        # Else the splits of a small table, and with them row numbers, follow the executors alive just then.
        spark.conf.set("spark.sql.files.minPartitionNum", str(max(8, spark.sparkContext.defaultParallelism)))
    return spark


def prepare_small(spark: SparkSession) -> SparkSession:
    """As ``prepare``, with a quarter of the bytes in a batch; files are read by 256 rows, not 4,096 whole texts, at a time."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "256")
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def numbered(docs: DataFrame, *columns: str, name: str = "row_no") -> DataFrame:
    """The named columns and a row number.

    Numbers follow file splits, so two reads of the same files agree; they tell
    apart rows that are equal in every column.
    """
    return docs.select(F.monotonically_increasing_id().alias(name), *columns)


def free_name(docs: DataFrame, name: str) -> str:
    """The name, or one like it that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def only_rows(docs: DataFrame, stay: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose number is in ``stay.row_no``, with all their columns."""
    number = free_name(docs, "kept_row_no")
    rows = docs.withColumn(number, F.monotonically_increasing_id())
    return rows.join(stay.select(F.col("row_no").alias(number)), number, "left_semi").drop(number)


def staged(rows: DataFrame, name: str, read: int | None = None) -> DataFrame:
    """Writes rows below the shared folder and reads them back: computed once, lineage cut.

    ``read`` is the number of narrow rows the last stage reads: see ``dealt``.
    """
    rows = rows if read is None else dealt(rows, read)
    return session.stage(rows, session.fresh_path(rows.sparkSession, name))


def dealt(rows: DataFrame, read: int) -> DataFrame:
    """The same rows in no more tasks than ``read`` rows are worth, but one per core at least.

    However many shuffle partitions are set, a small table then is not written as one tiny file for each.
    """
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-read // TASK_ROWS)))


def by_batch(rows: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """One output batch for each input batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(batch)
            if made is not None and made.num_rows:
                yield made
    return rows.mapInArrow(run, schema)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def hot_threshold(total: int) -> int:
    """Rows from which a key is hot; total // threshold, the number of hot keys, is at most 1,000."""
    return max(HOT_LEAST, -(-total // HOT_SHARE))


def look_up(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows joined with the one row of ``groups`` for their key; keys may be as skewed as they like.

    ``groups[size]`` is the number of rows of the key and ``total`` their sum.
    Keys of at least ``hot_threshold(total)`` rows - 1,000 at most, by
    counting - are broadcast; the rows of all others are shuffled.  Keys match
    when equal; rows without a group go.
    """
    least = hot_threshold(total)
    hot = groups.where(F.col(size) >= least)
    names = hot.select(key).withColumn("hot_", F.lit(True))
    marked = rows.join(F.broadcast(names), key, "left")
    busy = marked.where(F.col("hot_")).drop("hot_").join(F.broadcast(hot), key)
    rest = marked.where(F.col("hot_").isNull()).drop("hot_").join(groups.where(F.col(size) < least), key)
    return busy.unionByName(rest)


def unsigned_hex(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))
