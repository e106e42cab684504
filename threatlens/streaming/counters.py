"""Counters over streams."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threatlens import session
from threatlens.operators.sliding import latest_counts, sliding_count
from threatlens.sources.files import exists, remove


def window_counts(entries: DataFrame, length: str = "60 seconds", slide: str | None = "10 seconds",
                  lateness: str = "10 minutes") -> DataFrame:
    """Entries per address and window: cheaper than exact counts, and mergeable."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (entries.withWatermark("ts", lateness).groupBy(window, "ip").agg(F.count("*").alias("count"))
            .select("ip", F.col("window.start").alias("window_start"), "count"))


def session_counts(threats: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Findings per address, type and run of activity without a longer gap."""
    return (threats.withWatermark("ts", lateness)
            .groupBy(F.session_window("ts", gap), "source_ip", "threat_type")
            .agg(F.count("*").alias("attempts"))
            .select(F.col("source_ip").alias("ip"), "threat_type",
                    F.col("session_window.start").alias("session_start"), "attempts"))


def closed_sessions(threats: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions given out once, when the watermark has passed their end; their state goes with them.

    ``threats`` carries a watermark on ``ts``, best set on the entries: traffic without
    findings moves it too (``tail.parse_detect(..., lateness=...)``).
    """
    return (threats.groupBy(F.session_window("ts", gap), "source_ip", "threat_type")
            .agg(F.count("*").alias("attempts"), F.max("ts").alias("last_seen"))
            .select(F.col("source_ip").alias("ip"), "threat_type", F.col("session_window.start").alias("session_start"),
                    "last_seen", "attempts"))


class SlidingCounter:
    """Exact trailing-window counts on a stream, equal to the batch operator.

    Each micro-batch is counted by :func:`sliding_count` on top of a table of
    (key, instant) counts that reach back one window plus the allowed lateness.
    The table is written per batch under ``path``, so a repeated batch starts
    from the same state and overwrites its own output.  Being an ordinary
    batch job, it splits hot keys in the same way; a keyed state function would
    send all rows of a key to one task.

    Rows more than ``lateness`` behind the newest time of earlier batches are
    left out and counted in the ``progress`` table.
    """

    def __init__(self, path: str, key: str = "ip", ts: str = "ts", window_seconds: int = 60,
                 at_least: int = 1, lateness_seconds: int = 600) -> None:
        self.path, self.key, self.ts = path, key, ts
        self.window, self.at_least, self.lateness = window_seconds, at_least, lateness_seconds
        self._lock = threading.Lock()

    def start(self, entries: DataFrame, checkpoint: str, poll_interval: float | None = 1.0) -> StreamingQuery:
        from threatlens.streaming.tail import watch
        return watch(entries, checkpoint, self.process, poll_interval)

    def results(self, spark) -> DataFrame:
        return spark.read.parquet(f"{self.path}/counts").drop("batch")

    def progress(self, spark) -> DataFrame:
        """One row per batch: newest time so far and rows that came too late."""
        return spark.read.parquet(f"{self.path}/progress")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        with self._lock:
            self._process(batch, batch_id)

    def _process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        us = F.unix_micros(F.col(self.ts))
        rows = batch
        if "seq" not in rows.columns:
            rows = rows.withColumn("seq", F.struct(
                F.concat(F.lit(f"{batch_id:020d}#"), F.lpad(F.spark_partition_id().cast("string"), 10, "0"))
                .alias("part"), F.monotonically_increasing_id().alias("pos")))
        rows = rows.persist()
        try:
            before = f"{self.path}/state/batch={batch_id - 1}"
            known = exists(spark, before)
            newest = spark.read.parquet(f"{self.path}/progress/batch={batch_id - 1}").first()["newest"] \
                if known else None
            history = spark.read.parquet(before) if known else None
            on_time = F.lit(True) if newest is None else us >= newest - self.lateness * 1_000_000
            stats = rows.agg(F.max(us).alias("newest"), F.count_if(~on_time).alias("late")).first()
            newest = max((x for x in (newest, stats["newest"]) if x is not None), default=None)
            kept = rows.filter(on_time)
            counted = sliding_count(kept, F.col(self.key), F.col(self.ts), F.col("seq"),
                                    self.window, self.at_least, history)
            counted.write.mode("overwrite").parquet(f"{self.path}/counts/batch={batch_id}")
            state = latest_counts(kept, F.col(self.key), F.col(self.ts))
            if history is not None:
                state = state.unionByName(history).groupBy("_key", "_us").agg(F.sum("_n").alias("_n"))
            if newest is not None:
                state = state.filter(F.col("_us") >= newest - (self.window + self.lateness) * 1_000_000)
            state.write.mode("overwrite").parquet(f"{self.path}/state/batch={batch_id}")
            session.table(spark, [(newest, stats["late"])], "newest bigint, late bigint") \
                .coalesce(1).write.mode("overwrite").parquet(f"{self.path}/progress/batch={batch_id}")
        finally:
            rows.unpersist()
        self._forget(spark, batch_id - 2)

    def _forget(self, spark, batch_id: int) -> None:
        """Drops a state table that no retry can ask for any more."""
        if batch_id >= 0:
            remove(spark, f"{self.path}/state/batch={batch_id}")
