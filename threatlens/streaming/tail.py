"""Live log folders as streams.

A stream follows a folder: log shippers drop finished chunks there.  The same
parsers and row-wise detectors run on it as on batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threatlens import session
from threatlens.operators import detect, parsers, respond, whitelist
from threatlens.sources.files import exists, remove, source_format


def stream_lines(spark: SparkSession, path: str, pattern: str = "*.log",
                 files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text").option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def stream_sources(spark: SparkSession, sources: Iterable[dict], profile: str = "classic",
                   files_per_batch: int | None = None) -> DataFrame:
    """Parsed entries of every source with ``watch: true``, as one stream."""
    out = None
    for source in sources:
        if not source.get("watch", False):
            continue
        lines = stream_lines(spark, source["path"], source.get("pattern", "*.log"), files_per_batch)
        entries = parsers.parse(lines, source_format(source), profile).withColumn(
            "source_name", F.lit(source.get("name", "unknown")))
        out = entries if out is None else out.unionByName(entries)
    if out is None:
        raise ValueError("no source is marked with watch: true")
    return out


def parse_detect(lines: DataFrame, fmt: str = "nginx", profile: str = "strict",
                 config: dict | None = None, lateness: str | None = None) -> DataFrame:
    """Parsing, allow lists and pattern rules on a stream; no state is kept.

    ``lateness`` sets a watermark on the entries, for operators behind.
    """
    entries = whitelist.apply(parsers.parse(lines, fmt, profile), config, profile)
    if lateness is not None:
        entries = entries.withWatermark("ts", lateness)
    return detect.detect_patterns(entries, config, profile)


def skip_existing(stream: DataFrame, checkpoint: str) -> None:
    """Marks everything that is there now as read, so a later start sees new data only."""
    query = (stream.writeStream.foreachBatch(lambda batch, batch_id: None)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def watch(stream: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None],
          poll_interval: float | None = 1.0) -> StreamingQuery:
    """Starts a query that hands each batch of findings to ``on_batch``.

    With ``poll_interval`` None it ends when the data present has been read;
    ``query.stop()`` ends it otherwise.
    """
    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if poll_interval is None else {
        "processingTime": f"{max(1, round(poll_interval * 1000))} milliseconds"}
    return writer.trigger(**trigger).start()


def drain(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> DataFrame:
    """Reads what is present into Parquet and returns the table."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def drain_latest(stream: DataFrame, path: str, checkpoint: str, mode: str = "update",
                 keys: list[str] | None = None) -> DataFrame:
    """Reads what is present and returns the final row per key.

    ``update`` keeps every batch's changed rows and picks the latest of each
    key; ``complete`` replaces the table with every batch.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        target = f"{path}/batch={batch_id if mode == 'update' else 0}"
        batch.write.mode("overwrite").parquet(target)
    query = (stream.writeStream.foreachBatch(write).outputMode(mode)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    table = stream.sparkSession.read.parquet(path)
    if mode == "complete":
        return table.drop("batch")
    values = [c for c in table.columns if c not in (*keys, "batch")]
    return table.groupBy(*keys).agg(
        F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*")


def block_stream(threats: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """One block per address within ``ttl``.

    An address is forgotten at the end of the batch whose watermark (the newest
    time of earlier batches less ``ttl``) passes the end of its block; findings
    after that batch block it again.
    """
    return (respond.blockable(threats).withColumnRenamed("source_ip", "ip")
            .withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["ip"])
            .select("ip", F.col("ts").alias("blocked_at"), "threat_type", "severity"))


def live_stats(threats: DataFrame) -> DataFrame:
    """Running counts by type and severity; use with the complete or update mode."""
    return threats.groupBy("threat_type", "severity").agg(F.count("*").alias("count"))


class NewestRows:
    """A table that keeps the newest ``n`` rows of a stream.

    Every batch writes a version of its own: the newest rows of the version before
    and the batch.  A repeated batch writes the same version again, so nothing is
    counted twice; older versions than the one a repetition needs are removed.
    """

    def __init__(self, path: str, n: int = 1000, order: tuple[str, ...] = ("seq", "det")) -> None:
        self.path, self.n, self.order = path, n, order

    def start(self, rows: DataFrame, checkpoint: str, poll_interval: float | None = 1.0) -> StreamingQuery:
        return watch(rows, checkpoint, self.process, poll_interval)

    def _version(self, batch_id: int) -> str:
        return f"{self.path}/version={batch_id}"

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark, rows = batch.sparkSession, batch
        if exists(spark, self._version(batch_id - 1)):
            rows = rows.unionByName(spark.read.schema(batch.schema).parquet(self._version(batch_id - 1)))
        rows.orderBy(*[F.desc(c) for c in self.order]).limit(self.n).write.mode("overwrite").parquet(self._version(batch_id))
        remove(spark, self._version(batch_id - 2))

    def rows(self, spark: SparkSession) -> DataFrame:
        """The newest version."""
        versions = spark.read.parquet(self.path)
        return versions.join(versions.agg(F.max("version").alias("version")), "version").drop("version")


class LiveTotals:
    """Running totals of a watcher: lines, findings, addresses with findings, addresses blocked.

    Every batch is counted once, by address, and only addresses not seen before are
    added to the table of known ones, so no batch rewrites what earlier ones found.
    A batch's rows stand under its number: a repeated batch replaces its own.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def start(self, entries: DataFrame, threats: DataFrame, checkpoint: str,
              poll_interval: float | None = 1.0) -> StreamingQuery:
        """Both streams in one query, so that totals never mix two states of the input."""
        lines = entries.select(F.lit(None).cast("string").alias("source_ip"), F.lit(None).cast("string").alias("severity"),
                               F.lit(True).alias("line"))
        both = lines.unionByName(threats.select("source_ip", "severity", F.lit(False).alias("line")))
        return watch(both, checkpoint, self.process, poll_interval)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # By address: counts combine before the shuffle, so a hot address is one row per task.
        blocked = F.coalesce(F.col("severity").isin("HIGH", "CRITICAL"), F.lit(False))
        here = batch.groupBy("line", "source_ip").agg(F.count("*").alias("n"), F.max(blocked).alias("blocked"))
        counts = f"{self.path}/counts/batch={batch_id}"
        here.write.mode("overwrite").parquet(counts)
        here = spark.read.schema(here.schema).parquet(counts)
        found = here.where("not line and source_ip is not null")
        states = found.select("source_ip", F.lit("seen").alias("state")).unionByName(
            found.where("blocked").select("source_ip", F.lit("blocked").alias("state")))
        known = self._known(spark).where(F.col("batch") < batch_id).select("source_ip", "state")
        states.join(known, ["source_ip", "state"], "left_anti").write.mode("overwrite").parquet(
            f"{self.path}/known/batch={batch_id}")
        new = self._known(spark).where(F.col("batch") == batch_id)
        sums = here.agg(F.coalesce(F.sum(F.when(F.col("line"), F.col("n"))), F.lit(0)).alias("lines"),
                        F.coalesce(F.sum(F.when(~F.col("line"), F.col("n"))), F.lit(0)).alias("threats"))
        added = new.agg(F.count_if(F.col("state") == "seen").alias("unique_ips"),
                        F.count_if(F.col("state") == "blocked").alias("blocked_ips"))
        sums.join(added, F.lit(True)).write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch_id}")   # one row on either side
        remove(spark, counts)

    def _known(self, spark: SparkSession) -> DataFrame:
        schema = "source_ip string, state string, batch bigint"
        path = f"{self.path}/known"
        return spark.read.schema(schema).parquet(path) if exists(spark, path) else session.table(spark, [], schema)

    def rows(self, spark: SparkSession) -> DataFrame:
        """One row; nulls before the first batch become zeros."""
        columns = ("lines", "threats", "unique_ips", "blocked_ips")
        path, schema = f"{self.path}/totals", ", ".join(f"{c} bigint" for c in columns)
        totals = spark.read.schema(schema).parquet(path) if exists(spark, path) else session.table(spark, [], schema)
        return totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])
