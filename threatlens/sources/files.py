"""Text log files as line DataFrames: ``value`` and the arrival order ``seq``."""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlens.operators import parsers

log = logging.getLogger(__name__)


def _with_order(lines: DataFrame) -> DataFrame:
    # One file split is read by one task, in order; the running id alone would
    # not order rows across files, because splits are packed by size.
    part = F.concat(F.col("_metadata.file_path"), F.lit("#"),
                    F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"))
    return lines.select(
        "value", F.struct(part.alias("part"), F.monotonically_increasing_id().alias("pos")).alias("seq"))


def exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    return found is not None and len(found) > 0


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path if it is there."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def empty_lines(spark: SparkSession) -> DataFrame:
    from threatlens.schemas import LINES
    return spark.createDataFrame([], LINES)


def scan_file(spark: SparkSession, path: str, missing: str = "error") -> DataFrame:
    """Lines of one file, or of all files a glob names.

    Undecodable bytes become U+FFFD; ``\\n``, ``\\r\\n`` and ``\\r`` end a line.
    ``missing`` is ``"error"`` or ``"empty"``.
    """
    if not exists(spark, path):
        if missing == "error":
            raise FileNotFoundError(f"log file not found: {path}")
        log.warning("log file not found: %s", path)
        return empty_lines(spark)
    return _with_order(spark.read.text(path))


def scan_directory(spark: SparkSession, path: str, pattern: str = "*.log", skip_corrupt: bool = False) -> DataFrame:
    """Lines of the matching files directly in a directory, in file-name order.

    A damaged file is an error; with ``skip_corrupt`` the part that cannot be
    read is left out, and executors log the file.
    """
    if not exists(spark, f"{path.rstrip('/')}/{pattern}"):
        log.warning("no files matching %r in %s", pattern, path)
        return empty_lines(spark)
    return _with_order(
        spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "false")
        .option("ignoreCorruptFiles", str(skip_corrupt).lower()).text(path))


def source_format(source: dict) -> str:
    """The parser a configured source asks for, by name first, then by format."""
    name, fmt = source.get("name", "unknown"), source.get("format", "combined").lower()
    if name == "nginx" or fmt in ("combined", "nginx"):
        return "nginx"
    if name == "apache" or fmt == "apache":
        return "apache"
    return "nginx"


def scan_sources(spark: SparkSession, sources: Iterable[dict], profile: str = "classic") -> DataFrame:
    """Parsed entries of every configured source; missing paths are skipped."""
    parts = []
    for source in sources:
        lines = scan_file(spark, source.get("path", ""), missing="empty")
        entries = parsers.parse(lines, source_format(source), profile)
        parts.append(entries.withColumn("source_name", F.lit(source.get("name", "unknown"))))
    if not parts:
        return parsers.parse(empty_lines(spark), "nginx", profile).withColumn(
            "source_name", F.lit(None).cast("string"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def seq_of(part: Column, pos: Column) -> Column:
    return F.struct(part.alias("part"), pos.cast("bigint").alias("pos"))
