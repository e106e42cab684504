"""Session helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def build(app: str = "threatlens", cores: int | str = "*") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return prepare(
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on: log times are compared as UTC instants."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few fixed rows as part of the plan, without a job that ships them from Python."""
    fields = T._parse_datatype_string(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return spark.createDataFrame(
        pa.table([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, fields)],
                 names=fields.fieldNames()), schema=fields)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session may fall back to a temporary folder: on a cluster that
    would be a different disk on every machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    configured = tempfile.mkdtemp(prefix="threatlens-")
    spark.sparkContext.setCheckpointDir(configured)
    spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def stage(rows: DataFrame, path: str) -> DataFrame:
    """Writes rows as Parquet and reads them back: compute once, prune columns after."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
