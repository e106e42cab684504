"""Exact trailing-window counts per key, without a task ever holding a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatlens.functions.text import floor_div

CELL_US = 1_000_000     # microseconds of a cell
GROUP_CELLS = 3600      # cells of a group


def _instants(events: DataFrame) -> DataFrame:
    """Rows per (key, instant, slice); map-side combined, so hot keys shrink first."""
    return events.groupBy("_key", "_us", "_part").agg(F.count("*").alias("_n"))


def ranked(points: DataFrame) -> DataFrame:
    """Adds ``_rank``: the sum of ``_n`` of the key before a point, in three steps of bounded width.

    Points are ordered by ``_us``, ``_kind`` and ``_part``.

    Rows are summed per cell, cells are summed up inside a group, and groups per
    key; inside a cell the points are summed up themselves.  A window holds at
    most the cells of a group, the groups of a key, which are hours, or one
    second of one key.
    """
    zero = F.lit(0).cast("bigint")

    def before(*names: str):
        return lambda *order: F.coalesce(F.sum("_n").over(
            Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), zero)
    placed = points.withColumn("_cell", floor_div(F.col("_us"), CELL_US))
    cells = placed.groupBy("_key", "_cell").agg(F.sum("_n").alias("_n")) \
        .withColumn("_group", floor_div(F.col("_cell"), GROUP_CELLS))
    groups = cells.groupBy("_key", "_group").agg(F.sum("_n").alias("_n"))
    of_group = groups.select("_key", "_group", before("_key")("_group").alias("_of_group"))
    of_cell = cells.withColumn("_of_cell", before("_key", "_group")("_cell")).drop("_n")
    bases = of_cell.join(of_group, ["_key", "_group"]).select(
        "_key", "_cell", (F.col("_of_cell") + F.col("_of_group")).alias("_base"))
    inside = before("_key", "_cell")("_us", "_kind", "_part")
    return placed.withColumn("_inside", inside).join(bases, ["_key", "_cell"]).withColumn(
        "_rank", F.col("_base") + F.col("_inside")).drop("_cell", "_inside", "_base")


def _in_pairs(points: DataFrame, window_us: int, at_least: int) -> DataFrame:
    """Adds ``_rank``: the sum of ``_n`` of the key before a point, from the stretch before the one that asks.

    A stretch is as long as the window, so a window lies in the stretch of its last
    row and the one before.  Seconds are summed up per pair of stretches, and points
    inside their second, so no window holds more than the seconds of two windows of
    time, or one second of one key.  Pairs with fewer rows than ``at_least`` go.
    """
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_key", "_stretch").orderBy("_cell").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_key", "_cell").orderBy("_us", "_kind", "_part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    placed = points.withColumn("_cell", floor_div(F.col("_us"), CELL_US))
    of_cell = floor_div(F.col("_cell") * CELL_US, window_us)
    bases = placed.groupBy("_key", "_cell").agg(F.sum("_n").alias("_n")).withColumn(
        "_stretch", F.explode(F.array(of_cell, of_cell + 1))).withColumn("_base", before)
    if at_least > 1:
        bases = bases.withColumn("_total", F.sum("_n").over(Window.partitionBy("_key", "_stretch"))) \
            .filter(F.col("_total") >= at_least)
    return placed.withColumn("_inside", inside).withColumn("_stretch", floor_div(F.col("_asked_us"), window_us)) \
        .join(bases.select("_key", "_stretch", "_cell", "_base"), ["_key", "_stretch", "_cell"]) \
        .withColumn("_rank", F.col("_base") + F.col("_inside")).drop("_cell", "_stretch", "_inside", "_base")


def _counts_before(instants: DataFrame, window_us: int, at_least: int) -> DataFrame:
    """For every (key, instant, slice): rows of the window that arrived earlier.

    That is the rank of the instant less the rank of the place one window
    before it, which a probe without rows takes among the same points.  Instants
    and probes come from one explode and meet again in a window of one instant,
    so the plan holds its input once and not per role.
    """
    points = instants.select("_key", F.explode(F.array(
        F.struct("_us", "_part", "_n", F.lit(1).alias("_kind"), F.col("_us").alias("_asked_us")),
        F.struct((F.col("_us") - window_us).alias("_us"), F.lit("").alias("_part"), F.lit(0).cast("bigint").alias("_n"),
                 F.lit(0).alias("_kind"), F.col("_us").alias("_asked_us")))).alias("_p")).select("_key", "_p.*")
    placed = _in_pairs(points, window_us, at_least) if window_us > 0 else ranked(points)
    expired = F.max(F.when(F.col("_kind") == 0, F.col("_rank"))).over(Window.partitionBy("_key", "_asked_us"))
    return placed.withColumn("_before", F.col("_rank") - expired).filter("_kind = 1").select(
        "_key", "_us", "_part", "_n", "_before")


def _keyed(events: DataFrame, key: Column, ts: Column, seq: Column) -> DataFrame:
    return (events.withColumn("_key", key).withColumn("_us", F.unix_micros(ts))
            .withColumn("_part", seq["part"]).withColumn("_pos", seq["pos"])
            .filter("_key is not null and _us is not null"))


def sliding_count(events: DataFrame, key: Column, ts: Column, seq: Column, window_seconds: int,
                  at_least: int = 1, history: DataFrame | None = None,
                  name: str = "window_count") -> DataFrame:
    """Rows of the same key with ``ts`` in the last ``window_seconds``, up to this row.

    The lower bound is inclusive; of rows with equal times only earlier arrivals
    count.  Rows below ``at_least`` and rows without key or time are dropped.
    ``history`` (columns _key, _us, _n) adds counts from before these events.

    Only the small (key, instant, slice) table is windowed, and only where enough
    rows are close together.  Rows meet it again through an equi join on its full
    key, and are ranked inside one slice of one instant.
    """
    window_us = int(window_seconds) * 1_000_000
    keyed = _keyed(events, key, ts, seq)
    instants = _instants(keyed)
    if history is not None:
        # The empty slice name sorts before every real one.
        instants = instants.unionByName(history.select("_key", "_us", F.lit("").alias("_part"), "_n"))
    hot = _counts_before(instants, window_us, at_least).filter(F.col("_before") + F.col("_n") >= at_least)
    if history is not None:
        hot = hot.filter("_part <> ''")
    rank = F.row_number().over(Window.partitionBy("_key", "_us", "_part").orderBy("_pos"))
    return (keyed.join(hot.drop("_n"), ["_key", "_us", "_part"])
            .withColumn(name, F.col("_before") + rank)
            .filter(F.col(name) >= at_least)
            .drop("_key", "_us", "_part", "_pos", "_before"))


def latest_counts(events: DataFrame, key: Column, ts: Column) -> DataFrame:
    """The (key, instant) counts a later call can take as ``history``."""
    return (events.select(key.alias("_key"), F.unix_micros(ts).alias("_us"))
            .filter("_key is not null and _us is not null")
            .groupBy("_key", "_us").agg(F.count("*").alias("_n")))
