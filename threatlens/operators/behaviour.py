"""Documented detectors that look at behaviour: failed logins, port scans, beaconing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatlens.functions.text import floor_div
from threatlens.operators import sliding
from threatlens.operators.sliding import sliding_count


def detect_login_failures(entries: DataFrame, window: int = 60, threshold: int = 5) -> DataFrame:
    """Bursts of failed logins in syslog and Windows entries (strict profile)."""
    failed = F.col("extra")["message"].contains("Failed password") & (F.col("source") == "syslog")
    failed = failed | ((F.col("source") == "windows") & (F.col("status_code") == 4625))
    return sliding_count(entries.filter(failed), F.col("ip"), F.col("ts"), F.col("seq"),
                         window, at_least=threshold)


def port_of(message: Column) -> Column:
    return F.regexp_extract(message, r"(?i)\b(?:port|dpt)[ =](\d{1,5})\b", 1).try_cast("int")


def detect_port_scan(entries: DataFrame, port: Column, window: int = 60, threshold: int = 20,
                     slide: int | None = None) -> DataFrame:
    """Windows in which one address touched at least ``threshold`` distinct ports.

    Touches are made distinct per address, port and slide first, so a hot
    address costs at most one row per port and slide.
    """
    slide = slide or max(1, window // 6)
    if window % slide:
        raise ValueError("window must be a multiple of slide")
    step = floor_div(F.unix_seconds("ts"), slide)
    touched = (entries.select("ip", port.alias("port"), step.alias("_step"))
               .filter("ip is not null and port is not null and _step is not null").distinct())
    windows = touched.withColumn("_start", F.explode(
        F.sequence(F.col("_step") - (window // slide - 1), F.col("_step"))))
    return (windows.groupBy("ip", "_start").agg(F.count_distinct("port").alias("ports"))
            .filter(F.col("ports") >= threshold)
            .select("ip", F.timestamp_seconds(F.col("_start") * slide).alias("window_start"), "ports"))


def port_scans(entries: DataFrame, port: Column, window: int = 60, threshold: int = 20) -> DataFrame:
    """Instants at which an address had touched ``threshold`` distinct ports or more in the trailing window.

    A touch of a port counts from its time to the window's end after it, both
    inclusive.  Touches of one port inside a stretch of the window's length are
    one stay, and stays that meet are joined, so a port adds 1 where a stay begins
    and takes 1 away after it ends; the count at an instant is the sum of what came
    up to it.  Those sums are taken in steps of bounded width (``sliding.ranked``):
    neither a hot address nor a hot port is gathered in one task.
    """
    us = window * 1_000_000
    touches = entries.select(F.col("ip").alias("_key"), port.alias("_port"), F.unix_micros("ts").alias("_us")) \
        .filter("_key is not null and _port is not null and _us is not null")
    stays = touches.groupBy("_key", "_port", floor_div(F.col("_us"), us).alias("_stretch")).agg(
        F.min("_us").alias("_from"), F.max("_us").alias("_to"))
    of_port = Window.partitionBy("_key", "_port").orderBy("_stretch")
    begins = F.coalesce(F.col("_from") > F.lag("_to").over(of_port) + us, F.lit(True))
    ends = F.coalesce(F.lead("_from").over(of_port) > F.col("_to") + us, F.lit(True))
    steps = stays.select("_key", "_from", "_to", begins.alias("_begins"), ends.alias("_ends")).select("_key", F.inline(F.array_compact(
        F.array(F.when(F.col("_begins"), F.struct(F.col("_from").alias("_us"), F.lit(1).alias("_n"))),
                F.when(F.col("_ends"), F.struct((F.col("_to") + us + 1).alias("_us"), F.lit(-1).alias("_n")))))))
    asked = touches.select("_key", "_us", F.lit(0).alias("_n"), F.lit(True).alias("_asked"))
    points = steps.withColumn("_asked", F.lit(False)).unionByName(asked).groupBy("_key", "_us").agg(
        F.sum("_n").alias("_n"), F.max("_asked").alias("_asked"))
    ranked = sliding.ranked(points.withColumns({"_part": F.lit(""), "_kind": F.lit(0)}))
    return (ranked.filter("_asked").withColumn("ports", F.col("_rank") + F.col("_n")).filter(F.col("ports") >= threshold)
            .select(F.col("_key").alias("ip"), F.timestamp_micros("_us").alias("ts"), "ports"))


def detect_beaconing(entries: DataFrame, min_events: int = 10, max_variation: float = 0.1) -> DataFrame:
    """Address and path pairs contacted at regular intervals.

    The coefficient of variation of the gaps between distinct seconds decides.
    Gaps inside a day and gaps between days are summed separately, so no task
    holds all events of a pair.
    """
    pair = ["ip", "path"]
    seconds = (entries.filter("ts is not null").select(*pair, F.unix_seconds("ts").alias("_s")).distinct()
               .withColumn("_day", floor_div(F.col("_s"), 86400)))
    within = Window.partitionBy(*pair, "_day").orderBy("_s")
    gap = F.col("_s") - F.lag("_s").over(within)
    days = seconds.withColumn("_gap", gap).groupBy(*pair, "_day").agg(
        F.min("_s").alias("_first"), F.max("_s").alias("_last"), F.count("*").alias("_n"),
        F.sum("_gap").alias("_sum"), F.sum(F.col("_gap") * F.col("_gap")).alias("_squares"))
    between = F.col("_first") - F.lag("_last").over(Window.partitionBy(*pair).orderBy("_day"))
    zero = F.lit(0).cast("bigint")
    totals = days.withColumn("_edge", F.coalesce(between, zero)).groupBy(*pair).agg(
        F.sum("_n").alias("events"),
        (F.coalesce(F.sum("_sum"), zero) + F.sum("_edge")).alias("_total"),
        (F.coalesce(F.sum("_squares"), zero) + F.sum(F.col("_edge") * F.col("_edge"))).alias("_squares"))
    gaps = F.col("events") - 1
    mean = F.col("_total") / gaps
    variance = F.greatest(F.col("_squares") / gaps - mean * mean, F.lit(0.0))
    return (totals.filter(F.col("events") >= max(min_events, 2))
            .withColumn("mean_gap", mean).withColumn("variation", F.sqrt(variance) / F.col("mean_gap"))
            .filter(F.col("variation") <= max_variation)
            .select(*pair, "events", "mean_gap", "variation"))
