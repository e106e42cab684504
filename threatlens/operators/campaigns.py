"""Correlated incidents: one per address and attack type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatlens import rules
from threatlens.functions import lookup
from threatlens.functions.text import floor_div

REPEATED = 10
EXPLOITS = ("SQL_INJECTION", "XSS", "PATH_TRAVERSAL")
TOOL_NAMES = "(?i)(" + "|".join(p.removeprefix("(?i)") for p in rules.STRICT_USER_AGENTS) + ")"


def tool_of(user_agent: Column) -> Column:
    """The attack tool a user agent names, in lower case, else an empty text."""
    return F.lower(F.regexp_extract(F.coalesce(user_agent, F.lit("")), TOOL_NAMES, 1))


def attack_type(threats: DataFrame) -> Column:
    """Agents of attack tools are tool scans, other odd agents reconnaissance."""
    kind = F.col("threat_type")
    return F.when(kind != "SUSPICIOUS_UA", kind) \
        .when(tool_of(F.col("user_agent")) != "", F.lit("TOOL_SCAN")).otherwise(F.lit("RECON"))


def campaigns(threats: DataFrame, repeated: int = REPEATED, gap: str | None = None) -> DataFrame:
    """Incidents with attempts, main tool, severity and time span.

    MEDIUM is a suspicious pattern, HIGH a known tool or an exploit attempt,
    CRITICAL a repeated attack with a tool.  With ``gap`` a quiet period of that
    length starts a new incident.

    Findings are first counted per address, type and tool, which combines on the
    map side; the tool is then chosen from those few rows.
    """
    tagged = threats.select(
        F.col("source_ip").alias("ip"), attack_type(threats).alias("attack_type"),
        tool_of(F.col("user_agent")).alias("tool"), "ts", "seq")
    group = ["ip", "attack_type"]
    if gap is not None:
        tagged = sessions(tagged, group, gap)
        group = [*group, "session"]
    per_tool = tagged.groupBy(*group, "tool").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    # Named tools go before unnamed ones, then the most used, then by name.
    rank = F.struct(F.col("tool") != "", "n", "tool")
    found = per_tool.groupBy(*group).agg(
        F.sum("n").alias("attempts"), F.max_by("tool", rank).alias("tool"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    known = F.col("tool") != ""
    return found.withColumn(
        "severity",
        F.when(known & (F.col("attempts") >= repeated), F.lit("CRITICAL"))
         .when(known | F.col("attack_type").isin(*EXPLOITS), F.lit("HIGH"))
         .otherwise(F.lit("MEDIUM")))


def sessions(tagged: DataFrame, group: list[str], gap: str) -> DataFrame:
    """Adds ``session``, the start of the row's run of activity without a longer gap.

    Rows without a time form a session of their own, whose start is null.

    Runs are found among the distinct seconds of a group, cut into days; a day
    only passes its last second on to the next one, so no task reads all rows of
    a hot address.
    """
    second = F.unix_seconds("ts")
    gap_seconds = _seconds(gap)
    seconds = tagged.filter("ts is not null").select(*group, second.alias("_s")).distinct() \
        .withColumn("_day", floor_div(F.col("_s"), 86400))
    days = seconds.groupBy(*group, "_day").agg(F.max("_s").alias("_last"))
    previous_day = Window.partitionBy(*group).orderBy("_day")
    days = days.select(*group, "_day", F.lag("_last").over(previous_day).alias("_carried"))
    within = Window.partitionBy(*group, "_day").orderBy("_s")
    marked = seconds.join(days, [*group, "_day"]).withColumn(
        "_before", F.coalesce(F.lag("_s").over(within), F.col("_carried")))
    starts = F.when(F.col("_before").isNull() | (F.col("_s") - F.col("_before") >= gap_seconds), F.col("_s"))
    # The latest start inside the day, else the latest one of an earlier day.
    marked = marked.withColumn("_start", F.last(starts, ignorenulls=True).over(within))
    last_starts = marked.groupBy(*group, "_day").agg(F.max("_start").alias("_day_start"))
    earlier = Window.partitionBy(*group).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    last_starts = last_starts.select(*group, "_day", F.max("_day_start").over(earlier).alias("_inherited"))
    resolved = marked.join(last_starts, [*group, "_day"]).select(
        *group, "_s", F.timestamp_seconds(F.coalesce("_start", "_inherited")).alias("session"))
    dated = tagged.filter("ts is not null").withColumn("_s", second).join(resolved, [*group, "_s"]).drop("_s")
    undated = tagged.filter("ts is null").withColumn("session", F.lit(None).cast("timestamp"))
    return dated.unionByName(undated)


def _seconds(gap: str) -> int:
    count, unit = gap.split()
    return int(count) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def noise_reduction(entries: DataFrame, incidents: DataFrame) -> DataFrame:
    """Total lines, incidents and the share of lines the grouping removes, in percent."""
    sizes = entries.select(F.lit(1).alias("line"), F.lit(0).alias("incident")).unionByName(
        incidents.select(F.lit(0).alias("line"), F.lit(1).alias("incident")))
    counted = sizes.agg(F.coalesce(F.sum("line"), F.lit(0)).alias("total_logs"),
                        F.coalesce(F.sum("incident"), F.lit(0)).alias("distinct_incidents"))
    return counted.withColumn("reduction_ratio", F.when(
        F.col("total_logs") > 0,
        F.round((1 - F.col("distinct_incidents") / F.col("total_logs")) * 100, 1)).otherwise(F.lit(0.0)))


def risk_level(incidents: DataFrame) -> DataFrame:
    """Highest severity (LOW without incidents), incident count, attempts and attackers."""
    rank = lookup.severity_rank(F.col("severity"))
    return incidents.agg(
        F.coalesce(F.max_by("severity", rank), F.lit("LOW")).alias("risk_level"),
        F.count("*").alias("incident_count"),
        F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"),
        F.count_distinct("ip").alias("attackers"))
