"""Small fixed dimensions: severities, method codes, event and syslog names.

The tables have a fixed number of rows, so they are literals of the plan.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threatlens import rules, session


def literal_map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


def severity_rank(severity: Column) -> Column:
    """0 (LOW, and anything unknown) to 3 (CRITICAL)."""
    return F.coalesce(
        F.element_at(literal_map({s: i for i, s in enumerate(rules.SEVERITIES)}), severity), F.lit(0))


def method_code(method: Column, profile: str = "strict") -> Column:
    """The strict profile is case sensitive and its default code is 5, not 9.

    Names as they are in the table are compared one by one, which is cheaper than a look-up in a map.
    """
    if profile == "strict":
        return _case(method, rules.STRICT_METHOD_CODES, F.lit(5))
    return _case(method, rules.CLASSIC_METHOD_CODES, F.coalesce(
        F.element_at(literal_map(rules.CLASSIC_METHOD_CODES), F.upper(method)), F.lit(9)))


def _case(value: Column, table: dict, other: Column) -> Column:
    out = F.when(F.lit(False), other)
    for key, code in table.items():
        out = out.when(value == key, F.lit(code))
    return out.otherwise(other)


def event_label(event_id: Column) -> Column:
    return F.coalesce(
        F.element_at(literal_map(rules.WINDOWS_EVENT_LABELS), event_id.cast("int")), F.lit(""))


def severity_table(spark: SparkSession) -> DataFrame:
    return session.table(spark, [(s, i) for i, s in enumerate(rules.SEVERITIES)],
                         "severity string, rank int")


def event_table(spark: SparkSession) -> DataFrame:
    return session.table(spark, list(rules.WINDOWS_EVENT_LABELS.items()),
                         "event_id int, event_description string")


def syslog_severity_table(spark: SparkSession) -> DataFrame:
    return session.table(spark, list(enumerate(rules.SYSLOG_SEVERITIES)),
                         "severity_code int, severity string")


def syslog_facility_table(spark: SparkSession) -> DataFrame:
    return session.table(spark, list(rules.SYSLOG_FACILITIES.items()),
                         "facility_code int, facility string")


def with_event_label(events: DataFrame, event_id: str = "event_id") -> DataFrame:
    """Left join on the event table, which has eight rows."""
    table = event_table(events.sparkSession).withColumnRenamed("event_id", "_event")
    return (events.join(F.broadcast(table), F.col(event_id) == F.col("_event"), "left").drop("_event")
            .withColumn("event_description", F.coalesce("event_description", F.lit(""))))


def with_syslog_names(messages: DataFrame, priority: str = "priority") -> DataFrame:
    """Names for facility (priority / 8, 20 rows) and severity (priority % 8, 8 rows)."""
    spark = messages.sparkSession
    return (messages
            .withColumn("facility_code", F.shiftright(F.col(priority), 3))
            .withColumn("severity_code", F.col(priority).bitwiseAND(7))
            .join(F.broadcast(syslog_severity_table(spark)), "severity_code", "left")
            .join(F.broadcast(syslog_facility_table(spark)), "facility_code", "left")
            .withColumn("severity", F.coalesce("severity", F.lit("UNKNOWN")))
            .withColumn("facility", F.coalesce("facility", F.lit("unknown"))))


def reply(text: Column, require_all: bool = False) -> Column:
    """A scorer's reply text as a struct, null when no JSON object is found.

    Tried in turn: the text itself, the text without code fences, the first
    braced part of it.  ``require_all`` rejects replies that lack a field.
    """
    from threatlens.schemas import REPLY
    as_map = T.MapType(T.StringType(), T.StringType())
    trimmed = F.btrim(text, F.lit(" \t\r\n"))
    if require_all:
        bare = F.btrim(F.replace(F.replace(trimmed, F.lit("```json"), F.lit("")),
                                 F.lit("```"), F.lit("")), F.lit(" \t\r\n"))
        candidates = [bare]
    else:
        unfenced = F.btrim(F.regexp_replace(F.regexp_replace(
            trimmed, r"^```(?:json)?\s*\n?", ""), r"\n?```\s*$", ""), F.lit(" \t\r\n"))
        braced = F.regexp_extract(trimmed, r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", 0)
        candidates = [trimmed, unfenced, braced]
    # from_json gives an all-null struct for text that is no object; the map form
    # tells "not JSON" from "JSON without these fields".
    def parsed(c: Column) -> Column:
        fields = F.from_json(c, as_map)
        usable = c.rlike(r"^\{") & F.try_parse_json(c).isNotNull() & fields.isNotNull()
        if require_all:
            for key in rules.REPLY_KEYS:
                usable = usable & F.map_contains_key(fields, key)
        return F.when(usable, F.from_json(c, REPLY))
    return F.coalesce(*[parsed(c) for c in candidates])
