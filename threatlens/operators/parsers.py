"""Line parsers: a ``value`` column in, entry columns out.

Every other input column (``seq``, ``source_name``) is carried along, so the
same transforms serve files, tables and streams.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from threatlens import rules, session
from threatlens.functions import lookup, text

def _cleaned(lines: DataFrame, drop_returns: bool) -> DataFrame:
    value = text.strip(F.col("value"))
    if drop_returns:
        value = F.replace(value, F.lit("\r"), F.lit(""))
    return lines.withColumn("value", text.evaluated_once(value))


def _skipped(value: Column, fmt: str, profile: str) -> Column:
    """Lines that are neither entries nor errors."""
    skip = value == ""
    if profile == "strict":
        skip = skip | value.startswith("#")
        if fmt == "windows":
            skip = skip | value.startswith("Date")
    return skip


def _carried(lines: DataFrame) -> list[str]:
    return [c for c in lines.columns if c != "value"]


def _matched(lines: DataFrame, fmt: str, profile: str, pattern: str, groups: int) -> DataFrame:
    """Lines that match, with the pattern's groups in ``g``."""
    kept = _cleaned(lines, profile == "strict").filter(~_skipped(F.col("value"), fmt, profile))
    found = text.evaluated_once(text.line_groups(F.col("value"), pattern, groups))
    return kept.withColumn("g", found).filter(F.size("g") == groups)


def _or(c: Column, default: str) -> Column:
    return F.when(c == "", F.lit(default)).otherwise(c)


def _access(lines: DataFrame, source: str, profile: str) -> DataFrame:
    g = F.col("g")
    time = text.access_time(g[1])
    if profile == "strict":
        hit = _matched(lines, source, profile, rules.ACCESS_STRICT_LINE, 9)
        protocol, rest = text.strip(_or(g[4], "HTTP/1.1")), 5
        referrer, agent = _or(g[7], "-"), g[8]
    else:
        pattern = rules.NGINX_CLASSIC_LINE if source == "nginx" else rules.APACHE_CLASSIC_LINE
        hit = _matched(lines, source, profile, pattern, 8).withColumn("g_time", text.evaluated_once(time))
        time = F.col("g_time")      # read by the filter below and by the entries
        protocol, rest = F.lit(""), 4
        referrer, agent = g[6], g[7]
        if source == "apache":
            referrer, agent = _or(referrer, "-"), _or(agent, "-")
    path = _or(g[3], "/") if (profile, source) == ("classic", "apache") else g[3]
    entries = hit.select(
        *_carried(lines),
        g[0].alias("ip"),
        time.alias("ts"),
        text.access_offset(g[1]).alias("ts_offset"),
        text.access_hour(g[1]).alias("ts_hour"),
        g[2].alias("method"),
        path.alias("path"),
        protocol.alias("protocol"),
        g[rest].try_cast("int").alias("status_code"),
        F.when(g[rest + 1] == "-", F.lit(0).cast("bigint"))
         .otherwise(g[rest + 1].try_cast("bigint")).alias("bytes_sent"),
        referrer.alias("referrer"),
        agent.alias("user_agent"),
        F.col("value").alias("raw"),
        F.lit(source).alias("source"),
        F.lit(None).cast("map<string,string>").alias("extra"))
    # The classic profile needs a time on every entry.
    return entries if profile == "strict" else entries.filter("ts is not null")


def parse_nginx(lines: DataFrame, profile: str = "strict") -> DataFrame:
    return _access(lines, "nginx", profile)


def parse_apache(lines: DataFrame, profile: str = "strict") -> DataFrame:
    return _access(lines, "apache", profile)


def _year(year: int | None) -> int:
    return year if year is not None else date.today().year


def parse_syslog_entries(lines: DataFrame, year: int | None = None) -> DataFrame:
    """BSD syslog as access-log entries (strict profile).

    The lines carry no year: pass ``year`` for repeatable results, the default
    is the current one.
    """
    g = F.col("g")
    hit = _matched(lines, "syslog", "strict", rules.SYSLOG_STRICT_LINE, 5)
    stamp = F.concat_ws(" ", F.lit(str(_year(year))), F.regexp_replace(g[0], r"\s+", " "))
    ts = F.try_to_timestamp(stamp, F.lit("yyyy MMM d HH:mm:ss"))
    program, host, message = text.strip(g[2]), g[1], g[4]
    return hit.select(
        *_carried(lines),
        text.extract_ip(message).alias("ip"),
        ts.alias("ts"), F.lit(None).cast("int").alias("ts_offset"), F.hour(ts).alias("ts_hour"),
        F.lit("SYSLOG").alias("method"),
        F.concat(F.lit("/"), program).alias("path"),
        F.lit("HTTP/1.1").alias("protocol"),
        F.lit(0).alias("status_code"), F.lit(0).cast("bigint").alias("bytes_sent"),
        F.lit("-").alias("referrer"),
        F.concat(host, F.lit("/"), program).alias("user_agent"),
        F.col("value").alias("raw"), F.lit("syslog").alias("source"),
        F.create_map(F.lit("hostname"), host, F.lit("program"), program,
                     F.lit("pid"), g[3], F.lit("message"), message).alias("extra"))


def parse_syslog_messages(lines: DataFrame, year: int | None = None) -> DataFrame:
    """RFC 5424 (tried first) and RFC 3164 messages (classic profile)."""
    kept = _cleaned(lines, False).filter(F.col("value") != "")
    kept = kept.withColumn("g5", text.evaluated_once(
        text.line_groups(F.col("value"), rules.SYSLOG_5424_LINE, 8)))
    is_new = F.coalesce(F.size("g5") == 8, F.lit(False))
    kept = (kept
            .withColumn("g3", text.evaluated_once(F.when(
                ~is_new, text.line_groups(F.col("value"), rules.SYSLOG_3164_LINE, 9))))
            .filter(is_new | (F.size("g3") == 9)))
    g5, g3, modern = F.col("g5"), F.col("g3"), is_new
    priority = g5[0].try_cast("int")
    names = F.array(*[F.lit(s) for s in rules.SYSLOG_SEVERITIES])
    facilities = lookup.literal_map(rules.SYSLOG_FACILITIES)
    month = F.coalesce(F.nullif(F.array_position(
        F.array(*[F.lit(m) for m in rules.MONTHS]), g3[0]).cast("int"), F.lit(0)), F.lit(1))
    # An impossible date (30 February) drops the line, as any other parse error.
    old_ts = F.try_make_timestamp(F.lit(_year(year)), month, text.strip(g3[1]).try_cast("int"),
                                  g3[2].try_cast("int"), g3[3].try_cast("int"),
                                  g3[4].try_cast("decimal(8,6)"))
    return (kept.select(
        *_carried(lines),
        F.when(modern, text.parse_iso(g5[2])).otherwise(old_ts).alias("ts"),
        F.when(modern, text.access_offset(g5[2])).alias("ts_offset"),
        F.when(modern, g5[3]).otherwise(g3[5]).alias("hostname"),
        F.when(modern, g5[4]).otherwise(g3[6]).alias("process"),
        F.when(modern, g5[5]).otherwise(g3[7]).try_cast("int").alias("pid"),
        F.when(modern, g5[7]).otherwise(g3[8]).alias("message"),
        F.when(modern, F.element_at(names, priority.bitwiseAND(7) + 1))
         .otherwise(F.lit("INFO")).alias("severity"),
        F.when(modern, F.coalesce(F.element_at(facilities, F.shiftright(priority, 3)), F.lit("unknown")))
         .otherwise(F.lit("syslog")).alias("facility"),
        F.col("value").alias("raw"), F.lit("syslog").alias("source"),
        modern.alias("_modern"))
        .filter("_modern or ts is not null").drop("_modern"))


def parse_windows_csv(lines: DataFrame) -> DataFrame:
    g = F.col("g")
    hit = _matched(lines, "windows", "strict", rules.WINDOWS_CSV_LINE, 6)
    ts = F.try_to_timestamp(F.concat_ws(" ", g[0], g[1]), F.lit("yyyy-MM-dd HH:mm:ss"))
    event_id, origin = g[3].try_cast("int"), text.strip(g[2])
    shown = event_id.cast("string")
    return hit.select(
        *_carried(lines),
        text.extract_ip(g[5], rules.WINDOWS_LABELLED_IP, fallback=False).alias("ip"),
        ts.alias("ts"), F.lit(None).cast("int").alias("ts_offset"), F.hour(ts).alias("ts_hour"),
        F.lit("EVENT").alias("method"),
        F.concat(F.lit("/event/"), shown).alias("path"),
        F.lit("HTTP/1.1").alias("protocol"),
        event_id.alias("status_code"), F.lit(0).cast("bigint").alias("bytes_sent"),
        F.lit("-").alias("referrer"),
        F.concat(F.lit("Windows/"), origin).alias("user_agent"),
        F.col("value").alias("raw"), F.lit("windows").alias("source"),
        F.create_map(F.lit("event_id"), shown, F.lit("level"), text.strip(g[4]),
                     F.lit("source"), origin, F.lit("message"), g[5],
                     F.lit("event_description"), lookup.event_label(event_id)).alias("extra"))


Parser = Callable[..., DataFrame]
# Registered transforms by format; extend it to add a format.
FORMATS: dict[str, dict[str, Parser]] = {
    "strict": {
        "nginx": lambda lines, **_: parse_nginx(lines, "strict"),
        "apache": lambda lines, **_: parse_apache(lines, "strict"),
        "syslog": parse_syslog_entries,
        "windows": lambda lines, **_: parse_windows_csv(lines),
    },
    "classic": {
        "nginx": lambda lines, **_: parse_nginx(lines, "classic"),
        "combined": lambda lines, **_: parse_nginx(lines, "classic"),
        "apache": lambda lines, **_: parse_apache(lines, "classic"),
        "syslog": parse_syslog_messages,
    },
}
LINE_PATTERNS = {
    ("nginx", "strict"): rules.ACCESS_STRICT_LINE, ("apache", "strict"): rules.ACCESS_STRICT_LINE,
    ("syslog", "strict"): rules.SYSLOG_STRICT_LINE, ("windows", "strict"): rules.WINDOWS_CSV_LINE,
}


def parser_for(fmt: str, profile: str = "strict") -> Parser:
    """The strict profile rejects unknown formats, the classic one reads them as nginx."""
    registry, name = FORMATS[profile], fmt.lower()
    if name in registry:
        return registry[name]
    if profile == "strict":
        raise ValueError(f"unknown log format {fmt!r}, expected one of {sorted(registry)}")
    return registry["nginx"]


def parse(lines: DataFrame, fmt: str = "nginx", profile: str = "strict", **options) -> DataFrame:
    return parser_for(fmt, profile)(lines, **options)


def _judged(lines: DataFrame, fmt: str) -> tuple[DataFrame, str]:
    """Lines that count, cleaned, with ``_ok``: whether they can be parsed."""
    pattern = f"(?dU)^(?:{LINE_PATTERNS[fmt, 'strict']})"
    kept = _cleaned(lines, True).filter(~_skipped(F.col("value"), fmt, "strict"))
    return kept.withColumn("_ok", text.evaluated_once(F.col("value").rlike(pattern)))


def _with_rate(counts: DataFrame) -> DataFrame:
    return counts.withColumn("success_rate", F.when(
        F.col("lines_parsed") + F.col("parse_errors") > 0,
        F.col("lines_parsed") / (F.col("lines_parsed") + F.col("parse_errors")) * 100).otherwise(F.lit(0.0)))


def _quality_counts() -> list[Column]:
    return [F.count_if(F.col("_ok")).alias("lines_parsed"), F.count_if(~F.col("_ok")).alias("parse_errors")]


def parse_quality(lines: DataFrame, fmt: str = "nginx") -> DataFrame:
    """One row: lines parsed, parse errors, success rate in percent (strict profile)."""
    return _with_rate(_judged(lines, fmt).select("_ok").agg(*_quality_counts()))


def write_with_quality(lines: DataFrame, path: str, fmt: str = "nginx") -> DataFrame:
    """Writes the strict entries of the lines and returns the row of :func:`parse_quality`.

    The counts are observed by the job that writes: the input is read once.
    """
    seen = Observation("parse quality")
    judged = _judged(lines, fmt).observe(seen, *_quality_counts())
    parse(judged.filter("_ok").drop("_ok"), fmt).write.mode("overwrite").parquet(path)
    counts = seen.get
    return _with_rate(session.table(lines.sparkSession, [(counts["lines_parsed"], counts["parse_errors"])],
                                    "lines_parsed bigint, parse_errors bigint"))


def skip_lines(lines: DataFrame, fmt: str = "nginx", profile: str = "strict") -> DataFrame:
    return _cleaned(lines, profile == "strict").filter(~_skipped(F.col("value"), fmt, profile))


def entry_projection(entries: DataFrame) -> DataFrame:
    """The nine exported columns, with an ISO timestamp in the line's own offset."""
    return entries.select(
        *[c for c in ("seq",) if c in entries.columns],
        "ip", text.iso_time(F.col("ts"), text.offset_of(entries)).alias("timestamp"), "method", "path", "status_code",
        "bytes_sent", "referrer", "user_agent", "source")
