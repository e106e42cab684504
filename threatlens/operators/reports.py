"""Report queries over findings: counters, rankings, timelines, summaries.

Whoever needs several of them should write the findings once
(``respond.write_threats``) and read that table: every report here is one pass
over few columns of its input.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatlens import rules, session
from threatlens.functions import lookup, text

ORDER = ("seq", "det")


def count_by(threats: DataFrame, column: str) -> DataFrame:
    return threats.groupBy(column).agg(F.count("*").alias("count"))


def count_by_all(threats: DataFrame) -> DataFrame:
    """Counters by severity, type and address in one pass: (dimension, name, count)."""
    grouped = threats.groupingSets(
        [[F.col("severity")], [F.col("threat_type")], [F.col("source_ip")]],
        F.col("severity"), F.col("threat_type"), F.col("source_ip"),
    ).agg(F.count("*").alias("count"), F.min(_order_key()).alias("first"), F.grouping_id().alias("gid"))
    dimension = (F.when(F.col("gid") == 3, F.lit("severity"))
                 .when(F.col("gid") == 5, F.lit("threat_type")).otherwise(F.lit("source_ip")))
    return grouped.select(
        dimension.alias("dimension"),
        F.coalesce("severity", "threat_type", "source_ip").alias("name"), "count", "first")


def _order_key() -> Column:
    return F.struct(*ORDER)


def distinct_attackers(threats: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct("source_ip") if approximate else F.count_distinct("source_ip")
    return threats.agg(count.alias("unique_attacker_ips"))


def top_attackers(threats: DataFrame, n: int = 10) -> DataFrame:
    """Addresses by number of findings; ties in order of first appearance."""
    return (threats.groupBy("source_ip").agg(F.count("*").alias("count"), F.min(_order_key()).alias("first"))
            .orderBy(F.desc("count"), "first").limit(n)
            .select(F.col("source_ip").alias("ip"), "count", "first"))


def recent(threats: DataFrame, n: int = 50) -> DataFrame:
    """The last n findings in arrival order."""
    return threats.orderBy(*[F.desc(c) for c in ORDER]).limit(n)


def first(threats: DataFrame, n: int = 100) -> DataFrame:
    return threats.orderBy(*ORDER).limit(n)


def head_entries(entries: DataFrame, n: int = 100) -> DataFrame:
    return entries.orderBy("seq").limit(n)


def filter_threats(threats: DataFrame, severity: str | None = None, threat_type: str | None = None,
                   limit: int | None = None) -> DataFrame:
    """The tail limit comes before the filters, as in the dashboard query."""
    found = recent(threats, limit) if limit is not None else threats
    if severity:
        found = found.filter(F.col("severity") == severity.upper())
    if threat_type:
        found = found.filter(F.upper("threat_type") == threat_type.upper())
    return found


def threats_by_severity(threats: DataFrame) -> DataFrame:
    """Findings of the four known severities, tagged with the bucket's position."""
    return threats.filter(F.col("severity").isin(*rules.SEVERITIES)) \
        .withColumn("bucket", 3 - lookup.severity_rank(F.col("severity")))


def severity_order(threats: DataFrame, keep_missing: bool = True) -> DataFrame:
    """Counts in the fixed order CRITICAL to LOW; absent ones are 0 or left out."""
    table = lookup.severity_table(threats.sparkSession)
    counts = count_by(threats, "severity")
    return (table.join(counts, "severity", "left" if keep_missing else "inner")
            .select("severity", (3 - F.col("rank")).alias("position"),
                    F.coalesce("count", F.lit(0).cast("bigint")).alias("count")).orderBy("position"))


def sort_types(threats: DataFrame, profile: str = "strict") -> DataFrame:
    """Counts by type: by name, or (classic) by count with ties in order of appearance."""
    counts = threats.groupBy("threat_type").agg(
        F.count("*").alias("count"), F.min(_order_key()).alias("first"))
    order = ["threat_type"] if profile == "strict" else [F.desc("count"), "first"]
    return counts.orderBy(*order)


def timeline(threats: DataFrame) -> DataFrame:
    """Findings per hour of their own clock; those without a time are left out."""
    return (threats.filter("ts is not null")
            .groupBy(text.hour_bucket(F.col("ts"), text.offset_of(threats)).alias("hour"))
            .agg(F.count("*").alias("count")).orderBy("hour"))


def period_report(threats: DataFrame, period: str = "1 day") -> DataFrame:
    """Findings, attackers and change to the period reported before, per type and period."""
    by_period = (threats.filter("ts is not null")
                 .groupBy("threat_type", F.window("ts", period)["start"].alias("period_start"))
                 .agg(F.count("*").alias("count"), F.count_distinct("source_ip").alias("attackers")))
    before = Window.partitionBy("threat_type").orderBy("period_start")
    return by_period.withColumn("change", F.col("count") - F.lag("count", 1, 0).over(before))


def file_reports(entries: DataFrame, threats: DataFrame, column: str) -> DataFrame:
    """Lines and findings per input file (or any other column both sides carry)."""
    lines = entries.groupBy(column).agg(F.count("*").alias("lines"))
    found = threats.groupBy(column).agg(F.count("*").alias("threats"))
    return lines.join(found, column, "left").withColumn("threats", F.coalesce("threats", F.lit(0).cast("bigint")))


def merge_reports(per_file: DataFrame) -> DataFrame:
    """Totals over the rows of :func:`file_reports`."""
    return per_file.agg(F.count("*").alias("files"), F.sum("lines").alias("lines"),
                        F.sum("threats").alias("threats"))


#: Relative standard error of the address sketches: 1.04 / sqrt(2 ** SKETCH_BITS), and a little for merging.
SKETCH_BITS = 14
SKETCH_ERROR = 0.01


def file_sketches(entries: DataFrame, threats: DataFrame, column: str) -> DataFrame:
    """:func:`file_reports` with mergeable sketches of the addresses seen and of those with findings, a few KB each."""
    lines = entries.groupBy(column).agg(F.count("*").alias("lines"), F.hll_sketch_agg("ip", SKETCH_BITS).alias("ips"))
    found = threats.groupBy(column).agg(F.count("*").alias("threats"),
                                        F.hll_sketch_agg("source_ip", SKETCH_BITS).alias("attackers"))
    return lines.join(found, column, "left").withColumn("threats", F.coalesce("threats", F.lit(0).cast("bigint")))


def merge_sketches(per_file: DataFrame) -> DataFrame:
    """Totals and estimated distinct addresses over the rows of :func:`file_sketches`; no raw row is read again."""
    return per_file.agg(
        F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("threats").alias("threats"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("ips")), F.lit(0)).alias("unique_ips"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("attackers")), F.lit(0)).alias("unique_attackers"))


def union_ips(*sides: DataFrame) -> DataFrame:
    """Distinct addresses of several one-column DataFrames; each side shrinks first."""
    out = sides[0].distinct()
    for side in sides[1:]:
        out = out.union(side.distinct())
    return out.distinct()


def _metric(df: DataFrame, section: str, name: Column | str = "", value: str = "value") -> DataFrame:
    name = F.lit(name) if isinstance(name, str) else name
    return df.select(F.lit(section).alias("section"), name.alias("name"),
                     F.col(value).cast("bigint").alias("value"))


def _traffic_totals(entries: DataFrame, threats: DataFrame) -> DataFrame:
    """Lines, requests and distinct addresses of traffic and findings, in one pass over either."""
    addresses = entries.select("ip", F.lit(1).alias("n")).unionByName(
        threats.select(F.col("source_ip").alias("ip"), F.lit(0).alias("n")))
    totals = addresses.groupBy("ip").agg(F.sum("n").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("lines"), F.count("*").alias("ips"))
    return totals.select(F.explode(F.array(*[
        F.struct(F.lit("totals").alias("section"), F.lit(name).alias("name"), F.col(c).alias("value"))
        for name, c in (("lines_processed", "lines"), ("requests", "lines"), ("unique_ips", "ips"))])).alias("m")
    ).select("m.*")


def summary_rows(entries: DataFrame, threats: DataFrame, blocked: DataFrame | None = None,
                 profile: str = "strict") -> DataFrame:
    """The summary as (section, name, value) rows.

    Findings are read once: grouping sets give the severity, type and address
    counters, and a second, tiny aggregation turns addresses into a number.
    """
    spark = entries.sparkSession
    per_name = count_by_all(threats.select(
        "severity", "threat_type", "source_ip", *ORDER)).select(
        F.when(F.col("dimension") == "source_ip", F.lit("totals"))
         .when(F.col("dimension") == "severity", F.lit("severity")).otherwise(F.lit("type")).alias("section"),
        F.when(F.col("dimension") == "source_ip", F.lit("unique_attacker_ips"))
         .otherwise(F.col("name")).alias("name"),
        F.when(F.col("dimension") == "source_ip", F.lit(1).cast("bigint")).otherwise(F.col("count")).alias("value"),
        F.when(F.col("dimension") == "severity", F.col("count")).alias("threats"))
    per_section = per_name.groupBy("section", "name").agg(
        F.sum("value").alias("value"), F.sum("threats").alias("threats"))
    expanded = per_section.select(F.explode(F.array_compact(F.array(
        F.struct("section", "name", "value"),
        F.when(F.col("threats").isNotNull(), F.struct(
            F.lit("totals").alias("section"), F.lit("threats").alias("name"),
            F.col("threats").alias("value")))))).alias("m")).select("m.*")
    if profile == "classic":
        lines = _traffic_totals(entries, threats)
    else:
        lines = _metric(entries.agg(F.count("*").alias("value")), "totals", "lines_processed")
    zeros = session.table(
        spark, [("totals", n, 0) for n in ("lines_processed", "threats", "unique_attacker_ips", "blocked_ips")],
        "section string, name string, value bigint")
    out = expanded.unionByName(lines).unionByName(zeros)
    if blocked is not None:
        out = out.unionByName(_metric(
            blocked.agg(F.count_distinct("ip").alias("value")), "totals", "blocked_ips"))
    return out.groupBy("section", "name").agg(F.sum("value").alias("value"))


def summary(entries: DataFrame, threats: DataFrame, blocked: DataFrame | None = None,
            source_file: str = "", profile: str = "strict", started: datetime | None = None,
            ended: datetime | None = None) -> DataFrame:
    """The summary as one row; its maps hold one entry per severity and per type.

    The classic one also has the ten busiest attackers and, where the run's
    start and end are given, its period.
    """
    rows = summary_rows(entries, threats, blocked, profile)
    if profile == "classic":
        place = F.row_number().over(Window.orderBy(F.desc("count"), "first"))      # of ten rows
        top = top_attackers(threats, 10).select(
            F.lit("top").alias("section"), F.concat(F.lpad(place.cast("string"), 2, "0"), F.lit(" "), F.col("ip")).alias("name"),
            F.col("count").alias("value"))
        rows = rows.unionByName(top)

    def total(name: str) -> Column:
        return F.max(F.when((F.col("section") == "totals") & (F.col("name") == name), F.col("value")))

    def counters(section: str) -> Column:
        return F.map_from_entries(F.array_sort(F.array_compact(F.collect_list(
            F.when(F.col("section") == section, F.struct("name", "value"))))))
    columns = [total("lines_processed").alias("total_lines_processed"),
               total("threats").alias("total_threats"),
               total("blocked_ips").alias("blocked_ips_count"),
               counters("severity").alias("severity_breakdown"),
               counters("type").alias("threat_type_breakdown"),
               total("unique_attacker_ips").alias("unique_attacker_ips")]
    if profile == "classic":
        columns += [total("requests").alias("requests"), total("unique_ips").alias("unique_ips")]
        listed = F.array_sort(F.array_compact(F.collect_list(F.when(F.col("section") == "top", F.struct("name", "value")))))
        columns.append(F.transform(listed, lambda t: F.struct(
            F.substring_index(t["name"], " ", -1).alias("ip"), t["value"].alias("count"))).alias("top_attacker_ips"))
        if started is not None and ended is not None:
            columns.append(F.struct(
                F.lit(started.isoformat()).alias("start"), F.lit(ended.isoformat()).alias("end"),
                F.lit((ended - started).total_seconds()).alias("duration_seconds")).alias("period"))
    return rows.agg(*columns).withColumn("source_file", F.lit(source_file))


def classic_summary(entries: DataFrame, threats: DataFrame, blocked: DataFrame | None = None,
                    started: datetime | None = None, ended: datetime | None = None) -> DataFrame:
    """The classic summary in the nesting of its JSON report, one row."""
    one = summary(entries, threats, blocked, "", "classic", started, ended)
    period = F.col("period") if "period" in one.columns else F.lit(None).cast(
        "struct<start:string,end:string,duration_seconds:double>")
    return one.select(
        period.alias("period"),
        F.struct(F.col("total_lines_processed").alias("lines_processed"), "requests", "unique_ips",
                 F.col("total_threats").alias("threats_detected"),
                 F.col("blocked_ips_count").alias("ips_blocked")).alias("totals"),
        F.col("threat_type_breakdown").alias("threats_by_type"),
        F.col("severity_breakdown").alias("threats_by_severity"), "top_attacker_ips")


def dashboard_stats(entries: DataFrame, threats: DataFrame, top: int = 10, last: int = 50) -> DataFrame:
    """Totals, breakdowns, top addresses and latest findings: (section, position, name, value)."""
    counters = summary_rows(entries, threats).filter(
        (F.col("section") != "totals") | F.col("name").isin("lines_processed", "threats")) \
        .select("section", F.lit(0).cast("bigint").alias("position"), "name", "value")
    return counters.unionByName(_ranked(top_attackers(threats, top), "top_ips", [F.desc("count"), F.col("first")],
                                        F.col("ip"), F.col("count"))) \
        .unionByName(_ranked(recent(threats.select("threat_type", *ORDER), last), "recent_threats",
                             [F.desc(c) for c in ORDER], F.col("threat_type"), F.col("seq.pos")))


def _ranked(limited: DataFrame, section: str, order: Sequence[Column], name: Column, value: Column) -> DataFrame:
    # The input is already limited to a handful of rows.
    position = F.row_number().over(Window.partitionBy(F.lit(section)).orderBy(*order))
    return limited.select(F.lit(section).alias("section"), position.cast("bigint").alias("position"),
                          name.alias("name"), value.cast("bigint").alias("value"))


def text_report(entries: DataFrame, threats: DataFrame, source_file: str = "",
                generated: str = "", blocked: DataFrame | None = None, details: int = 100,
                title: str = "SECURITY ANALYSIS REPORT") -> DataFrame:
    """Lines of the text report (strict profile) with their order: (section, item, part, line).

    Only limited or fixed-size parts are listed, so the sort and the write are small.
    """
    spark = entries.sparkSession
    # A few counters, used by several parts below: computed once.
    rows = session.table(spark, [tuple(r) for r in summary_rows(entries, threats, blocked).collect()],
                         "section string, name string, value bigint")
    totals = rows.filter("section = 'totals'")
    labels = {"lines_processed": "Lines Processed  ", "threats": "Threats Detected ",
              "unique_attacker_ips": "Unique Attackers ", "blocked_ips": "Blocked IPs      "}

    def fixed(section: int, lines: Sequence[str]) -> list[tuple]:
        return [(section, i, 0, line) for i, line in enumerate(lines)]
    frame = session.table(
        spark, fixed(0, ["=" * 70, f"  {title}", "=" * 70, f"  Generated: {generated}",
                  f"  Source: {source_file}", "=" * 70, "", "SUMMARY", "-" * 40])
        + fixed(2, ["", "SEVERITY BREAKDOWN", "-" * 40])
        + fixed(4, ["", "THREAT TYPES", "-" * 40])
        + fixed(6, ["", "TOP ATTACKER IPs", "-" * 40])
        + fixed(8, ["", "DETAILED THREATS", "-" * 70])
        + fixed(11, ["=" * 70, "  END OF REPORT", "=" * 70]),
        "section int, item int, part int, line string")

    def lines(df: DataFrame, section: int, item: Column, line: Column, part: Column | None = None) -> DataFrame:
        return df.select(F.lit(section).alias("section"), item.cast("int").alias("item"),
                         (part if part is not None else F.lit(0)).cast("int").alias("part"), line.alias("line"))
    shown = F.element_at(lookup.literal_map(labels), F.col("name"))
    position = F.element_at(lookup.literal_map({n: i for i, n in enumerate(labels)}), F.col("name"))
    counts = lines(totals.filter(F.col("name").isin(*labels)), 1, position, F.concat(
        F.lit("  "), shown, F.lit(": "), F.col("value").cast("string")))
    bars = lines(
        lookup.severity_table(spark).join(
            rows.filter("section = 'severity'").select(F.col("name").alias("severity"), "value"), "severity", "left")
        .withColumn("value", F.coalesce("value", F.lit(0).cast("bigint"))),
        3, 3 - F.col("rank"), F.format_string(
            "  %-10s: %4d %s", "severity", "value", F.repeat(F.lit("#"), F.least("value", F.lit(50)).cast("int"))))
    types = rows.filter("section = 'type'").withColumn(
        "item", F.row_number().over(Window.partitionBy("section").orderBy("name")))
    types = lines(types, 5, F.col("item"), F.format_string("  %-20s: %4d", "name", "value"))
    top = _ranked(top_attackers(threats, 10), "top", [F.desc("count"), F.col("first")], F.col("ip"), F.col("count"))
    top = lines(top, 7, F.col("position"), F.format_string("  %-20s: %4d threats", "name", "value"))
    listed = first(threats.select("severity", "threat_type", "source_ip",
                                  text.local_time(F.col("ts"), text.offset_of(threats)).alias("ts"),
                                  "description", "payload", *ORDER), details)
    listed = listed.withColumn("item", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*ORDER)))
    stamp = F.coalesce(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("N/A"))
    block = F.array_compact(F.array(
        F.format_string("  [%d] %s | %s | %s | %s", "item", "severity", "threat_type", "source_ip", stamp),
        F.concat(F.lit("      "), F.col("description")),
        F.when(F.col("payload") != "", F.concat(F.lit("      Payload: "), text.truncate(F.col("payload"), 120))),
        F.lit("")))
    listed = listed.select("item", F.posexplode(block).alias("part", "line"))
    listed = lines(listed, 9, F.col("item"), F.col("line"), F.col("part"))
    more = lines(totals.filter((F.col("name") == "threats") & (F.col("value") > details)), 10, F.lit(0),
                 F.format_string("  ... and %d more threats", F.col("value") - details))
    out = frame
    for part in (counts, bars, types, top, listed, more):
        out = out.unionByName(part)
    return out.orderBy("section", "item", "part")


def classic_text_report(entries: DataFrame, threats: DataFrame, blocked: DataFrame | None = None,
                        started: datetime | None = None, ended: datetime | None = None,
                        generated: str = "", title: str = "SECURITY REPORT") -> DataFrame:
    """Lines of the text report (classic profile) with their order: (section, item, part, line).

    Sections of counters are left out when nothing was found.  Every part is a
    handful of counters, whatever the number of findings.
    """
    one = classic_summary(entries, threats, blocked, started, ended).first()     # counters and ten addresses
    thick, thin = "=" * 70, "-" * 70
    titles = rules.CLASSIC_REPORT_TITLES
    shown = {severity: one["threats_by_severity"].get(severity) for severity in reversed(rules.SEVERITIES)}
    # Types in order of their number of findings, then of their first one.
    types = [(r["threat_type"], r["count"]) for r in sort_types(threats, "classic").collect()]

    def part(heading: str, lines: Sequence[str]) -> list[str]:
        return [f"  {titles[heading]}", thin, *lines] if lines else []
    sections = [
        [thick, f"  {title}", thick],
        [f"  Başlangıç : {started.isoformat() if started else 'N/A'}",
         f"  Bitiş     : {ended.isoformat() if ended else 'N/A'}", thin],
        part("totals", [f"  {label}: {one['totals'][name]:,}" for name, label in rules.CLASSIC_REPORT_TOTALS.items()])
        + [thin],
        part("type", [f"  {name:<30} : {count:,}" for name, count in types]),
        part("severity", [f"  {name:<30} : {count:,}" for name, count in shown.items() if count]),
        part("top", [f"  {i:2}. {t['ip']:<20} : {t['count']:,} olay" for i, t in enumerate(one["top_attacker_ips"], 1)]),
        [f"  Rapor oluşturuldu: {generated}", thick]]
    rows = [(number, i, 0, line) for number, lines in enumerate(sections) for i, line in enumerate(lines)]
    rows += [(number, 1_000_000, 0, thin) for number in (3, 4, 5) if sections[number]]
    return session.table(entries.sparkSession, rows, "section int, item int, part int, line string") \
        .orderBy("section", "item", "part")
