"""Responses to findings as tables: blocks, alerts, reports.

Nothing here calls a firewall or a web service; the tables say what to do.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlens import rules
from threatlens.functions import lookup, text
from threatlens.functions.text import floor_div
from threatlens.operators import reports


def blockable(threats: DataFrame) -> DataFrame:
    return threats.filter(F.col("severity").isin("HIGH", "CRITICAL"))


def alertable(threats: DataFrame, minimum: str = "MEDIUM") -> DataFrame:
    return threats.filter(lookup.severity_rank(F.col("severity")) >= rules.SEVERITIES.index(minimum))


def first_per_ip(threats: DataFrame) -> DataFrame:
    """The first finding of each address; an aggregate, so hot addresses combine early."""
    at = F.struct(*reports.ORDER)
    return threats.groupBy("source_ip").agg(F.min_by(
        F.struct("seq", "det", "ts", "threat_type", "severity"), at).alias("f")).select("source_ip", "f.*")


def block_decisions(threats: DataFrame, method: str = "iptables", duration: int = 3600) -> DataFrame:
    """One block per address, from its first HIGH or CRITICAL finding; duration 0 is forever."""
    return first_per_ip(blockable(threats)).select(
        F.col("source_ip").alias("ip"), F.col("ts").alias("blocked_at"), "threat_type", "severity",
        F.lit(method).alias("method"), F.lit(duration).alias("duration"), "seq")


def _active(ts: Column) -> Column:
    return (ts >= F.col("blocked_at")) & (
        (F.col("duration") == 0)
        | (F.unix_micros(ts) < F.unix_micros("blocked_at") + F.col("duration").cast("bigint") * 1_000_000))


#: Hours of a bin of the interval join, bins a term may reach into, the least copies of a block in a crowded bin,
#: and the entries of an address and bin that make a crowd.
BIN_HOURS, MOST_BINS, COPIES, CROWD = 6, 1024, 16, 50_000


def blocked_entries(entries: DataFrame, decisions: DataFrame, blocked: bool = True) -> DataFrame:
    """Entries that met an active block of their address (or, negated, did not).

    An interval join by bins of time: a block is listed under every bin it reaches
    into, and an entry looks in its own.  Blocks without an end, or with a term of more
    than ``MOST_BINS`` bins, stand under one bin of their own.  Where an address has
    more than ``CROWD`` entries in a bin, its blocks there have a copy for each
    ``CROWD`` of them, ``COPIES`` at least, and the entries are spread over the copies;
    elsewhere there is one.  The listed blocks are always shuffled: Spark would judge their size by the
    blocks alone and broadcast them.  Entries are read once more for their counts.  The
    terms of an address must not overlap (``block_decisions`` has one, live blocks
    follow each other), so no entry is multiplied.
    """
    size = BIN_HOURS * 3600
    blocks = decisions.select(F.col("ip").alias("_ip"), "blocked_at", "duration")
    lasting = (F.col("duration") == 0) | (F.col("duration") > size * (MOST_BINS - 1))
    first = floor_div(F.unix_seconds("blocked_at"), size)
    last = floor_div(F.unix_seconds("blocked_at") + F.col("duration"), size)
    in_bin = floor_div(F.unix_seconds("ts"), size)
    binned = blocks.filter(~lasting).withColumn("_of", F.explode(F.sequence(first, last)))
    always = blocks.filter(lasting).withColumn("_of", F.lit(0).cast("bigint"))
    timed = entries
    for rows, flag, of in ((binned, "_met", in_bin), (always, "_met_lasting", F.lit(0).cast("bigint"))):
        crowds = F.broadcast(entries.groupBy(F.col("ip").alias("_ip"), of.alias("_of")).agg(F.count("*").alias("_n"))
                             .where(F.col("_n") > CROWD)
                             .select("_ip", "_of", F.greatest(F.lit(COPIES), F.ceil(F.col("_n") / CROWD)).alias("_copies")))
        side = rows.join(crowds, ["_ip", "_of"], "left").withColumn(
            "_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).select(
            "_ip", "_of", "blocked_at", "duration", "_copy", F.lit(True).alias(flag))
        own = timed.withColumn("_entry_of", of).join(
            crowds.select(F.col("_ip").alias("_crowd_ip"), F.col("_of").alias("_crowd_of"), "_copies"),
            (F.col("ip") == F.col("_crowd_ip")) & (F.col("_entry_of") == F.col("_crowd_of")), "left").withColumn(
            "_entry_copy", F.pmod(F.monotonically_increasing_id(), F.coalesce("_copies", F.lit(1)))).drop(
            "_crowd_ip", "_crowd_of", "_copies")
        same = (F.col("ip") == F.col("_ip")) & (F.col("_entry_of") == F.col("_of")) \
            & (F.col("_entry_copy") == F.col("_copy")) & _active(F.col("ts"))
        timed = own.join(side.hint("merge"), same, "left").drop(
            "_ip", "_of", "blocked_at", "duration", "_copy", "_entry_of", "_entry_copy")
    hit = F.coalesce("_met", "_met_lasting", F.lit(False))
    return timed.filter(hit if blocked else ~hit).select(*entries.columns)


def responder_stats(threats: DataFrame, alerters: int = 1, block: bool = True) -> DataFrame:
    """Findings seen, block actions taken and alerts sent, in one pass."""
    rank = lookup.severity_rank(F.col("severity"))
    return threats.agg(
        F.count("*").alias("total_threats"),
        (F.count_if(F.col("severity").isin("HIGH", "CRITICAL")) * int(block)).alias("blocked_ips"),
        (F.count_if(rank >= 1) * alerters).alias("alerts_sent"))


def _clock(offset: Column) -> Column:
    return F.date_format(text.local_time(F.col("ts"), offset), "yyyy-MM-dd HH:mm:ss")


def slack_message(footer: str = "threatlens", offset: Column | None = None) -> Column:
    """A Slack attachment as JSON text (classic profile); ``offset`` is the clock to show, in minutes."""
    def field(title: str, value: Column, short: bool) -> Column:
        return F.struct(F.lit(title).alias("title"), value.alias("value"), F.lit(short).alias("short"))
    when = _clock(F.lit(0) if offset is None else offset)
    fields = F.array(
        field("Kaynak IP", F.col("source_ip"), True), field("Hedef", _or_dash(F.col("target")), True),
        field("Açıklama", F.col("description"), False), field("Zaman", when, True),
        F.when(F.col("payload") != "", field("Payload", F.concat(
            F.lit("`"), text.truncate(F.col("payload"), 500), F.lit("`")), False)))
    return F.to_json(F.struct(F.array(F.struct(
        F.coalesce(F.element_at(lookup.literal_map(rules.SLACK_COLORS), F.col("severity")),
                   F.lit("#808080")).alias("color"),
        F.concat(F.lit("\U0001F6A8 "), "severity", F.lit(" - "), "threat_type").alias("title"),
        F.array_compact(fields).alias("fields"), F.lit(footer).alias("footer"),
        F.unix_seconds("ts").alias("ts"))).alias("attachments")))


def slack_text() -> Column:
    """The short Slack message (strict profile)."""
    return F.concat(F.lit(":rotating_light: *"), "severity", F.lit(" - "), "threat_type", F.lit("*\nIP: "),
                    "source_ip", F.lit("\n"), "description")


def telegram_text(offset: Column | None = None) -> Column:
    mark = F.coalesce(F.element_at(lookup.literal_map(rules.TELEGRAM_MARKS), F.col("severity")), F.lit("⚪"))
    return F.concat(
        mark, F.lit(" *"), "severity", F.lit(" - "), "threat_type", F.lit("*\n\n\U0001F4CD Kaynak IP: `"),
        "source_ip", F.lit("`\n\U0001F3AF Hedef: `"), _or_dash(F.col("target")),
        F.lit("`\n\U0001F4DD Açıklama: "), "description", F.lit("\n⏰ Zaman: `"),
        F.coalesce(_clock(F.lit(0) if offset is None else offset), F.lit("N/A")), F.lit("`"),
        F.when(F.col("payload") != "", F.concat(
            F.lit("\n\U0001F489 Payload: `"), text.truncate(F.col("payload"), 300), F.lit("`")))
        .otherwise(F.lit("")))


def _or_dash(c: Column) -> Column:
    return F.when(c == "", F.lit("-")).otherwise(F.coalesce(c, F.lit("-")))


def alert_outbox(threats: DataFrame, profile: str = "classic") -> DataFrame:
    """Messages to send, one row per finding and channel; raw log lines stay out."""
    carried = ["seq", "det", "severity", "threat_type", "source_ip"]
    if profile == "strict":
        return threats.select(*carried, F.lit("slack").alias("channel"), slack_text().alias("message"))
    offset = text.offset_of(threats)
    messages = F.array(
        F.struct(F.lit("slack").alias("channel"), slack_message(offset=offset).alias("message")),
        F.struct(F.lit("telegram").alias("channel"), telegram_text(offset).alias("message")))
    return alertable(threats).select(*carried, F.explode(messages).alias("m")).select(*carried, "m.*")


def write_threats(threats: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Findings as Parquet, partitioned by day and severity.

    Rows are rebalanced first: few files per folder, and large folders split.
    """
    (threats.withColumn("day", F.to_date("ts")).hint("rebalance", "day", "severity").write.mode(mode)
     .partitionBy("day", "severity").parquet(path))


def write_json_report(entries: DataFrame, threats: DataFrame, path: str, source_file: str = "",
                      blocked: DataFrame | None = None, profile: str = "strict",
                      generated: str = "", version: str = "1.0.0", started: datetime | None = None,
                      ended: datetime | None = None) -> None:
    """Findings as JSON lines in ``threats``, the summary as one JSON object in ``summary``.

    Each profile has its own layout of the summary.  Findings are never put into
    that one object, as their number has no bound.
    """
    from threatlens.operators.detect import threat_dict
    threat_dict(threats, profile).write.mode("overwrite").json(f"{path}/threats")
    if blocked is not None:
        blocked.select("ip").distinct().write.mode("overwrite").json(f"{path}/blocked_ips")
    if profile == "classic":
        reports.classic_summary(entries, threats, blocked, started, ended) \
            .coalesce(1).write.mode("overwrite").json(f"{path}/summary")
        return
    top = reports.top_attackers(threats, 10).agg(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("rank"), "first", "ip", "count"))),
        lambda r: F.struct(r["ip"].alias("ip"), r["count"].alias("count"))).alias("top_attacker_ips"))
    line = reports.summary(entries, threats, blocked, source_file, profile).select(
        F.lit(1).alias("_one"), F.struct("*").alias("summary"))
    meta = F.struct(F.lit(generated).alias("generated_at"), F.lit(source_file).alias("source_file"),
                    F.lit(version).alias("analyzer_version"))
    (line.join(top.withColumn("_one", F.lit(1)), "_one")      # one row on either side
     .select(meta.alias("meta"), "summary", "top_attacker_ips")
     .coalesce(1).write.mode("overwrite").json(f"{path}/summary"))


def write_text_report(report: DataFrame, path: str) -> None:
    """The lines of ``reports.text_report``; bounded, hence one file."""
    report.select("line").coalesce(1).write.mode("overwrite").text(path)
