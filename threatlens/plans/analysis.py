"""From lines to findings to reports."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlens import rules, session
from threatlens.operators import campaigns, detect, parsers, reports, respond
from threatlens.sources import files


@dataclass(frozen=True)
class Analysis:
    """Lazy entries and findings of one input, and the reports over them."""

    entries: DataFrame
    threats: DataFrame
    profile: str = "strict"
    config: dict | None = None
    source: str = ""

    @property
    def blocks(self) -> DataFrame:
        """Block decisions; only the classic profile with auto_block makes any."""
        chosen = (self.config or {}).get("response", {}).get("auto_block", {})
        found = self.threats
        if self.profile != "classic" or not chosen.get("enabled", False):
            found = found.filter(F.lit(False))
        return respond.block_decisions(found, chosen.get("method", "iptables"), chosen.get("duration", 3600))

    def materialize(self, path: str) -> Analysis:
        """Parses and detects once, into Parquet; later reports read the tables.

        The windowed detectors read entries twice and every report reads
        findings, so this pays as soon as more than one of them is wanted.
        """
        spark = self.entries.sparkSession
        entries = session.stage(self.entries, f"{path}/entries")
        found = detect.detect_all(entries, self.config, self.profile)
        respond.write_threats(found, f"{path}/threats")
        # Clean logs leave no file to infer a schema from.
        threats = spark.read.schema(found.schema).parquet(f"{path}/threats").drop("day")
        return replace(self, entries=entries, threats=threats)

    def summary(self) -> DataFrame:
        return reports.summary(self.entries, self.threats, self.blocks, self.source, self.profile)

    def campaigns(self) -> DataFrame:
        return campaigns.campaigns(self.threats)

    def write_reports(self, path: str, fmt: str = "both", generated: str = "",
                      started: datetime | None = None, ended: datetime | None = None) -> None:
        """The report files of the profile; only the classic ones show the run's period."""
        if fmt in ("json", "both"):
            respond.write_json_report(self.entries, self.threats, f"{path}/json", self.source,
                                      self.blocks, self.profile, generated, started=started, ended=ended)
        if fmt in ("txt", "text", "both"):
            if self.profile == "classic":
                report = reports.classic_text_report(self.entries, self.threats, self.blocks, started, ended, generated)
            else:
                report = reports.text_report(self.entries, self.threats, self.source, generated, self.blocks)
            respond.write_text_report(report, f"{path}/text")


def analyze_lines(lines: DataFrame, fmt: str = "nginx", profile: str = "strict",
                  config: dict | None = None, source: str = "", **options) -> Analysis:
    entries = parsers.parse(lines, fmt, profile, **options)
    return analyze_entries(entries, profile, config, source)


def analyze_entries(entries: DataFrame, profile: str = "strict", config: dict | None = None,
                    source: str = "") -> Analysis:
    rules.profile(profile)
    if "ip" not in entries.columns:
        raise ValueError("these records carry no address; detectors need access-log style entries "
                         "(for syslog, the strict profile gives them)")
    return Analysis(entries, detect.detect_all(entries, config, profile), profile, config, source)


def analyze_file(spark: SparkSession, path: str, fmt: str = "nginx", profile: str = "strict",
                 config: dict | None = None) -> Analysis:
    """One file; a missing one is an error (strict) or an empty analysis (classic)."""
    lines = files.scan_file(spark, path, "error" if profile == "strict" else "empty")
    return analyze_lines(lines, fmt, profile, config, path)


def analyze_directory(spark: SparkSession, path: str, pattern: str = "*.log", fmt: str = "nginx",
                      profile: str = "strict", config: dict | None = None) -> Analysis:
    """All matching files as one input: window counts run across file borders."""
    return analyze_lines(files.scan_directory(spark, path, pattern), fmt, profile, config, path)
