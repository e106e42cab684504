"""Hand-over to an external scorer: request tables out, reply tables in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threatlens import rules
from threatlens.functions import lookup, text

BATCH_HEADER = "Assess these log entries and answer with one JSON object.\n\n"


def batch_prompts(entries: DataFrame, max_lines: int = 50, header: str = BATCH_HEADER) -> DataFrame:
    """One request per ``max_lines`` raw lines in arrival order; only the last may be shorter.

    Lines are numbered inside their slice of the input, and slices through their
    line counts, so batches do not depend on where files are split.
    """
    lines = entries.select("raw", F.col("seq.part").alias("part"), F.col("seq.pos").alias("pos"))
    counts = lines.groupBy("part").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)      # one row per slice
    bases = counts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("pos")) - 1
    numbered = lines.withColumn("inside", inside).join(bases, "part").select(
        "raw", "pos", (F.col("base") + F.col("inside")).alias("line")).withColumn("batch", F.floor(F.col("line") / max_lines))
    listed = F.array_sort(F.collect_list(F.struct("line", "raw")))
    return numbered.groupBy("batch").agg(
        F.count("*").alias("lines"), F.min_by("pos", "line").alias("first_pos"),
        F.concat(F.lit(header), F.array_join(F.transform(listed, lambda r: r["raw"]), "\n")).alias("prompt"))


def head_prompt(entries: DataFrame, max_lines: int = 100, header: str = BATCH_HEADER) -> DataFrame:
    """A single request with the first ``max_lines`` lines."""
    head = entries.select("seq", "raw").orderBy("seq").limit(max_lines)
    return head.agg(F.concat(F.lit(header), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "raw"))), lambda r: r["raw"]), "\n")).alias("prompt"))


def entry_prompts(entries: DataFrame) -> DataFrame:
    """One request per entry, with six labelled fields (classic profile)."""
    return entries.select("seq", F.concat(
        F.lit("IP: "), "ip", F.lit("\nMethod: "), "method", F.lit("\nPath: "), "path",
        F.lit("\nStatus: "), F.col("status_code").cast("string"),
        F.lit("\nUser-Agent: "), text.truncate(F.col("user_agent"), 200),
        F.lit("\nBytes: "), F.col("bytes_sent").cast("string"), F.lit("\n")).alias("prompt"))


def rule_scorer(profile: str | rules.Profile = "classic") -> Callable[[Column], Column]:
    """A scorer from the profile's own pattern rules, for use where no service may be asked.

    It reads the path and the user agent of an entry's request (:func:`entry_prompts`) and
    answers with the first rule that matches, in the profile's order.  The confidence is the
    rule's own, null where the profile gives none.
    """
    p = rules.profile(profile)
    decode = text.url_decode_once if p.name == "classic" else text.url_decode_twice

    def reply(prompt: Column) -> Column:
        path = decode(F.regexp_extract(prompt, r"(?s)\nPath: (.*?)\nStatus: ", 1))
        agent = F.regexp_extract(prompt, r"(?s)\nUser-Agent: (.*)\nBytes: ", 1)

        def answer(threat: bool, kind: str, severity: str, confidence: float | None, reason: str) -> Column:
            return F.to_json(F.struct(
                F.lit(threat).alias("is_threat"), F.lit(kind).alias("threat_type"), F.lit(severity).alias("severity"),
                F.lit(confidence).cast("double").alias("confidence"), F.lit(reason).alias("reason")),
                {"ignoreNullFields": "false"})
        out = answer(False, "NORMAL", "NONE", None, "no rule matches")
        for rule in sorted(p.rules, key=lambda r: p.order.index(r.threat_type), reverse=True):
            hit = (agent if rule.text == "user_agent" else path).rlike(text.any_of(rule.patterns))
            out = F.when(hit, answer(True, rule.threat_type, rule.severity, rule.confidence, rule.name)).otherwise(out)
        return out
    return reply


def batch_scorer(answer: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """A scorer from a function of pandas batches, such as a client of a service; called on executors."""
    @F.pandas_udf("string")
    def replies(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield answer(batch)
    return replies


def score_external(requests: DataFrame, scorer: Callable[[Column], Column], column: str = "prompt",
                   require_all: bool = True) -> DataFrame:
    """Requests with the scorer's reply as a struct, null when it cannot be read."""
    return requests.withColumn("reply_text", scorer(F.col(column))) \
        .withColumn("reply", lookup.reply(F.col("reply_text"), require_all)).drop("reply_text")
