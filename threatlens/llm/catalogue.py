"""Queries of the corpus operators: one for each, over the whole ``documents`` table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlens import session
from threatlens.llm import (alignment, conversations, exact, language, mixing, packing, positions, quality, secret_scan, shared, simhash, spans,
                            token_files, weak_rules)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(shared.documents(spark, sf_dir)).select(
        "doc_id", shared.unsigned_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(shared.documents(spark, sf_dir), session.fresh_path(spark, "token-files"))


# A-Z only, as in the operator: DuckDB's lower() would also change other letters.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op6_exact_dedup", f"""WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
        doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
    FROM d WINDOW same AS (PARTITION BY t)""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(shared.documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(shared.documents(spark, sf_dir))


@query("op2_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.scored(shared.documents(spark, sf_dir), labels).select("doc_id", "held_out", "score", "predicted")


@query("op3_weak_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_rules.judged(shared.documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "posterior")


@query("op7_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(shared.documents(spark, sf_dir))


@query("op9_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.amounts(shared.documents(spark, sf_dir))


@query("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(shared.documents(spark, sf_dir))
    counts = [F.size(F.filter("base", _of_kind(kind))).cast("long").alias(f"n_{kind}") for kind in secret_scan.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"),
                        secret_scan.written(F.col("spans")).alias("spans"))


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


@query("op8_sentence_spans")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.deduplicated(shared.documents(spark, sf_dir)).select(
        "doc_id", F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), "removed", "text")


@query("op13_decontamination")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    n_hit = F.aggregate("hit", F.lit(0).cast("long"), lambda n, r: n + r["length"])
    return positions.contamination(shared.documents(spark, sf_dir), items).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query("op12_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(shared.documents(spark, sf_dir))


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = shared.prepare(spark).read.parquet(f"{sf_dir}/conversations.parquet")
    found = conversations.summary(conversations.damaged(convs))
    ids = convs.select("conv_id").distinct()
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in
               ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found, ids["conv_id"].eqNullSafe(found["conv_id"]), "left").select(
        ids["conv_id"], *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
