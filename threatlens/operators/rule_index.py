"""Rules found through an inverted index of what their patterns demand.

Most patterns demand some literal text.  A rule is listed under one q-gram of its
literal, the one that fewest rows hold; a row asks only for the rules listed under
its own q-grams, and only those patterns are run on it.  Rules without a literal
are kept apart and run on every row.  Texts and literals are compared in lower
case, which is never stricter than the pattern.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlens import session

Q = 3
#: Lengths of q-grams: a literal has those of the largest that fits.  Buckets that count them, and hashes broadcast at most.
SIZES, BUCKETS, MOST = (Q, 6, 12), 1 << 20, 1 << 20
_STEP = 1 << 40
#: Escapes that stand for one plain character are those of marks; others end a run or need care.
_CLASSES = frozenset("dDsSwWbBAzZGhHvVR")


def required_literal(pattern: str) -> str | None:
    """The longest text of at least ``Q`` ASCII characters, lower-cased, that every match holds; None if unknown.

    Reads the outermost level of a pattern in the Java dialect: groups and classes end a
    run of characters, a quantifier takes the character before it away, and whatever it
    does not know for certain makes it give up.
    """
    at, runs, run = 0, [], ""
    if pattern.startswith("(?"):
        flags, _, rest = pattern[2:].partition(")")
        if flags and set(flags) <= set("ism"):
            pattern = rest
    if "(?x" in pattern or "\\Q" in pattern:
        return None
    while at < len(pattern):
        c = pattern[at]
        at += 1
        if c == "\\":
            if at == len(pattern):
                return None
            c = pattern[at]
            at += 1
            if c.isalnum():
                if c not in _CLASSES:
                    return None                     # a code point, a property or a reference
                runs, run = [*runs, run], ""
                continue
        elif c == "|":
            return None
        elif c in "([":
            at = _closing(pattern, at - 1)
            if at is None:
                return None
            runs, run = [*runs, run], ""
            continue
        elif c in ".^$":
            runs, run = [*runs, run], ""
            continue
        elif c in "*?{":
            if c == "{":
                end = pattern.find("}", at)
                if end < 0:
                    return None
                at = end + 1
            runs, run = [*runs, run[:-1]], ""
            continue
        elif c == "+":
            runs, run = [*runs, run], ""
            continue
        elif c in ")]}":
            return None
        run += c
    best = max((r for r in [*runs, run] if r.isascii()), key=len, default="")
    return best.lower() if len(best) >= Q else None


def _closing(pattern: str, at: int) -> int | None:
    """The place after the group or class that opens at ``at``."""
    depth, inside = 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            at += 1
        elif c == "[":
            inside += 1
        elif c == "]" and inside:
            inside -= 1
        elif not inside and c == "(":
            depth += 1
        elif not inside and c == ")":
            depth -= 1
        at += 1
        if not depth and not inside:
            return at
    return None


def _with_literal(rule_table: DataFrame) -> DataFrame:
    """rule_no, pattern, literal and the length of its q-grams, for each rule."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(literal=[required_literal(p) for p in frame["pattern"]])
    narrow = rule_table.select("rule_no", "pattern")
    kind = narrow.schema["rule_no"].dataType.simpleString()
    length = F.coalesce(*[F.when(F.length("literal") >= q, F.lit(q)) for q in reversed(SIZES)])
    return narrow.mapInPandas(read, f"rule_no {kind}, pattern string, literal string").withColumn("q", length)


def _bytes(text: Column) -> Column:
    """The lower-cased text in UTF-8: literals are ASCII, and places in bytes are found without counting characters."""
    return F.encode(F.lower(text), "UTF-8")


def _places(low: Column, sizes: list[int]) -> Column:
    """Numbers that name the q-grams of a text, each a length and a place; the texts are cut out later, one at a time."""
    none = F.array().cast("array<bigint>")
    return F.concat(none, *[F.when(F.octet_length(low) >= q, F.sequence(
        F.lit(i * _STEP + 1), F.octet_length(low) + F.lit(i * _STEP - (q - 1)))).otherwise(none)
        for i, q in enumerate(sizes)])


def _gram(low: Column, at: Column, sizes: list[int]) -> Column:
    """The bytes of the q-gram that such a number names; null for negative ones."""
    q = F.lit(sizes[0]) if sizes else F.lit(0)
    for i, size in enumerate(sizes[1:], 1):
        q = F.when(at >= i * _STEP, F.lit(size)).otherwise(q)
    return F.when(at > 0, F.substring(low, at.bitwiseAND(F.lit(_STEP - 1)).cast("int"), q))


def build(rows: DataFrame, rule_table: DataFrame, column: str) -> DataFrame:
    """(gram, rule_no, pattern): each rule under the q-gram of its literal that fewest rows hold; null if it has none.

    Long literals have long q-grams, so that rules that differ in a few characters do not
    share theirs.  Places are counted per hash bucket of the q-gram, so that the table of
    counts is bounded and combines on the map side; the index is right whatever q-gram is taken.
    """
    spark = rows.sparkSession
    rules = session.stage(_with_literal(rule_table), session.fresh_path(spark, "rules"))
    sizes = sorted(r["q"] for r in rules.where("q is not null").select("q").distinct().collect())
    none = rules.where("literal is null").select(F.lit(None).cast("string").alias("gram"), "rule_no", "pattern")
    if not sizes:
        return none
    bucket = F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).alias("_bucket")
    at = F.explode(_places(F.col("_low"), sizes)).alias("_at")
    held = rows.select(_bytes(F.col(column)).alias("_low")).select("_low", at).select(
        _gram(F.col("_low"), F.col("_at"), sizes).alias("gram")).groupBy(bucket).agg(F.count("*").alias("_n"))
    listed = rules.where("literal is not null").select("*", F.explode(F.sequence(F.lit(1), F.length("literal") - F.col("q") + 1)).alias("_i")) \
        .select("rule_no", "pattern", F.substring(F.col("literal"), F.col("_i"), F.col("q")).alias("gram")).withColumn("_bucket", bucket)
    rarest = listed.join(held, "_bucket", "left").groupBy("rule_no", "pattern").agg(
        F.min_by("gram", F.struct(F.coalesce("_n", F.lit(0)), "gram")).alias("gram"))
    return session.stage(rarest.select("gram", "rule_no", "pattern").unionByName(none), session.fresh_path(spark, "rule-index"))


def matches(rows: DataFrame, index: DataFrame, column: str) -> DataFrame:
    """``_row`` (a row's columns), ``_id`` (tells rows apart) and ``rule_no`` of every match."""
    return _found(rows, index, column).groupBy("_id", "rule_no").agg(F.any_value("_row").alias("_row")).select(
        "_id", "_row", "rule_no")


def _found(rows: DataFrame, index: DataFrame, column: str) -> DataFrame:
    """The matches; one comes repeatedly where its q-gram stands in the row repeatedly.

    The q-grams of a row that no rule is listed under go before anything is shuffled: their hashes
    are looked up in a broadcast table of up to ``MOST`` hashes.  Longer indexes are joined by a shuffle.
    """
    number = index.schema["rule_no"].dataType
    text, low, at = F.col("_row")[column], F.col("_low"), F.col("_at")
    loose = index.where("gram is null").select("rule_no", "pattern").collect()      # configuration, rarely more than a few
    listed = index.where("gram is not null")
    sizes = sorted(r["q"] for r in listed.select(F.length("gram").alias("q")).distinct().collect())
    hits = [F.when(text.rlike(r["pattern"]), F.lit(-1 - i).cast("bigint")) for i, r in enumerate(loose)]
    asked = F.coalesce(_places(low, sizes), F.array().cast("array<bigint>"))
    wanted = F.concat(asked, F.array_compact(F.array(*hits))) if hits else asked
    hit = F.coalesce(F.lit(None).cast(number), *[F.when(at == -1 - i, F.lit(r["rule_no"]).cast(number)) for i, r in enumerate(loose)])
    named = rows.select(F.monotonically_increasing_id().alias("_id"), F.struct(*rows.columns).alias("_row"))
    met = named.withColumn("_low", _bytes(text)).withColumn("_at", F.explode(wanted)).select(
        "_id", "_row", _gram(low, at, sizes).alias("_asked"), hit.alias("_hit"))
    hashes = listed.select(F.xxhash64("gram").alias("_hash")).distinct()
    if hashes.limit(MOST + 1).count() <= MOST:
        met = met.join(F.broadcast(hashes.withColumn("_known", F.lit(True))), F.xxhash64("_asked") == F.col("_hash"), "left") \
            .where("_known or _hit is not null").drop("_hash", "_known")
    # Rows that are hits already meet no rule; short keys, which no q-gram equals, keep them apart from each other.
    key = F.coalesce(F.col("_asked").cast("string"), F.lpad(F.hex(F.pmod(F.col("_id"), F.lit(256))), 2, "0"))
    met = met.withColumn("_asked", key).join(listed, F.col("_asked") == F.col("gram"), "left" if hits else "inner")
    rule = F.coalesce(F.col("_hit"), F.when(F.rlike(text, F.col("pattern")), F.col("rule_no")))
    return met.select("_id", "_row", rule.alias("rule_no")).where("rule_no is not null")


def first_matches(rows: DataFrame, rule_table: DataFrame, column: str) -> DataFrame:
    """Rows that match, each with the smallest rule number of its matches."""
    found = _found(rows, build(rows, rule_table, column), column)
    first = found.groupBy("_id").agg(F.min("rule_no").alias("rule_no"), F.any_value("_row").alias("_row"))
    return first.select("_row.*", "rule_no")
