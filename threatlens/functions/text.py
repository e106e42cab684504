"""Text functions: regular expressions, URL decoding, addresses, timestamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlens import rules

# Unicode white space, as str.strip() removes it.
BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
          + "".join(chr(c) for c in range(0x2000, 0x200b)) + "\u2028\u2029\u202f\u205f\u3000")
_MARK = "\x01"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def evaluated_once(c: Column) -> Column:
    """The same value, computed in one place of the plan.

    Filters move below the projections they read and take copies of the
    expressions with them, which would repeat a costly match per condition.
    An expression that names the partition is not copied.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def floor_div(c: Column, n: int) -> Column:
    """Whole-number division that rounds down and stays exact for large values."""
    return ((c - F.pmod(c, F.lit(n).cast("bigint"))) / n).cast("bigint")


def java_regex(pattern: str) -> str:
    """The pattern with Unicode character classes and case folding.

    Java's defaults are ASCII only, which would let exotic blanks or look-alike
    letters slip past a rule.
    """
    flags, body = ("iU", pattern[4:]) if pattern.startswith("(?i)") else ("U", pattern)
    return f"(?{flags}:{body})"


def any_of(patterns: Sequence[str]) -> str:
    """One alternation, so a text is walked once for a whole rule."""
    return "|".join(java_regex(p) for p in patterns)


def first_match(text: Column, patterns: Sequence[str]) -> Column:
    """What the first pattern, in list order, that occurs in the text matched."""
    return F.coalesce(*[
        F.when(text.rlike(java_regex(p)), F.regexp_extract(text, java_regex(p), 0)) for p in patterns])


def first_pattern(text: Column, patterns: Sequence[str]) -> Column:
    """The source text of that pattern."""
    return F.coalesce(*[
        F.when(text.rlike(java_regex(p)), F.lit(p.removeprefix("(?i)"))) for p in patterns])


def line_groups(line: Column, pattern: str, groups: int) -> Column:
    """Array of the pattern's groups, matched at the start of the line.

    Lines that do not match give an array of another size, or null.  A single
    rewrite joins all groups with a control character and splits them again:
    one pass of the regular expression instead of one per field.  Lines that
    hold that character themselves are rare and take the plain way.
    """
    anchored = f"(?dU)^(?:{pattern})(?s:.*)"
    joined = F.regexp_replace(line, anchored, _MARK.join(f"${i + 1}" for i in range(groups)))
    plain = F.when(line.rlike(f"(?dU)^(?:{pattern})"), F.transform(
        F.array(*[F.lit(i + 1) for i in range(groups)]),
        lambda i: F.call_function("regexp_extract", line, F.lit(anchored), i)))
    return F.when(line.contains(_MARK), plain).otherwise(F.split(joined, _MARK))


def _percent_decode(c: Column) -> Column:
    # A percent sign without two hex digits stands for itself.
    return F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def url_decode_once(c: Column) -> Column:
    """Percent decoding only; a plus sign stays a plus sign."""
    return F.when(c.contains("%"), _percent_decode(F.replace(c, F.lit("+"), F.lit("%2B")))).otherwise(c)


def _form_decode(c: Column) -> Column:
    return (F.when(c.contains("%"), _percent_decode(c))
            .otherwise(F.translate(c, "+", " ")))


def url_decode_twice(c: Column) -> Column:
    """Form decoding, repeated when a percent sign is left (double encoding)."""
    once = _form_decode(c)
    return F.when(c.contains("%"), F.when(once.contains("%"), _form_decode(once)).otherwise(once)) \
            .otherwise(F.translate(c, "+", " "))


def detection_text(path: Column, protocol: Column) -> Column:
    return url_decode_twice(F.concat_ws(" ", path, protocol))


def truncate(c: Column, n: int | None) -> Column:
    return c if n is None else F.substring(c, 1, n)


def normalize_path(c: Column) -> Column:
    return F.substring_index(F.lower(c), "?", 1)


def extract_ip(message: Column, labelled: str = rules.SYSLOG_LABELLED_IP,
               fallback: bool = True) -> Column:
    """The labelled dotted quad, else the first one, else the zero address."""
    found = [F.nullif(F.regexp_extract(message, java_regex(labelled), 1), F.lit(""))]
    if fallback:
        found.append(F.nullif(F.regexp_extract(message, java_regex(rules.ANY_IP), 1), F.lit("")))
    return F.coalesce(*found, F.lit(rules.NO_IP))


def access_time(text: Column) -> Column:
    """``15/Jan/2024:10:00:00 +0000`` as an instant, null when malformed."""
    offset = F.when(F.substring(text, -3, 1) == ":", F.regexp_replace(text, ":(?=[0-9]{2}$)", "")) \
              .when(text.endswith("Z"), F.regexp_replace(text, "Z$", "+0000")).otherwise(text)
    return F.try_to_timestamp(offset, F.lit("d/MMM/yyyy:H:m:s xx"))


def access_hour(text: Column) -> Column:
    """The hour as written, that is in the line's own offset."""
    return F.split_part(text, F.lit(":"), F.lit(2)).try_cast("int")


def access_offset(text: Column) -> Column:
    """The offset a line's time is written with, in minutes; null where there is none.

    Reads ``+hhmm``, ``-hh:mm`` and ``Z`` at the end of a text.
    """
    digits = F.regexp_extract(text, r"[+-](\d\d):?(\d\d)$", 1), F.regexp_extract(text, r"[+-](\d\d):?(\d\d)$", 2)
    minutes = digits[0].try_cast("int") * 60 + digits[1].try_cast("int")
    negative = F.regexp_extract(text, r"([+-])\d\d:?\d\d$", 1) == "-"
    return F.when(text.endswith("Z"), F.lit(0)).otherwise(F.when(negative, -minutes).otherwise(minutes))


def offset_of(rows: DataFrame) -> Column:
    """The rows' offsets; rows without that column count as UTC."""
    return F.col("ts_offset") if "ts_offset" in rows.columns else F.lit(0)


def local_time(ts: Column, offset: Column) -> Column:
    """The wall clock of the event: a timestamp to be formatted, not compared."""
    return F.timestamp_micros(F.unix_micros(ts) + F.coalesce(offset, F.lit(0)).cast("bigint") * 60_000_000)


def iso_time(ts: Column, offset: Column | None = None) -> Column:
    """ISO 8601 with fractions only where there are any.

    ``offset`` holds minutes; times are shown in it, and a null one shows a time
    without any.  Without ``offset`` times are shown in UTC.
    """
    minutes = F.lit(0) if offset is None else offset
    shown = local_time(ts, minutes)
    size = F.abs(minutes)
    suffix = F.concat(F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+")),
                      F.lpad(floor_div(size, 60).cast("string"), 2, "0"), F.lit(":"),
                      F.lpad((size % 60).cast("string"), 2, "0"))
    return F.concat(
        F.date_format(shown, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(F.unix_micros(ts) % 1_000_000 == 0, F.lit("")).otherwise(F.date_format(shown, ".SSSSSS")),
        F.coalesce(suffix, F.lit("")))


def parse_iso(text: Column) -> Column:
    """ISO 8601 with ``Z`` or an offset, null when malformed."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)"), F.try_to_timestamp(text))


def hour_bucket(ts: Column, offset: Column | None = None) -> Column:
    """The hour on the event's own clock, or in UTC without ``offset``."""
    return F.date_format(ts if offset is None else local_time(ts, offset), "yyyy-MM-dd'T'HH:00")


def query_params(path: Column) -> Column:
    """Number of ``&``-separated parameters after the first question mark."""
    at = F.instr(path, "?")
    query = F.substring(path, at + 1, F.length(path))
    return F.when(at == 0, F.lit(0)).otherwise(
        F.length(query) - F.length(F.replace(query, F.lit("&"), F.lit(""))) + 1)


def special_char_count(path: Column) -> Column:
    return F.length(path) - F.length(F.translate(path, rules.STRICT_SPECIAL_CHARS, ""))


def has_special_chars(path: Column) -> Column:
    found = F.lit(False)
    for mark in rules.CLASSIC_SPECIAL_MARKS:
        found = found | path.contains(mark)
    return found.cast("int")
