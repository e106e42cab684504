"""Allow lists: rows that must not reach any detector or counter."""

from __future__ import annotations

import ipaddress
import logging
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threatlens import session
from threatlens.functions.text import evaluated_once, floor_div

log = logging.getLogger(__name__)

# Octets without leading zeros, as the address parser of the language demands.
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$"
INLINE_NETWORKS = 64          # up to this many networks stay a plain predicate
BROADCAST_ROWS = 100_000      # longest network table that is broadcast by hint
BUCKET_BITS = 16


def ipv4_number(ip: Column) -> Column:
    """The address as BIGINT, null when it is not a dotted quad."""
    octets = F.split(ip, r"\.")
    number = F.lit(0).cast("bigint")
    for i in range(4):
        number = number * 256 + octets[i].try_cast("bigint")
    return F.when(ip.rlike(IPV4), number)


def networks(entries: Sequence[str]) -> tuple[list, list[str]]:
    """The parsed networks (single addresses included) and the invalid entries."""
    parsed, invalid = [], []
    for entry in entries:
        try:
            parsed.append(ipaddress.ip_network(str(entry), strict=False))
        except ValueError:
            log.warning("invalid whitelist entry: %s", entry)
            invalid.append(str(entry))
    return parsed, invalid


def merged_ranges(entries: Sequence[str]) -> list[tuple[int, int]]:
    """Disjoint, sorted IPv4 ranges that cover exactly the listed networks."""
    v4 = [n for n in networks(entries)[0] if n.version == 4]
    return [(int(n.network_address), int(n.broadcast_address)) for n in ipaddress.collapse_addresses(v4)]


def exclude_ips(entries: DataFrame, ips: Sequence[str], column: str = "ip") -> DataFrame:
    """Drop rows whose address text is listed."""
    listed = sorted({str(ip) for ip in ips})
    if not listed:
        return entries
    if len(listed) <= INLINE_NETWORKS:
        return entries.filter(F.col(column).isNull() | ~F.col(column).isin(*listed))
    table = session.table(entries.sparkSession, [(ip,) for ip in listed], "_listed string")
    return entries.join(_sized(table, len(listed)), F.col(column) == F.col("_listed"), "left_anti")


def _sized(table: DataFrame, rows: int) -> DataFrame:
    # Known length: hint only below the bound, leave longer lists to the planner.
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def exclude_networks(entries: DataFrame, listed: Sequence[str], column: str = "ip") -> DataFrame:
    """Drop rows whose address lies in a listed network or equals a listed address.

    Short IPv4 lists become range predicates, longer ones an anti join; IPv6 addresses
    are compared by their masked prefixes, one equality per listed prefix length.
    """
    v4 = merged_ranges(listed)
    v6 = [n for n in networks(listed)[0] if n.version == 6]
    if v6:
        entries = _exclude_ipv6(entries, v6, column)
    if not v4:
        return entries
    if len(v4) <= INLINE_NETWORKS:
        number = ipv4_number(F.col(column))
        inside = F.lit(False)
        for lo, hi in v4:
            inside = inside | number.between(lo, hi)
        return entries.filter(~F.coalesce(inside, F.lit(False)))
    return anti_join_ranges(entries, range_table(entries.sparkSession, v4), column, rows=len(v4))


def range_table(spark: SparkSession, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    return session.table(spark, list(ranges), "lo bigint, hi bigint")


def anti_join_ranges(entries: DataFrame, ranges: DataFrame, column: str = "ip",
                     rows: int | None = None) -> DataFrame:
    """Left anti join with a table of disjoint address ranges.

    Ranges are listed under every /16 bucket they touch, which makes this an
    equi join with a range condition; log rows are never multiplied.  ``rows``
    is the known length of the table, if any.
    """
    size = 1 << BUCKET_BITS
    bucketed = ranges.select("lo", "hi", F.explode(F.sequence(
        floor_div(F.col("lo"), size), floor_div(F.col("hi"), size))).alias("_bucket"))
    if rows is not None and rows * 4 <= BROADCAST_ROWS:
        # A /0 alone touches 65,536 buckets; disjoint ranges share that bound.
        bucketed = F.broadcast(bucketed)
    number = ipv4_number(F.col(column))
    numbered = entries.withColumn("_ip", number).withColumn("_key", floor_div(number, size))
    hit = (F.col("_key") == F.col("_bucket")) & F.col("_ip").between(F.col("lo"), F.col("hi"))
    return numbered.join(bucketed, hit, "left_anti").drop("_ip", "_key")


def ipv6_digits(ip: Column) -> Column:
    """The address as 32 hexadecimal digits, null when it is not an IPv6 address.

    One ``::`` stands for at least one group of zeros; the last two groups may be a dotted
    quad; a zone behind ``%`` does not matter.
    """
    plain = F.lower(F.substring_index(ip, "%", 1))
    quad = F.regexp_extract(plain, r"([^:]*)$", 1)
    number = ipv4_number(quad)
    written = F.when(~quad.contains("."), plain).when(number.isNotNull(), F.concat(
        F.regexp_replace(plain, r"[^:]*$", ""), F.lower(F.hex(floor_div(number, 1 << BUCKET_BITS))), F.lit(":"),
        F.lower(F.hex(number % (1 << BUCKET_BITS)))))

    none = F.array().cast("array<string>")

    def groups(part: Column) -> Column:
        return F.when(part == "", none).otherwise(F.split(part, ":"))

    def expanded(sides: Column) -> Column:
        """The eight groups, or something that is no list of eight groups."""
        two = F.size(sides) == 2
        left, right = groups(sides[0]), F.when(two, groups(F.get(sides, 1))).otherwise(none)
        missing = 8 - F.size(left) - F.size(right)
        zeros = F.when(two & (missing > 0), F.array_repeat(F.lit("0"), missing)).otherwise(none)
        return F.when((F.size(sides) <= 2) & (~two | (missing > 0)), F.concat(left, zeros, right))
    digits = F.transform(F.array(F.split(written, "::")), expanded)
    valid = F.transform(digits, lambda every: F.when(
        (F.size(every) == 8) & F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$")),
        F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), "")))
    return F.when(ip.contains(":") & ~ip.endswith("%"), valid[0])


def _prefix(digits: Column, length: int) -> Column:
    """The first ``length`` bits of 32 hexadecimal digits, as digits; bits past the prefix are zero."""
    whole, rest = divmod(length, 4)
    head = F.substring(digits, 1, whole)
    if not rest:
        return head
    return F.concat(head, F.translate(F.substring(digits, whole + 1, 1), "0123456789abcdef",
                                      "".join(f"{d >> 4 - rest << 4 - rest:x}" for d in range(16))))


def _exclude_ipv6(entries: DataFrame, nets: Sequence[ipaddress.IPv6Network], column: str) -> DataFrame:
    """Anti joins on the masked prefix, one for each listed prefix length; short lists are plain predicates."""
    by_length: dict[int, set[str]] = {}
    for net in ipaddress.collapse_addresses(nets):
        digits = f"{int(net.network_address):032x}"
        by_length.setdefault(net.prefixlen, set()).add(digits[:-(-net.prefixlen // 4)])
    digits = entries.withColumn("_digits", evaluated_once(ipv6_digits(F.col(column))))
    for length, listed in sorted(by_length.items()):
        prefix = _prefix(F.col("_digits"), length)
        if len(listed) <= INLINE_NETWORKS:
            digits = digits.filter(~F.coalesce(prefix.isin(*listed), F.lit(False)))
        else:
            table = session.table(entries.sparkSession, [(p,) for p in sorted(listed)], "_listed string")
            digits = digits.join(_sized(table, len(listed)), prefix == F.col("_listed"), "left_anti")
    return digits.drop("_digits")


def exclude_agents(entries: DataFrame, agents: Sequence[str], column: str = "user_agent") -> DataFrame:
    """Drop rows whose user agent contains a listed text, in any case."""
    if not agents:
        return entries
    lowered, hit = F.lower(F.col(column)), F.lit(False)
    for agent in agents:
        hit = hit | lowered.contains(agent.lower())
    return entries.filter(~F.coalesce(hit, F.lit(False)))


def exclude_agent_patterns(entries: DataFrame, patterns: Sequence[str],
                           column: str = "user_agent") -> DataFrame:
    """Drop rows whose user agent matches one of the regular expressions."""
    if not patterns:
        return entries
    joined = "|".join(f"(?:{p})" for p in patterns)
    return entries.filter(~F.coalesce(F.col(column).rlike(joined), F.lit(False)))


def exclude_paths(entries: DataFrame, globs: Sequence[str], column: str = "path") -> DataFrame:
    """Drop rows whose path, without the query, matches a glob (``*`` and ``?``)."""
    if not globs:
        return entries
    plain, hit = F.substring_index(F.col(column), "?", 1), F.lit(False)
    for glob in globs:
        like = glob.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        hit = hit | plain.like(like.replace("*", "%").replace("?", "_"))
    return entries.filter(~F.coalesce(hit, F.lit(False)))


def apply(entries: DataFrame, config: dict | None, profile: str = "strict") -> DataFrame:
    """All configured allow lists.  The classic profile compares address texts."""
    lists = (config or {}).get("whitelist", {})
    ips = lists.get("ips", [])
    kept = exclude_networks(entries, ips) if profile == "strict" else exclude_ips(entries, ips)
    kept = exclude_agents(kept, lists.get("user_agents", []))
    kept = exclude_agent_patterns(kept, lists.get("user_agents_regex", []))
    return exclude_paths(kept, lists.get("paths", []))


def audit(entries: DataFrame, listed: Sequence[str], broad_prefix: int = 16) -> DataFrame:
    """One row per list entry: validity, breadth, size, and the rows it hides.

    Addresses are counted once, before the comparison with the list, so a hot
    address is one row there.
    """
    spark = entries.sparkSession
    rows = []
    for entry in dict.fromkeys(listed):
        parsed, _ = networks([entry])
        net = parsed[0] if parsed else None
        v4 = net is not None and net.version == 4
        rows.append((str(entry), net is not None,
                     net is not None and "/" in str(entry) and net.prefixlen <= broad_prefix,
                     float(net.num_addresses) if net is not None else None,
                     int(net.network_address) if v4 else None,
                     int(net.broadcast_address) if v4 else None))
    table = session.table(
        spark, rows, "entry string, valid boolean, broad boolean, addresses double, lo bigint, hi bigint")
    per_ip = entries.groupBy("ip").agg(F.count("*").alias("n")).withColumn("_ip", ipv4_number(F.col("ip")))
    size = 1 << BUCKET_BITS
    buckets = table.filter("lo is not null").select("entry", "lo", "hi", F.explode(F.sequence(
        floor_div(F.col("lo"), size), floor_div(F.col("hi"), size))).alias("_bucket"))
    hidden = (per_ip.withColumn("_bucket", floor_div(F.col("_ip"), size)).join(buckets, "_bucket")
              .filter(F.col("_ip").between(F.col("lo"), F.col("hi")))
              .groupBy("entry").agg(F.sum("n").alias("rows_hidden")))
    return (table.drop("lo", "hi").join(hidden, "entry", "left")
            .withColumn("rows_hidden", F.coalesce("rows_hidden", F.lit(0).cast("bigint"))))
