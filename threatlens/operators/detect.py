"""Threat detectors over entry DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threatlens import rules, session
from threatlens.functions import text
from threatlens.operators import rule_index, whitelist
from threatlens.operators.sliding import sliding_count

RULE_GROUP = 250


def _no_details() -> Column:
    return F.lit(None).cast("map<string,string>")


def settings(config: dict | None, name: str) -> dict:
    return (config or {}).get("detection", {}).get(name, {})


def enabled_rules(config: dict | None, profile: rules.Profile) -> list[rules.PatternRule]:
    return [r for r in profile.rules
            if not r.optional or settings(config, r.name).get("enabled", True)]


def _with_texts(entries: DataFrame, profile: rules.Profile) -> DataFrame:
    """Decode once per entry; every detector reads these columns.

    A ``_low`` column is the lower-cased text, or null where the text is not
    ASCII and a plain comparison could miss what a pattern would find.
    """
    if profile.name == "strict":
        texts = entries.withColumns({
            "_path": text.evaluated_once(text.detection_text(F.col("path"), F.col("protocol"))),
            "_referrer": text.evaluated_once(
                text.url_decode_twice(F.coalesce(F.col("referrer"), F.lit(""))))})
        texts = texts.withColumn("_full", text.evaluated_once(F.concat_ws(" ", "_path", "_referrer")))
    else:
        texts = entries.withColumn("_path", text.evaluated_once(text.url_decode_once(F.col("path"))))
        texts = texts.withColumn("_full", F.col("_path"))
    return texts.withColumns({
        f"_low{c}": text.evaluated_once(F.when(F.octet_length(c) == F.char_length(c), F.lower(c)))
        for c in ("_path", "_full", "user_agent")})


def _inspected(rule: rules.PatternRule) -> str:
    return {"path": "_path", "path_and_referrer": "_full", "user_agent": "user_agent"}[rule.text]


def _hit(rule: rules.PatternRule) -> Column:
    """Whether the rule matches; most texts lack every hint and skip the patterns."""
    column = _inspected(rule)
    low, hinted = F.col(f"_low{column}"), F.lit(False)
    for needed in rule.hints:
        together = low.contains(needed[0])
        for literal in needed[1:]:
            together = together & low.contains(literal)
        hinted = hinted | together
    return (low.isNull() | hinted) & F.col(column).rlike(text.any_of(rule.patterns))


def _details(rule: rules.PatternRule, profile: rules.Profile) -> Column:
    if profile.name == "strict":
        return _no_details()
    if rule.text == "user_agent":
        return F.create_map(F.lit("user_agent"), F.col("user_agent"))
    decoded = [F.lit("decoded_path"), text.truncate(F.col("_path"), 500)]
    if rule.name == "sql_injection":
        return F.create_map(F.lit("pattern"), text.first_pattern(F.col("_path"), rule.patterns), *decoded)
    return F.create_map(*decoded)


def _threat(det: int, threat_type: str, severity: Column, description: Column, payload: Column,
            confidence: Column, details: Column) -> Column:
    return F.struct(
        F.lit(threat_type).alias("threat_type"), severity.alias("severity"),
        description.alias("description"), payload.alias("payload"),
        confidence.cast("double").alias("confidence"), details.alias("details"), F.lit(det).alias("det"))


def _pattern_threat(rule: rules.PatternRule, profile: rules.Profile) -> Column:
    """The rule's finding, or null."""
    inspected = F.col(_inspected(rule))
    if rule.payload == "match":
        payload = text.truncate(text.first_match(inspected, rule.patterns), 200)
    else:
        shown = F.col("user_agent") if rule.text == "user_agent" else F.col("_path")
        payload = text.truncate(shown, rule.payload_chars)
    description = F.format_string(
        rule.description, F.col("ip"), text.truncate(F.col("user_agent"), rule.agent_chars)) \
        if "%" in rule.description else F.lit(rule.description)
    return F.when(_hit(rule), _threat(
        profile.order.index(rule.threat_type), rule.threat_type, F.lit(rule.severity),
        description, payload, F.lit(rule.confidence), _details(rule, profile)))


def _exploded(found: DataFrame, threats: Sequence[Column], order: Sequence[str] = ()) -> DataFrame:
    # Rows without any finding leave before the explode.
    listed = found.withColumn("_found", text.evaluated_once(F.array_compact(F.array(*threats)))) \
        .filter(F.size("_found") > 0)
    return threat_columns(listed.withColumn("_t", F.explode("_found")), order)


def threat_columns(found: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    t = F.col("_t")
    return found.select(
        *[c for c in ("seq", "source_name") if c in found.columns],
        t["threat_type"].alias("threat_type"), t["severity"].alias("severity"),
        F.col("ip").alias("source_ip"), "ts", text.offset_of(found).alias("ts_offset"), t["description"].alias("description"),
        F.col("path").alias("target"), t["payload"].alias("payload"),
        t["confidence"].alias("confidence"), t["details"].alias("details"),
        F.col("raw").alias("raw_log"), F.lit("rule-based").alias("detection_method"),
        "user_agent", t["det"].alias("det"), *keep)


def detect_patterns(entries: DataFrame, config: dict | None = None,
                    profile: str | rules.Profile = "strict",
                    only: Sequence[str] | None = None) -> DataFrame:
    """Row-wise findings of the enabled rules; at most one per rule and entry."""
    p = rules.profile(profile)
    chosen = [r for r in enabled_rules(config, p) if only is None or r.name in only]
    return _exploded(_with_texts(entries, p), [_pattern_threat(r, p) for r in chosen])


def is_login_attempt(profile: str | rules.Profile = "strict") -> Column:
    """Whether an entry counts as a login attempt."""
    status = F.col("status_code")
    if rules.profile(profile).name == "classic":
        return text.normalize_path(F.col("path")).isin(*rules.CLASSIC_LOGIN_PATHS) & status.isin(401, 403, 200)
    lowered, login = F.lower("path"), F.lit(False)
    for marker in rules.STRICT_LOGIN_MARKERS:
        login = login | lowered.contains(marker)
    return status.isin(401, 403) | (login & (status >= 400))


def bruteforce_candidates(entries: DataFrame, profile: str | rules.Profile = "strict") -> DataFrame:
    """Entries that count as login attempts."""
    return entries.filter(is_login_attempt(profile))


def _counted(entries: DataFrame, window: int, threshold: int) -> DataFrame:
    return sliding_count(entries, F.col("ip"), F.col("ts"), F.col("seq"), window, at_least=threshold)


def detect_bruteforce(entries: DataFrame, config: dict | None = None,
                      profile: str | rules.Profile = "strict") -> DataFrame:
    """A finding on every login attempt from the threshold on."""
    p = rules.profile(profile)
    chosen = settings(config, "brute_force")
    threshold = chosen.get("threshold", p.bruteforce_threshold)
    window = chosen.get("window", p.bruteforce_window)
    counted = _counted(bruteforce_candidates(entries, p), window, threshold)
    return threat_columns(counted.withColumn("_t", bruteforce_threat(p, threshold, window)), ["window_count"])


def bruteforce_threat(p: rules.Profile, threshold: int, window: int) -> Column:
    """The finding for a row that carries ``window_count``."""
    n = F.col("window_count")
    det = p.order.index("BRUTE_FORCE")
    if p.name == "strict":
        return _threat(
            det, "BRUTE_FORCE",
            F.when(n >= 2 * threshold, F.lit("CRITICAL")).otherwise(F.lit("HIGH")),
            F.format_string(f"Brute force: %d failed attempts in {window}s from %s", n, F.col("ip")),
            F.col("path"), F.least(F.lit(1.0), n / threshold), _no_details())
    return _threat(
        det, "BRUTE_FORCE", F.lit("HIGH"),
        F.format_string(f"Brute Force saldırısı tespit edildi: %d istek / {window}s", n),
        F.lit(""), F.lit(None), F.create_map(
            F.lit("count"), n.cast("string"), F.lit("threshold"), F.lit(str(threshold)),
            F.lit("window"), F.lit(str(window))))


def detect_ddos(entries: DataFrame, config: dict | None = None) -> DataFrame:
    """Floods: any traffic of one address, from the threshold on (classic profile)."""
    p = rules.CLASSIC
    chosen = settings(config, "ddos")
    threshold, window = chosen.get("threshold", p.ddos_threshold), chosen.get("window", p.ddos_window)
    counted = _counted(entries, window, threshold)
    return threat_columns(counted.withColumn("_t", ddos_threat(p, threshold, window)), ["window_count"])


def ddos_threat(p: rules.Profile, threshold: int, window: int) -> Column:
    """The finding for a row that carries ``window_count``."""
    n = F.col("window_count")
    return _threat(
        p.order.index("DDOS"), "DDOS", F.lit("CRITICAL"),
        F.format_string(f"Olası DDoS saldırısı: %d istek / {window}s", n), F.lit(""), F.lit(None),
        F.create_map(F.lit("count"), n.cast("string"), F.lit("threshold"), F.lit(str(threshold))))


def detect_all(entries: DataFrame, config: dict | None = None,
               profile: str | rules.Profile = "strict") -> DataFrame:
    """All findings of the enabled detectors, allow-listed traffic excluded first.

    ``(seq, det)`` is the order in which a one-line-at-a-time run reports them.
    """
    p = rules.profile(profile)
    kept = whitelist.apply(entries, config, p.name)
    found = detect_patterns(kept, config, p)
    if settings(config, "brute_force").get("enabled", True):
        found = found.unionByName(detect_bruteforce(kept, config, p).drop("window_count"))
    if p.ddos_threshold is not None and settings(config, "ddos").get("enabled", True):
        found = found.unionByName(detect_ddos(kept, config).drop("window_count"))
    return found


def threat_dict(threats: DataFrame, profile: str = "strict") -> DataFrame:
    """The exported columns of a finding, with an ISO timestamp in its own offset."""
    shared = ["threat_type", "severity", "source_ip",
              text.iso_time(F.col("ts"), text.offset_of(threats)).alias("timestamp"), "description"]
    if profile == "strict":
        return threats.select(*shared, "payload", "confidence", "raw_log", "detection_method")
    return threats.select(*shared, "target", "payload", "details")


def detect_custom(rows: DataFrame, custom: Sequence[dict], column: Column, ip: Column | None = None) -> DataFrame:
    """User rules ``{name, pattern, severity, threat_type}`` over one text column.

    Every rule is its own detector: at most one finding per rule and row.
    Patterns take the dialect of Java and are used as written.
    """
    found = [F.when(column.rlike(r["pattern"]), F.struct(
        F.lit(i).alias("rule_no"), F.lit(r["name"]).alias("rule"),
        F.lit(r["threat_type"]).alias("threat_type"), F.lit(r["severity"].upper()).alias("severity"),
        F.regexp_extract(column, r["pattern"], 0).alias("payload"))) for i, r in enumerate(custom)]
    listed = rows.withColumn("_found", text.evaluated_once(F.array_compact(F.array(*found)))) \
        .filter(F.size("_found") > 0)
    return listed.select(*rows.columns, F.explode("_found").alias("_t")).select(*rows.columns, "_t.*")


def match_rule_table(rows: DataFrame, rule_table: DataFrame, column: str) -> DataFrame:
    """First matching rule per row, for rules kept in a table (rule_no, pattern, …).

    Up to ``RULE_GROUP`` rules become part of the plan, and a row stops at the first that
    matches.  More go through an inverted index of the texts they demand, so a row
    meets only the patterns that its own q-grams name, however many rules there are.
    """
    table = rule_table.orderBy("rule_no").limit(RULE_GROUP + 1).collect()
    if len(table) > RULE_GROUP:
        return rule_index.first_matches(rows, rule_table, column).join(rule_table.drop("pattern"), "rule_no")
    groups = [F.coalesce(*[F.when(F.col(column).rlike(r["pattern"]), F.lit(r["rule_no"])) for r in table[at:at + RULE_GROUP]])
              for at in range(0, len(table), RULE_GROUP)]
    hit = F.lit(None).cast(rule_table.schema["rule_no"].dataType)
    matched = rows.withColumn("rule_no", hit)
    for group in groups:    # one projection each: a single expression of thousands of rules would not compile
        matched = matched.withColumn("rule_no", text.evaluated_once(F.coalesce("rule_no", group)))
    return matched.filter("rule_no is not null").join(rule_table.drop("pattern"), "rule_no")


def detector_stats(entries: DataFrame, threats: DataFrame) -> DataFrame:
    """(metric, name, value): entries analysed, findings, findings by type."""
    parts = [
        entries.agg(F.count("*").alias("value")).select(
            F.lit("total_analyzed").alias("metric"), F.lit("").alias("name"), "value"),
        threats.rollup("threat_type").agg(F.count("*").alias("value")).select(
            F.when(F.col("threat_type").isNull(), F.lit("threats_detected"))
             .otherwise(F.lit("by_type")).alias("metric"),
            F.coalesce("threat_type", F.lit("")).alias("name"), "value"),
        # A total of zero must show when nothing was found.
        session.table(entries.sparkSession, [("threats_detected", "", 0)],
                      "metric string, name string, value bigint")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]) \
        .groupBy("metric", "name").agg(F.sum("value").alias("value"))
