"""SQL counterparts of the catalogue, written for DuckDB over the same tables.

They share no code with the operators beyond the fixed values in ``rules`` and
the request templates: parsing, decoding, matching and counting are spelled out
in SQL.
"""

from __future__ import annotations

from collections.abc import Sequence

from threatlens import rules
from threatlens.sources import bridge


def q(value: str) -> str:
    """An SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def values(rows: Sequence[Sequence]) -> str:
    def item(x) -> str:
        return "NULL" if x is None else q(x) if isinstance(x, str) else str(x)
    return "VALUES " + ", ".join("(" + ", ".join(item(x) for x in row) + ")" for row in rows)


def any_match(column: str, patterns: Sequence[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, {q(p)})" for p in patterns) + ")"


def first_match(column: str, patterns: Sequence[str]) -> str:
    return "CASE " + " ".join(
        f"WHEN regexp_matches({column}, {q(p)}) THEN regexp_extract({column}, {q(p)}, 0)" for p in patterns) + " END"


def first_pattern(column: str, patterns: Sequence[str]) -> str:
    return "CASE " + " ".join(
        f"WHEN regexp_matches({column}, {q(p)}) THEN {q(p.removeprefix('(?i)'))}" for p in patterns) + " END"


def group(pattern: str, i: int, column: str = "line") -> str:
    return f"regexp_extract({column}, {q('^(?:' + pattern + ')')}, {i})"


def matches(pattern: str, column: str = "line") -> str:
    return f"regexp_matches({column}, {q('^(?:' + pattern + ')')})"


def seconds(ts: str = "ts") -> str:
    return f"CAST(epoch({ts}) AS BIGINT)"


def iso(ts: str = "ts") -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"


def local(ts: str = "ts", zone: str = "zone") -> str:
    """The time on the clock of the line."""
    return f"({ts} + CASE {zone} WHEN '-0500' THEN INTERVAL '-300 minutes' WHEN '+0330' THEN INTERVAL '210 minutes' " \
           "ELSE INTERVAL '0 minutes' END)"


def local_iso(ts: str = "ts", zone: str = "zone") -> str:
    return f"strftime({local(ts, zone)}, '%Y-%m-%dT%H:%M:%S') || substr({zone}, 1, 3) || ':' || substr({zone}, 4)"


def decode_twice(x: str) -> str:
    once = f"url_decode(replace({x}, '+', ' '))"
    return f"CASE WHEN contains({once}, '%') THEN url_decode(replace({once}, '+', ' ')) ELSE {once} END"


def rank(severity: str = "severity") -> str:
    return f"CASE {severity} WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END"


_brute = ", ".join(str(i) for i in bridge.BRUTE_FORCE_TEMPLATES)
_ids = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in bridge.WINDOWS_IDS.items())
_time = "try_strptime({t}, '%d/%b/%Y:%H:%M:%S %z')"

# Every CTE with the ones it reads; ``sql`` puts the needed ones in front.
CTES: dict[str, str] = {
    "tpl": f"SELECT * FROM ({values([(i, *t) for i, t in enumerate(bridge.TEMPLATES)])}) "
           "t(template, method, path, status, referrer, agent)",
    "ev": f"""SELECT event_id, date_trunc('second', ts) AS ts, user_id, event_type, value,
        CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
        '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS user_ip,
        CASE event_type {_ids} ELSE 4740 END AS windows_id FROM events""",
    "lines": f"""SELECT event_id, CASE WHEN template IN ({_brute}) THEN {q(bridge.BRUTE_FORCE_IP)} ELSE user_ip END
        || ' - - [' || CASE WHEN k = 98 THEN '41/Foo/2024:10:00:00 +0000'
            WHEN k % 10 = 3 THEN strftime(ts - INTERVAL 5 HOUR, '%d/%b/%Y:%H:%M:%S') || ' -0500'
            WHEN k % 10 = 6 THEN strftime(ts + INTERVAL 210 MINUTE, '%d/%b/%Y:%H:%M:%S') || ' +0330'
            ELSE strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000' END || '] "' || method || ' ' || path || ' HTTP/1.1" '
        || status || ' ' || CAST(floor(value * 100) AS BIGINT) || ' "' || referrer || '" "' || agent || '"' AS line
        FROM ev JOIN tpl ON k % {len(bridge.TEMPLATES)} = template""",
    "noisy": """SELECT event_id, CASE k % 10 WHEN 7 THEN '# comment' WHEN 8 THEN '   '
        WHEN 9 THEN 'not a log line ' || event_id ELSE line END AS line FROM lines JOIN ev USING (event_id)""",
    "syslog": """SELECT event_id, strftime(ts, '%b %-d %H:%M:%S') || ' host' || (user_id % 5) || ' ' ||
        CASE WHEN event_type = 'error' THEN 'sshd[' || user_id || ']: Failed password for root from ' || user_ip
             || ' port ' || (k + 1000) || ' ssh2'
        ELSE 'sudo: session opened by ' || event_type || ' at ' || user_ip END AS line FROM ev""",
    "syslog5424": """SELECT event_id, '<' || k || '>1 ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z host'
        || (user_id % 5) || ' app-' || event_type || ' ' || CASE WHEN k % 7 = 0 THEN '-' ELSE CAST(user_id AS VARCHAR) END
        || ' ID' || k || ' client ' || user_ip || ' done' AS line FROM ev""",
    "wincsv": """SELECT event_id, strftime(ts, '%Y-%m-%d,%H:%M:%S') || ',Security,' || windows_id ||
        CASE WHEN event_type = 'error' THEN ',Error,' ELSE ',Information,' END
        || 'Account of user ' || user_id || ' IP: ' || user_ip AS line FROM ev""",
}


def _access(name: str, lines: str, pattern: str, strict: bool, source: str = "nginx") -> str:
    def g(i: int) -> str:
        return group(pattern, i)
    shift = 0 if strict else -1
    protocol = f"CASE WHEN {g(5)} = '' THEN 'HTTP/1.1' ELSE trim({g(5)}) END" if strict else "''"
    referrer, agent = g(8 + shift), g(9 + shift)
    if strict or source == "apache":
        referrer = f"CASE WHEN {referrer} = '' THEN '-' ELSE {referrer} END"
    if not strict and source == "apache":
        agent = f"CASE WHEN {agent} = '' THEN '-' ELSE {agent} END"
    return f"""SELECT event_id, {g(1)} AS ip,
        CAST({_time.format(t=g(2))} AT TIME ZONE 'UTC' AS TIMESTAMP) AS ts, substr({g(2)}, -5) AS zone,
        CAST(split_part({g(2)}, ':', 2) AS INTEGER) AS ts_hour, {g(3)} AS method, {g(4)} AS path,
        {protocol} AS protocol, CAST({g(6 + shift)} AS INTEGER) AS status_code,
        CASE WHEN {g(7 + shift)} = '-' THEN 0 ELSE CAST({g(7 + shift)} AS BIGINT) END AS bytes_sent,
        {referrer} AS referrer, {agent} AS user_agent, line AS raw, {q(source)} AS source
        FROM {lines} WHERE {matches(pattern)}""" + (
        "" if strict else f" AND {_time.format(t=g(2))} IS NOT NULL")


CTES["entries"] = _access("entries", "lines", rules.ACCESS_STRICT_LINE, True)
CTES["apache"] = _access("apache", "lines", rules.ACCESS_STRICT_LINE, True, "apache")
CTES["noisy_entries"] = _access("noisy_entries", "noisy", rules.ACCESS_STRICT_LINE, True)
CTES["classic"] = _access("classic", "lines", rules.NGINX_CLASSIC_LINE, False)
CTES["apache_classic"] = _access("apache_classic", "lines", rules.APACHE_CLASSIC_LINE, False, "apache")

CTES["texts"] = f"""SELECT *, {decode_twice("(path || ' ' || protocol)")} AS dp,
    {decode_twice("(path || ' ' || protocol)")} || ' ' || {decode_twice('referrer')} AS dpr FROM entries"""
# A plus sign stays; only percent codes are decoded.
CTES["ctexts"] = "SELECT *, url_decode(replace(path, '+', '%2B')) AS dp FROM classic"


def _strict_rule(rule: rules.PatternRule, det: int) -> str:
    column = {"path": "dp", "path_and_referrer": "dpr", "user_agent": "user_agent"}[rule.text]
    payload = "user_agent" if rule.text == "user_agent" else "substr(dp, 1, 200)"
    description = q(rule.description.split("%1$s")[0]) + " || ip" + (
        " || ': ' || user_agent" if "%2$s" in rule.description else "")
    return f"""SELECT event_id, {det} AS det, {q(rule.threat_type)} AS threat_type, {q(rule.severity)} AS severity,
        ip AS source_ip, ts, zone, {description} AS description, path AS target, {payload} AS payload,
        CAST({rule.confidence} AS DOUBLE) AS confidence, user_agent
        FROM texts WHERE {any_match(column, rule.patterns)}"""


def _classic_rule(rule: rules.PatternRule, det: int) -> str:
    column = "user_agent" if rule.text == "user_agent" else "dp"
    payload = "substr(user_agent, 1, 200)" if rule.text == "user_agent" else \
        f"substr({first_match(column, rule.patterns)}, 1, 200)"
    description = q(rule.description.replace("%2$s", "")) + (
        " || substr(user_agent, 1, 100)" if "%2$s" in rule.description else "")
    pattern = first_pattern(column, rule.patterns) if rule.name == "sql_injection" else "CAST(NULL AS VARCHAR)"
    shown = "user_agent" if rule.text == "user_agent" else "substr(dp, 1, 500)"
    return f"""SELECT event_id, {det} AS det, {q(rule.threat_type)} AS threat_type, {q(rule.severity)} AS severity,
        ip AS source_ip, ts, zone, {description} AS description, path AS target, {payload} AS payload,
        {pattern} AS pattern, {shown} AS shown, user_agent
        FROM ctexts WHERE {any_match(column, rule.patterns)}"""


for _r in rules.STRICT.rules:
    CTES[f"s_{_r.name}"] = _strict_rule(_r, rules.STRICT.order.index(_r.threat_type))
for _r in rules.CLASSIC.rules:
    CTES[f"c_{_r.name}"] = _classic_rule(_r, rules.CLASSIC.order.index(_r.threat_type))

WINDOW = 21600          # seconds; events are sparse, so windows are wide
THRESHOLD = 5
CLASSIC_BF_THRESHOLD = 5
DDOS_THRESHOLD = 8


def sliding(source: str, window: int, key: str = "ip") -> str:
    """Rows so far of the key minus those older than the window."""
    return f"""SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id)
        - count(*) OVER (PARTITION BY {key} ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING
            AND INTERVAL {window * 1_000_000 + 1} MICROSECONDS PRECEDING) AS n FROM {source} WHERE ts IS NOT NULL"""


_login = " OR ".join(f"contains(lower(path), {q(m)})" for m in rules.STRICT_LOGIN_MARKERS)
CTES["s_candidates"] = f"""SELECT * FROM entries
    WHERE status_code IN (401, 403) OR (({_login}) AND status_code >= 400)"""
CTES["s_counted"] = sliding("s_candidates", WINDOW)
CTES["s_bruteforce"] = f"""SELECT event_id, 4 AS det, 'BRUTE_FORCE' AS threat_type,
    CASE WHEN n >= {2 * THRESHOLD} THEN 'CRITICAL' ELSE 'HIGH' END AS severity, ip AS source_ip, ts, zone,
    'Brute force: ' || n || ' failed attempts in {WINDOW}s from ' || ip AS description, path AS target,
    path AS payload, least(CAST(1 AS DOUBLE), n / CAST({THRESHOLD} AS DOUBLE)) AS confidence, user_agent
    FROM s_counted WHERE n >= {THRESHOLD}"""
_paths = ", ".join(q(p) for p in rules.CLASSIC_LOGIN_PATHS)
CTES["c_candidates"] = f"""SELECT * FROM classic
    WHERE split_part(lower(path), '?', 1) IN ({_paths}) AND status_code IN (401, 403, 200)"""
CTES["c_counted"] = sliding("c_candidates", WINDOW)
CTES["c_bruteforce"] = f"""SELECT event_id, 0 AS det, 'BRUTE_FORCE' AS threat_type, 'HIGH' AS severity, ip AS source_ip,
    ts, zone, 'Brute Force saldırısı tespit edildi: ' || n || ' istek / {WINDOW}s' AS description, path AS target,
    '' AS payload, CAST(NULL AS VARCHAR) AS pattern, CAST(n AS VARCHAR) AS shown, user_agent
    FROM c_counted WHERE n >= {CLASSIC_BF_THRESHOLD}"""
CTES["d_counted"] = sliding("classic", WINDOW)
CTES["c_ddos"] = f"""SELECT event_id, 1 AS det, 'DDOS' AS threat_type, 'CRITICAL' AS severity, ip AS source_ip, ts, zone,
    'Olası DDoS saldırısı: ' || n || ' istek / {WINDOW}s' AS description, path AS target, '' AS payload,
    CAST(NULL AS VARCHAR) AS pattern, CAST(n AS VARCHAR) AS shown, user_agent
    FROM d_counted WHERE n >= {DDOS_THRESHOLD}"""
CTES["threats"] = " UNION ALL ".join(
    f"SELECT * FROM s_{n}" for n in ("sql_injection", "path_traversal", "xss", "suspicious_ua", "bruteforce"))
CTES["cthreats"] = " UNION ALL ".join(
    f"SELECT * FROM c_{n}" for n in ("bruteforce", "ddos", "sql_injection", "path_traversal", "xss", "suspicious_ua"))
CTES["blocks"] = """SELECT source_ip AS ip, ts AS blocked_at, threat_type, severity, event_id FROM (
    SELECT *, row_number() OVER (PARTITION BY source_ip ORDER BY event_id, det) AS r
    FROM cthreats WHERE severity IN ('HIGH', 'CRITICAL')) WHERE r = 1"""
_tools = "(?i)(" + "|".join(p.removeprefix("(?i)") for p in rules.STRICT_USER_AGENTS) + ")"
CTES["tagged"] = f"""SELECT source_ip AS ip, lower(regexp_extract(user_agent, {q(_tools)}, 1)) AS tool, ts, event_id,
    CASE WHEN threat_type <> 'SUSPICIOUS_UA' THEN threat_type
         WHEN regexp_matches(user_agent, {q(_tools)}) THEN 'TOOL_SCAN' ELSE 'RECON' END AS attack_type
    FROM threats"""
CTES["pertool"] = "SELECT ip, attack_type, tool, count(*) AS n FROM tagged GROUP BY ALL"
CTES["chosen"] = """SELECT *, row_number() OVER (PARTITION BY ip, attack_type
    ORDER BY (tool <> '') DESC, n DESC, tool DESC) AS r, sum(n) OVER (PARTITION BY ip, attack_type) AS attempts
    FROM pertool"""
CTES["incidents"] = """SELECT ip, attack_type, CAST(attempts AS BIGINT) AS attempts, tool,
    CASE WHEN tool <> '' AND attempts >= 10 THEN 'CRITICAL'
         WHEN tool <> '' OR attack_type IN ('SQL_INJECTION', 'XSS', 'PATH_TRAVERSAL') THEN 'HIGH'
         ELSE 'MEDIUM' END AS severity FROM chosen WHERE r = 1"""


def sql(select: str) -> str:
    """The statement with the CTEs it needs, in order."""
    import re
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)
    visit(select)
    if not needed:
        return select
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in needed) + "\n" + select
