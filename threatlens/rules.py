"""Rule tables of the two detection profiles.

``strict`` and ``classic`` are two rule lists over the same engine: every
difference between them is data in this module, not a code path elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: severities, lowest first ---------------------------------
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")

# --- fixed values: strict profile patterns, in match order ------------------
STRICT_SQL_INJECTION = (
    r"(?i)('|%27)\s*(OR|AND)\s*('|\d|%27)",
    r"(?i)\bUNION\b.*\bSELECT\b",
    r"(?i)(--|#|/\*)",
    r"(?i)\bDROP\b.*\bTABLE\b",
    r"(?i)\bEXEC(\s|\()+\w+",
    r"(?i)xp_cmdshell",
    r"(?i);\s*DROP",
    r"(?i)information_schema",
    r"(?i)load_file\s*\(",
    r"(?i)into\s+outfile",
    r"(?i)\bOR\b\s+\d+\s*=\s*\d+",
    r"(?i)'\s*OR\s+'[^']*'\s*=\s*'",
    r"(?i)\bdatabase\s*\(\s*\)",
    r"(?i)\bconcat\s*\(",
    r"(?i)\bgroup_concat\s*\(",
)
STRICT_PATH_TRAVERSAL = (
    r"\.\./",
    r"\.\.\\",
    r"(?i)%2e%2e[/%5c]",
    r"(?i)/etc/(passwd|shadow|hosts)",
    r"(?i)\\windows\\system32",
    r"(?i)/proc/self",
    r"(?i)boot\.ini",
)
STRICT_XSS = (
    r"(?i)<script[^>]*>",
    r"(?i)javascript\s*:",
    r"(?i)on(load|error|click|mouseover)\s*=",
    r"(?i)<iframe",
    r"(?i)<img[^>]+onerror",
    r"(?i)alert\s*\(",
    r"(?i)document\.cookie",
    r"(?i)<svg[^>]+onload",
)
STRICT_USER_AGENTS = (
    "(?i)sqlmap", "(?i)nikto", "(?i)nmap", "(?i)masscan", "(?i)dirbuster",
    "(?i)gobuster", "(?i)wpscan", "(?i)havij", "(?i)acunetix", "(?i)nessus",
    "(?i)openvas", "(?i)burpsuite", "(?i)metasploit", "(?i)hydra", "(?i)w3af",
)
# What an ASCII text must contain, in lower case, for any pattern of the list to
# match: each entry names texts that must all be there.
STRICT_SQL_INJECTION_HINTS = (
    ("'",), ("%27",), ("union", "select"), ("--",), ("#",), ("/*",), ("drop",), ("exec",), ("xp_cmdshell",),
    ("information_schema",), ("load_file",), ("outfile",), ("or", "="), ("database",), ("concat",),
)
STRICT_PATH_TRAVERSAL_HINTS = (
    ("../",), ("..\\",), ("%2e%2e",), ("/etc/",), ("\\windows\\system32",), ("/proc/self",), ("boot.ini",),
)
STRICT_XSS_HINTS = (
    ("<script",), ("javascript",), ("onload",), ("onerror",), ("onclick",), ("onmouseover",), ("<iframe",),
    ("alert",), ("document.cookie",),
)
STRICT_LOGIN_MARKERS = ("/login", "/wp-login", "/admin", "/auth", "/signin")

# --- fixed values: classic profile patterns, in match order -----------------
CLASSIC_SQL_INJECTION = (
    r"(?i)('|%27)\s*(OR|AND)\s*('|\d|%27)",
    r"(?i)(\bUNION\b.*\bSELECT\b)",
    r"(?i)(--|#|/\*)",
    r"(?i)\b(DROP|DELETE|TRUNCATE|ALTER|CREATE)\b.*\b(TABLE|DATABASE)\b",
    r"(?i)\bEXEC\b.*\(",
    r"(?i)(xp_cmdshell|sp_executesql)",
    r"(?i)SLEEP\s*\(\s*\d+\s*\)",
    r"(?i)BENCHMARK\s*\(",
    r"(?i)1\s*=\s*1|'1'\s*=\s*'1'",
    r"(?i)(char|nchar|varchar|nvarchar)\s*\(",
)
CLASSIC_PATH_TRAVERSAL = (
    r"\.\./",
    r"\.\.\\",
    r"(?i)%2e%2e%2f",
    r"(?i)%2e%2e/",
    r"(?i)\.\.%2f",
    r"(?i)%252e%252e%252f",
    r"/etc/passwd",
    r"/etc/shadow",
    r"(?i)c:\\windows\\system32",
    r"(?i)boot\.ini",
)
CLASSIC_XSS = (
    r"(?i)<script[^>]*>",
    r"(?i)javascript\s*:",
    r"(?i)on(load|click|mouseover|error|focus|blur)\s*=",
    r"(?i)<\s*img[^>]+src\s*=\s*['\"]?javascript",
    r"(?i)document\.(cookie|write|location)",
    r"(?i)(alert|prompt|confirm)\s*\(",
    r"(?i)eval\s*\(",
    r"(?i)%3cscript",
    r"(?i)&#\d+;",
    r"(?i)data:text/html",
)
CLASSIC_USER_AGENTS = (
    "(?i)sqlmap", "(?i)nikto", "(?i)nmap", "(?i)masscan", "(?i)zgrab",
    "(?i)python-requests", "(?i)curl/", "(?i)wget/", "(?i)dirbuster",
    "(?i)gobuster", "(?i)hydra", "(?i)metasploit",
)
CLASSIC_LOGIN_PATHS = (
    "/wp-login.php", "/wp-admin/", "/admin/", "/administrator/",
    "/login", "/login.php", "/signin", "/auth", "/api/auth",
    "/.env", "/.git/config", "/phpmyadmin/", "/xmlrpc.php",
)

CLASSIC_SQL_INJECTION_HINTS = (
    ("'",), ("%27",), ("union", "select"), ("--",), ("#",), ("/*",), ("table",), ("database",), ("exec",),
    ("xp_cmdshell",), ("sleep",), ("benchmark",), ("1", "="), ("char",),
)
CLASSIC_PATH_TRAVERSAL_HINTS = (
    ("../",), ("..\\",), ("%2e%2e",), ("..%2f",), ("%252e",), ("/etc/",), ("\\windows\\system32",), ("boot.ini",),
)
CLASSIC_XSS_HINTS = (
    ("<script",), ("javascript",), ("onload",), ("onclick",), ("onmouseover",), ("onerror",), ("onfocus",),
    ("onblur",), ("document.",), ("alert",), ("prompt",), ("confirm",), ("eval",), ("%3cscript",), ("&#",),
    ("data:text/html",),
)

# --- fixed values: log line patterns and time formats -----------------------
ACCESS_STRICT_LINE = (
    r'(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s*([^"]*)"\s+'
    r'(\d{3})\s+(\d+|-)(?:\s+"([^"]*)"\s+"([^"]*)")?'
)
NGINX_CLASSIC_LINE = (
    r'(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+(.*?)\s+HTTP/\S+"\s+'
    r'(\d{3})\s+(\d+|-)\s+"([^"]*)"\s+"([^"]*)"'
)
APACHE_CLASSIC_LINE = (
    r'(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"(\S+)\s+(.*?)\s+HTTP/\S+"\s+'
    r'(\d{3})\s+(\d+|-)(?:\s+"([^"]*)"\s+"([^"]*)")?'
)
SYSLOG_STRICT_LINE = (
    r"(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^\[:]+)(?:\[(\d+)\])?:\s+(.*)"
)
SYSLOG_3164_LINE = (
    r"(\w{3})\s+(\s?\d+)\s+(\d{2}):(\d{2}):(\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.+)"
)
SYSLOG_5424_LINE = r"<(\d+)>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(.+)"
WINDOWS_CSV_LINE = (
    r"(\d{4}-\d{2}-\d{2})[,\t](\d{2}:\d{2}:\d{2})[,\t]([^,\t]+)[,\t](\d+)[,\t]([^,\t]+)[,\t](.*)"
)
SYSLOG_LABELLED_IP = r"(?i)(?:from|src|source|addr|ip)[=:\s]+(\d{1,3}(?:\.\d{1,3}){3})"
WINDOWS_LABELLED_IP = r"(?i)(?:IP|Address|Source)[:\s]+(\d{1,3}(?:\.\d{1,3}){3})"
ANY_IP = r"(\d{1,3}(?:\.\d{1,3}){3})"
NO_IP = "0.0.0.0"

# --- fixed values: lookup tables --------------------------------------------
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun",
          "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
SYSLOG_SEVERITIES = ("EMERGENCY", "ALERT", "CRITICAL", "ERROR",
                     "WARNING", "NOTICE", "INFO", "DEBUG")
SYSLOG_FACILITIES = {
    0: "kern", 1: "user", 2: "mail", 3: "daemon", 4: "auth", 5: "syslog",
    6: "lpr", 7: "news", 8: "uucp", 9: "cron", 10: "authpriv", 11: "ftp",
    16: "local0", 17: "local1", 18: "local2", 19: "local3",
    20: "local4", 21: "local5", 22: "local6", 23: "local7",
}
WINDOWS_LEVELS = ("LOGALWAYS", "CRITICAL", "ERROR", "WARNING", "INFORMATION", "VERBOSE")
WINDOWS_EVENT_LABELS = {
    4625: "Failed logon", 4624: "Successful logon", 4648: "Explicit credentials",
    4672: "Special privileges", 4720: "Account created", 4726: "Account deleted",
    4740: "Account locked out", 1102: "Audit log cleared",
}
STRICT_METHOD_CODES = {"GET": 0, "POST": 1, "PUT": 2, "DELETE": 3, "HEAD": 4}
CLASSIC_METHOD_CODES = {"GET": 0, "POST": 1, "PUT": 2, "DELETE": 3,
                        "HEAD": 4, "OPTIONS": 5, "PATCH": 6}
STRICT_SPECIAL_CHARS = "'\";|<>{}()[]"
CLASSIC_SPECIAL_MARKS = ("<", ">", "'", '"', ";", "(", ")", "\\", "../")
SLACK_COLORS = {"CRITICAL": "#FF0000", "HIGH": "#FF6600",
                "MEDIUM": "#FFB300", "LOW": "#00BCD4"}
TELEGRAM_MARKS = {"CRITICAL": "\U0001F534", "HIGH": "\U0001F7E0",
                  "MEDIUM": "\U0001F7E1", "LOW": "\U0001F535"}
# Headings and counters of the classic text report.
CLASSIC_REPORT_TITLES = {"totals": "\U0001F4CA GENEL İSTATİSTİKLER", "type": "\U0001F50D TEHDİT TÜRLERİ",
                         "severity": "⚠️  TEHDİT SEVİYELERİ", "top": "\U0001F3F4 EN ÇOK SALDIRAN IP'LER"}
CLASSIC_REPORT_TOTALS = {"lines_processed": "İşlenen satır     ", "requests": "Toplam istek      ",
                         "unique_ips": "Benzersiz IP      ", "threats_detected": "Tespit edilen     ",
                         "ips_blocked": "Bloklu IP         "}
REPLY_KEYS = ("is_threat", "threat_type", "severity", "confidence", "reason")


@dataclass(frozen=True)
class PatternRule:
    """One row-wise detector: which text it reads and what it reports."""

    name: str                 # key of the feature flag in the configuration
    threat_type: str
    severity: str
    patterns: tuple[str, ...]
    text: str                 # "path", "path_and_referrer" or "user_agent"
    payload: str              # "text" (what was inspected) or "match" (what matched)
    description: str          # SQL format string; %1$s is the ip, %2$s the user agent
    confidence: float | None
    hints: tuple[tuple[str, ...], ...]
    payload_chars: int | None = 200   # None: kept whole
    agent_chars: int | None = None    # how much of the agent the description shows
    optional: bool = True             # False: cannot be switched off


@dataclass(frozen=True)
class Profile:
    name: str
    rules: tuple[PatternRule, ...]
    order: tuple[str, ...]            # position of each threat type within one entry
    bruteforce_threshold: int
    bruteforce_window: int
    ddos_threshold: int | None        # None: the profile has no flood detector
    ddos_window: int
    contamination: float


def literal_hints(patterns: tuple[str, ...]) -> tuple[tuple[str, ...], ...]:
    """For patterns that are plain words."""
    return tuple((p.removeprefix("(?i)"),) for p in patterns)


# Descriptions and severities below are fixed values of the two profiles.
STRICT = Profile(
    name="strict",
    rules=(
        PatternRule("sql_injection", "SQL_INJECTION", "CRITICAL", STRICT_SQL_INJECTION,
                    "path_and_referrer", "text", "SQL Injection from %1$s", 0.95,
                    STRICT_SQL_INJECTION_HINTS),
        PatternRule("path_traversal", "PATH_TRAVERSAL", "HIGH", STRICT_PATH_TRAVERSAL,
                    "path", "text", "Path Traversal from %1$s", 0.90,
                    STRICT_PATH_TRAVERSAL_HINTS),
        PatternRule("xss", "XSS", "HIGH", STRICT_XSS,
                    "path_and_referrer", "text", "XSS attempt from %1$s", 0.90,
                    STRICT_XSS_HINTS),
        PatternRule("suspicious_ua", "SUSPICIOUS_UA", "MEDIUM", STRICT_USER_AGENTS,
                    "user_agent", "text", "Suspicious UA from %1$s: %2$s", 0.85,
                    literal_hints(STRICT_USER_AGENTS), payload_chars=None),
    ),
    order=("SQL_INJECTION", "PATH_TRAVERSAL", "XSS", "SUSPICIOUS_UA", "BRUTE_FORCE"),
    bruteforce_threshold=5, bruteforce_window=60,
    ddos_threshold=None, ddos_window=60, contamination=0.1,
)
CLASSIC = Profile(
    name="classic",
    rules=(
        PatternRule("sql_injection", "SQL_INJECTION", "HIGH", CLASSIC_SQL_INJECTION,
                    "path", "match", "SQL Injection girişimi tespit edildi", None,
                    CLASSIC_SQL_INJECTION_HINTS),
        PatternRule("path_traversal", "PATH_TRAVERSAL", "HIGH", CLASSIC_PATH_TRAVERSAL,
                    "path", "match", "Path traversal saldırısı tespit edildi", None,
                    CLASSIC_PATH_TRAVERSAL_HINTS),
        PatternRule("xss", "XSS", "MEDIUM", CLASSIC_XSS,
                    "path", "match", "XSS girişimi tespit edildi", None,
                    CLASSIC_XSS_HINTS),
        PatternRule("suspicious_ua", "SUSPICIOUS_UA", "LOW", CLASSIC_USER_AGENTS,
                    "user_agent", "text", "Şüpheli User-Agent tespit edildi: %2$s", None,
                    literal_hints(CLASSIC_USER_AGENTS), agent_chars=100, optional=False),
    ),
    order=("BRUTE_FORCE", "DDOS", "SQL_INJECTION", "PATH_TRAVERSAL", "XSS", "SUSPICIOUS_UA"),
    bruteforce_threshold=100, bruteforce_window=60,
    ddos_threshold=1000, ddos_window=60, contamination=0.05,
)
PROFILES = {"strict": STRICT, "classic": CLASSIC}


def profile(name: str | Profile) -> Profile:
    if isinstance(name, Profile):
        return name
    try:
        return PROFILES[name]
    except KeyError:
        raise ValueError(f"unknown profile {name!r}, expected one of {sorted(PROFILES)}") from None
