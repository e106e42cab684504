import json
from datetime import datetime

import pytest
from loglines import line

from threatlens.operators import campaigns, detect, reports, respond, scoring
from threatlens.plans import analysis

BF = {"detection": {"brute_force": {"threshold": 5, "window": 60}}}
ROWS = ([("9.9.9.9", "/login", 401, "python", i) for i in range(6)]
        + [("1.1.1.1", "/?q=<script>", 200, "sqlmap/1.7", 4000 + i) for i in range(12)]
        + [("2.2.2.2", "/../x", 404, "M", 9000)])


@pytest.fixture(scope="module")
def run(entries):
    return analysis.analyze_entries(entries(ROWS), "strict", BF, "x.log")


def test_summary(run):
    row = run.summary().first()
    assert (row.total_lines_processed, row.total_threats, row.unique_attacker_ips, row.blocked_ips_count) == (19, 27, 3, 0)
    assert row.threat_type_breakdown == {"BRUTE_FORCE": 2, "XSS": 12, "SUSPICIOUS_UA": 12, "PATH_TRAVERSAL": 1}
    assert row.severity_breakdown == {"HIGH": 15, "MEDIUM": 12} and row.source_file == "x.log"


def test_empty_input(entries):
    empty = analysis.analyze_entries(entries([("1.1.1.1", "/", 200, "M", 0)]).filter("false"))
    row = empty.summary().first()
    assert (row.total_lines_processed, row.total_threats, row.unique_attacker_ips) == (0, 0, 0)
    assert row.severity_breakdown == {}
    stats = {r.metric: r.value for r in detect.detector_stats(empty.entries, empty.threats).collect()}
    assert stats == {"total_analyzed": 0, "threats_detected": 0}
    assert campaigns.risk_level(empty.campaigns()).first().risk_level == "LOW"


def test_rankings(run):
    assert [(r.ip, r["count"]) for r in reports.top_attackers(run.threats, 2).collect()] == [("1.1.1.1", 24), ("9.9.9.9", 2)]
    assert reports.recent(run.threats, 1).first().threat_type == "PATH_TRAVERSAL"
    assert [r.threat_type for r in reports.first(run.threats, 3).collect()] == ["BRUTE_FORCE", "BRUTE_FORCE", "XSS"]
    assert [(r.severity, r["count"]) for r in reports.severity_order(run.threats).collect()] == [
        ("CRITICAL", 0), ("HIGH", 15), ("MEDIUM", 12), ("LOW", 0)]
    assert [r.hour for r in reports.timeline(run.threats).collect()] == ["2024-01-15T10:00", "2024-01-15T11:00",
                                                                       "2024-01-15T12:00"]
    assert reports.filter_threats(run.threats, "high", limit=5).count() == 3


def test_campaigns(run):
    got = {(r.ip, r.attack_type): (r.attempts, r.tool, r.severity) for r in run.campaigns().collect()}
    assert got == {("9.9.9.9", "BRUTE_FORCE"): (2, "", "MEDIUM"), ("1.1.1.1", "XSS"): (12, "sqlmap", "CRITICAL"),
                   ("1.1.1.1", "TOOL_SCAN"): (12, "sqlmap", "CRITICAL"), ("2.2.2.2", "PATH_TRAVERSAL"): (1, "", "HIGH")}
    noise = campaigns.noise_reduction(run.entries, run.campaigns()).first()
    assert (noise.total_logs, noise.distinct_incidents, noise.reduction_ratio) == (19, 4, 78.9)
    risk = campaigns.risk_level(run.campaigns()).first()
    assert (risk.risk_level, risk.incident_count, risk.attackers) == ("CRITICAL", 4, 3)


def test_sessions_cross_days(entries):
    seconds = [0, 10, 3000, 3700, 7200 + 3601]
    df = entries([("1.1.1.1", "/?q=<script>", 200, "M", s) for s in seconds])
    got = campaigns.campaigns(detect.detect_all(df), gap="1 hour").orderBy("session").collect()
    assert [r.attempts for r in got] == [4, 1]


def test_blocks_and_alerts(entries):
    rows = [("1.1.1.1", "/?q=<script>", 200, "M", 0), ("1.1.1.1", "/../", 200, "M", 10),
            ("1.1.1.1", "/a", 200, "M", 400), ("1.1.1.1", "/../", 200, "M", 20), ("3.3.3.3", "/b", 200, "curl/7", 30)]
    df = entries(rows, "classic")
    config = {"response": {"auto_block": {"enabled": True, "duration": 300}}}
    run = analysis.analyze_entries(df, "classic", config)
    blocks = run.blocks.collect()
    assert [(b.ip, b.threat_type, b.seq.pos, b.duration) for b in blocks] == [("1.1.1.1", "PATH_TRAVERSAL", 1, 300)]
    assert sorted(r.seq.pos for r in respond.blocked_entries(df, run.blocks).collect()) == [1, 3]
    forever = respond.block_decisions(run.threats, duration=0)
    assert sorted(r.seq.pos for r in respond.blocked_entries(df, forever).collect()) == [1, 2, 3]
    assert sorted(r.seq.pos for r in respond.blocked_entries(df, forever, blocked=False).collect()) == [0, 4]
    assert analysis.analyze_entries(df, "classic").blocks.count() == 0
    outbox = respond.alert_outbox(run.threats).filter("channel = 'slack'").orderBy("seq").collect()
    assert len(outbox) == 3                         # the LOW finding is not sent
    message = json.loads(outbox[0].message)["attachments"][0]
    assert message["color"] == "#FFB300" and message["fields"][0]["value"] == "1.1.1.1"
    assert message["fields"][-1] == {"title": "Payload", "value": "`<script>`", "short": False} or \
        message["fields"][-1]["title"] == "Payload"
    stats = respond.responder_stats(run.threats).first()
    assert (stats.total_threats, stats.blocked_ips, stats.alerts_sent) == (4, 2, 3)


def test_written_reports(spark, run, tmp_path):
    staged = run.materialize(str(tmp_path / "run"))
    assert staged.threats.count() == 27
    staged.write_reports(str(tmp_path / "out"), generated="now")
    text = [r.value for r in spark.read.text(str(tmp_path / "out/text")).collect()]
    assert text[1] == "  SECURITY ANALYSIS REPORT" and text[-2] == "  END OF REPORT"
    assert "  Lines Processed  : 19" in text and "  HIGH      :   15 " + "#" * 15 in text
    assert "  [1] HIGH | BRUTE_FORCE | 9.9.9.9 | 2024-01-15 10:00:04" in text
    summary = spark.read.json(str(tmp_path / "out/json/summary")).first()
    assert summary.summary.total_threats == 27 and summary.top_attacker_ips[0].ip == "1.1.1.1"
    assert spark.read.json(str(tmp_path / "out/json/threats")).count() == 27


def test_directory_is_one_input(spark, tmp_path):
    # Three attempts per file: only both files together reach the threshold.
    for name, first in (("b.log", 3), ("a.log", 0)):
        (tmp_path / name).write_text("\n".join(line("9.9.9.9", "/login", 401, second=first + i) for i in range(3)))
    (tmp_path / "c.txt").write_text(line("9.9.9.9", "/login", 401))
    run = analysis.analyze_directory(spark, str(tmp_path), config=BF)
    assert run.entries.count() == 6 and run.threats.count() == 2
    with pytest.raises(FileNotFoundError):
        analysis.analyze_file(spark, str(tmp_path / "none.log"))
    assert analysis.analyze_file(spark, str(tmp_path / "none.log"), profile="classic").entries.count() == 0


def test_prompts_and_scorer(entries):
    df = entries([("1.1.1.1", f"/{i}", 200, "nikto" if i == 7 else "M", i) for i in range(25)])
    batches = scoring.batch_prompts(df, 10, "H:").orderBy("batch").collect()
    assert [b.lines for b in batches] == [10, 10, 5] and batches[1].prompt.startswith("H:1.1.1.1 - - ")
    assert scoring.head_prompt(df, 2, "").first().prompt.count("\n") == 1


def test_rule_scorer_answers_as_the_detector(entries):
    df = entries([("1.1.1.1", "/a?id=1%27%20OR%201=1--", 200, "Mozilla", 0), ("1.1.1.1", "/../../etc/passwd", 200, "sqlmap/1.0", 1),
                  ("1.1.1.1", "/b?x=%3Cscript%3E", 200, "Mozilla", 2), ("1.1.1.1", "/c", 200, "nikto", 3), ("1.1.1.1", "/d", 200, "Mozilla", 4)],
                 "classic")
    found = {}
    for r in detect.detect_patterns(df, profile="classic").orderBy("seq", "det").collect():
        found.setdefault(r.seq.pos, (True, r.threat_type, r.severity))
    scored = scoring.score_external(scoring.entry_prompts(df), scoring.rule_scorer("classic")).collect()
    got = {r.seq.pos: (r.reply.is_threat, r.reply.threat_type, r.reply.severity) for r in scored}
    assert len(found) == 4 and got == {r.seq.pos: (False, "NORMAL", "NONE") for r in scored} | found


def test_batch_scorer_keeps_unreadable_replies_as_null(entries):
    df = entries([("1.1.1.1", f"/{i}", 200, "nikto" if i == 7 else "M", i) for i in range(25)])

    def answer(prompts):
        """A stand-in for a client of a service."""
        return prompts.map(lambda p: "?" if "/3\n" in p else (
            '{"is_threat": %s, "threat_type": "X", "severity": "LOW", "confidence": 0.5, "reason": "r"}' % str("nikto" in p).lower()))
    scored = scoring.score_external(scoring.entry_prompts(df), scoring.batch_scorer(answer)).collect()
    assert [r.seq.pos for r in scored if r.reply and r.reply.is_threat] == [7]
    assert [r.seq.pos for r in scored if r.reply is None] == [3]


def test_clean_logs_materialize(entries, tmp_path):
    from threatlens.plans import analysis
    clean = analysis.analyze_entries(entries([("1.1.1.1", "/about", 200, "Mozilla/5.0", i) for i in range(3)]))
    stored = clean.materialize(str(tmp_path / "run"))
    assert stored.threats.count() == 0 and stored.threats.columns == clean.threats.columns
    stored.write_reports(str(tmp_path / "report"))


def test_undated_findings_keep_their_campaign(spark):
    from threatlens.operators import campaigns
    rows = [("9.9.9.9", "XSS", "Mozilla", None, ("p", 0)), ("9.9.9.9", "XSS", "Mozilla", None, ("p", 1)),
            ("9.9.9.9", "XSS", "Mozilla", "2024-01-15 10:00:00", ("p", 2))]
    threats = spark.createDataFrame(rows, "source_ip string, threat_type string, user_agent string, t string, "
                                          "seq struct<part:string,pos:bigint>").selectExpr("*", "cast(t as timestamp) ts")
    found = {r.session is None: r.attempts for r in campaigns.campaigns(threats, gap="1 hour").collect()}
    assert found == {True: 2, False: 1}


def test_prompts_do_not_depend_on_slices(spark):
    from pyspark.sql import functions as F
    from threatlens.operators import scoring

    def batches(slices):
        part = F.lpad(F.floor(F.col("id") * slices / 300).cast("string"), 4, "0")
        rows = spark.range(300).select(F.concat(F.lit("line "), F.col("id").cast("string")).alias("raw"),
                                       F.struct(part.alias("part"), F.col("id").alias("pos")).alias("seq"))
        return sorted(tuple(r) for r in scoring.batch_prompts(rows).collect())
    assert batches(1) == batches(7) and len(batches(7)) == 6


def test_classic_summary_has_period_and_top_attackers(entries):
    from datetime import datetime
    found = analysis.analyze_entries(entries(ROWS, "classic"), "classic")
    row = reports.summary(found.entries, found.threats, None, "x", "classic", datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 2)).first()
    assert tuple(row.period) == ("2024-01-01T00:00:00", "2024-01-01T00:02:00", 120.0)
    top = [(t.ip, t["count"]) for t in row.top_attacker_ips]
    assert top == [(r.ip, r["count"]) for r in reports.top_attackers(found.threats, 10).collect()] and top[0][0] == "1.1.1.1"
    assert "period" not in reports.summary(found.entries, found.threats, None, "x", "classic").columns


def test_classic_reports(entries, tmp_path):
    df = entries([("1.1.1.1", "/../x", 200, "M", i) for i in range(3)] + [("2.2.2.2", "/a", 200, "M", 9)], "classic")
    run = analysis.analyze_entries(df, "classic")
    began, ended = datetime(2024, 1, 1, 0, 0), datetime(2024, 1, 1, 0, 0, 30)
    run.write_reports(str(tmp_path / "out"), generated="now", started=began, ended=ended)
    spark = df.sparkSession
    summary = spark.read.json(f"{tmp_path}/out/json/summary").first()
    assert summary.totals.asDict() == {"lines_processed": 4, "requests": 4, "unique_ips": 2,
                                       "threats_detected": 3, "ips_blocked": 0}
    assert summary.period.duration_seconds == 30 and summary.top_attacker_ips[0].asDict() == {"ip": "1.1.1.1", "count": 3}
    assert spark.read.json(f"{tmp_path}/out/json/threats").count() == 3
    lines = [r.value for r in spark.read.text(f"{tmp_path}/out/text").collect()]
    assert "  PATH_TRAVERSAL                 : 3" in lines and "   1. 1.1.1.1              : 3 olay" in lines
    assert lines[-2] == "  Rapor oluşturuldu: now"
    clean = analysis.analyze_entries(df.filter("path = '/a'"), "classic")
    lines = [r.line for r in reports.classic_text_report(clean.entries, clean.threats).collect()]
    assert len(lines) == 16 and lines[3] == "  Başlangıç : N/A"      # no section without findings
