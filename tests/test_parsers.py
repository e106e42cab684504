from datetime import datetime

import pytest

from threatlens.operators import detect, parsers, reports
from threatlens.sources import files, windows

NORMAL = '198.51.100.7 - - [09/Mar/2024:08:15:42 +0000] "GET /catalog/lamps?page=3 HTTP/1.1" 200 913 "-" "Firefox/128.0"'
SPACES = ('198.51.100.8 - - [09/Mar/2024:08:16:01 +0000] "GET /lamps?maker=9\' AND \'9 HTTP/1.1" 500 77 "-" '
          '"Firefox/128.0"')


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_strict_path_stops_at_blank_and_classic_does_not(lines):
    strict = one(parsers.parse_nginx(lines([SPACES])))
    assert (strict.path, strict.protocol) == ("/lamps?maker=9'", "AND '9 HTTP/1.1")
    classic = one(parsers.parse_nginx(lines([SPACES]), "classic"))
    assert classic.path == "/lamps?maker=9' AND '9"


def test_normal_line(lines):
    row = one(parsers.parse_nginx(lines(["  " + NORMAL + "\r"])))
    assert (row.ip, row.method, row.path, row.protocol) == ("198.51.100.7", "GET", "/catalog/lamps?page=3", "HTTP/1.1")
    assert (row.status_code, row.bytes_sent, row.referrer, row.user_agent) == (200, 913, "-", "Firefox/128.0")
    assert row.ts == datetime(2024, 3, 9, 8, 15, 42) and row.ts_hour == 8 and row.raw == NORMAL


def test_rejected_and_odd_lines(lines):
    texts = ["", "   ", "# note", "not a log line",
             '1.1.1.1 - - [15/Jan/2024:00:00:01 +0000] "HEAD /h HTTP/1.1" 200 -',
             '1.1.1.2 - - [bad time] "GET /x HTTP/1.1" 200 5 "-" "a"',
             '1.1.1.3 - - [5/Jan/2024:01:02:03 +0300] "GET /x" 404 5',
             '1.1.1.4 - - [05/jan/2024:01:02:03 +03:00] "GET /x HTTP/1.1" 404 5 "" ""',
             '1.1.1.5 - - [05/Jan/2024:01:02:03 +0000] "GET /a\x01b HTTP/1.1" 200 5 "-" "x"']
    rows = {r.ip: r for r in parsers.parse_nginx(lines(texts)).collect()}
    assert set(rows) == {f"1.1.1.{i}" for i in range(1, 6)}
    assert (rows["1.1.1.1"].bytes_sent, rows["1.1.1.1"].referrer, rows["1.1.1.1"].user_agent) == (0, "-", "")
    assert rows["1.1.1.2"].ts is None
    assert rows["1.1.1.3"].protocol == "HTTP/1.1"
    assert rows["1.1.1.3"].ts == rows["1.1.1.4"].ts == datetime(2024, 1, 4, 22, 2, 3)
    assert rows["1.1.1.3"].ts_hour == 1 and rows["1.1.1.4"].referrer == "-"
    assert rows["1.1.1.5"].path == "/a\x01b"
    assert {r.ip for r in parsers.parse_nginx(lines(texts), "classic").collect()} == {"1.1.1.4", "1.1.1.5"}
    apache = {r.ip: r for r in parsers.parse_apache(lines(texts), "classic").collect()}
    assert set(apache) == {"1.1.1.1", "1.1.1.4", "1.1.1.5"} and apache["1.1.1.1"].user_agent == "-"


def test_quality(lines):
    row = one(parsers.parse_quality(lines([NORMAL, SPACES, "", "# x", "junk"])))
    assert (row.lines_parsed, row.parse_errors) == (2, 1) and abs(row.success_rate - 200 / 3) < 1e-9
    assert one(parsers.parse_quality(lines([""]))).success_rate == 0.0


def test_syslog_strict(lines):
    texts = ["Jan 15 14:30:00 server sshd[12345]: Failed password for root from 192.168.1.100 port 22 ssh2",
             "Feb 30 14:30:00 server cron: no address", "Jan  5 01:02:03 h app: see 9.8.7.6 now"]
    rows = parsers.parse_syslog_entries(lines(texts), year=2024).orderBy("seq").collect()
    assert [r.ip for r in rows] == ["192.168.1.100", "0.0.0.0", "9.8.7.6"]
    assert rows[0].path == "/sshd" and rows[0].user_agent == "server/sshd" and rows[0].status_code == 0
    assert rows[0].extra["pid"] == "12345" and rows[1].extra["pid"] == "" and rows[1].ts is None
    assert rows[2].ts == datetime(2024, 1, 5, 1, 2, 3)


def test_syslog_messages(lines):
    texts = ["<165>1 2024-01-15T14:32:00+00:00 my.example.com evntslog 256 ID47 [x] An entry",
             "<999>1 nonsense host app - ID1 text", "Jan 15 14:30:00 server sshd[12]: hello",
             "Xyz 15 14:30:00 server sshd: hello", "Feb 30 14:30:00 server sshd: hello", "junk"]
    rows = parsers.parse_syslog_messages(lines(texts), year=2024).orderBy("seq").collect()
    assert len(rows) == 4
    assert (rows[0].facility, rows[0].severity, rows[0].pid) == ("local4", "NOTICE", 256)
    assert rows[0].ts == datetime(2024, 1, 15, 14, 32) and rows[0].message == "[x] An entry"
    assert (rows[1].facility, rows[1].severity, rows[1].pid, rows[1].ts) == ("unknown", "DEBUG", None, None)
    assert (rows[2].pid, rows[2].severity, rows[2].facility) == (12, "INFO", "syslog")
    assert rows[3].ts == datetime(2024, 1, 15, 14, 30)          # unknown month name counts as January


def test_windows_csv(lines):
    texts = ["Date,Time,Source,EventID,Level,Message",
             "2024-01-15,14:30:00,Security,4625,Error,An account failed to log on. IP: 192.168.1.50",
             "2024-01-15\t14:30:00\tSystem \t7\tInfo\tnothing"]
    rows = parsers.parse_windows_csv(lines(texts)).orderBy("seq").collect()
    assert [(r.ip, r.status_code, r.path) for r in rows] == [
        ("192.168.1.50", 4625, "/event/4625"), ("0.0.0.0", 7, "/event/7")]
    assert rows[0].extra["event_description"] == "Failed logon" and rows[1].user_agent == "Windows/System"


def test_registry(lines):
    with pytest.raises(ValueError):
        parsers.parse(lines([NORMAL]), "unknown")
    assert parsers.parse(lines([NORMAL]), "unknown", "classic").count() == 1
    assert parsers.parse(lines([NORMAL]), "APACHE").first().source == "apache"


def test_files_keep_order_and_replace_bad_bytes(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\ntwo\rthree \xff\n")
    (tmp_path / "b.log").write_text("four\nfive\n")
    (tmp_path / "c.txt").write_text("ignored\n")
    rows = files.scan_directory(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.value for r in rows] == ["one", "two", "three �", "four", "five"]
    with pytest.raises(FileNotFoundError):
        files.scan_file(spark, str(tmp_path / "none.log"))
    assert files.scan_file(spark, str(tmp_path / "none.log"), "empty").count() == 0
    assert files.scan_directory(spark, str(tmp_path), "*.gz").count() == 0


def test_windows_blocks(spark, tmp_path):
    (tmp_path / "w.txt").write_text(
        "Event ID: 4625\nDate and Time: 1/15/2024 2:30:00 PM\nLevel: Error\nSource: A\nSource: B\nDescription: x: y\n"
        "\nEvent ID: 7\nno colon\nEvent ID: bad\n")
    rows = windows.scan(spark, str(tmp_path / "w.txt")).orderBy("seq").collect()
    assert [r.event_id for r in rows] == [4625, 7]
    assert rows[0].ts == datetime(2024, 1, 15, 14, 30) and rows[0].level == "ERROR"
    assert rows[0].source == "B" and rows[0].message == "x: y"
    assert (rows[1].level, rows[1].channel, rows[1].user, rows[1].ts) == ("INFORMATION", "System", "N/A", None)


def test_windows_xml(spark, tmp_path):
    event = ('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="P"/>'
             '<EventID>{}</EventID><Level>2</Level><TimeCreated SystemTime="2024-01-15T14:30:00Z"/></System>'
             '<EventData><Data Name="A">1</Data><Data Name="B"/><Data Name="A">2</Data></EventData></Event>')
    (tmp_path / "e.xml").write_text("<Events>" + event.format(1) + event.format(2) + "</Events>")
    rows = windows.scan(spark, str(tmp_path / "e.xml")).orderBy("event_id").collect()
    assert [r.event_id for r in rows] == [1, 2]
    assert (rows[0].level, rows[0].channel, rows[0].user) == ("ERROR", "Unknown", "N/A")
    assert rows[0].event_data == {"A": "2", "B": ""} and rows[0].ts == datetime(2024, 1, 15, 14, 30)
    assert rows[0].message == "EventID=1 | Source=P | A=2 | B="
    texts = spark.createDataFrame([(event.format(3),), ("<Event>",), (event.format("x"),), ("<Other/>",)],
                                  "value string")
    assert [r.event_id for r in windows.parse_xml_column(texts).collect()] == [3]


def test_one_xml_export_is_read_by_several_tasks(spark, tmp_path):
    from threatlens.sources import windows
    event = ('<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><EventID>{}</EventID>'
             "<Level>2</Level></System><EventData><Data Name='Note'>{}</Data></EventData></Event>")
    text = "<?xml version='1.0'?>\n<Events>\n" + "\n".join(event.format(i, "x" * 200) for i in range(300)) + "\n</Events>"
    (tmp_path / "a.xml").write_text(text)
    (tmp_path / "b.xml").write_text("<Event><System><EventID>900</EventID></System></Event>")
    (tmp_path / "c.xml").write_text("<Events><Event><System><EventID>1</Ev <Event><System><EventID>901</EventID>"
                                    "</System></Event> no event here </Event>")
    (tmp_path / "d.xml").write_text("not xml at all")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        found = windows.scan_xml(spark, str(tmp_path))
        assert sorted(r.event_id for r in found.collect()) == [*range(300), 900, 901]
        assert found.rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_offsets_are_kept(lines):
    def stamped(stamp):
        return f'1.2.3.4 - - [{stamp}] "GET /?q=<script> HTTP/1.1" 200 5 "-" "Mozilla"'
    stamps = ["15/Jan/2024:23:30:00 -0500", "16/Jan/2024:08:00:00 +03:30", "16/Jan/2024:04:30:00 +0000", "41/Foo/2024:1:2:3 x"]
    entries = parsers.parse_nginx(lines([stamped(s) for s in stamps]))
    shown = [r.timestamp for r in parsers.entry_projection(entries).orderBy("seq").collect()]
    assert shown == ["2024-01-15T23:30:00-05:00", "2024-01-16T08:00:00+03:30", "2024-01-16T04:30:00+00:00", None]
    assert entries.filter("ts is not null").select("ts").distinct().count() == 1
    found = detect.detect_patterns(entries)
    assert [r.timestamp for r in detect.threat_dict(found).collect()] == shown
    assert {r.hour: r["count"] for r in reports.timeline(found).collect()} == {
        "2024-01-15T23:00": 1, "2024-01-16T08:00": 1, "2024-01-16T04:00": 1}
    naive = parsers.parse_syslog_entries(lines(["Jan 15 10:00:00 h sshd[1]: Failed password from 1.2.3.4"]), year=2024)
    assert parsers.entry_projection(naive).first().timestamp == "2024-01-15T10:00:00"
