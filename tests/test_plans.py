"""Plan shapes that must hold at any scale."""

from pyspark.sql import functions as F

from threatlens import rules
from threatlens.functions import lookup, text
from threatlens.operators import anomaly, detect, parsers, reports
from threatlens.plans import queries as catalogue
from threatlens.sources import bridge

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_detection_stays_in_the_engine(spark):
    text = plan(catalogue._threats(spark, SF))
    for bad in ("Python", "ArrowEval", "NestedLoop", "Cartesian", "BatchEval"):
        assert bad not in text
    assert text.count("PartitionFilters") and "ReadSchema" in text


def test_a_line_is_matched_once_per_pass(spark):
    entries = parsers.parse_nginx(bridge.access_lines(bridge.read_events(spark, SF)))
    text = plan(detect.bruteforce_candidates(entries).select("ip"))
    assert text.count("regexp_replace(value") == 1


def test_a_classic_time_is_read_once(spark):
    """The classic profile's filter on the time takes no copy of its parsing."""
    entries = parsers.parse_nginx(bridge.access_lines(bridge.read_events(spark, SF)), "classic")
    assert plan(entries.select("seq", "ts", "ip")).count("d/MMM/yyyy:H:m:s xx") == 1


def test_method_codes_compare_names_first(spark):
    rows = spark.createDataFrame([(m,) for m in ("GET", "get", "PATCH", "Patch", "HEAD", "TRACE", "", None)], "m string")
    found = rows.select(lookup.method_code(F.col("m")).alias("a"), lookup.method_code(F.col("m"), "classic").alias("b"))
    assert [tuple(r) for r in found.collect()] == [(0, 0), (5, 0), (5, 6), (5, 6), (4, 4), (5, 9), (5, 9), (5, 9)]
    assert plan(found.select("a")).count("element_at") == 0


def test_training_and_scoring_parse_lines_once(spark):
    for name in ("score_iforest", "join_scores"):
        text = plan(catalogue.QUERIES[name](spark, SF))
        assert "regexp" not in text and "get_json_object" not in text, name


def test_the_model_stages_what_it_reads(spark):
    for name in ("score_iforest", "join_scores"):
        staged = catalogue.QUERIES[name](spark, SF).inputFiles()[0]
        columns = set(spark.read.parquet(staged.rsplit("/", 1)[0]).columns)
        assert columns == {*anomaly.INPUTS, "ip"}, name


def test_line_groups_hold_the_pattern_few_times(spark):
    """Lines with the joining character itself take one expression, not one for each group."""
    lines = spark.createDataFrame([("1.1.1.1 - \x01 [x] \"GET /\x01 HTTP/1.1\" 200 5 \"-\" \"a\x01b\"",), ("odd \x01 line",),
                                   ("2.2.2.2 - - [x] \"GET / HTTP/1.1\" 200 5 \"-\" \"a\"",)], "value string")
    found = lines.select(text.line_groups(F.col("value"), rules.NGINX_CLASSIC_LINE, 8).alias("g"))
    assert plan(found).count("regexp_extract") == 1
    a, b, c = (r.g for r in found.collect())
    assert a == ["1.1.1.1", "x", "GET", "/\x01", "200", "5", "-", "a\x01b"] and b is None
    assert c == ["2.2.2.2", "x", "GET", "/", "200", "5", "-", "a"]


def test_an_xml_document_is_parsed_once(spark):
    text = plan(catalogue.QUERIES["parse_windows_xml_col"](spark, SF))
    assert text.count("from_xml(") == 1


def test_narrow_reads(spark):
    text = plan(reports.count_by(detect.detect_patterns(catalogue._entries(spark, SF)), "threat_type"))
    assert "event_type" not in text.split("ReadSchema")[1].split(">")[0]


def test_no_query_uses_a_cross_join(spark):
    for name in ("report_summary_classic", "campaigns", "whitelist_audit", "join_block_active", "dashboard_stats",
                 "noise_reduction", "join_cidr_anti", "detect_port_scan"):
        text = plan(catalogue.QUERIES[name](spark, SF))
        assert "Cartesian" not in text and "NestedLoop" not in text, name
