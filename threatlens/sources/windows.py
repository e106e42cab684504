"""Windows event exports: XML files, XML columns and text blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threatlens import rules
from threatlens.functions import text
from threatlens.schemas import XML_EVENT


def scan_xml(spark: SparkSession, path: str) -> DataFrame:
    """Events of XML export files; text that is no XML gives no rows.

    Files are cut after every closing ``Event`` tag, so one export is read by
    several tasks, and a broken event does not take its neighbours with it.
    """
    pieces = spark.read.option("lineSep", "</Event>").text(path)
    opened = F.regexp_extract("value", r"(?s)^.*(<Event[\s>].*)$", 1)
    return parse_xml_column(pieces.filter(F.col("value").rlike(r"<Event[\s>]")).select(
        F.concat(opened, F.lit("</Event>")).alias("value")))


def write_xml(documents: DataFrame, path: str, column: str = "value") -> None:
    """Event documents as export files, each with an ``Events`` root."""
    (documents.select(F.from_xml(F.col(column), XML_EVENT).alias("e")).select("e.*")
     .write.format("xml").option("rootTag", "Events").option("rowTag", "Event").mode("overwrite").save(path))


def parse_xml_column(documents: DataFrame, column: str = "value") -> DataFrame:
    """One XML event document per row, parsed once; other columns are carried along."""
    parsed = documents.withColumn("event", text.evaluated_once(
        F.from_xml(F.col(column), XML_EVENT, {"mode": "PERMISSIVE"}))).drop(column)
    return windows_events(parsed)


def windows_events(parsed: DataFrame) -> DataFrame:
    """Typed event columns of a parsed ``event`` struct.

    Elements without a System part or with a non-numeric id are dropped; an
    unreadable time is null.
    """
    system = F.col("event.System")
    data = F.coalesce(F.col("event.EventData.Data"), F.array().cast(
        "array<struct<_Name:string,_VALUE:string>>"))
    pairs = F.transform(data, lambda d: F.struct(
        F.coalesce(d["_Name"], F.lit("Data")).alias("key"),
        F.coalesce(d["_VALUE"], F.lit("")).alias("value")))
    raw_id = system["EventID"]
    level = system["Level"].try_cast("int")
    names = F.array(*[F.lit(n) for n in rules.WINDOWS_LEVELS])
    carried = [c for c in parsed.columns if c != "event"]
    typed = parsed.filter("event.System is not null").select(
        *carried,
        F.when(raw_id.isNull(), F.lit(0)).otherwise(F.btrim(raw_id).try_cast("int")).alias("event_id"),
        text.parse_iso(system["TimeCreated"]["_SystemTime"]).alias("ts"),
        F.coalesce(F.get(names, F.when(level.between(0, 5), level)), F.lit("INFORMATION")).alias("level"),
        F.coalesce(system["Channel"], F.lit("Unknown")).alias("channel"),
        F.coalesce(system["Computer"], F.lit("Unknown")).alias("computer"),
        F.coalesce(system["Security"]["_UserID"], F.lit("N/A")).alias("user"),
        F.coalesce(system["Provider"]["_Name"], F.lit("Unknown")).alias("source"),
        _last_wins(pairs).alias("event_data")).filter("event_id is not null")
    shown = F.transform(F.map_entries("event_data"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return typed.withColumn("message", F.concat_ws(" | ", F.concat(
        F.lit("EventID="), F.col("event_id").cast("string")),
        F.concat(F.lit("Source="), F.col("source")),
        F.nullif(F.array_join(shown, " | "), F.lit(""))))


def _last_wins(pairs: Column) -> Column:
    """Map of key/value pairs: first position, last value of a repeated key."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    values = F.transform(keys, lambda k: F.element_at(
        F.filter(pairs, lambda p: p["key"] == k), -1)["value"])
    return F.map_from_arrays(keys, values)


def parse_blocks(lines: DataFrame, raw: bool = False) -> DataFrame:
    """Blocks of a text export; a line starting with ``Event ID:`` opens one.

    With ``raw`` the lines of a block come along as one text, which then must fit
    in memory.

    The number of a line's block is a running count in file order.  It is taken
    in two steps, so that no task reads a whole file: openings per slice of at most
    ``SLICE`` lines of a split are summed over the slices of a file, then counted inside each slice.
    """
    value = text.strip(F.col("value"))
    marked = lines.select(
        value.alias("value"), "seq",
        F.substring_index(F.col("seq.part"), "#", 1).alias("file"),
        F.col("seq.part").alias("part"), text.floor_div(F.col("seq.pos"), SLICE).alias("slice"),
        value.startswith("Event ID:").cast("int").alias("opens"))
    per_slice = marked.groupBy("file", "part", "slice").agg(F.sum("opens").alias("opened"))
    in_file = Window.partitionBy("file").orderBy("part", "slice")
    offsets = per_slice.select(
        "part", "slice", F.row_number().over(in_file).alias("no"),
        F.coalesce(F.sum("opened").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("part", "slice").orderBy("seq.pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.join(offsets, ["part", "slice"]).withColumn(
        "block", F.col("offset") + F.sum("opens").over(inside)).drop("part", "slice", "opens", "offset")
    keyed = numbered.withColumn("key", F.when(F.col("value").contains(":"), _key(F.col("value"))))

    def last(name: str) -> Column:
        """The value of the last line with this key; combined on the map side, however long a block is."""
        at = F.when(F.col("key") == name, F.struct("no", "seq.pos"))     # file order in numbers, without paths
        return F.max_by(F.when(F.col("key") == name, _value(F.col("value"))), at).alias(name)
    events = keyed.groupBy("file", "block").agg(F.min("seq").alias("seq"), *[last(k) for k in BLOCK_KEYS])
    typed = events.select("file", "block", "seq", *_typed(lambda key, default: F.coalesce(F.col(f"`{key}`"), F.lit(default))))
    if raw:
        texts = numbered.groupBy("file", "block").agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda r: r["value"]), "\n").alias("raw"))
        typed = typed.join(texts, ["file", "block"])
    return typed.filter("event_id is not null").drop("file", "block")


#: Ids of lines in a slice of a split.
SLICE = 1 << 16

#: The lines of a block that become columns.
BLOCK_KEYS = ("Event ID", "Date and Time", "Level", "Log Name", "Computer", "User", "Description", "Source")


def _key(line: Column) -> Column:
    return text.strip(F.substring_index(line, ":", 1))


def _value(line: Column) -> Column:
    return text.strip(F.substring(line, F.instr(line, ":") + 1, F.length(line)))


def _typed(field) -> list[Column]:
    """The event columns from ``field(key, default)``."""
    return [
        field("Event ID", "0").try_cast("int").alias("event_id"),
        F.try_to_timestamp(field("Date and Time", ""), F.lit("M/d/yyyy h:m:s a")).alias("ts"),
        F.upper(field("Level", "Information")).alias("level"),
        field("Log Name", "System").alias("channel"),
        field("Computer", "Unknown").alias("computer"),
        field("User", "N/A").alias("user"),
        field("Description", "").alias("message"),
        field("Source", "Unknown").alias("source")]


def block_events(blocks: DataFrame, column: str = "lines") -> DataFrame:
    """Typed event columns of a ``lines`` array; later duplicates of a key win."""
    pairs = F.transform(F.filter(F.col(column), lambda line: line.contains(":")),
                        lambda line: F.struct(_key(line).alias("key"), _value(line).alias("value")))
    carried = [c for c in blocks.columns if c != column]
    return blocks.withColumn("fields", _last_wins(pairs)).select(
        *carried, *_typed(lambda key, default: F.coalesce(F.element_at(F.col("fields"), key), F.lit(default))),
        F.array_join(column, "\n").alias("raw")).filter("event_id is not null")


def scan_blocks(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    from threatlens.sources.files import scan_file
    return parse_blocks(scan_file(spark, path), raw)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Picks the reader by file extension."""
    return scan_xml(spark, path) if path.lower().endswith(".xml") else scan_blocks(spark, path)
