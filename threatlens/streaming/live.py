"""The whole detector on a stream: pattern rules and trailing-window counts in one query.

Pattern rules need no state.  Counts keep state per address, counter and stretch
of time of the window's own length: a window lies in the stretch of its last row
and the one before, so every row goes to its own stretch and, without its other
columns, to the next.  A key's state is the counts of at most two windows, and a
timer drops it when the watermark has passed, so addresses that fall silent leave
nothing behind, and the backlog of one hot address is spread over its stretches.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from threatlens import rules
from threatlens.functions import text
from threatlens.functions.text import floor_div
from threatlens.operators import detect, parsers, respond, whitelist

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CARRIED = ("ip", "ts", "ts_offset", "path", "raw", "user_agent", "seq", "source_name")


class Counter(NamedTuple):
    """One trailing-window count: rows it looks at, seconds, and the count from which rows are given out."""
    name: str
    applies: Column
    window: int
    at_least: int


def state_store(spark: SparkSession) -> SparkSession:
    """Keyed processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    return spark


class _Counts(StatefulProcessor):
    """Counts of one address, counter and stretch.

    Without ``wait`` rows are counted as they arrive, among what has arrived.  With it
    they are held until the watermark has passed them, so rows that come late, but not
    too late, are counted as if they had come in time.
    """

    def __init__(self, windows: dict[str, tuple[int, int]], carried: str, wait: bool) -> None:
        self.windows, self.carried, self.wait = windows, carried, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "us array<bigint>, n array<bigint>")
        self.held = handle.getListState("held", f"us bigint, row struct<{self.carried}>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        _, name, stretch = key
        window, at_least = self.windows[name]
        known = self.counts.get()
        us, n = (list(known[0]), list(known[1])) if known is not None else ([], [])
        new = sorted(((r.us, _plain(r.row)) for r in rows), key=_place)
        if known is None:
            self.handle.registerTimer((stretch + 1) * window // 1000)
        found = []
        if not self.wait:
            found = self._counted([(at, row) for at, row in new if row is not None],
                                  *_merged(us, n, [at for at, row in new if row is None]), window, at_least)
        us, n = _merged(us, n, [at for at, _ in new])
        self.counts.update((us, n))
        if self.wait:
            own = [(at, row) for at, row in new if row is not None]
            if own:
                self.held.appendList([_stored(r) for r in own])
                for at in {at for at, _ in own}:
                    self.handle.registerTimer(at // 1000 + 1)
        for row, count in found:
            yield self._out(name, row, count)

    def _counted(self, own: list[tuple], us: list[int], n: list[int], window: int, at_least: int) -> list[tuple]:
        """(row, count) of the rows that reach the threshold; ``own`` is sorted and not yet part of the counts."""
        out, sums, last, base, first = [], _sums(n), None, 0, 0
        for i, (at, row) in enumerate(own):
            if at != last:
                last, base = at, sums[bisect_left(us, at + 1)] - sums[bisect_left(us, at - window)]
                while own[first][0] < at - window:
                    first += 1
            count = base + i + 1 - first
            if count >= at_least:
                out.append((row, count))
        return out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        _, name, stretch = key
        window, at_least = self.windows[name]
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        if self.wait and self.held.exists():
            held = sorted(((r[0], _plain(r[1])) for r in self.held.get()), key=_place)
            ready, later = [r for r in held if r[0] < passed], [r for r in held if r[0] >= passed]
            if ready:
                us, n = self.counts.get()
                # Rows still held are part of the counts but come after; ready ones are ranked one by one.
                before = _without(list(us), list(n), [at for at, _ in ready])
                for row, count in self._counted(ready, *before, window, at_least):
                    yield self._out(name, row, count)
                if later:
                    self.held.put([_stored(r) for r in later])
                else:
                    self.held.clear()
        if passed >= (stretch + 1) * window and not (self.wait and self.held.exists()):
            self.counts.clear()

    def _out(self, name: str, row: dict, count: int) -> Row:
        return Row(counter=name, window_count=count, **row)

    def close(self) -> None:
        pass


def _plain(row: Any) -> dict | None:
    """A carried row as a dict; its order of arrival as a tuple."""
    if row is None:
        return None
    out = dict(row if isinstance(row, dict) else row.asDict())
    if out.get("seq") is not None:
        seq = out["seq"]
        out["seq"] = (seq["part"], seq["pos"])
    return out


def _place(r: tuple[int, dict | None]) -> tuple:
    """Time, then arrival."""
    return r[0], (r[1] or {}).get("seq") or ()


def _stored(r: tuple[int, dict]) -> tuple:
    return r[0], tuple(r[1].values())


def _sums(n: list[int]) -> list[int]:
    out = [0]
    for value in n:
        out.append(out[-1] + value)
    return out


def _merged(us: list[int], n: list[int], new: list[int]) -> tuple[list[int], list[int]]:
    """Sorted instants and their counts with further instants."""
    held = dict(zip(us, n))
    for at in new:
        held[at] = held.get(at, 0) + 1
    order = sorted(held)
    return order, [held[at] for at in order]


def _without(us: list[int], n: list[int], gone: list[int]) -> tuple[list[int], list[int]]:
    held = dict(zip(us, n))
    for at in gone:
        held[at] -= 1
    return us, [held[at] for at in us]


def counted(entries: DataFrame, counters: list[Counter], lateness: str = "10 minutes", wait: bool = False) -> DataFrame:
    """Entries that reach a counter's threshold, with ``counter`` and ``window_count``.

    Rows with the same address and time count in the order of ``seq``, where there is one.
    Rows that the watermark has passed are dropped; the query's progress says how many.
    """
    state_store(entries.sparkSession)
    carried = [c for c in _CARRIED if c in entries.columns]
    timed = entries.select(*carried, *[c.applies.alias(f"_applies_{i}") for i, c in enumerate(counters)]) \
        .where("ts is not null and ip is not null").withWatermark("ts", lateness)
    copies = []
    for i, c in enumerate(counters):
        stretch = floor_div(F.unix_micros("ts"), c.window * 1_000_000)
        for later in (0, 1):
            copies.append(F.when(F.col(f"_applies_{i}"), F.struct(
                F.lit(c.name).alias("counter"), (stretch + later).alias("stretch"), F.lit(not later).alias("own"))))
    exploded = timed.withColumn("_c", F.explode(F.array_compact(F.array(*copies))))
    keyed = exploded.select(
        "ip", F.col("_c.counter").alias("counter"), F.col("_c.stretch").alias("stretch"), "ts",
        F.unix_micros("ts").alias("us"), F.when(F.col("_c.own"), F.struct(*carried)).alias("row"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in timed.select(*carried).schema)
    row_schema = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in timed.select(*carried).schema)
    windows = {c.name: (c.window * 1_000_000, c.at_least) for c in counters}
    return keyed.groupBy("ip", "counter", "stretch").transformWithState(
        statefulProcessor=_Counts(windows, row_schema, wait), outputMode="Append", timeMode="EventTime",
        outputStructType=f"counter string, window_count bigint, {schema}")


def _counters(config: dict | None, p: rules.Profile) -> tuple[list[Counter], Column]:
    """The enabled counters of a profile and the finding for each row they give out."""
    found, threat = [], F.lit(None)
    brute, flood = detect.settings(config, "brute_force"), detect.settings(config, "ddos")
    if brute.get("enabled", True):
        least, window = brute.get("threshold", p.bruteforce_threshold), brute.get("window", p.bruteforce_window)
        found.append(Counter("BRUTE_FORCE", detect.is_login_attempt(p), window, least))
        threat = F.when(F.col("counter") == "BRUTE_FORCE", detect.bruteforce_threat(p, least, window)).otherwise(threat)
    if p.ddos_threshold is not None and flood.get("enabled", True):
        least, window = flood.get("threshold", p.ddos_threshold), flood.get("window", p.ddos_window)
        found.append(Counter("DDOS", F.lit(True), window, least))
        threat = F.when(F.col("counter") == "DDOS", detect.ddos_threat(p, least, window)).otherwise(threat)
    return found, threat


def detect_all(lines: DataFrame, fmt: str = "nginx", profile: str | rules.Profile = "strict", config: dict | None = None,
               lateness: str = "10 minutes", wait: bool = False) -> DataFrame:
    """All findings of a stream of lines, with the columns of the batch detector.

    ``wait`` holds counted rows until the watermark has passed them: findings then equal
    the batch's whatever the order of arrival within ``lateness``.
    """
    p = rules.profile(profile)
    entries = whitelist.apply(parsers.parse(lines, fmt, p.name), config, p.name)
    found = detect.detect_patterns(entries, config, p)
    counters, threat = _counters(config, p)
    if not counters:
        return found
    late = counted(entries.withColumn("ts_offset", text.offset_of(entries)), counters, lateness, wait)
    return found.unionByName(detect.threat_columns(late.withColumn("_t", threat)))


# --- blocks ------------------------------------------------------------------------------
class _Blocks(StatefulProcessor):
    """One address: its block in force, from the earliest finding that met none."""

    def __init__(self, ttl_us: int) -> None:
        self.ttl = ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "us bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = self.until.get()
        until = known[0] if known is not None else None
        for row in sorted(rows, key=lambda r: (r.us, *r.place)):
            if until is None or row.us >= until:
                until = row.us + self.ttl
                yield Row(ip=key[0], blocked_at=row.ts, threat_type=row.threat_type, severity=row.severity)
        if until is not None and (known is None or until != known[0]):
            self.until.update((until,))
            self.handle.registerTimer(until // 1000 + 1)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        known = self.until.get()
        if known is not None and known[0] <= timerValues.getCurrentWatermarkInMs() * 1000:
            self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def blocks(threats: DataFrame, ttl_seconds: int = 3600, lateness: str = "10 minutes") -> DataFrame:
    """Blocks with a term: the earliest finding, by (ts, seq), of an address that is not blocked then starts one.

    A block ends ``ttl_seconds`` after its start; a finding at that moment or later starts the next.
    """
    state_store(threats.sparkSession)
    order = F.array(*[F.col(c).cast("string") for c in (("seq.part",) if "seq" in threats.columns else ())],
                    *[F.lpad(F.col(c).cast("string"), 20, "0") for c in (("seq.pos", "det") if "seq" in threats.columns else ("det",))])
    narrow = (respond.blockable(threats).where("ts is not null").withWatermark("ts", lateness)
              .select("source_ip", "ts", F.unix_micros("ts").alias("us"), order.alias("place"), "threat_type", "severity"))
    return narrow.groupBy("source_ip").transformWithState(
        statefulProcessor=_Blocks(ttl_seconds * 1_000_000), outputMode="Append", timeMode="EventTime",
        outputStructType="ip string, blocked_at timestamp, threat_type string, severity string")
