"""Conversation structure repair with the least edits, in linear space.

A conversation may begin with a system turn and then alternates user and
assistant.  Four states say what stood last: nothing, system, user, assistant.
Each row is kept, given another role or deleted, and turns may be inserted; a row
is a transfer between states with costs.  The cheapest edits are found by
Hirschberg's divide and conquer: a forward vector of four costs from the left end
and a backward one from the right end meet in the middle; the crossing state of
least cost is fixed and both halves go on by themselves.  Forward vectors also
carry the order of the states' audits (a letter per edit), so among equal costs
the crossing is the one whose audit comes first.  Nothing but the two vectors is
kept per level.  Edits up to a crossing end with the row before it, so audits up to a
crossing are never prefixes of each other, and their order is the order of the whole.

Conversations of at most ``LONG`` rows are worked on whole, one task for many of
them.  Longer ones are range-partitioned by their order and cut into segments of
bounded size.  A segment's transfer is four by four costs and orders; segments meet
through their transfers only, and once their end states are known each is rebuilt by
itself.  Only two values of a long conversation are put together in one task, because
they are one value: its audit, and the digest, which reads the segments as a stream.

Rows are taken by turn, nulls first; of equal turns by role and text.  Nulls in role
and text are one space.  A conversation is a ``conv_id``; null is one of its own.  Equal
rows are duplicates after the first.  Very long texts are read whole.  An empty table
gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from threatlens.llm import shared

LONG = 100_000                                  # rows of a conversation that one task may hold
SEGMENT_ROWS, SEGMENT_CHARS = 4096, 1 << 22
_WHITE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}   # what may be inserted, or a role become
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Edits after the last row, by state.
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Faults of a row, and letters of its role that matter.
SOUND, BLANK, DUPLICATE, CUT_OFF = range(4)
NUMBERS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"

# --- transfers ---------------------------------------------------------------------
# A transfer is a tuple of 16: for each state before and after, (cost, order) or None.
# Orders compare the ways out of one state: audits for rows, ranks for segments.
Transfer = tuple


@functools.cache
def of_row(initial: str, fault: int) -> Transfer:
    """The cheapest edits from each state to each, first in order among equals, up to and including one row."""
    out: list = [None] * 16
    extra = TRUNCATED if fault == CUT_OFF else 0
    for start in range(4):
        state, inserted = start, ""
        for _ in range(3):                      # a third insertion would only repeat the first
            ways = [(DELETE, "D", state)]
            if fault in (SOUND, CUT_OFF):
                ways.append((REROLE + extra, "R", _NEXT[state]))
                if state in _KEPT.get(initial, {}):
                    ways.append((KEEP + extra, "K", _KEPT[initial][state]))
            for cost, letter, end in ways:
                way = (cost + INSERT * len(inserted), inserted + letter)
                if out[4 * start + end] is None or way < out[4 * start + end]:
                    out[4 * start + end] = way
            state, inserted = _NEXT[state], inserted + "I"
    return tuple(out)


@functools.lru_cache(maxsize=200_000)
def forward(vector: tuple, transfer: Transfer) -> tuple[int, tuple]:
    """(cost, order) per state, one transfer on; least cost apart, so that vectors recur."""
    ways = []
    for end in range(4):
        found = min(((vector[p][0] + t[0], vector[p][1], t[1]) for p in range(4)
                     if vector[p] is not None and (t := transfer[4 * p + end]) is not None), default=None)
        ways.append(found)
    order = {w[1:]: i for i, w in enumerate(sorted((w for w in ways if w is not None), key=lambda w: w[1:]))}
    least = min(w[0] for w in ways if w is not None)
    return least, tuple(None if w is None else (w[0] - least, order[w[1:]]) for w in ways)


@functools.lru_cache(maxsize=200_000)
def backward(vector: tuple, transfer: Transfer) -> tuple:
    """Cost from each state to the end, one transfer earlier; least cost taken off."""
    ways = [min((t[0] + vector[q] for q in range(4) if vector[q] is not None and (t := transfer[4 * p + q]) is not None),
                default=None) for p in range(4)]
    least = min((w for w in ways if w is not None), default=0)
    return tuple(None if w is None else w - least for w in ways)


def only(state: int) -> tuple:
    return tuple((0, 0) if s == state else None for s in range(4))


def crossing(vector: tuple, rest: tuple | list) -> int:
    """The state of least cost with what is left, of equals the one whose audit comes first."""
    return min((v[0] + rest[s], v[1], s) for s, v in enumerate(vector) if v is not None and rest[s] is not None)[2]


def path(transfers: list[Transfer], start: int, end: int) -> list[int]:
    """The states after each transfer of the best way from ``start`` to ``end``."""
    out = [end] * len(transfers)
    todo = [(0, len(transfers), start, end)]
    while todo:
        low, high, p, q = todo.pop()
        if high - low < 2:
            continue
        middle = (low + high) // 2
        left, right = only(p), tuple(0 if s == q else None for s in range(4))
        for transfer in transfers[low:middle]:
            left = forward(left, transfer)[1]
        for transfer in reversed(transfers[middle:high]):
            right = backward(right, transfer)
        out[middle - 1] = meet = crossing(left, right)
        todo += [(low, middle, p, meet), (middle, high, meet, q)]
    return out


def over(transfers: list[Transfer], start: int = START) -> tuple[int, tuple]:
    """Cost and vector after all transfers."""
    total, vector = 0, only(start)
    for transfer in transfers:
        cost, vector = forward(vector, transfer)
        total += cost
    return total, vector


def ending(vector: tuple) -> int:
    return crossing(vector, [INSERT * len(CLOSING[s]) for s in range(4)])


def together(transfers: list[Transfer]) -> Transfer:
    """One transfer for a run of them."""
    out: list = []
    for start in range(4):
        total, vector = over(transfers, start)
        out += [None if v is None else (total + v[0], v[1]) for v in vector]
    return tuple(out)


@functools.lru_cache(maxsize=100_000)
def audits(rows: tuple[tuple[str, int], ...], start: int, end: int) -> tuple[str, ...]:
    """The edits up to and including each row, on the best way between two states."""
    transfers = [of_row(*row) for row in rows]
    states = path(transfers, start, end)
    return tuple(t[4 * p + q][1] for t, p, q in zip(transfers, [start, *states], states))


# --- rows ----------------------------------------------------------------------------
def initial(role: str) -> str:
    """The first letter of a role; letters that no legal conversation has are all alike."""
    return role[:1] if role[:1] in _KEPT and role else "?"


def fault(text: str, seen: bool) -> int:
    held = text.strip(_WHITE)
    return BLANK if not held else DUPLICATE if seen else SOUND if held[-1] in ".!?" else CUT_OFF


def illegal(before: str, after: str) -> bool:
    """Role initials that may not follow each other."""
    return before[:1] + after[:1] not in ("su", "ua", "au")


def rebuilt(rows: list[tuple[str, str]], edits: tuple[str, ...] | list[str], state: int) -> list[tuple[str, str, str]]:
    """(edit, role, text) for each letter of the audit; role and text are null for deletions."""
    out = []
    for (role, text), letters in zip(rows, edits):
        for letter in letters:
            if letter == "D":
                out.append(("D", None, None))
                continue
            state = _KEPT[initial(role)][state] if letter == "K" else _NEXT[state]
            out.append((letter, role if letter == "K" else _NAMES[state], "" if letter == "I" else text))
    return out


def closed(state: int) -> list[tuple[str, str, str]]:
    out = []
    for letter in CLOSING[state]:
        state = _NEXT[state]
        out.append((letter, _NAMES[state], ""))
    return out


def written(rows: list[tuple[str, str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for _, role, text in rows if role is not None)


def _gaps(turns: list[int | None]) -> int:
    held = {t for t in turns if t is not None}
    return max(held) - min(held) + 1 - len(held) if held else 0


def _whole(turns: list, rows: list[tuple[str, str]]) -> tuple[list[int], str, list[tuple[str, str, str]]]:
    """Numbers, audit and rebuilt rows of one conversation."""
    seen, found = set(), []
    for row in rows:
        found.append((initial(row[0]), fault(row[1], row in seen)))
        seen.add(row)
    faults = [f for _, f in found]
    total, vector = over([of_row(*f) for f in found])
    end = ending(vector)
    edits = audits(tuple(found), START, end)
    cost = total + vector[end][0] + INSERT * len(CLOSING[end])
    numbers = [_gaps(turns), faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT_OFF),
               sum(illegal(a[0], b[0]) for a, b in zip(rows, rows[1:])), cost]
    return numbers, "".join(edits) + CLOSING[end], rebuilt(rows, edits, START) + closed(end)


# --- Spark -----------------------------------------------------------------------------
def _ordered(convs: DataFrame) -> DataFrame:
    """conv_id, key (never null), turn, role and text."""
    text = F.col("conv_id").cast("string")
    return convs.select("conv_id", F.when(text.isNull(), "n").otherwise(F.concat(F.lit("v"), text)).alias("key"), "turn",
                        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def _split(convs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations of bounded length, and those of longer ones if there are any."""
    rows = _ordered(convs)
    long = shared.staged(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > LONG).select("key"), "long")
    if not long.limit(1).count():
        return rows, None
    return rows.join(long, "key", "left_anti"), rows.join(long, "key", "left_semi")


def _by_conversation(rows: DataFrame, make: Callable[[object, list, list], list[tuple]], schema: str) -> DataFrame:
    """make(conv_id, turns, rows) for every whole conversation."""
    names = [f.split(" ")[0] for f in schema.split(", ")]
    kinds = [to_arrow_type(f.dataType) for f in T._parse_datatype_string(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def close() -> None:
            if key is not None:
                out.extend(make(held[0][0], [r[1] for r in held], [(r[2], r[3]) for r in held]))
        for batch in batches:
            for row_key, *row in zip(*(batch[c].to_pylist() for c in ("key", "conv_id", "turn", "role", "text"))):
                if row_key != key:
                    close()
                    key, held = row_key, []
                held.append(row)
            if out:
                yield _batch(out, names, kinds)
                out.clear()
        close()
        if out:
            yield _batch(out, names, kinds)
    order = ["key", F.col("turn").asc_nulls_first(), "role", "text"]
    return rows.repartition("key").sortWithinPartitions(*order).mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _kind(convs: DataFrame) -> str:
    return convs.schema["conv_id"].dataType.simpleString()


def summary(convs: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, faults, illegal neighbours, cost, audit and the digest of the repaired rows."""
    shared.prepare(convs.sparkSession)
    short, long = _split(convs)

    def make(conv_id: object, turns: list, rows: list) -> list[tuple]:
        numbers, audit, repaired = _whole(turns, rows)
        return [(conv_id, *numbers, audit, hashlib.sha256(written(repaired).encode()).hexdigest())]
    schema = f"conv_id {_kind(convs)}, {NUMBERS}, audit string, repaired_sha256 string"
    out = _by_conversation(short, make, schema)
    return out if long is None else out.unionByName(_Segments(long, _kind(convs)).summary())


def repaired(convs: DataFrame) -> DataFrame:
    """The repaired rows with their edits: conv_id, part and place (their order), edit, role, text; deletions have no role."""
    shared.prepare(convs.sparkSession)
    short, long = _split(convs)

    def make(conv_id: object, turns: list, rows: list) -> list[tuple]:
        return [(conv_id, 0, i, *row) for i, row in enumerate(_whole(turns, rows)[2])]
    schema = f"conv_id {_kind(convs)}, part long, place int, edit string, role string, text string"
    out = _by_conversation(short, make, schema)
    return out if long is None else out.unionByName(_Segments(long, _kind(convs)).rows().select(*out.columns))


class _Segments:
    """Long conversations by segments of bounded size."""

    def __init__(self, rows: DataFrame, kind: str):
        self.kind = kind
        rows = shared.staged(rows.withColumn("row_no", F.monotonically_increasing_id()), "long-rows")
        at = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row_no")
        firsts = rows.groupBy("key", "role", "text").agg(F.min(at).alias("at")).select(
            "at.row_no", F.lit(True).alias("first"))
        self.turns = rows.select("key", "turn").where("turn is not null").distinct()
        marked = rows.join(firsts, "row_no", "left").withColumn("first", F.coalesce("first", F.lit(False)))
        order = ["key", F.col("turn").asc_nulls_first(), "role", "text", "row_no"]
        self.parts = shared.staged(marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
            _cut, f"key string, conv_id {kind}, part long, n_blank long, n_duplicate long, n_truncated long, n_illegal long, "
                  "first string, last string, initials string, faults binary, costs array<int>, orders array<int>, "
                  "roles array<string>, texts array<string>"), "segments")
        self.ends = shared.staged(self.parts.select("key", "part", "first", "last", "costs", "orders").groupBy("key").applyInArrow(
            _crossed, "key string, part long, begin int, end int, is_last boolean, n_between long, cost long"), "crossings")

    def _placed(self) -> DataFrame:
        return self.parts.join(self.ends.drop("key"), "part")

    def rows(self) -> DataFrame:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            out = []
            for r in batch.to_pylist():
                out += [(r["conv_id"], r["part"], i, *row) for i, row in enumerate(_of_segment(r)[1])]
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
            return _batch(out, ["conv_id", "part", "place", "edit", "role", "text"], kinds) if out else None
        return shared.by_batch(self._placed(), run, f"conv_id {self.kind}, part long, place int, edit string, role string, "
                                                    "text string")

    def summary(self) -> DataFrame:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = []
            for r in batch.to_pylist():
                edits, rows = _of_segment(r)
                made.append((r["key"], r["part"], "".join(edits), written(rows), any(role is not None for _, role, _ in rows)))
            return _batch(made, ["key", "part", "audit", "written", "has_rows"],
                          [pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()])
        texts = shared.staged(shared.by_batch(self._placed(), run, "key string, part long, audit string, written string, has_rows boolean"),
                              "rebuilt-segments")
        digests = texts.where("has_rows").select("key", "part", "written").repartition("key").sortWithinPartitions(
            "key", "part").mapInArrow(_digested, "key string, repaired_sha256 string")
        whole = texts.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
            F.struct("part", "audit"))), lambda p: p["audit"]), "").alias("audit"))
        gaps = self.turns.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
        ends = self.ends.groupBy("key").agg(F.sum("n_between").alias("between"), F.max("cost").alias("cost"))
        sums = self.parts.groupBy("key").agg(
            F.first("conv_id").alias("conv_id"), F.sum("n_blank").alias("blank"), F.sum("n_duplicate").alias("duplicate"),
            F.sum("n_truncated").alias("truncated"), F.sum("n_illegal").alias("inside"))
        return sums.join(ends, "key").join(whole, "key").join(gaps, "key", "left").join(digests, "key", "left").select(
            "conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated",
            (F.col("inside") + F.col("between")).alias("illegal"), "cost", "audit",
            F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as segments: runs of one conversation with bounded rows and characters."""
    task, number, key, held, chars = TaskContext.get().partitionId() << 32, 0, None, [], 0

    def segment() -> pa.RecordBatch:
        initials = [initial(r[1]) for r in held]
        faults = [fault(r[2], not r[3]) for r in held]
        whole = together([of_row(*f) for f in zip(initials, faults)])
        n_illegal = sum(illegal(a[1], b[1]) for a, b in zip(held, held[1:]))
        costs, orders = zip(*[t or (-1, -1) for t in whole])
        return pa.RecordBatch.from_arrays(
            [pa.array([key]), pa.array([held[0][0]], conv_type), pa.array([task + number], pa.int64()),
             *[pa.array([n], pa.int64()) for n in (faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT_OFF), n_illegal)],
             pa.array([held[0][1]]), pa.array([held[-1][1]]), pa.array(["".join(initials)]), pa.array([bytes(faults)]),
             pa.array([costs], pa.list_(pa.int32())), pa.array([orders], pa.list_(pa.int32())),
             pa.array([[r[1] for r in held]], pa.list_(pa.string())), pa.array([[r[2] for r in held]], pa.list_(pa.string()))],
            ["key", "conv_id", "part", "n_blank", "n_duplicate", "n_truncated", "n_illegal", "first", "last", "initials",
             "faults", "costs", "orders", "roles", "texts"])
    for batch in batches:
        conv_type = batch.schema.field("conv_id").type
        for row_key, *row in zip(*(batch[c].to_pylist() for c in ("key", "conv_id", "role", "text", "first"))):
            if held and (row_key != key or len(held) >= SEGMENT_ROWS or chars >= SEGMENT_CHARS):
                yield segment()
                number, held, chars = number + 1, [], 0
            key = row_key
            held.append(row)
            chars += len(row[2])
    if held:
        yield segment()


def _crossed(table: pa.Table) -> pa.Table:
    """The states at the ends of a conversation's segments, from their transfers alone."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    transfers = [tuple(None if c < 0 else (c, o) for c, o in zip(r["costs"], r["orders"])) for r in rows]
    total, vector = over(transfers)
    end = ending(vector)
    states = path(transfers, START, end)
    cost = total + vector[end][0] + INSERT * len(CLOSING[end])
    between = [False, *(illegal(a["last"], b["first"]) for a, b in zip(rows, rows[1:]))]
    return pa.table({"key": [r["key"] for r in rows], "part": [r["part"] for r in rows],
                     "begin": pa.array([START, *states[:-1]], pa.int32()), "end": pa.array(states, pa.int32()),
                     "is_last": [i == len(rows) - 1 for i in range(len(rows))],
                     "n_between": pa.array(map(int, between), pa.int64()), "cost": pa.array([cost] * len(rows), pa.int64())})


def _of_segment(r: dict) -> tuple[list[str], list[tuple[str, str, str]]]:
    """Edits and rebuilt rows of a segment whose end states are known; the last also holds what closes."""
    edits = audits(tuple(zip(r["initials"], r["faults"])), r["begin"], r["end"])
    made = rebuilt(list(zip(r["roles"], r["texts"])), edits, r["begin"])
    return ([*edits, CLOSING[r["end"]]], made + closed(r["end"])) if r["is_last"] else (list(edits), made)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's segments, read in order as a stream."""
    key, digest, out = None, None, []
    for batch in batches:
        for row_key, text in zip(batch["key"].to_pylist(), batch["written"].to_pylist()):
            if row_key != key:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = row_key, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(text.encode())
    if key is not None:
        out.append((key, digest.hexdigest()))
    if out:
        yield _batch(out, ["key", "repaired_sha256"], [pa.string(), pa.string()])


def damaged(convs: DataFrame) -> DataFrame:
    """The rows with faults put in by a checksum of ``conv_id:turn``: dropped, emptied, marks removed, repeated, role user."""
    def plain(name: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))
    drawn = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    text = F.when(F.col("drawn") == 1, "").when(F.col("drawn") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = convs.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), drawn.alias("drawn"))
    copies = F.when(F.col("drawn") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("drawn <> 0").select(
        "conv_id", "turn", F.when(F.col("drawn") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(copies).alias("copy")).drop("copy")
