"""Conversation repair against all edit sequences, and whole-string dynamic programming."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from threatlens.llm import catalogue, conversations, shared

LEGAL = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"
TEXTS = ["Fine.", "Fine.", "Cut off here", "", " \n", "Why?", "no end \n", "Yes!  ", "çé 中文.", "Other."]
ROLES = ["user", "assistant", "system", "tool", "", " ", "User", "ua"]


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        held = text.strip(WHITE)
        out.append("blank" if not held else "duplicate" if (role, text) in seen else "" if held[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def every_edit(rows):
    """The cheapest audit, first in order, among all sequences with at most two insertions at each place."""
    found, marks = [], faults(rows)
    inserts = [()] + [(r,) for r in "ua"] + list(product("ua", repeat=2))
    ways = []
    for (role, _), mark in zip(rows, marks):
        if mark in ("blank", "duplicate"):
            ways.append([("D", 3, "")])
            continue
        more = int(mark == "truncated")
        ways.append([("D", 3, ""), ("R", 2 + more, "u"), ("R", 2 + more, "a"), ("K", more, role[:1] or "?")])
    for placed in product(inserts, repeat=len(rows) + 1):
        for chosen in product(*ways):
            initials, audit, cost = "", "", 0
            for some, way in zip(placed, [*chosen, None]):
                initials, audit, cost = initials + "".join(some), audit + "I" * len(some), cost + 2 * len(some)
                if way:
                    audit, cost, initials = audit + way[0], cost + way[1], initials + way[2]
            if LEGAL.fullmatch(initials):
                found.append((cost, audit))
    return min(found)


def by_strings(rows):
    """The same from one table of whole audits per state."""
    kept = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    nexts = {0: 2, 1: 2, 3: 2, 2: 3}

    def inserted(best):
        out = dict(best)
        for _ in range(3):
            for state, (cost, audit) in list(out.items()):
                way = (cost + 2, audit + "I")
                if nexts[state] not in out or way < out[nexts[state]]:
                    out[nexts[state]] = way
        return out
    best = {0: (0, "")}
    for (role, _), mark in zip(rows, faults(rows)):
        new = {}

        def take(state, way):
            if state not in new or way < new[state]:
                new[state] = way
        for state, (cost, audit) in inserted(best).items():
            take(state, (cost + 3, audit + "D"))
            if mark in ("", "truncated"):
                more = int(mark == "truncated")
                take(nexts[state], (cost + 2 + more, audit + "R"))
                if state in kept.get(role[:1], {}):
                    take(kept[role[:1]][state], (cost + more, audit + "K"))
        best = new
    return min(way for state, way in inserted(best).items() if state in (0, 3))


def replayed(rows, audit):
    """The repaired lines that an audit stands for."""
    left, out, last = list(rows), [], ""
    for letter in audit:
        if letter == "D":
            left.pop(0)
            continue
        role = "assistant" if last == "u" else "user"
        if letter == "K":
            role, text = left.pop(0)
        else:
            text = "" if letter == "I" else left.pop(0)[1]
        out.append(f"{role}:{text}")
        last = role[0]
    assert not left and LEGAL.fullmatch("".join(x[0] for x in out))
    return "\n".join(out)


def expected(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of (turn, role, text) rows in order."""
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [(role, text) for _, role, text in rows]
    marks = faults(pairs)
    cost, audit = by_strings(pairs)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(marks.count(m) for m in ("blank", "duplicate", "truncated")),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:])), cost, audit,
            hashlib.sha256(replayed(pairs, audit).encode()).hexdigest())


def in_order(rows):
    return sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def test_least_audit_of_all_edits():
    draw = random.Random(1)
    for n in (0, 1, 2, 3, 3):
        for _ in range(40 if n < 3 else 25):
            rows = [(draw.choice(ROLES), draw.choice(TEXTS)) for _ in range(n)]
            best = every_edit(rows)
            numbers, audit, made = conversations._whole([None] * n, rows)
            assert (numbers[-1], audit) == best == by_strings(rows), rows
            assert conversations.written(made) == replayed(rows, audit)


def test_halves_meet_at_the_best_crossing():
    draw = random.Random(2)
    for _ in range(400):
        rows = [(draw.choice(ROLES[:4]), draw.choice(TEXTS) + draw.choice(["", str(draw.random()), "1."]))
                for _ in range(draw.randrange(1, 90))]
        numbers, audit, _ = conversations._whole([None] * len(rows), rows)
        assert (numbers[-1], audit) == by_strings(rows)


def test_segments_compose():
    """Transfers of runs lead to the same audits as single rows, wherever the cuts are."""
    draw = random.Random(3)
    for _ in range(200):
        found = [(draw.choice("sua?"), draw.choice([0, 0, 1, 2, 3])) for _ in range(draw.randrange(1, 60))]
        rows = [conversations.of_row(*f) for f in found]
        total, vector = conversations.over(rows)
        end = conversations.ending(vector)
        cuts = sorted({0, len(rows), *(draw.randrange(len(rows) + 1) for _ in range(5))})
        runs = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
        transfers = [conversations.together(run) for run in runs]
        whole, last = conversations.over(transfers)
        assert (whole + last[end][0], conversations.ending(last)) == (total + vector[end][0], end)
        states = conversations.path(transfers, 0, end)
        audit = [x for a, b, p, q in zip(cuts, cuts[1:], [0, *states], states) for x in conversations.audits(tuple(found[a:b]), p, q)]
        assert audit == list(conversations.audits(tuple(found), 0, end))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Conversations with ties, repeats, gaps, nulls in every column and a long one that holds a third of all rows."""
    draw = random.Random(4)
    rows = []
    for conv in range(60):
        for turn in range(draw.randrange(1, 12)):
            for _ in range(draw.choice([1, 1, 1, 2])):
                rows.append((conv, draw.choice([turn, turn, turn + 2, None]), draw.choice([*ROLES, None]), draw.choice([*TEXTS, None])))
    rows += [(None, t, draw.choice(ROLES), draw.choice(TEXTS)) for t in range(9)]
    rows += [(99, t if t % 7 else None, draw.choice(ROLES[:4]), f"{draw.choice(TEXTS)} {draw.randrange(150)}.") for t in range(250)]
    rows += [(98, None, "user", "the same.")] * 40
    path = str(tmp_path_factory.mktemp("conversations") / "rows.parquet")
    spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, part int") \
        .repartition(3).write.parquet(path)
    return shared.prepare(spark).read.parquet(path), rows


def by_conversation(rows):
    out = {}
    for conv, *row in rows:
        out.setdefault(conv, []).append(row)
    return {conv: in_order(some) for conv, some in out.items()}


@pytest.mark.parametrize("limits", [{}, {"LONG": 8, "SEGMENT_ROWS": 5}, {"LONG": 0, "SEGMENT_ROWS": 1}, {"LONG": 30, "SEGMENT_CHARS": 40}])
def test_summary_equals_brute_force(made, monkeypatch, limits, keys):
    for name, value in limits.items():
        monkeypatch.setattr(conversations, name, value)
    docs, rows = made
    found = keys([tuple(r) for r in conversations.summary(docs).collect()])
    assert found == keys([(conv, *expected(some)) for conv, some in by_conversation(rows).items()])


@pytest.mark.parametrize("long", [100_000, 0])
def test_repaired_rows(made, monkeypatch, long):
    monkeypatch.setattr(conversations, "LONG", long)
    monkeypatch.setattr(conversations, "SEGMENT_ROWS", 7)
    docs, rows = made
    held = {}
    for r in sorted(conversations.repaired(docs).collect(), key=lambda r: (r.part, r.place)):
        held.setdefault(r.conv_id, []).append(r)
    for conv, some in by_conversation(rows).items():
        audit = expected(some)[6]
        assert "".join(r.edit for r in held.get(conv, [])) == audit
        assert "\n".join(f"{r.role}:{r.text}" for r in held.get(conv, []) if r.role is not None) == replayed(
            [r[1:] for r in some], audit)


def brute_damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


@pytest.mark.parametrize("name", ["made", "given"])
def test_query_equals_brute_force(spark, made, tmp_path, keys, name):
    sf_dir = "/root/testdata/sf0.001"
    if name == "made":
        sf_dir = str(tmp_path)
        made[0].write.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    left = by_conversation(brute_damaged(rows))
    found = keys([tuple(r) for r in catalogue.QUERIES["op11_conversation_repair"](spark, sf_dir).collect()])
    assert found == keys([(conv, *expected(left.get(conv, []))) for conv in {r[0] for r in rows}])


def test_empty_table(made):
    none = made[0].limit(0)
    assert conversations.summary(none).count() == 0 == conversations.repaired(none).count()
    assert conversations.damaged(none).count() == 0
