"""Conversation repair against brute force: all edits of short conversations, and a plain recursion over the table."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarryline.llm import catalog, conversations

BLANK = r"[\x20\x09-\x0D]*"
STEPS = {"0": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def fault_of(rows):
    """The first fault of each (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        last = text.strip(" \t\n\x0b\x0c\r")[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(roles, faults):
    """(cost, audit, final (role, row or None)) by states of the role before: all ways, the least kept."""
    best = {"0": (0, "", ())}

    def insert(chart):
        for _ in range(3):
            for at, (cost, audit, made) in list(chart.items()):
                for to in STEPS[at]:
                    if to in "ua" and ((v := (cost + 3, audit + "I", (*made, (to, None))))[:2] < chart.get(to, (1 << 60,))[:2]):
                        chart[to] = v
        return chart

    for k, (role, fault) in enumerate(zip(roles, faults)):
        new = {}

        def put(at, value, new=new):
            if at not in new or value[:2] < new[at][:2]:
                new[at] = value

        for at, (cost, audit, made) in insert(best).items():
            put(at, (cost + 4, audit + "D", made))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                for to in STEPS[at]:
                    if role == to:
                        put(to, (cost + more, audit + "K", (*made, (None, k))))
                    elif to in "ua":
                        put(to, (cost + 3 + more, audit + "R", (*made, (to, k))))
        best = new
    return min(v for at, v in insert(best).items() if at in "0a")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def expected(rows, hurt):
    groups = defaultdict(list)
    for conv, *rest in hurt:
        groups[conv].append(tuple(rest))
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(groups[conv], key=lambda r: (r[0] is not None, r[0] or 0))
        faults, initials = fault_of([r[1:] for r in mine]), [r[1][:1] for r in mine]
        cost, audit, made = cheapest(initials, faults)
        turns = [r[0] for r in mine if r[0] is not None]
        full = {"u": "user", "a": "assistant"}
        lines = [f"{full[to] if to else mine[k][1]}:{mine[k][2] if k is not None else ''}" for to, k in made]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def given(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def test_parser_against_all_edits():
    """Every way to delete, keep, rerole and insert, for all role orders of up to three rows."""
    whole = re.compile(r"(s?(ua)+)?")
    for n in range(4):
        for roles in itertools.product("suax", repeat=n):
            for faults in itertools.product(["", "truncated", "blank"] if n < 3 else ["", "blank"], repeat=n):
                found = None
                for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=n + 1):
                    for edits in itertools.product(*[["D"] if f == "blank" else ["D", "K", "u", "a"] for f in faults]):
                        made = "".join(g + ("" if e == "D" else r if e == "K" else e) for g, e, r in zip(gaps, (*edits, "D"), (*roles, "")))
                        if whole.fullmatch(made):
                            audit = "".join("I" * len(g) + {"D": "D", "K": "K"}.get(e, "R") for g, e in zip(gaps, edits)) + "I" * len(gaps[-1])
                            cost = sum({"I": 3, "R": 3, "D": 4, "K": 0}[x] for x in audit) + sum(3 for e, f in zip(edits, faults) if f == "truncated" and e != "D")
                            found = min(found or (cost, audit), (cost, audit))
                chart = conversations.first_set()
                for role, fault in zip(roles, faults):
                    chart = conversations.scanned(chart, role, fault)
                assert conversations.accepted(chart)[:2] == found == cheapest(roles, faults)[:2]


def test_the_table_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert given(catalog.op12_earley_repair(spark, sf)) == expected(rows, damage(rows))


ODD = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Hello!"), (1, 1, "assistant", "Hello!"), (1, None, "system", "Be kind."), (1, 5, "user", "open"),
    (2, None, None, None), (2, None, None, None), (None, 3, "assistant", "No id."), (None, 4, "tool", "x."), (3, 0, "", ""), (4, 0, "user", " \t\n"),
    (5, 1, "assistant", "a" * 70_000 + "?"), (5, 2, "user", "b."), (5, 3, "user", "b."), (5, 9, "User", "case."), (6, 0, "system", "Only."), (7, 0, "user", "one\xa0"), (7, 2, "assistant", "two.\x1c"),
]


@pytest.mark.parametrize("bits", [0, 1, 12])
def test_odd_rows_and_fragments_of_any_length(spark, monkeypatch, bits):
    monkeypatch.setattr(conversations, "FRAGMENT_BITS", bits)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in ODD], "conv_id long, turn long, role string, text string, pos string, edit int, h1 int")
    summary, lines = conversations.repair(df)
    got = given(summary.join(conversations.digests(lines).withColumnRenamed("conv_id", "d"), F.col("conv_id").eqNullSafe(F.col("d")), "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256))))
    spaced = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in ODD]
    assert got == expected(ODD, spaced)
    assert lines.where("edit <> 'I'").count() == len(ODD)


def test_empty_table_and_wholly_dropped_conversation(spark, tmp_path):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    summary, lines = conversations.repair(none)
    assert summary.count() == lines.count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "x")], none.schema).write.parquet(str(tmp_path / "conversations.parquet"))
    assert given(catalog.op12_earley_repair(spark, str(tmp_path))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_one_conversation_with_most_rows(spark, monkeypatch):
    """A conversation over many fragments equals brute force, and no fragment is longer than its bound."""
    monkeypatch.setattr(conversations, "FRAGMENT_BITS", 6)
    draw = random.Random(5)
    rows = [(1, k, draw.choice(["user", "assistant", "assistant", "system"]), f"text {draw.randint(0, 2500)}{draw.choice(['.', '!', ''])}") for k in range(3000)]
    rows += [(2 + k // 3, k % 3, "user", f"n{k}.") for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    cut = conversations.fragments(conversations.ordered(df)).selectExpr("conv_id", "size(rows) AS n", "opening").collect()
    assert max(r["n"] for r in cut) <= 64 and sum(r["conv_id"] == 1 for r in cut) >= 47 and sum(r["opening"] for r in cut) == 101
    summary, lines = conversations.repair(df)
    assert given(summary.join(conversations.digests(lines), "conv_id")) == expected(rows, rows)
