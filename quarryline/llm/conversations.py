"""Repair of conversations by an error-correcting Earley parse of their roles.

The grammar is that of a dialogue, an opening system row if any and then pairs of user and
assistant; its error productions delete a row, give it another role, or insert one without
text. A chart set holds items (production, dot), each with its least (cost, audit), where
the audit spells the edits so far. The recursion is on the left, so every item begins at
the first row and a set has a fixed number of items, however long the conversation is.

A conversation may hold most of all rows. Its rows are ordered by ranges, cut into
fragments of a bounded number of rows, and each fragment is parsed from every item that may
be alive at its first row. Fragments then join, since the least (cost, audit) of a
whole is made of such ones: an audit up to a row never begins another one up to the same
row unless they have the same edits and other costs.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm import scratch

#: log2 of the most rows of a fragment.
FRAGMENT_BITS = 12
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
INSERTED = "ua"
GRAMMAR = (("dialogue", ()), ("dialogue", ("turns",)), ("turns", ("s", "u", "a")), ("turns", ("u", "a")), ("turns", ("turns", "u", "a")))
START = "dialogue"
#: All items; a dot before a nonterminal only waits in the first set, so no fragment begins with one.
ITEMS = tuple((p, d) for p, (_, body) in enumerate(GRAMMAR) for d in range(len(body) + 1))
HEADS = {head for head, _ in GRAMMAR}

Item = tuple[int, int]
#: Least cost of an item, its audit, and its path: the audit with the role of inserted (u, a) and rerolled rows (U, A).
Value = tuple[int, str, str]
Chart = dict[Item, Value]


def _next(item: Item) -> str | None:
    body = GRAMMAR[item[0]][1]
    return body[item[1]] if item[1] < len(body) else None


def _offer(chart: Chart, item: Item, value: Value) -> bool:
    held = chart.get(item)
    if held is not None and held <= value:
        return False
    chart[item] = value
    return True


def _completed(chart: Chart) -> Chart:
    """With what finished items let others go on to: all wait in the first set at no cost."""
    agenda = [i for i in chart if _next(i) is None]
    while agenda:
        done = agenda.pop()
        head = GRAMMAR[done[0]][0]
        for p, (_, body) in enumerate(GRAMMAR):
            if body[:1] == (head,) and _offer(chart, (p, 1), chart[done]) and len(body) == 1:
                agenda.append((p, 1))
    return chart


def first_set() -> Chart:
    """The predicted items before the first row; those that wait for a nonterminal need not be held."""
    wanted, seen = [START], set()
    while wanted:
        head = wanted.pop()
        if head not in seen:
            seen.add(head)
            wanted += [b[0] for h, b in GRAMMAR if h == head and b and b[0] in HEADS]
    return {(p, 0): (0, "", "") for p, (head, body) in enumerate(GRAMMAR) if head in seen and not (body and body[0] in HEADS)}


def inserted(chart: Chart) -> Chart:
    """With what insertions reach, the cheapest first."""
    chart = dict(chart)
    agenda = [(v, i) for i, v in chart.items()]
    heapq.heapify(agenda)
    while agenda:
        value, item = heapq.heappop(agenda)
        wanted = _next(item)
        if chart[item] != value or wanted is None or wanted not in INSERTED:
            continue
        made = _completed({(item[0], item[1] + 1): (value[0] + INSERT, value[1] + "I", value[2] + wanted)})
        for i, v in made.items():
            if _offer(chart, i, v):
                heapq.heappush(agenda, (v, i))
    return chart


def scanned(chart: Chart, role: str, fault: str) -> Chart:
    """The set after one row: deleted under any item, kept where the grammar wants its role, rerolled where it wants another."""
    after: Chart = {}
    more = TRUNCATED if fault == "truncated" else 0
    for item, (cost, audit, path) in inserted(chart).items():
        wanted = _next(item)
        if wanted is not None or GRAMMAR[item[0]][0] == START:
            _offer(after, item, (cost + DELETE, audit + "D", path + "D"))
        if wanted is None or fault in ("blank", "duplicate"):
            continue
        to = (item[0], item[1] + 1)
        if wanted == role:
            _offer(after, to, (cost + more, audit + "K", path + "K"))
        elif wanted in INSERTED:
            _offer(after, to, (cost + REROLE + more, audit + "R", path + wanted.upper()))
    after = _completed(after)
    return {i: v for i, v in after.items() if _next(i) is not None or GRAMMAR[i[0]][0] == START}


def accepted(chart: Chart) -> Value:
    """The least whole parse."""
    return min(v for i, v in inserted(chart).items() if GRAMMAR[i[0]][0] == START and _next(i) is None)


#: Items that may be alive between two rows.
ALIVE = tuple(i for i in ITEMS if (GRAMMAR[i[0]][0] == START and _next(i) is None) or (_next(i) is not None and _next(i) not in HEADS))


def faults() -> tuple[Column, Column]:
    """(blank, truncated) of ``text``, apart from each other and from repeats."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return last == "", (last != "") & ~last.isin(".", "!", "?")


def ordered(rows: DataFrame) -> DataFrame:
    """(pos, conv_id, turn, role, text), a kept table: ``pos`` grows by conversation and turn, nulls first.

    Rows of one turn go by role and a hash of the text; copies of one row are split too, for
    the range has their places in the input as its last key. Null roles and texts are one space.
    """
    some = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    keys = ["conv_id", "turn", "role", "__text", "__copy"]
    placed = some.withColumns({"__text": F.xxhash64("text"), "__copy": F.monotonically_increasing_id()}).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return scratch.table(placed.select(F.monotonically_increasing_id().alias("pos"), "conv_id", "turn", "role", "text"), "turns", kept=True)


def fragments(rows: DataFrame) -> DataFrame:
    """(conv_id, first_pos, opening, rows): runs of at most 2**``FRAGMENT_BITS`` rows of a conversation in order, ``rows`` of (pos, turn, role, fault), role by its initial.

    Repeats are found by a first place for each (role, text), told apart by two hashes of 64
    bits, with partial sums before rows move.
    """
    blank, truncated = faults()
    narrow = rows.select(
        "pos", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), truncated.alias("truncated"),
        F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", F.lit("\0"), "role").alias("h2"),
    )
    first = narrow.groupBy("conv_id", "h1", "h2").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
    fault = F.when(F.col("blank"), "blank").when(F.col("new").isNull(), "duplicate").when(F.col("truncated"), "truncated").otherwise("")
    seen = narrow.join(first, "pos", "left").select("conv_id", "pos", "turn", "initial", fault.alias("fault"))
    cut = seen.groupBy("conv_id", F.shiftright("pos", FRAGMENT_BITS).alias("block")).agg(F.min("pos").alias("first_pos"), F.array_sort(F.collect_list(F.struct("pos", "turn", F.col("initial").alias("role"), "fault"))).alias("rows"))
    # A row for each fragment.
    return cut.select("conv_id", "first_pos", (F.min("first_pos").over(Window.partitionBy("conv_id")) == F.col("first_pos")).alias("opening"), "rows")


MOVES = "moves array<struct<entry:int,exit:int,cost:long,path:string>>"
COUNTS = ("blank", "duplicate", "truncated", "illegal")
LEGAL = ("su", "ua", "au")


def _ddl(df: DataFrame) -> str:
    return f"conv_id {df.schema['conv_id'].dataType.simpleString()}"


def moves(cut: DataFrame) -> DataFrame:
    """Each fragment's counts and ends, and its least (cost, path) from each item to each; an opening fragment begins with the first set."""
    schema = f"{_ddl(cut)}, first_pos long, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string, first_turn long, last_turn long, turns long, {MOVES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for first_pos, opening, rows in zip(*(b.column(n).to_pylist() for n in ("first_pos", "opening", "rows"))):
                roles, turns = [r["role"] for r in rows], [r["turn"] for r in rows if r["turn"] is not None]
                found = []
                for entry in [-1] if opening else range(len(ALIVE)):
                    chart = first_set() if opening else {ALIVE[entry]: (0, "", "")}
                    for r in rows:
                        chart = scanned(chart, r["role"], r["fault"])
                    found += [{"entry": entry, "exit": ALIVE.index(i), "cost": v[0], "path": v[2]} for i, v in chart.items()]
                count = {k: sum(r["fault"] == k for r in rows) for k in COUNTS[:3]}
                illegal = sum(x + y not in LEGAL for x, y in zip(roles, roles[1:]))
                ends = {"first_role": roles[0], "last_role": roles[-1], "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns))}
                out.append({"first_pos": first_pos, **count, "illegal": illegal, **ends, "moves": found})
            kinds = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("path", pa.string())])
            types = {"first_role": pa.string(), "last_role": pa.string(), "moves": pa.list_(kinds)}
            names = ["first_pos", *COUNTS, "first_role", "last_role", "first_turn", "last_turn", "turns", "moves"]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array([o[n] for o in out], types.get(n, pa.int64())) for n in names)], ["conv_id", *names])

    return cut.mapInArrow(run, schema)


_AUDIT = str.maketrans("uaUA", "IIRR")


class _Join:
    """Joins the fragments of one conversation: for each item alive, its cost and the place of its audit among the others."""

    def __init__(self, conv: pa.Scalar):
        self.conv, self.blocks, self.back = conv, [], []
        self.alive: dict[int, tuple[int, int]] = {-1: (0, 0)}
        self.sums, self.gaps = dict.fromkeys(COUNTS, 0), [None, None, 0]
        self.role = ""

    def add(self, f: dict) -> None:
        best: dict[int, tuple[int, int, str, int]] = {}
        for m in f["moves"]:
            if m["entry"] in self.alive:
                cost, place = self.alive[m["entry"]]
                value = (cost + m["cost"], place, m["path"].translate(_AUDIT), m["entry"])
                if m["exit"] not in best or value < best[m["exit"]]:
                    best[m["exit"]] = value
        # Audits up to one row end with a row's edit, so none begins another, and places carry on.
        order = {x: k for k, x in enumerate(sorted({v[1:3] for v in best.values()}))}
        self.alive = {to: (v[0], order[v[1:3]]) for to, v in best.items()}
        self.back.append({to: v[3] for to, v in best.items()})
        self.blocks.append(f["first_pos"])
        for k in COUNTS:
            self.sums[k] += f[k]
        if self.role is not None and len(self.blocks) > 1:
            self.sums["illegal"] += self.role + f["first_role"] not in LEGAL
        self.role = f["last_role"]
        if f["turns"]:
            low, high, n = self.gaps
            self.gaps = [f["first_turn"] if low is None else low, f["last_turn"], n + f["turns"] - (high == f["first_turn"] and high is not None)]

    def rows(self) -> Iterator[dict]:
        """Which way each fragment goes; the last one has the conversation's sums and what is inserted at its end."""
        ends = []
        for at, (cost, place) in self.alive.items():
            chart = inserted(first_set() if at < 0 else {ALIVE[at]: (0, "", "")})
            ends += [(cost + v[0], place, v[1], v[2], at) for i, v in chart.items() if GRAMMAR[i[0]][0] == START and _next(i) is None]
        cost, _, _, tail, at = min(ends)
        way = []
        for back in reversed(self.back):
            way.append((back[at], at))
            at = back[at]
        low, high, n = self.gaps
        for k, (first_pos, (entry, to)) in enumerate(zip(self.blocks, reversed(way)), 1):
            last = k == len(self.blocks)
            yield {"first_pos": first_pos, "entry": entry, "exit": to, "tail": tail if last else "", "cost": cost if last else None, "gaps": (high - low + 1 - n if n else 0) if last else None, **{c: self.sums[c] if last else None for c in COUNTS}}


def joined(parts: DataFrame) -> DataFrame:
    """(conv_id, first_pos, entry, exit, tail, cost, gaps and counts) of each fragment: a pass over the fragments in order, which holds one fragment and the ways of one conversation."""
    schema = f"{_ddl(parts)}, first_pos long, entry int, exit int, tail string, cost long, gaps long, {', '.join(f'{c} long' for c in COUNTS)}"
    kinds = {"entry": pa.int32(), "exit": pa.int32(), "tail": pa.string()}
    names = ["first_pos", "entry", "exit", "tail", "cost", "gaps", *COUNTS]

    def out(j: _Join) -> pa.RecordBatch:
        rows = list(j.rows())
        return pa.RecordBatch.from_arrays([pa.array([j.conv.as_py()] * len(rows), j.conv.type), *(pa.array([r[n] for r in rows], kinds.get(n, pa.int64())) for n in names)], ["conv_id", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            conv, columns = b.column("conv_id"), [n for n in b.schema.names if n != "conv_id"]
            for k in range(b.num_rows):
                if held is None or held.conv.as_py() != conv[k].as_py():
                    if held is not None:
                        yield out(held)
                    held = _Join(conv[k])
                held.add({n: b.column(n)[k].as_py() for n in columns})
        if held is not None:
            yield out(held)

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "first_pos").mapInArrow(run, schema)



def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(summary, lines) of conversations of (conv_id, turn, role, text).

    summary: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. lines: conv_id,
    pos, edit (K, R, D or I), role, text of every row in its order, deleted ones included, and
    of inserted ones, which have an empty text and the place of the row that they come before
    (``step`` orders them), or come last. A null conv_id is a conversation of its own; null
    roles and texts are one space, null turns come first and are no gap; rows equal in all
    columns are repeats; other columns are left out. No rows: two empty tables. Texts of any
    length are compared whole.
    """
    with scratch.passing(rows.sparkSession):
        turns = ordered(rows)
        parts = scratch.table(moves(fragments(turns)), "moves", kept=True)
        ways = scratch.table(joined(parts), "ways", kept=True)
    taken = ways.join(parts.select("first_pos", "moves"), "first_pos")
    path = F.get(F.filter("moves", lambda m: (m["entry"] == F.col("entry")) & (m["exit"] == F.col("exit"))), F.lit(0))["path"]
    taken = scratch.table(taken.select("conv_id", "first_pos", path.alias("path"), "tail", "cost", "gaps", *COUNTS), "paths", kept=True)
    whole = F.transform(F.array_sort(F.collect_list(F.struct("first_pos", F.concat("path", "tail").alias("path")))), lambda x: x["path"])
    summary = taken.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in ("gaps", *COUNTS, "cost")], F.translate(F.array_join(whole, ""), "uaUA", "IIRR").alias("audit"))
    tokens = taken.select("conv_id", "first_pos", F.posexplode(F.regexp_extract_all("path", F.lit("[ua]*[DKUA]"), F.lit(0))).alias("k", "token"))
    edits = tokens.select((F.col("first_pos") + F.col("k")).alias("pos"), F.regexp_extract("token", "^[ua]*", 0).alias("before"), F.right("token", F.lit(1)).alias("edit"))
    item = lambda edit, role, text: F.struct(edit.alias("edit"), role.alias("role"), text.alias("text"))
    added = lambda letters: F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), lambda c: item(F.lit("I"), F.when(c == "u", "user").otherwise("assistant"), F.lit("")))
    role = F.when(F.col("edit") == "U", "user").when(F.col("edit") == "A", "assistant").otherwise(F.col("role"))
    own = F.array(item(F.translate("edit", "UA", "RR"), role, F.col("text")))
    inside = turns.join(edits, "pos").select("conv_id", "pos", F.posexplode(F.concat(added(F.col("before")), own)).alias("step", "line"))
    after = taken.where("tail <> ''").select("conv_id", F.lit((1 << 63) - 1).alias("pos"), F.posexplode(added(F.col("tail"))).alias("step", "line"))
    return summary, inside.unionByName(after).select("conv_id", "pos", "step", "line.*")


def digests(lines: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the digest of ``role:text`` of the lines that stay, in order, joined by line feeds; no text of a conversation is held but one line's."""
    kept = lines.where("edit <> 'D'").select("conv_id", "pos", "step", F.concat("role", F.lit(":"), "text").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([conv.as_py()], conv.type), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])
        for b in batches:
            ids, texts = b.column("conv_id"), b.column("line")
            for k in range(b.num_rows):
                if state is not None and conv.as_py() == ids[k].as_py():
                    state.update(b"\n")
                else:
                    if state is not None:
                        yield row()
                    conv, state = ids[k], hashlib.sha256()
                state.update(texts[k].as_py().encode())
        if state is not None:
            yield row()

    return kept.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "step").mapInArrow(run, f"{_ddl(lines)}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the damage that repairs are tried on, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row, 1 empties its text, 2 takes the ends of sentences out of it, 3 repeats
    the row, 4 makes it the user's. A null counts as one space.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20))
    hit = rows.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("__kind")).where(F.col("__kind") != 0)
    text = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("__kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return hit.select("conv_id", "turn", F.when(F.col("__kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("__copy")).drop("__copy")
