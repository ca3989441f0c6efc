"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Everything is a column expression over one row, so a scan needs no shuffle. Positions
are code points, ends exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm import layout

# The base kinds in their order, with their patterns. A maximal run of
# hex digits or of access-key characters that is too short cannot hold a longer one, so
# the least length stands in the pattern; an assigned value is checked after matching.
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
LEAST_ASSIGNED = 6
#: Hits whose places are summed in one fold.
BLOCK = 128

#: Strings that may be secrets: long runs without white space, of one of three classes.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
HEX_CLASS, ALNUM_CLASS = r"^(?:[0-9a-f]+|[0-9A-F]+)$", r"^[A-Za-z0-9]+$"
#: Harmless parts of strings: placeholders, alphabets, repeats.
HARMLESS = r"(?:(?i:example|sample|dummy|placeholder|changeme|redacted)|(?i:abcdefghij|0123456789|9876543210)|(.{1,4})\1{4,})"
#: Harmless high-entropy strings: UUIDs, digits with separators, plain words and paths of
#: words, and strings of which every 20 characters touch a harmless part.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9+/_=-]+$",
    r"^[A-Za-z+/_=-]+$",
    r"^(?>.{0,19}?" + HARMLESS + r")++.{0,19}$",
)


@dataclass(frozen=True)
class Entropy:
    """Bits per character that a window of ``window`` characters must reach, by class."""

    window: int = 20
    least: dict[str, float] = field(default_factory=lambda: {"hex": 3.0, "alnum": 3.5, "base64": 3.7})
    allowed: tuple[str, ...] = ALLOWED


def _starts(text: Column, hits: Column, pattern: str) -> Column:
    """The start of each of ``hits``, the pattern's matches: what lies between them is what split() leaves.

    Sums run inside blocks of ``BLOCK`` hits and over the blocks' sums: one fold over all
    hits would copy what it has gathered at every step.
    """
    empty = F.array().cast("array<int>")
    far = lambda x: x["gap"] + x["hit"]
    steps = lambda v: F.transform(hits, lambda h, i: F.struct(F.length(F.get(v["gaps"], i)).alias("gap"), F.length(h).alias("hit")))
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / BLOCK).cast("int")), lambda b: F.slice(v["steps"], b * BLOCK + 1, BLOCK))
    first = lambda v: F.aggregate(
        F.transform(v["blocks"], lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + far(x))),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
        lambda s: s["out"],
    )
    within = lambda block, at: F.aggregate(
        block,
        F.struct(at.alias("at"), empty.alias("out")),
        lambda s, x: F.struct((s["at"] + far(x)).alias("at"), F.concat(s["out"], F.array(s["at"] + x["gap"])).alias("out")),
        lambda s: s["out"],
    )
    placed = lambda v: F.flatten(F.transform(v["blocks"], lambda block, b: within(block, F.get(v["first"], b))))
    started = lambda v: layout.bound(placed, blocks=v["blocks"], first=first(v))
    cut = lambda v: layout.bound(started, blocks=blocks(v))
    stepped = lambda v: layout.bound(cut, steps=steps(v))
    return F.when(F.size(hits) > 0, layout.bound(stepped, gaps=F.split(text, pattern, -1))).otherwise(empty)


def _span(kind: int, start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(kind).alias("rank"), end.cast("int").alias("end"), F.lit(KINDS[kind]).alias("kind"))


def _loud(s: Column, rule: Entropy) -> Column:
    """(from, to) of the windows of ``s`` that reach their class's bits, else nulls.

    The fold keeps the window's counts by character and the sum of n*log2(n); a step
    changes the two counts of the character that enters and the one that leaves.
    """
    w = rule.window
    least = F.when(s.rlike(HEX_CLASS), rule.least["hex"]).when(s.rlike(ALNUM_CLASS), rule.least["alnum"]).otherwise(rule.least["base64"])
    term = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(w + 2)])

    def step(v: Column, state: Column, i: Column) -> Column:
        new, old = F.get(v["codes"], i), F.when(i >= w, F.get(v["codes"], i - w))
        n_new = F.get(state["n"], new)
        n_old = F.get(state["n"], old) + F.when(new == old, 1).otherwise(0)
        total = state["sum"] + F.get(term, n_new + 1) - F.get(term, n_new) + F.coalesce(F.get(term, n_old - 1) - F.get(term, n_old), F.lit(0.0))
        counts = F.transform(state["n"], lambda n, k: n + F.when(k == new, 1).otherwise(0) - F.when(k == old, 1).otherwise(0))
        hit = (i >= w - 1) & (F.lit(math.log2(w)) - total / w >= v["least"])
        return F.struct(
            counts.alias("n"), total.alias("sum"),
            F.when(hit, F.least(state["lo"], i - (w - 1))).otherwise(state["lo"]).alias("lo"),
            F.when(hit, F.greatest(state["hi"], i + 1)).otherwise(state["hi"]).alias("hi"),
        )

    empty = F.struct(F.array_repeat(F.lit(0), 128).alias("n"), F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))
    fold = lambda v: F.aggregate(F.sequence(F.lit(0), F.size(v["codes"]) - 1), empty, lambda state, i: step(v, state, i), lambda state: F.struct(state["lo"].alias("lo"), state["hi"].alias("hi")))
    return layout.bound(fold, codes=F.transform(F.split(s, ""), lambda ch: F.ascii(ch)), least=least)


def find_secrets(docs: DataFrame, rule: Entropy = Entropy(), text: str = "text", out: str = "findings") -> DataFrame:
    """All rows and columns of ``docs`` with ``out``: array of (start, rank, end, kind), by start, then kind.

    Kinds: assign, access, hex, the leftmost non-overlapping matches of the patterns
    above, and entropy: the part of a candidate string covered by windows of enough
    Shannon entropy for its character class, unless an allow-list pattern fits it. A
    harmless part inside a candidate doesn't hide what stands a window away from it. The
    kinds do not suppress each other.

    A null or empty text has no findings; texts of any length are scanned whole. Rows
    are independent: repeats repeat their findings. A column called ``out`` is replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    hits = docs.withColumns(
        {
            "__ss_assign": F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(0)),
            "__ss_access": F.regexp_extract_all(t, F.lit(ACCESS), F.lit(0)),
            "__ss_hex": F.regexp_extract_all(t, F.lit(HEX), F.lit(0)),
            "__ss_entropy": F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)),
        }
    )
    values = F.when(F.size("__ss_assign") > 0, F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)))
    zipped = lambda kind, pattern: F.arrays_zip(F.col(f"__ss_{kind}").alias("hit"), _starts(t, F.col(f"__ss_{kind}"), pattern).alias("at"))
    placed = hits.withColumns({"__ss_value": values, **{f"__ss_{k}_at": zipped(k, p) for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE), strict=True)}})
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    base = []
    whole = lambda n: lambda x: _span(n, x["at"], x["at"] + F.length(x["hit"]))
    for n, kind in enumerate(KINDS[:3]):
        spans = F.transform(f"__ss_{kind}_at", whole(n))
        if kind == "assign":
            # Bound, for a lambda that names a column may be given the column's whole expression.
            long = lambda v: F.filter(v["spans"], lambda s, i: F.length(F.get(v["values"], i)) >= LEAST_ASSIGNED)
            spans = layout.bound(long, spans=spans, values=F.col("__ss_value"))
        base.append(F.when(F.size(f"__ss_{kind}") > 0, spans).otherwise(none))
    suspect = lambda s: ~F.exists(F.array(*[F.lit(p) for p in rule.allowed]), lambda p: F.regexp_like(s, p))
    candidates = F.filter("__ss_entropy_at", lambda x: suspect(x["hit"]))
    loud = F.filter(F.transform(candidates, lambda x: F.struct(x["at"].alias("at"), _loud(x["hit"], rule).alias("w"))), lambda x: x["w"]["lo"].isNotNull())
    entropy = F.when(F.size("__ss_entropy") > 0, F.transform(loud, lambda x: _span(3, x["at"] + x["w"]["lo"], x["at"] + x["w"]["hi"]))).otherwise(none)
    out_col = F.array_sort(F.concat(*base, entropy))
    return placed.withColumn(out, out_col).drop(*[f"__ss_{k}{x}" for k in KINDS for x in ("", "_at")], "__ss_value")


def spans_text(findings: Column) -> Column:
    """kind:start:end of each finding, comma-joined."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", findings: str = "findings", mark: str = "[secret]") -> DataFrame:
    """The texts with each found span, overlapping ones together, replaced by ``mark``.

    Texts without findings, null and empty ones stay; rows are independent, repeats give
    repeats; an empty table stays empty; other columns stay as they are.
    """
    cut = F.aggregate(
        findings,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, f: F.struct(
            F.when(f["start"] >= s["at"], F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, f["start"] - s["at"]), F.lit(mark))).otherwise(s["out"]).alias("out"),
            F.greatest(s["at"], f["end"]).alias("at"),
        ),
        lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.length(text))),
    )
    return docs.withColumn(text, F.when(F.size(findings) > 0, cut).otherwise(F.col(text)))
