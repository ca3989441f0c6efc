"""Line dedup: a segment-partition edit join over all lines, in DataFrame functions only.

After Li, Deng, Wang and Feng, "Pass-Join" (2011). A line within ``edits`` of another has
one of that line's ``edits + 1`` segments as a substring near the segment's place, so
segments of each length are indexed, and only the few substrings that can match are
probed. Found pairs are verified by a banded bit-parallel edit distance.

Groups of like lines are never listed pair by pair: a line first meets the least line
of each index entry that it hits; what that leaves unjoined is compared across
components only. Where a segment is frequent on both sides, what the lines hold besides it
is cut into segments again, and so on, so such lines meet only by what they share further.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm import layout, scratch
from quarryline.llm.components import components

#: Lines count as one with at most one edit for each full ``PER_EDIT`` characters of the shorter, and at most ``EDITS``.
EDITS, PER_EDIT = 2, 12
#: A line with more than this part of all rows has its repeats set aside first; there are fewer than 1 / HOT such lines.
HOT = 0.001
#: A key that more lines than this have, of those indexed and of those that probe it, is split further.
FREQUENT = 32
#: Letters that are counted, to leave out pairs that no few edits can make equal.
COUNTED = "etaoinsrhldum, E"


def wide(line: Column) -> Column:
    """Four bytes a character: any stretch of such a line is cut without going through what stands before it."""
    return F.encode(line, "UTF-32")


def widened(lines: DataFrame) -> DataFrame:
    """(h, line, n): wide lines and their lengths, columns of their own since they are used many times."""
    return lines.select("h", wide(F.col("line")).alias("line")).withColumn("n", (F.octet_length("line") / 4).cast("int"))


def _cut(wide_line: Column, start: Column, size: Column) -> Column:
    """``size`` characters from ``start`` (from 0) on."""
    return F.substring(wide_line, start * 4 + 1, size * 4)


def allowed(length: Column, edits: int = EDITS, per_edit: int = PER_EDIT) -> Column:
    """The edits that a line of so many characters may take."""
    return F.least(F.lit(edits), F.floor(length / per_edit)).cast("int")


def _looked(rows: DataFrame, looks: list[tuple[int, int, int, int]], applies: Column) -> DataFrame:
    """``rows`` of wide lines (line, n) with each of ``looks`` (t, d, i, shift) that ``applies`` and lies inside; adds ``at``, ``size`` and ``short``.

    Lines of t edits have t + 1 segments of near-equal length, the longer ones last. A look
    stands for segment i of a line shorter by d, sought ``shift`` places off; ``short`` is
    the length of that line. Looks are rows of a constant, so that one short expression
    makes all of them.
    """
    each = rows.select("*", F.inline(F.array(*[F.struct(*[F.lit(x).alias(name) for name, x in zip(("t", "d", "i", "shift"), look, strict=True)]) for look in looks])))
    each = each.where(applies).withColumn("short", F.col("n") - F.col("d"))
    parts, i = F.col("t") + 1, F.col("i")
    part, shorter = F.floor(F.col("short") / parts).cast("int"), parts - F.pmod("short", parts)
    bounds = {"size": part + F.when(i >= shorter, 1).otherwise(0), "at": part * i + F.greatest(F.lit(0), i - shorter) + F.col("shift")}
    return each.withColumns(bounds).where((F.col("at") >= 0) & (F.col("at") + F.col("size") <= F.col("n")))


def _segment_key() -> Column:
    return F.xxhash64("i", "short", _cut(F.col("line"), F.col("at"), F.col("size")))


def _index_looks(edits: int) -> list[tuple[int, int, int, int]]:
    return [(t, 0, i, 0) for t in range(1, edits + 1) for i in range(t + 1)]


def _probe_looks(edits: int) -> list[tuple[int, int, int, int]]:
    """Segment i of a line shorter by d starts at most i places, and at most ``t - i`` places beyond d, from where it stands in the
    probing line, t being the edits that the shorter line may take: edits before and after it add up."""
    shifts = lambda t, d, i: range(max(-i, d - (t - i)), min(i, d + (t - i)) + 1)
    return [(t, d, i, s) for t in range(1, edits + 1) for d in range(t + 1) for i in range(t + 1) for s in shifts(t, d, i)]


def _may_take(edits: int, per_edit: int) -> Column:
    return allowed(F.col("n") - F.col("d"), edits, per_edit) == F.col("t")


def index_keys(lines: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """(h, key): one key for each segment of each line (h, line, n): its number, the line's length and the segment."""
    return _looked(lines, _index_looks(edits), _may_take(edits, per_edit)).select("h", _segment_key().alias("key"))


def probe_keys(lines: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT) -> DataFrame:
    """(h, key): the keys of lines of the same length or shorter that each line may be near to."""
    return _looked(lines, _probe_looks(edits), _may_take(edits, per_edit)).select("h", _segment_key().alias("key"))


def _common(a: Column, b: Column, most: Column, start: Callable[[Column, Column, Column], Column]) -> Column:
    """How many characters, ``most`` at the utmost, ``a`` and ``b`` share from one end on, found by halving stretches.

    ``start(line, done, size)`` is where the next ``size`` characters begin after ``done``.
    """
    halves = F.transform(F.sequence(F.floor(F.log2(F.greatest(most, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    same = lambda n, w: _cut(a, start(a, n, w), w) == _cut(b, start(b, n, w), w)
    return F.aggregate(halves, F.lit(0), lambda n, w: F.when((n + w <= most) & same(n, w), n + w).otherwise(n))


def _cores(a: Column, b: Column, keep: int, build: Callable[[Column], Column]) -> Column:
    """``build(v)`` of v.pattern and v.text, the characters of wide lines ``a`` and ``b`` without what they share at their ends, after ``keep`` equal ones."""
    size = lambda line: (F.octet_length(line) / 4).cast("int")
    letters = lambda line, v: F.split(F.concat(F.lit(" " * keep), F.decode(_cut(line, v["head"], size(line) - v["head"] - v["tail"]), "UTF-32")), "")
    tails = lambda v: _common(v["a"], v["b"], v["least"] - v["head"], lambda line, n, w: size(line) - n - w)
    heads = lambda v: _common(v["a"], v["b"], v["least"], lambda line, n, w: n)
    cut = lambda v: layout.bound(build, pattern=letters(v["a"], v), text=letters(v["b"], v))
    tailed = lambda v: layout.bound(cut, a=v["a"], b=v["b"], head=v["head"], tail=tails(v))
    headed = lambda v: layout.bound(tailed, a=v["a"], b=v["b"], least=v["least"], head=heads(v))
    return layout.bound(headed, a=a, b=b, least=F.least(size(a), size(b)))


def edit_distance_within(a: Column, b: Column, edits: int = EDITS, most: Column | None = None) -> Column:
    """True if ``a`` becomes ``b`` by at most ``most`` (default and limit: ``edits``) insertions, deletions and replacements of characters.

    What the lines share at their ends is left out. Then Hyyrö's banded form of Myers'
    bit vectors: of each column of the distance matrix only the ``2 * edits + 1`` rows
    about the diagonal are kept, as bits of two longs that mark rises and falls; the
    distance is followed down the diagonal, then along the last row. On the diagonal it
    never falls, and along the last row by ``2 * edits`` at most, so one that has risen
    above three times ``edits`` is given up.
    """
    width = 2 * edits + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    bit = lambda x: F.lit(x).cast("long")
    cut = lambda x: x.bitwiseAND(bit(full))

    def step(v: Column, s: Column, j: Column) -> Column:
        equal, m = bit(0), v["m"]
        for k in range(width):
            row = j + (k - edits)
            equal = equal + F.when((row >= 0) & (row < m) & (F.get(v["pattern"], row) == F.get(v["text"], j)), bit(1 << k)).otherwise(bit(0))
        # Each value is bound before it is used again, for a lambda has no shared subexpressions.
        moved_on = layout.bound(lambda e: advance(e, s, j - (m - edits)), equal=equal, up=s["up"], down=s["down"])
        return F.when(s["far"] > 3 * edits, s).otherwise(moved_on)

    def advance(e: Column, s: Column, last: Column) -> Column:
        """``last`` counts from 0 once the band's top has come to the last row, so many bits above it."""
        up, down, equal = e["up"], e["down"], e["equal"]
        diagonal = cut((equal.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(equal).bitwiseOR(down))
        return layout.bound(lambda d: moved(d, up, down, s, last), diagonal=diagonal)

    def moved(d: Column, up: Column, down: Column, s: Column, last: Column) -> Column:
        diagonal = d["diagonal"]
        rises, falls = cut(down.bitwiseOR(F.bitwise_not(diagonal.bitwiseOR(up)))), diagonal.bitwiseAND(up)
        return layout.bound(lambda h: following(h, diagonal, s, last), rises=rises, falls=falls, shifted=F.shiftright(diagonal, 1))

    def following(h: Column, diagonal: Column, s: Column, last: Column) -> Column:
        rises, falls, shifted = h["rises"], h["falls"], h["shifted"]
        row = F.call_function("shiftright", bit(top >> 1), last.cast("int"))
        marked = lambda x, at: F.when(x.bitwiseAND(at) != 0, 1).otherwise(0)
        far = F.when(last < 0, 1 - marked(diagonal, bit(top))).otherwise(marked(rises, row) - marked(falls, row))
        return F.struct(
            cut(falls.bitwiseOR(F.bitwise_not(shifted.bitwiseOR(rises)))).alias("up"),
            shifted.bitwiseAND(rises).alias("down"),
            (s["far"] + far).cast("int").alias("far"),
        )

    start = F.struct(bit(((1 << (edits + 1)) - 1) << edits).alias("up"), bit(0).alias("down"), F.lit(edits).alias("far"))
    fold = lambda v: F.aggregate(F.sequence(F.lit(0), v["n"] - 1), start, lambda s, j: step(v, s, j), lambda s: s["far"])
    # The equal characters in front make either side longer than the band's reach.
    sized = lambda v: layout.bound(fold, pattern=v["pattern"], text=v["text"], m=F.size(v["pattern"]), n=F.size(v["text"]))
    far = _cores(wide(a), wide(b), edits + 1, sized)
    return F.when(F.abs(F.length(a) - F.length(b)) > edits, False).otherwise(far <= (F.lit(edits) if most is None else most))


def _counted(lines: DataFrame) -> DataFrame:
    """Adds how often each of some letters stands in the line, a column each."""
    count = lambda x: (F.length("line") - F.length(F.replace("line", F.lit(x)))).cast("int")
    return lines.withColumns({f"c{i}": count(x) for i, x in enumerate(COUNTED)})


def _side(df: DataFrame, name: str) -> DataFrame:
    """The counts renamed, so that two sides can be joined."""
    return df.withColumnsRenamed({f"c{i}": f"{name}{i}" for i in range(len(COUNTED))})


def _alike(edits: int) -> Column:
    """Of sides x and y: an edit changes two counts at most, by one each, so near lines pass; most others don't."""
    apart = F.lit(0)
    for i in range(len(COUNTED)):
        apart = apart + F.abs(F.col(f"x{i}") - F.col(f"y{i}"))
    return apart <= 2 * edits


def _near(pairs: DataFrame, lines: DataFrame, edits: int, per_edit: int) -> DataFrame:
    """The pairs (a, b) of hashes whose lines are within the edits that the shorter may take."""
    left = pairs.join(_side(lines, "x").withColumnsRenamed({"h": "a", "line": "line_a"}), "a")
    right = _side(lines, "y").withColumnsRenamed({"h": "__b", "line": "line_b"})
    both = left.join(right, (F.col("b") == F.col("__b")) & _alike(edits)).select("a", "b", "line_a", "line_b")
    most = allowed(F.least(F.length("line_a"), F.length("line_b")), edits, per_edit)
    return both.where(edit_distance_within(F.col("line_a"), F.col("line_b"), edits, most)).select("a", "b")


def _without(line: Column, cuts: Column) -> Column:
    """A wide line without the stretches ``cuts`` (at, size), each taken out of what the ones before it left."""
    return F.aggregate(cuts, line, lambda rest, c: F.concat(_cut(rest, F.lit(0), c["at"]), F.substring(rest, (c["at"] + c["size"]) * 4 + 1, F.lit(2**31 - 1))))


def _level(rows: DataFrame, edits: int, applies: Column, probing: bool, key: Column) -> DataFrame:
    """One side's keys of what is left of each line, with what tells whether a key is needed.

    ``lead`` and ``tail`` stand for the first and the last segment's length of characters,
    ``apart`` holds those of all levels in which lines that meet by the key have to differ, ``left`` is what the shorter line has besides the segment.
    """
    at = _looked(rows, _probe_looks(edits) if probing else _index_looks(edits), applies)
    parts = F.col("t") + 1
    first = F.floor(F.col("short") / parts).cast("int")
    last = first + F.when(F.pmod("short", parts) > 0, 1).otherwise(0)
    cuts = F.concat("cuts", F.array(F.struct("at", "size")))
    lead, tail, i = F.xxhash64(_cut(F.col("line"), F.lit(0), first)), F.xxhash64(_cut(F.col("line"), F.col("n") - last, last)), F.col("i")
    apart = F.concat("apart", F.when(i == 0, F.array().cast("array<bigint>")).when(i == F.col("t"), F.array(lead)).otherwise(F.array(lead, tail)))
    named = {"lead": lead, "tail": tail, "cuts": cuts, "apart": apart, "left": F.col("short") - F.col("size")}
    rest = F.xxhash64(_without(F.col("line"), F.array(F.struct("at", "size"))))
    return at.select("h", "component", F.lit(probing).alias("probing"), key.alias("key"), "t", "d", "i", rest.alias("rest"), *[x.alias(name) for name, x in named.items()])


def _split(lines: DataFrame, frequent: DataFrame, edits: int, per_edit: int) -> tuple[DataFrame, DataFrame]:
    """(key, probing, h, component, apart) of finer keys in place of those of ``frequent`` (key), and (key) of those that stay frequent.

    ``lines`` is (h, line, n, component). Two near lines that share a segment, untouched by
    their edits, are without it as near as before, so what is left has an untouched segment
    in its turn; that and all before it make up the finer key. Lines that have equal first
    segments are as near without them, and the same holds for last segments. So a key of
    another segment is needed only for lines that differ in the first, and a key of one in
    the middle only for lines that differ in the last, too: keys all of whose lines agree
    there are left out, and ``apart`` keeps single pairs from meeting there. It ends where so little is left that its parts would be empty.
    """
    none = lines.withColumns({"cuts": F.array().cast("array<struct<at:int,size:int>>"), "apart": F.array().cast("array<bigint>")})
    fits = _may_take(edits, per_edit)
    sides = [_level(none, edits, fits, probing, _segment_key()) for probing in (False, True)]
    rows = sides[0].union(sides[1]).join(frequent, "key", "left_semi")
    found = []
    while True:
        rows = scratch.table(rows.dropDuplicates(["key", "probing", "h", "rest"]), "line-split")
        many = F.least(F.count_if("probing"), F.count_if(~F.col("probing")))
        ends = [f(c).alias(f"{name}_{c}") for c in ("lead", "tail", "component") for name, f in (("lo", F.min), ("hi", F.max))]
        sizes = rows.groupBy("key").agg(*ends, many.alias("many"), F.max("i").alias("i"), F.max("t").alias("t"), F.max("left").alias("left"))
        differ = lambda c: F.col(f"lo_{c}") != F.col(f"hi_{c}")
        needed = (F.col("many") > 0) & differ("component") & ((F.col("i") == 0) | differ("lead")) & ((F.col("i") == 0) | (F.col("i") == F.col("t")) | differ("tail"))
        keys = scratch.table(sizes.where(needed).select("key", (F.col("many") > FREQUENT).alias("again"), (F.col("left") > F.col("t")).alias("more")), "line-split-keys")
        found.append((rows.join(keys.where("not (again and more)"), "key", "left_semi"), keys.where("again and not more").select("key")))
        deeper = keys.where("again and more")
        if deeper.isEmpty():
            return tuple(reduce(DataFrame.union, side) for side in ([r.select("key", "probing", "h", "component", "apart").distinct() for r, _ in found], [k for _, k in found]))
        on = rows.join(deeper, "key", "left_semi").select("h", "component", "probing", F.col("key").alias("above"), F.col("t").alias("__t"), F.col("d").alias("__d"), "cuts", "apart")
        on = on.join(lines.select("h", "line"), "h").withColumn("line", _without(F.col("line"), F.col("cuts"))).withColumn("n", (F.octet_length("line") / 4).cast("int"))
        same = lambda d: (F.col("t") == F.col("__t")) & (d == F.col("__d"))
        finer = F.xxhash64("above", _segment_key())
        rows = _level(on.where("not probing").drop("probing"), edits, same(F.col("d")), False, finer).union(_level(on.where("probing").drop("probing"), edits, same(F.col("d")), True, finer))


def _groups(lines: DataFrame, edits: int, per_edit: int) -> DataFrame:
    """(node, component) of the lines with near ones; ``lines`` is (h, line)."""
    long = lines.where(F.length("line") >= per_edit)
    sized = widened(long)
    index = scratch.table(index_keys(sized, edits, per_edit), "line-keys")
    first = scratch.table(index.groupBy("key").agg(F.min("h").alias("first")), "line-index")
    # Each key is in the index once, so its side of the join is even and can be hashed.
    hits = scratch.table(probe_keys(sized, edits, per_edit).join(first.hint("shuffle_hash"), "key").where("h <> first").select("key", "h", "first").distinct(), "line-hits")
    stars = scratch.table(hits.select(F.least("h", "first").alias("a"), F.greatest("h", "first").alias("b")).distinct(), "line-stars")
    entries = hits.select("key").distinct()
    # All lines of an entry that was hit: those indexed there and those that probe it.
    listed = scratch.table(index.join(entries, "key", "left_semi").select("key", "h").distinct(), "line-listed")
    wanted = stars.select(F.explode(F.array("a", "b")).alias("h")).union(listed.select("h")).distinct()
    kept = layout.thinned(long, "h", wanted).join(wanted, "h", "left_semi").dropDuplicates(["h"])
    found_lines = scratch.table(_counted(kept), "line-found")
    links = scratch.table(_near(stars, found_lines, edits, per_edit), "line-links")
    comps = scratch.table(components(links), "line-comps")
    named = lambda t: t.join(comps.withColumnRenamed("node", "h"), "h", "left").withColumn("component", F.coalesce("component", "h"))
    of_index, of_probes = scratch.table(named(listed), "line-of-index"), scratch.table(named(hits.select("key", "h")), "line-of-probes")
    both = of_index.select("key", "component", F.lit(0).alias("p")).union(of_probes.select("key", "component", F.lit(1)))
    sizes = both.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum("p").alias("p"), F.count("*").alias("n")).where("lo <> hi")
    mixed = scratch.table(sizes.select("key", (F.least(F.col("p"), F.col("n") - F.col("p")) > FREQUENT).alias("frequent")), "line-mixed")
    if mixed.isEmpty():
        return comps
    calm, frequent = mixed.where("not frequent"), mixed.where("frequent").select("key")
    left, right = (t.join(calm, "key", "left_semi").select("key", "h", "component", F.array().cast("array<bigint>").alias("apart")) for t in (of_index, of_probes))
    if not frequent.isEmpty():
        in_frequent = listed.union(hits.select("key", "h")).join(frequent, "key", "left_semi").select("h").distinct()
        lines_there = scratch.table(named(widened(found_lines.select("h", "line").join(in_frequent, "h", "left_semi"))), "line-frequent")
        finer, still = _split(lines_there, frequent, edits, per_edit)
        finer = scratch.table(finer, "line-finer")
        heads = finer.join(still, "key", "left_semi").where("not probing").groupBy("key").agg(F.min("h").alias("first"))
        again = finer.where("probing").join(heads, "key").where("h <> first").select(F.least("h", "first").alias("a"), F.greatest("h", "first").alias("b")).distinct()
        more = scratch.table(_near(again, found_lines, edits, per_edit), "line-more-stars")
        if not more.isEmpty():
            links = links.union(more)
            comps = scratch.table(components(links), "line-more-comps")
            left, right, finer = (named(t.drop("component")) for t in (left, right, finer))
        columns = ["key", "h", "component", "apart"]
        pick = lambda probing: finer.where(F.col("probing") == probing).select(columns)
        left, right = left.select(columns).union(pick(False)), right.select(columns).union(pick(True))
    # Counts are compared inside the join, so pairs of an entry that can't be near are never listed.
    counts = found_lines.drop("line")
    side = lambda t, name: scratch.table(_side(t.join(counts, "h"), name), f"line-{name}")
    left = side(left, "x").withColumnsRenamed({"h": "a", "component": "ca"})
    right = side(right, "y").withColumnsRenamed({"h": "b", "component": "cb", "key": "__key", "apart": "__apart"})
    elsewhere = F.exists(F.zip_with("apart", "__apart", lambda x, y: x == y), lambda same: same)
    near = (F.col("key") == F.col("__key")) & (F.col("ca") != F.col("cb")) & _alike(edits) & ~elsewhere
    across = left.join(right, near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = scratch.table(_near(across.join(stars, ["a", "b"], "left_anti"), found_lines, edits, per_edit), "line-more")
    return comps if more.isEmpty() else components(links.union(more))


def _lines(docs: DataFrame) -> DataFrame:
    """(__id, __tie, pos, line, h) for each line with something on it; lines end at a line feed."""
    rows = docs.select("__id", "__tie", F.posexplode(F.split("__text", "\n", -1)).alias("pos", "line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("h", F.xxhash64("line"))


def _drops(rows: DataFrame, edits: int, per_edit: int) -> DataFrame:
    """(__d, __t, __drop): the positions of the lines that go, by id and hash of the text; a kept table."""
    lines = _lines(rows)
    place = F.struct(F.col("__id").isNull().alias("last"), "__id", "__tie", "pos")
    seen = scratch.table(lines.select("__id", "__tie", "pos", "h"), "line-places")
    counts = scratch.table(seen.groupBy("h").agg(F.min(place).alias("at"), F.count("*").alias("n")), "line-counts")
    # Fewer than 1 / HOT lines, so a table of a fixed size.
    hot = counts.where(F.col("n") > F.lit(HOT) * max(1, seen.count())).select(F.col("h").alias("__hot"), "at")
    alone = lines.join(F.broadcast(hot), F.col("h") == F.col("__hot"), "left").where(F.col("__hot").isNull() | (place == F.col("at")))
    comps = _groups(alone.select("h", "line"), edits, per_edit)
    groups = scratch.table(counts.join(comps.withColumnRenamed("node", "h"), "h", "left").select("h", "at", F.coalesce("component", "h").alias("g")), "line-groups")
    firsts = scratch.table(groups.groupBy("g").agg(F.min("at").alias("first")), "line-firsts")
    of_line = scratch.table(groups.join(firsts, "g").select("h", "first"), "line-of")
    gone = seen.join(of_line, "h").where(place != F.col("first"))
    return scratch.table(gone.groupBy("__id", "__tie").agg(F.collect_set("pos").alias("__drop")).select(F.col("__id").alias("__d"), F.col("__tie").alias("__t"), "__drop"), "line-drops", kept=True)


def remove_repeated_lines(docs: DataFrame, edits: int = EDITS, per_edit: int = PER_EDIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the text without repeated lines, and ``n_lines``, ``n_removed``.

    Equal lines are one line, and so are lines that a chain of steps joins, each of at
    most one edit for every full ``per_edit`` characters of the shorter line and of at
    most ``edits``. A line stays at its first place, by (doc_id, position), and goes
    elsewhere. Lines of white space count for nothing and stay.

    Null, empty and blank texts stay as they are. Rows without doc_id come after all
    others in order. Rows equal in id and text count as one place and get one result. A
    text that loses all its lines becomes empty (or what white space is left). An empty
    table stays empty. Added columns replace those of the same name.
    """
    rows = docs.drop("n_lines", "n_removed").withColumns({"__id": F.col(doc_id).cast("long"), "__tie": F.xxhash64(text), "__text": F.col(text)})
    with scratch.passing(docs.sparkSession):
        drops = _drops(rows, edits, per_edit)
    joined = rows.join(drops, F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__tie") == F.col("__t")), "left")
    all_ = F.split("__text", "\n", -1)
    kept = layout.bound(lambda v: F.transform(v["left"], lambda i: F.get(v["lines"], i)), lines=all_, left=F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), "__drop"))
    out = joined.withColumns(
        {
            text: F.when(F.col("__drop").isNull(), F.col("__text")).otherwise(F.array_join(kept, "\n")),
            "n_lines": F.coalesce(F.size(F.filter(all_, lambda line: line.rlike(r"[^\x20\x09-\x0D]"))), F.lit(0)).cast("long"),
            "n_removed": F.coalesce(F.size("__drop"), F.lit(0)).cast("long"),
        }
    )
    return out.drop("__id", "__tie", "__text", "__d", "__t", "__drop")
