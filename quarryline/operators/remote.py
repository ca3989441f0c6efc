"""Answers of a remote service that are at hand as text or rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import paths as P
from quarryline.functions import text as X

def _member(of: Column, name: str) -> Column:
    """A member of an object by its name in any case; of several, the one that is spelled as asked, or else the last by its spelling."""
    fields = F.filter(F.map_entries(of.cast("map<string,variant>")), lambda e: F.lower(e["key"]) == name)
    return F.coalesce(F.get(F.filter(fields, lambda e: e["key"] == name), F.lit(0)), F.try_element_at(fields, F.lit(-1)))["value"]


def _kind(value: Column) -> Column:
    """What a JSON value is: "OBJECT<...>", "ARRAY<...>", "STRING", "BOOLEAN", a kind of number, "VOID" for null; null where there is none."""
    return F.schema_of_variant(value)


def envelopes(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``ok``, ``data`` (JSON text) and ``outcome``.

    outcome: "ok"; "no data" where it is said to be ok and ``data`` is absent; "code: message" of an
    error; "unknown error" where neither holds; "invalid" where the body isn't JSON or a
    member has another kind than an envelope's. Absent and null members count as false, no
    error and empty text; ``data`` may be null. Names match in any case.
    """
    parsed = F.try_parse_json(F.col(body))
    is_object = _kind(parsed).startswith("OBJECT")
    top = F.when(is_object, parsed)
    ok, error, data = (_member(top, n) for n in ("ok", "error", "data"))
    inside = F.when(_kind(error).startswith("OBJECT"), error)
    code, message = _member(inside, "code"), _member(inside, "message")
    fine = lambda v, kind: v.isNull() | _kind(v).startswith(kind) | (_kind(v) == "VOID")
    known = (is_object & fine(ok, "BOOLEAN") & fine(error, "OBJECT") & fine(code, "STRING") & fine(message, "STRING")) | (_kind(parsed) == "VOID")
    said = F.coalesce(F.try_variant_get(ok, "$", "boolean"), F.lit(False))
    text = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.lit(""))
    failure = F.when(error.isNull() | (_kind(error) == "VOID"), "unknown error").otherwise(F.concat(text(code), F.lit(": "), text(message)))
    outcome = F.when(~F.coalesce(known, F.lit(False)), "invalid").when(~said, failure).when(data.isNull(), "no data").otherwise("ok")
    rows = bodies.withColumn("outcome", outcome)
    return rows.withColumns({"ok": F.when(F.col("outcome") != "invalid", said), "data": F.when(F.col("outcome") == "ok", F.to_json(data))})


def proposed_fixes(fixes: DataFrame, most: int = 20) -> DataFrame:
    """The first ``most`` proposed fixes, by id."""
    return fixes.where(F.col("status") == "proposed").orderBy("fix_id").limit(most)


def _age(rows: DataFrame, as_of: Column) -> Column:
    """The age of ``created_at``, a timestamp or a stamp as text."""
    at = F.col("created_at")
    return (X.relative_age_of_text if rows.schema["created_at"].dataType.simpleString() == "string" else X.relative_age)(at, as_of).alias("age")


def recent_runs(runs: DataFrame, as_of: Column, most: int = 5) -> DataFrame:
    """The latest runs as a status page shows them: (run_id, age, project, status, branch, findings, fixes)."""
    top = runs.orderBy(F.desc("created_at"), "run_id").limit(most)
    branch = F.coalesce(F.nullif(F.col("branch"), F.lit("")), F.lit("-"))
    return top.select("run_id", _age(runs, as_of), X.cell(F.col("project"), 28).alias("project"), "status", X.cell(branch, 16).alias("branch"), "findings", "fixes")


def recent_fixes(fixes: DataFrame, as_of: Column, most: int = 5) -> DataFrame:
    """The latest proposed changes as a status page shows them: (age, project, number, status, title)."""
    top = fixes.orderBy(F.desc("created_at"), "fix_id").limit(most)
    return top.select(_age(fixes, as_of), X.cell(F.col("project"), 24).alias("project"), F.concat(F.lit("#"), F.col("fix_id").cast("string")).alias("number"), "status", X.cell(F.col("title"), 48).alias("title"))


def _table(rows: DataFrame, heads: dict[str, str], title: str, none: str, at: int) -> DataFrame:
    """(pos, line): a title and rows of columns, each as wide as its widest cell and two more; or the title and ``none``. ``rows`` has ``place``, from 1, and is short."""
    head = rows.sparkSession.range(1).select(F.lit(0).alias("place"), *[F.lit(h).alias(c) for c, h in heads.items()])
    cells = rows.select("place", *[F.col(c).cast("string").alias(c) for c in heads])
    first = next(iter(heads))
    both = head.unionByName(cells).withColumn(first, F.concat(F.lit("  "), first))
    wide = both.agg(*[F.max(F.length(c)).alias(f"__{c}") for c in heads], F.max("place").alias("__n"))
    *padded, last = heads
    lines = both.crossJoin(F.broadcast(wide)).where("__n > 0").select((F.col("place") + at + 1).alias("pos"), F.concat(*[F.rpad(c, F.col(f"__{c}") + 2, " ") for c in padded], F.coalesce(last, F.lit(""))).alias("line"))
    said = wide.select(F.lit(at).alias("pos"), F.when(F.col("__n") > 0, f"{title}:").otherwise(f"{title}: {none}").alias("line"))
    return said.unionByName(lines)


def status_page(identity: DataFrame, runs: DataFrame, fixes: DataFrame, as_of: Column, most: int = 5) -> DataFrame:
    """(pos, line): who is known by (email, org, plan, suspended), the latest runs and the latest changes, ``most`` of each.

    An empty list is said in its title's line. Only the listed rows are laid out.
    """
    order = lambda rows, key: Window.orderBy(F.desc("created_at"), key)
    top = lambda rows, key: rows.orderBy(F.desc("created_at"), key).limit(most).withColumn("place", F.row_number().over(order(rows, key)))
    runs, fixes = top(runs, "run_id"), top(fixes, "fix_id")
    branch = F.coalesce(F.nullif(F.col("branch"), F.lit("")), F.lit("-"))
    shown = runs.select("place", _age(runs, as_of), X.cell(F.col("project"), 28).alias("project"), "status", X.cell(branch, 16).alias("branch"), "findings", "fixes")
    changes = fixes.select("place", _age(fixes, as_of), X.cell(F.col("project"), 24).alias("project"), F.concat(F.lit("#"), F.col("fix_id").cast("string")).alias("number"), "status", X.cell(F.col("title"), 48).alias("title"))
    who = identity.select(F.explode(F.array(
        F.struct(F.lit(0).alias("pos"), F.concat(F.lit("Logged in as "), "email").alias("line")),
        F.struct(F.lit(1).alias("pos"), F.concat(F.lit("Org: "), "org", F.lit(" · plan: "), "plan", F.when(F.col("suspended"), "  (suspended)").otherwise("")).alias("line")),
        F.struct(F.lit(2).alias("pos"), F.lit("").alias("line")), F.struct(F.lit(100 + most).alias("pos"), F.lit("").alias("line")),
    )).alias("l")).select("l.*")
    runs_table = _table(shown, {"age": "WHEN", "project": "PROJECT", "status": "STATUS", "branch": "BRANCH", "findings": "FINDINGS", "fixes": "FIXES"}, "Recent runs", "(none yet: connect a repository to begin)", 3)
    fixes_table = _table(changes, {"age": "WHEN", "project": "PROJECT", "number": "PR", "status": "STATUS", "title": "TITLE"}, "Recent fix PRs", "(none)", 200 + most)
    return who.unionByName(runs_table).unionByName(fixes_table)


def readiness(wanted: DataFrame, offered: DataFrame | None, server: str) -> DataFrame:
    """(name, ready, message) for each wanted model; ``offered`` is None where the server can't be reached. What is missing is said with what to do."""
    if offered is None:
        return wanted.select("name", F.lit(False).alias("ready"), F.lit(f"can't reach the model server at {server}: is it running?").alias("message"))
    keys = offered.select(P.model_key(F.col("name")).alias("__key")).distinct()
    known = wanted.join(keys, P.model_key(F.col("name")) == F.col("__key"), "left")
    ready = F.col("__key").isNotNull()
    return known.select("name", ready.alias("ready"), F.when(~ready, F.concat(F.lit(f"the model server at {server} has no model "), "name", F.lit(": pull it first"))).alias("message"))


def available_models(wanted: DataFrame, offered: DataFrame) -> DataFrame:
    """The wanted models that a server offers; the tag "latest" may be left out on either side."""
    keys = offered.select(P.model_key(F.col("name")).alias("__key")).distinct()
    return wanted.join(keys, P.model_key(F.col("name")) == F.col("__key"), "left_semi")
