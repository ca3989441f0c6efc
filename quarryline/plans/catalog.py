"""The driver's queries for the operators on source corpora, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import findings as N
from quarryline.functions import paths as P
from quarryline.functions import text as X
from quarryline.functions import vectors as V
from quarryline.operators import chunking, index, ordering, patches, remote, report, scan, search, secrets
from quarryline.plans import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# ---- relations derived from the tables; the same text serves Spark and DuckDB

#: Documents as files of a tree, with skipped folders, folders whose names begin alike, upper-case and unknown extensions.
FILES = """
concat(source, CASE doc_id % 13 WHEN 0 THEN '-x/' WHEN 1 THEN '.d/' ELSE '/' END, CASE doc_id % 11 WHEN 0 THEN 'node_modules/' WHEN 1 THEN '.backup-20240101T000000Z/' WHEN 2 THEN 'lib/' ELSE '' END, CAST(doc_id AS STRING),
       CASE doc_id % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.GO' WHEN 2 THEN '.md' WHEN 3 THEN '.tar.gz' WHEN 4 THEN '.ts' WHEN 5 THEN '' WHEN 6 THEN '.yml' ELSE '.Sql' END)
"""
#: Events as findings.
FINDINGS = {
    "seq": "event_id",
    "file_path": "concat('src/', event_type, '/', CAST(user_id % 50 AS STRING), '.ts')",
    "line_start": "CAST(event_id % 97 + 1 AS INT)",
    "line_end": "CAST(event_id % 97 + 1 + event_id % 3 AS INT)",
    "category": "CASE event_id % 4 WHEN 3 THEN 'ssrf' WHEN 2 THEN 'headers' ELSE 'secrets' END",
    "severity": "CASE event_id % 7 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'info' WHEN 5 THEN 'odd' ELSE 'low' END",
    "title": "concat('Found in ', event_type)",
    "explanation": "concat('Seen by ', CAST(user_id AS STRING))",
    "detection": "CASE event_id % 4 WHEN 0 THEN 'regex' WHEN 1 THEN 'entropy' ELSE '' END",
    "pattern": "CASE event_id % 12 WHEN 0 THEN 'AWS access key' WHEN 4 THEN ' --Odd.Key (v2)! ' WHEN 8 THEN '' ELSE '' END",
    "cwe": "'CWE-798'",
    "owasp": "'A07:2021'",
    "snippet": "repeat(concat(event_type, ' '), CAST(event_id % 25 AS INT))",
}
FINDINGS_SQL = f"(SELECT {', '.join(f'{e} AS {c}' for c, e in FINDINGS.items())}, sha256(CAST(event_id AS VARCHAR)) AS content_hash FROM events)"
FILES_SQL = f"(SELECT doc_id, {FILES.replace('STRING', 'VARCHAR')} AS rel_path, text, strlen(text) AS size FROM documents)"
LANGUAGE_SQL = "CASE lower(regexp_extract(rel_path, '(\\.[^./]*)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in scan.LANGUAGES.items()) + " END"
PRUNED_SQL = "(len(list_filter(string_split(rel_path, '/')[:-2], lambda d: d IN (" + ", ".join(f"'{d}'" for d in scan.SKIPPED) + ") OR starts_with(d, '.backup-'))) > 0)"
LINES_SQL = "list_transform(CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END, lambda l: CASE WHEN ends_with(l, chr(13)) THEN l[:-2] ELSE l END)"
RANK_SQL = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 99 END"
LEVEL_SQL = "CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' WHEN severity = 'low' THEN 'note' ELSE 'none' END"
SLUG = "trim(lower(regexp_replace({}, '[^A-Za-z0-9]+', '-', 'g')), '-')"
RULE_SQL = f"CASE WHEN category = 'secrets' AND detection = 'regex' AND pattern <> '' THEN concat('secrets/', {SLUG.format('pattern')}) WHEN category = 'secrets' AND detection = 'entropy' THEN 'secrets/high-entropy-near-keyword' ELSE category END"
CHUNKS_SQL = f"""
(SELECT rel_path, language, 'lines' AS kind, CAST(s + 1 AS INT) AS line_start, CAST(least(s + 30, n) AS INT) AS line_end, body AS content_text, doc_id,
        sha256(concat(rel_path, chr(0), language, chr(0), CAST(s + 1 AS VARCHAR), chr(0), CAST(least(s + 30, n) AS VARCHAR), chr(0), body)) AS content_hash
 FROM (SELECT *, array_to_string(lines[s + 1 : s + 30], chr(10)) AS body
       FROM (SELECT doc_id, rel_path, language, lines, len(lines) AS n, unnest(range(0, CAST(greatest(0, ceil((len(lines) - 30) / 25.0)) * 25 + 1 AS BIGINT), 25)) AS s
             FROM (SELECT doc_id, rel_path, {LANGUAGE_SQL} AS language, {LINES_SQL} AS lines FROM {FILES_SQL} f WHERE NOT {PRUNED_SQL})
             WHERE language IS NOT NULL AND len(lines) > 0)))
"""


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.expr(FILES).alias("rel_path"), "text", F.octet_length("text").cast("long").alias("size"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return events.select(*[F.expr(e).alias(c) for c, e in FINDINGS.items()], F.sha2(F.col("event_id").cast("string"), 256).alias("content_hash"))


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.eligible(files(spark, sf_dir))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_lines(eligible(spark, sf_dir))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier run over the even documents has stored."""
    return chunking.chunk_lines(eligible(spark, sf_dir).where("doc_id % 2 = 0"))


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = read(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0]) if row else []


# ---- typed rows, and rows of the same shape that each table gives

#: Relation -> (table, its columns): the rows of a table that join the typed ones of ``fixtures``; the same text serves Spark and DuckDB.
DERIVED: dict[str, tuple[str, dict[str, str]]] = {
    "paths": ("documents", {"path": f"concat(CASE doc_id % 7 WHEN 0 THEN '/' WHEN 1 THEN '../' WHEN 2 THEN 'up/../../' WHEN 3 THEN 'C:' WHEN 4 THEN './in/../' WHEN 5 THEN 'a' ELSE '' END, CASE doc_id % 5 WHEN 0 THEN 'x/../' ELSE '' END, {FILES})"}),
    "report_paths": ("documents", {"path": f"concat(CASE doc_id % 6 WHEN 0 THEN '/etc/' WHEN 1 THEN '/var/../usr/bin/' WHEN 2 THEN '/tmp/../tmp/' WHEN 3 THEN './' WHEN 4 THEN '/./sys//' ELSE '' END, {FILES})"}),
    "origins": ("pages", {"origin": "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN concat('git@', source_host, ':', 'team/repo', CAST(page_id AS STRING), '.git') WHEN 2 THEN concat(' ', url, '.git ') WHEN 3 THEN '' ELSE concat('ssh://git@', source_host, '/o/', CAST(page_id AS STRING)) END".replace("source_host", "split_part(url, '/', 3)"), "root": "concat('/home/p', CAST(page_id AS STRING))"}),
    "existing": ("documents", {"path": FILES}),
    "backups": ("events", {"name": "concat(CASE event_id % 3 WHEN 0 THEN 'backup-' WHEN 1 THEN '.backup-' ELSE '.backup-old' END, CAST(20200000 + user_id AS STRING), 'T', CAST(100000 + event_id % 86400 AS STRING), 'Z')"}),
    "entries": ("documents", {"rel_path": f"concat({FILES}, CASE doc_id % 3 WHEN 0 THEN '.was-absent' ELSE '' END)"}),
    "sources": ("documents", {"a": "CASE doc_id % 4 WHEN 0 THEN '' ELSE concat('Owner/', source) END", "b": "CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN upper(concat('owner/', source)) WHEN 2 THEN concat('owner/', lang) ELSE concat('owner/', source) END"}),
    "thresholds": ("events", {"threshold": FINDINGS["severity"]}),
    "wanted": ("documents", {"name": "concat(source, CASE doc_id % 4 WHEN 0 THEN ':latest' WHEN 1 THEN ':7b' WHEN 2 THEN concat('-', lang) ELSE '' END)"}),
    "offered": ("documents", {"name": "concat(source, CASE doc_id % 3 WHEN 0 THEN ':latest' WHEN 1 THEN ':13b' ELSE '' END)"}),
}


def rows_sql(name: str) -> str:
    if name == "patches":
        return f"(SELECT * FROM {fixtures.sql('patches')} x UNION ALL SELECT CAST(doc_id AS VARCHAR), {_EDIT.replace('STRING', 'VARCHAR')} FROM (SELECT *, ls[spot] AS one, ls[spot + 1] AS two FROM {_FILE_LINES_SQL} y) z)"
    table, columns = DERIVED[name]
    return f"(SELECT * FROM {fixtures.sql(name)} x UNION ALL SELECT {', '.join(columns.values()).replace('STRING', 'VARCHAR')} FROM {table})"


def rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "patches":
        return fixtures.table(spark, name).unionByName(document_patches(spark, sf_dir))
    table, columns = DERIVED[name]
    return fixtures.table(spark, name).unionByName(read(spark, sf_dir, table).select(*[F.expr(e).alias(c) for c, e in columns.items()]))


#: A patch for each document of two lines or more, to the file that it is: one line in two is changed. Some name the old line wrongly, some its place or the file, and some create a file that is there.
_EDIT = """
concat(CASE WHEN doc_id % 13 = 5 THEN '--- /dev/null' ELSE concat('--- a/', named) END, chr(10), '+++ b/', named, chr(10),
       CASE WHEN doc_id % 13 = 5 THEN concat('@@ -0,0 +1 @@', chr(10), '+new') ELSE concat('@@ -', CAST(shown AS STRING), ',2 +', CAST(shown AS STRING), ',2 @@', chr(10), ' ', one, chr(10), '-', two, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END, chr(10), '+', two, '!', chr(10)) END)
"""
_EDITED = ["doc_id", "rel_path", "concat(rel_path, CASE WHEN doc_id % 11 = 3 THEN '.gone' ELSE '' END) AS named", "ls", "1 + doc_id % (n - 1) AS spot", "1 + doc_id % (n - 1) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS shown"]
_FILE_LINES_SQL = f"(SELECT {', '.join(_EDITED)} FROM (SELECT *, len(ls) AS n FROM (SELECT doc_id, rel_path, string_split(text, chr(10)) AS ls FROM {FILES_SQL} f)) WHERE n > 1)"


def document_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = files(spark, sf_dir).select("doc_id", "rel_path", F.split("text", "\n", -1).alias("ls")).withColumn("n", F.size("ls")).where("n > 1")
    placed = lines.selectExpr(*_EDITED)
    return placed.withColumns({"one": F.expr("ls[CAST(spot - 1 AS INT)]"), "two": F.expr("ls[CAST(spot AS INT)]")}).select(F.col("doc_id").cast("string").alias("patch_id"), F.expr(_EDIT).alias("patch"))


# ---- scans


@query("scan_dir_prune", f"SELECT doc_id, rel_path, {PRUNED_SQL} AS pruned FROM {FILES_SQL} f")
def scan_dir_prune(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", "rel_path", scan.pruned(F.col("rel_path")).alias("pruned"))


@query("scan_lang_by_ext", f"SELECT * FROM (SELECT doc_id, rel_path, {LANGUAGE_SQL} AS language FROM {FILES_SQL} f) WHERE language IS NOT NULL")
def scan_lang_by_ext(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", "rel_path", scan.language(F.col("rel_path")).alias("language")).where("language is not null")


@query("scan_size_cap", f"SELECT doc_id, rel_path, CAST(size * 200 AS BIGINT) AS size FROM {FILES_SQL} f WHERE size * 200 <= 524288")
def scan_size_cap(spark, sf_dir):
    grown = files(spark, sf_dir).withColumn("size", F.col("size") * 200)
    return grown.where(F.col("size") <= scan.MAX_FILE_BYTES).select("doc_id", "rel_path", "size")


@query("scan_total_cap", f"SELECT rel_path, CAST(size AS BIGINT) AS size, CAST(t AS BIGINT) AS total_bytes FROM (SELECT rel_path, size, sum(size) OVER (ORDER BY rel_path ROWS UNBOUNDED PRECEDING) AS t FROM {FILES_SQL} f) WHERE t <= (SELECT sum(size) // 3 FROM {FILES_SQL} g)")
def scan_total_cap(spark, sf_dir):
    """With a bound of a third of all bytes, so that it cuts at every size."""
    some = files(spark, sf_dir).select("rel_path", "size")
    return scan.total_cap(some, (some.agg(F.sum("size")).first()[0] or 0) // 3).select("rel_path", "size", "total_bytes")


@query("scan_total_cap_default", f"SELECT rel_path, CAST(size AS BIGINT) AS size, CAST(t AS BIGINT) AS total_bytes FROM (SELECT rel_path, size, sum(size) OVER (ORDER BY rel_path ROWS UNBOUNDED PRECEDING) AS t FROM {FILES_SQL} f) WHERE t <= {scan.MAX_TOTAL_BYTES}")
def scan_total_cap_default(spark, sf_dir):
    """With the bound that scans have by default."""
    return scan.total_cap(files(spark, sf_dir).select("rel_path", "size")).select("rel_path", "size", "total_bytes")


@query("text_lines", f"SELECT doc_id, CAST(len(lines) AS INT) AS n_lines, array_to_string(lines, chr(30)) AS joined FROM (SELECT doc_id, {LINES_SQL} AS lines FROM documents)")
def text_lines(spark, sf_dir):
    lines = X.lines(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(lines).alias("n_lines"), F.array_join(lines, "\x1e").alias("joined"))


@query("chunk_lines", f"SELECT rel_path, language, kind, line_start, line_end, content_text, content_hash FROM {CHUNKS_SQL} c")
def chunk_lines(spark, sf_dir):
    return chunks(spark, sf_dir)


@query("corpus_stats", f"SELECT (SELECT count(*) FROM (SELECT {LANGUAGE_SQL} AS l FROM {FILES_SQL} f WHERE NOT {PRUNED_SQL}) WHERE l IS NOT NULL) AS files, (SELECT count(*) FROM {CHUNKS_SQL} c) AS chunks")
def corpus_stats(spark, sf_dir):
    return chunking.corpus_stats(eligible(spark, sf_dir), chunks(spark, sf_dir))


# ---- index


@query("index_incremental", f"SELECT content_hash, rel_path, line_start FROM {CHUNKS_SQL} c WHERE doc_id % 2 = 1")
def index_incremental(spark, sf_dir):
    return index.new_chunks(chunks(spark, sf_dir), stored(spark, sf_dir)).select("content_hash", "rel_path", "line_start")


@query("index_unchanged", f"SELECT count(*) AS unchanged FROM {CHUNKS_SQL} c WHERE doc_id % 2 = 0")
def index_unchanged(spark, sf_dir):
    return index.stored_chunks(chunks(spark, sf_dir), stored(spark, sf_dir)).agg(F.count("*").alias("unchanged"))


@query("store_upsert", f"SELECT language, count(*) AS n, count(DISTINCT content_hash) AS hashes FROM {CHUNKS_SQL} c GROUP BY language")
def store_upsert(spark, sf_dir):
    return index.upserted(stored(spark, sf_dir), chunks(spark, sf_dir)).groupBy("language").agg(F.count("*").alias("n"), F.count_distinct("content_hash").alias("hashes"))


@query("embed_batches", f"SELECT rel_path, content_hash, n // 16 AS batch, n % 16 AS place FROM (SELECT rel_path, content_hash, row_number() OVER (ORDER BY rel_path, line_start, content_hash) - 1 AS n FROM {CHUNKS_SQL} c)")
def embed_batches(spark, sf_dir):
    keys = chunks(spark, sf_dir).select("rel_path", "line_start", "content_hash")
    return index.batches(keys).select("rel_path", "content_hash", "batch", "place")


@query("embed_truncate", "SELECT doc_id, CASE WHEN strlen(t) > 24576 THEN left(t, 24576) ELSE t END AS input, CAST(least(strlen(t), 24576) AS INT) AS n_bytes FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '?', 'g') AS t FROM documents)")
def embed_truncate(spark, sf_dir):
    plain = F.regexp_replace("text", "[^ -~]", "?")
    return read(spark, sf_dir, "documents").select("doc_id", index.embed_input(plain).alias("input")).withColumn("n_bytes", F.octet_length("input"))


@query("embed_chunks")
def embed_chunks(spark, sf_dir):
    """Chunks with vectors of the deterministic stand-in model; rows only, for a model isn't SQL."""
    return index.embed(chunks(spark, sf_dir), index.hashing_embedder()).select("content_hash", "embedding", "status", "error")


# ---- search


@query("vector_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM embeddings")
def vector_norms(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


_SCORED = "SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings"


@query("cosine_topk", f"SELECT vec_id, label, round(s, 6) AS score, CAST(row_number() OVER (ORDER BY s DESC, vec_id) AS INT) AS rank FROM ({_SCORED}) QUALIFY row_number() OVER (ORDER BY s DESC, vec_id) <= 10")
def cosine_topk(spark, sf_dir):
    got = search.search(read(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 10, key="vec_id", language="label")
    return got.select("vec_id", "label", F.round("score", 6).alias("score"), "rank")


@query("search_lang_filter", f"SELECT vec_id, label, round(s, 6) AS score, CAST(row_number() OVER (ORDER BY s DESC, vec_id) AS INT) AS rank FROM ({_SCORED}) WHERE label IN (1, 3) QUALIFY row_number() OVER (ORDER BY s DESC, vec_id) <= 10")
def search_lang_filter(spark, sf_dir):
    got = search.search(read(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 10, [1, 3], key="vec_id", language="label")
    return got.select("vec_id", "label", F.round("score", 6).alias("score"), "rank")


@query("search_render", f"""
SELECT rank, concat(rel_path, ':', line_start, '-', line_end) AS head, concat('(lines · ', language, ' · score=', format('{{:.3f}}', score), ')') AS detail,
       CASE WHEN content_text = '' THEN '' ELSE concat('   ', replace(rtrim(content_text, chr(10)), chr(10), concat(chr(10), '   '))) END AS body
FROM (SELECT *, 1.0::DOUBLE / (4 + line_start) AS score, line_end AS rank FROM {CHUNKS_SQL} c)""")
def search_render(spark, sf_dir):
    """Every chunk as a search shows it."""
    return search.rendered(chunks(spark, sf_dir).withColumns({"rank": F.col("line_end"), "score": F.lit(1.0) / (F.col("line_start") + 4)}))


# ---- findings


_LINES_OF = fixtures.sql("secret_lines")
_HITS = " UNION ALL ".join(
    f"SELECT line_id, {i} AS seq, '{r.pattern_id}' AS pattern_id, '{r.severity}' AS severity, unnest(list_distinct(regexp_extract_all(text, '{r.pattern}'))) AS match FROM l" + (f" WHERE regexp_matches(text, '{r.context}')" if r.context else "")
    for i, r in enumerate(secrets.RULES)
)


#: A line for each document that holds a key of one shape or another, assembled from digests, or just misses it.
_KEYED = """
CASE doc_id % 6 WHEN 0 THEN concat('id = AK', 'IA', upper(left(md5(CAST(doc_id AS STRING)), 16))) WHEN 1 THEN concat('t: gh', 'p_', left(sha256_hex, 36), ' end') WHEN 2 THEN concat('sk_', 'live_', left(sha256_hex, 40))
     WHEN 3 THEN concat('heroku ', left(sha256_hex, 8), '-0000-4000-8000-', right(sha256_hex, 12)) WHEN 4 THEN concat('AK', 'IA', left(sha256_hex, 9)) ELSE left(text, 80) END
"""
_KEYED_SQL = f"(SELECT 'document' AS origin, doc_id AS id, CAST(0 AS INT) AS line_no, {_KEYED.replace('STRING', 'VARCHAR')} AS text FROM (SELECT *, sha256(text) AS sha256_hex FROM documents) UNION ALL SELECT 'fixture', CAST(line_id AS BIGINT), CAST(1 AS INT), text FROM {_LINES_OF} f)"
_ALL_HITS = _HITS.replace("SELECT line_id,", "SELECT origin, id, line_no,")
_KEPT_HITS = "SELECT origin, id, line_no, CAST(seq AS INT) AS seq, pattern_id, severity, match FROM h WHERE NOT EXISTS (SELECT 1 FROM h k WHERE k.origin = h.origin AND k.id = h.id AND k.line_no = h.line_no AND k.seq < h.seq AND contains(k.match, h.match))"


def _fixed_lines(spark: SparkSession) -> DataFrame:
    return fixtures.table(spark, "secret_lines").select(F.lit("fixture").alias("origin"), F.col("line_id").cast("long").alias("id"), F.lit(1).alias("line_no"), "text")


@query("secret_regex", f"WITH l AS {_KEYED_SQL}, h AS ({_ALL_HITS}) {_KEPT_HITS}")
def secret_regex(spark, sf_dir):
    """The rules over a line for each document that has a key or nearly, and over the fixture's lines."""
    keyed = read(spark, sf_dir, "documents").withColumn("sha256_hex", F.sha2("text", 256)).select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), F.lit(0).alias("line_no"), F.expr(_KEYED).alias("text"))
    return secrets.by_pattern(_fixed_lines(spark).unionByName(keyed)).select("origin", "id", "line_no", "seq", "pattern_id", "severity", "match")


_ALL_LINES = f"(SELECT 'fixture' AS origin, CAST(line_id AS BIGINT) AS id, CAST(1 AS INT) AS line_no, text FROM {_LINES_OF} f UNION ALL SELECT 'document', doc_id, CAST(i AS INT), lines[i] FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, {LINES_SQL} AS lines FROM documents)))"


@query("secret_regex_all", f"WITH l AS {_ALL_LINES}, h AS ({_ALL_HITS}) {_KEPT_HITS}")
def secret_regex_all(spark, sf_dir):
    """The rules over every line of every document, and over the fixture's lines."""
    fixed = _fixed_lines(spark)
    lines = read(spark, sf_dir, "documents").select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), F.posexplode(X.lines(F.col("text"))).alias("at", "text"))
    every = fixed.unionByName(lines.select("origin", "id", (F.col("at") + 1).alias("line_no"), "text"))
    return secrets.by_pattern(every).select("origin", "id", "line_no", "seq", "pattern_id", "severity", "match")


_BITS = "list_sum(list_transform(list_distinct(string_split(value, '')), lambda c: -((length(value) - length(replace(value, c, ''))) / length(value)) * log2((length(value) - length(replace(value, c, ''))) / length(value))))"


@query("entropy_tokens", f"SELECT doc_id, value, entropy FROM (SELECT doc_id, value, round({_BITS}, 6) AS entropy FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{secrets.ASSIGNED.replace(chr(39), chr(39) * 2)}', 1)) AS value FROM documents)) WHERE entropy >= 3.0")
def entropy_tokens(spark, sf_dir):
    return secrets.by_entropy(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "value", "entropy")


@query("severity_rank", f"SELECT seq, severity, CAST({RANK_SQL} AS INT) AS severity_rank FROM {FINDINGS_SQL} f")
def severity_rank(spark, sf_dir):
    return findings(spark, sf_dir).select("seq", "severity", N.severity_rank(F.col("severity")).alias("severity_rank"))


_LIMIT = "CASE threshold WHEN 'critical' THEN 0 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'any' THEN 3 ELSE 1 END"


@query("threshold_rank", f"SELECT threshold, CAST({_LIMIT} AS INT) AS limit_rank FROM {rows_sql('thresholds')} t")
def threshold_rank(spark, sf_dir):
    return rows(spark, sf_dir, "thresholds").select("threshold", N.threshold_rank(F.col("threshold")).alias("limit_rank"))


@query("fail_on_count", " UNION ALL ".join(f"SELECT '{t}' AS threshold, count(*) FILTER (WHERE {RANK_SQL} <= {n}) AS n FROM {FINDINGS_SQL} f" for t, n in (("critical", 0), ("high", 1), ("medium", 2), ("low", 3), ("any", 3), ("bogus", 1))))
def fail_on_count(spark, sf_dir):
    found = findings(spark, sf_dir).select("severity")
    counts = [found.agg(F.count_if(N.severity_rank(F.col("severity")) <= N.threshold_rank(F.lit(t))).alias(t)) for t in ("critical", "high", "medium", "low", "any", "bogus")]
    return counts[0].select(F.lit("critical").alias("threshold"), F.col("critical").alias("n")).unionByName(_rest(counts[1:], ("high", "medium", "low", "any", "bogus")))


def _rest(counts: list[DataFrame], names: tuple[str, ...]) -> DataFrame:
    out = None
    for df, name in zip(counts, names, strict=True):
        row = df.select(F.lit(name).alias("threshold"), F.col(name).alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query("findings_sorted", f"SELECT seq, severity, file_path, line_start, row_number() OVER (ORDER BY {RANK_SQL}, file_path, line_start, seq) AS place FROM {FINDINGS_SQL} f")
def findings_sorted(spark, sf_dir):
    """Every finding with its place in the table's order, counted over sorted ranges."""
    ranked = findings(spark, sf_dir).select("seq", "severity", "file_path", "line_start").withColumn("rank", N.severity_rank(F.col("severity")))
    return ordering.running(ranked, "rank", ["file_path", "line_start", "seq"], F.lit(1), "place").drop("rank")


@query("findings_all_sorted", f"SELECT seq, severity, CAST({RANK_SQL} AS INT) AS severity_rank, file_path, line_start FROM {FINDINGS_SQL} f ORDER BY {RANK_SQL}, file_path, line_start, seq")
def findings_all_sorted(spark, sf_dir):
    """Every finding, as the table orders them, with what it orders by."""
    return report.sorted_findings(findings(spark, sf_dir)).select("seq", "severity", "severity_rank", "file_path", "line_start")


@query("table_rows", f"SELECT concat('[', upper(severity), ']') AS badge, concat(file_path, ':', line_start) AS location, title, CASE WHEN strlen(snippet) > 100 THEN concat(left(snippet, 100), '…') ELSE snippet END AS snippet FROM {FINDINGS_SQL} f")
def table_rows(spark, sf_dir):
    return report.table_rows(findings(spark, sf_dir))


@query("severity_summary", f"SELECT severity, CAST({RANK_SQL} AS INT) AS severity_rank, count(*) AS n FROM {FINDINGS_SQL} f WHERE {RANK_SQL} < 99 GROUP BY severity UNION ALL SELECT 'total', CAST(100 AS INT), count(*) FROM {FINDINGS_SQL} f")
def severity_summary(spark, sf_dir):
    return report.severity_summary(findings(spark, sf_dir))


@query("sarif_level", f"SELECT severity, {LEVEL_SQL} AS level, count(*) AS n FROM {FINDINGS_SQL} f GROUP BY severity")
def sarif_level(spark, sf_dir):
    return findings(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n")).select("severity", N.sarif_level(F.col("severity")).alias("level"), "n")


@query("sarif_rule_id", f"SELECT seq, {RULE_SQL} AS rule_id, coalesce(nullif(pattern, ''), title) AS rule_name FROM {FINDINGS_SQL} f")
def sarif_rule_id(spark, sf_dir):
    c = F.col
    return findings(spark, sf_dir).select("seq", N.rule_id(c("category"), c("detection"), c("pattern")).alias("rule_id"), N.rule_name(c("pattern"), c("title")).alias("rule_name"))


@query("slug", f"SELECT doc_id, {SLUG.format('text')} AS slug FROM documents")
def slug(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", N.slug(F.col("text")).alias("slug"))


@query("sarif_rules", f"SELECT rule_id, rule_name, explanation, category, cwe, owasp, level FROM (SELECT *, {RULE_SQL} AS rule_id, coalesce(nullif(pattern, ''), title) AS rule_name, {LEVEL_SQL} AS level FROM {FINDINGS_SQL} f) QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY seq) = 1")
def sarif_rules(spark, sf_dir):
    return report.sarif_rules(findings(spark, sf_dir))


@query("sarif_results", f"SELECT seq, {RULE_SQL} AS rule_id, {LEVEL_SQL} AS level, title AS message, file_path AS uri, line_start AS start_line, CASE WHEN line_end > line_start THEN line_end END AS end_line, content_hash AS fingerprint FROM {FINDINGS_SQL} f")
def sarif_results(spark, sf_dir):
    return report.sarif_results(findings(spark, sf_dir))


@query("fixable_findings", f"SELECT seq, category FROM {FINDINGS_SQL} f WHERE category NOT IN ('secrets', 'sql-injection', 'command-injection', 'ssrf', 'missing-auth', 'broken-access')")
def fixable_findings(spark, sf_dir):
    return report.fixable(findings(spark, sf_dir)).select("seq", "category")


_ASCII = "(SELECT doc_id, regexp_replace(text, '[^ -~]', '?', 'g') AS t FROM documents)"


def _ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^ -~]", "?").alias("t"))


@query("snippet_truncate", f"SELECT doc_id, CASE WHEN strlen(t) > 100 THEN concat(left(t, 100), '…') ELSE t END AS snippet FROM {_ASCII} d")
def snippet_truncate(spark, sf_dir):
    return _ascii(spark, sf_dir).select("doc_id", X.snippet(F.col("t"), 100).alias("snippet"))


@query("cell_truncate", f"SELECT doc_id, CASE WHEN strlen(t) > 28 THEN concat(left(t, 27), '…') ELSE t END AS cell, left(t, 1) AS one, left(t, 0) AS none FROM {_ASCII} d")
def cell_truncate(spark, sf_dir):
    return _ascii(spark, sf_dir).select("doc_id", X.cell(F.col("t"), 28).alias("cell"), X.cell(F.col("t"), 1).alias("one"), X.cell(F.col("t"), 0).alias("none"))


#: Whole texts, and the titles of findings.
_WHOLE_SQL = "(SELECT 'document' AS origin, doc_id AS id, text AS t FROM documents UNION ALL SELECT 'title', event_id, concat('Found in ', event_type) FROM events)"
_WHOLE_ASCII_SQL = "(SELECT origin, id, regexp_replace(t, '[^ -~]', '?', 'g') AS t FROM " + _WHOLE_SQL + " w)"


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select(F.lit("document").alias("origin"), F.col("doc_id").alias("id"), F.col("text").alias("t"))
    return documents.unionByName(findings(spark, sf_dir).select(F.lit("title").alias("origin"), F.col("seq").alias("id"), F.col("title").alias("t")))


def _whole_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whole(spark, sf_dir).withColumn("t", F.regexp_replace("t", "[^ -~]", "?"))


@query("slug_whole", f"SELECT origin, id, {SLUG.format('t')} AS slug FROM {_WHOLE_SQL} w")
def slug_whole(spark, sf_dir):
    return _whole(spark, sf_dir).select("origin", "id", N.slug(F.col("t")).alias("slug"))


@query("snippet_whole", f"SELECT origin, id, CASE WHEN strlen(t) > 100 THEN concat(left(t, 100), '…') ELSE t END AS snippet FROM {_WHOLE_ASCII_SQL} d")
def snippet_whole(spark, sf_dir):
    return _whole_ascii(spark, sf_dir).select("origin", "id", X.snippet(F.col("t"), 100).alias("snippet"))


@query("cell_whole", f"SELECT origin, id, CASE WHEN strlen(t) > 28 THEN concat(left(t, 27), '…') ELSE t END AS cell, left(t, 1) AS one, left(t, 0) AS none FROM {_WHOLE_ASCII_SQL} d")
def cell_whole(spark, sf_dir):
    return _whole_ascii(spark, sf_dir).select("origin", "id", X.cell(F.col("t"), 28).alias("cell"), X.cell(F.col("t"), 1).alias("one"), X.cell(F.col("t"), 0).alias("none"))


# ---- paths, patches, remotes


_SEGMENTS = "list_filter(string_split(path, '/'), lambda s: s NOT IN ('', '.'))"
_LOW = f"coalesce(list_min(list_transform(range(1, len({_SEGMENTS}) + 1), lambda i: list_sum(list_transform({_SEGMENTS}[1:i], lambda s: CASE WHEN s = '..' THEN -1 ELSE 1 END)))), 0)"
PROBLEM_SQL = f"CASE WHEN path = '' THEN 'empty' WHEN starts_with(path, '/') THEN 'absolute' WHEN path[2] = ':' THEN 'drive' WHEN contains(path, chr(92)) THEN 'backslash' WHEN {_LOW} < 0 THEN 'escapes' END"


@query("path_validate", f"SELECT path, problem IS NULL AS ok, problem FROM (SELECT path, {PROBLEM_SQL} AS problem FROM {rows_sql('paths')} p)")
def path_validate(spark, sf_dir):
    problem = P.path_problem(F.col("path"))
    return rows(spark, sf_dir, "paths").select("path", problem.isNull().alias("ok"), problem.alias("problem"))


#: An absolute path without dots and double slashes, built segment by segment; a relative one stays.
_CLEAN = f"CASE WHEN starts_with(path, '/') THEN list_reduce(list_prepend('', {_SEGMENTS}), lambda done, s: CASE WHEN s = '..' THEN regexp_replace(done, '/[^/]*$', '') ELSE concat(done, '/', s) END) ELSE path END"
_SYSTEM = " OR ".join(f"starts_with(clean, '{p}')" for p in P.SYSTEM_PREFIXES)


@query("sarif_path_guard", f"SELECT path, path <> '' AND NOT ({_SYSTEM}) AS ok FROM (SELECT path, {_CLEAN} AS clean FROM {rows_sql('report_paths')} p)")
def sarif_path_guard(spark, sf_dir):
    return rows(spark, sf_dir, "report_paths").select("path", P.report_path_allowed(F.col("path")).alias("ok"))


TRIM_SQL = f"regexp_replace({{}}, '^[{X.SPACE}]+|[{X.SPACE}]+$', '', 'g')"
#: Any https address that can be read as one; http only where the host is this machine.
_HOST = "split_part(split_part(split_part(substr(rest, 3), '/', 1), '?', 1), '#', 1)"
_BARE_HOST = "regexp_replace(authority, '^.*@', '')"
_URL_SQL = f"""
(SELECT url, scheme, rest, path, bare, {_BARE_HOST} AS host_port FROM
 (SELECT url, bare, scheme, rest, CASE WHEN starts_with(rest, '//') THEN {_HOST} ELSE '' END AS authority,
         regexp_extract(regexp_extract(rest, '^(//)?[^/?#]*([^?#]*)', 2), '.*') AS path FROM
  (SELECT url, bare, lower(regexp_extract(bare, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, regexp_replace(bare, '^[A-Za-z][A-Za-z0-9+.-]*:', '') AS rest
   FROM (SELECT url, {TRIM_SQL.format('url')} AS bare FROM (SELECT url FROM {fixtures.sql('urls')} u UNION ALL SELECT url FROM pages)))))
"""
_URL_BROKEN = "(regexp_matches(bare, '[\\x00-\\x1F\\x7F]') OR (starts_with(rest, '/') AND regexp_matches(path, '%([^0-9A-Fa-f]|$|[0-9A-Fa-f]([^0-9A-Fa-f]|$))')) OR (starts_with(rest, '//') AND NOT regexp_full_match(host_port, '([[][0-9A-Fa-f:.]*[]]|[^ :@%<>\\[\\]^`{|}\\\\]*)(:[0-9]*)?')))"


@query("url_guard", f"SELECT url, NOT {_URL_BROKEN} AND (scheme = 'https' OR (scheme = 'http' AND starts_with(rest, '//') AND regexp_replace(host_port, ':[0-9]*$', '') IN ('localhost', '127.0.0.1', '[::1]'))) AS ok FROM {_URL_SQL} u")
def url_guard(spark, sf_dir):
    both = fixtures.table(spark, "urls").unionByName(read(spark, sf_dir, "pages").select("url"))
    return both.select("url", P.url_allowed(F.col("url")).alias("ok"))


@query("base_url", f"SELECT url, rtrim(url, '/') AS base FROM (SELECT url FROM {fixtures.sql('urls')} u UNION ALL SELECT concat(url, '//') FROM pages)")
def base_url(spark, sf_dir):
    both = fixtures.table(spark, "urls").unionByName(read(spark, sf_dir, "pages").select(F.concat("url", F.lit("//")).alias("url")))
    return both.select("url", P.base_url(F.col("url")).alias("base"))


@query("or_default", f"SELECT origin, root, coalesce(nullif({TRIM_SQL.format('origin')}, ''), root) AS value FROM {rows_sql('origins')} o")
def or_default(spark, sf_dir):
    return rows(spark, sf_dir, "origins").select("origin", "root", X.or_default(F.col("origin"), F.col("root")).alias("value"))


@query("store_count", f"SELECT count(*) AS n, count(DISTINCT rel_path) AS files FROM {CHUNKS_SQL} c")
def store_count(spark, sf_dir):
    """Rows and files of a store that all chunks were put into at once."""
    return chunks(spark, sf_dir).agg(F.count("*").alias("n"), F.count_distinct("rel_path").alias("files"))


@query("store_count_all", f"SELECT count(*) AS n, count(DISTINCT rel_path) AS files FROM {CHUNKS_SQL} c")
def store_count_all(spark, sf_dir):
    """The store once all documents are in it."""
    return index.upserted(stored(spark, sf_dir), chunks(spark, sf_dir)).agg(F.count("*").alias("n"), F.count_distinct("rel_path").alias("files"))


@query("origin_base", f"SELECT origin, CASE WHEN starts_with(b, 'git@') AND contains(b, ':') THEN substr(b, instr(b, ':') + 1) WHEN len(string_split(b, '/')) >= 2 THEN concat(string_split(b, '/')[-2], '/', string_split(b, '/')[-1]) ELSE '' END AS base FROM (SELECT origin, regexp_replace({TRIM_SQL.format('origin')}, '[.]git$', '') AS b FROM {rows_sql('origins')} o)")
def origin_base(spark, sf_dir):
    return rows(spark, sf_dir, "origins").select("origin", P.origin_base(F.col("origin")).alias("base"))


@query("project_key", f"SELECT origin, root, left(sha256(coalesce(nullif({TRIM_SQL.format('origin')}, ''), concat('root:', root))), 16) AS project_key FROM {rows_sql('origins')} o")
def project_key(spark, sf_dir):
    return rows(spark, sf_dir, "origins").select("origin", "root", P.project_key(F.col("origin"), F.col("root")).alias("project_key"))


_PATCH_LINES = f"(SELECT patch_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT patch_id, string_split(patch, chr(10)) AS ls FROM {rows_sql('patches')} p))"
_TOUCHED = f"(SELECT patch_id, path, CAST(min(pos) AS INT) AS first_pos FROM (SELECT patch_id, pos, {TRIM_SQL.format("regexp_replace(regexp_replace(line[5:], '^b/', ''), '^([^' || chr(9) || ']+)' || chr(9) || '(.|[' || chr(13) || '])*$', '\\1')")} AS path FROM {_PATCH_LINES} l WHERE starts_with(line, '+++ ')) WHERE path NOT IN ('', '/dev/null') GROUP BY ALL)"


@query("patch_files", f"SELECT patch_id, path, first_pos, bool_or({PROBLEM_SQL} IS NOT NULL) OVER (PARTITION BY patch_id) AS unsafe FROM {_TOUCHED} t")
def patch_files(spark, sf_dir):
    return patches.patch_files(patches.usable(rows(spark, sf_dir, "patches")))


@query("patch_verdicts", f"SELECT p.patch_id, coalesce(n, 0) AS n_files, CASE WHEN {TRIM_SQL.format('patch')} = '' THEN 'empty' WHEN n IS NULL THEN 'touches no files' WHEN unsafe THEN 'unsafe path' ELSE 'ok' END AS verdict FROM {rows_sql('patches')} p LEFT JOIN (SELECT patch_id, count(*) AS n, bool_or({PROBLEM_SQL} IS NOT NULL) AS unsafe FROM {_TOUCHED} t GROUP BY patch_id) f ON p.patch_id = f.patch_id")
def patch_verdicts(spark, sf_dir):
    return patches.verdicts(rows(spark, sf_dir, "patches"))


@query("patch_applies", f"""
SELECT CAST(doc_id AS VARCHAR) AS patch_id, CASE WHEN bad THEN 'doesn''t apply' ELSE 'ok' END AS verdict, CASE WHEN bad THEN named END AS path, CASE WHEN bad THEN line END AS line
FROM (SELECT doc_id, named, doc_id % 13 = 5 AND named = rel_path OR doc_id % 13 <> 5 AND (named <> rel_path OR first_bad OR second_bad) AS bad,
             CAST(CASE WHEN doc_id % 13 = 5 THEN 0 WHEN named <> rel_path OR first_bad THEN shown ELSE shown + 1 END AS INT) AS line
      FROM (SELECT *, ls[shown] IS DISTINCT FROM ls[spot] AS first_bad, ls[shown + 1] IS DISTINCT FROM concat(ls[spot + 1], CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END) AS second_bad FROM {_FILE_LINES_SQL} l))""")
def patch_applies(spark, sf_dir):
    """Patches made from every document, held against the files that the documents are."""
    return patches.applicable(document_patches(spark, sf_dir), files(spark, sf_dir).select(F.col("rel_path").alias("path"), "text"))


@query("patch_line_stats", f"SELECT patch_id, CASE WHEN starts_with(line, '+++') OR starts_with(line, '---') OR starts_with(line, 'diff ') THEN 'header' WHEN starts_with(line, '+') THEN 'add' WHEN starts_with(line, '-') THEN 'delete' ELSE 'other' END AS kind, count(*) AS n FROM {_PATCH_LINES} l GROUP BY ALL")
def patch_line_stats(spark, sf_dir):
    return patches.patch_line_stats(rows(spark, sf_dir, "patches"))


@query("backup_plan", f"SELECT patch_id, t.path, CASE WHEN e.path IS NULL THEN 'mark_absent' ELSE 'copy' END AS action, CASE WHEN e.path IS NULL THEN concat(t.path, '.was-absent') ELSE t.path END AS target FROM {_TOUCHED} t LEFT JOIN {rows_sql('existing')} e ON t.path = e.path")
def backup_plan(spark, sf_dir):
    return patches.backup_plan(patches.patch_files(rows(spark, sf_dir, "patches")), rows(spark, sf_dir, "existing"))


@query("latest_backup", f"SELECT max(name) AS name FROM {rows_sql('backups')} b WHERE starts_with(name, '.backup-')")
def latest_backup(spark, sf_dir):
    return patches.latest_backup(rows(spark, sf_dir, "backups"), scan.BACKUP_PREFIX)


_PLAN = f"(SELECT rel_path, CASE WHEN ends_with(rel_path, '.was-absent') THEN 'delete' ELSE 'restore' END AS action, CASE WHEN ends_with(rel_path, '.was-absent') THEN rel_path[:-12] ELSE rel_path END AS target FROM {rows_sql('entries')} e)"


@query("restore_plan", f"SELECT * FROM {_PLAN} p")
def restore_plan(spark, sf_dir):
    return patches.restore_plan(rows(spark, sf_dir, "entries"))


@query("restore_counts", f"SELECT count(*) FILTER (WHERE action = 'restore') AS restored, count(*) FILTER (WHERE action = 'delete') AS deleted FROM {_PLAN} p")
def restore_counts(spark, sf_dir):
    return patches.restore_counts(patches.restore_plan(rows(spark, sf_dir, "entries")))


@query("source_mismatch", f"SELECT a, b, a <> '' AND b <> '' AND lower(a) <> lower(b) AS mismatch FROM {rows_sql('sources')} s")
def source_mismatch(spark, sf_dir):
    return rows(spark, sf_dir, "sources").select("a", "b", patches.source_mismatch(F.col("a"), F.col("b")).alias("mismatch"))


_SECONDS = "CAST(floor((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 1000000) AS BIGINT)"


_AGE = "CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN concat(s // 60, 'm ago') WHEN s < 86400 THEN concat(s // 3600, 'h ago') WHEN s < 2592000 THEN concat(s // 86400, 'd ago') ELSE strftime(ts, '%Y-%m-%d') END"


@query("relative_age", f"SELECT event_id, {_AGE} AS age, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp FROM (SELECT event_id, ts, {_SECONDS} AS s FROM events)")
def relative_age(spark, sf_dir):
    as_of = F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00"))
    return read(spark, sf_dir, "events").select("event_id", X.relative_age(F.col("ts"), as_of).alias("age"), X.compact_utc(F.col("ts")).alias("stamp"))


_BODY = """
CASE event_id % 8 WHEN 0 THEN concat('{"ok":true,"data":', props, '}') WHEN 1 THEN concat('{"ok":false,"error":{"code":"rate","message":"slow down ', CAST(event_id AS STRING), '"}}') WHEN 2 THEN '{"ok":false}' WHEN 3 THEN concat('not json ', props)
     WHEN 4 THEN concat('{"OK":true,"Data":', props, '}') WHEN 5 THEN concat('{"ok":"true","data":', props, '}') WHEN 6 THEN '{"ok":true}' ELSE concat('{"error":{"Code":"c', CAST(event_id AS STRING), '","message":null}}') END
"""
_BODIES_SQL = f"(SELECT event_id, {_BODY.replace('STRING', 'VARCHAR')} AS body FROM events UNION ALL SELECT -1, body FROM {fixtures.sql('bodies')} x)"
_ANY_CASE = "coalesce({0}->'$.{1}', {0}->'$.{2}', {0}->'$.{3}')"
_OF_KIND = "({0} IS NULL OR json_type({0}) IN ('{1}', 'NULL'))"


@query("json_envelope", f"""
WITH b AS (SELECT event_id, body, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM {_BODIES_SQL} x),
m AS (SELECT *, {_ANY_CASE.format('j', 'ok', 'OK', 'Ok')} AS o, {_ANY_CASE.format('j', 'error', 'ERROR', 'Error')} AS e, {_ANY_CASE.format('j', 'data', 'Data', 'DATA')} AS d FROM b),
k AS (SELECT *, {_ANY_CASE.format('e', 'code', 'Code', 'CODE')} AS c, {_ANY_CASE.format('e', 'message', 'MESSAGE', 'Message')} AS t FROM m),
r AS (SELECT *, CASE WHEN j IS NULL OR json_type(j) NOT IN ('OBJECT', 'NULL') OR NOT ({_OF_KIND.format('o', 'BOOLEAN')} AND {_OF_KIND.format('e', 'OBJECT')} AND {_OF_KIND.format('c', 'VARCHAR')} AND {_OF_KIND.format('t', 'VARCHAR')}) THEN 'invalid'
  WHEN coalesce(o->>'$', 'false') <> 'true' THEN CASE WHEN e IS NULL OR json_type(e) = 'NULL' THEN 'unknown error' ELSE concat(c->>'$', ': ', t->>'$') END WHEN d IS NULL THEN 'no data' ELSE 'ok' END AS outcome FROM k)
SELECT event_id, body, CASE WHEN outcome <> 'invalid' THEN coalesce(o->>'$', 'false') = 'true' END AS ok, CASE WHEN outcome = 'ok' THEN CAST(d->>'$.k' AS BIGINT) END AS k, outcome FROM r""")
def json_envelope(spark, sf_dir):
    """Answers of all shapes, made of the events' properties, and the typed ones."""
    bodies = read(spark, sf_dir, "events").select("event_id", F.expr(_BODY).alias("body")).unionByName(fixtures.table(spark, "bodies").select(F.lit(-1).cast("long").alias("event_id"), "body"))
    return remote.envelopes(bodies).select("event_id", "body", "ok", F.get_json_object("data", "$.k").try_cast("long").alias("k"), "outcome")


_STAMPED = "CASE event_id % 6 WHEN 0 THEN concat({0}, 'Z') WHEN 1 THEN concat({0}, '-05:00') WHEN 2 THEN concat({0}, '.123456789+02:00') WHEN 3 THEN replace({0}, 'T', ' ') WHEN 4 THEN left({0}, 4) ELSE concat({0}, ',5Z') END"


@query("relative_age_text", f"""
SELECT event_id, iso, CASE WHEN event_id % 6 IN (3, 4) THEN iso WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN concat(s // 60, 'm ago') WHEN s < 86400 THEN concat(s // 3600, 'h ago') WHEN s < 2592000 THEN concat(s // 86400, 'd ago') ELSE left(iso, 10) END AS age
FROM (SELECT event_id, {_STAMPED.format("strftime(ts, '%Y-%m-%dT%H:%M:%S')")} AS iso, CAST(floor((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(date_trunc('second', ts)) - CASE event_id % 6 WHEN 1 THEN 18000000000 WHEN 2 THEN 123456 - 7200000000 WHEN 5 THEN 500000 ELSE 0 END) / 1000000.0) AS BIGINT) AS s FROM events)""")
def relative_age_text(spark, sf_dir):
    """Ages of stamps as text: with offsets, fractions, and ones that aren't stamps."""
    plain = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"
    stamped = read(spark, sf_dir, "events").select("event_id", F.expr(_STAMPED.format(plain)).alias("iso"))
    return stamped.withColumn("age", X.relative_age_of_text(F.col("iso"), F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00"))))


@query("proposed_fixes", "SELECT fix_id, status FROM (SELECT event_id AS fix_id, CASE event_id % 3 WHEN 0 THEN 'proposed' WHEN 1 THEN 'applied' ELSE 'closed' END AS status FROM events) WHERE status = 'proposed' ORDER BY fix_id LIMIT 20")
def proposed_fixes(spark, sf_dir):
    fixes = read(spark, sf_dir, "events").select(F.col("event_id").alias("fix_id"), F.expr("CASE event_id % 3 WHEN 0 THEN 'proposed' WHEN 1 THEN 'applied' ELSE 'closed' END").alias("status"))
    return remote.proposed_fixes(fixes)


@query("recent_runs", f"SELECT event_id AS run_id, {_AGE} AS age, concat('a rather long project name ', '…') AS project, 'done' AS status, CASE WHEN event_id % 2 = 0 THEN '-' ELSE event_type END AS branch, event_id % 9 AS findings, event_id % 4 AS fixes FROM (SELECT *, {_SECONDS} AS s FROM events ORDER BY ts DESC, event_id LIMIT 5)")
def recent_runs(spark, sf_dir):
    return remote.recent_runs(_runs(spark, sf_dir), F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00")))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"), F.col("ts").alias("created_at"), F.lit("a rather long project name that goes on").alias("project"), F.lit("done").alias("status"),
        F.when(F.col("event_id") % 2 == 0, "").otherwise(F.col("event_type")).alias("branch"), (F.col("event_id") % 9).alias("findings"), (F.col("event_id") % 4).alias("fixes"),
    )


@query("recent_fixes", f"SELECT {_AGE} AS age, 'a rather long project n…' AS project, concat('#', event_id) AS number, CASE event_id % 2 WHEN 0 THEN 'merged' ELSE 'open' END AS status, concat('Found in ', event_type) AS title FROM (SELECT *, {_SECONDS} AS s FROM events ORDER BY ts DESC, event_id LIMIT 5)")
def recent_fixes(spark, sf_dir):
    return remote.recent_fixes(_fixes(spark, sf_dir), F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00")))


def _fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("fix_id"), F.col("ts").alias("created_at"), F.lit("a rather long project name that goes on").alias("project"),
        F.when(F.col("event_id") % 2 == 0, "merged").otherwise("open").alias("status"), F.concat(F.lit("Found in "), "event_type").alias("title"),
    )


_LATEST = "(SELECT *, row_number() OVER (ORDER BY ts DESC, event_id) AS place, {seconds} AS s FROM events ORDER BY ts DESC, event_id LIMIT 5)".format(seconds=_SECONDS)
_CELLS = {
    "Recent runs": (3, ["WHEN", "PROJECT", "STATUS", "BRANCH", "FINDINGS", "FIXES"], [_AGE, "concat('a rather long project name ', '…')", "'done'", "CASE WHEN event_id % 2 = 0 THEN '-' ELSE event_type END", "CAST(event_id % 9 AS VARCHAR)", "CAST(event_id % 4 AS VARCHAR)"]),
    "Recent fix PRs": (205, ["WHEN", "PROJECT", "PR", "STATUS", "TITLE"], [_AGE, "'a rather long project n…'", "concat('#', event_id)", "CASE event_id % 2 WHEN 0 THEN 'merged' ELSE 'open' END", "concat('Found in ', event_type)"]),
}


def _page_sql(title: str) -> str:
    at, heads, cells = _CELLS[title]
    names = [f"c{k}" for k in range(len(heads))]
    rows_ = "SELECT 0 AS place, " + ", ".join(f"'{'  ' * (k == 0)}{h}' AS c{k}" for k, h in enumerate(heads)) + " UNION ALL SELECT place, " + ", ".join(f"concat('{'  ' * (k == 0)}', {c})" for k, c in enumerate(cells)) + f" FROM {_LATEST} e"
    padded = ", ".join(f"rpad({n}, CAST(max(length({n})) OVER () + 2 AS INT), ' ')" for n in names[:-1])
    return f"SELECT {at} AS pos, '{title}:' AS line UNION ALL SELECT CAST(place + {at + 1} AS INT), concat({padded}, {names[-1]}) FROM ({rows_})"


@query("status_page", f"SELECT * FROM (VALUES (0, 'Logged in as me@team.example'), (1, 'Org: Team · plan: small  (suspended)'), (2, ''), (105, '')) v(pos, line) UNION ALL {_page_sql('Recent runs')} UNION ALL {_page_sql('Recent fix PRs')}")
def status_page(spark, sf_dir):
    """The lines of a status page over all events as runs and as changes."""
    who = spark.createDataFrame([("me@team.example", "Team", "small", True)], "email string, org string, plan string, suspended boolean")
    return remote.status_page(who, _runs(spark, sf_dir), _fixes(spark, sf_dir), F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00")))


@query("model_readiness", f"SELECT w.name, k IS NOT NULL AS ready, CASE WHEN k IS NULL THEN concat('the model server at http://localhost:1 has no model ', w.name, ': pull it first') END AS message FROM {rows_sql('wanted')} w LEFT JOIN (SELECT DISTINCT regexp_replace(name, ':latest$', '') AS k FROM {rows_sql('offered')} o) o ON regexp_replace(w.name, ':latest$', '') = k")
def model_readiness(spark, sf_dir):
    return remote.readiness(rows(spark, sf_dir, "wanted"), rows(spark, sf_dir, "offered"), "http://localhost:1")


@query("model_available", f"SELECT name FROM {rows_sql('wanted')} w WHERE regexp_replace(name, ':latest$', '') IN (SELECT regexp_replace(name, ':latest$', '') FROM {rows_sql('offered')} o)")
def model_available(spark, sf_dir):
    return remote.available_models(rows(spark, sf_dir, "wanted"), rows(spark, sf_dir, "offered"))
