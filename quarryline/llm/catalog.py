"""The driver's queries over whole tables, one for each numbered operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import bpe, byte_bpe, conversations, embedding_dedup, hashing_search, line_dedup, minhash, mixing, phrases, quality, secretscan, sharding, substring_dedup

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 shards of near-equal bytes."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs, shards=16).select(
        "doc_id", "size", F.crc32(F.col("text").cast("binary")).cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    out = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER, decoded="decoded")
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_spherical_kmeans_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all vectors."""
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), least=0.9)


def op4_setsketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of weights 3, 1, 2 takes of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op6_segment_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier place has too."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.remove_repeated_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op7_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, as counts and spans."""
    found = secretscan.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("findings", lambda f: f["kind"] != "entropy")
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secretscan.spans_text(base), 256).alias("base_sha256"), secretscan.spans_text(F.col("findings")).alias("spans"))


def op8_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.LEAST).cast("int").alias("predicted"))


def op9_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every row whose vec_id is divisible by 20."""
    rows = _table(spark, sf_dir, "embeddings")
    return hashing_search.nearest(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier place has too."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select("doc_id", "n_sentences", "n_removed", "removed_words", "removed", "text")


def op11_count_min_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 collocations of all documents."""
    return phrases.collocations(_table(spark, sf_dir, "documents").select("text", "lang"))


def op12_earley_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, its cheapest repair and the digest of what is repaired."""
    rows = _table(spark, sf_dir, "conversations")
    summary, lines = conversations.repair(conversations.damaged(rows))
    same = lambda other: F.col("conv_id").eqNullSafe(F.col(other))
    every = rows.select("conv_id").distinct().join(summary.withColumnRenamed("conv_id", "__s"), same("__s"), "left")
    every = every.join(conversations.digests(lines).withColumnRenamed("conv_id", "__d"), same("__d"), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_monoid_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's byte-level ids and of the bytes decoded from them."""
    out = byte_bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), RANKS, decoded="decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_histogram_sort": op1_histogram_sort,
        "op2_segment_tree_bpe": op2_segment_tree_bpe,
        "op3_spherical_kmeans_dedup": op3_spherical_kmeans_dedup,
        "op4_setsketch_near_duplicates": op4_setsketch_near_duplicates,
        "op5_sainte_lague": op5_sainte_lague,
        "op6_segment_line_dedup": op6_segment_line_dedup,
        "op7_entropy_secrets": op7_entropy_secrets,
        "op8_random_indexing_quality": op8_random_indexing_quality,
        "op9_multi_index_hashing": op9_multi_index_hashing,
        "op10_sentence_spans": op10_sentence_spans,
        "op11_count_min_phrases": op11_count_min_phrases,
        "op12_earley_repair": op12_earley_repair,
        "op13_monoid_byte_bpe": op13_monoid_byte_bpe,
    }


#: Links of (a, b) both ways -> the smallest id reachable from each id.
_COMPONENTS = """
reach(id, other) AS (SELECT a, b FROM edges UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.other = e.a),
least_of AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
"""

VECTORS_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
good AS (SELECT * FROM v WHERE len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
edges AS (SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.9),
links AS (SELECT a, count(*) AS n FROM edges GROUP BY a),
{_COMPONENTS}
SELECT v.vec_id, coalesce(n, 0) AS n_links, coalesce(component, v.vec_id) AS component_id, coalesce(component, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN links ON v.vec_id = a LEFT JOIN least_of ON v.vec_id = id
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
DOCUMENTS_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS s FROM w),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
each AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM each p JOIN each q ON p.shingle = q.shingle AND p.doc_id <> q.doc_id GROUP BY ALL),
edges AS (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
{_COMPONENTS}
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM sizes LEFT JOIN least_of ON doc_id = id
"""

PHRASES_SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM p),
t AS (SELECT lang, CAST(sum(len(words)) AS HUGEINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, words, unnest(range(1, len(words) - k + 2)) AS i FROM (SELECT lang, words, unnest(range(1, 6)) AS k FROM w)),
f AS (SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k >= 2),
s AS (SELECT c.lang, c.phrase, c.a, cut, x.a AS l, y.a AS r, t.n, (CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(x.a AS HUGEINT) * y.a) AS score
      FROM c JOIN t USING (lang) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1 : cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1 : c.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS f FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, string_split(phrase, ' ') AS w, a, k, unnest(range(2, k)) AS m FROM f WHERE k >= 3)) GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN longer USING (lang, phrase) WHERE f IS NULL OR 100 * f < 100 * a)
SELECT lang, CAST(row_number() OVER o AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept WINDOW o AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER o <= 2000
"""


def oracle_sql() -> dict[str, str]:
    """The queries whose whole result SQL can give at table size; the others are tested against brute force."""
    return {"op3_spherical_kmeans_dedup": VECTORS_SQL, "op4_setsketch_near_duplicates": DOCUMENTS_SQL, "op11_count_min_phrases": PHRASES_SQL}
