"""A corpus pipeline of five operators: quality, lines, near copies, mix, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept;
all but the last return the columns of ``documents``.

In every stage a null text is a text without words that stays null where the row stays, an
empty table gives an empty result, other columns of the input are left out, and columns
that an operator adds clash with none of ``documents``. Texts are taken whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm import bpe, line_dedup, minhash, mixing, quality, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _documents(df: DataFrame) -> DataFrame:
    """The columns of ``documents``; n_chars counts the text as it is now (null stays null)."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from those of ``labels`` that aren't held out.

    Null and empty texts share one score, repeated rows theirs, so equal rows all stay or all go.
    """
    return _documents(quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier place has too. A document that loses all its lines goes; one that had none stays.

    Earlier is by (doc_id, position), rows without doc_id last. Rows equal in id and text
    count as one place and get one result.
    """
    out = line_dedup.remove_repeated_lines(docs)
    return _documents(out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies.

    Null, empty and wordless texts are near nothing and stay, as do rows without doc_id.
    Rows equal in id and text all stay or all go.
    """
    return _documents(minhash.keep_first(docs))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each round in which words of a document are taken, with these words.

    Documents without words, null texts among them, go, for nothing is taken of them. A
    null source is a source of its own. Repeated rows are taken like any two rows.
    """
    return _documents(mixing.taken_documents(mixing.mix_sources(docs)))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers), their number, and the digest of the text decoded from them.

    A null or empty text has no ids; repeated rows get the same ids.
    """
    out = bpe.encode(docs.select("doc_id", "source", "text"), TOKENIZER, decoded="decoded")
    return out.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicate documents", near_copy_stage),
    ("source mix", mix_stage),
    ("token encoding", token_stage),
]

#: No stage but the mix can be put in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and reread as the next one's documents.

    A stage's own tables go once its result is written, and a result once the next one is.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch.passing(spark):
            made = stage(spark, docs, sf_dir)
            path = scratch.write(made, name.replace(" ", "-"), kept=True)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            scratch.drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
