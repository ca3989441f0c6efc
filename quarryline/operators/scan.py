"""Which files of a tree take part: columns of (rel_path, size)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators import ordering

# Folders that are never entered, and the language of each extension.
SKIPPED = (".git", "node_modules", ".next", ".turbo", ".cache", "dist", "build", ".venv", "venv", "__pycache__", "vendor", "target")
LANGUAGES = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".py": "python", ".go": "go", ".rs": "rust", ".java": "java", ".kt": "kotlin", ".rb": "ruby", ".php": "php", ".cs": "csharp",
    ".swift": "swift", ".sql": "sql", ".md": "markdown", ".sh": "shell", ".yaml": "yaml", ".yml": "yaml", ".json": "json",
}
MAX_FILE_BYTES = 524_288
MAX_TOTAL_BYTES = 20_000_000
BACKUP_PREFIX = ".backup-"


def pruned(path: Column, backup_prefix: str = BACKUP_PREFIX) -> Column:
    """True below a skipped folder or a backup folder."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.exists(folders, lambda d: d.isin(*SKIPPED) | d.startswith(backup_prefix))


def language(path: Column) -> Column:
    """By the last suffix of the name, in any case; null for others."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)))


def eligible(files: DataFrame, backup_prefix: str = BACKUP_PREFIX) -> DataFrame:
    """Files outside skipped folders, of a known language, of at most ``MAX_FILE_BYTES``; adds ``language``."""
    return files.where(~pruned(F.col("rel_path"), backup_prefix) & (F.col("size") <= MAX_FILE_BYTES)).withColumn("language", language(F.col("rel_path"))).where("language is not null")


def total_cap(files: DataFrame, most: int = MAX_TOTAL_BYTES) -> DataFrame:
    """Files in path order until ``most`` bytes are reached, with ``total_bytes``; the file that passes the bound is left out, with all after it. Files without a path are left out."""
    return ordering.running(files, "rel_path", [], F.col("size"), "total_bytes").where(F.col("total_bytes") <= most)
