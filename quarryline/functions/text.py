"""Column expressions on text: lines, hashes, cuts, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: what counts as white space at the ends of a value, as a set of characters.
SPACE = "\t\n\v\f\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(value: Column) -> Column:
    """Without any white space at either end, line ends included."""
    return F.regexp_replace(value, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def lines(text: Column) -> Column:
    """Lines as a line scanner gives them: one carriage return at an end goes, and no empty line after a final line feed. Empty text: none."""
    parts = F.split(text, "\n", -1)
    parts = F.when(text == "", F.array().cast("array<string>")).when(text.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda line: F.when(line.endswith("\r"), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line))


def decoded(content: Column) -> Column:
    """The text of UTF-8 bytes; null if any byte sequence is invalid."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def content_hash(path: Column, language: Column, line_start: Column, line_end: Column, body: Column) -> Column:
    """SHA-256, in hex, of the four fields, each closed by a NUL, and the body."""
    return F.sha2(F.concat_ws("\0", path, language, line_start.cast("string"), line_end.cast("string"), body), 256)


def cut_bytes(text: Column, most: int) -> Column:
    """At most so many bytes of UTF-8; a character that is cut through becomes U+FFFD."""
    return F.when(F.octet_length(text) > most, F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string"))).otherwise(text)


def snippet(text: Column, most: int) -> Column:
    """More than ``most`` bytes: the first ones and an ellipsis."""
    return F.when(F.octet_length(text) > most, F.concat(cut_bytes(text, most), F.lit("…"))).otherwise(text)


def cell(text: Column, most: int) -> Column:
    """More than ``most`` bytes: all but one of them and an ellipsis; without room for it, just the first ``most``."""
    short = cut_bytes(text, max(most, 0)) if most <= 1 else F.concat(cut_bytes(text, most - 1), F.lit("…"))
    return F.when(F.octet_length(text) > most, short).otherwise(text)


def indent(text: Column, prefix: str) -> Column:
    """Every line prefixed, line feeds at the end dropped; empty text stays empty."""
    body = F.regexp_replace(text, r"\n+\z", "")
    return F.when(text == "", "").otherwise(F.concat(F.lit(prefix), F.replace(body, F.lit("\n"), F.lit("\n" + prefix))))


def relative_age(at: Column, as_of: Column, date: Column | None = None) -> Column:
    """"just now", minutes, hours or days before ``as_of``; from 30 days on the date, that of the session's zone where ``date`` doesn't give it."""
    seconds = F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 1_000_000)
    count = lambda unit, letter: F.concat(F.floor(seconds / unit).cast("long").cast("string"), F.lit(f"{letter} ago"))
    return (
        F.when(seconds < 60, "just now").when(seconds < 3600, count(60, "m")).when(seconds < 86_400, count(3600, "h"))
        .when(seconds < 30 * 86_400, count(86_400, "d")).otherwise(F.date_format(at, "yyyy-MM-dd") if date is None else date)
    )


#: A date, a time and an offset, as RFC 3339 has them.
STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})\z"


def relative_age_of_text(iso: Column, as_of: Column) -> Column:
    """As ``relative_age`` for an RFC 3339 stamp as text, whose date is that of its own offset; what isn't one stays."""
    at = F.when(iso.rlike(STAMP), F.try_to_timestamp(F.replace(iso, F.lit(","), F.lit("."))))
    return F.when(at.isNull(), iso).otherwise(relative_age(at, as_of, F.left(iso, F.lit(10))))


def compact_utc(at: Column) -> Column:
    """20240131T235959Z"""
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")


def or_default(value: Column, default: Column) -> Column:
    """The trimmed value, or the default where nothing is left."""
    return F.coalesce(F.nullif(trimmed(value), F.lit("")), default)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; empty text: 0."""
    chars = F.split(text, "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
    return F.when(text == "", 0.0).otherwise(-F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + share(c) * F.log2(share(c))))
