"""Column expressions on paths, addresses and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryline.functions.text import trimmed

# Folders of the system that no report may be written to.
SYSTEM_PREFIXES = ("/etc/", "/bin/", "/sbin/", "/usr/bin/", "/usr/sbin/", "/boot/", "/proc/", "/sys/")


def path_problem(path: Column) -> Column:
    """Why a path isn't one inside the repository; null if it is one."""
    segments = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    depth = F.aggregate(
        segments,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda s, x: F.struct((s["at"] + F.when(x == "..", -1).otherwise(1)).alias("at"), F.least(s["low"], s["at"] + F.when(x == "..", -1).otherwise(1)).alias("low")),
        lambda s: s["low"],
    )
    return (
        F.when(path == "", "empty").when(path.startswith("/"), "absolute").when(F.substring(path, 2, 1) == ":", "drive")
        .when(path.contains("\\"), "backslash").when(depth < 0, "escapes")
    )


def report_path_allowed(path: Column) -> Column:
    """False for an empty path and for one below a folder of the system. Links are looked at when the file is written."""
    segments = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    clean = F.when(path.startswith("/"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)
    return (path != "") & ~F.exists(F.array(*map(F.lit, SYSTEM_PREFIXES)), lambda p: clean.startswith(p))


#: An address's user, host (in brackets or of characters that may stand in one) and port, up to the path.
AUTHORITY = r"(?:[A-Za-z0-9._:~!$&'()*+,;=%@-]*@)?(\[[0-9A-Fa-f:.]*\]|(?:[^\x00-\x20/?#@:\[\]\\^`{|}%\x7F]|%[89A-Fa-f][0-9A-Fa-f])*)(?::[0-9]*)?"


def url_allowed(url: Column) -> Column:
    """https to anywhere, http only to this machine; white space around doesn't count, and what can't be read as an address is refused."""
    bare = trimmed(url)
    scheme, rest = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*:([\s\S]*)$", 1)
    has_host = rest.startswith("//")
    host = F.regexp_replace(F.regexp_extract(rest, rf"^//{AUTHORITY}(?:[/?#][\s\S]*)?\z", 1), r"^\[|\]$", "")
    path = F.regexp_extract(rest, r"^(?://)?[^/?#]*([^?#]*)", 1)
    broken = bare.rlike(r"[\x00-\x1F\x7F]") | (has_host & ~rest.rlike(rf"^//{AUTHORITY}(?:[/?#]|\z)")) | (rest.startswith("/") & path.rlike(r"%(?![0-9A-Fa-f]{2})"))
    allowed = F.when(scheme == "https", True).when(scheme == "http", has_host & host.isin("localhost", "127.0.0.1", "::1")).otherwise(False)
    return F.coalesce(~broken & allowed, F.lit(False))


def origin_base(origin: Column) -> Column:
    """owner/repo of a remote's address; empty where it has none."""
    bare = F.regexp_replace(trimmed(origin), r"\.git\z", "")
    parts = F.split(bare, "/")
    last_two = F.when(F.size(parts) >= 2, F.concat_ws("/", F.get(parts, F.size(parts) - 2), F.get(parts, F.size(parts) - 1))).otherwise("")
    return F.when(bare.startswith("git@") & bare.contains(":"), F.regexp_extract(bare, r"^[^:]*:([\s\S]*)\z", 1)).otherwise(last_two)


def project_key(origin: Column, root: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the trimmed origin, or of the marked root."""
    return F.left(F.sha2(F.coalesce(F.nullif(trimmed(origin), F.lit("")), F.concat(F.lit("root:"), root)), 256), F.lit(16))


def base_url(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def model_key(name: Column) -> Column:
    """A model's name without the tag that is implied."""
    return F.regexp_replace(name, ":latest$", "")
