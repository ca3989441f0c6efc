"""Small relations for operators that the tables have no input for, as rows for Spark and as SQL values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarryline.functions.paths import SYSTEM_PREFIXES

_KEY = "A1b2C3d4E5f6G7h8J9k0"  # pieces only: no contiguous key shape stands in the repository


def _n(k: int) -> str:
    return (_KEY * 5)[:k]


def _paths() -> list[str]:
    """Repository paths of each class: plain, dotted, climbing by more or fewer steps than they are deep, rooted, with drives and backslashes."""
    names = ("one", "two.x", "th-ree", "fo_ur", "..five", "six.")
    deep = ["/".join(names[:n]) for n in range(1, len(names) + 1)]
    climbs = ["/".join([*names[:down], *[".."] * up, *names[:rest]]) for down in range(3) for up in range(1, 4) for rest in range(2)]
    roots = ["/", *("/" + p for p in deep[:2]), *(f"{drive}:{p}" for drive in "CQz" for p in ("/" + deep[1], deep[0], ""))]
    return [*deep, *climbs, *roots, *(p.replace("/", "\\") for p in (deep[1], "one/../../two")), "", ".", "./one", "one//two", "one/./two/", "./.."]


def _report_paths() -> list[str]:
    """Places for a report: relative ones, folders of users, and each folder of the system, plain and reached by detours."""
    name = "report.sarif"
    free = [name, f"./{name}", f"logs/today/{name}", f"/tmp/{name}", f"/home/someone/{name}", f"/usr/share/{name}", f"/opt/../srv/{name}", "../up.sarif", "/", ""]
    return [*free, *(f"{p}{name}" for p in SYSTEM_PREFIXES), *(f"/var/..{p}sub/{name}" for p in SYSTEM_PREFIXES), *(p.rstrip("/") for p in SYSTEM_PREFIXES), *(f"/.{p}/{name}" for p in SYSTEM_PREFIXES[:2])]


FIXTURES: dict[str, tuple[str, list[tuple]]] = {
    "secret_lines": ("line_id int, path string, line_no int, text string", [
        (1, "a.py", 1, "id = 'AK" + "IA" + "ABCDEFGH12345678'"), (2, "a.py", 2, "id = 'AK" + "IA" + "ABCDEFGH1234567'"),
        (3, "a.py", 3, "g = AI" + "za" + _n(35)), (4, "a.py", 4, "g = AI" + "za" + _n(34)),
        (5, "b.py", 1, "t = gh" + "p_" + _n(36)), (6, "b.py", 2, "t = gh" + "p_" + _n(35)),
        (7, "b.py", 3, "t = github" + "_pat_" + _n(82)), (8, "b.py", 4, "t = github" + "_pat_" + _n(81)),
        (9, "c.py", 1, "s = sk_" + "live_" + _n(24)), (10, "c.py", 2, "s = sk_" + "live_" + _n(23)),
        (11, "c.py", 3, "p = sk_" + "test_" + "0a" * 20), (12, "c.py", 4, "p = sk_" + "live_" + "0b" * 20), (13, "c.py", 5, "p = sk_" + "test_" + "0a" * 19),
        (14, "d.py", 1, "x = xox" + "b-" + "123456789012"), (15, "d.py", 2, "x = xox" + "b-" + "123"),
        (16, "d.py", 3, "a = sk-" + "ant-" + _n(24)), (17, "d.py", 4, "o = sk-" + _n(24)), (18, "d.py", 5, "o = sk-" + _n(10)),
        (19, "e.py", 1, "j = ey" + "J" + "abc.ey" + "J" + "def.ghi"), (20, "e.py", 2, "j = ey" + "J" + "abc.def"),
        (21, "e.py", 3, "g = S" + "G." + _n(22) + "." + _n(43)), (22, "e.py", 4, "g = S" + "G." + _n(21) + "." + _n(43)),
        (23, "f.py", 1, "HEROKU_KEY=01234567-" + "89ab-cdef-0123-456789abcdef"), (24, "f.py", 2, "id=01234567-" + "89ab-cdef-0123-456789abcdef"),
        (25, "f.py", 3, "-----BEGIN " + "RSA PRIVATE KEY-----"), (26, "f.py", 4, "-----BEGIN " + "PUBLIC KEY-----"), (27, "f.py", 5, ""),
    ]),
    "patches": ("patch_id string, patch string", [
        ("climb", "--- a/lib/k\n+++ b/lib/../../out.cfg\n@@ -1,2 +1,2 @@\n first\n-k\n+kk"),
        ("pair", "--- a/docs/intro.md\n+++ b/docs/intro.md\n@@ -2,2 +2,3 @@\n Title\n-old words\n+new words\n+more words\n--- a/lib/alpha.rs\n+++ b/lib/alpha.rs\n@@ -7 +7 @@ fn alpha\n-let a = 1;\n+let a = 2;\n"),
        ("removed", "--- a/lib/omega.rs\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-mod z;\n-\n"), ("tab", "--- a/web/menu.ts\n+++ web/menu.ts\tafter\n+x"),
        ("twice", "+++ b/one.py\n+a\n+++ b/one.py\n+b"), ("quirk", "+++ b/q.py\n+++ counted\n line"), ("blank", "  \n"), ("empty", ""), ("spaces", "\t\u00a0\r\n\u2003"),
        ("crlf", "--- a/x.go\r\n+++ b/x.go\r\n@@ -1 +1 @@\r\n-a\r\n+b\r\n"), ("stamped", "+++ b/dir/y.py\t2024-01-31 10:00\r\n+z"), ("words", "nothing that names a file\n"),
    ]),
    "paths": ("path string", [(p,) for p in _paths()]),
    "report_paths": ("path string", [(p,) for p in _report_paths()]),
    "urls": ("url string", [(u,) for u in (
        "https://api.example.com", "https://api.example.com:8443/v1", "http://localhost", "http://localhost:3000", "http://127.0.0.1:8080", "http://[::1]:8080", "http://example.com",
        "http://10.0.0.5:3000", "file:///etc/passwd", "ftp://example.com", "javascript:alert(1)", "data:text/plain,hi", "HTTPS://EXAMPLE.COM", "https://", "",
        "https://my_host.example/x", " https://a.example ", "\thttp://localhost\r\n", "https:opaque", "https:///no-host", "https://a.example:port", "https://a.example:", "https://a b.example",
        "https://a.example/%zz", "https://a.example/?q=%zz", "https://me:pw@a.example/x", "http://me@localhost:1/", "http://LOCALHOST", "http://localhost.example", "http:localhost", "http://[::1", "https://[::1]:x",
        "https://a.exa\nmple", "//a.example", "HTTP://127.0.0.1?x", "https://ä.example/ü")]),
    "origins": ("origin string, root string", [
        ("git@host.example:owner/repo.git", "/r"), ("https://host.example/owner/repo.git", "/r"), ("https://host.example/owner/repo", "/r"), (" https://host.example/o/r.git ", "/r"),
        ("ssh://git@host.example/o/r", "/r"), ("plain", "/r"), ("", "/home/me/r"), ("   ", "/home/me/r"),
        ("\thttps://host.example/o/r.git\n", "/r"), ("git@host.example/owner/repo", "/r"), ("git@plain", "/r"), ("\u00a0\r\n", "/r"), ("https://host.example/o/r.git/", "/r"), ("x.git.git", "/r")]),
    "existing": ("path string", [("lib/alpha.rs",), ("one.py",)]),
    "backups": ("name string", [(n,) for n in (".backup-20240101T000000Z", ".backup-20240301T120000Z", ".backup-20231231T235959Z", "src", ".git", "backup-20990101T000000Z")]),
    "entries": ("rel_path string", [("lib/alpha.rs",), ("lib/added.rs.was-absent",), ("x/y.was-absent",), ("was-absent",)]),
    "wanted": ("name string", [("nomic-embed-text",), ("mini:latest",), ("big:7b",), ("other",)]),
    "offered": ("name string", [("nomic-embed-text:latest",), ("mini",), ("big:13b",)]),
    "thresholds": ("threshold string", [(t,) for t in ("critical", "high", "medium", "low", "any", "bogus")]),
    "bodies": ("body string", [(b,) for b in (
        "", "not json", "{", "[]", "3", "\"ok\"", "null", "{}", "{\"ok\":null}", "{\"ok\":false}", "{\"ok\":false,\"error\":null}", "{\"ok\":false,\"error\":{}}", "{\"ok\":false,\"error\":{\"message\":\"m\"}}",
        "{\"error\":{\"code\":\"rate\",\"message\":\"m\"}}", "{\"ok\":false,\"error\":{\"code\":\"rate\",\"message\":null}}", "{\"ok\":false,\"error\":{\"code\":7}}", "{\"ok\":false,\"error\":\"gone\"}", "{\"ok\":false,\"error\":[]}",
        "{\"ok\":\"true\"}", "{\"ok\":1}", "{\"ok\":{}}", "{\"ok\":true}", "{\"ok\":true,\"data\":null}", "{\"ok\":true,\"data\":[1,2]}", "{\"ok\":true,\"data\":\"text\",\"error\":{\"code\":\"c\"}}", "{\"OK\":true,\"Data\":{\"k\":5}}", "{\"Ok\":false,\"ERROR\":{\"Code\":\"c\",\"MESSAGE\":\"m\"}}", "{\"ok\":true,\"data\":{\"k\":6}} ")]),
    "sources": ("a string, b string", [("Owner/Repo", "owner/repo"), ("owner/repo", "owner/other"), ("", "owner/repo"), ("owner/repo", "")]),
}


def table(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = FIXTURES[name]
    return spark.createDataFrame(rows, schema)


def sql(name: str) -> str:
    """The same rows as a SQL subquery."""
    schema, rows = FIXTURES[name]
    columns = ", ".join(c.split()[0] for c in schema.split(", "))
    quoted = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS v({columns}))"
