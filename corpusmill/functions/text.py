"""Column expressions over paths and texts; everything here stays inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's splitlines splits at. Fixed value.
LINE_END = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"
#: Endings of the file categories. Fixed values.
DOC_ENDINGS = (".md", ".rst", ".txt")
CONFIG_ENDINGS = (".json", ".yml", ".yaml", ".toml", ".ini")
SOURCE_ENDINGS = (".py", ".js", ".ts", ".java", ".cpp", ".go")
#: Path parts of test files, of dependencies, and of files whose findings count one level less. Fixed values.
TEST_PARTS = ("/test_", "_test.py", "/tests/", "/test/", "/__pycache__/", "/.pytest_cache/", "/fixtures/", "/mocks/", "/stubs/", "/__tests__/", ".test.js", ".spec.js", ".test.ts", ".spec.ts")
DEPENDENCY_PARTS = ("/node_modules/", "/venv/", "/.venv/", "/env/", "/.env/", "/vendor/", "/third_party/", "/packages/", "/.cargo/", "/target/release/")
DOWNGRADE_PARTS = ("/tests/", "/test/", "/examples/", "/example/")
DOWNGRADE_ENDINGS = ("_test.py", "_spec.rb", ".test.js", ".spec.js", ".test.ts", ".spec.ts")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ends_with_any(c: Column, endings) -> Column:
    out = F.lit(False)
    for e in endings:
        out = out | c.endswith(e)
    return out


def holds_any(c: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def line_count(content: Column | str) -> Column:
    """len(content.splitlines()); 0 for null."""
    c = F.coalesce(_col(content), F.lit(""))
    open_end = F.when((F.length(c) > 0) & ~F.substring(c, -1, 1).rlike(r"[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"), 1).otherwise(0)
    return (F.regexp_count(c, F.lit(LINE_END)) + open_end).cast("bigint")


def lines(content: Column | str) -> Column:
    """content.split('\\n') as an array; null gives null."""
    return F.split(_col(content), "\n", -1)


def directory(path: Column | str) -> Column:
    d = F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1)
    return F.when(d == "", F.lit(".")).otherwise(d)


def filename(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/]*)$", 1)


def extension(path: Column | str) -> Column:
    """Without its dot; empty for names without one and for dot files."""
    return F.regexp_extract(filename(path), r"^.+\.([^.]*)$", 1)


def category(path: Column | str) -> Column:
    p = F.lower(_col(path))
    return (
        F.when(p.contains("test") | p.contains("spec"), "test")
        .when(ends_with_any(p, DOC_ENDINGS), "documentation")
        .when(ends_with_any(p, CONFIG_ENDINGS), "configuration")
        .when(ends_with_any(p, SOURCE_ENDINGS), "source")
        .otherwise("other")
    )


def is_test(path: Column | str) -> Column:
    return holds_any(F.lower(_col(path)), TEST_PARTS)


def is_dependency(path: Column | str) -> Column:
    return holds_any(F.lower(_col(path)), DEPENDENCY_PARTS)


def downgrades(path: Column | str) -> Column:
    """Whether findings in a file count one level less."""
    p = _col(path)
    name = filename(p)
    return holds_any(F.lower(p), DOWNGRADE_PARTS) | name.startswith("test_") | ends_with_any(name, DOWNGRADE_ENDINGS)


def downgraded(severity: Column | str, path: Column | str) -> Column:
    s = _col(severity)
    return F.when(downgrades(path) & s.between(2, 4), s - 1).otherwise(s)


def redacted_path(path: Column | str, base: str) -> Column:
    """Relative to ``base``; else the last two parts."""
    p = _col(path)
    root = base.rstrip("/") + "/"
    parts = F.split(p, "/")
    return F.when(p.startswith(root), F.substr(p, F.lit(len(root) + 1))).otherwise(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/"))


def human_size(n: Column | str) -> Column:
    b = _col(n)
    return F.when(b < 1024, F.format_string("%d B", b)).when(b < 1048576, F.format_string("%.1f KB", b / 1024)).otherwise(F.format_string("%.1f MB", b / 1048576))


def anchor(path: Column | str) -> Column:
    p = F.lower(F.regexp_replace(_col(path), r"^[./]+", ""))
    return F.regexp_replace(F.regexp_replace(p, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def words(content: Column | str) -> Column:
    """Number of runs that are not white space."""
    c = F.coalesce(_col(content), F.lit(""))
    return F.regexp_count(c, F.lit(r"(?U)\S+")).cast("bigint")


def fallback_tokens(content: Column | str) -> Column:
    """Words plus punctuation, 1 at least, 0 if empty."""
    c = F.coalesce(_col(content), F.lit(""))
    return F.when(c == "", F.lit(0).cast("bigint")).otherwise(F.greatest(F.lit(1).cast("bigint"), words(c) + F.regexp_count(c, F.lit("[.,!?;:\"']")).cast("bigint")))


def family_tokens(content: Column | str, family: str) -> Column:
    """Character-based estimates by model family, cut to whole numbers."""
    c = F.coalesce(_col(content), F.lit(""))
    n = F.length(c)
    if family == "multibyte":
        wide = n - F.length(F.regexp_replace(c, r"[^\x00-\x7f]", ""))
        return ((n - wide) / 4 + wide * F.lit(1.5)).cast("bigint")
    return (n / F.lit({"claude": 3.5, "gemini": 4.0, "llama": 3.8}.get(family, 4.0))).cast("bigint")


def estimated_output(tokens: Column | str, most: int = 500) -> Column:
    return F.least(F.lit(most).cast("bigint"), F.floor(_col(tokens) * F.lit(0.3)))


def masked(finding: Column | str) -> Column:
    f = _col(finding)
    n = F.length(f)

    def ends(k: int) -> Column:
        return F.concat(F.left(f, F.lit(k)), F.lit("****"), F.right(f, F.lit(k)))

    return F.when(n == 0, "").when(n > 8, ends(3)).when(n > 4, ends(2)).when(n > 2, ends(1)).otherwise("****")


def glob_regex(pattern: str) -> str:
    """A path glob as one regular expression: ** crosses directories, * and ? do not, a trailing / means all below."""
    if pattern.endswith("/"):
        pattern += "**"
    anchored = "/" in pattern.rstrip("*").rstrip("/")
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + pattern[i] if pattern[i] in ".()+|^$[]{}\\" else pattern[i]), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}(?:/.*)?$"
