"""Checks of paths, names, sizes and contents, as columns: a verdict a row, never an exception in a task."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import text as T

#: Languages that may be asked for, parts that no name of a language has, endings of files that are never binary. Fixed values.
ALLOWED_LANGUAGES = (
    "python", "javascript", "typescript", "java", "cpp", "c", "csharp", "go", "rust", "php", "ruby", "swift", "kotlin", "scala", "r", "bash", "shell", "julia", "perl", "powershell",
    "sql", "graphql", "solidity", "html", "css", "xml", "yaml", "json", "toml", "ini", "markdown", "rst", "tex", "documentation", "config", "unknown", "glsl", "hlsl", "metal", "wat", "wasm",
)
SUSPICIOUS_PARTS = ("../", "..\\", "/", "\\", ";", "|", "&", "`", "$", "import", "exec", "eval", "__", "\x00", "\n", "\r", "\t")
CODE_ENDINGS = (".py", ".js", ".ts", ".html", ".css", ".json", ".xml", ".md")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def language_allowed(language: Column | str) -> Column:
    """Whether a name is a known language and nothing else; false for null and empty."""
    c = _col(language)
    return F.coalesce((c != "") & ~T.holds_any(c, SUSPICIOUS_PARTS) & F.lower(c).isin(*ALLOWED_LANGUAGES), F.lit(False))


def binary_by_share(content: Column | str, sample: int = 4096, share: float = 0.3) -> Column:
    """A NUL, or too large a share of bytes above 127, in the first ``sample`` bytes; of bytes or of a string's UTF-8."""
    raw = F.substring(_col(content).cast("binary"), 1, sample)
    head = F.decode(raw, "ISO-8859-1")
    wide = F.length(F.regexp_replace(head, r"[\x00-\x7f]", ""))
    return head.contains("\x00") | (wide > share * F.length(head))


def binary_by_control(content: Column | str, sample: int = 8192, share: float = 0.1) -> Column:
    """A NUL; or bytes that are no UTF-8, of which too large a share are control characters other than tab and line ends."""
    raw = F.substring(_col(content).cast("binary"), 1, sample)
    head = F.decode(raw, "ISO-8859-1")
    control = F.length(head) - F.length(F.regexp_replace(head, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    return head.contains("\x00") | (~F.is_valid_utf8(raw.cast("string")) & (control > share * F.length(head)))


def signature_verdict(path: Column | str, content: Column | str) -> Column:
    """text, binary, or mismatch for binary content under the ending of code; null for null content."""
    p, c = _col(path), _col(content)
    binary = binary_by_control(c)
    return F.when(c.isNotNull(), F.when(binary & T.ends_with_any(F.lower(p), CODE_ENDINGS), "mismatch").when(binary, "binary").otherwise("text"))


def input_status(path: Column | str, content: Column | str, base: str = "", max_bytes: int = 10 * 1024 * 1024, endings: tuple[str, ...] = ()) -> Column:
    """ok, or the first check that fails: empty_path, outside_base, unsafe_path, bad_ending, missing, too_large."""
    p, c = _col(path), _col(content)
    plain = F.coalesce(p, F.lit(""))
    out = F.when(F.trim(plain) == "", "empty_path").when(plain.rlike(r"(?:^|[/\\])\.\.(?:[/\\]|$)") | plain.contains("\x00"), "unsafe_path")
    if base:
        out = out.when(~plain.startswith(base.rstrip("/") + "/"), "outside_base")
    if endings:
        out = out.when(~T.ends_with_any(F.lower(plain), endings), "bad_ending")
    return out.when(c.isNull(), "missing").when(F.octet_length(c) > max_bytes, "too_large").otherwise("ok")


def url_allowed(url: Column | str, schemes: tuple[str, ...] = ("http", "https")) -> Column:
    """Whether an address has a wanted scheme, a host and no control characters or blanks."""
    c = _col(url)
    return F.coalesce(c.rlike(rf"^(?:{'|'.join(schemes)})://[^\s/?#@:]+(?::\d+)?(?:[/?#][^\s\x00-\x1f]*)?$"), F.lit(False))


def clean_filename(name: Column | str, most: int = 255) -> Column:
    """A name without separators, control characters and leading dots; ``unnamed`` if nothing is left."""
    c = F.regexp_replace(F.regexp_replace(_col(name), r"[/\\\x00-\x1f<>:\"|?*]", "_"), r"^\.+", "")
    return F.when(F.trim(c) == "", "unnamed").otherwise(F.substring(c, 1, most))


#: What a table of a kind must hold, by name of the kind: the registry that ``conforms`` reads.
SCHEMAS: dict[str, dict[str, str]] = {
    "files": {"file_id": "bigint", "repo": "string", "path": "string", "content": "string"},
    "issues": {"file_id": "bigint", "line_number": "int", "severity": "int"},
    "parses": {"file_id": "bigint", "parser_ord": "int", "parser_type": "string", "parser_quality": "string", "error": "string"},
}


def register_schema(name: str, columns: dict[str, str]) -> None:
    SCHEMAS[name] = dict(columns)


def conforms(df, name: str) -> list[str]:
    """What a relation lacks of a registered schema: missing columns and other types, in order of name."""
    have = dict(df.dtypes)
    return [f"{c} missing" if c not in have else f"{c} is {have[c]}, not {t}" for c, t in sorted(SCHEMAS[name].items()) if have.get(c) != t]
