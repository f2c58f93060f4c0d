"""Texts about code: summaries of a file, prompts, chat sizes, SQL statements and dialects."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T

DDL = ("create", "alter", "drop", "truncate", "rename")
DML = ("select", "insert", "update", "delete", "merge", "with")
#: What speaks for a dialect of SQL; each that is found is one vote. Fixed values.
DIALECTS = {
    "mysql": (r"`[a-zA-Z_]", r"\bauto_increment\b", r"\bengine\s*=", r"\bcharset\s*=", r"\bcollate\s*="),
    "postgresql": (r"\bserial\b", r"\bbigserial\b", r"\bplpgsql\b", r"\b\$\$", r"\breturning\b", r"::"),
    "sqlite": (r"\bautoincrement\b", r"\bwithout\s+rowid\b"),
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def escaped_fences(text: Column | str) -> Column:
    """Triple backticks broken up by zero-width spaces, so that they end no block."""
    return F.replace(_col(text), F.lit("```"), F.lit("`​`​`"))


def statement_class(statement: Column | str) -> Column:
    """DDL, DML or UNKNOWN by the first word."""
    word = F.regexp_extract(F.lower(F.coalesce(_col(statement), F.lit(""))), r"^\s*(\S+)", 1)
    return F.when(word.isin(*DDL), "DDL").when(word.isin(*DML), "DML").otherwise("UNKNOWN")


def dialect_votes(text: Column | str) -> dict[str, Column]:
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    out = {}
    for name, signs in DIALECTS.items():
        n = F.lit(0)
        for s in signs:
            n = n + low.rlike(s).cast("int")
        out[name] = n
    return out


def dialect(text: Column | str) -> Column:
    """The dialect with the most votes; PostgreSQL on ties and without any."""
    v = dialect_votes(text)
    return F.when((v["mysql"] > v["postgresql"]) & (v["mysql"] > v["sqlite"]), "mysql").when((v["sqlite"] > v["postgresql"]) & (v["sqlite"] > v["mysql"]), "sqlite").otherwise("postgresql")


_WINDOW = re.compile(r"(?i)\b(\w+)\s*\([^()]*\)\s*over\s*(\(|\w+)")


def window_calls(sql: str, around: int = 50) -> list[tuple[str, int, str]]:
    """(function, line, context) of every window function in a text."""
    return [(m[1], sql.count("\n", 0, m.start()) + 1, sql[max(0, m.start() - around) : m.end() + around]) for m in _WINDOW.finditer(sql)]


def file_text(name: Column, language: Column, imports: Column | None = None, kinds: Column | None = None, tokens: Column | None = None, issues: Column | None = None) -> Column:
    """A summary of a file in lines; parts that are missing or empty are left out.

    imports: array<string>; kinds: array<struct<kind, names array<string>>>; tokens: a number; issues: array<string>.
    """
    tick = F.lit("`")
    parts = [F.concat(F.lit("**File:** `"), name, tick), F.concat(F.lit("**Language:** `"), F.coalesce(language, F.lit("unknown")), tick)]
    if imports is not None:
        parts.append(F.when(F.size(imports) > 0, F.concat(F.lit("**Imports ("), F.size(imports).cast("string"), F.lit("):** `"), F.array_join(F.array_sort(imports), ", "), tick)))
    if kinds is not None:
        each = F.transform(F.array_sort(kinds), lambda k: F.concat(F.lit("**"), F.initcap(k["kind"]), F.lit(" ("), F.size(k["names"]).cast("string"), F.lit("):** `"), F.array_join(F.array_sort(k["names"]), ", "), F.lit("`")))
        parts.append(F.when(F.size(kinds) > 0, F.concat(F.lit("**Declarations:**\n"), F.array_join(each, "\n"))))
    if tokens is not None:
        parts.append(F.when(tokens.isNotNull(), F.concat(F.lit("**Token Counts:**\nGPT-4: `"), tokens.cast("string"), tick)))
    if issues is not None:
        parts.append(F.when(F.size(issues) > 0, F.concat(F.lit("**Security Issues:**\n"), F.array_join(issues, "\n"))))
    return F.concat_ws("\n", *parts)


def prompt(template: str, **values: Column | str) -> Column:
    """A template whose {NAME} places are filled from columns; text of code has its fences broken up first."""
    out: Column = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), escaped_fences(F.coalesce(_col(value).cast("string"), F.lit(""))))
    return out


PROMPTS = {
    "file": "Summarise this {LANGUAGE} file ({PATH}) in two sentences.\n```\n{CODE}\n```\n",
    "function": "Say in one sentence what the function {NAME} of {PATH} does.\n```\n{CODE}\n```\n",
    "overview": "Write an overview of a project with these directories:\n{TREE}\nIts files:\n{SUMMARIES}\n",
    "diff": "Describe what this change to {PATH} does.\n```\n{PATCH}\n```\n",
}


def chat_tokens(messages: DataFrame, conversation: str = "conv_id", role: str = "role", text: str = "text", name: str | None = None, chat_model: bool = True) -> DataFrame:
    """(conversation, messages, tokens): what a chat costs: an overhead a message, its role and text, names, and the start of the answer."""
    each = F.lit(3 if chat_model else 2) + T.fallback_tokens(role) + T.fallback_tokens(text)
    if name:
        each = each + F.when(F.col(name).isNotNull(), F.lit(1 if chat_model else 0) + T.fallback_tokens(name)).otherwise(0)
    return messages.groupBy(conversation).agg(F.count("*").alias("messages"), (F.sum(each) + F.lit(3 if chat_model else 0)).alias("tokens"))


def in_string(text: str, at: int) -> bool:
    """Whether a place lies inside a string literal; quotes of the other kind and escapes do not end one."""
    quote, i = "", 0
    while i < at:
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif text.startswith(quote, i):
                i += len(quote) - 1
                quote = ""
        elif c in "\"'`":
            quote = c * 3 if text.startswith(c * 3, i) and c != "`" else c
            i += len(quote) - 1
        i += 1
    return bool(quote)


#: Features of other languages, each as the number of its matches. Fixed values.
FEATURES = {
    "elixir": {"pipe": r"\|>", "genserver": r"\buse\s+GenServer\b", "macro": r"\bdefmacrop?\b", "protocol": r"\bdefprotocol\b", "behaviour": r"@behaviour\b", "spec": r"@spec\b", "guard": r"\bwhen\b", "with": r"\bwith\b"},
    "solidity": {"assembly_block": r"\bassembly\s*(?:\"[^\"]*\"\s*)?\{", "delegatecall_usage": r"\.delegatecall\s*[({]", "selfdestruct_call": r"\bselfdestruct\s*\(", "suicide_call": r"\bsuicide\s*\(", "external_call": r"\.call\s*[({]"},
}


def feature_counts(text: Column | str, language: str) -> list[Column]:
    c = F.coalesce(_col(text), F.lit(""))
    return [F.regexp_count(c, F.lit(p)).alias(k) for k, p in FEATURES[language].items()]


_TYPE = re.compile(r"(?m)^\s*(?:extend\s+)?(type|interface|input|enum|union)\s+(\w+)([^{=]*)(?:\{([^}]*)\}|=\s*([^\n]+(?:\n\s*\|[^\n]+)*))?")
_FIELD = re.compile(r"(?m)^\s*(\w+)\s*(?:\(([^)]*)\))?\s*:\s*([\[\]!\w]+)((?:\s*@\w+(?:\([^)]*\))?)*)")


def graphql_types(schema: str) -> list[tuple[str, str, str, str | None, list[str]]]:
    """(owner, kind, field, type, arguments) of a schema: fields of types, values of enums, members of unions."""
    bare = re.sub(r'"""[\s\S]*?"""|"[^"\n]*"|#[^\n]*', "", schema)
    out: list[tuple] = []
    for kind, name, _, body, members in _TYPE.findall(bare):
        if kind == "union":
            out += [(name, kind, m, m, []) for m in re.findall(r"\w+", members)]
        elif kind == "enum":
            out += [(name, kind, m, None, []) for m in re.findall(r"(?m)^\s*(\w+)", body)]
        else:
            out += [(name, kind, f, t, re.findall(r"(\w+)\s*:", a)) for f, a, t, _ in _FIELD.findall(body)]
    return out
