"""Documentation comments: the ones above a line, their words without marks, canonical kinds of declarations."""

from __future__ import annotations

import re

_LINE = re.compile(r"^[ \t]*(?:///?!?|--|\#+'?|;;+|%+)[ \t]?")
_OPEN, _CLOSE = re.compile(r"^[ \t]*/\*\*?!?[ \t]?"), re.compile(r"[ \t]*\*+/[ \t]*$")
_STAR = re.compile(r"^[ \t]*\*(?!/)[ \t]?")
_XML = re.compile(r"</?(?:summary|remarks|param|returns|value|example|exception|para|c|code|see|typeparam)\b[^>]*/?>")
_JSDOC = re.compile(r"^@(\w+)(?:[ \t]+\{([^}]*)\})?(?:[ \t]+([\w.$\[\]=]+))?[ \t]*-?[ \t]*(.*)$")
_ATTRIBUTE = re.compile(r"^[ \t]*(?:@[\w.]+(?:\(.*\))?|\#\[.*\]|\[\w.*\])[ \t]*$")
_COMMENT_LINE = re.compile(r"^[ \t]*(?://|--|\#(?!\[|!|include|define|if|endif|else|pragma)|;;|%)")


def clean(raw: str) -> str:
    """The words of a comment: marks, stars and XML tags removed, blank lines at its ends dropped."""
    out = []
    for line in raw.replace("\r", "").split("\n"):
        line = _CLOSE.sub("", _OPEN.sub("", line))
        out.append(_XML.sub("", _STAR.sub("", _LINE.sub("", line))).rstrip())
    return "\n".join(out).strip("\n").strip()


def tags(doc: str) -> list[tuple[str, str | None, str | None, str]]:
    """(tag, type, name, text) of every @tag line of a cleaned comment; further lines belong to the tag before."""
    out: list[list] = []
    for line in doc.split("\n"):
        if m := _JSDOC.match(line.strip()):
            named = m[1] in ("param", "arg", "argument", "property", "typedef", "template")
            out.append([m[1], m[2], m[3] if named else None, (m[4] if named else " ".join(x for x in (m[3], m[4]) if x)).strip()])
        elif out and line.strip():
            out[-1][3] = f"{out[-1][3]} {line.strip()}".strip()
    return [tuple(x) for x in out]


def above(lines: list[str], at: int) -> str | None:
    """The comment that ends directly above a line, only annotations or attributes between; None without one."""
    i = at - 1
    while i >= 0 and _ATTRIBUTE.match(lines[i]):
        i -= 1
    if i < 0:
        return None
    if lines[i].rstrip().endswith("*/"):
        start = i
        while start >= 0 and "/*" not in lines[start]:
            start -= 1
        if start < 0 or not lines[start].lstrip().startswith("/*"):
            return None
        return clean("\n".join(lines[start : i + 1])) or None
    start = i
    while start >= 0 and _COMMENT_LINE.match(lines[start]):
        start -= 1
    return clean("\n".join(lines[start + 1 : i + 1])) or None if start < i else None


def inline(line: str, bare: str) -> str | None:
    """The comment that trails code on a line; ``bare`` is the line with comments and strings blanked."""
    code = bare.rstrip()
    rest = line[len(code) :].strip()
    return clean(rest) or None if code and _COMMENT_LINE.match(rest) or rest.startswith("/*") else None


#: Kinds as parsers name them and the kind they stand for. Fixed values.
KINDS = {
    "func": "function", "fn": "function", "def": "function", "procedure": "function", "subroutine": "function", "lambda": "function", "arrow_function": "function", "function_definition": "function", "function_declaration": "function",
    "method_definition": "method", "method_declaration": "method", "constructor": "method", "destructor": "method", "getter": "method", "setter": "method",
    "class_definition": "class", "class_declaration": "class", "object": "class", "record": "class", "contract": "class",
    "struct_item": "struct", "union": "struct", "enum_item": "enum", "enumeration": "enum",
    "protocol": "interface", "trait": "interface", "mixin": "interface", "typedef": "type", "type_alias": "type", "newtype": "type",
    "mod": "module", "namespace": "module", "package": "module", "library": "module",
    "const": "constant", "let": "variable", "var": "variable", "field": "property", "attribute": "property",
}
FUNCTION_LIKE = ("function", "method", "macro")
TYPE_LIKE = ("class", "struct", "enum", "interface", "type")
CONTAINER_LIKE = ("class", "struct", "interface", "module", "impl", "extension")
#: Languages in which a kind means something else. Fixed values.
BY_LANGUAGE = {("go", "struct"): "struct", ("scala", "object"): "module", ("kotlin", "object"): "class", ("sql", "procedure"): "procedure", ("sql", "function"): "function", ("graphql", "union"): "type", ("rust", "trait"): "interface"}


def canonical(kind: str, language: str | None = None) -> str:
    """The canonical kind of a declaration."""
    low = kind.strip().lower()
    return BY_LANGUAGE.get((language or "", low)) or KINDS.get(low, low)
