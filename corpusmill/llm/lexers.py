"""Comments and literals of ten languages, found in one pass of one compiled pattern each.

``scan(language, text)`` gives the spans of comments and string literals and the code between them, in
which every comment is white space (a line break if it held one) and every literal one marker character.
A pattern that meets an opener without its end reports the text as broken and goes on after the opener.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

STRING, TEMPLATE, REGEX, CHAR = "\x01", "\x02", "\x03", "\x04"

LANGUAGE_OF = {"py": "python", "js": "javascript", "ts": "typescript", "java": "java", "go": "go", "rs": "rust", "c": "c", "rb": "ruby", "json": "json", "yml": "yaml", "yaml": "yaml"}


def language_of(path: str | None) -> str | None:
    """The language that a path's ending claims."""
    return LANGUAGE_OF.get((path or "").rpartition(".")[2].lower())


@dataclass
class Scan:
    """kind of a span: ``#`` line comment, ``*`` block comment, ``"`` string, ``'`` character, ``/`` pattern."""

    spans: list[tuple[int, int, str]] = field(default_factory=list)
    code: str = ""
    ok: bool = True


_LINE, _BLOCK = r"//[^\n]*+", r"/\*(?:[^*]|\*(?!/))*+\*/"
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\[\s\S])*+"', r"'(?:[^'\\\n]|\\[\s\S])*+'"

# Groups of each pattern: 1 line comment, 2 block comment, 3 string, 4 character, 5 special, 6 opener without end.
_PATTERNS = {
    "javascript": rf"({_LINE})|({_BLOCK})|({_DOUBLE}|{_SINGLE})|(?!)()|([`/])|([\"'])",
    "java": rf"({_LINE})|({_BLOCK})|(\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|{_DOUBLE})|({_SINGLE})|(?!)()|(/\*|[\"'])",
    "go": rf"({_LINE})|({_BLOCK})|({_DOUBLE}|`[^`]*+`)|({_SINGLE})|(?!)()|(/\*|[\"'`])",
    "c": rf"({_LINE})|({_BLOCK})|({_DOUBLE})|({_SINGLE})|(^[ \t]*\#(?:[^\n\\/\"']|\\[\s\S]|/(?![/*])|{_DOUBLE}|{_SINGLE})*+)|(/\*|[\"'])",
    "rust": rf"({_LINE})|(?!)()|(b?\"(?:[^\"\\]|\\[\s\S])*+\")|(b?'(?:\\(?:u\{{[0-9a-fA-F_]*+\}}|x[0-9a-fA-F]{{2}}|.)|[^'\\\n])')|(/\*|b?r\#*+\")|(\"|'(?![a-zA-Z_]))",
    "ruby": r"(\#[^\n]*+)|(^=begin\b[\s\S]*?\n=end\b[^\n]*+)|('(?:[^'\\]|\\[\s\S])*+')|(?!)()|([\"`/]|<<[~-]?(?:[A-Z]\w*+|\"[^\"\n]*+\"|'[^'\n]*+')|%[wWiIqQ]?[(\[{<|!/])|(')",
    "python": r"(\#[^\n]*+)|(?!)()|((?i:\b(?:r|u|b|f|rb|br|fr|rf))?(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''|\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*+\"|'(?!'')(?:[^'\\\n]|\\[\s\S])*+'))|(?!)()|(?!)()|([\"'])",
    "json": rf"(?!)()|(?!)()|({_DOUBLE})|(?!)()|(?!)()|(\")",
}
_PATTERNS["typescript"] = _PATTERNS["javascript"]
PATTERN = {k: re.compile(v, re.M) for k, v in _PATTERNS.items()}
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[A-Za-z]*+")
_RUBY_REGEX = re.compile(r"/(?:[^\\/\n]|\\.)*+/[a-z]*+")
_WORD_BEFORE = re.compile(r"[A-Za-z_$][\w$]*\Z")
_OPERAND_AFTER = frozenset("return typeof case in of delete void throw new else do instanceof yield await if unless while until and or not when puts".split())
_TEMPLATE_PART = re.compile(r"[^`\\$]++|\\[\s\S]|\$(?!\{)")
_DOUBLE_PART = {q: re.compile(rf"[^{q}\\#]++|\\[\s\S]|#(?!\{{)") for q in '"`'}
_INSIDE = re.compile(r"[^{}\"'`]++")
_QUOTED = re.compile(rf"{_DOUBLE}|{_SINGLE}")
_CLOSER = {"(": ")", "[": "]", "{": "}", "<": ">"}


def _interpolated(text: str, at: int, close: str, part: re.Pattern, opener: str) -> int:
    """End of a literal that starts before ``at`` and holds ``opener``...} parts; -1 without end."""
    n = len(text)
    while at < n:
        if m := part.match(text, at):
            at = m.end()
        elif text[at] == close:
            return at + 1
        elif text.startswith(opener, at):
            at += len(opener)
            depth = 1
            while depth and at < n:
                if m := _INSIDE.match(text, at):
                    at = m.end()
                    continue
                c = text[at]
                if c == "{":
                    depth, at = depth + 1, at + 1
                elif c == "}":
                    depth, at = depth - 1, at + 1
                elif c == "`" and opener == "${":
                    if (at := _interpolated(text, at + 1, "`", part, opener)) < 0:
                        return -1
                else:
                    m = _QUOTED.match(text, at)
                    at = m.end() if m else at + 1
        else:
            return -1
    return -1


def _wants_operand(before: str, last: str) -> bool:
    """Whether an operand may start after this code; ``last`` is what came before it."""
    before = before.rstrip() or last
    if not before:
        return True
    if m := _WORD_BEFORE.search(before):
        return m[0] in _OPERAND_AFTER
    return before[-1] not in ")]}0123456789\x01\x02\x03\x04"


def _special(language: str, text: str, m: re.Match, before: str, last: str) -> tuple[int, str]:
    """(end, span kind) of what needs more than the pattern; end -1: no end, kind '' : plain code."""
    at, opener = m.start(5), m[5]
    if language in ("javascript", "typescript"):
        if opener == "`":
            return _interpolated(text, at + 1, "`", _TEMPLATE_PART, "${"), "`"
        if _wants_operand(before, last) and (r := _JS_REGEX.match(text, at)):
            return r.end(), "/"
        return at + 1, ""
    if language == "c":
        return m.end(5), "#!"
    if language == "rust":
        if opener == "/*":  # these nest
            depth, i = 1, at + 2
            while depth:
                o, c = text.find("/*", i), text.find("*/", i)
                if c < 0:
                    return -1, "*"
                depth, i = (depth + 1, o + 2) if 0 <= o < c else (depth - 1, c + 2)
            return i, "*"
        end = text.find('"' + "#" * opener.count("#"), m.end(5))
        return (end + 1 + opener.count("#") if end >= 0 else -1), '"'
    if language == "ruby":
        if opener in '"`':
            return _interpolated(text, at + 1, opener, _DOUBLE_PART[opener], "#{"), '"'
        spaced = before[-1:] in " \t" and text[m.end(5) : m.end(5) + 1] not in ("", " ", "=", "\n")
        if opener == "/":
            if (_wants_operand(before, last) or (spaced and _WORD_BEFORE.search(before.rstrip()))) and (r := _RUBY_REGEX.match(text, at)):
                return r.end(), "/"
            return at + 1, ""
        if opener.startswith("<<"):
            tag = opener.lstrip("<~-").strip("\"'")
            if before.rstrip().endswith("class") or (opener[2] not in "~-" and not _wants_operand(before, last)):
                return m.end(5), ""
            end = re.compile(rf"^[ \t]*{re.escape(tag)}\s*$", re.M).search(text, m.end(5))
            return (end.end() if end else -1), '"<'
        if not (_wants_operand(before, last) or spaced):
            return at + 1, ""
        open_ = opener[-1]
        close, i, depth = _CLOSER.get(open_, open_), m.end(5), 1
        while i < len(text):
            c = text[i]
            if c == "\\":
                i += 1
            elif c == close:
                depth -= 1
                if not depth:
                    return i + 1, '"'
            elif c == open_:
                depth += 1
            i += 1
        return -1, '"'
    return at + 1, ""


def scan(language: str, text: str) -> Scan:
    """Spans and code of a text; YAML has its own way (``yaml_spans``)."""
    out, pattern, at, pieces = Scan(), PATTERN[language], 0, []
    spans, last = out.spans, ""
    search = pattern.search
    pos, n = 0, len(text)
    if language == "ruby" and (end := re.search(r"^__END__\r?$", text, re.M)):
        n = end.start()
        text = text[:n]
    while m := search(text, pos):
        k = m.lastindex
        start, end = m.span()
        if k == 1:
            spans.append((start, end, "#"))
            pieces.append(text[at:start])
        elif k == 2:
            spans.append((start, end, "*"))
            pieces += (text[at:start], "\n" if "\n" in m[2] else " ")
        elif k == 3 or k == 4:
            spans.append((start, end, '"' if k == 3 else "'"))
            pieces += (text[at:start], STRING if k == 3 else CHAR)
        elif k == 5:
            before = text[at:start]
            end, kind = _special(language, text, m, before, "".join(pieces[-2:]))
            if end < 0:
                out.ok = False
                end, kind = start + len(m[5]), ""
            if not kind:
                pos = end
                continue
            pieces.append(before)
            if kind == "#!":
                pieces.append("\n")
            elif kind == "*":
                spans.append((start, end, "*"))
                pieces.append("\n" if "\n" in text[start:end] else " ")
            elif kind == '"<':
                line = text.find("\n", start)
                line = end if line < 0 else min(line, end)
                spans.append((start, end, '"'))
                pieces += (STRING, text[start + len(m[5]) : line], "\n")
                pos = at = end
                continue
            else:
                spans.append((start, end, kind if kind != "`" else '"'))
                pieces.append({"`": TEMPLATE, "/": REGEX}.get(kind, STRING))
        else:
            out.ok = False
            pos = end
            continue
        pos = at = end
    pieces.append(text[at:n])
    out.code = "".join(pieces)
    return out


_YAML_COMMENT = re.compile(r"(?:^|(?<=[ \t]))#[^\n]*", re.M)
_YAML_VALUE = re.compile(
    r"^(?P<indent>[ ]*)(?:-[ ]+)*(?:(?P<key>[^\s#:\"'\[\]{}&*!|>%@`,][^:\n#]*?|\"[^\"\n]*\"|'[^'\n]*'):[ \t]+|-[ ]+|(?=\"|'))(?P<value>\"(?:[^\"\\]|\\[\s\S])*+\"|'(?:[^']|'')*+'|[|>][+\-0-9]*[ \t]*(?:#[^\n]*)?$|[^\s#\"'|>&*\[{][^\n]*?)(?=[ \t]+#|[ \t]*\r?$)",
    re.M,
)


def yaml_spans(text: str) -> list[tuple[int, int, str]]:
    """Comments and scalar values of a YAML text, by lines: quoted, plain and block scalars."""
    spans: list[tuple[int, int, str]] = []
    pos = 0
    for m in _YAML_VALUE.finditer(text):
        start, end = m.span("value")
        if start < pos:
            continue
        if text[start] in "|>":
            indent = len(m["indent"])
            stop = end
            for line in re.compile(r"\r?\n([ ]*)([^\n]*)").finditer(text, end):
                if line[2].strip() and len(line[1]) <= indent:
                    break
                stop = line.end()
            start, end = end, stop
        spans.append((start, end, '"'))
        pos = end
    inside = iter([*spans, (len(text) + 1, len(text) + 1, "")])
    cur = next(inside)
    for m in _YAML_COMMENT.finditer(text):
        while cur[1] <= m.start():
            cur = next(inside)
        if m.start() < cur[0]:
            spans.append((m.start(), m.end(), "#"))
    spans.sort()
    return spans


def spans_of(language: str, text: str) -> list[tuple[int, int, str]]:
    return yaml_spans(text) if language == "yaml" else scan(language, text).spans
