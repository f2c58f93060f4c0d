"""Functions and methods with their documentation, and the hierarchy that inherited documentation needs.

``extract`` finds in one pass over a file's spans each documentation comment that ends directly before a
named function with a body (only annotations or attributes between), or the docstring inside it.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right

from corpusmill.llm import lexers

NAME = r"[^\W\d][\w$]*"
_ANNOTATION = r"(?:@[\w.]+\s*)"
# Headers as they follow a comment in the masked text; group "name" ends at the parameter list or the arrow.
_SCRIPT = re.compile(
    rf"\s*(?:(?:export|default|declare|public|private|protected|static|override|abstract|readonly|async|get|set|accessor)\s+)*"
    rf"(?:function\s*\*?\s*(?P<f>{NAME})|(?:const|let|var)\s+(?P<v>{NAME})\s*(?::[^=;{{}}]*?)?=\s*(?:async\s*)?(?P<arrow>function\b\s*\*?\s*(?:{NAME})?|(?=[(<])|{NAME}\s*(?==>))|(?P<m>\*?\s*#?{NAME})\s*(?P<field>=\s*(?:async\s*)?(?=[(<]|{NAME}\s*=>))?(?=[(<=]))"
)
_HEADERS = {
    "java": re.compile(rf"\s*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp)\s+|<[^>{{;]*>\s*)*(?:{NAME}(?:\s*\.\s*{NAME})*\s*(?:<[^;{{(]*>)?(?:\s*\[\s*\])*\s+)?(?P<name>{NAME})\s*(?=\()"),
    "go": re.compile(rf"\s*func\s*(?P<recv>\([^)]*\)\s*)?(?P<name>{NAME})\s*(?:\[[^\]]*\])?(?=\()"),
    "rust": re.compile(rf"\s*(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:const|async|unsafe|default|extern(?:\s+\"?[\w ]*\"?)?)\s+)*fn\s+(?P<name>{NAME})\s*(?:<(?:[^<>()]|<[^<>()]*>)*>)?\s*(?=\()"),
    "c": re.compile(rf"\s*(?:(?:struct|union|enum)\s+)?(?:{NAME}[\s*]+)+(?P<name>{NAME})\s*(?=\()"),
    "ruby": re.compile(r"\s*(?:(?:private|protected|public|module_function|private_class_method)\s+)?def\s+(?:self\s*\.\s*)?(?P<name>[^\W\d]\w*[?!=]?|[-+*/%<>=!~\[\]^&|]+)"),
}
_NOT_NAMES = frozenset("if for while switch catch return function with new await typeof do else try throw match sizeof defer go super synchronized".split())
_CLASS = re.compile(rf"\b(?P<what>class|interface|impl|module|namespace|struct|enum)\s+(?P<name>{NAME})(?P<supers>[^{{;\n]*)")
#: Where a brace must follow, supers may stand on further lines.
_CLASS_BRACE = re.compile(rf"\b(?P<what>class|interface|namespace|enum|record)\s+(?P<name>{NAME})(?P<supers>[^{{;}}]*)(?=\{{)")
_PAREN = re.compile(r"[()]")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every comment and literal blanked, positions kept."""
    out, at = [], 0
    for a, b, k in spans:
        out.append(text[at:a])
        out.append(" " * (b - a) if k in "#*" else '"' * (b - a))
        at = b
    out.append(text[at:])
    return "".join(out)


def _close(code: str, at: int) -> int:
    """Position after the parenthesis that closes the one at ``at``; -1 without."""
    depth = 0
    for m in _PAREN.finditer(code, at):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return m.end()
    return -1


_GENERIC = re.compile(r"\s*<(?:[^<>()]|<[^<>()]*>)*>\s*")
_BODY = {
    "javascript": re.compile(r"\s*(?::\s*(?:[^{};=]|\{[^{}]*\}(?=\s*[{|&]))+?)?\s*\{"),
    "arrow": re.compile(r"\s*(?::[^;{}]*?)?\s*=>"),
    "java": re.compile(r"\s*(?:\[\s*\]\s*)*(?:throws\s+[\w.,\s]+)?\{"),
    "go": re.compile(r"[^\n;]*?\{"),
    "rust": re.compile(r"[^;{]*\{"),
    "c": re.compile(r"[^;{}=]*\{"),
}


def classes_of(language: str, code: str) -> list[tuple[int, str, tuple, str]]:
    """(start, name, supers, keyword) of every class-like header of a masked text, in order."""
    p = _CLASS_BRACE if language in ("java", "javascript", "typescript") else _CLASS
    return [(m.start(), m["name"], tuple(x for x in re.findall(NAME, m["supers"]) if x not in ("extends", "implements", "for", "where")), m["what"]) for m in p.finditer(code)]


def header(language: str, code: str, at: int, body: bool = True) -> tuple[int, int, str] | None:
    """(start of the name, end of the parameters, kind) of a named function, with a body unless ``body`` is false, that starts after ``at``."""
    if language in ("javascript", "typescript"):
        m = _SCRIPT.match(code, at)
        if not m:
            return None
        which = "f" if m["f"] else "v" if m["v"] else "m"
        name = m[which].lstrip("*").strip()
        start = m.end(which) - len(name)
        if name in _NOT_NAMES:
            return None
        p = m.end()
        if (which == "v" and m["arrow"] and not m["arrow"].startswith("function")) or (which == "m" and m["field"] and code[p : p + 1] not in "(<"):
            return start, p, "function"
        if g := _GENERIC.match(code, p):
            p = g.end()
        while code[p : p + 1].isspace():
            p += 1
        if code[p : p + 1] != "(":
            return None
        end = _close(code, p)
        if end < 0:
            return None
        arrow = (which == "v" and not (m["arrow"] or "").startswith("function")) or (which == "m" and m["field"])
        if body and not (_BODY["arrow"] if arrow else _BODY["javascript"]).match(code, end):
            return None
        return start, end, "method" if which == "m" else "function"
    m = _HEADERS[language].match(code, at)
    if not m or m["name"] in _NOT_NAMES:
        return None
    start, p = m.span("name")
    if language == "ruby":
        return start, p, "method"
    p = m.end()
    while code[p : p + 1].isspace():
        p += 1
    end = _close(code, p)
    if end < 0 or body and not _BODY[language].match(code, end):
        return None
    return start, end, "method" if language == "java" or (language == "go" and m["recv"]) else "function"


_ATTRIBUTE = {
    "java": re.compile(r"\s*@(?!interface\b)[\w.]+"),
    "typescript": re.compile(r"\s*@[\w.]+"),
    "rust": re.compile(r"\s*#!?(?=\[)"),
    "c": re.compile(r"\s*(?:__attribute__|\[\[[^\]]*\]\])"),
}
_ATTRIBUTE["javascript"] = _ATTRIBUTE["typescript"]


def _after_attributes(language: str, code: str, at: int) -> int:
    pattern = _ATTRIBUTE.get(language)
    while pattern and (m := pattern.match(code, at)):
        at = m.end()
        n = len(code)
        p = at
        while p < n and code[p] in " \t":
            p += 1
        if code[p : p + 1] == "(":
            at = _close(code, p)
        elif code[p : p + 1] == "[":
            depth = 0
            for i in range(p, n):
                depth += (code[i] == "[") - (code[i] == "]")
                if not depth:
                    at = i + 1
                    break
            else:
                return n
        if at < 0:
            return n
    return at


def blocks(language: str, text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, form) of each comment, line comments on adjoining lines with the same mark joined. form: the opener."""
    out: list[list] = []
    for a, b, k in spans:
        if k not in "#*":
            continue
        raw = text[a : a + 3]
        if k == "*":
            form = "/**" if raw == "/**" and text[a : a + 4] != "/**/" else "/*"
        elif language == "ruby" or language in ("python", "yaml"):
            form = "#"
        else:
            form = "///" if raw == "///" and text[a : a + 4] != "////" else "//!" if raw == "//!" and language == "rust" else "//"
        if k == "#" and out and out[-1][2] == form and out[-1][3]:
            gap = text[out[-1][1] : a]
            if gap.count("\n") == 1 and not gap.strip():
                out[-1][1] = b
                continue
        line_start = text.rfind("\n", 0, a) + 1
        out.append([a, b, form, k == "#" and not text[line_start:a].strip()])
    return [(a, b, f) for a, b, f, _ in out]


_DOC_FORMS = {"javascript": ("/**",), "typescript": ("/**",), "java": ("/**",), "go": ("//", "///"), "rust": ("///", "/**"), "c": ("///", "/**", "/*"), "ruby": ("#",)}
_CLEAN = re.compile(r"^[ \t]*(?:/\*\*?|\*(?!/)|///?!?|\#+!?)?[ \t]?|[ \t]*\*+/[ \t]*$", re.M)


def clean(raw: str) -> str:
    """The words of a comment without its marks."""
    return _CLEAN.sub("", raw.replace("\r", "")).strip()


def _python(tree: ast.Module, text: str) -> list[tuple]:
    lines = text.split("\n")
    out, stack = [], [(node, None, ()) for node in tree.body][::-1]
    while stack:
        node, owner, supers = stack.pop()
        kind = type(node)
        if kind is ast.ClassDef:
            bases = tuple(b.id if isinstance(b, ast.Name) else b.attr for b in node.bases if isinstance(b, (ast.Name, ast.Attribute)))
            stack += [(n, node.name, bases) for n in node.body][::-1]
        elif kind is ast.FunctionDef or kind is ast.AsyncFunctionDef:
            first = node.body[0]
            doc = first.value.value if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str) else None
            a = node.args
            params = [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg)))]
            if doc is not None or owner:
                end = max(first.lineno - 1, node.lineno)
                signature = " ".join(x.strip() for x in lines[node.lineno - 1 : end if first.lineno > node.lineno else node.lineno])
                code = "\n".join(lines[node.lineno - 1 : node.end_lineno])
                out.append((node.name, "method" if owner else "function", signature, node.lineno, doc, params, owner, supers, code))
            stack += [(n, None, ()) for n in node.body][::-1]
        else:
            for field in ("body", "orelse", "finalbody", "handlers", "cases"):
                stack += [(n, owner, supers) for n in getattr(node, field, ()) or () if isinstance(n, ast.AST)][::-1]
    return out


_IMPORTED = {
    "python": re.compile(r"^[ \t]*from[ \t]+([\w.]+)[ \t]+import[ \t]+(\([^)]*\)|[^\n#]+)", re.M),
    "javascript": re.compile(r"\bimport\s+(?:type\s+)?([\w$,{}\s*]+?)\s+from\s+['\"]([^'\"\n]+)['\"]"),
    "java": re.compile(r"^[ \t]*import[ \t]+(?:static[ \t]+)?[\w.]*?(\w+)[ \t]*;", re.M),
}


def import_hints(language: str, text: str) -> dict[str, str]:
    """Imported name -> stem of the file that it comes from."""
    out: dict[str, str] = {}
    if language == "python":
        for m in _IMPORTED["python"].finditer(text):
            stem = m[1].rpartition(".")[2]
            for part in m[2].strip("()").split(","):
                words = part.split()
                if words and stem:
                    out[words[-1]] = stem
    elif language in ("javascript", "typescript"):
        for m in _IMPORTED["javascript"].finditer(text):
            stem = m[2].rpartition("/")[2].partition(".")[0]
            for name in re.findall(r"[\w$]+", m[1]):
                out[name] = stem
    elif language == "java":
        out = {m[1]: m[1] for m in _IMPORTED["java"].finditer(text)}
    return out


def stem_of(path: str | None) -> str:
    """The name by which a file is imported: without ending, of a package's own file that of its folder."""
    parts = (path or "").split("/")
    stem = parts[-1].partition(".")[0]
    return parts[-2] if stem in ("__init__", "index", "mod") and len(parts) > 1 else stem


def _end_of(language: str, code: str, at: int) -> int:
    """Position after the body that opens after ``at`` (braces), or after the ``end`` of the same indent (Ruby)."""
    if language == "ruby":
        start = code.rfind("\n", 0, at) + 1
        indent = re.match(r"[ \t]*", code[start:])[0]
        m = re.compile(rf"^{indent}end\b", re.M).search(code, at)
        return m.end() if m else at
    open_ = code.find("{", at)
    if open_ < 0:
        return at
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, open_):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(code)


def hierarchy(language: str, text: str, spans: list[tuple[int, int, str]] | None, tree: ast.Module | None = None) -> list[tuple[str, int, tuple]]:
    """(class, start_line, supers) of every class that has supers, with or without methods."""
    if language == "python":
        bases = ((n, tuple(b.id if isinstance(b, ast.Name) else b.attr for b in n.bases if isinstance(b, (ast.Name, ast.Attribute)))) for n in ast.walk(tree) if isinstance(n, ast.ClassDef)) if tree else ()
        return [(n.name, n.lineno, b) for n, b in bases if b]
    if language not in _DOC_FORMS:
        return []
    code = masked(text, spans or [])
    return [(name, code.count("\n", 0, at) + 1, supers) for at, name, supers, _ in classes_of(language, code) if supers]


def extract(language: str, text: str, spans: list[tuple[int, int, str]] | None, tree: ast.Module | None = None, bodyless: list[tuple] | None = None, overriding: bool = False) -> list[tuple]:
    """(name, kind, signature, start_line, doc, params, owner, supers, code) of the documented functions of a valid file.

    ``bodyless`` receives (name, start_line, doc, params, owner) of documented interface and abstract methods;
    ``overriding`` adds methods that say they override another and have no documentation (doc is None).
    """
    if language == "python":
        return _python(tree, text) if tree else []
    if language not in _DOC_FORMS or not (spans or overriding):
        return []
    code = masked(text, spans or [])
    starts: list[int] | None = None
    classes: list[tuple[int, str, tuple, str]] | None = None
    out = []
    forms = _DOC_FORMS[language]
    for a, b, form in blocks(language, text, spans):
        if form not in forms:
            continue
        line = text.rfind("\n", 0, a) + 1
        if code[line:a].strip():
            continue  # trails code
        rest = re.compile(r"[ \t]*\r?\n?[ \t]*").match(text, b).end()
        if text[rest : rest + 1] in "\r\n":
            continue  # a blank line between
        at = _after_attributes(language, code, b)
        if "/*" in text[b:at] or "//" in text[b:at]:
            continue
        h = header(language, code, at)
        lacks = not h and bodyless is not None and language in ("java", "javascript", "typescript")
        if lacks:
            h = header(language, code, at, body=False)
        if not h or (gap := text[at : h[0]]).count("/*") or "//" in gap:
            continue
        start, end, kind = h
        if starts is None:
            starts = [0, *(m.end() for m in re.finditer("\n", text))]
            classes = classes_of(language, code)
        name = re.compile(r"[\w$#?!=]+").match(text, start)
        name = name[0] if name else text[start]
        params = re.findall(NAME, code[start + len(name) : end]) if language != "ruby" else re.findall(NAME, code[end : code.find("\n", end)])
        owner = next((c for c in reversed(classes) if c[0] < start), (0, None, (), ""))
        if lacks:
            if owner[1] and (owner[3] == "interface" or re.search(r"\babstract\b", code[at:start])):
                bodyless.append((name, bisect_right(starts, start), clean(text[a:b]), params, owner[1]))
            continue
        head = text[at:end].strip() if language != "ruby" else text[at : text.find("\n", end) if "\n" in text[end:] else len(text)].strip()
        out.append((name, kind, " ".join(head.split()), bisect_right(starts, start), clean(text[a:b]), params, owner[1], owner[2], text[line : _end_of(language, code, end)]))
    if overriding and language in ("java", "typescript"):
        told = {(r[0], r[3]) for r in out}
        starts = starts or [0, *(m.end() for m in re.finditer("\n", text))]
        classes = classes if classes is not None else classes_of(language, code)
        for m in re.finditer(r"@Override\b" if language == "java" else r"\boverride\b", code):
            line = text.rfind("\n", 0, m.start()) + 1
            at = _after_attributes(language, code, line)
            h = header(language, code, at)
            if not h or not h[0] > m.start():
                continue
            start, end, kind = h
            name = re.compile(r"[\w$]+").match(text, start)[0]
            owner = next((c for c in reversed(classes) if c[0] < start), (0, None, (), ""))
            if owner[1] and owner[2] and (name, bisect_right(starts, start)) not in told:
                told.add((name, bisect_right(starts, start)))
                out.append((name, kind, " ".join(text[at:end].split()), bisect_right(starts, start), None, re.findall(NAME, code[start + len(name) : end]), owner[1], owner[2], text[line : _end_of(language, code, end)]))
    return out
