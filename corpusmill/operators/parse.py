"""Declarations and imports of source files: Python by its own parser, other languages by tables of header patterns.

A file goes through a chain of parsers: the language's own one (Python), headers with their blocks over text
whose comments and strings are blanked, then headers alone. The chain ends with the first parser that finds
``enough`` declarations; ``parses`` keeps what each said, so that ``merge`` can reconcile them. A parser never
fails a task: what cannot be parsed gives an error, no declarations, and is marked degraded.

Defined results: null or empty contents and unknown languages give no rows; a file delivered twice counts
once; texts of documentation and configuration files are one declaration, the module.
"""

from __future__ import annotations

import ast
import re
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import docs
from corpusmill.functions.arrow import map_rows
from corpusmill.operators import files as K

_DECLARED = "kind:string,name:string,start_line:int,end_line:int,parent:string,depth:int,docstring:string,signature:string,modifiers:array<string>"
DECLARATION = f"array<struct<{_DECLARED}>>"
PARSE = f"array<struct<parser_ord:int,parser_type:string,parser_quality:string,error:string,declarations:{DECLARATION},imports:array<string>,missed_features:array<string>>>"
_N = r"([A-Za-z_$][\w$]*)"
#: kind and pattern by language; group 1 is the name. How a block ends: b braces, i indent, e the word end, l the line.
PATTERNS: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "javascript": ("b", [("class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_N}"), ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_N}"), ("function", rf"^\s*(?:export\s+)?(?:const|let|var)\s+{_N}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>"), ("method", rf"^\s+(?:(?:static|async|get|set|public|private|protected)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b){_N}\s*\([^)]*\)\s*(?::[^{{]+)?\{{")]),
    "java": ("b", [("class", rf"^\s*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*class\s+{_N}"), ("interface", rf"^\s*(?:(?:public|private|protected)\s+)*interface\s+{_N}"), ("enum", rf"^\s*(?:(?:public|private|protected)\s+)*enum\s+{_N}"), ("method", rf"^\s+(?:@\w+\s+)*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\], .?]+\s+{_N}\s*\([^)]*\)")]),
    "go": ("b", [("struct", rf"^type\s+{_N}\s+struct\b"), ("interface", rf"^type\s+{_N}\s+interface\b"), ("method", rf"^func\s+\([^)]*\)\s*{_N}"), ("function", rf"^func\s+{_N}"), ("type", rf"^type\s+{_N}\s+(?!struct|interface)")]),
    "rust": ("b", [("function", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+{_N}"), ("struct", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+{_N}"), ("enum", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+{_N}"), ("trait", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+{_N}"), ("impl", rf"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?{_N}"), ("module", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+{_N}")]),
    "c": ("b", [("function", rf"^(?:[A-Za-z_][\w]*[\s*]+)+{_N}\s*\([^;]*$"), ("struct", rf"^\s*(?:typedef\s+)?struct\s+{_N}\s*\{{"), ("enum", rf"^\s*(?:typedef\s+)?enum\s+{_N}\s*\{{"), ("macro", rf"^\s*#\s*define\s+{_N}")]),
    "ruby": ("e", [("module", rf"^\s*module\s+{_N}"), ("class", rf"^\s*class\s+{_N}"), ("method", r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)")]),
    "sql": ("l", [("table", r"(?i)^\s*create\s+(?:temp\w*\s+)?table\s+(?:if\s+not\s+exists\s+)?[\"`\[]?([\w.]+)"), ("view", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:materialized\s+)?view\s+[\"`\[]?([\w.]+)"), ("function", r"(?i)^\s*create\s+(?:or\s+replace\s+)?function\s+([\w.]+)"), ("procedure", r"(?i)^\s*create\s+(?:or\s+replace\s+)?procedure\s+([\w.]+)"), ("cte", r"(?i)(?:\bwith\s+(?:recursive\s+)?|^\s*,\s*)(\w+)\s+as\s*\("), ("window", r"(?i)\b(\w+)\s*\([^()]*\)\s*over\s*\(")]),
    "graphql": ("b", [(k, rf"^\s*(?:extend\s+)?{k}\s+{_N}") for k in ("type", "interface", "enum", "union", "input", "scalar", "query", "mutation", "subscription", "fragment")] + [("directive", r"^\s*directive\s+@(\w+)")]),
    "terraform": ("b", [("resource", r"^\s*resource\s+\"[^\"]+\"\s+\"([^\"]+)\""), ("data", r"^\s*data\s+\"[^\"]+\"\s+\"([^\"]+)\""), ("variable", r"^\s*variable\s+\"([^\"]+)\""), ("output", r"^\s*output\s+\"([^\"]+)\""), ("module", r"^\s*module\s+\"([^\"]+)\""), ("provider", r"^\s*provider\s+\"([^\"]+)\"")]),
    "php": ("b", [("class", rf"^\s*(?:abstract\s+|final\s+)*class\s+{_N}"), ("interface", rf"^\s*interface\s+{_N}"), ("trait", rf"^\s*trait\s+{_N}"), ("function", rf"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*function\s+&?{_N}")]),
    "csharp": ("b", [("class", rf"^\s*(?:(?:public|private|internal|protected|static|sealed|abstract|partial)\s+)*class\s+{_N}"), ("interface", rf"^\s*(?:(?:public|internal)\s+)*interface\s+{_N}"), ("struct", rf"^\s*(?:(?:public|internal|readonly)\s+)*struct\s+{_N}"), ("enum", rf"^\s*(?:(?:public|internal)\s+)*enum\s+{_N}"), ("method", rf"^\s+(?:(?:public|private|protected|internal|static|virtual|override|async|abstract)\s+)+[\w<>\[\], .?]+\s+{_N}\s*\(")]),
    "kotlin": ("b", [("class", rf"^\s*(?:(?:data|sealed|open|abstract|inner|enum|annotation|private|internal|public)\s+)*class\s+{_N}"), ("object", rf"^\s*(?:companion\s+)?object\s+{_N}"), ("interface", rf"^\s*interface\s+{_N}"), ("function", rf"^\s*(?:(?:override|suspend|inline|private|public|internal|open|operator)\s+)*fun\s+(?:<[^>]+>\s*)?(?:[\w.<>]+\.)?{_N}")]),
    "swift": ("b", [("class", rf"^\s*(?:(?:public|private|open|final|internal)\s+)*class\s+{_N}"), ("struct", rf"^\s*(?:(?:public|private|internal)\s+)*struct\s+{_N}"), ("enum", rf"^\s*(?:(?:public|private|indirect)\s+)*enum\s+{_N}"), ("protocol", rf"^\s*(?:(?:public|private)\s+)*protocol\s+{_N}"), ("function", rf"^\s*(?:(?:public|private|static|override|mutating|open)\s+)*func\s+{_N}")]),
    "scala": ("b", [("class", rf"^\s*(?:(?:case|abstract|sealed|final)\s+)*class\s+{_N}"), ("object", rf"^\s*(?:case\s+)?object\s+{_N}"), ("trait", rf"^\s*(?:sealed\s+)?trait\s+{_N}"), ("function", rf"^\s*(?:(?:override|private|protected|final|implicit)\s+)*def\s+{_N}")]),
    "r": ("b", [("function", r"^\s*([A-Za-z.][\w.]*)\s*(?:<-|=)\s*function\s*\("), ("class", r"^\s*set(?:Ref)?Class\(\s*[\"']([^\"']+)"), ("generic", r"^\s*setGeneric\(\s*[\"']([^\"']+)"), ("method", r"^\s*setMethod\(\s*[\"']([^\"']+)")]),
    "julia": ("e", [("module", rf"^\s*module\s+{_N}"), ("struct", rf"^\s*(?:mutable\s+)?struct\s+{_N}"), ("abstract", rf"^\s*abstract\s+type\s+{_N}"), ("function", r"^\s*function\s+([A-Za-z_][\w.!]*)"), ("macro", rf"^\s*macro\s+{_N}")]),
    "bash": ("b", [("function", r"^\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\s*\)\s*\{?"), ("function", r"^\s*function\s+([A-Za-z_][\w-]*)\s*\{")]),
    "dart": ("b", [("class", rf"^\s*(?:abstract\s+)?class\s+{_N}"), ("mixin", rf"^\s*mixin\s+{_N}"), ("enum", rf"^\s*enum\s+{_N}"), ("extension", rf"^\s*extension\s+{_N}"), ("function", rf"^\s*(?:static\s+)?[\w<>?]+\s+{_N}\s*\([^;]*\)\s*(?:async\s*)?\{{")]),
    "elixir": ("e", [("module", r"^\s*defmodule\s+([\w.]+)"), ("function", r"^\s*defp?\s+([a-z_]\w*[?!]?)"), ("macro", r"^\s*defmacrop?\s+([a-z_]\w*[?!]?)"), ("protocol", r"^\s*defprotocol\s+([\w.]+)")]),
    "crystal": ("e", [("module", rf"^\s*module\s+{_N}"), ("class", rf"^\s*(?:abstract\s+)?class\s+{_N}"), ("struct", rf"^\s*struct\s+{_N}"), ("method", r"^\s*(?:private\s+)?def\s+(?:self\.)?([a-z_]\w*[?!=]?)"), ("macro", r"^\s*macro\s+(\w+)")]),
    "zig": ("b", [("function", rf"^\s*(?:pub\s+)?(?:export\s+)?fn\s+{_N}"), ("struct", rf"^\s*(?:pub\s+)?const\s+{_N}\s*=\s*(?:packed\s+|extern\s+)?struct\b"), ("enum", rf"^\s*(?:pub\s+)?const\s+{_N}\s*=\s*enum\b"), ("test", r"^\s*test\s+\"([^\"]+)\"")]),
    "solidity": ("b", [("contract", rf"^\s*(?:abstract\s+)?contract\s+{_N}"), ("interface", rf"^\s*interface\s+{_N}"), ("library", rf"^\s*library\s+{_N}"), ("function", rf"^\s*function\s+{_N}"), ("event", rf"^\s*event\s+{_N}"), ("modifier", rf"^\s*modifier\s+{_N}"), ("struct", rf"^\s*struct\s+{_N}")]),
    "glsl": ("b", [("struct", rf"^\s*struct\s+{_N}"), ("function", rf"^\s*(?:void|float|int|bool|[biu]?vec\d|mat\d)\s+{_N}\s*\("), ("uniform", rf"^\s*(?:layout\([^)]*\)\s*)?uniform\s+\w+\s+{_N}")]),
    "wat": ("l", [("function", r"\(func\s+\$([\w.]+)"), ("export", r"\(export\s+\"([^\"]+)\""), ("memory", r"\(memory\s+\$([\w.]+)"), ("global", r"\(global\s+\$([\w.]+)")]),
    "toml": ("l", [("table", r"^\s*\[+([\w.\"-]+)\]+")]),
    "markdown": ("l", [("heading", r"^#{1,6}\s+(.+?)\s*#*$")]),
}
for _like, _of in {"typescript": "javascript", "cpp": "c", "c_header": "c", "cpp_header": "c", "hcl": "terraform", "hlsl": "glsl"}.items():
    PATTERNS[_like] = PATTERNS[_of]
PATTERNS["typescript"] = ("b", [("interface", rf"^\s*(?:export\s+)?(?:declare\s+)?interface\s+{_N}"), ("type", rf"^\s*(?:export\s+)?type\s+{_N}\s*[=<]"), ("enum", rf"^\s*(?:export\s+)?(?:const\s+)?enum\s+{_N}"), ("namespace", rf"^\s*(?:export\s+)?(?:namespace|module)\s+{_N}"), *PATTERNS["javascript"][1]])
PATTERNS["cpp"] = PATTERNS["cpp_header"] = ("b", [("class", rf"^\s*class\s+{_N}"), ("namespace", rf"^\s*namespace\s+{_N}"), *PATTERNS["c"][1]])
#: Words before a name that change what it is; they are reported, whatever the language.
MODIFIERS = frozenset(("export", "default", "declare", "public", "private", "protected", "internal", "static", "final", "abstract", "sealed", "open", "override", "virtual", "async", "const", "unsafe", "pub", "inline", "extern", "mutable", "readonly", "partial", "data", "suspend", "operator", "mutating", "native", "synchronized", "case", "implicit", "lazy", "external", "payable", "view", "pure", "packed"))
#: What each language names as needed; group 1 is the name.
IMPORTS: dict[str, list[str]] = {
    "javascript": [r"""(?m)^[ \t]*(?:import|export)\b[^'\"\n;]*['\"]([^'\"\n]+)['\"]""", r"""\brequire\(\s*['\"]([^'\"\n]+)['\"]\s*\)"""],
    "java": [r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+(?:\.\*)?)"],
    "go": [r'(?m)^[ \t]*import[ \t]+(?:[\w.]+[ \t]+)?"([^"\n]+)"', r'(?m)^[ \t]+(?:[\w.]+[ \t]+)?"([\w./-]+)"[ \t]*$'],
    "rust": [r"(?m)^[ \t]*(?:pub[ \t]+)?use[ \t]+([\w:]+)", r"(?m)^[ \t]*extern[ \t]+crate[ \t]+(\w+)"],
    "c": [r'(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]'],
    "csharp": [r"(?m)^[ \t]*(?:global[ \t]+)?using[ \t]+(?:static[ \t]+)?([\w.]+)[ \t]*;"],
    "php": [r"(?m)^[ \t]*use[ \t]+([\w\\]+)", r"""\b(?:require|include)(?:_once)?[ \t]*\(?[ \t]*['\"]([^'\"\n]+)"""],
    "ruby": [r"""(?m)^[ \t]*require(?:_relative)?[ \t]*\(?['\"]([^'\"\n]+)['\"]"""],
    "r": [r"""(?m)^[ \t]*(?:library|require|requireNamespace)\([ \t]*['\"]?([\w.]+)""", r"""(?m)^[ \t]*source\([ \t]*['\"]([^'\"\n]+)"""],
    "julia": [r"(?m)^[ \t]*(?:using|import)[ \t]+([\w.]+)"],
    "swift": [r"(?m)^[ \t]*import[ \t]+(?:class[ \t]+|struct[ \t]+|func[ \t]+)?([\w.]+)"],
    "kotlin": [r"(?m)^[ \t]*import[ \t]+([\w.]+(?:\.\*)?)"],
    "scala": [r"(?m)^[ \t]*import[ \t]+([\w.]+)"],
    "dart": [r"""(?m)^[ \t]*(?:import|export|part)[ \t]+['\"]([^'\"\n]+)['\"]"""],
    "elixir": [r"(?m)^[ \t]*(?:import|alias|use|require)[ \t]+([A-Z][\w.]*)"],
    "crystal": [r'(?m)^[ \t]*require[ \t]+"([^"\n]+)"'],
    "zig": [r'@import\("([^"\n]+)"\)'],
    "solidity": [r"""(?m)^[ \t]*import\b[^'\"\n;]*['\"]([^'\"\n]+)['\"]"""],
    "glsl": [r'(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)[>"]'],
    "bash": [r"(?m)^[ \t]*(?:source|\.)[ \t]+[\"']?([^\s\"';]+)"],
    "wat": [r'\(import[ \t]+"([^"]+)"'],
    "terraform": [r'(?m)^[ \t]*source[ \t]*=[ \t]*"([^"\n]+)"'],
    "graphql": [r"(?m)^#[ \t]*import[ \t]+[\"']?([^\s\"']+)"],
}
for _like, _of in {"typescript": "javascript", "cpp": "c", "c_header": "c", "cpp_header": "c", "hcl": "terraform", "hlsl": "glsl"}.items():
    IMPORTS[_like] = IMPORTS[_of]
_COMPILED = {k: (how, [(kind, re.compile(p)) for kind, p in ps]) for k, (how, ps) in PATTERNS.items()}
_IMPORTS = {k: [re.compile(p) for p in ps] for k, ps in IMPORTS.items()}

_STRING = r"\"(?:[^\"\\\n]|\\[\s\S])*+\"|'(?:[^'\\\n]|\\[\s\S])*+'"
_BLOCK = r"/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z)"
_BLANKED = {
    "slash": re.compile(rf"//[^\n]*+|{_BLOCK}|{_STRING}|`(?:[^`\\]|\\[\s\S])*+`"),
    "rust": re.compile(rf"//[^\n]*+|{_BLOCK}|\"(?:[^\"\\]|\\[\s\S])*+\"|'(?:[^'\\\n]|\\[^\n]{{1,8}})'"),
    "hash": re.compile(rf"\#[^\n]*+|\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''|{_STRING}"),
    "dash": re.compile(rf"--[^\n]*+|{_BLOCK}|{_STRING}"),
    "semicolon": re.compile(rf";;[^\n]*+|\(;(?:[^;]|;(?!\)))*+;\)|{_STRING}"),
}
_STYLE = {**dict.fromkeys(("python", "ruby", "bash", "r", "julia", "elixir", "crystal", "toml", "yaml", "terraform", "hcl", "graphql", "perl"), "hash"), "rust": "rust", "sql": "dash", "wat": "semicolon"}
_NOT_LINE = re.compile(r"[^\n]")


def blanked(language: str, text: str) -> str:
    """The text with comments and strings as blanks; places and lines stay."""
    return _BLANKED[_STYLE.get(language, "slash")].sub(lambda m: _NOT_LINE.sub(" ", m[0]), text)


def python_declarations(text: str, imports: list[str] | None = None) -> list[tuple] | None:
    """(kind, name, start, end, parent, depth, docstring, signature, modifiers) in source order, or None if the text is not Python."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None
    lines = text.split("\n")
    out, stack = [], [(n, None, False, 0) for n in reversed(tree.body)]
    while stack:
        node, parent, in_class, depth = stack.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "method" if in_class else "function"
            head = max(node.lineno, (node.body[0].lineno - 1) if node.body[0].lineno > node.lineno else node.lineno)
            signature = " ".join(x.strip() for x in lines[node.lineno - 1 : head]).partition("#")[0].strip().removesuffix(":")
            named = [d.func if isinstance(d, ast.Call) else d for d in node.decorator_list]
            modifiers = ["async"] * isinstance(node, ast.AsyncFunctionDef) + [f"@{d.id if isinstance(d, ast.Name) else d.attr}" for d in named if isinstance(d, (ast.Name, ast.Attribute))]
            out.append((kind, node.name, node.lineno, node.end_lineno, parent, depth, ast.get_docstring(node), signature, modifiers))
            stack += [(n, node.name, isinstance(node, ast.ClassDef), depth + 1) for n in reversed(node.body)]
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            if imports is not None:
                imports += [a.name for a in node.names] if isinstance(node, ast.Import) else ["." * node.level + (node.module or "")]
        else:
            for field in ("body", "orelse", "finalbody", "handlers", "cases"):
                stack += [(n, parent, in_class, depth) for n in reversed(getattr(node, field, None) or ()) if isinstance(n, ast.AST)]
    return out


_PYTHON_HEADER = re.compile(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)")


def indent_end(lines: list[str], start: int) -> int:
    """Index of the last line of the block that is indented below a line: up to the first line that says something at its indent or less."""
    base = len(lines[start]) - len(lines[start].lstrip())
    last = start
    for i in range(start + 1, len(lines)):
        bare = lines[i].strip()
        if not bare or bare.startswith("#"):
            continue
        if len(lines[i]) - len(lines[i].lstrip()) <= base:
            break
        last = i
    return last


def block_end(lines: list[str], start: int, how: str) -> int:
    """Index of the last line of the block that starts on a line: b braces, i indent, e the word end, l the line. Lines are blanked."""
    if how == "l":
        return start
    if how == "i":
        return indent_end(lines, start)
    if how == "e":
        indent = len(lines[start]) - len(lines[start].lstrip())
        for i in range(start + 1, len(lines)):
            bare = lines[i].strip()
            if (bare == "end" or bare.startswith(("end ", "end.", "end)", "end,"))) and len(lines[i]) - len(lines[i].lstrip()) <= indent:
                return i
        return start
    depth, parens, seen = 0, 0, False
    for i in range(start, len(lines)):
        for c in re.findall(r"[{}();]", lines[i]):
            if c == "{":
                depth, seen = depth + 1, True
            elif c == "}":
                depth -= 1
                if seen and depth <= 0:
                    return i
            elif c in "()":
                parens += 1 if c == "(" else -1
            elif not seen and parens <= 0:
                return i
        if depth < 0:
            return start
    return len(lines) - 1 if seen else start


def _signature(lines: list[str], bare: list[str], at: int) -> str:
    """The header from its line to where its block, body or statement begins."""
    out, depth = [], 0
    for raw, b in zip(lines[at:], bare[at:]):
        cut = re.search(r"\{|;|=>|(?<![<=!>])=(?!=)\s*$", b)
        if depth + b.count("(") - b.count(")") <= 0 and cut:
            out.append(raw[: cut.start()])
            break
        out.append(raw)
        depth += b.count("(") - b.count(")")
        if depth <= 0:
            break
    return " ".join(" ".join(out).split())


def table_declarations(language: str, text: str, blocks: bool = True) -> list[tuple]:
    """Declarations by header patterns; without ``blocks`` each ends on its own line."""
    how, patterns = _COMPILED[language]
    bare_text = blanked(language, text)
    lines, bare = text.split("\n"), bare_text.split("\n")
    out: list[tuple] = []
    open_: list[tuple[int, str]] = []
    for i, line in enumerate(lines):
        if not bare[i].strip():
            continue
        for kind, p in patterns:
            if m := p.search(line):
                if not bare[i][: m.end()].strip():
                    continue  # stands in a comment or string
                end = block_end(bare, i, how) if blocks else i
                while open_ and open_[-1][0] < i:
                    open_.pop()
                head = line[: m.start(1)]
                modifiers = [w for w in re.findall(r"\w+", head) if w in MODIFIERS]
                out.append((kind, m[1], i + 1, end + 1, open_[-1][1] if open_ else None, len(open_), docs.above(lines, i), _signature(lines, bare, i), modifiers))
                if end > i:
                    open_.append((end, m[1]))
                break
    return out


def imports_of(language: str, text: str) -> list[str]:
    """What a file names as needed, each once, in order of place."""
    bare = blanked(language, text) if language != "graphql" else text
    found = sorted((m.start(), m[1]) for p in _IMPORTS.get(language, ()) for m in p.finditer(text) if bare[m.start() : m.end()].strip() or m[0].lstrip()[:1] == '"')
    if language == "go":  # bare strings on lines of their own are imports only inside an import block
        blocks = [m.span() for m in re.finditer(r"(?m)^import\s*\([^)]*\)", text)]
        found = [(at, x) for at, x in found if text[at:].lstrip().startswith("import") or any(a <= at < b for a, b in blocks)]
    return list(dict.fromkeys(x for _, x in found))


def chain(language: str | None, text: str, enough: int = 1) -> list[tuple]:
    """(parser, quality, error, declarations, imports, missed) of each parser that was asked, in order."""
    out: list[tuple] = []
    if language is None:
        return [("text", "unknown", "unknown language", [], [], ["declarations", "imports"])]
    if language in ("markdown", "restructuredtext", "text", "config", "yaml", "ini", "xml", "html") and language not in _COMPILED:
        n = text.count("\n") + 1
        return [("text", "basic", None, [("module", "module", 1, n, None, 0, text, "", [])], [], [])]
    if language == "python":
        needed: list[str] = []
        found = python_declarations(text, needed)
        out.append(("syntax_tree", "full", None if found is not None else "syntax error", found or [], list(dict.fromkeys(needed)) if found is not None else [], []))
        if found is not None and len(found) >= enough:
            return out
        lines = text.split("\n")
        bare = blanked("python", text).split("\n")
        rough = [("class" if m[2] == "class" else "function", m[3], i + 1, indent_end(bare, i) + 1, None, 0, None, line.strip().removesuffix(":"), []) for i, line in enumerate(lines) if bare[i].strip() and (m := _PYTHON_HEADER.match(line))]
        needed = [m[1] for m in re.finditer(r"(?m)^[ \t]*(?:from|import)[ \t]+([A-Za-z_.][\w.]*)", text)]
        out.append(("headers", "partial", None, rough, list(dict.fromkeys(needed)), ["docstrings", "parents"]))
        return out
    if language not in _COMPILED:
        return [("text", "unknown", "no parser", [], [], ["declarations", "imports"])]
    for name, quality, blocks, missed in (("headers", "partial", True, []), ("lines", "basic", False, ["blocks", "parents"])):
        try:
            found, error = table_declarations(language, text, blocks), None
        except (RecursionError, MemoryError) as e:
            found, error = [], type(e).__name__
        out.append((name, quality, error, found, imports_of(language, text), missed))
        if len(found) >= enough:
            break
    return out


def _text(content: str) -> str:
    return content.lstrip("\ufeff").replace("\r\n", "\n")


def _carry(files: DataFrame) -> list[str]:
    return [c for c in ("file_id", "delivery", "path") if c in files.columns]


def parses(files: DataFrame, enough: int = 1) -> DataFrame:
    """(file_id, path, parser_ord, parser_type, parser_quality, error, declarations, imports, missed_features): what each parser of the chain said."""

    def kernel(paths, contents):
        out = []
        for path, content in zip(paths, contents):
            said = chain(K.language_of_path(path), _text(content), enough) if content else []
            out.append([(k, name, quality, error, found, needed, missed) for k, (name, quality, error, found, needed, missed) in enumerate(said)])
        return [out]

    each = map_rows(files, _carry(files), ["path", "content"], kernel, f"parses {PARSE}", costly=True)
    return K.once(each, "path", "parses").select("file_id", "path", F.explode("parses").alias("p")).select("file_id", "path", "p.*")


def file_declarations(path: str | None, content: str | None) -> tuple[str | None, list[tuple], bool]:
    """(language, declarations, degraded) of one file by the best parser that found any."""
    language = K.language_of_path(path)
    if not content or language is None or (language != "python" and language not in _COMPILED):
        return language, [], False
    said = chain(language, _text(content))
    best = next((x for x in said if x[3]), said[0])
    return language, best[3], best is not said[0] or bool(said[0][2])


def declarations(files: DataFrame) -> DataFrame:
    """One row a declaration: (file_id, path, language, kind, name, start_line, end_line, parent, depth, docstring, signature, modifiers, degraded)."""

    def kernel(paths, contents):
        out: list[list] = [[], [], []]
        for path, content in zip(paths, contents):
            for c, v in zip(out, file_declarations(path, content)):
                c.append(v)
        return out

    each = map_rows(files, _carry(files), ["path", "content"], kernel, f"language string, found {DECLARATION}, degraded boolean", costly=True)
    return K.once(each, "path", "language", "found", "degraded").select("file_id", "path", "language", F.explode("found").alias("d"), "degraded").select("file_id", "path", "language", "d.*", "degraded")


def imports(files: DataFrame) -> DataFrame:
    """(file_id, path, import): distinct, of every language with imports."""

    def kernel(paths, contents):
        out = []
        for path, content in zip(paths, contents):
            language = K.language_of_path(path)
            said = chain(language, _text(content)) if content and (language == "python" or language in _COMPILED) else []
            out.append(next((list(x[4]) for x in said if x[4]), []))
        return [out]

    each = map_rows(files, _carry(files), ["path", "content"], kernel, "found array<string>", costly=True)
    return K.once(each, "path", "found").select("file_id", "path", F.explode("found").alias("import")).distinct()


def by_kind(decls: DataFrame) -> DataFrame:
    return decls.groupBy("language", "kind").agg(F.count("*").alias("declarations"), F.round(F.avg(F.col("end_line") - F.col("start_line") + 1), 1).alias("mean_lines"), F.count_if(F.col("docstring").isNotNull()).alias("documented"))


def names_by_kind(decls: DataFrame) -> DataFrame:
    """(file_id, kind, names): the names of a file by kind, in order."""
    return decls.groupBy("file_id", "kind").agg(F.array_sort(F.collect_list("name")).alias("names"))


def nesting(decls: DataFrame) -> DataFrame:
    """(file_id, declarations, max_depth): how many there are with all their children, and how deep they go."""
    return decls.groupBy("file_id").agg(F.count("*").alias("declarations"), (F.max("depth") + 1).alias("max_depth"))


def compared(p: DataFrame) -> DataFrame:
    """(parser_type, files, errors, declarations, documented_share, max_depth, imports) of ``parses``."""
    d = F.col("declarations")
    documented = F.size(F.filter(d, lambda x: x["docstring"].isNotNull()))
    return p.groupBy("parser_type").agg(
        F.count("*").alias("files"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.sum(F.size(d)).alias("declarations"),
        F.round(F.coalesce(F.sum(documented) / F.nullif(F.sum(F.size(d)), F.lit(0)), F.lit(0.0)), 6).alias("documented_share"),
        F.coalesce(F.max(F.array_max(F.transform(d, lambda x: x["depth"])) + 1), F.lit(0)).alias("max_depth"),
        F.sum(F.size("imports")).alias("imports"),
    )


def annotations(decls: DataFrame) -> DataFrame:
    """(file_id, summary, tags): what a file declares, in words."""
    n = decls.groupBy("file_id").pivot("kind", ["function", "method", "class", "struct", "interface"]).agg(F.count("name"))
    words = F.filter(F.array(*(F.when(F.col(k) > 0, F.concat(F.col(k).cast("string"), F.lit(f" {k}"), F.when(F.col(k) > 1, "es" if k == "class" else "s").otherwise(""))) for k in ("function", "method", "class", "struct", "interface"))), lambda x: x.isNotNull())
    tags = F.filter(F.array(*(F.when(F.col(k) > 0, f"has_{k}") for k in ("function", "method", "class", "struct", "interface"))), lambda x: x.isNotNull())
    return n.select("file_id", F.when(F.size(words) > 0, F.concat(F.lit("Contains "), F.array_join(words, ", "))).alias("summary"), tags.alias("tags"))


def longest(decls: DataFrame, n: int = 3, least: int = 3) -> DataFrame:
    """The n longest functions of each file with at least ``least`` lines; ties by place. The limit is the feature."""
    from pyspark.sql import Window

    w = Window.partitionBy("file_id").orderBy((F.col("start_line") - F.col("end_line")), "start_line", "name")
    f = decls.filter(F.col("kind").isin("function", "method")).withColumn("rank", F.row_number().over(w))
    return f.filter((F.col("rank") <= n) & (F.col("end_line") - F.col("start_line") + 1 >= least)).select("file_id", "name", "start_line", "end_line", "rank")
