"""Grammars as layers: code becomes a string of token codes, and brackets are reduced from the inside out.

Each innermost bracket group is replaced by one character that says which constructs its content can be
(a block, an object, arguments, ...). What is left between brackets is regular, so that a few compiled
patterns decide it; and as the content of a group is a short string of codes, its verdict is remembered
and most groups of a corpus cost one look-up. The memo is bounded and only saves time.
"""

from __future__ import annotations

import re
from functools import lru_cache

from corpusmill.llm import lexers

MEMO = 200_000
#: No construct of these languages has so many names side by side, whatever macros or modifiers they are; it decides without trying.
_NAMES = "i" * 48
_GROUP = re.compile(r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}")
_FIRST = 0x80  # reduced groups are characters below 256, which keeps character classes small and quick to compile


class Layout:
    """Characters for the verdicts on paren, square, brace and keyword groups: as many bits each as the grammar needs."""

    def __init__(self, *widths: int) -> None:
        self.bases, at = [], _FIRST
        for w in widths:
            self.bases.append((at, 1 << w))
            at += 1 << w
        assert at <= 256, "too many verdicts"

    def having(self, kind: int, bits: int) -> str:
        """A character class of the groups of a kind that can be one of ``bits``."""
        base, n = self.bases[kind]
        return "[" + "".join(chr(base + k) for k in range(n) if k & bits) + "]"

    def any_of(self, *kinds: int) -> str:
        return "[" + "".join(f"{chr(self.bases[k][0])}-{chr(sum(self.bases[k]) - 1)}" for k in kinds) + "]"


PAREN, SQUARE, BRACE, KEYED = range(4)
_KIND = {"(": PAREN, "[": SQUARE, "{": BRACE}


class Grammar:
    """Base: subclasses give TOKEN, CODES, ``word``, ``classify`` and ``whole``."""

    language = ""
    TOKEN: re.Pattern
    CODES: dict[str, str]
    keep_lines = False
    WORD, NUMBER = "i", "l"
    layout: Layout

    def __init__(self) -> None:
        self.line_memo: dict[str, str] = {}
        self.group_memo: dict[str, str] = {}
        self.whole_memo: dict[str, bool] = {}

    def token(self, t: str) -> str:
        c = t[0]
        if c.isalpha() or c == "_" or c == "$":
            return self.WORD
        if c.isdigit():
            return self.NUMBER
        return "￾"

    def line(self, text: str) -> str:
        get, token = self.CODES.get, self.token
        return "".join([c if (c := get(t)) is not None else token(t) for t in self.TOKEN.findall(text)])

    def shape(self, code: str) -> str:
        memo, out = self.line_memo, []
        for line in code.split("\n"):
            line = line.strip()
            if (c := memo.get(line)) is None:
                if len(memo) > MEMO:
                    memo.clear()
                c = memo[line] = self.line(line)
            out.append(c)
        return ("\n" if self.keep_lines else "").join(out)

    def tidy(self, codes: str) -> str:
        return codes

    def _reduce(self, m: re.Match) -> str:
        g = m[0]
        c = self.group_memo.get(g)
        if c is None:
            if len(self.group_memo) > MEMO:
                self.group_memo.clear()
            c = self.group_memo[g] = chr(self.layout.bases[_KIND[g[0]]][0] + int(self.classify(g[0], g[1:-1])))
        return c

    def classify(self, kind: str, inner: str) -> int:
        raise NotImplementedError

    def whole(self, codes: str) -> bool:
        raise NotImplementedError

    def parses(self, scan: lexers.Scan) -> bool:
        if not scan.ok:
            return False
        codes = self.tidy(self.shape(scan.code))
        if "￾" in codes or _NAMES in codes:
            return False
        while True:
            less = _GROUP.sub(self._reduce, codes)
            if less == codes:
                break
            codes = less
        if any(c in codes for c in "()[]{}"):
            return False
        v = self.whole_memo.get(codes)
        if v is None:
            if len(self.whole_memo) > MEMO // 10:
                self.whole_memo.clear()
            v = self.whole_memo[codes] = self.whole(codes)
        return v


def _codes(**words: str) -> dict[str, str]:
    return {w: c for c, ws in words.items() for w in ws.split()}


def _full(p: str) -> re.Pattern:
    return re.compile(p)


def chain(unit: str, operators: str) -> str:
    """Units joined by operators or by the middle of a conditional."""
    return rf"(?:{unit}(?:(?:{operators}|\?{unit}(?:{operators}{unit})*:){unit})*)"


# ---------------------------------------------------------------------------------- JavaScript, TypeScript
class Script(Grammar):
    """ECMAScript, with types if ``typed``. Line breaks that can end a statement stay as codes."""

    keep_lines = True
    layout = Layout(5, 2, 5)
    TOKEN = re.compile(
        r"\??\.\s*#?[A-Za-z_$][\w$]*|\?\.(?=[(\[])|\.\.\.|@[A-Za-z_$][\w$.]*|#?[^\W\d][\w$]*(?=\s*:(?!:))|#?(?:[^\W\d]|\$)[\w$]*|\.?\d[\w.]*(?:(?<=[eE])[+-]\d+)?"
        r"|>>>=|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|===|!==|=>|==|!=|<=|&&|\|\||\?\?|\+\+|--|\*\*|<<|[-+*/%&|^]=|\?(?=\s*:)|\s+|[\s\S]"
    )
    _BASE = {
        **_codes(v="var let const", f="function", r="return", H="throw", I="if", W="while with", F="for", E="else", D="do", T="try", C="catch", Y="finally", S="switch", c="case", d="default", B="break continue", K="class", x="extends", N="new", M="import", X="export", a="async", l="true false null", G="debugger", g="static get set", m="as from satisfies", O="of", w="await yield"),
        "typeof": "!", "void": "!", "delete": "!", "in": "o", "instanceof": "o", "!": "!", "~": "!", "+": "+", "-": "+", "++": "u", "--": "u", "=>": "A", "...": "~", "*": "*", "=": "=", "<": "<", ">": ">", "|": "|", "&": "&", "?": "?", ":": ":", ",": ",", ";": ";", "?.": "",
        lexers.STRING: "s", lexers.TEMPLATE: "t", lexers.REGEX: "l", lexers.CHAR: "s",
        **{c: c for c in "()[]{}"},
        **{c: "o" for c in "** == != === !== <= && || ?? << / % ^ >>>= **= <<= >>= &&= ||= ??= -= += *= /= %= &= |= ^=".split()},
    }
    NUMBER = "n"

    def __init__(self, typed: bool) -> None:
        super().__init__()
        self.typed, self.language = typed, "typescript" if typed else "javascript"
        self.CODES = dict(self._BASE)
        if typed:
            self.CODES |= _codes(g="static get set public private protected readonly abstract declare override accessor", j="interface", y="type", z="namespace module", e="enum", x="extends implements", k="keyof infer unique is asserts")
        else:
            self.CODES |= {"enum": "e"}
        having, any_of = self.layout.having, self.layout.any_of
        P_ANY, S_ANY, B_ANY = any_of(PAREN), any_of(SQUARE), any_of(BRACE)
        ID = "[iagmOyzjk]" if typed else "[iagmO]"
        WORD = "[a-zA-Z]"
        args, params, forh, expr = (having(PAREN, b) for b in (1, 2, 4, 8))
        sq = having(SQUARE, 1)
        block, obj, cls, cases, shape = (having(BRACE, b) for b in (1, 2, 4, 8, 16))
        names = enum = obj
        ty = self._types(ID, params, S_ANY, shape, having(PAREN, 16)) if typed else ""
        ret = rf"(?::{ty})?" if typed else ""
        func = rf"a?f\*?{ID}?{params}{ret}\n?{block}"
        klass = rf"K(?:(?!x){ID})?(?:x[{ID[1:-1]}]p*(?:{args})?(?:,{ID}p*)*)*\n?{cls}"
        pre = rf"(?:[!+uNw]|a?(?:{ID}|{params}){ret}A)"
        prim = rf"(?:{func}|{klass}|M(?:p|{args})|(?<=A){block}|[lnst]|{expr}|{sq}|{obj}|{ID})"
        post = rf"(?:p|{args}|{sq}|t|u" + (r"|!(?=[p;,\n:?=o+*<>|&]|$|" + S_ANY + r"))" if typed else ")")
        as_ = rf"(?:m{ty})*" if typed else ""
        unit = rf"{pre}*{prim}{post}*{as_}"
        E = chain(unit, r"(?:[o+*<|&=]|>{1,3}=?)")
        EL = chain(unit, r"(?:[o+*<|&=,]|>{1,3}=?)")
        end = r"(?:[;\n]|$)"
        bind = rf"(?:{ID}|{sq}|{obj})"
        colon = rf"(?:!?:{ty})?" if typed else ""
        var = rf"v{bind}{colon}(?:={E})?(?:,{bind}{colon}(?:={E})?)*"
        fdecl = rf"a?f\*?{ID}{params}{ret}\n?{block}"
        kdecl = rf"(?:q(?:{args})?\n?)*g*K{ID}(?:x{ID}p*(?:{args})?(?:,{ID}p*)*)*\n?{cls}"
        tdecl = rf"g*(?:j{ID}(?:x{ID}p*(?:,{ID}p*)*)?\n?{shape}|y{ID}={ty}{end}|v?e{ID}\n?{enum}|z(?:{ID}p*|s)\n?{block}|a?f\*?{ID}{params}{ret}{end}|{var}{end})" if typed else r"(?!)"
        mods = rf"(?:M[y]?(?:s|(?:{ID}|\*m{ID}|{names})(?:,(?:\*m{ID}|{names}))?ms){end}|X[y]?(?:{names}(?:ms)?{end}|\*(?:m{ID})?ms{end}|d(?:{fdecl}|a?f\*?{params}{ret}{block}|{kdecl}|K(?:x{ID}p*)?{cls}|{E}{end})|{var}{end}|{fdecl}|{kdecl}|{tdecl}))"
        simple = rf"(?:{var}|r(?:{EL})?|H{EL}|B{ID}?|G|{EL})"
        b0 = rf"(?:{block}|T{block}\n?(?:C(?:{params})?{block}\n?(?:Y{block})?|Y{block})|S{expr}\n?{cases}|;|{simple}{end})"
        head = rf"(?:W{expr}\n?|F[w]?{forh}\n?|{ID}:\n?)*"
        ifs = rf"I{expr}\n?{head}(?:(?:I{expr}\n?)*{b0})(?:\n?EI{expr}\n?{head}{b0})*(?:\n?E{head}{b0})?"
        stmt = rf"(?:[;\n]|{fdecl}|{kdecl}|{tdecl}|{mods}|{head}(?:{ifs}|D\n?{b0}\n?W{expr}{end}|{b0}))"
        self.block = _full(rf"(?:{stmt})*+")
        self.args = _full(rf"(?:~?{E}(?:,~?{E})*,?)?")
        self.expr = _full(EL)
        pm = rf"(?:q(?:{args})?)*g*~?{bind}(?:\??:{ty})?(?:={E})?" if typed else rf"~?{bind}(?:={E})?"
        self.params = _full(rf"(?:{pm}(?:,{pm})*,?)?")
        self.for_ = _full(rf"(?:(?:{var}|{EL})?;(?:{EL})?;(?:{EL})?|v?{bind}{colon}(?:O|o){EL}|{unit}(?:O|o){EL})")
        self.square = _full(rf",*(?:~?{E}(?:,+~?{E})*,*)?")
        key = rf"(?:{WORD}|[sn]|{sq})"
        member = rf"(?:~{E}|{key}:{E}|y?(?:{ID}|[sd])(?:={E}|m{WORD})?|(?:[ag]|\*|a\*)?{key}{params}{ret}{block})"
        self.object = _full(rf"(?:{member}(?:,{member})*,?)?")
        field = rf"{key}(?:\?|!)?(?::{ty})?(?:={E})?{end}" if typed else rf"{key}(?:={E})?{end}"
        method = rf"a?\*?(?:{key}|g(?={key})){params}{ret}\n?(?:{block}" + (rf"|{end})" if typed else ")")
        self.klass = _full(rf"(?:[;\n]|(?:q(?:{args})?\n?)*[ga]*?(?:{method}|{field}|(?<=g){block}))*+")
        self.cases = _full(rf"\n*(?:(?:c{EL}|d):(?:{stmt})*+)*+\n*")
        if typed:
            mem = rf"g*(?:{key}?\??{params}{ret}|N{params}{ret}|{key}\??(?::{ty})?|{S_ANY}\??:{ty})"
            self.shape_ = _full(rf"[;,\n]*(?:{mem}(?:[;,\n]+{mem})*[;,\n]*)?")
            self.index = _full(rf"(?:{ID}:{ty}|{ID}o{ty}|{ty}(?:,{ty})*,?)")
            self.types_only = _full(rf"(?:~?(?:{ID}\??:)?{ty}(?:,~?(?:{ID}\??:)?{ty})*,?)?")
            inside = "itklnspx,|&=.:?A!\\[\\]y" + "agmOzjk" + S_ANY[1:-1] + B_ANY[1:-1] + P_ANY[1:-1]
            self.generic = re.compile(rf"(?<=[{ID[1:-1]}pfN{S_ANY[1:-1]}=,(\n])<[{inside}]*>(?=[(),;{{}}\[\]=:>|&\npAx?!.{P_ANY[1:-1]}{B_ANY[1:-1]}{S_ANY[1:-1]}i]|$)|^<[{inside}]*>")

    @staticmethod
    def _types(ID: str, params: str, square: str, shape: str, paren: str) -> str:
        part = rf"(?:[k!]|g(?=[{ID[1:-1]}k{square[1:-1]}]))*(?:{params}A)*(?:{ID}p*|[lnst]|!|{shape}|{square}|{paren})(?:{square})*"
        return rf"(?:\|?(?:k?{ID}k(?={ID}))?{part}(?:[|&x?:]{part})*)"

    def token(self, t: str) -> str:
        c = t[0]
        if c in ".?" and len(t) > 1 and (t[-1].isalnum() or t[-1] in "_$"):
            return "n" if t[1].isdigit() else "p"
        if c == "@":
            return "q"
        if c.isspace():
            return ""
        if c == "?":
            return ""  # an optional mark before a colon
        if c == "#" and len(t) > 1:
            return "i"
        if c == "." and t[1:2].isdigit():
            return "n"
        if c.isdigit() and not re.fullmatch(r"0[xX][0-9a-fA-F_]+n?|0[bB][01_]+n?|0[oO]?[0-7_]+n?|[0-9][0-9_]*n?(?:\.[0-9_]*)?(?:[eE][+-]?[0-9_]+)?|\d+\.?\d*", t):
            return "￾"
        return super().token(t)

    _LABEL = re.compile(r"#?[^\W\d][\w$]*(?=\s*:(?!:))")
    _NOT_ENDING = r"(?<=[!+oNw=<>|&?:,.(\[*~AxEDTYvfKcMXHIFW{;])\n+"
    _GOES_ON = r"\n+(?=[o+*=<>|&?:,.)\]pAxmt}])"
    _LINES = re.compile(_NOT_ENDING + "|" + _GOES_ON + r"|\n+(?=[CEY]|W" + r"\()|(?<=\n)\n+|\n+$|^\n+")
    _BEFORE_BRACE = re.compile(r"(?<=\))\n+(?=\{)")

    def line(self, text: str) -> str:
        get, token, out = self.CODES.get, self.token, []
        tokens = self.TOKEN.findall(text)
        for k, t in enumerate(tokens):
            c = get(t)
            if c is None:
                c = token(t)
            if c and c in "vfrHIWFEDTCYSBKxNMXlGwe!o" and t[0].isalpha() and t not in ("typeof", "void", "delete", "in", "instanceof"):
                after = "".join(tokens[k + 1 : k + 3]).lstrip()
                if after[:1] == ":" and t not in ("default", "case") and c not in "l":
                    c = "i"
            out.append(c)
        return "".join(out)

    def shape(self, code: str) -> str:
        if code.startswith("#!"):
            code = code[code.find("\n") + 1 :] if "\n" in code else ""
        return super().shape(code)

    def tidy(self, codes: str) -> str:
        return self._BEFORE_BRACE.sub("", self._LINES.sub("", codes))

    def _drop_generics(self, codes: str) -> str:
        if self.typed and "<" in codes:
            while True:
                less = self.generic.sub("", codes)
                if less == codes:
                    break
                codes = less
        return codes

    def _reduce(self, m: re.Match) -> str:
        return super()._reduce(m)

    def parses(self, scan: lexers.Scan) -> bool:
        return super().parses(scan)

    def classify(self, kind: str, inner: str) -> int:
        mask = self._classify(kind, inner)
        if self.typed and "<" in inner:
            mask |= self._classify(kind, self._drop_generics(inner))
        return mask

    def _classify(self, kind: str, inner: str) -> int:
        flat = inner.replace("\n", "")
        if kind == "(":
            mask = bool(self.args.fullmatch(flat)) | bool(self.params.fullmatch(flat)) << 1 | bool(self.expr.fullmatch(flat)) << 3
            if ";" in flat or "O" in flat or "o" in flat:
                mask |= bool(self.for_.fullmatch(flat)) << 2
            if self.typed:
                mask |= bool(self.types_only.fullmatch(flat)) << 4
            return mask
        if kind == "[":
            mask = int(bool(self.square.fullmatch(flat)))
            if self.typed:
                mask |= bool(self.index.fullmatch(flat)) << 1 | (not flat) << 1
            return mask
        mask = bool(self.block.fullmatch(inner)) | bool(self.object.fullmatch(flat)) << 1 | bool(self.klass.fullmatch(inner)) << 2
        if not flat or "c" in flat or "d" in flat:
            mask |= bool(self.cases.fullmatch(inner)) << 3
        if self.typed:
            mask |= bool(self.shape_.fullmatch(inner)) << 4
        return mask

    def whole(self, codes: str) -> bool:
        return bool(self.block.fullmatch(codes)) or (self.typed and "<" in codes and bool(self.block.fullmatch(self._drop_generics(codes))))


# ------------------------------------------------------------------------------------------------- Java
class Java(Grammar):
    language = "java"
    layout = Layout(5, 2, 5)
    TOKEN = re.compile(r"\.\s*(?:[^\W\d][\w$]*|\*)|::\s*[^\W\d]\w*|@\s*[^\W\d][\w.]*|\.\.\.|default(?=\s*(?::|->))|[^\W\d][\w$]*|\d[\w.]*(?:(?<=[eE])[+-]\d+)?|\.\d[\w]*|<<=|[-+*/%&|^]=|->|==|!=|<=|&&|\|\||\+\+|--|<<|[^\s]")
    CODES = {
        **_codes(g="public private protected static final abstract synchronized native transient volatile strictfp sealed default", K="class interface enum @interface record", x="extends implements permits", w="throws", N="new", k="package", M="import", I="if", F="for", W="while", D="do", E="else", T="try", C="catch", Y="finally", S="switch", c="case", r="return yield", h="throw", B="break continue", a="assert", l="true false null", o="instanceof"),
        "record": "i", "yield": "i", "sealed": "i", "permits": "i",
        "->": "A", "++": "u", "--": "u", "+": "+", "-": "+", "!": "!", "~": "!", "=": "=", "<": "<", ">": ">", "&": "&", "|": "o", "?": "?", ":": ":", ",": ",", ";": ";", "...": "~",
        lexers.STRING: "s", lexers.CHAR: "l",
        **{c: c for c in "()[]{}"},
        **{c: "o" for c in "* / % ^ == != <= && || << <<= -= += *= /= %= &= |= ^=".split()},
    }

    def token(self, t: str) -> str:
        if t[0] == "." and len(t) > 1:
            return "l" if t[1].isdigit() else "p"
        if t.startswith("default"):
            return "d"
        if t.startswith("::"):
            return "p"
        if t[0] == "@":
            return "K" if t.replace(" ", "") == "@interface" else "q"
        if t[0].isdigit() and not re.fullmatch(r"0[xX][0-9a-fA-F_]+[lL]?|0[bB][01_]+[lL]?|[0-9_]+[lLdDfF]?|[0-9_]*\.?[0-9_]*(?:[eE][+-]?[0-9_]+)?[dDfF]?", t):
            return "￾"
        return super().token(t)

    def __init__(self) -> None:
        super().__init__()
        having, any_of = self.layout.having, self.layout.any_of
        P_ANY, S_ANY, B_ANY = any_of(PAREN), any_of(SQUARE), any_of(BRACE)
        args, params, forh, expr, res = (having(PAREN, b) for b in (1, 2, 4, 8, 16))
        sq, sqe = having(SQUARE, 1), having(SQUARE, 2)
        block, init, cls, cases, enum = (having(BRACE, b) for b in (1, 2, 4, 8, 16))
        note = rf"(?:q{P_ANY}?)*"
        ty = rf"{note}ip*{sqe}*"
        pre = rf"(?:[!+u]|{expr}(?=[ilsNS!{P_ANY[1:-1]}])|(?:i|{params})A)"
        prim = rf"(?:Nip*(?:{args}(?:{cls})?|(?:{sq}|{sqe})+(?:{init})?)|S{expr}{cases}|(?<=A){block}|i|[ls]|{expr})"
        unit = rf"{pre}*{prim}(?:p|{args}|{sq}|u|{sqe}p)*"
        E = chain(unit, r"(?:(?:[o+<&=]|>{1,3}=?)g?)")
        EL = chain(unit, r"(?:(?:[o+<&=,]|>{1,3}=?)g?)")
        decl = rf"i{sqe}*(?:=(?:{E}|{init}))?"
        decls = rf"{decl}(?:,{decl})*"
        kind = rf"{note}(?:g{note})*"
        ext = rf"(?:x{ty}(?:,{ty})*)*"
        types = rf"{kind}(?:K|i(?=i{P_ANY}))i(?:{params})?{ext}(?:{cls}|{enum})"
        local = rf"{kind}{ty}{decls};"
        b0 = rf"(?:{block}|T(?:{res})?{block}(?:C{params}{block})*(?:Y{block})?|S{expr}{cases}|g{expr}{block}|;|r(?:{E})?;|h{E};|Bi?;|a{E}(?::{E})?;|i(?=[lsN]){E};|{EL};)"
        head = rf"(?:W{expr}|F{forh}|i:)*"
        ifs = rf"I{expr}{head}(?:I{expr})*{b0}(?:EI{expr}{head}{b0})*(?:E{head}{b0})?"
        stmt = rf"(?:{types}|{local}|{head}(?:{ifs}|D{b0}W{expr};|{b0}))"
        self.block = _full(rf"(?:{stmt})*+")
        self.args, self.expr = _full(rf"(?:{EL})?"), _full(rf"(?:{E}|{ty}(?:&{ty})*)")
        pm = rf"{kind}(?:{ty}(?:o{ty})*~?)?i{sqe}*"
        self.params = _full(rf"(?:{pm}(?:,{pm})*)?")
        self.for_ = _full(rf"(?:(?:{kind}{ty}{decls}|{EL})?;(?:{E})?;(?:{EL})?|{kind}{ty}i:{E})")
        self.res = _full(rf"(?:{kind}{ty}i=)?{E}(?:;(?:{kind}{ty}i=)?{E})*;?")
        self.square = _full(E)
        self.init = _full(rf"(?:(?:{E}|{init})(?:,(?:{E}|{init}))*,?)?")
        throws = rf"(?:w{ty}(?:,{ty})*)?"
        member = rf"(?:;|{types}|{kind}(?:{ty}i{params}{sqe}*{throws}(?:g{E})?(?:{block}|;)|i(?:{params})?{throws}{block}|{ty}{decls};|{block}))"
        self.klass = _full(rf"(?:{member})*+")
        const = rf"{note}i(?:{args})?(?:{cls})?"
        self.enum = _full(rf"(?:{const}(?:,{const})*)?,?(?:;(?:{member})*+)?")
        self.cases = _full(rf"(?:(?:c{EL}|d)(?::(?:{stmt})*+|A(?:{block}|h{E};|{E};)))*+")
        self.file = _full(rf"(?:{note}kip*;)?(?:Mg?ip*;|;)*(?:{types}|;)*+")
        self.generic = re.compile(rf"(?:(?<=[igpq;}}{{{P_ANY[1:-1]}{B_ANY[1:-1]}])|^)<(?:[ip,?&qx]|{S_ANY})*>")

    def tidy(self, codes: str) -> str:
        return codes.replace("g:", "d:").replace("gA", "dA")  # a modifier before these is the default of a switch

    def _generics(self, codes: str) -> str:
        while True:
            less = self.generic.sub("", codes)
            if less == codes:
                return codes
            codes = less

    def classify(self, kind: str, inner: str) -> int:
        mask = self._classify(kind, inner)
        if "<" in inner:
            mask |= self._classify(kind, self._generics(inner))
        return mask

    def _classify(self, kind: str, inner: str) -> int:
        if kind == "(":
            mask = bool(self.args.fullmatch(inner)) | bool(self.params.fullmatch(inner)) << 1 | bool(self.expr.fullmatch(inner)) << 3 | bool(self.res.fullmatch(inner)) << 4
            return mask | ((";" in inner or ":" in inner) and bool(self.for_.fullmatch(inner))) << 2
        if kind == "[":
            return 2 if not inner else int(bool(self.square.fullmatch(inner)))
        return bool(self.block.fullmatch(inner)) | bool(self.init.fullmatch(inner)) << 1 | bool(self.klass.fullmatch(inner)) << 2 | bool(self.cases.fullmatch(inner)) << 3 | bool(self.enum.fullmatch(inner)) << 4

    def whole(self, codes: str) -> bool:
        return bool(self.file.fullmatch(codes)) or bool("<" in codes and self.file.fullmatch(self._generics(codes)))


# --------------------------------------------------------------------------------------------------- Go
class Go(Grammar):
    language = "go"
    layout = Layout(4, 1, 5)
    keep_lines = True
    TOKEN = re.compile(r"\.\s*[^\W\d]\w*|\.(?=\()|\.\.\.|[^\W\d]\w*|\d[\w.]*(?:(?<=[eEpP])[+-]\d+)?|\.\d\w*|&\^=|<<=|>>=|[-+*/%&|^:=!<>]=|<-|&&|\|\||\+\+|--|<<|>>|&\^|[^\s]")
    CODES = {
        **_codes(f="func", r="return", I="if", F="for", R="range", S="switch select", c="case", d="default", G="go defer", y="type", t="struct", n="interface", m="map", h="chan", k="package", M="import", v="var const", E="else", B="break continue goto fallthrough"),
        ":=": "D", "=": "=", "<-": "w", "*": "*", "&": "*", "+": "+", "-": "+", "^": "+", "!": "!", "++": "u", "--": "u", "...": "~", ".": "", ",": ",", ";": ";", ":": ":", "|": "|", "~": "!",
        lexers.STRING: "s", lexers.CHAR: "l",
        **{c: c for c in "()[]{}"},
        **{c: "o" for c in "/ % == != <= >= < > && || << >> &^".split()},
        **{c: "=" for c in "+= -= *= /= %= &= |= ^= <<= >>= &^=".split()},
    }
    _ENDS = frozenset("ilsrBu)]}p")

    def token(self, t: str) -> str:
        if t[0] == "." and len(t) > 1:
            return "l" if t[1].isdigit() else "p"
        if t[0].isdigit() and not re.fullmatch(r"0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?i?|0[bBoO]?[0-9_]+i?|[0-9_]+\.?[0-9_]*(?:[eE][+-]?\d+)?i?", t):
            return "￾"
        return super().token(t)

    def line(self, text: str) -> str:
        codes = super().line(text)
        return codes + ";" if codes and codes[-1] in self._ENDS else codes

    def shape(self, code: str) -> str:
        codes = super().shape(code).replace("\n", "")
        return codes

    def __init__(self) -> None:
        super().__init__()
        having, any_of = self.layout.having, self.layout.any_of
        P_ANY, S_ANY, B_ANY = any_of(PAREN), any_of(SQUARE), any_of(BRACE)
        args, params, group = (having(PAREN, b) for b in (1, 2, 4))
        sq = having(SQUARE, 1)
        block, lit, fields, methods, cases = (having(BRACE, b) for b in (1, 2, 4, 8, 16))
        pre_t = rf"(?:\*|{sq}|m{sq}|h|w)*"
        base = rf"(?:ip*(?:{sq})?|t{fields}|n{methods}|{params})"
        fn = rf"f{params}(?:{pre_t}{base})?"
        ty = rf"{pre_t}(?:{base}|{fn})"
        prim = rf"(?:f{params}(?:{ty})?{block}|f{params}(?:{ty})?|i|[ls]|{args}|t{fields}|n{methods})"
        unit = rf"(?:[!+*wh]|m?{sq})*{prim}(?:p|{args}|{sq}|{lit})*"
        E = rf"{unit}(?:[o+*|w]{unit})*"
        EL = rf"(?:{unit}(?:[o+*|w,]{unit})*)"
        simple = rf"{EL}(?:[=D]{EL}|u)?"
        vspec = rf"i(?:,i)*(?:(?!=){ty})?(?:={EL})?"
        tspec = rf"i(?:{sq})?=?{ty}"
        ifs = rf"I(?:(?:{simple})?;)?{E}{block}(?:EI(?:(?:{simple})?;)?{E}{block})*(?:E{block})?"
        fors = rf"F(?:(?:{simple})?;(?:{E})?;(?:{simple})?|(?:{EL}[=D])?R{E}|{E})?{block}"
        sw = rf"S(?:(?:{simple})?;)?(?:(?:iD)?{E})?{cases}"
        stmt = rf"(?:;|(?:i:;?)?(?:{ifs}|{fors}|{sw}|v(?:{vspec}|{group})|y(?:{tspec}|{group})|r(?:{EL})?|G{E}|Bi?|{block}|{simple})(?:;|$))"
        self.block = _full(rf"(?:{stmt})*+")
        arg = rf"(?:{E}|{ty}|y)"
        self.args = _full(rf"(?:{arg}(?:,{arg})*~?,?)?")
        pm = rf"(?:i(?:,i)*~?{ty}|~?{ty})"
        self.params = _full(rf"(?:{pm}(?:,{pm})*,?)?")
        self.group = _full(rf"(?:(?:{vspec}|{tspec});)*(?:{vspec}|{tspec})?")
        self.square = _full(rf"(?:~|{E}|(?:{E})?:(?:{E})?(?::{E})?|{ty}(?:,{ty})*|i(?:,i)*{ty}(?:\|{ty})*(?:,i(?:,i)*{ty}(?:\|{ty})*)*)?")
        el = rf"(?:{E}|{lit})"
        self.lit = _full(rf"(?:{el}(?::{el})?(?:,{el}(?::{el})?)*,?;?)?")
        self.fields = _full(rf"(?:(?:i(?:,i)*{ty}|\*?ip*(?:{sq})?)s?(?:;|$))*+")
        self.methods = _full(rf"(?:(?:i{params}(?:{ty})?|!?{ty}(?:\|!?{ty})*)(?:;|$))*+")
        self.cases = _full(rf"(?:(?:c(?:{simple}|{ty}(?:,{ty})*)|d):(?:{stmt})*+)*+")
        self.imports = _full(r"(?:[ip]?s;|_?s;)*[ip]?s?")
        imp = having(PAREN, 8)
        self.file = _full(rf";*ki;(?:M(?:[ip]?s|{imp});|;)*(?:(?:f(?:{params})?i(?:{sq})?{params}(?:{ty})?(?:{block})?|v(?:{vspec}|{group})|y(?:{tspec}|{group}))(?:;|$)|;)*+")

    def classify(self, kind: str, inner: str) -> int:
        if kind == "(":
            inner2 = inner.removesuffix(";")
            return bool(self.args.fullmatch(inner2)) | bool(self.params.fullmatch(inner2)) << 1 | bool(self.group.fullmatch(inner)) << 2 | bool(self.imports.fullmatch(inner)) << 3
        if kind == "[":
            return int(bool(self.square.fullmatch(inner)))
        return bool(self.block.fullmatch(inner)) | bool(self.lit.fullmatch(inner)) << 1 | bool(self.fields.fullmatch(inner)) << 2 | bool(self.methods.fullmatch(inner)) << 3 | bool(self.cases.fullmatch(inner)) << 4

    def whole(self, codes: str) -> bool:
        return bool(self.file.fullmatch(codes))


# ------------------------------------------------------------------------------------------------- Rust
class Rust(Grammar):
    language = "rust"
    layout = Layout(5, 1, 6)
    TOKEN = re.compile(r"\.\s*(?:[^\W\d]\w*|\d+)|::\s*<|::\s*[^\W\d]\w*|'[A-Za-z_]\w*|[^\W\d]\w*!(?=\s*[(\[{A-Za-z_])(?!\s*=)|r#[^\W\d]\w*|[^\W\d]\w*|\d[\w]*(?:\.\d[\w]*)?(?:(?<=[eE])[+-]\d+)?|\.\.=|\.\.\.|\.\.|<<=|>>=|[-+*/%&|^]=|->|=>|==|!=|<=|>=(?!>)|&&|\|\||<<|::|[^\s]")
    CODES = {
        **_codes(f="fn", v="let", m="mut ref", q="const static", g="pub", u="unsafe async move extern", d="dyn impl", w="where", F="for", n="in", I="if", E="else", M="match", W="while", O="loop", r="return", B="break continue", T="struct union", e="enum", t="trait", y="type", z="mod", U="use", l="true false", X="extern"),
        "impl": "p", "union": "i", "as": "a", "=>": "A", "->": "R", "::": "c", "..": "D", "..=": "D", "...": "D", "!": "!", "&": "&", "&&": "&", "*": "*", "-": "-", "+": "+", "=": "=", "<": "<", ">": ">", "|": "|", "||": "|", "?": "?", ":": ":", ",": ",", ";": ";", "#": "#", "@": "@", "$": "",
        lexers.STRING: "s", lexers.CHAR: "l",
        **{c: c for c in "()[]{}"},
        **{c: "o" for c in "/ % ^ == != <= >= << <<= >>= -= += *= /= %= &= |= ^=".split()},
    }

    def token(self, t: str) -> str:
        if t[0] == "." and len(t) > 1:
            return "."
        if t.startswith("::"):
            return "<" if t[-1] == "<" else "P"
        if t[0] == "'":
            return "L"
        if t[-1] == "!":
            return "Z"
        if t[0].isdigit() and not re.fullmatch(r"0x[0-9a-fA-F_]+(?:[iu](?:8|16|32|64|128|size))?|0[bo][0-9_]+(?:[iu]\w+)?|[0-9_]+(?:\.[0-9_]+)?(?:[eE][+-]?[0-9_]+)?(?:[iuf](?:8|16|32|64|128|size))?", t):
            return "￾"
        return super().token(t)

    def __init__(self) -> None:
        super().__init__()
        having, any_of = self.layout.having, self.layout.any_of
        P_ANY, S_ANY, B_ANY = any_of(PAREN), any_of(SQUARE), any_of(BRACE)
        args, params, vis = (having(PAREN, b) for b in (1, 2, 4))
        sq = having(SQUARE, 1)
        block, lit, fields, arms, items, uses = (having(BRACE, b) for b in (1, 2, 4, 8, 16, 32))
        variants = uses
        ptypes, pats = having(PAREN, 8), having(PAREN, 16)
        any_ = any_of(PAREN, SQUARE, BRACE)
        path = r"(?:c|P)?i(?:P)*"
        tpre = r"(?:[&*mLdqp]|F(?=L))*"
        tbase = rf"(?:{path}(?:{ptypes}(?:R{tpre}{path})?)?|{ptypes}|{sq}|!|u*f{ptypes}(?:R{tpre}(?:{path}|{ptypes}))?|Z{any_})"
        ty = rf"(?:\??{tpre}{tbase}(?:\+(?:\??{tpre}{tbase}|L))*)"
        pat = rf"(?:[&*mq@|D\-PcL]|i(?![ils])|[ls](?![ils])|{pats}|{sq}|(?<=[iP]){fields}|(?<=[iP]){lit})+"
        par = rf"\|(?:(?:[imlsq&*,:PLdp<>\-]|{any_})*\|)?(?:R{ty})?"
        blocklike = rf"(?:(?:L:)?(?:u*{block}|O{block}|W(?:v{pat}=)?�{block}|F{pat}n�{block})|M�{arms}|I(?:v{pat}=)?�(?:{block})(?:EI(?:v{pat}=)?�{block})*(?:E{block})?)"
        prim0 = rf"(?:[ls]|{path}|{args}|{sq}|Z{any_}|r|B(?:L)?|D)"
        post = rf"(?:\.|{args}|{sq}|\?|a{ty})*"
        pre = rf"(?:[!*&\-m]|u?{par}|r|D|BL?(?=[ils]))*"
        unit0 = rf"{pre}{prim0}{post}"
        op = r"(?:[o+*&|<>=\-]|>>=?|D)"
        flat = rf"(?:{unit0}(?:{op}{unit0})*D?)"  # no braces: heads of if, while, match, for
        flat = rf"(?:{unit0}(?:{op}(?:v{pat}=)?{unit0})*D?)"
        blocklike = blocklike.replace("�", flat)
        prim = rf"(?:{path}{lit}|{blocklike}|{prim0})"
        unit = rf"{pre}{prim}{post}"
        E = rf"(?:{unit}(?:{op}{unit})*D?)"
        where = rf"(?:w(?:(?:L|{ty}):(?:L|{ty})?(?:\+(?:L|{ty}))*,?)*)?"
        g = rf"(?:g(?:{vis})?)?"
        fn = rf"{g}(?:[uqX]s?)*fi{params}(?:R{ty})?{where}(?:{block}|;)"
        use = rf"{g}U(?:c|P)?[i]?(?:P|c)*(?:c?{uses}|c?\*)?(?:ai)?;"
        struct = rf"{g}Ti(?:{where}{fields}|{ptypes}{where};|;)"
        item = rf"(?:{fn}|{use}|{struct}|{g}ei{where}{variants}|{g}u*ti(?::{ty}(?:\+L)?)?{where}{items}|u*p(?:!?{ty}F)?{ty}{where}{items}|{g}zi(?:{items}|;)|{g}yi(?::{ty})?(?:={ty})?;|{g}qm?i:{ty}(?:={E})?;|uis;|us?{items}|Z(?:i)?(?:{B_ANY}|(?:{P_ANY}|{S_ANY});))"
        stmt = rf"(?:;|{item}|v{pat}(?::{ty})?(?:={E}(?:E{block})?)?;|{blocklike}(?![.?])|{E};)"
        self.block = _full(rf"(?:{stmt})*+(?:{E})?")
        self.block2 = _full(rf"(?>{stmt})*(?:{E})?")
        self.items = _full(rf"(?:{item}|;)*+")
        self.args = _full(rf"(?:{E}(?:,{E})*,?)?")
        pm = rf"(?:{pat}:{ty}|&?L?m?i|~)"
        self.params = _full(rf"(?:{pm}(?:,{pm})*,?)?")
        self.vis = _full(r"(?:i|ni(?:P)*|nP+)")
        self.types = _full(rf"(?:{g}{ty}(?:,{g}{ty})*,?)?")
        self.pats = _full(rf"(?:{pat}(?:,{pat})*,?)?")
        self.square = _full(rf"(?:{E}(?:,{E})*,?|{E};{E}|{ty}(?:;{E})?|{pat}(?:,{pat})*)?")
        self.lit = _full(rf"(?:(?:i(?::{E})?|l:{E})(?:,(?:i(?::{E})?|l:{E}))*,?(?:D{E})?)?")
        self.fields = _full(rf"(?:{g}i:{ty}(?:,{g}i:{ty})*,?|(?:m*i(?::{pat})?)(?:,m*i(?::{pat})?)*,?D?|D)?")
        self.arms = _full(rf"(?:{pat}(?:I{E})?A(?:{blocklike}(?=$|[^.?,o+]),?|{E}(?:,|$)))*+")
        self.uses = _full(rf"(?:(?:i|P)(?:P|c)*(?:c?{uses}|c?\*)?(?:ai)?|\*|{uses})(?:,(?:(?:i|P)(?:P|c)*(?:c?{uses}|c?\*)?(?:ai)?|\*))*,?|")
        self.variants = _full(rf"(?:i(?:{ptypes}|{fields})?(?:={E})?(?:,i(?:{ptypes}|{fields})?(?:={E})?)*,?)?")
        self.generic = re.compile(rf"(?:(?<=[iPpFf.,<&(:RLd+=;]))<(?:[iPcL,:+?=&*mdqlp!;]|{S_ANY}|{P_ANY}|R)*>(?!=)|^<(?:[iPcL,:+?=&*mdq]|{S_ANY}|{P_ANY})*>")
        self.attribute = re.compile(rf"#!?{S_ANY}")

    def _generics(self, codes: str) -> str:
        while True:
            less = self.generic.sub("", codes)
            if less == codes:
                return codes
            codes = less

    def classify(self, kind: str, inner: str) -> int:
        inner = self.attribute.sub("", inner)
        mask = self._classify(kind, inner)
        if "<" in inner:
            mask |= self._classify(kind, self._generics(inner))
        return mask

    def _classify(self, kind: str, inner: str) -> int:
        if kind == "(":
            return bool(self.args.fullmatch(inner)) | bool(self.params.fullmatch(inner)) << 1 | bool(self.vis.fullmatch(inner)) << 2 | bool(self.types.fullmatch(inner)) << 3 | bool(self.pats.fullmatch(inner)) << 4
        if kind == "[":
            return int(bool(self.square.fullmatch(inner)))
        block = bool(self.block.fullmatch(inner)) or bool(self.block2.fullmatch(inner))
        return block | bool(self.lit.fullmatch(inner)) << 1 | bool(self.fields.fullmatch(inner)) << 2 | bool(self.arms.fullmatch(inner)) << 3 | bool(self.items.fullmatch(inner)) << 4 | (bool(self.uses.fullmatch(inner)) or bool(self.variants.fullmatch(inner))) << 5

    def whole(self, codes: str) -> bool:
        codes = self.attribute.sub("", codes)
        return bool(self.items.fullmatch(codes)) or bool("<" in codes and self.items.fullmatch(self._generics(codes)))


# ---------------------------------------------------------------------------------------------------- C
class C(Grammar):
    language = "c"
    layout = Layout(6, 1, 4)
    TOKEN = re.compile(r"(?:->|\.)\s*[^\W\d]\w*|\.\.\.|[^\W\d]\w*|\d[\w.]*(?:(?<=[eEpP])[+-]\d+)?|\.\d\w*|<<=|>>=|[-+*/%&|^]=|==|!=|<=|>=|&&|\|\||\+\+|--|<<|>>|[^\s]")
    CODES = {
        **_codes(r="return", I="if", W="while", F="for", E="else", D="do", S="switch", c="case", d="default", B="break continue", G="goto", T="struct union enum", y="typedef", z="sizeof _Alignof"),
        "*": "*", "&": "*", "+": "+", "-": "+", "!": "!", "~": "!", "++": "u", "--": "u", "=": "=", "?": "?", ":": ":", ",": ",", ";": ";", "...": "~",
        lexers.STRING: "s", lexers.CHAR: "l",
        **{c: c for c in "()[]{}"},
        **{c: "o" for c in "/ % ^ | == != <= >= < > && || << >> <<= >>= -= += *= /= %= &= |= ^=".split()},
    }

    def token(self, t: str) -> str:
        if t[0] in ".-" and len(t) > 1:
            return "l" if t[1].isdigit() else "p"
        if t[0].isdigit() and not re.fullmatch(r"0[xX][0-9a-fA-F.]+(?:[pP][+-]?\d+)?[uUlLfF]*|0[bB][01]+[uUlL]*|[0-9]+\.?[0-9]*(?:[eE][+-]?\d+)?[uUlLfF]*", t):
            return "￾"
        return super().token(t)

    def __init__(self) -> None:
        super().__init__()
        having, any_of = self.layout.having, self.layout.any_of
        P_ANY, S_ANY, B_ANY = any_of(PAREN), any_of(SQUARE), any_of(BRACE)
        args, params, forh, expr, cast, dcl = (having(PAREN, b) for b in (1, 2, 4, 8, 16, 32))
        sq = having(SQUARE, 1)
        block, init, fields, enum = (having(BRACE, b) for b in (1, 2, 4, 8))
        tag = rf"T(?:i(?:{fields}|{enum})?|{fields}|{enum})"
        spec = rf"(?:i|{tag})+"
        pre = rf"(?:[!+*u]|z|(?:{cast}|{expr})(?=[ilsz!+*u{P_ANY[1:-1]}{B_ANY[1:-1]}]))*"
        unit = rf"{pre}(?:i|l|s+(?:is+)*|{expr}|{cast}|(?<={cast}){init})(?:p|{args}|{sq}|u)*"
        E, EL = chain(unit, "[o+*=]"), chain(unit, "[o+*=,]")
        d = rf"\**i*(?:i|{dcl})(?:{sq}|{params})*(?::{E})?"
        decl = rf"{d}(?:=(?:{E}|{init}))?"
        decls = rf"{decl}(?:,{decl})*"
        local = rf"y?(?:{spec}{decls}|{tag}|i*{tag});"
        end = r";"
        b0 = rf"(?:{block}|S{expr}{block}|;|r(?:{EL})?;|B;|Gi;|{EL};)"
        head = rf"(?:W{expr}|F{forh}|i:|c{E}:|d:)*"
        ifs = rf"I{expr}{head}(?:I{expr})*{b0}(?:EI{expr}{head}{b0})*(?:E{head}{b0})?"
        stmt = rf"(?:{head}(?:{local}|{ifs}|D{b0}W{expr};|{b0}))"
        self.block = _full(rf"(?:{stmt})*+(?:{head})")
        self.args, self.expr = _full(rf"(?:(?:{E}|{spec}\**)(?:,(?:{E}|{spec}\**))*)?"), _full(EL)
        abstract = rf"(?:\*|i)*(?:{dcl})?(?:i)?(?:{sq}|{params})*"
        pm = rf"(?:{spec}{abstract}|~)"
        self.params = _full(rf"(?:{pm}(?:,{pm})*)?")
        self.cast = _full(rf"{spec}\**(?:i*\**)(?:{dcl})?(?:{sq}|{params})*")
        self.dcl = _full(rf"i*\*+i*(?:i|{dcl})?(?:{sq}|{params})*|i")
        self.for_ = _full(rf"(?:{spec}{decls}|{EL})?;(?:{EL})?;(?:{EL})?")
        self.square = _full(rf"(?:i*{E}|i*\*?)?")
        el = rf"(?:(?:(?:p|{sq})+=|i:)?(?:{E}|{init}))"
        self.init = _full(rf"(?:{el}(?:,{el})*,?)?")
        self.fields = _full(rf"(?:{spec}(?:{d}(?:,{d})*)?;|;)*+")
        self.enum = _full(rf"i(?:={E})?(?:,i(?:={E})?)*,?")
        func = rf"{spec}\**i*(?:i|{dcl}){params}+(?:i{P_ANY}?)*{block}"
        self.file = _full(rf"(?:{func}|{local}|is{B_ANY}|i{P_ANY};?|;)*+")

    def classify(self, kind: str, inner: str) -> int:
        if kind == "(":
            mask = bool(self.args.fullmatch(inner)) | bool(self.params.fullmatch(inner)) << 1 | bool(self.expr.fullmatch(inner)) << 3 | bool(self.cast.fullmatch(inner)) << 4 | bool(self.dcl.fullmatch(inner)) << 5
            return mask | (";" in inner and bool(self.for_.fullmatch(inner))) << 2
        if kind == "[":
            return int(bool(self.square.fullmatch(inner)))
        return bool(self.block.fullmatch(inner)) | bool(self.init.fullmatch(inner)) << 1 | bool(self.fields.fullmatch(inner)) << 2 | bool(self.enum.fullmatch(inner)) << 3

    def whole(self, codes: str) -> bool:
        return bool(self.file.fullmatch(codes))


# ------------------------------------------------------------------------------------------------- Ruby
class Ruby(Grammar):
    """Brackets as elsewhere; then keyword blocks up to their ``end`` are reduced in the same way."""

    language = "ruby"
    layout = Layout(3, 1, 2, 2)
    keep_lines = True
    NUMBER = "f"
    TOKEN = re.compile(r"(?:&?\.|::)\s*[^\W\d]\w*[?!]?(?!=[^=~>])|(?:&?\.|::)\s*[^\W\d]\w*|&?\.(?=\()|\.\.\.|\.\.|[^\W\d]\w*[?!]?:(?!:)|:[^\W\d]\w*[?!=]?|:\x01|:(?:\[\]=?|[-+*/%<>=!~^&|]+)|@@?[^\W\d]\w*|\$(?:[^\W\d]\w*|[\d!@&~;,/.<>_:?\"$0*])|defined\?|[^\W\d]\w*[?!]?(?!=[^=~>])|[^\W\d]\w*|\d[\w]*(?:\.\d\w*)?(?:(?<=[eE])[+-]\d+)?|\?[^\s\w](?=[\s,)])|\*\*=|<=>|===|<<=|>>=|&&=|\|\|=|=>|==|!=|=~|!~|<=|>=|&&|\|\||<<|>>|\*\*|->|[-+*/%&|^]=|\x01\s*:(?!:)|[^\s]")
    CODES = {
        **_codes(b="def", K="class", z="module", I="if unless", W="while until", F="for", n="in", E="else", e="elsif", C="case", w="when", D="do", X="begin", R="rescue", Y="ensure", t="then", Q="end", r="return break next redo retry", l="true false nil", y="alias undef", O="and or", N="not"),
        "defined?": "N", "=": "=", "+": "+", "-": "+", "*": "*", "**": "*", "&": "*", "!": "!", "~": "!", "|": "|", "?": "?", ":": ":", ",": ",", ";": "\n", "=>": ">", "->": "L", "..": "d", "...": "d", "<": "<", "<<": "<", ".": "", "&.": "",
        lexers.STRING: "s", lexers.REGEX: "l", lexers.CHAR: "s",
        **{c: c for c in "()[]{}"},
        **{c: "o" for c in "/ % ^ == != <= >= > && || >> <=> === =~ !~".split()},
        **{c: "=" for c in "**= <<= >>= &&= ||= += -= *= /= %= &= |= ^=".split()},
    }
    _BLOCK = re.compile(r"[bKzIWFCXD][^bKzIWFCXDQ]*Q")
    _LINES = re.compile(r"(?<=[o+*=!,.|?>O<dN:])\n+|\n+(?=[p.]|[)\]])|(?<=[(\[])\n+|(?<=\n)\n+")

    def token(self, t: str) -> str:
        if t[0] in "&.:" and len(t) > 1:
            if t.startswith("::") or t[0] in "&.":
                return "p"
            return "l"
        if t[0] == "\x01":
            return "k"
        if t[0] in "@$":
            return "i"
        if t[-1] == ":" and len(t) > 1:
            return "k"
        if t[0] == "?" and len(t) > 1:
            return "l"
        return super().token(t)

    def line(self, text: str) -> str:
        codes = super().line(text)
        out: list[str] = []
        for k, c in enumerate(codes):
            prev = out[-1] if out else ""
            if c in "IW" and prev and prev not in "\n=(,[{|tDE&O" and not (c == "I" and prev in "+*o!L<>"):
                c = "m"  # a modifier
            elif c == "R" and prev and prev != "\n":
                c = "m"
            elif c == "D" and ("W" in out or "F" in out) and "D" not in out:
                c = "t"  # the do of a loop head
            out.append(c)
        return "".join(out)

    def __init__(self) -> None:
        super().__init__()
        having, any_of = self.layout.having, self.layout.any_of
        args, params, expr = (having(PAREN, b) for b in (1, 2, 4))
        sq = having(SQUARE, 1)
        hash_, block = having(BRACE, 1), having(BRACE, 2)
        unit_, defn, do = (chr(self.layout.bases[KEYED][0] + k) for k in (1, 2, 3))
        prim = rf"(?:i|s+|[lf]|{expr}|{sq}|{hash_}|{unit_}|p|L(?:{params}|i(?:,i)*)?(?:{block}|{do}))"
        post = rf"(?:p|{args}|{sq}|{block}|{do})*"
        pre = r"(?:[!+*N])*"
        plain = rf"{pre}{prim}{post}"
        arg = rf"(?:k?[*]?(?:{plain}(?:(?:[o+*=<|dO>?:]|>\n?){plain})*)|k|\*)"
        said = rf"(?:k?[*]?(?:{plain}(?:(?:[o+*=<|dO>?:]|>\n?){plain})*)|k)"  # a bare splat is passed on between brackets only
        call = rf"(?:{pre}i(?:p|{sq}|{args})*(?:{said}(?:,\n?{said})*)(?:{do})?)"
        unit = rf"(?:{call}|{plain})"
        E = rf"(?:{unit}d?(?:[o+*=<|dO?:]{unit})*d?)"
        EL = rf"\*?{E}(?:,\*?{E})*"
        stmt = rf"(?:r(?:{EL})?|y[il][il]|{EL}(?:={EL})?|{defn})(?:m{E}|O(?:r(?:{EL})?|{E}))*"
        self.stmts = rf"\n*(?:(?>{stmt})(?:\n+(?>{stmt}))*)?\n*"
        S = self.stmts
        self.body = _full(S)
        pm = rf"(?:[*]*i(?:=(?:{plain}(?:[o+*<|]{plain})*))?|k(?:{plain})?|[*]+|{having(PAREN, 2)}|\*k?l?)"
        pl = rf"(?:{pm}(?:,{pm})*,?)?"
        self.params = _full(pl)
        self.args = _full(rf"\n*(?:{arg}(?:,\n*{arg})*,?|{E})?\n*")
        self.expr = _full(S)
        self.hash_ = _full(rf"\n*(?:(?:k\n*(?:{E})?|{E}>\n*{E}|\*{E})(?:,\n*(?:k\n*(?:{E})?|{E}>\n*{E}|\*{E}))*,?\n*)?")
        bar = rf"(?:\|{pl}(?:\n?)\|)?"
        self.block = _full(rf"{bar}{S}")
        tail = rf"(?:R(?:{EL})?(?:>i)?[t\n]{S})*(?:E{S})?(?:Y{S})?"
        self.kinds = {
            "b": _full(rf"(?:[ip]p*=?|[l+*o!<|=]+|{sq}=?)(?:{params}|{pl})(?:\n|$){S}{tail}".replace("(?:[ip]p*=?", "(?:[ipst]?p*[i]?=?")),
            "K": _full(rf"(?:<i|ip*(?:<ip*(?:{args})?)?)\n{S}{tail}"),
            "z": _full(rf"ip*\n{S}"),
            "I": _full(rf"{E}[t\n]+{S}(?:e{E}[t\n]+{S})*(?:E{S})?"),
            "W": _full(rf"{E}[t\n]+{S}"),
            "F": _full(rf"i(?:,i)*n{E}[t\n]+{S}"),
            "C": _full(rf"(?:{E})?\n+(?:[wn]{EL}[t\n]{S})*(?:E{S})?"),
            "X": _full(rf"{S}{tail}"),
            "D": _full(rf"{bar}{S}{tail}"),
        }

    def tidy(self, codes: str) -> str:
        return self._LINES.sub("", codes)

    def _keyed(self, m: re.Match) -> str:
        g = m[0]
        c = self.group_memo.get(g)
        if c is None:
            if len(self.group_memo) > MEMO:
                self.group_memo.clear()
            ok = self.kinds[g[0]].fullmatch(g[1:-1])
            c = self.group_memo[g] = chr(self.layout.bases[KEYED][0] + (0 if not ok else 2 if g[0] in "bKz" else 3 if g[0] == "D" else 1))
        return c

    def _blocks(self, codes: str) -> str:
        while "Q" in codes:
            less = self._BLOCK.sub(self._keyed, codes)
            if less == codes:
                break
            codes = less
        return codes

    def classify(self, kind: str, inner: str) -> int:
        inner = self._blocks(inner)
        if kind == "(":
            return bool(self.args.fullmatch(inner)) | bool(self.params.fullmatch(inner.replace("\n", ""))) << 1 | bool(self.expr.fullmatch(inner)) << 2
        if kind == "[":
            return int(bool(self.args.fullmatch(inner)))
        return bool(self.hash_.fullmatch(inner)) | bool(self.block.fullmatch(inner)) << 1

    def whole(self, codes: str) -> bool:
        return bool(self.body.fullmatch(self._blocks(codes).strip("\n")))


_MAKERS = {"javascript": lambda: Script(False), "typescript": lambda: Script(True), "java": Java, "go": Go, "rust": Rust, "c": C, "ruby": Ruby}


@lru_cache(maxsize=None)
def grammar(language: str) -> Grammar:
    return _MAKERS[language]()
