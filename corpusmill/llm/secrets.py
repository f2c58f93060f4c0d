"""Credentials written out in source text and in scanner contexts: found, and redacted in place.

A text is cut lexically into string literals and the rest, without a language's grammar, so that broken
files and one-line contexts work too. A literal is a secret if its form is that of an issued key, if it
holds a credential in an address, header, command, query or embedded record, or if it is assigned or
passed to a credential-named identifier and is no placeholder; a few password shapes count under any name.
Comments and plain values are searched for labelled values, issued keys, addresses and private keys.
Redaction replaces the characters of the value only; delimiters, escapes and line breaks stay.

Defined results: null and empty texts give no rows; literals joined by an operator count once, at the
first; a file delivered twice counts once; values that stand in for a secret, references, masked values,
digests, ids, public keys, patterns and embedded data are no secrets.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import per_file

_BACKTICK = r"`(?:[^`\\]|\\[\s\S])*+`"
_LITERAL = re.compile(
    r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*+"""|\'\'\'(?:[^\'\\]|\\[\s\S]|\'(?!\'\'))*+\'\'\'|"(?:[^"\\\n]|\\[\s\S])*+"|(?<![A-Za-z0-9])\'(?:[^\'\\\n]|\\[\s\S])*+\'|' + _BACKTICK
)
#: Go has no escapes between backticks.
_LITERAL_GO = re.compile(_LITERAL.pattern.removesuffix(_BACKTICK) + r"`[^`]*+`")
#: Before a backtick: it stands in a comment, where it pairs on its line only.
_COMMENTED = re.compile(r"^[ \t]*(?:#+!?(?=\s)|//|/\*|\*(?=[\s/])|--(?=\s))|[\s;{}](?:#|//|/\*)(?=\s)", re.M)
#: What a value must hold before anything else is asked.
_LIKELY = re.compile(r"\d|[a-z][A-Z]|BEGIN|[!#%^*+]")
_ISSUED = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|AIza[\w-]{30,39}|gh[opsur]_[A-Za-z0-9]{30,}|xox[abeoprs]-[\w-]{16,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|glpat-[\w-]{20,}|npm_[A-Za-z0-9]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})(?![A-Za-z0-9])"
)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_BODY = re.compile(r"(?:\\n|\\r|\s|[\"'+,]|\\\n)*([A-Za-z0-9+/=]{20,}|$)")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_ADDRESS = re.compile(r"\b[a-z][a-z0-9+.-]*://[^\s/:@\"'`]*:([^\s/@\"'`]+(?:@(?=[^\s/@\"'`]*@)[^\s/@\"'`]*)*)@[\w.\[-]")
_QUERY = re.compile(r"[?&;](?:access_token|auth_token|id_token|refresh_token|token|api_?key|key|apikey|secret|client_secret|sig|signature|password|passwd|pwd|auth)=([^\s&#\"'`;]{8,})", re.I)
_HEADER = re.compile(r"\b(?:(?:Proxy-)?Authorization\s*[:=]\s*(?:Bearer|Basic|Token|Digest|ApiKey)\s+|(?:X-[\w-]*(?:Token|Key|Secret|Auth)|Api-Key|Private-Token|Cookie)\s*[:=]\s*)([^\s\"'`;,]{8,})", re.I)
_SHARED = re.compile(r"\b(?:AccountKey|SharedAccessKey|SharedSecret|Password|Pwd)\s*=\s*([^\s;\"'`]{8,})", re.I)
_COMMAND = re.compile(
    r"\bcurl\b[^\n\"'`]*?\s(?:-u|--user)[\s=]*[^\s:]+:([^\s\"'`]{6,})|\bsshpass\s+-p\s*([^\s\"'`]{6,})|\bmysql\w*\b[^\n\"'`]*?\s-p([^\s\"'`]{6,})|\s--(?:password|passwd|token|secret|api-key|auth-token)[=\s]+([^\s\"'`]{6,})"
    r"|\b(?:PGPASSWORD|MYSQL_PWD|[A-Z_]*(?:PASSWORD|TOKEN|SECRET|API_KEY))=([^\s\"'`;]{8,})|\bwget\b[^\n\"'`]*?--(?:http-)?password[=\s]+([^\s\"'`]{6,})|\bdocker\s+login\b[^\n\"'`]*?\s-p\s*([^\s\"'`]{6,})|\bredis-cli\b[^\n\"'`]*?\s-a\s*([^\s\"'`]{6,})"
)
_RECORD = re.compile(r"\\?[\"'](?:[\w-]*(?:passw(?:or)?d|passwort|pwd|secret|token|api_?key|passphrase|credential))\\?[\"']\s*:\s*\\?[\"']((?:[^\"'\\]|\\(?![\"']).)+)\\?[\"']", re.I)
_HOOK = re.compile(r"^https?://[^\s?#]*/([A-Za-z0-9_-]{24,})$")

#: Parts of names that tell a credential, in several languages. Fixed values.
_CREDENTIAL = re.compile(
    r"(?:^|_|-|\b)(?:pass|pw|pwd|passwd|passcode|password|passwort|passphrase|kennwort|contrasena|contraseña|clave|senha|mot_de_passe|motdepasse|mdp|secret|secrets|token|tokens|apikey|credential|credentials|cred|creds|auth|bearer|jwt|session|cookie|login|salt|signature|otp|pat)(?:$|_|-|\b)"
    r"|(?:^|_|-)(?:api|access|secret|private|signing|sign|encryption|encrypt|master|deploy|service|auth|licence|license|storage|account|ssh|tls|root|client|shared|session|hmac|webhook|geo|maps|old|new|ci|admin|user|billing|server|app|aws)_?-?(?:api_?)?key(?:$|_|-)|passw(?:or)?d|passwor?t|secret|apikey|api_key"
)
_NOT_CREDENTIAL = re.compile(r"public|pattern|regex|regexp|_re$|label|field|column|header_?name|_name$|placeholder|example|dummy|fake|mock|sha\d*|hash|digest|checksum|fingerprint|etag|integrity|uuid|guid|commit|revision|version|_path$|_file$|_url$|_uri$|_type$|_length$|_len$|_count$|_size$|_ttl$|_env$|_var$|policy|prompt|message|title|help|error|hint|keyword|csrf")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_BEFORE = re.compile(r"([A-Za-z_\u00c0-\u024f][\w\u00c0-\u024f.-]*)\\?[\"'\]]*[ \t]*(?::[ \t]*&?(?:'\w+[ \t]+)?\w+(?:<[^<>\n]*>)?(?:\[\])?)?[ \t]*(?::=|=>|\+=|\|\|=|=|:|,)\s*(?:(?:concat!|String::from|String)\s*)?[(\s]*(?:[bBrRuUfF]{1,2})?$")
_PASSED = re.compile(r"(?:^|[\W_])(?:connect|login|log_in|logon|bind|auth|authenticate|signin|sign_in|set_?password|set_?token|with_?(?:token|password|api_?key))\s*\((?:[^()\n]*?,)?\s*$", re.I)
_PASSED_NAME = re.compile(r"\b(?:connect|login|log_in|logon|bind|auth|authenticate|signin|sign_in)\s*\(\s*$", re.I)
_PLACEHOLDER = re.compile(
    r"(?i)(?<![a-z0-9])(?:your|example|sample|placeholder|change.?(?:me|it|this)|replace|dummy|fake|foo(?:bar)?|todo|fixme|insert|redacted|removed|hidden|masked|censored|none|null|nil|undefined|unset|not.?set|set.?this|goes|here|n/?a|tbd|to.?be|enter|fill|xxx+|\.\.\.)(?![a-z0-9])|EXAMPLE|CHANGEME|x{6,}"
)
#: Words that make a stand-in only of values that hold nothing else but words.
_WEAK = re.compile(r"(?i)(?<![a-z0-9])(?:my|put|docs|demo|test(?:ing)?|mock|default|secret.?key)(?![a-z0-9])")
_RANDOM = re.compile(r"(?=[A-Za-z0-9+/]*\d)(?=[A-Za-z0-9+/]*[A-Za-z])[A-Za-z0-9+/]{6,}|[^\W\d_]*[!#$%^&*?][\w!#$%^&*?]{3,}")
_REFERENCE = re.compile(r"^\s*(?:\$\{?\w|\{\{|\{%|<[^>]*>$|%\(|%\{|%[sdv]$|\{\w*\}|#\{|@\w+@|env[.:(]|ENV\[|os\.|process\.|vault:|secret://|arn:|ref:|file:|data:|ssh-|sha\d+-|sha\d+:|/|\./|~/|https?://)", re.I)
_MASKED = re.compile(r"\*{3,}|•{3,}|x{8,}|\.{3,}|^(.)\1*$|…")
_PLAIN = re.compile(r"^[A-Za-z]?[a-z]*(?:[ _./:\-][a-z]*)*$|^[A-Z]+(?:_[A-Z]+)*$|^\d+(?:\.\d+)*$|^[a-z]+(?:[A-Z][a-z]+)*$|^[a-z]+\[\w*\]$")
_PATTERN = re.compile(r"\[\^?[\w-]+-[\w-]+\]|\\[dws]|\(\?|\]\{\d|\{\d+,?\d*\}|\.\*|\)\+|\|.*\(|\^.*\$$")
_PHRASE = re.compile(r"^[a-z]{3,}(?:[-_.][a-z]{3,}){2,}\d{1,4}$|^[A-Z][a-z]{2,}[!#%_^*+&@~=-][a-z]{3,}\d{2,5}$")
_PASSWORD = re.compile(r"^[!-~]{10,26}$")
_DIGEST = re.compile(r"^(?:[0-9a-f]{40}|[0-9a-f]{64}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})$", re.I)
_COMMENT = re.compile(r"(?:^[ \t]*(?:#+|//+|/?\*+|--|;|<!--|\"\"\"|''')|(?<=[\s;{}])(?:#|//|/\*)(?=\s))[^\n]*+", re.M)
_LABEL = re.compile(
    r"\b(?:password|passwort|passwd|pwd|pw|kennwort|contraseña|contrasena|clave|senha|mot de passe|mdp|пароль|passphrase|token|secret|(?:api|old|access|signing|secret|deploy|new|master|private)[ _-]?key|login|credentials?|auth)\b[\"']?\s*(?:is|ist|es|est|was|=>|:=|=|:)\s*[\"'`]?([^\s\"'`]{8,})",
    re.I,
)
_JOINER = re.compile(r"[:=]|\s(?:is|ist|es|est|was)\b", re.I)
_LABEL_UNSPACED = re.compile(r"(?:密码|密碼|パスワード|口令|令牌)\s*(?:是|は|[:：=])\s*([!-~]{8,})")
_YAML_PLAIN = re.compile(r"^[ \t]*(?:-[ \t]+)?([\w.-]+):[ \t]+([^\s\"'#&*!|>%@`{\[][^\s#]{7,})[ \t]*(?:#.*)?\r?$", re.M)
_JOINED = re.compile(r"\s*(?:[+.,&]|\|\||\\)?\s*\Z")


def credential_name(name: str) -> bool:
    """Whether an identifier names a credential: its words, however they are joined."""
    n = _CAMEL.sub("_", name.rpartition(".")[2]).lower()
    return bool(_CREDENTIAL.search(n)) and not _NOT_CREDENTIAL.search(n)


def stands_in(value: str) -> bool:
    """Whether a value only stands for a secret: placeholder, reference, mask, pattern or plain words."""
    if _REFERENCE.search(value) or _MASKED.search(value) or _PLACEHOLDER.search(value) or _PATTERN.search(value) or _PLAIN.match(value):
        return True
    return bool(_WEAK.search(value)) and not _RANDOM.search(_WEAK.sub(" ", value))


def _classes(value: str) -> tuple[bool, bool, bool, bool]:
    return any(c.islower() for c in value), any(c.isupper() for c in value), any(c.isdigit() for c in value), any(not c.isalnum() for c in value)


def password_shape(value: str) -> bool:
    """Whether a value looks like a password or pass phrase under any name."""
    if _PHRASE.match(value):
        return True
    if not _PASSWORD.match(value) or "/" in value or "." in value or "," in value or ":" in value or "(" in value or "<" in value or "=" in value.rstrip("=") or "[" in value or "{" in value or "\\" in value or "$" in value:
        return False
    lower, upper, digit, special = _classes(value)
    if not (lower and upper and (digit or special)):
        return False
    changes = sum(1 for a, b in zip(value, value[1:]) if (a.islower() and b.isupper()) or (a.isalpha() != b.isalpha()))
    words = re.findall(r"[A-Z]?[a-z]{3,}", value)
    return changes >= 4 and sum(map(len, words)) <= 0.67 * len(value)


#: Names whose value is a password even if it is one long word or a number, and the words that then make a stand-in of it.
_PASSWORD_NAME = re.compile(r"(?:^|_)(?:pass(?:wd|word|phrase|code)?|passwor?t|kennwort|pwd|contrase(?:na|ña)|senha)$")
_STANDS = re.compile(r"pass|word|secret|change|your|example|sample|dummy|fake|test|admin|user|enter|token|login|default|none|empty|required|string|value|placeholder|hidden|kennwort|senha|contrase|geheim|motdepasse", re.I)


#: A pass phrase of plain words.
_PHRASE_WORDS = re.compile(r"^[^\W\d_]{3,}(?: [^\W\d_]{3,}){2,7}$")


def _password_word(name: str, value: str) -> bool:
    """Whether a value that is one long word, or only digits, is the password of a password-named place."""
    if not _PASSWORD_NAME.search(_CAMEL.sub("_", name.rpartition(".")[2]).lower()):
        return False
    if value.isdigit():
        return len(value) >= 8 and len(set(value)) > 2
    return value.isalpha() and (value.islower() or not value.isascii()) and len(value) >= (14 if value.isascii() else 8) and not _STANDS.search(value)


def _named_secret(value: str) -> bool:
    """Whether a value given to a credential name is a secret."""
    if len(value) < 6 or " " in value or "\n" in value or not value.isprintable() or stands_in(value):
        return False
    lower, upper, digit, special = _classes(value)
    return digit or (lower and upper) or (special and not re.match(r"^[\w./:-]*$", value))


def within(text: str, lo: int, hi: int) -> list[tuple[int, int]]:
    """Secrets whose own form or surroundings tell, between two positions."""
    out = []
    for m in _ISSUED.finditer(text, lo, hi):
        if not stands_in(m[0]) or m[0].startswith("eyJ") and "*" not in m[0]:
            out.append(m.span())
    part = text[lo:hi]
    if "://" in part:
        for m in _ADDRESS.finditer(text, lo, hi):
            v = m[1]
            if len(v) >= 4 and not v.startswith(("$", "{", "<", "%")) and not _MASKED.search(v) and not _PLACEHOLDER.search(v) and v.lower() not in ("password", "pass", "pwd", "secret", "token"):
                out.append(m.span(1))
        for m in _QUERY.finditer(text, lo, hi):
            if _named_secret(m[1]):
                out.append(m.span(1))
    if ":" in part or "=" in part:
        for p in (_HEADER, _SHARED):
            for m in p.finditer(text, lo, hi):
                if _named_secret(m[1].strip("=/") or m[1]):
                    out.append(m.span(1))
    if " " in part or "=" in part:
        for m in _COMMAND.finditer(text, lo, hi):
            k = m.lastindex
            if _named_secret(m[k]) or _PHRASE.match(m[k]):
                out.append(m.span(k))
    if '"' in part or "'" in part:
        for m in _RECORD.finditer(text, lo, hi):
            if _named_secret(m[1]) or _PHRASE.match(m[1]):
                out.append(m.span(1))
    return out


def _pem(text: str, context: bool) -> list[tuple[int, int]]:
    out = []
    for m in _PEM.finditer(text):
        body = _PEM_BODY.match(text, m.end())
        if body and (body[1] or context):
            end = _PEM_END.search(text, m.end())
            stop = end.end() if end and not _PEM.search(text, m.end(), end.start()) else body.end()
            out.append((m.start(), stop))
    return out


def _literals(text: str, go: bool) -> Iterator[re.Match]:
    """The literals of a text, in order."""
    p, at = _LITERAL_GO if go else _LITERAL, 0
    while m := p.search(text, at):
        a, at = m.span()
        if text[a] == "`" and "\n" in m[0] and _COMMENTED.search(text, text.rfind("\n", 0, a) + 1, a):
            at = a + 1
            continue
        yield m


def _before(text: str, a: int, most: int = 120) -> str:
    """What stands before a place, from a name to it: any number of blanks counts as one."""
    end = a
    while end and text[end - 1] in " \t\r\n":
        end -= 1
    return text[max(0, end - most) : end] + text[max(end, a - 1) : a]


def find(text: str, yaml: bool = False, context: bool = False, go: bool = False) -> list[tuple[int, int]]:
    """(start, end) of every secret value of a text, in order, without overlaps."""
    found = _pem(text, context)
    joined_to: tuple[int, bool] = (-1, False)
    quotes: list[tuple[int, int]] = []
    for m in _literals(text, go):
        a, b = m.span()
        width = 3 if text.startswith(('"""', "'''"), a) and b - a >= 6 else 1
        lo, hi = a + width, b - width
        quotes.append((lo, hi))
        if hi - lo < 6:
            continue
        value = text[lo:hi]
        if not _LIKELY.search(value) and (hi - lo < 8 or not (value.isalpha() or " " in value)):
            continue
        last_end, last_secret = joined_to
        if last_end >= 0 and a - last_end < 40 and _JOINED.match(text[last_end:a]) and text[last_end:a].strip() != "," or (last_end >= 0 and last_secret and a - last_end < 4 and "concat!" in text[max(0, last_end - 80) : last_end]):
            joined_to = (b, last_secret)
            if last_secret:
                found.append((lo, hi, -1))
            continue
        own = within(text, lo, hi)
        if own:
            found += own
            joined_to = (b, False)
            continue
        secret = False
        if not any(c.isspace() for c in value):
            before = _before(text, a)
            n = _BEFORE.search(before)
            name = n[1] if n else ""
            if context and not before.strip():  # the name was cut off
                secret = bool(_PHRASE.match(value)) or (_named_secret(value) and not _DIGEST.match(value))
            elif name and credential_name(name):
                secret = _named_secret(value) or bool(_PHRASE.match(value)) or _password_word(name, value)
            elif (p := _PASSED.search(before)) and not _PASSED_NAME.search(before):
                secret = _named_secret(value) or bool(_PHRASE.match(value))
            elif not (name and _NOT_CREDENTIAL.search(_CAMEL.sub("_", name).lower())) and n and not n[0].rstrip().endswith(","):
                secret = password_shape(value) and not stands_in(value)
            if not secret and (h := _HOOK.match(value)) and sum(_classes(h[1])[:3]) == 3 and not stands_in(h[1]):
                found.append((lo + h.start(1), lo + h.end(1)))
        elif _PHRASE_WORDS.match(value) and not _STANDS.search(value) and (n := _BEFORE.search(_before(text, a))) and "passphrase" in n[1].lower() and credential_name(n[1]):
            secret = True
        if secret:
            found.append((lo, hi))
        joined_to = (b, secret)
    starts = [q[0] for q in quotes]

    def quoted(at: int) -> bool:
        k = bisect_right(starts, at) - 1
        return k >= 0 and at < quotes[k][1]

    for m in (x for c in _COMMENT.finditer(text) if _JOINER.search(c[0]) for x in _LABEL.finditer(text, *c.span())):
        v = m[1].rstrip(".,;)*/")
        if _PHRASE.match(v) or (_named_secret(v) and (password_shape(v) or sum(_classes(v)[:3]) == 3 or re.match(r"^[0-9a-f-]{24,}$", v) or sum(_classes(v)) >= 3)):
            found.append((m.start(1), m.start(1) + len(v)))
    for m in _LABEL_UNSPACED.finditer(text) if not text.isascii() else ():
        if _named_secret(m[1]):
            found.append(m.span(1))
    if yaml:
        for m in _YAML_PLAIN.finditer(text):
            if (credential_name(m[1]) and (_named_secret(m[2]) or _PHRASE.match(m[2]))) or within(text, *m.span(2)):
                found.append(m.span(2))
    for m in _ISSUED.finditer(text):
        if not quoted(m.start()) and not stands_in(m[0]):
            found.append(m.span())
    if "://" in text:
        for m in _ADDRESS.finditer(text):
            if not quoted(m.start(1)):
                found += within(text, m.start(), min(len(text), m.end() + 1))
    out: list[tuple[int, int]] = []
    for f in sorted(found, key=lambda x: (x[0], -x[1])):
        if out and f[0] < out[-1][1]:
            continue
        out.append(f)
    return out


_KEPT = re.compile(r"(\\.|\s)|.", re.S)


def redact(text: str, spans: list[tuple[int, int]], mark: str = "*") -> str:
    """The text with only the characters of the values replaced; escapes and white space stay."""
    out, at = [], 0
    for s in spans:
        out += (text[at : s[0]], _KEPT.sub(lambda m: m[1] or mark, text[s[0] : s[1]]))
        at = s[1]
    return "".join((*out, text[at:]))


def lines_of(text: str, spans: list[tuple]) -> list[int]:
    """Lines on which values begin; the further literals of a joined value do not count."""
    return sorted({text.count("\n", 0, s[0]) + 1 for s in spans if len(s) == 2})


def _spans(tbl: str, path: str | None, text: str | None) -> list[tuple]:
    if not text or not text.strip():
        return []
    return find(text, (path or "").endswith((".yml", ".yaml")), tbl == "security_issues", (path or "").endswith(".go"))


def _tables(files: DataFrame, issues: DataFrame, kernel, schema: str) -> DataFrame:
    """What the kernel gives for each text of both tables, with tbl and row_id; the latest delivery of a file, one row of repeated findings."""
    a = per_file(files, ["file_path", "content"], lambda paths, texts: kernel("parsed_files", paths, texts), schema)
    b = per_file(issues, ["file_path", "context"], lambda paths, texts: kernel("security_issues", paths, texts), schema, key="issue_id")
    return a.withColumn("tbl", F.lit("parsed_files")).unionByName(b.withColumn("tbl", F.lit("security_issues"))).withColumnRenamed("file_id", "row_id")


def found(files: DataFrame, issues: DataFrame) -> DataFrame:
    """(tbl, row_id, line_no) of each line on which a secret begins."""

    def kernel(tbl, paths, texts):
        return [[lines_of(t, s) if (s := _spans(tbl, p, t)) else [] for p, t in zip(paths, texts)]]

    return _tables(files, issues, kernel, "lines array<int>").select("tbl", "row_id", F.explode("lines").alias("line_no"))


def redacted(files: DataFrame, issues: DataFrame) -> DataFrame:
    """(tbl, row_id, secrets, text): the texts that held secrets, redacted."""

    def kernel(tbl, paths, texts):
        spans = [_spans(tbl, p, t) for p, t in zip(paths, texts)]
        return [[sum(1 for x in s if len(x) == 2) for s in spans], [redact(t, s) if s else None for s, t in zip(spans, texts)]]

    return _tables(files, issues, kernel, "secrets int, text string").filter("text is not null").select("tbl", "row_id", "secrets", "text")
