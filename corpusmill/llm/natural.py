"""Natural language inside source files: comments and string literals, their language and share.

Spans come from one lexer pass; adjoining line comments form one text, so that a wrapped sentence is
whole. Sentences are found by shape and their language by one Aho-Corasick pass over all of a file's
candidate sentences: function words of all spaced languages between word borders, votes weighed by inverse
language frequency; script ranges settle Russian, Chinese and Japanese.

Defined results: files with null or blank content, of other endings or with invalid syntax give no rows; of a
file delivered twice the latest delivery counts; a sentence of another language than the eight gives none; a tie goes to the language that comes first in ``prose.LANGUAGES``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import functions, lexers, prose, syntax
from corpusmill.llm.common import per_file

_PREFIX = re.compile(r"^[A-Za-z]{0,2}(\"\"\"|'''|\"|'|`)")
_ESCAPE = re.compile(r"\\(?:u\{?([0-9a-fA-F]{4,6})\}?|([nrt])|(.))", re.S)
_TAG_LINE = re.compile(r"^[ \t]*(?:[@\\]\w+|:(?:param|returns?|rtype|raises?|type)\b[^:\n]*:)", re.M)


def _unescape(m: re.Match) -> str:
    if m[1]:
        code = int(m[1], 16)
        return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else " "
    return " " if m[2] else m[3]


def literal_text(raw: str) -> str:
    """What a string literal says: without delimiters, escapes resolved."""
    m = _PREFIX.match(raw)
    if m:
        q = m[1]
        raw = raw[m.end() : -len(q)] if raw.endswith(q) and len(raw) >= m.end() + len(q) else raw[m.end() :]
    return _ESCAPE.sub(_unescape, raw) if "\\" in raw else raw


def texts_of(language: str, text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, words) of each comment block and string literal that is long enough to hold a sentence."""
    out = [(a, b, functions.clean(text[a:b])) for a, b, _ in functions.blocks(language, text, spans) if b - a >= 10]
    out += [(a, b, literal_text(text[a:b])) for a, b, k in spans if k == '"' and b - a >= 10]
    return out


def sentences_of(language: str, text: str, spans: list[tuple[int, int, str]]) -> list[tuple[str, int]]:
    """(language, characters) of every sentence in a file."""
    pieces: list[str] = []
    for _, _, said in texts_of(language, text, spans):
        if len(said) >= 10:
            if "\n" in said:
                keep = [x for x in _TAG_LINE.sub("\n\n", said).split("\n") if not x.strip() or not prose._CODE_END.search(x)]
                pieces += prose.sentences("\n".join(keep))
            else:
                pieces += prose.sentences(said)
    return [(lang, len(p)) for p, lang in zip(pieces, prose.spoken(pieces)) if lang]


def file_sentences(path: str | None, content: str | None) -> tuple[list[tuple[str, int]], int]:
    """Sentences of a file and its length in characters; nothing for one that does not parse."""
    language = lexers.language_of(path)
    if language is None or content is None or not (text := syntax.plain(content)).strip():
        return [], 0
    scan = lexers.Scan(lexers.yaml_spans(text)) if language == "yaml" else lexers.scan(language, text)
    if not syntax.valid(language, text, scan):
        return [], 0
    return sentences_of(language, text, scan.spans), len(text)


def shares(files: DataFrame) -> DataFrame:
    """(file_id, nl_lang, sentences, chars, share): what each language takes of each file's characters."""

    def kernel(paths, contents):
        out = []
        for path, content in zip(paths, contents):
            said, n = file_sentences(path, content)
            total: dict[str, list[int]] = {}
            for language, chars in said:
                t = total.setdefault(language, [0, 0])
                t[0] += 1
                t[1] += chars
            out.append([(language, count, chars, round(min(1.0, chars / n), 6)) for language, (count, chars) in sorted(total.items())])
        return [out]

    each = per_file(files, ["file_path", "content"], kernel, "said array<struct<nl_lang:string,sentences:int,chars:bigint,share:double>>")
    return each.select("file_id", F.explode("said").alias("s")).select("file_id", "s.*")


def found(files: DataFrame) -> DataFrame:
    """(file_id, nl_lang) of each language in which a file holds a sentence."""
    return shares(files).select("file_id", "nl_lang")
