"""Changes of content that need a scanner with state: comments, documentation, Unicode."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TRIPLE = r"\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''"
_STRING = r"\"(?:[^\"\\\n]|\\[\s\S])*+\"|'(?:[^'\\\n]|\\[\s\S])*+'|`(?:[^`\\]|\\[\s\S])*+`"
_SLASH = re.compile(rf"({_STRING})|(//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)")
_HASH = re.compile(rf"({_TRIPLE}|{_STRING})|(\#[^\n]*+)")
_DOC_LINES = re.compile(r"^[ \t]*(?:///|//!|#').*\n?", re.M)
_DOC_BLOCK = re.compile(r"/\*\*(?!/)(?:[^*]|\*(?!/))*+\*/")
_DOCSTRING = re.compile(rf"^([ \t]*(?:async[ \t]+)?(?:def|class)\b[^\n]*:[ \t]*\n)([ \t]*(?:{_TRIPLE})[ \t]*\n?)", re.M)
_ZERO_WIDTH = dict.fromkeys(map(ord, "​‌‍⁠﻿"))
HASH_LANGUAGES = frozenset("python ruby bash yaml r julia elixir crystal perl toml".split())


def without_comments(text: str, language: str) -> str:
    """Comments removed, strings kept, trailing blanks removed from the lines they stood on."""
    pattern = _HASH if language in HASH_LANGUAGES else _SLASH
    out = pattern.sub(lambda m: m[1] or "", text)
    return "\n".join(x.rstrip() for x in out.split("\n"))


def without_docs(text: str, language: str) -> str:
    """Documentation removed; three or more line breaks become two."""
    out = _DOCSTRING.sub(lambda m: m[1], text) if language == "python" else _DOC_LINES.sub("", _DOC_BLOCK.sub("", text))
    return re.sub(r"\n{3,}", "\n\n", out)


def normalised(text: str) -> str:
    """No byte order mark, LF line ends, no zero-width characters, composed, plain spaces."""
    t = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n").translate(_ZERO_WIDTH)
    return unicodedata.normalize("NFC", t).replace(" ", " ")


def _udf(f):
    @F.pandas_udf("string")
    def run(text: pd.Series, language: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else f(t, n or "") for t, n in zip(text, language)], dtype=object)

    return run


def remove_comments(text: Column | str, language: Column | str) -> Column:
    return _udf(without_comments)(text, language)


def remove_docs(text: Column | str, language: Column | str) -> Column:
    return _udf(without_docs)(text, language)


def normalise(text: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else normalised(x) for x in t], dtype=object)

    return run(text)


def drop_blank_lines(text: Column | str) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != ""), "\n")
