"""Source files that do not parse for the language of their path's ending.

A file is parsed by the grammar that its ending claims: Python by the interpreter's own parser, JSON and
YAML by theirs, seven more languages by ``grammar``. A file that fails is ranked against the other
languages by typical tokens and parsed by each in that order: a success tells a wrong ending, failure in
all tells corruption.

Defined results: files with null or blank content, and paths of other endings, give no row; a byte order
mark and CRLF do not matter; of a file delivered twice the latest delivery counts; JSON and YAML of any depth
are decided, Python that the interpreter refuses as too deeply nested is not valid. YAML is decided by PyYAML
alone: a worker that lacks it raises where a text has to be parsed as YAML, and the query ends without rows.
"""

from __future__ import annotations

import ast
import json
import re
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import grammar, lexers
from corpusmill.llm.common import per_file
from corpusmill.operators import nested

LANGUAGES = ("python", "javascript", "typescript", "java", "go", "rust", "c", "ruby", "json", "yaml")


def plain(text: str) -> str:
    """The text without byte order mark and carriage returns at line ends."""
    if text.startswith("﻿"):
        text = text[1:]
    return text.replace("\r\n", "\n") if "\r" in text else text


def python_tree(text: str) -> ast.Module | None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None  # the interpreter refuses what is nested too deep for it


def _constant(name: str):
    raise ValueError(name)


_JSON = json.JSONDecoder(parse_constant=_constant)


def _json_valid(text: str) -> bool:
    try:
        _JSON.decode(text)
    except RecursionError:  # too deep for the library's stack: the same grammar on a stack of its own
        try:
            nested.parse_json(text)
        except ValueError:
            return False
    except ValueError:
        return False
    return True


def _yaml_valid(text: str) -> bool:
    import yaml  # where it is missing this raises and the query ends: nothing else stands in for the parser

    try:
        for _ in yaml.parse(text, Loader=yaml.Loader):  # states on a list, not on the stack: any depth
            pass
    except (yaml.YAMLError, ValueError):  # ValueError: an escape beyond Unicode, a version of thousands of digits
        return False
    return True


def valid(language: str, text: str, scan: lexers.Scan | None = None) -> bool:
    """Whether ``plain`` text is valid syntax; ``scan`` saves a second pass over it."""
    if language == "python":
        return python_tree(text) is not None
    if language == "json":
        return _json_valid(text)
    if language == "yaml":
        return _yaml_valid(text)
    return grammar.grammar(language).parses(scan or lexers.scan(language, text))


#: Tokens by which a text is ranked; each match is one vote.
_TYPICAL = {
    "python": r"^\s*(?:def|class) \w+.*:\s*$|^\s*(?:from \w[\w.]* )?import \w|\bself\b|\bNone\b|\belif\b|^\s*@\w+",
    "javascript": r"\b(?:const|let|var) \w+ =|\bfunction\b|=>|===|^import .* from |\bnew Error\(",
    "typescript": r"\b(?:const|let) \w+: |: (?:string|number|boolean)\b|^import \{.*\} from |\binterface \w+ \{|\bas unknown\b|\bnamespace\b",
    "java": r"^package [\w.]+;|^import [\w.]+;|\b(?:public|private|protected) (?:static |final )*\w|@Override\b",
    "go": r"^package \w+$|^func |:= |\bfmt\.|\bdefer\b|\[\]byte|\bchan\b",
    "rust": r"^\s*(?:pub(?:\(crate\))? )?fn |\blet (?:mut )?\w+|^use [\w:]+;|\bimpl\b|-> \w|&self\b|\w!\(",
    "c": r"^#include\b|\bsize_t\b|\bchar \*|\bNULL\b|->\w|\bstatic (?:int|void)\b",
    "ruby": r"^\s*end$|^\s*def \w+[^:]*$|^require |\.each do\b|\bnil\b|\|\w+\|",
    "json": r"^\s*\"[^\"]*\": |^\s*[{\[]$",
    "yaml": r"^\s*[\w-]+:(?: |$)|^\s*- \w",
}
_VOTES = {k: re.compile(v, re.M) for k, v in _TYPICAL.items()}


def ranking(text: str) -> list[str]:
    """All languages, the most typical first; formats that plain text could pass for only with a typical token."""
    votes = {k: sum(1 for _ in p.finditer(text)) for k, p in _VOTES.items()}
    return sorted((k for k in votes if votes[k] or k not in ("json", "yaml")), key=lambda k: (-votes[k], LANGUAGES.index(k)))


def foreign(language: str, text: str) -> str | None:
    """Another language as which the text parses, tried in order of rank."""
    return next((k for k in ranking(text) if k != language and valid(k, text)), None)


def parsed(files: DataFrame) -> DataFrame:
    """(file_id, repo, language, valid, parsed_as, verdict), one row per distinct file; verdict is valid, wrong_ending or corrupt.

    A file that its own grammar accepts is valid whatever others say, so that others are asked only of the
    rest: the rows are those of parsing every file by every grammar.
    """

    def kernel(repos, paths, contents):
        out: list[list] = [[], [], [], []]
        for repo, path, content in zip(repos, paths, contents):
            language = lexers.language_of(path)
            row = (None, None, None, None)
            if language is not None and content is not None and (text := plain(content)).strip():
                ok = valid(language, text)
                row = (repo, language, ok, language if ok else foreign(language, text))
            for c, v in zip(out, row):
                c.append(v)
        return out

    done = per_file(files, ["repo", "file_path", "content"], kernel, "repo string, language string, valid boolean, parsed_as string").filter("language is not null")
    return done.withColumn("verdict", F.when(F.col("valid"), "valid").when(F.col("parsed_as").isNotNull(), "wrong_ending").otherwise("corrupt"))


def found(files: DataFrame) -> DataFrame:
    """(file_id) of the files that are not valid: wrong endings and corrupt files."""
    return parsed(files).filter(F.col("verdict") != "valid").select("file_id")


def rates(files: DataFrame) -> DataFrame:
    """(repo, language, files, invalid, wrong_ending, rate)."""
    return parsed(files).groupBy("repo", "language").agg(
        F.count("*").alias("files"),
        F.count_if(F.col("verdict") != "valid").alias("invalid"),
        F.count_if(F.col("verdict") == "wrong_ending").alias("wrong_ending"),
        F.round(F.count_if(F.col("verdict") != "valid") / F.count("*"), 6).alias("rate"),
    )
