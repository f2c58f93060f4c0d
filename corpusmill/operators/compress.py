"""Compression of source text: score lines, keep what matters, replace the rest by placeholders.

One Arrow kernel a file: contents are neither exploded to lines nor shuffled. A line's own score depends on
the line alone and is remembered; marks of findings, declarations and tags raise it. Runs of lines that are
kept or omitted become segments; an omitted run shorter than ``least`` is kept, which joins it to its
neighbours. Python code that no longer parses gets back the segment that holds the place of the error.

Input: (file_id, path, content) with, where they are known, ``issues`` array<struct<line_no, severity>> and
``starts`` array<int>, the first lines of declarations. Defined results: null and empty contents give no
rows; a file delivered twice counts once.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import rules as R
from corpusmill.functions.arrow import map_rows
from corpusmill.functions.arrow import spread as scattered
from corpusmill.operators import files as K
from corpusmill.operators import parse

LEVELS = {"aggressive": (0.7, 1), "high": (0.7, 1)}
PLACEHOLDER = "[... code omitted ({lines} lines, {issues} issues) ...]"
SEGMENT = "array<struct<segment:bigint,kind:string,start_line:int,end_line:int,lines:bigint,issues:bigint,patterns:array<string>,content:string>>"
_MEMO = 200_000
_PATTERNS = {k: re.compile(p, re.ASCII) for k, p in R.LINE_PATTERNS.items()}
_IMPORT, _FLOW = re.compile(R.IMPORT_LINE, re.ASCII), re.compile(R.FLOW_LINE, re.ASCII)
_SCORES: dict[str, float] = {}


def settings(level: str) -> tuple[float, int]:
    """(threshold, context lines) of a level."""
    return LEVELS.get(level.lower(), (0.4, 2))


def line_score(line: str) -> float:
    """What a line is worth by itself, from 0 to 1."""
    hit = {k for k, p in _PATTERNS.items() if p.search(line)}
    if hit & {"security", "error_handling", "database"} or _IMPORT.search(line):
        return 1.0
    if hit & {"api", "config"}:
        return 0.8
    if hit & {"async", "testing"}:
        return 0.6
    if _FLOW.search(line):
        return 0.5
    if "return" in line or "=" in line:
        return 0.4
    bare = line.strip(" ")
    return 0.2 if bare and not bare.startswith(("#", "//", "/*", "*")) else 0.0


def scores(lines: list[str], issues: list[tuple[int, int]] = (), starts: list[int] = (), keep_tags: tuple[str, ...] = (), level: str = "medium") -> list[float]:
    """The score of every line, before context is spread."""
    out = []
    for line in lines:
        v = _SCORES.get(line)
        if v is None:
            if len(_SCORES) >= _MEMO:
                _SCORES.clear()
            v = _SCORES[line] = line_score(line)
        out.append(v)
    n = len(out)
    for at, severity in issues:
        reach = 2 if (severity or 0) >= 3 else 0
        for i in range(max(0, at - 1 - reach), min(n, at + reach)):
            out[i] = 1.0
    body = 10 if settings(level)[0] < 0.7 else 5
    for at in starts:
        for k in range(body):
            if 0 <= at - 1 + k < n:
                out[at - 1 + k] = max(out[at - 1 + k], 1.0 if k < 5 else 0.5)
    if keep_tags:
        tags = [t.lower() for t in keep_tags]
        for i, line in enumerate(lines):
            low = line.lower()
            if any(t in low for t in tags):
                for j in range(max(0, i - 1), min(n, i + 2)):
                    out[j] = 1.0
    return out


def runs(kept: list[bool]) -> list[tuple[int, int, bool]]:
    """(first, end, kept) of the runs of equal flags."""
    out: list[tuple[int, int, bool]] = []
    for i, k in enumerate(kept):
        if out and out[-1][2] == k:
            out[-1] = (out[-1][0], i + 1, k)
        else:
            out.append((i, i + 1, k))
    return out


def spread(score: list[float], context: int) -> list[float]:
    """Lines near an important one count at least 0.8; lifted lines lift no others."""
    out = list(score)
    for i, s in enumerate(score):
        if s >= 0.9:
            for j in range(max(0, i - context), min(len(score), i + context + 1)):
                out[j] = max(out[j], 0.8)
    return out


def kept_lines(score: list[float], level: str = "medium", least: int = 3) -> list[bool]:
    threshold, context = settings(level)
    keep = [s >= threshold for s in spread(score, context)]
    for a, b, k in runs(keep):
        if not k and b - a < least:
            keep[a:b] = [True] * (b - a)
    return keep


def mended(lines: list[str], keep: list[bool]) -> list[bool]:
    """Kept Python lines that do not parse get back the omitted segment at the line of the error; lines are counted over all segments."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse("\n".join(x for x, k in zip(lines, keep) if k))
            return keep
        except SyntaxError as e:
            at = e.lineno
        except (ValueError, RecursionError, MemoryError):
            return keep
    out = list(keep)
    for a, b, k in runs(keep):
        if at is not None and a <= at < b:
            if not k:
                out[a:b] = [True] * (b - a)
            break
    return out


def segmented(path: str | None, text: str, issues=(), starts=(), level: str = "medium", least: int = 3, keep_tags: tuple[str, ...] = (), placeholder: str = PLACEHOLDER, check: bool = False, texts: bool = True) -> list[tuple]:
    """(segment, kind, start_line, end_line, lines, issues, patterns, content) of a text in order."""
    lines = text.split("\n")
    places = sorted(at for at, _ in issues)
    keep = kept_lines(scores(lines, issues, starts, keep_tags, level), level, least)
    if check and K.language_of_path(path) == "python":
        keep = mended(lines, keep)
    out = []
    for k, (a, b, code) in enumerate(runs(keep), 1):
        within = bisect_right(places, b) - bisect_left(places, a + 1)
        names = [] if code else [n for n, p in _PATTERNS.items() if any(p.search(x) for x in lines[a:b])]
        content = None
        if texts:
            content = "\n".join(lines[a:b]) if code else placeholder.replace("{lines}", str(b - a)).replace("{issues}", str(within)) + (f", patterns: {', '.join(names)}" if names else "")
        out.append((k, "code" if code else "omitted", a + 1, b, b - a, within, names, content))
    return out


def _inputs(files: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    some = files.filter("content is not null and content <> ''")
    carry = [c for c in ("file_id", "delivery") if c in files.columns]
    return some, carry, ["path", "content", *(c for c in ("issues", "starts") if c in files.columns)]


def _marks(columns: list[str], row: tuple, declare: bool, path: str | None, content: str) -> tuple[list, list]:
    given = dict(zip(columns, row))
    issues = [(i["line_no"], i["severity"]) for i in given.get("issues") or () if i["line_no"] is not None]
    starts = [x for x in given.get("starts") or () if x is not None]
    if declare:
        starts += [d[2] for d in parse.file_declarations(path, content)[1]]
    return issues, starts


def importance(files: DataFrame, level: str = "medium", keep_tags: tuple[str, ...] = (), declare: bool = False) -> DataFrame:
    """(file_id, scores array<double>): the score of every line; ``declare`` marks the declarations that the parsers find."""
    some, carry, columns = _inputs(files)

    def kernel(*lists):
        out = []
        for row in zip(*lists):
            issues, starts = _marks(columns, row, declare, row[0], row[1])
            out.append(scores(row[1].split("\n"), issues, starts, keep_tags, level))
        return [out]

    return K.once(map_rows(some, carry, columns, kernel, "scores array<double>", costly=True), "scores")


def _segment_rows(files: DataFrame, texts: bool, **options) -> DataFrame:
    some, carry, columns = _inputs(files)
    declare = options.pop("declare", False)

    def kernel(*lists):
        out = []
        for row in zip(*lists):
            issues, starts = _marks(columns, row, declare, row[0], row[1])
            out.append(segmented(row[0], row[1], issues, starts, texts=texts, **options))
        return [out]

    return map_rows(some, carry, columns, kernel, f"segments {SEGMENT}", costly=True)


def segments(files: DataFrame, **options) -> DataFrame:
    """(file_id, segment, kind, start_line, end_line, lines, issues, patterns). Options are those of ``segmented`` and ``declare``."""
    each = K.once(_segment_rows(files, False, **options), "segments").select("file_id", F.explode("segments").alias("s"))
    return each.select("file_id", "s.segment", "s.kind", "s.start_line", "s.end_line", "s.lines", "s.issues", "s.patterns")


def segment_json(files: DataFrame, **options) -> DataFrame:
    """(file_id, segments): every segment of a file as JSON, with its content."""
    each = _segment_rows(files, True, **options).withColumn("json", F.to_json("segments"))
    return K.once(each, F.col("json").alias("segments"))


def assembled(segments_: Column) -> Column:
    return F.array_join(F.transform(segments_, lambda s: s["content"]), "\n")


def compressed(files: DataFrame, **options) -> DataFrame:
    """(file_id, content): kept lines as they are, each omitted segment one placeholder."""
    return K.once(_segment_rows(files, True, **options), assembled(F.col("segments")).alias("content"))


def compressed_in(files: DataFrame, **options) -> DataFrame:
    """(file_id, delivery, path, content) with the compressed content in its place, one row for each row in; empty contents stay."""
    carry = [c for c in files.columns if c not in ("content", "issues", "starts")]
    columns = ["path", "content", *(c for c in ("issues", "starts") if c in files.columns)]
    declare = options.pop("declare", False)

    def kernel(*lists):
        out = []
        for row in zip(*lists):
            if not row[1]:
                out.append(row[1])
                continue
            issues, starts = _marks(columns, row, declare, row[0], row[1])
            out.append("\n".join(s[-1] for s in segmented(row[0], row[1], issues, starts, **options)))
        return [out]

    given = files.withColumn("_text", F.col("content")).drop("content")
    return map_rows(given, carry, ["_text" if c == "content" else c for c in columns], kernel, "content string", costly=True).select(*files.drop("issues", "starts").columns)


def summary(files: DataFrame, **options) -> DataFrame:
    """Per corpus: lines, kept lines, code segments, and files by the share they lose."""
    s = F.col("segments")
    code = F.filter(s, lambda x: x["kind"] == "code")

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("bigint"), lambda acc, x: acc + x["lines"])

    per = K.once(_segment_rows(files, False, **options).select("*", total(s).alias("lines"), total(code).alias("kept"), F.size(code).alias("code_segments")), "lines", "kept", "code_segments")
    lost = 1 - F.col("kept") / F.col("lines")
    return per.agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("kept").alias("kept_lines"), F.sum("code_segments").alias("code_segments"), F.count_if(lost > 0.7).alias("much"), F.count_if((lost >= 0.4) & (lost <= 0.7)).alias("some"), F.count_if(lost < 0.4).alias("little"))


def table_marks(files: DataFrame, issues: DataFrame | None = None, declarations: DataFrame | None = None) -> DataFrame:
    """``files`` with issues from (file_id, line_number, severity) and starts from (file_id, start_line): one narrow row a file on the joined side."""
    out = scattered(files)  # before the joins, whose partitions are left to adaptive execution
    if issues is not None:
        per = issues.filter("line_number is not null").groupBy("file_id").agg(F.sort_array(F.collect_set(F.struct(F.col("line_number").alias("line_no"), "severity"))).alias("issues"))
        out = out.join(per, "file_id", "left")
    if declarations is not None:
        per = declarations.filter("start_line is not null").groupBy("file_id").agg(F.sort_array(F.collect_set("start_line")).alias("starts"))
        out = out.join(per, "file_id", "left")
    return out
