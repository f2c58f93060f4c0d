"""Line rules over files: one combined test first, then each rule on the lines that passed it."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import rules as R
from corpusmill.functions import text as T
from corpusmill.functions.arrow import map_columns, map_rows
from corpusmill.functions.attacks import ATTACK_RULES
from corpusmill.operators import files as K

IGNORE = re.compile(r"(?:#|//|/\*)\s*(?:nosec\b|scan-ignore(?:-line)?(?![\w-]))", re.I | re.A)
BLOCK = re.compile(r"scan-ignore-(?:(start)|end)", re.I | re.A)
_FOUND = "array<struct<line_no:int,rule:string,severity:int,masked:string>>"


def lines(files: DataFrame) -> DataFrame:
    """(file_id, path, line_no, line): numbered from 1, split at line feeds."""
    return files.select("file_id", "path", F.posexplode(T.lines("content")).alias("p", "line")).select("file_id", "path", (F.col("p") + 1).alias("line_no"), "line")


def compiled(custom=(), rules=R.SECRET_RULES) -> tuple[R.Rule, ...]:
    """Built-in rules overlaid by custom ones: a custom rule with the name of another takes its place. Unsafe patterns are refused."""
    for r in custom:
        R.checked_regex(r.regex)
    by_name = {r.name: r for r in (*rules, *custom)}
    return tuple(by_name.values())


@lru_cache(maxsize=16)
def _patterns(rules: tuple[R.Rule, ...]) -> list[tuple[R.Rule, re.Pattern]]:
    return [(r, re.compile(r.regex, re.A)) for r in rules]


def ignored_lines(text: str) -> set[int]:
    """Numbers of the lines that an ignore mark covers: on the line, on the one before, or an open block."""
    out: set[int] = set()
    open_ = before = False
    for n, line in enumerate(text.split("\n"), 1):
        here = bool(IGNORE.search(line))
        if m := BLOCK.search(line):
            open_ = bool(m[1])
        if here or before or open_:
            out.add(n)
        before = here
    return out


def mask(value: str) -> str:
    """The ends of a finding, as many characters as its length allows."""
    n = len(value)
    k = 3 if n > 8 else 2 if n > 4 else 1 if n > 2 else 0
    return f"{value[:k]}****{value[n - k:]}" if k else "****" if value else ""


def _lines_with(text: str, low: str, hints: tuple[str, ...]) -> list[tuple[int, int]]:
    """(start, end) of every line that holds a hint; all lines without hints, or where small letters are not as many as letters."""
    if not hints or len(low) != len(text):
        ends = [m.start() for m in re.finditer("\n", text)] + [len(text)]
        return list(zip([0, *(e + 1 for e in ends)], ends))
    out: dict[int, int] = {}
    for h in hints:
        where = low if h == h.lower() else text
        at = where.find(h)
        while at >= 0:
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            out[text.rfind("\n", 0, at) + 1] = end
            at = where.find(h, end)
    return sorted(out.items())


def text_findings(text: str, rules: tuple[R.Rule, ...] = R.SECRET_RULES, marks: bool = True) -> list[tuple[int, str, int, str]]:
    """(line_no, rule, severity, value) of every finding in the order of rules and places; with ``marks``, of those that no ignore mark covers."""
    low = text.lower()
    skip = ignored_lines(text) if marks and ("nosec" in low or "scan-ignore" in low) else ()
    out = []
    for r, p in _patterns(rules):
        for a, b in _lines_with(text, low, r.hints):
            for m in p.finditer(text[a:b]):
                n = text.count("\n", 0, a) + 1
                if n not in skip:
                    out.append((n, r.name, r.severity, m[r.group]))
    return out


def masked_text(text: str, rules: tuple[R.Rule, ...] = R.SECRET_RULES) -> str:
    """A text with every finding masked wherever its value stands: the longer first, so that one inside another does not break it, until none is left."""
    while values := sorted({v for *_, v in text_findings(text, rules) if v and "****" not in v}, key=lambda v: (-len(v), v)):
        before = text
        for v in values:
            text = text.replace(v, mask(v))
        if text == before:
            break
    return text


def _rows(files: DataFrame, rules, marks: bool, least: int | str) -> DataFrame:
    rules = tuple(rules)

    def kernel(texts):
        return [[[(n, rule, s, mask(v)) for n, rule, s, v in text_findings(t, rules, marks)] if t is not None else [] for t in texts]]

    carry = [c for c in ("file_id", "delivery", "path") if c in files.columns]
    found = map_rows(files, carry, ["content"], kernel, f"found {_FOUND}", costly=True)
    out = K.once(found, "path", "found").select("file_id", "path", F.explode("found").alias("f"))
    rows = out.select("file_id", "path", "f.line_no", "f.rule", T.downgraded(F.col("f.severity"), "path").alias("severity"), "f.masked")
    return rows.filter(F.col("severity") >= severity_level(least)).distinct()


def findings(files: DataFrame, rules=R.SECRET_RULES, least: int | str = 0) -> DataFrame:
    """(file_id, path, line_no, rule, severity, masked): severity counts one level less in test files. Ignore marks do not count."""
    return _rows(files, rules, False, least)


def unignored(files: DataFrame, rules=R.SECRET_RULES, least: int | str = 0) -> DataFrame:
    """The findings that no ignore mark covers."""
    return _rows(files, rules, True, least)


def ignored(files: DataFrame) -> DataFrame:
    """(file_id, line_no) of the lines that an ignore mark covers."""

    def kernel(texts):
        return [[sorted(ignored_lines(t)) if t is not None else [] for t in texts]]

    marked = files.withColumn("_marked", F.when(F.col("content").rlike(r"(?i)nosec|scan-ignore"), F.col("content")))
    each = map_rows(marked, [c for c in ("file_id", "delivery") if c in files.columns], ["_marked"], kernel, "skip array<int>")
    return K.once(each, "skip").select("file_id", F.explode("skip").alias("line_no"))


def masked(files: DataFrame, rules=R.SECRET_RULES, hide: bool = True) -> DataFrame:
    """``files`` with found array<struct<line_no, rule, severity, masked>> of the findings that no ignore mark covers and, if ``hide``, with masked contents.

    Lines stay where they are.
    """
    rules = tuple(rules)

    def kernel(texts):
        found = [text_findings(t, rules) if t is not None else [] for t in texts]
        return [[[(n, rule, s, mask(v)) for n, rule, s, v in f] for f in found], [masked_text(t, rules) if f and hide else t for t, f in zip(texts, found)]]

    carry = [c for c in files.columns if c not in ("found", "content")]
    return map_rows(files.withColumnRenamed("content", "_plain"), carry, ["_plain"], kernel, f"found {_FOUND}, content string", costly=True)


SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")


def severity_level(least: int | str) -> int:
    """A threshold as a number; what is no severity counts as medium."""
    if isinstance(least, int):
        return least if 0 <= least < len(SEVERITIES) else 2
    return SEVERITIES.index(least.upper()) if least.upper() in SEVERITIES else 2


def unwanted_path(path: Column | str, globs) -> Column:
    """Whether a path, its name or any directory above it matches an ignore pattern."""
    return K.matches_any(path, globs)


def unwanted_finding(found: Column | str, patterns) -> Column:
    """Whether a finding matches a pattern of findings that are known to be harmless."""
    f = F.col(found) if isinstance(found, str) else found
    return f.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


#: What stands in the place of dangerous content. Fixed value.
REMOVED = "[REDACTED: POTENTIALLY DANGEROUS CONTENT]"


def redacted(content: Column | str, removed: str = REMOVED) -> Column:
    """Dangerous content removed; of a secret only the value is, its name and mark stay."""
    c = F.col(content) if isinstance(content, str) else content
    for name, regex in R.DANGEROUS.items():
        if name == "secrets_pattern":
            c = F.regexp_replace(c, regex.replace(r"\s*[:=]\s*", r"(\s*[:=])\s*"), '$1$2 "[REDACTED]"')
        else:
            c = F.regexp_replace(c, "(?d)" + regex, removed)
    return c


def dangerous(files: DataFrame) -> DataFrame:
    """One flag for each family of dangerous content."""
    c = F.coalesce("content", F.lit(""))
    return K.once(files, *(c.rlike("(?d)" + p).alias(name) for name, p in R.DANGEROUS.items()))


def report(found: DataFrame) -> DataFrame:
    """Findings by test and production files: files, findings, rules and a histogram of severities."""
    return found.groupBy(T.is_test("path").alias("in_tests")).agg(
        F.countDistinct("file_id").alias("files"), F.count("*").alias("findings"), F.countDistinct("rule").alias("rules"), *(F.count_if(F.col("severity") == s).alias(f"severity_{s}") for s in range(5))
    )


def deduplicated(issues: DataFrame) -> DataFrame:
    """Scanner findings once each: the lowest id of those that agree in file, line, rule and context."""
    key = ["file_id", "line_number", "rule_id", "context"]
    return issues.groupBy(*key).agg(F.min("issue_id").alias("issue_id"), F.max("severity").alias("severity")).select("issue_id", "file_id", "line_number", "rule_id", "severity")


_ATTACK = "array<struct<rule:string,severity:int,line_no:int,column:int,snippet:string,cwe:string,message:string>>"


def attacks(files: DataFrame, rules=ATTACK_RULES) -> DataFrame:
    """(file_id, rule, severity, line_no, column, snippet, cwe, message): matches over whole contents, with their places.

    Rules apply to their languages, those for all to every file. A place needs offsets, which built-in
    functions do not give; files without any match never leave the JVM. Both dialects are held to ASCII
    classes and to line feeds as line ends, so that they agree.
    """
    language = K.language_by_extension("path")
    some = F.lit(False)
    for langs in dict.fromkeys(r.languages for r in rules):
        any_rule = "(?d)" + "|".join(f"(?:{r.regex})" for r in rules if r.languages == langs)
        some = some | ((F.lit(True) if langs == ("all",) else language.isin(*langs)) & F.col("content").rlike(any_rule))

    def kernel(paths, contents):
        compiled_ = [(r, re.compile(r.regex, re.ASCII)) for r in rules]
        out = []
        for path, text in zip(paths, contents):
            own = K.language_of_path(path)
            out.append([(r.name, r.severity, text.count("\n", 0, m.start()) + 1, m.start() - text.rfind("\n", 0, m.start()), m[0][:100], r.cwe, r.message) for r, p in compiled_ if r.languages == ("all",) or own in r.languages for m in p.finditer(text)])
        return [out]

    carry = [c for c in ("file_id", "delivery") if c in files.columns]
    found = map_rows(files.filter(some), carry, ["path", "content"], kernel, f"hits {_ATTACK}")
    return K.once(found, "hits").select("file_id", F.explode("hits").alias("h")).select("file_id", "h.*")


def attack_counts(files: DataFrame, rules=ATTACK_RULES) -> DataFrame:
    """(rule, files, matches) without leaving the JVM."""
    language, content = K.language_by_extension("path"), F.coalesce("content", F.lit(""))

    def count(r: R.Rule) -> Column:
        n = F.regexp_count(content, F.lit("(?d)" + r.regex))
        return n if r.languages == ("all",) else F.when(language.isin(*r.languages), n).otherwise(0)

    per = K.once(files, F.array(*map(count, rules)).alias("n"))
    names = F.array(*(F.lit(r.name) for r in rules))
    each = per.select(F.explode(F.arrays_zip(names.alias("rule"), F.col("n"))).alias("r")).filter("r.n > 0")
    return each.groupBy("r.rule").agg(F.count("*").alias("files"), F.sum("r.n").alias("matches"))


def formatted(issues: DataFrame, least: int | str = "MEDIUM") -> DataFrame:
    """(file_path, text): the findings of a file at or over a threshold, the worst first, as lines of a report."""
    name = F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("severity") + 1)
    line = F.struct((-F.col("severity")).alias("s"), F.col("line_number"), F.col("rule_id"), F.concat(name, F.lit(" line "), F.coalesce(F.col("line_number").cast("string"), F.lit("?")), F.lit(": "), F.coalesce("description", F.lit("")), F.lit(" ["), F.coalesce("rule_id", F.lit("")), F.lit("]")).alias("text"))
    kept = issues.filter(F.col("severity") >= severity_level(least)).select("file_path", line.alias("l")).distinct()
    return kept.groupBy("file_path").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["text"]), "\n").alias("text"))


def new_findings(external: DataFrame, own: DataFrame) -> DataFrame:
    """Findings of another scanner whose (file_id, line_number, rule_id) the own ones do not have."""
    return external.join(own.select("file_id", "line_number", "rule_id"), ["file_id", "line_number", "rule_id"], "left_anti")


def external(files: DataFrame, command: list[str], timeout: int = 60) -> DataFrame:
    """(file_id, rule_id, severity, line_number, message, error) from a scanner that is run once a file and prints JSON results.

    The text goes to a file of its own beside the worker, which is removed; ERROR counts as high, WARNING as
    medium, the rest as low. A command that is missing, fails or takes too long gives one row with its error.
    """

    def run(text: str, suffix: str) -> tuple[list[dict], str | None]:
        import json
        import subprocess
        import tempfile

        with tempfile.NamedTemporaryFile("w", suffix=suffix, encoding="utf-8", newline="") as f:
            f.write(text)
            f.flush()
            try:
                done = subprocess.run([*command, f.name], capture_output=True, text=True, timeout=timeout)
                return json.loads(done.stdout or "{}").get("results", []), None
            except (OSError, ValueError, subprocess.TimeoutExpired) as e:
                return [], str(e)

    def kernel(ids, paths, texts):
        out: list[list] = [[] for _ in range(6)]
        for i, path, text in zip(ids, paths, texts):
            if text is None:
                continue
            results, error = run(text, "." + (path or "").rpartition(".")[2])
            rows = [(i, r.get("check_id"), {"ERROR": 3, "WARNING": 2}.get(r.get("extra", {}).get("severity"), 1), r.get("start", {}).get("line"), r.get("extra", {}).get("message"), None) for r in results]
            for row in rows or ([(i, None, None, None, None, error)] if error else []):
                for c, v in zip(out, row):
                    c.append(v)
        return out

    return map_columns(files, ["file_id", "path", "content"], kernel, "file_id bigint, rule_id string, severity int, line_number int, message string, error string").distinct()
