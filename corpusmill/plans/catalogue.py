"""The core's queries over the driver tables, each with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import rules as R
from corpusmill.functions import text as T
from corpusmill.functions.attacks import ATTACK_RULES
from corpusmill.operators import compress, content, diff, files, graph, merge, nested, parse, render, scan, summarize
from corpusmill.plans import pipeline
from corpusmill.plans.registry import query
from corpusmill.session import table

#: The files relation in SQL.
FILES = "f AS (SELECT DISTINCT ON (file_id) file_id, repo, repo || '/' || file_path AS path, content, declarations, imports FROM parsed_files ORDER BY file_id, ingested_at DESC NULLS LAST, collected_at DESC NULLS LAST)"
LINE_END = "'\\r\\n|[\\n\\r\\x{000b}\\x{000c}\\x{001c}-\\x{001e}\\x{0085}\\x{2028}\\x{2029}]'"
LINE_COUNT = f"(len(regexp_extract_all(coalesce(content, ''), {LINE_END})) + CASE WHEN length(coalesce(content, '')) > 0 AND NOT regexp_matches(right(content, 1), '[\\n\\r\\x{{000b}}\\x{{000c}}\\x{{001c}}-\\x{{001e}}\\x{{0085}}\\x{{2028}}\\x{{2029}}]') THEN 1 ELSE 0 END)"
BYTES = "strlen(coalesce(content, ''))"
EXT = "regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+\\.([^.]*)$', 1)"
LANG = "CASE lower(regexp_extract(path, '([^/]*)$', 1)) WHEN 'dockerfile' THEN 'dockerfile' WHEN 'makefile' THEN 'makefile' WHEN 'cmakelists.txt' THEN 'cmake' ELSE CASE lower(" + EXT + ") " + " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in files.EXTENSIONS.items()) + " END END"
CATEGORY = """CASE WHEN lower(path) LIKE '%test%' OR lower(path) LIKE '%spec%' THEN 'test'
 WHEN regexp_matches(lower(path), '\\.(md|rst|txt)$') THEN 'documentation'
 WHEN regexp_matches(lower(path), '\\.(json|yml|yaml|toml|ini)$') THEN 'configuration'
 WHEN regexp_matches(lower(path), '\\.(py|js|ts|java|cpp|go)$') THEN 'source' ELSE 'other' END"""
DIR = "CASE WHEN contains(path, '/') AND regexp_extract(path, '^(.*)/[^/]*$', 1) <> '' THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END"
WORDS = r"len(regexp_extract_all(coalesce(content, ''), '[^\s\x{000b}\x{001c}-\x{001f}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))"
TOKENS = f"CASE WHEN coalesce(content, '') = '' THEN 0 ELSE greatest(1, {WORDS} + len(regexp_extract_all(content, '[.,!?;:\"'']'))) END"
LINES = f"WITH {FILES}, l AS (SELECT file_id, path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no FROM f WHERE content IS NOT NULL)"


def _files(spark, d):
    return files.files(table(spark, d, "parsed_files"))


def _anti(parts):
    return " OR ".join(f"contains(lower(path), '{p}')" for p in parts)


@query(
    "corpus_stats",
    f"WITH {FILES} SELECT count(*) AS files, sum({LINE_COUNT})::BIGINT AS lines, sum({BYTES})::BIGINT AS bytes, count(DISTINCT {LANG}) AS languages, floor(sum({BYTES}) / count(*))::BIGINT AS average_size, count(*) FILTER (NOT regexp_matches(path, '\\.(md|txt|rst)$')) AS source_files, count(*) FILTER (regexp_matches(path, '\\.(md|txt|rst)$')) AS doc_files FROM f",
)
def corpus_stats(spark, d):
    return files.stats(_files(spark, d))


@query("category_counts", f"WITH {FILES}, c AS (SELECT {CATEGORY} AS c FROM f) SELECT " + ", ".join(f"count(*) FILTER (c = '{k}') AS {k}" for k in ("source", "test", "documentation", "configuration", "other")) + " FROM c")
def category_counts(spark, d):
    return files.category_counts(_files(spark, d))


@query("file_metadata", f"WITH {FILES} SELECT file_id, {DIR} AS dir, regexp_extract(path, '([^/]*)$', 1) AS name, {EXT} AS ext, {BYTES}::BIGINT AS bytes, {LINE_COUNT}::BIGINT AS lines, {CATEGORY} AS category, CASE WHEN {BYTES} < 1024 THEN printf('%d B', {BYTES}) WHEN {BYTES} < 1048576 THEN printf('%.1f KB', {BYTES} / 1024.0) ELSE printf('%.1f MB', {BYTES} / 1048576.0) END AS size FROM f")
def file_metadata(spark, d):
    return files.metadata(_files(spark, d))


def _index(key_sql):
    return f"WITH {FILES} SELECT {key_sql} AS k, count(*) AS files, min(path) AS first_path, max(path) AS last_path FROM f GROUP BY 1"


@query("index_by_language", _index(LANG))
def index_by_language(spark, d):
    return files.index_by(_files(spark, d), files.language_by_extension("path"))


@query("index_by_type", _index(CATEGORY))
def index_by_type(spark, d):
    return files.index_by(_files(spark, d), T.category("path"))


@query("index_by_directory", _index(DIR))
def index_by_directory(spark, d):
    return files.index_by(_files(spark, d), T.directory("path"))


@query("members_by_language", f"WITH {FILES} SELECT {LANG} AS k, path, row_number() OVER (PARTITION BY {LANG} ORDER BY path) AS n FROM f")
def members_by_language(spark, d):
    return files.members_by(_files(spark, d), files.language_by_extension("path"))


@query("path_redaction", f"WITH {FILES} SELECT file_id, CASE WHEN starts_with(path, 'korvane/monotree/') THEN substr(path, 18) ELSE array_to_string(list_slice(string_split(path, '/'), -2, -1), '/') END AS redacted FROM f")
def path_redaction(spark, d):
    return files.once(_files(spark, d), "path").select("file_id", T.redacted_path("path", "korvane/monotree").alias("redacted"))


@query("path_flags", f"WITH {FILES} SELECT file_id, {_anti(T.TEST_PARTS)} AS is_test, {_anti(T.DEPENDENCY_PARTS)} AS is_dependency FROM f")
def path_flags(spark, d):
    return files.once(_files(spark, d), "path").select("file_id", T.is_test("path").alias("is_test"), T.is_dependency("path").alias("is_dependency"))


@query("line_counts", f"WITH {FILES} SELECT file_id, {LINE_COUNT}::BIGINT AS lines, len(string_split(content, chr(10)))::BIGINT AS split_lines FROM f")
def line_counts(spark, d):
    return files.once(_files(spark, d), T.line_count("content").alias("lines"), F.when(F.col("content").isNotNull(), F.size(T.lines("content"))).cast("bigint").alias("split_lines"))


@query("line_lengths", LINES + " SELECT length(line)::BIGINT AS length, count(*) AS lines, min(line_no)::BIGINT AS first_line FROM l GROUP BY 1")
def line_lengths(spark, d):
    per = files.once(_files(spark, d), F.transform(T.lines("content"), lambda x: F.length(x)).alias("lengths"))
    each = per.select(F.posexplode("lengths").alias("p", "length"))
    return each.groupBy(F.col("length").cast("bigint").alias("length")).agg(F.count("*").alias("lines"), (F.min("p") + 1).cast("bigint").alias("first_line"))


WIDE = "length(regexp_replace(coalesce(content, ''), '[\\x00-\\x7f]', '', 'g'))"


@query("token_estimates", f"WITH {FILES} SELECT file_id, ({TOKENS})::BIGINT AS gpt4_tokens, {WORDS}::BIGINT AS words, " + ", ".join(f"trunc(length(coalesce(content, '')) / {x}::DOUBLE)::BIGINT AS {k}_tokens" for k, x in (("claude", 3.5), ("gemini", 4.0), ("llama", 3.8))) + f", trunc((length(coalesce(content, '')) - {WIDE}) / 4.0::DOUBLE + {WIDE} * 1.5::DOUBLE)::BIGINT AS multibyte_tokens FROM f")
def token_estimates(spark, d):
    return files.tokens(_files(spark, d))


@query("cost_estimates", f"WITH {FILES}, t AS (SELECT file_id, ({TOKENS})::BIGINT AS i FROM f) SELECT file_id, i AS input_tokens, least(500, floor(i * 0.3::DOUBLE))::BIGINT AS output_tokens, round(i / 1000.0::DOUBLE * 0.01::DOUBLE + least(500, floor(i * 0.3::DOUBLE)) / 1000.0::DOUBLE * 0.03::DOUBLE, 8) AS cost FROM t")
def cost_estimates(spark, d):
    return files.costs(_files(spark, d))


@query("document_tokens", f"SELECT source, sum({TOKENS})::BIGINT AS tokens, count(*) AS texts FROM (SELECT source, text AS content FROM documents) GROUP BY source")
def document_tokens(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.sum(T.fallback_tokens("text")).alias("tokens"), F.count("*").alias("texts"))


@query("content_hashes", f"WITH {FILES} SELECT file_id, sha256(coalesce(content, '')) AS sha256, md5(coalesce(content, '')) AS md5 FROM f")
def content_hashes(spark, d):
    return files.hashes(_files(spark, d))


@query("cache_keys", f"WITH {FILES} SELECT file_id, sha256(lower(trim(regexp_replace(regexp_replace(coalesce(content, ''), '//[^\\n]*|#[^\\n]*', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), ' '))) AS cache_key FROM f")
def cache_keys(spark, d):
    return files.cache_keys(_files(spark, d))


ANCHOR = "regexp_replace(regexp_replace(lower(regexp_replace(path, '^[./]+', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query("navigation", f"WITH {FILES} SELECT repo, path, file_id, row_number() OVER w AS n, {ANCHOR} AS anchor, lag({ANCHOR}) OVER w AS prev_anchor, lead({ANCHOR}) OVER w AS next_anchor FROM f WINDOW w AS (PARTITION BY repo ORDER BY path, file_id)")
def navigation(spark, d):
    return files.navigation(_files(spark, d))


@query(
    "directory_tree",
    f"WITH {FILES}, p AS (SELECT string_split(path, '/') AS parts FROM f), n AS (SELECT DISTINCT array_to_string(parts[1:k], '/') AS node, k AS depth, k = len(parts) AS is_file FROM (SELECT parts, unnest(generate_series(1, len(parts))) AS k FROM p)), q AS (SELECT *, CASE WHEN depth = 1 THEN '' ELSE regexp_extract(node, '^(.*)/[^/]*$', 1) END AS parent FROM n), c AS (SELECT parent, count(*) AS children FROM q WHERE depth > 1 GROUP BY 1) SELECT node, depth::BIGINT AS depth, is_file, row_number() OVER (PARTITION BY q.parent ORDER BY node DESC) = 1 AS last, coalesce(children, 0) AS children FROM q LEFT JOIN c ON c.parent = q.node",
)
def directory_tree(spark, d):
    return files.tree(_files(spark, d)).withColumn("depth", F.col("depth").cast("bigint"))


@query("output_split", f"WITH {FILES}, n AS (SELECT file_id, len(string_split(content, chr(10))) AS n, ceil(len(string_split(content, chr(10))) / 3.0)::BIGINT AS chunk FROM f WHERE content IS NOT NULL) SELECT file_id, part::INT AS part, least(chunk, n - (part - 1) * chunk)::BIGINT AS lines FROM (SELECT *, unnest(generate_series(1, ceil(n / chunk::DOUBLE)::BIGINT)) AS part FROM n)")
def output_split(spark, d):
    return files.split_output(_files(spark, d))


_BINARY = "lower(" + EXT + ") IN (" + ", ".join(f"'{e}'" for e in files.BINARY_EXTENSIONS) + f") OR {_anti(files.BINARY_PARTS)}"
_EXCLUDES = ("**/third_party/**", "vendor/", "*.lock.json")
_SKIP = f"""CASE WHEN regexp_matches(path, '^(?:.*/)?third_party/.*(?:/.*)?$') THEN 'excluded_pattern' WHEN regexp_matches(path, '^(?:.*/)?vendor/.*(?:/.*)?$') THEN 'excluded_pattern' WHEN regexp_matches(path, '^(?:.*/)?[^/]*\\.lock\\.json(?:/.*)?$') THEN 'excluded_pattern'
 WHEN regexp_matches(lower(path), '\\.(md|rst|txt)$') THEN 'documentation' WHEN lower(regexp_extract(path, '([^/]*)$', 1)) IN ('makefile', 'dockerfile', 'jenkinsfile', 'vagrantfile') THEN 'special_file'
 WHEN {LANG} IS NULL THEN 'unknown_language' WHEN {LANG} IN ('ruby') THEN 'excluded_language' WHEN {_BINARY} THEN 'binary' WHEN content IS NULL THEN 'unreadable' WHEN {BYTES} > 20000 THEN 'too_large' WHEN contains(content, chr(0)) THEN 'binary_content' END"""
_OPTIONS = {"excludes": _EXCLUDES, "exclude_languages": ("ruby",), "max_bytes": 20000}


@query("skip_report", f"WITH {FILES} SELECT file_id, path, {_SKIP} AS reason, CASE WHEN {EXT} = '' THEN 'no_extension' ELSE '.' || {EXT} END AS extension FROM f WHERE {_SKIP} IS NOT NULL")
def skip_report(spark, d):
    return files.skipped(_files(spark, d), **_OPTIONS)


@query("skip_summary_top5", f"WITH {FILES} SELECT CASE WHEN {EXT} = '' THEN 'no_extension' ELSE '.' || {EXT} END AS extension, count(*) AS files FROM f WHERE {_SKIP} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def skip_summary_top5(spark, d):
    return files.skip_summary(_files(spark, d), **_OPTIONS)


@query("skip_reasons", f"WITH {FILES} SELECT {_SKIP} AS reason, count(*) AS files FROM f WHERE {_SKIP} IS NOT NULL GROUP BY 1")
def skip_reasons(spark, d):
    return files.skipped(_files(spark, d), **_OPTIONS).groupBy("reason").agg(F.count("*").alias("files"))


# ------------------------------------------------------------------------------------------------ scanning
_RE2 = {"aws_access_key_id": r"(?:^|[^A-Z0-9])(AKIA[0-9A-Z]{16})(?:[^A-Z0-9]|$)"}
_DOWN = "(" + " OR ".join([*(f"contains(lower(path), '{p}')" for p in T.DOWNGRADE_PARTS), "starts_with(regexp_extract(path, '([^/]*)$', 1), 'test_')", *(f"ends_with(path, '{e}')" for e in T.DOWNGRADE_ENDINGS)]) + ")"
_MASK = "CASE WHEN length(x) = 0 THEN '' WHEN length(x) > 8 THEN left(x, 3) || '****' || right(x, 3) WHEN length(x) > 4 THEN left(x, 2) || '****' || right(x, 2) WHEN length(x) > 2 THEN left(x, 1) || '****' || right(x, 1) ELSE '****' END"


def _q(s: str) -> str:
    return s.replace("'", "''")


_FOUND = " UNION ALL ".join(f"SELECT file_id, path, line_no, '{r.name}' AS rule, {r.severity} AS severity, unnest(regexp_extract_all(line, '{_q(_RE2.get(r.name, r.regex))}', {1 if r.name in _RE2 else r.group})) AS x FROM l" for r in R.SECRET_RULES)
_RAW_SCAN = f"{LINES}, x AS ({_FOUND}), s AS (SELECT DISTINCT file_id, path, line_no::INT AS line_no, rule, (CASE WHEN {_DOWN} AND severity BETWEEN 2 AND 4 THEN severity - 1 ELSE severity END)::INT AS severity, {_MASK} AS masked FROM x)"


# Lines that an ignore mark covers: on the line, on the one before, or an open block.
_IGNORED = """m AS (SELECT file_id, line_no, regexp_matches(line, '(?i)(?:#|//|/\\*)\\s*(?:nosec\\b|scan-ignore(?:-line)?(?:[^\\w-]|$))') AS here,
 CASE WHEN regexp_matches(line, '(?i)scan-ignore-start') THEN 1 WHEN regexp_matches(line, '(?i)scan-ignore-end') THEN 0 END AS mark FROM l),
 i AS (SELECT file_id, line_no FROM (SELECT file_id, line_no, here OR coalesce(lag(here) OVER w, false) OR coalesce(last_value(mark IGNORE NULLS) OVER w, 0) = 1 AS skip FROM m WINDOW w AS (PARTITION BY file_id ORDER BY line_no)) WHERE skip)"""
_SCAN = _RAW_SCAN.replace("x AS (", f"{_IGNORED}, x0 AS (", 1).replace(", s AS (", ", x AS (SELECT * FROM x0 WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.file_id = x0.file_id AND i.line_no = x0.line_no)), s AS (", 1)


@query("secret_scan", _SCAN + " SELECT * FROM s")
def secret_scan(spark, d):
    return scan.unignored(_files(spark, d))


@query("secret_scan_all", _RAW_SCAN + " SELECT * FROM s")
def secret_scan_all(spark, d):
    return scan.findings(_files(spark, d))


@query("ignored_lines", f"{LINES}, {_IGNORED} SELECT file_id, line_no::INT AS line_no FROM i")
def ignored_lines(spark, d):
    return scan.ignored(_files(spark, d))


# Every finding masked wherever its value stands, the longer first, twice over; by hash, as texts are long.
@query(
    "masked_contents",
    _SCAN + f", v AS (SELECT file_id, list(DISTINCT struct_pack(n := -length(x), x := x)) AS xs FROM x GROUP BY 1), q AS (SELECT f.file_id, content, CASE WHEN xs IS NULL THEN content ELSE list_reduce(list_concat([content], list_transform(list_sort(xs), lambda e: e.x)), lambda acc, x: replace(acc, x, {_MASK})) END AS masked FROM f LEFT JOIN v USING (file_id) WHERE content IS NOT NULL) SELECT file_id, sha256(masked) AS h, masked <> content AS changed FROM q",
)
def masked_contents(spark, d):
    m = scan.masked(_files(spark, d).withColumn("plain", F.sha2("content", 256)))
    return files.once(m, F.sha2("content", 256).alias("h"), (F.sha2("content", 256) != F.col("plain")).alias("changed")).filter("h is not null")


@query("secret_scan_threshold", _SCAN + " SELECT rule, count(*) AS findings FROM s WHERE severity >= 3 GROUP BY rule")
def secret_scan_threshold(spark, d):
    return scan.unignored(_files(spark, d), least=3).groupBy("rule").agg(F.count("*").alias("findings"))


@query("finding_report", _SCAN + f" SELECT {_anti(T.TEST_PARTS)} AS in_tests, count(DISTINCT file_id) AS files, count(*) AS findings, count(DISTINCT rule) AS rules, " + ", ".join(f"count(*) FILTER (severity = {k}) AS severity_{k}" for k in range(5)) + " FROM s GROUP BY 1")
def finding_report(spark, d):
    return scan.report(scan.unignored(_files(spark, d)))


_DANGEROUS = {
    "exec_patterns": r"\b(exec|eval|system|popen|subprocess\.call|subprocess\.Popen|os\.system|child_process\.exec|require\(\s*[\"']child_process[\"']\)|Runtime\.exec|Process\.start|os\.popen|ShellExecute|WScript\.Shell)\b",
    "sql_injection": r"(?i)(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)\s+.*?(FROM|INTO|TABLE|DATABASE)\s+",
    "path_traversal": r"\.\./|\.\\|\x00|/etc/passwd",
    "template_injection": r"\{\{.+?\}\}|\$\{.+?\}|<%= .+? %>",
    "secrets_pattern": r"(?i)(password|passwd|pwd|secret|api[-_]?key|access[-_]?key|auth[-_]?token|credential|secret[-_]?key|private[-_]?key)\s*[:=]\s*['\"][^'\"]{8,}['\"]",
    "base64_pattern": r"[A-Za-z0-9+/]{40,}={0,2}",
}


@query("dangerous_content", f"WITH {FILES} SELECT file_id, " + ", ".join(f"regexp_matches(coalesce(content, ''), '{_q(p)}') AS {k}" for k, p in _DANGEROUS.items()) + " FROM f")
def dangerous_content(spark, d):
    return scan.dangerous(_files(spark, d))


_NAMES = {0: "INFO", 1: "LOW", 2: "MEDIUM", 3: "HIGH", 4: "CRITICAL"}


@query("issues_by_severity", "WITH i AS (SELECT DISTINCT * FROM security_issues) SELECT file_path, CASE severity " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _NAMES.items()) + " END AS severity_name, count(*) AS issues FROM i GROUP BY 1, 2")
def issues_by_severity(spark, d):
    names = F.create_map(*(F.lit(x) for kv in _NAMES.items() for x in kv))
    return table(spark, d, "security_issues").distinct().groupBy("file_path", names[F.col("severity")].alias("severity_name")).agg(F.count("*").alias("issues"))


@query("issues_deduplicated", "SELECT min(issue_id) AS issue_id, file_id, line_number, rule_id, max(severity) AS severity FROM security_issues GROUP BY file_id, line_number, rule_id, context")
def issues_deduplicated(spark, d):
    return scan.deduplicated(table(spark, d, "security_issues"))


@query("issue_severity_downgraded", "SELECT DISTINCT issue_id, (CASE WHEN coalesce(" + _DOWN.replace("path", "file_path") + ", false) AND severity BETWEEN 2 AND 4 THEN severity - 1 ELSE severity END)::INT AS severity FROM security_issues")
def issue_severity_downgraded(spark, d):
    return table(spark, d, "security_issues").select("issue_id", F.when(F.coalesce(T.downgrades("file_path"), F.lit(False)) & F.col("severity").between(2, 4), F.col("severity") - 1).otherwise(F.col("severity")).alias("severity")).distinct()


# --------------------------------------------------------------------------------------------- compression
_SCORE = "greatest(CASE WHEN {i} THEN 1.0 WHEN {fl} THEN 0.5 WHEN contains(line, 'return') OR contains(line, '=') THEN 0.4 WHEN trim(line, ' ') <> '' AND NOT regexp_matches(trim(line, ' '), '^(#|//|/\\*|\\*)') THEN 0.2 ELSE 0.0 END, CASE WHEN {s} OR {e} OR {d} THEN 1.0 ELSE 0.0 END, CASE WHEN {a} OR {c} THEN 0.8 ELSE 0.0 END, CASE WHEN {y} OR {t} THEN 0.6 ELSE 0.0 END)".format(
    i=f"regexp_matches(line, '{R.IMPORT_LINE}')",
    fl=f"regexp_matches(line, '{R.FLOW_LINE}')",
    **{k: f"regexp_matches(line, '{R.LINE_PATTERNS[n]}')" for k, n in {"s": "security", "e": "error_handling", "d": "database", "a": "api", "c": "config", "y": "async", "t": "testing"}.items()},
)
_L = LINES.replace("WHERE content IS NOT NULL", "WHERE content IS NOT NULL AND content <> ''").replace("SELECT file_id, path, unnest", "SELECT file_id, path, len(string_split(content, chr(10))) AS n, unnest")
# Marks: lines with a finding (two more on either side if it is high), the first lines of declarations, lines beside a tag.
_MARKS = """, si AS (SELECT DISTINCT file_id, line_number, severity FROM security_issues WHERE line_number IS NOT NULL),
 im AS (SELECT file_id, unnest(generate_series(line_number - CASE WHEN severity >= 3 THEN 2 ELSE 0 END, line_number + CASE WHEN severity >= 3 THEN 2 ELSE 0 END)) AS line_no, 1.0 AS mark FROM si),
 ds AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(declarations, '\\\\*"start_line\\\\*"\\s*:\\s*(\\d+)', 1))::BIGINT AS start_line FROM f WHERE json_valid(declarations)),
 dm AS (SELECT file_id, start_line + k AS line_no, CASE WHEN k < 5 THEN 1.0 ELSE 0.5 END AS mark FROM ds, (SELECT unnest(generate_series(0, 9)) AS k)),
 mk AS (SELECT file_id, line_no, max(mark) AS mark FROM (SELECT * FROM im UNION ALL SELECT * FROM dm) GROUP BY 1, 2)"""
_IMPORTANCE = _L + _MARKS + f", v0 AS (SELECT file_id, line_no, line, {_SCORE} AS own, max(CASE WHEN contains(lower(line), 'important') OR contains(lower(line), 'keep') THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS tagged FROM l), v AS (SELECT v0.file_id, v0.line_no, line, greatest(own, coalesce(mark, 0.0), CASE WHEN tagged = 1 THEN 1.0 ELSE 0.0 END) AS importance FROM v0 LEFT JOIN mk ON mk.file_id = v0.file_id AND mk.line_no = v0.line_no)"
_SEGMENTS = (
    _IMPORTANCE
    + """, c AS (SELECT *, greatest(importance, CASE WHEN max(CASE WHEN importance >= 0.9 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 THEN 0.8 ELSE 0.0 END) >= 0.4 AS keep FROM v),
 t AS (SELECT *, CASE WHEN lag(keep) OVER (PARTITION BY file_id ORDER BY line_no) = keep THEN 0 ELSE 1 END AS turn FROM c), r AS (SELECT *, sum(turn) OVER (PARTITION BY file_id ORDER BY line_no) AS run FROM t),
 k AS (SELECT file_id, line_no, line, keep OR count(*) OVER (PARTITION BY file_id, run) < 3 AS keep FROM r), u AS (SELECT *, CASE WHEN lag(keep) OVER (PARTITION BY file_id ORDER BY line_no) = keep THEN 0 ELSE 1 END AS turn FROM k),
 g AS (SELECT *, sum(turn) OVER (PARTITION BY file_id ORDER BY line_no) AS segment FROM u),
 s0 AS (SELECT file_id, segment::BIGINT AS segment, CASE WHEN keep THEN 'code' ELSE 'omitted' END AS kind, min(line_no)::INT AS start_line, max(line_no)::INT AS end_line, count(*) AS lines FROM g GROUP BY file_id, segment, keep),
 s AS (SELECT s0.*, (SELECT count(*) FROM si WHERE si.file_id = s0.file_id AND si.line_number BETWEEN s0.start_line AND s0.end_line)::BIGINT AS issues FROM s0)"""
)
_TAGS = {"keep_tags": ("important", "keep")}


def _scored(spark, d):
    """Files with their findings and the declarations that their deliveries tell of."""
    told = table(spark, d, "parsed_files")
    starts = nested.shred(told.select("file_id", "declarations", "ingested_at", "collected_at"), "file_id", (nested.DECLARATIONS,)).filter("element = 'declaration'").select(F.col("record_id").alias("file_id"), F.col("attributes")["start_line"].cast("int").alias("start_line"))
    return compress.table_marks(_files(spark, d), table(spark, d, "security_issues").select("file_id", "line_number", "severity").distinct(), starts)


@query("line_importance", _IMPORTANCE + " SELECT file_id, round(importance, 2)::DOUBLE AS importance, count(*) AS lines FROM v GROUP BY 1, 2")
def line_importance(spark, d):
    each = compress.importance(_scored(spark, d), **_TAGS).select("file_id", F.explode("scores").alias("importance"))
    return each.groupBy("file_id", F.round("importance", 2).alias("importance")).agg(F.count("*").alias("lines"))


@query("segments", _SEGMENTS + " SELECT * FROM s")
def segments(spark, d):
    return compress.segments(_scored(spark, d), **_TAGS).drop("patterns")


@query("compression_summary", _SEGMENTS + ", p AS (SELECT file_id, sum(lines) AS lines, coalesce(sum(lines) FILTER (kind = 'code'), 0) AS kept, count(*) FILTER (kind = 'code') AS code_segments FROM s GROUP BY 1) SELECT count(*) AS files, sum(lines)::BIGINT AS lines, sum(kept)::BIGINT AS kept_lines, sum(code_segments)::BIGINT AS code_segments, count(*) FILTER (1 - kept / lines > 0.7) AS much, count(*) FILTER (1 - kept / lines BETWEEN 0.4 AND 0.7) AS some, count(*) FILTER (1 - kept / lines < 0.4) AS little FROM p")
def compression_summary(spark, d):
    return compress.summary(_scored(spark, d), **_TAGS)


_PLACED = "'[... code omitted (' || count(*) || ' lines, ' || any_value(issues) || ' issues) ...]' || coalesce(nullif(', patterns: ' || concat_ws(', ', " + ", ".join(f"CASE WHEN bool_or(regexp_matches(line, '{p}')) THEN '{n}' END" for n, p in R.LINE_PATTERNS.items()) + "), ', patterns: '), '')"
_PARTS = _SEGMENTS + f", b AS (SELECT g.file_id, g.segment, CASE WHEN keep THEN string_agg(line, chr(10) ORDER BY line_no) ELSE {_PLACED} END AS part FROM g JOIN s ON s.file_id = g.file_id AND s.segment = g.segment GROUP BY g.file_id, g.segment, keep)"


@query("compressed_documents", _PARTS + " SELECT file_id, string_agg(part, chr(10) ORDER BY segment) AS content FROM b GROUP BY 1")
def compressed_documents(spark, d):
    return compress.compressed(_scored(spark, d), **_TAGS)


@query("token_savings", _PARTS + f", a AS (SELECT sum({TOKENS})::BIGINT AS n FROM (SELECT string_agg(part, chr(10) ORDER BY segment) AS content FROM b GROUP BY file_id)), z AS (SELECT count(*) AS files, sum({TOKENS})::BIGINT AS n FROM f WHERE content IS NOT NULL AND content <> '') SELECT files, z.n AS tokens_before, a.n AS tokens_after, z.n - a.n AS saved, round((z.n - a.n) / z.n::DOUBLE, 6) AS saved_share FROM z, a")
def token_savings(spark, d):
    before = files.once(_files(spark, d).filter("content <> ''"), T.fallback_tokens("content").alias("tokens"))
    return files.token_savings(before, compress.compressed(_scored(spark, d), **_TAGS).select("file_id", T.fallback_tokens("content").alias("tokens")))


# With the declarations that the parsers find and the check of the kept Python code; parsers are not SQL.
@query("compressed_checked")
def compressed_checked(spark, d):
    marked = scan.masked(_files(spark, d), hide=False)
    return compress.compressed(marked.withColumn("issues", F.transform("found", lambda x: F.struct(x["line_no"].alias("line_no"), x["severity"].alias("severity")))), declare=True, check=True)


# ------------------------------------------------------------------------------------------- parser results
_MISSED = "len(coalesce(missed_features, []))"
# What a file declares at its top, however it is written: a list, a wrapper, a lone object.
_DECLARED = """dt AS (SELECT file_id, CASE WHEN json_valid(declarations) THEN CAST(declarations AS JSON) END AS j, CASE WHEN json_valid(imports) THEN CAST(imports AS JSON) END AS i FROM f),
 dl AS (SELECT file_id, CASE json_type(j) WHEN 'ARRAY' THEN json_extract(j, '$[*]') WHEN 'OBJECT' THEN CASE WHEN json_exists(j, '$.kind') OR json_exists(j, '$.name') THEN [j] ELSE json_extract(j, '$.declarations[*]') END ELSE [] END AS ds, CASE json_type(i) WHEN 'ARRAY' THEN json_extract(i, '$[*]') WHEN 'NULL' THEN [] ELSE CASE WHEN i IS NULL THEN [] ELSE [i] END END AS ms FROM dt),
 dk AS (SELECT file_id, list_filter(ds, lambda x: json_type(x) = 'OBJECT') AS ds, list_filter(ms, lambda x: json_type(x) <> 'NULL') AS ms FROM dl),
 dc AS (SELECT file_id, len(ds) AS declared, len(list_filter(ds, lambda x: coalesce(x->>'$.docstring', '') <> '' OR coalesce(x->>'$.signature', '') <> '' OR coalesce(x->>'$.modifiers', '[]') NOT IN ('', '[]', '{}'))) AS complete, len(ms) AS imported FROM dk)"""
_CONF = f"CASE WHEN error IS NOT NULL AND error <> '' THEN 0.3::DOUBLE ELSE greatest(0.0, least(1.0, CASE coalesce(parser_quality, 'unknown') WHEN 'full' THEN 0.4::DOUBLE WHEN 'partial' THEN 0.25 WHEN 'basic' THEN 0.15 ELSE 0.1 END + CASE WHEN coalesce(declared, 0) > 0 THEN least(0.3::DOUBLE, 0.05::DOUBLE * sqrt(declared)) + 0.2::DOUBLE * complete / declared ELSE 0.0::DOUBLE END + least(0.1::DOUBLE, 0.01::DOUBLE * coalesce(imported, 0)) - least(0.15::DOUBLE, 0.03::DOUBLE * {_MISSED}))) END"
_PARSES = f"WITH {FILES}, {_DECLARED}, p AS (SELECT DISTINCT ON (file_id, parser_ord, parser_type) file_id, parser_ord, parser_type, error, coalesce(missed_features, []) AS missed_features, round(coalesce(nullif(confidence_score, 0.0), {_CONF}), 6) AS confidence FROM parse_results LEFT JOIN dc USING (file_id) ORDER BY file_id, parser_ord, parser_type, parsed_at DESC NULLS LAST), u AS (SELECT * FROM (SELECT *, error IS NOT NULL AND error <> '' AS failed, bool_and(error IS NOT NULL AND error <> '') OVER (PARTITION BY file_id) AS all_failed FROM p) WHERE NOT failed OR all_failed)"


def _parses(spark, d):
    return merge.parses(table(spark, d, "parse_results"), merge.declared(table(spark, d, "parsed_files")))


@query("parse_confidence", _PARSES + " SELECT file_id, parser_ord, parser_type, confidence FROM p")
def parse_confidence(spark, d):
    return _parses(spark, d).select("file_id", "parser_ord", "parser_type", "confidence")


@query("merge_fast_fail", _PARSES + " SELECT file_id, parser_type, confidence FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY CASE WHEN confidence >= 0.8 THEN 0 ELSE 1 END, CASE WHEN confidence >= 0.8 THEN 0.0 ELSE -confidence END, parser_ord, parser_type) AS r FROM u) WHERE r = 1")
def merge_fast_fail(spark, d):
    return merge.fast_fail(_parses(spark, d))


@query(
    "merge_confidence",
    _PARSES
    + ", k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY confidence DESC, parser_ord, parser_type) AS r FROM u), h AS (SELECT file_id, min_by(parser_type, r) AS base, string_agg(parser_type, '+' ORDER BY r) AS engines, count(*) AS parsers FROM k GROUP BY 1), e AS (SELECT file_id, parser_ord, unnest(list_distinct(missed_features)) AS feature FROM u), c AS (SELECT e.file_id, feature FROM e JOIN h USING (file_id) GROUP BY e.file_id, feature, parsers HAVING count(*) = parsers), m AS (SELECT file_id, count(*) AS missed FROM c GROUP BY 1) SELECT file_id, base, CASE WHEN parsers > 1 THEN 'merged:' || engines ELSE engines END AS engines, parsers, coalesce(missed, 0) AS missed FROM h LEFT JOIN m USING (file_id)",
)
def merge_confidence(spark, d):
    return merge.by_confidence(_parses(spark, d))


def _merged(spark, d, strategy):
    """The tables hold declarations by file, so that each usable parser of a file has them."""
    usable = merge.usable(_parses(spark, d)).select("file_id", "parser_ord", "parser_type", "confidence")
    return merge.merge_declarations(usable.join(merge.declarations(table(spark, d, "parsed_files")), "file_id"), strategy)


@query("merge_declarations_confidence")
def merge_declarations_confidence(spark, d):
    return _merged(spark, d, "confidence")


@query("merge_declarations_union")
def merge_declarations_union(spark, d):
    return _merged(spark, d, "union")


@query("merge_declarations_best_of_breed")
def merge_declarations_best_of_breed(spark, d):
    return _merged(spark, d, "best_of_breed")


# --------------------------------------------------------------------------------------------- trees, graph
def _states(spark, d, contents: bool = False):
    """Two states of the tree: the second lacks some files, has some under another name and some changed. By hash, unless contents are asked for."""
    changed = F.when(F.pmod("file_id", F.lit(11)) == 2, F.concat(F.coalesce("content", F.lit("")), F.lit("\n# changed"))).otherwise(F.col("content"))
    if contents:
        f = files.once(_files(spark, d), "path", F.col("content").alias("old"), changed.alias("new"))
    else:
        f = files.once(_files(spark, d), "path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("old"), F.sha2(F.coalesce(changed, F.lit("")), 256).alias("new"))
    name = "content" if contents else "hash"
    m = F.pmod(F.col("file_id"), F.lit(11))
    new = f.filter(m != 0).select(F.when(m == 1, F.concat("path", F.lit(".moved"))).otherwise(F.col("path")).alias("path"), F.col("new").alias(name))
    return f.select("path", F.col("old").alias(name)), new


_STATES = f"WITH {FILES}, o AS (SELECT path, sha256(coalesce(content, '')) AS oh FROM f), n AS (SELECT CASE WHEN file_id % 11 = 1 THEN path || '.moved' ELSE path END AS path, sha256(CASE WHEN file_id % 11 = 2 THEN coalesce(content, '') || chr(10) || '# changed' ELSE coalesce(content, '') END) AS nh FROM f WHERE file_id % 11 <> 0), j AS (SELECT coalesce(o.path, n.path) AS path, oh, nh FROM o FULL JOIN n ON o.path = n.path), a AS (SELECT nh AS h, path, row_number() OVER (PARTITION BY nh ORDER BY path) AS r FROM j WHERE oh IS NULL), g AS (SELECT oh AS h, path, row_number() OVER (PARTITION BY oh ORDER BY path) AS r FROM j WHERE nh IS NULL), c AS (SELECT path, 'modified' AS change, NULL AS old_path FROM j WHERE oh IS NOT NULL AND nh IS NOT NULL AND oh <> nh UNION ALL SELECT coalesce(a.path, g.path), CASE WHEN a.path IS NULL THEN 'deleted' WHEN g.path IS NULL THEN 'added' ELSE 'renamed' END, CASE WHEN a.path IS NOT NULL THEN g.path END FROM a FULL JOIN g ON a.h = g.h AND a.r = g.r)"


@query("snapshot_diff", _STATES + " SELECT * FROM c")
def snapshot_diff(spark, d):
    return diff.changes(*_states(spark, d))


@query("snapshot_diff_counts", _STATES + " SELECT change, count(*) AS files FROM c GROUP BY 1")
def snapshot_diff_counts(spark, d):
    return diff.change_counts(diff.changes(*_states(spark, d)))


@query("snapshot_patches")
def snapshot_patches(spark, d):
    return diff.patches(*_states(spark, d, contents=True))


@query("manifest_verify", _STATES + " SELECT path, CASE WHEN nh IS NULL THEN 'missing' WHEN oh IS NULL THEN 'unexpected' WHEN oh = nh THEN 'match' ELSE 'mismatch' END AS verdict FROM j")
def manifest_verify(spark, d):
    old, new = _states(spark, d)
    return diff.verify(old.select("path", F.upper("hash").alias("sha256")), new)


_EDGES = f"WITH {FILES}, e AS (SELECT DISTINCT repo, path, unnest(CASE regexp_extract(path, '\\.([^./]*)$', 1) " + " ".join(f"WHEN '{e}' THEN regexp_extract_all(content, '{_q(p)}', 1)" for e, p in graph.IMPORTS.items()) + " END) AS import FROM f)"


@query("import_edges", _EDGES + " SELECT repo, path, import FROM e")
def import_edges(spark, d):
    return graph.edges(_files(spark, d))


@query("imported_by", _EDGES + " SELECT import, count(*) AS files, count(DISTINCT repo) AS repos FROM e GROUP BY 1")
def imported_by(spark, d):
    return graph.imported_by(graph.edges(_files(spark, d)))


# ------------------------------------------------------------------------------------- usage, rates, generic
@query("model_usage", "WITH s AS (SELECT DISTINCT summary_id, model_used, tokens_used, cost_estimate, cached FROM summaries) SELECT model_used, count(*) AS calls, sum(tokens_used)::BIGINT AS tokens, round(avg(tokens_used), 4) AS mean_tokens, round(sum(cost_estimate), 4) AS cost, count(*) FILTER (cached) AS cached FROM s GROUP BY ROLLUP (model_used)")
def model_usage(spark, d):
    s = table(spark, d, "summaries").select("summary_id", "model_used", "tokens_used", "cost_estimate", "cached").distinct()
    return s.rollup("model_used").agg(F.count("*").alias("calls"), F.sum("tokens_used").alias("tokens"), F.round(F.avg("tokens_used"), 4).alias("mean_tokens"), F.round(F.sum("cost_estimate"), 4).alias("cost"), F.count_if(F.col("cached")).alias("cached"))


@query("cheapest_model", "WITH s AS (SELECT DISTINCT summary_id, provider, model_used, tokens_used, cost_estimate FROM summaries WHERE tokens_used > 0), m AS (SELECT provider, model_used, round(sum(cost_estimate) / sum(tokens_used), 9) AS unit FROM s GROUP BY 1, 2) SELECT provider, arg_min(model_used, (unit, model_used)) AS model_used FROM m WHERE unit IS NOT NULL GROUP BY 1")
def cheapest_model(spark, d):
    s = table(spark, d, "summaries").filter("tokens_used > 0").select("summary_id", "provider", "model_used", "tokens_used", "cost_estimate").distinct()
    m = s.groupBy("provider", "model_used").agg(F.round(F.sum("cost_estimate") / F.sum("tokens_used"), 9).alias("unit")).filter("unit is not null")
    return m.groupBy("provider").agg(F.min_by("model_used", F.struct("unit", "model_used")).alias("model_used"))


@query("summary_cache_misses", f"WITH {FILES} SELECT file_id FROM f WHERE content IS NOT NULL AND file_id NOT IN (SELECT file_id FROM summaries WHERE error IS NULL AND file_id IS NOT NULL)")
def summary_cache_misses(spark, d):
    done = table(spark, d, "summaries").filter("error is null")
    return files.once(_files(spark, d), F.col("content").isNotNull().alias("read")).filter("read").join(done, "file_id", "left_anti").select("file_id")


@query("rate_limit", "SELECT event_id, c AS in_window, c <= 3 AS allowed FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS c FROM events)")
def rate_limit(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    e = table(spark, d, "events").withColumn("in_window", F.count("*").over(w))
    return e.select("event_id", "in_window", (F.col("in_window") <= 3).alias("allowed"))


_FEATURES = {"arrow": r"=>", "async": r"\basync\b", "await": r"\bawait\b", "optional_chain": r"\?\.", "nullish": r"\?\?", "template": r"`[^`]*\$\{", "match": r"(?m)^\s*match\s", "walrus": r":=", "lambda": r"\blambda\b", "generics": r"\w<\w+>"}


@query("modern_syntax", f"WITH {FILES} SELECT {LANG} AS language, " + ", ".join(f"sum(len(regexp_extract_all(coalesce(content, ''), '{p}')))::BIGINT AS {k}" for k, p in _FEATURES.items()) + " FROM f GROUP BY 1")
def modern_syntax(spark, d):
    per = files.once(_files(spark, d), "path", *(F.regexp_count(F.coalesce("content", F.lit("")), F.lit(p)).alias(k) for k, p in _FEATURES.items()))
    return per.groupBy(files.language_by_extension("path").alias("language")).agg(*(F.sum(k).alias(k) for k in _FEATURES))


@query("statement_classes", LINES + """, q AS (SELECT lower(regexp_extract(line, '["'']\\s*(SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)\\b', 1)) AS verb FROM l) SELECT CASE WHEN verb IN ('select', 'insert', 'update', 'delete') THEN 'DML' ELSE 'DDL' END AS class, verb, count(*) AS statements FROM q WHERE verb <> '' GROUP BY 1, 2""")
def statement_classes(spark, d):
    verbs = F.transform(T.lines("content"), lambda x: F.lower(F.regexp_extract(x, r"[\"']\s*(SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP)\b", 1)))
    return files.once(_files(spark, d), F.filter(verbs, lambda x: x != "").alias("verbs")).select(F.explode("verbs").alias("verb")).groupBy(F.when(F.col("verb").isin("select", "insert", "update", "delete"), "DML").otherwise("DDL").alias("class"), "verb").agg(F.count("*").alias("statements"))


@query("language_votes", f"WITH {FILES} SELECT file_id, " + ", ".join(f"regexp_matches(coalesce(content, ''), '{p}')::INT AS {k}" for k, p in {"postgres": r"(?i)\bRETURNING\b|::\w+", "mysql": r"(?i)AUTO_INCREMENT|ENGINE\s*=", "sqlite": r"(?i)AUTOINCREMENT|PRAGMA"}.items()) + " FROM f")
def language_votes(spark, d):
    c = F.coalesce("content", F.lit(""))
    return files.once(_files(spark, d), *(c.rlike(p).cast("int").alias(k) for k, p in {"postgres": r"(?i)\bRETURNING\b|::\w+", "mysql": r"(?i)AUTO_INCREMENT|ENGINE\s*=", "sqlite": r"(?i)AUTOINCREMENT|PRAGMA"}.items()))


@query("largest_orders", "SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def largest_orders(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").withColumn("r", F.row_number().over(w)).filter("r <= 3").select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("price"))


# -------------------------------------------------------------- what SQL cannot express: tested on small fixtures
@query("declarations")
def declarations(spark, d):
    return parse.declarations(_files(spark, d))


@query("declarations_by_kind")
def declarations_by_kind(spark, d):
    return parse.by_kind(parse.declarations(_files(spark, d)))


@query("parser_chain")
def parser_chain(spark, d):
    """What each parser of the chain found over the whole corpus."""
    return parse.compared(parse.parses(_files(spark, d)))


@query("declaration_nesting")
def declaration_nesting(spark, d):
    return parse.nesting(parse.declarations(_files(spark, d)))


@query("annotations")
def annotations(spark, d):
    return parse.annotations(parse.declarations(_files(spark, d)))


@query("longest_functions")
def longest_functions(spark, d):
    return parse.longest(parse.declarations(_files(spark, d)))


@query("content_cleaned")
def content_cleaned(spark, d):
    language = files.language_by_extension("path")
    return files.once(_files(spark, d), content.drop_blank_lines(content.remove_comments(content.remove_docs(content.normalise("content"), language), language)).alias("content"))


@query("rendered_markdown")
def rendered_markdown(spark, d):
    return pipeline.run(_files(spark, d), pipeline.Spec.of("lean"))


@query("document_markdown")
def document_markdown(spark, d):
    return render.document(_files(spark, d), "markdown")


@query("document_json")
def document_json(spark, d):
    return render.document(scan.masked(_files(spark, d), hide=False), "json", listed=_files(spark, d))


@query("rendered_xml")
def rendered_xml(spark, d):
    return render.chunks(_files(spark, d), "xml")


@query("rendered_json_roundtrip", f"WITH {FILES} SELECT path, coalesce(content, '') AS content FROM f")
def rendered_json_roundtrip(spark, d):
    return render.reconstruct(render.chunks(_files(spark, d), "json").select(F.col("chunk").alias("document")), "json").select("path", "content")


@query("rendered_markdown_roundtrip", f"WITH {FILES} SELECT path, sha256(coalesce(content, '')) AS h FROM f")
def rendered_markdown_roundtrip(spark, d):
    return render.reconstruct(render.chunks(_files(spark, d), "markdown").select(F.col("chunk").alias("document")), "markdown").select("path", F.sha2("content", 256).alias("h"))


@query("summaries_due", f"WITH {FILES} SELECT file_id FROM f WHERE {LINE_COUNT} >= 20 AND {LANG} IN ('python', 'java', 'go') AND NOT regexp_matches(path, '^(?:.*/)?tests/.*(?:/.*)?$') AND file_id NOT IN (SELECT file_id FROM summaries WHERE error IS NULL AND file_id IS NOT NULL)")
def summaries_due(spark, d):
    done = table(spark, d, "summaries").filter("error is null").select("file_id").distinct()
    return summarize.due(_files(spark, d), done, languages=("python", "java", "go"), excludes=("tests/",))


_ATTACKS = " UNION ALL ".join(f"SELECT '{r.name}' AS rule, len(regexp_extract_all(content, '{_q(r.regex)}')) AS n FROM f WHERE content IS NOT NULL" + ("" if r.languages == ("all",) else f" AND {LANG} IN (" + ", ".join(f"'{x}'" for x in r.languages) + ")") for r in ATTACK_RULES)


@query("attack_counts", f"WITH {FILES}, a AS ({_ATTACKS}) SELECT rule, count(*) AS files, sum(n)::BIGINT AS matches FROM a WHERE n > 0 GROUP BY 1")
def attack_counts(spark, d):
    return scan.attack_counts(_files(spark, d))


@query("attack_scan")
def attack_scan(spark, d):
    return scan.attacks(_files(spark, d))


@query("document_attacks", "WITH a AS (" + " UNION ALL ".join(f"SELECT doc_id, '{r.name}' AS rule, len(regexp_extract_all(text, '{_q(r.regex)}'))::BIGINT AS matches FROM documents WHERE text IS NOT NULL" for r in ATTACK_RULES if r.languages == ("all",)) + ") SELECT * FROM a WHERE matches > 0")
def document_attacks(spark, d):
    rules = [r for r in ATTACK_RULES if r.languages == ("all",)]
    text = F.coalesce("text", F.lit(""))
    each = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.regexp_count(text, F.lit(r.regex)).cast("bigint").alias("matches")) for r in rules)))
    return table(spark, d, "documents").select("doc_id", each.alias("r")).filter("r.matches > 0").select("doc_id", "r.rule", "r.matches")
