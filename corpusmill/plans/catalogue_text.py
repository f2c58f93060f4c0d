"""Queries over paths, texts and findings that SQL can ask in its own words; no constant is shared with the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import describe, validate
from corpusmill.functions import rules as R
from corpusmill.functions import text as T
from corpusmill.operators import compress, content, diff, files, graph, merge, nested, render, scan, summarize
from corpusmill.plans.catalogue import BYTES, EXT, FILES, LANG, LINE_COUNT, LINES, TOKENS, _files, _PARTS, _RAW_SCAN, _SCAN, _scored, _states, _STATES, _TAGS
from corpusmill.plans.registry import _NODES, query
from corpusmill.session import table
from corpusmill.sources import git, trees

NAME = "regexp_extract(path, '([^/]*)$', 1)"


# ------------------------------------------------------------------------------------------ paths and languages
@query("pruned_paths", f"WITH {FILES} SELECT file_id, len(list_filter(string_split(path, '/')[:-2], lambda d: d IN ('__pycache__', '.git', 'node_modules', '.pytest_cache', 'build', 'dist', '.idea', '.vscode', 'venv', '.venv', 'env', 'site-packages', 'libs', 'vendor', 'third_party') OR starts_with(d, '.') OR contains(lower(d), 'env'))) > 0 AS pruned FROM f")
def pruned_paths(spark, d):
    return files.once(_files(spark, d), files.pruned_directory("path").alias("pruned"))


@query("pruned_directories", f"WITH {FILES}, a AS (SELECT DISTINCT array_to_string(string_split(path, '/')[:k], '/') AS directory FROM (SELECT path, unnest(generate_series(1, len(string_split(path, '/')) - 1)) AS k FROM f)) SELECT directory FROM a WHERE regexp_matches(directory, '(?:^|/)(?:vendor|third_party|build|dist|libs)(?:/|$)') OR regexp_matches(directory, '(?:^|/)(?:\\.[^/]*|[^/]*[eE][nN][vV][^/]*|node_modules|__pycache__|site-packages)(?:/|$)')")
def pruned_directories(spark, d):
    """All directories less those that a walk keeps."""
    parts = F.split("path", "/")
    every = files.once(_files(spark, d), "path").filter(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("directory")).distinct()
    return every.exceptAll(every.filter(~files.pruned_directory(F.concat("directory", F.lit("/x")))))


@query("exclusion_specs", f"WITH {FILES}, e AS (SELECT file_id, path, regexp_matches(path, '(?:^|/)(?:[^/]*\\.log|build|dist|node_modules|__pycache__)(?:/|$)') OR regexp_matches(path, '\\.ya?ml$') AS ignored, regexp_matches(path, '(?:^|/)third_party/') OR regexp_matches(path, '(?:^|/)src/.*\\.min\\.js$') AS excluded, regexp_matches(path, '(?:^|/)src/') OR regexp_matches(path, '\\.(?:py|go|json)$') AS included FROM f) SELECT file_id, ignored, excluded, included, ignored OR excluded OR NOT included AS left_out FROM e")
def exclusion_specs(spark, d):
    ignored = trees.ignored("path", "*.log\n*.yml\n*.yaml\n")
    excluded, included = files.matches_any("path", ("**/third_party/**", "**/src/**/*.min.js")), files.matches_any("path", ("**/src/**", "*.py", "*.go", "*.json"))
    return files.once(_files(spark, d), ignored.alias("ignored"), excluded.alias("excluded"), included.alias("included"), (ignored | excluded | ~included).alias("left_out"))


@query("include_decision", f"WITH {FILES}, s AS (SELECT file_id, CASE WHEN regexp_matches(path, '(?:^|/)(?:build|dist|node_modules)(?:/|$)') OR regexp_matches(path, '\\.lock$') THEN 'ignored' WHEN NOT (regexp_matches(path, '(?:^|/)src/') OR regexp_matches(path, '\\.py$')) THEN 'not_included' WHEN regexp_matches(lower(path), '\\.(md|rst|txt)$') THEN 'documentation' WHEN lower({NAME}) IN ('makefile', 'dockerfile', 'jenkinsfile', 'vagrantfile') THEN 'special_file' WHEN {LANG} IS NULL THEN 'unknown_language' WHEN {LANG} NOT IN ('python', 'go', 'java') THEN 'excluded_language' WHEN regexp_matches(lower(path), 'lock\\.json|package-lock|\\.min\\.js|\\.bundle\\.js|vendor\\.js|polyfill|compiled|generated|build/|dist/') THEN 'binary' WHEN content IS NULL THEN 'unreadable' WHEN contains(content, chr(0)) THEN 'binary_content' END AS reason FROM f) SELECT reason, count(*) AS files FROM s GROUP BY 1")
def include_decision(spark, d):
    reason = files.skip_reason("path", "content", ignore="*.lock\n", includes=("**/src/**", "*.py"), include_languages=("python", "go", "java"))
    return files.once(_files(spark, d), reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("files"))


@query("skip_totals", f"WITH {FILES}, s AS (SELECT CASE WHEN regexp_matches(lower(path), '\\.(md|rst|txt)$') THEN 'documentation' WHEN {LANG} = 'ruby' THEN 'excluded_language' WHEN regexp_matches(lower(path), 'lock\\.json|package-lock|yarn\\.lock|pnpm-lock|\\.min\\.js|\\.bundle\\.js|vendor\\.js|polyfill|compiled|generated|build/|dist/') THEN 'binary' WHEN content IS NULL THEN 'unreadable' WHEN contains(content, chr(0)) THEN 'binary_content' END AS reason FROM f), t AS (SELECT count(*) AS n FROM s) SELECT reason, count(*) AS files, round(count(*) / any_value(n), 6) AS share FROM s, t WHERE reason IS NOT NULL GROUP BY ROLLUP (reason)")
def skip_totals(spark, d):
    return files.skip_totals(_files(spark, d), exclude_languages=("ruby",))


@query("custom_languages", f"WITH {FILES} SELECT file_id, CASE WHEN {EXT} IN ('yml', 'yaml') THEN 'pipeline' ELSE coalesce({LANG}, 'unknown') END AS language FROM f")
def custom_languages(spark, d):
    return files.once(_files(spark, d), F.coalesce(files.language_by_extension("path", {".yml": "pipeline", ".yaml": "pipeline"}), F.lit("unknown")).alias("language"))


@query("content_languages", f"WITH {FILES} SELECT file_id, CASE WHEN regexp_matches(content, '^#!.*\\bpython') OR regexp_matches(content, '(?m)^(?:def|class) \\w+.*:\\s*$') OR regexp_matches(content, '(?m)^from [\\w.]+ import ') THEN 'python' WHEN regexp_matches(content, '^#!.*\\b(?:bash|sh|zsh)\\b') THEN 'bash' WHEN regexp_matches(content, '^#!.*\\bruby') OR regexp_matches(content, '(?m)^require [''\"]') THEN 'ruby' WHEN regexp_matches(content, '^#!.*\\bnode') OR regexp_matches(content, '(?m)^(?:const|let|var) \\w+ = ') OR regexp_matches(content, '(?m)^module\\.exports\\b') THEN 'javascript' WHEN regexp_matches(content, '^<\\?php') THEN 'php' WHEN regexp_matches(content, '^<\\?xml') THEN 'xml' WHEN regexp_matches(content, '(?i)^\\s*<!doctype html|^\\s*<html') THEN 'html' WHEN regexp_matches(content, '(?m)^package \\w+$') THEN 'go' WHEN regexp_matches(content, '(?m)^package [\\w.]+;') OR regexp_matches(content, '(?m)^import [\\w.]+;') THEN 'java' WHEN regexp_matches(content, '(?m)^use [\\w:]+;') OR regexp_matches(content, '(?m)^(?:pub )?fn \\w+') THEN 'rust' WHEN regexp_matches(content, '(?m)^#include [<\"]') THEN 'c' WHEN regexp_matches(content, '^\\s*[{{\\[]\\s*[\"{{\\[]') THEN 'config' END AS language FROM f WHERE content IS NOT NULL")
def content_languages(spark, d):
    return files.once(_files(spark, d).filter("content is not null"), files.language_by_content("content").alias("language"))


@query("allowed_languages", "SELECT file_id, coalesce(lower(language) IN ('python', 'javascript', 'typescript', 'java', 'cpp', 'c', 'csharp', 'go', 'rust', 'php', 'ruby', 'swift', 'kotlin', 'scala', 'r', 'bash', 'shell', 'julia', 'perl', 'powershell', 'sql', 'graphql', 'solidity', 'html', 'css', 'xml', 'yaml', 'json', 'toml', 'ini', 'markdown', 'rst', 'tex', 'documentation', 'config', 'unknown', 'glsl', 'hlsl', 'metal', 'wat', 'wasm'), false) AS allowed FROM (SELECT DISTINCT ON (file_id) * FROM parsed_files ORDER BY file_id, ingested_at DESC NULLS LAST, collected_at DESC NULLS LAST)")
def allowed_languages(spark, d):
    return files.once(files.delivered(table(spark, d, "parsed_files")), validate.language_allowed("language").alias("allowed"))


@query("binary_contents", f"WITH {FILES}, h AS (SELECT file_id, content, left(hex(encode(content)), 8192) AS x FROM f WHERE content IS NOT NULL) SELECT file_id, regexp_matches(x, '^(?:..)*?00') OR length(regexp_replace(x, '([0-7].)|([89A-F].)', '\\2', 'g')) / 2 > 0.3 * (length(x) / 2) AS by_share, regexp_matches(left(hex(encode(content)), 16384), '^(?:..)*?00') AS by_control FROM h")
def binary_contents(spark, d):
    c = _files(spark, d).filter("content is not null")
    return files.once(c, validate.binary_by_share("content").alias("by_share"), validate.binary_by_control("content").alias("by_control"))


@query("signature_verdicts", f"WITH {FILES}, b AS (SELECT file_id, path, contains(left(content, 8192), chr(0)) AS b FROM f WHERE content IS NOT NULL) SELECT file_id, CASE WHEN b AND regexp_matches(lower(path), '\\.(py|js|ts|html|css|json|xml|md)$') THEN 'mismatch' WHEN b THEN 'binary' ELSE 'text' END AS verdict FROM b")
def signature_verdicts(spark, d):
    return files.once(_files(spark, d).filter("content is not null"), validate.signature_verdict("path", "content").alias("verdict"))


@query("input_status", f"WITH {FILES} SELECT file_id, CASE WHEN regexp_matches(path, '(?:^|/)\\.\\.(?:/|$)') THEN 'unsafe_path' WHEN NOT starts_with(path, 'korvane/') THEN 'outside_base' WHEN NOT regexp_matches(lower(path), '\\.(py|go|json)$') THEN 'bad_ending' WHEN content IS NULL THEN 'missing' WHEN {BYTES} > 9000 THEN 'too_large' ELSE 'ok' END AS status FROM f")
def input_status(spark, d):
    return files.once(_files(spark, d), validate.input_status("path", "content", "korvane", 9000, (".py", ".go", ".json")).alias("status"))


@query("safe_paths", f"WITH {FILES}, p AS (SELECT file_id, CASE file_id % 5 WHEN 0 THEN '../' || path WHEN 1 THEN '/' || path WHEN 2 THEN replace(path, '/', '%2f') WHEN 3 THEN 'a/%2e%2e/' || path ELSE path END AS p, path FROM f) SELECT file_id, CASE WHEN file_id % 5 IN (0, 3) THEN NULL ELSE path END AS safe FROM p")
def safe_paths(spark, d):
    """Paths that stay inside their root, of paths that were tampered with."""
    m = F.pmod("file_id", F.lit(5))
    given = F.when(m == 0, F.concat(F.lit("../"), "path")).when(m == 1, F.concat(F.lit("/"), "path")).when(m == 2, F.replace("path", F.lit("/"), F.lit("%2f"))).when(m == 3, F.concat(F.lit("a/%2e%2e/"), "path")).otherwise(F.col("path"))
    return files.once(_files(spark, d), "path").select("file_id", render.safe_paths(given).alias("safe"))


@query("preview_files", f"WITH {FILES} SELECT path, length(content) AS characters FROM f ORDER BY path LIMIT 10")
def preview_files(spark, d):
    return files.once(_files(spark, d), "path", F.length("content").cast("bigint").alias("characters")).select("path", "characters").orderBy("path").limit(10)


@query("index_with_issues", f"WITH {FILES} SELECT DISTINCT path FROM f WHERE file_id IN (SELECT file_id FROM security_issues)")
def index_with_issues(spark, d):
    return files.once(_files(spark, d), "path").join(table(spark, d, "security_issues").select("file_id").distinct(), "file_id", "left_semi").select("path").distinct()


@query("index_with_declarations", _NODES + ", g AS (SELECT DISTINCT ON (file_id) file_id, repo || '/' || file_path AS path FROM parsed_files ORDER BY file_id) SELECT DISTINCT path FROM g WHERE file_id IN (SELECT file_id FROM n)")
def index_with_declarations(spark, d):
    some = nested.found(table(spark, d, "parsed_files")).filter("node_kind = 'declaration'").select("file_id").distinct()
    return files.once(_files(spark, d), "path").join(some, "file_id", "left_semi").select("path").distinct()


@query("members_by_category", f"WITH {FILES}, c AS (SELECT path, CASE WHEN contains(lower(path), 'test') OR contains(lower(path), 'spec') THEN 'test' WHEN regexp_matches(lower(path), '\\.(md|rst|txt)$') THEN 'documentation' WHEN regexp_matches(lower(path), '\\.(json|yml|yaml|toml|ini)$') THEN 'configuration' WHEN regexp_matches(lower(path), '\\.(py|js|ts|java|cpp|go)$') THEN 'source' ELSE 'other' END AS k FROM f) SELECT k, path, row_number() OVER (PARTITION BY k ORDER BY path) AS n FROM c")
def members_by_category(spark, d):
    return files.members_by(_files(spark, d), T.category("path"))


@query("items_with_documents", f"WITH {FILES} SELECT 'code' AS kind, count(*) AS items, count(path) AS with_path FROM f UNION ALL SELECT 'document', count(*), count(file_path) FROM documents")
def items_with_documents(spark, d):
    code = files.once(_files(spark, d), "path").select(F.lit("code").alias("kind"), "path")
    docs = table(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("file_path").alias("path"), F.col("domain").alias("doc_type"))
    return code.unionByName(docs, allowMissingColumns=True).groupBy("kind").agg(F.count("*").alias("items"), F.count("path").alias("with_path"))


@query("document_sources", "SELECT doc_id AS file_id, lower(regexp_extract(file_path, '\\.([^./]*)$', 1)) AS doc_type FROM documents WHERE regexp_matches(lower(file_path), '\\.(md|rst|txt)$')")
def document_sources(spark, d):
    given = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("source").alias("repo"), F.col("file_path").alias("path"), F.col("text").alias("content"))
    return trees.documents(given).select("file_id", "doc_type")


@query("drawn_tree", f"WITH {FILES}, p AS (SELECT string_split(path, '/') AS parts FROM f), n AS (SELECT DISTINCT array_to_string(parts[1:k], '/') AS node, k AS depth FROM (SELECT parts, unnest(generate_series(1, len(parts))) AS k FROM p)), q AS (SELECT *, CASE WHEN depth = 1 THEN '' ELSE regexp_extract(node, '^(.*)/[^/]*$', 1) END AS parent FROM n), w AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY node DESC) = 1 AS last FROM q), a AS (SELECT w.node, u.depth, u.last FROM w JOIN w u ON u.node = w.node OR starts_with(w.node, u.node || '/')), m AS (SELECT node, list(last ORDER BY depth) AS marks FROM a GROUP BY 1) SELECT node, array_to_string(list_transform(marks[:-2], lambda x: CASE WHEN x THEN '    ' ELSE '│   ' END), '') || CASE WHEN marks[-1] THEN '└── ' ELSE '├── ' END || regexp_extract(node, '([^/]*)$', 1) AS line FROM m")
def drawn_tree(spark, d):
    return files.drawn_tree(files.once(_files(spark, d), "path"))


@query("run_stats", f"WITH {FILES} SELECT (SELECT count(*) FROM parsed_files) AS scanned, (SELECT count(*) FROM f WHERE content IS NOT NULL) AS parsed, (SELECT count(*) FROM documents) AS documents, count(DISTINCT {LANG}) AS languages, sum({LINE_COUNT})::BIGINT AS lines, sum({BYTES})::BIGINT AS bytes FROM f")
def run_stats(spark, d):
    per = files.once(_files(spark, d), "path", F.col("content").isNotNull().alias("read"), T.line_count("content").alias("lines"), F.octet_length(F.coalesce("content", F.lit(""))).cast("bigint").alias("bytes"))
    a = per.agg(F.count_if("read").alias("parsed"), F.countDistinct(files.language_by_extension("path")).alias("languages"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))
    b = table(spark, d, "parsed_files").agg(F.count("*").alias("scanned")).join(F.broadcast(table(spark, d, "documents").agg(F.count("*").alias("documents"))))
    return a.join(F.broadcast(b)).select("scanned", "parsed", "documents", "languages", "lines", "bytes")


@query("preamble_types", f"WITH {FILES} SELECT CASE WHEN contains({NAME}, '.') THEN regexp_extract(path, '\\.([^./]*)$', 1) ELSE 'unknown' END AS ending, count(*) AS files, count(*) FILTER ({NAME} IN ('main.py', '__main__.py', 'app.py', 'server.py', 'manage.py', 'index.js', 'server.js', 'app.js', 'index.ts', 'server.ts', 'app.ts')) AS entry_points FROM f GROUP BY 1")
def preamble_types(spark, d):
    """Files by ending and the likely entry points among them."""
    per = files.once(_files(spark, d), "path")
    name = T.filename("path")
    ending = F.when(name.contains("."), F.regexp_extract("path", r"\.([^./]*)$", 1)).otherwise("unknown")
    entry = name.isin("main.py", "__main__.py", "app.py", "server.py", "manage.py", "index.js", "server.js", "app.js", "index.ts", "server.ts", "app.ts")
    return per.groupBy(ending.alias("ending")).agg(F.count("*").alias("files"), F.count_if(entry).alias("entry_points"))


@query("function_lengths", _NODES + " SELECT count(*) AS functions, round(avg((x->>'$.end_line')::BIGINT - (x->>'$.start_line')::BIGINT + 1), 1) AS mean_lines FROM n WHERE x->>'$.kind' = 'function'")
def function_lengths(spark, d):
    f = nested.related(table(spark, d, "parsed_files"), "file_id")["declaration"].filter("kind = 'function'")
    return f.agg(F.count("*").alias("functions"), F.round(F.avg(F.col("end_line") - F.col("start_line") + 1), 1).alias("mean_lines"))


@query("declared_names_by_kind", _NODES + " SELECT file_id, x->>'$.kind' AS kind, count(*) AS n, min(x->>'$.name') AS first_name, max(x->>'$.name') AS last_name FROM n GROUP BY 1, 2")
def declared_names_by_kind(spark, d):
    t = nested.related(table(spark, d, "parsed_files"), "file_id")["declaration"].select(F.col("record_id").alias("file_id"), "kind", "name")
    from corpusmill.operators import parse

    named = parse.names_by_kind(t.filter("name is not null"))
    return named.select("file_id", "kind", F.size("names").cast("bigint").alias("n"), F.element_at("names", 1).alias("first_name"), F.element_at("names", -1).alias("last_name"))


@query("canonical_kinds", _NODES + " SELECT CASE x->>'$.kind' WHEN 'func' THEN 'function' WHEN 'fn' THEN 'function' WHEN 'trait' THEN 'interface' WHEN 'protocol' THEN 'interface' WHEN 'namespace' THEN 'module' WHEN 'mod' THEN 'module' WHEN 'package' THEN 'module' WHEN 'constructor' THEN 'method' WHEN 'object' THEN 'class' WHEN 'record' THEN 'class' WHEN 'union' THEN 'struct' WHEN 'const' THEN 'constant' WHEN 'field' THEN 'property' ELSE x->>'$.kind' END AS kind, count(*) AS declarations FROM n WHERE x->>'$.kind' IS NOT NULL GROUP BY 1")
def canonical_kinds(spark, d):
    from corpusmill.functions import docs

    t = nested.related(table(spark, d, "parsed_files"), "file_id")["declaration"].filter("kind is not null")
    pairs = [F.lit(x) for kv in docs.KINDS.items() for x in kv]
    low = F.lower(F.trim("kind"))
    return t.groupBy(F.coalesce(F.create_map(*pairs)[low], low).alias("kind")).agg(F.count("*").alias("declarations"))


@query("parser_comparison", "WITH p AS (SELECT DISTINCT ON (file_id, parser_ord, parser_type) * FROM parse_results ORDER BY file_id, parser_ord, parser_type, parsed_at DESC NULLS LAST) SELECT parser_type, count(*) AS files, count(*) FILTER (coalesce(error, '') <> '') AS errors, count(*) FILTER (degraded) AS degraded, round(avg(len(coalesce(missed_features, []))), 6) AS mean_missed FROM p GROUP BY 1")
def parser_comparison(spark, d):
    latest = table(spark, d, "parse_results").groupBy("file_id", "parser_ord", "parser_type").agg(F.max_by(F.struct("error", "degraded", "missed_features"), F.col("parsed_at").cast("timestamp")).alias("x"))
    missed = F.size(F.coalesce("x.missed_features", F.array().cast("array<string>")))
    return latest.groupBy("parser_type").agg(F.count("*").alias("files"), F.count_if(F.coalesce("x.error", F.lit("")) != "").alias("errors"), F.count_if("x.degraded").alias("degraded"), F.round(F.avg(missed), 6).alias("mean_missed"))


@query("operation_stats", "SELECT event_type, count(*) AS operations, round(avg(value), 6) AS mean, count(*) FILTER (value > 90) AS slow FROM events GROUP BY 1")
def operation_stats(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("operations"), F.round(F.avg("value"), 6).alias("mean"), F.count_if(F.col("value") > 90).alias("slow"))


# ------------------------------------------------------------------------------------------------------- texts
@query("contents_normalised", f"WITH {FILES} SELECT file_id, sha256(replace(array_to_string(list_transform(string_split(regexp_replace(replace(replace(CASE WHEN starts_with(content, chr(65279)) THEN substr(content, 2) ELSE content END, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\\x{{200b}}\\x{{200c}}\\x{{200d}}\\x{{2060}}\\x{{feff}}]', '', 'g'), chr(0)), lambda x: nfc_normalize(x)), chr(0)), chr(160), ' ')) AS h FROM f WHERE content IS NOT NULL")
def contents_normalised(spark, d):
    return files.once(_files(spark, d).filter("content is not null"), F.sha2(content.normalise("content"), 256).alias("h"))


@query("blank_lines_dropped", f"WITH {FILES} SELECT file_id, sha256(array_to_string(list_filter(string_split(content, chr(10)), lambda x: trim(x, ' ') <> ''), chr(10))) AS h FROM f WHERE content IS NOT NULL")
def blank_lines_dropped(spark, d):
    return files.once(_files(spark, d).filter("content is not null"), F.sha2(content.drop_blank_lines("content"), 256).alias("h"))


@query("lines_numbered", f"WITH {FILES} SELECT file_id, sha256(array_to_string(list_transform(string_split(content, chr(10)), lambda x, i: printf('%4d | ', i) || x), chr(10))) AS h FROM f WHERE content IS NOT NULL")
def lines_numbered(spark, d):
    return files.once(_files(spark, d).filter("content is not null"), F.sha2(render.numbered_lines("content"), 256).alias("h"))


@query("contents_redacted", f"""WITH {FILES} SELECT file_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '\\b(exec|eval|system|popen|subprocess\\.call|subprocess\\.Popen|os\\.system|child_process\\.exec|require\\(\\s*[\"'']child_process[\"'']\\)|Runtime\\.exec|Process\\.start|os\\.popen|ShellExecute|WScript\\.Shell)\\b', 'X', 'g'), '(?i)(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)\\s+.*?(FROM|INTO|TABLE|DATABASE)\\s+', 'X', 'g'), '\\.\\./|\\.\\\\|\\x00|/etc/passwd', 'X', 'g'), '\\{{\\{{.+?\\}}\\}}|\\$\\{{.+?\\}}|<%= .+? %>', 'X', 'g'), '(?i)(password|passwd|pwd|secret|api[-_]?key|access[-_]?key|auth[-_]?token|credential|secret[-_]?key|private[-_]?key)(\\s*[:=])\\s*[''\"][^''\"]{{8,}}[''\"]', '\\1\\2 "[REDACTED]"', 'g'), '[A-Za-z0-9+/]{{40,}}={{0,2}}', 'X', 'g')) AS h FROM f WHERE content IS NOT NULL""")
def contents_redacted(spark, d):
    """Dangerous content removed; its mark is shortened so that both sides can be compared by hash."""
    return files.once(_files(spark, d).filter("content is not null"), F.sha2(scan.redacted("content", "X"), 256).alias("h"))


@query("fences_escaped", f"WITH {FILES} SELECT file_id, sha256(replace(content, '```', '`' || chr(8203) || '`' || chr(8203) || '`')) AS h FROM f WHERE content IS NOT NULL")
def fences_escaped(spark, d):
    return files.once(_files(spark, d).filter("content is not null"), F.sha2(describe.escaped_fences("content"), 256).alias("h"))


@query("file_prompts", f"WITH {FILES} SELECT file_id, sha256('Summarise this ' || coalesce({LANG}, '') || ' file (' || path || ') in two sentences.' || chr(10) || '```' || chr(10) || replace(coalesce(content, ''), '```', '`' || chr(8203) || '`' || chr(8203) || '`') || chr(10) || '```' || chr(10)) AS h FROM f")
def file_prompts(spark, d):
    made = describe.prompt(describe.PROMPTS["file"], LANGUAGE=files.language_by_extension("path"), PATH="path", CODE="content")
    return files.once(_files(spark, d), F.sha2(made, 256).alias("h"))


@query("file_texts", f"WITH {FILES}, g AS (SELECT DISTINCT ON (file_id) file_id, token_stats FROM parsed_files ORDER BY file_id, ingested_at DESC NULLS LAST, collected_at DESC NULLS LAST) SELECT file_id, '**File:** `' || {NAME} || '`' || chr(10) || '**Language:** `' || coalesce({LANG}, 'unknown') || '`' || CASE WHEN token_stats.gpt4_tokens IS NOT NULL THEN chr(10) || '**Token Counts:**' || chr(10) || 'GPT-4: `' || token_stats.gpt4_tokens || '`' ELSE '' END AS text FROM f JOIN g USING (file_id)")
def file_texts(spark, d):
    text = describe.file_text(T.filename("file_path"), files.language_by_extension("file_path"), tokens=F.col("token_stats.gpt4_tokens"))
    return files.once(files.delivered(table(spark, d, "parsed_files")), text.alias("text"))


@query("statement_kinds", "SELECT doc_id, CASE regexp_extract(lower(coalesce(text, '')), '^\\s*(\\S+)', 1) WHEN 'create' THEN 'DDL' WHEN 'alter' THEN 'DDL' WHEN 'drop' THEN 'DDL' WHEN 'truncate' THEN 'DDL' WHEN 'rename' THEN 'DDL' WHEN 'select' THEN 'DML' WHEN 'insert' THEN 'DML' WHEN 'update' THEN 'DML' WHEN 'delete' THEN 'DML' WHEN 'merge' THEN 'DML' WHEN 'with' THEN 'DML' ELSE 'UNKNOWN' END AS class FROM documents")
def statement_kinds(spark, d):
    return table(spark, d, "documents").select("doc_id", describe.statement_class("text").alias("class"))


_VOTE = {"m": ("`[a-zA-Z_]", "\\bauto_increment\\b", "\\bengine\\s*=", "\\bcharset\\s*=", "\\bcollate\\s*="), "p": ("\\bserial\\b", "\\bbigserial\\b", "\\bplpgsql\\b", "\\b\\$\\$", "\\breturning\\b", "::"), "s": ("\\bautoincrement\\b", "\\bwithout\\s+rowid\\b")}


@query("dialect_votes", f"WITH {FILES}, v AS (SELECT file_id, " + ", ".join("(" + " + ".join(f"regexp_matches(lower(coalesce(content, '')), '{x}')::INT" for x in xs) + f") AS {k}" for k, xs in _VOTE.items()) + " FROM f) SELECT file_id, m AS mysql, p AS postgresql, s AS sqlite, CASE WHEN m > p AND m > s THEN 'mysql' WHEN s > p AND s > m THEN 'sqlite' ELSE 'postgresql' END AS dialect FROM v")
def dialect_votes(spark, d):
    return files.once(_files(spark, d), *(v.alias(k) for k, v in describe.dialect_votes("content").items()), describe.dialect("content").alias("dialect"))


@query("model_cache_keys", f"WITH {FILES} SELECT file_id, sha256('{{\"content\": \"' || sha256(lower(trim(regexp_replace(regexp_replace(coalesce(content, ''), '//[^\\n]*|#[^\\n]*', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), ' '))) || '\", \"model\": \"m1\", \"temperature\": \"0\"}}') AS cache_key FROM f")
def model_cache_keys(spark, d):
    return files.cache_keys(_files(spark, d), "m1", {"temperature": "0"})


@query("contents_truncated", f"WITH {FILES}, h AS (SELECT file_id, content, left(content, 4000) AS head FROM f WHERE content IS NOT NULL), p AS (SELECT *, length(regexp_extract(head, '(?s)^(.*)\n', 1)) + 1 AS place, strpos(head, chr(10)) AS back FROM h) SELECT file_id, length(CASE WHEN length(content) <= 4000 THEN content WHEN back > 0 AND place >= 3600 THEN left(head, place - 1) ELSE head END) AS kept FROM p")
def contents_truncated(spark, d):
    return files.once(_files(spark, d).filter("content is not null"), F.length(summarize.truncated(F.col("content"), 1000)).cast("bigint").alias("kept"))


@query("chat_sizes", f"WITH m AS (SELECT source, domain AS role, text FROM documents), t AS (SELECT source, {TOKENS.replace('content', 'text')} AS a, {TOKENS.replace('content', 'role')} AS b FROM m) SELECT source, count(*) AS messages, (sum(a + b + 3) + 3)::BIGINT AS tokens FROM t GROUP BY 1")
def chat_sizes(spark, d):
    """Documents of a source as one chat, their domain as the role."""
    m = table(spark, d, "documents").select("source", F.col("domain").alias("role"), "text")
    return describe.chat_tokens(m, "source").withColumn("tokens", F.col("tokens").cast("bigint"))


# ---------------------------------------------------------------------------------------------------- findings
@query("test_findings", _SCAN + " SELECT path, line_no, rule, severity, masked FROM s WHERE regexp_matches(lower(path), '/test_|_test\\.py|/tests/|/test/|/__pycache__/|/\\.pytest_cache/|/fixtures/|/mocks/|/stubs/|/__tests__/|\\.test\\.js|\\.spec\\.js|\\.test\\.ts|\\.spec\\.ts')")
def test_findings(spark, d):
    return scan.unignored(_files(spark, d)).filter(T.is_test("path")).select("path", "line_no", "rule", "severity", "masked")


@query("custom_rule_scan", f"{LINES}, x AS (SELECT DISTINCT file_id, line_no::INT AS line_no, unnest(regexp_extract_all(line, 'TODO\\(\\w+\\)|AKIA[0-9A-Z]{{16}}')) AS v FROM l) SELECT file_id, line_no, CASE WHEN starts_with(v, 'TODO') THEN 'todo_owner' ELSE 'aws_access_key_id' END AS rule FROM x GROUP BY ALL")
def custom_rule_scan(spark, d):
    """A custom rule, and one in place of a built-in of the same name."""
    own = (R.Rule("todo_owner", r"TODO\(\w+\)", "", 0), R.Rule("aws_access_key_id", r"AKIA[0-9A-Z]{16}", "", 4))
    rules = [r for r in scan.compiled(own) if r.name in ("todo_owner", "aws_access_key_id")]
    return scan.findings(_files(spark, d), rules).select("file_id", "line_no", "rule").distinct()


@query("issues_formatted", "WITH i AS (SELECT DISTINCT file_path, severity, line_number, rule_id, description FROM security_issues WHERE severity >= 3) SELECT file_path, string_agg(CASE severity WHEN 4 THEN 'CRITICAL' ELSE 'HIGH' END || ' line ' || coalesce(line_number::VARCHAR, '?') || ': ' || coalesce(description, '') || ' [' || coalesce(rule_id, '') || ']', chr(10) ORDER BY severity DESC, line_number NULLS FIRST, rule_id NULLS FIRST, description) AS text FROM i GROUP BY 1")
def issues_formatted(spark, d):
    return scan.formatted(table(spark, d, "security_issues"), "HIGH")


@query("severity_badges", "SELECT DISTINCT issue_id, CASE severity WHEN 0 THEN 'ℹ️' WHEN 1 THEN '🟢' WHEN 2 THEN '🟡' WHEN 3 THEN '🟠' WHEN 4 THEN '🔴' ELSE '❓' END AS badge FROM security_issues")
def severity_badges(spark, d):
    return table(spark, d, "security_issues").select("issue_id", render.badge("severity").alias("badge")).distinct()


@query("new_external_findings", _RAW_SCAN + " SELECT DISTINCT issue_id FROM security_issues i WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.file_id = i.file_id AND s.line_no = i.line_number AND s.rule = i.rule_id)")
def new_external_findings(spark, d):
    own = scan.findings(_files(spark, d)).select("file_id", F.col("line_no").alias("line_number"), F.col("rule").alias("rule_id"))
    return scan.new_findings(table(spark, d, "security_issues"), own).select("issue_id").distinct()


@query("ignored_findings", "SELECT DISTINCT issue_id, coalesce(regexp_matches(file_path, '(?:^|/)(?:tests|examples)/') OR regexp_matches(file_path, '_test\\.go$'), false) AS by_path, coalesce(regexp_matches(context, '(?i)example|localhost'), false) AS by_text FROM security_issues")
def ignored_findings(spark, d):
    i = table(spark, d, "security_issues")
    return i.select("issue_id", F.coalesce(scan.unwanted_path("file_path", ("**/tests/**", "**/examples/**", "*_test.go")), F.lit(False)).alias("by_path"), F.coalesce(scan.unwanted_finding("context", ("(?i)example", "(?i)localhost")), F.lit(False)).alias("by_text")).distinct()


@query("attack_places", f"{LINES}, x AS (SELECT file_id, line_no::INT AS line_no, 'base64_obfuscation' AS rule, len(regexp_extract_all(line, '[A-Za-z0-9+/]{{50,}}={{0,2}}')) AS n FROM l UNION ALL SELECT file_id, line_no::INT, 'suspicious_ip_address', len(regexp_extract_all(line, '\\b(?:192\\.168|10\\.|172\\.(?:1[6-9]|2[0-9]|3[01]))\\.\\d{{1,3}}\\.\\d{{1,3}}\\b')) FROM l) SELECT file_id, line_no, rule, n FROM x WHERE n > 0")
def attack_places(spark, d):
    from corpusmill.functions.attacks import ATTACK_RULES

    rules = [r for r in ATTACK_RULES if r.name in ("base64_obfuscation", "suspicious_ip_address")]
    return scan.attacks(_files(spark, d), rules).groupBy("file_id", "line_no", "rule").agg(F.count("*").alias("n"))


@query("segment_contents", _PARTS + " SELECT file_id, segment::BIGINT AS segment, sha256(part) AS h FROM b")
def segment_contents(spark, d):
    """Segments of a file looked up by its id."""
    each = files.once(compress._segment_rows(_scored(spark, d), True, **_TAGS), "segments").select("file_id", F.explode("segments").alias("s"))
    return each.select("file_id", "s.segment", F.sha2("s.content", 256).alias("h"))


# ------------------------------------------------------------------------------------ snapshots, graph, summaries
@query("snapshot_stats", _STATES + ", k AS (SELECT c.path, change, CASE WHEN f.content IS NULL THEN 0 ELSE len(list_filter(string_split(f.content, chr(10)), lambda x: NOT starts_with(x, '--'))) END AS n, f.content IS NULL AS missing FROM c LEFT JOIN f ON f.path = c.path) SELECT count(*) AS files, sum(CASE WHEN change = 'modified' THEN CASE WHEN missing THEN 2 ELSE 1 END ELSE 0 END)::BIGINT AS additions, sum(CASE change WHEN 'deleted' THEN n ELSE 0 END)::BIGINT AS deletions, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'deleted') AS deleted, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'renamed') AS renamed FROM k WHERE change <> 'added'")
def snapshot_stats(spark, d):
    """Sums over the changed files, added ones left out, which the test states make of empty files only."""
    rows = diff.rows(*_states(spark, d, contents=True), binaries=True).filter("change <> 'added'")
    return diff.stats(rows).drop("binary")


@query("first_imports", f"WITH {FILES}, e AS (SELECT DISTINCT repo, path, unnest(regexp_extract_all(content, '(?m)^[ \\t]*(?:from|import)[ \\t]+([A-Za-z_][\\w.]*)', 1)) AS i FROM f WHERE ends_with(path, '.py')) SELECT repo, path, array_to_string(list_slice(list_sort(list(i)), 1, 10), ',') AS imports FROM e GROUP BY 1, 2")
def first_imports(spark, d):
    e = graph.edges(_files(spark, d)).filter(F.col("path").endswith(".py"))
    return graph.first_imports(e).select("repo", "path", F.array_join("imports", ",").alias("imports"))


@query("latest_summaries", "SELECT file_id, arg_max(summary, (created_at, summary_id)) AS summary FROM summaries WHERE error IS NULL AND file_id IS NOT NULL AND summary IS NOT NULL GROUP BY 1")
def latest_summaries(spark, d):
    return summarize.latest(table(spark, d, "summaries"))


@query("fresh_summaries", "SELECT DISTINCT summary_id FROM summaries WHERE epoch(TIMESTAMP '2024-09-01') - floor(epoch(created_at)) <= 2592000")
def fresh_summaries(spark, d):
    return summarize.fresh(table(spark, d, "summaries"), "2024-09-01 00:00:00", 30 * 86400).select("summary_id").distinct()


@query("repository_addresses", "SELECT repo_id, CASE repo_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'v1' WHEN 2 THEN 'dev' ELSE NULL END AS ref, string_split(repo, '/')[1] AS owner, string_split(repo, '/')[2] AS name, CASE repo_id % 4 WHEN 1 THEN 'shorthand' ELSE 'url' END AS kind FROM repos")
def repository_addresses(spark, d):
    m = F.pmod("repo_id", F.lit(4))
    a = F.when(m == 0, F.concat(F.lit("https://host.example/"), "repo", F.lit(".git"))).when(m == 1, F.concat("repo", F.lit("#v1"))).when(m == 2, F.concat(F.lit("https://host.example/"), "repo", F.lit("/tree/dev"))).otherwise(F.concat(F.lit("git@host.example:"), "repo", F.lit(".git")))
    return table(spark, d, "repos").select("repo_id", git.address_parts(a).alias("p"), git.target_kind(a).alias("kind")).select("repo_id", "p.ref", "p.owner", "p.name", "kind")


_TOP = _NODES + """, t AS (SELECT file_id, node_path::INT AS ord, x->>'$.kind' AS kind, x->>'$.name' AS name, (x->>'$.start_line')::INT AS start_line, (x->>'$.end_line')::INT AS end_line, x->>'$.docstring' AS docstring, x->>'$.signature' AS signature, coalesce(json_array_length(x, '$.modifiers'), 0)::INT AS modifiers, (SELECT count(*) FROM n c WHERE c.file_id = n.file_id AND c.parent_path = n.node_path)::INT AS children FROM n WHERE parent_path = ''),
 p AS (SELECT DISTINCT file_id, parser_ord, parser_type, error FROM parse_results), u AS (SELECT * FROM (SELECT *, coalesce(error, '') <> '' AS failed, bool_and(coalesce(error, '') <> '') OVER (PARTITION BY file_id) AS all_failed FROM p) WHERE NOT failed OR all_failed),
 d AS (SELECT t.*, parser_ord FROM t JOIN u USING (file_id))"""


@query("merged_union", _TOP + " SELECT file_id, kind, name, start_line, end_line, parser_ord, ord FROM (SELECT *, row_number() OVER (PARTITION BY file_id, kind, name, start_line, end_line ORDER BY parser_ord, ord) AS r FROM d) WHERE r = 1")
def merged_union(spark, d):
    from corpusmill.plans.catalogue import merge_declarations_union

    return merge_declarations_union(spark, d).select("file_id", "kind", "name", "start_line", "end_line", "parser_ord", "ord")


@query("merged_best_of_breed", _TOP + " SELECT file_id, kind, name, start_line, end_line, parser_ord, ord, modifiers, children FROM (SELECT *, row_number() OVER (PARTITION BY file_id, kind, name, start_line, end_line ORDER BY (coalesce(docstring, '') <> '') DESC, (coalesce(signature, '') <> '') DESC, modifiers DESC, children DESC, parser_ord, ord) AS r FROM d) WHERE r = 1")
def merged_best_of_breed(spark, d):
    from corpusmill.plans.catalogue import merge_declarations_best_of_breed

    return merge_declarations_best_of_breed(spark, d).select("file_id", "kind", "name", "start_line", "end_line", "parser_ord", "ord", "modifiers", "children")


@query("complete_parsers", "WITH p AS (SELECT DISTINCT file_id, parser_ord, parser_type, error FROM parse_results) SELECT file_id, count(*) AS parsers, count(*) FILTER (coalesce(error, '') = '') AS usable FROM p GROUP BY 1")
def complete_parsers(spark, d):
    p = table(spark, d, "parse_results").select("file_id", "parser_ord", "parser_type", "error").distinct()
    ok = merge.usable(p).filter("coalesce(error, '') = ''").groupBy("file_id").agg(F.count("*").alias("usable"))
    return p.groupBy("file_id").agg(F.count("*").alias("parsers")).join(ok, "file_id", "left").withColumn("usable", F.coalesce("usable", F.lit(0).cast("bigint")))


@query("rendered_xml_roundtrip", f"WITH {FILES} SELECT path, sha256(coalesce(content, '')) AS h FROM f")
def rendered_xml_roundtrip(spark, d):
    return render.reconstruct(render.chunks(_files(spark, d), "xml").select(F.col("chunk").alias("document")), "xml").select("path", F.sha2("content", 256).alias("h"))


@query("rendered_text", f"WITH {FILES}, c AS (SELECT repo, path, coalesce(content, '') AS content, row_number() OVER (PARTITION BY repo ORDER BY path, file_id) AS n, count(*) OVER (PARTITION BY repo) AS total, coalesce({LANG}, 'unknown') AS language, {LINE_COUNT} AS lines, {BYTES} AS b FROM f) SELECT repo, path, sha256(repeat('=', 80) || chr(10) || 'FILE ' || n || '/' || total || ': ' || path || chr(10) || language || ', ' || lines || ' lines, ' || CASE WHEN b < 1024 THEN printf('%d B', b) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0) ELSE printf('%.1f MB', b / 1048576.0) END || chr(10) || repeat('=', 80) || chr(10) || content || chr(10)) AS h FROM c")
def rendered_text(spark, d):
    return render.chunks(_files(spark, d), "text").select("repo", "path", F.sha2("chunk", 256).alias("h"))


# -------------------------------------------------------------------------------------------------- declarations
def _declared(spark, d, language):
    from corpusmill.operators import parse

    return parse.declarations(_files(spark, d).filter(files.language_by_extension("path") == language)).select("file_id", "kind", "name", "start_line", "end_line", "parent", "signature", "docstring", "depth", "degraded")


_HEADS = {
    "go": ("go", "^(?:func\\s+(?:\\([^)]*\\)\\s*)?|type\\s+)([A-Za-z_]\\w*)"),
    "rust": ("rs", "^\\s*(?:pub(?:\\([^)]*\\))?\\s+)?(?:(?:const|async|unsafe)\\s+)*(?:fn|struct|enum|trait|mod)\\s+([A-Za-z_]\\w*)|^\\s*impl(?:<[^>]*>)?\\s+(?:[\\w:<>]+\\s+for\\s+)?([A-Za-z_]\\w*)"),
    "ruby": ("rb", "^\\s*(?:module|class|def)\\s+(?:self\\.)?([A-Za-z_]\\w*[?!=]?)"),
    "python": ("py", "^\\s*(?:async\\s+)?(?:def|class)\\s+(\\w+)"),
    "java": ("java", "^\\s*(?:(?:public|private|protected|static|final|abstract|sealed)\\s+)*(?:class|interface|enum)\\s+([A-Za-z_]\\w*)"),
}


def _heads(language, extra=""):
    ending, regex = _HEADS[language]
    groups = regex.count("([A-Za-z_]\\w*") + regex.count("(\\w+)")
    name = f"regexp_extract(line, '{regex}', 1)" if groups == 1 else f"coalesce(nullif(regexp_extract(line, '{regex}', 1), ''), regexp_extract(line, '{regex}', 2))"
    return f"{LINES}, h AS (SELECT file_id, {name} AS name, line_no::INT AS start_line FROM l WHERE ends_with(path, '.{ending}') AND regexp_matches(line, '{regex}')) SELECT file_id, name, start_line FROM h{extra}"


for _language in ("go", "rust", "ruby", "python"):

    def _query(spark, d, language=_language):
        return _declared(spark, d, language).select("file_id", "name", "start_line")

    query(f"{_language}_headers", _heads(_language))(_query)


@query("java_types", _heads("java"))
def java_types(spark, d):
    return _declared(spark, d, "java").filter(F.col("kind").isin("class", "interface", "enum")).select("file_id", "name", "start_line")


@query("go_blocks", f"{LINES}, h AS (SELECT file_id, line_no::INT AS start_line, line FROM l WHERE ends_with(path, '.go') AND regexp_matches(line, '^func\\s+(?:\\([^)]*\\)\\s*)?[A-Za-z_]\\w*')), e AS (SELECT file_id, line_no::INT AS n FROM l WHERE ends_with(path, '.go') AND rtrim(line, chr(13)) = '}}'), t AS (SELECT file_id, max(line_no)::INT AS total FROM l GROUP BY 1) SELECT h.file_id, start_line, coalesce(min(n), any_value(total)) AS end_line FROM h JOIN t USING (file_id) LEFT JOIN e ON e.file_id = h.file_id AND e.n > h.start_line GROUP BY 1, 2")
def go_blocks(spark, d):
    """Where the body of each function ends: by its braces."""
    return _declared(spark, d, "go").filter(F.col("kind").isin("function", "method") & (F.col("end_line") > F.col("start_line"))).select("file_id", "start_line", "end_line")


@query("go_documented", f"{LINES}, h AS (SELECT file_id, line_no FROM l WHERE ends_with(path, '.go') AND regexp_matches(line, '^(?:func\\s+(?:\\([^)]*\\)\\s*)?|type\\s+)[A-Za-z_]\\w*')) SELECT h.file_id, h.line_no::INT AS start_line FROM h JOIN l ON l.file_id = h.file_id AND l.line_no = h.line_no - 1 WHERE regexp_matches(l.line, '^\\s*//+\\s*\\S') OR regexp_matches(l.line, '\\*/\\s*$')")
def go_documented(spark, d):
    """Declarations with a comment that ends directly above them."""
    return _declared(spark, d, "go").filter("docstring is not null").select("file_id", "start_line")


_NEEDS = {
    "java": ("java", "(?m)^[ \\t]*import[ \\t]+(?:static[ \\t]+)?([\\w.]+(?:\\.\\*)?)"),
    "rust": ("rs", "(?m)^[ \\t]*(?:pub[ \\t]+)?use[ \\t]+([\\w:]+)"),
    "ruby": ("rb", "(?m)^[ \\t]*require(?:_relative)?[ \\t]*\\(?[''\"]([^''\"\\n]+)[''\"]"),
    "c": ("c", "(?m)^[ \\t]*#[ \\t]*include[ \\t]*[<\"]([^>\"\\n]+)[>\"]"),
}
for _language, (_ending, _regex) in _NEEDS.items():

    def _query(spark, d, language=_language):
        from corpusmill.operators import parse

        return parse.imports(_files(spark, d).filter(files.language_by_extension("path") == language)).select("file_id", "import")

    query(f"{_language}_imports", f"WITH {FILES} SELECT DISTINCT file_id, unnest(regexp_extract_all(ltrim(content, chr(65279)), '{_regex}', 1)) AS import FROM f WHERE ends_with(path, '.{_ending}')")(_query)
