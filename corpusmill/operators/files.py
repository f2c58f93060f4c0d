"""The files relation and the questions asked of whole corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import order

#: Path endings of binary files, parts of paths that are taken for binary or built output, names that are no code. Fixed values.
BINARY_EXTENSIONS = (
    "png", "jpg", "jpeg", "gif", "ico", "webp", "bmp", "tiff", "tif", "svg",
    "woff", "woff2", "ttf", "eot", "otf",
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
    "zip", "tar", "gz", "tgz", "7z", "rar", "bz2", "xz",
    "mp3", "mp4", "wav", "avi", "mov", "flac", "ogg", "mkv", "wmv", "mpg", "mpeg",
    "exe", "dll", "so", "dylib", "bin", "dat", "db", "sqlite", "pyc", "pyo", "pyd",
    "whl", "egg", "tsbuildinfo", "min.js", "bundle.js",
)
BINARY_PARTS = ("lock.json", "package-lock", "yarn.lock", "pnpm-lock", ".min.js", ".bundle.js", "vendor.js", "polyfill", "compiled", "generated", "build/", "dist/")
SPECIAL_NAMES = ("makefile", "dockerfile", "jenkinsfile", "vagrantfile")
#: Hidden configuration files that are kept although ignore files and default excludes match them. Fixed values.
KEPT_HIDDEN = (
    ".eslintrc", ".eslintrc.js", ".eslintrc.cjs", ".eslintrc.json", ".eslintrc.yml", ".eslintrc.yaml",
    ".prettierrc", ".prettierrc.js", ".prettierrc.cjs", ".prettierrc.json", ".prettierrc.yml", ".prettierrc.yaml",
    ".babelrc", ".babelrc.js", ".babelrc.json", ".swcrc", ".npmrc", ".nvmrc", ".yarnrc", ".yarnrc.yml",
    ".editorconfig", ".flake8", ".pylintrc", ".python-version", ".pre-commit-config.yaml", ".isort.cfg", ".style.yapf", ".coveragerc",
    ".dockerignore", ".env.example", ".env.template", ".env.sample", ".rubocop.yml", ".ruby-version",
    ".browserslistrc", ".commitlintrc", ".commitlintrc.js", ".commitlintrc.json", ".lintstagedrc", ".lintstagedrc.js", ".lintstagedrc.json",
    ".huskyrc", ".huskyrc.js", ".huskyrc.json", ".markdownlint.json", ".markdownlintrc", ".prettierignore", ".eslintignore",
    ".stylelintrc", ".stylelintrc.json", ".stylelintrc.js",
)
#: Directories that are never entered. Fixed values.
PRUNED_NAMES = ("__pycache__", ".git", "node_modules", ".pytest_cache", "build", "dist", ".idea", ".vscode", "venv", ".venv", "env", "site-packages", "libs", "vendor", "third_party")
#: Excluded unless told otherwise: built, cached, locked, temporary, binary and secret files. Fixed values.
DEFAULT_EXCLUDES = (
    "**/.git/**", "**/__pycache__/**", "*.pyc", "*.pyo", "*.pyd", "**/node_modules/**", "build/", "dist/", "*.egg-info/", "*.egg",
    ".vscode/", ".idea/", "*.swp", "*.swo", "*~", ".project", ".classpath", ".settings/",
    ".DS_Store", "._*", "Thumbs.db", "desktop.ini", ".coverage", ".pytest_cache/", ".tox/", "coverage.xml", "*.cover", ".hypothesis/", "htmlcov/", "coverage/",
    ".next/", "**/static/chunks/**", "*.map", "docs/_build/", "site/", ".env", ".env.*", "venv/", "ENV/", "env/",
    "*.log", "logs/", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Gemfile.lock", "composer.lock", "poetry.lock", "Pipfile.lock",
    "*.sql", "*.sqlite", "*.db", "tmp/", "temp/", "*.tmp", "*.temp", "*.bak", "*.backup", "*.old",
    "*.jar", "*.war", "*.ear", "*.zip", "*.tar.gz", "*.rar", ".cache/", ".sass-cache/", ".parcel-cache/", "out/", "**/libs/**", "**/third_party/**",
    ".secrets/", "*.pem", "*.key", "*.cert", "*.crt", "secrets.yml", "secrets.json",
)
#: Languages by ending of the path, and by whole name. Fixed values.
EXTENSIONS = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java",
    "c": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "h": "c_header", "hpp": "cpp_header", "hh": "cpp_header", "cs": "csharp", "go": "go", "rb": "ruby", "php": "php",
    "swift": "swift", "kt": "kotlin", "kts": "kotlin", "rs": "rust", "scala": "scala", "m": "objective-c", "mm": "objective-cpp", "pl": "perl", "pm": "perl", "lua": "lua", "r": "r",
    "sh": "bash", "bash": "bash", "zsh": "bash", "fish": "bash", "ksh": "bash", "ps1": "powershell", "bat": "batch", "cmd": "batch", "sql": "sql",
    "html": "html", "htm": "html", "css": "css", "sass": "sass", "less": "less", "xml": "xml", "json": "config", "yaml": "yaml", "yml": "yaml", "toml": "toml",
    "ini": "ini", "cfg": "ini", "conf": "ini", "md": "markdown", "rst": "restructuredtext", "tex": "latex", "txt": "text", "dockerfile": "dockerfile", "makefile": "makefile",
    "env": "dotenv", "gitignore": "gitignore", "gitattributes": "gitattributes", "csv": "csv", "tsv": "tsv", "http": "http", "graphql": "graphql", "gql": "graphql",
    "vue": "vue", "svelte": "svelte", "dart": "dart", "ex": "elixir", "exs": "elixir", "erl": "erlang", "hrl": "erlang",
    "fs": "fsharp", "fsi": "fsharp", "fsx": "fsharp", "fsscript": "fsharp", "hs": "haskell", "lhs": "haskell", "purescript": "purescript", "purs": "purescript",
    "clj": "clojure", "cljs": "clojurescript", "cljc": "clojure", "edn": "edn", "tf": "terraform", "hcl": "hcl", "groovy": "groovy", "gvy": "groovy", "gradle": "gradle",
    "sol": "solidity", "cshtml": "razor", "vb": "vbnet", "vbs": "vbscript", "pas": "pascal", "dfm": "delphi_form", "lpr": "delphi_project", "dpr": "delphi_project",
    "asm": "assembly", "s": "assembly", "cbl": "cobol", "cob": "cobol", "f": "fortran", "for": "fortran", "f90": "fortran", "f95": "fortran", "f03": "fortran", "f08": "fortran",
    "jl": "julia", "nim": "nim", "cr": "crystal", "zig": "zig", "wat": "wat", "applescript": "applescript", "scpt": "applescript", "gd": "gdscript", "tcl": "tcl", "cmake": "cmake",
    "abap": "abap", "ada": "ada", "ads": "ada", "adb": "ada", "elm": "elm", "nix": "nix", "rkt": "racket", "scheme": "scheme", "v": "verilog", "sv": "systemverilog", "vhdl": "vhdl",
    "liquid": "liquid", "ejs": "ejs", "mustache": "mustache", "handlebars": "handlebars", "hbs": "handlebars", "pug": "pug", "jade": "jade", "haml": "haml", "slim": "slim",
    "ipynb": "jupyter_notebook", "glsl": "glsl", "vert": "glsl", "frag": "glsl", "geom": "glsl", "tesc": "glsl", "tese": "glsl", "comp": "glsl",
    "hlsl": "hlsl", "fx": "hlsl", "hlsli": "hlsl", "cginc": "hlsl", "metal": "metal", "msl": "metal",
}
NAMES = {"dockerfile": "dockerfile", "makefile": "makefile", "cmakelists.txt": "cmake"}


def language_by_extension(path: Column | str, custom: dict[str, str] | None = None) -> Column:
    """By whole name, then by ending, both in lower case; ``custom`` endings come first. Null if unknown."""
    pairs = [F.lit(x) for kv in {**EXTENSIONS, **{k.lstrip("."): v for k, v in (custom or {}).items()}}.items() for x in kv]
    names = [F.lit(x) for kv in NAMES.items() for x in kv]
    return F.coalesce(F.create_map(*names)[F.lower(T.filename(path))], F.create_map(*pairs)[F.lower(T.extension(path))])


language_of = language_by_extension


def language_of_path(path: str | None) -> str | None:
    """The same in Python."""
    name = (path or "").rpartition("/")[2].lower()
    return NAMES.get(name) or (EXTENSIONS.get(name.rpartition(".")[2]) if "." in name[1:] else None)


#: What a text of unknown name begins with or holds, by language; the first that matches decides.
CONTENT_SIGNS = (
    ("python", r"^#!.*\bpython|(?m)^(?:def|class) \w+.*:\s*$|(?m)^from [\w.]+ import "),
    ("bash", r"^#!.*\b(?:bash|sh|zsh)\b"),
    ("ruby", r"^#!.*\bruby|(?m)^require ['\"]"),
    ("javascript", r"^#!.*\bnode|(?m)^(?:const|let|var) \w+ = |(?m)^module\.exports\b"),
    ("php", r"^<\?php"),
    ("xml", r"^<\?xml"),
    ("html", r"(?i)^\s*<!doctype html|^\s*<html"),
    ("go", r"(?m)^package \w+$"),
    ("java", r"(?m)^package [\w.]+;|(?m)^import [\w.]+;"),
    ("rust", r"(?m)^use [\w:]+;|(?m)^(?:pub )?fn \w+"),
    ("c", r"(?m)^#include [<\"]"),
    ("config", r"^\s*[{\[]\s*[\"{\[]"),
)


def language_by_content(content: Column | str) -> Column:
    """A guess from the whole text where a path says nothing; null if no sign is found."""
    c = F.col(content) if isinstance(content, str) else content
    out = F.lit(None).cast("string")
    for language, sign in reversed(CONTENT_SIGNS):
        out = F.when(c.rlike("(?d)" + sign), language).otherwise(out)
    return out


def determined_language(path: Column | str, content: Column | str, custom: dict[str, str] | None = None) -> Column:
    """By name, then by content, then ``unknown``."""
    return F.coalesce(language_by_extension(path, custom), language_by_content(content), F.lit("unknown"))


def delivered(rows: DataFrame) -> DataFrame:
    """``rows`` with delivery, the times by which ``once`` finds the latest; null where there are none."""
    times = [(F.unix_micros(F.col(c).cast("timestamp")) if c in rows.columns else F.lit(None).cast("bigint")).alias(c) for c in ("ingested_at", "collected_at")]
    return rows.withColumn("delivery", F.struct(*times))


def files(deliveries: DataFrame) -> DataFrame:
    """(file_id, repo, path, content, delivery) of every delivery; ``once`` leaves one a file.

    Contents are never shuffled to find repeated deliveries: each operator derives its narrow result first,
    and that is reduced to the latest delivery of each file.
    """
    return delivered(deliveries).select("file_id", "repo", F.concat_ws("/", "repo", "file_path").alias("path"), "content", "delivery")


def once(df: DataFrame, *columns: Column | str) -> DataFrame:
    """file_id and columns, one row a file: what the delivery with the latest (ingested_at, collected_at) gives.

    Deliveries that agree in both times are settled by the values themselves, so that the result does not
    depend on the plan. A relation without ``delivery`` has one row a file already.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    if "delivery" not in df.columns:
        return df.select("file_id", *cols)
    rows = df.select("file_id", "delivery", *cols)
    names = rows.columns[2:]
    latest = rows.groupBy("file_id").agg(F.max(F.struct("delivery", *names)).alias("_latest"))
    return latest.select("file_id", *(F.col("_latest")[n].alias(n) for n in names))


def _bytes() -> Column:
    return F.octet_length(F.coalesce("content", F.lit(""))).cast("bigint")


def stats(df: DataFrame) -> DataFrame:
    per = once(df, "path", T.line_count("content").alias("lines"), _bytes().alias("bytes"))
    n, size = F.count("*"), F.sum("bytes")
    docs = T.ends_with_any(F.col("path"), (".md", ".txt", ".rst"))
    return per.agg(
        n.alias("files"),
        F.sum("lines").alias("lines"),
        size.alias("bytes"),
        F.countDistinct(language_of("path")).alias("languages"),
        F.coalesce(F.floor(size / F.nullif(n, F.lit(0))), F.lit(0)).alias("average_size"),
        F.count_if(~docs).alias("source_files"),
        F.count_if(docs).alias("doc_files"),
    )


def category_counts(df: DataFrame) -> DataFrame:
    c = T.category("path")
    return once(df, "path").agg(*(F.count_if(c == k).alias(k) for k in ("source", "test", "documentation", "configuration", "other")))


def metadata(df: DataFrame) -> DataFrame:
    per = once(df, "path", _bytes().alias("bytes"), T.line_count("content").alias("lines"))
    return per.select("file_id", T.directory("path").alias("dir"), T.filename("path").alias("name"), T.extension("path").alias("ext"), "bytes", "lines", T.category("path").alias("category"), T.human_size("bytes").alias("size"))


def index_by(df: DataFrame, key: Column) -> DataFrame:
    """key -> number of paths, first and last path. Groups are unbounded, so members stay rows (``members_by``)."""
    return once(df, "path").groupBy(key.alias("k")).agg(F.count("*").alias("files"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


def members_by(df: DataFrame, key: Column) -> DataFrame:
    """The inverted index as rows, numbered within each key by path, however many files a key has."""
    return order.ranked(once(df, "path").select(key.alias("k"), "path", "file_id"), ["k"], ["path", "file_id"]).drop("file_id")


def pruned_directory(path: Column | str, env_like: bool = True) -> Column:
    """Whether a walk from the top would not have come to a file: a directory above it is pruned by name."""
    p = F.col(path) if isinstance(path, str) else path
    above = F.slice(F.split(p, "/"), F.lit(1), F.size(F.split(p, "/")) - 1)

    def bad(d: Column) -> Column:
        low = d.isin(*PRUNED_NAMES) | d.startswith(".")
        return low | F.lower(d).contains("env") if env_like else low

    return F.exists(above, bad)


def matches_any(path: Column | str, globs) -> Column:
    """Whether a path matches one of some globs; one combined expression."""
    p = F.col(path) if isinstance(path, str) else path
    return p.rlike("|".join(f"(?:{T.glob_regex(g)})" for g in globs)) if globs else F.lit(False)


def skip_reason(path: Column | str, content: Column | str | None = None, max_bytes: int = 20 * 1024 * 1024, doc_endings=T.DOC_ENDINGS, excludes=(), includes=(), include_languages=(), exclude_languages=(), ignore: str | None = None, default_excludes: bool = False, prune: bool = False, custom: dict[str, str] | None = None) -> Column:
    """Why a file is left out, null if it is kept; the order of the tests is part of the result.

    ``ignore`` is the text of an ignore file; hidden configuration files of ``KEPT_HIDDEN`` pass it and the default excludes.
    """
    from corpusmill.sources.trees import ignored

    p = F.col(path) if isinstance(path, str) else path
    low, language = F.lower(p), language_by_extension(p, custom)
    binary = F.lower(T.extension(p)).isin(*BINARY_EXTENSIONS) | T.holds_any(low, BINARY_PARTS)
    hidden = T.filename(p).isin(*KEPT_HIDDEN)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    if prune:
        out = out.when(pruned_directory(p), "pruned_directory")
    if ignore is not None:
        out = out.when(ignored(p, ignore) & ~hidden, "ignored")
    if default_excludes:
        out = out.when(matches_any(p, DEFAULT_EXCLUDES) & ~hidden, "default_exclude")
    for glob in excludes:
        out = out.when(p.rlike(T.glob_regex(glob)), "excluded_pattern")
    if includes:
        out = out.when(~matches_any(p, includes), "not_included")
    out = out.when(T.ends_with_any(low, doc_endings), "documentation").when(F.lower(T.filename(p)).isin(*SPECIAL_NAMES), "special_file").when(language.isNull(), "unknown_language")
    if include_languages:
        out = out.when(~language.isin(*include_languages), "excluded_language")
    if exclude_languages:
        out = out.when(language.isin(*exclude_languages), "excluded_language")
    out = out.when(binary, "binary")
    if content is not None:
        c = F.col(content) if isinstance(content, str) else content
        out = out.when(c.isNull(), "unreadable").when(F.octet_length(c) > max_bytes, "too_large").when(c.contains("\x00"), "binary_content")
    return out


def skipped(df: DataFrame, **options) -> DataFrame:
    ext = T.extension("path")
    per = once(df, "path", skip_reason("path", "content", **options).alias("reason"), F.when(ext == "", "no_extension").otherwise(F.concat(F.lit("."), ext)).alias("extension"))
    return per.filter("reason is not null")


def skip_summary(df: DataFrame, top: int = 5, **options) -> DataFrame:
    """The most frequent endings of skipped files; ties by name. The limit is the feature."""
    return skipped(df, **options).groupBy("extension").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "extension").limit(top)


def skip_totals(df: DataFrame, **options) -> DataFrame:
    """(reason, files, share): how many files each reason leaves out, and what part of all files that is; a total without reason."""
    per = once(df, skip_reason("path", "content", **options).alias("reason"))
    by = per.rollup("reason").agg(F.count("*").alias("files"), F.grouping("reason").alias("whole"), F.count_if(F.col("reason").isNotNull()).alias("left_out"))
    total = by.filter("whole = 1").select(F.col("files").alias("all_files"))
    rows = by.filter("whole = 1 or reason is not null").select("reason", F.when(F.col("whole") == 1, F.col("left_out")).otherwise(F.col("files")).alias("files"))
    return rows.join(F.broadcast(total)).select("reason", "files", F.round(F.col("files") / F.col("all_files"), 6).alias("share"))


def navigation(df: DataFrame) -> DataFrame:
    """Number in path order within a repo, with the anchors of the neighbours, however many files a repo has."""
    per = once(df, "repo", "path").withColumn("anchor", T.anchor("path"))
    out = order.ranked(per, ["repo"], ["path", "file_id"], {"anchor": "anchor"})
    return out.select("repo", "path", "file_id", "n", "anchor", "prev_anchor", "next_anchor")


def tree(df: DataFrame) -> DataFrame:
    """Every directory and file as a row: path, depth, whether it is its parent's last child, direct children.

    What a directory says of its children is aggregated by directory and joined to one node each, so that a
    directory of any size is no hot key.
    """
    parts = F.split("path", "/")
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("node"), (k == F.size(parts)).alias("is_file"))))
    nodes = df.select(prefixes.alias("p")).select("p.node", "p.depth", "p.is_file").distinct()
    parent = F.when(F.col("depth") == 1, "").otherwise(F.regexp_extract("node", r"^(.*)/[^/]*$", 1))
    below = nodes.groupBy(parent.alias("parent")).agg(F.count("*").alias("children"), F.max("node").alias("last_child"))
    kids = below.filter("parent <> ''").select(F.col("parent").alias("node"), "children")
    lasts = below.select(F.col("last_child").alias("node"), F.lit(True).alias("last"))
    placed = nodes.join(kids, "node", "left").join(lasts, "node", "left")
    return placed.select("node", "depth", "is_file", F.coalesce("last", F.lit(False)).alias("last"), F.coalesce("children", F.lit(0).cast("bigint")).alias("children"))


def drawn_tree(df: DataFrame) -> DataFrame:
    """(node, line): every node of ``tree`` as a line of the drawing; lines in order of node make the tree.

    A line needs to know which of its ancestors are last children: at most as many rows as its depth.
    """
    t = tree(df)
    parts = F.split("node", "/")
    up = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("above")
    flags = t.select("node", up).join(t.select(F.col("node").alias("above"), "last"), "above")
    marks = flags.groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.length("above").alias("k"), "last"))).alias("marks"))
    depth = F.size("marks")
    stem = F.array_join(F.transform(F.slice("marks", F.lit(1), depth - 1), lambda m: F.when(m["last"], "    ").otherwise("│   ")), "")
    tip = F.when(F.element_at("marks", -1)["last"], "└── ").otherwise("├── ")
    return marks.select("node", F.concat(stem, tip, T.filename("node")).alias("line"))


def tokens(df: DataFrame) -> DataFrame:
    return once(df, T.fallback_tokens("content").alias("gpt4_tokens"), T.words("content").alias("words"), *(T.family_tokens("content", f).alias(f"{f}_tokens") for f in ("claude", "gemini", "llama", "multibyte")))


def token_savings(before: DataFrame, after: DataFrame) -> DataFrame:
    """(files, tokens_before, tokens_after, saved, saved_share) of two relations (file_id, tokens), such as the plain and the compressed corpus."""
    a, b = before.agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens_before")), after.agg(F.sum("tokens").alias("tokens_after"))
    both = a.join(F.broadcast(b)).withColumn("saved", F.col("tokens_before") - F.col("tokens_after"))
    return both.withColumn("saved_share", F.round(F.coalesce(F.col("saved") / F.nullif("tokens_before", F.lit(0)), F.lit(0.0)), 6))


def costs(df: DataFrame, per_1k_input: float = 0.01, per_1k_output: float = 0.03, most: int = 500) -> DataFrame:
    """Expected tokens and cost of asking a model about each file."""
    per = once(df, T.fallback_tokens("content").alias("input_tokens")).withColumn("output_tokens", T.estimated_output("input_tokens", most))
    return per.withColumn("cost", F.round(F.col("input_tokens") / 1000 * per_1k_input + F.col("output_tokens") / 1000 * per_1k_output, 8))


def hashes(df: DataFrame) -> DataFrame:
    c = F.coalesce("content", F.lit(""))
    return once(df, F.sha2(c, 256).alias("sha256"), F.md5(c).alias("md5"))


def cache_keys(df: DataFrame, model: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """A key that comments and white space do not change; with a model, of a JSON text whose keys are in order."""
    bare = F.regexp_replace(F.coalesce("content", F.lit("")), r"//[^\n]*|#[^\n]*", "")
    own = F.sha2(F.lower(F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))), 256)
    if model is not None:
        fields = sorted({**(options or {}), "model": model}.items())
        before = [f'"{k}": "{v}"' for k, v in fields if k < "content"]
        after = [f'"{k}": "{v}"' for k, v in fields if k > "content"]
        own = F.sha2(F.concat(F.lit("{" + "".join(f"{x}, " for x in before) + '"content": "'), own, F.lit('"' + "".join(f", {x}" for x in after) + "}")), 256)
    return once(df, own.alias("cache_key"))


def split_output(df: DataFrame, parts: int = 3) -> DataFrame:
    """Lines of each file in ``parts`` runs of equal length, as a split sink writes them."""
    per = once(df, F.when(F.col("content").isNotNull(), F.size(T.lines("content"))).cast("bigint").alias("n")).filter("n is not null").withColumn("chunk", F.ceil(F.col("n") / parts))
    out = per.select("file_id", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / F.col("chunk")).cast("int"))).alias("part"), "n", "chunk")
    return out.select("file_id", "part", F.least(F.col("chunk"), F.col("n") - (F.col("part") - 1) * F.col("chunk")).alias("lines"))
