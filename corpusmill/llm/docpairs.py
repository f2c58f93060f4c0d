"""Functions paired with their documentation.

Each file is parsed once; a documented function gives a pair of code and description unless its
documentation is missing, empty or trivial (``prose.informative``). A method whose documentation is left
to the class it comes from (an inheritance tag, a Java or TypeScript method that says it overrides, or a
Python method of a derived class without docstring) is resolved by joining it to the same method of its
parents, level by level; what no ancestor documents is dropped. ``documented`` are the resolved pairs that
document themselves.

Defined results: files with null or blank content, of other endings or with invalid syntax give no rows; of a
file delivered twice the latest delivery counts; of several equally named parents in a repo the imported one
documents the method, else the one in the file with the lowest id.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import functions, lexers, prose, syntax
from corpusmill.llm.common import deliveries, per_file
from corpusmill.operators import files as K
from corpusmill.session import cut

_ROW = "language:string,name:string,kind:string,signature:string,start_line:int,description:string,code:string,owner:string,supers:array<struct<name:string,hint:string>>,own:boolean,role:string"
_INHERIT = re.compile(r"[@{]\s*@?inheritdoc", re.I)


def file_functions(path: str | None, content: str | None, bodyless: list | None = None, classes: list | None = None) -> tuple[str | None, list[tuple]]:
    """The documented functions of a file; nothing for one that does not parse. The lists receive methods without body and the classes."""
    language = lexers.language_of(path)
    if language in (None, "json", "yaml") or content is None or not (text := syntax.plain(content)).strip():
        return language, []
    if language == "python":
        tree = syntax.python_tree(text)
        if tree and classes is not None:
            classes += functions.hierarchy(language, text, None, tree)
        return language, functions.extract(language, text, None, tree) if tree else []
    scan = lexers.scan(language, text)
    if not syntax.valid(language, text, scan):
        return language, []
    if classes is not None:
        classes += functions.hierarchy(language, text, scan.spans)
    return language, functions.extract(language, text, scan.spans, None, bodyless, classes is not None)


def candidates(files: DataFrame, texts: bool = True) -> DataFrame:
    """Every function with its own documentation, or with one to inherit (own is false); without ``texts`` only what resolving needs.

    role: function, or what only helps to resolve: told (a documented method without body), class (one with supers).
    A super has the stem of the file from which its name is imported.
    """

    def kernel(paths, contents):
        out = []
        for path, content in zip(paths, contents):
            bodyless, classes, rows = [], [], []
            language, found_ = file_functions(path, content, bodyless, classes)
            hints = functions.import_hints(language, content) if classes or any(f[7] for f in found_) else {}

            def above(supers, hints=hints):
                return [(s, hints.get(s)) for s in supers]

            for name, line, doc, params, owner in bodyless:
                if prose.informative(doc, name, params):
                    rows.append((language, name, "method", None, line, doc.strip() if texts else None, None, owner, [], True, "told"))
            for name, line, supers in classes:
                rows.append((language, name, "class", None, line, None, None, name, above(supers), False, "class"))
            for name, kind, signature, line, doc, params, owner, supers, code in found_:
                own = prose.informative(doc, name, params)
                if own or (supers and owner and (doc is None or _INHERIT.search(doc))):
                    rows.append((language, name, kind, signature if texts else None, line, (doc or "").strip() if own and texts else None, code if texts else None, owner, above(supers), own, "function"))
            out.append(rows)
        return [[functions.stem_of(p) for p in paths], out]

    each = per_file(files, ["file_path", "content"], kernel, f"stem string, rows array<struct<{_ROW}>>")
    repo = per_file_columns(files, "repo")
    return each.select("file_id", "stem", F.explode("rows").alias("r")).select("file_id", "stem", "r.*").join(repo, "file_id")


def per_file_columns(files: DataFrame, *names: str) -> DataFrame:
    """(file_id, names) of the latest delivery; no content."""
    return K.once(deliveries(files).filter("file_id is not null"), *names)


def resolve(every: DataFrame, max_levels: int | None = None) -> DataFrame:
    """(file_id, start_line, name, from_file, from_line) of every documented function; its own place where it documents itself.

    Methods without documentation of their own climb the class hierarchy level by level, until none is open.
    A parent whose file is imported comes before another of that name in the repository; of several, that of
    the file with the lowest id. Pairs of method and class that were seen are not climbed again, so that
    circles end.
    """
    row = ["file_id", "start_line", "name"]
    functions_ = every.filter("role = 'function'")
    own = functions_.filter("own").select(*row, F.col("file_id").alias("from_file"), F.col("start_line").alias("from_line"))
    place = F.struct("file_id", "start_line")
    told = every.filter("own and owner is not null").groupBy("repo", F.col("owner").alias("parent"), "name", "stem").agg(F.min(place).alias("exact"))
    told_any = told.groupBy("repo", "parent", "name").agg(F.min("exact").alias("any"))
    above = every.filter("owner is not null").select("repo", F.col("owner").alias("parent"), F.explode("supers").alias("s")).select("repo", "parent", F.col("s.name").alias("next"), F.col("s.hint").alias("next_hint")).distinct()
    open_ = functions_.filter("not own").select(*row, "repo", F.explode("supers").alias("s")).select(*row, "repo", F.col("s.name").alias("parent"), F.col("s.hint").alias("hint"))
    resolved, seen, level = own, None, 0
    while max_levels is None or level < max_levels:
        level += 1
        hit = cut(open_.join(told_any, ["repo", "parent", "name"], "left").join(told.withColumnRenamed("stem", "hint"), ["repo", "parent", "name", "hint"], "left").withColumn("told", F.coalesce("exact", "any")).drop("exact", "any"))
        done = hit.filter("told is not null").groupBy(*row).agg(F.min(F.struct(F.col("hint").isNull(), "told")).alias("x")).select(*row, F.col("x.told.file_id").alias("from_file"), F.col("x.told.start_line").alias("from_line"))
        resolved = resolved.unionByName(done)
        seen = hit.select(*row, "parent") if seen is None else seen.unionByName(hit.select(*row, "parent"))
        step = hit.filter("told is null").join(above, ["repo", "parent"]).select(*row, "repo", F.col("next").alias("parent"), F.col("next_hint").alias("hint")).distinct()
        open_ = step.join(done, row, "left_anti").join(seen, [*row, "parent"], "left_anti")
        if open_.isEmpty():
            break
    return resolved


def documented(files: DataFrame) -> DataFrame:
    """(file_id, start_line) of every function whose own documentation is not trivial: of the resolved pairs those that document themselves."""
    pairs_ = resolve(cut(candidates(files, texts=False)))
    return pairs_.filter("file_id = from_file and start_line = from_line").select("file_id", "start_line").distinct()


def pairs(files: DataFrame, max_levels: int | None = None) -> DataFrame:
    """(file_id, language, name, kind, signature, start_line, description, code, inherited). Levels are joined until none is open; ``max_levels`` may stop before."""
    every = cut(candidates(files))
    shown = ["file_id", "language", "name", "kind", "signature", "start_line", "description", "code"]
    all_ = every.filter("role = 'function'").dropDuplicates(["file_id", "start_line", "name"])
    own = all_.filter("own").select(*shown, F.lit(False).alias("inherited"))
    far = resolve(every.drop("code", "description", "signature"), max_levels).filter("file_id <> from_file or start_line <> from_line")
    said = every.filter("own").select(F.col("file_id").alias("from_file"), F.col("start_line").alias("from_line"), "description").dropDuplicates(["from_file", "from_line"])
    inherited = all_.filter("not own").drop("description").join(far, ["file_id", "start_line", "name"]).join(said, ["from_file", "from_line"]).select(*shown, F.lit(True).alias("inherited"))
    return own.unionByName(inherited)
