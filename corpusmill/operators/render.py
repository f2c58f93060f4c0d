"""Rendering files to Markdown, JSON, XML and text, and reading such documents back.

A document is a relation of ordered chunks (part, repo, n, path, chunk), so that no task ever holds a corpus:
``chunks`` gives one a file, ``document`` adds the head, contents, statistics, tree, indexes and relationships
around them; ``write`` puts them into part files in order. Contents are shuffled once, when they meet their
number; files are numbered within their repository, whatever its size.

Optional columns of the input are shown where they are: ``found`` (findings), ``declared`` (declarations),
``summary``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import files as K
from corpusmill.operators import graph, order
from corpusmill.operators.files import language_by_extension

FORMATS = ("markdown", "json", "xml", "text")
#: Marks of severities from info to critical. Fixed values.
BADGES = ("ℹ️", "🟢", "🟡", "🟠", "🔴")
SEVERITY = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")


def badge(severity: Column | str) -> Column:
    """The mark of a severity from 0 to 4."""
    s = F.col(severity) if isinstance(severity, str) else severity
    return F.coalesce(F.get(F.array(*map(F.lit, BADGES)), s), F.lit("❓"))


def severity_name(severity: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, SEVERITY)), severity), F.lit("INFO"))


def _fence(c: Column) -> Column:
    runs = F.transform(F.regexp_extract_all(c, F.lit("`+"), F.lit(0)), lambda x: F.length(x))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _cdata(c: Column) -> Column:
    return F.concat(F.lit("<![CDATA["), F.replace(c, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def numbered_lines(content: Column | str) -> Column:
    """Each line behind its number."""
    return F.array_join(F.transform(T.lines(content), lambda x, i: F.concat(F.format_string("%4d | ", i + 1), x)), "\n")


def _joined(items: Column, line, sep: str = "\n") -> Column:
    return F.array_join(F.transform(items, line), sep)


def declaration_tree(declared: Column | str) -> Column:
    """Declarations as an indented list, children below their parents."""
    d = F.col(declared) if isinstance(declared, str) else declared
    return _joined(d, lambda x: F.concat(F.repeat(F.lit("  "), x["depth"]), F.lit("- **"), x["kind"], F.lit("** `"), x["name"], F.lit("` (lines "), x["start_line"].cast("string"), F.lit("-"), x["end_line"].cast("string"), F.lit(")")))


def _some(c: str, present: set[str], made: Column) -> Column:
    """A part that is left out where its column is missing or empty."""
    return F.when(F.size(c) > 0, made).otherwise("") if c in present else F.lit("")


def _of_severity(k: int) -> Column:
    return F.size(F.filter("found", lambda x: x["severity"] == k))


def _markdown(present: set[str], c: Column, language: Column, lines: Column, size: Column) -> Column:
    nav = F.concat(F.lit("[↑ Contents](#contents)"), F.coalesce(F.concat(F.lit(" | [← Previous](#"), "prev_anchor", F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(" | [Next →](#"), "next_anchor", F.lit(")")), F.lit("")))
    summary = F.coalesce(F.concat(F.lit("> "), F.replace("summary", F.lit("\n"), F.lit("\n> ")), F.lit("\n\n")), F.lit("")) if "summary" in present else F.lit("")
    declared = _some("declared", present, F.concat(F.lit("<details>\n<summary>Declarations</summary>\n\n"), declaration_tree("declared") if "declared" in present else F.lit(""), F.lit("\n</details>\n\n")))
    found = _some("found", present, F.concat(F.lit("<details>\n<summary>Findings</summary>\n\n"), _joined(F.col("found"), lambda x: F.concat(F.lit("- "), badge(x["severity"]), F.lit(" **Line "), x["line_no"].cast("string"), F.lit("**: "), x["rule"])) if "found" in present else F.lit(""), F.lit("\n</details>\n\n")))
    counts = F.concat(*([F.lit("\n| declarations | "), F.size("declared").cast("string"), F.lit(" |")] if "declared" in present else []), *([F.lit("\n| findings | "), F.size("found").cast("string"), F.lit(" |")] if "found" in present else []), F.lit(""))
    table = F.concat(F.lit("| property | value |\n| --- | --- |\n| language | "), F.when(language == "", "unknown").otherwise(language), F.lit(" |\n| lines | "), lines.cast("string"), F.lit(" |\n| size | "), T.human_size(size), F.lit(" |\n| type | "), T.category("path"), F.lit(" |"), counts, F.lit("\n\n"))
    return F.concat(F.lit("### "), F.col("n").cast("string"), F.lit(". "), F.col("path"), F.lit(" {#"), T.anchor("path"), F.lit("}\n\n"), nav, F.lit("\n\n"), summary, table, declared, found, _fence(c), language, F.lit("\n"), c, F.lit("\n"), _fence(c), F.lit("\n"))


def _json(present: set[str], c: Column, language: Column, lines: Column, size: Column) -> Column:
    fields = [F.col("path").alias("file_path"), language.alias("language"), F.struct(F.col("path").alias("path"), T.directory("path").alias("directory"), T.filename("path").alias("filename"), T.extension("path").alias("extension"), language.alias("language"), size.alias("size_bytes"), lines.alias("line_count"), T.category("path").alias("type")).alias("metadata")]
    if "declared" in present:
        kids = lambda d: F.size(F.filter("declared", lambda x: (x["parent"] == d["name"]) & (x["depth"] == d["depth"] + 1) & x["start_line"].between(d["start_line"], d["end_line"])))
        each = F.transform("declared", lambda d: F.struct(d["name"].alias("name"), d["kind"].alias("type"), F.array(d["start_line"], d["end_line"]).alias("line_range"), kids(d).alias("children_count")))
        fields.append(F.when(F.size("declared") > 0, F.struct(F.size("declared").alias("declaration_count"), each.alias("declarations"))).alias("analysis"))
    if "found" in present:
        by = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(s).alias("key"), _of_severity(k).alias("value")) for k, s in enumerate(SEVERITY))), lambda e: e["value"] > 0))
        issues = F.transform("found", lambda x: F.struct(x["rule"].alias("rule"), severity_name(x["severity"]).alias("severity"), x["line_no"].alias("line")))
        fields.append(F.when(F.size("found") > 0, F.struct(F.size("found").alias("issue_count"), by.alias("by_severity"), issues.alias("issues"))).alias("security"))
    if "summary" in present:
        fields.append(F.col("summary"))
    return F.to_json(F.struct(*fields, c.alias("content")))


def _xml_entry(present: set[str], c: Column, language: Column, lines: Column, size: Column) -> Column:
    declared = _some("declared", present, F.concat(F.lit("<declarations>"), _joined(F.col("declared"), lambda x: F.concat(F.lit('<declaration kind="'), _xml(x["kind"]), F.lit('" name="'), _xml(x["name"]), F.lit('" lines="'), x["start_line"].cast("string"), F.lit("-"), x["end_line"].cast("string"), F.lit('"/>')), "") if "declared" in present else F.lit(""), F.lit("</declarations>")))
    found = _some("found", present, F.concat(F.lit("<security_issues>"), _joined(F.col("found"), lambda x: F.concat(F.lit('<issue rule="'), _xml(x["rule"]), F.lit('" severity="'), severity_name(x["severity"]), F.lit('" line="'), x["line_no"].cast("string"), F.lit('"/>')), "") if "found" in present else F.lit(""), F.lit("</security_issues>")))
    meta = F.concat(F.lit("<file_metadata><path>"), _xml(F.col("path")), F.lit("</path><language>"), language, F.lit("</language><type>"), T.category("path"), F.lit("</type><line_count>"), lines.cast("string"), F.lit("</line_count><size_bytes>"), size.cast("string"), F.lit("</size_bytes></file_metadata>"))
    return F.concat(F.lit('<file_entry id="'), F.col("n").cast("string"), F.lit('">'), meta, declared, found, F.lit("<file_content>"), _cdata(c), F.lit("</file_content></file_entry>"))


def _plain(present: set[str], c: Column, language: Column, lines: Column, size: Column) -> Column:
    bar = "=" * 80
    declared = _some("declared", present, F.concat(F.lit("declarations: "), _joined(F.col("declared"), lambda x: F.concat(x["kind"], F.lit(" "), x["name"]), ", ") if "declared" in present else F.lit(""), F.lit("\n")))
    found = _some("found", present, F.concat(F.lit("findings: "), F.size("found").cast("string") if "found" in present else F.lit(""), F.lit("\n")))
    return F.concat(F.lit(bar + "\nFILE "), F.col("n").cast("string"), F.lit("/"), F.col("of").cast("string"), F.lit(": "), F.col("path"), F.lit("\n"), F.when(language == "", "unknown").otherwise(language), F.lit(", "), lines.cast("string"), F.lit(" lines, "), T.human_size(size), F.lit("\n"), declared, found, F.lit(bar + "\n"), c, F.lit("\n"))


_CHUNK = {"markdown": _markdown, "json": _json, "xml": _xml_entry, "text": _plain}


def chunks(files: DataFrame, kind: str, listed: DataFrame | None = None) -> DataFrame:
    """(repo, n, path, chunk): one chunk a file, numbered in path order by repo.

    ``listed`` has the same files, so that their numbers need not wait for what was done to their contents.
    """
    if kind not in _CHUNK:
        raise ValueError(f"unknown format {kind!r}")
    per = K.once(files if listed is None else listed, "repo", "path")
    number = order.ranked(per.withColumn("anchor", T.anchor("path")), ["repo"], ["path", "file_id"], {"anchor": "anchor"})
    if kind == "text":
        number = number.join(per.groupBy(F.col("repo").alias("_r")).agg(F.count("*").alias("of")), F.col("repo").eqNullSafe(F.col("_r"))).drop("_r")
    here = files.join(number.drop("repo", "path", "anchor"), "file_id")
    c = F.coalesce("content", F.lit(""))
    chunk = _CHUNK[kind](set(files.columns), c, F.coalesce(language_by_extension("path"), F.lit("")), T.line_count("content"), F.octet_length(c).cast("bigint"))
    return K.once(here, "repo", "n", "path", chunk.alias("chunk")).select("repo", "n", "path", "chunk")


def _part(df: DataFrame, part: int, chunk: Column, n: Column | str = "n", path: Column | str | None = None) -> DataFrame:
    return df.select(F.lit(part).alias("part"), (F.col(n) if isinstance(n, str) else n).cast("bigint").alias("n"), (F.col(path) if isinstance(path, str) else F.lit("") if path is None else path).alias("path"), chunk.alias("chunk"))


def _members(rows: DataFrame, opening, closing, sep: Column) -> DataFrame:
    """(n, chunk) of grouped members (index, key, member): each member once, the first of a key opened, the last closed."""
    keys = order.ranked(rows.groupBy("index", "key").agg(F.count("*").alias("of")), ["index"], ["key"]).withColumnRenamed("n", "key_n")
    placed = order.ranked(rows, ["index", "key"], ["member"])
    both = placed.join(keys.select(F.col("index").alias("_i"), F.col("key").alias("_k"), "of", "key_n"), F.col("index").eqNullSafe(F.col("_i")) & F.col("key").eqNullSafe(F.col("_k"))).drop("_i", "_k")
    first, last = F.col("n") == 1, F.col("n") == F.col("of")
    return both.select("index", "key", "key_n", "n", F.concat(F.when(first, opening).otherwise(sep), F.to_json(F.struct(F.col("member").alias("m"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("member").alias("m")))) - 6) if closing == "json" else F.col("member"), F.when(last, "]" if closing == "json" else "").otherwise("")).alias("chunk"))


def _quoted(c: Column) -> Column:
    j = F.to_json(F.struct(c.alias("m")))
    return j.substr(F.lit(6), F.length(j) - 6)


def document(files: DataFrame, kind: str, title: str = "Corpus report", listed: DataFrame | None = None) -> DataFrame:
    """(part, n, path, chunk): a whole document in the order of part, n and path.

    Parts: 0 head and statistics, 1 contents, 2 directory tree, 3 index of files, 4 files, 5 relationships,
    6 indexes, 7 foot. Files are in order of path over the whole corpus.
    """
    one, base = files.withColumn("repo", F.lit("")), files if listed is None else listed
    fixed = files.sparkSession.range(1)
    per = K.once(base, "path", T.line_count("content").alias("lines"), F.octet_length(F.coalesce("content", F.lit(""))).cast("bigint").alias("bytes"))
    stats = K.stats(base)
    body = _part(chunks(one, kind, None if listed is None else listed.withColumn("repo", F.lit(""))), 4, F.col("chunk"), path="path")
    tree = K.drawn_tree(per)
    edges = graph.edges(base.withColumn("repo", F.lit("")))
    if kind == "markdown":
        rows = [(k, F.col(k)) for k in ("files", "lines", "bytes", "languages", "average_size", "source_files", "doc_files")]
        head = _part(stats, 0, F.concat(F.lit(f"# {title}\n\n**Files**: "), F.col("files").cast("string"), F.lit("\n\n| metric | value |\n| --- | --- |\n"), F.concat_ws("\n", *(F.concat(F.lit(f"| {k} | "), c.cast("string"), F.lit(" |")) for k, c in rows)), F.lit("\n\n## Contents {#contents}\n")), F.lit(0))
        toc = _part(order.ranked(per.select("path", "file_id", F.lit("").alias("g")), ["g"], ["path", "file_id"]), 1, F.concat(F.lit("- ["), F.col("n").cast("string"), F.lit(". "), F.col("path"), F.lit("](#"), T.anchor("path"), F.lit(")")))
        drawn = _part(tree, 2, F.col("line"), F.lit(1), "node").unionByName(_part(fixed, 2, F.lit("\n## Directory structure\n\n<details>\n\n```"), F.lit(0))).unionByName(_part(fixed, 2, F.lit("```\n</details>\n"), F.lit(2)))
        grouped = order.ranked(per.withColumn("category", T.category("path")), ["category"], ["path", "file_id"])
        index = _part(grouped, 3, F.concat(F.when(F.col("n") == 1, F.concat(F.lit("\n### "), F.initcap("category"), F.lit("\n\n| # | file | size |\n| --- | --- | --- |\n"))).otherwise(""), F.lit("| "), F.col("n").cast("string"), F.lit(" | ["), F.col("path"), F.lit("](#"), T.anchor("path"), F.lit(") | "), T.human_size("bytes"), F.lit(" |")), F.lit(1), F.concat("category", F.lit("\x00"), "path"))
        opened = _part(fixed, 3, F.lit("\n## File index\n"), F.lit(0)).unionByName(_part(fixed, 4, F.lit("\n## Files\n"), F.lit(0)))
        uses = _part(fixed, 5, F.lit("\n## Relationships\n"), F.lit(0)).unionByName(_part(edges, 5, F.concat(F.lit("- `"), F.col("path"), F.lit("` → `"), F.col("import"), F.lit("`")), F.lit(1), F.concat("path", F.lit("\x00"), "import")))
        parts = [head, toc, drawn, index, opened, body, uses]
    elif kind == "text":
        bar = "=" * 80
        head = _part(stats, 0, F.concat(F.lit(f"{bar}\n{title}\n{bar}\nfiles: "), F.col("files").cast("string"), F.lit("\nlines: "), F.col("lines").cast("string"), F.lit("\nsize: "), T.human_size("bytes"), F.lit("\nlanguages: "), F.col("languages").cast("string"), F.lit("\n\nDIRECTORY TREE\n")), F.lit(0))
        toc = _part(fixed, 3, F.lit("\nFILE INDEX\n"), F.lit(0)).unionByName(_part(order.ranked(per.select("path", "file_id", F.lit("").alias("g")), ["g"], ["path", "file_id"]), 3, F.concat(F.format_string("%6d. ", F.col("n")), F.col("path"))))
        parts = [head, _part(tree, 2, F.col("line"), F.lit(1), "node"), toc, body]
    elif kind == "xml":
        head = _part(stats, 0, F.concat(F.lit(f"<repository><title>{title}</title><statistics>"), *(F.concat(F.lit(f"<{k}>"), F.col(k).cast("string"), F.lit(f"</{k}>")) for k in ("files", "lines", "bytes", "languages")), F.lit("</statistics><files>")), F.lit(0))
        shut = _part(fixed, 5, F.lit("</files><relationships>"), F.lit(0)).unionByName(_part(fixed, 7, F.lit("</relationships></repository>"), F.lit(0)))
        uses = _part(edges, 5, F.concat(F.lit('<imports file="'), _xml(F.col("path")), F.lit('" name="'), _xml(F.col("import")), F.lit('"/>')), F.lit(1), F.concat("path", F.lit("\x00"), "import"))
        parts = [head, body, uses, shut]
    else:
        numbers = F.to_json(F.struct(F.col("files").alias("total_files"), F.col("lines").alias("total_lines"), F.col("bytes").alias("total_bytes"), F.col("languages").alias("unique_languages"), F.col("average_size").alias("average_file_size")))
        cats = K.category_counts(base)
        counted = stats.join(F.broadcast(cats))
        head = _part(counted, 0, F.concat(F.lit('{"metadata":{"version":"2.0","title":'), _quoted(F.lit(title)), F.lit(',"config":{"format":"json","sorting_enabled":true}},"statistics":'), numbers, F.lit(',"repository":{"file_count":'), F.col("files").cast("string"), F.lit(',"categories":'), F.to_json(F.struct(*cats.columns)), F.lit('},"files":[')), F.lit(0))
        rows = body.withColumn("chunk", F.concat(F.when(F.col("n") > 1, ",").otherwise(""), "chunk"))
        imports = _members(edges.select(F.lit("imports").alias("index"), F.col("path").alias("key"), F.col("import").alias("member")).unionByName(edges.select(F.lit("imported_by").alias("index"), F.col("import").alias("key"), F.col("path").alias("member"))), F.concat(F.when(F.col("key_n") > 1, ",").otherwise(""), _quoted(F.col("key")), F.lit(":[")), "json", F.lit(","))
        named = per.withColumns({"by_language": F.coalesce(language_by_extension("path"), F.lit("unknown")), "by_type": T.category("path"), "by_directory": T.directory("path")})
        each = named.select(F.explode(F.array(*(F.struct(F.lit(i).alias("index"), F.col(i).alias("key"), F.col("path").alias("member")) for i in ("by_directory", "by_language", "by_type")))).alias("x")).select("x.*").distinct()
        lists = _members(each, F.concat(F.when(F.col("key_n") > 1, ",").otherwise(""), _quoted(F.col("key")), F.lit(":[")), "json", F.lit(","))

        def section(df: DataFrame, part: int, names: tuple[str, ...], before: str, after: str) -> list[DataFrame]:
            out = [_part(fixed, part, F.lit(before), F.lit(0))]
            for k, name in enumerate(names):
                out.append(_part(fixed, part, F.lit(("," if k else "") + f'"{name}":' + "{"), F.lit(3 * k + 1)))
                out.append(df.filter(F.col("index") == name).select(F.lit(part).alias("part"), F.lit(3 * k + 2).cast("bigint").alias("n"), F.format_string("%012d:%012d", "key_n", "n").alias("path"), "chunk"))
                out.append(_part(fixed, part, F.lit("}"), F.lit(3 * k + 3)))
            return [*out, _part(fixed, part, F.lit(after), F.lit(3 * len(names) + 1))]

        with_ = []
        for name, column in (("with_issues", "found"), ("with_declarations", "declared")):
            if column in files.columns:
                some = K.once(files, "path", (F.size(column) > 0).alias("some")).filter("some").select(F.lit(name).alias("index"), F.lit(name).alias("key"), F.col("path").alias("member"))
                with_.append(_members(some, F.lit(""), "json", F.lit(",")).withColumn("chunk", F.regexp_replace("chunk", r"\]$", "")).select("index", "chunk", F.format_string("%012d", "n").alias("path")))
        parts = [head, rows, *section(imports, 5, ("imported_by", "imports"), '],"relationships":{', "}"), *section(lists, 6, ("by_directory", "by_language", "by_type"), ',"indexes":{', "")]
        for k, w in enumerate(with_):
            name = "with_issues" if k == 0 and "found" in files.columns else "with_declarations"
            parts += [_part(fixed, 6, F.lit(f',"{name}":['), F.lit(20 + 3 * k)), w.select(F.lit(6).alias("part"), F.lit(21 + 3 * k).cast("bigint").alias("n"), "path", "chunk"), _part(fixed, 6, F.lit("]"), F.lit(22 + 3 * k))]
        parts.append(_part(fixed, 7, F.lit("}}"), F.lit(0)))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def write(rendered: DataFrame, path: str, parts: int | None = None, compression: str = "none") -> None:
    """Part files in order; ``parts`` bounds their number, ``compression`` is none, gzip or bzip2."""
    if compression not in ("none", "gzip", "bzip2"):
        raise ValueError(f"unknown compression {compression!r}")
    keys = ["part", "n", "path"] if "part" in rendered.columns else ["repo", "path"]
    ordered = rendered.repartitionByRange(*([parts] if parts else []), *keys)
    ordered.sortWithinPartitions(*keys).select("chunk").write.option("compression", compression).text(path)


_HEADER = re.compile(r"^### \d+\. (.+?) \{#[^}]*\}\s*$", re.M)
_OPEN = re.compile(r"^(`{3,}|~{3,})([^\n]*)$", re.M)


def read_markdown(document: str) -> dict[str, str]:
    """Path -> content of a rendered document; the outermost fence of each section counts, one of a diff does not.

    A fence longer than three marks ends at the first that closes it, so that its content may hold headers; one
    of three marks ends at the last of its section.
    """
    out = {}
    at = 0
    while h := _HEADER.search(document, at):
        after = _HEADER.search(document, h.end())
        at = h.end()
        o = _OPEN.search(document, h.end(), after.start() if after else len(document))
        while o and o[2].strip() == "diff":
            end = re.compile(rf"^{re.escape(o[1])}[ \t]*$", re.M).search(document, o.end())
            o = _OPEN.search(document, end.end(), after.start() if after else len(document)) if end else None
        if not o:
            continue
        close = re.compile(rf"^{re.escape(o[1][0])}{{{len(o[1])},}}[ \t]*$", re.M)
        if len(o[1]) > 3:
            end = close.search(document, o.end())
        else:
            ends = list(close.finditer(document, o.end(), after.start() if after else len(document)))
            end = ends[-1] if ends else None
        if end:
            out[h[1]] = document[o.end() + 1 : max(end.start() - 1, o.end() + 1)]
            at = end.end()
    return out


def _xml_trees(document: str):
    """The root of a document, of a document without a root, or of every entry by itself where the whole is broken."""
    from xml.etree import ElementTree

    bare = re.sub(r"<\?xml[^>]+\?>", "", document)
    clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "�", bare)
    for text in (clean, f"<r>{clean}</r>"):
        try:
            yield ElementTree.fromstring(text)
            return
        except ElementTree.ParseError:
            continue
    for m in re.finditer(r"<file_entry\b[\s\S]*?</file_entry>", clean):
        try:
            yield ElementTree.fromstring(m[0])
        except ElementTree.ParseError:
            continue


def _raw_entries(document: str) -> Iterator[tuple[str, str]]:
    """Entries as this module writes them: contents in CDATA keep carriage returns and control characters, which an XML reader changes."""
    import html

    for m in re.finditer(r"<file_entry id=\"\d+\"><file_metadata><path>([^<]*)</path>(?:(?!<file_content>)[\s\S])*?<file_content>((?:<!\[CDATA\[(?:(?!\]\]>)[\s\S])*\]\]>)+)</file_content></file_entry>", document):
        yield html.unescape(m[1]), "".join(re.findall(r"<!\[CDATA\[((?:(?!\]\]>)[\s\S])*)\]\]>", m[2]))


def read_xml(document: str) -> dict[str, str]:
    """Path -> content: entries as they are written here, else elements ``file`` or any element with a path and a content."""
    own = dict(_raw_entries(document))
    if own:
        return own
    out: dict[str, str] = {}
    for root in _xml_trees(document):
        elements = [*root.iter("file_entry")] or root.findall(".//files/file") or [*root.iter("file")] or [e for e in root.iter() if e.get("path") and e.find("content") is not None]
        for e in elements:
            named = e.find(".//file_metadata/path")
            path = named.text if named is not None and named.text else next((e.get(k) for k in ("path", "name", "filename", "filepath") if e.get(k)), None)
            if not path:
                continue
            held = next((x for x in (e.find(".//file_content"), e.find("content"), e.find("code")) if x is not None and x.text is not None), None)
            content = held.text if held is not None else e.text if e.text and e.text.strip() else None
            if content is not None:
                out[path] = content
    return out


def _entries(value) -> Iterator[tuple[str, str]]:
    if isinstance(value, dict):
        path = next((value[k] for k in ("file_path", "path", "filepath", "name", "filename") if isinstance(value.get(k), str)), None)
        content = next((value[k] for k in ("content", "code", "text", "source") if isinstance(value.get(k), str)), None)
        if path is not None and content is not None:
            yield path, content
        else:
            for k, v in value.items():
                if isinstance(v, str) and ("/" in k or "." in k):
                    yield k, v
                else:
                    yield from _entries(v)
    elif isinstance(value, list):
        for v in value:
            yield from _entries(v)


def read_json(document: str) -> dict[str, str]:
    """Path -> content of one JSON document, or of one object a line."""
    try:
        return dict(_entries(json.loads(document)))
    except ValueError:
        return dict(e for line in document.splitlines() if line.strip() for e in _entries(json.loads(line)))


READERS = {"markdown": read_markdown, "json": read_json, "xml": read_xml}


def safe_path(path: str) -> str | None:
    """A relative path that stays inside its root, or None: decoded up to three times, normalised, without drives or parent parts."""
    import unicodedata
    from urllib.parse import unquote

    p = path
    for _ in range(3):
        q = unquote(p)
        if q == p:
            break
        p = q
    p = unicodedata.normalize("NFKC", p).lstrip("/")
    if not p or len(p) > 4096 or "\x00" in p or "\\" in p or re.match(r"^[A-Za-z]:", p) or any(x == ".." for x in p.split("/")):
        return None
    return p


def safe_paths(path: Column | str) -> Column:
    """``safe_path`` as a column."""

    @F.pandas_udf("string")
    def run(paths: pd.Series) -> pd.Series:
        return pd.Series([safe_path(p) if p is not None else None for p in paths], dtype=object)

    return run(path)


def reconstruct(documents: DataFrame, kind: str, column: str = "document") -> DataFrame:
    """(path, content, safe) of every file in rendered documents; unsafe paths are kept and marked."""
    read = READERS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, c, safe_path(p) is not None) for doc in b[column] if doc for p, c in read(doc).items()]
            yield pd.DataFrame(rows, columns=["path", "content", "safe"])

    return documents.select(column).mapInPandas(run, "path string, content string, safe boolean")
