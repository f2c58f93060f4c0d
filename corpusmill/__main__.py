"""Command line: run a tree into a document, read a document back, list what there is."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from corpusmill.operators import files as K
from corpusmill.operators import parse, render
from corpusmill.plans import pipeline
from corpusmill.session import local_session, ship
from corpusmill.sources import git, trees


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusmill")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="render a directory")
    run.add_argument("source")
    run.add_argument("target")
    run.add_argument("--format", choices=render.FORMATS, default="markdown")
    run.add_argument("--preset", choices=sorted(pipeline.PRESETS))
    run.add_argument("--config", help="a file of settings, JSON or YAML")
    run.add_argument("--include", action="append", default=[])
    run.add_argument("--whole", action="store_true", help="with head, contents, tree and indexes")
    run.add_argument("--exclude", action="append", default=[])
    run.add_argument("--include-language", action="append", default=[])
    run.add_argument("--exclude-language", action="append", default=[])
    run.add_argument("--parts", type=int, default=1)
    run.add_argument("--compression", choices=("none", "gzip", "bzip2"), default="none")
    back = sub.add_parser("reconstruct", help="write the files of a rendered document")
    back.add_argument("source")
    back.add_argument("target")
    back.add_argument("--format", choices=sorted(render.READERS), default="markdown")
    back.add_argument("--preview", type=int, default=0, help="only list so many files")
    sub.add_parser("formats")
    sub.add_parser("languages", help="languages by ending, and which have a parser")
    init = sub.add_parser("init", help="write a file of settings")
    init.add_argument("target")
    init.add_argument("--preset", choices=sorted(pipeline.PRESETS), default="medium")
    check = sub.add_parser("validate", help="check a file of settings and say where each comes from")
    check.add_argument("source")
    sides = sub.add_parser("diff", help="what changed between two Git references of a repository")
    sides.add_argument("repository")
    sides.add_argument("old")
    sides.add_argument("new")
    sides.add_argument("--binaries", action="store_true")
    look = sub.add_parser("diagnose", help="what the parsers make of a directory")
    look.add_argument("source")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "formats":
        print(*render.FORMATS, sep="\n")
        return 0
    if a.command == "languages":
        for ending, language in sorted(K.EXTENSIONS.items()):
            print(ending, language, "parsed" if language == "python" or language in parse.PATTERNS else "text")
        return 0
    if a.command == "init":
        with open(a.target, "x", encoding="utf-8") as f:
            json.dump({"format": "markdown", **pipeline.PRESETS[a.preset], "excludes": [], "includes": []}, f, indent=2)
        return 0
    if a.command == "validate":
        for name, source in pipeline.Spec.from_file(a.source).provenance:
            print(f"{name}: {source}")
        return 0
    spark = local_session()
    ship(spark)
    if a.command == "diff":
        git.changes(spark, a.repository, a.old, a.new, a.binaries).select("path", "change", "old_path", "additions", "deletions").orderBy("path").show(1000, truncate=False)
        return 0
    if a.command == "diagnose":
        parse.compared(parse.parses(trees.read_tree(spark, a.source))).orderBy("parser_type").show(truncate=False)
        return 0
    if a.command == "run":
        options = {"format": a.format, "whole_document": a.whole}
        options |= {k: tuple(v) for k, v in (("excludes", a.exclude), ("includes", a.include), ("include_languages", a.include_language), ("exclude_languages", a.exclude_language)) if v}
        spec = pipeline.Spec.from_file(a.config, a.preset, **options) if a.config else pipeline.Spec.of(a.preset, **options)
        document = pipeline.run(trees.read_tree(spark, a.source), spec)
        render.write(document, a.target, a.parts, a.compression)
        return 0
    documents = spark.read.text(a.source, wholetext=True).select(F.col("value").alias("document"))
    found = render.reconstruct(documents, a.format)
    if a.preview:
        found.select("path", F.length("content").alias("characters"), "safe").orderBy("path").limit(a.preview).show(truncate=False)
        return 0
    r = trees.write_tree(found, a.target).first()
    print(f"written {r.written or 0}, refused {r.refused or 0}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
