"""Imports as edges, and what imports what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import files as K

#: How each language names what it needs, at the start of a line; group 1 is the name.
IMPORTS = {
    "py": r"(?m)^[ \t]*(?:from|import)[ \t]+([A-Za-z_][\w.]*)",
    "js": r"(?m)^[ \t]*(?:import|export)\b[^'\"\n;]*['\"]([^'\"\n]+)['\"]",
    "ts": r"(?m)^[ \t]*(?:import|export)\b[^'\"\n;]*['\"]([^'\"\n]+)['\"]",
    "java": r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+)",
    "go": r"(?m)^[ \t]*import[ \t]+\"([^\"\n]+)\"",
    "rs": r"(?m)^[ \t]*use[ \t]+([\w:]+)",
    "c": r"(?m)^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]",
    "rb": r"(?m)^[ \t]*require(?:_relative)?[ \t]*['\"]([^'\"\n]+)['\"]",
}


def edges(files: DataFrame) -> DataFrame:
    """Distinct (path, repo, import)."""
    ext = F.regexp_extract("path", r"\.([^./]*)$", 1)
    found = F.lit(None).cast("array<string>")
    for e, p in IMPORTS.items():
        found = F.when(ext == e, F.regexp_extract_all("content", F.lit(p), F.lit(1))).otherwise(found)
    return K.once(files, "repo", "path", found.alias("found")).select("repo", "path", F.explode("found").alias("import")).distinct()


def imported_by(e: DataFrame) -> DataFrame:
    """(import, files, repos)."""
    return e.groupBy("import").agg(F.count("*").alias("files"), F.countDistinct("repo").alias("repos"))


def first_imports(e: DataFrame, n: int = 10) -> DataFrame:
    """(path, imports): up to ``n`` imports of each file in order of name; the limit is the feature."""
    return e.groupBy("repo", "path").agg(F.slice(F.sort_array(F.collect_set("import")), 1, n).alias("imports"))


def type_edges(schema: DataFrame) -> DataFrame:
    """(owner, field, target) of type definitions (owner, field, type): each reference to a type that is defined, wrappers left out."""
    bare = F.regexp_replace("type", r"[\[\]!\s]", "")
    known = schema.select(F.col("owner").alias("target")).distinct()
    return schema.select("owner", "field", bare.alias("target")).join(known, "target", "left_semi").select("owner", "field", "target")


def referring(edges_: DataFrame, target: str) -> DataFrame:
    """Types that refer to a type."""
    return edges_.filter(F.col("target") == target).select("owner").distinct()
