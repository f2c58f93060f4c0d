"""Sources: directory trees, archives, ignore files, repository addresses; and the sink that writes files back."""

from __future__ import annotations

import os
import re
import shutil
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import files as K
from corpusmill.operators.render import safe_path

MAX_BYTES = 20 * 1024 * 1024


def read_tree(spark: SparkSession, root: str, glob: str | None = None, max_bytes: int = MAX_BYTES, repo: str = "", prune: bool = False, includes: tuple[str, ...] = ()) -> DataFrame:
    """(file_id, repo, path, content) of the text files below a directory, or of one file; invalid UTF-8 is replaced.

    The size test reaches the source, so that large files are listed but never read (``left_out`` has them);
    what a walk would prune is left out by path before contents are decoded.
    """
    listed = listing(spark, root, glob)
    df = listed.filter(F.col("length") <= max_bytes)
    if prune:
        df = df.filter(~K.pruned_directory("name"))
    if includes:
        df = df.filter(K.matches_any("name", includes))
    return df.filter(~binary("content")).select(F.xxhash64("path").alias("file_id"), F.lit(repo).alias("repo"), F.col("name").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def listing(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Every file below a directory with its name relative to it; a file as root keeps its own name."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    base = root.rstrip("/") + "/"
    inside = F.regexp_replace("path", "^(?:file:)?/*" + re.escape(base.lstrip("/")), "")
    return r.load(root).withColumn("name", F.when(inside == F.col("path"), F.regexp_extract("path", r"([^/]*)$", 1)).otherwise(inside))


def left_out(spark: SparkSession, root: str, glob: str | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, bytes, reason) of the files that ``read_tree`` does not give: too_large or binary."""
    every = listing(spark, root, glob)
    large = every.filter(F.col("length") > max_bytes).select(F.col("name").alias("path"), F.col("length").alias("bytes"), F.lit("too_large").alias("reason"))
    blank = every.filter(F.col("length") <= max_bytes).filter(binary("content")).select(F.col("name").alias("path"), F.col("length").alias("bytes"), F.lit("binary").alias("reason"))
    return large.unionByName(blank)


def documents(files: DataFrame, endings: tuple[str, ...] = T.DOC_ENDINGS) -> DataFrame:
    """(file_id, repo, path, doc_type, content) of the documentation files: the other branch of a scan, which code filters drop."""
    return files.filter(T.ends_with_any(F.lower("path"), endings)).select("file_id", "repo", "path", F.lower(T.extension("path")).alias("doc_type"), "content")


#: Globs that are always ignored. Fixed values.
ALWAYS_IGNORED = ("**/__pycache__/**", "**/*.pyc", "**/.git/**", "**/node_modules/**", "**/.pytest_cache/**", "**/.coverage", "**/build/**", "**/dist/**", "**/*.egg-info/**")


def binary(content: Column | str, sample: int = 4096, share: float = 0.3) -> Column:
    """A NUL or too many bytes outside ASCII in the first bytes."""
    head = F.decode(F.substring(content, 1, sample), "ISO-8859-1")
    wide = F.length(F.regexp_replace(head, r"[\x00-\x7f]", ""))
    return head.contains("\x00") | (wide > share * F.length(head))


#: First bytes of formats that are not text. Fixed values.
SIGNATURES = {"elf": "7F454C46", "pe": "4D5A", "zip": "504B0304", "gzip": "1F8B", "png": "89504E47", "jpeg": "FFD8FF", "gif": "47494638", "pdf": "25504446", "class": "CAFEBABE", "bzip2": "425A68"}


def signature(content: Column | str) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit(None).cast("string")
    for name, magic in SIGNATURES.items():
        out = F.when(head.startswith(magic), name).otherwise(out)
    return out


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(pattern as one regular expression, keeps) of an ignore file; later rules win."""
    out = []
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#"):
            keep = line.startswith("!")
            out.append((T.glob_regex(line.lstrip("!").removeprefix("/") if not line.lstrip("!").startswith("/") else line.lstrip("!")[1:]), keep))
    return out


def ignored(path: Column | str, text: str) -> Column:
    """Whether an ignore file, or what is always ignored, covers a path; the last rule that matches decides."""
    p = F.col(path) if isinstance(path, str) else path
    out = F.lit(False)
    for regex, keep in [*ignore_rules(text), *((T.glob_regex(g), False) for g in ALWAYS_IGNORED)]:
        out = F.when(p.rlike(regex), F.lit(not keep)).otherwise(out)
    return out


def unzip(archive: str, target: str) -> str:
    """Extract an archive below a folder that executors share, refusing members that would leave it; returns the folder."""
    with zipfile.ZipFile(archive) as z:
        for n in z.namelist():
            if not n.endswith("/"):
                p = safe_path(n)
                if p is None:
                    raise ValueError(f"unsafe member {n!r}")
                full = os.path.join(target, p)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with z.open(n) as src, open(full, "wb") as dst:
                    shutil.copyfileobj(src, dst)
    return target


_ADDRESS = re.compile(r"^(?:https?://[^/]+/|git@[^:]+:|ssh://git@[^/]+/)?(?P<owner>[\w.-]+)/(?P<name>[\w.-]+?)(?:\.git)?(?:/(?:tree|blob)/(?P<ref>[^?#]+))?/?$")


def repository(address: str) -> tuple[str, str, str | None] | None:
    """(owner, name, ref) of a repository address or shorthand."""
    m = _ADDRESS.match(address.strip())
    return (m["owner"], m["name"], m["ref"]) if m else None


def write_tree(files: DataFrame, target: str) -> DataFrame:
    """Write (path, content) below a folder that all executors share; (written, refused) once counted."""

    def run(batches):
        import pandas as pd

        for b in batches:
            written = refused = 0
            for p, c in zip(b["path"], b["content"]):
                s = safe_path(p) if p else None
                full = os.path.join(target, s) if s else None
                if full is None or os.path.islink(full) or not os.path.abspath(full).startswith(os.path.abspath(target) + os.sep):
                    refused += 1
                    continue
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "w", encoding="utf-8", newline="") as f:
                    f.write(c or "")
                written += 1
            yield pd.DataFrame({"written": [written], "refused": [refused]})

    return files.select("path", "content").mapInPandas(run, "written bigint, refused bigint").agg(F.sum("written").alias("written"), F.sum("refused").alias("refused"))
