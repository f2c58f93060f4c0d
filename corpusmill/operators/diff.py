"""Two states of a tree against each other: changed files, integrity, patches, Git references."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.order import ranked


def hashed(files: DataFrame) -> DataFrame:
    """(path, hash): contents leave the row as their SHA-256, so that no join carries them."""
    if "hash" in files.columns:
        return files.select("path", "hash")
    return files.select("path", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change, old_path) from two relations (path, content) or (path, hash): a full outer join on the path, then an exact rename by content.

    A file that disappeared and one that appeared with the same content are a rename, matched in path order:
    both sides are numbered within their hash and joined on (hash, number), however many files share one.
    """
    both = hashed(old).withColumnRenamed("hash", "old_hash").join(hashed(new).withColumnRenamed("hash", "new_hash"), "path", "full_outer")
    kept = both.filter("old_hash is not null and new_hash is not null and old_hash <> new_hash").select("path", F.lit("modified").alias("change"), F.lit(None).cast("string").alias("old_path"))
    gone = ranked(both.filter("new_hash is null").select(F.col("old_hash").alias("hash"), F.col("path").alias("was")), ["hash"], ["was"])
    came = ranked(both.filter("old_hash is null").select(F.col("new_hash").alias("hash"), F.col("path").alias("now")), ["hash"], ["now"])
    m = gone.join(came, ["hash", "n"], "full_outer")
    moved = m.select(F.coalesce("now", "was").alias("path"), F.when(F.col("now").isNull(), "deleted").when(F.col("was").isNull(), "added").otherwise("renamed").alias("change"), F.when(F.col("now").isNotNull(), F.col("was")).alias("old_path"))
    return kept.unionByName(moved)


def change_counts(changed: DataFrame) -> DataFrame:
    return changed.groupBy("change").agg(F.count("*").alias("files"))


def verify(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, verdict) of (path, sha256) against (path, content): match, mismatch, missing or unexpected; hashes ignore case."""
    a = hashed(actual).withColumnRenamed("hash", "found")
    both = manifest.select("path", F.lower("sha256").alias("expected")).join(a, "path", "full_outer")
    return both.select("path", F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.col("expected") == F.col("found"), "match").otherwise("mismatch").alias("verdict"))


def rows(old: DataFrame, new: DataFrame, binaries: bool = False, context: int = 3) -> DataFrame:
    """(path, change, old_path, binary, content, patch, additions, deletions) of every changed file.

    content is the new side, or the old one of a deleted file; a binary file (a NUL in either side) has
    neither content nor patch and is given only if ``binaries``. Contents are joined on their path.
    """
    what = changes(old, new)
    before, after = old.select(F.col("path").alias("_was"), F.col("content").alias("old")), new.select("path", F.col("content").alias("new"))
    both = what.withColumn("_was", F.coalesce("old_path", "path")).join(after, "path", "left").join(before, "_was", "left")
    binary = F.coalesce(F.col("old").contains("\x00"), F.lit(False)) | F.coalesce(F.col("new").contains("\x00"), F.lit(False))
    both = both.withColumn("binary", binary).filter(F.lit(True) if binaries else ~F.col("binary"))
    text = both.select("path", "change", "old_path", "binary", F.when(~F.col("binary"), F.when(F.col("change") == "deleted", F.col("old")).otherwise(F.col("new"))).alias("content"), F.when(F.col("binary") | (F.col("change") == "renamed"), None).otherwise(_diff(context)("path", "old", "new")).alias("patch"))
    return counted(text).fillna(0, ["additions", "deletions"])


def stats(changed: DataFrame) -> DataFrame:
    """(files, additions, deletions, binary and one count for each kind of change) of ``rows``."""
    return changed.agg(F.count("*").alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"), F.count_if("binary").alias("binary"), *(F.count_if(F.col("change") == k).alias(k) for k in ("added", "deleted", "modified", "renamed")))


def unified(old: str | None, new: str | None, path: str, context: int = 3) -> str:
    """A unified diff of two texts, of which one may be missing and has no lines then; common ends are set aside first, so that only what differs is compared."""
    import difflib

    a, b = (x.split("\n") if x is not None else [] for x in (old, new))
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    same = [("equal", 0, head, 0, head)] if head else []
    codes = [(k, i1 + head, i2 + head, j1 + head, j2 + head) for k, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a[head : len(a) - tail], b[head : len(b) - tail], False).get_opcodes()]
    end = [("equal", len(a) - tail, len(a), len(b) - tail, len(b))] if tail else []
    out: list[str] = []
    m = difflib.SequenceMatcher(None, [], [], False)
    m.opcodes = [*same, *codes, *end]  # grouped with their context by the library
    for group in m.get_grouped_opcodes(context):
        if not out:
            out += [f"--- a/{path}", f"+++ b/{path}"]
        spans = [(group[0][k], group[-1][k + 1]) for k in (1, 3)]
        shown = [f"{x + (y > x)}" if y - x == 1 else f"{x + (y > x)},{y - x}" for x, y in spans]
        out.append(f"@@ -{shown[0]} +{shown[1]} @@")
        for kind, i1, i2, j1, j2 in group:
            if kind == "equal":
                out += [" " + x for x in a[i1:i2]]
            else:
                out += ["-" + x for x in a[i1:i2]] + ["+" + x for x in b[j1:j2]]
    return "\n".join(out)


def _diff(context: int):
    @F.pandas_udf("string")
    def run(path: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([unified(a, c, p, context) for p, a, c in zip(path, old, new)], dtype=object)

    return run


def patches(old: DataFrame, new: DataFrame, context: int = 3) -> DataFrame:
    """(path, patch, additions, deletions) of files whose content changed; text diffs in Arrow batches."""
    pair = old.select("path", F.col("content").alias("old")).join(new.select("path", F.col("content").alias("new")), "path", "full_outer").filter("not old <=> new")
    return counted(pair.select("path", _diff(context)("path", "old", "new").alias("patch")))


def counted(patch: DataFrame) -> DataFrame:
    """Lines that a patch adds and removes; file headers do not count."""
    ls = F.split("patch", "\n")

    def of(sign: str):
        return F.when(F.col("patch").isNotNull(), F.size(F.filter(ls, lambda x: x.startswith(sign) & ~x.startswith(sign * 3)))).cast("bigint")

    return patch.withColumns({"additions": of("+"), "deletions": of("-")})


REF = r"^(?!-)(?!.*(?:\.\.|@\{|[\s~^:?*\[\\]|//))[\w./-]+$"


def valid_ref(ref: str) -> bool:
    """Whether a name can be a Git reference or commit; what Git would read as an option or a range is none."""
    import re

    return bool(re.match(REF, ref)) and not ref.endswith(("/", ".", ".lock"))
