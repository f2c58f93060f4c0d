"""Git repositories as sources: addresses, a clone beside the driver, two references against each other.

Cloning and reading objects is staging that happens before Spark reads anything; contents reach Spark as rows
or as a directory that executors share.
"""

from __future__ import annotations

import os
import re
import subprocess
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import diff
from corpusmill.sources import trees


class GitError(RuntimeError):
    """A git command that failed or took too long."""


def run(*args: str, cwd: str | None = None, timeout: int = 300) -> bytes:
    """The output of a git command; no prompts, no credentials in error messages."""
    env = {**os.environ, "GIT_TERMINAL_PROMPT": "0"}
    try:
        done = subprocess.run(["git", *args], cwd=cwd, env=env, capture_output=True, timeout=timeout)
    except (OSError, subprocess.TimeoutExpired) as e:
        raise GitError(hidden(str(e))) from None
    if done.returncode:
        raise GitError(hidden(done.stderr.decode(errors="replace").strip()))
    return done.stdout


def hidden(text: str) -> str:
    """A text without the credentials of the addresses in it."""
    return re.sub(r"(://)[^/@\s]+@", r"\1****@", text)


def with_token(address: str, token: str | None) -> str:
    return re.sub(r"^https://", f"https://{token}@", address) if token else address


def clone(address: str, target: str, ref: str | None = None, token: str | None = None, depth: int | None = 1, timeout: int = 300) -> str:
    """A shallow clone into a new folder; returns the folder."""
    if ref is not None and not diff.valid_ref(ref):
        raise ValueError(f"invalid reference {ref!r}")
    run("clone", "--quiet", *(["--depth", str(depth)] if depth else []), *(["--branch", ref] if ref else []), "--", with_token(address, token), target, timeout=timeout)
    return target


def clone_async(pool: ThreadPoolExecutor, *args, **options) -> Future:
    """The same in a pool of threads."""
    return pool.submit(clone, *args, **options)


def read_repository(spark: SparkSession, address: str, target: str, **options) -> DataFrame:
    """Clone into a folder that executors share, then read it as a tree."""
    owner, name, ref = trees.repository(address) or ("", os.path.basename(address.rstrip("/")), None)
    where = address if "://" in address or address.startswith("git@") or os.path.exists(address) else f"https://github.com/{owner}/{name}"
    return trees.read_tree(spark, clone(where, target, ref, **options), repo=name)


def validate_refs(repository: str, *refs: str) -> list[str]:
    """Which of some references are none."""
    bad = []
    for r in refs:
        try:
            if not diff.valid_ref(r):
                raise GitError("name")
            run("rev-parse", "--verify", "--quiet", f"{r}^{{commit}}", cwd=repository)
        except GitError:
            bad.append(r)
    return bad


def changed_paths(repository: str, old: str, new: str) -> list[str]:
    out = run("diff", "--name-only", "-z", "--no-renames", old, new, "--", cwd=repository)
    return sorted(x.decode("utf-8", "replace") for x in out.split(b"\0") if x)


def snapshot(spark: SparkSession, repository: str, ref: str, paths: list[str] | None = None) -> DataFrame:
    """(path, content) of the files of a reference, all or some; what is no UTF-8 keeps a NUL, so that it counts as binary."""
    listed = paths if paths is not None else [x.decode("utf-8", "replace") for x in run("ls-tree", "-r", "-z", "--name-only", ref, cwd=repository).split(b"\0") if x]
    rows = []
    for p in listed:
        try:
            raw = run("show", f"{ref}:{p}", cwd=repository)
        except GitError:
            continue  # not in this reference
        text = raw.decode("utf-8", "replace")
        rows.append((p, text if b"\0" in raw or raw.decode("utf-8", "ignore").encode() == raw else text + "\0"))
    return spark.createDataFrame(rows, "path string, content string")


def changes(spark: SparkSession, repository: str, old: str, new: str, binaries: bool = False) -> DataFrame:
    """``diff.rows`` of two references, with their names; only changed files are read."""
    if bad := validate_refs(repository, old, new):
        raise ValueError(f"no such reference: {', '.join(bad)}")
    paths = changed_paths(repository, old, new)
    out = diff.rows(snapshot(spark, repository, old, paths), snapshot(spark, repository, new, paths), binaries)
    return out.withColumns({"from_ref": F.lit(old), "to_ref": F.lit(new)})


_HOST = r"^(?:https?://(?:www\.)?[^/]+/|git@[^:/]+:|ssh://git@[^/]+/)?"


def address_parts(address: Column | str) -> Column:
    """struct(owner, name, ref) of an address or shorthand, as a column; nulls where it is none.

    owner/name, owner/name#ref, owner/name/ref, addresses with /tree/ref or /-/tree/ref, and the git@ form.
    """
    a = F.trim(F.col(address) if isinstance(address, str) else address)
    full = a.rlike(r"^(?:https?://|git@|ssh://)")
    rest = F.regexp_replace(a, _HOST, "")
    owner, name = F.regexp_extract(rest, r"^([^/#]+)/", 1), F.regexp_replace(F.regexp_extract(rest, r"^[^/#]+/([^/#]+)", 1), r"\.git$", "")
    tail = F.when(full, F.regexp_extract(rest, r"^[^/]+/[^/]+/(?:-/)?tree/([^?#]+?)/?$", 1)).otherwise(F.coalesce(F.nullif(F.regexp_extract(rest, r"#(.+)$", 1), F.lit("")), F.regexp_extract(rest, r"^[^/#]+/[^/#]+/(?:tree/)?([^#]+)$", 1)))
    ok = (owner != "") & (name != "")
    return F.struct(F.when(ok, owner).alias("owner"), F.when(ok, name).alias("name"), F.when(ok, F.nullif(tail, F.lit(""))).alias("ref"))


def target_kind(target: Column | str) -> Column:
    """url, path or shorthand: an absolute, home or dotted path is local, two bare names are a repository."""
    t = F.trim(F.col(target) if isinstance(target, str) else target)
    return F.when(t.rlike(r"^(?:https?://|git@|ssh://)"), "url").when(t.rlike(r"^(?:/|~|\.{1,2}(?:/|$)|[A-Za-z]:[\\/])") | ~t.contains("/"), "path").when(t.rlike(r"^[\w.-]+/[\w.-]+(?:[#/].+)?$"), "shorthand").otherwise("path")
