"""Summaries by an injected model: what is due, bounded concurrency in each partition, retries, a cache."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import files as K


def due(files: DataFrame, cached: DataFrame | None = None, least_lines: int = 20, languages: tuple[str, ...] = (), excludes: tuple[str, ...] = ()) -> DataFrame:
    """(file_id) of the files worth a summary that have none yet: long enough, of a wanted language, no excluded path."""
    out = K.once(files, "path", T.line_count("content").alias("lines")).filter(F.col("lines") >= least_lines)
    if languages:
        out = out.filter(K.language_by_extension("path").isin(*languages))
    if excludes:
        out = out.filter(~K.matches_any("path", excludes))
    return (out.join(cached, "file_id", "left_anti") if cached is not None else out).select("file_id")


def summaries(files: DataFrame, model: Callable[[str], str], concurrency: int = 5, tries: int = 3, pause: float = 1.0) -> DataFrame:
    """(file_id, summary, error): a model that fails is asked again, then the error is kept."""

    def ask(text: str) -> tuple[str | None, str | None]:
        for k in range(tries):
            try:
                return model(text), None
            except Exception as e:
                error = str(e)
                if k + 1 < tries:
                    time.sleep(pause * 2**k)
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                said = list(pool.map(ask, b["content"].fillna("")))
                yield pd.DataFrame({"file_id": b["file_id"], "summary": [s for s, _ in said], "error": [e for _, e in said]})

    return files.select("file_id", "content").mapInPandas(run, "file_id bigint, summary string, error string")


def truncated(text, tokens: int, chars_per_token: float = 4.0):
    """Text cut to about so many tokens, at a line break if one lies in the last tenth."""
    most = int(tokens * chars_per_token)
    head = F.substring(text, 1, most)
    last = most - F.locate("\n", F.reverse(head)) + 1
    return F.when(F.length(text) <= most, text).when((F.locate("\n", F.reverse(head)) > 0) & (last >= most * 0.9), F.substring(head, F.lit(1), last - 1)).otherwise(head)


def bodies(files: DataFrame, decls: DataFrame, n: int = 3, least: int = 3) -> DataFrame:
    """(file_id, name, start_line, end_line, code): the lines of the longest functions of each file, for summaries of their own."""
    from corpusmill.operators import parse

    spans = parse.longest(decls, n, least).groupBy("file_id").agg(F.collect_list(F.struct("name", "start_line", "end_line")).alias("spans"))
    cut = F.transform("spans", lambda s: F.struct(s["name"].alias("name"), s["start_line"].alias("start_line"), s["end_line"].alias("end_line"), F.array_join(F.slice(T.lines("content"), s["start_line"], s["end_line"] - s["start_line"] + 1), "\n").alias("code")))
    return K.once(files.join(spans, "file_id"), cut.alias("cut")).select("file_id", F.explode("cut").alias("c")).select("file_id", "c.*")


def overview(said: DataFrame, tree: DataFrame, model: Callable[[str], str], most_chars: int = 200_000) -> str:
    """One text about a whole project from its summaries (path, summary) and its drawn tree (node, line): both in order of path, as much as a prompt holds."""
    from corpusmill.functions import describe

    def read(df: DataFrame, key: str, line) -> str:
        out, size = [], 0
        for r in df.select(key, line.alias("_line")).orderBy(key).toLocalIterator():
            size += len(r["_line"] or "") + 1
            if size > most_chars:
                break
            out.append(r["_line"] or "")
        return "\n".join(out)

    text = describe.PROMPTS["overview"].replace("{TREE}", read(tree, "node", F.col("line"))).replace("{SUMMARIES}", read(said, "path", F.concat_ws(": ", "path", "summary")))
    return model(text)


def fresh(cached: DataFrame, now, ttl_seconds: int = 3600, time: str = "created_at") -> DataFrame:
    """Rows of a cache that are not older than their time to live."""
    return cached.filter(F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col(time).cast("timestamp")) <= ttl_seconds)


def latest(summaries_: DataFrame) -> DataFrame:
    """(file_id, summary): the newest summary of each file that has no error; of equally new ones the one with the highest id."""
    ok = summaries_.filter("error is null and file_id is not null and summary is not null")
    return ok.groupBy("file_id").agg(F.max_by("summary", F.struct(F.col("created_at").cast("timestamp"), "summary_id")).alias("summary"))


def write(said: DataFrame, path: str) -> None:
    """Summaries as JSON lines in folders by the first characters of the hash of their file's id, so that one is found without a scan."""
    said.withColumn("key", F.substring(F.sha2(F.col("file_id").cast("string"), 256), 1, 2)).repartition("key").write.mode("append").partitionBy("key").json(path)


#: Models by name: what a caller registers is found by it.
PROVIDERS: dict[str, Callable[[str], str]] = {}


def provider(name: str):
    """Registers a model under a name."""

    def put(f: Callable[[str], str]) -> Callable[[str], str]:
        PROVIDERS[name] = f
        return f

    return put
