"""Reading level of prose, propagated over the graph of documents and their words.

Words are hashed into ``buckets`` places, so that what is known of all words is two vectors of that length
however large the corpus is. Graded examples are clamped at the mean of their grades; the difficulty of a
word is the mean of its documents, that of a document the mean of its words, weighted by how often it uses
them and by how sharply each word's documents agree. A round is one pass over the documents' word lists: the
task scores its documents by the last round's vectors and adds them up by word in arrays of its own, so that
no edge is ever shuffled and no word is a hot key; only these sums meet. Each round is calibrated against the
examples, which keeps averages from drifting to the middle, and rounds end when words hardly move any more
(``tolerance``). Thresholds between levels are fitted on at most ``max_examples`` graded documents, those with
the lowest hashes.

Defined results: texts that are null, blank, source code, shorter than 60 words outside code blocks and
tables, or not in English, German, French or Spanish give no row, whatever their columns say; grades of
such documents, null grades and grades outside 1 to 4 are ignored; without any grade there is no result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.arrow import map_columns
from corpusmill.llm import prose
from corpusmill.session import cut

LANGUAGES = ("en", "de", "fr", "es")
MIN_WORDS, MAX_CODE = 60, 0.3
BUCKETS = 1 << 20
_FENCE = re.compile(r"^[ \t]*(```|~~~)[^\n]*\n[\s\S]*?(?:^[ \t]*\1[^\n]*$|\Z)", re.M)
_TABLE = re.compile(r"^[ \t]*\|.*$", re.M)


def prose_words(text: str | None) -> tuple[str, list[str]] | None:
    """(language, words outside code blocks and tables) of a text that has a level; else None."""
    if not text or text.isspace():
        return None
    body = text.replace("\r\n", "\n") if "\r" in text else text
    if "```" in body or "~~~" in body:
        body = _FENCE.sub("\n", body)
    if "|" in body:
        body = _TABLE.sub("", body)
    words = prose.WORD.findall(body.lower())
    if len(words) < MIN_WORDS:
        return None
    lines = [x for x in body.split("\n") if x and not x.isspace()]
    code = sum(len(x) for x in lines if prose.code_like(x))
    if code > MAX_CODE * sum(map(len, lines)):
        return None
    votes: dict[str, float] = {}
    for _, found in prose.automaton().iter(f" {' '.join(words)} "):
        for language, weight in found:
            votes[language] = votes.get(language, 0.0) + weight
    if not votes:
        return None
    best = max(votes, key=lambda k: (votes[k], -prose.RANK[k]))
    return (best, words) if best in LANGUAGES else None


def word_lists(documents: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, words, counts) of every prose text: word is a hash of language and word, the same on every machine."""

    def kernel(ids, texts):
        import xxhash

        known: dict[tuple[str, str], int] = {}
        out: list[list] = [[], [], []]
        for i, text in zip(ids, texts):
            p = prose_words(text)
            if p is None:
                continue
            language, words = p
            held: dict[int, int] = {}
            for w, n in Counter(words).items():
                h = known.get((language, w))
                if h is None:
                    h = known[language, w] = xxhash.xxh64_intdigest(f"{language}:{w}") % buckets
                held[h] = held.get(h, 0) + n
            out[0].append(i)
            out[1].append(list(held))
            out[2].append(list(held.values()))
        return out

    return map_columns(documents, ["doc_id", "text"], kernel, "doc_id bigint, words array<int>, counts array<int>", costly=True)


def thresholds(score: np.ndarray, grade: np.ndarray) -> list[float]:
    """Cuts between the four levels that misplace the fewest examples; the middle of equally good ones."""
    order = np.argsort(score, kind="stable")
    v, y = score[order], grade[order]
    places = np.concatenate([[v[0] - 0.5], (v[1:] + v[:-1]) / 2, [v[-1] + 0.5]])
    out = []
    for k in (1.5, 2.5, 3.5):
        high = (y > k).astype(int)
        wrong = np.concatenate([[0], np.cumsum(high)]) + (1 - high).sum() - np.concatenate([[0], np.cumsum(1 - high)])
        out.append(float(np.median(places[wrong == wrong.min()])))
    return sorted(out)


def calibrated(g: np.ndarray, cuts: list[float]) -> np.ndarray:
    """Piecewise linear: the cuts become 1.5, 2.5 and 3.5."""
    return np.clip(np.interp(g, np.maximum.accumulate([cuts[0] - 0.5, *cuts, cuts[2] + 0.5]), [1.0, 1.5, 2.5, 3.5, 4.0]), 1.0, 4.0)


def _scores(batch: pa.RecordBatch, mean: np.ndarray, sharp: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score of each document, flat words, document of each flat word) of an Arrow batch."""
    words, counts = batch.column("words"), batch.column("counts")
    flat = words.flatten().to_numpy(zero_copy_only=False)
    tf = counts.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(words.offsets.to_numpy(zero_copy_only=False))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    weight = tf * sharp[flat]
    below = np.bincount(doc, weights=weight, minlength=len(lengths))
    above = np.bincount(doc, weights=weight * mean[flat], minlength=len(lengths))
    return np.where(below > 0, above / np.where(below > 0, below, 1.0), prior), flat, doc


class _Words:
    """What is known of words after a round."""

    def __init__(self, buckets: int, sums: DataFrame, sharpness: float, softness: float) -> None:
        rows = sums.toArrow()  # at most one narrow row a place
        at = rows["word"].to_numpy()
        c, s, s2 = np.zeros(buckets), np.zeros(buckets), np.zeros(buckets)
        c[at], s[at], s2[at] = rows["c"].to_numpy(), rows["s"].to_numpy(), rows["s2"].to_numpy()
        self.count = c
        self.prior = float(s.sum() / c.sum()) if c.sum() else 0.0
        mean = (s + self.prior) / (c + 1)
        spread = np.maximum(0.0, (s2 + 1 + self.prior**2) / (c + 1) - mean * mean)
        self.mean = mean
        self.sharp = np.where(c > 0, (spread + softness) ** -sharpness, 0.0)

    def moved(self, before: _Words) -> float:
        """How far words moved on average, by how often they occur."""
        return float((self.count * abs(self.mean - before.mean)).sum() / max(1.0, self.count.sum()))


def _sums(lists: DataFrame, words, cuts: list[float] | None, graded_weight: float, buckets: int) -> DataFrame:
    """(word, c, s, s2) over documents with their scores: a task adds up in arrays of its own before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, s, s2 = np.zeros(buckets), np.zeros(buckets), np.zeros(buckets)
        for b in batches:
            grade = b.column("grade").to_numpy(zero_copy_only=False).astype(float)
            known = ~np.isnan(grade)
            if words is None:
                flat = b.column("words").flatten().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(b.num_rows), np.diff(b.column("words").offsets.to_numpy(zero_copy_only=False)))
                f, w = np.where(known, grade, 0.0), known.astype(float)
            else:
                mean, sharp, prior = words.value
                g, flat, doc = _scores(b, mean, sharp, prior)
                f, w = np.where(known, grade, calibrated(g, cuts)), np.where(known, graded_weight, 1.0)
            weight, value = w[doc], f[doc]
            np.add.at(c, flat, weight)
            np.add.at(s, flat, weight * value)
            np.add.at(s2, flat, weight * value * value)
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("int32")), pa.array(c[at]), pa.array(s[at]), pa.array(s2[at])], ["word", "c", "s", "s2"])

    each = lists.select("words", "counts", "grade").mapInArrow(run, "word int, c double, s double, s2 double")
    return each.groupBy("word").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("s2").alias("s2"))


def _scored(lists: DataFrame, words, extra: str, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, sharp, prior = words.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column(extra), pa.array(_scores(b, mean, sharp, prior)[0])], ["doc_id", extra, "g"])

    return lists.select("doc_id", "words", "counts", extra).mapInArrow(run, f"doc_id bigint, {extra} {kind}, g double")


def levels(documents: DataFrame, labels: DataFrame, max_rounds: int = 20, tolerance: float = 0.01, sharpness: float = 1.5, softness: float = 0.05, graded_weight: float = 30.0, max_examples: int = 20_000, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, level, score)."""
    spark = documents.sparkSession
    grades = labels.filter("level between 1 and 4").groupBy("doc_id").agg(F.avg("level").alias("grade"))
    lists = cut(word_lists(documents, buckets).join(grades, "doc_id", "left"))
    known = lists.filter("grade is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    examples = cut(known)
    words = _Words(buckets, _sums(lists.filter("grade is not null"), None, None, graded_weight, buckets), sharpness, softness)
    if not words.count.any():
        return lists.select("doc_id", F.lit(0).alias("level"), F.lit(0.0).alias("score")).limit(0)
    for _ in range(max_rounds):
        shared = spark.sparkContext.broadcast((words.mean, words.sharp, words.prior))
        seen = _scored(examples, shared, "grade", "double").toPandas()
        cuts = thresholds(seen["g"].to_numpy(float), seen["grade"].to_numpy(float))
        after = _Words(buckets, _sums(lists, shared, cuts, graded_weight, buckets), sharpness, softness)
        still = after.moved(words) <= tolerance
        words = after
        if still:
            break
    shared = spark.sparkContext.broadcast((words.mean, words.sharp, words.prior))
    seen = _scored(examples, shared, "grade", "double").toPandas()
    cuts = thresholds(seen["g"].to_numpy(float), seen["grade"].to_numpy(float))
    level = F.lit(1)
    for c in cuts:
        level = level + F.when(F.col("g") > c, 1).otherwise(0)
    return _scored(lists, shared, "grade", "double").select("doc_id", level.cast("int").alias("level"), F.col("g").alias("score"))


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, level) of every prose text."""
    return levels(documents, labels).select("doc_id", "level").distinct()
