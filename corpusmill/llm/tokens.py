"""Token counts and ids by a public tokenizer.

``token_counts``: exact counts per text, then totals per slice. A text longer than ``chunk_chars`` is cut
only where the tokenizer's split pattern proves a border that no pre-token spans and that no look-ahead
crosses: before white space that follows other text, and between a letter and a digit. Such chunks are
spread over workers and their exact counts summed. A text with no such place stays whole. Source, language
and domain travel with the counts, so that each table is read once.

``token_ids``: ids by the tokenizers library over Arrow batches; ``token_spans`` adds the character range
of each id, ``decode_ids`` reverses the byte table.

Defined results: null and empty texts have 0 tokens and an empty id list; strings that look like special
tokens are ordinary text; repeated keys keep one count; extra columns are ignored; empty tables give
empty results.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache
from itertools import chain

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.arrow import map_columns
from corpusmill.llm.common import deliveries

CHUNK_CHARS = 65_536


def vocabulary(name: str = "byte_bpe_50k") -> str:
    """Where the vocabulary files are, without ending; the folder may be set by CORPUSMILL_TOKENIZERS."""
    folder = os.environ.get("CORPUSMILL_TOKENIZERS")
    if not folder:
        import public_tokenizers

        folder = os.path.dirname(public_tokenizers.path(name))
    return os.path.join(folder, name)


#: The split pattern of byte-level BPE files of this kind, as published with them (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def _counter(path: str):
    import tiktoken

    with open(path + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path + ".json")
    t.encode_special_tokens = True
    return t


@lru_cache(maxsize=4)
def byte_table(path: str) -> list[bytes]:
    """The bytes of each id: the file spells bytes as printable characters, the others shifted to 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shifted = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    back = {chr(shifted.get(b, b)): b for b in range(256)}
    vocab = _tokenizer(path).get_vocab()
    table = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        table[i] = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()
    return table


def count_one(text: str | None, path: str) -> int:
    if not text:
        return 0
    try:
        return len(_counter(path).encode_ordinary(text))
    except ValueError as e:  # the counter's regex engine has a step limit; the other library has none
        if "stack" not in str(e).lower() and "limit" not in str(e).lower() and "regex" not in str(e).lower():
            raise
        return len(_tokenizer(path).encode(text, add_special_tokens=False).ids)


@lru_cache(maxsize=1)
def _border():
    import regex

    return regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


def cut_text(text: str, chunk_chars: int = CHUNK_CHARS) -> list[str]:
    """Chunks whose token counts add up to the text's; joined they are the text."""
    chunks, at = [], 0
    while len(text) - at > chunk_chars:
        place = _border().search(text, at + chunk_chars)
        if place is None:
            break
        chunks.append(text[at : place.start()])
        at = place.start()
    chunks.append(text[at:])
    return chunks


def _latest(df: DataFrame, key: str, text: str, about: dict[str, F.Column], path: str | None, chunk_chars: int) -> DataFrame:
    """(row_id, about.., tokens): one scan of the texts, exact counts, the latest delivery of each key.

    A text of usual size is counted where it is read; an oversized one leaves as chunks, which are spread over
    the workers by (key, chunk) and counted there. What is shuffled is a narrow row a text, and those chunks.
    Chunks of one delivery are summed by themselves, so that deliveries with different texts never mix.
    """
    path = path or vocabulary()

    def first(keys, times, texts, *others):
        out: list[list] = [[] for _ in range(6 + len(others))]
        for row in zip(keys, times, texts, *others):
            k, d, t, *o = row
            chunks = cut_text(t, chunk_chars) if t is not None and len(t) > chunk_chars else None
            known = count_one(t, path) if chunks is None else None
            mark = None if chunks is None else xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63)
            for i, chunk in enumerate(chunks or [None]):
                for c, v in zip(out, (k, d, mark, i, known, chunk, *o)):
                    c.append(v)
        return out

    def second(keys, times, marks, numbers, known, chunks, *others):
        counts = [n if c is None else count_one(c, path) for n, c in zip(known, chunks)]
        return [keys, times, marks, numbers, counts, *others]

    names = list(about)
    base = deliveries(df.select(F.col(key).cast("bigint").alias("row_id"), F.col(text).alias("text"), *(c.cast("string").alias(n) for n, c in about.items()), *(c for c in ("ingested_at", "collected_at") if c in df.columns))).filter("row_id is not null")
    kept = "row_id bigint, delivery struct<ingested_at:bigint,collected_at:bigint>, mark bigint, chunk int"
    tail = "".join(f", {n} string" for n in names)
    pieces = map_columns(base, ["row_id", "delivery", "text", *names], first, f"{kept}, known bigint, text string{tail}", costly=True)
    spread = pieces.repartition(F.xxhash64("row_id", "chunk"))
    counted_ = map_columns(spread, ["row_id", "delivery", "mark", "chunk", "known", "text", *names], second, f"{kept}, tokens bigint{tail}")
    whole = counted_.groupBy("row_id", "delivery", "mark", "chunk", *names).agg(F.max("tokens").alias("tokens")).groupBy("row_id", "delivery", "mark", *names).agg(F.sum("tokens").alias("tokens"))
    best = whole.groupBy("row_id").agg(F.max(F.struct("delivery", "tokens", *names)).alias("x"))
    return best.select("row_id", *(F.col("x")[n].alias(n) for n in names), F.col("x")["tokens"].alias("tokens"))


def token_counts(df: DataFrame, key: str, text: str, path: str | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(row_id, tokens): one row per distinct key."""
    return _latest(df, key, text, {}, path, chunk_chars)


def _language(column: str) -> F.Column:
    return F.nullif(F.lower(F.trim(F.col(column))), F.lit(""))


def counted(documents: DataFrame, files: DataFrame, path: str | None = None, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(tbl, row_id, source, language, domain, tokens) of every text of both tables; a file delivered twice counts once."""
    docs = _latest(documents, "doc_id", "text", {"source": F.col("source"), "language": _language("lang"), "domain": F.col("domain")}, path, chunk_chars)
    code = _latest(files, "file_id", "content", {"source": F.col("repo"), "language": _language("language"), "domain": F.lit(None)}, path, chunk_chars)
    return docs.withColumn("tbl", F.lit("documents")).unionByName(code.withColumn("tbl", F.lit("parsed_files"))).select("tbl", "row_id", "source", "language", "domain", "tokens")


def slices(count: DataFrame) -> DataFrame:
    """Totals by source, language and domain, nulls as a group of their own."""
    return count.groupBy("tbl", "source", "language", "domain").agg(F.count("*").alias("texts"), F.sum("tokens").alias("tokens"))


def totals(count: DataFrame) -> DataFrame:
    """Totals by each dimension alone: (tbl, dimension, value, texts, tokens)."""
    parts = slices(count)
    named = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("source", "language", "domain"))))
    return parts.select("tbl", named.alias("d"), "texts", "tokens").groupBy("tbl", "d.dimension", "d.value").agg(F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens"))


def against_summaries(count: DataFrame, summaries: DataFrame) -> DataFrame:
    """Exact tokens of the summarised files beside the rough figure that the summariser reported, by language."""
    used = summaries.filter(F.col("tokens_used") > 0).groupBy(F.col("file_id").alias("row_id")).agg(F.max("tokens_used").alias("tokens_used"))
    both = count.filter(F.col("tbl") == "parsed_files").join(used, "row_id")
    return both.groupBy("language").agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens"), F.sum("tokens_used").alias("tokens_used"))


#: Where a text may be cut so that the ids of its pieces are the ids of the text: before white space that
#: follows other text. Only some of these places are used, those after marks that end a phrase or line.
_PIECE = re.compile(r"(?<=[.!?:;,|\]\)}>])(?=\s)|(?<=[^\s])(?=\n)")
#: Bound of the memo in characters; longer pieces than the other bound are not remembered.
_MEMO_CHARS, _MEMO_PIECE = 4_000_000, 1_000


class _Memo(dict):
    chars = 0


@lru_cache(maxsize=4)
def _memo(path: str) -> _Memo:
    return _Memo()


def _encode(texts: list[str | None], path: str, step: int = 256) -> list[list[int]]:
    """Ids of each text. Pieces that come again are encoded once for each worker; the memo is bounded."""
    t, memo = _tokenizer(path), _memo(path)
    out: list[list[int]] = []
    for at in range(0, len(texts), step):
        cut = [_PIECE.split(x) if x else [] for x in texts[at : at + step]]
        here: dict[str, list[int]] = {}
        for pieces in cut:
            for p in pieces:
                if p not in here:
                    here[p] = memo.get(p)
        new = [p for p, ids in here.items() if ids is None]
        for p, e in zip(new, t.encode_batch_fast(new, add_special_tokens=False)):
            here[p] = e.ids
            if len(p) <= _MEMO_PIECE:
                if memo.chars > _MEMO_CHARS:
                    memo.clear()
                    memo.chars = 0
                memo[p] = e.ids
                memo.chars += len(p)
        out += [list(chain.from_iterable(map(here.__getitem__, pieces))) for pieces in cut]
    return out


def token_ids(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every document, without special tokens."""
    path = path or vocabulary()

    def kernel(keys, texts):
        return [keys, _encode(texts, path)]

    return map_columns(documents, ["doc_id", "text"], kernel, "doc_id bigint, ids array<int>", costly=True)


def decode_ids(ids: list[int], path: str, errors: str = "replace") -> str:
    """The text of some ids; bytes that are part of a split character become U+FFFD unless all its ids are there."""
    table = byte_table(path)
    return b"".join(table[i] for i in ids).decode("utf-8", errors)


def decoded(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, h): the SHA-256 of what the ids of each document decode to."""
    import hashlib

    path = path or vocabulary()

    def kernel(keys, texts):
        return [keys, [hashlib.sha256(decode_ids(i, path).encode()).hexdigest() for i in _encode(texts, path)]]

    return map_columns(documents, ["doc_id", "text"], kernel, "doc_id bigint, h string", costly=True)


def id_spans(ids: list[int], text: str, path: str) -> tuple[list[int], list[int]]:
    """Character range of each id; ids that share a split character all cover it."""
    import numpy as np

    table = byte_table(path)
    ends = np.cumsum([len(table[i]) for i in ids], dtype=np.int64)
    if not len(ends):
        return [], []
    starts = ends - np.array([len(table[i]) for i in ids])
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character that each byte belongs to
    return char[starts].tolist(), (char[ends - 1] + 1).tolist()


def token_spans(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, char_start, char_end, same): ids with their character ranges, and whether decoding gives the text back."""
    path = path or vocabulary()

    def kernel(keys, texts):
        ids = _encode(texts, path)
        spans = [id_spans(i, t or "", path) for i, t in zip(ids, texts)]
        return [keys, ids, [s[0] for s in spans], [s[1] for s in spans], [decode_ids(i, path) == (t or "") for i, t in zip(ids, texts)]]

    return map_columns(documents, ["doc_id", "text"], kernel, "doc_id bigint, ids array<int>, char_start array<int>, char_end array<int>, same boolean", costly=True)
