"""Files that nobody wrote by hand for their repository: generated, minified, vendored, or data saved as code.

Pass one trains an identifier model per language: character trigrams of the distinct names of every file,
and how names are joined (camel, snake). Its size is bounded by the alphabet, not by the data: 40 characters
and three places make 64,000 trigrams a language. Pass two scores every file with the model. Three signals
decide, each followed by an exact check:

* the cross-entropy of the names flags mangled ones (the check: dense code of short names);
* the diversity of the names, distinct stems to all names and literals, flags templates, locks and data (the
  checks: functions alike but for digits, the fields of a lock, next to nothing but literals);
* naming style foreign to the language is reported, but flags nothing, because copies of packages are named
  as other files are (README has the figures): copies are found by the five-word shingles they share with an
  upstream file, and a generator's banner counts by itself, as a generator may write natural names.

Defined results: files with null or blank content or of other endings give no row; of a file delivered twice
the latest delivery counts; binary content is corrupt and none of these; an empty list of upstream files
matches nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.arrow import map_columns
from corpusmill.llm import functions, lexers, syntax
from corpusmill.llm.common import per_file

NAME = re.compile(r"(?<![\w$])[A-Za-z_$][\w$]*")
#: Words of the grammars are no names. Fixed values.
KEYWORDS = frozenset("and as assert async await boolean break byte case catch char class const continue crate def default defer del do double elif else elsif end ensure enum except export extends extern false final finally float fmt fn for from func function global go goto if impl implements import in include inline instanceof int interface is lambda let long loop match mod module move mut namespace new nil none not null number or package pass pub public private protected raise range readonly require rescue return self short signed sizeof static str string struct super switch then this throw throws trait true try type typedef typeof undefined union unless unsafe unsigned until use usize var void volatile when where while with yield Self String None True False NULL size_t end nil".split())
#: Bits a character by which mangled names exceed what their language's names cost on average; most blanks in dense code.
SURPRISE, DENSE_SPACE = 1.5, 0.12
CONTAINED, COVERED = 0.7, 0.4
#: At most so many distinct stems to each name or literal: templates, locks and data repeat themselves.
DIVERSITY = 0.5
#: Characters of upstream texts that are indexed and broadcast at once; more are compared block by block.
BLOCK_CHARS = 32_000_000


def names_of(language: str, text: str, code: str) -> list[str]:
    """The names in the code of a file, in order."""
    return [n for n in NAME.findall(code) if n not in KEYWORDS]


def _grams(name: str) -> list[str]:
    s = f"^{''.join(c if c.isascii() else '?' for c in name.lower())}$"
    return [s[i : i + 3] for i in range(len(s) - 2)] if len(s) > 2 else [s]


def _style(name: str) -> str | None:
    core = name.strip("_$")
    if "_" in core:
        return "snake" if core.islower() else "upper" if core.isupper() else None
    return "camel" if re.search(r"[a-z][A-Z]", core) and core[:1].islower() else None


def _binary(text: str) -> bool:
    return "\x00" in text or text.count("�") * 20 > len(text)


def _code(language: str, text: str) -> tuple[str, list[tuple[int, int, str]]]:
    if language in ("json", "yaml"):
        return text, lexers.spans_of(language, text)
    scan = lexers.scan(language, text)
    return scan.code, scan.spans


def train(files: DataFrame) -> DataFrame:
    """(language, gram, n): in how many (file, name) pairs a trigram occurs; grams of a style are named ``=camel``."""

    def kernel(paths, contents):
        names: dict[str, Counter] = {}
        for path, content in zip(paths, contents):
            language = lexers.language_of(path)
            if language in (None, "json", "yaml") or not content or _binary(content):
                continue  # keys of data are no names of code
            text = syntax.plain(content)
            names.setdefault(language, Counter()).update(set(names_of(language, text, _code(language, text)[0])))
        out: list[list] = [[], [], []]
        for language, counts in names.items():
            grams: Counter = Counter()
            for name, n in counts.items():
                for g in _grams(name):
                    grams[g] += n
                if style := _style(name):
                    grams[f"={style}"] += n
            out[0] += [language] * len(grams)
            out[1] += grams.keys()
            out[2] += grams.values()
        return out

    counted = map_columns(files, ["file_path", "content"], kernel, "language string, gram string, n bigint", costly=True)
    return counted.groupBy("language", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Trigram probabilities with back-off, and the share of each naming style, by language."""

    def __init__(self, rows: list[tuple[str, str, int]]) -> None:
        self.grams: dict[str, dict[str, int]] = {}
        self.before: dict[str, dict[str, int]] = {}
        self.styles: dict[str, dict[str, float]] = {}
        for language, gram, n in rows:
            if gram[0] == "=":
                self.styles.setdefault(language, {})[gram[1:]] = n
                continue
            self.grams.setdefault(language, {})[gram] = n
            b = self.before.setdefault(language, {})
            b[gram[:2]] = b.get(gram[:2], 0) + n
        for shares in self.styles.values():
            total = sum(shares.values())
            for k in shares:
                shares[k] /= total
        self.usual = {k: sum(-n * self._log(g, k) for g, n in grams.items()) / sum(grams.values()) for k, grams in self.grams.items()}
        self.memo: dict[tuple[str, str], float] = {}

    def _log(self, gram: str, language: str) -> float:
        return math.log2((self.grams.get(language, {}).get(gram, 0) + 0.05) / (self.before.get(language, {}).get(gram[:2], 0) + 2.0))

    def mangled(self, language: str, entropy: float) -> bool:
        return entropy >= self.usual.get(language, 0.0) + SURPRISE

    def bits(self, language: str, name: str) -> float:
        """Bits a character that a name costs under its language's model."""
        key = (language, name)
        v = self.memo.get(key)
        if v is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            cost = [-self._log(g, language) for g in _grams(name)]
            v = self.memo[key] = sum(cost) / len(cost)
        return v

    def entropy(self, language: str, names: set[str]) -> float:
        return sum(self.bits(language, n) for n in names) / len(names) if names else 0.0

    def foreign(self, language: str, names: set[str]) -> float:
        """How much of a file's names is joined in a way that is rare in its language."""
        styles = [s for n in names if (s := _style(n))]
        shares = self.styles.get(language, {})
        return sum(1 - shares.get(s, 0.0) for s in styles) / len(styles) if styles else 0.0


_WORD = re.compile(r"\w+")


_WORDS: dict[str, int] = {}
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(5)], dtype=np.uint64)


def shingles(text: str) -> np.ndarray:
    """Distinct hashes of runs of five words, sorted; the same on every machine. Hashes of words are remembered."""
    ids = []
    for w in _WORD.findall(text):
        h = _WORDS.get(w)
        if h is None:
            if len(_WORDS) > 200_000:
                _WORDS.clear()
            h = _WORDS[w] = xxhash.xxh64_intdigest(w)
        ids.append(h)
    if len(ids) < 5:
        return np.empty(0, dtype=np.uint64)
    v = np.array(ids, dtype=np.uint64)
    n = len(v) - 4
    with np.errstate(over="ignore"):
        mixed = sum((v[k : n + k] ^ np.uint64(k)) * _FACTORS[4 - k] for k in range(5))
    return np.unique(mixed)


#: How a banner of a generator begins, in several languages. Matched at the start of a comment line.
_BANNER = re.compile(
    r"^[^\w<@]*+(?:@generated\b|<auto-?generated|auto-?generated\b(?:\s+(?:by|file|from|code|on|with|using)\b|[\s.,:;!-]*$)|(?:(?:this|the)\s+)?(?:code|file|source|module)?\s*(?:was|is|has\s+been)?\s*(?:automatically\s+|auto-?)?(?:generated|produced)\s+(?:automatically|by|on|from|with|using)\b"
    r"|machine[\s-](?:written|generated|made)\b|do\s+not\s+(?:modify|edit|change|touch)\b(?!.*\bbanner)|output\s+of\s+(?:the\s+)?\S+\s+(?:compiler|generator|tool)\b|source\s+of\s+truth\s+is\b|generated\s+(?:code|file)\b"
    r"|(?:diese\s+datei|dieser\s+code)\s+(?:wurde|ist|wird)\s+.*\b(?:automatisch|maschinell|generiert|erzeugt)|automatisch\s+(?:erzeugt|generiert)"
    r"|(?:ce\s+)?(?:fichier|code)\s+(?:est\s+|a\s+été\s+)?(?:créé|généré|produit)\b.*automatiquement|(?:este\s+)?(?:archivo|fichero|código)\s+(?:fue\s+|ha\s+sido\s+|es\s+)?(?:creado|generado|producido)\b.*autom[aá]tic|(?:este\s+)?(?:arquivo|ficheiro|código)\s+(?:foi\s+|é\s+)?(?:gerado|criado|produzido)\b.*automatic"
    r"|(?:этот\s+)?(?:файл|код)\s+(?:был\s+)?(?:создан|сгенерирован)\b.*(?:автоматически|программой)|本文件由.*自动生成|.*(?:自动生成|自動生成)(?:され|，|,|。|的))",
    re.I,
)
#: What may stand before a file's first own line of code.
_HEAD = re.compile(r"(?:\s+|(?:import|from|package|use|extern|require|require_relative|using|include|module|frozen_string_literal)\b[^\n(]*(?:\([^)]*\))?[^\n]*(?:\n|$)|\#\s*(?:include|pragma|ifndef|define)\b[^\n]*(?:\n|$)|\#![^\n]*|\"+;?|'+;?)*+")


#: One of these stands in every banner.
_BANNER_WORDS = ("generat", "produced", "machine", "automati", "maschinell", "generiert", "erzeugt", "autom", "автомат", "программ", "自动生成", "自動生成")
_BANNER_SPACED = re.compile(r"do\s+not\s+(?:modify|edit|change|touch)|output\s+of|source\s+of\s+truth")


def banner(language: str, text: str, spans: list[tuple[int, int, str]]) -> bool:
    """Whether a comment before a file's first own code, or after its last, says that a program wrote it."""
    low = text.lower()
    if not any(w in low for w in _BANNER_WORDS) and not _BANNER_SPACED.search(low) or not any(k in "#*" for *_, k in spans):
        return False
    code = functions.masked(text, spans)
    head, foot = _HEAD.match(code).end(), len(code.rstrip())
    for a, b, k in spans:
        if k not in "#*" or foot > a > head:
            continue
        for said in functions.clean(text[a:b]).split("\n"):
            if _BANNER.match(said):
                return True
    return False


_NUMBERED = re.compile(r"\d+")
_FUNCTION = re.compile(r"\b(?:def|func|function|fn)\s+(?:\([^)]*\)\s*)?(?:self\.)?([A-Za-z_$][\w$]*)|\b[A-Za-z_][\w<>\[\], *]*?[\s*]([A-Za-z_]\w*)\s*\([^;{}()]*\)\s*\{")
_LITERALS = re.compile(r"0[xX][0-9a-fA-F]+|\b\d+(?:\.\d+)?\b|[\x01\x04]")
_LOCK = re.compile(r"\"(?:lockfileVersion|lockfile-version|_resolved|resolved|integrity)\"\s*:")


def template(code: str) -> tuple[int, float]:
    """(size of the largest set of functions named alike but for digits, its share of all functions)."""
    found_ = [a or b for a, b in _FUNCTION.findall(code)]
    if not found_:
        return 0, 0.0
    groups = Counter(_NUMBERED.sub("#", n) for n in found_ if any(c.isdigit() for c in n))
    top = max(groups.values(), default=0)
    return top, top / len(found_)


def data_share(text: str, code: str, spans: list[tuple[int, int, str]]) -> tuple[float, int]:
    """(share of the characters outside comments that literals take, number of literals)."""
    comments = sum(b - a for a, b, k in spans if k in "#*")
    strings = [b - a for a, b, k in spans if k in "\"'/"]
    numbers = [len(m) for m in _LITERALS.findall(code)]
    rest = len(text) - comments
    bare = sum(1 for c in code if c in " \t\r\n,;[](){}")
    return min(1.0, (sum(strings) + sum(numbers) + bare) / rest) if rest else 0.0, len(strings) + len([x for x in numbers if x])


def judge(language: str, text: str, model: Model, upstream: Shared) -> tuple:
    """(entropy, diversity, foreign style, upstream id, contained, verdict, signal) of a file."""
    if _binary(text):
        return 0.0, 1.0, 0.0, None, 0.0, None, None
    code, spans = _code(language, text)
    all_names = names_of(language, text, code)
    names = set(all_names)
    entropy, style = model.entropy(language, names), model.foreign(language, names)
    stems = {_NUMBERED.sub("#", n) for n in names}
    literals = len(_LITERALS.findall(code)) + sum(1 for *_, k in spans if k in "\"'/")
    diversity = len(stems) / max(1, len(all_names) + literals)
    best, shared, contained = nearest(shingles(text), upstream)
    verdict = signal = None
    prose_like = language in ("json", "yaml")
    if best is not None and contained >= CONTAINED and shared >= COVERED * upstream.sizes[best]:
        verdict, signal = "vendored", "shared text"
    elif not prose_like and model.mangled(language, entropy) and _dense(text, code, names):
        verdict, signal = "minified", "entropy"
    elif diversity <= DIVERSITY and (said := _repeats(language, text, code, spans, all_names, names, stems)):
        verdict, signal = said, "diversity"
    elif banner(language, text, spans):
        verdict, signal = "generated", "banner"
    return entropy, diversity, style, best if contained >= CONTAINED else None, contained, verdict, signal


class Shared:
    """Shingles of upstream files, sorted, with the files that hold each."""

    def __init__(self, rows) -> None:
        index: dict[int, list[int]] = {}
        self.sizes: dict[int, int] = {}
        for r in rows:
            own = shingles(syntax.plain(r.content))
            self.sizes[r.upstream_id] = len(own)
            for x in own.tolist():
                index.setdefault(x, []).append(r.upstream_id)
        self.keys = np.array(sorted(index), dtype=np.uint64)
        self.held = [index[k] for k in self.keys.tolist()]


def nearest(own: np.ndarray, upstream: Shared) -> tuple[int | None, int, float]:
    """(upstream file that shares most, how many shingles, their part of the file's own); the lower id of equal ones."""
    if not len(own) or not len(upstream.keys):
        return None, 0, 0.0
    at = np.searchsorted(upstream.keys, own)
    at[at == len(upstream.keys)] = 0
    hits: Counter = Counter(k for i in at[upstream.keys[at] == own].tolist() for k in upstream.held[i])
    if not hits:
        return None, 0, 0.0
    best = min(hits, key=lambda k: (-hits[k], k))
    return best, hits[best], hits[best] / len(own)


def _repeats(language: str, text: str, code: str, spans: list[tuple[int, int, str]], all_names: list[str], names: set[str], stems: set[str]) -> str | None:
    """What a file of low diversity is: a lock, data, or functions from a template."""
    if language in ("json", "yaml"):
        if language == "json" and len(_LOCK.findall(text)) >= 3:
            return "generated"
    elif _data_only(text, code, spans, all_names):
        return "data"
    if names and len(stems) < 0.85 * len(names) and (t := template(code))[0] >= 5 and t[1] >= 0.4:
        return "generated"
    return None


def _dense(text: str, code: str, names: set[str]) -> bool:
    """Mangled code is short names without room: most names of one or two characters, few blanks or few lines."""
    short = sum(1 for n in names if len(n) <= 2)
    space = sum(1 for c in code if c.isspace())
    return short >= 0.5 * len(names) and (space <= DENSE_SPACE * len(code) or len(code) / (code.count("\n") + 1) >= 120)


def _data_only(text: str, code: str, spans: list[tuple[int, int, str]], names: list[str]) -> bool:
    share, literals = data_share(text, code, spans)
    if share < 0.9:
        return False
    longest = max((b - a for a, b, k in spans if k == '"'), default=0)
    return len(names) <= 12 + literals // 50 and (literals >= 60 or longest >= 600)


_SCORES = "repo string, language string, entropy double, diversity double, foreign double, upstream_id int, contained double, verdict string, signal string"


def blocks(upstream: DataFrame, block_chars: int = BLOCK_CHARS):
    """The upstream list in blocks of bounded size; how many is known before anything is collected."""
    listed = upstream.select("upstream_id", "content").filter("content is not null")
    total = listed.agg(F.sum(F.length("content"))).first()[0] or 0
    n = -(-total // block_chars) or 1
    for k in range(n):
        yield Shared((listed.filter(F.pmod(F.xxhash64("upstream_id"), F.lit(n)) == k) if n > 1 else listed).collect())


def scored(files: DataFrame, upstream: DataFrame, model: Model | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(file_id, repo, language, entropy, diversity, foreign, upstream_id, contained, verdict, signal), one row per distinct file."""
    if model is None:
        model = Model([tuple(r) for r in train(files).collect()])
    context = files.sparkSession.sparkContext
    first, *others = [context.broadcast(x) for x in blocks(upstream, block_chars)]
    trained = context.broadcast(model)

    def kernel(repos, paths, contents):
        m, up = trained.value, first.value
        out: list[list] = [[] for _ in range(9)]
        for repo, path, content in zip(repos, paths, contents):
            language = lexers.language_of(path)
            told = language is not None and content is not None and bool((text := syntax.plain(content)).strip())
            row = (repo, language, *judge(language, text, m, up)) if told else (None,) * 9
            for c, v in zip(out, row):
                c.append(v)
        return out

    done = per_file(files, ["repo", "file_path", "content"], kernel, _SCORES).filter("language is not null")
    for other in others:  # more upstream texts than one block holds: each further block is one more pass

        def copied(paths, contents, other=other):
            up = other.value
            out: list[list] = [[], [], []]
            for path, content in zip(paths, contents):
                own = shingles(syntax.plain(content)) if content and lexers.language_of(path) and not _binary(content) else np.empty(0, dtype=np.uint64)
                best, shared, c = nearest(own, up)
                for o, v in zip(out, (best if c >= CONTAINED else None, c, best is not None and c >= CONTAINED and shared >= COVERED * up.sizes[best])):
                    o.append(v)
            return out

        more = per_file(files, ["file_path", "content"], copied, "more_id int, more double, copy boolean").filter("more > 0")
        both = done.join(more, "file_id", "left")
        better = F.coalesce(F.col("more") > F.col("contained"), F.lit(False))
        done = both.withColumns({"upstream_id": F.when(better, F.col("more_id")).otherwise(F.col("upstream_id")), "contained": F.when(better, F.col("more")).otherwise(F.col("contained")), "verdict": F.when(F.coalesce("copy", F.lit(False)), "vendored").otherwise(F.col("verdict")), "signal": F.when(F.coalesce("copy", F.lit(False)), "shared text").otherwise(F.col("signal"))}).drop("more_id", "more", "copy")
    return done


def found(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """(file_id) of the files that were not written by hand."""
    return scored(files, upstream).filter("verdict is not null").select("file_id")
