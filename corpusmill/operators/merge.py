"""Reconciliation of what several parsers say of one file.

Input: one row for each parser and file with its place in the chain (``parser_ord``), quality, error and
counts. Rows that failed are left out unless every parser failed. Ties go to the earlier parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.arrow import map_columns
from corpusmill.operators import nested

#: Base score by parser quality. Fixed values.
QUALITY = {"full": 0.4, "partial": 0.25, "basic": 0.15}


def confidence(quality: Column, error: Column, declarations: Column, complete: Column, imports: Column, missed: Column) -> Column:
    """Confidence in a result from 0 to 1: quality, number and completeness of declarations, imports, less what was missed."""
    base = F.lit(0.1)
    for k, v in QUALITY.items():
        base = F.when(quality == k, v).otherwise(base)
    some = F.when(declarations > 0, F.least(F.lit(0.3), 0.05 * F.sqrt(declarations)) + 0.2 * complete / declarations).otherwise(0.0)
    score = base + some + F.least(F.lit(0.1), 0.01 * imports) - F.least(F.lit(0.15), 0.03 * missed)
    return F.when(error.isNotNull() & (error != ""), 0.3).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def _given(value) -> bool:
    """Whether an attribute holds anything: an empty list may be written as text."""
    return value not in (None, "", "[]", [], {})


def _top(text: str | None, root: nested.Root) -> list:
    value, ok = nested._load(text)
    return nested.entries(value, root) if ok else []


def declared(files: DataFrame) -> DataFrame:
    """(file_id, declarations, complete, imports): numbers of top-level declarations, of those with docstring, signature or modifiers, and of imports."""

    def kernel(ids, decls, imports):
        out: list[list] = [[], [], [], []]
        for i, d, m in zip(ids, decls, imports):
            top = _top(d, nested.DECLARATIONS)
            full = sum(any(_given(e.get(k)) for k in ("docstring", "signature", "modifiers")) for e in top)
            for c, v in zip(out, (i, len(top), full, len(_top(m, nested.IMPORTS)))):
                c.append(v)
        return out

    rows = map_columns(files, ["file_id", "declarations", "imports"], kernel, "file_id bigint, declarations int, complete int, imports int")
    return rows.groupBy("file_id").agg(*(F.max(c).alias(c) for c in ("declarations", "complete", "imports")))


def declarations(files: DataFrame) -> DataFrame:
    """(file_id, ord, kind, name, start_line, end_line, docstring, signature, modifiers, children) of every top-level declaration; the last two are counts."""

    def number(value) -> int | None:
        try:
            return int(value)
        except (TypeError, ValueError):
            return None

    def text(value) -> str | None:
        return value if value is None or isinstance(value, str) else str(value)

    def kernel(ids, decls):
        out: list[list] = [[] for _ in range(10)]
        for i, d in zip(ids, decls):
            for k, e in enumerate(_top(d, nested.DECLARATIONS)):
                mods = e.get("modifiers")
                if isinstance(mods, str) and mods.strip()[:1] == "[":
                    mods = nested._load(mods)[0]
                n = len(mods) if isinstance(mods, (list, dict)) else int(_given(mods))
                for c, v in zip(out, (i, k, text(e.get("kind")), text(e.get("name")), number(e.get("start_line")), number(e.get("end_line")), text(e.get("docstring")), text(e.get("signature")), n, len(nested.entries(e.get("children"), nested.DECLARATIONS)))):
                    c.append(v)
        return out

    kind = "file_id bigint, ord int, kind string, name string, start_line int, end_line int, docstring string, signature string, modifiers int, children int"
    return map_columns(files, ["file_id", "declarations"], kernel, kind).dropDuplicates(["file_id", "ord"])


def parses(results: DataFrame, declared: DataFrame) -> DataFrame:
    """The newest row of each parser and file with the declarations and imports found for their file, and their confidence."""
    said = ["parser_quality", "error", "missed_features", "confidence_score"]
    newest = F.struct(*(["parsed_at"] if "parsed_at" in results.columns else []), *said)
    p = results.groupBy("file_id", "parser_ord", "parser_type").agg(F.max(newest).alias("x")).select("file_id", "parser_ord", "parser_type", *(F.col("x")[c].alias(c) for c in said))
    j = p.join(declared, "file_id", "left").fillna(0, ["declarations", "complete", "imports"])
    missed = F.size(F.coalesce("missed_features", F.array().cast("array<string>")))
    own = confidence(F.coalesce("parser_quality", F.lit("unknown")), F.col("error"), F.col("declarations"), F.col("complete"), F.col("imports"), missed)
    given = F.nullif("confidence_score", F.lit(0.0))
    return j.withColumn("confidence", F.round(F.coalesce(given, own), 6))


def usable(p: DataFrame) -> DataFrame:
    """Rows without error; all of a file's rows if every parser failed."""
    failed = F.col("error").isNotNull() & (F.col("error") != "")
    any_ok = F.max((~failed).cast("int")).over(Window.partitionBy("file_id")) == 1
    return p.withColumn("_ok", ~failed | ~any_ok).filter("_ok").drop("_ok")


def fast_fail(p: DataFrame, enough: float = 0.8) -> DataFrame:
    """The first parser that is sure enough, else the surest: (file_id, parser_type, confidence)."""
    hit = (F.col("confidence") >= enough).cast("int")
    w = Window.partitionBy("file_id").orderBy(F.desc(hit), F.when(hit == 1, F.lit(0.0)).otherwise(-F.col("confidence")), "parser_ord", "parser_type")
    return usable(p).withColumn("r", F.row_number().over(w)).filter("r = 1").select("file_id", "parser_type", "confidence")


def by_confidence(p: DataFrame) -> DataFrame:
    """(file_id, base, engines, parsers, missed): the surest parser leads; what all missed stays missed."""
    u = usable(p).withColumn("missed_features", F.coalesce("missed_features", F.array().cast("array<string>")))
    w = Window.partitionBy("file_id").orderBy(F.desc("confidence"), "parser_ord", "parser_type")
    ranked = u.withColumn("r", F.row_number().over(w))
    engines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "parser_type"))), lambda x: x["parser_type"]), "+")
    heads = ranked.groupBy("file_id").agg(F.min_by("parser_type", "r").alias("base"), engines.alias("engines"), F.count("*").alias("parsers"))
    each = u.select("file_id", "parser_ord", "parser_type", F.explode(F.array_distinct("missed_features")).alias("feature"))
    common = each.groupBy("file_id", "feature").agg(F.count("*").alias("n")).join(heads, "file_id").filter("n = parsers").groupBy("file_id").agg(F.count("*").alias("missed"))
    return heads.join(common, "file_id", "left").withColumn("missed", F.coalesce("missed", F.lit(0).cast("bigint"))).withColumn("engines", F.when(F.col("parsers") > 1, F.concat(F.lit("merged:"), F.col("engines"))).otherwise(F.col("engines")))


def merge_declarations(decls: DataFrame, strategy: str = "confidence") -> DataFrame:
    """One row for each distinct declaration of a file, from (file_id, parser_ord, confidence, ord, kind, name, start_line, end_line, docstring, signature, modifiers, children).

    confidence: of the surest parser that has it; union: of the first; best_of_breed: of the most complete.
    """
    key = ["file_id", "kind", "name", "start_line", "end_line"]
    full = (F.coalesce(F.length("docstring"), F.lit(0)) > 0, F.coalesce(F.length("signature"), F.lit(0)) > 0, F.coalesce(F.col("modifiers"), F.lit(0)), F.coalesce(F.col("children"), F.lit(0)))
    order = {"confidence": [F.desc("confidence")], "union": [], "best_of_breed": [c.desc() if i > 1 else c.cast("int").desc() for i, c in enumerate(full)]}[strategy]
    w = Window.partitionBy(*key).orderBy(*order, "parser_ord", "ord")
    return decls.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
