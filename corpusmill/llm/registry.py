"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import docpairs, natural, packing, provenance, reading, secrets, syntax, tokens
from corpusmill.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _counted(spark, d):
    return tokens.counted(table(spark, d, "documents"), table(spark, d, "parsed_files"))


@query("p1_tokens")
def p1_tokens(spark, d):
    return _counted(spark, d)


@query("p1_slices")
def p1_slices(spark, d):
    return tokens.slices(_counted(spark, d))


@query("p1_totals")
def p1_totals(spark, d):
    return tokens.totals(_counted(spark, d))


@query("p1_estimates")
def p1_estimates(spark, d):
    return tokens.against_summaries(_counted(spark, d), table(spark, d, "summaries"))


@query("p8_ids")
def p8_ids(spark, d):
    return tokens.token_ids(table(spark, d, "documents"))


@query("p8_spans")
def p8_spans(spark, d):
    return tokens.token_spans(table(spark, d, "documents"))


def _sizes(spark, d):
    from pyspark.sql import functions as F

    return tokens.token_counts(table(spark, d, "documents"), "doc_id", "text").select(F.col("row_id").alias("doc_id"), "tokens")


@query("p9_containers")
def p9_containers(spark, d):
    return packing.pack(_sizes(spark, d), table(spark, d, "context_windows"))


@query("p9_certificate")
def p9_certificate(spark, d):
    from corpusmill.session import cut

    sizes, windows = cut(_sizes(spark, d)), table(spark, d, "context_windows")
    return packing.certificate(sizes, windows, packing.pack(sizes, windows))


@query("p9_invariants", "SELECT window_id, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS split_needlessly, 0::BIGINT AS overfull FROM context_windows")
def p9_invariants(spark, d):
    """Every document is placed, none is split that fits, no container holds more than its capacity."""
    from pyspark.sql import functions as F

    packed, sizes = p9_containers(spark, d), table(spark, d, "context_windows").select("window_id", "capacity_tokens")
    per = packed.groupBy("window_id", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens")).join(F.broadcast(sizes), "window_id")
    docs = per.groupBy("window_id").agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("split_needlessly"))
    boxes = packed.groupBy("window_id", "container").agg(F.sum("tokens").alias("tokens")).join(F.broadcast(sizes), "window_id").groupBy("window_id").agg(F.count_if(F.col("tokens") > F.col("capacity_tokens")).alias("overfull"))
    return docs.join(boxes, "window_id")


@query("p8_decoded", "SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents")
def p8_decoded(spark, d):
    """Ids read back through the byte table give every text again."""
    return tokens.decoded(table(spark, d, "documents"))


@query("p1_texts", "SELECT 'documents' AS tbl, source, nullif(lower(trim(lang)), '') AS language, domain, count(*) AS texts FROM documents GROUP BY ALL UNION ALL SELECT 'parsed_files', repo, nullif(lower(trim(language)), ''), NULL, count(*) FROM (SELECT DISTINCT ON (file_id) * FROM parsed_files ORDER BY file_id, ingested_at DESC NULLS LAST, collected_at DESC NULLS LAST) GROUP BY ALL")
def p1_texts(spark, d):
    """Texts of each slice, as the token totals have them."""
    return tokens.slices(_counted(spark, d)).drop("tokens")


@query("p6_found")
def p6_found(spark, d):
    return syntax.found(table(spark, d, "parsed_files"))


@query("p6_report")
def p6_report(spark, d):
    return syntax.parsed(table(spark, d, "parsed_files"))


@query("p6_rates")
def p6_rates(spark, d):
    return syntax.rates(table(spark, d, "parsed_files"))


@query("p3_found")
def p3_found(spark, d):
    return natural.found(table(spark, d, "parsed_files"))


@query("p3_shares")
def p3_shares(spark, d):
    return natural.shares(table(spark, d, "parsed_files"))


@query("p4_found")
def p4_found(spark, d):
    return docpairs.documented(table(spark, d, "parsed_files"))


@query("p4_pairs")
def p4_pairs(spark, d):
    return docpairs.pairs(table(spark, d, "parsed_files"))


@query("p5_found")
def p5_found(spark, d):
    return secrets.found(table(spark, d, "parsed_files"), table(spark, d, "security_issues"))


@query("p5_redacted")
def p5_redacted(spark, d):
    return secrets.redacted(table(spark, d, "parsed_files"), table(spark, d, "security_issues"))


@query("p7_found")
def p7_found(spark, d):
    return provenance.found(table(spark, d, "parsed_files"), table(spark, d, "upstream_files"))


@query("p7_scores")
def p7_scores(spark, d):
    return provenance.scored(table(spark, d, "parsed_files"), table(spark, d, "upstream_files"))


@query("p10_found")
def p10_found(spark, d):
    return reading.found(table(spark, d, "documents"), table(spark, d, "reading_labels"))


@query("p10_scores")
def p10_scores(spark, d):
    return reading.levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))
