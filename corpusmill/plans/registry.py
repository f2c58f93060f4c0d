"""Queries of the core and their SQL, by name. ``query`` registers one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import nested
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


# Declarations level by level: whatever way siblings are written, they become a list; nulls take no place.
_LIST = "CASE WHEN v IS NULL OR json_type(v) = 'NULL' THEN [] WHEN json_type(v) = 'VARCHAR' AND json_valid(v->>'$') AND left(trim(v->>'$'), 1) IN ('[', '{{') THEN json_extract(CAST(v->>'$' AS JSON), '$[*]') WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') WHEN json_type(v) = 'OBJECT' AND json_exists(v, '$.name') THEN [v] WHEN json_type(v) = 'OBJECT' AND json_exists(v, '$.\"0\"') THEN list_transform(list_sort(list_transform(json_keys(v), lambda k: k::INT)), lambda k: json_extract(v, '$.\"' || k || '\"')) WHEN json_type(v) = 'OBJECT' THEN json_extract(v, '$.declarations[*]') ELSE {scalar} END"
_NODES = f"""WITH RECURSIVE f AS (SELECT DISTINCT ON (file_id) file_id, CASE WHEN json_valid(declarations) THEN CAST(declarations AS JSON) END AS d, CASE WHEN json_valid(imports) THEN CAST(imports AS JSON) END AS i FROM parsed_files ORDER BY file_id, ingested_at DESC NULLS LAST, collected_at DESC NULLS LAST),
 top AS (SELECT file_id, list_filter({_LIST.format(scalar="[]")}, lambda x: json_type(x) = 'OBJECT') AS xs FROM (SELECT file_id, d AS v FROM f)),
 n AS (SELECT file_id, (k - 1)::VARCHAR AS node_path, '' AS parent_path, xs[k] AS x FROM (SELECT file_id, xs, unnest(generate_series(1, len(xs))) AS k FROM top)
  UNION ALL SELECT file_id, parent || '.' || (k - 1)::VARCHAR, parent, xs[k] FROM (SELECT file_id, parent, xs, unnest(generate_series(1, len(xs))) AS k FROM (SELECT file_id, node_path AS parent, list_filter({_LIST.format(scalar="[]")}, lambda x: json_type(x) = 'OBJECT') AS xs FROM (SELECT file_id, node_path, json_extract(x, '$.children') AS v FROM n)))),
 m AS (SELECT file_id, list_filter(CASE WHEN v IS NULL OR json_type(v) = 'NULL' THEN [] WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') ELSE [v] END, lambda x: json_type(x) <> 'NULL') AS xs FROM (SELECT file_id, i AS v FROM f))"""


@query("p2_found", _NODES + " SELECT file_id, 'declaration' AS node_kind, node_path, parent_path FROM n UNION ALL SELECT file_id, 'import', (k - 1)::VARCHAR, '' FROM (SELECT file_id, unnest(generate_series(1, len(xs))) AS k FROM m)")
def p2_found(spark, d):
    return nested.found(table(spark, d, "parsed_files"))


@query("p2_tables")
def p2_tables(spark, d):
    return nested.tables(table(spark, d, "parsed_files"))


@query("p2_declarations", _NODES + " SELECT file_id AS record_id, node_path, parent_path, x->>'$.kind' AS kind, x->>'$.name' AS name, (x->>'$.start_line')::BIGINT AS start_line, (x->>'$.end_line')::BIGINT AS end_line, x->>'$.signature' AS signature, x->>'$.docstring' AS docstring FROM n")
def p2_declarations(spark, d):
    typed = nested.related(table(spark, d, "parsed_files"), "file_id")["declaration"]
    return typed.select("record_id", "node_path", "parent_path", "kind", "name", "start_line", "end_line", "signature", "docstring")


@query("p2_modifiers", _NODES + " SELECT file_id AS record_id, node_path || '/modifiers.' || (k - 1) AS node_path, node_path AS parent_path, (k - 1)::INT AS ord, ms[k]->>'$' AS value FROM (SELECT file_id, node_path, ms, unnest(generate_series(1, len(ms))) AS k FROM (SELECT file_id, node_path, json_extract(x, '$.modifiers[*]') AS ms FROM n))")
def p2_modifiers(spark, d):
    return nested.related(table(spark, d, "parsed_files"), "file_id")["declaration.modifiers"].select("record_id", "node_path", "parent_path", "ord", "value")


@query("p2_depths", _NODES + " SELECT file_id, count(*) AS declarations, max(len(string_split(node_path, '.')))::INT AS max_depth FROM n GROUP BY 1")
def p2_depths(spark, d):
    nodes = nested.found(table(spark, d, "parsed_files")).filter("node_kind = 'declaration'")
    return nodes.groupBy("file_id").agg(F.count("*").alias("declarations"), F.max(F.size(F.split("node_path", "[.]"))).alias("max_depth"))


@query("p2_schema")
def p2_schema(spark, d):
    return nested.schema_edges(table(spark, d, "parsed_files"))
