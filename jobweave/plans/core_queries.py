"""Queries of the general data-processing operators on provider payloads; SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.operators import nested, timestamps, units
from jobweave.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.posting_times(table(spark, d, "provider_pages"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return units.yearly_pay(table(spark, d, "provider_pages"), table(spark, d, "fx_rates"), table(spark, d, "pay_periods"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.nested_values(table(spark, d, "provider_pages"))


def p7_triples(spark: SparkSession, d: str) -> DataFrame:
    """How many leaves each path of each source's answers has, over whole payloads."""
    triples = nested.path_triples(table(spark, d, "provider_pages"), "payload", ["source"])
    return triples.groupBy("source", "path").agg(F.count("*").alias("leaves"))


QUERIES = {f.__name__: f for f in (p2_found, p4_found, p7_found, p7_triples)}


def _json(x: str) -> str:
    """A value that may be written as JSON text."""
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND regexp_matches({x} ->> '$', '^\\s*[{{\\[]') AND json_valid({x} ->> '$') THEN ({x} ->> '$')::JSON ELSE {x} END"


def _list(x: str) -> str:
    """A list's elements; a lone value is a list of one, null and absent ones are empty."""
    return f"CASE WHEN json_type({x}) = 'ARRAY' THEN from_json({x}, '[\"JSON\"]') WHEN json_type({x}) = 'NULL' OR {x} IS NULL THEN []::JSON[] ELSE [{x}] END"


def _each(source: str, value: str, keep: str, number: str) -> str:
    """``source``'s rows, one for each element of ``value``, as ``i`` with its place."""
    return f"(SELECT {keep}, n - 1 AS {number}, xs[n] AS i FROM (SELECT {keep}, xs, unnest(generate_series(1, len(xs))) AS n FROM (SELECT {keep}, {_list('v')} AS xs FROM (SELECT {keep}, {_json('v')} AS v FROM (SELECT {keep}, {value} AS v FROM {source})))))"


def _items(source: str, path: list[str]) -> str:
    pages = f"(SELECT DISTINCT page_id, payload::JSON AS j FROM provider_pages WHERE source = '{source}' AND payload IS NOT NULL AND json_valid(payload))"
    for key in path[:-1]:
        pages = f"(SELECT page_id, {_json('j')} AS j FROM (SELECT page_id, j -> '$.{key}' AS j FROM {pages}))"
    return f"(SELECT page_id, item_no, {_json('i')} AS i FROM {_each(pages, f'j -> {chr(39)}$.{path[-1]}{chr(39)}', 'page_id', 'item_no')})"


_SCALAR = "json_type(i) NOT IN ('NULL', 'OBJECT', 'ARRAY')"
_COMPONENTS = _each(
    f"(SELECT page_id, item_no, {_json('c')} AS c FROM (SELECT page_id, item_no, i -> '$.compensation' AS c FROM {_items('ashby', ['jobs'])}))", "c -> '$.summaryComponents'", "page_id, item_no", "elem_no"
)
_LINES = _each(
    f"(SELECT page_id, item_no, {_json('h')} AS h FROM (SELECT page_id, item_no, i -> '$.job_highlights' AS h FROM {_items('jsearch', ['data'])}))", "h -> '$.Qualifications'", "page_id, item_no", "elem_no"
)
ORACLE = {
    "p7_found": f"""SELECT DISTINCT page_id, item_no::INT AS item_no, field, elem_no::INT AS elem_no, i ->> '$' AS value FROM (
SELECT page_id, item_no, 'usajobs.MatchedObjectId' AS field, -1 AS elem_no, i -> '$.MatchedObjectId' AS i FROM {_items('usajobs', ['SearchResult', 'SearchResultItems'])}
UNION ALL SELECT page_id, item_no, 'jsearch.job_highlights.Qualifications', elem_no, i FROM {_LINES}
UNION ALL SELECT page_id, item_no, 'ashby.compensation.summaryComponents.value', elem_no, i -> '$.value' FROM (SELECT page_id, item_no, elem_no, {_json('i')} AS i FROM {_COMPONENTS})) WHERE {_SCALAR}""",
}
