"""Items of provider answers: one API answer per row in, one item per row out.

The envelope is opened with ``from_json`` inside the JVM; array elements stay
JSON text until an operator asks for fields, so only what is used is parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The key that holds the items of a provider's answer.
ENVELOPES = {
    "france_travail": "resultats",
    "adzuna": "results",
    "jsearch": "data",
    "ashby": "jobs",
    "lever": "data",
    "remoteok": "data",
}


def json_list(text: Column) -> Column:
    """JSON text as an array of JSON texts; a lone object is a list of one.

    Null, broken or scalar text gives null.
    """
    t = F.trim(text)
    return (
        F.when(t.startswith("["), F.from_json(t, "array<string>"))
        .when(t.startswith("{"), F.when(F.from_json(t, "struct<jobweave_probe:string>").isNotNull() & _valid(t), F.array(t)))
    )


def _valid(t: Column) -> Column:
    return F.try_parse_json(t).isNotNull()


def items(pages: DataFrame) -> DataFrame:
    """``page_id, source, board, fetched_at, items array<string>``, one row per page.

    A top-level array is the list itself; an object is opened at its
    provider's envelope key, and an item alone under that key counts as a list
    of one. Null or broken payloads keep their page out. Pages delivered twice
    with the same payload are one page.
    """
    envelope = F.from_json("payload", "struct<" + ",".join(f"{k}:string" for k in sorted(set(ENVELOPES.values()))) + ">")
    key = F.lit(None).cast("string")
    for source, name in ENVELOPES.items():
        key = F.when(F.col("source") == source, F.col(f"__env.{name}")).otherwise(key)
    top = F.trim("payload")
    return (
        pages.select("page_id", "source", "board", "fetched_at", "payload")
        .where(F.col("payload").isNotNull())
        .withColumn("__env", F.when(top.startswith("{"), envelope))
        .select(
            "page_id", "source", "board", "fetched_at",
            F.when(top.startswith("["), F.from_json(top, "array<string>")).otherwise(json_list(key)).alias("items"),
        )
        .where(F.col("items").isNotNull())
    )


def exploded(pages: DataFrame) -> DataFrame:
    """``page_id, source, board, fetched_at, item_no, item``; item_no counts from 0, nulls keep their place."""
    return items(pages).select("page_id", "source", "board", "fetched_at", F.posexplode("items").alias("item_no", "item")).where(
        F.col("item").isNotNull()
    )
