"""Checks on CV texts: periods of work, gaps, repeated words, length, bullets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.operators.texts import lines
from jobweave.text import let


def stints(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, first, last``: distinct periods written "(2007-2010)" in a text."""
    found = F.regexp_extract_all(text, F.lit(r"\(((?:19|20)\d{2}-(?:19|20)\d{2})\)"), 1)
    each = df.select(key, F.explode(found).alias("p"))
    return each.select(key, F.substring("p", 1, 4).cast("int").alias("first"), F.substring("p", 6, 4).cast("int").alias("last")).where("first <= last").distinct()


def gaps(periods: DataFrame, key: str, more_than: int = 1) -> DataFrame:
    """``key, after, until``: years without work between a period's end and the next one's start."""
    w = Window.partitionBy(key).orderBy("first", "last")
    return periods.withColumn("until", F.lead("first").over(w)).where(F.col("until") - F.col("last") > more_than).select(key, F.col("last").alias("after"), "until")


def work_years(periods: DataFrame, key: str) -> DataFrame:
    """Years in all (overlaps count twice), periods, and periods of under a year."""
    return periods.groupBy(key).agg(F.sum(F.col("last") - F.col("first")).alias("years"), F.count("*").alias("periods"), F.sum((F.col("last") == F.col("first")).cast("int")).alias("short"))


def doubled_words(text: Column) -> Column:
    """How often a word of two letters or more stands twice in a row, whatever its case."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{2,}"), 0)
    twice = lambda w: F.size(F.filter(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: a == b), lambda same: same))
    return let(words, twice)


def pages(df: DataFrame, key: str, text: str) -> DataFrame:
    """Estimated pages: the greater of characters / 3500 and lines that aren't blank / 45."""
    filled = lines(df, key, text).groupBy(key).agg(F.sum((F.col("line") != "").cast("int")).alias("filled"))
    return df.join(filled, key).select(key, F.round(F.greatest(F.length(text) / 3500, F.col("filled") / 45), 4).alias("pages"))


def answer_metrics(text: Column) -> dict[str, Column]:
    """Words, seconds at 130 words a minute, and whether a figure is given."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return {"words": words, "seconds": F.round(words / 130 * 60).cast("int"), "quantified": text.rlike(r"[0-9]{2,}|[0-9] ?[%€$£k]")}
