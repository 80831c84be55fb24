"""New batches against all accepted history, by content-defined chunks.

A posting's text is cut into chunks where a rolling hash over its words says
so, so an edit changes the chunks around it and leaves the others. A table of
chunks of all accepted records persists (``ChunkTable``); a batch is checked by
joining its chunks with that table, and only accepted records' chunks are
appended, so no accepted text is read twice. The bytes of a record's chunks that
earlier records of one identity hold, against its own or the shortest of
theirs, are its coverage; enough coverage makes it a near-duplicate, and an exact check of employer, post, level and place
decides whether it is the same vacancy. A record's id at its source and its link
count as chunks that cover everything: they open a link whatever became of the
text, and the exact check follows all the same.

Chunk keys hold source, post and level, so a common turn of phrase doesn't
gather unrelated records. Accepted records that tell the same employer and place
are one class, of which the earliest stands for all within a key; classes are
formed before the join, with partial sums, so neither a hot employer nor a group
of copies is paired: work grows with the new records and the identities that
share a chunk. Links to the own identity are sure; a record without one is
compared with the other classes of its chunks, as far as both tell, and all are
compared with earlier records that don't tell employer or place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm.linkage import facts_of
from jobweave.session import checkpoint, remove, shared_folder

#: Share of the shorter text's bytes in shared chunks that makes two records near-duplicates.
COVERAGE = 0.3
#: Guard against links that run in circles; each round doubles the length of the chains that are resolved.
MAX_ROUNDS = 60

#: What is compared of two records besides their chunks.
FACTS = ["employer", "employer_rest", "city", "region", "programme"]
POSTING = ["posting_id", "source", "source_id", "url", "title", "company", "location", "description"]
#: Ids and links that stand for none.
_NONE = r"(?i)^\W*(?:n/?a|none|null|nan|unknown|inconnu|nc|0*|x*)\W*$"


def _mark(tag: str, column: str) -> Column:
    """A pseudo-chunk of an id or a link; null where it says nothing."""
    c = F.trim(column)
    return F.when((c != "") & ~c.rlike(_NONE), F.struct(F.xxhash64(F.lit(tag), c).alias("h"), F.lit(-1).alias("n")))


def records_of(facts: DataFrame) -> DataFrame:
    """One row for each record: its facts, and its chunks with their bytes, -1 where one is an id or a link.

    ``class`` is equal for records of one told identity, else the record's own.
    """
    told = (F.col("employer") != "") & (F.col("city") != "")
    marks = F.filter(F.array(_mark("id", "source_id"), _mark("url", "url")), lambda m: m.isNotNull())
    own = F.xxhash64("source", "post", "level", F.when(told, F.col("employer")), F.when(told, F.col("city")), F.when(~told, F.col("posting_id")))
    return facts.select(
        F.col("posting_id").alias("id"), "source", "post", "level", *FACTS, told.alias("told"), own.alias("class"),
        F.aggregate("chunks", F.lit(0), lambda s, c: s + c["n"]).alias("total"), F.concat(F.array_distinct("chunks"), marks).alias("chunks"),
    )


def chunks_of(records: DataFrame) -> DataFrame:
    """The chunk-to-record table, in numbers only: one row for each distinct chunk of a record. ``key`` holds source, post, level and chunk."""
    each = records.select("id", "total", "class", "told", F.xxhash64("source", "post", "level").alias("own"), F.inline("chunks"))
    return each.select(F.xxhash64("own", "h").alias("key"), "n", "id", "total", "class", "told")


def _agree() -> Column:
    """Whether two records may announce one vacancy, as far as both tell."""
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    both = lambda c: (x(c) != "") & (y(c) != "")
    employer = ~both("employer") | (F.levenshtein(x("employer"), y("employer")) <= 2)
    place = F.when(both("city"), x("city") == y("city")).otherwise(~both("region") | (x("region") == y("region")))
    return employer & place & (~both("programme") | (F.levenshtein(x("programme"), y("programme")) <= 2))


def links(new: DataFrame, accepted: DataFrame, records: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``b, a``: for each new record its near-duplicates among earlier ones.

    ``new`` and ``accepted`` are chunk tables; ``accepted`` may hold the new
    records as well, so repeats within a batch are found too. ``records`` has
    the facts of both, looked up only for pairs that share enough.
    """
    # A row delivered twice, on either side, counts a chunk once.
    own = new.groupBy("key", F.col("id").alias("b")).agg(F.max("n").alias("n"), F.min("total").alias("b_total"), F.min("class").alias("b_class"))
    classes = accepted.groupBy("key", "class").agg(F.min("id").alias("a"), F.min_by("total", "id").alias("a_total"), F.max("told").alias("told"))
    pairs = own.join(classes, "key").where(F.col("a") < F.col("b"))
    shared = pairs.groupBy("b", "class").agg(
        F.sum(F.greatest("n", F.lit(0))).alias("shared"), F.max(F.col("n") < 0).alias("same_id"), F.min("a").alias("a"),
        F.min(F.least("a_total", "b_total")).alias("least"), F.max("told").alias("told"), F.max(F.col("class") == F.col("b_class")).alias("sure"),
    )
    enough = lambda times: F.col("same_id") | (F.col("shared") >= times * coverage * F.col("least"))
    near = checkpoint(shared.where(enough(1)).select("b", "a", "told", "sure", enough(2).alias("much")))
    sure = near.where("sure").select("b", "a")
    other = near.where("not sure").join(sure.select("b", F.lit(True).alias("has")).distinct(), "b", "left").where(F.col("has").isNull() | ~F.col("told"))
    side = lambda k, name: records.select(F.col("id").alias(k), F.struct(*FACTS).alias(name))
    # Where nothing but the text speaks, the name of the programme or a good part of the text must.
    named = (F.col("x.programme") != "") & (F.col("x.programme") == F.col("y.programme"))
    loose = other.join(side("b", "x"), "b").join(side("a", "y"), "a").where(_agree() & (named | F.col("much"))).select("b", "a")
    return sure.unionByName(loose).distinct()


def earliest(found: DataFrame) -> DataFrame:
    """``b, a``: the earliest record each repeated record goes back to, through records it is linked with.

    Each round replaces a record's target by its target's target, so chains of
    2^k links take k rounds. Links go back in id order, so there are no circles.
    """
    state = checkpoint(found.groupBy("b").agg(F.min("a").alias("a")))
    for _ in range(MAX_ROUNDS):
        up = state.select(F.col("b").alias("a"), F.col("a").alias("root"))
        moved = checkpoint(state.join(up, "a", "left").select("b", F.coalesce("root", "a").alias("a"), F.col("root").isNotNull().alias("moved")))
        changed = not moved.where("moved").isEmpty()
        state = moved.select("b", "a")
        if not changed:
            return state
    raise RuntimeError(f"chains of links aren't resolved after {MAX_ROUNDS} rounds")


def _read(postings: DataFrame) -> DataFrame:
    """Records of postings; columns that a table lacks count as null."""
    rows = postings.select(*(F.col(c) if c in postings.columns else F.lit(None).cast("string").alias(c) for c in POSTING))
    text = rows.withColumns({c: F.col(c).cast("string") for c in ("source_id", "url")})
    return records_of(facts_of(text, "source_id", "url", chunks=True))


class ChunkTable:
    """The persistent table of accepted records and their chunks, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, coverage: float = COVERAGE) -> None:
        self.spark, self.path, self.coverage = spark, path, coverage

    def append(self, accepted: DataFrame) -> None:
        """Adds accepted postings: the one time their texts are read."""
        _read(accepted).write.mode("append").parquet(self.path)

    def check(self, batch: DataFrame) -> DataFrame:
        """``posting_id_a, posting_id_b`` of the batch's repeats of accepted postings and of each other.

        Reads the batch's texts and the table's numbers, no accepted text.
        """
        fresh = checkpoint(_read(batch))
        known = self.spark.read.parquet(self.path).unionByName(fresh)
        found = links(chunks_of(fresh), chunks_of(known), known, self.coverage)
        return earliest(found).select(F.col("a").alias("posting_id_a"), F.col("b").alias("posting_id_b"))

    def accept(self, batch: DataFrame) -> DataFrame:
        """Checks a batch, appends what was accepted, and returns the repeats.

        A repeat's chunks go to the accepted record it repeats: a later row may
        share its text with the repeat only.
        """
        repeats = checkpoint(self.check(batch))
        root = repeats.select(F.col("posting_id_b").alias("posting_id"), "posting_id_a")
        own = batch.join(root, "posting_id", "left").withColumn("posting_id", F.coalesce("posting_id_a", "posting_id")).drop("posting_id_a")
        self.append(own)
        return repeats


def repeated_postings(history: DataFrame, new: DataFrame, path: str | None = None) -> DataFrame:
    """``posting_id_a, posting_id_b``: every new row that announces an accepted vacancy again, with the earliest accepted row.

    The history goes into a chunk table (at ``path``, else in the session's
    shared folder), and the new rows are checked against it as one batch. That gives
    what checking smaller batches one after the other in order of their ids
    gives, as links go back in id order. Rows without id or source are left
    out; a row delivered again counts once; nulls elsewhere say nothing; empty
    tables give an empty result. Texts without words share nothing.
    """
    spark = history.sparkSession
    place = path or f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    table = ChunkTable(spark, place)
    table.append(history)
    found = table.check(new)
    if path is None:
        # The result is a checkpoint of its own.
        remove(spark, place)
    return found
