"""Queries of the llm operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm import headings, history, leakage, linkage, privacy, tokenizer, toxicity
from jobweave.session import table

#: Key under which p3_redacted makes pseudonyms; a deployment passes its own.
DEMO_KEY = "jobweave-demo-key"


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return headings.map_headings(table(spark, d, "cv_sections"), table(spark, d, "section_catalog"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """How many headings come out with each name, unmatched ones included."""
    return p1_found(spark, d).groupBy("name").agg(F.count("*").alias("headings"))


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The headings that mean no entry of the catalogue, each wording with its number of sections."""
    sections = table(spark, d, "cv_sections", "cv_id", "section_no", "raw_heading").distinct()
    lost = p1_found(spark, d).where(F.col("name") == headings.UNMATCHED).select("cv_id", "section_no")
    return sections.join(lost, ["cv_id", "section_no"]).where(F.col("raw_heading").isNotNull()).groupBy("raw_heading").agg(F.count("*").alias("sections"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of personal data, from the same pass that replaces them; a pseudonym depends on its value alone, so rows stay distinct."""
    return privacy.find_personal_data(table(spark, d, "cv_parse"), table(spark, d, "cv_sections"), DEMO_KEY).select("cv_id", "section_no", "kind", "value")


def p3_linked(spark: SparkSession, d: str) -> DataFrame:
    """For each pseudonym, in how many texts it stands: equal values stay linked across CVs."""
    found = privacy.find_personal_data(table(spark, d, "cv_parse"), table(spark, d, "cv_sections"), DEMO_KEY)
    return found.groupBy("kind", "pseudonym").agg(F.countDistinct("cv_id", "section_no").alias("texts"))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return privacy.redact_texts(table(spark, d, "cv_parse"), table(spark, d, "cv_sections"), DEMO_KEY)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeated_postings(table(spark, d, "job_postings"), table(spark, d, "monitor_new_jobs"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return linkage.match_postings(table(spark, d, "job_postings")).select("posting_id_a", "posting_id_b")


def p6_confidence(spark: SparkSession, d: str) -> DataFrame:
    return linkage.match_postings(table(spark, d, "job_postings"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    return p8_ids(spark, d).select("doc_id", tokenizer.decode(F.col("ids")).alias("text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the documents that hold no passage of an item."""
    return leakage.without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.score(table(spark, d, "documents"), table(spark, d, "content_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("abusive").select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", "source", "score", "abusive")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.rates(_scored(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_report, p1_unmatched, p3_found, p3_linked, p3_redacted, p5_found, p6_found, p6_confidence, p8_ids, p8_decoded, p9_found, p9_clean, p10_found, p10_scores, p10_rates,
    )
}

#: Decoding gives every text back; null has no tokens and comes back empty.
ORACLE = {"p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
