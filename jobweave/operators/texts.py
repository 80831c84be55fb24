"""Texts: tokens, salience, repetition, sections of a CV, and how well it was parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.text import fold

#: Token pattern, portable between regex dialects.
TOKEN = r"\p{L}[\p{L}\p{N}]{2,}"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"

#: Headings by section, folded.
HEADINGS = {
    "summary": ("summary", "professional summary", "profile", "about", "about me", "resume", "profil", "a propos"),
    "experience": ("experience", "work experience", "professional experience", "employment", "experience professionnelle", "experiences"),
    "education": ("education", "academic background", "formation", "diplomes"),
    "skills": ("skills", "technical skills", "core competencies", "competences", "competences techniques"),
    "certifications": ("certifications", "licenses", "certificats"),
    "languages": ("languages", "langues"),
    "projects": ("projects", "projets"),
    "interests": ("interests", "hobbies", "loisirs", "centres d'interet"),
}


def tokens(df: DataFrame, key: str, text: str, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """``key, token``: one row for each word of three letters or more that is no stop word, lower-cased."""
    words = df.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)).alias("token"))
    return words.where(~F.col("token").isin(*stopwords)) if stopwords else words


def token_counts(df: DataFrame, key: str, text: str, stopwords: tuple[str, ...] = ()) -> DataFrame:
    return tokens(df, key, text, stopwords).groupBy(key, "token").agg(F.count("*").alias("n"))


def salience(counts: DataFrame, key: str) -> DataFrame:
    """``min(1, 10 tf idf)`` within each text: tf = n / N, idf = ln((N + 1) / (n + 1)) + 1."""
    total = counts.groupBy(key).agg(F.sum("n").alias("total"))
    tf = F.col("n") / F.col("total")
    idf = F.log((F.col("total") + 1) / (F.col("n") + 1)) + 1
    return counts.join(total, key).select(key, "token", "n", F.least(F.lit(1.0), tf * idf * 10).alias("salience"))


def top_per_key(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= n)


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, line``: lines from 0, trimmed of blanks; line ends of either style."""
    return df.select(key, F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("line_no", "raw")).select(key, "line_no", F.trim(F.regexp_replace("raw", r"\s+", " ")).alias("line"))


def repeated_lines(df: DataFrame, key: str, text: str, least_length: int = 10, least_count: int = 3) -> DataFrame:
    kept = lines(df, key, text).where(F.length("line") >= least_length)
    return kept.groupBy(key, "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def heading_name(line: Column) -> Column:
    """The section a line is the heading of, or null."""
    folded = F.rtrim(F.regexp_replace(F.trim(fold(line)), r":+$", ""))
    name = F.lit(None).cast("string")
    for section, headings in HEADINGS.items():
        name = F.when(folded.isin(*headings), section).otherwise(name)
    return name


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, section_no, name, text``: the lines after each heading, joined; lines before the first heading are dropped.

    All lines of a text meet in one row by grouping, so the group is a text.
    """
    marked = lines(df, key, text).withColumn("name", heading_name(F.col("line")))
    w = Window.partitionBy(key).orderBy("line_no")
    placed = marked.withColumn("section_no", F.sum(F.col("name").isNotNull().cast("int")).over(w)).where(F.col("section_no") > 0)
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isNull(), F.struct("line_no", "line")))), lambda x: x["line"])
    return placed.groupBy(key, "section_no").agg(F.max("name").alias("name"), F.regexp_replace(F.array_join(body, "\n"), r"^\s+|\s+$", "").alias("text"))


def parse_confidence(text: Column, has_sections: Column) -> Column:
    """0 for fewer than 50 characters; else 1, less 0.3 without e-mail, 0.4 without sections, 0.2 under 200 characters."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    score = F.lit(1.0) - F.when(text.rlike(EMAIL), 0.0).otherwise(0.3) - F.when(has_sections, 0.0).otherwise(0.4) - F.when(F.length(t) < 200, 0.2).otherwise(0.0)
    return F.when(F.length(t) < 50, F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), score), 6))


def distinct_first(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """First spelling of each value of a key, without regard to case."""
    return df.groupBy(key, F.lower(value).alias("folded")).agg(F.min_by(value, F.struct(order, value)).alias(value))
