"""Offers: title, level, hard requirements, terms by salience, and how often terms stand in a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.operators.texts import lines
from jobweave.text import fold, let

#: Fixed value: a demand for years of experience, in folded text.
YEARS = r"\b(\d+)\s*\+?\s*(?:years?|ans?)\s*(?:of\s+)?(?:experience)?\b"
#: Words of level, folded, and the form they are reported in.
LEVEL = r"\b(junior|senior|lead|principal|stagiaire|stage|confirme)\b"
LEVEL_NAMES = {"stage": "stagiaire", "confirme": "confirmé"}
#: Longest text before a demand for years that still counts as the name of a skill.
SKILL_CHARS = 50
#: Words that begin with a capital without being names of tools, English and French.
PLAIN_WORDS = (
    "The A An And Or But In On At To For Of With By From Is Are Was Were Be We You It As If This That These Those Our Your Its Their My Who Which What "
    "Le La Les De Du Des Un Une Et Ou En Dans Sur Avec Par Pour Est Sont Nous Vous Il Elle Ils Elles Ce Cette Ces "
    "Requirements Required Skills Experience Background Education Benefits Responsibilities About Missions Profil Compétences Formation"
).split()
#: Names of tools that count in lower case too.
TOOLS = (
    "python go rust java scala ruby swift kotlin typescript javascript html css sql bash linux docker kubernetes terraform ansible nginx redis postgres "
    "postgresql mysql mongodb elasticsearch kafka rabbitmq graphql rest api grpc spark hadoop airflow dbt pandas numpy aws gcp azure k8s git github gitlab "
    "react vue angular nodejs django flask"
).split()
MOST_TERMS = 15
#: Words that no term is made of, English and French, of three letters or more.
STOPWORDS = (
    "the and but for with from are was were been being have has had does did will would could should may might shall can not nor yet both either neither each "
    "such than too very then that this these those you she they our your his her its their who which what where when how about between into through during "
    "before after above below down out off over under again further while although since until unless also just more most other only same any all some one "
    "two three year years experience ability excellent good strong knowledge skills position team work working role join looking candidate candidates apply "
    "application les des une dans sur avec par pour est sont être avoir vous nous elle ils elles qui que quoi dont pas plus très bien tout tous toute toutes "
    "cette ces mon ton son notre votre leur leurs aux ans poste équipe equipe candidat rejoindre capacité capacite excellente bonne forte connaissance "
    "compétence competence expérience"
).split()


def title(text: Column) -> Column:
    """The first line that isn't blank."""
    return F.try_element_at(F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""), F.lit(1))


def level(text: Column) -> Column:
    """The first word of level in a text, else the first demand for years as "N+ years", else null."""
    folded = fold(text)
    word = F.nullif(F.regexp_extract(folded, LEVEL, 1), F.lit(""))
    names = F.create_map(*(F.lit(x) for kv in LEVEL_NAMES.items() for x in kv))
    years = F.nullif(F.regexp_extract(folded, YEARS, 1), F.lit(""))
    return F.coalesce(F.try_element_at(names, word), word, F.concat(years, F.lit("+ years")))


def is_hard(line: Column) -> Column:
    return fold(line).rlike(YEARS)


def hard_requirements(offers: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, line, skill``: lines that demand years of experience; ``skill`` is what stands before, where that is short."""
    found = lines(offers, key, text).where(is_hard(F.col("line")))
    before = F.rtrim(F.rtrim(F.substr("line", F.lit(1), F.regexp_instr(fold(F.col("line")), F.lit(YEARS)) - 1)), F.lit(","))
    plain = F.trim(F.ltrim(before, F.lit("-*•◦·▸▹–— ")))
    return found.select(key, "line_no", "line", F.when((plain != "") & (F.length(plain) < SKILL_CHARS), plain).alias("skill"))


def tool_terms(offers: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, n, salience, rank_no``: the MOST_TERMS terms of an offer that look like names of tools, by salience, ties by name.

    Words with a capital that aren't plain words, and known tools in any
    spelling. Salience is tf x idf within the offer, as elsewhere.
    """
    words = offers.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(r"[\p{L}][\p{L}\p{N}+#]+"), 0)).alias("word")).withColumn("term", F.lower("word"))
    kept = words.where((F.length("term") > 2) & ~F.col("term").isin(*STOPWORDS))
    counts = kept.groupBy(key, "term").agg(F.count("*").alias("n"), F.max(F.col("word").rlike(r"^[A-Z]") & ~F.col("word").isin(*PLAIN_WORDS)).alias("named"))
    total = Window.partitionBy(key)
    rated = counts.withColumn("total", F.sum("n").over(total))
    tf, idf = F.col("n") / F.col("total"), F.log((F.col("total") + 1) / (F.col("n") + 1)) + 1
    rated = rated.where(F.col("named") | F.col("term").isin(*TOOLS)).withColumn("salience", F.round(F.least(F.lit(1.0), tf * idf * 10), 6))
    order = Window.partitionBy(key).orderBy(F.desc("salience"), "term")
    return rated.withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= MOST_TERMS).select(key, "term", "n", "salience", "rank_no")


def spaced(text: Column) -> Column:
    """Words of a text with two blanks between them, so that a word may end one hit and begin the next."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}+#]+"), 0), "  "), F.lit(" "))


def frequency(term: Column, text: Column) -> Column:
    """How often a term stands in a text as whole words, whatever its case and punctuation."""
    return let(spaced(term), lambda t: times(t, spaced(text)))


def times(term: Column, text: Column) -> Column:
    """``frequency`` of a term in a text, both ``spaced`` already."""
    return F.when(term == "  ", 0).otherwise(((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int"))


def requirement_terms(offers: DataFrame, key: str, text: str, phrases: list[str], most: int = 20) -> DataFrame:
    """``key, term, rank_no``: phrases that an offer holds, in the order given, then its most frequent words, ``most`` in all.

    Words of a phrase that was found and stop words are left out; ties go to
    the word that stands first.
    """
    held = F.filter(F.lit(phrases), lambda p: F.lower(F.col(text)).contains(p)) if phrases else F.array().cast("array<string>")
    base = offers.where(F.col(text).isNotNull()).select(key, held.alias("held"), F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}][\p{L}.#+-]{2,}"), 0).alias("words"))
    taken = F.flatten(F.transform("held", lambda p: F.split(p, r"\s+")))
    each = base.select(key, taken.alias("taken"), F.posexplode("words").alias("pos", "term")).where(~F.col("term").isin(*STOPWORDS) & ~F.array_contains("taken", F.col("term")))
    counts = each.groupBy(key, "term").agg(F.count("*").alias("n"), F.min("pos").alias("pos")).select(key, "term", F.lit(1).alias("kind"), (-F.col("n")).alias("less"), "pos")
    first = base.select(key, F.posexplode("held").alias("pos", "term")).select(key, "term", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("less"), "pos")
    order = Window.partitionBy(key).orderBy("kind", "less", "pos")
    return first.unionByName(counts).withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= most).select(key, "term", "rank_no")


def questions(bank: DataFrame, family: str, kind: str) -> DataFrame:
    """Rows of a bank of questions for a family of roles and a kind, whatever their case; rows without a text are left out."""
    if kind.lower().strip() not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    same = lambda c, x: F.lower(F.trim(c)) == x.lower().strip()
    return bank.where(same("family", family) & same("kind", kind) & (F.col("text") != ""))


#: Kinds of interview questions; levels in order.
KINDS = ("behavioral", "technical", "case")
LADDER = ("junior", "mid", "senior", "lead")


def level_distance(a: Column, b: Column, ladder: tuple[str, ...] = LADDER) -> Column:
    """Steps between two levels; an unknown level stands at 99, so two unknown ones are 0 apart."""
    names = F.lit(list(ladder))
    at = lambda c: F.when(F.array_position(names, c) > 0, F.array_position(names, c) - 1).otherwise(99)
    return F.abs(at(a) - at(b)).cast("int")
