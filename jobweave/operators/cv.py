"""CVs from plain text: sections, contact fields, skills, highlights and the claims they make."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.operators.texts import EMAIL, heading_name, parse_confidence, sections
from jobweave.text import fold

#: Fixed value: shape of a telephone number; fewer than LEAST_DIGITS digits are none.
PHONE = r"(?:(?:\+|00)\d{1,3}[\s.-]?)?(?:\(?\d{1,4}\)?[\s.-]?){2,5}\d"
LEAST_DIGITS = 7
#: Lines that stand where a name would, folded; signs that lead a list's lines; most skills that are read.
TITLES = ("curriculum vitae", "cv", "resume")
BULLETS = "-*•◦·"
MOST_SKILLS = 50

#: Verbs of achievement, English and French.
STRONG_VERBS = (
    "led|built|shipped|reduced|increased|launched|automated|designed|developed|delivered|created|implemented|established|negotiated|secured|generated|"
    "achieved|exceeded|improved|transformed|streamlined|optimized|accelerated|expanded|scaled|founded|drove|managed|directed|recruited|trained|mentored|"
    "coached|spearheaded|championed|architected|engineered|migrated|deployed|integrated|refactored|authored|published|presented|closed|won|saved|cut|"
    "halved|doubled|tripled|consolidated|revamped|overhauled|prioritized|orchestrated|coordinated|facilitated|executed|audited|analyzed|identified|"
    "resolved|eliminated|prevented|"
    "piloté|conçu|réduit|augmenté|lancé|automatisé|développé|livré|créé|implémenté|mis en place|négocié|sécurisé|généré|atteint|dépassé|amélioré|"
    "transformé|optimisé|accéléré|étendu|fondé|dirigé|géré|recruté|formé|encadré|architecturé|déployé|intégré|refactorisé|rédigé|publié|présenté|"
    "remporté|économisé|réduit de moitié|doublé|triplé|consolidé|refondu|priorisé|orchestré|coordonné|facilité|exécuté|audité|analysé|identifié|résolu|éliminé"
)
#: Phrases of duty, which lead a line that tells no achievement.
DUTIES = r"^(?:responsible\s+for|worked\s+on|helped\s+|assisted\s+|involved\s+in|participated\s+in|in\s+charge\s+of|tasked\s+with|duties\s+included|a\s+charge\s+de|charge\s+de|responsable\s+de)"
#: Figures that measure an achievement; words before the way it was reached.
MEASURE = (
    r"\d+(?:[.,]\d+)?\s*%|[€$£]\s*\d+|\d+\s*[€$£]|\d+(?:[.,]\d+)?\s*[xX×]|[xX×]\s*\d+(?:[.,]\d+)?|\d+(?:[.,]\d+)?\s*[mMkK]"
    r"|\d+\s+(?:months?|weeks?|days?|years?|mois|semaines?|jours?|ans?)"
)
METHOD = r"\s(?:by|via|using|through|en|a l'aide de|grace a|en utilisant|par)\s"
#: What a claim rests on, by words of a folded line, the first that applies, and what would prove it.
LEADERSHIP = (
    r"(?:led|managed|directed|supervised|oversaw|gere|dirige|encadre).*?\b(?:team\s+of|equipe\s+de)\s*\d+"
    r"|(?:led|managed|directed|supervised|oversaw|gere|dirige|encadre)\s+(?:a\s+)?(?:team\s+)?(?:of\s+)?\d+\s+[a-z0-9_]+"
)
CERTIFIED = r"\b(?:certified|certification|certificat|diplome|awarded|credential)\b"
AWARDED = r"\b(?:award|prize|won|received|prix|recompense|laureat)\b"
PROOF = {
    "metric": "dashboard screenshot, report link, or reference contact",
    "leadership": "reference from a direct report or org chart",
    "certification": "credential URL or certification ID",
    "award": "announcement link or certificate scan",
}


def matches(text: Column) -> Column:
    """Telephone-like pieces of a text that have enough digits, in order."""
    found = F.regexp_extract_all(text, F.lit(f"({PHONE})"), 1)
    return F.filter(found, lambda x: F.length(F.regexp_replace(x, r"\D", "")) >= LEAST_DIGITS)


def first_phone(text: Column) -> Column:
    return F.trim(F.try_element_at(matches(text), F.lit(1)))


def bullets(text: Column) -> Column:
    """Lines without the signs that lead them; blank ones are left out."""
    plain = F.transform(F.split(text, "\n"), lambda x: F.trim(F.ltrim(F.trim(x), F.lit(BULLETS))))
    return F.filter(plain, lambda x: x != "")


def section_texts(cvs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, name, text``: each section's text; the last one of a name counts."""
    found = sections(cvs, key, text)
    return found.groupBy(key, "name").agg(F.max_by("text", "section_no").alias("text"))


def highlights(cvs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, no, line``: lines of the experience section, counted from 0."""
    own = section_texts(cvs, key, text).where(F.col("name") == "experience")
    return own.select(key, F.posexplode(bullets(F.col("text"))).alias("no", "line"))


def skills(cvs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, no, skill``: at most MOST_SKILLS entries of the skills section, in order."""
    own = section_texts(cvs, key, text).where(F.col("name") == "skills")
    parts = F.filter(F.transform(F.split("text", "[,\n;•]"), lambda x: F.trim(x)), lambda x: x != "")
    return own.select(key, F.posexplode(F.slice(parts, 1, MOST_SKILLS)).alias("no", "skill"))


def basics(cvs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, name, email, phone``: the first line that is no contact and no title, the first address and number."""
    t = F.col(text)
    plain = F.transform(F.split(t, r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    name = F.filter(plain, lambda x: (x != "") & ~x.rlike(EMAIL) & (F.size(matches(x)) == 0) & ~fold(x).isin(*TITLES))
    return cvs.select(key, F.try_element_at(name, F.lit(1)).alias("name"), F.nullif(F.regexp_extract(t, EMAIL, 0), F.lit("")).alias("email"), first_phone(t).alias("phone"))


def parsed(cvs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, contact fields, sections, confidence and warnings of each CV: the whole reading in one table.

    Null texts are left out; a text without known headings has no sections.
    """
    told = cvs.where(F.col(text).isNotNull())
    by_name = section_texts(told, key, text).groupBy(key).agg(F.array_sort(F.collect_list("name")).alias("sections"))
    has = F.exists(F.split(text, r"\r\n|\r|\n"), lambda x: heading_name(F.regexp_replace(x, r"\s+", " ")).isNotNull())
    size = F.length(F.regexp_replace(text, r"^\s+|\s+$", ""))
    warn = lambda test, name: F.when(test, F.lit(name))
    some = F.array(warn(~F.col(text).rlike(EMAIL), "no_email_detected"), warn(~has, "no_recognized_sections"), warn(size < 200, "very_short_text"))
    warnings = F.when(size < 50, F.array(F.lit("scanned_or_empty"))).otherwise(F.array_compact(some))
    judged = told.select(key, parse_confidence(F.col(text), has).alias("confidence"), warnings.alias("warnings"))
    empty = F.array().cast("array<string>")
    return basics(told, key, text).join(judged, key).join(by_name, key, "left").withColumn("sections", F.coalesce("sections", empty))


def first_verb(line: Column) -> tuple[Column, Column]:
    """The word a line begins with (a duty's first word, a compound verb whole), and whether it is a weak one."""
    low = F.lower(F.trim(line))
    strong = STRONG_VERBS.split("|")
    compound = F.lit(None).cast("string")
    for verb in ("mise en place", "réduit de moitié", "mis en place"):
        compound = F.when(low.startswith(verb), verb).otherwise(compound)
    first = F.nullif(F.regexp_extract(low, r"^([\p{L}\p{N}_]+(?:\s+en(?![\p{L}\p{N}_]))?)", 1), F.lit(""))
    duty = fold(low).rlike(DUTIES)
    verb = F.when(duty, first).otherwise(F.coalesce(compound, first))
    stem = F.rtrim(F.rtrim(verb, F.lit("é")), F.lit("e"))
    return verb, F.when(verb.isNull(), False).otherwise(duty | ~(verb.isin(*strong) | stem.isin(*strong)))


def achievement(line: Column) -> dict[str, Column]:
    """What a line of a CV tells: ``verb``, ``weak``, ``object`` (without verb and way), ``measured``, ``way``."""
    verb, weak = first_verb(line)
    rest = F.trim(F.substr(F.trim(line), F.coalesce(F.length(verb), F.lit(0)) + 1))
    # Folding keeps a text's length, so places in the folded line are places in the line.
    at = F.coalesce(F.nullif(F.regexp_instr(fold(rest), F.lit(METHOD)), F.lit(0)), F.length(rest) + 1)
    way = F.nullif(F.trim(F.regexp_replace(F.substr(rest, at), rf"(?iu)^\s(?:by|via|using|through|en utilisant|en|à l'aide de|a l'aide de|grâce à|grace a|par)\s", "")), F.lit(""))
    return {"verb": verb, "weak": weak, "object": F.trim(F.substr(rest, F.lit(1), at - 1)), "measured": line.rlike(MEASURE), "way": way}


def claim(line: Column) -> Column:
    """What a line's claim rests on: the first kind that applies, or null."""
    low = fold(line)
    return F.when(line.rlike(MEASURE), "metric").when(low.rlike(LEADERSHIP), "leadership").when(low.rlike(CERTIFIED), "certification").when(low.rlike(AWARDED), "award")


def claims(found: DataFrame, key: str) -> DataFrame:
    """``key, no, kind, proof`` of the highlights that claim something."""
    proof = F.create_map(*(F.lit(x) for kv in PROOF.items() for x in kv))
    return found.select(key, "no", claim(F.col("line")).alias("kind")).where(F.col("kind").isNotNull()).withColumn("proof", F.element_at(proof, F.col("kind")))


def evidence(cvs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, origin, no, line``: all lines that may speak for a candidate: highlights, sentences of the summary over 15 characters, skills."""
    summary = section_texts(cvs, key, text).where(F.col("name") == "summary")
    said = F.filter(F.transform(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"[.!?]\s"), lambda x: F.trim(x)), lambda x: F.length(x) > 15)
    parts = [
        highlights(cvs, key, text).select(key, F.lit("highlight").alias("origin"), "no", "line"),
        summary.select(key, F.lit("summary").alias("origin"), F.posexplode(said).alias("no", "line")),
        skills(cvs, key, text).select(key, F.lit("skill").alias("origin"), "no", F.col("skill").alias("line")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def best_evidence(lines_: DataFrame, key: str, terms: list[str], most: int = 4) -> DataFrame:
    """The ``most`` lines of each CV that share most words with ``terms``; lines that share none are left out, ties in order of place."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(r"[\p{L}\p{N}+#]{2,}"), 0))
    shared = F.size(F.array_intersect(words, F.lit([t.lower() for t in terms])))
    order = Window.partitionBy(key).orderBy(F.desc("shared"), "origin", "no")
    return lines_.withColumn("shared", shared).where("shared > 0").withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= most)


def flat_text(cvs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, text``: contact fields, summary, highlights and skills of each CV as one text, in this order, one piece a line."""
    own = evidence(cvs, key, text)
    pieces = F.array_sort(F.collect_list(F.struct("origin", "no", "line")))
    of = lambda origin: F.array_join(F.transform(F.filter(pieces, lambda x: x["origin"] == origin), lambda x: x["line"]), "\n")
    parts = own.groupBy(key).agg(*(F.nullif(of(o), F.lit("")).alias(o) for o in ("summary", "highlight", "skill")))
    return basics(cvs.where(F.col(text).isNotNull()), key, text).join(parts, key, "left").select(key, F.concat_ws("\n", "name", "email", "phone", "summary", "highlight", "skill").alias("text"))
