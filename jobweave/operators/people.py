"""People in pasted texts and networks: who writes, for whom, and who could introduce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.operators.crm import introduction_value
from jobweave.operators.market import name_overlap_join
from jobweave.text import fold

#: Titles of recruiters and names of agencies, in folded text; shapes of names, profiles and contact lines.
RECRUITER = (
    r"\b(?:recruiter|recruteur|recruteuse|talent acquisition|talent partner|talent manager|charge de recrutement|chargee de recrutement|hr business partner|hr manager|"
    r"responsable rh|drh|rrh|head of talent|chief people|people partner|sourcer|sourcing specialist|staffing|placement specialist)\b"
)
AGENCY = (
    r"\b(?:recruitment|recrutement|staffing|headhunt|headhunting|talent partners|esn|ssii|consulting rh|hr consulting|search firm|executive search|interim|manpower|adecco|hays|"
    r"michael page|robert half|randstad|kelly services)\b"
)
NAME = r"^[A-ZÀ-ÖØ-Ý][A-Za-zÀ-ÖØ-öø-ÿ'-]+(?:\s+[A-ZÀ-ÖØ-Ý][A-Za-zÀ-ÖØ-öø-ÿ'-]+){1,3}$"
PROFILE = r"https?://(?:www\.)?linkedin\.com/in/[A-Za-z0-9_-]+/?"
CONTACT = r"@|linkedin\.com|http|www\.|tel:|mob:|mobile:|\+[0-9]"
#: Words that don't count as shared between a role and a title.
SMALL_WORDS = ("de", "du", "la", "le", "of", "the", "and", "et")


def profile(text: Column) -> Column:
    """The first address of a professional profile in a text."""
    return F.nullif(F.regexp_extract(text, f"({PROFILE})", 1), F.lit(""))


def writer(text: Column) -> dict[str, Column]:
    """``name, title, company, kind, profile`` of the person whose signature or page a text is.

    Name: the first line written like one, else the first line. Title: the first
    line with a recruiter's title. Company: the first short line that is neither,
    no contact and no sentence. Kind: "agency", "in_house" or "unknown".
    """
    rows = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    title = F.try_element_at(F.filter(rows, lambda x: fold(x).rlike(RECRUITER)), F.lit(1))
    named = F.try_element_at(F.filter(rows, lambda x: x.rlike(NAME) & ~fold(x).rlike(RECRUITER)), F.lit(1))
    name = F.coalesce(named, F.try_element_at(rows, F.lit(1)))
    said = lambda x: (F.lower(x) == x) & (F.length(x) > 30)
    firm = F.filter(rows, lambda x: (x != name) & ~fold(x).rlike(RECRUITER) & ~F.lower(x).rlike(CONTACT) & ~said(x) & F.length(x).between(2, 80))
    company = F.try_element_at(firm, F.lit(1))
    kind = F.when(F.array_join(F.transform(rows, fold), " ").rlike(AGENCY), "agency").when(company.isNotNull(), "in_house").otherwise("unknown")
    return {"name": name, "title": title, "company": company, "kind": kind, "profile": profile(text)}


def shared_words(role: Column, title: Column) -> Column:
    """Words that a role and a title share, small words left out, sorted."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), 0)
    return F.array_sort(F.array_except(F.array_intersect(words(role), words(title)), F.lit(list(SMALL_WORDS))))


def warm_paths(targets: DataFrame, people: DataFrame, target: str, company: str, relation: str, hops: str, most: int | None = None) -> DataFrame:
    """``targets`` with the people whose employer's name holds the target's, or is held by it, best introduction first (``rank_no``).

    Ties go by the order of the people's columns. With ``most``, only so many for each target.
    """
    found = name_overlap_join(targets, people, target, company).withColumn("value", introduction_value(F.col(relation), F.col(hops)))
    order = Window.partitionBy(target).orderBy(F.desc("value"), *people.columns)
    ranked = found.withColumn("rank_no", F.row_number().over(order))
    return ranked.where(F.col("rank_no") <= most) if most else ranked


#: Fields of an application form that a CV can fill, in order.
FORM = ("full_name", "email", "phone", "linkedin", "current_company", "current_title", "location")


def filled_form(values: dict[str, Column]) -> dict[str, Column]:
    """``fields`` (a map of what is told) and ``unmapped`` (names of what isn't) of the FORM; other fields are never filled."""
    told = {k: F.nullif(F.trim(values.get(k, F.lit(None).cast("string"))), F.lit("")) for k in FORM}
    fields = F.map_filter(F.create_map(*(x for k, v in told.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())
    return {"fields": fields, "unmapped": F.array_compact(F.array(*(F.when(v.isNull(), F.lit(k)) for k, v in told.items())))}
