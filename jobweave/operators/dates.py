"""Dates as CVs write them: months, ranges of years, and forms that software fails to read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweave.text import fold

#: First three letters of months, folded; "jui" stands for July.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "fev": 2, "avr": 4, "mai": 5, "jui": 7, "aou": 8,
}
#: The month that stands for one that isn't told.
MIDDLE = 6
#: Wordings of a date that readers may fail on, folded.
FORMS = {
    "YYYY": r"\b(?:19|20)\d{2}\s*[-–—]\s*(?:19|20)\d{2}\b",
    "'YY": r"'\d{2}\b",
    "season": r"\b(?:spring|summer|fall|autumn|winter|printemps|ete|automne|hiver)\b",
    "ongoing": r"\bongoing\b",
    "current": r"\bcurrent\b",
    "present": r"\bpresent\b",
}


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def year_month(text: Column) -> Column:
    """``year * 100 + month`` of "2020-01", "2020", "01/2020" and "Jan 2020"; month 0 where it isn't told, null for other texts."""
    t = fold(F.trim(text))
    months = F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv))
    word = F.coalesce(F.try_element_at(months, F.regexp_extract(t, r"^([a-z]{3})", 1)), F.lit(0))
    return (
        F.when(t.rlike(r"^\d{4}-\d{2}$"), _part(t, r"^(\d{4})", 1) * 100 + _part(t, r"-(\d{2})$", 1))
        .when(t.rlike(r"^\d{4}$"), _part(t, r"^(\d{4})$", 1) * 100)
        .when(t.rlike(r"^\d{1,2}/\d{4}$"), _part(t, r"/(\d{4})$", 1) * 100 + _part(t, r"^(\d{1,2})/", 1))
        .when(t.rlike(r"^[a-z]{3,}\s+\d{4}$"), _part(t, r"(\d{4})$", 1) * 100 + word)
    )


def months_between(a: Column, b: Column) -> Column:
    """Months from one ``year_month`` to another; a month that isn't told is June."""
    month = lambda c: F.when(c % 100 == 0, MIDDLE).otherwise(c % 100)
    return ((b / 100).cast("int") - (a / 100).cast("int")) * 12 + month(b) - month(a)


def first_day(text: Column) -> Column:
    """The date of "2020-05-17", the first day of "2020-05" and "2020"; null for other texts and days that don't exist."""
    t = F.trim(text)
    whole = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01"))).when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01")))
    return F.try_to_date(whole, "yyyy-MM-dd")


def shown(text: Column, style: str) -> Column:
    """"2020-05" or "2020-05-17" as "May 2020" (style "Mon YYYY") or "05/2020" ("MM/YYYY"); other texts stay."""
    day = first_day(text)
    plain = F.trim(text).rlike(r"^\d{4}-\d{2}")
    month = F.element_at(F.array(*(F.lit(m) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())), F.month(day))
    year = F.year(day).cast("string")
    made = F.concat(month, F.lit(" "), year) if style == "Mon YYYY" else F.concat(F.lpad(F.month(day).cast("string"), 2, "0"), F.lit("/"), year)
    return F.when(day.isNotNull() & plain, made).otherwise(text)


def shown_range(start: Column, end: Column, style: str) -> Column:
    """Both ends shown, with an open end as "Present"; one end alone where the other is missing altogether."""
    last = F.when(F.lower(F.trim(end)).isin("present", "current", "ongoing"), "Present").otherwise(shown(end, style))
    return F.concat_ws(" – ", shown(start, style), last)


def year_only(text: Column) -> Column:
    return F.trim(text).rlike(r"^\d{4}$")


def bad_form(text: Column, forms: Column) -> Column:
    """The first of ``forms`` (an array of names of FORMS, others say nothing) that a text uses, or null."""
    low = fold(text)

    def used(form: Column) -> Column:
        test = F.lit(False)
        for name, pattern in FORMS.items():
            test = F.when(form == name, low.rlike(pattern)).otherwise(test)
        return F.coalesce(test, F.lit(False))

    return F.try_element_at(F.filter(forms, used), F.lit(1))
