"""Pay in mixed units to euros per year, in Spark SQL expressions only.

A field's text gives one or two amounts and perhaps a unit and a currency.
Units and currencies are looked up in alias tables by join; the unit in the
text counts before that in a sibling field, before that in the item's
description, before the year; a currency in the text before a sibling field,
before the country. Then amount x factor x units a year x euros a unit.

Nothing is shuffled but the final ``distinct``: alias and rate tables are
joined by broadcast, behind a check of their number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.session import broadcast_if_small
from jobweave.sources.payloads import exploded, json_list
from jobweave.text import fold, squeeze

#: Most rows of an alias, period or rate table that are broadcast.
DIMENSION_ROWS = 10_000

#: Words for units of pay, by period. Written without accents, in lower case.
PERIOD_ALIASES = {
    "year": "an|ans|annee|annuel|annuelle|annuels|annuellement|annual|annually|year|yearly|yr|yrs|y|annum|pa|p.a.",
    "month": "mois|mensuel|mensuelle|mensuels|mensuellement|month|monthly|mo|mth",
    "week": "semaine|hebdo|hebdomadaire|week|weekly|wk",
    "day": "jour|jours|j|journalier|journaliere|quotidien|day|daily|tjm",
    "hour": "heure|heures|h|horaire|hour|hourly|hr|hrs",
}

#: Words and signs for currencies. Written without accents, in lower case.
CURRENCY_ALIASES = {
    "EUR": "eur|euro|euros|€|k€",
    "GBP": "gbp|£|pound|pounds|pounds sterling|pound sterling|sterling",
    "USD": "usd|us$|$|dollar|dollars|us dollars",
    "CHF": "chf|fr.|francs suisses|swiss francs",
    "CAD": "cad|ca$|c$|can$|canadian dollars",
    "PLN": "pln|zl|zloty|zlotys",
    "SEK": "sek|kr|kronor",
}

#: Currency of a country, by the code of adzuna boards and of jsearch.
COUNTRY_CURRENCY = {"gb": "GBP", "us": "USD", "fr": "EUR", "ch": "CHF", "ca": "CAD", "pl": "PLN"}

#: Labels of ashby components that aren't recurring base pay.
NOT_BASE = r"(?i)equity|stock|option|share|bonus|signing|sign-on|one-off|benefit|commission|allowance|prime|other|rsu"

AMOUNT = r"(?:\d{1,3}(?:[ .,'](?=\d{3}))(?:\d{3}[ .,'](?=\d{3}))*\d{3}|\d+)(?:[.,]\d{1,2}(?!\d))?"
_PAY = r"salary|salaire|salaires|pay|paid|rate|rates|figure|figures|taux|remuneration|wage|wages|tarif|contract|montant"
_UNIT = "|".join(sorted((a.replace(".", r"\.") for v in PERIOD_ALIASES.values() for a in v.split("|")), key=len, reverse=True))


def _fold(c: Column) -> Column:
    return squeeze(F.translate(fold(c), "’ʼ´", "'''"))


def _aliases(spark, table: dict[str, str], alias: str, name: str) -> DataFrame:
    return spark.createDataFrame([(a, k) for k, v in table.items() for a in v.split("|")], f"{alias} string, {name} string")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def text_unit(folded: Column) -> Column:
    """The unit alias in a pay text: after a slash or "per", or as a word of its own."""
    slash = _found(folded, rf"(?:/|\bper |\bpar |\bl'|\bla |\ble |\ban |\ba )\s?({_UNIT})\b")
    word = _found(folded, r"\b(annuel\w*|annual\w*|yearly|mensuel\w*|monthly|hebdomadaire|hebdo|weekly|journalier\w*|daily|tjm|horaire|hourly)\b")
    return F.coalesce(word, slash)


def description_unit(folded: Column) -> Column:
    """The unit alias where a sentence of the description speaks of pay in a unit."""
    words = r"annual|annually|annuel|annuelle|yearly|monthly|mensuel|mensuelle|weekly|hebdomadaire|daily|journalier|journaliere|hourly|horaire"
    return F.coalesce(
        _found(folded, rf"\b(?:{_PAY})\b[^.;]{{0,30}}?(?:\bper |\bpar |/\s?|\bby the |\bfor one |\ba l')({_UNIT})\b"),
        _found(folded, rf"\b(?:{_PAY})\b[^.;]{{0,20}}?\b({words})\b"),
        _found(folded, rf"\b({words}|day|hour|week|month)(?:-|\s)?(?:{_PAY})\b"),
        _found(folded, r"\b(tjm)\b"),
    )


def description_thousands(folded: Column) -> Column:
    return folded.rlike(rf"\b(?:{_PAY})\b[^.;]{{0,30}}?\b(?:in thousands|in k\b|en milliers|en k\b|en k€)")


def amounts(text: Column) -> Column:
    """Amounts of a pay text, in order, as ``array<decimal(18,4)>``; none gives the empty array.

    Percentages, ordinals and the number of months are no amounts. A "k" after
    the second of two amounts holds for the first as well.
    """
    t = _fold(text)
    t = F.regexp_replace(t, r"(?:sur|over|x|on|in) \d+(?:[.,]\d+)? ?(?:mois|months?|paiements?|payments?)", " ")
    t = F.regexp_replace(t, r"\d+(?:e|eme|er|th)\b(?! ?\d)|\d+(?:[.,]\d+)? ?%", " ")
    pieces = F.regexp_extract_all(t, F.lit(rf"({AMOUNT} ?k?)"), 1)
    number = lambda p: F.regexp_replace(
        F.regexp_replace(F.regexp_replace(p, r"[ k]|'", ""), r"[.,](?=\d{3}(?:\D|$))", ""), ",", "."
    ).try_cast("decimal(18,4)")
    kilo = F.exists(pieces, lambda p: p.endswith("k"))
    value = lambda p: (number(p) * F.when(p.endswith("k") | (kilo & (number(p) < 1000)), F.lit(1000)).otherwise(F.lit(1))).cast("decimal(18,4)")
    return F.filter(F.transform(pieces, value), lambda x: x.isNotNull())


def months_stated(text: Column) -> Column:
    """For how many months the pay is given ("sur 13 mois"), else null."""
    return _found(_fold(text), r"(?:sur|over|x|on) (\d{1,2})(?:[.,]0+)? ?(?:mois|months?|paiements?|payments?)\b").try_cast("int")


def pay_fields(pages: DataFrame) -> DataFrame:
    """One row for each pay text of an item: page_id, item_no, field, text, unit_field, currency_field, country, description."""
    rows = exploded(pages.where(F.col("source").isin("france_travail", "adzuna", "ashby", "jsearch")))
    schema = (
        "struct<salaire:string,salary_min:string,compensation:string,job_max_salary:string,job_salary_period:string,"
        "job_salary_currency:string,job_country:string,description:string,job_description:string,descriptionPlain:string>"
    )
    x = rows.withColumn("x", F.from_json("item", schema)).select(
        "page_id", "item_no", "source", "board", "x.*", F.coalesce("x.description", "x.job_description", "x.descriptionPlain").alias("about")
    )
    obj = lambda c, s: F.from_json(c, s)
    none = F.lit(None).cast("string")
    libelle = F.when(F.trim("salaire").startswith("{"), obj("salaire", "struct<libelle:string>")["libelle"]).otherwise(F.col("salaire"))
    comp = obj("compensation", "struct<summaryComponents:string,currency:string>")
    part = lambda p: obj(p, "struct<label:string,value:string>")
    parts = F.filter(
        F.transform(json_list(comp["summaryComponents"]), part), lambda p: p["value"].isNotNull() & ~F.coalesce(p["label"], F.lit("")).rlike(NOT_BASE)
    )
    one = lambda field, text, unit, currency, country: F.struct(
        F.lit(field).alias("field"), text.alias("text"), unit.alias("unit_field"), currency.alias("currency_field"), country.alias("country")
    )
    found = (
        F.when(F.col("source") == "france_travail", F.array(one("france_travail.salaire.libelle", libelle, none, none, F.lit("fr"))))
        .when(F.col("source") == "adzuna", F.array(one("adzuna.salary_min", F.col("salary_min"), none, none, F.col("board"))))
        .when(F.col("source") == "jsearch", F.array(one("jsearch.job_max_salary", F.col("job_max_salary"), F.col("job_salary_period"), F.col("job_salary_currency"), F.col("job_country"))))
        .otherwise(F.transform(parts, lambda p: one("ashby.compensation", p["value"], none, comp["currency"], none)))
    )
    return x.select("page_id", "item_no", "about", F.explode(found).alias("f")).select("page_id", "item_no", "f.*", F.col("about").alias("description")).where(
        F.col("text").isNotNull()
    )


def yearly_pay(pages: DataFrame, fx_rates: DataFrame, pay_periods: DataFrame) -> DataFrame:
    """``page_id, item_no, field, bound, eur_year``: amounts of recurring base pay in whole euros a year, distinct.

    No row for null, zero or negative amounts, texts without an amount,
    percentages, and currencies that can't be told. A currency or period that
    is twice in its table gives the greatest rate. Empty tables give an empty
    result.
    """
    spark = pages.sparkSession
    small = lambda df: broadcast_if_small(df, DIMENSION_ROWS)
    folded, about = _fold(F.col("text")), _fold(F.col("description"))
    raw = pay_fields(pages).select(
        "page_id", "item_no", "field", amounts(F.col("text")).alias("amounts"),
        months_stated(F.col("text")).alias("months"),
        text_unit(folded).alias("t_unit"), _fold(F.col("unit_field")).alias("f_unit"), description_unit(about).alias("d_unit"),
        F.coalesce(description_thousands(about), F.lit(False)).alias("thousands"),
        _found(folded, r"(ca\$|us\$|c\$|€|£|\$|\b(?:eur|euros?|gbp|usd|chf|cad|pln|zl|sek|pounds?(?: sterling)?|kr)\b|(?<=k)€)").alias("t_cur"),
        _fold(F.col("currency_field")).alias("f_cur"),
        F.lower(F.trim("country")).alias("country"),
    ).where(F.size("amounts") > 0)
    for c in ("t", "f", "d"):
        raw = raw.join(small(_aliases(spark, PERIOD_ALIASES, f"{c}_unit", f"{c}_period")), f"{c}_unit", "left")
    for c in ("t", "f"):
        raw = raw.join(small(_aliases(spark, CURRENCY_ALIASES, f"{c}_cur", f"{c}_code")), f"{c}_cur", "left")
    raw = raw.join(small(spark.createDataFrame(list(COUNTRY_CURRENCY.items()), "country string, c_code string")), "country", "left")
    periods = pay_periods.groupBy("pay_period").agg(F.max("per_year").alias("per_year"))
    rates = fx_rates.groupBy("currency").agg(F.max("eur_per_unit").cast("decimal(18,8)").alias("rate"))
    known = (
        raw.withColumn("pay_period", F.coalesce("t_period", "f_period", "d_period", F.lit("year")))
        .withColumn("currency", F.coalesce("t_code", "f_code", "c_code"))
        .join(small(periods), "pay_period").join(small(rates), "currency")
    )
    n = F.when((F.col("pay_period") == "month") & F.col("months").isNotNull(), F.col("months")).otherwise(F.col("per_year"))
    # "In thousands" holds for figures that are written so.
    unit = F.when(F.col("thousands") & (F.col("amount") < 1000), 1000).otherwise(1)
    high = (F.col("k") == 1) | (F.col("field") == "jsearch.job_max_salary")
    return (
        known.select("*", F.posexplode(F.slice("amounts", 1, 2)).alias("k", "amount"))
        .where(F.col("amount") > 0)
        .select(
            "page_id", "item_no", "field", F.when(high, "high").otherwise("low").alias("bound"),
            F.round(F.col("amount") * unit * n * F.col("rate"), 0).cast("bigint").alias("eur_year"),
        )
        .distinct()
    )
