"""What speaks against a CV: style of its lines, words, dates, address, market rules, stuffing, instructions to machines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobweave.operators.cv import STRONG_VERBS
from jobweave.operators.dates import months_between, year_only
from jobweave.operators.texts import repeated_lines, token_counts, top_per_key
from jobweave.text import fold

#: Flags in the order in which they are listed, with their severity.
SEVERITY = {
    "passive_voice": "HIGH", "duty_bullets": "HIGH", "banned_word": "MEDIUM", "gap_unlabeled": "MEDIUM", "job_hopping": "MEDIUM", "years_only_dates": "MEDIUM",
    "email_unprofessional": "LOW", "wrong_photo_market": "CRITICAL", "wrong_personal_info": "CRITICAL", "ai_generic_phrasing": "HIGH", "no_quantification": "MEDIUM",
    "length_violation": "HIGH", "typo_risk": "CRITICAL", "prompt_injection": "CRITICAL", "keyword_stuffing_token": "HIGH", "keyword_stuffing_line": "HIGH",
}
_W, _B, _E = r"[\p{L}\p{N}_]", r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
#: Patterns of lower-case lines and texts.
PASSIVE = rf"{_B}(?:was|were|been|is|are|a été|ont été|est|sont)\s+{_W}+(?:ed|en|ied|ée?s?){_E}"
GENERIC = (
    rf"{_B}(?:responsible for|worked on|helped with|in order to|assisted with|participated in|contributed to|was involved in){_E}|{_B}supported{_E}.*{_B}team{_E}"
)
PERSONAL = (
    rf"date\s+de\s+naissance|n[eé]{{1,2}}e?\s+le{_E}|{_B}born{_E}|{_B}birth(?:date|day)?{_E}|{_B}d\.?o\.?b\.?{_E}|{_B}national(?:it[eé]|ity){_E}|{_B}marital{_E}|situation\s+familiale"
)
#: Fixed value: figures in a line, as it is written.
FIGURE = rf"\d+\s*%|\$[\d,]+|€[\d,]+|\d+[xX]{_E}|\d+×{_W}|\d+\s*(?:k|M|B|heures?|hours?|jours?|days?|mois|month)"
#: Words without content, English and French.
BANNED = (
    "synergy|synergies|motivated|team player|go-getter|hardworking|hard-working|results-driven|results driven|think outside the box|outside the box|passionate|"
    "passionate about|dynamic|detail-oriented|detail oriented|self-starter|self starter|proactive|innovative|cutting-edge|cutting edge|best-in-class|"
    "best in class|fast-paced|fast paced|leverage|synergize|value-added|value added|thought leader|guru|ninja|rockstar|wizard|strategic thinker|"
    "strong communicator|excellent communication skills|people person|go to person|seasoned professional|proven track record|"
    "synergie|motivé|motivée|esprit d'equipe|esprit d equipe|dynamique|passionné|passionnée|passionné par|passionnée par|proactif|innovant|innovante|"
    "force de proposition|rigueur|autonome|polyvalent|polyvalente|entreprenant|entreprenante|impliqué|impliquée|investi|investie|sérieux|sérieuse|curieux|"
    "curieuse|flexible|adaptable|orienté résultats|orientée résultats|a l ecoute|sens du relationnel|bonne communication|excellente communication|valeur ajoutée"
)
#: Domains of throw-away addresses, and names before the @ that look unprofessional.
THROWAWAY = (
    "mailinator.com", "guerrillamail.com", "trashmail.com", "yopmail.com", "sharklasers.com", "guerrillamailblock.com", "spam4.me", "trashmail.io", "throwam.com", "dispostable.com",
)
UNPROFESSIONAL = r"^(?:[a-z]+[_.]?\d{2,}|[a-z]*x{2,}[a-z]*|[a-z]+_?[a-z]+\d{2,}|.*(?:gamer|kool|leet|swag|xd|irl|pr0|pwn|noob|based).*)$"
#: Markets: photo, whether personal data may stand in a CV, most pages, style of dates.
MARKETS = (
    ("ca-en", "forbidden", False, 2, "Mon YYYY"), ("ca-fr", "optional", False, 2, "MM/YYYY"), ("fr", "optional", False, 2, "MM/YYYY"),
    ("uk", "discouraged", False, 2, "Mon YYYY"), ("us", "forbidden", False, 2, "Mon YYYY"),
)
NO_PHOTO = ("us", "uk", "ca", "ca-en")
PAGE_CHARS, PAGE_LINES = 3500, 45
#: Most months between two posts, shortest post in months and how many of them count as hopping.
LONGEST_GAP, SHORT_POST, MANY_SHORT = 3, 12, 3
#: Instructions to a screening machine, in folded text (English, then French).
INJECTIONS = (
    r"\b(?:ignore|disregard|forget|override|bypass|skip)\b.{0,30}\b(?:previous|prior|all|above|earlier|initial|system)\b.{0,30}\b(?:instruction|prompt|rule|guideline|context|message)s?\b",
    r"\byou\b.{0,20}\b(?:must|should|shall|are required to|need to)\b.{0,30}\b(?:hire|select|advance|recommend|pass|approve|choose)\b.{0,30}\b(?:this|the)\b.{0,15}\b(?:candidate|applicant|person)\b",
    r"\b(?:act as(?: if)?|pretend (?:you are|to be)|assume the role of|roleplay as)\b",
    r"\b(?:new|updated|revised|override|replacement)\b.{0,20}\b(?:instruction|prompt|rule|directive|command)s?\b",
    r"\bthis (?:candidate|applicant|person)\b.{0,40}\b(?:perfect|ideal|excellent|best|top|outstanding)\b.{0,40}\b(?:must|should|shall)\b.{0,20}\b(?:hire|select|advance|pass)\b",
    r"\b(?:do not|don't|never|avoid)\b.{0,20}\b(?:reject|decline|refuse|disqualify|eliminate|screen out)\b.{0,30}\b(?:this|the)?\b.{0,15}\b(?:candidate|applicant|person|resume|cv)\b",
    r"\[system\]|\[inst\]|\[/inst\]|<\|system\|>|<\|user\|>|<\|assistant\|>|###\s*instruction|###\s*system|###\s*prompt",
    r"\b(?:ignorez|oubliez|effacez|annulez|contournez)\b.{0,30}\b(?:les |toutes les |ces )?\b(?:instruction|regle|consigne|prompt)s?\b",
    r"\b(?:vous devez|il faut|vous etes oblige)\b.{0,30}\b(?:embaucher|selectionner|retenir|accepter|valider)\b.{0,30}\b(?:ce candidat|cet(?:te)? (?:candidat|postulant))\b",
    r"\b(?:ne|n')\b.{0,10}\b(?:rejetez|eliminez|refusez|disqualifiez)\b.{0,30}\b(?:pas|jamais)\b.{0,20}\b(?:ce candidat|cet(?:te)? (?:candidat|postulant)|ce cv)\b",
)
#: How often a word and a line must stand to count as stuffing, how long the line must be, and how many of each are listed.
STUFFED, REPEATED, LEAST_LINE, MOST_WORDS, MOST_LINES = 5, 3, 10, 3, 2
#: Words that may repeat, English and French.
COMMON = (
    "the and was for with from that this are been have has had not but our you your she they their les une des est elle ils elles nous vous que qui dans par "
    "sur aux son ses mon mes avec pour pas plus"
).split()


def passive(line: Column) -> Column:
    return F.lower(line).rlike(PASSIVE)


def duty(line: Column) -> Column:
    """Neither a strong verb (first word, or one of over four letters anywhere) nor a figure."""
    verbs = STRONG_VERBS.split("|")
    first = F.rtrim(F.regexp_extract(F.lower(F.trim(line)), r"^(\S+)", 1), F.lit(".,;:"))
    strong = first.isin(*verbs) | F.lower(line).rlike("|".join(v for v in verbs if len(v) > 4))
    return ~strong & ~line.rlike(FIGURE)


def banned_words(text: Column, words: str = BANNED) -> Column:
    """Words that occur in a text, wherever, in the order of the list."""
    low = F.lower(text)
    return F.filter(F.lit(words.split("|")), lambda w: low.contains(w))


def email_fault(email: Column) -> Column:
    """"domain" for a throw-away address, "name" for an unprofessional one, else null."""
    local, domain = F.split_part(F.lower(email), F.lit("@"), F.lit(1)), F.split_part(F.lower(email), F.lit("@"), F.lit(2))
    two = F.length(email) - F.length(F.replace(email, F.lit("@"), F.lit(""))) == 1
    return F.when(two & domain.isin(*THROWAWAY), "domain").when(two & local.rlike(UNPROFESSIONAL), "name")


def typo(text: Column, doubled: Column) -> Column:
    """The first kind of mechanical error a text has: "doubled word", "repeated letters" or "double space"; ``doubled`` counts doubled words."""
    letters = "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return F.when(doubled > 0, "doubled word").when(text.rlike(letters), "repeated letters").when(text.rlike(rf"[^\s.?!:]  +{_W}"), "double space")


def generic(text: Column) -> Column:
    """The first generic phrase of a text, lower-cased, or null."""
    return F.nullif(F.trim(F.regexp_extract(F.lower(text), f"({GENERIC})", 1)), F.lit(""))


def personal_snippet(text: Column) -> Column:
    """Where a text speaks of birth, nationality or family: ten characters before and thirty after, at most eighty; null where it doesn't."""
    low = F.lower(text)
    at, hit = F.regexp_instr(low, F.lit(PERSONAL)), F.regexp_extract(low, f"({PERSONAL})", 1)
    begin = F.greatest(F.lit(1), at - 10)
    return F.when(at > 0, F.substring(F.trim(F.substr(low, begin, at + F.length(hit) + 30 - begin)), 1, 80))


def markets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MARKETS), "market string, photo string, personal_ok boolean, most_pages int, dates string")


def estimated_pages(text: Column) -> Column:
    filled = F.size(F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x) != ""))
    return F.greatest(F.length(text) / PAGE_CHARS, filled / PAGE_LINES)


def market_flags(cvs: DataFrame, key: str, text: str, photo: str, rules: DataFrame) -> DataFrame:
    """``key, market, flag`` for each market of ``rules`` (a few rows, broadcast by their count): photo, personal data, length."""
    facts = cvs.select(key, F.col(photo).alias("photo_in"), personal_snippet(F.col(text)).isNotNull().alias("personal"), estimated_pages(F.col(text)).alias("pages"))
    listed = rules.limit(1001).collect()
    if len(listed) > 1000:
        raise ValueError("more than 1000 markets")
    one = lambda test, flag, m: F.when(test, F.struct(F.lit(m).alias("market"), F.lit(flag).alias("flag")))
    found = []
    for r in listed:
        found.append(one(F.lit(r.market in NO_PHOTO) & F.col("photo_in"), "wrong_photo_market", r.market))
        found.append(one(F.lit(not r.personal_ok) & F.col("personal"), "wrong_personal_info", r.market))
        found.append(one(F.col("pages") > r.most_pages, "length_violation", r.market))
    return facts.select(key, F.explode(F.array_compact(F.array(*found))).alias("f")).select(key, "f.*")


def employment_gaps(work: DataFrame, key: str) -> DataFrame:
    """``key, after, until, months``: gaps of more than LONGEST_GAP months between posts in order of start.

    ``work`` has ``key, start, end`` as year * 100 + month; a post without an
    end ends as it starts, one without a start is left out.
    """
    dated = work.where(F.col("start").isNotNull()).withColumn("stop", F.coalesce("end", "start"))
    order = Window.partitionBy(key).orderBy((F.col("start") / 100).cast("int"), F.when(F.col("start") % 100 == 0, 6).otherwise(F.col("start") % 100), "stop")
    gap = months_between(F.col("stop"), F.col("until"))
    return dated.withColumn("until", F.lead("start").over(order)).withColumn("months", gap).where(F.col("months") > LONGEST_GAP).select(key, F.col("stop").alias("after"), "until", "months")


def job_hopping(work: DataFrame, key: str) -> DataFrame:
    """``key, short``: CVs with at least MANY_SHORT posts of under a year (but of a month at least)."""
    span = months_between(F.col("start"), F.col("end"))
    return work.groupBy(key).agg(F.sum(F.when((span > 0) & (span < SHORT_POST), 1).otherwise(0)).alias("short")).where(F.col("short") >= MANY_SHORT)


def years_only(work: DataFrame, key: str) -> DataFrame:
    """``key, field, value``: starts and ends that are a year alone; ``work`` has the texts ``started`` and ``ended``."""
    each = work.select(key, F.explode(F.array(*(F.struct(F.lit(n).alias("field"), F.col(c).alias("value")) for n, c in (("start", "started"), ("end", "ended"))))).alias("v"))
    return each.select(key, "v.*").where(year_only(F.col("value")))


def without_figures(highlights: DataFrame, key: str) -> DataFrame:
    """CVs that have highlights, none of them with a figure."""
    return highlights.groupBy(key).agg(F.max(F.col("line").rlike(FIGURE)).alias("some")).where(~F.col("some")).select(key)


def injections(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, pattern_no, hits``: how often each kind of instruction to a machine stands in a text; kinds that don't are left out."""
    low = F.regexp_replace(fold(text), "[’ʼ]", "'")
    each = F.array(*(F.struct(F.lit(n).alias("pattern_no"), F.regexp_count(low, F.lit(p)).alias("hits")) for n, p in enumerate(INJECTIONS, 1)))
    return df.select(key, F.explode(F.filter(each, lambda x: x["hits"] > 0)).alias("x")).select(key, "x.*")


def stuffed(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, kind, value, n, rank_no``: the most repeated words and lines of each text, where they repeat too often."""
    counts = token_counts(df, key, text, tuple(COMMON)).where(F.col("n") >= STUFFED)
    words = top_per_key(counts, key, [F.desc("n"), F.col("token")], MOST_WORDS).select(key, F.lit("word").alias("kind"), F.col("token").alias("value"), "n", "rank_no")
    again = repeated_lines(df, key, text, LEAST_LINE, REPEATED)
    same = top_per_key(again, key, [F.desc("n"), F.col("line")], MOST_LINES).select(key, F.lit("line").alias("kind"), F.col("line").alias("value"), "n", "rank_no")
    return words.unionByName(same)


def roll_up(found: dict[str, DataFrame], key: str) -> DataFrame:
    """``key, flag, severity, n, flag_no``: how often each CV has each flag, in the order of SEVERITY. Every table of ``found`` has one row for a finding."""
    each = reduce(lambda a, b: a.unionByName(b), (df.select(key, F.lit(flag).alias("flag")) for flag, df in found.items()))
    names = list(SEVERITY)
    severity = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    return each.groupBy(key, "flag").agg(F.count("*").alias("n")).select(
        key, "flag", F.element_at(severity, F.col("flag")).alias("severity"), "n", F.array_position(F.lit(names), F.col("flag")).alias("flag_no")
    )


#: Systems that read CVs: largest file (MB), what they do with columns, tables and headers, date forms they fail on, share they read in one and two columns.
SYSTEMS = (
    ("workday", 2.0, "concatenate_lr", "merge", "stripped", ["YYYY", "'YY", "season", "ongoing", "current"], 0.95, 0.55),
    ("greenhouse", 2.5, "moderate", "risky", "partial", ["season"], 0.92, 0.75),
    ("lever", 10.0, "omit_secondary", "scramble", "risky", ["inconsistency"], 0.96, 0.71),
    ("taleo_oracle", 5.0, "concatenate_lr", "scramble", "ignored", ["ongoing", "current", "season", "present"], 0.88, 0.40),
    ("icims", 5.0, "concatenate_lr", "tolerant", "ignored", ["ongoing", "current", "fall", "spring", "summer", "winter"], 0.89, 0.67),
    ("smartrecruiters", 5.0, "moderate", "tolerant", "readable", ["season"], 0.90, 0.75),
    ("ashby", 10.0, "best", "tolerant", "readable", [], 0.97, 0.90),
    ("bamboohr", 5.0, "moderate", "tolerant", "readable", [], 0.70, 0.50),
    ("recruitee", 2.0, "scramble", "tolerant", "ignored", ["inconsistency"], 0.82, 0.55),
    ("generic", 2.0, "concatenate_lr", "scramble", "stripped", ["YYYY", "season", "ongoing", "current"], 0.85, 0.55),
)
#: What a fault of each severity takes off; headings that systems don't know although people use them, folded.
PENALTY = {"CRITICAL": 30, "HIGH": 18, "MEDIUM": 8, "LOW": 3}
UNKNOWN_HEADINGS = ("employment history", "aptitudes", "certifications & licenses", "licences")


def unknown_heading(text: Column) -> Column:
    """Whether a line of a text is a heading that reading systems don't know."""
    return F.exists(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(F.rtrim(F.trim(fold(x)), F.lit(":"))).isin(*UNKNOWN_HEADINGS))


def systems(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SYSTEMS), "system string, most_mb double, on_columns string, on_tables string, on_header string, bad_dates array<string>, one_column double, two_columns double")


def readability(layouts: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """``key, system, score, faults, lost``: how well each system would read each CV.

    ``layouts`` has ``key, text, pages, columns, has_tables, header_contact, is_pdf,
    mb``. Score: what the system reads of such a layout, in percent, less a
    penalty for each fault. ``rules`` is a table of a few systems; each CV meets
    all of them inside its row.
    """
    from jobweave.operators.dates import bad_form

    listed = rules.limit(1001).collect()
    if len(listed) > 1000:
        raise ValueError("more than 1000 systems")
    two = F.col("is_pdf") & (F.col("columns") >= 2)
    shared = layouts.select("*", unknown_heading(F.col("text")).alias("__heading"), F.length("text").alias("__chars"))

    def judge(r) -> Column:
        fault = lambda test, name, severity: F.when(test, F.struct(F.lit(name).alias("fault"), F.lit(severity).alias("severity")))
        columns = {"omit_secondary": "HIGH", "concatenate_lr": "HIGH", "scramble": "HIGH"}.get(r.on_columns, "MEDIUM")
        tables = {"risky": "MEDIUM", "scramble": "HIGH", "merge": "HIGH"}.get(r.on_tables, "MEDIUM")
        header = {"stripped": "CRITICAL", "ignored": "HIGH", "risky": "HIGH"}.get(r.on_header, "LOW")
        dates = bad_form(F.col("text"), F.lit(r.bad_dates)).isNotNull() if r.bad_dates else F.lit(False)
        found = F.array_compact(
            F.array(
                fault(two, "two_column", columns), fault(F.col("has_tables") & F.lit(r.on_tables != "tolerant"), "table", tables), fault(F.col("header_contact"), "header_contact", header),
                fault((F.col("__chars") > 0) & (F.col("pages") > 0) & (F.col("__chars") / F.col("pages") < 50), "scanned", "CRITICAL"),
                fault(F.col("mb") > r.most_mb, "oversized", "HIGH"), fault(F.col("__heading"), "dropped_section", "MEDIUM"), fault(dates, "bad_dates", "MEDIUM"),
            )
        )
        base = F.when(F.col("columns") >= 2, r.two_columns).otherwise(r.one_column) * 100
        weights = F.create_map(*(F.lit(x) for kv in PENALTY.items() for x in kv))
        penalty = F.aggregate(found, F.lit(0), lambda s, x: s + F.element_at(weights, x["severity"]))
        lost = F.array_compact(F.array(F.when(F.col("header_contact") & F.lit(header != "LOW"), "contact"), F.when(two & F.lit(r.on_columns == "omit_secondary"), "secondary_column_content")))
        score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), base - penalty)), 2)
        return F.struct(F.lit(r.system).alias("system"), score.alias("score"), F.transform(found, lambda x: x["fault"]).alias("faults"), lost.alias("lost"))

    return shared.select(key, F.explode(F.array(*map(judge, listed))).alias("j")).select(key, "j.*")
