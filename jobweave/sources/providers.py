"""Provider answers to the one posting schema, each provider as column expressions over its items.

``POSTING`` columns: source, source_id, title, company, location, remote, url,
apply_url, date_posted, description, salary, tags, raw. Items that are no
objects are skipped. Empty texts, zero and false count as absent where a field
falls back; source_id, title, url and description are never null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.operators.timestamps import _iso
from jobweave.sources.payloads import json_list

POSTING = ["source", "source_id", "title", "company", "location", "remote", "url", "apply_url", "date_posted", "description", "salary", "tags", "raw"]


def _t(c: Column) -> Column:
    """Absent where empty."""
    return F.nullif(c, F.lit(""))


def _g(path: str) -> Column:
    return F.get_json_object("raw", f"$.{path}")


def _either(*cs: Column) -> Column:
    return F.coalesce(*(_t(c) for c in cs))


def _bool(c: Column) -> Column:
    """Null where absent; false where the value is false, zero or empty."""
    return F.when(c.isNotNull(), ~c.isin("false", "0", "0.0", "", "[]", "{}"))


def _told(c: Column) -> Column:
    """Absent where empty or zero."""
    return F.when(~c.isin("", "0", "0.0", "false"), c)


def _strings(path: str, field: str | None = None) -> Column:
    """A list's non-empty texts, or one field of its objects; the empty array where there is none."""
    xs = F.from_json(_g(path), "array<string>")
    if field:
        xs = F.transform(xs, lambda x: F.get_json_object(x, f"$.{field}"))
    return F.coalesce(F.filter(xs, lambda x: x.isNotNull() & (x != "")), F.array().cast("array<string>"))


def _iso_of_epoch(text: Column, per_second: int = 1) -> Column:
    """An epoch as ISO time in UTC; other texts stay, and so do numbers beyond the year 9999."""
    seconds = F.floor(text.try_cast("decimal(20,3)") / per_second)
    return F.when(text.rlike(r"^\d+(?:\.\d+)?$") & (seconds < 253402300800), _iso(seconds)).otherwise(text)


def _none() -> Column:
    return F.lit(None).cast("string")


def _open_range(low: Column, high: Column, present: Column) -> Column:
    """"low–high" with "?" for an end that isn't told."""
    return F.when(present, F.concat(F.coalesce(_told(low), F.lit("?")), F.lit("–"), F.coalesce(_told(high), F.lit("?"))))


def _joined(sep: str, *parts: Column) -> Column:
    return _t(F.concat_ws(sep, *map(_t, parts)))


def _remote_place(c: Column) -> Column:
    return F.when(F.lower(c).contains("remote"), True)


def _greenhouse():
    return dict(source_id=_g("id"), title=_g("title"), location=_g("location.name"), url=_g("absolute_url"), date_posted=_t(_g("updated_at")), description=_g("content"))


def _lever():
    kind = _t(_g("workplaceType"))
    return dict(
        source_id=_g("id"), title=_g("text"), location=_g("categories.location"), remote=F.when(kind.isNotNull(), kind == "remote"), url=_g("hostedUrl"), apply_url=_g("applyUrl"),
        date_posted=_iso_of_epoch(_g("createdAt"), 1000), description=_either(_g("descriptionPlain"), _g("description")),
    )


def _ashby():
    return dict(
        source_id=_g("id"), title=_g("title"), location=_t(_g("location")), remote=_bool(_g("isRemote")), url=_g("jobUrl"), apply_url=_g("applyUrl"), date_posted=_g("publishedDate"),
        description=_either(_g("descriptionPlain"), _g("descriptionHtml")), salary=_t(F.array_join(_strings("compensation.summaryComponents", "value"), " / ")),
    )


def _recruitee():
    low, high = _told(_g("salary_from")), _told(_g("salary_to"))
    return dict(
        source_id=_g("id"), title=_g("title"), location=_joined(", ", _g("city"), _g("country")), remote=_bool(_g("remote")), url=_either(_g("careers_url"), _g("url")), date_posted=_g("created_at"),
        description=_g("description"), salary=F.when(low.isNotNull() | high.isNotNull(), F.concat_ws(" ", F.concat_ws(" – ", low, high), _t(_g("salary_currency")))),
    )


def _workable():
    return dict(
        source_id=_g("shortcode"), title=_either(_g("full_title"), _g("title")), location=_joined(", ", _g("location.city"), _g("location.country")), remote=_bool(_g("location.telecommuting")),
        url=_g("url"), apply_url=_g("application_url"), date_posted=_g("created_at"), description=_g("description"),
    )


def _smartrecruiters():
    own = F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.coalesce(_g("id"), F.lit("")))
    return dict(
        source_id=_g("id"), title=_g("name"), company=_t(_g("company.name")), location=_joined(", ", _g("location.city"), _g("location.region"), _g("location.country")),
        remote=F.when(_g("location.remote").startswith("{"), F.coalesce(_bool(_g("location.remote.enabled")), F.lit(False))), url=_either(_g("applyUrl"), own), apply_url=_g("applyUrl"),
        date_posted=_g("releasedDate"), description=_g("jobAd.sections.jobDescription.text"),
    )


def _remoteok():
    low, high = _g("salary_min"), _g("salary_max")
    return dict(
        source_id=_told(_g("id")), title=_g("position"), company=_t(_g("company")), location=_t(_g("location")), remote=F.lit(True), url=_g("url"), apply_url=_t(_g("apply_url")),
        date_posted=F.when(_told(_g("epoch")).rlike(NUMBER), _iso_of_epoch(_g("epoch"))).otherwise(_g("date")), description=_g("description"),
        salary=F.when(_told(low).isNotNull() | _told(high).isNotNull(), F.concat_ws(" – ", low, high)), tags=_strings("tags"),
    )


def _remotive():
    return dict(
        source_id=_told(_g("id")), title=_g("title"), company=_t(_g("company_name")), remote=F.lit(True), url=_g("url"), date_posted=_g("publication_date"), description=_g("description"),
        salary=_t(_g("salary")), tags=_strings("tags"),
    )


def _arbeitnow():
    return dict(
        source_id=_g("slug"), title=_g("title"), company=_t(_g("company_name")), location=_t(_g("location")), remote=_bool(_g("remote")), url=_g("url"),
        date_posted=_iso_of_epoch(_told(_g("created_at"))), description=_g("description"), tags=_strings("tags"),
    )


def _careerjet():
    own = _t(F.substring_index(F.rtrim(_g("url"), F.lit("/")), "/", -1))
    return dict(
        source_id=F.when(_t(_g("url")).isNull(), F.col(ITEM).cast("string")).otherwise(own), title=_g("title"), company=_t(_g("company")), location=_t(_g("locations")), url=_g("url"),
        date_posted=_t(_g("date")), description=_g("description"),
    )


def _france_travail():
    own = F.concat(F.lit("https://candidat.francetravail.fr/offres/recherche/detail/"), F.coalesce(_g("id"), F.lit("")))
    return dict(
        source_id=_g("id"), title=_g("intitule"), company=_g("entreprise.nom"), location=_g("lieuTravail.libelle"), url=_either(_g("origineOffre.urlOrigine"), own),
        date_posted=_either(_g("dateCreation"), _g("dateActualisation")), description=_g("description"), salary=_g("salaire.libelle"), tags=_strings("competences", "libelle"),
    )


def _adzuna():
    low, high, label = _g("salary_min"), _g("salary_max"), _t(_g("category.label"))
    return dict(
        source_id=_g("id"), title=_g("title"), company=_g("company.display_name"), location=_t(_g("location.display_name")), url=_g("redirect_url"), date_posted=_t(_g("created")),
        description=_g("description"), salary=_open_range(low, high, low.isNotNull() | high.isNotNull()), tags=F.when(label.isNotNull(), F.array(label)),
    )


def _jsearch():
    low, high = _g("job_min_salary"), _g("job_max_salary")
    lists = F.map_values(F.from_json(_g("job_highlights"), "map<string,string>"))
    some = F.transform(lists, lambda x: F.when(x.startswith("["), F.slice(F.from_json(x, "array<string>"), 1, 3)))
    return dict(
        source_id=_g("job_id"), title=_g("job_title"), company=_g("employer_name"), location=_joined(", ", _g("job_city"), _g("job_state"), _g("job_country")), remote=_bool(_g("job_is_remote")),
        url=_either(_g("job_apply_link"), _g("job_google_link")), apply_url=_g("job_apply_link"), date_posted=F.coalesce(_t(_g("job_posted_at_datetime_utc")), _told(_g("job_posted_at_timestamp"))),
        description=_g("job_description"), salary=_open_range(low, high, low.isNotNull() | high.isNotNull()), tags=F.flatten(F.array_compact(some)),
    )


def _usajobs():
    d = lambda path: _g(f"MatchedObjectDescriptor.{path}")
    low, high = d("PositionRemuneration[0].MinimumRange"), d("PositionRemuneration[0].MaximumRange")
    both = _open_range(low, high, _told(low).isNotNull() | _told(high).isNotNull())
    return dict(
        source_id=d("PositionID"), title=d("PositionTitle"), company=d("OrganizationName"), location=d("PositionLocation[0].LocationName"), url=_either(d("PositionURI"), d("ApplyURI[0]")),
        apply_url=_t(d("ApplyURI[0]")), date_posted=_t(d("PublicationStartDate")), description=_either(d("QualificationSummary"), d("JobSummary")),
        salary=F.rtrim(F.concat(both, F.lit(" "), F.coalesce(d("PositionRemuneration[0].RateIntervalCode"), F.lit("")))), tags=_strings("MatchedObjectDescriptor.JobGrade", "Code"),
    )


def _reed():
    low, high, own = _g("minimumSalary"), _g("maximumSalary"), F.concat(F.lit("https://www.reed.co.uk/jobs/"), F.coalesce(_g("jobId"), F.lit("")))
    both = _open_range(low, high, low.isNotNull() | high.isNotNull())
    return dict(
        source_id=_g("jobId"), title=_g("jobTitle"), company=_g("employerName"), location=_g("locationName"), remote=_remote_place(_g("locationName")), url=_either(_g("jobUrl"), own), apply_url=_g("jobUrl"),
        date_posted=_either(_g("date"), _g("expirationDate")), description=_either(_g("jobDescription"), _g("snippet")), salary=F.rtrim(F.concat(both, F.lit(" "), F.coalesce(_g("currency"), F.lit("GBP")))),
    )


def _themuse():
    own = F.concat(F.lit("https://www.themuse.com/jobs/"), F.coalesce(_g("id"), F.lit("")))
    return dict(
        source_id=_g("id"), title=_g("name"), company=_g("company.name"), location=_g("locations[0].name"), url=_either(_g("refs.landing_page"), own), date_posted=_t(_g("publication_date")),
        description=_g("contents"), tags=F.concat(_strings("categories", "name"), _strings("levels", "name")),
    )


def _jooble():
    return dict(
        source_id=_g("id"), title=_g("title"), company=_g("company"), location=_g("location"), remote=_remote_place(_g("location")), url=_g("link"), date_posted=_t(_g("updated")),
        description=_g("snippet"), salary=_told(_g("salary")),
    )


def _labonneboite():
    own = F.concat(F.lit("https://labonneboite.francetravail.fr/"), F.coalesce(F.concat(F.lit("entreprise/"), _t(_g("siret"))), F.lit("")))
    return dict(
        source_id=_g("siret"), title=F.rtrim(F.concat(F.lit("(marché caché) "), F.coalesce(_g("name"), F.lit("")))), company=_t(_g("name")), location=_joined(", ", _g("city"), _g("zipcode")),
        url=_either(_g("url"), own), description=F.concat_ws(" — ", _t(_g("naf_text")), _t(_g("headcount_text"))),
    )


#: Column that holds an item's place in its answer while it is read.
ITEM = "__item_no"
NUMBER = r"^\d+(?:\.\d+)?$"

#: For each provider: key of the items and the fields that differ from null.
SPECS: dict[str, tuple[str, Callable[[], dict[str, Column]]]] = {
    "greenhouse": ("jobs", _greenhouse), "lever": ("data", _lever), "ashby": ("jobs", _ashby), "recruitee": ("offers", _recruitee), "workable": ("jobs", _workable),
    "smartrecruiters": ("content", _smartrecruiters), "remoteok": ("jobs", _remoteok), "remotive": ("jobs", _remotive), "arbeitnow": ("data", _arbeitnow), "careerjet": ("jobs", _careerjet),
    "france_travail": ("resultats", _france_travail), "adzuna": ("results", _adzuna), "jsearch": ("data", _jsearch), "usajobs": ("SearchResult.SearchResultItems", _usajobs),
    "reed": ("results", _reed), "themuse": ("results", _themuse), "jooble": ("jobs", _jooble), "labonneboite": ("companies", _labonneboite),
}


def _items(provider: str) -> Column:
    """The items of an answer (column ``payload``) as JSON texts."""
    text = F.trim("payload")
    body = json_list(F.get_json_object(text, f"$.{SPECS[provider][0]}"))
    if provider == "remoteok":
        # Answers come as a list; an object holds them as "jobs" or "data".
        body = F.coalesce(body, json_list(F.get_json_object(text, "$.data")))
    return F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(body)


def _is_posting(provider: str) -> Column:
    """Whether an item (column ``raw``) is one of the provider's postings."""
    if provider == "remoteok":
        return _g("position").isNotNull() | _g("id").isNotNull()
    if provider == "usajobs":
        return F.coalesce(_g("MatchedObjectDescriptor"), F.lit("{}")).startswith("{")
    return F.lit(True)


def normalise_all(pages: DataFrame, *keep: str, only: tuple[str, ...] = tuple(SPECS), company: Column | None = None) -> DataFrame:
    """``keep`` columns and POSTING columns of the answers (``source, payload``) of many providers, in one pass over them.

    ``only`` names the providers that are read; answers of others give no rows.
    ``company`` names the employer of an answer that is one employer's board;
    an item's own employer comes first. Broken and null payloads give no rows.
    Epochs become ISO times; other wordings stay, and ``operators.timestamps``
    reads them.
    """
    by_source = lambda values: reduce(lambda acc, x: F.when(F.col("source") == x[0], x[1]).otherwise(acc), values.items(), F.lit(None))
    held = [] if company is None else [company.alias("__board")]
    known = pages.where(F.col("source").isin(*only) & F.try_parse_json("payload").isNotNull())
    items = known.select("source", *(k for k in keep if k != "source"), *held, F.posexplode(by_source({p: _items(p) for p in only})).alias(ITEM, "raw"))
    items = items.where(F.trim("raw").startswith("{") & by_source({p: _is_posting(p) for p in only}))
    got = {p: SPECS[p][1]() for p in only}
    if company is not None:
        got = {p: {**f, "company": F.coalesce(f.get("company", _none()), F.col("__board"))} for p, f in got.items()}
    defaults = {"remote": F.lit(None).cast("boolean"), "tags": F.array().cast("array<string>")}
    empty = {"source_id": F.lit(""), "title": F.lit(""), "url": F.lit(""), "description": F.lit(""), "tags": defaults["tags"]}
    out = []
    for name in POSTING[1:-1]:
        none = defaults.get(name, _none())
        told = {p: f[name] for p, f in got.items() if name in f}
        value = by_source(told).cast(TYPES.get(name, "string")) if told else none
        out.append((F.coalesce(value, empty[name]) if name in empty else value).alias(name))
    return items.select(*(k for k in keep if k != "source"), "source", *out, "raw")


#: Types of POSTING columns that aren't texts.
TYPES = {"remote": "boolean", "tags": "array<string>"}


def normalise(pages: DataFrame, provider: str, *keep: str, company: Column | None = None) -> DataFrame:
    """``normalise_all`` of one provider's answers, which need no column ``source``."""
    SPECS[provider]
    return normalise_all(pages.withColumn("source", F.lit(provider)), *keep, only=(provider,), company=company)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def search_all(answers: dict[str, DataFrame], per_source: int | None = None) -> DataFrame:
    """Postings of several providers' answers, by name; with ``per_source``, the first of each provider by id.

    A provider without answers adds nothing; an unknown one is an error.
    """
    unknown = set(answers) - set(SPECS)
    if unknown:
        raise ValueError(f"unknown providers: {sorted(unknown)}")
    pages = union_all([df.select(F.lit(name).alias("source"), "payload") for name, df in sorted(answers.items())])
    return _first(normalise_all(pages, only=tuple(sorted(answers))), ["source"], per_source)


def _first(postings: DataFrame, group: list[str], n: int | None) -> DataFrame:
    """The first ``n`` postings of each group, by id; all of them without ``n``."""
    if n is None:
        return postings
    order = Window.partitionBy(*group).orderBy("source_id", "url")
    return postings.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= n).drop("__n")


def fan_out(answers: DataFrame, boards: DataFrame, per_board: int | None = None) -> DataFrame:
    """POSTING and ``board`` of the answers (``source, board, payload``) of listed boards (``source, board, company``).

    A board's company names the employer of its postings. Boards without a name
    and sources without a normaliser add nothing; with ``per_board``, the first
    postings of each board by id.
    """
    listed = boards.where((F.col("board") != "") & F.col("source").isin(list(SPECS))).dropDuplicates(["source", "board"])
    known = answers.join(listed.select("source", "board", "company"), ["source", "board"])
    return _first(normalise_all(known, "board", company=F.col("company")), ["source", "board"], per_board)
