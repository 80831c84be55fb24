"""Postings: keys, duplicates within a date band, search, ranking, profiles of companies, snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.text import fold

#: Words that a company's or title's key leaves out.
NOISE = (
    "inc", "ltd", "llc", "corp", "corporation", "co", "company", "sas", "sarl", "sa", "sasu", "gmbh", "bv", "nv", "ag", "the", "and", "or",
    "de", "du", "la", "le", "les",
)
BAND_DAYS = 14

#: Hosts whose pages only list other sites' postings.
AGGREGATORS = ("linkedin.com", "indeed.com", "glassdoor.com")


def normalised(c: Column) -> Column:
    """Lower case, no accents, single blanks, no noise words; '' for null."""
    words = F.split(F.regexp_replace(F.lower(fold(F.coalesce(c, F.lit("")))), r"^\s+|\s+$", ""), r"\s+")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*NOISE)), " ")


def city(location: Column) -> Column:
    """What stands before the first comma; '' for null."""
    return F.trim(F.substring_index(F.coalesce(location, F.lit("")), ",", 1))


def blocking_key(company: Column, location: Column, title: Column) -> Column:
    return F.sha2(F.concat_ws("|", normalised(company), normalised(city(location)), normalised(title)), 256)


def iso_date(text: Column) -> Column:
    """The date in the first ten characters, null where there is none."""
    head = F.substring(text, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def within_band(a: Column, b: Column, days: int = BAND_DAYS) -> Column:
    """Dates at most ``days`` apart; an unknown date is within any band."""
    return F.coalesce(F.abs(F.datediff(a, b)) <= days, F.lit(True))


def completeness(df: DataFrame) -> Column:
    """How many of seven fields are told, plus the number of tags."""
    told = ("company", "location", "remote", "apply_url", "date_posted", "salary", "description")
    return reduce(lambda x, y: x + y, (F.col(c).isNotNull().cast("int") for c in told if c in df.columns)) + F.coalesce(F.size("tags"), F.lit(0))


def latest(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """One row for each key, the one of greatest ``order``: an upsert log's current state. Null keys are one key.

    Only ``columns`` (all, if none are named) are read and shuffled; values
    derived from wide columns are best derived before.
    """
    rest = [c for c in (columns or df.columns) if c not in (key, order)]
    newest = F.max(order).alias(order)
    if not rest:
        return df.groupBy(key).agg(newest)
    found = df.groupBy(key).agg(newest, F.max_by(F.struct(*rest), F.col(order)).alias("r"))
    wanted = [c for c in (columns or df.columns) if c != key]
    return found.select(key, *(F.col(order) if c == order else F.col(f"r.{c}").alias(c) for c in wanted))


#: Columns by which ``kept`` decides: key, date and number of told fields.
DEDUPE = ["__key", "__dt", "__full"]


def dedupe_columns(postings: DataFrame) -> list[Column]:
    """DEDUPE of postings, as columns: narrow, to be made before any shuffle."""
    return [
        blocking_key(F.col("company"), F.col("location"), F.col("title")).alias("__key"), iso_date(F.col("date_posted")).alias("__dt"),
        completeness(postings).alias("__full"),
    ]


def kept(keyed: DataFrame, order: str, *carry: str) -> DataFrame:
    """``order`` and ``carry`` columns of one row for each cluster, from a table with DEDUPE.

    In order of ``order``, a row no earlier anchor of its key is near to
    becomes an anchor; others join the first anchor they are near to, and the
    most complete of a cluster is kept. Rows of one key and date always share an
    anchor, so they are reduced to one before the fold, which runs over a key's
    dates and never over its rows.
    """
    best = F.min(F.struct((-F.col("__full")).alias("less"), F.col(order).alias("id"), *carry)).alias("best")
    days = keyed.groupBy("__key", "__dt").agg(F.min(order).alias("o"), best)
    xs = days.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("o", F.col("__dt").alias("dt"), "best"))).alias("xs"))
    empty = F.array().cast(f"array<struct<o:{days.schema['o'].dataType.simpleString()},dt:date>>")
    near = lambda a, x: within_band(a["dt"], x["dt"])
    grow = lambda acc, x: F.when(F.exists(acc, lambda a: near(a, x)), acc).otherwise(F.concat(acc, F.array(F.struct(x["o"].alias("o"), x["dt"].alias("dt")))))
    mine = lambda anchors, x: F.filter(anchors, lambda a: near(a, x) & (a["o"] <= x["o"]))[0]["o"]
    each = xs.withColumn("anchors", F.aggregate("xs", empty, grow)).select(
        F.explode(F.transform("anchors", lambda a: F.array_min(F.transform(F.filter("xs", lambda x: mine(F.col("anchors"), x) == a["o"]), lambda x: x["best"])))).alias("k")
    )
    return each.select(F.col("k.id").alias(order), *(F.col(f"k.{c}").alias(c) for c in carry))


def dedupe(postings: DataFrame, order: str = "posting_id") -> DataFrame:
    """One posting for each cluster of the same key with dates within the band of the cluster's anchor; the most complete is kept."""
    return postings.join(kept(postings.select(order, *dedupe_columns(postings)), order), order, "left_semi")


def duplicate_links(keyed: DataFrame, order: str, days: int = BAND_DAYS) -> DataFrame:
    """``order, __key, links``: for each row of a table with ``__key`` and ``__dt``, how many other rows of its key lie within the band.

    Rows without a date are within any band. Rows of one key and date are
    counted first; a range of dates sums the counts, so no pairs are made,
    however many rows share a key.
    """
    counts = keyed.groupBy("__key", "__dt").agg(F.count("*").alias("n"))
    near = Window.partitionBy("__key").orderBy(F.datediff("__dt", F.lit("1970-01-01").cast("date"))).rangeBetween(-days, days)
    all_ = Window.partitionBy("__key")
    undated = F.sum(F.when(F.col("__dt").isNull(), F.col("n")).otherwise(0)).over(all_)
    total = F.when(F.col("__dt").isNull(), F.sum("n").over(all_)).otherwise(F.sum(F.when(F.col("__dt").isNotNull(), F.col("n")).otherwise(0)).over(near) + undated)
    linked = counts.select(F.col("__key").alias("k"), F.col("__dt").alias("dt"), (total - 1).alias("links"))
    return keyed.join(linked, (F.col("__key") == F.col("k")) & F.col("__dt").eqNullSafe(F.col("dt"))).select(order, "__key", "links")


def company_brief(postings: DataFrame, order: str = "posting_id", titles: int = 3, tags: int = 8) -> DataFrame:
    """``company, titles, tags``: a company's first titles, and its first different tags in the order in which they are seen.

    Only as many rows as are shown reach one row.
    """
    named = postings.where(F.col("company").isNotNull())
    top = lambda df, n, by: df.withColumn("r", F.row_number().over(Window.partitionBy("company").orderBy(*by))).where(F.col("r") <= n)
    listed = lambda df, c: df.groupBy("company").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", c))), lambda x: x[c]).alias(f"{c}s"))
    first = listed(top(named.select("company", order, "title").where(F.col("title").isNotNull()), titles, [order]), "title")
    each = named.select("company", F.col(order).alias("o"), F.posexplode("tags").alias("pos", "tag"))
    seen = each.groupBy("company", "tag").agg(F.min(F.struct("o", "pos")).alias("first"))
    some = listed(top(seen, tags, ["first", "tag"]), "tag")
    none = F.array().cast("array<string>")
    return first.join(some, "company", "full").select("company", F.coalesce("titles", none).alias("titles"), F.coalesce("tags", none).alias("tags"))


def matches_any(terms: list[str], *fields: str) -> Column:
    """Any term occurs in the joined lower-cased fields; no terms match everything."""
    text = F.lower(F.concat_ws(" ", *fields))
    return reduce(lambda x, y: x | y, (text.contains(t.lower()) for t in terms), F.lit(not terms))


def search(postings: DataFrame, query: str, key: str = "posting_id", order: str | None = None) -> DataFrame:
    """``key, title, date_posted``: dedupe, then keyword filter, then newest first (dates compare as strings, unknown ones last).

    Whether a text matches is decided before any shuffle and looked at after
    dedupe, so the kept posting's own text counts and no description moves.
    With ``order``, postings are a log of which the latest row of a key counts.
    """
    hit = matches_any(query.split(), "title", "description").alias("hit")
    rows = postings.select(key, *([order] if order else []), "title", "date_posted", hit, *dedupe_columns(postings))
    if order:
        rows = latest(rows, key, order)
    return kept(rows, key, "title", "date_posted", "hit").where("hit").drop("hit").orderBy(F.col("date_posted").desc_nulls_last(), key)


def first_per_group(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits groups before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= n)


def company_profile(postings: DataFrame, top: int = 20) -> DataFrame:
    """For each company: postings, distinct places, share of remote among told, first and last date as strings, most frequent tags.

    ``tags`` has the ``top`` tags, most frequent first, ties in alphabetical
    order. Counts of tags are made before they meet in one row, so a large
    company's row holds its different tags, not its postings.
    """
    named = postings.where(F.col("company").isNotNull())
    whole = named.groupBy("company").agg(
        F.count("*").alias("postings"), F.countDistinct("location").alias("places"),
        F.round(F.avg(F.col("remote").cast("double")), 3).alias("remote_share"), F.min("date_posted").alias("first_date"), F.max("date_posted").alias("last_date"),
    )
    counts = named.select("company", F.explode("tags").alias("tag")).groupBy("company", "tag").agg(F.count("*").alias("n"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("company").orderBy(F.desc("n"), "tag"))).where(F.col("r") <= top)
    tags = best.groupBy("company").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "tag"))), lambda x: x["tag"]).alias("tags"))
    return whole.join(tags, "company", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def company_places(postings: DataFrame, order: str = "posting_id") -> DataFrame:
    """``company, location, place_no``: a company's different places in the order in which they are first seen."""
    seen = postings.where(F.col("company").isNotNull() & F.col("location").isNotNull()).groupBy("company", "location").agg(F.min(order).alias("first"))
    return seen.select("company", "location", F.row_number().over(Window.partitionBy("company").orderBy("first", "location")).alias("place_no"))


def postings_of(postings: DataFrame, company: str) -> DataFrame:
    """A company's postings; all of them where it has none, or is empty."""
    mine = postings.where(F.col("company") == company) if company else postings
    return postings if mine.isEmpty() else mine


def tag_counts(postings: DataFrame) -> DataFrame:
    return postings.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def snapshot_diff(current: DataFrame, previous: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``current`` whose key isn't in ``previous``; removed keys aren't reported."""
    return current.join(previous.select(*key).distinct(), key, "left_anti")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def application_source(df: DataFrame) -> Column:
    """Where to apply: the employer's system, an aggregator's page, or the posting itself."""
    aggregated = reduce(lambda x, y: x | y, ((host(F.col("url")) == a) | host(F.col("url")).endswith("." + a) for a in AGGREGATORS))
    return F.when(F.coalesce(F.col("apply_url"), F.lit("")) != "", "ats").when(aggregated, "aggregator").otherwise("direct")


def moment(text: Column) -> Column:
    """Seconds since 1970 of an ISO date, or of the date and time in the first 19 characters; null for others. An offset is not read."""
    head = F.substring(text, 1, 19)
    whole = head.rlike(r"^\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2})?$")
    at = F.when(whole, F.replace(head, F.lit("T"), F.lit(" "))).try_cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at)


def recency(date_text: Column, now: Column) -> Column:
    """0.5 ** (age in weeks, days in fractions), 1 for future times, 0.5 for unknown ones; ``now`` in seconds since 1970."""
    age = F.greatest(F.lit(0), now - moment(date_text)) / 86400
    return F.coalesce(F.exp(-F.log(F.lit(2.0)) * age / 7), F.lit(0.5))


#: Words of titles and tags for low and for high levels.
LOW_LEVEL = "junior|stagiaire|stage|entry|intern|graduate"
HIGH_LEVEL = "senior|lead|principal|staff|architect|director|vp|head"
#: Odds by fewer applicants than, and beyond; weights of the signals.
APPLICANTS, MANY_APPLICANTS = {10: 0.85, 50: 0.65, 200: 0.45}, 0.20
SIGNALS = {"fit": 0.40, "recency": 0.20, "competition": 0.20, "hiring": 0.10, "network": 0.10}


def hiring(applicants: Column) -> Column:
    """0..1 by bands of the number of applicants; 0.5 for unknown."""
    band = F.when(applicants.isNull(), 0.5)
    for below, odds in APPLICANTS.items():
        band = band.when(applicants < below, odds)
    return band.otherwise(MANY_APPLICANTS)


def chances(df: DataFrame, fit: Column, now: Column, applicants: Column, network: Column) -> dict[str, Column]:
    """``score`` (0..100, weighted signals) and ``confidence`` (by how many of the five are known) of postings."""
    told = [moment(F.col("date_posted")).isNotNull(), competition_known(df), applicants.isNotNull(), network.isNotNull()]
    known = reduce(lambda x, y: x + y, (t.cast("int") for t in told)) + 1
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    parts = {
        "fit": unit(fit / 100), "recency": recency(F.col("date_posted"), now), "competition": competition(df), "hiring": hiring(applicants), "network": unit(F.coalesce(network, F.lit(0.0))),
    }
    score = reduce(lambda x, y: x + y, (F.lit(w) * parts[k] for k, w in SIGNALS.items()))
    return {"score": F.round(score * 100, 2), "confidence": F.when(known >= 4, "high").when(known >= 2, "med").otherwise("low")}


def _levels(df: DataFrame) -> tuple[Column, Column]:
    text = F.lower(F.concat_ws(" ", F.col("title"), F.array_join("tags", " ")))
    return text.rlike(rf"\b({LOW_LEVEL})\b"), text.rlike(rf"\b({HIGH_LEVEL})\b")


def competition_known(df: DataFrame) -> Column:
    low, high = _levels(df)
    return F.col("remote").isNotNull() | low | high


def competition(df: DataFrame) -> Column:
    """0..1, greater where fewer will apply: by remote work and words for level in title and tags; 0.5 where neither speaks."""
    low, high = _levels(df)
    place = F.when(F.col("remote"), 0.15).when(~F.col("remote"), -0.05).otherwise(0.0)
    level = F.when(low, 0.20).when(high, -0.15).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 - (place + level)))


def _grams(c: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda k: F.substring(c, k, F.lit(n))))


def _inside(short: DataFrame, long: DataFrame) -> DataFrame:
    """``s, l``: texts of ``short`` that occur in texts of ``long``; both hold distinct texts that aren't empty.

    A text occurs in another only if its rarest three letters do (its whole,
    where it has fewer). So each short text has one key, and the common ones
    of a language decide nothing.
    """
    parts = []
    for n in (1, 2, 3):
        some = short.where(F.length("s") == n) if n < 3 else short.where(F.length("s") >= n)
        held = long.where(F.length("l") >= n).select("l", F.explode(_grams(F.col("l"), n)).alias("g"))
        rare = held.groupBy("g").count()
        keyed = some.select("s", F.explode(_grams(F.col("s"), n)).alias("g")).join(rare, "g", "left")
        key = keyed.groupBy("s").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "g")).alias("k")).select("s", F.col("k.g").alias("g"))
        parts.append(key.join(held, "g").where(F.col("l").contains(F.col("s"))).select("s", "l"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def name_overlap_join(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Rows of both sides where one name contains the other, without regard to case and outer blanks.

    Distinct names are compared, through an index of letter groups, and verified
    exactly; no side is broadcast or crossed. Null and empty names match nothing.
    """
    key = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    x, y = left.withColumn("__x", key(a)), right.withColumn("__y", key(b))
    xs, ys = (d.select(c).where(F.col(c).isNotNull()).distinct() for d, c in ((x, "__x"), (y, "__y")))
    named = lambda df, s, l: df.select(F.col(s).alias("__x"), F.col(l).alias("__y"))  # noqa: E731, E741
    inner = named(_inside(ys.withColumnRenamed("__y", "s"), xs.withColumnRenamed("__x", "l")), "l", "s")
    outer = named(_inside(xs.withColumnRenamed("__x", "s"), ys.withColumnRenamed("__y", "l")), "s", "l")
    return x.join(inner.unionByName(outer).distinct(), "__x").join(y, "__y").drop("__x", "__y")


#: Ranges of values that ``nearest`` cuts a key into.
RANGES = 64


def nearest(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, tie: str) -> DataFrame:
    """``left`` with ``match``, the right row of equal keys with the nearest value, and ``approximate``, whether the values differ.

    Ties go to the least ``tie``; null values are as far as can be, and a key
    that the right side lacks has a null match. Both sides are merged in order
    of value, where the neighbours of a left row are its candidates, so no pairs
    are made. Keys are cut into ranges of values, at quantiles of the right side,
    so a hot key is many tasks; a range's outer neighbours are looked up
    in a table with one row for each key and range.
    """
    fields = [c for c in right.columns if c not in keys]
    cuts = right.select(F.percentile_approx(F.col(b).cast("double"), [k / RANGES for k in range(1, RANGES)]).alias("q")).first()["q"] or []
    bucket = lambda c: F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda q: q < c.cast("double"))) if cuts else F.lit(0)
    value = right.schema[b].dataType
    row = F.struct(F.col(b).alias("v"), F.col(tie).alias("t"), F.struct(*fields).alias("r"))
    # Of equal values only the least tie can win.
    best = right.groupBy(*keys, F.col(b).alias("v")).agg(F.min_by(row, F.col(tie)).alias("row"))
    told = best.where(F.col("v").isNotNull()).withColumn("g", bucket(F.col("v")))
    kind = f"struct<v:{value.simpleString()},t:{right.schema[tie].dataType.simpleString()},r:struct<{','.join(f'{c}:{right.schema[c].dataType.simpleString()}' for c in fields)}>>"
    ends = told.groupBy(*keys, "g").agg(F.max_by("row", "v").alias("last"), F.min_by("row", "v").alias("first"))
    # For each key: its ranges in order; few, so they meet in one row.
    index = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("g", "last", "first"))).alias("ends"))
    mine = left.withColumn("__id", F.struct(*left.columns)).withColumn("v", F.col(a).cast(value)).withColumn("g", bucket(F.col(a)))
    none = F.lit(None).cast(kind)
    both = mine.select(*keys, "g", "v", F.lit(1).alias("s"), "__id", none.alias("row")).unionByName(
        told.select(*keys, "g", "v", F.lit(0).alias("s"), F.lit(None).cast(mine.schema["__id"].dataType).alias("__id"), "row")
    )
    up = Window.partitionBy(*keys, "g").orderBy("v", "s")
    down = Window.partitionBy(*keys, "g").orderBy(F.desc("v"), "s")
    near = both.withColumn("below", F.last("row", ignorenulls=True).over(up)).withColumn("above", F.last("row", ignorenulls=True).over(down)).where("s = 1")
    placed = near.join(index, keys, "left")
    before = F.try_element_at(F.filter("ends", lambda e: e["g"] < F.col("g")), F.lit(-1))["last"]
    after = F.try_element_at(F.filter("ends", lambda e: e["g"] > F.col("g")), F.lit(1))["first"]
    gap = lambda c: F.abs(F.col("v") - c["v"])
    options = F.filter(F.array(F.col("below"), F.col("above"), before, after), lambda c: c.isNotNull())
    ranked = F.array_min(F.transform(options, lambda c: F.struct(gap(c).isNull().alias("far"), gap(c).alias("gap"), c["t"].alias("t"), c["r"].alias("r"))))
    # Without a value of its own a row takes the least tie of its key, as does one whose key has no values.
    any_ = right.groupBy(*keys).agg(F.min_by(F.struct(*fields), F.col(tie)).alias("any"))
    found = placed.withColumn("best", F.when(F.col("v").isNotNull(), ranked)).join(any_, keys, "left")
    match = F.coalesce(F.col("best.r"), F.col("any"))
    return found.select(F.col("__id.*"), match.alias("match"), F.when(match.isNotNull(), F.coalesce(F.col("best.gap") != 0, F.lit(True))).alias("approximate"))
