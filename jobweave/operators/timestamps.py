"""Mixed timestamp wordings to one UTC instant, by Viterbi over record order.

Every value is read in all ways that are valid for it (unit of an epoch,
order of day and month, zone written or assumed); a reading carries a cost for
departing from what its source declares. A source's records, in the order they
were fetched, form a chain; the cheapest path through it is chosen, where a
change of format and a jump back in time cost extra. Declared conventions
outweigh both, so the chain decides what they leave open: the order of day and
month where a source declares none.

An answer's records are one row. A first pass finds the cheapest path through
each answer and the state it ends in; then each answer with an open record goes
through a second pass that starts from the end of the source's answer before
it. Ends are handed on within slices of an hour of a source's fetches, and from
slice to slice by a table with one row for each, so no task sees all records of
a source.

All of it is column arithmetic inside the JVM. Nothing depends on the session time zone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.session import checkpoint, epoch_seconds
from jobweave.sources.payloads import items
from jobweave.text import fold, let, squeeze

#: Hours east of UTC of zone abbreviations.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 1, "BST": 1, "IST": 1, "CET": 1, "CEST": 2, "MEZ": 1, "MESZ": 2,
    "EET": 2, "EEST": 3, "MSK": 3, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8,
    "PDT": -7, "AKST": -9, "AKDT": -8, "HST": -10,
}

#: Beginnings of month names (fr, en, de, es), folded to ASCII.
MONTHS = {
    1: "jan|ene", 2: "fev|feb", 3: "mar", 4: "avr|apr|abr", 5: "mai|may", 6: "juin|jun", 7: "juil|jul", 8: "aou|aug|ago",
    9: "sep", 10: "oct|okt", 11: "nov", 12: "dec|dez|dic",
}

#: Words for units of relative times, as seconds.
UNITS = {
    "s|sec|secs|seconds?|secondes?|sekunden?|segundos?": 1,
    "min|mins|mn|minutes?|minuten?|minutos?|minuti": 60,
    "h|hr|hrs|hours?|heures?|stunden?|horas?|ore|ora": 3600,
    "j|d|jours?|days?|tage?n?|dias?|giorni|giorno": 86400,
    "sem|semaines?|weeks?|wochen?|semanas?|settiman[ae]": 604800,
    "mois|months?|monate?n?|meses|mes|mesi": 2592000,
    "ans?|annees?|years?|jahre?n?|anos?": 31536000,
}

FAR = 100.0  #: cost of a reading against the source's convention
SWITCH = 1.0  #: cost of another format than the record before
BACK = 0.25  #: cost of lying before the record before
FUTURE = 20.0  #: cost of lying more than two days after the fetch
#: Seconds of fetching within which ends are handed on row by row.
SLICE = 3600


@dataclass(frozen=True)
class Convention:
    """How a source writes times that could be read in more than one way."""

    field: str
    zone: str = "UTC"
    #: Whether the day stands before the month; None leaves both orders open.
    day_first: bool | None = None


#: The time field and the conventions of each source.
CONVENTIONS = {
    "france_travail": Convention("dateCreation", "Europe/Paris", True),
    "lever": Convention("createdAt"),
    "remoteok": Convention("epoch"),
    "jsearch": Convention("job_posted_at_datetime_utc", day_first=False),
}

_READING = "array<struct<format:string,sec:bigint,cost:double>>"


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _wall(year: Column, month: Column, day: Column, clock: dict[str, Column]) -> Column:
    """Civil seconds since 1970, null where the date or the clock time doesn't exist."""
    date = F.unix_date(F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd"))
    h, m, s = clock["h"], clock["m"], clock["s"]
    return F.when((h < 24) & (m < 60) & (s < 60), date.cast("bigint") * 86400 + h * 3600 + m * 60 + s)


def _clock(text: Column) -> dict[str, Column]:
    """Clock time in the rest of a value; none is midnight, a broken one is null."""
    text = fold(text)
    pattern = r"^[,t\s]*(?:a |at |um |le )?\s*(\d{1,2})\s?[:h]\s?(\d{2})?(?::(\d{2})(?:[.,]\d+)?)?\s*(?:([ap]\.?m\.?)(?![a-z]))?"
    has = text.rlike(r"\d")
    part = lambda i: F.coalesce(_int(F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))), F.lit(0))
    found = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    hour, half = _int(found), F.substring(F.regexp_extract(text, pattern, 4), 1, 1)
    hour = F.when(half == "p", F.when(hour == 12, 12).otherwise(hour + 12)).when((half == "a") & (hour == 12), 0).otherwise(hour)
    # Digits of a written offset alone ("+02:00") are no clock time.
    plain = ~has | text.rlike(r"^\s*[+-]\d")
    return {"h": F.when(found.isNotNull(), hour).when(plain, 0), "m": F.when(found.isNotNull() | plain, part(2)), "s": part(3)}


def _zoned(wall: Column, rest: Column, zone: Column) -> Column:
    """Civil seconds to UTC seconds by the zone written in ``rest``, else by ``zone``.

    ``to_utc_timestamp`` takes the earlier offset of an hour that occurs twice
    and the offset before the change for one that is skipped.
    """
    sign = F.regexp_extract(rest, r"([+-])(\d{2}):?(\d{2})?\s*$", 1)
    off = F.coalesce(_int(F.nullif(F.regexp_extract(rest, r"([+-])(\d{2}):?(\d{2})?\s*$", 2), F.lit(""))), F.lit(0)) * 3600
    off += F.coalesce(_int(F.nullif(F.regexp_extract(rest, r"([+-])(\d{2}):?(\d{2})?\s*$", 3), F.lit(""))), F.lit(0)) * 60
    region = F.regexp_extract(rest, r"([A-Z][A-Za-z]+(?:/[A-Za-z_+-]+)+)\s*$", 1)
    # A cast knows all regions and gives null for others, where a conversion function would fail.
    named = F.unix_seconds(F.concat(F.rtrim(_iso(wall), F.lit("Z")), F.lit(" "), region).try_cast("timestamp"))
    abbreviation = F.regexp_extract(rest, r"(?:^|[\s\d])([A-Z]{1,4})\s*$", 1)
    fixed = F.try_element_at(F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv)), abbreviation) * 3600
    civil = lambda z: F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(wall), z))
    return (
        F.when(sign != "", wall - F.when(sign == "-", -off).otherwise(off))
        .when(region != "", named)
        .when(fixed.isNotNull(), wall - fixed)
        .otherwise(civil(zone))
    )


def _month(text: Column) -> Column:
    folded = fold(text)
    month = F.lit(None).cast("int")
    for number, names in MONTHS.items():
        month = F.when(folded.rlike(f"^(?:{names})"), number).otherwise(month)
    return month


def readings(value: Column, fetched: Column, zone: Column, day_first: Column) -> Column:
    """All valid readings of ``value`` as ``array<struct<format, sec, cost>>``.

    Null, empty, zero and placeholder values give the empty array; so do
    wordings that denote no instant. A null ``day_first`` leaves the order of
    day and month open.
    """
    return let(squeeze(value), lambda v: _readings(v, fetched, zone, day_first))


def _readings(v: Column, fetched: Column, zone: Column, day_first: Column) -> Column:
    get = lambda p, i: F.regexp_extract(v, p, i)
    one = lambda name, sec, cost: F.struct(F.lit(name).alias("format"), sec.cast("bigint").alias("sec"), cost.cast("double").alias("cost"))
    ok = F.lit(0.0)

    number = F.when(v.rlike(r"^\d{6,20}(?:\.\d+)?$"), v.try_cast("decimal(38,9)"))
    out = []
    for name, factor in (("s", 1), ("ms", 10**3), ("us", 10**6), ("ns", 10**9)):
        sec = F.floor(number / F.lit(factor))
        out.append(one(f"epoch_{name}", F.when(sec.between(631152000, 4102444800), sec), ok))

    # Civil readings: the same arithmetic for all of them, so the plan holds it once.
    civil = lambda name, year, month, day, rest, cost: F.struct(
        F.lit(name).alias("format"), _int(year).alias("y"), month.alias("m"), day.alias("d"), rest.alias("rest"), cost.cast("double").alias("cost")
    )
    iso = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(.*)$"
    dmy = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2}(?!\d))(.*)$"
    words = r"^(?:\p{L}+\.?,? )?(\d{1,2})(?:er|st|nd|rd|th|\.)? (?:de )?(\p{L}{3,})\.?,? (?:de )?(\d{4})(.*)$"
    turned = r"^(?:\p{L}+, )?(\p{L}{3,})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})(.*)$"
    a, b = _int(get(dmy, 1)), _int(get(dmy, 2))
    # A year of two digits lies in this century.
    year = F.when(F.length(get(dmy, 3)) == 2, F.concat(F.lit("20"), get(dmy, 3))).otherwise(get(dmy, 3))
    forms = F.filter(
        F.array(
            civil("iso", get(iso, 1), _int(get(iso, 2)), _int(get(iso, 3)), get(iso, 4), ok),
            civil("dmy", year, b, a, get(dmy, 4), F.when(~day_first, FAR).otherwise(0.0)),
            civil("mdy", year, a, b, get(dmy, 4), F.when(day_first, FAR).otherwise(0.0)),
            civil("day_month", get(words, 3), _month(get(words, 2)), _int(get(words, 1)), get(words, 4), ok),
            civil("month_day", get(turned, 3), _month(get(turned, 1)), _int(get(turned, 2)), get(turned, 4), ok),
        ),
        lambda c: c["y"].isNotNull() & c["m"].isNotNull() & c["d"].isNotNull(),
    )
    instant = lambda c: let(_wall(c["y"], c["m"], c["d"], _clock(c["rest"])), lambda wall: _zoned(wall, c["rest"], zone))
    dated = F.transform(forms, lambda c: F.struct(c["format"].alias("format"), instant(c).cast("bigint").alias("sec"), c["cost"].alias("cost")))

    low = fold(v)
    back = r"^(?:il y a|hace|vor|ha|posted|publie il y a|publiee il y a|publicado hace)?\s*(?:environ|about|etwa)?\s*(\d{1,4}|une?|an?|eine[mnr]?|uno|una|un)\+?\s*([a-z]+)\.?(?: ago| fa| atras)?$"
    amount = F.regexp_extract(low, back, 1)
    unit = F.regexp_extract(low, back, 2)
    seconds = F.lit(None).cast("bigint")
    for names, n in UNITS.items():
        seconds = F.when(unit.rlike(f"^(?:{names})$"), n).otherwise(seconds)
    count = F.when(amount.rlike(r"^\d+$"), _int(amount)).when(amount != "", 1)
    said = low.rlike(r"^(?:il y a|hace|vor|ha |publi|posted)| ago$| fa$| atras$|^\d+\s?[a-z]+$")
    out.append(one("relative", F.when(said, fetched - count * seconds), ok))
    days = F.when(low.rlike(r"^(?:hier|yesterday|gestern|ayer|ieri)$"), 1).when(low.rlike(r"^(?:aujourd'hui|today|heute|hoy|oggi|now|just now|a l'instant)$"), 0)
    out.append(one("relative", fetched - days * 86400, ok))

    late = lambda r: F.struct(r["format"], r["sec"], (r["cost"] + F.when(r["sec"] > fetched + 172800, FUTURE).otherwise(0.0)).alias("cost"))
    valid = F.filter(F.concat(F.array(*out[:4]), dated, F.array(*out[4:])), lambda r: r["sec"].isNotNull())
    return F.coalesce(F.transform(valid, late), F.array().cast(_READING))


_STATE = "struct<format:string,sec:bigint>"


def viterbi(chains: Column, before: Column | None = None) -> Column:
    """Cheapest reading of each record: array of arrays of readings to ``struct<path array<bigint>, end struct<format, sec>>``.

    ``before`` is the state the chain begins in (null: unknown); ``end`` the one
    it ends in. A record without readings keeps its place as null and is passed
    over. Ties go to the earlier path, then to the reading listed first.
    """
    state = "array<struct<cost:double,format:string,sec:bigint,path:array<bigint>>>"

    def step(acc: Column, cands: Column) -> Column:
        def extend(r: Column) -> Column:
            def price(p: Column) -> Column:
                move = F.when(p["format"].isNull(), 0.0).otherwise(
                    F.when(p["format"] != r["format"], SWITCH).otherwise(0.0) + F.when(r["sec"] < p["sec"], BACK).otherwise(0.0)
                )
                return F.struct((p["cost"] + move).alias("cost"), p["path"].alias("path"))

            best = F.array_min(F.transform(acc, price))
            return F.struct(
                (best["cost"] + r["cost"]).alias("cost"), r["format"].alias("format"), r["sec"].alias("sec"),
                F.concat(best["path"], F.array(r["sec"])).alias("path"),
            )

        skip = F.transform(acc, lambda p: F.struct(p["cost"], p["format"], p["sec"], F.concat(p["path"], F.array(F.lit(None).cast("bigint"))).alias("path")))
        return F.when(F.size(cands) == 0, skip).otherwise(F.transform(cands, extend)).cast(state)

    before = F.lit(None).cast(_STATE) if before is None else before
    start = F.array(F.struct(F.lit(0.0).alias("cost"), before["format"].alias("format"), before["sec"].alias("sec"), F.array().cast("array<bigint>").alias("path"))).cast(state)

    def cheapest(acc: Column) -> Column:
        best = F.array_min(F.transform(acc, lambda p: F.struct(p["cost"].alias("cost"), p["path"].alias("path"), p["format"].alias("format"), p["sec"].alias("sec"))))
        return F.struct(best["path"].alias("path"), F.struct(best["format"].alias("format"), best["sec"].alias("sec")).alias("end"))

    return F.aggregate(chains, start, step, cheapest)


def posting_times(pages: DataFrame) -> DataFrame:
    """``page_id, item_no, source, utc`` of every item whose time field denotes an instant.

    Rows are distinct. Items that are null or no object, absent fields and
    placeholders give no row; an empty table gives an empty result. Extra
    columns of ``pages`` are not looked at. An answer delivered again counts
    once in its source's order.
    """
    known = F.col("source").isin(list(CONVENTIONS))
    chains = items(pages.where(known))
    zone, day_first = F.lit("UTC"), F.lit(None).cast("boolean")
    schema = "struct<" + ",".join(f"{c.field}:string" for c in CONVENTIONS.values()) + ">"
    for source, c in CONVENTIONS.items():
        here = F.col("source") == source
        zone = F.when(here, c.zone).otherwise(zone)
        day_first = F.when(here, F.lit(c.day_first).cast("boolean")).otherwise(day_first)

    def value(item: Column) -> Column:
        parsed = F.from_json(item, schema)
        field = F.lit(None).cast("string")
        for source, c in CONVENTIONS.items():
            field = F.when(F.col("source") == source, parsed[c.field]).otherwise(field)
        return field

    chains = (
        chains.withColumn("fetched", epoch_seconds("fetched_at"))
        .withColumn("zone", zone).withColumn("day_first", day_first)
        .withColumn("value", F.transform("items", value))
    )
    read = F.transform("value", lambda v: readings(v, F.col("fetched"), F.col("zone"), F.col("day_first")))
    alone = chains.select("page_id", "source", "fetched", read.alias("read")).withColumn("best", viterbi(F.col("read")))
    # Readings are needed again only where one is open; the others' paths are final.
    open_ = F.exists("read", lambda r: F.size(r) > 1)
    narrow = checkpoint(alone.select("page_id", "source", "fetched", "best", F.when(open_, F.col("read")).alias("read"), F.floor(F.col("fetched") / SLICE).alias("slice")))
    end = F.when(F.col("best.end.sec").isNotNull(), F.col("best.end"))
    slices = narrow.groupBy("source", "slice").agg(F.max_by(end, F.when(end.isNotNull(), F.struct("fetched", "page_id"))).alias("last"))
    until = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("source", "slice", F.last("last", ignorenulls=True).over(until).alias("slice_before"))
    order = Window.partitionBy("source", "slice").orderBy("fetched", "page_id")
    earlier = F.last(end, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    page = F.lag("page_id").over(order)
    # An answer delivered again begins where its first delivery did.
    began = narrow.join(slices, ["source", "slice"], "left").withColumn("handed", F.when(page.isNull() | (page != F.col("page_id")), F.struct(F.coalesce(earlier, F.col("slice_before")).alias("end"))))
    placed = began.withColumn("before", F.last("handed", ignorenulls=True).over(order)["end"])
    path = F.when(F.col("read").isNotNull() & F.col("before").isNotNull(), viterbi(F.col("read"), F.col("before"))["path"]).otherwise(F.col("best.path"))
    return (
        placed.select("page_id", "source", F.posexplode(path).alias("item_no", "sec"))
        .where(F.col("sec").isNotNull())
        .select("page_id", "item_no", "source", _iso(F.col("sec")).alias("utc"))
        .distinct()
    )


def _iso(sec: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ssZ`` of seconds since 1970, whatever the session's zone is."""
    day, left = F.floor(sec / 86400), F.pmod(sec, F.lit(86400))
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(
        F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("string"), F.lit("T"), two(F.floor(left / 3600)), F.lit(":"),
        two(F.floor(left / 60) % 60), F.lit(":"), two(left % 60), F.lit("Z"),
    )
