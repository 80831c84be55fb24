"""Times, pay and nested records, in a session that isn't in UTC."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from jobweave.operators.nested import nested_values, path_triples, stream_triples
from jobweave.operators.timestamps import posting_times
from jobweave.operators.units import yearly_pay

PAGES = "page_id bigint, source string, board string, fetched_at timestamp_ntz, loaded_at timestamp_ntz, payload string, value int"


def pages(spark, *rows):
    data = [(n, s, b, None, None, p if p is None or isinstance(p, str) else json.dumps(p), 7) for n, (s, b, p) in enumerate(rows)]
    df = spark.createDataFrame(data, PAGES)
    return df.withColumn("fetched_at", F.lit("2026-03-10 12:00:00").cast("timestamp_ntz"))


def times(spark, source, *values):
    key = {"france_travail": ("resultats", "dateCreation"), "lever": (None, "createdAt"), "remoteok": (None, "epoch"), "jsearch": ("data", "job_posted_at_datetime_utc")}[source]
    out = {}
    # One value a page: chains of one.
    for v in values:
        items = [{key[1]: v}]
        out[v] = items if key[0] is None else {key[0]: items}
    got = {r.page_id: r.utc for r in posting_times(pages(spark, *((source, "all", p) for p in out.values()))).collect()}
    return [got.get(n) for n in range(len(values))]


def test_paris_wall_clock(spark):
    assert times(
        spark, "france_travail", "2026-01-05T10:00:00", "2025-10-26 02:30", "2026-03-29T02:30:00", "05/01/2026", "1er février 2026 à 9h05",
        "il y a 2 jours", "2026-01-05T10:00:00.987+0100", "hier", "25/13/2026", "0000-00-00", "N/A", "", None,
    ) == [
        "2026-01-05T09:00:00Z", "2025-10-26T00:30:00Z", "2026-03-29T01:30:00Z", "2026-01-04T23:00:00Z", "2026-02-01T08:05:00Z",
        "2026-03-08T12:00:00Z", "2026-01-05T09:00:00Z", "2026-03-09T12:00:00Z", None, None, None, None, None,
    ]


def test_other_sources(spark):
    assert times(spark, "lever", 1772441724, 1772441724123, 1772441724123456, "1772441724", 0) == ["2026-03-02T08:55:24Z"] * 4 + [None]
    assert times(spark, "remoteok", "1759374168.9", "Mon, 02 Mar 2026 08:55:24 GMT") == ["2025-10-02T03:02:48Z", "2026-03-02T08:55:24Z"]
    assert times(
        spark, "jsearch", "3/2/2026 12:05 AM PST", "2025-11-02 01:19:00 America/Chicago", "2026-03-02 12:05:00 America/Nowhere", "Mar 2, 2026 08:55 UTC", "5 hours ago", "3/2/2026"
    ) == ["2026-03-02T08:05:00Z", "2025-11-02T06:19:00Z", None, "2026-03-02T08:55:00Z", "2026-03-10T07:00:00Z", "2026-03-02T00:00:00Z"]


def test_two_digit_years(spark):
    assert times(spark, "france_travail", "28.04.26 20:56", "02.06.26 09:18", "13/10/25", "01-02-26T08:00+00:00", "00.00.00 00:00", "28.04.126 20:56", "31.02.26 10:00") == [
        "2026-04-28T18:56:00Z", "2026-06-02T07:18:00Z", "2025-10-12T22:00:00Z", "2026-02-01T08:00:00Z", None, None, None,
    ]
    assert times(spark, "jsearch", "3/2/26 12:05 AM PST", "02/03/26") == ["2026-03-02T08:05:00Z", "2026-02-03T00:00:00Z"]


def test_times_of_odd_pages(spark):
    lone = {"data": {"job_posted_at_datetime_utc": "2026-03-02"}}
    rows = [("jsearch", "a", lone), ("jsearch", "a", None), ("jsearch", "a", "{broken"), ("jsearch", "a", {"data": []}), ("jsearch", "a", {"data": [None, 5, "x", lone["data"]]}), ("remoteok", "a", [{"legal": "x"}, {"epoch": 1772441724}])]
    df = pages(spark, *rows)
    got = sorted((r.page_id, r.item_no) for r in posting_times(df.union(df)).collect())
    assert got == [(0, 0), (4, 3), (5, 1)]
    assert posting_times(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def rates(spark):
    fx = spark.createDataFrame([("EUR", 1.0), ("GBP", 1.17), ("USD", 0.92), ("CHF", 1.05), ("CAD", 0.67)], "currency string, eur_per_unit double")
    return fx, spark.createDataFrame([("year", 1), ("month", 12), ("week", 52), ("day", 218), ("hour", 1820)], "pay_period string, per_year int")


def pay(spark, rates, source, board, item, key):
    return sorted((r.bound, r.eur_year) for r in yearly_pay(pages(spark, (source, board, {key: [item]})), *rates).collect())


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Mensuel de 2 500,00 EUR à 3 000 EUR sur 13.0 mois", [("high", 39000), ("low", 32500)]),
        ("Mensuel de 3 500 € x 14 mois", [("low", 49000)]),
        ("63-116 k€ brut annuel", [("high", 116000), ("low", 63000)]),
        ("De 46,75 à 79,50 euros de l'heure", [("high", 144690), ("low", 85085)]),
        ("Journalier de 390 CHF", [("low", 89271)]),
        ("Selon profil + 13e mois", []), ("SMIC", []), ("", []), ("0 € par an", []),
    ],
)
def test_french_pay(spark, rates, text, expected):
    assert pay(spark, rates, "france_travail", "all", {"salaire": {"libelle": text}}, "resultats") == expected


def test_other_pay(spark, rates):
    assert pay(spark, rates, "adzuna", "gb", {"salary_min": 126, "description": "We travel. Salary in thousands per year."}, "results") == [("low", 147420)]
    assert pay(spark, rates, "adzuna", "us", {"salary_min": "50.5", "description": "x 10 times a year. Rate per hour."}, "results") == [("low", 84557)]
    assert pay(spark, rates, "jsearch", "all", {"job_max_salary": "CA$8,750", "job_salary_period": "MONTHLY", "job_country": "US"}, "data") == [("high", 70350)]
    assert pay(spark, rates, "jsearch", "all", {"job_max_salary": 54, "job_country": "DE"}, "data") == []
    parts = [{"label": "Equity", "value": "0.1% – 0.5%"}, {"label": "Salary", "value": "£48k – £74k annually"}, None, {"label": "Bonus", "value": "£1,000"}]
    assert pay(spark, rates, "ashby", "x", {"compensation": json.dumps({"summaryComponents": parts, "currency": None})}, "jobs") == [("high", 86580), ("low", 56160)]


def test_stream_triples():
    text = '{"a": [{"b": [null, 1.50, "x"]}, {"b": "lone"}], "c": "{\\"d\\": 2}"}'
    assert list(stream_triples(text, frozenset(), frozenset())) == [("a.b", [0, 1], "1.50"), ("a.b", [0, 2], "x"), ("a.b", [1], "lone"), ("c", [], '{"d": 2}')]
    assert list(stream_triples(text, frozenset({"a.b", "c.d"}), frozenset({"a.b"}))) == [("a.b", [0, 1], "1.50"), ("a.b", [0, 2], "x"), ("a.b", [1, 0], "lone"), ("c.d", [], "2")]
    assert list(stream_triples("{broken", frozenset(), frozenset())) == list(stream_triples(None, frozenset(), frozenset())) == []


def test_nested_values(spark):
    rows = [
        ("usajobs", "all", {"SearchResult": {"SearchResultItems": {"MatchedObjectId": 805679302}}}),
        ("jsearch", "all", {"data": [{}, {"job_highlights": json.dumps({"Qualifications": ["a", None, "b"]})}, {"job_highlights": {"Qualifications": "c"}}]}),
        ("ashby", "x", {"jobs": [{"compensation": {"summaryComponents": [None, {"label": "l"}, {"value": "v"}]}}]}),
        ("ashby", "x", None), ("adzuna", "fr", {"jobs": [1]}),
    ]
    df = pages(spark, *rows)
    got = sorted(tuple(r)[:2] + tuple(r)[3:] for r in nested_values(df.union(df)).collect())
    assert got == [(0, 0, -1, "805679302"), (1, 1, 0, "a"), (1, 1, 2, "b"), (1, 2, 0, "c"), (2, 0, 2, "v")]
    assert path_triples(df.limit(0), "payload", ["page_id"]).count() == 0


def test_transition_costs_decide_an_open_order(spark):
    """A source without a declared order of day and month: the answer fetched before decides, in either direction."""
    def page(i, hour, values):
        return i, "lever", "b", datetime.datetime(2026, 5, 6, hour), json.dumps([{"createdAt": v} for v in values])

    schema = "page_id bigint, source string, board string, fetched_at timestamp_ntz, payload string"
    # An answer without times between them hands on what it got.
    between = page(5, 1, [None, "N/A"])
    for first, month in (("25/03/2026 10:00", "04"), ("03/25/2026 10:00", "05")):
        later = page(3, 2, ["05/04/2026 10:00", None, "05/04/2026 11:00"])
        df = spark.createDataFrame([page(4, 1, [first]), between, later, later, page(2, 1, [])], schema)
        got = sorted((r.page_id, r.item_no, r.utc[5:7]) for r in posting_times(df).collect())
        assert got == [(3, 0, month), (3, 2, month), (4, 0, "03")]


def test_events_of_odd_texts():
    """Broken JSON gives nothing, whatever comes before the break; nesting has no limit."""
    for bad in ('{"a":1,}', "[1,2", '{"a" 1}', "{} x", "[,]", '{"a":"\\x"}', "tru", "[1 2]", '{"a":"b\nc"}', '{"a":[1}'):
        assert stream_triples(bad, frozenset(), frozenset()) == []
    assert stream_triples('{"a": [1, null, "x\\u00e9"], "b": {"c": true}}', frozenset(), frozenset()) == [("a", [0], "1"), ("a", [2], "xé"), ("b.c", [], "true")]
    deep = "[" * 20_000 + "7" + "]" * 20_000
    assert stream_triples(deep, frozenset(), frozenset()) == [("", [0] * 20_000, "7")]
    assert stream_triples('{"x": {"a": [[', frozenset({"b"}), frozenset()) == []


def test_large_keys_beside_nulls(spark):
    df = spark.createDataFrame([(2**62 + 1, '{"a": [1]}'), (None, '{"a": [2]}')], "k bigint, payload string")
    assert {(r.k, r.value) for r in path_triples(df, "payload", ["k"]).collect()} == {(2**62 + 1, "1"), (None, "2")}
