import datetime
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobweave.operators import market, match, texts
from jobweave.sources import providers, sinks
from jobweave.streaming.monitor import watch

POSTING = "posting_id bigint, title string, company string, location string, remote boolean, apply_url string, date_posted string, description string, salary string, tags array<string>"


def greedy(rows):
    """Brute force: first anchor within 14 days, in order; the most complete of each cluster."""
    day = lambda t: datetime.date.fromisoformat(t) if t else None
    near = lambda a, b: a is None or b is None or abs((a - b).days) <= 14
    clusters = []
    for i, t, full in rows:
        for c in clusters:
            if near(c[0], day(t)):
                c[1].append((-full, i))
                break
        else:
            clusters.append((day(t), [(-full, i)]))
    return sorted(min(m)[1] for _, m in clusters)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 60)), st.booleans()), min_size=1, max_size=14))
def test_dedupe_is_the_greedy_loop(spark, items):
    base = datetime.date(2026, 1, 1)
    rows = [(n, "Data Engineer", "Acme SAS", "Lyon, FR", None, None, None if d is None else str(base + datetime.timedelta(d)), "x", "1" if full else None, []) for n, (d, full) in enumerate(items)]
    kept = sorted(r.posting_id for r in market.dedupe(spark.createDataFrame(rows, POSTING)).select("posting_id").collect())
    assert kept == greedy([(r[0], r[6], 3 + (r[6] is not None) + (r[8] is not None)) for r in rows])


def test_dedupe_empty_and_nulls(spark):
    df = spark.createDataFrame([(1, None, None, None, None, None, "garbage", None, None, None), (2, None, None, None, None, None, None, None, None, None)], POSTING)
    assert [r.posting_id for r in market.dedupe(df).select("posting_id").collect()] == [1]
    assert market.dedupe(df.limit(0)).count() == 0


def test_names_within_names(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abÉ ") for _ in range(rnd.randint(0, 6)))
    xs, ys = [word() for _ in range(60)] + [None], [word().upper() for _ in range(60)] + [None, ""]
    one, two = (spark.createDataFrame(list(enumerate(v)), f"{k} int, {c} string") for k, c, v in (("i", "n", xs), ("j", "m", ys)))
    plain = lambda x: (x or "").strip(" ").lower()
    want = {(i, j) for i, x in enumerate(xs) for j, y in enumerate(ys) if plain(x) and plain(y) and (plain(x) in plain(y) or plain(y) in plain(x))}
    got = [(r.i, r.j) for r in market.name_overlap_join(one, two, "n", "m").collect()]
    assert set(got) == want and len(got) == len(want)


def test_nearest_is_the_nearest(spark):
    rnd = random.Random(7)
    value = lambda: None if rnd.random() < 0.1 else float(rnd.randint(0, 40))
    left = [(n, rnd.choice("abcz"), value()) for n in range(120)]
    right = [(n, rnd.choice("abc"), value()) for n in range(90)] + [(900, "n", None), (901, "n", None)]
    left += [(900, "n", 3.0)]
    got = market.nearest(spark.createDataFrame(left, "i int, k string, a double"), spark.createDataFrame(right, "j int, k string, b double"), ["k"], "a", "b", "j").collect()
    assert len(got) == len(left)
    for r in got:
        options = sorted((r.a is None or b is None, 0 if r.a is None or b is None else abs(r.a - b), j) for j, k, b in right if k == r.k)
        assert (r.match and r.match.j) == (options[0][2] if options else None)
        assert r.approximate == ((options[0][0] or options[0][1] != 0) if options else None)


def test_links_are_counted_as_pairs_would_be(spark):
    rnd = random.Random(9)
    base = datetime.date(2026, 1, 1)
    rows = [(n, rnd.choice("ab"), None if rnd.random() < 0.1 else base + datetime.timedelta(rnd.randint(0, 60))) for n in range(80)] + [(99, None, base), (98, "lone", None)]
    near = lambda a, b: a is None or b is None or abs((a - b).days) <= 14
    want = {i: sum(j != i and l == k and near(d, e) for j, l, e in rows) for i, k, d in rows if k is not None}
    got = market.duplicate_links(spark.createDataFrame(rows, "i int, __key string, __dt date"), "i").collect()
    assert {r.i: r.links for r in got} == want and len(got) == len(want)


def test_latest_reads_what_is_asked_for(spark):
    from jobweave.plans import reference_queries

    df = reference_queries.pr11_recency(spark, "/root/testdata/sf0.001")
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "ReadSchema: struct<posting_id:bigint,date_posted:string,ingested_at:timestamp_ntz>" in plan
    log = spark.createDataFrame([(1, 5, "a", 9), (1, 7, "b", 8), (None, 1, "c", 7), (None, 2, None, 6)], "id int, at int, x string, y int")
    assert {tuple(r) for r in market.latest(log, "id", "at", "x").collect()} == {(1, "b"), (None, None)}
    assert {tuple(r) for r in market.latest(log, "id", "at").collect()} == {(1, 7, "b", 8), (None, 2, None, 6)}


def test_normalisers(spark):
    page = lambda p: spark.createDataFrame([(p,), ("{broken",), (None,)], "payload string")
    r = providers.normalise(page('{"offers": [{"id": 1, "title": "t", "city": "", "country": "FR", "salary_from": 3, "salary_currency": "EUR"}, 5]}'), "recruitee").collect()
    assert [(x.source_id, x.location, x.salary) for x in r] == [("1", "FR", "3 EUR")]
    r = providers.normalise(page('[{"legal": "x"}, {"id": "9", "position": "p", "tags": ["a", ""]}]'), "remoteok").collect()
    assert [(x.source_id, x.remote, x.tags) for x in r] == [("9", True, ["a"])]
    r = providers.normalise(page('{"data": [{"job_id": "7", "job_title": "t", "job_city": "Nice", "job_country": "FR", "job_highlights": {"Q": ["a", "b", "c", "d"]}}]}'), "jsearch").collect()
    assert [(x.location, x.tags) for x in r] == [("Nice, FR", ["a", "b", "c"])]
    for name in providers.SPECS:
        assert providers.normalise(page("[]"), name).columns == providers.POSTING


def test_times_of_normalisers(spark):
    page = lambda p: spark.createDataFrame([(p,)], "payload string")
    assert [r.date_posted for r in providers.normalise(page('[{"id": "a", "createdAt": 1772441724123}, {"id": "b", "createdAt": "2026-01-02"}]'), "lever").collect()] == ["2026-03-02T08:55:24Z", "2026-01-02"]
    assert [r.date_posted for r in providers.normalise(page('{"data": [{"slug": "a", "created_at": 1772441724}]}'), "arbeitnow").collect()] == ["2026-03-02T08:55:24Z"]


def test_requirements_and_score(spark):
    offers = spark.createDataFrame([(1, "Title\nRequirements:\n- Python, Go\n- K8s and Kafka\n\n\nIgnored\nNice to have\nRust\nGo"), (2, None), (3, "")], "offer bigint, text string")
    wanted = match.requirements(offers, "offer", "text")
    assert {(r.kind, r.term) for r in wanted.collect()} == {("must", "python"), ("must", "go"), ("must", "k8s"), ("must", "kafka"), ("nice", "rust")}
    cvs = spark.createDataFrame([(7, "Python, kubernetes; Rust."), (8, None)], "cv bigint, text string")
    aliases = spark.createDataFrame([("k8s", "kubernetes"), ("kube", "kubernetes")], "alias string, canonical string")
    found = match.covered_terms(wanted, match.terms_of(cvs, "cv", "text"), aliases, "cv", fuzzy=False)
    assert {tuple(r) for r in found.collect()} == {(7, "python", "exact"), (7, "k8s", "alias"), (7, "rust", "exact")}
    names = match.expanded(wanted.select("term").distinct(), aliases)
    assert {r.name for r in names.where("term = 'k8s'").collect()} == {"k8s", "kube", "kubernetes"} and {r.name for r in names.where("term = 'go'").collect()} == {"go"}
    gaps = match.keyword_gaps(wanted, found, offers.where("text is not null"), cvs.where("text is not null"), "offer", "cv", "text", most=1)
    # "go" stands twice in the offer, so it comes before "kafka".
    assert [(r.cv, r.offer, r.term, r.n, r.status, r.rank_no) for r in gaps.collect()] == [(7, 1, "go", 2, "missing", 1)]


def test_token_sets():
    import difflib

    share = match.token_set_share
    assert share("senior data engineer", "data engineer") == 100 and share("b a", "a b") == 100 and share("", "a") == share("a", " ") == 0
    assert share("Data Engineer", "data engineer") < 85 <= share("data enginer", "data engineer")
    rnd = random.Random(2)

    def slow(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            last = 0
            for k, b in enumerate(y, 1):
                last, row[k] = row[k], last + 1 if a == b else max(row[k], row[k - 1])
        return row[-1]

    for _ in range(200):
        x, y = ("".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 90))) for _ in range(2))
        assert match.common_length(x, y) == slow(x, y) and abs(share(x, y) - share(y, x)) < 1e-9
        assert match.common_length(x, y) >= sum(b.size for b in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())


def test_token_set_column(spark):
    df = spark.createDataFrame([("a b", "b a"), (None, "x"), ("x" * 5000, "x" * 4999)], "x string, y string")
    assert [None if v is None else round(v, 2) for v, in df.select(match.token_set_ratio(F.col("x"), F.col("y"))).collect()] == [100.0, None, 99.99]


def test_all_offers_and_cvs(spark):
    offers = spark.createDataFrame([(1, "Senior dev\nRequirements:\n- K8s, Python\n- Kafka clusters\n- PostgreSQL\nNice to have\nml"), (50, "Requirements:\nJavascript\nRust")], "offer bigint, text string")
    cvs = spark.createDataFrame([(7, "Junior. Kubernetes, kafka, postgressql, machine learning"), (90, "JS"), (91, "Cobol")], "cv bigint, text string")
    aliases = match.synonyms(spark)
    wanted = match.requirements(offers, "offer", "text")
    offered = match.terms_of(cvs, "cv", "text").unionByName(match.phrases_of(cvs, "cv", "text", aliases))
    found = match.covered_terms(wanted, offered, aliases, "cv")
    assert {tuple(r) for r in found.collect()} == {
        (7, "k8s", "alias"), (7, "kafka clusters", "exact"), (7, "postgresql", "fuzzy"), (7, "ml", "alias"), (90, "javascript", "alias"),
    }
    level = match.level_rank(F.col("text")).alias("level")
    scores = match.all_scores(wanted, found, offers.select("offer", level), cvs.select("cv", level), "offer", "cv")
    # Three of four required and the wished one, less a tenth: no neighbours' ids needed.
    assert {tuple(r) for r in scores.collect()} == {(7, 1, 73.13, 1), (90, 50, 37.5, 1)}


def test_sinks(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = lambda *r: spark.createDataFrame(r, "id int, stage string")
    assert sinks.read_store(spark, log, rows((1, "a")).schema).count() == 0
    sinks.upsert(rows((1, "a"), (2, "a")), log)
    sinks.upsert(rows((1, "b")), log)
    assert {(r.id, r.stage) for r in sinks.current(spark, log, "id").collect()} == {(1, "b"), (2, "a")}
    assert [r.id for r in sinks.append_valid(rows((3, " "), (4, "x")), ["stage"], str(tmp_path / "v")).collect()] == [3]


def test_sections_and_confidence(spark):
    df = spark.createDataFrame([(1, "Jane\nProfil :\nHello\r\n\r\nÉDUCATION\nMSc"), (2, None), (3, "")], "cv_id bigint, raw_text string")
    assert [(r.name, r.text) for r in texts.sections(df, "cv_id", "raw_text").orderBy("section_no").collect()] == [("summary", "Hello"), ("education", "MSc")]


def test_stream(spark, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy("/root/testdata/sf0.001/monitor_new_jobs.parquet", tmp_path / "in")
    schema = spark.read.parquet(str(tmp_path / "in")).selectExpr("posting_id", "source_id", "cast(detected_at as timestamp) detected_at").schema
    raw = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    known = spark.read.parquet("/root/testdata/sf0.001/job_postings.parquet")
    fresh = watch(raw.selectExpr("posting_id", "source_id", "cast(detected_at as timestamp) detected_at").where("detected_at is not null"), known, "source_id", "detected_at", "3650 days")
    q = fresh.writeStream.format("memory").queryName("fresh").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = spark.read.parquet(str(tmp_path / "in")).where("detected_at is not null").select("source_id").distinct().join(known.select("source_id"), "source_id", "left_anti").count()
    assert spark.table("fresh").count() == want and schema
