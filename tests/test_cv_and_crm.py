"""Operators on CVs, dates, flags, applications and answers: nulls, empty texts, ties, empty tables."""

import pytest
from pyspark.sql import functions as F

from jobweave.operators import answers, crm, cv, dates, flags, offers
from jobweave.plans import provider_queries
from jobweave.sources import providers

CV = """Curriculum Vitae
JANE DOE
jane.doe@example.org / +33 6 12 34 56 78

Profil :
Built things that last for twenty years. Ok.
Work experience
Acme - Cook (2001-2003)
- Led a team of 8 cooks by teaching them
\u2022 Was promoted in March
Skills
Python, Go;Rust
"""


@pytest.fixture(scope="module")
def cvs(spark):
    return spark.createDataFrame([(1, CV, 9), (2, None, 9), (3, "", 9), (4, "x" * 100_000, 9)], "cv_id bigint, raw_text string, name int")


def test_reading(cvs):
    assert [(r.no, r.line) for r in cv.highlights(cvs, "cv_id", "raw_text").orderBy("no").collect()] == [(0, "Acme - Cook (2001-2003)"), (1, "Led a team of 8 cooks by teaching them"), (2, "Was promoted in March")]
    assert [r.skill for r in cv.skills(cvs, "cv_id", "raw_text").orderBy("no").collect()] == ["Python", "Go", "Rust"]
    rows = {r.cv_id: r for r in cv.parsed(cvs, "cv_id", "raw_text").collect()}
    assert set(rows) == {1, 3, 4} and (rows[1].email, rows[1].phone, rows[1].sections) == ("jane.doe@example.org", "+33 6 12 34 56 78", ["experience", "skills", "summary"])
    assert rows[1].name == "JANE DOE" and rows[3].warnings == ["scanned_or_empty"] and rows[3].confidence == 0 and rows[4].sections == []
    assert cv.parsed(cvs.limit(0), "cv_id", "raw_text").count() == 0
    best = cv.best_evidence(cv.evidence(cvs, "cv_id", "raw_text"), "cv_id", ["Python", "cooks", "team"], 2)
    assert [(r.origin, r.shared) for r in best.orderBy("rank_no").collect()] == [("highlight", 2), ("skill", 1)]


def test_lines(spark):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(["Reduced costs by 20 % using Python", "Responsible for the canteen", "Mis en place un outil", "", "Certified welder", "Managed a team of 12"])], "i int, line string")
    made = {r.i: r for r in df.select("i", *(c.alias(k) for k, c in cv.achievement(F.col("line")).items())).collect()}
    assert (made[0].verb, made[0].weak, made[0].object, made[0].way, made[0].measured) == ("reduced", False, "costs", "20 % using Python", True)
    assert (made[1].verb, made[1].weak) == ("responsible", True) and made[2].verb == "mis en place" and not made[2].weak and made[3].verb is None
    assert [r.c for r in df.select("i", cv.claim(F.col("line")).alias("c")).orderBy("i").collect()] == ["metric", None, None, None, "certification", "leadership"]


def test_dates(spark):
    df = spark.createDataFrame([(t,) for t in ("2020-03", "2019", "5/2018", "Juin 2017", None, "x")], "t string")
    assert [r.m for r in df.select(dates.year_month(F.col("t")).alias("m")).collect()] == [202003, 201900, 201805, 201707, None, None]
    got = spark.range(1).select(dates.months_between(F.lit(201900), F.lit(202003)), dates.shown_range(F.lit("2020-03"), F.lit("ongoing"), "Mon YYYY"), dates.shown(F.lit("2019"), "MM/YYYY")).first()
    assert tuple(got) == (9, "Mar 2020 – Present", "2019")


def test_flags(spark, cvs):
    assert [r.no for r in cv.highlights(cvs, "cv_id", "raw_text").where(flags.passive(F.col("line"))).collect()] == [2]
    told = cvs.where("raw_text is not null").withColumn("photo", F.lit(True))
    got = {(r.cv_id, r.market, r.flag) for r in flags.market_flags(told, "cv_id", "raw_text", "photo", flags.markets(spark)).collect()}
    assert (1, "us", "wrong_photo_market") in got and (1, "fr", "wrong_photo_market") not in got and (4, "fr", "length_violation") in got
    work = spark.createDataFrame([(1, 200000, 200103), (1, 200201, 200206), (1, 200301, 200303), (1, 200304, 200306), (2, None, 200001), (3, 200001, None)], "cv_id int, start int, end int")
    assert {tuple(r) for r in flags.employment_gaps(work, "cv_id").collect()} == {(1, 200103, 200201, 10), (1, 200206, 200301, 7)}
    assert {tuple(r) for r in flags.job_hopping(work, "cv_id").collect()} == {(1, 4)}
    assert flags.roll_up({"passive_voice": work.limit(0).select("cv_id")}, "cv_id").count() == 0
    score = flags.readability(
        spark.createDataFrame([(1, "Jan 2020, ongoing", 1, 2, True, True, True, 3.0)], "id int, text string, pages int, columns int, has_tables boolean, header_contact boolean, is_pdf boolean, mb double"), flags.systems(spark), "id"
    )
    one = {r.system: r for r in score.collect()}
    assert one["workday"].score == 0 and one["workday"].faults == ["two_column", "table", "header_contact", "scanned", "oversized", "bad_dates"] and one["lever"].lost == ["contact", "secondary_column_content"]


def test_applications(spark):
    apps = lambda *s: spark.createDataFrame([(x,) for x in s], "stage string")
    rows = {r.step: r for r in crm.funnel(apps("applied", "applied", "screen", "offer")).collect()}
    assert rows["applied_to_screen"].rate == 0.5 and rows["interview_to_offer"].rate is None and rows["interview_to_offer"].vs_usual is None
    # Ties go to the first step: both lose all.
    assert [r.step for r in rows.values() if r.bottleneck] == ["screen_to_interview"] and crm.funnel(apps()).count() == 0
    targets = spark.createDataFrame([("Lead",), ("x",)], "t string")
    stories = spark.createDataFrame([(["leadership", ""],), (None,)], "c array<string>")
    part = lambda p: {tuple(r) for r in crm.story_coverage(stories, "c", targets, "t", p).collect()}
    assert part(False) == {("Lead", False), ("x", False)} and part(True) == {("Lead", True), ("x", False)}
    assert tuple(crm.coverage_share(crm.story_coverage(stories, "c", targets.limit(0), "t")).first()) == (0, 0, 1.0)
    events = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (None, "z", 1)], "k int, stage string, at int")
    assert [(r.k, r.steps, r.current_step, r.history) for r in crm.stage_history(events, "k", "stage", "at").collect()] == [(1, 3, "b", ["a", "b"])]
    assert spark.range(1).select(crm.guessed_address(F.lit(" Zoé  de la Tour "), F.lit("@A.org")), crm.relation_weight(F.lit("")), crm.relation_weight(F.lit("stranger"))).first()[:] == ("zoe.tour@a.org", 1.0, 0.2)


def test_answers(spark):
    text = "At the time my goal was growth. I built a tool with the team, we reduced costs by 20%. As a result sales doubled."
    got = spark.createDataFrame([(text,), ("",)], "t string").select(*(c.alias(k) for k, c in answers.judged(F.col("t")).items())).collect()
    assert got[0].has_star and got[0].quantified and got[0].balance == 1.0 and got[0].band == "high" and (got[1].words, got[1].band) == (0, "low")


def test_offers(spark):
    df = spark.createDataFrame([(1, "\n Data engineer confirmé\n- Python, 5+ years of experience\nKubernetes, Kafka and kafka", 2), (2, None, 2), (3, "3 ans", 2)], "i int, text string, term int")
    assert [(r.t, r.l) for r in df.select(offers.title(F.col("text")).alias("t"), offers.level(F.col("text")).alias("l")).collect()] == [("Data engineer confirmé", "confirmé"), (None, None), ("3 ans", "3+ years")]
    assert {(r.i, r.skill) for r in offers.hard_requirements(df, "i", "text").collect()} == {(1, "Python"), (3, None)}
    assert [r.term for r in offers.tool_terms(df, "i", "text").where("i = 1").orderBy("rank_no").collect()][:2] == ["data", "kafka"]
    assert [r.n for r in df.select(offers.frequency(F.lit("Kafka"), F.col("text")).alias("n")).collect()] == [2, None, 0]


def test_board_names_the_employer(spark):
    pages = spark.createDataFrame([(p, "Board Co") for p in provider_queries._payloads("smartrecruiters")], "payload string, board string")
    assert [r.company for r in providers.normalise(pages, "smartrecruiters", company=F.col("board")).orderBy("source_id").collect()] == ["Own", "Board Co"]
    with pytest.raises(ValueError):
        providers.search_all({"nobody": pages})
    assert providers.search_all({"smartrecruiters": pages}, per_source=1).count() == 1


def test_people(spark):
    from jobweave.operators import people

    df = spark.createDataFrame([("Jane Doe\nTalent Acquisition Partner\nAcme\njane@acme.example\nhttps://linkedin.com/in/jd",), ("",), (None,)], "t string")
    got = df.select(*(c.alias(k) for k, c in people.writer(F.col("t")).items())).collect()
    assert got[0][:] == ("Jane Doe", "Talent Acquisition Partner", "Acme", "in_house", "https://linkedin.com/in/jd") and got[1].kind == "unknown" and got[1].name is None
    known = spark.createDataFrame([(1, "Acme Ltd", "friend", 2), (2, "ACME", "mentor", 1), (3, None, "friend", 1), (4, "", "friend", 1)], "i int, employer string, relation string, hops int")
    paths = people.warm_paths(spark.createDataFrame([("acme",), (None,)], "target string"), known, "target", "employer", "relation", "hops")
    assert [(r.i, r.value) for r in paths.orderBy("rank_no").collect()] == [(2, 0.95), (1, 0.5)]
    form = people.filled_form({"email": F.lit(" "), "full_name": F.lit("X"), "password": F.lit("p")})
    row = spark.range(1).select(form["fields"].alias("f"), form["unmapped"].alias("u")).first()
    assert row.f == {"full_name": "X"} and row.u == [k for k in people.FORM if k != "full_name"]


def test_layout(spark):
    from jobweave.operators import layout

    pages = [[10.0, 20.0], [10.0, 12.0, 590.0], [10.0, 20.0, 400.0, 410.0, 300.0], [], None]
    df = spark.createDataFrame([(p,) for p in pages], "xs array<double>")
    assert [r.c for r in df.select(layout.columns(F.col("xs"), F.lit(600.0)).alias("c")).collect()] == [1, 2, 2, 1, 1]
    chars = spark.createDataFrame([(3.0, None), (10.0, [1.0]), (10.0, [1.0, 0.2, 1.0]), (10.0, [0.0, 0.0, 0.0, 0.0]), (None, None), (10.0, [])], "size double, colour array<double>")
    assert [r.h for r in chars.select(layout.hidden(F.col("size"), F.col("colour")).alias("h")).collect()] == [True, True, False, True, False, False]


def test_files(spark, tmp_path):
    import zipfile

    from jobweave.sources import files, sinks

    (tmp_path / "a.txt").write_bytes("é".encode() + b"\xff")
    (tmp_path / "b.pdf").write_bytes(b"x")
    (tmp_path / "c.docx").write_bytes(b"no zip")
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr></w:tbl></w:body></w:document>")
    got = {r.path[-6:]: (r.text, bool(r.fault)) for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"/a.txt": ("é�", False), "/b.pdf": (None, True), "c.docx": (None, True), "d.docx": ("One\na\tb", False)}
    assert sinks.within("/r", "a/../b") == "/r/b" and sinks.within("/r", "/x") == "/x"
    with pytest.raises(ValueError):
        sinks.within("/r", "../x")
    sinks.store_people(spark.createDataFrame([("x",)], "name string"), str(tmp_path / "p"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).collect()] == [("x", True, 3)]
    sinks.queue(spark.createDataFrame([(1,), (2,)], "job_id int"), str(tmp_path / "q"))
    sinks.queue(spark.createDataFrame([(1, "sent")], "job_id int, status string"), str(tmp_path / "q"))
    assert {(r.job_id, r.status) for r in sinks.current(spark, str(tmp_path / "q"), "job_id").collect()} == {(1, "sent"), (2, "prepared")}
