"""Matching of many stated CVs: the same rows as one by one, and no pair of an offer and a CV is moved."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from jobweave.operators import match

WORDS = ["python", "go", "k8s", "kubernetes", "kafka", "rust", "ml", "machine learning", "node.js", "we", "lead the team", "sql."]


@pytest.fixture(scope="module")
def sides(spark):
    """150 CVs, so three blocks of them, one of them empty, and 12 offers; some offers and CVs have a level."""
    rnd = random.Random(5)
    some = lambda n: rnd.sample(WORDS, rnd.randint(1, n))
    offers = [(k, f"{rnd.choice(['Senior', 'Junior', 'A'])} dev\nRequirements:\n" + "\n".join(some(10)) + "\nNice to have\n" + "\n".join(some(4))) for k in range(12)]
    cvs = [(100 * k, rnd.choice(["senior ", ""]) + ", ".join(some(6)).replace("node.js", "node js").replace("sql.", "sql")) for k in range(149)] + [(99_999, "")]
    offers, cvs = spark.createDataFrame(offers, "offer bigint, text string"), spark.createDataFrame(cvs, "cv bigint, text string")
    aliases = match.synonyms(spark)
    offered = match.terms_of(cvs, "cv", "text").unionByName(match.phrases_of(cvs, "cv", "text", aliases)).distinct()
    return offers, cvs, match.requirements(offers, "offer", "text"), offered, aliases


@pytest.fixture(scope="module")
def one_by_one(sides):
    """``cv, term, tier`` by loops."""
    _, _, wanted, offered, aliases = sides
    names = {r.alias: r.canonical for r in aliases.collect()}
    held: dict = {}
    for r in offered.collect():
        held.setdefault(r.cv, set()).add(r.term)
    rows = set()
    for term in {r.term for r in wanted.collect()}:
        parts = {term, *re.split(r"\s+", term)}
        for cv, words in held.items():
            if parts & words:
                rows.add((cv, term, "exact"))
            elif {names.get(p, p) for p in parts} & {names.get(w, w) for w in words}:
                rows.add((cv, term, "alias"))
    return rows


def moved(spark, small, name):
    """Keys by which the plan of a query moves rows."""
    plan = entry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    return {tuple(re.findall(r"(\w+)#", x)) for x in re.findall(r"hashpartitioning\(([^)]*)\)", plan)}


def test_scores(spark, small, sides, one_by_one):
    offers, cvs, wanted, offered, aliases = sides
    level = match.level_rank(F.col("text")).alias("level")
    o, c = offers.select("offer", level), cvs.select("cv", level)
    found = spark.createDataFrame(sorted(one_by_one), "cv bigint, term string, tier string")
    want = sorted(map(tuple, match.all_scores(wanted, found, o, c, "offer", "cv").collect()))
    got = sorted(map(tuple, match.match_scores(wanted, offered, aliases, o, c, "offer", "cv").collect()))
    assert len({r[0] for r in want}) > 2 * match.BITS and got == want
    assert not [k for k in moved(spark, small, "a06_match_score") if {"cv", "doc_id"} <= {*k}]


def test_coverage(spark, small, sides, one_by_one):
    _, _, wanted, offered, aliases = sides
    got = [tuple(r) for r in match.covered_terms(wanted, offered, aliases, "cv", fuzzy=False).collect()]
    assert len(got) == len({*got}) and {*got} == one_by_one
    # The last thing done is making CVs of bits; rows of CVs and terms aren't grouped again.
    plan = entry.queries()["j01_coverage"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"\b(Exchange|HashAggregate|\w*Join)\b", plan)[1].endswith("Join")


def test_level_fit_is_spread(spark):
    """Offers that come in one part meet the CVs in many."""
    offers, cvs = (spark.createDataFrame([(k, k % 3 if k % 4 else None) for k in range(n)], f"{key} bigint, level int").coalesce(1) for n, key in ((40, "offer"), (5, "cv")))
    fit = match.level_fit(offers, cvs, "offer", "cv")
    assert fit.count() == 200 and fit.where("fit = 'unknown'").count() == 40 * 5 - 30 * 3
    assert fit.rdd.getNumPartitions() > 4


def test_gaps(spark, small, sides, one_by_one):
    offers, cvs, wanted, offered, aliases = sides
    found = spark.createDataFrame(sorted(one_by_one), "cv bigint, term string, tier string")
    want = sorted(map(tuple, match.keyword_gaps(wanted, found, offers, cvs, "offer", "cv", "text").collect()))
    got = sorted(map(tuple, match.stated_gaps(wanted, offered, aliases, offers, cvs, "offer", "cv", "text").collect()))
    assert got == want and {r[6] for r in want} == {"addable", "missing"}
    assert not [k for k in moved(spark, small, "t2_keyword_gaps") if {"cv", "doc_id"} <= {*k}]


def test_spellings_are_bits_too(spark, small):
    plan = entry.queries()["j01_with_spellings"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"\b(Exchange|HashAggregate|\w*Join)\b", plan)[1].endswith("Join")


@pytest.fixture
def unhinted(spark):
    """Joins broadcast what the code says and nothing else, as with tables too large for the optimizer's own broadcasts."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_long_words_move_nothing(spark, unhinted):
    """Requirements aren't moved once for each pair of letters, however long the CVs' words are; the rows are those of all pairs."""
    rnd = random.Random(7)
    words = ["a" * 300, "terraform", "postgresql", "machine learning", "no", "x", "𐐨𐐩𐐪𐐫𐐬𐐭𐐮𐐯", *("".join(rnd.choice("abc-") for _ in range(rnd.randint(3, 80))) for _ in range(25))]
    typo = lambda w: "".join(c * rnd.choice([1] * 18 + [0, 2]) for c in w)
    asks = sorted({*words, *(typo(w) for w in words for _ in range(6)), "learning machine", "learn a machine", "y", *(" ".join(["aaa", "of the"] * k) for k in range(30, 60))} - {""})
    near = match.spellings(spark.createDataFrame([(x,) for x in asks], "term string"), spark.createDataFrame([(y,) for y in words], "term string"))
    plan = near._jdf.queryExecution().executedPlan().toString()
    alike = lambda x, y: min(len(x), len(y)) > 1 and 2 * match.common_length(x, y) / (len(x) + len(y)) >= match.SPELLING - 1e-9
    want = sorted((x, y) for x in asks for y in words if alike(" ".join(sorted(x.split())), y))
    assert sorted(map(tuple, near.collect())) == want and len(want) > 2 * len(words)
    assert not re.search(r"hashpartitioning\([^)]*pair#", plan)


def test_requirements_are_shuffled_once(spark, sides, unhinted):
    """Spellings are sought among the terms that are shuffled anyway."""
    _, _, wanted, offered, aliases = sides
    found = match.covered_terms(wanted, offered, aliases, "cv")
    assert {r.tier for r in found.collect()} >= {"exact", "alias"}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len([x for x in plan.split("\n") if "REPARTITION_BY_NUM" in x and "hashpartitioning(term#" in x and "Reused" not in x]) == 1
