"""Queries on people, layouts, question banks and boards; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobweave.operators import crm, layout, offers, people
from jobweave.plans.cv_queries import _fold, _in, _list, _q
from jobweave.plans.offer_queries import _OFFERS, _WEIGHT, _docs
from jobweave.plans.provider_queries import WANTED, _sql
from jobweave.session import table
from jobweave.sources import providers

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


# --- who writes: messages of recruiters, and a few signatures beside them

_SIGNED = (
    "Jane Doe\nTalent Acquisition Partner\nAcme Robotics\njane@acme.example", "Cabinet de recrutement Untel\nPaul-Henri O'Neil\nhttps://www.linkedin.com/in/ph-oneil",
    "just a line of plain lower case words that goes on for long", "Head of Talent\nZoé Martin\nHays\n+33 1 00 00 00 00",
)
_MESSAGES = "(SELECT doc_id, text FROM documents WHERE kind = 'recruiter_message' AND text IS NOT NULL UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-n}::BIGINT, {_q(t)})" for n, t in enumerate(_SIGNED, 1)) + ") AS v(doc_id, text))"


def _messages(spark, d):
    return _docs(spark, d, "recruiter_message").select("doc_id", "text").unionByName(spark.createDataFrame([(-n, t) for n, t in enumerate(_SIGNED, 1)], "doc_id bigint, text string"))


_ROWS = f"(SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS xs FROM {_MESSAGES})"
_HIRES = f"regexp_matches({_fold('x')}, {_q(people.RECRUITER)})"
_WRITERS = f"""(SELECT doc_id, xs, coalesce(list_filter(xs, lambda x: regexp_matches(x, {_q(people.NAME)}) AND NOT {_HIRES})[1], xs[1]) AS name, list_filter(xs, lambda x: {_HIRES})[1] AS title,
nullif(regexp_extract(text, {_q(people.PROFILE)}), '') AS profile FROM {_ROWS})"""
_FIRMS = f"""(SELECT *, list_filter(xs, lambda x: x <> name AND NOT {_HIRES} AND NOT regexp_matches(lower(x), {_q(people.CONTACT)}) AND NOT (lower(x) = x AND length(x) > 30) AND length(x) BETWEEN 2 AND 80)[1] AS company FROM {_WRITERS})"""


@query(f"""SELECT doc_id, name, title, company, profile, CASE WHEN regexp_matches(array_to_string(list_transform(xs, lambda x: {_fold('x')}), ' '), {_q(people.AGENCY)}) THEN 'agency'
WHEN company IS NOT NULL THEN 'in_house' ELSE 'unknown' END AS kind FROM {_FIRMS}""")
def pr19_writers(spark, d):
    parts = people.writer(F.col("text"))
    return _messages(spark, d).select("doc_id", *(parts[k].alias(k) for k in ("name", "title", "company", "profile", "kind")))


_HEAD = "regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]+')"


@query(f"SELECT posting_id, list_sort(list_filter(list_distinct(list_intersect({_HEAD}, ['data', 'engineer', 'of', 'senior'])), lambda w: w NOT IN {_in(people.SMALL_WORDS)})) AS words FROM (SELECT posting_id, min(title) AS title FROM job_postings WHERE title IS NOT NULL GROUP BY posting_id)")
def u07_shared_words(spark, d):
    t = table(spark, d, "job_postings", "posting_id", "title").where("title is not null").groupBy("posting_id").agg(F.min("title").alias("title"))
    return t.select("posting_id", people.shared_words(F.lit("Senior data engineer of data"), F.col("title")).alias("words"))


_RELATION = "CASE s_suppkey % 4 WHEN 0 THEN 'friend' WHEN 1 THEN 'colleague' WHEN 2 THEN 'acquaintance' ELSE 'someone' END"


@query(f"""WITH p AS (SELECT s_suppkey, n_name AS employer, {_RELATION} AS relation, (1 + s_suppkey % 2)::INT AS hops FROM supplier JOIN nation ON s_nationkey = n_nationkey), t AS (SELECT n_name AS target FROM nation),
j AS (SELECT target, s_suppkey, employer, relation, hops, round(least(1.0, {_WEIGHT} / hops), 3) AS value FROM t JOIN p ON contains(lower(target), lower(employer)) OR contains(lower(employer), lower(target)))
SELECT target, s_suppkey, value, rank_no FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY value DESC, s_suppkey, employer, relation, hops) AS rank_no FROM j) WHERE rank_no <= 5""")
def t8_warm_paths(spark, d):
    """Suppliers stand for people one knows, nations for employers."""
    n = table(spark, d, "nation", "n_nationkey", "n_name")
    relation = F.when(F.col("s_suppkey") % 4 == 0, "friend").when(F.col("s_suppkey") % 4 == 1, "colleague").when(F.col("s_suppkey") % 4 == 2, "acquaintance").otherwise("someone")
    s = table(spark, d, "supplier", "s_suppkey", "s_nationkey").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    known = s.select("s_suppkey", F.col("n_name").alias("employer"), relation.alias("relation"), (1 + F.col("s_suppkey") % 2).cast("int").alias("hops"))
    return people.warm_paths(n.select(F.col("n_name").alias("target")), known, "target", "employer", "relation", "hops", 5).select("target", "s_suppkey", "value", "rank_no")


_CUSTOMER = "(SELECT c_custkey, nullif(CASE WHEN c_custkey % 3 > 0 THEN c_name END, '') AS n, CASE WHEN c_custkey % 5 > 0 THEN c_custkey || '@mail.example' END AS e, c_mktsegment AS c FROM customer)"


@query(f"""SELECT c_custkey, list_transform(told, lambda x: x.k) AS told, list_transform(told, lambda x: x.v) AS answers, list_filter([CASE WHEN n IS NULL THEN 'full_name' END, CASE WHEN e IS NULL THEN 'email' END,
'phone', 'linkedin', CASE WHEN c IS NULL THEN 'current_company' END, 'current_title', 'location'], lambda x: x IS NOT NULL) AS unmapped
FROM (SELECT *, list_filter([{{'k': 'full_name', 'v': n}}, {{'k': 'email', 'v': e}}, {{'k': 'current_company', 'v': c}}], lambda x: x.v IS NOT NULL) AS told FROM {_CUSTOMER})""")
def pr02_filled_form(spark, d):
    i = F.col("c_custkey")
    values = {"full_name": F.when(i % 3 > 0, F.col("c_name")), "email": F.when(i % 5 > 0, F.concat(i.cast("string"), F.lit("@mail.example"))), "current_company": F.col("c_mktsegment"), "iban": F.lit("never")}
    form = people.filled_form(values)
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment")
    return c.select("c_custkey", F.map_keys(form["fields"]).alias("told"), F.map_values(form["fields"]).alias("answers"), form["unmapped"].alias("unmapped"))


# --- layouts: the first numbers of an order's lines stand for places of words

_PAGES = "(SELECT l_orderkey, list(l_extendedprice::DOUBLE % 600) AS xs FROM lineitem GROUP BY l_orderkey)"


@query(f"""SELECT l_orderkey, CASE WHEN list_max(xs) - list_min(xs) < 600 * 0.3::DOUBLE THEN 1 WHEN len(list_filter(xs, lambda x: x BETWEEN 600 * 0.3::DOUBLE AND 600 * 0.7::DOUBLE)) = 0 THEN 2
WHEN len(list_filter(xs, lambda x: x < 600 * 0.4::DOUBLE)) >= 2 AND len(list_filter(xs, lambda x: x > 600 * 0.5::DOUBLE)) >= 2
AND list_min(list_filter(xs, lambda x: x > 600 * 0.5::DOUBLE)) - list_max(list_filter(xs, lambda x: x < 600 * 0.4::DOUBLE)) > 600 * 0.1::DOUBLE THEN 2 ELSE 1 END AS columns FROM {_PAGES}""")
def x25_columns(spark, d):
    pages = table(spark, d, "lineitem", "l_orderkey", "l_extendedprice").groupBy("l_orderkey").agg(F.collect_list(F.col("l_extendedprice").cast("double") % 600).alias("xs"))
    return pages.select("l_orderkey", layout.columns(F.col("xs"), F.lit(600.0)).alias("columns"))


@query("""SELECT l_orderkey, l_linenumber, l_discount::DOUBLE * 100 < 4 OR (1 - l_tax::DOUBLE >= 0.95 AND 1 - l_discount::DOUBLE >= 0.95) AS hidden FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem)""")
def x22_hidden(spark, d):
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_tax").distinct()
    tax, cut = F.col("l_tax").cast("double"), F.col("l_discount").cast("double")
    return rows.select("l_orderkey", "l_linenumber", layout.hidden(cut * 100, F.array(1 - tax, 1 - cut, F.lit(1.0))).alias("hidden"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS html FROM documents")
def x27_escaped(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", layout.escaped(F.col("text")).alias("html"))


@query("SELECT cv_id, CASE WHEN 90 - 5 * n >= 75 THEN 'high' WHEN 90 - 5 * n <= 50 THEN 'low' ELSE 'medium' END AS readiness FROM (SELECT cv_id, count(*) AS n FROM cv_sections GROUP BY cv_id)")
def pr14_readiness(spark, d):
    """The number of a CV's sections stands for its flags."""
    return table(spark, d, "cv_sections", "cv_id").groupBy("cv_id").agg(F.count("*").alias("n")).select("cv_id", layout.readiness(F.lit(90), F.col("n")).alias("readiness"))


# --- offers and questions

_PHRASES = ["care team", "on-call duty", "flexible hours", "machine learning"]


@query(f"""WITH b AS (SELECT doc_id, list_filter({_list(_PHRASES)}, lambda p: contains(lower(text), p)) AS held, regexp_extract_all(lower(text), '[\\p{{L}}][\\p{{L}}.#+-]{{2,}}') AS words FROM {_OFFERS}),
e AS (SELECT doc_id, held, n - 1 AS pos, words[n] AS term FROM (SELECT *, unnest(generate_series(1, len(words))) AS n FROM b)),
c AS (SELECT doc_id, term, 1 AS kind, -count(*) AS less, min(pos) AS pos FROM e WHERE term NOT IN {_in(sorted(set(offers.STOPWORDS)))} AND NOT list_contains(flatten(list_transform(held, lambda p: string_split(p, ' '))), term) GROUP BY doc_id, term
UNION ALL SELECT doc_id, held[n], 0, 0, n - 1 FROM (SELECT *, unnest(generate_series(1, len(held))) AS n FROM b))
SELECT doc_id, term, rank_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY kind, less, pos) AS rank_no FROM c) WHERE rank_no <= 20""")
def a13_requirement_terms(spark, d):
    return offers.requirement_terms(_docs(spark, d, "offer"), "doc_id", "text", _PHRASES)


@query("SELECT doc_id FROM documents WHERE lower(trim(source)) = (SELECT min(lower(trim(source))) FROM documents WHERE source <> '' AND kind = 'interview_answer') AND kind = 'interview_answer' AND text <> ''")
def f09_questions(spark, d):
    """Documents stand for a bank of questions, their source for the family of roles."""
    docs = table(spark, d, "documents", "doc_id", "source", "kind", "text")
    bank = docs.where("kind = 'interview_answer'").select("doc_id", F.col("source").alias("family"), F.lit("Case ").alias("kind"), "text")
    family = docs.where("source <> '' and kind = 'interview_answer'").agg(F.min(F.lower(F.trim("source")))).first()[0] or ""
    return offers.questions(bank, family, "CASE").select("doc_id")


_LEVELS = ["junior", "mid", "senior", "lead", "boss"]


@query(f"WITH l AS (SELECT unnest({_list(_LEVELS)}) AS x), p AS (SELECT x, CASE WHEN list_position({_list(offers.LADDER)}, x) > 0 THEN list_position({_list(offers.LADDER)}, x) - 1 ELSE 99 END AS k FROM l) SELECT a.x AS a, b.x AS b, abs(a.k - b.k)::INT AS steps FROM p a, p b")
def j05_level_distance(spark, d):
    pairs = spark.createDataFrame([(a, b) for a in _LEVELS for b in _LEVELS], "a string, b string")
    return pairs.select("a", "b", offers.level_distance(F.col("a"), F.col("b")).alias("steps"))


# --- boards

_BOARDED = ("ashby", "lever")
_WANTED = ", ".join(WANTED)
_BOARDS = "(SELECT DISTINCT source, board, upper(board) AS company FROM provider_pages WHERE source IN ('ashby', 'lever') AND board <> '')"


def _boarded_sql(name: str) -> str:
    rows = f"(SELECT DISTINCT p.page_id, p.board, b.company AS firm, payload FROM provider_pages p JOIN {_BOARDS} b USING (source, board) WHERE source = '{name}' AND payload IS NOT NULL AND json_valid(payload))"
    inner = _sql(name).replace(f"(SELECT DISTINCT page_id, payload FROM provider_pages WHERE source = '{name}' AND payload IS NOT NULL AND json_valid(payload))", rows)
    for old, new in (("(SELECT page_id, CASE WHEN json_type(payload", "(SELECT page_id, board, firm, CASE WHEN json_type(payload"), ("(SELECT page_id, n, xs[n] AS i FROM (SELECT page_id, xs,", "(SELECT page_id, board, firm, n, xs[n] AS i FROM (SELECT page_id, board, firm, xs,")):
        assert old in inner
        inner = inner.replace(old, new)
    inner = inner.replace(f"SELECT page_id, '{name}' AS source,", f"SELECT page_id, board, '{name}' AS source,", 1).replace("NULL::VARCHAR AS company", "firm AS company")
    return f"SELECT board, {', '.join(WANTED)} FROM ({inner})"


@query(f"SELECT board, {_WANTED} FROM (SELECT *, row_number() OVER (PARTITION BY source, board ORDER BY source_id, url) AS rank_no FROM ({' UNION ALL '.join(map(_boarded_sql, _BOARDED))})) WHERE rank_no <= 3")
def u02_boards(spark, d):
    """All boards with a name; the first three postings of each."""
    pages = table(spark, d, "provider_pages", "page_id", "source", "board", "payload").where(F.col("source").isin(*_BOARDED))
    listed = pages.select("source", "board", F.upper("board").alias("company")).distinct()
    return providers.fan_out(pages.dropDuplicates(["page_id", "source", "board", "payload"]), listed, 3).select("board", *WANTED)


@query("SELECT user_id, min(ts) AS first_error FROM events WHERE event_type = 'error' AND user_id IS NOT NULL GROUP BY user_id")
def t10_first_finding(spark, d):
    """Of many findings of one kind only the first counts."""
    e = table(spark, d, "events", "user_id", "event_type", "ts").where("event_type = 'error' and user_id is not null")
    return e.groupBy("user_id").agg(F.min("ts").alias("first_error"))


@query(f"SELECT n_name AS relation, {_WEIGHT.replace('relation', 'n_name')} AS weight FROM nation")
def pr24_unknown_relations(spark, d):
    return table(spark, d, "nation", "n_name").select(F.col("n_name").alias("relation"), crm.relation_weight(F.col("n_name")).alias("weight"))
