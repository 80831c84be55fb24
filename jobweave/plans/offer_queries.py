"""Queries on offers, matching, applications, answers and form fields; each with its SQL.

Matching is a search: the CVs whose id is divisible by 100 are the stated
queries, and all offers meet them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from jobweave.operators import answers, crm, market, match, offers, texts
from jobweave.plans.cv_queries import _fold, _in, _list, _q
from jobweave.plans.reference_queries import _LATEST, _WANTED
from jobweave.session import checkpoint, table

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


def _docs(spark, d, kind: str):
    return table(spark, d, "documents", "doc_id", "kind", "text").where((F.col("kind") == kind) & F.col("text").isNotNull())


_OFFERS = "(SELECT doc_id, text FROM documents WHERE kind = 'offer' AND text IS NOT NULL)"
_STATED = "(SELECT doc_id AS cv, text FROM documents WHERE kind = 'resume' AND text IS NOT NULL AND doc_id % 100 = 0)"


def _stated(spark, d):
    return _docs(spark, d, "resume").where("doc_id % 100 = 0").withColumnRenamed("doc_id", "cv")


# --- offers

_WORD = f"regexp_extract({_fold('text')}, {_q(offers.LEVEL)}, 1)"
_YEARS = f"regexp_extract({_fold('text')}, {_q(offers.YEARS)}, 1)"
_LEVEL = f"CASE WHEN {_WORD} = 'stage' THEN 'stagiaire' WHEN {_WORD} = 'confirme' THEN 'confirmé' WHEN {_WORD} <> '' THEN {_WORD} WHEN {_YEARS} <> '' THEN {_YEARS} || '+ years' END"
_TITLE = "list_filter(list_transform(regexp_split_to_array(text, '\\r\\n|\\r|\\n'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')[1]"


@query(f"SELECT doc_id, {_TITLE} AS title, {_LEVEL} AS level FROM {_OFFERS}")
def x10_offer_head(spark, d):
    return _docs(spark, d, "offer").select("doc_id", offers.title(F.col("text")).alias("title"), offers.level(F.col("text")).alias("level"))


_OFFER_LINES = f"""(SELECT doc_id, n - 1 AS line_no, trim(regexp_replace(xs[n], '\\s+', ' ', 'g')) AS line FROM
(SELECT doc_id, xs, unnest(generate_series(1, len(xs))) AS n FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS xs FROM {_OFFERS})))"""
_BEFORE = f"trim(ltrim(rtrim(rtrim(left(line, strpos({_fold('line')}, regexp_extract({_fold('line')}, {_q(offers.YEARS)})) - 1)), ','), '-*•◦·▸▹–— '))"


@query(f"""SELECT doc_id, line_no, line, CASE WHEN skill <> '' AND length(skill) < {offers.SKILL_CHARS} THEN skill END AS skill FROM
(SELECT doc_id, line_no, line, {_BEFORE} AS skill FROM {_OFFER_LINES} WHERE regexp_matches({_fold('line')}, {_q(offers.YEARS)}))""")
def f15_hard_requirements(spark, d):
    return offers.hard_requirements(_docs(spark, d, "offer"), "doc_id", "text")


@query(f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}][\\p{{L}}\\p{{N}}+#]+')) AS word FROM {_OFFERS}),
c AS (SELECT doc_id, lower(word) AS term, count(*) AS n, bool_or(regexp_matches(word, '^[A-Z]') AND word NOT IN {_in(offers.PLAIN_WORDS)}) AS named FROM w
  WHERE length(lower(word)) > 2 AND lower(word) NOT IN {_in(sorted(set(offers.STOPWORDS)))} GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM c),
s AS (SELECT doc_id, term, n, round(least(1.0, n / total::DOUBLE * (ln((total + 1) / (n + 1)::DOUBLE) + 1) * 10), 6) AS salience FROM t WHERE named OR term IN {_in(offers.TOOLS)})
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY salience DESC, term) AS rank_no FROM s) WHERE rank_no <= {offers.MOST_TERMS}""")
def t3_tool_terms(spark, d):
    return offers.tool_terms(_docs(spark, d, "offer"), "doc_id", "text")


def _spaced(x: str) -> str:
    return f"(' ' || array_to_string(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}+#]+'), '  ') || ' ')"


def _frequency(term: str, text: str) -> str:
    return f"CASE WHEN {_spaced(term)} = '  ' THEN 0 ELSE (length({_spaced(text)}) - length(replace({_spaced(text)}, {_spaced(term)}, ''))) // length({_spaced(term)}) END"


@query(f"SELECT doc_id, kind, term, {_frequency('term', 'text')} AS n FROM {_WANTED} JOIN {_OFFERS} USING (doc_id)")
def a17_term_frequency(spark, d):
    o = _docs(spark, d, "offer").select("doc_id", "text")
    return match.requirements(o, "doc_id", "text").join(o, "doc_id").select("doc_id", "kind", "term", offers.frequency(F.col("term"), F.col("text")).alias("n"))


# --- matching

_NAMES = "(VALUES " + ", ".join(f"({_q(a)}, {_q(k)})" for k, v in match.SYNONYMS.items() for a in v.split("|")) + ") AS y(alias, canonical)"


@query(f"""WITH t AS (SELECT DISTINCT term FROM {_WANTED}), c AS (SELECT term, coalesce(canonical, term) AS c FROM t LEFT JOIN (SELECT * FROM {_NAMES}) n ON n.alias = term)
SELECT DISTINCT term, coalesce(name, c) AS name FROM c LEFT JOIN (SELECT canonical, alias AS name FROM {_NAMES} UNION SELECT canonical, canonical FROM {_NAMES}) n ON n.canonical = c""")
def j09_expanded_terms(spark, d):
    wanted = match.requirements(_docs(spark, d, "offer"), "doc_id", "text").select("term").distinct()
    return match.expanded(wanted, match.synonyms(spark))


_SAID = f"(SELECT cv, unnest(regexp_extract_all(lower(text), '\\.?[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}+#.-]*')) AS w FROM {_STATED})"
_PHRASES = sorted({n for k, v in match.SYNONYMS.items() for n in (k, *v.split("|")) if " " in n})
_WORDS_OF = "(' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}+#/.-]*[\\p{L}\\p{N}+#]'), ' ') || ' ')"
_HELD = f"(SELECT DISTINCT cv, rtrim(w, '.') AS term FROM {_SAID} WHERE rtrim(w, '.') <> '' UNION SELECT DISTINCT cv, unnest(list_filter({_list(_PHRASES)}, lambda p: contains({_WORDS_OF}, ' ' || p || ' '))) FROM {_STATED})"
_CANON = "(SELECT DISTINCT {0}, coalesce(canonical, term) AS term FROM {1} LEFT JOIN (SELECT * FROM " + _NAMES + ") n ON n.alias = term)"
_PARTS = f"(SELECT asked, unnest(list_distinct(list_append(regexp_split_to_array(asked, '\\s+'), asked))) AS term FROM (SELECT DISTINCT term AS asked FROM {_WANTED}))"
_COVERED = f"""(SELECT cv, term, CASE min(tier) WHEN 0 THEN 'exact' ELSE 'alias' END AS tier FROM (SELECT cv, asked AS term, 0 AS tier FROM {_PARTS} p JOIN {_HELD} h USING (term)
UNION ALL SELECT cv, asked, 1 FROM {_CANON.format('asked', _PARTS)} p JOIN {_CANON.format('cv', _HELD)} h USING (term)) GROUP BY cv, term)"""


def _sides(spark, d):
    """Offers, stated CVs, terms of the offers, terms of the CVs and names of terms."""
    o, cvs, aliases = _docs(spark, d, "offer"), checkpoint(_stated(spark, d)), match.synonyms(spark)
    offered = match.terms_of(cvs, "cv", "text").unionByName(match.phrases_of(cvs, "cv", "text", aliases)).distinct()
    return o, cvs, match.requirements(o, "doc_id", "text"), offered, aliases


@query(f"SELECT * FROM {_HELD}")
def a07_candidate_terms(spark, d):
    cvs, aliases = _stated(spark, d), match.synonyms(spark)
    return match.terms_of(cvs, "cv", "text").unionByName(match.phrases_of(cvs, "cv", "text", aliases)).distinct()


@query(f"SELECT * FROM {_COVERED}")
def j01_coverage(spark, d):
    """Terms of all offers that the stated CVs cover, exactly or by another name."""
    return match.covered_terms(*_sides(spark, d)[2:], "cv", fuzzy=False)


@query()
def j01_with_spellings(spark, d):
    """The same, other spellings included; they have no SQL."""
    return match.covered_terms(*_sides(spark, d)[2:], "cv")


def _rank(x: str) -> str:
    return f"CASE regexp_extract({_fold(x)}, '\\b(junior|senior|lead|principal|stagiaire|stage|confirme)\\b', 1) WHEN 'stagiaire' THEN 0 WHEN 'stage' THEN 0 WHEN 'junior' THEN 1 WHEN 'confirme' THEN 2 WHEN 'senior' THEN 3 WHEN 'lead' THEN 4 WHEN 'principal' THEN 5 END"


@query(f"""WITH w AS (SELECT * FROM {_WANTED}), t AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'must') AS musts, count(*) FILTER (WHERE kind = 'nice') AS nices FROM w GROUP BY doc_id),
g AS (SELECT cv, doc_id, count(*) FILTER (WHERE kind = 'must') AS must, count(*) FILTER (WHERE kind = 'nice') AS nice FROM w JOIN {_COVERED} c USING (term) GROUP BY cv, doc_id),
r AS (SELECT g.*, musts, nices, {_rank('o.text')} AS ol, {_rank('s.text')} AS cl FROM g JOIN t USING (doc_id) JOIN {_OFFERS} o USING (doc_id) JOIN {_STATED} s USING (cv))
SELECT cv, doc_id, round(100 * (0.75 * CASE WHEN musts > 0 THEN must / musts ELSE 0 END + 0.25 * CASE WHEN nices > 0 THEN nice / nices ELSE 0 END) * CASE WHEN ol <> cl THEN 0.9 ELSE 1.0 END, 2) AS score,
musts - must AS missing_must FROM r""")
def a06_match_score(spark, d):
    """All offers against the stated CVs; pairs that cover nothing score 0 and have no row."""
    o, cvs, wanted, offered, aliases = _sides(spark, d)
    rank = match.level_rank(F.col("text")).alias("level")
    return match.match_scores(wanted, offered, aliases, o.select("doc_id", rank), cvs.select("cv", rank), "doc_id", "cv")


@query(f"""SELECT doc_id, cv, CASE WHEN ol IS NULL OR cl IS NULL THEN 'unknown' WHEN ol = cl THEN 'match' WHEN cl < ol THEN 'under' ELSE 'over' END AS fit
FROM (SELECT doc_id, cv, {_rank('o.text')} AS ol, {_rank('s.text')} AS cl FROM {_OFFERS} o, {_STATED} s)""")
def x12_level_fit(spark, d):
    """How the level of the stated CVs fits that of each offer."""
    rank = match.level_rank(F.col("text")).alias("level")
    return match.level_fit(_docs(spark, d, "offer").select("doc_id", rank), _stated(spark, d).select("cv", rank), "doc_id", "cv")


_TOTAL = "len(regexp_extract_all(lower(text), '\\p{L}[\\p{L}\\p{N}]{2,}'))"


@query(f"""WITH w AS (SELECT doc_id, kind, term, {_frequency('term', 'text')} AS n, {_TOTAL} AS total FROM {_WANTED} JOIN {_OFFERS} USING (doc_id)),
s AS (SELECT doc_id, kind, term, n, round(least(1.0, n / greatest(total, 1)::DOUBLE * (ln((total + 1) / (n + 1)::DOUBLE) + 1) * 10), 6) AS salience FROM w),
p AS (SELECT s.*, cv, text FROM s, {_STATED} c WHERE NOT EXISTS (SELECT 1 FROM {_COVERED} k WHERE k.cv = c.cv AND k.term = s.term))
SELECT cv, doc_id, term, kind, n, salience, CASE WHEN {_frequency('term', 'text')} > 0 THEN 'addable' ELSE 'missing' END AS status, rank_no FROM
(SELECT *, row_number() OVER (PARTITION BY cv, doc_id ORDER BY kind, n DESC, salience DESC, term) AS rank_no FROM p) WHERE rank_no <= 5""")
def t2_keyword_gaps(spark, d):
    o, cvs, wanted, offered, aliases = _sides(spark, d)
    return match.stated_gaps(wanted, offered, aliases, o, cvs, "doc_id", "cv", "text")


@query()
def x09_title_ratio(spark, d):
    """New postings against the history's of equal key and near date: how alike their titles are as typed. Exact tests stand in tests/."""
    def side(name: str, i: str):
        key = market.blocking_key(F.col("company"), F.col("location"), F.col("title")).alias("k")
        return table(spark, d, name).select(F.col("posting_id").alias(i), F.col("title").alias(f"{i}_title"), key, market.iso_date(F.col("date_posted")).alias(f"{i}_dt")).distinct()

    pairs = side("job_postings", "a").join(side("monitor_new_jobs", "b"), "k").where(market.within_band(F.col("a_dt"), F.col("b_dt")))
    return pairs.select("a", "b", F.round(match.token_set_ratio(F.col("a_title"), F.col("b_title")), 4).alias("ratio"))


# --- applications: orders of the star schema stand for them, events for their stages

_STAGE = {"view": "applied", "click": "screen", "signup": "interview", "purchase": "offer", "error": "accepted"}
_STAGED = "CASE event_type " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in _STAGE.items()) + " ELSE 'other' END"


def _staged(spark, d):
    names = F.create_map(*(F.lit(x) for kv in _STAGE.items() for x in kv))
    e = table(spark, d, "events", "user_id", "event_type", "ts")
    return e.withColumn("stage", F.coalesce(F.try_element_at(names, F.col("event_type")), F.lit("other")))


_STEPS = "(VALUES " + ", ".join(f"({k}, {_q(a)}, {_q(b)}, {u}::DOUBLE)" for k, (a, b, u) in enumerate(crm.STEPS)) + ") AS s(step_no, a, b, usual)"


@query(f"""WITH e AS (SELECT {_STAGED} AS stage FROM events), c AS (SELECT stage, count(*) AS n FROM e GROUP BY stage),
r AS (SELECT step_no, a || '_to_' || b AS step, coalesce(x.n, 0) AS from_n, coalesce(y.n, 0) AS to_n, usual FROM {_STEPS} LEFT JOIN c x ON x.stage = a LEFT JOIN c y ON y.stage = b),
q AS (SELECT *, CASE WHEN from_n > 0 THEN to_n / from_n WHEN to_n = 0 THEN 0.0 END AS rate FROM r)
SELECT step_no, step, from_n, to_n, round(rate, 6) AS rate, CASE WHEN rate > usual * 1.05 THEN 'above' WHEN rate < usual * 0.95 THEN 'below' WHEN rate IS NOT NULL THEN 'at' END AS vs_usual,
from_n > 0 AND row_number() OVER (ORDER BY CASE WHEN from_n > 0 THEN 1 - rate END DESC NULLS LAST, step_no) = 1 AS bottleneck FROM q""")
def a01_funnel(spark, d):
    return crm.funnel(_staged(spark, d))


_ORDER_STAGE = "CASE o_orderstatus WHEN 'F' THEN 'offer' WHEN 'P' THEN 'interview' ELSE 'applied' END"


@query(f"""SELECT coalesce(nullif(c_mktsegment, ''), 'unknown') AS channel, count(*) AS n, round(avg((s IN {_in(crm.INTERVIEWED)})::INT), 4) AS interview_share, round(avg((s IN {_in(crm.OFFERED)})::INT), 4) AS offer_share
FROM (SELECT c_mktsegment, {_ORDER_STAGE} AS s FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1""")
def a02_channel_shares(spark, d):
    o = table(spark, d, "orders", "o_custkey", "o_orderstatus").join(table(spark, d, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    stage = F.when(F.col("o_orderstatus") == "F", "offer").when(F.col("o_orderstatus") == "P", "interview").otherwise("applied")
    return crm.channel_shares(o.withColumn("stage", stage), "c_mktsegment")


@query(f"""WITH e AS (SELECT user_id, {_STAGED} AS stage, ts, lag({_STAGED}) OVER (PARTITION BY user_id ORDER BY ts, {_STAGED}) AS before FROM events WHERE user_id IS NOT NULL)
SELECT user_id, count(*) AS steps, arg_max(stage, (ts, stage)) AS current_step, min(ts) AS first_at, max(ts) AS last_at,
coalesce(list(stage ORDER BY ts, stage) FILTER (WHERE before IS NULL OR before <> stage), []) AS history FROM e GROUP BY user_id""")
def w06_stage_history(spark, d):
    return crm.stage_history(_staged(spark, d), "user_id", "stage", "ts")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P'")
def s29_listed(spark, d):
    return crm.listed(table(spark, d, "orders", "o_orderkey", "o_orderdate", "o_orderstatus"), "o_orderdate", "o_orderkey", "P", "o_orderstatus").select("o_orderkey", "o_orderdate")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey = 7")
def s28_one(spark, d):
    return crm.one(table(spark, d, "customer", "c_custkey", "c_mktsegment"), "c_custkey", 7)


_TARGETS = ["Python", "kotlin", "Data", "java", "Nothing like it"]
_TAGS = "(SELECT DISTINCT lower(unnest(tags)) AS c FROM job_postings)"
_WANTED_TAGS = "(SELECT unnest(" + _list(_TARGETS) + ") AS target)"


def _targets(spark):
    return spark.createDataFrame([(t,) for t in _TARGETS], "target string")


@query(f"SELECT target, EXISTS (SELECT 1 FROM {_TAGS} t WHERE t.c = lower(target)) AS covered FROM {_WANTED_TAGS}")
def j07_story_coverage(spark, d):
    """Tags of postings stand for the competencies of stories."""
    return crm.story_coverage(table(spark, d, "job_postings", "tags"), "tags", _targets(spark), "target")


@query(f"SELECT target, EXISTS (SELECT 1 FROM {_TAGS} t WHERE t.c <> '' AND (contains(trim(t.c), lower(target)) OR contains(lower(target), trim(t.c)))) AS covered FROM {_WANTED_TAGS}")
def j06_partly_covered(spark, d):
    return crm.story_coverage(table(spark, d, "job_postings", "tags"), "tags", _targets(spark), "target", partly=True)


@query(f"SELECT count(*) AS targets, sum(covered::INT)::BIGINT AS covered, round(avg(covered::INT), 4) AS share FROM ({ORACLE['j07_story_coverage']})")
def j07_coverage_share(spark, d):
    return crm.coverage_share(j07_story_coverage(spark, d))


@query("SELECT posting_id FROM job_postings WHERE len(list_filter(tags, lambda c: contains(lower(c), 'python'))) > 0")
def f10_stories_for(spark, d):
    return crm.stories_for(table(spark, d, "job_postings", "posting_id", "tags"), "tags", "Python").select("posting_id")


_WARN = "CASE WHEN {0} > 0 THEN '{1} missing: ' || {0} END"


@query(f"""SELECT batch_no, n, sources, first_at, last_at, list_filter([{_WARN.format('c', 'company')}, {_WARN.format('l', 'location')}], lambda x: x IS NOT NULL) AS warnings FROM
(SELECT batch_no, count(*) AS n, count(DISTINCT source) AS sources, min(detected_at) AS first_at, max(detected_at) AS last_at, count(*) FILTER (WHERE company IS NULL) AS c,
count(*) FILTER (WHERE location IS NULL) AS l FROM monitor_new_jobs GROUP BY batch_no)""")
def a18_batch_envelope(spark, d):
    return crm.envelope(table(spark, d, "monitor_new_jobs"), "batch_no", "source", "detected_at", "company", "location")


_SAID_RELATIONS = ["Friend", "former colleague at Acme", "LinkedIn connection", "amie", "coll", "", "stranger", "school friend", "ancien manager (2019)"]
_RELATIONS = "(SELECT unnest(" + _list(_SAID_RELATIONS) + ") AS relation)"
_K = "lower(trim(relation))"
_WEIGHT = "CASE " + " ".join(f"WHEN {_K} = {_q(n)} THEN {w}" for n, w in crm.RELATIONS) + " " + " ".join(f"WHEN contains({_K}, {_q(n)}) OR contains({_q(n)}, {_K}) THEN {w}" for n, w in crm.RELATIONS) + f" ELSE {crm.UNKNOWN_RELATION} END::DOUBLE"


@query(f"SELECT relation, {_WEIGHT} AS weight, round(least(1.0, {_WEIGHT} / 2), 3) AS at_two_hops FROM {_RELATIONS}")
def pr25_relation_weight(spark, d):
    df = spark.createDataFrame([(r,) for r in _SAID_RELATIONS], "relation string")
    return df.select("relation", crm.relation_weight(F.col("relation")).alias("weight"), crm.introduction_value(F.col("relation"), F.lit(2)).alias("at_two_hops"))


_LETTERS = "regexp_replace(" + _fold("{0}") + ", '[^a-z]', '', 'g')"


@query(f"""SELECT s_suppkey, CASE WHEN len(w) > 1 AND {_LETTERS.format('w[1]')} <> '' AND {_LETTERS.format('w[-1]')} <> '' THEN {_LETTERS.format('w[1]')} || '.' || {_LETTERS.format('w[-1]')} ELSE {_LETTERS.format('n')} END || '@example.org' AS address
FROM (SELECT s_suppkey, replace(s_name, '#', ' ') || 'é x' AS n, list_filter(regexp_split_to_array(trim(replace(s_name, '#', ' ') || 'é x'), '\\s+'), lambda x: x <> '') AS w FROM supplier)""")
def pr22_guessed_address(spark, d):
    name = F.concat(F.replace("s_name", F.lit("#"), F.lit(" ")), F.lit("é x"))
    return table(spark, d, "supplier", "s_suppkey", "s_name").select("s_suppkey", crm.guessed_address(name, F.lit("@Example.org")).alias("address"))


# --- answers

_ANSWERS = "(SELECT doc_id, text FROM documents WHERE kind = 'interview_answer' AND text IS NOT NULL)"
_PLAIN = "regexp_replace(" + _fold("text") + ", '[’ʼ]', '''', 'g')"


@query(f"SELECT doc_id, {', '.join(f'regexp_matches({_PLAIN}, {_q(p)}) AS {n}' for n, p in answers.PARTS.items())} FROM {_ANSWERS}")
def pr27_star(spark, d):
    return _docs(spark, d, "interview_answer").select("doc_id", *(c.alias(n) for n, c in answers.star(F.col("text")).items()))


_SHARE = f"round(len(regexp_extract_all({_PLAIN}, {_q(answers.I_WORDS)})) / greatest(1, len(regexp_extract_all({_PLAIN}, {_q(answers.WE_WORDS)}))), 3)"


@query(f"SELECT doc_id, {_SHARE} AS balance FROM {_ANSWERS}")
def a19_balance(spark, d):
    return _docs(spark, d, "interview_answer").select("doc_id", answers.balance(F.col("text")).alias("balance"))


_FOUND = " + ".join(f"regexp_matches({_PLAIN}, {_q(p)})::INT" for p in answers.PARTS.values())


@query(f"""WITH a AS (SELECT doc_id, {_FOUND} AS found, regexp_matches({_fold('text')}, {_q(answers.QUANTIFIED)}) AS quantified, {_SHARE} AS balance,
len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) AS words FROM {_ANSWERS}), b AS (SELECT *, round(words / 130 * 60)::INT AS seconds FROM a),
c AS (SELECT *, CASE WHEN found = 4 THEN 40 ELSE found * 10 END + CASE WHEN quantified THEN 20 ELSE 0 END + CASE WHEN seconds BETWEEN 90 AND 180 THEN 20 WHEN seconds BETWEEN 60 AND 240 THEN 10 ELSE 0 END
+ CASE WHEN balance BETWEEN 0.5 AND 5.0 THEN 20 WHEN balance BETWEEN 0.2 AND 10.0 THEN 10 ELSE 0 END AS score FROM b)
SELECT doc_id, found = 4 AS has_star, quantified, balance, words, seconds, score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'med' ELSE 'low' END AS band FROM c""")
def pr26_answer_score(spark, d):
    return _docs(spark, d, "interview_answer").select("doc_id", *(c.alias(n) for n, c in answers.judged(F.col("text")).items()))


_QUESTIONS = [
    "Are you authorized to work in France?", "What are your salary expectations?", "When can you start?", "Why do you want to work here?", "How many years of experience do you have?",
    "Do you have experience with Apache Kafka?", "Avez-vous utilisé Docker en production ?", "Maîtrisez-vous Python ?", "Are you familiar with C++?", "Combien d'années d'expérience avez-vous ?",
    "Quel est votre préavis ?", "Tell me a joke.", "",
]
_ASKED = "(SELECT unnest(" + _list(_QUESTIONS) + ") AS text)"
_INTENT = "CASE " + " ".join(f"WHEN regexp_matches({_PLAIN}, {_q(p)}) THEN {_q(n)}" for n, p in answers.INTENTS.items()) + " ELSE 'other' END"


@query(f"SELECT text AS question, {_INTENT} AS intent, nullif(trim(regexp_extract({_PLAIN}, {_q(answers.ASKED)}, 1)), '') AS skill FROM {_ASKED}")
def pr28_questions(spark, d):
    df = spark.createDataFrame([(q,) for q in _QUESTIONS], "question string")
    return df.select("question", answers.intent(F.col("question")).alias("intent"), answers.asked_skill(F.col("question")).alias("skill"))


_ASK = ["python", "apache kafka", "c++", "nothing like it"]


@query(f"""WITH t AS (SELECT cv, list(term) AS terms FROM {_HELD} GROUP BY cv), s AS (SELECT unnest({_list(_ASK)}) AS skill)
SELECT cv, skill, list_contains(terms, skill) OR len(list_intersect(terms, regexp_extract_all(skill, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}+#./-]+'))) > 0 AS held FROM t, s""")
def j11_skill_in_cv(spark, d):
    terms = a07_candidate_terms(spark, d).groupBy("cv").agg(F.collect_set("term").alias("terms"))
    return terms.select("cv", "terms", F.explode(F.lit(_ASK)).alias("skill")).select("cv", "skill", answers.holds_skill(F.col("skill"), F.col("terms")).alias("held"))


_FIELD_NAMES = ["user_password", "cardNumber card number", "cvv", "IBAN", "ssn", "otp", "wallet_address", "first_name", "e-mail", "Mot de passe", "numéro sécu", "billing city"]
_NAMED = "(SELECT unnest(" + _list(_FIELD_NAMES) + ") AS name)"


@query("SELECT name, CASE " + " ".join(f"WHEN regexp_matches({_fold('name')}, {_q(p)}) THEN {_q(k)}" for k, p in answers.FIELDS.items()) + f" ELSE 'safe' END AS kind FROM {_NAMED}")
def f07_field_kind(spark, d):
    return spark.createDataFrame([(n,) for n in _FIELD_NAMES], "name string").select("name", answers.field_kind(F.col("name")).alias("kind"))


_MORE_URLS = ["https://a.example/checkout", "https://pay.example/pay/now", "https://a.example/login?x=1", "https://a.example/oauth/cb", "https://a.example/jobs/1"]


@query(f"""SELECT url, CASE WHEN regexp_matches(lower(url), {_q(answers.PAYMENT)}) THEN 'payment' WHEN regexp_matches(lower(url), {_q(answers.SIGN_IN)}) THEN 'sign-in' END AS reason
FROM (SELECT DISTINCT url FROM job_postings UNION SELECT unnest({_list(_MORE_URLS)}))""")
def f08_blocked_pages(spark, d):
    urls = table(spark, d, "job_postings", "url").unionByName(spark.createDataFrame([(u,) for u in _MORE_URLS], "url string")).distinct()
    return urls.select("url", answers.blocked(F.col("url")).alias("reason"))


@query(f"SELECT posting_id FROM {_LATEST} WHERE apply_url IS NOT NULL AND NOT regexp_matches(lower(apply_url), {_q(answers.PAYMENT)}) AND NOT regexp_matches(lower(apply_url), {_q(answers.SIGN_IN)})")
def o02_fit_to_send(spark, d):
    """Postings with a form that is neither a payment nor a sign-in page."""
    fine = F.col("apply_url").isNotNull() & answers.blocked(F.col("apply_url")).isNull()
    rows = table(spark, d, "job_postings").select("posting_id", "ingested_at", fine.alias("fine"))
    return market.latest(rows, "posting_id", "ingested_at", "fine").where("fine").select("posting_id")


@query(f"SELECT doc_id, token, n, round(least(1.0, n / total::DOUBLE * (ln((total + 1) / (n + 1)::DOUBLE) + 1) * 10), 6) AS salience FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}[\\p{{L}}\\p{{N}}]{{2,}}')) AS token FROM {_OFFERS}) WHERE token NOT IN {_in(sorted(set(offers.STOPWORDS)))} GROUP BY doc_id, token))")
def a11_offer_salience(spark, d):
    """Salience of the words of offers, stop words left out."""
    counts = texts.token_counts(_docs(spark, d, "offer"), "doc_id", "text", tuple(offers.STOPWORDS))
    return texts.salience(counts, "doc_id").withColumn("salience", F.round("salience", 6))
