"""Queries of the engine's own operators, each with the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.operators import market, match, resume, texts
from jobweave.session import shared_folder, table
from jobweave.sources import sinks

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


def _postings(spark: SparkSession, d: str, *columns) -> DataFrame:
    """The latest row of each posting, with the columns asked for only; derived ones are made before the shuffle."""
    rows = table(spark, d, "job_postings").select("posting_id", "ingested_at", *columns)
    return market.latest(rows, "posting_id", "ingested_at", *(c for c in rows.columns if c != "ingested_at"))


def _all(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "job_postings")


_NOISE = ", ".join(f"'{w}'" for w in market.NOISE)
_NORM = (
    "array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(strip_accents(coalesce({0}, ''))), '^\\s+|\\s+$', '', 'g'), '\\s+'),"
    " lambda w: w NOT IN (" + _NOISE + ")), ' ')"
)
_KEY = "sha256(" + _NORM.format("company") + " || '|' || " + _NORM.format("trim(split_part(coalesce(location, ''), ',', 1))") + " || '|' || " + _NORM.format("title") + ")"
_LATEST = "(SELECT * FROM job_postings QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY ingested_at DESC) = 1)"
_DATE = "CASE WHEN regexp_matches(substring(date_posted, 1, 10), '^\\d{4}-\\d{2}-\\d{2}$') THEN try_cast(substring(date_posted, 1, 10) AS DATE) END"
_FULL = (
    "((company IS NOT NULL)::INT + (location IS NOT NULL)::INT + (remote IS NOT NULL)::INT + (apply_url IS NOT NULL)::INT"
    " + (date_posted IS NOT NULL)::INT + (salary IS NOT NULL)::INT + (description IS NOT NULL)::INT + coalesce(len(tags), 0))"
)
_KEPT = f"""
WITH RECURSIVE p AS (SELECT posting_id, {_KEY} AS k, {_DATE} AS dt, {_FULL} AS full_n FROM {_LATEST}),
s AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY posting_id) AS n FROM p),
r AS (
  SELECT k, n, posting_id, full_n, posting_id AS anchor, [{{'o': posting_id, 'dt': dt}}] AS anchors FROM s WHERE n = 1
  UNION ALL
  SELECT s.k, s.n, s.posting_id, s.full_n,
    coalesce(list_filter(r.anchors, lambda a: a.dt IS NULL OR s.dt IS NULL OR abs(date_diff('day', a.dt, s.dt)) <= 14)[1].o, s.posting_id),
    CASE WHEN len(list_filter(r.anchors, lambda a: a.dt IS NULL OR s.dt IS NULL OR abs(date_diff('day', a.dt, s.dt)) <= 14)) > 0
      THEN r.anchors ELSE list_append(r.anchors, {{'o': s.posting_id, 'dt': s.dt}}) END
  FROM r JOIN s ON s.k = r.k AND s.n = r.n + 1),
kept AS (SELECT posting_id FROM r QUALIFY row_number() OVER (PARTITION BY k, anchor ORDER BY full_n DESC, posting_id) = 1)
"""


@query(f"SELECT posting_id, {_KEY} AS block_key FROM {_LATEST}")
def x06_blocking_key(spark, d):
    return _postings(spark, d, market.blocking_key(F.col("company"), F.col("location"), F.col("title")).alias("block_key"))


@query(f"{_KEPT} SELECT posting_id FROM kept")
def a04_dedupe(spark, d):
    return market.kept(_postings(spark, d, *market.dedupe_columns(_all(spark, d))), "posting_id")


@query(f"""{_KEPT} SELECT posting_id, title, date_posted FROM {_LATEST} JOIN kept USING (posting_id)
WHERE contains(lower(concat_ws(' ', title, description)), 'data') OR contains(lower(concat_ws(' ', title, description)), 'python')""")
def u03_market_search(spark, d):
    return market.search(_all(spark, d), "data python", order="ingested_at")


@query(f"SELECT posting_id, {_FULL} AS fields FROM {_LATEST}")
def a05_completeness(spark, d):
    return _postings(spark, d, market.completeness(_all(spark, d)).alias("fields"))


@query("SELECT posting_id, max(ingested_at) AS ingested_at FROM job_postings GROUP BY posting_id")
def k01_upsert_latest(spark, d):
    return market.latest(_all(spark, d), "posting_id", "ingested_at", "ingested_at")


@query(f"SELECT posting_id FROM {_LATEST} WHERE contains(lower(concat_ws(' ', title, description)), 'senior') OR contains(lower(concat_ws(' ', title, description)), 'kotlin')")
def f01_keyword_filter(spark, d):
    return _postings(spark, d, market.matches_any(["senior", "Kotlin"], "title", "description").alias("hit")).where("hit").select("posting_id")


_KEYED = f"(SELECT posting_id, {_KEY} AS k, {_DATE} AS dt FROM {_LATEST})"


@query(f"""SELECT a.posting_id, any_value(a.k) AS class_id, count(b.posting_id) AS links FROM {_KEYED} a LEFT JOIN {_KEYED} b
ON a.k = b.k AND a.posting_id <> b.posting_id AND coalesce(abs(date_diff('day', a.dt, b.dt)) <= 14, true) GROUP BY a.posting_id""")
def j08_band_join(spark, d):
    """Duplicate postings as a class and a number of links for each; pairs would grow with the square of a key's rows."""
    p = _postings(spark, d, *market.dedupe_columns(_all(spark, d))[:2])
    return market.duplicate_links(p, "posting_id").select("posting_id", F.col("__key").alias("class_id"), "links")


@query(f"""WITH p AS {_LATEST}, t AS (SELECT company, list(title ORDER BY posting_id)[1:3] AS titles FROM p WHERE company IS NOT NULL AND title IS NOT NULL GROUP BY company),
e AS (SELECT company, posting_id, n, tags[n] AS tag FROM (SELECT company, posting_id, tags, unnest(generate_series(1, len(tags))) AS n FROM p WHERE company IS NOT NULL)),
f AS (SELECT company, tag, min((posting_id, n)) AS first FROM e GROUP BY company, tag), g AS (SELECT company, list(tag ORDER BY first, tag)[1:8] AS tags FROM f GROUP BY company)
SELECT company, coalesce(titles, []::VARCHAR[]) AS titles, coalesce(tags, []::VARCHAR[]) AS tags FROM t FULL JOIN g USING (company)""")
def pr32_company_brief(spark, d):
    return market.company_brief(_postings(spark, d, "company", "title", "tags"))


@query(f"""SELECT posting_id, source, rank_no FROM (SELECT posting_id, source, row_number() OVER (PARTITION BY source ORDER BY date_posted DESC NULLS LAST, posting_id)
AS rank_no FROM {_LATEST}) WHERE rank_no <= 5""")
def t7_first_per_source(spark, d):
    top = market.first_per_group(_postings(spark, d, "source", "date_posted"), ["source"], [F.col("date_posted").desc_nulls_last(), F.col("posting_id")], 5)
    return top.select("posting_id", "source", "rank_no")


@query(f"""WITH p AS {_LATEST}, w AS (SELECT company, count(*) AS postings, count(DISTINCT location) AS places, round(avg(remote::INT), 3) AS remote_share,
min(date_posted) AS first_date, max(date_posted) AS last_date FROM p WHERE company IS NOT NULL GROUP BY company),
t AS (SELECT company, tag, count(*) AS n FROM (SELECT company, unnest(tags) AS tag FROM p WHERE company IS NOT NULL) GROUP BY company, tag),
b AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY n DESC, tag) AS r FROM t),
g AS (SELECT company, list(tag ORDER BY r) AS tags FROM b WHERE r <= 20 GROUP BY company)
SELECT w.*, coalesce(g.tags, []::VARCHAR[]) AS tags FROM w LEFT JOIN g USING (company)""")
def a03_company_profile(spark, d):
    return market.company_profile(_postings(spark, d, "company", "location", "remote", "date_posted", "tags"))


@query(f"""SELECT company, location, row_number() OVER (PARTITION BY company ORDER BY min(posting_id), location) AS place_no FROM {_LATEST}
WHERE company IS NOT NULL AND location IS NOT NULL GROUP BY company, location""")
def u08_company_places(spark, d):
    return market.company_places(_postings(spark, d, "company", "location"))


@query(f"SELECT posting_id FROM {_LATEST}")
def f11_postings_or_all(spark, d):
    """A company that isn't there falls back to all postings."""
    return market.postings_of(_postings(spark, d, "company"), "No Such Company").select("posting_id")


@query(f"SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM {_LATEST}) GROUP BY tag ORDER BY n DESC, tag LIMIT 20")
def t6_top_tags(spark, d):
    return market.tag_counts(_postings(spark, d, "tags")).orderBy(F.desc("n"), "tag").limit(20)


@query("""SELECT posting_id FROM monitor_new_jobs m WHERE NOT EXISTS (SELECT 1 FROM job_postings j WHERE j.source = m.source AND j.source_id = m.source_id)""")
def j02_monitor_diff(spark, d):
    return market.snapshot_diff(table(spark, d, "monitor_new_jobs"), table(spark, d, "job_postings", "source", "source_id"), ["source", "source_id"]).select("posting_id")


@query("SELECT DISTINCT source, source_id FROM job_postings")
def k05_snapshot(spark, d):
    """Written by the sink and read again."""
    path = f"{shared_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    sinks.snapshot(table(spark, d, "job_postings"), ["source", "source_id"], path)
    return spark.read.parquet(path)


@query(f"""SELECT posting_id, CASE WHEN coalesce(apply_url, '') <> '' THEN 'ats'
WHEN regexp_matches(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '(^|\\.)(linkedin|indeed|glassdoor)\\.com$') THEN 'aggregator' ELSE 'direct' END AS kind FROM {_LATEST}""")
def pr01_application_source(spark, d):
    return _postings(spark, d, market.application_source(_all(spark, d)).alias("kind"))


_MOMENT = """CASE WHEN regexp_matches(substring(date_posted, 1, 19), '^\\d{4}-\\d{2}-\\d{2}(?:T\\d{2}:\\d{2}:\\d{2})?$')
THEN epoch(try_cast(replace(substring(date_posted, 1, 19), 'T', ' ') AS TIMESTAMP)) END"""
_NOW = 1782907200  # 2026-07-01 12:00
_RECENCY = f"coalesce(exp(-ln(2.0) * greatest(0, {_NOW} - {_MOMENT}) / 86400 / 7), 0.5)"


@query(f"SELECT posting_id, round({_RECENCY}, 6) AS recency FROM {_LATEST}")
def pr11_recency(spark, d):
    return _postings(spark, d, F.round(market.recency(F.col("date_posted"), F.lit(_NOW)), 6).alias("recency"))


_LOW = f"regexp_matches(t, '\\b({market.LOW_LEVEL})\\b')"
_HIGH = f"regexp_matches(t, '\\b({market.HIGH_LEVEL})\\b')"
_COMPETITION = f"""greatest(0.0, least(1.0, 0.5 - (CASE WHEN remote THEN 0.15 WHEN NOT remote THEN -0.05 ELSE 0.0 END
+ CASE WHEN {_LOW} THEN 0.20 WHEN {_HIGH} THEN -0.15 ELSE 0.0 END)))::DOUBLE"""
_TITLED = f"(SELECT posting_id, remote, date_posted, lower(title || ' ' || array_to_string(tags, ' ')) AS t FROM {_LATEST})"


@query(f"SELECT posting_id, round({_COMPETITION}, 4) AS competition FROM {_TITLED}")
def pr12_competition(spark, d):
    return _postings(spark, d, F.round(market.competition(_all(spark, d)), 4).alias("competition"))


@query(f"SELECT posting_id, posting_id % 300 AS applicants, CASE WHEN posting_id % 300 < 10 THEN 0.85 WHEN posting_id % 300 < 50 THEN 0.65 WHEN posting_id % 300 < 200 THEN 0.45 ELSE 0.2 END::DOUBLE AS hiring FROM {_LATEST}")
def pr13_hiring(spark, d):
    """The tables tell no number of applicants; one is made from the id."""
    n = F.col("posting_id") % 300
    return _postings(spark, d, n.alias("applicants"), market.hiring(n).alias("hiring"))


@query(f"""SELECT posting_id, round(100 * (0.4 * (posting_id % 101) / 100 + 0.2 * {_RECENCY} + 0.2 * {_COMPETITION} + 0.1 * 0.5 + 0.1 * 0.0), 2) AS score,
CASE WHEN 1 + ({_MOMENT} IS NOT NULL)::INT + (remote IS NOT NULL OR {_LOW} OR {_HIGH})::INT >= 4 THEN 'high'
WHEN 1 + ({_MOMENT} IS NOT NULL)::INT + (remote IS NOT NULL OR {_LOW} OR {_HIGH})::INT >= 2 THEN 'med' ELSE 'low' END AS confidence FROM {_TITLED}""")
def pr10_chances(spark, d):
    """Signals of a posting with a fit made from its id; applicants and network unknown."""
    none = F.lit(None).cast("double")
    parts = market.chances(_all(spark, d), (F.col("posting_id") % 101).cast("double"), F.lit(_NOW), none, none)
    return _postings(spark, d, *(c.alias(k) for k, c in parts.items()))


@query(f"SELECT posting_id, CAST({_DATE} AS VARCHAR) AS day FROM {_LATEST}")
def d01_iso_date(spark, d):
    return _postings(spark, d, market.iso_date(F.col("date_posted")).cast("string").alias("day"))


@query(f"SELECT posting_id, {_NORM.format('title')} AS title_key, {_NORM.format('company')} AS company_key FROM {_LATEST}")
def x04_normalised(spark, d):
    return _postings(spark, d, market.normalised(F.col("title")).alias("title_key"), market.normalised(F.col("company")).alias("company_key"))


_TOKENS = "(SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}[\\p{L}\\p{N}]{2,}')) AS token FROM documents)"
_COUNTS = f"(SELECT doc_id, token, count(*) AS n FROM {_TOKENS} GROUP BY doc_id, token)"


@query(f"SELECT token, count(*) AS n FROM {_TOKENS} GROUP BY token")
def x07_token_counts(spark, d):
    return texts.tokens(table(spark, d, "documents"), "doc_id", "text").groupBy("token").agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, token, n, rank_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, token) AS rank_no FROM {_COUNTS} WHERE n >= 5) WHERE rank_no <= 3""")
def a12_stuffed_tokens(spark, d):
    counts = texts.token_counts(table(spark, d, "documents"), "doc_id", "text").where(F.col("n") >= 5)
    return texts.top_per_key(counts, "doc_id", [F.desc("n"), F.col("token")], 3)


@query("""SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, trim(regexp_replace(unnest(regexp_split_to_array(text, '\\r\\n|\\r|\\n')), '\\s+', ' ', 'g')) AS line
FROM documents) WHERE length(line) >= 10 GROUP BY doc_id, line HAVING count(*) >= 3""")
def a12_repeated_lines(spark, d):
    return texts.repeated_lines(table(spark, d, "documents"), "doc_id", "text")


@query(f"""SELECT doc_id, token, n, round(least(1.0, n / total::DOUBLE * (ln((total + 1) / (n + 1)::DOUBLE) + 1) * 10), 6) AS salience
FROM {_COUNTS} JOIN (SELECT doc_id, sum(n) AS total FROM {_COUNTS} GROUP BY doc_id) USING (doc_id)""")
def a11_salience(spark, d):
    counts = texts.token_counts(table(spark, d, "documents"), "doc_id", "text")
    return texts.salience(counts, "doc_id").withColumn("salience", F.round("salience", 6))


_HEAD = "CASE " + " ".join(
    "WHEN h IN (" + ", ".join("'" + x.replace("'", "''") + "'" for x in hs) + f") THEN '{name}'" for name, hs in texts.HEADINGS.items()
) + " END"
_CV = "(SELECT cv_id, min(raw_text) AS raw_text FROM cv_parse GROUP BY cv_id)"
_LINES = f"""(SELECT cv_id, n - 1 AS line_no, trim(regexp_replace(xs[n], '\\s+', ' ', 'g')) AS line FROM
(SELECT cv_id, xs, unnest(generate_series(1, len(xs))) AS n FROM (SELECT cv_id, regexp_split_to_array(raw_text, '\\r\\n|\\r|\\n') AS xs FROM {_CV} WHERE raw_text IS NOT NULL)))"""


def _cvs(spark, d):
    return table(spark, d, "cv_parse").groupBy("cv_id").agg(F.min("raw_text").alias("raw_text"))


@query(f"""WITH m AS (SELECT *, {_HEAD} AS name FROM (SELECT *, rtrim(regexp_replace(trim(lower(strip_accents(line))), ':+$', '')) AS h FROM {_LINES})),
s AS (SELECT *, sum((name IS NOT NULL)::INT) OVER (PARTITION BY cv_id ORDER BY line_no) AS section_no FROM m)
SELECT cv_id, section_no::BIGINT AS section_no, max(name) AS name, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE name IS NULL), ''), '^\\s+|\\s+$', '', 'g') AS text
FROM s WHERE section_no > 0 GROUP BY cv_id, section_no""")
def x01_sections(spark, d):
    return texts.sections(_cvs(spark, d), "cv_id", "raw_text").select("cv_id", F.col("section_no").cast("bigint").alias("section_no"), "name", "text")


@query(f"""WITH h AS (SELECT cv_id, count(*) AS n FROM (SELECT cv_id, {_HEAD} AS name FROM (SELECT cv_id, rtrim(regexp_replace(trim(lower(strip_accents(line))), ':+$', '')) AS h FROM {_LINES}))
WHERE name IS NOT NULL GROUP BY cv_id)
SELECT cv_id, CASE WHEN length(t) < 50 THEN 0.0 ELSE round(greatest(0.0, 1.0 - CASE WHEN regexp_matches(raw_text, '[\\w.+-]+@[\\w-]+\\.[\\w.-]+') THEN 0 ELSE 0.3 END
- CASE WHEN n > 0 THEN 0 ELSE 0.4 END - CASE WHEN length(t) < 200 THEN 0.2 ELSE 0 END)::DOUBLE, 6) END::DOUBLE AS confidence
FROM (SELECT cv_id, raw_text, regexp_replace(raw_text, '^\\s+|\\s+$', '', 'g') AS t FROM {_CV} WHERE raw_text IS NOT NULL) LEFT JOIN h USING (cv_id)""")
def pr38_parse_confidence(spark, d):
    cvs = _cvs(spark, d).where("raw_text is not null")
    has = F.exists(F.split("raw_text", r"\r\n|\r|\n"), lambda x: texts.heading_name(F.regexp_replace(x, r"\s+", " ")).isNotNull())
    return cvs.select("cv_id", texts.parse_confidence(F.col("raw_text"), has).alias("confidence"))


@query("SELECT cv_id, lower(raw_heading) AS folded, min_by(raw_heading, section_no * 1000000000::BIGINT) AS raw_heading FROM (SELECT cv_id, section_no, min(raw_heading) AS raw_heading FROM cv_sections WHERE raw_heading IS NOT NULL GROUP BY cv_id, section_no) GROUP BY cv_id, lower(raw_heading)")
def w02_distinct_first(spark, d):
    one = table(spark, d, "cv_sections").where("raw_heading is not null").groupBy("cv_id", "section_no").agg(F.min("raw_heading").alias("raw_heading"))
    return texts.distinct_first(one, "cv_id", "raw_heading", "section_no")


@query("""WITH a AS (SELECT DISTINCT company FROM job_postings WHERE trim(company) <> ''), b AS (SELECT DISTINCT company AS known_name FROM monitor_new_jobs WHERE trim(company) <> '')
SELECT company, known_name FROM a JOIN b ON contains(lower(trim(company)), lower(trim(known_name))) OR contains(lower(trim(known_name)), lower(trim(company)))""")
def j03_name_overlap(spark, d):
    """Employers of the history against those of new postings."""
    a, b = table(spark, d, "job_postings", "company").distinct(), table(spark, d, "monitor_new_jobs", F.col("company").alias("known_name")).distinct()
    return market.name_overlap_join(a, b, "company", "known_name")


@query("""SELECT c_custkey, c_nationkey, s_suppkey, CASE WHEN s_suppkey IS NOT NULL THEN coalesce(gap <> 0, true) END AS approximate FROM (SELECT c_custkey, c_nationkey, s_suppkey, abs(c_acctbal - s_acctbal) AS gap,
row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal) NULLS LAST, s_suppkey) AS r FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey) WHERE r = 1""")
def j04_nearest(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal")
    s = table(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").withColumnRenamed("s_nationkey", "c_nationkey")
    return market.nearest(c, s, ["c_nationkey"], "c_acctbal", "s_acctbal", "s_suppkey").select("c_custkey", "c_nationkey", "match.s_suppkey", "approximate")


@query("SELECT source, count(*) AS pages, sum((payload IS NULL OR NOT json_valid(payload))::INT)::BIGINT AS broken FROM provider_pages GROUP BY source")
def s22_tolerant_scan(spark, d):
    bad = F.col("payload").isNull() | F.try_parse_json("payload").isNull()
    return table(spark, d, "provider_pages").groupBy("source").agg(F.count("*").alias("pages"), F.sum(bad.cast("bigint")).alias("broken"))


_STINTS = """(SELECT DISTINCT cv_id, substring(p, 1, 4)::INT AS first, substring(p, 6, 4)::INT AS last FROM (SELECT cv_id,
unnest(regexp_extract_all(raw_text, '\\(((?:19|20)[0-9]{2}-(?:19|20)[0-9]{2})\\)', 1)) AS p FROM """ + _CV + """) WHERE substring(p, 1, 4) <= substring(p, 6, 4))"""


@query(f"SELECT cv_id, after, until FROM (SELECT cv_id, last AS after, lead(first) OVER (PARTITION BY cv_id ORDER BY first, last) AS until FROM {_STINTS}) WHERE until - after > 1")
def w01_work_gaps(spark, d):
    return resume.gaps(resume.stints(_cvs(spark, d), "cv_id", "raw_text"), "cv_id")


@query(f"SELECT cv_id, sum(last - first)::BIGINT AS years, count(*) AS periods, sum((last = first)::INT)::BIGINT AS short FROM {_STINTS} GROUP BY cv_id")
def a14_work_years(spark, d):
    return resume.work_years(resume.stints(_cvs(spark, d), "cv_id", "raw_text"), "cv_id")


@query("""SELECT doc_id, len(list_filter(range(2, len(t) + 1), lambda i: t[i] = t[i - 1])) AS doubled
FROM (SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}{2,}') AS t FROM documents WHERE text IS NOT NULL)""")
def x19_doubled_words(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", resume.doubled_words(F.col("text")).cast("bigint").alias("doubled"))


@query(f"""SELECT cv_id, round(greatest(length(raw_text) / 3500, filled / 45), 4) AS pages FROM {_CV} JOIN (SELECT cv_id, sum((line <> '')::INT) AS filled FROM {_LINES} GROUP BY cv_id) USING (cv_id)""")
def x18_pages(spark, d):
    return resume.pages(_cvs(spark, d).where("raw_text is not null"), "cv_id", "raw_text")


@query("""SELECT doc_id, n AS words, round(n / 130 * 60)::INT AS seconds, regexp_matches(text, '[0-9]{2,}|[0-9] ?[%€$£k]') AS quantified
FROM (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n FROM documents WHERE kind = 'interview_answer' AND text IS NOT NULL)""")
def pr26_answer_metrics(spark, d):
    answers = table(spark, d, "documents").where("kind = 'interview_answer' and text is not null")
    return answers.select("doc_id", *(c.alias(n) for n, c in resume.answer_metrics(F.col("text")).items()))


_OFFER_LINES = """(SELECT doc_id, n - 1 AS line_no, trim(regexp_replace(xs[n], '\\s+', ' ', 'g')) AS line FROM
(SELECT doc_id, xs, unnest(generate_series(1, len(xs))) AS n FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS xs FROM documents WHERE kind = 'offer' AND text IS NOT NULL)))"""
_WANTED = f"""(WITH l AS (SELECT *, trim(regexp_replace(lower(strip_accents(line)), '\\s*:\\s*$', '')) AS h FROM {_OFFER_LINES}),
k AS (SELECT *, CASE WHEN regexp_matches(h, '{match.MUST}') THEN 'must' WHEN regexp_matches(h, '{match.NICE}') THEN 'nice' WHEN regexp_matches(h, '{match.OTHER}') THEN 'other'
  WHEN line = '' AND lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) = '' THEN 'other' END AS mark FROM l),
p AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kind FROM k),
t AS (SELECT doc_id, kind, unnest(regexp_split_to_array(trim(regexp_replace(lower(line), '^[-*•◦·▸▹–—\\s]+', '')), '{match.TERM_LINK}')) AS term
  FROM p WHERE mark IS NULL AND kind IN ('must', 'nice') AND line <> '')
SELECT doc_id, min(kind) AS kind, term FROM t WHERE term <> '' GROUP BY doc_id, term)"""


@query(f"SELECT doc_id, kind, term FROM {_WANTED}")
def x10_offer_requirements(spark, d):
    return match.requirements(table(spark, d, "documents").where("kind = 'offer' and text is not null"), "doc_id", "text")


@query(f"""SELECT posting_id, coalesce(CASE regexp_extract(lower(strip_accents(title)), '\\b(junior|senior|lead|principal|stagiaire|stage|confirme)\\b', 1) WHEN 'stagiaire' THEN 0 WHEN 'stage' THEN 0
WHEN 'junior' THEN 1 WHEN 'confirme' THEN 2 WHEN 'senior' THEN 3 WHEN 'lead' THEN 4 WHEN 'principal' THEN 5 END, -1) AS level_rank FROM {_LATEST}""")
def x12_level_rank(spark, d):
    return _postings(spark, d, F.coalesce(match.level_rank(F.col("title")), F.lit(-1)).alias("level_rank"))


@query("SELECT source FROM job_postings EXCEPT SELECT source FROM provider_pages")
def u05_except(spark, d):
    return table(spark, d, "job_postings", "source").subtract(table(spark, d, "provider_pages", "source"))


@query("SELECT source FROM job_postings INTERSECT SELECT source FROM provider_pages")
def u06_intersect(spark, d):
    return table(spark, d, "job_postings", "source").intersect(table(spark, d, "provider_pages", "source"))
