"""Postings of one vacancy across sources, by loopy belief propagation over candidate pairs.

Postings are read into facts (employer, post, level, place, names and sentences
of the text). Equal postings of a source become one variant, so copies are
compared once; variants of a source that tell the same employer, post, level and
city are one class, for they announce one vacancy. Candidates share an identity,
a rare name of the text, or a common one and the region, together with post and
level; each pair of variants gets prior log-odds from how its facts agree, and
a pair of classes has those of its best variants. Then factors say that a class has at
most one partner in each other source: every pair receives from each of its two
classes a message against it, as strong as the class's other candidates in that
source. Messages are exchanged through joins until they stop changing, else
that is an error; marginals give the confidence.

Candidate keys are rare by construction; a hot employer or source doesn't make
them grow. The loop cuts its lineage with checkpoints.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.llm.postings import read_postings
from jobweave.session import checkpoint

#: Evidence in natural log-odds.
PRIOR = -9.0
WEIGHTS = {
    "post": 4.0, "city": 3.0, "region": 1.0, "programme": 6.0, "name": 1.5, "sentence": 2.0, "identity": 6.0,
    "conflict": -12.0, "employer_conflict": -9.0, "programme_conflict": -3.0,
}
#: Shared names and shared sentences aren't independent: each of the two tells at most as much as three of its kind.
SATURATION = 3
#: An employer's agreement weighs the more the rarer it is: natural log of the inverse of its share, less one, within these bounds.
EMPLOYER_WEIGHT = (0.5, 6.0)
#: Employers and names of a text with more than this share of all postings are common; there can't be many of them.
COMMON_SHARE = 0.002
MATCH = 0.5
#: Messages are exchanged until none changes by more than TOLERANCE; STEPS rounds go between checkpoints.
STEPS, TOLERANCE, DAMPING, MAX_ROUNDS = 5, 0.001, 0.6, 1000

#: A post code of which a part is missing.
INCOMPLETE = r"^\.|\.\.|\.$"
_IDENTITY = ["source", "post", "level", "city", "region", "employer", "employer_rest", "programme"]


def facts_of(postings: DataFrame, *keep: str, chunks: bool = False) -> DataFrame:
    """Facts of each row that has an id and a source."""
    return read_postings(postings.where(F.col("posting_id").isNotNull() & F.col("source").isNotNull()), "posting_id", "source", *keep, chunks=chunks)


def common(values: DataFrame, column: str, rows: int) -> dict:
    """Values of ``column`` with more than COMMON_SHARE of ``rows``, and their shares.

    At most 1 / COMMON_SHARE values for each value a row may hold, however
    large the table is, so they may be collected.
    """
    return {r[0]: r[1] / rows for r in values.groupBy(column).count().where(F.col("count") > COMMON_SHARE * rows).collect()}


def name_weights(shares: dict[int, float]) -> dict[int, float]:
    """Evidence of the common names: as much as a rare one's at COMMON_SHARE, down to nothing for a name that all postings have."""
    return {n: WEIGHTS["name"] * math.log(share) / math.log(COMMON_SHARE) for n, share in shares.items()}


def candidate_pairs(reps: DataFrame, usual: list[int]) -> DataFrame:
    """``a, b`` (a < b): representatives of different sources that share a key.

    Names among ``usual`` count where a side withholds its employer, two at
    least and in one region: with fewer, such a pair can't reach even odds.
    """
    key = lambda tag, *parts: F.xxhash64(F.lit(tag), F.col("post"), F.col("level"), *parts)
    none = F.array().cast("array<bigint>")
    known = F.lit(usual).cast("array<bigint>") if usual else none
    named = (F.col("employer") != "") & (F.col("city") != "")
    # An employer's name may be misspelt, but not at both ends.
    spelt = F.array(key("begin", F.substring("employer", 1, 3), F.col("city")), key("end", F.right("employer", F.lit(3)), F.col("city")))
    keys = F.concat(
        F.when(named, spelt).otherwise(none),
        F.when(F.col("programme") != "", F.array(key("programme", F.col("programme")))).otherwise(none),
        F.transform(F.array_except("names", known), lambda n: key("name", n)),
        F.when(F.col("city") != "", F.transform("sentences", lambda s: key("sentence", s, F.col("city")))).otherwise(none),
    )
    rows = reps.select("id", "source", F.explode(F.array_distinct(keys)).alias("key"))
    # Both sides are one table, so it is shuffled once.
    x, y = rows.alias("x"), rows.alias("y")
    apart = (F.col("x.id") < F.col("y.id")) & (F.col("x.source") != F.col("y.source"))
    by_key = x.join(y, F.col("x.key") == F.col("y.key")).where(apart).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    either = lambda: (F.col("id") != F.col("v")) & (F.col("source") != F.col("v_source"))
    ends = (F.least("id", "v").alias("a"), F.greatest("id", "v").alias("b"))
    # Where an employer is withheld, common names of the text must do, several of them.
    told = reps.where(F.col("region") != "").select("id", "source", "employer", F.explode(F.transform(F.array_intersect("names", known), lambda n: key("usual", n, F.col("region")))).alias("key"))
    withheld = told.where(F.col("employer") == "").select(F.col("id").alias("v"), F.col("source").alias("v_source"), "key")
    by_usual = withheld.join(told.select("id", "source", "key"), "key").where(either()).select(*ends, "key").distinct().groupBy("a", "b").count().where(F.col("count") > 1).select("a", "b")
    # Where a place is not told, employer and post must do; such postings are few and meet all others of their employer.
    whole = F.xxhash64("post", "level", "employer")
    vague = reps.where((F.col("city") == "") & (F.col("employer") != "")).select(F.col("id").alias("v"), F.col("source").alias("v_source"), F.col("region").alias("v_region"), whole.alias("key"))
    full = reps.where(F.col("employer") != "").select("id", "source", "region", whole.alias("key"))
    by_employer = vague.join(full, "key").where(either() & ((F.col("region") == F.col("v_region")) | (F.col("region") == "") | (F.col("v_region") == ""))).select(*ends)
    # The same for a post of which a part can't be read: employer, level and place must do.
    spot = F.xxhash64("level", "employer", "city")
    part = reps.where(named & F.col("post").rlike(INCOMPLETE)).select(F.col("id").alias("v"), F.col("source").alias("v_source"), spot.alias("key"))
    by_place = part.join(reps.where(named).select("id", "source", spot.alias("key")), "key").where(either()).select(*ends)
    return by_key.unionByName(by_usual).unionByName(by_employer).unionByName(by_place).distinct()


def prior(employers: dict[str, float], names: dict[int, float], a: str = "x", b: str = "y") -> Column:
    """Log-odds of a pair from the agreement of its facts, by shares of common employers and weights of common names.

    Employer, post, level and city that are all told and equal tell more
    together than each for itself: that is what makes a vacancy.
    """
    w = {k: F.lit(v) for k, v in WEIGHTS.items()}
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    same = lambda c: x(c) == y(c)
    both = lambda c: (x(c) != "") & (y(c) != "")
    part = lambda col, i: F.split_part(col, F.lit("."), F.lit(i))
    clash = F.lit(False)
    for i in (1, 2, 3):
        p, q = part(x("post"), i), part(y("post"), i)
        clash = clash | ((p != "") & (q != "") & (p != q))
    post = F.when(clash | ~same("level"), w["conflict"]).when(same("post"), w["post"]).otherwise(w["post"] / 2)
    place = (
        F.when(both("city") & same("city"), w["city"]).when(both("city"), w["conflict"])
        .when(both("region") & same("region"), w["region"]).when(both("region"), w["conflict"]).otherwise(F.lit(0.0))
    )
    rest_clash = both("employer_rest") & ~same("employer_rest") & (F.levenshtein(x("employer_rest"), y("employer_rest")) > 2)
    near = F.levenshtein(x("employer"), y("employer")) <= 1 + (F.least(F.length(x("employer")), F.length(y("employer"))) >= 6).cast("int")
    low, high = EMPLOYER_WEIGHT
    table = {k: min(high, max(low, -math.log(share) - 1)) for k, share in employers.items()}
    rarity = F.coalesce(F.try_element_at(F.create_map(*(F.lit(z) for kv in table.items() for z in kv)), x("employer")), F.lit(high)) if table else F.lit(high)
    told = both("employer") & both("city") & ~x("post").rlike(INCOMPLETE)
    identical = told & same("employer") & ~rest_clash & same("post") & same("level") & same("city")
    firm = (
        F.when(~both("employer"), F.lit(0.0)).when(same("employer") & ~rest_clash, rarity)
        .when(near & ~rest_clash, rarity / 2).otherwise(w["employer_conflict"])
    )
    programme = (
        F.when(~both("programme"), F.lit(0.0)).when(same("programme"), w["programme"])
        .when(F.levenshtein(x("programme"), y("programme")) <= 2, w["programme"] / 2).otherwise(w["programme_conflict"])
    )
    shared = lambda c: F.array_intersect(x(c), y(c))
    weights = F.create_map(*(F.lit(z) for kv in names.items() for z in kv)) if names else None
    weigh = (lambda n: F.coalesce(F.try_element_at(weights, n), w["name"])) if names else (lambda n: w["name"])
    named = F.least(F.aggregate(shared("names"), F.lit(0.0), lambda s, n: s + weigh(n)), SATURATION * w["name"])
    said = F.least(F.size(shared("sentences")), F.lit(SATURATION)) * w["sentence"]
    return F.lit(PRIOR) + post + place + firm + programme + named + said + F.when(identical, w["identity"]).otherwise(0.0)


def _exchange(state: DataFrame) -> DataFrame:
    """One damped round of messages ``m_a``, ``m_b``; ``change`` is the greatest step of a row.

    The sums of a class's beliefs come back to each of its pairs by a window,
    which is the aggregate joined back to its rows; written as a join, the plan
    of several rounds would double with each.
    """
    bounded = lambda c: F.exp(F.least(F.greatest(c, F.lit(-30.0)), F.lit(30.0)))
    rows = state.withColumn("e_a", bounded(F.col("odds") + F.col("m_b"))).withColumn("e_b", bounded(F.col("odds") + F.col("m_a")))
    rows = rows.withColumn("s_a", F.sum("e_a").over(Window.partitionBy("a", "b_source"))).withColumn("s_b", F.sum("e_b").over(Window.partitionBy("b", "a_source")))
    rest = lambda s, e: -F.log1p(F.greatest(F.col(s) - F.col(e), F.lit(0.0)))
    step = lambda old, new: (1 - DAMPING) * F.col(old) + DAMPING * new
    m_a, m_b = step("m_a", rest("s_a", "e_a")), step("m_b", rest("s_b", "e_b"))
    change = F.greatest(F.abs(m_a - F.col("m_a")), F.abs(m_b - F.col("m_b")))
    return rows.select("a", "b", "a_source", "b_source", "odds", m_a.alias("m_a"), m_b.alias("m_b"), change.alias("change"))


def propagate(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``a, b, a_source, b_source, odds`` to ``a, b, p``: marginals under the one-partner factors.

    Pairs that no other pair contests keep their prior. The rest exchange
    messages: from class a to its pair with b goes -log(1 + sum of exp(belief
    without this message) over a's other pairs into b's source), and the same
    from b; partial steps (damping) until the greatest change is small. Messages
    that don't settle within MAX_ROUNDS rounds are an error.
    """
    contested = pairs
    for end, into in (("a", "b_source"), ("b", "a_source")):
        contested = contested.join(pairs.groupBy(end, into).agg(F.count("*").alias(f"n_{end}")), [end, into])
    alone = contested.where((F.col("n_a") == 1) & (F.col("n_b") == 1)).select("a", "b", "odds")
    state = checkpoint(
        contested.where((F.col("n_a") > 1) | (F.col("n_b") > 1)).select("a", "b", "a_source", "b_source", "odds", F.lit(0.0).alias("m_a"), F.lit(0.0).alias("m_b"))
    )
    for _ in range(0, MAX_ROUNDS, STEPS):
        for _ in range(STEPS):
            state = _exchange(state)
        state = checkpoint(state)
        if (state.agg(F.max("change")).first()[0] or 0.0) < TOLERANCE:
            break
    else:
        raise RuntimeError(f"messages still change by more than {TOLERANCE} after {MAX_ROUNDS} rounds")
    belief = state.select("a", "b", (F.col("odds") + F.col("m_a") + F.col("m_b")).alias("odds")).unionByName(alone)
    return belief.select("a", "b", (1 / (1 + F.exp(-F.col("odds")))).alias("p"))


def match_postings(postings: DataFrame, threshold: float = MATCH) -> DataFrame:
    """``posting_id_a, posting_id_b, confidence`` (a < b) of postings of one vacancy in different sources.

    Rows without id or source are left out; redelivered rows count once; nulls
    in other columns say nothing. An empty table gives an empty result.
    """
    # Rows with equal facts are one variant, redelivered ones among them; they need not be made distinct before.
    same = F.xxhash64(*_IDENTITY, F.array_sort("names"), F.array_sort("sentences"))
    told = (F.col("employer") != "") & (F.col("city") != "") & ~F.col("post").rlike(INCOMPLETE)
    whole = F.when(told, F.xxhash64("source", "post", "level", "employer", "employer_rest", "city"))
    facts = checkpoint(facts_of(postings).select("posting_id", *_IDENTITY, "names", "sentences", same.alias("same"), F.coalesce(whole, same).alias("class")))
    rows = facts.count()
    names = name_weights(common(facts.select(F.explode("names").alias("n")), "n", rows))
    employers = common(facts.where(F.col("employer") != ""), "employer", rows)
    members = facts.select("posting_id", "source", "class")
    reps = checkpoint(
        facts.groupBy("source", "same").agg(
            F.min("posting_id").alias("id"), *(F.first(c).alias(c) for c in ("class", "post", "level", "city", "region", "employer", "employer_rest", "programme", "names", "sentences"))
        ).drop("same")
    )
    pairs = candidate_pairs(reps, list(names))
    x = reps.select(F.col("id").alias("a"), F.struct(*reps.columns).alias("x"))
    y = reps.select(F.col("id").alias("b"), F.struct(*reps.columns).alias("y"))
    # Ends of a pair are classes, the lesser source first.
    turned = F.col("x.source") > F.col("y.source")
    end = lambda c, one, two: F.when(turned, F.col(f"{two}.{c}")).otherwise(F.col(f"{one}.{c}"))
    scored = pairs.join(x, "a").join(y, "b").select(
        end("class", "x", "y").alias("a"), end("class", "y", "x").alias("b"), end("source", "x", "y").alias("a_source"), end("source", "y", "x").alias("b_source"),
        prior(employers, names).alias("odds"),
    )
    # A pair against which the facts speak this strongly can't win, and would change another's log-odds by less than exp(PRIOR).
    best = scored.where(F.col("odds") > PRIOR).groupBy("a", "b", "a_source", "b_source").agg(F.max("odds").alias("odds"))
    found = propagate(checkpoint(best)).where(F.col("p") >= threshold)
    of = members.select(F.col("class").alias("c"), "posting_id").distinct()
    one, two = of.select(F.col("c").alias("a"), F.col("posting_id").alias("i")), of.select(F.col("c").alias("b"), F.col("posting_id").alias("j"))
    return (
        found.join(one, "a").join(two, "b")
        .select(F.least("i", "j").alias("posting_id_a"), F.greatest("i", "j").alias("posting_id_b"), F.col("p").alias("confidence"))
        .groupBy("posting_id_a", "posting_id_b").agg(F.max("confidence").alias("confidence"))
    )
