"""Applications as a log: stages, funnel, channels, stories and what they cover."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of the funnel with the share that usually passes, and how far from it (relative) still counts as "at".
STEPS = (("applied", "screen", 0.03), ("screen", "interview", 0.33), ("interview", "offer", 0.20), ("offer", "accepted", 0.80))
AT = 0.05
#: Stages that count as an interview reached, and as an offer reached.
INTERVIEWED = ("phone_screen", "interview", "final", "offer", "accepted")
OFFERED = ("offer", "accepted")


def funnel(apps: DataFrame, stage: str = "stage") -> DataFrame:
    """``step_no, step, from_n, to_n, rate, vs_usual, bottleneck``: one row for each step, from counts of current stages.

    Counts aren't cumulative, so a rate may exceed 1; it is 0 where both stages
    are empty and unknown where only the first is. The bottleneck is the step
    that loses most, of those whose first stage has any; ties go to the first one.
    """
    stages = sorted({s for a, b, _ in STEPS for s in (a, b)})
    n = apps.agg(*(F.sum(F.when(F.col(stage) == s, 1).otherwise(0)).alias(s) for s in stages), F.count("*").alias("all"))
    row = lambda k, a, b, usual: F.struct(
        F.lit(k).alias("step_no"), F.lit(f"{a}_to_{b}").alias("step"), F.coalesce(a, F.lit(0)).alias("from_n"), F.coalesce(b, F.lit(0)).alias("to_n"), F.lit(usual).alias("usual")
    )
    each = n.where(F.col("all") > 0).select(F.explode(F.array(*(row(k, *s) for k, s in enumerate(STEPS)))).alias("s")).select("s.*")
    rate = F.when(F.col("from_n") > 0, F.col("to_n") / F.col("from_n")).when(F.col("to_n") == 0, 0.0)
    low, high = F.col("usual") * (1 - AT), F.col("usual") * (1 + AT)
    rated = each.withColumn("rate", rate).withColumn("vs_usual", F.when(F.col("rate") > high, "above").when(F.col("rate") < low, "below").when(F.col("rate").isNotNull(), "at"))
    # Four rows at most: one window over all of them is no task of any size.
    loss = F.when(F.col("from_n") > 0, 1 - F.col("rate"))
    first = F.row_number().over(Window.partitionBy().orderBy(loss.desc_nulls_last(), "step_no"))
    return rated.withColumn("bottleneck", (first == 1) & (F.col("from_n") > 0)).select("step_no", "step", "from_n", "to_n", F.round("rate", 6).alias("rate"), "vs_usual", "bottleneck")


def channel_shares(apps: DataFrame, channel: str, stage: str = "stage") -> DataFrame:
    """``channel, n, interview_share, offer_share``; null and empty channels are "unknown"."""
    share = lambda stages: F.round(F.avg(F.coalesce(F.col(stage).isin(*stages), F.lit(False)).cast("int")), 4)
    name = F.coalesce(F.nullif(F.col(channel), F.lit("")), F.lit("unknown"))
    return apps.groupBy(name.alias("channel")).agg(F.count("*").alias("n"), share(INTERVIEWED).alias("interview_share"), share(OFFERED).alias("offer_share"))


def stage_history(events: DataFrame, key: str, stage: str, at: str) -> DataFrame:
    """``key, steps, current_step, first_at, last_at, history``: each key's stages in order of time.

    The history is one key's own events; consecutive events of one stage are
    one entry, at its first time.
    """
    order = Window.partitionBy(key).orderBy(at, stage)
    turns = events.where(F.col(key).isNotNull()).withColumn("before", F.lag(stage).over(order))
    entry = F.when(F.col("before").isNull() | (F.col("before") != F.col(stage)), F.struct(F.col(at).alias("at"), F.col(stage).alias("stage")))
    return turns.groupBy(key).agg(
        F.count("*").alias("steps"), F.max_by(stage, F.struct(at, stage)).alias("current_step"), F.min(at).alias("first_at"), F.max(at).alias("last_at"),
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["stage"]).alias("history"),
    )


def listed(apps: DataFrame, at: str, key: str, stage: str | None = None, stage_column: str = "stage") -> DataFrame:
    """Applications, of one stage if it is named, newest first."""
    some = apps.where(F.col(stage_column) == stage) if stage else apps
    return some.orderBy(F.col(at).desc_nulls_last(), key)


def one(apps: DataFrame, key: str, value) -> DataFrame:
    """The application of a key: one row or none. The filter reaches the scan."""
    return apps.where(F.col(key) == value)


def story_coverage(stories: DataFrame, competencies: str, targets: DataFrame, target: str, partly: bool = False) -> DataFrame:
    """``target, covered``: whether a story tells each target, by equal names without regard to case, or by names one of which holds the other (``partly``).

    Distinct names of the stories are compared, so the stories' number doesn't matter.
    """
    told = stories.select(F.explode(competencies).alias("c")).select(F.lower("c").alias("c")).where(F.col("c") != "").distinct()
    wanted = targets.select(target).distinct()
    if partly:
        from jobweave.operators.market import name_overlap_join

        hit = name_overlap_join(wanted, told, target, "c").select(target).distinct()
    else:
        hit = wanted.join(told, F.lower(target) == F.col("c"), "left_semi")
    return wanted.join(hit.withColumn("hit", F.lit(True)), target, "left").select(target, F.coalesce("hit", F.lit(False)).alias("covered"))


def coverage_share(covered: DataFrame) -> DataFrame:
    """``targets, covered, share``; without targets all is covered."""
    n, hit = F.count("*"), F.sum(F.when(F.col("covered"), 1).otherwise(0))
    return covered.agg(n.alias("targets"), F.coalesce(hit, F.lit(0)).alias("covered"), F.round(F.when(n > 0, hit / n).otherwise(1.0), 4).alias("share"))


def stories_for(stories: DataFrame, competencies: str, wanted: str) -> DataFrame:
    """Stories with a competency whose name holds ``wanted``."""
    return stories.where(F.exists(F.col(competencies), lambda c: F.lower(c).contains(wanted.lower())))


def envelope(rows: DataFrame, group: str, source: str, at: str, *required: str) -> DataFrame:
    """``group, n, sources, first_at, last_at, warnings``: what each delivery holds, and how many rows lack each required field."""
    lacks = [F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(f"__{c}") for c in required]
    found = rows.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(source).alias("sources"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), *lacks)
    warn = [F.when(F.col(f"__{c}") > 0, F.concat(F.lit(f"{c} missing: "), F.col(f"__{c}").cast("string"))) for c in required]
    return found.select(group, "n", "sources", "first_at", "last_at", F.array_compact(F.array(*warn)).alias("warnings"))


#: Weights of relations, in order of precedence, for names that hold one another.
RELATIONS = (
    ("friend", 1.0), ("ami", 1.0), ("amie", 1.0), ("former manager", 0.95), ("ancien manager", 0.95), ("mentor", 0.95), ("mentee", 0.90),
    ("former colleague", 0.75), ("ancien collègue", 0.75), ("ancien collegue", 0.75), ("colleague", 0.70), ("collègue", 0.70), ("collegue", 0.70),
    ("university friend", 0.70), ("camarade de promo", 0.70), ("school friend", 0.65), ("acquaintance", 0.40), ("connaissance", 0.40),
    ("linkedin connection", 0.25), ("connexion linkedin", 0.25), ("contact", 0.30),
)
UNKNOWN_RELATION = 0.20


def relation_weight(relation: Column) -> Column:
    """Weight of a relation: its own, else that of the first one in the list that it holds or that holds it."""
    name = F.lower(F.trim(relation))
    exact = reduce(lambda acc, x: F.when(name == x[0], x[1]).otherwise(acc), reversed(RELATIONS), F.lit(None).cast("double"))
    partly = reduce(lambda acc, x: F.when(name.contains(x[0]) | F.lit(x[0]).contains(name), x[1]).otherwise(acc), reversed(RELATIONS), F.lit(UNKNOWN_RELATION))
    return F.coalesce(exact, partly)


def introduction_value(relation: Column, hops: Column) -> Column:
    return F.round(F.least(F.lit(1.0), relation_weight(relation) / hops), 3)


def guessed_address(name: Column, domain: Column) -> Column:
    """first.last@domain in plain letters; one word alone stands for itself."""
    from jobweave.text import fold

    plain = lambda c: F.regexp_replace(fold(c), "[^a-z]", "")
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    first, last = plain(words[0]), plain(F.element_at(words, -1))
    local = F.when((F.size(words) > 1) & (first != "") & (last != ""), F.concat(first, F.lit("."), last)).otherwise(plain(name))
    return F.concat(local, F.lit("@"), F.lower(F.ltrim(domain, F.lit("@"))))
