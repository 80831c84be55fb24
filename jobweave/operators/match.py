"""Offers against CVs: required and wished terms of an offer, what a CV covers of them, score and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobweave.operators.texts import TOKEN, lines
from jobweave.session import broadcast_if_small, checkpoint, spread
from jobweave.text import fold

#: Headings of an offer's blocks, folded, without a final colon.
MUST = r"^(?:requirements?|required|must[ -]have|exige|requis|profil recherche)$"
NICE = r"^(?:nice[ -]to[ -]have|bonus|plus|atout|apprecie|un plus|would be a plus)$"
OTHER = (
    r"^(?:responsibilities|about (?:us|the role|you)|we offer|benefits?|compensation|what you|missions?|responsabilites?|ce que|nous offrons|"
    r"avantages?|salary|salaire|remuneration)$"
)
#: Ranks of levels.
LEVELS = {"stagiaire": 0, "stage": 0, "junior": 1, "confirme": 2, "senior": 3, "lead": 4, "principal": 5}
#: Other names of skills, by canonical name.
SYNONYMS = {
    "kubernetes": "k8s",
    "docker": "docker-compose|dockercompose",
    "javascript": "js|javascript.js",
    "typescript": "ts",
    "python": "py|python3|python2",
    "machine learning": "ml|apprentissage automatique|machine-learning",
    "postgresql": "postgres|psql|postgresql db",
    "ci/cd": "cicd|ci cd|continuous integration|continuous deployment|intégration continue|integration continue",
    "gestion de projet": "project management|chef de projet|project manager|gestion projet",
    "react": "reactjs|react.js|react js",
    "vue": "vuejs|vue.js|vue js",
    "angular": "angularjs|angular.js",
    "nodejs": "node|node.js|node js|npm|express",
    "redis": "redis db|redisdb",
    "mongodb": "mongo|mongodb atlas",
    "elasticsearch": "elastic|elk|opensearch",
    "terraform": "tf|infrastructure as code|iac",
    "ansible": "playbook",
    "aws": "amazon web services|ec2|s3|lambda",
    "gcp": "google cloud|google cloud platform|gke",
    "azure": "microsoft azure|azure cloud",
    "java": "jvm|openjdk",
    "springboot": "spring|spring boot|spring framework",
    "linux": "unix|bash|shell|ubuntu|debian",
    "git": "github|gitlab|bitbucket|version control|contrôle de version|controle de version",
    "agile": "scrum|kanban|méthode agile|methode agile|sprint",
    "sql": "structured query language|mysql|sqlite|base de données|base de donnees",
    "api": "rest api|restful|graphql|web services",
    "devops": "dev ops|sre|site reliability",
    "rust": "rust-lang",
    "golang": "go|go lang|go language",
    "scala": "akka|scala language",
    "hadoop": "mapreduce|hive|spark|apache spark|big data",
    "deep learning": "dl|apprentissage profond|deep-learning|neural network|réseau de neurones|reseau de neurones",
    "nlp": "natural language processing|traitement du langage naturel|traitement automatique du langage|tal",
    "pandas": "pandas python",
}
#: Most rows of a table of names that is broadcast.
DIMENSION_ROWS = 10_000
#: Most CVs of a stated set of queries that travel to the offers; more of them are shuffled to them.
STATED_ROWS = 100_000
#: Most rows of a table of the words of stated CVs that is broadcast.
WORD_ROWS = 300_000
#: CVs of a block: a bit of a number stands for each.
BITS = 64
#: Before a word that counts in another way than as a requirement's; no requirement holds a line's end.
MARK = "\n"
#: Share of characters that a requirement and a CV's word must have in common, in order, to count as spellings of one term.
SPELLING = 0.85
TERM_LINK = r"\s*(?:,|;|/|\bet\b|\band\b|\bou\b|\bor\b)\s*"


def requirements(offers: DataFrame, key: str, text: str) -> DataFrame:
    """``key, kind, term``: distinct lower-cased terms of the lines below "Requirements" and "Nice to have" headings.

    A block ends at the next heading or at a second blank line in a row.
    """
    ls = lines(spread(offers.select(key, text), key), key, text)
    head = F.trim(F.regexp_replace(fold(F.col("line")), r"\s*:\s*$", ""))
    kind = F.when(head.rlike(MUST), "must").when(head.rlike(NICE), "nice").when(head.rlike(OTHER), "other")
    w = Window.partitionBy(key).orderBy("line_no")
    blank = F.col("line") == ""
    marked = ls.withColumn("mark", F.when(kind.isNotNull(), kind).when(blank & F.lag(blank).over(w), "other"))
    placed = marked.withColumn("kind", F.last("mark", ignorenulls=True).over(w)).where(F.col("mark").isNull() & F.col("kind").isin("must", "nice") & ~blank)
    item = F.trim(F.regexp_replace(F.lower("line"), r"^[-*•◦·▸▹–—\s]+", ""))
    terms = placed.select(key, "kind", F.explode(F.split(item, TERM_LINK)).alias("term")).where(F.col("term") != "")
    # A term that is required isn't merely wished for.
    return terms.groupBy(key, "term").agg(F.min("kind").alias("kind")).select(key, "kind", "term")


def terms_of(cvs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term``: distinct lower-cased words of a CV, with signs that names of tools hold."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\.?[\p{L}\p{N}][\p{L}\p{N}+#.-]*"), 0)
    return cvs.select(key, F.explode(F.array_distinct(F.transform(words, lambda x: F.rtrim(x, F.lit("."))))).alias("term")).where(F.col("term") != "").distinct()


def canonical(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Terms with aliases replaced by their canonical form; unknown ones stay."""
    names = broadcast_if_small(synonyms.select(F.col("alias").alias("term"), "canonical"), DIMENSION_ROWS)
    return terms.join(names, "term", "left").withColumn("term", F.coalesce("canonical", "term")).drop("canonical").distinct()


def expanded(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``terms`` with ``name``: each term's canonical form and all names of it; a term without names stands for itself."""
    names = synonyms.select("canonical", F.col("alias").alias("name")).unionByName(synonyms.select("canonical", F.col("canonical").alias("name"))).distinct()
    names = broadcast_if_small(names, DIMENSION_ROWS)
    own = terms.join(broadcast_if_small(synonyms.select(F.col("alias").alias("term"), "canonical"), DIMENSION_ROWS), "term", "left")
    whole = own.withColumn("canonical", F.coalesce("canonical", "term"))
    return whole.join(names, "canonical", "left").withColumn("name", F.coalesce("name", "term")).drop("canonical").distinct()


def keyword_gaps(wanted: DataFrame, found: DataFrame, offers: DataFrame, cvs: DataFrame, offer: str, cv: str, text: str, most: int = 5) -> DataFrame:
    """``cv, offer, term, kind, n, salience, status, rank_no``: the ``most`` terms of each offer that a CV doesn't cover.

    Required terms come before wished ones, then those the offer says most
    often, then by salience. ``status`` is "addable" where the CV's text holds
    the term as words, else "missing". ``cvs`` is a stated set of queries: all
    offers meet each of them.
    """
    from jobweave.operators.offers import frequency

    rated = _rated(wanted, offers, offer, text)
    # A CV that holds a term holds its first word: that is the key, and the whole term is verified.
    word = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}+#]+"), 0)
    asked = rated.select("term").distinct().select("term", F.try_element_at(word("term"), F.lit(1)).alias("__word"))
    said = cvs.select(cv, F.explode(F.array_distinct(word(text))).alias("__word"))
    held = asked.join(said, "__word").join(cvs.select(cv, F.col(text).alias("__cv")), cv).where(frequency(F.col("term"), F.col("__cv")) > 0)
    stated = broadcast_if_small(cvs.select(cv).distinct(), STATED_ROWS)
    pairs = rated.crossJoin(stated).join(found.select(cv, "term"), [cv, "term"], "left_anti").join(held.select(cv, "term", F.lit(True).alias("held")), [cv, "term"], "left")
    order = Window.partitionBy(cv, offer).orderBy("kind", F.desc("n"), F.desc("salience"), "term")
    status = F.when(F.coalesce("held", F.lit(False)), "addable").otherwise("missing")
    return pairs.withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= most).select(cv, offer, "term", "kind", "n", "salience", status.alias("status"), "rank_no")


def _rated(wanted: DataFrame, offers: DataFrame, offer: str, text: str) -> DataFrame:
    """``wanted`` with ``n``, how often the offer says the term, and ``salience``."""
    from jobweave.operators.offers import spaced, times

    total = F.size(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0))
    said = spread(offers.select(offer, text), offer).select(offer, spaced(F.col(text)).alias("__said"), total.alias("total"))
    rated = wanted.join(said, offer).withColumn("__term", spaced(F.col("term"))).withColumn("n", times(F.col("__term"), F.col("__said"))).drop("__said", "__term")
    tf, idf = F.col("n") / F.greatest("total", F.lit(1)), F.log((F.col("total") + 1) / (F.col("n") + 1)) + 1
    return rated.withColumn("salience", F.round(F.least(F.lit(1.0), tf * idf * 10), 6)).drop("total")


def stated_gaps(wanted: DataFrame, offered: DataFrame, aliases: DataFrame, offers: DataFrame, cvs: DataFrame, offer: str, cv: str, text: str, most: int = 5) -> DataFrame:
    """``keyword_gaps`` of what ``covered_terms`` without other spellings finds, for stated CVs: nothing but each offer's terms is moved.

    An offer's terms stand in one order for all CVs. Going through them, a bit for each CV tells
    whether it lacks a first, a second ... term so far; the rows of a term are the CVs for which it is the next.
    """
    from jobweave.operators.offers import spaced

    offered = checkpoint(offered)
    numbers = broadcast_if_small(numbered(cvs.select(cv, spaced(F.col(text)).alias("__cv")), cv), STATED_ROWS)
    token = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}+#]+"), 0))
    mark = lambda x: F.concat(F.lit(MARK), x)
    longest = F.array_max(F.transform(token("term"), lambda x: F.struct(F.length(x).alias("n"), x.alias("word"))))["word"]
    zero, ones = F.lit(0).cast("bigint"), F.lit(-1).cast("bigint")
    names = word_bits(offered, aliases, numbers, cv).where(F.col("alias") != 0).select("term", "block", "alias", zero.alias("held"))
    said = bits_of(cvs.select(cv, F.explode(token(text)).alias("term")), numbers, cv).select(mark(F.col("term")), "block", zero, "bits")
    # Terms that no CV of a block covers have rows for it too.
    blocks = numbers.select("block").distinct().select(F.lit(MARK), "block", zero, zero)
    words = broadcast_if_small(names.union(said).union(blocks), WORD_ROWS)
    parts = F.array_distinct(F.concat(F.array("term"), F.split("term", r"\s+"), F.array(mark(longest), F.lit(MARK))))
    each = _rated(wanted, offers, offer, text).select(offer, "kind", "n", "salience", F.col("term").alias("__term"), F.explode(parts).alias("term"))
    by = [offer, "block", "kind", "n", "salience", "__term"]
    found = each.join(words, "term").groupBy(*by).agg(F.bit_or("alias").alias("covered"), F.bit_or("held").alias("held"))
    # Who holds the longest word of a term may hold the term; its text tells.
    term = F.struct("kind", (-F.col("n")).alias("less_n"), (-F.col("salience")).alias("less_salience"), F.col("__term").alias("term"), F.bitwise_not("covered").alias("lacking"), "held")
    lists = found.groupBy(offer, "block").agg(F.array_sort(F.collect_list(term)).alias("terms"))

    def step(done, x):
        before = lambda r: F.when(r == 0, ones).otherwise(F.get(done["lacks"], r - 1)).bitwiseAND(x["lacking"])
        now = F.transform(done["lacks"], lambda v, r: before(r).bitwiseAND(F.bitwise_not(v)))
        return F.struct(F.transform(done["lacks"], lambda v, r: v.bitwiseOR(before(r))).alias("lacks"), F.concat(done["places"], F.array(now)).alias("places"))

    start = F.struct(F.array_repeat(zero, most).alias("lacks"), F.array().cast("array<array<bigint>>").alias("places"))
    placed = lists.select(offer, "block", "terms", F.aggregate("terms", start, step, lambda x: x["places"]).alias("places"))
    rows = placed.select(offer, "block", F.inline(F.arrays_zip("terms", "places"))).select(offer, "block", "terms.*", F.posexplode("places").alias("place", "bits")).where("bits <> 0")
    pairs = rows.join(numbers, "block").where(has(F.col("bits"), F.col("bit")))
    status = F.when(has(F.col("held"), F.col("bit")) & F.contains("__cv", spaced(F.col("term"))), "addable").otherwise("missing")
    return pairs.select(cv, offer, "term", "kind", (-F.col("less_n")).alias("n"), (-F.col("less_salience")).alias("salience"), status.alias("status"), (F.col("place") + 1).alias("rank_no"))


def level_rank(text: Column) -> Column:
    """Rank of the first level word in a text, or null."""
    word = F.regexp_extract(fold(text), r"\b(junior|senior|lead|principal|stagiaire|stage|confirme)\b", 1)
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv)), word)


def synonyms(spark: SparkSession) -> DataFrame:
    """``alias, canonical`` of SYNONYMS; an alias of two names stands for the first."""
    return spark.createDataFrame([(a, k) for k, names in SYNONYMS.items() for a in names.split("|")], "alias string, canonical string")


def phrases_of(cvs: DataFrame, key: str, text: str, aliases: DataFrame) -> DataFrame:
    """``key, term``: names of skills in more than one word that a CV holds; ``aliases`` are at most DIMENSION_ROWS."""
    rows = aliases.limit(DIMENSION_ROWS + 1).collect()
    if len(rows) > DIMENSION_ROWS:
        raise ValueError(f"more than {DIMENSION_ROWS} names")
    names = sorted({n for r in rows for n in r if " " in n})
    if not names:
        return cvs.select(key, F.lit("").alias("term")).limit(0)
    words = F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}+#/.-]*[\p{L}\p{N}+#]"), 0), " ")
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    return cvs.select(key, F.explode(F.filter(F.lit(names), lambda n: padded.contains(F.concat(F.lit(" "), n, F.lit(" "))))).alias("term")).distinct()


def common_length(x: str, y: str) -> int:
    """Length of the longest common subsequence, a bit for each character of ``x``."""
    places: dict[str, int] = {}
    for k, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << k
    whole = (1 << len(x)) - 1
    row = whole
    for c in y:
        both = row & places.get(c, 0)
        row = (row + both | row - both) & whole
    return len(x) - row.bit_count()


def token_set_share(x: str, y: str) -> float:
    """How alike two texts are as sets of words, 0 to 100: 100 where one has all words of the other.

    Else the best of: what only one of them has, compared by its characters
    in order and set against all of both texts; the shared words against either text.
    """
    a, b = set(x.split()), set(y.split())
    if not a or not b:
        return 0.0
    both = a & b
    if both and (both == a or both == b):
        return 100.0
    shared, p, q = len(" ".join(both)), " ".join(sorted(a - b)), " ".join(sorted(b - a))
    gap = 1 if both else 0
    one, two = shared + gap + len(p), shared + gap + len(q)
    apart = len(p) + len(q) - 2 * common_length(p, q)
    best = 100 * (1 - apart / (one + two))
    if both:
        best = max(best, *(100 * (1 - (gap + len(d)) / (shared + n)) for d, n in ((p, one), (q, two))))
    return best


def token_set_ratio(x: Column, y: Column) -> Column:
    """``token_set_share`` of two text columns, in Arrow batches; null where a text is null."""
    import pandas as pd

    def ratio(a, b):
        return pd.Series([None if p is None or q is None else token_set_share(p, q) for p, q in zip(a, b)], dtype="float64")

    # Annotations of this module are texts, which pandas_udf doesn't read.
    ratio.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(ratio, "double")(x, y)


def _common(pairs):
    """Twice the longest common subsequence over both lengths, of ``x`` and ``y``."""
    import pandas as pd

    for pdf in pairs:
        share = [2 * common_length(x, y) / (len(x) + len(y)) for x, y in zip(pdf["x"], pdf["y"])]
        yield pd.DataFrame({"asked": pdf["asked"], "term": pdf["y"], "share": pd.Series(share, dtype="float64", index=pdf.index)})


def spellings(asks: DataFrame, words: DataFrame) -> DataFrame:
    """``asked, term``: requirements (``asked``) and words (``term``) with at least SPELLING of their characters in common.

    Two texts that alike share a pair of neighbouring letters (or are equal), and their
    lengths differ by little, so both are the join's key and no pair is missed. The words come to
    the requirements, whose pairs are many times their size and aren't moved.
    """
    low, high = SPELLING / (2 - SPELLING), (2 - SPELLING) / SPELLING
    parts_of = lambda c, size: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (size - 1)), lambda k: F.substring(c, k, F.lit(size))))
    # A filter on requirements alone would be pushed below their shuffle, which is then made twice.
    x = asks.select(F.col("term").alias("asked"), F.array_join(F.array_sort(F.split("term", r"\s+")), " ").alias("x"))
    y = words.select(F.col("term").alias("y")).distinct().where(F.length("y") > 1).withColumn("n", F.length("y"))
    # Only lengths that words have: requirements may be whole sentences. Letters that no word of a length has aren't in common with any.
    lengths = y.select("n", F.explode(parts_of("y", 1)).alias("letter")).groupBy("n").agg(F.array_join(F.collect_set("letter"), "").alias("letters"))
    apart = F.length(F.call_function("translate", F.col("x"), F.col("letters"), F.lit("")))
    fits = F.col("n").between(F.length("x") * low - 1e-9, F.length("x") * high + 1e-9) & (apart <= F.length("x") - SPELLING / 2 * (F.length("x") + F.col("n")) + 1e-6)
    x = x.join(broadcast_if_small(lengths, DIMENSION_ROWS), fits)
    # Pairs of a long word don't hold it each; words of equal hash are told apart by their letters.
    pairs = y.select("n", F.xxhash64("y").alias("word"), F.explode(parts_of("y", 2)).alias("pair"))
    met = x.withColumn("pair", F.explode(parts_of("x", 2))).join(broadcast_if_small(pairs, WORD_ROWS), ["pair", "n"]).select("asked", "x", "word")
    # As many letters as may be put in or left out bound the edits.
    close = F.levenshtein("x", "y") <= (1 - SPELLING) * (F.length("x") + F.length("y")) + 1e-9
    near = met.join(broadcast_if_small(y.select(F.xxhash64("y").alias("word"), "y"), WORD_ROWS), "word").where(close).select("asked", "x", "y").distinct()
    return near.mapInPandas(_common, "asked string, term string, share double").where(F.col("share") >= SPELLING - 1e-9).select("asked", "term")


def numbered(cvs: DataFrame, cv: str) -> DataFrame:
    """``cvs`` with ``block, bit``: BITS of them to a block."""
    n = F.row_number().over(Window.orderBy(cv)) - 1
    return cvs.withColumn("bit", n).withColumn("block", F.floor(F.col("bit") / BITS).cast("int")).withColumn("bit", F.col("bit") % BITS)


def bits_of(terms: DataFrame, numbers: DataFrame, cv: str) -> DataFrame:
    """``term, block, bits``: the CVs of each term, as bits."""
    n = numbers.select(F.col(cv).alias("__cv"), "block", "bit")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit"))
    return terms.join(n, F.col(cv).eqNullSafe(F.col("__cv"))).groupBy("term", "block").agg(F.bit_or(one).alias("bits"))


def word_bits(offered: DataFrame, aliases: DataFrame, numbers: DataFrame, cv: str) -> DataFrame:
    """``term, block, exact, alias, near``: for each word, the CVs that hold it, that hold a name of it, and (words after MARK) that hold it or what it is a name of."""
    names = broadcast_if_small(aliases.select(F.col("alias").alias("term"), "canonical"), DIMENSION_ROWS)
    exact, known = bits_of(offered, numbers, cv), bits_of(canonical(offered, aliases), numbers, cv).select(F.col("term").alias("canonical"), "block", "bits")
    words = offered.select("term").union(aliases.select("alias")).union(aliases.select("canonical")).distinct()
    named = words.join(names, "term", "left").withColumn("canonical", F.coalesce("canonical", "term")).join(known, "canonical")
    kinds = [(exact, "term", "exact"), (named, "term", "alias"), (exact, F.concat(F.lit(MARK), F.col("term")), "near"), (known, F.concat(F.lit(MARK), F.col("canonical")), "near")]
    rows = [df.select(F.col(t).alias("term") if isinstance(t, str) else t.alias("term"), "block", *((F.col("bits") if k == kind else F.lit(0).cast("bigint")).alias(k) for k in ("exact", "alias", "near"))) for df, t, kind in kinds]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3]).groupBy("term", "block").agg(*(F.bit_or(k).alias(k) for k in ("exact", "alias", "near")))


def has(bits: Column, bit: Column) -> Column:
    return F.getbit(bits, bit) == 1


def covered_bits(wanted: DataFrame, keys: list[str], words: DataFrame, near: bool = False) -> DataFrame:
    """``keys, block, exact, alias, near`` of rows with a ``term``; rows stay in the part they are in."""
    parts = F.concat(F.array("term"), F.split("term", r"\s+"), *([F.coalesce("near", F.array().cast("array<string>"))] if near else []))
    each = wanted.select(*(F.col(k).alias(f"__{k}") for k in keys), F.explode(F.array_distinct(parts)).alias("term"))
    found = each.join(words, "term").groupBy(*(f"__{k}" for k in keys), "block").agg(*(F.bit_or(k).alias(k) for k in ("exact", "alias", "near")))
    return found.select(*(F.col(f"__{k}").alias(k) for k in keys), "block", "exact", "alias", "near")


def covered_terms(wanted: DataFrame, offered: DataFrame, aliases: DataFrame, cv: str, fuzzy: bool = True) -> DataFrame:
    """``cv, term, tier`` of every wanted term that a CV covers: ``exact`` (the term or one of its words), ``alias`` or ``fuzzy`` (another spelling).

    What a CV covers of a term doesn't depend on the offer, so terms are
    compared once for all offers. Terms not covered have no row. CVs are bits
    of numbers until the end: only the rows asked for are ever made one by one.
    """
    offered = checkpoint(offered)
    numbers = broadcast_if_small(numbered(offered.select(cv).distinct(), cv), STATED_ROWS)
    words = broadcast_if_small(word_bits(offered, aliases, numbers, cv), WORD_ROWS)
    asks = spread(wanted.select("term"), "term").distinct()
    if fuzzy:
        both = offered.unionByName(canonical(offered, aliases)).distinct()
        near = spellings(asks, both).groupBy("asked").agg(F.collect_set(F.concat(F.lit(MARK), F.col("term"))).alias("near"))
        asks = asks.join(near.withColumnRenamed("asked", "term"), "term", "left")
    found = covered_bits(asks, ["term"], words, fuzzy)
    exact, alias, bit = F.col("exact"), F.col("alias"), F.col("bit")
    tier = F.when(has(exact, bit), "exact").when(has(alias, bit), "alias").otherwise("fuzzy")
    held = exact.bitwiseOR(alias).bitwiseOR(F.col("near"))
    return found.join(numbers, "block").where(has(held, bit)).select(cv, "term", tier.alias("tier"))


def all_scores(wanted: DataFrame, found: DataFrame, offers: DataFrame, cvs: DataFrame, offer: str, cv: str) -> DataFrame:
    """``cv, offer, score, missing_must`` of all offers and CVs with a covered term; the others' score is 0.

    ``offers`` and ``cvs`` tell a ``level`` (null: unknown); known levels that
    differ take a tenth off.
    """
    total = wanted.groupBy(offer).agg(F.sum((F.col("kind") == "must").cast("int")).alias("musts"), F.sum((F.col("kind") == "nice").cast("int")).alias("nices"))
    got = wanted.join(found, "term").groupBy(cv, offer).agg(F.sum((F.col("kind") == "must").cast("int")).alias("must"), F.sum((F.col("kind") == "nice").cast("int")).alias("nice"))
    rows = got.join(total, offer).join(offers.select(offer, F.col("level").alias("o")), offer).join(cvs.select(cv, F.col("level").alias("c")), cv)
    return _scored(rows, offer, cv)


def _scored(rows: DataFrame, offer: str, cv: str) -> DataFrame:
    share = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(0.0)
    fit = F.when(F.col("o") != F.col("c"), 0.9).otherwise(1.0)
    return rows.select(cv, offer, F.round(100 * (0.75 * share("must", "musts") + 0.25 * share("nice", "nices")) * fit, 2).alias("score"), (F.col("musts") - F.col("must")).alias("missing_must"))


def match_scores(wanted: DataFrame, offered: DataFrame, aliases: DataFrame, offers: DataFrame, cvs: DataFrame, offer: str, cv: str) -> DataFrame:
    """``all_scores`` of what ``covered_terms`` without other spellings finds, for stated CVs: nothing but each offer's terms is moved.

    The terms of an offer meet in one part, and its CVs are bits until they are counted.
    """
    offered = checkpoint(offered)
    numbers = broadcast_if_small(numbered(cvs.select(cv, F.col("level").alias("c")), cv), STATED_ROWS)
    words = broadcast_if_small(word_bits(offered, aliases, numbers, cv), WORD_ROWS)
    all_of = lambda kind: F.sum((F.col("kind") == kind).cast("int")).over(Window.partitionBy(offer))
    counted = wanted.withColumn("musts", all_of("must")).withColumn("nices", all_of("nice"))
    bits_by = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("alias")))
    found = covered_bits(counted, [offer, "term", "kind", "musts", "nices"], words)
    lists = found.groupBy(offer, "block", "musts", "nices").agg(bits_by("must").alias("must"), bits_by("nice").alias("nice"), F.bit_or("alias").alias("any"))
    rows = lists.join(offers.select(offer, F.col("level").alias("o")), offer).join(numbers, "block").where(has(F.col("any"), F.col("bit")))
    count = lambda c: F.size(F.filter(c, lambda x: has(x, F.col("bit")))).cast("bigint").alias(c)
    return _scored(rows.select(offer, cv, "o", "c", "musts", "nices", count("must"), count("nice")), offer, cv)


def level_fit(offers: DataFrame, cvs: DataFrame, offer: str, cv: str) -> DataFrame:
    """``offer, cv, fit``: whether a CV's level is under, over or equal to an offer's; "unknown" where either isn't told.

    ``cvs`` is a stated set of queries, which all offers meet.
    """
    stated = broadcast_if_small(cvs.select(cv, F.col("level").alias("c")), STATED_ROWS)
    o, c = F.col("level"), F.col("c")
    fit = F.when(o.isNull() | c.isNull(), "unknown").when(o == c, "match").when(c < o, "under").otherwise("over")
    return spread(offers.select(offer, "level"), offer).crossJoin(stated).select(offer, cv, fit.alias("fit"))
