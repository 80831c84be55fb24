"""Free-entered headings to a canonical list, by a prefix-filtered similarity join.

A heading is normalised (mojibake, accents, case, letter-spacing, decoration),
so that rows collapse to distinct headings before anything is compared. Each
heading becomes a set of tokens: its letters, numbered where they repeat, and
its pairs of adjacent letters. Tokens are ordered by global rarity; two sets
can reach Jaccard similarity t only if they share one of their first
|x| - ceil(t|x|) + 1 tokens, so only these are joined. Lengths and positions
prune further, Jaccard is verified exactly, and the best entry is kept, else
the heading is reported as unmatched.

The reference side is the catalogue's labels, wordings learnt from the sections
themselves, and a thesaurus of other wordings for the catalogue's names
(``ALIASES``, a parameter). Learning: sections whose heading is a label teach a
naive Bayes model what the sections of each name hold; where the sections below
another heading hold the same, time and again, the heading is a wording of
that name. What the column ``name`` of the sections says is not used: where it
is a catalogue name at all, it is hardly ever the heading's.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.session import broadcast_if_small, checkpoint
from jobweave.text import fold, let

UNMATCHED = "unmatched"

#: Least Jaccard similarity of token sets.
THRESHOLD = 0.4

#: Most labelled sections the model is fitted on: those of least hash.
SAMPLE_ROWS = 20_000
#: Sections that a heading needs, and how sure the model must be of them on average, to be learnt as a wording.
LEAST_SECTIONS, LEAST_SURE = 3, 0.8
#: Most rows of the catalogue that are broadcast.
CATALOGUE_ROWS = 10_000

#: Other wordings of the catalogue's names, in four languages.
ALIASES = {
    "summary": "résumé du profil|accroche|qui suis-je|en bref|présentation|profil perso|mon profil en quelques mots|profil professionnel|"
    "about the candidate|my story in short|in a nutshell|personal statement|who I am|about me|professional summary|objective|über mich|perfil",
    "experience": "carrière|vie professionnelle|mes postes|emplois précédents|parcours|parcours pro|parcours professionnel|postes occupés|"
    "stages et emplois|exp. pro.|career overview|work hist.|previous jobs|where I've worked|jobs so far|prof. exp.|career history|"
    "employment history|positions held|professional experience|Berufserfahrung|experiencia laboral",
    "education": "parcours scolaire|cursus|études|form. initiale|mes études|scolarité|cursus universitaire|where I studied|educ.|studies|"
    "univ. & school|academic record|degrees|schooling|formation initiale|Ausbildung|estudios",
    "skills": "atouts techniques|logiciels maîtrisés|boîte à outils|savoir-faire|environnement technique|comp. tech.|ce que je sais faire|"
    "tools & technologies|what I'm good at|expertise|toolbox|know-how|tech stack|core strengths|Kenntnisse|competencias",
    "certifications": "habilitations obtenues|attestations|certifs|titres et certificats|accreditations|badges & certificates|"
    "professional licences|certs|Zertifikate|certificados",
    "languages": "langues étrangères|niveau de langue|langues parlées|je parle|tongues I speak|lang.|spoken languages|language proficiency|"
    "Sprachen|idiomas",
    "projects": "portfolio|réalisations marquantes|projets perso|projets personnels|mes réalisations|selected work|things I built|"
    "portfolio of work|side projects|Projekte|proyectos",
    "interests": "mes hobbies|passions|hors travail|temps libre|activités extra-pro|what I do for fun|outside work|free time|leisure|"
    "Freizeit|aficiones",
    "references": "recommandations|personnes à contacter|ils peuvent parler de moi|referees|contacts for reference|"
    "people who can vouch for me|Referenzen|referencias",
    "volunteering": "vie associative|engagement associatif|actions solidaires|charity involvement|community work|unpaid work|Ehrenamt|voluntariado",
    "publications": "bibliographie|travaux publiés|articles parus|papers|published articles|writing credits|Veröffentlichungen|publicaciones",
    "awards": "prix et médailles|prix reçus|récompenses|honours|prizes won|recognition|Auszeichnungen|premios",
}

#: Printed forms of the bytes 80 to 9f in Windows-1252, and these bytes in ISO 8859-1.
_CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_LATIN1 = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"


def normalise(heading: Column) -> Column:
    """Lower-case letters, digits, "&" and apostrophes, single blanks; '' where nothing is left.

    Removes decoration: bullets, brackets, numbering, ranges of years, and
    notes such as "(continued)" or "/ détail". Letter-spaced words are closed
    up. Look-alikes that typists and scanners mix up (0/o, 1/l/i) become one letter.
    """
    return let(let(let(heading, _repaired), _folded), _undecorated)


def _repaired(h: Column) -> Column:
    """Text that was UTF-8 but read as Windows-1252 shows tell-tale letters; it is read again, where that gives valid text."""
    as_bytes = F.translate(h, _CP1252, _LATIN1)
    again = F.try_validate_utf8(F.encode(as_bytes, "ISO-8859-1").cast("string"))
    return F.when(h.rlike("[ÃÂâÅ]"), F.coalesce(F.when(~as_bytes.rlike(r"[^\x00-\xff]"), again), h)).otherwise(h)


def _folded(h: Column) -> Column:
    h = F.translate(fold(h), "’ʼ`´", "''''")
    return F.replace(F.replace(h, F.lit("œ"), F.lit("oe")), F.lit("ß"), F.lit("ss"))


def _undecorated(h: Column) -> Column:
    spaced = h.rlike(r"^\s*\S(?:\s\S)*(?:\s{2,}\S(?:\s\S)*)*\s*$") & h.rlike(r"(?:^|\s)\S\s\S(?:\s|$)")
    h = F.when(spaced, F.regexp_replace(h, r"(?<=\S)\s(?=\S)", "")).otherwise(h)
    h = F.regexp_replace(h, r"\((?:continued|suite|cont\.?|cont'd)\)|[-–/]\s*(?:overview|detail|details|suite)\b|\b(?:19|20)\d\d\s*[-–]\s*(?:19|20)\d\d\b", " ")
    h = F.regexp_replace(h, r"^\s*(?:[0-9]{1,2}|[ivx]{1,4})\s*[.)/:-]\s*", " ")
    h = F.translate(h, "01i", "oll")
    return F.trim(F.regexp_replace(F.regexp_replace(h, r"[^\p{L}\p{N}&' ]", " "), r"\s+", " "))


def tokens(norm: Column) -> Column:
    """Set of a normalised heading's tokens: numbered letters and pairs of adjacent letters (ends count as letters)."""
    def build(chars: Column) -> Column:
        numbered = F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string")))
        pairs = F.zip_with(F.concat(F.array(F.lit("^")), chars), F.concat(chars, F.array(F.lit("$"))), lambda a, b: F.concat(F.lit("~"), a, b))
        return F.array_distinct(F.concat(numbered, pairs))

    chars = F.filter(F.split(F.replace(norm, F.lit(" "), F.lit("_")), ""), lambda c: c != "")
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(let(chars, build))


def similarity_join(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD, edits: Callable[[Column], Column] | None = None) -> DataFrame:
    """``l, r, lt, rt, jaccard``: all pairs of ``left.l`` and ``right.r`` with Jaccard of ``lt``, ``rt`` >= threshold.

    ``l`` and ``r`` are distinct keys. Exact: prefix, length and position
    filters drop no pair that reaches the threshold. Empty sets match nothing.
    With ``edits``, which bounds the edit distance that is of use by the longer
    key's length, pairs of keys whose lengths differ by more are left out.
    """
    t = F.lit(threshold)
    everything = left.select(F.lit("l").alias("side"), F.col("l").alias("key"), F.col("lt").alias("toks")).unionByName(
        right.select(F.lit("r").alias("side"), F.col("r").alias("key"), F.col("rt").alias("toks"))
    )
    each = everything.select("side", "key", F.explode("toks").alias("tok"))
    rarity = each.groupBy("tok").count()
    # Rows are few bytes but much work: a fixed number of partitions keeps them from being merged into one task.
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        each.join(rarity, "tok")
        .groupBy("side", "key")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("count", "tok"))), lambda x: x["tok"]).alias("toks"))
        .repartition(n, "side", "key")
        .withColumn("n", F.size("toks"))
        .withColumn("prefix", F.slice("toks", F.lit(1), (F.col("n") - F.ceil(t * F.col("n") - 1e-9) + 1).cast("int")))
    )

    def side(name: str) -> DataFrame:
        # Pairs are made of hashes; where two keys had one, verification would tell them apart.
        return ordered.where(F.col("side") == name).select(
            F.xxhash64("key").alias(f"{name}h"), F.length("key").alias(f"{name}c"), F.col("n").alias(f"{name}n"), F.posexplode("prefix").alias(f"{name}p", "tok")
        )

    need = F.ceil(t / (1 + t) * (F.col("ln") + F.col("rn")) - 1e-9)
    left_over = 1 + F.least(F.col("ln") - F.col("lp"), F.col("rn") - F.col("rp")) - 1
    hashed = lambda df, name: df.select(F.xxhash64(name).alias(f"{name}h"), name, f"{name}t")
    candidates = (
        side("l").join(side("r"), "tok")
        .where((F.col("rn") >= t * F.col("ln") - 1e-9) & (F.col("ln") >= t * F.col("rn") - 1e-9))
        # Tokens before a shared one may be shared too, but no more than the lesser position.
        .where(F.least("lp", "rp") + left_over >= need)
        .where(F.abs(F.col("lc") - F.col("rc")) <= edits(F.greatest("lc", "rc")) if edits else F.lit(True))
        .select("lh", "rh").distinct().repartition(n, "lh").join(hashed(left, "l"), "lh").join(hashed(right, "r"), "rh")
    )
    shared = F.size(F.array_intersect("lt", "rt"))
    return candidates.select("l", "r", "lt", "rt", (shared / (F.size("lt") + F.size("rt") - shared)).alias("jaccard")).where(F.col("jaccard") >= t - 1e-9)


_TOKEN = re.compile(r"[^\W\d_]{2,}|\d+|[•@–:,-]")
_SHAPE = (re.compile(r"[A-ZÀ-Ý][a-zß-ÿ]+"), re.compile(r"\b[a-zß-ÿ]+\b"), re.compile(r"\d+"))


def features(text: str | None) -> set[str]:
    """What a section's text shows: its words, numbers and signs, the number and shapes of its lines, its length."""
    lines = [x for x in (text or "").splitlines() if x.strip()]
    found = {"w" + ("#" if x.isdigit() else x) for x in _TOKEN.findall((text or "").lower())}
    for x in lines:
        shape = _SHAPE[2].sub("9", _SHAPE[1].sub("a", _SHAPE[0].sub("A", x)))
        found.add("s" + shape[:12])
    return found | {f"n{min(5, len(lines))}", f"c{min(8, len(text or '') // 40)}"}


class Contents:
    """Naive Bayes over the features of sections, with a flat prior over the names."""

    def __init__(self, labelled: list[tuple[str, str]]) -> None:
        import numpy as np

        self.names = sorted({name for name, _ in labelled})
        place = {name: k for k, name in enumerate(self.names)}
        self.index: dict[str, int] = {}
        counts: list = []
        for name, text in labelled:
            for f in features(text):
                k = self.index.setdefault(f, len(self.index))
                if k == len(counts):
                    counts.append(np.zeros(len(self.names)))
                counts[k][place[name]] += 1
        rows = np.bincount([place[name] for name, _ in labelled], minlength=len(self.names))
        self.weights = np.log((np.array(counts).reshape(-1, len(self.names)) + 0.5) / (rows + 1))
        # A feature that no labelled section has.
        self.unseen = np.log(0.5 / (rows + 1))

    def judge(self, text: str | None) -> tuple[str, float]:
        """The likeliest name, and its probability."""
        import numpy as np

        found = features(text)
        known = [self.index[f] for f in found if f in self.index]
        odds = self.weights[known].sum(axis=0) + (len(found) - len(known)) * self.unseen
        odds = np.exp(odds - odds.max())
        best = int(odds.argmax())
        return self.names[best], float(odds[best] / odds.sum())


def typed_forms(sections: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``raw_heading, l``: the different headings that aren't a label as they stand, and what they are normalised to."""
    exact = catalogue.select(F.col("label").alias("raw_heading")).where(F.col("raw_heading").isNotNull()).distinct()
    n = int(sections.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    forms = sections.select("raw_heading").where(F.col("raw_heading").isNotNull()).distinct().join(broadcast_if_small(exact, CATALOGUE_ROWS), "raw_heading", "left_anti")
    return checkpoint(forms.repartition(n, "raw_heading").select("raw_heading", normalise(F.col("raw_heading")).alias("l")))


def learnt_entries(sections: DataFrame, catalogue: DataFrame, forms: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``r, name``: normalised headings (of ``forms``) that stand, over and over, above sections such as a name's.

    The model is fitted on at most ``sample_rows`` sections with a label as
    heading and applied to all others. A repeated row counts once; sections without text
    say nothing. Without labelled sections nothing is learnt.
    """
    labels = catalogue.where(F.col("label").isNotNull()).groupBy(F.col("label").alias("raw_heading")).agg(F.min("name").alias("name"))
    labels = broadcast_if_small(labels, CATALOGUE_ROWS)
    told = sections.where(F.col("raw_heading").isNotNull() & F.col("text").rlike(r"\S")).select("cv_id", "section_no", "raw_heading", F.col("text").cast("string").alias("text"))
    sample = told.join(labels, "raw_heading").select("name", "text").orderBy(F.xxhash64("name", "text"), "name", "text").limit(sample_rows)
    labelled = [(r.name, r.text) for r in sample.collect()]
    spark = catalogue.sparkSession
    if not labelled:
        return spark.createDataFrame([], "r string, name string")
    model = Contents(labelled)

    def run(batches):
        for pdf in batches:
            judged = [model.judge(t) for t in pdf["text"]]
            yield pdf[["cv_id", "section_no", "r"]].assign(name=[n for n, _ in judged], sure=[p for _, p in judged])

    # Ids travel as texts: beside a null, whole numbers would become inexact ones.
    ids = [F.col(c).cast("string").alias(c) for c in ("cv_id", "section_no")]
    rest = told.join(forms.where(F.col("l") != ""), "raw_heading").select(*ids, F.col("l").alias("r"), "text")
    votes = rest.mapInPandas(run, "cv_id string, section_no string, r string, name string, sure double").groupBy("r", "cv_id", "section_no").agg(F.max_by(F.struct("name", "sure"), F.struct("sure", "name")).alias("v"))
    each = votes.groupBy("r", F.col("v.name").alias("name")).agg(F.sum("v.sure").alias("sure"), F.count("*").alias("n"))
    whole = each.groupBy("r").agg(F.max_by(F.struct("name", "sure"), F.struct("sure", "name")).alias("best"), F.sum("n").alias("n"))
    return whole.where((F.col("n") >= LEAST_SECTIONS) & (F.col("best.sure") >= LEAST_SURE * F.col("n"))).select("r", "best.name")


def catalogue_entries(catalogue: DataFrame, aliases: dict[str, str] = ALIASES, learnt: DataFrame | None = None) -> DataFrame:
    """``r, name``: normalised wordings; labels come before learnt wordings, these before the thesaurus."""
    spark = catalogue.sparkSession
    labels = catalogue.where(F.col("label").isNotNull()).select(normalise(F.col("label")).alias("r"), "name", F.lit(0).alias("rank"))
    more = spark.createDataFrame([(a, n) for n, v in aliases.items() for a in v.split("|")], "label string, name string")
    more = more.join(catalogue.select("name").distinct(), "name", "left_semi").select(normalise(F.col("label")).alias("r"), "name", F.lit(2).alias("rank"))
    every = labels.unionByName(more)
    if learnt is not None:
        every = every.unionByName(learnt.select("r", "name", F.lit(1).alias("rank")))
    return every.where(F.col("r") != "").groupBy("r").agg(F.min_by("name", F.struct("rank", "name")).alias("name"))


def _plausible() -> Column:
    """Verification beyond the similarity: one edit for each started four letters, or nearly the same letters in disorder."""
    same = F.size(F.filter(F.array_intersect("lt", "rt"), lambda x: ~x.startswith("~")))
    longest = F.greatest(F.length("r"), F.length("l"))
    return (F.levenshtein("l", "r") <= 1 + longest / 4) | ((same >= 0.75 * longest) & (F.levenshtein("l", "r") <= _most_edits(longest)) & (longest >= 5))


def _most_edits(longest: Column) -> Column:
    return 2 + longest / 4


def map_headings(sections: DataFrame, catalogue: DataFrame, threshold: float = THRESHOLD, aliases: dict[str, str] = ALIASES, learn: bool = True) -> DataFrame:
    """``cv_id, section_no, name`` for every heading that isn't a label as it stands; distinct rows.

    Null headings are no cases; empty ones and such without letters are
    ``unmatched``. Ties go to the lesser edit distance, then to the first
    wording in alphabetical order. An empty catalogue leaves all unmatched.
    Wordings are learnt where ``sections`` has a column ``text``. Extra columns
    of both tables are not looked at.
    """
    forms = typed_forms(sections, catalogue)
    rows = sections.select("cv_id", "section_no", "raw_heading").join(forms, "raw_heading").select("cv_id", "section_no", "l").distinct()
    left = forms.select("l").distinct().where(F.col("l") != "").withColumn("lt", tokens(F.col("l")))
    learnt = checkpoint(learnt_entries(sections, catalogue, forms)) if learn and "text" in sections.columns else None
    entries = catalogue_entries(catalogue, aliases, learnt)
    right = entries.withColumn("rt", tokens(F.col("r")))
    pairs = similarity_join(left, right, threshold, _most_edits).join(entries, "r")
    pairs = pairs.where(_plausible())
    best = pairs.groupBy("l").agg(F.min_by("name", F.struct(-F.col("jaccard"), F.levenshtein("l", "r"), "r")).alias("name"))
    return rows.join(best, "l", "left").select("cv_id", "section_no", F.coalesce("name", F.lit(UNMATCHED)).alias("name")).distinct()
