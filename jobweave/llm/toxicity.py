"""Abusive, hateful or sexual content, scored with class-conditional Kneser-Ney models.

Texts are undisguised (look-alike letters, hidden characters, leet digits,
letter-spacing, drawn-out letters, masked words) and cut into passages. Two
interpolated Kneser-Ney trigram models are fitted on a bounded sample of
labelled documents, one for abusive and one for ordinary passages; both back off
to one unigram distribution pooled over the classes, so an expression that is
rare in either is judged alike. A passage's score is the difference of its
log-likelihoods divided by its length; a document's is that of its worst passage.

A label belongs to a document, most of whose passages are ordinary even where it
is abusive. So fitting alternates: the abusive model learns from the passages
of abusive documents that the current models hold for abusive, at first the
worst one of each in any case. The threshold is set on held-out folds of the
sample; the seed passages are held out with it, so a few labels are enough to
set one, and there is no other rule for small samples.

The labelled sample is cut into passages by Spark, and the models of the folds
are fitted by parallel tasks. Scoring is one pass over the corpus without a shuffle.
"""

from __future__ import annotations

import html
import math
import pickle
import re
import unicodedata
import zlib
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled documents the models are fitted on: those of least hash of their id.
SAMPLE_ROWS = 20_000
ORDER, DISCOUNT = 3, 0.75
#: Words of a passage; longer sentences are cut into overlapping passages.
PASSAGE = 16
ROUNDS, FOLDS = 3, 4
#: Trigrams whose scores, and words whose normal forms, a task keeps at hand; others are computed again.
MEMO = 200_000

#: Cyrillic and Greek letters and the Latin letters they are mistaken for.
_LOOKALIKES = str.maketrans("аеорсухікмнтвԁѕјһԛԝαοερνιτκυАЕОРСУХІКМНТВЅЈΑΟΕΡΝΙΤΚΥΒΗΜΧ", "aeopcyxikmhtbdsjhqwaoepvitkuAEOPCYXIKMHTBSJAOEPNITKYBHMX")
_LEET = str.maketrans("013457@$!", "oieastasi")
_HIDDEN = re.compile("[\\u00ad\\u200b-\\u200f\\u2060\\ufeff]")
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h\d|tr|td)\b[^<>]*>|(?<=[.!?…])\s+|[\r\n]+|[;•]\s")
_TAG = re.compile(r"<[^<>]{0,200}>")
_SPACED = re.compile(r"(?<![\w'’])(?:\w(?:[.\-_*·] [.\-_*·]?|[ .\-_*·])){3,}\w(?![\w'’])")
_DRAWN = re.compile(r"([^\W\d_])\1{2,}")
_TOKEN = re.compile(r"(?:(?<!\w)[@$](?=\w))?[^\W_](?:[\w@$!*]*[\w$])?")
_NUMBERED = re.compile(r"\d+(?:e|er|re|eme|st|nd|rd|th|k|m|h|x)?")

#: Passages that stand for either class where labels are few; a parameter of ``fit``.
SEEDS = {
    True: "espèce d'idiot|tu es un imbécile|vous êtes des abrutis|ferme ta gueule|ferme-la, crétin|sale connard|pauvre débile|va te faire voir, ordure|"
    "je vais te tuer|je vais te faire regretter|tu vas le payer cher|je sais où tu habites, fais attention à toi|tu devrais mourir|"
    "les étrangers sont des parasites|les femmes sont inférieures|ces gens sont des animaux, qu'ils rentrent chez eux|"
    "envoie-moi une photo de toi nue|couche avec moi et tu auras le poste|déshabille-toi|"
    "you are an idiot|you stupid moron|shut up, you worthless piece of trash|what a pathetic loser|go to hell, bastard|you disgusting asshole|"
    "i will kill you|i will make you regret this|i know where you live, watch your back|you should die|nobody would miss you|"
    "immigrants are vermin|women are inferior|these people are animals and should go back home|keep those people out, they ruin everything|"
    "send me a nude picture|sleep with me and you get the job|take off your clothes for me",
    False: "notre charte interdit les insultes|la formation traite du harcèlement sexuel|nous modérons les contenus haineux|il faut tuer le processus|"
    "our policy forbids insults and harassment|the training covers sexual harassment and discrimination|we moderate hateful content|"
    "kill the process before you restart the server|pest control removed rats and vermin from the warehouse|women and foreigners are welcome|"
    "nous cherchons un ingénieur pour notre équipe|we are looking for an engineer to join our team|vous travaillez avec le service achats|"
    "you will work with the care team on the release process",
}


def undisguise(text: str) -> str:
    """The text as it is meant to be read; case and accents stay."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
        if re.search("[Ͱ-ӿԀ-ԯ]", text):
            # Only words that mix scripts, or stand alone among Latin words, are disguises.
            text = re.sub(r"\w*[Ͱ-ӿԀ-ԯ]\w*", lambda m: m[0].translate(_LOOKALIKES), text)
    if "&" in text:
        text = html.unescape(text)
    if _SPACED.search(text):
        text = _SPACED.sub(lambda m: re.sub(r"[ .\-_*·]", "", re.sub(r"[.\-_*·] [.\-_*·]", "\0", m[0])).replace("\0", " "), text)
    return _DRAWN.sub(r"\1", text)


def _word(token: str, first: bool) -> str:
    if token.isdigit():
        return "#"
    if "*" in token:
        return "<mask>"
    has_digit = any(c in "0123456789@$!" for c in token)
    if has_digit and not _NUMBERED.fullmatch(token.lower()) and len(token) >= 3 and any(c.isalpha() for c in token):
        token = token.rstrip("!").translate(_LEET)
    elif not first and token[0].isupper() and not token.isupper():
        return "<name>"
    token = token.casefold().replace("’", "'")
    if not token.isascii():
        token = "".join(c for c in unicodedata.normalize("NFKD", token) if not unicodedata.combining(c))
    return token if not token[0].isdigit() else "#"


def passages(text: str | None, memo: dict | None = None) -> list[tuple[str, ...]]:
    """Passages of a text as tuples of normalised words; names and numbers are one word each.

    ``memo`` keeps up to MEMO words as they were normalised, for the texts to come.
    """
    if not text or not text.strip():
        return []
    memo = {} if memo is None else memo

    def word(token: str, first: bool) -> str:
        found = memo.get((token, first))
        if found is None:
            found = _word(token, first)
            if len(memo) < MEMO:
                memo[token, first] = found
        return found

    out = []
    for piece in _BREAK.split(undisguise(text)):
        words = tuple(word(t, n == 0) for n, t in enumerate(_TOKEN.findall(_TAG.sub(" ", piece).replace("'", " ").replace("’", " "))))
        if len(words) > PASSAGE:
            out.extend(words[i : i + PASSAGE] for i in range(0, len(words) - PASSAGE // 2, PASSAGE // 2))
        elif words:
            out.append(words)
    return out


class KneserNey:
    """Interpolated Kneser-Ney model of word passages over a pooled unigram distribution."""

    def __init__(self, counts: Counter, base: dict[str, float], unseen: float) -> None:
        self.base, self.unseen = base, unseen
        grams: list[Counter] = [Counter() for _ in range(ORDER + 1)]
        for words, n in counts.items():
            padded = ("<s>",) * (ORDER - 1) + words + ("</s>",)
            for i in range(ORDER - 1, len(padded)):
                grams[ORDER][padded[i - ORDER + 1 : i + 1]] += n
        # Lower orders count the different words before, not occurrences.
        for k in range(ORDER - 1, 0, -1):
            for g in grams[k + 1]:
                grams[k][g[1:]] += 1
        self.grams = grams
        self.total: list[Counter] = [Counter() for _ in range(ORDER + 1)]
        self.kinds: list[Counter] = [Counter() for _ in range(ORDER + 1)]
        for k in range(1, ORDER + 1):
            for g, n in grams[k].items():
                self.total[k][g[:-1]] += n
                self.kinds[k][g[:-1]] += 1

    def prob(self, context: tuple[str, ...], word: str) -> float:
        p = self.base.get(word, self.unseen)
        for k in range(1, ORDER + 1):
            c = context[len(context) - k + 1 :] if k > 1 else ()
            total = self.total[k].get(c)
            if total:
                p = max(self.grams[k].get((*c, word), 0) - DISCOUNT, 0) / total + DISCOUNT * self.kinds[k][c] / total * p
        return p

    def loglik(self, words: tuple[str, ...]) -> float:
        padded = ("<s>",) * (ORDER - 1) + words + ("</s>",)
        return sum(math.log(self.prob(padded[i - ORDER + 1 : i], padded[i])) for i in range(ORDER - 1, len(padded)))


class Scorer:
    """Both models and the threshold; scores passages and texts."""

    def __init__(self, toxic: Counter, ordinary: Counter) -> None:
        pooled: Counter = Counter()
        for counts in (toxic, ordinary):
            mass = sum(n * (len(w) + 1) for w, n in counts.items()) or 1
            for words, n in counts.items():
                for w in (*words, "</s>"):
                    pooled[w] += n / mass / 2
        unseen = 1 / (len(pooled) + 1)
        base = {w: 0.9 * p + 0.1 * unseen for w, p in pooled.items()}
        self.toxic, self.ordinary = KneserNey(toxic, base, 0.1 * unseen), KneserNey(ordinary, base, 0.1 * unseen)
        self.threshold = 0.0
        self.memo: dict[tuple[str, ...], float] = {}
        self.words: dict[tuple[str, bool], str] = {}

    def trigram(self, gram: tuple[str, ...]) -> float:
        """Difference of the log-probabilities of a trigram's last word."""
        score = self.memo.get(gram)
        if score is None:
            score = math.log(self.toxic.prob(gram[:-1], gram[-1]) / self.ordinary.prob(gram[:-1], gram[-1]))
            if len(self.memo) < MEMO:
                self.memo[gram] = score
        return score

    def passage(self, words: tuple[str, ...]) -> float:
        padded = ("<s>",) * (ORDER - 1) + words + ("</s>",)
        return sum(map(self.trigram, zip(padded, padded[1:], padded[2:]))) / (len(words) + 1)

    def worst(self, found: list[tuple[str, ...]]) -> float | None:
        """Score of the worst passage; null where there is none. Passages of one or two words are judged with care."""
        return max((self.passage(w) * min(1.0, (len(w) + 1) / 4) for w in found), default=None)

    def text(self, text: str | None) -> float | None:
        return self.worst(passages(text, self.words))

    def __getstate__(self):
        return {**self.__dict__, "memo": {}, "words": {}}


#: A labelled document: its passages and whether it is abusive.
Doc = tuple[list[tuple[str, ...]], bool]


def _passages_by_class(docs: list[Doc], seeds: list[Doc]) -> tuple[Counter, Counter]:
    """Passages that teach the abusive and the ordinary model, with their counts."""
    seed = {k: Counter(p for ps, bad in seeds if bad == k for p in ps) for k in (True, False)}
    ordinary = Counter(p for ps, bad in docs if not bad for p in ps)
    abusive = [ps for ps, bad in docs if bad and ps]
    # Passages that ordinary documents hold as well teach the abusive model nothing.
    toxic = Counter(p for ps in abusive for p in set(ps) if p not in ordinary)
    scorer = Scorer(toxic + seed[True], ordinary + seed[False])
    for again in range(ROUNDS):
        if again:
            scorer = Scorer(*found)
        chosen: Counter = Counter()
        rest: Counter = Counter()
        for ps in abusive:
            ranked = sorted(((scorer.passage(p), p) for p in set(ps)), reverse=True)
            for n, (score, p) in enumerate(ranked):
                (chosen if score > 0.5 or (n == 0 and not again) else rest)[p] += 1
        found = chosen + seed[True], ordinary + rest + seed[False]
    return found


def seed_documents(seeds: dict[bool, str] = SEEDS) -> list[Doc]:
    return [(passages(t), bad) for bad, texts in seeds.items() for t in texts.split("|")]


def fold_of(doc: Doc) -> int:
    """The fold a document is held out in; equal texts are held out together."""
    return zlib.crc32("\n".join(" ".join(p) for p in doc[0]).encode("utf-8", "replace")) % FOLDS


def hold_out(docs: list[Doc], seeds: list[Doc], fold: int) -> list[tuple[float, bool, bool]]:
    """``score, abusive, is a seed`` of a fold's documents and seeds, by models fitted on the other folds."""
    part = Scorer(*_passages_by_class([d for d in docs if fold_of(d) != fold], [d for d in seeds if fold_of(d) != fold]))
    return [(s, bad, seed) for group, seed in ((docs, False), (seeds, True)) for ps, bad in group if fold_of((ps, bad)) == fold and (s := part.worst(ps)) is not None]


def tune(held: list[tuple[float, bool, bool]]) -> tuple[float, float]:
    """Threshold of greatest F1 over held-out documents, and that F1.

    The seeds of either class weigh as one labelled document together, so
    they decide only where there are no labels.
    """
    seeds = Counter(bad for _, bad, seed in held if seed)
    weigh = lambda bad, seed: 1 / seeds[bad] if seed else 1.0
    held = sorted(held, reverse=True)
    positives, hit, flagged, best = sum(weigh(bad, seed) for _, bad, seed in held if bad), 0.0, 0.0, (0.0, 0.0)
    for n, (s, bad, seed) in enumerate(held, 1):
        hit += weigh(bad, seed) * bad
        flagged += weigh(bad, seed)
        f1 = 2 * hit / (flagged + positives)
        if bad and f1 >= best[0]:
            below = next((x for x, _, _ in held[n:]), s)
            best = (f1, (s + max(below, s - 0.5)) / 2)
    return best[1], best[0]


def fit(labelled: list[tuple[str | None, int]], seeds: dict[bool, str] = SEEDS) -> Scorer:
    """Models and threshold from (text, abusive) pairs; without any, from the seed passages alone."""
    docs, own = [(passages(t), bool(b)) for t, b in labelled if t], seed_documents(seeds)
    scorer = Scorer(*_passages_by_class(docs, own))
    scorer.threshold, scorer.f1 = tune([x for k in range(FOLDS) for x in hold_out(docs, own, k)])
    return scorer


def fit_tables(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """``fit`` on at most ``sample_rows`` labelled documents; null labels are left out.

    Tasks cut the sample into passages; then one task sorts the passages of all
    of it by class, and one for each fold fits models on the other folds. The sample's bound
    bounds what the driver holds.
    """
    known = labels.where(F.col("abusive").isNotNull()).groupBy("doc_id").agg(F.max("abusive").alias("abusive"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)

    def cut(batches):
        memo: dict = {}
        for pdf in batches:
            yield pdf[["abusive"]].assign(found=[[" ".join(p) for p in passages(t, memo)] for t in pdf["text"]])

    sample = documents.where(F.col("text") != "").select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", F.col("abusive").cast("int").alias("abusive"))
    docs: list[Doc] = sorted(([tuple(p.split(" ")) for p in r.found], bool(r.abusive)) for r in sample.mapInPandas(cut, "abusive int, found array<string>").collect())
    seeds = seed_documents()

    def models(batches):
        import pandas as pd

        for pdf in batches:
            for fold in pdf["id"]:
                out = [dict(c) for c in _passages_by_class(docs, seeds)] if fold == FOLDS else hold_out(docs, seeds, int(fold))
                yield pd.DataFrame({"fold": [fold], "made": [zlib.compress(pickle.dumps(out), 1)]})

    made = {r.fold: pickle.loads(zlib.decompress(r.made)) for r in documents.sparkSession.range(0, FOLDS + 1, 1, FOLDS + 1).mapInPandas(models, "fold bigint, made binary").collect()}
    scorer = Scorer(*map(Counter, made[FOLDS]))
    scorer.threshold, scorer.f1 = tune([x for k in range(FOLDS) for x in made[k]])
    return scorer


def score(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, source, score, abusive`` of every document.

    Null, empty and blank texts get a null score and ``abusive`` false. Rows may
    repeat; extra columns are dropped. A missing ``source`` column is an error.
    """
    scorer = fit_tables(documents, labels, sample_rows)

    def run(batches):
        for pdf in batches:
            scores = [scorer.text(t) for t in pdf["text"]]
            yield pdf[["doc_id", "source"]].assign(score=scores, abusive=[s is not None and s >= scorer.threshold for s in scores])

    # Ids travel as texts: beside a null, whole numbers would become inexact ones.
    texts = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    scored = texts.mapInPandas(run, "doc_id string, source string, score double, abusive boolean")
    return scored.withColumn("doc_id", F.col("doc_id").cast(documents.schema["doc_id"].dataType))


def rates(scored: DataFrame) -> DataFrame:
    """``source, documents, abusive, rate`` for each source, null included."""
    return scored.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum(F.col("abusive").cast("bigint")).alias("abusive"), F.avg(F.col("abusive").cast("double")).alias("rate")
    )
