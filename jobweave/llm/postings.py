"""What a job posting says about its vacancy: employer, post, level, place, and names in its text.

Titles, employers and places are read against small vocabularies in French and
English, with single typing errors corrected, so that wordings in either
language come to the same codes. One pass in Arrow batches, no shuffle.
"""

from __future__ import annotations

import difflib
import hashlib
import html
import re
import unicodedata
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Occupations: French / English wordings.
ROLES = """administrateur bases donnees/database administrator;administrateur reseau/network administrator;actuaire/actuary;geometre/surveyor;
conseiller clientele/customer advisor;responsable comptes/account manager;responsable conformite/compliance officer;
developpeur front-end/frontend developer;charge recrutement/recruiter;charge contenu/content editor;juriste/legal counsel;scrum master;
gestionnaire paie/payroll officer;ingenieur mecanique/mechanical engineer;redacteur technique/technical writer;
developpeur full stack/full stack developer;assistant direction/executive assistant;ingenieur devops/devops engineer;
controleur gestion/financial controller;ingenieur qualite logicielle/qa engineer;technicien laboratoire/lab technician;
ingenieur support/support engineer;developpeur backend/backend developer;ingenieur avant-vente/sales engineer;
charge marketing/marketing officer;ingenieur fiabilite/site reliability engineer;designer ux/ux designer;kinesitherapeute/physiotherapist;
formateur/trainer;chef produit/product manager;ingenieur cloud/cloud engineer;analyste donnees/data analyst;analyste risques/risk analyst;
developpeur mobile/mobile developer;comptable/accountant;conducteur travaux/site manager;analyste metier/business analyst;
receptionniste/receptionist;graphiste/graphic designer;architecte solutions/solution architect;consultant energie/energy consultant;
chef partie;partenaire rh/hr business partner;pharmacien/pharmacist;infirmier/nurse;ingenieur systemes embarques/embedded engineer;
chef projet/project manager;responsable qualite/quality manager;ingenieur genie civil/civil engineer;
technicien maintenance/maintenance technician;ingenieur machine learning/machine learning engineer;ingenieur procedes/process engineer;
responsable entrepot/warehouse supervisor;ingenieur electrique/electrical engineer;responsable magasin/store manager;
ingenieur securite/security engineer;ingenieur data/data engineer;coordinateur logistique/logistics coordinator;acheteur/buyer;
scientifique donnees/data scientist"""

#: Fields of work: French / English.
FIELDS = """facturation/billing;reporting;froid/cold storage;archives;terrain/field ops;messagerie/messaging;flotte/fleet;immobilier/property;
integration/onboarding;reservation/booking;credit;fidelite/loyalty;chaine logistique/supply chain;ateliers/workshops;appels offres/tenders;
recherche/search;imagerie/imaging;paiement/payments;catalogue;sinistres/claims;fraude/fraud;abonnements/subscriptions;identite/identity;
billetterie/ticketing;douanes/customs;tarification/pricing;stocks/inventory;comptage/metering;retours/returns;epargne/savings"""

#: Branches: French / English.
BRANCHES = """gros/wholesale;automobile/automotive;ferroviaire/rail;agricole/agriculture;enseignement/education;b2b;maritime;temps reel/real time;
hotellerie/hospitality;telecom;grands comptes/enterprise;energie/energy;international;btp/construction;luxe/luxury;sante/healthcare;
aerien/aviation;alimentaire/grocery;assurance/insurance;secteur public/public sector"""

#: Levels: wordings by level; none of them is the middle level.
LEVELS = {"junior": "junior jr debutant debutante", "senior": "senior sr confirme confirmee", "lead": "lead led principal principale"}

#: Words that stand for one another in titles, abbreviations included.
SAME = {
    "eng": "ingenieur ingenieure engineer ing eng", "dev": "developpeur developpeuse developer dev", "admin": "administrateur administrator admin administratrice",
    "tech": "technicien technicienne technician technical technique tech", "resp": "responsable resp", "mgr": "manager mgr", "charge": "charge chargee ch",
    "asst": "assistant assistante asst", "frontend": "front-end frontend", "backend": "back-end backend", "coord": "coordinateur coordinator coord",
    "consultant": "consultant consultante cons", "analyst": "analyste analyst", "architect": "architecte architect",
}

#: Places: city (other spellings) - region codes - country.
PLACES = """paris,ile de france,fr;lyon,auvergne rhone alpes,fr;marseille,provence alpes cote d azur,fr;toulouse,occitanie,fr;nantes,pays de la loire,fr;
rennes,bretagne,fr;lille,hauts de france,fr;bordeaux,nouvelle aquitaine,fr;strasbourg,grand est,fr;nice,provence alpes cote d azur,fr;
montpellier,occitanie,fr;angers,pays de la loire,fr;le havre,normandie,fr;reims,grand est,fr;grenoble,auvergne rhone alpes,fr;
saint etienne,auvergne rhone alpes,fr;dijon,bourgogne franche comte,fr;nimes,occitanie,fr;brest,bretagne,fr;clermont ferrand,auvergne rhone alpes,fr;
amiens,hauts de france,fr;tours,centre val de loire,fr;limoges,nouvelle aquitaine,fr;luxembourg,luxembourg,lu;orleans,centre val de loire,fr;
annecy,auvergne rhone alpes,fr;besancon,bourgogne franche comte,fr;nancy,grand est,fr;rouen,normandie,fr;pau,nouvelle aquitaine,fr;
argenteuil,ile de france,fr;saint denis,ile de france,fr;mulhouse,grand est,fr;caen,normandie,fr;poitiers,nouvelle aquitaine,fr;metz,grand est,fr;
la rochelle,nouvelle aquitaine,fr;troyes,grand est,fr;montreuil,ile de france,fr;valence,auvergne rhone alpes,fr;vannes,bretagne,fr;
laval,pays de la loire,fr;chambery,auvergne rhone alpes,fr;niort,nouvelle aquitaine,fr;manchester,england,gb;glasgow,scotland,gb;sheffield,england,gb;
london|londres,england,gb;leeds,england,gb;bristol,england,gb;nottingham,england,gb;cardiff,wales,gb;liverpool,england,gb;leicester,england,gb;
brighton,england,gb;newcastle,england,gb;edinburgh|edimbourg,scotland,gb;belfast,northern ireland,gb;portland,or,us;columbus,oh,us;new york,ny,us;
seattle,wa,us;nashville,tn,us;denver,co,us;raleigh,nc,us;atlanta,ga,us;austin,tx,us;chicago,il,us;phoenix,az,us;philadelphia|philadelphie,pa,us;
miami,fl,us;san diego,ca,us;boston,ma,us;pittsburgh,pa,us;geneva|geneve,ge,ch;lausanne,vd,ch;dublin,leinster,ie;montreal,qc,ca;toronto,on,ca;
vancouver,bc,ca;brussels|bruxelles,bruxelles,be"""

#: Words around an employer's name that don't tell employers apart.
LEGAL = frozenset("sas sa sarl sasu s.a.s inc llc ltd plc limited gmbh group groupe societe the international france europe uk company cie co".split())

_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
_TAGS = re.compile(r"<[^<>]{0,200}>")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_ALNUM = re.compile(r"[^\W_]+")
_INNER_CAP = re.compile(r"(?<=[^.!?…\s]\s)[A-ZÀ-Ý][a-zß-ÿ]{5,}\b")
_CAP = re.compile(r"\b[A-ZÀ-Ý][a-zß-ÿ]{5,}\b")
_HEAD_TITLE = re.compile(r"(?:\s:\s?|: |\()([^:()]+)\)?[.\s]*$")
#: Words around a title that say nothing about the post.
_NOISE = frozenset("h f m x de des du la le les et and the of en cdi cdd urgent permanent temps plein ref reposted relance mi hf fh mfx nouveau new".split())
_WITHHELD = re.compile(r"(?i)\s*(?:n/?[ac]|-+|\?+|none|null|unknown|confidenti\w+|anonym\w*|(?:notre|our|un|a)\s+clients?|clients?|(?:entreprise|employeur|soci[ée]t[ée]|company|employer)\s+(?:confidenti|anonym|non)\w*.*)\s*")
_PROGRAMME = re.compile(r"\b[Pp]rogramme ([A-Z][a-z]{4,})|\b([A-Z][a-z]{4,}) programme\b")


#: Characters that have no decomposition to plain ones. (Chained replacement is many times faster than a translation table.)
_PUNCTUATION = (("’", "'"), ("–", "-"), ("—", "-"), ("…", "."), ("œ", "oe"), ("Œ", "OE"), ("ß", "ss"))


def fold(text: str) -> str:
    """Lower case without accents."""
    if not text.isascii():
        for a, b in _PUNCTUATION:
            text = text.replace(a, b)
        parts = unicodedata.normalize("NFKD", text)
        plain = parts.encode("ascii", "ignore").decode()
        # Texts in other scripts keep their letters.
        text = plain if 2 * len(plain) >= len(text) else "".join(c for c in parts if not unicodedata.combining(c))
    return text.lower()


def _clean(text: str) -> str:
    if "<" in text:
        text = _TAGS.sub("\n", text)
    return html.unescape(text) if "&" in text else text


class Speller:
    """Corrects words to a vocabulary: one insertion, deletion, exchange or swap of neighbours; long words more."""

    def __init__(self, words) -> None:
        self.words = frozenset(words)
        self.long = sorted(w for w in self.words if len(w) >= 7)
        self.near: dict[str, set[str]] = {}
        for w in self.words:
            if len(w) >= 4:
                for d in self._deletes(w):
                    self.near.setdefault(d, set()).add(w)
        self.memo: dict[str, str] = {}

    @staticmethod
    def _deletes(w: str):
        yield w
        for i in range(len(w)):
            yield w[:i] + w[i + 1 :]

    def candidates(self, w: str) -> set[str]:
        """Vocabulary words within one error."""
        if w in self.words or len(w) < 4:
            return {w} & self.words
        return {v for d in self._deletes(w) for v in self.near.get(d, ()) if abs(len(v) - len(w)) <= 1}

    def __call__(self, w: str) -> str:
        if w in self.words or len(w) < 4:
            return w
        known = self.memo.get(w)
        if known is None:
            hits = self.candidates(w)
            if hits:
                known = min(hits, key=lambda v: (abs(len(v) - len(w)), sorted(v) != sorted(w), v[0] != w[0], v))
            else:
                known = (difflib.get_close_matches(w, self.long, 1, 0.8) or [w])[0] if len(w) >= 7 else w
            if len(self.memo) < 100_000:
                self.memo[w] = known
        return known


class Reader:
    """Reads postings. Built once in each task."""

    def __init__(self) -> None:
        self.canon = {w: k for k, v in SAME.items() for w in v.split()}
        self.level = {w: k for k, v in LEVELS.items() for w in v.split()}
        spec = lambda t: [[p.split() for p in e.strip().split("/")] for e in t.replace("\n", "").split(";")]
        c = lambda ws: [self.canon.get(w, w) for w in ws]
        self.roles = sorted(((frozenset(c(p)), k) for k, e in enumerate(spec(ROLES)) for p in e), key=lambda x: -len(x[0]))
        self.phrases = [(tuple(c(p)), kind, k) for kind, t in (("f", FIELDS), ("b", BRANCHES)) for k, e in enumerate(spec(t)) for p in e]
        self.double = [x for x in self.phrases if len(x[0]) > 1]
        self.single = {x[0][0]: x[1:] for x in self.phrases if len(x[0]) == 1}
        # A word that only one double phrase has stands for it where the other word is lost.
        self.half = {w: x[1:] for x in self.double for w in x[0] if sum(w in y[0] for y in self.phrases) == 1}
        vocabulary = {w for t in (ROLES, FIELDS, BRANCHES) for e in spec(t) for p in e for w in p} | set(self.canon) | set(self.level)
        self.spell = Speller(vocabulary)
        self.cities, self.regions, self.region_of = {}, {}, {}
        for entry in PLACES.replace("\n", "").split(";"):
            city, region, country = entry.strip().split(",")
            names = city.split("|")
            for n in names:
                self.cities[n] = names[0]
            self.regions[region] = f"{country}:{region}"
            self.region_of[names[0]] = f"{country}:{region}"
        self.city_spell = Speller({w for c in self.cities for w in [c.replace(" ", "")]})
        self.joined = {c.replace(" ", ""): v for c, v in self.cities.items()}
        self.titles: dict[str, tuple[str, str, bool]] = {}
        self.spots: dict[str, tuple[str, str]] = {}

    def title(self, text: str | None) -> tuple[str, str, bool]:
        """(post, level, sure): post is "role.field.branch", each a number or empty; sure if all words are known as they stand."""
        key = text or ""
        known = self.titles.get(key)
        if known is None:
            known = self._title(fold(key))
            if len(self.titles) < 200_000:
                self.titles[key] = known
        return known

    def _title(self, text: str) -> tuple[str, str, bool]:
        typed = _WORD.findall(text.replace("d'", " "))
        sure = all(w in self.spell.words or w in _NOISE or w.isdigit() for w in typed)
        words = [self.canon.get(x, x) for w in typed for x in [self.spell(w)]]
        flat = [x for w in words for x in ([w] if "-" not in w or w in self.spell.words else w.split("-"))]
        level = next((self.level[w] for w in flat if w in self.level), "")
        code = {"f": "", "b": ""}
        for phrase, kind, k in self.double:
            for i in range(len(flat) - len(phrase) + 1):
                if tuple(flat[i : i + len(phrase)]) == phrase and not code[kind]:
                    code[kind] = str(k)
                    del flat[i : i + len(phrase)]
                    break
        bag = set(flat)
        role = ""
        for need, k in self.roles:
            if need <= bag:
                role = str(k)
                for w in need:
                    flat.remove(w)
                break
        if not role:
            # Part of an occupation's words, where that leaves one occupation.
            part = {k for need, k in self.roles if len(need & bag) * 2 >= len(need) and need & bag}
            role = str(part.pop()) if len(part) == 1 else ""
        for w in flat:
            hit = self.single.get(w)
            if hit and not code[hit[0]]:
                code[hit[0]] = str(hit[1])
        for w in flat:
            hit = self.half.get(w)
            if hit and not code[hit[0]]:
                code[hit[0]] = str(hit[1])
        return f"{role}.{code['f']}.{code['b']}", level, sure and bool(role and code["f"] and code["b"])

    def place(self, text: str | None) -> tuple[str, str]:
        """(city, region) of a location; empty where it doesn't say."""
        key = text or ""
        known = self.spots.get(key)
        if known is None:
            words = re.findall(r"[a-z]+", fold(key))
            joined = " ".join(words)
            city = ""
            for n in (3, 2, 1):
                for i in range(len(words) - n + 1):
                    city = city or self.cities.get(" ".join(words[i : i + n]), "")
            region = self.region_of.get(city, "") or next((v for k, v in self.regions.items() if re.search(rf"\b{k}\b", joined)), "")
            for n in (2, 1):
                for i in range(len(words) - n + 1):
                    s = "".join(words[i : i + n])
                    if not city and s not in ("france", "remote") and (not region or s not in region.replace(" ", "")):
                        hits = {self.joined[x] for x in self.city_spell.candidates(s)}
                        # A spelling that could be several cities tells none.
                        city = hits.pop() if len(hits) == 1 else ""
            region = region or self.region_of.get(city, "")
            known = (city, region)
            if len(self.spots) < 100_000:
                self.spots[key] = known
        return known

    def employer(self, text: str | None) -> tuple[str, str]:
        """(first word, further words) of an employer's name."""
        if not text or _WITHHELD.fullmatch(text):
            return "", ""
        words = [w for w in re.findall(r"[a-z0-9.]+", fold(text)) if w.strip(".") not in LEGAL and w.strip(".")]
        return (words[0], " ".join(words[1:])) if words else ("", "")

    def text(self, description: str | None) -> tuple[str, str, list[str], list[str]]:
        """(head, programme, names, sentences): the first sentence, and what can be compared across postings.

        Names are rare-looking capitalised words, folded; sentences are
        normalised to their words.
        """
        clean = _clean(description or "")
        sentences = [s for s in _SENTENCE.split(clean) if s and not s.isspace()]
        m = _PROGRAMME.search(clean)
        programme = fold(m[1] or m[2]) if m else ""
        names = sorted({fold(w) for w in _INNER_CAP.findall(clean)})
        plain = [" ".join(_ALNUM.findall(s)) for s in fold("\n".join(s.replace("\n", " ") for s in sentences)).split("\n")] if sentences else []
        return (sentences[0] if sentences else ""), programme, names, plain

    def read(self, title, company, location, description) -> tuple:
        post, level, sure = self.title(title)
        head, programme, names, sentences = self.text(description)
        city, region = self.place(location)
        if not city and _PROGRAMME.search(head):
            # A head that introduces the programme names its place; it counts where it lies in the stated region.
            found, where = self.place(" ".join(_CAP.findall(head)) + " " + head.rstrip(". ").rsplit(",", 1)[-1])
            if found and (not region or region == where):
                city, region = found, where
        if not sure and (m := _HEAD_TITLE.search(head)):
            # The head may repeat the title. It decides what the title leaves open or spells wrongly.
            again, its, clear = self.title(m[1])
            if clear:
                post, level = again, level or its
            else:
                post = ".".join(a or b for a, b in zip(post.split("."), again.split(".")))
        first, rest = self.employer(company)
        return post, level, city, region, first, rest, programme, names, sentences


FACTS = (
    "post string, level string, city string, region string, employer string, employer_rest string, programme string, "
    "names array<bigint>, sentences array<bigint>, chunks array<struct<h:bigint,n:int>>"
)
FIELDS_OUT = ["post", "level", "city", "region", "employer", "employer_rest", "programme", "names", "sentences", "chunks"]
#: Words of a chunk: at least, at most, and on average about eight more than the least.
CHUNK_MIN, CHUNK_MAX, CHUNK_MASK = 6, 32, 7


def hash64(text: str) -> int:
    """A signed 64-bit hash that is equal on all machines."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def chunk(fields: list[str]) -> list[tuple[int, int]]:
    """Content-defined chunks of a record's fields: (hash, bytes).

    A rolling hash over the last three words ends a chunk where its low bits
    are zero, so an edit changes the chunks around it and no others. A field's
    end always ends a chunk.
    """
    out = []
    for field in fields:
        begin, words = 0, field.split()
        marks, last = [zlib.crc32(w.encode()) for w in words], len(words) - 1
        one = two = 0
        for k, mark in enumerate(marks):
            size = k + 1 - begin
            rolling = (mark + 31 * one + 961 * two) >> 5
            one, two = mark, one
            if k == last or size >= CHUNK_MAX or (size >= CHUNK_MIN and not rolling & CHUNK_MASK):
                piece = " ".join(words[begin : k + 1])
                out.append((hash64(piece), len(piece)))
                begin = k + 1
    return out


def read_postings(postings: DataFrame, *keep: str, chunks: bool = False) -> DataFrame:
    """``keep`` columns and the facts of each posting, ``chunks`` of its text only on demand; nulls read as empty."""
    columns = ["title", "company", "location", "description"]

    def run(batches):
        import pandas as pd

        reader = Reader()
        for pdf in batches:
            facts = []
            for row in pdf[columns].itertuples(index=False, name=None):
                *fields, names, sentences = reader.read(*row)
                pieces = chunk(sentences) if chunks else None
                # Short sentences and common turns tell little; those that count hold some words.
                facts.append((*fields, [hash64(n) for n in names], [] if chunks else [hash64(s) for s in sorted(set(sentences)) if len(s) > 40], pieces))
            out = pd.DataFrame(facts, columns=FIELDS_OUT)
            yield pd.concat([pdf[list(keep)].reset_index(drop=True), out], axis=1)

    schema = ", ".join(f"{k} {postings.schema[k].dataType.simpleString()}" for k in keep)
    return postings.select(*keep, *(F.col(c).cast("string").alias(c) for c in columns)).mapInPandas(run, f"{schema}, {FACTS}")
