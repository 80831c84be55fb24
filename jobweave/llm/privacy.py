"""Personal data in free text: located, typed, and replaced so that the rest stays readable.

Patterns with validation find e-mail addresses, phone numbers, identity
numbers and street addresses; names are found where a text introduces a person
(the head of a CV, a title, "led by", an author or referee line), and their
shape is checked. Overlaps go to the more telling kind.

Replacement is keyed and deterministic, so equal values stay linked across
documents without a table of pseudonyms: numbers and dates of birth are permuted
within their format by a Feistel network (fields stay in their ranges, check
digits follow, letters become letters); other values become typed placeholders
with a keyed tag.

Each text is treated alone, in Arrow batches, with no shuffle.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "phone", "id_number", "address", "person")
ROUNDS = 8

_AT = r"(?:\s?@\s?|\s?[(\[]\s?(?:at|arobase)\s?[)\]]\s?|\s+arobase\s+|\s+at\s+(?=[\w-]+\s+dot\s))"
_DOT = r"(?:\.|\s?[(\[]\s?(?:dot|point)\s?[)\]]\s?|\s+(?:point|dot)\s+)"
EMAIL = re.compile(rf"(?<![\w.+-])[A-Za-z0-9][\w.+-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w@])")

#: Shapes of telephone numbers: French, British and North American, national and international; others only with a plus.
PHONE = re.compile(
    r"(?<![\w.+/-])(?<!\d )(?:"
    r"(?:\+|00)33[ .-]?(?:\(0\))?[ .-]?[1-9](?:[ .-]?\d\d){4}"
    r"|0[1-9](?:[ .-]?\d\d){4}"
    r"|(?:(?:\+|00)44[ .-]?(?:\(0\))?[ .-]?|0)(?:20[ .-]?\d{4}[ .-]?\d{4}|7\d{3}[ .-]?\d{3}[ .-]?\d{3}|1\d{2,3}[ .-]?\d{3}[ .-]?\d{3,4})"
    r"|(?:(?:\+|00)?1[ .-])?(?:\(\d{3}\)[ .-]?|\d{3}[.-]|(?<=1[ .-])\d{3} |\d{3} (?=\d{3}[ -]\d{4}))\d{3}[ .-]\d{4}"
    r"|\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}"
    r")(?![\w]|[.,/-]\d|[ ]\d)"
)

NIR = re.compile(r"(?<![\w.,/-])(?<!\d )[12] ?\d\d ?(?:0[1-9]|1[0-2]|[2-4]\d|5[0-9]) ?(?:\d\d|2[AB]) ?\d{3} ?\d{3}(?:[ /-]?\d\d)?(?!\w|[ ]?\d)")
SSN = re.compile(r"(?<![\w.,/-])(?<!\d )\d{3}([ -])\d\d\1\d{4}(?!\w|[ .,/-]?\d)")
NINO = re.compile(r"(?<!\w)(?![DFIUV])[A-Z](?![DFIOUV])[A-Z] ?\d\d ?\d\d ?\d\d ?[A-D](?!\w)")
_ID_LABEL = r"(?:passe?port|cni|carte (?:nationale )?d['’]identit[ée]|identity card|id card|n° ?ss|nir|s[ée]cu(?:rit[ée] sociale)?|ssn|social security|nino|national insurance)"
LABELLED = re.compile(rf"\b{_ID_LABEL}(?:\s+(?:no\.?|n°|number|num[ée]ro|nr\.?))?\s*[:.#]?\s*((?=[A-Z]*\d)[A-Z0-9]{{1,4}}(?:[ -]?[A-Z0-9]{{2,9}}){{0,5}})(?!\w)", re.I)
BOOKLET = re.compile(r"(?<!\w)\d\d[A-Z]{2}\d{5}(?!\w)")
BIRTH = re.compile(r"(?i)\b(?:n[ée]+\s?(?:\(e\))?\s+le|date de naissance|born(?: on)?|date of birth|dob)\s*:?\s*(\d{1,2}([./-])\d{1,2}\2\d{4})")

_TOWN = r"[A-ZÀ-Ý][A-Za-zÀ-ÿ'’]*(?:[ -](?:[A-ZÀ-Ý][A-Za-zÀ-ÿ'’]*|en|sur|sous|lès|la|le|les|de|du|des|upon|on)(?=[ -][A-ZÀ-Ý])|[ -][A-ZÀ-Ý][A-Za-zÀ-ÿ'’]{2,}){0,4}"
_FR_STREET = r"(?:rue|avenue|av\.?|boulevard|bd\.?|boul\.?|place|pl\.?|chemin|ch\.?|impasse|imp\.?|all[ée]e|quai|cours|route|rte\.?|square|passage|voie|sentier|villa|faubourg|fg\.?)"
ADDRESS = re.compile(
    r"(?<![\w/.-])(?:"
    # number and street, French order
    rf"(?:(?:appt?\.?|appartement|b[âa]t(?:iment|\.)?|[ée]tage)\s?\w+,?\s)?\d{{1,4}}\s?(?:bis|ter|quater|[A-D](?=,?\s))?,?\s(?i:{_FR_STREET})\s"
    r"(?:(?i:de la|de l['’]|des|du|de|d['’]|la|le|les)\s?)?[A-ZÀ-Ý][\wÀ-ÿ'’]*(?:[ -](?:(?:(?:de|du|des|la|le|les|et)[ -])*)[A-ZÀ-Ý][\wÀ-ÿ'’]*){0,4}"
    rf"(?:,?\s(?i:appt?\.?|appartement|b[âa]t(?:iment|\.)?)\s?\w+)?(?:\s?[,–-]?\s?\b\d{{5}}\s{_TOWN})?"
    # English order
    r"|(?:(?:Flat|Apt\.?|Apartment|Unit|Suite)\s\w+,\s)?\d{1,5}[A-D]?\s(?:[A-Z][\w'’]*[ -]){1,3}?"
    r"(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Boulevard|Blvd\.?|Drive|Dr\.?|Way|Court|Ct\.?|Close|Terrace|Place|Pl\.?|Row|Crescent|Mews|Gardens|Grove|Hill|Square|Parkway|Pkwy\.?|Walk|Quay)(?![\w])"
    r"(?:,\s(?:Apt\.?|Apartment|Unit|Suite|Flat|#)\s?\w+)?"
    rf"(?:,\s{_TOWN}(?:,?\s[A-Z]{{2}}\s\d{{5}}(?:-\d{{4}})?|,?\s[A-Z]{{1,2}}\d[A-Z\d]?\s\d[A-Z]{{2}})?)?"
    r")(?!\w)"
)

_UPPER, _LOWER = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_CAP = rf"(?:Ma?c|O['’]|D['’])?[{_UPPER}][{_LOWER}]+(?:['’-][{_UPPER}]?[{_LOWER}]+)*"
_ALL = rf"[{_UPPER}]{{2,}}(?:['’-][{_UPPER}]{{2,}})*"
_PART = rf"(?:{_CAP}|{_ALL})"
_SPACE = "[ \u00a0]{1,3}"
#: A full name: given and family name in either order, initials with full stops, a comma where the family name leads.
NAME = (
    rf"(?:[{_UPPER}]\.(?:{_SPACE}?[{_UPPER}]\.)*{_SPACE}{_PART}|{_PART},{_SPACE}(?:{_PART}(?:{_SPACE}[{_UPPER}]\.)?|[{_UPPER}]\.)"
    rf"|{_PART}(?:{_SPACE}[{_UPPER}]\.)?{_SPACE}{_PART}|{_PART}{_SPACE}[{_UPPER}]\.)"
)
_TITLE = r"(?:M\.|MM\.|Mme\.?|Mlle\.?|Mr\.?|Mrs\.?|Ms\.?|Miss|Dr\.?|Pr\.?|Prof\.?|Monsieur|Madame|Mademoiselle|Me|Maître|Docteur|Doctor|Professeur|Professor)"
INTRODUCED = re.compile(
    rf"(?:(?<!\w){_TITLE}{_SPACE}"
    r"|\b(?:dirigée?s? par|encadrée?s? par|supervisée?s? par|managée?s? par|pilotée?s? par|led by|managed by|supervised by|headed by|mentored by|reporting to)\s(?:(?:M|Mr|Mrs|Ms|Mme|Dr)\.?\s)?"
    rf")({NAME})(?![{_LOWER}])"
)
AUTHOR = re.compile(rf"\b(?:With|Avec|et|and|co-auteur\s?:?|co-author\s?:?)\s({NAME})(?=,?\s(?:\(?(?:\d+(?:e|er|nd|rd|th|st)|premier|second|third|first|last|deuxième|troisième|lead|principal)\s(?:auteur|author)|co-?aut))")
REFEREE = re.compile(rf"(?<![\w@.])(?:{_TITLE}{_SPACE})?({NAME})\s?\((?:anc|ex-|former|mon |my |previous|manager|responsable|tuteur|maître|directeur|directrice|supervisor|tutor)[^)]*\)")
#: What a referee's line and an author's line can't do without; looked for first, as that is cheap.
_REFEREE_HINT = re.compile(r"\((?:anc|ex-|former|mon |my |previous|manager|responsable|tuteur|maître|directeur|directrice|supervisor|tutor)")
_AUTHOR_HINT = "aut"
CONTACT = re.compile(rf"(?m)^[\s\-•*]*(?:{_TITLE}{_SPACE})?({NAME})\s?(?:[–—:;,/|-]|\()\s?(?=(?:tél|tel|phone|mail|e-mail|mobile|[+(]?\d|[\w.+-]+ ?@|head of|direct))")
_LINE_NAME = re.compile(rf"\s*(?:(?:Nom|Name|Candidat|Candidate)\s?:\s?)?({NAME})\s*")
_COVER = re.compile(r"(?i)\s*(?:cv|curriculum vit(?:ae|æ)|r[ée]sum[ée]|candidature)\s*:?\s*")

#: Words that are no names although they are written like such at the head of a CV.
NOT_NAMES = frozenset(
    "profil profile summary resume skills competences formation education experience experiences work career langues languages projets projects "
    "certifications licenses diplomes diploma publications awards distinctions references hobbies interests loisirs interets benevolat "
    "volunteering academic background technical techniques professionnelle professionnelles professional parcours presentation propos contact "
    "personal statement objective about portfolio scolaire universitaire studies schooling univ school degrees tools technologies toolbox tech "
    "stack core strengths expertise know how savoir faire outils logiciels environnement technique cursus etudes carriere emplois postes stages "
    "history employment jobs positions prof exp educ comp lang accroche bref note nutshell story signature footer page table adresse address "
    "mobile phone mail home curriculum vitae cv engineer manager developer ingenieur developpeur responsable master bachelor licence institut "
    "institute university universite college java python mme mlle mr mrs ms miss dr prof monsieur madame mademoiselle docteur doctor".split()
)

_RANK = {"email": 0, "id_number": 1, "phone": 2, "address": 3, "person": 4, "birth_date": 5}


@dataclass(frozen=True)
class Span:
    """A piece of personal data in a text."""

    start: int
    end: int
    kind: str


def _plain(word: str) -> str:
    return "".join(c for c in word.casefold().translate(str.maketrans("àâäéèêëîïôöûüç", "aaaeeeeiioouuc")) if c.isalpha())


def _is_name(text: str) -> bool:
    words = [_plain(w) for w in re.split(r"[\s,.'’-]+", text)]
    return not any(w in NOT_NAMES for w in words if w) and any(len(w) > 2 for w in words)


def locate(text: str | None, whole_cv: bool = True) -> list[Span]:
    """Spans of personal data, in order, without overlaps; [] for null.

    ``whole_cv`` texts have a head, where a line that is a name alone counts.
    """
    if not text:
        return []
    found: list[Span] = []
    add = lambda m, kind, g=0: found.append(Span(m.start(g), m.end(g), kind))
    if "@" in text or "robase" in text or "(at)" in text or "[at]" in text or " at " in text:
        for m in EMAIL.finditer(text):
            add(m, "email")
    if any(c.isdigit() for c in text):
        for pattern in (NIR, SSN, NINO, BOOKLET):
            for m in pattern.finditer(text):
                add(m, "id_number")
        for m in LABELLED.finditer(text):
            if sum(c.isdigit() for c in m[1]) >= 5:
                add(m, "id_number", 1)
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                add(m, "phone")
        for m in ADDRESS.finditer(text):
            add(m, "address")
        for m in BIRTH.finditer(text):
            add(m, "birth_date", 1)
    people = [INTRODUCED, CONTACT]
    if _AUTHOR_HINT in text:
        people.append(AUTHOR)
    if _REFEREE_HINT.search(text):
        people.append(REFEREE)
    for pattern in people:
        for m in pattern.finditer(text):
            if _is_name(m[1]):
                add(m, "person", 1)
    if whole_cv:
        at, seen = 0, 0
        for line in text.splitlines(keepends=True):
            if line.strip():
                if not _COVER.fullmatch(line):
                    m = _LINE_NAME.fullmatch(line)
                    if m and _is_name(m[1]):
                        found.append(Span(at + m.start(1), at + m.end(1), "person"))
                        break
                    seen += 1
                    if seen == 2:
                        break
            at += len(line)
    found.sort(key=lambda s: (_RANK[s.kind], s.start - s.end, s.start))
    kept: list[Span] = []
    for s in found:
        if all(s.end <= k.start or s.start >= k.end for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s.start)


def _round(key: bytes, tag: str, n: int, half: int, width: int) -> int:
    digest = hmac.new(key, f"{tag}|{n}|{width}|{half}".encode(), hashlib.sha256).digest()
    return int.from_bytes(digest[:16], "big")


def permute_digits(digits: str, key: bytes, tag: str = "") -> str:
    """Keyed permutation of the decimal strings of one length (an alternating Feistel network)."""
    n = len(digits)
    if n < 2:
        return str((int(digits or 0) + _round(key, tag, 0, 0, 1)) % 10) if digits else ""
    u = n // 2
    a, b = int(digits[:u]), int(digits[u:])
    size_a, size_b = 10**u, 10 ** (n - u)
    for k in range(ROUNDS):
        if k % 2:
            b = (b + _round(key, tag, k, a, n - u)) % size_b
        else:
            a = (a + _round(key, tag, k, b, u)) % size_a
    return f"{a:0{u}d}{b:0{n - u}d}"


def restore_digits(digits: str, key: bytes, tag: str = "") -> str:
    """Inverse of ``permute_digits``."""
    n = len(digits)
    if n < 2:
        return str((int(digits or 0) - _round(key, tag, 0, 0, 1)) % 10) if digits else ""
    u = n // 2
    a, b = int(digits[:u]), int(digits[u:])
    for k in reversed(range(ROUNDS)):
        if k % 2:
            b = (b - _round(key, tag, k, a, n - u)) % 10 ** (n - u)
        else:
            a = (a - _round(key, tag, k, b, u)) % 10**u
    return f"{a:0{u}d}{b:0{n - u}d}"


#: Departments of French social security numbers that aren't plain digits, and the digits that stand for them in the key.
CORSICA = {"2A": "19", "2B": "18"}
#: Letters that may lead a national insurance number, second letters, suffixes, and prefixes that are never given out.
NINO_FIRST, NINO_SECOND, NINO_LAST = "ABCEGHJKLMNOPRSTWXYZ", "ABCEGHJKLMNPRSTWXYZ", "ABCD"
NINO_NEVER = ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def permute_below(n: int, size: int, key: bytes, tag: str, back: bool = False) -> int:
    """Keyed permutation of 0 .. size - 1: digits are permuted until the result lies below ``size`` again (cycle walking)."""
    width = max(2, len(str(size - 1)))
    move = restore_digits if back else permute_digits
    while True:
        n = int(move(f"{n:0{width}d}", key, tag))
        if n < size:
            return n


def nir_key(head: str) -> int:
    """The two check digits of a French social security number's first 13 places."""
    plain = head
    for letters, digits in CORSICA.items():
        plain = plain.replace(letters, digits)
    return 97 - int(plain) % 97


def _permute_nir(chars: str, key: bytes, back: bool) -> str:
    """Year, month, department with commune, and serial permuted, each among the values it may have; the sex stays.

    The key follows the new number. A key that is off by some amount stays off
    by it, so a valid number gives a valid one and a number without its key
    the same 13 places as with it. All fields are permuted together, as one
    number, so one part shows nothing of another.
    """
    months = [f"{m:02d}" for m in (*range(1, 13), *range(20, 60))]
    places = [f"{d:02d}" for d in range(100)] + list(CORSICA)
    sizes = (100, len(months), len(places), 1_000_000)
    parts = (int(chars[1:3]), months.index(chars[3:5]), places.index(chars[5:7]), int(chars[7:13]))
    n = 0
    for part, size in zip(parts, sizes):
        n = n * size + part
    n = permute_below(n, 100 * len(months) * len(places) * 1_000_000, key, "nir", back)
    new = []
    for size in reversed(sizes):
        n, part = divmod(n, size)
        new.append(part)
    serial, place, month, year = new
    head = f"{chars[0]}{year:02d}{months[month]}{places[place]}{serial:06d}"
    if len(chars) == 13:
        return head
    return f"{head}{(nir_key(head) + int(chars[13:]) - nir_key(chars[:13])) % 100:02d}"


def _permute_mixed(chars: str, key: bytes, tag: str, back: bool) -> str:
    """Letters and digits permuted together, each place keeping its kind."""
    size, n = 1, 0
    for c in chars:
        base, digit = (10, int(c)) if c in "0123456789" else (26, _LETTERS.index(c))
        n, size = n * base + digit, size * base
    n, out = permute_below(n, size, key, tag, back), []
    for c in reversed(chars):
        n, digit = divmod(n, 10 if c in "0123456789" else 26)
        out.append(str(digit) if c in "0123456789" else _LETTERS[digit])
    return "".join(reversed(out))


def _permute_nino(chars: str, key: bytes, back: bool) -> str:
    prefixes = [a + b for a in NINO_FIRST for b in NINO_SECOND if a + b not in NINO_NEVER]
    size = len(prefixes) * 1_000_000 * len(NINO_LAST)
    n = (prefixes.index(chars[:2]) * 1_000_000 + int(chars[2:8])) * len(NINO_LAST) + NINO_LAST.index(chars[8])
    n, last = divmod(permute_below(n, size, key, "nino", back), len(NINO_LAST))
    return f"{prefixes[n // 1_000_000]}{n % 1_000_000:06d}{NINO_LAST[last]}"


def _id_kind(chars: str) -> str:
    """The kind of an identity number without its spaces and signs."""
    if len(chars) in (13, 15) and NIR.fullmatch(chars):
        return "nir"
    if len(chars) == 9 and NINO.fullmatch(chars) and chars[:2] not in NINO_NEVER and chars[0] in NINO_FIRST and chars[1] in NINO_SECOND:
        return "nino"
    return "other"


def permute_id(value: str, key: bytes, back: bool = False) -> str:
    """An identity number to another one of its kind, in the same format; ``back`` inverts it.

    A value is read without its spaces and signs and in upper case, so all
    written forms of a number stay linked. Numbers of French social security
    and of national insurance keep to what their fields may hold; all others
    (American numbers, passports, cards) keep letters as letters and digits as
    digits, and don't become one of the former.
    """
    chars = "".join(c for c in value.upper() if c in _LETTERS or c in "0123456789")
    kind = _id_kind(chars)
    if kind == "nir":
        new = _permute_nir(chars, key, back)
    elif kind == "nino":
        new = _permute_nino(chars, key, back)
    else:
        new = _permute_mixed(chars, key, f"id{len(chars)}", back)
        while chars and _id_kind(new) != "other":
            new = _permute_mixed(new, key, f"id{len(chars)}", back)
    # Other signs than letters and digits of the Latin alphabet stay where they are.
    fill = iter(new)
    return "".join((lambda x: x.lower() if c.islower() else x)(next(fill)) if c.upper() in _LETTERS or c in "0123456789" else c for c in value)


def permute_phone(value: str, key: bytes) -> str:
    """The last eight digits permuted, the same in national and international form; prefix and spacing stay."""
    digits = [c for c in value if c in "0123456789"]
    keep = max(0, len(digits) - 8)
    new = iter(digits[:keep] + list(permute_digits("".join(digits[keep:]), key, "phone")))
    return "".join(next(new) if c in "0123456789" else c for c in value)


def permute_date(value: str, key: bytes) -> str:
    """A day.month.year date to another one between 1900 and 2099, in the same format; a date that doesn't exist is masked."""
    m = re.fullmatch(r"(\d{1,2})([./-])(\d{1,2})\2(\d{4})", value)
    try:
        day = datetime.date(int(m[4]), int(m[3]), int(m[1])).toordinal()
    except (TypeError, ValueError):
        return "[DATE]"
    low, size = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()
    n = day - low
    if not 0 <= n < size:
        return "[DATE]"
    # Cycle walking: five digits hold all days; permute until the result is a day again.
    while True:
        n = int(permute_digits(f"{n:05d}", key, "date"))
        if n < size:
            d = datetime.date.fromordinal(low + n)
            return f"{d.day:02d}{m[2]}{d.month:02d}{m[2]}{d.year}"


def pseudonym(value: str, kind: str, key: bytes) -> str:
    """What stands for a value: equal values of a kind get equal pseudonyms under one key."""
    if kind == "phone":
        return permute_phone(value, key)
    if kind == "id_number":
        return permute_id(value, key)
    if kind == "birth_date":
        return permute_date(value, key)
    norm = " ".join(value.casefold().split())
    return f"[{kind.upper()}_{hmac.new(key, f'{kind}|{norm}'.encode(), hashlib.sha256).hexdigest()[:8]}]"


def replaced(text: str | None, key: bytes, whole_cv: bool = True) -> tuple[str | None, list[tuple[str, str, str]]]:
    """The text with its personal data replaced, and ``kind, value, pseudonym`` of each piece; null stays null."""
    if not text:
        return text, []
    out, found, at = [], [], 0
    for s in locate(text, whole_cv):
        value = text[s.start : s.end]
        found.append((s.kind, value, pseudonym(value, s.kind, key)))
        out += [text[at : s.start], found[-1][2]]
        at = s.end
    return "".join([*out, text[at:]]), found


def redact(text: str | None, key: bytes, whole_cv: bool = True) -> str | None:
    return replaced(text, key, whole_cv)[0]


def _texts(cv_parse: DataFrame, cv_sections: DataFrame) -> DataFrame:
    """``cv_id, section_no, text`` of CVs (section 0) and of their sections."""
    return (
        cv_parse.select("cv_id", F.lit(0).alias("section_no"), F.col("raw_text").alias("text"))
        .unionByName(cv_sections.select("cv_id", F.col("section_no").cast("int").alias("section_no"), "text"))
        .where(F.col("text").isNotNull() & (F.col("text") != ""))
    )


def replace_personal_data(cv_parse: DataFrame, cv_sections: DataFrame, key: str) -> DataFrame:
    """``cv_id, section_no, text, found array<struct<kind, value, pseudonym>>``: each text once read, replaced under ``key``.

    Null and empty texts are left out. Rows repeat as they do in the tables;
    extra columns are not looked at.
    """
    secret = key.encode()

    def run(batches):
        import pandas as pd

        for pdf in batches:
            done = [replaced(t, secret, no == 0) for no, t in zip(pdf["section_no"], pdf["text"])]
            found = [[{"kind": k, "value": v, "pseudonym": p} for k, v, p in f] for _, f in done]
            yield pd.DataFrame({"cv_id": pdf["cv_id"], "section_no": pdf["section_no"], "text": [t for t, _ in done], "found": found})

    # Ids travel as texts: beside a null, whole numbers would become inexact ones.
    schema = "cv_id string, section_no int, text string, found array<struct<kind:string,value:string,pseudonym:string>>"
    rows = _texts(cv_parse, cv_sections).withColumn("cv_id", F.col("cv_id").cast("string")).mapInPandas(run, schema)
    return rows.withColumn("cv_id", F.col("cv_id").cast("bigint"))


def find_personal_data(cv_parse: DataFrame, cv_sections: DataFrame, key: str = "") -> DataFrame:
    """``cv_id, section_no, kind, value, pseudonym``: every distinct piece of personal data and what stands for it under ``key``.

    Repeated rows count once. Dates of birth are replaced, but are no kind of their own.
    """
    pieces = replace_personal_data(cv_parse, cv_sections, key).select("cv_id", "section_no", F.inline("found"))
    return pieces.where(F.col("kind").isin(*KINDS)).distinct()


def redact_texts(cv_parse: DataFrame, cv_sections: DataFrame, key: str) -> DataFrame:
    """``cv_id, section_no, text``: distinct texts with personal data replaced under ``key``."""
    return replace_personal_data(cv_parse, cv_sections, key).select("cv_id", "section_no", "text").distinct()
