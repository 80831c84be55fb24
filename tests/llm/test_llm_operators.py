"""The llm operators against brute force, round trips and held-out labels, with nulls, ties, repeats and odd columns."""

import difflib
import itertools
import random
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobweave.llm import headings, history, leakage, linkage, postings, privacy, queries, tokenizer, toxicity

SMALL = "/root/testdata/sf0.001"
VOCABULARY = tokenizer.default_vocabulary()


# --- 1 headings


@pytest.fixture(scope="module")
def catalogue(spark):
    return spark.read.parquet(f"{SMALL}/section_catalog.parquet")


def mapped(spark, catalogue, *texts):
    df = spark.createDataFrame([(1, n, t, "x") for n, t in enumerate(texts)], "cv_id bigint, section_no int, raw_heading string, name string")
    got = {r.section_no: r.name for r in headings.map_headings(df.union(df), catalogue).collect()}
    return [got.get(n) for n in range(len(texts))]


def test_headings(spark, catalogue):
    assert mapped(
        spark, catalogue, "Expérience professionnelle", "experience professionnelle", "E X P É R I E N C E S", "CompÃ©tences techniques", "🎓 Profll (suite)", "2. Diplômse",
        "Berufserfahrung", "Exp. pro.", "C0mp. tech. :", "À   P R O P O S", "Hobbies 2010-2024", "", "???", "Permis de conduire", None, "x" * 5000,
    ) == [
        None, "experience", "experience", "skills", "summary", "education", "experience", "experience", "skills", "summary", "interests",
        "unmatched", "unmatched", "unmatched", None, "unmatched",
    ]


def test_headings_empty_catalogue(spark, catalogue):
    assert mapped(spark, catalogue.limit(0), "Profil", "") == ["unmatched", "unmatched"]


def test_wordings_are_learnt(spark, catalogue):
    """A heading no list knows comes out by what its sections hold, where they are several; a repeated row counts once."""
    rnd = random.Random(6)
    tools, posts = ["Python", "Kotlin", "Go", "Rust", "Spark", "Kafka"], ["Cook", "Nurse", "Driver"]
    skill = lambda: ", ".join(rnd.sample(tools, 4))
    work = lambda: "\n".join(f"{rnd.choice(posts)} at Acme ({1990 + rnd.randint(0, 30)}-2022)\n- Led {rnd.randint(2, 90)} people" for _ in range(3))
    rows = [(n, "Skills", skill()) for n in range(40)] + [(n + 40, "Work experience", work()) for n in range(40)]
    rows += [(100 + n, "Quuxmeister", skill()) for n in range(4)] + [(110, "Onceonly", skill()), (110, "Onceonly", skill()), (111, "Xylotrope", None), (112, "Xylotrope", ""), (113, "Xylotrope", " ")]
    df = spark.createDataFrame([(i, 1, h, t, 5) for i, h, t in rows], "cv_id bigint, section_no int, raw_heading string, text string, r int")
    got = {r.cv_id: r.name for r in headings.map_headings(df.union(df), catalogue).collect()}
    assert {got[100 + n] for n in range(4)} == {"skills"} and {got[k] for k in (110, 111, 112, 113)} == {"unmatched"} and set(got) == {100, 101, 102, 103, 110, 111, 112, 113}
    assert {r.name for r in headings.map_headings(df, catalogue, learn=False).collect()} == {"unmatched"}


def test_prefix_filter_drops_no_pair(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(2, 9)))
    ls, rs = sorted({word() for _ in range(60)}), sorted({word() for _ in range(60)})
    left = spark.createDataFrame([(x,) for x in ls], "l string").withColumn("lt", headings.tokens(F.col("l")))
    right = spark.createDataFrame([(x,) for x in rs], "r string").withColumn("rt", headings.tokens(F.col("r")))
    sets = {k: set(v) for k, v in [(r[0], r[1]) for r in left.collect()] + [(r[0], r[1]) for r in right.collect()]}
    for t in (0.4, 0.7):
        want = {(a, b) for a in ls for b in rs if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9}
        assert {(r.l, r.r) for r in headings.similarity_join(left, right, t).collect()} == want


# --- 3 personal data

CV = """CV
MILLFORD Jarek
Adresse : 56ter place des Glycines 25000 Besançon | Tél. +33 6 39 98 41 70
jarek.millford @ mail.example
NIR 1 63 06 99 847 347/66
Experience
- En binôme avec M. Romaric D. Bourwick, acheteur.
- Site located at 64 Tidewater Ave, Apt 37, Raleigh, NC 27601.
Version 10.4.2.117 livrée le 12/03/2021, lot 06-2023-118, mention @interne.
Mme Ottemont, Quitterie, directrice – (617) 555-0107
With L. Thibemont, second author.
SSN: 951-91-7618, Passport no. X68955712, born on 02/03/1985"""


def test_locate():
    got = {(s.kind, CV[s.start : s.end]) for s in privacy.locate(CV)}
    assert got == {
        ("person", "MILLFORD Jarek"), ("address", "56ter place des Glycines 25000 Besançon"), ("phone", "+33 6 39 98 41 70"), ("email", "jarek.millford @ mail.example"),
        ("id_number", "1 63 06 99 847 347/66"), ("person", "Romaric D. Bourwick"), ("address", "64 Tidewater Ave, Apt 37, Raleigh, NC 27601"), ("person", "Ottemont, Quitterie"),
        ("phone", "(617) 555-0107"), ("person", "L. Thibemont"), ("id_number", "951-91-7618"), ("id_number", "X68955712"), ("birth_date", "02/03/1985"),
    }
    assert privacy.locate(None) == privacy.locate("") == privacy.locate("Work experience\nProfil") == []


def test_redaction_keeps_the_rest():
    clean = privacy.redact(CV, b"k")
    for s in privacy.locate(CV):
        assert CV[s.start : s.end] not in clean
    assert "Version 10.4.2.117 livrée le 12/03/2021, lot 06-2023-118, mention @interne." in clean
    assert clean == privacy.redact(CV, b"k") != privacy.redact(CV, b"other")
    assert privacy.redact(None, b"k") is None and privacy.redact("", b"k") == ""


@settings(max_examples=100, deadline=None)
@given(st.text("0123456789", min_size=0, max_size=16), st.binary(min_size=1, max_size=8))
def test_feistel_is_a_permutation(digits, key):
    new = privacy.permute_digits(digits, key, "t")
    assert len(new) == len(digits) and privacy.restore_digits(new, key, "t") == digits


def test_feistel_hits_every_value_once():
    assert len({privacy.permute_digits(f"{n:03d}", b"k") for n in range(1000)}) == 1000
    assert re.fullmatch(r"\d\d/\d\d/\d{4}", privacy.permute_date("29/02/2024", b"k")) and privacy.permute_date("31/02/2024", b"k") == "[DATE]"


def test_pseudonyms_stay_in_their_format():
    key, rnd = b"k", random.Random(5)
    for _ in range(300):
        place = rnd.choice(["2A", "2B", f"{rnd.randrange(100):02d}"])
        head = f"{rnd.choice('12')}{rnd.randrange(100):02d}{rnd.randrange(1, 13):02d}{place}{rnd.randrange(10**6):06d}"
        valid = f"{head}{privacy.nir_key(head):02d}"
        new = privacy.permute_id(valid, key)
        # A valid number gives a valid one; with and without its key, and however spaced, it is the same number.
        assert privacy.NIR.fullmatch(new) and int(new[13:]) == privacy.nir_key(new[:13]) and new[0] == valid[0]
        spaced = f"{valid[0]} {valid[1:3]} {valid[3:5]} {valid[5:7]} {valid[7:10]} {valid[10:13]} {valid[13:]}"
        assert privacy.permute_id(head, key) == new[:13] and privacy.permute_id(spaced, key).replace(" ", "") == new
        assert privacy.permute_id(new, key, back=True) == valid
    odd = [f"BG{n:06d}A" for n in range(300)] + [f"{n:09d}" for n in range(300)]
    assert len({privacy.permute_id(v, key) for v in odd}) == 600 and all(privacy.permute_id(privacy.permute_id(v, key), key, back=True) == v for v in odd)
    for value in ("AB 12 34 56 C", "906-05-0275", "X07516437", "62ZX53166", "qq123456c", "BG123456A"):
        new = privacy.permute_id(value, key)
        assert new != value and privacy.permute_id(new, key, back=True) == value
        assert [(c.isdigit(), c.isupper()) for c in new] == [(c.isdigit(), c.isupper()) for c in value]
    assert privacy.NINO.fullmatch(privacy.permute_id("AB123456C", key)) and privacy.permute_id("AB123456C", b"other") != privacy.permute_id("AB123456C", key)
    forms = ["+33 6 39 98 41 70", "0639984170", "06.39.98.41.70"]
    assert len({privacy.permute_phone(f, key).replace(" ", "").replace(".", "").replace("+33", "0") for f in forms}) == 1


def test_personal_data_tables(spark):
    cv = spark.createDataFrame([(1, CV, "z"), (1, CV, "z"), (2, None, "z"), (3, "", "z")], "cv_id bigint, raw_text string, value string")
    sections = spark.createDataFrame([(1, 2, "a@b.example"), (1, 2, "a@b.example"), (None, 1, "Tél. 0353017728")], "cv_id bigint, section_no int, text string")
    sections = sections.unionByName(spark.createDataFrame([(2**62 + 1, 1, "c@d.example")], sections.schema))
    got = [tuple(r)[:4] for r in privacy.find_personal_data(cv, sections, "k").collect()]
    assert len(got) == len(set(got)) == 15 and (2**62 + 1, 1, "email", "c@d.example") in got and (1, 2, "email", "a@b.example") in got and (None, 1, "phone", "0353017728") in got


# --- 5 history, 6 linkage

POST = "posting_id bigint, source string, source_id string, title string, company string, location string, description string, score int"
BODY = "Une équipe de {n} gère fraude sous SolidWorks ; vous seriez la 21e recrue depuis avril. Le pôle {w} compte 25 personnes réparties entre Reims et Austin. Nous avons passé 48 % de la charge froid vers Symfony en janvier."


def post(i, source, title, company, place, head, w, n=17):
    return (i, source, str(i), title, company, place, f"{head} {BODY.format(n=n, w=w)}", 1)


ROWS = [
    post(1, "adzuna", "Ingénieur data senior – Fraude Luxe", "Abnamin Studio", "Lyon, France", "Rejoignez le programme Helstavre de Abnamin Studio, site de Lyon.", "Elmthorit"),
    post(2, "lever", "Sr Data Enginer / Fraud Luxury (F/H)", "Abnamin", "69003 Lyon", "Helstavre programme, Lyon.", "Zzz"),
    post(3, "reed", "Ingénieur data – Fraude Luxe", "Abnamin Studio", "Lyon, France", "Rejoignez le programme Otherwise de Abnamin Studio, site de Lyon.", "Elmthorit"),
    post(4, "jsearch", "Ingénieur data senior – Fraude Luxe", "n/c", "Auvergne-Rhône-Alpes", "Programme Helstavre, Lyon.", "Elmthorit"),
    post(5, "lever", "Ingénieur data senior – Fraude Luxe", "Abnamin Studio", "Annecy, France", "Rejoignez le programme Annex de Abnamin Studio, site de Annecy.", "Elmthorit"),
    (6, "lever", None, None, None, None, None, 1), (7, None, None, "x", None, None, None, 1), (8, "adzuna", None, "", "", "", "", 1),
]


def test_linkage(spark):
    df = spark.createDataFrame(ROWS, POST)
    want = {(1, 2), (1, 4), (2, 4)}
    got = linkage.match_postings(df.union(df)).collect()
    assert {(r.posting_id_a, r.posting_id_b) for r in got} == want and len(got) == 3 and all(0.5 <= r.confidence <= 1 for r in got)
    assert linkage.match_postings(df.limit(0)).count() == 0


def test_linkage_copies(spark):
    copies = [post(100 + k, "adzuna", *ROWS[0][3:6], "Rejoignez le programme Helstavre de Abnamin Studio, site de Lyon.", "Elmthorit") for k in range(5)]
    df = spark.createDataFrame([ROWS[1], *copies], POST)
    assert {(r.posting_id_a, r.posting_id_b) for r in linkage.match_postings(df).collect()} == {(2, 100 + k) for k in range(5)}


def test_propagation_matches_enumeration(spark):
    """Two classes of one source compete for one of another; exact marginals by enumeration of allowed matchings."""
    import math

    rows = [(1, 3, "s", "t", 2.0), (2, 3, "s", "t", 1.0), (4, 5, "s", "t", 0.5)]
    got = {(r.a, r.b): r.p for r in linkage.propagate(spark.createDataFrame(rows, "a bigint, b bigint, a_source string, b_source string, odds double")).collect()}
    z, mass = 0.0, {(1, 3): 0.0, (2, 3): 0.0}
    for on in itertools.product((0, 1), repeat=2):
        if sum(on) <= 1:
            w = math.exp(2.0 * on[0] + 1.0 * on[1])
            z += w
            for k, bit in zip(mass, on):
                mass[k] += w * bit
    assert all(abs(got[k] - mass[k] / z) < 0.03 for k in mass) and abs(got[4, 5] - 1 / (1 + math.exp(-0.5))) < 1e-9


PAIRS = "a bigint, b bigint, a_source string, b_source string, odds double"


def test_messages_mend_what_the_prior_gets_wrong(spark):
    """1-12 looks likely by itself, but 2 fits nothing but 12 and 1 fits 11 as well: the matching that places all wins."""
    rows = [(1, 11, "s", "t", 3.0), (1, 12, "s", "t", 1.0), (2, 12, "s", "t", 4.0), (3, 13, "s", "t", -0.5)]
    got = {(r.a, r.b): r.p for r in linkage.propagate(spark.createDataFrame(rows, PAIRS)).collect()}
    assert {k for k, p in got.items() if p >= 0.5} == {(1, 11), (2, 12)}
    assert {(a, b) for a, b, _, _, odds in rows if odds >= 0} == {(1, 11), (1, 12), (2, 12)}


def test_long_contests_settle(spark, monkeypatch):
    """A chain of contested pairs, each link a little weaker: exact marginals of a chain by forward and backward sums."""
    import math

    n = 41
    odds = [2.0 - 0.01 * k for k in range(n)]
    # Pair k joins class k // 2 of one source with class (k + 1) // 2 of the other: neighbours share an end.
    rows = [(k // 2, 1000 + (k + 1) // 2, "s", "t", odds[k]) for k in range(n)]
    w = [math.exp(x) for x in odds]
    f = [(1.0, 0.0)]
    for k in range(n):
        f.append((f[-1][0] + f[-1][1], f[-1][0] * w[k]))
    b = [(1.0, 1.0)]
    for k in reversed(range(1, n)):
        off, on = b[0]
        b.insert(0, (off + w[k] * on, off))
    z = sum(f[-1])
    want = [f[k + 1][1] * b[k][1] / z for k in range(n)]
    got = {(r.a, r.b): r.p for r in linkage.propagate(spark.createDataFrame(rows, PAIRS)).collect()}
    assert all(abs(got[r[0], r[1]] - p) < 0.01 for r, p in zip(rows, want))
    monkeypatch.setattr(linkage, "MAX_ROUNDS", 5)
    with pytest.raises(RuntimeError):
        linkage.propagate(spark.createDataFrame(rows, PAIRS))


def test_variants_of_a_class_don_t_compete(spark):
    """Two wordings of a vacancy in one source both match the other source's posting."""
    again = post(30, "adzuna", "Ingénieur data senior – Fraude Luxe", "Abnamin Studio", "Lyon, France", "Le programme Helstavre recrute, site de Lyon.", "Other", 40)
    df = spark.createDataFrame([ROWS[0], again, ROWS[1]], POST)
    assert found(linkage.match_postings(df)) == {(1, 2), (2, 30)}


def found(df):
    return {(r.posting_id_a, r.posting_id_b) for r in df.collect()}


def test_history(spark, tmp_path):
    old = spark.createDataFrame(ROWS, POST)
    typo = post(20, "adzuna", "Ingénieur  data senior – Fraude Luxe (reposted)", None, "Lyon, Auvergne-Rhône-Alpes", "Rejoignez le programme Helstavre de Abnamin Studio, site de Lyon.", "Elmthorit", 18)
    new = [typo, post(21, "adzuna", *ROWS[4][3:6], "Rejoignez le programme Annex de Abnamin Studio, site de Annecy.", "Elmthorit"),
           post(22, "adzuna", *ROWS[4][3:6], "Rejoignez le programme Annex de Abnamin Studio, site de Annecy.", "Elmthorit"),
           post(23, "workable", *ROWS[0][3:6], "Rejoignez le programme Helstavre de Abnamin Studio, site de Lyon.", "Elmthorit")]
    batch = spark.createDataFrame(new, POST)
    assert found(history.repeated_postings(old.union(old), batch)) == {(1, 20), (21, 22)}
    assert found(history.repeated_postings(old.limit(0), batch.limit(0))) == set()
    store = history.ChunkTable(spark, str(tmp_path / "chunks"))
    store.append(old)
    assert found(store.accept(batch)) == {(1, 20), (21, 22)}
    again = spark.createDataFrame([(30, *new[3][1:])], POST)
    assert found(store.check(again)) == {(23, 30)}


SAME = ("Ingénieur data senior – Fraude Luxe", "Abnamin Studio", "Lyon, France")


def vacancy(i, *sentences, source_id=None):
    return (i, "adzuna", source_id or f"ref-{i}", *SAME, " ".join(sentences), 1)


def sentence(seed, n=14):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(n)) + "."


def test_coverage_decides(spark, tmp_path):
    """Equal employer, post, level and place: what the texts share decides, and moving the bound moves the decision."""
    common, own = sentence("c"), [sentence(k, 30) for k in range(9)]
    old = spark.createDataFrame([vacancy(1, common, *own[:4])], POST)
    batch = spark.createDataFrame([vacancy(2, common, *own[4:8]), vacancy(3, common, *own[:3], own[8])], POST)
    got = {}
    for bound in (0.05, 0.3, 0.95):
        table = history.ChunkTable(spark, str(tmp_path / f"t{bound}"), bound)
        table.append(old)
        got[bound] = found(table.check(batch))
    assert got == {0.05: {(1, 2), (1, 3)}, 0.3: {(1, 3)}, 0.95: set()}
    # A record delivered twice, on either side, doesn't count its chunks twice.
    table = history.ChunkTable(spark, str(tmp_path / "twice"), 0.15)
    table.append(old.union(old))
    assert found(table.check(batch.where("posting_id = 2").union(batch.where("posting_id = 2")))) == set()


def test_ids_open_links(spark):
    """A rewritten text under the same id is found; a placeholder id, or another post under it, is none."""
    old = spark.createDataFrame([vacancy(1, sentence(1, 40), source_id="A77"), vacancy(2, sentence(2, 40), source_id="n/a")], POST)
    other = (13, "adzuna", "A77", "Comptable – Froid Gros", "Abnamin Studio", "Lyon, France", sentence(5, 40), 1)
    batch = spark.createDataFrame([vacancy(11, sentence(3, 40), source_id="A77"), vacancy(12, sentence(4, 40), source_id="N/A"), other, vacancy(14, source_id="A77")], POST)
    assert found(history.repeated_postings(old, batch)) == {(1, 11), (1, 14)}


def test_batches_one_after_the_other(spark, tmp_path):
    """Small batches in order give what one batch gives; a row that shares its text with a repeat only goes back to the first one."""
    parts = [sentence(k, 30) for k in range(12)]
    rows = [vacancy(k + 1, *parts[2 * k : 2 * k + 4]) for k in range(5)]
    old = spark.createDataFrame(rows[:1], POST)
    whole = found(history.repeated_postings(old, spark.createDataFrame(rows[1:], POST)))
    table = history.ChunkTable(spark, str(tmp_path / "one"))
    table.append(old)
    by_batch = set()
    for row in rows[1:]:
        by_batch |= found(table.accept(spark.createDataFrame([row], POST)))
    assert whole == by_batch == {(1, k) for k in (2, 3, 4, 5)}


def test_endless_links_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(history, "MAX_ROUNDS", 2)
    chain = spark.createDataFrame([(k + 1, k) for k in range(40)], "b bigint, a bigint")
    with pytest.raises(RuntimeError):
        history.earliest(chain)


def test_chunks_survive_edits():
    rnd = random.Random(3)
    words = [f"w{rnd.randint(0, 5000)}" for _ in range(400)]
    edited = [*words[:200], "new", *words[201:]]
    a, b = postings.chunk([" ".join(words)]), postings.chunk([" ".join(edited)])
    assert sum(n for h, n in set(a) & set(b)) > 0.8 * sum(n for _, n in a) and postings.chunk(["", " "]) == []


# --- 8 tokenizer


def test_encoding_is_the_public_one(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(str(P.path("byte_bpe_50k.json")))
    reference.encode_special_tokens = True
    texts = [None, "", " ", "  \n\t x", "Élan déjà-vu’s 12,5 % 😀 ñandú", "a" * 700, "=" * 300, "<|endoftext|>", "​ 　 б日本語", "Elmrcedalgaf's we're \r\n\r\n", "😀" * 40]
    df = spark.createDataFrame([(n, t, [1]) for n, t in enumerate(texts)] + [(1, "", [2]), (0, "other", [3]), (None, "no id Zyxwvut", [4])], "doc_id bigint, text string, ids array<int>")
    got = tokenizer.encode(df, path=VOCABULARY)
    rows = got.select("doc_id", "ids", tokenizer.decode(F.col("ids"), VOCABULARY).alias("back")).collect()
    assert len(rows) == len(texts) + 3
    for n, t in enumerate(texts):
        mine = [r for r in rows if r.doc_id == n and r.back == (t or "")]
        assert mine and list(mine[0].ids) == reference.encode(t or "", add_special_tokens=False).ids
    assert [r.back for r in rows if r.doc_id is None] == ["no id Zyxwvut"]
    assert tokenizer.encode(df.limit(0)).count() == 0


# --- 9 leakage

VOCAB = "the answer must say who calmly warns owner of site first when blue ledger went missing graders look for patient memory and penalise hasty reports".split()


def brute(doc, item, least=12):
    a, b = leakage.passage_words(doc), leakage.passage_words(item)
    return max((m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()), default=0) >= least


def test_leaks_against_brute_force(spark):
    rnd = random.Random(5)
    items = [(k, " ".join(rnd.choice(VOCAB) for _ in range(40)), "en") for k in range(6)]
    docs = []
    for n in range(60):
        item, size = rnd.choice(items)[1].split(), rnd.choice([8, 11, 12, 15, 30])
        at = rnd.randint(0, 40 - size)
        docs.append((n, "lorem ipsum dolor " * 5 + " ".join(item[at : at + size]).upper() + ", sit amet " * 6, 1))
    df = spark.createDataFrame([*docs, (100, None, 1), (101, "", 1), (None, items[0][1], 1)], "doc_id bigint, text string, item_id int")
    it = spark.createDataFrame([*items, (50, None, "en"), (51, "too short", "en")], "item_id int, text string, lang string")
    rows = leakage.find_leaks(df.union(df), it).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    want = {(d, k) for d, t, _ in docs for k, i, _ in items if brute(t, i)}
    assert want <= got and len(rows) == len(got) and (None, 0) in got
    assert all(d is None or (d, k) in want for d, k in got)
    kept = {r.doc_id for r in leakage.without_leaks(df, it).collect()}
    assert kept == {d for d, *_ in docs} - {d for d, _ in want} | {100, 101, None}
    assert leakage.find_leaks(df.limit(0), it).count() == leakage.find_leaks(df, it.limit(0)).count() == 0


def test_changed_passages(spark):
    item = "Since a museum shop shares the spare rota sheet with a small bus garage, the answer must say who formally warns the owner of the site first of all"
    words = item.split()
    changed = " ".join("perhaps" if k in (5, 14, 21) else w for k, w in enumerate(words))
    marked = "<p>" + " ".join(f"<b>{w}</b>" if k % 7 == 0 else w for k, w in enumerate(words)).replace("é", "e") + "</p>"
    short = " ".join(words[:10])
    df = spark.createDataFrame([(1, changed), (2, marked), (3, short), (4, item.replace(" ", "  "))], "doc_id bigint, text string")
    assert {r.doc_id for r in leakage.find_leaks(df, spark.createDataFrame([(9, item)], "item_id int, text string")).collect()} == {1, 2, 4}


def test_changed_words_of_other_items(spark):
    item = "since a museum shop shares the spare rota sheet with a small bus garage the answer must say who formally warns the owner of the site first of all"
    # Uses the fillers and the words of the first item's slots: "again" beside other words, "freezer log" for "rota sheet".
    other = "the queue never forms again provided that perhaps a seaside orchard shares the spare freezer log with a large bus garage and they must say who quietly waits"
    filled = " ".join({5: "again", 14: "perhaps", 21: "again", 23: ""}.get(k, w) for k, w in enumerate(item.split()))
    alike = item.replace("rota sheet", "freezer log").replace("small", "large").replace("formally", "quietly")
    short = "the answer must say who again warns the owner of the site"
    shorter = "must say who again warns the owner of the site"
    slot = "shop shares the spare freezer sheet with a small bus garage the"
    named = "shares the spare rota sheet with a zealous bus garage the answer"
    df = spark.createDataFrame(list(enumerate([filled, alike, short, shorter, slot, named])), "doc_id bigint, text string")
    it = spark.createDataFrame([(9, item), (8, other)], "item_id int, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(df, it).collect()} == {(0, 9), (2, 9)}


def test_many_open_chains():
    item = list(range(1, 1001))
    # Between the two halves of a passage, sixty matches elsewhere in the item open chains of their own.
    hits = [(0, 0, 10), *((8, 100 + 10 * k, 3) for k in range(60)), (11, 11, 10)]
    best = leakage.chains(hits, [*range(1, 11), 0, *range(12, 22)], item, leakage.Slots([item]))
    assert best[0] == (0, 21, 21, 20, 10, 0, 0) and len(best) == 61


# --- 10 content


def test_undisguise():
    words = lambda t: [w for p in toxicity.passages(t) for w in p]
    assert words("quel n u i s i b l e") == ["quel", "nuisible"] and words("tu es d.é.b.i.l.e") == ["tu", "es", "debile"]
    assert words("an 1d10t, an an​imal, un dééééébile, un cаfаrd, r**é") == ["an", "idiot", "an", "animal", "un", "debile", "un", "cafard", "<mask>"]
    assert toxicity.passages(None) == toxicity.passages("  ") == []


def test_kneser_ney_sums_to_one():
    from collections import Counter

    scorer = toxicity.Scorer(Counter({("a", "b", "a"): 2, ("b",): 1}), Counter({("a", "c"): 3}))
    for model in (scorer.toxic, scorer.ordinary):
        # What the unigrams leave goes to words never seen, one of which stands for all of them here.
        left = 1 - sum(model.base.values())
        for context in ((), ("a", "b"), ("<s>", "<s>"), ("x", "y"), ("b", "a")):
            seen = sum(model.prob(context, w) for w in model.base)
            share = model.prob(context, "never seen") / model.unseen
            assert abs(seen + left * share - 1) < 1e-9


def test_held_out_accuracy():
    c = duckdb.connect()
    rows = c.execute("select d.text, l.abusive from '/root/testdata/sf0.1/documents.parquet' d join '/root/testdata/sf0.1/content_labels.parquet' l using (doc_id) order by doc_id").fetchall()
    train, test = rows[::2], rows[1::2]
    scorer = toxicity.fit(train)
    said = [(s is not None and s >= scorer.threshold, bool(y)) for t, y in test for s in [scorer.text(t)]]
    hit = sum(a and b for a, b in said)
    # Two dozen abusive documents to learn from; ten times as many give 0.99 and 1.0 (README).
    assert hit / max(1, sum(a for a, _ in said)) >= 0.85 and hit / sum(b for _, b in said) >= 0.55


def test_score_tables(spark):
    docs = spark.createDataFrame([(1, "Tu es un imbécile, ferme-la.", "a", 9), (2, None, "a", 9), (3, " ", None, 9), (4, "We are looking for an engineer to join our team.", "b", 9)], "doc_id bigint, text string, source string, score int")
    labels = spark.createDataFrame([(1, None), (9, 1)], "doc_id bigint, abusive int")
    rows = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert rows[1].abusive and not rows[4].abusive and rows[2].score is None and rows[3].score is None and not rows[2].abusive
    rate = {r.source: (r.documents, r.abusive, r.rate) for r in toxicity.rates(toxicity.score(docs, labels)).collect()}
    assert rate == {"a": (2, 1, 0.5), None: (1, 0, 0.0), "b": (1, 0, 0.0)}
    assert toxicity.score(docs.limit(0), labels.limit(0)).count() == 0


# --- queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    df = queries.QUERIES[name](spark, SMALL)
    rows = df.collect()
    assert df.columns and (len(rows) == len({str(r) for r in rows}) or name in ("p10_scores", "p8_decoded", "p8_ids"))
    if name in queries.ORACLE:
        c = duckdb.connect()
        c.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
        assert sorted(map(tuple, rows)) == sorted(c.execute(queries.ORACLE[name]).fetchall())
