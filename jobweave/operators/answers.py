"""Interview answers and screening questions: structure, balance, what a question asks, and form fields and addresses that must not be filled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobweave.text import fold

#: Words of the four parts of an answer, in folded text with straight apostrophes.
PARTS = {
    "situation": r"\b(?:contexte|context|situation|cadre|epoque|moment|a l'epoque|au moment ou|background|at the time|when i was)\b",
    "task": r"\b(?:mission|objectif|tache|defi|challenge|responsabilite|charge de|devais|needed to|had to|my role|my goal|tasked)\b",
    "action": (
        r"\b(?:j'ai|j'avais|nous avons|on a)\b|\bi (?:decided|implemented|built|created|proposed|designed|led|developed|wrote|set up|coordinated|reached out|"
        r"did|made|took|drove|launched|initiated|delivered|managed|owned|handled)\b"
    ),
    "result": (
        r"\b(?:resultat|resultats|impact|bilan|outcome|en consequence|as a result|which resulted|led to|achieved|delivered|succes|reussi|gagne|atteint|succeeded)\b"
        r"|\bwe (?:reduced|increased|saved|improved|grew|cut|boosted|hit|reached)\b"
    ),
}
QUANTIFIED = r"\d+\s*[%€$£k]|\d[\d\s]*[.,]\d+|\b\d{2,}\b|\b(?:twice|double|triple|x\d+|\dx)\b"
I_WORDS, WE_WORDS = r"\b(?:je\b|j'|i\b)", r"\b(?:nous|on|we)\b"
#: Words a minute, and bands of the score.
PACE, HIGH, LOW = 130, 70.0, 40.0


def plain(text: Column) -> Column:
    return F.regexp_replace(fold(text), "[’ʼ]", "'")


def star(text: Column) -> dict[str, Column]:
    """Whether each of the four parts of an answer is there."""
    return {name: plain(text).rlike(p) for name, p in PARTS.items()}


def balance(text: Column) -> Column:
    """How often the speaker says "I" for each "we"."""
    t = plain(text)
    return F.round(F.regexp_count(t, F.lit(I_WORDS)) / F.greatest(F.lit(1), F.regexp_count(t, F.lit(WE_WORDS))), 3)


def judged(text: Column) -> dict[str, Column]:
    """``has_star, quantified, balance, words, seconds, score, band`` of an answer."""
    parts = star(text)
    found = sum((c.cast("int") for c in parts.values()), F.lit(0))
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))
    seconds, share, quantified = F.round(words / PACE * 60).cast("int"), balance(text), fold(text).rlike(QUANTIFIED)
    structure = F.when(found == 4, 40).otherwise(found * 10)
    length = F.when(seconds.between(90, 180), 20).when(seconds.between(60, 240), 10).otherwise(0)
    spoken = F.when(share.between(0.5, 5.0), 20).when(share.between(0.2, 10.0), 10).otherwise(0)
    score = structure + F.when(quantified, 20).otherwise(0) + length + spoken
    band = F.when(score >= HIGH, "high").when(score >= LOW, "med").otherwise("low")
    return {"has_star": found == 4, "quantified": quantified, "balance": share, "words": words, "seconds": seconds, "score": score, "band": band}


#: What a screening question is about, by folded wording; the first kind that applies. The first four are a person's to answer.
INTENTS = {
    "authorization": r"\b(?:authori[sz]ed to work|work permit|visa|sponsorship|right to work|citizen|autorisation de travail|permis de travail|titre de sejour)",
    "salary": r"\b(?:salary|salaire|compensation|remuneration|pretentions)|\bwhat\s+do\s+you\s+expect",
    "availability": r"\b(?:relocat|mobile\b|mobilite\b|notice\s+period|preavis\b|availab|disponib|start\s+date|when\s+can\s+you\s+start|quand\s+(?:pouvez|peut)|date\s+de\s+debut|willing\s+to\s+move)",
    "why_here": r"\bwhy\s+(?:do\s+you\s+want|are\s+you\s+interested|this\s+company|this\s+role|work\s+here)|\bpourquoi\s+(?:voulez|souhaitez|cette\s+entreprise|ce\s+poste|travailler\s+ici)|\bwhat\s+(?:attracts|interests)\s+you",
    "years": r"\bhow\s+many\s+years|\byears?\s+(?:of\s+)?experience|\bcombien\s+d.annees|\bannees?\s+d.experience",
    "skill": r"\b(?:experience\s+with|familiar\s+with|knowledge\s+of|worked\s+with|have\s+you\s+used)\b|\bavez[- ]vous\s+(?:utilise|une\s+experience|de\s+l.experience|travaille)|\bmaitrisez[- ]vous|\bdo\s+you\s+know\b",
}
#: What stands before the name of a skill in a question, folded.
ASKED = (
    r"(?:experience\s+with|knowledge\s+of|familiar\s+with|have\s+you\s+used|worked\s+with|worked\s+on|do\s+you\s+know|"
    r"avez[- ]vous\s+(?:utilise|une\s+experience\s+avec|travaille\s+(?:avec|sur))|maitrisez[- ]vous|avec)\s+([a-z][a-z0-9#+_./ -]{0,39}?)\s*(?:[?.,;!]|$|\s(?:in|for|or|before|en)\s)"
)


def intent(question: Column) -> Column:
    """What a question is about: the first kind of INTENTS that applies, else "other"."""
    q = plain(question)
    kind = F.lit("other")
    for name, pattern in reversed(INTENTS.items()):
        kind = F.when(q.rlike(pattern), name).otherwise(kind)
    return kind


def asked_skill(question: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(plain(question), ASKED, 1)), F.lit(""))


def holds_skill(skill: Column, terms: Column) -> Column:
    """Whether a CV's terms (an array) hold a skill, or one of its words."""
    parts = F.regexp_extract_all(F.lower(skill), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}+#./-]+"), 0)
    return F.array_contains(terms, F.lower(F.trim(skill))) | F.arrays_overlap(terms, parts)


#: Kinds of form fields that must not be filled, by lower-case name, the first that applies.
FIELDS = {
    "password": r"password|passwd|pass|mot.?de.?passe|mdp|secret|pin\b|code.?secret",
    "card": r"card.?number|num.?carte|card.?num|numero.?carte|credit.?card|debit.?card|carte.?bancaire|carte.?credit|pan\b|cc.?number|cc_num",
    "cvc_cvv": r"cvv|cvc|csc|security.?code|card.?security|cryptogramme|crypto.?visuel|code.?carte|cv2|card.?verif",
    "iban": r"iban|bic|swift|rib\b|account.?number|num.?compte|numero.?compte|bank.?account|compte.?bancaire|routing.?number|sort.?code",
    "ssn": r"ssn|social.?security|numero.?secu|nir\b|sin\b|national.?id|national.?insurance|nino\b|tax.?id|tin\b|fiscal.?id|identifiant.?fiscal",
    "otp_2fa": r"otp|totp|one.?time|2fa|two.?factor|mfa|auth.?code|verification.?code|code.?verification|sms.?code|code.?sms|token.?auth",
    "crypto": r"wallet.?address|private.?key|seed.?phrase|mnemonic|crypto.?address|btc.?address|eth.?address|public.?key",
}
#: Addresses of payment and of sign-in pages, in lower case.
PAYMENT = (
    r"checkout|/pay(?:ment)?(?:/|$|\.)|\.pay(?:ment)?(?:/|$|\.)|/billing|\.billing|/cart(?:/|$|\.)|/orders?(?:/checkout|/pay|/payment)|stripe\.com|paypal\.com|"
    r"braintree|square\.com/payments|adyen\.com|mollie\.com|paiement|/encaissement"
)
SIGN_IN = (
    r"/login|/signin|/sign.in|/connexion|/authentification|/auth(?:/|$|\.)|/sessions?(?:/new|/create)|/sso|/oauth|/oidc|/saml|/password.?reset|/forgot.?password|/mot.?de.?passe"
)


def field_kind(name: Column) -> Column:
    kind, low = F.lit("safe"), fold(name)
    for k, pattern in reversed(FIELDS.items()):
        kind = F.when(low.rlike(pattern), k).otherwise(kind)
    return kind


def blocked(url: Column) -> Column:
    """Why a page must not be acted on: "payment", "sign-in", or null."""
    low = F.lower(url)
    return F.when(low.rlike(PAYMENT), "payment").when(low.rlike(SIGN_IN), "sign-in")
