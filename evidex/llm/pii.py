"""P1: personal information inside free text.

Candidate spans come from shapes, gazetteers and given names learned from the
contexts of all texts. Labelers (shape, gazetteer, context before, context
after, rarity) vote on each; expectation-maximisation over the votes of all
candidates estimates how reliable every labeler is, and its posteriors train
the span classifier that decides on every candidate. Accepted spans are replaced
by placeholders of their type. Fitting goes over every distinct text: words are
counted as tables, and the classifier takes sums of its gradient over equal cases.
Each distinct text is searched once: its candidates are kept as a table, on which
the classifier is fitted and then decides, and rows find them by their text's digest.

Edge cases: null, blank and valueless texts give no span and stay as they are;
texts of any length are read whole; spans never overlap, the earlier and then
the longer one counts; positions are Unicode code points from 0; repeated rows
each give their spans; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.session import spread, stage

KINDS = ["name", "email", "phone", "id_number", "address"]
#: A word is common if at least this share of the distinct texts has it; one begins sentences if it begins so many for each text. Four at least.
COMMON, STARTS = 0.0008, 1 / 6000
FEATURES = 1 << 14
#: A capitalised word is learned as a given name if it comes before at least so many different rare words, they are at least this
#: share of the different words it comes before, and this share of its uses is announced or followed as persons are.
LEARN_SURNAMES, LEARN_VARIETY, LEARN_CUED = 5, 0.5, 0.4
#: Strength of the classifier's prior that a feature says nothing; its fit ends with the step that takes less than this share off the loss.
RIDGE, SETTLED = 0.1, 3e-5
#: Counts a task holds before it passes them on.
HELD = 200_000
#: Characters the longest surname with its particles takes; and the longest end of a phone or identity number after its digits.
_SURNAME, _TAIL = 60, 16

# Given names of the languages covered.
GIVEN = set(
    "adam agnes aisha alan alejandro alexander alfred alice amelia amir ana anastasia andrea andreas anna anne anthony antonio arthur barbara beatriz benjamin bernard björn bruno camille carla carlos carmen caroline catherine charles "
    "charlotte chloe christian christine clara claire claudia constance cristina daniel daniela david deborah dennis diana diego dmitri edmund eduardo elena elisabeth elizabeth emily emma enrique erik eva fatima felix fernando florian "
    "francesca francisco frank franziska frederik gabriel george gerhard giovanni giulia giuseppe greta guadalupe gwendolyn hannah hans heinrich helen henrietta henry hugo ignacio ingrid irene isabel isidora ivan jack jacob james jan "
    "jane javier jean jessica joana johannes john jonas jorge josé joseph juan julia julien jürgen karin karl katherine klaus laura leopold linda louis lucas lucia luis luisa maarten manuel marco margaret maria mario marta martin mary "
    "matteo matthew maximilian michael miguel mohammed monika nancy natalia nathan nicolas nikolaus nina oliver olga oluwaseun pablo patricia paul paula pedro peter philip pierre priyanka quentin rafael rebecca rené richard robert "
    "rosa ruth samuel sandra sarah sebastian sofia sophie søren stefan stephen susan sven tatiana theodore thomas tiago ursula valentina vincent vladislav walburga walter wilhelm willem william xenia yusuf zoë".split()
)
PARTICLES = r"(?:(?:van der|van den|van de|van|von der|von|de la|del|della|dos|das|de|di|da|du|der|den|le|la|al|el|bin|ibn)\s)"
# Words before a value of each kind, and words that mark other numbers.
CUES = {
    "name": "contact attendees from ask who is with con mit avec regards emergency or and wants hello dear hi frau herr mr mrs ms dr prof m mme señor señora sr sra by holder auf an bei owe reach joindre llamar a de cc name",
    "email": "mail email e-mail write to contact cc bcc an a from reach escribe écrire address came",
    "phone": "number tel phone mobile call at reach unter au al telefon téléphone teléfono cell fax regards",
    "id_number": "id ssn dni nif passport steuer-id ausweisnummer identity identité identidad number mine is no no. nr nino ahv holder",
    "address": "home address lives at to moved adresse anschrift dirección parcel is lautet es a an",
}
CUES = {k: set(v.split()) for k, v in CUES.items()}
# Words before numbers and codes that belong to nobody, and words of places.
OTHER = set("order section ticket part item build release version page pages chapter verse figure table paragraph article invoice model serial commit checksum hash port job line row range step week rfc clone pinned".split())
PLACES = set("port saint mount lake new north south east west fort cape square street road bridge station airport river park hall bay valley island".split())
STREETS = "street|st\\.|road|rd\\.?|avenue|ave\\.?|boulevard|blvd\\.?|lane|ln\\.?|drive|dr\\.|close|terrace|court|ct\\.|place|square|way|crescent|row|mews|gardens|grove|hill|park"
STREETS_DE = "straße|strasse|str\\.|platz|weg|gasse|allee|ufer|damm|ring|straat|laan|plein|gracht|kade"
STREETS_FR = "rue|avenue|av\\.|boulevard|bd\\.?|place|allée|chemin|impasse|quai|cours|route|via|viale|piazza|corso|largo"
STREETS_ES = "c/|calle|avenida|avda\\.?|plaza|paseo|rua|travessa|praça|largo|camino|carrer|ronda"

_W = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_C = rf"(?-i:[^\W\d_a-zäöüéèñß]){_W}"
_TOWN = rf"{_W}(?:\s{_W}){{0,2}}?"
_POST = r"(?:[A-Z]{1,2}\d{1,2}[A-Z]?\s\d[A-Z]{2}|[A-Z]{2}\s\d{5}(?:-\d{4})?|\d{5}|\d{4}\s?[A-Z]{2})"
_SEP = r"(?:,\s*|\s*\n\s*)"
ADDRESS = re.compile(
    rf"(?<![\w/-])(?:"
    rf"(?:(?:flat|apt\.?|apartment|unit|suite|room)\s\d+[a-z]?{_SEP})?\d{{1,5}}[a-z]?\s(?-i:[^\W\d_a-z]){_W}(?:\s(?-i:[^\W\d_a-z]){_W})?\s(?:{STREETS})(?!\w)(?:{_SEP}(?:apt\.?|apartment|unit|suite|flat|floor|fl\.?|#)\s?\d+[a-z]?)?(?:{_SEP}{_TOWN}(?:,?\s{_POST})?(?![\w-]))?"
    rf"|\d{{1,4}}[a-z]?(?:\s(?:bis|ter))?,?\s(?:{STREETS_FR})\s(?:(?:de|du|des|de la|della|dei|d['’]|l['’])\s?)*{_C}(?:\s{_W}){{0,2}}(?:{_SEP}(?:\d{{5}}\s)?{_W})?"
    rf"|(?:{STREETS_ES}|{STREETS_FR})\s?(?:(?:de|del|da|do|la|di)\s)*{_C}(?:\s{_W}){{0,2}},?\s(?:n[º°o]\.?\s?)?\d{{1,4}}[a-z]?(?:,\s?(?:\d{{1,2}}\s?[ºª°]\s?(?:izq|der|dcha|[a-z])\.?|bajo|ático|atico|izq\.?|\d[ºª]))*(?:{_SEP}(?:\d{{5}}(?:-\d{{3}})?\s)?{_W})?"
    rf"|(?:{_C}-?|{_C}\s)(?:{STREETS_DE})\s\d{{1,4}}\s?[a-z]?(?!\w)(?:{_SEP}(?:\d{{5}}|\d{{4}}\s?[A-Z]{{2}})\s{_W})?"
    rf")",
    re.IGNORECASE,
)
#: What every address holds; addresses are looked for around each of these.
_STREET_WORDS = {re.sub(r"\\\.\??", "", w): 2 if part is STREETS_DE else 1 for part in (STREETS, STREETS_FR, STREETS_ES, STREETS_DE) for w in part.split("|")}
EMAIL = re.compile(
    r"(?<![\w.+%-])[\w%+-]+(?:\.[\w%+-]+)*(?:\s?@\s?|\s?[\[(]\s?(?:at|ät|arroba)\s?[\])]\s?)"
    r"[\w-]+(?:(?:\.|\s?[\[(]\s?(?:dot|punkt|punto|point)\s?[\])]\s?)[\w-]+)+",
    re.IGNORECASE,
)
PHONE = re.compile(
    r"(?<![\w.+/#-])(?<!\d[ -])(?:"
    r"(?:\+|00)\d{1,3}(?:[ .-]\(?\d{1,8}\)?){2,5}|\+\d{9,14}"
    r"|(?:1[ .-])?\(\d{3}\)\s?\d{3}[ .-]\d{4}|(?:1[ .-])?\d{3}([.-])\d{3}\1\d{4}"
    r"|0\d{2,4}[/-]\d{5,9}|0\d{4}\s\d{3}\s\d{3}|0\d{3}\s\d{3}\s\d{4}|0\d(?:[ .]\d{2}){4}|0\d{2,4}\s\d{5,8}|[69]\d{2}\s\d{3}\s\d{3}"
    r")(?:\s?(?:ext\.?|x)\s?\d{1,5})?(?![\w/]|[.-]\d)"
)
ID_NUMBER = re.compile(
    r"(?<![\w./#@-])(?<!\d )(?:\d{3}-\d{2}-\d{4}|[A-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]|\d{2}\s\d{3}\s\d{3}\s\d{3}|756\.\d{4}\.\d{4}\.\d{2}"
    r"|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|[A-Z]\d{2}[A-Z]\d{2}[A-Z]\d{2}|[A-Z]{1,2}\d{6,8}|[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]|\d{3}\.\d{3}\.\d{3}-\d{2}|[12]\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}\s?\d{3}\s?\d{2})(?![\w-]|[./]\d)",
    re.IGNORECASE,
)
_CLUSTER = re.compile(r"\d[\d .()/\-A-Za-z]{0,1}(?:[\d .()/\-]|[A-Z](?![a-z]))*")
_INITIAL = re.compile(rf"(?<![\w.'’@+-])(?:[^\W\d_]\.\s?){{1,2}}(?=\s?{PARTICLES}*{_W})", re.IGNORECASE)
_PAIR = re.compile(r"(?<![\w.@+-])[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+\s[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:-[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)?(?![\w@])")
_AFTER_GIVEN = re.compile(rf"((?:\s[^\W\d_]\.)*)\s({PARTICLES}*)({_W})(?![\w@])", re.IGNORECASE)
_AFTER_INITIAL = re.compile(rf"({PARTICLES}*)({_W})(?![\w@])", re.IGNORECASE)
_BEFORE_COMMA = re.compile(rf"(?<![\w.'’@-])({PARTICLES}*)({_W}),\s$", re.IGNORECASE)
_LAST_WORDS = re.compile(r"([\w.’'-]+)[^\w]*$")
_FIRST_WORD = re.compile(r"^[^\w]*([\w-]+)")
_COMMA_GIVEN = re.compile(r",\s([^\W\d_]+)(?=\s*(?:[,;:.<(-]|$|\n))")
_STARTER = re.compile(r"(?:^|[.!?]\s|\n)\W*([^\W\d_]+)")
_WORD = re.compile(r"[^\W\d_]+")
_PLAIN = re.compile(r"(?<!\w)[a-zß-öø-ÿ]{2,}(?!\w)")
_RIGHT = re.compile(r"^(?:\s?[<:;]|\s-\s|,?\s(?:wants|moved|at|au|al|im|en|on|dans|a reply|and|or|unter|call|wrote)\b|\s*$|\s?\n)", re.IGNORECASE)


def _case(w: str) -> str:
    return "U" if len(w) > 1 and w.isupper() else "l" if w.islower() else "T" if w[:1].isupper() else "x"


@dataclass
class Lexicon:
    """Words common in the texts, words that begin sentences there, and an automaton of given names and street words."""

    common: set[str] = field(default_factory=set)
    starters: set[str] = field(default_factory=set)
    given: set[str] = field(default_factory=lambda: set(GIVEN))

    def __post_init__(self):
        self.automaton = ahocorasick.Automaton()
        for w, joins in _STREET_WORDS.items():  # joins: 2 where the word may end another one
            self.automaton.add_word(w, (0, len(w) if joins == 1 else -len(w)))
        for g in self.given:
            self.automaton.add_word(g, (len(g), 0))
        self.automaton.make_automaton()


@dataclass
class Span:
    kind: str
    start: int
    end: int
    votes: tuple[int, ...]
    features: list[int]


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)


def _names(text: str, low: str, hits: list[tuple[int, int]], lex: Lexicon) -> list[tuple[int, int, str, str]]:
    """(start, end, given or initial, surname) of name candidates; hits: last position and length of given names in low."""
    out = []

    def surname_fits(given_case: str, sur: str) -> bool:
        c = _case(sur)
        if sur.lower() in lex.given and c != "U":
            return False
        if given_case == "l":
            return c == "l" and len(sur) > 2 and sur not in lex.common
        if given_case == "U":
            return c == "U" and len(sur) > 1
        return c in "Tx" and len(sur) > 1 or c == "U" and len(sur) > 2

    for last, n in hits:
        s, e = last - n + 1, last + 1
        if (s and (low[s - 1].isalnum() or low[s - 1] in "_@.+-'’")) or (e < len(low) and (low[e].isalnum() or low[e] in "_@-'’")):
            continue
        given = text[s:e]
        case = _case(given)
        m = _AFTER_GIVEN.match(text, e)
        after = bool(m) and surname_fits(case, m[3])
        opens = after and case != "l" and m[3].lower() in lex.starters  # may be the next sentence instead
        if after and not opens:
            out.append((s, m.end(), given, m[3]))
            continue
        b = _BEFORE_COMMA.search(text, max(0, s - _SURNAME), s)
        if b and surname_fits(case, b[2]) and b[2].lower() not in lex.common:
            out.append((b.start(), e, given, b[2]))
        elif after and m[3].lower() not in lex.common:
            out.append((s, m.end(), given, m[3]))
    for m in _INITIAL.finditer(text):
        n = _AFTER_INITIAL.match(text, m.end())
        if n is None or n[2].lower() in lex.given or len(n[2]) < 3 or n[2].lower() in lex.common:
            continue
        behind = _COMMA_GIVEN.match(text, n.end())
        if behind and behind[1].lower() in lex.given:
            continue  # a title before a reversed name
        if m[0][0].isupper() and _case(n[2]) in "TU":
            out.append((m.start(), n.end(), m[0].strip(), n[2]))
    for m in _PAIR.finditer(text):
        a, b = m[0].split()
        if a.lower() not in lex.given and a.lower() not in CUES["name"] and not ({a.lower(), b.lower()} & lex.common):
            out.append((m.start(), m.end(), a, b))
    return out


def _around(text: str, at: int) -> tuple[int, int]:
    """Where the line before the one at holds begins, and where the line after it ends: an address takes up to three lines."""
    lo = text.rfind("\n", 0, at)
    hi = text.find("\n", at)
    nxt = text.find("\n", hi + 1) if hi >= 0 else -1
    return (text.rfind("\n", 0, lo) + 1 if lo >= 0 else 0), (nxt if nxt >= 0 else len(text))


def _h(*parts: object) -> int:
    return xxhash.xxh32_intdigest("|".join(map(str, parts))) % FEATURES


def candidates(text: str | None, lex: Lexicon) -> list[Span]:
    """Candidate spans with their labelers' votes and the classifier's features.

    A labeler abstains (0) where it sees nothing unusual; that a candidate has the shape of its kind is no vote.
    """
    if not text:
        return []
    found: list[tuple[str, int, int, list[int], str]] = []
    if "@" in text or "[" in text or "(" in text:
        for m in EMAIL.finditer(text):
            tld = re.split(r"[.\])\s]+", m[0])[-1]
            found.append(("email", m.start(), m.end(), [0 if tld.isalpha() and len(tld) > 1 else -1, -1 if text[m.end() : m.end() + 1] in ":/" and text[m.end() + 1 : m.end() + 2].isalnum() else 1], "e"))
    low, hits, streets = _lower(text), [], []
    for last, (n, street) in lex.automaton.iter(low):
        if n:
            hits.append((last, n))
        elif not low[last + 1 : last + 2].isalnum():
            at = last - abs(street) + 1
            if street < 0 or not at or not low[at - 1].isalnum():
                streets.append(at)
    numbers = [(m.start(), m.end()) for m in _CLUSTER.finditer(text)]
    for lo, hi in numbers:
        if hi - lo < 6:
            continue
        for m in PHONE.finditer(text, max(0, lo - 3), hi + _TAIL):
            n = sum(c.isdigit() for c in m[0])
            found.append(("phone", m.start(), m.end(), [0, 1 if 9 <= n <= 17 else -1], re.sub(r"\d", "9", m[0])[:16]))
        for m in ID_NUMBER.finditer(text, max(0, lo - 8), hi + _TAIL):
            found.append(("id_number", m.start(), m.end(), [0 if m[0].upper() == m[0] else -1, 0], re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", m[0]))))
    if numbers:
        reached = -1
        for at in streets:
            if at < reached:
                continue
            lo, hi = _around(text, at)
            line_end = text.find("\n", at)
            line_end = line_end if line_end >= 0 else len(text)
            for m in ADDRESS.finditer(text, max(reached, lo), hi):
                if m.start() > line_end:
                    break  # the lines around that one may hold more of it
                long = "," in m[0] or "\n" in m[0]
                found.append(("address", m.start(), m.end(), [0, 1 if long else -1], "a" if long else "s"))
                reached = m.end()
            reached = max(reached, line_end)
    for s, e, given, sur in _names(text, low, hits, lex):
        known = given.lower() in lex.given
        rare = sur.lower() not in lex.common
        place = given.lower() in PLACES or sur.lower() in PLACES
        found.append(("name", s, e, [1 if known else -1 if place else 0, -1 if not rare else 0 if place else 1], ("g" if known else "i" if given.endswith(".") else "u") + _case(sur)))
    if not found:
        return []
    rank = {"email": 0, "address": 1, "id_number": 2, "phone": 3, "name": 4}
    out: list[Span] = []
    for kind, s, e, votes, shape in sorted(found, key=lambda f: (rank[f[0]], f[1], f[1] - f[2])):
        if any(o.start < e and s < o.end for o in out):
            continue
        left = _LAST_WORDS.search(text, max(0, s - 40), s)
        before = left[1].lower().strip(".'-’") if left and "\n" not in text[left.end(1) : s].rstrip("\n") else ""
        right = _FIRST_WORD.match(text[e : e + 30])
        after = right[1].lower() if right else ""
        cue = 1 if before in CUES[kind] else -1 if before in OTHER else 0
        votes = tuple([*votes, cue, 1 if _RIGHT.match(text[e : e + 16]) else 0])
        feats = [_h(kind), _h(kind, "shape", shape), _h(kind, "b", before), _h(kind, "a", after), *(_h(kind, k, v) for k, v in enumerate(votes))]
        out.append(Span(kind, s, e, votes, feats))
    return sorted(out, key=lambda o: o.start)


def reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 40) -> dict[tuple[int, ...], float]:
    """Posterior of each vote pattern of one kind by EM, labelers being independent given the truth.

    Every labeler's reliability has the same prior, a tenth of the candidates in favour of being right four times out of five;
    the share of true candidates has a prior of one half, as strong as the candidates, as a free share would call all of them true.
    """
    patterns = list(counts)
    n = np.array([counts[p] for p in patterns], dtype=float)
    v = np.array(patterns)  # -1, 0, 1
    total, width = n.sum(), v.shape[1]
    post = 1 / (1 + np.exp(-v.sum(axis=1)))
    prior = 0.1 * total + 5
    for _ in range(rounds):
        share = (post @ n + 0.5 * total) / (2 * total)
        log = np.full(len(n), math.log(share / (1 - share)))
        for k in range(width):
            cast = v[:, k] != 0
            for value, right in ((1, 0.8), (-1, 0.2)):
                at = v[:, k] == value
                p1 = ((post * n)[at].sum() + right * prior) / ((post * n)[cast].sum() + prior)
                p0 = (((1 - post) * n)[at].sum() + (1 - right) * prior) / (((1 - post) * n)[cast].sum() + prior)
                log[at] += math.log(p1 / p0)
        post = 1 / (1 + np.exp(-log))
    return dict(zip(patterns, post))


@dataclass
class Model:
    """What the workers need: words of the texts and the classifier's weights."""

    common: set[str]
    starters: set[str]
    given: set[str]
    weights: np.ndarray

    def lexicon(self) -> Lexicon:
        return Lexicon(self.common, self.starters, self.given)

    def spans(self, text: str | None, lex: Lexicon) -> list[Span]:
        return [c for c in candidates(text, lex) if self.weights[c.features].sum() > 0]


def word_counts(text: str, into: dict[tuple[str, str, str], list[int]]) -> None:
    """Adds what a text says of words to into: (what, word, next word) -> [uses, cued].

    df: texts that hold a word, lower-cased; plain: those that hold it in lower case; head: sentences it begins;
    pair: its uses, capitalised, before another such word, and those in the contexts of persons.
    """

    def add(what: str, a: str, b: str = "", cued: int = 0) -> None:
        c = into.setdefault((what, a, b), [0, 0])
        c[0] += 1
        c[1] += cued

    for w in set(_WORD.findall(text.lower())):
        add("df", w)
    for w in set(_PLAIN.findall(text)):
        add("plain", w)
    for m in _STARTER.finditer(text):
        add("head", m[1].lower())
    for m in _PAIR.finditer(text):
        first, second = (w.lower() for w in m[0].split())
        if first in GIVEN or first in PLACES:
            continue
        left = _LAST_WORDS.search(text, max(0, m.start() - 40), m.start())
        add("pair", first, second, int(bool((left and left[1].lower().strip(".'-’") in CUES["name"]) or _RIGHT.match(text[m.end() : m.end() + 16]))))


def taught(uses, cued, rare, behind, plain):
    """Whether a capitalised word is a given name, of columns or numbers: rare: different rare words behind it; behind: different ones at all; plain: texts with it in lower case."""
    return (rare >= LEARN_SURNAMES) & (rare >= LEARN_VARIETY * behind) & (cued >= LEARN_CUED * uses) & (plain < uses)


def floors(n: int) -> tuple[float, float]:
    """Uses from which a word is common, and begins sentences, among n distinct texts."""
    return max(4, COMMON * n), max(4, STARTS * n)


def case_counts(texts: Iterable[str], lex: Lexicon) -> Counter:
    """(kind, votes, features) -> candidates."""
    return Counter((c.kind, c.votes, tuple(c.features)) for t in texts for c in candidates(t, lex))


def loss_of(w: np.ndarray, x: np.ndarray, n: np.ndarray, true: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic loss and gradient over rows of features x, each n cases of which true are expected to be true."""
    s = w[x].sum(axis=1)
    g = n / (1 + np.exp(-np.clip(s, -500, 500))) - true
    return float((n * np.logaddexp(0, s) - true * s).sum()), np.bincount(x.ravel(), np.repeat(g, x.shape[1]), FEATURES)


def classifier(kinds: Iterable[str], uses: np.ndarray, loss: Callable[[np.ndarray], tuple[float, np.ndarray]]) -> np.ndarray:
    """Weights that minimise loss and the priors, by L-BFGS scaled by how often each feature is used."""
    if not (kinds := sorted(kinds)):
        return np.zeros(FEATURES)
    # what a vote means where no case is like it: the labelers' prior, as a few candidates that have only this vote
    prior = [([_h(kind), _h(kind, k, v)], 0.5 + 0.3 * v) for kind in kinds for k in range(4) for v in (-1, 1)]
    px, pn = np.array([f for f, _ in prior]), np.full(len(prior), 5.0)
    pt = pn * np.array([t for _, t in prior])
    scale = 1 / np.sqrt(0.25 * (uses + np.bincount(px.ravel(), np.repeat(pn, 2), FEATURES)) + RIDGE)

    def at(u: np.ndarray) -> tuple[float, np.ndarray]:
        w = u * scale
        (a, ga), (b, gb) = loss(w), loss_of(w, px, pn, pt)
        return a + b + RIDGE / 2 * float(w @ w), (ga + gb + RIDGE * w) * scale

    u = np.zeros(FEATURES)
    f, g = at(u)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        d, coef = -g, []
        for s, y in reversed(past):
            coef.append((s @ d) / (s @ y))
            d = d - coef[-1] * y
        if past:
            d = d * (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (s, y), c in zip(past, reversed(coef)):
            d = d + (c - (y @ d) / (s @ y)) * s
        step = 1.0
        while True:
            f2, g2 = at(u + step * d)
            if f2 <= f + 1e-4 * step * (g @ d) or step < 1e-6:
                break
            step /= 2
        s, y, gain = step * d, g2 - g, f - f2
        if gain > 0:
            u, f, g = u + s, f2, g2
        if not gain >= SETTLED * abs(f):
            break
        if s @ y > 0:
            past = [*past[-9:], (s, y)]
    return u * scale


def train(texts: list[str]) -> Model:
    """fit() on texts that are at hand."""
    distinct = sorted({t for t in texts if t})
    counts: dict[tuple[str, str, str], list[int]] = {}
    for t in distinct:
        word_counts(t, counts)
    least, heads = floors(len(distinct))
    n = lambda what, w: counts.get((what, w, ""), (0, 0))[0]
    firsts: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    for (what, a, b), (uses, cued) in counts.items():
        if what == "pair":
            firsts[a] = [x + y for x, y in zip(firsts[a], (uses, cued, n("df", b) < least, 1))]
    given = GIVEN | {w for w, c in firsts.items() if taught(*c, n("plain", w))}
    common = {a for (what, a, _), (c, _) in counts.items() if what == "df" and c >= least and a not in given}
    starters = {a for (what, a, _), (c, _) in counts.items() if what == "head" and c >= heads and a not in given}
    cases = case_counts(distinct, Lexicon(common, starters, given))
    votes: dict[str, Counter] = defaultdict(Counter)
    for (kind, v, _), c in cases.items():
        votes[kind][v] += c
    truth = {k: reliabilities(v) for k, v in votes.items()}
    x = np.array([f for _, _, f in cases], dtype=int).reshape(len(cases), -1)
    m = np.array(list(cases.values()), dtype=float)
    true = m * np.array([truth[kind][v] for kind, v, _ in cases])
    uses = np.bincount(x.ravel(), np.repeat(m, x.shape[1]), FEATURES) if cases else np.zeros(FEATURES)
    return Model(common, starters, given, classifier(truth, uses, lambda w: loss_of(w, x, m, true)))


def texts_of(messages: DataFrame, segments: DataFrame) -> DataFrame:
    """record_table, record_id, text of every row with text."""
    part = lambda df, name: df.select(F.lit(name).alias("record_table"), F.col("id").alias("record_id"), F.col("content_text").alias("text"))
    return part(messages, "messages").unionByName(part(segments, "segments")).where(F.col("text").isNotNull())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, str, str], list[int]] = {}

    def rows() -> pa.RecordBatch:
        keys, values = (zip(*counts), zip(*counts.values())) if counts else ([()] * 3, [()] * 2)
        return pa.RecordBatch.from_arrays([*(pa.array(k, pa.string()) for k in keys), *(pa.array(v, pa.int64()) for v in values)], names=["what", "a", "b", "n", "cued"])

    for batch in batches:
        for t in batch.column("text").to_pylist():
            word_counts(t, counts)
            if len(counts) > HELD:
                yield rows()
                counts.clear()
    yield rows()


def _gradient(w: np.ndarray | None):
    """One row per task: loss at w, and the features with a gradient; of no w: how often each feature is used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, total = 0.0, np.zeros(FEATURES)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("features").flatten().to_numpy().reshape(b.num_rows, -1)
            n, true = (b.column(c).to_numpy() for c in ("n", "true"))
            a, g = (0.0, np.bincount(x.ravel(), np.repeat(n, x.shape[1]), FEATURES)) if w is None else loss_of(w, x, n, true)
            loss, total = loss + a, total + g
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([total[at].tolist()], pa.list_(pa.float64()))], names=["loss", "at", "g"])

    return run


def _summed(examples: DataFrame, w: np.ndarray | None) -> tuple[float, np.ndarray]:
    loss, total = 0.0, np.zeros(FEATURES)
    for r in examples.mapInArrow(_gradient(w), "loss double, at array<int>, g array<double>").collect():
        loss += r["loss"]
        total[r["at"]] += r["g"]
    return loss, total


def _digest(text: str = "text"):
    return F.unhex(F.sha2(text, 256)).alias("digest")


CANDIDATE = "digest binary, kind string, start_pos long, end_pos long, votes array<int>, features array<int>"


def fit(texts: DataFrame) -> Model:
    """fitted() without the candidates."""
    return fitted(texts)[0]


def fitted(texts: DataFrame) -> tuple[Model, DataFrame]:
    """Fit lexicon, reliabilities and classifier on every distinct text (record_table, record_id, text); also the candidates of each (CANDIDATE).

    The driver gets words of at least a share of the texts, names learned, counts of vote patterns and sums of features.
    """
    spark = texts.sparkSession
    texts = stage(texts.select("text").where("text <> ''").distinct(), "texts")
    least, heads = floors(texts.count())
    counts = spread(texts).mapInArrow(_counted, "what string, a string, b string, n long, cued long")
    counts = stage(counts.groupBy("what", "a", "b").agg(F.sum("n").alias("n"), F.sum("cued").alias("cued")), "words")
    of = lambda what: counts.where(F.col("what") == what)
    frequent = of("df").where(F.col("n") >= least).select(F.col("a").alias("b"), F.lit(1).alias("frequent"))
    firsts = of("pair").select("a", "b", "n", "cued").join(F.broadcast(frequent), "b", "left").groupBy("a")
    firsts = firsts.agg(F.sum("n").alias("uses"), F.sum("cued").alias("cued"), F.sum(F.when(F.col("frequent").isNull(), 1).otherwise(0)).alias("rare"), F.count(F.lit(1)).alias("behind"))
    firsts = firsts.where(F.col("rare") >= LEARN_SURNAMES).join(of("plain").select("a", F.col("n").alias("plain")), "a", "left")
    learned = firsts.where(taught(F.col("uses"), F.col("cued"), F.col("rare"), F.col("behind"), F.coalesce("plain", F.lit(0))))
    given = GIVEN | {r["a"] for r in learned.select("a").collect()}
    common = {r["b"] for r in frequent.collect()} - given
    starters = {r["a"] for r in of("head").where(F.col("n") >= heads).select("a").collect()} - given
    shared = spark.sparkContext.broadcast(Model(common, starters, given, np.zeros(0)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value.lexicon()
        kinds = [pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for b in batches:
            rows = [(d, c.kind, c.start, c.end, c.votes, c.features) for d, t in zip(b.column("digest").to_pylist(), b.column("text").to_pylist()) for c in candidates(t, lex)]
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["digest", "kind", "start_pos", "end_pos", "votes", "features"])

    searched = stage(spread(texts).select(_digest(), "text").mapInArrow(search, CANDIDATE), "candidates")
    found = stage(searched.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n")), "cases")
    votes: dict[str, Counter] = defaultdict(Counter)
    for r in found.groupBy("kind", "votes").agg(F.sum("n").alias("n")).orderBy("kind", "votes").collect():
        votes[r["kind"]][tuple(r["votes"])] = r["n"]
    if not votes:
        return Model(common, starters, given, np.zeros(FEATURES)), searched
    truth = spark.createDataFrame([(k, list(v), float(p)) for k, c in votes.items() for v, p in reliabilities(c).items()], "kind string, votes array<int>, p double")
    examples = found.join(F.broadcast(truth), ["kind", "votes"]).groupBy("features").agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * F.col("p")).alias("true"))
    examples = stage(examples, "examples")
    return Model(common, starters, given, classifier(votes, _summed(examples, None)[1], lambda w: _summed(examples, w))), searched


def _accepted(searched: DataFrame, model: Model) -> DataFrame:
    """digest, pii_kind, start_pos, end_pos of the candidates that the model takes for true."""
    shared = searched.sparkSession.sparkContext.broadcast(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column("features").flatten().to_numpy().reshape(b.num_rows, -1)
                yield b.select(["digest", "kind", "start_pos", "end_pos"]).filter(pa.array(shared.value[x].sum(axis=1) > 0))

    return searched.mapInArrow(run, "digest binary, kind string, start_pos long, end_pos long").withColumnRenamed("kind", "pii_kind")


SPAN = "record_table string, record_id string, pii_kind string, start_pos bigint, end_pos bigint"


def find(texts: DataFrame, model: Model, searched: DataFrame | None = None) -> DataFrame:
    """record_table, record_id, pii_kind, start_pos, end_pos (exclusive) of every personal value. searched: fitted()'s candidates of these texts, which then are not searched again."""
    if searched is not None:
        rows = texts.select("record_table", "record_id", _digest())
        return rows.join(_accepted(searched, model), "digest").select("record_table", "record_id", "pii_kind", "start_pos", "end_pos")
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        lex = model.lexicon()
        for b in batches:
            rows = [(t, i, c.kind, c.start, c.end) for t, i, x in zip(b["record_table"], b["record_id"], b["text"]) for c in model.spans(x, lex)]
            yield pd.DataFrame(rows, columns=["record_table", "record_id", "pii_kind", "start_pos", "end_pos"])

    return texts.mapInPandas(run, SPAN)


def _replaced(text: str, spans: Iterable[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for start, end, kind in spans:
        parts += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(parts) + text[at:] if parts else text


def redact(texts: DataFrame, model: Model, searched: DataFrame | None = None) -> DataFrame:
    """record_table, record_id, text with every personal value replaced by [NAME], [EMAIL], [PHONE], [ID_NUMBER] or [ADDRESS]. searched: as in find()."""
    out = "record_table string, record_id string, text string"
    if searched is not None:
        spans = _accepted(searched, model).groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "pii_kind"))).alias("spans"))  # of one text

        def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                new = [x if not at else _replaced(x, (tuple(s.values()) for s in at)) for x, at in zip(b.column("text").to_pylist(), b.column("spans").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("record_table"), b.column("record_id"), pa.array(new, pa.string())], names=["record_table", "record_id", "text"])

        rows = texts.select("record_table", "record_id", "text", _digest()).join(spans, "digest", "left")
        return rows.select("record_table", "record_id", "text", "spans").mapInArrow(replace, out)
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        lex = model.lexicon()
        for b in batches:
            yield b[["record_table", "record_id"]].assign(text=[_replaced(x, ((c.start, c.end, c.kind) for c in model.spans(x, lex))) for x in b["text"]])

    return texts.select("record_table", "record_id", "text").mapInPandas(run, out)
