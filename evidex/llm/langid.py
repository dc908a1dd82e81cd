"""P10: missing or wrong document language labels.

Per language a variable-order byte context tree (prediction by partial
matching, escape method C) is trained on a bounded sample of labelled
documents and frozen. A text's prose is cut into sentences; the exact code
length of each word under every language adds up per sentence, sentences that
switch language inside are split where that saves most bits, and the passages
of a document are decoded together with a cost per change of language.

Labels are noisy, so the sample is decoded with the first trees and the trees
are trained again on the passages found.

Edge cases: null, blank or letterless texts have no prose and give no passage;
code, markup, identifiers and addresses are removed before counting; texts of
any length are read whole; repeated documents are scored alike; without any
labelled document the trees rest on a short list of function words; extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ["en", "de", "fr", "es", "it", "pt", "nl"]
# Frequent function words of each language, so that a tree exists without any label.
SEEDS = {
    "en": "the of and to in is that it was for with as his on be at by this had not are but from they which have you were all",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec mais nous cette ont été",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya o este sí porque muy sin",
    "it": "di che è la il un a per in una sono mi ho lo non ma le si ti ha con cosa come da al del della gli più nella questo anche",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou já",
    "nl": "de en van ik te dat die in een hij het niet zijn is was op aan met als voor had er maar om hem dan zou of wat mijn men dit",
}
#: The tree's greatest context length in bytes.
ORDER = 5
#: Documents of each language the trees are fitted on, at most.
SAMPLE_DOCS = 400
#: Characters of a document of the sample that count in full; each word of a longer one counts for less.
FULL_WEIGHT = 2000
#: Bits a change of language costs between sentences, and within one.
SWITCH_BITS, INNER_BITS = 9.0, 28.0
#: Least share of the letters of a document's prose for a language to count as being in it.
SHARE = 0.2

_FENCE = re.compile(r"(?:^|\n)[ \t>]*(```|~~~).*?(?:\n[ \t>]*\1[^\n]*|\Z)", re.DOTALL)
_INLINE = re.compile(r"`[^`\n]*`|<[^<>\n]{1,200}>|^[ \t]{4,}\S[^\n]*$", re.MULTILINE)
#: What makes the token around it no word: digits of ids and numbers, addresses, paths, code.
_MARK = re.compile(r"[\d@_\\={}]|://|\(\)|/\S*/|\w:\w")
_CODE_LINE = re.compile(r"^\s*(?:[{}\[\]();]|SELECT\b|INSERT\b|UPDATE\b|FROM\b|for \w+ in |if .*:\s*$|def |class |import |return\b|rc=|\$ |>>> )[^\n]*$", re.MULTILINE)
#: Within a token: a word, or an end of the sentence.
_PART = re.compile(r"([^\W\d_]+)|[.!?…]+$|(?<=\w)[:;]$|^\|$")


def units(text: str | None) -> list[list[str]]:
    """The prose of a text as sentences of lower-case words; tokens (up to white space) that hold a mark are left out."""
    if not text:
        return []
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    text = _INLINE.sub(" ", _CODE_LINE.sub("\n", text)).lower()
    out: list[list[str]] = []
    sentence: list[str] = []
    for line in text.split("\n"):
        for token in line.split():
            if token.isalpha():
                sentence.append(token)
            elif not _MARK.search(token):
                for word in _PART.findall(token):
                    if word:
                        sentence.append(word)
                    elif sentence:
                        out.append(sentence)
                        sentence = []
        if sentence:
            out.append(sentence)
            sentence = []
    return out


class ContextTree:
    """A frozen variable-order model: code lengths of words, with the blank before and after as context."""

    def __init__(self, words: Counter, order: int = ORDER):
        self.order = order
        tree: dict[bytes, Counter] = defaultdict(Counter)
        for word, n in words.items():
            s = b" " + word.encode() + b" "
            for i in range(1, len(s)):
                for k in range(min(i, order) + 1):
                    tree[s[i - k : i]][s[i]] += n
        self.cost: dict[bytes, tuple[float, dict[int, float]]] = {}
        for context, seen in tree.items():
            total = sum(seen.values()) + len(seen)
            self.cost[context] = (-math.log2(len(seen) / total), {b: -math.log2(c / total) for b, c in seen.items()})

    def symbol_bits(self, piece: bytes) -> float:
        """Code length of the last byte of piece after the bytes before it, at most order of them."""
        symbol, total, cost = piece[-1], 0.0, self.cost
        for k in range(max(0, len(piece) - 1 - self.order), len(piece)):
            node = cost.get(piece[k:-1])
            if node is None:
                continue
            if (c := node[1].get(symbol)) is not None:
                return total + c
            total += node[0]
        return total + 8.0

    def bits(self, word: str) -> float:
        """Exact code length of a word and the blank after it."""
        s = b" " + word.encode() + b" "
        return sum(self.symbol_bits(s[max(0, i - self.order) : i + 1]) for i in range(1, len(s)))


class Scorer:
    """Bits of words under every language, remembered within a bound.

    A symbol's code length depends on at most order bytes before it in its word, and the same few bytes recur in many words,
    so symbols are priced once per such context and a word is the sum of its symbols.
    """

    REMEMBERED = 200_000

    def __init__(self, trees: list[ContextTree]):
        self.trees, self.known, self.priced = trees, {}, {}
        self.order = max((t.order for t in trees), default=ORDER)
        self.rows = np.empty((1024, len(trees)))
        self.symbols = np.empty((1024, len(trees)))

    def _symbol(self, piece: bytes) -> int:
        """The row of a context and the symbol after it."""
        n = len(self.priced)
        if n == len(self.symbols):
            self.symbols = np.concatenate([self.symbols, np.empty_like(self.symbols)])
        self.symbols[n] = [t.symbol_bits(piece) for t in self.trees]
        self.priced[piece] = n
        return n

    def __call__(self, words: list[str]) -> np.ndarray:
        known, priced, order = self.known, self.priced, self.order
        if len(known) > self.REMEMBERED:
            known.clear()
        if len(priced) > self.REMEMBERED:
            priced.clear()
        at = list(map(known.get, words))
        if None in at:
            new = list(set(words).difference(known))
            pieces, starts = [], []
            for w in new:
                s = b" " + w.encode() + b" "
                starts.append(len(pieces))
                pieces += [s[max(0, i - order) : i + 1] for i in range(1, len(s))]
            rows = [k if (k := priced.get(p)) is not None else self._symbol(p) for p in pieces]
            bits = np.add.reduceat(self.symbols[rows], starts, axis=0)
            n = len(known)
            while n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            self.rows[n : n + len(new)] = bits
            known.update(zip(new, range(n, n + len(new))))
            at = list(map(known.get, words))
        return self.rows[at]


def _pieces(bits: np.ndarray, lo: int, hi: int) -> list[tuple[int, int]]:
    """[lo, hi) cut where two languages explain the words better than one by INNER_BITS, each part again, in order."""
    out, todo = [], [(lo, hi)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo >= 6:
            sums = np.cumsum(bits[lo:hi], axis=0)
            two = sums.min(axis=1)[:-1] + (sums[-1] - sums[:-1]).min(axis=1)
            at = int(two.argmin())
            if sums[-1].min() - two[at] > INNER_BITS:
                todo += [(lo + at + 1, hi), (lo, lo + at + 1)]
                continue
        out.append((lo, hi))
    return out


def passages(text: str | None, score: Scorer) -> list[tuple[int, float, int, list[str]]]:
    """(language number, confidence, letters, words) of each run of sentences in one language, in order."""
    sentences = units(text)
    if not sentences:
        return []
    words = [w for s in sentences for w in s]
    bits = score(words)
    ends = np.cumsum([len(s) for s in sentences])
    starts = np.concatenate([[0], ends[:-1]])
    # no cut of a sentence can save more than its words' own best languages do
    room = np.add.reduceat(bits, starts, axis=0).min(axis=1) - np.add.reduceat(bits.min(axis=1), starts)
    pieces = []
    for a, b, r in zip(starts.tolist(), ends.tolist(), room.tolist()):
        pieces += _pieces(bits, a, b) if r > INNER_BITS else [(a, b)]
    e = np.add.reduceat(bits, [p[0] for p in pieces], axis=0)
    n = len(pieces)
    nearest = e.argmin(axis=1)
    if (nearest == nearest[0]).all():  # one language is best everywhere
        return [_passage(e, words, pieces, int(nearest[0]), 0, n)]
    best, back = e[0].copy(), np.zeros((n, e.shape[1]), dtype=np.int8)
    own = np.arange(e.shape[1], dtype=np.int8)
    for i in range(1, n):
        low = int(best.argmin())
        stay = best <= best[low] + SWITCH_BITS
        back[i] = np.where(stay, own, low)
        best = np.where(stay, best, best[low] + SWITCH_BITS) + e[i]
    path = [int(best.argmin())]
    for i in range(n - 1, 0, -1):
        path.append(int(back[i][path[-1]]))
    path.reverse()
    out, start = [], 0
    for i in range(1, n + 1):
        if i == n or path[i] != path[start]:
            out.append(_passage(e, words, pieces, path[start], start, i))
            start = i
    return out


def _passage(e: np.ndarray, words: list[str], pieces: list[tuple[int, int]], lang: int, a: int, b: int) -> tuple[int, float, int, list[str]]:
    total = e[a:b].sum(axis=0)
    conf = 1.0 / np.exp2(np.clip(total[lang] - total, -1000, 50)).sum()
    run = words[pieces[a][0] : pieces[b - 1][1]]
    return lang, float(conf), sum(map(len, run)), run


def label(lang: Column) -> Column:
    """The two-letter code a label counts as, else null."""
    return F.when(lang.rlike(rf"(?i)^({'|'.join(LANGUAGES)})([-_][a-z]{{2}})?$"), F.lower(F.substring(lang, 1, 2)))


def fit(documents: DataFrame, per_language: int = SAMPLE_DOCS, rounds: int = 2) -> list[ContextTree]:
    """Trees from a bounded sample: per_language whole labelled documents of any length, chosen by a hash of the id."""
    labelled = documents.select("doc_id", "text", label(F.col("lang")).alias("lang")).where(
        F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0)
    )
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # at most 7 rows
    # twice the wanted number is expected below the threshold; the smallest hashes of those are taken
    keep = F.lit(False)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    for k, n in counts.items():
        keep = keep | ((F.col("lang") == k) & (draw < min(1.0, 1.5 * per_language / n)))
    rows = labelled.where(keep).select("lang", draw.alias("draw"), "doc_id", "text").collect()
    texts: dict[str, list[str]] = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["draw"], r["doc_id"])):
        if len(texts[r["lang"]]) < per_language:
            texts[r["lang"]].append(r["text"])
    def counted(runs_of) -> list[ContextTree]:
        words = {k: Counter({w: 3 for w in SEEDS[k].split()}) for k in LANGUAGES}
        for k, found in texts.items():
            for t in found:
                weight = min(1.0, FULL_WEIGHT / len(t))
                for lang, run in runs_of(k, t):
                    for w in run:
                        words[lang][w] += weight
        return [ContextTree(words[k]) for k in LANGUAGES]

    trees = counted(lambda k, t: ((k, u) for u in units(t)))
    for _ in range(rounds):
        score = Scorer(trees)
        trees = counted(lambda k, t, score=score: ((LANGUAGES[p[0]], p[3]) for p in passages(t, score)))
    return trees


_HELD: list[tuple[list, Scorer]] = []


def _scorer(trees: list[tuple[int, dict]]) -> Scorer:
    """The scorer of broadcast trees; a worker keeps it, with the words it has priced, for its next tasks."""
    if not _HELD or _HELD[0][0] is not trees:
        models = []
        for order, cost in trees:
            t = ContextTree(Counter(), order)
            t.cost = cost
            models.append(t)
        _HELD[:] = [(trees, Scorer(models))]
    return _HELD[0][1]


PASSAGE = "doc_id bigint, passage int, lang string, confidence double, letters bigint"


def detect(documents: DataFrame, trees: list[ContextTree]) -> DataFrame:
    """doc_id, passage (from 0), lang, confidence, letters: the passages of every document."""
    frozen = documents.sparkSession.sparkContext.broadcast([(t.order, t.cost) for t in trees])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = _scorer(frozen.value)
        for b in batches:
            rows = [(d, k, LANGUAGES[p[0]], p[1], p[2]) for d, t in zip(b["doc_id"], b["text"]) for k, p in enumerate(passages(t, score))]
            yield pd.DataFrame(rows, columns=["doc_id", "passage", "lang", "confidence", "letters"])

    return documents.select("doc_id", "text").where(F.col("text").isNotNull()).mapInPandas(run, PASSAGE)


def document_languages(found: DataFrame) -> DataFrame:
    """doc_id, lang, share, confidence for each language with at least SHARE of a document's letters. found: detect()."""
    per = found.groupBy("doc_id", "lang").agg(F.sum("letters").alias("letters"), (F.sum(F.col("confidence") * F.col("letters")) / F.sum("letters")).alias("confidence"))
    total = F.expr("aggregate(langs, 0L, (a, x) -> a + x.letters)")
    return (
        per.groupBy("doc_id")
        .agg(F.collect_list(F.struct("lang", "letters", "confidence")).alias("langs"))  # at most 7 entries
        .select("doc_id", total.alias("total"), F.explode("langs").alias("l"))
        .where(F.col("l.letters") >= SHARE * F.col("total"))
        .select("doc_id", "l.lang", (F.col("l.letters") / F.col("total")).alias("share"), "l.confidence")
    )


def relabelled(documents: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, lang_found for every document whose languages are not exactly the one its label names."""
    langs = document_languages(found).groupBy("doc_id").agg(F.collect_set("lang").alias("langs"))
    return (
        documents.select("doc_id", label(F.col("lang")).alias("label"))
        .join(langs, "doc_id")
        .where(F.col("label").isNull() | (F.size("langs") != 1) | (F.col("langs")[0] != F.col("label")))
        .select("doc_id", F.explode("langs").alias("lang_found"))
    )
