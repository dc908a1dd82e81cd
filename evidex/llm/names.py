"""P6: variant spellings of names typed by people.

Two sparse cosine joins. The first is over distinct tokens: each is a vector of
character n-grams weighted by rarity, the cosines of all pairs that share an
n-gram are summed up exactly, and pairs are kept from a threshold on. The second
is over values: each is a vector of its tokens weighted by rarity, and the
cosine of two values counts similar tokens by their n-gram cosine. Of each
value's partners the most similar are kept. A pair's similarity is the mean of
its cosine and, counted twice, of how well the tokens agree one by one, which tells namesakes
apart. Average-linkage clustering groups the spellings. It merges all pairs of
mutually nearest clusters round by round, which gives the same tree as merging
one pair at a time: within a task for each connected component of a bounded
number of pairs, and over the whole edge table for those that are larger, so no
group has to fit into a task.

An n-gram or token that many items share is split into parts of bounded size,
so no feature is one task.

Edge cases: null and blank values are left out; repeated rows count once; a
value of titles or legal forms only has no tokens and stays alone; a value
without partner has no row; equal similarities are broken by a hash of the pair;
an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.session import stage

#: Least cosine of two tokens' n-gram vectors to be compared; of tokens at most three letters apart (a swap and another edit).
TOKEN_COSINE, NEAR_COSINE = 0.35, 0.1
#: Least cosine of two values to be a pair, and what their rarest tokens must hold of it.
PAIR_COSINE, VALUE_COSINE = 0.15, 0.55
#: Partners kept of each value, the most similar first; beyond that number all that reach SURE are kept too.
TOP, SURE = 100, 0.4
#: Least average similarity of two groups to be merged.
LINKAGE = 0.52
#: How far tokens two edits apart agree.
TWO_EDITS = 0.5
#: Items of a feature that are joined in one part.
SPLIT = 2000
#: Pairs of a connected component that are clustered within a task.
LOCAL_PAIRS = 20_000

# Words that make no difference between names.
TITLES = "dr prof professor mr mrs ms miss mme mlle herr frau sir dipl ing phd md jr sr señor señora sig".split()
LEGAL = "ltd limited ag gmbh mbh inc incorporated sa bv nv llc llp plc corp corporation co company kg ohg se spa srl sarl sas oy ab as pty the".split()
# Given names and their short forms.
NICKNAMES = {
    "alexander": "alex sascha sasha xander sandy", "anastasia": "nastya stasia ana", "björn": "bjoern bjorn", "charlotte": "lotte lottie charlie", "constance": "connie",
    "daniela": "dani", "edmund": "ed ned eddie ted", "elizabeth": "liz betty beth lizzie eliza bess libby", "francisco": "fran paco pancho frank", "franziska": "franzi ziska",
    "guadalupe": "lupe lupita", "gwendolyn": "gwen wendy", "henrietta": "hetty etta harriet", "ignacio": "nacho", "ingrid": "inga", "isidora": "isi dora", "johannes": "hannes hans jo johann",
    "jürgen": "juergen jurgen", "katherine": "kate kathy katie kat kitty kathryn", "leopold": "poldi leo", "margaret": "maggie peggy meg marge greta", "michael": "mike mick micky",
    "nikolaus": "niko klaus nick", "oluwaseun": "seun", "priyanka": "priya", "quentin": "quin", "rené": "rene", "robert": "rob bob bobby robbie bert", "sebastian": "basti seb bastian",
    "søren": "soren soeren", "theodore": "theo ted teddy", "ursula": "uschi ulla ursel", "vladislav": "vlad slava", "walburga": "burgi wally", "william": "will bill billy willy liam",
    "xenia": "xeni ksenia", "yusuf": "yussuf", "zoë": "zoe", "james": "jim jimmy jamie", "john": "jack johnny", "joseph": "joe joey josef", "thomas": "tom tommy", "richard": "dick rick ricky",
    "edward": "eddie ed ted ned", "anthony": "tony", "andrew": "andy drew", "christopher": "chris kit", "daniel": "dan danny", "david": "dave", "samuel": "sam", "patricia": "pat patty trish",
    "susan": "sue susie", "jennifer": "jen jenny", "rebecca": "becky", "deborah": "deb debbie", "victoria": "vicky tori", "matthew": "matt", "benjamin": "ben", "nicholas": "nick", "gregory": "greg",
}


def _plain(word: str) -> str:
    word = word.replace("ø", "o").replace("ß", "ss").replace("æ", "ae").replace("ł", "l")
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


_ROOTS: dict[str, set[str]] = {}
for _full, _short in NICKNAMES.items():
    for _w in [_full, *_short.split()]:
        _ROOTS.setdefault(_plain(_w), set()).add(_plain(_full))


_DOTTED = re.compile(r"(?<=\b[^\W\d_])\.(?=[^\W\d_]\b)")
_NOT_WORD = re.compile(r"[\W_]+")
_DROPPED = {*TITLES, *LEGAL}


@lru_cache(maxsize=200_000)
def tokens(value: str) -> tuple[str, ...]:
    """Distinct tokens of a value, without accents, titles and legal forms; single letters are initials."""
    text = _DOTTED.sub("", _plain(value.lower()))
    return tuple(sorted({w for w in _NOT_WORD.split(text) if w and w not in _DROPPED}))


def _grams(token: Column, sizes: tuple[int, ...]) -> Column:
    s = F.concat(F.lit("^"), token, F.lit("$"))
    at = lambda n: F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substr(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*(at(n) for n in sizes)))


def _prefix(weighted: DataFrame, least: float) -> DataFrame:
    """item, feature: of each unit vector (item, feature, w) the rarest features, up to where the rest's norm is below least.

    Two vectors with a cosine of least share at least one of these, so joining on them loses no pair.
    """
    w = Window.partitionBy("item").orderBy(F.desc("w"), "feature")
    before = F.coalesce(F.sum(F.col("w") * F.col("w")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return weighted.withColumn("before", before).where(F.col("before") <= 1 - least * least).select("item", "feature")


def _weighted(items: DataFrame) -> DataFrame:
    """item, feature, w from item, feature: weights by rarity, unit length. Features of very few items, as typing errors make, weigh alike."""
    n = items.select("item").distinct().count()
    df = items.groupBy("feature").agg(F.count(F.lit(1)).alias("df"))
    w = items.join(df, "feature").withColumn("idf", F.log(F.lit(n + 10.0) / (F.col("df") + 9.0)) + 1.0)
    norm = F.sqrt(F.sum(F.col("idf") * F.col("idf")).over(Window.partitionBy("item")))
    return w.select("item", "feature", (F.col("idf") / norm).alias("w"))


def shared(left: DataFrame, right: DataFrame, split: int = SPLIT) -> DataFrame:
    """a, b, and the columns left_w, right_w of all pairs of items of left and right (item, feature, w) that share a feature.

    A feature of more than split items of left is joined in parts, to each of which right's items are sent.
    """
    big = left.groupBy("feature").agg(F.ceil(F.count(F.lit(1)) / split).cast("int").alias("parts")).where("parts > 1")  # few, so the other features are shuffled once
    count = F.coalesce("parts", F.lit(1))
    a = left.join(big, "feature", "left").select("feature", F.col("item").alias("a"), F.col("w").alias("left_w"), F.pmod(F.xxhash64("item"), count).cast("int").alias("part"))
    b = right.join(big, "feature", "left").select("feature", F.col("item").alias("b"), F.col("w").alias("right_w"), F.explode(F.sequence(F.lit(0), count - 1)).alias("part"))
    return a.join(b, ["feature", "part"]).drop("feature", "part")


def cosines(weighted: DataFrame) -> DataFrame:
    """a, b, cosine, a < b: the exact cosine of every pair of unit vectors (item, feature, w) that share a feature."""
    both = shared(weighted, weighted).where(F.col("a") < F.col("b"))
    return both.groupBy("a", "b").agg(F.sum(F.col("left_w") * F.col("right_w")).alias("cosine"))


def abbreviations(words: DataFrame) -> DataFrame:
    """a, b (both ways): tokens of three to five letters and the longer ones they may shorten, as a beginning or by their consonants."""
    short = words.where(F.length("word").between(3, 5)).select(F.col("word").alias("a"))
    full = words.where(F.length("word") > 4).select(F.col("word").alias("b"))
    fits = 3 * F.length("a") <= 2 * F.length("b")
    beginnings = full.select("b", F.explode(F.array(*(F.substring("b", 1, n) for n in (3, 4, 5)))).alias("a"))
    found = short.join(beginnings, "a").where(fits).select("a", "b")
    bones = lambda c: F.substring(F.concat(F.substring(c, 1, 1), F.regexp_replace(F.expr(f"substring({c}, 2)"), "[aeiou]", "")), 1, 2)
    bare = short.where(~F.expr("substring(a, 2)").rlike("[aeiou]")).withColumn("k", bones("a"))
    spelled = F.concat(F.lit("^"), F.array_join(F.filter(F.split("a", ""), lambda x: x.rlike("[a-z]")), ".*"))
    found = found.unionByName(bare.join(full.withColumn("k", bones("b")), "k").where(fits & F.rlike("b", spelled)).select("a", "b"))
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))


def rescored(pairs: DataFrame, weighted: DataFrame) -> DataFrame:
    """a, b, cosine: pairs (a, b) with the cosine of their unit vectors (item, feature, w), 0 without a common feature."""
    left = pairs.join(weighted.select(F.col("item").alias("a"), "feature", F.col("w").alias("left_w")), "a")
    right = weighted.select(F.col("item").alias("b"), "feature", F.col("w").alias("right_w"))
    return left.join(right, ["b", "feature"], "left").groupBy("a", "b").agg(F.coalesce(F.sum(F.col("left_w") * F.col("right_w")), F.lit(0.0)).alias("cosine"))


def similar_tokens(words: DataFrame) -> DataFrame:
    """a, b, cosine (both ways and each token with itself): tokens whose n-gram vectors are similar, abbreviations, short forms of given names.

    words: word. A token is the vector of its 2- and 3-grams. Long tokens find each other by the cosine of their 4-grams,
    which are rarer, and short ones by that of the vectors themselves. Abbreviations and short forms may have a cosine of 0.
    """
    grams = lambda fits, sizes: words.where(fits).select(F.col("word").alias("item"), F.explode(_grams(F.col("word"), sizes)).alias("feature"))
    vectors = stage(_weighted(grams(F.lit(True), (2, 3))), "grams")
    short = cosines(vectors.where(F.length("item") <= 8))
    long = cosines(stage(_weighted(grams(F.length("word") >= 7, (4,))), "grams"))
    close = (F.col("cosine") >= TOKEN_COSINE) | ((F.col("cosine") >= NEAR_COSINE) & (F.levenshtein("a", "b", 3) >= 0))
    near = stage(rescored(short.where(close).union(long.where(close)).select("a", "b").distinct(), vectors), "near")
    nicknames = sorted((x, y) for x, rx in _ROOTS.items() for y, ry in _ROOTS.items() if x != y and rx & ry)
    known = abbreviations(words).union(words.sparkSession.createDataFrame(nicknames, "a string, b string")).withColumn("cosine", F.lit(0.0))
    same = words.select(F.col("word").alias("a"), F.col("word").alias("b"), F.lit(1.0).alias("cosine"))
    out = same.union(known).union(near.select("a", "b", "cosine")).union(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    return out.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def _one_edit(a: str, b: str) -> bool:
    """Equal but for one insertion, deletion, substitution or swap of neighbours."""
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 2:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    if len(a) > len(b):
        a, b = b, a
    return a[i:] == b[i + 1 :]


def _two_edits(a: str, b: str) -> bool:
    """Equal but for two edits as in _one_edit: undoing one at the first difference leaves at most one."""
    if abs(len(a) - len(b)) > 2:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    ways = [(x[1:], y[1:]), (x[1:], y), (x, y[1:])]
    if len(x) > 1 and x[:2] == y[:2][::-1]:
        ways.append((x[2:], y[2:]))
    return any(p == q or _one_edit("^^" + p, "^^" + q) for p, q in ways)


def _shortened(short: str, full: str) -> bool:
    """Whether short abbreviates full: its letters in order from the first, at most five and less than two thirds."""
    if not 2 < len(short) <= 5 or 3 * len(short) > 2 * len(full) or short[0] != full[0]:
        return False
    letters = iter(full)
    return full.startswith(short) or (not set(short[1:]) & set("aeiou") and all(c in letters for c in short))


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    ra, rb = _ROOTS.get(a), _ROOTS.get(b)
    if ra and rb:
        return 0.97 if ra & rb else 0.0
    if _one_edit(a, b) and (min(len(a), len(b)) > 2 or ra or rb):
        return 0.93
    if min(len(a), len(b)) > 6 and not ra and not rb and _two_edits(a, b):
        return TWO_EDITS
    if _shortened(a, b) or _shortened(b, a):
        return 0.9
    for x, roots in ((a, rb), (b, ra)):  # a mistyped form of a name that has short forms
        if roots and len(x) > 3 and any(_one_edit(x, r) for r in roots):
            return 0.88
    return 0.0


def alignment(a: list[str], b: list[str]) -> float:
    """Similarity of two token bags: every whole token of the one must be found in the other, or begin with its initial.

    Further initials make no difference. At least one token must be common as a whole word, given names and initials not counted.
    """
    fa, fb = [t for t in a if len(t) > 1], [t for t in b if len(t) > 1]
    ia, ib = [t for t in a if len(t) == 1], [t for t in b if len(t) == 1]
    score, anchored, left = 1.0, False, list(fb)
    pairs = sorted(((_alike(x, y), i, j) for i, x in enumerate(fa) for j, y in enumerate(fb)), reverse=True)
    used_a: set[int] = set()
    used_b: set[int] = set()
    for s, i, j in pairs:
        if s <= 0 or i in used_a or j in used_b:
            continue
        used_a.add(i)
        used_b.add(j)
        score *= s
        anchored |= (s >= 0.93 or s == TWO_EDITS) and fa[i] not in _ROOTS and fb[j] not in _ROOTS
    if not anchored:
        return 0.0
    for words, used, initials in ((fa, used_a, ib), (fb, used_b, ia)):
        free = list(initials)
        for i, w in enumerate(words):
            if i in used:
                continue
            first = next((x for x in free if x == w[0] or any(x == r[0] for r in _ROOTS.get(w, ()))), None)
            if first is None:
                return 0.0
            free.remove(first)
            score *= 0.85
    if len(fa) == len(fb) == 1 and not set(ia) & set(ib):
        return 0.0 if ia or ib else score  # a surname alone: its initial tells who it is
    return score


def bags(subjects: DataFrame) -> DataFrame:
    """value, word: the whole tokens (longer than a letter) of each distinct value of subjects (value)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(v, t) for v in b["value"] for t in tokens(v) if len(t) > 1], columns=["value", "word"])

    return subjects.where(F.col("value").isNotNull()).select("value").distinct().mapInPandas(run, "value string, word string")


def candidates(weighted: DataFrame, near: DataFrame) -> DataFrame:
    """a, b, a < b: values (weighted: item, feature, w) whose rarest tokens meet in near (a, b)."""
    index = stage(_prefix(weighted, VALUE_COSINE), "index").withColumn("w", F.lit(1.0))
    reach = index.join(near.select(F.col("a").alias("feature"), F.col("b").alias("to")), "feature").select("item", F.col("to").alias("feature"), "w")
    return shared(reach.distinct(), index).where(F.col("a") < F.col("b")).select("a", "b").distinct()


def value_cosines(pairs: DataFrame, weighted: DataFrame, near: DataFrame) -> DataFrame:
    """pairs (a, b and others) with the cosine of their values (weighted: item, feature, w).

    A value is the unit vector of its tokens weighted by rarity; a token of the one counts with the most similar one of the other.
    """
    bag = weighted.groupBy("item").agg(F.collect_list(F.struct("feature", "w")).alias("bag"))  # the few tokens of one value
    both = pairs.join(bag.select(F.col("item").alias("a"), F.col("bag").alias("bag_a")), "a").join(bag.select(F.col("item").alias("b"), F.col("bag").alias("bag_b")), "b")
    crossed = both.select("a", "b", F.explode("bag_a").alias("x"), "bag_b").select("a", "b", "x", F.explode("bag_b").alias("y"))
    met = crossed.select(F.col("a").alias("va"), F.col("b").alias("vb"), F.col("x.feature").alias("a"), F.col("y.feature").alias("b"), (F.col("x.w") * F.col("y.w")).alias("w")).join(near, ["a", "b"])
    best = met.groupBy("va", "vb", "a").agg(F.max(F.col("w") * F.col("cosine")).alias("part"))
    found = best.groupBy(F.col("va").alias("a"), F.col("vb").alias("b")).agg(F.least(F.sum("part"), F.lit(1.0)).alias("cosine"))
    return pairs.join(found, ["a", "b"])


def top(pairs: DataFrame, n: int = TOP, sure: float = SURE) -> DataFrame:
    """pairs (a, b, cosine and others) that are among the n most similar of either end, and all that reach sure."""
    rank = lambda me, other: F.row_number().over(Window.partitionBy(me).orderBy(F.desc("cosine"), other))
    ranked = pairs.withColumn("rank_a", rank("a", "b")).withColumn("rank_b", rank("b", "a"))
    return ranked.where((F.col("rank_a") <= n) | (F.col("rank_b") <= n) | (F.col("cosine") >= sure)).drop("rank_a", "rank_b")


def linked(subjects: DataFrame) -> DataFrame:
    """a, b, cosine, similarity (above 0), a < b: the pairs of similar values whose tokens agree.

    Whether tokens agree is looked at first, as it leaves a tenth of the candidates, so that no namesake takes the place of a partner.
    """
    words = stage(bags(subjects), "bags")
    near = stage(similar_tokens(words.select("word").distinct()), "similar")
    weighted = stage(_weighted(words.select(F.col("value").alias("item"), F.col("word").alias("feature"))), "values")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            p = p.assign(agreed=[alignment(list(tokens(a)), list(tokens(b))) for a, b in zip(p["a"], p["b"])])
            yield p[p["agreed"] > 0]

    agreed = stage(candidates(weighted, near).mapInPandas(run, "a string, b string, agreed double"), "agreed")
    kept = top(value_cosines(agreed, weighted, near).where(F.col("cosine") >= PAIR_COSINE))
    return kept.select("a", "b", "cosine", ((F.col("cosine") + 2 * F.col("agreed")) / 3).alias("similarity"))


def components(edges: DataFrame) -> DataFrame:
    """value, component: the least value of its connected component, for every end of edges (a, b).

    Labels spread over the edges and jump to the label of the label; each round is stored, nothing comes to the driver but
    whether a label changed.
    """
    ends = stage(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "ends")
    labels = stage(ends.groupBy("a").agg(F.min("b").alias("c")).select(F.col("a").alias("value"), F.least("a", "c").alias("c"), F.lit(True).alias("moved")), "labels")
    while True:
        seen = ends.join(labels.select(F.col("value").alias("b"), "c"), "b").select(F.col("a").alias("value"), "c")
        jump = labels.select("value", F.col("c").alias("at")).join(labels.select(F.col("value").alias("at"), "c"), "at").select("value", "c")
        least = seen.union(jump).groupBy("value").agg(F.min("c").alias("least"))
        new = labels.select("value", "c").join(least, "value").select("value", F.least("c", "least").alias("c"), (F.col("least") < F.col("c")).alias("moved"))
        labels = stage(new, "labels")
        if labels.where("moved").isEmpty():
            return labels.select("value", F.col("c").alias("component"))


def _tie(a: str, b: str) -> int:
    """What F.xxhash64 gives for a pair."""
    h = xxhash.xxh64_intdigest(b.encode(), seed=xxhash.xxh64_intdigest(a.encode(), seed=42))
    return h - (1 << 64) if h >> 63 else h


def merged_clusters(edges: list[tuple[str, str, float]], least: float) -> dict[str, str]:
    """value -> cluster by the rounds of _linkage_rounds(), for the edges of one component."""
    total = {(a, b): s for a, b, s in edges}
    members = {v: [v] for e in edges for v in e[:2]}
    while True:
        best: dict[str, tuple] = {}
        for (a, b), t in total.items():
            avg = round(t / (len(members[a]) * len(members[b])), 9)
            if avg >= least:
                key = (avg, _tie(a, b), a, b)
                for end in (a, b):
                    if end not in best or key > best[end]:
                        best[end] = key
        into = {k[3]: k[2] for end, k in best.items() if end == k[2] and best[k[3]] == k}
        if not into:
            return {v: c for c, vs in members.items() for v in vs}
        for old, new in into.items():
            members[new] += members.pop(old)
        moved: dict[tuple[str, str], float] = {}
        for (a, b), t in total.items():
            a, b = into.get(a, a), into.get(b, b)
            if a != b:
                moved[min(a, b), max(a, b)] = moved.get((min(a, b), max(a, b)), 0.0) + t
        total = moved


def average_linkage(edges: DataFrame, least: float = LINKAGE, local_pairs: int = LOCAL_PAIRS) -> DataFrame:
    """value, cluster: groups of average linkage over edges (a, b, similarity, a < b); pairs without edge have similarity 0."""
    edges = stage(edges.select("a", "b", "similarity"), "edges")
    of = edges.join(components(edges).withColumnRenamed("value", "a"), "a")
    sizes = of.groupBy("component").agg(F.count(F.lit(1)).alias("pairs"))
    of = stage(of.join(sizes, "component"), "components")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for p in batches:
            out: dict[str, str] = {}
            for c, a, b, s in zip(p["component"], p["a"], p["b"], p["similarity"]):
                if c != at and held:
                    out |= merged_clusters(held, least)
                    held = []
                at = c
                held.append((a, b, s))
            yield pd.DataFrame(list(out.items()), columns=["value", "cluster"])
        yield pd.DataFrame(list(merged_clusters(held, least).items()), columns=["value", "cluster"])

    small = of.where(F.col("pairs") <= local_pairs).repartition("component").sortWithinPartitions("component")
    clusters = small.select("component", "a", "b", "similarity").mapInPandas(run, "value string, cluster string")
    large = of.where(F.col("pairs") > local_pairs)
    return clusters if large.isEmpty() else clusters.unionByName(_linkage_rounds(large, least))


def _linkage_rounds(edges: DataFrame, least: float) -> DataFrame:
    """average_linkage() as rounds over the whole edge table.

    Each round merges all pairs of clusters that are each other's nearest. Average linkage is reducible, so this
    gives the groups of merging the nearest pair at a time.
    """
    edges = stage(edges.select("a", "b", F.col("similarity").alias("total")), "edges")
    members = stage(edges.select(F.col("a").alias("value")).union(edges.select("b")).distinct().withColumn("cluster", F.col("value")), "members")
    while True:
        sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
        avg = (
            edges.join(sizes.select(F.col("cluster").alias("a"), F.col("n").alias("na")), "a")
            .join(sizes.select(F.col("cluster").alias("b"), F.col("n").alias("nb")), "b")
            .select("a", "b", F.round(F.col("total") / (F.col("na") * F.col("nb")), 9).alias("avg"))
            .where(F.col("avg") >= least)
        )
        tie = F.xxhash64("a", "b")
        ends = avg.select(F.col("a").alias("me"), "avg", tie.alias("tie"), "a", "b").union(avg.select(F.col("b"), "avg", tie, "a", "b"))
        best = ends.groupBy("me").agg(F.max(F.struct("avg", "tie", "a", "b")).alias("best"))
        merged = stage(best.groupBy("best.a", "best.b").agg(F.count(F.lit(1)).alias("votes")).where("votes = 2").select("a", "b"), "merged")
        if merged.isEmpty():
            return members
        into = merged.select(F.col("b").alias("old"), F.col("a").alias("new"))
        members = stage(members.join(into, F.col("cluster") == F.col("old"), "left").select("value", F.coalesce("new", "cluster").alias("cluster")), "members")
        moved = (
            edges.join(into, F.col("a") == F.col("old"), "left").select(F.coalesce("new", "a").alias("a"), "b", "total")
            .join(into, F.col("b") == F.col("old"), "left").select("a", F.coalesce("new", "b").alias("b"), "total")
            .where(F.col("a") != F.col("b"))
        )
        edges = stage(moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("total").alias("total")), "edges")


def spelling_groups(subjects: DataFrame) -> DataFrame:
    """value, cluster: the spellings (value) that mean the same entity; values without partner are left out."""
    return average_linkage(linked(subjects))


def spelling_pairs(groups: DataFrame) -> DataFrame:
    """subject_a, subject_b: all pairs within the groups, the smaller first."""
    return groups.select(F.col("value").alias("subject_a"), "cluster").join(groups.select(F.col("value").alias("subject_b"), "cluster"), "cluster").where(
        F.col("subject_a") < F.col("subject_b")
    ).select("subject_a", "subject_b")
