import itertools

import pytest

from evidex.llm import names as N

GROUPS = [
    ["elizabeth bipudreplum", "betty bipudreplum", "bipudreplum elizabeth", "elizabeth k. bipudreplum", "elizbaeth bipudreplum", "e. bipudreplum", "dr. elizabeth bipudreplm"],
    ["franziska bipudreplum", "franzi bipudreplum"],
    ["stemugopum textiles s.a", "stemugopum txt", "the stemugopum textiles company", "textiles stemugopum"],
    ["stemugopum systems ltd", "stemugopum sys", "stemugopum-systems"],
    ["søren kamibifan", "soeren kamibifan", "kamibifan, søren"],
]


@pytest.mark.parametrize(("a", "b", "same"), [(GROUPS[0][0], GROUPS[1][0], False), (GROUPS[2][0], GROUPS[3][0], False), ("j. smith", "john smith", True), ("john smith", "jane smith", False), ("j. smith", "smith, k", False), ("j. smith", "smith, j", True), ("j. smith", "smith", False), ("john", "john", False), ("dr", "ltd", False)])
def test_alignment(a, b, same):
    assert (N.alignment(list(N.tokens(a)), list(N.tokens(b))) > 0) == same


def test_groups(spark):
    names = [n for g in GROUPS for n in g] + ["user", "my landlord", "  ", None, "the company"]
    df = spark.createDataFrame([(n, "clash") for n in names * 3], "value string, cluster string")
    got = {(r["subject_a"], r["subject_b"]) for r in N.spelling_pairs(N.spelling_groups(df)).collect()}
    want = {tuple(sorted(p)) for g in GROUPS for p in itertools.combinations(g, 2)}
    assert got == want
    assert N.spelling_pairs(N.spelling_groups(df.limit(0))).count() == 0


def linkage(edges, least):
    clusters = {x: {x} for e in edges for x in e[:2]}
    sim = {frozenset(e[:2]): e[2] for e in edges}
    while True:
        best = max(((sum(sim.get(frozenset((x, y)), 0) for x in a for y in b) / len(a) / len(b), i, j) for (i, a), (j, b) in itertools.combinations(clusters.items(), 2)), default=(0, 0, 0))
        if best[0] < least:
            return {frozenset(c) for c in clusters.values()}
        clusters[best[1]] |= clusters.pop(best[2])


def test_linkage_rounds_equal_pairwise_merging(spark):
    import random

    rng = random.Random(4)
    edges = [(f"n{a:02}", f"n{b:02}", round(rng.random(), 6)) for a in range(24) for b in range(a + 1, 24) if rng.random() < 0.5]
    got = {}
    for r in N.average_linkage(spark.createDataFrame(edges, "a string, b string, similarity double"), 0.3).collect():
        got.setdefault(r["cluster"], set()).add(r["value"])
    assert {frozenset(c) for c in got.values()} == linkage(edges, 0.3)


def test_token_join_finds_every_edit(spark):
    words = ["kolemesel", "kolmesel", "kolemseel", "kolemesell", "kolemasel", "william", "willliam", "wlliam", "press", "prems", "presss", "zoe", "zooe"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(r["a"], r["b"]) for r in N.similar_tokens(df).collect()}
    for base in ("kolemesel", "william"):
        for w in words:
            if N._one_edit(base, w):
                assert (base, w) in got and (w, base) in got


def test_cosines_are_exact_and_split_features_lose_nothing(spark):
    import random

    rng = random.Random(7)
    vectors = {f"i{n:03}": {f: rng.random() for f in rng.sample("abcdefgh", 3)} for n in range(60)}
    rows = [(i, f, w) for i, v in vectors.items() for f, w in v.items()]
    df = spark.createDataFrame(rows, "item string, feature string, w double")
    want = {(x, y): sum(w * vectors[y].get(f, 0) for f, w in vectors[x].items()) for x, y in itertools.combinations(vectors, 2) if set(vectors[x]) & set(vectors[y])}
    got = {(r["a"], r["b"]): r["cosine"] for r in N.cosines(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    parts = {(r["a"], r["b"]) for r in N.shared(df, df, split=5).where("a < b").collect()}
    assert parts == want.keys()


def test_every_link_has_a_cosine_and_the_best_partners_are_kept(spark):
    df = spark.createDataFrame([(n,) for g in GROUPS for n in g], "value string")
    links = N.linked(df).collect()
    assert links and all(0 < r["cosine"] <= 1 and 0 < r["similarity"] <= 1 and r["a"] < r["b"] for r in links)
    pairs = spark.createDataFrame([("a", f"b{n}", n / 100) for n in range(80)], "a string, b string, cosine double")
    kept = {r["b"] for r in N.top(pairs.where("cosine < 2"), n=0, sure=0.4).collect()}
    assert kept == {f"b{n}" for n in range(40, 80)}  # beyond the number, all that are sure


@pytest.mark.parametrize(("a", "b", "two"), [("datsetoran", "dastetorann", True), ("kolemesel", "kolmesell", True), ("kolemesel", "kalemasel", True), ("kolemesel", "kalimasel", False)])
def test_two_edits(a, b, two):
    assert N._two_edits(a, b) == N._two_edits(b, a) == two


def test_large_components_are_clustered_alike(spark):
    import random

    rng = random.Random(11)
    edges = [(f"n{a:02}", f"n{b:02}", rng.choice([0.3, 0.5, 0.6, 0.9])) for a in range(40) for b in range(a + 1, 40) if rng.random() < (0.4 if a // 10 == b // 10 else 0.02)]
    df = spark.createDataFrame(edges, "a string, b string, similarity double")

    def groups(local):
        out = {}
        for r in N.average_linkage(df, 0.45, local_pairs=local).collect():
            out.setdefault(r["cluster"], set()).add(r["value"])
        return {frozenset(c) for c in out.values()}

    assert groups(10_000) == groups(0) and len(groups(0)) > 3  # many ties: the hash of the pair decides in both
    assert N.average_linkage(df.limit(0)).count() == 0


def test_components(spark):
    chain = [(f"c{n:03}", f"c{n + 1:03}") for n in range(60)] + [("x", "y"), ("c000", "c005")]
    got = {r["value"]: r["component"] for r in N.components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert set(got.values()) == {"c000", "x"} and got["c060"] == "c000" and got["y"] == "x" and len(got) == 63
