import random

from evidex.llm import mixing as M
from evidex.llm import packing as P
from evidex.llm import tokens as K


def test_best_fit_is_best_fit():
    rng = random.Random(2)
    loads = [rng.randrange(0, 60) for _ in range(400)]
    bins = {}
    for load, b in zip(loads, P.best_fit(loads, 64)):
        bins[b] = bins.get(b, 0) + load
    assert max(bins.values()) <= 64 and len(bins) <= 1.05 * -(-sum(loads) // 64) + 1
    left = []
    for load in sorted(loads, reverse=True):  # the same rule, slowly
        fit = [x for x in left if x >= load]
        if fit:
            x = min(fit)
            left.remove(x)
            left.append(x - load)
        else:
            left.append(64 - load)
    assert len(left) == len(bins)


def test_every_item_is_packed_once(spark):
    rng = random.Random(6)
    sizes = [(n, rng.choice([0, 3, 17, 64, 65, 200, 1000, 40])) for n in range(3000)]
    df = spark.createDataFrame([(*s, 1, "clash") for s in sizes], "doc_id long, n_tokens long, piece int, load string").repartition(5)
    caps = spark.createDataFrame([("small", 64), ("large", 512), ("none", 0), (None, 5)], "container_kind string, capacity_tokens int")
    c = P.pack(df, caps).cache()
    rows = c.collect()
    for kind, cap in (("small", 64), ("large", 512)):
        mine = [r for r in rows if r["container_kind"] == kind]
        assert len({r["container_id"] for r in mine}) == len(mine)
        got = {}
        for r in mine:
            assert sum(m["tokens"] for m in r["members"]) == r["load"] <= cap
            for m in r["members"]:
                got.setdefault(m["doc_id"], []).append((m["piece"], m["first_token"], m["tokens"]))
        assert {d: sorted(v) for d, v in got.items()} == {d: P.pieces(n, cap) for d, n in sizes}
    fill = {r["container_kind"]: r for r in P.fill(c).collect()}
    assert set(fill) == {"small", "large"} and fill["large"]["fill"] > 0.97
    assert P.pack(df.limit(0), caps).count() == 0


def test_items_that_never_fit_together(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "60L as n_tokens")
    c = P.pack(df, spark.createDataFrame([("k", 100)], "container_kind string, capacity_tokens int"))
    assert c.count() == 5000


def test_mix(spark):
    rng = random.Random(8)
    docs = [(n, rng.choice(["Big", "big ", "big"]), rng.randrange(1, 200)) for n in range(4000)] + [(10_000 + n, "small", 50) for n in range(40)] + [(20_000, None, 9), (20_001, "other", 9), (20_002, "big", 0)]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, source string, n_tokens long, copies string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("absent", 0.2, 2)], "source string, target_share double, max_repeats int")
    used, report = M.mix(df, targets, slices=7)
    rows = used.collect()
    r = {x["source"]: x for x in report.collect()}
    assert {x["source_key"] for x in rows} == {"big", "small"}
    assert max(x["copies"] for x in rows if x["source_key"] == "big") == 1 and {x["copies"] for x in rows if x["source_key"] == "small"} == {3}
    assert abs(r["big"]["tokens"] - r["big"]["wanted"]) <= 400 and r["small"]["tokens"] == 6000 and r["small"]["too_small"] and r["absent"]["tokens"] == 0
    assert abs(sum(x["actual_share"] for x in r.values()) - 1) < 1e-5
    again, _ = M.mix(df, targets, slices=3)
    assert {(x["doc_id"], x["copies"]) for x in again.collect()} == {(x["doc_id"], x["copies"]) for x in rows}
    none, report = M.mix(df.limit(0), targets)
    assert none.count() == 0 and {x["actual_share"] for x in report.collect()} == {0.0}


def test_sizes(spark):
    df = spark.createDataFrame([(1, "Hello, world", "s"), (2, None, "s"), (3, "", "s"), (4, " " * 20_000, "s"), (5, "ß日本語 🙂" * 500, "s")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["n_tokens"] for r in K.sizes(df, keep=("source",)).collect()}
    assert got[1] == 3 and got[3] == 0 and set(got) == {1, 3, 4, 5}
    enc = K.encoding()
    assert enc.decode(enc.encode_ordinary("ß日本語 🙂")) == "ß日本語 🙂"


def test_rounds_go_on_while_they_save(spark, monkeypatch):
    """Many small tasks leave underfull containers that later rounds merge; close to the fewest possible remain."""
    monkeypatch.setattr(P, "PER_TASK", 50)
    rng = random.Random(3)
    df = spark.createDataFrame([(n, rng.randrange(1, 40)) for n in range(6000)], "doc_id long, n_tokens long").repartition(24)
    c = P.pack(df, spark.createDataFrame([("k", 100)], "container_kind string, capacity_tokens int"))
    r = P.fill(c).collect()[0]
    assert r["containers"] <= 1.02 * r["fewest"] + 1


def test_even_total(spark):
    """Shrunk until the smallest source reaches its share; only an absent one is short."""
    rng = random.Random(4)
    docs = [(n, "big", rng.randrange(1, 200)) for n in range(4000)] + [(10_000 + n, "Small ", 50) for n in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    total = M.even_total(df, targets)
    assert total == 20_000
    r = {x["source"]: x for x in M.mix(df, targets, total)[1].collect()}
    assert not r["big"]["too_small"] and not r["small"]["too_small"] and r["absent"]["too_small"]
    assert abs(r["big"]["actual_share"] - 0.6 / 0.9) < 0.01 and abs(r["small"]["actual_share"] - 0.3 / 0.9) < 0.01
    assert M.even_total(df.limit(0), targets) == 0
