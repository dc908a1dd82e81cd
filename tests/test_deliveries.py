import random
import re

from conftest import ts

from evidex.operators import deliveries as D

SCHEMA = "id string, source_id string, external_id string, imported_at timestamp_ntz, kept_id string, number string"


def rows(spark, data):
    return spark.createDataFrame([(*r, "clash", "clash") for r in data], SCHEMA)


def brute(data):
    best, out = {}, set()
    for i, s, e, t in sorted(data, key=lambda r: (r[3], r[0])):
        if s is None or e is None:
            continue
        k = (s, e.strip().lower())
        if k in best:
            out.add(i)
        best.setdefault(k, i)
    return out


def test_surplus_matches_brute_force(spark):
    rng = random.Random(3)
    data = []
    for n in range(400):
        e = rng.choice([f"activity:{rng.randrange(60)}", f"Activity:{rng.randrange(60)}", f" x{rng.randrange(40)}:00{rng.randrange(3)}\n", "", "  ", None, "hot", "hot", f"a:{10 ** 20}"])
        data.append((f"m{n:03}", rng.choice(["s1", "s2", None]), e, ts(f"2024-01-0{rng.randrange(1, 5)}T00:00:00")))
    df = rows(spark, data)
    assert {r[0] for r in D.surplus_deliveries(df).collect()} == brute(data)
    for epochs in (1, 3):
        surplus, state = D.deliver_in_order(df, epochs)
        assert {r["message_id"] for r in surplus.collect()} == brute(data)
        ranges = [(r["source_id"], r["producer"], r["lo"], r["hi"]) for r in state.ranges.collect()]
        covered = {(s, p, n) for s, p, lo, hi in ranges for n in range(lo, hi + 1)}
        want = {(s, e.strip().lower().split(":")[0], int(e.strip().split(":")[1])) for _, s, e, _ in data if s and e and re.fullmatch(r"(?i)activity:(0|[1-9]\d*)", e.strip())}
        assert covered == want and sum(hi - lo + 1 for _, _, lo, hi in ranges) == len(want)
    kept = D.first_deliveries(df)
    assert kept.columns == df.columns and {r["id"] for r in kept.collect()} == {r[0] for r in data} - brute(data)


def test_ranges_are_disjoint_and_carry_over(spark):
    t = ts("2024-01-01T00:00:00")
    first = rows(spark, [(f"a{n}", "s", f"p:{n}", t) for n in (1, 2, 3, 7, 8, 5000, 5001)] + [("n1", "s", "x y", t)])
    surplus, state = D.deliver(first)
    assert surplus.count() == 0
    assert sorted((r["lo"], r["hi"]) for r in state.ranges.collect()) == [(1, 3), (7, 8), (5000, 5001)]
    second = rows(spark, [("b1", "s", "p:3", t), ("b2", "s", "p:4", t), ("b3", "s", "P:4 ", t), ("b4", "s", "X Y", t), ("b5", "s", "z", t)])
    surplus, state = D.deliver(second, state)
    assert {(r["message_id"], r["kept_id"]) for r in surplus.collect()} == {("b1", None), ("b3", "b2"), ("b4", None)}
    assert sorted((r["lo"], r["hi"]) for r in state.ranges.collect()) == [(1, 4), (7, 8), (5000, 5001)]
    assert state.keys.count() == 2


def test_ranges_merge_across_blocks(spark):
    df = spark.createDataFrame([("s", "p", n, n) for n in range(4000, 8300)] * 2, "source_id string, producer string, lo long, hi long")
    assert [(r["lo"], r["hi"]) for r in D.merge_ranges(df).collect()] == [(4000, 8299)]


def test_empty(spark):
    assert D.surplus_deliveries(rows(spark, [])).count() == 0
