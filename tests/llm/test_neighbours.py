import numpy as np

from evidex.llm import neighbours as N

SCHEMA = "cache_id string, embedding_model_version string, embedding_dimension int, embedding array<float>, similarity string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def brute(rows, queries, k):
    ok = {r[0]: np.array(r[3], dtype=np.float32).astype(float) for r in rows if r[3] is not None and len(r[3]) == r[2] and all(x is not None and np.isfinite(x) for x in r[3]) and any(r[3])}
    version = {r[0]: r[1] for r in rows}
    out = set()
    for q in queries:
        if q not in ok:
            continue
        sims = [(-round(float(ok[q] @ v / np.linalg.norm(ok[q]) / np.linalg.norm(v)), 5), i) for i, v in ok.items() if i != q and version[i] == version[q]]
        out |= {(q, i) for _, i in sorted(sims)[:k]}
    return out


def test_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 16))
    rows = [(f"a{n:04}", "v1", 16, (centres[n % 30] + 0.3 * rng.standard_normal(16)).tolist()) for n in range(3000)]
    rows += [(f"b{n:03}", "v2", 8, rng.standard_normal(8).tolist()) for n in range(200)]
    rows += [("x1", "v1", 16, None), ("x2", "v1", 16, [1.0] * 15), ("x3", "v1", 16, [0.0] * 16), ("x4", "v1", 16, [float("nan")] * 16), ("x5", None, 16, [1.0] * 16), ("x6", "v1", 16, [None] + [1.0] * 15), ("x7", "v1", 16, [float("inf")] + [1.0] * 15)]
    df = table(spark, rows)
    asked = [f"a{n:04}" for n in range(0, 3000, 100)] + ["b000", "x1", "x3", "x4"]
    got = N.neighbours(df, df.where(df.cache_id.isin(asked)), k=10, forests=N.fit(df, leaf=64), visits=16, block=20).collect()
    want = brute(rows, asked, 10)
    found = {(r["query_id"], r["cache_id"]) for r in got}
    assert len(found) == len(want) and len(found & want) >= 0.9 * len(want)
    assert all(r["similarity"] <= 1 + 1e-9 for r in got)


def test_copies_and_few_rows(spark):
    rows = [(f"c{n:03}", "v", 4, [1.0, 2.0, 3.0, 4.0]) for n in range(300)] + [("d", "v", 4, [1.0, 0.0, 0.0, 0.0])]
    df = table(spark, rows)
    got = N.neighbours(df, df.where("cache_id in ('c150', 'd')"), k=5).collect()
    assert [r["cache_id"] for r in sorted((r for r in got if r["query_id"] == "c150"), key=lambda r: r["rank"])] == ["c000", "c001", "c002", "c003", "c004"]
    pair = table(spark, rows[:2])
    assert {tuple(r) for r in N.pairs(N.neighbours(pair, pair, k=5)).collect()} == {("c000", "c001")}
    none = table(spark, [])
    assert N.neighbours(none, none).count() == 0


def test_every_vector_by_the_join(spark):
    """All vectors as queries, exactly checked for every hundredth; big leaves are split without losing any pair."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    rows = [(f"a{n:04}", "v1", 16, (centres[n % 40] + 0.3 * rng.standard_normal(16)).tolist()) for n in range(4000)]
    df = table(spark, rows)
    forests = N.fit(df, leaf=64)
    got = N.all_neighbours(df, k=10, forests=forests, block=100, part=50).collect()
    assert len(got) == 40_000 and all(r["query_id"] != r["cache_id"] for r in got)
    asked = [f"a{n:04}" for n in range(0, 4000, 100)]
    want = brute(rows, asked, 10)
    found = {(r["query_id"], r["cache_id"]) for r in got if r["query_id"] in set(asked)}
    assert len(found & want) >= 0.95 * len(want)


def test_the_queue_takes_the_nearest_leaves():
    import heapq

    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    f = N.grow(x, 300, trees=3, leaf=20)
    p, size = f.project(x[:20]), 1 << f.levels
    for q, got in enumerate(f.visits(x[:20], 12)):
        queue, want = [(0.0, t, 0, 1) for t in range(3)], []
        while queue and len(want) < 12:
            far, t, level, node = heapq.heappop(queue)
            if level == f.levels:
                want.append(far)
                continue
            m = float(p[q, t, level] - f.thresholds[t, node])
            heapq.heappush(queue, (max(far, m), t, level + 1, 2 * node))
            heapq.heappush(queue, (max(far, -m), t, level + 1, 2 * node + 1))
        have = []
        for leaf in got:
            t, node, far = leaf // size, 1, 0.0
            for level in range(f.levels):
                bit = (leaf % size) >> (f.levels - 1 - level) & 1
                m = float(p[q, t, level] - f.thresholds[t, node])
                far, node = max(far, -m if bit else m), 2 * node + bit
            have.append(far)
        assert np.allclose(have, want, atol=1e-5)


def test_the_sample_follows_the_depth_within_its_bound():
    assert [N.sample_size(n) for n in (100, 100_000, 2_000_000, 10**9)] == [20_000, 20_000, 41_666, 100_000]
    x = np.random.default_rng(0).standard_normal((N.sample_size(2_000_000), 8)).astype(np.float32)
    assert N.grow(x, 2_000_000, trees=1).levels == 14  # leaves of 122 of 2,000,000 vectors
