"""P3: the most similar vectors for every query vector.

A forest of random-projection trees is fitted on a bounded sample; every vector
is indexed. A query takes the leaves of all trees in the order of one shared
priority queue, nearest split plane first, and notes those it visits. Up to a
fixed number of queries are sent to the vectors, which then never move: each
partition places its vectors in the trees, compares them with the queries that
visit their leaf, and keeps the best of each query. More queries than that, up to
every vector, meet the vectors in a join on the leaf; a leaf that holds many
vectors is split into parts to each of which its queries are sent. The best are
reranked by exact cosine.

Edge cases: vectors that are null, of another length than stated, with a null
or non-finite element, or all zero are no candidates and as queries have no
neighbours; only vectors of one model version are compared; equal similarities
go to the smallest id; a query is never its own neighbour; fewer than k others
give fewer rows; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidex.session import stage

#: Vectors of each model version the trees are fitted on: as many as there are, up to SAMPLE; for deeper trees PER_LEAF for each
#: leaf, up to SAMPLE_MOST, which is enough for leaves of LEAF vectors up to some five million vectors.
SAMPLE, SAMPLE_MOST, PER_LEAF = 20_000, 100_000, 4
TREES, LEAF, VISITS = 10, 192, 64
#: Queries that are broadcast, at most; more are joined with the vectors on the leaves.
BLOCK = 8192
#: Leaves a joined query visits first, to learn how similar its best vectors are at least.
FIRST_VISITS = 8
#: Vectors of a leaf that are compared in one task of the join.
PART = 4096


@dataclass
class Forest:
    """Split directions per tree and level, thresholds per tree and node (root 1, children 2n and 2n + 1)."""

    directions: np.ndarray  # trees x levels x dim
    thresholds: np.ndarray  # trees x 2 ** levels

    @property
    def levels(self) -> int:
        return self.directions.shape[1]

    def project(self, unit: np.ndarray) -> np.ndarray:
        t, levels, dim = self.directions.shape
        return (unit @ self.directions.reshape(t * levels, dim).T).reshape(len(unit), t, levels)

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        p = self.project(unit)
        node = np.ones(p.shape[:2], dtype=np.int32)
        tree = np.arange(p.shape[1])
        for level in range(self.levels):
            node = 2 * node + (p[:, :, level] > self.thresholds[tree, node])
        return node - (1 << self.levels)

    def visits(self, unit: np.ndarray, most: int) -> np.ndarray:
        """tree * leaves + leaf of the leaves nearest to each query, of all trees through one queue; -1 where there are fewer.

        A leaf's priority is the largest distance to a split plane on whose other side it lies. The queue holds all leaves at
        once: priorities are worked out level by level for a batch of queries, and the smallest are taken.
        """
        p, levels, size = self.project(unit), self.levels, 1 << self.levels
        trees = p.shape[1]
        out = np.full((len(unit), most), -1, dtype=np.int32)
        step = max(1, 4_000_000 // (trees * size))
        take = min(most, trees * size)
        for a in range(0, len(unit), step):
            q = p[a : a + step]
            far = np.zeros((len(q), trees, 1), dtype=np.float32)
            for level in range(levels):
                margin = q[:, :, level, None] - self.thresholds[None, :, 1 << level : 2 << level]
                far = np.stack([np.maximum(far, margin), np.maximum(far, -margin)], axis=3).reshape(len(q), trees, -1)
            far = far.reshape(len(q), -1)
            near = np.argpartition(far, take - 1, axis=1)[:, :take] if take < far.shape[1] else np.broadcast_to(np.arange(take), far.shape)
            order = np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable")
            out[a : a + step, :take] = np.take_along_axis(near, order, axis=1)
        return out


def grow(sample: np.ndarray, population: int, trees: int = TREES, leaf: int = LEAF, seed: int = 11) -> Forest:
    """A forest whose leaves hold about leaf of population vectors, split at the sample's medians."""
    dim = sample.shape[1]
    levels = max(1, int(np.ceil(np.log2(max(population, 2) / leaf))))
    levels = min(levels, max(1, int(np.log2(max(len(sample), 2))) - 1))
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((trees, levels, dim)).astype(np.float32)
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    forest = Forest(directions, np.zeros((trees, 1 << levels), dtype=np.float32))
    p = forest.project(sample)
    for t in range(trees):
        node = np.ones(len(sample), dtype=np.int64)
        for level in range(levels):
            at = pd.Series(p[:, t, level]).groupby(node).median()
            forest.thresholds[t, at.index.to_numpy()] = at.to_numpy()
            node = 2 * node + (p[:, t, level] > forest.thresholds[t, node])
    return forest


def _usable_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of all vectors of a batch, and numbers of the rows with an id, a version and the stated length."""
    sizes = np.asarray(batch.column("embedding").value_lengths().fill_null(-1))
    stated = np.asarray(batch.column("embedding_dimension").fill_null(-2))
    named = np.asarray(batch.column("embedding_model_version").is_valid()) & np.asarray(batch.column("cache_id").is_valid())
    return sizes, np.flatnonzero((sizes == stated) & (sizes > 0) & named)


def usable(batches: Iterator[pa.RecordBatch]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """version -> (ids, unit vectors) of the usable rows of the batches."""
    parts: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        sizes, rows = _usable_rows(batch)
        if not len(rows):
            continue
        versions = np.array(batch.column("embedding_model_version").take(pa.array(rows)).to_pylist(), dtype=object)
        ids = np.array(batch.column("cache_id").take(pa.array(rows)).to_pylist(), dtype=object)
        column = batch.column("embedding").take(pa.array(rows))
        for key in sorted({(v, int(s)) for v, s in zip(versions, sizes[rows])}):
            pick = np.flatnonzero((versions == key[0]) & (sizes[rows] == key[1]))
            flat = column.take(pa.array(pick)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = flat.reshape(len(pick), key[1])
            norm = np.sqrt((x * x).sum(axis=1))
            ok = np.isfinite(x).all(axis=1) & np.isfinite(norm) & (norm > 0)
            parts.setdefault(key, []).append((ids[pick][ok], (x[ok] / norm[ok, None]).astype(np.float32)))
    most: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for (v, dim), p in sorted(parts.items()):
        joined = np.concatenate([a for a, _ in p]), np.concatenate([b for _, b in p])
        most[f"{v}\u0000{dim}"] = joined  # vectors of one version and another length are compared among themselves
    return most


_COLUMNS = ["cache_id", "embedding_model_version", "embedding_dimension", "embedding"]
_FOUND = "query_id string, cache_id string, similarity double"


def _best(query: np.ndarray, item: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best items of each query, without repeats; item numbers are in the order of the ids."""
    order = np.lexsort((item, -sim, query))
    query, item, sim = query[order], item[order], sim[order]
    fresh = np.ones(len(query), dtype=bool)
    fresh[1:] = (query[1:] != query[:-1]) | (item[1:] != item[:-1])
    query, item, sim = query[fresh], item[fresh], sim[fresh]
    starts = np.r_[0, np.flatnonzero(query[1:] != query[:-1]) + 1] if len(query) else np.array([], dtype=int)
    rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)])) if len(query) else np.array([], dtype=int)
    return query[rank < k], item[rank < k], sim[rank < k]


def _compare(units: np.ndarray, forest: Forest, queries: np.ndarray, visits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, item) of the k best items of each query among those in the leaves it visits, by float32 cosine."""
    size = 1 << forest.levels
    leaves = forest.leaves(units) + np.arange(forest.thresholds.shape[0]) * size
    q_leaf, q_row = visits.ravel(), np.repeat(np.arange(len(visits)), visits.shape[1])
    keep = q_leaf >= 0
    q_leaf, q_row = q_leaf[keep], q_row[keep]
    order = np.argsort(q_leaf, kind="stable")
    q_leaf, q_row = q_leaf[order], q_row[order]
    i_leaf, i_row = leaves.T.ravel(), np.tile(np.arange(len(units)), leaves.shape[1])
    order = np.argsort(i_leaf, kind="stable")
    i_leaf, i_row = i_leaf[order], i_row[order]
    both = np.intersect1d(q_leaf, i_leaf)
    qa, qb = np.searchsorted(q_leaf, both), np.searchsorted(q_leaf, both, side="right")
    ia, ib = np.searchsorted(i_leaf, both), np.searchsorted(i_leaf, both, side="right")
    found, held = [], 0
    floor = np.full(len(queries), -2.0, dtype=np.float32)
    for a, b, c, d in zip(qa, qb, ia, ib):
        qs, items = q_row[a:b], i_row[c:d]
        sims = queries[qs] @ units[items].T
        if d - c > k:
            top = np.sort(np.argsort(-sims, axis=1, kind="stable")[:, :k], axis=1)
            sims, items = np.take_along_axis(sims, top, axis=1), items[top]
        else:
            items = np.broadcast_to(items, sims.shape)
        good = sims >= floor[qs][:, None]
        found.append((np.broadcast_to(qs[:, None], sims.shape)[good], items[good], sims[good]))
        held += int(good.sum())
        if held > 1_500_000:
            q, i, s = _best(*map(np.concatenate, zip(*found)), k)
            found, held = [(q, i, s)], 0
            n = np.bincount(q, minlength=len(queries))
            worst = np.full(len(queries), 2.0, dtype=np.float32)
            np.minimum.at(worst, q, s)
            floor = np.where(n >= k, worst, -2.0).astype(np.float32)
    if not found:
        return np.array([], dtype=int), np.array([], dtype=int)
    q, i, _ = _best(*map(np.concatenate, zip(*found)), k)
    return q, i


def sample_size(population: int, sample: int = SAMPLE, most: int = SAMPLE_MOST) -> int:
    """Vectors of a version to fit its trees on."""
    return max(sample, min(most, PER_LEAF * population // LEAF))


def fit(vectors: DataFrame, sample: int = SAMPLE, **grown: int) -> dict[str, Forest]:
    """version and dimension -> forest, fitted on a bounded sample of each version chosen by a hash of the id."""
    base = vectors.select(*_COLUMNS).where(F.col("embedding_model_version").isNotNull() & (F.size("embedding") == F.col("embedding_dimension")))
    counts = base.groupBy("embedding_model_version", "embedding_dimension").count().collect()  # one row per model version
    draw = F.pmod(F.xxhash64("cache_id"), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    keep = F.lit(False)
    for r in counts:
        keep = keep | ((F.col("embedding_model_version") == r[0]) & (F.col("embedding_dimension") == r[1]) & (draw < min(1.0, sample_size(r["count"], sample) / r["count"])))
    population = {f"{r[0]}\u0000{r[1]}": r["count"] for r in counts}
    drawn = usable(base.where(keep).toArrow().to_batches())
    return {key: grow(units, population[key], **grown) for key, (_, units) in drawn.items() if len(units) > 1}


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, forests: dict[str, Forest] | None = None, visits: int = VISITS, block: int = BLOCK, part: int = PART) -> DataFrame:
    """query_id, cache_id, similarity, rank: the k vectors most similar to each query. queries has the columns of vectors.

    Queries are written out with the leaves they visit. Up to block of them are broadcast, more are joined on the leaves.
    """
    spark = vectors.sparkSession
    forests = fit(vectors) if forests is None else forests
    trees = spark.sparkContext.broadcast(forests)

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (ids, units) in usable(batches).items():
            if (forest := trees.value.get(key)) is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.string()), pa.array([key] * len(ids)), pa.array(list(units), pa.list_(pa.float32())), pa.array(list(forest.visits(units, visits)), pa.list_(pa.int32()))],
                    names=["query_id", "key", "unit", "visits"],
                )

    asked = stage(queries.select(*_COLUMNS).mapInArrow(visited, "query_id string, key string, unit array<float>, visits array<int>"), "queries")
    out = _sent(vectors, asked, trees, k) if asked.count() <= block else _joined(vectors, asked, trees, k, part)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "cache_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "cache_id", "similarity", "rank")


def _sent(vectors: DataFrame, asked: DataFrame, trees, k: int) -> DataFrame:
    """query_id, cache_id, similarity: the best of each partition of vectors for a bounded number of queries, which are broadcast."""
    table = asked.toArrow()
    sent = {}
    keys = np.array(table.column("key").to_pylist(), dtype=object)
    for key in sorted(set(keys)):
        t = table.filter(pa.array(keys == key))
        sent[key] = (
            np.array(t.column("query_id").to_pylist(), dtype=object),
            np.array(t.column("unit").combine_chunks().flatten()).reshape(t.num_rows, -1),
            np.array(t.column("visits").combine_chunks().flatten()).reshape(t.num_rows, -1),
        )
    shared = vectors.sparkSession.sparkContext.broadcast(sent)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (ids, units) in usable(batches).items():
            if key not in shared.value:
                continue
            order = np.argsort(ids.astype(str), kind="stable")
            ids, units = ids[order], units[order]
            q_ids, q_units, q_visits = shared.value[key]
            q, i = _compare(units, trees.value[key], q_units, q_visits, k + 1)
            sims = np.einsum("ij,ij->i", q_units[q].astype(np.float64), units[i].astype(np.float64))
            other = q_ids[q] != ids[i]
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_ids[q][other], pa.string()), pa.array(ids[i][other], pa.string()), pa.array(sims[other], pa.float64())], names=["query_id", "cache_id", "similarity"]
            )

    return vectors.select(*_COLUMNS).mapInArrow(search, _FOUND)


def _joined(vectors: DataFrame, asked: DataFrame, trees, k: int, part: int) -> DataFrame:
    """query_id, cache_id, similarity: the best of each part of a leaf for the queries that visit it, by a join on the leaf.

    Queries visit their first leaves first; from the others only what is at least as similar as the k-th of those comes back.
    """

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (ids, units) in usable(batches).items():
            if (forest := trees.value.get(key)) is not None:
                leaves = forest.leaves(units) + np.arange(forest.thresholds.shape[0]) * (1 << forest.levels)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.string()), pa.array([key] * len(ids)), pa.array(list(units), pa.list_(pa.float32())), pa.array(list(leaves.astype(np.int32)), pa.list_(pa.int32()))], names=["cache_id", "key", "unit", "leaves"]
                )

    # the index: every vector with its leaf in each tree, stored once
    index = stage(vectors.select(*_COLUMNS).mapInArrow(placed, "cache_id string, key string, unit array<float>, leaves array<int>"), "index")
    sizes = index.select("key", F.explode("leaves").alias("leaf")).groupBy("key", "leaf").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    sizes = F.broadcast(sizes)  # at most TREES x SAMPLE_MOST / 2 leaves of each model version
    items = index.select("key", "cache_id", "unit", F.explode("leaves").alias("leaf")).join(sizes, ["key", "leaf"])
    items = items.select("key", "leaf", F.pmod(F.xxhash64("cache_id"), "parts").cast("int").alias("part"), "cache_id", "unit")
    def at(queries: DataFrame, visits) -> DataFrame:
        rows = queries.select("key", "query_id", "unit", "least", F.explode(visits).alias("leaf")).where("leaf >= 0").join(sizes, ["key", "leaf"])
        return rows.select("key", "leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query_id", "unit", "least")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.string()), "cache_id": pa.array([], pa.string()), "similarity": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        matrix = lambda t: np.array(t.column("unit").combine_chunks().flatten()).reshape(t.num_rows, -1)
        ids = np.array(left.column("cache_id").to_pylist(), dtype=object)
        order = np.argsort(ids.astype(str), kind="stable")
        ids, units, q_units = ids[order], matrix(left)[order], matrix(right)
        q_ids, least = np.array(right.column("query_id").to_pylist(), dtype=object), np.array(right.column("least"))
        found = []
        for a in range(0, len(q_ids), 512):
            sims = q_units[a : a + 512] @ units.T
            best = np.argsort(-sims, axis=1, kind="stable")[:, : k + 1]
            q, i = np.repeat(np.arange(a, a + len(sims)), best.shape[1]), best.ravel()
            exact = np.einsum("ij,ij->i", q_units[q].astype(np.float64), units[i].astype(np.float64))
            other = (q_ids[q] != ids[i]) & (exact >= least[q])
            found.append((q_ids[q][other], ids[i][other], exact[other]))
        q, i, s = map(np.concatenate, zip(*found))
        return pa.table({"query_id": pa.array(q, pa.string()), "cache_id": pa.array(i, pa.string()), "similarity": pa.array(s, pa.float64())})

    by = ["key", "leaf", "part"]

    def meet(coming: DataFrame) -> DataFrame:
        met = items.groupBy(*by).cogroup(coming.groupBy(*by)).applyInArrow(compare, _FOUND)
        return met.groupBy("query_id", "cache_id").agg(F.max("similarity").alias("similarity"))  # found in several trees

    first = stage(meet(at(asked.withColumn("least", F.lit(-2.0)), F.slice("visits", 1, FIRST_VISITS))), "first")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "cache_id")
    kth = first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("similarity")).alias("kth"))
    rest = asked.join(kth, "query_id", "left").withColumn("least", F.coalesce("kth", F.lit(-2.0)))
    more = meet(at(rest, F.slice("visits", FIRST_VISITS + 1, F.greatest(F.size("visits") - FIRST_VISITS, F.lit(0)))))
    return first.unionByName(more).groupBy("query_id", "cache_id").agg(F.max("similarity").alias("similarity"))


def all_neighbours(vectors: DataFrame, k: int = 10, **how: int) -> DataFrame:
    """neighbours() of every vector."""
    return neighbours(vectors, vectors, k, **how)


def pairs(found: DataFrame) -> DataFrame:
    """cache_id_a, cache_id_b: found as pairs, the smaller id first, each once."""
    return found.select(F.least("query_id", "cache_id").alias("cache_id_a"), F.greatest("query_id", "cache_id").alias("cache_id_b")).distinct()
