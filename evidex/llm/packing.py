"""P8: filling fixed-capacity containers with items.

Hierarchical residual packing: each partition packs its items best fit, largest
first, and emits the containers that are nearly full; the others go on as items
to fewer tasks and are merged best fit again, round by round, until a round saves
next to none. A task gets a bounded number of containers, so the last rounds
don't end in a single task.

Only a text larger than the capacity is cut, into full containers and a rest
that is packed like any other item.

Edge cases: null texts are no items; an empty text is an item of size 0;
repeated documents are packed each; capacities that are null or below 1 are left
out; an empty table gives no containers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.session import stage

#: Filled share from which a container is emitted before the last round.
FULL = 0.995
#: Containers a task of a merging round gets, about.
PER_TASK = 20_000
#: Share of its containers a round must save for another one to follow. In a single task, where no other dealing exists, any one does.
SAVES = 0.001

_MEMBER = "struct<doc_id: bigint, piece: int, first_token: bigint, tokens: bigint>"
_BIN = f"container_kind string, capacity int, load bigint, members array<{_MEMBER}>"


def best_fit(loads: list[int], capacity: int) -> list[int]:
    """The bin of each load when the largest come first and each goes where least space is left."""
    bins: dict[int, list[int]] = defaultdict(list)  # space left -> bins
    mask, count, out = 0, 0, [0] * len(loads)  # mask: bit r is set if a bin has r left
    for i in sorted(range(len(loads)), key=lambda i: -loads[i]):
        size = loads[i]
        fits = mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = bins[left].pop()
            if not bins[left]:
                mask ^= 1 << left
        else:
            b, left, count = count, capacity, count + 1
        out[i] = b
        left -= size
        if not bins[left]:
            mask |= 1 << left
        bins[left].append(b)
    return out


def pieces(n_tokens: int, capacity: int) -> list[tuple[int, int, int]]:
    """(piece, first token, tokens) of a text: one piece, or full containers and a rest if it is larger than the capacity."""
    if n_tokens <= capacity:
        return [(0, 0, n_tokens)]
    return [(k, at, min(capacity, n_tokens - at)) for k, at in enumerate(range(0, n_tokens, capacity))]


def _first(capacities: list[tuple[str, int]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        sizes: list[int] = []
        for b in batches:
            ids += b["doc_id"].tolist()
            sizes += b["n_tokens"].tolist()
        for kind, capacity in capacities:
            items = [(d, *p) for d, n in zip(ids, sizes) for p in pieces(n, capacity)]
            grouped: dict[int, list] = defaultdict(list)
            for item, b in zip(items, best_fit([i[3] for i in items], capacity)):
                grouped[b].append(item)
            yield from _rows(kind, capacity, grouped.values())

    return run


def _rows(kind: str, capacity: int, groups) -> Iterator[pd.DataFrame]:
    rows = [(kind, capacity, sum(m[3] for m in g), [dict(zip(("doc_id", "piece", "first_token", "tokens"), m)) for m in g]) for g in groups]
    for at in range(0, len(rows), 2000):
        yield pd.DataFrame(rows[at : at + 2000], columns=["container_kind", "capacity", "load", "members"])


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kinds: dict[tuple[str, int], list] = defaultdict(list)
    for b in batches:
        for kind, capacity, load, members in zip(b["container_kind"], b["capacity"], b["load"], b["members"]):
            kinds[kind, capacity].append((load, [(m["doc_id"], m["piece"], m["first_token"], m["tokens"]) for m in members]))
    for (kind, capacity), bins in sorted(kinds.items()):
        grouped: dict[int, list] = defaultdict(list)
        for (_, members), b in zip(bins, best_fit([int(x[0]) for x in bins], capacity)):
            grouped[b] += members
        yield from _rows(kind, capacity, grouped.values())


def pack(sizes: DataFrame, capacities: DataFrame, full: float = FULL, saves: float = SAVES) -> DataFrame:
    """container_kind, capacity, container_id, load, members of all containers.

    sizes: doc_id, n_tokens. capacities: container_kind, capacity_tokens (a few rows).
    """
    caps = sorted((r[0], int(r[1])) for r in capacities.where("capacity_tokens >= 1 and container_kind is not null").select("container_kind", "capacity_tokens").distinct().collect())
    bins = stage(sizes.where("n_tokens is not null").select("doc_id", "n_tokens").mapInPandas(_first(caps), _BIN), "bins")
    nearly = F.col("load") >= full * F.col("capacity")
    done = [bins.where(nearly)]
    rest = bins.where(~nearly)
    n, tasks = rest.count(), 0
    while n > 1:
        tasks = max(1, -(-n // PER_TASK))
        # loads are dealt out evenly and anew in each round, so that small ones meet other large ones in every task
        dealt = rest.repartition(tasks, F.xxhash64(F.col("members")[0]["doc_id"], F.col("members")[0]["piece"], F.lit(n))) if tasks > 1 else rest.coalesce(1)
        bins = stage(dealt.mapInPandas(_merge, _BIN), "bins")
        done.append(bins.where(nearly))
        rest = bins.where(~nearly)
        total, left = bins.count(), rest.count()
        saved, n = n - total, left
        if saved < 1 or tasks > 1 and saved < saves * total:
            break
    out = rest
    for d in done:
        out = out.unionByName(d)
    # the first member names the container: an item is in one container of each kind
    first = F.array_min(F.transform("members", lambda m: F.struct(m["doc_id"], m["piece"])))
    return out.select(
        "container_kind", "capacity", F.concat_ws("-", F.col("container_kind"), first["doc_id"], first["piece"]).alias("container_id"), "load", "members"
    )


def contents(containers: DataFrame) -> DataFrame:
    """container_kind, container_id, doc_id, piece, first_token, tokens of every item."""
    return containers.select("container_kind", "container_id", F.inline("members"))


def fill(containers: DataFrame) -> DataFrame:
    """container_kind, capacity, containers, tokens, fewest (no packing needs less), fill."""
    return containers.groupBy("container_kind", "capacity").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("load").alias("tokens"), F.ceil(F.sum("load") / F.first("capacity")).alias("fewest"),
        F.round(F.sum("load") / (F.count(F.lit(1)) * F.first("capacity")), 6).alias("fill"),
    )
