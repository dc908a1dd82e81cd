"""Derivation with pluggable models: embedding of pending segments, payload parsing, generations, invalidation.

A model is a function on a batch of texts; the default embedder is deterministic
(hashed character n-grams), so results repeat.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], np.ndarray]


def hashed_embedder(dim: int = 64) -> Embedder:
    """Unit vectors of hashed character 3-grams."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            raw = f"  {t.lower()} ".encode()
            for k in range(len(raw) - 2):
                h = zlib.crc32(raw[k : k + 3])
                out[i, h % dim] += 1 if h & 1 << 20 else -1
            out[i] /= np.linalg.norm(out[i]) or 1
        return out

    return embed


def embed_pending(segments: DataFrame, cache: DataFrame, version: str, embedder: Embedder | None = None) -> DataFrame:
    """input_sha256, embedding_model_version, embedding_dimension, embedding of the distinct texts without a cached vector.

    segments: content_text. Texts are reduced to their hashes before the cache is asked, each is embedded once.
    """
    embedder = embedder or hashed_embedder()
    texts = segments.where(F.trim(F.coalesce("content_text", F.lit(""))) != "").select(F.sha2("content_text", 256).alias("input_sha256"), "content_text").groupBy("input_sha256").agg(F.first("content_text").alias("content_text"))
    have = cache.where(F.col("embedding_model_version") == version).select("input_sha256").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = embedder(b["content_text"].tolist())
            yield pd.DataFrame({"input_sha256": b["input_sha256"], "embedding_model_version": version, "embedding_dimension": v.shape[1] if len(v) else 0, "embedding": list(v)})

    return texts.join(have, "input_sha256", "left_anti").mapInPandas(run, "input_sha256 string, embedding_model_version string, embedding_dimension int, embedding array<float>")


def active_generations(generations: DataFrame, segments: DataFrame, embedded: DataFrame) -> DataFrame:
    """conversation_id, generation_id: of each conversation the latest generation all of whose segments are embedded.

    generations: conversation_id, generation_id, created_at. segments: generation_id, segment_id. embedded: segment_id.
    """
    from evidex.operators.relational import complete, latest_by_max

    ready = complete(generations, segments, embedded, "generation_id", "segment_id")
    return latest_by_max(ready, ["conversation_id"], ["created_at", "generation_id"]).select("conversation_id", "generation_id")


def invalidated(segments: DataFrame, messages: DataFrame | None = None, conversations: DataFrame | None = None) -> DataFrame:
    """id of the segments that reclassified messages (those that hold them) or conversations (all of theirs) invalidate."""
    out = segments.select("id").limit(0)
    if messages is not None:
        hit = segments.select("id", F.explode("message_ids").alias("m")).join(messages.select(F.col("id").alias("m")).distinct(), "m").select("id")
        out = out.unionByName(hit)
    if conversations is not None:
        c = conversations.select(F.col("id").alias("c")).distinct()
        out = out.unionByName(segments.join(c, F.col("conversation_id") == F.col("c"), "left_semi").select("id"))
    return out.distinct()


def parsed_segments(payload: Column) -> Column:
    """The segments of a model's payload (an array of title, summary, message_ids, text), null if anything is off.

    The payload must hold exactly 'segments', not empty, each with exactly the four keys and a text.
    """
    items = F.from_json(F.get_json_object(payload, "$.segments"), "array<struct<title:string,summary:string,message_ids:array<string>,content_text:string>>")
    raw = F.from_json(F.get_json_object(payload, "$.segments"), "array<map<string,string>>")
    keys = F.array(*(F.lit(k) for k in ("content_text", "message_ids", "summary", "title")))
    exact = F.forall(raw, lambda m: F.array_sort(F.map_keys(m)) == keys)
    good = F.forall(items, lambda x: F.trim(F.coalesce(x["content_text"], F.lit(""))) != "")
    top = F.json_object_keys(payload)
    return F.when((F.size(top) == 1) & F.array_contains(top, "segments") & (F.size(items) > 0) & exact & good, items)


def chain_of_parts(texts: DataFrame, most: int) -> DataFrame:
    """id, part, text: texts longer than most halved until each part fits, in order."""
    n = F.greatest(F.lit(1), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), F.length("text") / most)))).cast("int"))
    step = F.ceil(F.length("text") / n).cast("int")
    return texts.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr("text", i * step + 1, step))).alias("part", "text"))


def best_run(runs: DataFrame, metric: str, keys: list[str], maximize: bool = True) -> DataFrame:
    """The run of each key with the best metric, then the smallest run_id."""
    w = Window.partitionBy(*keys).orderBy(F.desc(metric) if maximize else F.asc(metric), "run_id")
    return runs.where(F.col(metric).isNotNull()).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def bundle_ids(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bundle: the only bundle_id of a group, 'unknown' without any, else a hash of the sorted set."""
    ids = F.array_sort(F.collect_set("bundle_id"))
    return rows.groupBy(*keys).agg(ids.alias("ids")).select(*keys, F.when(F.size("ids") == 0, "unknown").when(F.size("ids") == 1, F.col("ids")[0]).otherwise(F.sha2(F.array_join("ids", "\u0000"), 256)).alias("bundle"))


def reference_defects(references: DataFrame, parents: DataFrame, key: str, boundary: list[str]) -> DataFrame:
    """key, defect of references whose parent is unknown or lies in another tenant or corpus."""
    p = parents.select(F.col(key).alias("p_key"), *(F.col(c).alias(f"p_{c}") for c in boundary))
    same = F.lit(True)
    for c in boundary:
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    return references.join(p, F.col(key) == F.col("p_key"), "left").select(key, F.when(F.col("p_key").isNull(), "unknown parent").when(~same, "other boundary").alias("defect")).where("defect is not null")
