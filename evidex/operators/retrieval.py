"""Lexical and exact-reference retrieval, budgeted packets, corpus description, embedding cache."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidex.functions.text import QUERY_TOKEN, collapse, decision_id, lexical_score, opaque_id, reference_value, rfc_id, words
from evidex.session import stage


def haystack() -> Column:
    """What a query is matched against: content, external id, sub kind and provenance."""
    return F.lower(F.concat_ws(" ", F.coalesce("content", F.lit("")), F.coalesce("external_id", F.lit("")), F.coalesce("sub_kind", F.lit("")), F.coalesce("provenance.path", F.lit("")), F.coalesce("provenance.commit_sha", F.lit(""))))


def tokens_of(query: str) -> list[str]:
    return re.findall(QUERY_TOKEN, query.lower())


def search(corpus: DataFrame, query: str, limit: int = 10, newest: int = 1000) -> DataFrame:
    """The best rows among the newest, by score, then external id. newest and limit are the feature's own bounds."""
    recent = corpus.orderBy(F.desc("recorded_at"), "external_id", "item_id").limit(newest)
    scored = recent.withColumn("score", lexical_score(haystack(), tokens_of(query))).where("score > 0")
    return scored.orderBy(F.desc("score"), "external_id", "item_id").limit(max(1, min(limit, 50)))


def search_each(corpus: DataFrame, query: str, limit: int = 10, newest: int = 1000) -> DataFrame:
    """search() in every (tenant_id, corpus_id) on its own: rows with score and rank, up to limit for each corpus.

    The newest rows are those of one corpus; which corpora may be read is the caller's filter (R.secure_view). Both
    bounds are ranks, which Spark applies before the shuffle as well, so a large corpus is no large task.
    """
    own = lambda *order: Window.partitionBy("tenant_id", "corpus_id").orderBy(*order, "external_id", "item_id")
    recent = corpus.withColumn("age", F.row_number().over(own(F.desc("recorded_at")))).where(F.col("age") <= newest).drop("age")
    scored = recent.withColumn("score", lexical_score(haystack(), tokens_of(query))).where("score > 0")
    return scored.withColumn("rank", F.row_number().over(own(F.desc("score")))).where(F.col("rank") <= max(1, min(limit, 50)))


def references(corpus: DataFrame) -> DataFrame:
    """item_id, ref_kind, ref_value, normalized: what each row can be looked up by, each kind and value once."""
    text = F.concat_ws(" ", "external_id", "content")
    item = lambda kind, value: F.struct(F.lit(kind).alias("ref_kind"), value.alias("ref_value"))
    refs = F.array(
        item("path", F.col("provenance.path")), item("commit_sha", F.col("provenance.commit_sha")), item("item_id", F.col("item_id")),
        item("rfc_id", F.when(F.col("sub_kind").contains("rfc"), rfc_id(text))), item("decision_id", F.when(F.col("sub_kind").contains("decision"), decision_id(text))),
    )
    rows = corpus.select("item_id", F.inline(refs)).where(F.trim("ref_value") != "")
    return rows.withColumn("normalized", reference_value(F.col("ref_kind"), F.col("ref_value"))).groupBy("item_id", "ref_kind", "normalized").agg(F.min("ref_value").alias("ref_value"))


def lookup(refs: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """item_id, matched (sorted kinds) of rows with any of the wanted (kind, value). wanted is what one query names."""
    w = refs.sparkSession.createDataFrame(wanted, "w_kind string, w_value string").select("w_kind", reference_value(F.col("w_kind"), F.col("w_value")).alias("w_normalized")).distinct()
    return refs.join(F.broadcast(w), (F.col("ref_kind") == F.col("w_kind")) & (F.col("normalized") == F.col("w_normalized"))).groupBy("item_id").agg(
        F.array_join(F.array_sort(F.collect_set("ref_kind")), ",").alias("matched")
    )


def packet(hits: DataFrame, budget: int, most: int = 50, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, item_id, rank, cost, included: hits (keys, item_id, score, external_id, content) packed greedily within a number of words, a packet for each value of keys.

    A hit over the rest of the budget is skipped and later, smaller ones may still fit. At most 50 hits are ranked in a packet.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "external_id", "item_id")
    best = hits.withColumn("at", F.row_number().over(w)).where(F.col("at") <= most) if keys else hits.orderBy(F.desc("score"), "external_id", "item_id").limit(most)
    ranked = best.withColumn("cost", words(F.col("content")) + words(F.concat_ws(" ", "item_id", "external_id")))
    item = F.struct(F.negative("score").alias("o"), "external_id", "item_id", "cost")
    listed = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))  # at most 50 entries
    start = F.struct(F.array().cast("array<struct<item_id:string,rank:int,cost:int,included:boolean>>").alias("out"), F.lit(0).alias("used"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["cost"] <= budget
        row = F.struct(x["item_id"].alias("item_id"), (F.size(acc["out"]) + 1).alias("rank"), x["cost"].alias("cost"), fits.alias("included"))
        return F.struct(F.array_append(acc["out"], row).alias("out"), (acc["used"] + F.when(fits, x["cost"]).otherwise(0)).alias("used"))

    return listed.select(*keys, F.inline(F.aggregate("items", start, step, lambda a: a["out"])))


def provenance_json() -> Column:
    """Provenance as JSON with sorted keys and blanks after separators, as it is searched and cited."""
    text = lambda c: F.when(c.isNull(), "null").otherwise(F.concat(F.lit('"'), c, F.lit('"')))
    both = F.concat(F.lit('{"commit_sha": '), text(F.col("provenance.commit_sha")), F.lit(', "path": '), text(F.col("provenance.path")), F.lit("}"))
    return F.when(F.col("provenance").isNull(), "{}").otherwise(both)


def exact_hits(corpus: DataFrame, wanted: DataFrame, query: str, limit: int = 10, newest: int = 1000) -> DataFrame:
    """Rows of each (tenant_id, corpus_id) that any wanted reference names: tenant_id, corpus_id, item_id, external_id, lane, score, rank.

    wanted: ref_kind, ref_value, what one query names. Rows found through references() score 10 and what the query scores on
    them; of those the newest count. Commits by hash, sources by content hash and files by path score 100. Both lanes are merged
    by the whole part of the score, then external_id; a row that both lanes find is there twice.
    """
    w = F.broadcast(wanted.select(F.col("ref_kind").alias("w_kind"), reference_value(F.col("ref_kind"), F.col("ref_value")).alias("w_value")).distinct())
    kinds = ("path", "commit_sha", "item_id", "rfc_id", "decision_id")
    named = references(corpus).join(w.where(F.col("w_kind").isin(*kinds)), (F.col("ref_kind") == F.col("w_kind")) & (F.col("normalized") == F.col("w_value"))).select("item_id").distinct()
    own = lambda *order: Window.partitionBy("tenant_id", "corpus_id").orderBy(*order)
    hay = F.lower(F.concat_ws(" ", F.coalesce("content", F.lit("")), "external_id", F.coalesce("sub_kind", F.lit("")), provenance_json()))
    tokens = tokens_of(query)
    found = corpus.join(named, "item_id", "left_semi").withColumn("age", F.row_number().over(own(F.desc("recorded_at"), "external_id", "item_id"))).where(F.col("age") <= newest)
    score = F.round(F.lit(10.0) + (lexical_score(hay, tokens) if tokens else F.lit(0.0)), 4)
    cols = ["tenant_id", "corpus_id", "item_id", "external_id"]
    lanes = found.select(*cols, F.lit("references").alias("lane"), score.cast("double").alias("score"))
    direct = {"commit_sha": F.lower("provenance.commit_sha"), "source_hash": F.lower("content_sha256"), "path": F.lower("provenance.path")}
    for kind, value in direct.items():
        hit = corpus.withColumn("__v", value).join(w.where(F.col("w_kind") == kind), F.col("__v") == F.col("w_value"))
        lanes = lanes.unionByName(hit.select(*cols, F.lit(kind).alias("lane"), F.lit(100.0).alias("score")))
    rank = F.row_number().over(own(F.desc(F.col("score").cast("int")), F.coalesce("external_id", F.lit("")), "lane", "item_id"))
    return lanes.withColumn("rank", rank).where(F.col("rank") <= limit)


def labelled(hits: DataFrame) -> DataFrame:
    """Hits as they are handed out: reference_id, where they come from, content, score, tier and freshness."""
    dirty = F.col("redaction_state") == "dirty"
    return hits.select(
        opaque_id(F.struct("corpus_id", "item_id", "tenant_id")).alias("reference_id"), "tenant_id", "corpus_id", "source_kind", F.coalesce("sub_kind", F.lit("unknown")).alias("sub_kind"), "external_id",
        F.coalesce("content", F.lit("")).alias("content"), "score", "privacy_tier", provenance_json().alias("provenance"), F.coalesce(dirty, F.lit(False)).alias("dirty_working_tree"),
        F.when(F.coalesce(dirty, F.lit(False)), "dirty_working_tree").when(dirty.isNotNull(), "fresh").otherwise("unknown").alias("freshness"),
    )


#: Keys of a citation that are written whether they have a value or not.
_CITED = ["tenant_id", "corpus_id", "source_kind", "sub_kind", "external_id", "reference_id", "freshness"]


def citation_words(path: Column) -> Column:
    """Words of a hit's citation as JSON with sorted keys: two for each of its 14 keys, more where a value holds blanks."""
    extra = lambda c: F.size(F.split(collapse(F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))), " ")) - 1
    total = F.lit(28) + extra(path)
    for c in _CITED:
        total = total + extra(F.col(c))
    return total


def build_packets(hits: DataFrame, budget: int, most: int = 50) -> DataFrame:
    """tenant_id, corpus_id, candidate_id, reference_id, rank, cost, selected, reason: a packet of each corpus from its labelled() hits.

    Hits are taken by score, then external_id, while their content and citation fit the rest of the budget (words). A reference
    already in the packet is left out as duplicate, one that doesn't fit as over_budget; later, smaller ones may still fit.
    """
    keys = ["tenant_id", "corpus_id"]
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "external_id", "reference_id")
    best = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    path = F.get_json_object("provenance", "$.path")
    best = best.withColumn("cost", (words(F.col("content")) + citation_words(path)).cast("int"))
    listed = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "reference_id", "cost"))).alias("items"))  # at most 50 entries
    start = F.struct(F.array().cast("array<struct<rank:int,reference_id:string,cost:int,reason:string>>").alias("out"), F.array().cast("array<string>").alias("seen"), F.lit(0).alias("used"))

    def step(acc: Column, x: Column) -> Column:
        reason = F.when(F.array_contains(acc["seen"], x["reference_id"]), "duplicate").when(acc["used"] + x["cost"] > max(0, budget), "over_budget").otherwise("")
        row = F.struct(x["rank"].alias("rank"), x["reference_id"].alias("reference_id"), x["cost"].alias("cost"), reason.alias("reason"))
        took = reason == ""
        return F.struct(
            F.array_append(acc["out"], row).alias("out"), F.when(took, F.array_append(acc["seen"], x["reference_id"])).otherwise(acc["seen"]).alias("seen"), (acc["used"] + F.when(took, x["cost"]).otherwise(0)).alias("used")
        )

    rows = listed.select(*keys, F.inline(F.aggregate("items", start, step, lambda a: a["out"])))
    return rows.select(*keys, F.format_string("candidate-%04d", "rank").alias("candidate_id"), "reference_id", "rank", "cost", (F.col("reason") == "").alias("selected"), "reason")


def describe(corpus: DataFrame) -> DataFrame:
    """Per tenant and corpus: rows, latest and earliest record, external ids, sub kinds."""
    return corpus.groupBy("tenant_id", "corpus_id").agg(
        F.count(F.lit(1)).alias("items"), F.max("recorded_at").alias("latest"), F.min("recorded_at").alias("earliest"), F.count_distinct("external_id").alias("external_ids"),
        F.array_join(F.array_sort(F.collect_set("sub_kind")), ",").alias("sub_kinds"),
    )


def manifest(corpus: DataFrame) -> DataFrame:
    """Per corpus a digest that changes with any row, independent of order: the rows' hashes are added up, so nothing is collected."""
    row = F.sha2(F.concat_ws("\u0000", *(F.coalesce(c, F.lit("")) for c in ("item_id", "external_id", "content_sha256"))), 256)
    part = lambda a: F.sum(F.conv(F.substring(row, a, 12), 16, 10).cast("decimal(20,0)"))
    sums = corpus.groupBy("tenant_id", "corpus_id").agg(F.count(F.lit(1)).alias("items"), *(part(a).alias(f"s{a}") for a in (1, 13, 25, 37)))
    return sums.select("tenant_id", "corpus_id", "items", F.sha2(F.concat_ws("|", "items", "s1", "s13", "s25", "s37"), 256).alias("digest"))


def changed_corpora(before: DataFrame, now: DataFrame) -> DataFrame:
    """tenant_id, corpus_id of the manifests of now whose digest differs from before, or that are new: what has to be projected again."""
    keys = ["tenant_id", "corpus_id", "digest"]
    return now.select(*keys).join(before.select(*keys), keys, "left_anti").select("tenant_id", "corpus_id")


def freshness(rows: DataFrame, dirty: str, projected: str, payload: str) -> Column:
    """Freshness label: a dirty tree wins, then the payload's label, then the projection's, then fresh if dirtiness is known."""
    known = lambda c: F.when(F.col(c).isNotNull() & (F.col(c) != "unknown"), F.col(c))
    return F.when(F.coalesce(F.col(dirty), F.lit(False)), "dirty_working_tree").otherwise(F.coalesce(known(payload), known(projected), F.when(F.col(dirty).isNotNull(), "fresh"), F.lit("unknown")))


def cached_embeddings(cache: DataFrame) -> DataFrame:
    """One cached vector per input and model version: the oldest, then the smallest id. Combined before the shuffle."""
    return cache.groupBy("input_sha256", "embedding_model_version").agg(F.min(F.struct("created_at", "cache_id")).alias("first"), F.count(F.lit(1)).alias("entries")).select(
        "input_sha256", "embedding_model_version", F.col("first.cache_id").alias("cache_id"), "entries"
    )


def embedding_misses(inputs: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Distinct inputs (input_sha256) without a vector of the model version."""
    have = cache.where(F.col("embedding_model_version") == version).select("input_sha256").distinct()
    return inputs.select("input_sha256").distinct().join(have, "input_sha256", "left_anti")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in the JVM."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def top_similar(vectors: DataFrame, query_ids: list[int], k: int) -> DataFrame:
    """query_id, vec_id, similarity, rank: exact search for a stated, small set of queries, which become literals."""
    asked = vectors.where(F.col("vec_id").isin(query_ids)).select("vec_id", "embedding").limit(len(query_ids)).collect()
    qs = F.array(*(F.struct(F.lit(r[0]).alias("query_id"), F.array(*(F.lit(float(x)) for x in r[1])).alias("q")) for r in asked))
    scored = vectors.select("vec_id", "embedding", F.explode(qs).alias("x")).where("x.query_id != vec_id")
    scored = scored.select(F.col("x.query_id").alias("query_id"), "vec_id", F.round(cosine(F.col("x.q"), F.col("embedding")), 6).alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_similar_to(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """query_id, vec_id, similarity, rank: exact search for any number of queries (vec_id, embedding).

    Queries go to the vectors in broadcast blocks of about that number; the k best are taken before the shuffle as well.
    """
    asked = stage(queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "queries")
    blocks = max(1, -(-asked.count() // block))
    number = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    out = None
    for b in range(blocks):
        scored = vectors.select("vec_id", "embedding").join(F.broadcast(asked.where(number == b)), F.col("query_id") != F.col("vec_id"))
        scored = scored.select("query_id", "vec_id", F.round(cosine(F.col("q"), F.col("embedding")), 6).alias("similarity"))
        part = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        out = part if out is None else out.unionByName(part)
    return out
