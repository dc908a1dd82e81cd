"""Entity graph: build from beliefs, neighbourhoods, chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidex.session import stage


def entity_rows(beliefs: DataFrame) -> DataFrame:
    """belief_id, role, key, label of the subject and the object of each belief.

    Key spaces of subjects and objects never meet, so one name may be two entities.
    """
    clean = lambda c: F.trim(F.regexp_replace(F.lower(c), r"(?U)\s+", " "))
    subject = beliefs.select(F.col("id").alias("belief_id"), F.lit("subject").alias("role"), F.concat(F.lit("subject:"), "subject_normalized").alias("key"), F.col("subject_text").alias("label"))
    obj = beliefs.select(
        F.col("id").alias("belief_id"), F.lit("object").alias("role"),
        F.when(F.col("object_text").isNotNull(), F.concat(F.lit("object:"), clean(F.col("object_text"))))
        .when(F.coalesce("group_object_key", F.lit("")) != "", F.concat_ws(":", F.lit("object"), "predicate", "group_object_key")).alias("key"),
        F.coalesce("object_text", "group_object_key").alias("label"),
    )
    return subject.unionByName(obj).where("key is not null")


def entities(rows: DataFrame) -> DataFrame:
    """key, label, belief_id, mentions: the first belief (by id, subject before object) names an entity."""
    return rows.groupBy("key").agg(
        F.min_by("label", F.struct("belief_id", F.when(F.col("role") == "subject", 0).otherwise(1))).alias("label"),
        F.min("belief_id").alias("belief_id"), F.count(F.lit(1)).alias("mentions"),
    )


def edges(rows: DataFrame, beliefs: DataFrame) -> DataFrame:
    """source, target, kind, belief_id: one edge per pair and predicate, from the first belief."""
    s = rows.where("role = 'subject'").select("belief_id", F.col("key").alias("source"))
    o = rows.where("role = 'object'").select("belief_id", F.col("key").alias("target"))
    b = beliefs.select(F.col("id").alias("belief_id"), F.col("predicate").alias("kind"))
    return s.join(o, "belief_id").join(b, "belief_id").groupBy("source", "target", "kind").agg(F.min("belief_id").alias("belief_id"))


def neighbourhood(links: DataFrame, start: DataFrame, depth: int = 2) -> DataFrame:
    """origin, node, depth: nodes on paths without repeats of one or two steps over undirected links (source, target).

    A node may appear at both depths. Raises for other depths.
    """
    if depth not in (1, 2):
        raise ValueError("depth must be 1 or 2")
    both = links.select(F.col("source").alias("a"), F.col("target").alias("b")).union(links.select("target", "source")).where("a != b").distinct()
    one = start.select(F.col("node").alias("origin")).distinct().join(both, F.col("origin") == F.col("a")).select("origin", F.col("b").alias("node"))
    out = one.select("origin", "node", F.lit(1).alias("depth"))
    if depth == 2:
        two = one.join(both, F.col("node") == F.col("a")).where(F.col("b") != F.col("origin")).select("origin", F.col("b").alias("node")).distinct()
        out = out.unionByName(two.select("origin", "node", F.lit(2).alias("depth")))
    return out


def chain_heads(links: DataFrame, node: str, successor: str, rounds: int = 40) -> DataFrame:
    """node, head: the end of each node's chain of successors, by pointer doubling; nodes on a cycle have no head.

    Rounds grow with the logarithm of the longest chain.
    """
    step = stage(links.select(F.col(node).alias("n"), F.col(successor).alias("h")), "chain")
    for _ in range(rounds):
        nxt = step.select(F.col("n").alias("m"), F.col("h").alias("hh"))
        moved = stage(step.join(nxt, F.col("h") == F.col("m"), "left").select("n", F.coalesce("hh", "h").alias("h"), F.col("hh").isNotNull().alias("moved")), "chain")
        step = moved.select("n", "h")
        if moved.where("moved").isEmpty():
            return step.select(F.col("n").alias(node), F.col("h").alias("head"))
    open_ends = step.join(step.select(F.col("n").alias("m")), F.col("h") == F.col("m"), "left_semi").select("n")
    return step.join(open_ends, "n", "left_anti").select(F.col("n").alias(node), F.col("h").alias("head"))


def preorder(nodes: DataFrame, conversation: str = "conversation_id") -> DataFrame:
    """conversation_id, node, sequence_index of message trees (node, parent, position, has_message) in depth-first order.

    Paths are built level by level as joins, so a tree is never collected: roots are nodes without a known parent, in
    the order of position; only nodes with a message are numbered. Nodes on a cycle come last, by position.
    """
    base = stage(nodes.select(conversation, "node", "parent", "position", "has_message"), "tree")
    known = base.select(conversation, F.col("node").alias("p")).distinct()
    pad = lambda c: F.lpad(c.cast("string"), 10, "0")
    orphan = base.join(known, (base[conversation] == known[conversation]) & (base["parent"] == known["p"]), "left_anti")
    level = stage(orphan.select(conversation, "node", "has_message", pad(F.col("position")).alias("path")), "level")
    done = level
    while True:
        up = level.select(F.col(conversation).alias("c"), F.col("node").alias("p"), F.col("path").alias("up"))
        nxt = base.join(up, (base[conversation] == F.col("c")) & (base["parent"] == F.col("p"))).select(
            conversation, "node", "has_message", F.concat_ws("/", "up", pad(F.col("position"))).alias("path")
        )
        level = stage(nxt, "level")
        if level.isEmpty():
            break
        done = done.unionByName(level)
    rest = base.join(done.select(conversation, "node"), [conversation, "node"], "left_anti").select(conversation, "node", "has_message", F.concat(F.lit("~"), pad(F.col("position"))).alias("path"))
    w = Window.partitionBy(conversation).orderBy("path", "node")
    return done.unionByName(rest).where("has_message").withColumn("sequence_index", (F.row_number().over(w) - 1).cast("int")).select(conversation, "node", "sequence_index")
