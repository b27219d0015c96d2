"""Scopes and runs form forests: closures over (node, parent), and what a node inherits from its ancestors.

Chains may be of any length; in a cycle every node is an ancestor of every other, and none is a root.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialise


def _links(nodes: DataFrame) -> DataFrame:
    """(node, up) of nodes that have a parent other than themselves."""
    return nodes.filter(F.col("parent").isNotNull() & ~F.col("parent").eqNullSafe(F.col("node"))).select("node", F.col("parent").alias("up")).distinct()


def ancestors(nodes: DataFrame) -> DataFrame:
    """(node, ancestor, depth) of (node, parent) rows, each node being its own ancestor at depth 0.

    Pointer doubling: each round joins the paths of one length with themselves, so depth d takes log d joins on the node key; it ends when a round finds no
    pair that wasn't there. Each round is written to shared storage, as the next one reads it more than once. The result has a row for each pair, so
    ask for ``roots`` or ``inherit`` where these suffice.
    """
    jumps, length, size = _links(nodes), 1, -1
    closure = materialise(nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")).distinct())
    while (now := closure.count()) != size and not jumps.isEmpty():
        size = now
        step = jumps.withColumnsRenamed({"node": "at", "up": "further"})
        longer = closure.join(step, F.col("ancestor") == F.col("at")).select("node", F.col("further").alias("ancestor"), (F.col("depth") + length).alias("depth"))
        closure = materialise(closure.unionByName(longer).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")))
        jumps = materialise(jumps.join(step, F.col("up") == F.col("at")).select("node", F.col("further").alias("up")).distinct())
        length *= 2
    return closure


def _jump(nodes: DataFrame, value: str) -> DataFrame:
    """(node, value): the node's value, else the nearest ancestor's, by pointer jumping: a row a node, log depth joins, and no closure.

    A node that is done leaves the rounds. Nodes that are left after as many rounds as the longest chain can need hang on a cycle without a value.
    """
    known = materialise(nodes.groupBy("node").agg(F.first(value, ignorenulls=True).alias("value"), F.max("parent").alias("up")))
    known = known.withColumn("up", F.when(F.col("value").isNull() & ~F.col("up").eqNullSafe(F.col("node")), F.col("up")))
    open_, done = known.filter("value IS NULL AND up IS NOT NULL"), known.filter("value IS NOT NULL OR up IS NULL").select("node", "value")
    state, rounds = known, known.count().bit_length() + 1
    for _ in range(rounds):
        if open_.isEmpty():
            break
        above = state.select(F.col("node").alias("at"), F.col("value").alias("held"), F.col("up").alias("further"))
        moved = materialise(open_.join(above, F.col("up") == F.col("at"), "left").select("node", F.col("held").alias("value"), F.col("further").alias("up")))
        settled = moved.filter("value IS NOT NULL OR up IS NULL")
        open_ = moved.filter("value IS NULL AND up IS NOT NULL")
        done = done.unionByName(settled.select("node", "value"))
        state = done.withColumn("up", F.lit(None).cast(known.schema["up"].dataType)).unionByName(open_)
    return done.unionByName(open_.select("node", "value"))


def inherit(nodes: DataFrame, value: str) -> DataFrame:
    """(node, value): each node's own value, else its nearest ancestor's; null if none has one."""
    return _jump(nodes, value).withColumnRenamed("value", value)


def inherited(nodes: DataFrame, value: str) -> DataFrame:
    """(node, value): the nearest ancestor's value, a node's own left aside."""
    above = inherit(nodes, value).withColumnsRenamed({"node": "at", value: "held"})
    return nodes.select("node", "parent").join(above, (F.col("parent") == F.col("at")) & (F.col("parent") != F.col("node")), "left").select("node", F.col("held").alias(value))


def roots(nodes: DataFrame) -> DataFrame:
    """(node, root): the ancestor without a parent; a parent that has no row of its own is one too. Nodes on a cycle, or below one, have none."""
    missing = _links(nodes).select(F.col("up").alias("node")).distinct().join(nodes.select("node").distinct(), "node", "left_anti")
    both = nodes.select("node", "parent").unionByName(missing.withColumn("parent", F.lit(None).cast(nodes.schema["parent"].dataType)))
    top = F.when(F.col("parent").isNull() | (F.col("parent") == F.col("node")), F.col("node"))
    return inherit(both.withColumn("root", top), "root").join(nodes.select("node").distinct(), "node", "left_semi")
