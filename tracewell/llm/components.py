"""Connected components of an undirected graph given as a DataFrame of links.

Alternating large-star and small-star rounds, each one aggregation and one join over
the links; every round is written to the shared folder, so lineage stays short and a lost
executor costs a task. No links or components come to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, released

#: More rounds than any graph has needed (they grow with the logarithm of its size).
MAX_ROUNDS = 60


def roots(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """The smallest number of each of n nodes' components, given links a-b (and earlier labels)."""
    labels = np.arange(n, dtype=np.int64) if labels is None else labels
    while len(a):
        x, y = labels[a], labels[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        lo = np.minimum(x, y)
        np.minimum.at(labels, np.maximum(x, y), lo)
        while True:
            up = labels[labels]
            if np.array_equal(up, labels):
                break
            labels = up
    return labels


def contract(batches):
    """Within a batch, links become stars around their smallest node."""
    for batch in batches:
        a, b = (batch.column(i).to_numpy() for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = roots(len(nodes), at[: len(a)], at[len(a) :])
        out = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[root[out]])], ["u", "v"])


def connected_components(links: DataFrame, forest: bool = False) -> DataFrame:
    """(node, component) for every node that has a link; component is its smallest reachable node.

    ``links``: two bigint columns u, v. Loops and repeated links do no harm; an empty table gives no rows. A ``forest`` was contracted by
    the workers that found it and isn't sent through others.
    """
    stars = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    if not forest:
        stars = stars.mapInArrow(lambda batches: released(contract(batches)), "u bigint, v bigint")
    edges = materialise(stars.distinct())  # each edge has u > v
    state = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(least, F.col("u") == F.col("w")).select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        edges = materialise(small.select("e.u", "e.v").filter("u <> v").distinct())
        seen = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("connected components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
