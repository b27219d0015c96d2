"""Embedding near-duplicates by overlapping clusters.

Equal vectors of a label are one class. Classes are dealt to the clusters of several nearest centroids; within a cluster all pairs are
compared in blocks, by their cosine in double precision, so every cluster that holds a pair finds it and the one that owns it counts it
for both. An audit compares a sample
of each label with all vectors; labels whose recall is too low are dealt to more clusters, and at last compared whole.

Defined results: vectors that are null, zero or hold null or non-finite components, and vectors without a label, link with nothing
and are components of their own; vectors of different lengths don't link; rows that repeat a vec_id count as vectors each; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components, roots

#: Vectors of a cluster on average; vectors of a label that centroids are fitted on at most; centroids of a label at most.
CLUSTER, SAMPLE, CENTROIDS = 500, 8192, 4096
#: Rows and columns of a block of a cluster's pairs; pairs of a block handled at once.
SHARD, COLUMNS, PAIRS_AT_ONCE = 512, 4096, 65536
#: Clusters that a vector is dealt to, tried in turn until the audit is content; labels that never pass are compared in pairs of chunks of WHOLE.
OVERLAPS, ENOUGH, WHOLE = (3, 6, 12), 0.95, 4096
#: Classes audited of all, and of each label that has several clusters.
AUDITED, AUDITED_PART = 512, 64


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k unit centroids of unit vectors."""
    c = x[np.random.default_rng(7).permutation(len(x))[:k]]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(size > 0, sums / np.maximum(size, 1e-30), c)
    return c


def nearest(sims: np.ndarray, k: int) -> np.ndarray:
    k = min(k, sims.shape[1])
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, 1), axis=1, kind="stable"), 1)


def prune(x: np.ndarray, near: np.ndarray, dist: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each row's candidates, sorted by distance, those that no kept one is alpha times closer to; -1 fills the rest."""
    n, k = near.shape
    out = np.full((n, degree), -1, np.int64)
    for lo in range(0, n, 256):
        c = x[near[lo : lo + 256]]
        between = 1 - c @ c.transpose(0, 2, 1)
        d, open_ = dist[lo : lo + 256], np.ones((len(c), k), bool)
        rows = np.arange(len(c))
        for slot in range(degree):
            pick = np.where(open_.any(1), open_.argmax(1), -1)
            live = pick >= 0
            if not live.any():
                break
            r, p = rows[live], pick[live]
            out[lo + r, slot] = near[lo + r, p]
            open_[r] &= alpha * between[r, p] > d[r]
            open_[r, p] = False
    return out


def links_of_cluster(ids: np.ndarray, weights: np.ndarray, x64: np.ndarray, clusters: np.ndarray, own: int, least: float):
    """(u, v, n): for each class of a cluster the root of its found component, and the vectors that it links to in pairs owned here.

    A pair that several clusters hold is counted by the one with the smallest number.
    """
    y = unit(x64)
    n, counts = len(ids), np.zeros(len(ids), np.int64)
    labels = np.arange(n)
    step = max(1, min(PAIRS_AT_ONCE, (1 << 24) // clusters.shape[1] ** 2))
    for lo in range(0, n, SHARD):
        for left in range(lo, n, COLUMNS):
            a, b = np.nonzero(y[lo : lo + SHARD] @ y[left : left + COLUMNS].T >= least)
            a, b = a + lo, b + left
            a, b = a[a < b], b[a < b]
            for k in range(0, len(a), step):
                i, j = a[k : k + step], b[k : k + step]
                labels = roots(n, i, j, labels)
                common = np.where((clusters[i][:, :, None] == clusters[j][:, None, :]).any(2), clusters[i], np.iinfo(np.int32).max).min(1)
                i, j = i[common == own], j[common == own]
                counts += (np.bincount(i, weights[j], n) + np.bincount(j, weights[i], n)).astype(np.int64)
    keep = (counts > 0) | (labels != np.arange(n))
    return ids[keep], ids[labels[keep]], counts[keep]


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the vectors that can link."""
    good = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    return vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(good)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def fit_centroids(classes: DataFrame) -> dict[str, np.ndarray]:
    """Centroids of each group that is larger than a cluster, fitted on a bounded sample."""
    sizes = {r.part: r.n for r in classes.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") > CLUSTER).collect()}
    if not sizes:
        return {}
    rate = F.create_map(*[F.lit(v) for g, n in sizes.items() for v in (g, int(min(1, SAMPLE / n) * (1 << 30)))])
    pick = F.pmod(F.xxhash64("rep", F.lit("sample")), F.lit(1 << 30))
    rows = classes.filter(F.col("part").isin(list(sizes))).filter(pick < rate[F.col("part")]).select("part", "embedding").collect()
    found = {}
    for g, n in sizes.items():
        x = np.array([r.embedding for r in rows if r.part == g], np.float64)
        found[g] = centroids(unit(x), min(CENTROIDS, -(-n // CLUSTER), len(x)))
    return found


def deal(classes: DataFrame, centres: dict[str, np.ndarray], overlap: int) -> DataFrame:
    """Classes in each of the clusters that they are near to: (g, cluster, clusters, rep, n, embedding), g naming group and cluster."""

    def run(batches):
        for batch in batches:
            parts, x = np.array(batch.column(0).to_pylist()), batch.column(3)
            near = [[0]] * len(parts)
            for g in np.unique(parts):
                if g in centres:
                    at = np.flatnonzero(parts == g)
                    got = nearest(unit(_matrix(x.take(pa.array(at)))) @ centres[g].T, overlap)
                    for i, row in zip(at, np.sort(got, axis=1).tolist(), strict=True):
                        near[i] = row
            at = pa.array(np.repeat(np.arange(len(parts)), [len(r) for r in near]))
            cluster = pa.array([c for r in near for c in r], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), cluster, pa.array(near, pa.list_(pa.int32())).take(at), *(batch.column(k).take(at) for k in (1, 2, 3))], ["part", "cluster", "clusters", "rep", "n", "embedding"]
            )

    kind = classes.schema["embedding"].dataType.simpleString()
    dealt = classes.select("part", "rep", "n", "embedding").mapInArrow(run, f"part string, cluster int, clusters array<int>, rep bigint, n bigint, embedding {kind}")
    return dealt.withColumn("g", F.xxhash64("part", "cluster"))


def deal_whole(classes: DataFrame) -> DataFrame:
    """Classes in every pair of chunks of their group that has their own, as ``deal`` gives them: any two of a group meet."""
    sizes = classes.groupBy("part").agg(F.ceil(F.count("*") / WHOLE).cast("int").alias("chunks")).withColumnRenamed("part", "p")
    met = classes.join(sizes, F.col("part") == F.col("p")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    number = lambda x: F.least("own", x) * F.col("chunks") + F.greatest("own", x)
    met = met.withColumn("clusters", F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), number)).withColumn("cluster", F.explode("clusters"))
    return met.select("part", "cluster", "clusters", "rep", "n", "embedding").withColumn("g", F.xxhash64("part", "cluster"))


def found_links(dealt: DataFrame, least: float) -> DataFrame:
    """(u, v, n) of every cluster; see links_of_cluster."""

    def solve(rows: list[pa.RecordBatch]):
        t = pa.Table.from_batches(rows).combine_chunks()
        clusters = _matrix(t["clusters"].combine_chunks()).astype(np.int32)
        u, v, n = links_of_cluster(t["rep"].to_numpy(), t["n"].to_numpy(), _matrix(t["embedding"].combine_chunks()), clusters, t["cluster"][0].as_py(), least)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(n)], ["u", "v", "n"])

    def run(batches):
        held = []
        for batch in batches:
            g = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
            for lo, hi in zip(cuts, cuts[1:]):  # noqa: B905
                if hi == lo:
                    continue
                if held and held[0].column(0)[0].as_py() != g[lo]:
                    yield solve(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield solve(held)

    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt.select("g", "cluster", "clusters", "rep", "n", "embedding").repartition(parts, "g").sortWithinPartitions("g")
    return rows.mapInArrow(run, "u bigint, v bigint, n bigint")


def near_duplicates(vectors: DataFrame, least: float = 0.93, overlaps: tuple[int, ...] = OVERLAPS) -> tuple[DataFrame, float]:
    """((vec_id, n_links, component_id, kept) of every row, the audit's lowest recall of a label)."""
    base = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding")
    some = valid(base).withColumn("part", F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string")))
    classes = materialise(some.groupBy("part", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    centres = fit_centroids(classes)
    pending, settled, recalls = classes, None, {}
    for overlap in (*overlaps, None):
        links = materialise(found_links(deal_whole(pending) if overlap is None else deal(pending, centres, overlap), least))
        comps = connected_components(links.select("u", "v"))
        sums = links.groupBy("u").agg(F.sum("n").alias("linked"))
        found = pending.join(sums, F.col("rep") == F.col("u"), "left").join(comps, F.col("rep") == F.col("node"), "left")
        found = found.select(
            "part", "embedding", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
        )
        found = materialise(found)
        recalls |= audit(some, found, least, list(centres))
        missed = [g for g, r in recalls.items() if r < ENOUGH]
        if overlap is None and missed:
            raise RuntimeError(f"links are missing after all pairs were compared: {missed[:5]}")
        settled_now = found.filter(~F.col("part").isin(missed)) if missed else found
        settled = settled_now if settled is None else settled.unionByName(settled_now)
        if not missed:
            break
        pending = pending.filter(F.col("part").isin(missed))
    placed, recall = settled, min(recalls.values(), default=1.0)
    part = F.when(F.col("label").isNotNull() & F.col("embedding").isNotNull(), F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string")))
    result = base.withColumn("p", part).join(
        placed.withColumnRenamed("embedding", "e"), (F.col("p") == F.col("part")) & (F.col("embedding") == F.col("e")), "left"
    )
    component = F.coalesce("component_id", "vec_id")
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept")), recall


def audit(some: DataFrame, placed: DataFrame, least: float, large: list[str], sample: int = AUDITED) -> dict[str, float]:
    """The mean recall of links of each group's audited classes, compared with all vectors by brute force in blocks.

    About ``sample`` classes of all are picked by a hash, and AUDITED_PART of each of the ``large`` groups, so none of these goes unseen.
    """
    rate = F.lit(sample) / F.lit(max(1, placed.count()))
    if large:
        sizes = placed.filter(F.col("part").isin(large)).groupBy("part").agg(F.count("*").alias("m")).withColumnRenamed("part", "p")
        placed = placed.join(F.broadcast(sizes), F.col("part") == F.col("p"), "left")
        rate = F.greatest(rate, F.lit(AUDITED_PART) / F.col("m"))
    pick = F.pmod(F.xxhash64("embedding", F.lit("audit")), F.lit(1 << 30)) < F.least(rate, F.lit(1.0)) * (1 << 30)
    queries = placed.filter(pick).select("part", "embedding", "n_links").collect()
    if not queries:
        return {}
    places: dict[str, list[int]] = {}
    for k, r in enumerate(queries):
        places.setdefault(r.part, []).append(k)
    groups = {g: (np.array(at, np.int64), unit(np.array([queries[k].embedding for k in at], np.float64))) for g, at in places.items()}

    def run(batches):
        for batch in batches:
            parts = np.array(batch.column(0).to_pylist())
            at, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for g in np.unique(parts):
                if g in groups:
                    y = unit(_matrix(batch.column(1).take(pa.array(np.flatnonzero(parts == g)))))
                    at.append(groups[g][0])
                    n.append((groups[g][1] @ y.T >= least).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), pa.array(np.concatenate(n))], ["at", "n"])

    true = dict(some.select("part", "embedding").mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n") - 1).collect())
    shares = {g: [queries[k].n_links / true[k] for k in at if true[k]] for g, at in places.items()}
    return {g: float(np.mean(s)) if s else 1.0 for g, s in shares.items()}
