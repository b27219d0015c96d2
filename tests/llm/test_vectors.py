import numpy as np
import pytest

from tracewell.llm import vectors as V
from tracewell.llm.queries import op9_vectors


def brute_force(rows, least=0.93):
    """vec_id -> (n_links, component_id)."""
    ok = {i: (lab, np.array(e, np.float64)) for i, e, lab in rows if lab is not None and e and all(v is not None and np.isfinite(v) for v in e) and any(e)}
    comp, links = {i: i for i, _, _ in rows}, {i: set() for i, _, _ in rows}
    ids = sorted(ok)
    for i in ids:
        for j in ids:
            (a, x), (b, y) = ok[i], ok[j]
            if i != j and a == b and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                links[i].add(j)
    for i in sorted(links):
        todo = [i]
        while todo:
            k = todo.pop()
            for j in links[k]:
                if comp[j] > comp[i]:
                    comp[j] = comp[i]
                    todo.append(j)
    return {i: (len(links[i]), comp[i]) for i in comp}


def test_small_table_is_exact(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = op9_vectors(spark, sf).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute_force(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1),
            (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [], 1), (13, [0.0, 1.0], 1)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, part string")
    got, _ = V.near_duplicates(frame)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == brute_force(rows)
    assert V.near_duplicates(frame.limit(0))[0].count() == 0


def test_recall_over_clusters_and_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr(V, "CLUSTER", 120)
    monkeypatch.setattr(V, "SHARD", 64)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 24))
    rows = []
    for k, b in enumerate(base):
        for _ in range(int(rng.integers(1, 5)) if k else 150):
            rows.append((len(rows), (b + rng.normal(size=24) * (0.15 if k % 3 else 0.0)).astype(np.float32).tolist(), int(k % 2)))
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got, recall = V.near_duplicates(frame)
    want = brute_force(rows)
    found = {r.vec_id: r.n_links for r in got.collect()}
    assert all(found[i] <= want[i][0] for i in found)
    assert sum(found.values()) >= 0.98 * sum(n for n, _ in want.values()) and recall >= 0.95


def test_pruning_keeps_directions():
    x = V.unit(np.random.default_rng(1).normal(size=(40, 5)))
    sims = x @ x.T
    np.fill_diagonal(sims, -np.inf)
    near = V.nearest(sims, 20)
    kept = V.prune(x, near, 1 - np.take_along_axis(sims, near, 1), 8, 1.2)
    for p, row in enumerate(kept):
        row = row[row >= 0]
        assert row[0] == near[p, 0]
        for k, b in enumerate(row):
            assert all(1.2 * (1 - x[a] @ x[b]) > 1 - x[p] @ x[b] - 1e-12 for a in row[:k])


def test_a_crowd_around_one_vector_is_found_once_each():
    rng = np.random.default_rng(2)
    x = np.concatenate([V.unit(rng.normal(size=(1, 64)) + rng.normal(size=(700, 64)) * 0.03), V.unit(rng.normal(size=(300, 64)))])
    ids = np.arange(len(x))
    u, v, n = V.links_of_cluster(ids, np.ones(len(x), np.int64), x, np.zeros((len(x), 1), np.int32), 0, 0.93)
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    found = np.zeros(len(x), int)
    found[u] = n
    assert (found <= near.sum(1)).all() and found.sum() >= 0.99 * near.sum()


def test_links_of_clusters_are_whole_for_both_vectors(monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([V.unit(rng.normal(size=(1, 64)) + rng.normal(size=(400, 64)) * s) for s in (0.2, 0.25, 0.27, 0.3, 0.32)])
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    weights, clusters = rng.integers(1, 4, len(x)), np.sort(np.argsort(rng.random((len(x), 4)), axis=1)[:, :3], axis=1).astype(np.int32)
    monkeypatch.setattr(V, "COLUMNS", 700)
    found = np.zeros(len(x), int)
    for own in range(4):  # any two vectors share two clusters at least
        at = np.flatnonzero((clusters == own).any(1))
        u, _, n = V.links_of_cluster(at, weights[at], x[at], clusters[at], own, 0.93)
        np.add.at(found, u, n)
    assert near.any() and (found == near @ weights).all()


def test_a_label_that_misses_links_is_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(V, "CLUSTER", 8)
    monkeypatch.setattr(V, "WHOLE", 50)
    monkeypatch.setattr(V, "ENOUGH", 1.0)
    monkeypatch.setattr(V, "AUDITED_PART", 1000)
    rng = np.random.default_rng(6)
    crowd = V.unit(rng.normal(size=(1, 16))) + rng.normal(size=(300, 16)) * 0.02
    small = np.concatenate([b + rng.normal(size=(4, 16)) * 0.2 for b in rng.normal(size=(60, 1, 16))])
    rows = [(i, v.tolist(), label) for i, (v, label) in enumerate([*((v, 1) for v in crowd), *((v, 2) for v in small)])]
    got, recall = V.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), overlaps=(1,))
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == brute_force(rows) and recall == 1.0
