"""op3 and components against brute force."""

import random

import numpy as np

from lotloom.llm import embedding_dedup
from lotloom.llm.components import components


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(500 + k, 501 + k) for k in range(60)] + [(900, 900)] + [(1000, 1001 + k) for k in range(80)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(parent, x) for x in parent if x != 900}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_are_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(260):
        v = rng.normal(size=8)
        for c in range(rng.integers(1, 4)):
            rows.append([len(rows), int(rng.integers(0, 2)) if c else k % 2, (v + rng.normal(size=8) * 0.09 * c).astype(np.float32).tolist()])
    v = rng.normal(size=8)
    for k in range(120):  # a chain, a dense group and a group of copies
        rows.append([len(rows), 0, (v + np.eye(8)[k % 8] * 0.03 * (k // 8)).tolist()])
    rows += [[len(rows) + k, 1, rows[5][2]] for k in range(40)]
    n = len(rows)
    rows += [[n, None, rows[0][2]], [n + 1, 0, None], [n + 2, 0, [0.0] * 8], [n + 3, 0, [float("nan")] * 8], [n + 4, 0, [None, *rows[0][2][1:]]], [n + 5, 0, []], [n + 6, 0, rows[0][2][:4]], [None, 0, rows[0][2]], [n + 7, 1, [float("inf")] + [0.0] * 7]]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, label int, embedding array<float>, kept int").repartition(4)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame, block=50, cell=40).collect()}
    assert len(got) == len(rows)
    x = np.array([r[2] for r in rows[:n]], np.float32).astype(float)
    label = np.array([r[1] for r in rows[:n]])
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    parent = {k: k for k in range(n)}
    for a, b in zip(*np.nonzero(near), strict=True):
        a, b = find(parent, int(a)), find(parent, int(b))
        parent[max(a, b)] = min(a, b)
    for k in range(n):
        r = got[k]
        assert (r.n_links, r.component_id, r.kept) == (near[k].sum(), find(parent, k), find(parent, k) == k)
    for k in (*range(n, n + 8), None):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (0, k, k is not None)
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_large_labels_are_split_level_by_level(spark):
    rng = np.random.default_rng(8)
    hubs = rng.normal(size=(90, 6)) * 4
    rows = [(k, 0 if k % 10 else k % 3, (hubs[k % 90] + rng.normal(size=6) * 0.25).tolist()) for k in range(2600)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    classes = frame.selectExpr("cast(label as long) label", "xxhash64(embedding) h1", "xxhash64(7, embedding) h2", "embedding v")
    cells = embedding_dedup.split_cells(classes, 20, 0.98).collect()
    assert sum(r.home for r in cells) == 2600 and max(r.cell.count(".") for r in cells) >= 2 and len({(r.label, r.cell) for r in cells}) > 64
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(frame, block=64, cell=20).collect()}
    x = np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r[1] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    assert all(got[k] == near[k].sum() - 1 for k in range(2600))
