"""op11 against plain k-means in Python's whole numbers."""

import hashlib
import math

import numpy as np

from lotloom.llm import ball_kmeans

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, k=8, rounds=10, size=64):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(x) <= 1 << 17 for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, at, strict=True) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at = assign()
    total = [sum(d for d, c in at if c == n) for n in range(len(centroids))]
    return sorted((str(i), c, d, total[c], sum(total), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, at, strict=True))


def told(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_equal_to_plain_k_means(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(5, 64))
    rows = [(k, (middles[k % 5] + rng.normal(size=64) * (0.1 if k % 3 else 1)).astype(np.float32).tolist(), 1) for k in range(300)]
    rows += [(7, rows[7][1], 1), (7, rows[8][1], 2), (None, rows[9][1], None), *((400 + k, rows[3][1], 1) for k in range(40))]  # repeated ids, a null id, copies that tie
    odd = [None, [], [0.5] * 63, [0.5] * 65, [0.5] * 63 + [None], [0.5] * 63 + [float("nan")], [float("inf")] + [0.5] * 63, [2.0**18] + [0.0] * 63]
    rows += [(500 + k, v, 1) for k, v in enumerate(odd)] + [(600, [0.0] * 64, 1), (601, [-0.0001] * 64, 1), (602, [131072.0] + [0.0] * 63, 1)]
    got = ball_kmeans.clustered(spark.createDataFrame(rows, SCHEMA))
    assert told(got) == plain(rows)
    assert got.schema.simpleString() == "struct<vec_id:bigint,cluster:int,distance:bigint,cluster_inertia:bigint,inertia:bigint,centroid_sha256:string>"


def test_few_none_and_clashing_columns(spark):
    rows = [(k, [float(k)] * 64, 1) for k in range(3)] + [(5, [1.0] * 64, 1)] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    assert told(ball_kmeans.clustered(df)) == plain(rows)
    clash = df.selectExpr("*", "'a' as v", "7 as cluster", "label as distance", "1 as pos", "2 as far", "'x' as inertia")
    assert told(ball_kmeans.clustered(clash)) == plain(rows)
    assert ball_kmeans.clustered(df.limit(0)).count() == 0
    two = spark.createDataFrame([(k, [float(k % 7), -float(k % 3)], 1) for k in range(50)], SCHEMA)
    assert told(ball_kmeans.clustered(two, k=4, rounds=3, size=2)) == plain([tuple(r) for r in two.collect()], 4, 3, 2)


def test_only_relevant_neighbours_are_met():
    """Two far pairs of centroids: the other pair is never a neighbour, and a core is left alone."""
    balls = ball_kmeans.Balls(np.array([[0, 0], [100, 0], [9000, 0], [9100, 0]]), [80, 80, 80, None])
    near = balls.neighbours()
    assert [n.tolist() for n, _ in near] == [[0, 1], [1, 0], [2, 3], [3, 2, 1, 0]]
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(-50, 50, (200, 2)) + [x, 0] for x in (0, 100, 9000, 9100)])
    at = np.repeat([0, 1, 2, 3], 200)
    best, least = ball_kmeans.nearest(v, at, balls, near)
    every = ((v[:, None, :] - balls.centroids) ** 2).sum(2)
    assert (best == every.argmin(1)).all() and (least == every.min(1)).all()
    assert (best != at).any() and (best == at).any()
