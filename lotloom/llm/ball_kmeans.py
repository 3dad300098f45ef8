"""Centroid clustering by ball k-means, in whole numbers.

A cluster is a ball: its centroid and the distance of its farthest member. After a round moves the
centroids, a ball can have grown by its centroid's way at most, so only centroids within twice that
radius are its neighbours; half the distance to each neighbour cuts the ball into a stable core and
annuli. A member in the core stays without another look, one in the n-th annulus is compared with the
n nearest neighbours. All of it is exact, since a centroid farther than twice a member's distance
from the member's own can neither win nor tie.

Vectors with the cluster they are in are a table that each round writes anew to the shared folder; the
one before goes when the next is whole. Sums by cluster and component combine before they are
shuffled, and only they (clusters times components) and the radii reach the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

CLUSTERS, ROUNDS, SIZE, SCALE, SEED = 8, 10, 64, 1024, 3
#: Components up to this absolute value keep each squared distance within a long.
FAR = 1 << 17


@dataclass
class Balls:
    """centroids: number by component; radii: bounds of members' distances, None where nothing is known yet."""

    centroids: np.ndarray
    radii: list[int | None]

    def neighbours(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each ball the centroids that its members may be nearer to, nearest first, and their squared distances."""
        out = []
        for own, radius in zip(self.centroids, self.radii, strict=True):
            apart = ((self.centroids - own) ** 2).sum(1)
            near = np.lexsort((np.arange(len(apart)), apart))
            out.append((near, apart[near]) if radius is None else (near[apart[near] <= 4 * radius * radius], apart[near][apart[near] <= 4 * radius * radius]))
        return out


def nearest(vectors: np.ndarray, at: np.ndarray, balls: Balls, near: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each vector, which was in cluster ``at``."""
    cluster = at.astype(np.int64)
    distance = ((vectors - balls.centroids[cluster]) ** 2).sum(1)
    best, least = cluster.copy(), distance.copy()
    for own, (others, apart) in enumerate(near):
        rows = np.flatnonzero(cluster == own)
        annulus = np.searchsorted(apart, 4 * distance[rows], side="right")
        for step, other in enumerate(others.tolist()):
            rows, annulus = rows[annulus > step], annulus[annulus > step]
            if not len(rows):
                break
            if other == own:
                continue
            away = ((vectors[rows] - balls.centroids[other]) ** 2).sum(1)
            better = (away < least[rows]) | (away == least[rows]) & (other < best[rows])
            best[rows[better]], least[rows[better]] = other, away[better]
    return best, least


def assigned(state: DataFrame, balls: Balls) -> DataFrame:
    """``state`` (vec_id, v, cluster, distance) with each vector in its nearest cluster; ties go to the smaller number."""
    near = balls.neighbours()

    def by_batch(batches):
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
            best, least = nearest(v, batch.column("cluster").to_numpy(), balls, near)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(best.astype(np.int32)), pa.array(least)], ["vec_id", "v", "cluster", "distance"])

    return state.mapInArrow(by_batch, "vec_id long, v array<int>, cluster int, distance long")


def moved(state: DataFrame, balls: Balls) -> Balls:
    """Balls around the floored means of what ``state`` has in each cluster; an empty one keeps its centroid."""
    sums = state.select("cluster", "distance", F.posexplode("v")).groupBy("cluster", "pos").agg(F.count("*").alias("n"), F.sum("col").alias("total"), F.max("distance").alias("far")).collect()
    centroids, far = balls.centroids.copy(), [0] * len(balls.radii)
    for r in sums:  # clusters times components
        centroids[r.cluster, r.pos] = r.total // r.n
        far[r.cluster] = r.far
    way = ((centroids - balls.centroids) ** 2).sum(1).tolist()
    return Balls(centroids, [isqrt(f) + isqrt(w) + 2 for f, w in zip(far, way, strict=True)])


def quantised(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """(vec_id, v) of the vectors with exactly ``size`` components, none null or not finite: floor(1024 * x) of each."""
    x = F.col("embedding").cast("array<double>")
    sound = (F.size(x) == size) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) <= FAR), F.lit(False)))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * SCALE).cast("int")).alias("v"))


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, seed: int = SEED) -> DataFrame:
    """One row for each vector of ``vectors`` (vec_id, embedding) that is kept: vec_id, cluster, distance
    (squared), cluster_inertia, inertia and the sha256 of the cluster's final centroid.

    Not kept, and without a row: null vectors, vectors of another length, with a null component, one that is not
    finite or one beyond FAR (its squared distance would not fit a long). Each repeated row counts. Starts are the
    vectors of the ``k`` smallest hashes, with equal hashes in order of their components and null ids last;
    where fewer are kept there are so many clusters. An empty table gives no rows; other columns are not
    read, whatever their names.
    """
    spark = vectors.sparkSession
    scratch.small_batches(spark, 10_000)
    state = scratch.table(quantised(vectors, size).withColumns({"cluster": F.lit(0), "distance": F.lit(0).cast("long")}), "vectors")
    starts = state.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).select("v").collect()
    balls = Balls(np.array([r.v for r in starts], np.int64).reshape(-1, size), [None] * len(starts))
    if not starts:
        return state.select("vec_id", "cluster", "distance", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        before, state = state, scratch.table(assigned(state, balls), "balls")
        scratch.dropped(before)
        balls = moved(state, balls)
    before, state = state, scratch.table(assigned(state, balls).drop("v"), "clusters")
    scratch.dropped(before)
    inertia = {r.cluster: r.total for r in state.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in balls.centroids.tolist()]
    of = F.col("cluster") + 1
    by_cluster = F.array(*[F.lit(inertia.get(c, 0)).cast("long") for c in range(len(names))])
    return state.select("vec_id", "cluster", "distance", F.element_at(by_cluster, of).alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), F.element_at(F.array(*map(F.lit, names)), of).alias("centroid_sha256"))


def op11_ball_kmeans(spark, sf_dir: str) -> DataFrame:
    """All embeddings in 8 clusters."""
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """Plain k-means: every vector meets every centroid in every round."""
    def assignment(r: int) -> str:
        return f"""a{r} as materialized (select rid, vec_id, v, min({{'d': d, 'c': cluster}}) as best from
  (select rid, vec_id, k.v as v, cluster, cast(list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as bigint) as d from kept k, c{r} c) group by all)"""

    steps = []
    for r in range(ROUNDS):
        steps.append(assignment(r))
        steps.append(f"""s{r} as (select c, pos, sum(x) as s, count(*) as n from (select best.c as c, unnest(v) as x, generate_subscripts(v, 1) as pos from a{r}) group by all),
m{r} as (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by pos) as v from s{r} group by c),
c{r + 1} as materialized (select cluster, coalesce(m.v, o.v) as v from c{r} o left join m{r} m on m.c = o.cluster)""")
    steps.append(assignment(ROUNDS))
    chain = ",\n".join(steps)
    return f"""
with kept as materialized (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
  from embeddings where len(embedding) = {SIZE} and len(list_filter(embedding, lambda x: x is not null and not isnan(x) and abs(x) <= {FAR})) = {SIZE}),
c0 as materialized (select row_number() over (order by sha256('{SEED}:' || vec_id) nulls last, v) - 1 as cluster, v from kept
  qualify row_number() over (order by sha256('{SEED}:' || vec_id) nulls last, v) <= {CLUSTERS}),
{chain}
select vec_id, cast(best.c as int) as cluster, best.d as distance, cast(sum(best.d) over (partition by best.c) as bigint) as cluster_inertia,
       cast(sum(best.d) over () as bigint) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{ROUNDS} a join c{ROUNDS} c on c.cluster = a.best.c
"""


ORACLE_SQL = _sql()
