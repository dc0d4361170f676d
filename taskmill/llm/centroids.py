"""Centroid clustering in exact integers, with bounds that follow the moving centroids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskmill.llm.common import free_names
from taskmill.scale import discard, stage

CLUSTERS, ROUNDS, COMPONENTS, SCALE, SALT = 40, 5, 64, 256, "2:"
# Centroids are held by the driver and sent to every task, and compared with each other.
MAX_CLUSTERS = 4096
# Below this a product sum of 64 components is exact in a double; above it integers are used.
EXACT_IN_DOUBLE = 1 << 22
# Larger components are refused: a squared distance has to fit a long.
MAX_COMPONENT = 1 << 27
# Bounds are doubles. They are moved by this share of their size, so that rounding never tightens one.
SLACK = 1e-9
VECTORS_AT_ONCE = 1 << 13


@dataclass
class Step:
    """What a task needs to move the bounds of vectors on to new centroids."""

    centroids: np.ndarray
    drift: np.ndarray | None = None
    loosening: np.ndarray | None = None
    half_gap: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        gaps = np.sqrt(_squared(self.centroids, self.centroids).astype(float))
        np.fill_diagonal(gaps, np.inf)
        self.half_gap = gaps.min(axis=1, initial=np.inf) / 2


def _squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all centroids."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT_IN_DOUBLE // 2:
        p, c = points.astype(float), centroids.astype(float)
        return ((p**2).sum(1)[:, None] - 2 * (p @ c.T) + (c**2).sum(1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], axis=1)


def _own(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((points - centroids) ** 2).sum(1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By how much a lower bound of each cluster's vectors falls when the other centroids move.

    A vector x of cluster i lies in the sphere around ``old[i]``. Let centroid j move from p to q, with
    midpoint m. Then |x - p| - |x - q| = 2 (x - m)(q - p) / (|x - p| + |x - q|), and the sum below is at
    least 2 |x - m|, so x comes nearer by no more than |q - p| cos(a), a being the angle at m between x
    and the direction of the move. In the plane through p, q and the sphere's centre the least such angle
    is that of the centre less that under which the sphere is seen: the bound is the full drift only if
    the sphere holds m or lies ahead, and nothing if all of it lies behind.
    """
    k = len(old)
    moved = (new - old).astype(float)
    drift = np.sqrt((moved**2).sum(1))
    middle = (old + new) / 2.0
    result = np.zeros(k)
    for i in range(k):
        if radius[i] < 0:
            continue
        to_centre = old[i] - middle
        far = np.sqrt((to_centre**2).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.clip((to_centre * moved).sum(1) / (far * drift), -1, 1)
            seen = np.clip(radius[i] / far, 0, 1)
        angle = np.maximum(np.arccos(cosine) - np.arcsin(seen) - SLACK, 0)
        bound = drift * np.maximum(np.cos(angle), 0)
        bound = np.where((far <= radius[i] * (1 + SLACK)) | ~np.isfinite(bound), drift, bound)
        bound[drift == 0] = 0
        bound[i] = 0
        result[i] = bound.max(initial=0.0)
    return result * (1 + SLACK) + SLACK


def _assigned(step: Step, points: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, exact: bool):
    """The nearest centroid of every vector; only those whose bounds cross are compared with all."""
    cluster = cluster.copy()
    if step.drift is not None:
        upper = (upper + step.drift[cluster]) * (1 + SLACK) + SLACK
        lower = np.maximum(lower - step.loosening[cluster], 0) * (1 - SLACK)
        bound = np.maximum(lower, step.half_gap[cluster] * (1 - SLACK))
        open_ = np.flatnonzero(upper >= bound)
        upper[open_] = np.sqrt(_own(points[open_], step.centroids[cluster[open_]])) * (1 + SLACK)
        open_ = open_[upper[open_] >= bound[open_]]
    else:
        upper, lower = upper.copy(), lower.copy()
        open_ = np.arange(len(points))
    if len(open_):
        all_ = _squared(points[open_], step.centroids)
        nearest = all_.argmin(axis=1)
        row = np.arange(len(open_))
        cluster[open_] = nearest
        upper[open_] = np.sqrt(all_[row, nearest]) * (1 + SLACK)
        others = all_.astype(float)
        others[row, nearest] = np.inf
        lower[open_] = np.sqrt(others.min(axis=1)) * (1 - SLACK)
    distance = _own(points, step.centroids[cluster]) if exact else np.zeros(len(points), np.int64)
    return cluster, upper, lower, distance, len(open_)


def _points(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)


def _assign(step: Step, names: list[str], exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, VECTORS_AT_ONCE):
                batch = whole.slice(at, VECTORS_AT_ONCE)
                place = [batch.schema.get_field_index(n) for n in names]
                points = _points(batch.column(place[0]))
                old = [batch.column(p).to_numpy(zero_copy_only=False) for p in place[1:4]]
                *found, _ = _assigned(step, points, *old, exact)
                columns = list(batch.columns)
                for p, values, kind in zip(place[1:], found, (pa.int32(), pa.float64(), pa.float64(), pa.int64())):
                    columns[p] = pa.array(values.astype(kind.to_pandas_dtype()), kind)
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch one row for each cluster in it: a task sends on no more than that."""
    for batch in batches:
        points = _points(batch.column(0))
        cluster, upper = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        order = np.argsort(cluster, kind="stable")
        if not len(order):
            continue
        cluster, points, upper = cluster[order], points[order], upper[order]
        begin = np.flatnonzero(np.concatenate([[True], cluster[1:] != cluster[:-1]]))
        sums = np.add.reduceat(points, begin, axis=0)
        yield pa.RecordBatch.from_arrays([
            pa.array(cluster[begin], pa.int32()), pa.array(np.diff([*begin, len(cluster)]), pa.int64()),
            pa.array(np.maximum.reduceat(upper, begin), pa.float64()), pa.array(list(sums), pa.list_(pa.int64())),
        ], ["cluster", "n", "radius", "sums"])


def _means(state: DataFrame, names: list[str], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The new centroids and the radius of each cluster around its old one: one row of sums per cluster and place."""
    points, cluster, upper = (F.col(n) for n in names[:3])
    partial = state.select(points, cluster, upper).mapInArrow(_sums, "cluster int, n long, radius double, sums array<long>")
    per_place = partial.select("cluster", "n", "radius", F.posexplode("sums").alias("place", "part"))
    rows = per_place.groupBy("cluster", "place").agg(
        F.sum("n").alias("n"), F.max("radius").alias("radius"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total")
    ).collect()
    new, radius = centroids.copy(), np.full(len(centroids), -1.0)
    for r in rows:
        new[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
        radius[r["cluster"]] = r["radius"]
    return new, radius


def _kept(vector: Column, components: int) -> Column:
    real = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return vector.isNotNull() & (F.size(vector) == components) & F.forall(vector, real)


def cluster_vectors(
    vectors: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    components: int = COMPONENTS,
    scale: int = SCALE,
    salt: str = SALT,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Nearest-centroid clusters of vectors, in integers, with the same rows however the input is dealt.

    Vectors with exactly ``components`` components, none null or not finite, take part; each component x
    becomes floor(scale * x). The first centroids are the vectors with the smallest SHA-256 of salt and id
    (ties by the vector; vectors without an id come last). Each round gives every vector to the nearest
    centroid (ties: the smaller number) and moves every centroid that has vectors to their componentwise
    floor(sum / count). Then vectors are given out once more. Returns ``vec_id``, the ``keep`` columns,
    ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` and ``centroid_sha256``.

    A vector carries an upper bound of the distance to its centroid and a lower bound of that to any other.
    When centroids move, the first grows by the own centroid's drift; the second falls by what planar
    geometry allows for the cluster's sphere (``loosening``), mostly less than the largest drift. Only
    vectors whose bounds cross are compared with all centroids, in exact integers. A round reads and writes
    the vectors in place, without a shuffle, and sends the driver one sum per cluster and component; state
    is staged each round and the one before is removed.

    Vectors that are null, too short, too long or not numbers are left out. Repeated ids and vectors each
    keep a row. With fewer vectors than ``clusters`` each is a centroid; an empty table gives an empty
    result. Components beyond 2^27 raise an error, since squared distances would not fit a long.
    """
    if not 1 <= clusters <= MAX_CLUSTERS:
        raise ValueError(f"from 1 to {MAX_CLUSTERS} clusters")
    spark = vectors.sparkSession
    names = free_names(vectors, "points", "cluster", "upper", "lower", "distance")
    points, cluster, upper, lower, distance = names
    vector = F.col(f"`{embedding}`")

    def whole(x: Column) -> Column:
        value = F.floor(x.cast("double") * scale)
        return F.when(F.abs(x.cast("double") * scale) <= MAX_COMPONENT, value.cast("int")).otherwise(
            F.raise_error(F.lit(f"a component times {scale} is beyond {MAX_COMPONENT}")).cast("int")
        )

    carried = list(dict.fromkeys((vec_id, *keep)))
    state = stage(vectors.where(_kept(vector, components)).select(
        *[F.col(f"`{c}`") for c in carried], F.transform(vector, whole).alias(points),
        F.lit(0).alias(cluster), F.lit(0.0).alias(upper), F.lit(0.0).alias(lower), F.lit(0).cast("long").alias(distance),
    ), "vectors")
    key = F.sha2(F.concat(F.lit(salt), F.col(f"`{vec_id}`").cast("string")), 256)
    seeds = state.select(key.alias("key"), points).orderBy(F.asc_nulls_last("key"), points).limit(clusters).collect()
    centroids = np.array([r[1] for r in seeds], np.int64).reshape(len(seeds), components)
    step = Step(centroids)
    for r in range(rounds + 1 if len(seeds) else 0):
        before = state
        state = stage(before.mapInArrow(_assign(step, names, r == rounds), before.schema), "vectors")
        if r < rounds:
            new, radius = _means(state, names, step.centroids)
            drift = np.sqrt(((new - step.centroids) ** 2).sum(1).astype(float))
            step = Step(new, drift, loosening(step.centroids, new, radius))
        discard(before)

    sums = state.groupBy(F.col(cluster).alias("cluster")).agg(F.sum(distance).alias("s")).collect()
    total = sum(r["s"] for r in sums)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in step.centroids.tolist()]
    table = spark.createDataFrame(
        [(r["cluster"], r["s"], total, digests[r["cluster"]]) for r in sums],
        "number int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    joined = state.join(F.broadcast(table), F.col(cluster) == F.col("number"))
    new = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return joined.select(
        *[state[f"`{c}`"] for c in carried if c not in new], state[cluster].alias("cluster"),
        state[distance].alias("distance"), table["cluster_inertia"], table["inertia"], table["centroid_sha256"],
    )
