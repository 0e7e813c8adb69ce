"""Centroid clustering of integer vectors with a LAESA pivot table.

A few pivots are chosen once and the distance of every vector to every pivot is stored beside the
vector. By the triangle inequality the greatest difference between a vector's and a centroid's
pivot distances is a lower bound of their distance. In each round a task computes the exact distance
of a vector to the centroid of least bound; only the centroids whose bound does not exceed it survive
and receive exact integer distances. Bounds are loosened by more than the rounding error of the
stored roots, so no centroid is left out wrongly; ties go to the smaller number.

A round is one pass over the stored table. Its sums leave each task pre-aggregated (one row per
cluster and component) and reach the driver as ``k`` x ``dims`` numbers; the driver holds the
centroids, nothing that grows with the rows. Pivots come from the ``PIVOT_SAMPLE`` rows of smallest
hash, each as far as possible from those before: they decide speed only, never results.

Vectors that are null, have another number of components than ``dims``, or hold a null, NaN or
infinite component take no part. Repeated rows and repeated ids count each. A null id comes last
among the first centroids. Fewer vectors than ``k`` give as many centroids as vectors; an empty table
gives no rows. Components beyond 2**27 after scaling end the job with an error, as squared distances
would leave 64 bits. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.llm.shared import stage

DIMS = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
PIVOTS = 8
PIVOT_SAMPLE = 256
GREATEST = 1 << 27
SLACK = 1e-9  # relative; the roots are exact to 1e-15


def whole_numbers(vec: Column, scale: int) -> Column:
    """floor(scale * x) of each component, in double precision."""
    return F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vec: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~odd, F.lit(False))


def matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def roots(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances (not squared) of vectors to a few points, from exact squares."""
    out = np.empty((len(vectors), len(points)))
    for i, p in enumerate(points):
        out[:, i] = np.sqrt(squared(vectors, p).astype(np.float64))
    return out


def squared(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    diff = vectors - points
    return np.einsum("ij,ij->i", diff, diff)


def assign(vectors: np.ndarray, near: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, number of exact distances) by pivot bounds.

    ``near``: stored distances of the vectors to the pivots.
    """
    centre_near = roots(centroids, pivots)
    bound = np.zeros((len(vectors), len(centroids)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(near[:, p, None] - centre_near[None, :, p]), out=bound)
    reach = (near.max(axis=1, initial=0.0)[:, None] + centre_near.max(axis=1, initial=0.0)[None, :] + 1.0) * SLACK
    bound = np.maximum(bound - reach, 0.0) ** 2
    cluster = bound.argmin(axis=1)
    best = squared(vectors, centroids[cluster])
    first = cluster.copy()
    exact = len(vectors)
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= best) & (first != c))
        if not len(rows):
            continue
        exact += len(rows)
        dist = squared(vectors[rows], centroids[c])
        better = (dist < best[rows]) | ((dist == best[rows]) & (c < cluster[rows]))
        best[rows[better]] = dist[better]
        cluster[rows[better]] = c
    return cluster, best, exact


def _with_near(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, dims: int, names: list[str]):
    for batch in batches:
        vectors = matrix(batch.column("__v"), dims)
        if len(vectors) and max(vectors.max(), -vectors.min()) > GREATEST:
            raise ValueError(f"a component is beyond {GREATEST} after scaling")
        near = roots(vectors, pivots)
        stored = pa.FixedSizeListArray.from_arrays(pa.array(near.ravel()), near.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns)), stored], names)


def _sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, pivots: np.ndarray):
    """Sums of a task's vectors by cluster and component, and their numbers."""
    k, dims = centroids.shape
    total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
    for batch in batches:
        vectors = matrix(batch.column("__v"), dims)
        cluster, _, _ = assign(vectors, matrix_of_doubles(batch.column("__near"), len(pivots)), centroids, pivots)
        for c in range(k):
            mine = vectors[cluster == c]
            total[c] += mine.sum(axis=0)
            count[c] += len(mine)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(np.arange(k), dims), pa.int32()),
            pa.array(np.tile(np.arange(dims), k), pa.int32()),
            pa.array(total.ravel(), pa.int64()),
            pa.array(np.repeat(count, dims), pa.int64()),
        ],
        ["cluster", "dim", "total", "n"],
    )


def matrix_of_doubles(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, pivots: np.ndarray):
    for batch in batches:
        vectors = matrix(batch.column("__v"), centroids.shape[1])
        near = matrix_of_doubles(batch.column("__near"), len(pivots))
        cluster, distance, _ = assign(vectors, near, centroids, pivots)
        yield pa.RecordBatch.from_arrays(
            [batch.column("__id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["__id", "cluster", "distance"]
        )


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of a sample, each of greatest distance to the nearest one chosen before."""
    chosen = [0]
    gap = squared(sample, sample[0])
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, squared(sample, sample[chosen[-1]]))
    return sample[chosen]


def smallest_hashes(rows: DataFrame, prefix: str, count: int) -> np.ndarray:
    """Vectors of the ``count`` rows whose ``prefix`` + id has the smallest SHA-256."""
    code = F.sha2(F.concat(F.lit(prefix), F.col("__id").cast("string")), 256)
    first = rows.withColumn("__code", code).orderBy(F.asc_nulls_last("__code"), "__v").limit(count)
    return np.array([r["__v"] for r in first.select("__v").collect()], np.int64)


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    dims: int = DIMS,
    scale: int = SCALE,
    k: int = CLUSTERS,
    rounds: int = ROUNDS,
    prefix: str = "3:",
    pivots: int = PIVOTS,
) -> DataFrame:
    """(``id_col``, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256) per vector.

    Centroids start as the ``k`` vectors whose ``prefix`` + id hashes smallest, in that order.
    """
    spark = vectors.sparkSession
    vec = F.col(f"`{vec_col}`")
    kept = vectors.filter(usable(vec) & (F.size(vec) == dims))
    rows = kept.select(F.col(f"`{id_col}`").alias("__id"), whole_numbers(vec, scale).alias("__v"))
    id_type = rows.schema["__id"].dataType.simpleString()
    names = [id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256"]
    types = [id_type, "int", "long", "long", "long", "array<long>", "string"]
    centroids = smallest_hashes(rows, prefix, k)
    if not len(centroids):
        return spark.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in zip(names, types, strict=True)))
    fixed = choose_pivots(smallest_hashes(rows, "pivot:", PIVOT_SAMPLE), pivots)
    schema = T.StructType([*rows.schema.fields, T.StructField("__near", T.ArrayType(T.DoubleType()))])
    table = stage(rows.mapInArrow(partial(_with_near, pivots=fixed, dims=dims, names=schema.names), schema), "pivot-table")
    for _ in range(rounds):
        parts = table.mapInArrow(partial(_sums, centroids=centroids, pivots=fixed), "cluster int, dim int, total long, n long")
        summed = parts.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        moved = centroids.copy()
        for r in summed:
            if r["n"]:
                moved[r["cluster"], r["dim"]] = r["total"] // r["n"]
        if (moved == centroids).all():  # later rounds would repeat this one
            break
        centroids = moved
    found = stage(
        table.select("__id", "__v", "__near").mapInArrow(
            partial(_assigned, centroids=centroids, pivots=fixed), f"__id {id_type}, cluster int, distance long"
        ),
        "pivot-clusters",
    )
    spread = {r["cluster"]: r["spread"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("spread")).collect()}
    total = sum(spread.values())
    about = [
        (c, spread.get(c, 0), total, v.tolist(), hashlib.sha256(",".join(map(str, v.tolist())).encode()).hexdigest())
        for c, v in enumerate(centroids)
    ]
    facts = spark.createDataFrame(
        about, "__c int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string"
    )
    # one row per centroid: bounded by k
    joined = found.join(F.broadcast(facts), F.col("cluster") == F.col("__c"))
    return joined.select(F.col("__id").alias(id_col), *names[1:])
