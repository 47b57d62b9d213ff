"""Centroid clustering of vectors, in exact integers, by weighted deduplication.

Vectors are quantised to integers. Equal ones form one distinct vector with its multiplicity, and Lloyd's rounds run over
the distinct vectors alone: a task assigns its vectors and gives the weighted integer sums of each cluster, whose exact
floors are the next centroids. At the end the distinct vectors' clusters are joined back to the rows. A vector that very
many rows share weighs in the rounds as one row does, and is joined back by a broadcast of such vectors alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, stage

CLUSTERS, ROUNDS, SCALE, WIDTH, SEED = 16, 3, 64, 64, 1
#: Components below this size give squared distances that double precision holds exactly (up to 2**8 components a product).
_EXACT = 2**20
_MOST = 2**63 - 1


def quantised(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """vec_id long, q array<long>: floor(scale * x) of the vectors of `width` finite components; others take no part."""
    x = F.col("x")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.filter(x.isNotNull() & (F.size(x) == width)).filter(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    fits = F.forall(x, lambda v: F.abs(v * scale) < float(2**62))
    q = F.transform(x, lambda v: F.floor(v * scale).cast("long"))
    return rows.select("vec_id", F.when(fits, q).otherwise(F.raise_error(F.lit("a component times the scale is beyond a long")).cast("array<bigint>")).alias("q"))


def seeds(rows: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors whose `seed:vec_id` has the smallest sha256, ascending: a top-k, no sort of the table."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [r["q"] for r in rows.select("q", order.alias("order")).orderBy(F.col("order").asc_nulls_last(), "q").limit(clusters).collect()]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster (the smallest number on a tie) and exact squared distance of each row of integers.

    Products run in double precision while every number in them is an integer below 2**53, else in Python's integers.
    """
    largest = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    if largest < _EXACT and x.shape[1] <= 256:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        far = (c * c).sum(1) - 2 * (a @ c.T)
        k = far.argmin(1)
        return k, (far[np.arange(len(x)), k] + (a * a).sum(1)).astype(np.int64)
    a, c = x.astype(object), centroids.astype(object)
    far = np.stack([((a - row) ** 2).sum(1) for row in c], 1)
    k = np.array([min(range(len(c)), key=row.__getitem__) for row in far], np.int64)
    return k, far[np.arange(len(x)), k]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(centroids: np.ndarray):
    """Weighted sums of the distinct vectors of a partition by cluster: a row for each cluster and component."""
    clusters, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros((clusters, width), object), np.zeros(clusters, object)
        for batch in batches:
            if batch.num_rows:
                x, n = _matrix(batch.column("q")), batch.column("n").to_numpy()
                k, _ = nearest(x, centroids)
                small = int(np.abs(x).max(initial=0)) * int(n.sum()) <= _MOST
                for j in np.unique(k):
                    own = k == j
                    total[j] += n[own] @ x[own] if small else n[own].astype(object) @ x[own].astype(object)
                    weight[j] += int(n[own].sum())
        seen = [j for j in range(clusters) if weight[j]]
        number = pa.decimal128(38, 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(seen, width).astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(seen))),
                pa.array([Decimal(int(v)) for j in seen for v in total[j]], number), pa.array([Decimal(weight[j]) for j in seen for _ in range(width)], number),
            ],
            ["k", "d", "s", "n"],
        )

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                k, far = nearest(_matrix(batch.column("q")), centroids)
                if far.max() > _MOST:
                    raise OverflowError("a squared distance is beyond a long")
                yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("n"), pa.array(k.astype(np.int32)), pa.array(far.astype(np.int64))], ["q", "n", "cluster", "distance"])

    return run


def lloyd(distinct: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS) -> list[list[int]]:
    """Centroids after `rounds` rounds over distinct vectors (q, n): a scan a round, clusters x components sums collected."""
    now = np.array(centroids, np.int64)
    for _ in range(rounds):
        sums = distinct.mapInArrow(_sums(now), "k int, d int, s decimal(38,0), n decimal(38,0)").groupBy("k", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        now = now.copy()
        for r in sums.collect():
            now[r["k"], r["d"]] = int(r["s"]) // int(r["n"])
    return now.tolist()


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, cluster_inertia, inertia) of every row that takes part, and the final centroids.

    vectors: vec_id, embedding; other columns play no part. Null vectors, those of another length and those with a null
    or non-finite component take no part; vectors of zeros do. Repeated rows, and rows that share an id, are rows of their
    own. A row without an id is clustered too, and is a seed only when there are no others left. Fewer rows than clusters
    give fewer centroids, an empty table an empty result. Equal distances go to the smaller number; equal seed hashes
    (repeated ids) to the smaller vector. What doesn't fit a long (components, distances, inertia) is an error.
    """
    spark = vectors.sparkSession
    rows = stage(quantised(vectors, width, scale), "quantised")
    distinct = stage(rows.groupBy("q").agg(F.count("*").alias("n")), "distinct_vectors")
    first = seeds(rows, clusters, seed)
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long"), []
    final = lloyd(distinct, first, rounds)
    known = stage(distinct.mapInArrow(_assigned(np.array(final, np.int64)), "q array<long>, n long, cluster int, distance long"), "assigned")
    weighed = F.sum(F.col("n").cast("decimal(19,0)") * F.col("distance")).cast("long")
    inertia = {r["cluster"]: r["i"] for r in known.groupBy("cluster").agg(weighed.alias("i")).collect()}  # a row for each cluster
    if sum(inertia.values()) > _MOST:
        raise OverflowError("the inertia is beyond a long")
    told = spark.createDataFrame(sorted(inertia.items()), "cluster int, cluster_inertia long")
    joined = hot_join(rows, known, ["q"], "n").select("vec_id", "cluster", "distance")
    return joined.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(inertia.values())).cast("long").alias("inertia")), final


def centroid_digests(centroids: list[list[int]]) -> list[str]:
    """sha256 of each centroid's components, as decimals joined by commas."""
    return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
