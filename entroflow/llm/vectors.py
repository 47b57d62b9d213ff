"""What the two vector searches share: valid rows, and tasks over (queries, rows) in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and queries that one block holds at most, about.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048


def valid_vectors(vectors: DataFrame, zero: bool, length: int | None = None) -> DataFrame:
    """vec_id long, x array<double> of the rows that take part: an id, and a vector of finite components.

    zero: whether vectors of zeros take part. length: the length that takes part; without it, where lengths differ, the
    most frequent one (the smallest on a tie). Repeated rows of an id and vector count once; ids should tell vectors apart.
    """
    x = F.col("x")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).filter(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0))
    rows = rows.filter(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    if not zero:
        rows = rows.filter(F.exists(x, lambda v: v != 0))
    if length is not None:
        return rows.filter(F.size("x") == length)
    lengths = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("x") == (lengths["n"] if lengths else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array<double> column of one length."""
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def length_of(rows: DataFrame) -> int:
    """The length of the vectors of a table that isn't empty."""
    return rows.select(F.size("x")).first()[0]


def sample(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most `most` rows, those of the smallest hash: the bounded sample that an index is fitted on."""
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toArrow().combine_chunks()
    if not got.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    return got.column("vec_id").to_numpy(), matrix(got.column("x").combine_chunks())


class Best:
    """The best k rows of each query so far, within bounded memory: higher score first, then smaller id."""

    def __init__(self, k: int):
        self.k, self.parts, self.size = k, [], 0

    def add(self, q: np.ndarray, v: np.ndarray, s: np.ndarray) -> None:
        self.parts.append((q, v, s))
        self.size += len(q)
        if self.size > 400_000:
            self.parts = [self.top()]
            self.size = len(self.parts[0][0])

    def top(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not sum(len(p[0]) for p in self.parts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, v, s = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        new = np.append(True, (q[1:] != q[:-1]) | (v[1:] != v[:-1]))
        q, v, s = q[new], v[new], s[new]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = place < self.k
        return q[keep], v[keep], s[keep]


def search_blocks(queries: DataFrame, rows: DataFrame, find: Callable, k: int, dtype: str) -> DataFrame:
    """Run find(queries, floors, rows) on each block: query_id, vec_id, score of the best k by query and partition.

    queries: cell, part, query_id, floor, x. rows: cell, part, vec_id, x. Those of a (cell, part) meet in one task, the
    queries first; the caller keeps the parts small. find(q_ids, q, floors, v_ids, v) yields (query, row, score) arrays.
    """
    left = queries.select("cell", "part", F.lit(0).alias("side"), F.col("query_id").alias("id"), F.col("floor").cast("double").alias("floor"), "x")
    right = rows.select("cell", "part", F.lit(1).alias("side"), F.col("vec_id").alias("id"), F.lit(None).cast("double").alias("floor"), "x")
    both = left.unionByName(right).repartition(F.col("cell"), F.col("part")).sortWithinPartitions("cell", "part", "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, now, qs, vs, held = Best(k), None, [], [], 0

        def finish() -> None:
            if qs and vs:
                q_ids, floors, q = (np.concatenate([x[j] for x in qs]) for j in range(3))
                v_ids, _, v = (np.concatenate([x[j] for x in vs]) for j in range(3))
                for found in find(q_ids, q, floors, v_ids, v):
                    best.add(*found)

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, part, side = (batch.column(c).to_numpy() for c in ("cell", "part", "side"))
            ids, floors, x = batch.column("id").to_numpy(), batch.column("floor").fill_null(-np.inf).to_numpy(zero_copy_only=False), matrix(batch.column("x"))
            cuts = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (side[1:] != side[:-1])))
            for a, b in zip(cuts, np.append(cuts[1:], len(cell))):
                if (cell[a], part[a]) != now:
                    finish()
                    now, qs, vs, held = (cell[a], part[a]), [], [], 0
                (vs if side[a] else qs).append((ids[a:b], floors[a:b], x[a:b]))
                held += (b - a) * bool(side[a])
                if held > 2 * BLOCK_ROWS:  # a part larger than meant is searched as it comes
                    finish()
                    vs, held = [], 0
        finish()
        q, v, s = best.top()
        for a in range(0, len(q), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(q[a : a + 50_000]), pa.array(v[a : a + 50_000]), pa.array(s[a : a + 50_000].astype(np.int64 if dtype == "long" else np.float64))], ["query_id", "vec_id", "score"])

    return both.mapInArrow(run, f"query_id long, vec_id long, score {dtype}")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: each query's best k, higher scores first, ties to the smaller vec_id."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def empty_result(spark: SparkSession, dtype: str) -> DataFrame:
    return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {dtype}")
