"""Exact top-k search by a dual tree of cover trees.

The tree's top is a cover by pivots: those of the first level are chosen farthest-first from a bounded sample, and cells
of many rows are parted by pivots of their own, level by level, so that cells stay as small however many rows there
are. Rows stand in the cell of their nearest pivot, large cells in parts. Below, a task builds a cover tree (balls of
half the radius at each level) of a part's rows and of a group's queries, and walks both together. A pair of nodes is
left out if its largest possible inner product, from the centres and covering radii, is below the worst kth score of
the query group. The first round searches each group's own cell for such scores; the second goes down the levels and
searches only the cells that they leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stage
from .vectors import BLOCK_QUERIES, Best, empty_result, length_of, matrix, ranked, sample, search_blocks, valid_vectors

#: Rows that the first level's pivots are drawn from, rows a cell is meant to hold, pivots of that level at most, rows of a
#: part and queries of a group at most.
FIT_VECTORS, CELL_ROWS, MOST_PIVOTS, PART_ROWS, GROUP_QUERIES = 8192, 2048, 256, 4096, 256
#: Cells of more rows than this are parted again, into so many at most; rows of a leaf.
SPLIT_ROWS, FAN, LEAF = 8192, 64, 48
#: Rounds of parting; cells that are still large after them stay so.
LEVELS = 8


class Node:
    """A ball of a cover tree: its centre, the radius that covers its rows, and its children or, in a leaf, its rows."""

    __slots__ = ("center", "children", "length", "radius", "rows")

    def __init__(self, x: np.ndarray, rows: np.ndarray):
        self.center = x[rows[0]]
        far = np.sqrt(((x[rows] - self.center) ** 2).sum(1))
        self.radius, self.length = float(far.max()) * (1 + 1e-9), float(np.sqrt((self.center**2).sum())) * (1 + 1e-9)
        self.rows, self.children = rows, []
        if len(rows) <= LEAF or self.radius == 0:
            return
        left, balls = rows, []
        while len(left):
            inside = ((x[left] - x[left[0]]) ** 2).sum(1) <= (self.radius / 2) ** 2
            balls.append(left[inside])
            left = left[~inside]
            if len(balls) > max(4, len(rows) // 8):  # half the radius holds hardly any other row: no use in parting
                return
        self.children = [Node(x, b) for b in balls]


def _products(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Inner products of rows of integers (held as doubles), exact; largest: a bound of any sum on the way."""
    if largest < 2**53:
        return a @ b.T
    if largest < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object)
    return whole(a) @ whole(b).T


def _longs(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object and any(not -(2**63) < int(x) < 2**63 for x in scores):
        raise OverflowError("a score doesn't fit a long: components are too large")
    return scores.astype(np.int64)


def _walk(k: int):
    def find(q_ids, q, floors, v_ids, v):
        # Bounds are held as doubles, lowered by more than their rounding; the scores themselves are exact integers.
        lower = lambda x: x - np.abs(np.where(np.isfinite(x), x, 0)) * 2.0**-51
        worst = lower(floors)
        best = Best(k)
        largest = float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1]
        kept = np.full((len(q), k), -np.inf)
        todo = [(Node(q, np.arange(len(q))), Node(v, np.arange(len(v))))]
        while todo:
            a, b = todo.pop()
            most = float(a.center @ b.center) + a.radius * b.length + b.radius * a.length + a.radius * b.radius
            if most * (1 + 1e-9 * np.sign(most)) + 1e-9 < worst[a.rows].min():
                continue
            if a.children or b.children:
                # The wider ball is parted; of the other's pairs the most promising is walked first.
                if a.children and (not b.children or a.radius >= b.radius):
                    todo += [(x, b) for x in a.children]
                else:
                    todo += sorted(((a, x) for x in b.children), key=lambda p: float(a.center @ p[1].center))
                continue
            exact = _products(q[a.rows], v[b.rows], largest)
            s = exact.astype(float)
            s[q_ids[a.rows][:, None] == v_ids[b.rows][None]] = -np.inf
            r, c = np.nonzero((s >= worst[a.rows][:, None]) & np.isfinite(s))
            best.add(q_ids[a.rows[r]], v_ids[b.rows[c]], _longs(exact[r, c]))
            kept[a.rows] = -np.partition(-np.concatenate([kept[a.rows], s], 1), k - 1, axis=1)[:, :k]
            worst[a.rows] = np.maximum(worst[a.rows], lower(kept[a.rows].min(1)))
        yield best.top()

    return find


def _cells(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                x = matrix(part.column("x"))
                far = np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T, 0)
                cell = far.argmin(1)
                dist = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("x"), pa.array(cell.astype(np.int64)), pa.array(dist)], ["vec_id", "x", "cell", "far"])

    return run


def _pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each next pivot is the row farthest from all before."""
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def _nearest_pivot(q_ids, q, floors, v_ids, v):
    """For search_blocks(): the nearest of the pivots v to each row q."""
    far = ((v * v).sum(1) - 2 * q @ v.T).argmin(1)
    yield q_ids, v_ids[far], -((q - v[far]) ** 2).sum(1)


def _distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)) * (1 + 1e-9)


def _parted(rows: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Rows (vec_id, x, cell, far) after their large cells are parted, and the new cells: node, parent, centre; None if no cell is large.

    A cell's pivots are its rows of smallest hash in each of so many classes. Cells whose rows are all alike stay whole.
    """
    large = stage(rows.groupBy("cell").agg(F.count("*").alias("rows"), F.max("far").alias("radius")).filter((F.col("rows") > SPLIT_ROWS) & (F.col("radius") > 0)).select("cell", "rows"), "large_cells")
    if large.isEmpty():
        return None
    fan = F.greatest(F.lit(2), F.least(F.lit(FAN), F.ceil(F.col("rows") / CELL_ROWS))).cast("long")
    mine = rows.join(small(large), "cell").withColumn("j", F.pmod(F.xxhash64(F.lit("pivot"), "vec_id"), fan))
    new = stage(mine.groupBy("cell", "j").agg(F.min_by("x", F.struct(F.xxhash64("vec_id"), F.col("vec_id"))).alias("centre")).select((F.lit(MOST_PIVOTS) + F.col("cell") * FAN + F.col("j")).alias("node"), F.col("cell").alias("parent"), "centre"), "pivots")
    parts = F.ceil(F.col("rows") / BLOCK_QUERIES).cast("long")
    asks = mine.select("cell", F.pmod(F.xxhash64("vec_id"), parts).alias("part"), F.col("vec_id").alias("query_id"), F.lit(None).alias("floor"), "x")
    offers = new.join(large, F.col("parent") == F.col("cell")).select("cell", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.col("node").alias("vec_id"), F.col("centre").alias("x"))
    found = search_blocks(asks, offers, _nearest_pivot, 1, "double").select(F.col("query_id").alias("vec_id"), F.col("vec_id").alias("node"))
    moved = mine.select("vec_id", "x").join(found, "vec_id").join(small(new), "node").select("vec_id", "x", F.col("node").alias("cell"), _distance("x", "centre").alias("far"))
    rest = rows.join(small(large), "cell", "left_anti").select("vec_id", "x", "cell", "far")
    return stage(rest.unionByName(moved), "cells"), new


def top_k(vectors: DataFrame, queries: DataFrame | None = None, k: int = 5, scale: int = 256) -> DataFrame:
    """Each query's k highest integer inner products over all other rows: query_id, rank, vec_id, score.

    Components become floor(scale * component). Vectors that are null or hold null or non-finite components take no part
    (vectors of zeros do), nor do queries of another length than the vectors; see valid_vectors() for lengths and repeats.
    Ties go to the smaller vec_id, however many there are. Scores are exact; one that doesn't fit a long is an error.
    Without vectors the result is empty, with fewer than k others it has as many. Other columns play no part.
    """
    spark = vectors.sparkSession
    scaled = lambda v: F.when(F.abs(scale * v) < 2.0**52, F.floor(scale * v).cast("double")).otherwise(scale * v)
    whole = lambda df, length: valid_vectors(df, True, length).select("vec_id", F.transform("x", scaled).alias("x"))
    rows = stage(whole(vectors, None), "int_vectors")
    total = rows.count()
    if not total:
        return empty_result(spark, "long")
    asked = rows if queries is None else stage(whole(queries, length_of(rows)), "int_queries")
    _, x = sample(rows, FIT_VECTORS)
    pivots = _pivots(x, max(1, min(MOST_PIVOTS, total // CELL_ROWS)))
    shared = spark.sparkContext.broadcast(pivots)  # at most MOST_PIVOTS rows
    placed = "vec_id long, x array<double>, cell long, far double"
    rows, asked = (stage(df.mapInArrow(_cells(shared), placed), "cells") for df in (rows, asked))
    centres = spark.createDataFrame([(i, None, p.tolist()) for i, p in enumerate(pivots)], "node long, parent long, centre array<double>")
    nodes = [centres]
    while len(nodes) < LEVELS and (got := _parted(rows)):
        rows = got[0]
        nodes.append(got[1])

    def dealt(df: DataFrame, most: int, name: str) -> DataFrame:
        """Parts of cells of about `most` rows."""
        sizes = small(stage(df.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("long").alias("parts")), "cell_sizes"))
        return stage(df.join(sizes, "cell").withColumn(name, F.pmod(F.xxhash64("vec_id"), F.col("parts"))).drop("parts"), name)

    rows, asked = dealt(rows, PART_ROWS, "chunk"), dealt(asked, GROUP_QUERIES, "group")
    chunks = stage(rows.groupBy("cell", "chunk").agg(F.max("far").alias("radius")), "chunks")
    groups = asked.groupBy("cell", "group").agg(F.max("far").alias("radius"))

    # First round: each group in the first part of its own cell, or of the first cell that this one was parted into.
    home = asked.select("cell", F.col("group").alias("part"), F.col("vec_id").alias("query_id"), F.lit(None).alias("floor"), "x")
    top = _top(F.col("cell"))
    hosts = chunks.groupBy(top.alias("top")).agg(F.min("cell").alias("host"))
    per_cell = small(stage(groups.groupBy("cell").agg(F.max("group").alias("last")).join(hosts, F.col("cell") == F.col("top")), "homes"))
    near = rows.filter("chunk = 0").withColumnRenamed("cell", "from").join(per_cell, F.col("from") == F.col("host")).select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("part"), "vec_id", "x")
    first = stage(search_blocks(home, near, _walk(k), k, "long"), "first_round")
    floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") >= k).select("query_id", "floor")
    known = stage(asked.withColumnRenamed("vec_id", "query_id").join(floors, "query_id", "left"), "floors")

    # Second round: pairs of a group and a part that the covering radii don't rule out, from the first level's cells
    # downwards; blocks of the query set meet blocks of the rows by the blocks' numbers.
    described = known.groupBy("cell", "group").agg(F.max("far").alias("r"), F.min(F.coalesce("floor", F.lit(float("-inf")))).alias("worst"))
    described = described.join(F.broadcast(centres), F.col("cell") == F.col("node")).select("cell", "group", "r", "worst", F.col("centre").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    size = lambda a: F.sqrt(dot(a, a))
    most = dot("q", "centre") + F.col("r") * size("centre") + F.col("radius") * size("q") + F.col("r") * F.col("radius")
    may = most + F.abs(most) * 1e-9 + 1 >= F.col("worst")
    leaves = chunks.groupBy(F.col("cell").alias("node")).agg(F.max("radius").alias("radius"))
    tree = _radii(nodes, leaves, dot)
    pairs = described.withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(pivots) - 1).cast("long")))).join(F.broadcast(tree[0]), "node").filter(may)
    ends = pairs
    for level in tree[1:]:
        pairs = stage(pairs.select("cell", "group", "r", "worst", "q", F.col("node").alias("parent")), "open_nodes")
        pairs = pairs.join(small(level), "parent").filter(may)
        ends = ends.unionByName(pairs.select(ends.columns))
    meet = ends.select("cell", "group", "r", "worst", "q", "centre", F.col("node").alias("other")).join(chunks.withColumnRenamed("cell", "other"), "other")
    done = (F.col("chunk") == 0) & (F.col("other") == F.col("host"))
    open_pairs = meet.join(small(stage(hosts, "hosts")), F.col("cell") == F.col("top"), "left").filter(may & ~F.coalesce(done, F.lit(False)))
    open_pairs = stage(open_pairs.select("cell", "group", "other", "chunk"), "open_pairs")
    number = F.xxhash64("chunk", F.pmod(F.xxhash64("from", "group"), F.col("bundles"))).alias("part")
    # Groups that meet a part are dealt to bundles, so that neither side of a task grows with the table.
    bundles = open_pairs.groupBy("other", "chunk").agg(F.ceil(F.count("*") / 8).cast("long").alias("bundles"))
    pairs = open_pairs.withColumnRenamed("cell", "from").join(bundles, ["other", "chunk"])
    left = known.withColumnRenamed("cell", "from").join(pairs, ["from", "group"]).select(F.col("other").alias("cell"), number, "query_id", "floor", "x")
    spread = bundles.withColumnRenamed("other", "cell").withColumn("bundle", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bundles") - 1)))
    right = rows.join(spread, ["cell", "chunk"]).select("cell", F.xxhash64("chunk", "bundle").alias("part"), "vec_id", "x")
    second = search_blocks(left, right, _walk(k), k, "long")
    return ranked(first.unionByName(second), k)


def _top(cell: Column) -> Column:
    """The first-level cell that a cell lies in."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), cell, lambda c, _: F.when(c >= MOST_PIVOTS, F.floor((c - MOST_PIVOTS) / FAN)).otherwise(c))


def _radii(nodes: list[DataFrame], leaves: DataFrame, dot) -> list[DataFrame]:
    """Each level's nodes with a covering radius of all that lies below: a leaf's own, else the farthest child's reach."""
    out, below = [], None
    for level in reversed(nodes):
        own = level.join(leaves, "node", "left")
        if below is not None:
            reach = below.select("parent", F.col("centre").alias("c"), F.col("radius").alias("b")).join(level.select(F.col("node").alias("parent"), F.col("centre").alias("p")), "parent")
            reach = reach.groupBy(F.col("parent").alias("node")).agg(F.max(_distance("c", "p") + F.col("b")).alias("reach"))
            own = own.join(reach, "node", "left").withColumn("radius", F.greatest("radius", "reach")).drop("reach")
        below = stage(own.filter("radius is not null"), "tree_level")
        out.append(below)
    return out[::-1]
