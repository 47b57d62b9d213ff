"""Approximate nearest neighbours over balanced posting lists.

Centroids come from balanced k-means on a bounded sample and stay in memory, linked into a neighbourhood graph that is
searched by best-first expansion. Every vector goes to its nearest list, and to further ones if it lies near their
boundary, unless a list it already has is closer to the further centroid. A query visits the lists whose centroid is
within a ratio of the distance to its nearest one; the ratio is the smallest that reaches the wanted recall on some of
the queries, whose neighbours among all rows are known by brute force. Inner products become distances by one added
component, sqrt(M^2 - |x|^2), with M the largest norm.

Neighbouring lists form groups. A task holds a group's rows and takes in the queries that visit any of its lists, each with
the score that it looks for at least: what so many rows of the sample reach that all rows almost surely hold k such. A
query that finds fewer is searched again in all lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage
from .vectors import BLOCK_ROWS, Best, empty_result, length_of, matrix, ranked, sample, valid_vectors

#: Vectors the centroids are fitted on, and for each list at least; vectors a list is meant to hold, lists at most (they
#: are held in memory); lists a vector is in at most. So the sample is of 65,536 vectors at most.
FIT_VECTORS, FIT_OF_LIST, LIST_ROWS, MOST_LISTS, REPLICAS = 20_000, 8, 400, 8192, 3
#: A vector joins lists whose centroid is within this ratio of its nearest one; recall that the visiting ratio is fitted to.
BOUNDARY, RECALL = 1.06, 0.94
#: Neighbours in the centroid graph; candidates kept in its search, over the lists wanted.
DEGREE, BEAM = 24, 1.5
#: Centroids that a search begins at, and that it expands at once.
ENTRIES, WIDE = 64, 4
#: Queries that the visiting ratio is fitted to, by brute force over all rows.
FIT_QUERIES = 200
#: Groups of lists at least where rows suffice, rows of a group (at least; and components, at most, half as many in double precision), queries searched at once.
GROUPS, GROUP_ROWS, GROUP_COMPONENTS, QUERIES = 16, 8192, 1 << 25, 2048


def single_error(width: int) -> float:
    """What a product of two vectors of length 1 at most may err in single precision, amply."""
    return 8 * (width + 4) * float(np.finfo(np.float32).eps)


@dataclass
class Centroids:
    """Centroids, their graph, the largest norm and the ratio that queries visit lists by."""

    points: np.ndarray
    links: np.ndarray
    norm: float
    ratio: float = 2.0
    sample_ids: np.ndarray | None = None
    sample: np.ndarray | None = None

    def __post_init__(self):
        self.half = np.einsum("ij,ij->i", self.points, self.points) / 2

    def _near(self, x: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Half the squared distance between x[rows] and points[at], less half of x's square."""
        parts = [self.half[at[a : a + 20_000]] - np.einsum("ij,ij->i", x[rows[a : a + 20_000]], self.points[at[a : a + 20_000]]) for a in range(0, len(rows), 20_000)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _entry(self) -> np.ndarray:
        return np.unique(np.linspace(0, len(self.points) - 1, min(len(self.points), ENTRIES)).astype(int))

    def search(self, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest `want` centroids found for each row, nearest first: (indices, distances).

        Best-first from fixed entry points: each round expands every row's nearest candidates not yet expanded, until
        all that are kept have been.
        """
        k, n, entry = len(self.points), len(x), self._entry()
        want = min(want, k)
        keep = min(k, max(int(want * BEAM) + 8, len(entry)))
        ids = np.tile(entry, (n, 1))
        near = self.half[entry] - x @ self.points[entry].T
        done, seen = np.zeros(ids.shape, bool), np.zeros((n, k), bool)
        seen[:, entry] = True
        keep = min(keep, int(want * BEAM) + 8)
        live = np.arange(n)
        while len(live):
            if ids.shape[1] > keep:
                at = np.argpartition(near, keep - 1, axis=1)[:, :keep]
                ids, near, done = (np.take_along_axis(y, at, 1) for y in (ids, near, done))
            value = np.where(done[live], np.inf, near[live])
            wide = min(WIDE, value.shape[1])
            at = np.argpartition(value, wide - 1, axis=1)[:, :wide]
            r, c = np.nonzero(np.isfinite(np.take_along_axis(value, at, 1)))
            if not len(r):
                break
            rows, c = live[r], at[r, c]
            done[rows, c] = True
            to = self.links[ids[rows, c]]
            flat = (rows[:, None] * k + to).ravel()
            flat = flat[~seen.ravel()[flat]]
            seen.ravel()[flat] = True
            flat.sort()
            rr, to = np.divmod(flat[np.append(True, flat[1:] != flat[:-1])] if len(flat) else flat, k)
            live = live[np.unique(r)]
            if not len(rr):
                continue
            first = np.searchsorted(rr, np.arange(n))
            place = ids.shape[1] + np.arange(len(rr)) - first[rr]
            more = int(place.max()) + 1 - ids.shape[1]
            ids, near, done = (np.concatenate([y, np.full((n, more), fill, y.dtype)], axis=1) for y, fill in ((ids, 0), (near, np.inf), (done, True)))
            ids[rr, place], near[rr, place], done[rr, place] = to, self._near(x, rr, to), False
        order = np.argsort(near, axis=1, kind="stable")[:, :want]
        square = 2 * np.take_along_axis(near, order, 1) + np.einsum("ij,ij->i", x, x)[:, None]
        return np.take_along_axis(ids, order, 1), np.sqrt(np.maximum(square, 0))

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - np.einsum("ij,ij->i", x, x), 0))
        return np.column_stack([x, more])

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Queries at the vectors' scale: a query's length doesn't change its order of candidates."""
        length = np.sqrt(np.einsum("ij,ij->i", x, x))
        return self.lift(x * (self.norm / np.where(length > 0, length, 1))[:, None], True)

    def lists_of(self, x: np.ndarray) -> list[np.ndarray]:
        """Lists of each vector: the nearest, and near ones that no list already chosen is closer to."""
        at, far = self.search(self.lift(x, False), 4 * REPLICAS)
        own = self.points[at]
        square = 2 * self.half[at]
        gaps = np.sqrt(np.maximum(square[:, :, None] + square[:, None] - 2 * (own @ own.transpose(0, 2, 1)), 0))
        chosen = np.zeros(at.shape, bool)
        chosen[:, 0] = True
        for j in range(1, at.shape[1]):
            clear = ((gaps[:, :j, j] > far[:, j, None] * 0.9) | ~chosen[:, :j]).all(1)
            chosen[:, j] = clear & (far[:, j] <= BOUNDARY * far[:, 0]) & (chosen.sum(1) < REPLICAS)
        return np.split(at[chosen], np.cumsum(chosen.sum(1))[:-1])

    def visits(self, x: np.ndarray, ratio: float | None = None) -> list[np.ndarray]:
        """Lists that each query visits: from its nearest centroid the graph is followed through all that are within the ratio."""
        k, ratio = len(self.points), self.ratio if ratio is None else ratio
        if np.isinf(ratio):
            return [np.arange(k)] * len(x)
        x = self.scaled(x)
        at, _ = self.search(x, 1)
        square = np.einsum("ij,ij->i", x, x)
        near, done = np.full((len(x), k), np.inf), np.zeros((len(x), k), bool)
        every = np.arange(len(x))
        near[every, at[:, 0]] = self._near(x, every, at[:, 0])
        while True:
            limit = (np.maximum(2 * near.min(1) + square, 0) * ratio**2 - square) / 2 + 1e-12 * square
            r, c = np.nonzero((near <= limit[:, None]) & ~done)
            if not len(r):
                return [np.flatnonzero(x) for x in near <= limit[:, None]]
            done[r, c] = True
            flat = (r[:, None] * k + self.links[c]).ravel()
            flat = flat[np.isinf(near.ravel()[flat])]
            reached = np.zeros(len(x) * k, bool)
            reached[flat] = True
            rr, to = np.divmod(np.flatnonzero(reached), k)
            near[rr, to] = self._near(x, rr, to)

    def floors(self, ids: np.ndarray, x: np.ndarray, place: int) -> np.ndarray:
        """The score that so many rows of the sample reach, besides the query's own row; less by what single precision may err."""
        out = np.full(len(x), -np.inf)
        if len(self.sample_ids) > place:
            own = np.minimum(np.searchsorted(self.sample_ids, ids), len(self.sample_ids) - 1)
            mine = self.sample_ids[own] == ids
            length = np.sqrt((x * x).sum(1))
            small = (x / np.where(length > 0, length, 1)[:, None]).astype(np.float32)
            for a in range(0, len(x), 64):
                s = small[a : a + 64] @ self.sample.T
                at = np.flatnonzero(mine[a : a + 64])
                s[at, own[a + at]] = -np.inf
                s.partition(len(self.sample_ids) - place, axis=1)
                out[a : a + 64] = s[:, -place]
            out = (out - single_error(x.shape[1])) * length * self.norm
        return np.where(np.isnan(out), -np.inf, out)


def _balanced(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means whose distances grow with a cluster's size, so that lists come out of like size.

    Lifted vectors are all of one length, and so are the centroids here: a mean of few vectors would otherwise be
    longer than one of many, and farther from everything.
    """
    rng = np.random.default_rng(1)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    penalty, spread, length = np.zeros(k), float(x.var(0).sum()) + 1e-12, float(np.sqrt((x[0] ** 2).sum()))
    for _ in range(rounds):
        owner = np.concatenate([np.argmin((c * c).sum(1) - 2 * x[a : a + 2048] @ c.T + penalty, 1) for a in range(0, len(x), 2048)])
        size = np.bincount(owner, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, owner, x)
        far = np.sqrt((sums**2).sum(1))[:, None]
        c = np.where((size[:, None] > 0) & (far > 0), sums * (length / np.maximum(far, 1e-300)), x[rng.choice(len(x), k)])
        penalty += 0.02 * spread * np.clip(size * k / len(x) - 1, -1, 2)
    return c


def fit(rows: DataFrame, asked: DataFrame, total: int, k: int) -> Centroids:
    """Centroids from a bounded sample, and the visiting ratio that reaches RECALL on some queries over all rows."""
    ids, x = sample(rows, max(FIT_VECTORS, FIT_OF_LIST * min(MOST_LISTS, total // LIST_ROWS)))
    x = x.astype(float)
    norm = float(rows.agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))).first()[0]) ** 0.5
    out = fit_sample(x, norm, total)
    out.sample_ids, first = np.unique(ids, return_index=True)
    out.sample = (x[first] / norm).astype(np.float32)
    # Chosen by another hash: the centroids lie nearer to the rows that they are fitted on than to others.
    got = asked.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(FIT_QUERIES).toArrow().combine_chunks()
    if got.num_rows:
        q = matrix(got.column("x").combine_chunks()).astype(float)
        out.ratio = _ratio(out, q, *_truth(rows, got.column("vec_id").to_numpy(), q, k))
    return out


def fit_sample(x: np.ndarray, norm: float, total: int) -> Centroids:
    """Centroids and their graph from a sample at hand, with the largest norm and the number of all vectors."""
    lists = max(1, min(MOST_LISTS, total // LIST_ROWS, len(x) // FIT_OF_LIST))
    start = Centroids(np.zeros((1, x.shape[1] + 1)), np.zeros((1, 1), int), norm)
    points = _balanced(start.lift(x, False), lists)
    half = (points * points).sum(1) / 2
    near = []
    for a in range(0, lists, 512):
        gap = half - points[a : a + 512] @ points.T
        gap[np.arange(len(gap)), a + np.arange(len(gap))] = -np.inf
        near.append(np.argsort(gap, axis=1, kind="stable")[:, 1 : DEGREE + 1])
    near = np.concatenate(near)
    chain = np.stack([(np.arange(lists) + 1) % lists, (np.arange(lists) - 1) % lists], axis=1)  # keeps the graph in one piece
    return Centroids(points, np.concatenate([near, chain], axis=1).astype(int), norm)


def _truth(rows: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The true neighbours of some queries among all rows: places of the queries, and vectors."""
    shared = rows.sparkSession.sparkContext.broadcast((q_ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (q_ids, q), best = shared.value, Best(k)
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("vec_id").to_numpy()
                s = q @ matrix(batch.column("x")).astype(float).T
                s[q_ids[:, None] == ids[None]] = -np.inf
                at = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(q), 1))
                r, c = np.repeat(np.arange(len(q)), at.shape[1]), at.ravel()
                own = np.isfinite(s[r, c])
                best.add(r[own], ids[c[own]], s[r[own], c[own]])
        own = best.top()
        yield pa.RecordBatch.from_arrays([pa.array(own[0].astype(np.int64)), pa.array(own[1].astype(np.int64)), pa.array(own[2].astype(float))], ["query_id", "vec_id", "score"])

    found = ranked(rows.mapInArrow(run, "query_id long, vec_id long, score double"), k).select("query_id", "vec_id")
    got = rows.join(F.broadcast(found), "vec_id").select("query_id", "x").toArrow().combine_chunks()
    return got.column("query_id").to_numpy(), matrix(got.column("x").combine_chunks()).astype(float) if got.num_rows else np.zeros((0, q.shape[1]))


def _ratio(model: Centroids, q: np.ndarray, at: np.ndarray, found: np.ndarray) -> float:
    """The ratio of distances within which RECALL of the neighbours found[i] of q[at[i]] have a list."""
    if not len(at):
        return 1.0
    x = model.scaled(q)
    far = np.sqrt(np.maximum(2 * (model.half - x @ model.points.T) + (x * x).sum(1)[:, None], 0))
    far /= np.maximum(far.min(1, keepdims=True), 1e-12)
    needed = np.array([far[i, own].min() for i, own in zip(at, model.lists_of(found))])
    return float(np.quantile(needed, RECALL, method="higher")) * (1 + 1e-6)


def _groups(points: np.ndarray, groups: int) -> np.ndarray:
    """A group for each list: centroids are parted at the middle of the direction they spread most in, until there are so many."""
    points, parts = np.where(np.isfinite(points), points, 0), [np.arange(len(points))]
    while len(parts) < min(groups, len(points)):
        at = parts.pop(max(range(len(parts)), key=lambda i: len(parts[i])))
        x = points[at] - points[at].mean(0)
        order = at[np.argsort(x @ np.linalg.svd(x, full_matrices=False)[2][0], kind="stable")]
        parts += [order[: len(at) // 2], order[len(at) // 2 :]]
    out = np.zeros(len(points), np.int64)
    for g, at in enumerate(parts):
        out[at] = g
    return out


def _deal(shared, place: int | None = None, ratio: float | None = None):
    """Each vector once for each group that it has lists in; queries (a place in the sample is given) with their floors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, group = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                ids, x = part.column("vec_id").to_numpy(), matrix(part.column("x")).astype(float)
                lists = own.lists_of(x) if place is None else own.visits(x, ratio)
                floors = np.full(len(x), -np.inf) if place is None else own.floors(ids, x, place)
                at, cell = np.repeat(np.arange(len(lists)), [len(y) for y in lists]), np.concatenate(lists)
                order = np.lexsort((cell, group[cell], at))
                at, cell = at[order], cell[order]
                new = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (group[cell[1:]] != group[cell[:-1]])))
                cells = pa.ListArray.from_arrays(pa.array(np.append(new, len(cell)).astype(np.int32)), pa.array(cell.astype(np.int32)))
                rows = pa.array(at[new])
                yield pa.RecordBatch.from_arrays([part.column("vec_id").take(rows), pa.array(group[cell[new]].astype(np.int32)), cells, pa.array(floors[at[new]]), part.column("x").take(rows)], ["vec_id", "group", "cells", "floor", "x"])

    return run


class _Rows:
    """A group's rows, sorted by list."""

    def __init__(self, parts: list[tuple], norm: float):
        ids, cells, lengths, x = (np.concatenate([p[j] for p in parts]) for j in range(4))
        at = np.repeat(np.arange(len(ids)), lengths)
        order = np.argsort(cells, kind="stable")
        self.at, cells = at[order], cells[order]
        self.names, first = np.unique(cells, return_index=True)
        self.ends = np.append(first, len(cells))
        self.ids, self.x = ids, x
        # Single-precision vectors serve as they are, where products can neither overflow nor vanish.
        self.norm, self.scaled = (1.0, x) if x.dtype == np.float32 and 1e-9 < norm < 1e9 else (norm, (x / norm).astype(np.float32))
        self.slack = single_error(x.shape[1]) * norm / self.norm

    def find(self, q_ids: np.ndarray, floors: np.ndarray, cells: np.ndarray, lengths: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple]:
        """The best k of each query among the lists it visits, as (queries, rows, scores).

        Products in single precision leave out what lies below a query's floor for certain; the others are scored in
        double precision, each by itself, so that a score doesn't depend on the block.
        """
        q = q.astype(float)
        length = np.sqrt((q * q).sum(1))
        small = (q / length[:, None]).astype(np.float32)
        floors, best, pending, held = floors.copy(), Best(k + 2), [], 0

        def settle() -> None:
            for i, j in pending:
                for a in range(0, len(i), 50_000):
                    r, c = i[a : a + 50_000], j[a : a + 50_000]
                    s = (q[r] * self.x[c]).sum(axis=1)
                    keep = s >= floors[r]
                    best.add(r[keep], self.ids[c[keep]], s[keep])
            r, c, s = best.top()
            best.parts, best.size = [(r, c, s)], len(r)
            last = np.flatnonzero(np.append(r[1:] != r[:-1], True)) if len(r) else np.zeros(0, int)
            full = last[np.bincount(r, minlength=len(q))[r[last]] >= k + 2] if len(r) else last
            floors[r[full]] = np.maximum(floors[r[full]], s[full])

        own = np.repeat(np.arange(len(q)), lengths)
        order = np.argsort(cells, kind="stable")
        own, cells = own[order], cells[order]
        cuts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(cells))):
            place = int(np.searchsorted(self.names, cells[a]))
            if place == len(self.names) or self.names[place] != cells[a]:
                continue
            for e in range(self.ends[place], self.ends[place + 1], BLOCK_ROWS):
                rows = self.at[e : min(e + BLOCK_ROWS, self.ends[place + 1])]
                v = self.scaled[rows]
                for d in range(a, b, 256):
                    r = own[d : min(d + 256, b)]
                    least = (floors[r] / (length[r] * self.norm) - self.slack).astype(np.float32)
                    least[np.isnan(least)] = -np.inf  # squares beyond double precision
                    i, j = np.divmod(np.flatnonzero((small[r] @ v.T >= least[:, None]).ravel()), len(rows))
                    i, j = r[i], rows[j]
                    other = q_ids[i] != self.ids[j]
                    pending.append((i[other], j[other]))
                    held += len(i)
                    if held > 200_000:
                        settle()
                        pending, held = [], 0
        settle()
        r, c, s = best.top()
        yield q_ids[r], c, s


def _search(queries: DataFrame, rows: DataFrame, norm: float, k: int) -> DataFrame:
    """query_id, vec_id, score: each query's best k of a group's part. Rows of a (group, part) come before its queries."""
    both = rows.withColumn("side", F.lit(0)).unionByName(queries.withColumn("side", F.lit(1)))
    both = both.repartition(F.col("group"), F.col("part")).sortWithinPartitions("group", "part", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, held, waiting, count = None, [], None, [], 0

        def search() -> Iterator[pa.RecordBatch]:
            if held is not None and waiting:
                ids, cells, lengths, x, floors = (np.concatenate([w[j] for w in waiting]) for j in range(5))
                for q, v, s in held.find(ids, floors, cells, lengths, x, k):
                    for a in range(0, len(q), 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(y[a : a + 50_000]) for y in (q.astype(np.int64), v.astype(np.int64), s.astype(float))], ["query_id", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            group, part, side = (batch.column(c).to_numpy() for c in ("group", "part", "side"))
            cuts = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (part[1:] != part[:-1]) | (side[1:] != side[:-1])))
            for a, b in zip(cuts, np.append(cuts[1:], len(group))):
                if (group[a], part[a]) != now:
                    yield from search()
                    now, parts, held, waiting, count = (group[a], part[a]), [], None, [], 0
                for e in range(a, b, QUERIES):
                    own = batch.slice(e, min(QUERIES, b - e))
                    cells = own.column("cells")
                    got = own.column("vec_id").to_numpy(), cells.flatten().to_numpy(), np.diff(cells.offsets.to_numpy()), matrix(own.column("x")), own.column("floor").to_numpy()
                    if not side[a]:
                        parts.append(got)
                        continue
                    if parts:
                        held = _Rows(parts, norm)
                        parts.clear()
                    waiting.append(got)
                    count += own.num_rows
                    if count >= QUERIES:
                        yield from search()
                        waiting, count = [], 0
        yield from search()

    return both.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame | None = None, k: int = 20) -> DataFrame:
    """Each query's k rows of largest inner product found: query_id, rank, vec_id, score.

    vectors, queries: vec_id, embedding (queries default to all vectors); a query isn't its own neighbour. Vectors that
    are null, zero or hold null or non-finite components take no part, nor do queries of another length than the vectors;
    see valid_vectors() for lengths and repeats. Scores are inner products in double precision of the vectors as they are;
    ties go to the smaller vec_id, however many there are. Where the largest component is beyond what squares can hold
    (2**300, or 2**30 in single precision; or below their inverses) all are searched scaled by a power of two and scores scaled
    back, to infinity if need be; a vector that vanishes beside such ones takes no part. A query that finds fewer than k others in its lists, or fewer
    of the score that it looks for, is searched in all lists, so it gets k rows if there are as many. Without vectors the
    result is empty. Other columns play no part.
    """
    single = lambda df: isinstance(df.schema["embedding"].dataType, T.ArrayType) and isinstance(df.schema["embedding"].dataType.elementType, T.FloatType)
    # Single-precision vectors are kept as they are: half the bytes.
    kind = "float" if single(vectors) and (queries is None or single(queries)) else "double"
    valid = lambda df, *more: df_cast(valid_vectors(df, False, *more), kind)
    rows = stage(valid(vectors), "vectors")
    total = rows.count()
    if not total:
        return empty_result(vectors.sparkSession, "double")
    width = length_of(rows)
    asked = rows if queries is None else stage(valid(queries, width), "queries")
    largest = lambda df: df.agg(F.max(F.array_max(F.transform("x", lambda v: F.abs(v.cast("double")))))).first()[0] or 0.0
    room = (2.0**-30, 2.0**30) if kind == "float" else (2.0**-300, 2.0**300)
    # Components whose squares overflow, or vanish, are brought to about 1 by a power of two.
    factor = lambda top: 1.0 if not top or room[0] < top < room[1] else 2.0 ** -int(np.frexp(top)[1])
    factors = [factor(largest(rows))] * 2 if queries is None else [factor(largest(df)) for df in (rows, asked)]
    if factors != [1.0, 1.0]:
        grown = lambda df, by: stage(df.withColumn("x", F.transform("x", lambda v: (v.cast("double") * by).cast(kind))).filter(F.exists("x", lambda v: v != 0)), "scaled")
        rows = grown(rows, factors[0])
        asked = rows if queries is None else grown(asked, factors[1])
        total = rows.count()
        return _nearest(rows, asked, total, width, k, kind).withColumn("score", F.col("score") / factors[0] / factors[1])
    return _nearest(rows, asked, total, width, k, kind)


def _nearest(rows: DataFrame, asked: DataFrame, total: int, width: int, k: int, kind: str) -> DataFrame:
    model = fit(rows, asked, total, k)
    most = int(min(max(total * REPLICAS / GROUPS, GROUP_ROWS), max(GROUP_COMPONENTS // width // (1 if kind == "float" else 2), 1)))
    group = _groups(model.points, -(-total * REPLICAS // most))
    shared = rows.sparkSession.sparkContext.broadcast((model, group))  # at most MOST_LISTS centroids and the sample
    dealt = f"vec_id long, group int, cells array<int>, floor double, x array<{kind}>"
    listed = stage(rows.mapInArrow(_deal(shared), dealt), "lists")
    # A group of many more rows than meant is dealt over several parts; every query that visits it comes to all of them.
    sizes = F.broadcast(stage(listed.groupBy("group").agg(F.ceil(F.count("*") / (1.5 * most)).cast("int").alias("parts")), "group_sizes"))
    dealt_rows = listed.join(sizes, "group").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int")).drop("parts")

    def search(asked: DataFrame, place: int, ratio: float | None = None) -> DataFrame:
        visits = asked.mapInArrow(_deal(shared, place, ratio), dealt).join(sizes, "group")
        visits = visits.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return ranked(_search(visits, dealt_rows, model.norm, k), k)

    # Of 1.2 k rows so many are in the sample on average; a few more, and nearly every query has k rows of that score.
    mean = 1.2 * k * len(model.sample_ids) / total
    found = stage(search(asked, min(k, int(np.ceil(mean + 2.5 * mean**0.5 + 2)))), "found")
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k).select(F.col("query_id").alias("vec_id"))
    short = stage(asked.join(full, "vec_id", "left_anti"), "short")
    if short.isEmpty():
        return found
    every = search(short, k, float("inf"))
    return found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(every)


def df_cast(rows: DataFrame, kind: str) -> DataFrame:
    return rows.withColumn("x", F.col("x").cast(f"array<{kind}>"))
