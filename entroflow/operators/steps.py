"""The training steps, each as a plan of its own, and the fused scan that replaces them in a fit.

A row's cluster is a projection over the model, so rows never move; only sums by cluster do. The fused scan shifts its
sums by the current centroids, which keeps their differences exact, and gives everything that an iteration needs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from ..functions.kernels import EPS, array_sum, assign_closest, share


#: Clusters x features beyond which assignment runs in Arrow blocks instead of an expression of literals.
LITERALS = 64
#: Numbers of sums by cluster that a fit may bring to the driver: clusters x (2 features + classes + 1).
MOST_SUMS = 20_000_000
#: Partitions whose sums one task adds up.
_ADDED = 64


@dataclass
class Parameters:
    """Centroids by cluster, feature importances, class probabilities by cluster; features and classes by name."""

    features: list[str] | str
    classes: list
    centroids: list[list[float]]
    importances: list[float]
    probabilities: list[list[float]]
    width: int = field(init=False)

    def __post_init__(self):
        self.width = len(self.importances)

    @property
    def clusters(self) -> int:
        return len(self.centroids)

    def columns(self) -> list[Column]:
        """The features; a single name is an array column."""
        if isinstance(self.features, str):
            return [F.element_at(self.features, d + 1).cast("double") for d in range(self.width)]
        return [F.col(f).cast("double") for f in self.features]

    def change(self, **new) -> Parameters:
        return replace(self, **new)


def label_code(label: str, classes: list) -> Column:
    """0-based class index of a label."""
    code = F.lit(None).cast("int")
    for m, c in enumerate(classes):
        code = F.when(F.col(label) == F.lit(c), m).otherwise(code)
    return code


def distances(p: Parameters, eps_c: float = 0.0, rows: int = 1, label: str | None = None, weight: Column | None = None) -> Column:
    """Array over clusters: weighted squared distance, less the label's log-probability times eps_c / rows."""
    out = []
    for c, probs in zip(p.centroids, p.probabilities):
        if isinstance(p.features, str):  # one expression over the array, however wide
            gaps = F.zip_with(p.features, F.array(*map(F.lit, c)), lambda x, v: (x.cast("double") - v) * (x.cast("double") - v))
            d = array_sum(F.zip_with(gaps, F.array(*map(F.lit, p.importances)), lambda g, w: g * w))
        else:
            d = sum((F.lit(w) * (x - F.lit(v)) * (x - F.lit(v)) for w, x, v in zip(p.importances, p.columns(), c)), F.lit(0.0))
        d = d if weight is None else weight * d
        if eps_c > 0 and label is not None:
            logs = F.array(*(F.lit(math.log(max(v, EPS))) for v in probs))
            d = d - F.lit(eps_c / rows) * F.element_at(logs, label_code(label, p.classes) + 1)
        out.append(d)
    return F.array(*out)


def closest(x: np.ndarray, c: np.ndarray, w_d: np.ndarray, weight: np.ndarray | None = None, told: np.ndarray | None = None) -> np.ndarray:
    """Cluster from 0 of each row, the first on a tie. told: what each row's label takes off each cluster's distance.

    Large models find by products of matrices which clusters can be the closest, and weigh those alone term by term, so
    that rounding in the products decides nothing.
    """
    def scaled(far, rows=slice(None), k=slice(None)):
        far = far if weight is None else far * (weight[rows, None] if far.ndim == 2 else weight[rows])
        return far if told is None else far - told[rows, k]

    if len(c) * len(w_d) <= 4096 or not len(x):
        return scaled(np.stack([((x - row) ** 2) @ w_d for row in c], 1)).argmin(1)
    own, size = (x * x) @ w_d, (c * c) @ w_d
    rough = scaled(own[:, None] + size - 2 * ((x * w_d) @ c.T))
    slack = 1e-13 * (len(w_d) + 8) * (own + size.max()) * (1 if weight is None else weight) + (0 if told is None else 1e-14 * np.abs(told).max(1))
    near = rough <= (rough.min(1) + 2 * slack)[:, None]
    k = near.argmax(1)
    rows = np.flatnonzero(near.sum(1) > 1)
    if len(rows):
        best = np.full(len(rows), np.inf)
        for j in np.flatnonzero(near[rows].any(0)):
            some = np.flatnonzero(near[rows, j])
            far = scaled(((x[rows[some]] - c[j]) ** 2) @ w_d, rows[some], j)
            less = far < best[some]
            best[some[less]], k[rows[some[less]]] = far[less], j
    return k


def vectors_of(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), width)


def codes_of(column: pa.Array, classes: list) -> np.ndarray:
    """0-based class index of each label, -1 where it's none of the classes."""
    return pc.index_in(column, value_set=pa.array(classes, column.type)).fill_null(-1).to_numpy(zero_copy_only=False)


def _x(p: Parameters) -> Column:
    return F.transform(p.features, lambda v: v.cast("double")) if isinstance(p.features, str) else F.array(*p.columns())


def _assigner(df: DataFrame, p: Parameters, eps: float, labelled: bool, weighted: bool):
    """An Arrow function (x, label, weight) to clusters, with the model in a broadcast: a projection, on streams too."""
    model = df.sparkSession.sparkContext.broadcast((np.array(p.centroids, float), np.array(p.importances, float), np.log(np.maximum(np.array(p.probabilities, float), EPS)), p.classes))

    @F.arrow_udf("int")
    def assigned(x: pa.Array, y: pa.Array, w: pa.Array) -> pa.Array:
        c, w_d, logs, classes = model.value
        told = eps * logs[:, codes_of(y, classes)].T if labelled and eps > 0 else None
        weight = w.to_numpy(zero_copy_only=False) if weighted else None
        return pa.array(closest(vectors_of(x, len(w_d)), c, w_d, weight, told).astype(np.int32) + 1)

    return assigned


def assign(df: DataFrame, p: Parameters, eps_c: float = 0.0, rows: int = 1, label: str | None = None, weight: Column | None = None, out: str = "k", lowering: str | None = None) -> DataFrame:
    """Add the closest cluster (from 1, first on a tie): a projection without a shuffle.

    lowering: expr (literals) for small models, arrow (a broadcast matrix) for others, if not given. Features are without
    nulls, and arrays as long as the model is wide; with a label, labels are among the classes.
    """
    if (lowering or ("expr" if p.clusters * p.width <= LITERALS else "arrow")) == "expr":
        return df.withColumn(out, assign_closest(distances(p, eps_c, rows, label, weight)))
    f = _assigner(df, p, eps_c / rows, label is not None, weight is not None)
    return df.withColumn(out, f(_x(p), F.col(label) if label else F.lit(0), F.lit(1.0) if weight is None else weight.cast("double")))


def nonempty(df: DataFrame, clusters: int, k: str = "k") -> DataFrame:
    """k, n, new_k: surviving clusters in order, numbered afresh."""
    counts = df.groupBy(k).agg(F.count("*").alias("n")).filter(F.col(k).between(1, clusters))
    return counts.withColumn("new_k", F.row_number().over(Window.orderBy(k)))  # a row for each cluster


def drop_empty(df: DataFrame, clusters: int, k: str = "k") -> DataFrame:
    """Renumber clusters after the empty ones are gone."""
    alive = F.broadcast(nonempty(df, clusters, k).select(k, "new_k"))
    return df.join(alive, k).withColumn(k, F.col("new_k")).drop("new_k")


def _center(p: Parameters, d: int, k: str = "k") -> Column:
    return F.element_at(F.array(*(F.lit(c[d]) for c in p.centroids)), F.col(k))


def scatter(df: DataFrame, p: Parameters, weight: Column) -> DataFrame:
    """feature, q: weighted squared distances to each row's own centroid, summed."""
    names = p.features if isinstance(p.features, list) else [f"{p.features}_{d + 1}" for d in range(p.width)]
    sums = [F.struct(F.lit(n).alias("feature"), F.sum(weight * (x - _center(p, d)) * (x - _center(p, d))).alias("q")) for d, (n, x) in enumerate(zip(names, p.columns()))]
    return df.agg(F.array(*sums).alias("a")).select(F.inline("a"))


def update_importances(df: DataFrame, p: Parameters, weight: Column, eps_w: float) -> DataFrame:
    """feature, w: softmax of -q / eps_w over the features; uniform for an infinite eps_w."""
    q = scatter(df, p, weight)
    every = Window.partitionBy()  # a row for each feature
    if math.isinf(eps_w):
        return q.select("feature", F.lit(1.0 / p.width).alias("w"))
    raised = F.exp((F.min("q").over(every) - F.col("q")) / eps_w)
    return q.withColumn("e", raised).select("feature", share(F.col("e"), F.sum("e").over(every), F.count("*").over(every)).alias("w"))


def update_centroids(df: DataFrame, p: Parameters, weight: Column) -> DataFrame:
    """k and the weighted mean of each feature; 0 where a cluster has no weight."""
    names = p.features if isinstance(p.features, list) else [f"{p.features}_{d + 1}" for d in range(p.width)]
    total = F.sum(weight)
    return df.groupBy("k").agg(*(F.when(total > 0, F.sum(weight * x) / F.when(total > 0, total).otherwise(1.0)).otherwise(0.0).alias(n) for n, x in zip(names, p.columns())))


def _over_classes(counts: DataFrame, by: list[str], classes: list) -> DataFrame:
    """by, class, l from counts (by, class, n): shares of each group, with a row for every class."""
    every = counts.groupBy(*by).agg(F.sum("n").alias("all")).withColumn("class", F.explode(F.lit(classes)))
    found = counts.withColumnRenamed("n", "own")
    return every.join(found, [*by, "class"], "left").select(*by, "class", (F.coalesce("own", F.lit(0)) / F.col("all")).alias("l"))


def update_probabilities(df: DataFrame, label: str, classes: list) -> DataFrame:
    """k, class, l: unweighted class shares of each cluster; classes without rows are there, with 0."""
    return _over_classes(df.groupBy("k", F.col(label).alias("class")).agg(F.count("*").alias("n")), ["k"], classes)


def priors(df: DataFrame, label: str, classes: list) -> DataFrame:
    """class, l: unweighted class frequencies, the starting point of every cluster."""
    counts = df.groupBy(F.lit(0).alias("one"), F.col(label).alias("class")).agg(F.count("*").alias("n"))
    return _over_classes(counts, ["one"], classes).drop("one")


def entropy_of(w: list[float]) -> float:
    return -sum(v * math.log(max(v, EPS)) for v in w)


def loss(df: DataFrame, p: Parameters, label: str, weight: Column, rows: int, eps_c: float, eps_w: float) -> DataFrame:
    """loss: distances to own centroids, class error and entropy, of rows that have a cluster k. One aggregate."""
    d = sum((F.lit(w) * (x - _center(p, i)) * (x - _center(p, i)) for i, (w, x) in enumerate(zip(p.importances, p.columns()))), F.lit(0.0))
    logs = F.array(*(F.array(*(F.lit(math.log(max(v, EPS))) for v in probs)) for probs in p.probabilities))
    told = F.element_at(F.element_at(logs, F.col("k")), label_code(label, p.classes) + 1)
    last = 0.0 if math.isinf(eps_w) else eps_w * entropy_of(p.importances)
    return df.agg((F.sum(weight * d) - F.lit(eps_c / rows) * F.sum(told) - F.lit(last)).alias("loss"))


def class_distribution(p: Parameters, k: str = "k") -> Column:
    """Class probabilities of a row's cluster, scaled to sum 1."""
    own = F.element_at(F.array(*(F.array(*(F.lit(float(v)) for v in probs)) for probs in p.probabilities)), F.col(k))
    return F.transform(own, lambda v: share(v, array_sum(own), F.size(own)))


def with_distribution(df: DataFrame, p: Parameters, k: str = "k", out: str = "probabilities") -> DataFrame:
    """Add the class probabilities of a row's cluster: by literals for small models, by a broadcast matrix for others."""
    if p.clusters * len(p.classes) <= LITERALS:
        return df.withColumn(out, class_distribution(p, k))
    own = np.array(p.probabilities, float)
    total = own.sum(1, keepdims=True)
    table = df.sparkSession.sparkContext.broadcast(np.where((total > EPS) & np.isfinite(total), own / np.where(total > 0, total, 1), 1 / own.shape[1]))

    @F.arrow_udf("array<double>")
    def told(k: pa.Array) -> pa.Array:
        rows = table.value[k.to_numpy(zero_copy_only=False) - 1]
        return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel()))

    return df.withColumn(out, told(k))


def statistics(df: DataFrame, p: Parameters, label: str, eps_c: float, rows: int, weight: Column | None, lowering: str = "arrow", given: str | None = None) -> dict[int, tuple]:
    """One scan under the current parameters: {cluster from 0: (weight, shifted sums, shifted squares, class counts)}.

    weight: None for 1 / rows each. given: take each row's cluster from this column instead. Clusters without rows
    are missing. Only clusters x (2 features + classes + 1) numbers reach the driver.
    """
    w = F.lit(1.0 / rows) if weight is None else weight
    if p.clusters * (2 * p.width + len(p.classes) + 1) > MOST_SUMS:
        raise ValueError(f"{p.clusters} clusters of {p.width} features and {len(p.classes)} classes: more than {MOST_SUMS} sums")
    if lowering == "expr":
        known = df if given else assign(df, p, eps_c, rows, label, w, "_k", lowering)
        known = known.withColumn("_k", F.col(given)) if given else known
        shifted = [x - _center(p, d, "_k") for d, x in enumerate(p.columns())]
        sums = known.groupBy(F.col("_k").alias("k")).agg(F.sum(w).alias("s"), F.array(*(F.sum(w * x) for x in shifted)).alias("r"), F.array(*(F.sum(w * x * x) for x in shifted)).alias("q"), F.array(*(F.count_if(F.col(label) == F.lit(c)).cast("double") for c in p.classes)).alias("n"))
    else:
        narrow = df.select(_x(p).alias("x"), F.col(label).alias("y"), w.cast("double").alias("w"), (F.col(given) if given else F.lit(0)).cast("int").alias("k"))
        fields = "k int, some int, s double, r array<double>, q array<double>, n array<double>"
        model = df.sparkSession.sparkContext.broadcast((np.array(p.centroids, float), np.array(p.importances, float), np.log(np.maximum(np.array(p.probabilities, float), EPS)), p.classes))
        part = narrow.mapInArrow(_partial(model, eps_c / rows, given is not None), fields)
        # Partitions' sums by cluster are added up in two steps, array by array.
        for by in (("k", "some"), ("k",)):
            part = part.repartition(*map(F.col, by)).sortWithinPartitions("k").mapInArrow(_added, fields)
        sums = part
    return {r["k"] - 1: (r["s"], np.array(r["r"]), np.array(r["q"]), np.array(r["n"])) for r in sums.collect()}


def _sum_rows(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (k, some, s, r, q, n) as a batch."""
    k, some, s, *arrays = zip(*rows) if rows else [()] * 6
    lists = [pa.array([v.tolist() for v in a], pa.list_(pa.float64())) for a in arrays]
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(some, pa.int32()), pa.array(s, pa.float64()), *lists], ["k", "some", "s", "r", "q", "n"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of each cluster in this partition, which come sorted by cluster."""
    now = None
    for batch in batches:
        for k, some, s, *arrays in zip(*(batch.column(c) for c in ("k", "some", "s", "r", "q", "n"))):
            own = [a.values.to_numpy() for a in arrays]
            if now and now[0] == k.as_py():
                now = (now[0], now[1], now[2] + s.as_py(), *(a + b for a, b in zip(now[3:], own)))
            else:
                if now:
                    yield _sum_rows([now])
                now = (k.as_py(), some.as_py(), s.as_py(), *own)
    if now:
        yield _sum_rows([now])


def _partial(model, eps: float, given: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, w_d, logs, classes = model.value
        k_n, d_n, m_n = len(c), len(w_d), logs.shape[1]
        sums = np.zeros(k_n), np.zeros((k_n, d_n)), np.zeros((k_n, d_n)), np.zeros((k_n, m_n))
        s, r, q, n = sums
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vectors_of(batch.column("x"), d_n)
            y, w = codes_of(batch.column("y"), classes), batch.column("w").to_numpy()
            k = batch.column("k").to_numpy() - 1 if given else closest(x, c, w_d, w, eps * logs[:, y].T if eps > 0 else None)
            shifted = x - c[k]
            for j in np.unique(k):
                own = k == j
                s[j] += w[own].sum()
                r[j] += w[own] @ shifted[own]
                q[j] += w[own] @ (shifted[own] ** 2)
                n[j] += np.bincount(y[own], minlength=m_n)
        some = TaskContext.get().partitionId() // _ADDED
        for j in np.flatnonzero(n.sum(1) > 0).tolist():
            yield _sum_rows([(j + 1, some, s[j], r[j], q[j], n[j])])

    return run
