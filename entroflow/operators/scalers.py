"""Column transformers: min-max scaling and empirical-quantile mapping.

Both are fitted on named columns and check the names of what they transform. Fitting and transforming are plans; only
min-max, two numbers a column, is collected.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordered import carried, cuts_of, pieces, with_piece
from ..sources.staging import staged

#: Knots (of all columns together) up to which a mapping is a projection with the knots in a broadcast: 16 MB.
KNOTS_HELD = 1_000_000


def check_columns(df: DataFrame, features: list[str], carry: Iterable[str] = ()) -> None:
    """The table must have the fitted columns, in any order, and besides them none but those named to be carried along."""
    missing, more = [f for f in features if f not in df.columns], [c for c in df.columns if c not in features and c not in carry]
    if missing or more:
        raise ValueError(f"columns differ from the fitted ones: missing {missing}, unknown {more}")


def check_range(lo: float, hi: float) -> None:
    if not hi >= lo:
        raise ValueError(f"feature_range: {hi} is below {lo}")


@dataclass
class MinMaxScaler:
    """Scale columns to feature_range, without clipping. A constant column becomes the range's low end.

    Null counts as absent; a column with a NaN, or without values, has NaN bounds and turns NaN.
    """

    feature_range: tuple[float, float] = (0.0, 1.0)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)

    def __post_init__(self):
        check_range(*self.feature_range)

    @staticmethod
    def fit_plan(df: DataFrame, features: list[str]) -> DataFrame:
        """One row for each feature: feature, min, max. One pass, map-side combined."""
        sums = []
        for f in features:
            x = F.col(f).cast("double")
            nan = F.coalesce(F.bool_or(F.isnan(x)), F.lit(True))
            sums.append(F.struct(F.lit(f).alias("feature"), F.when(nan, float("nan")).otherwise(F.min(x)).alias("min"), F.when(nan, float("nan")).otherwise(F.max(x)).alias("max")))
        return df.agg(F.array(*sums).alias("a")).select(F.inline("a"))

    def fit(self, df: DataFrame, features: list[str]) -> MinMaxScaler:
        rows = self.fit_plan(df, features).collect()
        return MinMaxScaler(self.feature_range, {r["feature"]: tuple(math.nan if v is None else v for v in (r["min"], r["max"])) for r in rows})

    def forward(self, x: Column, lo: float, hi: float) -> Column:
        a, b = self.feature_range
        if math.isnan(lo):
            return F.lit(float("nan"))
        return F.lit(float(a)) if hi == lo else (x.cast("double") - lo) * (1 / (hi - lo)) * (b - a) + a

    def backward(self, s: Column, lo: float, hi: float) -> Column:
        a, b = self.feature_range
        if math.isnan(lo):
            return F.lit(float("nan"))
        return F.lit(lo) if hi == lo or a == b else (s.cast("double") - a) / (b - a) * (hi - lo) + lo

    def transform(self, df: DataFrame, carry: Iterable[str] = ()) -> DataFrame:
        check_columns(df, list(self.bounds), carry)
        return df.withColumns({f: F.when(F.col(f).isNotNull(), self.forward(F.col(f), *b)) for f, b in self.bounds.items()})

    def inverse_transform(self, df: DataFrame, carry: Iterable[str] = ()) -> DataFrame:
        check_columns(df, list(self.bounds), carry)
        return df.withColumns({f: F.when(F.col(f).isNotNull(), self.backward(F.col(f), *b)) for f, b in self.bounds.items()})


def melt(df: DataFrame, key: list[str], features: list[str]) -> DataFrame:
    """Long form: key, feature, v."""
    return df.select(*key, F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features))))


def finite(x) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


@dataclass
class QuantileTransformer:
    """Map columns to their place in the fitted empirical distribution, linear between distinct values.

    The fitted table (feature, rank, value, n) keeps every distinct finite value; it is written once, and stays distributed.
    Up to KNOTS_HELD knots are broadcast, and transforming is a projection: no key, no shuffle, streams too. Beyond, rows are searched by
    sorting pieces of values and knots together, and need a key. Values outside are clamped, non-finite ones become the
    middle; the inverse turns non-finite ones into NaN, or into the knot where there is one alone. Null stays null.
    """

    feature_range: tuple[float, float] = (0.0, 1.0)
    knots: DataFrame | None = None
    features: list[str] = field(default_factory=list)
    _held: dict | None = field(default=None, repr=False, compare=False)

    def __post_init__(self):
        check_range(*self.feature_range)

    def fit(self, df: DataFrame, features: list[str]) -> QuantileTransformer:
        distinct = melt(df, [], features).filter(finite("v")).distinct()
        cuts, most = cuts_of(distinct, "v")
        placed = with_piece(distinct, "v", cuts, most)
        sums = F.broadcast(carried(placed, ["feature"], F.count("*")))  # a row for each piece
        knots = placed.join(sums, ["feature", "piece"]).select("feature", (F.col("before") + F.row_number().over(pieces("feature").orderBy("v"))).alias("rank"), F.col("v").alias("value"), F.col("whole").alias("n"))
        return QuantileTransformer(self.feature_range, staged(knots, "knots"), list(features))

    def held(self) -> dict[str, np.ndarray] | None:
        """Each feature's knots, ascending, if there are few enough to hold; counted before any is collected."""
        if self._held is None and self.knots.count() <= KNOTS_HELD:
            found = {r["feature"]: r["v"] for r in self.knots.groupBy("feature").agg(F.array_sort(F.collect_list("value")).alias("v")).collect()}
            self._held = {f: np.array(found.get(f, []), float) for f in self.features}
        return self._held

    def _mapper(self, spark: SparkSession, inverse: bool):
        """An Arrow function (feature, value) to the mapped value, with the knots in a broadcast."""
        (a, b), knots = self.feature_range, spark.sparkContext.broadcast(self._held)
        step = _back if inverse else _forth

        @F.arrow_udf("double")
        def mapped(feature: pa.Array, x: pa.Array) -> pa.Array:
            v, names = x.to_numpy(zero_copy_only=False).astype(float), feature.to_numpy(zero_copy_only=False)
            out = np.empty(len(v))
            for name in set(names):
                own = names == name
                out[own] = step(v[own], knots.value.get(name, np.zeros(0)), a, b)
            return pa.array(out, mask=x.is_null().to_numpy(zero_copy_only=False))

        return mapped

    def _long(self, long: DataFrame, inverse: bool) -> DataFrame | None:
        if self.held() is None:
            return None
        v = F.col("v").cast("double")
        return long.withColumn("v", F.when(v.isNotNull(), self._mapper(long.sparkSession, inverse)("feature", v)))

    def _near(self, values: DataFrame) -> DataFrame:
        """feature, v (distinct), below and above: the knots (rank, v) next to each value."""
        points = self.knots.select("feature", F.col("value").alias("v"), "rank")
        cuts, most = cuts_of(points, "v")
        both = with_piece(values.withColumn("rank", F.lit(None).cast("long")).withColumn("is_value", F.lit(1)).unionByName(points.withColumn("is_value", F.lit(0))), "v", cuts, most)
        up = pieces("feature").orderBy("v", "is_value").rowsBetween(Window.unboundedPreceding, 0)
        down = pieces("feature").orderBy(F.desc("v"), "is_value").rowsBetween(Window.unboundedPreceding, 0)
        knot = F.when(F.col("rank").isNotNull(), F.struct("rank", "v"))
        near = both.withColumn("below", F.last(knot, ignorenulls=True).over(up)).withColumn("above", F.last(knot, ignorenulls=True).over(down)).filter("is_value = 1")
        if most:  # the nearest knots of other pieces
            ends = both.groupBy("feature", "piece").agg(F.min(knot).alias("first"), F.max(knot).alias("last"))
            along = Window.partitionBy("feature").orderBy("piece")  # a row for each piece
            ends = ends.select("feature", "piece", F.last("last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("left"), F.first("first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("right"))
            near = near.join(F.broadcast(ends), ["feature", "piece"], "left").withColumn("below", F.coalesce("below", "left")).withColumn("above", F.coalesce("above", "right"))
        return near.select("feature", "v", "below", "above")

    def transform_long(self, long: DataFrame) -> DataFrame:
        """key..., feature, v with v mapped: by bisection in the knots, or where they are many by an as-of search that sorts
        pieces of values and knots together (null values are left out there)."""
        if (out := self._long(long, inverse=False)) is not None:
            return out
        a, b = self.feature_range
        key = [c for c in long.columns if c not in ("feature", "v")]
        k = self.knots
        # Values that rows share are placed once.
        values = long.filter(finite("v")).select(*key, "feature", "v")
        near = values.join(self._near(values.select("feature", "v").distinct()), ["feature", "v"])
        n = F.broadcast(k.groupBy("feature").agg(F.max("n").alias("n")))  # a row for each feature
        gap = F.col("above.v") - F.col("below.v")
        place = F.when(F.col("below").isNull(), 0.0).when(F.col("above").isNull(), 1.0)
        only = F.when(F.col("n") == 1, F.when(F.col("below").isNull(), 0.0).when(F.col("above").isNull(), 1.0).otherwise(0.5))
        inside = (F.col("below.rank") - 1 + F.when(gap > 0, (F.col("v") - F.col("below.v")) / F.when(gap > 0, gap).otherwise(1.0)).otherwise(0.0)) / F.greatest(F.col("n") - 1, F.lit(1))
        mapped = near.join(n, "feature", "left").select(*key, "feature", F.when(F.col("n").isNull(), 0.5).otherwise(F.coalesce(only, place, inside)).alias("p"))
        odd = long.filter(~finite("v") & F.col("v").isNotNull()).select(*key, "feature", F.lit(0.5).alias("p"))
        return mapped.unionByName(odd).select(*key, "feature", (F.col("p") * (b - a) + a).alias("v"))

    def inverse_long(self, long: DataFrame) -> DataFrame:
        """key..., feature, v mapped back: by place in the knots, or where they are many by two equi-joins on rank."""
        if (out := self._long(long, inverse=True)) is not None:
            return out
        a, b = self.feature_range
        key = [c for c in long.columns if c not in ("feature", "v")]
        n = F.broadcast(self.knots.groupBy("feature").agg(F.max("n").alias("n")))
        p = F.lit(0.5) if a == b else F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - a) / (b - a)))
        placed = long.join(n, "feature", "left").withColumn("at", F.when(F.col("n") == 1, 1.0).when(finite("v") & F.col("n").isNotNull(), p * (F.col("n") - 1) + 1))
        placed = placed.withColumn("lo", F.floor("at").cast("long")).withColumn("hi", F.ceil("at").cast("long"))
        lo = self.knots.select("feature", F.col("rank").alias("lo"), F.col("value").alias("lo_v"))
        hi = self.knots.select("feature", F.col("rank").alias("hi"), F.col("value").alias("hi_v"))
        both = placed.join(lo, ["feature", "lo"], "left").join(hi, ["feature", "hi"], "left")
        value = F.col("lo_v") + (F.col("at") - F.col("lo")) * (F.col("hi_v") - F.col("lo_v"))
        return both.select(*key, "feature", F.when(F.col("v").isNotNull(), F.coalesce(value, F.lit(float("nan")))).alias("v"))

    def _wide(self, df: DataFrame, key: list[str], inverse: bool) -> DataFrame:
        check_columns(df, self.features, key)
        if self.held() is not None:
            mapper = self._mapper(df.sparkSession, inverse)
            values = {f: F.col(f).cast("double") for f in self.features}
            return df.select(*key, *(F.when(v.isNotNull(), mapper(F.lit(f), v)).alias(f) for f, v in values.items()))
        if not key:
            raise ValueError(f"more than {KNOTS_HELD} knots: rows need a key")
        # Rows are put together again by their key, so it must tell them apart.
        if not df.groupBy(*key).count().filter("count > 1").isEmpty():
            raise ValueError(f"{key} doesn't tell rows apart")
        step = self.inverse_long if inverse else self.transform_long
        out = step(melt(df, key, self.features)).groupBy(*key).pivot("feature", self.features).agg(F.first("v"))
        return df.select(*key).join(out, key, "left")

    def transform(self, df: DataFrame, key: Iterable[str] = ()) -> DataFrame:
        """The key (columns carried along) and the mapped columns, by name whatever their order. Only a mapping of very many knots
        needs the key to tell rows apart."""
        return self._wide(df, list(key), inverse=False)

    def inverse_transform(self, df: DataFrame, key: Iterable[str] = ()) -> DataFrame:
        return self._wide(df, list(key), inverse=True)


def _forth(v: np.ndarray, knots: np.ndarray, a: float, b: float) -> np.ndarray:
    """Places of values among sorted distinct knots, in the range from a to b."""
    n, good = len(knots), np.isfinite(v)
    p = np.full(len(v), 0.5)
    if n == 1:
        p[good] = np.where(v[good] < knots[0], 0.0, np.where(v[good] > knots[0], 1.0, 0.5))
    elif n:
        x = v[good]
        below = np.searchsorted(knots, x, "right") - 1
        lo, hi = knots[np.clip(below, 0, n - 1)], knots[np.clip(below + (x != knots[np.clip(below, 0, n - 1)]), 0, n - 1)]
        gap = hi - lo
        inside = (below + np.where(gap > 0, (x - lo) / np.where(gap > 0, gap, 1.0), 0.0)) / (n - 1)
        p[good] = np.where(x < knots[0], 0.0, np.where(x > knots[-1], 1.0, inside))
    return p * (b - a) + a


def _back(v: np.ndarray, knots: np.ndarray, a: float, b: float) -> np.ndarray:
    """Values at places of the range from a to b."""
    n, good = len(knots), np.isfinite(v)
    if n <= 1:
        return np.full(len(v), knots[0] if n else np.nan)
    out = np.full(len(v), np.nan)
    p = np.full(good.sum(), 0.5) if a == b else np.clip((v[good] - a) / (b - a), 0.0, 1.0)
    at = p * (n - 1)
    lo, hi = np.floor(at).astype(int), np.ceil(at).astype(int)
    out[good] = knots[lo] + (at - lo) * (knots[hi] - knots[lo])
    return out


#: Version of what save_scaler writes.
STORE = 1


def save_scaler(spark: SparkSession, scaler: MinMaxScaler | QuantileTransformer, path: str) -> None:
    """A fitted scaler, written where Spark can write: one JSON row, and a quantile mapping's knots as Parquet, by feature and rank."""
    told = {"store": STORE, "kind": type(scaler).__name__, "feature_range": list(scaler.feature_range)}
    if isinstance(scaler, QuantileTransformer):
        told["features"] = scaler.features
        scaler.knots.select("feature", "rank", "value", "n").repartitionByRange("feature", "rank").sortWithinPartitions("feature", "rank").write.mode("overwrite").parquet(f"{path}/knots")
    else:
        told["bounds"] = scaler.bounds
    spark.createDataFrame([(json.dumps(told),)], "scaler string").coalesce(1).write.mode("overwrite").text(f"{path}/scaler")


def load_scaler(spark: SparkSession, path: str) -> MinMaxScaler | QuantileTransformer:
    told = json.loads(spark.read.text(f"{path}/scaler", wholetext=True).first()[0])
    if told["store"] != STORE:
        raise ValueError(f"{path}: written by version {told['store']} of the store, this is {STORE}")
    span = tuple(told["feature_range"])
    if told["kind"] == "QuantileTransformer":
        return QuantileTransformer(span, spark.read.parquet(f"{path}/knots"), told["features"])
    return MinMaxScaler(span, {f: tuple(b) for f, b in told["bounds"].items()})
