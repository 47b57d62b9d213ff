"""Mutual information of continuous columns with a label, by nearest neighbours on the line, with windows only.

Rows are first collapsed to distinct values of each feature and label with their counts, so that a value which very many rows
share is one row from then on, and rows need no key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import EPS, digamma, hash_uniform
from ..functions.ordered import carried, cuts_of, pieces, with_piece
from ..sources.staging import small, staged
from .scalers import melt

TRIFLE = 1e-11


def _radius(k: int, by) -> Column:
    """Distance to the kth neighbour in a class sorted by distinct value: the least reach of a run of values around a value
    that holds k rows besides one of its own. k values on either side are enough, as each has a row at least."""
    left, right = [(F.lit(0.0), F.lit(0))], [(F.lit(0.0), F.lit(0))]
    for j in range(1, k + 1):  # reach and rows of the j values next to it; null where there are fewer
        left.append((F.col("v") - F.lag("v", j).over(by), left[-1][1] + F.lag("c", j).over(by)))
        right.append((F.lead("v", j).over(by) - F.col("v"), right[-1][1] + F.lead("c", j).over(by)))
    options = [F.when(F.col("c") - 1 + a[1] + b[1] >= k, F.greatest(a[0], b[0])) for a in left for b in right]
    return F.least(*options)


def _borders(rows: DataFrame, k: int) -> DataFrame:
    """feature, label, piece, v, c: for each piece of a class the k values before it and the k after it, as rows of its own."""
    up, down = pieces("feature", "label").orderBy("v"), pieces("feature", "label").orderBy(F.desc("v"))
    told = rows.withColumn("up", F.row_number().over(up)).withColumn("down", F.row_number().over(down)).withColumn("vc", F.struct("v", "c"))
    ends = told.groupBy("feature", "label", "piece").agg(F.collect_list(F.when(F.col("up") <= k, F.col("vc"))).alias("first"), F.collect_list(F.when(F.col("down") <= k, F.col("vc"))).alias("last"))
    along = Window.partitionBy("feature", "label").orderBy("piece")  # a row for each piece, none of them without rows
    before = F.flatten(F.collect_list("last").over(along.rowsBetween(-k, -1)))
    after = F.flatten(F.collect_list("first").over(along.rowsBetween(1, k)))
    near = ends.withColumn("before", F.slice(F.sort_array(before, asc=False), 1, k)).withColumn("after", F.slice(F.sort_array(after), 1, k))
    return near.select("feature", "label", "piece", F.explode(F.concat("before", "after")).alias("vc")).select("feature", "label", "piece", "vc.v", "vc.c")


def mutual_information(long: DataFrame, k: int = 3) -> DataFrame:
    """feature, mi of a long table (feature, label, v; other columns play no part): the kNN estimate between a continuous and a
    discrete variable.

    Classes of one row are left out; where fewer than two classes or rows remain the estimate is 0, and it is never
    negative. Counts within each value's radius come from sorting values and interval ends together, piece by piece.
    """
    counted = staged(long.groupBy("feature", "label", "v").agg(F.count("*").alias("c")), "value_counts")
    classes = small(staged(counted.groupBy("feature", "label").agg(F.sum("c").alias("n_c")).filter("n_c > 1"), "class_sizes"))
    sized = counted.join(classes, ["feature", "label"])
    cuts, most = cuts_of(sized, "v")
    sized = with_piece(sized, "v", cuts, most).withColumn("k", F.least(F.lit(k), F.col("n_c") - 1))
    around = sized.select("feature", "label", "piece", "v", "c", "n_c", "k")
    if most:
        around = around.unionByName(_borders(around, k), allowMissingColumns=True)
    own = pieces("feature", "label").orderBy("v")
    radius = F.coalesce(*(F.when(F.col("k") == j, _radius(j, own)) for j in range(1, k + 1)))
    rows = around.withColumn("r", radius).filter("n_c is not null")
    tiny = F.col("r") <= EPS
    # Points within the radius: strictly nearer, or up to EPS where the radius is nothing. The radius is drawn in by a
    # trifle, so that rounding in v - r and v + r doesn't take a neighbour at the radius itself for a nearer one.
    inner = F.col("r") * (1 - TRIFLE)
    lo = F.struct((F.col("v") - F.when(tiny, F.lit(EPS)).otherwise(inner)).alias("at"), F.when(tiny, 0).otherwise(2).alias("order"), F.lit(-1).alias("sign"))
    hi = F.struct((F.col("v") + F.when(tiny, F.lit(EPS)).otherwise(inner)).alias("at"), F.when(tiny, 2).otherwise(0).alias("order"), F.lit(1).alias("sign"))
    point = F.struct(F.col("v").alias("at"), F.lit(1).alias("order"), F.lit(0).alias("sign"))
    events = rows.select("feature", "label", "v", "c", "n_c", "k", F.explode(F.array(point, lo, hi)).alias("e")).select("feature", "label", "v", "c", "n_c", "k", "e.*")
    events = with_piece(events, "at", cuts, most)
    points = F.sum(F.when(F.col("sign") == 0, F.col("c")).otherwise(0))
    running = points.over(pieces("feature").orderBy("at", "order").rowsBetween(Window.unboundedPreceding, 0))
    met = events.withColumn("seen", running).filter("sign <> 0")
    if most:
        met = met.join(F.broadcast(carried(events, ["feature"], points)), ["feature", "piece"]).withColumn("seen", F.col("seen") + F.col("before"))  # a row for each piece
    within = met.groupBy("feature", "label", "v").agg(F.sum(F.col("sign") * F.col("seen")).alias("m"), F.max("c").alias("c"), F.max("n_c").alias("n_c"), F.max("k").alias("k"))
    mean = lambda x: F.sum(F.col("c") * digamma(x)) / F.sum("c")
    means = within.groupBy("feature").agg(F.sum("c").alias("n"), F.count_distinct("label").alias("labels"), mean("k").alias("a"), mean("n_c").alias("b"), mean(F.greatest("m", F.lit(1))).alias("c"))
    mi = F.when(F.col("labels") < 2, 0.0).otherwise(F.greatest(F.lit(0.0), digamma("n") + F.col("a") - F.col("b") - F.col("c")))
    every = counted.select("feature").distinct()
    return every.join(means, "feature", "left").select("feature", F.coalesce(mi, F.lit(0.0)).alias("mi"))


def positions(column: str, width: int) -> list[str]:
    """Names of an array column's places."""
    return [f"{column}_{d + 1}" for d in range(width)]


def feature_information(df: DataFrame, features: list[str] | str, label: str, key: list[str] = (), k: int = 3, noise: int | None = None) -> DataFrame:
    """feature, mi: columns, or the places of one array column (name_1, name_2, ...), divided by their standard deviation
    (unless 0) and, with a seed, given a little normal noise, which `key` tells rows apart for."""
    one_id = F.concat_ws(":", *(F.col(c).cast("string") for c in key)).alias("id")
    if isinstance(features, str):
        long = df.select(one_id, F.col(label).alias("label"), F.posexplode(F.col(features)).alias("_at", "v"))
        long = long.select("id", "label", F.concat(F.lit(f"{features}_"), (F.col("_at") + 1).cast("string")).alias("feature"), F.col("v").cast("double").alias("v"))
    else:
        long = melt(df.select(one_id, F.col(label).alias("label"), *features), ["id", "label"], features)
    stats = small(staged(long.groupBy("feature").agg(F.stddev_pop("v").alias("sd"), F.avg(F.abs("v")).alias("size")), "feature_sizes"))
    scaled = long.join(stats, "feature").withColumn("v", F.when(F.col("sd") > 0, F.col("v") / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).otherwise(F.col("v")))
    if noise is not None:
        u, t = hash_uniform(noise, "radius", "feature", "id"), hash_uniform(noise, "angle", "feature", "id")
        size = F.greatest(F.lit(1.0), F.when(F.col("sd") > 0, F.col("size") / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)).otherwise(F.col("size")))
        scaled = scaled.withColumn("v", F.col("v") + 1e-10 * size * F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * t))
    return mutual_information(scaled.select("feature", "label", "v"), k)
