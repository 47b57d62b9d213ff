"""Order along a line without one task for a whole column: values fall into pieces by cut points, tasks sort pieces, and
what earlier pieces hold is carried over in small tables (a row for each piece)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task is meant to sort. Where the cuts lie decides nothing but the tasks' sizes.
PIECE_ROWS = 1_000_000


def cuts_of(df: DataFrame, value: str) -> tuple[DataFrame, int]:
    """feature, cuts (ascending) of the values of each feature, and the largest number of cuts. Equal values are never cut."""
    largest = df.groupBy("feature").count().agg(F.max("count")).first()[0] or 0
    n = math.ceil(largest / PIECE_ROWS)
    if n < 2:
        return df.sparkSession.createDataFrame([], "feature string, cuts array<double>"), 0
    shares = F.array(*(F.lit(k / n) for k in range(1, n)))
    rows = df.groupBy("feature").agg(F.array_sort(F.array_distinct(F.percentile_approx(value, shares, max(10_000, 20 * n)))).alias("cuts")).collect()  # features x n numbers
    return df.sparkSession.createDataFrame([(r["feature"], [float(v) for v in r["cuts"]]) for r in rows], "feature string, cuts array<double>"), n - 1


def with_piece(df: DataFrame, value: str, cuts: DataFrame, most: int) -> DataFrame:
    """Add piece: the number of the feature's cuts below the value, by bisection."""
    if not most:
        return df.withColumn("piece", F.lit(0))
    steps = F.array(*(F.lit(1 << k) for k in range(most.bit_length() - 1, -1, -1)))

    def step(at: Column, wide: Column) -> Column:
        there = at + wide
        return F.when((there <= F.size("cuts")) & (F.try_element_at("cuts", F.greatest(F.least(there, F.size("cuts")), F.lit(1))) < F.col(value)), there).otherwise(at)

    found = df.join(F.broadcast(cuts), "feature", "left")
    return found.withColumn("piece", F.when(F.coalesce(F.size("cuts"), F.lit(0)) > 0, F.aggregate(steps, F.lit(0), step)).otherwise(0)).drop("cuts")


def carried(df: DataFrame, by: list[str], count: Column) -> DataFrame:
    """by, piece, before, whole: a sum over the earlier pieces of a group, and over all."""
    sums = df.groupBy(*by, "piece").agg(count.alias("own"))
    along = Window.partitionBy(*by).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, "piece", F.coalesce(F.sum("own").over(along), F.lit(0)).alias("before"), F.sum("own").over(Window.partitionBy(*by)).alias("whole"))


def pieces(*by: str):
    return Window.partitionBy(*by, "piece")
