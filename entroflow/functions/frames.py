"""Matrix kernels on long tables (i, j, v): a row for each entry, so that no matrix is ever held whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import share


def _scaled(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*by)
    return df.withColumn(out, share(F.col(value), F.sum(value).over(w), F.count("*").over(w)))


def left_stochastic(df: DataFrame, column: str = "j", value: str = "v", out: str = "v") -> DataFrame:
    """Each column sums to 1."""
    return _scaled(df, [column], value, out)


def right_stochastic(df: DataFrame, row: str = "i", value: str = "v", out: str = "v") -> DataFrame:
    """Each row sums to 1."""
    return _scaled(df, [row], value, out)


def softmax(df: DataFrame, by: list[str], value: str = "v", prefactor: float = 1.0, out: str = "v") -> DataFrame:
    """exp(v / prefactor) scaled to sum 1 within each group."""
    if not prefactor > 0:
        raise ValueError("softmax: prefactor must be positive")
    top = F.max(value).over(Window.partitionBy(*by))
    raised = df.withColumn(out, F.when(top == float("-inf"), 0.0).otherwise(F.exp((F.col(value) - top) / prefactor)))
    return _scaled(raised, by, out, out)


def assign_closest(df: DataFrame, item: str = "j", place: str = "i", distance: str = "v") -> DataFrame:
    """For each item the place of its smallest distance, the smallest place on a tie: a partial aggregate."""
    return df.groupBy(item).agg(F.min(F.struct(distance, place))[place].alias("k"))
