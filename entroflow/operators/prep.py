"""Labels, weights and rows before a fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import share


def numeric_features(df: DataFrame, features: list[str]) -> DataFrame:
    """The features as doubles; a feature that isn't numeric is an error."""
    for f in features:
        if not isinstance(df.schema[f].dataType, T.NumericType):
            raise ValueError(f"feature {f} is {df.schema[f].dataType.simpleString()}, not numeric")
    return df.withColumns({f: F.col(f).cast("double") for f in features})


def classes_of(df: DataFrame, label: str) -> list:
    """Sorted distinct labels: as many as there are classes."""
    return [r[0] for r in df.select(label).filter(F.col(label).isNotNull()).distinct().orderBy(label).collect()]


def one_hot_label(label: str, classes: list) -> Column:
    """0/1 array over the classes, observed or not."""
    return F.array(*((F.col(label) == F.lit(c)).cast("double") for c in classes)) if classes else F.array().cast("array<double>")


def normalised_weights(df: DataFrame, weight: str, out: str = "w") -> DataFrame:
    """Weights that sum to 1; uniform where the sum is no use. One scalar aggregate, no global window."""
    if not isinstance(df.schema[weight].dataType, T.NumericType):
        raise ValueError("weights must be numeric")
    total, n, missing = df.agg(F.sum(F.col(weight).cast("double")), F.count("*"), F.count_if(F.col(weight).isNull())).first()
    if missing:
        raise ValueError("a weight is null")
    return df.withColumn(out, share(F.col(weight).cast("double"), F.lit(total), F.lit(max(n, 1))))


def select_rows(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in `keys`: a semi-join."""
    return df.join(keys.select(*on).distinct(), on, "left_semi")
