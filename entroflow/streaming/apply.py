"""Fitted models on streams. Prediction and scaling are projections (quantile mappings up to KNOTS_HELD knots), so they run on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.classifier import Model
from ..operators.scalers import MinMaxScaler, QuantileTransformer


def read(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def predict(stream: DataFrame, model: Model, scaler: MinMaxScaler | QuantileTransformer | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Scale (if wanted; carry names the columns besides the features) and predict each row as it comes: no state, no watermark."""
    return model.predict_mode(scaler.transform(stream, carry) if scaler else stream)
