"""Tables that queries start from, and saving and loading of fitted models."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classifier import EspaClassifier, Model, Report
from ..operators.steps import Parameters


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: doc_id, letters (share of a-z), variety (share of distinct words), size (log of n_chars), quality."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    words = F.split("text", " ")
    letters = F.length(F.regexp_replace("text", "[^a-zA-Z]", "")) / F.greatest(F.length("text"), F.lit(1))
    return docs.select("doc_id", letters.alias("letters"), (F.size(F.array_distinct(words)) / F.size(words)).alias("variety"), F.log(F.greatest("n_chars", F.lit(1)).cast("double")).alias("size"), F.col("quality").cast("int").alias("quality"))


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """A model as one JSON row, written where Spark can write."""
    kept = {"parameters": {k: v for k, v in asdict(model.parameters).items() if k != "width"}, "settings": asdict(model.settings), "report": asdict(model.report)}
    spark.createDataFrame([(json.dumps(kept),)], "model string").write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> Model:
    kept = json.loads(spark.read.text(path, wholetext=True).first()[0])
    return Model(Parameters(**kept["parameters"]), EspaClassifier(**kept["settings"]), Report(**kept["report"]))
