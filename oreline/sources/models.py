"""Saving fitted pipelines with what is known about them."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession


def save_model(model: PipelineModel, path: str, spark: SparkSession, **about) -> None:
    """The model under ``path/model`` and one JSON row of metadata, metrics and parameters beside it."""
    model.write().overwrite().save(f"{path}/model")
    row = spark.createDataFrame([(json.dumps(about, sort_keys=True, default=str),)], "about string")
    row.coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(path: str, spark: SparkSession) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/about").first().value)
