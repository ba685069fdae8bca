"""Model store, trial log and model properties."""

from __future__ import annotations

import threading
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import reshape
from caseloom.sources import tables


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def append_trials(trials: DataFrame, path: str) -> None:
    """Add finished trials to the log."""
    trials.write.mode("append").parquet(path)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class TrialLog:
    """Trials of one study in a table shared by many, told apart by the values of ``tags``.

    A trial is appended when it ends, one append at a time; what an append cut off leaves behind is not read.
    """

    def __init__(self, spark: SparkSession, path: str, tags: dict | None = None):
        self.spark, self.path, self.tags, self._lock = spark, path, tags or {}, threading.Lock()

    def finished(self) -> dict[str, float]:
        """Loss per trial key."""
        if not tables.exists(self.spark, self.path):
            return {}
        rows = read_trials(self.spark, self.path)
        for name, value in self.tags.items():
            rows = rows.filter(F.col(name) == value)
        return {r["key"]: r["loss"] for r in rows.select("key", "loss").collect()}  # one row a trial

    def append(self, key: str, trial: int, loss: float, params: dict) -> None:
        row = {**{n: float(v) for n, v in params.items()}, **self.tags, "key": key, "trial": trial, "loss": loss}
        with self._lock:
            append_trials(self.spark.createDataFrame([tuple(row.values())], list(row)).coalesce(1), self.path)


def best_trials(trials: DataFrame, keys: Sequence[str], loss: str = "loss", order: str = "trial") -> DataFrame:
    return reshape.best_trial(trials, keys, loss, order)


def properties_long(report: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Model properties as (keys, property, value) rows."""
    return reshape.to_long(report, keys, values, "property", "value")


def write_properties(properties: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    tables.write(properties, path, partition_by, mode="append")
