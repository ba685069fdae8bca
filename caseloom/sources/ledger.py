"""Tables written run by run, with a manifest of the runs that are finished."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import joins
from caseloom.sources import tables


class RunLedger:
    """A table with a folder per run at ``path``, and beside it the manifest of finished runs.

    A run enters the manifest after its rows are in place.  What a lost job leaves in a run's folder is not read, and the
    folder is replaced when the run is done again.  Keys are compared by value, null folders apart.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.manifest, self.keys = spark, path, f"{path}_finished", list(keys)

    def finished(self, like: DataFrame | None = None) -> DataFrame | None:
        """Keys of the finished runs, in the types of ``like``; none before the first."""
        if not tables.exists(self.spark, self.manifest):
            return None
        done = self.spark.read.parquet(self.manifest).select(*self.keys).distinct()
        return done if like is None else done.select(*[F.col(k).cast(like.schema[k].dataType) for k in self.keys])

    def pending(self, grid: DataFrame) -> DataFrame:
        """Runs of the grid still to do."""
        runs = grid.select(*self.keys).distinct()
        done = self.finished(runs)
        return runs if done is None else joins.pending_work(runs, done, self.keys)

    def commit(self, rows: DataFrame, runs: DataFrame) -> None:
        """Replace the folders of these runs by ``rows``, then enter the runs; ``runs`` must not be computed from the manifest any more."""
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*self.keys).parquet(self.path)
        runs.select(*self.keys).write.mode("append").parquet(self.manifest)

    def read(self) -> DataFrame:
        """Rows of the finished runs."""
        rows = self.spark.read.parquet(self.path)
        return rows.join(self.finished(rows), self.keys, "left_semi")
