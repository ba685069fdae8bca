"""Test beds: a folder per environment with its batches and capacities as CSV files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import joins, ordering
from caseloom.sources import tables


def path_part(place: int) -> Column:
    """A folder name of the file a row came from, counted from the file name (1 = its folder)."""
    return F.url_decode(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1 - place))


def _place(grid: bool) -> dict[str, Column]:
    names = {"env": path_part(1)}
    return {"grid": path_part(2), **names} if grid else names


def read_batches(spark: SparkSession, pattern: str, grid: bool = False) -> DataFrame:
    """(env, batch, pos, case_id) from ``<env>/batches.csv`` files.

    ``grid`` adds the name of the folder above the environment.

    The place of a line in its file decides the order of cases, however the scan cuts the file; ``pos`` is its rank inside the batch.
    """
    where = _place(grid)
    placed = spark.read.option("header", True).csv(pattern).select(
        *[c.alias(n) for n, c in where.items()],
        F.col("batch").cast("int").alias("batch"),
        F.col("case_id").cast("long").alias("case_id"),
        *tables.file_position(),
    )
    return ordering.numbered(tables.in_file_order(placed, "_line"), [*where, "batch"], "_line", "pos").drop("_line")


def read_capacity(spark: SparkSession, pattern: str, humans: Sequence[str] | None = None, grid: bool = False) -> DataFrame:
    """(env, batch, batch_size, expert, capacity) with the classifier's remainder row.

    ``<env>/capacity.csv`` has ``batch_id``, ``batch_size`` and one column per human.  ``humans`` names those to take;
    without it each file's own header does, so files of one read may have other humans or another order.  An empty
    cell then means that the batch does not have this human.
    """
    where = _place(grid)
    if humans is None:
        long = _by_own_header(spark, pattern, where)
        return joins.with_remainder(long, list(where)).filter(F.col("expert").isNotNull())
    wide = spark.read.option("header", True).csv(pattern).select(
        *[c.alias(n) for n, c in where.items()],
        F.col("batch_id").cast("int").alias("batch"),
        F.col("batch_size").cast("long").alias("batch_size"),
        *[F.col(f"`{h}`").cast("long").alias(h) for h in humans],
    )
    return joins.with_remainder(joins.unpivot_capacity(wide, list(where), humans), list(where))


def _by_own_header(spark: SparkSession, pattern: str, where: dict[str, Column]) -> DataFrame:
    """(env, batch, batch_size, expert, capacity) of files that may differ in their columns.

    A batch without humans keeps a row of a null expert and no capacity.
    """
    cells = F.transform(F.split("value", ","), lambda c: F.trim(F.regexp_replace(c, '"', "")))
    lines = spark.read.text(pattern).select(
        *[c.alias(n) for n, c in where.items()], F.col("_metadata.file_path").alias("_file"), cells.alias("_cells")
    )
    titles = F.array_contains("_cells", "batch_id")
    heads = lines.filter(titles).select("_file", F.col("_cells").alias("_names"))
    rows = lines.filter(~titles & (F.array_join("_cells", "") != ""))
    named = joins.attach(rows, heads, ["_file"], "_cells")
    pairs = F.zip_with("_names", "_cells", lambda n, c: F.struct(n.alias("name"), c.alias("cell")))
    found = named.withColumn("_m", F.map_from_entries(F.slice(pairs, 1, F.size("_names"))))
    people = F.map_filter("_m", lambda n, c: ~n.isin("batch_id", "batch_size") & (c != ""))
    long = found.select(
        *where,
        F.col("_m")["batch_id"].cast("int").alias("batch"),
        F.col("_m")["batch_size"].cast("long").alias("batch_size"),
        F.explode_outer(people).alias("expert", "_c"),
    )
    return long.withColumn("capacity", F.coalesce(F.col("_c").cast("long"), F.lit(0).cast("long"))).drop("_c")
