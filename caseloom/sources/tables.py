"""CSV and parquet tables, skipping of finished work, and the probability store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom import config
from caseloom.operators import joins, ordering
from caseloom.session import cut_lineage


def applications_schema(numeric: Sequence[str] = ()) -> T.StructType:
    """Schema of the raw applications; further numeric features are named by the caller."""
    return T.StructType(
        [T.StructField(config.LABEL, T.IntegerType())]
        + [T.StructField(c, T.DoubleType()) for c in numeric]
        + [T.StructField(c, T.StringType()) for c in config.DOMAINS]
        + [T.StructField(config.PROTECTED, T.IntegerType()), T.StructField(config.TIMESTAMP, T.IntegerType())]
    )


def read_csv(spark: SparkSession, path: str, schema: T.StructType, line: str | None = None) -> DataFrame:
    """CSV with a header line; columns are found by name and cast, whatever their order.

    ``line`` adds a column of that name that grows in the order of files and lines, see :func:`in_file_order`.
    """
    raw = spark.read.option("header", True).csv(path)
    missing = [n for n in schema.names if n not in raw.columns]
    if missing:
        raise ValueError(f"columns {missing} are not in {path}")
    cols = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]
    return raw.select(*cols) if line is None else in_file_order(raw.select(*cols, *file_position()), line)


def file_position() -> list[Column]:
    """Where a scanned row comes from: its file, the start of its block, and a number that grows inside the block."""
    where = F.col("_metadata")
    return [where["file_path"].alias("_file"), where["file_block_start"].alias("_block"), F.monotonically_increasing_id().alias("_row")]


def in_file_order(scanned: DataFrame, out: str) -> DataFrame:
    """Replace :func:`file_position` by one number in the order of (file name, block, line).

    It orders rows the same however the scan cuts files into blocks and packs blocks into tasks.  Only one row per block
    is sorted in one place.
    """
    rows = cut_lineage(scanned)
    blocks = rows.select("_file", "_block").distinct()
    blocks = blocks.withColumn("_place", F.row_number().over(Window.orderBy("_file", "_block")).cast("long"))
    placed = joins.attach(rows, blocks, ["_file", "_block"], "_row")
    inside = F.col("_row").bitwiseAND((1 << 33) - 1)
    return placed.withColumn(out, F.shiftleft("_place", 33) + inside).drop("_file", "_block", "_row", "_place")


def numeric_features(spark: SparkSession, path: str) -> list[str]:
    """Columns of the applications file without a role of their own: they pass through as numbers."""
    known = set(applications_schema().names)
    return [c for c in spark.read.option("header", True).csv(path).columns if c not in known]


def with_case_id(rows: DataFrame, source_key: str) -> DataFrame:
    """Dense case id in the total order (month, source key); the key must be numeric and unique."""
    return ordering.numbered(rows, [], source_key, "case_id", outer=[config.TIMESTAMP])


def scan(
    spark: SparkSession, path: str, columns: dict[str, str | Column] | None = None, where: Column | None = None
) -> DataFrame:
    """Parquet scan of the named columns (``output: input``); filter and columns reach the files."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.filter(where)
    if columns is None:
        return df
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def write(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "ignore") -> None:
    """Parquet sink; an existing table is kept unless ``mode`` says otherwise."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a write to this folder has finished; a folder left by a failed write does not count."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def pending(grid: DataFrame, path: str, on: Sequence[str]) -> DataFrame:
    """Rows of the work grid whose output partition is not in the table at ``path`` yet."""
    spark = grid.sparkSession
    if not exists(spark, path):
        return grid
    done = spark.read.parquet(path).select(*on).distinct()
    return joins.pending_work(grid, done.select(*[F.col(c).cast(grid.schema[c].dataType) for c in on]), on)


STORE_KEYS = ["scen", "cost", "method", "seed"]


def write_probabilities(pairs: DataFrame, path: str, mode: str = "append") -> None:
    """Store ``p_correct`` per (case, expert), one folder per scenario, cost, method and seed."""
    cols = [*STORE_KEYS, "case_id", "expert", "p_correct"]
    pairs.select(*cols).write.mode(mode).partitionBy(*STORE_KEYS).parquet(path)


def read_probabilities(spark: SparkSession, path: str, **keys) -> DataFrame:
    """Stored probabilities of the given keys; only their folders are read."""
    schema = T.StructType(
        [
            T.StructField("case_id", T.LongType()),
            T.StructField("expert", T.StringType()),
            T.StructField("p_correct", T.DoubleType()),
            T.StructField("scen", T.StringType()),
            T.StructField("cost", T.DoubleType()),
            T.StructField("method", T.StringType()),
            T.StructField("seed", T.StringType()),
        ]
    )
    df = spark.read.schema(schema).parquet(path)
    for name, value in keys.items():
        df = df.filter(F.col(name) == value)
    return df
