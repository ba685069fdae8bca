"""Session helpers: where lineage may be cut."""

from __future__ import annotations

import shutil
import tempfile
import threading
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


# Scratch folders of local sessions, removed when the process ends.
_SCRATCH: list[tempfile.TemporaryDirectory] = []

# Folder of each table that cut lineage, as long as its DataFrame lives.
_TABLES: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()

_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Blocks of each session that release shuffles now, from any thread, and the setting before the first of them.
_RELEASING: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_LOCK = threading.Lock()


def use_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the one the cluster names, a scratch one only in local mode.

    Spark makes a folder per application inside it, which may be dropped when the application ends.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        _SCRATCH.append(tempfile.TemporaryDirectory(prefix="caseloom-ckpt-", ignore_cleanup_errors=True))
        named = _SCRATCH[-1].name
    sc.setCheckpointDir(named)
    return named


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Queries run inside give back their shuffle files as they end.

    Without it the files stay until the driver happens to collect the plan, so a chain of jobs holds the shuffles of all.
    The setting is one for all threads; the last block to end restores what was there before the first.
    """
    with _LOCK:
        held = _RELEASING.setdefault(spark, {"blocks": 0})
        if not held["blocks"]:
            held["before"] = spark.conf.get(_RELEASE, "false")
            spark.conf.set(_RELEASE, "true")
        held["blocks"] += 1
    try:
        yield
    finally:
        with _LOCK:
            held["blocks"] -= 1
            if not held["blocks"]:
                spark.conf.set(_RELEASE, held["before"])


def cut_lineage(df: DataFrame, *used: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and go on from that table.

    Columnar, so later steps read only their columns, and its measured size guides later joins.  Its shuffle files are
    released with the write: a lost executor costs nothing that the table does not hold.  ``used`` are earlier tables
    that nothing else reads; they are dropped once the new one is whole.
    """
    spark = df.sparkSession
    path = f"{use_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    with shuffles_released(spark):
        df.write.parquet(path)
    drop_tables(*used)
    out = spark.read.schema(df.schema).parquet(path)
    _TABLES[out] = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Remove tables of :func:`cut_lineage` whose last reader has ended; any other DataFrame is left alone.

    A folder that pyarrow cannot reach stays: it costs room, never a result.
    """
    for table in tables:
        path = _TABLES.pop(table, None)
        if path is None:
            continue
        got = urlparse(path)
        if got.scheme in ("", "file"):
            shutil.rmtree(got.path, ignore_errors=True)
            continue
        try:
            store, top = fs.FileSystem.from_uri(path)
            store.delete_dir(top)
        except (OSError, pa.ArrowException):
            pass


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that tasks find it without an installation."""
    sc = spark.sparkContext
    if any("/caseloom-package" in f for f in sc.listFiles):
        return
    home = Path(__file__).resolve().parent
    _SCRATCH.append(tempfile.TemporaryDirectory(prefix="caseloom-package-", ignore_cleanup_errors=True))
    ignore = shutil.ignore_patterns("__pycache__")
    shutil.copytree(home, f"{_SCRATCH[-1].name}/in/{home.name}", ignore=ignore)
    sc.addPyFile(shutil.make_archive(f"{_SCRATCH[-1].name}/caseloom-package", "zip", f"{_SCRATCH[-1].name}/in"))


def shuffle_width(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
