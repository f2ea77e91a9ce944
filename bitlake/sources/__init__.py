"""Tables on disk: curve-sorted point indexes, bitmaps and their rank/select directories, all Parquet."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from bitlake.operators import bitmaps
from bitlake.operators.spatial import build_index  # noqa: F401


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_directory(bitmap: DataFrame, path: str, files: int | None = None) -> None:
    """A rank/select directory, sorted so that look-ups prune by bitmap and word."""
    d = bitmaps.directory(bitmap)
    files = files or max(1, bitmap.sparkSession.sparkContext.defaultParallelism)
    d.repartitionByRange(files, bitmaps.ID, bitmaps.AT).sortWithinPartitions(bitmaps.ID, bitmaps.AT).write.parquet(path)


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """The directory that write_directory() wrote; its words are the bitmap, too."""
    return spark.read.parquet(path)


_WRITTEN: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that all executors share; only in local mode, where the session may name none, in
    a local one. What stands there goes when the driver's program ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="bitlake-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    if not _WRITTEN:
        atexit.register(_remove_written)
    path = f"{base}/bitlake-{label}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def _remove_written() -> None:
    for path, spark in _WRITTEN.items():
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            return
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
