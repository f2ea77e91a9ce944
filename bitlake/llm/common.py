"""Shared helpers: word patterns, table access, materialised intermediates."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only in local mode, where the session may name none (tests), is one made."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="bitlake-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_WRITTEN: dict[str, SparkSession] = {}


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path of its own under the shared folder. What stands there goes when the driver's program ends."""
    if not _WRITTEN:
        atexit.register(_remove_written)
    path = f"{shared_dir(spark)}/bitlake-{label}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def _remove_written() -> None:
    for path, spark in _WRITTEN.items():
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            return
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str = "part") -> DataFrame:
    """Write df once under the shared folder and read it back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(batches):
    """batches of a worker's task. At their end, memory that the worker has freed goes back to the system: the worker
    waits for its next task beside the JVM, in the same executor."""
    import pyarrow as pa

    yield from batches
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def scratch(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    name, taken = f"__{stem}", {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
