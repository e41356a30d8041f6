"""Session settings, table access and durable intermediate results shared by the whole package."""

from __future__ import annotations

import builtins
import ctypes
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Functions sent to executors travel by value, so workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules["campovia"])

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what the context was given for checkpoints.

    Only where driver and executors are one process a temporary folder takes its place; on a cluster a missing setting is an
    error, for each executor would write to its own disk and later reads would miss rows.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if sc.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="campovia-checkpoints-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir()
    return root


def durable(df: DataFrame) -> DataFrame:
    """Write df to the shared folder once and read it back: the lineage ends at files that outlive any executor.

    The files are removed when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/campovia-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, own = _file(spark, path)
    fs.deleteOnExit(own)
    written = spark.read.schema(df.schema).parquet(path)
    written._campovia_path = path
    return written


def bucketed(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """Write df to the shared folder in buckets by a column and read it back: groups of that column need no further shuffle of it.

    The catalogue's entry goes at once, for only this very DataFrame reads the files; they are removed when the JVM ends.
    """
    spark = df.sparkSession
    name = f"campovia_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(name)
    fs, own = _file(spark, path)
    fs.deleteOnExit(own)
    written = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return written


def discard(written: DataFrame) -> None:
    """Remove what durable wrote for this very DataFrame, once nothing will read it any more."""
    fs, own = _file(written.sparkSession, written._campovia_path)
    fs.delete(own, True)


def _file(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a path, and the path as it takes it."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def per_process(key: tuple, make):
    """A value made once in each worker process and kept for its later tasks (functions travel by value, module state doesn't)."""
    store = builtins.__dict__.setdefault("_campovia_worker", {})
    if key not in store:
        store[key] = make()
    return store[key]


def give_back() -> None:
    """Return a worker's freed memory to the system: workers live on and share an executor's limit with its other ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
