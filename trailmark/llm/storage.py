"""Shared-folder tables that cut lineage and survive the loss of executors.

Everything is written below ``spark.checkpoint.dir``, which driver and executors
share.  Where a local session has no such setting (unit tests, a laptop) a temporary
folder is set as the checkpoint folder; on a cluster that is an error, since no other
machine would see it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` as a URI; on one machine a temporary one if unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return qualified(spark, path).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark would take, so that other readers take the same."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it from there.

    Later stages then depend on files that every executor sees, so a lost
    executor never forces (or changes) the work before this point.
    """
    return table(df, name)[0]


def table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``materialize``, with the path to ``delete`` when the table is used up."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    if path in _made:
        _made.remove(path)


@atexit.register
def _cleanup() -> None:
    """What is left when the driver ends; the session may be gone by then."""
    for path in _made:
        try:
            files, at = pafs.FileSystem.from_uri(path)
            files.delete_dir(at)
        except Exception:  # a store that is out of reach: the folder's owner cleans up
            continue
