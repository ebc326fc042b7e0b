"""Where intermediate tables go, and how lineage is cut.

Everything that is read more than once is written as Parquet under the folder
that the cluster names in ``spark.checkpoint.dir``; a lost executor then costs
a re-read, not a recomputation, and every executor sees the same files.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


#: Folders of our own, and the innermost ``scratch``, by application.
_local: dict[str, str] = {}
_inside: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; a local one of our own only for a local master without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = spark.sparkContext.applicationId
    if own not in _local:
        _local[own] = tempfile.mkdtemp(prefix="spark-scratch-")
    return _local[own]


#: Bytes of rows that Python workers are given at once; Spark's own default, 64 MB, is three times that with copies.
BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for rows that hold whole texts, unless the session sets its own size."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, BATCH_BYTES)


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/reelspan-{spark.sparkContext.applicationId}"


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one, or that of the ``scratch`` that it is in."""
    return _own_dir(spark) + _inside.get(spark.sparkContext.applicationId, "")


def stored(df: DataFrame, name: str) -> str:
    """``df`` written to the shared folder: where."""
    path = f"{run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again with its own schema."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name))


def release_shuffles(spark: SparkSession) -> None:
    """Shuffle files of queries that are over go now: Spark removes them when the driver's collector finds that no plan needs them, else every half hour."""
    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written within goes at the end, and the session's batch size is as before; consume results inside.

        with scratch(spark):
            remove_repeats(docs).write.parquet(out)
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, outer = spark.conf.get(name), _inside.get(spark.sparkContext.applicationId, "")
    _inside[spark.sparkContext.applicationId] = own = f"{outer}/{uuid.uuid4().hex}"
    try:
        yield
    finally:
        remove(spark, f"{_own_dir(spark)}{own}")
        _inside[spark.sparkContext.applicationId] = outer
        spark.conf.set(name, before)


def outlived(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> tuple[DataFrame, str]:
    """What ``make`` returns, written beside the scratch of its making, which goes; and where it is."""
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with scratch(spark):
        made = make()
        made.write.option("compression", "zstd").parquet(path)
        shape = made.schema
    return spark.read.schema(shape).parquet(path), path


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Removes all that this application has written here; results that still read it are then lost."""
    remove(spark, _own_dir(spark))
