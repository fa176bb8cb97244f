"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, one is set under the warehouse if driver and executors are one process; a cluster must name it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoint"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/tables"


_written: list[str] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors. by: a column that later reads filter on."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    kept = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        if kept is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, kept)
    _written.append(path)
    again = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    _paths[again] = path
    return again


def _delete(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*frames: DataFrame) -> None:
    """Deletes what stored() wrote for these, which nothing reads any more."""
    for frame in frames:
        name = _paths.pop(frame)
        _written.remove(name)
        _delete(frame.sparkSession, name)


def discard_parts(frame: DataFrame, by: str, *values: object) -> None:
    """Deletes the parts of such values of what stored(by=by) wrote, which nothing reads any more."""
    for value in values:
        _delete(frame.sparkSession, f"{_paths[frame]}/{by}={value}")


def drop_stored(spark: SparkSession) -> int:
    """Deletes the tables that stored() wrote in this process, once no result that reads them is needed; how many."""
    gone = 0
    while _written:
        gone += bool(_delete(spark, _written.pop()))
    return gone
