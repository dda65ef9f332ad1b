"""Tables written to the shared folder that the cluster names, to cut lineage and to survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``; a temporary one only where that is unset and all is one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark, "_sparkloom_tables", None) or "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark._sparkloom_tables = base
    return f"{base.rstrip('/')}/rows-{uuid.uuid4().hex}"


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have what is at the path deleted when the driver ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def folder(spark: SparkSession) -> str:
    """A new path in a new folder, which is deleted when the driver ends."""
    parent = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    parent.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(parent)
    delete_at_exit(spark, parent.toString())
    return f"{parent.toString()}/table"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as parquet and read again. :func:`discard` deletes it; what is left goes when the driver ends."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    delete_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete tables made by :func:`stored` that no later plan reads."""
    for df in frames:
        files = df.inputFiles()
        if files:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            if path.getName().startswith("rows-"):
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
