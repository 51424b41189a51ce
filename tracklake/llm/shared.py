"""Folders and tables that the driver and all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: The folders of the tables that store() made and drop() hasn't removed.
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one, but only if all runs on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="shared-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint df in the shared folder: later jobs start from that copy, whatever its columns are called."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it from there.

    Unlike after a checkpoint the planner knows the size of what it reads, and drop() can remove the table as soon
    as the tables made from it stand. One that a returned result reads stays in the folder. Column names must
    differ by more than case.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def drop(*tables: DataFrame, shuffles: bool = False) -> None:
    """Remove tables that store() made; with ``shuffles`` also the shuffle files that no plan refers to any more.

    Spark removes those when the driver's JVM collects its garbage, which can be after many large steps.
    """
    for table in tables:
        remove(table.sparkSession, _FOLDERS.pop(table))
    if shuffles:
        gc.collect()
        tables[0].sparkSession._jvm.System.gc()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, in whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def rekey(column: Column, kind: str) -> Column:
    """The same value under an expression that Catalyst doesn't follow.

    An aggregate's output is already partitioned by its key, and a join on that key would reuse this
    exchange; then adaptive execution can't split a hot key of the other side. Under a new expression
    both sides of the join get exchanges of their own, and skewed partitions are split.
    """
    return F.concat(column, F.lit("")) if kind == "string" else column.bitwiseXOR(F.lit(0).cast(kind))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
