"""Writers on Spark's commit protocol: a failed job leaves nothing half-written."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def json_lines(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """JSON lines, a folder per task or clip."""
    writer = df.write
    (writer.partitionBy(*by) if by else writer).json(path)


def if_absent(df: DataFrame, path: str) -> None:
    """Nothing happens where the table is there already."""
    df.write.mode("ignore").parquet(path)


def only_new(df: DataFrame, path: str, key: str) -> None:
    """Append the shards (values of key) that the table doesn't have: a restarted job does only what is missing."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    if there:
        df = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    df.write.mode("append").partitionBy(key).parquet(path)


def version(df: DataFrame, base: str, number: int) -> str:
    """A new version beside the old ones; inputs are never overwritten."""
    path = f"{base}/v={number}"
    df.write.mode("errorifexists").parquet(path)
    return path


def manifest(spark: SparkSession, values: dict, path: str) -> None:
    """A configuration or manifest as one JSON line."""
    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def bundle(items: DataFrame, path: str) -> None:
    """A bundle: items by task and a table of clips with their item counts and tasks."""
    items.write.partitionBy("task").json(f"{path}/by_task")
    clips = items.groupBy("clip_id").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_set("task")).alias("tasks"), F.count_distinct("frame").alias("n_frames"))
    clips.write.json(f"{path}/clips")


def verify_bundle(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Per task the counts expected and found, and whether they agree."""
    found = spark.read.json(f"{path}/by_task").groupBy("task").agg(F.count("*").alias("found"))
    return expected.join(found, "task", "full").withColumn("ok", F.col("expected").eqNullSafe(F.col("found")))
