"""Readers: everything becomes a DataFrame with a declared schema, read by the executors."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import conform


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """Parquet with only some columns; with a schema, optional columns that a file lacks are null."""
    df = spark.read.parquet(path)
    df = conform(df, schema) if schema else df
    return df.select(*columns) if columns else df


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document or array of records per file, with the file's path."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, broken ones go to ``_corrupt`` instead of vanishing."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def _arrow(schema: str, spark: SparkSession) -> pa.Schema:
    return spark.createDataFrame([], schema).toArrow().schema


def zip_members(spark: SparkSession, path: str, suffix: str, schema: str) -> DataFrame:
    """The Parquet members of zip archives whose name holds ``suffix``, with clip_id from the name's start.

    An archive is one row of the binary-file source, so archives spread over tasks. A member that can't be
    read gives one row with its error.
    """
    kind = _arrow(schema, spark)
    names = [n for n in kind.names if n != "clip_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    for member in sorted(archive.namelist()):
                        if suffix not in member:
                            continue
                        clip = member.rsplit("/", 1)[-1].split(suffix)[0]
                        try:
                            table, error = pq.read_table(io.BytesIO(archive.read(member))), None
                        except (pa.ArrowInvalid, OSError) as e:
                            table, error = None, str(e)
                        n = 1 if table is None else table.num_rows
                        columns = [pa.array([clip] * n)]
                        for name in names:
                            given = table is not None and name in table.column_names
                            columns.append(table.column(name).cast(kind.field(name).type).combine_chunks() if given else pa.nulls(n, kind.field(name).type))
                        columns.append(pa.array([error] * n, pa.string()))
                        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks) for c in columns], ["clip_id", *names, "error"])

    files = spark.read.format("binaryFile").load(path).select("content")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.createDataFrame([], schema).schema if f.name != "clip_id")
    return files.mapInArrow(read, f"clip_id string, {fields}, error string")


#: A packed point of a radar file: 43 bytes, unaligned. Fixed values of the format.
POINT = np.dtype([
    ("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("dyn_prop", "i1"), ("id", "<i2"), ("rcs", "<f4"), ("vx", "<f4"), ("vy", "<f4"), ("vx_comp", "<f4"), ("vy_comp", "<f4"),
    ("is_quality_valid", "i1"), ("ambig_state", "i1"), ("x_rms", "i1"), ("y_rms", "i1"), ("invalid_state", "i1"), ("pdh0", "i1"), ("vx_rms", "i1"), ("vy_rms", "i1"),
])


def radar_points(spark: SparkSession, path: str) -> DataFrame:
    """Binary point clouds: a text header that ends in ``DATA binary`` and gives POINTS, then packed records."""
    wanted = ["x", "y", "z", "dyn_prop", "rcs", "vx", "vy", "vx_comp", "vy_comp", "invalid_state", "ambig_state"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                head, _, body = content.partition(b"DATA binary\n")
                n = next(int(line.split()[1]) for line in head.decode("ascii", "replace").splitlines() if line.startswith("POINTS"))
                points = np.frombuffer(body, POINT, count=n)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(n)), *[pa.array(points[w].astype(np.float64)) for w in wanted]], ["path", "point", *wanted])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, "path string, point long, " + ", ".join(f"{w} double" for w in wanted))


def log_matches(spark: SparkSession, path: str, pattern: str, names: list[str]) -> DataFrame:
    """The groups of a pattern in the lines of text files that match it."""
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(*[F.regexp_extract("value", pattern, i + 1).alias(n) for i, n in enumerate(names)])


def row_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Rows of several Parquet tables, from their footers."""
    parts = [spark.read.parquet(p).agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder with size and time, without reading them."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """MD5 of each file; files whose digest is known are left out by an anti-join with an earlier result."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.md5("content").alias("md5"))


def lens(intrinsics: DataFrame) -> DataFrame:
    """Camera models parsed from their JSON column."""
    from ..schemas import LENS

    return intrinsics.withColumn("lens", F.from_json("model_parameters", LENS))
