"""The session that every entry point and test uses."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Settings that results rely on; sizes are left to the cluster.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def get_session(app: str = "tracklake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the semantic settings; ``master`` only where none is given by spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        cpus = master.partition("[")[2].rstrip("]")
        builder = builder.master(master).config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else str(os.cpu_count()))
        builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for key, value in (SEMANTICS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_shipped_package", None):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="code-")) / f"{package.name}_code.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, str(path.relative_to(package.parent)))
    sc.addPyFile(str(target))
    sc._shipped_package = str(target)
