"""Streaming forms: windows with watermarks, stateful history, and the watcher of new results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, schema: str, kind: str = "parquet", per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def tumbling(stream: DataFrame, ts: str, size: str, by: list[str], value: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums per window; rows later than the watermark are dropped."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.withWatermark(ts, late).groupBy(window.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select("w.start", "w.end", *by, "n", "total")


def sessions(stream: DataFrame, ts: str, gap: str, by: list[str], late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n")).select("w.start", "w.end", *by, "n")


def history(stream: DataFrame, key: str, order: str, text: str, size: int) -> DataFrame:
    """For each arriving row the texts of up to ``size`` rows of its key before it, oldest first; state is only these texts."""
    fields = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = f"`{key}` {fields[key]}, `{order}` {fields[order]}, history string"

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(batches).sort_values(order)
        out = []
        for at, said in zip(rows[order], rows[text], strict=True):
            out.append((keys[0], at, "\n".join(f"t-{len(held) - i}s: {h}" for i, h in enumerate(held)) or "t-1s: none"))
            held = [*held, "none" if said is None else said][-size:]
        state.update((held,))
        yield pd.DataFrame(out, columns=[key, order, "history"])

    return stream.groupBy(key).applyInPandasWithState(step, schema, "held array<string>", "append", "NoTimeout")


def new_steps(stream: DataFrame, step: str, stride: int, ts: str, late: str = "30 days") -> DataFrame:
    """Each step once, and only multiples of the stride: the watcher's input."""
    return stream.where(F.col(step) % stride == 0).withWatermark(ts, late).dropDuplicatesWithinWatermark([step])


def append_rows(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):  # noqa: ANN201
    """A started query that appends to a JSON log; the checkpoint remembers what is done."""
    return stream.writeStream.format("json").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
