"""Loader branches: each source as items (clip_id, task, frame, prompt, target), and their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X

COLUMNS = ("clip_id", "task", "frame", "prompt", "target")
LONGEST = 4000
NO_RADAR = "No radar is available for this clip."


def _rows(df: DataFrame, task, prompt, target, frame=None) -> DataFrame:  # noqa: ANN001
    return df.select("clip_id", (F.lit(task) if isinstance(task, str) else task).alias("task"), (F.col("frame") if frame is None else frame).cast("int").alias("frame"), prompt.alias("prompt"), target.alias("target"))


def qa(docs: DataFrame, keep: DataFrame, holdout: DataFrame | None = None, cot: bool = False) -> DataFrame:
    """Questions with their options; with reasoning, only those whose claims don't disagree with the labels."""
    docs = docs.join(keep, "clip_id", "left_semi")
    docs = docs.join(holdout, "clip_id", "left_anti") if holdout is not None else docs
    rows = docs.select("clip_id", F.explode("qa").alias("q"))
    prompt = F.concat_ws("\n", "q.question", X.options_text(F.col("q.options")))
    frame = X.frame_reference(F.col("q.question"))
    if not cot:
        return _rows(rows, "qa", prompt, F.col("q.answer"), frame)
    rows = rows.where(F.coalesce(F.col("q.verification.status"), F.lit("unchecked")) != "disagrees").where(F.coalesce("q.rationale", F.lit("")) != "")
    return _rows(rows, "qa_cot", F.concat(F.rtrim(prompt), F.lit(' Answer as JSON with "rationale" and "answer".')), X.reasoned(F.col("q.rationale"), F.col("q.answer")), frame)


def descriptions(frames: DataFrame, clips: DataFrame, keep: DataFrame) -> DataFrame:
    ask = lambda c: F.concat(F.lit("Describe the scene: "), c, F.lit("."))
    one = _rows(frames.where(~F.col("kind").isin("context", "qa_summary")), F.concat(F.lit("desc_"), "kind"), ask(F.col("kind")), F.col("text"))
    two = _rows(clips, F.lit("desc_clip"), F.lit("Describe the clip."), F.col("text"), F.lit(11))
    return one.unionByName(two).join(keep, "clip_id", "left_semi")


def radar_probe(features: DataFrame, sensor: str, coarse: bool = False) -> DataFrame:
    """A count question whose form turns with the frame; the coarse one answers in bands."""
    form = F.pmod("frame", F.lit(3))
    step = {0: 50, 1: 10, 2: 10}
    columns = {0: f"{sensor}_n_points", 1: f"{sensor}_n_moving", 2: f"{sensor}_p90_range"}
    asks = {0: "How many detections does the radar return?", 1: "How many detections move?", 2: "Within what range are nine tenths of the detections?"}
    value = F.when(form == 0, F.col(columns[0]).cast("double")).when(form == 1, F.col(columns[1]).cast("double")).otherwise(F.col(columns[2]))
    if coarse:
        value = F.when(form == 0, N.band(F.col(columns[0]).cast("double"), step[0])).when(form == 1, N.band(F.col(columns[1]).cast("double"), step[1])).otherwise(N.band(F.col(columns[2]), step[2]))
    prompt = F.when(form == 0, asks[0]).when(form == 1, asks[1]).otherwise(asks[2])
    return _rows(features.where(F.col(columns[0]).isNotNull()), "radar_probe_coarse" if coarse else "radar_probe", prompt, N.fixed(value))


def radar_transfer(features: DataFrame, a: str = "lrr1", b: str = "mrr2") -> DataFrame:
    """What one radar would return, asked where both were there."""
    both = features.where(F.col(f"{a}_n_points").isNotNull() & F.col(f"{b}_n_points").isNotNull())
    even = F.pmod("frame", F.lit(2)) == 0
    return _rows(both, "radar_transfer", F.when(even, "How many detections does the other radar return?").otherwise("How many of its detections move?"), F.when(even, F.col(f"{b}_n_points")).otherwise(F.col(f"{b}_n_moving")).cast("string"))


def from_table(items: DataFrame, tasks: list[str], split: list[str], keep: DataFrame) -> DataFrame:
    rows = items.where(F.col("task").isin(tasks) & F.col("split").isin(split)).join(keep, "clip_id", "left_semi")
    return _rows(rows, F.col("task"), F.col("prompt"), F.col("target"))


def probes(table: DataFrame, task: str, forms: list[str], keep: DataFrame) -> DataFrame:
    return _rows(table.where(F.col("form").isin(forms)).join(keep, "clip_id", "left_semi"), task, F.col("prompt"), F.col("target"))


def retrieval(clips: DataFrame, features: DataFrame, anchor: int = 11) -> DataFrame:
    """Tags of a clip: place, time of day, traffic and pace; unknown ones are left out."""
    df = clips.join(features.where(F.col("frame") == anchor), "clip_id")
    when = F.when((F.col("hour_of_day") >= 20) | (F.col("hour_of_day") <= 5), "night").when(F.col("hour_of_day").isNotNull(), "day")
    traffic = F.when(F.col("n_tracks") == 0, "empty").when(F.col("n_tracks") < 5, "light traffic").otherwise("dense traffic")
    return _rows(df, "retrieval", F.lit("Tags for this clip?"), F.concat_ws("; ", F.lower("country"), when, traffic, F.when(F.col("ego_speed") < 0.5, "standing")), F.lit(anchor))


def ood(events: DataFrame, rate: int = 30, last: int = 20) -> DataFrame:
    """Reasoning about odd events at the frame in which they begin."""
    frame = F.least(F.greatest(F.expr(f"start_frame div {rate}") + 1, F.lit(1)), F.lit(last))
    return _rows(events, "ood_reasoning", F.lit("What is unusual here?"), F.col("description"), frame)


def load(branches: list[DataFrame], longest: int = LONGEST) -> DataFrame:
    """The branches' union without items that are too long to train on."""
    return reduce(DataFrame.unionByName, branches).where(F.length("prompt") + F.length("target") <= longest)


def refuse_without_sensor(items: DataFrame, sensors: DataFrame, tasks: list[str]) -> DataFrame:
    """Tasks that only radar can answer get a refusal where the clip has none."""
    df = items.join(sensors.select("clip_id", "sensor"), "clip_id", "left")
    return df.withColumn("target", F.when(F.col("sensor").isNull() & F.col("task").isin(tasks), F.lit(NO_RADAR)).otherwise(F.col("target"))).drop("sensor")


def counts(items: DataFrame) -> DataFrame:
    return items.groupBy("task").agg(F.count("*").alias("n"))


def expand_tasks(spec: Column, trained: list[str]) -> Column:
    """The tasks of a comma-separated list, each once in the order of its first mention; ``all`` stands for the trained ones."""
    named = F.filter(F.transform(F.split(spec, ","), lambda t: F.trim(t)), lambda t: t != "")
    every = F.array(*[F.lit(t) for t in trained])
    return F.array_distinct(F.flatten(F.transform(named, lambda t: F.when(t == "all", every).otherwise(F.array(t)))))


def ego_text(states: DataFrame, by: list[str], label: str, order: str, speed: str, accel: str, yaw: str) -> DataFrame:
    """The ego's binned states up to now as one text: label, then s, a and y with their bins."""
    said = F.concat(F.col(label), *[F.concat(F.lit(k), F.col(c).cast("string")) for k, c in ((":s", speed), ("a", accel), ("y", yaw))])
    return states.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), said.alias("s")))), lambda x: x["s"]), " ").alias("ego"))
