"""Catalog, split and task tables: joins and filters over clip metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import sampling as SA
from ..operators import temporal as TE

SENSORS = ("srr0", "mrr2", "lrr1")

# Detection classes of the second dataset.
DETECTION = {
    "movable_object.barrier": "barrier", "vehicle.bicycle": "bicycle", "vehicle.bus.bendy": "bus", "vehicle.bus.rigid": "bus", "vehicle.car": "car",
    "vehicle.construction": "construction_vehicle", "vehicle.motorcycle": "motorcycle", "human.pedestrian.adult": "pedestrian", "human.pedestrian.child": "pedestrian",
    "human.pedestrian.construction_worker": "pedestrian", "human.pedestrian.police_officer": "pedestrian", "movable_object.trafficcone": "traffic_cone",
    "vehicle.trailer": "trailer", "vehicle.truck": "truck",
}


def true(c: str) -> Column:
    """A flag whose null counts as no."""
    return F.coalesce(F.col(c), F.lit(False))


def clips(metadata: DataFrame, collection: DataFrame, presence: DataFrame, chunks: DataFrame, ood: DataFrame) -> DataFrame:
    """Metadata of downloaded chunks with collection facts, flags, archive paths and out-of-domain cluster."""
    df = metadata.join(chunks.select("chunk").distinct(), "chunk", "left_semi").join(collection, "clip_id", "left").join(presence, "clip_id", "left")
    df = df.join(ood.select("clip_id", "ood_cluster"), "clip_id", "left").withColumn("has_ood_reasoning", F.col("ood_cluster").isNotNull())
    chunk = F.format_string("chunk_%04d", "chunk")
    paths = {"camera_zip": F.concat(F.lit("camera/"), chunk, F.lit(".zip")), "camera_video": F.concat("clip_id", F.lit(".mp4"))}
    for s in SENSORS:
        paths[f"has_{s}"] = true(f"has_{s}")
        paths[f"radar_{s}_zip"] = F.when(true(f"has_{s}"), F.concat(F.lit(f"radar/{s}/"), chunk, F.lit(".zip")))
        paths[f"radar_{s}_member"] = F.when(true(f"has_{s}"), F.concat("clip_id", F.lit(f".{s}.parquet")))
    for k in ("obstacle", "egomotion"):
        paths[f"{k}_zip"] = F.when(true(f"has_{k}"), F.concat(F.lit(f"labels/{k}/"), chunk, F.lit(".zip")))
        paths[f"{k}_member"] = F.when(true(f"has_{k}"), F.concat("clip_id", F.lit(f".{k}.parquet")))
    df = df.withColumns(paths)
    return df.withColumn("n_front_radars", sum((F.col(f"has_{s}").cast("int") for s in SENSORS), F.lit(0)))


def in_split(split: Column, wanted: str) -> Column:
    """Training folds validation in."""
    return split.isin("train", "val") if wanted == "train" else split == wanted


def profile() -> Column:
    """Which radars a clip has, as S, M, L in one string; none without any."""
    letters = F.concat(*[F.when(true(f"has_{s}"), s[0].upper()).otherwise("") for s in SENSORS])
    return F.coalesce(F.nullif(letters, F.lit("")), F.lit("none"))


def preferred_radar() -> Column:
    return F.coalesce(*[F.when(true(f"has_{s}"), F.lit(s)) for s in reversed(SENSORS)])


def usable(df: DataFrame, split: str, radar: str | None = None, holdout: DataFrame | None = None, extrinsics: bool = True) -> DataFrame:
    """Clips with labels, egomotion and a radar (the named one, else any, long range first); held-out clips only outside training."""
    ok = true("has_obstacle") & true("has_egomotion") & true("clip_is_valid") & (true("has_radar_extrinsics") if extrinsics else F.lit(True))
    df = df.withColumn("sensor", F.when(true(f"has_{radar}"), radar) if radar else preferred_radar()).where(ok & F.col("sensor").isNotNull())
    if holdout is None:
        return df.where(in_split(F.col("split"), split))
    inside = df.where(in_split(F.col("split"), split)).join(holdout, "clip_id", "left_anti")
    return inside if split == "train" else inside.unionByName(df.join(holdout, "clip_id", "left_semi"))


def claimed_by_first(df: DataFrame, radars: list[str]) -> DataFrame:
    """Each clip for the first radar in the list that it has."""
    return df.withColumn("radar", F.coalesce(*[F.when(true(f"has_{x}"), F.lit(x)) for x in radars])).where("radar IS NOT NULL")


def night() -> Column:
    return (F.col("hour_of_day") >= 20) | (F.col("hour_of_day") <= 5)


def detection_boxes(annotations: DataFrame, kinds: dict[str, str] = DETECTION) -> DataFrame:
    """Annotations of detection classes; others go."""
    return annotations.withColumn("label", N.lookup(F.col("category"), kinds)).where("label IS NOT NULL")


def wide_samples(samples: DataFrame, data: DataFrame, channels: list[str], counts: DataFrame) -> DataFrame:
    """One row per sample with a path per channel and the number of its boxes (0 without)."""
    wide = data.groupBy("sample_token").pivot("channel", channels).agg(F.first("path"))
    wide = wide.withColumnsRenamed({c: f"path_{c}" for c in channels})
    return samples.join(wide, "sample_token", "left").join(counts, "sample_token", "left").withColumn("n_boxes", F.coalesce("n_boxes", F.lit(0)))


def tracking_clips(tracks: DataFrame, base: DataFrame, least: int = 30) -> DataFrame:
    """Clips with long tracks: how many, moving ones, the longest and the median length."""
    long = tracks.where(F.col("n_obs") >= least)
    stats = long.groupBy("clip_id").agg(F.count("*").alias("n_long"), F.count_if(~F.col("is_stationary")).alias("n_moving"), F.max("duration_s").alias("longest_s"), F.median("n_obs").alias("median_obs"))
    return base.join(stats, "clip_id")


def agents(tracks: DataFrame, base: DataFrame, least: int = 60, inside: float = 0.5, path: float = 2.0) -> DataFrame:
    """Moving tracks that are mostly in the forward sector, with their clip's columns."""
    chosen = tracks.where((F.col("n_obs") >= least) & ~F.col("is_stationary") & (F.col("frac_in_front_fov") >= inside) & (F.col("world_path_len_m") >= path))
    return chosen.drop("chunk").join(base, "clip_id")


def ego_windows(base: DataFrame) -> DataFrame:
    """Windows of two seconds back and three ahead, every two seconds."""
    return base.withColumn("t0", F.explode(F.sequence(F.lit(2), F.lit(16), F.lit(2))))


def keyframes_with_context(samples: DataFrame, before: int = 4, after: int = 6) -> DataFrame:
    return TE.with_context(samples, ["scene_token"], ["timestamp"], before, after)


def slices(base: DataFrame) -> dict[str, DataFrame]:
    """Validation by day, by night and by region."""
    val = base.where("split = 'val'")
    out = {"day": val.where(~night()), "night": val.where(night())}
    return out | {f"region_{r}": val.where(F.col("country").isin(*cs)) for r, cs in {"us": ["United States"], "eu": ["Germany", "France", "Spain", "Italy"]}.items()}


def domains(base: DataFrame, source: str, target: str) -> dict[str, DataFrame]:
    """Clips of one radar configuration, of another, and those with two front radars."""
    return {"source": base.where(F.col("radar_config") == source), "target": base.where(F.col("radar_config") == target), "paired": base.where(F.col("n_front_radars") >= 2)}


def profile_counts(base: DataFrame) -> DataFrame:
    return base.withColumn("profile", profile()).groupBy("profile", "split").agg(F.count("*").alias("n"))


def retrieval(base: DataFrame, queries: DataFrame, events: str = "events") -> tuple[DataFrame, DataFrame]:
    """The corpus with a flag of clips that a query names, and one row per query event."""
    rows = queries.withColumn("e", F.explode(F.from_json(events, "array<struct<start_frame:int,description:string>>")))
    rows = rows.select("clip_id", "e.start_frame", "e.description").dropna(subset=["description"])
    corpus = base.join(rows.select("clip_id").distinct().withColumn("_q", F.lit(True)), "clip_id", "left").withColumn("is_query", true("_q")).drop("_q")
    return corpus, rows


def holdout(qa: DataFrame, n: int | None = None) -> DataFrame:
    """The clips of the checked questions; or the n that come first by hash."""
    return SA.hash_holdout(qa, "clip_id", n) if n else qa.select("clip_id").distinct()


def extrinsics_index(base: DataFrame, extrinsics: DataFrame) -> DataFrame:
    """Clips with the sorted names of their calibrated radars."""
    radars = extrinsics.where(F.col("sensor_name").rlike("radar")).groupBy("clip_id").agg(F.array_join(F.array_sort(F.collect_set("sensor_name")), ",").alias("radar_extrinsics_sensors"))
    return base.join(radars, "clip_id", "left").withColumn("has_radar_extrinsics", F.col("radar_extrinsics_sensors").isNotNull())


def eligible_chunks(listed: DataFrame, needed: list[str], any_of: list[str]) -> DataFrame:
    """Chunks that have all needed components and at least one of the radars; listed: chunk, component, bytes."""
    out = listed.groupBy("chunk").agg(F.count_distinct(F.when(F.col("component").isin(needed), F.col("component"))).alias("k"), F.count_if(F.col("component").isin(any_of)).alias("r"), F.sum("bytes").alias("bytes"))
    return out.where((F.col("k") == len(needed)) & (F.col("r") > 0)).select("chunk", "bytes")


def download_plan(listed: DataFrame, done: DataFrame, needed: list[str], any_of: list[str], first: int, bytes_per_s: float) -> DataFrame:
    """The next chunks to fetch with running bytes and seconds."""
    todo = eligible_chunks(listed, needed, any_of).join(done, "chunk", "left_anti").orderBy("chunk").limit(first)
    up_to = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    return todo.withColumn("bytes_so_far", F.sum("bytes").over(up_to)).withColumn("eta_s", F.col("bytes_so_far") / bytes_per_s)


def metadata_tables(scene: DataFrame, sample: DataFrame, data: DataFrame, annotation: DataFrame, instance: DataFrame, category: DataFrame, calibrated: DataFrame, sensor: DataFrame, log: DataFrame) -> dict[str, DataFrame]:
    """Scenes, samples, keyframe data and annotations of the second dataset with names in place of tokens."""
    named = lambda df, **names: df.select(*[F.col(old).alias(new) for new, old in names.items()])
    scenes = scene.join(named(log, log_token="token", location="location"), "log_token", "left").withColumnRenamed("token", "scene_token")
    samples = sample.withColumnRenamed("token", "sample_token").join(scenes.select("scene_token", "name", "location"), "scene_token", "left")
    channels = named(calibrated, calibrated_sensor_token="token", sensor_token="sensor_token").join(named(sensor, sensor_token="token", channel="channel"), "sensor_token", "left").drop("sensor_token")
    frames = data.where("is_key_frame").withColumnRenamed("filename", "path").join(channels, "calibrated_sensor_token", "left")
    kinds = named(instance, instance_token="token", category_token="category_token").join(named(category, category_token="token", category="name"), "category_token", "left").drop("category_token")
    boxes = annotation.join(kinds, "instance_token", "left").join(samples.select("sample_token", "scene_token", "timestamp"), "sample_token", "left")
    return {"scenes": scenes, "samples": samples, "sample_data": frames, "annotations": boxes}


def check_splits(tables: dict[str, DataFrame], key: str = "clip_id") -> DataFrame:
    """Every pair of splits with the number of keys that both hold; all must be 0."""
    parts = [df.select(F.lit(name).alias("split"), key).distinct() for name, df in tables.items()]
    seen = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("s"))
    pairs = seen.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))
