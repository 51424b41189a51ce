"""Scene features per clip and second, probes, point clouds and descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import numbers as N
from ..functions import text as X
from ..operators import temporal as TE
from ..operators import tracks as TR

CLASSES = ("automobile", "heavy_truck", "person", "rider", "bus", "trailer", "train_or_tram_car", "animal", "stroller", "protruding_object")


def rig_points(radar: DataFrame, extrinsics: DataFrame) -> DataFrame:
    """Radar returns in the rig's frame (x, y, z), with seconds and the scan's time."""
    pose = extrinsics.select("clip_id", F.col("sensor_name").alias("sensor"), *[F.col(q) for q in ("qx", "qy", "qz", "qw")], *[F.col(c).alias(f"o{c}") for c in "xyz"])
    df = radar.join(pose, ["clip_id", "sensor"])
    p = G.to_parent(G.rotation(*[F.col(q) for q in ("qx", "qy", "qz", "qw")]), tuple(F.col(f"o{c}") for c in "xyz"), G.spherical(F.col("azimuth"), F.col("elevation"), F.col("distance")))
    return df.withColumns(dict(zip("xyz", p, strict=True))).withColumn("t", F.col("timestamp") / 1e6).drop("qx", "qy", "qz", "qw", "ox", "oy", "oz")


def moving_returns(points: DataFrame, ego: DataFrame, limit: float = 1.0) -> DataFrame:
    """Returns with the residual that the ego's own speed leaves, and whether it means motion."""
    df = TE.nearest_join(points, ego, ["clip_id"], "t", ["speed"])
    res = G.doppler_residual(tuple(F.col(c) for c in "xyz"), F.col("radial_velocity"), (F.col("near.speed"), F.lit(0.0), F.lit(0.0)), F.col("doppler_ambiguity"))
    return df.withColumn("residual", res).withColumn("moving", F.col("residual") > limit).drop("near")


def nearest_scan(grid: DataFrame, points: DataFrame, key: list[str] = ["clip_id", "sensor"]) -> DataFrame:  # noqa: B006
    """For each grid row all returns of the scan nearest in time."""
    scans = points.select(*key, "t").distinct()
    at = TE.nearest_join(grid, scans, key, "t", []).withColumn("scan_t", F.col("near.t")).drop("near")
    return at.join(points.withColumnRenamed("t", "scan_t"), [*key, "scan_t"])


def scene_features(clips: DataFrame, ego: DataFrame, boxes: DataFrame, points: DataFrame, frames: int = 21, window: float = 0.6) -> DataFrame:
    """One row per clip and second: the ego's state, tracks in the forward sector, and each radar's scan."""
    grid = clips.select("clip_id", F.explode(F.sequence(F.lit(1), F.lit(frames))).alias("frame")).withColumn("t", (F.col("frame") - 1).cast("double"))
    out = TE.nearest_join(grid, ego, ["clip_id"], "t", ["speed", "yaw_rate", "travelled"])
    out = out.select("clip_id", "frame", "t", *[F.col(f"near.{c}").alias(f"ego_{c}") for c in ("speed", "yaw_rate", "travelled")])
    seen = TE.band_join(grid, boxes.withColumnRenamed("t", "bt"), ["clip_id"], "t", window, "bt").withColumn("rng", F.hypot("cx", "cy")).where(G.in_front(F.col("cx"), F.col("cy")))
    counts = TR.frame_counts(seen, ["clip_id", "frame"], "track_id", "label_class", "rng", F.coalesce(F.col("speed") > 1, F.lit(False)), CLASSES)
    out = out.join(counts, ["clip_id", "frame"], "left").fillna(0, ["n_tracks", "n_moving", *[f"n_{c}" for c in CLASSES]])
    for sensor in ("srr0", "mrr2", "lrr1"):
        scan = nearest_scan(grid.withColumn("sensor", F.lit(sensor)), points.where(F.col("sensor") == sensor))
        stats = TR.scan_stats(scan, ["clip_id", "frame"], "rcs", "distance", F.col("moving")).withColumnsRenamed({c: f"{sensor}_{c}" for c in ("n_points", "n_moving", "max_strength", "mean_strength", "p90_range")})
        out = out.join(stats, ["clip_id", "frame"], "left")  # no row: no sensor; the columns are there all the same
    for c, (lo, hi) in {"ego_speed": (0.0, 32.0), "n_tracks": (0.0, 32.0), "nearest_range": (0.0, 64.0)}.items():
        out = out.withColumn(f"{c}_bin", N.digitise(F.col(c).cast("double"), lo, hi, 32))
    return out


def point_cloud(scans: DataFrame, key: list[str], size: int = 1024) -> DataFrame:
    """The first points of each scan: movers, then strong returns, then in their order; ``slot`` from 0."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("moving"), F.desc("rcs"), "point"))
    return scans.withColumn("slot", rank - 1).where(F.col("slot") < size)


def occupancy(scans: DataFrame, key: list[str]) -> DataFrame:
    """The cells of a forward polar grid that moving returns occupy."""
    cells = scans.where("moving").withColumn("cell", G.grid_cell(F.col("x"), F.col("y"))).where("cell IS NOT NULL")
    return TR.window_occupancy(cells, key, "cell", 48)


def structure_probes(scans: DataFrame, key: list[str]) -> DataFrame:
    """Questions about a scan's structure; the form rotates by a hash of its key."""
    s = TR.scan_structure(scans, key, "azimuth", "distance", "radial_velocity")
    forms = [("bearing", F.degrees("bearing")), ("lateral", (F.col("n_left") - F.col("n_right")).cast("double")), ("closing", F.col("closing")), ("near_far", F.col("n_near").cast("double")), ("spread", F.degrees("spread"))]
    place = X.rotate_by_sha1(F.concat_ws("_", *key), len(forms))
    pick = lambda values: F.element_at(F.array(*values), place + 1)
    return s.select(*key, pick([F.lit(n) for n, _ in forms]).alias("form"), F.concat(F.lit("What is the scan's "), pick([F.lit(n) for n, _ in forms]), F.lit("?")).alias("prompt"), N.fixed(pick([v for _, v in forms]), 1).alias("target"))


def object_probes(evidence: DataFrame, key: list[str]) -> DataFrame:
    """Questions about lit objects: the first usable form in an order that a hash rotates; frames without one give nothing."""
    e = evidence.groupBy(*key).agg(F.count_if(F.col("n_points") > 0).alias("n_illuminated"), F.min_by(F.struct("median_range", "median_azimuth", "n_points"), F.struct("median_range", "box")).alias("near"))
    forms = F.array(*[F.struct(F.lit(n).alias("form"), v.cast("double").alias("value")) for n, v in (("illuminated", F.col("n_illuminated")), ("range", F.col("near.median_range")), ("azimuth", F.col("near.median_azimuth")), ("detections", F.nullif(F.col("near.n_points"), F.lit(0))))])
    e = e.withColumn("forms", forms).withColumn("k", X.rotate_by_sha1(F.concat_ws("_", *key), 4))
    turned = F.concat(F.expr("slice(forms, k + 1, 4)"), F.when(F.col("k") > 0, F.expr("slice(forms, 1, greatest(k, 1))")).otherwise(F.expr("slice(forms, 1, 0)")))
    e = e.withColumn("use", F.try_element_at(F.filter(turned, lambda f: f["value"].isNotNull()), F.lit(1))).where("use IS NOT NULL")
    return e.select(*key, F.col("use.form").alias("form"), N.fixed(F.col("use.value"), 1).alias("target"), "n_illuminated")


def _plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def descriptions(features: DataFrame) -> DataFrame:
    """Objects, manoeuvre and radar sentences per frame; kinds that can't be said give no row."""
    key = [F.col("clip_id"), F.col("frame")]
    lead = X.pick(["Ahead: ", "In front: ", "The forward sector holds "], *key, F.lit("objects"))
    objects = F.when(F.col("n_tracks") == 0, F.lit("No road users ahead.")).otherwise(F.concat(lead, _plural(F.col("n_tracks"), "road user"), F.lit(". The closest is a "), "nearest_class", F.lit(" at "), N.fixed(F.col("nearest_range")), F.lit(" m.")))
    pace = F.when(F.col("ego_speed") < 0.5, "The car stands.").otherwise(F.concat(F.lit("The car drives at "), N.fixed(F.col("ego_speed"), 1), F.lit(" m/s"), F.when(F.abs("ego_yaw_rate") > 0.1, " and turns.").otherwise(".")))
    radar = F.when(F.col("lrr1_n_points").isNotNull(), F.concat(F.lit("The long-range radar returns "), _plural(F.col("lrr1_n_points"), "detection"), F.lit(", "), F.col("lrr1_n_moving").cast("string"), F.lit(" of which are not explained by the car's own motion.")))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("text")) for k, v in (("objects", objects), ("manoeuvre", pace), ("radar", radar))])
    return features.select("clip_id", "frame", F.explode(F.filter(kinds, lambda k: k["text"].isNotNull())).alias("k")).select("clip_id", "frame", "k.*")


def clip_description(features: DataFrame) -> DataFrame:
    """A paragraph per clip from its frames' extremes."""
    c = features.groupBy("clip_id").agg(F.min("ego_speed").alias("lo"), F.max("ego_speed").alias("hi"), F.max("ego_travelled").alias("far"), F.max("n_tracks").alias("most"), F.count_if(F.col("n_moving") > 0).alias("busy"), F.count("*").alias("n"))
    text = F.concat(F.lit("Over the clip the car covers "), N.fixed(F.col("far")), F.lit(" m at "), N.fixed(F.col("lo"), 1), F.lit(" to "), N.fixed(F.col("hi"), 1), F.lit(" m/s. At most "), _plural(F.col("most"), "road user"), F.lit(" are ahead; something moves in "), F.col("busy").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" seconds."))
    return c.select("clip_id", F.lit("clip").alias("kind"), text.alias("text"))


def qa_summary(docs: DataFrame) -> DataFrame:
    """A line per document with the number of questions of each kind, the most frequent first."""
    rows = docs.select("clip_id", F.explode("qa").alias("q")).groupBy("clip_id", F.col("q.taxonomy").alias("kind")).agg(F.count("*").alias("n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "kind", "n"))), lambda s: F.concat(s["n"].cast("string"), F.lit(" "), s["kind"]))
    return rows.groupBy("clip_id").agg(F.concat(F.lit("Questions: "), F.array_join(parts, ", "), F.lit(".")).alias("text"))
