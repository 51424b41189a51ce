"""Instruction items from egomotion, tracks and radar: one DataFrame per task, (clip_id, task, frame, prompt, target, strat, needs_radar).

Every builder is joins, windows and string expressions. ego: clip_id, t (s), x, y, yaw, speed, yaw_rate.
obstacle: clip_id, track_id, t (s), label_class, cx, cy, cz, sx, sy, sz, yaw_deg, wx, wy, speed (rig and world).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import numbers as N
from ..functions import text as X
from ..operators import temporal as TE

LIST_M, LIST_SIZE, NEAR_S = 40.0, 8, 0.15
ANCHORS = {"det_objects": range(3, 19, 3), "motion_seg": range(2, 19, 2), "plan_ego": range(3, 18, 2), "agent_traj": range(3, 18, 2), "track_step": range(5, 20)}
EMPTY = "No road users in the forward sector."
STEPS = (1.0, 2.0, 3.0)
CHAIN = ' Think step by step and answer as JSON with "rationale" and "answer".'


def ego_frame(egomotion: DataFrame) -> DataFrame:
    """Egomotion on seconds with unwrapped yaw, speed and yaw rate by central differences."""
    e = egomotion.withColumn("t", F.col("timestamp") / 1e6).withColumn("raw", G.yaw(*[F.col(q) for q in ("qx", "qy", "qz", "qw")]))
    e = TE.unwrap(e, "raw", ["clip_id"], ["t"], 2 * math.pi, "yaw")
    for v in ("x", "y", "yaw"):
        e = e.withColumn(f"d_{v}", TE.gradient(v, "t", ["clip_id"], ["t"]))
    e = e.withColumn("speed", F.hypot("d_x", "d_y")).withColumnRenamed("d_yaw", "yaw_rate")
    return TE.travelled(e, ["x", "y"], ["clip_id"], ["t"]).select("clip_id", "t", "x", "y", "yaw", "speed", "yaw_rate", "d_x", "d_y", "travelled")


def boxes_world(obstacle: DataFrame, ego: DataFrame) -> DataFrame:
    """Boxes with world positions by the pose interpolated at their own time, and world speed of tracks seen three times."""
    o = obstacle.withColumn("t", F.col("timestamp_us") / 1e6)
    q = [F.col(f"orientation_{c}") for c in "xyzw"]
    o = o.select("clip_id", "track_id", "t", "label_class", *[F.col(f"center_{c}").alias(f"c{c}") for c in "xyz"], *[F.col(f"size_{c}").alias(f"s{c}") for c in "xyz"], F.degrees(G.yaw(*q)).alias("yaw_deg"))
    o = TE.interpolate(o, ego.select("clip_id", "t", "x", "y", "yaw"), ["clip_id"], "t", ["x", "y", "yaw"])
    wx = F.col("x") + F.cos("yaw") * F.col("cx") - F.sin("yaw") * F.col("cy")
    wy = F.col("y") + F.sin("yaw") * F.col("cx") + F.cos("yaw") * F.col("cy")
    o = o.withColumn("wx", wx).withColumn("wy", wy)
    n = F.count("*").over(Window.partitionBy("clip_id", "track_id"))
    vx, vy = (TE.gradient(c, "t", ["clip_id", "track_id"], ["t"]) for c in ("wx", "wy"))
    o = o.withColumn("n", n).withColumn("vx", F.when(F.col("n") >= 3, vx)).withColumn("vy", F.when(F.col("n") >= 3, vy))
    return o.withColumn("speed", F.hypot("vx", "vy")).drop("n", "x", "y", "yaw")


def anchors(clips: DataFrame, task: str) -> DataFrame:
    """Clip and frame: frame N is second N - 1."""
    frames = [a + 1 for a in ANCHORS[task]]
    return clips.select("clip_id", F.explode(F.array(*[F.lit(f) for f in frames])).alias("frame")).withColumn("t", (F.col("frame") - 1).cast("double"))


def visible(at: DataFrame, boxes: DataFrame, reach: float = LIST_M, within: float = NEAR_S) -> DataFrame:
    """The tracks in the forward sector at each anchor, each by its nearest observation, nearest first in ``rank``."""
    pairs = TE.band_join(at, boxes.withColumnRenamed("t", "bt"), ["clip_id"], "t", within, "bt")
    pairs = TE.nearest_per_track(pairs, ["clip_id", "frame"], "track_id", "t", "bt").withColumn("rng", F.hypot("cx", "cy")).withColumn("az", F.degrees(F.atan2("cy", "cx")))
    pairs = pairs.where(G.in_front(F.col("cx"), F.col("cy"), 60.0, reach))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("clip_id", "frame").orderBy("rng", "track_id")))


def _item(df: DataFrame, task: str, prompt: Column, target: Column, strat: Column, radar: bool) -> DataFrame:
    return df.select("clip_id", F.lit(task).alias("task"), "frame", prompt.alias("prompt"), target.alias("target"), strat.alias("strat"), F.lit(radar).alias("needs_radar"))


def _lists(at: DataFrame, seen: DataFrame, part: Column, empty: str = EMPTY) -> DataFrame:
    """Every anchor with its parts in the order of rank, joined; the phrase where there are none."""
    texts = seen.where(F.col("rank") <= LIST_SIZE).groupBy("clip_id", "frame").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("s")))), lambda x: x["s"]).alias("parts"))
    out = at.join(texts, ["clip_id", "frame"], "left").withColumn("parts", F.coalesce("parts", F.array().cast("array<string>")))
    return out.withColumn("text", X.listed(F.col("parts"), empty))


def det_objects(clips: DataFrame, boxes: DataFrame) -> DataFrame:
    """Objects within 40 m, nearest first, in polar form and as boxes."""
    at = anchors(clips, "det_objects")
    seen = visible(at, boxes)
    polar = _lists(at, seen, X.describe_polar(F.col("label_class"), F.col("rng"), F.col("az"), F.coalesce(F.col("speed") > 1, F.lit(False))))
    box = X.describe_point(F.col("label_class"), *[F.col(f"c{c}") for c in "xyz"], tuple(F.col(f"s{c}") for c in "xyz"), G.yaw_sector(F.col("yaw_deg")))
    boxed = _lists(at, seen, F.concat(box, F.coalesce(F.concat(F.lit(" "), G.object_attribute(F.col("label_class"), F.col("speed"))), F.lit(""))))
    strat = F.when(F.size("parts") == 0, "none").when(F.size("parts") <= 3, "few").otherwise("many")
    one = _item(polar, "det_objects_azdeg", F.lit("List the road users in the forward sector within 40 m, nearest first, with range and azimuth."), F.col("text"), strat, True)
    return one.unionByName(_item(boxed, "det_objects_3dbbox", F.lit("List the road users in the forward sector within 40 m, nearest first, as boxes: centre, size, heading sector and state."), F.col("text"), strat, True))


def motion_seg(clips: DataFrame, boxes: DataFrame) -> DataFrame:
    """Which objects move and which stand, each object with its own word."""
    at = anchors(clips, "motion_seg")
    seen = visible(at, boxes).where("speed IS NOT NULL")
    word = F.when(F.col("speed") > 1, " moving").otherwise(" stationary")
    out = _lists(at, seen, F.concat(X.describe_polar(F.col("label_class"), F.col("rng"), F.col("az")), word))
    return _item(out, "motion_seg_azdeg", F.lit("Which road users in the forward sector are moving and which are stationary?"), F.col("text"), F.when(F.size("parts") == 0, "none").otherwise("some"), True)


def _future(at: DataFrame, ego: DataFrame) -> DataFrame:
    """Anchors with pose now, and struct per step of pose and controls; steps beyond the clip are left out."""
    now = TE.interpolate(at, ego, ["clip_id"], "t", ["x", "y", "yaw", "speed"]).withColumnsRenamed({c: f"{c}0" for c in ("x", "y", "yaw", "speed")})
    grid = now.withColumn("step", F.explode(F.array(*[F.lit(s) for s in STEPS]))).withColumnRenamed("t", "t0").withColumn("t", F.col("t0") + F.col("step"))
    found = TE.nearest_join(grid, ego, ["clip_id"], "t", ["speed", "yaw_rate", "yaw"]).where(F.col("near.t") >= F.col("t") - 0.35)
    return TE.interpolate(found, ego.select("clip_id", "t", "x", "y"), ["clip_id"], "t", ["x", "y"])


def plan_ego(clips: DataFrame, ego: DataFrame) -> DataFrame:
    """The ego's next three seconds as waypoints and as controls; anchors whose clip ends earlier give nothing."""
    rows = _future(anchors(clips, "plan_ego"), ego)
    fx, fy = G.to_frame(F.col("x"), F.col("y"), (F.col("x0"), F.col("y0")), F.col("yaw0"))
    turn = F.degrees(TE.wrap(F.col("near.yaw") - F.col("yaw0"), 2 * math.pi))
    number = F.col("step").cast("int").cast("string")
    way = F.concat(F.lit("+"), number, F.lit("s ("), N.fixed(fx, 1, True), F.lit("m, "), N.fixed(fy, 1, True), F.lit("m)"))
    control = F.concat(F.lit("+"), number, F.lit("s "), N.fixed(F.col("near.speed"), 1), F.lit(" m/s, yaw "), N.fixed(F.degrees("near.yaw_rate"), 1, True), F.lit(" deg/s"))
    done = rows.groupBy("clip_id", "frame").agg(
        F.array_sort(F.collect_list(F.struct("step", way.alias("w"), control.alias("c"), turn.alias("turn"), (F.col("near.speed") - F.col("speed0")).alias("dv")))).alias("s"),
    ).where(F.size("s") == len(STEPS))
    last = F.element_at("s", -1)
    strat = G.nav_command(last["turn"])
    action = G.ego_action(last["dv"], last["turn"])
    join = lambda k: F.array_join(F.transform("s", lambda x: x[k]), "; ")
    prompt = lambda what: F.concat(F.lit("Command: "), strat, F.lit(f". {what}"))
    out = _item(done, "plan_ego_xy", prompt("Where will the car be in one, two and three seconds?"), join("w"), strat, False)
    out = out.unionByName(_item(done, "plan_ego_control", prompt("What will speed and yaw rate be in one, two and three seconds?"), join("c"), strat, False))
    reason = F.concat(F.lit("The car is "), action, F.lit("."))
    return out.unionByName(_item(done, "plan_ego_xy_cot", F.concat(prompt("Where will the car be in one, two and three seconds?"), F.lit(CHAIN)), X.reasoned(reason, join("w")), strat, False))


def agent_traj(clips: DataFrame, boxes: DataFrame, ego: DataFrame) -> DataFrame:
    """One moving agent per anchor, nearest or rarest by turns, and where it will be; leaving the sector is said."""
    at = anchors(clips, "agent_traj")
    seen = visible(at, boxes).where("speed > 1")
    rarity = boxes.groupBy("label_class").agg(F.count_distinct("clip_id", "track_id").alias("rarity"))
    seen = seen.join(rarity, "label_class")
    near, rare = F.struct(F.col("rng").alias("a"), F.col("rng").alias("b"), "track_id"), F.struct(F.col("rarity").cast("double").alias("a"), F.col("rng").alias("b"), "track_id")
    keep = F.struct("track_id", "label_class", "rng", "az")
    chosen = seen.groupBy("clip_id", "frame", "t").agg(F.min_by(keep, near).alias("near"), F.min_by(keep, rare).alias("rare"))
    chosen = chosen.select("clip_id", "frame", "t", F.when(F.floor(F.col("frame") / 2) % 2 == 0, F.col("near")).otherwise(F.col("rare")).alias("a")).select("clip_id", "frame", "t", "a.*")
    pose = TE.interpolate(chosen, ego, ["clip_id"], "t", ["x", "y", "yaw"])
    steps = pose.withColumn("step", F.explode(F.array(*[F.lit(s) for s in STEPS]))).withColumn("ft", F.col("t") + F.col("step"))
    future = boxes.select("clip_id", "track_id", F.col("t").alias("bt"), F.col("cx").alias("bx"), F.col("cy").alias("by"), "wx", "wy")
    hits = TE.band_join(steps.withColumnRenamed("t", "t0").withColumnRenamed("ft", "t").withColumnRenamed("track_id", "tid"), future, ["clip_id"], "t", NEAR_S, "bt").where("tid = track_id")
    hits = TE.nearest_per_track(hits, ["clip_id", "frame", "step"], "track_id", "t", "bt").select("clip_id", "frame", "step", "bx", "by", "wx", "wy")
    rows = steps.join(hits, ["clip_id", "frame", "step"], "left")
    gone = F.coalesce(~G.in_front(F.col("bx"), F.col("by")), F.lit(True))
    first = F.min(F.when(gone, F.col("step"))).over(Window.partitionBy("clip_id", "frame"))
    rows = rows.withColumn("first", first).where(F.col("first").isNull() | (F.col("step") <= F.col("first")))
    number = F.col("step").cast("int").cast("string")
    fx, fy = G.to_frame(F.col("wx"), F.col("wy"), (F.col("x"), F.col("y")), F.col("yaw"))
    polar = F.when(gone, F.concat(F.lit("+"), number, F.lit(f"s {X.LEAVES}"))).otherwise(F.concat(F.lit("+"), number, F.lit("s "), N.fixed(F.hypot(fx, fy)), F.lit("m az"), N.fixed(F.degrees(F.atan2(fy, fx)), 0, True), F.lit("deg")))
    xy = F.when(gone, F.concat(F.lit("+"), number, F.lit(f"s {X.LEAVES}"))).otherwise(F.concat(F.lit("+"), number, F.lit("s ("), N.fixed(fx, 1, True), F.lit("m, "), N.fixed(fy, 1, True), F.lit("m)")))
    done = rows.groupBy("clip_id", "frame", "label_class", "rng", "az").agg(F.array_sort(F.collect_list(F.struct("step", polar.alias("p"), xy.alias("q")))).alias("s"))
    prompt = F.concat(F.lit("Where will the "), X.describe_polar(F.col("label_class"), F.col("rng"), F.col("az")), F.lit(" be in one, two and three seconds?"))
    join = lambda k: F.array_join(F.transform("s", lambda x: x[k]), "; ")
    out = _item(done, "agent_traj_azdeg", prompt, join("p"), F.col("label_class"), True)
    return out.unionByName(_item(done, "agent_traj_xy", prompt, join("q"), F.col("label_class"), True))


def track_step(clips: DataFrame, boxes: DataFrame) -> DataFrame:
    """Tracks with ids local to the clip, given the four frames before."""
    at = clips.select("clip_id", F.explode(F.sequence(F.lit(1), F.lit(21))).alias("frame")).withColumn("t", (F.col("frame") - 1).cast("double"))
    seen = TE.local_ids(visible(at, boxes), ["clip_id"], "track_id", "bt")
    frames = _lists(at, seen, X.describe_polar(F.col("label_class"), F.col("rng"), F.col("az"), tid=F.col("local_id")), "none")
    frames = TE.history_block(frames, ["clip_id"], ["frame"], "text", 4)
    chosen = frames.where(F.col("frame").isin([a + 1 for a in ANCHORS["track_step"]]))
    return _item(chosen, "track_step_azdeg", F.concat(F.lit("History:\n"), F.col("history"), F.lit("\nList the road users now, each with its id.")), F.col("text"), F.when(F.size("parts") == 0, "none").otherwise("some"), True)


def all_items(clips: DataFrame, egomotion: DataFrame, obstacle: DataFrame) -> DataFrame:
    """All tasks' items; radar tasks only for clips with a radar and its calibration."""
    ego = ego_frame(egomotion)
    boxes = boxes_world(obstacle, ego)
    ready = clips.where(F.coalesce(F.col("has_radar_extrinsics"), F.lit(False)) & (F.coalesce("has_lrr1", F.lit(False)) | F.coalesce("has_mrr2", F.lit(False)) | F.coalesce("has_srr0", F.lit(False))))
    parts = [det_objects(ready, boxes), motion_seg(ready, boxes), plan_ego(ready, ego), agent_traj(ready, boxes, ego), track_step(ready, boxes)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(clips.select("clip_id", "split"), "clip_id")
