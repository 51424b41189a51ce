"""Matching, scorers and rewards on rows of (generated, reference), as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..functions.numbers import decay, f1, let

# How near or how much overlapping a match must be, and what a contradiction costs.
MATCH_M, RANGE_ONLY_M, IOU_LEAST, CONTRADICTION = 2.0, 1.0, 0.3, 0.35

# ---------------------------------------------------------------- greedy matching


def _place(o: Column) -> tuple[Column, Column]:
    a = F.radians(o["az"])
    return F.coalesce(o["x"], o["rng"] * F.cos(a)), F.coalesce(o["y"], o["rng"] * F.sin(a))


def candidates(predicted: Column, truth: Column, cost: Callable[[Column, Column], Column], limit: Column | float) -> Column:
    """All pairs within the limit as structs (cost, i, j), cheapest first, places from 0."""
    pairs = F.flatten(F.transform(predicted, lambda p, i: F.transform(truth, lambda t, j: F.struct(cost(p, t).alias("cost"), i.alias("i"), j.alias("j")))))
    return F.array_sort(F.filter(pairs, lambda c: c["cost"] <= limit))


def greedy(sorted_pairs: Column) -> Column:
    """Of sorted (cost, i, j) those whose i and j are both still free."""
    none = F.array().cast("array<struct<cost:double,i:int,j:int>>")
    free = lambda used, c: ~F.exists(used, lambda u: (u["i"] == c["i"]) | (u["j"] == c["j"]))
    return F.aggregate(sorted_pairs, none, lambda used, c: F.when(free(used, c), F.concat(used, F.array(c.cast("struct<cost:double,i:int,j:int>")))).otherwise(used))


def match(predicted: Column, truth: Column, threshold: float | None = None) -> Column:
    """Pairs of objects: by overlap where any has an image box, else by distance in metres."""
    boxes = F.exists(truth, lambda o: o["bbox"].isNotNull()) | F.exists(predicted, lambda o: o["bbox"].isNotNull())

    def apart(p: Column, t: Column) -> Column:
        (px, py), (tx, ty) = _place(p), _place(t)
        return F.hypot(px - tx, py - ty)

    by_box = candidates(predicted, truth, lambda p, t: -G.iou(p["bbox"], t["bbox"]), -IOU_LEAST)
    aimed = F.exists(truth, lambda o: o["has_az"]) | F.exists(predicted, lambda o: o["has_az"])
    limit = F.when(aimed, F.lit(MATCH_M)).otherwise(RANGE_ONLY_M) if threshold is None else F.lit(threshold)
    return greedy(F.when(boxes, by_box).otherwise(candidates(predicted, truth, apart, limit)))


# ---------------------------------------------------------------- scorers: a struct of additive counters


def score_objects(generated: Column, reference: Column, threshold: float | None = None) -> Column:
    """Counters of a list of objects; errors are sums over the matched pairs that state the value."""
    return let(lambda got, want: _score_parsed(got, want, threshold), X.objects(generated), X.objects(reference))


def score_classes(generated: Column, reference: Column, threshold: float | None = None) -> Column:
    """Of score_objects() only the counters of each class."""

    def of(got: Column, want: Column) -> Column:
        named = lambda p: F.struct(F.struct(F.get(got, p["i"])["cls"].alias("cls")).alias("p"), F.struct(F.get(want, p["j"])["cls"].alias("cls")).alias("t"))
        return let(lambda both: F.struct(_class_counts(got, want, both).alias("per_class")), F.transform(match(got, want, threshold), named))

    return let(of, X.objects(generated), X.objects(reference))


def _score_parsed(got: Column, want: Column, threshold: float | None = None) -> Column:
    return let(lambda pairs: _object_counts(got, want, F.transform(pairs, lambda p: F.struct(F.get(got, p["i"]).alias("p"), F.get(want, p["j"]).alias("t")))), match(got, want, threshold))


def _object_counts(got: Column, want: Column, paired: Column) -> Column:
    return let(lambda both: _counts_of(got, want, both), paired)


def _class_counts(got: Column, want: Column, both: Column) -> Column:
    """tp, fp and fn of each class of either side; a pair of different classes is a miss of both."""
    return F.transform(F.array_union(F.transform(got, lambda o: o["cls"]), F.transform(want, lambda o: o["cls"])), lambda c: F.struct(
        c.alias("cls"),
        F.size(F.filter(both, lambda b: (b["p"]["cls"] == c) & (b["t"]["cls"] == c))).alias("tp"),
        (F.size(F.filter(got, lambda o: o["cls"] == c)) - F.size(F.filter(both, lambda b: (b["p"]["cls"] == c) & (b["t"]["cls"] == c)))).alias("fp"),
        (F.size(F.filter(want, lambda o: o["cls"] == c)) - F.size(F.filter(both, lambda b: (b["p"]["cls"] == c) & (b["t"]["cls"] == c)))).alias("fn"),
    ))


def _counts_of(got: Column, want: Column, both: Column) -> Column:
    total = lambda f: F.aggregate(both, F.lit(0.0), lambda a, b: a + F.coalesce(f(b["p"], b["t"]).cast("double"), F.lit(0.0)))
    known = lambda f: total(lambda p, t: f(p, t).isNotNull().cast("int"))
    turn = lambda p, t: F.abs(G.wrap_degrees(p["yaw"] - t["yaw"]))
    size = lambda p, t: F.aggregate(F.zip_with(p["size"], t["size"], lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / 3
    speed = lambda p, t: F.hypot(p["vel"][0] - t["vel"][0], p["vel"][1] - t["vel"][1])
    az = lambda p, t: F.when(p["has_az"] & t["has_az"], F.abs(G.wrap_degrees(p["az"] - t["az"])))
    ids = lambda p, t: t["tid"].isNotNull() & p["tid"].isNotNull()
    return F.struct(
        F.lit(1).alias("n"), F.size(both).alias("tp"), (F.size(got) - F.size(both)).alias("fp"), (F.size(want) - F.size(both)).alias("fn"), F.size(both).alias("matched"),
        total(lambda p, t: (p["cls"] == t["cls"]).cast("int")).alias("class_ok"),
        total(lambda p, t: (p["moving"] == t["moving"]).cast("int")).alias("motion_ok"),
        total(lambda p, t: ids(p, t).cast("int")).alias("id_total"), total(lambda p, t: (ids(p, t) & (p["tid"] == t["tid"])).cast("int")).alias("id_ok"),
        total(lambda p, t: F.abs(p["rng"] - t["rng"])).alias("range_err"), total(az).alias("az_err"), known(az).alias("az_n"),
        total(lambda p, t: F.abs(p["z"] - t["z"])).alias("z_err"), known(lambda p, t: p["z"] - t["z"]).alias("z_n"),
        total(size).alias("size_err"), known(size).alias("size_n"), total(turn).alias("yaw_err"), known(turn).alias("yaw_n"),
        total(speed).alias("vel_err"), known(speed).alias("vel_n"),
        total(lambda p, t: (p["attr"] == t["attr"]).cast("int")).alias("attr_ok"), known(lambda p, t: p["attr"] == t["attr"]).alias("attr_n"),
        _class_counts(got, want, both).alias("per_class"),
    )


def _shared(got: Column, want: Column) -> Column:
    return F.array_sort(F.array_intersect(F.map_keys(got), F.map_keys(want)))


def _sum(keys: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(keys, F.lit(0.0), lambda a, h: a + F.coalesce(f(h).cast("double"), F.lit(0.0)))


def score_waypoints(generated: Column, reference: Column) -> Column:

    def of(got: Column, want: Column) -> Column:
        keys = _shared(got, want)
        err = _sum(keys, lambda h: F.hypot(got[h][0] - want[h][0], got[h][1] - want[h][1]))
        return F.struct(F.lit(1).alias("n"), F.size(keys).alias("horizons"), F.size(want).alias("expected"), err.alias("err"))

    return let(of, X.waypoints(generated), X.waypoints(reference))


def score_control(generated: Column, reference: Column) -> Column:

    def of(got: Column, want: Column) -> Column:
        keys = _shared(got, want)
        speed, yaw = _sum(keys, lambda h: F.abs(got[h][0] - want[h][0])), _sum(keys, lambda h: F.abs(got[h][1] - want[h][1]))
        return F.struct(F.lit(1).alias("n"), F.size(keys).alias("horizons"), F.size(want).alias("expected"), speed.alias("speed_err"), yaw.alias("yaw_err"))

    return let(of, X.controls(generated), X.controls(reference))


def score_trajectory(generated: Column, reference: Column) -> Column:
    """Polar, (x, y) and box forms, and leaving the sector, each compared only with its own form."""
    return let(lambda got, want: let(lambda keys: _trajectory(got, want, keys), _shared(got, want)), X.horizons(generated), X.horizons(reference))


def _trajectory(got: Column, want: Column, keys: Column) -> Column:
    of = lambda k: F.filter(keys, lambda h: (want[h]["kind"] == k) & (got[h]["kind"] == k))
    gone = F.filter(keys, lambda h: want[h]["kind"] == "gone")
    value = lambda m, h, i: m[h]["values"][i]
    apart = lambda h: F.hypot(value(got, h, 0) - value(want, h, 0), value(got, h, 1) - value(want, h, 1))
    final = F.filter(of("xy"), lambda h: h == F.array_max(F.map_keys(want)))
    return F.struct(
        F.lit(1).alias("n"), (F.size(gone) + F.size(of("polar")) + F.size(of("xy")) + F.size(of("bbox"))).alias("horizons"), F.size(want).alias("expected"),
        _sum(of("polar"), lambda h: F.abs(value(got, h, 0) - value(want, h, 0))).alias("range_err"),
        _sum(of("polar"), lambda h: F.abs(value(got, h, 1) - value(want, h, 1))).alias("az_err"), F.size(of("polar")).alias("polar_n"),
        _sum(of("bbox"), lambda h: G.iou(got[h]["values"], want[h]["values"])).alias("iou"), F.size(of("bbox")).alias("iou_n"),
        F.size(of("gone")).alias("gone_ok"), F.size(gone).alias("gone_n"),
        _sum(of("xy"), apart).alias("disp_err"), F.size(of("xy")).alias("disp_n"), _sum(final, apart).alias("final_err"), F.size(final).alias("final_n"),
    )


def score_quantity(generated: Column, reference: Column) -> Column:
    return let(_quantity, X.first_number(generated), X.first_number(reference))


def _quantity(p: Column, t: Column) -> Column:
    ok = (p.isNotNull() & t.isNotNull()).cast("int")
    err = F.coalesce(F.abs(p - t), F.lit(0.0))
    return F.struct(F.lit(1).alias("n"), ok.alias("scored"), F.when(ok == 1, p).alias("pred"), F.when(ok == 1, t).alias("truth"), err.alias("abs_err"), F.coalesce(err / F.greatest(F.abs(t), F.lit(1.0)), F.lit(0.0)).alias("rel_err"))


def set_counts(got: Column, want: Column) -> Column:
    return F.struct(F.lit(1).alias("n"), F.size(F.array_intersect(got, want)).alias("tp"), F.size(F.array_except(got, want)).alias("fp"), F.size(F.array_except(want, got)).alias("fn"))


def score_tags(generated: Column, reference: Column) -> Column:
    return let(set_counts, X.tags(generated), X.tags(reference))


def score_choice(generated: Column, reference: Column) -> Column:
    return F.struct(F.lit(1).alias("n"), F.coalesce((X.choice(generated) == X.choice(reference)).cast("int"), F.lit(0)).alias("correct"))


def _number_credit(generated: Column, reference: Column) -> Column:

    def of(got: Column, want: Column) -> Column:
        credit = F.transform(want, lambda w, i: F.when(i < F.size(got), F.greatest(F.lit(0.0), 1.0 - F.abs(F.get(got, i) - w) / F.greatest(F.abs(w), F.lit(1.0)))).otherwise(0.0))
        return F.aggregate(credit, F.lit(0.0), lambda a, x: a + x)

    return let(of, X.numbers(generated), X.numbers(reference))


def score_description(generated: Column, reference: Column) -> Column:
    words = lambda a, b: F.struct(
        F.lit(1).alias("n"), F.size(X.numbers(reference)).alias("numbers"), _number_credit(generated, reference).alias("number_credit"),
        F.size(F.array_intersect(a, b)).alias("claim_tp"), F.size(F.array_except(a, b)).alias("claim_fp"), F.size(F.array_except(b, a)).alias("claim_fn"),
    )
    return let(words, X.claim_words(generated), X.claim_words(reference))


def score_text(generated: Column, reference: Column) -> Column:
    return F.struct(F.lit(1).alias("n"))


def score_tracking(generated: Column, reference: Column, prompt: Column) -> Column:
    """As objects, and how many ids of the last history line the answer carries on where the truth does."""
    lines = F.filter(F.split(F.coalesce(prompt, F.lit("")), "\n"), lambda s: s.rlike(r"^\s*t-\d+s:"))
    last = F.array_min(F.transform(lines, lambda s: F.struct(F.regexp_extract(s, r"t-(\d+)s:", 1).cast("int").alias("age"), s.alias("line"))))["line"]
    ids = lambda objects: F.transform(objects, lambda o: o["tid"])

    def of(s: Column, held: Column, got: Column, want: Column) -> Column:
        due = F.filter(F.array_distinct(want), lambda t: t.isNotNull() & F.array_contains(held, t))
        return let(lambda d: F.struct(*[s[k].alias(k) for k in ("n", "tp", "fp", "fn", "matched", "class_ok")], F.size(d).alias("id_checkable"), F.size(F.array_intersect(d, got)).alias("id_carried")), due)

    parsed = lambda held, got, want: let(of, _score_parsed(got, want), ids(held), ids(got), ids(want))
    return let(parsed, X.objects(last), X.objects(generated), X.objects(reference))


# ---------------------------------------------------------------- rewards


def reward_objects(g: Column, r: Column) -> Column:

    def of(s: Column) -> Column:
        base = f1(s["tp"], s["fp"], s["fn"])
        detail = F.try_divide(s["class_ok"] + s["motion_ok"], 2.0 * s["matched"])
        where = decay(F.try_divide(s["range_err"], s["matched"]), 5.0)
        return F.when(s["matched"] == 0, base).otherwise(0.5 * base + 0.5 * base * (0.5 * detail + 0.5 * where))

    return let(of, score_objects(g, r))


def reward_waypoints(g: Column, r: Column, half: float = 1.0) -> Column:
    return let(lambda s: F.when(s["horizons"] == 0, 0.0).otherwise(s["horizons"] / F.greatest(s["expected"], F.lit(1)) * decay(F.try_divide(s["err"], s["horizons"]), half)), score_waypoints(g, r))


def reward_control(g: Column, r: Column) -> Column:

    def of(s: Column) -> Column:
        part = decay(F.try_divide(s["speed_err"], s["horizons"]), 1.0) + decay(F.try_divide(s["yaw_err"], s["horizons"]), 3.0)
        return F.when(s["horizons"] == 0, 0.0).otherwise(s["horizons"] / F.greatest(s["expected"], F.lit(1)) * 0.5 * part)

    return let(of, score_control(g, r))


def reward_trajectory(g: Column, r: Column, half: float = 2.0, half_az: float = 3.0) -> Column:
    def one(got: Column, want: Column, h: Column) -> Column:
        a, b = F.try_element_at(got, h), want[h]
        va, vb = a["values"], b["values"]
        polar = 0.5 * (decay(F.abs(F.get(va, F.lit(0)) - F.get(vb, F.lit(0))), half) + decay(F.abs(F.get(va, F.lit(1)) - F.get(vb, F.lit(1))), half_az))
        xy = decay(F.hypot(F.get(va, F.lit(0)) - F.get(vb, F.lit(0)), F.get(va, F.lit(1)) - F.get(vb, F.lit(1))), half)
        return F.when(F.coalesce(a["kind"] != b["kind"], F.lit(True)), 0.0).when(b["kind"] == "gone", 1.0).when(b["kind"] == "xy", xy).when(b["kind"] == "bbox", G.iou(va, vb)).otherwise(polar)

    return let(lambda got, want: F.coalesce(F.try_divide(_sum(F.map_keys(want), lambda h: one(got, want, h)), F.size(want)), F.lit(0.0)), X.horizons(g), X.horizons(r))


def reward_quantity(g: Column, r: Column) -> Column:
    want, got = F.size(X.numbers(r)), F.size(X.numbers(g))
    return F.when((want == 0) | (got == 0), 0.0).otherwise(F.try_divide(_number_credit(g, r), want))


def reward_tags(g: Column, r: Column) -> Column:
    return let(lambda s: f1(s["tp"], s["fp"], s["fn"]), score_tags(g, r))


def reward_choice(g: Column, r: Column) -> Column:
    return score_choice(g, r)["correct"].cast("double")


def reward_description(g: Column, r: Column, cost: float = CONTRADICTION) -> Column:

    def of(s: Column, a: Column, b: Column) -> Column:
        claim = f1(s["claim_tp"], s["claim_fp"], s["claim_fn"])
        base = F.when(s["numbers"] == 0, claim).otherwise(0.5 * F.try_divide(s["number_credit"], s["numbers"]) + 0.5 * claim)
        return F.greatest(F.lit(0.0), base - cost * X.contradictions(a, b))

    return let(of, score_description(g, r), X.claim_words(g), X.claim_words(r))


def reward_tracking(g: Column, r: Column, prompt: Column) -> Column:
    """Half for finding the objects, half for carrying their ids on."""
    return let(tracking_reward, score_tracking(g, r, prompt))


def tracking_reward(s: Column) -> Column:
    """reward_tracking() of counters that score_tracking() gave."""
    base = f1(s["tp"], s["fp"], s["fn"])
    return F.when(s["id_checkable"] == 0, base).otherwise(0.5 * base + 0.5 * F.try_divide(s["id_carried"], s["id_checkable"]))


def reward_reasoned(reward: Callable[[Column, Column], Column], g: Column, r: Column, weight: float = 0.3) -> Column:
    """Answer and rationale apart: without the format the rationale's part isn't earned."""
    (gr, ga), (rr, ra) = X.rationale(g), X.rationale(r)
    answer = reward(ga, ra)
    return F.when(rr.isNull(), answer).when(gr.isNull(), (1 - weight) * answer).otherwise((1 - weight) * answer + weight * reward_description(gr, rr))


def reward_relative(g: Column, r: Column) -> Column:
    p, t = X.first_number(g), X.first_number(r)
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(p - t) / F.greatest(F.abs(t), F.lit(1.0))), F.lit(0.0))


def reward_exact(g: Column, r: Column) -> Column:
    return F.coalesce((F.trim(g) == F.trim(r)).cast("double"), F.lit(0.0))


def reward_tolerance(g: Column, r: Column, share: float = 0.1) -> Column:
    p, t = X.first_number(g), X.first_number(r)
    return F.coalesce((F.abs(p - t) <= share * F.greatest(F.abs(t), F.lit(1.0))).cast("double"), F.lit(0.0))


#: Task family -> (scorer, reward); a task name picks the family it starts with.
FAMILIES: dict[str, tuple[Callable, Callable]] = {
    "det_objects": (score_objects, reward_objects), "motion_seg": (score_objects, reward_objects), "plan_ego_control": (score_control, reward_control),
    "plan_ego": (score_waypoints, reward_waypoints), "agent_traj": (score_trajectory, reward_trajectory), "radar_probe": (score_quantity, reward_quantity),
    "radar_transfer": (score_quantity, reward_quantity), "radar_objects": (score_quantity, reward_quantity), "radar_structure": (score_quantity, reward_quantity),
    "depth_range": (score_quantity, reward_quantity), "world_model": (score_quantity, reward_quantity), "retrieval": (score_tags, reward_tags),
    "qa": (score_choice, reward_choice), "ood": (score_text, reward_description), "desc": (score_description, reward_description),
}


def family(task: Column) -> Column:
    """The longest family name that the task's name starts with; null for none."""
    out = F.lit(None).cast("string")
    for name in sorted(FAMILIES, key=len):
        out = F.when(task.startswith(name), F.lit(name)).otherwise(out)
    return out


def reward(task: Column, g: Column, r: Column) -> Column:
    """The reward of the task's family; with rationale for tasks that end in _cot."""
    out = reward_description(g, r)
    for name in sorted(FAMILIES, key=len):
        f = FAMILIES[name][1]
        out = F.when(task.startswith(name), F.when(task.endswith("_cot"), reward_reasoned(f, g, r)).otherwise(f(g, r))).otherwise(out)
    return out


# ---------------------------------------------------------------- folds


def fold(scored: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """The sums of all numeric counters of a score struct for each group."""
    kinds = {"int", "bigint", "double"}
    names = [f.name for f in scored.schema[score].dataType if f.dataType.simpleString() in kinds]
    return scored.groupBy(*by).agg(*[F.sum(F.col(score)[n]).alias(n) for n in names])


def detection_ratios(folded: DataFrame) -> DataFrame:
    """Precision, recall, F1 and mean errors; null where nothing states the value."""
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    per = lambda a, b: F.try_divide(F.col(a), F.col(b))
    out = folded.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.try_divide(2 * p * r, F.greatest(p + r, F.lit(1e-9))))
    if "class_ok" in folded.columns:
        matched = F.greatest(F.col("matched"), F.lit(1))
        out = out.withColumn("class_acc", F.col("class_ok") / matched)
    if "range_err" in folded.columns:
        out = out.withColumn("motion_acc", F.col("motion_ok") / matched).withColumn("range_mae", F.col("range_err") / matched).withColumn("az_mae", F.col("az_err") / F.greatest(F.col("az_n"), F.lit(1)))
        for k in ("z", "size", "yaw", "vel"):
            out = out.withColumn(f"{k}_mae", per(f"{k}_err", f"{k}_n"))
        out = out.withColumn("id_acc", per("id_ok", "id_total")).withColumn("attr_acc", per("attr_ok", "attr_n"))
    return out


def per_class(scored: DataFrame, by: list[str], score: str = "score", weight: str | None = None) -> DataFrame:
    """Precision, recall and F1 of each class that the truth has, the most frequent first; a row counts ``weight`` times."""
    times = F.lit(1) if weight is None else F.col(weight)
    rows = scored.select(*by, times.alias("_times"), F.explode(F.col(score)["per_class"]).alias("c")).groupBy(*by, F.col("c.cls").alias("cls"))
    rows = rows.agg(*[F.sum(F.col("c")[k] * F.col("_times")).alias(k) for k in ("tp", "fp", "fn")]).where("tp + fn > 0").withColumn("n", F.col("tp") + F.col("fn"))
    return detection_ratios(rows).orderBy(*by, F.desc("n"), "cls")


def per_class_of_texts(df: DataFrame, by: list[str], generated: Column, reference: Column) -> DataFrame:
    """per_class() of rows of texts; an answer that a group gives several times to the same reference is read and matched once."""
    texts = df.select(*by, generated.alias("_got"), reference.alias("_want")).groupBy(*by, "_got", "_want").agg(F.count("*").alias("_n"))
    return per_class(texts.withColumn("score", score_classes(F.col("_got"), F.col("_want"))), by, weight="_n")


def average_precision(rows: DataFrame, by: list[str], confidence: str, hit: str, truths: str, tie: str) -> DataFrame:
    """Area under the monotone precision envelope: rows are predictions with a hit flag and the group's number of truths."""
    order = Window.partitionBy(*by).orderBy(F.desc(confidence), tie)
    rows = rows.withColumn("_tp", F.sum(F.col(hit).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_k", F.row_number().over(order))
    rows = rows.withColumn("_recall", F.try_divide(F.col("_tp"), F.col(truths))).withColumn("_precision", F.col("_tp") / F.col("_k"))
    # from the last row on: a frame that ends with the group would be gone through again for each row
    back = Window.partitionBy(*by).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_envelope", F.max("_precision").over(back))
    rows = rows.withColumn("_gain", F.col("_recall") - F.coalesce(F.lag("_recall").over(order), F.lit(0.0)))
    return rows.groupBy(*by).agg(F.sum(F.col("_gain") * F.col("_envelope")).alias("ap"))


def detection_map(items: DataFrame, thresholds: tuple[float, ...] = (0.5, 1.0, 2.0, 4.0)) -> DataFrame:
    """items (item, predicted, truth: arrays of objects, confidence: array) -> cls, threshold, ap, n.

    Per class and item, predictions in order of confidence take the nearest free truth closer than the
    threshold. Each prediction keeps its own confidence, whichever class stands before it in the answer.
    """
    zipped = items.select("item", F.col("truth"), F.transform(F.col("predicted"), lambda o, i: F.struct(o.alias("o"), F.coalesce(F.get(F.col("confidence"), i), F.lit(0.0)).alias("c"))).alias("p"))
    classes = F.array_union(F.transform("p", lambda p: p["o"]["cls"]), F.transform("truth", lambda t: t["cls"]))
    per = zipped.withColumn("cls", F.explode(classes)).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    mine = F.filter("p", lambda p: p["o"]["cls"] == F.col("cls"))
    sure = F.array_sort(F.transform(mine, lambda p, i: F.struct((-p["c"]).alias("k"), i.alias("i"), p.alias("p"))))
    per = per.withColumn("sure", sure).withColumn("true", F.filter("truth", lambda t: t["cls"] == F.col("cls"))).drop("p", "truth")
    taken = F.array().cast("array<int>")

    def step(used: Column, s: Column) -> Column:
        (px, py) = _place(s["p"]["o"])
        near = F.transform(F.col("true"), lambda t, j: F.struct(F.hypot(px - _place(t)[0], py - _place(t)[1]).alias("d"), j.alias("j")))
        best = F.array_min(F.filter(near, lambda c: (c["d"] < F.col("threshold")) & ~F.array_contains(used, c["j"])))
        return F.concat(used, F.array(F.coalesce(best["j"], F.lit(-1))))

    per = per.withColumn("used", F.aggregate("sure", taken, step))
    totals = per.groupBy("cls", "threshold").agg(F.sum(F.size("true")).alias("n"))
    rows = per.select("cls", "threshold", "item", F.posexplode(F.arrays_zip("sure", "used"))).select("cls", "threshold", "item", "pos", (-F.col("col.sure.k")).alias("confidence"), (F.col("col.used") >= 0).alias("hit"))
    rows = rows.join(totals, ["cls", "threshold"]).withColumn("tie", F.struct("item", "pos"))
    ap = average_precision(rows, ["cls", "threshold"], "confidence", "hit", "n", "tie")
    return totals.where("n > 0").join(ap, ["cls", "threshold"], "left").select("cls", "threshold", F.coalesce("ap", F.lit(0.0)).alias("ap"), "n")


def chamfer(predicted: Column, truth: Column) -> Column:
    """For each truth the distance to the nearest prediction."""
    return F.transform(truth, lambda t: F.array_min(F.transform(predicted, lambda p: F.hypot(_place(p)[0] - _place(t)[0], _place(p)[1] - _place(t)[1]))))


def min_ade(paths: Column, truth: Column) -> Column:
    """Of several candidate paths (maps horizon -> [x, y]) the least mean distance to the truth; null without a shared horizon."""
    return F.array_min(F.transform(paths, lambda p: F.try_divide(_sum(_shared(p, truth), lambda h: F.hypot(p[h][0] - truth[h][0], p[h][1] - truth[h][1])), F.size(_shared(p, truth)))))


def collides(path: Column, obstacles: Column, length: float = 4.6, width: float = 1.9) -> Column:
    """How many points [x, y] of a path overlap an obstacle [x, y, length, width]."""
    hit = lambda p: F.exists(obstacles, lambda o: (F.abs(p[0] - o[0]) <= (o[2] + length) / 2) & (F.abs(p[1] - o[1]) <= (o[3] + width) / 2))
    return F.size(F.filter(path, hit))


def advantages(df: DataFrame, group: list[str], reward: str, out: str = "advantage") -> DataFrame:
    """The reward's distance from its group's mean in population standard deviations; 0 where they hardly differ."""
    w = Window.partitionBy(*group)
    mean, sd = F.avg(reward).over(w), F.stddev_pop(reward).over(w)
    return df.withColumn(out, F.when(sd < 1e-6, 0.0).otherwise(F.try_divide(F.col(reward) - mean, sd)))
