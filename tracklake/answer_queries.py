"""Queries over answers, claims and text forms.

The texts are written from the tables' numbers and read back by the operators; the SQL works on the numbers
themselves, so each row checks writing, parsing and scoring together.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as X
from .operators import claims as C
from .operators import scoring as SC
from .queries import query, r, read

V = "v AS (SELECT l_orderkey, l_linenumber AS n, l_quantity::int AS q, round(l_discount * 100)::int AS d, round(l_tax * 100)::int AS x, l_returnflag AS f FROM lineitem)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as small whole numbers: n, q, d, x, and the flag f."""
    li = read(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q"), F.round(F.col("l_discount") * 100).cast("int").alias("d"), F.round(F.col("l_tax") * 100).cast("int").alias("x"), F.col("l_returnflag").alias("f"))


def say(form: str, **values: Column | str) -> Column:
    """A text with columns in the place of ``{name}``; a single letter stands for its column."""
    parts = []
    for literal, name in ((a, b) for a, b, *_ in Formatter().parse(form)):
        if literal:
            parts.append(F.lit(literal))
        if name:
            c = values.get(name, F.col(name))
            parts.append((F.lit(c) if isinstance(c, str) else c).cast("string"))
    return F.concat(*parts)


def even(c: str = "n") -> Column:
    return F.col(c) % 2 == 0


# ---------------------------------------------------------------- scorers and rewards


@query(f"""WITH {V}, s AS (SELECT *, 1 + (n % 2 = 0)::int AS horizons, (d + CASE WHEN n % 2 = 0 THEN x ELSE 0 END)::double AS err FROM v)
SELECT l_orderkey, n, horizons, 2 AS expected, err, round(horizons / 2.0 * (1 / (1 + err / horizons)), 6) AS reward FROM s""")
def waypoint_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = say("+1s ({q}m, {x}m); +2s ({q}.5m, {d}m)")
    got = F.concat(say("+1s ({q}m, {a}m)", a=F.col("x") + F.col("d")), F.when(even(), say("; +2s ({q}.5m, {a}m)", a=F.col("d") - F.col("x"))).otherwise("; +3s (1m, -1m)"))
    out = lines(spark, sf_dir).withColumn("s", SC.score_waypoints(got, want)).withColumn("reward", SC.reward_waypoints(got, want))
    return out.select("l_orderkey", "n", "s.horizons", "s.expected", "s.err", r("reward", 6).alias("reward"))


@query(f"""WITH {V}, s AS (SELECT *, 1 + (n % 2 = 0)::int AS h FROM v)
SELECT l_orderkey, n, h AS horizons, (x * h)::double AS speed_err, (4 * h)::double AS yaw_err, round(h / 2.0 * 0.5 * (1 / (1 + x::double) + 3 / (3 + 4.0::double)), 6) AS reward FROM s""")
def control_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = say("+1s {q}.0 m/s, yaw +{d}.5 deg/s; +2s {q} m/s, yaw {d} deg/s")
    fast, turn = F.col("q") + F.col("x"), F.col("d") - 4
    got = F.concat(say("+1s {a}.0 m/s, yaw {b} deg/s", a=fast, b=(turn + 0.5).cast("decimal(9,1)")), F.when(even(), say("; +2s {a} m/s, yaw {b} deg/s", a=fast, b=turn)).otherwise(""))
    out = lines(spark, sf_dir).withColumn("s", SC.score_control(got, want)).withColumn("reward", SC.reward_control(got, want))
    return out.select("l_orderkey", "n", "s.horizons", "s.speed_err", "s.yaw_err", r("reward", 6).alias("reward"))


@query(f"""WITH {V}, s AS (SELECT *, n % 4 AS k FROM v)
SELECT l_orderkey, n, CASE WHEN k = 0 THEN d ELSE 0 END::double AS range_err, CASE WHEN k = 0 THEN x ELSE 0 END::double AS az_err, (k = 0)::int AS polar_n, CASE WHEN k = 1 THEN x ELSE 0 END::double AS disp_err, (k = 1)::int AS final_n,
 round(CASE WHEN k = 2 THEN 0.6 ELSE 0 END, 6)::double AS iou, (k = 3)::int AS gone_n, (k = 3 AND q % 2 = 0)::int AS gone_ok,
 round(CASE k WHEN 0 THEN 0.5 * (2 / (2 + d::double) + 3 / (3 + x::double)) WHEN 1 THEN 2 / (2 + x::double) WHEN 2 THEN 0.6 ELSE (q % 2 = 0)::int END, 6)::double AS reward FROM s""")
def trajectory_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n") % 4
    pick = lambda *forms: F.when(k == 0, forms[0]).when(k == 1, forms[1]).when(k == 2, forms[2]).otherwise(forms[3])
    gone = F.lit(f"+1s {X.LEAVES}")
    want = pick(say("+1s {q}m az{x}deg"), say("+1s ({q}m, {d}m)"), say("+1s [{q}px, 10px, {a}px, 30px]", a=F.col("q") + 20), gone)
    got = pick(say("+1s {a}m az0deg", a=F.col("q") + F.col("d")), say("+1s ({q}m, {a}m)", a=F.col("d") + F.col("x")), say("+1s [{a}, 10, {b}, 30]", a=F.col("q") + 5, b=F.col("q") + 25), F.when(even("q"), gone).otherwise(say("+1s {q}m az0deg")))
    out = lines(spark, sf_dir).withColumn("s", SC.score_trajectory(got, want)).withColumn("reward", SC.reward_trajectory(got, want))
    return out.select("l_orderkey", "n", *[f"s.{c}" for c in ("range_err", "az_err", "polar_n", "disp_err", "final_n")], r("s.iou", 6).alias("iou"), "s.gone_n", "s.gone_ok", r("reward", 6).alias("reward"))


@query(f"""WITH {V}, s AS (SELECT *, n % 5 <> 0 AS ok, CASE WHEN n % 5 = 1 THEN 0 ELSE d END AS e FROM v)
SELECT l_orderkey, n, ok::int AS scored, CASE WHEN ok THEN q + e END::double AS pred, CASE WHEN ok THEN q END::double AS truth, CASE WHEN ok THEN e ELSE 0 END::double AS abs_err, round(CASE WHEN ok THEN e / greatest(q, 1)::double ELSE 0 END, 6) AS rel_err,
 round(CASE WHEN ok THEN greatest(0, 1 - e / greatest(q, 1)::double) ELSE 0 END, 6) AS reward, round(CASE WHEN ok THEN greatest(0, 1 - e / greatest(q, 1)::double) ELSE 0 END, 6) AS relative, (n % 5 = 1)::int::double AS exact, (ok AND e <= 0.1::double * greatest(q, 1))::int::double AS near FROM s""")
def quantity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = F.col("q").cast("string")
    got = F.when(F.col("n") % 5 == 0, "none").when(F.col("n") % 5 == 1, say(" {q} ")).otherwise(say("about {a} metres", a=F.col("q") + F.col("d")))
    out = lines(spark, sf_dir).withColumn("s", SC.score_quantity(got, want))
    kinds = {"reward": SC.reward_quantity, "relative": SC.reward_relative, "exact": SC.reward_exact, "near": SC.reward_tolerance}
    return out.select("l_orderkey", "n", "s.scored", "s.pred", "s.truth", "s.abs_err", r("s.rel_err", 6).alias("rel_err"), *[r(f(got, want), 6).alias(k) for k, f in kinds.items()])


@query(f"""WITH {V} SELECT l_orderkey, n, chr(65 + q % 5) AS chosen, (q % 5 = d % 5)::int AS correct, (q % 5 = d % 5)::int::double AS reward FROM v""")
def choice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, want = say("Answer: I pick ({a}), Eve", a=F.char(F.col("q") % 5 + 65)), F.char(F.col("d") % 5 + 65)
    out = lines(spark, sf_dir)
    return out.select("l_orderkey", "n", X.choice(got).alias("chosen"), SC.score_choice(got, want)["correct"].alias("correct"), SC.reward_choice(got, want).alias("reward"))


@query(f"""WITH {V}, s AS (SELECT *, 2 + (q % 3 = q % 2)::int AS tp FROM v) SELECT l_orderkey, n, tp, 3 - tp AS fp, 3 - tp AS fn, round(tp / 3.0, 6)::double AS reward FROM s""")
def tag_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    got, want = say("Day;  traffic {a}; X{b};", a=F.col("q") % 3, b=F.col("d") % 2), say("day; traffic {a}; x{b}", a=F.col("q") % 2, b=F.col("d") % 2)
    out = lines(spark, sf_dir).withColumn("s", SC.score_tags(got, want))
    return out.select("l_orderkey", "n", "s.tp", "s.fp", "s.fn", r(SC.reward_tags(got, want), 6).alias("reward"))


@query(f"""WITH {V}, s AS (SELECT *, 1 + (n % 2 = 0)::int + (d % 2 = 0)::int AS tp, greatest(0, 1 - x / greatest(q, 1)::double) AS credit FROM v)
SELECT l_orderkey, n, 2 AS numbers, round(credit, 6) AS number_credit, tp AS claim_tp, 3 - tp AS claim_fp, 3 - tp AS claim_fn, round(greatest(0, 0.5 * credit / 2 + 0.5 * (tp / 3.0::double) - 0.35 * (d % 2)), 6) AS reward FROM s""")
def description_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    want = say("A car is moving left, {q} metres ahead and {d} to the side.")
    got = say("A {a} is {b} left, {c} metres ahead.", a=F.when(even(), "car").otherwise("truck"), b=F.when(even("d"), "moving").otherwise("stationary"), c=F.col("q") + F.col("x"))
    out = lines(spark, sf_dir).withColumn("s", SC.score_description(got, want))
    return out.select("l_orderkey", "n", "s.numbers", r("s.number_credit", 6).alias("number_credit"), "s.claim_tp", "s.claim_fp", "s.claim_fn", r(SC.reward_description(got, want), 6).alias("reward"))


@query(f"""WITH {V}, s AS (SELECT *, (q % 5 = d % 5)::int AS answer FROM v) SELECT l_orderkey, n, round(0.7 * answer + CASE WHEN n % 2 = 0 THEN 0.3 * CASE WHEN d % 2 = 0 THEN 1 ELSE 0.15 END ELSE 0 END, 6)::double AS reward FROM s""")
def reasoned_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.char(F.col("q") % 5 + 65), F.char(F.col("d") % 5 + 65)
    got = F.when(even(), X.reasoned(F.lit("a car is moving"), a)).otherwise(a)
    want = X.reasoned(F.when(even("d"), "a car is moving").otherwise("a car is stationary"), b)
    return lines(spark, sf_dir).select("l_orderkey", "n", r(SC.reward_reasoned(SC.reward_choice, got, want), 6).alias("reward"))


@query(f"""WITH {V} SELECT l_orderkey, n, 2 AS tp, 0 AS fp, 0 AS fn, 1 AS id_checkable, (d % 2 = 0)::int AS id_carried, (0.5 + 0.5 * (d % 2 = 0)::int)::double AS reward FROM v""")
def tracking_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = say("History:\nt-2s: #5 car 9m az+0deg; #88 bus 58m az+0deg\nt-1s: #{n} car 10m az+0deg; #777 truck 30m az+5deg\nNow?")
    want = say("#{n} car 10m az+0deg; #88 bus 60m az-3deg")
    got = say("#{a} car 10m az+0deg; #88 bus 60m az-3deg", a=F.when(even("d"), F.col("n")).otherwise(F.col("n") + 100))
    scored = SC.let(lambda s: F.struct(*[s[k].alias(k) for k in ("tp", "fp", "fn", "id_checkable", "id_carried")], SC.tracking_reward(s).alias("reward")), SC.score_tracking(got, want, prompt))
    return lines(spark, sf_dir).withColumn("s", scored).select("l_orderkey", "n", "s.*")


@query(f"""WITH {V}, c AS (SELECT f, unnest([{{'cls': 'car', 'tp': (q % 2 = 0)::int, 'fp': 0, 'fn': (q % 2)::int}}, {{'cls': 'truck', 'tp': 0, 'fp': 0, 'fn': 1}}, {{'cls': 'bus', 'tp': 0, 'fp': (q % 2)::int, 'fn': 0}}]) AS c FROM v)
SELECT f, c.cls AS cls, sum(c.tp)::bigint AS tp, sum(c.fp)::bigint AS fp, sum(c.fn)::bigint AS fn, sum(c.tp + c.fn)::bigint AS n, round(sum(c.tp) / greatest(sum(c.tp + c.fp), 1), 6) AS "precision", round(sum(c.tp) / greatest(sum(c.tp + c.fn), 1), 6) AS recall FROM c GROUP BY f, c.cls HAVING sum(c.tp + c.fn) > 0""")
def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    want, got = F.lit("car 10m az+0deg; truck 40m az-20deg moving"), say("{a} {b}m az+0deg", a=F.when(even("q"), "car").otherwise("bus"), b=F.lit(10) + F.col("d") % 2)
    return SC.per_class_of_texts(lines(spark, sf_dir), ["f"], got, want).select("f", "cls", "tp", "fp", "fn", "n", r("precision", 6).alias("precision"), r("recall", 6).alias("recall"))


@query(f"""WITH {V} SELECT l_orderkey, n, 2 AS n_objects, n AS tid, NULL::int AS other_tid, (q + 5)::double AS ranges, -d::double AS azimuths, round(sqrt(q * q + d * d::double), 6) AS point_range, round(degrees(atan2(d, q)), 4) AS point_az, 12::double AS volume,
 CASE WHEN n % 12 * 30 >= 180 THEN n % 12 * 30 - 360 ELSE n % 12 * 30 END::double AS yaw, 'stopped' AS attr FROM v""")
def parsed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("l_orderkey", "n", X.objects(say("#{n} car {q}m az-{d}deg moving; truck 5m")).alias("polar"), X.objects(say("car ({q}.0m, +{d}.0m, 0.5m) size 4.0mx2.0mx1.5m heading {a} stopped", a=F.col("n") % 12))[0].alias("point"))
    polar, point = F.col("polar"), F.col("point")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    every = lambda k: total(F.transform(polar, lambda o: o[k]))
    volume = F.aggregate(point["size"], F.lit(1.0), lambda a, v: a * v)
    return rows.select("l_orderkey", "n", F.size(polar).alias("n_objects"), polar[0]["tid"].alias("tid"), polar[1]["tid"].alias("other_tid"), every("rng").alias("ranges"), every("az").alias("azimuths"), r(point["rng"], 6).alias("point_range"), r(point["az"], 4).alias("point_az"), volume.alias("volume"), point["yaw"].alias("yaw"), point["attr"].alias("attr"))


_NAMES = ["det_objects_azdeg", "plan_ego_control", "plan_ego_xy", "agent_traj_xy", "radar_probe_coarse", "retrieval", "qa_cot", "desc_clip", "ood_reasoning", "odd"]


@query(f"""WITH {V}, t AS (SELECT *, {_NAMES}[n % 10 + 1] AS task FROM v) SELECT l_orderkey, n, task, CASE WHEN task LIKE 'det_objects%' THEN 'det_objects' WHEN task LIKE 'plan_ego_control%' THEN 'plan_ego_control' WHEN task LIKE 'plan_ego%' THEN 'plan_ego' WHEN task LIKE 'agent_traj%' THEN 'agent_traj'
 WHEN task LIKE 'radar_probe%' THEN 'radar_probe' WHEN task = 'retrieval' THEN 'retrieval' WHEN task LIKE 'qa%' THEN 'qa' WHEN task LIKE 'desc%' THEN 'desc' WHEN task LIKE 'ood%' THEN 'ood' END AS family FROM t""")
def task_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines(spark, sf_dir).withColumn("task", F.element_at(F.array(*[F.lit(t) for t in _NAMES]), (F.col("n") % 10 + 1).cast("int")))
    return out.select("l_orderkey", "n", "task", SC.family(F.col("task")).alias("family"))


@query(f"""WITH {V}, s AS (SELECT *, list_transform([[q, d], [q + 30, 0]], lambda t: list_min([sqrt((t[1] - q)::double ** 2 + (t[2] - x)::double ** 2), sqrt((t[1] - 40)::double ** 2 + t[2]::double ** 2)])) AS c FROM v)
SELECT l_orderkey, n, round(c[1], 6) AS first_truth, round(c[2], 6) AS second_truth, round(least(abs(d)::double, (abs(x - d) + 3) / 2.0::double), 6) AS min_ade, (q <= 4)::int + (q BETWEEN 5 AND 14)::int AS collisions FROM s""")
def path_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(None).cast("double").alias("rng"), F.lit(None).cast("double").alias("az"))
    zero, q, d, x = F.lit(0), F.col("q"), F.col("d"), F.col("x")
    near = SC.chamfer(F.array(point(q, x), point(F.lit(40), zero)), F.array(point(q, d), point(q + 30, zero)))
    path = lambda *ps: F.map_from_arrays(F.array(*[F.lit(i + 1) for i in range(len(ps))]), F.array(*[F.array(a.cast("double"), b.cast("double")) for a, b in ps]))
    ade = SC.min_ade(F.array(path((q, d * 2)), path((q, x), (q + 3, zero))), path((q, d), (q, zero)))
    hits = SC.collides(F.array(F.array(F.lit(-0.5), F.lit(0.0)), F.array(F.lit(9.5), F.lit(0.0))), F.array(F.array(q.cast("double"), F.lit(0.25), F.lit(4.5), F.lit(1.0))))
    return lines(spark, sf_dir).select("l_orderkey", "n", r(near[0], 6).alias("first_truth"), r(near[1], 6).alias("second_truth"), r(ade, 6).alias("min_ade"), hits.alias("collisions"))


# ---------------------------------------------------------------- text forms


@query(f"""WITH {V} SELECT l_orderkey, n, 2 AS n_parts, q::double AS part_range, d::double AS part_az, q || chr(10) || 'b' AS squeezed, 'at ' || 2 * q || ' m and ' || (2 * d + 1) || ' s' AS doubled, q::double AS value, 'm' AS unit, least(q, 19) AS frame, CASE WHEN n % 2 = 0 THEN 'count' ELSE 'other' END AS form,
 'A. ' || q || chr(10) || 'B. ' || d AS options, CASE WHEN d > 0 THEN round(q / d::double, 4) END AS ratio, CASE WHEN d > 0 THEN round((q + d) / 2.0, 4) END::double AS mean_azimuth FROM v""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .functions import numbers as N

    parts = X.split_objects(say("#{n} car {q}m az{d}deg moving; odd part; truck 5m"))
    value, unit = X.split_unit(say(" {q}m "))
    asked = F.when(even(), "How MANY cars are there?").otherwise("Where are they?")
    options = F.map_from_arrays(F.array(F.lit("B"), F.lit("A")), F.array(F.col("d").cast("string"), F.col("q").cast("string")))
    azimuth = F.when(F.col("d") == 0, "none").otherwise(say("car 5m az-{q}deg; truck 7m az+{d}deg"))
    return lines(spark, sf_dir).select(
        "l_orderkey", "n", F.size(parts).alias("n_parts"), parts[0]["rng"].alias("part_range"), parts[0]["az"].alias("part_az"), X.squeeze(say("{q}<image>\n\n \nb")).alias("squeezed"),
        X.double_numbers(say("at {q} m and {d}.5 s")).alias("doubled"), value.alias("value"), unit.alias("unit"), X.frame_reference(say("see Frame {q} or frame 3")).alias("frame"),
        X.question_form(asked, [("how many", "count")]).alias("form"), X.options_text(options).alias("options"),
        N.finite(F.when(F.col("d") == 0, F.lit(float("inf"))).otherwise(F.col("q") / F.col("d").cast("double"))).alias("ratio"), r(X.mean_abs_azimuth(azimuth)).alias("mean_azimuth"),
    )


# ---------------------------------------------------------------- claims


@query(f"""WITH {V}, c AS (SELECT l_orderkey, n, q, d, x, unnest(['ego_pos', 'ego_speed', 'agent_pos', 'agent_speed', 'distance', 'future_pos']) AS kind FROM v)
SELECT l_orderkey, n, kind, n AS frame, CASE WHEN kind = 'future_pos' THEN d END::double AS horizon_s, CASE kind WHEN 'ego_pos' THEN q WHEN 'agent_pos' THEN -d WHEN 'future_pos' THEN q END::double AS x, CASE kind WHEN 'ego_pos' THEN d WHEN 'agent_pos' THEN q WHEN 'future_pos' THEN x END::double AS y,
 CASE kind WHEN 'ego_speed' THEN x WHEN 'agent_speed' THEN x + 0.5 WHEN 'distance' THEN q END::double AS value FROM c""")
def claims_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = say("In Frame {n} the ego vehicle is at pos=({q}, {d}) with a speed of {x} m/s. A car stands at position (-{d}, {q}, 1.5)! It has a velocity of {x}.5 m/s. A truck is {q} m away. By its speed it will be at t={d} s near ({q}, {x}). It is 5 m/s fast.")
    out = C.claims(lines(spark, sf_dir).withColumn("text", text), "text").select("l_orderkey", "n", F.explode("claims").alias("c"))
    return out.select("l_orderkey", "n", "c.kind", "c.frame", "c.horizon_s", F.col("c.x") + 0.0, F.col("c.y"), "c.value").toDF("l_orderkey", "n", "kind", "frame", "horizon_s", "x", "y", "value")


_KINDS = ["ego_pos", "ego_speed", "agent_pos", "agent_speed", "distance", "future_pos"]
_CHECKED = f"""{V}, k AS (SELECT *, {_KINDS}[n % 6 + 1] AS kind FROM v), e AS (SELECT *, CASE kind WHEN 'ego_pos' THEN d WHEN 'ego_speed' THEN abs(10 - q) WHEN 'agent_pos' THEN sqrt((x * x + d * d)::double) WHEN 'agent_speed' THEN abs(5 - q) WHEN 'distance' THEN abs(20 - q) ELSE least(d, abs(10 - d)) END::double AS error,
 CASE kind WHEN 'ego_pos' THEN 3 WHEN 'ego_speed' THEN 1 WHEN 'agent_speed' THEN 1.5 ELSE 5 END AS tolerance FROM k WHERE l_orderkey % 3 <> 0 OR kind IN ('ego_pos', 'ego_speed', 'future_pos')),
u AS (SELECT l_orderkey, n, kind, CASE WHEN l_orderkey % 3 = 0 AND kind = 'future_pos' THEN d::double ELSE error END AS error, tolerance FROM e)"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One claim for each order line, against an ego and (for two orders in three) an object that stand still."""
    li = lines(spark, sf_dir).withColumn("kind", F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("n") % 6 + 1).cast("int")))
    place, speed = F.col("kind").isin("ego_pos", "future_pos"), F.col("kind").isin("ego_speed", "agent_speed", "distance")
    x = F.when(place, F.col("d")).when(F.col("kind") == "agent_pos", F.col("x") + 10)
    y = F.when(place, 0).when(F.col("kind") == "agent_pos", F.col("d"))
    found = li.select(F.col("l_orderkey").alias("clip_id"), "n", "kind", F.lit(1).alias("frame"), F.lit(None).cast("double").alias("horizon_s"), x.cast("double").alias("x"), y.cast("double").alias("y"), F.when(speed, F.col("q")).cast("double").alias("value"), "q", "d")
    found = C.numbered(found, ["clip_id"], ["n", "q", "d", "x", "value"]).drop("q", "d")
    clips = found.select("clip_id").distinct()
    number = lambda v, name: F.lit(float(v)).alias(name)
    ego = clips.select("clip_id", number(0, "t"), number(0, "x"), number(0, "y"), number(10, "speed"))
    objects = clips.where(F.col("clip_id") % 3 != 0).select("clip_id", F.lit(1).alias("track_id"), number(0, "t"), number(10, "wx"), number(0, "wy"), number(5, "speed"), number(20, "rng"))
    return C.evaluate(found, ego, objects)


@query(f"""WITH {_CHECKED}, all_lines AS (SELECT DISTINCT l_orderkey FROM v), s AS (SELECT l_orderkey, count(*) AS n_checks, count_if(error <= tolerance) AS n_pass FROM u GROUP BY l_orderkey)
SELECT l_orderkey AS clip_id, coalesce(n_checks, 0) AS n_checks, coalesce(n_pass, 0) AS n_pass, CASE WHEN coalesce(n_checks, 0) = 0 THEN 'unchecked' WHEN n_pass = n_checks THEN 'agrees' ELSE 'disagrees' END AS status FROM all_lines LEFT JOIN s USING (l_orderkey)""")
def claim_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.status(_checked(spark, sf_dir), ["clip_id"])


@query(f"""WITH {_CHECKED} SELECT kind, count(*) AS n, round(avg((error <= tolerance)::int), 6) AS rate, round(median(error), 4) AS median_error, round(quantile_cont(error, 0.9), 4) AS p90_error FROM u GROUP BY kind""")
def claim_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.quality_report(_checked(spark, sf_dir))
    return out.select("kind", "n", r("rate", 6).alias("rate"), r("median_error").alias("median_error"), r("p90_error").alias("p90_error"))


@query(f"""WITH {V} SELECT l_orderkey, n, CASE n % 5 WHEN 0 THEN 'comparative' WHEN 1 THEN 'range' WHEN 2 THEN 'arithmetic' WHEN 3 THEN 'safe' ELSE 'answer_dependent' END AS verdict, d || '.4' AS alike, 'at 7 m, not ' || d || ' m' AS replaced,
 CASE n % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'missing' WHEN 2 THEN 'no_question_suffix' ELSE 'wrong_chunk' END AS defect, 'chunk_' || lpad((q % 100)::varchar, 4, '0') || '_c' || l_orderkey || '.mp4_Q' || n AS expected, CASE WHEN n % 2 = 0 THEN 'A,B,C,D,E' ELSE 'A,B,D,E,C' END AS letters, CASE WHEN n % 2 = 0 THEN 5 ELSE 5 END AS n_options FROM v""")
def claim_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n") % 5
    sentence = F.when(k == 0, say("It is {q} m/s faster.")).when(k == 1, say("It is {q}-{d} m off.")).when(k == 2, say("The sum is {q} m.")).otherwise(say("It moves at {q} m/s."))
    question = F.when(k == 4, say("Is it at {q} m?")).otherwise(F.lit("Where is it?"))
    verdict = C.verdict(F.col("q").cast("string"), sentence, question, F.create_map(F.lit("A"), F.lit("none")))
    start = F.lit(3)
    replaced = C.substitute(say("at {q} m, not {d} m"), F.array(F.struct(start.alias("start"), (start + F.length(F.col("q").cast("string"))).alias("end"), F.lit("7").alias("text"))))
    clip, chunk, good = say("c{l_orderkey}"), F.col("q") % 100, C.expected_id(F.col("q") % 100, say("c{l_orderkey}"), F.col("n"))
    ident = F.when(F.col("n") % 4 == 0, good).when(F.col("n") % 4 == 1, "").when(F.col("n") % 4 == 2, "chunk_0001").otherwise(C.expected_id(F.col("q") % 100 + 1, clip, F.col("n")))
    filled = C.pad_options(F.when(even(), F.create_map(*[F.lit(x) for x in ("A", "a", "B", "b", "C", "c", "D", "Not sure")])).otherwise(F.create_map(*[F.lit(x) for x in ("A", "a", "B", "b", "D", "d", "E", "e")])), ["not sure", "None of these"])
    return lines(spark, sf_dir).select(
        "l_orderkey", "n", verdict.alias("verdict"), C.like(say("{q}.5"), F.col("d") + F.lit(0.37)).alias("alike"), replaced.alias("replaced"), C.bad_id(ident, chunk, clip).alias("defect"), good.alias("expected"),
        F.array_join(F.map_keys(filled), ",").alias("letters"), F.size(filled).alias("n_options"),
    )


@query("""SELECT l_orderkey AS clip_id, count(*)::int AS n_qa, string_agg('chunk_' || lpad((l_orderkey % 1000)::varchar, 4, '0') || '_' || l_orderkey || '.mp4_Q' || i, ',' ORDER BY i) AS ids FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey) AS i FROM lineitem WHERE l_returnflag <> 'R') GROUP BY l_orderkey""")
def dropped_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.concat_ws("-", "l_linenumber", "l_quantity").alias("id"), F.array(F.struct(F.when(F.col("l_returnflag") == "R", "range").when(F.col("l_returnflag") == "A", "safe").alias("verdict"))).alias("corrections"))
    docs = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("clip_id"), F.pmod("l_orderkey", F.lit(1000)).cast("int").alias("chunk")).agg(F.array_sort(F.collect_list(item)).alias("qa"))
    out = C.drop_unsafe(docs, ["range", "comparative"])
    return out.select(F.col("clip_id").cast("long").alias("clip_id"), "n_qa", F.array_join(F.transform("qa", lambda q: q["id"]), ",").alias("ids"))
