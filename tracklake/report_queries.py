"""Queries over catalogs, loader branches, reports, geometry and scans, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .answer_queries import V, even, lines, say
from .functions import geometry as G
from .operators import temporal as TE
from .operators import tracks as TR
from .plans import catalog as CA
from .plans import loader as LO
from .plans import reports as RE
from .plans import scenes as SE
from .queries import DAY, E, events, query, r, read

# ---------------------------------------------------------------- geometry


@query(f"""WITH {V}, g AS (SELECT *, q * 1.0::double AS a, d + 0.3::double AS b, 30.0::double + x AS c FROM v), t AS (SELECT *, sqrt(a * a + b * b) AS flat, sqrt(a * a + b * b + c * c) AS far FROM g)
SELECT l_orderkey, n, round(a * 500 * atan2(flat, c) / flat + 960, 3) AS u, round(b * 500 * atan2(flat, c) / flat + 540, 3) AS v, round(a / far, 4) AS rx, round(b / far, 4) AS ry, round(c / far, 4) AS rz, round(degrees(atan2(-a, c)), 3) AS azimuth, atan2(flat, c) > 1 AS hidden FROM t""")
def lens(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, zero = F.lit(1.0), F.lit(0.0)
    centre, cde = (F.lit(960.0), F.lit(540.0)), (one, zero, zero)
    point = (F.col("q") * 1.0, F.col("d") + 0.3, F.col("x") + 30.0)
    u, v = G.project(point, F.array(zero, F.lit(500.0)), centre, cde, F.lit(3.0))
    rows = lines(spark, sf_dir).withColumn("pu", u).withColumn("pv", v).withColumn("hidden", G.project(point, F.array(zero, F.lit(500.0)), centre, cde, one)[0].isNull())
    inverse = F.array(zero, F.lit(1 / 500.0))
    ray = G.unproject(F.col("pu"), F.col("pv"), inverse, centre, cde)
    # camera to rig: forward is the camera's z, left is against its x
    rig = (zero, zero, one, -one, zero, zero, zero, -one, zero)
    azimuth = G.camera_azimuth(F.col("pu"), F.col("pv"), inverse, centre, cde, rig)
    return rows.select("l_orderkey", "n", r("pu", 3).alias("u"), r("pv", 3).alias("v"), *[r(c).alias(k) for k, c in zip(("rx", "ry", "rz"), ray, strict=True)], r(azimuth, 3).alias("azimuth"), "hidden")


@query(f"""WITH {V}, c AS (SELECT *, list_transform([[-2, -1, -0.75], [-2, -1, 0.75], [-2, 1, -0.75], [-2, 1, 0.75], [2, -1, -0.75], [2, -1, 0.75], [2, 1, -0.75], [2, 1, 0.75]], lambda s: [(q - 25 + s[1]) * 100.0 / (20.003 + x + s[3]) + 320, (d - 5 + s[2]) * 100.0 / (20.003 + x + s[3]) + 240]::double[]) AS p FROM v),
b AS (SELECT l_orderkey, n, list_min(list_transform(p, lambda a: a[1])) AS x1, list_max(list_transform(p, lambda a: a[1])) AS x2, list_min(list_transform(p, lambda a: a[2])) AS y1, list_max(list_transform(p, lambda a: a[2])) AS y2 FROM c)
SELECT l_orderkey, n, round(least(greatest(x1, 0), 399), 3) AS x1, round(least(greatest(x2, 0), 399), 3) AS x2, round(y1, 3) AS y1, round(y2, 3) AS y2 FROM b WHERE least(greatest(x2, 0), 399) - least(greatest(x1, 0), 399) >= 2""")
def image_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0.0)
    straight = G.rotation(zero, zero, zero, F.lit(2.0))
    points = G.corners((F.col("q") - 25.0, F.col("d") - 5.0, F.col("x") + 20.003), (F.lit(4.0), F.lit(2.0), F.lit(1.5)), straight)
    box = G.image_box([(px * 100.0 / pz + 320, py * 100.0 / pz + 240) for px, py, pz in points], F.lit(400.0), F.lit(480.0))
    out = lines(spark, sf_dir).withColumn("b", box).where("b IS NOT NULL")
    return out.select("l_orderkey", "n", *[r(F.col("b")[i], 3).alias(k) for i, k in enumerate(("x1", "y1", "x2", "y2"))])


@query(f"""WITH {V}, h AS (SELECT *, radians(n * 25) AS h, q * 1.01::double AS px, d - 5.02::double AS py FROM v), g AS (SELECT *, degrees(atan2(py, px)) AS az, sqrt(px * px + py * py) AS rng FROM h)
SELECT l_orderkey, n, round(cos(h) * (px - x) + sin(h) * (py - 1), 4) AS forward, round(cos(h) * (py - 1) - sin(h) * (px - x), 4) AS leftward, round(CASE WHEN n * 25 % 360 > 180 THEN n * 25 % 360 - 360 ELSE n * 25 % 360 END, 4)::double AS yaw,
 CASE WHEN q > 40 THEN 'LEFT' WHEN q < 10 THEN 'RIGHT' ELSE 'STRAIGHT' END AS command, CASE WHEN d > 6 THEN 'accelerating' WHEN d < 4 THEN 'braking' ELSE 'steady' END || ', ' || CASE WHEN q > 33 THEN 'turning left' WHEN q < 17 THEN 'turning right' ELSE 'straight' END AS action,
 CASE WHEN x > 1 THEN 'moving' ELSE ['with_rider', 'stopped', 'standing'][n % 3 + 1] END AS state, CASE WHEN abs(az) <= 60 AND rng < 40 THEN floor(rng / 10)::int * 12 + least(floor((az + 60) / 10), 11)::int END AS cell,
 round(-(px * 8 + py * 0.5) / sqrt(px * px + py * py + x * x), 4) AS radial, round(degrees(atan2(cos(0.1::double) * (py - 0.5) - sin(0.1::double) * (px - 8), cos(0.1::double) * (px - 8) + sin(0.1::double) * (py - 0.5))), 3) AS later FROM g""")
def ego_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lines(spark, sf_dir).withColumn("h", F.radians(F.col("n") * 25)).withColumn("px", F.col("q") * 1.01).withColumn("py", F.col("d") - 5.02)
    px, py, zero = F.col("px"), F.col("py"), F.lit(0.0)
    forward, leftward = G.to_frame(px, py, (F.col("x"), F.lit(1)), F.col("h"))
    yaw = F.degrees(G.yaw(zero, zero, 2 * F.sin(F.col("h") / 2), 2 * F.cos(F.col("h") / 2)))
    kind = F.element_at(F.array(F.lit("rider"), F.lit("car"), F.lit("person")), (F.col("n") % 3 + 1).cast("int"))
    radial, later = G.expected_static((px, py, F.col("x")), (F.lit(8.0), F.lit(0.5), zero), F.lit(0.1), 1.0)
    return v.select(
        "l_orderkey", "n", r(forward).alias("forward"), r(leftward).alias("leftward"), r(yaw).alias("yaw"), G.nav_command(F.col("q") - 25).alias("command"), G.ego_action((F.col("d") - 5) * 1.0, (F.col("q") - 25) * 1.0).alias("action"),
        G.object_attribute(kind, F.col("x") * 1.0).alias("state"), G.grid_cell(px, py).alias("cell"), r(radial).alias("radial"), r(later, 3).alias("later"),
    )


# ---------------------------------------------------------------- time and scans


@query(f"""WITH {E}, a AS (SELECT event_id AS anchor, user_id, t AS t_end FROM e WHERE event_type = 'purchase'), g AS (SELECT anchor, user_id, slot::int AS slot, t_end - (2 - slot) * 86400000000 AS t FROM a, (SELECT unnest(range(0, 3)) AS slot))
SELECT g.anchor, g.user_id, g.slot, min(e.t) - any_value(g.t) AS wait FROM g LEFT JOIN e ON e.user_id = g.user_id AND e.t >= g.t GROUP BY g.anchor, g.user_id, g.slot""")
def next_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    ends = ev.where("event_type = 'purchase'").select(F.col("event_id").alias("anchor"), "user_id", "t")
    out = TE.as_of_forward(TE.fixed_rate(ends, "t", 3, DAY), ev, ["user_id"], "t", ["value"], ["event_id"])
    return out.select("anchor", "user_id", "slot", (F.col("next.t") - F.col("t")).cast("long").alias("wait"))


@query(f"""WITH {V}, b AS (SELECT l_orderkey, q, count(*) AS k, max(x) AS x FROM v GROUP BY ALL)
SELECT l_orderkey, count(*) AS n_tested, count_if(x > 3) AS n_with_return, count(*) - count_if(x > 3) AS n_camera_only FROM b GROUP BY l_orderkey""")
def frame_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = lines(spark, sf_dir).groupBy("l_orderkey", "q").agg(F.when(F.max("x") > 3, F.max("x")).otherwise(0).alias("n_points"))
    return TR.frame_evidence(boxes, ["l_orderkey"])


@query(f"""WITH {V}, p AS (SELECT l_orderkey, q, max(d) AS d FROM v GROUP BY ALL), b AS (SELECT l_orderkey, x, max(n) AS o FROM v GROUP BY ALL)
SELECT p.l_orderkey, q, arg_max('box' || x, o * 100 + x) AS label FROM p JOIN b ON p.l_orderkey = b.l_orderkey AND abs(d - x) <= 2 * 1.3 GROUP BY p.l_orderkey, q""")
def last_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lines(spark, sf_dir)
    points = v.groupBy("l_orderkey", "q").agg(F.max("d").cast("double").alias("x")).withColumn("y", F.lit(0.0)).withColumn("z", F.lit(0.0))
    boxes = v.groupBy("l_orderkey", F.col("x").alias("bx")).agg((F.max("n") * 100 + F.col("bx")).alias("order"))
    fixed = {"cy": 0.0, "cz": 0.0, "sx": 4.0, "sy": 4.0, "sz": 4.0, "qx": 0.0, "qy": 0.0, "qz": 0.0, "qw": 1.0}
    boxes = boxes.select("l_orderkey", "order", F.concat(F.lit("box"), F.col("bx").cast("string")).alias("label"), F.col("bx").cast("double").alias("cx"), *[F.lit(c).alias(k) for k, c in fixed.items()])
    return TR.last_box(points, boxes, ["l_orderkey"], "q", "order", "label")


@query(f"""WITH {V} SELECT l_orderkey, round(sum(d) + ln(1 + count(*)) / 64, 6) AS pooled_sum, max(d)::double AS pooled_max, round(ln(1 + count(*)) / 7, 6) AS count_target, count(DISTINCT x) AS n_occupied FROM v GROUP BY l_orderkey""")
def pooled_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lines(spark, sf_dir)
    cells = TR.window_occupancy(v, ["l_orderkey"], "x", 12)
    pooled = TR.masked_pool(v.withColumn("d", F.col("d").cast("double")), ["l_orderkey"], "d")
    return pooled.join(cells, "l_orderkey").select("l_orderkey", r("pooled_sum", 6).alias("pooled_sum"), "pooled_max", r("count_target", 6).alias("count_target"), F.size(F.filter("occupied", lambda o: o)).cast("long").alias("n_occupied"))


@query("""WITH t AS (SELECT o_custkey, o_orderpriority AS track, min(o_orderkey) AS first_frame, max(o_orderkey) AS last_frame, count(*) AS n, arg_max(o_totalprice, o_orderkey) AS last_range, bool_or(o_orderstatus = 'F') AS confirmed FROM orders GROUP BY ALL HAVING count(*) >= 2)
SELECT o_custkey, track, first_frame, last_frame, n, last_range, confirmed FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY last_range, track) AS k FROM t) WHERE k <= 2""")
def track_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumn("ok", F.col("o_orderstatus") == "F").withColumnRenamed("o_orderpriority", "track")
    return TR.track_records(o, ["o_custkey"], "track", "o_orderkey", "o_totalprice", "ok", 2)


@query("""SELECT l_orderkey, l_linenumber, slot FROM (SELECT l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R') DESC, l_extendedprice DESC, l_linenumber) - 1)::int AS slot FROM lineitem) WHERE slot < 3""")
def point_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("moving"), F.col("l_extendedprice").alias("rcs"), F.col("l_linenumber").alias("point"))
    return SE.point_cloud(scans, ["l_orderkey"], 3).select("l_orderkey", "l_linenumber", "slot")


@query("""WITH k AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_extendedprice) AS i, l_quantity AS a, l_discount AS b FROM lineitem)
SELECT l_orderkey, m AS n_real, (i - 1)::int AS slot, a, b FROM (SELECT *, least(count(*) OVER (PARTITION BY l_orderkey), 3) AS m FROM k) WHERE i <= 3""")
def padded_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = RE.padded(read(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.desc("l_quantity"), "l_extendedprice"], ["l_quantity", "l_discount"], 3)
    out = out.withColumn("n_real", F.size(F.filter("mask", lambda m: m)).cast("long"))
    return RE.sparse(out, ["l_orderkey", "n_real"]).select("l_orderkey", "n_real", "slot", F.col("point")[0].alias("a"), F.col("point")[1].alias("b"))


# ---------------------------------------------------------------- catalogs


@query("""WITH c AS (SELECT c_custkey, c_acctbal > 5000 AS s, c_nationkey % 2 = 0 AS m, c_mktsegment LIKE 'A%' AS l FROM customer)
SELECT c_custkey, CASE WHEN m THEN 'mrr2' WHEN s THEN 'srr0' ELSE 'lrr1' END AS radar, CASE WHEN l THEN 'lrr1' WHEN m THEN 'mrr2' ELSE 'srr0' END AS preferred, CASE WHEN s THEN 'S' ELSE '' END || CASE WHEN m THEN 'M' ELSE '' END || CASE WHEN l THEN 'L' ELSE '' END AS profile, c_custkey % 3 <> 2 AS train, c_custkey % 3 = 2 AS test FROM c WHERE s OR m OR l""")
def radar_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").withColumn("has_srr0", F.when(F.col("c_acctbal") > 5000, True)).withColumn("has_mrr2", F.col("c_nationkey") % 2 == 0).withColumn("has_lrr1", F.col("c_mktsegment").startswith("A"))
    split = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("c_custkey") % 3 + 1).cast("int"))
    out = CA.claimed_by_first(c, ["mrr2", "srr0", "lrr1"])
    return out.select("c_custkey", "radar", CA.preferred_radar().alias("preferred"), CA.profile().alias("profile"), CA.in_split(split, "train").alias("train"), CA.in_split(split, "test").alias("test"))


@query("""WITH s AS (SELECT o_custkey, string_agg(DISTINCT 'radar_' || o_orderstatus, ',' ORDER BY 'radar_' || o_orderstatus) AS sensors FROM orders WHERE o_orderpriority NOT LIKE '5%' GROUP BY o_custkey)
SELECT c_custkey AS clip_id, sensors AS radar_extrinsics_sensors, sensors IS NOT NULL AS has_radar_extrinsics FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def calibrated_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("clip_id"), F.concat(F.when(F.col("o_orderpriority").startswith("5"), "camera_").otherwise("radar_"), "o_orderstatus").alias("sensor_name"))
    return CA.extrinsics_index(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip_id")), names)


@query("""WITH u AS (SELECT o_custkey AS chunk, sum(o_totalprice) AS bytes FROM orders GROUP BY o_custkey HAVING count(DISTINCT CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END) = 2 AND count_if(o_orderstatus = 'P') > 0 AND o_custkey % 5 <> 0), t AS (SELECT * FROM u ORDER BY chunk LIMIT 50)
SELECT chunk, round(bytes, 2) AS bytes, round(sum(bytes) OVER (ORDER BY chunk), 2) AS bytes_so_far, round(sum(bytes) OVER (ORDER BY chunk) / 1000, 4) AS eta_s FROM t""")
def download_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty next chunks: the plan's own length."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chunk"), F.col("o_orderstatus").alias("component"), F.col("o_totalprice").alias("bytes"))
    out = CA.download_plan(o, o.select("chunk").distinct().where("chunk % 5 = 0"), ["F", "O"], ["P"], 50, 1000.0)
    return out.select("chunk", r("bytes", 2).alias("bytes"), r("bytes_so_far", 2).alias("bytes_so_far"), r("eta_s").alias("eta_s"))


@query("""SELECT x.s AS a, y.s AS b, count(*) AS shared FROM (SELECT DISTINCT o_custkey AS k, o_orderstatus AS s FROM orders) x JOIN (SELECT DISTINCT o_custkey AS k, o_orderstatus AS s FROM orders) y ON x.k = y.k AND x.s < y.s GROUP BY ALL""")
def split_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("clip_id"), "o_orderstatus")
    return CA.check_splits({s: o.where(F.col("o_orderstatus") == s) for s in "FOP"})


# ---------------------------------------------------------------- loader


_PROBE = "CASE n % 3 WHEN 0 THEN 'How many detections does the radar return?' WHEN 1 THEN 'How many detections move?' ELSE 'Within what range are nine tenths of the detections?' END"


@query(f"""WITH {V}, b AS (SELECT l_orderkey AS clip_id, 'radar_probe' AS task, n AS frame, {_PROBE} AS prompt, CASE n % 3 WHEN 1 THEN d ELSE q END::varchar AS target FROM v WHERE f <> 'A'
UNION ALL SELECT l_orderkey, 'radar_probe_coarse', n, {_PROBE}, printf('%.0f', CASE n % 3 WHEN 0 THEN round_even(q / 50.0::double, 0) * 50 WHEN 1 THEN round_even(d / 10.0::double, 0) * 10 ELSE round_even((q + 0.25) / 10.0::double, 0) * 10 END) FROM v WHERE f <> 'A'
UNION ALL SELECT l_orderkey, 'radar_transfer', n, CASE WHEN n % 2 = 0 THEN 'How many detections does the other radar return?' ELSE 'How many of its detections move?' END, CASE WHEN n % 2 = 0 THEN x ELSE d END::varchar FROM v WHERE f = 'N'
UNION ALL SELECT o_custkey, 'ood_reasoning', least(greatest((o_orderkey % 700) // 30 + 1, 1), 20)::int, 'What is unusual here?', o_orderpriority FROM orders) SELECT * FROM b WHERE length(prompt) + length(target) <= 50""")
def loader_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lines(spark, sf_dir).withColumn("seen", F.col("f") != "A").withColumn("both", F.col("f") == "N")
    given = lambda c, ok: F.when(F.col(ok), c)
    features = v.select(F.col("l_orderkey").alias("clip_id"), F.col("n").alias("frame"), given(F.col("q"), "seen").alias("lrr1_n_points"), F.col("d").alias("lrr1_n_moving"), (F.col("q") + 0.25).alias("lrr1_p90_range"), given(F.col("x"), "both").alias("mrr2_n_points"), F.col("d").alias("mrr2_n_moving"))
    odd = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("clip_id"), (F.col("o_orderkey") % 700).alias("start_frame"), F.col("o_orderpriority").alias("description"))
    return LO.load([LO.radar_probe(features, "lrr1"), LO.radar_probe(features, "lrr1", coarse=True), LO.radar_transfer(features), LO.ood(odd)], 50)


@query("""WITH c AS (SELECT c_custkey, c_acctbal, c_custkey % 4 AS k FROM customer WHERE c_acctbal > 0 AND c_custkey % 10 <> 0), q AS (SELECT c_custkey AS clip_id, least(c_custkey % 30, 19)::int AS frame, 'In Frame ' || (c_custkey % 30) || ', what is it?' || chr(10) || 'A. car' || chr(10) || 'B. bus' AS prompt, k FROM c)
SELECT clip_id, 'qa' AS task, frame, prompt, 'B' AS target FROM q UNION ALL SELECT clip_id, 'qa_cot', frame, prompt || ' Answer as JSON with "rationale" and "answer".', '{"rationale": "seen", "answer": "B"}' FROM q WHERE k IN (0, 3)""")
def question_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip_id"), "c_acctbal", (F.col("c_custkey") % 30).alias("at"), (F.col("c_custkey") % 4).alias("k"))
    asked = F.struct(
        say("In Frame {at}, what is it?").alias("question"), F.create_map(F.lit("B"), F.lit("bus"), F.lit("A"), F.lit("car")).alias("options"), F.lit("B").alias("answer"), F.when(F.col("k") == 2, "").otherwise("seen").alias("rationale"),
        F.struct(F.when(F.col("k") == 1, "disagrees").when(F.col("k") == 3, "agrees").alias("status")).alias("verification"),
    )
    docs, keep, held = c.select("clip_id", F.array(asked).alias("qa")), c.where("c_acctbal > 0").select("clip_id"), c.where("clip_id % 10 = 0").select("clip_id")
    return LO.qa(docs, keep, held).unionByName(LO.qa(docs, keep, held, cot=True))


@query("""SELECT o_orderkey AS clip_id, CASE WHEN o_orderkey % 2 = 0 THEN 'radar_probe' ELSE 'qa' END AS task, CASE WHEN o_orderkey % 2 = 0 AND coalesce(c_acctbal, 0) <= 0 THEN 'No radar is available for this clip.' ELSE o_orderpriority END AS target FROM orders LEFT JOIN customer ON c_custkey = o_orderkey""")
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clip_id"), F.when(even("o_orderkey"), "radar_probe").otherwise("qa").alias("task"), F.col("o_orderpriority").alias("target"))
    sensors = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip_id"), F.when(F.col("c_acctbal") > 0, "lrr1").alias("sensor"))
    return LO.refuse_without_sensor(items, sensors, ["radar_probe"]).select("clip_id", "task", "target")


@query("""SELECT c_custkey AS clip_id, 'retrieval' AS task, 11 AS frame, 'Tags for this clip?' AS prompt, lower(c_mktsegment) || CASE WHEN c_nationkey = 24 THEN '' WHEN c_nationkey >= 20 OR c_nationkey <= 5 THEN '; night' ELSE '; day' END || CASE c_custkey % 8 WHEN 0 THEN '; empty' WHEN 1 THEN '; light traffic' WHEN 2 THEN '; light traffic' WHEN 3 THEN '; light traffic' WHEN 4 THEN '; light traffic' ELSE '; dense traffic' END || CASE WHEN c_acctbal < 500 THEN '; standing' ELSE '' END AS target FROM customer""")
def retrieval_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "clip_id")
    clips = c.select("clip_id", F.col("c_mktsegment").alias("country"), F.nullif(F.col("c_nationkey"), F.lit(24)).alias("hour_of_day"))
    features = c.select("clip_id", F.lit(11).alias("frame"), (F.col("clip_id") % 8).alias("n_tracks"), (F.col("c_acctbal") / 1000).alias("ego_speed"))
    return LO.retrieval(clips, features.unionByName(features.withColumn("frame", F.lit(12))))


@query("""SELECT c_custkey, array_to_string(CASE c_custkey % 3 WHEN 0 THEN ['det', 'qa', 'ood'] WHEN 1 THEN ['qa', 'det'] ELSE ['x' || c_nationkey] END, '|') AS tasks FROM customer""")
def task_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.when(F.col("c_custkey") % 3 == 0, "all, ood,,qa").when(F.col("c_custkey") % 3 == 1, " qa , all, qa").otherwise(F.concat(F.lit("x"), F.col("c_nationkey").cast("string")))
    return read(spark, sf_dir, "customer").select("c_custkey", F.array_join(LO.expand_tasks(spec, ["det", "qa"]), "|").alias("tasks"))


@query("""SELECT user_id, string_agg('+' || (event_id % 100) || 's:s' || (value::int // 10) || 'a' || (event_id % 7) || 'y' || (event_id % 5), ' ' ORDER BY event_id) AS ego FROM events GROUP BY user_id""")
def ego_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_id", F.concat(F.lit("+"), (F.col("event_id") % 100).cast("string"), F.lit("s")).alias("label"), F.expr("cast(bround(value, 0) as int) div 10").alias("s"), (F.col("event_id") % 7).alias("a"), (F.col("event_id") % 5).alias("y"))
    return LO.ego_text(e, ["user_id"], "label", "event_id", "s", "a", "y")


# ---------------------------------------------------------------- reports


_LOSS = "SELECT f AS mode, 't' || (n % 3) AS task, sum(q)::double / sum(d + 1) AS loss, sum(x)::double / sum(n) AS digit_loss, sum(n % 2)::double / sum(n) AS digit_accuracy FROM v GROUP BY ALL"


def _losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select(F.col("f").alias("mode"), F.concat(F.lit("t"), (F.col("n") % 3).cast("string")).alias("task"), F.col("q").alias("loss_sum"), (F.col("d") + 1).alias("tokens"), F.col("x").alias("digit_loss_sum"), F.col("n").alias("digits"), (F.col("n") % 2).alias("digit_hits"))
    return RE.teacher_forced(rows)


@query(f"""WITH {V}, t AS ({_LOSS}) SELECT mode, task, round(loss, 6) AS loss, round(digit_loss, 6) AS digit_loss, round(digit_accuracy, 6) AS digit_accuracy, round(exp(loss), 4) AS perplexity FROM t""")
def teacher_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _losses(spark, sf_dir).select("mode", "task", r("loss", 6).alias("loss"), r("digit_loss", 6).alias("digit_loss"), r("digit_accuracy", 6).alias("digit_accuracy"), r("perplexity").alias("perplexity"))


@query(f"""WITH {V}, t AS ({_LOSS}), m AS (SELECT a.task, a.mode, a.loss - b.loss AS delta FROM t a JOIN t b ON a.task = b.task AND b.mode = 'N' AND a.mode <> 'N'), g AS (SELECT mode AS run, avg(CASE WHEN task IN ('t0', 't1') THEN delta END) AS a, avg(CASE WHEN task = 't2' THEN delta END) AS b FROM m GROUP BY mode)
SELECT run, round(a, 6) AS radar_gap, round(b, 6) AS camera_gap, CASE WHEN b > 1e-4 THEN round(a / b, 4) END AS selectivity FROM g""")
def loss_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = RE.mode_deltas(_losses(spark, sf_dir), "loss", "N").withColumnRenamed("mode", "run")
    out = RE.loss_gaps(deltas, ["t0", "t1"], ["t2"])
    return out.select("run", r("radar_gap", 6).alias("radar_gap"), r("camera_gap", 6).alias("camera_gap"), r("selectivity").alias("selectivity"))


@query(f"""WITH {V}, m AS (SELECT f, median(d) AS m FROM v WHERE n % 6 <> 0 GROUP BY f) SELECT f, count(*) AS n, round(avg(abs(q - d)), 6) AS mae, round(avg(abs(m - d)), 6) AS baseline_mae, round(corr(q, d), 6) AS corr, (SELECT round(sum(n % 2)::double / sum(n), 6) FROM v w WHERE w.f = v.f) AS micro_accuracy FROM v JOIN m USING (f) WHERE n % 6 <> 0 GROUP BY f""")
def numeric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lines(spark, sf_dir)
    pairs = v.select("f", F.when(F.col("n") % 6 != 0, F.col("q")).cast("double").alias("pred"), F.col("d").cast("double").alias("truth"))
    micro = RE.micro_macro(v.select("f", (F.col("n") % 2).alias("hits"), F.col("n").alias("valid"), F.col("d").alias("mae")), ["f"])
    out = RE.numeric_report(pairs, ["f"]).join(micro, "f")
    return out.select("f", "n", *[r(c, 6).alias(c) for c in ("mae", "baseline_mae", "corr", "micro_accuracy")])


@query("""WITH v AS (SELECT l_suppkey AS seed, sum(l_quantity) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey) SELECT l_suppkey AS seed, count(*) AS n, round(avg(l_discount), 6) AS score FROM lineitem WHERE l_returnflag = 'N' AND l_suppkey = (SELECT seed FROM v ORDER BY m DESC, seed LIMIT 1) GROUP BY l_suppkey""")
def best_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "seed")
    val = li.where("l_returnflag = 'R'").groupBy("seed").agg(F.sum("l_quantity").alias("m"))
    test = li.where("l_returnflag = 'N'").groupBy("seed").agg(F.count("*").alias("n"), r(F.avg("l_discount"), 6).alias("score"))
    return RE.select_seed(val, test, "m")


@query("""SELECT o_orderkey AS step, o_totalprice AS m FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 7""")
def kept_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven best: the report's own length."""
    return RE.keep_best(read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("m")), "m", 7)


@query(f"""WITH {V} SELECT l_orderkey, n, CASE WHEN n % 3 = 0 THEN 'd' WHEN n % 3 = 1 THEN 'x' END AS metric, CASE WHEN n % 3 = 0 THEN d WHEN n % 3 = 1 THEN x END AS value FROM v""")
def first_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lines(spark, sf_dir)
    table = v.select("l_orderkey", "n", F.when(F.col("n") % 3 == 0, F.col("d")).alias("d"), F.when(F.col("n") % 3 <= 1, F.col("x")).alias("x"))
    return RE.first_metric(table, ["d", "x"]).select("l_orderkey", "n", "metric", "value")


@query(f"""WITH {V} SELECT f, round(avg(d), 6) AS l2_1s, round(avg(CASE WHEN n % 2 = 0 THEN x END), 6) AS l2_2s, NULL::double AS l2_3s FROM v GROUP BY f""")
def horizon_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = F.concat(say("+1s ({q}m, {a}m)", a=F.col("x") + F.col("d")), F.when(even(), say("; +2s ({q}.5m, {a}m)", a=F.col("d") - F.col("x"))).otherwise("; +3s (1m, -1m)"))
    rows = lines(spark, sf_dir).select("f", got.alias("generated"), say("+1s ({q}m, {x}m); +2s ({q}.5m, {d}m)").alias("reference"))
    return RE.horizon_errors(rows, ["f"]).select("f", *[r(f"l2_{h}s", 6).alias(f"l2_{h}s") for h in (1, 2, 3)])


@query(f"""WITH {V}, c AS (SELECT f, unnest([least(d, 60 - q), 0])::double AS d FROM v WHERE n % 4 <> 0) SELECT f, round(median(d), 6) AS chamfer, round(avg((d <= 2)::int), 6) AS within, (SELECT round(avg((n % 4 <> 0)::int), 6) FROM v w WHERE w.f = c.f) AS carries FROM c GROUP BY f""")
def detection_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = F.when(F.col("n") % 4 == 0, "none").otherwise(say("car {a}m az+0deg; truck 60m az+0deg", a=F.col("q") + F.col("d")))
    rows = lines(spark, sf_dir).select("f", got.alias("generated"), say("car {q}m az+0deg; truck 60m az+0deg").alias("reference"))
    share = RE.contains_share(rows, ["f"], "generated", {"carries": "truck "})
    return RE.detection_distances(rows, ["f"]).join(share, "f").select("f", r("chamfer", 6).alias("chamfer"), r("within", 6).alias("within"), r("carries", 6).alias("carries"))


@query("""SELECT conv_id, count(*) AS n, count(DISTINCT text) AS n_distinct, count(*) > 1 AND count(DISTINCT text) = 1 AS broken FROM conversations GROUP BY conv_id""")
def frame_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RE.frame_guard(read(spark, sf_dir, "conversations"), ["conv_id"], "text")


@query("""WITH s AS (SELECT c_nationkey, c_custkey % 13 AS tp, 20 + c_custkey % 7 AS a, 15 + c_custkey % 5 AS b FROM customer) SELECT c_nationkey, count(*) AS n, round(2.0 * sum(tp) / sum(a + b), 6)::double AS pooled, round(avg(2.0::double * tp / (a + b)), 6) AS per_sequence FROM s GROUP BY c_nationkey""")
def pooled_idf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "customer").select("c_nationkey", (F.col("c_custkey") % 13).alias("idtp"), (F.col("c_custkey") % 7 + 20).alias("n_predicted"), (F.col("c_custkey") % 5 + 15).alias("n_truth"))
    s = s.withColumn("idf1", 2.0 * F.col("idtp") / (F.col("n_predicted") + F.col("n_truth")))
    return RE.pooled_idf1(s, ["c_nationkey"]).select("c_nationkey", "n", r("pooled", 6).alias("pooled"), r("per_sequence", 6).alias("per_sequence"))


@query("""WITH p AS (SELECT user_id, event_id, value, coalesce(sum((event_type = 'purchase')::int) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS part FROM events) SELECT user_id, part, round_even(avg(value), 4) AS confidence FROM p GROUP BY user_id, part""")
def token_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("piece", F.when(F.col("event_type") == "purchase", "x; ").otherwise("y"))
    return RE.token_confidences(e, ["user_id"], "event_id", "piece", "value")


@query("""WITH m AS (SELECT p_partkey, p_size / 10.0::double AS w, p_size % 4 + 1 AS s, p_size % 2 = 0 AS c FROM part) SELECT p_partkey, round(2.5::double * CASE WHEN c THEN 0.1 ELSE 1 END + w / s, 6) AS gib FROM m WHERE 2.5::double * CASE WHEN c THEN 0.1 ELSE 1 END + w / s <= 3.0001""")
def memory_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 10.0).alias("weights_gib"), (F.col("p_size") % 4 + 1).alias("shards"), even("p_size").alias("checkpointing"))
    return RE.memory_plan(modes, 40, 4096, 8192, 3.0001).select("p_partkey", r("gib", 6).alias("gib"))
