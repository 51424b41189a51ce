import io
import math
import random
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tracklake import schemas
from tracklake.functions import geometry as G
from tracklake.functions import numbers as N
from tracklake.functions import text as X
from tracklake.operators import claims as C
from tracklake.operators import sampling as SA
from tracklake.operators import scoring as SC
from tracklake.operators import stats as ST
from tracklake.operators import temporal as TE
from tracklake.operators import tracks as TR
from tracklake.plans import catalog, items, loader, reports, scenes
from tracklake.sources import readers, writers


def one(spark, column, **given):
    names = list(given) or ["_"]
    return spark.createDataFrame([Row(**{n: given.get(n, 0) for n in names})]).select(column.alias("v")).first()["v"]


def test_formatting_ties(spark):
    rows = spark.createDataFrame([(x,) for x in (0.5, 1.5, 2.5, -0.5, 12.5, -3.5)], "x double").select(N.fixed(F.col("x"), 0, True).alias("s")).collect()
    assert [r["s"] for r in rows] == [f"{x:+.0f}" for x in (0.5, 1.5, 2.5, -0.5, 12.5, -3.5)]


def test_gradient_and_unwrap_match_numpy(spark):
    rng = np.random.default_rng(1)
    t = np.cumsum(rng.uniform(0.05, 0.3, 50))
    y = np.cumsum(rng.normal(0, 2, 50))
    angle = (y + np.pi) % (2 * np.pi) - np.pi
    df = spark.createDataFrame([(1, float(a), float(b), float(c)) for a, b, c in zip(t, y, angle, strict=True)], "k int, t double, y double, a double")
    got = TE.unwrap(df.withColumn("g", TE.gradient("y", "t", ["k"], ["t"])), "a", ["k"], ["t"], 2 * math.pi, "u").orderBy("t").toPandas()
    assert np.allclose(got["g"], np.gradient(y, t)) and np.allclose(got["u"], np.unwrap(angle))


def test_neighbours_with_and_without_ranges(spark):
    rng = random.Random(2)
    series = [(k, rng.randrange(0, 1000), i) for i in range(300) for k in (0,)] + [(1, 5, 999)]
    grid = [(k, t) for k in (0, 1, 2) for t in range(-50, 1100, 7)]
    s, g = spark.createDataFrame(series, "k int, t long, id int"), spark.createDataFrame(grid, "k int, t long")
    want = {}
    for k, t in grid:
        mine = sorted((x, i) for kk, x, i in series if kk == k)
        want[k, t] = min((abs(x - t), x) for x, _ in mine)[1] if mine else None
    for width in (None, 64):
        got = {(r["k"], r["t"]): r["near"]["t"] if r["near"] else None for r in TE.nearest_join(g, s, ["k"], "t", [], ["id"], width).collect()}
        assert got == want


def test_band_join_boundaries(spark):
    a = spark.createDataFrame([(1, float(x)) for x in (0, 10, 20, 25)], "k int, t double")
    b = spark.createDataFrame([(1, float(x)) for x in (0, 9.99, 10, 15, 30, -10)], "k int, t_r double")
    got = sorted((r["t"], r["t_r"]) for r in TE.band_join(a, b, ["k"], "t", 10.0).collect())
    assert got == sorted((float(x), float(y)) for x in (0, 10, 20, 25) for y in (0, 9.99, 10, 15, 30, -10) if abs(x - y) <= 10)


def scene(spark):
    """The ego drives along x at 10 m/s for 2.9 s; two tracks stand, one drives along."""
    ts = [i / 10 for i in range(30)]
    ego = spark.createDataFrame([("c", int(t * 1e6), 10 * t, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0) for t in ts], schemas.EGOMOTION)
    world = {"100": ("automobile", lambda t: (40.0, 6.0)), "200": ("automobile", lambda t: (70 + 10 * t, 1.0)), "300": ("person", lambda t: (25.0, -8.0))}
    rows = [("c", k, int(t * 1e6), cls, at(t)[0] - 10 * t, at(t)[1], 0.0, 4.0, 2.0, 1.5, 0.0, 0.0, 0.0, 1.0, "rig") for k, (cls, at) in world.items() for t in ts]
    return ego, spark.createDataFrame(rows, schemas.OBSTACLE)


def test_toy_scene(spark):
    egomotion, obstacle = scene(spark)
    ego = items.ego_frame(egomotion)
    boxes = items.boxes_world(obstacle, ego)
    inside = G.in_front(F.col("cx"), F.col("cy"))
    world = {r["track_id"]: r for r in TR.track_summary(boxes, ["clip_id", "track_id"], "t", ["wx", "wy"], ["t"], F.hypot("cx", "cy"), inside, "label_class", per_second=1.0).collect()}
    rig = {r["track_id"]: r for r in TR.track_summary(boxes, ["clip_id", "track_id"], "t", ["cx", "cy"], ["t"], F.hypot("cx", "cy"), inside, per_second=1.0).collect()}
    assert [round(world[k]["net_disp"], 6) for k in ("100", "200", "300")] == [0, 29, 0]
    assert [round(rig[k]["net_disp"], 6) for k in ("100", "200", "300")] == [29, 0, 29]
    assert [world[k]["is_stationary"] for k in ("100", "200", "300")] == [True, False, True]
    at = spark.createDataFrame([("c", 3, 2.0)], "clip_id string, frame int, t double")
    seen = items.visible(at, boxes, reach=300.0).orderBy("rank").collect()
    assert [(r["track_id"], round(r["rng"], 2), round(r["az"], 2)) for r in seen] == [("300", 9.43, -57.99), ("100", 20.88, 16.7), ("200", 70.01, 0.82)]
    assert [r["track_id"] for r in items.visible(at, boxes).orderBy("rank").collect()] == ["300", "100"]


def test_items(spark):
    egomotion, obstacle = scene(spark)
    clips = spark.createDataFrame([("c", "train", True, True, False, False)], "clip_id string, split string, has_radar_extrinsics boolean, has_lrr1 boolean, has_mrr2 boolean, has_srr0 boolean")
    out = items.all_items(clips, egomotion, obstacle).collect()
    by = {(r["task"], r["frame"]): r["target"] for r in out}
    assert by["motion_seg_azdeg", 3] == "person 9m az-58deg stationary; automobile 21m az+17deg stationary"
    assert by["det_objects_azdeg", 7] == items.EMPTY
    assert {r["task"] for r in out} >= {"det_objects_3dbbox", "track_step_azdeg"}
    none = items.all_items(clips.withColumn("has_radar_extrinsics", F.lit(False)), egomotion, obstacle)
    assert none.count() == 0


def test_geometry(spark):
    df = spark.createDataFrame([(0.0, 0.0, math.sin(math.pi / 4), math.cos(math.pi / 4), 3.0, 4.0, 5.0)], "qx double, qy double, qz double, qw double, x double, y double, z double")
    r = G.rotation(*[F.col(c) for c in ("qx", "qy", "qz", "qw")])
    v = tuple(F.col(c) for c in "xyz")
    w = G.to_parent(r, (F.lit(1.0), F.lit(2.0), F.lit(3.0)), v)
    back = G.to_child(r, (F.lit(1.0), F.lit(2.0), F.lit(3.0)), w)
    got = df.select(*w, *back, G.yaw(*[F.col(c) for c in ("qx", "qy", "qz", "qw")])).first()
    assert np.allclose(got, [-3.0, 5.0, 8.0, 3, 4, 5, math.pi / 2])
    lens = (F.array(F.lit(0.0), F.lit(500.0)), (F.lit(960.0), F.lit(540.0)), (F.lit(1.0), F.lit(0.0), F.lit(0.0)))
    u, p = G.project((F.lit(1.0), F.lit(0.0), F.lit(1.0)), *lens, F.lit(1.2))
    ray = G.unproject(u, p, F.array(F.lit(0.0), F.lit(1 / 500)), lens[1], lens[2])
    got = df.select(u, p, *ray).first()
    assert np.allclose(got, [960 + 500 * math.pi / 4, 540, math.sqrt(0.5), 0, math.sqrt(0.5)])
    behind = G.project((F.lit(1.0), F.lit(0.0), F.lit(-1.0)), *lens, F.lit(1.2))
    assert df.select(*behind).first()[0] is None
    folded = G.doppler_residual((F.lit(10.0), F.lit(0.0), F.lit(0.0)), F.lit(6.0), (F.lit(16.0), F.lit(0.0), F.lit(0.0)), F.lit(22.0))
    bare = G.doppler_residual((F.lit(10.0), F.lit(0.0), F.lit(0.0)), F.lit(6.0), (F.lit(16.0), F.lit(0.0), F.lit(0.0)))
    assert df.select(folded, bare).first()[0:2] == (0.0, 22.0)
    codes = G.encode_steps(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.5), F.lit(1.0))), -10.0, 10.0)
    pts = df.select(G.decode_steps(codes, -10.0, 10.0).alias("p")).first()["p"]
    assert np.allclose(pts, [[1, 2], [2.5, 1]], atol=0.05)


def test_box_evidence(spark):
    points = spark.createDataFrame([(1, 10.0, 0.0, 0.0, 3.0, False), (1, 10.5, 0.4, 0.0, 5.0, True), (1, 50.0, 0.0, 0.0, 1.0, True)], "f int, x double, y double, z double, rv double, moving boolean")
    boxes = spark.createDataFrame([(1, "a", 10.0, 0.0, 0.0, 4.0, 2.0, 2.0, 0.0, 0.0, 0.0, 1.0), (1, "b", 90.0, 0.0, 0.0, 4.0, 2.0, 2.0, 0.0, 0.0, 0.0, 1.0)], "f int, box string, cx double, cy double, cz double, sx double, sy double, sz double, qx double, qy double, qz double, qw double")
    got = {r["box"]: r for r in TR.box_evidence(points, boxes, ["f"], "box", "rv", "moving").collect()}
    assert (got["a"]["n_points"], got["a"]["n_moving"], got["a"]["median_radial"]) == (2, 1, 5.0)
    assert (got["b"]["n_points"], got["b"]["median_radial"]) == (0, None)
    e = TR.frame_evidence(TR.box_evidence(points, boxes, ["f"], "box", "rv", "moving"), ["f"]).first()
    assert (e["n_tested"], e["n_with_return"], e["n_camera_only"]) == (2, 1, 1)


def test_parsing(spark):
    text = "#20 automobile 34 m az +13 deg moving; person (9.7m, -13.0m, 0.9m) size 4.5mx1.9mx1.5m heading 11 moving; #1 truck [117, 445, 387, 772] stationary; car 5m"
    got = one(spark, X.objects(F.lit(text)))
    assert [(o["tid"], o["cls"], o["moving"]) for o in got] == [(20, "automobile", True), (None, "person", True), (1, "truck", False), (None, "car", False)]
    assert got[0]["rng"] == 34 and got[0]["az"] == 13 and got[1]["size"] == [4.5, 1.9, 1.5] and got[1]["yaw"] == -30 and got[2]["bbox"] == [117, 445, 387, 772] and not got[3]["has_az"]
    assert one(spark, X.waypoints(F.lit("+1s (+12.5, +0.2); +2s (3, 4); +1s (1m, -1m)"))) == {1: [1.0, -1.0], 2: [3.0, 4.0]}
    assert one(spark, X.choice(F.lit("Answer: E"))) == "E" and one(spark, X.choice(F.lit("None"))) is None
    assert one(spark, X.rationale(F.lit('{"rationale": "because", "answer": "B"}'))[0]) == "because"
    assert [tuple(s) for s in one(spark, X.sentences(F.lit("One. Two!  Three 3.5 m")))] == [("One.", 0), ("Two!", 5), ("Three 3.5 m", 11)]
    assert one(spark, X.double_numbers(F.lit("a 2 b 1.5m"))) == "a 4 b 3m"


def test_scoring(spark):
    score = lambda g, r: one(spark, SC.score_objects(F.lit(g), F.lit(r)))
    truth = "automobile 34 m az +13 deg moving; automobile 20 m az -5 deg"
    s = score("; ".join(reversed(truth.split("; "))), truth)
    assert (s["tp"], s["fp"], s["fn"], s["class_ok"], s["motion_ok"]) == (2, 0, 0, 2, 2)
    s = score("person 200 m az -40 deg moving", truth)
    assert (s["tp"], s["fp"], s["fn"]) == (0, 1, 2)
    assert score("automobile 35 m az +13 deg", "automobile 34 m az +13 deg")["tp"] == 1 and score("automobile 40 m az +13 deg", "automobile 34 m az +13 deg")["tp"] == 0
    s = score("#77 automobile 34 m", "#20 automobile 34 m")
    assert (s["tp"], s["id_ok"], s["id_total"]) == (1, 0, 1)
    way = one(spark, SC.score_waypoints(F.lit("+1s (3, 4); +2s (1, 1)"), F.lit("+1s (0, 0)")))
    assert (way["horizons"], way["expected"], way["err"]) == (1, 1, 5.0)
    gone = one(spark, SC.score_trajectory(F.lit("+1s 22 m az +16 deg; +2s leaves the forward sector"), F.lit("+1s 20 m az +15 deg; +2s leaves the forward sector")))
    assert (gone["polar_n"], gone["range_err"], gone["gone_ok"], gone["horizons"]) == (1, 2.0, 1, 2)
    for text in (truth, "+1s (3, 4)"):
        assert one(spark, SC.reward_quantity(F.lit(text), F.lit(text))) == 1.0
    low, high = one(spark, SC.reward_description(F.lit("None are moving"), F.lit("All 2 are moving"))), one(spark, SC.reward_description(F.lit("All 2 are moving"), F.lit("All 2 are moving")))
    assert low < 0.5 < high == 1.0
    assert one(spark, SC.reward_tags(F.lit("a; B"), F.lit("b;c"))) == 0.5


def test_assignment_against_brute_force():
    from itertools import permutations

    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (3, 5), (5, 3), (4, 4), (6, 6)):
        g = rng.integers(0, 9, (n, m)).astype(float)
        best = max(sum(g[i, p[i]] for i in range(n)) for p in permutations(range(m), n)) if n <= m else max(sum(g[p[j], j] for j in range(m)) for p in permutations(range(n), m))
        pairs = ST.assignment(g)
        assert len(pairs) == min(n, m) and sum(g[i, j] for i, j in pairs) == best


def test_correlation_policies_and_student(spark):
    df = spark.createDataFrame([("a", float(i), 2.0 * i) for i in range(6)] + [("flat", 1.0, float(i)) for i in range(6)] + [("few", 1.0, 2.0)], "g string, x double, y double")
    got = {r["g"]: (r["p"], r["q"]) for r in df.groupBy("g").agg(ST.correlation("x", "y").alias("p"), ST.correlation("x", "y", 5, None).alias("q")).collect()}
    assert np.isclose(got["a"][0], 1) and got["flat"] == (0.0, None) and got["few"] == (None, None)
    assert np.isclose(ST.student_p(2.228, 10), 0.05, atol=2e-4) and ST.student_p(0, 5) == 1.0


def test_objects_are_parsed_once(spark, capsys):
    text = "x" * 300 + " ,;,, #7 car 5m; " + "van [1,2px,3,4]" + " stationary,car (1.5m, -2.0m, 3m) 4x2x1 m heading 7 vel 1m/s -2m/s stopped;" + ";, é\n" * 30_000 + "bus -6.5 m az +3 deg\tmoving"
    seven, van, point, bus = one(spark, X.objects(F.lit(text)))
    assert (seven["tid"], seven["cls"], seven["rng"], seven["az"], seven["has_az"]) == (7, "car", 5.0, 0.0, False)
    assert (van["bbox"], van["moving"], van["rng"], van["az"]) == ([1.0, 2.0, 3.0, 4.0], False, None, None)
    assert (point["size"], point["vel"], point["yaw"], point["attr"]) == ([4.0, 2.0, 1.0], [1.0, -2.0], -150.0, "stopped")
    assert (bus["rng"], bus["az"], bus["moving"], bus["attr"]) == (-6.5, 3.0, True, "moving")
    assert [one(spark, X.objects(F.lit(t))) for t in (None, "", ",,;", "car 5m/s")] == [[]] * 4
    spark.createDataFrame([(text,)], "t string").select(X.objects(F.col("t")).alias("o")).explain()
    assert capsys.readouterr().out.count("regexp_") == 1  # before, each part of an object had a pattern of its own


def test_class_counts_of_repeated_answers(spark):
    rows = [("a", "car 5m; bus 9m", "car 5m; truck 9m")] * 5 + [("a", "car 5m", None), ("b", None, "car 5m; car 8m"), ("b", "car 8m", "car 5m; car 8m"), ("b", "bus 5m", "")]
    df = spark.createDataFrame(rows, "k string, g string, r string")
    got = SC.per_class_of_texts(df, ["k"], F.col("g"), F.col("r")).collect()
    assert got == SC.per_class(df.withColumn("score", SC.score_objects(F.col("g"), F.col("r"))), ["k"]).collect()
    assert [(r["k"], r["cls"], r["tp"], r["fp"], r["fn"], r["n"]) for r in got] == [("a", "car", 5, 1, 0, 5), ("a", "truck", 0, 0, 5, 5), ("b", "car", 1, 0, 3, 4)]


def test_claims(spark):
    text = "In frame 3 the ego vehicle's velocity is (17.94, 1.53) m/s and its position is (90.22, 1.35). The ego vehicle's X-position is 349.69m. The red car has a speed of 6.79 m/s, around 17.6-17.9 m/s. It is 12.5 m away. The truck is predicted to be at t = 2.0 s at (5.0, 6.0)."
    got = [(c["kind"], c["frame"], c["x"], c["y"], c["value"]) for c in C.extract(text)]
    assert ("ego_pos", 3, 90.22, 1.35, None) in got and ("agent_speed", 3, None, None, 6.79) in got and ("distance", 3, None, None, 12.5) in got
    assert not any(k == "distance" and v == 349.69 for k, *_, v in got) and not any(v is not None and v < 0 for *_, v in got)
    assert ("future_pos", 3, 5.0, 6.0, None) in got and not any(k == "agent_pos" for k, *_ in got)
    assert all(text[a:b] for c in C.extract(text) for a, b in zip(c["starts"], c["ends"], strict=True))
    table = C.claims(spark.createDataFrame([(text,), (None,)], "t string"), "t").collect()
    assert len(table[0]["claims"]) == len(got) and table[1]["claims"] == []
    edits = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("XX").alias("text")), F.struct(F.lit(4).alias("start"), F.lit(5).alias("end"), F.lit("").alias("text")))
    assert one(spark, C.substitute(F.lit("abcdef"), edits)) == "XXbcdf"
    assert one(spark, C.like(F.lit("3.25"), F.lit(7.0))) == "7.00" and one(spark, C.like(F.lit("3"), F.lit(2.5))) == "2"
    verdict = lambda stated, sentence: one(spark, C.verdict(F.lit(stated), F.lit(sentence), F.lit("Is it 5.0 m?"), F.create_map(F.lit("A"), F.lit("7"))))
    assert [verdict("7", "x"), verdict("1", "17.6-17.9 m/s"), verdict("1", "a = b"), verdict("1", "faster"), verdict("1", "so")] == ["answer_dependent", "range", "arithmetic", "comparative", "safe"]
    assert one(spark, C.bad_id(F.lit("chunk_0001_x.mp4_Q1"), F.lit(1), F.lit("x"))) == "ok" and one(spark, C.bad_id(F.lit("chunk_0002_x.mp4_Q1"), F.lit(1), F.lit("x"))) == "wrong_chunk"
    assert one(spark, C.pad_options(F.create_map(F.lit("A"), F.lit("No"), F.lit("B"), F.lit("Yes")), ["no", "Maybe"])) == {"A": "No", "B": "Yes", "C": "Maybe"}


def test_claims_of_repeated_texts(spark, capsys):
    texts = [None, "", *(f"In Frame {i % 3} the EGO is at pos=({i}, -{i}.5) ; it is {i} m away. Frame 9: ſpeed of 3 m/s. Velocity of {i}.5 M/S" for i in range(12))]
    order = [texts[random.Random(i).randrange(len(texts))] for i in range(90)]
    want = [C.extract(t) for t in order]
    for limits in ((50_000, 1 << 26), (5, 1 << 26), (50_000, 600)):
        known = C.Remembered(*limits)
        assert [c for lo in range(0, 90, 7) for c in known.of(pa.array(order[lo : lo + 7], pa.string())).to_pylist()] == want
    assert len(C.Remembered().of(pa.array([], pa.string()))) == 0
    found = C.claims(spark.createDataFrame([(i, t) for i, t in enumerate(order)], "i int, t string"), "t").select("i", F.explode("claims").alias("c"))
    assert found.groupBy("i").count().count() == sum(map(bool, want))
    found.explain()  # each text is read once, although the rows of an explode are filtered before it
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1


def test_claim_checks(spark):
    ego = spark.createDataFrame([("c", t / 10, float(t), 0.0, 10.0) for t in range(30)], "clip_id string, t double, x double, y double, speed double")
    obj = spark.createDataFrame([("c", "1", t / 10, 40.0, 6.0, 0.0, 40.0 - t) for t in range(30)], "clip_id string, track_id string, t double, wx double, wy double, speed double, rng double")
    rows = [("c", 0, "ego_pos", 2, None, 10.5, 0.0, None), ("c", 1, "ego_speed", 2, None, None, None, 20.0), ("c", 2, "agent_pos", 2, None, 41.0, 6.0, None), ("c", 3, "distance", 2, None, None, None, 31.0), ("d", 4, "ego_pos", 2, None, 0.0, 0.0, None)]
    got = {r["claim_id"]: r for r in C.evaluate(spark.createDataFrame(rows, "clip_id string, claim_id int, kind string, frame int, horizon_s double, x double, y double, value double"), ego, obj).collect()}
    assert (got[0]["error"], got[0]["ok"]) == (0.5, True) and (got[1]["error"], got[1]["ok"]) == (10.0, False)
    assert got[2]["error"] == 1.0 and got[2]["computed"] == [40.0, 6.0] and got[3]["ok"] and got[4]["error"] is None
    status = {r["clip_id"]: r["status"] for r in C.status(spark.createDataFrame([("a", 1.0, True), ("b", 9.0, False), ("c", None, None)], "clip_id string, error double, ok boolean"), ["clip_id"]).collect()}
    assert status == {"a": "agrees", "b": "disagrees", "c": "unchecked"}


def test_sampling_is_the_same_for_any_partitioning(spark):
    df = spark.range(2000).withColumn("b", (F.col("id") % 3).cast("string")).withColumnRenamed("id", "i")
    draw = lambda d: sorted(r["i"] for r in SA.mixture(d, "b", {"0": 1.0, "1": 3.0}, 900, "i").collect())
    a, b = draw(df), draw(df.repartition(13))
    assert a == b and len(a) == 900 and sum(i % 3 == 1 for i in a) == 667
    thin = SA.thin(df, ["b"], "i", 16).groupBy("b").count().collect()
    assert all(16 <= r["count"] <= 667 for r in thin)


def test_sources(spark, tmp_path):
    def member(values):
        out = io.BytesIO()
        pq.write_table(pa.table({"timestamp": values, "x": [float(v) for v in values]}), out)
        return out.getvalue()

    with zipfile.ZipFile(tmp_path / "chunk_0001.zip", "w") as z:
        z.writestr("clipA.egomotion.parquet", member([1, 2, 3]))
        z.writestr("sub/clipB.egomotion.parquet", member([4]))
        z.writestr("clipC.egomotion.parquet", b"broken")
        z.writestr("clipD.other.parquet", member([9]))
    rows = readers.zip_members(spark, f"{tmp_path}/*.zip", ".egomotion", schemas.EGOMOTION).collect()
    assert sorted((r["clip_id"], r["timestamp"]) for r in rows if r["error"] is None) == [("clipA", 1), ("clipA", 2), ("clipA", 3), ("clipB", 4)]
    assert [r["clip_id"] for r in rows if r["error"]] == ["clipC"] and all(r["z"] is None for r in rows)
    points = np.zeros(3, readers.POINT)
    points["x"], points["rcs"] = [1, 2, 3], [0.5, 1, 2]
    assert readers.POINT.itemsize == 43
    (tmp_path / "a.pcd").write_bytes(b"VERSION 0.7\nPOINTS 3\nDATA binary\n" + points.tobytes())
    assert [r["x"] for r in readers.radar_points(spark, f"{tmp_path}/a.pcd").orderBy("point").collect()] == [1.0, 2.0, 3.0]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\nbroken\n')
    got = readers.json_lines(spark, f"{tmp_path}/l.jsonl", "a int").collect()
    assert sorted(r["a"] or 0 for r in got) == [0, 1, 2] and [r["_corrupt"] for r in got if r["a"] is None] == ["broken"]
    df = spark.createDataFrame([("c1", "t1", 1), ("c1", "t2", 2), ("c2", "t1", 1)], "clip_id string, task string, frame int")
    writers.bundle(df, f"{tmp_path}/bundle")
    expected = spark.createDataFrame([("t1", 2), ("t2", 1), ("t3", 1)], "task string, expected long")
    assert {r["task"]: r["ok"] for r in writers.verify_bundle(spark, f"{tmp_path}/bundle", expected).collect()} == {"t1": True, "t2": True, "t3": False}
    writers.only_new(df, f"{tmp_path}/shards", "clip_id")
    writers.only_new(df.unionByName(spark.createDataFrame([("c3", "t", 0)], df.schema)), f"{tmp_path}/shards", "clip_id")
    assert spark.read.parquet(f"{tmp_path}/shards").count() == 4
    (tmp_path / "run.log").write_text("step 10 loss 0.5\nnoise\nstep 20 loss 0.25\n")
    assert readers.log_matches(spark, f"{tmp_path}/run.log", r"step (\d+) loss ([0-9.]+)", ["step", "loss"]).count() == 2


def test_plans(spark):
    clips = spark.createDataFrame([("a", 1, "train", True, False, True), ("b", 1, "val", True, True, False), ("c", 2, "test", False, False, False)], "clip_id string, chunk int, split string, has_lrr1 boolean, has_mrr2 boolean, has_srr0 boolean")
    full = clips.withColumn("has_obstacle", F.lit(True)).withColumn("has_egomotion", F.lit(True)).withColumn("clip_is_valid", F.lit(True)).withColumn("has_radar_extrinsics", F.lit(True))
    held = spark.createDataFrame([("a",)], "clip_id string")
    assert {r["clip_id"]: r["sensor"] for r in catalog.usable(full, "train").collect()} == {"a": "lrr1", "b": "lrr1"}
    assert [r["clip_id"] for r in catalog.usable(full, "train", holdout=held).collect()] == ["b"]
    assert {r["clip_id"] for r in catalog.usable(full, "test", holdout=held).collect()} == {"a"}
    assert {r["profile"] for r in full.select(catalog.profile().alias("profile")).collect()} == {"SL", "ML", "none"}
    docs = spark.createDataFrame([("a", 1, "train", "f", 1, [("q1", "In frame 4 what?", {"B": "no", "A": "yes"}, "A", "because", "t", None, None)])], schemas.QA)
    row = loader.qa(docs, clips).first()
    assert (row["frame"], row["prompt"], row["target"]) == (4, "In frame 4 what?\nA. yes\nB. no", "A")
    cot = loader.qa(docs, clips, cot=True).first()
    assert cot["target"] == '{"rationale": "because", "answer": "A"}'
    gens = spark.createDataFrame([("qa", "full", "A", "A"), ("qa", "full", "B", "A"), ("qa", "shuffled", "B", "A")], "task string, mode string, generated string, reference string")
    assert reports.rescored(gens).first()["reward"] == 0.5
    frames = spark.createDataFrame([("c", 1, 2, "automobile", 12.0, 5.0, 0.0, 3.0, 10, 2, 1)], "clip_id string, frame int, n_tracks long, nearest_class string, nearest_range double, ego_speed double, ego_yaw_rate double, ego_travelled double, lrr1_n_points long, lrr1_n_moving long, n_moving long")
    texts = {r["kind"]: r["text"] for r in scenes.descriptions(frames).collect()}
    assert "2 road users" in texts["objects"] and "10 detections" in texts["radar"] and "covers 3 m" in scenes.clip_description(frames).first()["text"]


def test_streaming(spark, tmp_path):
    from tracklake.streaming import streams

    data = spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", m % 2, float(m)) for m in range(50)], "ts string, k int, v double").withColumn("ts", F.to_timestamp("ts"))
    data.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = streams.files(spark, f"{tmp_path}/in", "ts timestamp, k int, v double")
    q = streams.tumbling(stream, "ts", "10 minutes", ["k"], "v").writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["n"], r["total"]) for r in spark.table("tumbling").collect()) == sorted((5, float(sum(m for m in range(a, a + 10) if m % 2 == k))) for a in range(0, 50, 10) for k in (0, 1))
    with pytest.raises(Exception):  # noqa: B017
        streams.files(spark, f"{tmp_path}/in", "not a schema")


def test_ridge_against_rows(spark):
    """The moments give what numpy gives on the rows themselves."""
    import numpy as np

    rng = np.random.default_rng(4)
    rows = []
    for g, n in (("a", 400), ("b", 60), ("c", 12), ("d", 90)):
        x = rng.normal(size=(n, 3)) * [1, 50, 0.01] + [1000, -3, 0]
        y = x[:, 0] * 2 - x[:, 1] * 0.1 + rng.normal(size=n) + 500 if g != "d" else np.full(n, 7.0)
        rows += [(g, f"{g}{i}", *map(float, x[i]), float(y[i])) for i in range(n)]
    df = spark.createDataFrame([*rows, ("a", "null", None, 1.0, 1.0, 1.0)], "g string, id string, x0 double, x1 double, x2 double, y double")
    families = {"one": ["x0"], "all": ["x0", "x1", "x2"]}
    got = {(r["g"], r["family"], r["without"]): (r["n"], r["r2"]) for r in ST.ridge(df, ["g"], "y", families, "id", unique=True).collect()}
    train = {r["id"]: r["t"] for r in df.select("id", (F.pmod(F.xxhash64("id"), F.lit(10)) < 7).alias("t")).collect()}

    def r2(group, at):
        x, y, t = np.array([[r[2 + i] for i in at] for r in group]), np.array([r[5] for r in group]), np.array([train[r[1]] for r in group])
        z = (x - x[t].mean(0)) / x[t].std(0)
        a, b, rest = z[t], y[t] - y[t].mean(), y[~t] - y[t].mean()
        fits = [z[~t] @ np.linalg.solve(a.T @ a + k * np.eye(len(at)), a.T @ b) for k in (0.1, 1.0, 10.0, 100.0)]
        return max(1 - ((rest - f) ** 2).sum() / ((rest - rest.mean()) ** 2).sum() for f in fits)

    for g in "ab":
        group = [r for r in rows if r[0] == g]
        whole = r2(group, [0, 1, 2])
        assert abs(got[g, "one", None][1] - r2(group, [0])) < 1e-9 and abs(got[g, "all", None][1] - whole) < 1e-9
        assert abs(got[g, "all", "x1"][1] - (whole - r2(group, [0, 2]))) < 1e-9 and got[g, "one", None][0] == len(group)
    flat = got["d", "one", None][1]
    assert not any(k[0] == "c" for k in got) and (flat is None or np.isnan(flat))
    assert ST.ridge(df.limit(0), ["g"], "y", families, "id").collect() == []
