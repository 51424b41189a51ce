"""Queries against their SQL on small tables of rows on which the two once differed."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tracklake import queries


def differing(spark, folder, name, **tables):
    """Rows of the query and of its SQL that the other side hasn't."""
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.sql(queries.ORACLES[name])
    columns = want.columns
    want = {tuple(r) for r in want.fetchall()}
    return {tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, str(folder)).collect()} ^ want


def events(values, users=None, kinds=None):
    day = datetime.datetime(2024, 1, 1)
    n = len(values)
    return {"event_id": list(range(n)), "ts": [day + datetime.timedelta(minutes=i) for i in range(n)], "user_id": users or [1] * n, "event_type": kinds or ["view"] * n, "value": values, "props": ["{}"] * n}


def test_mean_confidence_just_below_and_above_a_tie(spark, tmp_path):
    values = [49.44875, 59.848749999999995, 40.49625, 60.943749999999994, 1.00005, 2.5]
    assert not differing(spark, tmp_path, "token_confidences", events=events(values, list(range(6))))


def test_bearing_by_price_and_quantity_together(spark, tmp_path):
    # one cent apart, but the cheaper line's quantity is larger by more than that counts
    n = 14
    lines = {"l_suppkey": [1] * n, "l_quantity": [50.0, 1.0] + [30.0] * (n - 2), "l_discount": [0.05] * n, "l_extendedprice": [1000.0, 1000.01] + [30000.0] * (n - 2)}
    assert not differing(spark, tmp_path, "scan_structure", lineitem=lines)


def test_nearest_class_by_price_and_part_together(spark, tmp_path):
    # one cent apart, but the cheaper line's part number is larger by more than that counts
    lines = {"l_orderkey": [1, 1, 2, 2], "l_partkey": [900_000, 3, 3, 4], "l_quantity": [30.0, 5.0, 30.0, 5.0], "l_extendedprice": [1000.0, 1000.01, 5.0, 5.0]}
    part = {"p_partkey": [900_000, 3, 4], "p_size": [0, 1, 2]}
    assert not differing(spark, tmp_path, "frame_counts", lineitem=lines, part=part)


def test_jumps_of_half_a_turn(spark, tmp_path):
    values = [0.0, 15.0, 0.0, 45.0, 30.0, 14.999999999999998, 30.0, 75.00000000000001, 0.3, 15.3, 45.3]
    assert not differing(spark, tmp_path, "unwrapped", events=events(values))


def test_controls_of_a_long_event_type(spark, tmp_path):
    n = 280_000  # place 271,181 times 7,919 is more than 2**31
    assert not differing(spark, tmp_path, "control_rows", events=events([float(i) for i in range(n)], [i % 7 for i in range(n)]))


def test_precision_envelope_in_linear_time(spark):
    from pyspark.sql import functions as F

    from tracklake.operators import scoring as SC

    n = 60_000
    rows = spark.range(n).select(F.lit(1).alias("g"), "id", (F.lit(float(n)) - F.col("id")).alias("c"), (F.col("id") % 3 == 0).alias("hit"), F.lit(n // 3).alias("n"))
    out = SC.average_precision(rows, ["g"], "c", "hit", "n", "id")
    hits, best, want = n // 3, 0.0, 0.0
    for k in range(n, 0, -1):
        best = max(best, hits / k)
        if (k - 1) % 3 == 0:
            want += best / (n // 3)
            hits -= 1
    assert abs(out.first()["ap"] - want) < 1e-9
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()


def test_quantiles_keep_no_map_of_all_values(spark):
    from pyspark.sql import functions as F

    from tracklake.operators import stats as ST

    inf, nan = float("inf"), float("nan")
    columns = {"a": [float(i * i % 101) for i in range(150)], "b": [1e9] * 100 + [0.5] * 50, "c": [inf, -inf, nan] + [None] * 140 + [2.0, 4.0, 4.0, 7.0, 9.0, 1.0, 0.0], "d": [None] * 150}
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns))
    got = ST.quantile_profile(df, list(columns))
    assert "percentile(" not in got._jdf.queryExecution().toString()
    for r in got.collect():
        want = df.agg(F.count(r["name"]), *[F.percentile(r["name"], q) for q in (0.01, 0.5, 0.99)]).first()
        assert str(tuple(r)[1:]) == str(tuple(want))


def test_tracking_reads_each_text_once(spark):
    from pyspark.sql import functions as F

    from tracklake.functions import text as X
    from tracklake.operators import scoring as SC

    rows = spark.createDataFrame([("#1 car 10m az+0deg", "#1 car 10m az+0deg; #2 bus 60m az-3deg", "t-1s: #1 car 10m az+0deg")], "g string, r string, p string")
    out = rows.select(SC.score_tracking(F.col("g"), F.col("r"), F.col("p")).alias("s"), SC.reward_tracking(F.col("g"), F.col("r"), F.col("p")).alias("v"))
    assert str(SC.score_tracking(F.col("g"), F.col("r"), F.col("p"))).count("(?:px)?") == 3 * str(X.objects(F.col("g"))).count("(?:px)?")
    row = out.first()
    assert (row["s"]["tp"], row["s"]["fn"], row["s"]["id_checkable"], row["s"]["id_carried"]) == (1, 1, 1, 1) and abs(row["v"] - (0.5 * 2 / 3 + 0.5)) < 1e-9
