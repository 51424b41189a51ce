"""Schemas of the core tables. Columns are always there; what wasn't measured is null, never 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EGOMOTION = "clip_id string, timestamp bigint, x double, y double, z double, qx double, qy double, qz double, qw double"
OBSTACLE = (
    "clip_id string, track_id string, timestamp_us bigint, label_class string, center_x double, center_y double, center_z double, "
    "size_x double, size_y double, size_z double, orientation_x double, orientation_y double, orientation_z double, orientation_w double, reference_frame string"
)
RADAR = "clip_id string, sensor string, timestamp bigint, azimuth double, elevation double, distance double, radial_velocity double, doppler_ambiguity double, rcs double"
EXTRINSICS = "clip_id string, sensor_name string, qx double, qy double, qz double, qw double, x double, y double, z double"
INTRINSICS = "clip_id string, sensor_name string, model_parameters string"
LENS = "principal_point array<double>, angle_to_pixeldist_poly array<double>, pixeldist_to_angle_poly array<double>, max_angle double, linear_cde array<double>, resolution array<int>"
CLIPS = "clip_id string, chunk int, split string, clip_is_valid boolean, country string, month int, hour_of_day int, platform_class string, radar_config string, has_srr0 boolean, has_mrr2 boolean, has_lrr1 boolean, has_obstacle boolean, has_egomotion boolean, has_radar_extrinsics boolean, ood_cluster string"
TRACKS = (
    "clip_id string, chunk int, track_id string, label_class string, n_obs bigint, t_start_us bigint, t_end_us bigint, duration_s double, rig_net_disp_m double, rig_path_len_m double, "
    "world_net_disp_m double, world_path_len_m double, world_mean_speed_ms double, is_stationary boolean, mean_range_m double, frac_in_front_fov double"
)
ITEMS = "clip_id string, task string, frame int, prompt string, target string, strat string, needs_radar boolean, split string"
QA = (
    "clip_id string, chunk int, split string, filename string, n_qa int, qa array<struct<id: string, question: string, options: map<string,string>, answer: string, rationale: string, taxonomy: string, "
    "verification: struct<status: string, n_checks: int, n_pass: int>, corrections: array<struct<kind: string, frame: int, error: double, verdict: string, stated: array<string>, computed: array<string>>>>>"
)
GENERATIONS = "task string, mode string, form string, clip_id string, prompt string, generated string, reference string, confidence array<double>, samples array<string>, user string"
VERIFICATION = "clip_id string, qa_index int, taxonomy string, n_checks int, n_pass int, claims string"


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df with exactly the schema's columns: those it lacks are typed nulls."""
    wanted = df.sparkSession.createDataFrame([], schema).schema
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
