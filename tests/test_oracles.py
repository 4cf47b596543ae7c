"""A sample of registered queries against their DuckDB SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tidewater.plans.bindings import TABLES
from tidewater.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["B2_robust_statistics", "C2_trailing_72h", "C4_sync_plan", "D4_hot_pixel_gate", "F2_spatial_expansion", "X2_multiple_phrase", "A2_episodes", "V1_verdict", "V4_precision", "Q9_keyset_page", "M2_dilation", "N1_reflectance", "G2_polygon_area", "G3_rasterise", "G3_rasterise_buffered", "G4_interior_point", "G8_tile_lookup", "S8_windowed_read", "S9_resample_bilinear", "S17_report_rows", "S18_geojson", "S19_map_polygons", "S2_scene_catalog", "S11_backfill_chunks", "S1_load_registry", "T1_streaming_weekly_rollup", "T2_exactly_once", "T3_stateful_episodes", "T4_device_page", "A4_follow_ups", "X4_wording_guard", "G15_slug", "D15_rainfall_gate", "A8_alert_feed", "A9_alert_payload", "X3_summary", "O2_open_alerts", "T6_reading_bands", "S3_boa_offset", "N13_display_stretch", "M3_valid_mask", "M8_opening_and_closing", "M9_components", "M10_water_mask", "D5_dbscan_core_points", "D5_dbscan_clusters", "D6_cluster_stats", "D9_cluster_outline", "B3_extended_baseline", "B6_window_status", "S15_observation_table", "S18_feature_files", "S8_pruned_read", "T1_incremental_rollup", "T2_stage_input", "T3_closed_episodes"]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v + 0.0:.8g}")
    return str(v).removesuffix(" 00:00:00") if hasattr(v, "year") else v


@pytest.mark.parametrize("name", SAMPLE)
def test_equal_to_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    done = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in done.fetchall())


def test_entry_has_rows_and_every_oracle_has_a_query(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
