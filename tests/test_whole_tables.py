"""Queries that once took a part of their table, against their SQL, which takes the whole."""

import re

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from tests.test_oracles import FOLDER, plain
from tidewater.plans.bindings import TABLES
from tidewater.plans.catalog import QUERIES

WHOLE = ("P1_recipients", "P2_send_decisions", "P1_audiences", "P1_reached_classes", "P2_new_dispatches", "A6_reference_scene", "Q7_series_payload", "J5_brief_series", "J5_episode_briefs", "Q2_body_states", "Q3_zone_states", "O2_gauges", "S10_block_plan", "C8_rain_percentile_rank", "D11_water_extent_delta", "B3_seasonal_baseline")


@pytest.mark.parametrize("name", WHOLE)
def test_whole_table_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    sql = entry.oracle_sql()[name]
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    wanted = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in done.fetchall())
    assert got and got == wanted


def test_slugs_cover_the_whole_text(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    out = {r["doc_id"]: r["slug"] for r in QUERIES["G15_slug"](spark, FOLDER).collect()}
    plain_ones = {i for i, t in texts.items() if t is not None and t.isascii() and len(t) > 60}
    assert plain_ones and out.keys() == texts.keys()
    assert all(out[i] == re.sub("[^a-z0-9]+", "_", texts[i].lower()).strip("_") for i in plain_ones)


def test_partition_takes_every_body_to_convergence(spark):
    rows = QUERIES["G12_zone_partition"](spark, FOLDER).toPandas()
    suppliers = {r["s_suppkey"] for r in spark.read.parquet(f"{FOLDER}/supplier.parquet").collect()}
    assert set(rows["id"]) == suppliers
    for _, body in rows.groupby("id"):
        p, zone = body[["x", "y"]].to_numpy(), body["zone"].to_numpy()
        assert set(zone) == set(range(min(4, len(p))))
        centres = np.array([p[zone == z].mean(0) for z in range(zone.max() + 1)])
        d = ((p[:, None] - centres) ** 2).sum(2)
        assert np.allclose(d[np.arange(len(p)), zone], d.min(1))
