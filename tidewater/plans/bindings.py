"""The driver's tables as the analytics' canonical tables.

Each binding is one SQL text that Spark and DuckDB both run, so an operator and its oracle see the same input.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

BINDINGS: dict[str, str] = {
    "obs": """SELECT l_suppkey AS zone_id, l_returnflag AS indicator, l_shipdate AS observed_at, l_orderkey AS scene_id, l_linenumber AS line,
        l_extendedprice * l_discount * 0.1414213562e0 AS mean, l_extendedprice * l_tax * 0.1732050807e0 AS p90, l_quantity * 2 AS valid_pixel_pct, l_quantity AS water_fraction_pct FROM lineitem""",
    "quality": """SELECT l_suppkey AS zone_id, CASE WHEN l_returnflag = 'N' THEN l_returnflag || l_linestatus ELSE l_returnflag END AS indicator, l_shipdate AS observed_at, l_orderkey AS scene_id,
        l_extendedprice * l_discount * 0.1414213562e0 AS mean, l_quantity * 2 AS valid_pixel_pct, l_quantity AS water_fraction_pct FROM lineitem""",
    "bodies": """SELECT CAST(n_nationkey AS BIGINT) AS body_id, n_name AS name, r_name AS district, CAST(1 + n_nationkey % 3 AS BIGINT) AS tier,
        0.5e0 + n_nationkey * 0.7e0 AS area_km2, CASE n_nationkey % 4 WHEN 0 THEN 'reservoir' WHEN 1 THEN 'river' WHEN 2 THEN 'basin' ELSE 'pond' END AS water_tag,
        n_nationkey % 5 = 0 AS drinking_water, n_nationkey % 2 = 0 AS urban FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "zones": """SELECT s_suppkey AS zone_id, CAST(s_nationkey AS BIGINT) AS body_id, s_name AS name, s_suppkey AS seq, abs(s_acctbal) / 1000 AS area_km2 FROM supplier""",
    "rain": """SELECT CAST(n_regionkey AS BIGINT) AS body_id, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) * 1.414213562e-5 AS mm_24h
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, CAST(o_orderdate AS DATE)""",
    "rain_rows": """SELECT CAST(n_regionkey AS BIGINT) AS body_id, CAST(o_orderdate AS DATE) AS date, o_totalprice * 1.414213562e-5 AS mm_24h,
        CASE WHEN o_orderkey % 3 = 0 THEN 'archive' ELSE 'forecast' END AS source, o_orderkey AS fetched_at
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "scenes": """SELECT o_orderkey AS scene_id, CAST(c_nationkey AS BIGINT) AS body_id, o_orderdate AS sensed_at, CAST(floor(o_totalprice) AS BIGINT) % 100 AS cloud_pct,
        o_orderstatus AS state FROM orders JOIN customer ON o_custkey = c_custkey""",
    "pixels": """SELECT l_suppkey AS scene_id, l_orderkey * 10 + l_linenumber AS px, l_partkey % 5 AS zone_id, l_quantity * 30 AS b03, l_extendedprice / 60 AS b04,
        l_extendedprice / 80 + l_quantity AS b05, l_discount * 9000 AS b08, l_tax * 9000 AS b11, CAST(l_orderkey % 12 AS BIGINT) AS scl FROM lineitem""",
    "candidates": """SELECT o_orderkey AS candidate_id, CAST(c_nationkey AS BIGINT) AS zone_id, o_orderdate AS observed_at, o_orderpriority AS indicator,
        CAST(floor(o_totalprice) AS BIGINT) % 101 AS priority, CAST(o_orderkey % 4 AS BIGINT) AS votes, (CAST(floor(o_totalprice) AS BIGINT) % 1300) / 100 - 4 AS z, CAST(floor(o_totalprice / 7) AS BIGINT) % 50 / 10 AS area_km2,
        CAST(floor(o_totalprice / 3) AS BIGINT) % 101 AS valid_pct, (CAST(floor(o_totalprice / 11) AS BIGINT) % 101) / 100 AS rain_percentile, o_orderstatus AS state FROM orders JOIN customer ON o_custkey = c_custkey""",
}

_USED = re.compile(r"\b(" + "|".join(TABLES) + r")\b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One canonical table."""
    text = BINDINGS[name]
    used = {t: table(spark, sf_dir, t) for t in set(_USED.findall(text))}
    return spark.sql(_USED.sub(r"{\1}", text), **used)


def cte(*names: str) -> str:
    """The same canonical tables as the start of a WITH clause."""
    return ", ".join(f"{n} AS ({BINDINGS[n]})" for n in names)
