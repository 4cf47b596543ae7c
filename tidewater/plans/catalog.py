"""Registered queries over the reference's own operators, and their oracles.

"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.plans import alerting, detection, fusion, monitoring, pixel_plans, registry_plans, reports, seasonal, source_plans, streams
from tidewater.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]
_MODULES = (alerting, detection, fusion, monitoring, pixel_plans, registry_plans, reports, seasonal, source_plans, streams)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged zone-indicator readings with their seasonal band."""
    return detection.flagged_readings(spark, sf_dir)
