"""All named queries, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.operators import reading as R
from pagewright.plans import fixtures as fx
from pagewright.plans import (  # noqa: F401
    intake_queries, layout_queries, metering_queries, reading_queries, region_queries,
    streaming_queries)
from pagewright.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES", "flagship"]


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Every page's text, mean confidence and number of boxes, from word boxes."""
    kept = R.gate_recognition(fx.regions_fx(spark, sf))
    return R.page_results(fx.page_base_fx(spark, sf), kept)
