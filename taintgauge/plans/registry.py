"""All queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taintgauge.plans import evidence_queries, model_queries, pool_queries, problem_queries, sampling_queries, score_queries  # noqa: F401
from taintgauge.plans.book import ORACLES, QUERIES  # noqa: F401


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["finding_low_prevalence"](spark, folder)
