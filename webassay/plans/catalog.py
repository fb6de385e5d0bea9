"""Every query of the library by name, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webassay.plans import audit, crawl, job, marked
from webassay.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "audit", "crawl", "flagship", "job", "marked"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of an audit's findings, in all, by severity, by category and by id."""
    return audit.findings_summary(spark, sf_dir)
