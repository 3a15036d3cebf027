"""All queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectide.plans import core, ingest, measure  # noqa: F401  (they register their queries)
from vectide.plans.base import ORACLES, QUERIES, judged
from vectide.operators.spectrum import spectrum_by

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regimes and median shifts by dose band: which groups hold enough rows."""
    return spectrum_by(judged(spark, sf_dir), "band")
