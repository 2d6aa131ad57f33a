"""Named queries over the driver's tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quaver.plans import compare, curation, datasets, draws, search, series, spans, spectra, tables, training, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = search.QUERIES | series.QUERIES | compare.QUERIES | draws.QUERIES | spans.QUERIES | tables.QUERIES | vectors.QUERIES | spectra.QUERIES | training.QUERIES | curation.QUERIES | datasets.QUERIES
ORACLES: dict[str, str] = search.ORACLES | series.ORACLES | compare.ORACLES | draws.ORACLES | spans.ORACLES | tables.ORACLES | vectors.ORACLES | spectra.ORACLES | training.ORACLES | curation.ORACLES | datasets.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["sensitive_volume_chirp"](spark, sf_dir)
