"""Parquet tables by name."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder; columns and filters are pushed into the scan by the caller's plan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
