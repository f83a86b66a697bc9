"""Counts, shares and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shares(df: DataFrame, by: str) -> DataFrame:
    """Rows and percentage per value; a comma-separated value counts once for each of its parts; null is ``default``."""
    total = df.agg(F.count("*").alias("n")).scalar()
    parts = df.select(F.explode(F.split(F.coalesce(F.col(by), F.lit("default")), ",")).alias(by))
    return parts.groupBy(F.trim(by).alias(by)).agg(F.count("*").alias("n")).withColumn("pct", F.round(100 * F.col("n") / total, 6))


def rollup(df: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Rows, distinct values and sum of a measure over all prefixes of the keys; ``level`` is the number kept."""
    filled = df.select(*(F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys), measure)
    out = filled.rollup(*keys).agg(F.count("*").alias("n"), F.count_distinct(measure).alias("distinct_values"), F.sum(measure).alias("total"), F.grouping_id().alias("_g"))
    return out.withColumn("level", F.lit(len(keys)) - F.bit_count("_g")).drop("_g")
