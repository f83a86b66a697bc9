"""Driver queries of the record-level core operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.loglines import log_entries
from ..operators.packed import split_packed
from ..runtime import spread, table
from . import packed_sql

PACKED_FIELDS = ["keywords", "related_keywords", "business_capability"]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_packed(spread(table(spark, sf_dir, "keywords")), "entry_id", PACKED_FIELDS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_entries(table(spark, sf_dir, "log_entries"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found}
SQL = packed_sql.SQL
