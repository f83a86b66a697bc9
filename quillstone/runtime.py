"""Session-level helpers shared by all operators: tables, checkpoints and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows that an operator may broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 200_000
#: And most bytes, where the rows' sizes are known.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The scan of a small file in as many partitions as there are cores; a scan that has enough stays as it is.

    A scan with fewer partitions than cores holds no more than that many splits, so what is shuffled is bounded."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the shared folder of the cluster; choose one only where none is set (tests, local mode)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        given = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(given or os.path.join(tempfile.gettempdir(), "quillstone-checkpoints"))


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which outlives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: Column | None = None, most_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """The materialized frame with a broadcast hint if it has at most ``rows`` rows and, by the ``size`` of each, at
    most ``most_bytes`` bytes, else without.

    Returns the frame and whether it is broadcast, so that the caller can salt a shuffled join."""
    kept = materialize(df)
    found = kept.agg(F.count("*").alias("n"), F.sum(size if size is not None else F.lit(0)).alias("bytes")).first()
    small = found["n"] <= rows and (found["bytes"] or 0) <= most_bytes
    return (F.broadcast(kept) if small else kept), small


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str, salts: int = 16, by: str | None = None) -> DataFrame:
    """Shuffled join for a hot ``on`` key: ``right`` is copied once per salt, ``left`` rows take one each."""
    seed = F.hash(F.col(by)) if by else F.monotonically_increasing_id()
    one = left.withColumn("_salt", F.pmod(seed, F.lit(salts)).cast("int"))
    many = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return one.join(many, [*on, "_salt"], how).drop("_salt")
