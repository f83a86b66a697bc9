"""Versioned snapshots of index tables: a folder per generation and a pointer that is replaced last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEEP = 2
POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def current(spark: SparkSession, root: str) -> int:
    """Number of the current generation; 0 if there is none or its pointer can't be read."""
    fs, path = _fs(spark, root)
    pointer = path(f"{root}/{POINTER}")
    if not fs.exists(pointer):
        return 0
    try:
        return int(spark.read.text(f"{root}/{POINTER}").first()[0])
    except (TypeError, ValueError):
        return 0


def save(spark: SparkSession, root: str, tables: dict[str, DataFrame], keep: int = KEEP) -> int:
    """Write the next generation whole, then move the pointer; older ones beyond ``keep`` go. A failed write leaves
    the current generation as it was."""
    fs, path = _fs(spark, root)
    fs.mkdirs(path(root))
    new = current(spark, root) + 1
    folder = f"{root}/gen_{new}"
    try:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
    except Exception:
        fs.delete(path(folder), True)
        raise
    temporary = path(f"{root}/_{POINTER}_{new}")
    out = fs.create(temporary, True)
    out.write(bytearray(str(new), "ascii"))
    out.close()
    fs.delete(path(f"{root}/{POINTER}"), False)
    if not fs.rename(temporary, path(f"{root}/{POINTER}")):
        raise OSError(f"the pointer of {root} can't be replaced")
    for status in fs.listStatus(path(root)):
        name = status.getPath().getName()
        if name.startswith("gen_") and int(name[4:]) <= new - keep:
            fs.delete(status.getPath(), True)
    return new


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    n = current(spark, root)
    fs, path = _fs(spark, root)
    folder = f"{root}/gen_{n}/{name}"
    if not n or not fs.exists(path(folder)):
        raise FileNotFoundError(folder)
    return spark.read.parquet(folder)
