"""Table loading with enough parallelism for CPU-heavy text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{table}.parquet")


def load_text(spark: SparkSession, root: str, table: str, *columns: str) -> DataFrame:
    """Like :func:`load`, but spreads a table that has fewer input splits than cores.

    Parquet files with one row group give one task however large the cluster is.
    Large inputs already have more splits than cores and are read as they are,
    so no shuffle is added at scale.
    """
    df = load(spark, root, table)
    if columns:
        df = df.select(*columns)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
