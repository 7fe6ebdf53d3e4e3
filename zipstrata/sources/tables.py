"""Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; folder may be any path that Spark can read."""
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))


def spread(df: DataFrame, most_bytes: int = 256 << 20) -> DataFrame:
    """df over all cores, if it is small and in fewer files than there are cores.

    A file with one row group is one task, however long its rows take.  Large
    tables are left as they lie: their row groups keep all cores busy.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > most_bytes or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(2 * cores)


def dealt_by(df: DataFrame, column: str) -> DataFrame:
    """df by a key over all shuffle partitions.

    A join or grouping on the key that follows takes this partitioning.  It is
    not merged by size afterwards, as rows that are few bytes may be much work.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), column)
