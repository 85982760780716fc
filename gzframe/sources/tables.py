"""Reading tables of plain Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a table that counts as small.
SMALL = 64 * 2**20


def spread(df: DataFrame) -> DataFrame:
    """A small table in fewer files than there are cores, dealt over all cores.

    A file that small is one row group, which one task reads and all that
    follows would run in. Larger tables have many row groups and are left as
    they are: no shuffle is added where it would cost anything."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= SMALL and len(df.inputFiles()) < cores else df


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))
