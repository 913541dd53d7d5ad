"""Reading files that are split too little."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """A small scan dealt out evenly, if some few tasks would have most of its rows.

    A Parquet file is read by one task for each of its row groups, and a small table may
    have one. Scans of several tasks a core are as they are; of the others the rows of each
    task are counted first, from the files' footers alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() > 4 * cores:
        return df
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    if sum(sizes) < 64 or max(sizes) * cores <= 2 * sum(sizes):
        return df
    return df.repartition(2 * cores)
