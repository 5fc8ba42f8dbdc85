"""Parallelism for small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: An input smaller than this for each core may be dealt out again; larger ones have splits enough.
SMALL = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, where it is small and lies in fewer files than there are cores; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df
