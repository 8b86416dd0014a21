"""How rows lie in partitions before work begins."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """`df` (of `columns`, if named) over all cores if it is a scan of fewer splits than those: a small table often is one row
    group, which one core would read and work on alone. Larger scans stay as they are, and so does what already
    comes from an exchange."""
    out = df.select(*columns) if columns else df
    if df.isStreaming or out._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return out
    cores = df.sparkSession.sparkContext.defaultParallelism
    return out.repartition(cores) if out._jdf.rdd().getNumPartitions() <= cores else out
