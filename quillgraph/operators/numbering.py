"""Numbers in order within groups, without one task a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved


def numbered(df: DataFrame, *, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with `name`: 0, 1, 2, ... in order within each group of `by`; order must be unique there.

    Rows are range-partitioned by group and order, so a large group spans partitions. Each
    partition's share of a group is numbered on its own and starts after the shares before
    it, whose sizes are a row a partition and group.
    """
    by, order = list(by), list(order)
    ranged = saved(df.repartitionByRange(*[F.col(c) for c in (*by, *order)]).withColumn("_part", F.spark_partition_id()), "numbered")
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*by, "_part").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1
    return ranged.withColumn("_i", local).join(starts, [*by, "_part"]).withColumn(name, F.col("_start") + F.col("_i")).drop("_part", "_start", "_i")
