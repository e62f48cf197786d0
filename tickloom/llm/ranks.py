"""Gapless ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import staged


def ranked(rows: DataFrame, group: str, order: list[str], what: str) -> DataFrame:
    """Adds ``idx`` (from 0 by ``order`` within ``group``) and ``size`` (rows of the group).

    Rows are dealt by ranges of group and order, sorted there and written once with their place;
    a partition's first rank is the sum of the counts before it, so a group of any size is spread over
    many tasks. Equal rows are spread by the input partition they come from. ``group`` must not
    be null; columns ``idx, size, row_no, salt`` are replaced.
    """
    kept = [c for c in rows.columns if c not in ("idx", "size", "row_no", "salt")]
    keys = [group, *order, "salt"]
    placed = rows.select(*kept, F.spark_partition_id().alias("salt")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = staged(placed.drop("salt").withColumn("row_no", F.monotonically_increasing_id()), what)  # partition and place
    part = F.shiftright("row_no", 33).alias("part")
    counts = placed.groupBy(group, part).agg(F.min("row_no").alias("first"), F.count(F.lit(1)).alias("n"))
    all_parts = W.partitionBy(group)  # a row per partition that the group reaches
    before = all_parts.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")
    bases = counts.select(F.col(group).alias("of"), "part", shift.alias("shift"), F.sum("n").over(all_parts).alias("size"))
    out = placed.withColumn("part", part).join(bases.withColumnRenamed("part", "in_part"), (F.col(group) == F.col("of")) & (F.col("part") == F.col("in_part")))
    return out.select(*kept, (F.col("row_no") + F.col("shift")).alias("idx"), "size")
