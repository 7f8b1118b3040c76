"""Running sums of groups that may be too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .cut import cut


def before(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str = "before") -> DataFrame:
    """rows with the sum of value over the rows of their group that come before them; order has to tell a group's rows apart.

    Rows are dealt to ranges of (group, order). A row's sum is that of its own range, by a window no larger than the
    range, and the sum of the ranges before, of which a group has no more than there are partitions.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.withColumn("_value", value).repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id())
    dealt = cut(dealt)  # which range a row is in is decided once
    ranges = dealt.groupBy(*group, "_part").agg(F.sum("_value").alias("_all"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*(F.col(g).alias(f"_g{k}") for k, g in enumerate(group)), F.col("_part").alias("_p"), F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_earlier"))
    inside = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("_own", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    same = F.col("_part") == F.col("_p")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return own.join(ranges, same).select(*rows.columns, (F.col("_earlier") + F.col("_own")).alias(name))
